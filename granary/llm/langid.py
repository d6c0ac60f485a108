"""Language identification by Bayesian evidence fusion.

For each row, log-likelihoods of its text under hashed byte trigrams of each language are fused with the markup's declared
language, the address suffix and a prior of its host. How far a declaration or a suffix can be trusted, and what a host's
pages are written in, is learnt from the rows themselves by grouped aggregation of the text's posteriors: a host's prior is
smoothed by its domain's, that by the suffix's, that by the whole. A row never votes for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._shared import materialize

BUCKETS = 1 << 15
TEMPER = 0.05  # trigrams of a text are far from independent: each counts as so much of one
STRENGTH = 4.0  # rows that a wider prior counts as
DECLARED_FLOOR = 1.0


def trigrams(data: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text."""
    a = np.frombuffer(b" " + data.lower() + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    h = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(17)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            t = trigrams(data)
            if len(t) > BUCKETS // 4:
                own += np.bincount(t, minlength=BUCKETS)
            else:
                np.add.at(own, t, 1)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "bucket", "n"])


def text_model(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log-probabilities (language x bucket), from all labelled rows; null labels are left out."""
    own = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counts = own.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums: dict[str, np.ndarray] = {}
    for r in counts.toLocalIterator():  # at most BUCKETS rows for each language
        sums.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    langs = sorted(sums) or ["und"]
    smooth = np.stack([sums.get(k, np.zeros(BUCKETS)) for k in langs]) + 0.5
    return langs, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def _likelihood_udf(logp: np.ndarray):
    """Tempered log-likelihoods, the best at 0. The text itself doesn't leave the worker."""
    table = np.ascontiguousarray(logp.T)

    @F.arrow_udf("array<double>")
    def likelihoods(texts: pa.Array) -> pa.Array:
        out = []
        for data in texts.to_pylist():
            t = trigrams(data or b"")
            total = np.zeros(table.shape[1])
            for at in range(0, len(t), 1 << 20):
                total += table[t[at : at + (1 << 20)]].sum(0, dtype=np.float64)
            out.append((TEMPER * (total - total.max())).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return likelihoods.asNondeterministic()


def visible(html) -> "F.Column":
    """The text of a page's article, or of all of it where it has none, without scripts, styles, navigation, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>", " ")
    article = F.regexp_extract(bare, r"(?is)<article\b[^>]*>(.*?)(</article>|\z)", 1)
    return F.regexp_replace(F.when(F.length(article) > 0, article).otherwise(F.regexp_replace(bare, r"(?is)<head\b.*?</head\s*>", " ")), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")


def declared(html) -> "F.Column":
    """The primary subtag of the html element's lang, or null."""
    found = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    return F.when(found != "", found)


def host(url) -> "F.Column":
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def domain(host_) -> "F.Column":
    """The last two labels of a host."""
    return F.regexp_extract(host_, r"([^.]+\.[^.]+)$", 1)


def suffix(host_) -> "F.Column":
    return F.regexp_extract(host_, r"\.([^.]+)$", 1)


def fuse(evidence: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """evidence: any columns, and text binary, declared, host, domain, suffix. Returns them without the text, with
    text_lang (by the text alone), lang and score (its posterior).

    Null or empty texts say nothing; a missing declaration, host or suffix is a value of its own. Ties go to the language
    first in order. Rows are independent but for the aggregates; repeated rows count again."""
    n = len(langs)
    keep = [c for c in evidence.columns if c != "text"]
    base = evidence.select(*keep, _likelihood_udf(logp)(F.coalesce("text", F.lit("").cast("binary"))).alias("__ll"))
    base = base.select(*keep, *[F.col("__ll")[i].alias(f"__ll{i}") for i in range(n)])
    e = [F.exp(f"__ll{i}") for i in range(n)]
    total = sum(e[1:], e[0])
    base = base.select("*", *[(x / total).alias(f"__p{i}") for i, x in enumerate(e)])
    base = materialize(base.fillna("", ["declared", "host", "domain", "suffix"]), "evidence")
    sums = lambda at, name: base.groupBy(*at).agg(*[F.sum(f"__p{i}").alias(f"{name}{i}") for i in range(n)]).select(*[F.col(c).alias(f"{name}_{c}") for c in at], *[f"{name}{i}" for i in range(n)])
    whole = base.agg(*[F.coalesce(F.sum(f"__p{i}"), F.lit(0.0)) for i in range(n)]).first()
    rows = sum(whole)
    prior = [(whole[i] + 1.0) / (rows + n) for i in range(n)]
    met = base
    for name, at in (("__h", ["host", "domain", "suffix"]), ("__d", ["domain", "suffix"]), ("__s", ["suffix"]), ("__c", ["declared"])):
        part = sums(at, name)
        met = met.join(part, [F.col(c) == F.col(f"{name}_{c}") for c in at]).drop(*[f"{name}_{c}" for c in at])
    # a row is taken out of every sum it is in
    out = lambda name, i: F.greatest(F.col(f"{name}{i}") - F.col(f"__p{i}"), F.lit(0.0))
    size = lambda name: sum((out(name, i) for i in range(1, n)), out(name, 0))
    point = []
    for i in range(n):
        by_suffix = (out("__s", i) + STRENGTH * prior[i]) / (size("__s") + STRENGTH)
        by_domain = (out("__d", i) + STRENGTH * by_suffix) / (size("__d") + STRENGTH)
        by_host = (out("__h", i) + STRENGTH * by_domain) / (size("__h") + STRENGTH)
        # P(declared | language), but for a factor that all languages share
        says = (out("__c", i) + DECLARED_FLOOR * prior[i]) / F.lit(whole[i] + DECLARED_FLOOR)
        point.append(F.col(f"__ll{i}") + F.log(by_host) + F.log(says))
    met = met.select(*keep, F.array(*[F.struct((-F.col(f"__ll{i}")).alias("x"), F.lit(i).alias("i")) for i in range(n)]).alias("__t"), F.array(*[F.struct((-p).alias("x"), F.lit(i).alias("i")) for i, p in enumerate(point)]).alias("__f"))
    met = met.withColumn("__best", F.array_min("__f"))
    names = F.array(*[F.lit(k) for k in langs])
    score = 1 / F.aggregate("__f", F.lit(0.0), lambda s, x: s + F.exp(F.col("__best.x") - x["x"]))
    return met.select(*keep, F.element_at(names, F.array_min("__t")["i"] + 1).alias("text_lang"), F.element_at(names, F.col("__best.i") + 1).alias("lang"), score.alias("score"))


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.lit(None).cast("long").alias("doc_id"), visible(html).cast("binary").alias("text"), declared(html).alias("declared"), host(F.col(url_col)).alias("host"))
    return own.withColumn("domain", domain(F.col("host"))).withColumn("suffix", suffix(F.col("host")))


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents have no markup and no address; their source takes the host's place."""
    return docs.select(F.lit(None).cast("long").alias("page_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.lit(None).cast("string").alias("declared"), F.col(source_col).cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))
