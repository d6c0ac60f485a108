"""I-Match document fingerprints with randomised lexicons, in DataFrame functions only.

Terms are hashed; the document frequencies of 2**20 hash buckets, counted over all documents, decide which terms lie in the
chosen inverse-document-frequency band. The table that says so is one byte for each bucket, so what every task gets has a
fixed size. A document's distinct terms of the band, sorted, are hashed once as a whole and once for each of SERIES
randomised lexicons. A lexicon is a series of nested subsets, each half of the one before; the sparsest that still holds a
term of the document is hashed. So it covers a term or two of short and long documents alike, and survives an edit of the
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 20
SERIES = 16
PLACE_BITS = 24  # a term's place in a lexicon: these upper bits of its hash, after an exclusive or with the lexicon's salt
BAND = (0.001, 0.1)  # of the documents, in which a term of the lexicon occurs; at least MIN_DF
MIN_DF = 2
SPLITS = 256  # ranges of ids that are chained separately
_WORDS = r"[\s\p{Punct}]+"


def terms(text: Column) -> Column:
    """Distinct hashes of the lower-cased words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), _WORDS), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> bytes:
    """One byte for each bucket: 1 where its share of the documents lies in the band. Frequencies cover all documents;
    what comes to the driver is a bitmap of the buckets."""
    n = docs.count()
    hits = docs.select(F.explode(F.array_distinct(F.transform(terms(F.coalesce(F.col(text_col), F.lit(""))), _bucket))).alias("b"))
    df = hits.groupBy("b").agg(F.count("*").alias("df")).filter((F.col("df") >= max(MIN_DF, band[0] * n)) & (F.col("df") <= max(MIN_DF, band[1] * n)))
    bitmaps = df.select(F.col("b").cast("long").alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    flags = bytearray(1 << BUCKET_BITS)
    for r in bitmaps.collect():
        base = (r["at"] - 1) * 8 * len(r["bits"])
        for i, byte in enumerate(r["bits"]):
            for k in range(8):
                if byte >> k & 1:
                    flags[base + 8 * i + k] = 1
    return bytes(flags)


def _salt(series: int) -> int:
    """Fixed pseudo-random upper bits for each lexicon."""
    mixed = (series + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return (mixed >> 32) % (1 << PLACE_BITS)


def _place(term: Column, series: int) -> Column:
    return F.shiftrightunsigned(term, 64 - PLACE_BITS).bitwiseXOR(F.lit(_salt(series)))


def with_subhashes(df: DataFrame, text: Column, flags: bytes, into: str) -> DataFrame:
    """df with an array of 1 + SERIES sub-hashes of text, all 0 for a text without terms of the band."""
    table = F.lit(bytearray(flags))
    digest = lambda a: F.when(F.size("__terms") > 0, F.pmod(F.xxhash64(a), F.lit(65535)) + 1).otherwise(0).cast("int")
    others = [F.col(c) for c in df.columns if c != into]
    df = df.select(*others, F.array_sort(F.filter(terms(text), lambda t: F.substr(table, _bucket(t) + 1, F.lit(1)) == F.lit(bytearray(b"\x01")))).alias("__terms"))
    least = [F.array_min(F.transform("__terms", (lambda m: lambda t: _place(t, m))(m))) for m in range(SERIES)]
    df = df.select(*others, "__terms", *[F.expr("1L").alias("__one"), *[x.alias(f"__least{m}") for m, x in enumerate(least)]])
    df = df.select(*others, "__terms", *[F.call_function("shiftleft", "__one", F.floor(F.log2(F.col(f"__least{m}") + 1)).cast("int") + 1).alias(f"__below{m}") for m in range(SERIES)])
    own = [digest(F.filter("__terms", (lambda m: lambda t: _place(t, m) + 1 < F.col(f"__below{m}"))(m))) for m in range(SERIES)]
    return df.select(*others, F.array(digest(F.col("__terms")), *own).alias(into))


def fingerprint(hashes: Column) -> Column:
    """Four hexadecimal digits for each sub-hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal sub-hashes among those that either has; 1 where neither has any."""
    either = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (x == y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def with_next(docs: DataFrame, columns: list[str], splits: int = SPLITS) -> DataFrame:
    """docs (with columns `id` and `tie`) and next_<column>: that column of the row that follows by (id, tie); after the
    last comes the first. Each text moves once: ids are cut into ranges, and the first rows of a range are also dealt to the
    range before it, where only the last row looks at them."""
    least = -(1 << 63)
    key = F.coalesce("id", F.lit(least).cast("long"))
    bounds = docs.select(F.percentile_approx(key, [i / splits for i in range(1, splits)], 10 * splits).alias("at")).first()["at"] or []
    bounds = sorted(set(bounds))
    at = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= key)) if bounds else F.lit(0)
    ranged = docs.withColumn("__key", key).withColumn("__at", at).withColumn("__copy", F.lit(0))
    firsts = sorted((r["__at"], r["k"]) for r in ranged.groupBy("__at").agg(F.min("__key").alias("k")).collect())
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # the last range comes before the first
    if not before:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    pairs = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    copies = ranged.filter(F.col("__key").isin(list(before))).withColumn("__at", F.element_at(pairs, F.col("__key"))).withColumn("__copy", F.lit(1))
    order = W.partitionBy("__at").orderBy("__copy", "__key", "tie")
    met = ranged.unionByName(copies).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return met.filter("__copy = 0").drop("__key", "__at", "__copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by the start of the next document's, by ascending id; null ids
    come first, and rows that share an id follow each other by a hash of their texts. A null text counts as empty; a text
    without lexicon terms has a fingerprint of zeros, whose likeness to another such one is 1. A single row is its own next.
    An empty table gives an empty result. No other column is read."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    flags = lexicon(base, "text", band)
    own = with_subhashes(base, F.col("text"), flags, "own")
    met = with_next(own, ["text", "own"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    met = met.select("id", n.cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"))
    out = with_subhashes(met, F.col("edited"), flags, "new")
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
