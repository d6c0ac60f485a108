"""Secret scan: Aho-Corasick keyword prefilter, regular expressions anchored at the hits, checksums of the tokens found.

One automaton holds the keywords of every rule. Keyword-less hexadecimal runs are caught by all four-character
hexadecimal strings, so that a run's first characters are themselves a hit. Rules only ever match at a hit, leftmost first
and not inside the rule's last match, which is what a search of the whole text by the rule alone would give.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._shared import utf8

KINDS = ("assign", "access", "hex", "checked")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# published token prefixes whose last six characters are the base-62 CRC-32 of the 30 before
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")  # on lower-cased text
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of body in base 62, six digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out


@lru_cache(1)
def _automaton():
    a = ahocorasick.Automaton()
    for w in ("".join(x) for x in product("0123456789abcdef", repeat=4)):
        a.add_word(w, (4, 2))
    for kind, words in ((0, ASSIGN_WORDS), (1, ("akia",)), (3, CHECKED_PREFIXES)):
        for w in words:
            a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret, in that order; code points, end exclusive."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only, so positions stay
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in _automaton().iter(low))
    done, out = [0, 0, 0, 0], []
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == 2:
            m = _HEX.match(text, start)
            ok = m and m.end() - start >= 24
        elif kind == 0:
            m = _ASSIGN.match(low, start)
            ok = m and m.end(2) - m.start(2) >= 6
        elif kind == 1:
            m = _ACCESS.match(text, start)
            ok = m and m.end() - start >= 20
        else:
            m = _CHECKED.match(text, start)
            ok = m and checksum62(m[1]) == m[2]
        if m:
            done[kind] = m.end()
        if ok:
            out.append((start, kind, m.end()))
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "<secret>") -> str:
    """text with each run of overlapping spans replaced by mask."""
    out, at = [], 0
    runs: list[list[int]] = []
    for a, _, b in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


REPORT = "struct<n_assign:long,n_access:long,n_hex:long,n_checked:long,base_sha256:string,spans:string,redacted:string>"
_REPORT = pa.struct([(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex", "n_checked")] + [(n, pa.string()) for n in ("base_sha256", "spans", "redacted")])
_FIELDS = [f.name for f in _REPORT]


def _scan_udf(texts_out: bool, mask: str):
    @F.arrow_udf(REPORT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
            spans = find(text)
            n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            base = _joined(s for s in spans if s[1] < 3)
            out.append(dict(zip(_FIELDS, [*n, hashlib.sha256(base.encode()).hexdigest(), _joined(spans), redact(text, spans, mask) if texts_out and spans else None], strict=True)))
        return pa.array(out, _REPORT)

    return scan.asNondeterministic()


def secret_scan(docs: DataFrame, text_col: str = "text", texts: bool = False, mask: str = "<secret>", into: str = "secrets") -> DataFrame:
    """docs with one more column (struct `into`, replacing one of that name): counts by kind, base_sha256 and spans, and
    with texts=True `redacted`, the text with its secrets masked (null where there are none).

    Whole texts are read; null counts as empty, and an empty text has no spans. Rows are independent: repeated rows get
    the same report, and an empty table an empty result."""
    return docs.drop(into).withColumn(into, _scan_udf(texts, mask)(utf8(text_col)))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "<secret>") -> DataFrame:
    """docs with secrets masked in their texts and length_col, if there, set to the new length of changed texts."""
    found = secret_scan(docs, text_col, True, mask, "__secrets")
    masked = F.col("__secrets.redacted")
    if length_col and length_col in docs.columns:
        found = found.withColumn(length_col, F.when(masked.isNotNull(), F.length(masked)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return found.withColumn(text_col, F.coalesce(masked, text_col)).select(docs.columns)
