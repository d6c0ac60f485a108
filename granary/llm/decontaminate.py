"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark items, searched in each document's word sequence. For patterns of m words a
shift table over two-word blocks tells how far the search may move on; a block that ends a pattern gives shift 0 and leads
to a bucket of patterns by that suffix, which are compared word by word. Windows of fewer words (short items) have tables
of their own for each length, so they don't shorten the shifts of the long ones.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._shared import utf8

WINDOW = 10
#: Windows searched in one pass over the documents; beyond it the benchmark is searched in blocks, one pass each.
MAX_WINDOWS = 400_000
# A-Z become lower case; digits, a-z and the bytes of non-ASCII characters stay; all others separate words
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return data.translate(_TABLE).split()


class Searcher:
    """Wu-Manber tables for patterns of equal length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int) -> None:
        self.m = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))  # by last block, then by first word
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[self._key(pattern, length)][pattern[0]].append((pattern, items))

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def occurrences(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        m, get, default, n = self.m, self.shift.get, self.default, len(words)
        if self.block == 1:
            for i, w in enumerate(words):
                if w in self.buckets:
                    yield i, self.buckets[w][w][0][1]
            return
        i = m - 1
        while i < n:
            key = (words[i - 1], words[i])
            step = get(key, default)
            if step:
                i += step
                continue
            start = i - m + 1
            if near := self.buckets[key].get(words[start]):
                at = tuple(words[start : i + 1])
                for pattern, items in near:
                    if pattern == at:
                        yield start, items
            i += 1


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def searchers(items: list[tuple[int | None, bytes]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict = defaultdict(lambda: defaultdict(list))
    for item, data in items:
        for w in windows_of(words_of(data), window):
            at = by_length[len(w)][w]
            if item not in at:
                at.append(item)
    return [Searcher(p, n) for n, p in by_length.items()]


def search(words: list[bytes], tables: list[Searcher]) -> tuple[list[tuple[int, int]], set]:
    """Merged [start, end) runs of hit words, and the items with an occurrence."""
    runs, items = [], set()
    for t in tables:
        for start, found in t.occurrences(words):
            runs.append((start, start + t.m))
            items.update(found)
    return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_REPORT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
REPORT = "struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,hit_runs:array<array<long>>,items:array<string>>"


def report(n: int, runs: list[tuple[int, int]], items) -> dict:
    names = sorted("" if i is None else str(i) for i in items)
    hit = sum(b - a for a, b in runs)
    return {"n_words": n, "n_hit": hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "contaminated": hit > 0, "hit_runs": [[a, b] for a, b in runs], "items": names}


def _scan_udf(tables: list[Searcher]):
    @F.arrow_udf(REPORT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = words_of(t.as_buffer().to_pybytes() if t.is_valid else b"")
            out.append(report(len(words), *search(words, tables)))
        return pa.array(out, _REPORT)

    return scan.asNondeterministic()


def _merge_udf():
    @F.arrow_udf(REPORT)
    def join(one: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(one.to_pylist(), other.to_pylist(), strict=True):
            names = sorted({*a["items"], *b["items"]})
            out.append(report(a["n_words"], merged([tuple(r) for r in a["hit_runs"] + b["hit_runs"]]), names))
        return pa.array(out, _REPORT)

    return join.asNondeterministic()


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS, into: str = "contamination") -> DataFrame:
    """docs with one more column (struct `into`, replacing one of that name): n_words, n_hit, n_items, items_sha256,
    contaminated, hit_runs (word positions [start, end)), items (sorted as strings).

    Null and wordless texts have no words and no hits. Repeated document rows each get their report; items that share an
    id count once; an item with a null id is named by the empty string. An empty benchmark marks nothing. The benchmark
    is sent to executors in blocks of at most max_windows windows, each a pass over the documents' words."""
    items = benchmark.select(F.col(item_col).alias("i"), utf8(item_text_col).alias("t"))
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * max_windows)))  # a window starts at a word, and a word and its separator take two bytes
    out, text = docs.drop(into), utf8(text_col)
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        scanned = _scan_udf(searchers([(r.i, bytes(r.t)) for r in part.toLocalIterator()], window))(text)
        if not k:
            out = out.withColumn(into, scanned)
        else:
            out = out.withColumn("__next", scanned).withColumn(into, _merge_udf()(into, "__next")).drop("__next")
    return out


def passages(text: str, hit_runs: list[list[int]]) -> list[str]:
    """The hit passages of a text, for reports and tests."""
    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [text[found[a][0] : found[b - 1][1]] for a, b in hit_runs]
