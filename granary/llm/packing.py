"""Sequence packing by minimum bin slack over a histogram of lengths.

Documents are cut into full pieces and a remainder. Only the histogram of remainder lengths (at most CAPACITY - 1 numbers,
whatever the input) is needed to plan: again and again, the longest length left opens a window, and a bitset subset-sum
over the lengths left, with their counts, finds the multiset that fills it closest; it is used as often as the counts
allow. Where no multiset fills a window exactly, one more piece is cut to fill it. The plan says which ranks of each
length go where; executors apply it to their own rows, so no document ever moves for it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm._shared import materialize, utf8
from granary.llm.subwords import default_path, encoder

CAPACITY = 2048
END_ID = 1
BROADCAST_ROWS = 500_000  # (partition, length) offsets up to which they are broadcast; beyond, they are joined by shuffle


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to room from below. Bitset dynamic programming over
    the lengths, longest first, each count split in powers of two; the steps are kept and walked back for the counts."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + k
            at -= n * k
    return chosen


@dataclass(frozen=True)
class Entry:
    """Ranks [a, b) of pieces of length `kind`: `size` ids from `sub` on go to a sequence as the t-th of `each` per sequence."""

    kind: int
    a: int
    b: int
    sub: int
    size: int
    t: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Entry]:
    """Entries for every piece counted in histogram. Their number depends on the capacity only, not on the counts."""
    left = {n: c for n, c in histogram.items() if c}
    pool: dict[int, list[tuple[int, int, int, int]]] = {n: [(n, 0, c, 0)] for n, c in left.items()}
    entries: list[Entry] = []
    sequence = 0

    def take(n: int, many: int) -> Iterator[tuple[int, int, int, int]]:
        left[n] -= many
        while many:
            kind, a, b, sub = pool[n].pop()
            if b - a > many:
                pool[n].append((kind, a + many, b, sub))
                b = a + many
            many -= b - a
            yield kind, a, b, sub
        if not left[n]:
            del left[n], pool[n]

    def put(n: int, each: int, m: int, offset: int) -> None:
        t = 0
        for kind, a, b, sub in take(n, each * m):
            entries.append(Entry(kind, a, b, sub, n, t, each, sequence, offset))
            t += b - a

    while left:
        top = max(left)
        left[top] -= 1
        chosen = fill(left, capacity - top)
        left[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        m = min(left[n] // k for n, k in chosen.items())
        slack = capacity - sum(n * k for n, k in chosen.items())
        cut = max(((min(m, left[n] // (chosen.get(n, 0) + 1)), n) for n in left if n > slack), default=(0, 0)) if slack else (0, 0)
        m = cut[0] or m
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            put(n, k, m, offset)
            offset += n * k
        if cut[0]:
            t, n = 0, cut[1]
            for kind, a, b, sub in list(take(n, m)):
                entries.append(Entry(kind, a, b, sub, slack, t, 1, sequence, offset))
                t += b - a
                pool.setdefault(n - slack, []).append((kind, a, b, sub + slack))
                left[n - slack] = left.get(n - slack, 0) + b - a
        sequence += m
    return entries


class Lookup:
    """The entries of a piece, by its length and rank."""

    def __init__(self, entries: list[Entry]) -> None:
        by: dict[int, list[Entry]] = {}
        for e in entries:
            by.setdefault(e.kind, []).append(e)
        self.at: dict[int, tuple[list[int], list[list[Entry]]]] = {}
        for kind, own in by.items():
            edges = sorted({x for e in own for x in (e.a, e.b)})
            where = {x: i for i, x in enumerate(edges)}
            parts: list[list[Entry]] = [[] for _ in edges]
            for e in own:
                for i in range(where[e.a], where[e.b]):
                    parts[i].append(e)
            self.at[kind] = (edges, [sorted(p, key=lambda e: e.sub) for p in parts])

    def places(self, kind: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(sub, size, sequence, offset) of each part of the piece."""
        edges, parts = self.at[kind]
        for e in parts[bisect_right(edges, rank) - 1]:
            q, r = divmod(e.t + rank - e.a, e.each)
            yield e.sub, e.size, e.sequence + q, e.offset + r * e.size


PIECES = "part int, doc_id long, doc_tokens long, start long, length int, rank long, ids binary"


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, to = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for batch in batches:
            at = 0
            for ids, ends in to.encode(batch.column(1)):
                ids = np.insert(ids, ends, end_id).astype("<u4")
                size = np.diff(ends, prepend=0) + 1
                pieces = -(-size // capacity)
                owner = np.repeat(np.arange(len(size)), pieces)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, size[owner] - start)
                order = np.argsort(length, kind="stable")  # ranks go on from those of the pieces of the same length before
                first = np.concatenate([[0], np.flatnonzero(np.diff(length[order])) + 1])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order))) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                cuts = pa.array(np.concatenate([[0], 4 * np.cumsum(length)]), pa.int64()).buffers()[1]
                blobs = pa.Array.from_buffers(pa.large_binary(), len(length), [None, cuts, pa.py_buffer(ids)]).cast(pa.binary())
                doc_id = batch.column(0).slice(at, len(size)).take(pa.array(owner))
                at += len(size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), part, np.int32)), doc_id, pa.array(size[owner]), pa.array(start), pa.array(length.astype(np.int32)), pa.array(rank), blobs], names=["part", "doc_id", "doc_tokens", "start", "length", "rank", "ids"])

    return run


def _placer(entries, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(entries.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, doc_tokens, start, length, rank, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for sub, size, sequence, offset in lookup.places(length, rank):
                    own = ids[4 * sub : 4 * (sub + size)]
                    rows.append((doc_id, start + sub, size, zlib.crc32(own), doc_tokens, sequence, offset, own if keep_ids else None))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)][: 7 + keep_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + keep_ids])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the ids
    (little-endian unsigned 32-bit).

    Whole texts are packed; a null or empty text is its end id alone. Repeated rows and ids are packed as often as they
    occur, and a null id stays null. Every sequence but the last ones of the plan is full; the last is padded to the
    capacity unless its length is a power of two. An empty table gives no piece."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    pieces = materialize(base.mapInArrow(_cutter(tokenizer or default_path(), end_id, capacity), PIECES), "pieces")
    sizes = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    entries = spark.sparkContext.broadcast(plan(totals, capacity))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if sizes.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "doc_tokens", "start", "length", (F.col("rank") + F.col("first")).alias("rank"), "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return ranked.mapInArrow(_placer(entries, keep_ids), schema)
