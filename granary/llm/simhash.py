"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits have a segment
that differs in at most one, so they meet in an equality join on that segment with one position masked (32 masks for each
segment). Meetings are verified on the whole fingerprint. Only distinct fingerprints are indexed, so copies cost nothing.

One shuffle brings the members of each key together, in order of keys, and each pair is told by the lowest key that both
share, so that a pair that meets under many keys is told once. Groups that meet under one key are never expanded into pairs:
- keys with up to HOT members are linked in a streaming pass that keeps one key in memory and emits edges of a spanning forest;
- larger ones are known beforehand, from counts of whole segments (a key has the members of two), and are dealt out by
  one-wildcard variants of the other half (two quarters of 16 bits) instead. Such a sub-key fixes 46 of 64 bits, so it holds at
  most 2**18 distinct fingerprints, whatever the input: exact, and bounded.

Near-duplicates by a similarity of word shingles start from the same: texts of equal fingerprints, and those that the
fingerprints' links join, are compared by their shingles, which decide. Similar texts whose fingerprints differ in more bits
are then found exactly, whatever the size of a group. Put in one order, two sets of n shingles that have at least the share t
of each in common have one in common among their first n - ceil(t * n) + 1, so an equality join on those brings every such pair
together. Parity maps of the sets rule out most of the others, and the shingles of both texts decide here too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._shared import discard, materialize, utf8
from granary.llm.components import connected_components

HOT = 2048  # members of a key beyond which it is dealt out again
BLOCK = 1 << 16  # shingle hashes counted at a time
BLOCK_MEMBERS = 2048  # members of a shingle beyond which they are compared in pairs of blocks
COMMON_OF = 16  # one id of so many counts to see which shingles are common
COMMON_LEAST = 16  # texts of those that a common shingle has at least
COMMON_MOST = 100_000  # common shingles that are told to every task
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(data: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 for a text without words."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    text = memoryview(b" ".join(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[min(shingle, len(words)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(text[a : b - 1], 42) for a, b in zip(starts[at : at + BLOCK], last[at : at + BLOCK], strict=False)), np.uint64)
        for k, column in enumerate(h.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            counts[8 * k : 8 * k + 8] += np.bincount(column, minlength=256) @ _BITS
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprint_udf(shingle: int = 3):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts], np.uint64).view(np.int64))

    return fingerprint.asNondeterministic()


def _forest(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs of x that are near; compares with what is not yet reached only."""
    one, other, left = [], [], np.arange(len(x))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = []
            for f in front:
                hit = np.bitwise_count(x[left] ^ x[f]) <= bits
                if hit.any():
                    found.append(left[hit])
                    one.append(found[-1])
                    other.append(np.full(len(found[-1]), f))
                    left = left[~hit]
                    if not len(left):
                        break
            front = np.concatenate(found) if found else np.empty(0, np.int64)
    return tuple(x[np.concatenate(side)] if side else x[:0] for side in (one, other))


def _near_grid(x: np.ndarray, bits: int) -> np.ndarray:
    """The same for many fingerprints that agree outside few bits: looks up every mask of those bits in a table of members."""
    vary = int(np.bitwise_or.reduce(x ^ x[0]))
    free = [i for i in range(64) if vary >> i & 1]
    at = np.zeros(len(x), np.int64)
    for k, i in enumerate(free):
        at |= ((x >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k
    where = np.full(1 << len(free), -1, np.int64)
    where[at] = np.arange(len(x))
    comp = np.arange(len(x))
    masks = [sum(1 << i for i in m) for r in range(1, bits + 1) for m in combinations(range(len(free)), r)]
    while True:
        before = comp.copy()
        for m in masks:
            other = where[at ^ m]
            ok = other >= 0
            comp[ok] = np.minimum(comp[ok], comp[other[ok]])
        comp = comp[comp]
        if (comp == before).all():
            return comp


def _link(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is near among the fingerprints of one sub-key."""
    x = np.unique(x)
    if len(x) <= 2 * HOT:
        return _forest(x, bits)
    comp = _near_grid(x, bits)
    own = comp != np.arange(len(x))
    return x[own], x[comp[own]]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and fingerprints of rows (key, fp) in order of keys, whole keys at a time."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            cut = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            yield keys[:cut], fps[:cut]
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield keys, fps


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64)) for x in (a, b)], names=["a", "b"])


def _lowest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(segment, position) of the lowest key that two fingerprints share, as 32 * segment + position; 64 where there is none."""
    out = np.full(len(a), 64, np.int64)
    for s in (1, 0):
        part = ((a ^ b) >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)
        shared = np.bitwise_count(part) <= 1
        out[shared] = 32 * s + np.bitwise_count(np.maximum(part[shared], np.uint64(1)) - np.uint64(1))
    return out


def _linker(bits: int):
    """Of (key, fp): edges under the lowest key that their ends share. They connect every near pair: those of a forest that
    are left out share a lower key, under which others connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _by_key(batches):
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            size = np.diff(starts, append=len(keys))
            place = keys[starts] >> 32
            bit = (fps >> np.repeat(place, size).astype(np.uint64)) & np.uint64(1)
            ones = np.add.reduceat(bit.astype(np.int64), starts)
            # beyond a segment's position 0, only members that differ there have no lower key in common
            apart = (size > 1) & ((place % 32 == 0) | ((ones > 0) & (ones < size)))
            two = starts[apart & (size == 2)]
            a, b = [fps[two]], [fps[two + 1]]
            for at, n in zip(starts[apart & (size > 2)].tolist(), size[apart & (size > 2)].tolist(), strict=True):
                one, other = _forest(fps[at : at + n], bits)
                a.append(one)
                b.append(other)
            held = np.concatenate([place[apart & (size == 2)], *[np.full(len(x), p) for x, p in zip(a[1:], place[apart & (size > 2)].tolist(), strict=True)]])
            one, other = np.concatenate(a), np.concatenate(b)
            told = (np.bitwise_count(one ^ other) <= bits) & (_lowest(one, other) == held)
            yield _edges([one[told]], [other[told]])

    return run


def _sub_linker(bits: int):
    """Of (sub-key, fp): edges that connect what is near under each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _by_key(batches):
            found = [_link(part, bits) for part in np.split(fps, np.flatnonzero(np.diff(keys)) + 1) if len(part) > 1]
            yield _edges([f[0] for f in found], [f[1] for f in found])

    return run


def _variants(column: str, base, width: int, segments: int, shift: int) -> "F.Column":
    """Array of base | segment | masked position | segment with that position cleared."""
    word = (1 << width) - 1
    out = []
    for s in range(segments):
        segment = F.shiftrightunsigned(F.col(column), shift + s * width).bitwiseAND(F.lit(word))
        out += [base.bitwiseOR(F.lit((s * width + p) << width)).bitwiseOR(segment.bitwiseAND(F.lit(word ^ (1 << p)))) for p in range(width)]
    return F.array(*out)


def _large_keys(fps: DataFrame) -> DataFrame:
    """(s, v, hot, spare) of segment values, as maps of positions: those where the key of the value has over HOT members, and
    those of a frequent value where no other meets it, so that position 0 stands for them."""
    halves = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")) for s in (0, 1)]))
    counts = materialize(fps.select(halves.alias("h")).groupBy("h.s", "h.v").agg(F.count("*").alias("n")), "segments")
    beside = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col("v").bitwiseXOR(F.lit(1 << p)).alias("w")) for p in range(32)]))
    often = counts.filter(F.col("n") >= HOT // 2).select("s", "v", "n", beside.alias("x")).select("s", "v", "n", "x.p", "x.w")
    met = often.join(counts.select(F.col("s").alias("t"), F.col("v").alias("u"), F.col("n").alias("m")), (F.col("s") == F.col("t")) & (F.col("w") == F.col("u")), "left")
    place = F.call_function("shiftleft", F.lit(1).cast("long"), "p")
    hot = (F.col("n") + F.coalesce("m", F.lit(0)) > HOT) & ((F.col("p") == 0) | F.col("m").isNotNull())
    own = met.select("s", "v", F.when(hot, place).otherwise(0).alias("hot"), F.when((F.col("p") > 0) & F.col("m").isNull(), place).otherwise(0).alias("spare"))
    others = met.filter(hot & F.col("m").isNotNull()).select("s", F.col("w").alias("v"), place.alias("hot"), F.lit(0).cast("long").alias("spare"))
    return materialize(own.union(others).groupBy("s", "v").agg(F.bit_or("hot").alias("hot"), F.bit_or("spare").alias("spare")), "large-keys")


def near_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """fps: distinct (fp long). Returns (a, b): links between fingerprints at most `bits` apart. Every such pair is
    connected through such links; two segments with one wildcard cover three bits, and so do the sub-keys of large keys."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard cover at most three differing bits")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = _variants("fp", F.lit(0).cast("long"), 32, 2, 0)
    link = lambda rows, how: rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(how, "a long, b long")
    # each row becomes 64: dealt out first, as a few small files would else be exploded by as few tasks
    spread, large = fps.repartition(n), _large_keys(fps)
    if large.isEmpty():
        return link(spread.select(F.explode(variants).alias("key"), "fp").select("key", "fp"), _linker(bits))
    for s in (0, 1):
        own = large.filter(F.col("s") == s).select(F.col("v").alias(f"v{s}"), F.col("hot").alias(f"hot{s}"), F.col("spare").alias(f"spare{s}"))
        spread = spread.join(own, F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)) == F.col(f"v{s}"), "left")
    spread = materialize(spread.select("fp", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hot0", "hot1", "spare0", "spare1")]), "spread")
    shift = lambda c, by: F.call_function("shiftright", c, by).bitwiseAND(F.lit(1).cast("long"))
    taken = [F.col(f"hot{s}").bitwiseOR(F.col(f"spare{s}")) for s in (0, 1)]
    kept = F.filter(variants, lambda _, i: shift(F.when(i < 32, taken[0]).otherwise(taken[1]), F.pmod(i, F.lit(32))) == 0)
    few = spread.select("fp", F.explode(kept).alias("key")).select("key", "fp")
    places = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda p: shift(F.col("__hot"), p) == 1)
    parts = []
    for s in (0, 1):  # the other half is 32 * (1 - s) bits up; (s, position) and the segment's other bits stand above the sub-key
        segment = F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF))
        rows = spread.filter(F.col(f"hot{s}") != 0).select("fp", F.col(f"hot{s}").alias("__hot")).select("fp", segment.alias("v"), F.explode(places).alias("p"))
        rest = F.col("v").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), "p")))
        above = F.shiftleft(F.shiftleft(F.col("p").cast("long") + 32 * s, 32).bitwiseOR(rest), 21)
        parts.append(rows.select("fp", above.alias("above")).select("fp", F.explode(_variants("fp", F.col("above"), 16, 2, 32 * (1 - s))).alias("key")).select("key", "fp"))
    return link(few, _linker(bits)).union(link(parts[0].union(parts[1]), _sub_linker(bits)))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """One row for each row of docs: (doc_id, fingerprint, component_id).

    Whole texts count; null and blank texts have fingerprint 0 and link like any other. Repeated rows and ids stay. A row
    with a null id gets the component of its fingerprint but is never a component's name (null if only such rows have
    it). Other columns, whatever their names, are not read. An empty table gives an empty result."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard cover at most three differing bits")
    each = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_udf(shingle)(utf8(text_col)).alias("fp")), "fingerprints")
    least = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(near_links(least.select("fp"), bits)).select(F.col("id").alias("fp"), "component")
    named = found.join(least, "fp").groupBy("component").agg(F.min("least").alias("name"))
    names = found.join(named, "component").select("fp", "name")
    classes = materialize(least.join(names, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "classes")
    return each.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _words(data: bytes) -> list[bytes]:
    return data.lower().split()


def text_key(data: bytes) -> bytes:
    """Equal for texts of equal words."""
    return xxhash.xxh128_digest(b" ".join(_words(data)))


def shingles(data: bytes, shingle: int) -> set[bytes]:
    """Distinct shingles of words; of fewer words, the whole sequence; none without words."""
    words = _words(data)
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """The same as sorted 64-bit hashes."""
    words = _words(data)
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each, width = np.array([digest(w) for w in words], np.uint64), min(shingle, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """So many of a set's first hashes that every set of that similarity has one of them among its own first: those of
    `common` come last, by rank, which keeps keys small and never changes what meets a similar set."""
    n = len(hashes)
    if not n:
        return hashes
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(common[at] == hashes, rank[at], 0)))]
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of hashes fall on each bit of a map of 2 to 4 bits a hash. Each hash that two sets don't
    have in common changes one bit, so their maps differ in no more bits than the sets in hashes."""
    width = 64 << max(0, (2 * len(hashes) - 1).bit_length() - 6)
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").view("<u8")


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A wider map as one of so many words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _apart(sizes, similarity: float):
    """Hashes that two sets of that similarity, of so many in all, have at most not in common."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-6


def _describe_udf(shingle: int, similarity: float, common: np.ndarray, rank: np.ndarray):
    kind = pa.struct([("key", pa.binary()), ("size", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("fp", pa.int64())])

    @F.arrow_udf("struct<key: binary, size: long, prefix: array<long>, bits: binary, fp: long>")
    def describe(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            data = t.as_buffer().to_pybytes() if t.is_valid else b""
            h = shingle_hashes(data, shingle)
            out.append({"key": text_key(data), "size": len(h), "prefix": prefix(h, similarity, common, rank).view(np.int64), "bits": parities(h).tobytes(), "fp": int(np.uint64(simhash(data)).view(np.int64))})
        return pa.array(out, kind)

    return describe.asNondeterministic()


def _key_udf():
    @F.arrow_udf("binary")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array([text_key(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.binary())

    return key.asNondeterministic()


def _similar_udf(shingle: int, similarity: float):
    @F.arrow_udf("boolean")
    def similar(one: pa.Array, other: pa.Array) -> pa.Array:
        out, last, a = [], None, set()
        for x, y in zip(one, other, strict=True):
            x, y = x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()
            if x != last:
                last, a = x, shingles(x, shingle)
            b = shingles(y, shingle)
            both = len(a & b)
            out.append(both >= similarity * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return similar.asNondeterministic()


def _possible_udf(similarity: float):
    """False only of sets that are surely less similar, by their sizes and maps."""

    @F.arrow_udf("boolean")
    def possible(one: pa.Array, other: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for x, y, n in zip(one, other, sizes.to_numpy().tolist(), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
            words = min(len(x), len(y))
            out.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= _apart(n, similarity))
        return pa.array(out, pa.bool_())

    return possible.asNondeterministic()


def _common(base: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many texts have, sorted, and their ranks by it: counted on a sample, as only the cost depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_buffer().to_pybytes(), shingle).view(np.int64))], names=["h"])

    sample = base.filter(F.pmod(F.xxhash64("name"), F.lit(COMMON_OF)) == 0).select("text").mapInArrow(run, "h long")
    rows = sample.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_LEAST).orderBy(F.col("n").desc(), "h").limit(COMMON_MOST).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, node, size), sorted by key: rows of keys with several members, how many, and the least member with its size."""
    names, held = ["key", "node", "size", "n", "rep", "rep_size"], [np.empty(0, np.int64)] * 3

    def emit(key, node, size):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        n = np.diff(np.append(starts, len(key)))
        order = np.lexsort((node, key))  # the first of a key's rows is its least member
        many = np.repeat(n > 1, n)
        rep, rep_size = np.repeat(node[order][starts], n), np.repeat(size[order][starts], n)
        return pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (key, node, size, np.repeat(n, n), rep, rep_size)], names=names)

    for b in batches:
        held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
        key = held[0]
        if len(key) and key[0] != key[-1]:
            cut = np.searchsorted(key, key[-1])  # the last key may go on in the next batch
            yield emit(*(h[:cut] for h in held))
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield emit(*held)


def _across(node: np.ndarray, comp: np.ndarray, size: np.ndarray, block: np.ndarray, bits: list[bytes], similarity: float, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one key's members that may be similar and aren't linked yet, of different blocks where there are two: all
    such pairs, or a forest of them."""
    order = np.argsort(size, kind="stable")
    node, comp, size, block = node[order], comp[order], size[order], block[order]
    two, words = block.min() != block.max(), np.array([len(bits[i]) // 8 for i in order])
    for w in np.unique(words):
        at, end = int(np.searchsorted(words, w)), int(np.searchsorted(words, 2 * w, "right"))
        maps = np.stack([_folded(np.frombuffer(bits[i], "<u8"), w) for i in order[at:end]])
        for i in range(at, int(np.searchsorted(words, w, "right"))):
            to = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right"))
            other = np.arange(i + 1, min(to, end))
            other = other[comp[other] != comp[i]]
            if two:
                other = other[block[other] != block[i]]
            if len(other):
                other = other[np.bitwise_count(maps[other - at] ^ maps[i - at]).sum(1, dtype=np.int64) <= _apart(size[other] + size[i], similarity)]
                if forest:
                    joined, first = np.unique(comp[other], return_index=True)
                    comp[np.isin(comp, joined)], other = comp[i], other[first]
                yield np.minimum(node[i], node[other]), np.maximum(node[i], node[other])


def _crosser(similarity: float, forest: bool):
    """Of (key, low, high, block, node, comp, size, bits), sorted by the first three: pairs (a, b) by _across of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = np.empty((7, 0), np.int64), []

        def emit(held, bits):
            cuts = [0, *(np.flatnonzero((np.diff(held[:3], axis=1) != 0).any(0)) + 1).tolist(), held.shape[1]]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                _, _, _, block, node, comp, size = held[:, lo:hi]
                if comp.min() != comp.max():
                    for a, b in _across(node, comp, size, block, bits[lo:hi], similarity, forest):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(7)])], axis=1)
            bits += batch.column(7).to_pylist()
            last = np.flatnonzero((held[:3] != held[:3, -1:]).any(0))  # the last group may go on in the next batch
            if len(last):
                yield from emit(held[:, : last[-1] + 1], bits[: last[-1] + 1])
                held, bits = held[:, last[-1] + 1 :], bits[last[-1] + 1 :]
        if len(bits):
            yield from emit(held, bits)

    return run


def near_candidates(prints: DataFrame, bits: int = 3) -> DataFrame:
    """prints: (node, fp). Pairs (a, b) of nodes: those of one fingerprint with the least of them, and the least ones of
    fingerprints that near_links links."""
    least = materialize(prints.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same = prints.join(least, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    one, other = (least.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in ("a", "b"))
    near = near_links(least.select("fp"), bits).join(one, "a").join(other, "b")
    return same.union(near.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(name, key, component, kept) of each distinct text of docs: the least id that has it, what text_key gives for it, the
    least name among the texts that it reaches by links, and whether it is the one text of those to keep. A link is a
    Jaccard similarity of the word shingles of `similarity` or more; every link of distinct texts is found, but for those
    that others imply, and verified on the whole texts: by near SimHash fingerprints, and what these leave by shared hashes.

    Null and blank texts have no shingles and are one text. Rows without an id are left out; rows that share an id are of
    different texts where their words differ. An empty table gives an empty result."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("name"), utf8(text_col).alias("text"))
    each = base.select("name", _describe_udf(shingle, similarity, *_common(base, shingle))("text").alias("d"))
    least = each.groupBy("d.key").agg(F.min(F.struct("name", "d.size", "d.prefix", "d.bits", "d.fp")).alias("d"))
    distinct = materialize(least.select(F.monotonically_increasing_id().alias("node"), "key", "d.*"), "distinct-texts")
    maps = distinct.select("node", "size", "bits")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that are similar."""
        pairs = materialize(pairs.distinct(), "candidates")
        needed = distinct.select("node", "name", "key").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        found = base.join(needed.select("name").distinct(), "name", "left_semi").withColumn("key", _key_udf()("text")).join(needed, ["name", "key"])
        texts = materialize(found.groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
        one, other = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
        return materialize(pairs.join(one, "a").join(other, "b").filter(_similar_udf(shingle, similarity)("text_a", "text_b")).select("a", "b"), "links")

    # texts of near fingerprints
    found = connected_components(linked(near_candidates(distinct.select("node", "fp")))).select(F.col("id").alias("node"), "component")

    # then of those that have a hash in common: each key's members are first compared with the least of them only, which links
    # most of a group of copies
    rows = distinct.select(F.explode("prefix").alias("key"), "node", "size").repartition(n, "key").sortWithinPartitions("key")
    met = materialize(rows.mapInArrow(_meet, "key long, node long, size long, n long, rep long, rep_size long"), "met")
    stars = met.filter((F.col("rep") != F.col("node")) & (F.least("size", "rep_size") >= similarity * F.greatest("size", "rep_size") - 1e-6)).select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    one, other = (maps.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    for c in ("a", "b"):
        stars = stars.join(found.select(F.col("node").alias(c), F.col("component").alias(f"own_{c}")), c, "left")
    stars = stars.filter(F.coalesce("own_a", "a") != F.coalesce("own_b", "b")).select("a", "b")
    stars = stars.join(one, "a").join(other, "b").filter(_possible_udf(similarity)("bits_a", "bits_b", F.col("size_a") + F.col("size_b"))).select("a", "b")
    links = linked(stars).union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = connected_components(links).select(F.col("id").alias("node"), "component")

    # then all those with each other that a key brings together and no link does yet: along a forest first, so that a group
    # of copies that its least member isn't like doesn't become all its pairs; large keys by pairs of blocks
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("long")
    for forest in (True, False):
        own = materialize(met.filter("n > 2").select("key", "node", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "own")
        unsettled = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
        dealt = own.join(unsettled, "key", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        dealt = dealt.join(maps, "node").select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "size", "bits")
        pairs = dealt.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_crosser(similarity, forest), "a long, b long")
        links = linked(pairs).union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = connected_components(links).select(F.col("id").alias("node"), "component")
        discard(own)
    found = found.withColumnRenamed("component", "group")
    named = distinct.select("node", "name", "key").join(found, "node", "left").withColumn("group", F.coalesce("group", "node"))
    first = named.groupBy("group").agg(F.min(F.struct("name", "key")).alias("first"))
    return named.join(first, "group").select("name", "key", F.col("first.name").alias("component"), F.struct("name", "key").eqNullSafe(F.col("first")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one text of each group of similar_components: of those of its least id, the one of the least key. Rows of
    one id count as one document where their words are equal, of which any one row stays; each other text of a shared id
    goes only if it is itself a near-duplicate of one that stays. Rows without an id can't be named and stay."""
    keepers = similar_components(docs, id_col, text_col, **how).filter("kept").select(F.col("name").alias("__keep"), F.col("key").alias("__key"))
    keyed = docs.filter(F.col(id_col).isNotNull()).withColumn("__own", _key_udf()(utf8(text_col)))
    kept = keyed.join(keepers, (F.col(id_col).cast("long") == F.col("__keep")) & (F.col("__own") == F.col("__key")), "left_semi").dropDuplicates([id_col, "__own"]).drop("__own")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
