"""Language-model scoring of documents: a causal self-attention model over subword ids (attention.py), and beside it the
smoothed unigram score that it is measured against.

Word counts, the classes of subword ids and the counts of ids after each class are taken from every training document. So is
the attention layer: it starts from a fit on SAMPLE_DOCS whole texts, and then every window of every training document moves it
once, in the task that reads the document; the tasks' moves are averaged.

Words whose share of the tokens is at least HEAD_SHARE go to every task; there can be no more than 1 / HEAD_SHARE of them.
The others meet their counts in a join by word, of one row for each word of a document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import attention as A
from granary.llm._shared import materialize, utf8
from granary.llm.subwords import default_path, encoder

HEAD_SHARE = 1e-6
SAMPLE_DOCS = 1500  # training documents the attention layer starts from, those with the least hash of their ids
ADDERS = 32  # tasks that add up packed rows
FLUSH_WORDS = 1_000_000  # counts of words that a task holds before it adds them up and hands them on
CHUNK_BYTES = 1 << 21  # of texts that are scored together
END = b" "  # stands for the end token; no word holds a space
ALPHA = 0.1


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, coded, and the text of each. Only A-Z are lower-cased, so bytes that aren't UTF-8 stay as they are."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    found, size = split.values.view(pa.binary()), np.diff(split.offsets.to_numpy())
    owner = np.repeat(np.arange(len(texts)), size)
    there = pc.greater(pc.binary_length(found), 0)  # white space at an end leaves an empty word
    return found.filter(there).dictionary_encode(), owner[there.to_numpy(zero_copy_only=False)]


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_BYTES."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _packed(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Rows of integers by their keys, as (word, blob); only what isn't zero is kept."""
    keys, blobs = [], []
    for key, row in rows.items():
        at = np.flatnonzero(row)
        if len(at):
            keys.append(struct.pack("<I", key))
            blobs.append(zstandard.compress(at.astype("<u4").tobytes() + row[at].astype("<i8").tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["word", "blob"])


def _add_packed(sums: dict[int, np.ndarray], width: int, word: bytes, blob: bytes) -> None:
    raw = zstandard.decompress(blob)
    n, key = len(raw) // 12, struct.unpack("<I", word)[0]
    if key not in sums:
        sums[key] = np.zeros(width, np.int64)
    sums[key][np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)


def _summed(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The sum of the packed rows of each key; keys are few, whatever the input, and a task holds those it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for word, blob in zip(b.column(0), b.column(1), strict=True):
                _add_packed(sums, width, word.as_py(), blob.as_py())
        yield _packed(sums)

    out: dict[int, np.ndarray] = {}
    for r in rows.select("word", "blob").repartition(ADDERS, "word").mapInArrow(run, "word binary, blob binary").toLocalIterator():
        _add_packed(out, width, bytes(r["word"]), bytes(r["blob"]))
    return out


def _encoded(blobs: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, how many each text has) of some texts after another, with their end ids."""
    for a, b in _parts(blobs):
        own = [np.append(np.frombuffer(i.as_buffer(), "<u2").astype(np.int64), end) for i in blobs.slice(a, b - a)]
        yield np.concatenate(own), np.array([len(o) for o in own])


def _counter(path: str, vocabulary: int):
    """Of training texts: words and subword ids. And each text with its ids, so that they are made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, end, tables = encoder(path), vocabulary - 1, []
        met = np.zeros(vocabulary, np.int64)

        def batch(what, keys, counts, blobs):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), what, np.int32)), keys, counts, blobs], names=["kind", "word", "n", "blob"])

        def summed():
            all_ = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            tables.clear()
            for b in all_.to_batches(max_chunksize=100_000):
                yield batch(0, b.column("word"), b.column("n_sum"), pa.nulls(b.num_rows, pa.binary()))

        for b in batches:
            at = 0
            for ids, ends in to.encode(b.column(1)):
                n = len(ends)
                some, at = b.slice(at, n), at + n
                texts, train = some.column(1), ~some.column(2).to_numpy(zero_copy_only=False)
                cuts = pa.array(np.concatenate([[0], 2 * ends]), pa.int64()).buffers()[1]
                yield batch(2, texts, some.column(0), pa.Array.from_buffers(pa.large_binary(), n, [None, cuts, pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary()))
                if not train.any():
                    continue
                coded, _ = _words(texts.filter(pa.array(train)))
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                tables.append(pa.table({"word": pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), "n": np.append(counts, train.sum())}))
                met += np.bincount(ids[np.repeat(train, np.diff(ends, prepend=0))], minlength=vocabulary)
                met[end] += train.sum()
                if sum(t.num_rows for t in tables) >= FLUSH_WORDS:
                    yield from summed()
        if tables:
            yield from summed()
        own = _packed({0: met})
        yield batch(1, own.column(0), pa.nulls(own.num_rows, pa.int64()), own.column(1))

    return run


def _neighbours(vocabulary: int, near: np.ndarray):
    """Of training texts: how often each id stands after and before the most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside, met = np.zeros((2 * A.NEAR + 2, vocabulary), np.int32), 0
        for b in batches:
            for ids, sizes in _encoded(b.column(0), vocabulary - 1):
                A.add_beside(beside, near, ids, sizes)
                met += len(ids)
                if met >= 1 << 30:  # before a count can pass 32 bits
                    yield _packed(dict(enumerate(beside)))
                    beside[:], met = 0, 0
        yield _packed(dict(enumerate(beside)))

    return run


def _mover(vocabulary: int, first):
    """Of training texts: the counts of ids after each class, and what all their windows move in the net (after CLASSES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, end = first.value, vocabulary - 1
        mover, pairs = A.Mover(net), np.zeros(A.CLASSES * vocabulary, np.int32)
        met = 0
        for b in batches:
            for ids, sizes in _encoded(b.column(0), end):
                before = np.append(end, ids[:-1])  # every text ends with that id
                np.add.at(pairs, net.kind.take(before) * vocabulary + ids, np.int32(1))
                met += len(ids)
                if met >= 1 << 30:
                    yield _packed(dict(enumerate(pairs.reshape(A.CLASSES, vocabulary))))
                    pairs[:], met = 0, 0
                mover.add(ids, sizes)
        yield _packed(dict(enumerate(pairs.reshape(A.CLASSES, vocabulary))))
        if mover.seen:
            yield _packed({A.CLASSES + i: row for i, row in enumerate(mover.sums())})

    return run


def _scorer(vocabulary: int, shared):
    """One row for each text with what its frequent words and the model say, and one for each other word of it."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ["row", "word", "k", "doc_id", "n_tokens", "known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, inside, head, unit = shared.value
        score, end = A.Scorer(net, inside), vocabulary - 1
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for at, to in _parts(b.column(1)):
                some, n = b.slice(at, to - at), to - at
                ids = [np.append(np.frombuffer(i.as_buffer(), "<u2").astype(np.int64), end) for i in some.column(2)]
                points = score.log10(ids)
                coded, owner = _words(some.column(1))
                word = coded.indices.to_numpy()
                lp = np.fromiter(map(head.get, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), repeat(np.nan)), np.float64, len(coded.dictionary))[word]
                known = ~np.isnan(lp)
                tokens = np.bincount(owner, minlength=n) + 1
                last = head.get(END)
                base = np.bincount(owner[known], weights=lp[known], minlength=n) + (last or 0.0)
                found = np.bincount(owner[known], minlength=n) + (last is not None)
                key, many = np.unique(owner[~known] * max(1, len(coded.dictionary)) + word[~known], return_counts=True)
                whose, which = np.divmod(key, max(1, len(coded.dictionary)))
                if last is None:  # a corpus without training texts
                    whose, which, many = np.append(whose, np.arange(n)), np.append(which, np.full(n, len(coded.dictionary))), np.append(many, np.ones(n, np.int64))
                spelled = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]).take(pa.array(which.astype(np.int64)))
                m = len(whose)
                yield pa.RecordBatch.from_arrays([pa.array(row + whose), spelled, pa.array(many), *(pa.nulls(m, k) for k in kinds[3:])], names=names)
                rows = np.arange(row, row + n)
                marks = pa.array([struct.pack("<q", r) + END + END for r in rows.tolist()], pa.binary())  # no word: meets no count
                yield pa.RecordBatch.from_arrays([pa.array(rows), marks, pa.array(np.zeros(n, np.int64)), some.column(0), pa.array(tokens), pa.array(found), pa.array(base), pa.array(points)], names=names)
                row += n

    return run


def _sample(docs: DataFrame, path: str, vocabulary: int) -> list[np.ndarray]:
    ids = [r["id"] for r in docs.filter("not held_out and id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).collect()]
    to, out = encoder(path), []
    # rows that share an id count as one, so that the sample is bounded whatever repeats
    rows = docs.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("text").alias("text")).toLocalIterator()
    for r in rows:
        out.append((r["id"], np.append(next(to.texts(pa.array([bytes(r["text"])], pa.binary()))), vocabulary - 1).astype(np.uint16)))
    return [x for _, x in sorted(out, key=lambda o: o[0])]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Whole texts are scored; a null or blank text is its end token alone. Documents whose crc32(id as text) mod 10 is 0 are
    held out; rows with a null id are training rows like others. Repeated rows get equal scores. Without training rows
    every count is 0. An empty table gives an empty result. No other column is read."""
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, tokenizer or default_path()
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    if vocabulary > 1 << 16:
        raise ValueError("ids are kept in 16 bits")
    base = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"), held_out(id_col).alias("held_out"))
    counted = materialize(base.select("id", "text", "held_out").mapInArrow(_counter(path, vocabulary), "kind int, word binary, n long, blob binary"), "counted")
    packed, training = "word binary, blob binary", counted.filter((F.col("kind") == 2) & ~held_out("n")).select("blob")
    met = _summed(counted.filter("kind = 1"), vocabulary).get(0, np.zeros(vocabulary, np.int64))
    found = _summed(training.mapInArrow(_neighbours(vocabulary, A.ranks(met)), packed), vocabulary)
    beside = np.zeros((2 * A.NEAR + 2, vocabulary), np.int32 if met.sum() < 1 << 31 else np.int64)
    for key in list(found):
        beside[key] = found.pop(key)
    kind = A.classes_from(met, beside)
    del beside
    net = A.train(vocabulary, kind, _sample(base, path, vocabulary))
    first = spark.sparkContext.broadcast(net)
    width = max(vocabulary, sum(net.p[n].size for n in A.OTHERS)) + 1
    found = _summed(training.mapInArrow(_mover(vocabulary, first), packed), width)
    if found:
        net = A.moved(net, [found.pop(A.CLASSES + i, np.zeros(width, np.int64)) for i in range(A.SUMS)])
    pairs = np.zeros((A.CLASSES, vocabulary))
    for key in list(found):
        pairs[key] = found.pop(key)[:vocabulary]
    inside = A.within(pairs, kind)
    del pairs

    words = materialize(counted.filter("kind = 0").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    unit = np.log10(total + ALPHA * (distinct + 1))
    least = max(1.0, HEAD_SHARE * total)
    head = {bytes(r["word"]): float(np.log10(r["c"] + ALPHA) - unit) for r in words.filter(F.col("c") >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast((net, inside, head, float(unit)))
    del inside, head

    each = counted.filter("kind = 2").select("n", "word", "blob").mapInArrow(_scorer(vocabulary, shared), "row long, word binary, k long, doc_id long, n_tokens long, known long, base double, score double")
    rare = words.filter(F.col("c") < least).select(F.col("word").alias("rare"), "c")
    c = F.coalesce("c", F.lit(0))
    part = each.join(rare, F.col("word") == F.col("rare"), "left").select("row", "doc_id", "n_tokens", "score", F.coalesce("known", F.when(c > 0, F.col("k")).otherwise(0)).alias("known"), F.coalesce("base", F.col("k") * (F.log10(c + ALPHA) - float(unit))).alias("base"))
    found = part.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.max("score").alias("score"))
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
