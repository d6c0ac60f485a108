"""Toxicity by subword bags: the mean of character n-gram embeddings of a window of words goes into a linear softmax.

Embeddings and softmax are trained jointly, in numpy, on a bounded, documented sample of labelled rows. A text's score is
that of its most toxic window, calibrated on labelled documents kept out of the fit, so that a few words in a long text
count as much as in a short one. After training, a word's part in the softmax is one number, kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._shared import utf8

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
WINDOW = 5  # words
FLOOR = 50  # n-grams that a window's mean is taken over at least
THRESHOLD = 0.3
MIN_SHARE, MIN_DOCS = 0.004, (2, 8)  # of the fitted documents that an n-gram must occur in, and the bounds of that number
DECAY = 0.6  # of the embeddings, in the manner of AdamW
SAMPLE = {1: 900, 0: 1400}  # labelled documents that are fitted, by label: the bound of the sample
CACHE_WORDS = 150_000
_STRIP = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]))


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


def grams(words: Iterable[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, n-grams before each word and in all) of words, each between boundary marks."""
    marked = [f"<{w.decode('utf-8', 'replace').strip(_STRIP)}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(marked)), size)
    out_hash, out_owner = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        out_hash.append((h[inside] % np.uint64(buckets)).astype(np.int32))
        out_owner.append(owner[: len(h)][inside])
    if not out_hash:
        return np.empty(0, np.int32), np.zeros(len(marked) + 1, np.int64)
    h, o = np.concatenate(out_hash), np.concatenate(out_owner)
    order = np.argsort(o, kind="stable")
    return h[order], np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(marked)))])


class Vocabulary:
    """Indices of words, and their n-grams."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> np.ndarray:
        at = self.index
        return np.array([at.setdefault(w, len(at)) for w in words], np.int64)


@dataclass
class Model:
    """weight: what each n-gram bucket adds to the log-odds of a window that it fills alone; scale and shift calibrate."""

    weight: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    index: dict = field(default_factory=dict)
    part: np.ndarray = field(default_factory=lambda: np.zeros(CACHE_WORDS, np.float32))
    count: np.ndarray = field(default_factory=lambda: np.zeros(CACHE_WORDS, np.float32))

    def __getstate__(self):
        return {"weight": self.weight.astype(np.float32), "bias": self.bias, "scale": self.scale, "shift": self.shift}

    def __setstate__(self, state):
        self.__init__(**state)

    def _learn(self, new: list[bytes]) -> None:
        h, ends = grams(new, len(self.weight))
        total = np.concatenate([[0.0], np.cumsum(self.weight[h], dtype=np.float64)])[ends]
        at = len(self.index)
        self.part[at : at + len(new)] = np.diff(total)
        self.count[at : at + len(new)] = np.diff(ends)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def logit(self, words: list[bytes]) -> float:
        """Of the most toxic window; of an empty one where there are no words."""
        best = self.bias if not words else -np.inf
        for start in range(0, len(words), WINDOW * 8192):  # whole windows, a bounded number at a time
            part = words[start : start + WINDOW * 8192]
            new = [w for w in set(part) if w not in self.index]
            if len(self.index) + len(new) > CACHE_WORDS:
                self.index, new = {}, list(set(part))
            if new:
                self._learn(new)
            at = np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))
            cuts = np.arange(0, len(part), WINDOW)
            best = max(best, float((np.add.reduceat(self.part[at], cuts) / np.maximum(np.add.reduceat(self.count[at], cuts), FLOOR)).max()) + self.bias)
        return best

    def score(self, data: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(tokens(data)) + self.shift, -40, 40))))


def _fit(flat: np.ndarray, cuts: np.ndarray, labels: np.ndarray, docs: np.ndarray, vocabulary: Vocabulary, seed: int = 7) -> tuple[np.ndarray, float]:
    """flat: indices of the words of windows that start at cuts (which ends with their end); labels and docs: of each window.

    Joint training of embeddings and softmax by Adam on all windows; then again with only the most toxic windows of the
    toxic documents, as a label says that there is such a window, not that each is one."""
    rng = np.random.default_rng(seed)
    h, ends = grams(vocabulary.index)
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if not len(h):  # texts of marks alone
        return np.zeros(BUCKETS, np.float32), 0.0
    least = min(max(MIN_SHARE * (docs.max() + 1), MIN_DOCS[0]), MIN_DOCS[1])  # n-grams of fewer documents say nothing yet
    where = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(cuts))
    pairs = np.unique(flat * (docs.max() + 1) + docs[where])
    word_docs = np.bincount(pairs // (docs.max() + 1), minlength=len(sizes))
    known = np.bincount(h, weights=word_docs[owner], minlength=BUCKETS) >= least
    embedding = (rng.standard_normal((BUCKETS, DIM)) * 0.05 * known[:, None]).astype(np.float32)
    softmax = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    del pairs, word_docs
    count = np.maximum(np.add.reduceat(sizes[flat], cuts[:-1]), FLOOR).astype(np.float32)[:, None]
    words = np.empty((len(sizes), DIM), np.float32)

    def forward():
        for a in range(0, len(sizes), 8192):  # some words' n-grams at a time
            b = min(a + 8192, len(sizes))
            own = np.concatenate([embedding[h[ends[a] : ends[b]]], np.zeros((1, DIM), np.float32)])
            words[a:b] = np.add.reduceat(own, ends[a:b] - ends[a], axis=0) * (sizes[a:b] > 0)[:, None]
        mean = np.add.reduceat(words[flat], cuts[:-1], axis=0) / count
        logits = mean @ softmax + bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return mean, e / e.sum(1, keepdims=True)

    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embedding, softmax, bias)]
    step = 0

    def train(weight: np.ndarray, epochs: int, rate: float) -> None:
        nonlocal step
        target = np.eye(2, dtype=np.float32)[labels]
        for _ in range(epochs):
            step += 1
            mean, p = forward()
            d = (p - target) * (weight / weight.sum())[:, None]
            back = d @ softmax.T / count
            per_word = np.stack([np.bincount(flat, weights=back[where, k], minlength=len(sizes)) for k in range(DIM)], 1)
            grad = np.stack([np.bincount(h, weights=per_word[owner, k], minlength=BUCKETS) for k in range(DIM)], 1).astype(np.float32)
            grads = (grad * known[:, None], mean.T @ d + 1e-4 * softmax, d.sum(0))
            for value, g, (m, v) in zip((embedding, softmax, bias), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                if value is embedding:
                    value *= 1 - rate * DECAY
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def balanced(use: np.ndarray) -> np.ndarray:
        w = use.astype(np.float32)
        for c in (0, 1):
            w[labels == c] /= max(1.0, w[labels == c].sum())
        return w

    train(balanced(np.ones(len(docs))), 20, 0.05)
    for epochs in (10, 10, 20):
        odds = forward()[1][:, 1]
        top = np.zeros(docs.max() + 1)
        np.maximum.at(top, docs, odds)
        hard = np.where(odds > 0.2, 4.0, 1.0)  # what looks toxic in a clean document counts more
        train(balanced(np.where(labels == 0, hard, (odds >= top[docs] - 1e-9) | (odds > 0.9))), epochs, 0.03)
    return embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0])


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton steps with a little ridge."""
    center, spread = x.mean(), x.std() + 1e-6
    z = np.stack([(x - center) / spread, np.ones_like(x)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        g = z.T @ (weight * (p - y)) + np.array([1e-3, 0]) * beta
        beta = beta - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), g)
        beta[0] = np.clip(beta[0], 1e-3, 50)
    return float(beta[0] / spread), float(beta[1] - beta[0] * center / spread)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> Model:
    """Fit on at most sample[label] labelled documents of each label, those with the least hash of their ids, held-out
    ones excepted. With labels of one kind only, every text scores as that kind's share."""
    sample = sample or SAMPLE
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(share.values())
    if len(share) < 2:
        rate = min(max(share.get(1, 0) / max(1, n), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    chosen = {r.doc_id: r.y for y in (0, 1) for r in own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y]).collect()}
    # rows that share an id count as one, so that the sample is bounded whatever repeats
    rows = docs.filter(F.col(id_col).isin(list(chosen))).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
    vocabulary, held, sizes, labels_, owners, checked = Vocabulary(), [], [], [], [], []
    for r in sorted(((r.doc_id, bytes(r.text)) for r in rows.toLocalIterator()), key=lambda r: r):
        words, y = tokens(r[1]), chosen[r[0]]
        rng = np.random.default_rng(r[0] & 0x7FFFFFFF)
        if rng.random() < 0.25:
            checked.append((r[1], y))
            continue
        n = -(-len(words) // WINDOW)
        held.append(vocabulary.add(words))
        sizes += [WINDOW] * (n - 1) + [len(words) - WINDOW * (n - 1)] * bool(n)
        labels_ += [y] * n
        owners += [r[0]] * n
    if len(set(labels_)) < 2 or len({y for _, y in checked}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(share[1] / share[0])))
    model = Model(*_fit(np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)]), np.array(labels_), np.unique(owners, return_inverse=True)[1], vocabulary))
    x, y = np.array([model.logit(tokens(t)) for t, _ in checked]), np.array([float(y) for _, y in checked])
    weight = np.where(y == 1, share[1] / n / y.mean(), share[0] / n / (1 - y.mean()))
    model.scale, model.shift = _calibrate(x, y, weight)
    return model


def score_udf(model: Model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], pa.float64())

    return score.asNondeterministic()


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the score of each whole text in one more column (replacing one of that name). Null and blank texts score
    as a window without n-grams. Repeated rows get equal scores; an empty table gives an empty result."""
    return docs.drop(into).withColumn(into, score_udf(model)(utf8(text_col)))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score threshold or more."""
    return scored(docs, model, text_col, "__score").filter(F.col("__score") < threshold).drop("__score")
