"""A causal self-attention language model in numpy, over subword ids, with an output in two levels.

The next id's class comes from one attention layer over the window. Frequent ids are classes of their own; the others are
grouped by what stands before and after them in the whole corpus, so that a class tells much of an id. The id within its class
comes from counts over the whole corpus, given the class before. Training is plain backpropagation with Adam: train makes a
first net from some texts, and every window of the corpus then moves it once, in parts that start from that net and whose
moves are averaged. Scoring cuts each text in windows of CONTEXT + STRIDE inputs that overlap by CONTEXT, so each id is scored
once, with at least CONTEXT ids before it (fewer at the start).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIM, CONTEXT, STRIDE = 16, 24, 24
LENGTH = CONTEXT + STRIDE
HEAD, TAIL = 96, 64  # ids that are classes of their own, and classes that the others share
NEAR = 128  # ids whose place before and after an id says what it is like
ROUNDS, FACTORS = 12, 24  # of the grouping
CLASSES = HEAD + TAIL
BATCH = 512  # windows made together, by eights
AT_ONCE = 64  # windows scored together; what they need stays in a core's cache
RATE = 0.003  # of the corpus' windows
LAMBDA = 20.0  # weight of the counts without context
_FAR = np.float32(-1e9)
# a query at CONTEXT + i sees inputs up to its own
SEEN = np.arange(LENGTH)[None, :] <= np.arange(CONTEXT, LENGTH)[:, None]
MASK = np.where(SEEN, np.float32(0), _FAR)


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each of the NEAR most frequent ids, NEAR for the others."""
    near = np.full(len(counts), NEAR)
    near[np.argsort(-counts, kind="stable")[:NEAR]] = np.arange(min(NEAR, len(counts)))
    return near


def add_beside(table: np.ndarray, near: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
    """Adds to table (2 * NEAR + 2, vocabulary), of texts one after another: how often an id stands after each rank, then how
    often before each. Before a text stands the last id of the vocabulary."""
    before = np.append(table.shape[1] - 1, ids[:-1])
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = table.shape[1] - 1
    flat, one = table.reshape(-1), table.dtype.type(1)
    np.add.at(flat, near[before] * table.shape[1] + ids, one)
    np.add.at(flat, (near[ids] + NEAR + 1) * table.shape[1] + before, one)


def classes_of(texts: list[np.ndarray], vocabulary: int, seed: int = 1) -> np.ndarray:
    """classes_from of the counts of some texts."""
    flat = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    counts, beside = np.bincount(flat, minlength=vocabulary), np.zeros((2 * NEAR + 2, vocabulary), np.int64)
    if len(flat):
        add_beside(beside, ranks(counts), flat, np.array([len(t) for t in texts]))
    return classes_from(counts, beside, seed)


def classes_from(counts: np.ndarray, beside: np.ndarray, seed: int = 1) -> np.ndarray:
    """The class of each id, by its count and its row of add_beside: the HEAD most frequent ids, then TAIL groups of ids with
    like neighbours (k-means on the main factors of their square-rooted, smoothed neighbour shares). Ids without a count go
    where a mean id goes."""
    vocabulary = len(counts)
    order = np.argsort(-counts, kind="stable")
    out = np.full(vocabulary, HEAD, np.int64)
    out[order[:HEAD]] = np.arange(min(HEAD, vocabulary))
    seen = np.flatnonzero(counts)
    if len(seen) <= HEAD + TAIL:
        out[order[HEAD:]] = HEAD + np.arange(vocabulary - min(HEAD, vocabulary)) % TAIL
        return out
    share = beside[:, seen].T.astype(np.float32)
    mean = share.sum(0, dtype=np.float64) / share.sum(dtype=np.float64)
    mean = mean.astype(np.float32)
    size = share.sum(1, keepdims=True) + np.float32(5)
    share += 5 * mean
    share /= size
    np.sqrt(share, out=share)
    share -= np.sqrt(mean)
    weight = np.sqrt(counts[seen]).astype(np.float32)
    heavy = share * weight[:, None]
    axes = np.linalg.svd(heavy.T @ heavy)[0][:, :FACTORS]
    rest = np.isin(seen, order[HEAD:])
    x, weight = (share @ axes)[rest], weight[rest].astype(np.float64)
    del share, heavy
    centers = x[np.random.default_rng(seed).choice(len(x), TAIL, replace=False, p=weight / weight.sum())]
    nearest = lambda v: ((centers**2).sum(1) - 2 * v @ centers.T).argmin(-1)
    for _ in range(ROUNDS):
        group = nearest(x)
        mass = np.bincount(group, weights=weight, minlength=TAIL)
        moved = np.stack([np.bincount(group, weights=weight * x[:, k], minlength=TAIL) for k in range(x.shape[1])], 1)
        centers[mass > 0] = moved[mass > 0] / mass[mass > 0][:, None]
    out[order[HEAD:]] = HEAD + nearest(np.zeros(x.shape[1]))
    out[seen[rest]] = HEAD + nearest(x)
    return out


def windows(ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, which targets are there) of a text's ids: each id is the target of one window."""
    n = len(ids)
    w = -(-n // STRIDE)
    padded = np.full(CONTEXT + 1 + w * STRIDE, begin, np.int64)
    padded[CONTEXT + 1 : CONTEXT + 1 + n] = ids
    at = np.arange(w)[:, None] * STRIDE
    there = at + np.arange(STRIDE)[None, :] < n
    return padded[at + np.arange(LENGTH)[None, :]], padded[at + CONTEXT + 1 + np.arange(STRIDE)[None, :]], there


def windows_of(ids: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts one after another."""
    each = -(-sizes // STRIDE)
    room = np.where(each > 0, CONTEXT + 1 + each * STRIDE, 0)
    starts = np.cumsum(room) - room
    padded = np.full(int(room.sum()), begin, np.int64)
    within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(starts, sizes) + CONTEXT + 1 + within] = ids
    step = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    at = (np.repeat(starts, each) + step)[:, None]
    there = step[:, None] + np.arange(STRIDE) < np.repeat(sizes, each)[:, None]
    return padded[at + np.arange(LENGTH)], padded[at + CONTEXT + 1 + np.arange(STRIDE)], there


@dataclass
class Net:
    """begin: the id of the padding before a text, which no text holds."""

    begin: int
    kind: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, vocabulary: int, kind: np.ndarray, seed: int = 5) -> "Net":
        rng = np.random.default_rng(seed)
        shape = {"embed": (vocabulary + 1, DIM), "place": (LENGTH, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM), "skip": (DIM, DIM), "out": (DIM, CLASSES), "prev": (CLASSES, CLASSES), "bias": (CLASSES,)}
        scale = {"embed": 0.3, "place": 0.1, "prev": 0.0, "bias": 0.0}
        return cls(vocabulary, np.append(kind, 0), {n: (rng.standard_normal(s) * scale.get(n, DIM**-0.5)).astype(np.float32) for n, s in shape.items()})

    def tables(self) -> dict[str, np.ndarray]:
        """Each id's query, key, value and skip vector, so that scoring only looks them up."""
        p = self.p
        scale = np.float32(DIM**-0.5)
        return {"q": p["embed"] @ p["q"] * scale, "k": p["embed"] @ p["k"], "v": p["embed"] @ p["v"] @ p["o"], "s": p["embed"] @ p["skip"], "pq": p["place"] @ p["q"] * scale, "pk": p["place"] @ p["k"], "pv": p["place"] @ p["v"] @ p["o"], "prev": p["prev"] + p["bias"], "eprev": np.exp(p["prev"] + p["bias"])}

    def class_logp(self, x: np.ndarray, t: dict[str, np.ndarray], target: np.ndarray) -> np.ndarray:
        """Natural log-probability of the class of each target."""
        own = x[:, CONTEXT:]
        q, k, v = t["q"].take(own, 0) + t["pq"][CONTEXT:], t["k"].take(x, 0) + t["pk"], t["v"].take(x, 0) + t["pv"]
        score = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(np.minimum(score, 30, out=score), out=score)
        score *= SEEN
        h = np.matmul(score, v)
        h /= score.sum(2, keepdims=True)
        h += t["s"].take(own, 0)
        np.tanh(h, out=h)
        logits = h.reshape(-1, DIM) @ self.p["out"]
        before, kind = self.kind.take(own).ravel(), self.kind.take(target).ravel()
        chosen = logits[np.arange(len(logits)), kind] + t["prev"][before, kind]
        # the sum of exp(a + b) as that of exp(a) * exp(b): what the class before says is known beforehand
        total = np.einsum("ij,ij->i", np.exp(logits, out=logits), t["eprev"].take(before, 0))
        return (chosen - np.log(total)).reshape(target.shape)

    def loss_and_grads(self, x: np.ndarray, target: np.ndarray, there: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the targets that are there, and its gradients; of "embed" as (ids, their rows)."""
        p, n, scale = self.p, max(1, int(there.sum())), np.float32(DIM**-0.5)
        plain = p["embed"].take(x, 0)
        e = plain + p["place"]
        plain, own = (np.ascontiguousarray(a[:, CONTEXT:]) for a in (plain, e))
        q, k, v = own @ (p["q"] * scale), e @ p["k"], e @ p["v"]
        a = np.matmul(q, k.transpose(0, 2, 1))
        np.exp(np.minimum(a, 30, out=a), out=a)
        a *= SEEN
        a /= a.sum(2, keepdims=True)
        mix = np.matmul(a, v)
        flat_mix, flat_plain = mix.reshape(-1, DIM), plain.reshape(-1, DIM)
        h = np.tanh(flat_mix @ p["o"] + flat_plain @ p["skip"])
        # targets in order of the class before, so that the gradients of "prev" are sums of runs
        before = self.kind.take(x[:, CONTEXT:]).ravel()
        order = np.argsort(before.astype(np.uint8), kind="stable")
        before, gold, weight, h = before[order], self.kind.take(target).ravel()[order], there.ravel()[order] / np.float32(n), h[order]
        d = h @ p["out"]
        d += (p["prev"] + p["bias"]).take(before, 0)
        np.exp(np.minimum(d, 80, out=d), out=d)
        total, at = d.sum(1), np.arange(len(d))
        loss = float(-(np.log(d[at, gold] / total + 1e-9) * weight).sum())
        d *= (weight / total)[:, None]
        d[at, gold] -= weight
        runs = np.flatnonzero(np.diff(before, prepend=-1))
        g = {"out": h.T @ d, "prev": np.zeros_like(p["prev"])}
        g["prev"][before[runs]] = np.add.reduceat(d, runs, axis=0)
        g["bias"] = g["prev"].sum(0)
        dh = np.empty_like(h)
        dh[order] = (d @ p["out"].T) * (1 - h * h)
        g["o"], g["skip"] = flat_mix.T @ dh, flat_plain.T @ dh
        dmix = (dh @ p["o"].T).reshape(mix.shape)
        da = np.matmul(dmix, v.transpose(0, 2, 1))
        dv = np.matmul(a.transpose(0, 2, 1), dmix)
        da -= (dmix * mix).sum(2, keepdims=True)
        da *= a
        dq, dk = np.matmul(da, k) * scale, np.matmul(da.transpose(0, 2, 1), q)
        g["q"], g["k"], g["v"] = (y.reshape(-1, DIM).T @ z.reshape(-1, DIM) for y, z in ((own, dq), (e, dk), (e, dv)))
        de = dk @ p["k"].T + dv @ p["v"].T
        de[:, CONTEXT:] += dq @ p["q"].T
        g["place"] = de.sum(0)
        de[:, CONTEXT:] += (dh @ p["skip"].T).reshape(mix.shape)
        order = np.argsort(x.ravel().astype(np.uint16 if self.begin < 1 << 16 else np.int64), kind="stable")
        ids = x.ravel()[order]
        runs = np.flatnonzero(np.diff(ids, prepend=-1))
        g["embed"] = ids[runs], np.add.reduceat(de.reshape(-1, DIM)[order], runs, axis=0)
        return loss, g


class Adam:
    """Moves a net along its gradients; rows of "embed" only where the windows have their ids."""

    def __init__(self, net: Net) -> None:
        self.net, self.step, self.state = net, 0, {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}

    def move(self, x: np.ndarray, target: np.ndarray, there: np.ndarray, rate: float) -> None:
        self.step += 1
        one, two = np.float32(rate / (1 - 0.9**self.step)), np.float32(1 - 0.99**self.step)
        for n, g in self.net.loss_and_grads(x, target, there)[1].items():
            rows, g = g if n == "embed" else (slice(None), g)
            m, v = (s[rows] for s in self.state[n])
            m = m + np.float32(0.1) * (g - m)
            v = v + np.float32(0.01) * (g * g - v)
            self.state[n][0][rows], self.state[n][1][rows] = m, v
            self.net.p[n][rows] -= one * m / (np.sqrt(v / two) + np.float32(1e-8))


def train(vocabulary: int, kind: np.ndarray, texts: list[np.ndarray], steps: int = 800, batch: int = 192, rate: float = 0.01, seed: int = 5) -> Net:
    net = Net.new(vocabulary, kind, seed)
    if not texts:
        return net
    small = np.uint16 if vocabulary < 1 << 16 else np.int64
    parts = [tuple(p.astype(small) if i < 2 else p for i, p in enumerate(windows(t, net.begin))) for t in texts]
    x, y, there = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    rng, adam = np.random.default_rng(seed), Adam(net)
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(batch, len(x)))
        adam.move(x[at].astype(np.int64), y[at].astype(np.int64), there[at], rate * min(1.0, step / 20) * (1 - 0.9 * step / steps))
    return net


OTHERS = ("place", "q", "k", "v", "o", "skip", "out", "prev", "bias")  # what every window moves
FIXED = 1 << 20  # moves are added as integers of this part, so that their order doesn't matter


class Mover:
    """A net that all windows of one part of the corpus have moved, each once."""

    def __init__(self, first: Net, seed: int = 5) -> None:
        self.first, self.net = first, Net(first.begin, first.kind, {n: v.copy() for n, v in first.p.items()})
        self.adam, self.rng = Adam(self.net), np.random.default_rng(seed)
        self.met, self.seen = np.zeros(first.begin + 1, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        x, y, there = windows_of(ids, sizes, self.net.begin)
        self.met += np.bincount(x.ravel(), minlength=len(self.met))
        self.seen += len(x)
        order = self.rng.permutation(len(x))
        for at in range(0, len(x), AT_ONCE):
            part = order[at : at + AT_ONCE]
            self.adam.move(x[part], y[part], there[part], RATE)

    def sums(self) -> list[np.ndarray]:
        """Rows of integers that add up over parts: the moves of each column of "embed", by how often its id was met, how often
        that was, and the moves of all others, by windows, with their number."""
        moved = {n: self.net.p[n].astype(np.float64) - self.first.p[n] for n in self.net.p}
        embed = np.rint(moved["embed"] * (self.met * float(FIXED))[:, None]).astype(np.int64)
        others = np.concatenate([moved[n].ravel() for n in OTHERS]) * (self.seen * float(FIXED))
        return [*embed.T, self.met, np.append(np.rint(others).astype(np.int64), self.seen)]


SUMS = DIM + 2


def moved(first: Net, sums: list[np.ndarray]) -> Net:
    """first with the mean moves of all parts, by the added rows of Mover.sums; longer rows end with zeros."""
    p = {n: v.copy() for n, v in first.p.items()}
    rows, size, at = len(p["embed"]), sum(p[n].size for n in OTHERS), 0
    met, others, seen = np.maximum(sums[DIM][:rows], 1), sums[DIM + 1], max(1, int(sums[DIM + 1][size]))
    for d in range(DIM):
        p["embed"][:, d] += (sums[d][:rows] / (met * float(FIXED))).astype(np.float32)
    for n in OTHERS:
        p[n] += (others[at : at + p[n].size].reshape(p[n].shape) / (seen * float(FIXED))).astype(np.float32)
        at += p[n].size
    return Net(first.begin, first.kind, p)


def within(pairs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Natural log-probability of an id within its class after a class, from counts (class before, id) over the corpus:
    those after that class, smoothed by those after any, smoothed by one for each id."""
    any_ = pairs.sum(0) + 1.0
    base = any_ / np.bincount(kind, weights=any_, minlength=CLASSES)[kind]
    out = np.zeros((len(pairs), pairs.shape[1] + 1), np.float32)  # the last column is the padding's
    for c, row in enumerate(pairs):
        out[c, :-1] = np.log((row + LAMBDA * base) / (np.bincount(kind, weights=row, minlength=CLASSES)[kind] + LAMBDA))
    return out


class Scorer:
    """Scores many texts in batches of windows."""

    def __init__(self, net: Net, inside: np.ndarray) -> None:
        self.net, self.inside, self.t = net, inside, net.tables()

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(texts))
        held, owners, size = [], [], 0

        def flush():
            x, y, there = (np.concatenate([h[i] for h in held]) for i in range(3))
            who = np.concatenate(owners)
            points = np.empty(len(x))
            for a in range(0, len(x), AT_ONCE):
                xs, ys = x[a : a + AT_ONCE], y[a : a + AT_ONCE]
                lp = self.net.class_logp(xs, self.t, ys) + self.inside[self.net.kind.take(xs[:, CONTEXT:]), ys]
                points[a : a + AT_ONCE] = np.where(there[a : a + AT_ONCE], lp, 0).sum(1, dtype=np.float64)
            out[:] += np.bincount(who, weights=points, minlength=len(out))

        for i, ids in enumerate(texts):
            for a in range(0, len(ids), STRIDE * BATCH * 8):  # long texts in parts that keep their context
                part = ids[max(0, a - CONTEXT - 1) : a + STRIDE * BATCH * 8]
                x, y, there = windows(part if not a else part[CONTEXT + 1 :], self.net.begin)
                if a:
                    lead = np.concatenate([part, np.full(-len(part[CONTEXT + 1 :]) % STRIDE, self.net.begin)])
                    x = lead[np.arange(len(x))[:, None] * STRIDE + np.arange(LENGTH)[None, :]]
                held.append((x, y, there))
                owners.append(np.full(len(x), i))
                size += len(x)
            if size >= BATCH * 8:
                flush()
                held, owners, size = [], [], 0
        if held:
            flush()
        return out / np.log(10)
