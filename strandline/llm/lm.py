"""A log-bilinear language model trained in numpy by noise-contrastive estimation.

Corpus statistics (how often each word occurs in all training texts) are counted by Spark and may have any number of words.
The two words before a token predict it: score(x | a, b) = (C1 * r_a + C2 * r_b) . q_x + bias_x, in a tree of two levels. The
root's children are the most frequent words, clusters of further frequent words (neighbours in rank), groups of all other
words, and the end of a text; a cluster's children are its words, a group's are leaves that a word's hash picks. Every child has
a vector and a bias of its own, and a softmax over its siblings normalises it. Words of one leaf share it as their smoothed
counts say, one unseen word included; so token log-probabilities are normalised over the vocabulary and the unseen words.
Clusters and groups grow in number with the vocabulary, up to the bounds in `LmParams`. As contexts, the most frequent words have
rows of their own and all others a row that their hash picks.

Training: each task runs noise-contrastive estimation over all of its tokens (at the root, unigram noise that a minibatch
shares; in a cluster or group, noise of its children for each token) by batched matrix products. One task first learns from a
sample of about `LmParams.warm` tokens, so that all others start near one another; then rows of parameters are averaged,
weighted by the updates that they got in each task. What a task sends back has the size of the model, whatever the input's. The
result depends on how rows fall into partitions, as the averages do; the same files and settings give the same model.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import SLICE, byte_slices, held_out, release_memory, small_batches, stored

ALPHA = 0.1


@dataclass(frozen=True)
class LmParams:
    """direct: frequent words that are children of the root. clusters: most clusters of further ones; groups: most groups of other
    words; width: children of each. head: frequent words whose counts every task holds. own, slots: contexts with rows of their
    own, and rows for the rest. All of these bound what is sent to tasks. dim, noise, near, batch, rate, heavy, rounds: of the
    training (near: noise children of a token's own cluster or group). warm: about how many tokens the start is learned from
    (a sample by a hash of the id; the training itself takes all). flush: tokens that are learned from at a time."""

    direct: int = 63
    clusters: int = 160
    groups: int = 32
    width: int = 128
    head: int = 131_072
    own: int = 8192
    slots: int = 8192
    dim: int = 15
    noise: int = 32
    near: int = 3
    batch: int = 2048
    rate: float = 0.1
    heavy: int = 16
    rounds: int = 1
    warm: int = 1_500_000
    flush: int = 500_000


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for whole in batches:
        for part in byte_slices(whole, text, SLICE // 2):
            h, off = wordhash.words(part.column(text))
            yield part, h, off


def word_counts(texts: DataFrame, p: LmParams) -> DataFrame:
    """(h, c): how often each word hash occurs in the column text, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for _, h, _ in _batches(batches, 0):
            held.append(h)
            n += len(h)
            if n >= p.flush:
                yield out()
                held, n = [], 0
        if held:
            yield out()
        held.clear()
        release_memory()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Lookup:
    """From word hashes to positions in a sorted table, by a direct index on the high bits and a short search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted uint64
        self.bits = max(1, min(20, int(len(keys)).bit_length() + 2))
        self.start = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        last = len(self.keys)
        while len(todo):
            a = at[todo]
            inside = a < last
            todo, a = todo[inside], a[inside]
            k = self.keys[a]
            hit = k == h[todo]
            out[todo[hit]] = a[hit]
            todo = todo[k < h[todo]]
            at[todo] += 1
        return out


@dataclass
class Tables:
    """What every task holds: the head words' hashes and counts, where they are in the tree, and the totals."""

    keys: np.ndarray
    counts: np.ndarray
    node: np.ndarray  # child of the root of each head word
    leaf: np.ndarray  # child of a block (cluster or group), numbered through; -1: the word is a child of the root
    row: np.ndarray  # context row of each head word
    direct: int
    clusters: int
    groups: int
    width: int
    own: int
    slots: int
    total: int  # training tokens, ends included
    distinct: int  # distinct training tokens, the end included
    ends: int
    node_mass: np.ndarray  # smoothed counts of the root's children, the end last
    leaf_mass: np.ndarray  # (blocks, width), 0 for children that aren't there

    @property
    def end(self) -> int:
        return self.direct + self.clusters + self.groups

    @property
    def begin(self) -> int:
        return self.own + self.slots

    def tail_leaf(self, h: np.ndarray) -> np.ndarray:
        """The leaf that a word outside direct words and clusters has by its hash."""
        return self.clusters * self.width + ((h & np.uint64((1 << 63) - 1)) % np.uint64(self.groups * self.width)).astype(np.int64)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return self.own + ((h >> np.uint64(34)) % np.uint64(self.slots)).astype(np.int64)


#: `Tables.tail_leaf` in SQL, from the first group's first leaf.
LEAF = "cast((h & 9223372036854775807) % {} as int)"


def _head(counts: DataFrame, distinct: int, most: int) -> DataFrame:
    """The most frequent words, at most `most`: all above a count that a histogram over sixteenths of powers of two gives."""
    if distinct <= most:
        return counts
    step = F.floor(F.log2("c") * 16)
    above, least = 0, 1 << 20
    for s, n in sorted(map(tuple, counts.groupBy(step.alias("s")).count().collect()), reverse=True):
        if above + n > most:
            break
        above, least = above + n, s
    return counts.filter(step >= least)


def tables(counts: DataFrame, n_texts: int, p: LmParams) -> Tables:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    top = _head(counts, int(distinct), p.head).toPandas().sort_values(["c", "h"], ascending=[False, True])
    keys, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    direct = min(p.direct, len(top))
    clusters = min(p.clusters, -(-(len(top) - direct) // p.width))
    classes = min(len(top), direct + clusters * p.width)
    others = int(distinct) - classes
    groups = max(1, min(p.groups, -(-others // (8 * p.width))))
    own, slots = min(p.own, len(top)), min(p.slots, 1 << max(1, int(distinct)).bit_length())
    t = Tables(keys, c, np.empty(0), np.empty(0), np.empty(0), direct, clusters, groups, p.width, own, slots, int(total) + n_texts, int(distinct) + (n_texts > 0), n_texts, np.empty(0), np.empty(0))
    rank = np.arange(len(top))
    leaf = np.where(rank < direct, -1, np.where(rank < classes, rank - direct, t.tail_leaf(keys)))
    # Sums of counts and numbers of words by leaf of the groups (as many rows as leaves), less those of words with a class of their own.
    leaves = groups * p.width
    mass, words = np.zeros(leaves), np.zeros(leaves)
    for g, n, w in counts.groupBy(F.expr(LEAF.format(leaves)).alias("g")).agg(F.sum("c"), F.count("*")).collect():
        mass[g], words[g] = n, w
    at = t.tail_leaf(keys[:classes]) - clusters * p.width
    mass += ALPHA * (words + 1) - np.bincount(at, c[:classes] + ALPHA, leaves)
    inner = np.zeros(clusters * p.width)
    inner[: classes - direct] = c[direct:classes] + ALPHA
    t.leaf_mass = np.concatenate((inner, np.maximum(mass, ALPHA))).reshape(-1, p.width)
    t.node_mass = np.concatenate((c[:direct] + ALPHA, t.leaf_mass.sum(1), [n_texts + ALPHA]))
    order = np.argsort(keys)
    t.keys, t.counts, t.leaf = keys[order], c[order], leaf[order]
    t.node = np.where(t.leaf < 0, rank[order], direct + t.leaf // p.width)
    t.row = np.where(rank[order] < own, rank[order], t.slot(t.keys))
    return t


def sequences(h: np.ndarray, off: np.ndarray, pos: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, node, leaf, at, offsets): context rows of the word before each token and of the one before that, the token's places in
    the tree, where the words are among the tokens, and the offsets of texts; a text of n words has n + 1 tokens."""
    n = len(off) - 1
    out_off = off + np.arange(n + 1)
    size = int(out_off[-1])
    node, leaf, row = np.full(size, t.end, np.int32), np.full(size, -1, np.int32), np.full(size, t.begin, np.int32)
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(off))
    if len(h):
        known = pos >= 0
        where, of = np.flatnonzero(known), pos[known]
        lf, nd, rw = np.empty(len(h), np.int64), np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        lf[where], nd[where], rw[where] = t.leaf[of], t.node[of], t.row[of]
        rest = np.flatnonzero(~known)
        lf[rest], rw[rest] = t.tail_leaf(h[rest]), t.slot(h[rest])
        nd[rest] = t.direct + lf[rest] // t.width
        leaf[at], node[at], row[at] = lf, nd, rw
    a, b = np.full(size, t.begin, np.int32), np.full(size, t.begin, np.int32)
    a[1:], b[2:] = row[:-1], row[:-2]
    first = out_off[:-1]
    a[first] = b[first] = t.begin
    second = first + 1
    b[second[second < out_off[1:]]] = t.begin
    return a, b, node, leaf, at, out_off


@dataclass
class Theta:
    """Parameters, float32: r (contexts), q (root's children, the last column is the bias), l (leaves, likewise), and c = (C1, C2)."""

    r: np.ndarray
    q: np.ndarray
    l: np.ndarray
    c: np.ndarray

    def copy(self) -> Theta:
        return Theta(*(x.copy() for x in self.parts()))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.r, self.q, self.l, self.c


def initial(t: Tables, p: LmParams) -> Theta:
    rng = np.random.default_rng(7)
    d, f = p.dim, np.float32
    vector = lambda n, s: rng.normal(0, s, (n, d))
    share = t.leaf_mass / t.leaf_mass.sum(1)[:, None]
    bias = np.where(share > 0, np.log(np.maximum(share, 1e-300)), -1e9).ravel()
    q = np.column_stack([vector(t.end + 1, 0.05), np.log(t.node_mass / t.node_mass.sum())])
    leaf = np.column_stack([vector(len(bias), 0.05), bias])
    return Theta(vector(t.begin + 1, 0.3).astype(f), q.astype(f), leaf.astype(f), np.stack([np.full(d, 1.0), np.full(d, 0.5)]).astype(f))


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by row number: a row's first value is copied, the second added and so on, as long as many rows have another; the rest goes by runs."""
    order = np.argsort(rows, kind="stable")
    r = rows.take(order)
    cut = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    times = np.diff(cut, append=len(r))
    out, layer = values.take(order.take(cut), 0), 1
    more = np.flatnonzero(times > 1)
    while len(more) > 128:
        out[more] += values.take(order.take(cut.take(more) + layer), 0)
        layer += 1
        more = more.compress(times.take(more) > layer)
    if len(more):
        left = times.take(more) - layer
        first = np.cumsum(left) - left
        at = np.repeat(cut.take(more) + layer - first, left) + np.arange(left.sum())
        out[more] += np.add.reduceat(values.take(order.take(at), 0), first, axis=0)
    return r.take(cut), out


def _put(x: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """x[rows] = values, a whole row at a time."""
    whole = np.dtype((np.void, x.itemsize * x.shape[1]))
    np.put(x.view(whole).ravel(), rows, np.ascontiguousarray(values).view(whole).ravel())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Nce:
    """One task's training: AdaGrad over minibatches of weighted tokens."""

    def __init__(self, theta: Theta, square: Theta, t: Tables, p: LmParams, seed: int):
        """square: sums of squared gradients so far."""
        self.theta, self.t, self.p = theta.copy(), t, p
        self.square = square.copy().parts()
        self.used = [np.zeros(len(x), np.int64) for x in theta.parts()]
        self.rng = np.random.default_rng(seed)
        uni = t.node_mass / t.node_mass.sum()
        self.log_kq, self.cdf = np.log(p.noise * uni).astype(np.float32), np.cumsum(uni)
        # Noise in a block: a table of its children, each in it once at least and else by its share.
        share = t.leaf_mass / t.leaf_mass.sum(1)[:, None]
        there = share > 0
        times = there + np.floor(share * 3 * t.width).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(times.sum(1))))
        self.table = np.repeat(np.arange(share.size), times.ravel())
        self.log_kl = np.log(p.near * np.maximum(times, 1) / times.sum(1)[:, None]).astype(np.float32).ravel()

    def learn(self, a: np.ndarray, b: np.ndarray, node: np.ndarray, leaf: np.ndarray) -> None:
        """One pass over all tokens; equal ones go together with a weight, those seen often in several entries, so that a minibatch doesn't hang on one of them."""
        t = self.t
        n, m = t.begin + 1, t.leaf_mass.size + t.end + 1
        key, weight = np.unique((a.astype(np.int64) * n + b) * m + np.where(leaf >= 0, leaf, t.leaf_mass.size + node), return_counts=True)
        pieces = -(-weight // self.p.heavy)
        order = self.rng.permutation(np.repeat(np.arange(len(key)), pieces))
        share = (weight / pieces).astype(np.float32)
        for s in range(0, len(order), self.p.batch):
            k = order[s : s + self.p.batch]
            x = key[k]
            code, target = x // m, x % m
            lf = np.where(target < t.leaf_mass.size, target, -1)
            self.step(code // n, code % n, np.where(lf < 0, target - t.leaf_mass.size, t.direct + lf // t.width), lf, share[k])

    def _climb(self, which: int, rows: np.ndarray, values: np.ndarray) -> None:
        r, g = _sums(rows.astype(np.uint16) if len(self.used[which]) <= 65536 else rows, values)
        x, sq = self.theta.parts()[which], self.square[which]
        r = r.astype(np.intp)
        new = sq.take(r, 0)
        new += g * g
        _put(sq, r, new)
        np.sqrt(new, out=new)
        np.divide(g, new, out=new)
        new *= np.float32(self.p.rate)
        new += x.take(r, 0)
        _put(x, r, new)
        self.used[which][r] += 1

    def step(self, a: np.ndarray, b: np.ndarray, node: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> None:
        th, p, d = self.theta, self.p, self.p.dim
        c1, c2 = th.c[0].copy(), th.c[1].copy()
        ra, rb = th.r.take(a, 0), th.r.take(b, 0)
        ctx = np.ones((len(a), d + 1), np.float32)
        ctx[:, :d] = ra * c1 + rb * c2
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(p.noise)), self.t.end)
        qt, qn = th.q.take(node, 0), th.q.take(noise, 0)
        gn = ctx @ qn.T
        gn -= self.log_kq[noise]
        _sigmoid(gn)
        gn *= -weight[:, None]  # pushes the noise down
        gp = weight * _sigmoid(self.log_kq[node] - np.einsum("nd,nd->n", ctx, qt))  # pulls the true child up
        g = gp[:, None] * qt[:, :d] + gn @ qn[:, :d]
        deep = np.flatnonzero(leaf >= 0)
        if len(deep):
            mine, cx = leaf[deep], ctx.take(deep, 0)
            block = mine // self.t.width
            lo, size = self.starts[block], self.starts[block + 1] - self.starts[block]
            drawn = self.table[lo[:, None] + (self.rng.random((len(deep), p.near), dtype=np.float32) * size[:, None]).astype(np.int64)]
            rows = np.concatenate([mine[:, None], drawn], 1)
            ql = th.l.take(rows, 0)
            gl = np.einsum("nkd,nd->nk", ql, cx)
            gl -= self.log_kl.take(rows)
            _sigmoid(gl)
            np.negative(gl, out=gl)
            gl[:, 0] += 1
            gl *= weight[deep][:, None]
            g[deep] += np.einsum("nk,nkd->nd", gl, ql)[:, :d]
            self._climb(2, rows.ravel(), cx.take(np.repeat(np.arange(len(deep)), 1 + p.near), 0) * gl.reshape(-1, 1))
        self._climb(1, np.concatenate([node, noise]), np.concatenate([gp[:, None] * ctx, gn.T @ ctx]))
        self._climb(3, np.arange(2), np.stack([(g * ra).sum(0), (g * rb).sum(0)]))
        self._climb(0, np.concatenate([a, b]), np.concatenate([g * c1, g * c2]))


def _learn_all(nce: Nce, batches: Iterator[pa.RecordBatch]) -> bool:
    """Learn from all texts, `flush` tokens at a time; whether there were any."""
    t, look = nce.t, Lookup(nce.t.keys)
    held: list[tuple[np.ndarray, ...]] = []
    n, some = 0, False
    for _, h, off in _batches(batches, 0):
        held.append(sequences(h, off, look(h), t)[:4])
        n += len(held[-1][0])
        if n >= nce.p.flush:
            nce.learn(*map(np.concatenate, zip(*held, strict=True)))
            held, n, some = [], 0, True
    if n:
        nce.learn(*map(np.concatenate, zip(*held, strict=True)))
        held.clear()
    release_memory()
    return some or n > 0


def _warm(learned: DataFrame, t: Tables, p: LmParams) -> tuple[Theta, Theta]:
    """Where all tasks start: parameters and sums of squares that one task learned from a sample of about p.warm tokens."""
    theta = initial(t, p)
    square = Theta(*(np.ones_like(x) for x in theta.parts()))
    shared = learned.sparkSession.sparkContext.broadcast((theta, square, t))
    share = min(1.0, p.warm / max(1, t.total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nce = Nce(*shared.value, p, 999)
        _learn_all(nce, batches)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((nce.theta.parts(), tuple(nce.square)))], pa.binary())], names=["v"])

    sample = learned.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < share * 1_000_003).select("text")
    got = sample.repartition(1).mapInArrow(run, "v binary").collect()  # one row of the model's size
    shared.unpersist()
    return tuple(Theta(*x) for x in pickle.loads(got[0]["v"])) if got else (theta, square)


def train(learned: DataFrame, t: Tables, p: LmParams) -> Theta:
    """Rounds of training over all rows of learned (doc_id, text); after each, a row of parameters is averaged by the updates that it got."""
    theta, square = _warm(learned, t, p)
    sc = learned.sparkSession.sparkContext
    starts = np.cumsum([0] + [len(x) for x in theta.parts()])
    for rnd in range(p.rounds):
        shared = sc.broadcast((theta, square, t))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rnd=rnd) -> Iterator[pa.RecordBatch]:
            nce = Nce(*shared.value, p, 1000 + rnd)
            if _learn_all(nce, batches):  # only rows that moved
                for k, (x, used) in enumerate(zip(nce.theta.parts(), nce.used, strict=True)):
                    at = np.flatnonzero(used)
                    wide = np.zeros((len(at), p.dim + 1), np.float32)
                    wide[:, : x.shape[1]] = x[at]
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (p.dim + 1)), pa.array(wide.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array((starts[k] + at).astype(np.int32)), pa.array(used[at].astype(np.float64)), rows], names=["row", "n", "v"])

        sent = learned.select("text").mapInArrow(run, "row int, n double, v array<float>")
        mean = sent.groupBy("row").agg(*[(F.sum(F.col("v")[j] * F.col("n")) / F.sum("n")).alias(f"v{j}") for j in range(p.dim + 1)])
        got = mean.toPandas().sort_values("row")
        theta = theta.copy()
        at, v = got["row"].to_numpy(np.int64), got[[f"v{j}" for j in range(p.dim + 1)]].to_numpy(np.float32)
        for k, x in enumerate(theta.parts()):
            mine = (at >= starts[k]) & (at < starts[k + 1])
            x[at[mine] - starts[k]] = v[mine][:, : x.shape[1]]
        shared.unpersist()
    return theta


@dataclass
class Model:
    """Tables and parameters, with what scoring needs of them."""

    t: Tables
    theta: Theta
    cached: list = field(default_factory=list)

    def _root(self) -> tuple[np.ndarray, ...]:
        """exp(scores) of the root's children from each context row alone, near and far, and the logs that were taken out; the sum over children of a product of two rows is the root's normaliser."""
        if not self.cached:
            r, q, c = self.theta.r, self.theta.q, self.theta.c
            d = r.shape[1]
            near, far = (r * c[0]) @ q[:, :d].T + q[:, d], (r * c[1]) @ q[:, :d].T
            m, k = near.max(1), far.max(1)
            self.cached.append((np.exp(near - m[:, None]), np.exp(far - k[:, None]), m, k))
        return self.cached[0]

    def __getstate__(self) -> tuple:
        return self.t, self.theta

    def __setstate__(self, state: tuple) -> None:
        self.t, self.theta = state
        self.cached = []

    def log_p(self, a: np.ndarray, b: np.ndarray, node: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of a root's child and, below it, of the leaf, from batched matrix products."""
        t, th = self.t, self.theta
        d = th.r.shape[1]
        e_near, e_far, m, k = self._root()
        out = np.empty(len(a))
        for s in range(0, len(a), 1024):
            x, y, z = a[s : s + 1024], b[s : s + 1024], node[s : s + 1024]
            whole = np.einsum("nj,nj->n", e_near.take(x, 0), e_far.take(y, 0))
            out[s : s + 1024] = np.log(e_near[x, z] * e_far[y, z] / whole)
        thin = np.flatnonzero(~np.isfinite(out))  # beyond float32's range: the plain way
        for i in thin.tolist():
            v = ((th.r[a[i]] * th.c[0] + th.r[b[i]] * th.c[1]) @ th.q[:, :d].T + th.q[:, d]).astype(np.float64)
            out[i] = v[node[i]] - v.max() - np.log(np.exp(v - v.max()).sum())
        order = np.argsort(leaf, kind="stable")
        cut = np.searchsorted(leaf[order], np.arange(len(t.leaf_mass) + 1) * t.width)
        for j in np.flatnonzero(np.diff(cut)).tolist():
            i = order[cut[j] : cut[j + 1]]
            part = th.l[j * t.width : (j + 1) * t.width]
            for s in range(0, len(i), 8192):
                ii = i[s : s + 8192]
                x = (th.r.take(a[ii], 0) * th.c[0] + th.r.take(b[ii], 0) * th.c[1]) @ part[:, :d].T + part[:, d]
                x -= x.max(1)[:, None]
                mine = x[np.arange(len(ii)), leaf[ii] - j * t.width]
                out[ii] += mine - np.log(np.exp(x).sum(1))
        return out


def fit(learned: DataFrame, p: LmParams = LmParams()) -> tuple[Model, DataFrame]:
    """learned (doc_id, text) -> the model, and (h, c), the count of each word hash."""
    small_batches(learned.sparkSession)
    counts = stored(word_counts(learned, p), "counts")
    t = tables(counts, learned.count(), p)
    return Model(t, train(learned, t, p)), counts


def score(docs: DataFrame, p: LmParams = LmParams(), held_out_mod: int = 10, id_col: str = "doc_id", text_col: str = "text", fitted: tuple[Model, DataFrame] | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts are words (see `wordhash`) and one end. Statistics and model come from the rows whose crc32 of doc_id as text
    leaves a remainder other than 0 modulo held_out_mod. base_score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))).
    score: the model's log10 probability. A null text counts as empty and has one token, its end. Rows that repeat a doc_id
    are each scored and each learned from. An empty table gives an empty result. fitted: what `fit` returned, to score by it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), held_out_mod))
    small_batches(spark)
    model, counts = fitted or fit(docs.filter("not held_out").select("doc_id", "text"), p)
    t = model.t
    shared = spark.sparkContext.broadcast(model)

    # Each row has a number of its own, so that rows which share a doc_id stay apart.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        t = model.t
        look, row = Lookup(t.keys), TaskContext.get().partitionId() << 40
        down = np.log10(t.total + ALPHA * (t.distinct + 1))
        log_c = np.log10(t.counts + ALPHA)
        first_tail, log_mass = t.clusters * t.width, np.log10(np.maximum(t.leaf_mass, 1e-300)).ravel()
        for part, h, off in _batches(batches, 1):
            n = len(off) - 1
            pos = look(h)
            a, b, node, leaf, place, toff = sequences(h, off, pos, t)
            lp = model.log_p(a, b, node, leaf) / np.log(10)
            known = pos >= 0
            at = np.repeat(np.arange(n), np.diff(off))
            share = np.where(known, log_c[np.maximum(pos, 0)] if len(log_c) else 0.0, 0.0)
            n_words = np.diff(off)
            base = np.bincount(at, share, n) + np.log10(t.ends + ALPHA) - (n_words + 1) * down
            model_sum = np.add.reduceat(lp, toff[:-1]) if n else np.empty(0)
            mine = leaf[place]
            tail = mine >= first_tail  # these share their leaf by their counts
            model_sum = model_sum + np.bincount(at[tail], share[tail] - log_mass[mine[tail]], n)
            # Words outside the head go on as (hash, times): their counts are joined.
            cell, times = np.unique(np.stack([at[~known].astype(np.uint64), h[~known]]), axis=1, return_counts=True) if (~known).any() else (np.empty((2, 0), np.uint64), np.empty(0, np.int64))
            cut = np.searchsorted(cell[0], np.arange(n + 1)).astype(np.int32)
            outside = pa.ListArray.from_arrays(pa.array(cut), pa.array(cell[1].view(np.int64)))
            many = pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int32)))
            ids = pa.array(np.arange(row, row + n))
            row += n
            yield pa.RecordBatch.from_arrays([ids, part.column(0), part.column(2), pa.array(n_words + 1), pa.array(np.bincount(at[known], None, n).astype(np.int64) + int(t.ends > 0)), pa.array(base), pa.array(model_sum), outside, many], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "times"])
        release_memory()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    first = stored(docs.select("doc_id", "text", "held_out").mapInArrow(run, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>, times array<int>"), "scored")
    tail = first.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("h"), F.col("x.times").alias("k"))
    more = tail.join(counts, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("logs"))
    return first.drop("tail", "times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(t.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
