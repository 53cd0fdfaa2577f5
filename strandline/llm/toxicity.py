"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult and threat (with a lexical weight), target, negation, reporting verb, quotation mark, clause break,
other. Five small transducers read the symbols one after another, each writing a symbol for each one that it reads, with a factor:
negation weakens what follows it closely and hands a negated insult, threat or target on as any other word; reported speech
weakens what is quoted and hands a quoted target on as any other word; a target strengthens an insult and makes a threat one
(before or after it); insults in a row strengthen each other. They are composed into one machine, which scores matched clauses,
not isolated words.

The insult terminals (words and word beginnings) and the calibration of clause scores to a probability are learned from
labelled documents: a sample of about `ToxParams.sample` of them at most, picked by a hash of the id (the documented bound of the
training). Scoring reads the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, held_out, named, release_memory, small_batches, stored, with_columns

OTHER, BREAK, TARGET, NOT, REPORT, QUOTE, INSULT, THREAT = range(8)

# Fixed terminals of the grammar in the languages of the corpus.
WORDS = {
    TARGET: "you your yours yourself he him his she her they them their people tu te toi vous ton votre ils elles du dich dir ihr euch sie usted ustedes vosotros ellos",
    NOT: "not never isn't aren't don't doesn't nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says say claimed claims called wrote quoted reported allegedly sagte schrieb dit disait écrit dijo dice escribió",
    THREAT: "kill murder hurt stab shoot burn destroy strangle töten umbringen tuer frapper matar golpear",
}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"“”«»]")


@dataclass(frozen=True)
class ToxParams:
    """sample: about how many labelled documents are learned from, at most. prefixes: lengths of word beginnings that may be terminals. evidence:
    least G statistic of a terminal. seen: least toxic documents with it. lexicon: most terminals. kept: words a worker remembers."""

    sample: int = 12_000
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    evidence: float = 15.0
    seen: int = 3
    lexicon: int = 20_000
    threat: float = 2.0
    kept: int = 150_000


class Transducer:
    """A deterministic transducer over the symbols: from a state, a symbol leads on, is written as a symbol, and gets a factor."""

    def __init__(self, states: int):
        self.to = [[0] * 8 for _ in range(states)]
        self.out = [list(range(8)) for _ in range(states)]
        self.factor = [[1.0] * 8 for _ in range(states)]

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes is read by the other; factors multiply."""
        n = len(other.to)
        made = Transducer(len(self.to) * n)
        for a in range(len(self.to)):
            for b in range(n):
                for x in range(8):
                    y = self.out[a][x]
                    made.to[a * n + b][x] = self.to[a][x] * n + other.to[b][y]
                    made.out[a * n + b][x] = other.out[b][y]
                    made.factor[a * n + b][x] = self.factor[a][x] * other.factor[b][y]
        return made

    def run(self, symbols: list[int]) -> tuple[list[int], list[float]]:
        """What it writes, and the factors."""
        state, out, factors = 0, [], []
        for x in symbols:
            out.append(self.out[state][x])
            factors.append(self.factor[state][x])
            state = self.to[state][x]
        return out, factors


def _window(opener: int, span: int, inside: dict[int, float], outside: dict[int, float], hidden: tuple[int, ...] = ()) -> Transducer:
    """The opener's effect lasts for `span` symbols or to the clause's end; factors differ inside and outside of it, and hidden symbols are written as OTHER inside."""
    t = Transducer(span + 1)
    for s in range(span + 1):
        for x in range(8):
            t.to[s][x] = 0 if x == BREAK else span if x == opener else max(0, s - 1)
            t.out[s][x] = OTHER if s and x in hidden else x
            t.factor[s][x] = (inside if s else outside).get(x, 1.0)
    return t


def negation() -> Transducer:
    return _window(NOT, 3, {INSULT: 0.35, THREAT: 0.1, TARGET: 0.0}, {}, (INSULT, THREAT, TARGET))


def target() -> Transducer:
    return _window(TARGET, 6, {INSULT: 1.4, THREAT: 1.5}, {THREAT: 0.25})


def aimed() -> Transducer:
    """A target that follows a threat closely makes up for what the threat lacks without one; elsewhere a target has no weight of its own."""
    return _window(THREAT, 4, {TARGET: 1.25}, {TARGET: 0.0})


def chain() -> Transducer:
    return _window(INSULT, 4, {INSULT: 1.15}, {})


def reported() -> Transducer:
    """A reporting verb weakens the rest of its clause, and a quotation that it opens up to the closing mark."""
    t = Transducer(3)
    for s in range(3):
        for x in range(8):
            t.to[s][x] = {0: 1 if x == REPORT else 0, 1: 0 if x == BREAK else 2 if x == QUOTE else 1, 2: 0 if x == QUOTE else 2}[s]
            t.out[s][x] = OTHER if s and x == TARGET else x
            t.factor[s][x] = 0.0 if s and x == TARGET else 0.5 if s and x in (INSULT, THREAT) else 1.0
    return t


def machines() -> list[Transducer]:
    return [negation(), reported(), target(), aimed(), chain()]


def grammar() -> Transducer:
    first, *rest = machines()
    for t in rest:
        first = first.then(t)
    return first


class Scorer:
    """Features of a text: clause scores that the composed grammar gives."""

    NAMES = ("total", "density", "most", "clauses", "words", "root")

    def __init__(self, lexicon: dict[str, float], p: ToxParams):
        """lexicon: `word$` for a whole word or `begin` for a word's beginning -> weight."""
        self.lexicon, self.p = lexicon, p
        self.machine = grammar()
        self.fixed = {w: k for k, ws in WORDS.items() for w in ws.split()} | dict.fromkeys(".!?;\n", BREAK) | dict.fromkeys('"“”«»', QUOTE)
        self.known: dict[str, tuple[int, float] | None] = {}

    def _symbol(self, w: str) -> tuple[int, float] | None:
        best = max([self.lexicon.get(w + "$", 0.0), *[self.lexicon.get(w[:n], 0.0) for n in self.p.prefixes if n < len(w)]])
        kind = self.fixed.get(w, OTHER)
        if kind == THREAT:
            return THREAT, max(best, self.p.threat)
        if kind != OTHER:
            return kind, self.p.threat if kind == TARGET else 0.0
        return (INSULT, best) if best > 0 else None

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses with a match, and the number of words."""
        tokens = _TOKEN.findall(text.lower())
        known = self.known
        if len(known) > self.p.kept:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = self._symbol(w)
        symbols = list(map(known.__getitem__, tokens))
        to, factor = self.machine.to, self.machine.factor
        found: list[float] = []
        state, score, words = 0, 0.0, len(tokens)
        for s in symbols:
            if s is None:
                state = to[state][OTHER] if state else 0
                continue
            x, weight = s
            if weight:
                score += weight * factor[state][x]
            if x == BREAK:
                words -= 1
                if score:
                    found.append(score)
                    score = 0.0
            state = to[state][x]
        if score:
            found.append(score)
        return found, words

    def features(self, text: str | None) -> list[float]:
        found, words = self.clauses(text) if text else ([], 0)
        total = sum(found)
        return [total, 100 * total / (words + 20), max(found, default=0.0), float(len(found)), math.log1p(words), math.sqrt(total)]


def learn_lexicon(sample: DataFrame, p: ToxParams) -> dict[str, float]:
    """sample (text, toxic) -> terminals that are more frequent in toxic documents, with log rate ratios as weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: tuple[Counter, Counter] = (Counter(), Counter())
        docs: tuple[Counter, Counter] = (Counter(), Counter())
        for whole in batches:
            for part in byte_slices(whole, 0, 4 << 20):
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    c = Counter(w for w in _TOKEN.findall((text or "").lower()) if w[0].isalpha())
                    many[y].update(c)
                    # Each document counts once for each terminal.
                    docs[y].update({f for w in c for f in (w + "$", *[w[:n] for n in p.prefixes if n < len(w)])})
        occ: tuple[Counter, Counter] = (Counter(), Counter())
        for y in (0, 1):
            for w, n in many[y].items():
                for f in (w + "$", *[w[:k] for k in p.prefixes if k < len(w)]):
                    occ[y][f] += n
        # A terminal that no toxic document here has still counts against it.
        names = list(occ[0].keys() | occ[1].keys())
        cols = [pa.array([c.get(f, 0) for f in names], pa.int64()) for c in (occ[0], occ[1], docs[1])]
        for s in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[s : s + 100_000], pa.string()), *[c.slice(s, 100_000) for c in cols]], names=["f", "neg", "pos", "seen"])
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), *[pa.array([sum(c.values())], pa.int64()) for c in many], pa.array([0], pa.int64())], names=["f", "neg", "pos", "seen"])
        del many, docs, occ, names, cols
        release_memory()

    got = sample.select("text", "toxic").mapInArrow(run, "f string, neg long, pos long, seen long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("neg", "pos", "seen")])
    rows = got.filter(f"f = '' or seen >= {p.seen}")
    total = got.filter("f = ''").head()
    if total is None or not total["neg"] or not total["pos"]:
        return {}
    n, m = float(total["neg"]), float(total["pos"])
    weight = F.log((F.col("pos") + 0.5) / (m + 1)) - F.log((F.col("neg") + 0.5) / (n + 1))
    both = F.col("pos") + F.col("neg")
    g = 2 * (F.col("pos") * F.log((F.col("pos") + 1e-9) / (both * m / (n + m))) + F.col("neg") * F.log((F.col("neg") + 1e-9) / (both * n / (n + m))))
    top = rows.filter("f <> ''").select("f", "pos", weight.alias("w"), g.alias("g")).filter((F.col("g") >= p.evidence) & (F.col("w") >= 0.7)).orderBy(F.desc("g"), "f").limit(p.lexicon)
    found = top.collect()
    # A word's beginning is no terminal of its own if one word makes up most of what speaks for it.
    most: dict[str, int] = {}
    for r in found:
        if r["f"].endswith("$"):
            for k in p.prefixes:
                most[r["f"][:-1][:k]] = max(most.get(r["f"][:-1][:k], 0), r["pos"])
    return {r["f"]: min(6.0, r["w"]) for r in found if r["f"].endswith("$") or most.get(r["f"], 0) < 0.6 * r["pos"]}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps with a small ridge: (mean, scale, weights, intercept)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (y - q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w[:-1], float(w[-1])


@dataclass
class Model:
    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights + self.intercept, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, p: ToxParams = ToxParams(), held_out_mod: int = 5) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic) outside the held-out rows; null labels don't count, and an id with both labels counts as toxic."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), held_out_mod)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.filter("doc_id is not null"), "labels")
    n = known.count()
    share = min(1.0, p.sample / n) if n else 1.0
    # About p.sample rows, whatever the number of labels: a share of them by a hash of the id.
    thin = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < share * 1_000_003)
    sample = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(thin), "doc_id").select("text", "toxic"), "sample")
    lexicon = learn_lexicon(sample, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, p)
        for whole in batches:
            for part in byte_slices(whole, 0, 4 << 20):
                x = [scorer.features(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), *[pa.array([r[k] for r in x], pa.float64()) for k in range(len(Scorer.NAMES))]], names=["toxic", *Scorer.NAMES])
        del scorer
        release_memory()

    got = sample.mapInArrow(run, "toxic int, " + ", ".join(f"{c} double" for c in Scorer.NAMES)).toPandas()
    x, y = got[list(Scorer.NAMES)].to_numpy(float), got["toxic"].to_numpy(float)
    if len(set(y.tolist())) < 2:
        k, base = len(Scorer.NAMES), (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, np.zeros(k), np.ones(k), np.zeros(k), math.log(base / (1 - base)))
    return Model(lexicon, *_fit(x, y))


def _scored(docs: DataFrame, model: Model, p: ToxParams, score: str, text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        scorer = Scorer(model.lexicon, p)

        def run(texts: pa.Array) -> list:
            x = np.array([scorer.features(t) for t in texts.to_pylist()])
            return [pa.array(model.probability(x))]

        return run

    return with_columns(docs, text_col, [T.StructField(score, T.DoubleType())], make)


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxParams = ToxParams(), held_out_mod: int = 5) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    A null or empty text has no clause and gets the score of a text without match. With no labels of both kinds to learn from,
    every score is the smoothed share of toxic labels (0.5 without any). Columns of docs that bear a new name are replaced;
    repeated rows stay; an empty table gives an empty result.
    """
    out = _scored(docs, learn(docs, labels, p, held_out_mod), p, "score")
    return out.withColumn("held_out", held_out(F.col("doc_id"), held_out_mod)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, p: ToxParams = ToxParams(), held_out_mod: int = 5, at: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below `at`."""
    out = _scored(docs, learn(docs, labels, p, held_out_mod), p, "__tox_score")
    return out.filter(F.col("__tox_score") < at).select(*named(docs))
