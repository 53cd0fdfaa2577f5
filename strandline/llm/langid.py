"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters of lower-cased words, with a blank at word ends) in
order. A document's own most frequent n-grams are ranked alike; its distance to a language is the sum, over them, of how far
each is out of place in the profile (an n-gram that isn't in the profile counts as far as can be). The least distance wins.

The profiles come from n-gram counts that Spark adds up; the training rows of a language are thinned to about
`LangParams.sample` documents by a hash of their text (a documented bound of the classifier's training).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, held_out, named, small_batches, stored, with_columns

UNKNOWN = "und"
#: Up to so many languages their sizes are broadcast; beyond it they are joined.
BROADCAST_LANGS = 10_000


@dataclass(frozen=True)
class LangParams:
    """top: n-grams in a profile. sample: about how many documents of a language the profile is counted on. reach: similarity below
    which a text is never in a language that was learned; slack, enough: see `reaches` (only `keep_known` asks)."""

    top: int = 400
    sample: int = 3000
    reach: float = 0.02
    slack: float = 0.9
    enough: int = 30


_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what isn't a letter."""
    if not _letter:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                t[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _letter.append(t)
    return _letter[0]


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: 21 bits a character, a blank (0) before and after each word; empty if it has no letter."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = (x != 0) | np.concatenate((x[1:] != 0, [False]))  # one blank before each word
    x = x[keep]
    if not len(x):
        return np.empty(0, np.uint64)
    x = np.concatenate(([0], x, [0]) if x[0] else (x, [0])).astype(np.uint64)
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    mid = x[1:-1] != 0
    return np.concatenate((x[x != 0], two | np.uint64(1 << 63), three[mid] | np.uint64(3 << 62) if len(three) else three))


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order of falling frequency, ties by code."""
    s = np.sort(codes)
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    n = np.diff(np.append(cut, len(s)))
    u = s[cut]
    if len(u) > top:  # keep all that tie with the last place
        least = np.partition(n, len(n) - top)[len(n) - top]
        u, n = u[n >= least], n[n >= least]
    return u[np.lexsort((u, -n))][:top]


def learn(docs: DataFrame, p: LangParams) -> dict[str, list[int]]:
    """lang -> profile, from the rows (text, lang) of docs; rows without lang or text don't count."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = stored(known.groupBy("lang").count(), "langs")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    share = F.least(F.lit(1.0), F.lit(float(p.sample)) / F.col("count"))
    thin = known.join(sizes, "lang").filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < share * 1_000_003).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, 0, 4 << 20):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for lang in set(langs):
                    u, c = np.unique(np.concatenate([ngram_codes(t) for t, x in zip(texts, langs, strict=True) if x == lang]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "code", "c"])

    counts = thin.mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "code"))).filter(F.col("rank") <= p.top)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():  # languages x top rows
        out.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {k: [c for _, c in sorted(v)] for k, v in out.items()}


class Identifier:
    """Profiles as one sorted table of codes with a rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], top: int):
        self.langs, self.top = sorted(profiles), top
        codes = np.unique(np.array([c for v in profiles.values() for c in v], np.int64).view(np.uint64))
        self.codes = codes
        self.rank = np.full((len(codes) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(codes, np.array(profiles[lang], np.int64).view(np.uint64)), k] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is one less the mean out-of-place distance as a share of the greatest; (und, 0) without a letter."""
        codes = ngram_codes(text) if text else np.empty(0, np.uint64)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(codes, self.top)
        at = np.searchsorted(self.codes, mine)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == mine[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        r = self.rank[at]
        away = np.where(r < 0, self.top, np.abs(r - np.arange(len(mine))[:, None])).mean(0)
        k = int(np.argmin(away))
        return self.langs[k], float(max(0.0, 1 - away[k] / self.top))


def _identified(docs: DataFrame, profiles: dict[str, list[int]], p: LangParams, lang: str, score: str, text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        one = Identifier(shared.value, p.top)

        def run(texts: pa.Array) -> list:
            got = [one(t) for t in texts.to_pylist()]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return run

    return with_columns(docs, text_col, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], make)


def identify(docs: DataFrame, p: LangParams = LangParams(), held_out_mod: int = 5) -> DataFrame:
    """docs with held_out, lang_pred and score (0 to 1).

    Profiles are learned from rows with non-null text and lang whose crc32 of doc_id as text leaves a remainder other than 0.
    A text that is null or has no letter gets `und` and score 0; so does every text if there is nothing to learn from. Ties
    go to the language that sorts first. Columns of docs that bear a new name are replaced; repeated rows stay; an empty
    table gives an empty result.
    """
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), held_out_mod))
    return _identified(docs, learn(docs.filter("not held_out"), p), p, "lang_pred", "score")


def _length() -> Column:
    """Texts by length: the whole part of log2 of the characters."""
    return F.floor(F.log2(F.greatest(F.length(F.col("__lang_text")), F.lit(1)))).cast("int")


def reaches(scored: DataFrame, p: LangParams) -> dict[str, tuple[float, dict[int, float]]]:
    """language -> (its least, length -> least) of the scores of scored training rows (__lang_pred, __lang_score, __lang_text), times p.slack.

    A length counts with its two neighbours; one with fewer than p.enough rows has the language's least.
    """
    got = scored.filter(F.col("__lang_pred") != UNKNOWN).groupBy("__lang_pred", _length().alias("size")).agg(F.min("__lang_score").alias("least"), F.count("*").alias("n")).collect()
    by: dict[str, dict[int, tuple[float, int]]] = {}
    for r in got:  # languages x lengths rows
        by.setdefault(r["__lang_pred"], {})[r["size"]] = (r["least"], r["n"])
    out = {}
    for lang, sizes in by.items():
        some = {}
        for k in sizes:
            near = [sizes[j] for j in (k - 1, k, k + 1) if j in sizes]
            if sum(n for _, n in near) >= p.enough:
                some[k] = max(p.reach, p.slack * min(x for x, _ in near))
        out[lang] = (max(p.reach, p.slack * min(x for x, _ in sizes.values())), some)
    return out


def keep_known(docs: DataFrame, p: LangParams = LangParams(), held_out_mod: int = 5) -> DataFrame:
    """The rows of docs whose text is in a language that was learned; rejected are texts without a letter and texts less similar to
    their language than the training rows of like length."""
    train = docs.filter(~held_out(F.col("doc_id"), held_out_mod))
    profiles = learn(train, p)
    scored = _identified(docs.withColumn("__lang_text", F.col("text").cast("string")), profiles, p, "__lang_pred", "__lang_score")
    taught = F.col("text").isNotNull() & F.col("lang").isNotNull()
    found = reaches(scored.filter(~held_out(F.col("doc_id"), held_out_mod) & taught), p)
    least = F.lit(p.reach)
    for lang, (whole, some) in sorted(found.items()):
        of = F.lit(whole)
        for k, x in sorted(some.items()):
            of = F.when(_length() == k, x).otherwise(of)
        least = F.when(F.col("__lang_pred") == lang, of).otherwise(least)
    return scored.filter((F.col("__lang_pred") != UNKNOWN) & (F.col("__lang_score") >= least)).select(*named(docs))
