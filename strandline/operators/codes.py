"""Gene codes: all words over an alphabet, and a choice of codes that differ enough to survive a misread sign."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chance of a code by its number of ones, in 101sts: fixed values. More ones: none.
ONES = (101, 52, 3)


def words(spark: SparkSession, alphabet: str, size: int) -> DataFrame:
    """(code) of all words of `size` signs, each read off the digits of a row's number; made by the executors."""
    base = len(alphabet)
    sign = lambda k: F.substring(F.lit(alphabet), (F.floor(F.col("id") / base ** (size - 1 - k)) % base + 1).cast("int"), F.lit(1))
    return spark.range(base**size).select(F.concat(F.lit(""), *[sign(k) for k in range(size)]).alias("code"))


def ones(code: Column) -> Column:
    """How often the sign 1 occurs."""
    return F.char_length(code) - F.char_length(F.replace(code, F.lit("1"), F.lit("")))


def eligible(codes: DataFrame) -> DataFrame:
    """Codes of three or more different signs that aren't ruled out by their ones, with their weight."""
    weight = F.array(*[F.lit(w) for w in ONES])
    kinds = F.size(F.array_distinct(F.split("code", "")))
    return codes.withColumn("weight", F.try_element_at(weight, ones(F.col("code")) + 1)).filter(kinds >= 3).filter("weight is not null")


def choose(spark: SparkSession, most: int = 500, seed: int = 1, alphabet: str = "1234", size: int = 6) -> list[str]:
    """At most `most` eligible codes, no two of which differ in a single sign, drawn in proportion to their weights. The words are len(alphabet) ** size, and gathered on the driver."""
    rows = sorted(map(tuple, eligible(words(spark, alphabet, size)).collect()))
    draw = np.random.default_rng(seed).exponential(size=len(rows)) / np.array([w for _, w in rows], float).reshape(-1)
    taken: list[str] = []
    seen: set[tuple[int, str]] = set()  # a taken code without one of its signs: what a code one sign away would leave, too
    for k in np.argsort(draw).tolist():
        code = rows[k][0]
        holes = {(j, code[:j] + code[j + 1 :]) for j in range(len(code))}
        if len(taken) < most and not holes & seen:
            taken.append(code)
            seen |= holes
    return taken
