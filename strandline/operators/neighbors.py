"""Sequence neighbourhoods: all words within d edits (or substitutions) of a query."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame

ALPHABET = "ACGT"


def edits(word: str, d: int, indel: bool = True) -> Iterator[str]:
    """Words within d edits of word, each edit moving on to the right, some of them repeatedly.

    The order (at each place: leave out, keep, substitute, insert before) matters only where a cap cuts the enumeration.
    """
    todo = [(word, 0, d)]
    while todo:
        s, at, left = todo.pop()
        if at == len(s):
            if left < d:
                yield s
            continue
        later = [(s[:at] + s[at + 1 :], at, left - 1)] if left and indel else []
        later.append((s, at + 1, left))
        if left:
            later += [(s[:at] + b + s[at + 1 :], at + 1, left - 1) for b in ALPHABET if b != s[at]]
            if indel:
                later += [(s[:at] + b + s[at:], at + 1, left - 1) for b in ALPHABET]
        todo.extend(reversed(later))


def minimal(words: set[str]) -> set[str]:
    """The words that contain no other one."""
    kept: set[str] = set()
    sizes: list[int] = []
    for w in sorted(words, key=len):
        if not any(w[i : i + n] in kept for n in sizes for i in range(len(w) - n + 1)):
            kept.add(w)
            if len(w) not in sizes:
                sizes.append(len(w))
    return kept


def neighborhood(word: str, d: int, indel: bool = True, cap: int | None = None) -> list[str]:
    """The neighbourhood in byte order: with indels its substring-minimal words, else all words within d substitutions (the word too).

    With a cap, enumeration ends once the set has that many members, as it stands then.
    """
    if cap is None:
        every = {word, *edits(word, d, indel)} if d else {word}
        return sorted(minimal(every) if indel else every)
    first = list(islice(edits(word, d, indel), cap)) if d else []
    if len(first) < cap and len(every := {word, *first}) < cap:  # never cut
        return sorted(minimal(every) if indel else every)
    have = {word}
    if d and len(have) < cap:
        for w in edits(word, d, indel):
            if not indel:
                have.add(w)
            elif not any(x in w for x in have):
                have = {x for x in have if w not in x}
                have.add(w)
            if len(have) >= cap:
                break
    return sorted(have)


def neighbor_table(queries: DataFrame, d: int, indel: bool = True, cap: int | None = 10_000) -> DataFrame:
    """queries (query_id, strand, seq) -> (query_id, strand, seq, neighbor, capped)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, s, q in zip(b["query_id"], b["strand"], b["seq"], strict=True):
                ns = neighborhood(q, d, indel, cap)
                rows += [(i, s, q, n, cap is not None and len(ns) >= cap) for n in ns]
            yield pd.DataFrame(rows, columns=["query_id", "strand", "seq", "neighbor", "capped"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "strand", "seq").mapInPandas(run, f"query_id {kind}, strand string, seq string, neighbor string, capped boolean")
