"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions alone.

A mask picks five tokens out of eight neighbours and ignores the other positions; the masked tokens of every window of a
document and of a benchmark item are hashed, equal hashes are joined, and around each hit document and item are compared
position by position on the hit's diagonal. A document is contaminated where a window of `span` item tokens agrees with it in
at least `percent` of the positions (the whole item, if it is shorter).

Either default mask finds every window of 13 tokens with up to two substitutions, wherever they are; so at 80 percent no
window is missed. Shorter items are cut into one piece more than substitutions are allowed, so that one piece is intact, and
pieces are seeds like masks; so these are exact, down to items of one token. Tokens are runs of letters and digits of the lower-cased text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, named, salted_join, stored

# Positions that a mask looks at.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
#: Up to so many benchmark seeds are broadcast; beyond it both sides are shuffled. Likewise items, and the rows of lines to compare.
BROADCAST_SEEDS, BROADCAST_ITEMS, BROADCAST_LINES = 1_000_000, 50_000, 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(h: str, mask: tuple[int, ...]) -> Column:
    """The masked hashes of all windows of an array of token hashes, by window; of one shorter than the mask, none."""
    span = mask[-1] + 1
    at = F.sequence(F.lit(1), F.size(h) - span + 1)
    return F.when(F.size(h) >= span, F.transform(at, lambda i: F.xxhash64(F.lit(span * 100 + mask[min(2, span - 1)]), *[F.element_at(h, i + o) for o in mask]))).otherwise(F.array().cast("array<long>"))


def seeds(hashed: DataFrame, key: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """hashed (key, h) -> (key, pos, seed), one row for each mask and window."""
    per_mask = hashed.select(key, F.explode(F.array(*[_seeds("h", m) for m in masks])).alias("of_mask"))
    return per_mask.select(key, F.posexplode("of_mask").alias("pos", "seed"))


def pieces(n: int, percent: int) -> list[tuple[int, int]]:
    """(from, to) of the pieces of an item of n tokens: one of them is intact wherever at least `percent` of the tokens agree."""
    k = max(1, n - max(0, -(-n * percent // 100)) + 1)
    k = min(k, n)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def _item_seeds(items: DataFrame, span: int, percent: int, masks: tuple[tuple[int, ...], ...]) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(item_id, pos, seed) of all items, and the masks of the pieces of items shorter than span."""
    out, more = seeds(items.filter(F.size("h") >= span), "item_id", masks), set()
    for (n,) in items.select(F.size("h")).distinct().filter(F.col("size(h)").between(1, span - 1)).collect():  # fewer than span rows
        for a, b in pieces(n, percent):
            mask = tuple(range(b - a))
            more.add(mask)
            out = out.unionByName(items.filter(F.size("h") == n).withColumn("piece", F.slice("h", a + 1, b - a)).select("item_id", F.lit(a).alias("pos"), F.explode(_seeds("piece", mask)).alias("seed")))
    return out, sorted(more)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_LINES else rows


def contaminated(docs: DataFrame, bench: DataFrame, span: int = 13, percent: int = 80, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, matched, compared, item_tokens): each document and item that overlap, once, at the best window.

    doc_start and item_start number tokens from 0. Null texts count as empty; items without a token never match. Rows that share a doc_id (or item_id) are each compared and reported under it
    together; null ids are dropped. Other columns are ignored. An empty side gives an empty result.
    """
    items = stored(bench.select("item_id", tokens(F.col("text")).alias("h")).filter("item_id is not null").distinct(), "items")
    of_items, short = _item_seeds(items, span, percent, masks)
    item_seeds = stored(of_items.select("seed", "item_id", F.col("pos").alias("item_pos")).distinct(), "seeds")
    of_docs = seeds(docs.filter("doc_id is not null").select("doc_id", tokens(F.col("text")).alias("h")), "doc_id", (*masks, *short))
    if item_seeds.count() <= BROADCAST_SEEDS:
        hits = of_docs.join(F.broadcast(item_seeds), "seed")
    else:  # both sides are shuffled; a seed that very many documents have, such as a common passage, is split
        met = stored(of_docs.join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "met")
        of_seed = item_seeds.groupBy("seed").agg(F.collect_list(F.struct("item_id", "item_pos")).alias("places"))
        hits = salted_join(met, of_seed, "seed", F.col("doc_id"), stored(hot_keys(met, "seed", met.count()), "hot")).select("doc_id", "pos", F.explode("places").alias("p")).select("doc_id", "pos", "p.*")
    lines = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).count()
    n_items = items.count()
    sized, some = items.select("item_id", F.col("h").alias("item")), lambda x: F.broadcast(x) if n_items <= BROADCAST_ITEMS else x
    lines = stored(lines.join(some(items.select("item_id", F.size("h").alias("item_n"))), "item_id").select("doc_id", "item_id", "diagonal", "item_n"), "lines")
    # Only documents with a hit are read again, and of each one only the stretch that a line compares goes on.
    again = docs.select("doc_id", "text").join(_few(lines.select("doc_id").distinct()), "doc_id", "left_semi")
    cut = again.select("doc_id", tokens(F.col("text")).alias("h")).join(_few(lines), "doc_id")
    begin = F.greatest(F.col("diagonal"), F.lit(0))
    cut = cut.select("doc_id", "item_id", "diagonal", begin.alias("doc_from"), F.greatest(-F.col("diagonal"), F.lit(0)).alias("item_from"), F.slice("h", begin + 1, F.col("item_n")).alias("h"), F.size("h").alias("doc_n"))
    cut = cut.join(some(sized), "item_id")
    length = F.least(F.col("doc_n") - F.col("doc_from"), F.size("item") - F.col("item_from"))
    cut = cut.withColumns({"n": length, "item_tokens": F.size("item"), "window": F.least(F.lit(span), F.size("item"))}).filter("n >= window")
    same = F.zip_with(F.slice("h", 1, F.col("n")), F.slice("item", F.col("item_from") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    cut = cut.withColumn("same", same).drop("h", "item")
    window = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("window") + 1), lambda i: F.struct(F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda a, x: a + x).alias("matched"), (-i).alias("at")))
    best = cut.withColumn("best", F.array_max(window)).filter(F.col("best.matched") * 100 >= F.col("window") * percent)
    out = best.select("doc_id", "item_id", F.struct(F.col("best.matched").alias("matched"), (-(F.col("doc_from") - F.col("best.at") - 1)).alias("at"), (F.col("item_from") - F.col("best.at") - 1).alias("item_start"), F.col("window").alias("compared"), "item_tokens").alias("b"))
    top = out.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return top.select("doc_id", "item_id", (-F.col("b.at")).cast("long").alias("doc_start"), F.col("b.item_start").cast("long").alias("item_start"), F.col("b.matched").cast("long").alias("matched"), F.col("b.compared").cast("long").alias("compared"), F.col("b.item_tokens").cast("long").alias("item_tokens"))


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, span: int = 13, percent: int = 80) -> DataFrame:
    """The rows of docs that overlap no benchmark item."""
    gone = contaminated(docs, bench, span, percent).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs))
