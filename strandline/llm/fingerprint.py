"""Canonical exact fingerprints of documents, in DataFrame functions alone.

Canonical form: Unicode compatibility composition (NFKC), full case folding, white space runs to one blank, trimmed. Normaliser
and case folding are the ICU functions that Spark ships, called by the SQL function `reflect`. The fingerprint is the hex of
four 64-bit xxhash values of the canonical form under different prefixes. Canonical forms that share all four values are then
compared byte by byte: where a bucket holds different bytes, its fingerprints get a number each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Up to so many hash buckets with several members are broadcast to pick the texts to compare; beyond it they are joined.
BROADCAST_BUCKETS = 500_000
#: Rows of a cell (neighbours in the order of ids), and cells at most: beyond so many rows, cells grow instead.
CELL_ROWS, CELLS = 2048, 32_768


def _icu(cls: str, method: str, text: Column) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding may undo it), white space of any kind to single blanks, trimmed; of a non-null text."""
    composed = _icu("com.ibm.icu.text.Normalizer", "compose", text)
    folded = _icu("com.ibm.icu.text.Normalizer", "compose", _icu("com.ibm.icu.lang.UCharacter", "foldCase", composed))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """Four 64-bit xxhash values as 64 hex digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(k), canon)), 16, "0")) for k in range(4)])


def collisions(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(fp, canon, variant) of the canonical forms that share a hash with another one and don't come first; none, as a rule.

    texts (fp, canon), marks (fp): all fingerprints. Only texts of buckets with several members are compared, and equal ones
    collapse before the shuffle: a group of copies of any size reaches a task as a row for each partition that it comes from.
    """
    many = stored(marks.groupBy("fp").count().filter("count > 1").select("fp"), "buckets")
    many = F.broadcast(many) if many.count() <= BROADCAST_BUCKETS else many
    kinds = texts.join(many, "fp", "left_semi").groupBy("fp", "canon").count()
    return kinds.withColumn("variant", F.row_number().over(Window.partitionBy("fp").orderBy("canon")) - 1).filter("variant > 0").select("fp", "canon", "variant")


def _cell(bounds: list[int]) -> Column:
    """The cell of a row (id, h) among bounds, quantiles of the ids in order: 0 before the first. An id that is several bounds is dealt to as many cells, in the order of h."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # folded into one literal
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    n = len(bounds)

    def before(value: Column, with_equal: bool) -> Column:
        """How many bounds are below value (or equal), by binary search."""
        ok = lambda x: x <= value if with_equal else x < value
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when((i + s <= n) & ok(F.element_at(table, F.least(i + s, F.lit(n)))), i + s).otherwise(i))

    low, high = before(F.col("id"), False), before(F.col("id"), True)
    share = F.col("h") / F.lit(2.0**64) + 0.5
    return F.when(high == low, low).otherwise((low + F.least(F.floor(share * (high - low + 1)), high - low)).cast("int"))


def beside_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, id, text) -> the same with h and next_text, the text of the next row in the order of (id, h, text), by one shuffle of the texts; h is a hash of the text.

    Quantiles of the ids cut the order into cells of about CELL_ROWS rows, however the ids lie. The first row of each cell goes
    to the cell before it too (that of the first cell to the last), where it stands last; so every row finds the next one in
    its own cell. Rows that share id and text stand in one cell.
    """
    docs = docs.withColumn("h", F.xxhash64("text"))
    cells = min(CELLS, -(-docs.count() // CELL_ROWS))
    at = [k / cells for k in range(1, cells)]
    bounds = docs.agg(F.percentile_approx("id", F.split(F.lit(",".join(map(repr, at))), ",").cast("array<double>"), 4 * cells)).head()[0] if at else []
    celled = docs.withColumn("cell", _cell([int(x) for x in bounds or []]))
    # One row for each cell (CELLS at most): its first place in the order, and the cell before it.
    firsts = celled.groupBy("cell").agg(F.min(F.struct("id", "h")).alias("first"))
    order = Window.orderBy("cell")
    last = F.max("cell").over(Window.partitionBy(F.lit(0)))
    back = stored(firsts.withColumn("to", F.coalesce(F.lag("cell").over(order), last)).withColumn("turn", F.when(F.lag("cell").over(order).isNull(), 2).otherwise(1)), "firsts")
    marks = F.broadcast(back.select("cell", F.col("first.id").alias("id"), F.col("first.h").alias("h"), "to", "turn"))
    heads = celled.join(marks, ["cell", "id", "h"]).groupBy("to", "turn", "id", "h").agg(F.min("text").alias("text"))
    both = celled.select("doc_id", "id", "h", "text", "cell", F.lit(0).alias("turn")).unionByName(heads.select("id", "h", "text", F.col("to").alias("cell"), "turn"), allowMissingColumns=True)
    w = Window.partitionBy("cell").orderBy("turn", "id", "h", "text")
    return both.withColumn("next_text", F.lead("text").over(w)).filter("turn = 0").select("doc_id", "id", "h", "text", "next_text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the whole text whose last floor(n_chars / 2) code points give way to as many first ones (all, if there
    are fewer) of the next document in ascending doc_id; the first follows the last. A null text counts as empty. An exact
    fingerprint is alike (1.0) where the canonical bytes are equal, and else not (0.0). Rows that repeat a doc_id follow one
    another in the order of a hash of their texts; a null doc_id comes first. One row alone is its own next. An empty table gives an
    empty result. Where texts of different canonical forms share a hash, an edited text
    of one of these forms has its number too.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), text.alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    met = beside_next(base).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    made = met.withColumns({"canon": canonical(F.col("text")), "edited_canon": canonical(F.col("edited")), "next_canon": canonical(F.col("next_text"))})
    out = stored(
        made.select(
            "doc_id",
            "id",
            "h",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            wide_hash(F.col("canon")).alias("fingerprint"),
            wide_hash(F.col("edited_canon")).alias("edited_fingerprint"),
            (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
            (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
        ),
        "prints",
    )
    canon = base.select("id", canonical(F.col("text")).alias("canon")).withColumn("fp", wide_hash(F.col("canon")))
    other = stored(collisions(canon.select("fp", "canon"), out.select(F.col("fingerprint").alias("fp"))), "collisions")
    if other.count():  # different bytes under one hash: number them
        edited = made.select("id", "h", F.col("edited_canon").alias("canon")).withColumn("fp", wide_hash(F.col("canon")))
        for name, forms, keys in (("fingerprint", canon, ["id"]), ("edited_fingerprint", edited, ["id", "h"])):
            named_ = forms.join(other, ["fp", "canon"]).select(*keys, F.col("fp").alias(name), "variant").distinct()
            out = out.join(named_, [*keys, name], "left").withColumn(name, F.concat_ws("-", name, F.col("variant").cast("string"))).drop("variant")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
