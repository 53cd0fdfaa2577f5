"""MinHash near-duplicate detection by fast similarity sketching.

A sketch has t coordinates. Round i throws every shingle at a bin: in the first t rounds the bin is a hash of the shingle, in
the next t rounds it is i - t, so every coordinate of a non-empty set fills for sure; a bin keeps the least (round, value).
Long texts fill all bins in the first round, so the work is about one hash a shingle, and the number of equal coordinates of
two sketches is concentrated about t times their similarity.

Bands of sketch rows give candidates; links are confirmed on the full shingle sets. Texts with equal sets collapse to one
representative first. Within a bucket, all members are compared with its centre (a star). Buckets whose members are then still
in different components compare them across components in blocks of bounded size: no link of a bucket is given up, and
copies in a component are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import HOT_KEYS, HOT_ROWS, SLICE, byte_slices, hot_keys, named, release_memory, salted_join, small_batches, stored
from .components import components

ROWS = 4
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-5
#: Shingles and members in one side of a block when members of a bucket are compared across components.
BLOCK, BLOCK_ROWS = 500_000, 256
#: Up to so many ids are broadcast to pick the texts whose full sets are needed; beyond it the texts are joined.
BROADCAST_IDS = 1_000_000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _seeds(t: int) -> np.ndarray:
    return np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """t coordinates (uint32) of a non-empty set of 64-bit hashes; rounds run in growing blocks until every bin is filled."""
    none, low = np.iinfo(np.uint64).max, np.uint64(0xFFFFFFFF)
    seeds, out, done, block = _seeds(t), np.full(t, none, np.uint64), 0, 1
    while done < t and out.max() == none:
        rounds = np.arange(done, min(t, done + block), dtype=np.uint64)
        x = wordhash.mix(s[None, :] + seeds[done : done + len(rounds), None])
        bins = ((x >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((x & low) | (rounds[:, None] << np.uint64(32))).ravel())
        done, block = done + len(rounds), max(3, min(block * 2, 1 + 65536 // len(s)))
    rest = np.flatnonzero(out == none)
    if len(rest):
        x = wordhash.mix(s[None, :] + seeds[t + rest, None])
        out[rest] = (x & low).min(1) | ((t + rest).astype(np.uint64) << np.uint64(32))
    return (wordhash.mix(out) >> np.uint64(32)).astype(np.uint32)


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    return wordhash.shingles(*wordhash.words(texts), k)


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch, bands) of each row; digest names the set, empty sets have null digest and no bands."""
    b, t = bands_for(threshold), bands_for(threshold) * ROWS
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.array([wordhash.word_hash(f"band{j}") for j in range(b)], np.uint64)
        mult = np.array([wordhash.word_hash(f"row{j}") | 1 for j in range(ROWS)], np.uint64)
        for whole in batches:
            for part in byte_slices(whole, 1, SLICE):
                sets = _sets(part.column(1), k)
                digest, sk, bands = [], [], []
                for s in sets:
                    if len(s):
                        x = sketch(s, t)
                        digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        sk.append(x.tobytes())
                        bands.append(wordhash.mix((x.reshape(b, ROWS).astype(np.uint64) * mult).sum(1, dtype=np.uint64) + seeds).view(np.int64))
                    else:
                        digest.append(None)
                        sk.append(None)
                        bands.append(np.empty(0, np.int64))
                flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
                cut = np.concatenate(([0], np.cumsum([len(x) for x in bands]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sk, pa.binary()), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], schema=pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))]))
        release_memory()

    return docs.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, k: int) -> DataFrame:
    """(doc_id, s): the full shingle sets of the given ids."""
    ids = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in byte_slices(whole, 1, SLICE):
                sets = [s.view(np.int64) for s in _sets(part.column(1), k)]
                cut = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets)))], names=["doc_id", "s"])
        release_memory()

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s array<long>")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    ids = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "ids")
    sets = _full_sets(docs, ids, ids.count(), k)
    a, b = sets.select(F.col("doc_id").alias("u"), F.col("s").alias("a")), sets.select(F.col("doc_id").alias("v"), F.col("s").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    # A centre may have very many pairs; each v has few.
    met = salted_join(pairs.join(b, "v"), a, "u", F.col("v"), stored(hot_keys(pairs, "u", pairs.count()), "hot"))
    return met.filter(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def _across(members: DataFrame, t: int, percent: int) -> DataFrame:
    """Links (u, v) between members of a bucket that are in different components, as many as join what can be joined.

    members: (bucket, band, few, many, of_many, id, root, n_shingles, sketch, s). The members of a bucket's largest component
    needn't meet one another: they are dealt to `many` blocks by a hash of the id, all other members to `few`; every block of
    others meets every block of the largest component and every block of others in a group of its own. There, members are compared
    across components: sketches first (a pair at the threshold falls short with a chance of about one in a million), then full
    sets. A link merges two components, whose members needn't meet any more; so a group returns fewer links than it has members.
    A pair that shares several bands is compared in the first.
    """
    p = percent / 100
    least = max(1, math.floor(t * p - 5.2 * math.sqrt(t * p * (1 - p))))
    h = F.xxhash64("id")
    block = F.when(F.col("of_many"), F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c).cast("int") - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    numbered = members.withColumn("block", block)
    me = F.col("block")
    # kind 0: others with others, i <= j; kind 1: others (side 0) with the largest component (side 1).
    with_others = F.transform(upto("few"), lambda o: cell(0, F.least(me, o), F.greatest(me, o), (me > o).cast("int")))
    with_many = F.transform(upto("many"), lambda o: cell(1, me, o, F.lit(0)))
    of_many = F.transform(upto("few"), lambda o: cell(1, o, me, F.lit(1)))
    dealt = numbered.withColumn("to", F.explode(F.when(F.col("of_many"), of_many).otherwise(F.concat(with_others, with_many))))
    dealt = dealt.select("bucket", "to.kind", "to.i", "to.j", "to.side", "band", "id", "root", "n_shingles", "sketch", "s")

    def compare(g: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        band, ids, n, sk = int(g["band"][0]), g["id"], g["n_shingles"], g["sketch"]
        alone = g["kind"][0] == 0 and g["i"][0] == g["j"][0]
        left = np.flatnonzero(g["side"] == 0)
        right = left if alone else np.flatnonzero(g["side"] == 1)
        comp = g["root"].copy()
        full: dict[int, frozenset] = {}

        def shingles(k: int) -> frozenset:
            if k not in full:
                full[k] = frozenset(g["s"][k].tolist())
            return full[k]

        found = []
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[y > x] if alone else y
            if not len(y):
                continue
            equal = sk[y] == sk[x]
            near = equal.sum(1)
            first = equal.reshape(len(y), -1, ROWS).all(2).argmax(1)
            good = (near >= least) & (first == band)
            y, near = y[good], near[good]
            for k in y[np.argsort(-near, kind="stable")].tolist():
                if comp[k] != comp[x]:
                    both = len(shingles(x) & shingles(k))
                    if 100 * both >= percent * (int(n[x]) + int(n[k]) - both):
                        found.append((int(ids[x]), int(ids[k])))
                        comp[comp == comp[k]] = comp[x]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive one after another; a group that a batch cuts is carried over."""
        names = ["bucket", "kind", "i", "j", "side", "band", "id", "root", "n_shingles"]
        carry: dict[str, np.ndarray] = {}
        for batch in _with_end(batches):
            if batch is not None:
                if not len(batch):
                    continue
                new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
                new["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(len(batch), t)
                new["s"] = np.empty(len(batch), object)
                cut, flat = batch.column("s").offsets.to_numpy(), batch.column("s").values.to_numpy()
                for k in range(len(batch)):
                    new["s"][k] = flat[cut[k] : cut[k + 1]]
                carry = {c: np.concatenate([carry[c], new[c]]) for c in new} if carry else new
            if not carry:
                continue
            step = np.zeros(len(carry["id"]) - 1, bool)
            for c in ("bucket", "kind", "i", "j"):
                step |= carry[c][1:] != carry[c][:-1]
            cuts = [0, *(np.flatnonzero(step) + 1).tolist()] + ([len(carry["id"])] if batch is None else [])
            found = [x for p, q in zip(cuts, cuts[1:]) for x in compare({c: x[p:q] for c, x in carry.items()})]
            carry = {c: x[cuts[-1] :] for c, x in carry.items()} if batch is not None else {}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
        release_memory()

    return dealt.repartition("bucket", "kind", "i", "j").sortWithinPartitions("bucket", "kind", "i", "j").mapInArrow(run, "u long, v long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    A text's set holds its distinct k-word shingles (words as in `wordhash`; fewer words: the whole sequence as one); two
    texts are linked where 100 * intersection >= percent * union of their full sets. component_id is the smallest doc_id that
    links reach. Null, empty and blank texts have n_shingles 0 and stand alone. Rows that share a doc_id count as separate
    texts with one name: the id is linked to whatever any of them is linked to. Rows without id stand alone, component null,
    kept true. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    t = bands_for(percent / 100) * ROWS
    signed = stored(signatures(docs, k, percent / 100), "signed")
    full = signed.filter("digest is not null and doc_id is not null")
    # Equal sets: one representative for each; the rest hangs on it.
    reps = stored(full.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "reps")
    member = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key")).select("id", "n_shingles", "band", F.xxhash64("band", "key").alias("bucket"))
    wide = stored(member.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "wide")
    rows = wide.agg(F.coalesce(F.sum("m"), F.lit(0))).head()[0]
    hot = stored(_parts(wide, rows), "hot")
    filled = stored(salted_join(member, wide, "bucket", F.col("id"), hot), "filled")
    # A bucket's centre is its member that meets the most others in all its buckets: what the others were copied from, if it is there.
    met = filled.groupBy("id").agg(F.sum("m").alias("met"))
    centre = filled.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("id"), "n_shingles")).alias("c"))
    centre = centre.select("bucket", (-F.col("c.id")).alias("u"), F.col("c.n_shingles").alias("n_u"))
    filled = stored(salted_join(filled.drop("m"), centre, "bucket", F.col("id"), hot), "centred")
    star = filled.filter("id <> u").filter(100 * F.least("n_shingles", "n_u") >= percent * F.greatest("n_shingles", "n_u")).select("u", F.col("id").alias("v")).distinct()
    links = stored(_verified(docs, stored(star, "star"), k, percent), "links")
    root = components(links)
    # The centre of a bucket has met all others; only these can still miss one another.
    now = stored(filled.filter("id <> u").join(root, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", "n_shingles", F.coalesce("root", "id").alias("root")), "now")
    parts = now.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("sum"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "sum")).alias("top"), F.sum("n").alias("n"), F.sum("sum").alias("sum")).filter("top.n < n")
    blocks = lambda n, total: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(total / BLOCK)).cast("long")
    open_ = open_.select("bucket", F.col("top.root").alias("largest"), blocks(F.col("n") - F.col("top.n"), F.col("sum") - F.col("top.sum")).alias("few"), blocks(F.col("top.n"), F.col("top.sum")).alias("many"))
    left = stored(salted_join(now, open_, "bucket", F.col("id"), hot).withColumn("of_many", F.col("root") == F.col("largest")).drop("largest"), "open")
    ids = stored(left.select(F.col("id").alias("doc_id")).distinct(), "ids")
    sets = _full_sets(docs, ids, ids.count(), k)
    more = stored(_across(left.join(reps.select("id", "sketch"), "id").join(sets.withColumnRenamed("doc_id", "id"), "id"), t, percent), "across")
    # An id whose rows have several sets links these.
    twice = full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").select("doc_id")
    own = full.select("doc_id", "digest").distinct().join(twice, "doc_id", "left_semi").join(reps.select("digest", "id"), "digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    root = components(links.union(more).union(own))
    # Copies take their representative's component; a set that very many rows have is split.
    total = reps.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0]
    named_ = reps.join(root, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("component_id"))
    copies = stored(_parts(reps.select("digest", F.col("copies").alias("m")), total), "hot")
    out = salted_join(signed.select("doc_id", "n_shingles", "digest"), named_, "digest", F.col("doc_id"), copies, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _parts(counted: DataFrame, total: int) -> DataFrame:
    """`hot_keys` of (key, m) whose rows are counted already."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    return counted.select(counted.columns[0], F.ceil(F.col("m") / most).cast("int").alias("__parts")).filter("__parts > 1")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for those whose component has a smaller doc_id; of rows that repeat a doc_id, all stay or go."""
    gone = near_duplicates(docs, k, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs))
