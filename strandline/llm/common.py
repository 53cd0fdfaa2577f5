"""Helpers that the training-data operators share: table access, bounded Arrow batches, splits and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch; a batch of long texts is cut by bytes, so that memory doesn't grow with row length.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: Bytes of text that are hashed at once; working arrays take about fifty times as much.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, in rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column, mod: int) -> Column:
    """True where crc32 of the id as text leaves remainder 0; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod) == 0


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares. Only a session in one process (tests) may do without the setting; elsewhere a local folder would lose data between executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/strandline"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def quoted(name: str) -> Column:
    """A column by a name that may hold dots and backticks."""
    return F.col(f"`{name.replace('`', '``')}`")


def named(docs: DataFrame) -> list[Column]:
    """The columns of docs, by names that may hold dots and backticks."""
    return [quoted(c) for c in docs.columns]


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot from so many rows on; beyond this, from a share of all rows, so that hot keys stay few enough to be broadcast.
HOT_ROWS, HOT_KEYS = 64, 4096


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, __parts) of the keys that have more than max(HOT_ROWS, total / HOT_KEYS) of the rows: fewer than HOT_KEYS; into how many parts to split each."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    return rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("__parts")).filter("__parts > 1")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key): the rows of a hot key in left are dealt, by a hash of spread, to as many parts as it has, and right's row is copied to each."""
    one = F.coalesce("__parts", F.lit(1))
    a = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), one).cast("int")).drop("__parts")
    b = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__parts")
    return a.join(b, [key, "__salt"], how).drop("__salt")


def release_memory() -> None:
    """Give freed memory back to the system at a task's end, as Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def byte_slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the given text or binary column holds about `most` bytes in a piece (one row at least)."""
    col = batch.column(column)
    if not len(batch):
        return
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // max(1, most)
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
        yield batch.slice(int(a), int(b - a))


def with_columns(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.Array], list]], most: int = 4 << 20) -> DataFrame:
    """Append columns that Python computes from whole texts.

    make() runs once in a task and gives a function from an Arrow text array to the new columns. Input columns named as a
    new one (in any case) are replaced. Any other column passes through untouched.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    src = df.select(*[quoted(c).alias(f"__{k}") for k, c in enumerate(keep)], quoted(text).cast("string").alias("__text"))
    schema = T.StructType([f for f in df.schema.fields if f.name in keep] + list(fields))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for whole in batches:
            for part in byte_slices(whole, n, most):
                fn = fn or make()
                cols = fn(part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], names=[*keep, *[f.name for f in fields]])
        fn = None
        release_memory()

    return src.mapInArrow(run, schema)
