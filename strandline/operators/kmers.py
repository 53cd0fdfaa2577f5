"""Positional k-mers: chunking of long sequences, the persistent index, counting and locating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases that a chunk owns. Substrings are taken of binary values, in constant time.
CORE = 8192
#: Up to so many patterns are broadcast to the genome's k-mers; more are joined by a shuffle on the k-mer.
BROADCAST_PATTERNS = 500_000


def chunks(genome: DataFrame, overlap: int, core: int = CORE) -> DataFrame:
    """genome (chrom_id, seq) -> (chrom_id, chrom_len, chunk_start, own, piece).

    piece is binary and begins `overlap` bases before chunk_start (less at the chromosome's start; from says where) and ends
    as many after the owned part, so any window that begins in the owned part is whole, with context on both sides. Chunks are
    dealt anew, so that a few long chromosomes, or one file that can't be split, keep all tasks busy.
    """
    n = F.length("seq").cast("long")
    cut = genome.filter(F.length("seq") > 0).select("chrom_id", n.alias("chrom_len"), F.col("seq").cast("binary").alias("bin"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(core).cast("long"))).alias("chunk_start"))
    start = F.greatest(F.col("chunk_start") - overlap, F.lit(0))
    stop = F.least(F.col("chunk_start") + core + overlap, F.col("chrom_len"))
    out = cut.select("chrom_id", "chrom_len", "chunk_start", start.alias("from"), F.least(F.lit(core).cast("long"), F.col("chrom_len") - F.col("chunk_start")).alias("own"), F.substring("bin", (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))
    spark = genome.sparkSession
    return out.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chrom_id", "chunk_start")


def text_at(piece: Column, at: Column, length: Column | int) -> Column:
    """length bases of a binary piece from 0-based `at`."""
    return F.substring(piece, (at + 1).cast("int"), (length if isinstance(length, Column) else F.lit(length)).cast("int")).cast("string")


def kmers(genome: DataFrame, k: int, core: int = CORE) -> DataFrame:
    """(kmer, chrom_id, pos): every window of k bases, 0-based. Sequences shorter than k have none."""
    return windows(chunks(genome, k, core), k).select("kmer", "chrom_id", "pos")


def windows(pieces: DataFrame, k: int) -> DataFrame:
    """chunks -> their columns with pos and kmer of each window that begins in the owned part and fits the chromosome."""
    last = F.least(F.col("own"), F.col("chrom_len") - F.col("chunk_start") - k + 1)
    at = pieces.filter(last > 0).select("*", F.explode(F.sequence(F.col("chunk_start"), F.col("chunk_start") + last - 1)).alias("pos"))
    return at.withColumn("kmer", text_at(F.col("piece"), F.col("pos") - F.col("from"), k))


def chunk_of(pos: Column, core: int = CORE) -> Column:
    """The chunk that owns a place."""
    return F.floor(pos / core).cast("long") * core


def build_index(genome: DataFrame, k: int, name: str, buckets: int = 64) -> None:
    """Write the k-mer table bucketed and sorted by k-mer: later joins on it don't shuffle it, and a filter on k-mers reads few buckets."""
    kmers(genome, k).write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").format("parquet").saveAsTable(name)


def open_index(spark: SparkSession, name: str) -> DataFrame:
    """(kmer, chrom_id, pos); a table that isn't there is an error."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"There is no index {name}; make it with the index command.")
    return spark.table(name)


def index_width(index: DataFrame) -> int:
    """The k of an index, 0 of an empty one."""
    first = index.select(F.length("kmer")).head()
    return first[0] if first else 0


def few(patterns: DataFrame) -> DataFrame:
    """patterns, to be broadcast while they are few."""
    return F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns


def locate(index: DataFrame, patterns: DataFrame, by: str = "kmer") -> DataFrame:
    """All positions of each distinct pattern: index (kmer, chrom_id, pos) joined with patterns (kmer, ...)."""
    return index.join(few(patterns), by)


def count_patterns(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kmer, n) of each distinct pattern, 0 for absent ones. Occurrences are counted on the map side first, so a repeat of any size is a row for each task."""
    wanted = patterns.select("kmer").distinct()
    have = index.join(few(wanted), "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("n"))
    return wanted.join(have, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
