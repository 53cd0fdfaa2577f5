"""FASTA: genomes, queries, primers, probe targets and barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Up to so many record numbers are broadcast.
BROADCAST_RECORDS = 500_000


def head_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(b & 255 for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def is_gzip(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b"


def check_gzip(spark: SparkSession, path: str) -> None:
    """A genome to be indexed must be compressed; so its name and its bytes must say."""
    if not is_gzip(head_bytes(spark, path, 2)):
        raise ValueError(f"{path} is not compressed; please compress the genome with bgzip")
    if not path.endswith((".gz", ".bgz")):
        raise ValueError(f"{path} is compressed, but its name does not end in .gz, by which it is read")


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(record, name, seq) in file order; name is the whole header line. Line breaks (and \\r) inside a record are dropped, records without name or sequence left out.

    The file is split by Spark's reader at each `>` that follows a line break, so one record is one row and a `>` inside a header
    stays; .gz is read by its extension.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("record", F.monotonically_increasing_id())
    raw = raw.withColumn("value", F.regexp_replace("value", "^>", ""))  # a file's first record has no line break before it
    name = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    seq = F.regexp_replace(body, r"\s", "")
    return raw.select("record", name.alias("name"), (F.upper(seq) if upper else seq).alias("seq")).filter((F.col("name") != "") & (F.col("seq") != ""))


def is_fasta(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a header."""
    head = spark.read.text(path).head()
    return head is not None and head[0].startswith(">")


def check_fasta(spark: SparkSession, path: str) -> None:
    if not is_fasta(spark, path):
        raise ValueError(f"{path} is not a FASTA file")


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, chrom, seq): chromosomes by first word of their header, numbered in file order. Chromosomes are few; their numbering is over names alone."""
    fa = read_fasta(spark, path).withColumn("chrom", F.split("name", r"\s")[0])
    ids = fa.select("record").withColumn("chrom_id", F.row_number().over(Window.orderBy("record")) - 1)
    few = ids.count() <= BROADCAST_RECORDS
    return fa.join(F.broadcast(ids) if few else ids, "record").select("chrom_id", "chrom", "seq")


def literal_query(spark: SparkSession, seq: str) -> DataFrame:
    return spark.createDataFrame([(0, None, seq)], "query_id long, name string, seq string")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    check_fasta(spark, path)
    return read_fasta(spark, path, upper=False).select(F.col("record").alias("query_id"), "name", "seq")


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path).select(F.col("record").alias("primer_id"), "name", "seq")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(chrom_id, chrom, gene_id, symbol, start, end, strand, line, seq): every record is one + region over its whole length, its gene id and symbol its name; a genome and regions at once."""
    fa = read_fasta(spark, path)
    return fa.select(F.col("record").alias("chrom_id"), F.col("name").alias("chrom"), F.col("record").alias("line"), F.col("name").alias("gene_id"), F.col("name").alias("symbol"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), F.lit("+").alias("strand"), "seq")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, code, barcode) of strict two-line records, for a join with genes on their ordinal. Barcode files are small: their lines are numbered in one group."""
    line = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", "\r$", "")).filter("value <> ''")
    n = line.withColumn("n", F.row_number().over(Window.orderBy("at")) - 1).withColumn("ordinal", F.floor(F.col("n") / 2))
    head = n.filter("n % 2 = 0").select("ordinal", F.regexp_replace("value", "^>", "").alias("code"))
    return head.join(n.filter("n % 2 = 1").select("ordinal", F.upper("value").alias("barcode")), "ordinal")
