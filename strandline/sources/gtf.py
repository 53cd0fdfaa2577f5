"""Gene annotation (GTF): one feature a line, tab-separated, 1-based inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def attribute(attributes: Column, key: str) -> Column:
    """The value of a key in `key "value"; ...` (null without it); a value ends at its first blank."""
    value = F.regexp_extract(attributes, rf'(?:^|;)\s*{key} "?([^";\s]*)', 1)
    return F.when(value != "", value)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order as `line`; comments and lines without nine fields are left out. Compressed files are read by their extension."""
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = text.filter(F.size(f) >= 9).select("line", *[f[k].alias(n) for k, n in enumerate(SCHEMA.replace(",", "").split()[::2])])
    return rows.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def exons(gtf: DataFrame, chromosomes: DataFrame, id_attribute: str = "gene_id", feature: str = "exon", protein_coding: bool = False, genes: DataFrame | None = None) -> DataFrame:
    """gtf -> (chrom_id, gene_id, symbol, coding, start, end, strand, line), half-open, of the wanted feature on known chromosomes (chrom_id, chrom).

    genes (gene_id) restricts the genes. A start of 0 or a start beyond the end is an error.
    """
    a = F.col("attributes")
    rows = gtf.filter(F.col("feature") == feature).join(chromosomes.select("chrom_id", "chrom"), "chrom")
    if protein_coding:
        rows = rows.filter(attribute(a, "transcript_biotype") == "protein_coding")
    rows = rows.withColumn("gene_id", attribute(a, id_attribute)).filter("gene_id is not null")
    if genes is not None:
        rows = rows.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    sound = F.when(F.col("start") < 1, F.raise_error(F.lit("Annotation error: a feature begins before base 1."))).when(F.col("start") > F.col("end"), F.raise_error(F.lit("Annotation error: a feature ends before its start."))).otherwise(F.col("start") - 1)
    return rows.select("chrom_id", "gene_id", F.coalesce(attribute(a, "gene_name"), F.lit("n.a.")).alias("symbol"), (attribute(a, "gene_biotype") == "protein_coding").alias("coding"), sound.alias("start"), "end", "strand", "line")


def gene_table(exon_rows: DataFrame) -> DataFrame:
    """(gene_id, symbol, coding, ordinal): genes numbered by first appearance. The order is over genes, which are few."""
    from pyspark.sql import Window

    first = exon_rows.groupBy("gene_id").agg(F.min_by("symbol", "line").alias("symbol"), F.min_by("coding", "line").alias("coding"), F.min("line").alias("first"))
    return first.withColumn("ordinal", F.row_number().over(Window.orderBy("first")) - 1).drop("first")
