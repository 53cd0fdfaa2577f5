"""Padlock probes: two adjacent arms that tile gene regions, sound by composition and melting temperature, unique in the genome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import gc_fraction, revcomp_acgt
from ..functions.thermo import tm_perfect
from ..lineage import stored
from ..operators import intervals, kmers, neighbors, words
from .config import PadlockOptions


def regions(exons: DataFrame) -> DataFrame:
    """exons (chrom_id, gene_id, start, end, strand, line) -> flattened regions with the strand of the gene's first line on that chromosome."""
    strand = exons.groupBy("chrom_id", "gene_id").agg(F.min_by("strand", "line").alias("strand"))
    return intervals.flatten(exons.select("chrom_id", "gene_id", "start", "end"), ["chrom_id", "gene_id"]).join(strand, ["chrom_id", "gene_id"])


def missing_genes(wanted: DataFrame, genes: DataFrame) -> DataFrame:
    return wanted.join(genes, "gene_id", "left_anti")


def tiles(genome: DataFrame, region: DataFrame, arm: int) -> DataFrame:
    """region (chrom_id, gene_id, start, end, strand) -> its columns with k, arm1, arm2 of every tile, in transcript orientation; k counts from the transcript's side.

    A region meets the chunks in which its tiles begin, never a whole chromosome.
    """
    size = 2 * arm
    last = F.col("end") - size
    cut = region.filter(F.col("end") - F.col("start") >= size).withColumn("chunk_start", F.explode(F.sequence(kmers.chunk_of(F.col("start")), kmers.chunk_of(last), F.lit(kmers.CORE).cast("long"))))
    met = cut.join(kmers.chunks(genome, size).select("chrom_id", "chunk_start", "from", "piece", "chrom_len"), ["chrom_id", "chunk_start"])
    begin, stop = F.greatest(F.col("start"), F.col("chunk_start")), F.least(last, F.col("chunk_start") + kmers.CORE - 1, F.col("chrom_len") - size)
    at = met.filter(begin <= stop).withColumn("__p", F.explode(F.sequence(begin, stop)))
    left, right = (F.upper(kmers.text_at(F.col("piece"), F.col("__p") - F.col("from") + x, arm)) for x in (0, arm))
    minus = F.col("strand") == "-"
    k = F.when(minus, last - F.col("__p")).otherwise(F.col("__p") - F.col("start")).cast("int")
    return at.select(*region.columns, k.alias("k"), F.when(minus, revcomp_acgt(right)).otherwise(left).alias("arm1"), F.when(minus, revcomp_acgt(left)).otherwise(right).alias("arm2"))


def gc_in_range(seq: Column, o: PadlockOptions) -> Column:
    gc = gc_fraction(seq)
    return (gc >= o.gc_min) & (gc <= o.gc_max)


def _kept(t: DataFrame, good: Column, *made: str) -> DataFrame:
    """Rows of t for which good holds. The columns made stand in an array that is taken apart again: so the planner can't put their formulas into the filter and work each out several times."""
    if not made:
        return t.filter(good)
    rest = [c for c in t.columns if c not in made]
    whole = t.select(*rest, F.explode(F.array(F.struct(*made))).alias("__m")).select(*rest, "__m.*")
    return whole.filter(good)


def arm_filters(t: DataFrame, o: PadlockOptions) -> DataFrame:
    """Tiles whose arms pass composition, then melting temperature (at most 93 + GC - 675 / arm, GC as a fraction) and its difference."""
    t = t.filter(gc_in_range(F.col("arm1"), o) & gc_in_range(F.col("arm2"), o))
    t = t.withColumns({"arm1_gc": gc_fraction(F.col("arm1")), "arm2_gc": gc_fraction(F.col("arm2")), "arm1_tm": tm_perfect(F.col("arm1"), o.ions), "arm2_tm": tm_perfect(F.col("arm2"), o.ions)})
    most = lambda gc: 93 + F.col(gc) - 675.0 / o.arm
    return _kept(t, (F.col("arm1_tm") <= most("arm1_gc")) & (F.col("arm2_tm") <= most("arm2_gc")) & (F.abs(F.col("arm1_tm") - F.col("arm2_tm")) <= o.tm_diff), "arm1_gc", "arm2_gc", "arm1_tm", "arm2_tm")


def probe_filters(t: DataFrame, o: PadlockOptions) -> DataFrame:
    t = t.withColumn("probe", F.concat("arm1", "arm2")).withColumn("probe_gc", gc_fraction(F.col("probe"))).filter(gc_in_range(F.col("probe"), o))
    t = t.withColumn("probe_tm", tm_perfect(F.col("probe"), o.ions))
    low = 81.5 + F.col("probe_gc") - 675.0 / (2 * o.arm)
    return _kept(t, (F.col("probe_tm") >= low) & (F.col("probe_tm") <= low + 10), "probe_tm")


def occurrences(t: DataFrame, genome: DataFrame, o: PadlockOptions, d: int) -> DataFrame:
    """(arm, n): places in the genome of the words of each distinct arm, itself or its neighbourhood, on both strands (a word of both strands twice). Words of different lengths are counted length by length, as numbers: arms with a melting temperature hold A, C, G, T only."""
    spark = genome.sparkSession
    arms = stored(t.select(F.col("arm1").alias("arm")).union(t.select("arm2")).distinct(), "arms")
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = arms.withColumn("strand", F.lit("+")).withColumn("seq", F.col("arm")).unionByName(arms.withColumn("strand", F.lit("-")).withColumn("seq", revcomp_acgt(F.col("arm")))).repartition(parts)
    reach = 0 if o.hamming or not d else d
    if not d or o.hamming and words.near_size(o.arm, d) < min(o.max_neighborhood, words.MOST_NEAR):
        near = {o.arm: (both.select("arm", F.col("seq").alias("kmer")), d)}
    else:
        table = stored(neighbors.neighbor_table(both.withColumnRenamed("arm", "query_id"), d, not o.hamming, o.max_neighborhood).select(F.col("query_id").alias("arm"), F.col("neighbor").alias("kmer")), "neighbors")
        near = {k: (table.filter(F.length("kmer") == k), 0) for k in range(o.arm - reach, o.arm + reach + 1)}
    met = []
    for k, (kmer, within) in near.items():
        if k > words.LONGEST:  # too long for numbers
            of_k = kmer if not within else neighbors.neighbor_table(kmer.select(F.col("arm").alias("query_id"), F.lit("").alias("strand"), F.col("kmer").alias("seq")), within, False, None).select(F.col("query_id").alias("arm"), F.col("neighbor").alias("kmer"))
            met.append(of_k.join(kmers.count_patterns(kmers.kmers(genome, k), of_k), "kmer").select("arm", "n"))
            continue
        of_k = words.near_words(kmer.select("arm", words.number(F.col("kmer")).alias("own")), k, within)
        met.append(of_k.select("arm", "word").join(words.counts(genome, k, words.marks(of_k)), "word").select("arm", "n"))
    total = reduce(DataFrame.unionByName, met).groupBy("arm").agg(F.sum("n").cast("long").alias("n"))
    return arms.join(total, "arm", "left").select("arm", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def unique(t: DataFrame, genome: DataFrame, o: PadlockOptions, d: int) -> DataFrame:
    """Tiles whose arms (one of them, for probe_unique) occur no more often than a true target does: once exactly; once in the Hamming and 2d times in the edit neighbourhood; never for absent targets."""
    most = (0 if o.fasta_target and o.absent else 1) if not d else 0 if o.fasta_target and o.absent else 1 if o.hamming else 2 * d
    t = stored(t, "tiles")  # read three times below
    n = stored(occurrences(t, genome, o, d), "counts")
    t = t.join(n.select(F.col("arm").alias("arm1"), F.col("n").alias("n1")), "arm1").join(n.select(F.col("arm").alias("arm2"), F.col("n").alias("n2")), "arm2")
    good = (F.col("n1") <= most) | (F.col("n2") <= most) if o.probe_unique else (F.col("n1") <= most) & (F.col("n2") <= most)
    return t.filter(good).drop("n1", "n2")


def assembled(arm1: Column, arm2: Column, barcode: Column, o: PadlockOptions) -> Column:
    return F.concat(revcomp_acgt(arm1), F.lit(o.spacer_left), F.lit(o.anchor), barcode, F.lit(o.spacer_right), revcomp_acgt(arm2))


def spread(t: DataFrame, keys: list[str], step: int) -> DataFrame:
    """From left to right, the tiles of each group that begin at least `step` after the last one taken. The fold runs over a group's places only; the other columns are joined back."""
    fold = F.aggregate(
        F.array_sort(F.collect_set("k")),
        F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("taken")),
        lambda s, k: F.when(s["last"].isNull() | (k >= s["last"] + step), F.struct(k.alias("last"), F.concat(s["taken"], F.array(k)).alias("taken"))).otherwise(s),
        lambda s: s["taken"],
    )
    taken = t.groupBy(*keys).agg(fold.alias("ks")).select(*keys, F.explode("ks").alias("k"))
    return t.join(taken, [*keys, "k"], "left_semi")


def padlock(source: DataFrame, region: DataFrame, barcodes: DataFrame, o: PadlockOptions = PadlockOptions(), genome: DataFrame | None = None) -> DataFrame:
    """source (chrom_id, seq) that regions lie on, the genome itself or target sequences with a genome (chrom_id, seq) to be unique in; region as `regions` gives it, barcodes (gene_id, barcode) -> probes with their figures; position 1-based.

    A gene without barcode has twenty N, and so no probe passes.
    """
    genome = source if genome is None else genome
    t = probe_filters(arm_filters(tiles(source, region, o.arm), o), o)
    t = unique(t, genome, o, 0)
    if o.distance:
        t = unique(t, genome, o, o.distance)
    t = t.join(barcodes, "gene_id", "left").withColumn("barcode", F.coalesce("barcode", F.lit("N" * 20)))
    t = t.withColumn("padlock", assembled(F.col("arm1"), F.col("arm2"), F.col("barcode"), o)).filter(gc_in_range(F.col("padlock"), o))
    t = t.withColumns({"barcode_gc": gc_fraction(F.col("barcode")), "barcode_tm": tm_perfect(F.col("barcode"), o.ions)})
    t = t.withColumn("position", F.when(F.col("strand") == "-", F.col("end") - F.col("k") - 2 * o.arm + 1).otherwise(F.col("start") + F.col("k") + 1))
    return t if o.overlapping else spread(t, ["chrom_id", "gene_id", "start"], 2 * o.arm)
