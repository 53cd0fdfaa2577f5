"""Command line: index, hunt, search, padlock and version."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def _ions(p: argparse.ArgumentParser) -> None:
    p.add_argument("--monovalent", type=float, default=50.0, help="mM")
    p.add_argument("--divalent", type=float, default=1.5, help="mM")
    p.add_argument("--dntp", type=float, default=0.6, help="mM")
    p.add_argument("--dna", type=float, default=50.0, help="nM of annealing oligos")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline")
    p.add_argument("--version", "-v", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    sub.add_parser("version", help="print the version")
    i = sub.add_parser("index", help="write the k-mer table of a genome")
    i.add_argument("genome", help="compressed FASTA file")
    i.add_argument("--kmer", "-k", type=int, default=8, help="length of the k-mers; a search uses the table where its seeds are as long")
    i.add_argument("--name", "-o", default="genome_kmers")
    h = sub.add_parser("hunt", help="find a sequence, or all of a FASTA file")
    h.add_argument("query")
    h.add_argument("-g", "--genome", required=True)
    h.add_argument("-d", "--distance", type=int, default=1)
    h.add_argument("-m", "--maxmatches", type=int, default=1000)
    h.add_argument("-x", "--maxNeighborhood", type=int, default=10_000)
    h.add_argument("-n", "--hamming", action="store_true")
    h.add_argument("-f", "--forward", action="store_true")
    h.add_argument("-o", "--outfile", required=True)
    h.add_argument("--index", help="a table that index wrote")
    s = sub.add_parser("search", help="in-silico PCR with the primers of a FASTA file")
    s.add_argument("primers")
    s.add_argument("-g", "--genome", required=True)
    s.add_argument("-i", "--config", help="directory of nearest-neighbour parameters")
    s.add_argument("-o", "--outfile", required=True)
    s.add_argument("-k", "--kmer", type=int, default=15)
    s.add_argument("-m", "--maxmatches", type=int, default=10_000)
    s.add_argument("-x", "--maxNeighborhood", type=int, default=10_000)
    s.add_argument("-d", "--distance", type=int, default=1)
    s.add_argument("-q", "--pruneprimer", type=int)
    s.add_argument("-n", "--hamming", action="store_true")
    s.add_argument("-c", "--cutTemp", type=float, default=45.0)
    s.add_argument("-l", "--maxProdSize", type=int, default=15_000)
    s.add_argument("--cutoffPenalty", type=float, default=-1.0)
    s.add_argument("--penaltyTmDiff", type=float, default=0.6)
    s.add_argument("--penaltyTmMismatch", type=float, default=0.4)
    s.add_argument("--penaltyLength", type=float, default=0.001)
    s.add_argument("--index", help="a table that index wrote")
    _ions(s)
    k = sub.add_parser("padlock", help="design probes for genes")
    k.add_argument("gene", help="an id, a file of ids, all, or a FASTA file of targets")
    k.add_argument("-g", "--genome", required=True)
    k.add_argument("-t", "--gtf", required=True)
    k.add_argument("-b", "--barcodes", required=True)
    k.add_argument("-d", "--distance", type=int, default=1)
    k.add_argument("-o", "--outfile", default="out.tsv")
    k.add_argument("-j", "--json")
    k.add_argument("-e", "--absent", action="store_true", help="FASTA targets are not in the genome")
    k.add_argument("-n", "--hamming", action="store_true")
    k.add_argument("-a", "--anchor", default="TGCGTCTATTTAGTGGAGCC")
    k.add_argument("-l", "--spacerleft", default="TCCTC")
    k.add_argument("-r", "--spacerright", default="TCTTT")
    k.add_argument("-m", "--armlen", type=int, default=20)
    k.add_argument("-z", "--tmdiff", type=float, default=2.0)
    k.add_argument("--gcmin", type=float, default=0.4)
    k.add_argument("--gcmax", type=float, default=0.6)
    k.add_argument("-u", "--attribute", default="gene_id")
    k.add_argument("-f", "--feature", default="exon")
    k.add_argument("-p", "--probe", action="store_true", help="only one arm needs to be unique")
    k.add_argument("-v", "--overlapping", action="store_true")
    _ions(k)
    return p


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    if not a.command:
        p.print_usage(sys.stderr)
        return 1
    if a.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("strandline").getOrCreate()
    if not _exists(spark, a.genome):
        print(f"Error: there is no genome {a.genome}", file=sys.stderr)
        return 1
    try:
        return {"index": _index, "hunt": _hunt, "search": _search, "padlock": _padlock}[a.command](spark, a)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def _index(spark, a: argparse.Namespace) -> int:
    from .operators import kmers
    from .sources import fasta

    fasta.check_gzip(spark, a.genome)
    kmers.build_index(fasta.read_genome(spark, a.genome), a.kmer, a.name)
    return 0


def _table(spark, a: argparse.Namespace):
    from .operators import kmers

    return kmers.open_index(spark, a.index) if a.index else None


def _hunt(spark, a: argparse.Namespace) -> int:
    from . import sinks
    from .plans.config import HuntOptions
    from .plans.hunt import hunt
    from .sources import fasta

    genome = fasta.read_genome(spark, a.genome)
    queries = fasta.read_queries(spark, a.query) if _exists(spark, a.query) else fasta.literal_query(spark, a.query)
    o = HuntOptions(a.distance, a.hamming, a.forward, a.maxmatches, a.maxNeighborhood)
    hits, said = hunt(genome, queries, o, _table(spark, a))
    sinks.write_documents(sinks.hunt_documents(queries, hits, said, genome, o, {"version": __version__, "genome": a.genome, "outfile": a.outfile}), a.outfile)
    return 0


def _search(spark, a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from . import sinks
    from .functions.thermo import Ions
    from .lineage import stored
    from .plans import search
    from .plans.config import SearchOptions
    from .sources import fasta, tables

    if a.config:
        tables.check_parameters(a.config)
    genome = fasta.read_genome(spark, a.genome)
    fasta.check_fasta(spark, a.primers)
    primers = fasta.read_primers(spark, a.primers)
    ions = Ions(a.monovalent, a.divalent, a.dntp, a.dna)
    o = SearchOptions(a.kmer, a.distance, a.hamming, a.maxmatches, a.maxNeighborhood, a.pruneprimer, a.cutTemp, a.maxProdSize, a.cutoffPenalty, a.penaltyTmDiff, a.penaltyTmMismatch, a.penaltyLength, a.config, ions)
    sites, products, said = search.search(genome, primers, o, _table(spark, a))
    sites = stored(sites, "sites")
    none = search.products(sites.limit(0), o).withColumn("seq", F.lit(""))
    rows, made = sinks.search_tables(sites, none if products is None else products, primers, genome)
    sinks.write_document(sinks.search_document(rows, made, said, o, {"version": __version__, "genome": a.genome, "outfile": a.outfile}), a.outfile)
    return 0


def _padlock(spark, a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from . import sinks
    from .functions import dna
    from .functions.thermo import Ions
    from .lineage import stored
    from .plans import padlock
    from .plans.config import PadlockOptions
    from .sources import fasta, gtf, tables

    genome = fasta.read_genome(spark, a.genome)
    file = _exists(spark, a.gene)
    target = file and fasta.is_fasta(spark, a.gene)
    o = PadlockOptions(a.anchor, a.spacerleft, a.spacerright, a.distance, a.hamming, a.armlen, a.tmdiff, a.gcmin, a.gcmax, a.probe, a.absent, target, a.overlapping, a.attribute, a.feature, ions=Ions(a.monovalent, a.divalent, a.dntp, a.dna))
    if target:
        exons = fasta.read_targets(spark, a.gene).withColumn("coding", F.lit(True))
        source = exons.select("chrom_id", "chrom", "seq")
    else:
        wanted = None if a.gene == "all" else tables.read_gene_list(spark, a.gene) if file else spark.createDataFrame([(a.gene,)], "gene_id string")
        source = genome
        exons = gtf.exons(gtf.read_gtf(spark, a.gtf), genome, a.attribute, a.feature, genes=wanted)
        if wanted is not None and (lost := padlock.missing_genes(wanted, exons).limit(1).head()):
            print(f"Error: there is no gene {lost[0]} in {a.gtf}", file=sys.stderr)
            return 1
    genes = gtf.gene_table(exons)
    codes = fasta.read_barcodes(spark, a.barcodes)
    genes = stored(genes.join(codes, "ordinal", "left"), "genes")
    if (short := genes.filter("barcode is null").count()):
        print(f"Warning: {short} genes have no barcode, and so no probe", file=sys.stderr)
    probes = padlock.padlock(source, padlock.regions(exons), genes.filter("barcode is not null").select("gene_id", "barcode"), o, genome)
    table = stored(sinks.padlock_table(probes, genes, source, o, spark.range(1).select(dna.ucsc_database(F.lit(a.genome))).head()[0]), "table")
    sinks.write_tsv(sinks.padlock_text(table), a.outfile)
    if a.json:
        meta = {"version": __version__, "genome": a.genome, "infile": a.gene, "outfile": a.outfile, "barcodes": a.barcodes, "gtf": a.gtf, "jsonfile": a.json}
        sinks.write_document(sinks.padlock_document(table, o, meta), a.json)
    return 0
