"""Scalar functions on nucleotide text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements (U pairs as T does).
IUPAC, COMPLEMENT = "ACGTURYSWKMBVDHN", "TGCAAYRSWMKVBHDN"


def revcomp(seq: Column, keep_case: bool = False) -> Column:
    """Reverse complement; what isn't an IUPAC code becomes N. Upper-cased, unless case is kept."""
    if keep_case:
        both, paired = IUPAC + IUPAC.lower(), COMPLEMENT + COMPLEMENT.lower()
        return F.reverse(F.translate(F.regexp_replace(seq, f"[^{both}]", "N"), both, paired))
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT))


def revcomp_acgt(seq: Column) -> Column:
    """Reverse complement of text that holds A, C, G, T and N only."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc_fraction(seq: Column) -> Column:
    """Share of C and G; -1 for empty text and text with an N."""
    up = F.upper(seq)
    return F.when((F.length(seq) == 0) | F.contains(up, F.lit("N")), F.lit(-1.0)).otherwise((F.length(seq) - F.length(F.translate(seq, "CGcg", ""))) / F.length(seq))


def clean_dna(seq: Column) -> Column:
    """Upper case, with N for everything but A, C, G, T."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def non_dna_count(seq: Column) -> Column:
    """How many characters `clean_dna` replaces; each is worth one warning."""
    return F.length(F.regexp_replace(F.upper(seq), "[ACGT]", ""))


def has_n(seq: Column) -> Column:
    return F.contains(F.upper(seq), F.lit("N"))


def self_complementary(seq: Column) -> Column:
    """Even length and equal to its reverse complement."""
    return (F.length(seq) % 2 == 0) & (seq == revcomp_acgt(seq))


def nucleotide_length(aligned: Column) -> Column:
    return F.length(F.replace(aligned, F.lit("-"), F.lit("")))


def trailing_gap(aligned: Column) -> Column:
    """Columns at the end that are gaps."""
    return F.length(aligned) - F.length(F.regexp_replace(aligned, "-+$", ""))


def base_code(base: Column) -> Column:
    """A, C, G, T (or their digits) as 0..3, everything else 4."""
    at = F.greatest(F.instr(F.lit("ACGT"), F.upper(base)), F.instr(F.lit("0123"), base))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(4)


#: Bases in one word of `substitutions`.
WORD = 15


def packed(seq: Column, words: int) -> Column:
    """words numbers, each with four bits for each of WORD bases: one of them set for A, C, G, T, none for anything else."""
    bits = F.translate(F.translate(seq, "ACGT", "1248"), "BDEFHIJKLMNOPQRSUVWXYZ", "0" * 22)
    return F.array(*[F.coalesce(F.conv(F.substring(bits, 1 + WORD * k, WORD), 16, 10).cast("long"), F.lit(0)) for k in range(words)])


def substitutions(a: Column, b: Column, longest: int) -> Column:
    """Places at which two upper-case texts of one length (at most `longest`) differ, where one of them holds A, C, G, T only."""
    n = -(-longest // WORD)
    x, y = packed(a, n), packed(b, n)
    same = F.lit(0)
    for k in range(n):
        same = same + F.bit_count(x[k].bitwiseAND(y[k]))
    return (F.length(a) - same).cast("int")


def ucsc_database(genome_file: Column) -> Column:
    """The browser database that a genome file's name points to."""
    # Marks in file names and the databases that they name, in order of precedence.
    marks = (
        ("GRCh37", "hg19"),
        ("GRCh38", "hg38"),
        ("GRCz10", "danRer10"),
        ("WBcel235", "ce11"),
        ("BDGP6", "dm6"),
        ("GRCm38", "mm10"),
        ("MEDAKA1", "oryLat2"),
        ("TAIR10", "hub_1936559_araTha1"),
        ("Saccharomyces_cerevisiae.R64", "sacCer3"),
    )
    out = F.lit("Unknown")
    for mark, db in reversed(marks):
        out = F.when(F.contains(genome_file, F.lit(mark)), F.lit(db)).otherwise(out)
    return out


def ucsc_link(db: Column, chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("https://genome.ucsc.edu/cgi-bin/hgTracks?db="), db, F.lit("&position="), chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
