"""Options of the commands, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.thermo import Ions


@dataclass(frozen=True)
class HuntOptions:
    distance: int = 1
    hamming: bool = False
    forward_only: bool = False
    max_matches: int | None = 1000
    max_neighborhood: int = 10_000
    compat: bool = False


@dataclass(frozen=True)
class SearchOptions:
    kmer: int = 15
    distance: int = 1
    hamming: bool = False
    max_matches: int | None = 10_000
    max_neighborhood: int = 10_000
    prune: int | None = None
    cut_temp: float = 45.0
    max_product: int = 15_000
    cutoff_penalty: float = -1.0
    penalty_tm_diff: float = 0.6
    penalty_tm_mismatch: float = 0.4
    penalty_length: float = 0.001
    parameters: str | None = None
    ions: Ions = field(default_factory=Ions)


@dataclass(frozen=True)
class PadlockOptions:
    anchor: str = "TGCGTCTATTTAGTGGAGCC"
    spacer_left: str = "TCCTC"
    spacer_right: str = "TCTTT"
    distance: int = 1
    hamming: bool = False
    arm: int = 20
    tm_diff: float = 2.0
    gc_min: float = 0.4
    gc_max: float = 0.6
    probe_unique: bool = False
    absent: bool = False
    fasta_target: bool = False
    overlapping: bool = False
    attribute: str = "gene_id"
    feature: str = "exon"
    protein_coding: bool = False
    max_neighborhood: int = 10_000
    ions: Ions = field(default_factory=Ions)
