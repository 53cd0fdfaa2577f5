"""Nearest-neighbour melting temperatures of perfect duplexes, as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import self_complementary

# Published unified nearest-neighbour parameters (Allawi and SantaLucia 1997), 5'->3' dinucleotide on its
# complement: enthalpy in cal/mol, entropy in cal/(K mol).
STACK = {
    "AA": (-7900.0, -22.2), "AC": (-8400.0, -22.4), "AG": (-7800.0, -21.0), "AT": (-7200.0, -20.4),
    "CA": (-8500.0, -22.7), "CC": (-8000.0, -19.9), "CG": (-10600.0, -27.2), "CT": (-7800.0, -21.0),
    "GA": (-8200.0, -22.2), "GC": (-9800.0, -24.4), "GG": (-8000.0, -19.9), "GT": (-8400.0, -22.4),
    "TA": (-7200.0, -21.3), "TC": (-8200.0, -22.2), "TG": (-8500.0, -22.7), "TT": (-7900.0, -22.2),
}
INIT_H, INIT_S, AT_H, AT_S, NO_AT_S, GAS, ZERO_C = 200.0, -5.7, 2200.0, 6.9, 1e-11, 1.9872, 273.15


@dataclass(frozen=True)
class Ions:
    """Monovalent and divalent salt and dNTP in mM, oligo in nM."""

    monovalent: float = 50.0
    divalent: float = 1.5
    dntp: float = 0.6
    dna: float = 50.0

    def salt(self) -> float:
        """The entropy correction of one base pair step."""
        dntp = self.dntp if self.divalent > 0 else self.divalent
        return 0.368 * math.log((self.monovalent + 120 * math.sqrt(max(0.0, self.divalent - dntp))) / 1000)


def salt_correction(mv: Column, dv: Column, dntp: Column) -> Column:
    free = F.when(dv <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dv - dntp))
    return 0.368 * F.ln((mv + 120 * F.sqrt(free)) / 1000)


def _stacked(seq: Column, which: int) -> Column:
    """The sum over all dinucleotides of text of A, C, G, T, by plain string functions, which stay in generated code.

    Two different bases can't overlap themselves, so leaving them out counts them. A base's own pairs are its occurrences before
    the last place less its pairs with other bases: so each other pair counts with the difference to its first base's own pair.
    """
    n = F.length(seq)
    tenths = {k: round(v[which] * 10) for k, v in STACK.items()}  # whole numbers, so that sums are exact
    total = F.lit(0.0)
    for a in "ACGT":
        total = total + (n - F.length(F.translate(seq, a, "")) - F.endswith(seq, F.lit(a)).cast("int")) * F.lit(tenths[a + a])
        for b in "ACGT":
            if a != b:
                total = total + (n - F.length(F.replace(seq, F.lit(a + b), F.lit("")))) * F.lit((tenths[a + b] - tenths[a + a]) / 2)
    return total / 10


def duplex_enthalpy(seq: Column) -> Column:
    ends = [F.when(F.substring(seq, k, 1).isin("A", "T"), AT_H).otherwise(0.0) for k in (1, -1)]
    return INIT_H + _stacked(seq, 0) + ends[0] + ends[1]


def duplex_entropy(seq: Column) -> Column:
    ends = [F.when(F.substring(seq, k, 1).isin("A", "T"), AT_S).otherwise(NO_AT_S) for k in (1, -1)]
    return INIT_S + _stacked(seq, 1) + ends[0] + ends[1]


def tm_perfect(seq: Column, ions: Ions = Ions()) -> Column:
    """Melting temperature (Celsius) of an oligo of A, C, G, T on its reverse complement; null if it is shorter than 2 or holds another letter."""
    conc = F.when(self_complementary(seq), GAS * math.log(ions.dna / 1e9)).otherwise(GAS * math.log(ions.dna / 4e9))
    tm = duplex_enthalpy(seq) / (duplex_entropy(seq) + (F.length(seq) - 1) * F.lit(ions.salt()) + conc) - ZERO_C
    return F.when((F.length(seq) >= 2) & (F.translate(seq, "ACGT", "") == ""), tm)
