"""Melting temperatures and free energies from nearest-neighbour sums, as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .sequence import _c, clean_dna, reverse_complement

#: Sugimoto et al. 1996, enthalpy (kcal/mol) and entropy (cal/K/mol) by dinucleotide.
SUGIMOTO_1996 = {
    "AA": (-8.0, -21.9), "AC": (-9.4, -25.5), "AG": (-6.6, -16.4), "AT": (-5.6, -15.2),
    "CA": (-8.2, -21.0), "CC": (-10.9, -28.4), "CG": (-11.8, -29.0), "CT": (-6.6, -16.4),
    "GA": (-8.8, -23.5), "GC": (-10.5, -26.4), "GG": (-10.9, -28.4), "GT": (-9.4, -25.5),
    "TA": (-6.6, -18.4), "TC": (-8.8, -23.5), "TG": (-8.2, -21.0), "TT": (-8.0, -21.9),
}
#: SantaLucia 1998, the same units.
SANTALUCIA_1998 = {
    "AA": (-7.9, -22.2), "AC": (-8.4, -22.4), "AG": (-7.8, -21.0), "AT": (-7.2, -20.4),
    "CA": (-8.5, -22.7), "CC": (-8.0, -19.9), "CG": (-10.6, -27.2), "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "GT": (-8.4, -22.4),
    "TA": (-7.2, -21.3), "TC": (-8.2, -22.2), "TG": (-8.5, -22.7), "TT": (-7.9, -22.2),
}
#: SantaLucia and Hicks 2004 differs for AA and TT.
SANTALUCIA_2004 = SANTALUCIA_1998 | {"AA": (-7.6, -21.3), "TT": (-7.6, -21.3)}
#: Free energy at 37 degrees (kcal/mol) of RNA/DNA dinucleotides, read along the DNA.
RNA_DNA_37 = {
    "AA": -0.2, "AC": -1.5, "AG": -0.9, "AT": -1.0, "CA": -1.0, "CC": -2.2, "CG": -1.2, "CT": -1.4,
    "GA": -0.8, "GC": -2.4, "GG": -1.5, "GT": -1.0, "TA": -0.3, "TC": -1.4, "TG": -1.0, "TT": -0.4,
}


def dinucleotide_sums(s: Column, *tables: dict[str, float]) -> list[Column]:
    """Sums of tables' values over a sequence's dinucleotides; others count 0, as does a sequence of one base.

    Bases become numbers and neighbours are looked up in one literal array, so the code does not grow with the tables.
    """
    names = " ACGT"
    table = F.array(*[F.struct(*[F.lit(float(t.get(x + y, 0.0))).alias(f"t{k}") for k, t in enumerate(tables)]) for x in names for y in names])
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit("ACGT"), c) * (F.length(c) == 1).cast("int"))
    n = F.greatest(F.length(s) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda x, y: F.get(table, x * 5 + y))
    zero = F.struct(*[F.lit(0.0).alias(f"t{k}") for k in range(len(tables))])
    total = F.aggregate(pairs, zero, lambda a, x: F.struct(*[(a[f"t{k}"] + x[f"t{k}"]).alias(f"t{k}") for k in range(len(tables))]))
    return [total[f"t{k}"] for k in range(len(tables))]


#: Each byte's base as 1 to 4 (U as T, either case), others 0. Complements make 5.
_BASES = np.zeros(256, np.int64)
for _i, _x in enumerate(("Aa", "Cc", "Gg", "TtUu"), 1):
    _BASES[list(_x.encode())] = _i


def _melting(s: Column | str, table: dict[str, tuple[float, float]], least: int, formula: Callable[..., np.ndarray]) -> Column:
    """``formula`` (h, e, n, at, gc, strong, same) of sequences of A, C, G, T of ``least`` bases or more; null for others.

    h, e: sums of enthalpy and entropy, added place by place; n: length; at, gc: how many end bases are A or T, G or C; strong:
    G and C; same: equal to its reverse complement. Whole batches at once: expressions over letters cost some hundred times that.
    It passes as not deterministic, so that it is made once a row and not again in each filter that reads it.
    """
    values = np.array([[table.get(x + y, (0.0, 0.0))[k] for x in " ACGT" for y in " ACGT"] for k in (0, 1)])

    def melting(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        codes = np.append(_BASES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)], 0)
        n = np.array([len(x) for x in texts], np.int64)
        at = np.cumsum(n) - n
        h, e, strong = np.zeros(n.size), np.zeros(n.size), np.zeros(n.size, np.int64)
        ok, same = n >= least, np.ones(n.size, bool)
        for i in range(n.max(initial=0)):
            rows = np.flatnonzero(n > i)
            here = codes[at[rows] + i]
            ok[rows] &= here > 0
            strong[rows] += (here == 2) | (here == 3)
            same[rows] &= here + codes[at[rows] + n[rows] - 1 - i] == 5
            if i:
                pair = codes[at[rows] + i - 1] * 5 + here
                h[rows] += values[0, pair]
                e[rows] += values[1, pair]
        ends = codes[at], codes[np.maximum(at + n - 1, 0)]
        weak = sum(((x == 1) | (x == 4)).astype(np.float64) for x in ends)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = formula(h, e, n.astype(np.float64), weak, sum(((x == 2) | (x == 3)).astype(np.float64) for x in ends), strong, same)
        return pd.Series(out).where(pd.Series(ok), None)

    return F.pandas_udf(melting, DoubleType()).asNondeterministic()(_c(s))


def tm_primer(s: Column | str, na_mm: float = 50, mg_mm: float = 0, dntp_mm: float = 0.6, nm: float = 50, formamide_m: float = 0) -> Column:
    """SantaLucia 1998 with its salt correction: symmetric sequences lose 1.4 of entropy and count their concentration
    whole, divalent ions count as 120 times the root of what dNTPs leave; formamide by (2.88 - 0.453 GC) a mole."""
    ion = na_mm + 120 * math.sqrt(max(mg_mm - dntp_mm, 0))

    def tm(h, e, n, at, gc, strong, same):
        h, e = h + at * 2.3 + gc * 0.1, e + at * 4.1 + gc * -2.8
        e = e + np.where(same, -1.4, 0.0) + (n - 1) * (0.368 * math.log(ion / 1000))
        rate = np.where(same, math.log(nm / 1e9), math.log(nm / 4e9)) * 1.987
        return h * 1000 / (e + rate) - 273.15 - (2.88 - strong / n * 0.453) * formamide_m

    return _melting(s, SANTALUCIA_1998, 2, tm)


def tm_padlock(s: Column | str, na_mm: float = 50, mg_mm: float = 0, nm: float = 50, formamide_pct: float = 0) -> Column:
    """Sugimoto 1996 sums with one initiation term and a sodium and magnesium term."""
    salt = 16.6 * math.log10(na_mm / 1000 + 3.795 * math.sqrt(mg_mm / 1000))
    return _melting(s, SUGIMOTO_1996, 1, lambda h, e, *_: (h + 0.6) * 1000 / (e - 9.0 + 1.9872 * math.log(nm * 1e-9)) - 273.15 + salt - 0.72 * formamide_pct)


def tm_miner(s: Column | str, na_mm: float = 50, nm: float = 50, formamide_pct: float = 0) -> Column:
    """SantaLucia 1998 with terminal terms and half the strand concentration, rounded to 2 places before formamide."""

    def tm(h, e, n, at, gc, *_):
        h, e = h + at * 2.3 + gc * 0.1, e + at * 4.1 + gc * -2.8
        e = e + (n - 1) * (0.368 * math.log(na_mm / 1000))
        return h * 1000 / (e + 1.987 * math.log(nm / 2 * 1e-9)) - 273.15

    return F.round(_melting(s, SANTALUCIA_1998, 2, tm), 2) - 0.65 * formamide_pct


def tm_merfish(s: Column | str, na_mm: float = 50, nm: float = 50) -> Column:
    """SantaLucia and Hicks 2004 with initiation, a term per terminal A or T, and the whole concentration."""

    def tm(h, e, n, at, *_):
        h, e = h + at * 2.2 + 0.2, e + at * 6.9 - 5.7
        e = e + (n - 1) * (0.368 * math.log(na_mm / 1000))
        return h * 1000 / (e + 1.9872 * math.log(nm * 1e-9)) - 273.15

    return _melting(s, SANTALUCIA_2004, 2, tm)


def rna_dna_37(s: Column | str, of_target: bool = False, salt_m: float = 0.115) -> Column:
    """Free energy of an RNA/DNA hybrid; a target's own sequence is reverse-complemented first. Null below two bases."""
    s = F.translate(F.upper(_c(s)), "U", "T")
    s = F.when(F.length(s) >= 2, reverse_complement(s) if of_target else s)
    return dinucleotide_sums(s, RNA_DNA_37)[0] - (math.log(salt_m) * -0.175 - 0.2)


def tm_difference(columns: list[Column], conditions: list[object]) -> Column:
    """Largest minus smallest temperature; null if one is missing or methods and conditions differ."""
    if len(columns) < 2 or any(c != conditions[0] for c in conditions):
        return F.lit(None).cast("double")
    there = columns[0].isNotNull()
    for c in columns[1:]:
        there = there & c.isNotNull()
    return F.when(there, F.greatest(*columns) - F.least(*columns))


def _closes(s: Column, k: int, loop: int):
    """Of a start: whether the word of k bases there finds its reverse complement behind the loop."""
    return lambda i: F.substring(s, i + (k + loop), F.length(s)).contains(F.reverse(F.translate(F.substring(s, i, F.lit(k)), "ACGT", "TGCA")))


def stem_score(s: Column | str, stem: int = 4, loop: int = 3, most: int = 8) -> Column:
    """A named stand-in for folding energies: the longest stem, of ``stem`` to ``most`` pairs, around a loop; 0 if none.

    A stem is a word whose reverse complement starts at least ``loop`` bases after the word's end.
    """
    s = clean_dna(s)
    out = F.lit(0)
    for k in range(stem, most + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (2 * k + loop) + 1, F.lit(1)))
        has = F.exists(starts, _closes(s, k, loop))
        out = F.when((F.length(s) >= 2 * k + loop) & has, k).otherwise(out)
    return F.when(s.isNotNull(), out)
