"""Nucleotide and peptide functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements.
_IUPAC = "acgtumrwsykvhdbn"
_COMPLEMENT = "tgcaakywsrmbdhvn"
# The standard genetic code, for codons of t, c, a, g in that order.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Residue masses in daltons, by one-letter code.
MASS = {"A": 71.08, "R": 156.19, "N": 114.10, "D": 115.09, "C": 103.14, "E": 129.12, "Q": 128.13, "G": 57.05, "H": 137.14, "I": 113.16, "L": 113.16, "K": 128.17, "M": 131.19, "F": 147.18, "P": 97.12, "S": 87.08, "T": 101.10, "W": 186.21, "Y": 163.18, "V": 99.13}
WATER = 18.015
#: Codons of the vertebrate mitochondria that differ from the standard ones.
MITOCHONDRIA = {"aga": "*", "agg": "*", "ata": "M", "tga": "W"}


def codons(changes: dict[str, str] | None = None) -> dict[str, str]:
    table = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("tcag") for j, b in enumerate("tcag") for k, c in enumerate("tcag")}
    return table | (changes or {})


def complement(seq: Column) -> Column:
    return F.translate(F.lower(seq), _IUPAC, _COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def fragment(seq: Column, x1: Column, x2: Column) -> Column:
    """Bases x1 to x2, counted from 1, both included and cut to the sequence; reverse
    complement where x1 > x2."""
    n = F.length(seq)
    lo, hi = F.greatest(F.least(x1, x2), F.lit(1)), F.least(F.greatest(x1, x2), n)
    part = F.when(hi >= lo, seq.substr(lo, hi - lo + 1))
    return F.when(x1 <= x2, part).otherwise(reverse_complement(part))


def translate(seq: Column, table: dict[str, str] | None = None) -> Column:
    """Frame 1 by a genetic code; stop is *, an unknown or partial codon X."""
    code = F.create_map(*[F.lit(x) for kv in (table or codons()).items() for x in kv])
    clean = F.replace(F.lower(seq), F.lit("u"), F.lit("t"))
    n = F.ceil(F.length(clean) / 3).cast("int")
    letters = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(code, clean.substr(i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(seq.isNull(), None).when(n == 0, F.lit("")).otherwise(F.array_join(letters, ""))


def peptide_fragment(pep: Column, x1: Column, x2: Column) -> Column:
    lo, hi = F.greatest(x1, F.lit(1)), F.least(x2, F.length(pep))
    return F.when(hi >= lo, pep.substr(lo, hi - lo + 1))


def gc_percent(seq: Column) -> Column:
    s = F.lower(seq)
    known = F.regexp_count(s, F.lit("[acgtu]"))
    return F.try_divide(100.0 * F.regexp_count(s, F.lit("[gc]")), known)


def melting_point(seq: Column) -> Column:
    """Wallace's rule under 14 bases, else the GC-content formula."""
    s = F.lower(seq)
    gc, n = F.regexp_count(s, F.lit("[gc]")), F.length(s)
    return F.when(n < 14, 2.0 * (n - gc) + 4.0 * gc).otherwise(64.9 + 41.0 * (gc - 16.4) / n)


def peptide_weight(pep: Column) -> Column:
    mass = F.create_map(*[F.lit(x) for kv in MASS.items() for x in kv])
    residues = F.split(F.upper(pep), "")
    total = F.aggregate(residues, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(mass, x), F.lit(0.0)))
    return F.when(F.length(pep) > 0, total + WATER)


def entropy(seq: Column) -> Column:
    """Shannon entropy of the neighbouring base pairs, in bits."""
    s = F.lower(seq)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: s.substr(i, F.lit(2)))
    kinds = F.array_distinct(pairs)
    n = F.size(pairs)
    share = F.transform(kinds, lambda k: F.size(F.filter(pairs, lambda x: x == k)) / n)
    return F.when(F.length(s) > 1, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)))
