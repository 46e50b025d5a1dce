"""Column encoders for clinical texts. Every one gives null for what it doesn't know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.session import try_number


def binary_flag(c: str, yes: tuple[str, ...] = ("positive", "pos", "yes", "true", "y", "dead", "deceased"), no: tuple[str, ...] = ("negative", "neg", "no", "false", "n", "alive", "living")) -> Column:
    """1 / 0 from two vocabularies; numbers count as 1 from 0.5 on."""
    t, x = F.lower(F.trim(F.col(c))), try_number(c)
    return F.when(t.isin(*yes), 1).when(t.isin(*no), 0).when(x >= 0.5, 1).when(x < 0.5, 0)


def response_flag(c: str) -> Column:
    """pCR 1, RD 0."""
    t = F.upper(F.trim(F.col(c)))
    return F.when(t == "PCR", 1).when(t == "RD", 0)


def receptor_flag(c: str) -> Column:
    """P... 1, N... 0."""
    t = F.upper(F.trim(F.col(c)))
    return F.when(t.isin("P", "POS", "POSITIVE", "1"), 1).when(t.isin("N", "NEG", "NEGATIVE", "0"), 0)


def stage_digit(c: str, prefix: str) -> Column:
    """The first digit of a code that starts with the prefix (T1c gives 1)."""
    t = F.upper(F.trim(F.col(c)))
    return F.when(t.startswith(prefix.upper()), F.nullif(F.regexp_extract(t, "[0-9]", 0), F.lit("")).try_cast("int"))


def stage_group(c: str) -> Column:
    """I, II(A-B), III(A-C), IV as 1 to 4."""
    t = F.upper(F.trim(F.col(c)))
    return F.when(t == "I", 1).when(t.isin("II", "IIA", "IIB"), 2).when(t.isin("III", "IIIA", "IIIB", "IIIC"), 3).when(t == "IV", 4)


def intrinsic_label(c: str, keep_unknown: bool = False) -> Column:
    """Basal, Her2, LumA, LumB, Normal in upper case; unknown labels pass if kept, else null."""
    t = F.upper(F.trim(F.col(c)))
    known = F.when(t.isin("BASAL", "BASAL-LIKE"), "BASAL").when(t.isin("HER2", "HER2-ENRICHED"), "HER2").when(t.isin("LUMA", "LUMINAL A"), "LUMA").when(t.isin("LUMB", "LUMINAL B"), "LUMB").when(t.isin("NORMAL", "NORMAL-LIKE"), "NORMAL")
    return F.coalesce(known, t) if keep_unknown else known


def barcode_patient(c: str, prefix: str = "TCGA") -> Column:
    """Dots to hyphens, upper case; ids with the prefix keep their first three parts."""
    t = F.upper(F.translate(F.trim(F.col(c)), ".", "-"))
    return F.when(t.startswith(prefix), F.array_join(F.slice(F.split(t, "-"), 1, 3), "-")).otherwise(t)


def first_symbol(c: str) -> Column:
    """The gene symbol before ``///``; null for blanks, NAN and ---."""
    t = F.upper(F.trim(F.split_part(F.col(c), F.lit("///"), F.lit(1))))
    return F.when(~t.isin("", "NAN", "---"), t)
