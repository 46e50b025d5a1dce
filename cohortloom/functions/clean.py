"""Rules shared by the cleaning operators: what counts as missing, ids, light category codes. All JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts (lower case, without brackets) that say that there is no value.
NO_VALUE = (
    "", "na", "n/a", "n.a.", "n.a", "nan", "nil", "none", "null", "none given", "missing", "unknown", "unk", "not recorded", "not assessed",
    "not available", "not known", "not given", "not done", "nicht erfasst", "unbekannt", "keine angabe", "k.a.", "n.d.", "nd", "tbd", "pending", "?", "??", "-", "--", "---", ".", "..",
)

#: Any blank, no-break spaces too, as a character class.
BLANK = r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: str | Column) -> Column:
    """Outer blanks off, inner runs of blanks to one space."""
    return F.trim(F.regexp_replace(_c(c), BLANK + "+", " "))


def no_value_text(c: str | Column) -> Column:
    """True for NULL and for texts that say that there is no value."""
    c = _c(c)
    return c.isNull() | F.lower(F.trim(F.regexp_replace(squash(c), r"^[\[(<]+|[\])>]+$", ""))).isin(*NO_VALUE)


def no_value_number(c: str | Column, lo: float, hi: float) -> Column:
    """True for NULL, NaN and numbers outside [lo, hi]."""
    c = _c(c)
    return c.isNull() | F.isnan(c) | (c < lo) | (c > hi)


def patient_key(c: str | Column) -> Column:
    """Canonical patient id ``ABC-D4-01234567``: the first three parts, upper case, joined by hyphens.

    Parts may be parted by hyphens, dots, underscores or blanks; what follows the third part names an aliquot and is
    dropped. NULL for anything that isn't such an id (placeholders)."""
    parts = rf"^{BLANK}*([A-Za-z]+){BLANK}*[-._ ]{BLANK}*([A-Za-z][A-Za-z0-9]*){BLANK}*[-._ ]{BLANK}*([0-9]+)(?:{BLANK}*[-._ ].*)?{BLANK}*$"
    out = F.upper(F.regexp_replace(_c(c), parts, "$1-$2-$3"))
    return F.when(F.regexp_like(_c(c), F.lit(parts)), out)


def block_key(c: str | Column) -> Column:
    """Block id without case and outer blanks; NULL for placeholders: a block id has letters and a number other than 0."""
    out = F.upper(squash(c))
    return F.when(F.regexp_like(out, F.lit(r"[A-Z]")) & F.regexp_like(out, F.lit(r"[1-9]")) & ~no_value_text(c), out)


def cohort_key(c: str | Column) -> Column:
    """Cohort name in one spelling: lower case, outer blanks off, hyphens and blanks to underscores."""
    return F.regexp_replace(F.lower(squash(c)), r"[-\s]+", "_")


def stage_code(c: str | Column) -> Column:
    """Light stage code 1-4 from Roman numerals, digits or English number words with sub-stage letters; NULL otherwise."""
    t = F.lower(squash(c))
    hit = F.regexp_extract(t, r"(?:^|[^a-z0-9])p?(iv|i{1,3}|[1-4]|one|two|three|four)[abc]?(?:$|[^a-z0-9])", 1)
    return F.when(hit.isin("i", "1", "one"), 1).when(hit.isin("ii", "2", "two"), 2).when(hit.isin("iii", "3", "three"), 3).when(hit.isin("iv", "4", "four"), 4)


def intrinsic_code(c: str | Column) -> Column:
    """Light intrinsic-subtype code (BASAL, HER2, LUMA, LUMB, NORMAL); OTHER for the rest, NULL for missing."""
    t = F.regexp_replace(F.lower(squash(c)), r"[^a-z0-9]", "")
    return (
        F.when(no_value_text(c), None).when(t.contains("basal"), "BASAL").when(t.contains("her2") | t.contains("erbb2"), "HER2").when(t.contains("normal"), "NORMAL")
        .when(t.contains("lum"), F.when(t.contains("luma") | t.contains("luminala") | t.startswith("alum"), "LUMA").when(t.contains("lumb") | t.contains("luminalb") | t.startswith("blum"), "LUMB").otherwise("OTHER"))
        .otherwise("OTHER")
    )


def receptor_code(c: str | Column) -> Column:
    """Light receptor code (POS, NEG); OTHER for the rest, NULL for missing."""
    t = F.regexp_replace(F.lower(squash(c)), r"^er\b[\s:]*(status)?\s*", "")
    return F.when(no_value_text(c), None).when(F.regexp_like(t, F.lit(r"^(pos|p$|\+|1|yes|expr)")), "POS").when(F.regexp_like(t, F.lit(r"^(neg|n$|-$|0|no)")), "NEG").otherwise("OTHER")
