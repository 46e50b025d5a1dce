"""Quantities recorded in different units: parse numbers and unit expressions, decide the unit of each value, convert."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.clean import BLANK
from cohortloom.functions.quantity import Unit, parse_unit
from cohortloom.session import stage

#: A number: digits with points or commas inside.
NUMBER = r"[-+]?[0-9](?:[0-9.,]*[0-9])?"

UNIT_TYPE = T.StructType([T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("scale", T.DoubleType()), T.StructField("offset", T.DoubleType()), T.StructField("name", T.StringType())])


@F.pandas_udf(UNIT_TYPE)
def _parsed(text: pd.Series) -> pd.DataFrame:
    found = [parse_unit(t) if isinstance(t, str) else None for t in text]
    return pd.DataFrame({"dims": [list(u.dims) if u else None for u in found], "scale": [u.scale if u else None for u in found], "offset": [u.offset if u else None for u in found], "name": [u.name if u else None for u in found]})


def split_quantity(c: Column) -> tuple[Column, Column]:
    """Number text and unit text of a quantity such as ``~9,0 Monate``, ``months: 43.8`` or ``9 (d)``.

    Both are NULL where the text holds no number or more than one."""
    t = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, BLANK + "+", " ")), r"^ ?(?:[~≈<>=≥≤]|approx\.?|about|ca\.?|circa)+ ?", ""))
    shape = rf"^(?:([^0-9]*?)[: ]*)({NUMBER})([^0-9]*|[^0-9]*\^?-?[0-9][^0-9]*)$"
    number = F.nullif(F.regexp_extract(t, shape, 2), F.lit(""))
    unit = F.nullif(F.trim(F.regexp_replace(F.concat(F.regexp_extract(t, shape, 1), F.lit(" "), F.regexp_extract(t, shape, 3)), r"[():\[\]<>+=≥≤]+", " ")), F.lit(""))
    return number, F.when(number.isNotNull(), unit)


def number_readings(number: Column) -> tuple[Column, Column]:
    """The number of a number text, with commas as decimal points, and with commas (before three digits) as thousands
    separators; the second is NULL where it can't be read so. A point after or before a comma settles the matter."""
    plain = F.regexp_like(number, F.lit(r"^[-+]?[0-9]+(?:\.[0-9]+)?$"))
    grouped = F.regexp_like(number, F.lit(r"^[-+]?[1-9][0-9]{0,2}(?:,[0-9]{3})+(?:\.[0-9]+)?$"))
    as_grouped = F.when(grouped, F.regexp_replace(number, ",", "").try_cast("double"))
    as_decimal = F.when(plain, number.try_cast("double")).when(F.regexp_like(number, F.lit(r"^[-+]?[0-9]+,[0-9]+$")), F.regexp_replace(number, ",", ".").try_cast("double")).when(
        F.regexp_like(number, F.lit(r"^[-+]?[0-9]{1,3}(?:\.[0-9]{3})+,[0-9]+$")), F.regexp_replace(F.regexp_replace(number, r"\.", ""), ",", ".").try_cast("double")
    )
    return as_decimal, as_grouped


def with_units(df: DataFrame, texts: list[str]) -> DataFrame:
    """Adds ``<text>_parsed`` (dims, scale, offset, name; NULL if it names no unit) for columns of unit texts.

    Each distinct text is parsed once, so the work in Python doesn't grow with the rows; the distinct texts stay distributed."""
    base = df.withColumns({f"{t}__key": F.lower(F.trim(F.col(t))) for t in texts})
    known = stage(base.select(F.explode(F.array(*[f"{t}__key" for t in texts])).alias("__t")).where("__t is not null").distinct().withColumn("__p", _parsed("__t")), "units")
    for t in texts:
        base = base.join(known.select(F.col("__t").alias(f"{t}__key"), F.col("__p").alias(f"{t}_parsed")), f"{t}__key", "left")
    return base.drop(*[f"{t}__key" for t in texts])


def harmonise_durations(
    df: DataFrame, value: str, said_unit: str, documented: str, low_days: str, high_days: str, target: Unit, units: dict[str, float], tolerance: float = 0.08
) -> DataFrame:
    """Every duration of column ``value`` (text) in ``target`` units, with the unit it really stands in and why.

    A unit in the text holds first, then the one in ``said_unit``. A plain number without either stands in its
    ``documented`` unit, unless no unit is documented or the number so read contradicts the row's dates (it must lie
    between ``low_days`` and ``high_days``, both in days and NULL where unknown, up to ``tolerance``): then the unit of
    ``units`` (name to days) that comes nearest to the dates is taken, the documented one on equal terms.

    Adds ``number``, ``unit``, ``unit_source`` (text, column, documented, dates), ``dims`` and ``converted``. Missing
    values and texts without exactly one number give NULLs in all five; so does a text with an unknown unit. Columns of
    ``df`` with these names are replaced. Nulls are allowed anywhere; rows are independent, so repeated rows come out alike."""
    own = [c for c in df.columns if c not in ("number", "unit", "unit_source", "dims", "converted")]
    number, text_unit = split_quantity(F.col(value))
    df = with_units(df.select(*own).withColumns({"__number": number, "__in_text": text_unit, "__said": F.lower(F.trim(said_unit)), "__doc": F.lower(F.trim(documented))}), ["__in_text", "__said", "__doc"])
    decimal, grouped = number_readings(F.col("__number"))
    low, high = (F.greatest(F.col(c).cast("double"), F.lit(0.25)) for c in (low_days, high_days))
    df = df.withColumns({"__dec": decimal, "__grp": grouped, "__low": F.log(F.when(F.col(low_days).isNotNull(), F.least(low, high))), "__high": F.log(F.when(F.col(high_days).isNotNull(), F.greatest(low, high)))})
    df = df.withColumns({"__read": F.coalesce("__dec", "__grp"), "__given": F.coalesce(F.when(F.col("__in_text").isNotNull(), F.col("__in_text_parsed")).otherwise(F.col("__said_parsed")))})

    def off(v: Column, days: Column) -> Column:
        """Log distance of v units of so many days from the dates' interval; NULL without dates."""
        got = F.log(F.greatest(v * days, F.lit(0.25)))
        return F.when(F.col("__low").isNotNull() & F.col("__high").isNotNull() & got.isNotNull(), F.greatest(F.col("__low") - got, got - F.col("__high"), F.lit(0.0)))

    # the nearest unit by the dates, evaluated once a row; the documented unit wins where units are equally near
    choices = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("days")) for n, d in units.items()])
    near = F.transform(choices, lambda u: F.struct(F.round(off(F.col("__read"), u["days"]), 3).alias("off"), (~u["name"].eqNullSafe(F.col("__doc_parsed.name"))).alias("other"), u["name"].alias("name"), u["days"].alias("days")))
    df = df.withColumns({"__doc_off": off(F.col("__read"), F.col("__doc_parsed.scale")), "__near": F.array_min(F.filter(near, lambda u: u["off"].isNotNull()))})
    bare = F.col("__in_text").isNull() & F.col("__given").isNull()
    trusted = F.col("__doc_parsed").isNotNull() & (F.col("__doc_off").isNull() | (F.col("__doc_off") <= tolerance) | (F.col("__near.off") > tolerance))
    plain = F.struct(F.array(*map(F.lit, target.dims)).alias("dims"), F.col("__near.days").alias("scale"), F.lit(0.0).alias("offset"), F.col("__near.name").alias("name"))
    df = df.withColumn("__why", F.when(~bare, F.when(F.col("__in_text").isNotNull(), "text").otherwise("column")).when(trusted, "documented").when(F.col("__near").isNotNull(), "dates"))
    df = df.withColumn("__unit", F.when(F.col("__read").isNotNull(), F.when(F.col("__why").isin("text", "column"), F.col("__given")).when(F.col("__why") == "documented", F.col("__doc_parsed")).when(F.col("__why") == "dates", plain)))
    df = df.withColumns({"__a": off(F.col("__dec"), F.col("__unit.scale")), "__b": off(F.col("__grp"), F.col("__unit.scale"))})
    # a comma before three digits: the reading nearer to the dates; without dates, thousands of days, decimals of the rest
    by_dates = F.when(F.col("__a") != F.col("__b"), F.col("__b") < F.col("__a"))
    pick = F.when(F.col("__grp").isNotNull() & (F.col("__dec").isNull() | F.coalesce(by_dates, F.col("__unit.name") == "days")), F.col("__grp")).otherwise(F.col("__dec"))
    df = df.withColumns({"number": F.when(F.col("__unit").isNotNull(), pick), "unit": F.nullif(F.col("__unit.name"), F.lit("")), "unit_source": F.when(F.col("__unit").isNotNull(), F.col("__why")), "dims": F.col("__unit.dims")})
    same = F.col("dims") == F.array(*map(F.lit, target.dims))
    df = df.withColumn("converted", F.when(same, (F.col("number") * F.col("__unit.scale") + F.col("__unit.offset") - target.offset) / target.scale))
    return df.select(*own, "number", "unit", "unit_source", "dims", "converted")
