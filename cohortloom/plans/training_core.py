"""Queries of the general training-data operators (problems 1, 4 and 5) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.clean import NO_VALUE, cohort_key, intrinsic_code, no_value_number, no_value_text, receptor_code, stage_code
from cohortloom.functions.quantity import MONTH_DAYS, YEAR_DAYS, parse_unit
from cohortloom.operators.drift import Field, promote, schema_changes, unify
from cohortloom.operators.impute import fill_and_model, fill_missing
from cohortloom.operators.units import harmonise_durations
from cohortloom.session import stage, table

GRADE, KI67 = (1.0, 3.0), (0.0, 100.0)


def missing_cells() -> dict[str, F.Column]:
    """Where clinical lacks a usable value: null, NaN, blank, out of its domain, or a text that says so."""
    return {"grade": no_value_number("grade", *GRADE), "ki67": no_value_number("ki67", *KI67), "stage": no_value_text("stage")}


def clinical_model(df: DataFrame) -> tuple[dict[str, F.Column], dict[str, F.Column]]:
    """The numeric and categorical fields of clinical that say which records are alike; NULL where there is nothing to learn."""
    gone = missing_cells()
    romans = F.get(F.array(*map(F.lit, ("I", "II", "III", "IV"))), stage_code("stage") - 1)
    return (
        {"grade": F.when(~gone["grade"], F.col("grade")), "ki67": F.when(~gone["ki67"], F.col("ki67"))},
        {"stage": F.when(~gone["stage"], romans), "name": cohort_key("name"), "subtype_pam50": intrinsic_code("subtype_pam50"), "subtype_er": receptor_code("subtype_er"), "period": F.year("diagnosed_on")},
    )


FILLED = ["grade", "ki67", "stage"]


def filled_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clinical with grade, ki67 and stage filled from records alike in cohort, subtype and period."""
    df = table(spark, sf_dir, "clinical").select("rec_id", *FILLED, "name", "subtype_pam50", "subtype_er", "diagnosed_on")
    return fill_missing(df, *clinical_model(df), {"grade": GRADE, "ki67": KI67}, FILLED, missing=missing_cells())


def p1_heldout(spark: SparkSession, sf_dir: str, share: int = 10) -> DataFrame:
    """How good the filled values are: one known cell in ``share`` of each field is hidden (by hash), filled, and compared with
    the truth; beside it the mean or mode of the cell's cohort, and of all records. Error: root mean square for numbers, share
    of wrong levels for stage. One row a field: field, n, error, group_error, overall_error, steps, converged."""
    df = table(spark, sf_dir, "clinical").select("rec_id", *FILLED, "name", "subtype_pam50", "subtype_er", "diagnosed_on")
    numeric, categorical = clinical_model(df)
    truth = {**numeric, "stage": categorical["stage"]}
    hide = {f: F.pmod(F.xxhash64(F.lit(f), "rec_id"), F.lit(share)) == 0 for f in FILLED}
    seen = {f: F.when(~hide[f], truth[f]) for f in FILLED}
    base = df.withColumns({f"true_{f}": F.when(hide[f], truth[f]) for f in FILLED})
    filled, m = fill_and_model(base, {f: seen[f] for f in numeric}, {**categorical, "stage": seen["stage"]}, {"grade": GRADE, "ki67": KI67}, FILLED, missing={f: seen[f].isNull() for f in FILLED})
    filled = stage(filled.select(cohort_key("name").alias("cohort"), *[F.col(f"true_{f}") for f in FILLED], *[F.col(f"{f}_filled") for f in FILLED], *[F.when(~F.col(f"{f}_was_filled"), F.col(f"{f}_filled")).alias(f"seen_{f}") for f in FILLED]), "heldout")
    out = []
    for f in FILLED:
        middle = F.avg(f"seen_{f}") if f in numeric else F.mode(f"seen_{f}", True)
        by_group, whole = filled.groupBy("cohort").agg(middle.alias("g")), filled.agg(middle.alias("o"))
        d = filled.where(F.col(f"true_{f}").isNotNull()).join(by_group, filled["cohort"].eqNullSafe(by_group["cohort"]), "left").crossJoin(F.broadcast(whole))  # one row
        off = (lambda c, f=f: F.sqrt(F.avg(F.pow(c - F.col(f"true_{f}"), 2)))) if f in numeric else (lambda c, f=f: F.avg((~c.eqNullSafe(F.col(f"true_{f}"))).cast("double")))
        out.append(d.agg(F.lit(f).alias("field"), F.count("*").alias("n"), *[F.round(off(F.col(c)), 4).alias(n) for c, n in ((f"{f}_filled", "error"), ("g", "group_error"), ("o", "overall_error"))], F.lit(len(m.loglik)).alias("steps"), F.lit(m.converged).alias("converged")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filled_clinical(spark, sf_dir)
    marks = F.array(*[F.when(F.col(f"{f}_was_filled"), F.lit(f)) for f in ("grade", "ki67", "stage")])
    return df.select("rec_id", F.explode(F.array_compact(marks)).alias("field"))


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = [f"{f}{s}" for f in ("grade", "ki67", "stage") for s in ("_filled", "_was_filled")]
    return filled_clinical(spark, sf_dir).select("rec_id", *keep)


TIMES = ("time_os", "time_dfs", "time_drfs")
TIME_UNITS = {"days": 1.0, "weeks": 7.0, "months": MONTH_DAYS, "years": YEAR_DAYS}


def converted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three times of endpoints, one row each, in months.

    time_os runs to the last contact; time_dfs to the relapse, else to the last contact; time_drfs to the distant
    relapse, which lies between these two, or without one to the last contact."""
    units = table(spark, sf_dir, "cohorts").select(cohort_key("name").alias("__name"), *[F.col(f"{t[5:]}_unit") for t in TIMES]).dropDuplicates(["__name"])
    day = lambda c: F.datediff(F.col(c), F.col("enrolled_at"))
    df = table(spark, sf_dir, "endpoints").select("ep_id", cohort_key("name").alias("__name"), *TIMES, "time_unit", "event_drfs", day("last_contact_at").alias("__last"), day("relapse_at").alias("__relapse"))
    df = df.join(units, "__name", "left")
    first = F.coalesce("__relapse", "__last")
    rows = [
        ("time_os", F.col("__last"), F.col("__last")),
        ("time_dfs", first, first),
        ("time_drfs", F.when(F.col("event_drfs") == 0, F.col("__last")).otherwise(first), F.col("__last")),
    ]
    pieces = [F.struct(F.lit(t).alias("field"), F.col(t).alias("raw"), F.col(f"{t[5:]}_unit").alias("documented"), low.alias("low_days"), high.alias("high_days")) for t, low, high in rows]
    long = df.select("ep_id", "time_unit", F.inline(F.array(*pieces)))
    return harmonise_durations(long, "raw", "time_unit", "documented", "low_days", "high_days", parse_unit("months"), TIME_UNITS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_times(spark, sf_dir).where(F.col("unit").isin("days", "weeks", "years")).select("ep_id", "field", "unit")


def p4_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted_times(spark, sf_dir).select("ep_id", "field", "number", "unit", "unit_source", F.round("converted", 4).alias("months"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "raw_rows")).select("file_id", "field_name", "change")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table, with two fields promoted from the rescue column."""
    number = lambda t: F.trim(t).try_cast("double")
    out = unify(table(spark, sf_dir, "raw_rows"), ["feed", "file_id", "line_no"])
    return promote(out, (Field("ki67", ("ki67",), number), Field("er_pct", ("er_pct",), number)))


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "raw_rows"))


def p5_by_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes as found without any alias of the target schema: renames come from spellings and values alone."""
    return schema_changes(table(spark, sf_dir, "raw_rows"), fields=())


_SAYS_NONE = ", ".join("'" + v.replace("'", "''") + "'" for v in NO_VALUE)
MISSING_STAGE_SQL = rf"(stage IS NULL OR lower(trim(regexp_replace(trim(regexp_replace(stage, '[\s\x{{00a0}}]+', ' ', 'g')), '^[\[(<]+|[\])>]+$', '', 'g'))) IN ({_SAYS_NONE}))"

QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p1_heldout": p1_heldout, "p4_found": p4_found, "p4_months": p4_months, "p5_found": p5_found, "p5_changes": p5_changes, "p5_by_values": p5_by_values, "p5_unified": p5_unified}
SQL = {
    "p1_found": f"""
        SELECT rec_id, 'grade' AS field FROM clinical WHERE grade IS NULL OR isnan(grade) OR grade < 1 OR grade > 3
        UNION ALL SELECT rec_id, 'ki67' FROM clinical WHERE ki67 IS NULL OR isnan(ki67) OR ki67 < 0 OR ki67 > 100
        UNION ALL SELECT rec_id, 'stage' FROM clinical WHERE {MISSING_STAGE_SQL}""",
}
