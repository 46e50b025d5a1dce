"""Frames of a study: feature assembly, modules, composites as text, receptor matching, fitted scalers, column shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.operators.scoring import wide_scores


def row_max(*columns: Column | str) -> Column:
    """The largest of the row's values, nulls left out; null if all are."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def ordered_unique(df: DataFrame, group: str, items: str, out: str = "item") -> DataFrame:
    """The distinct items of all groups' lists in the order of their first appearance (groups by name): ``out``, ``place`` from 1.
    The order is global: for lists of a configuration, not data."""
    long = df.select(group, F.posexplode(items).alias("at", out)).where(F.col(out).isNotNull())
    first = long.groupBy(out).agg(F.min(F.struct(group, "at")).alias("f"))
    return first.select(out, F.row_number().over(W.orderBy("f", out)).alias("place"))


def module_map(columns: DataFrame, column: str, modules: Sequence[tuple[str, str]], other: str = "other") -> DataFrame:
    """Adds ``module``: that of the first (prefix, module) that the name (without ``sig__``) begins with."""
    name = F.lower(F.regexp_replace(F.col(column), "^sig__", ""))
    case = F.lit(other)
    for prefix, module in reversed(modules):
        case = F.when(name.startswith(prefix.lower()), module).otherwise(case)
    return columns.withColumn("module", case)


def formula(components: DataFrame, by: str = "class_name", part: str = "set_name", sign: str = "sign") -> DataFrame:
    """A composite as text, its parts by name: ``+ z(a) - z(b)``."""
    text = F.concat(F.when(F.col(sign) < 0, "- ").otherwise("+ "), F.lit("z("), F.col(part), F.lit(")"))
    return components.groupBy(by).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), text.alias("t")))), lambda x: x["t"])).alias("formula"))


def feature_matrix(scores: DataFrame, sets: Sequence[str], expression: DataFrame, genes: Sequence[str], clinical: DataFrame, columns: Sequence[str], baselines: dict[str, DataFrame]) -> DataFrame:
    """One row a scored sample: ``sig__`` (scores), ``gene__`` (single genes), ``baseline__`` (named scores: sample_id, score) and
    ``clin__`` columns; what a sample lacks is null."""
    out = wide_scores(scores, sets)
    if genes:
        g = expression.where(F.col("gene").isin(*genes)).groupBy("sample_id").pivot("gene", list(genes)).agg(F.first("value"))
        out = out.join(g.select("sample_id", *[F.col(f"`{x}`").alias(f"gene__{x}") for x in genes]), "sample_id", "left")
    for name, df in baselines.items():
        out = out.join(df.select("sample_id", F.col("score").alias(f"baseline__{name}")), "sample_id", "left")
    return out.join(clinical.select("sample_id", *[F.col(c).alias(f"clin__{c}") for c in columns]), "sample_id", "left")


def receptor_matched(df: DataFrame, arm: str, flag: str, control: Column) -> DataFrame:
    """Rows comparable in a receptor: an arm of only positives is left out (it has no negative controls), a mixed one is
    restricted to negatives; controls to negatives too. Adds ``matching``: negative or mixed. Null flags are left out."""
    status = df.where(~control & F.col(flag).isNotNull()).groupBy(F.col(arm).alias("__a")).agg(F.min(flag).alias("__lo"), F.max(flag).alias("__hi"))
    d = df.where(F.col(flag) == 0).withColumn("__c", control)
    d = d.join(status, d[arm] == status["__a"], "left").where("__c or __lo = 0")
    return d.withColumn("matching", F.when(F.col("__c"), "control").when(F.col("__hi") == 1, "mixed").otherwise("negative")).drop("__a", "__lo", "__hi", "__c")


def significant(df: DataFrame, p: str, below: float = 0.10) -> DataFrame:
    """Rows of a result table with p (or q) below the level; nulls aren't."""
    return df.where(F.col(p) < below)


def median_contrast(df: DataFrame, value: str, linked: Column) -> DataFrame:
    """Medians of two groups of rows and their difference: n_linked, n_other, median_linked, median_other, difference."""
    a, b = F.when(linked, F.col(value)), F.when(~linked, F.col(value))
    out = df.agg(F.count(a).alias("n_linked"), F.count(b).alias("n_other"), F.median(a).alias("median_linked"), F.median(b).alias("median_other"))
    return out.withColumn("difference", F.col("median_linked") - F.col("median_other"))


def fit_scaler(df: DataFrame, feature: str, value: str, *, robust: bool = False, ddof: int = 1) -> DataFrame:
    """Centre and scale of each feature, to be applied to other rows: mean and sd (ddof 0 or 1), or median and 1.4826 MAD (the sd
    where that is 0); a scale of 0 is 1. Columns: feature, centre, scale."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    s = df.groupBy(feature).agg(F.avg(value).alias("m"), sd(value).alias("s"), *([F.median(value).alias("med")] if robust else []))
    if not robust:
        return s.select(feature, F.col("m").alias("centre"), F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("scale"))
    mad = df.join(s.select(feature, "med"), feature).groupBy(feature).agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return s.join(mad, feature).select(feature, F.col("med").alias("centre"), F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("scale"))


def apply_scaler(df: DataFrame, fitted: DataFrame, feature: str, value: str, out: str, bound: float | None = None) -> DataFrame:
    """(x - centre) / scale by fitted scalers, clipped to +-bound; features that weren't fitted give null."""
    d = df.join(fitted, feature, "left")
    z = (F.col(value) - F.col("centre")) / F.col("scale")
    if bound is not None:
        z = F.when(z.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), z)))
    return d.withColumn(out, z).drop("centre", "scale")


def column_shares(df: DataFrame, column: str, value: str, out: str = "share") -> DataFrame:
    """Each value as a share of its column's sum (as loadings of a feature over the factors); null where that is 0."""
    total = df.groupBy(F.col(column).alias("__c")).agg(F.sum(value).alias("__t"))
    return df.join(total, F.col(column).eqNullSafe(F.col("__c"))).withColumn(out, F.col(value) / F.nullif(F.col("__t").cast("double"), F.lit(0.0))).drop("__c", "__t")


def outcome_status(df: DataFrame, by: Sequence[str], outcome: str, least_rows: int) -> DataFrame:
    """VALID or TOO_SMALL by group, with its numbers: a guard that keeps the groups in the table of results."""
    return df.groupBy(*by).agg(F.count(outcome).alias("n"), F.sum(outcome).alias("events")).withColumn("status", F.when(F.col("n") >= least_rows, "VALID").otherwise("TOO_SMALL"))


def all_of(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
