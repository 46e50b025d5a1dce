"""Scaling and simple imputation of long tables (entity, feature, value). Each docstring names the divisor of its variance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Adds aggregates of the group to its rows: an aggregate with a map-side part, joined back (no window over whole groups)."""
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # without groups: one row


def zscore(df: DataFrame, value: str, by: Sequence[str], out: str, ddof: int = 0, constant: str = "zero") -> DataFrame:
    """(x - mean) / sd within ``by``; ``ddof`` 0 or 1. Constant groups give 0 (``zero``) or x - mean (``centre``)."""
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value)
    d = _joined(df, by, __m=F.avg(value), __s=sd)
    spread = F.when(F.col("__s") > 0, F.col("__s"))
    z = (F.col(value) - F.col("__m")) / (spread if constant == "zero" else F.coalesce(spread, F.lit(1.0)))
    return d.withColumn(out, F.coalesce(z, F.when(F.col(value).isNotNull(), F.lit(0.0)))).drop("__m", "__s")


def robust_zscore(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """(x - median) / (1.4826 MAD); where the MAD is 0 the ordinary z (ddof 1), where that fails 0."""
    d = _joined(df, by, __med=F.median(value))
    d = _joined(d.withColumn("__off", F.abs(F.col(value) - F.col("__med"))), by, __mad=F.median("__off"), __m=F.avg(value), __s=F.stddev_samp(value))
    z = F.when(F.col("__mad") > 0, (F.col(value) - F.col("__med")) / (1.4826 * F.col("__mad"))).when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return d.withColumn(out, F.when(F.col(value).isNotNull(), z)).drop("__med", "__off", "__mad", "__m", "__s")


def impute_median(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """The exact median of the group where the value is null (0 for a group without values)."""
    d = _joined(df, by, __med=F.median(value))
    return d.withColumn(out, F.coalesce(F.col(value), F.col("__med"), F.lit(0.0))).drop("__med")


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def cluster_input(df: DataFrame, entity: str, feature: str, value: str, *, robust: bool = True, least_sd: float = 0.01, bound: float = 10.0) -> DataFrame:
    """Median imputation, (robust) z, features of an sd (ddof 1) under ``least_sd`` dropped, clipped to +-bound: column ``x``."""
    d = impute_median(df.select(entity, feature, value), value, [feature], "__x")
    d = robust_zscore(d, "__x", [feature], "__z") if robust else zscore(d, "__x", [feature], "__z", ddof=1)
    return _joined(d, [feature], __sd=F.stddev_samp("__z")).where(F.col("__sd") >= least_sd).select(entity, feature, clip(F.col("__z"), -bound, bound).alias("x"))


def wide_cluster_input(df: DataFrame, entity: str, features: Sequence[str], *, least_sd: float = 0.01, bound: float = 10.0) -> tuple[DataFrame, list[str]]:
    """``cluster_input`` (robust) of a frame with a column for each feature, and the features that are kept. Medians and spreads,
    a few numbers a feature, are found in three passes over the frame (stage it) and enter as constants."""
    long = lambda d: d.unpivot(entity, list(features), "feature", "v").groupBy("feature")
    value = {f: F.col(f).cast("double") for f in features}
    med = {r["feature"]: r["m"] or 0.0 for r in long(df.select(entity, *[c.alias(f) for f, c in value.items()])).agg(F.median("v").alias("m")).collect()}
    x = {f: F.coalesce(c, F.lit(med.get(f, 0.0))) for f, c in value.items()}  # the median stays what it is
    off = long(df.select(entity, *[F.abs(c - F.lit(med.get(f, 0.0))).alias(f) for f, c in x.items()])).agg(F.median("v").alias("mad"))
    mad = {r["feature"]: r["mad"] for r in off.collect()}
    rest = df.agg(*[g(c).alias(f"{p}{f}") for f, c in x.items() for p, g in (("m_", F.avg), ("s_", F.stddev_samp))]).first()
    z = {}
    for f, c in x.items():
        if (mad.get(f) or 0.0) > 0:
            z[f] = (c - F.lit(med[f])) / F.lit(1.4826 * mad[f])
        else:
            s = rest[f"s_{f}"] or 0.0
            z[f] = (c - F.lit(rest[f"m_{f}"])) / F.lit(s) if s > 0 else F.lit(0.0)
    sd = df.agg(*[F.stddev_samp(c).alias(f) for f, c in z.items()]).first()
    kept = [f for f in features if sd[f] is not None and sd[f] >= least_sd]
    return df.select(entity, *[clip(z[f], -bound, bound).alias(f) for f in kept]), kept


def shift_nonnegative(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Adds |min(min, 0)| + 1e-6 of the group."""
    d = _joined(df, by, __lo=F.min(value))
    return d.withColumn(out, F.col(value) + F.abs(F.least(F.col("__lo"), F.lit(0.0))) + 1e-6).drop("__lo")


def fit_minmax(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The bounds of each group, to be kept and applied to other rows."""
    return df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def apply_minmax(df: DataFrame, bounds: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """(x - lo) / (hi - lo) by fitted bounds; may leave [0, 1]; 0 where hi = lo."""
    d = df.join(bounds, list(by), "left")
    return d.withColumn(out, F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")


def log2p(c: Column, pseudo: float = 1.0) -> Column:
    """log2(x + pseudocount); null where that isn't positive."""
    return F.when(c + pseudo > 0, F.log2(c + pseudo))


def log_if_raw(df: DataFrame, value: str, out: str, limit: float = 100.0) -> DataFrame:
    """log2(x + 1) of the whole table if its largest value is above ``limit``: data already in log space stay as they are."""
    top = df.agg(F.max(value).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(F.col("__top") > limit, log2p(F.col(value))).otherwise(F.col(value))).drop("__top")  # one row


def usable_features(df: DataFrame, entity: str, feature: str, value: str, *, least_share: float = 0.8, least_distinct: int = 2) -> DataFrame:
    """Features with values for ``least_share`` of the entities and ``least_distinct`` different ones: ``feature``, ``n``, ``n_distinct``."""
    n = df.agg(F.count_distinct(entity).alias("__all"))
    stats = df.groupBy(feature).agg(F.count(value).alias("n"), F.count_distinct(value).alias("n_distinct"))
    return stats.crossJoin(F.broadcast(n)).where((F.col("n") >= F.floor(least_share * F.col("__all"))) & (F.col("n_distinct") >= least_distinct)).drop("__all")  # one row


def batch_adjust(df: DataFrame, feature: str, batch: str, entity: str, value: str, out: str = "adjusted", *, steps: int = 30) -> DataFrame:
    """Empirical-Bayes location/scale adjustment of batches (parametric priors).

    Per feature: standardise by the grand mean and pooled variance; per batch: shrink each feature's batch mean and variance
    towards the batch's priors by the usual fixed-point iteration. Means, variances and priors are aggregates; the iteration
    runs over (batch, feature) rows, grouped by batch, and never sees the values. Null values stay null; a single batch is
    returned as it is; a batch with one value per feature keeps its scale."""
    own = df.select(entity, feature, batch, F.col(value).cast("double").alias("v"))
    cell = own.where("v is not null").groupBy(feature, batch).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    whole = cell.groupBy(feature).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("s2")) / F.sum("n")).alias("pooled"), F.count("*").alias("n_batches"))
    std = cell.join(whole, feature).where("pooled > 0").select(feature, batch, "n", "grand", "pooled", "n_batches", ((F.col("m") - F.col("grand")) / F.sqrt("pooled")).alias("g"), (F.col("s2") / F.col("pooled") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))).alias("d2"))

    def shrink(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, g, d = pdf["n"].to_numpy(float), pdf["g"].to_numpy(float), pdf["d2"].to_numpy(float)
        centre, tau = g.mean(), g.var(ddof=1) if len(g) > 1 else 0.0
        mean, var = d.mean(), d.var(ddof=1) if len(d) > 1 else 0.0
        a, b = ((2 * var + mean**2) / var, (mean * var + mean**3) / var) if var > 0 else (np.inf, np.inf)
        gs, ds = g.copy(), d.copy()
        for _ in range(steps):
            gs = (n * tau * g + ds * centre) / (n * tau + ds) if tau > 0 else np.full_like(g, centre)
            ss = (n - 1) * d + n * (g - gs) ** 2
            ds = (b + ss / 2) / (n / 2 + a - 1) if np.isfinite(a) else np.full_like(d, mean)
        return pdf.assign(g_star=gs, d_star=np.maximum(ds, 1e-12))[[*pdf.columns[:2], "grand", "pooled", "n_batches", "g_star", "d_star"]]

    kinds = dict(std.dtypes)
    star = std.groupBy(batch).applyInPandas(shrink, f"`{feature}` {kinds[feature]}, `{batch}` {kinds[batch]}, grand double, pooled double, n_batches long, g_star double, d_star double")
    done = own.join(star, [feature, batch], "left")
    z = ((F.col("v") - F.col("grand")) / F.sqrt("pooled") - F.col("g_star")) / F.sqrt("d_star")
    return done.select(entity, feature, batch, F.when(F.col("n_batches") > 1, z * F.sqrt("pooled") + F.col("grand")).otherwise(F.col("v")).alias(out))
