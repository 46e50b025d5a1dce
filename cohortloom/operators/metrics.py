"""Metrics of scores and clusterings: windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.session import ratio


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC by rank sums, ties at their mean rank: rows are first reduced to counts by distinct score."""
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__s")).agg(F.sum(F.col(label).cast("int")).alias("p"), F.count("*").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(W.partitionBy(*by).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = c.withColumn("won", F.col("p") * (below + 0.5 * (F.col("n") - F.col("p"))))
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return d.groupBy(*by).agg(ratio(F.sum("won"), pos * neg).alias("auc"), pos.alias("n_pos"), neg.alias("n_neg"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the gain in recall over distinct scores, from the highest."""
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__s")).agg(F.sum(F.col(label).cast("int")).alias("p"), F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy(F.col("__s").desc())
    d = c.withColumn("prec", F.sum("p").over(w) / F.sum("n").over(w))
    return d.groupBy(*by).agg(ratio(F.sum(F.col("prec") * F.col("p")), F.sum("p")).alias("average_precision"))


def calibration(df: DataFrame, label: str, prob: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins, the last closed."""
    d = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    b = d.groupBy(*by, F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(F.col(label).cast("double")).alias("y"), F.sum(F.pow(F.col(prob) - F.col(label), 2)).alias("se"))
    n = F.sum("n")
    return b.groupBy(*by).agg((F.sum("se") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / n).alias("ece"))


def cdf_area(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Area under the empirical distribution function by the trapezoid rule between neighbouring sorted values."""
    w = W.partitionBy(*by).orderBy(value)
    d = df.groupBy(*by, value).agg(F.count("*").alias("k"))
    d = d.withColumns({"hi": F.sum("k").over(w.rowsBetween(W.unboundedPreceding, 0)), "gap": F.col(value) - F.lag(value).over(w), "all": F.sum("k").over(W.partitionBy(*by))})
    # between neighbours the function goes from the previous value's last step to this value's first step
    return d.groupBy(*by).agg(F.coalesce(F.sum(F.col("gap") * (F.col("hi") - F.col("k") + (F.col("hi") - F.col("k") + 1)) / 2 / F.col("all")), F.lit(0.0)).alias("cdf_area"))


def ambiguous_share(df: DataFrame, value: str, by: Sequence[str], lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Share of pairs whose consensus lies strictly between ``lo`` and ``hi``."""
    inside = (F.col(value) > lo) & (F.col(value) < hi)
    return df.groupBy(*by).agg((F.count(F.when(inside, 1)) / F.count(value)).alias("pac"))


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of a distance matrix (one model's samples)."""
    out = []
    for i in range(len(labels)):
        own = labels == labels[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = distance[i, own].sum() / (own.sum() - 1)
        b = min(distance[i, labels == k].mean() for k in np.unique(labels) if k != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))
