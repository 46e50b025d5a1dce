"""Confounding checks: least-squares residuals by sums over the rows, partial rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.classical import spearman
from cohortloom.session import denan


def ols_residuals(df: DataFrame, targets: dict[str, str], terms: Sequence[str]) -> DataFrame:
    """Adds the residuals of least squares (with an intercept) on ``terms``: ``targets`` names the new column of each target. One
    pass gives the normal equations, whose size is that of the terms; rows with a null or NaN among targets or terms get null."""
    number = lambda c: denan(F.col(c).cast("double"))
    cols = [F.lit(1.0), *map(number, terms)]
    whole = F.lit(True)
    for c in [*terms, *targets]:
        whole = whole & number(c).isNotNull()
    p = len(cols)
    sums = [F.sum(F.when(whole, cols[i] * cols[j])).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.when(whole, cols[i] * F.col(y).cast("double"))).alias(f"y{i}_{k}") for k, y in enumerate(targets) for i in range(p)]
    r = df.agg(*sums).first()
    a = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    out = df
    for k, (y, name) in enumerate(targets.items()):
        b = np.linalg.lstsq(a, np.array([r[f"y{i}_{k}"] or 0.0 for i in range(p)]), rcond=None)[0]
        fit = sum((cols[i] * F.lit(float(b[i])) for i in range(p)), F.lit(0.0))
        out = out.withColumn(name, F.when(whole, F.col(y).cast("double") - fit))
    return out


def partial_spearman(df: DataFrame, risk: str, time: str, event: str, confounders: Sequence[str]) -> DataFrame:
    """Rank correlation of risk and time among events, raw and of the residuals on the confounders: rho, partial_rho, n,
    proxy_warning (the partial one is under half of the raw one, so the score may stand for the confounders)."""
    d = df.where(F.col(event) == 1).na.drop(subset=[risk, time, *confounders])
    d = ols_residuals(d, {risk: "__r", time: "__t"}, confounders)
    raw = spearman(d, risk, time).select(F.col("rho"), "n")
    # residuals that differ by rounding only are ties
    part = spearman(d.withColumns({"__r": F.round("__r", 9), "__t": F.round("__t", 9)}), "__r", "__t").select(F.col("rho").alias("partial_rho"))
    return raw.crossJoin(F.broadcast(part)).withColumn("proxy_warning", F.abs("partial_rho") < 0.5 * F.abs("rho"))  # one row each
