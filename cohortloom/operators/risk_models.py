"""Survival models behind one interface, and their out-of-fold evaluation. A model is fitted in numpy to one training part; each
(model, held-out fold) is a task of its own, and scores are compared by the distributed concordance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.factorise import nmf_kernel, nnls_kernel
from cohortloom.operators.survival import cox_kernel, valid_outcomes

#: Most rows of a training part that a task takes as one design matrix.
MAX_ROWS = 2_000_000


class RiskModel:
    """Plug-in point: ``fit(x, time, event)`` on a frame of features (nulls allowed), then ``score(x)``: higher is riskier."""

    def fit(self, x: pd.DataFrame, time: np.ndarray, event: np.ndarray) -> RiskModel:
        raise NotImplementedError

    def score(self, x: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError


class CoxRisk(RiskModel):
    """Elastic-net Cox on ``columns`` (all if None): medians of the training rows for nulls, constant columns left out. A column
    that new rows lack counts as its training median."""

    def __init__(self, columns: Sequence[str] | None = None, penalizer: float = 0.01, l1_ratio: float = 0.5) -> None:
        self.columns, self.penalizer, self.l1_ratio = columns, penalizer, l1_ratio

    def _matrix(self, x: pd.DataFrame) -> np.ndarray:
        return x.reindex(columns=self.use).fillna(self.median).to_numpy(float) - self.mean

    def fit(self, x: pd.DataFrame, time: np.ndarray, event: np.ndarray) -> CoxRisk:
        self.use = [c for c in (self.columns or x.columns) if c in x.columns and x[c].nunique() > 1]
        if not self.use:
            raise ValueError("no column with more than one value")
        self.median = x[self.use].median()
        self.mean = x[self.use].fillna(self.median).to_numpy(float).mean(0)
        self.beta = cox_kernel(self._matrix(x), time, event, self.penalizer, self.l1_ratio)["beta"]
        return self

    def score(self, x: pd.DataFrame) -> np.ndarray:
        return self._matrix(x) @ self.beta


class RandomCox(CoxRisk):
    """Negative control: Cox on a few columns drawn by seed."""

    def __init__(self, k: int = 6, seed: int = 0, columns: Sequence[str] | None = None) -> None:
        super().__init__(None, 0.05)
        self.k, self.seed, self.pool = k, seed, columns

    def fit(self, x: pd.DataFrame, time: np.ndarray, event: np.ndarray) -> RandomCox:
        pool = np.array(self.pool or list(x.columns))
        self.columns = list(np.random.default_rng(self.seed).choice(pool, size=min(self.k, len(pool)), replace=False))
        super().fit(x, time, event)
        return self


class FactorCox(RiskModel):
    """Non-negative factors of the scaled training features (best of ``runs``), Cox on their min-max weights; new rows are projected
    on the factors and scaled by the training rows' bounds. Robust scaling (sd where the MAD is 0), clipped to +-10."""

    def __init__(self, columns: Sequence[str], k: int = 6, runs: int = 10, penalizer: float = 0.05, seed: int = 42) -> None:
        self.columns, self.k, self.runs, self.penalizer, self.seed = list(columns), k, runs, penalizer, seed

    def _scaled(self, x: pd.DataFrame) -> np.ndarray:
        v = x.reindex(columns=self.columns).fillna(self.median).to_numpy(float)
        return np.clip((v - self.median.to_numpy(float)) / self.spread, -10, 10)

    def _weights(self, x: pd.DataFrame) -> pd.DataFrame:
        w = nnls_kernel(self.h, np.maximum(self._scaled(x) + self.shift, 0))
        return pd.DataFrame((w - self.low) / self.span, columns=[f"factor_{i + 1}" for i in range(self.k)])

    def fit(self, x: pd.DataFrame, time: np.ndarray, event: np.ndarray) -> FactorCox:
        v = x.reindex(columns=self.columns)
        self.median = v.median().fillna(0.0)
        full = v.fillna(self.median)
        mad, sd = 1.4826 * (full - self.median).abs().median(), full.std(ddof=1)
        self.spread = mad.where(mad > 0, sd).replace(0, 1.0).fillna(1.0).to_numpy(float)
        z = self._scaled(x)
        self.shift = np.abs(np.minimum(z.min(0), 0)) + 1e-6
        _, self.h, _ = min((nmf_kernel(z + self.shift, self.k, self.seed * 1000 + r, steps=200) for r in range(self.runs)), key=lambda t: t[2])
        w = nnls_kernel(self.h, z + self.shift)
        self.low, self.span = w.min(0), np.where(np.ptp(w, axis=0) > 0, np.ptp(w, axis=0), 1.0)
        self.cox = CoxRisk(None, self.penalizer).fit(self._weights(x), time, event)
        return self

    def score(self, x: pd.DataFrame) -> np.ndarray:
        return self.cox.score(self._weights(x))


class StackedCox(RiskModel):
    """Cox on the in-sample scores of its members."""

    def __init__(self, members: Sequence[RiskModel], penalizer: float = 0.01) -> None:
        self.members, self.penalizer = members, penalizer

    def _scores(self, x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({f"m{i}": m.score(x) for i, m in enumerate(self.members)})

    def fit(self, x: pd.DataFrame, time: np.ndarray, event: np.ndarray) -> StackedCox:
        for m in self.members:
            m.fit(x, time, event)
        self.top = CoxRisk(None, self.penalizer).fit(self._scores(x), time, event)
        return self

    def score(self, x: pd.DataFrame) -> np.ndarray:
        return self.top.score(self._scores(x))


def out_of_fold_risk(df: DataFrame, row: str, time: str, event: str, features: Sequence[str], fold: str, zoo: dict[str, Callable[[], RiskModel]], folds: int) -> DataFrame:
    """Risk of each row by models fitted on the other folds: model, row, t, e, fold, risk (NULL where a fit fails). Rows without a
    valid outcome are left out. Each (model, held-out fold) is a task with a copy of the rows, a study of at most ``MAX_ROWS``
    rows; more raise ValueError."""
    d = valid_outcomes(df, time, event).select(row, F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(fold).cast("int").alias("fold"), *[F.col(f).cast("double").alias(f) for f in features])
    if d.count() > MAX_ROWS:
        raise ValueError("the study is too large for one design matrix a task")
    jobs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("held")) for m in zoo for k in range(folds)]))
    kind, cols = dict(d.dtypes)[row], list(features)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, kind="stable").reset_index(drop=True)
        test = pdf["fold"] == key[1]
        held, train = pdf[test].reset_index(drop=True), pdf[~test].reset_index(drop=True)
        risk = np.full(len(held), np.nan)
        try:
            risk = zoo[key[0]]().fit(train[cols], train["t"].to_numpy(), train["e"].to_numpy()).score(held[cols])
        except (np.linalg.LinAlgError, ValueError, FloatingPointError):
            pass
        return pd.DataFrame({"model": key[0], row: held[row], "t": held["t"], "e": held["e"], "fold": held["fold"], "risk": risk})

    out = d.select("*", jobs.alias("j")).select(*d.columns, "j.*").groupBy("model", "held").applyInPandas(run, f"model string, `{row}` {kind}, t double, e int, fold int, risk double")
    return out.withColumn("risk", F.when(~F.isnan("risk"), F.col("risk")))
