"""Model operators. A model is fitted once per group (arm, signature, replicate, fold) in numpy inside ``applyInPandas``: the
group is one design matrix. Scoring is expressions or Arrow batches against a small fitted model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.special import norm_sf2


def logit_kernel(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an intercept by IRLS; ``ridge`` on all but the intercept. Coefficients, covariance, log likelihood."""
    a = np.column_stack([np.ones(len(x)), x])
    w0 = np.ones(len(x)) if weight is None else weight
    pen = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    b = np.zeros(a.shape[1])

    def value(b: np.ndarray) -> float:
        eta = a @ b
        return float((w0 * (y * eta - np.logaddexp(0, eta))).sum() - b @ pen @ b / 2)

    best = value(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w0 * p * (1 - p))[:, None]).T @ a + pen
        step = np.linalg.lstsq(h + 1e-10 * np.eye(len(b)), a.T @ (w0 * (y - p)) - pen @ b, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and (new := value(b + size * step)) < best - 1e-12:
            size /= 2
        b, gain, best = b + size * step, abs(new - best), new
        if gain < 1e-10:
            break
    p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
    h = (a * (w0 * p * (1 - p))[:, None]).T @ a + pen
    return b, np.linalg.pinv(h), best


def elastic_logit_kernel(x: np.ndarray, y: np.ndarray, c: float = 0.5, l1_ratio: float = 0.5, steps: int = 2000) -> np.ndarray:
    """Elastic-net logistic regression (classes weighted to balance) by accelerated proximal gradient: intercept first."""
    n, p = x.shape
    w = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    a = np.column_stack([np.ones(n), x])
    lip = 0.25 * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 * c + (1 - l1_ratio)
    b = z = np.zeros(p + 1)
    t = 1.0
    for _ in range(steps):
        g = c * a.T @ (w * (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y))
        g[1:] += (1 - l1_ratio) * z[1:]
        new = z - g / lip
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - l1_ratio / lip, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - b)
        if np.abs(new - b).max() < 1e-8:
            b = new
            break
        b, t = new, t2
    return b


LOGIT_SCHEMA = "term string, beta double, se double, odds_ratio double, ci_lo double, ci_hi double, z double, p double, n long, n_events long, error string"


def logit(df: DataFrame, outcome: str, terms: Sequence[str], by: Sequence[str], *, least_rows: int = 30, least_cell: int = 1) -> DataFrame:
    """Unpenalised logistic regression per group: one row a term, Wald interval and p. Rows with a null are dropped; terms
    constant in the group are left out; a group that is too small or of one outcome gives one row with ``error``."""
    d = df.select(*by, F.col(outcome).cast("double").alias("__y"), *[F.col(t).cast("double").alias(t) for t in terms]).na.drop(subset=["__y", *terms])
    kinds = dict(d.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in by}
        n, ev = len(pdf), int(pdf["__y"].sum())
        use = [t for t in terms if pdf[t].nunique() > 1]
        if n < least_rows or min(ev, n - ev) < least_cell or not use:
            return pd.DataFrame([{**head, **dict.fromkeys(("term", "beta", "se", "odds_ratio", "ci_lo", "ci_hi", "z", "p")), "n": n, "n_events": ev, "error": "too few rows or outcomes"}])
        b, cov, _ = logit_kernel(pdf[use].to_numpy(), pdf["__y"].to_numpy())
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        e = lambda v: float(np.exp(np.clip(v, -700, 700)))
        return pd.DataFrame([{**head, "term": t, "beta": b[i], "se": se[i], "odds_ratio": e(b[i]), "ci_lo": e(b[i] - 1.96 * se[i]), "ci_hi": e(b[i] + 1.96 * se[i]), "z": b[i] / se[i] if se[i] else None, "p": norm_sf2(b[i] / se[i]) if se[i] else None, "n": n, "n_events": ev, "error": None} for i, t in enumerate(["(intercept)", *use])])

    return d.groupBy(*by).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in by) + ", " + LOGIT_SCHEMA)


def interaction_logit(df: DataFrame, outcome: str, score: str, arm: str, covariates: Sequence[str], by: Sequence[str], **limits: int) -> DataFrame:
    """outcome ~ z + arm + z * arm + covariates per group, z the score standardised (ddof 1) over the group."""
    stats = df.groupBy(*by).agg(F.avg(score).alias("__m"), F.stddev_samp(score).alias("__s"))
    d = df.join(stats, list(by)).withColumn("z_score", F.when(F.col("__s") > 0, (F.col(score) - F.col("__m")) / F.col("__s")))
    return logit(d.withColumn("interaction", F.col("z_score") * F.col(arm)), outcome, ["z_score", arm, "interaction", *covariates], by, **limits)


def interaction_replicates(df: DataFrame, row: str, outcome: str, score: str, arm: str, by: Sequence[str], n: int, *, fraction: float | None = None, seed: int = 42, least_rows: int = 30) -> DataFrame:
    """The interaction term of ``interaction_logit`` in ``n`` replicates of each group: by, rep, beta, p. The outcome is shuffled
    within the arm or, with ``fraction``, so much of each arm is drawn without replacement (at least 5 rows).

    The groups' rows go once to every task (one trial); replicates are tasks' rows, never copies of the data. Draws follow from
    (seed, replicate) over the rows in the order of ``row``. Replicates too small or of one outcome give no row."""
    spark, keys = df.sparkSession, list(by)
    data = df.select(*keys, row, F.col(outcome).cast("double").alias("__y"), F.col(arm).cast("double").alias("__a"), F.col(score).cast("double").alias("__x")).na.drop().orderBy(*keys, row).toPandas()
    groups = [(k, g[["__y", "__a", "__x"]].to_numpy(float)) for k, g in data.groupby(keys)]
    shared = spark.sparkContext.broadcast([g for _, g in groups])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at, rep in zip(pdf["at"], pdf["rep"], strict=True):
            d, rng = shared.value[at].copy(), np.random.default_rng((seed, int(rep)))
            arms = [np.flatnonzero(d[:, 1] == v) for v in np.unique(d[:, 1])]
            if fraction is None:
                for i in arms:
                    d[i, 0] = d[rng.permutation(i), 0]
            else:
                d = d[np.concatenate([rng.permutation(i)[: max(5, int(len(i) * fraction))] for i in arms])]
            y, a, x = d.T
            if len(y) < least_rows or len(np.unique(y)) < 2 or x.std() == 0:
                continue
            z = (x - x.mean()) / x.std(ddof=1)
            terms = [c for c in (z, a) if np.ptp(c) > 0]
            if np.ptp(z * a) == 0:
                continue
            b, cov, _ = logit_kernel(np.column_stack([*terms, z * a]), y)
            se = float(np.sqrt(max(cov[-1, -1], 0)))
            out.append((at, rep, float(b[-1]), norm_sf2(b[-1] / se) if se else None))
        return pd.DataFrame(out, columns=["at", "rep", "beta", "p"])

    jobs = spark.range(len(groups) * n).select((F.col("id") % max(1, len(groups))).cast("int").alias("at"), F.floor(F.col("id") / max(1, len(groups))).cast("int").alias("rep"))
    done = jobs.groupBy((F.col("rep") % 64).alias("task")).applyInPandas(fit, "at int, rep int, beta double, p double")
    kinds = dict(df.dtypes)
    names = spark.createDataFrame([(i, *(k if isinstance(k, tuple) else (k,))) for i, (k, _) in enumerate(groups)], "at int, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys))
    return done.join(F.broadcast(names), "at").select(*keys, "rep", "beta", "p")  # a row a group


class Classifier:
    """Plug-in point of the out-of-fold harness: ``fit(x, y)`` on frames of features (nulls allowed), then ``score(x)``."""

    def fit(self, x: pd.DataFrame, y: np.ndarray) -> Classifier:
        raise NotImplementedError

    def score(self, x: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError


class RidgeLogit(Classifier):
    """Balanced ridge logit on scaled features (ddof 0), medians of the training rows for nulls."""

    def __init__(self, c: float = 1.0, columns: Sequence[str] | None = None) -> None:
        self.c, self.columns = c, columns

    def _matrix(self, x: pd.DataFrame) -> np.ndarray:
        return ((x[self.use].fillna(self.median) - self.mean) / self.sd).to_numpy(float)

    def fit(self, x: pd.DataFrame, y: np.ndarray) -> RidgeLogit:
        cols = [c for c in (self.columns or x.columns) if x[c].nunique() > 1]
        self.use, self.median = cols, x[cols].median()
        full = x[cols].fillna(self.median)
        self.mean, self.sd = full.mean(), full.std(ddof=0).replace(0, 1.0)
        w = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
        self.beta = logit_kernel(self._matrix(x), y, w, 1 / self.c)[0]
        return self

    def score(self, x: pd.DataFrame) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + self._matrix(x) @ self.beta[1:], -30, 30)))


class ElasticLogit(RidgeLogit):
    """Elastic-net logit; nulls are 0 after scaling."""

    def __init__(self, c: float = 0.5, l1_ratio: float = 0.5, columns: Sequence[str] | None = None) -> None:
        super().__init__(c, columns)
        self.l1_ratio = l1_ratio

    def fit(self, x: pd.DataFrame, y: np.ndarray) -> ElasticLogit:
        cols = [c for c in (self.columns or x.columns) if x[c].nunique() > 1]
        self.use, self.median = cols, x[cols].mean()
        self.mean, self.sd = x[cols].mean(), x[cols].std(ddof=0).replace(0, 1.0)
        self.beta = elastic_logit_kernel(self._matrix(x), y, self.c, self.l1_ratio)
        return self


class RandomColumns(RidgeLogit):
    """Negative control: a ridge logit on a few columns drawn by seed."""

    def __init__(self, k: int = 6, seed: int = 0) -> None:
        super().__init__()
        self.k, self.seed = k, seed

    def fit(self, x: pd.DataFrame, y: np.ndarray) -> RandomColumns:
        rng = np.random.default_rng(self.seed)
        self.columns = list(rng.choice(np.array(x.columns), size=min(self.k, x.shape[1]), replace=False))
        super().fit(x, y)
        return self


class Stacked(Classifier):
    """A logit on the in-sample scores of its members."""

    def __init__(self, members: Sequence[Classifier]) -> None:
        self.members = members

    def _scores(self, x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({f"m{i}": m.score(x) for i, m in enumerate(self.members)})

    def fit(self, x: pd.DataFrame, y: np.ndarray) -> Stacked:
        for m in self.members:
            m.fit(x, y)
        self.top = RidgeLogit().fit(self._scores(x), y)
        return self

    def score(self, x: pd.DataFrame) -> np.ndarray:
        return self.top.score(self._scores(x))


def out_of_fold(df: DataFrame, row: str, outcome: str, features: Sequence[str], fold: str, factory: Callable[[], Classifier], by: Sequence[str] = ()) -> DataFrame:
    """Scores of rows by models fitted on the other folds: row, outcome, fold, score (null where a fit fails), per group ``by``
    (a replicate, a model input). One group is one cross-validation and is run by one task."""
    d = df.select(*by, row, F.col(outcome).cast("double").alias("__y"), F.col(fold).alias("__f"), *[F.col(f).cast("double").alias(f) for f in features]).where("__y is not null")
    d = d if by else d.withColumn("__all", F.lit(0))
    keys, kinds = list(by) or ["__all"], dict(d.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = pd.Series(np.nan, index=pdf.index)
        for f in sorted(pdf["__f"].unique()):
            test = pdf["__f"] == f
            try:
                score[test] = factory().fit(pdf.loc[~test, list(features)], pdf.loc[~test, "__y"].to_numpy()).score(pdf.loc[test, list(features)])
            except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                pass
        return pd.DataFrame({**{k: pdf[k] for k in keys}, row: pdf[row], "outcome": pdf["__y"], "fold": pdf["__f"], "score": score})

    out = d.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{row}` {kinds[row]}, outcome double, fold int, score double")
    return out if by else out.drop("__all")


def train_and_apply(train: DataFrame, test: DataFrame, row: str, outcome: str, features: Sequence[str], factory: Callable[[], Classifier]) -> DataFrame:
    """Fit on one cohort, score another: row, outcome, score. The training cohort is one design matrix on the driver's side of
    ``toPandas``; the test rows are scored in Arrow batches."""
    d = train.select(F.col(outcome).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f) for f in features]).where("__y is not null").toPandas()
    model = factory().fit(d[list(features)], d["__y"].to_numpy())

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(x))

    return test.select(row, F.col(outcome).cast("double").alias("outcome"), score(F.struct(*[F.col(f).cast("double").alias(f) for f in features])).alias("score"))


def centroids(df: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """Mean by label and feature of long data."""
    return df.where(F.col(label).isNotNull()).groupBy(label, feature).agg(F.avg(value).alias("centre"))


def nearest_centroid(df: DataFrame, entity: str, feature: str, value: str, centres: DataFrame, label: str, metric: str = "euclidean") -> DataFrame:
    """The label of the nearest centroid (the first by name on ties): entity, predicted, distance. ``metric``: euclidean,
    cosine or correlation (1 - similarity). Features missing in the data count as 0. Labels x features must be a model, not data."""
    names = centres.select(F.col(feature).alias("__f")).distinct()
    ents = df.select(entity).distinct()
    c = centres.select(F.col(label).alias("predicted"), F.col(feature).alias("__f"), "centre")
    x = df.select(entity, F.col(feature).alias("__f"), F.col(value).alias("__v")).join(F.broadcast(names), "__f", "left_semi")  # features of a model
    if metric == "euclidean":
        # |x - c|^2 = sum over present (x^2 - 2 x c) + |c|^2, so missing features cost nothing to represent
        norm = c.groupBy("predicted").agg(F.sum(F.col("centre") ** 2).alias("cc"))
        part = x.join(F.broadcast(c), "__f").groupBy(entity, "predicted").agg(F.sum(F.col("__v") * F.col("__v") - 2 * F.col("__v") * F.col("centre")).alias("xc")).join(F.broadcast(norm), "predicted")
        d = part.select(entity, "predicted", F.sqrt(F.greatest(F.col("xc") + F.col("cc"), F.lit(0.0))).alias("distance"))
    else:
        m = names.agg(F.count("*").alias("m"))
        cs = c.groupBy("predicted").agg(F.sum("centre").alias("c1"), F.sum(F.col("centre") ** 2).alias("c2"))
        xs = x.groupBy(entity).agg(F.sum("__v").alias("x1"), F.sum(F.col("__v") ** 2).alias("x2"))
        dot = x.join(F.broadcast(c), "__f").groupBy(entity, "predicted").agg(F.sum(F.col("__v") * F.col("centre")).alias("xc")).join(F.broadcast(cs), "predicted").join(xs, entity).crossJoin(F.broadcast(m))  # one row
        k = F.col("m") if metric == "correlation" else F.lit(float("inf"))
        top = F.col("xc") - F.col("x1") * F.col("c1") / k
        sim = top / F.sqrt((F.col("x2") - F.col("x1") ** 2 / k) * (F.col("c2") - F.col("c1") ** 2 / k))
        d = dot.select(entity, "predicted", (1 - sim).alias("distance"))
    best = d.groupBy(entity).agg(F.min(F.struct("distance", "predicted")).alias("b"))
    return ents.join(best, entity, "left").select(entity, "b.predicted", "b.distance")


def softmax_of_negative(distances: Column) -> Column:
    """Probabilities from an array of distances."""
    e = F.transform(distances, lambda d: F.exp(F.array_min(distances) - d))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))
