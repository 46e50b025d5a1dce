"""Filling missing values from similar records: EM for a mixture of Gaussian and categorical fields.

The model is a latent-class mixture. Given its class, a record's numeric fields are jointly Gaussian (full covariance)
and its categorical fields, those to fill and those that only say which records are alike (cohort, subtype, period), are
independent. Missing fields are integrated out, so every row takes part with what it has.

The table is cleaned and staged once. Rows that are equal in all fields of the model are one row with a weight, so the
steps' work is bounded by the fields' values. EM starts from a fit to a bounded sample of these rows and then runs over all
of them until the likelihood settles. One step is one distributed job: each partition reduces its rows to sufficient
statistics (class x statistic), these are summed by statistic, and only classes x statistics numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cohortloom.session import stage


@dataclass
class MixedEM:
    """Fitted mixture. ``numeric``: columns to fill with conditional expectations; ``levels``: the levels of each
    categorical column in the order of their codes. Levels beyond ``max_levels`` (the rarest) share one further code, that of
    ``other`` fields: it tells that records are alike in being rare and is never filled in."""

    numeric: list[str]
    categorical: list[str]
    levels: dict[str, list[str]]
    bounds: dict[str, tuple[float, float]]
    weight: np.ndarray = field(default_factory=lambda: np.ones(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    cov: np.ndarray = field(default_factory=lambda: np.zeros((1, 0, 0)))
    prob: list[np.ndarray] = field(default_factory=list)
    other: set[str] = field(default_factory=set)
    loglik: list[float] = field(default_factory=list)
    converged: bool = False

    def size(self, name: str) -> int:
        """Number of codes of a categorical column."""
        return len(self.levels[name]) + (name in self.other)


def _posterior(m: MixedEM, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of rows with NaN / -1 as missing: log likelihood, responsibilities, conditional expectations (classes, rows, fields), and
    for each pattern of missing fields its rows and the classes' conditional covariances."""
    n, d, k = len(x), x.shape[1], len(m.weight)
    logp = np.repeat(np.log(m.weight)[:, None], n, axis=1)
    for j, p in enumerate(m.prob):
        if p.shape[1]:  # the last column stands for code -1: a missing field says nothing
            logp += np.concatenate([np.log(p), np.zeros((k, 1))], axis=1)[:, c[:, j]]
    pattern = (~np.isnan(x)) @ (1 << np.arange(d)) if d else np.zeros(n, int)
    expect, spread = np.empty((k, n, d)), []
    for bits in np.unique(pattern):
        rows = np.flatnonzero(pattern == bits)
        o, u = [j for j in range(d) if bits >> j & 1], [j for j in range(d) if not bits >> j & 1]
        here, cond = x[rows], np.zeros((k, d, d))
        for a in range(k):
            full = here.copy()
            full[:, u] = m.mean[a, u]
            left = m.cov[a][np.ix_(u, u)]
            if o:
                soo = np.linalg.inv(m.cov[a][np.ix_(o, o)])
                off = here[:, o] - m.mean[a, o]
                logp[a, rows] -= 0.5 * (((off @ soo) * off).sum(1) + np.linalg.slogdet(m.cov[a][np.ix_(o, o)])[1] + len(o) * np.log(2 * np.pi))
                if u:
                    gain = m.cov[a][np.ix_(u, o)] @ soo
                    full[:, u] += off @ gain.T
                    left = left - gain @ m.cov[a][np.ix_(o, u)]
            cond[a][np.ix_(u, u)] = left
            expect[a, rows] = full
        spread.append((rows, cond))
    top = logp.max(axis=0)
    total = top + np.log(np.exp(logp - top).sum(axis=0))
    return total, np.exp(logp - total), expect, spread


def _statistics(m: MixedEM, x: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sufficient statistics of weighted rows, one row a class: weight, sums, sums of products, counts by level; then the log
    likelihood."""
    k, d = len(m.weight), x.shape[1]
    total, resp, expect, spread = _posterior(m, x, c)
    resp = resp * w
    second = np.stack([(expect[a] * resp[a][:, None]).T @ expect[a] for a in range(k)]) if d else np.zeros((k, 0, 0))
    for rows, cond in spread:
        second = second + resp[:, rows].sum(1)[:, None, None] * cond
    parts = [resp.sum(1)[:, None], np.stack([resp[a] @ expect[a] for a in range(k)]), second.reshape(k, -1)]
    for j, name in enumerate(m.categorical):
        size = m.size(name)
        parts.append(np.stack([np.bincount(c[:, j] + 1, resp[a], size + 1)[1:] for a in range(k)]))
    return np.concatenate([*parts, np.full((k, 1), (w * total).sum() / k)], axis=1)


def _update(m: MixedEM, s: np.ndarray, prior: float, floor: np.ndarray) -> float:
    d = len(m.numeric)
    n = s[:, 0] + 1e-9
    m.weight = (s[:, 0] + prior) / (s[:, 0] + prior).sum()
    m.mean = s[:, 1 : 1 + d] / n[:, None]
    second = s[:, 1 + d : 1 + d + d * d].reshape(-1, d, d) / n[:, None, None]
    m.cov = second - np.einsum("kd,ke->kde", m.mean, m.mean) + np.diag(floor)[None]
    at, m.prob = 1 + d + d * d, []
    for name in m.categorical:
        size = m.size(name)
        counts = s[:, at : at + size] + prior
        m.prob.append(counts / counts.sum(axis=1, keepdims=True))
        at += size
    return float(s[:, -1].sum())


def _numpy(b: pd.DataFrame, d: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (NaN where missing), codes (-1 where missing) and weights of a batch of coded rows."""
    x = b.iloc[:, :d].to_numpy(float, na_value=np.nan).reshape(len(b), d)
    return x, b.iloc[:, d : d + q].to_numpy(np.int64).reshape(len(b), q), b.iloc[:, d + q].to_numpy(float)


def _local_fit(m: MixedEM, x: np.ndarray, c: np.ndarray, w: np.ndarray, prior: float, floor: np.ndarray, steps: int, tol: float, seed: int) -> MixedEM:
    """EM on rows at hand, from classes that are drawn around the data: where the distributed steps start."""
    rng, k = np.random.default_rng(seed), len(m.weight)
    m.mean = m.mean + rng.normal(size=m.mean.shape) * np.sqrt(np.stack([np.diag(v) for v in m.cov]))
    m.prob = [p * rng.uniform(0.5, 1.5, p.shape) for p in m.prob]
    m.prob = [p / p.sum(axis=1, keepdims=True) if p.size else p for p in m.prob]
    m.weight, last = np.full(k, 1 / k), -np.inf
    for _ in range(steps):
        now = _update(m, _statistics(m, x, c, w), prior, floor)
        if abs(now - last) <= tol * abs(now):
            break
        last = now
    m.loglik = [now]
    return m


def prepare(df: DataFrame, numeric: dict[str, Column], categorical: dict[str, Column], keep: Sequence[Column]) -> DataFrame:
    """``keep`` and the cleaned fields (``__x<i>`` numbers, ``__k<i>`` texts), written once: cleaning texts costs more than EM."""
    x = [c.cast("double").alias(f"__x{i}") for i, c in enumerate(numeric.values())]
    k = [c.cast("string").alias(f"__k{i}") for i, c in enumerate(categorical.values())]
    return stage(df.select(*keep, *x, *k), "fields")


def _codes(levels: dict[str, list[str]], other: set[str]) -> list[Column]:
    out = []
    for i, (name, known) in enumerate(levels.items()):
        c = F.col(f"__k{i}")
        if not known:
            out.append(F.lit(-1).alias(f"__c{i}"))
            continue
        at = F.element_at(F.create_map(*[F.lit(v) for kv in zip(known, range(len(known)), strict=True) for v in kv]), c)
        out.append(F.when(c.isNull(), -1).otherwise(F.coalesce(at, F.lit(len(known) if name in other else -1))).cast("int").alias(f"__c{i}"))
    return out


def fit_mixed_em(
    df: DataFrame, numeric: dict[str, Column], categorical: dict[str, Column], bounds: dict[str, tuple[float, float]], *, classes: int = 8, steps: int = 25, tol: float = 1e-4, max_levels: int = 200, prior: float = 0.5, sample: int = 5_000, starts: int = 2, prepared: DataFrame | None = None
) -> MixedEM:
    """Fit the mixture to every row of ``df`` by EM. The columns are expressions that are NULL where a value is missing.

    ``sample``: most distinct rows (drawn by hash) of the first fit, which only chooses where the steps over all rows start;
    of ``starts`` such fits the likeliest is taken. The steps end when the log likelihood moves by less than ``tol`` of itself
    (``converged``) or after ``steps``. An empty table gives a model of standard values (means in the middle of the bounds, no levels)."""
    clean = prepare(df, numeric, categorical, []) if prepared is None else prepared
    names, cats = list(numeric), list(categorical)
    d, q = len(names), len(cats)
    levels: dict[str, list[str]] = {c: [] for c in cats}
    other: set[str] = set()
    if q:
        cells = clean.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__k{i}").alias("v")) for i in range(q)]))).where("v is not null").groupBy("i", "v").count()
        w = W.partitionBy("i").orderBy(F.desc("count"), "v")
        top = cells.withColumn("at", F.row_number().over(w)).where(F.col("at") <= max_levels + 1).orderBy("i", "at")
        for r in top.collect():  # at most max_levels + 1 a field
            if r["at"] > max_levels:
                other.add(cats[r["i"]])
            else:
                levels[cats[r["i"]]].append(r["v"])
    first = clean.agg(F.count("*").alias("n"), *[a for j in range(d) for a in (F.avg(f"__x{j}").alias(f"m{j}"), F.var_pop(f"__x{j}").alias(f"v{j}"))]).first()
    middle = [(bounds[n][0] + bounds[n][1]) / 2 for n in names]
    mean = np.array([first[f"m{j}"] if first[f"m{j}"] is not None else middle[j] for j in range(d)])
    var = np.array([first[f"v{j}"] or 1.0 for j in range(d)])

    def blank() -> MixedEM:
        m = MixedEM(names, cats, levels, bounds, np.full(classes, 1 / classes), np.tile(mean, (classes, 1)), np.tile(np.diag(var), (classes, 1, 1)), other=other)
        m.prob = [np.full((classes, m.size(c)), 1 / max(1, m.size(c))) for c in cats]
        return m

    if not first["n"]:
        return blank()
    fields = [*[F.col(f"__x{j}") for j in range(d)], *_codes(levels, other)]
    coded = clean.select(*fields)
    coded = stage(coded.groupBy(*coded.columns).agg(F.count("*").cast("double").alias("__w")), "em")
    floor = 1e-3 * var + 1e-6
    drawn = coded.orderBy(F.xxhash64(*coded.columns), *coded.columns).limit(sample).toPandas()  # bounded by ``sample``
    m = max((_local_fit(blank(), *_numpy(drawn, d, q), prior, floor, 60, tol, seed) for seed in range(starts)), key=lambda v: v.loglik[-1])
    m.loglik = []
    for _ in range(steps):

        def reduce(batches: Iterator[pd.DataFrame], m: MixedEM = m) -> Iterator[pd.DataFrame]:
            total = 0.0
            for b in batches:
                if len(b):
                    total = total + _statistics(m, *_numpy(b, d, q))
            if not isinstance(total, float):
                yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        rows = coded.mapInPandas(reduce, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # classes x statistics
        s = np.zeros(len(rows))
        for r in rows:
            s[r["at"]] = r["v"]
        m.loglik.append(_update(m, s.reshape(classes, -1), prior, floor))
        if len(m.loglik) > 1 and abs(m.loglik[-1] - m.loglik[-2]) <= tol * abs(m.loglik[-2]):
            m.converged = True
            break
    return m


def fill_missing(df: DataFrame, numeric: dict[str, Column], categorical: dict[str, Column], bounds: dict[str, tuple[float, float]], fill: Sequence[str], *, missing: dict[str, Column], **fit: int) -> DataFrame:
    """Every cell of ``fill`` without a usable value gets a value from similar records, and a mark.

    ``numeric`` / ``categorical``: the fields as expressions that are NULL where there is nothing to learn from;
    ``missing``: for each field of ``fill``, where a value is to be filled. Adds ``<field>_filled`` and ``<field>_was_filled``;
    columns of ``df`` with these names are replaced, all others stay. A filled cell gets the conditional expectation within
    ``bounds`` or the likeliest level; any other its value as ``numeric`` / ``categorical`` gives it, so that a column keeps to
    one spelling, or as it stood where that is NULL (a text that names no level). Nulls in any column are allowed; repeated
    rows are filled alike; an empty table stays empty; a categorical field without any value at all can't be filled and stays
    NULL, unmarked."""
    return fill_and_model(df, numeric, categorical, bounds, fill, missing=missing, **fit)[0]


def fill_and_model(df: DataFrame, numeric: dict[str, Column], categorical: dict[str, Column], bounds: dict[str, tuple[float, float]], fill: Sequence[str], *, missing: dict[str, Column], **fit: int) -> tuple[DataFrame, MixedEM]:
    """``fill_missing`` and the fitted model."""
    own = [c for c in df.columns if c not in {f"{f}{s}" for f in fill for s in ("_filled", "_was_filled")}]
    clean = prepare(df, numeric, categorical, [*[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(own)], *[F.coalesce(missing[f], F.lit(False)).alias(f"__g{i}") for i, f in enumerate(fill)]])
    m = fit_mixed_em(df, numeric, categorical, bounds, prepared=clean, **fit)
    names, cats = list(numeric), list(categorical)
    d, q = len(names), len(cats)
    kind = T.StructType([T.StructField(f, T.DoubleType() if f in numeric else T.StringType()) for f in fill])

    @F.pandas_udf(kind)
    def expected(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({f: [] for f in fill})
        x, c, _ = _numpy(rows, d, q)
        _, resp, expect, _ = _posterior(m, x, c)
        out = {}
        for f in fill:
            if f in m.numeric:
                lo, hi = m.bounds[f]
                out[f] = np.clip((resp * expect[:, :, m.numeric.index(f)]).sum(0), lo, hi)
            else:
                j, known = m.categorical.index(f), np.array(m.levels[f], dtype=object)
                out[f] = known[(resp.T @ m.prob[j])[:, : len(known)].argmax(axis=1)] if len(known) else [None] * len(rows)
        return pd.DataFrame(out)

    gone = [F.col(f"__g{i}") for i in range(len(fill))]
    any_gone = F.lit(False)
    for g in gone:
        any_gone = any_gone | g
    row = F.struct(*[F.col(f"__x{j}") for j in range(d)], *_codes(m.levels, m.other), F.lit(1.0).alias("__w"))

    def finished(part: DataFrame, value: dict[str, Column]) -> DataFrame:
        cols = []
        for i, f in enumerate(fill):
            given = F.col(f"__x{names.index(f)}") if f in numeric else F.col(f"__k{cats.index(f)}")
            stood = df.schema[f].dataType if f in df.columns else None
            as_it_was = F.col(f"__o{own.index(f)}").cast("double" if f in numeric else "string") if stood is not None else F.lit(None)
            cols += [F.when(gone[i], value[f]).otherwise(F.coalesce(given, as_it_was)).alias(f"{f}_filled"), (gone[i] & value[f].isNotNull()).alias(f"{f}_was_filled")]
        return part.select(*[F.col(f"__o{i}").alias(c) for i, c in enumerate(own)], *cols)

    none = {f: F.lit(None).cast("double" if f in numeric else "string") for f in fill}
    whole = finished(clean.where(~any_gone), none)
    filled = finished(clean.where(any_gone).withColumn("__e", expected(row)), {f: F.col("__e")[f] for f in fill})
    return whole.unionByName(filled), m
