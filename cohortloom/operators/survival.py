"""Survival operators. Curves, log-rank and concordance are windows and joins over event times; Cox is a numpy kernel that
runs once per group inside ``applyInPandas`` (a group is one model fit: a cohort, an arm, a replicate)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.functions.special import chi2_sf, norm_sf2
from cohortloom.operators.resampling import poisson_weights, replicates
from cohortloom.session import ratio


def valid_outcomes(df: DataFrame, time: str, event: str) -> DataFrame:
    """Rows with a time of 0 or more and a known event."""
    return df.where(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) & (F.col(time) >= 0) & F.col(event).isNotNull())


def life_table(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """One row per group and time: t, d (events), c (all that leave), n (at risk). Rows are pre-aggregated to distinct times."""
    t = valid_outcomes(df, time, event).groupBy(*by, F.col(time).alias("t")).agg(F.sum(F.col(event).cast("int")).alias("d"), F.count("*").alias("c"))
    return t.withColumn("n", F.sum("c").over(W.partitionBy(*by).orderBy(F.col("t").desc())))


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """The curve at event times: t, n, d, s. A group whose last are all events ends at 0."""
    w = W.partitionBy(*by).orderBy("t")
    steps = life_table(df, time, event, by).where("d > 0")
    dead = F.max(F.when(F.col("d") == F.col("n"), 1).otherwise(0)).over(w)
    s = F.exp(F.sum(F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)).over(w))
    return steps.withColumn("s", F.when(dead == 1, 0.0).otherwise(s)).drop("c")


def median_survival(df: DataFrame, time: str, event: str, by: Sequence[str]) -> DataFrame:
    """First time with s <= 0.5 by group (null if never), with the numbers of rows and events."""
    km = kaplan_meier(df, time, event, by).where("s <= 0.5").groupBy(*by).agg(F.min("t").alias("median_time"))
    n = valid_outcomes(df, time, event).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("events"))
    return n.join(km, list(by), "left")


def logrank_terms(df: DataFrame, time: str, event: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Observed and expected events by group; covariance of O - E by pair of groups. At-risk counts come from one running
    count by group at the event times at which anyone has an event."""
    table = life_table(df.withColumn("__one", F.lit(1)), time, event, ["__one", group])
    times = table.groupBy("__one", "t").agg(F.sum("d").alias("dd")).where("dd > 0")
    groups = table.select(group).distinct()
    # at risk in each group at each event time: the number of the group's rows from there on
    grid = times.crossJoin(groups)  # all groups; their number decides whether they are broadcast
    leaves = table.groupBy(group, "t").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    full = grid.join(leaves, [group, "t"], "full_outer").withColumns({"c": F.coalesce("c", F.lit(0)), "d": F.coalesce("d", F.lit(0))})
    full = full.withColumn("n", F.sum("c").over(W.partitionBy(group).orderBy(F.col("t").desc()))).where("dd is not null")
    total = full.groupBy("t").agg(F.sum("n").alias("nn"))
    full = full.join(total, "t")
    oe = full.groupBy(group).agg(F.sum("d").alias("observed"), F.sum(ratio(F.col("dd") * F.col("n"), F.col("nn"))).alias("expected"))
    a, b = full.select("t", F.col(group).alias("g1"), F.col("n").alias("n1"), "dd", "nn"), full.select("t", F.col(group).alias("g2"), F.col("n").alias("n2"))
    k = F.col("dd") * (F.col("nn") - F.col("dd")) / (F.col("nn") - 1)
    cov = F.when(F.col("nn") > 1, k * F.col("n1") / F.col("nn") * (F.when(F.col("g1") == F.col("g2"), 1.0).otherwise(0.0) - F.col("n2") / F.col("nn"))).otherwise(0.0)
    return oe, a.join(b, "t").groupBy("g1", "g2").agg(F.sum(cov).alias("v"))


def logrank(df: DataFrame, time: str, event: str, group: str) -> dict[str, float]:
    """Multi-group log-rank: chi2, df, p. Only the groups' totals (k and k x k numbers) come to the driver."""
    oe, cov = logrank_terms(df, time, event, group)
    rows = sorted(oe.collect(), key=lambda r: str(r[0]))
    at = {r[0]: i for i, r in enumerate(rows)}
    v = np.zeros((len(rows), len(rows)))
    for r in cov.collect():
        v[at[r["g1"]], at[r["g2"]]] = r["v"]
    z = np.array([r["observed"] - (r["expected"] or 0.0) for r in rows])
    if len(rows) < 2:
        return {"chi2": 0.0, "df": 0, "p": 1.0}
    chi = float(z[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ z[:-1])
    return {"chi2": chi, "df": len(rows) - 1, "p": chi2_sf(chi, len(rows) - 1)}


def pairwise_logrank(df: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Log-rank of every pair of groups (a < b) in one plan: a, b, chi2 (of one degree), observed and expected events of a.
    A pair's rows are the two groups' rows at their distinct times; p and q are for the caller's result rows."""
    t = life_table(df.where(F.col(group).isNotNull()), time, event, [group]).select(F.col(group).alias("g"), "t", "d", "c")
    names = t.select("g").distinct()
    pairs = names.select(F.col("g").alias("a")).join(names.select(F.col("g").alias("b")), F.col("a") < F.col("b"))  # groups of a study
    one = lambda side: pairs.join(t, F.col(side) == F.col("g")).select("a", "b", "t", *[(F.col(c) if side == s else F.lit(0)).alias(f"{c}{s}") for c in "dc" for s in "ab"])
    both = one("a").unionByName(one("b")).groupBy("a", "b", "t").agg(*[F.sum(f"{c}{s}").alias(f"{c}{s}") for c in "dc" for s in "ab"])
    w = W.partitionBy("a", "b").orderBy(F.col("t").desc())
    both = both.withColumns({"na": F.sum("ca").over(w), "nb": F.sum("cb").over(w)}).where("da + db > 0")
    n, dd = F.col("na") + F.col("nb"), F.col("da") + F.col("db")
    v = F.when(n > 1, dd * (n - dd) / (n - 1) * F.col("na") / n * F.col("nb") / n).otherwise(0.0)
    out = both.groupBy("a", "b").agg(F.sum("da").alias("observed"), F.sum(dd * F.col("na") / n).alias("expected"), F.sum(v).alias("v"))
    return pairs.join(out, ["a", "b"], "left").select("a", "b", "observed", "expected", F.coalesce(ratio(F.pow(F.col("observed") - F.col("expected"), 2), F.col("v")), F.lit(0.0)).alias("chi2"))


#: Most rows (of distinct time and risk) that a bin of ``concordance`` should hold; more make more bins.
BIN_ROWS = 50_000


def concordance(df: DataFrame, time: str, event: str, risk: str, by: Sequence[str] = (), bins: int = 256, rows: int = BIN_ROWS) -> DataFrame:
    """Harrell's C (higher risk, earlier event): concordant, tied, comparable, c_index by group.

    Pairs are counted, not formed: rows are reduced to counts by (time, risk) and a group is cut into bins of about ``rows`` of
    them by time and, apart, by risk (at most ``bins`` each). A pair is either within a bin of time, or in two of them and within
    a bin of risk, or in two of both: the first two are counted in n log(n) in a task a bin, the last from the grid of counts by
    both bins. Exact for any ``bins`` and ``rows``."""
    keys = list(by)
    d = valid_outcomes(df, time, event).where(F.col(risk).isNotNull()).select(*keys, F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r"))
    cells = d.groupBy(*keys, "t", "r").agg(F.count("*").alias("n"), F.sum("e").alias("ne"))
    parts = [i / bins for i in range(1, bins)] or [0.5]
    edges = d.groupBy(*keys).agg(F.count("*").alias("m"), *[F.percentile_approx(c, parts, 10_000).alias(f"c{c}") for c in "tr"])
    few = F.ceil(F.col("m") / rows)  # bins that are needed; of the cuts, which are alike in number, that many are kept
    some = lambda c: F.filter(c, lambda x, i: F.floor((i + 2) * few / bins) > F.floor((i + 1) * few / bins)) if bins > 1 else F.filter(c, lambda x: F.lit(False))
    edges = edges.select(*keys, *[F.array_distinct(some(f"c{c}")).alias(f"c{c}") for c in "tr"])
    cells = cells.join(edges, keys) if keys else cells.crossJoin(F.broadcast(edges))  # without groups: one row
    place = lambda c: F.size(F.filter(f"c{c}", lambda x: x < F.col(c))).alias(f"b{c}")
    cells = cells.select(*keys, "t", "r", "n", "ne", place("t"), place("r"), (F.size("ct") > 0).alias("cut"))
    own = F.struct(F.lit(0).alias("side"), F.col("bt").alias("bin"), F.col("t").alias("x"))
    other = F.struct(F.lit(1).alias("side"), F.col("br").alias("bin"), F.col("bt").cast("double").alias("x"))
    sides = cells.select(*keys, "r", "n", "ne", F.explode(F.when(F.col("cut"), F.array(own, other)).otherwise(F.array(own))).alias("s")).select(*keys, "s.*", "r", "n", "ne")
    grid = cells.where("cut").groupBy(*keys, "bt", "br").agg(F.sum("n").alias("n"), F.sum("ne").alias("ne"))
    sides = sides.unionByName(grid.select(*keys, F.lit(2).alias("side"), F.lit(0).alias("bin"), F.col("bt").cast("double").alias("x"), F.col("br").cast("double").alias("r"), "n", "ne"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        good, ties, pairs = pair_counts(*(pdf[c].to_numpy() for c in ("x", "r", "ne", "n")))
        if pdf["side"].iloc[0] == 2:  # two bins of both: the same bin of risk is counted on the rows
            ties, pairs = 0, pairs - ties
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "c": [good], "e": [ties], "p": [pairs]})

    kinds = dict(d.dtypes)
    counts = sides.groupBy(*keys, "side", "bin").applyInPandas(count, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "c long, e long, p long"]))
    both = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(y) for x, y in (("c", "concordant"), ("e", "tied"), ("p", "comparable"))])
    both = both.where("comparable > 0") if keys else both
    return both.withColumn("c_index", ratio(F.col("concordant") + 0.5 * F.col("tied"), F.col("comparable")))


def pair_counts(time: np.ndarray, risk: np.ndarray, events: np.ndarray, total: np.ndarray) -> tuple:
    """Concordant, tied and comparable pairs of rows that stand for ``total`` rows with ``events`` among them, in n log(n): a pair of
    unequal times is counted at the highest bit in which the ranks of its times differ. Rows stay sorted by (higher bits, risk).
    ``events`` and ``total`` may have replicates as their first axis: the order is that of the rows, so it is found once for all."""
    if not len(time):
        return (0, 0, 0) if total.ndim == 1 else tuple(np.zeros((3, len(total)), total.dtype))
    r = np.unique(risk, return_inverse=True)[1]
    order = np.argsort(r, kind="stable")
    t, r = np.unique(time, return_inverse=True)[1][order], r[order]
    events, total = events[..., order], total[..., order]
    front = np.zeros((*total.shape[:-1], 1), total.dtype)
    at, n, zero, top = np.arange(len(r)), len(r), total.dtype.type(0), int(t.max())
    good = ties = pairs = zero
    for bit in range(top.bit_length() - 1, -1, -1):
        block, one = t >> (bit + 1), (t >> bit) & 1 == 1
        late = np.concatenate([front, np.cumsum(np.where(one, total, zero), axis=-1, dtype=total.dtype)], axis=-1)
        new = np.concatenate([[True], block[1:] != block[:-1]])
        tie = new | np.concatenate([[True], r[1:] != r[:-1]])
        early = np.flatnonzero(~one & (events > 0).reshape(-1, n).any(0))
        spans = []
        for first in (new, tie):  # where the early row's block, then its run of equal risks, begins and ends
            starts = at[first]
            which = (np.cumsum(first) - 1)[early]
            spans += [late[..., starts[which]], late[..., np.append(starts[1:], n)[which]]]
        w = events[..., early]
        good = good + (w * (spans[2] - spans[0])).sum(-1)
        ties = ties + (w * (spans[3] - spans[2])).sum(-1)
        pairs = pairs + (w * (spans[1] - spans[0])).sum(-1)
        key = t >> bit
        move = np.argsort(key.astype(np.uint16) if top < 65536 else key, kind="stable")  # blocks fall in two
        t, r, events, total = t[move], r[move], events[..., move], total[..., move]
    return good, ties, pairs


def concordance_kernel(time: np.ndarray, event: np.ndarray, risk: np.ndarray, weight: np.ndarray) -> float | None:
    """Harrell's C of weighted rows (as ``concordance`` on rows repeated by weight)."""
    good, ties, pairs = pair_counts(time, risk, np.where(event > 0, weight, 0), weight)
    return float((good + 0.5 * ties) / pairs) if pairs > 0 else None


#: Replicates that a task of ``bootstrap_concordance`` weighs at once, and rows times replicates beyond which it takes fewer at a time.
REPLICATES, MAX_CELLS = 10, 4_000_000


def bootstrap_concordance(df: DataFrame, row: str, time: str, event: str, risk: str, n: int, seed: int = 42) -> DataFrame:
    """Harrell's C in ``n`` replicates of ``poisson_bootstrap``: rep, c_index. A task takes the rows once for several replicates,
    draws their weights from the rows' hashes and sorts once for all of them."""
    d = valid_outcomes(df, time, event).where(F.col(risk).isNotNull()).select(F.xxhash64(F.lit(seed), row).alias("h"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r"))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        first, rows = int(pdf["batch"].iloc[0]) * REPLICATES, []
        t, e, r, h = (pdf[c].to_numpy() for c in ("t", "e", "r", "h"))
        step = max(1, MAX_CELLS // len(pdf))
        reps = np.arange(first, min(n, first + REPLICATES))
        for at in range(0, len(reps), step):
            own = reps[at : at + step]
            weight = np.stack([poisson_weights(h, int(rep)) for rep in own])
            good, ties, pairs = pair_counts(t, r, np.where(e > 0, weight, 0), weight)
            rows += [(rep, (g + 0.5 * x) / p if p > 0 else None) for rep, g, x, p in zip(own.tolist(), good.tolist(), ties.tolist(), pairs.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["rep", "c_index"])

    batches = -(-n // REPLICATES)
    return replicates(d, batches, "batch").repartition(batches, "batch").groupBy("batch").applyInPandas(some, "rep int, c_index double")


def composite_risk(df: DataFrame, time: str, event: str, factors: Sequence[str], clinical: Sequence[str], *, penalizer: float = 0.05, l1_ratio: float = 0.5, least_rows: int = 50) -> tuple[DataFrame, tuple[float, float]]:
    """Elastic-net Cox on factors and clinical columns; the score is the factors' part alone, on centred factors: the complete
    rows with ``risk`` and ``tertile``, and the cuts (exact thirds of the training scores)."""
    terms = [*factors, *clinical]
    d = valid_outcomes(df, time, event).na.drop(subset=terms)
    fits = {r["term"]: r for r in cox(d, time, event, terms, penalizer=penalizer, l1_ratio=l1_ratio, least_rows=least_rows).collect()}
    if None in fits:
        raise ValueError(f"no risk score: {fits[None]['error']}")
    means = d.agg(*[F.avg(f).alias(f) for f in factors]).first()
    risk = sum(((F.col(f) - F.lit(means[f])) * F.lit(fits[f]["beta"] or 0.0) for f in factors), F.lit(0.0))
    d = d.withColumn("risk", risk)
    cuts = tuple(d.agg(F.percentile("risk", [1 / 3, 2 / 3]).alias("q")).first()["q"])
    return risk_tertiles(d, "risk", cuts), cuts


def decision_curve(df: DataFrame, risk: str, event: str, thresholds: Sequence[float], ddof: int = 1) -> DataFrame:
    """Net benefit of treating where sigmoid(z(risk)) >= t, of treating all, and of none (0): one pass, one row a threshold."""
    d = df.where(F.col(risk).isNotNull() & F.col(event).isNotNull())
    stats = d.agg(F.avg(risk).alias("m"), (F.stddev_samp if ddof else F.stddev_pop)(risk).alias("s"))
    p = 1 / (1 + F.exp(-F.coalesce(ratio(F.col(risk) - F.col("m"), F.col("s")), F.lit(0.0))))
    long = d.crossJoin(F.broadcast(stats)).select(p.alias("p"), F.col(event).cast("int").alias("e"), F.explode(F.array(*map(F.lit, map(float, thresholds)))).alias("threshold"))  # one row of statistics
    hit = F.col("p") >= F.col("threshold")
    out = long.groupBy("threshold").agg(F.count("*").alias("n"), F.sum("e").alias("events"), F.count(F.when(hit, 1)).alias("n_flagged"), F.count(F.when(hit & (F.col("e") == 1), 1)).alias("tp"))
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return out.select("threshold", "n_flagged", ((F.col("tp") - (F.col("n_flagged") - F.col("tp")) * odds) / F.col("n")).alias("nb_model"), ((F.col("events") - (F.col("n") - F.col("events")) * odds) / F.col("n")).alias("nb_treat_all"))


def cox_kernel(x: np.ndarray, time: np.ndarray, event: np.ndarray, penalizer: float = 0.0, l1_ratio: float = 0.0, strata: np.ndarray | None = None, steps: int = 60) -> dict:
    """Cox regression with Efron ties: the mean log partial likelihood less penalizer * ((1 - l1) / 2 |b|^2 + l1 |b|_1, the
    latter smoothed), by Newton steps with halving. Columns are standardised (ddof 1) for the fit and the coefficients
    given back on their scale. Returns beta, se, loglik, loglik0, residuals (Schoenfeld, events x columns) and their times."""
    n, p = x.shape
    mu, sd = x.mean(0), x.std(0, ddof=1) if n > 1 else np.ones(p)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mu) / sd
    order = np.lexsort((-event, time))
    z, time, event = z[order], time[order], event[order].astype(bool)
    strata = np.zeros(n, int) if strata is None else np.unique(strata[order], return_inverse=True)[1]

    groups, (up, low) = [], np.triu_indices(p)
    for s in np.unique(strata):
        tt, ee = time[strata == s], event[strata == s]
        if ee.any():
            times, m = np.unique(tt[ee], return_counts=True)  # a time's events are the first of its rows
            groups.append((np.ascontiguousarray(z[strata == s].T), np.flatnonzero(ee), times, m, np.searchsorted(tt, times)))

    def sums(w: np.ndarray, zz: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of w, w z and w z z' (upper triangle) from each start to the next."""
        s0, s1, s2 = np.add.reduceat(w, starts), np.empty((p, len(starts))), np.empty((len(up), len(starts)))
        for i in range(p):
            wz = w * zz[i]
            s1[i] = np.add.reduceat(wz, starts)
            for at in np.flatnonzero(up == i):
                s2[at] = np.add.reduceat(wz * zz[low[at]], starts)
        return s0, s1, s2

    def parts(b: np.ndarray, residuals: bool = False):
        ll, g, h, res = 0.0, np.zeros(p), np.zeros((p, p)), []
        for zz, dead, times, m, first in groups:
            eta = b @ zz
            top = eta.max()
            w = np.exp(eta - top)
            begin = np.cumsum(m) - m
            s0, s1, s2 = (np.cumsum(v[..., ::-1], axis=-1)[..., ::-1] for v in sums(w, zz, first))  # at risk
            d0, d1, d2 = sums(w[dead], zz[:, dead], begin)
            at = np.repeat(np.arange(len(m)), m)
            f = (np.arange(len(at)) - begin[at]) / m[at]
            a0 = s0[at] - f * d0[at]
            e = (s1[:, at] - f * d1[:, at]) / a0
            ll += eta[dead].sum() - np.log(a0).sum() - top * len(at)
            g += zz[:, dead].sum(1) - e.sum(1)
            a2 = np.zeros((p, p))
            a2[up, low] = s2 @ np.add.reduceat(1 / a0, begin) - d2 @ np.add.reduceat(f / a0, begin)
            h += e @ e.T - (a2 + np.triu(a2, 1).T)
            if residuals:
                mean = np.add.reduceat(e, begin, axis=1) / m
                res.append((times[at], (zz[:, dead] - mean[:, at]).T))
        return ll, g, h, res

    def penalised(b: np.ndarray):
        ll, g, h, _ = parts(b)
        soft = np.sqrt(b * b + 1e-8)
        value = ll / n - penalizer * ((1 - l1_ratio) / 2 * b @ b + l1_ratio * soft.sum())
        return value, g / n - penalizer * ((1 - l1_ratio) * b + l1_ratio * b / soft), h / n - penalizer * np.diag((1 - l1_ratio) + l1_ratio * 1e-8 / soft**3), ll

    b = np.zeros(p)
    value, g, h, ll = penalised(b)
    ll0 = ll
    for _ in range(steps):
        step = np.linalg.lstsq(-h + 1e-9 * np.eye(p), g, rcond=None)[0]
        size = 1.0
        while size > 1e-6:
            new = penalised(b + size * step)
            if new[0] >= value - 1e-12:
                break
            size /= 2
        moved = size * np.abs(step).max() if p else 0.0
        b, (value, g, h, ll) = b + size * step, new
        if moved < 1e-7:
            break
    cov = np.linalg.pinv(-h * n)
    _, _, _, res = parts(b, True)
    return {"beta": b / sd, "se": np.sqrt(np.maximum(np.diag(cov), 0)) / sd, "loglik": ll, "loglik0": ll0, "residuals": np.concatenate([r for _, r in res] or [np.zeros((0, p))]), "res_times": np.concatenate([t for t, _ in res] or [np.zeros(0)]), "cov": cov}


COX_SCHEMA = "term string, beta double, se double, hazard_ratio double, z double, p double, n long, events long, loglik double, lr_p double, ph_chi2 double, ph_p double, error string"


def cox(df: DataFrame, time: str, event: str, terms: Sequence[str], by: Sequence[str] = (), *, strata: str | None = None, penalizer: float = 0.0, l1_ratio: float = 0.0, least_rows: int = 20, least_events: int = 5) -> DataFrame:
    """One Cox fit per group, one row a term, with the test of proportional hazards (scaled Schoenfeld residuals against the
    rank of time). Rows with a null are dropped, terms that are constant in the group come out null; a group that is too
    small gives one row with ``error``. The group is one fit's design matrix and must fit into a task."""
    keys = list(by) or ["__all"]
    d = valid_outcomes(df, time, event).select(*by, F.col(time).cast("double").alias("__t"), F.col(event).cast("int").alias("__e"), *([F.col(strata).cast("string").alias("__s")] if strata else []), *[F.col(t).cast("double").alias(t) for t in terms]).na.drop()
    if not by:
        d = d.withColumn("__all", F.lit(0))
    kinds = dict(d.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        n, ev = len(pdf), int(pdf["__e"].sum())
        blank = dict.fromkeys(("beta", "se", "hazard_ratio", "z", "p", "loglik", "lr_p", "ph_chi2", "ph_p"))
        use = [t for t in terms if pdf[t].nunique() > 1]
        if n < least_rows or ev < least_events or not use:
            return pd.DataFrame([{**head, "term": None, **blank, "n": n, "events": ev, "error": "too few rows, events or terms"}])
        k = cox_kernel(pdf[use].to_numpy(float), pdf["__t"].to_numpy(float), pdf["__e"].to_numpy(int), penalizer, l1_ratio, pdf["__s"].to_numpy() if strata else None)
        lr = chi2_sf(max(0.0, 2 * (k["loglik"] - k["loglik0"])), len(use))
        rank = pd.Series(k["res_times"]).rank().to_numpy()
        rank = rank - rank.mean()
        scaled = ev * k["residuals"] @ k["cov"]
        rows = []
        for t in terms:
            if t not in use:
                rows.append({**head, "term": t, **blank, "n": n, "events": ev, "error": "constant"})
                continue
            i = use.index(t)
            b, s = k["beta"][i], k["se"][i]
            ph = float((rank @ scaled[:, i]) ** 2 / max(1e-300, ev * k["cov"][i, i] * (rank @ rank)))
            rows.append({**head, "term": t, "beta": b, "se": s, "hazard_ratio": float(np.exp(min(b, 700))), "z": b / s if s else None, "p": norm_sf2(b / s) if s else None, "n": n, "events": ev, "loglik": k["loglik"], "lr_p": lr, "ph_chi2": ph, "ph_p": chi2_sf(ph, 1), "error": None})
        return pd.DataFrame(rows)

    out = d.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + COX_SCHEMA)
    return out if by else out.drop("__all")


def cox_frame(df: DataFrame, group: str, covariates: Sequence[str], keep: Sequence[str], *, least_share: float = 0.8) -> tuple[DataFrame, list[str]]:
    """Design columns: dummies of ``group`` against its modal level (the smallest on ties), and the covariates that have values
    in ``least_share`` of the rows and more than one value. Returns the frame and its terms; one pass finds them."""
    stats = df.agg(F.count("*").alias("n"), F.mode(group, True).alias("ref"), F.array_sort(F.collect_set(group)).alias("levels"), *[F.count(c).alias(f"n_{c}") for c in covariates], *[F.count_distinct(c).alias(f"d_{c}") for c in covariates]).first()
    levels = [v for v in stats["levels"] or [] if v != stats["ref"]]
    good = [c for c in covariates if stats[f"n_{c}"] >= int(least_share * stats["n"]) and stats[f"d_{c}"] > 1]
    dummies = [F.when(F.col(group) == v, 1.0).otherwise(0.0).alias(f"{group}={v}") for v in levels]
    return df.select(*keep, *dummies, *[F.col(c).cast("double").alias(c) for c in good]), [*[f"{group}={v}" for v in levels], *good]


def risk_tertiles(df: DataFrame, score: str, cuts: tuple[float, float], out: str = "tertile") -> DataFrame:
    """Tertile by the training cuts: <= low, then >= high, else medium; a null score is medium, as a fitted score gives it."""
    c = F.col(score)
    return df.withColumn(out, F.when(c >= cuts[1], "high").when(c <= cuts[0], "low").otherwise("medium"))
