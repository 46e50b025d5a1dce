"""Data-quality checks. Each is one aggregation that ends in one row: name, status (PASS, WARN, FAIL, SKIP), message, evidence
(map of texts). A suite is the union of such rows, so it stays lazy until the report is read; only the report's rows are collected."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.metrics import calibration
from cohortloom.session import pearson

STATUS = ("PASS", "WARN", "FAIL", "SKIP")
#: Pairs of columns whose correlations one pass computes.
PAIR_BLOCK = 1_000
SCHEMA = "name string, status string, message string, evidence map<string,string>"


def _row(stats: DataFrame, name: str, status: Column, message: Column, evidence: dict[str, Column] | None = None) -> DataFrame:
    pairs = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    e = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return stats.select(F.lit(name).alias("name"), status.alias("status"), message.alias("message"), e.alias("evidence"))


def known(spark: SparkSession, name: str, status: str, message: str, evidence: dict[str, object] | None = None) -> DataFrame:
    """A row that needs no data (schema checks, checks of numbers already at hand)."""
    return spark.createDataFrame([(name, status, message, {k: str(v) for k, v in (evidence or {}).items()})], SCHEMA)


def _numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float")]


def no_nan(df: DataFrame, name: str) -> DataFrame:
    """FAIL if any cell is null or NaN."""
    bad = [F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if c in _numeric(df) else F.lit(False)) for c in df.columns]
    s = df.agg(F.coalesce(F.sum(sum((b.cast("long") for b in bad), F.lit(0))), F.lit(0)).alias("n"))
    return _row(s, name, F.when(F.col("n") > 0, "FAIL").otherwise("PASS"), F.concat(F.col("n").cast("string"), F.lit(" missing cells")), {"n": F.col("n")})


def no_inf(df: DataFrame, name: str) -> DataFrame:
    """FAIL if any numeric cell is infinite; tables without such columns pass."""
    cols = _numeric(df)
    s = df.agg(F.coalesce(F.sum(sum((F.when(F.abs(F.col(f"`{c}`")) == float("inf"), 1).otherwise(0) for c in cols), F.lit(0))), F.lit(0)).alias("n"))
    return _row(s, name, F.when(F.col("n") > 0, "FAIL").otherwise("PASS"), F.concat(F.col("n").cast("string"), F.lit(" infinite cells")), {"n": F.col("n")})


def shape(df: DataFrame, rows: int | None, columns: int | None, name: str) -> DataFrame:
    """FAIL if the numbers of rows or columns differ; None is any."""
    s = df.agg(F.count("*").alias("r"))
    ok = (F.col("r") == rows if rows is not None else F.lit(True)) & F.lit(columns is None or columns == len(df.columns))
    return _row(s, name, F.when(ok, "PASS").otherwise("FAIL"), F.concat(F.col("r").cast("string"), F.lit(f" x {len(df.columns)}")), {"rows": F.col("r"), "columns": F.lit(len(df.columns))})


def in_range(df: DataFrame, column: str, lo: float, hi: float, name: str, allow_null: bool = True) -> DataFrame:
    """FAIL on values outside [lo, hi] (and on nulls unless allowed); WARN if there is no value."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x), x)
    s = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.count(F.when(x.isNull(), 1)).alias("nulls"))
    bad = (F.col("lo") < lo) | (F.col("hi") > hi) | (F.lit(not allow_null) & (F.col("nulls") > 0))
    return _row(s, name, F.when(F.col("n") == 0, "WARN").when(bad, "FAIL").otherwise("PASS"), F.concat_ws(" to ", F.col("lo").cast("string"), F.col("hi").cast("string")), {"min": F.col("lo"), "max": F.col("hi"), "nulls": F.col("nulls")})


def unique_index(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """FAIL if a key occurs twice, with five of them."""
    d = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    s = d.agg(F.count("*").alias("dups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    five = d.select(F.concat_ws("|", *keys).alias("k")).orderBy("k").limit(5).agg(F.concat_ws(",", F.sort_array(F.collect_list("k"))).alias("examples"))
    s = s.crossJoin(F.broadcast(five))  # one row each
    return _row(s, name, F.when(F.col("dups") > 0, "FAIL").otherwise("PASS"), F.concat(F.col("dups").cast("string"), F.lit(" repeated keys")), {"keys": F.col("dups"), "extra_rows": F.col("extra"), "examples": F.col("examples")})


def has_columns(df: DataFrame, required: Sequence[str], name: str, soft: bool = False) -> DataFrame:
    gone = [c for c in required if c not in df.columns]
    return known(df.sparkSession, name, ("WARN" if soft else "FAIL") if gone else "PASS", f"missing: {gone}" if gone else "all there", {"missing": ",".join(gone)})


def aligned(a: DataFrame, b: DataFrame, key: str, name: str, least: int = 1) -> DataFrame:
    """FAIL if fewer than ``least`` keys are shared; PASS if the key sets are equal; else WARN."""
    x = a.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("a", F.lit(1))
    y = b.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("b", F.lit(1))
    s = x.join(y, "k", "full_outer").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
    return _row(s, name, F.when(F.col("both") < least, "FAIL").when((F.col("only_a") == 0) & (F.col("only_b") == 0), "PASS").otherwise("WARN"), F.concat(F.col("both").cast("string"), F.lit(" shared")), {c: F.col(c) for c in ("both", "only_a", "only_b")})


def balanced_binary(df: DataFrame, column: str, name: str, least: float = 0.05) -> DataFrame:
    """FAIL if values aren't 0 / 1 or there are none; WARN if the rarer class is under ``least``."""
    t = F.col(column).cast("string")
    v = F.when(t.isNotNull() & (F.lower(t) != "nan"), t)
    x = v.try_cast("double")
    s = df.agg(F.count(v).alias("n"), F.count(F.when(v.isNotNull() & (x.isNull() | ~x.isin(0.0, 1.0)), 1)).alias("odd"), F.avg(x).alias("p"))
    low = F.least(F.col("p"), 1 - F.col("p"))
    return _row(s, name, F.when((F.col("n") == 0) | (F.col("odd") > 0), "FAIL").when(low < least, "WARN").otherwise("PASS"), F.concat(F.lit("share of 1: "), F.round("p", 4).cast("string")), {"n": F.col("n"), "odd": F.col("odd"), "rate": F.col("p")})


def correlation_sign(df: DataFrame, a: str, b: str, sign: int, name: str, least: float = 0.0, least_rows: int = 10) -> DataFrame:
    """WARN on few rows, no correlation or a weak one; FAIL on the wrong sign."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = d.agg(pearson(a, b).alias("r"), F.count("*").alias("n"))
    return _row(s, name, F.when((F.col("n") < least_rows) | F.col("r").isNull() | F.isnan("r") | (F.abs("r") < least), "WARN").when(F.signum("r") != sign, "FAIL").otherwise("PASS"), F.concat(F.lit("r = "), F.round("r", 4).cast("string")), {"r": F.col("r"), "n": F.col("n")})


#: Plausible ranges of the 99 % quantile by kind of expression values.
PLAUSIBLE = {"tpm": (10.0, 1e6), "counts": (10.0, 1e8), "log2_tpm": (1.0, 20.0), "log2_intensity": (1.0, 20.0)}


def plausible_units(expr: DataFrame, kind: str, name: str, value: str = "value") -> DataFrame:
    """99 % quantile (sketch over all values) within the range of the kind; an unknown kind is a WARN."""
    s = expr.where(~F.isnan(value)).agg(F.percentile_approx(value, [0.01, 0.99], 10000).alias("q"))
    lo, hi = PLAUSIBLE.get(kind, (None, None))
    status = F.lit("WARN") if lo is None else F.when(F.col("q")[1].between(lo, hi), "PASS").otherwise("FAIL")
    return _row(s, name, status, F.concat(F.lit(f"{kind}: q99 "), F.round(F.col("q")[1], 4).cast("string")), {"q01": F.col("q")[0], "q99": F.col("q")[1]})


def symbol_like(expr: DataFrame, name: str, gene: str = "gene", most: float = 0.05) -> DataFrame:
    """FAIL if more than ``most`` of the genes look like database ids or probes, or aren't upper case."""
    g = expr.select(F.col(gene).alias("g")).where("g is not null").distinct()
    odd = F.regexp_like("g", F.lit(r"^(ENSG\d|\d+_at|ILMN_)")) | (F.col("g") != F.upper("g"))
    s = g.agg(F.count("*").alias("n"), F.count(F.when(odd, 1)).alias("odd"))
    return _row(s, name, F.when(F.col("n") == 0, "FAIL").when(F.col("odd") > most * F.col("n"), "FAIL").otherwise("PASS"), F.concat(F.col("odd").cast("string"), F.lit(" odd symbols")), {"n": F.col("n"), "odd": F.col("odd")})


def endpoint_encoding(df: DataFrame, name: str, binary: Sequence[str], times: Sequence[str], most_zero: float = 0.5) -> DataFrame:
    """FAIL if an event isn't 0 / 1, a time is negative, or more than ``most_zero`` of a time are 0."""
    aggs = [F.count(F.when(~F.col(c).cast("string").try_cast("double").isin(0.0, 1.0) | (F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()), 1)).alias(f"b_{c}") for c in binary]
    aggs += [a for c in times for a in (F.count(F.when(F.col(c) < 0, 1)).alias(f"n_{c}"), F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == 0).cast("double"))).alias(f"z_{c}"))]
    bad = reduce(lambda x, y: x | y, [F.col(f"b_{c}") > 0 for c in binary] + [(F.col(f"n_{c}") > 0) | (F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) > most_zero) for c in times])
    return _row(df.agg(*aggs), name, F.when(bad, "FAIL").otherwise("PASS"), F.lit("endpoint codes"), {c: F.col(c) for c in [f"b_{c}" for c in binary] + [f"n_{c}" for c in times]})


def disjoint(df: DataFrame, key: str, source: str, name: str) -> DataFrame:
    """FAIL if a key occurs in two sources: one aggregation over all pairs of sources at once."""
    s = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(source).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("shared"))
    return _row(s, name, F.when(F.col("shared") > 0, "FAIL").otherwise("PASS"), F.concat(F.col("shared").cast("string"), F.lit(" shared keys")), {"shared": F.col("shared")})


def feature_frame(df: DataFrame, key: str, prefix: str = "", high: float = 0.98) -> DataFrame:
    """Empty, all-null and infinite columns FAIL, constant ones WARN, pairs of |r| above ``high`` WARN. One pass for the columns,
    one for each block of ``PAIR_BLOCK`` pairs; every pair is looked at, however many columns there are."""
    cols = [c for c in df.columns if c != key and dict(df.dtypes)[c] in ("double", "float", "int", "bigint")]
    q = lambda c: F.col(f"`{c}`").cast("double")
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        x = F.when(~F.isnan(q(c)), q(c))
        aggs += [F.count(x).alias(f"n{i}"), F.count(F.when(F.abs(x) == float("inf"), 1)).alias(f"i{i}"), (F.max(x) - F.min(x)).alias(f"r{i}")]
    s = df.agg(*aggs)
    listed = lambda cond: F.concat_ws(",", *[F.when(cond(i), F.lit(c)) for i, c in enumerate(cols)])
    empty, inf = listed(lambda i: F.col(f"n{i}") == 0), listed(lambda i: F.col(f"i{i}") > 0)
    flat = listed(lambda i: (F.col(f"n{i}") > 0) & (F.col(f"r{i}") == 0))
    rows = [
        _row(s, f"{prefix}non_empty", F.when((F.col("n") == 0) | F.lit(not cols), "FAIL").otherwise("PASS"), F.col("n").cast("string")),
        _row(s, f"{prefix}all_null_columns", F.when(empty != "", "FAIL").otherwise("PASS"), empty),
        _row(s, f"{prefix}infinite_columns", F.when(inf != "", "FAIL").otherwise("PASS"), inf),
        _row(s, f"{prefix}constant_columns", F.when(flat != "", "WARN").otherwise("PASS"), flat),
    ]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if pairs:
        near = []
        for at in range(0, len(pairs), PAIR_BLOCK):
            block = pairs[at : at + PAIR_BLOCK]
            c = df.agg(*[pearson(q(a), q(b)).alias(f"c{i}") for i, (a, b) in enumerate(block)])
            near.append(c.select(F.lit(at).alias("at"), F.concat_ws(",", *[F.when(F.abs(F.col(f"c{i}")) > high, F.lit(f"{a}~{b}")) for i, (a, b) in enumerate(block)]).alias("near")))
        found = union(near).where("near <> ''").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "near"))), lambda x: x["near"])).alias("near"))  # a row a block
        rows.append(_row(found, f"{prefix}near_duplicate_columns", F.when(F.col("near") != "", "WARN").otherwise("PASS"), F.col("near")))
    return union(rows)


def score_scale(df: DataFrame, columns: Sequence[str], name: str, z_like: bool = True) -> DataFrame:
    """FAIL if an sd is 0 or the largest is over 1000 times the smallest; WARN if z-like scores have a mean beyond 0.5."""
    s = df.agg(*[a for i, c in enumerate(columns) for a in (F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}"), F.avg(F.col(f"`{c}`")).alias(f"m{i}"))])
    sd = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(columns))]
    low, high = (F.least(*sd), F.greatest(*sd)) if len(sd) > 1 else (sd[0], sd[0])
    off = reduce(lambda x, y: x | y, [F.abs(F.col(f"m{i}")) > 0.5 for i in range(len(columns))])
    return _row(s, name, F.when((low <= 0) | (high / F.nullif(low, F.lit(0.0)) > 1000), "FAIL").when(F.lit(z_like) & off, "WARN").otherwise("PASS"), F.concat_ws(" to ", low.cast("string"), high.cast("string")), {"min_sd": low, "max_sd": high})


def no_leakage(splits: DataFrame, key: str, name: str, fold: str = "fold", role: str = "role") -> DataFrame:
    """FAIL if a key (row or group) is in train and test of one fold."""
    s = splits.where(F.col(key).isNotNull()).groupBy(fold, key).agg(F.count_distinct(role).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("leaks"))
    return _row(s, name, F.when(F.col("leaks") > 0, "FAIL").otherwise("PASS"), F.concat(F.col("leaks").cast("string"), F.lit(" leaks")), {"leaks": F.col("leaks")})


def permutation_sanity(null: DataFrame, metric: str, name: str, tol: float = 0.08) -> DataFrame:
    """FAIL if the mean metric of permuted labels is off 0.5 by more than ``tol``."""
    s = null.agg(F.avg(metric).alias("m"), F.count(metric).alias("n"))
    return _row(s, name, F.when(F.abs(F.col("m") - 0.5) <= tol, "PASS").otherwise("FAIL"), F.concat(F.lit("mean "), F.round("m", 4).cast("string")), {"mean": F.col("m"), "n": F.col("n")})


def seed_stability(runs: DataFrame, metric: str, name: str, most: float = 0.03) -> DataFrame:
    """FAIL if the sd (ddof 0) over seeds exceeds ``most``."""
    s = runs.agg(F.stddev_pop(metric).alias("s"))
    return _row(s, name, F.when(F.col("s") <= most, "PASS").otherwise("FAIL"), F.concat(F.lit("sd "), F.round("s", 5).cast("string")), {"sd": F.col("s")})


def calibrated(df: DataFrame, label: str, prob: str, name: str, most_ece: float = 0.10, most_brier: float = 0.25) -> DataFrame:
    s = calibration(df, label, prob)
    return _row(s, name, F.when((F.col("ece") <= most_ece) & (F.col("brier") <= most_brier), "PASS").otherwise("WARN"), F.concat_ws(" / ", F.round("ece", 4).cast("string"), F.round("brier", 4).cast("string")), {"ece": F.col("ece"), "brier": F.col("brier")})


def gate(spark: SparkSession, name: str, value: float | None, ok: Callable[[float], bool], otherwise: str, message: str = "") -> DataFrame:
    """A threshold on a number at hand: consensus PAC, NMF stability, C-index, self-prediction; None is a SKIP."""
    if value is None or value != value:
        return known(spark, name, "SKIP", "no value")
    return known(spark, name, "PASS" if ok(value) else otherwise, message or f"{value:.4g}", {"value": value})


def cluster_sizes(df: DataFrame, cluster: str, name: str, least: float = 0.05) -> DataFrame:
    """WARN if a cluster has under ``least`` of the rows."""
    s = df.groupBy(cluster).agg(F.count("*").alias("n")).agg((F.min("n") / F.sum("n")).alias("f"))
    return _row(s, name, F.when(F.col("f") < least, "WARN").otherwise("PASS"), F.concat(F.lit("least share "), F.round("f", 4).cast("string")), {"least": F.col("f")})


def subtype_redundancy(df: DataFrame, cluster: str, subtype: str, name: str, most: float = 0.95, least_rows: int = 20, least_cluster: int = 5) -> DataFrame:
    """WARN if a cluster (of ``least_cluster`` rows or more) is almost one subtype, or if there are few rows."""
    d = df.where(F.col(cluster).isNotNull() & F.col(subtype).isNotNull()).groupBy(cluster, subtype).agg(F.count("*").alias("n"))
    per = d.groupBy(cluster).agg(F.sum("n").alias("t"), (F.max("n") / F.sum("n")).alias("f"))
    s = per.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.max(F.when(F.col("t") >= least_cluster, F.col("f"))), F.lit(0.0)).alias("f"))
    return _row(s, name, F.when((F.col("n") < least_rows) | (F.col("f") > most), "WARN").otherwise("PASS"), F.concat(F.lit("largest share "), F.round("f", 4).cast("string")), {"share": F.col("f"), "n": F.col("n")})


def event_rate(df: DataFrame, event: str, name: str, least: int = 20, least_rate: float = 0.05) -> DataFrame:
    """FAIL if there is no outcome; WARN under ``least`` events or ``least_rate``."""
    s = df.where(F.col(event).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(event).cast("long")), F.lit(0)).alias("e"))
    return _row(s, name, F.when(F.col("n") == 0, "FAIL").when((F.col("e") < least) | (F.col("e") / F.nullif(F.col("n"), F.lit(0)) < least_rate), "WARN").otherwise("PASS"), F.concat(F.col("e").cast("string"), F.lit(" events of "), F.col("n").cast("string")), {"events": F.col("e"), "n": F.col("n")})


def union(rows: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


@dataclass
class Check:
    """A lazy check: its function gives rows; an exception becomes a FAIL row."""

    name: str
    run: Callable[[], DataFrame]

    def rows(self, spark: SparkSession) -> list[dict]:
        try:
            return [r.asDict() for r in self.run().collect()]  # a few rows
        except Exception as e:  # noqa: BLE001
            return [{"name": self.name, "status": "FAIL", "message": f"{type(e).__name__}: {e}"[:500], "evidence": {}}]


@dataclass
class Report:
    results: list[dict] = field(default_factory=list)

    def add(self, rows: DataFrame | list[dict], prefix: str = "") -> Report:
        for r in rows if isinstance(rows, list) else [x.asDict() for x in rows.collect()]:
            self.results.append({**r, "name": prefix + r["name"]})
        return self

    def counts(self) -> dict[str, int]:
        return {s: sum(r["status"] == s for r in self.results) for s in STATUS}

    def of(self, status: str) -> list[dict]:
        return [r for r in self.results if r["status"] == status]

    def all_passed(self) -> bool:
        return all(r["status"] in ("PASS", "SKIP") for r in self.results)

    def require(self, strict: bool = False) -> None:
        """Hard gate: raises if anything failed (or, strict, warned)."""
        bad = self.of("FAIL") + (self.of("WARN") if strict else [])
        if bad:
            raise ValueError("; ".join(f"{r['name']}: {r['message']}" for r in bad))

    def to_json(self) -> str:
        safe = lambda v: None if isinstance(v, float) and not np.isfinite(v) else v
        return json.dumps({"counts": self.counts(), "results": [{k: safe(v) for k, v in r.items()} for r in self.results]}, indent=1)

    def to_text(self) -> str:
        return "\n".join([f"[{r['status']}] {r['name']}: {r['message']}" for r in self.results] + [str(self.counts())])
