"""Classical tests over grouped counts and moments. Statistics are SQL aggregates; tails are computed on the result rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import special
from cohortloom.operators.relational import average_rank, quantile_bin
from cohortloom.session import pearson, ratio


def two_by_two(df: DataFrame, by: Sequence[str], exposed: Column, outcome: Column) -> DataFrame:
    """Counts of a 2 x 2 table within ``by``: a (exposed, event), b (exposed, none), c (not, event), d (not, none); null
    exposures and outcomes don't count."""
    n = lambda x, y: F.count(F.when((exposed == x) & (outcome == y), 1))
    return df.groupBy(*by).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))


def odds_effects(t: DataFrame) -> DataFrame:
    """Adds the Haldane-Anscombe odds ratio (+0.5 in each cell), its log, standard error, 95 % interval, and the difference of rates."""
    a, b, c, d = (F.col(x) + 0.5 for x in "abcd")
    lor, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return t.withColumns({"log_or": lor, "se": se, "odds_ratio": F.exp(lor), "ci_lo": F.exp(lor - 1.96 * se), "ci_hi": F.exp(lor + 1.96 * se), "rate_diff": ratio(F.col("a"), F.col("a") + F.col("b")) - ratio(F.col("c"), F.col("c") + F.col("d"))})


def bin_effects(df: DataFrame, value: str, by: Sequence[str], exposed: Column, outcome: Column) -> DataFrame:
    """Effects of the exposure within each tertile of ``value`` (tertiles within ``by``)."""
    binned = quantile_bin(df, value, by, out="tertile").where("tertile is not null")
    return odds_effects(two_by_two(binned, [*by, "tertile"], exposed, outcome))


def chi2_yates(t: DataFrame) -> DataFrame:
    """Adds chi2 (with Yates' correction) and Cramer's V of 2 x 2 counts; null where a margin is empty."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    off = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    chi = ratio(n * off * off, (a + b) * (c + d) * (a + c) * (b + d))
    return t.withColumns({"chi2": chi, "cramers_v": F.sqrt(ratio(chi, n))})


def chi2_table(df: DataFrame, by: Sequence[str], row: str, col: str) -> DataFrame:
    """Pearson's chi2 of an r x c table within ``by`` from its counts: chi2, df, cramers_v; nulls are a level (as text)."""
    cells = df.select(*by, F.coalesce(F.col(row).cast("string"), F.lit("nan")).alias("r"), F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias("c")).groupBy(*by, "r", "c").agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(*by, "r").agg(F.sum("o").alias("nr")), cells.groupBy(*by, "c").agg(F.sum("o").alias("nc"))
    total = cells.groupBy(*by).agg(F.sum("o").alias("n"), F.count_distinct("r").alias("kr"), F.count_distinct("c").alias("kc"))
    j = lambda x, y, k: x.join(y, k) if k else x.crossJoin(F.broadcast(y))  # noqa: E731  without keys: one row
    d = j(cells.join(rows, [*by, "r"]).join(cols, [*by, "c"]), total, list(by))
    chi = F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("nr") * F.col("nc"))) - F.max("n")  # empty cells add nothing to the sum of o^2 / e
    return d.groupBy(*by).agg(chi.alias("chi2"), ((F.max("kr") - 1) * (F.max("kc") - 1)).alias("df"), F.max("n").alias("n"), F.least(F.max("kr"), F.max("kc")).alias("k")).withColumn("cramers_v", F.sqrt(ratio(F.col("chi2"), F.col("n") * (F.col("k") - 1)))).drop("k", "n")


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way F from group sizes, means and variances: f_stat, df_between, df_within; groups of fewer than 2 values are left out."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n >= 2")
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    between, within = F.sum(F.col("n") * F.col("m") * F.col("m")) - s * s / n, F.sum((F.col("n") - 1) * F.col("v"))
    out = g.groupBy(*by).agg(between.alias("ssb"), within.alias("ssw"), (F.count("*") - 1).alias("df_between"), (n - F.count("*")).alias("df_within"))
    return out.where("df_between >= 1").select(*by, ratio(F.col("ssb") / F.col("df_between"), F.col("ssw") / F.col("df_within")).alias("f_stat"), "df_between", "df_within")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of mean ranks within ``by``, over the rows with both values."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumns({"__x": average_rank(x, by), "__y": average_rank(y, by)})
    return d.groupBy(*by).agg(pearson("__x", "__y").alias("rho"), F.count("*").alias("n"))


def correlation_pairs(df: DataFrame, entity: str, feature: str, value: str) -> DataFrame:
    """Pearson r of every pair of features (a < b) over the entities with both. For feature frames (tens to hundreds of columns)."""
    d = df.select(entity, feature, value).where(F.col(value).isNotNull())
    a, b = d.select(entity, F.col(feature).alias("a"), F.col(value).alias("x")), d.select(entity, F.col(feature).alias("b"), F.col(value).alias("y"))
    return a.join(b, entity).where("a < b").groupBy("a", "b").agg(pearson("x", "y").alias("r"), F.count("*").alias("n"))


def sign_test(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One-sided binomial test of negative signs: k of n below 0, p = P(X >= k) for a fair coin. Zeros and nulls don't count.
    The binomial terms are summed from the top by the ratio of neighbours, in logarithms, so nothing overflows for any n."""
    d = df.where(F.col(value) != 0).groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(F.col(value) < 0, 1)).alias("k"))
    start = F.struct((F.col("n") * F.log(F.lit(0.5))).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.col("n"), F.lit(1).cast("bigint"), F.lit(-1).cast("bigint")), start, lambda acc, i: F.struct((acc["t"] + F.log(i / (F.col("n") - i + 1))).alias("t"), (acc["s"] + F.when(i >= F.col("k"), F.exp(acc["t"])).otherwise(0.0)).alias("s")), lambda acc: acc["s"])
    return d.withColumn("p_one_sided", F.when(F.col("k") == 0, 1.0).otherwise(F.least(F.lit(1.0), total)))


def random_effects(df: DataFrame, effect: str, se: str, by: Sequence[str] = ()) -> DataFrame:
    """DerSimonian-Laird meta-analysis: k, q, tau2, pooled effect, its se and 95 % interval on the scale of ``effect``."""
    d = df.where(F.col(effect).isNotNull() & (F.col(se) > 0)).withColumn("w", 1 / (F.col(se) * F.col(se)))
    y = F.col(effect)
    sums = d.groupBy(*by).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") ** 2).alias("sw2"), F.sum(F.col("w") * y).alias("swy"), F.sum(F.col("w") * y * y).alias("swyy"))
    q = F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") ** 2 / F.col("sw"))
    sums = sums.withColumn("q", q).withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sw2") / F.col("sw")), F.lit(0.0)))).select(*by, "k", "q", "tau2")
    d = (d.join(sums, list(by)) if by else d.crossJoin(F.broadcast(sums))).withColumn("ws", 1 / (F.col(se) ** 2 + F.col("tau2")))  # without groups: one row
    out = d.groupBy(*by, "k", "q", "tau2").agg((F.sum(F.col("ws") * y) / F.sum("ws")).alias("pooled"), F.sqrt(1 / F.sum("ws")).alias("pooled_se"))
    return out.withColumns({"ci_lo": F.col("pooled") - 1.96 * F.col("pooled_se"), "ci_hi": F.col("pooled") + 1.96 * F.col("pooled_se")})


def min_detectable_or(n: Column, p: Column) -> Column:
    """exp(2.8 sqrt(2 / (n p (1 - p)))); infinite under 20 rows."""
    return F.when(n < 20, F.lit(float("inf"))).otherwise(F.exp(2.8 * F.sqrt(ratio(F.lit(2.0), n * p * (1 - p)))))


def with_tail(df: DataFrame, kind: str, columns: Sequence[str], out: str) -> DataFrame:
    """Adds a tail probability to result rows: ``norm`` (z), ``chi2`` (x, df), ``f`` (f, df1, df2), ``t`` (t, df), ``fisher`` (a, b, c, d)."""
    fn = {"norm": special.norm_sf2, "chi2": special.chi2_sf, "f": special.f_sf, "t": special.t_sf2, "fisher": lambda *x: special.fisher_exact(*map(int, x))[1]}[kind]

    def tails(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*cols, strict=True)], dtype="float64")

    return df.withColumn(out, F.pandas_udf(tails, "double")(*[F.col(c).cast("double") for c in columns]))
