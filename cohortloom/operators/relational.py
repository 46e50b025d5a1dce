"""Relational helpers: deduplication, coalescing joins, ranks, bins, false-discovery rates, top-k. DataFrame in, DataFrame out.

All keep to built-in expressions. Windows are partitioned by the caller's keys; where an operator is global by nature
(a rank over one result table), the docstring says so, and it is meant for aggregated results.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``: one aggregation with a map-side part, no sort of whole groups.
    Null keys are a key; ``columns`` are the other columns to keep."""
    pick = F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns]))
    return df.groupBy(*keys).agg(pick.alias("__m")).select(*keys, *[F.col(f"__m.__{c}").alias(c) for c in columns])


def coalesce_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the keys and columns of both; the left value holds unless it is null."""
    own = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in keys]
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    pick = lambda c: F.coalesce(*[F.col(f"{s}.`{c}`") for s, d in (("a", left), ("b", right)) if c in d.columns]).alias(c)
    return a.join(b, on, "full_outer").select(*map(pick, keys), *map(pick, own))


def overlay_join(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join in which the right value of ``columns`` wins unless it is null; other columns stay."""
    r = right.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns if c in right.columns])
    out = left.join(r, left[key] == F.col("__k"), "left").drop("__k")
    for c in columns:
        if c in right.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)) if c in left.columns else F.col(f"__{c}")).drop(f"__{c}")
    return out


def average_rank(value: Column | str, by: Sequence[str]) -> Column:
    """Rank from 1 within ``by``, ties sharing their mean rank."""
    w = W.partitionBy(*by).orderBy(value)
    same = W.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def percent_rank_average(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Mean rank divided by the number of non-null values in ``by``; null values get null."""
    rank = average_rank(value, list(by))
    nulls = F.count(F.when(F.col(value).isNull(), 1)).over(W.partitionBy(*by))  # nulls sort first
    n = F.count(F.col(value)).over(W.partitionBy(*by))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), (rank - nulls) / n))


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q values within ``by`` (the whole table if empty: for tables of results). Tied p share the smallest
    rank's bound through the running minimum; null p give null and don't count."""
    d = df.withColumn("__has", F.col(p).isNotNull())
    keys = [*by, "__has"]
    up, down = W.partitionBy(*keys).orderBy(F.col(p)), W.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(W.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    d = d.withColumn("__b", F.col(p) * n / F.row_number().over(up))
    return d.withColumn(out, F.when(F.col("__has"), F.least(F.lit(1.0), F.min("__b").over(down)))).drop("__b", "__has")


def delta_to_previous(df: DataFrame, value: str, order: str, out: str, by: Sequence[str] = (), relative: bool = False) -> DataFrame:
    """Difference to the previous row by ``order`` (the first row keeps its value); ``relative``: divided by the previous
    value, as gains in consensus area are given (the first row is null)."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(order))
    if relative:
        return df.withColumn(out, (F.col(value) - before) / F.nullif(before.cast("double"), F.lit(0.0)))
    return df.withColumn(out, F.coalesce(F.col(value) - before, F.col(value)))


def delta_to_baseline(df: DataFrame, value: str, is_baseline: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Difference to the baseline row of ``by``."""
    return df.withColumn(out, F.col(value) - F.max(F.when(is_baseline, F.col(value))).over(W.partitionBy(*by)))


def with_cuts(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], out: str = "cuts") -> DataFrame:
    """Adds exact quantiles (linear interpolation) of ``value`` within ``by``: an aggregate joined back, not a window."""
    cuts = df.groupBy(*by).agg(F.percentile(value, list(probs)).alias(out))
    if not by:
        return df.crossJoin(F.broadcast(cuts))  # one row
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by])
    return df.alias("l").join(cuts.alias("r"), on).select("l.*", f"r.{out}")


def quantile_bin(df: DataFrame, value: str, by: Sequence[str], labels: Sequence[str] = ("low", "mid", "high"), out: str = "bin") -> DataFrame:
    """Quantile bins, closed on the right, the lowest included. A value at a cut falls in the lower bin; nulls get null."""
    k = len(labels)
    d = with_cuts(df, value, by, [i / k for i in range(1, k)], "__cuts")
    case = F.when(F.col(value).isNull(), None)
    for i in range(k - 1):
        case = case.when(F.col(value) <= F.col("__cuts")[i] + 1e-9, labels[i])  # interpolation may miss a value by rounding
    return d.withColumn(out, case.otherwise(labels[-1])).drop("__cuts")


def high_low(df: DataFrame, value: str, by: Sequence[str], prob: float = 0.5, out: str = "half") -> DataFrame:
    """``high`` at or above the quantile ``prob`` within ``by``, else ``low``; nulls get null."""
    d = with_cuts(df, value, by, [prob], "__cuts")
    return d.withColumn(out, F.when(F.col(value).isNull(), None).when(F.col(value) >= F.col("__cuts")[0] - 1e-9, "high").otherwise("low")).drop("__cuts")


def unique_names(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Repeated names get ``_2``, ``_3`` by ``order``."""
    k = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(k == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), k.cast("string"))))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group (Spark prunes them per partition before the shuffle)."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def key_intersection(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys common to all; an empty intersection is the caller's error to raise."""
    return reduce(lambda a, b: a.intersect(b), [f.select(key).where(F.col(key).isNotNull()) for f in frames])


def shared_keys(df: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that occur in more than one source: ``key``, ``n_sources``. One aggregation, however many sources."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(source).alias("n_sources")).where("n_sources > 1")


def family(df: DataFrame, prefixes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Projection on the columns with one of the prefixes, after the keys."""
    return df.select(*keys, *[c for c in df.columns if c not in keys and c.startswith(tuple(prefixes))])


def ablation_grid(df: DataFrame, blocks: dict[str, Sequence[str]], grid: dict[str, Sequence[str]], keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Named unions of column blocks (block: prefixes)."""
    return {name: family(df, [p for b in parts for p in blocks[b]], keys) for name, parts in grid.items()}


def first_present(df: DataFrame, aliases: dict[str, Sequence[str]], kinds: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns from the first alias present; a typed null column where none is."""
    kinds = kinds or {}
    pick = lambda c, names: next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast(kinds.get(c, "string"))).alias(c)
    return df.select(*[pick(c, names) for c, names in aliases.items()])
