"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import stage


def hash_to_min(edges: DataFrame, *, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``node``, ``first`` (the smallest node of its component).

    Hash-to-min with each cluster kept as (node, member) rows: a node sends its whole cluster to the smallest member and
    that member to all of the cluster, until nothing changes; so no cluster is ever gathered into one row or task, and
    the smallest node of a component ends with all of it. The number of rounds is logarithmic in the longest path.
    Self-loops and repeated edges are allowed and nulls ignored; no edges give no rows. More than ``rounds`` rounds raise
    RuntimeError rather than give parts of components."""
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    pairs = stage(e.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))).alias("p")).select("p.*").distinct(), "graph")
    before = None
    for _ in range(rounds):
        low = stage(pairs.groupBy("v").agg(F.min("u").alias("m")), "low")  # written, so that a hot node's side of the join can be split
        sent = pairs.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p")).select("p.*")
        pairs = stage(sent.distinct(), "graph")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("first"))
        before = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def linked_sets(df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """Rows linked, directly or through others, by an equal non-null key: ``row``, ``first`` (the smallest linked row).

    Every row with a non-null id comes out once, an unlinked one as its own first. Each key's rows are first reduced to
    edges to the smallest of them (a map-side minimum), so a key that holds a third of the rows costs as many edges as it
    has rows. Both sides of each join are written tables, so AQE splits the partition of a hot key (an aggregate between
    exchange and join would forbid it; a test looks at the plan). Repeated ids are one row."""
    long = df.select(F.col(row).alias("row"), F.explode(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key"))) for k, c in keys.items()])).alias("k")).where("row is not null and k is not null").select("row", "k.*")
    long = stage(long, "keys")
    stars = stage(long.groupBy("kind", "key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("kind", "key", "low"), "stars")
    edges = long.join(stars, ["kind", "key"]).where("row > low").select(F.col("low").alias("a"), F.col("row").alias("b")).distinct()
    first = hash_to_min(edges).withColumnRenamed("node", "row")
    return df.select(F.col(row).alias("row")).where("row is not null").distinct().join(first, "row", "left").select("row", F.coalesce("first", "row").alias("first"))


def assign_splits(df: DataFrame, row: str, first: str, plan: dict[str, float], strata: list[Column], *, seed: int = 7, rounds: int = 8) -> DataFrame:
    """Each row's split: ``row``, ``first``, ``split_name``. Rows of one component (equal ``first``) share their split.

    A component's stratum is that of most of its rows (the first by name on ties; NULL is a stratum). Every component is
    assigned by weighted rendezvous hashing: the split with the largest -w / ln(hash(component, split)) wins. A split's weight
    shrinks with the component's size, to next to nothing for one that would fill the split's part of all rows. Plain weights
    meet the proportions in expectation only, so they are calibrated: ``rounds`` times, a weight by stratum and one over
    all strata are moved by the share of rows that the split lacks, and the best are kept. A component's split depends on its hash, its size and its
    stratum's weights alone, so few rows move when the plan or the data change a little. ``plan``: split name to fraction, any positive scale; an empty plan gives no rows. Ids of any type; rows with a null ``first`` are left out."""
    names, total = sorted(s for s in plan if plan[s] > 0), sum(plan.values())
    share = {s: plan[s] / total for s in names}
    rows = df.select(F.col(row).alias("row"), F.col(first).alias("first"), F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in strata] or [F.lit("")]).alias("stratum"))
    rows = stage(rows.where("first is not null"), "rows")
    if not names:
        return rows.select("row", "first", F.lit(None).cast("string").alias("split_name")).limit(0)
    mix = rows.groupBy("first", "stratum").agg(F.count("*").alias("n"))
    comp = mix.groupBy("first").agg(F.max(F.struct("n", "stratum")).alias("top"), F.sum("n").alias("n")).select("first", "top.stratum", "n")
    drawn = [(F.pmod(F.xxhash64(F.lit(seed), F.col("first"), F.lit(s)), F.lit(2**52)).cast("double") + 0.5) / float(2**52) for s in names]
    comp = stage(comp.select("first", "stratum", "n", *[(-F.log(d)).alias(f"e{i}") for i, d in enumerate(drawn)]), "components")
    sizes = comp.groupBy("stratum").agg(F.sum("n").alias("size"))
    weights = stage(sizes.select("stratum", "size", *[F.lit(share[s]).alias(f"w{i}") for i, s in enumerate(names)]), "weights")
    everywhere, every = [share[s] for s in names], float(comp.agg(F.sum("n")).first()[0] or 1)

    def chosen(weights: DataFrame, everywhere: list[float]) -> DataFrame:
        winner = F.array_max(F.array(*[F.struct((F.greatest(1 - F.col("n") / (share[s] * every), F.lit(1e-9)) * F.col(f"w{i}") * everywhere[i] / F.col(f"e{i}")).alias("score"), F.lit(i).alias("s")) for i, s in enumerate(names)]))["s"]
        return comp.join(weights, "stratum").select("first", "stratum", "n", winner.alias("s"))

    best = None
    for r in range(rounds):
        got = chosen(weights, everywhere).groupBy("stratum").agg(*[F.sum(F.when(F.col("s") == i, F.col("n")).otherwise(0)).alias(f"g{i}") for i in range(len(names))])
        got = stage(weights.join(got, "stratum"), "got")
        whole = got.agg(F.sum("size").alias("size"), *[F.sum(f"g{i}").alias(f"g{i}") for i in range(len(names))]).first()
        if not whole["size"]:
            break
        off = sum(abs(whole[f"g{i}"] - share[s] * whole["size"]) for i, s in enumerate(names))
        if best is None or off < best[0]:
            best = (off, weights, everywhere)
        everywhere = [w * ((share[s] * whole["size"] + 1) / (whole[f"g{i}"] + 1)) ** 0.5 for i, (w, s) in enumerate(zip(everywhere, names, strict=True))]
        if r < rounds - 1 - rounds // 3:  # the last rounds leave the strata and settle the whole
            lack = [F.pow((F.lit(share[s]) * F.col("size") + 1) / (F.col(f"g{i}") + 1), 0.5) for i, s in enumerate(names)]
            weights = stage(got.select("stratum", "size", *[(F.col(f"w{i}") * lack[i]).alias(f"w{i}") for i in range(len(names))]), "weights")
    if best is not None:  # of the weights tried, those that come nearest to the plan
        _, weights, everywhere = best
    label = F.element_at(F.array(*map(F.lit, names)), F.col("s") + 1)
    return rows.select("row", "first").join(chosen(weights, everywhere).select("first", label.alias("split_name")), "first").select("row", "first", "split_name")
