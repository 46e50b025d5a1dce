"""Best representative of each duplicate group: Bayesian fusion with copy detection.

Every source (provider) has an accuracy, every pair of sources a probability that one copies the other. Both are
estimated from the data: values that are likely wrong and yet shared speak for copying; a copied vote is discounted; the
accuracy of a source is the mean posterior of what it says. A record that another one supersedes (no worse in recency and
trust, better in one of them or, where both are equal, of the smaller id) has practically no prior probability of being current. The
group's record is built field by field: the candidate of the highest posterior, votes and prior together. Only aggregated
evidence (one number per source, three per pair of sources) reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.session import stage

#: Sources with an accuracy and copying probabilities of their own; further (smaller) ones share theirs, but each still votes
#: and each of their records is a candidate.
MAX_SOURCES = 24


def _votes(claims: Column, acc: list[float], dep: list[list[float]], copy_rate: float, n_false: float) -> Column:
    """One (value, score) per claim: the discounted log-odds of the claim's source; copies of better sources count less."""
    size = len(acc)
    order = sorted(range(size), key=lambda s: (-acc[s], s))
    rank = F.array(*[F.lit(order.index(s)) for s in range(size)])
    weight = F.array(*[F.lit(math.log(n_false * acc[s] / (1 - acc[s]))) for s in range(size)])
    depend = F.array(*[F.lit(dep[s][t]) for s in range(size) for t in range(size)])

    def vote(x: Column) -> Column:
        better = F.filter(claims, lambda y: (y["value"] == x["value"]) & (F.get(rank, y["source"]) < F.get(rank, x["source"])))
        free = F.aggregate(better, F.lit(1.0), lambda a, y: a * (1 - F.lit(copy_rate) * F.get(depend, x["source"] * size + y["source"])))
        q = 1 - F.lit(copy_rate) * F.get(depend, x["source"] * size + x["source"])  # sources that share parameters: each further vote counts less
        votes = F.when(q < 1, (1 - F.pow(q, x["n"])) / (1 - q)).otherwise(x["n"])
        return F.struct(x["value"].alias("value"), x["source"].alias("source"), x["n"].alias("n"), (F.get(weight, x["source"]) * free * votes).alias("score"))

    return F.transform(claims, vote)


def _posteriors(votes: Column, n_false: float) -> Column:
    """Each vote with the posterior of its value: softmax of the values' scores, with n_false unseen values beside."""

    def score(v: Column) -> Column:
        return F.aggregate(F.filter(votes, lambda y: y["value"] == v), F.lit(0.0), lambda a, y: a + y["score"])

    values = F.array_distinct(F.transform(votes, lambda x: x["value"]))
    total = F.aggregate(F.transform(values, lambda v: F.exp(F.least(score(v), F.lit(500.0)))), F.lit(float(n_false)), lambda a, s: a + s)
    return F.transform(votes, lambda x: F.struct(x["value"].alias("value"), x["source"].alias("source"), x["n"].alias("n"), (F.exp(F.least(score(x["value"]), F.lit(500.0))) / total).alias("p")))


def fuse(
    df: DataFrame, group: Column, record: str, source: str, trust: Column, updated: Column, fields: dict[str, Column], *, copy_rate: float = 0.8, prior_copy: float = 0.2, n_false: float = 10.0, rounds: int = 3, max_sources: int = MAX_SOURCES
) -> DataFrame:
    """One row per group and field that has a usable value: the surviving value and the record it is taken from.

    ``fields``: usable values as text, NULL where there is none. ``trust``: a rank, 1 the most trusted (NULL: least);
    ``updated``: NULL counts as the oldest. Of each source its latest value votes. The survivor is the record of the highest
    posterior: its value's by the votes, times the prior of the record (see the module). Where one record supersedes all
    others (``undisputed``) it survives, the smallest id among records equal in recency and trust. Columns: ``group``,
    ``field``, ``value``, ``record``, ``posterior`` (of the value, by the votes), ``undisputed``, ``n_records`` (of the group, usable or not).

    Rows without a group are left out. Groups are reduced per source and trust before they are gathered, and sources beyond
    ``max_sources`` per value too, so a group of any size costs one small row. Repeated rows count as further records of the
    group. An empty table gives no rows."""
    rows = df.select(
        group.alias("group"), F.col(record).alias("rec"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), F.coalesce(trust.cast("int"), F.lit(2**30)).alias("trust"),
        F.coalesce(updated.cast("timestamp"), F.lit("0001-01-02").cast("timestamp")).alias("upd"), *[c.cast("string").alias(f"f_{i}") for i, c in enumerate(fields.values())],
    ).where("group is not null")
    late = [F.max(F.when(F.col(f"f_{i}").isNotNull(), F.struct("upd", (-F.col("rec")).alias("r"), F.col(f"f_{i}").alias("value")))).alias(f"l_{i}") for i in range(len(fields))]
    reduced = stage(rows.groupBy("group", "src", "trust").agg(F.count("*").alias("n"), *late), "fuse")
    names = [r["src"] for r in reduced.groupBy("src").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "src").limit(max_sources + 1).collect()]
    rare, names = len(names) > max_sources, names[:max_sources]
    size = len(names) + 1
    index = F.array_position(F.array(*[F.lit(s) for s in names] or [F.lit("")]), F.col("src"))
    reduced = reduced.withColumn("source", F.when(index > 0, index.cast("int") - 1).otherwise(size - 1))
    said = lambda i: F.struct("source", F.lit(1).alias("n"), F.col(f"l_{i}.value").alias("value"), F.col(f"l_{i}.upd").alias("upd"), (-F.col("trust")).alias("t"), F.col(f"l_{i}.r").alias("r"))
    if not rare:  # each source is told apart: at most max_sources rows a group and trust
        gathered = reduced.groupBy("group").agg(F.sum("n").alias("n_records"), *[F.collect_list(F.when(F.col(f"l_{i}").isNotNull(), said(i))).alias(f"c_{i}") for i in range(len(fields))])
        items = gathered.select("group", "n_records", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.array_sort(F.col(f"c_{i}")).alias("by")) for i, f in enumerate(fields)])).alias("x")).select("group", "n_records", "x.field", "x.by")
    else:
        cells = reduced.select("group", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f"l_{i}").isNotNull(), said(i)).alias("c")) for i, f in enumerate(fields)])).alias("x")).select("group", "x.field", "x.c.*").where("source is not null")
        cells = cells.groupBy("group", "field", "source", "t", "value").agg(F.sum("n").cast("int").alias("n"), F.max(F.struct("upd", "r")).alias("k"))
        items = cells.groupBy("group", "field").agg(F.array_sort(F.collect_list(F.struct("source", "n", "value", F.col("k.upd").alias("upd"), "t", F.col("k.r").alias("r")))).alias("by"))
        items = items.join(reduced.groupBy("group").agg(F.sum("n").alias("n_records")), "group")
    # a source's latest value votes, whatever trust it stood in
    newest = F.filter("by", lambda x: (x["source"] == size - 1) | ~F.exists("by", lambda y: (y["source"] == x["source"]) & ((y["upd"] > x["upd"]) | ((y["upd"] == x["upd"]) & (y["r"] > x["r"])))))
    items = stage(items.where(F.size("by") > 0).withColumn("claims", F.transform(newest, lambda b: F.struct(b["value"].alias("value"), b["source"].alias("source"), b["n"].alias("n")))), "claims")

    acc, dep = [0.8] * size, [[0.0] * size for _ in range(size)]
    dep[-1][-1] = prior_copy
    contested = items.where(F.size("claims") > 1)
    for step in range(rounds):
        post = contested.select(_votes(F.col("claims"), acc, dep, copy_rate, n_false).alias("v")).select(_posteriors(F.col("v"), n_false).alias("v"))
        own = F.transform("v", lambda x: F.struct(x["source"].alias("a"), F.lit(-1).alias("b"), (x["p"] * x["n"]).alias("right"), x["n"].cast("double").alias("wrong"), F.lit(0.0).alias("differ")))
        pairs = F.flatten(
            F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["source"] > x["source"]), lambda y: F.struct(
                x["source"].alias("a"), y["source"].alias("b"), F.when(x["value"] == y["value"], x["p"]).otherwise(0.0).alias("right"), F.when(x["value"] == y["value"], 1 - x["p"]).otherwise(0.0).alias("wrong"), F.when(x["value"] == y["value"], 0.0).otherwise(1.0).alias("differ"))))
        )
        seen = post.select(F.explode(F.concat(own, pairs)).alias("s")).groupBy("s.a", "s.b").agg(*[F.sum(f"s.{c}").alias(c) for c in ("right", "wrong", "differ")]).collect()
        acc = list(acc)
        for r in seen:
            if r["b"] < 0 and step:  # accuracies only once copied votes are discounted: else a copied majority vouches for itself
                acc[r["a"]] = min(0.98, max(0.3, (r["right"] + 8.0) / (r["wrong"] + 10.0)))
        for r in seen:
            if r["b"] >= 0:
                a, b = r["a"], r["b"]
                right, wrong = acc[a] * acc[b], (1 - acc[a]) * (1 - acc[b]) / n_false
                mean = (acc[a] + acc[b]) / 2
                # before copies are discounted nobody knows which shared values are wrong: only the agreement counts then
                true, false = (r["right"], r["wrong"]) if step else (r["right"] + r["wrong"], 0.0)
                llr = true * math.log(copy_rate * mean / right + 1 - copy_rate) + false * math.log(copy_rate * (1 - mean) / wrong + 1 - copy_rate) + r["differ"] * math.log(1 - copy_rate)
                dep[a][b] = dep[b][a] = 1 / (1 + (1 - prior_copy) / prior_copy * math.exp(-max(-500.0, min(500.0, llr))))

    done = items.withColumn("v", _votes(F.col("claims"), acc, dep, copy_rate, n_false)).withColumn("p", _posteriors(F.col("v"), n_false))

    # the prior of a superseded record is less than any posterior of the votes: the maximum is among the others
    open_ = F.filter("by", lambda x: ~F.exists("by", lambda y: (y["upd"] >= x["upd"]) & (y["t"] >= x["t"]) & ((y["upd"] > x["upd"]) | (y["t"] > x["t"]) | (y["r"] > x["r"]))))
    done = done.select("group", "field", "n_records", "p", open_.alias("open"))
    votes = lambda x: F.coalesce(F.array_max(F.transform(F.filter("p", lambda y: y["value"] == x["value"]), lambda y: y["p"])), F.lit(0.0))
    scored = F.transform("open", lambda x: F.struct(votes(x).alias("votes"), x["t"].alias("t"), x["upd"].alias("upd"), x["r"].alias("r"), x["value"].alias("value")))
    done = done.select("group", "field", "n_records", F.array_max(scored).alias("best"), (F.size("open") == 1).alias("undisputed"))
    return done.select("group", "field", F.col("best.value").alias("value"), (-F.col("best.r")).alias("record"), F.col("best.votes").alias("posterior"), "undisputed", "n_records")
