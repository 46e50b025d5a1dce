"""Mapping free-entered values to a canonical list: character n-gram inverted index, weighted cosine, threshold and margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.functions.clean import BLANK
from cohortloom.session import stage

UNMATCHED = "UNMATCHED"


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams of a text with a mark at either end."""
    t = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))


def normalised(c: Column, noise: str, rewrites: list[tuple[str, str]]) -> Column:
    """Lower case; marks of editing (brackets, quotes, arrows) and ``noise`` words off; then the rewrites, in their order."""
    t = F.trim(F.regexp_replace(F.lower(c), BLANK + "+", " "))
    t = F.regexp_replace(t, noise, " ")
    for pattern, to in rewrites:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(t, " +", " "))


def normal_form(field: Column, value: Column, rules: dict[str, tuple[str, list[tuple[str, str]]]]) -> Column:
    """``normalised`` by the rules of the field; NULL for fields without rules."""
    out = F.lit(None).cast("string")
    for name, (noise, rewrites) in rules.items():
        out = F.when(field == name, normalised(value, noise, rewrites)).otherwise(out)
    return out


def map_to_canon(
    values: DataFrame, field: str, value: str, reference: DataFrame, rules: dict[str, tuple[str, list[tuple[str, str]]]], *, n: int = 2, threshold: float | dict[str, float] = 0.62, margin: float = 0.06
) -> DataFrame:
    """The entry that each distinct (field, value) names: ``field``, ``value``, ``entry`` (or ``UNMATCHED``), ``score``,
    ``runner_up`` (the score of the next entry).

    ``reference``: field, entry, surface (spellings of the entry, in normal form). ``rules``: by field, noise words and
    rewrites that bring a value to normal form. Values are made distinct first, so work follows the distinct values. An
    n-gram index of the surfaces (gram to surface and weight) gives the candidates; the score is the cosine of weighted
    gram sets, a gram weighing ln(1 + entries / entries with it); an entry is accepted at ``threshold`` (one, or one by field) or more if it is
    ``margin`` ahead of every other entry. Of a value's grams the commonest are not looked up, as many as can't lift a score to
    threshold - margin between them (Cauchy-Schwarz), so a large reference isn't joined by its frequent grams and no entry that
    matters is lost; ``score`` and ``runner_up`` are 0 where no entry comes near. A value equal to a surface scores 1. Nulls are no
    values; a value that is empty in normal form is unmatched; fields without a reference are unmatched. The index is a
    table like any other; its joins are left to the optimizer."""
    distinct = values.select(F.col(field).alias("field"), F.col(value).alias("value")).where("value is not null and field is not null").distinct()
    distinct = stage(distinct.withColumn("norm", normal_form(F.col("field"), F.col("value"), rules)), "values")
    forms = distinct.select("field", "norm").where("norm is not null and norm <> ''").distinct()
    surfaces = reference.select("field", "entry", "surface").distinct()
    ref = surfaces.select("field", "entry", "surface", F.explode(grams(F.col("surface"), n)).alias("gram"))
    kinds = surfaces.groupBy("field").agg(F.count_distinct("entry").alias("kinds"))
    weight = ref.groupBy("field", "gram").agg(F.count_distinct("entry").alias("df")).join(kinds, "field").select("field", "gram", F.log(1 + F.col("kinds") / F.col("df")).alias("w"))
    index = stage(ref.join(weight, ["field", "gram"]), "index")
    if isinstance(threshold, dict):
        least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv]), F.col("field")), F.lit(1.0))
    else:
        least = F.lit(threshold)
    length = index.groupBy("field", "entry", "surface").agg(F.sum(F.col("w") * F.col("w")).alias("norm2"))
    asked = forms.select("field", "norm", F.explode(grams(F.col("norm"), n)).alias("gram"))
    asked = asked.join(index.select("field", "gram", "w").distinct(), ["field", "gram"], "left").join(kinds, "field", "left")
    by_form = W.partitionBy("field", "norm")
    asked = asked.withColumn("own2", F.sum(F.pow(F.coalesce("w", F.log(1 + F.col("kinds"))), 2)).over(by_form)).where("w is not null")
    common = F.sum(F.col("w") * F.col("w")).over(by_form.orderBy("w", "gram").rowsBetween(W.unboundedPreceding, 0))  # commonest first
    asked = stage(asked.withColumn("look", common >= F.pow(F.greatest(least - margin, F.lit(0.0)), 2) * F.col("own2")), "asked")
    likely = asked.where("look").join(index, ["field", "gram"]).select("field", "norm", "entry", "surface", "own2").distinct()
    mine, theirs = asked.select("field", "norm", "gram"), index.select("field", "entry", "surface", "gram", "w")
    dot = likely.join(mine, ["field", "norm"]).join(theirs, ["field", "entry", "surface", "gram"]).groupBy("field", "norm", "entry", "surface", "own2").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    scored = dot.join(length, ["field", "entry", "surface"]).select("field", "norm", "entry", F.when(F.col("norm") == F.col("surface"), 1.0).otherwise(F.least(F.lit(0.999), F.col("dot") / F.sqrt(F.col("norm2") * F.col("own2")))).alias("score"))
    by_entry = scored.groupBy("field", "norm", "entry").agg(F.max("score").alias("score"))
    two = by_entry.withColumn("k", F.row_number().over(by_form.orderBy(F.desc("score"), F.desc("entry")))).where("k <= 2")
    ranks = two.groupBy("field", "norm").agg(F.max(F.when(F.col("k") == 1, F.struct("score", "entry"))).alias("top"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))
    best = ranks.select("field", "norm", "top.score", "runner_up", F.when((F.col("top.score") >= least) & (F.col("top.score") - F.col("runner_up") >= margin), F.col("top.entry")).alias("entry"))
    return distinct.join(best, ["field", "norm"], "left").select("field", "value", F.coalesce("entry", F.lit(UNMATCHED)).alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("runner_up", F.lit(0.0)).alias("runner_up"))
