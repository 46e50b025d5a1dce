"""Scores of gene sets and composites over long expression (gene, sample_id, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.operators.scaling import zscore
from cohortloom.session import stage

#: Most pairs of gene and sample that are broadcast, and most samples that a scan is told by name.
MAX_KEYS, MAX_NAMED = 1_000_000, 100


def clean_expression(expr: DataFrame, gene: str = "gene", sample: str = "sample_id", value: str = "value") -> DataFrame:
    """One value per gene and sample: symbols in upper case without blanks, NaN and null dropped, repeated measurements by
    their median. Rows without a symbol (blank, NAN, ---) or sample are dropped; other columns are left out."""
    return _measured(expr, gene, sample, value).groupBy("gene", "sample_id").agg(F.median("value").alias("value"))


def _measured(expr: DataFrame, gene: str = "gene", sample: str = "sample_id", value: str = "value") -> DataFrame:
    g = F.upper(F.regexp_replace(F.col(gene), r"\s+", ""))
    d = expr.select(g.alias("gene"), F.col(sample).alias("sample_id"), F.when(~F.isnan(value), F.col(value)).alias("value"))
    return d.where("value is not null and sample_id is not null and gene is not null and gene not in ('', 'NAN', '---')")


def _spelled(expr: DataFrame, gene_sets: DataFrame | None) -> DataFrame:
    """``_measured`` by a table of the symbols' spellings, each cleaned once; of ``gene_sets`` only the genes in any set."""
    names = expr.select(F.col("gene").alias("__raw")).distinct().withColumn("gene", F.upper(F.regexp_replace("__raw", r"\s+", "")))
    names = names.where("gene not in ('', 'NAN', '---')")
    if gene_sets is not None:
        names = names.join(exploded_sets(gene_sets).select("gene"), "gene", "left_semi")
    d = expr.select(F.col("gene").alias("__raw"), "sample_id", F.when(~F.isnan("value"), F.col("value")).alias("value")).where("value is not null and sample_id is not null")
    return d.join(stage(names, "spellings"), "__raw").select("gene", "sample_id", "value")


def staged_expression(expr: DataFrame, gene_sets: DataFrame | None = None) -> DataFrame:
    """``clean_expression`` (of the genes in any of ``gene_sets``), staged with a sample's genes close to each other. The median of
    one or two values needs only the least and the largest; only pairs of more unequal values (pooled samples) are looked up
    again for an exact median."""
    measured = _spelled(expr, gene_sets)
    d = measured.withColumn("part", F.pmod(F.xxhash64("gene"), F.lit(4)))  # no sample is one task's alone
    few = d.repartition("sample_id", "part").groupBy("sample_id", "part", "gene").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("n") == 2, 0.5 * F.col("lo") + 0.5 * F.col("hi"))
    few = stage(few.select("gene", "sample_id", value.alias("value")), "expression")
    many = few.where("value is null").select("gene", "sample_id")
    n = many.count()
    if not n:
        return few
    pools = [r[0] for r in many.select("sample_id").distinct().limit(MAX_NAMED + 1).collect()]
    d = measured.where(F.col("sample_id").isin(pools)) if len(pools) <= MAX_NAMED else measured
    d = d.join(F.broadcast(many) if n <= MAX_KEYS else many, ["gene", "sample_id"], "left_semi")  # pairs that are counted, else a shuffle
    return few.where("value is not null").unionByName(stage(d.groupBy("gene", "sample_id").agg(F.median("value").alias("value")), "repeated"))


def exploded_sets(gene_sets: DataFrame) -> DataFrame:
    """(set_name, gene) of a table name, genes; symbols in upper case, each once a set."""
    return gene_sets.select(F.col("name").alias("set_name"), F.explode("genes").alias("gene")).select("set_name", F.upper(F.trim("gene")).alias("gene")).distinct()


def mean_z(expr: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Mean over the set's genes of the gene's z score (ddof 0, constant genes 0): set_name, sample_id, score.
    A set without any measured gene scores 0 in every sample."""
    sets = exploded_sets(gene_sets)
    z = zscore(expr.join(sets.select("gene").distinct(), "gene", "left_semi"), "value", ["gene"], "z")
    got = z.join(sets, "gene").groupBy("set_name", "sample_id").agg(F.avg("z").alias("score"))
    none = sets.select("set_name").distinct().join(sets.join(expr.select("gene").distinct(), "gene", "left_semi").select("set_name").distinct(), "set_name", "left_anti")
    samples = expr.select("sample_id").distinct()
    return got.unionByName(samples.join(none, F.lit(True)).select("set_name", "sample_id", F.lit(0.0).alias("score")))


def measured_samples(expr: DataFrame) -> DataFrame:
    """The samples of ``clean_expression``."""
    return _measured(expr).select("sample_id").distinct()


def wide_mean_z(expr: DataFrame, gene_sets: DataFrame, names: Sequence[str], samples: DataFrame | None = None) -> DataFrame:
    """``wide_scores`` of ``mean_z`` (6 places): a row for each sample with any score, a column for each set of ``names``. One pass
    over the expression for its genes' means, one for the scores; no rows of (set, sample) are formed. ``samples``: all samples,
    where ``expr`` has only the genes in sets; read only if a set without a measured gene gives each of them a score."""
    sets = exploded_sets(gene_sets)
    holds = {n: f"in_{i}" for i, n in enumerate(names)}
    member = sets.groupBy("gene").agg(*[F.max(F.col("set_name") == n).alias(c) for n, c in holds.items()])
    genes = expr.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).join(member, "gene")
    genes = stage(genes, "genes")
    seen = sets.join(genes.select("gene").withColumn("seen", F.lit(True)), "gene", "left").groupBy("set_name").agg(F.max(F.coalesce("seen", F.lit(False))).alias("seen"))
    none = {r["set_name"] for r in seen.where("not seen").collect()}  # sets without a measured gene score 0 in every sample
    z = F.coalesce((F.col("value") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")), F.when(F.col("m").isNotNull(), F.lit(0.0)))
    d = expr.join(genes, "gene").withColumn("z", z)
    got = d.groupBy("sample_id").agg(*[F.round(F.avg(F.when(F.col(c), F.col("z"))), 6).alias(n) for n, c in holds.items()])
    if none:
        got = (expr.select("sample_id").distinct() if samples is None else samples).join(got, "sample_id", "left")
    return got.select("sample_id", *[F.lit(0.0).alias(n) if n in none else n for n in names])


def mean_z_sample_sd(expr: DataFrame, genes: Sequence[str], out: str = "score", least: int = 1) -> DataFrame:
    """Mean z (ddof 1) of the listed genes present, by sample; null where fewer than ``least`` are."""
    z = zscore(expr.where(F.col("gene").isin([g.upper() for g in genes])), "value", ["gene"], "z", ddof=1)
    return z.groupBy("sample_id").agg(F.when(F.count("z") >= least, F.avg("z")).alias(out))


def geometric_pair(expr: DataFrame, gene_a: str, gene_b: str, out: str = "score") -> DataFrame:
    """sqrt(a * b) of two genes, negatives as 0; null where one is missing."""
    pick = lambda g: F.max(F.when(F.col("gene") == g, F.greatest(F.col("value"), F.lit(0.0))))
    return expr.where(F.col("gene").isin(gene_a, gene_b)).groupBy("sample_id").agg(F.sqrt(pick(gene_a) * pick(gene_b)).alias(out))


def signed_composite(scores: DataFrame, components: DataFrame, *, by: Sequence[str] = (), value: str = "score", out: str = "composite") -> DataFrame:
    """Sum of sign * z (ddof 1 over the samples at hand, constant scores centred) over the components present.

    ``components``: class_name, set_name, sign. ``by``: columns of ``scores`` that define the samples at hand. Returns
    class_name, sample_id (and ``by``), the composite and n_components; classes without components give no rows."""
    z = zscore(scores, value, [*by, "set_name"], "z", ddof=1, constant="centre")
    return z.join(components, "set_name").groupBy("class_name", "sample_id", *by).agg(F.sum(F.col("sign") * F.col("z")).alias(out), F.count("*").alias("n_components"))


def ssgsea(expr: DataFrame, gene_sets: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Single-sample enrichment (Barbie et al. 2009): set_name, sample_id, score = sum over ranks of P_hit - P_miss.

    Genes are ranked within the sample by descending value (ties by symbol); the i-th gene has the weight (N - i + 1) ** alpha.
    Only genes of the set enter: with N genes, k hits of which the j-th is at place r_j, the sum of P_hit is the sum of its
    weight share times the places from r_j to N, and P_miss is closed-form; so each set costs its own genes, not N.
    Sets with no gene or with all genes measured score 0 / are left out."""
    ranked = expr.select("gene", "sample_id", F.row_number().over(W.partitionBy("sample_id").orderBy(F.col("value").desc(), "gene")).alias("r"))
    n = expr.groupBy("sample_id").agg(F.count("*").alias("n"))
    hits = ranked.join(exploded_sets(gene_sets), "gene").join(n, "sample_id")
    w = F.pow((F.col("n") - F.col("r") + 1).cast("double"), F.lit(alpha))
    tail = F.col("n") - F.col("r") + 1
    sums = hits.groupBy("set_name", "sample_id", "n").agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * tail).alias("swt"), F.sum(tail.cast("double")).alias("st"))
    miss = (F.col("n") * (F.col("n") + 1) / 2 - F.col("st")) / (F.col("n") - F.col("k"))
    return sums.where("k < n").select("set_name", "sample_id", (F.col("swt") / F.col("sw") - miss).alias("score"))


def probes_to_genes(probes: DataFrame, probe_map: DataFrame, method: str = "max_variance") -> DataFrame:
    """Long probe values (probe, sample_id, value) to genes: the probe of the largest variance (ddof 1, then the smallest
    name) or the mean over probes. Probes without a gene are dropped."""
    d = probes.join(probe_map.where("gene is not null"), "probe")
    if method == "mean":
        return d.groupBy("gene", "sample_id").agg(F.avg("value").alias("value"))
    var = d.groupBy("gene", "probe").agg(F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    best = var.groupBy("gene").agg(F.min(F.struct((-F.col("v")).alias("v"), "probe")).alias("b")).select("gene", F.col("b.probe").alias("probe"))
    return d.join(best, ["gene", "probe"]).select("gene", "sample_id", "value")


def wide_scores(scores: DataFrame, names: Sequence[str], prefix: str = "sig__", value: str = "score") -> DataFrame:
    """One column per set, with an explicit list of sets (no extra pass to find them)."""
    wide = scores.groupBy("sample_id").pivot("set_name", list(names)).agg(F.first(value))
    return wide.select("sample_id", *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])
