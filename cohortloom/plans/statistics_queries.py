"""Queries whose results rest on numeric kernels or draws (no SQL says the same; tests compare them with brute force), the
treatment-interaction pipelines, and the data-quality checks (with SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.clean import cohort_key, receptor_code, stage_code
from cohortloom.operators import classical, factorise, metrics, models, quality, relational, resampling, scaling, scoring, survival
from cohortloom.plans.reference_queries import AGE, SURV, TRIAL, ages, arm_tables, composites, labelled, outcomes, query, r6, scores, trial
from cohortloom.session import stage, table
from cohortloom.streaming.checks import windowed_quality

FEATURES = ["lymph_core", "stroma_web", "vessel_growth", "low_oxygen", "antigen_show", "cell_cycle", "repair_gap", "hormone_drive"]


def feature_frame(s: SparkSession, d: str) -> DataFrame:
    """Samples x signatures, staged: many fits read it."""
    return stage(scoring.wide_scores(scores(s, d), FEATURES, prefix="").na.drop(), "features")


def discovery_frame(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """One row a sample, scaled for clustering and factorisation (medians for nulls, robust z, near-constant signatures left
    out, clipped), staged; and the signatures that are kept."""
    expr, sets = table(s, d, "expr"), table(s, d, "gene_sets")
    wide = stage(scoring.wide_mean_z(scoring.staged_expression(expr, sets), sets, FEATURES, scoring.measured_samples(expr)), "scores")
    x, names = scaling.wide_cluster_input(wide, "sample_id", FEATURES)
    return stage(x, "samples"), names


def trial_long(s: SparkSession, d: str) -> DataFrame:
    """(sample, signature, score) with arm, outcome and age: the long frame of all interaction pipelines."""
    return scores(s, d).join(trial(s, d), "sample_id").join(ages(s, d), "sample_id")


# ---- interaction pipelines -------------------------------------------------------------------------------------------
@query("interaction_by_signature")
def _(s, d):
    """Every signature's arm interaction, with false-discovery rates over all of them."""
    fits = models.interaction_logit(trial_long(s, d), "pcr", "score", "her2", ["age"], ["set_name"], least_rows=30).where("term = 'interaction' or error is not null")
    return relational.benjamini_hochberg(fits, "p", "q_bh")


@query("interaction_by_class")
def _(s, d):
    """Class composites: interaction, false-discovery rate, power and validity."""
    j = composites(s, d).join(trial(s, d), "sample_id").join(ages(s, d), "sample_id")
    fits = models.interaction_logit(j, "pcr", "composite", "her2", ["age"], ["class_name"], least_rows=30)
    rate = j.groupBy("class_name").agg(F.count("*").alias("n_rows"), F.avg("pcr").alias("rate"))
    out = fits.where("term = 'interaction' or error is not null").join(rate, "class_name").withColumn("mde", classical.min_detectable_or(F.col("n_rows"), F.col("rate")))
    return relational.benjamini_hochberg(out, "p", "q_bh")


@query("interaction_leave_one_out")
def _(s, d):
    """The immune composite without each of its components in turn."""
    parts = [("lymph_core", 1), ("interferon_call", 1), ("stroma_web", -1)]
    variants = [("all" if v is None else f"without_{v}", n, w) for v in (None, *[p for p, _ in parts]) for n, w in parts if n != v]
    comp = s.createDataFrame(variants, "class_name string, set_name string, sign int")
    j = scoring.signed_composite(scores(s, d), comp).join(trial(s, d), "sample_id")
    return models.interaction_logit(j, "pcr", "composite", "her2", [], ["class_name"]).where("term = 'interaction' or error is not null")


def class_trial(s: SparkSession, d: str) -> DataFrame:
    return stage(composites(s, d).join(trial(s, d), "sample_id").select("class_name", "sample_id", "composite", "her2", "pcr"), "trial")


@query("interaction_permutation")
def _(s, d):
    """Permutation p of each class's interaction (outcome shuffled within the arm), 1000 replicates."""
    j = class_trial(s, d)
    null = models.interaction_replicates(j, "sample_id", "pcr", "composite", "her2", ["class_name"], 1000)
    seen = models.interaction_logit(j, "pcr", "composite", "her2", [], ["class_name"]).where("term = 'interaction'").select("class_name", F.col("beta").alias("observed"))
    return resampling.permutation_p(null.join(F.broadcast(seen), "class_name"), F.col("observed"), "beta", ["class_name"], two_sided=True)  # a row a class


@query("interaction_subsample_stability")
def _(s, d):
    """By class, the share of 500 subsamples (60 % within the arm) in which the interaction has p < 0.05."""
    fits = models.interaction_replicates(class_trial(s, d), "sample_id", "pcr", "composite", "her2", ["class_name"], 500, fraction=0.6)
    return fits.groupBy("class_name").agg(F.count("*").alias("n"), F.median("p").alias("median_p"), F.avg((F.col("p") < 0.05).cast("double")).alias("share_p05"), F.avg((F.col("beta") < 0).cast("double")).alias("share_negative"))


@query("cross_arm_meta")
def _(s, d):
    """Effect by cohort, pooled by random effects, with the sign test: the cross-arm verdict in one row."""
    e = classical.odds_effects(arm_tables(s, d))
    m = classical.random_effects(e, "log_or", "se").withColumn("z", F.col("pooled") / F.col("pooled_se"))
    return classical.with_tail(m, "norm", ["z"], "p").crossJoin(F.broadcast(classical.sign_test(e, "log_or").select(F.col("n").alias("n_arms"), F.col("k").alias("n_negative"), F.col("p_one_sided").alias("p_sign"))))  # one row each


@query("fisher_by_cohort")
def _(s, d):
    return classical.with_tail(arm_tables(s, d), "fisher", ["a", "b", "c", "d"], "p_fisher")


@query("arm_balance")
def _(s, d):
    """Are arm and subtype independent within each cohort? chi2 and its tail."""
    r = table(s, d, "response_rows").select(cohort_key("name").alias("name"), F.upper(F.regexp_replace("arm", "[^A-Za-z]", "")).alias("arm"), "subtype")
    return classical.with_tail(classical.chi2_table(r, ["name"], "subtype", "arm"), "chi2", ["chi2", "df"], "p")


# ---- survival models -------------------------------------------------------------------------------------------------
@query("cox_by_cohort")
def _(s, d):
    j = outcomes(s, d).join(ages(s, d), "sample_id").join(trial(s, d).select("sample_id", "her2"), "sample_id")
    return survival.cox(j, "t", "e", ["age", "her2"], ["name"], penalizer=0.01)


@query("cox_stratified")
def _(s, d):
    j = outcomes(s, d).join(ages(s, d), "sample_id").join(trial(s, d).select("sample_id", "her2"), "sample_id")
    return survival.cox(j, "t", "e", ["age", "her2"], strata="name", penalizer=0.01)


@query("cox_interaction_by_signature")
def _(s, d):
    """Signature x arm in a Cox model, one fit per signature, with false-discovery rates."""
    j = scores(s, d).join(outcomes(s, d), "sample_id").join(trial(s, d).select("sample_id", "her2"), "sample_id").withColumn("interaction", F.col("score") * F.col("her2"))
    fits = survival.cox(j, "t", "e", ["score", "her2", "interaction"], ["set_name"], penalizer=0.05).where("term = 'interaction'")
    return relational.benjamini_hochberg(fits, "p", "q_bh")


@query("logrank_test")
def _(s, d):
    r = survival.logrank(outcomes(s, d), "t", "e", "name")
    return s.createDataFrame([(r["chi2"], r["df"], r["p"])], "chi2 double, df int, p double")


LOGRANK_SQL = """t AS (SELECT half, t, sum(e) AS d, count(*) AS c FROM sv GROUP BY 1, 2), p AS (SELECT x.half AS a, y.half AS b FROM (SELECT DISTINCT half FROM t) x JOIN (SELECT DISTINCT half FROM t) y ON x.half < y.half),
 u AS (SELECT a, b, t, sum(CASE WHEN half = a THEN d ELSE 0 END) AS da, sum(CASE WHEN half = b THEN d ELSE 0 END) AS db, sum(CASE WHEN half = a THEN c ELSE 0 END) AS ca, sum(CASE WHEN half = b THEN c ELSE 0 END) AS cb FROM p JOIN t ON half IN (a, b) GROUP BY 1, 2, 3),
 n AS (SELECT *, sum(ca) OVER w AS na, sum(cb) OVER w AS nb FROM u WINDOW w AS (PARTITION BY a, b ORDER BY t DESC))
 SELECT a, b, sum(da) AS observed, round(sum((da + db) * na / (na + nb)), 6) AS expected, round(sum(da - (da + db) * na / (na + nb)) ** 2 / sum(CASE WHEN na + nb > 1 THEN (da + db) * (na + nb - da - db) / (na + nb - 1) * na * nb / (na + nb) ** 2 ELSE 0 END), 6) AS chi2 FROM n WHERE da + db > 0 GROUP BY 1, 2"""


@query("logrank_pairwise", f"WITH {SURV.replace('event_os AS e', "event_os AS e, CASE WHEN name < 'l' THEN 'a-k' WHEN name < 'p' THEN 'l-o' ELSE 'p-z' END AS half")}, {LOGRANK_SQL}")
def _(s, d):
    o = outcomes(s, d).withColumn("half", F.when(F.col("name") < "l", "a-k").when(F.col("name") < "p", "l-o").otherwise("p-z"))
    return r6(survival.pairwise_logrank(o, "t", "e", "half"), "expected", "chi2")


@query("logrank_pairwise_q")
def _(s, d):
    """The same with tails and false-discovery rates."""
    o = outcomes(s, d).withColumn("half", F.when(F.col("name") < "l", "a-k").when(F.col("name") < "p", "l-o").otherwise("p-z"))
    p = classical.with_tail(survival.pairwise_logrank(o, "t", "e", "half").withColumn("df", F.lit(1)), "chi2", ["chi2", "df"], "p")
    return relational.benjamini_hochberg(p, "p", "q")


@query("risk_score_bootstrap")
def _(s, d):
    """Composite risk score (Cox on factors, age, stage and receptor status; the factors' part alone): C-index with the percentile
    interval of 200 bootstrap replicates, tertile cuts and sizes."""
    w = factor_weights(s, d)
    factors = [c for c in w.columns if c != "sample_id"]
    o = relational.first_of_key(outcomes(s, d).where("sample_id is not null"), ["sample_id"], ["ep_id"], ["t", "e"])
    k = relational.first_of_key(table(s, d, "clinical").where("sample_id is not null"), ["sample_id"], ["rec_id"], ["age", "stage", "subtype_er", "subtype_her2"])
    clinical = {"age": F.col("age"), "stage": stage_code("stage"), "er": F.when(receptor_code("subtype_er") == "POS", 1).when(receptor_code("subtype_er") == "NEG", 0), "her2": F.col("subtype_her2")}
    j = stage(w.join(o, "sample_id").join(k.select("sample_id", *[c.cast("double").alias(n) for n, c in clinical.items()]), "sample_id"), "risk")
    risk, cuts = survival.composite_risk(j, "t", "e", factors, list(clinical))
    risk = stage(risk, "scored")
    sizes = risk.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("tertile") == v, 1)).alias(f"n_{v}") for v in ("low", "medium", "high")])
    seen = risk.select("t", "e", "risk").withColumn("weight", F.lit(1)).withColumn("rep", F.lit(0)).groupBy("rep").applyInPandas(lambda p: p.assign(c_index=survival.concordance_kernel(*(p[c].to_numpy() for c in ("t", "e", "risk", "weight"))))[["c_index"]].head(1), "c_index double")
    ci = resampling.percentile_interval(survival.bootstrap_concordance(risk, "sample_id", "t", "e", "risk", 200), "c_index")
    return seen.crossJoin(ci).crossJoin(sizes).withColumns({"low_cut": F.lit(cuts[0]), "high_cut": F.lit(cuts[1])})  # one row each


# ---- classifiers, factors, clusters ----------------------------------------------------------------------------------
@query("out_of_fold_auc")
def _(s, d):
    """Pooled out-of-fold AUC of several models, each against the clinical one."""
    f = feature_frame(s, d).join(trial(s, d), "sample_id").join(ages(s, d), "sample_id")
    f = stage(resampling.stratified_folds(f, "pcr", "sample_id", 5), "folds")
    zoo = {"clinical": (["age", "her2"], models.RidgeLogit), "signatures": (FEATURES, models.RidgeLogit), "elastic_all": ([*FEATURES, "age", "her2"], models.ElasticLogit), "random_columns": (FEATURES, models.RandomColumns), "stacked": ([*FEATURES, "age", "her2"], lambda: models.Stacked([models.RidgeLogit(columns=["age", "her2"]), models.RidgeLogit(columns=FEATURES)]))}
    parts = [metrics.auc(models.out_of_fold(f, "sample_id", "pcr", cols, "fold", make), "outcome", "score").withColumn("model", F.lit(n)) for n, (cols, make) in zoo.items()]
    return relational.delta_to_baseline(quality.union(parts), "auc", F.col("model") == "clinical", "delta_vs_clinical")


@query("external_validation")
def _(s, d):
    """Trained on half of the samples (by hash), applied to the other half."""
    f = feature_frame(s, d).join(trial(s, d), "sample_id").withColumn("half", F.pmod(F.xxhash64("sample_id"), F.lit(2)))
    got = models.train_and_apply(f.where("half = 0"), f.where("half = 1"), "sample_id", "pcr", [*FEATURES, "her2"], models.RidgeLogit)
    return metrics.auc(got, "outcome", "score")


@query("nmf_stability")
def _(s, d):
    """Factorisations of all samples: 30 runs for each k."""
    x, names = discovery_frame(s, d)
    return factorise.nmf_stability(x, "sample_id", names, [3, 4, 5, 6], runs=30)[0]


def factor_weights(s: SparkSession, d: str) -> DataFrame:
    x, names = discovery_frame(s, d)
    stats, best = factorise.nmf_stability(x, "sample_id", names, [3, 4, 5, 6], runs=30)
    _, h, shift = best[factorise.select_k_nmf(stats)]
    return factorise.project_factors(x, "sample_id", h, shift=shift)


@query("factor_projection")
def _(s, d):
    """Factors of all samples at the selected k, then the weights of every sample on them."""
    return factor_weights(s, d)


@query("consensus_pac")
def _(s, d):
    """Consensus clustering of all samples, 100 subsamples of 80 %: the ambiguous share of pairs by k."""
    x, names = discovery_frame(s, d)
    return factorise.consensus_pac(x, "sample_id", names, [2, 3, 4, 5, 6], replicates=100)


@query("batch_adjusted")
def _(s, d):
    e = table(s, d, "expr").where("value is not null and not isnan(value) and batch is not null").select(F.upper(F.regexp_replace("gene", r"\s+", "")).alias("gene"), "batch", "sample_id", "value")
    out = scaling.batch_adjust(e, "gene", "batch", "sample_id", "value")
    return out.groupBy("gene", "batch").agg(F.round(F.avg("adjusted"), 6).alias("mean"), F.count("adjusted").alias("n"))


@query("factor_names")
def _(s, d):
    k = relational.first_of_key(table(s, d, "clinical").where("sample_id is not null and name is not null"), ["sample_id"], ["rec_id"], ["name"])
    profile = scores(s, d).join(k, "sample_id").groupBy(F.col("name").alias("cluster"), "set_name").agg(F.avg("score").alias("mean"))
    return factorise.name_by_features(profile, "cluster", "set_name", "mean", [("immune", ["lymph_core"], []), ("stromal", ["stroma_web"], [])])


# ---- quality ---------------------------------------------------------------------------------------------------------
@query("check_missing_and_infinite", "SELECT 'expr_missing' AS name, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) || ' missing cells' AS message FROM expr WHERE value IS NULL OR isnan(value) UNION ALL SELECT 'expr_inf', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) || ' infinite cells' FROM expr WHERE isinf(value)")
def _(s, d):
    v = table(s, d, "expr").select("value")
    return quality.union([quality.no_nan(v, "expr_missing"), quality.no_inf(v, "expr_inf")]).drop("evidence")


@query("check_range", "SELECT 'ki67' AS name, CASE WHEN count(x) = 0 THEN 'WARN' WHEN min(x) < 0 OR max(x) > 100 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT CASE WHEN NOT isnan(ki67) THEN ki67 END AS x FROM clinical) UNION ALL SELECT 'age', CASE WHEN count(age) = 0 THEN 'WARN' WHEN min(age) < 0 OR max(age) > 120 THEN 'FAIL' ELSE 'PASS' END FROM clinical")
def _(s, d):
    c = table(s, d, "clinical")
    return quality.union([quality.in_range(c, "ki67", 0, 100, "ki67"), quality.in_range(c, "age", 0, 120, "age")]).select("name", "status")


@query("check_unique_index", "SELECT 'samples' AS name, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) || ' repeated keys' AS message FROM (SELECT sample_id FROM endpoints GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'rows', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) || ' repeated keys' FROM (SELECT ep_id FROM endpoints GROUP BY 1 HAVING count(*) > 1)")
def _(s, d):
    e = table(s, d, "endpoints")
    return quality.union([quality.unique_index(e, ["sample_id"], "samples"), quality.unique_index(e, ["ep_id"], "rows")]).drop("evidence")


@query("check_alignment", "WITH a AS (SELECT DISTINCT sample_id FROM clinical WHERE sample_id IS NOT NULL), b AS (SELECT DISTINCT sample_id FROM endpoints WHERE sample_id IS NOT NULL), c AS (SELECT count(*) FILTER (a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL) AS n, count(*) FILTER (b.sample_id IS NULL) AS oa, count(*) FILTER (a.sample_id IS NULL) AS ob FROM a FULL JOIN b ON a.sample_id = b.sample_id) SELECT 'clinical_endpoints' AS name, CASE WHEN n < 10 THEN 'FAIL' WHEN oa = 0 AND ob = 0 THEN 'PASS' ELSE 'WARN' END AS status, n || ' shared' AS message FROM c")
def _(s, d):
    return quality.aligned(table(s, d, "clinical"), table(s, d, "endpoints"), "sample_id", "clinical_endpoints", 10).drop("evidence")


@query("check_binary_and_events", "SELECT 'pcr' AS name, CASE WHEN count(pcr) = 0 OR count(*) FILTER (pcr NOT IN (0, 1)) > 0 THEN 'FAIL' WHEN least(avg(pcr), 1 - avg(pcr)) < 0.05 THEN 'WARN' ELSE 'PASS' END AS status FROM endpoints UNION ALL SELECT 'events', CASE WHEN count(event_os) = 0 THEN 'FAIL' WHEN sum(event_os) < 20 OR avg(event_os) < 0.05 THEN 'WARN' ELSE 'PASS' END FROM endpoints")
def _(s, d):
    e = table(s, d, "endpoints")
    return quality.union([quality.balanced_binary(e, "pcr", "pcr"), quality.event_rate(e, "event_os", "events")]).select("name", "status")


@query("check_cohorts_disjoint", "SELECT 'cohorts' AS name, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) || ' shared keys' AS message FROM (SELECT sample_id FROM clinical WHERE sample_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1)")
def _(s, d):
    return quality.disjoint(table(s, d, "clinical"), "sample_id", "name", "cohorts").drop("evidence")


@query("check_leakage", "WITH f AS (SELECT row_id, block_id, (row_number() OVER (PARTITION BY pcr ORDER BY row_id) - 1) % 5 AS fold FROM response_rows), r AS (SELECT k.fold AS fold, f.block_id, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS role FROM f, (SELECT DISTINCT fold FROM f) k) SELECT 'blocks' AS name, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) || ' leaks' AS message FROM (SELECT fold, block_id FROM r WHERE block_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT role) > 1)")
def _(s, d):
    f = resampling.stratified_folds(table(s, d, "response_rows").select("row_id", "block_id", "pcr"), "pcr", "row_id", 5, seed=None).withColumnRenamed("fold", "own")
    r = f.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("role", F.when(F.col("own") == F.col("fold"), "test").otherwise("train"))
    return quality.no_leakage(r, "block_id", "blocks").drop("evidence")


@query("check_redundancy_and_sizes", "WITH t AS (SELECT name, subtype_pam50 AS s, count(*) AS n FROM clinical WHERE name IS NOT NULL AND subtype_pam50 IS NOT NULL GROUP BY 1, 2), p AS (SELECT name, sum(n) AS t, max(n) / sum(n) AS f FROM t GROUP BY 1) SELECT 'redundancy' AS name, CASE WHEN sum(t) < 20 OR max(f) FILTER (t >= 5) > 0.95 THEN 'WARN' ELSE 'PASS' END AS status FROM p UNION ALL SELECT 'sizes', CASE WHEN min(n) / sum(n) < 0.05 THEN 'WARN' ELSE 'PASS' END FROM (SELECT name, count(*) AS n FROM clinical GROUP BY 1)")
def _(s, d):
    c = table(s, d, "clinical")
    return quality.union([quality.subtype_redundancy(c, "name", "subtype_pam50", "redundancy"), quality.cluster_sizes(c, "name", "sizes")]).select("name", "status")


@query("check_calibration", f"WITH {AGE}, {TRIAL}, d AS (SELECT pcr AS y, age::DOUBLE / 100 AS p FROM tr JOIN ag USING (sample_id)), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y, sum((p - y) ** 2) AS se FROM d GROUP BY 1) SELECT 'age' AS name, CASE WHEN sum(n * abs(p - y)) / sum(n) <= 0.1 AND sum(se) / sum(n) <= 0.25 THEN 'PASS' ELSE 'WARN' END AS status FROM b")
def _(s, d):
    return quality.calibrated(labelled(s, d), "y", "p", "age").select("name", "status")


@query("check_symbols_and_units")
def _(s, d):
    e = table(s, d, "expr")
    return quality.union([quality.symbol_like(e, "symbols"), quality.plausible_units(e, "log2_intensity", "units"), quality.endpoint_encoding(table(s, d, "endpoints"), "endpoints", ["pcr", "event_os"], []), quality.has_columns(e, ["gene", "sample_id", "purity"], "columns", soft=True), quality.shape(e, None, 5, "shape")])


@query("check_feature_frame")
def _(s, d):
    f = feature_frame(s, d)
    return quality.union([quality.feature_frame(f, "sample_id", "features::"), quality.score_scale(f, FEATURES, "scale"), quality.correlation_sign(f, "lymph_core", "antigen_show", 1, "sign")])


@query("windowed_quality", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS n_null, round(avg(value) FILTER (NOT isnan(value)), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def _(s, d):
    return r6(windowed_quality(table(s, d, "events"), "ts", "value", "event_type"), "mean")



