"""Queries of study frames, fitted scalers, confounding checks, survival models, suites and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.clean import cohort_key, receptor_code, stage_code
from cohortloom.operators import classical, confounding, frames, models, quality, relational, resampling, risk_models, scaling, scoring, suites, survival
from cohortloom.plans.reference_queries import AGE, COMP, COMPONENTS, SCORES, SURV, TRIAL, X, ages, composites, expression, outcomes, query, r6, scores, trial
from cohortloom.session import stage, table

SETS = ["antigen_show", "cell_cycle", "checkpoint_set", "fibre_wall", "hormone_drive", "interferon_call", "killer_act", "low_oxygen", "lymph_core", "matrix_turn", "mucin_coat", "myeloid_drift", "repair_gap", "stroma_web", "vessel_growth"]
MODULES = [("lymph", "immune"), ("interferon", "immune"), ("killer", "immune"), ("checkpoint", "immune"), ("antigen", "antigen"), ("stroma", "stroma"), ("fibre", "stroma"), ("matrix", "stroma"), ("vessel", "vascular"), ("low_oxygen", "vascular")]
TIS = ["QENL21", "QOL27", "QOT14", "XAL17", "XURL27", "XYLR19"]
ARMS = r"tr2 AS (SELECT name AS arm, tr.* FROM tr JOIN (SELECT sample_id, arg_min(name, rec_id) AS name FROM clinical WHERE sample_id IS NOT NULL AND name IS NOT NULL GROUP BY 1) USING (sample_id))"


# ---- frames ----------------------------------------------------------------------------------------------------------
def study_frame(s: SparkSession, d: str) -> DataFrame:
    e = expression(s, d)
    sc = stage(r6(scoring.mean_z(e, table(s, d, "gene_sets")), "score"), "scores")
    base = {"cyt": r6(scoring.geometric_pair(e, "QOT14", "XAL17"), "score"), "tis": r6(scoring.mean_z_sample_sd(e, TIS, least=5), "score")}
    return frames.feature_matrix(sc, SETS, r6(e, "value"), ["QOT14", "XAL17"], ages(s, d), ["age"], base)


@query("study_frame", f"""WITH {SCORES}, {AGE}, g AS (SELECT sample_id, max(round(v, 6)) FILTER (gene = 'QOT14') AS gene__QOT14, max(round(v, 6)) FILTER (gene = 'XAL17') AS gene__XAL17 FROM x WHERE gene IN ('QOT14', 'XAL17') GROUP BY 1),
 cyt AS (SELECT sample_id, round(CASE WHEN count(*) = 2 THEN sqrt(greatest(max(v) FILTER (gene = 'QOT14'), 0) * greatest(max(v) FILTER (gene = 'XAL17'), 0)) END, 6) AS baseline__cyt FROM x WHERE gene IN ('QOT14', 'XAL17') GROUP BY 1),
 tz AS (SELECT gene, sample_id, coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) AS z FROM x WHERE gene IN ({', '.join(f"'{g}'" for g in TIS)}) WINDOW w AS (PARTITION BY gene)),
 tis AS (SELECT sample_id, round(CASE WHEN count(z) >= 5 THEN avg(z) END, 6) AS baseline__tis FROM tz GROUP BY 1),
 w AS (SELECT sample_id, {', '.join(f"max(score) FILTER (set_name = '{n}') AS sig__{n}" for n in SETS)} FROM s GROUP BY 1)
 SELECT w.*, gene__QOT14, gene__XAL17, baseline__cyt, baseline__tis, age AS clin__age FROM w LEFT JOIN g USING (sample_id) LEFT JOIN cyt USING (sample_id) LEFT JOIN tis USING (sample_id) LEFT JOIN ag USING (sample_id)""")
def _(s, d):
    return study_frame(s, d)


@query("overall_stage", "SELECT rec_id, greatest(CASE WHEN NOT isnan(grade) THEN grade END, subtype_her2::DOUBLE) AS top FROM clinical")
def _(s, d):
    return table(s, d, "clinical").select("rec_id", frames.row_max(F.when(~F.isnan("grade"), F.col("grade")), F.col("subtype_her2").cast("double")).alias("top"))


@query("gene_panel", "SELECT item, row_number() OVER (ORDER BY f, item) AS place FROM (SELECT g AS item, min((name, pos)) AS f FROM (SELECT name, unnest(genes) AS g, generate_subscripts(genes, 1) AS pos FROM gene_sets) WHERE g IS NOT NULL GROUP BY 1)")
def _(s, d):
    return frames.ordered_unique(table(s, d, "gene_sets"), "name", "genes")


@query("module_of_signature", "SELECT 'sig__' || name AS feature, CASE " + " ".join(f"WHEN name LIKE '{p.replace('_', '|_')}%' ESCAPE '|' THEN '{m}'" for p, m in MODULES) + " ELSE 'other' END AS module FROM gene_sets")
def _(s, d):
    return frames.module_map(table(s, d, "gene_sets").select(F.concat(F.lit("sig__"), "name").alias("feature")), "feature", MODULES)


@query("composite_formula", "SELECT class_name, string_agg(CASE WHEN sign < 0 THEN '- ' ELSE '+ ' END || 'z(' || set_name || ')', ' ' ORDER BY set_name) AS formula FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in COMPONENTS) + ") t(class_name, set_name, sign) GROUP BY 1")
def _(s, d):
    return frames.formula(s.createDataFrame(COMPONENTS, "class_name string, set_name string, sign int"))


def arms(s: SparkSession, d: str) -> DataFrame:
    """The trial with the sample's cohort as its arm."""
    k = relational.first_of_key(table(s, d, "clinical").where("sample_id is not null and name is not null"), ["sample_id"], ["rec_id"], ["name"])
    return trial(s, d).join(k.withColumnRenamed("name", "arm"), "sample_id")


@query("receptor_matched_arms", f"WITH {TRIAL}, {ARMS}, st AS (SELECT arm AS a, min(her2) AS lo, max(her2) AS hi FROM tr2 WHERE arm <> 'quillon' GROUP BY 1) SELECT arm, CASE WHEN arm = 'quillon' THEN 'control' WHEN hi = 1 THEN 'mixed' ELSE 'negative' END AS matching, count(*) AS n, sum(pcr)::BIGINT AS events FROM tr2 LEFT JOIN st ON a = arm WHERE her2 = 0 AND (arm = 'quillon' OR lo = 0) GROUP BY 1, 2")
def _(s, d):
    m = frames.receptor_matched(arms(s, d), "arm", "her2", F.col("arm") == "quillon")
    return m.groupBy("arm", "matching").agg(F.count("*").alias("n"), F.sum("pcr").alias("events"))


@query("significant_brands", """WITH p AS (SELECT p_partkey, round((p_partkey * 7919 % 10007) / 10007.0, 9) AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS b FROM p), q AS (SELECT p_partkey, round(least(1, min(b) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r) SELECT p_partkey, q FROM q WHERE q < 0.9""")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.round(F.expr("p_partkey * 7919 % 10007") / 10007.0, 9).alias("p"))
    return frames.significant(r6(relational.benjamini_hochberg(p, "p", "q"), "q"), "q", 0.9).select("p_partkey", "q")


@query("linked_arm_medians", "WITH n AS (SELECT p_brand, p_type LIKE '%STEEL%' AS linked, p_retailprice AS v FROM part) SELECT count(v) FILTER (linked) AS n_linked, count(v) FILTER (NOT linked) AS n_other, round(median(v) FILTER (linked), 6) AS median_linked, round(median(v) FILTER (NOT linked), 6) AS median_other, round(median(v) FILTER (linked) - median(v) FILTER (NOT linked), 6) AS difference FROM n")
def _(s, d):
    return r6(frames.median_contrast(table(s, d, "part"), "p_retailprice", F.col("p_type").contains("STEEL")), "median_linked", "median_other", "difference")


@query("outcome_guard", "SELECT name, count(pcr) AS n, sum(pcr)::BIGINT AS events, CASE WHEN count(pcr) >= 90 THEN 'VALID' ELSE 'TOO_SMALL' END AS status FROM endpoints GROUP BY 1")
def _(s, d):
    return frames.outcome_status(table(s, d, "endpoints"), ["name"], "pcr", 90)


@query("loading_shares", "SELECT name, subtype, n, round(n / sum(n) OVER (PARTITION BY name), 6) AS share FROM (SELECT name, subtype, count(*) AS n FROM response_rows GROUP BY 1, 2)")
def _(s, d):
    return r6(frames.column_shares(table(s, d, "response_rows").groupBy("name", "subtype").agg(F.count("*").alias("n")), "name", "n"), "share")


# ---- scalers and simple imputation -----------------------------------------------------------------------------------
LI = "b AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS f, CASE WHEN l_quantity > 3 THEN l_extendedprice END AS v FROM lineitem WHERE l_suppkey IS NOT NULL)"


def lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").where("l_suppkey is not null").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("f"), F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).alias("v"))


@query("scaler_fit_apply", f"WITH {LI}, m AS (SELECT f, avg(v) AS c, stddev_samp(v) AS s FROM b WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT f, count(*) AS n, round(avg((v - c) / s), 6) AS mean, round(max((v - c) / s), 6) AS top FROM b JOIN m USING (f) WHERE l_suppkey % 2 = 1 GROUP BY 1")
def _(s, d):
    x = lines(s, d)
    z = frames.apply_scaler(x.where("l_suppkey % 2 = 1"), frames.fit_scaler(x.where("l_suppkey % 2 = 0"), "f", "v"), "f", "v", "z")
    return r6(z.groupBy("f").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.max("z").alias("top")), "mean", "top")


@query("robust_scaler_fit_apply", f"WITH {LI}, a AS (SELECT f, median(v) AS c FROM b WHERE l_suppkey % 2 = 0 GROUP BY 1), m AS (SELECT f, any_value(c) AS c, median(abs(v - c)) * 1.4826 AS s FROM b JOIN a USING (f) WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT f, count(*) AS n, round(avg(CASE WHEN v IS NOT NULL THEN greatest(-1.0, least(1.0, (v - c) / s)) END), 6) AS mean, round(max((v - c) / s), 6) AS top FROM b JOIN m USING (f) WHERE l_suppkey % 2 = 1 GROUP BY 1")
def _(s, d):
    x = lines(s, d)
    fitted = frames.fit_scaler(x.where("l_suppkey % 2 = 0"), "f", "v", robust=True)
    z = frames.apply_scaler(frames.apply_scaler(x.where("l_suppkey % 2 = 1"), fitted, "f", "v", "z"), fitted, "f", "v", "c", bound=1.0)
    return r6(z.groupBy("f").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.max("z").alias("top")), "mean", "top")


@query("median_imputed", f"WITH {LI} SELECT l_orderkey, l_linenumber, l_suppkey, round(coalesce(v, median(v) OVER (PARTITION BY f)), 6) AS x FROM b")
def _(s, d):
    return r6(scaling.impute_median(lines(s, d), "v", ["f"], "x"), "x").select("l_orderkey", "l_linenumber", "l_suppkey", "x")


@query("nonnegative_shift", f"WITH {LI} SELECT l_orderkey, l_linenumber, l_suppkey, round(v - 20000 + abs(least(min(v - 20000) OVER (PARTITION BY f), 0)) + 1e-6, 6) AS x FROM b")
def _(s, d):
    return r6(scaling.shift_nonnegative(lines(s, d).withColumn("v", F.col("v") - 20000), "v", ["f"], "x"), "x").select("l_orderkey", "l_linenumber", "l_suppkey", "x")


@query("minmax_fit_apply", f"WITH {LI}, m AS (SELECT f, min(v) AS lo, max(v) AS hi FROM b WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT l_orderkey, l_linenumber, l_suppkey, round((v - lo) / (hi - lo), 6) AS x FROM b JOIN m USING (f) WHERE l_suppkey % 2 = 1")
def _(s, d):
    x = lines(s, d)
    out = scaling.apply_minmax(x.where("l_suppkey % 2 = 1"), scaling.fit_minmax(x.where("l_suppkey % 2 = 0"), "v", ["f"]), "v", ["f"], "x")
    return r6(out.withColumn("x", F.when(F.col("v").isNotNull(), F.col("x"))), "x").select("l_orderkey", "l_linenumber", "l_suppkey", "x")


@query("cluster_input", f"""WITH {SCORES}, m AS (SELECT set_name, median(score) AS med, avg(score) AS mu, stddev_samp(score) AS sd FROM s GROUP BY 1), q AS (SELECT set_name, median(abs(score - med)) AS mad FROM s JOIN m USING (set_name) GROUP BY 1),
 zz AS (SELECT set_name, sample_id, CASE WHEN mad > 0 THEN (score - med) / (1.4826 * mad) WHEN sd > 0 THEN (score - mu) / sd ELSE 0 END AS z FROM s JOIN m USING (set_name) JOIN q USING (set_name)), k AS (SELECT set_name FROM zz GROUP BY 1 HAVING stddev_samp(z) >= 0.01)
 SELECT sample_id, set_name, round(greatest(-10.0, least(10.0, z)), 5) AS x FROM zz SEMI JOIN k USING (set_name)""")
def _(s, d):
    return scaling.cluster_input(scores(s, d), "sample_id", "set_name", "score").withColumn("x", F.round("x", 5))


# ---- confounding and interactions ------------------------------------------------------------------------------------
@query("ols_residuals", f"WITH {SURV}, {AGE}, j AS (SELECT ep_id, t::DOUBLE AS t, age::DOUBLE AS age FROM sv JOIN endpoints USING (ep_id) JOIN ag USING (sample_id)), r AS (SELECT regr_slope(t, age) AS b, regr_intercept(t, age) AS a FROM j) SELECT ep_id, round(t - a - b * age, 4) AS residual FROM j, r")
def _(s, d):
    j = outcomes(s, d).join(ages(s, d), "sample_id").select("ep_id", "t", "age")
    return confounding.ols_residuals(j, {"t": "residual"}, ["age"]).select("ep_id", F.round("residual", 4).alias("residual"))


RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("partial_spearman", f"""WITH {COMP}, {SURV}, {AGE}, j AS (SELECT composite AS r, t::DOUBLE AS t, age::DOUBLE AS age FROM sv JOIN endpoints USING (ep_id) JOIN ag USING (sample_id) JOIN c USING (sample_id) WHERE e = 1 AND class_name = 'immune'),
 b AS (SELECT regr_slope(t, age) AS bt, regr_intercept(t, age) AS a_t, regr_slope(r, age) AS br, regr_intercept(r, age) AS ar FROM j), k AS (SELECT r, t, round(r - ar - br * age, 9) AS rr, round(t - a_t - bt * age, 9) AS tt FROM j, b),
 w AS (SELECT {RANK('r')} AS a, {RANK('t')} AS b, {RANK('rr')} AS c, {RANK('tt')} AS d FROM k), f AS (SELECT corr(a, b) AS rho, corr(c, d) AS p, count(*) AS n FROM w)
 SELECT round(rho, 6) AS rho, n, round(p, 6) AS partial_rho, abs(p) < 0.5 * abs(rho) AS proxy_warning FROM f""")
def _(s, d):
    j = outcomes(s, d).join(ages(s, d), "sample_id").join(composites(s, d).where("class_name = 'immune'"), "sample_id")
    return r6(confounding.partial_spearman(j, "composite", "t", "e", ["age"]), "rho", "partial_rho")


@query("interaction_by_arm_and_signature")
def _(s, d):
    """Every (cohort, signature): the arm interaction, one false-discovery rate over all of them; small groups stay with an error."""
    j = scores(s, d).join(arms(s, d), "sample_id").join(ages(s, d), "sample_id")
    fits = models.interaction_logit(j, "pcr", "score", "her2", ["age"], ["arm", "set_name"], least_rows=30, least_cell=3).where("term = 'interaction' or error is not null")
    return relational.benjamini_hochberg(fits, "p", "q_bh")


@query("interaction_matched")
def _(s, d):
    """The corrected pipeline: each cohort against the control cohort, receptors matched; composite by arm interaction, with q,
    power and a validity flag."""
    m = frames.receptor_matched(arms(s, d), "arm", "her2", F.col("arm") == "quillon")
    control = m.where("matching = 'control'").drop("arm", "matching")
    pairs = m.where("matching <> 'control'").select("arm", "matching", "sample_id", "pcr").withColumn("treated", F.lit(1))
    every = pairs.select("arm", "matching").distinct().join(control.select("sample_id", "pcr"), F.lit(True)).withColumn("treated", F.lit(0))  # arms x control rows
    j = pairs.unionByName(every).join(composites(s, d), "sample_id")
    fits = models.interaction_logit(j, "pcr", "composite", "treated", [], ["class_name", "arm", "matching"], least_rows=40, least_cell=3).where("term = 'interaction' or error is not null")
    rate = control.agg(F.avg("pcr").alias("rate"))
    out = fits.crossJoin(F.broadcast(rate)).withColumn("mde", classical.min_detectable_or(F.col("n"), F.col("rate")))  # one row
    return relational.benjamini_hochberg(out.withColumn("status", F.when(F.col("error").isNull(), "VALID").otherwise("TOO_SMALL")), "p", "q_bh")


# ---- survival models -------------------------------------------------------------------------------------------------
def benchmark_frame(s: SparkSession, d: str) -> DataFrame:
    """Scored samples with outcome, clinical columns and a stratified fold."""
    f = study_frame(s, d)
    o = relational.first_of_key(outcomes(s, d).where("sample_id is not null"), ["sample_id"], ["ep_id"], ["t", "e"])
    k = relational.first_of_key(table(s, d, "clinical").where("sample_id is not null"), ["sample_id"], ["rec_id"], ["stage", "subtype_er", "subtype_her2"])
    clin = k.select("sample_id", stage_code("stage").cast("double").alias("clin__stage"), F.when(receptor_code("subtype_er") == "POS", 1.0).when(receptor_code("subtype_er") == "NEG", 0.0).alias("clin__er"), F.col("subtype_her2").cast("double").alias("clin__her2"))
    j = f.join(o, "sample_id").join(clin, "sample_id", "left")
    return stage(resampling.stratified_folds(j, "e", "sample_id", 5), "benchmark")


CLINICAL = ["clin__age", "clin__stage", "clin__er", "clin__her2"]
SIGS = [f"sig__{n}" for n in SETS]


def zoo() -> dict:
    """The benchmark's models by name."""
    rm = risk_models
    return {
        "clinical_only": lambda: rm.CoxRisk(CLINICAL), "tis": lambda: rm.CoxRisk(["baseline__tis"]), "cyt": lambda: rm.CoxRisk(["baseline__cyt"]), "signature_interferon": lambda: rm.CoxRisk(["sig__interferon_call"]),
        **{f"random_s{k}": (lambda k=k: rm.RandomCox(6, k, SIGS)) for k in range(3)}, "factors": lambda: rm.FactorCox(SIGS), "factors_clinical": lambda: rm.StackedCox([rm.FactorCox(SIGS), rm.CoxRisk(CLINICAL)]),
    }


def out_of_fold(s: SparkSession, d: str) -> DataFrame:
    return stage(risk_models.out_of_fold_risk(benchmark_frame(s, d), "sample_id", "t", "e", [*SIGS, "baseline__tis", "baseline__cyt", *CLINICAL], "fold", zoo(), 5), "risks")


@query("survival_benchmark")
def _(s, d):
    """Out-of-fold C-index of nine survival models, pooled and by fold, each against the clinical one."""
    r = out_of_fold(s, d)
    pooled = survival.concordance(r, "t", "e", "risk", ["model"])
    by_fold = survival.concordance(r, "t", "e", "risk", ["model", "fold"]).groupBy("model").agg(F.sort_array(F.collect_list(F.struct("fold", "c_index")))["c_index"].alias("fold_c"))  # five a model
    return relational.delta_to_baseline(pooled.join(by_fold, "model"), "c_index", F.col("model") == "clinical_only", "delta_vs_clinical")


@query("c_index_by_signature", f"""WITH {SCORES}, {SURV}, j AS (SELECT set_name, ep_id, t, e, score AS r FROM sv JOIN endpoints USING (ep_id) JOIN s USING (sample_id)),
 p AS (SELECT a.set_name, count(*) AS n, count(*) FILTER (b.r < a.r) AS c, count(*) FILTER (b.r = a.r) AS k FROM j a JOIN j b ON a.set_name = b.set_name AND a.e = 1 AND b.t > a.t GROUP BY 1)
 SELECT set_name, c AS concordant, k AS tied, n AS comparable, round((c + 0.5 * k) / n, 6) AS c_index FROM p""")
def _(s, d):
    """Harrell's C of every signature's score."""
    j = outcomes(s, d).join(scores(s, d), "sample_id")
    return r6(survival.concordance(j, "t", "e", "score", ["set_name"]), "c_index")


# ---- suites ----------------------------------------------------------------------------------------------------------
@query("suite_report")
def _(s, d):
    """The validation suite over two cohorts and a feature frame: one row a check, names prefixed by what was checked."""
    e = table(s, d, "expr")
    cohorts = {}
    for name in ("quillon", "orrin2"):
        k = table(s, d, "clinical").where(cohort_key("name") == name)
        o = table(s, d, "endpoints").where(cohort_key("name") == name)
        cohorts[name] = suites.Bundle(e.join(k.select("sample_id").distinct(), "sample_id", "left_semi"), k, o, "log2_intensity")
    return suites.run_suite(s, cohorts, {"study": study_frame(s, d)}, {"tertiles": {"logrank_p": 0.004, "n_low": 100, "n_medium": 100, "n_high": 100}, "ph_violated": []})
