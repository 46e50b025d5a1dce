"""Queries of the relational, scoring, statistical, survival and metric operators, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.clean import cohort_key
from cohortloom.functions.encoders import barcode_patient, binary_flag, intrinsic_label, receptor_flag, response_flag, stage_digit, stage_group
from cohortloom.operators import classical, metrics, models, relational, resampling, scaling, scoring, survival
from cohortloom.session import stage, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- views -----------------------------------------------------------------------------------------------------------
COMPONENTS = [("immune", "lymph_core", 1), ("immune", "interferon_call", 1), ("immune", "stroma_web", -1), ("stromal", "fibre_wall", 1), ("stromal", "matrix_turn", 1), ("vascular", "vessel_growth", 1), ("vascular", "low_oxygen", 1)]
X = r"""x AS (SELECT upper(regexp_replace(gene, '\s+', '', 'g')) AS gene, sample_id, median(value) AS v FROM expr
 WHERE value IS NOT NULL AND NOT isnan(value) AND sample_id IS NOT NULL AND gene IS NOT NULL AND upper(regexp_replace(gene, '\s+', '', 'g')) NOT IN ('', 'NAN', '---') GROUP BY 1, 2)"""
SCORES = X + """, gs AS (SELECT DISTINCT name AS set_name, upper(trim(g)) AS gene FROM gene_sets, unnest(genes) AS t(g)),
 z AS (SELECT gene, sample_id, coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0) AS z FROM x WHERE gene IN (SELECT gene FROM gs) WINDOW w AS (PARTITION BY gene)),
 s AS (SELECT set_name, sample_id, round(avg(z), 6) AS score FROM z JOIN gs USING (gene) GROUP BY 1, 2)"""
COMP = SCORES + ", comp(class_name, set_name, sign) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in COMPONENTS) + """),
 sz AS (SELECT set_name, sample_id, (score - avg(score) OVER w) / coalesce(nullif(stddev_samp(score) OVER w, 0), 1) AS z FROM s WINDOW w AS (PARTITION BY set_name)),
 c AS (SELECT class_name, sample_id, round(sum(sign * z), 6) AS composite, count(*) AS n_components FROM sz JOIN comp USING (set_name) GROUP BY 1, 2)"""
TRIAL = """tr AS (SELECT e.sample_id, e.pcr, k.her2 FROM (SELECT sample_id, arg_min(pcr, ep_id) AS pcr FROM endpoints WHERE pcr IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1) e
 JOIN (SELECT sample_id, arg_min(subtype_her2, rec_id) AS her2 FROM clinical WHERE subtype_her2 IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1) k USING (sample_id))"""
EFFECT = """log_or, se, exp(log_or) AS odds_ratio, exp(log_or - 1.96 * se) AS ci_lo, exp(log_or + 1.96 * se) AS ci_hi"""
SURV = "sv AS (SELECT ep_id, name, date_diff('day', enrolled_at, last_contact_at) AS t, event_os AS e FROM endpoints WHERE enrolled_at IS NOT NULL AND last_contact_at IS NOT NULL AND event_os IS NOT NULL AND last_contact_at >= enrolled_at)"
AGE = "ag AS (SELECT sample_id, arg_min(age, rec_id) AS age FROM clinical WHERE age IS NOT NULL AND sample_id IS NOT NULL GROUP BY 1)"


def expression(spark: SparkSession, d: str) -> DataFrame:
    """Clean expression, written once: every use of it joins aggregates back to its rows."""
    return stage(scoring.clean_expression(table(spark, d, "expr")), "expression")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return stage(r6(scoring.mean_z(expression(spark, d), table(spark, d, "gene_sets")), "score"), "scores")


def composites(spark: SparkSession, d: str) -> DataFrame:
    comp = spark.createDataFrame(COMPONENTS, "class_name string, set_name string, sign int")
    return r6(scoring.signed_composite(scores(spark, d), comp), "composite")


def trial(spark: SparkSession, d: str) -> DataFrame:
    e = relational.first_of_key(table(spark, d, "endpoints").where("pcr is not null and sample_id is not null"), ["sample_id"], ["ep_id"], ["pcr"])
    k = relational.first_of_key(table(spark, d, "clinical").where("subtype_her2 is not null and sample_id is not null"), ["sample_id"], ["rec_id"], ["subtype_her2"])
    return e.join(k.withColumnRenamed("subtype_her2", "her2"), "sample_id")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "endpoints").select("ep_id", "sample_id", "name", F.datediff("last_contact_at", "enrolled_at").cast("long").alias("t"), F.col("event_os").alias("e"))
    return e.where("t >= 0 and e is not null")


def ages(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_of_key(table(spark, d, "clinical").where("age is not null and sample_id is not null"), ["sample_id"], ["rec_id"], ["age"])


# ---- sources, deduplication, scoring ---------------------------------------------------------------------------------
@query("duplicate_sample_median", f"WITH {X} SELECT gene, sample_id, round(v, 6) AS value FROM x")
def _(s, d):
    return r6(scoring.clean_expression(table(s, d, "expr")), "value")


@query("gene_zscore_pop", f"WITH {X} SELECT gene, sample_id, round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 6) AS z FROM x WINDOW w AS (PARTITION BY gene)")
def _(s, d):
    return r6(scaling.zscore(expression(s, d), "value", ["gene"], "z"), "z").select("gene", "sample_id", "z")


@query("robust_zscore", f"""WITH {X}, m AS (SELECT gene, median(v) AS med, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY 1), q AS (SELECT gene, median(abs(v - med)) AS mad FROM x JOIN m USING (gene) GROUP BY 1)
 SELECT gene, sample_id, round(CASE WHEN mad > 0 THEN (v - med) / (1.4826 * mad) WHEN s > 0 THEN (v - m) / s ELSE 0 END, 6) AS z FROM x JOIN m USING (gene) JOIN q USING (gene)""")
def _(s, d):
    return r6(scaling.robust_zscore(expression(s, d), "value", ["gene"], "z"), "z").select("gene", "sample_id", "z")


@query("geneset_mean_z", f"WITH {SCORES} SELECT set_name, sample_id, score FROM s")
def _(s, d):
    return scores(s, d)


@query("composite_signed_z", f"WITH {COMP} SELECT * FROM c")
def _(s, d):
    return composites(s, d)


@query("cyt_score", f"WITH {X} SELECT sample_id, round(CASE WHEN count(*) = 2 THEN sqrt(greatest(max(v) FILTER (gene = 'QOT14'), 0) * greatest(max(v) FILTER (gene = 'XAL17'), 0)) END, 6) AS score FROM x WHERE gene IN ('QOT14', 'XAL17') GROUP BY 1")
def _(s, d):
    return r6(scoring.geometric_pair(expression(s, d), "QOT14", "XAL17"), "score")


@query("tis_score", f"""WITH {X}, z AS (SELECT gene, sample_id, coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) AS z FROM x WHERE gene IN ('QENL21', 'QOL27', 'QOT14', 'XAL17', 'XURL27', 'XYLR19') WINDOW w AS (PARTITION BY gene))
 SELECT sample_id, round(CASE WHEN count(z) >= 5 THEN avg(z) END, 6) AS score FROM z GROUP BY 1""")
def _(s, d):
    return r6(scoring.mean_z_sample_sd(expression(s, d), ["QENL21", "QOL27", "QOT14", "XAL17", "XURL27", "XYLR19"], least=5), "score")


@query("signature_frame", f"""WITH {SCORES} SELECT sample_id, max(score) FILTER (set_name = 'lymph_core') AS sig__lymph_core, max(score) FILTER (set_name = 'stroma_web') AS sig__stroma_web, max(score) FILTER (set_name = 'cell_cycle') AS sig__cell_cycle FROM s GROUP BY 1""")
def _(s, d):
    return scoring.wide_scores(scores(s, d), ["lymph_core", "stroma_web", "cell_cycle"])


@query("ssgsea_score", f"""WITH {X}, gs AS (SELECT DISTINCT name AS set_name, upper(trim(g)) AS gene FROM gene_sets, unnest(genes) AS t(g)),
 r AS (SELECT gene, sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, gene) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM x),
 a AS (SELECT set_name, sample_id, n, count(*) AS k, sum((n - r + 1) ** 0.25) AS sw FROM r JOIN gs USING (gene) GROUP BY 1, 2, 3 HAVING count(*) < n),
 w AS (SELECT a.set_name, r.sample_id, r.r, a.n, CASE WHEN gs.gene IS NOT NULL THEN (a.n - r.r + 1) ** 0.25 / sw ELSE 0 END AS hit, CASE WHEN gs.gene IS NULL THEN 1.0 / (a.n - k) ELSE 0 END AS miss FROM a JOIN r USING (sample_id) LEFT JOIN gs ON gs.set_name = a.set_name AND gs.gene = r.gene)
 SELECT set_name, sample_id, round(sum((hit - miss) * (n - r + 1)), 4) AS score FROM w GROUP BY 1, 2""")
def _(s, d):
    return scoring.ssgsea(expression(s, d), table(s, d, "gene_sets")).withColumn("score", F.round("score", 4))


@query("probe_to_gene_max_variance", """WITH p AS (SELECT vec_id, i - 1 AS probe, (i - 1) // 8 AS gene, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS t(i)), q AS (SELECT gene, probe, var_samp(v) AS s FROM p GROUP BY 1, 2),
 b AS (SELECT gene, probe FROM q QUALIFY row_number() OVER (PARTITION BY gene ORDER BY s DESC, probe) = 1) SELECT 'g' || p.gene AS gene, vec_id AS sample_id, round(v, 6) AS value FROM p JOIN b USING (gene, probe)""")
def _(s, d):
    long = table(s, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("probe", "value"))
    probe_map = s.range(64).select(F.col("id").cast("int").alias("probe"), F.concat(F.lit("g"), F.expr("id div 8")).alias("gene"))
    return r6(scoring.probes_to_genes(long, probe_map), "value")


@query("gmt_explode", "SELECT DISTINCT name AS set_name, upper(trim(g)) AS gene FROM gene_sets, unnest(genes) AS t(g)")
def _(s, d):
    return scoring.exploded_sets(table(s, d, "gene_sets"))


@query("log_if_raw", "SELECT l_orderkey, l_linenumber, round(CASE WHEN (SELECT max(l_extendedprice) FROM lineitem) > 100 THEN log2(l_extendedprice + 1) ELSE l_extendedprice END, 6) AS v FROM lineitem")
def _(s, d):
    return r6(scaling.log_if_raw(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "v"), "v").drop("l_extendedprice")


@query("usable_features", f"WITH {X}, n AS (SELECT count(DISTINCT sample_id) AS a FROM x) SELECT gene, count(v) AS n, count(DISTINCT v) AS n_distinct FROM x GROUP BY 1 HAVING count(v) >= floor(0.05 * (SELECT a FROM n)) AND count(DISTINCT v) >= 2")
def _(s, d):
    return scaling.usable_features(expression(s, d), "sample_id", "gene", "value", least_share=0.05)


# ---- relational ------------------------------------------------------------------------------------------------------
@query("combine_first_join", """WITH a AS (SELECT sample_id, arg_min(name, rec_id) AS name, arg_min(age, rec_id) FILTER (age IS NOT NULL) AS age FROM clinical WHERE sample_id IS NOT NULL GROUP BY 1), b AS (SELECT sample_id, arg_min(name, ep_id) AS name, min(pcr) AS pcr FROM endpoints WHERE sample_id IS NOT NULL GROUP BY 1)
 SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.name, b.name) AS name, age, pcr FROM a FULL JOIN b ON a.sample_id = b.sample_id""")
def _(s, d):
    a = table(s, d, "clinical").where("sample_id is not null").groupBy("sample_id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("rec_id"))).alias("name"), F.min_by("age", F.when(F.col("age").isNotNull(), F.col("rec_id"))).alias("age"))
    b = table(s, d, "endpoints").where("sample_id is not null").groupBy("sample_id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ep_id"))).alias("name"), F.min("pcr").alias("pcr"))
    return relational.coalesce_join(a, b, ["sample_id"])


@query("overlay_join", """WITH a AS (SELECT sample_id, arg_min(age, rec_id) FILTER (age IS NOT NULL) AS age FROM clinical WHERE sample_id IS NOT NULL GROUP BY 1), b AS (SELECT sample_id, max(pcr) AS age FROM endpoints WHERE sample_id IS NOT NULL GROUP BY 1)
 SELECT a.sample_id, coalesce(b.age, a.age) AS age FROM a LEFT JOIN b ON a.sample_id = b.sample_id""")
def _(s, d):
    a = table(s, d, "clinical").where("sample_id is not null").groupBy("sample_id").agg(F.min_by("age", F.when(F.col("age").isNotNull(), F.col("rec_id"))).alias("age"))
    b = table(s, d, "endpoints").where("sample_id is not null").groupBy("sample_id").agg(F.max("pcr").alias("age"))
    return relational.overlay_join(a, b, "sample_id", ["age"])


@query("gene_intersection", r"""WITH g AS (SELECT DISTINCT upper(regexp_replace(gene, '\s+', '', 'g')) AS gene, batch FROM expr WHERE gene IS NOT NULL AND batch IS NOT NULL) SELECT gene FROM g GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT batch) FROM g)""")
def _(s, d):
    e = table(s, d, "expr").where("gene is not null and batch is not null").select(F.upper(F.regexp_replace("gene", r"\s+", "")).alias("gene"), "batch").distinct()
    n = e.agg(F.count_distinct("batch").alias("n"))
    return e.groupBy("gene").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("gene")  # one row


@query("cohort_overlap", "SELECT sample_id, count(DISTINCT name) AS n_sources FROM clinical WHERE sample_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1")
def _(s, d):
    return relational.shared_keys(table(s, d, "clinical"), "sample_id", "name")


@query("percent_rank_avg", f"""WITH {X} SELECT gene, sample_id, round((rank() OVER (PARTITION BY sample_id ORDER BY v) + (count(*) OVER (PARTITION BY sample_id, v) - 1) / 2.0) / count(*) OVER (PARTITION BY sample_id), 6) AS pct FROM x""")
def _(s, d):
    return r6(relational.percent_rank_average(expression(s, d), "value", ["sample_id"], "pct"), "pct").select("gene", "sample_id", "pct")


@query("bh_fdr", """WITH p AS (SELECT p_partkey, p_brand, round((p_partkey * 7919 % 10007) / 10007.0, 9) AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p) AS b FROM p)
 SELECT p_partkey, round(least(1, min(b) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r""")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", F.round(F.expr("p_partkey * 7919 % 10007") / 10007.0, 9).alias("p"))
    return r6(relational.benjamini_hochberg(p, "p", "q", ["p_brand"]), "q").select("p_partkey", "q")


@query("delta_to_previous", "SELECT name, y, n, coalesce(n - lag(n) OVER (PARTITION BY name ORDER BY y), n) AS delta FROM (SELECT name, year(diagnosed_on) AS y, count(*) AS n FROM clinical WHERE diagnosed_on IS NOT NULL GROUP BY 1, 2)")
def _(s, d):
    n = table(s, d, "clinical").where("diagnosed_on is not null").groupBy("name", F.year("diagnosed_on").alias("y")).agg(F.count("*").alias("n"))
    return relational.delta_to_previous(n, "n", "y", "delta", ["name"])


@query("delta_to_baseline", "SELECT arm, n, n - max(n) FILTER (arm = 'control') OVER () AS delta FROM (SELECT arm, count(*) AS n FROM response_rows GROUP BY 1)")
def _(s, d):
    return relational.delta_to_baseline(table(s, d, "response_rows").groupBy("arm").agg(F.count("*").alias("n")), "n", F.col("arm") == "control", "delta")


@query("top3_signatures", f"WITH {SCORES} SELECT sample_id, set_name, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, set_name) AS rank FROM s QUALIFY rank <= 3")
def _(s, d):
    return relational.top_k(scores(s, d), ["sample_id"], [F.col("score").desc(), F.col("set_name")], 3).select("sample_id", "set_name", "score", "rank")


@query("unique_names", "SELECT row_id, CASE WHEN k = 1 THEN arm ELSE arm || '_' || k END AS label FROM (SELECT row_id, arm, row_number() OVER (PARTITION BY arm ORDER BY row_id) AS k FROM response_rows)")
def _(s, d):
    return relational.unique_names(table(s, d, "response_rows").select("row_id", "arm"), "arm", "row_id", "label").select("row_id", "label")


@query("prefix_projection", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_shipdate FROM lineitem")
def _(s, d):
    blocks = {"keys": ["l_orderkey", "l_partkey", "l_suppkey"], "line": ["l_line"], "ship": ["l_ship"]}
    return relational.ablation_grid(table(s, d, "lineitem"), blocks, {"all": ["keys", "line", "ship"]})["all"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate")


@query("alias_harmonise", "SELECT rec_id AS row_id, site AS place, CAST(NULL AS VARCHAR) AS arm FROM clinical")
def _(s, d):
    return relational.first_present(table(s, d, "clinical"), {"row_id": ["row_id", "rec_id"], "place": ["centre", "site"], "arm": ["arm", "treatment"]})


@query("clinical_encoders", """SELECT rec_id, CASE WHEN lower(trim(subtype_er)) IN ('positive','pos','yes','true','y','dead','deceased') THEN 1 WHEN lower(trim(subtype_er)) IN ('negative','neg','no','false','n','alive','living') THEN 0 WHEN TRY_CAST(trim(subtype_er) AS DOUBLE) >= 0.5 THEN 1 WHEN TRY_CAST(trim(subtype_er) AS DOUBLE) < 0.5 THEN 0 END AS er_flag,
 CASE WHEN upper(trim(subtype_er)) IN ('P','POS','POSITIVE','1') THEN 1 WHEN upper(trim(subtype_er)) IN ('N','NEG','NEGATIVE','0') THEN 0 END AS receptor,
 CASE upper(trim(stage)) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'IIA' THEN 2 WHEN 'IIB' THEN 2 WHEN 'III' THEN 3 WHEN 'IIIA' THEN 3 WHEN 'IIIB' THEN 3 WHEN 'IIIC' THEN 3 WHEN 'IV' THEN 4 END AS stage_group,
 CASE WHEN upper(trim(stage)) LIKE 'STAGE%' THEN TRY_CAST(nullif(regexp_extract(upper(trim(stage)), '[0-9]'), '') AS INT) END AS stage_digit,
 CASE WHEN upper(trim(subtype_pam50)) IN ('BASAL','BASAL-LIKE') THEN 'BASAL' WHEN upper(trim(subtype_pam50)) IN ('HER2','HER2-ENRICHED') THEN 'HER2' WHEN upper(trim(subtype_pam50)) IN ('LUMA','LUMINAL A') THEN 'LUMA' WHEN upper(trim(subtype_pam50)) IN ('LUMB','LUMINAL B') THEN 'LUMB' WHEN upper(trim(subtype_pam50)) IN ('NORMAL','NORMAL-LIKE') THEN 'NORMAL' END AS intrinsic,
 CASE WHEN upper(replace(trim(patient_id), '.', '-')) LIKE 'MSA%' THEN array_to_string(list_slice(string_split(upper(replace(trim(patient_id), '.', '-')), '-'), 1, 3), '-') ELSE upper(replace(trim(patient_id), '.', '-')) END AS patient, CASE upper(trim(stage)) WHEN 'PCR' THEN 1 WHEN 'RD' THEN 0 END AS response
 FROM (SELECT rec_id, subtype_er, stage, subtype_pam50, patient_id FROM clinical)""")
def _(s, d):
    return table(s, d, "clinical").select("rec_id", binary_flag("subtype_er").alias("er_flag"), receptor_flag("subtype_er").alias("receptor"), stage_group("stage").alias("stage_group"), stage_digit("stage", "stage").alias("stage_digit"), intrinsic_label("subtype_pam50").alias("intrinsic"), barcode_patient("patient_id", "MSA").alias("patient"), response_flag("stage").alias("response"))


# ---- groups, effects, tests ------------------------------------------------------------------------------------------
@query("profile_by_cluster", f"WITH {SCORES.replace('round(avg(z), 6) AS score', 'avg(z) AS score')}, k AS (SELECT sample_id, arg_min(name, rec_id) AS cluster FROM clinical WHERE sample_id IS NOT NULL AND name IS NOT NULL GROUP BY 1) SELECT cluster, set_name, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(median(score), 6) AS median, count(score) AS n FROM s JOIN k USING (sample_id) GROUP BY 1, 2")
def _(s, d):
    k = relational.first_of_key(table(s, d, "clinical").where("sample_id is not null and name is not null"), ["sample_id"], ["rec_id"], ["name"])
    j = scoring.mean_z(expression(s, d), table(s, d, "gene_sets")).join(k, "sample_id")  # not rounded before: means of rounded scores are ties
    return r6(j.groupBy(F.col("name").alias("cluster"), "set_name").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.median("score").alias("median"), F.count("score").alias("n")), "mean", "sd", "median")


@query("composite_tertile_effect", f"""WITH {COMP}, {TRIAL}, j AS (SELECT class_name, composite, pcr, her2 FROM c JOIN tr USING (sample_id)), q AS (SELECT class_name, quantile_cont(composite, [1/3.0, 2/3.0]) AS cuts FROM j GROUP BY 1),
 b AS (SELECT class_name, CASE WHEN composite <= cuts[1] + 1e-9 THEN 'low' WHEN composite <= cuts[2] + 1e-9 THEN 'mid' ELSE 'high' END AS tertile, pcr, her2 FROM j JOIN q USING (class_name)),
 n AS (SELECT class_name, tertile, count(*) FILTER (her2 = 1 AND pcr = 1) AS a, count(*) FILTER (her2 = 1 AND pcr = 0) AS b, count(*) FILTER (her2 = 0 AND pcr = 1) AS c, count(*) FILTER (her2 = 0 AND pcr = 0) AS d FROM b GROUP BY 1, 2),
 e AS (SELECT *, ln((a + .5) * (d + .5) / ((b + .5) * (c + .5))) AS log_or, sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (c + .5) + 1 / (d + .5)) AS se FROM n)
 SELECT class_name, tertile, a, b, c, d, round(log_or, 6) AS log_or, round(se, 6) AS se, round(exp(log_or), 4) AS odds_ratio, round(exp(log_or - 1.96 * se), 4) AS ci_lo, round(exp(log_or + 1.96 * se), 4) AS ci_hi, round(a / nullif(a + b, 0)::DOUBLE - c / nullif(c + d, 0)::DOUBLE, 6) AS rate_diff FROM e""")
def _(s, d):
    j = composites(s, d).join(trial(s, d), "sample_id")
    e = r6(classical.bin_effects(j, "composite", ["class_name"], F.col("her2"), F.col("pcr")), "log_or", "se", "rate_diff")
    return e.withColumns({c: F.round(c, 4) for c in ("odds_ratio", "ci_lo", "ci_hi")})


@query("class_tertile_effects", """WITH j AS (SELECT p_brand, l_extendedprice AS v, (l_linestatus = 'O')::INT AS arm, (l_returnflag = 'R')::INT AS y FROM lineitem JOIN part ON p_partkey = l_partkey), q AS (SELECT p_brand, quantile_cont(v, [1/3.0, 2/3.0]) AS cuts FROM j GROUP BY 1),
 t AS (SELECT p_brand, CASE WHEN v <= cuts[1] + 1e-9 THEN 'low' WHEN v <= cuts[2] + 1e-9 THEN 'mid' ELSE 'high' END AS tertile, arm, y FROM j JOIN q USING (p_brand)), n AS (SELECT p_brand, tertile, count(*) FILTER (arm = 1 AND y = 1) AS a, count(*) FILTER (arm = 1 AND y = 0) AS b, count(*) FILTER (arm = 0 AND y = 1) AS c, count(*) FILTER (arm = 0 AND y = 0) AS d FROM t GROUP BY 1, 2)
 SELECT p_brand, tertile, a, b, c, d, round(ln((a + .5) * (d + .5) / ((b + .5) * (c + .5))), 6) AS log_or, round(sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (c + .5) + 1 / (d + .5)), 6) AS se FROM n""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("v"), (F.col("l_linestatus") == "O").cast("int").alias("arm"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    j = li.join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return r6(classical.bin_effects(j, "v", ["p_brand"], F.col("arm"), F.col("y")), "log_or", "se").select("p_brand", "tertile", "a", "b", "c", "d", "log_or", "se")


@query("median_split_subgroup", f"""WITH {COMP}, {TRIAL}, j AS (SELECT class_name, composite, pcr, her2 FROM c JOIN tr USING (sample_id)), q AS (SELECT class_name, median(composite) AS cut FROM j GROUP BY 1)
 SELECT class_name, CASE WHEN composite >= cut - 1e-9 THEN 'high' ELSE 'low' END AS half, her2, count(*) AS n, sum(pcr) AS events, round(avg(pcr), 6) AS rate FROM j JOIN q USING (class_name) GROUP BY 1, 2, 3""")
def _(s, d):
    j = relational.high_low(composites(s, d).join(trial(s, d), "sample_id"), "composite", ["class_name"])
    return r6(j.groupBy("class_name", "half", "her2").agg(F.count("*").alias("n"), F.sum("pcr").alias("events"), F.avg("pcr").alias("rate")), "rate")


ARM = "upper(regexp_replace(arm, '[^A-Za-z]', '', 'g'))"
NAME = r"regexp_replace(lower(trim(name)), '[-\s]+', '_', 'g')"


def arms(s, d):
    a = F.upper(F.regexp_replace("arm", "[^A-Za-z]", ""))
    return table(s, d, "response_rows").select("row_id", cohort_key("name").alias("name"), a.alias("arm"), (a != "CONTROL").cast("int").alias("treated"), "pcr", "subtype")


@query("arm_contingency", f"SELECT {NAME} AS name, {ARM} AS arm, pcr, count(*) AS n FROM response_rows GROUP BY 1, 2, 3")
def _(s, d):
    return arms(s, d).groupBy("name", "arm", "pcr").agg(F.count("*").alias("n"))


TWO = f"t AS (SELECT {NAME} AS name, count(*) FILTER ({ARM} <> 'CONTROL' AND pcr = 1) AS a, count(*) FILTER ({ARM} <> 'CONTROL' AND pcr = 0) AS b, count(*) FILTER ({ARM} = 'CONTROL' AND pcr = 1) AS c, count(*) FILTER ({ARM} = 'CONTROL' AND pcr = 0) AS d FROM response_rows GROUP BY 1)"


def arm_tables(s, d):
    return classical.two_by_two(arms(s, d), ["name"], F.col("treated"), F.col("pcr"))


@query("chi2_yates", f"""WITH {TWO}, q AS (SELECT *, (a + b + c + d)::DOUBLE AS n, greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2.0)::DOUBLE AS o FROM t), r AS (SELECT *, n * o * o / nullif((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0) AS chi2 FROM q)
 SELECT name, a, b, c, d, round(chi2, 6) AS chi2, round(sqrt(chi2 / nullif(n, 0)), 6) AS cramers_v FROM r""")
def _(s, d):
    return r6(classical.chi2_yates(arm_tables(s, d)), "chi2", "cramers_v")


@query("chi2_table", f"""WITH cells AS (SELECT coalesce(subtype, 'nan') AS r, {ARM} AS c, count(*)::DOUBLE AS o FROM response_rows GROUP BY 1, 2), m AS (SELECT r, c, o, sum(o) OVER (PARTITION BY r) AS nr, sum(o) OVER (PARTITION BY c) AS nc, sum(o) OVER () AS n FROM cells), k AS (SELECT count(DISTINCT r) AS kr, count(DISTINCT c) AS kc FROM cells)
 SELECT round(sum(o * o * n / (nr * nc)) - max(n), 6) AS chi2, (any_value(kr) - 1) * (any_value(kc) - 1) AS df, round(sqrt((sum(o * o * n / (nr * nc)) - max(n)) / (max(n) * (least(any_value(kr), any_value(kc)) - 1))), 6) AS cramers_v FROM m, k""")
def _(s, d):
    return r6(classical.chi2_table(arms(s, d), [], "subtype", "arm"), "chi2", "cramers_v")


@query("anova_f", """WITH g AS (SELECT name, count(age) AS n, avg(age) AS m, var_samp(age) AS v FROM clinical WHERE age IS NOT NULL AND name IS NOT NULL GROUP BY 1 HAVING count(age) >= 2)
 SELECT round(((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f_stat, count(*) - 1 AS df_between, sum(n) - count(*) AS df_within FROM g""")
def _(s, d):
    return r6(classical.anova(table(s, d, "clinical").select(F.col("age").cast("double").alias("age"), "name"), "age", "name"), "f_stat")


@query("dl_meta_analysis", f"""WITH {TWO}, e AS (SELECT ln((a + .5) * (d + .5) / ((b + .5) * (c + .5))) AS y, sqrt(1 / (a + .5) + 1 / (b + .5) + 1 / (c + .5) + 1 / (d + .5)) AS se FROM t), s AS (SELECT count(*) AS k, sum(1 / se ** 2) AS sw, sum(1 / se ** 4) AS sw2, sum(y / se ** 2) AS swy, sum(y * y / se ** 2) AS swyy FROM e),
 q AS (SELECT k, greatest(0, swyy - swy ** 2 / sw) AS q, greatest(0, coalesce((greatest(0, swyy - swy ** 2 / sw) - (k - 1)) / nullif(sw - sw2 / sw, 0), 0)) AS tau2 FROM s), p AS (SELECT k, q, tau2, sum(y / (se ** 2 + tau2)) / sum(1 / (se ** 2 + tau2)) AS pooled, sqrt(1 / sum(1 / (se ** 2 + tau2))) AS pse FROM e, q GROUP BY 1, 2, 3)
 SELECT k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(pooled, 6) AS pooled, round(pse, 6) AS pooled_se, round(pooled - 1.96 * pse, 6) AS ci_lo, round(pooled + 1.96 * pse, 6) AS ci_hi FROM p""")
def _(s, d):
    return r6(classical.random_effects(classical.odds_effects(arm_tables(s, d)), "log_or", "se"), "q", "tau2", "pooled", "pooled_se", "ci_lo", "ci_hi")


@query("sign_test", f"""WITH {TWO}, e AS (SELECT ln((a + .5) * (d + .5) / ((b + .5) * (c + .5))) AS y FROM t), n AS (SELECT count(*) AS n, count(*) FILTER (y < 0) AS k FROM e WHERE y <> 0)
 SELECT n, k, round((SELECT sum(gamma(n + 1) / (gamma(i + 1) * gamma(n - i + 1))) FROM range(0, 100) AS r(i) WHERE i >= k AND i <= n) * 0.5 ** n, 6) AS p_one_sided FROM n""")
def _(s, d):
    return r6(classical.sign_test(classical.odds_effects(arm_tables(s, d)), "log_or"), "p_one_sided")


@query("min_detectable_or", f"SELECT {NAME} AS name, {ARM} AS arm, count(*) AS n, round(CASE WHEN count(*) < 20 THEN NULL ELSE exp(2.8 * sqrt(2 / (count(*) * 0.2 * 0.8))) END, 6) AS mde FROM response_rows GROUP BY 1, 2")
def _(s, d):
    n = arms(s, d).groupBy("name", "arm").agg(F.count("*").alias("n"))
    m = classical.min_detectable_or(F.col("n"), F.lit(0.2))
    return n.withColumn("mde", F.when(m < float("inf"), F.round(m, 6)))


@query("feature_corr_pairs", f"WITH {SCORES} SELECT a.set_name AS a, b.set_name AS b, round(corr(a.score, b.score), 6) AS r, count(*) AS n FROM s a JOIN s b ON a.sample_id = b.sample_id AND a.set_name < b.set_name GROUP BY 1, 2")
def _(s, d):
    return r6(classical.correlation_pairs(scores(s, d), "sample_id", "set_name", "score"), "r")


@query("spearman_rho", """WITH d AS (SELECT name, age::DOUBLE AS x, ki67 AS y FROM clinical WHERE age IS NOT NULL AND ki67 IS NOT NULL AND NOT isnan(ki67)), r AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY name ORDER BY y) + (count(*) OVER (PARTITION BY name, y) - 1) / 2.0 AS ry FROM d)
 SELECT name, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def _(s, d):
    c = table(s, d, "clinical").where("age is not null and ki67 is not null and not isnan(ki67)").select("name", F.col("age").cast("double").alias("x"), F.col("ki67").alias("y"))
    return r6(classical.spearman(c, "x", "y", ["name"]), "rho")


# ---- survival --------------------------------------------------------------------------------------------------------
KM = SURV + """, lt AS (SELECT name, t, sum(e) AS d, count(*) AS c FROM sv GROUP BY 1, 2), ar AS (SELECT name, t, d, sum(c) OVER (PARTITION BY name ORDER BY t DESC) AS n FROM lt),
 km AS (SELECT name, t, d, n, CASE WHEN max((d = n)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS s FROM ar WHERE d > 0 WINDOW w AS (PARTITION BY name ORDER BY t))"""


@query("km_curve", f"WITH {KM} SELECT name, t, d, n, round(s, 6) AS s FROM km")
def _(s, d):
    return r6(survival.kaplan_meier(outcomes(s, d), "t", "e", ["name"]), "s")


@query("km_median", f"WITH {KM}, m AS (SELECT name, min(t) AS median_time FROM km WHERE round(s, 9) <= 0.5 GROUP BY 1) SELECT name, count(*) AS n, sum(e) AS events, any_value(median_time) AS median_time FROM sv LEFT JOIN m USING (name) GROUP BY 1")
def _(s, d):
    return survival.median_survival(outcomes(s, d), "t", "e", ["name"])


@query("logrank_oe", f"""WITH {SURV}, ev AS (SELECT t, sum(e) AS dd, 0 AS z FROM sv GROUP BY 1 HAVING sum(e) > 0), nn AS (SELECT ev.t, count(*) AS n FROM ev JOIN sv ON sv.t >= ev.t GROUP BY 1), ng AS (SELECT ev.t, sv.name, count(*) AS ng FROM ev JOIN sv ON sv.t >= ev.t GROUP BY 1, 2),
 ob AS (SELECT name, sum(e) AS observed FROM sv GROUP BY 1), ex AS (SELECT name, sum(dd * ng / n) AS expected FROM ev JOIN nn USING (t) JOIN ng USING (t) GROUP BY 1) SELECT name, observed, round(expected, 6) AS expected FROM ob JOIN ex USING (name)""")
def _(s, d):
    return r6(survival.logrank_terms(outcomes(s, d), "t", "e", "name")[0], "expected")


@query("harrell_c", f"""WITH {SURV}, {AGE}, d AS (SELECT sv.name, t, e, age FROM sv JOIN endpoints USING (ep_id) JOIN ag USING (sample_id)), p AS (SELECT a.name, count(*) FILTER (b.age < a.age) AS concordant, count(*) FILTER (b.age = a.age) AS tied, count(*) AS comparable FROM d a JOIN d b ON a.name = b.name AND a.e = 1 AND a.t < b.t GROUP BY 1)
 SELECT name, concordant, tied, comparable, round((concordant + 0.5 * tied) / comparable, 6) AS c_index FROM p""")
def _(s, d):
    j = outcomes(s, d).join(ages(s, d), "sample_id")
    return r6(survival.concordance(j, "t", "e", "age", ["name"], bins=64).where("comparable > 0"), "c_index")


@query("dca_curve", f"""WITH {SURV}, {AGE}, d AS (SELECT e, age::DOUBLE AS x FROM sv JOIN endpoints USING (ep_id) JOIN ag USING (sample_id)), z AS (SELECT e, 1 / (1 + exp(-round((x - avg(x) OVER ()) / stddev_samp(x) OVER (), 9))) AS p FROM d), th AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 13) AS r(i)),
 g AS (SELECT threshold, count(*) AS n, sum(e) AS ev, count(*) FILTER (p >= threshold) AS n_flagged, count(*) FILTER (p >= threshold AND e = 1) AS tp FROM z, th GROUP BY 1)
 SELECT threshold, n_flagged, round((tp - (n_flagged - tp) * threshold / (1 - threshold)) / n, 6) AS nb_model, round((ev - (n - ev) * threshold / (1 - threshold)) / n, 6) AS nb_treat_all FROM g""")
def _(s, d):
    j = outcomes(s, d).join(ages(s, d), "sample_id").select("e", F.col("age").cast("double").alias("x"))
    return r6(survival.decision_curve(j, "x", "e", [i / 20 for i in range(1, 13)]), "nb_model", "nb_treat_all")


# ---- metrics, folds, models ------------------------------------------------------------------------------------------
LAB = f"{TRIAL}, d AS (SELECT her2, pcr AS y, age::DOUBLE / 100 AS p FROM tr JOIN ag USING (sample_id))"


def labelled(s, d):
    return trial(s, d).join(ages(s, d), "sample_id").select("sample_id", "her2", F.col("pcr").alias("y"), (F.col("age").cast("double") / 100).alias("p"))


@query("auc_rank_sum", f"""WITH {AGE}, {LAB}, r AS (SELECT her2, y, rank() OVER (PARTITION BY her2 ORDER BY p) + (count(*) OVER (PARTITION BY her2, p) - 1) / 2.0 AS r FROM d), g AS (SELECT her2, sum(r) FILTER (y = 1) AS rs, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM r GROUP BY 1)
 SELECT her2, round((rs - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auc, n_pos, n_neg FROM g""")
def _(s, d):
    return r6(metrics.auc(labelled(s, d), "y", "p", ["her2"]), "auc")


@query("average_precision", f"""WITH {AGE}, {LAB}, c AS (SELECT her2, p, sum(y) AS k, count(*) AS n FROM d GROUP BY 1, 2), w AS (SELECT her2, k, sum(k) OVER o / sum(n) OVER o AS prec FROM c WINDOW o AS (PARTITION BY her2 ORDER BY p DESC)) SELECT her2, round(sum(prec * k) / nullif(sum(k), 0), 6) AS average_precision FROM w GROUP BY 1""")
def _(s, d):
    return r6(metrics.average_precision(labelled(s, d), "y", "p", ["her2"]), "average_precision")


@query("brier_ece", f"""WITH {AGE}, {LAB}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y, sum((p - y) ** 2) AS se FROM d GROUP BY 1) SELECT round(sum(se) / sum(n), 6) AS brier, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b""")
def _(s, d):
    return r6(metrics.calibration(labelled(s, d), "y", "p"), "brier", "ece")


@query("cdf_area", f"""WITH {SCORES}, k AS (SELECT set_name, score, count(*) AS k FROM s GROUP BY 1, 2), w AS (SELECT set_name, score - lag(score) OVER o AS gap, sum(k) OVER o - k AS below, sum(k) OVER (PARTITION BY set_name) AS n FROM k WINDOW o AS (PARTITION BY set_name ORDER BY score)) SELECT set_name, round(coalesce(sum(gap * (below + below + 1) / 2 / n), 0), 6) AS cdf_area FROM w GROUP BY 1""")
def _(s, d):
    return r6(metrics.cdf_area(scores(s, d), "score", ["set_name"]), "cdf_area")


@query("pac_from_pairs", "WITH p AS (SELECT p_brand, round((p_partkey * 7919 % 10007) / 10007.0, 9) AS c FROM part) SELECT p_brand, round(count(*) FILTER (c > 0.1 AND c < 0.9)::DOUBLE / count(c), 6) AS pac FROM p GROUP BY 1")
def _(s, d):
    p = table(s, d, "part").select("p_brand", F.round(F.expr("p_partkey * 7919 % 10007") / 10007.0, 9).alias("c"))
    return r6(metrics.ambiguous_share(p, "c", ["p_brand"]), "pac")


@query("stratified_folds", f"SELECT row_id, (row_number() OVER (PARTITION BY pcr ORDER BY row_id) - 1) % 5 AS fold FROM response_rows")
def _(s, d):
    return resampling.stratified_folds(table(s, d, "response_rows").select("row_id", "pcr"), "pcr", "row_id", 5, seed=None).select("row_id", "fold")


EMB = "x AS (SELECT vec_id, label, i AS f, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) AS t(i)), c AS (SELECT label AS predicted, f, avg(v) AS centre FROM x GROUP BY 1, 2)"


def embedded(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("f", "v"))


@query("centroid_classify", f"WITH {EMB}, e AS (SELECT vec_id, predicted, sqrt(sum((v - centre) ** 2)) AS distance FROM x JOIN c USING (f) GROUP BY 1, 2) SELECT vec_id, predicted, round(distance, 4) AS distance FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, predicted) = 1")
def _(s, d):
    e = embedded(s, d)
    return models.nearest_centroid(e, "vec_id", "f", "v", models.centroids(e, "label", "f", "v"), "label").withColumn("distance", F.round("distance", 4))


@query("centroid_cosine", f"WITH {EMB}, e AS (SELECT vec_id, predicted, 1 - sum(v * centre) / sqrt(sum(v * v) * sum(centre * centre)) AS distance FROM x JOIN c USING (f) GROUP BY 1, 2) SELECT vec_id, predicted, round(distance, 6) AS distance FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, predicted) = 1")
def _(s, d):
    e = embedded(s, d)
    return r6(models.nearest_centroid(e, "vec_id", "f", "v", models.centroids(e, "label", "f", "v"), "label", metric="cosine"), "distance")


@query("centroid_pairwise_distance", f"WITH {EMB} SELECT a.predicted AS a, b.predicted AS b, round(sqrt(sum((a.centre - b.centre) ** 2)), 6) AS distance FROM c a JOIN c b ON a.f = b.f AND a.predicted < b.predicted GROUP BY 1, 2")
def _(s, d):
    c = models.centroids(embedded(s, d), "label", "f", "v")
    a, b = c.select(F.col("label").alias("a"), "f", F.col("centre").alias("x")), c.select(F.col("label").alias("b"), "f", F.col("centre").alias("y"))
    return r6(a.join(b, "f").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) ** 2)).alias("distance")), "distance")


@query("linear_risk_tertile", f"WITH {SCORES}, r AS (SELECT sample_id, round(0.8 * max(score) FILTER (set_name = 'cell_cycle') - 0.5 * max(score) FILTER (set_name = 'lymph_core'), 6) AS risk FROM s GROUP BY 1) SELECT sample_id, risk, CASE WHEN risk >= 0.3 THEN 'high' WHEN risk <= -0.3 THEN 'low' ELSE 'medium' END AS tertile FROM r")
def _(s, d):
    w = scoring.wide_scores(scores(s, d), ["cell_cycle", "lymph_core"], prefix="")
    return survival.risk_tertiles(w.select("sample_id", F.round(0.8 * F.col("cell_cycle") - 0.5 * F.col("lymph_core"), 6).alias("risk")), "risk", (-0.3, 0.3))
