"""Queries of the training-corpus operators (problems 2, 3, 6, 7, 8 and 9) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.clean import NO_VALUE, block_key, cohort_key, no_value_number, no_value_text, patient_key, squash, stage_code
from cohortloom.llm.canon import UNMATCHED, map_to_canon, normal_form
from cohortloom.llm.leaks import find_leaks
from cohortloom.llm.packing import pack, token_count
from cohortloom.llm.spans import document_pairs, share_of_documents, shared_spans
from cohortloom.llm.splits import assign_splits, linked_sets
from cohortloom.llm.survivors import fuse
from cohortloom.session import table

SPAN = 400


def fused_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """age, grade, ki67 and stage of each patient, from the best of the patient's records."""
    trust = table(spark, sf_dir, "providers").select("provider", "trust")
    df = table(spark, sf_dir, "clinical").join(trust, "provider", "left")
    stage = F.coalesce(stage_code("stage").cast("string"), F.lower(squash("stage")))
    fields = {
        "age": F.col("age"),
        "grade": F.when(~no_value_number("grade", 1.0, 3.0), F.col("grade")),
        "ki67": F.when(~no_value_number("ki67", 0.0, 100.0), F.col("ki67")),
        "stage": F.when(~no_value_text("stage"), stage),
    }
    return fuse(df, patient_key("patient_id"), "rec_id", "provider", F.col("trust"), F.col("updated_at"), fields)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fused_patients(spark, sf_dir).where("undisputed and n_records >= 2")
    return done.select(F.col("group").alias("patient_id"), "field", F.col("record").alias("rec_id"))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per patient, each field with the record it comes from."""
    fields = ["age", "grade", "ki67", "stage"]
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return fused_patients(spark, sf_dir).groupBy(F.col("group").alias("patient_id")).agg(
        F.max("n_records").alias("n_records"), *[x for f in fields for x in (pick(f, "value").alias(f), pick(f, "record").alias(f"{f}_rec"), F.round(pick(f, "posterior"), 4).alias(f"{f}_posterior"))]
    )


def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_sets(table(spark, sf_dir, "response_rows"), "row_id", {"patient": patient_key("patient_id"), "block": block_key("block_id")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_rows(spark, sf_dir).where("row <> first").select(F.col("first").alias("first_row"), F.col("row").alias("row_id"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "split_plan").collect()  # the plan: a few parameters
    df = table(spark, sf_dir, "response_rows").join(linked_rows(spark, sf_dir), F.col("row_id") == F.col("row"))
    strata = {"name": cohort_key("name"), "subtype": F.upper(squash("subtype"))}
    by = [strata.get(c, F.col(c)) for c in plan[0]["stratify_by"]] if plan else []
    return assign_splits(df, "row_id", "first", {r["split_name"]: r["fraction"] for r in plan}, by).select(F.col("row").alias("row_id"), F.col("first").alias("first_row"), "split_name")


#: Marks of editing around a free-typed value, and spellings in normal form of the entries of ref_values.
_EDITS = r"[;,/] *array *$|\[[^\]]*\]|^(?:->|call=|=)|^(?:result|initial|pam50|subtype|call|status)\s*:|[;*?'\"]+"
RULES = {
    "stage": (
        _EDITS + r"|\b(?:ajcc\s*[678]?|path\.?|revised|clinical|tumour|tumor|at entry)(?![a-z0-9])|[(),]",
        [(r"^ *(?:stg|stadium|st)\b\.?", "stage"), (r"\bp(?=(?:iv|i{1,3})[abc]?\b)", ""), (r"\b(?:iv|4)[abc]?\b", "four"), (r"\b(?:iii|3)[abc]?\b", "three"), (r"\b(?:ii|2)[abc]?\b", "two"), (r"\b(?:i|1)[abc]?\b", "one")],
    ),
    "subtype_er": (
        _EDITS + r"|/ *ihc|\( *ihc *\)|\bihc\b|^ *er status\b",
        [(r"^ *er\b *:? *", ""), (r"^ *(?:pos|p|\+|1(?:\.0)?|yes|y|expressed|positiv)\.? *$", "positive"), (r"^ *(?:neg|n|-|0(?:\.0)?|no|not expressed|negativ)\.? *$", "negative")],
    ),
    "subtype_pam50": (
        _EDITS + r"|[/,;] *array|\( *array *\)|\bsubtype\b:?",
        [(r"[._()-]+", " "), (r" +", " "), (r"^ *([ab]) luminal *$", "luminal $1"), (r"\blum ?([ab])\b", "luminal $1"), (r"\bluminal([ab])\b", "luminal $1"), (r"\b(basal|normal)like\b", "$1 like"), (r"\berbb2/her ?2\b", "her2"), (r"\bher 2\b", "her2"), (r"\bher2 e(?:nr)?\b", "her2 enriched"), (r" type *$", "")],
    ),
}
#: A spelling that neither the entry nor its label has.
SPELLINGS = {("subtype_pam50", "NORMAL"): ["normal breast like"]}
MAPPED = ("stage", "subtype_er", "subtype_pam50")
#: Least cosine by field: "grade 2" must not pass for "stage 2", so stages, told apart by one word, need more than the rest.
LEAST = {"stage": 0.62, "subtype_er": 0.45, "subtype_pam50": 0.45}


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed cells of clinical that have a value: rec_id, field, value."""
    cells = F.array(*[F.when(~no_value_text(f), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f in MAPPED])
    return table(spark, sf_dir, "clinical").select("rec_id", F.explode(F.array_compact(cells)).alias("c")).select("rec_id", "c.*")


def ref_surfaces(ref: DataFrame, rules: dict = RULES) -> DataFrame:
    """Spellings of the entries in normal form: the entry, its label up to a comma, and ``SPELLINGS``. field, entry, surface."""
    extra = F.coalesce(*[F.when((F.col("field") == f) & (F.col("entry") == e), F.array(*map(F.lit, forms))) for (f, e), forms in SPELLINGS.items()], F.array().cast("array<string>"))
    texts = F.concat(F.array(F.col("entry"), F.substring_index("label", ",", 1)), extra)
    long = ref.select("field", "entry", F.explode(texts).alias("text")).where("text is not null")
    return long.select("field", "entry", F.coalesce(normal_form(F.col("field"), F.col("text"), rules), F.lower("text")).alias("surface")).distinct()


def mapped_values(spark: SparkSession, sf_dir: str, rules: dict = RULES) -> DataFrame:
    """The entry of ref_values that each distinct typed value names."""
    return map_to_canon(typed_values(spark, sf_dir), "field", "value", ref_surfaces(table(spark, sf_dir, "ref_values"), rules), rules, threshold=LEAST)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = table(spark, sf_dir, "ref_values").select("field", F.col("entry").alias("value"))
    cells = typed_values(spark, sf_dir).join(F.broadcast(exact), ["field", "value"], "left_anti")  # ref_values: a fixed list
    return cells.join(mapped_values(spark, sf_dir), ["field", "value"]).select("rec_id", "field", "entry")


def p6_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct typed value, its entry or UNMATCHED, the scores, and how often it was typed."""
    n = typed_values(spark, sf_dir).groupBy("field", "value").agg(F.count("*").alias("n"))
    return mapped_values(spark, sf_dir).join(n, ["field", "value"]).select("field", "value", "entry", F.round("score", 4).alias("score"), F.round("runner_up", 4).alias("runner_up"), "n")


def p6_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index alone maps, without rewrites, beside the mapping with them. Of the cells that aren't exactly an entry, by field:
    n, mapped (with rules), alike (the same entry without), lost (unmatched without), other (another entry)."""
    plain = mapped_values(spark, sf_dir, {f: (r"[^\p{L}\p{N}+-]+", []) for f in RULES}).select("field", "value", F.col("entry").alias("plain"))
    exact = table(spark, sf_dir, "ref_values").select("field", F.col("entry").alias("value"))
    cells = typed_values(spark, sf_dir).groupBy("field", "value").agg(F.count("*").alias("k")).join(F.broadcast(exact), ["field", "value"], "left_anti")  # ref_values: a fixed list
    j = cells.join(mapped_values(spark, sf_dir), ["field", "value"]).join(plain, ["field", "value"])
    n = lambda cond: F.sum(F.when(cond, F.col("k")).otherwise(0))
    named = F.col("entry") != UNMATCHED
    return j.groupBy("field").agg(F.sum("k").alias("n"), n(named).alias("mapped"), n(named & (F.col("plain") == F.col("entry"))).alias("alike"), n(named & (F.col("plain") == UNMATCHED)).alias("lost"), n((F.col("plain") != UNMATCHED) & (F.col("plain") != F.col("entry"))).alias("other"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    return pack(docs, "doc_id", "tokens", table(spark, sf_dir, "pack_plan"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir).where("n_pieces > 1 and piece_no = 0").select(F.col("plan").cast("int").alias("plan_id"), F.col("item").alias("doc_id"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers of each plan: pieces, tokens, room left, cost."""
    plans = table(spark, sf_dir, "pack_plan").select(F.col("plan_id").alias("plan"), F.col("capacity_tokens").alias("capacity"))
    done = packed_documents(spark, sf_dir).groupBy("plan", "container").agg(F.count("*").alias("n_pieces"), F.sum("piece_tokens").alias("tokens"), F.round(F.sum("cost"), 3).alias("cost"))
    return done.join(plans, "plan").select(F.col("plan").alias("plan_id"), "container", "n_pieces", "tokens", (F.col("capacity") - F.col("tokens")).alias("room"), "cost")


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id")).distinct()


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items: in how many documents, and how much of the item at most."""
    return leaks(spark, sf_dir).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("n_docs"), F.round(F.max(F.col("held_words") / F.col("item_words")), 4).alias("most_held"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return document_pairs(shared_spans(docs, "doc_id", "text", "received_at", least=SPAN), docs, "doc_id", "text", SPAN)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shares = share_of_documents(docs, "doc_id", "text", shared_spans(docs, "doc_id", "text", "received_at", least=SPAN), SPAN)
    return shares.select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "n_copies", "n_links", "shared_chars", F.round("share", 6).alias("share"))


QUERIES = {
    "p2_found": p2_found, "p2_survivors": p2_survivors, "p3_found": p3_found, "p3_splits": p3_splits, "p6_found": p6_found, "p6_mapping": p6_mapping, "p6_without_rules": p6_without_rules, "p7_found": p7_found, "p7_containers": p7_containers,
    "p8_found": p8_found, "p8_leaked_items": p8_leaked_items, "p9_found": p9_found, "p9_shares": p9_shares,
}

_PATIENT = r"CASE WHEN regexp_matches(patient_id, '^\s*[A-Za-z]+\s*[-._ ]\s*[A-Za-z][A-Za-z0-9]*\s*[-._ ]\s*[0-9]+(\s*[-._ ].*)?\s*$') THEN upper(regexp_replace(patient_id, '^\s*([A-Za-z]+)\s*[-._ ]\s*([A-Za-z][A-Za-z0-9]*)\s*[-._ ]\s*([0-9]+).*$', '\1-\2-\3', 's')) END"
_SAYS_NONE = ", ".join("'" + v.replace("'", "''") + "'" for v in NO_VALUE)
_STAGE = rf"(stage IS NOT NULL AND lower(trim(regexp_replace(trim(regexp_replace(stage, '[\s\x{{00a0}}]+', ' ', 'g')), '^[\[(<]+|[\])>]+$', '', 'g'))) NOT IN ({_SAYS_NONE}))"
_CELLS = " UNION ALL ".join(f"SELECT pid, '{f}' AS field, rec_id, updated_at, trust FROM r WHERE {ok}" for f, ok in (("age", "age IS NOT NULL"), ("grade", "grade BETWEEN 1 AND 3"), ("ki67", "ki67 BETWEEN 0 AND 100"), ("stage", _STAGE)))
SQL: dict[str, str] = {
    "p2_found": f"""WITH r AS (SELECT {_PATIENT} AS pid, clinical.*, coalesce(trust, 2147483647) AS trust FROM clinical LEFT JOIN providers USING (provider)), k AS (SELECT pid FROM r WHERE pid IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
        c AS (SELECT * FROM ({_CELLS}) WHERE pid IN (SELECT pid FROM k)), m AS (SELECT pid, field, max(updated_at) AS u, min(trust) AS t FROM c GROUP BY 1, 2)
        SELECT pid AS patient_id, field, min(rec_id) AS rec_id FROM c JOIN m USING (pid, field) WHERE updated_at = u AND trust = t GROUP BY 1, 2""",
    "p3_found": rf"""WITH RECURSIVE k AS (SELECT row_id, 'p' || {_PATIENT} AS key FROM response_rows WHERE {_PATIENT} IS NOT NULL UNION ALL SELECT row_id, 'b' || upper(trim(block_id)) FROM response_rows WHERE regexp_matches(upper(trim(block_id)), '[A-Z]') AND regexp_matches(block_id, '[1-9]')),
        e AS (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM k a JOIN k b ON a.key = b.key AND a.row_id <> b.row_id), walk(a, b) AS (SELECT row_id, row_id FROM response_rows UNION SELECT walk.a, e.b FROM walk JOIN e ON walk.b = e.a)
        SELECT min(b) AS first_row, a AS row_id FROM walk GROUP BY a HAVING min(b) < a""",
    "p9_found": """WITH w AS (SELECT doc_id, md5_number_lower(substr(text, i, 400)) AS h, md5_number_upper(substr(text, i, 400)) AS g FROM documents, unnest(range(1, length(text) - 398)) AS t(i) WHERE length(text) >= 400),
        k AS (SELECT g, h FROM w GROUP BY 1, 2 HAVING min(doc_id) < max(doc_id)), s AS (SELECT DISTINCT doc_id, g, h FROM w SEMI JOIN k USING (g, h))
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.g = b.g AND a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_shares": """WITH d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, i, md5_number_lower(substr(text, i, 400)) AS h, md5_number_upper(substr(text, i, 400)) AS g FROM d, unnest(range(1, length(text) - 398)) AS t(i) WHERE doc_id = class_id AND length(text) >= 400),
        k AS (SELECT g, h FROM w GROUP BY 1, 2 HAVING min(doc_id) < max(doc_id)), s AS (SELECT doc_id, i, g, h FROM w SEMI JOIN k USING (g, h)), u AS (SELECT DISTINCT doc_id, g, h FROM s),
        c AS (SELECT doc_id, sum(least(400, coalesce(following - i, 400))) AS shared FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM s) GROUP BY 1),
        l AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n_links FROM u a JOIN u b USING (g, h) WHERE a.doc_id <> b.doc_id GROUP BY 1),
        o AS (SELECT d.doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links, (CASE WHEN n_copies > 1 THEN length(text) ELSE coalesce(shared, 0) END)::INT AS shared_chars, length(text) AS chars FROM d LEFT JOIN c ON class_id = c.doc_id LEFT JOIN l ON class_id = l.doc_id)
        SELECT doc_id, class_id, n_copies, n_links, shared_chars, round(CASE WHEN chars > 0 THEN shared_chars / chars ELSE 0 END, 6) AS share FROM o""",
    "p7_found": r"""SELECT plan_id, doc_id FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+')) AS n FROM documents) JOIN pack_plan ON n > capacity_tokens""",
}
