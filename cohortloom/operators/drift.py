"""Schemas that drift between files: one consistent table by rescue-column ingestion, and a report of every change.

Lines are JSON objects, read as VARIANT in the JVM, so that the type of each value is known without a schema. A target
schema says which source names (aliases) feed a field and how a value is cast. What has no place in it, or can't be cast,
is kept as JSON in the rescue column; ``promote`` replays rescued values into typed columns once a field is approved. The
ingestion logs each entry it met (name, type, the field it went to), and changes between files are read from that log; a
rename to a name that the schema doesn't know is inferred from the values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortloom.functions.clean import patient_key
from cohortloom.session import stage


@dataclass(frozen=True)
class Field:
    """A field of the target schema: its aliases (source names, case-sensitive) and the cast of the value's text, NULL
    where it can't be cast."""

    name: str
    aliases: tuple[str, ...]
    cast: Callable[[Column], Column]


def _number(kind: str) -> Callable[[Column], Column]:
    return lambda t: F.trim(t).try_cast("double").try_cast(kind)


def _receptor(t: Column) -> Column:
    v = F.lower(F.trim(t))
    return F.when(v.isin("p", "pos", "positive", "true", "1"), "POSITIVE").when(v.isin("n", "neg", "negative", "false", "0"), "NEGATIVE")


def _death(t: Column) -> Column:
    v = F.lower(F.trim(t))
    return F.when(v.isin("dead", "deceased", "true", "1"), 1).when(v.isin("alive", "living", "false", "0"), 0)


def _intrinsic(t: Column) -> Column:
    v = F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    return F.when(v.contains("basal"), "BASAL").when(v.startswith("her2"), "HER2").when(v.isin("luma", "luminala"), "LUMA").when(v.isin("lumb", "luminalb"), "LUMB").when(v.startswith("normal"), "NORMAL").when(F.regexp_like(v, F.lit("^[1-5]$")), F.concat(F.lit("CODE"), v))


#: The fields that the feeds deliver under several names.
CLINICAL_FIELDS = (
    Field("patient_id", ("patient_id", "PatientID", "patient-id", "subject", "case_id"), patient_key),
    Field("subtype_er", ("subtype_er", "Subtype_ER", "ER_status", "er_ihc", "er_result", "oestrogen_receptor"), _receptor),
    Field("event_os", ("event_os", "EVENT_OS", "os_event", "vital_status", "deceased", "death_event"), _death),
    Field("subtype_pam50", ("subtype_pam50", "Subtype_Pam50", "PAM50", "pam50_call", "intrinsic_subtype", "molecular_class"), _intrinsic),
    Field("time_os", ("time_os", "os_time", "OS_months", "followup"), _number("double")),
    Field("age", ("age", "Age", "age_years", "age_at_dx"), _number("int")),
)


def _same_name(c: Column) -> Column:
    """A name without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _parsed(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``__v``: the line as a VARIANT object; NULL for lines that aren't a readable JSON object."""
    v = F.try_parse_json(F.col(payload))
    return df.withColumn("__p", v).withColumn("__v", F.when(F.schema_of_variant("__p").startswith("OBJECT"), F.col("__p"))).drop("__p")


def _entries(v: str) -> Column:
    """The entries of a VARIANT object, as a map from name to VARIANT."""
    return F.from_json(F.to_json(v), "map<string,variant>")


def _kind(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", None).when(F.regexp_like(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")), "number").otherwise("other")


def _alias_map(fields: tuple[Field, ...]) -> Column:
    return F.create_map(*[F.lit(x) for f in fields for a in f.aliases for x in (a, f.name)]) if fields else F.create_map(F.lit(""), F.lit(""))


def ingest(df: DataFrame, keep: list[str], payload: str = "payload", fields: tuple[Field, ...] = CLINICAL_FIELDS, rescue: str = "_rescued") -> DataFrame:
    """``unify`` with the log of each line: ``_log``, an array of (name, type, field), field being the one of the target schema that
    entries of this name go to and NULL for those that can only be rescued."""
    v = _parsed(df.select(*keep, payload), payload)
    entries = v.withColumn("__m", _entries("__v")).withColumn("__t", F.transform_values("__m", lambda _, x: F.try_variant_get(x, "$", "string")))
    cols, used = {}, []
    for f in fields:
        casts = [F.struct(f.cast(F.col("__t")[a]).alias("value"), F.lit(a).alias("by")) for a in f.aliases]
        cols[f"__{f.name}"] = F.get(F.filter(F.array(*casts), lambda x: x["value"].isNotNull()), F.lit(0))
        used.append(F.col(f"__{f.name}")["by"])
    out = entries.withColumns(cols)
    stored = F.array_compact(F.array(*used)) if fields else F.array().cast("array<string>")
    left = F.map_filter("__m", lambda k, x: ~F.coalesce(F.array_contains(stored, k), F.lit(False)) & (F.schema_of_variant(x) != "VOID"))
    rest = F.when(F.col("__v").isNull() & F.col(payload).isNotNull(), F.to_json(F.create_map(F.lit("_line"), F.col(payload)))).when(F.size(left) > 0, F.to_json(left))
    alias_of = _alias_map(fields)
    log = F.transform(F.map_entries("__m"), lambda e: F.struct(e["key"].alias("name"), _kind(e["value"]).alias("type"), F.element_at(alias_of, e["key"]).alias("field")))
    return out.select(*keep, *[F.col(f"__{f.name}")["value"].alias(f.name) for f in fields], F.col("__v").isNotNull().alias("_readable"), rest.alias(rescue), F.when(F.col("__v").isNotNull(), log).alias("_log"))


def unify(df: DataFrame, keep: list[str], payload: str = "payload", fields: tuple[Field, ...] = CLINICAL_FIELDS, rescue: str = "_rescued") -> DataFrame:
    """One consistent table: columns ``keep``, the fields of the target schema, ``_readable`` and the rescue column.

    The first alias (in the order of the schema) with a value that casts fills a field. The rescue column is a JSON object
    of every entry that isn't stored in a field: unknown names and uncastable values, nulls left out; a broken line is kept
    whole under ``_line``; NULL if nothing is left over. No line is dropped; lines sent twice stay twice."""
    return ingest(df, keep, payload, fields, rescue).drop("_log")


def field_types(table: DataFrame, keys: list[str]) -> DataFrame:
    """From the log of an ingested table, for each file (``keys``) and name in any of its readable lines: ``field_name``, ``type``
    (string, number, boolean, or other, that of most non-null values, the first by name on a tie; NULL if all are null), ``field``
    (of the target schema, NULL if its values are rescued) and ``n`` (lines that have it)."""
    cells = table.select(*keys, F.inline("_log"))
    by_kind = cells.groupBy(*keys, F.col("name").alias("field_name"), F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.max("field").alias("field"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.col("n").alias("n"), F.translate("kind", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("last"), F.col("kind").alias("kind"))))
    return by_kind.groupBy(*keys, "field_name").agg(best["kind"].alias("type"), F.max("field").alias("field"), F.sum("n").alias("n"))


def _profiles(df: DataFrame, wanted: DataFrame, feed: str, file_id: str, payload: str, most: int = 32) -> DataFrame:
    """What the values of some names of some files look like: mean and sd of numbers, shares of the ``most`` commonest texts and
    shapes (letters a, digits 9). ``wanted``: __feed, __f, name."""
    files = F.broadcast(wanted.select("__feed", "__f").distinct()) if wanted.count() <= 100_000 else wanted.select("__feed", "__f").distinct()
    d = df.select(F.col(feed).alias("a"), F.col(file_id).alias("b"), payload)
    d = d.join(files, d["a"].eqNullSafe(files["__feed"]) & d["b"].eqNullSafe(files["__f"]), "left_semi")
    cells = _parsed(d, payload).where("__v is not null").select("a", "b", F.explode(_entries("__v")).alias("name", "v"))
    cells = cells.join(wanted, cells["a"].eqNullSafe(wanted["__feed"]) & cells["b"].eqNullSafe(wanted["__f"]) & (cells["name"] == wanted["name"]), "left_semi")
    text = F.lower(F.trim(F.try_variant_get("v", "$", "string")))
    cells = cells.select("a", "b", "name", text.alias("t")).where("t is not null").groupBy("a", "b", "name", "t").agg(F.count("*").alias("n"))
    x = F.col("t").try_cast("double")
    moments = cells.groupBy("a", "b", "name").agg(F.sum("n").alias("all"), F.sum(F.when(x.isNotNull(), F.col("n"))).alias("nums"), F.sum(x * F.col("n")).alias("sx"), F.sum(x * x * F.col("n")).alias("sxx"))

    def shares(c: Column, out: str) -> DataFrame:
        g = cells.groupBy("a", "b", "name", c.alias("t")).agg(F.sum("n").alias("n"))
        g = g.withColumn("k", F.row_number().over(W.partitionBy("a", "b", "name").orderBy(F.desc("n"), "t"))).where(F.col("k") <= most)
        return g.groupBy("a", "b", "name").agg(F.map_from_entries(F.collect_list(F.struct("t", F.col("n").cast("double").alias("n")))).alias(out))

    shape = F.regexp_replace(F.regexp_replace("t", r"\p{L}+", "a"), r"[0-9]+", "9")
    keys = lambda l, r: l["a"].eqNullSafe(r["a"]) & l["b"].eqNullSafe(r["b"]) & (l["name"] == r["name"])
    texts, shapes = shares(F.col("t"), "texts"), shares(shape, "shapes")
    out = moments.join(texts, keys(moments, texts)).select(moments["*"], "texts")
    out = out.join(shapes, keys(out, shapes)).select(out["*"], "shapes")
    part = lambda c: F.transform_values(c, lambda _, v: v / F.col("all"))
    mean = F.col("sx") / F.col("nums")
    return out.select("a", "b", "name", part("texts").alias("texts"), part("shapes").alias("shapes"), F.when(F.col("nums") * 2 > F.col("all"), mean).alias("mean"), F.sqrt(F.greatest(F.col("sxx") / F.col("nums") - mean * mean, F.lit(1e-9))).alias("sd"))


def _likeness(a: str, b: str) -> Column:
    """0 to 1: how alike two profiles (``a`` and ``b``: prefixes of their columns) and the names are. Values count three
    quarters: shared texts, else shapes and distributions of numbers, which tell less (half, if the names have nothing in common);
    two-valued fields are alike too easily."""

    def shared(c: str) -> Column:
        return F.aggregate(F.map_keys(f"{a}.{c}"), F.lit(0.0), lambda acc, k: acc + F.least(F.element_at(f"{a}.{c}", k), F.coalesce(F.element_at(f"{b}.{c}", k), F.lit(0.0))))

    var = F.pow(f"{a}.sd", 2) + F.pow(f"{b}.sd", 2)
    normal = F.sqrt(2 * F.col(f"{a}.sd") * F.col(f"{b}.sd") / var) * F.exp(-F.pow(F.col(f"{a}.mean") - F.col(f"{b}.mean"), 2) / (4 * var))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(_same_name(c)) - 1, F.lit(1))), lambda i: F.substring(_same_name(c), i, F.lit(2))))
    x, y = grams(F.col(f"{a}.name")), grams(F.col(f"{b}.name"))
    names = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    texts = shared("texts") * F.when(F.least(F.size(f"{a}.texts"), F.size(f"{b}.texts")) > 2, 1.0).otherwise(0.6)
    numbers = F.col(f"{a}.mean").isNotNull() & F.col(f"{b}.mean").isNotNull()
    values = F.greatest(texts, F.when(numbers, 0.8 * normal).otherwise(0.7 * shared("shapes")))
    return 0.75 * values * F.when(numbers & (names < 0.1), 0.5).otherwise(1.0) + 0.25 * names


def schema_changes(df: DataFrame, feed: str = "feed", file_id: str = "file_id", order: str = "exported_on", payload: str = "payload", fields: tuple[Field, ...] = CLINICAL_FIELDS, *, least: float = 0.55) -> DataFrame:
    """Changes of each file against the one before it in its feed (by ``order``, then ``file_id``), from the log of the ingestion:
    ``file_id``, ``field_name``, ``change`` (added, removed, renamed, retyped), ``old_name``, ``old_type``, ``new_type``, ``evidence``
    (schema, spelling or values, for renames) and ``confidence``.

    A removed and an added name are a rename if they feed the same target field (``schema``) or differ in case and punctuation only
    (``spelling``); several such pairs in a step are paired in the order of the names. Of the other removed and added names of
    a step, two are a rename if each is the other's most alike in its values and name, and alike by ``least`` (``values``). A rename
    that also changes the type gives a second row. A name whose values are all null in a file has no type there and so isn't
    retyped. The log is reduced to one row per file, name and type before anything is compared; files without a readable
    line count as files without fields. Lines sent twice count twice; null feeds are one feed; an empty table gives no rows."""
    files = df.groupBy(feed, file_id).agg(F.min(order).alias("__at"))
    files = files.withColumn("__before", F.lag(file_id).over(W.partitionBy(feed).orderBy(F.col("__at").asc_nulls_first(), file_id)))
    types = stage(field_types(ingest(df, [feed, file_id], payload, fields), [feed, file_id]), "log")  # a row a file and name
    now = types.select(F.col(feed).alias("__feed"), F.col(file_id).alias("__file"), "field_name", F.col("type").alias("new_type"), "field")
    links = stage(files.where("__before is not null").select(F.col(feed).alias("__feed"), F.col(file_id).alias("__file"), F.col("__before")), "links")
    n, o = links.alias("n"), types.select(F.col(feed).alias("__feed"), F.col(file_id).alias("__before"), "field_name", F.col("type").alias("old_type"), "field").alias("o")
    cur = n.join(now.alias("c"), (F.col("n.__file") == F.col("c.__file")) & F.col("n.__feed").eqNullSafe(F.col("c.__feed"))).select("n.__feed", "n.__file", "n.__before", "field_name", "field", "new_type", F.lit(True).alias("__new"))
    old = n.join(o, (F.col("n.__before") == F.col("o.__before")) & F.col("n.__feed").eqNullSafe(F.col("o.__feed"))).select("n.__feed", "n.__file", "n.__before", "field_name", "field", "old_type", F.lit(True).alias("__old"))
    both = cur.unionByName(old, allowMissingColumns=True)
    both = both.groupBy("__feed", "__file", "__before", "field_name").agg(F.max("new_type").alias("new_type"), F.max("__new").alias("is_new"), F.max("old_type").alias("old_type"), F.max("__old").alias("is_old"), F.max("field").alias("field"))
    both = both.withColumns({"concept": F.coalesce("field", F.concat(F.lit("="), _same_name(F.col("field_name")))), "evidence": F.when(F.col("field").isNotNull(), "schema").otherwise("spelling")})
    row = ["__file", "field_name", "change", "old_name", "old_type", "new_type", "evidence", "confidence"]
    none = F.lit(None).cast("string")
    stayed = both.where("is_new and is_old and old_type <> new_type").select("__file", "field_name", F.lit("retyped").alias("change"), F.col("field_name").alias("old_name"), "old_type", "new_type", none.alias("evidence"), F.lit(1.0).alias("confidence"))
    moved = both.where("is_new is null or is_old is null").withColumn("nth", F.row_number().over(W.partitionBy("__feed", "__file", "concept", "is_new").orderBy("field_name")))
    pair = moved.groupBy("__feed", "__file", "__before", "concept", "nth").agg(
        F.max(F.when(F.col("is_new"), F.col("field_name"))).alias("new_name"), F.max("new_type").alias("new_type"), F.max(F.when(F.col("is_old"), F.col("field_name"))).alias("old_name"), F.max("old_type").alias("old_type"), F.max("evidence").alias("evidence")
    )
    pair = stage(pair.withColumn("confidence", F.lit(1.0)), "moved")  # at most a row a file and name
    gone = pair.where("new_name is null").select("__feed", "__file", "__before", "old_name", "old_type")
    come = pair.where("old_name is null").select(F.col("__feed").alias("f2"), F.col("__file").alias("file2"), "new_name", "new_type")
    open_ = gone.join(come, (gone["__file"] == come["file2"]) & gone["__feed"].eqNullSafe(come["f2"])).drop("f2", "file2")
    open_ = stage(open_, "open")
    if not open_.isEmpty():
        wanted = stage(open_.select("__feed", F.col("__before").alias("__f"), F.col("old_name").alias("name")).unionByName(open_.select("__feed", F.col("__file").alias("__f"), F.col("new_name").alias("name"))).distinct(), "wanted")
        looks = stage(_profiles(df, wanted, feed, file_id, payload), "profiles")
        p, q = looks.alias("p"), looks.alias("q")
        scored = open_.alias("m").join(p, F.col("m.__feed").eqNullSafe(F.col("p.a")) & (F.col("m.__before") == F.col("p.b")) & (F.col("m.old_name") == F.col("p.name"))).join(q, F.col("m.__feed").eqNullSafe(F.col("q.a")) & (F.col("m.__file") == F.col("q.b")) & (F.col("m.new_name") == F.col("q.name")))
        scored = scored.select("m.*", _likeness("p", "q").alias("confidence")).where(F.col("confidence") >= least)
        rank = lambda side, other: F.row_number().over(W.partitionBy("__feed", "__file", side).orderBy(F.desc("confidence"), other))
        mates = stage(scored.withColumns({"i": rank("old_name", "new_name"), "j": rank("new_name", "old_name")}).where("i = 1 and j = 1").drop("i", "j"), "mates")
        taken = mates.select("__feed", "__file", F.explode(F.array(F.struct(F.col("old_name").alias("o"), none.alias("n")), F.struct(none.alias("o"), F.col("new_name").alias("n")))).alias("t")).select(F.col("__feed").alias("f2"), F.col("__file").alias("file2"), "t.*")
        rest = pair.join(taken, (pair["__file"] == taken["file2"]) & pair["__feed"].eqNullSafe(taken["f2"]) & pair["old_name"].eqNullSafe(taken["o"]) & pair["new_name"].eqNullSafe(taken["n"]), "left_anti")
        pair = rest.unionByName(mates.withColumns({"concept": none, "nth": F.lit(1), "evidence": F.lit("values")}))
    changes = F.when(F.col("old_name").isNull(), F.array(F.lit("added"))).when(F.col("new_name").isNull(), F.array(F.lit("removed"))).when(F.col("old_type") != F.col("new_type"), F.array(F.lit("renamed"), F.lit("retyped"))).otherwise(F.array(F.lit("renamed")))
    renamed = F.col("old_name").isNotNull() & F.col("new_name").isNotNull()
    moved = pair.select("__file", F.coalesce("new_name", "old_name").alias("field_name"), F.explode(changes).alias("change"), "old_name", "old_type", "new_type", F.when(renamed, F.col("evidence")).alias("evidence"), F.round("confidence", 4).alias("confidence"))
    return stayed.select(*row).unionByName(moved.select(*row)).withColumnRenamed("__file", file_id)


def promote(table: DataFrame, fields: tuple[Field, ...], rescue: str = "_rescued") -> DataFrame:
    """Approve fields: rescued values that cast are replayed into typed columns (new ones, or gaps of those there are)
    and leave the rescue column; the others stay rescued."""
    entries = table.withColumn("__m", F.from_json(F.col(rescue), "map<string,variant>")).withColumn("__t", F.transform_values("__m", lambda _, x: F.try_variant_get(x, "$", "string")))
    cols, used = {}, []
    for f in fields:
        casts = [F.struct(f.cast(F.col("__t")[a]).alias("value"), F.lit(a).alias("by")) for a in f.aliases]
        hit = F.get(F.filter(F.array(*casts), lambda x: x["value"].isNotNull()), F.lit(0))
        cols[f"__{f.name}"] = F.when(F.col(f.name).isNull(), hit) if f.name in table.columns else hit
        used.append(F.col(f"__{f.name}")["by"])
    out = entries.withColumns(cols)
    left = F.map_filter("__m", lambda k, _: ~F.coalesce(F.array_contains(F.array_compact(F.array(*used)), k), F.lit(False)))
    names = {f.name for f in fields}
    kept = [c for c in table.columns if c != rescue and c not in names]
    filled = [(F.coalesce(F.col(f.name), F.col(f"__{f.name}")["value"]) if f.name in table.columns else F.col(f"__{f.name}")["value"]).alias(f.name) for f in fields]
    return out.select(*kept, *filled, F.when(F.size(left) > 0, F.to_json(left)).alias(rescue))
