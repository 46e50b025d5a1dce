"""Fill (problem 1), units (4) and schema drift (5)."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.clean import block_key, no_value_number, no_value_text, patient_key, stage_code
from cohortloom.functions.quantity import MONTH_DAYS, YEAR_DAYS, convert, parse_unit
from cohortloom.operators.drift import CLINICAL_FIELDS, Field, promote, schema_changes, unify
from cohortloom.operators.impute import fill_missing
from cohortloom.operators.units import harmonise_durations, split_quantity

CLINICAL = "rec_id long, grp string, grade double, ki67 double, stage string, extra string"


def fill(df):
    gone = {"grade": no_value_number("grade", 1, 3), "ki67": no_value_number("ki67", 0, 100), "stage": no_value_text("stage")}
    return fill_missing(
        df, {"grade": F.when(~gone["grade"], F.col("grade")), "ki67": F.when(~gone["ki67"], F.col("ki67"))}, {"stage": F.when(~gone["stage"], F.col("stage")), "grp": F.col("grp")},
        {"grade": (1.0, 3.0), "ki67": (0.0, 100.0)}, ["grade", "ki67", "stage"], missing=gone, classes=4, steps=10,
    )


def test_fill_beats_the_overall_mean_on_held_out_cells(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], {}
    for i in range(1500):
        g = "abc"[i % 3]
        grade, ki = float(np.clip(round({"a": 1, "b": 2, "c": 3}[g] + rng.normal(0, 0.3)), 1, 3)), float(np.clip({"a": 8, "b": 25, "c": 60}[g] + rng.normal(0, 4), 0, 100))
        stage = {"a": "I", "b": "II", "c": "III"}[g] if rng.random() < 0.85 else "IV"
        truth[i] = (grade, ki, stage)
        hide = rng.random(3) < 0.25
        rows.append((i, g, [None, float("nan"), 9.0][i % 3] if hide[0] else grade, None if hide[1] else ki, ["n/a", None, " ", "?"][i % 4] if hide[2] else stage, "x"))
    out = fill(spark.createDataFrame(rows, CLINICAL)).toPandas()
    assert list(out.columns)[:6] == ["rec_id", "grp", "grade", "ki67", "stage", "extra"] and len(out) == 1500
    ki = out[out.ki67_was_filled]
    t = np.array([truth[i][1] for i in ki.rec_id])
    assert np.sqrt(((ki.ki67_filled - t) ** 2).mean()) < 0.4 * t.std()
    st = out[out.stage_was_filled]
    assert (st.stage_filled == [truth[i][2] for i in st.rec_id]).mean() > 0.75
    assert not out.ki67_filled.isna().any() and out.grade_filled.between(1, 3).all()
    kept = out[~out.grade_was_filled]
    assert (kept.grade_filled == kept.grade).all()
    assert {i for i in out.rec_id[out.grade_was_filled]} == {r[0] for r in rows if r[2] is None or not 1 <= r[2] <= 3}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None)], [(1, "a", 2.0, None, "", None)] * 3 + [(None, None, float("nan"), 5.0, "II", "y")]])
def test_fill_edge_cases(spark, rows):
    out = fill(spark.createDataFrame(rows, CLINICAL)).toPandas()
    assert len(out) == len(rows)
    assert all(v == v and 1 <= v <= 3 for v in out.grade_filled)


def test_fill_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 5.0, "I", "x"), (2, "a", 2.0, 6.0, "I", "x")], CLINICAL).withColumn("grade_filled", F.lit("old"))
    out = fill(df).toPandas()
    assert list(out.columns).count("grade_filled") == 1 and out.grade_filled.notna().all()


def test_missing_and_keys(spark):
    texts = [None, "", " ", "?", "--", "N.A.", "[not available]", "Nicht erfasst", "NONE GIVEN", " ", "borderline", "+", "0"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(no_value_text("t")).collect()]
    assert got == [True] * 10 + [False] * 3
    ids = {"msa.a4.00000303": "MSA-A4-00000303", "LKS - E2 - 00000609": "LKS-E2-00000609", " TMN_B3_00000126\t": "TMN-B3-00000126", "TMN-D2-00001047-06A-11R": "TMN-D2-00001047", "not linked": None, "-": None, "": None, "UNKNOWN": None, None: None}
    d = spark.createDataFrame([(k,) for k in ids], "t string").select("t", patient_key("t").alias("k")).collect()
    assert {r["t"]: r["k"] for r in d} == ids
    blocks = {"TB00-000062 ": "TB00-000062", "tb00-000062": "TB00-000062", "NOBLOCK": None, "0": None, "n/a": None, "pending": None, None: None}
    d = spark.createDataFrame([(k,) for k in blocks], "t string").select("t", block_key("t").alias("k")).collect()
    assert {r["t"]: r["k"] for r in d} == blocks
    stages = {"pIIA": 2, "Stage 3b": 3, "stage four": 4, "sage I": 1, "AJCC IIIC": 3, "grade": None, None: None}
    d = spark.createDataFrame([(k,) for k in stages], "t string").select("t", stage_code("t").alias("k")).collect()
    assert {r["t"]: r["k"] for r in d} == stages


def test_unit_grammar():
    assert parse_unit("mo.").name == "months" and parse_unit(" (Wochen) ").name == "weeks" and parse_unit("").dims if parse_unit("") else True
    assert parse_unit("mg/l").dims == (0, -3, 1, 0, 0, 0) and parse_unit("mg/l").scale == pytest.approx(1.0)
    assert parse_unit("kg*m^2/s^2").dims == (-2, 2, 1, 0, 0, 0)
    assert convert(100.0, parse_unit("°C"), parse_unit("°F")) == pytest.approx(212.0)
    assert convert(1.0, parse_unit("years"), parse_unit("months")) == pytest.approx(12.0)
    assert parse_unit("furlong") is None and parse_unit("/s") is None and parse_unit("kd") is None and parse_unit("9") is None
    with pytest.raises(ValueError, match="dimension"):
        convert(1.0, parse_unit("kg"), parse_unit("m"))


def test_split_quantity(spark):
    texts = {"~9,0 Monate": ("9,0", "monate"), "months: 43.79": ("43.79", "months"), "9.9 (mo)": ("9.9", "mo"), "4,340Tage": ("4,340", "tage"), "approx. 12 MO.": ("12", "mo."), ">232 day": ("232", "day"), "454.1+ w": ("454.1", "w"), "not reached": (None, None), "61.8": ("61.8", None), "": (None, None), None: (None, None)}
    d = spark.createDataFrame([(k,) for k in texts], "t string")
    n, u = split_quantity(F.col("t"))
    assert {r["t"]: (r["n"], r["u"]) for r in d.select("t", n.alias("n"), u.alias("u")).collect()} == texts


UNITS = {"days": 1.0, "weeks": 7.0, "months": MONTH_DAYS, "years": YEAR_DAYS}


def test_durations(spark):
    rows = [
        (1, "10.35", None, "months", 315, 315, "months", "documented", 10.35), (2, "315", None, "months", 315, 315, "days", "dates", 315 / MONTH_DAYS), (3, "9.52yrs", "days", "months", None, None, "years", "text", 9.52 * 12),
        (4, "99.3", "wk", None, 695, 695, "weeks", "column", 99.3 * 7 / MONTH_DAYS), (5, "4,340Tage", None, None, None, None, "days", "text", 4340 / MONTH_DAYS), (6, "22,83 (months)", "wk", None, None, None, "months", "text", 22.83),
        (7, "not reached", None, "days", 3, 3, None, None, None), (8, None, None, None, None, None, None, None, None), (9, "5", None, None, None, None, None, None, None), (10, "12 parsecs", None, "days", None, None, None, "text", None),
        (11, "0", None, "months", 0, 0, "months", "documented", 0.0), (12, "9.7", None, "months", 164, 500, "months", "documented", 9.7),
    ]
    d = spark.createDataFrame([r[:6] for r in rows], "id int, v string, said string, doc string, lo int, hi int").withColumn("unit", F.lit("clash"))
    got = {r["id"]: r for r in harmonise_durations(d, "v", "said", "doc", "lo", "hi", parse_unit("months"), UNITS).collect()}
    assert len(got) == len(rows)
    for i, *_, unit, source, months in rows:
        assert (got[i]["unit"], got[i]["converted"]) == (unit, pytest.approx(months) if months is not None else None), i
        if unit:
            assert got[i]["unit_source"] == source, i
    assert harmonise_durations(d.limit(0), "v", "said", "doc", "lo", "hi", parse_unit("months"), UNITS).count() == 0


def feed(spark, files, name="f"):
    rows = [(name, i, f"2020-01-{i:02d} 00:00:00", n, p if isinstance(p, str) or p is None else json.dumps(p)) for i, lines in files.items() for n, p in enumerate(lines)]
    return spark.createDataFrame(rows, "feed string, file_id long, exported_on string, line_no int, payload string")


def test_schema_changes(spark):
    files = {
        1: [{"subtype_er": "pos", "ki67": 3, "bilateral": True}] * 3, 2: [{"ER_status": "neg", "ki67": "x", "bilateral": True}, {"ER_status": "neg", "ki67": 3.5, "bilateral": "NA"}, {"ER_status": None, "ki67": 4, "bilateral": False}, '{"broken'],
        3: [{"ER_status": 1, "rin": 2}] * 2, 4: [{"er_ihc": True, "rin": None}], 5: ["broken", None, "[1, 2]", '"text"'], 6: [{"er_ihc": True}],
    }
    got = {tuple(r) for r in schema_changes(feed(spark, files)).select("file_id", "field_name", "change").collect()}
    assert got == {
        (2, "ER_status", "renamed"), (3, "ER_status", "retyped"), (3, "ki67", "removed"), (3, "bilateral", "removed"), (3, "rin", "added"),
        (4, "er_ihc", "renamed"), (4, "er_ihc", "retyped"), (5, "er_ihc", "removed"), (5, "rin", "removed"), (6, "er_ihc", "added"),
    }
    assert schema_changes(feed(spark, files).limit(0)).count() == 0


def test_unify_promote_and_keep_everything(spark):
    files = {1: [{"subject": "nvk.h4.00000898", "Subtype_ER": "P", "ki67": 2.8, "age_years": "82", "os_event": "Alive", "time_os": "n.d."}, {"PatientID": "X", "ki67": "n.d."}, "{broken", None, "{}"]}
    out = unify(feed(spark, files), ["file_id", "line_no"])
    r = {x["line_no"]: x.asDict() for x in out.collect()}
    assert r[0]["patient_id"] == "NVK-H4-00000898" and r[0]["subtype_er"] == "POSITIVE" and r[0]["age"] == 82 and r[0]["event_os"] == 0 and r[0]["time_os"] is None
    assert json.loads(r[0]["_rescued"]) == {"ki67": 2.8, "time_os": "n.d."} and json.loads(r[1]["_rescued"]) == {"PatientID": "X", "ki67": "n.d."}
    assert json.loads(r[2]["_rescued"]) == {"_line": "{broken"} and not r[2]["_readable"] and r[3]["_rescued"] is None and r[4]["_rescued"] is None
    p = {x["line_no"]: x.asDict() for x in promote(out, (Field("ki67", ("ki67",), lambda t: F.trim(t).try_cast("double")),)).collect()}
    assert p[0]["ki67"] == 2.8 and json.loads(p[0]["_rescued"]) == {"time_os": "n.d."} and p[1]["ki67"] is None and "ki67" in json.loads(p[1]["_rescued"])
    assert len({a for f in CLINICAL_FIELDS for a in f.aliases}) == sum(len(f.aliases) for f in CLINICAL_FIELDS)


def test_rare_levels_are_never_filled_in_nor_counted_as_a_real_level(spark):
    from cohortloom.operators.impute import fill_and_model

    rows = [(i, "abcdefgh"[i % 8], 2.0, 10.0, ["I"] * 12 + ["II"] * 8, "x") for i in range(20)]
    rows = [(i, g, gr, ki, s[i], x) for i, g, gr, ki, s, x in rows] + [(100 + i, "z", 2.0, 10.0, f"rare{i}", "x") for i in range(15)] + [(200, "z", 2.0, 10.0, None, "x")]
    df = spark.createDataFrame(rows, CLINICAL)
    out, m = fill_and_model(df, {"grade": F.col("grade"), "ki67": F.col("ki67")}, {"stage": F.col("stage"), "grp": F.col("grp")}, {"grade": (1, 3), "ki67": (0, 100)}, ["stage"], missing={"stage": F.col("stage").isNull()}, classes=2, max_levels=2)
    assert m.levels["stage"] == ["I", "II"] and m.other == {"stage", "grp"} and m.size("stage") == 3
    got = {r["rec_id"]: r for r in out.collect()}
    assert got[200]["stage_was_filled"] and got[200]["stage_filled"] in ("I", "II") and got[101]["stage_filled"] == "rare1" and not got[101]["stage_was_filled"]
