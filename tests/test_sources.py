"""Readers and sinks over freshly written files, the streaming check, and the driver contract."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from cohortloom.sources import readers, sinks
from cohortloom.streaming.checks import windowed_quality


def test_matrix(spark, tmp_path):
    p = tmp_path / "m.tsv"
    p.write_text("gene\tgene_type\tA.1\tA.1\tB\nabc\tprotein_coding\t3\t5\t900\nABC\tprotein_coding\t7\t7\t7\nxyz\tprotein_coding\tx\tnan\t1\nrna\tlncRNA\t9\t9\t9\n")
    got = {(r["gene"], r["sample_id"]): r["value"] for r in readers.read_matrix(spark, str(p), log=False).collect()}
    assert got == {("ABC", "A-1"): 4.0, ("ABC", "B"): 900.0, ("XYZ", "A-1"): 0.0, ("XYZ", "B"): 1.0}
    logged = {(r["gene"], r["sample_id"]): r["value"] for r in readers.read_matrix(spark, str(p)).collect()}
    assert logged["XYZ", "B"] == pytest.approx(1.0)
    small = tmp_path / "s.tsv"
    small.write_text("S1\tS2\nabc\t3\t50\n")
    assert {r["value"] for r in readers.read_matrix(spark, str(small), short_header=True).collect()} == {3.0, 50.0}


def test_series_and_annotation(spark, tmp_path):
    text = '!Series_title\t"study"\n!Series_platform_id\t"P1"\n!Sample_geo_accession\t"S1"\t"S2"\n!Sample_characteristics_ch1\t"age: 32"\t"grade: 2"\n!Sample_characteristics_ch1\t"age: 33"\t"no colon"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\t"S9"\n"p1"\t8.1\tx\t1\n!series_matrix_table_end\n'
    p = tmp_path / "s.txt.gz"
    p.write_bytes(gzip.compress(text.encode("latin-1")))
    s = readers.read_series(spark, str(p))
    assert (s["title"], s["platform_id"], s["sample_ids"]) == ("study", "P1", ["S1", "S2"])
    assert {tuple(r) for r in s["characteristics"].collect()} == {("S1", "age", "32"), ("S1", "age__2", "33"), ("S2", "grade", "2")}
    assert sorted(tuple(r) for r in s["expr"].select("probe", "sample_id", F.coalesce("value", F.lit(-1.0))).collect()) == [("p1", "S1", 8.1), ("p1", "S2", -1.0)]
    assert {tuple(r) for r in readers.read_row_keyed(spark, str(p)).collect()} == {("S1", "age", "32"), ("S2", "age", "2")}
    a = tmp_path / "a.txt"
    a.write_text("#c\n!x\nID\tother\tGene Symbol\np1\t.\tabc /// d\np2\t.\t---\np3\t.\n")
    assert {tuple(r) for r in readers.read_annotation(spark, str(a)).collect()} == {("p1", "ABC"), ("p2", None), ("p3", None)}


def test_gmt_config_cohort_and_sinks(spark, tmp_path):
    p = tmp_path / "g.gmt"
    p.write_text("one\nname\tdesc\nset\tdesc\tabc\tDef\t\n")
    assert [tuple(r) for r in readers.read_gmt(spark, str(p)).collect()] == [("set", "desc", ["ABC", "DEF"])]
    (tmp_path / "c.json").write_text('{"k": 1}')
    assert readers.read_config(str(tmp_path / "c.json")) == {"k": 1}
    e = spark.createDataFrame([("G", "s1", 1.0), ("G", "s2", 1.0)], "gene string, sample_id string, value double")
    c = readers.Cohort("x", e, spark.createDataFrame([("s1", 1)], "sample_id string, age int"), spark.createDataFrame([("s1", 0), ("s3", 1)], "sample_id string, pcr int"))
    a = c.aligned()
    assert a.expr.count() == 1 and a.endpoints.count() == 1
    with pytest.raises(ValueError, match="samples"):
        c.aligned(5)
    a.write(str(tmp_path / "cohort"))
    assert readers.Cohort.read(spark, str(tmp_path / "cohort")).meta == {"n_samples": "1"}
    assert sinks.markdown_table(e.limit(1)).splitlines()[0] == "| gene | sample_id | value |"
    sinks.write_json({"a": float("nan"), "b": [1.5, float("inf")]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [1.5, None]}
    out = readers.overlay_clinical(spark.createDataFrame([("s1", None)], "sample_id string, age int"), spark.createDataFrame([("s1", 40)], "sample_id string, age int"), spark.createDataFrame([("s1", 3.0)], "sample_id string, time_os double"))
    assert [r.asDict() for r in out.collect()] == [{"sample_id": "s1", "age": 40, "time_os": 3.0}]


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 10:00:00", "ab"[i % 2], float(i) if i % 5 else None) for i in range(30)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in windowed_quality(d, "ts", "v", "k").collect()}
    q = windowed_quality(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "ts", "v", "k").writeStream.format("memory").queryName("wq").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("wq").collect()} == want and len(want) == 6


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
