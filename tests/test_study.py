"""Survival models out of fold, suites, confounding checks and frames on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import confounding, drift, frames, quality, risk_models, suites, survival


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=(n, 7))
    time = rng.exponential(5 / np.exp(1.2 * x[:, 0] - 0.6 * x[:, 1]))
    pdf = pd.DataFrame(x, columns=[f"sig_{i}" for i in range(7)]).assign(row=np.arange(n), t=np.round(time, 3), e=(time < 8).astype(int), fold=np.arange(n) % 4)
    pdf.loc[::17, "sig_3"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_survival_models_out_of_fold(spark, study):
    _, df = study
    sigs = [f"sig_{i}" for i in range(7)]
    zoo = {"two": lambda: risk_models.CoxRisk(["sig_0", "sig_1"]), "noise": lambda: risk_models.CoxRisk(["sig_5"]), "factors": lambda: risk_models.FactorCox(sigs, k=3, runs=2), "stack": lambda: risk_models.StackedCox([risk_models.CoxRisk(["sig_0"]), risk_models.RandomCox(3, 1)]), "none": lambda: risk_models.CoxRisk(["absent"])}
    out = risk_models.out_of_fold_risk(df, "row", "t", "e", sigs, "fold", zoo, 4)
    c = {r["model"]: r["c_index"] for r in survival.concordance(out, "t", "e", "risk", ["model"]).collect()}
    assert out.count() == 240 * 5 and "none" not in c  # no column to fit: null risks
    assert c["two"] > 0.7 and c["two"] > c["noise"] + 0.1 and 0.3 < c["factors"] < 1
    assert risk_models.out_of_fold_risk(df.limit(0), "row", "t", "e", sigs, "fold", zoo, 4).count() == 0


def test_residuals_and_partial_correlation(spark):
    rng = np.random.default_rng(4)
    age = rng.normal(size=200)
    pdf = pd.DataFrame({"age": age, "risk": age + rng.normal(0, 0.3, 200), "t": -2 * age + rng.normal(0, 0.3, 200), "e": 1})
    pdf.loc[0, "age"] = None
    df = spark.createDataFrame(pdf)
    got = confounding.ols_residuals(df, {"t": "res"}, ["age"]).toPandas()
    ok = pdf.age.notna()
    b = np.polyfit(pdf.age[ok], pdf.t[ok], 1)
    assert np.allclose(got.res[ok], pdf.t[ok] - np.polyval(b, pdf.age[ok])) and np.isnan(got.res[0])
    r = confounding.partial_spearman(df, "risk", "t", "e", ["age"]).first()
    assert r["rho"] < -0.8 and abs(r["partial_rho"]) < 0.25 and r["proxy_warning"] and r["n"] == 199


def test_suite_and_exit_codes(spark):
    ids = [f"S{i:03d}" for i in range(40)]
    expr = spark.createDataFrame([(g, s, 5.0 + i % 3) for g in ("GA", "GB") for i, s in enumerate(ids)], "gene string, sample_id string, value double")
    clin = spark.createDataFrame([(s, 50 + i, "II") for i, s in enumerate(ids)], "sample_id string, age int, stage string")
    ends = spark.createDataFrame([(s, i % 2, 1.0 + i, i % 3 == 0) for i, s in enumerate(ids)], "sample_id string, pcr int, time_os double, e boolean").select("sample_id", "pcr", "time_os", F.col("e").cast("int").alias("event_os"))
    rows = suites.run_suite(spark, {"a": suites.Bundle(expr, clin, ends)}, {}, {"tertiles": {"logrank_p": 0.2, "n_low": 40, "n_medium": 40, "n_high": 40}, "ph_violated": ["age"], "pac": 0.2, "c_index": None})
    got = {r["name"]: r["status"] for r in rows.collect()}
    assert got["a::expr_no_nan"] == "PASS" and got["a::clinical_columns"] == "WARN" and got["a::pcr_balance"] == "PASS" and got["tertile_separation"] == "WARN" and got["proportional_hazards"] == "WARN" and got["consensus_pac"] == "PASS" and got["c_index"] == "SKIP"
    few = {r["name"]: r["status"] for r in suites.cohort_suite(suites.Bundle(expr, clin, ends.limit(5))).collect()}
    assert few["pcr_balance"] == "SKIP" and few["expr_endpoints"] == "FAIL"
    report = quality.Report().add(rows)
    assert suites.exit_code(report) == 0 and suites.exit_code(report, strict=True) == 1
    assert [r["status"] for r in suites.run_suite(spark, {}, {}, {}).collect()] == ["SKIP"]


def test_all_pairs_of_columns_are_checked(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIR_BLOCK", 4)
    df = spark.range(20).select(F.col("id").alias("k"), *[F.rand(i).alias(f"c{i}") for i in range(5)]).withColumn("c9", F.col("c4") * 2)
    got = {r["name"]: r for r in quality.feature_frame(df, "k").collect()}
    assert got["near_duplicate_columns"]["status"] == "WARN" and got["near_duplicate_columns"]["message"] == "c4~c9"


def test_receptor_matching_and_scalers(spark):
    df = spark.createDataFrame([("ctl", 0, 1), ("ctl", 1, 1), ("pos", 1, 0), ("mix", 1, 1), ("mix", 0, 0), ("neg", 0, 1), ("neg", None, 1)], "arm string, her2 int, y int")
    got = {(r["arm"], r["matching"]) for r in frames.receptor_matched(df, "arm", "her2", F.col("arm") == "ctl").collect()}
    assert got == {("ctl", "control"), ("mix", "mixed"), ("neg", "negative")}
    x = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 4.0), ("b", 4.0)], "f string, v double")
    fit = {r["f"]: (r["centre"], r["scale"]) for r in frames.fit_scaler(x, "f", "v", robust=True).collect()}
    assert fit == {"a": (2.0, pytest.approx(1.4826)), "b": (4.0, 1.0)}


def test_renames_without_aliases_come_from_values(spark):
    import json

    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        rows.append(("f", 1, "2020-01-01", i, json.dumps({"grp": "abc"[i % 3], "followup_months": float(rng.normal(50, 9)), "bmi": float(rng.normal(25, 3))})))
        rows.append(("f", 2, "2020-02-01", i, json.dumps({"category": "abc"[(i + 1) % 3], "months_followup": float(rng.normal(50, 9)), "tils": float(rng.normal(25, 3))})))
    df = spark.createDataFrame(rows, "feed string, file_id long, exported_on string, line_no int, payload string")
    got = {(r["field_name"], r["change"]) for r in drift.schema_changes(df, fields=()).collect()}
    assert got == {("category", "renamed"), ("months_followup", "renamed"), ("bmi", "removed"), ("tils", "added")}


def test_assignment_is_the_best_of_all_orders():
    from itertools import permutations

    from cohortloom.operators.factorise import best_assignment

    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        g = rng.normal(size=(n, n))
        got = best_assignment(g)
        assert sorted(got) == list(range(n)) and sum(g[i, got[i]] for i in range(n)) == pytest.approx(max(sum(g[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_sign_test_of_many_signs(spark):
    from math import comb

    from cohortloom.operators.classical import sign_test

    df = spark.range(3000).select(F.when(F.col("id") < 1560, -1.0).otherwise(1.0).alias("v"))
    want = sum(comb(3000, i) for i in range(1560, 3001)) / 2**3000
    assert sign_test(df, "v").first()["p_one_sided"] == pytest.approx(want, rel=1e-6)
