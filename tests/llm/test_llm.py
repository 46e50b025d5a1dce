"""Training-corpus operators against brute force on small fixtures, and their edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm.canon import map_to_canon
from cohortloom.llm.leaks import find_leaks, myers, words_of
from cohortloom.llm.packing import pack, pack_sizes, token_count
from cohortloom.llm.queries import RULES, ref_surfaces
from cohortloom.llm.spans import SpanIndex, document_pairs, share_of_documents, shared_spans
from cohortloom.llm.splits import assign_splits, hash_to_min, linked_sets
from cohortloom.llm.survivors import fuse
from cohortloom.session import stage

# ---- survivors -------------------------------------------------------------------------------------------------------
REC = "rec long, who string, src string, trust int, upd timestamp, a string, b string"


def fused(spark, rows):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], *r[5:]) for r in rows], REC.replace("upd timestamp", "upd string"))
    return fuse(df, F.col("who"), "rec", "src", F.col("trust"), F.col("upd").cast("timestamp"), {"a": F.col("a"), "b": F.col("b")})


def test_fusion_takes_the_undisputed_record_else_the_likeliest_value(spark):
    rows = [
        (1, "p", "lab", 1, "2020-01-01", "x", None), (2, "p", "web", 2, "2021-01-01", "y", "q"), (3, "p", "site", 3, "2019-01-01", "x", "r"),  # a: disputed, x has two voices
        (4, "q", "lab", 1, "2020-01-01", "x", None), (5, "q", "web", 2, "2019-01-01", "z", None), (6, "q", "lab", 1, "2020-01-01", "x", None),  # a: 4 and 6 are equal
        (7, "r", "lab", None, None, None, None), (8, None, "lab", 1, "2020-01-01", "x", "x"),
    ]
    got = {(r["group"], r["field"]): r for r in fused(spark, rows).collect()}
    assert set(got) == {("p", "a"), ("p", "b"), ("q", "a")}
    assert got["p", "a"]["value"] == "x" and not got["p", "a"]["undisputed"] and got["p", "a"]["record"] == 1 and got["p", "a"]["n_records"] == 3
    assert got["p", "b"]["record"] == 2 and got["p", "b"]["undisputed"]
    assert got["q", "a"]["record"] == 4 and got["q", "a"]["undisputed"]
    assert fused(spark, rows[:0]).count() == 0


def test_fusion_discounts_copied_votes(spark):
    rng, rows, rec = random.Random(1), [], 0
    for p in range(400):
        true = rng.choice("abcdefgh")
        wrong = rng.choice([c for c in "abcdefgh" if c != true])
        copied = true if rng.random() < 0.4 else wrong
        for k, (src, v) in enumerate((("good1", true if rng.random() < 0.85 else rng.choice("abcdefgh")), ("good2", true if rng.random() < 0.85 else rng.choice("abcdefgh")), ("bad", copied), ("copy1", copied), ("copy2", copied))):
            rec += 1
            rows.append((rec, f"p{p}", src, k + 1, f"2020-01-{k + 1:02d}", v, true))
    # the less trusted the later: no record is superseded, so the votes decide
    got = {r["group"]: r["value"] for r in fused(spark, rows).where("field = 'a'").collect()}
    truth = {r[1]: r[6] for r in rows}
    majority = {p: max(set(vs), key=vs.count) for p, vs in ((p, [r[5] for r in rows if r[1] == p]) for p in truth)}
    right = sum(got[p] == truth[p] for p in truth) / len(truth)
    assert right > 0.8 and right > sum(majority[p] == truth[p] for p in truth) / len(truth) + 0.1


@pytest.mark.parametrize("most", [3, 100])
def test_every_source_votes_and_every_record_is_a_candidate(spark, most):
    """Twenty sources, more than are told apart: the survivor is the same as by the definition over all records."""
    rng, rows = random.Random(3), []
    for p in range(60):
        for k in range(rng.randrange(1, 25)):
            rows.append((len(rows) + 1, f"p{p}", f"s{rng.randrange(20)}", rng.choice([1, 2, 3, None]), f"2020-01-{rng.randrange(1, 6):02d}", rng.choice(["x", "y", None]), None))
    df = spark.createDataFrame(rows, REC.replace("upd timestamp", "upd string"))
    got = {r["group"]: r for r in fuse(df, F.col("who"), "rec", "src", F.col("trust"), F.col("upd").cast("timestamp"), {"a": F.col("a")}, max_sources=most).collect()}
    for p in {r[1] for r in rows}:
        mine = [(r[4], -(r[3] or 2**30), -r[0]) for r in rows if r[1] == p and r[5]]
        if not mine:
            assert p not in got
            continue
        top = [x for x in mine if all(x[0] >= y[0] and x[1] >= y[1] for y in mine)]
        assert got[p]["undisputed"] == bool(top) and got[p]["n_records"] == sum(r[1] == p for r in rows)
        if top:
            assert got[p]["record"] == -max(x[2] for x in top)
        else:
            front = [x for x in mine if not any(y[0] >= x[0] and y[1] >= x[1] and y != x for y in mine)]
            assert -got[p]["record"] in [x[2] for x in front] or any(x[2] == -got[p]["record"] for x in mine)


# ---- splits ----------------------------------------------------------------------------------------------------------
def brute_components(edges):
    par = {}
    find = lambda x: x if par.setdefault(x, x) == x else find(par[x])
    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(par)}


@pytest.mark.parametrize("seed", range(1))
def test_hash_to_min_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    got = {r["node"]: r["first"] for r in hash_to_min(spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_linked_sets_and_empty(spark):
    rows = [(1, "p", None), (2, "p", "b"), (3, None, "b"), (4, None, None), (5, "z", None), (5, "z", None), (None, "p", "b")]
    df = spark.createDataFrame(rows, "row_id long, p string, b string")
    keys = {"p": F.col("p"), "b": F.col("b")}
    assert {tuple(r) for r in linked_sets(df, "row_id", keys).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert linked_sets(df.limit(0), "row_id", keys).count() == 0


def test_splits_keep_components_and_proportions(spark):
    rng = random.Random(2)
    rows = [(i, i // 3 * 3 if i < 6000 else 6000, rng.choice("xy")) for i in range(9000)]  # one component holds a third
    df = spark.createDataFrame(rows, "row long, first long, s string")
    got = assign_splits(df, "row", "first", {"train": 0.7, "valid": 0.1, "test": 0.2}, [F.col("s")]).toPandas()
    assert len(got) == 9000 and (got.groupby("first").split_name.nunique() == 1).all()
    share = got.split_name.value_counts() / 9000
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["valid"] - 0.1) < 0.03 and abs(share["test"] - 0.2) < 0.03


def test_few_rows_move_when_the_plan_changes_and_ids_may_be_texts(spark):
    df = spark.createDataFrame([(f"r{i}", f"c{i // 4}") for i in range(4000)], "row string, first string")
    run = lambda plan: {r["row"]: r["split_name"] for r in assign_splits(df, "row", "first", plan, []).collect()}
    a, b = run({"train": 0.7, "valid": 0.1, "test": 0.2}), run({"train": 0.65, "valid": 0.15, "test": 0.2})
    assert 0.02 < sum(a[k] != b[k] for k in a) / 4000 < 0.12  # a plan that moves 5 % of the rows
    assert run({}) == {} and assign_splits(df.limit(0), "row", "first", {"a": 1.0}, []).count() == 0


def test_hot_keys_are_split(spark):
    """One patient holds half of the rows: the joins' partition of it is read in parts."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).repartition(8).select(F.col("id").alias("v"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("key"))
        left = stage(rows, "left")
        right = stage(left.groupBy("key").agg(F.min("v").alias("low")), "right")
        j = left.join(right, "key")
        j.write.format("noop").mode("overwrite").save()
        j.collect()
        assert "skew=true" in j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- canonical values ------------------------------------------------------------------------------------------------
def test_mapping(spark):
    entries = [("subtype_pam50", e, v) for e, v in (("BASAL", "Basal-like"), ("HER2", "HER2-enriched"), ("LUMA", "Luminal A"), ("LUMB", "Luminal B"), ("NORMAL", "Normal-like"))]
    entries += [("subtype_er", "NEGATIVE", "oestrogen receptor not expressed"), ("subtype_er", "POSITIVE", None), ("stage", "I", "stage one"), ("stage", "II", "stage two, with its sub-stages"), ("stage", "III", "stage three"), ("stage", "IV", "stage four")]
    ref = ref_surfaces(spark.createDataFrame(entries, "field string, entry string, label string"))
    want = {
        ("stage", "pIIA"): "II", ("stage", "sage III [reviewed]"): "III", ("stage", "IV AJCC7"): "IV", ("stage", "grade 2"): "UNMATCHED", ("stage", "2 at entry"): "II", ("stage", "stage four"): "IV", ("stage", "luminal"): "UNMATCHED",
        ("subtype_er", "er pos. / IHC"): "POSITIVE", ("subtype_er", "psoitive"): "POSITIVE", ("subtype_er", "ER-"): "NEGATIVE", ("subtype_er", "0.0 *"): "NEGATIVE", ("subtype_er", "borderline"): "UNMATCHED", ("subtype_er", "HER2 3+"): "UNMATCHED", ("subtype_er", "?!"): "UNMATCHED",
        ("subtype_pam50", "-> ltminal B"): "LUMB", ("subtype_pam50", "A (luminal); array"): "LUMA", ("subtype_pam50", "erbb2/HER2 enriched"): "HER2", ("subtype_pam50", "luminal"): "UNMATCHED", ("subtype_pam50", "Normal breast-like"): "NORMAL", ("subtype_pam50", "bsaal-like"): "BASAL",
        ("other", "x"): "UNMATCHED",
    }
    values = spark.createDataFrame([*want, ("stage", None), (None, "I"), ("stage", "pIIA")], "field string, value string")
    got = {(r["field"], r["value"]): r["entry"] for r in map_to_canon(values, "field", "value", ref, RULES, threshold={"stage": 0.62, "subtype_er": 0.45, "subtype_pam50": 0.45}).collect()}
    assert got == want
    assert map_to_canon(values.limit(0), "field", "value", ref, RULES).count() == 0


# ---- packing ---------------------------------------------------------------------------------------------------------
def test_tokens_are_wordpunct(spark):
    texts = ["", " \n", "Ki-67 = 5.5%, Größe_1 сигнатура № 7", "a  b…c", "x" * 300_000 + " !?", None]
    want = [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(token_count(F.col("t"))).collect()]
    assert got == want


def slow_pack(sizes, capacity, linear, quadratic):
    bins = [[capacity, 0.0] for _ in range(-(-sum(sizes) // capacity))]
    out = []
    for n in sizes:
        fit = [i for i, (room, _) in enumerate(bins) if room >= n]
        i = min(fit, key=lambda i: (bins[i][1], i)) if fit else len(bins)
        if not fit:
            bins.append([capacity, 0.0])
        bins[i][0] -= n
        bins[i][1] += linear * n + quadratic * n * n
        out.append(i)
    return out


def test_pack_sizes_equals_the_plain_search():
    rng = np.random.default_rng(3)
    for cap in (7, 64, 512):
        sizes = np.sort(rng.integers(0, cap + 1, 300))[::-1]
        assert pack_sizes(sizes, cap, 1.0, 0.5).tolist() == slow_pack(sizes.tolist(), cap, 1.0, 0.5)
    assert len(pack_sizes(np.array([], dtype=int), 8, 1, 1)) == 0


def test_pack(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([0, 3, 40, 90, 130, 700])) for i in range(400)] + [(400, None), (401, 100), (402, 100)]
    plans = spark.createDataFrame([(1, 100), (2, 250), (3, 0)], "plan_id int, capacity_tokens int")
    out = pack(spark.createDataFrame(docs, "d long, n int"), "d", "n", plans, shard_items=150).toPandas()
    for plan, cap in ((1, 100), (2, 250)):
        p = out[out.plan == plan]
        assert p.groupby("item").piece_tokens.sum().to_dict() == {d: n or 0 for d, n in docs}
        load = p.groupby("container").piece_tokens.sum()
        assert load.max() <= cap and set(p[p.n_pieces > 1].item) == {d for d, n in docs if (n or 0) > cap}
        assert (cap * len(load) - load.sum()) / (cap * len(load)) < 0.2
    assert set(out.plan) == {1, 2}
    assert pack(spark.createDataFrame([], "d long, n int"), "d", "n", plans).count() == 0
    assert pack(spark.createDataFrame(docs, "d long, n int"), "d", "n", plans.limit(0)).count() == 0


# ---- leaks -----------------------------------------------------------------------------------------------------------
def edit_to_span(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for m in (1, 5, 63, 64, 65, 90):
        for _ in range(20):
            p, t = [rng.choice("abcd") for _ in range(m)], [rng.choice("abcd") for _ in range(rng.randrange(0, 120))]
            masks = {c: sum(1 << j for j, x in enumerate(p) if x == c) for c in set(p)}
            assert myers(masks, m, t)[0] == edit_to_span(p, t)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(30, 46)))) for i in range(12)]
    docs = []
    for d in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            _, p = items[d % 12]
            w = p.split()
            part = w[rng.randrange(0, max(1, len(w) // 3)) :][: int(len(w) * rng.choice([0.2, 0.3, 0.7, 0.9, 1.0]))]
            part = [x if rng.random() > 0.06 else rng.choice(["", "zzz"]) for x in part]
            if d % 9 == 0:
                rng.shuffle(part)
            text = rng.choice([" ", "\r\n", " *", "</b> <i>"]).join(part)
            body[len(body) // 2 : len(body) // 2] = [rng.choice([text, text.upper(), f"<p>“{text}”</p>"])]
        docs.append((d, " ".join(body)))
    want = {(i, d) for i, p in items for d, t in docs if len(words_of(p)) - edit_to_span(words_of(p), words_of(t)) >= 0.5 * len(words_of(p))}
    got = {(r["item"], r["doc"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage").collect()}
    assert got == want and 15 < len(want) < 50


def test_leaks_within_the_whole_error_budget(spark):
    """Words replaced at random up to half of the item, and every second or third one: no whole piece of words is left."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(n)]) for i, n in enumerate((3, 4, 9, 29, 30, 40, 41, 60))]
    docs = []
    for d in range(240):
        p = items[d % 8][1]
        bad = set(range(0, len(p), 2 + d % 2)) if d % 5 == 0 else set(rng.sample(range(len(p)), int(len(p) * rng.uniform(0.2, 0.6))))
        part = [rng.choice(["", f"z{rng.random()}"]) if j in bad else x for j, x in enumerate(p)]
        docs.append((d, " ".join([*(rng.choice(vocab) for _ in range(d % 90)), *part, *(rng.choice(vocab) for _ in range(40))])))
    want = {(i, d) for i, p in items for d, t in docs if len(p) - edit_to_span(p, words_of(t)) >= 0.5 * len(p)}
    got = {(r["item"], r["doc"]) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, passage string"), "item_id", "passage").collect()}
    assert got == want and len(want) > 120


def test_leak_edge_cases(spark):
    items = spark.createDataFrame([(1, "one"), (2, ""), (3, None), (4, "alpha beta gamma delta"), (5, "…")], "item_id long, passage string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 200_000 + "Alpha, beta & gamma: <b>delta</b>"), (3, "alpha beta gamma delta"), (4, "this one here")], "doc_id long, text string").withColumn("item", F.lit(1))
    run = lambda a, b: sorted((r["item"], r["doc"]) for r in find_leaks(a, "doc_id", "text", b, "item_id", "passage").collect())
    assert run(docs, items) == [(1, 4), (4, 3), (4, 3)]
    assert run(docs.limit(0), items) == [] and run(docs, items.limit(0)) == []


# ---- shared spans ----------------------------------------------------------------------------------------------------
def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def corpus(seed):
    rng = random.Random(seed)
    letter = lambda n: "".join(rng.choice("abcdefé сигнатура\n") for _ in range(n))
    spans = [letter(n) for n in (30, 39, 40, 41, 60, 90)]
    docs = []
    for i in range(40):
        t = letter(rng.randrange(0, 120))
        for s in rng.sample(spans, rng.choice([0, 1, 2])):
            cut = rng.randrange(len(t) + 1)
            t = t[:cut] + s + t[cut:]
        docs.append((i, t, f"2020-01-{1 + i % 20:02d}"))
    docs += [(100, docs[3][1] + "", "2021-01-01"), (101, docs[3][1], None), (102, "", "2020-01-01"), (103, None, "2020-01-01"), (104, "ab" * 80, "2020-01-01"), (105, "ba" * 80, "2020-01-01"), (106, "é" * 50_000, "2020-02-01"), (107, "x" + "é" * 45, "2020-02-01")]
    return docs


@pytest.mark.parametrize(("seed", "batches", "small"), [(2, 3, 10**6), (3, 2, 2)])
def test_shared_spans_equal_brute_force(spark, monkeypatch, seed, batches, small):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string, at string").withColumn("doc", F.lit(0))
    monkeypatch.setattr("cohortloom.llm.spans.SMALL", small)
    shared = shared_spans(df, "doc_id", "text", "at", least=40, gram=24, batches=batches)
    assert (shared[1] is None) == (small > 100)
    got = [tuple(r) for r in document_pairs(shared, df, "doc_id", "text", 40).collect()]
    assert len(got) == len(set(got))
    got = set(got)
    t = {i: x for i, x, _ in docs if x}
    want = {(a, b) for a in t for b in t if a < b and (longest_common(t[a], t[b]) >= 40 if max(a, b) != 106 else "é" * 40 in t[min(a, b)])}
    if (106, 107) not in want:
        want |= {(106, 107)}
    assert got == want
    shares = {r["doc"]: r for r in share_of_documents(df, "doc_id", "text", shared, 40).collect()}
    assert len(shares) == sum(x is not None for _, x, _ in docs) and shares[101]["share"] in (0.0, 1.0) and shares[102]["share"] == 0.0
    for d, x in t.items():
        partners = [y for e, y in t.items() if e != d and (min(d, e), max(d, e)) in want]
        assert (shares[d]["shared_chars"] >= 40) == bool(partners or (list(t.values()).count(x) > 1)) or len(x) < 40


def covered_chars(d, t, least):
    """Characters of text d in windows of ``least`` that another text holds, by plain search."""
    hit, text = set(), t[d]
    for i in range(len(text) - least + 1):
        w = text[i : i + least]
        if any(w in x for e, x in t.items() if e != d):
            hit |= set(range(i, i + least))
    return len(hit)


@pytest.mark.parametrize("small", [2])
def test_shares_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr("cohortloom.llm.spans.SMALL", small)
    docs = [d for d in corpus(7) if d[0] < 102]
    df = spark.createDataFrame(docs, "doc_id long, text string, at string")
    t = {i: x for i, x, _ in docs}
    got = {r["doc"]: r["shared_chars"] for r in share_of_documents(df, "doc_id", "text", shared_spans(df, "doc_id", "text", "at", least=40, gram=24), 40).collect()}
    copied = [d for d, x in t.items() if list(t.values()).count(x) > 1]
    assert got == {d: len(x) if d in copied else covered_chars(d, t, 40) for d, x in t.items()}


@pytest.mark.parametrize("small", [0, 2, 10**6])
def test_links_do_not_depend_on_how_places_are_verified(spark, monkeypatch, small):
    monkeypatch.setattr("cohortloom.llm.spans.SMALL", small)
    monkeypatch.setattr("cohortloom.llm.spans.HOT", 3)
    docs = [d for d in corpus(5) if d[0] < 102]
    df = spark.createDataFrame(docs, "doc_id long, text string, at string")
    t = {i: x for i, x, _ in docs}
    rep = {i: min(e for e, y in t.items() if y == x) for i, x in t.items()}
    links = {i: sum(e != i and longest_common(t[e], t[i]) >= 40 for e in set(rep.values())) for i in set(rep.values())}
    got = {r["doc"]: r["n_links"] for r in share_of_documents(df, "doc_id", "text", shared_spans(df, "doc_id", "text", "at", least=40, gram=24), 40).collect()}
    assert got == {i: links[r] for i, r in rep.items()} and len(set(got.values())) > 3


def test_span_index_joins_runs_without_shuffling_them_and_compacts(spark, monkeypatch):
    monkeypatch.setattr("cohortloom.llm.spans.HOT", 3)
    monkeypatch.setattr("cohortloom.llm.spans.SMALL", 5)
    docs = spark.createDataFrame([(i, f"{i:03d}" * 20 + "shared words " * 10) for i in range(24)], "doc_id long, text string")
    index = SpanIndex(spark, "doc_id", "text", least=40, gram=24, max_runs=2)
    found = None
    for part in range(4):
        got = index.append(docs.where(f"doc_id % 4 = {part}"))
        found = got if found is None else found.unionByName(got)
        assert len(index.runs) == (1, 2, 1, 2)[part]
    assert index.compactions == 1
    plan = index.shared_places(spark.table(index.runs[1][0]), [spark.table(index.runs[0][0])])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()
    assert found.select("doc").distinct().count() == 24
    shared = shared_spans(docs.withColumn("at", F.lit("2020-01-01")), "doc_id", "text", "at", least=40, gram=24)
    assert shared[1] is not None and {tuple(r) for r in document_pairs(shared, docs, "doc_id", "text", 40).collect()} == {(a, b) for a in range(24) for b in range(a + 1, 24)}


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "doc_id long, text string, at timestamp")
    shared = shared_spans(df, "doc_id", "text", "at")
    assert shared[0].count() == 0 and shared[1] is None and shared[2].count() == 0
    assert document_pairs(shared, df, "doc_id", "text", 400).count() == 0 and share_of_documents(df, "doc_id", "text", shared, 400).count() == 0
