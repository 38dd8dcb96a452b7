import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text as T
from tidemark.operators import dedup as D
from tidemark.operators import resolve as E
from tidemark.operators import repair as R
from tidemark.operators import score as S
from tidemark.operators import synth as G
from tidemark.operators import validate as V


def test_imputation(spark):
    df = spark.createDataFrame([(1, None, None), (2, 4.0, "b"), (3, 8.0, "a"), (4, 8.0, "a")], "row_id int, n double, t string")
    for strategy, want in (("mean", 20 / 3), ("median", 8.0), ("mode", 8.0)):
        r = R.impute(df, strategy=strategy).orderBy("row_id").first()
        assert r.n == pytest.approx(want) and r.t == "a"
    assert R.impute(df, df.limit(0)).orderBy("row_id").first().t == "missing"
    with pytest.raises(ValueError):
        R.impute(df, strategy="guess")


def test_typos(spark):
    ref = spark.createDataFrame([("apple",), ("pear",), (None,)], "v string")
    df = spark.createDataFrame([("aple",), ("pear",), (None,), ("zzz",)], "v string")
    assert [r.v for r in R.fix_typos(df, ref, "v", min_score=50).collect()].count("apple") == 1
    assert sorted(map(str, (r.v for r in R.fix_typos(df, ref, "v", min_score=50).collect()))) == ["None", "apple", "pear", "zzz"]
    assert sorted(map(str, (r.v for r in R.fix_typos(df, ref.limit(0), "v").collect()))) == ["None", "aple", "pear", "zzz"]
    assert sorted(map(str, (r.v for r in R.fix_typos(df, ref, "v", "weighted", 60).collect()))) == ["None", "apple", "pear", "zzz"]


def test_vocabulary_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "VOCABULARY_BLOCK", 3)
    vocab = spark.createDataFrame([(f"word{i:02d}",) for i in range(20)], "choice string")
    values = spark.createDataFrame([("wrd07",), ("word1",)], "value string")
    got = {r.value: r.choice for r in R.best_choices(values, vocab).collect()}
    assert got == {"wrd07": "word07", "word1": "word01"}


def test_cap_and_repair_are_idempotent(spark):
    ref = spark.createDataFrame([(1, 0.0, "a"), (2, 10.0, "b")], "row_id int, n double, t string")
    df = spark.createDataFrame([(1, -5.0, "aa"), (2, 99.0, None), (3, None, "b")], "row_id int, n double, t string")
    once = R.repair(df, ref)
    assert sorted(map(tuple, R.repair(once, ref).collect())) == sorted(map(tuple, once.collect()))
    assert all(0 <= r.n <= 10 and r.t in "ab" for r in once.collect())
    assert R.cap_range(ref, "t").collect() == ref.collect()


def test_scores(spark):
    err = spark.createDataFrame([(1, "x"), (2, "b"), (3, None)], "row_id int, v string")
    fixed = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "row_id int, v string")
    ref = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "row_id int, v string")
    rows = {r.label: r for r in S.score_repair(err, fixed, ref).collect()}
    assert rows["true"].f1 == 1 and rows["accuracy"].f1 == 1 and rows["macro avg"].support == 3
    flags = {r.row_id: (r.is_error, r.is_changed) for r in S.repair_flags(err, fixed, ref, null_safe=False).collect()}
    assert flags[3] == (True, True)
    assert [tuple(r) for r in S.change_table(err, fixed).collect()] == [(1, "v", "x", "a")]
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    got = S.classifier_scores(pairs, "t", "p")
    assert got["accuracy"] == 0.5 and got["recall"] == 0.5 and got["precision"] == round((2 * 1 + 1 / 3) / 4, 4)


def test_text_functions(spark):
    df = spark.createDataFrame([(" \tHéllo, World! 1-2\n", "Acme CO. Ltd", "-$1,200.50", "ABC", "abc1", "12")], "a string, b string, c string, d string, e string, f string")
    r = df.select(
        T.normalize_text(F.col("a")), T.expand_abbreviations(F.col("b"), {"ltd": "limited", "co": "company $1"}), T.strip_currency(F.col("c")), T.remove_punctuation(F.col("a")),
        T.is_lower(F.col("d")), T.is_lower(F.col("e")), T.is_lower(F.col("f")), T.has_punctuation(F.col("b")), T.clean_text(F.col("a")),
    ).first()
    assert r[0] == "hllo world 12" and r[1] == "Acme company $1. limited" and r[2] == "1200.50" and r[3] == " \tHéllo World 12\n"
    assert r[4:8] == (False, True, False, True) and r[8] == "hello world 12"


def test_similarity_by_hand(spark):
    assert T.lcs_length("kitten", "sitting") == 4 and T.lcs_length("", "a") == 0
    assert T.edit_ratio("kitten", "sitting") == round(200 * 4 / 13)
    assert T.token_set_ratio("new york mets", "mets new YORK!") == 100 and T.token_set_ratio("a b", "a b c d") == 100
    assert T.token_set_ratio("", "x") == 0 and T.token_set_ratio(None, None) == 0
    assert T.phonetic_similarity("Smith", "Smyth") == 100 and T.phonetic_similarity("123", "123") == 0
    assert T.weighted_ratio("same text", "same text") == 100
    for a, b in (("house", "horse"), ("the cat", "cat the"), ("x", "abcdefghij x")):
        assert T.token_set_ratio(a, b) == T.token_set_ratio(b, a) and 0 <= T.weighted_ratio(a, b) <= 100
    df = spark.createDataFrame([("a b", "b a"), (None, "x")], "x string, y string")
    assert [r[0] for r in df.select(T.similarity(F.col("x"), F.col("y"))).collect()] == [100.0, 0.0]


def test_phonetic_codes():
    want = {"Smith": "SM0", "Knight": "NT", "Philip": "FLP", "Thomas": "TMS", "Wright": "RT", "Catherine": "K0RN", "Peter": "PTR", "Xavier": "SF", "Thompson": "TMPSN"}
    assert {k: T.phonetic_code(k) for k in want} == want


def test_window_pairs_and_classes(spark):
    df = spark.createDataFrame([(i, f"name {i // 2}", float(i // 2)) for i in range(20)], "row_id int, t string, n double")
    pairs = D.candidate_pairs(df)
    assert pairs.count() == 85
    scored = D.score_pairs(pairs, ["t"], ["n"], "overlap")
    classes = {r.row_id: r.record_class for r in D.classify(df, scored).collect()}
    assert set(classes.values()) == {2}
    assert D.unique_records(df, scored.where("record1 < 2")).count() == 18
    both = D.combine_pairs(scored.where("score = 100"), scored.where("score = 100")).collect()
    assert all(abs(r.score - 100) < 1e-9 and r.sources == ["model", "rules"] for r in both) and len(both) == 10
    none = D.score_pairs(pairs, [], [], "overlap")
    assert none.agg(F.max("score")).first()[0] == 0
    mixed = spark.createDataFrame([(0, 1, 90.0, ["t"]), (1, 2, 70.0, ["t"])], "record1 int, record2 int, score double, contributing_columns array<string>")
    assert {r.row_id: r.record_class for r in D.classify(df.limit(3), mixed).collect()} == {0: 2, 1: 2, 2: 1}
    assert {r.row_id: r.record_class for r in D.classify(df.limit(3), mixed, compat_class=True).collect()} == {0: 2, 1: 1, 2: 1}


def test_plan_of_window_pairs_has_no_nested_loop(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], "row_id int, t string")
    plan = D.candidate_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_mean_cosine_equals_all_pairs(spark):
    df = spark.createDataFrame([(0, "red fox"), (1, "red dog runs"), (2, ""), (3, "fox fox dog")], "row_id int, t string")
    w = D.tfidf(df, F.col("t"))
    vectors = {i: {} for i in range(4)}
    for r in w.collect():
        vectors[r.row_id][r.term] = r.w
    assert all(abs(sum(x * x for x in v.values()) - 1) < 1e-9 for v in vectors.values() if v)
    for r in D.mean_cosine(df, w).collect():
        want = sum(sum(vectors[r.row_id].get(t, 0) * x for t, x in v.items()) for v in vectors.values()) / 4
        assert abs(r.mean_cosine - want) < 1e-9


def test_link_and_merge(spark):
    base = spark.createDataFrame([(0, "acme tools", 1.0), (1, "blue river", 5.0), (2, "zzz", 9.0)], "row_id long, name string, n double")
    inc = spark.createDataFrame([(10, "river blue", 5.0), (11, "acme tool works", 1.1), (12, "", 3.0)], "row_id long, name string, n double")
    m = E.link(base, inc)
    got = {r.row_1: r.row_2 for r in m.collect()}
    assert got == {0: 11, 1: 10}
    assert all(0 <= r.error_similarity <= 1 and 0 <= r.final_similarity <= 1 for r in m.collect())
    out = E.merge(m, base, inc, {"name": "prefer_dataset_2"}).collect()
    assert len(out) == 4 and {r.source_chain for r in out} == {"base + incoming", "base", "incoming"}
    assert {r.name for r in out if r.source_chain == "base + incoming"} == {"river blue", "acme tool works"}
    assert E.link(base, inc, max_matches=1).count() == 1
    assert sorted(map(tuple, E.link(base, inc, max_share=0.5).collect())) == sorted(map(tuple, m.collect()))
    assert E.link(base, inc, max_share=0.0).count() == 0
    assert E.resolve_all([("a", base), ("b", inc), ("c", inc.withColumn("row_id", F.col("row_id") + 100))]).count() >= 4
    with pytest.raises(ValueError):
        E.resolve_all([("a", base)])


def test_conflicts_and_names(spark):
    df = spark.createDataFrame([("", "x"), (None, "x"), ("a", "x"), (None, None)], "a string, b string")
    for strategy, want in (("prefer_non_null", ["x", "x", "a", None]), ("prefer_dataset_2", ["x", "x", "x", None]), ("other", ["", None, "a", None])):
        assert [r[0] for r in df.select(E.resolve_conflict(F.col("a"), F.col("b"), strategy)).collect()] == want
    assert E.close_names(spark.createDataFrame([], "custmer int, b int"), spark.createDataFrame([], "customer int, b int")) == {"custmer": "customer"}


def test_standardise_modes(spark):
    a = spark.createDataFrame([(0, "acme ltd", 1), (1, "blue", 2)], "row_id int, name string, n int")
    b = spark.createDataFrame([(0, "ACME, LTD", 1), (1, None, 2), (2, "green co", 3)], "row_id int, name string, n int")
    sets, full = [("a", a), ("b", b)], {"ltd": "limited"}
    names = lambda out: [r.name for r in dict(out)["b"].orderBy("row_id").collect()]
    assert names(E.standardize(sets, "majority", abbreviations=full)) == ["acme limited", None, "green co"]
    assert names(E.standardize(sets, "standard", standard="a")) == ["acme ltd", None, "green co"]
    assert names(E.standardize(sets, "rules", rules={"name": {"lower": True}})) == ["acme, ltd", None, "green co"]
    assert names(E.standardize(sets, "column", sources={"name": "a"})) == ["acme ltd", None, "green co"]
    with pytest.raises(ValueError):
        E.standardize(sets, "guess")


def test_columns(spark):
    df = spark.createDataFrame([(1, 1.0, "12/10/2022"), (2, 3.0, "2023-02-03"), (3, None, "x")], "row_id int, n double, d string")
    parts = [tuple(r)[3:] for r in C.with_date_parts(df, ["d"]).orderBy("row_id").collect()]
    assert parts == [(2022, 10, 12), (2023, 2, 3), (0, 0, 0)]
    z = [r.n_scaled for r in C.with_zscores(df, ["n"]).orderBy("row_id").collect()]
    assert z == [-1.0, 1.0, None]
    assert [r.n for r in C.with_minmax(df, ["n"]).orderBy("row_id").collect()] == [0.0, 1.0, None]
    assert C.with_zscores(df.withColumn("k", F.lit(5)), ["k"]).first().k_scaled == 0
    assert C.column_types(df) == (["row_id", "n"], ["d"]) and C.three_way_types(df)[0] == ["d"]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "n double")
    assert [r.n for r in C.fold_nan(nan).collect()] == [None, 1.0]
    assert len(C.feature_matrix(df, ["n"], ["d"]).first().features) >= 2
    assert C.preview_change(df, df, "row_id", ["n"], 2).count() == 2


def test_closeness_and_masks(spark):
    df = spark.createDataFrame([(100.0, 101.0), (100.0, 103.0), (None, 1.0), (0.0, 0.0), (-100.0, -99.0)], "a double, b double")
    assert [r[0] for r in df.select(V.close(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True]
    t = spark.createDataFrame([(1, "a"), (2, "q"), (3, None)], "row_id int, v string")
    ref = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    assert {r.row_id: r.is_typo_v for r in V.mask_typos(t, ref, "v").collect()} == {1: False, 2: True, 3: True}
    with pytest.raises(KeyError):
        V.valid_masks(t, {"absent": "x"})


def test_synthetic_rows(spark):
    out = G.synthesize(spark, {"n": {"mean": 10.0, "std": 2.0}, "m": {"mode": "x"}, "z": {}}, {"p": r"^\d{4}-\d{2}-\d{2}$", "q": "?", "n": r"^\d+$"}, 2000)
    rows = out.collect()
    mean = sum(r.n for r in rows) / len(rows)
    assert abs(mean - 10) < 0.3 and all(round(r.n, 2) == r.n for r in rows) and out.columns == ["n", "m", "z", "p", "q"]
    assert {r.m for r in rows} == {"x"} and {r.z for r in rows} == {None} and {r.q for r in rows} == {"SyntheticValue"}
    assert out.where(~F.col("p").rlike(r"^20\d\d-\d\d-\d\d$")).count() == 0
    for p, pattern in ((r"^\d+\.\d+$", r"^\d+\.\d\d$"), (r"^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$", r"^[A-Z]")):
        assert spark.range(50).select(G.value_for_pattern(p).alias("v")).where(~F.col("v").rlike(pattern)).count() == 0
    assert math.isclose(spark.range(1).select(G.clamp(F.lit(5.0), {"max": 3})).first()[0], 3)


def test_common_terms_lose_no_partner(spark):
    import random

    r = random.Random(5)
    text = lambda: " ".join(["the1"] * (r.random() < 0.9) + r.choices(["inc", "corp"], k=r.randrange(3)) + r.choices([f"t{i}" for i in range(40)], k=r.randrange(3)))
    base = spark.createDataFrame([(i, text(), float(i % 7)) for i in range(60)], "row_id long, name string, n double")
    inc = spark.createDataFrame([(100 + i, text(), float(i % 5)) for i in range(60)], "row_id long, name string, n double")
    shown = lambda df: sorted((x.row_1, x.row_2, round(x.text_similarity, 9), round(x.final_similarity, 9)) for x in df.collect())
    whole = shown(E.link(base, inc))  # 60 rows: all pairs
    assert len(whole) > 50
    for common in (0, 3, 20):
        assert shown(E.link(base, inc, common=common)) == whole


def test_all_suppliers_are_linked(spark):
    from tidemark.plans.registry import QUERIES

    data = "/root/testdata/sf0.01"
    want = spark.read.parquet(f"{data}/supplier.parquet").select("s_suppkey").collect()
    got = QUERIES["linked_numbers"](spark, data).collect()
    assert sorted((x.row_1, x.row_2) for x in got) == sorted((x[0], x[0] + 100000) for x in want)


def test_quantiles_and_modes_are_exact(spark):
    import numpy as np

    from tidemark.operators.profile import modes, quantiles

    r = np.random.default_rng(3)
    x, y = r.normal(size=9_000).round(3), r.integers(0, 3, 9_000).astype(float)
    rows = [(float(a), float(b), None if i % 5 else "b") for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(float("nan"), None, "a")] * 3_000
    df = spark.createDataFrame(rows, "x double, y double, t string")
    for gathered in (50_000, 2):  # few values are read: the brackets have to be narrowed
        found = quantiles(df, ["x", "y"], (0.0, 0.25, 0.5, 0.99, 1.0), gathered)
        for c, v in (("x", x), ("y", y)):
            assert np.allclose(found[c], np.quantile(v, [0.0, 0.25, 0.5, 0.99, 1.0]), rtol=0, atol=1e-12)
    assert quantiles(df.limit(0), ["x"]) == {"x": [None, None, None]}
    top = modes(df, ["y", "t"]).first()
    kinds, counts = np.unique(y, return_counts=True)
    assert (top.mode0, top.mode1) == (kinds[counts.argmax()], "a")
    assert tuple(modes(df.limit(0), ["y", "t"]).first()) == (None, None)
