import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import learn as L
from tidemark.operators.rules import compile_rules
from tidemark.sources import sinks
from tidemark.sources import tables as S
from tidemark.streaming import live


def test_typed_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(' ID ,Amount,Note\n1,2.5,NA\n002,,"a, b"\nNULL,3,n/a\n')
    df = S.read_table(spark, str(p), lower_headers=True)
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "note": "string"}
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, [(1, 2.5, None), (2, None, "a, b"), (None, 3.0, None)]))


def test_text_csv_and_blanks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1,\n,NA\n")
    assert [tuple(r) for r in S.read_table(spark, str(p), all_text=True).collect()] == [("1", None), (None, "NA")]
    assert [tuple(r) for r in S.read_table(spark, str(p), all_text=True, blank_is_missing=False).collect()] == [("1", ""), ("", "NA")]


def test_encoding_fallback(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("n\ncafé\n".encode("latin-1"))
    assert S.read_table(spark, str(p)).first().n == "café"
    q = tmp_path / "u.csv"
    q.write_text("n\ncafé\n", encoding="utf-8")
    assert S.read_table(spark, str(q)).first().n == "café"


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = S.with_row_id(df, ["k"]).collect()
    assert sorted((r.row_id, r.k) for r in out) == [(i, i) for i in range(1000)]
    assert sorted(r.row_id for r in S.with_row_id(df).collect()) == list(range(1000))
    assert S.with_row_id(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("partitions", [3, 16])
def test_row_ids_of_many_rows_do_not_depend_on_the_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(50_000).select((F.col("id") * 48_271 % 50_000).alias("k")).repartition(5)
        out = S.with_row_id(df, ["k"])
        assert out.where("k <> row_id").count() == 0 and out.select("row_id").distinct().count() == 50_000
        twice = S.with_row_id(df.select((F.col("k") % 7).alias("k")), ["k"])
        assert [tuple(r) for r in twice.agg(F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).collect()] == [(50_000, 0, 49_999)]
        order = [r.k for r in twice.orderBy("row_id").collect()]
        assert order == sorted(order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_csv_is_split_unless_a_field_goes_on_over_a_line(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('n,t\n1,"one ""two"""\n2,three\n')
    plain = S.read_table(spark, str(p))
    assert [tuple(r) for r in plain.orderBy("n").collect()] == [(1, 'one "two"'), (2, "three")]
    assert "multiLine" not in plain._jdf.queryExecution().toString() or "multiLine=true" not in plain._jdf.queryExecution().toString()
    q = tmp_path / "b.csv"
    q.write_text('n,t\n1,"one\ntwo"\n2,three\n')
    assert [tuple(r) for r in S.read_table(spark, str(q)).orderBy("n").collect()] == [(1, "one\ntwo"), (2, "three")]


def test_small_files_go_through_the_session(spark, tmp_path):
    from tidemark.operators.profile import save_history

    save_history(str(tmp_path / "h.json"), {"a": "é"}, {"a": {"mode": "x"}}, spark)
    assert S.read_rules(str(tmp_path / "h.json"), spark) == S.read_rules(str(tmp_path / "h.json")) == ({"a": "é"}, {"a": {"mode": "x"}})


def test_rules_and_abbreviations(tmp_path, spark):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"patterns": {"a": "x"}, "metrics": {"a": {"mode": "m"}}}))
    patterns, metrics = S.read_rules(str(p))
    assert S.apply_rules({"a": "y", "b": "z"}, patterns) == {"a": "x", "b": "z"}
    assert S.apply_rules({"a": "y", "b": "z"}, patterns, "replace") == {"a": "x"} and metrics["a"]["mode"] == "m"
    q = tmp_path / "a.yaml"
    q.write_text("ltd: limited\nco: company\n")
    assert list(S.read_abbreviations(str(q)).items()) == [("ltd", "limited"), ("co", "company")]
    with pytest.raises(ValueError):
        S.read_datasets(spark, {"one": "x"})
    df = spark.range(1)
    assert S.default_reference(df) is df


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, None, [])], "row_id int, v string, c array<string>")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).where("c = 'x, y'").count() == 1
    pairs = spark.createDataFrame([(0, 1, 90.0, ["v"]), (0, 2, 65.0, [])], "record1 int, record2 int, score double, contributing_columns array<string>")
    sinks.write_pairs(pairs, spark.createDataFrame([(3, 100)], "record int, uniqueness int"), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p/similar")).count() == 1
    sinks.write_classes(spark.createDataFrame([(1, 2), (2, 0)], "r int, record_class int"), str(tmp_path / "k"))
    assert (tmp_path / "k/record_class=2").exists()
    sinks.save_report(str(tmp_path / "r.json"), df, {"accuracy": 1})
    assert json.loads((tmp_path / "r.json").read_text())["performance"] == {"accuracy": 1}
    a, b = sinks.error_and_correction_styles(df.drop("c"), df.drop("c").withColumn("v", F.lit("z")))
    assert a.first().colour == "FFCCCC" and {r.value for r in b.collect()} == {"z"}
    with pytest.raises((ImportError, ValueError)):
        sinks.write_workbook(df, a, str(tmp_path / "x.xlsx"), most_rows=1)
    h = spark.createDataFrame([(2, 0.1, 0.2), (1, 0.3, 0.4)], "iteration int, impurity double, fpr double")
    assert [r.iteration for r in sinks.history_chart(h).collect()] == [1, 2]


EVENTS = "ts string, id int, kind string"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", 1, "view"), ("2024-01-01 10:50:00", 2, "oops"), ("2024-01-01 11:10:00", 3, None), ("2024-01-01 11:20:00", 3, "view")]
    rules = compile_rules({"kind": "^(view|click)$"})
    for i in range(2):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], EVENTS).write.mode("append").json(str(tmp_path / "in"))
    read = lambda df: live.windowed_issues(live.mark_stream(df.withColumn("ts", F.col("ts").cast("timestamp")), rules), ["kind"])
    stream = read(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    batch = read(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(str, live.drained(stream).collect())) == sorted(map(str, batch.collect()))
    assert sum(r.missing for r in batch.collect()) == 1 and sum(r.invalid for r in batch.collect()) == 1


def test_late_duplicates_are_dropped(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", 1, "a"), ("2024-01-01 10:06:00", 1, "b"), ("2024-01-01 10:07:00", 2, "c")]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.json(str(tmp_path / "in"))
    stream = live.without_late_duplicates(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")), ["id"])
    assert sorted(r.id for r in live.drained(stream, "append").collect()) == [1, 2]


def test_drift_alerts(spark):
    seen = []
    history = spark.createDataFrame([(float(i), "a") for i in range(10)], "n double, t string")
    check = live.alert_on_drift(history, lambda df, i: seen.append((i, {r.column_name for r in df.collect()})))
    check(history, 0)
    check(history.withColumn("n", F.col("n") + 100), 1)
    assert seen == [(0, set()), (1, {"n"})]
    rules = live.learn_rules(history.select("t"))
    assert set(rules) == {"t"}


def test_density_clusters_equal_brute_force(spark):
    import random

    r = random.Random(1)
    pts = [(i, [r.gauss(c, 0.15), r.gauss(c, 0.15), r.gauss(0, 0.1), r.random()]) for i, c in enumerate([0, 3] * 20)] + [(90 + i, [50.0 * i, 9.0, 9.0, 9.0]) for i in range(3)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    near = {i: {j for j, q in pts if dist(p, q) <= 0.8} for i, p in pts}
    core = {i for i in near if len(near[i]) >= 5}
    label = {}
    for i in sorted(core):
        todo = [i]
        while todo:
            j = todo.pop()
            if label.get(j, i + 1) > i:
                label[j] = i
                todo += [k for k in near[j] & core if label.get(k, i + 1) > i]
    for i in near:
        if i not in core:
            label[i] = min((label[j] for j in near[i] & core), default=-1)
    names = {v: n for n, v in enumerate(sorted({v for v in label.values() if v >= 0}))}
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in pts], ["row_id", "features"])
    got = {x.row_id: x.density_cluster for x in L.cluster_density(df, 0.8, 5).collect()}
    assert got == {i: names.get(v, -1) for i, v in label.items()}


def test_split_and_oversampling(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, 0, Vectors.dense([float(i), 0.0])) for i in range(60)] + [(100 + i, 1, Vectors.dense([float(i), 5.0])) for i in range(8)]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"])
    train, test = L.stratified_split(df, "label")
    assert train.count() + test.count() == 68 and train.where("label = 1").count() in (5, 6)
    level = L.oversample(df, "label")
    assert {r.label: r["count"] for r in level.groupBy("label").count().collect()} == {0: 60, 1: 60}
    assert all(0 <= r.features[0] <= 7 and r.features[1] == 5 for r in level.where("label = 1").collect())
    assert L.oversample(df.where("label = 0"), "label").count() == 60


def test_classifiers_tell_classes_apart(spark):
    rows = [(i, i % 2, float(i % 2), float(i % 2), 0.5 * (i % 2), 0.5 * (i % 2), float(i % 7)) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id int, record_class int, cluster double, density_cluster double, mean_cosine double, mean_cosine_2 double, centroid_distance double")
    scores = L.meta_classify(df, trees=2, models=("logistic", "forest", "gradient", "ada", "extreme"))
    assert all(s["accuracy"] == 1 for s in scores.values())
    assert "reason" in L.meta_classify(df.where("record_class = 0"))


def test_meta_scores_asks_for_the_whole_job(spark, monkeypatch):
    import inspect

    from tidemark.plans.registry import QUERIES

    asked = {}
    signature = inspect.signature(L.meta_classify)

    def seen(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        asked.update(call.arguments)
        return {}

    monkeypatch.setattr(L, "meta_classify", seen)
    QUERIES["meta_scores"](spark, "/root/testdata/sf0.001")
    assert asked["trees"] == 100 and set(asked["models"]) == {"logistic", "forest", "gradient", "ada", "extreme"}
