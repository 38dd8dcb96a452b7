import importlib
import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_pii import brute as brute_spans
from tidemark.llm import mixing, pieces, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    r = random.Random(8)
    vocab = ["w%d" % i for i in range(300)]
    bad = ["grumblef" + c + d for c in "abcdef" for d in "abcdef"]
    rows, labels = [], []
    for i in range(0, 700, 2):
        ws = [r.choice(vocab) for _ in range(r.choice((6, 40, 300)))]
        toxic = int(r.random() < 0.3)
        if toxic:
            ws[3:3] = [r.choice(bad) for _ in range(4)]
        elif r.random() < 0.2:
            ws[2:2] = [r.choice(("bob@mail7.example.com", "10.1.2.3", "4111 1111 1111 1111", "+1 (555) 555-1234"))]
        text = " ".join(ws)
        rows.append((i, text, "en", r.choice(("a", "b", None)), len(text)))
        labels.append((i, 0, toxic))
        if r.random() < 0.15:
            text = " ".join([*ws, "more"])
            rows.append((i + 1, text, "en", "c", len(text)))
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, labels = fixture()
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = [[tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        df = f(spark, docs, d)
        assert df.columns[:5] == COLUMNS if i == 4 else df.columns == COLUMNS
        df.write.parquet(f"{d}/{i}")
        docs = spark.read.parquet(f"{d}/{i}")
        out.append([tuple(r) for r in docs.collect()])
    return d, labels, out


def test_toxic_documents_go(stages):
    _, labels, out = stages
    kept = {r[0] for r in out[1]}
    wrong = sum((i in kept) == bool(t) for i, _, t in labels)
    assert wrong / len(labels) < 0.03
    assert set(out[1]) <= set(out[0])


def test_one_of_each_group_stays(stages):
    groups = brute_groups([(r[0], r[1]) for r in stages[2][1]], 5, 80)
    assert sorted(map(repr, stages[2][2])) == sorted(repr(r) for r in stages[2][1] if groups[r[0]][2])


def test_personal_data_is_masked(stages):
    before, after = ({r[0]: r for r in stages[2][i]} for i in (2, 3))
    assert before.keys() == after.keys()
    for i, r in before.items():
        text = r[1]
        for s, k, e in sorted(brute_spans(text), reverse=True):
            text = text[:s] + f"<{pii.KINDS[k].upper()}>" + text[e:]
        assert after[i] == (i, text, *r[2:4], len(text))


def test_mix_meets_targets(stages):
    before, after = stages[2][3], stages[2][4]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    for r in after:
        taken[r[3]] = taken.get(r[3], 0) + words(r[1])
    want = mixing.targets(list(sizes.items()))
    assert all(0 <= want[s] - taken.get(s, 0) <= 310 for s in sizes)
    assert set(after) <= set(before) and all(after.count(r) <= 2 for r in after[:40])


def test_pieces_round_trip(stages):
    model = pieces.Pieces(pieces.model_path())
    assert sorted(repr(r[:5]) for r in stages[2][5]) == sorted(map(repr, stages[2][4]))
    for r in stages[2][5]:
        assert bytes(r[5]) == model.encode(r[1]) and r[6] == len(r[5]) // 2 and r[7]
        assert model.decode(np.frombuffer(bytes(r[5]), "<u2")) == r[1]


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, stages[0])
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, stages[2][5]))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark):
    from tidemark.llm.minhash import deduplicated

    rows = [(1, "a b c d e f", 2), (1, "a b c d e f", 1), (2, "A b c d e f", 1), (None, "x", 1), (None, "x", 1)]
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, [(1, "a b c d e f", 1), (None, "x", 1), (None, "x", 1)]))


def test_entry_module_lists_them():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 11)}
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
