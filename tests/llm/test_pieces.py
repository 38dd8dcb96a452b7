import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path())


def brute(model, s):
    """Best score over all segmentations, by dynamic programming over substrings."""
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        if s[e - 1] not in model.single:
            best[e] = best[e - 1] + model.unknown
        for b in range(max(0, e - 64), e):
            found = model.pieces.get(s[b:e])
            if found:
                best[e] = max(best[e], best[b] + found[2])
    return best[-1]


def value(model, ids):
    """Score of a segmentation; each run of byte pieces is whole characters."""
    scores, run, total = {i: v for i, _, v in model.pieces.values()}, b"", 0.0
    for i in [*ids, None]:
        if i is not None and i in model.byte:
            run += model.out[i]
            continue
        total += len(run.decode()) * model.unknown
        run = b""
        if i is not None:
            total += scores[i]
    return total


TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n\n\tb", "漢字テスト", "😀 👩‍👩‍👧", "\x00\x7f", "▁", "a▁b ▁ c▁▁", "word." * 50, "x" * 500, "é ß ñ Ü", "日本 の 梦"]


def texts():
    r = random.Random(4)
    marks = ["the", "ing", " ", "  ", "\n", "é", "漢", "😀", "1", "99", ".", "...", "▁", "qz", "A", "\t", "्", "梦"]
    return TEXTS + ["".join(r.choice(marks) for _ in range(r.randrange(25))) for _ in range(400)]


def test_best_sum_of_scores(model):
    for t in texts():
        if "▁" in t or not t:
            continue
        s = pieces.SPACE + t.replace(" ", pieces.SPACE)
        ids = np.frombuffer(model.encode(t), "<u2").tolist()
        assert ids == model.best(s), t  # cutting and caching change nothing
        assert value(model, ids) == brute(model, s), t


def test_words_together_equal_words_alone(model):
    r = random.Random(6)
    alphabet = sorted(model.single)
    words = sorted({pieces.SPACE + "".join(r.choice(alphabet[:200] if r.random() < 0.5 else alphabet) for _ in range(r.randrange(12))) for _ in range(3000)} | {p for p in model.pieces if p.startswith(pieces.SPACE)})
    got = model.together(words)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [model.best(w) for w in words]


def test_batches_and_small_caches_change_nothing(model, monkeypatch):
    want = [model.encode(t) for t in texts()]
    for held, longest, piece in ((5, 48, 1 << 19), (1 << 21, 3, 30), (40, 48, 7)):
        monkeypatch.setattr(pieces, "HELD", held)
        monkeypatch.setattr(pieces, "LONGEST", longest)
        monkeypatch.setattr(pieces, "PIECE", piece)
        model.forget()
        assert [ids for i in range(0, len(texts()), 40) for ids in model.batch(texts()[i : i + 40])] == want
    model.forget()


def test_round_trip(model):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    for t in texts() + docs:
        assert model.decode(np.frombuffer(model.encode(t), "<u2")) == t


def test_library_decodes_the_same(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for t in texts():
        if "▁" not in t and "\x00" not in t:
            assert sp.decode(np.frombuffer(model.encode(t), "<u2").tolist()).strip() == t.strip()


def test_tables(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "a b " * 30000, None), (2, "a b", "y"), (2, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    out = pieces.decode(pieces.encode(df, pieces.model_path()), pieces.model_path()).collect()
    assert sorted(r.decoded for r in out) == sorted(t or "" for _, t, _ in rows)
    assert out[0].asDict().keys() == {"doc_id", "text", "piece_ids", "decoded"}
    assert pieces.encode(df.limit(0), pieces.model_path()).count() == 0


def test_one_pass_equals_two(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "a b " * 30000, None), (2, "a ▁ b\x00é", "y")]
    df, path = spark.createDataFrame(rows, "doc_id long, text string, decoded string"), pieces.model_path()
    two = pieces.decode(pieces.encode(df, path), path).collect()
    assert pieces.round_trip(df, path).select(*two[0].asDict()).collect() == two
    assert pieces.round_trip(df.limit(0), path).count() == 0
    assert pieces.round_trip(df.select(F.expr("doc_id as text"), "decoded"), path, "text", back="text").columns == ["decoded", "piece_ids", "text"]
