import os
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bitplane, separators
from tidemark.llm.bpe import Encoder, vocabulary

PATTERN = public_tokenizers.PATTERN
ODD = ["", " ", "  a  b\n\n c", "it's we'll I'D !'s ''s", "a b c", "漢字 テスト", "😀 é ñ ü ß", "<|endoftext|> x", "\x1c\x85 y", "\r\n\t", "œuvre €5 “q” …", "x" * 3000]


def library():
    return Tokenizer.from_file(vocabulary())


def corpus(n=400):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    r = random.Random(1)
    marks = "ab é'ſ漢.,!? \n\t ​-0195²½Ⅷ_"
    return (rows + ODD + ["".join(r.choice(marks) for _ in range(r.randrange(60))) for _ in range(n)])


def test_words_give_the_ids_of_whole_texts():
    texts = corpus(3000)
    got = Encoder(vocabulary(), PATTERN).batch(texts)
    want = library().encode_batch_fast(texts, add_special_tokens=False)
    for t, g, w in zip(texts, got, want):
        assert np.frombuffer(g, "<u2").tolist() == w.ids, t


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
def test_planes_round_trip(kind, dtype):
    r = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        ids = r.integers(0, np.iinfo(dtype).max, n, dtype=dtype, endpoint=True)
        planes = bitplane.to_planes(ids, kind)
        assert len(planes) == ids.dtype.itemsize * (8 if kind == "bit" else 1)
        assert (bitplane.from_planes(planes, n, ids.dtype.itemsize, kind) == ids).all()


@pytest.mark.parametrize("kind,chunk,block", [("byte", 1 << 16, 1 << 14), ("bit", 64, 10), ("byte", 1, 1)])
def test_files_round_trip(spark, tmp_path, kind, chunk, block):
    texts = corpus(60)[-130:] + [None, "last"]
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    docs = spark.createDataFrame([(i, texts[i], i) for i in order], "doc_id long, text string, start int").repartition(5)
    path = str(tmp_path / "ids")
    bitplane.write_ids(docs, path, vocabulary(), PATTERN, chunk=chunk, block=block, kind=kind)
    got = sorted(bitplane.read_ids(spark, path).collect(), key=lambda r: r.doc_id)
    at, tok = 0, library()
    for i, r in enumerate(got):
        ids = [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        at += len(ids)
    assert len(got) == len(texts)


def test_files_of_no_and_repeated_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    bitplane.write_ids(empty, str(tmp_path / "e"), vocabulary(), PATTERN)
    assert bitplane.read_ids(spark, str(tmp_path / "e")).count() == 0
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (1, "a")], "doc_id long, text string")
    bitplane.write_ids(docs, str(tmp_path / "r"), vocabulary(), PATTERN)
    got = bitplane.read_ids(spark, str(tmp_path / "r")).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), (1, 2), (1, 4), (1, 6)]


def test_scan_stitches_blocks(spark, tmp_path):
    r = random.Random(5)
    want = set()
    for f in range(4):
        ids, at, k = [], 0, 0
        for _ in range(r.choice((0, 1, 40))):
            n = r.choice((0, 1, 3, 50))
            ids += [r.randrange(9) for _ in range(n)] + [9]
            want.add((f, k, at, n + 1, True))
            at, k = at + n + 1, k + 1
        if f % 2:
            ids += [1, 2, 3]
            want.add((f, k, at, 3, False))
        np.array(ids, "<u2").tofile(tmp_path / f"part-{f}.bin")
    for block in (1, 2, 7, 1000):
        got = separators.scan_flat(spark, str(tmp_path), 9, block=block).collect()
        assert {(int(os.path.basename(x.file)[5]), x.ordinal, x.start, x.n_tokens, x.closed) for x in got} == want
        assert len(got) == len(want)


def test_counts_of_documents(spark, tmp_path):
    texts = corpus(50) + [None]
    src = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ordinal int").repartition(3).write.parquet(src)
    got = {r.doc_id: r.n_tokens for r in separators.token_counts(spark.read.parquet(src), vocabulary(), PATTERN, 50256, block=100).collect()}
    tok = library()
    tok.encode_special_tokens = True
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    # any plan will do, though a second run would deal its rows otherwise
    other = spark.read.parquet(src).repartition(4).union(spark.createDataFrame([(None, "a b", 0), (5, "c", 0)], "doc_id long, text string, ordinal int"))
    again = separators.token_counts(other.where("doc_id is null or doc_id <> 5 or text = 'c'"), vocabulary(), PATTERN, 50256)
    named = {r.doc_id: r.n_tokens for r in again.collect()}
    assert named == got | {None: 3, 5: 2}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert separators.token_counts(none, vocabulary(), PATTERN, 50256).count() == 0


def test_spelled_out_classes():
    import re

    import regex

    from tidemark.llm import bpe

    plain = [chr(c) for c in range(0x2100) if not bpe._ODD.search(chr(c))]
    for one, full in ((f"[{bpe._LETTER}]", r"\p{L}"), (f"[{bpe._NUMBER}]", r"\p{N}"), (f"[{bpe._BLANK}]", r"\s")):
        assert [c for c in plain if re.match(one, c)] == [c for c in plain if regex.match(full, c)]
    assert bpe._PATTERN == PATTERN


def test_cache_generations():
    texts = corpus(300)
    coder, tok = Encoder(vocabulary(), PATTERN, cache=50), library()
    for i in range(0, len(texts), 7):
        part = texts[i : i + 7]
        assert [np.frombuffer(g, "<u2").tolist() for g in coder.batch(part)] == [e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)]
