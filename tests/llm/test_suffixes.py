import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import suffixes


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        last = -1
        for p in range(len(b) - 49 if i is not None else 0):
            if least[b[p : p + 50]] < i:
                for q in range(max(p, last), p + 50):
                    gone[q] = True
                last = p + 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, parts=5):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, payload int").repartition(parts)
    out = suffixes.without_repeats(df).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out]


def check(spark, rows, parts=5):
    assert sorted(map(repr, run(spark, rows, parts))) == sorted(map(repr, brute(rows)))


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randrange(2, 8))) for _ in range(500)]
    shared = [" ".join(r.choice(vocab) for _ in range(12)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 6)):
            k = r.random()
            if k < 0.3:
                parts.append(r.choice(shared)[r.randrange(8) :])
            elif k < 0.4 and texts:
                t = r.choice(texts)
                a = r.randrange(len(t) + 1)
                parts.append(t[a : a + r.choice((48, 49, 50, 51, 400))])
            elif k < 0.45:
                parts.append(r.choice(("a", "ab", "\x00")) * r.randrange(130))
            else:
                parts.append(" ".join(r.choice(vocab) for _ in range(r.randrange(60))))
        texts.append("".join(parts))
        if r.random() < 0.15:
            texts.append(texts[-1])
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("hot", [2, 50])
@pytest.mark.parametrize("piece", [300, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, hot, piece):
    # functions run in other processes: constants are read through the closure's module there, so
    # the small settings are tried in this process
    monkeypatch.setattr(suffixes, "RUN", 26 * hot)  # hot strings come in several runs
    monkeypatch.setattr(suffixes, "PIECE", piece)
    for seed in range(4):
        rows = corpus(seed)
        assert sorted(local(rows, hot)) == sorted(brute(rows))


def local(rows, hot, tasks=4):
    """The operator's stages in one process."""
    import pandas as pd
    import pyarrow as pa

    class Held:
        def __init__(self, value):
            self.value = value

    bits = 6
    batches = []
    for k in range(tasks):
        mine = rows[k::tasks]
        batches.append([pa.record_batch([pa.array([i for i, _ in mine], pa.int64()), pa.array([hash(t) for _, t in mine], pa.int64()), pa.array([t.encode() for _, t in mine], pa.binary())], ["doc_id", "th", "text"])])
    grams = [x for b in batches for out in suffixes._grams(bits)(iter(b)) for x in out.to_pylist()]
    frame = pd.DataFrame(grams)
    tables = {int(k): suffixes._tables(bits, hot)(g) for k, g in frame.groupby("bucket")}
    shared = suffixes._joined_tables({b: (f["shared"].iloc[0], f["hot"].iloc[0]) for b, f in tables.items()}, bits)
    assert hot > 2 or len(shared[1])
    bounds = np.array([b"b", b"c e"], "S25")
    out = [x for b in batches for o in suffixes._runs(Held(shared), Held(bounds), 3)(iter(b)) for x in o.to_pylist()]
    found = [(x["doc_id"], x["th"], x["payload"]) for x in out if x["kind"] == 1]
    for kind, f in ((0, suffixes._merge), (2, lambda pdf: suffixes._merge(pdf, True))):
        for part in {x["part"] for x in out if x["kind"] == kind}:
            got = f(pd.DataFrame([x for x in out if x["kind"] == kind and x["part"] == part]))
            found += list(got.itertuples(index=False, name=None))
    result = []
    for i, t in rows:
        b = t.encode()
        gone = suffixes.removed(np.array([len(b)]), [[p for d, h, p in found if d == i and h == hash(t)]])
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        result.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return result


def test_tables(spark):
    check(spark, corpus(9))
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    check(spark, [(r["doc_id"], r["text"]) for r in rows])


def test_defined_cases(spark):
    line = "The quick brown fox jumps over the lazy dog, twice and then again."
    rows = [(1, None), (2, ""), (3, line[:49]), (4, line), (5, line), (5, line + " more"), (5, line), (None, line), (-3, line[:60]), (8, line * 3), (9, "z" * 200_000), (10, "z" * 60)]
    check(spark, rows)
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_never_compares_known_prefixes():
    r = random.Random(1)
    runs, every = [], []
    for n in range(7):
        keys = sorted({bytes(r.choice(b"ab") for _ in range(suffixes.KEY)) if r.random() < 0.5 else b"a" * 60 + bytes(r.choice(b"ab") for _ in range(suffixes.KEY - 60)) for _ in range(r.randrange(40))})
        every += keys
        last, run = None, []
        for i, k in enumerate(keys):
            same = 0 if last is None else next((j for j in range(len(k)) if k[j] != last[j]), len(k))
            run.append((k, same, n, n, i))
            last = k
        runs.append(iter(run))
    got = list(suffixes.merged(runs))
    assert [k for _, k, *_ in got] == sorted(every)
    for (_, a, *_), (n, b, *_) in zip(got, got[1:]):
        assert n == next((j for j in range(len(a)) if a[j] != b[j]), len(a))
