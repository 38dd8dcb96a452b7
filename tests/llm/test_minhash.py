import itertools
import random
import re

import numpy as np

from tidemark.llm import components, minhash
from tidemark.llm.components import connected_components
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.scratch import Scratch


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def texts(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice((2, 5, 40, 200)))]
        out.append(" ".join(base))
        for _ in range(r.randrange(5)):
            near = list(base)
            for _ in range(r.randrange(6)):
                near[r.randrange(len(near))] = r.choice(vocab)
            out.append(r.choice((" ", "\n\t")).join(near).upper() if r.random() < 0.3 else " ".join(near))
    r.shuffle(out)
    return list(enumerate(out))


def test_equals_brute_force(spark):
    for words, percent in ((3, 85), (5, 80)):
        rows = texts(words)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, words, percent)


def test_chain_over_unlinked_ends(spark):
    words = [f"a{i}" for i in range(100)]
    rows = [(k, " ".join(words[: 100 - 4 * k])) for k in range(8)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 3, 85)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (9, long), (8, long + " y"), (4, "One two")]
    df = spark.createDataFrame([(a, b, "t", 1) for a, b in rows], "doc_id long, text string, node string, key int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect())
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (0, 1, None, True), (8, 29999, 8, True), (9, 29998, 8, False)],
        key=lambda r: (r[0], r[1]),
    )


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_by_hash():
    r = random.Random(2)
    marks = ["a", "B", "\u00e9", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u00a0", ".", "zz"]
    docs = [None, "", " "] + ["".join(r.choice(marks) for _ in range(r.randrange(40))) for _ in range(300)]
    got = minhash.word_hashes([None if t is None else t.encode() for t in docs])
    of = {}
    for t, h in zip(docs, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(words) == len(h)
        assert all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
    assert len(set(of.values())) == len(of)


def test_hot_nodes_and_shingles_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SALT", 3)
    rows = texts(7)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 3, 85)


def test_components_with_a_star(spark, monkeypatch):
    monkeypatch.setattr(components, "MANY", 5)
    edges = [(500, i) for i in range(40)] + [(i, i + 1000) for i in range(0, 40, 3)] + [(2000 + i, 2001 + i) for i in range(6)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    want = {i: 0 for i in [500, *range(40), *range(1000, 1040, 3)]} | {i: 2000 for i in range(2000, 2007)}
    assert {r.node: r.component for r in got.collect()} == {n: c for n, c in want.items() if n != c}


def test_components_of_few_links_need_no_round_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    # the rounds join through join_unique; few links are solved without it
    monkeypatch.setattr(components, "join_unique", lambda *a, **b: (_ for _ in ()).throw(AssertionError("a round of joins")))
    by_arrays = connected_components(edges, Scratch(spark, "test"))
    arrays = sorted(map(tuple, by_arrays.collect()))
    assert by_arrays.schema.simpleString() == "struct<node:bigint,component:bigint>"
    monkeypatch.undo()
    monkeypatch.setattr(components, "FEW", 0)
    assert arrays == sorted(map(tuple, connected_components(edges, Scratch(spark, "test")).collect()))
    least = {}
    for a, b in [p for p in pairs if None not in p] * 80:
        least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    assert dict(arrays) == {k: v for k, v in least.items() if k != v}


def test_a_step_of_many_links_keeps_no_scratch_table(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 0)
    scratch = Scratch(spark, "test")
    assert connected_components(spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "a long, b long"), scratch).count() == 3
    assert not {"least", "large", "low"} & set(scratch.paths)
