import random
import zlib

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.scratch import Scratch


def brute(x, lo, hi):
    """By definition: the best segment, the shortest of equals, then both sides."""
    best = None
    for i in range(lo, hi):
        for j in range(i + 1, hi + 1):
            v = (sum(x[i:j]), -(j - i))
            if v[0] > 0 and (best is None or v > best[0]):
                best = (v, i, j)
    if not best:
        return []
    (v, _), i, j = best
    return brute(x, lo, i) + [(i, j, v)] + brute(x, j, hi)


def test_segments_equal_definition():
    r = random.Random(1)
    for _ in range(400):
        x = [r.uniform(-2, 1.6) for _ in range(r.randrange(14))]
        got = toxicity.segments(np.array(x))
        want = brute(x, 0, len(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([v for *_, v in got], [v for *_, v in want])


def test_segments_of_nothing():
    assert toxicity.segments(np.array([])) == []
    assert toxicity.segments(np.full(5, -1.0)) == []
    assert toxicity.segments(np.zeros(5)) == []


def data(spark, n=600):
    r = random.Random(2)
    vocab = ["w%d" % i for i in range(200)]
    bad = ["grumblef" + "".join(r.choice("abcdef") for _ in range(3)) for _ in range(60)]
    rows, labels = [], []
    for i in range(n):
        ws = [r.choice(vocab) for _ in range(r.choice((5, 40, 400)))]
        toxic = int(r.random() < 0.25)
        if toxic:
            at = r.randrange(len(ws))
            ws[at:at] = [r.choice(bad) for _ in range(r.choice((2, 5)))]
        rows.append((i, " ".join(ws), "x"))
        labels.append((i, 0, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_accuracy_and_passages(spark):
    docs, labels, truth = data(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [(t, out[i].score >= 0.7) for i, _, t in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(t == p for t, p in held) / len(held) > 0.97
    marked = [[("grumblef" in texts[i][p.start : p.end]) for p in out[i].passages] for i, _, t in truth]
    assert all(any(m) for m, (_, _, t) in zip(marked, truth) if t)
    clean = [bool(m) for m, (_, _, t) in zip(marked, truth) if not t]
    assert sum(clean) / len(clean) < 2 * toxicity.SIGNIFICANT  # what the expected number allows


def test_held_out_labels_are_not_read(spark):
    docs, labels, truth = data(spark, 200)
    docs = docs.select("doc_id", "text")
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in truth], labels.schema)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_defined_cases(spark):
    docs, labels, _ = data(spark, 200)
    model = toxicity.fit(docs, labels)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "grumblefabc grumblefabd grumblefaaa"), (None, "w1 w2"), (4, "w1"), (4, "w1"), (7, "w1 " * 100_000)]
    out = toxicity.score(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, passages int"), model).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id): r.score for r in out if r.doc_id in (1, 2, 3, 7)}
    assert by[1] == by[2] == by[3] < 0.5 and by[7] < 0.5
    assert max(r.score for r in out if r.doc_id == 4) >= 0.7
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), none).count() == 0
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_every_unit_stays(spark):
    n = 61_000  # words of their own beginnings, each seen in three toxic documents
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: "".join(letters[i // 26**k % 26] for k in range(4))
    bad = " ".join(name(i) for i in range(n))
    rows = [(i, bad if i % 2 else "w1 w2 w3 w4 " * 50, i % 2) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, step=0.01)
    assert len(model.units) > n
    assert all(model.units.get(name(i)) is not None for i in range(n))


def test_units_by_hash():
    names = ["word", "^wor", "wor", "\u00fcber", "\u4e2d\u6587", "a" * 300]
    units = toxicity.Units(np.array([toxicity.hash_of(w) for w in names]), np.arange(6, dtype=np.float32))
    assert [units.get(w) for w in names] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert units.get("other") is None and units.get("^word") is None and toxicity.Units().get("word") is None


def test_token_scores_equal_a_walk_over_strings(monkeypatch):
    r = random.Random(9)
    atoms = ["alpha", "alphabet", "al", "beta", "\u00e9t\u00e9", "\u6f22\u5b57", ".", "-", "'", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "(", "x" * 40, "7", "\U0001f600", "\u0130"]
    units = {u: r.uniform(-2, 2) for u in ("alpha", "^alp", "^alph", "beta", "^bet", "\u00e9t\u00e9", "^x" + "x" * 5, "7", "^\u6f22\u5b57")}
    model = toxicity.Model(toxicity.Units(np.array([toxicity.hash_of(u) for u in units]), np.array(list(units.values()), np.float32)))

    def of(word):
        for u in [word, *["^" + word[:n] for n in (6, 5, 4, 3) if len(word) >= n]]:
            if u in units:
                return np.float32(units[u])
        return 0.0

    texts = [None, "", " "] + ["".join(r.choice(atoms) for _ in range(r.randrange(60))) for _ in range(200)]
    want = []
    for t in texts:
        raw = (t or "").lower().split()
        want.append([max((of(w) for w in "".join(c if c.isalnum() else " " for c in x).split()), default=0.0) - model.drift for x in raw])
    for piece in (1 << 19, 40):
        monkeypatch.setattr("tidemark.llm.hashing.PIECE", piece)
        got = toxicity.Scanner(model).tokens(texts)
        assert all(len(x) == len(w) and np.allclose(x, w) for (_, x), w in zip(got, want, strict=True))
    for t, (tokens, x) in zip(texts, got, strict=True):
        raw = (t or "").lower().split()
        assert len(set(zip(raw, tokens.tolist(), strict=True))) == len(set(raw)) == len(set(tokens.tolist()))
        assert np.isclose(toxicity.best_score(x), max((v for *_, v in toxicity.segments(x)), default=0.0))


def test_smoothed_rates_equal_the_formula(spark):
    counts = {"abcdefg": (3, 1), "abcdefh": (0, 5), "abcxyz": (4, 0), "ab": (2, 7), "zzz": (1, 30)}
    rows = []
    for w, (t, n) in counts.items():
        rows.append((toxicity.hash_of(w), *[toxicity.hash_of("^" + w[:k]) if len(w) >= k else None for k in toxicity.PREFIXES], t, n))
    units, spread = toxicity._units(spark.createDataFrame(rows, toxicity._COUNTS), 5.0, 1, 0.0, 0.3, Scratch(spark, "test"))
    all_t, all_n = sum(t for t, _ in counts.values()) + 1, sum(n for _, n in counts.values()) + 1
    root = all_t / (all_t + all_n)

    def rate(word, whole):
        up = root
        for k in toxicity.PREFIXES:
            if len(word) >= k:
                t, n = (sum(c[i] for w, c in counts.items() if w[:k] == word[:k] and len(w) >= k) for i in (0, 1))
                up = (t + 5 * up) / (t + n + 5)
        return (counts[word][0] + 5 * up) / (sum(counts[word]) + 5) if whole else up

    value = lambda p: np.log(p / (1 - p)) - np.log(root / (1 - root))
    for w in counts:
        assert np.isclose(units.get(w), value(rate(w, True)), atol=1e-5)
        for k in toxicity.PREFIXES:
            if len(w) >= k:
                assert np.isclose(units.get("^" + w[:k]), value(rate(w[:k], False) if w[:k] in counts else prefix_rate(counts, w[:k], root)), atol=1e-5)
    assert sum(n for _, n in spread) == sum(n for _, n in counts.values())


def prefix_rate(counts, prefix, root):
    up = root
    for k in toxicity.PREFIXES:
        if len(prefix) >= k:
            t, n = (sum(c[i] for w, c in counts.items() if w[:k] == prefix[:k] and len(w) >= k) for i in (0, 1))
            up = (t + 5 * up) / (t + n + 5)
    return up


def test_lambda_solves_its_equation():
    spread = [(-0.5, 900.0), (0.4, 80.0), (2.0, 3.0)]
    v = toxicity._lambda(spread)
    assert np.isclose(sum(n * np.exp(v * x) for x, n in spread) / sum(n for _, n in spread), 1.0)


def test_logistic_weights_are_stationary():
    cells = [(-2.0, 0.0, 0, 50), (1.0, 0.5, 0, 5), (3.0, 1.0, 1, 20), (0.0, 0.2, 1, 4)]
    w = np.array(toxicity._logistic(cells))
    x, y, n = np.array([[1, a, b] for a, b, _, _ in cells]), np.array([c[2] for c in cells]), np.array([c[3] for c in cells])
    assert np.allclose(x.T @ (n * (y - 1 / (1 + np.exp(-x @ w)))), np.array([1e-3, 1, 1]) * w, atol=1e-5)


def test_ids_of_text_teach_too(spark):
    docs, labels, _ = data(spark, 200)
    named = lambda d: d.withColumn("doc_id", d.doc_id.cast("string"))
    a = toxicity.fit(docs, labels)
    b = toxicity.fit(named(docs), named(labels))
    assert a.weights == b.weights and (a.units.hashes == b.units.hashes).all()


def test_passages_do_not_depend_on_earlier_repeats(spark):
    docs, labels, _ = data(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    bad = [f"grumblef{x}" for x in ("aaa", "abb", "acc", "add", "aee")]
    gap = " ".join(f"w{i}" for i in range(200))
    early = " ".join(f"{w} {gap}" for _ in range(3) for w in bad)  # each three times, scattered
    passage = " ".join(bad)
    text = " ".join([early, passage, *[gap, passage] * 7])
    (row,) = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    spans, at = [], len(early) + 1
    for _ in range(8):
        spans.append((at, at + len(passage)))
        at += len(passage) + len(gap) + 2
    assert all(text[a:b] == passage for a, b in spans)
    assert all(any(p.start <= a and b <= p.end for p in row.passages) for a, b in spans)
    assert row.score >= 0.7


def test_damping_ignores_order():
    words, x = np.array([1, 1, 2, 1, 1, 3]), np.array([1.0, 1, 2, 1, 1, -0.5])
    back = toxicity.damped(words[::-1], x[::-1], 5.5)
    assert np.isclose(back, toxicity.damped(words, x, 5.5)) and np.isclose(back, 5.5 * 5 / 6)
    assert toxicity.damped(np.arange(4), np.ones(4), 4.0) == 4.0
