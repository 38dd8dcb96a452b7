import itertools
import math

import numpy as np

from tidemark.llm import neighbours


def brute(rows, queries, k):
    seen = {}
    for i, v in rows:
        good = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if good:
            seen[i] = min(seen.get(i, v), v)
    out = []
    for q in queries:
        if q in seen:
            near = sorted((math.dist(seen[q], v), i) for i, v in seen.items() if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


def test_perturbation_order_equals_enumeration():
    for m in (1, 2, 3, 4):
        cost = lambda j: j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))  # noqa: B023, E731
        every = [s for n in range(m + 1) for s in itertools.combinations(range(2 * m), n) if not any(2 * m - 1 - r in s for r in s)]
        got = neighbours.perturbations(m, 10_000)
        total = lambda s: sum(cost(r + 1) for r in s)  # noqa: B023, E731
        assert sorted(got) == sorted(every) and len(got) == 3**m and got[0] == ()
        assert np.allclose([total(s) for s in got], sorted(map(total, every)))


def test_visits_are_the_keys_of_moved_slots():
    r = np.random.default_rng(2)
    index = neighbours.Index.make(5, 1.0, 2, 3)
    x = r.normal(size=(4, 5))
    at, got = index.at(x), index.visits(x, 27)
    slots = np.floor(at)
    assert (got[:, :, 0] == index.keys(x)).all()
    for i in range(4):
        for t in range(2):
            border = [(d, j, way) for j in range(3) for d, way in ((at[i, t, j] - slots[i, t, j], -1), (slots[i, t, j] + 1 - at[i, t, j], 1))]
            border.sort()
            for p, moves in enumerate(neighbours.perturbations(3, 27)):
                moved = slots[i : i + 1].copy()
                for rank in moves:
                    moved[0, t, border[rank][1]] += border[rank][2]
                assert index.mixed(index.sums(moved))[0, t] == got[i, t, p]
    seen = neighbours.first_visits(index, x, x, 27)
    assert (np.diag(seen) == 0).all() and (seen <= 27).all()


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, rep string")


def run(spark, rows, every=10, k=10, **options):
    df = table(spark, rows)
    got = neighbours.nearest(df, df.where(f"vec_id % {every} = 0"), k, **options)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def recall(got, want):
    return len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) / len(want)


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(3)
    for rows in (
        r.normal(size=(700, 32)),
        np.repeat(r.normal(size=(40, 16)), 15, axis=0) + 0.05 * r.normal(size=(600, 16)),
    ):
        data = [(i, v.tolist()) for i, v in enumerate(rows)]
        got, want = run(spark, data), brute(data, range(0, len(data), 10), 10)
        assert len(got) == len(want) and recall(got, want) >= 0.9
        at = dict(data)
        assert all(abs(s - math.dist(at[q], at[v])) < 1e-12 for q, _, v, s in got)
        for _, g in itertools.groupby(got, key=lambda x: x[0]):
            g = list(g)
            assert [x[1] for x in g] == list(range(1, 11)) and [(x[3], x[2]) for x in g] == sorted((x[3], x[2]) for x in g)


def test_one_vector_on_most_rows(spark):
    r = np.random.default_rng(4)
    same = r.normal(size=8).tolist()
    rows = [(i, same if i % 3 else r.normal(size=8).tolist()) for i in range(900)]
    got, want = run(spark, rows, 20), brute(rows, range(0, 900, 20), 10)
    assert recall(got, want) >= 0.9
    hot = [x for x in got if rows[x[0]][1] is same]
    assert [(q, n, v) for q, n, v, _ in hot] == [(q, n, v) for q, n, v, _ in want if rows[q][1] is same]


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 0.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (10, [5.0, 5.0]), (10, [5.0, 5.0]), (None, [1.0, 1.0]), (20, None), (11, [1.0, 2.0, 3.0])]
    got = run(spark, rows)
    assert got == [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 10, math.sqrt(41)), (10, 1, 7, math.sqrt(34)), (10, 2, 8, math.sqrt(34)), (10, 3, 0, math.sqrt(41))]
    empty = table(spark, rows).limit(0)
    assert neighbours.nearest(empty, empty).count() == 0
    assert run(spark, [(0, [1.0, 1.0])]) == []


def test_joined_queries_give_what_broadcast_ones_give(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 50)  # buckets dealt by salt
    r = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(np.repeat(r.normal(size=(3, 8)), 200, axis=0) + 0.01 * r.normal(size=(600, 8)))]
    assert run(spark, rows, 30) == run(spark, rows, 30, query_bytes=0)


def test_few_candidates_where_vectors_have_clusters():
    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(100, 32)), 20, axis=0) + 0.02 * r.normal(size=(2000, 32))
    some = np.arange(0, 2000, 50)
    near = np.argsort(np.square(x[some][:, None] - x[None]).sum(axis=2), axis=1)[:, 1:11]
    found = np.concatenate((np.repeat(np.arange(len(some)), 10)[:, None], x[near.ravel()]), axis=1)
    fitted = neighbours.fit(x[some], found, x, 2000, 16, 0.93)
    assert fitted.recall >= 0.93 and fitted.share < 0.05
    hashes = fitted.index.planes.shape[1]
    seen = neighbours.first_visits(fitted.index, x[some], x, len(neighbours.perturbations(hashes, 512)))
    mean = [(seen[np.arange(len(some))[:, None], near] < p).mean() for p in (1, 4, fitted.probes)]
    assert mean == sorted(mean) and mean[-1] >= 0.93  # later visits only add
    assert neighbours.fit(x[some], found[:0], x, 2000, 16, 0.93) is None
