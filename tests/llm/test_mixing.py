import random
import re
from fractions import Fraction

from tidemark.llm import mixing


def reachable(histogram, budget):
    got = {0}
    for s, c in histogram.items():
        for _ in range(c):
            got |= {g + s for g in got if g + s <= budget}
    return max(got)


def test_counts_are_best_where_the_programme_covers_all():
    r = random.Random(1)
    for _ in range(200):
        h = {r.randrange(1, 40): r.randrange(1, 5) for _ in range(r.randrange(1, 7))}
        total = sum(s * c for s, c in h.items())
        budget = r.randrange(0, total + 5)
        got = mixing.fit_counts(h, budget)
        assert all(0 <= got.get(s, 0) <= c for s, c in h.items())
        words = sum(s * c for s, c in got.items())
        assert words <= budget
        # proportional shares come first, so the best sum overall is a bound that is met closely
        assert reachable(h, min(budget, total)) - words <= max(h)


def test_large_histogram_meets_the_budget():
    r = random.Random(2)
    h = {s: r.randrange(1, 50) for s in range(1, 6000, 7)}
    total = sum(s * c for s, c in h.items())
    for part in (0.01, 0.37, 0.9):
        budget = int(total * part)
        assert sum(s * c for s, c in mixing.fit_counts(h, budget).items()) == budget


def slow_targets(sizes):
    order = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    w = [(5, 2, 1)[i % 3] for i in range(len(order))]
    budget, fixed = Fraction(3 * sum(n for _, n in order), 2), {}
    while True:
        free = [i for i in range(len(order)) if i not in fixed]
        left = budget - sum(fixed.values())
        now = {i: left * w[i] / sum(w[j] for j in free) for i in free} if free else {}
        over = {i: Fraction(2 * order[i][1]) for i in free if now[i] > 2 * order[i][1]}
        if not over:
            return {order[i][0]: {**fixed, **now}[i] for i in range(len(order))}
        fixed |= over


def test_targets():
    r = random.Random(3)
    for _ in range(200):
        sizes = [(f"s{i}" if i else None, r.choice((0, 1, 10, 1000, 10**7))) for i in range(r.randrange(1, 9))]
        got = mixing.targets(sizes)
        assert got == slow_targets(sizes)
        assert all(0 <= got[s] <= 2 * n for s, n in sizes) and sum(got.values()) == Fraction(3, 2) * sum(n for _, n in sizes)
    assert mixing.targets([]) == {}


def docs(spark, n=600):
    r = random.Random(5)
    rows = []
    for i in range(n):
        source = r.choice(("a", "a", "a", "b", "é", "😀", None))
        rows.append((i, r.choice((" ", "\n ")).join("w" for _ in range(r.choice((0, 1, 5, 5, 5, 17, 80)))), source, 3))
    rows += [(n, None, "a", 3), (None, "x y", "b", 3), (7, "t", "zero", 1), (7, "t", "zero", 1), (n + 1, "", "void", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_plan(spark):
    rows, df = docs(spark)
    base = mixing.sized(df.drop("size")).select("doc_id", "source", "size")
    out = mixing.plan(base).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = mixing.targets(list(sizes.items())), dict.fromkeys(sizes, 0)
    for r in out:
        assert 0 <= r.times <= 2 and r.source_size == sizes[r.source] and r.target == float(want[r.source])
        taken[r.source] += r.times * r["size"]
    for s in sizes:
        assert 0 <= want[s] - taken[s] < 17
    again = mixing.plan(base.repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mix_repeats_rows(spark):
    rows, df = docs(spark)
    out = mixing.mix(df).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "size"}
    words = sum(len((r.text or "").split()) for r in out)
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert abs(words - 1.5 * total) < 100
    assert mixing.mix(df.limit(0)).count() == 0
