import hashlib
import random
import re

from tidemark.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda: 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule, text or "") if good(kind, m[0])]
    return sorted(out)


def digest(spans):
    text = ",".join(f"{list(RULES)[k]}:{s}:{e}" for s, k, e in spans)
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(df)
    return {r.doc_id: r for r in pii.digest(found, pii.fit(pii.vote_counts(found))).collect()}


def test_base_spans_equal_brute_force(spark):
    r = random.Random(3)
    atoms = ["a", "Z9", "é", "漢", "😀", "@", "@x.com", ".", "..", "-", "_", "+", "+1", "%", " ", "  ", "\n", "\t", "(", ")", "0", "12", "255", "256.1", "10.0.0.1",
             "4111 1111 1111 1111", "4111111111111111", "+1 (555) 555-1234", "bob.1@mail.example.com", "1.2.3.4.5.6.7.8", "12-34", "", "�"]
    rows = [(i, "".join(r.choice(atoms) for _ in range(r.randrange(30)))) for i in range(1500)]
    got = run(spark, rows)
    for i, text in rows:
        want = brute(text)
        assert got[i].base_sha256 == digest(want), (text, want, got[i])
        for k, kind in enumerate(pii.BASE):
            assert got[i][f"n_{kind}"] == sum(x[1] == k for x in want)
        every = set(got[i].spans.split(",")) if got[i].spans else set()
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want} <= every


def test_adds_spans_in_context_and_leaves_others(spark):
    rows = [(i, f"call me, my phone is (415) 555-0{i:03d} or write to bob@mail{i}.example.com") for i in range(40)]
    rows += [(100 + i, f"My social security number is 123-45-{6000 + i} and card 4111 1111 1111 1111") for i in range(20)]
    rows += [(200 + i, f"section {i}.{i}.{i + 300}.1 of the plain text about 1999 and 2024 totals 12 000 {i}") for i in range(40)]
    got = run(spark, rows)
    assert all("phone:" in got[i].spans for i in range(40))
    assert all("national_id:" in got[100 + i].spans for i in range(20))
    assert all(got[200 + i].spans == "" for i in range(40))


def slow_fit(counts, rounds=50):
    """The same model row by row: Dawid and Skene on votes that are no abstentions,
    with the prior counts of the operator."""
    weak = {1: (0.9, 0.15), -1: (0.1, 0.85)}
    rows = [(kind, votes) for kind, votes, n in counts for _ in range(n)]
    strength = 20 + len(rows) / 2
    prior = dict.fromkeys(pii.KINDS, 0.5)
    emission = {v: dict(weak) for v in pii.VOTES}
    for _ in range(rounds):
        post = []
        for kind, votes in rows:
            yes, no = prior[kind], 1 - prior[kind]
            for v, x in zip(pii.VOTES, votes, strict=True):
                if x:
                    yes, no = yes * emission[v][x][0], no * emission[v][x][1]
            post.append(yes / (yes + no))
        for kind in pii.KINDS:
            of = [p for p, (k, _) in zip(post, rows, strict=True) if k == kind]
            prior[kind] = (sum(of) + 1 + len(of) / 4) / (1.5 * len(of) + 2)
        for i, v in enumerate(pii.VOTES):
            part = {x: [strength * weak[x][j] + sum(q for p, (_, w) in zip(post, rows, strict=True) if w[i] == x for q in [(p, 1 - p)[j]]) for j in (0, 1)] for x in weak}
            total = [sum(part[x][j] for x in weak) for j in (0, 1)]
            emission[v] = {x: (part[x][0] / total[0], part[x][1] / total[1]) for x in weak}
    return prior, emission


def test_reliabilities_equal_a_walk_over_rows(spark):
    r = random.Random(5)
    counts = [(r.choice(pii.KINDS), tuple(r.choice((-1, 0, 1)) for _ in pii.VOTES), r.randrange(1, 6)) for _ in range(12)]
    counts = list({c[:2]: c for c in counts}.values())
    table = spark.createDataFrame([(k, *v, 3, n) for k, v, n in counts], "kind string, " + ", ".join(f"{v} int" for v in pii.VOTES) + ", size int, count long")
    model = pii.fit(table)
    prior, emission = slow_fit(counts)
    assert all(abs(model.prior[k] - prior[k]) < 1e-9 for k in prior)
    assert all(abs(a - b) < 1e-9 for v in emission for x in (-1, 1) for a, b in zip(model.emission[v][x], emission[v][x], strict=True))


def test_planted_spans_by_precision_and_recall(spark):
    """The classifier decides where patterns alone cannot: same shapes, other context."""
    r = random.Random(12)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows, planted = [], {}
    for i in range(400):
        kind = i % 8
        text, span = f"plain words number {i} and nothing else here", None
        if kind == 0:
            text, span = f'set token = "{key(40)}" before the run', "secret"
        elif kind == 1:
            text = f"fixed in commit {key(40)} of the tree"
        elif kind == 2:
            text, span = f"please call my phone 415-555-{1000 + i} today", "phone"
        elif kind == 3:
            text = f"invoice 115-023-{1000 + i} was paid"
        elif kind == 4:
            text, span = f"write to jane{i} [at] mail{i}.example [dot] com now", "email"
        elif kind == 5:
            text = f"the-quick-brown-fox-jumps-{i} over the lazy dog"
        elif kind == 6:
            text = f"order 4000 0000 0000 {1000 + i} shipped" if not luhn(f"400000000000{1000 + i}") else text
        rows.append((i, text))
        planted[i] = span
    got = run(spark, rows)
    added = {i: [s.split(":")[0] for s in got[i].spans.split(",") if s] for i in planted}
    assert all(got[i].n_added == len(added[i]) for i in planted)
    right = sum(added[i] == [planted[i]] for i in planted if planted[i])
    wrong = sum(bool(added[i]) for i in planted if not planted[i])
    assert right / sum(map(bool, planted.values())) >= 0.95 and wrong / max(1, right + wrong) <= 0.05, (right, wrong)
    model = pii.fit(pii.vote_counts(pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert model.weights["vote context"] > 0.5  # the words before a span count


def test_columns_with_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.org", 7, "x", "y")], "doc_id long, text string, __pii_w int, __spans string, candidates string")
    out = pii.redact(df).first()
    assert out.asDict() == {"doc_id": 1, "text": "mail <EMAIL>", "__pii_w": 7, "__spans": "x", "candidates": "y"}
    assert pii.candidates(df).first()["__pii_w"] == 7


def test_defined_cases(spark):
    word = "a" * 50_000
    digits = "1 " * 20_000
    rows = [(1, None), (2, ""), (3, word + "@" + "b.c" * 2000), (4, digits), (5, "+" + "1" * 30_000), (5, "x@y.z"), (5, "x@y.z")]
    df = spark.createDataFrame([(a, b, 1, "c") for a, b in rows], "doc_id long, text string, candidates int, c string")
    found = pii.candidates(df.select("doc_id", "text"))
    out = pii.digest(found, pii.fit(pii.vote_counts(found))).collect()
    assert len(out) == 7
    for r in out:
        texts = [t for i, t in rows if i == r.doc_id]
        assert r.base_sha256 in {digest(brute(t)) for t in texts}
    empty = pii.candidates(df.select("doc_id", "text").limit(0))
    assert pii.digest(empty, pii.fit(pii.vote_counts(empty))).count() == 0


def test_redaction(spark):
    rows = [(1, "mail bob@x.org now", "en"), (2, None, "en"), (3, "nothing", "c"), (4, "ip 10.0.0.1, 4111111111111111", "d")]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["mail <EMAIL> now", None, "nothing", "ip <IP>, <CARD>"]
    assert out[0].asDict().keys() == {"doc_id", "text", "lang"}
