"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from the base patterns and from looser ones: mail addresses
written out, phone numbers without a country, national ids, and long strings of
letters and digits that may be secrets. Five labelers vote +1, 0 (abstain) or -1 on
each: the base rule, a checksum or range check, a gazetteer, the words before the
span, and the shape. The votes are counted by pattern, a table whose size is bounded
by the number of vote patterns and not by the data; expectation-maximisation over
those counts estimates what each labeler is worth, and its posteriors train a
logistic span classifier, which becomes a column expression. Spans of the base
rules always stay; a further candidate is added if the classifier gives it
``ACCEPT`` or more.

Positions come without a Python step: matches are wrapped in a marker, the text
is split at it, and the lengths of the parts add up to offsets in code points. A
pattern is only tried on texts that have what it needs, such as an @ or digits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "national_id", "secret")
BASE = KINDS[:4]
VOTES = ("rule", "check", "gazetteer", "context", "shape")
ACCEPT = 0.9
STRENGTH = 20.0
MARK = "\ue000"

# Possessive and anchored forms of the base patterns: the same matches, with no
# backtracking over long runs and no recursion in the JVM's matcher.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z]{2,24}",
    "phone": r"(?<![0-9+().-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+",
}
# What a text must have before a pattern is tried on it.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "loose email": r"at[\])]",
    "loose phone": r"[0-9]{3}[-.\x20)]\x20?[0-9]{3}[-.\x20][0-9]{4}",
    "loose national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "loose secret": r"[0-9]",
}
# Common top-level domains, card issuer prefixes, words before personal data.
TOP_LEVEL = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|nl|eu|us|ca|au|ch|at|be|se|pl|br|in|jp|cn|ru"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|30)"
CONTEXT = {
    "email": r"(e-?mail|contact|correo|courriel|write to|@)",
    "ip": r"(\bip\b|address|server|host|login)",
    "card": r"(card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment)",
    "phone": r"(phone|tel|call|mobile|cell|fax|contact|whatsapp|telefon|appel)",
    "national_id": r"(ssn|social security|tax id|national id|passport)",
    "secret": r"(token|secret|passw|pwd|api.?key|access.?key|private.?key|bearer|auth|credential)",
}
KEY_PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk-|sk_live_|eyJ|AIza|ya29)"
AGAINST = r"(version|isbn|issn|order no|invoice|serial|model|doi|figure|chapter|©)\W*$"
PUBLIC = r"(commit|revision|checksum|digest|sha-?[0-9]*|md5|uuid|href|src|url|https?:)\W*$"  # not secret though they look so


def _luhn(digits: str) -> str:
    return (
        f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr({digits}, -i, 1)) "
        f"WHEN int(substr({digits}, -i, 1)) > 4 THEN 2 * int(substr({digits}, -i, 1)) - 9 "
        f"ELSE 2 * int(substr({digits}, -i, 1)) END) % 10 = 0"
    )


def _parts(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)


def _spans(parts: str) -> str:
    """Parts of a marked text -> array of (start, s)."""
    return (
        f"CASE WHEN {parts} IS NULL OR size({parts}) < 3 THEN CAST(array() AS array<struct<start:int,s:string>>) ELSE "
        f"transform(sequence(1, size({parts}) - 2, 2), i -> struct("
        f"aggregate(slice({parts}, 1, i), 0, (a, p) -> a + length(p)) AS start, {parts}[i] AS s)) END"
    )


def _rule(kind: str) -> str:
    d = "regexp_replace(x.s, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return f"x.s RLIKE '^{part}([.]{part}){{3}}$'"
    if kind == "card":
        return f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN {_luhn(d)} ELSE false END"
    return f"length({d}) BETWEEN 9 AND 15"


def _votes(kind: str, rule: str) -> str:
    d = "regexp_replace(x.s, '[^0-9]', '')"
    before = "lower(substr(w, greatest(x.start - 40, 0) + 1, x.start - greatest(x.start - 40, 0)))"
    # to be well-formed proves little of what the looser patterns find
    fine = 0 if rule == "0" else 1
    check = {
        "email": f"CASE WHEN x.s RLIKE '[.]{{2}}|^[.]|[.]@|@-' THEN -1 ELSE {fine} END",
        "ip": f"CASE WHEN NOT ({_rule('ip')}) OR x.s RLIKE '(^|[.])0[0-9]|^0[.]' THEN -1 ELSE 1 END",
        "card": f"CASE WHEN length({d}) BETWEEN 12 AND 19 AND ({_luhn(d)}) THEN 1 ELSE -1 END",
        "phone": f"CASE WHEN length({d}) BETWEEN 9 AND 15 THEN {fine} ELSE -1 END",
        "national_id": "CASE WHEN x.s RLIKE '^(000|666|9)|-00-|-0000$' THEN -1 ELSE 1 END",
        "secret": "CASE WHEN x.s RLIKE '[A-Za-z]' THEN 0 ELSE -1 END",
    }[kind]
    gazetteer = {
        "email": f"CASE WHEN lower(x.s) RLIKE '[.\\\\])]\\\\s?({TOP_LEVEL})$' THEN 1 ELSE 0 END",
        "ip": "CASE WHEN x.s RLIKE '^(10|127|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]' THEN 0 ELSE 1 END",
        "card": f"CASE WHEN {d} RLIKE '{ISSUERS}' THEN 1 ELSE -1 END",
        "phone": f"CASE WHEN substr({d}, -10) RLIKE '^[2-9]' THEN 1 ELSE -1 END",
        "national_id": "0",
        "secret": f"CASE WHEN x.s RLIKE '{KEY_PREFIXES}' THEN 1 ELSE 0 END",
    }[kind]
    shape = {
        "email": "CASE WHEN length(x.s) <= 80 THEN 1 ELSE -1 END",
        "ip": "CASE WHEN substr(w, x.start + length(x.s) + 1, 2) RLIKE '^[.][0-9]' THEN -1 ELSE 1 END",
        "card": "CASE WHEN x.s RLIKE '^([0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\\\\2[0-9]{4}\\\\2[0-9]{4})$' THEN 1 ELSE -1 END",
        "phone": "CASE WHEN x.s RLIKE '[0-9]{3}[ .)-]+[0-9]{3}[ .-][0-9]{4}$' THEN 1 ELSE 0 END",
        "national_id": "0",
        "secret": "CASE WHEN length(x.s) > 200 OR x.s RLIKE '[A-Za-z]{4,}[-_/][A-Za-z]{3,}' THEN -1 WHEN x.s RLIKE '^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$' THEN 1 ELSE 0 END",
    }[kind]
    against = PUBLIC if kind == "secret" else AGAINST
    context = f"CASE WHEN {before} RLIKE r'{against}' THEN -1 WHEN {before} RLIKE r'{CONTEXT[kind]}' THEN 1 ELSE 0 END"
    return (
        f"struct({rule} AS rule, {check} AS check, {gazetteer} AS gazetteer, {context} AS context, {shape} AS shape, "
        "CAST(least(length(x.s) DIV 4, 8) AS int) AS size)"
    )


def candidates(docs: DataFrame, text_col: str = "text", to: str = "candidates") -> DataFrame:
    """``docs`` with an array of candidate spans: (start, kind number, end, kind,
    base, votes). base is true where a base rule accepts the span; a looser
    candidate that overlaps an accepted one, or fails the base rule of its kind
    in a way no labeler could mend (too few digits for a card), is left out.

    Null and empty texts have none; very long texts are searched whole; repeated
    rows stay and have the same spans; an empty table stays empty. A column named
    ``to`` is replaced, all others stay whatever their names."""
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    clean = F.when(raw.contains(MARK), F.translate(raw, MARK, "\ufffd")).otherwise(raw)
    tag = "__pii_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    out = docs.withColumn(f"{tag}w", clean)
    w = F.col(f"{tag}w")
    every = {f"b_{k}": (k, p) for k, p in PATTERNS.items()} | {f"l_{k}": (f"loose {k}", p) for k, p in LOOSE.items()}
    marked = {f"{tag}{c}": F.when(w.contains("@") if need == "email" else w.rlike(NEEDS[need]), _parts(w, p)) for c, (need, p) in every.items()}
    out = out.withColumns(marked)
    out = out.withColumns({c: F.expr(_spans(c)) for c in marked})

    def listed(column: str, kind: str, rule: str, base: str) -> str:
        body = _votes(kind, rule).replace("(w,", f"({tag}w,")
        n = KINDS.index(kind)
        worth = {"card": 12, "phone": 7}.get(kind, 0)
        some = f"filter({column}, x -> length(regexp_replace(x.s, '[^0-9]', '')) >= {worth})" if worth else column
        return f"transform({some}, x -> struct(x.start AS start, {n} AS k, x.start + length(x.s) AS end, '{kind}' AS kind, {base} AS base, {body} AS votes))"

    based = ", ".join(listed(f"{tag}b_{k}", k, f"CASE WHEN {_rule(k)} THEN 1 ELSE -1 END", _rule(k)) for k in BASE)
    loose = ", ".join(listed(f"{tag}l_{k}", k, "0", "false") for k in LOOSE)
    out = out.withColumn(f"{tag}base", F.expr(f"concat({based})"))
    out = out.withColumn(
        f"{tag}more", F.expr(f"filter(concat({loose}), c -> NOT exists({tag}base, b -> b.base AND b.start < c.end AND c.start < b.end))")
    )
    out = out.withColumn(to, F.expr(f"sort_array(concat({tag}base, {tag}more))"))
    return out.drop(f"{tag}w", f"{tag}base", f"{tag}more", *marked)


@dataclass
class SpanModel:
    """Reliabilities from EM and the classifier trained on its posteriors."""

    prior: dict[str, float] = field(default_factory=dict)
    emission: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, c: str) -> str:
        """SQL of the probability that candidate ``c`` is personal data."""
        terms = [f"({self.weights.get('bias', 0.0)!r}D)"]
        for k in KINDS:
            terms.append(f"CASE WHEN {c}.kind = '{k}' THEN {self.weights.get('kind ' + k, 0.0)!r}D ELSE 0D END")
        for v in VOTES:
            terms.append(f"{self.weights.get('vote ' + v, 0.0)!r}D * {c}.votes.{v}")
        terms.append(f"{self.weights.get('size', 0.0)!r}D * {c}.votes.size")
        return f"1D / (1D + exp(-({' + '.join(terms)})))"


def vote_counts(found: DataFrame, column: str = "candidates") -> DataFrame:
    """Candidates by kind and vote pattern: at most 6 * 3^5 * 9 rows."""
    one = found.select(F.explode(column).alias("c"))
    return one.groupBy("c.kind", *[F.col(f"c.votes.{v}").alias(v) for v in VOTES], F.col("c.votes.size").alias("size")).count()


def fit(counts: DataFrame, rounds: int = 50) -> SpanModel:
    """EM over vote patterns (Dawid and Skene, 1979), then logistic regression on
    the posteriors by Newton steps. Whether a labeler abstains tells nothing; of its
    votes, what is assumed at first counts as much as ``STRENGTH`` candidates and
    half the data, so a labeler is never taken for the opposite of what it says, and
    a kind's prior is held by a quarter of its data to each side. No candidates: the
    prior model."""
    rows = sorted(tuple(r) for r in counts.collect())  # bounded by the number of vote patterns
    weak = {1: (0.9, 0.15), -1: (0.1, 0.85)}  # of votes on personal data, and on other spans
    emission = {v: dict(weak) for v in VOTES}
    prior = dict.fromkeys(KINDS, 0.5)
    strength = STRENGTH + sum(float(r[7]) for r in rows) / 2
    kinds, votes, sizes, n = ([r[0] for r in rows], [r[1:6] for r in rows], [r[6] for r in rows], [float(r[7]) for r in rows])
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for kind, v in zip(kinds, votes, strict=True):
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(emission[name][x][0] / emission[name][x][1]) for name, x in zip(VOTES, v, strict=True) if x)
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for kind in KINDS:
            of = [(p, m) for k, p, m in zip(kinds, post, n, strict=True) if k == kind]
            some = 1 + sum(m for _, m in of) / 4
            prior[kind] = (sum(p * m for p, m in of) + some) / (sum(m for _, m in of) + 2 * some)
        for i, name in enumerate(VOTES):
            up = {x: strength * weak[x][0] for x in weak}
            down = {x: strength * weak[x][1] for x in weak}
            for v, p, m in zip(votes, post, n, strict=True):
                if v[i]:
                    up[v[i]] += p * m
                    down[v[i]] += (1 - p) * m
            emission[name] = {x: (up[x] / sum(up.values()), down[x] / sum(down.values())) for x in weak}
    names = ["bias", *(f"kind {k}" for k in KINDS), *(f"vote {v}" for v in VOTES), "size"]
    if not rows:
        return SpanModel(prior, emission, {"bias": -4.0, **{f"vote {v}": 2.0 for v in VOTES}})
    x = np.array([[1.0, *(float(k == a) for a in KINDS), *map(float, v), float(s)] for k, v, s in zip(kinds, votes, sizes, strict=True)])
    y, m = np.array(post), np.array(n)
    m = m / m.sum() * min(m.sum(), 10_000.0)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (m * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (m * (y - p)) - w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return SpanModel(prior, emission, {a: float(b) for a, b in zip(names, w, strict=True)})


def accepted(model: SpanModel, column: str = "candidates") -> Column:
    """The spans that stay: base ones and what the classifier adds."""
    return F.expr(f"filter({column}, c -> c.base OR {model.probability('c')} >= {ACCEPT}D)")


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')"


def digest(found: DataFrame, model: SpanModel) -> DataFrame:
    """Per row of ``found`` (doc_id, candidates): counts of the base kinds, a hash of
    the base spans, all spans as text, and how many of them the classifier added.
    Repeated rows stay; no candidates give zeros and empty text; no rows give none;
    other columns are not read."""
    out = found.withColumn("__all", accepted(model)).withColumn("__base", F.expr("filter(candidates, c -> c.base)"))
    return out.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(__base, c -> c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(_joined("__base")), 256).alias("base_sha256"),
        F.expr(_joined("__all")).alias("spans"),
        (F.size("__all") - F.size("__base")).cast("long").alias("n_added"),
    )


def masked(text: str, spans: str) -> str:
    """SQL of the text with each span replaced by <KIND>; where spans overlap, the
    first one's name stands for both."""
    step = (
        "(a, c) -> CASE WHEN c.end <= a.at THEN a "
        f"WHEN c.start < a.at THEN struct(a.out AS out, c.end AS at) "
        f"ELSE struct(concat(a.out, substr({text}, a.at + 1, c.start - a.at), '<', upper(c.kind), '>') AS out, c.end AS at) END"
    )
    return f"aggregate({spans}, struct('' AS out, 0 AS at), {step}, a -> concat(a.out, substr({text}, a.at + 1)))"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` masked and the columns as they
    were; n_chars, if present, follows the new text. Null text stays null, text
    without spans is unchanged, repeated rows stay, no rows give none. The model is
    fitted on all of ``docs`` first: a second search costs less than to store what
    the first one found beside the texts."""
    name = "__spans"
    while name in docs.columns:
        name += "_"
    model = fit(vote_counts(candidates(docs.select(F.col(f"`{text_col}`")), text_col, name), name))
    found = candidates(docs, text_col, name).withColumn(name, accepted(model, name))
    new = F.when(F.size(name) > 0, F.expr(masked(f"`{text_col}`", name))).otherwise(F.col(f"`{text_col}`"))
    out = found.withColumn(text_col, new).drop(name)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
