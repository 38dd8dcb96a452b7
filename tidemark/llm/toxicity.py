"""Toxic passages as maximum-scoring segments.

Every token has a log-odds score: how much likelier it is in toxic text than in
other text, estimated under Dirichlet priors in a hierarchy. The prior of a word
is centred on the rate of its six-letter beginning, that on five letters, and so
on down to the rate of all tokens, so a rare or unseen form of a known root is
scored by the root. Counts are of documents with the word. Scores less a drift are
negative on average in clean text; the linear-time scan of Ruzzo and Tompa (1999)
then finds every maximal-scoring segment. Karlin and Altschul's extreme-value law
turns a segment's score S in n tokens into an expected number K n exp(-lambda S)
of such segments in clean text: lambda solves E[exp(lambda x)] = 1 for the token
scores of clean text, K is the maximum-likelihood value for the best segments of
clean training documents. A document's evidence, its best and its summed
significant segments in these units, becomes a score from 0 to 1 by logistic
regression. Only there are repeats damped: a token adds to a significant segment's
evidence three times at most. Every segment is found, wherever its words stood
before; a running minimum of the sums tells first whether a text has a significant
one at all.

Words are known by 64-bit hashes, taken for many texts at once, from the count to
the scan. Fitting uses at most ``max_labelled`` labelled rows, the ones with the
smallest hash; scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import join_unique
from tidemark.llm.batches import sliced
from tidemark.llm.hashing import Sums, edges, numbers, pieces
from tidemark.llm.scratch import Scratch

PREFIXES = (3, 4, 5, 6)
SIGNIFICANT = 0.05
BINS = 0.05
REPEATS = 3
HELD = 400_000  # word counts that a counting task holds before it gives them out
_PREFIX = np.uint64(0xA0761D6478BD642F)  # tells a beginning from the word of the same letters


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: is it blank, is it alphanumeric, its random number."""
    every = list(map(chr, range(0x110000)))
    blank, alnum = (np.fromiter(map(f, every), bool, len(every)) for f in (str.isspace, str.isalnum))
    return blank, alnum, numbers(len(every))


class Tokens:
    """The blank-separated tokens of lower-cased texts: ``counts`` by text, a hash of
    each; and their words, the alphanumeric runs: ``owner`` (the token), hash,
    length, and ``prefix(n)``."""

    def __init__(self, texts: list[str]):
        blank, alnum, number = _characters()
        codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = edges(~blank[codes])
        self.begin, self.end = edges(alnum[codes])
        self.sums = Sums(number[codes])
        self.hashes = self.sums.of(starts, ends)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(starts, offsets))
        self.owner = np.searchsorted(starts, self.begin, "right") - 1
        self.length = self.end - self.begin
        self.words = self.sums.of(self.begin, self.end)

    def prefix(self, n: int, some: np.ndarray) -> np.ndarray:
        """Hashes of the first ``n`` letters of some words that are as long or longer."""
        return self.sums.of(self.begin[some], self.begin[some] + n) ^ _PREFIX


def hash_of(unit: str) -> int:
    """The hash of a word, or of ``^`` and a beginning."""
    bare = unit.removeprefix("^")
    t = Tokens([bare])
    h = t.sums.of(np.array([0]), np.array([len(bare)]))[0]
    return int((h ^ _PREFIX if unit.startswith("^") else h).view(np.int64))


class Units:
    """Hash of a word or beginning -> log-odds: sorted hashes beside their log-odds,
    and a bit table, most of it clear, that tells most others at once. 16 to 20
    bytes a unit."""

    def __init__(self, hashes: np.ndarray | None = None, odds: np.ndarray | None = None):
        hashes = np.zeros(0, np.uint64) if hashes is None else np.asarray(hashes, np.int64).view(np.uint64)
        odds = np.zeros(0, np.float32) if odds is None else odds
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.odds = hashes[order], odds[order].astype(np.float32)
        self.mask = np.uint64((1 << max(10, (32 * len(hashes)).bit_length())) - 1)
        flags = np.zeros(int(self.mask) + 1, bool)
        flags[(hashes & self.mask).astype(np.int64)] = True
        self.bits = np.packbits(flags, bitorder="little")

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are units, and their log-odds."""
        slot = (h & self.mask).astype(np.int64)
        maybe = np.flatnonzero(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
        at = np.minimum(self.hashes.searchsorted(h[maybe]), max(0, len(self) - 1))
        hit = self.hashes[at] == h[maybe] if len(self) else np.zeros(0, bool)
        return maybe[hit], self.odds[at[hit]]

    def get(self, unit: str) -> float | None:
        found, odds = self.find(np.array([hash_of(unit)], np.int64).view(np.uint64))
        return float(odds[0]) if len(found) else None


@dataclass
class Model:
    units: Units = field(default_factory=Units)
    drift: float = 0.3
    decay: float = 1.0  # lambda
    scale: float = 0.1  # K
    weights: tuple[float, float, float] = (-2.0, 1.0, 0.5)

    def scores(self, tokens: Tokens) -> np.ndarray:
        """Of each token the greatest score of its words, less the drift: that of the
        word, or else of its longest known beginning, or else 0."""
        words = np.zeros(len(tokens.words))
        found, odds = self.units.find(tokens.words)
        words[found] = odds
        left = np.ones(len(words), bool)
        left[found] = False
        for n in PREFIXES[::-1]:
            some = np.flatnonzero(left & (tokens.length >= n))
            found, odds = self.units.find(tokens.prefix(n, some))
            words[some[found]] = odds
            left[some[found]] = False
        out = np.zeros(len(tokens.hashes))
        if len(words):
            first = np.flatnonzero(np.concatenate(([True], tokens.owner[1:] != tokens.owner[:-1])))
            out[tokens.owner[first]] = np.maximum.reduceat(words, first)
        return out - self.drift

    def score(self, best: float, total: float) -> float:
        a, b, c = self.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * best + c * total))))


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of ``x``, left to right."""
    up = np.concatenate(([False], x > 0, [False]))
    edges = np.flatnonzero(up[1:] != up[:-1])
    if not len(edges):
        return []
    sums = np.concatenate(([0.0], np.cumsum(x)))
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum behind, last one that begins lower
    for s, e, low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), sums[edges[::2]].tolist(), sums[edges[1::2]].tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((s, e, low, high, j))
                break
            s, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, high - low) for s, e, low, high, _ in found]


def best_score(x: np.ndarray) -> float:
    """The score of the best segment, 0 where no token scores above 0."""
    if not len(x):
        return 0.0
    sums = np.concatenate(([0.0], np.cumsum(x)))
    return max(0.0, float((sums[1:] - np.minimum.accumulate(sums[:-1])).max()))


def damped(tokens: np.ndarray, x: np.ndarray, v: float) -> float:
    """The score ``v`` of a segment less the share of its positive scores that are
    repeats of a token past the third: the same wherever in it the repeats stand."""
    up = x > 0
    _, first, counts = np.unique(tokens[up], return_index=True, return_counts=True)
    y = x[up][first]
    return v * float((y * np.minimum(counts, REPEATS)).sum() / (y * counts).sum())


class Scanner:
    """The scan of texts by a model."""

    def __init__(self, model: Model):
        self.model = model

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the hashes of its tokens and their scores."""
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
        for part in pieces([(t or "").lower() for t in texts], " \n"):
            t = Tokens([p for _, p in part])
            x = self.model.scores(t)
            cuts = np.cumsum(t.counts)[:-1]
            for (i, _), h, y in zip(part, np.split(t.hashes, cuts), np.split(x, cuts), strict=True):
                found[i].append((h, y))
        return [f[0] if len(f) == 1 else tuple(map(np.concatenate, zip(*f, strict=True))) for f in found]

    def evidence(self, tokens: np.ndarray, x: np.ndarray) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The best segment score, and the significant segments as (first token,
        behind the last token, -ln of the expected number, the same with repeats
        damped)."""
        best, m = best_score(x), self.model
        if best <= 0:
            return 0.0, []
        shift, least = math.log(m.scale * len(x)), -math.log(SIGNIFICANT)
        if m.decay * best - shift < least:
            return best, []
        seen = [(s, e, v) for s, e, v in segments(x) if m.decay * v - shift >= least]
        return best, [(s, e, m.decay * v - shift, m.decay * damped(tokens[s:e], x[s:e], v) - shift) for s, e, v in seen]

    def features(self, n: int, best: float, seen: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """Of the best segment, the significant ones with repeats damped, and of
        their sum."""
        top = max(r[3] for r in seen) if seen else self.model.decay * best - math.log(self.model.scale * n) if n and best > 0 else -10.0
        return max(-10.0, min(30.0, top)), math.log1p(sum(max(0.0, r[3]) for r in seen))


def training(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that may be learned from: those
    with crc32 of the doc_id as text mod 3 other than 1, at most ``max_labelled`` of
    them. Their ids as text are what is broadcast. Of several labels of an id the
    greatest counts; rows of ``docs`` that share an id all count."""
    name = F.col("doc_id").cast("string")
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(name.cast("binary")) % 3 != 1)
        .groupBy(name.alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    return docs.select(name.alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")


_COUNTS = "h long, " + ", ".join(f"p{n} long" for n in PREFIXES) + ", t long, n long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and of their beginnings, with the numbers of toxic and other
    documents that have the word."""
    names = ["h", *(f"p{n}" for n in PREFIXES), "t", "n"]

    def out(held: list) -> pa.RecordBatch:
        words, lengths, toxic, *beginnings = map(np.concatenate, zip(*held, strict=True))
        _, first, group = np.unique(words, return_index=True, return_inverse=True)
        t = np.bincount(group, toxic, len(first)).astype(np.int64)
        cols = [pa.array(words[first].view(np.int64))]
        for n, p in zip(PREFIXES, beginnings, strict=True):
            cols.append(pa.array(p[first].view(np.int64), mask=lengths[first] < n))
        return pa.record_batch([*cols, pa.array(t), pa.array(np.bincount(group, minlength=len(first)) - t)], names)

    held, size = [], 0
    for b in sliced(batches):
        texts, toxic = [(t or "").lower() for t in b.column(0).to_pylist()], b.column(1).to_numpy()
        parts = []
        for part in pieces(texts, " \n"):
            t = Tokens([p for _, p in part])
            doc = np.array([i for i, _ in part])[np.searchsorted(np.cumsum(t.counts), t.owner, "right")]
            some = _distinct(doc, t.words)
            p = []
            for n in PREFIXES:
                long = np.flatnonzero(t.length[some] >= n)
                h = np.zeros(len(some), np.uint64)
                h[long] = t.prefix(n, some[long])
                p.append(h)
            parts.append((doc[some], t.words[some], t.length[some], *p))
        if not parts:
            continue
        doc, words, *rest = map(np.concatenate, zip(*parts, strict=True))
        some = _distinct(doc, words) if len(parts) > 1 else np.arange(len(doc))  # a long document comes in several parts
        held.append((words[some], rest[0][some], (toxic[doc[some]] == 1).astype(float), *[r[some] for r in rest[1:]]))
        size += len(some)
        if size > HELD:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _distinct(doc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where a document has a word for the first time."""
    order = np.lexsort((words, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (words[order][1:] != words[order][:-1])
    return order[new]


def _units(counts: DataFrame, strength: float, least: int, step: float, drift: float, scratch: Scratch) -> tuple[Units, list]:
    """Word counts -> the units that change a score, and a histogram of the scores
    of clean tokens. A unit whose score is within ``step`` of what its beginning
    gives is left out; all others stay, which the labelled rows bound.

    Beginnings are summed up by length and each length takes its prior from the one
    before: a parent has as many children as letters that can follow. Only words
    can be many to a beginning; the frequent ones meet it by broadcast."""
    total = counts.agg(F.sum("t"), F.sum("n"), F.count("*")).first()
    all_t, all_n = float(total[0] or 0) + 1, float(total[1] or 0) + 1
    root = all_t / (all_t + all_n)

    def rate(up):
        return (F.col("t") + strength * up) / (F.col("t") + F.col("n") + strength)

    levels = None
    for i, n in enumerate(PREFIXES):
        up = F.first(f"p{PREFIXES[i - 1]}") if i else F.lit(0).cast("long")
        own = counts.where(f"p{n} is not null").groupBy(F.col(f"p{n}").alias("h")).agg(up.alias("parent"), F.sum("t").alias("t"), F.sum("n").alias("n"))
        if i:
            own = own.join(last.select(F.col("h").alias("parent"), F.col("rate").alias("up")), "parent")  # noqa: F821
        else:
            own = own.withColumn("up", F.lit(root))
        last = scratch.stage(own.select("h", "t", "n", "up", rate(F.col("up")).alias("rate")), f"level{n}")
        levels = last if levels is None else levels.unionAll(last)
    deepest = F.coalesce(*[f"p{n}" for n in PREFIXES[::-1]])
    words = counts.select("h", "t", "n", deepest.alias("parent"))
    kids = words.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"))
    parents = levels.select(F.col("h").alias("parent"), F.col("rate").alias("up")).join(kids, "parent")
    above = join_unique(words.where("parent is not null"), scratch.stage(parents, "parents"), "parent", int(total[2]), "kids").select("h", "t", "n", "up")
    words = above.unionAll(words.where("parent is null").select("h", "t", "n", F.lit(root).alias("up"))).withColumn("rate", rate(F.col("up")))
    words = scratch.stage(words, "rated")
    odds = math.log(root / (1 - root))
    score = lambda r: F.log(F.col(r) / (1 - F.col(r))) - odds
    units = levels.unionAll(words.select("h", "t", "n", "up", "rate"))
    kept = units.where((F.col("t") + F.col("n") >= least) & (F.abs(score("rate") - score("up")) >= step))
    spread = words.groupBy(F.round(score("rate") / BINS).cast("int").alias("b")).agg(F.sum("n").alias("n")).orderBy("b").collect()  # bounded: one row a bin
    chosen = kept.select("h", score("rate").cast("float").alias("s")).toArrow()  # bounded: 12 bytes a unit of the labelled rows
    return Units(chosen["h"].to_numpy(), chosen["s"].to_numpy()), [(r.b * BINS - drift, float(r.n)) for r in spread if r.n]


def _lambda(spread: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(lambda x)] = 1; 3 where clean text has no
    positive score to bound it."""
    total = sum(n for _, n in spread)
    if not total:
        return 1.0

    def excess(v: float) -> float:
        return math.log(sum(n * math.exp(min(700.0, v * x)) for x, n in spread) / total)

    low, high = 1e-3, 3.0
    if excess(high) <= 0:
        return high
    if excess(low) >= 0:
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _scan(model, with_features: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.value)
        for b in sliced(batches):
            rows = []
            for tokens, x in scan.tokens(b.column(0).to_pylist()):
                best, seen = scan.evidence(tokens, x) if with_features else (best_score(x), [])
                rows.append((len(x), best, *scan.features(len(x), best, seen)))
            n, *cols = zip(*rows, strict=True)
            yield pa.record_batch([b.column(1).cast(pa.int32()), pa.array(n, pa.int64()), *[pa.array(c, pa.float64()) for c in cols]], ["toxic", "n", "best", "top", "sum"])

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 200_000,
    strength: float = 5.0,
    least: int = 3,
    step: float = 0.25,
    drift: float = 0.3,
) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ids may be
    of any type that casts to text, other columns are not read. Null ids, ids
    without a label and null labels teach nothing; null texts have no tokens; empty
    tables, or labelled rows of one kind only, give the neutral start model. Ties in
    the order of hashes are broken by id, so reruns agree."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = scratch.stage(training(docs, labels, max_labelled).select("text", "toxic"), "training")
    beginnings = [F.first(f"p{n}", True).alias(f"p{n}") for n in PREFIXES]  # a word has one of each length
    counts = scratch.stage(rows.mapInArrow(_counts, _COUNTS).groupBy("h").agg(*beginnings, F.sum("t").alias("t"), F.sum("n").alias("n")), "words")
    model = Model(drift=drift)
    kinds = {r.toxic for r in rows.select("toxic").distinct().collect()}
    if kinds != {0, 1}:
        return model
    model.units, spread = _units(counts, strength, least, step, drift, scratch)
    model.decay = _lambda(spread)
    schema = "toxic int, n long, best double, top double, sum double"
    shared = spark.sparkContext.broadcast(model)
    seen = rows.mapInArrow(_scan(shared, False), schema)
    mean = seen.where("toxic = 0 and n > 0").agg(F.avg(F.col("n") * F.exp(-model.decay * F.col("best")))).first()[0]
    shared.destroy()  # its only result is in hand
    model.scale = 1 / max(float(mean or 1.0), 1e-9)
    shared = spark.sparkContext.broadcast(model)
    seen = rows.mapInArrow(_scan(shared, True), schema)
    table = seen.groupBy(F.round(F.col("top") * 4).alias("a"), F.round(F.col("sum") * 4).alias("b"), "toxic").count().orderBy("a", "b", "toxic")
    model.weights = _logistic([(r.a / 4, r.b / 4, r.toxic, r["count"]) for r in table.collect()])  # bounded: one row a cell of the grid
    shared.destroy()
    scratch.drop(*scratch.paths)
    return model


def _logistic(cells: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    x = np.array([[1.0, a, b] for a, b, _, _ in cells])
    y, n = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], float)
    w, ridge = np.zeros(3), np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _places(text: str, seen: list[tuple[int, int, float, float]]) -> list[dict]:
    """Token segments as character spans."""
    at, out = list(_tokens(text)), []
    for s, e, v, _ in seen:
        out.append({"start": at[s][0], "end": at[e - 1][1], "strength": v})
    return out


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    i = 0
    for raw in text.split():
        i = text.index(raw, i)
        yield i, i + len(raw)
        i += len(raw)


_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strength", pa.float64())]))


def _scored(model, names: tuple[str, str], kept: int, at: int):
    """Appends score and passages of the texts in column ``at`` to the first ``kept`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(model.value)
        for b in sliced(batches):
            scores, found = [], []
            texts = b.column(at).to_pylist()
            for text, (tokens, x) in zip(texts, scan.tokens(texts), strict=True):
                best, seen = scan.evidence(tokens, x)
                scores.append(scan.model.score(*scan.features(len(x), best, seen)))
                found.append(_places(text, seen) if seen else [])
            yield pa.record_batch([*b.columns[:kept], pa.array(scores, pa.float64()), pa.array(found, _PASSAGES)], [*b.schema.names[:kept], *names])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """``keep`` columns of every row of ``docs``, its score and its significant
    passages (start, end, strength) in characters, under ``names``; ``keep`` may
    not have these names, other columns are not read. Null, empty and blank texts
    have no tokens, the lowest score and no passages; equal texts, long or short,
    score alike; repeated rows stay; no rows give no rows."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    sent, at = [F.col(f"`{c}`") for c in keep], len(keep)
    if "text" in keep and docs.schema["text"].dataType.simpleString() == "string":
        at = keep.index("text")  # sent once
    else:
        sent.append(F.col("text").cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*sent).mapInArrow(
        _scored(shared, names, len(keep), at), f"{fields}, {names[0]} double, {names[1]} array<struct<start:int,end:int,strength:double>>"
    )


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    scored = score(docs, fit(docs, labels), tuple(docs.columns), ("__score", "__passages"))
    return scored.where(F.col("__score") < threshold).select(*kept)
