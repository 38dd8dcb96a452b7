"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash is floor((a . x + b) / w) for a normal vector a (Datar et al., 2004); a
table's key is a tuple of them. A query visits its own bucket of each table and
then buckets next to it, in the order of the estimated chance that they hold near
neighbours: the slot borders of a query are ranked by distance, and sets of moves
over these ranks come in the order of their expected squared distance, which is
the same list for every query (Lv et al., 2007). The candidates of all tables are
merged and ranked by exact Euclidean distance in double precision.

Plan: the index is a table (key, vector id) of every distinct vector, the visits a
table (key, queries). They meet by a join on the key, buckets with very many
vectors dealt by salt; what is shuffled is ids. Candidates are grouped by vector,
meet the vector once, and each task keeps the nearest few of each query. So the
work follows the number of candidates, not vectors times queries.

Hashes, slot width and number of visits are chosen by the estimated number of
candidates at the wanted recall: true neighbours of ``SAMPLE_QUERIES`` vectors,
found by one exact scan, give the recall, ``SAMPLE`` vectors give the candidates.
If no setting reaches it, or a query finds fewer neighbours than asked for, the
exact scan decides, queries in blocks.

Equal vectors are indexed once, with their smallest ids, as many as an answer can
hold; the ids are picked with a limit in each task before the shuffle, so a vector
that very many rows share costs little.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.skew import hot_limit
from tidemark.llm.batches import sliced
from tidemark.llm.scratch import Scratch

SAMPLE = 1_000  # vectors whose share in a query's candidates is estimated
SAMPLE_QUERIES = 48
VISITS = 512  # most visits of a table that are considered
SETTINGS = ((14, 3.0), (10, 2.0), (8, 1.5), (6, 1.0), (3, 3.0))  # hashes, slot width in distances of a true neighbour
BLOCK = 1024  # queries of an exact scan
QUERY_BYTES = 32 << 20  # of query vectors that may be broadcast; more are joined
BUCKET = 4_096  # vectors of a bucket that one task takes
PAIRS = 1 << 15  # distances computed at a time


@dataclass
class Index:
    """Hash functions for ``tables`` tables of ``hashes`` hashes. A key is a sum of
    slots times odd numbers, mixed, so the key of a neighbouring bucket is the sum
    and a few of these numbers."""

    planes: np.ndarray  # tables x hashes x dims
    shifts: np.ndarray  # tables x hashes, in slots
    width: float
    factors: np.ndarray  # tables x hashes

    @classmethod
    def make(cls, dims: int, width: float, tables: int, hashes: int, seed: int = 11) -> Index:
        r = np.random.default_rng(seed)
        planes, shifts = r.normal(size=(tables, hashes, dims)), r.random((tables, hashes))
        return cls(planes, shifts, max(width, 1e-300), r.integers(0, 1 << 63, (tables, hashes), dtype=np.uint64) * np.uint64(2) + np.uint64(1))

    def at(self, x: np.ndarray) -> np.ndarray:
        """Position in slots, rows x tables x hashes."""
        return np.tensordot(x, self.planes, (1, 2)) / self.width + self.shifts

    def mixed(self, sums: np.ndarray) -> np.ndarray:
        """Sums, tables along the second axis, to 64-bit keys that hold the table."""
        number = np.arange(1, sums.shape[1] + 1, dtype=np.uint64).reshape(-1, *[1] * (sums.ndim - 2))
        x = sums + number * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))).view(np.int64)

    def sums(self, slots: np.ndarray) -> np.ndarray:
        return (slots.astype(np.int64).view(np.uint64) * self.factors).sum(axis=2, dtype=np.uint64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows x tables: the bucket of each vector."""
        return self.mixed(self.sums(np.floor(self.at(x))))

    def visits(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Rows x tables x visits: the buckets that each vector visits, in order."""
        at = self.at(x)
        slots = np.floor(at)
        n, tables, hashes = slots.shape
        border = np.stack((at - slots, slots + 1 - at), axis=3).reshape(n, tables, 2 * hashes)  # move 2j goes down in hash j, 2j + 1 up
        order = np.argsort(border, axis=2, kind="stable")
        step = np.where(order % 2 == 1, np.uint64(1), ~np.uint64(0))
        moves = np.take_along_axis(np.broadcast_to(self.factors, slots.shape), order // 2, axis=2) * step
        moves = np.concatenate((moves, np.zeros((n, tables, 1), np.uint64)), axis=2)
        return self.mixed(self.sums(slots)[:, :, None] + moves[:, :, _padded(hashes, probes)].sum(axis=3, dtype=np.uint64))


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of moves as ranks 0 to 2 * ``hashes`` - 1 of the
    borders, nearest first, in the order of the expected sum of squared distances.
    Ranks r and 2 * ``hashes`` - 1 - r are the two borders of one hash, and no set
    holds both; the empty set comes first."""
    m = hashes
    scale = 4 * (m + 1) * (m + 2)
    cost = [j * (j + 1) / scale if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / scale for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - r in chosen for r in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


def _padded(hashes: int, probes: int) -> np.ndarray:
    sets = perturbations(hashes, probes)
    out = np.full((len(sets), max(1, max(map(len, sets)))), 2 * hashes)
    for i, s in enumerate(sets):
        out[i, : len(s)] = s
    return out


def first_visits(index: Index, queries: np.ndarray, points: np.ndarray, probes: int = VISITS) -> np.ndarray:
    """Queries x points: the first visit that reaches a point, ``probes`` if none does."""
    keys, visits = index.keys(points), index.visits(queries, probes)
    out = np.full((len(queries), len(points)), probes)
    for t in range(keys.shape[1]):
        order = np.argsort(keys[:, t], kind="stable")
        own, asked = keys[order, t], visits[:, t].ravel()
        low, high = np.searchsorted(own, asked, "left"), np.searchsorted(own, asked, "right")
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        at = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        q, p = np.divmod(np.repeat(hit, counts), visits.shape[2])
        np.minimum.at(out, (q, order[at]), p)
    return out


@dataclass
class Fitted:
    index: Index
    probes: int
    recall: float  # of the sample queries' true neighbours
    share: float  # of all vectors that a query meets


def fit(queries: np.ndarray, neighbours: np.ndarray, sample: np.ndarray, rows: int, tables: int, recall: float) -> Fitted | None:
    """The setting with the fewest candidates, of those that reach ``recall``; None
    if none does. ``neighbours`` has k true neighbours of each query, with its own
    number first: rows of (query, vector)."""
    if not len(neighbours) or not len(sample):
        return None
    owner, near = neighbours[:, 0].astype(int), neighbours[:, 1:]
    distance = float(np.median(np.sqrt(np.square(near - queries[owner]).sum(axis=1))))
    best, least = None, float("inf")
    for hashes, slots in SETTINGS:
        index = Index.make(queries.shape[1], slots * distance, tables, hashes)
        probes = len(perturbations(hashes, VISITS))
        seen = first_visits(index, queries, np.concatenate((near, sample)), probes)
        found = np.sort(seen[owner, np.arange(len(near))])
        last = int(found[int(np.ceil(recall * len(found))) - 1])
        if last >= probes:
            continue
        met = seen[:, len(near) :] <= last
        cost = met.mean() * rows + 0.2 * tables * (last + 1)
        if cost < least:
            best, least = Fitted(index, last + 1, float((found <= last).mean()), float(met.mean())), cost
    return best


class Nearest:
    """The ``most`` nearest vectors of each query, of those added so far."""

    def __init__(self, most: int):
        self.most = most
        self.q, self.r, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, q: np.ndarray, r: np.ndarray, d: np.ndarray) -> None:
        q, r, d = np.concatenate((self.q, q)), np.concatenate((self.r, r)), np.concatenate((self.d, d))
        order = np.lexsort((r, d, q))
        q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.most
        self.q, self.r, self.d = q[keep], r[order][keep], d[order][keep]

    def batch(self, ids: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.q if ids is None else ids[self.q]), pa.array(self.r), pa.array(self.d)], ["query", "rep", "score"])


_FOUND = "query long, rep long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - y).sum(axis=1))


def _scanned(block, most: int):
    """The nearest vectors of a task for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = block.value
        top = Nearest(most)
        for b in sliced(batches, max(1, PAIRS // max(1, len(ids)))):
            reps, x = b.column(0).to_numpy(), _matrix(b.column(1))
            q, r = np.divmod(np.arange(len(ids) * len(x)), len(x))
            top.add(q, reps[r], _distances(x[r], points[q]))
        if len(top.q):
            yield top.batch(ids)

    return run


def _keyed(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            keys = index.value.keys(_matrix(b.column(1)))
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), keys.shape[1]))], ["key", "rep"])

    return run


def _visiting(index, probes: int, places):
    """(key, q): q is the query's id, or its place in the ids that are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 32):
            q = b.column(0).to_numpy()
            q = np.searchsorted(places.value[0], q) if places else q
            keys = index.value.visits(_matrix(b.column(1)), probes)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(q.astype(np.int64), keys.shape[1] * keys.shape[2]))], ["key", "q"])

    return run


def _ranked(block, most: int):
    """Vectors with the places of the queries that meet them -> the nearest of each
    query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = block.value
        top = Nearest(most)
        for b in sliced(batches, 512):
            reps, x = b.column(0).to_numpy(), _matrix(b.column(1))
            counts = b.column(2).value_lengths().to_numpy()
            pairs = np.unique(np.repeat(np.arange(len(x)), counts) * len(ids) + b.column(2).flatten().to_numpy())
            held = []
            for i in range(0, len(pairs), PAIRS):
                r, q = np.divmod(pairs[i : i + PAIRS], len(ids))
                held.append((q, reps[r], _distances(x[r], points[q])))
            if held:
                top.add(*map(np.concatenate, zip(*held, strict=True)))
        if len(top.q):
            yield top.batch(ids)

    return run


def _paired(most: int):
    """(query, its vector, rep, its vector) -> the nearest of each query in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Nearest(most)
        for b in sliced(batches, 8192):
            top.add(b.column(0).to_numpy(), b.column(2).to_numpy(), _distances(_matrix(b.column(3)), _matrix(b.column(1))))
        if len(top.q):
            yield top.batch()

    return run


def _exact(points: DataFrame, queries: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(query, rep, score) of the nearest of all vectors in each task, for queries
    in blocks of about BLOCK, one block at a time at the driver."""
    spark = points.sparkSession
    out = spark.createDataFrame([], _FOUND)
    blocks = -(-queries.count() // BLOCK)
    for i in range(blocks):
        held = _block(queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i))
        if len(held[0]):
            shared = spark.sparkContext.broadcast(held)
            out = out.unionAll(scratch.stage(points.select("rep", "v").mapInArrow(_scanned(shared, most), _FOUND), f"exact{i}"))
            shared.destroy()
    return out


def _block(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = queries.select("query", "v").orderBy("query").toArrow().combine_chunks()
    if not len(rows):
        return np.empty(0, np.int64), np.empty((0, 0))
    return rows["query"].to_numpy(), _matrix(rows["v"].combine_chunks())


def _candidates(points: DataFrame, queries: DataFrame, fitted: Fitted, dims: int, most: int, query_bytes: int, scratch: Scratch) -> DataFrame:
    """(query, rep, score): each task's nearest among the vectors that lie in a
    bucket the query visits."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(fitted.index)
    small = queries.count() * (dims + 1) * 8 <= query_bytes
    block = spark.sparkContext.broadcast(_block(queries)) if small else None  # its size was just checked
    index = scratch.stage(points.select("rep", "v").mapInArrow(_keyed(shared), "key long, rep long"), "index")
    visits = queries.select("query", "v").mapInArrow(_visiting(shared, fitted.probes, block), "key long, q long")
    visits = visits.select("key", F.col("q").cast("int" if small else "long").alias("q")).groupBy("key").agg(F.collect_list("q").alias("qs"))
    limit = hot_limit(index.count(), BUCKET)
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)  # at most MOST_HOT rows
    salts = F.broadcast(sizes.select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("salts")))
    dealt = index.join(salts, "key", "left").select("key", "rep", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"), F.lit(0)).alias("salt"))
    visits = visits.join(salts, "key", "left").select("key", "qs", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    met = dealt.join(visits, ["key", "salt"]).groupBy("rep").agg(F.flatten(F.collect_list("qs")).alias("qs"))
    met = met.join(points.select("rep", "v"), "rep").select("rep", "v", "qs")
    if small:
        return met.mapInArrow(_ranked(block, most), _FOUND)
    pairs = met.select("rep", "v", F.explode(F.array_distinct("qs")).alias("query"))
    asked = queries.select("query", F.col("v").alias("own"))
    return pairs.join(asked, "query").select("query", "own", "rep", "v").mapInArrow(_paired(most), _FOUND)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    tables: int = 16,
    recall: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k``
    nearest found among ``vectors`` with another id, nearest first, ties to the
    smaller id; score is the Euclidean distance. Both tables have the id and vector
    columns; other columns are not read, whatever their names. ``recall`` is that
    of the sample queries on which the index is fitted. Query vectors of up to
    ``query_bytes`` are broadcast, more are joined by a shuffle.

    Defined cases: null, empty and all-zero vectors and vectors with null or
    non-finite components take no part, nor do rows with a null id; vectors of a
    length other than the most frequent one take no part; fewer rows than ``k``
    give all of them; rows that share an id count once, with the smaller vector;
    empty tables give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast("array<double>")
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        out = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(
            "id is not null and v is not null and size(v) > 0"
        )
        return out.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))

    rows = scratch.stage(clean(vectors), "rows")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = clean(queries).where(F.size("v") == sizes.n)
    rows = rows.where(F.size("v") == sizes.n)
    # distinct vectors: their smallest ids, one more than an answer holds, as a query leaves out itself
    by_vector = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("i", F.row_number().over(by_vector)).where(F.col("i") <= k + 1)
    points = scratch.stage(
        some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "v", "ids"), "points"
    )
    asked = scratch.stage(asked, "asked")
    distinct = scratch.stage(asked.groupBy("v").agg(F.min("id").alias("query")), "distinct")
    fitted = _fitted(points, sizes.n, k, tables, recall, scratch)
    order = Window.partitionBy("query").orderBy("score", "rep")

    def best(found: DataFrame, name: str) -> DataFrame:
        """The k + 1 nearest of each query, of what all tasks found, with their rows' ids."""
        top = found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).select("query", "rep", "score")
        return scratch.stage(top, name).join(points.select("rep", "ids"), "rep")

    if fitted:
        near = best(_candidates(points, distinct, fitted, sizes.n, k + 1, query_bytes, scratch), "found")
        enough = near.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k)
        few = scratch.stage(distinct.join(enough, "query", "left_anti").select("query", "v"), "few")
        near = near.join(few.select("query"), "query", "left_anti").unionByName(best(_exact(points, few, k + 1, scratch), "exact"))
    else:
        near = best(_exact(points, distinct, k + 1, scratch), "exact")
    # back to every query, and from distinct vectors to rows
    names = asked.select(F.col("id").alias("query_id"), "v").join(distinct, "v").select("query_id", "query")
    answers = names.join(near, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fitted(points: DataFrame, dims: int, k: int, tables: int, recall: float, scratch: Scratch) -> Fitted | None:
    """The setting for these vectors, fitted on ``SAMPLE`` of them, the ones with
    the smallest hash, and on what one exact scan finds for the first few."""
    sample = points.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select(F.col("rep").alias("query"), "v")
    ids, x = _block(sample)
    if len(ids) <= k:
        return None
    r = np.random.default_rng(5).permutation(len(ids))
    some = np.sort(r[:SAMPLE_QUERIES])
    shared = points.sparkSession.sparkContext.broadcast((ids[some], x[some]))
    near = points.select("rep", "v").mapInArrow(_scanned(shared, k + 1), _FOUND).where("query <> rep")
    order = Window.partitionBy("query").orderBy("score", "rep")
    near = near.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k).select("query", "rep")
    pairs = near.join(points.select("rep", "v"), "rep").select("query", "v").orderBy("query", "v").toArrow().combine_chunks()  # k rows a sample query
    shared.destroy()
    owner = np.searchsorted(ids[some], pairs["query"].to_numpy())
    found = np.concatenate((owner[:, None].astype(float), _matrix(pairs["v"].combine_chunks())), axis=1)
    return fit(x[some], found, np.delete(x, some, axis=0), points.count(), tables, recall)
