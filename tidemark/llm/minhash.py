"""Near-duplicate documents by circulant MinHash.

A document's set holds 64-bit hashes of its word shingles. C-MinHash (Li and Li,
2022) needs two permutations only: the first places each shingle on a circle of
``CIRCLE`` points, the second ranks the points, and coordinate k of the signature
is the least rank seen after turning the circle by k. Reading coordinate 0..K-1
for one shingle is one contiguous slice of the ranks, so a whole signature is a
gather of slices and a column minimum. Folding shingles onto the circle can only
raise an estimated similarity; every link is confirmed on the full sets.

Plan: signatures in one pass over the texts; documents with equal sets fold into
their smallest doc_id with map-side minima, so a group of copies costs one row a
task; the bands of what is left go to buckets. Within a bucket every member is
compared with two leaders, the one that shares most buckets with others and the
smallest, not with all. Members of buckets that the verified links leave in
several components are then compared across components, through the rare ends of
their sets, so no link between components is lost and a large group of copies
costs few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.skew import join_unique
from tidemark.llm.batches import sliced
from tidemark.llm.components import connected_components
from tidemark.llm.hashing import _MIX, Sums, edges, mixed, numbers, pieces
from tidemark.llm.scratch import Scratch

CIRCLE = 1 << 20
SALT = 1_000  # rows of a shingle on one side of a join that one task takes

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANKS = (b" ", b"\n", b"\t")
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NUMBER = numbers(256)


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its words in order, A-Z lower-cased."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for part in pieces([t or b"" for t in texts], _BLANKS):
        raw = np.frombuffer((b" ".join(p for _, p in part) + b" ").translate(_LOWER), np.uint8)
        starts, ends = edges(~_BLANK[raw])
        h = Sums(_NUMBER[raw]).of(starts, ends)
        cuts = np.searchsorted(starts, np.cumsum([len(p) + 1 for _, p in part]))[:-1]
        for (i, _), words in zip(part, np.split(h, cuts), strict=True):
            found[i].append(words)
    return [f[0] if len(f) == 1 else np.concatenate(f) for f in found]


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, given the words'
    hashes; of the whole sequence where it is shorter; none for no words."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _MIX[0] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Circulant:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows, self.k = bands, rows, bands * rows
        ranks = np.random.default_rng(seed).permutation(CIRCLE).astype(np.int32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: self.k]]), self.k)
        self.place = np.uint64(0xD6E8FEB86659FD93)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (mixed(shingles * self.place) >> np.uint64(44)).astype(np.int64)
        least = self.slices[at[:2048]].min(axis=0)
        for i in range(2048, len(at), 2048):
            np.minimum(least, self.slices[at[i : i + 2048]].min(axis=0), out=least)
        return least

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key a band, its number included."""
        sig = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        key = mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX[0])
        for r in range(self.rows):
            key = mixed(key * _MIX[0] + sig[:, r])
        return key.view(np.int64)


def _signed(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle = Circulant(bands, rows)
        for b in sliced(batches):
            n, h1, h2, keys = [], [], [], []
            for h in word_hashes(b.column(1).to_pylist()):
                s = shingle_set(h, words)
                n.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), keys.append(None)
                    continue
                raw = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((raw >> 64) - (1 << 63)), h2.append((raw & ((1 << 64) - 1)) - (1 << 63))
                keys.append(circle.keys(s))
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "h1", "h2", "keys"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingle_set(h, words).view(np.int64) for h in word_hashes(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    na, nb, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * both >= percent * (na + nb)))
        .select(*pairs.columns)
    )


def _across(rest: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) between different labels of ``rest`` (node, label,
    s), none of the links left out.

    With the shingles of every set in one order, rarest first, two sets at the
    threshold share a shingle near the front of both: of n shingles within the
    first n - needed + 1, where needed is the overlap the sizes ask for, and the
    first one they share leaves at least the needed overlap behind it. A text far
    from all others has only rare shingles in front and meets nobody. Of a
    shingle's rows the most frequent label is not joined with itself. The rows of a
    shingle that very many sets share are dealt by salt, ``SALT`` of one side to a
    task, and meet its counts by broadcast.
    """
    part = percent / (100 + percent)
    rest = scratch.stage(rest, "open")
    total = rest.agg(F.sum(F.size("s"))).first()[0] or 0
    words = rest.select("node", "label", F.size("s").alias("n"), F.explode("s").alias("w"))
    often = scratch.stage(words.groupBy("w").agg(F.count("*").alias("df")), "often")
    order = Window.partitionBy("node").orderBy("df", "w")
    front = (
        join_unique(words, often, "w", total, "df", SALT)
        .withColumn("i", F.row_number().over(order) - 1)
        .where((F.col("df") > 1) & (100 * (F.col("n") - F.col("i")) >= percent * F.col("n")))
        .select("w", "node", "label", "n", "i")
    )
    front = scratch.stage(front, "front")
    scratch.drop("often")
    most = front.groupBy("w", "label").agg(F.count("*").alias("c")).groupBy("w").agg(
        F.max_by("label", "c").alias("most"), F.count("*").alias("labels"), F.sum("c").alias("rows"), F.max("c").alias("top")
    )
    salts = F.ceil((F.col("rows") - F.col("top")) / SALT).cast("int")
    most = most.select("w", "most", "labels", "rows", F.greatest(salts, F.lit(1)).alias("salts"))
    front = join_unique(front, scratch.stage(most, "most"), "w", front.count(), "rows", SALT).where("labels > 1")
    left = front.where("label <> most").select("w", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), *[F.col(c).alias(f"{c}0") for c in ("node", "label", "n", "i")])
    right = front.select("w", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}1") for c in ("node", "label", "n", "i")])
    fits = (
        (F.col("label0") != F.col("label1"))
        & (100 * F.least("n0", "n1") >= percent * F.greatest("n0", "n1"))
        & (F.least(F.col("n0") - F.col("i0"), F.col("n1") - F.col("i1")) >= F.floor(part * (F.col("n0") + F.col("n1")) - 1e-6))
    )
    pairs = left.alias("x").join(right.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.salt") == F.col("y.salt")) & fits)
    ends = F.when(F.col("node0") < F.col("node1"), F.struct(F.col("node0").alias("a"), F.col("node1").alias("b"), F.col("label0").alias("la"), F.col("label1").alias("lb")))
    ends = ends.otherwise(F.struct(F.col("node1").alias("a"), F.col("node0").alias("b"), F.col("label1").alias("la"), F.col("label0").alias("lb")))
    return pairs.select(ends.alias("e")).select("e.*").distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = 36,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents whose sets overlap by ``percent`` of their union or more are
    linked; component_id is the smallest doc_id reachable over links, kept is
    true on the row that carries it. Words are runs of anything but space and
    U+0009..U+000D, A-Z lower-cased.

    Defined cases: null, empty or blank text has n_shingles 0 and is linked with
    nothing; a null doc_id stays unlinked with a null component_id and kept true;
    rows that share a doc_id are one node (equal rows stay equal rows); an empty
    table gives an empty result; other columns are not read.

    A pair at the threshold is missed with probability (1 - s^rows)^bands: 6e-7
    for the defaults at 0.8. The searching is per bucket, without a cap.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    feats = scratch.stage(
        slim.mapInArrow(_signed(words, bands, rows), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "feats"
    )
    live = feats.where("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    reps = live.join(classes.select("node"), live.doc_id == F.col("node"), "left_semi").select(
        F.col("doc_id").alias("node"), F.explode("keys").alias("key")
    )
    bucket = reps.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.stage(reps.join(bucket, "key").distinct(), "shared")
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    lead = shared.join(weight, "node").groupBy("key").agg(F.max_by("node", "weight").alias("l0"), F.min("node").alias("l1"))
    star = (
        shared.select("key", "node")
        .join(lead, "key")
        .select("node", F.explode(F.array("l0", "l1")).alias("leader"))
        .where("node <> leader")
        .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        .distinct()
    )
    sets = scratch.stage(
        slim.join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .select("doc_id", "text")
        .mapInArrow(_sets(words), "node long, s array<long>")
        .dropDuplicates(["node"]),
        "sets",
    )
    star = scratch.stage(star, "star")
    links = scratch.stage(_verified(star, sets, percent), "linked0")
    found = connected_components(links, scratch)
    labelled = shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    labelled = scratch.stage(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("m0"), F.max("label").alias("m1")).where("m0 < m1").select("key")
    rest = labelled.join(open_keys, "key", "left_semi").select("node", "label").distinct()
    across = _across(rest.join(sets, "node"), percent, scratch).join(star, ["a", "b"], "left_anti")
    # links between components join whole components: they are looked for among these alone
    more = scratch.stage(_verified(across, sets, percent).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "linked1")
    joined = connected_components(more, scratch).select(F.col("node").alias("label"), F.col("component").alias("top"))
    found = labelled.select("node", "label").distinct().join(joined, "label", "left").select("node", F.coalesce("top", "label").alias("component"))
    of_class = classes.join(found, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    linked = feats.select("doc_id", "n_shingles", "h1", "h2").join(
        of_class.withColumn("live", F.lit(True)), ["h1", "h2"], "left"
    )
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), all columns, less those of near
    duplicates: of each group the document with the smallest doc_id stays. Of rows
    that share a doc_id one stays, the first by its columns' text; rows with a null
    doc_id all stay."""
    found = Scratch(docs.sparkSession, "deduplicated").stage(near_duplicates(docs, words, percent).select("doc_id", "kept"), "kept")
    left = docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    order = Window.partitionBy("doc_id").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    again = left.join(twice, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    first = again.withColumn("__row", F.row_number().over(order)).where("__row = 1").drop("__row")
    return left.join(twice, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(first)
