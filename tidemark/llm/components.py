"""Connected components by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.skew import join_unique
from tidemark.llm.scratch import Scratch

MANY = 1_000  # neighbours of a node that one task may well take
FEW = 1 << 19  # links, 8 MB, that the driver takes at most


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every
    node with a link to another. Self links and repeated links change nothing;
    links with a null end are ignored; no links give no rows.

    At most ``FEW`` links are solved by arrays in the driver. With more, each step
    groups by node with map-side minima and joins the minima back. The minima of
    nodes with very many neighbours, few by arithmetic, are broadcast, so the centre
    of a star is no single task; then only a count and a hash sum reach the driver,
    to see whether a round changed anything. Every half of a step is written, as a
    plan of a whole step has each half several times.
    """
    links = scratch.stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links0",
    )
    mark = _mark(links)
    if 0 < mark[0] <= FEW:
        return _by_arrays(links)
    step = 0
    while mark[0]:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_unique(both, least, "a", 2 * mark[0], least=MANY).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.stage(large, "large")
        low = scratch.stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = (
            join_unique(large, low, "a", 2 * mark[0], least=MANY)
            .select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        step += 1
        links = scratch.stage(small, f"links{step}")
        scratch.drop(f"links{step - 1}", "least", "large", "low")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _by_arrays(links: DataFrame) -> DataFrame:
    """The components of few links: labels that only fall, each round along the links
    and then to the label's own label until that changes nothing."""
    found = links.select("a", "b").toArrow()  # bounded: ``FEW`` rows
    kind = links.schema["a"].dataType.simpleString()
    nodes, ends = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))  # the others carry their own number
    table = pa.table({"node": nodes[some], "component": nodes[label[some]]})
    return links.sparkSession.createDataFrame(table).select(*[F.col(c).cast(kind).alias(c) for c in table.column_names])


def _mark(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
    )
