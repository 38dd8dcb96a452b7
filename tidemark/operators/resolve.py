"""Entity resolution: standardise, link, resolve conflicts, merge, fold."""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import get_close_matches
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import aligned_union, qcol, shared_columns, with_minmax, with_text
from tidemark.functions.text import expand_abbreviations, has_punctuation, is_lower, remove_punctuation, strip_currency
from tidemark.sources.shared import kept
from tidemark.operators.dedup import inverse_frequencies, terms, weights

STEPS = ("lower", "punctuation", "currency", "abbreviations")
STRATEGIES = ("prefer_dataset_1", "prefer_dataset_2", "prefer_non_null")

# English words without content.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you "
    "your yours yourself yourselves"
).split()


def infer_majority_format(dfs: Sequence[DataFrame], column: str) -> dict[str, bool]:
    """Steps by majority over the present values of all tables: lower-case if over
    0.6 of them are, no punctuation if under 0.4 have any, currency signs kept."""
    every = reduce(lambda a, b: a.unionAll(b), [d.select(qcol(column).cast("string").alias("v")) for d in dfs])
    r = every.agg(F.avg(is_lower(F.col("v")).cast("int")).alias("l"), F.avg(has_punctuation(F.col("v")).cast("int")).alias("p")).first()
    return {"lower": (r.l or 0) > 0.6, "punctuation": r.p is not None and r.p < 0.4, "currency": False, "abbreviations": True}


def standard_format(df: DataFrame, column: str, row_id: str = "row_id", n: int = 20) -> dict[str, bool]:
    """Steps that a table's first ``n`` rows follow: all lower-case, none punctuated."""
    v = qcol(column).cast("string")
    r = df.orderBy(row_id).limit(n).agg(F.coalesce(F.bool_and(is_lower(v)), F.lit(True)).alias("l"), F.coalesce(F.bool_and(~has_punctuation(v)), F.lit(True)).alias("p")).first()
    return {"lower": r.l, "punctuation": r.p, "currency": False, "abbreviations": True}


def standardized(c: Column, steps: dict[str, bool], abbreviations: dict[str, str] | None = None) -> Column:
    """Lower-case, punctuation, currency, abbreviations, in this order; NULL stays."""
    if steps.get("lower"):
        c = F.lower(c)
    if steps.get("punctuation"):
        c = remove_punctuation(c)
    if steps.get("currency"):
        c = strip_currency(c)
    return expand_abbreviations(c, abbreviations) if steps.get("abbreviations") and abbreviations else c


def standardize(
    datasets: list[tuple[str, DataFrame]],
    mode: str = "majority",
    standard: str | None = None,
    rules: dict[str, dict[str, bool]] | None = None,
    sources: dict[str, str] | None = None,
    abbreviations: dict[str, str] | None = None,
    row_id: str = "row_id",
    per_dataset: bool = False,
) -> list[tuple[str, DataFrame]]:
    """The tables with their shared text columns in one format. Modes: ``standard``
    takes it from one table, ``rules`` from given steps a column, ``column`` from a
    table named for each column, ``majority`` from a vote over all tables (or within
    each, ``per_dataset``). Number columns stay."""
    if mode not in ("standard", "rules", "column", "majority"):
        raise ValueError(f"unknown mode {mode}")
    tables = dict(datasets)
    names = [set(d.columns) for d in tables.values()]
    first = next(iter(tables.values()))
    common = [c for c in sorted(set.intersection(*names)) if c != row_id and all(d.schema[c].dataType.typeName() == "string" for d in tables.values())]

    def steps(c: str, df: DataFrame) -> dict[str, bool]:
        if mode == "rules":
            return (rules or {}).get(c, {})
        if mode == "standard":
            return standard_format(tables.get(standard or "", first), c, row_id)
        if mode == "column":
            return standard_format(tables.get((sources or {}).get(c, ""), first), c, row_id)
        return infer_majority_format([df] if per_dataset else list(tables.values()), c)

    shared_steps = None if per_dataset else {c: steps(c, first) for c in common}
    out = []
    for name, df in datasets:
        chosen = shared_steps or {c: steps(c, df) for c in common}
        out.append((name, df.select(*[standardized(qcol(c), chosen[c], abbreviations).alias(c) if c in chosen else qcol(c) for c in df.columns])))
    return out


def row_errors(base: DataFrame, df: DataFrame, cols: list[str], row_id: str, components: int | None = None) -> DataFrame:
    """(row_id, error): mean squared error of rebuilding a row's scaled numbers from
    the principal components of the base, the linear form of an auto-encoder."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scaled_base, scaled = with_minmax(base, cols, base), with_minmax(df, cols, base)
    k = components or max(1, len(cols) // 2)
    fill = [F.coalesce(qcol(c).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(cols)]
    join = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(cols))], outputCol="__v")
    fitted = join.transform(scaled_base.select(*fill))
    means = [v or 0.0 for v in fitted.agg(*[F.avg(f"__x{i}") for i in range(len(cols))]).first()]
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(fitted)
    axes = model.pc.toArray().tolist()  # cols x k
    at_mean = [sum(m * axes[i][j] for i, m in enumerate(means)) for j in range(k)]
    rows = model.transform(join.transform(scaled.select(qcol(row_id).alias("row_id"), *fill))).select("row_id", *[f"__x{i}" for i in range(len(cols))], vector_to_array("__p").alias("p"))
    back = [sum(((F.col("p")[j] - at_mean[j]) * axes[i][j] for j in range(k)), F.lit(means[i])) for i in range(len(cols))]
    error = sum(((F.col(f"__x{i}") - b) * (F.col(f"__x{i}") - b) for i, b in enumerate(back)), F.lit(0.0)) / len(cols)
    return rows.select("row_id", error.alias("error"))


def link(
    base: DataFrame,
    incoming: DataFrame,
    row_id: str = "row_id",
    text_weight: float = 0.5,
    error_weight: float = 0.5,
    max_matches: int | None = None,
    stop_words: Sequence[str] = STOP_WORDS,
    cols: list[str] | None = None,
    max_share: float | None = None,
    common: int = 1_000,
) -> DataFrame:
    """(row_1, row_2, text_similarity, error_similarity, final_similarity, text_1,
    text_2): the incoming row most like each base row by the cosine of term weights
    fitted on the base, the smaller id of equals. Rows that share no term have no
    partner. error_similarity compares how well the matched rows' numbers fit the
    base, 1 where the tables share no numbers. ``max_matches`` keeps the base rows
    with the smallest ids.

    A term that most rows have pairs most rows with each other. With ``max_share``
    only terms in at most that share of the base rows propose pairs; their scores
    still count all terms. Rows that share commoner terms only then have no partner.
    Without it, a term in more than ``common`` base rows pairs only the rows whose
    best partner by the other terms it could outdo, and of incoming rows alike in
    these terms the first: the result is that of all pairs."""
    texts = [c for c in (cols or shared_columns(base, incoming, "text")) if c != row_id]
    numbers = [c for c in shared_columns(base, incoming, "numeric") if c != row_id and (cols is None or c in cols)]
    left, right = with_text(base, texts), with_text(incoming, texts)
    if max_matches is not None:
        keep = left.select(qcol(row_id)).orderBy(row_id).limit(max_matches)
        asked = left.join(keep, row_id, "left_semi")
    else:
        asked = left
    tf = terms(left, F.col("__text"), row_id, stop_words)
    idf = inverse_frequencies(tf, base.count())
    w1 = weights(tf, idf).join(asked.select(qcol(row_id).alias("row_id")), "row_id", "left_semi")
    w2 = weights(terms(right, F.col("__text"), row_id, stop_words), idf)
    w1 = w1.select(F.col("row_id").alias("row_1"), "term", F.col("w").alias("w1"))
    w2 = w2.select(F.col("row_id").alias("row_2"), "term", F.col("w").alias("w2"))
    rows = base.count()
    blocked = max_share is None and rows > common
    if max_share is None and not blocked:
        both = w1.join(w2, "term")
    else:
        # idf falls with the number of rows that have the term
        max_share = common / rows if max_share is None else max_share
        rare = idf.where(F.col("idf") >= math.log((1 + rows) / (1 + max_share * rows)) + 1).select("term")
        proposed = w1.join(rare, "term").select("row_1", "term").join(w2.select("row_2", "term"), "term").select("row_1", "row_2").distinct()
        both = proposed.join(w1, "row_1").join(w2, ["row_2", "term"])
    dots = both.groupBy("row_1", "row_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("text_similarity"))
    if blocked:
        dots = dots.unionAll(_by_common_terms(w1.join(rare, "term", "left_anti"), w2.join(rare, "term", "left_anti"), dots))
    best = dots.groupBy("row_1").agg(F.min(F.struct((-F.round("text_similarity", 12)).alias("s"), "row_2", "text_similarity")).alias("b"))
    out = best.select("row_1", F.col("b.row_2").alias("row_2"), F.col("b.text_similarity").alias("text_similarity"))
    if numbers:
        e1 = row_errors(base, base, numbers, row_id).select(F.col("row_id").alias("row_1"), F.col("error").alias("e1"))
        e2 = row_errors(base, incoming, numbers, row_id).select(F.col("row_id").alias("row_2"), F.col("error").alias("e2"))
        out = out.join(e1, "row_1").join(e2, "row_2").withColumn("__d", F.abs(F.col("e1") - F.col("e2"))).drop("e1", "e2")
        out = with_minmax(out, ["__d"]).withColumn("error_similarity", 1 - F.col("__d")).drop("__d")
    else:
        out = out.withColumn("error_similarity", F.lit(1.0))
    out = out.withColumn("final_similarity", text_weight * F.col("text_similarity") + error_weight * F.col("error_similarity"))
    t1 = left.select(qcol(row_id).alias("row_1"), F.col("__text").alias("text_1"))
    t2 = right.select(qcol(row_id).alias("row_2"), F.col("__text").alias("text_2"))
    return out.join(t1, "row_1").join(t2, "row_2").select("row_1", "row_2", "text_similarity", "error_similarity", "final_similarity", "text_1", "text_2")


def _by_common_terms(c1: DataFrame, c2: DataFrame, dots: DataFrame) -> DataFrame:
    """(row_1, row_2, text_similarity) over the common terms ``c1`` and ``c2`` of the
    rows that these could still give a better partner than ``dots`` does."""
    tops = c2.groupBy("term").agg(F.max("w2").alias("top"))
    most = c1.join(tops, "term").groupBy("row_1").agg(F.sum(F.col("w1") * F.col("top")).alias("most"))
    found = dots.groupBy("row_1").agg(F.max("text_similarity").alias("found"))
    undecided = most.join(found, "row_1", "left").where(F.col("found").isNull() | (F.col("found") <= F.col("most") + 1e-11)).select("row_1")
    alike = c2.groupBy("row_2").agg(F.sort_array(F.collect_list(F.struct("term", "w2"))).alias("v")).groupBy("v").agg(F.min("row_2").alias("row_2"))
    first = alike.select("row_2", F.inline("v"))
    return c1.join(undecided, "row_1", "left_semi").join(first, "term").groupBy("row_1", "row_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("text_similarity"))


def resolve_conflict(a: Column, b: Column, strategy: str = "prefer_dataset_1") -> Column:
    """The first value, the second, or the first unless it is NULL or empty. Other
    strategies mean the first."""
    if strategy == "prefer_dataset_2":
        return b
    if strategy == "prefer_non_null":
        return F.when(a.isNotNull() & (a.cast("string") != ""), a).otherwise(b)
    return a


def merge(
    matches: DataFrame,
    base: DataFrame,
    incoming: DataFrame,
    strategies: dict[str, str] | None = None,
    names: tuple[str, str] = ("base", "incoming"),
    row_id: str = "row_id",
    keep_unmatched: bool = True,
) -> DataFrame:
    """One golden row a match: for each shared column the resolved value and both
    originals; row ids, score and the chain of sources; then the rows of either
    table without a match. An incoming row may be in several matches."""
    shared = [c for c in shared_columns(base, incoming) if c not in (row_id, "source_chain", "final_similarity", "row_1", "row_2") and not c.startswith("original_")]
    chain = lambda df, side, name: F.coalesce(F.col(f"{side}.source_chain"), F.lit(name)) if "source_chain" in df.columns else F.lit(name)
    a, b = (df.select(qcol(row_id).alias(r), F.struct(*[qcol(c).alias(c) for c in df.columns]).alias(s)) for df, r, s in ((base, "row_1", "a"), (incoming, "row_2", "b")))
    get = lambda side, c: F.col(side).getField(c)
    resolved = matches.select("row_1", "row_2", "final_similarity").join(a, "row_1").join(b, "row_2")
    golden = resolved.select(
        *[resolve_conflict(get("a", c), get("b", c), (strategies or {}).get(c, STRATEGIES[0])).alias(c) for c in shared],
        *[get(s, c).alias(f"original_{c}_from_{n}") for c in shared for s, n in (("a", names[0]), ("b", names[1]))],
        "row_1",
        "row_2",
        "final_similarity",
        F.concat(chain(base, "a", names[0]), F.lit(" + "), chain(incoming, "b", names[1])).alias("source_chain"),
    )
    if not keep_unmatched:
        return golden

    def rest(df: DataFrame, mine: str, other: str, name: str) -> DataFrame:
        left = df.join(matches.select(F.col(mine).alias(row_id)).distinct(), row_id, "left_anti")
        own = [c for c in df.columns if c not in (row_id, "row_1", "row_2", "final_similarity", "source_chain")]
        score = F.col("final_similarity") if "final_similarity" in df.columns else F.lit(None).cast("double")
        origin = F.coalesce(F.col("source_chain"), F.lit(name)) if "source_chain" in df.columns else F.lit(name)
        id_type = golden.schema[mine].dataType
        return left.select(
            *[qcol(c) for c in own], qcol(row_id).cast(id_type).alias(mine), F.lit(None).cast(id_type).alias(other), score.alias("final_similarity"), origin.alias("source_chain")
        )

    return aligned_union(golden, rest(base, "row_1", "row_2", names[0]), rest(incoming, "row_2", "row_1", names[1]))


def resolve_all(datasets: list[tuple[str, DataFrame]], strategies: dict[str, str] | None = None, row_id: str = "row_id", keep_unmatched: bool = True, **options) -> DataFrame:
    """Folds the tables from the left: the result of two is linked with the next.
    Each step's lineage is cut by a table in the folder the cluster shares."""
    if len(datasets) < 2:
        raise ValueError("two tables or more are needed")
    cols = sorted(set.intersection(*[set(d.columns) for _, d in datasets]) - {row_id})
    name, out = datasets[0]
    for other, df in datasets[1:]:
        matches = link(out, df, row_id, cols=cols, **options)
        merged = merge(matches, out, df, strategies, (name, other), row_id, keep_unmatched)
        key = F.struct(F.col("row_1").isNull(), "row_1", "row_2")
        merged = merged.withColumn(row_id, F.xxhash64(key)).drop("row_1", "row_2") if other != datasets[-1][0] else merged
        out, name = kept(merged, "resolved"), "merged"
    return out


def close_names(a: DataFrame, b: DataFrame, cutoff: float = 0.6) -> dict[str, str]:
    """Columns of ``a`` that ``b`` lacks -> the most similar name there, if any."""
    out = {}
    for c in a.columns:
        near = get_close_matches(c.strip().lower(), [x.strip().lower() for x in b.columns], 1, cutoff) if c not in b.columns else []
        if near:
            out[c] = next(x for x in b.columns if x.strip().lower() == near[0])
    return out


def score_histogram(matches: DataFrame, column: str = "final_similarity", bins: int = 20) -> DataFrame:
    """(bin, low, high, n): exact counts in equal bins from 0 to 1."""
    at = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    counts = matches.where(F.col(column).isNotNull()).groupBy(F.greatest(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "n")


def best_rows(scored: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """The best row of each group, the smallest ``tie`` of equals."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
