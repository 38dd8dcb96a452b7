"""Duplicates, term vectors, entity resolution, clusters, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import dedup as D
from tidemark.operators import learn as L
from tidemark.operators import profile as A
from tidemark.operators import resolve as E
from tidemark.operators import synth as G
from tidemark.operators.rules import compile_rules
from tidemark.plans.base import dirty, dirty_sql, query, table
from tidemark.sources import sinks
from tidemark.sources.shared import kept
from tidemark.sources.tables import with_row_id
from tidemark.streaming import live

TEXT, NUMERIC = ["p_name", "p_type"], ["p_size", "p_retailprice"]

WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"
_NEAR = "coalesce(abs(a.{c} - b.{c}) <= 0.02::DOUBLE * greatest(abs(a.{c}), abs(b.{c})), false)"


def _overlap(c: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat(a.w_{c}, b.w_{c}))) = 0 THEN 0 ELSE 100.0::DOUBLE * len(list_intersect(a.w_{c}, b.w_{c})) / len(list_distinct(list_concat(a.w_{c}, b.w_{c}))) END"


_WORDED = "worded AS (SELECT p_partkey, p_brand, p_name, p_size, p_retailprice, " + ", ".join(f"{WORDS.format(c=c)} AS w_{c}" for c in TEXT) + " FROM part)"
_SCORES = ", ".join([f"{_overlap(c)} AS s_{c}" for c in TEXT] + [f"CASE WHEN {_NEAR.format(c=c)} THEN 100.0::DOUBLE ELSE 0 END AS s_{c}" for c in NUMERIC])
_NAMED = "list_filter([" + ", ".join(f"CASE WHEN s_{c} > 60 THEN '{c}' END" for c in TEXT + NUMERIC) + "], lambda x: x IS NOT NULL)"
_TOTAL = "(" + " + ".join(f"s_{c}" for c in TEXT + NUMERIC) + ") / 4"


def _pairs_sql(name: str, on: str) -> str:
    return f"{name} AS (SELECT record1, record2, {_TOTAL} AS score, {_NAMED} AS contributing_columns FROM (SELECT a.p_partkey AS record1, b.p_partkey AS record2, {_SCORES} FROM worded a JOIN worded b ON {on}))"


WINDOW = f"{_WORDED}, {_pairs_sql('pairs', 'b.p_partkey > a.p_partkey AND b.p_partkey <= a.p_partkey + 5')}"
BLOCKS = _pairs_sql("blocks", "b.p_partkey > a.p_partkey AND a.p_brand = b.p_brand AND a.p_name = b.p_name")


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", *TEXT, *NUMERIC)


def _window_pairs(spark, sf_dir):
    rows = D.worded(_parts(spark, sf_dir), TEXT)
    return D.score_pairs(D.candidate_pairs(rows, "p_partkey", cols=[*TEXT, *NUMERIC]), TEXT, NUMERIC, "words")


def _block_pairs(spark, sf_dir, shown):
    """The scored pairs of kinds in blocks, ``shown`` applied to them, and the kinds' rows."""
    rows = D.worded(_parts(spark, sf_dir).withColumn("block", F.concat_ws("|", "p_brand", "p_name")), TEXT)
    members, kinds = D.block_kinds(rows, "p_partkey", F.col("block"), [*TEXT, *NUMERIC])
    return kept(shown(D.score_pairs(kinds, TEXT, NUMERIC, "words")), "scored"), members


def _readable(pairs):
    return pairs.select("record1", "record2", F.round("score", 6).alias("score"), F.concat_ws(",", "contributing_columns").alias("contributing_columns"))


_READABLE = "SELECT record1, record2, round(score, 6) AS score, array_to_string(contributing_columns, ',') AS contributing_columns FROM "


@query("window_pairs", f"WITH {WINDOW} {_READABLE} pairs")
def window_pairs(spark, sf_dir):
    return _readable(_window_pairs(spark, sf_dir))


@query("block_pairs", f"WITH {_WORDED}, {BLOCKS} {_READABLE} blocks")
def block_pairs(spark, sf_dir):
    return D.spread(*_block_pairs(spark, sf_dir, _readable))


@query("similar_pairs", f"WITH {WINDOW} {_READABLE} pairs WHERE score >= 60 AND score < 80")
def similar_pairs(spark, sf_dir):
    return _readable(D.split_pairs(_window_pairs(spark, sf_dir))[1])


_ENDS = "ends AS (SELECT record1 AS r, CASE WHEN score >= 80 THEN 2 ELSE 1 END AS k FROM pairs WHERE score >= 60 UNION ALL SELECT record2, CASE WHEN score >= 80 THEN 2 ELSE 1 END FROM pairs WHERE score >= 60)"


def _classes_sql(pick: str) -> str:
    return f"WITH {WINDOW}, {_ENDS} SELECT p_partkey, CAST(coalesce((SELECT {pick}(k) FROM ends WHERE r = p_partkey), 0) AS INT) AS record_class FROM part"


@query("record_classes", _classes_sql("max"))
def record_classes(spark, sf_dir):
    return D.classify(_parts(spark, sf_dir), _window_pairs(spark, sf_dir), "p_partkey").select("p_partkey", "record_class")


@query("record_classes_compat", _classes_sql("min"))
def record_classes_compat(spark, sf_dir):
    return D.classify(_parts(spark, sf_dir), _window_pairs(spark, sf_dir), "p_partkey", compat_class=True).select("p_partkey", "record_class")


@query("class_counts", f"WITH q AS ({_classes_sql('max')}) SELECT record_class, count(*) AS n FROM q GROUP BY record_class")
def class_counts(spark, sf_dir):
    return record_classes(spark, sf_dir).groupBy("record_class").agg(F.count("*").alias("n"))


@query("unique_records", f"WITH {WINDOW}, {_ENDS} SELECT p_partkey AS record, 100 AS uniqueness FROM part WHERE p_partkey NOT IN (SELECT r FROM ends)")
def unique_records(spark, sf_dir):
    return D.unique_records(_parts(spark, sf_dir), _window_pairs(spark, sf_dir), "p_partkey")


@query(
    "combine_pairs",
    f"WITH {WINDOW}, {BLOCKS}, both_ AS (SELECT record1, record2, 0.7::DOUBLE * score AS score, 'rules' AS source, contributing_columns FROM pairs WHERE score >= 60 "
    "UNION ALL SELECT record1, record2, 0.3::DOUBLE * score, 'model', contributing_columns FROM blocks WHERE score >= 60) "
    "SELECT record1, record2, round(sum(score), 6) AS score, string_agg(source, ',' ORDER BY source) AS sources, array_to_string(list_sort(list_distinct(flatten(list(contributing_columns)))), ',') AS contributing_columns FROM both_ GROUP BY record1, record2",
)
def combine_pairs(spark, sf_dir):
    keep = lambda p: p.where("score >= 60")
    out = D.combine_spread(keep(_window_pairs(spark, sf_dir)), *_block_pairs(spark, sf_dir, keep))
    return out.select("record1", "record2", F.round("score", 6).alias("score"), F.concat_ws(",", "sources").alias("sources"), F.concat_ws(",", "contributing_columns").alias("contributing_columns"))


@query("fuzzy_pairs")
def fuzzy_pairs(spark, sf_dir):
    return _readable(D.score_pairs(D.candidate_pairs(_parts(spark, sf_dir), "p_partkey"), TEXT, NUMERIC))


def _tfidf_sql(source: str, key: str, text: str) -> str:
    return (
        f"tok AS (SELECT {key} AS row_id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source}), tf AS (SELECT row_id, term, count(*) AS tf FROM tok GROUP BY row_id, term), "
        f"idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term), raw AS (SELECT row_id, term, tf * idf AS x FROM tf JOIN idf USING (term)), "
        "norm AS (SELECT row_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY row_id), vec AS (SELECT row_id, term, x / norm AS w FROM raw JOIN norm USING (row_id))"
    )


@query("tfidf_weights", f"WITH {_tfidf_sql('part', 'p_partkey', 'concat_ws(chr(32), p_name, p_brand, p_type)')} SELECT row_id, term, round(w, 6) AS w FROM vec")
def tfidf_weights(spark, sf_dir):
    out = D.tfidf(table(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_brand", "p_type"), "p_partkey")
    return out.select("row_id", "term", F.round("w", 6).alias("w"))


@query(
    "mean_cosine",
    f"WITH {_tfidf_sql('documents', 'doc_id', 'text')}, m AS (SELECT term, sum(w) / (SELECT count(*) FROM documents) AS m FROM vec GROUP BY term), d AS (SELECT row_id, sum(w * m) AS s FROM vec JOIN m USING (term) GROUP BY row_id) "
    "SELECT doc_id AS row_id, round(coalesce(s, 0), 6) AS mean_cosine FROM documents LEFT JOIN d ON doc_id = row_id",
)
def mean_cosine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = D.mean_cosine(docs, D.tfidf(docs, F.col("text"), "doc_id"), "doc_id")
    return out.select("row_id", F.round("mean_cosine", 6).alias("mean_cosine"))


BASE = "SELECT s_suppkey AS row_id, s_name AS name, concat('nation', s_nationkey) AS place FROM supplier"
INCOMING = (
    "SELECT s_suppkey + 100000 AS row_id, CASE WHEN s_suppkey % 7 = 0 THEN concat(s_name, ' ltd') WHEN s_suppkey % 11 = 0 THEN '' ELSE s_name END AS name, "
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('nation', s_nationkey) END AS place FROM supplier WHERE s_suppkey % 3 <> 0"
)


def _sides(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(BASE), spark.sql(INCOMING)


_LINKED = (
    f"base AS ({BASE}), incoming AS ({INCOMING}), bt AS (SELECT row_id, concat_ws(' ', coalesce(name, ''), coalesce(place, '')) AS text FROM base), it AS (SELECT row_id, concat_ws(' ', coalesce(name, ''), coalesce(place, '')) AS text FROM incoming), "
    + _tfidf_sql("bt", "row_id", "text")
    + ", itok AS (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM it), iraw AS (SELECT row_id, term, count(*) * any_value(idf) AS x FROM itok JOIN idf USING (term) GROUP BY row_id, term), "
    "inorm AS (SELECT row_id, sqrt(sum(x * x)) AS norm FROM iraw GROUP BY row_id), ivec AS (SELECT row_id, term, x / norm AS w FROM iraw JOIN inorm USING (row_id)), "
    "dots AS (SELECT a.row_id AS row_1, b.row_id AS row_2, sum(a.w * b.w) AS s FROM vec a JOIN ivec b USING (term) GROUP BY 1, 2), "
    "link AS (SELECT row_1, row_2, s FROM (SELECT *, row_number() OVER (PARTITION BY row_1 ORDER BY round(s, 12) DESC, row_2) AS r FROM dots) WHERE r = 1)"
)


@query("link_entities", f"WITH {_LINKED} SELECT row_1, row_2, round(s, 6) AS text_similarity, round(0.5::DOUBLE * s + 0.5::DOUBLE, 6) AS final_similarity FROM link")
def link_entities(spark, sf_dir):
    out = E.link(*_sides(spark, sf_dir))
    return out.select("row_1", "row_2", F.round("text_similarity", 6).alias("text_similarity"), F.round("final_similarity", 6).alias("final_similarity"))


@query("score_histogram", f"WITH {_LINKED}, f AS (SELECT 0.5::DOUBLE * s + 0.5::DOUBLE AS v FROM link) SELECT CAST(least(floor(v * 20 - 1e-9::DOUBLE), 19) AS INT) AS bin, count(*) AS n FROM f GROUP BY bin")
def score_histogram(spark, sf_dir):
    found = E.link(*_sides(spark, sf_dir)).withColumn("final_similarity", F.col("final_similarity") - 5e-11)
    return E.score_histogram(found).select("bin", "n")


_MATCHED = "SELECT s_suppkey AS row_1, s_suppkey + 100000 AS row_2, 1.0 AS final_similarity FROM supplier WHERE s_suppkey % 4 = 0 AND s_suppkey % 3 <> 0"


def _golden(value: str, c: str) -> str:
    return f"{value} AS {c}, b.{c} AS original_{c}_from_base, i.{c} AS original_{c}_from_incoming"


@query(
    "merge_entities",
    f"WITH base AS ({BASE}), incoming AS ({INCOMING}), m AS ({_MATCHED}) SELECT {_golden('i.name', 'name')}, {_golden('CASE WHEN b.place IS NOT NULL AND b.place <> chr(0) THEN b.place ELSE i.place END', 'place')}, "
    "row_1, row_2, CAST(final_similarity AS DOUBLE) AS final_similarity, 'base + incoming' AS source_chain FROM m JOIN base b ON b.row_id = row_1 JOIN incoming i ON i.row_id = row_2 "
    "UNION ALL SELECT name, NULL, NULL, place, NULL, NULL, row_id, NULL, NULL, 'base' FROM base WHERE row_id NOT IN (SELECT row_1 FROM m) "
    "UNION ALL SELECT name, NULL, NULL, place, NULL, NULL, NULL, row_id, NULL, 'incoming' FROM incoming WHERE row_id NOT IN (SELECT row_2 FROM m)",
)
def merge_entities(spark, sf_dir):
    base, incoming = _sides(spark, sf_dir)
    matches = spark.sql(_MATCHED).withColumn("final_similarity", F.col("final_similarity").cast("double"))
    return E.merge(matches, base, incoming, {"name": "prefer_dataset_2", "place": "prefer_non_null"})


@query(
    "resolve_conflicts",
    f"WITH base AS ({BASE}), incoming AS ({INCOMING}) SELECT b.row_id, b.name AS one, i.name AS two, CASE WHEN i.name IS NOT NULL AND i.name <> '' THEN i.name ELSE b.name END AS full_name FROM base b JOIN incoming i ON i.row_id = b.row_id + 100000",
)
def resolve_conflicts(spark, sf_dir):
    base, incoming = _sides(spark, sf_dir)
    joined = base.alias("b").join(incoming.alias("i"), F.col("i.row_id") == F.col("b.row_id") + 100000)
    a, b = F.col("b.name"), F.col("i.name")
    return joined.select(
        F.col("b.row_id"), E.resolve_conflict(a, b).alias("one"), E.resolve_conflict(a, b, "prefer_dataset_2").alias("two"), E.resolve_conflict(b, a, "prefer_non_null").alias("full_name")
    )


def _standard(c: str) -> str:
    lower = f"coalesce((SELECT avg(CAST({c} = lower({c}) AND lower({c}) <> upper({c}) AS INT)) > 0.6 FROM every), false)"
    bare = f"coalesce((SELECT avg(CAST(regexp_matches({c}, '[^\\w\\s]') AS INT)) < 0.4 FROM every), false)"
    cased = f"CASE WHEN {lower} THEN lower({c}) ELSE {c} END"
    plain = f"CASE WHEN {bare} THEN regexp_replace({cased}, '[^\\w\\s]', '', 'g') ELSE {cased} END"
    return f"regexp_replace(regexp_replace({plain}, '(?i)\\bltd\\b', 'limited', 'g'), '(?i)\\bco\\b', 'company', 'g') AS {c}"


@query(
    "standardize_majority",
    f"WITH {dirty_sql('part')}, every AS (SELECT p_name, p_type FROM dirty UNION ALL SELECT p_name, p_type FROM part) SELECT p_partkey, {_standard('p_name')}, {_standard('p_type')} FROM dirty",
)
def standardize_majority(spark, sf_dir):
    pick = lambda d: d.select("p_partkey", "p_name", "p_type")
    sets = [("dirty", pick(dirty(spark, sf_dir, "part"))), ("clean", pick(table(spark, sf_dir, "part")))]
    return E.standardize(sets, "majority", abbreviations={"ltd": "limited", "co": "company"}, row_id="p_partkey")[0][1]


@query("linked_numbers", "SELECT s_suppkey AS row_1, s_suppkey + 100000 AS row_2, 1.0::DOUBLE AS text_similarity, 1.0::DOUBLE AS error_similarity, 1.0::DOUBLE AS final_similarity, s_name AS text_1, s_name AS text_2 FROM supplier")
def linked_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"), "s_acctbal", "s_nationkey")
    out = E.link(rows, rows.withColumn("row_id", F.col("row_id") + 100000))  # each row's like is itself
    return out.select("row_1", "row_2", *[F.round(f"{c}_similarity", 6).alias(f"{c}_similarity") for c in ("text", "error", "final")], "text_1", "text_2")


@query("resolve_all")
def resolve_all(spark, sf_dir):
    base, incoming = _sides(spark, sf_dir)
    return E.resolve_all([("first", base), ("second", incoming), ("third", incoming.withColumn("row_id", F.col("row_id") + 100000))])


ISSUES = {"event_type": "^(view|click|purchase|signup)$", "props": r'^\{"k": \d\d\}$'}


@query(
    "events_hourly_issues",
    "WITH c AS (SELECT date_trunc('hour', ts) AS start, 'event_type' AS column_name, regexp_full_match(event_type, '^(view|click|purchase|signup)$') AS good FROM events "
    "UNION ALL SELECT date_trunc('hour', ts), 'props', regexp_full_match(props, '^\\{\"k\": \\d\\d\\}$') FROM events) "
    "SELECT strftime(start, '%Y-%m-%d %H') AS hour, column_name, count(*) FILTER (WHERE NOT good) AS invalid, count(*) AS rows FROM c GROUP BY start, column_name",
)
def events_hourly_issues(spark, sf_dir):
    return _hours(live.windowed_issues(live.mark_stream(_events(table(spark, sf_dir, "events")), compile_rules(ISSUES)), list(ISSUES)))


def _events(df):
    return df.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "props")


def _hours(found):
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "column_name", "invalid", "rows")


@query(
    "events_stream_issues",
    "SELECT 'event_type' AS column_name, count(*) FILTER (WHERE event_type = 'error') AS invalid, count(*) AS rows FROM events "
    "UNION ALL SELECT 'props', count(*) FILTER (WHERE NOT regexp_full_match(props, '^\\{\"k\": \\d\\d\\}$')), count(*) FROM events",
)
def events_stream_issues(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    counts = live.windowed_issues(live.mark_stream(_events(stream), compile_rules(ISSUES)), list(ISSUES))
    found = live.drained(counts)
    return found.groupBy("column_name").agg(F.sum("invalid").alias("invalid"), F.sum("rows").alias("rows"))


@query("row_ids", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS row_id FROM part")
def row_ids(spark, sf_dir):
    return with_row_id(table(spark, sf_dir, "part"), ["p_name", "p_partkey"]).select("p_partkey", "row_id")


@query("first_rows", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50)")
def first_rows(spark, sf_dir):
    return sinks.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)


@query("aligned_union", "SELECT n_nationkey, n_name, NULL AS r_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
def aligned_union(spark, sf_dir):
    return C.aligned_union(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"), "r_regionkey"))


@query("cluster_sizes")
def cluster_sizes(spark, sf_dir):
    df = kept(D.classify(_parts(spark, sf_dir), _window_pairs(spark, sf_dir), "p_partkey"), "classified")
    return L.analyze_clusters(L.cluster_records(df, F.concat_ws(" ", *TEXT), NUMERIC, "p_partkey"))


@query("meta_scores")
def meta_scores(spark, sf_dir):
    df = kept(D.classify(_parts(spark, sf_dir), _window_pairs(spark, sf_dir), "p_partkey"), "classified")
    clustered = L.cluster_records(df, F.concat_ws(" ", *TEXT), NUMERIC, "p_partkey")
    scores = L.meta_classify(clustered, row_id="p_partkey")
    rows = [(m, v["accuracy"], v["precision"], v["recall"], v["f1"]) for m, v in scores.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double")


@query("synthetic_rows")
def synthetic_rows(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    metrics = A.collect_profile(A.profile(df, ["c_acctbal", "c_mktsegment"]))
    patterns = A.collect_patterns(A.infer_patterns(df, ["c_custkey", "c_mktsegment"]))
    return G.synthesize(spark, metrics, patterns, 1000)
