"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bitplane, media, minhash, mixing, neighbours, pieces, pii, separators, suffixes, toxicity
from tidemark.llm.bpe import vocabulary
from tidemark.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return separators.token_counts(docs, vocabulary(), _pattern(), end_id=50256)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return pieces.round_trip(docs, pieces.model_path()).select(
        "doc_id",
        (F.octet_length("piece_ids") / 2).cast("long").alias("n_pieces"),
        F.crc32("piece_ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "bitplane").path("ids")
    bitplane.write_ids(_table(spark, sf_dir, "documents"), path, vocabulary(), _pattern())
    return bitplane.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85, bands=25, rows=5)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size")
    return mixing.plan(Scratch(spark, "mixing").stage(docs, "sizes")).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.candidates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "candidates")
    found = Scratch(spark, "pii").stage(found, "candidates")
    return pii.digest(found, pii.fit(pii.vote_counts(found)))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, raw = media.store(_table(spark, sf_dir, "documents")), media.samples()
    described = files.select(
        "doc_id",
        "n_bytes",
        F.octet_length(raw).cast("long").alias("payload_bytes"),
        F.sha2(raw, 256).alias("payload_sha256"),
        F.crc32(F.substring(raw, -64, 64)).alias("tail_crc32"),
        F.octet_length("wav").cast("long").alias("media_bytes"),
        F.sha2("wav", 256).alias("media_sha256"),
        "wav",
    )
    return media.digested(Scratch(spark, "media").stage(media.audio_features(described), "features"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_id_output": op4_token_id_output,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_pii": op8_pii,
    "op9_media": op9_media,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

ORACLES = {
    "op5_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE
    WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
    "op7_suffix_dedup": r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
k AS (SELECT doc_id, p, substr(x, 2 * p - 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(1, n - 48)) AS p FROM h WHERE n >= 50)),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g),
r AS (SELECT k.doc_id, k.p FROM k JOIN m ON m.g = k.g WHERE m.least < k.doc_id),
b AS (SELECT DISTINCT doc_id, p + o AS q FROM r, (SELECT unnest(range(50)) AS o)),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT follows) AS n_spans
      FROM (SELECT doc_id, coalesce(lag(q) OVER (PARTITION BY doc_id ORDER BY q) = q - 1, false) AS follows FROM b) GROUP BY doc_id),
t AS (SELECT a.doc_id, string_agg(substr(a.x, 2 * a.q - 1, 2), '' ORDER BY a.q) AS x
      FROM (SELECT h.doc_id, h.x, unnest(range(1, h.n + 1)) AS q FROM h WHERE h.doc_id IN (SELECT doc_id FROM c)) a
      LEFT JOIN b ON b.doc_id = a.doc_id AND b.q = a.q WHERE b.q IS NULL GROUP BY a.doc_id)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h.x ELSE coalesce(t.x, '') END)) AS kept_sha256
FROM h LEFT JOIN c ON c.doc_id = h.doc_id LEFT JOIN t ON t.doc_id = h.doc_id""",
}
