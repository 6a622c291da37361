"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    clusters,
    decontaminate,
    exact_dedup,
    infill,
    licenses,
    media,
    ngram_join,
    packing,
    pieces,
    pii,
    secrets,
    toxicity,
    warc,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json as ranks
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).drop("copies")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_text(table(spark, sf_dir, "documents"))
    return media.decode(stored, keep_payload=False).drop("payload", "phash", "error")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learnt(docs, table(spark, sf_dir, "labels")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
u AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM u
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.tokenised(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return packing.packed(found).drop("uid")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECES)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"), 4, ngram_join.Likeness(85, 100))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.indexed(table(spark, sf_dir, "documents"))
    found = decontaminate.contamination(index, table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)).drop("item_ids")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.restored(infill.transformed(infill.framed(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_media": op2_media,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_pieces": op9_pieces,
    "op10_ngram_join": op10_ngram_join,
    "op11_clusters": op11_clusters,
    "op12_decontamination": op12_decontamination,
    "op13_infill": op13_infill,
}
ORACLES: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op8_licenses": licenses.oracle(),
    "op11_clusters": clusters.oracle(),
    "op12_decontamination": decontaminate.ORACLE,
    "op13_infill": infill.ORACLE,
}
