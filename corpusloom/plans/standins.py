"""The engine's tables as made from the driver's tables, and the same as SQL.

documents stand for documents, labels for review states, embeddings for chunk vectors,
events for the usage log, conversations for messages, orders for tickets, lineitem for citations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("bo-luat", "luat", "nghi-quyet", "nghi-dinh", "thong-tu", "quyet-dinh", "chi-thi", "an-le", "khac")
AUTHORITIES = ("quoc-hoi", "chinh-phu", "bo", "uy-ban-nhan-dan", "khac")
STATUSES = ("active", "expired", "active", "repealed", "draft", "unknown", "active")
DAY = "2026-01-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with metadata that follow from the id, and review states from the labels."""
    i = F.col("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    year = (i % 25 + 2000).cast("string")
    level = F.when(i % 4 == 0, (i % 13 * 10).cast("int"))
    score = F.when(i % 6 != 0, (i % 41 + 60).cast("double"))
    day = lambda m, off: F.date_add(F.lit("2025-06-01").cast("date"), ((i * m) % 400 + off).cast("int"))
    status = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "review_required").when(F.col("quality") == 1, "passed").otherwise("pending")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        i.alias("id"), "text", F.substring(F.substring_index("text", "\n", 1), 1, 200).alias("title"),
        F.concat(F.lit("doc_"), i, F.lit("_"), year, F.lit(".txt")).alias("file_name"),
        F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit("/"), (i % 24 + 2000).cast("string"), F.lit("/QH"))).alias("document_code"),
        F.when(i % 10 != 0, _pick(TYPES, i)).alias("document_type"), F.when(i % 7 != 0, _pick(AUTHORITIES, i)).alias("authority_level"),
        F.when(i % 4 != 0, F.col("source")).alias("issuing_authority"), level.alias("normative_level"), F.when(i % 11 != 0, _pick(STATUSES, i)).alias("legal_status"),
        F.col("lang").alias("legal_domain"), F.col("source").alias("source_reference"), F.when(i % 5 != 0, day(7, 0)).alias("effective_date"), F.when(i % 3 == 1, day(11, 60)).alias("expiry_date"), day(3, -300).alias("signed_date"),
        F.when(F.col("quality") == 1, "reviewed").otherwise("pending_review").alias("metadata_review_status"), status.alias("ingestion_quality_status"),
        F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "indexed_verified").otherwise("indexed_unreviewed").alias("retrieval_visibility"),
        score.alias("ocr_quality_score"), F.when(i % 6 == 0, "direct_text_high").when(score >= 90, "ocr_high").when(score >= 80, "ocr_medium").otherwise("ocr_low").alias("ocr_quality_label"),
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


DOCUMENTS_SQL = f"""
kd AS (
    SELECT d.doc_id AS id, d.text, substr(split_part(d.text, chr(10), 1), 1, 200) AS title,
        'doc_' || d.doc_id || '_' || (d.doc_id % 25 + 2000) || '.txt' AS file_name,
        CASE WHEN d.doc_id % 3 = 0 THEN d.doc_id || '/' || (d.doc_id % 24 + 2000) || '/QH' END AS document_code,
        CASE WHEN d.doc_id % 10 <> 0 THEN {_list(TYPES)}[d.doc_id % {len(TYPES)} + 1] END AS document_type,
        CASE WHEN d.doc_id % 7 <> 0 THEN {_list(AUTHORITIES)}[d.doc_id % {len(AUTHORITIES)} + 1] END AS authority_level,
        CASE WHEN d.doc_id % 4 <> 0 THEN d.source END AS issuing_authority,
        CASE WHEN d.doc_id % 4 = 0 THEN (d.doc_id % 13 * 10)::INTEGER END AS normative_level,
        CASE WHEN d.doc_id % 11 <> 0 THEN {_list(STATUSES)}[d.doc_id % {len(STATUSES)} + 1] END AS legal_status,
        d.lang AS legal_domain, d.source AS source_reference,
        CASE WHEN d.doc_id % 5 <> 0 THEN DATE '2025-06-01' + ((d.doc_id * 7) % 400)::INTEGER END AS effective_date,
        CASE WHEN d.doc_id % 3 = 1 THEN DATE '2025-06-01' + ((d.doc_id * 11) % 400 + 60)::INTEGER END AS expiry_date,
        DATE '2025-06-01' + ((d.doc_id * 3) % 400 - 300)::INTEGER AS signed_date,
        CASE WHEN l.quality = 1 THEN 'reviewed' ELSE 'pending_review' END AS metadata_review_status,
        CASE WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 0 THEN 'review_required' WHEN l.quality = 1 THEN 'passed' ELSE 'pending' END AS ingestion_quality_status,
        CASE WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 1 THEN 'indexed_verified' ELSE 'indexed_unreviewed' END AS retrieval_visibility,
        CASE WHEN d.doc_id % 6 <> 0 THEN (d.doc_id % 41 + 60)::DOUBLE END AS ocr_quality_score,
        CASE WHEN d.doc_id % 6 = 0 THEN 'direct_text_high' WHEN d.doc_id % 41 + 60 >= 90 THEN 'ocr_high' WHEN d.doc_id % 41 + 60 >= 80 THEN 'ocr_medium' ELSE 'ocr_low' END AS ocr_quality_label
    FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    model = _pick(("gpt-4.1", "gpt-4.1-mini", "gpt-5.4", "gpt-5.4-mini", "other"), F.col("event_id"))
    cost = F.col("value").cast("decimal(18,6)")
    return e.select("event_id", F.col("event_type").alias("request_type"), F.col("user_id").alias("document_id"), k.alias("tokens"), cost.alias("cost"), model.alias("model"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))


USAGE_SQL = """
usage AS (
    SELECT event_id, event_type AS request_type, user_id AS document_id, coalesce((props::JSON->>'k')::BIGINT, 0) AS tokens, value::DECIMAL(18,6) AS cost,
        ['gpt-4.1', 'gpt-4.1-mini', 'gpt-5.4', 'gpt-5.4-mini', 'other'][event_id % 5 + 1] AS model,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS created_at
    FROM events
)"""

#: document graph: each document cites three others, by arithmetic on ids
EDGES_SQL = """
edges AS (
    SELECT DISTINCT doc_id AS src, (doc_id * 7 + 3 * k) % (SELECT max(doc_id) + 1 FROM documents) AS dst
    FROM documents, (VALUES (1), (2)) t(k) WHERE doc_id % 3 <> 0 AND doc_id <> (doc_id * 7 + 3 * k) % (SELECT max(doc_id) + 1 FROM documents)
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg((F.max("doc_id") + 1).alias("n"))
    rows = d.where("doc_id % 3 <> 0").join(F.broadcast(n), F.lit(True)).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 7 + 3 * F.col("k")) % F.col("n")).alias("dst")).where("src <> dst").distinct()
