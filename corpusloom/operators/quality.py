"""Document quality: sub-scores, total, issue codes, risk and the corpus report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import blank, codes_that_hold, file_base, fold, segments, word_count, years

# Issue codes by risk.
HIGH_RISK = ("no_chunks", "relation_missing_evidence", "low_ocr_quality", "ingestion_blocked", "retrieval_blocked")
MEDIUM_RISK = (
    "metadata_pending_review", "no_structured_provisions", "document_code_year_mismatch_filename", "legal_status_not_authoritative",
    "ingestion_review_required", "retrieval_unreviewed",
)
REQUIRED = ("document_code", "document_type", "authority_level", "issuing_authority", "legal_status")


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))


def metrics(docs: DataFrame, **tables: DataFrame) -> DataFrame:
    """Documents with a count per table, 0 where a document has no rows; a table's key is document_id."""
    out = docs
    for name, table in tables.items():
        out = out.join(count_by(table, "document_id", name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def issue_codes() -> Column:
    c = F.col
    code_years, file_years = years(c("document_code")), years(F.regexp_replace(file_base(c("file_name")), r"\.[^.]*$", ""))
    year_off = (F.size(code_years) > 0) & (F.size(file_years) > 0) & ~F.arrays_overlap(code_years, file_years)
    is_ = lambda name, value: F.coalesce(c(name) == value, F.lit(False))
    return codes_that_hold(
        (~is_("metadata_review_status", "reviewed"), "metadata_pending_review"),
        (is_("ingestion_quality_status", "blocked"), "ingestion_blocked"),
        (is_("ingestion_quality_status", "review_required"), "ingestion_review_required"),
        (is_("retrieval_visibility", "blocked"), "retrieval_blocked"),
        (is_("retrieval_visibility", "indexed_unreviewed"), "retrieval_unreviewed"),
        *((F.coalesce(c(f), F.lit("")) == "", f"missing_{f}") for f in REQUIRED),
        (c("legal_status").isNull() | c("legal_status").isin("unknown", "draft"), "legal_status_not_authoritative"),
        (c("chunk_count") == 0, "no_chunks"),
        (c("provision_count") == 0, "no_structured_provisions"),
        ((c("chunk_count") > 0) & (c("provision_count") > 3 * c("chunk_count")), "provision_chunk_ratio_high"),
        (c("missing_evidence_count") > 0, "relation_missing_evidence"),
        (year_off, "document_code_year_mismatch_filename"),
        (c("ocr_quality_score").cast("double") < 85, "low_ocr_quality"),
    )


def risk(issues: Column) -> Column:
    some = lambda names: F.arrays_overlap(issues, F.array(*map(F.lit, names)))
    return F.when(some(HIGH_RISK), "high").when(some(MEDIUM_RISK) | F.exists(issues, lambda i: F.startswith(i, F.lit("missing_"))), "medium").otherwise("low")


def report(docs: DataFrame) -> DataFrame:
    """Documents with issue_codes and risk_level."""
    return docs.withColumn("issue_codes", issue_codes()).withColumn("risk_level", risk(F.col("issue_codes")))


def issue_counts(reported: DataFrame) -> DataFrame:
    return reported.select(F.explode("issue_codes").alias("issue_code")).groupBy("issue_code").agg(F.count("*").alias("n"))


def missing_evidence(relations: DataFrame, evidence: str) -> DataFrame:
    return relations.where(blank(F.col(evidence)))


def metadata_score(*fields: Column) -> Column:
    return sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 5.0).otherwise(0.0) for f in fields), F.lit(0.0))


def text_scores(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, clean_score, structure_score and chunk_score from text and its chunks (doc_id, section_title, content)."""
    seg = docs.select("doc_id", segments(F.col("text")).alias("s"))
    seg = seg.withColumn("f", F.transform("s", fold))
    count = lambda test: F.size(F.filter("f", test))
    starts = lambda *p: lambda x: x.rlike("^(" + "|".join(p) + ") ")
    size = F.length(F.array_join("s", "\n"))
    n = F.greatest(F.size("s"), F.lit(1))
    short = F.size(F.filter("s", lambda x: word_count(x) <= 3)) / n
    bad = (size - F.length(F.replace(F.array_join("s", "\n"), F.lit("�"), F.lit("")))) / F.greatest(size, F.lit(1))
    clean = 14.0 + F.when(size >= 12000, 8.0).when(size >= 3000, 6.0).when(size >= 1000, 3.0).otherwise(0.0) + F.greatest(F.lit(0.0), 6.0 - short * 18.0) + F.greatest(F.lit(0.0), 2.0 - bad * 200.0)
    shape = (
        F.least(F.lit(12.0), count(starts("dieu")) * 2.5) + F.least(F.lit(6.0), count(starts("phan", "chuong", "muc")) * 2.0)
        + F.least(F.lit(3.0), count(lambda x: x.rlike(r"^\d+\.")) * 0.5) + F.least(F.lit(2.0), count(lambda x: x.rlike(r"^[a-z][\)\.]\s+")) * 0.35)
    )
    base = seg.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(30.0), clean)).alias("clean_score"), shape.alias("shape"), (F.size("s") > 0).alias("has_text"))
    length = F.length("content")
    per_doc = chunks.where(length > 0).groupBy("doc_id").agg(
        F.avg(length).alias("mean"), F.count("*").alias("n"), F.avg(F.when(length < 160, 1.0).otherwise(0.0)).alias("short"), F.avg(F.when(length > 4000, 1.0).otherwise(0.0)).alias("long"),
        F.count_if((F.col("section_title") != "") & (F.lower("section_title") != "preamble")).alias("titled"),
    )
    band = F.when(F.col("mean").between(300, 2200), 10.0).when(F.col("mean").between(180, 3000), 7.0).otherwise(4.0)
    many = F.when(F.col("n") > 1, 4.0).otherwise(0.0) + F.when(F.col("n") > 5, 2.0).otherwise(0.0)
    chunk = F.least(F.lit(20.0), band + many + F.greatest(F.lit(0.0), 4.0 - F.col("short") * 8.0) + F.greatest(F.lit(0.0), 4.0 - F.col("long") * 10.0))
    out = base.join(per_doc.select("doc_id", chunk.alias("chunk_score"), "titled"), "doc_id", "left")
    titled = F.least(F.lit(4.0), F.coalesce("titled", F.lit(0)) * 0.35)
    return out.select("doc_id", "has_text", "clean_score", F.least(F.lit(25.0), F.col("shape") + titled).alias("structure_score"), F.coalesce("chunk_score", F.lit(0.0)).alias("chunk_score"))


def direct_total(clean: Column, structure: Column, meta: Column, chunk: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 15.0 + clean + structure + meta + chunk)), 2)


def direct_label(score: Column) -> Column:
    return F.when(score >= 65, "direct_text_high").when(score >= 55, "direct_text_medium").otherwise("direct_text_low")


def scanned_total(confidence: Column, clean: Column, structure: Column, meta: Column, chunk: Column) -> Column:
    total = confidence * 0.70 + structure / 25.0 * 12.0 + meta / 25.0 * 8.0 + chunk / 20.0 * 7.0 + clean / 30.0 * 3.0
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def scanned_label(score: Column) -> Column:
    return F.when(score >= 90, "ocr_high").when(score >= 80, "ocr_medium").otherwise("ocr_low")
