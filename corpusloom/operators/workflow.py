"""Filters, texts, states and reports of the review workflow, as Columns and DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: answers that stand for "nothing known"
EMPTY_ANSWERS = ("", "null", "none", "khong co", "không có", "chua ro", "chưa rõ", "n/a", "unknown")
# fixed values: what an issue adds to the score by which documents are chosen for annotation
ISSUE_WEIGHTS = {
    "low_ocr_quality": 80,
    "ingestion_blocked": 80,
    "retrieval_blocked": 80,
    "relation_missing_evidence": 70,
    "document_code_year_mismatch_filename": 45,
    "legal_status_not_authoritative": 35,
    "missing_document_code": 30,
    "missing_document_type": 30,
    "missing_authority_level": 30,
    "missing_issuing_authority": 30,
    "missing_legal_status": 30,
    "no_structured_provisions": 25,
    "provision_chunk_ratio_high": 20,
    "metadata_pending_review": 10,
    "ingestion_review_required": 10,
    "retrieval_unreviewed": 10,
}
OTHER_ISSUE_WEIGHT = 5
# fixed values: words of the embedding template
UNKNOWN = "Khong ro"
NO_HINTS = "Khong co"
PREFIXED_MODEL = "intfloat/multilingual-e5"


def filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters of those columns whose value is given (not None)."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), df)


def searchable(active: Column, visibility: Column, allow_unreviewed: bool) -> Column:
    """Rows that a search may return."""
    seen = ("indexed_verified", "indexed_unreviewed") if allow_unreviewed else ("indexed_verified",)
    return F.coalesce(active & visibility.isin(*seen), F.lit(False))


def needs_attention(reviewed: Column, risk: Column, issues: Column) -> Column:
    """Not reviewed, or of high risk, or with issues."""
    return (reviewed.isNull() | (reviewed != "reviewed")) | (risk == "high") | (F.coalesce(issues, F.lit(0)) > 0)


def emptyish(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(*EMPTY_ANSWERS), F.lit(True))


def first_filled(*xs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def retrieval_text(*parts: Column) -> Column:
    """Parts joined by a space without null and empty ones."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def embedding_text(fields: list[tuple[str, Column]], content: Column) -> Column:
    """One bracketed line per named field, then the content."""
    lines = [F.concat(F.lit(f"[{name}: "), first_filled(x, F.lit(UNKNOWN)), F.lit("]")) for name, x in fields]
    return F.concat_ws("\n", *lines, F.lit("[Noi dung]"), F.coalesce(content, F.lit("")))


def query_embedding_text(query: Column, hints: Column) -> Column:
    """Template of a query; ``hints`` is an array of preferred terms."""
    joined = F.array_join(F.filter(hints, lambda h: h != ""), ", ")
    return F.concat_ws("\n", F.lit("[Loai truy van: legal_research_query]"), F.concat(F.lit("[Tu khoa uu tien: "), first_filled(joined, F.lit(NO_HINTS)), F.lit("]")), F.lit("[Cau hoi]"), F.trim(query))


def prefixed(text: Column, model: str, kind: str) -> Column:
    """query: or passage: before the text, for the models that were trained so."""
    return F.concat(F.lit("query: " if kind == "query" else "passage: "), text) if model.startswith(PREFIXED_MODEL) else text


def title_like(line: Column) -> Column:
    """At least 60 % of a line's words in upper case, or 70 % (and two) with an upper-case first letter."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    lettered = lambda w: F.regexp_like(w, F.lit(r"\p{L}"))
    n = F.size(words)
    upper = F.size(F.filter(words, lambda w: lettered(w) & (w == F.upper(w))))
    title = F.size(F.filter(words, lambda w: lettered(w) & F.regexp_like(w, F.lit(r"^\p{Lu}"))))
    return (n >= 2) & ((upper >= F.greatest(F.lit(1), F.ceil(n * 0.6))) | (title >= F.greatest(F.lit(2), F.ceil(n * 0.7))))


def findings(x: Column) -> Column:
    """A JSON list of strings as it is, anything else as a list of one; empty if there is nothing."""
    listed = F.from_json(x, "array<string>")
    is_list = F.ltrim(x).startswith("[")
    return F.when(x.isNull() | (F.trim(x) == ""), F.array().cast("array<string>")).when(is_list & listed.isNotNull(), listed).otherwise(F.array(x))


def object_in(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def usage_of(payload: Column) -> Column:
    """Tokens and calls of a provider's answer in either naming scheme: struct of input, output, cached, total, web_calls."""
    read = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(payload, p).cast("long"), F.lit(0)) for p in paths], F.lit(0))
    into, out = read("$.usage.input_tokens", "$.usage.prompt_tokens"), read("$.usage.output_tokens", "$.usage.completion_tokens")
    cached = read("$.usage.input_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cached_tokens")
    total = F.coalesce(F.nullif(F.get_json_object(payload, "$.usage.total_tokens").cast("long"), F.lit(0)), into + out)
    calls = F.from_json(F.get_json_object(payload, "$.output"), "array<struct<type:string>>")
    web = F.coalesce(F.size(F.filter(calls, lambda c: c["type"] == "web_search_call")), F.lit(0))
    return F.struct(into.alias("input"), out.alias("output"), cached.alias("cached"), total.alias("total"), F.greatest(web, F.lit(0)).cast("long").alias("web_calls"))


def selection_score(issues: Column, relations: Column, provision_relations: Column, provisions: Column, risk: Column) -> Column:
    """Weights of issues, capped counts of relations and provisions, and 100 for high risk."""
    weights = F.create_map(*[F.lit(x) for kv in ISSUE_WEIGHTS.items() for x in kv])
    own = F.aggregate(F.coalesce(issues, F.array().cast("array<string>")), F.lit(0), lambda a, i: a + F.coalesce(F.try_element_at(weights, i), F.lit(OTHER_ISSUE_WEIGHT)))
    n = lambda x: F.coalesce(x.cast("long"), F.lit(0))
    part = lambda x, by, cap: F.least(F.floor(n(x) / by).cast("long"), F.lit(cap))
    return own + part(relations, 1, 20) + part(provision_relations, 5, 25) + part(provisions, 200, 20) + F.when(risk == "high", 100).otherwise(0)


def backfill_quality(df: DataFrame) -> DataFrame:
    """Sets ingestion_quality_status, retrieval_visibility and quality_notes from the OCR score and the review status."""
    score, reviewed = F.col("ocr_quality_score"), F.coalesce(F.col("metadata_review_status") == "reviewed", F.lit(False))
    by = lambda low, open_, done: F.when(score < 75, low).when(~reviewed, open_).otherwise(done)
    kept = lambda text: first_filled(F.col("quality_notes"), F.lit(text))
    notes = by(F.lit("ocr_quality_below_blocking_threshold"), kept("metadata_pending_review"), kept("Backfilled from existing reviewed document."))
    return df.withColumns({"ingestion_quality_status": by(F.lit("blocked"), F.lit("review_required"), F.lit("passed")), "retrieval_visibility": by(F.lit("blocked"), F.lit("indexed_unreviewed"), F.lit("indexed_verified")), "quality_notes": notes})


def defer_review(df: DataFrame, ids: DataFrame, note: str, id_col: str = "id") -> DataFrame:
    """Listed rows go back to pending; adds changed (null for rows that are not listed)."""
    listed = ids.select(F.col(id_col).alias("listed_id")).distinct()
    d = df.join(listed, F.col(id_col) == F.col("listed_id"), "left")
    mine, blocked = F.col("listed_id").isNotNull(), F.coalesce(F.col("retrieval_visibility") == "blocked", F.lit(False))
    seen = F.when(mine & ~blocked, "indexed_unreviewed").otherwise(F.col("retrieval_visibility"))
    changed = F.coalesce(F.col("metadata_review_status") != "pending_review", F.lit(True)) | ~seen.eqNullSafe(F.col("retrieval_visibility"))
    status = F.when(F.coalesce(F.col("ingestion_quality_status") == "blocked", F.lit(False)), "blocked").otherwise("review_required")
    return d.withColumns(
        {
            "changed": F.when(mine, changed),
            "retrieval_visibility": seen,
            "metadata_review_status": F.when(mine, "pending_review").otherwise(F.col("metadata_review_status")),
            "ingestion_quality_status": F.when(mine, status).otherwise(F.col("ingestion_quality_status")),
            "review_notes": F.when(mine, F.concat_ws("\n", F.nullif(F.col("review_notes"), F.lit("")), F.lit(note))).otherwise(F.col("review_notes")),
        }
    ).drop("listed_id")


def better_parse(rule_rows: Column, other_rows: Column, failed: Column, score: Column, threshold: int = 60) -> Column:
    """Which parser's rows to take: the other's only after a failure or a low score, and only if it has more."""
    poor = F.coalesce(failed, F.lit(False)) | F.coalesce(score < threshold, F.lit(True))
    return F.when(poor & (F.coalesce(other_rows, F.lit(0)) > F.coalesce(rule_rows, F.lit(0))), "ai_fallback").otherwise("deterministic")


def case_states(escalate: Column, ticket: Column) -> tuple[Column, Column]:
    """Status of the session and of the case after an answer."""
    up = F.coalesce(escalate, F.lit(False))
    return F.when(up & ticket.isNotNull(), "escalated").otherwise("active"), F.when(up, "needs_review").otherwise("analysis_ready")


def escalations(sessions: DataFrame, tickets: DataFrame) -> DataFrame:
    """New tickets of sessions (session_id, confidence) that have none: session_id, status, priority."""
    new = sessions.join(tickets.select("session_id").distinct(), "session_id", "left_anti")
    high = F.coalesce((F.col("confidence") > 0) & (F.col("confidence") < 0.5), F.lit(False))
    return new.select("session_id", F.lit("new").alias("status"), F.when(high, "high").otherwise("normal").alias("priority"))


def replied(status: Column) -> Column:
    return F.when(status.isin("new", "assigned", "in_progress"), "answered").otherwise(status)


def sync_status(found: Column, failed: Column) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)), "failed").when(F.coalesce(found, F.lit(0)) > 0, "synced").otherwise("no_matches")


def shared_limit(first: DataFrame, second: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of one source, then those of the other for the places that are left."""
    a = first.orderBy(*order).limit(limit).withColumn("source", F.lit(1))
    b = second.orderBy(*order).limit(limit).withColumn("source", F.lit(2))
    # at most two times ``limit`` rows
    place = F.row_number().over(Window.orderBy("source", *order))
    return a.unionByName(b).withColumn("place", place).where(F.col("place") <= limit)


def recommended_backend(runs: DataFrame, parity: DataFrame) -> DataFrame:
    """One row: mean milliseconds per backend (backend, avg_ms) and the recommendation given parity (matches boolean)."""
    own = runs.agg(F.avg(F.when(F.col("backend") == "relational", F.col("avg_ms"))).alias("relational_ms"), F.avg(F.when(F.col("backend") == "graph", F.col("avg_ms"))).alias("graph_ms"))
    par = parity.agg(F.count_if("matches").alias("matched"), F.count("*").alias("cases"))
    slow = (F.col("relational_ms") > 0) & (F.col("graph_ms") > 1.5 * F.col("relational_ms"))
    good = (F.col("cases") > 0) & (F.col("matched") == F.col("cases")) & F.coalesce(F.col("relational_ms"), F.col("graph_ms")).isNotNull()
    # both sides are one row
    return own.join(par, F.lit(True)).withColumn("backend", F.when(good & ~F.coalesce(slow, F.lit(False)), "graph").otherwise("relational"))


def with_usage_names(usage: DataFrame, documents: DataFrame) -> DataFrame:
    """Usage (document_id, path, title_then) with document by id, else by path; the name at that time comes before today's."""
    by_path = documents.where("path is not null").groupBy("path").agg(F.min("id").alias("path_id"))
    u = usage.join(by_path, "path", "left").withColumn("document_id", F.coalesce("document_id", "path_id")).drop("path_id")
    named = documents.select(F.col("id").alias("document_id"), F.col("title").alias("title_now"))
    u = u.join(named, "document_id", "left")
    return u.withColumn("title", first_filled(F.col("title_then"), F.col("title_now"), F.lit("Unknown document"))).drop("title_then", "title_now")
