"""Queries of rules, quality, reports and identity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import clamp
from corpusloom.operators import identity, qa, quality, reports, retrieval, rules
from corpusloom.operators.ordering import natural_key, page, positions

from .standins import DAY, DOCUMENTS_SQL, USAGE_SQL, documents, table, usage


def today():
    """The reference date; a function, since a Column needs a session and this module is imported without one."""
    return F.lit(DAY).cast("date")


def _measured(spark, sf):
    """Documents with chunk, provision and evidence counts from the driver's tables."""
    d = documents(spark, sf)
    chunks = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    provisions = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"))
    relations = table(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.when(F.col("page_id") % 9 != 0, F.col("url")).alias("legal_basis"))
    return quality.metrics(d, chunk_count=chunks, provision_count=provisions, missing_evidence_count=quality.missing_evidence(relations, "legal_basis"))


def corpus_quality_report(spark, sf):
    r = quality.report(_measured(spark, sf))
    return r.select("id", "chunk_count", "provision_count", F.array_join("issue_codes", ",").alias("issue_codes"), "risk_level")


def issue_code_counts(spark, sf):
    return quality.issue_counts(quality.report(_measured(spark, sf)))


ISSUES_SQL = f"""
{DOCUMENTS_SQL}, measured AS (
    SELECT kd.*, coalesce(c.n, 0) AS chunk_count, coalesce(p.n, 0) AS provision_count, coalesce(e.n, 0) AS missing_evidence_count
    FROM kd LEFT JOIN (SELECT vec_id AS id, count(*) AS n FROM embeddings GROUP BY 1) c USING (id)
        LEFT JOIN (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1) p USING (id)
        LEFT JOIN (SELECT page_id AS id, count(*) AS n FROM pages WHERE page_id % 9 = 0 GROUP BY 1) e USING (id)
), issues AS (
    SELECT id, chunk_count, provision_count, list_filter([
        CASE WHEN metadata_review_status <> 'reviewed' THEN 'metadata_pending_review' END,
        CASE ingestion_quality_status WHEN 'blocked' THEN 'ingestion_blocked' WHEN 'review_required' THEN 'ingestion_review_required' END,
        CASE retrieval_visibility WHEN 'blocked' THEN 'retrieval_blocked' WHEN 'indexed_unreviewed' THEN 'retrieval_unreviewed' END,
        CASE WHEN document_code IS NULL THEN 'missing_document_code' END, CASE WHEN document_type IS NULL THEN 'missing_document_type' END,
        CASE WHEN authority_level IS NULL THEN 'missing_authority_level' END, CASE WHEN issuing_authority IS NULL THEN 'missing_issuing_authority' END,
        CASE WHEN legal_status IS NULL THEN 'missing_legal_status' END, CASE WHEN legal_status IS NULL OR legal_status IN ('unknown', 'draft') THEN 'legal_status_not_authoritative' END,
        CASE WHEN chunk_count = 0 THEN 'no_chunks' END, CASE WHEN provision_count = 0 THEN 'no_structured_provisions' END,
        CASE WHEN chunk_count > 0 AND provision_count > 3 * chunk_count THEN 'provision_chunk_ratio_high' END,
        CASE WHEN missing_evidence_count > 0 THEN 'relation_missing_evidence' END,
        CASE WHEN document_code IS NOT NULL AND len(list_intersect(regexp_extract_all(document_code, '(?:19|20)[0-9]{{2}}'), regexp_extract_all(replace(file_name, '.txt', ''), '(?:19|20)[0-9]{{2}}'))) = 0 THEN 'document_code_year_mismatch_filename' END,
        CASE WHEN ocr_quality_score < 85 THEN 'low_ocr_quality' END
    ], lambda x: x IS NOT NULL) AS codes FROM measured
)"""


def validity(spark, sf):
    v = rules.validity(documents(spark, sf), today())
    return v.select("id", "status", "is_effective", "is_authoritative", F.array_join("reasons", " | ").alias("reasons"))


def hierarchy(spark, sf):
    return documents(spark, sf).select("id", rules.priority(F.col("document_type"), F.col("authority_level"), F.col("normative_level")).alias("priority"))


def conflict_pair(spark, sf):
    d = documents(spark, sf).select("id", rules.effective(F.col("legal_status"), F.col("effective_date"), F.col("expiry_date"), today()).alias("valid"), rules.priority(F.col("document_type"), F.col("authority_level"), F.col("normative_level")).alias("priority"), "signed_date")
    side = lambda p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in d.columns))
    pairs = side("l").join(side("r"), F.col("l_id") + 1 == F.col("r_id"))
    return rules.conflicts(pairs).select("l_id", "r_id", "winner_id", "basis")


def priority_boost(spark, sf):
    d = documents(spark, sf)
    boost = retrieval.priority_boost(F.col("normative_level"), F.col("legal_status"), F.col("effective_date"), F.col("ocr_quality_label"), F.col("ocr_quality_score"), F.col("metadata_review_status"), today())
    return d.select("id", boost.cast("int").alias("boost"), F.round(clamp(boost / 100, -0.12, 0.12), 4).alias("clamped"))


def quality_gate(spark, sf):
    d = _measured(spark, sf).withColumn("review_status", F.col("metadata_review_status")).withColumn("parser_source", F.when(F.col("id") % 13 == 0, "ai_fallback").otherwise("rules"))
    return rules.gate(d).select("id", "gate_status", "visibility", "gate_notes")


def metadata_scores(spark, sf):
    fields = [F.col(c) for c in ("document_code", "document_type", "issuing_authority", "authority_level", "signed_date")]
    d = documents(spark, sf).select("id", quality.metadata_score(*fields).alias("meta"))
    total = quality.direct_total(F.lit(20.0), F.col("id") % 25 + F.lit(0.0), F.col("meta"), F.lit(12.0))
    return d.select("id", "meta", total.alias("score"), quality.direct_label(total).alias("label"))


def usage_overview(spark, sf):
    return reports.usage_overview(usage(spark, sf))


def usage_by_day(spark, sf):
    return reports.usage_by_day(usage(spark, sf)).withColumn("day", F.col("day").cast("string"))


def usage_by_document(spark, sf):
    return reports.usage_by_document(usage(spark, sf))


def token_cost(spark, sf):
    u = usage(spark, sf)
    cost = reports.token_cost(F.col("model"), F.col("tokens") * 100, F.col("tokens") * 20, F.col("tokens") * 7, F.col("event_id") % 3)
    return u.select("event_id", cost.alias("usd"))


def overview_counts(spark, sf):
    names = ("documents", "labels", "pages", "embeddings", "conversations", "benchmark", "events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region")
    return reports.counts(**{n: table(spark, sf, n) for n in names})


def distinct_documents(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.count_if(F.col("l_returnflag").isin("A", "R")).alias("returned"), F.count_if(~F.col("l_linestatus").isin("O")).alias("closed"))


def conditional_counts(spark, sf):
    d = documents(spark, sf)
    n = lambda s: F.sum(F.when(F.col("ingestion_quality_status") == s, 1).otherwise(0)).alias(s)
    return d.groupBy("legal_domain").agg(F.count("*").alias("total"), n("passed"), n("review_required"), n("blocked"), n("pending"))


def embedding_status(spark, sf):
    v = table(spark, sf, "embeddings").select((F.col("vec_id") % 97).alias("document_id"), (F.col("vec_id") * 31 % 10).alias("m"))
    per = v.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(F.col("m") < 7).alias("indexed"), F.count_if(F.col("m") == 9).alias("failed"))
    return per.select("document_id", "total", "indexed", "failed", retrieval.embedding_status(per, "total", "indexed", "failed").alias("status"))


def review_queues(spark, sf):
    d = documents(spark, sf)
    q = lambda test, severity, key: d.where(test).select("id", severity.alias("severity"), key.alias("order_key"))
    score = F.coalesce(F.col("ocr_quality_score"), F.lit(0.0))
    rows = reports.queues(
        20, ocr=q(score < 85, F.when(score < 75, "high").otherwise("medium"), score), metadata=q(F.col("metadata_review_status") != "reviewed", F.lit("medium"), F.lit(0.0)),
        ingestion=q(F.col("ingestion_quality_status").isin("blocked", "review_required"), F.when(F.col("ingestion_quality_status") == "blocked", "high").otherwise("low"), F.lit(0.0)),
    )
    return reports.queue_summary(rows)


def recent_activity(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("ticket").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    e = table(spark, sf, "events").select(F.lit("usage").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    li = table(spark, sf, "lineitem").select(F.lit("citation").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("at"))
    out = reports.merged_feed(25, "at", o, e, li)
    return out.select("kind", "id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def quota_then_fill(spark, sf):
    d = documents(spark, sf).select("id", F.col("legal_domain").alias("grp"), (F.col("id") * 37 % 101).alias("score"))
    return reports.quota_then_fill(d, {"en": 10, "fr": 10, "de": 8}, 40)


def duplicate_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), identity.content_hash(F.col("text")).alias("content_sha256"))
    return d.groupBy("content_sha256").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def duplicate_report(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("file_name"), identity.content_hash(F.col("text")).alias("content_sha256"), F.lit(None).cast("string").alias("source_identity"))
    return identity.duplicate_of(d).select("id", "duplicate_of", F.array_join("fields", ",").alias("fields"))


def unique_file_names(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("slug"))
    return identity.unique_names(c, "slug", "c_custkey")


def latest_run(spark, sf):
    o = table(spark, sf, "orders")
    return identity.last_per_key(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def anti_join_no_children(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


def ticket_bundle(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", "o_orderstatus", "parts")


def pinned_order(spark, sf):
    n = table(spark, sf, "nation")
    pin = F.coalesce(F.try_element_at(F.create_map(F.lit("FRANCE"), F.lit(1), F.lit("GERMANY"), F.lit(2), F.lit("NATION_3"), F.lit(3)), F.col("n_name")), F.lit(1000))
    return positions(n, pin, F.lower("n_name"), F.col("n_nationkey")).select("n_nationkey", "n_name", "place")


def page_slice(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return page(p, 3, 20, F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey", "p_name", "place")


def catalog_order(spark, sf):
    """Places of all documents by title, by the label of their status and by signed date, downwards, as a reader of the language sorts them."""
    d = documents(spark, sf).select("id", "title", "file_name", "legal_status", "signed_date")
    label = F.try_element_at(F.create_map(*(F.lit(x) for pair in STATUS_LABELS for x in pair)), F.col("legal_status"))
    own = F.col("id")
    by_title = positions(d, natural_key(F.concat_ws(" ", "title", "file_name")), own, name="by_title")
    by_status = positions(by_title, natural_key(F.coalesce(label, F.lit(UNKNOWN_LABEL))), own, name="by_status")
    by_date = positions(by_status, F.desc(F.coalesce(F.col("signed_date").cast("string"), F.lit(""))), own, name="by_date")
    return by_date.select("id", "by_title", "by_status", "by_date")


# What a reader sees for a status.
STATUS_LABELS = (("active", "Còn hiệu lực"), ("expired", "Hết hiệu lực"), ("repealed", "Bị bãi bỏ"), ("draft", "Dự thảo"))
UNKNOWN_LABEL = "Chưa rõ"
_FILLED_DIGITS = "array_to_string(list_transform(regexp_extract_all({0}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') AND length(p) < 24 THEN lpad(p, 24, '0') ELSE p END), '')"
# a sort key's first level, up to the first separator, holds the base letters
_BASE = "regexp_extract(icu_sort_key(" + _FILLED_DIGITS + ", 'vi'), '^((?:[0-9A-Fa-f]{{2}})*?)01', 1)"
_LABEL = " ".join(f"WHEN '{status}' THEN '{label}'" for status, label in STATUS_LABELS)
CATALOG_SQL = f"""WITH {DOCUMENTS_SQL}
SELECT id, row_number() OVER (ORDER BY {_BASE.format("(title || ' ' || file_name)")}, id) AS by_title, row_number() OVER (ORDER BY {_BASE.format(f"(CASE legal_status {_LABEL} ELSE '{UNKNOWN_LABEL}' END)")}, id) AS by_status,
    row_number() OVER (ORDER BY coalesce(signed_date::VARCHAR, '') DESC, id) AS by_date FROM kd"""


def last_messages(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("n", n).where("n <= 6").select("conv_id", "turn", "role", "n")


def outer_join_residual(spark, sf):
    """The test of the right side is part of the join, so left rows stay."""
    d, v = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "embeddings").select("vec_id", "label")
    return d.join(v, (d["doc_id"] == v["vec_id"]) & (v["label"] == 1), "left").select("doc_id", "vec_id", "label")


def definition_counts(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.join(per, n["n_nationkey"] == per["c_nationkey"], "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("in_use"))


def understanding(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") % len(PHRASES) + 1).cast("int")), "text").alias("text"))
    return qa.understand(c).select("conv_id", "turn", "domain", "intent", "complexity")


PHRASES = ("Tôi muốn nghỉ việc thì cần gì?", "Văn bản này còn hiệu lực không?", "Tranh chấp quyền sử dụng đất", "So sánh hai điều", "Ly hôn", "xin chào")
_FOLDED = "trim(regexp_replace(replace(strip_accents(lower(t)), 'đ', 'd'), '\\s+', ' ', 'g'))"


def _has(terms) -> str:
    return "(" + " OR ".join(f"contains(f, '{t}')" for t in terms) + ")"


def validation_score(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select(
        F.col("o_orderkey").alias("answer_id"), (F.col("o_orderkey") % 4).alias("n_results"), (F.col("o_orderkey") % 3).alias("n_authoritative"), (F.col("o_orderkey") % 7 == 0).alias("unresolved_conflict"),
        F.when(F.col("o_orderstatus") == "O", "high").when(F.col("o_orderstatus") == "F", "medium").otherwise("low").alias("complexity"),
    )
    return qa.base_validation(a).select("answer_id", "confidence", "escalate", "status")


def case_facts_dedupe(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("case_id"), F.col("l_returnflag").alias("fact_key"), F.col("l_linestatus").alias("fact_value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    known = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("case_id"), F.lit("A").alias("fact_key"), F.lit("f").alias("fact_value"))
    return qa.new_facts(f, known, keep=3).select("case_id", "fact_key", "fact_value", "seq", "place")


def escalation_priority(spark, sf):
    t = table(spark, sf, "orders")
    first = identity.first_wins(t, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", F.when(F.col("o_totalprice") < 100000, "high").otherwise("normal").alias("priority"))


_RANK = lambda col, ranks: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 0 END"
_PRIORITY = f"coalesce(normative_level, greatest({_RANK('document_type', rules.TYPE_RANK)}, {_RANK('authority_level', rules.AUTHORITY_RANK)}))"
_VALID = f"(coalesce(legal_status, 'unknown') = 'active' AND (effective_date IS NULL OR effective_date <= DATE '{DAY}') AND (expiry_date IS NULL OR expiry_date >= DATE '{DAY}'))"
_PRICE = lambda i: "CASE model " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in reports.PRICES.items()) + " END"

REPORT_QUERIES = {
    "corpus_quality_report": (
        corpus_quality_report,
        f"""WITH {ISSUES_SQL} SELECT id, chunk_count, provision_count, array_to_string(codes, ',') AS issue_codes,
        CASE WHEN len(list_intersect(codes, [{', '.join(f"'{x}'" for x in quality.HIGH_RISK)}])) > 0 THEN 'high'
            WHEN len(list_intersect(codes, [{', '.join(f"'{x}'" for x in quality.MEDIUM_RISK)}])) > 0 OR len(list_filter(codes, lambda c: starts_with(c, 'missing_'))) > 0 THEN 'medium' ELSE 'low' END AS risk_level FROM issues""",
    ),
    "issue_code_counts": (issue_code_counts, f"WITH {ISSUES_SQL} SELECT issue_code, count(*) AS n FROM (SELECT unnest(codes) AS issue_code FROM issues) GROUP BY 1"),
    "validity": (
        validity,
        f"""WITH {DOCUMENTS_SQL}, s AS (SELECT *, coalesce(legal_status, 'unknown') AS status, {_VALID} AS ok FROM kd), r AS (
            SELECT *, list_filter([CASE WHEN status IN ('expired', 'repealed', 'draft', 'unknown') THEN 'Document status is marked as ' || status || '.' END,
                CASE WHEN effective_date > DATE '{DAY}' THEN 'Document becomes effective on ' || effective_date::VARCHAR || '.' END,
                CASE WHEN expiry_date < DATE '{DAY}' THEN 'Document expired on ' || expiry_date::VARCHAR || '.' END], lambda x: x IS NOT NULL) AS why FROM s)
        SELECT id, status, ok AS is_effective, ok AS is_authoritative, CASE WHEN ok AND len(why) = 0 THEN 'Document is active within the evaluated date range.' ELSE array_to_string(why, ' | ') END AS reasons FROM r""",
    ),
    "hierarchy": (hierarchy, f"WITH {DOCUMENTS_SQL} SELECT id, ({_PRIORITY})::INTEGER AS priority FROM kd"),
    "conflict_pair": (
        conflict_pair,
        f"""WITH {DOCUMENTS_SQL}, d AS (SELECT id, {_VALID} AS valid, {_PRIORITY} AS priority, signed_date FROM kd)
        SELECT l.id AS l_id, r.id AS r_id,
            CASE WHEN l.valid AND NOT r.valid THEN l.id WHEN r.valid AND NOT l.valid THEN r.id WHEN l.priority > r.priority THEN l.id WHEN l.priority < r.priority THEN r.id
                WHEN l.signed_date > r.signed_date THEN l.id WHEN l.signed_date < r.signed_date THEN r.id END AS winner_id,
            CASE WHEN l.valid <> r.valid THEN 'validity' WHEN l.priority <> r.priority THEN 'hierarchy' WHEN l.signed_date <> r.signed_date THEN 'temporal_override' ELSE 'unresolved' END AS basis
        FROM d l JOIN d r ON l.id + 1 = r.id""",
    ),
    "priority_boost": (
        priority_boost,
        f"""WITH {DOCUMENTS_SQL}, b AS (SELECT id, greatest(coalesce(normative_level, 0) // 10, 0)
            + CASE coalesce(legal_status, 'active') WHEN 'active' THEN 6 WHEN 'expired' THEN -8 WHEN 'repealed' THEN -12 WHEN 'draft' THEN -4 ELSE 0 END
            + CASE WHEN effective_date <= DATE '{DAY}' THEN 2 ELSE 0 END
            + CASE WHEN starts_with(ocr_quality_label, 'direct_text') THEN 10 WHEN ocr_quality_label = 'ocr_high' THEN 5 WHEN ocr_quality_label = 'ocr_medium' THEN -1 WHEN ocr_quality_label = 'ocr_low' THEN -8 ELSE 0 END
            + CASE WHEN ocr_quality_score >= 95 THEN 4 WHEN ocr_quality_score >= 90 THEN 2 WHEN ocr_quality_score < 85 THEN -4 ELSE 0 END
            + CASE WHEN metadata_review_status = 'pending_review' AND ocr_quality_score < 85 THEN -3 ELSE 0 END AS boost FROM kd)
        SELECT id, boost::INTEGER AS boost, round(greatest(-0.12, least(0.12, boost / 100)), 4)::DOUBLE AS clamped FROM b""",
    ),
    "quality_gate": (
        quality_gate,
        f"""WITH {ISSUES_SQL}, g AS (SELECT id, list_filter([CASE WHEN length(trim(text)) < 200 THEN 'extracted_text_too_short' END, CASE WHEN chunk_count = 0 THEN 'no_chunks' END,
                CASE WHEN ocr_quality_score < 75 THEN 'ocr_quality_below_blocking_threshold' END], lambda x: x IS NOT NULL) AS blocking,
            list_filter([CASE WHEN ocr_quality_score >= 75 AND ocr_quality_score < 85 THEN 'ocr_quality_requires_review' END, CASE WHEN provision_count = 0 THEN 'no_structured_provisions' END,
                CASE WHEN id % 13 = 0 THEN 'ai_fallback_parser_used' END, CASE WHEN metadata_review_status <> 'reviewed' THEN 'metadata_pending_review' END], lambda x: x IS NOT NULL) AS review FROM measured)
        SELECT id, CASE WHEN len(blocking) > 0 THEN 'blocked' WHEN len(review) > 0 THEN 'review_required' ELSE 'passed' END AS gate_status,
            CASE WHEN len(blocking) > 0 THEN 'blocked' WHEN len(review) > 0 THEN 'indexed_unreviewed' ELSE 'indexed_verified' END AS visibility,
            CASE WHEN len(blocking) + len(review) = 0 THEN 'Ingestion quality gate passed.' ELSE array_to_string(list_concat(blocking, review), '; ') END AS gate_notes FROM g""",
    ),
    "metadata_scores": (
        metadata_scores,
        f"""WITH {DOCUMENTS_SQL}, m AS (SELECT id, 5.0::DOUBLE * ((document_code IS NOT NULL)::INT + (document_type IS NOT NULL)::INT + (issuing_authority IS NOT NULL)::INT + (authority_level IS NOT NULL)::INT + 1) AS meta FROM kd),
        s AS (SELECT id, meta, least(100, 15 + 20 + id % 25 + meta + 12)::DOUBLE AS score FROM m)
        SELECT id, meta, score, CASE WHEN score >= 65 THEN 'direct_text_high' WHEN score >= 55 THEN 'direct_text_medium' ELSE 'direct_text_low' END AS label FROM s""",
    ),
    "usage_overview": (usage_overview, f"WITH {USAGE_SQL} SELECT count(*) AS requests, count(*) FILTER (status = 'success') AS succeeded, sum(tokens)::BIGINT AS tokens, sum(cost) AS cost FROM usage"),
    "usage_by_day": (usage_by_day, f"WITH {USAGE_SQL} SELECT created_at::DATE::VARCHAR AS day, count(*) AS requests, sum(tokens)::BIGINT AS tokens, sum(cost) AS cost FROM usage GROUP BY 1 ORDER BY 1 DESC LIMIT 14"),
    "usage_by_document": (
        usage_by_document,
        f"WITH {USAGE_SQL} SELECT document_id, count(*) AS requests, sum(cost) AS cost, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM usage GROUP BY 1 ORDER BY cost DESC, requests DESC, document_id LIMIT 20",
    ),
    "token_cost": (
        token_cost,
        f"""WITH {USAGE_SQL} SELECT event_id, CASE WHEN {_PRICE(0)} IS NOT NULL OR event_id % 3 > 0 THEN round((coalesce((tokens * 80) * {_PRICE(0)}, 0) + coalesce((tokens * 20) * {_PRICE(1)}, 0) + coalesce((tokens * 7) * {_PRICE(2)}, 0))::DECIMAL(28,8) * 0.000001::DECIMAL(7,6)
        + (event_id % 3) * 0.01, 6)::DECIMAL(18,6) END AS usd FROM usage""",
    ),
    "overview_counts": (
        overview_counts,
        " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "labels", "pages", "embeddings", "conversations", "benchmark", "events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region")),
    ),
    "distinct_documents": (distinct_documents, "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_returnflag IN ('A', 'R')) AS returned, count(*) FILTER (l_linestatus NOT IN ('O')) AS closed FROM lineitem"),
    "conditional_counts": (
        conditional_counts,
        f"WITH {DOCUMENTS_SQL} SELECT legal_domain, count(*) AS total, " + ", ".join(f"count(*) FILTER (ingestion_quality_status = '{s}') AS {s}" for s in ("passed", "review_required", "blocked", "pending")) + " FROM kd GROUP BY 1",
    ),
    "embedding_status": (
        embedding_status,
        """WITH p AS (SELECT vec_id % 97 AS document_id, count(*) AS total, count(*) FILTER (vec_id * 31 % 10 < 7) AS indexed, count(*) FILTER (vec_id * 31 % 10 = 9) AS failed FROM embeddings GROUP BY 1)
        SELECT *, CASE WHEN total = 0 THEN 'not_indexed' WHEN indexed = total THEN 'indexed' WHEN indexed > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'pending' END AS status FROM p""",
    ),
    "review_queues": (
        review_queues,
        f"""WITH {DOCUMENTS_SQL}, o AS (SELECT 'ocr' AS queue, id, CASE WHEN coalesce(ocr_quality_score, 0) < 75 THEN 'high' ELSE 'medium' END AS severity FROM kd WHERE coalesce(ocr_quality_score, 0) < 85 ORDER BY coalesce(ocr_quality_score, 0), id LIMIT 20),
        m AS (SELECT 'metadata' AS queue, id, 'medium' AS severity FROM kd WHERE metadata_review_status <> 'reviewed' ORDER BY id LIMIT 20),
        i AS (SELECT 'ingestion' AS queue, id, CASE ingestion_quality_status WHEN 'blocked' THEN 'high' ELSE 'low' END AS severity FROM kd WHERE ingestion_quality_status IN ('blocked', 'review_required') ORDER BY id LIMIT 20)
        SELECT queue, count(*) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
        FROM (FROM o UNION ALL FROM m UNION ALL FROM i) GROUP BY 1""",
    ),
    "recent_activity": (
        recent_activity,
        """WITH a AS (SELECT 'ticket' AS kind, o_orderkey AS id, o_orderdate::TIMESTAMP AS ts FROM orders UNION ALL SELECT 'usage', event_id, ts::TIMESTAMP FROM events
            UNION ALL SELECT 'citation', l_orderkey * 10 + l_linenumber, l_shipdate::TIMESTAMP FROM lineitem)
        SELECT kind, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at" FROM (SELECT * FROM a ORDER BY ts DESC, kind, id LIMIT 25)""",
    ),
    "quota_then_fill": (
        quota_then_fill,
        f"""WITH {DOCUMENTS_SQL}, i AS (SELECT id, legal_domain AS grp, id * 37 % 101 AS score, row_number() OVER (PARTITION BY legal_domain ORDER BY id * 37 % 101 DESC, id DESC) AS own FROM kd),
        q AS (SELECT * FROM i WHERE own <= CASE grp WHEN 'en' THEN 10 WHEN 'fr' THEN 10 WHEN 'de' THEN 8 ELSE 0 END),
        f AS (SELECT * FROM i WHERE id NOT IN (SELECT id FROM q) ORDER BY score DESC, id DESC LIMIT (40 - (SELECT count(*) FROM q)))
        SELECT id, grp, score, 'quota' AS reason FROM q UNION ALL SELECT id, grp, score, 'fill' FROM f""",
    ),
    "duplicate_groups": (duplicate_groups, "SELECT sha256(text) AS content_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "duplicate_report": (
        duplicate_report,
        """WITH d AS (SELECT doc_id AS id, substr(text, 1, 40) AS f, sha256(text) AS h FROM documents), m AS (SELECT id, min(id) OVER (PARTITION BY f) AS a, min(id) OVER (PARTITION BY h) AS b FROM d), b AS (SELECT *, least(CASE WHEN a < id THEN a END, CASE WHEN b < id THEN b END) AS o FROM m)
        SELECT id, o AS duplicate_of, array_to_string(list_filter([CASE WHEN b = o THEN 'content_sha256' END, CASE WHEN a = o THEN 'file_name' END], lambda x: x IS NOT NULL), ',') AS fields FROM b WHERE o IS NOT NULL""",
    ),
    "unique_file_names": (
        unique_file_names,
        "SELECT c_custkey, lower(c_mktsegment) AS slug, CASE WHEN n = 1 THEN lower(c_mktsegment) ELSE lower(c_mktsegment) || '-' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS n FROM customer)",
    ),
    "latest_run": (latest_run, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "anti_join_no_children": (anti_join_no_children, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "ticket_bundle": (ticket_bundle, "SELECT o_orderkey, o_orderstatus, parts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "pinned_order": (
        pinned_order,
        "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY CASE n_name WHEN 'FRANCE' THEN 1 WHEN 'GERMANY' THEN 2 WHEN 'NATION_3' THEN 3 ELSE 1000 END, lower(n_name), n_nationkey) AS place FROM nation",
    ),
    "catalog_order": (catalog_order, CATALOG_SQL),
    "page_slice": (page_slice, "SELECT p_partkey, p_name, place FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place BETWEEN 41 AND 60"),
    "last_messages": (last_messages, "SELECT conv_id, turn, role, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS n FROM conversations) WHERE n <= 6"),
    "outer_join_residual": (outer_join_residual, "SELECT doc_id, vec_id, label FROM documents LEFT JOIN embeddings ON doc_id = vec_id AND label = 1"),
    "definition_counts": (definition_counts, "SELECT n_name, count(c_custkey) AS n, count(c_custkey) > 0 AS in_use FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"),
    "understanding": (
        understanding,
        f"""WITH c AS (SELECT conv_id, turn, [{', '.join(f"'{p}'" for p in PHRASES)}][conv_id % {len(PHRASES)} + 1] || ' ' || text AS t FROM conversations), g AS (SELECT conv_id, turn, {_FOLDED} AS f FROM c)
        SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(f, '{k}') THEN '{v}'" for k, v in qa.CATEGORY_OF)} ELSE '{qa.DEFAULT_CATEGORY}' END AS domain,
            CASE {' '.join(f"WHEN {_has(t)} THEN '{n}'" for n, t in qa.INTENTS)} ELSE 'legal_qa' END AS intent,
            CASE WHEN {_has(qa.HIGH_RISK)} THEN 'high' WHEN len(string_split(f, ' ')) > 45 THEN 'medium' ELSE 'low' END AS complexity FROM g""",
    ),
    "validation_score": (
        validation_score,
        """WITH a AS (SELECT o_orderkey AS answer_id, o_orderkey % 4 AS n, o_orderkey % 3 AS good, o_orderkey % 7 = 0 AS conflict, CASE o_orderstatus WHEN 'O' THEN 'high' WHEN 'F' THEN 'medium' ELSE 'low' END AS level FROM orders),
        s AS (SELECT *, greatest(0.28, least(0.94, round(0.84 - CASE WHEN n = 0 THEN 0.34 WHEN n = 1 THEN 0.08 ELSE 0 END - CASE WHEN good = 0 AND n > 0 THEN 0.22 ELSE 0 END - CASE WHEN conflict THEN 0.18 ELSE 0 END - CASE level WHEN 'high' THEN 0.12 WHEN 'medium' THEN 0.05 ELSE 0 END, 4)))::DOUBLE AS confidence FROM a),
        e AS (SELECT *, confidence < 0.62 OR conflict OR good = 0 AS escalate FROM s)
        SELECT answer_id, confidence, escalate, CASE WHEN escalate THEN 'needs_review' WHEN confidence < 0.75 THEN 'pass_with_warnings' ELSE 'passed' END AS status FROM e""",
    ),
    "case_facts_dedupe": (
        case_facts_dedupe,
        """WITH f AS (SELECT l_partkey AS case_id, l_returnflag AS fact_key, l_linestatus AS fact_value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag, lower(l_linestatus) ORDER BY l_orderkey * 10 + l_linenumber) = 1),
        n AS (SELECT * FROM f WHERE NOT (case_id IN (SELECT p_partkey FROM part) AND case_id % 5 = 0 AND fact_key = 'A' AND lower(fact_value) = 'f'))
        SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq)::INTEGER AS place FROM n QUALIFY place <= 3""",
    ),
    "escalation_priority": (
        escalation_priority,
        "SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'high' ELSE 'normal' END AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    ),
}
