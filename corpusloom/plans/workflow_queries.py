"""Queries of the review workflow: filters, texts, states and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import workflow as W

from .standins import DOCUMENTS_SQL, documents, table

_EMPTY = "(" + ", ".join(f"'{x}'" for x in W.EMPTY_ANSWERS) + ")"
_KD = f"WITH {DOCUMENTS_SQL}"


def conditional_filters(spark, sf):
    d = documents(spark, sf)
    return W.filters(d, legal_domain="en", document_type=None, metadata_review_status="reviewed").select("id", "legal_domain")


def searchable_rows(spark, sf):
    active, seen = F.col("legal_status") == "active", F.col("retrieval_visibility")
    return documents(spark, sf).select("id", W.searchable(active, seen, True).alias("open"), W.searchable(active, seen, False).alias("verified"))


def attention_list(spark, sf):
    d = documents(spark, sf).withColumn("issues", F.when(F.col("document_code").isNull(), 1).otherwise(0))
    risk = F.when(F.col("retrieval_visibility") == "blocked", "high").otherwise("low")
    return d.where(W.needs_attention(F.col("metadata_review_status"), risk, F.col("issues"))).orderBy("id").limit(8).select("id", "metadata_review_status")


_ANSWERS = ("", " NULL ", "none", "Không có", "chua ro", "N/A", "Unknown", "Luật", "0")


def empty_answers(spark, sf):
    x = F.element_at(F.array(*map(F.lit, (*_ANSWERS, None))), (F.col("c_custkey") % (len(_ANSWERS) + 1) + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", W.emptyish(x).alias("empty"), W.first_filled(x, F.col("c_name")).alias("first"))


def retrieval_texts(spark, sf):
    d = documents(spark, sf)
    x = W.retrieval_text(F.col("title"), F.col("document_code"), F.lit(""), F.col("issuing_authority"), F.col("text"))
    return d.select("id", F.sha2(x, 256).alias("h"))


def embedding_texts(spark, sf):
    d = documents(spark, sf)
    x = W.embedding_text([("Ten van ban", F.col("title")), ("So hieu", F.col("document_code")), ("Linh vuc", F.col("legal_domain")), ("Loai van ban", F.col("document_type"))], F.col("text"))
    return d.select("id", F.sha2(W.prefixed(x, W.PREFIXED_MODEL + "-base", "passage"), 256).alias("h"))


def query_texts(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    hints = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("luat dat dai"), F.lit(""), F.lit("thue"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", F.sha2(W.query_embedding_text(F.col("text"), hints), 256).alias("h"))


def title_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    p = table(spark, sf, "part").select((F.col("p_partkey") + 10_000_000).alias("doc_id"), F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" of the and")).otherwise(F.lit(""))).alias("line"))
    return d.unionByName(p).select("doc_id", F.coalesce(W.title_like(F.col("line")), F.lit(False)).alias("title_like"))


def findings_lists(spark, sf):
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, F.concat(F.lit('["a'), F.col("o_custkey"), F.lit('", "b"]'))).when(k == 1, F.col("o_orderstatus")).when(k == 2, F.lit("[broken"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(W.findings(x), "|").alias("findings"))


def json_in_text(spark, sf):
    x = F.concat(F.lit("Answer: "), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"n": '), F.col("event_id"), F.lit(', "m": {"k": 1}} end'))).otherwise(F.lit("none")))
    e = table(spark, sf, "events").select("event_id", W.object_in(x).alias("found"))
    return e.select("event_id", "found", F.get_json_object("found", "$.m.k").cast("int").alias("k"))


def provider_usage(spark, sf):
    k = F.col("event_id")
    new = F.format_string('{"usage": {"input_tokens": %d, "output_tokens": %d, "input_tokens_details": {"cached_tokens": %d}, "total_tokens": %d}, "output": [{"type": "web_search_call"}, {"type": "message"}]}', k % 97, k % 13, k % 7, k % 211)
    old = F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": %d}}', k % 89, k % 11)
    u = W.usage_of(F.when(k % 3 == 0, new).when(k % 3 == 1, old))
    return table(spark, sf, "events").select("event_id", u.alias("u")).select("event_id", F.col("u.input").alias("input_tokens"), F.col("u.output").alias("output_tokens"), F.col("u.cached").alias("cached_tokens"), F.col("u.total").alias("total_tokens"), F.col("u.web_calls").alias("web_calls"))


_CODES = ("low_ocr_quality", "missing_document_code", "metadata_pending_review", "some_other_issue")


def selection_scores(spark, sf):
    i = F.col("id")
    issues = F.filter(F.array(*[F.when(i % (n + 2) == 0, F.lit(c)) for n, c in enumerate(_CODES)]), lambda c: c.isNotNull())
    risk = F.when(F.col("retrieval_visibility") == "blocked", "high").otherwise("low")
    return documents(spark, sf).select("id", W.selection_score(issues, i % 31, i % 173, i % 6007, risk).cast("int").alias("score"))


def quality_backfill(spark, sf):
    d = documents(spark, sf).withColumn("quality_notes", F.when(F.col("id") % 3 == 0, F.lit("kept")))
    return W.backfill_quality(d).select("id", "ingestion_quality_status", "retrieval_visibility", "quality_notes")


def deferred_reviews(spark, sf):
    d = documents(spark, sf).withColumn("review_notes", F.when(F.col("id") % 2 == 0, F.lit("seen")))
    chosen = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return W.defer_review(d, chosen, "later").select("id", "changed", "metadata_review_status", "ingestion_quality_status", "retrieval_visibility", "review_notes")


def parser_choice(spark, sf):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    x = W.better_parse(k % 7, k % 11, k % 5 == 0, (k % 100).cast("int"))
    return table(spark, sf, "lineitem").select(k.alias("k"), x.alias("parser"))


def case_outcomes(spark, sf):
    up = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    session, case = W.case_states(up, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")))
    ticket = F.element_at(F.array(*map(F.lit, ("new", "assigned", "in_progress", "closed", "answered"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", session.alias("session_status"), case.alias("case_status"), W.replied(ticket).alias("ticket_status"))


def new_escalations(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 10 / 10).alias("confidence"))
    return W.escalations(s, table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("session_id")))


def relation_sync(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem").where("l_quantity > 45")
    n = li.groupBy("l_partkey").agg(F.count("*").alias("n"))
    status = W.sync_status(F.col("n"), F.col("p_partkey") % 17 == 0)
    return p.join(n, p["p_partkey"] == n["l_partkey"], "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def relation_histogram(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))


def shared_review_limit(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return W.shared_limit(o.where("o_orderstatus = 'P'").drop("o_orderstatus"), o.where("o_orderstatus = 'O'").drop("o_orderstatus"), ["o_orderkey"], 400)


def graph_benchmark(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("backend", F.when(F.col("l_linestatus") == "O", "graph").otherwise("relational"))
    return li.groupBy("backend", F.col("l_linenumber").alias("depth")).agg(F.bround(F.avg("l_quantity"), 2).alias("avg_ms"), F.min("l_quantity").alias("min_ms"), F.max("l_quantity").alias("max_ms"), F.count("*").alias("runs"))


def backend_recommendation(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.when(F.col("l_linestatus") == "O", "graph").otherwise("relational").alias("backend"), F.col("l_quantity").alias("avg_ms"))
    parity = table(spark, sf, "orders").select((F.col("o_orderkey") > 0).alias("matches"))
    return W.recommended_backend(runs, parity).select("matched", "cases", "backend")


def usage_names(spark, sf):
    d = documents(spark, sf).select("id", F.when(F.col("id") % 9 != 0, F.col("file_name")).alias("path"), F.when(F.col("id") % 4 != 0, F.col("file_name")).alias("title"))
    k = F.col("event_id")
    u = table(spark, sf, "events").select("event_id", F.when(k % 3 == 0, k % 997).alias("document_id"), F.when(k % 2 == 0, F.format_string("doc_%d_%d.txt", k % 499, k % 499 % 25 + 2000)).alias("path"), F.when(k % 5 == 0, F.lit("then")).when(k % 5 == 1, F.lit("")).alias("title_then"))
    return W.with_usage_names(u, d).select("event_id", "document_id", "title")


def user_totals(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return c.agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_if(seg == "BUILDING").alias("admins"), F.count_if(seg == "MACHINERY").alias("consultants"))


def page_confidence(spark, sf):
    """Mean of pages' confidences that leaves out pages without one."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 3 != 0, F.floor("l_quantity").cast("long")).alias("confidence"))
    return li.groupBy("l_orderkey").agg(F.sum("confidence").alias("total"), F.count("confidence").alias("pages"), F.round(F.avg("confidence"), 3).alias("mean"))


def alias_lists(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.lower("p_type").alias("alias"))
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))


def email_keys(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.ORG ")).alias("email"))
    return c.select("c_custkey", F.lower(F.trim("email")).alias("email"))


_SCORES = " + ".join(f"CASE WHEN id % {n + 2} = 0 THEN {W.ISSUE_WEIGHTS.get(c, W.OTHER_ISSUE_WEIGHT)} ELSE 0 END" for n, c in enumerate(_CODES))
_LINES = "list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')"

WORKFLOW_QUERIES = {
    "conditional_filters": (conditional_filters, f"{_KD} SELECT id, legal_domain FROM kd WHERE legal_domain = 'en' AND metadata_review_status = 'reviewed'"),
    "searchable_rows": (searchable_rows, f"{_KD} SELECT id, coalesce(legal_status = 'active' AND retrieval_visibility IN ('indexed_verified', 'indexed_unreviewed'), false) AS open, coalesce(legal_status = 'active' AND retrieval_visibility = 'indexed_verified', false) AS verified FROM kd"),
    "attention_list": (attention_list, f"{_KD} SELECT id, metadata_review_status FROM kd WHERE metadata_review_status IS DISTINCT FROM 'reviewed' OR retrieval_visibility = 'blocked' OR document_code IS NULL ORDER BY id LIMIT 8"),
    "empty_answers": (empty_answers, f"SELECT c_custkey, coalesce(lower(trim(x)) IN {_EMPTY}, true) AS empty, coalesce(nullif(x, ''), c_name) AS first FROM (SELECT *, [{', '.join(f"'{x}'" for x in _ANSWERS)}, NULL][c_custkey % {len(_ANSWERS) + 1} + 1] AS x FROM customer)"),
    "retrieval_texts": (retrieval_texts, f"{_KD} SELECT id, sha256(concat_ws(' ', nullif(title, ''), nullif(document_code, ''), nullif(issuing_authority, ''), nullif(text, ''))) AS h FROM kd"),
    "embedding_texts": (embedding_texts, f"{_KD} SELECT id, sha256('passage: [Ten van ban: ' || coalesce(nullif(title, ''), 'Khong ro') || ']' || chr(10) || '[So hieu: ' || coalesce(document_code, 'Khong ro') || ']' || chr(10) || '[Linh vuc: ' || coalesce(nullif(legal_domain, ''), 'Khong ro') || ']' || chr(10) || '[Loai van ban: ' || coalesce(document_type, 'Khong ro') || ']' || chr(10) || '[Noi dung]' || chr(10) || coalesce(text, '')) AS h FROM kd"),
    "query_texts": (query_texts, "SELECT conv_id, turn, sha256('[Loai truy van: legal_research_query]' || chr(10) || '[Tu khoa uu tien: ' || CASE WHEN conv_id % 2 = 0 THEN 'luat dat dai, thue' ELSE 'Khong co' END || ']' || chr(10) || '[Cau hoi]' || chr(10) || trim(text)) AS h FROM conversations WHERE role = 'user'"),
    "title_lines": (title_lines, f"""WITH l AS (SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents
        UNION ALL SELECT p_partkey + 10000000, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') || ' ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' of the and' ELSE '' END FROM part),
        c AS (SELECT doc_id, len({_LINES}) AS n, len(list_filter({_LINES}, lambda w: regexp_matches(w, '\\p{{L}}') AND w = upper(w))) AS u, len(list_filter({_LINES}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) AS t FROM l)
        SELECT doc_id, coalesce(n >= 2 AND (u >= greatest(1, ceil(n * 0.6)) OR t >= greatest(2, ceil(n * 0.7))), false) AS title_like FROM c"""),
    "findings_lists": (findings_lists, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_custkey || '|b' WHEN 1 THEN o_orderstatus WHEN 2 THEN '[broken' ELSE '' END AS findings FROM orders"),
    "json_in_text": (json_in_text, """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '{"n": ' || event_id || ', "m": {"k": 1}}' END AS found, CASE WHEN event_id % 3 <> 0 THEN 1 END AS k FROM events"""),
    "provider_usage": (provider_usage, "SELECT event_id, i AS input_tokens, o AS output_tokens, c AS cached_tokens, coalesce(nullif(t, 0), i + o) AS total_tokens, w AS web_calls FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 97 WHEN 1 THEN event_id % 89 ELSE 0 END AS i, CASE event_id % 3 WHEN 0 THEN event_id % 13 WHEN 1 THEN event_id % 11 ELSE 0 END AS o, CASE event_id % 3 WHEN 0 THEN event_id % 7 ELSE 0 END AS c, CASE event_id % 3 WHEN 0 THEN event_id % 211 ELSE 0 END AS t, CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END::BIGINT AS w FROM events)"),
    "selection_scores": (selection_scores, f"{_KD} SELECT id, ({_SCORES} + least(id % 31, 20) + least(id % 173 // 5, 25) + least(id % 6007 // 200, 20) + CASE WHEN retrieval_visibility = 'blocked' THEN 100 ELSE 0 END)::INTEGER AS score FROM kd"),
    "quality_backfill": (quality_backfill, f"{_KD} SELECT id, CASE WHEN ocr_quality_score < 75 THEN 'blocked' WHEN metadata_review_status IS DISTINCT FROM 'reviewed' THEN 'review_required' ELSE 'passed' END AS ingestion_quality_status, CASE WHEN ocr_quality_score < 75 THEN 'blocked' WHEN metadata_review_status IS DISTINCT FROM 'reviewed' THEN 'indexed_unreviewed' ELSE 'indexed_verified' END AS retrieval_visibility, CASE WHEN ocr_quality_score < 75 THEN 'ocr_quality_below_blocking_threshold' WHEN id % 3 = 0 THEN 'kept' WHEN metadata_review_status IS DISTINCT FROM 'reviewed' THEN 'metadata_pending_review' ELSE 'Backfilled from existing reviewed document.' END AS quality_notes FROM kd"),
    "deferred_reviews": (deferred_reviews, f"{_KD}, c AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), j AS (SELECT kd.*, c.doc_id IS NOT NULL AS mine, CASE WHEN id % 2 = 0 THEN 'seen' END AS note, CASE WHEN c.doc_id IS NOT NULL AND retrieval_visibility IS DISTINCT FROM 'blocked' THEN 'indexed_unreviewed' ELSE retrieval_visibility END AS seen FROM kd LEFT JOIN c ON id = c.doc_id) SELECT id, CASE WHEN mine THEN metadata_review_status IS DISTINCT FROM 'pending_review' OR seen IS DISTINCT FROM retrieval_visibility END AS changed, CASE WHEN mine THEN 'pending_review' ELSE metadata_review_status END AS metadata_review_status, CASE WHEN mine THEN CASE WHEN ingestion_quality_status = 'blocked' THEN 'blocked' ELSE 'review_required' END ELSE ingestion_quality_status END AS ingestion_quality_status, seen AS retrieval_visibility, CASE WHEN mine THEN concat_ws(chr(10), note, 'later') ELSE note END AS review_notes FROM j"),
    "parser_choice": (parser_choice, "SELECT k, CASE WHEN (k % 5 = 0 OR k % 100 < 60) AND k % 11 > k % 7 THEN 'ai_fallback' ELSE 'deterministic' END AS parser FROM (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem)"),
    "case_outcomes": (case_outcomes, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'escalated' ELSE 'active' END AS session_status, CASE WHEN o_orderstatus = 'O' THEN 'needs_review' ELSE 'analysis_ready' END AS case_status, ['answered', 'answered', 'answered', 'closed', 'answered'][o_orderkey % 5 + 1] AS ticket_status FROM orders"),
    "new_escalations": (new_escalations, "SELECT c_custkey AS session_id, 'new' AS status, CASE WHEN c_custkey % 10 BETWEEN 1 AND 4 THEN 'high' ELSE 'normal' END AS priority FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "relation_sync": (relation_sync, "SELECT p_partkey, coalesce(n, 0) AS n, CASE WHEN p_partkey % 17 = 0 THEN 'failed' WHEN n > 0 THEN 'synced' ELSE 'no_matches' END AS status FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON p_partkey = l_partkey"),
    "relation_histogram": (relation_histogram, "SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "shared_review_limit": (shared_review_limit, "WITH b AS (SELECT o_orderkey, 1 AS source FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, source, row_number() OVER (ORDER BY source, o_orderkey)::INTEGER AS place FROM b QUALIFY place <= 400"),
    "graph_benchmark": (graph_benchmark, "SELECT CASE WHEN l_linestatus = 'O' THEN 'graph' ELSE 'relational' END AS backend, l_linenumber AS depth, round_even(avg(l_quantity), 2) AS avg_ms, min(l_quantity) AS min_ms, max(l_quantity) AS max_ms, count(*) AS runs FROM lineitem GROUP BY 1, 2"),
    "backend_recommendation": (backend_recommendation, "WITH r AS (SELECT avg(l_quantity) FILTER (l_linestatus <> 'O') AS a, avg(l_quantity) FILTER (l_linestatus = 'O') AS g FROM lineitem), p AS (SELECT count_if(o_orderkey > 0)::BIGINT AS matched, count(*) AS cases FROM orders) SELECT matched, cases, CASE WHEN matched = cases AND NOT g > 1.5 * a THEN 'graph' ELSE 'relational' END AS backend FROM r, p"),
    "usage_names": (usage_names, f"{_KD}, d AS (SELECT id, CASE WHEN id % 9 <> 0 THEN file_name END AS path, CASE WHEN id % 4 <> 0 THEN file_name END AS title FROM kd), m AS (SELECT path, min(id) AS mid FROM d WHERE path IS NOT NULL GROUP BY 1), u AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 997 END AS own, CASE WHEN event_id % 2 = 0 THEN 'doc_' || event_id % 499 || '_' || (event_id % 499 % 25 + 2000) || '.txt' END AS path, CASE event_id % 5 WHEN 0 THEN 'then' WHEN 1 THEN '' END AS t FROM events), j AS (SELECT event_id, t, coalesce(own, mid) AS document_id FROM u LEFT JOIN m USING (path)) SELECT event_id, document_id, coalesce(nullif(t, ''), nullif(title, ''), 'Unknown document') AS title FROM j LEFT JOIN d ON document_id = id"),
    "user_totals": (user_totals, "SELECT count(*) AS users, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_mktsegment = 'BUILDING') AS admins, count(*) FILTER (c_mktsegment = 'MACHINERY') AS consultants FROM customer"),
    "page_confidence": (page_confidence, "SELECT l_orderkey, sum(c)::BIGINT AS total, count(c) AS pages, round(avg(c), 3) AS mean FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_quantity)::BIGINT END AS c FROM lineitem) GROUP BY 1"),
    "alias_lists": (alias_lists, "SELECT p_brand, string_agg(alias, '|' ORDER BY alias) AS aliases FROM (SELECT DISTINCT p_brand, lower(p_type) AS alias FROM part) GROUP BY 1"),
    "email_keys": (email_keys, "SELECT c_custkey, lower(c_name) || '@example.org' AS email FROM customer"),
}
