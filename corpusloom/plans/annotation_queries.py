"""Queries of proposed annotations, the annotation tool, checks of answers and concept anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.context import excerpt
from corpusloom.functions.shared import spread
from corpusloom.functions.text import fold
from corpusloom.operators import answers as A
from corpusloom.operators import prelabel as P
from corpusloom.operators.annotation import PROVISION_LABELS

from .standins import DOCUMENTS_SQL, documents, table

_KD = f"WITH {DOCUMENTS_SQL}"


def _sentences(spark, sf):
    """One provision per two parts, one chunk per part."""
    k = F.col("p_partkey")
    say = lambda test, *xs: F.when(test, F.concat(*xs)).otherwise("")
    content = F.concat(
        F.lit("Doanh nghiệp "), "p_name", F.lit(", phải nộp "), "p_type",
        say(F.floor(k / 2) % 2 == 0, F.lit("; trừ trường hợp "), "p_brand"),
        say(k % 3 == 0, F.lit("; nếu "), "p_name"),
        say(k % 5 == 0, F.lit("; sẽ bị "), "p_type"),
        F.lit("."),
    )
    return spread(table(spark, sf, "part").select(F.floor(k / 8).alias("doc_id"), F.floor(k / 2).alias("provision_id"), (k % 2 * 1000).alias("start"), content.alias("content")), "doc_id")


_ENTITIES_SQL = """
WITH p AS (SELECT *, p_partkey AS k, p_partkey % 2 * 1000 AS s, length('Doanh nghiệp ' || p_name || ', phải nộp ' || p_type) AS n FROM part),
q AS (SELECT *, CASE WHEN k // 2 % 2 = 0 THEN '; trừ trường hợp ' || p_brand ELSE '' END AS c, CASE WHEN k % 3 = 0 THEN '; nếu ' || p_name ELSE '' END AS d FROM p),
f AS (
    SELECT k, s, 'SUBJECT' AS label, 'Doanh nghiệp ' || p_name AS text, 0 AS off FROM q
    UNION ALL SELECT k, s, 'ACTION', 'phải', length('Doanh nghiệp ' || p_name || ', ') FROM q
    UNION ALL SELECT k, s, 'LEGAL_OBJECT', 'nộp ' || p_type, length('Doanh nghiệp ' || p_name || ', phải ') FROM q
    UNION ALL SELECT k, s, 'EXCEPTION', substr(c, 3), n + 2 FROM q WHERE c <> ''
    UNION ALL SELECT k, s, 'CONDITION', CASE WHEN c <> '' THEN substr(c, 7) ELSE substr(d, 3) END, n + CASE WHEN c <> '' THEN 6 ELSE 2 END FROM q WHERE c <> '' OR d <> ''
    UNION ALL SELECT k, s, 'CONSEQUENCE', 'sẽ bị ' || p_type, n + length(c || d) + 2 FROM q WHERE k % 5 = 0),
e AS (SELECT k // 8 AS doc_id, k // 2 AS provision_id, label, text, s + off AS begin_, s + off + length(text) AS end_, row_number() OVER (PARTITION BY k // 2 ORDER BY s + off, s + off + length(text), label) AS n FROM f),
entities AS (SELECT *, 'sem-' || provision_id || '-' || lower(label) || '-' || n AS entity_id FROM e)"""


def semantic_entities(spark, sf):
    return P.semantic_entities(_sentences(spark, sf)).select("doc_id", "provision_id", "entity_id", "label", "text", F.col("begin").alias("begin_"), F.col("end").alias("end_"))


def semantic_relations(spark, sf):
    return P.semantic_relations(P.semantic_entities(_sentences(spark, sf)))


_ENDS = " UNION ALL ".join(f"SELECT '{kind}' AS relation_type, '{end}' AS tail, '{label}' AS label, {from_action} AS out" for kind, end, label, from_action in P.ACTION_RELATIONS)


def _items(spark, sf):
    """A task of the annotation tool per customer: reviewed, predicted, neither, or no JSON."""
    k = F.col("c_custkey")
    result = F.format_string(
        '[{"id": "r%d", "type": "Labels", "score": 0.5, "value": {"start": %d, "end": %d, "text": "x", "labels": [" SUBJECT "]}}, {"id": "s%d", "type": "labels", "labels": ["ARTICLE"], "value": {"text": "y"}}, '
        '{"type": "relation", "from_id": "r%d", "to_id": "s%d", "labels": ["AMENDS"]}, {"id": "t", "type": "relation", "from_id": "a"}, {"id": "z", "type": "choices", "labels": ["N"]}]',
        k, k % 7, k % 7 + 1, k, k, k,
    )
    boxes = F.when(k % 4 == 0, F.concat(F.lit('"annotations": [{"result": '), result, F.lit("}]"))).when(k % 4 == 1, F.concat(F.lit('"annotations": [], "predictions": [{"result": '), result, F.lit("}]"))).otherwise('"annotations": []')
    named = F.when(k % 3 == 0, F.concat(F.lit('"file_name": "'), "c_name", F.lit('", '))).otherwise('"pdf": "a/b/c.pdf", ')
    item = F.concat(F.lit('{"data": {'), named, F.lit('"document_id": "'), k, F.lit('", "body": "B", "metadata_prelabels": [{"label": "TITLE", "normalized_value": "'), "c_name", F.lit('"}, {"label": "CODE"}]}, '), boxes, F.lit("}"))
    return spread(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", F.when(k % 4 == 3, "no item").otherwise(item).alias("item"))


def tool_documents(spark, sf):
    return P.tool_items(_items(spark, sf)).select("c_custkey", "document_id", "source_file_name", "source_text", "language", "review_status")


def tool_entities(spark, sf):
    return P.tool_entities(P.tool_items(_items(spark, sf)), "c_custkey").select("c_custkey", "entity_id", "label", "text", F.col("start").alias("start_"), "normalized_value", "score")


def tool_relations(spark, sf):
    return P.tool_relations(P.tool_items(_items(spark, sf)), "c_custkey").select("c_custkey", "relation_id", "relation_type", "source_id", "target_id")


def import_summary(spark, sf):
    d = P.tool_items(_items(spark, sf))
    return P.import_summary(d.select("c_custkey"), P.tool_entities(d, "c_custkey"), P.tool_relations(d, "c_custkey"), "c_custkey", PROVISION_LABELS)


def response_findings(spark, sf):
    k = F.col("conv_id") + F.col("turn")
    c = table(spark, sf, "conversations")
    text = F.concat("text", F.when(k % 3 == 0, F.lit(" Căn cứ Điều 1.")).otherwise(""), F.when(k % 5 == 0, F.lit(" Cảnh báo.")).otherwise(""))
    labels = F.when(k % 2 == 0, F.array(F.lit("Điều 1"), F.lit(None).cast("string"), F.lit("Khoản 99 Điều 98"), F.lit("Điều 97"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", F.array_join(A.response_findings(text, labels, k % 4 == 0, k % 7 == 0), "|").alias("findings"))


_WORDS = lambda ws: " OR ".join(f"contains(low, '{w}')" for w in ws)


def plan_steps(spark, sf):
    k = F.col("o_orderkey")
    x = A.plan_steps(F.lit("legal_qa"), F.col("o_orderpriority"), F.lit("low"), k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return table(spark, sf, "orders").select("o_orderkey", F.posexplode(x).alias("i", "s")).select("o_orderkey", "i", "s.step", "s.status", "s.note")


def concept_anchors(spark, sf):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    links = table(spark, sf, "lineitem").select(k.alias("link_id"), F.col("l_partkey").alias("concept_id"), (k % 1201).alias("document_id"), F.when(k % 3 != 0, F.col("l_partkey")).alias("chunk_id"), (F.col("l_returnflag") != "R").alias("is_active"), F.when(k % 2 == 0, F.concat(F.lit('{"source_excerpt": "e'), k, F.lit('"}'))).otherwise("[]").alias("metadata_json"))
    chunks = table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("citation_label"))
    return A.concept_anchors(links, documents(spark, sf), chunks).select("anchor_id", "document_id", "legal_status", "document_code", "citation_label", "source_excerpt")


def graph_concept_scores(spark, sf):
    q, name = fold(F.concat(F.lit("luật "), "p_name")), F.concat(F.lit("luat "), F.lower("p_name"))
    k = F.col("p_partkey") % 5
    concept = F.when(k == 0, name).when(k == 3, F.lit("luat")).otherwise("none such")
    aliases = F.when(k == 1, F.array(F.lit("q"), name)).when(k == 2, F.array(F.lit("luat"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", A.graph_concept_score(q, concept, aliases).cast("double").alias("score"))


_MARKERS = {"research": ("science", "study"), "public": ("the ", "der "), "codes": ("3/2003/qh", "9/2009/qh"), "none": ("no such marker at all",)}


def seed_links(spark, sf):
    d = documents(spark, sf).where("legal_status = 'active'")
    return A.seed_links(d, _MARKERS, F.lower(F.concat_ws(" ", "title", "document_code")))


def document_benchmark(spark, sf):
    d = documents(spark, sf)
    n, k = F.size(F.split("text", "\n")), F.col("id")
    meta = A.completeness(*(F.col(c) for c in ("title", "legal_domain", "document_type", "document_code", "issuing_authority", "authority_level", "signed_date", "effective_date", "legal_status")), F.lit(None))
    chunks = A.chunk_structure_score(F.floor(n / 2), n, F.length("text") - n + 1)
    review = A.review_readiness(F.col("metadata_review_status"), F.element_at(F.array(F.lit("synced"), F.lit("pending"), F.lit("failed")), (k % 3 + 1).cast("int")))
    d = d.select("id", meta.alias("metadata"), F.when(F.col("text").isNull(), 0.0).otherwise(chunks).alias("chunks"), (k % 6 / 5).alias("retrieval"), review.alias("review"))
    return d.withColumn("overall", A.benchmark_score(F.col("metadata"), F.col("chunks"), F.col("retrieval"), F.col("review")))


_ALIASES = ("und", "les", "with", "para", "on a")


def target_excerpts(spark, sf):
    return documents(spark, sf).select("id", excerpt(F.col("text"), F.array(*map(F.lit, _ALIASES))).alias("excerpt"))


_FILLED = " + ".join(f"(coalesce({c}::VARCHAR, '') <> '')::INTEGER" for c in ("title", "legal_domain", "document_type", "document_code", "issuing_authority", "authority_level", "signed_date", "effective_date", "legal_status"))
_HELD = " UNION ALL ".join(f"SELECT '{concept}' AS concept, min(id) AS document_id FROM t WHERE " + " OR ".join(f"contains(x, '{w}')" for w in words) for concept, words in _MARKERS.items())

ANNOTATION_QUERIES = {
    "semantic_entities": (semantic_entities, f"{_ENTITIES_SQL} SELECT doc_id, provision_id, entity_id, label, text, begin_, end_ FROM entities"),
    "semantic_relations": (semantic_relations, f"""{_ENTITIES_SQL}, one AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY provision_id, label ORDER BY n) = 1), kinds AS ({_ENDS})
        SELECT a.doc_id, a.provision_id, 'sem-rel-' || a.provision_id || '-' || tail AS relation_id, relation_type, CASE WHEN out THEN a.entity_id ELSE b.entity_id END AS source_id, CASE WHEN out THEN b.entity_id ELSE a.entity_id END AS target_id
        FROM one a JOIN one b USING (provision_id) JOIN kinds ON b.label = kinds.label WHERE a.label = 'ACTION'"""),
    "tool_documents": (tool_documents, """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey END AS document_id, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 3 = 0 THEN c_name ELSE 'c.pdf' END AS source_file_name,
        CASE WHEN c_custkey % 4 <> 3 THEN 'B' END AS source_text, 'vi' AS language, CASE c_custkey % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'predicted' ELSE 'draft' END AS review_status FROM customer"""),
    "tool_entities": (tool_entities, """SELECT c_custkey, 'metadata-1' AS entity_id, 'TITLE' AS label, c_name AS text, NULL::INTEGER AS start_, c_name AS normalized_value, NULL::DOUBLE AS score FROM customer WHERE c_custkey % 4 <> 3
        UNION ALL SELECT c_custkey, 'r' || c_custkey, 'SUBJECT', 'x', (c_custkey % 7)::INTEGER, NULL, 0.5 FROM customer WHERE c_custkey % 4 < 2
        UNION ALL SELECT c_custkey, 's' || c_custkey, 'ARTICLE', 'y', NULL, NULL, NULL FROM customer WHERE c_custkey % 4 < 2"""),
    "tool_relations": (tool_relations, """SELECT c_custkey, 'r' || c_custkey || '->s' || c_custkey AS relation_id, 'AMENDS' AS relation_type, 'r' || c_custkey AS source_id, 's' || c_custkey AS target_id FROM customer WHERE c_custkey % 4 < 2
        UNION ALL SELECT c_custkey, 't', 'RELATED_TO', 'a', '' FROM customer WHERE c_custkey % 4 < 2"""),
    "import_summary": (import_summary, """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 3 END::BIGINT AS entity_count, (c_custkey % 4 < 2)::BIGINT AS provision_count, (c_custkey % 4 < 2)::BIGINT AS semantic_entity_count,
        CASE WHEN c_custkey % 4 < 2 THEN 2 ELSE 0 END::BIGINT AS relation_count FROM customer"""),
    "response_findings": (response_findings, f"""WITH r AS (SELECT conv_id, turn, conv_id + turn AS k, lower(text || CASE WHEN (conv_id + turn) % 3 = 0 THEN ' Căn cứ Điều 1.' ELSE '' END || CASE WHEN (conv_id + turn) % 5 = 0 THEN ' Cảnh báo.' ELSE '' END) AS low FROM conversations),
        m AS (SELECT *, CASE WHEN k % 2 = 0 THEN list_filter(['Điều 1', 'Khoản 99 Điều 98'], lambda x: NOT contains(low, lower(x))) ELSE [] END AS missing FROM r)
        SELECT conv_id, turn, CASE WHEN low IS NULL THEN '' ELSE concat_ws('|', CASE WHEN k % 2 = 0 AND NOT ({_WORDS(A.BASIS_WORDS)}) THEN '{A.NO_BASIS}' END, CASE WHEN len(missing) > 0 THEN '{A.NO_LABELS}' || array_to_string(missing, ', ') || '.' END,
        CASE WHEN k % 4 = 0 AND NOT ({_WORDS(A.STATUS_WORDS)}) THEN '{A.NO_WARNING}' END, CASE WHEN k % 7 = 0 AND NOT ({_WORDS(A.CONFLICT_WORDS)}) THEN '{A.NO_CONFLICT}' END) END AS findings FROM m"""),
    "plan_steps": (plan_steps, f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS d, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS c FROM orders)
        SELECT o_orderkey, 0 AS i, 'classify_intent' AS step, 'completed' AS status, 'intent=legal_qa' AS note FROM o
        UNION ALL SELECT o_orderkey, 1, 'score_complexity', 'completed', 'complexity=low' FROM o
        UNION ALL SELECT o_orderkey, 2, 'retrieve_legal_evidence', CASE WHEN a THEN 'completed' ELSE 'empty' END, 'domain=' || d FROM o
        UNION ALL SELECT o_orderkey, 3, 'inspect_related_articles', CASE WHEN b THEN 'completed' ELSE 'empty' END, CASE WHEN b THEN '{A.RELATED_NOTE}' END FROM o
        UNION ALL SELECT o_orderkey, 4, 'check_validity', CASE WHEN a THEN 'completed' ELSE 'skipped' END, NULL FROM o
        UNION ALL SELECT o_orderkey, 5, 'resolve_conflict', CASE WHEN c THEN 'needs_review' ELSE 'completed' END, CASE WHEN c THEN '{A.CONFLICT_NOTE}' END FROM o
        UNION ALL SELECT o_orderkey, 6, 'validate_response', 'completed', NULL FROM o
        UNION ALL SELECT o_orderkey, 7, 'escalate_if_needed', 'conditional', NULL FROM o"""),
    "concept_anchors": (concept_anchors, f"""{_KD}, k AS (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem WHERE l_returnflag <> 'R')
        SELECT 'anchor:' || k AS anchor_id, k % 1201 AS document_id, legal_status, document_code, p_name AS citation_label, CASE WHEN k % 2 = 0 THEN 'e' || k END AS source_excerpt
        FROM k LEFT JOIN kd ON k % 1201 = id LEFT JOIN part ON p_partkey = CASE WHEN k % 3 <> 0 THEN l_partkey END"""),
    "graph_concept_scores": (graph_concept_scores, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN 0.78 WHEN 3 THEN 0.72 END::DOUBLE AS score FROM part"),
    "seed_links": (seed_links, f"{_KD}, t AS (SELECT id, lower(concat_ws(' ', title, document_code)) AS x FROM kd WHERE legal_status = 'active') SELECT * FROM ({_HELD}) WHERE document_id IS NOT NULL"),
    "document_benchmark": (document_benchmark, f"""{_KD}, s AS (SELECT id, metadata_review_status AS m, text, len(string_split(text, chr(10))) AS n, ({_FILLED}) / 10 AS filled FROM kd),
        d AS (SELECT id, round_even(filled, 3) AS metadata, CASE WHEN text IS NULL THEN 0.0 ELSE round_even((n // 2) / n * 0.7::DOUBLE + least((length(text) - n + 1) / n / 420, 1.0::DOUBLE) * 0.3::DOUBLE, 3) END AS chunks, id % 6 / 5 AS retrieval,
            round_even(CASE WHEN m = 'reviewed' THEN 1.0 ELSE 0.45 END::DOUBLE * 0.65::DOUBLE + CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.1 END::DOUBLE * 0.35::DOUBLE, 3) AS review FROM s)
        SELECT *, round_even(metadata * 0.3::DOUBLE + chunks * 0.2::DOUBLE + retrieval * 0.35::DOUBLE + review * 0.15::DOUBLE, 3) AS overall FROM d"""),
    "target_excerpts": (target_excerpts, f"""WITH y AS (SELECT doc_id AS id, text, regexp_replace(strip_accents(lower(text)), '[^a-z0-9/]', ' ', 'g') AS y FROM documents),
        c AS (SELECT *, string_split(y, '') AS cs, trim(regexp_replace(y, ' +', ' ', 'g')) AS f, length(rtrim(y)) AS n FROM y),
        k AS (SELECT id, text, f, list_filter(range(1, n + 1), lambda i: cs[i] <> ' ' OR (i > 1 AND cs[i - 1] <> ' ' )) AS kept FROM c),
        a AS (SELECT id, min({{'at': instr(f, alias), 'n': length(alias)}}) AS hit FROM k, (VALUES {", ".join(f"('{a}')" for a in _ALIASES)}) v(alias) WHERE contains(f, alias) GROUP BY id),
        b AS (SELECT id, text, kept[greatest(hit.at - 120, 1)] AS first, kept[least(hit.at + hit.n + 119, len(kept))] AS last FROM k JOIN a USING (id)),
        e AS (SELECT id, substr(trim(regexp_replace(substr(text, greatest(first - 60, 1), last + 59 - greatest(first - 61, 0)), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+', ' ', 'g')), 1, 280) AS excerpt FROM b)
        SELECT doc_id AS id, excerpt FROM documents LEFT JOIN e ON doc_id = e.id"""),
}
