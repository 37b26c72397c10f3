"""Queries of payloads: bundles, annotation tasks and answers are built from the tables, written, and read as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.shared import Tables, spread
from corpusloom.operators import payloads, prelabel, provisions

from .annotation_queries import _ENDS, _ENTITIES_SQL, _sentences
from .standins import DOCUMENTS_SQL, documents, table


def case_bundles(spark, sf):
    """Bundles of customers as cases, with line items as facts, events as runs and orders as tickets."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("domain"))
    facts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("value"))
    runs = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"))
    tickets = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("priority"))
    made = payloads.case_bundles(c, facts, runs.where("id % 2 = 0"), runs.where("id % 2 = 1"), tickets)
    v = Tables(spark, "bundles").save(made, "json").withColumn("v", F.parse_json("bundle"))
    size = lambda name: F.size(F.variant_get("v", f"$.{name}", "array<variant>")).alias(f"n_{name}")
    get = lambda path, kind, name: F.try_variant_get("v", path, kind).alias(name)
    return v.select(
        "case_id", get("$.case.title", "string", "title"), size("facts"), size("planner_runs"), size("validation_runs"), size("tickets"), get("$.facts[0].id", "long", "first_fact"), get("$.facts[0].value", "string", "first_value"),
        get("$.planner_runs[0].id", "long", "last_plan"), get("$.validation_runs[0].status", "string", "last_status"), get("$.tickets[0].id", "long", "last_ticket"), get("$.tickets[1].priority", "string", "priority_before"),
    )


_PER_CASE = lambda sql: f"SELECT case_id, list(struct_pack(id := id, v := v) ORDER BY {{0}}) AS x FROM ({sql}) GROUP BY 1"
CASE_SQL = f"""WITH f AS ({_PER_CASE("SELECT l_suppkey AS case_id, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS t_, l_returnflag AS v FROM lineitem").format("t_, id")}),
p AS ({_PER_CASE("SELECT user_id AS case_id, event_id AS id, ts AS t_, event_type AS v FROM events WHERE event_id % 2 = 0").format("t_ DESC, id DESC")}),
r AS ({_PER_CASE("SELECT user_id AS case_id, event_id AS id, ts AS t_, event_type AS v FROM events WHERE event_id % 2 = 1").format("t_ DESC, id DESC")}),
t AS ({_PER_CASE("SELECT o_custkey AS case_id, o_orderkey AS id, o_orderdate AS t_, o_orderpriority AS v FROM orders").format("t_ DESC, id DESC")})
SELECT c_custkey AS case_id, c_name AS title, coalesce(len(f.x), 0)::INTEGER AS n_facts, coalesce(len(p.x), 0)::INTEGER AS n_planner_runs, coalesce(len(r.x), 0)::INTEGER AS n_validation_runs, coalesce(len(t.x), 0)::INTEGER AS n_tickets,
    f.x[1].id AS first_fact, f.x[1].v AS first_value, p.x[1].id AS last_plan, r.x[1].v AS last_status, t.x[1].id AS last_ticket, t.x[2].v AS priority_before
FROM customer LEFT JOIN f ON c_custkey = f.case_id LEFT JOIN p ON c_custkey = p.case_id LEFT JOIN r ON c_custkey = r.case_id LEFT JOIN t ON c_custkey = t.case_id"""


def _proposals(spark, sf):
    """Entities and relations of the semantic prelabels, and a title per document without a span."""
    found = Tables(spark, "proposals").save(prelabel.semantic_entities(_sentences(spark, sf)), "entities")
    attributes = F.create_map(F.lit("provision"), F.col("provision_id").cast("string"), F.lit("prediction_score"), F.concat(F.lit("0."), F.col("n").cast("string")))
    entities = found.select(F.col("doc_id").alias("document_id"), "entity_id", "label", "text", F.col("begin").alias("start"), "end", F.lit(None).cast("string").alias("normalized_value"), attributes.alias("attributes"))
    docs = spread(entities.select("document_id"), "document_id").distinct().select("document_id", F.concat(F.lit("d"), "document_id", F.lit(".txt")).alias("source_file_name"), F.lit("vi").alias("language"), F.concat(F.lit('Văn "bản" '), "document_id").alias("text"))
    none = F.lit(None).cast("long")
    title = docs.select("document_id", F.concat(F.lit("meta-"), "document_id").alias("entity_id"), F.lit("TITLE").alias("label"), "text", none.alias("start"), none.alias("end"), F.lit("").alias("normalized_value"), F.create_map(F.lit("display_name"), F.lit("Title")).alias("attributes"))
    relations = prelabel.semantic_relations(spread(found, "doc_id")).select(F.col("doc_id").alias("document_id"), "relation_id", "relation_type", "source_id", "target_id", F.lit(0.75).alias("score"), F.create_map(F.lit("source"), F.lit("parser")).alias("attributes"))
    broken = docs.select("document_id", F.concat(F.lit("bad-"), "document_id").alias("relation_id"), F.lit("CITES").alias("relation_type"), F.concat(F.lit("meta-"), "document_id").alias("source_id"), F.lit("nowhere").alias("target_id"), F.lit(0.5).alias("score"), F.create_map(F.lit("a"), F.lit("b")).alias("attributes"))
    return docs, entities.unionByName(title), relations.unionByName(broken)


def annotation_tasks(spark, sf):
    """Results of the tasks, read back one by one."""
    made = payloads.annotation_tasks(*_proposals(spark, sf))
    v = Tables(spark, "tasks").save(made, "json").withColumn("v", F.parse_json("task"))
    rows = v.select("document_id", "v", F.posexplode(F.variant_get("v", "$.predictions[0].result", "array<variant>")).alias("i", "r"))
    get = lambda c, path, kind, name: F.try_variant_get(c, path, kind).alias(name)
    return rows.select(
        "document_id", "i", get("v", "$.data.text", "string", "text_"), get("v", "$.data.metadata_prelabels[0].normalized_value", "string", "title"), get("r", "$.id", "string", "id"), get("r", "$.type", "string", "type"),
        get("r", "$.value.start", "long", "begin_"), get("r", "$.value.labels[0]", "string", "label"), get("r", "$.value.provision", "string", "provision"), get("r", "$.score", "double", "score"), get("r", "$.from_id", "string", "from_id"), get("r", "$.labels[0]", "string", "kind"),
    )


TASKS_SQL = f"""{_ENTITIES_SQL}, one AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY provision_id, label ORDER BY n) = 1), kinds AS ({_ENDS}),
rel AS (SELECT a.doc_id, 'sem-rel-' || a.provision_id || '-' || tail AS id, relation_type, CASE WHEN out THEN a.entity_id ELSE b.entity_id END AS from_id FROM one a JOIN one b USING (provision_id) JOIN kinds ON b.label = kinds.label WHERE a.label = 'ACTION'),
x AS (SELECT doc_id, 0 AS k, begin_ AS t_, entity_id AS id, 'labels' AS type, begin_, label, provision_id::VARCHAR AS provision, ('0.' || n)::DOUBLE AS score, NULL AS from_id, NULL AS kind FROM entities
    UNION ALL SELECT doc_id, 1, 0, id, 'relation', NULL, NULL, NULL, 0.75, from_id, relation_type FROM rel)
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, t_, id) - 1)::INTEGER AS i, 'Văn "bản" ' || doc_id AS text_, 'Văn "bản" ' || doc_id AS title, id, type, begin_, label, provision, score, from_id, kind FROM x"""


def response_texts(spark, sf):
    """Answers out of the shapes that providers send, made of the conversations' messages."""
    k = F.col("conv_id") + F.col("turn")
    t = F.col("text")
    item = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    contents = F.to_json(F.struct(F.array(item("text", F.concat(F.lit("  "), t)), item("tool", t), item("text", F.lit("thêm"))).alias("content")))
    outputs = F.to_json(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.array(item("output_text", F.lit("nein"))).alias("content")), F.struct(F.lit("message").alias("type"), F.array(item("refusal", t), item("output_text", t)).alias("content"))).alias("output")))
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))
    whole = F.to_json(F.struct(F.concat(t, F.lit(" ")).alias("output_text")))
    payload = F.when(k % 6 == 0, contents).when(k % 6 == 1, outputs).when(k % 6 == 2, choices).when(k % 6 == 3, whole).when(k % 6 == 4, F.concat(F.lit("{"), t)).otherwise(F.lit('{"output": 5, "choices": []}'))
    provider = F.when(k % 6 == 0, "anthropic").otherwise("other")
    return table(spark, sf, "conversations").select("conv_id", "turn", payloads.response_text(payload, provider).alias("answer"))


RESPONSE_SQL = """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN CASE WHEN trim(text) = '' THEN '' ELSE trim(text) || chr(10) END || 'thêm' WHEN 1 THEN trim(text) WHEN 2 THEN trim(text) WHEN 3 THEN trim(text) ELSE '' END AS answer FROM conversations"""


def shown_values(spark, sf):
    """Stored values of events as a reader sees them: arrays, objects, plain texts."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    value = F.when(i % 4 == 0, F.concat(F.lit("["), "props", F.lit(", "), i.cast("string"), F.lit(', "a b", null]'))).when(i % 4 == 1, F.concat(F.lit('{"loai": "'), "event_type", F.lit('", "n": '), i.cast("string"), F.lit("}"))).when(i % 4 == 2, F.concat(F.lit(" "), "event_type", F.lit(" x "))).otherwise("")
    return e.select("event_id", F.array_join(payloads.shown(value), "|").alias("shown"))


SHOWN_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (props::JSON)::VARCHAR || '|' || event_id || '|a b' WHEN 1 THEN 'loai: ' || event_type || '|n: ' || event_id WHEN 2 THEN event_type || ' x' ELSE '' END AS shown
FROM (SELECT event_id, event_type, replace(props, ' ', '') AS props FROM events)"""


PAYLOAD_QUERIES = {
    "case_bundles": (case_bundles, CASE_SQL),
    "annotation_tasks": (annotation_tasks, TASKS_SQL),
    "response_texts": (response_texts, RESPONSE_SQL),
    "shown_values": (shown_values, SHOWN_SQL),
}


def _stored(spark, sf):
    """Line items as provisions of their suppliers, with the first of an order as the parent of the others."""
    o, n = F.col("l_orderkey") * 10, F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("document_id"), (o + n).alias("provision_id"), F.when(n > 1, o + 1).alias("parent_provision_id"), F.col("l_returnflag").alias("provision_level"))


def _cleared(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("document_id"))


def replaced_provisions(spark, sf):
    """Every tenth supplier's provisions go; every twentieth gets three new ones, of which the last names a parent that there is not."""
    given = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(p).cast("int").alias("parent_index"), F.lit(level).alias("provision_level")) for i, p, level in ((1, None, "article"), (2, 1, "clause"), (3, 5, "point"))))
    new = table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("document_id"), F.explode(given).alias("g")).select("document_id", "g.*")
    return provisions.replace_provisions(_stored(spark, sf), new, _cleared(spark, sf))


def replaced_relations(spark, sf):
    """Relations between suppliers' provisions that outlive the replacement."""
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(k.alias("relation_id"), F.when(k % 9 != 0, k % 97).alias("source_document_id"), (k * 3 % 101).alias("target_document_id"))
    return provisions.cleared_relations(r, _cleared(spark, sf))


def case_graphs(spark, sf):
    """Latest orders of customers as runs, with graphs that are missing, broken, no object, or sound."""
    k = F.col("o_orderkey")
    node = F.struct(F.lit("issue").alias("id"), k.alias("n"))
    sound = F.to_json(F.struct(F.array_repeat(node, (k % 5).cast("int")).alias("nodes"), F.array(F.lit("e")).alias("edges"), F.col("o_orderpriority").alias("domain")))
    graph = F.when(k % 4 == 0, "").when(k % 4 == 1, "{broken").when(k % 4 == 2, "[1]").otherwise(sound)
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("id"), F.col("o_orderdate").alias("updated_at"), graph.alias("graph_json"))
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"))
    out = provisions.case_graphs(cases, runs)
    return out.select("case_id", "title", "status", "run_id", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), "domain", "intent")


def catalog_filters(spark, sf):
    """Documents that each choice of status and domain shows."""
    d = documents(spark, sf).select("id", (F.col("legal_status") == "active").alias("is_active"), "legal_domain")
    out = [d.where(provisions.catalog_filter(s, x, F.col("is_active"), F.col("legal_domain"))).select("id", F.lit(f"{s} {x}").alias("choice")) for s in ("all", "active", "inactive") for x in ("all", "de")]
    return reduce(DataFrame.unionByName, out)


PAYLOAD_QUERIES |= {
    "replaced_provisions": (
        replaced_provisions,
        """WITH s AS (SELECT l_suppkey AS d, l_orderkey * 10 + l_linenumber AS p, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS up, l_returnflag AS level FROM lineitem),
        n AS (SELECT s_suppkey AS d, i, (SELECT max(p) FROM s) + row_number() OVER (ORDER BY s_suppkey, i) AS p FROM supplier, (SELECT unnest([1, 2, 3]) AS i) WHERE s_suppkey % 20 = 0)
        SELECT d AS document_id, p AS provision_id, up AS parent_provision_id, level AS provision_level FROM s WHERE d NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)
        UNION ALL SELECT d, p, CASE WHEN i = 2 THEN p - 1 END, CASE i WHEN 1 THEN 'article' WHEN 2 THEN 'clause' ELSE 'point' END FROM n""",
    ),
    "replaced_relations": (
        replaced_relations,
        """WITH r AS (SELECT o_orderkey AS relation_id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 97 END AS source_document_id, o_orderkey * 3 % 101 AS target_document_id FROM orders), g AS (SELECT s_suppkey AS d FROM supplier WHERE s_suppkey % 10 = 0)
        SELECT * FROM r WHERE NOT EXISTS (FROM g WHERE d = source_document_id) AND NOT EXISTS (FROM g WHERE d = target_document_id)""",
    ),
    "case_graphs": (
        case_graphs,
        """WITH r AS (SELECT o_custkey AS c, max(struct_pack(t := o_orderdate, k := o_orderkey)).k AS k FROM orders GROUP BY 1)
        SELECT c_custkey AS case_id, c_name AS title, CASE WHEN k IS NULL OR k % 4 = 0 THEN 'empty' WHEN k % 4 = 1 THEN 'invalid_json' ELSE 'ready' END AS status, CASE WHEN k % 4 > 1 THEN k END AS run_id, CASE WHEN k % 4 = 3 THEN k % 5 ELSE 0 END::INTEGER AS n_nodes,
            CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END::INTEGER AS n_edges, CASE WHEN k % 4 = 3 THEN o_orderpriority END AS domain, NULL::VARCHAR AS intent FROM customer LEFT JOIN r ON c = c_custkey LEFT JOIN orders ON o_orderkey = k""",
    ),
    "catalog_filters": (
        catalog_filters,
        f"""WITH {DOCUMENTS_SQL}, c(s, x) AS (VALUES ('all', 'all'), ('all', 'de'), ('active', 'all'), ('active', 'de'), ('inactive', 'all'), ('inactive', 'de'))
        SELECT id, s || ' ' || x AS choice FROM kd, c WHERE (s = 'all' OR (s = 'active') = coalesce(legal_status = 'active', false)) AND (x = 'all' OR legal_domain = x)""",
    ),
}
