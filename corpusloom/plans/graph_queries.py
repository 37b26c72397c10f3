"""Queries of structure, retrieval, relations and graphs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, tokens
from corpusloom.operators import graph, retrieval, structure

from .standins import EDGES_SQL, edges, table
from .text_queries import FOLD, TOKENS

#: every document whose id is divisible by this is a root
ROOT_STEP = 20


def bfs(depth, spark, sf):
    roots = table(spark, sf, "documents").where(F.col("doc_id") % ROOT_STEP == 0).select(F.col("doc_id").alias("root_id"))
    nodes, _ = graph.neighbourhood(roots, edges(spark, sf), depth)
    return nodes


def bfs_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    walk(root_id, node_id, depth) AS (SELECT doc_id, doc_id, 0 FROM documents WHERE doc_id % {ROOT_STEP} = 0 UNION SELECT root_id, b, depth + 1 FROM walk JOIN both_ways ON node_id = a WHERE depth < {depth})
    SELECT root_id, node_id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1, 2"""


def bfs_edges(spark, sf):
    """Edges that a search of two steps from each root expands."""
    roots = table(spark, sf, "documents").where(F.col("doc_id") % ROOT_STEP == 0).select(F.col("doc_id").alias("root_id"))
    return graph.neighbourhood(roots, edges(spark, sf), 2)[1]


def _concepts(spark, sf):
    """Nations as concepts of customers' questions, suppliers' trade as edges, customers as anchors."""
    c = table(spark, sf, "customer")
    roots = c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(F.col("c_nationkey").cast("long"), (F.col("c_custkey") * 7 % 25))).alias("concept_id"))
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    e = s.select(F.col("s_nationkey").cast("long").alias("src"), ((F.col("s_nationkey") * 3 + key % 2) % 25).alias("dst"), F.when(key % 3 == 0, "REQUIRES").otherwise("ENABLES").alias("edge_type"), (key % 7 < 2).alias("is_active"), key.alias("edge_id"))
    links = c.select(F.col("c_nationkey").cast("long").alias("concept_id"), F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 50 == 1).alias("is_active"))
    return roots, e, links


def concept_graph_nodes(spark, sf):
    return graph.concept_graph(*_concepts(spark, sf), 2)[0].withColumnRenamed("node_id", "concept_id")


def concept_graph_edges(spark, sf):
    """Edges that the search expanded, and those between any two of its nodes."""
    near, inside = (graph.concept_graph(*_concepts(spark, sf), 1, inside=test)[1].select("query_id", "src", "dst", "edge_type", "edge_id") for test in (False, True))
    return near.withColumn("rule", F.lit("near")).unionByName(inside.withColumn("rule", F.lit("inside")))


def concept_graph_anchors(spark, sf):
    return graph.concept_graph(*_concepts(spark, sf), 1)[2].select("query_id", "concept_id", "document_id")


def _concepts_sql(depth: int) -> str:
    return f"""WITH RECURSIVE roots AS (SELECT DISTINCT c_custkey AS query_id, unnest([c_nationkey::BIGINT, c_custkey * 7 % 25]) AS concept_id FROM customer WHERE c_custkey % 20 = 0),
    e AS (SELECT s_nationkey::BIGINT AS src, (s_nationkey * 3 + s_suppkey % 2) % 25 AS dst, CASE WHEN s_suppkey % 3 = 0 THEN 'REQUIRES' ELSE 'ENABLES' END AS edge_type, s_suppkey AS edge_id FROM supplier WHERE s_suppkey % 7 < 2),
    ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    walk(query_id, concept_id, depth) AS (SELECT query_id, concept_id, 0 FROM roots UNION SELECT query_id, b, depth + 1 FROM walk JOIN ways ON concept_id = a WHERE depth < {depth}),
    nodes AS (SELECT query_id, concept_id, min(depth)::INTEGER AS depth FROM walk GROUP BY ALL),
    near AS (SELECT DISTINCT query_id, e.* FROM nodes JOIN e ON concept_id IN (src, dst) AND depth < {depth}),
    inside AS (SELECT a.query_id, e.* FROM e JOIN nodes a ON a.concept_id = src JOIN nodes b ON b.concept_id = dst AND a.query_id = b.query_id)"""


_ONE_EACH = "SELECT query_id, src, dst, edge_type, min(edge_id) AS edge_id, '{0}' AS rule FROM {0} GROUP BY query_id, src, dst, edge_type"


def endpoint_both_in_set(spark, sf):
    nodes = table(spark, sf, "documents").where("doc_id % 4 < 2").select(F.col("doc_id").alias("node_id"))
    return graph.within(edges(spark, sf), nodes).select("src", "dst")


def edge_evidence(spark, sf):
    e = edges(spark, sf).withColumn("relation_type", F.element_at(F.array(F.lit("amends"), F.lit("cites"), F.lit("repeals")), (F.col("src") % 3 + 1).cast("int")))
    e = e.select((F.col("src") % 50).alias("src"), (F.col("dst") % 50).alias("dst"), "relation_type", F.concat("src", F.lit(">"), "dst").alias("sample"))
    return graph.edge_evidence(e).select("src", "dst", "n", F.array_join("types", ",").alias("types"), F.array_join("samples", ",").alias("samples"))


def backend_parity(spark, sf):
    a = edges(spark, sf)
    return graph.parity(a, a.where("src % 10 <> 0").unionByName(a.where("src % 20 = 0")))


ALIASES = ((1, "land", "land"), (1, "land", "quyền sử dụng đất"), (2, "work", "the"), (2, "work", "labour law"), (3, "rule", "and of"), (3, "rule", "des lois"))


def alias_match(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    a = spark.createDataFrame([(*row, i) for i, row in enumerate(ALIASES)], "concept_id int, name string, alias string, alias_order int")
    return graph.match_concepts(q, a).drop("place").withColumn("score", F.round("score", 4))


def lexical_rank(spark, sf):
    """Ten best documents of each benchmark item by weighted words and word pairs."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("words"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), fold(F.col("text")).alias("folded"))
    rows = retrieval.phrase_scores(q, d).select("query_id", "document_id", "score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id"))
    return rows.withColumn("rank", place).where("rank <= 10")


_MARKED = "chr(1) || regexp_replace({0}, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g') || chr(1)"
_TIMES = "((length(m) - length(replace(m, {0}, ''))) // length({0}))"
LEXICAL_SQL = f"""
WITH q AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS words FROM benchmark),
d AS (SELECT doc_id AS document_id, {FOLD.format('text')} AS folded FROM documents),
s AS (SELECT document_id, {_MARKED.format('folded')} AS m, regexp_extract_all(folded, '[\\p{{L}}\\p{{N}}_]+') AS w FROM d),
p AS (SELECT DISTINCT query_id, document_id FROM (SELECT query_id, unnest(words) AS t FROM q) a JOIN (SELECT document_id, unnest(w) AS t FROM s) b USING (t)),
n AS (SELECT query_id, document_id, words, m FROM p JOIN q USING (query_id) JOIN s USING (document_id)),
t AS (SELECT query_id, document_id, m, words, 3 AS weight, unnest(words) AS needle FROM n
    UNION ALL SELECT query_id, document_id, m, words, 8, words[i] || ' ' || words[i + 1] FROM n, (SELECT unnest(range(1, (SELECT max(len(words)) FROM q))) AS i) WHERE i < len(words)
    UNION ALL SELECT query_id, document_id, m, words, 12, words[1] || ' ' || words[2] || ' ' || words[3] FROM n WHERE len(words) >= 3),
c AS (SELECT query_id, document_id, m, weight, {_MARKED.format('needle')} AS needle FROM t),
scored AS (SELECT query_id, document_id, sum(weight * {_TIMES.format('needle')})::INTEGER AS score FROM c GROUP BY 1, 2)
SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id)::INTEGER AS rank FROM scored QUALIFY rank <= 10
"""


def hybrid_rank(spark, sf):
    """Five best of a score mix that follows from ids."""
    e = table(spark, sf, "embeddings")
    c = e.select(
        (F.col("vec_id") % 23).alias("query_id"), F.col("vec_id").alias("document_id"), F.lit(1).alias("chunk_index"), (F.col("vec_id") * 13 % 50).alias("char_count"), (F.col("vec_id") * 7 % 31).alias("lexical"),
        ((F.col("vec_id") * 11 % 64) / 128).alias("semantic"), F.when(F.col("vec_id") % 5 == 0, 0.25).otherwise(0.0).alias("reference"), F.when(F.col("vec_id") % 9 == 0, 0.125).otherwise(0.0).alias("citation"), (F.col("vec_id") % 40 - 20).alias("boost"),
    )
    return retrieval.hybrid_rank(c, 5).select("query_id", "document_id", "rank", F.abs(F.col("score")).alias("score"))


HYBRID_SQL = """
WITH c AS (SELECT vec_id % 23 AS query_id, vec_id AS document_id, vec_id * 13 % 50 AS char_count, vec_id * 7 % 31 AS lexical, (vec_id * 11 % 64) / 128::DOUBLE AS semantic,
    CASE WHEN vec_id % 5 = 0 THEN 0.25::DOUBLE ELSE 0 END AS reference, CASE WHEN vec_id % 9 = 0 THEN 0.125::DOUBLE ELSE 0 END AS citation, vec_id % 40 - 20 AS boost FROM embeddings),
k AS (SELECT * FROM c WHERE lexical > 0 OR semantic >= 0.18 OR reference > 0 OR citation > 0),
s AS (SELECT *, CASE WHEN max(lexical) OVER w > 0 THEN lexical / (max(lexical) OVER w)::DOUBLE ELSE 0 END AS l, CASE WHEN max(semantic) OVER w > 0 THEN semantic / max(semantic) OVER w ELSE 0 END AS m FROM k WINDOW w AS (PARTITION BY query_id)),
t AS (SELECT *, greatest(0, round_even((l * 0.46::DOUBLE + m * 0.36::DOUBLE + reference + citation + greatest(-0.12::DOUBLE, least(0.12::DOUBLE, boost / 100::DOUBLE))) * 100, 0))::INTEGER AS score FROM s)
SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, char_count, document_id)::INTEGER AS rank FROM t QUALIFY rank <= 5
"""


def band_self_join(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    b = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"))
    met = li.join(b, F.col("l_orderkey") == F.col("o")).where((F.col("l_linenumber") != F.col("n")) & ((F.col("l_suppkey") == F.col("s")) | (F.abs(F.col("l_linenumber") - F.col("n")) <= 1)))
    return met.select("l_orderkey", "l_linenumber", "n").distinct()


def null_safe_lookup(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("clause"), F.col("p_brand").alias("article"))
    want = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 50).cast("int")).alias("c"))
    # a supplier's first part is that of its clause, so each clause is looked through once and not once per supplier
    order = F.struct(F.col("article").isNull().alias("last"), "article", F.col("p_partkey").isNull().alias("unnamed"), "p_partkey")
    first = p.groupBy("clause").agg(F.min(order).alias("f"))
    met = want.distinct().join(first, F.col("c").eqNullSafe(F.col("clause")))
    return met.select("s_suppkey", "f.p_partkey", "f.article", "clause")


def chunk_counts(spark, sf):
    """Chunks and their words per document; structure is rare in the driver's texts, so most come from the fallback."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = structure.chunk_metadata(structure.build_chunks(d))
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("chunk_type").alias("type"), F.first("strategy").alias("strategy"))


GRAPH_QUERIES = {
    **{f"bfs_depth_{n}": (partial(bfs, n), bfs_sql(n)) for n in (1, 2, 3)},
    "bfs_edges_depth_2": (bfs_edges, bfs_sql(2).replace("SELECT root_id, node_id, min(depth)", ", seen AS (SELECT root_id, node_id, min(depth)") + ") SELECT DISTINCT root_id, src, dst FROM seen JOIN edges ON node_id IN (src, dst) WHERE depth < 2"),
    "concept_graph_nodes": (concept_graph_nodes, _concepts_sql(2) + " SELECT * FROM nodes"),
    "concept_graph_edges": (concept_graph_edges, _concepts_sql(1) + " " + _ONE_EACH.format("near") + " UNION ALL " + _ONE_EACH.format("inside")),
    "concept_graph_anchors": (concept_graph_anchors, _concepts_sql(1) + " SELECT query_id, concept_id, c_custkey AS document_id FROM nodes JOIN customer ON c_nationkey = concept_id WHERE c_custkey % 50 = 1"),
    "endpoint_both_in_set": (endpoint_both_in_set, f"WITH {EDGES_SQL} SELECT src, dst FROM edges WHERE src IN (SELECT doc_id FROM documents WHERE doc_id % 4 < 2) AND dst IN (SELECT doc_id FROM documents WHERE doc_id % 4 < 2)"),
    "edge_evidence": (
        edge_evidence,
        f"""WITH {EDGES_SQL}, e AS (SELECT src % 50 AS a, dst % 50 AS b, ['amends', 'cites', 'repeals'][src % 3 + 1] AS t, src || '>' || dst AS sample FROM edges)
        SELECT a AS src, b AS dst, count(*) AS n, array_to_string(list_sort(list(DISTINCT t)), ',') AS types, array_to_string(list_slice(list_sort(list(sample)), 1, 5), ',') AS samples FROM e GROUP BY 1, 2""",
    ),
    "backend_parity": (backend_parity, f"WITH {EDGES_SQL} SELECT src, dst, 'left' AS side FROM edges WHERE src % 10 = 0 AND src % 20 <> 0"),
    "alias_match": (
        alias_match,
        f"""WITH a(concept_id, name, alias, o) AS (VALUES {', '.join(f"({c}, '{n}', '{x}', {i})" for i, (c, n, x) in enumerate(ALIASES))}), q AS (SELECT item_id AS query_id, {FOLD.format('text')} AS q FROM benchmark), f AS (SELECT *, {FOLD.format('alias')} AS f FROM a),
        s AS (SELECT query_id, concept_id, name, alias, o, CASE WHEN f = q THEN 1.0 WHEN contains(q, f) THEN least(0.98, 0.6 + length(f) / greatest(length(q), 1)::DOUBLE * 0.4)
            WHEN len(list_filter(string_split(f, ' '), lambda t: NOT contains(q, t))) = 0 THEN 0.55 END::DOUBLE AS score FROM q, f)
        SELECT query_id, concept_id, name, alias, round(score, 4) AS score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, concept_id ORDER BY score DESC, o) = 1""",
    ),
    "lexical_rank": (lexical_rank, LEXICAL_SQL),
    "hybrid_rank": (hybrid_rank, HYBRID_SQL),
    "band_self_join": (
        band_self_join,
        "SELECT DISTINCT a.l_orderkey, a.l_linenumber, b.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber AND (a.l_suppkey = b.l_suppkey OR abs(a.l_linenumber - b.l_linenumber) <= 1)",
    ),
    "null_safe_lookup": (
        null_safe_lookup,
        """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS clause, p_brand AS article FROM part), w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 50)::INTEGER END AS c FROM supplier)
        SELECT s_suppkey, p_partkey, article, clause FROM w JOIN p ON c IS NOT DISTINCT FROM clause QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY article, p_partkey) = 1""",
    ),
    "chunk_counts": (chunk_counts, None),
}


def chunk_offsets(spark, sf):
    """Offsets of messages in the joined text of their conversation."""
    from corpusloom.operators import annotation

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))
    return annotation.source_text(c).select("doc_id", "chunk_index", "start", "stop")


HINTS = ("information", "new data")


def search_tables(spark, sf):
    """Benchmark items as questions that name an article, documents as chunks of articles."""
    asked = F.concat("text", F.lit(" dieu "), (F.col("item_id") % 5 + 1).cast("string"))
    hints = F.when(F.col("item_id") % 2 == 0, F.array(*map(F.lit, HINTS)))
    none = F.lit(None).cast("array<double>").alias("vector")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), asked.alias("text"), hints.alias("hints"), none)
    article = (F.col("doc_id") % 7).cast("string")
    no = F.lit(None).cast("string")
    c = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), article.alias("article_number"), no.alias("clause_number"), no.alias("point_number"),
        no.alias("section_title"), F.concat(F.lit("\u0110i\u1ec1u "), article).alias("citation_label"), none, (F.col("doc_id") % 30 - 10).alias("boost"),
    )
    return q, c


def search_prefilter(spark, sf):
    q, c = search_tables(spark, sf)
    return retrieval.prefilter(q.withColumn("words", tokens(F.col("text"))), c).select("query_id", "document_id")


def search(spark, sf):
    """Five best chunks of each question by words, hints, the article it names and the document's boost."""
    return retrieval.search(*search_tables(spark, sf)).select("query_id", "document_id", "score", "rank")


_SEARCH = f"""
WITH a AS (SELECT item_id AS query_id, text || ' dieu ' || (item_id % 5 + 1) AS question, CASE WHEN item_id % 2 = 0 THEN {list(HINTS)} ELSE []::VARCHAR[] END AS hints FROM benchmark),
q AS (SELECT query_id, question, hints, {TOKENS.format('question')} AS words FROM a),
d AS (SELECT doc_id AS document_id, text, lower(text) AS low, doc_id % 7 AS article, doc_id % 30 - 10 AS boost, {FOLD.format('text')} AS folded FROM documents),
term AS (SELECT DISTINCT query_id, lower(t) AS t FROM (SELECT query_id, unnest(list_concat(words[1:8], hints[1:4])) AS t FROM q) WHERE length(t) >= 3),
pre AS (SELECT query_id, document_id FROM (SELECT DISTINCT query_id, document_id FROM term JOIN d ON contains(low, t)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id) <= 5000)
"""
SEARCH_SQL = f"""{_SEARCH},
pair AS (SELECT * FROM pre UNION ALL SELECT query_id, document_id FROM q, d WHERE len(words) > 0 AND query_id NOT IN (SELECT query_id FROM pre)),
s AS (SELECT document_id, {_MARKED.format('folded')} AS m FROM d),
n AS (SELECT query_id, document_id, words, hints, m FROM pair JOIN q USING (query_id) JOIN s USING (document_id)),
t AS (SELECT query_id, document_id, m, 3 AS weight, unnest(words) AS needle FROM n
    UNION ALL SELECT query_id, document_id, m, 8, words[i] || ' ' || words[i + 1] FROM n, (SELECT unnest(range(1, (SELECT max(len(words)) FROM q))) AS i) WHERE i < len(words)
    UNION ALL SELECT query_id, document_id, m, 12, words[1] || ' ' || words[2] || ' ' || words[3] FROM n WHERE len(words) >= 3
    UNION ALL SELECT query_id, document_id, m, 10, unnest(hints) FROM n),
c AS (SELECT query_id, document_id, m, weight, {_MARKED.format('needle')} AS needle FROM t),
l AS (SELECT query_id, document_id, sum(weight * {_TIMES.format('needle')})::INTEGER AS lexical FROM c GROUP BY 1, 2),
x AS (SELECT query_id, document_id, lexical, boost, length(text) AS n, article = query_id % 5 + 1 AS named FROM l JOIN d USING (document_id)),
k AS (SELECT *, max(lexical) OVER (PARTITION BY query_id) AS best FROM x WHERE lexical > 0 OR named),
r AS (SELECT query_id, document_id, n, greatest(0, round_even((CASE WHEN best > 0 THEN lexical::DOUBLE / best ELSE 0.0::DOUBLE END * 0.46::DOUBLE + 0.0::DOUBLE * 0.36::DOUBLE + CASE WHEN named THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN named THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END + greatest(-0.12::DOUBLE, least(0.12::DOUBLE, boost::DOUBLE / 100))) * 100::DOUBLE, 0)::INTEGER) AS score FROM k)
SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n, document_id)::INTEGER AS rank FROM r QUALIFY rank <= 5
"""


def edited_texts(spark, sf):
    from corpusloom.operators import editing

    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(editing.normalise_white_space(F.col("text")), 256).alias("spaced"), F.sha2(editing.drop_blank_lines(F.col("text")), 256).alias("dense"))


def text_scores(spark, sf):
    """Cleanliness, structure and chunk scores of the documents with their fallback chunks."""
    from corpusloom.operators import quality

    d = table(spark, sf, "documents").select("doc_id", "text")
    out = quality.text_scores(d, structure.fallback_chunks(d))
    total = quality.direct_total(F.col("clean_score"), F.col("structure_score"), F.lit(15.0), F.col("chunk_score"))
    return out.select("doc_id", "has_text", F.round("clean_score", 4).alias("clean_score"), F.round("structure_score", 4).alias("structure_score"), F.round("chunk_score", 4).alias("chunk_score"), quality.direct_label(total).alias("label"))


GRAPH_QUERIES |= {
    "chunk_offsets": (
        chunk_offsets,
        """WITH c AS (SELECT conv_id AS doc_id, turn AS chunk_index, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)
        SELECT doc_id, chunk_index, start, start + n AS stop FROM c""",
    ),
    "edited_texts": (
        edited_texts,
        r"""SELECT doc_id, sha256(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS spaced,
        sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> ''), chr(10))) AS dense FROM documents""",
    ),
    "text_scores": (text_scores, None),
    "search_prefilter": (search_prefilter, _SEARCH + "SELECT query_id, document_id FROM pre"),
    "search": (search, SEARCH_SQL),
}
