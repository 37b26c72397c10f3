"""Bounded traversal of document and concept graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.shared import Tables, dealt_join
from corpusloom.functions.text import fold


#: neighbours of a node that one task expands; nodes of more are hubs and are dealt to several
HUB = 10_000
#: anchors of one concept that one task makes
ANCHORS_A_TASK = 1_000_000


def _salted_arcs(tables: Tables, edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, salt) of each edge in both directions, and (a, ways) of the hubs: at most one in ``hub`` arcs."""
    both = tables.save(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct(), "both")
    hubs = tables.save(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("a", F.ceil(F.col("n") / hub).cast("int").alias("ways")), "hubs")
    salt = F.pmod(F.xxhash64("b"), F.coalesce("ways", F.lit(1))).cast("int")
    return both.join(hubs, "a", "left").select("a", "b", salt.alias("salt")), hubs


def traverse(starts: DataFrame, edges: DataFrame, depth: int, most: int = 3, hub: int = HUB) -> DataFrame:
    """(root_id, node_id, depth): least number of steps, in either direction, from the nodes (root_id, node_id) that a search starts from.

    The depth is clamped to 1..``most``.  Each level is written and only expands the one before.  Steps go both
    ways, so a neighbour of a level is in the level before it, in itself or is new: those two are all that is
    taken out, however many nodes have been seen.  Arcs of hubs are dealt by salt, which the frontier follows.
    The search ends early when a level is empty.
    """
    tables = Tables(starts.sparkSession, "walk")
    arcs, hubs = _salted_arcs(tables, edges, hub)
    arcs = tables.save(arcs, "arcs")
    levels = [tables.save(starts.select("root_id", "node_id").distinct(), "level0")]
    for i in range(1, max(1, min(most, depth)) + 1):
        spread = levels[-1].join(hubs, F.col("node_id") == F.col("a"), "left").select("root_id", "node_id", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("salt"))
        reached = spread.join(arcs, (F.col("node_id") == F.col("a")) & (spread["salt"] == arcs["salt"])).select("root_id", F.col("b").alias("node_id")).distinct()
        for old in levels[-2:]:
            reached = reached.join(old, ["root_id", "node_id"], "left_anti")
        levels.append(tables.save(reached, f"level{i}"))
        if levels[-1].isEmpty():
            break
    tables.drop("both")
    return reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(i)) for i, level in enumerate(levels)])


def edges_near(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges per root_id of which an end is less than ``depth`` steps away: those that a search has expanded."""
    inner = nodes.where(F.col("depth") < depth)
    out = [inner.join(edges, F.col("node_id") == F.col(end)).select("root_id", *edges.columns) for end in ("src", "dst")]
    return reduce(DataFrame.union, out).distinct()


def edges_inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges per root_id of which both ends have been reached."""
    from_ = nodes.select("root_id", F.col("node_id").alias("src"))
    to = nodes.select("root_id", F.col("node_id").alias("dst"))
    return edges.join(from_, "src").join(to, ["root_id", "dst"], "left_semi").select("root_id", *edges.columns)


def neighbourhood(roots: DataFrame, edges: DataFrame, depth: int, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (root_id, node_id, depth) within ``depth`` steps of each root (root_id), and the edges expanded on the way."""
    nodes = traverse(roots.select("root_id", F.col("root_id").alias("node_id")), edges, depth, most)
    return nodes, edges_near(nodes, edges, max(1, min(most, depth)))


def concept_graph(roots: DataFrame, edges: DataFrame, links: DataFrame, depth: int, inside: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and anchors of a search over concepts per question.

    roots (query_id, concept_id) are the concepts that a question starts from, all at depth 0; edges (src, dst,
    edge_type, is_active, ...) count while active, one of each type; links (concept_id, document_id, is_active, ...)
    anchor concepts in documents.  With ``inside`` edges between any two nodes are kept, as a path pattern
    finds them, else those that the search expanded.  The depth is clamped to 1..4.
    """
    keys = ("src", "dst", "edge_type")
    # questions meet one edge of each type, not all that there are of it
    rest = F.min(F.struct(*(c for c in edges.columns if c not in keys))).alias("rest")
    active = edges.where("is_active").groupBy(*keys).agg(rest).select(*(c if c in keys else f"rest.{c}" for c in edges.columns))
    tables = Tables(roots.sparkSession, "concepts")
    active = tables.save(active, "active")
    starts = roots.select(F.col("query_id").alias("root_id"), F.col("concept_id").alias("node_id"))
    nodes = traverse(starts, active, depth, most=4)
    kept = edges_inside(nodes, active) if inside else edges_near(nodes, active, max(1, min(4, depth)))
    # an edge's ends are nodes even where the search ended before it expanded them
    ends = kept.select("root_id", F.explode(F.array("src", "dst")).alias("concept_id")).distinct()
    named = nodes.select("root_id", F.col("node_id").alias("concept_id")).union(ends).distinct()
    named = tables.save(named, "named")
    anchors = dealt_join(named, links.where("is_active"), "concept_id", "root_id", tables, ANCHORS_A_TASK).withColumnRenamed("root_id", "query_id")
    return nodes.withColumnRenamed("root_id", "query_id"), kept.withColumnRenamed("root_id", "query_id"), anchors


def within(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among the nodes (node_id)."""
    for end in (src, dst):
        edges = edges.join(nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    return edges


def edge_evidence(relations: DataFrame, samples: int = 5) -> DataFrame:
    """Per pair of documents: number of provision relations, their types and the first samples."""
    rows = F.array_sort(F.collect_list("sample")) if "sample" in relations.columns else F.array().cast("array<string>")
    return relations.groupBy("src", "dst").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("relation_type")).alias("types"), F.slice(rows, 1, samples).alias("samples"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side's name: no rows mean equal multisets."""
    left, right = a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))
    return left.unionByName(right)


def alias_score(query: Column, alias: Column) -> Column:
    """1 for equal folded texts, up to .98 by share of length where the query contains the alias, .55 where it has all words."""
    inside = F.least(F.lit(0.98), 0.6 + F.length(alias) / F.greatest(F.length(query), F.lit(1)) * 0.4)
    every = F.forall(F.split(alias, " "), lambda t: F.contains(query, t))
    return F.when((alias == "") | (query == ""), None).when(alias == query, 1.0).when(F.contains(query, alias), inside).when(every, 0.55)


def match_concepts(queries: DataFrame, aliases: DataFrame, limit: int = 8, dictionary_rows: int = 10_000) -> DataFrame:
    """Best alias per query (query_id, text) and concept (concept_id, name, alias, alias_order).

    The dictionary is a bounded table: more than ``dictionary_rows`` aliases raise, since each is tried on each query.
    """
    words = aliases.withColumn("folded", fold(F.col("alias")))
    if words.limit(dictionary_rows + 1).count() > dictionary_rows:
        raise ValueError(f"a concept dictionary has at most {dictionary_rows} aliases")
    rows = queries.withColumn("q", fold(F.col("text"))).join(F.broadcast(words), F.lit(True)).withColumn("score", alias_score(F.col("q"), F.col("folded"))).where("score is not null")
    best = F.row_number().over(Window.partitionBy("query_id", "concept_id").orderBy(F.desc("score"), "alias_order"))
    rows = rows.withColumn("b", best).where("b = 1").withColumn("score", F.bround("score", 4))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "concept_id", "name", "alias", "score", "place")
