"""Stored provisions that are replaced by those of a new parse, and the reasoning graph of a case's latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import positions


def replace_provisions(stored: DataFrame, new: DataFrame, cleared: DataFrame) -> DataFrame:
    """``stored`` without the provisions of the documents in ``cleared`` (document_id), and with the new ones.

    stored has document_id, provision_id, parent_provision_id and further columns; new has document_id, index (from 1 in each
    document), parent_index and the same further columns.  New ids go on after the largest stored one, by document and
    index.  A parent is a provision of the same document with a smaller index; any other parent index is none.
    """
    kept = stored.join(cleared.select("document_id").distinct(), "document_id", "left_anti")
    last = stored.agg(F.coalesce(F.max("provision_id"), F.lit(0))).first()[0]
    placed = positions(new.join(cleared.select("document_id").distinct(), "document_id", "left_semi"), F.col("document_id"), F.col("index"), name="_place")
    named = placed.withColumn("provision_id", F.col("_place") + F.lit(last))
    parents = named.select("document_id", F.col("index").alias("parent_index"), F.col("provision_id").alias("_parent"))
    met = named.join(parents, ["document_id", "parent_index"], "left")
    met = met.withColumn("parent_provision_id", F.when(F.col("parent_index") < F.col("index"), F.col("_parent")))
    return kept.select(*stored.columns).unionByName(met.select(*stored.columns))


def cleared_relations(relations: DataFrame, cleared: DataFrame) -> DataFrame:
    """Relations of provisions (source_document_id, target_document_id, ...) that touch no document in ``cleared``, on either side."""
    gone = cleared.select("document_id").distinct()
    for side in ("source_document_id", "target_document_id"):
        # a null end names no document
        relations = relations.join(gone.withColumnRenamed("document_id", side), side, "left_anti").select(*relations.columns)
    return relations


def case_graphs(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """case_id, title, status, run_id, nodes, edges, domain, intent: what the latest run (case_id, id, updated_at, graph_json) of each case reasoned.

    Without a run or a graph the status is empty, with one that cannot be read invalid_json, else ready; a graph that is no
    object has neither nodes nor edges.  nodes and edges are arrays of VARIANT.
    """
    latest = runs.groupBy("case_id").agg(F.max(F.struct("updated_at", "id", "graph_json")).alias("run"))
    out = cases.join(latest, "case_id", "left")
    text = F.nullif(F.col("run.graph_json"), F.lit(""))
    graph = F.try_parse_json(text)
    status = F.when(text.isNull(), "empty").when(graph.isNull(), "invalid_json").otherwise("ready")
    get = lambda path, kind: F.try_variant_get(graph, path, kind)
    parts = lambda path: F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>"))
    return out.select(
        "case_id", "title", status.alias("status"), F.when(status == "ready", F.col("run.id")).alias("run_id"), parts("$.nodes").alias("nodes"), parts("$.edges").alias("edges"), get("$.domain", "string").alias("domain"), get("$.intent", "string").alias("intent")
    )


def catalog_filter(status: str, domain: str, is_active: Column, legal_domain: Column) -> Column:
    """What a list of documents shows for a choice of status (all, active, inactive) and of domain (all or one)."""
    by_status = {"all": F.lit(True), "active": F.coalesce(is_active, F.lit(False)), "inactive": ~F.coalesce(is_active, F.lit(False))}
    # any other choice shows nothing
    shown = by_status.get(status, F.lit(False))
    return shown if domain == "all" else shown & legal_domain.eqNullSafe(F.lit(domain))
