"""What bounds the memory and the cores of queries: plans without broadcasts, rows dealt to all cores, work done once."""

import os

import pandas as pd
import pytest

from corpusloom.operators import payloads, prelabel
from corpusloom.plans import annotation_queries, rollup_queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_tool_items_are_read_once_on_all_cores(spark):
    """an item's JSON is parsed once, not for each field, after the rows were dealt out."""
    shown = plan(annotation_queries.tool_documents(spark, SF))
    assert shown.count("from_json(") == 1 and "REPARTITION_BY_NUM" in shown


def test_tool_items_of_odd_shapes(spark):
    """a field of another shape takes nothing from the others; a column named like the parsed item stays."""
    rows = [(1, '{"data": {"document_id": "7", "text": "t"}, "annotations": "x", "predictions": [{"result": []}]}', "own"), (2, "[]", "own"), (3, None, "own"), (4, '{"data": "x", "annotations": [{"result": "y"}]}', "own")]
    out = prelabel.tool_items(spark.createDataFrame(rows, "k int, item string, _item string")).orderBy("k").select("k", "_item", "document_id", "source_text", "language", "review_status").collect()
    assert [tuple(r) for r in out[:3]] == [(1, "own", 7, "t", "vi", "predicted"), (2, "own", None, None, "vi", "draft"), (3, "own", None, None, "vi", "draft")]
    assert (out[3].document_id, out[3].source_text) == (None, None)


@needs_tables
def test_semantic_relations_are_dealt_once(spark):
    """parts are dealt by document before patterns are tried, and no shuffle follows."""
    shown = plan(annotation_queries.semantic_relations(spark, SF))
    assert shown.count("Exchange") == 1 and "REPARTITION_BY_NUM" in shown


def test_tasks_broadcast_nothing(spark):
    """small in the shuffle is not small in memory."""
    docs = spark.createDataFrame([(1, "a.txt", "vi", "x")], "document_id long, source_file_name string, language string, text string")
    entities = spark.createDataFrame([(1, "e", "TITLE", "x", 0, 1, None, {"a": "b"})], "document_id long, entity_id string, label string, text string, start long, end long, normalized_value string, attributes map<string, string>")
    relations = spark.createDataFrame([(1, "r", "CITES", "e", "e", 0.5, {"a": "b"}), (1, "s", "CITES", "e", "none", 0.5, {"a": "b"})], "document_id long, relation_id string, relation_type string, source_id string, target_id string, score double, attributes map<string, string>")
    made = payloads.annotation_tasks(docs, entities, relations)
    shown = made._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Join ") == shown.count("strategy=merge") > 0
    task = made.first()["task"]
    assert '"id":"r"' in task and '"id":"s"' not in task


def test_files_are_made_a_few_at_a_time():
    """a task does not hold the files of a whole batch."""
    n = 3 * rollup_queries.FILES_AT_ONCE + 1
    made = list(rollup_queries._files(iter([pd.DataFrame({"doc_id": range(n), "lines": [["x"]] * n})])))
    assert [len(x) for x in made] == [rollup_queries.FILES_AT_ONCE] * 3 + [1]
    assert [p for x in made for p in x["path"]] == [f"/in/{i}.docx" for i in range(n)]
