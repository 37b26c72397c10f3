import datetime
import json

from corpusloom.operators import payloads, provisions


def test_bundle(spark):
    c = spark.createDataFrame([(1, "A"), (2, "B")], "case_id long, title string")
    t = lambda d: datetime.datetime(2025, 1, d)
    facts = spark.createDataFrame([(1, 7, t(2), "x"), (1, 6, t(2), "y"), (1, 5, t(3), None)], "case_id long, id long, created_at timestamp, value string")
    runs = spark.createDataFrame([(1, 1, t(1), "old"), (1, 2, t(4), "new"), (1, 3, t(4), "newest"), (1, 4, None, "never")], "case_id long, id long, updated_at timestamp, status string")
    rows = {r.case_id: json.loads(r.bundle) for r in payloads.case_bundles(c, facts, runs, runs.limit(0), runs).collect()}
    assert [f["id"] for f in rows[1]["facts"]] == [6, 7, 5] and [p["id"] for p in rows[1]["planner_runs"]] == [3, 2, 1, 4]
    assert rows[1]["validation_runs"] == [] and rows[2] == {"case": {"case_id": 2, "title": "B"}, "facts": [], "planner_runs": [], "validation_runs": [], "tickets": []}


def test_task(spark):
    docs = spark.createDataFrame([(1, "a.txt", "vi", 'Điều "1"'), (2, None, "vi", None)], "document_id long, source_file_name string, language string, text string")
    entities = spark.createDataFrame(
        [(1, "e1", "ARTICLE", "Điều 1", 0, 6, None, {"article_number": "1", "prediction_score": "0.5"}), (1, "e2", "CLAUSE", "x", 9, 10, None, {}), (1, "m", "TITLE", "T", None, None, "", {"a": "b"})],
        "document_id long, entity_id string, label string, text string, start long, end long, normalized_value string, attributes map<string,string>",
    )
    relations = spark.createDataFrame([(1, "r", "CITES", "e1", "e2", 0.9, {"k": "v"}), (1, "s", "CITES", "e1", "m", None, None)], "document_id long, relation_id string, relation_type string, source_id string, target_id string, score double, attributes map<string,string>")
    tasks = {r.document_id: json.loads(r.task) for r in payloads.annotation_tasks(docs, entities, relations).collect()}
    assert tasks[1] == {
        "data": {"document_id": 1, "source_file_name": "a.txt", "language": "vi", "text": 'Điều "1"', "metadata_prelabels": [{"entity_id": "m", "label": "TITLE", "text": "T", "normalized_value": "T", "attributes": {"a": "b"}}]},
        "predictions": [{"model_version": payloads.PROPOSED_BY, "result": [
            {"id": "e1", "type": "labels", "from_name": "label", "to_name": "text", "value": {"start": 0, "end": 6, "text": "Điều 1", "labels": ["ARTICLE"], "article_number": "1"}, "score": 0.5},
            {"id": "e2", "type": "labels", "from_name": "label", "to_name": "text", "value": {"start": 9, "end": 10, "text": "x", "labels": ["CLAUSE"]}},
            {"id": "r", "type": "relation", "from_id": "e1", "to_id": "e2", "labels": ["CITES"], "score": 0.9, "value": {"k": "v"}},
        ]}],
    }
    assert tasks[2]["predictions"][0]["result"] == [] and tasks[2]["data"]["metadata_prelabels"] == []


def test_answers_and_shown_values(spark):
    rows = [
        ('{"content": [{"type": "text", "text": " a "}, {"type": "x", "text": "b"}, {"type": "text"}, {"type": "text", "text": "c"}]}', "anthropic", "a\nc"),
        ('{"output_text": "  ", "output": [{"type": "message", "content": [{"type": "output_text", "text": ""}, {"type": "output_text", "text": "d"}]}]}', "x", "d"),
        ('{"choices": [{"message": {"content": "e"}}], "output_text": "f"}', "x", "e"), ("{broken", "x", ""), (None, "x", ""), ('{"content": 5}', "anthropic", ""), ('{"output": [1, {"type": "message"}]}', "x", ""),
    ]
    df = spark.createDataFrame(rows, "payload string, provider string, want string")
    got = df.select(payloads.response_text(df.payload, df.provider).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    rows = [('["a", 1, null, {"b": 2}]', ["a", "1", '{"b":2}']), ('{"x": "y", "z": [1]}', ["x: y", "z: [1]"]), (" plain ", ["plain"]), ("", []), (None, []), ('"quoted"', ['"quoted"'])]
    df = spark.createDataFrame(rows, "v string, want array<string>")
    got = df.select(payloads.shown(df.v).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_replaced_provisions(spark):
    stored = spark.createDataFrame([(1, 10, None, "a"), (1, 11, 10, "b"), (2, 20, None, "a"), (3, 5, None, "x")], "document_id long, provision_id long, parent_provision_id long, level string")
    new = spark.createDataFrame([(2, 2, 1, "n2"), (2, 1, 2, "n1"), (4, 1, None, "m"), (1, 1, None, "not cleared")], "document_id long, index int, parent_index int, level string")
    cleared = spark.createDataFrame([(2,), (4,), (3,)], "document_id long")
    got = {tuple(r) for r in provisions.replace_provisions(stored, new, cleared).collect()}
    assert got == {(1, 10, None, "a"), (1, 11, 10, "b"), (2, 21, None, "n1"), (2, 22, 21, "n2"), (4, 23, None, "m")}
    relations = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, None, 1)], "relation_id long, source_document_id long, target_document_id long")
    assert {r.relation_id for r in provisions.cleared_relations(relations, cleared).collect()} == {1, 4}
    assert provisions.replace_provisions(stored.limit(0), new.limit(0), cleared).count() == 0


def test_case_graphs(spark):
    cases = spark.createDataFrame([(i, f"c{i}") for i in range(5)], "case_id long, title string")
    t = lambda d: datetime.datetime(2025, 1, d)
    runs = spark.createDataFrame([(1, 1, t(1), '{"nodes": [1]}'), (1, 2, t(2), '{"nodes": [1, {"id": 2}], "intent": "x"}'), (2, 3, t(1), "{"), (3, 4, t(1), None), (4, 5, t(1), "[]")], "case_id long, id long, updated_at timestamp, graph_json string")
    rows = {r.case_id: r for r in provisions.case_graphs(cases, runs).selectExpr("case_id", "status", "run_id", "size(nodes) n", "intent").collect()}
    assert [(rows[i].status, rows[i].run_id, rows[i].n) for i in range(5)] == [("empty", None, 0), ("ready", 2, 2), ("invalid_json", None, 0), ("empty", None, 0), ("ready", 5, 0)] and rows[1].intent == "x"
