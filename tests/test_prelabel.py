import json
import re

from pyspark.sql import functions as F

from corpusloom.operators import answers, prelabel

TEXT = "Tổ chức kinh tế phải nộp hồ sơ đầy đủ khi chuyển nhượng, trừ trường hợp luật khác quy định; nếu vi phạm thì sẽ bị xử phạt."


def test_phrases_of_a_provision(spark):
    chunks = spark.createDataFrame([(1, 7, 10, TEXT), (1, 7, 10, TEXT), (1, 8, 0, ""), (1, 9, 0, None), (2, 1, 0, "😀 phải: ; x")], "doc_id long, provision_id long, start int, content string")
    rows = prelabel.semantic_entities(chunks)
    got = {r.label: r for r in rows.where("provision_id = 7").collect()}
    assert set(got) == set(prelabel.SEMANTIC_LABELS)
    for label, pattern in (("SUBJECT", r"\bTổ chức\b"), ("ACTION", r"\bphải\b"), ("EXCEPTION", r"\btrừ trường hợp\b[^.;:\n]{0,180}"), ("CONDITION", r"\btrường hợp\b[^.;:\n]{0,180}"), ("CONSEQUENCE", r"\bsẽ bị\b[^.;:\n]{0,180}")):
        m = re.search(pattern, TEXT, re.I)
        assert (got[label].text, got[label].begin, got[label].end) == (m.group(), 10 + m.start(), 10 + m.end())
    assert got["LEGAL_OBJECT"].text.startswith("nộp hồ sơ") and TEXT[got["LEGAL_OBJECT"].begin - 10 :].startswith("nộp hồ sơ")
    # places count characters, also behind those outside the basic plane
    assert [(r.label, r.begin) for r in rows.where("doc_id = 2").collect()] == [("ACTION", 2)]
    assert rows.where("provision_id in (8, 9)").count() == 0
    relations = {r.relation_type: (r.source_id, r.target_id) for r in prelabel.semantic_relations(rows.where("provision_id = 7")).collect()}
    assert relations["SUBJECT_OF"] == (got["SUBJECT"].entity_id, got["ACTION"].entity_id)
    assert relations["HAS_CONDITION"] == (got["ACTION"].entity_id, got["CONDITION"].entity_id) and len(relations) == 5


def test_words_inside_others_are_no_phrases(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "biển khiếu nại, neutral bin"), (1, 2, 0, "KHI BIN")], "doc_id long, provision_id long, start int, content string")
    assert [(r.provision_id, r.label) for r in prelabel.semantic_entities(chunks).collect()] == [(2, "CONDITION")]


def test_items_of_the_tool(spark):
    item = {"data": {"document_id": "x", "text": "a/b/name.txt"}, "annotations": [{"result": [{"id": "e", "type": "taxonomy", "value": {"labels": ["A"], "start": 1, "end": 3, "text": "bc"}}]}], "predictions": [{"result": []}]}
    items = spark.createDataFrame([(1, json.dumps(item)), (2, "no json"), (3, None), (4, "{}")], "id long, item string")
    docs = prelabel.tool_items(items)
    got = {r.id: r for r in docs.collect()}
    assert (got[1].document_id, got[1].source_file_name, got[1].review_status) == (None, "name.txt", "reviewed")
    assert all(got[i].review_status == "draft" for i in (2, 3, 4))
    assert [(r.id, r.label, r.start, r.end) for r in prelabel.tool_entities(docs, "id").collect()] == [(1, "A", 1, 3)]


def test_findings_of_an_answer(spark):
    row = spark.range(1).select(
        answers.response_findings(F.lit("Theo luật"), F.array(F.lit("Điều 5")), F.lit(True), F.lit(True)).alias("all"),
        answers.response_findings(F.lit("Căn cứ Điều 5: cảnh báo, có mâu thuẫn"), F.array(F.lit("Điều 5")), F.lit(True), F.lit(True)).alias("none"),
        answers.response_findings(F.lit(None).cast("string"), F.array(F.lit("Điều 5")), F.lit(True), F.lit(True)).alias("null"),
    ).first()
    assert len(row["all"]) == 4 and row["none"] == [] and row["null"] == []
