import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import flow, guards, rollups


def tables(spark):
    q = spark.createDataFrame([(1, "Thu hồi đất đai khoản bồi thường", None, None), (2, "zzz qqq", None, None)], "query_id long, text string, hints array<string>, vector array<double>")
    chunks = spark.createDataFrame(
        [(10, 0, "Quy định bồi thường thu hồi đất", "1", "Điều 1"), (10, 1, "Tiếp theo", "1", None), (11, 0, "Đất thu", "2", None), (12, 0, "Mở đầu", "3", "Điều 3")],
        "document_id long, chunk_index int, content string, article_number string, citation_label string",
    )
    none = F.lit(None).cast("string")
    chunks = chunks.withColumns({"clause_number": none, "point_number": none, "section_title": none, "vector": F.lit(None).cast("array<double>"), "boost": F.lit(0)})
    day = datetime.date
    docs = spark.createDataFrame(
        [(10, "Luật A", "luat", "quoc-hoi", None, "active", None, None, day(2020, 1, 1)), (11, "Nghị định B", "nghi-dinh", "chinh-phu", None, "expired", None, day(2021, 1, 1), day(2019, 1, 1)), (12, "Thông tư C", "thong-tu", "bo", None, "active", None, None, None)],
        "id long, title string, document_type string, authority_level string, normative_level int, legal_status string, effective_date date, expiry_date date, signed_date date",
    )
    relations = spark.createDataFrame([(10, 12, "amends")], "source_document_id long, target_document_id long, relation_type string")
    aliases = spark.createDataFrame([(1, "Đất", "dat dai", 0), (2, "Bồi thường", "tien boi thuong x", 1)], "concept_id int, name string, alias string, alias_order int")
    concepts = spark.createDataFrame([(1, "Đất"), (2, "Bồi thường")], "concept_id int, name string")
    edges = spark.createDataFrame([(1, 2, "ENABLES_RIGHT", "mở quyền", True), (2, 1, "X", None, False)], "src int, dst int, edge_type string, label string, is_active boolean")
    links = spark.createDataFrame([(2, 12, 5, True, "defines", "Điều 9", None), (1, 10, 4, True, None, None, None)], "concept_id int, document_id long, link_id long, is_active boolean, relation_role string, citation_label string, source_excerpt string")
    return q, chunks, docs, relations, aliases, concepts, edges, links


def test_flow(spark):
    stages = flow.run_tools(*tables(spark), F.lit("2026-01-15").cast("date"))
    rows = {r.query_id: r for r in flow.answers(stages).collect()}
    one = rows[1]
    assert (one.domain, one.intent) == ("dat-dai", "legal_qa") and [e.document_id for e in one.evidence] == [10, 11]
    assert [e.is_authoritative for e in one.evidence] == [True, False]
    assert [(n.id, n.label) for n in one.graph_nodes] == [("issue", "dat-dai"), ("evidence:10:0", "Điều 1"), ("evidence:11:0", "Nghị định B"), ("related:10:1", "Luật A"), ("related:12:0", "Điều 3")]
    assert [e.type for e in one.graph_edges] == ["SUPPORTED_BY", "SUPPORTED_BY", "SAME_DOCUMENT_CONTEXT", "AMENDS"]
    assert "- Đất -> mở quyền -> Bồi thường" in one.answer and "- defines - Điều 9 - Thông tư C" in one.answer
    assert "- Đoạn liên quan - Nghị định B [Document status is marked as expired.; Document expired on 2021-01-01.]" in one.answer
    assert "nghiêng về văn bản ID 10 theo validity." in one.answer and "Đã tìm thấy 2 điều khoản" in one.answer
    assert rows[2].evidence is None and rows[2].answer.startswith("Kết luận: Chưa đủ căn cứ") and [n.id for n in rows[2].graph_nodes] == ["issue"]
    # every stage is a written table
    for stage in (stages.hits, stages.articles, stages.nodes, stages.edges, stages.anchors, stages.conflicts):
        assert "Scan parquet" in stage._jdf.queryExecution().executedPlan().toString()


def test_answers_that_cannot_be_trusted(spark):
    rows = [
        (1, 'Kết quả: {"title": " T ", "legal_domain": "dat-dai", "other": {"a": 1}} xong'), (2, '{"title": "", "legal_domain": "elsewhere"}'), (3, '{"title": "cut'), (4, None), (5, '{"title": "x", }'),
        (6, '{"title": ["a"], "legal_domain": 5}'), (7, "[1]"),
    ]
    replies = spark.createDataFrame(rows, "id long, reply string")
    rules = spark.createDataFrame([(i, "rule", "khac") for i in range(1, 9)], "id long, title string, legal_domain string")
    allowed = spark.createDataFrame([("legal_domain", "dat-dai"), ("legal_domain", "lao-dong")], "field string, value string")
    out = {r.id: (r.title, r.legal_domain, r.outcome) for r in guards.merged_answers(rules, replies, "id", ("title", "legal_domain"), allowed).collect()}
    assert out[1] == ("T", "dat-dai", "answer") and out[2] == ("rule", "khac", "partly") and out[6][1:] == ("khac", "partly")
    assert all(out[i] == ("rule", "khac", "default") for i in (3, 4, 5, 7, 8))
    bad = {(r.id, r.reason) for r in guards.quarantine(guards.read_answers(replies, "id")).collect()}
    assert bad == {(3, "no object"), (4, "no object"), (5, "broken"), (7, "no object")}
    with pytest.raises(ValueError):
        guards.allow_list(spark.range(guards.MOST_ALLOWED + 1).selectExpr("'f' as field", "cast(id as string) as value"))


def test_proposed_provisions(spark):
    reply = """{"provisions": [{"provision_level": " Article ", "article_number": "7a", "content": " A ", "node_id": "n"}, 3, {"provision_level": "part", "content": "x"}, {"provision_level": "clause", "content": ""},
        {"provision_level": "clause", "article_number": "7a", "clause_number": "2", "content": "B", "parent_node_id": "n"}, {"provision_level": "point", "point_code": "đ", "content": "C", "parent_node_id": "node-2", "heading": "H"},
        {"provision_level": "article", "content": "D", "parent_node_id": "gone"}]}"""
    rows = guards.sanitised_provisions(spark.createDataFrame([(1, reply), (2, '{"provisions": "none"}'), (3, "")], "id long, reply string"), "id").orderBy("seq").collect()
    assert [(r.id, r.seq, r.parent_seq, r.content, r.citation_label, r.sort_key) for r in rows] == [
        (1, 1, None, "A", "Điều 7a", "007.000.000"), (1, 2, 1, "B", "Điều 7a Khoản 2", "007.002.000"), (1, 3, 2, "C", "Điểm đ", "000.000.177"), (1, 4, None, "D", "Article 4", "000.000.000"),
    ]


def test_rollups(spark):
    rows = spark.createDataFrame([("a", "r", ["x", "y"]), (None, "r", []), ("a", "s", None)], "legal_domain string, selection_reason string, issue_codes array<string>")
    known = spark.createDataFrame([("issue_counts", "z")], "kind string, key string")
    got = {(r.kind, r.key): r.n for r in rollups.selection_summary(rows, known).collect()}
    assert got == {("selected_count", "all"): 3, ("by_domain", "a"): 2, ("by_domain", "None"): 1, ("by_selection_reason", "r"): 2, ("by_selection_reason", "s"): 1, ("issue_counts", "x"): 1, ("issue_counts", "y"): 1, ("issue_counts", "z"): 0}
    plan = rollups.selection_summary(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    m = spark.createDataFrame([("a", "p", 1), (None, "p", 3), ("a", "q", None)], "d string, e string, v long")
    got = {(r.dimension, r.value): (r.rows, r.v_sum, r.v_mean) for r in rollups.totals_and_means(m, ["d", "e"], ["v"]).collect()}
    assert got == {("d", "a"): (2, 1, 1.0), ("d", None): (1, 3, 3.0), ("e", "p"): (2, 4, 2.0), ("e", "q"): (1, 0, None), ("all", None): (3, 4, 2.0)}
