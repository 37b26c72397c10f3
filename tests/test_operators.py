import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import annotation, editing, graph, identity, metadata, qa, relations, retrieval, rules

DAY = datetime.date(2026, 1, 15)


def test_validity_and_conflict(spark):
    d = spark.createDataFrame([(1, "active", DAY - datetime.timedelta(15), None), (2, "expired", None, DAY - datetime.timedelta(1)), (3, "draft", None, None)], "id long, legal_status string, effective_date date, expiry_date date")
    rows = {r.id: r for r in rules.validity(d, F.lit(DAY)).collect()}
    assert rows[1].is_authoritative and rows[1].reasons == ["Document is active within the evaluated date range."]
    assert not rows[2].is_effective and any("expired" in x for x in rows[2].reasons)
    pair = spark.createDataFrame([(10, True, 60, None, 20, True, 100, None)], "l_id int, l_valid boolean, l_priority int, l_signed_date date, r_id int, r_valid boolean, r_priority int, r_signed_date date")
    got = rules.conflicts(pair).first()
    assert (got.winner_id, got.basis) == (20, "hierarchy")


def test_understanding(spark):
    q = spark.createDataFrame([("Tôi bị thu hồi đất và đang tranh chấp bồi thường.",), ("Văn bản này còn hiệu lực không?",), ("Tôi muốn nghỉ việc thì cần chuẩn bị hồ sơ gì?",)], "text string")
    got = [(r.domain, r.intent, r.complexity) for r in qa.understand(q).collect()]
    assert got[0] == ("dat-dai", "legal_qa", "high")
    assert got[1][1:] == ("validity_check", "low")
    assert got[2][0] == "lao-dong"


def test_relation_types(spark):
    rows = [("sua doi, bo sung Bo luat", "nghi-dinh", None, "amends"), ("bo sung mot so", "x", None, "supplements"), ("gi do", "van-ban-hop-nhat", None, "consolidates"), ("gi do", "x", None, "general_reference")]
    got = spark.createDataFrame(rows, "c string, t string, k string, want string").select(relations.classify(F.col("c"), F.col("t"), F.col("k")).alias("got"), "want")
    assert all(r.got == r.want for r in got.collect())


def test_provision_reference_with_damage(spark):
    got = spark.createDataFrame([("Can cu iem a khoan 1 ieu 8 va Điều 9",)], "x string").select(relations.provision_references(F.col("x")).alias("r")).first().r
    assert [tuple(r) for r in got] == [("8", "1", "a"), ("9", None, None)]


def test_related_fills_from_the_same_document_first(spark):
    chunks = spark.createDataFrame([(1, 1, "5"), (1, 2, "5"), (2, 1, None), (1, 9, None)], "document_id long, chunk_index int, article_number string")
    hits = spark.createDataFrame([(7, 1, 1, 1)], "query_id long, rank int, document_id long, chunk_index int")
    links = spark.createDataFrame([(1, 2, "amends")], "source_document_id long, target_document_id long, relation_type string")
    got = retrieval.related(hits, chunks, links).orderBy("place").collect()
    assert [(r.document_id, r.chunk_index, r.relation_type) for r in got] == [(1, 2, "same_document_context"), (2, 1, "amends")]


def test_search(spark):
    q = spark.createDataFrame([(1, "hop dong lao dong theo dieu 5", ["hop dong"], [1.0, 0.0])], "query_id long, text string, hints array<string>, vector array<double>")
    rows = [
        (1, 1, "Hợp đồng lao động là gì", "5", None, None, None, "Điều 5", [1.0, 0.0], 0),
        (2, 1, "lao động", "6", None, None, None, None, [0.0, 1.0], 0),
        (3, 1, "khong lien quan", None, None, None, None, None, None, 0),
    ]
    c = spark.createDataFrame(rows, "document_id long, chunk_index int, content string, article_number string, clause_number string, point_number string, section_title string, citation_label string, vector array<double>, boost int")
    got = retrieval.search(q, c).orderBy("rank").collect()
    # .46 + .36 + .22 + .12
    assert [(r.document_id, r.score) for r in got][0] == (1, 116)
    assert [r.document_id for r in got] == [1, 2]


def test_prefilter_and_scan(spark):
    asked = [(1, "labour", None, None), (2, "zzyzx", None, [1.0, 0.0]), (3, "of a", None, [1.0, 0.0]), (4, "unknown", ["LABOUR law"], None), (5, None, None, None)]
    q = spark.createDataFrame(asked, "query_id long, text string, hints array<string>, vector array<double>")
    rows = [(1, 1, "All labours of men", None, [0.0, 1.0]), (1, 2, None, "Labour law", None), (2, 1, "lab our", None, [1.0, 0.0]), (3, 1, "", None, None)]
    c = spark.createDataFrame([(*r[:3], None, None, None, r[3], None, r[4], 0) for r in rows], "document_id long, chunk_index int, content string, article_number string, clause_number string, point_number string, section_title string, citation_label string, vector array<double>, boost int")
    words = q.withColumn("words", tokens(F.col("text")))
    pairs = lambda df: sorted((r.query_id, r.document_id, r.chunk_index) for r in df.collect())
    found = [(1, 1, 1), (1, 1, 2), (4, 1, 2)]
    assert pairs(retrieval.prefilter(words, c)) == found
    assert pairs(retrieval.prefilter(words, c, cap=1)) == [(1, 1, 1), (4, 1, 2)]
    # a question that finds nothing meets every chunk, one without a word none
    assert pairs(retrieval.candidates(words, c)) == sorted(found + [(2, *r[:2]) for r in rows])
    assert pairs(retrieval.candidates(words, c.limit(0))) == [] == pairs(retrieval.candidates(words.limit(0), c))
    assert sorted(r.query_id for r in retrieval.too_short(words).collect()) == [3, 5]
    assert [(r.query_id, r.document_id, r.score) for r in retrieval.search(q, c).where("query_id = 2").collect()] == [(2, 2, 36)]


def test_concepts_and_graph(spark):
    q = spark.createDataFrame([(1, "quyền sử dụng đất"), (2, "nhà đầu tư có đất để sử dụng quyền")], "query_id long, text string")
    a = spark.createDataFrame([(1, "land", "Quyền sử dụng đất", 0)], "concept_id int, name string, alias string, alias_order int")
    assert {r.query_id: r.score for r in graph.match_concepts(q, a).collect()} == {1: 1.0, 2: 0.55}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    nodes, used = graph.neighbourhood(spark.createDataFrame([(1,)], "root_id long"), e, 2)
    assert {(r.node_id, r.depth) for r in nodes.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {(r.src, r.dst) for r in used.collect()} == {(1, 2), (2, 3)}


def test_metadata(spark):
    text = "QUỐC HỘI\nSố: 45/2019/QH14\nBỘ LUẬT\nLao động sửa đổi\nHà Nội, ngày 20 tháng 11 năm 2019\nBộ luật này có hiệu lực thi hành từ ngày 01/01/2021"
    d = spark.createDataFrame([(1, text, "x.docx")], "doc_id long, text string, file_name string")
    r = metadata.infer(d, F.lit(DAY)).first()
    assert (r.document_code, r.document_type, r.issuing_authority, r.authority_level) == ("45/2019/QH14", "bo-luat", "Quốc hội", "quoc-hoi")
    assert (r.signed_date, r.effective_date, r.legal_status) == (datetime.date(2019, 11, 20), datetime.date(2021, 1, 1), "active")
    t = spark.createDataFrame([("291 2025 ND CP 679921 [20260326_DD]", "291_2025_ND-CP_679921.docx"), ("Nghi dinh quy dinh chi tiet ve dat dai", "291_2025_ND-CP_679921.docx")], "t string, f string")
    assert [r.p for r in t.select(metadata.placeholder_title(F.col("t"), F.col("f")).alias("p")).collect()] == [True, False]


def test_claims_and_validation(spark):
    a = spark.createDataFrame([(1, "Theo điều 5 được nghỉ. Xin chào."), (2, "Xin chào.")], "answer_id long, text string")
    e = spark.createDataFrame([(1, "Điều 5 được nghỉ việc")], "answer_id long, evidence string")
    assert {r.answer_id: (r.n_claims, r.support) for r in qa.claim_support(a, e).collect()} == {1: (1, 1.0), 2: (0, 1.0)}
    v = spark.createDataFrame([(0, 0, False, "low"), (1, 1, False, "low")], "n_results int, n_authoritative int, unresolved_conflict boolean, complexity string")
    assert [(r.status, r.confidence) for r in qa.base_validation(v).collect()] == [("needs_review", 0.5), ("passed", 0.76)]


def test_duplicates(spark):
    d = spark.createDataFrame([(1, "a", "h1", None), (2, "b", "h1", None), (3, "a", "h2", "s"), (4, "c", "h3", None)], "id long, file_name string, content_sha256 string, source_identity string")
    assert {(r.id, r.duplicate_of, tuple(r.fields)) for r in identity.duplicate_of(d).collect()} == {(2, 1, ("content_sha256",)), (3, 1, ("file_name",))}


def test_annotation(spark):
    e = spark.createDataFrame(
        [(1, "e1", "ARTICLE", "Điều 1", 0, {"article_number": "1"}), (1, "e2", "CLAUSE", "1.", 10, {"article_number": "1", "clause_number": "1"}), (1, "e3", "POINT", "a)", 20, {"article_number": "1", "clause_number": "1", "point_code": "a"}), (1, "e4", "ARTICLE", "Điều 2", 30, {"article_number": "2"}), (1, "e5", "POINT", "b)", 40, {})],
        "doc_id long, entity_id string, label string, text string, start int, attributes map<string,string>",
    ).withColumn("normalized_value", F.lit(None).cast("string"))
    rows = annotation.import_provisions(e).orderBy("seq").collect()
    assert [r.parent_seq for r in rows] == [None, 1, 2, None, 4]
    assert rows[2].citation_label == "Điểm a Khoản 1 Điều 1" and rows[2].sort_key == "1|1|a|000003"
    r = spark.createDataFrame([(1, "r1", "X", "e1", "e9")], "doc_id long, relation_id string, relation_type string, source_id string, target_id string")
    assert [x.relation_id for x in annotation.dangling(e, r).collect()] == ["r1"]
    spans = spark.createDataFrame([(1, 2, 4, "A"), (1, 3, 6, "B")], "doc_id long, begin int, end int, label string")
    texts = spark.createDataFrame([(1, "0123456789")], "doc_id long, text string")
    assert [(s.begin, s.end, s.label) for s in annotation.segments(spans, texts).orderBy("begin").collect()] == [(0, 2, None), (2, 4, "A"), (4, 10, None)]


def test_editing(spark):
    x = spark.createDataFrame([("câu một\ntiếp theo\n\nĐiều 1. A\nhết",)], "x string")
    assert x.select(editing.join_broken_lines(F.col("x")).alias("y")).first().y == "câu một tiếp theo\n\nĐiều 1. A\nhết"
    assert x.select(editing.drop_blank_lines(F.col("x")).alias("y")).first().y.count("\n") == 3
    assert x.select(editing.replace_all(F.col("x"), "ĐIỀU 1.", "$1").alias("y")).first().y.split("\n")[3] == "$1 A"
    assert x.select(editing.scanned_lines(F.lit("DIEU 1 Pham vi KHOAN 1 Noi dung")).alias("y")).first().y == "DIEU 1 Pham vi\nKHOAN 1 Noi dung"


def test_domains_by_category(spark):
    d = spark.createDataFrame([(1, "Về hợp đồng lao động và tiền lương"), (2, "khác")], "doc_id long, text string")
    c = spark.createDataFrame([("dat-dai", "Đất đai", None, 0), ("lao-dong", "Lao động", "việc làm", 1)], "slug string, name string, description string, position int")
    assert {r.doc_id: (r.legal_domain, r.score) for r in metadata.domain_scores(d, c).collect()} == {1: ("lao-dong", 13), 2: ("dat-dai", 0)}
    many = spark.range(metadata.MOST_CATEGORIES + 1).selectExpr("cast(id as string) as slug", "'x' as name", "'y' as description", "id as position")
    with pytest.raises(ValueError):
        metadata.domain_scores(d, many)


def test_costly_rows_are_dealt_to_all_cores(spark, tmp_path):
    from corpusloom.functions.shared import spread

    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spread(spark.read.parquet(str(tmp_path / "one")), "id")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 3 * spark.sparkContext.defaultParallelism


def test_files_of_one_row_group_are_made_in_many_tasks(spark):
    from corpusloom.plans.rollup_queries import docx_round_trip

    out = docx_round_trip(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_prefilter_keeps_texts_out_of_its_joins(spark):
    words = spark.createDataFrame([(1, ["some", "term"], None), (2, ["m t"], None)], "query_id int, words array<string>, hints array<string>")
    c = spark.createDataFrame([(i, 0, f"x{i} SOME term") for i in range(8)], "document_id int, chunk_index int, content string")
    found = retrieval.prefilter(words, c, cap=5)
    assert sorted((r.query_id, r.document_id) for r in found.collect()) == [(1, i) for i in range(5)]
    assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()
