"""Queries that read whole texts and drop no candidates."""

from corpusloom import catalog
from corpusloom.operators import retrieval


def tables(spark, folder, texts, **others):
    rows = [(i, t, "en", "web") for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    for name, (data, schema) in others.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_names_behind_the_fortieth_line_count(spark, tmp_path):
    tables(spark, tmp_path, ["alpha bravo\nx", "charlie\n" + "x\n" * 60 + "as alpha bravo says"])
    got = catalog.queries()["relation_classify"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.target_id, r.by_code) for r in got] == [(2, 1, False)]


def test_suggestions_cover_whole_texts(spark, tmp_path):
    tables(spark, tmp_path, ["xyz " * 200 + "cong hoa " * 100])
    row = catalog.queries()["scan_suggestions"](spark, str(tmp_path)).first()
    told = [x.split(":") for x in row.suggestions.split("|")]
    assert row.changed_tokens == len(told) > 150 and max(int(t[1]) for t in told) > 350


MANY = 5_001


def test_the_best_chunk_counts_behind_the_first_five_thousand(spark):
    q = spark.createDataFrame([(1, "labour", ["fair labour", "labour"], None)], "query_id long, text string, hints array<string>, vector array<double>")
    rows = [(i, 0, "labour x" if i < MANY else "fair labour labour " * 3, None, None, None, None, None, None, 0) for i in range(1, MANY + 1)]
    c = spark.createDataFrame(rows, "document_id long, chunk_index int, content string, article_number string, clause_number string, point_number string, section_title string, citation_label string, vector array<double>, boost int")
    got = retrieval.search(q, c, limit=1).collect()
    # 6 times the word, 3 times the first hint, 6 times the second
    assert [(r.document_id, r.lexical, r.score) for r in got] == [(MANY, 6 * 3 + 3 * 10 + 6 * 10, 46)]


def test_an_answer_rests_on_the_best_of_all_documents(spark, tmp_path):
    tables(spark, tmp_path, ["labour x"] * (MANY - 1) + ["labour " * 40], benchmark=([(5, "labour")], "item_id long, text string"))
    row = catalog.queries()["question_flow"](spark, str(tmp_path)).first()
    assert str(MANY) in [hit.split(":")[0] for hit in row.evidence.split("|")]
