from corpusloom.operators import retrieval

TEXTS = [
    (1, "aaa aaa aaa aaa, aaa bbb"), (2, "aaa bbb aaa bbb aaa bbb aaa"), (3, "aaa  bbb aaa,bbb aaa\x01bbb aaa"), (None, "bbb ccc"), (None, "aaa bbb ccc"),
    ((1 << 60) + 1, "éa aaa ²bb aaa b̈bb ab aaa ab ccc"), (5, None), (6, ""), (7, "aaa"), (7, "aaa bbb"), (8, "ccc ccc ccc bbb ccc ccc ccc ccc"),
]


def test_few_phrases_are_counted_where_texts_are_read(spark, monkeypatch):
    q = spark.createDataFrame([(1, ["aaa", "bbb", "aaa"]), (2, ["aaa", "aaa", "bbb", "ccc"]), (3, ["ccc", "ccc", "ccc"]), (4, ["aaa", "ab", "ccc"])], "query_id int, words array<string>")
    texts = spark.createDataFrame(TEXTS, "document_id long, folded string")
    few = retrieval.phrase_scores(q, texts)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "regexp_extract_all" not in plan
    monkeypatch.setattr(retrieval, "FEW_PHRASES", 0, raising=False)
    many = retrieval.phrase_scores(q, texts)
    assert "regexp_extract_all" in many._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(few) == rows(many) and len(rows(few)) > 12
