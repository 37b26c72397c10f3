from corpusloom.operators import scans


def test_a_preview_repairs_texts_once(spark):
    docs = spark.createDataFrame([(1, "CHUONG I QUY DINH CHUNG D1EU 1 PHAM V1"), (2, None), (3, "")], "doc_id long, text string")
    out = scans.preview_corrections(docs)
    # the repair joins lines by a Python function; the preview reads its result
    assert "_joints" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"] for r in out.collect()} == {1, 2, 3}
