import corpus_pipeline
from corpusloom.llm.store import Scratch

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test-pipeline")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    toxic, language, unique = sizes[1:4]
    assert sizes[0] * 0.8 < toxic <= sizes[0] and toxic * 0.95 < language <= toxic and language * 0.7 < unique < language
    assert docs.select("doc_id").distinct().count() <= unique
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("start = 0").count() == sizes[4]


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "the cat sat on the mat today", "en", "s", 1)] * 2 + [(None, None, None, None, None), (2, "", None, "s", 0), (3, "der Hund und die Katze sind im Haus", "de", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        stage(spark, docs.limit(0), SF).count()
    assert corpus_pipeline.near_duplicates(spark, docs, SF).where("doc_id = 1").count() == 1


def test_different_texts_of_one_id_stay(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (5, text["d"] + " z"), (None, text["c"] + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, text["a"]), (None, text["b"]), (7, text["c"]), (5, text["d"] + " z")], key=repr)
    got = corpus_pipeline.near_duplicates(spark, docs.where("doc_id = 5 or text like 'd%' or text like 'a%'"), SF).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, text["a"]), (5, text["d"] + " z")], key=repr)


def test_mixing_counts_each_row_of_an_id(spark):
    sizes = [5, 9, 14, 23, 31, 47]
    rows = [(i % 2 or None, " ".join(f"{i}w{j}" for j in range(n)), "ab"[i % 2]) for i, n in enumerate(sizes * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    words = {r["source"]: r["n"] for r in mixed.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    total = {s: sum(n for i, n in enumerate(sizes * 20) if "ab"[i % 2] == s) for s in "ab"}
    goal_b = max(2 * sum(total.values()) / 7, sum(total.values()) - 3 * total["a"])
    assert abs(words["b"] - goal_b) <= max(sizes) and abs(words["a"] - (sum(total.values()) - goal_b)) <= max(sizes)
    assert mixed.groupBy("text").count().where("count > 3").count() == 0


def test_names_that_clash_stay(spark):
    names = ["_toxicity", "_lang", "_score", "_row", "_id", "_copies", "_copy", "component_id", "n", "size", "target"]
    rows = [(i, f"the cat sat on the mat with {i} other cats and then it slept well {i * 7}", "s", *range(len(names))) for i in (1, 2, 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in names))
    docs = docs.withColumns({"lang": docs.source, "n_chars": docs.n})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.select(*names).distinct().collect() == [tuple(range(len(names)))], name
