import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import packages
from corpusloom.sources.packages import Format


def some_tables(spark):
    texts = spark.createDataFrame([(1, 'a "quoted", text\nof two lines', None), (2, "", "é"), (3, None, "x")], "id long, text string, note string")
    numbers = spark.range(1000).select("id", (F.col("id") / 3).alias("third"), F.array("id").alias("list"))
    return {"texts": (texts, Format("csv", marked=True)), "numbers": (numbers, Format()), "lines": (texts, Format("json"))}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "out" / "p")
    written = packages.write_package(some_tables(spark), path, {"schema_version": "v1"})
    assert {n: t["rows"] for n, t in written["tables"].items()} == {"texts": 3, "numbers": 1000, "lines": 3}
    manifest, tables = packages.read_package(spark, path)
    assert manifest == json.loads(json.dumps(written)) and manifest["schema_version"] == "v1"
    assert sorted(map(tuple, tables["texts"].collect())) == [("1", 'a "quoted", text\nof two lines', ""), ("2", "", "é"), ("3", "", "x")]
    assert {tuple(r) for r in tables["lines"].collect()} == {(1, 'a "quoted", text\nof two lines', None), (2, "", "é"), (3, None, "x")}
    files = [f for f in os.listdir(f"{path}/texts") if f.endswith(".csv")]
    assert all(open(f"{path}/texts/{f}", "rb").read().startswith(b"\xef\xbb\xbfid") for f in files)
    with pytest.raises(FileExistsError):
        packages.write_package(some_tables(spark), path)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        packages.write_package({**some_tables(spark), "broken": (broken, Format())}, path)
    assert os.listdir(tmp_path) == []
    with pytest.raises(packages.BrokenPackage):
        packages.read_package(spark, path)


def test_files_that_changed(spark, tmp_path):
    path = str(tmp_path / "p")
    packages.write_package(some_tables(spark), path)
    spark.range(5).select("id", (F.col("id") / 3).alias("third"), F.array("id").alias("list")).write.mode("append").parquet(f"{path}/numbers")
    with pytest.raises(packages.BrokenPackage, match="numbers"):
        packages.read_package(spark, path)
    os.remove(f"{path}/{packages.MANIFEST}")
    with pytest.raises(packages.BrokenPackage, match="manifest"):
        packages.read_package(spark, path)


def test_trackers_and_ground_truth(spark):
    d = spark.createDataFrame([(1, "a.txt", ["X", "Y"]), (2, "b.txt", [])], "document_id long, file_name string, issue_codes array<string>")
    rows = packages.selected_documents(d).orderBy("document_id").collect()
    assert rows[0].asDict() == {**dict.fromkeys(packages.SELECTED_COLUMNS), "document_id": "1", "file_name": "a.txt", "issue_codes": "X;Y"} and rows[1].issue_codes == ""
    assert packages.blank_tracker(d).first().asDict() == {"document_id": 1, "file_name": "a.txt", **dict(packages.TRACKER_DEFAULTS)}
    r = spark.createDataFrame([(1, 5, '{"a": [1, {"b": null}]}', ["p", "q"], None)], "document_id long, reviewer_user_id long, payload string, provisions array<string>, warnings array<string>")
    bundle = json.loads(packages.ground_truth(r, ("provisions", "warnings"), F.lit("2026-01-15 10:00:00").cast("timestamp")).first().bundle)
    assert bundle == {"schema_version": packages.GROUND_TRUTH, "saved_at": "2026-01-15T10:00:00", "reviewer_user_id": 5, "document_id": 1, "payload": {"a": [1, {"b": None}]}, "import_bundle": {"provisions": ["p", "q"]}, "bundle_counts": {"provisions": 2, "warnings": 0}}


def test_dialects(spark):
    p = spark.createDataFrame([(1, 10, None), (1, 11, 10)], "document_id long, provision_id long, parent_id long")
    d = spark.createDataFrame([(1, "T")], "document_id long, title string")
    r = spark.createDataFrame([(1, 2, "amends", 0.9)], "source_document_id long, target_document_id long, relation_type string, confidence_score double")
    q = spark.createDataFrame([(10, 11, "CITES")], "source_provision_id long, target_provision_id long, relation_type string")
    six = packages.graph_tables(p, d, r, q)
    typed, plain = packages.in_dialect(six, True), packages.in_dialect(six, False)
    assert typed["documents"].columns == ["document_id:ID(Document)", "title", ":LABEL"] and plain["documents"].columns == ["document_id", "title", "node_label"]
    assert typed["document_relations"].columns == [":START_ID(Document)", ":END_ID(Document)", "relation_type", "confidence_score:float", ":TYPE"]
    assert plain["provision_relations"].columns == ["start_provision_id", "end_provision_id", "relation_type", "type"]
    assert [tuple(x) for x in typed["has_child"].collect()] == [(10, 11, "HAS_CHILD")] and [tuple(x) for x in plain["has_provision"].collect()] == [(1, 10, "HAS_PROVISION")]
