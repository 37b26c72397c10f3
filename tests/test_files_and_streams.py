import datetime

from pyspark.sql import functions as F

from corpusloom.plans.standins import usage
from corpusloom.operators import reports
from corpusloom.sources import files
from corpusloom.streaming import logs

SF = "/root/testdata/sf0.001"


def test_read_and_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("một\n\n hai ")
    got = files.read_texts(spark, str(tmp_path / "in")).first()
    assert got.segments == ["một", "hai"]
    b = files.read_binary(spark, str(tmp_path / "in"), "*.txt")
    assert b.count() == 1 and files.first_per_folder(b, 1).count() == 1
    good, bad = files.supported(b)
    assert (good.count(), bad.count()) == (1, 0)
    rows = spark.range(7)
    files.write_in_parts(rows, "id", 3, str(tmp_path / "parts"))
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "parts")).groupBy("part").count().collect()) == [1, 3, 3]
    counts = files.write_graph(rows, rows.where("id < 2"), str(tmp_path / "graph"))
    assert {r.name: r.n for r in counts.collect()} == {"nodes": 7, "edges": 2}


def test_reports(spark, tmp_path):
    for i, ok in enumerate((True, False)):
        (tmp_path / f"r{i}.json").write_text('{"results": [{"id": "c%d", "status": "%s", "checks": [{"name": "x", "passed": %s}]}]}' % (i, "passed" if ok else "failed", str(ok).lower()))
    r = files.read_reports(spark, str(tmp_path), "results array<struct<id: string, status: string, checks: array<struct<name: string, passed: boolean>>>>", 5)
    assert [(f.case_id, f.failed) for f in files.failures(r).collect()] == [("c1", "x")]


def test_stream_agrees_with_batch(spark, tmp_path):
    u = usage(spark, SF).withColumn("cost", F.col("cost").cast("decimal(18,6)"))
    u.write.parquet(str(tmp_path / "log"))
    stream = logs.daily_usage(spark.readStream.schema(u.schema).parquet(str(tmp_path / "log")))
    logs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.day: (r.requests, r.tokens, r.cost) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.day: (r.requests, r.tokens, r.cost) for r in reports.usage_by_day(u, 1000).collect()}
    closed = {d: v for d, v in want.items() if d < max(want) - datetime.timedelta(days=2)}
    assert closed and {d: got[d] for d in closed} == closed
