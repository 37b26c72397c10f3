"""Queries on small tables that their SQL tells apart from near misses."""

import os
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from corpusloom import catalog


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def wanted(folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}/*.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return columns, Counter(found.fetchall())


def same_as_sql(spark, folder, name):
    columns, want = wanted(folder, name)
    got = Counter(tuple(r) for r in catalog.queries()[name](spark, str(folder)).select(*columns).collect())
    assert got == want
    return got


PARTS, SUPPLIERS = "p_partkey long, p_size int, p_brand string", "s_suppkey long"


def test_null_safe_lookup_with_missing_brands(spark, tmp_path):
    r = random.Random(2)
    parts = [(i, r.choice([None, 1, 2, 4, 6, 7, 48]), r.choice([None, "Brand#1", "Brand#2"])) for i in range(60)] + [(99, 10, None)]
    write(spark, tmp_path, part=(parts, PARTS), supplier=([(i,) for i in [*range(70), 5, None]], SUPPLIERS))
    assert len(same_as_sql(spark, tmp_path, "null_safe_lookup")) > 20


def test_null_safe_lookup_does_not_pair_all_rows_without_clause(spark, tmp_path):
    n = 40_000
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).select((F.col("id") * 3).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    out = catalog.queries()["null_safe_lookup"](spark, str(tmp_path))
    assert out.count() == n and out.where("p_partkey = 0").count() == n
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


TALK = "conv_id long, turn long, role string, text string"


def test_answers_that_are_cut_off_are_broken_whatever_their_title(spark, tmp_path):
    said = [None, "", "x" * 14, "Enan thly to thti.", "y" * 18, "z" * 21, 'a "quoted" word', "w" * 60]
    rows = [(i, turn, "user", said[(i + turn) // 7 % len(said)]) for i in range(120) for turn in (0, 1)]
    write(spark, tmp_path, conversations=(rows, TALK))
    for name in ("guarded_metadata", "quarantined_answers", "sanitised_provisions"):
        assert same_as_sql(spark, tmp_path, name)


def test_structure_counts_of_short_statutes(spark, tmp_path):
    rows = [(i, "abc " * (i // 9)) for i in range(600)]
    write(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = same_as_sql(spark, tmp_path, "structure_counts")
    assert {r[4] for r in got} >= {75.0, 85.0}


def test_facts_of_one_place_are_told_in_order_of_key_and_value(spark, tmp_path):
    lines = [(1, 1, 1, key, value) for key in "RNA" for value in "OF"]
    for turn in (lines, lines[::-1]):
        write(spark, tmp_path, lineitem=(turn, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"), part=([(1,)], "p_partkey long"))
        got = catalog.queries()["case_facts_dedupe"](spark, str(tmp_path)).orderBy("place").collect()
        assert [(r.fact_key, r.fact_value) for r in got] == [("A", "F"), ("A", "O"), ("N", "F")]
