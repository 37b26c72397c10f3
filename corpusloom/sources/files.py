"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import segments
from corpusloom.operators.ordering import positions


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, segments) of whole text files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("segments", segments(F.col("text")))


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, content_sha256) of files of any kind below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("content_sha256"))


def preview(x: Column, chars: int = 12_000) -> Column:
    return F.coalesce(F.substring(x, 1, chars), F.lit(""))


def first_per_folder(files: DataFrame, most: int) -> DataFrame:
    """At most ``most`` files of each folder, in order of the path without case."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    place = F.row_number().over(Window.partitionBy(folder).orderBy(F.lower("path"), "path"))
    return files.withColumn("place", place).where(F.col("place") <= most).drop("place")


def supported(files: DataFrame, kinds: tuple[str, ...] = ("txt", "pdf", "docx")) -> tuple[DataFrame, DataFrame]:
    """Files of known kinds, and the others with an error."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    tagged = files.withColumn("source_type", kind)
    return tagged.where(F.col("source_type").isin(*kinds)), tagged.where(~F.col("source_type").isin(*kinds)).withColumn("error", F.concat(F.lit("unsupported source type: "), "source_type"))


def text_or_scan(text: Column, kind: Column, scanned: Column) -> Column:
    """The text layer; only for a PDF without one, the scanned text."""
    return F.when((F.trim(F.coalesce(text, F.lit(""))) == "") & (kind == "pdf"), scanned).otherwise(text)


def page_confidence(tokens: DataFrame) -> DataFrame:
    """Mean confidence of the tokens of each page that have one, to three places."""
    return tokens.groupBy("doc_id", "page").agg(F.bround(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 3).alias("confidence"))


def read_reports(spark: SparkSession, path: str, schema: str, newest: int) -> DataFrame:
    """Newest JSON reports of a folder by file name; broken files are left out."""
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED").withColumn("file", F.col("_metadata.file_name"))
    return rows.orderBy(F.desc("file")).limit(newest)


def failures(reports: DataFrame) -> DataFrame:
    """(file, case_id, failed): failed results with the names of their failed checks."""
    rows = reports.select("file", F.explode("results").alias("r")).where("r.status = 'failed'")
    return rows.select("file", F.col("r.id").alias("case_id"), F.array_join(F.transform(F.filter("r.checks", lambda c: ~c["passed"]), lambda c: c["name"]), ",").alias("failed"))


def append_report(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """CSV with a header, columns renamed for the tool that imports it."""
    named = df.select(*(F.col(c).alias((names or {}).get(c, c)) for c in df.columns))
    named.write.mode("overwrite").csv(path, header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Node and edge tables in full, and the number of rows of each."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = nodes.sparkSession
    rows = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("nodes", "edges")]
    return rows[0].unionByName(rows[1])


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Only the partitions of the keys that ``df`` has are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_in_parts(tasks: DataFrame, order: str, size: int, path: str) -> None:
    """Tasks in folders of ``size`` rows, by their order (``order`` and then all other columns), one file each."""
    placed = positions(tasks, *(F.col(c) for c in (order, *(c for c in tasks.columns if c != order))))
    parts = placed.withColumn("part", F.floor((F.col("place") - 1) / size)).drop("place")
    parts.repartition("part").write.mode("overwrite").partitionBy("part").json(path)
