"""Identity of documents, duplicates, and changes of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import codes_that_hold


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def source_identity(reference: Column, path: Column, content: Column) -> Column:
    """``sha256:`` of the content, else ``source:``, else ``path:``."""
    tagged = lambda tag, x: F.concat(F.lit(tag), F.nullif(F.trim(x), F.lit("")))
    return F.coalesce(tagged("sha256:", content), tagged("source:", reference), tagged("path:", path))


def duplicate_of(docs: DataFrame, keys: tuple[str, ...] = ("file_name", "content_sha256", "source_identity")) -> DataFrame:
    """(id, duplicate_of, fields): the earliest other document that agrees in any key.

    Each key is one window minimum over its own exchange, so a group of equal keys of any size
    costs one row per member, not one per pair.
    """
    firsts = None
    for key in keys:
        known = docs.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("id").alias("first"))
        hit = docs.join(known, key).where("id > first").select("id", "first", F.lit(key).alias("field"))
        firsts = hit if firsts is None else firsts.unionByName(hit)
    best = firsts.groupBy("id").agg(F.min("first").alias("duplicate_of"))
    fields = firsts.join(best, "id").where("first = duplicate_of").groupBy("id", "duplicate_of").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return fields


def matching_fields(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Names of the keys in which l_* and r_* agree."""
    return pairs.withColumn("fields", codes_that_hold(*((F.col(f"l_{k}") == F.col(f"r_{k}"), k) for k in keys)))


def unique_names(df: DataFrame, name: str, order: str, joint: str = "-") -> DataFrame:
    """Adds unique_name: the second and later rows of one name get a number."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(joint), n)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` that have their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Each table without the rows of the documents (document_id) that go."""
    return {name: t.join(gone.select(F.col("document_id").alias(key)), key, "left_anti") for name, t in tables.items()}


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def last_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")
