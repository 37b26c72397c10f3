"""Reports that count one table several ways in a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _facts(*facts: tuple[str, Column, Column]) -> Column:
    """array<struct<kind, key, n>> of (kind, keys, number of each): a key may be one value or an array of them."""
    none = F.array().cast("array<struct<kind:string,key:string,n:long>>")

    def told(kind: str, keys: Column, n: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("key"), n.cast("long").alias("n")))

    return F.concat(*(F.coalesce(told(*fact), none) for fact in facts))


def counted(rows: DataFrame, *facts: tuple[str, Column, Column], known: DataFrame | None = None) -> DataFrame:
    """(kind, key, n): sums of all facts of all rows.

    Each row becomes its facts inside a task and they are summed there before the one exchange, so a report of
    many counts reads the table once.  ``known`` (kind, key) adds pairs that have no facts, with 0.
    """
    told = rows.select(F.explode(_facts(*facts)).alias("f")).select("f.*")
    if known is not None:
        told = told.unionByName(known.select("kind", F.col("key").cast("string").alias("key"), F.lit(0).cast("long").alias("n")))
    return told.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def selection_summary(selected: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(kind, key, n): documents in all, by domain and by reason of their selection, and how often each issue occurs.

    selected has legal_domain (null is the domain None), selection_reason and issue_codes (an array).
    """
    one, row = F.lit(1), lambda c: F.array(c)
    return counted(
        selected, ("selected_count", row(F.lit("all")), one), ("by_domain", row(F.coalesce("legal_domain", F.lit("None"))), one),
        ("by_selection_reason", row(F.col("selection_reason")), one), ("issue_counts", F.col("issue_codes"), one), known=known,
    )


ROUND_TRIP_TOTALS = ("entities", "relations", "metadata_fields", "provisions", "provision_relations", "semantic_entities")


def round_trip_report(tasks: DataFrame) -> DataFrame:
    """(kind, key, n) over tasks that went to the annotation tool and came back.

    tasks has document_id, review_status, a number of each of ROUND_TRIP_TOTALS, and the arrays labels, relation_types and
    warnings of what a task holds.  document_count counts distinct documents, null being one.
    """
    one, row = F.lit(1), lambda c: F.array(c)
    facts = [
        ("task_count", row(F.lit("all")), one), ("review_status_counts", row(F.col("review_status")), one), ("label_counts", F.col("labels"), one),
        ("relation_counts", F.col("relation_types"), one), ("warning_counts", F.col("warnings"), one), ("document", row(F.coalesce(F.col("document_id").cast("string"), F.lit("None"))), one),
    ]
    facts += [("totals", row(F.lit(name)), F.coalesce(name, F.lit(0))) for name in ROUND_TRIP_TOTALS]
    out = counted(tasks, *facts)
    # the documents are groups already: what is left is their number
    is_document = F.col("kind") == "document"
    kind, key = F.when(is_document, "document_count").otherwise(F.col("kind")), F.when(is_document, "all").otherwise(F.col("key"))
    return out.groupBy(kind.alias("kind"), key.alias("key")).agg(F.sum(F.when(is_document, 1).otherwise(F.col("n"))).alias("n"))


def totals_and_means(rows: DataFrame, dimensions: list[str], measures: list[str], known: DataFrame | None = None) -> DataFrame:
    """(dimension, value, rows, sum and mean of each measure): one row per value of each dimension, and one for all rows.

    Grouping sets expand a row once per dimension after partial sums; grouping_id tells the sets apart, so a null value is a
    value like others.  ``known`` (dimension, value) adds values without rows, with sums of 0 and means of null.
    """
    sets = [[F.col(d)] for d in dimensions] + [[]]
    sums = [F.sum(m).alias(f"{m}_sum") for m in measures]
    cube = rows.groupingSets(sets, *map(F.col, dimensions)).agg(F.grouping_id().alias("g"), F.count("*").alias("rows"), *sums, *(F.count(m).alias(f"{m}_n") for m in measures))
    # a dimension's bit is 0 in its own set
    whole = (1 << len(dimensions)) - 1
    own = {d: whole ^ (1 << (len(dimensions) - 1 - i)) for i, d in enumerate(dimensions)}
    name, value = F.lit("all"), F.lit(None).cast("string")
    for d, g in own.items():
        name, value = F.when(F.col("g") == g, d).otherwise(name), F.when(F.col("g") == g, F.col(d).cast("string")).otherwise(value)
    mean = lambda m: F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum") / F.col(f"{m}_n")).alias(f"{m}_mean")
    out = cube.select(name.alias("dimension"), value.alias("value"), "rows", *(c for m in measures for c in (F.coalesce(f"{m}_sum", F.lit(0)).alias(f"{m}_sum"), mean(m))))
    if known is not None:
        found = out.select("dimension", "value").where("value is not null")
        empty = known.join(found, ["dimension", "value"], "left_anti")
        kinds = dict(out.dtypes)
        out = out.unionByName(empty.select("dimension", "value", *(F.lit(None if c.endswith("_mean") else 0).cast(kinds[c]).alias(c) for c in out.columns[2:])))
    return out
