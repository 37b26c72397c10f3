"""Orders of whole tables: natural orders of a language, and the place of each row without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.shared import Tables

DIGITS = 24


def natural_key(x: Column, language: str = "vi") -> Column:
    """Sort key of a text as its language orders it: base letters only, and numbers by their value.

    Runs of digits are filled with zeros to DIGITS places, so numbers compare as numbers up to that length.
    """
    runs = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    filled = F.transform(runs, lambda p: F.when(p.rlike("^[0-9]") & (F.length(p) < DIGITS), F.lpad(p, DIGITS, "0")).otherwise(p))
    return F.collate(F.array_join(filled, ""), f"{language}_CI_AI")


def positions(rows: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in the order of the keys, which must tell all rows apart.

    Rows are dealt by ranges of the keys and sorted inside them.  What a row needs besides is the number of
    rows in the ranges before its own: one count per range, added up outside the rows.
    """
    tables = Tables(rows.sparkSession, "order")
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = tables.save(dealt, "dealt").withColumn("_range", F.shiftright("_at", 33))
    sizes = dict(dealt.groupBy("_range").count().collect())
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    starts = rows.sparkSession.createDataFrame(offsets, "_range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def page(rows: DataFrame, number: int, size: int, *keys: Column) -> DataFrame:
    """Rows of one page (from 1) of an order with their places; a number beyond the last page gives the last."""
    placed = positions(rows, *keys)
    n = placed.count()
    last = max(1, -(-n // size))
    number = max(1, min(number, last))
    return placed.where(F.col("place").between((number - 1) * size + 1, number * size))
