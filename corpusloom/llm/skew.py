"""Joins of rows with totals of their keys, whatever the keys' shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, free_name

#: tables of totals up to this many rows are broadcast
FEW_KEYS = 20_000
#: keys of at least this part of all rows are hot; there are no more hot keys than this number
HOT_PART = 1000


def attach_totals(scratch: Scratch, rows: DataFrame, totals: DataFrame, key: str, value: str) -> DataFrame:
    """Every row with the ``value`` of its key; null keys are equal, keys without totals have null.

    ``totals`` has ``key``, ``value`` and ``n``, the number of rows of the key.  A few totals are broadcast.
    Of many, those of hot keys are broadcast, which are at most HOT_PART, and the rest meet by a shuffle
    in which no key has more than a thousandth of the rows.
    """
    own = free_name(rows, "_key")
    found = scratch.save(totals.select(F.col(key).alias(own), F.col(value), F.col("n").alias("_rows")), f"totals-{value}")
    n_keys, n_rows = found.agg(F.count("*"), F.sum("_rows")).first()
    same: Column = F.col(key).eqNullSafe(F.col(own))
    if n_keys <= FEW_KEYS:
        return rows.join(F.broadcast(found.drop("_rows")), same, "left").drop(own)
    is_hot = F.col("_rows") * HOT_PART >= n_rows
    hot, cold = found.where(is_hot).drop("_rows"), found.where(~is_hot).drop("_rows")
    mark = free_name(rows, "_hot")
    tried = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), same, "left").drop(own)
    met = tried.where(F.col(mark)).drop(mark)
    rest = tried.where(F.col(mark).isNull()).drop(mark, value)
    return met.unionByName(rest.join(cold, same, "left").drop(own))
