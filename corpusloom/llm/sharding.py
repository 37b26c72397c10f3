"""Shards of near equal bytes by sampled splitters, in DataFrame operations only.

Rows are ordered by the hash of their text, then of their id.  A sample draws
rows in proportion to their size (a row of w expected draws counts w or w + 1
times, by a hash, so reruns agree); quantiles of the sampled keys split the
order into ranges of near equal size.  Each splitter is a range of its own, so
a text with very many copies is alone in one.  Exact sizes of the ranges are
then counted, overfull ranges are subdivided by the hash of the id, and prefix
sums over the pieces, whose number is bounded, give each row its place in the
whole order.  A shard is the part of the order that holds its share of bytes.

Equal texts are neighbours, so a group of copies stays in one shard as long as it
has at most ``whole_share`` of a shard's bytes; larger groups are cut where a
shard ends.  A shard's size thus differs from its share by that part or one row
at each end.

Defined results: null texts are empty; null and repeated ids are rows like
others, wholly equal rows have neighbouring slots; ties go by id; extra columns
do not matter; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch

#: bytes of a row besides its text
ROW_BYTES = 8
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 200_000
#: ranges, and so splitters, at most: what is broadcast is bounded by it
MAX_RANGES = 1 << 16
SAMPLES_PER_RANGE = 8
#: a range is overfull with so many times its share of bytes or rows
OVERFULL = 3
_STEPS = 1 << 30


def draws(size: Column, per_byte: float) -> Column:
    """How often the sample draws a row: the expected number, rounded down or up by a hash."""
    chance = F.pmod(F.xxhash64("k1", "k2", F.lit("draw")), F.lit(_STEPS)) / _STEPS
    return F.floor(size * per_byte + chance).cast("long")


def splitters(scratch: Scratch, rows: DataFrame, total: int, ranges: int) -> tuple[DataFrame, int]:
    """(bucket, keys, before) and the bits of a bucket: sorted splitters that begin with these bits, and the number below them.

    Every bucket has a row.  The table has at most four rows per range.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    sample = rows.select("k1", draws(F.col("size"), wanted / total).alias("w")).where("w > 0").groupBy("k1").agg(F.sum("w").alias("w"))
    sample = scratch.save(sample, "sample")
    drawn = sample.agg(F.sum("w")).first()[0] or 1
    upto = F.sum("w").over(Window.orderBy("k1").rowsBetween(Window.unboundedPreceding, 0))
    quantile = lambda c: F.floor(c * ranges / drawn)
    chosen = sample.withColumn("upto", upto).where(quantile(F.col("upto")) > quantile(F.col("upto") - F.col("w")))
    bits = max(2, ranges.bit_length() + 1)
    keys = chosen.groupBy(F.shiftright("k1", 64 - bits).alias("bucket")).agg(F.sort_array(F.collect_list("k1")).alias("keys"))
    buckets = rows.sparkSession.range(-(1 << bits - 1), 1 << bits - 1, 1, 1).select(F.col("id").alias("bucket"))
    filled = buckets.join(F.broadcast(keys), "bucket", "left").withColumn("keys", F.coalesce("keys", F.expr("cast(array() as array<bigint>)")))
    before = F.sum(F.size("keys")).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return scratch.save(filled.withColumn("before", F.coalesce(before, F.lit(0))), "splitters"), bits


def in_ranges(rows: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``range``: even between two splitters, odd on one."""
    met = rows.withColumn("bucket", F.shiftright("k1", 64 - bits)).join(F.broadcast(table), "bucket")
    below = F.col("before") + F.size(F.filter("keys", lambda s: s < F.col("k1")))
    on = F.array_contains("keys", F.col("k1")).cast("long")
    return met.withColumn("range", 2 * below + on).drop("bucket", "keys", "before")


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", whole_share: float = 0.02, whole_rows: bool = False, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; with ``whole_rows`` also ``row``, a struct of all its columns."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = ["row"] if whole_rows else []
    own = [F.struct(*docs.columns).alias("row")] if whole_rows else []
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col)).alias("k2"), *own)
    rows = scratch.save(rows, "rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, n // rows_per_range))

    ranged = in_ranges(rows, *splitters(scratch, rows, total, ranges))
    share = F.greatest(F.sum("size") / (total / ranges), F.count("*") / (max(n, 1) / ranges))
    pieces_of = F.when(share > OVERFULL, F.ceil(share)).otherwise(1)
    split = scratch.save(ranged.groupBy("range").agg(pieces_of.cast("long").alias("pieces")), "ranges")
    cut = ranged.join(F.broadcast(split), "range").withColumn("piece", F.pmod("k2", "pieces")).drop("pieces")

    order = ["range", "piece"]
    earlier = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    pieces = cut.groupBy(*order).agg(F.sum("size").alias("bytes"))
    starts = scratch.save(pieces.select(*order, F.coalesce(earlier, F.lit(0)).alias("start")), "pieces")

    inside = Window.partitionBy(*order).orderBy("k1", "k2", "doc_id")
    group = Window.partitionBy(*order, "k1")
    placed = cut.withColumn("place", F.row_number().over(inside))
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumns({"group_at": F.min("at").over(group), "group_size": F.sum("size").over(group)})
    whole = F.col("group_size") <= int(whole_share * total / shards)
    middle2 = 2 * (F.col("start") + F.when(whole, F.col("group_at")).otherwise(F.col("at"))) + F.when(whole, F.col("group_size")).otherwise(F.col("size"))
    placed = placed.join(F.broadcast(starts), order).withColumn("m", middle2)
    placed = placed.withColumn("shard", F.expr(f"m * {shards} div {2 * total}").cast("int"))
    placed = scratch.save(placed.select("doc_id", "size", "text_crc32", *order, "place", "shard", *extra), "placed")

    runs = placed.groupBy(*order, "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    runs = scratch.save(runs.select(*order, "shard", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift")), "runs")
    out = placed.join(F.broadcast(runs), [*order, "shard"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"), *extra)


def write_shards(sharded: DataFrame, path: str, files: int = 96) -> None:
    """Rows (with ``row``) as one folder per shard, in the order of their slots; large shards have several files."""
    ordered = sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)
