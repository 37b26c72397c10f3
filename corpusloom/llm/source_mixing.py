"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document of size s (words) in source k gets the rate min(cap, exp(lambda_k *
s / mean_k)): of all rates below the cap that meet the source's token target,
these have the least Kullback-Leibler divergence from one copy each.  lambda is
the minimum of the convex dual, found by Newton steps, all sources at once, in
which each step is one aggregation; a bracket catches steps that leave it.

The steps run on the histogram (source, size, number of documents), which the
documents' task-side partial counts make small whatever the size of a source.
Rates become copies by systematic rounding along the histogram (documents of
one size are alike), and up to ``repairs`` single copies per source then remove
most of the remaining difference.  Which of several equal documents gets an
extra copy is decided by a hash, so reruns agree.  Groups of equal documents of
any number are split over salts before they are ranked.

Defined results: null and empty texts have size 0 and add no words; sources of
no words have the target 0; repeated rows count each for itself but share one
fate when wholly equal; extra columns do not matter; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
DOCS_PER_SALT = 1024


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, at most cap times the source's size.

    With sources in order of size per weight, those before the first source that stays below its
    limit are capped and the rest share what is left, so one pass finds the fixed point.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = total.withColumn("weight", weight.cast("double"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    shared = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped_before", cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_size") - F.col("capped_before")) / F.col("left_weight"))
        .withColumn("free", F.col("weight") * F.col("level") <= cap * F.col("source_size"))
        .withColumn("first_free", F.min(F.when(F.col("free"), F.struct(F.col("capped_before").alias("c"), F.col("level").alias("l")))).over(everything))
        .withColumn("free_from_here", F.max(F.col("free").cast("int")).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    )
    target = F.when(F.col("free_from_here"), F.col("weight") * F.col("first_free.l")).otherwise(cap * F.col("source_size"))
    return shared.select("source", "source_size", target.cast("double").alias("target"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    from math import log

    return F.exp(F.least(lam * z, F.lit(log(cap))))


def solve(scratch: Scratch, histogram: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-7, rounds: int = 40) -> DataFrame:
    """(source, lam): tilts that meet the targets; ``histogram`` has source, size, n."""
    mean = F.sum(F.col("size") * F.col("n")) / F.sum("n")
    flat = histogram.where("size > 0").groupBy("source").agg(mean.alias("mean")).withColumn("s", F.coalesce("source", F.lit(""))).withColumn("null_source", F.col("source").isNull())
    keys = ["s", "null_source"]
    goal = goals.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("null_source", F.col("source").isNull()).drop("source")
    start = flat.join(goal, keys).where("target > 0")
    ratio = F.col("target") / F.col("source_size")
    state = start.select(*keys, "mean", "target", F.log(ratio).alias("lam"), F.lit(-5000.0).alias("lo"), F.lit(5000.0).alias("hi"), (ratio >= cap * (1 - 1e-12)).alias("full"))
    state = scratch.save(state, "tilt0")
    rows = histogram.where("size > 0").withColumn("s", F.coalesce("source", F.lit(""))).withColumn("null_source", F.col("source").isNull()).select(*keys, "size", "n")
    rows = scratch.save(rows, "histogram-keys")
    for i in range(1, rounds + 1):
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("lam"), z, cap)
        moving = (F.col("lam") * z < F.log(F.lit(cap))).cast("double")
        sums = rows.join(state.select(*keys, "mean", "lam"), keys).groupBy(*keys).agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * z * r * moving).alias("slope")
        )
        now = state.join(sums, keys)
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        inside = F.coalesce((newton > F.col("l2")) & (newton < F.col("h2")), F.lit(False))
        now = now.withColumns({"l2": lo, "h2": hi, "error": F.abs(gap) / F.col("target")})
        middle = (F.col("l2") + F.col("h2")) / 2
        now = now.select(*keys, "mean", "target", F.when(F.col("full") | (F.col("error") <= tolerance), F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), F.col("l2").alias("lo"), F.col("h2").alias("hi"), "full", "error")
        now = scratch.save(now, f"tilt{i}")
        worst = now.where("not full").agg(F.max("error")).first()[0]
        state = now.drop("error")
        if worst is None or worst <= tolerance:
            break
    lam = F.when(F.col("full"), F.lit(1e9)).otherwise(F.col("lam"))
    return state.select(F.when(F.col("null_source"), F.lit(None)).otherwise(F.col("s")).alias("source"), "mean", lam.alias("lam"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cap: float = 3.0,
    weights: tuple[int, ...] = WEIGHTS,
    repairs: int = 6,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (copies * size) of every document."""
    scratch = Scratch(spark, "mixing")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))
    sizes = scratch.save(sizes.withColumn("h", F.xxhash64("doc_id", "source", "size")), "sizes")
    counts = scratch.save(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    goals = scratch.save(targets(counts.select("source", (F.col("size") * F.col("n")).alias("size")), cap, weights), "goals")
    tilts = solve(scratch, counts, goals, cap)

    salts = F.floor(F.col("n") / DOCS_PER_SALT).cast("int") + 1
    big = counts.withColumn("salts", salts).where("salts > 1").select(F.col("source").alias("bs"), F.col("size").alias("bz"), "salts")
    few = big.count() <= 20_000
    salted = sizes.join(F.broadcast(big) if few else big, _same("source", "bs") & (F.col("size") == F.col("bz")), "left")
    salted = salted.withColumn("salt", F.pmod("h", F.coalesce("salts", F.lit(1))).cast("int")).select("doc_id", "source", "size", "h", "salt")
    cells = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    tilted = cells.join(tilts.select(F.col("source").alias("ts"), "mean", "lam"), _same("source", "ts"), "left").drop("ts")
    rate = F.when(F.col("lam").isNull(), F.lit(0.0)).when(F.col("lam") >= 1e9, F.lit(cap)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), cap))
    along = Window.partitionBy("source").orderBy(F.desc("size"), "salt")
    upto = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rounded = tilted.withColumn("rate", rate).withColumn("upto", upto)
    # of a cell's n documents, each has floor(copies / n) copies and the remainder one more
    copies = (F.floor(F.col("upto") + 0.5 + 1e-9) - F.floor(F.col("upto") - F.col("n") * F.col("rate") + 0.5 + 1e-9)).cast("long")
    plan = rounded.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), (F.col("n") * int(cap)))).select("source", "size", "salt", "n", "copies")
    plan = scratch.save(plan, "plan")
    for i in range(repairs):
        got = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
        gap = got.join(goals.select(F.col("source").alias("gs"), "target"), _same("source", "gs")).select(F.col("source").alias("gs"), (F.col("target") - F.col("got")).alias("gap"))
        seen = plan.join(gap, _same("source", "gs"))
        more = (F.col("gap") > 0) & (F.col("copies") < F.col("n") * int(cap))
        less = (F.col("gap") < 0) & (F.col("copies") > 0)
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & (more | less)
        best = seen.where(fits).groupBy("source").agg(F.min_by(F.struct("size", "salt", F.signum("gap").cast("long").alias("sign")), F.struct(F.abs(F.abs("gap") - F.col("size")).alias("off"), "size", "salt")).alias("b"))
        best = best.select(F.col("source").alias("fs"), F.col("b.size").alias("fz"), F.col("b.salt").alias("ft"), F.col("b.sign").alias("sign"))
        plan = plan.join(best, _same("source", "fs") & (F.col("size") == F.col("fz")) & (F.col("salt") == F.col("ft")), "left")
        plan = scratch.save(plan.select("source", "size", "salt", "n", (F.col("copies") + F.coalesce("sign", F.lit(0))).alias("copies")), f"plan{i}")
    place = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "doc_id"))
    ranked = salted.withColumn("place", place)
    decided = plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("salt").alias("pt"), "n", "copies")
    joined = ranked.join(decided, _same("source", "ps") & (F.col("size") == F.col("pz")) & (F.col("salt") == F.col("pt")))
    own = (F.floor(F.col("copies") / F.col("n")) + (F.col("place") <= F.col("copies") % F.col("n")).cast("long")).cast("long")
    goal = goals.select(F.col("source").alias("gs"), "source_size", "target")
    out = joined.join(goal, _same("source", "gs"))
    return out.select("doc_id", "size", "source_size", "target", own.alias("copies"), (own * F.col("size")).alias("taken"))
