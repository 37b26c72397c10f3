"""Operational reports: usage and cost, queues, activity, selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# US dollars per million input, cached input and output tokens.
PRICES = {
    "gpt-4.1": ("2.00", "0.50", "8.00"),
    "gpt-4.1-mini": ("0.40", "0.10", "1.60"),
    "gpt-5.4": ("2.50", "0.25", "15.00"),
    "gpt-5.4-mini": ("0.60", "0.10", "2.40"),
    "gpt-5.4-nano": ("0.15", "0.03", "0.60"),
    "text-embedding-3-small": ("0.02", "0.00", "0.00"),
}
WEB_SEARCH = "0.01"


def token_cost(model: Column, tokens_in: Column, cached: Column, tokens_out: Column, searches: Column) -> Column:
    """Price of a request to six places, half up; null for an unknown model without web searches."""
    price = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for k, v in PRICES.items() for x in (k, v[i]))), model).cast("decimal(9,2)")
    part = lambda n, i: F.coalesce(n.cast("decimal(18,0)") * price(i), F.lit(0).cast("decimal(28,2)"))
    tokens = part(F.greatest(tokens_in - cached, F.lit(0)), 0) + part(cached, 1) + part(tokens_out, 2)
    total = tokens / F.lit(1_000_000).cast("decimal(10,0)") + searches.cast("decimal(18,0)") * F.lit(WEB_SEARCH).cast("decimal(4,2)")
    return F.when(price(0).isNotNull() | (searches > 0), F.round(total, 6).cast("decimal(18,6)"))


def usage_overview(usage: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "success")
    return usage.agg(F.count("*").alias("requests"), ok.alias("succeeded"), F.sum("tokens").alias("tokens"), F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"))


def usage_by_day(usage: DataFrame, days: int = 14) -> DataFrame:
    per = usage.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"))
    return per.orderBy(F.desc("day")).limit(days)


def usage_by_document(usage: DataFrame, limit: int = 20) -> DataFrame:
    per = usage.groupBy("document_id").agg(F.count("*").alias("requests"), F.sum(F.col("cost").cast("decimal(18,6)")).alias("cost"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    return per.orderBy(F.desc("cost"), F.desc("requests"), "document_id").limit(limit)


def counts(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def merged_feed(limit: int, order: str, *sources: DataFrame) -> DataFrame:
    """Newest ``limit`` rows over several sources, each cut to its own newest first."""
    each = [s.orderBy(F.desc(order), "kind", "id").limit(limit) for s in sources]
    return reduce(DataFrame.unionByName, each).orderBy(F.desc(order), "kind", "id").limit(limit)


def queues(limit: int, **queue: DataFrame) -> DataFrame:
    """First ``limit`` of each queue (id, severity, order_key) under its name."""
    rows = []
    for name, q in queue.items():
        rows.append(q.orderBy("order_key", "id").limit(limit).select(F.lit(name).alias("queue"), "id", "severity"))
    return reduce(DataFrame.unionByName, rows)


def queue_summary(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return rows.groupBy("queue").agg(F.count("*").alias("total"), n("high"), n("medium"), n("low"))


def quota_then_fill(items: DataFrame, quotas: dict[str, int], size: int) -> DataFrame:
    """The best of each group up to its quota, then the best of the rest until ``size``; items has id, grp, score."""
    table = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    own = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("id")))
    ranked = items.withColumn("own", own).withColumn("picked", F.col("own") <= F.coalesce(F.try_element_at(table, F.col("grp")), F.lit(0)))
    chosen = ranked.where("picked").withColumn("reason", F.lit("quota"))
    chosen = chosen.orderBy(F.desc("score"), F.desc("id")).limit(size)
    rest = ranked.join(chosen.select("id"), "id", "left_anti").orderBy(F.desc("score"), F.desc("id")).limit(size).withColumn("reason", F.lit("fill"))
    both = chosen.unionByName(rest)
    return both.orderBy(F.desc("reason"), F.desc("score"), F.desc("id")).limit(size).select("id", "grp", "score", "reason")
