"""Streams over the append-only logs: an extension, since the knowledge base itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Requests, tokens and cost per day of created_at; a day closes when the watermark has passed it."""
    day = F.window("created_at", "1 day")
    out = events.withWatermark("created_at", late).groupBy(day).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return out.select(F.to_date("window.start").alias("day"), "requests", "tokens", "cost")


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Messages of a user without a pause of ``gap`` are one session."""
    return messages.withWatermark("created_at", late).groupBy("user_id", F.session_window("created_at", gap)).agg(F.count("*").alias("messages")).select("user_id", "session_window.start", "session_window.end", "messages")


def first_facts(facts: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of equal facts of a case within the watermark."""
    keyed = facts.withColumn("v", F.lower(F.trim("fact_value"))).withWatermark("created_at", late)
    return keyed.dropDuplicatesWithinWatermark(["case_id", "fact_key", "v"]).drop("v")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; files are written exactly once."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
