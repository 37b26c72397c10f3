"""Answers of language models as input that cannot be trusted: checked, kept apart, merged, with a default for each failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import digits_padded
from corpusloom.operators.workflow import object_in

#: allowed values of all fields together; they become part of the plan
MOST_ALLOWED = 2000
LEVELS = ("article", "clause", "point")


def read_answers(replies: DataFrame, key: str) -> DataFrame:
    """(key, answer, reason): the JSON object inside each reply (key, reply) as VARIANT; null with the reason where there is none."""
    told = object_in(F.col("reply"))
    parsed = F.try_parse_json(told)
    is_object = F.try_variant_get(parsed, "$", "map<string, variant>").isNotNull()
    reason = F.when(told.isNull(), "no object").when(~F.coalesce(is_object, F.lit(False)), "broken")
    return replies.select(key, "reply", F.when(reason.isNull(), parsed).alias("answer"), reason.alias("reason"))


def quarantine(answers: DataFrame) -> DataFrame:
    """Replies that could not be read, as they came, with the reason."""
    return answers.where("answer is null").drop("answer")


def _clean(answer: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(answer, path, "string")), F.lit(""))


def allow_list(allowed: DataFrame) -> dict[str, list[str]]:
    """Values that each restricted field may have, from (field, value); more than MOST_ALLOWED raise."""
    rows = allowed.select("field", "value").distinct().limit(MOST_ALLOWED + 1).collect()
    if len(rows) > MOST_ALLOWED:
        raise ValueError(f"restricted fields have at most {MOST_ALLOWED} values")
    out: dict[str, list[str]] = {}
    for row in sorted(rows):
        out.setdefault(row["field"], []).append(row["value"])
    return out


def merged_answers(rules: DataFrame, replies: DataFrame, key: str, fields: tuple[str, ...], allowed: DataFrame) -> DataFrame:
    """``rules`` (key and fields) with the fields that a reply overrides, and outcome: answer, partly or default.

    An empty field changes nothing.  A field that the allow-list names only takes its values, as they are written; another
    value is dropped, and the outcome is partly.  A reply that is missing or cannot be read leaves everything as it was.
    """
    lists = allow_list(allowed)
    said = read_answers(replies, key).select(key, "answer", *(_clean(F.col("answer"), f"$.{f}").alias(f"_{f}") for f in fields))
    may = {f: F.col(f"_{f}").isin(*lists[f]) if f in lists else F.lit(True) for f in fields}
    refused = F.lit(False)
    for f in fields:
        refused = refused | F.coalesce(~may[f], F.lit(False))
    out = rules.join(said, key, "left")
    outcome = F.when(F.col("answer").isNull(), "default").when(refused, "partly").otherwise("answer")
    return out.select(key, *(F.coalesce(F.when(may[f], F.col(f"_{f}")), F.col(f)).alias(f) for f in fields), outcome.alias("outcome"))


def sanitised_provisions(replies: DataFrame, key: str) -> DataFrame:
    """Provisions that replies propose in their list ``provisions``: those of a known level with a content, numbered in order.

    key, seq, parent_seq, provision_level, three numbers, heading, content, citation_label, sort_key.  Parents are named by
    node ids, which default to node-1, node-2 and so on; of a repeated id the last counts.  What is no object is left out.
    """
    read = read_answers(replies, key)
    items = F.coalesce(F.try_variant_get("answer", "$.provisions", "array<variant>"), F.array().cast("array<variant>"))
    rows = read.select(key, F.posexplode(items).alias("pos", "item"))
    names = ("article_number", "clause_number", "point_code", "heading", "content", "node_id", "parent_node_id")
    rows = rows.select(key, "pos", F.lower(_clean(F.col("item"), "$.provision_level")).alias("provision_level"), *(_clean(F.col("item"), f"$.{n}").alias(n) for n in names))
    rows = rows.where(F.col("provision_level").isin(*LEVELS) & F.col("content").isNotNull())
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    rows = rows.withColumn("node_id", F.coalesce("node_id", F.concat(F.lit("node-"), "seq")))
    holders = rows.groupBy(key, F.col("node_id").alias("parent_node_id")).agg(F.max("seq").alias("parent_seq"))
    rows = rows.join(holders, [key, "parent_node_id"], "left")
    label = F.concat_ws(" ", F.concat(F.lit("Điều "), "article_number"), F.concat(F.lit("Khoản "), "clause_number"), F.concat(F.lit("Điểm "), "point_code"))
    label = F.coalesce(F.nullif(label, F.lit("")), "heading", F.concat(F.initcap("provision_level"), F.lit(" "), "seq"))
    code = F.lower(F.substring(F.coalesce("point_code", F.lit("")), 1, 1))
    point = F.when(code == "", "000").when(code == "đ", "177").otherwise(F.lpad(F.greatest(F.ascii(code) - 96, F.lit(0)).cast("string"), 3, "0"))
    sort_key = F.concat_ws(".", digits_padded(F.col("article_number")), digits_padded(F.col("clause_number")), point)
    return rows.select(key, "seq", "parent_seq", "provision_level", "article_number", "clause_number", "point_code", F.substring("heading", 1, 500).alias("heading"), "content", F.substring(label, 1, 255).alias("citation_label"), sort_key.alias("sort_key"))
