"""Annotations: anchoring provisions in a document's text, and import of annotated documents.

Entities are rows (doc_id, entity_id, label, text, start, normalized_value, attributes map),
relations rows (doc_id, relation_id, relation_type, source_id, target_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Labels of annotated entities and relations.
PROVISION_LABELS = ("ARTICLE", "CLAUSE", "POINT")


def source_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, start, stop): offsets of each chunk in the chunks joined by line feeds."""
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0))
    return chunks.withColumn("start", start).withColumn("stop", F.col("start") + F.length("content"))


def anchor(provisions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Start of each provision (doc_id, seq, three numbers, citation_label, heading, content) in the source text.

    Chunks whose numbers equal the provision's or are null are tried, all chunks of the document where there
    are none; label, heading and content are looked for in this order.
    """
    spans = source_text(chunks).select("doc_id", "chunk_index", "start", F.col("content").alias("chunk"), *(F.col(c).alias(f"chunk_{c}") for c in ("article_number", "clause_number", "point_code")))
    met = provisions.join(spans, "doc_id")
    fits = F.lit(True)
    for c in ("article_number", "clause_number", "point_code"):
        fits = fits & (F.col(f"chunk_{c}").isNull() | F.col(f"chunk_{c}").eqNullSafe(F.col(c)))
    met = met.withColumn("fits", fits)
    some = F.max("fits").over(Window.partitionBy("doc_id", "seq"))
    met = met.withColumn("some", some).where("fits or not some")
    tries = F.array(*(F.struct(F.lit(i).alias("order"), F.when(F.col(c) != "", F.instr("chunk", F.col(c))).otherwise(0).alias("at"), F.length(c).alias("n")) for i, c in enumerate(("citation_label", "heading", "content"))))
    met = met.withColumn("t", F.explode(tries)).where("t.at > 0")
    best = F.min(F.struct(F.col("t.order"), "chunk_index", (F.col("start") + F.col("t.at") - 1).alias("begin"), F.col("t.n").alias("n")))
    found = met.groupBy("doc_id", "seq").agg(best.alias("b"))
    return provisions.select("doc_id", "seq").join(found, ["doc_id", "seq"], "left").select("doc_id", "seq", F.col("b.begin").alias("begin"), (F.col("b.begin") + F.col("b.n")).alias("end"))


def import_provisions(entities: DataFrame) -> DataFrame:
    """Provisions in order of position; a clause belongs to the last article, a point to the last clause of it."""
    rows = entities.where(F.col("label").isin(*PROVISION_LABELS))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("start", F.lit(10**9)), "entity_id")
    rows = rows.withColumn("seq", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda label: F.last(F.when(F.col("label") == label, F.col("seq")), ignorenulls=True).over(upto)
    rows = rows.withColumn("article", last("ARTICLE")).withColumn("clause", last("CLAUSE"))
    clause = F.when(F.col("article").isNull() | (F.col("clause") > F.col("article")), F.col("clause"))
    parent = F.when(F.col("label") == "CLAUSE", F.col("article")).when(F.col("label") == "POINT", F.coalesce(clause, F.col("article")))
    a, c, p = (F.col("attributes")[k] for k in ("article_number", "clause_number", "point_code"))
    heading = F.trim(F.coalesce(F.col("attributes")["heading"], "normalized_value", "text"))
    label = F.concat_ws(" ", F.concat(F.lit("Điểm "), p), F.concat(F.lit("Khoản "), c), F.concat(F.lit("Điều "), a))
    key = F.concat_ws("|", F.coalesce(a, F.lit("0000")), F.coalesce(c, F.lit("0000")), F.coalesce(p, F.lit("00")), F.lpad(F.col("seq").cast("string"), 6, "0"))
    return rows.select("doc_id", "entity_id", "seq", parent.alias("parent_seq"), F.lower("label").alias("level"), F.substring(F.coalesce(F.nullif(label, F.lit("")), heading), 1, 255).alias("citation_label"), key.alias("sort_key"))


def joined_relations(entities: DataFrame, relations: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Relations of some kinds with the labels and texts of both ends; those with a missing end drop out."""
    end = lambda side: entities.select("doc_id", F.col("entity_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.trim("text").alias(f"{side}_text"))
    return relations.where(F.col("relation_type").isin(*kinds)).join(end("source"), ["doc_id", "source_id"]).join(end("target"), ["doc_id", "target_id"])


def dangling(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of which an end is no entity."""
    ids = entities.select("doc_id", "entity_id").distinct()
    gone = [relations.join(ids.withColumnRenamed("entity_id", end), ["doc_id", end], "left_anti").select("doc_id", "relation_id") for end in ("source_id", "target_id")]
    return gone[0].union(gone[1]).distinct()


def segments(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts cut at the first of overlapping spans: (doc_id, begin, end, label), label null between spans."""
    start = F.expr("named_struct('at', cast(0 as int), 'kept', cast(array() as array<struct<begin: int, end: int, label: string>>))")
    sorted_ = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "label"))).alias("s"))

    def step(acc, x):
        plain = F.filter(F.array(F.struct(acc["at"].alias("begin"), x["begin"].alias("end"), F.lit(None).cast("string").alias("label"))), lambda g: g["begin"] < g["end"])
        taken = F.struct(x["end"].alias("at"), F.concat(acc["kept"], plain, F.array(x)).alias("kept"))
        return F.when(x["begin"] >= acc["at"], taken).otherwise(acc)

    rows = texts.select("doc_id", F.length("text").alias("n")).join(sorted_, "doc_id", "left")
    done = F.aggregate(F.coalesce("s", F.expr("cast(array() as array<struct<begin: int, end: int, label: string>>)")), start, step)
    rows = rows.select("doc_id", "n", done.alias("d"))
    rest = F.filter(F.array(F.struct(F.col("d.at").alias("begin"), F.col("n").alias("end"), F.lit(None).cast("string").alias("label"))), lambda g: g["begin"] < g["end"])
    return rows.select("doc_id", F.explode(F.concat("d.kept", rest)).alias("g")).select("doc_id", "g.begin", "g.end", "g.label")
