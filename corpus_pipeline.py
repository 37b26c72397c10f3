"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and reread for the next.
All stages but the last return the columns of documents.

Defined results: null and empty texts are not toxic, have no language (so the
language stage drops them), are linked with nothing, have size 0 in the mix and
pack to the end token alone; ids that are null or repeat name no row, so rows
are then told apart by keys of their own; of linked rows the one with the least
id stays, of one id (or of null ids) any one; extra columns are kept whatever
their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.jaccard_join import jaccard_components
from corpusloom.llm.language_id import UNDETERMINED, predict_language
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.queries import language_examples, table, tokenizer_path, toxic_examples
from corpusloom.llm.source_mixing import mix_sources
from corpusloom.llm.store import Scratch, free_name
from corpusloom.llm.toxicity import score_toxicity

#: the stages cannot be expressed in SQL (trained models, tokenizer); tests hold them against brute force
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    score = free_name(docs, "_toxicity")
    scored = score_toxicity(spark, docs, toxic_examples(docs, table(spark, sf_dir, "labels")), score_col=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages: not undetermined."""
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    found = predict_language(spark, docs, language_examples(docs), lang_col=lang, score_col=score)
    return found.where(F.col(lang) != UNDETERMINED).select(*docs.columns)


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The rows and the column that names each: doc_id, or a new one where doc_id is null or repeats."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs, "doc_id"
    row = free_name(docs, "_row")
    # written, so that a task that runs again gives its rows the same keys
    return scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of linked rows."""
    scratch = Scratch(spark, "kept")
    rows, key = keyed(docs, scratch)
    found = jaccard_components(spark, rows, id_col=key)
    if key == "doc_id":
        kept = found.where("doc_id = component_id").select(key)
    else:
        ids = found.join(rows.select(key, "doc_id"), key)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))
        kept = ids.groupBy("component_id").agg(first.alias("first")).select(f"first.{key}")
    return rows.join(scratch.save(kept, "kept"), key, "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    rows, key = keyed(docs, Scratch(spark, "mixed"))
    own, copies, copy = (free_name(rows, name) for name in ("_id", "_copies", "_copy"))
    taken = mix_sources(spark, rows, id_col=key).where("copies > 0").select(F.col("doc_id").alias(own), F.col("copies").alias(copies))
    out = rows.join(taken, F.col(key) == F.col(own))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4,096 tokens, as op9 packs them."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
