"""Checks of answers, plans of a case, anchors and scores of concepts, and benchmark scores of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_any

# Words that an answer must have where its evidence calls for them.
BASIS_WORDS = ("căn cứ", "can cu")
STATUS_WORDS = ("hết hiệu lực", "het hieu luc", "không còn", "khong con", "cảnh báo", "canh bao")
CONFLICT_WORDS = ("xung đột", "xung dot", "mâu thuẫn", "mau thuan")
# Findings of the check.
NO_BASIS = "Response text does not expose a legal basis section despite retrieved evidence."
NO_LABELS = "Response text omits top citation labels: "
NO_WARNING = "Response uses non-authoritative evidence without an explicit legal-status warning."
NO_CONFLICT = "Response does not disclose unresolved conflict detected by deterministic tools."
# Notes of a plan's steps.
RELATED_NOTE = "Expanded supporting context from nearby provisions."
CONFLICT_NOTE = "Potential legal conflict remained unresolved."


def response_findings(response: Column, labels: Column, doubtful: Column, unresolved: Column, top: int = 3) -> Column:
    """What an answer fails to say; ``labels`` holds the citation label (or null) of every result, best first.

    ``doubtful``: some evidence is not authoritative.  A null answer has no findings.
    """
    low = F.lower(response)
    missing = F.filter(F.slice(labels, 1, top), lambda x: (x != "") & ~F.contains(low, F.lower(x)))
    found = F.array(
        F.when((F.size(labels) > 0) & ~contains_any(low, BASIS_WORDS), NO_BASIS),
        F.when(F.size(missing) > 0, F.concat(F.lit(NO_LABELS), F.array_join(missing, ", "), F.lit("."))),
        F.when(doubtful & ~contains_any(low, STATUS_WORDS), NO_WARNING),
        F.when(unresolved & ~contains_any(low, CONFLICT_WORDS), NO_CONFLICT),
    )
    return F.when(response.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(found))


def plan_steps(intent: Column, domain: Column, complexity: Column, results: Column, related: Column, unresolved: Column) -> Column:
    """The eight steps of a case: array of (step, status, note)."""
    said = lambda name, x: F.concat(F.lit(f"{name}="), x)
    done = F.lit("completed")
    rows = (
        ("classify_intent", done, said("intent", intent)),
        ("score_complexity", done, said("complexity", complexity)),
        ("retrieve_legal_evidence", F.when(results, "completed").otherwise("empty"), said("domain", domain)),
        ("inspect_related_articles", F.when(related, "completed").otherwise("empty"), F.when(related, RELATED_NOTE)),
        ("check_validity", F.when(results, "completed").otherwise("skipped"), F.lit(None)),
        ("resolve_conflict", F.when(unresolved, "needs_review").otherwise("completed"), F.when(unresolved, CONFLICT_NOTE)),
        ("validate_response", done, F.lit(None)),
        ("escalate_if_needed", F.lit("conditional"), F.lit(None)),
    )
    return F.array(*(F.struct(F.lit(s).alias("step"), status.alias("status"), note.cast("string").alias("note")) for s, status, note in rows))


def concept_anchors(links: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active links (link_id, concept_id, document_id, chunk_id, is_active, metadata_json) with document and chunk, if they exist."""
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "document_code", "legal_status")
    c = chunks.select("chunk_id", "citation_label")
    rows = links.where("is_active").join(d, "document_id", "left").join(c, "chunk_id", "left")
    return rows.withColumn("source_excerpt", F.get_json_object("metadata_json", "$.source_excerpt")).withColumn("anchor_id", F.concat(F.lit("anchor:"), "link_id"))


def graph_concept_score(query: Column, name: Column, aliases: Column) -> Column:
    """Score of a concept in the graph store; all texts folded.  Null where nothing matches."""
    empty = F.coalesce(query, F.lit("")) == ""
    some = lambda test: F.coalesce(F.exists(aliases, test), F.lit(False))
    return (
        F.when(empty, None)
        .when(name == query, 1.0)
        .when(some(lambda a: a == query), 0.98)
        .when(some(lambda a: F.contains(query, a)), 0.78)
        .when(F.contains(query, name), 0.72)
    )


def seed_links(documents: DataFrame, markers: dict[str, tuple[str, ...]], text: Column) -> DataFrame:
    """First document (least id) whose folded text holds a marker of the concept: (concept, document_id).

    Markers are settings, so each document tells its concepts by itself and one small aggregate follows.
    """
    held = F.array_compact(F.array(*(F.when(contains_any(text, words), F.lit(concept)) for concept, words in markers.items())))
    return documents.select("id", F.explode(held).alias("concept")).groupBy("concept").agg(F.min("id").alias("document_id"))


def completeness(*fields: Column) -> Column:
    """Share of fields that are neither null nor empty."""
    filled = sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return F.bround(filled / len(fields), 3)


def chunk_structure_score(legal: Column, chunks: Column, characters: Column) -> Column:
    """Share of chunks with legal structure and mean length against 420 characters."""
    mean = characters / chunks
    return F.when(F.coalesce(chunks, F.lit(0)) == 0, 0.0).otherwise(F.bround(legal / chunks * 0.7 + F.least(mean / 420, F.lit(1.0)) * 0.3, 3))


def review_readiness(metadata_status: Column, relation_status: Column) -> Column:
    m = F.when(metadata_status == "reviewed", 1.0).otherwise(0.45)
    r = F.when(relation_status.isin("synced", "no_matches"), 1.0).when(relation_status == "pending", 0.4).otherwise(0.1)
    return F.bround(m * 0.65 + r * 0.35, 3)


def benchmark_score(metadata: Column, chunks: Column, retrieval: Column, review: Column) -> Column:
    return F.bround(metadata * 0.3 + chunks * 0.2 + retrieval * 0.35 + review * 0.15, 3)
