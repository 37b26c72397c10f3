"""Queries of the repair of scanned texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.shared import spread
from corpusloom.functions.text import tokens
from corpusloom.operators import scans
from corpusloom.operators.editing import LEXICON

from .standins import table


#: letters of a document that a short statute is made of
SHORT = 120


def _scanned(spark, sf, letters=None):
    """Each document as a statute that scanning has damaged: letters taken for digits, no accents, no line breaks; of its words the first ``letters``, else all."""
    i = F.col("doc_id")
    words = F.regexp_replace("text", "[^a-z]+", " ")
    words = F.trim(words if letters is None else F.substring(words, 1, letters))
    say = F.concat(F.lit("CHUONG I QUY DINH CHUNG DIEU "), i % 9 + 1, F.when(i % 2 == 0, " Pham vi dieu chinh").otherwise(" PHAM V1 D1EU CH1NH"), F.lit("\n KH0AN 1 N01 DUNG "), words)
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", say.alias("text"))


def repaired_scans(spark, sf):
    return scans.repair_scans(_scanned(spark, sf, SHORT))


def scan_suggestions(spark, sf):
    """What a reviewer should look at in the repaired texts, all of it."""
    out = scans.preview_corrections(_scanned(spark, sf))
    shown = F.array_join(F.transform("suggestions", lambda s: F.concat_ws(":", s["line_number"], s["token_index"], s["original"], s["corrected"], s["reason"])), "|")
    return out.select("doc_id", "changed_tokens", "review_required", shown.alias("suggestions"))


def lexicon_matches(spark, sf):
    """The closest syllable of statutes, if there is one, to each distinct word of the documents."""
    words = table(spark, sf, "documents").select(F.explode(tokens(F.col("text"), [])).alias("word"))
    return scans.closest(words, tuple(sorted(LEXICON)), scans.REPAIR_RATIO).withColumn("ratio", F.round("ratio", 6))


SCAN_QUERIES = {
    "repaired_scans": (
        repaired_scans,
        r"""SELECT doc_id, trim('Chương I QUY ĐỊNH CHUNG' || chr(10) || 'Điều ' || (doc_id % 9 + 1) || '. Phạm vi điều chỉnh' || chr(10) || trim('1. NOI DUNG ' || trim(substr(regexp_replace(text, '[^a-z]+', ' ', 'g'), 1, 120)))) AS text FROM documents""",
    ),
    "scan_suggestions": (scan_suggestions, None),
    "lexicon_matches": (lexicon_matches, None),
}
