"""Audit of document filters over all orders in which they can be applied.

What a filter removes depends only on the set of filters applied before it, not
on their order.  Sets and the filter that comes next are the edges of a lattice
(5 filters: 80 edges); an order is a path through it.  So documents are counted
once per set of filters that they fail, those counts go to the edges, and the
600 steps of the 120 orders look their edge up.

A document is first reduced to a row of its part, its failures and its labels;
rows of equal failures are added up inside the tasks before anything moves, so
no part, label or failure is hot.  The repeat filter asks for the smallest id
of each text: texts meet by digest, digests of very many rows by a broadcast of
at most a thousand of them.

Defined results: null texts are empty; null languages are the part '' together
with empty ones; rows without an id repeat nothing, are no first text and have
no labels; rows that share id and text are no repeats of each other; of several
labels of a document one with the mark is enough; extra columns do not matter;
no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import attach_totals
from .store import Scratch

FILTERS = "ABCDE"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text alone fails filters A to D."""
    inner = F.trim(text, F.lit(SPACES))
    words = F.split(inner, r"[\x20\x09-\x0D]+")
    n_words = F.when(inner == "", 0).otherwise(F.size(words))
    n_distinct = F.when(inner == "", 0).otherwise(F.size(F.array_distinct(words)))
    n_upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n_words < 100,
        "B": 100 * n_distinct < 80 * n_words,
        "C": 100 * n_upper > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failing_rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, fails, digest): failures of A to D as bits, and the digest of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = F.lit(0)
    for name, fail in text_failures(text).items():
        fails = fails + F.when(fail, _bit(name)).otherwise(0)
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), fails.alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))


def with_repeats(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with E added to the failures of those whose text a smaller id has."""
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    met = attach_totals(scratch, rows, texts, "digest", "first_id")
    repeat = F.when(F.col("doc_id") > F.col("first_id"), _bit("E")).otherwise(0)
    return met.select("doc_id", "part", (F.col("fails") + repeat).alias("fails"))


def with_labels(scratch: Scratch, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the marks good and toxic."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = scratch.save(marks, "marks")
    no = F.lit(False)
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    named = named.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # rows of null ids have no partner and would all go to one task
    return named.unionByName(rows.where("doc_id is null").withColumns({"good": no, "toxic": no}))


def lattice_edges(cells: DataFrame) -> DataFrame:
    """Counts of each (part, applied, filter): ``applied`` has the bits of the filters before, ``filter`` is the next one's number."""
    every = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("applied"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("filter"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    edges = every.where(F.col("applied").bitwiseAND(bit) == 0)
    fails_it = F.col("fails").bitwiseAND(bit) != 0
    fails_before = F.col("fails").bitwiseAND(F.col("applied")) != 0
    lost = ~fails_before & fails_it
    n = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    return edges.groupBy("part", "applied", "filter").agg(
        n(~fails_before & ~fails_it).alias("kept"),
        n(lost).alias("removed"),
        n(fails_before & fails_it).alias("redundant"),
        n(F.col("fails") == bit).alias("unique_fails"),
        n(lost & F.col("good")).alias("good_lost"),
        n(lost & F.col("toxic")).alias("toxic_lost"),
    )


def paths() -> Iterator[tuple[str, int, int, int]]:
    """(order, step, applied, filter) of every step of every order."""
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for step, f in enumerate(order, 1):
            yield "".join(FILTERS[i] for i in order), step, applied, f
            applied |= 1 << f


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, counts of COUNTS, shapley: one row per part and step; ``labels`` has doc_id, quality, toxic."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    rows = scratch.save(failing_rows(docs, id_col, text_col, part_col), "rows")
    marked = with_labels(scratch, with_repeats(scratch, rows), labels)
    cells = marked.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    edges = scratch.save(lattice_edges(cells), "edges")
    steps = spark.createDataFrame(list(paths()), "filter_order string, step int, applied int, filter int")
    met = edges.join(F.broadcast(steps), ["applied", "filter"])
    # each filter is one step of every order
    gains = met.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return met.join(gains, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
