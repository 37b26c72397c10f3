"""Paragraphs of word-processor files and rows of workbooks, from the bytes that Spark has read.

Both kinds are zipped XML.  Spark's own file source deals the files, so any store that it reads will do; a task
pulls one element after the other from its files and forgets it.  A file that cannot be read is one row with the
reason, and does not end the job.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element, ParseError, iterparse
from zipfile import BadZipFile, ZipFile
from zlib import error as ZlibError

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import segments
from corpusloom.operators.structure import repair_line

#: what a damaged file can raise while it is read
BROKEN = (BadZipFile, ParseError, ZlibError, KeyError, ValueError, IndexError, EOFError, NotImplementedError, RuntimeError)
ROWS_AT_ONCE = 2000


def _name(tag: str) -> str:
    """Tag without its name space."""
    return tag.rpartition("}")[2]


def _attribute(e: Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _name(k) == name), None)


def _run_text(p: Element) -> str:
    """Text of the runs of a paragraph and of its links, with tabs and line breaks."""
    shown = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    runs = [r for child in p for r in ([child] if _name(child.tag) == "r" else child if _name(child.tag) == "hyperlink" else ()) if _name(r.tag) == "r"]
    return "".join(e.text or "" if _name(e.tag) == "t" else shown.get(_name(e.tag), "") for r in runs for e in r)


def paragraphs(data: bytes) -> Iterator[str]:
    """Text of each paragraph of the body; those inside tables are none."""
    with ZipFile(io.BytesIO(data)) as archive, archive.open("word/document.xml") as xml:
        depth = 0
        for event, e in iterparse(xml, events=("start", "end")):
            if event == "start":
                depth += 1
                continue
            if depth == 3:
                if _name(e.tag) == "p":
                    yield _run_text(e)
                e.clear()
            depth -= 1


def _column(reference: str) -> int:
    """Number of a cell's column, from 0, by its letters."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _all_text(e: Element) -> str:
    """Text of a shared or inline string: plain or in runs, without phonetic hints."""
    out = [e.findtext("{*}t") or ""]
    out += [run.findtext("{*}t") or "" for run in e.iterfind("{*}r")]
    return "".join(out)


def sheet_cells(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, texts of its cells) of all sheets of a workbook, formulas as their stored results."""
    with ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        strings: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with archive.open("xl/sharedStrings.xml") as xml:
                for _, e in iterparse(xml):
                    if _name(e.tag) == "si":
                        strings.append(_all_text(e))
                        e.clear()
        with archive.open("xl/_rels/workbook.xml.rels") as xml:
            targets = {_attribute(e, "Id"): _attribute(e, "Target") or "" for _, e in iterparse(xml) if _name(e.tag) == "Relationship"}
        with archive.open("xl/workbook.xml") as xml:
            sheets = [(e.get("name") or "", targets[_attribute(e, "id")]) for _, e in iterparse(xml) if _name(e.tag) == "sheet"]
        for sheet, target in sheets:
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            with archive.open(path) as xml:
                for _, e in iterparse(xml):
                    if _name(e.tag) != "row":
                        continue
                    cells: list[str | None] = []
                    for c in e:
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        value, kind = c.findtext("{*}v"), c.get("t")
                        if kind == "inlineStr":
                            inline = c.find("{*}is")
                            value = None if inline is None else _all_text(inline)
                        elif value is not None and kind == "s":
                            value = strings[int(value)]
                        cells[at] = value
                    yield sheet, int(e.get("r") or 0), cells
                    e.clear()


def _read(files: DataFrame, rows_of, columns: str) -> DataFrame:
    """(path, the columns, error) of the rows that ``rows_of`` makes of each file's content."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for row in rows_of(content or b""):
                        rows.append((path, *row, None))
                        if len(rows) >= ROWS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=["path", *names, "error"])
                            rows = []
                except BROKEN as e:
                    rows.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", *names, "error"]).astype({n: "Int64" for n in names if n in ("pos", "row")})

    return files.select("path", "content").mapInPandas(run, f"path string, {columns}, error string")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(path, pos, text, error): paragraphs of files (path, content) in order, as lines of a statute, without empty ones.

    What of a damaged file could be read before the damage is kept; its last row has the error.
    """
    rows = _read(files, lambda data: enumerate(paragraphs(data)), "pos long, text string")
    return rows.withColumn("text", repair_line(F.col("text"))).where("error is not null or text <> ''")


def workbook_rows(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells, error): rows of all sheets of workbooks (path, content)."""
    return _read(files, sheet_cells, "sheet string, row long, cells array<string>")


def import_files(files: DataFrame) -> DataFrame:
    """(path, status, error, segments) of each file (path, content): texts in UTF-8 and word-processor files are imported, others fail with a reason.

    One bad file fails alone.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    plain = files.where(suffix == "txt").select("path", F.when(text.isNull(), "not UTF-8").alias("error"), segments(text).alias("segments"))
    line = F.when(F.col("text").isNotNull(), F.struct("pos", "text"))
    office = docx_paragraphs(files.where(suffix == "docx")).groupBy("path").agg(F.max("error").alias("error"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]).alias("segments"))
    read = plain.unionByName(office)
    none = F.array().cast("array<string>")
    error = F.when(~suffix.isin("txt", "docx"), "unsupported type").otherwise(F.col("error"))
    out = files.select("path").join(read, "path", "left").withColumn("error", error)
    out = out.withColumn("segments", F.when(F.col("error").isNull(), F.coalesce("segments", none)).otherwise(none))
    return out.select("path", F.when(F.col("error").isNull(), "imported").otherwise("failed").alias("status"), "error", "segments")


# What the numbers of a field of law begin with; others begin with LAND.
CASE_PREFIXES = (("hon-nhan-va-gia-dinh", "FAMILY"),)


def benchmark_cases(rows: DataFrame, domains: dict[str, str], most: int = 25) -> DataFrame:
    """Cases of the sheets (path, sheet, row, cells) that ``domains`` names: case_id, domain, query, expectations.

    The header is the first row that holds the word Prompt; rows before it and rows without question or answer are
    left out, and of each sheet the first ``most`` cases are taken, numbered in order.
    """
    cell = lambda x: F.nullif(F.trim(x), F.lit(""))
    named = rows.where(F.col("sheet").isin(*domains))
    is_header = F.exists(F.col("cells"), lambda c: F.trim(c) == "Prompt")
    first = F.min(F.when(is_header, F.struct("row", "cells"))).over(Window.partitionBy("path", "sheet"))
    named = named.withColumn("header", first).where(F.col("row") > F.col("header.row"))
    heads = F.transform("header.cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    get = lambda name: cell(F.get("cells", F.nullif(F.array_position(heads, name), F.lit(0)).cast("int") - 1))
    slugs = F.create_map(*(F.lit(x) for pair in domains.items() for x in pair))
    out = named.select("path", "sheet", "row", slugs[F.col("sheet")].alias("domain"), get("Prompt").alias("query"), get("Expected Output").alias("answer"), get("Category").alias("category"), get("Legal Basic").alias("basis"))
    out = out.where("query is not null and answer is not null")
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row"))).where(F.col("n") <= most)
    category = F.coalesce("category", F.lit("Legal QA"))
    prefix = F.when(F.col("domain") == CASE_PREFIXES[0][0], CASE_PREFIXES[0][1]).otherwise("LAND")
    return out.select(
        F.format_string("%s-XLSX-%03d", prefix, F.col("n")).alias("case_id"), "domain", "query", *case_expectations(category), F.substring("answer", 1, 700).alias("expected_answer_excerpt"), F.coalesce("basis", F.lit("")).alias("legal_basis_text"), category.alias("source_category")
    )


def case_expectations(category: Column) -> list[Column]:
    """expected_intent, expected_complexity, must_escalate and required_checks by the words of a category."""
    has = lambda *terms: F.lower(category).rlike("|".join(terms))
    checks = lambda *names: F.array(*map(F.lit, names))
    legal, cited, grounded = "legal_status_checked", "citation_present", "answer_grounded"
    return [
        F.when(has("hierarchy", "conflict"), "conflict_check").when(has("database coverage"), "legal_search").otherwise("legal_qa").alias("expected_intent"),
        F.when(has("conflict", "temporal", "compliance"), "high").otherwise("medium").alias("expected_complexity"), has("compliance").alias("must_escalate"),
        F.when(has("compliance"), checks("escalation_for_missing_evidence", legal)).when(has("temporal"), checks(cited, legal, grounded)).when(has("hierarchy", "conflict"), checks(cited, "conflict_checked", legal))
        .when(has("database coverage"), checks(cited)).otherwise(checks(grounded)).alias("required_checks"),
    ]
