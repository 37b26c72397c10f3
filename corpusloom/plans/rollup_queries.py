"""Queries of reports in one pass and of imported office files."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.sax.saxutils import escape
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions.shared import bounded_batches, spread
from corpusloom.functions.text import LINE_BREAK
from corpusloom.operators import rollups
from corpusloom.sources import office

from .standins import DOCUMENTS_SQL, documents, table

ISSUES = ("MISSING_CODE", "EXPIRED", "LOW_OCR", "NO_DOMAIN", "NEVER_SEEN")


def selection_summary(spark, sf):
    """All documents as a selection, with issues by their metadata; an issue that no document has counts 0."""
    d = documents(spark, sf)
    reason = F.when(F.col("ocr_quality_label") == "ocr_low", "quality").when(F.col("document_code").isNull(), "metadata").otherwise("sample")
    issues = F.array_compact(F.array(F.when(F.col("document_code").isNull(), ISSUES[0]), F.when(F.col("legal_status") == "expired", ISSUES[1]), F.when(F.col("ocr_quality_label") == "ocr_low", ISSUES[2]), F.when(F.col("document_type").isNull(), ISSUES[3])))
    known = spark.createDataFrame([("issue_counts", i) for i in ISSUES], "kind string, key string")
    return rollups.selection_summary(d.select("legal_domain", reason.alias("selection_reason"), issues.alias("issue_codes")), known)


SELECTION_SQL = f"""WITH {DOCUMENTS_SQL}, s AS (SELECT coalesce(legal_domain, 'None') AS d, CASE WHEN ocr_quality_label = 'ocr_low' THEN 'quality' WHEN document_code IS NULL THEN 'metadata' ELSE 'sample' END AS r,
    document_code IS NULL AS a, coalesce(legal_status = 'expired', false) AS b, ocr_quality_label = 'ocr_low' AS c, document_type IS NULL AS e FROM kd)
SELECT 'selected_count' AS kind, 'all' AS key, count(*)::BIGINT AS n FROM s UNION ALL SELECT 'by_domain', d, count(*) FROM s GROUP BY d UNION ALL SELECT 'by_selection_reason', r, count(*) FROM s GROUP BY r
UNION ALL SELECT 'issue_counts', unnest({list(ISSUES)}), unnest([sum(a::INTEGER), sum(b::INTEGER), sum(c::INTEGER), sum(e::INTEGER), 0])::BIGINT FROM s"""


def round_trip_report(spark, sf):
    """Orders as tasks: what they hold follows from their keys."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    some = lambda *pairs: F.array_compact(F.array(*(F.when(k % n == 0, x) for x, n in pairs)))
    rows = o.select(
        F.when(k % 11 != 0, F.col("o_custkey")).alias("document_id"), F.col("o_orderstatus").alias("review_status"), (k % 5).alias("entities"), (k % 3).alias("relations"), F.when(k % 7 != 0, k % 4).alias("metadata_fields"), (k % 6).alias("provisions"),
        F.lit(1).alias("provision_relations"), (k % 2).alias("semantic_entities"), some(("ARTICLE", 1), ("CLAUSE", 2), ("CLAUSE", 4), ("POINT", 3)).alias("labels"), some(("CITES", 2), ("AMENDS", 5)).alias("relation_types"), F.when(k % 13 == 0, F.array(F.lit("no anchor"))).alias("warnings"),
    )
    return rollups.round_trip_report(rows)


ROUND_TRIP_SQL = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS d, o_orderstatus AS s FROM orders)
SELECT 'task_count' AS kind, 'all' AS key, count(*)::BIGINT AS n FROM o UNION ALL SELECT 'document_count', 'all', count(DISTINCT coalesce(d, -1)) FROM o UNION ALL SELECT 'review_status_counts', s, count(*) FROM o GROUP BY s
UNION ALL SELECT 'label_counts', unnest(['ARTICLE', 'CLAUSE', 'POINT']), unnest([count(*), count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 4 = 0), count(*) FILTER (k % 3 = 0)]) FROM o
UNION ALL SELECT 'relation_counts', unnest(['CITES', 'AMENDS']), unnest([count(*) FILTER (k % 2 = 0), count(*) FILTER (k % 5 = 0)]) FROM o UNION ALL SELECT 'warning_counts', 'no anchor', count(*) FROM o WHERE k % 13 = 0
UNION ALL SELECT 'totals', unnest(['entities', 'relations', 'metadata_fields', 'provisions', 'provision_relations', 'semantic_entities']), unnest([sum(k % 5), sum(k % 3), sum(CASE WHEN k % 7 <> 0 THEN k % 4 ELSE 0 END), sum(k % 6), count(*), sum(k % 2)])::BIGINT FROM o"""


def roadmap_totals(spark, sf):
    """Line items by status and by flag, and all together; a flag without items has a row, too."""
    li = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).cast("long").alias("line"))
    known = spark.createDataFrame([("flag", "Z"), ("flag", "A")], "dimension string, value string")
    out = rollups.totals_and_means(li, ["flag", "status"], ["quantity", "line"], known)
    return out.withColumns({c: F.round(c, 6) for c in ("quantity_mean", "line_mean")})


ROADMAP_SQL = """WITH l AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_returnflag END AS flag, l_linestatus AS status, l_quantity::BIGINT AS q, CASE WHEN l_linenumber > 2 THEN l_linenumber END::BIGINT AS line FROM lineitem)
SELECT CASE WHEN grouping(flag) = 0 THEN 'flag' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS dimension, CASE WHEN grouping(flag) = 0 THEN flag WHEN grouping(status) = 0 THEN status END AS value, count(*) AS rows,
    sum(q)::BIGINT AS quantity_sum, round(sum(q)::DOUBLE / count(q), 6) AS quantity_mean, coalesce(sum(line), 0)::BIGINT AS line_sum, round(sum(line)::DOUBLE / count(line), 6) AS line_mean
FROM l GROUP BY GROUPING SETS ((flag), (status), ()) UNION ALL SELECT 'flag', 'Z', 0, 0, NULL, 0, NULL"""

_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def docx_bytes(lines: list[str]) -> bytes:
    """A word-processor file with one paragraph per line, half a table between them."""
    name = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    out = io.BytesIO()
    with ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {name}><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:sectPr/></w:body></w:document>')
    return out.getvalue()


#: files that a task holds before it passes them on
FILES_AT_ONCE = 64


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), FILES_AT_ONCE):
            some = batch.iloc[at : at + FILES_AT_ONCE]
            content = [docx_bytes(list(x)) if i % 50 else b"PK broken" for i, x in zip(some["doc_id"], some["lines"])]
            yield pd.DataFrame({"path": [f"/in/{i}.docx" for i in some["doc_id"]], "content": content})


def docx_round_trip(spark, sf):
    """Paragraphs of documents that were made word-processor files; every fiftieth file is broken."""
    lines = F.split(F.regexp_replace("text", _XML, " "), LINE_BREAK)
    made = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", lines.alias("lines")).mapInPandas(_files, "path string, content binary")
    rows = office.docx_paragraphs(made)
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "pos", "text", F.col("error").isNotNull().alias("failed"))


def imported_files(spark, sf):
    """Documents as files of three kinds: imported, or failed alone."""
    i = F.col("doc_id")
    lines = F.split(F.regexp_replace("text", _XML, " "), LINE_BREAK)
    bounded_batches(spark)
    d = table(spark, sf, "documents")
    office_files = d.where(i % 3 == 0).select("doc_id", lines.alias("lines")).mapInPandas(_files, "path string, content binary")
    plain = d.where(i % 3 != 0).select(F.concat(F.lit("/in/"), i, F.when(i % 3 == 1, ".TXT").otherwise(".pdf")).alias("path"), F.when(i % 7 == 0, F.unhex(F.lit("FF41"))).otherwise(F.col("text").cast("binary")).alias("content"))
    out = office.import_files(office_files.unionByName(plain))
    return out.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "status", F.size("segments").alias("n"))


_LINES_SQL = "list_filter(list_transform(string_split_regex(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '\\r\\n|[\\n\\r\\x85\\x{2028}\\x{2029}]'), lambda s: trim(regexp_replace(s, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g'))), lambda s: true)"
ROLLUP_QUERIES = {
    "selection_summary": (selection_summary, SELECTION_SQL),
    "round_trip_report": (round_trip_report, ROUND_TRIP_SQL),
    "roadmap_totals": (roadmap_totals, ROADMAP_SQL),
    "docx_round_trip": (
        docx_round_trip,
        f"""WITH l AS (SELECT doc_id, {_LINES_SQL} AS x FROM documents WHERE doc_id % 50 <> 0), e AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS text FROM l)
        SELECT doc_id, pos, text, false AS failed FROM e WHERE text <> '' UNION ALL SELECT doc_id, NULL, NULL, true FROM documents WHERE doc_id % 50 = 0""",
    ),
    "imported_files": (
        imported_files,
        f"""WITH l AS (SELECT doc_id, len(list_filter({_LINES_SQL}, lambda s: s <> '')) AS n, CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 <> 0 ELSE doc_id % 3 = 1 AND doc_id % 7 <> 0 END AS ok FROM documents)
        SELECT doc_id, CASE WHEN ok THEN 'imported' ELSE 'failed' END AS status, CASE WHEN ok THEN n ELSE 0 END::INTEGER AS n FROM l""",
    ),
}


def packaged_tables(spark, sf):
    """Counts and headers of a package of the graph's tables, read back from the files of both dialects."""
    from corpusloom.functions.shared import Tables
    from corpusloom.sources import packages

    d = documents(spark, sf).select(F.col("id").alias("document_id"), "title", "document_code", "legal_status")
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("provision_id"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 10 + 1).alias("parent_id"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_document_id"), F.col("o_orderkey").alias("target_document_id"), F.col("o_orderpriority").alias("relation_type"), (F.col("o_orderkey") % 100 / 100).alias("confidence_score"))
    q = p.where("parent_id is not null and provision_id % 3 = 0").select(F.col("provision_id").alias("source_provision_id"), F.col("parent_id").alias("target_provision_id"), F.lit("CITES_PROVISION").alias("relation_type"))
    six, out = packages.graph_tables(p, d, r, q), []
    for dialect in ("typed", "plain"):
        path = f"{Tables(spark, 'package').root}/{dialect}"
        packages.write_package({name: (df, packages.Format("csv", marked=True)) for name, df in packages.in_dialect(six, dialect == "typed").items()}, path)
        for name, df in packages.read_package(spark, path)[1].items():
            ids = F.sum(F.col(f"`{df.columns[0]}`").cast("long"))
            out.append(df.agg(F.lit(dialect).alias("dialect"), F.lit(name).alias("name"), F.lit("|".join(df.columns)).alias("header"), F.count("*").alias("n"), ids.alias("ids"), F.max(F.col(f"`{df.columns[-1]}`")).alias("last")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


PACKAGED_SQL = f"""WITH {DOCUMENTS_SQL}, p AS (SELECT l_suppkey AS d, l_orderkey * 10 + l_linenumber AS p, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS up FROM lineitem),
x AS (SELECT 'documents' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM kd UNION ALL SELECT 'provisions', count(*), sum(d) FROM p UNION ALL SELECT 'has_provision', count(*), sum(d) FROM p WHERE up IS NULL
    UNION ALL SELECT 'has_child', count(*), sum(up) FROM p WHERE up IS NOT NULL UNION ALL SELECT 'document_relations', count(*), sum(o_custkey) FROM orders UNION ALL SELECT 'provision_relations', count(*), sum(p) FROM p WHERE up IS NOT NULL AND p % 3 = 0),
h(dialect, name, header, last) AS (VALUES ('typed', 'documents', 'document_id:ID(Document)|title|document_code|legal_status|:LABEL', 'Document'), ('plain', 'documents', 'document_id|title|document_code|legal_status|node_label', 'Document'),
    ('typed', 'provisions', 'document_id|provision_id:ID(Provision)|parent_id|:LABEL', 'Provision'), ('plain', 'provisions', 'document_id|provision_id|parent_id|node_label', 'Provision'),
    ('typed', 'has_provision', ':START_ID(Document)|:END_ID(Provision)|:TYPE', 'HAS_PROVISION'), ('plain', 'has_provision', 'start_document_id|end_provision_id|type', 'HAS_PROVISION'),
    ('typed', 'has_child', ':START_ID(Provision)|:END_ID(Provision)|:TYPE', 'HAS_CHILD'), ('plain', 'has_child', 'start_provision_id|end_provision_id|type', 'HAS_CHILD'),
    ('typed', 'document_relations', ':START_ID(Document)|:END_ID(Document)|relation_type|confidence_score:float|:TYPE', 'RELATES_TO'), ('plain', 'document_relations', 'start_document_id|end_document_id|relation_type|confidence_score|type', 'RELATES_TO'),
    ('typed', 'provision_relations', ':START_ID(Provision)|:END_ID(Provision)|relation_type|:TYPE', 'PROVISION_RELATES_TO'), ('plain', 'provision_relations', 'start_provision_id|end_provision_id|relation_type|type', 'PROVISION_RELATES_TO'))
SELECT dialect, name, header, n, ids::BIGINT AS ids, last FROM h JOIN x USING (name)"""
ROLLUP_QUERIES["packaged_tables"] = (packaged_tables, PACKAGED_SQL)
