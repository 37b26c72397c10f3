"""Packages of several tables that become visible together, or not at all.

All tables of a package are written below a folder that nobody reads, read back, counted and summed up; what
was written is compared with what was meant.  Then the folder gets its name, and last its manifest.  A
folder without a manifest is no package, so a job that dies at any point leaves nothing that a reader takes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest.json"
#: a mark that some spreadsheets need to read a file as UTF-8
BYTE_ORDER_MARK = "﻿"


class BrokenPackage(Exception):
    """A package whose files are not those that its manifest tells of."""


@dataclass(frozen=True)
class Format:
    """How a table is written: parquet, json or csv."""

    kind: str = "parquet"
    #: for csv: a mark at the start of each file
    marked: bool = False


class _Store:
    """Files of the store that a path belongs to, by Spark's own access to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise BrokenPackage(f"{old} could not be renamed")

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text


def _strings(df: DataFrame) -> DataFrame:
    """All columns as the texts that a file holds; empty and null are one in CSV."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def checksum(df: DataFrame) -> tuple[int, str]:
    """Number of rows and the sum of their hashes, whatever their order and files."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first()
    return n, str(total)


def _write(df: DataFrame, path: str, how: Format) -> None:
    if how.kind == "csv":
        first, *rest = df.columns
        named = df.withColumnRenamed(first, BYTE_ORDER_MARK + first) if how.marked else df
        named.write.csv(path, header=True, escape='"')
    else:
        df.write.format(how.kind).save(path)


def _read(spark: SparkSession, path: str, how: Format, columns: list[str], schema: str) -> DataFrame:
    if how.kind == "csv":
        rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), escape='"', multiLine=True, enforceSchema=True)
        return _strings(rows)
    return spark.read.schema(schema).format(how.kind).load(path)


def write_package(tables: dict[str, tuple[DataFrame, Format]], path: str, about: dict[str, str] | None = None) -> dict:
    """Writes all tables below ``path``, which must be new, and returns the manifest."""
    spark = next(iter(tables.values()))[0].sparkSession
    store = _Store(spark, path)
    if store.exists(path):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}._{uuid.uuid4().hex}"
    told: dict[str, dict] = {}
    try:
        for name, (df, how) in tables.items():
            rows = _strings(df) if how.kind == "csv" else df
            schema = df.schema.toDDL() if hasattr(df.schema, "toDDL") else ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
            _write(rows, f"{staging}/{name}", how)
            n, total = checksum(_read(spark, f"{staging}/{name}", how, rows.columns, schema))
            if n != rows.count():
                raise BrokenPackage(f"{name}: rows were lost")
            told[name] = {"format": how.kind, "marked": how.marked, "columns": rows.columns, "schema": schema, "rows": n, "checksum": total}
        manifest = {**(about or {}), "tables": told}
        store.rename(staging, path)
        store.write(f"{path.rstrip('/')}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, indent=1))
        return manifest
    except BaseException:
        store.delete(staging)
        raise


def read_package(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Manifest and tables of a package; raises BrokenPackage where the manifest is missing or does not agree with the files."""
    store = _Store(spark, path)
    if not store.exists(f"{path.rstrip('/')}/{MANIFEST}"):
        raise BrokenPackage(f"{path} has no manifest")
    manifest = json.loads(store.read(f"{path.rstrip('/')}/{MANIFEST}"))
    out = {}
    for name, told in manifest["tables"].items():
        df = _read(spark, f"{path.rstrip('/')}/{name}", Format(told["format"], told["marked"]), told["columns"], told["schema"])
        if checksum(df) != (told["rows"], told["checksum"]):
            raise BrokenPackage(f"{path}: {name} does not agree with the manifest")
        out[name] = df
    return manifest, out


# --- what packages hold

# Columns of the trackers, and what a document that nobody has reviewed begins with.
SELECTED_COLUMNS = ("document_id", "file_name", "title", "legal_domain", "document_type", "document_code", "issuing_authority", "effective_date", "legal_status", "risk_level", "selection_reason", "selection_score", "issue_codes")
TRACKER_DEFAULTS = (("reviewer", ""), ("metadata_status", "pending"), ("structure_status", "pending"), ("relation_status", "pending"), ("overall_status", "pending"), ("needs_manual_cleanup", "false"), ("review_notes", ""))
GROUND_TRUTH = "annotation_ground_truth.v1"


def selected_documents(documents: DataFrame) -> DataFrame:
    """Selected documents as a tracker shows them; columns that the table lacks are empty, issues are joined."""
    have = set(documents.columns)
    shown = lambda c: F.array_join("issue_codes", ";") if c == "issue_codes" and c in have else F.col(c) if c in have else F.lit(None)
    return documents.select(*(shown(c).cast("string").alias(c) for c in SELECTED_COLUMNS))


def blank_tracker(documents: DataFrame) -> DataFrame:
    """A row per document for a reviewer to fill in."""
    return documents.select("document_id", "file_name", *(F.lit(value).alias(name) for name, value in TRACKER_DEFAULTS))


def ground_truth(reviewed: DataFrame, lists: tuple[str, ...], saved_at: Column) -> DataFrame:
    """(document_id, bundle): what reviewers confirmed of each document, as JSON with its schema's version.

    reviewed has document_id, reviewer_user_id, payload (JSON) and the arrays named in ``lists``, each with its count.
    """
    size = lambda c: F.greatest(F.size(F.coalesce(F.col(c), F.array().cast(dict(reviewed.dtypes)[c]))), F.lit(0)).alias(c)
    bundle = F.struct(
        F.lit(GROUND_TRUTH).alias("schema_version"), F.date_format(saved_at, "yyyy-MM-dd'T'HH:mm:ss").alias("saved_at"), "reviewer_user_id", "document_id", F.parse_json("payload").alias("payload"),
        F.struct(*lists).alias("import_bundle"), F.struct(*map(size, lists)).alias("bundle_counts"),
    )
    return reviewed.select("document_id", F.to_json(bundle).alias("bundle"))


def graph_tables(provisions: DataFrame, documents: DataFrame, document_relations: DataFrame, provision_relations: DataFrame) -> dict[str, DataFrame]:
    """The six tables that a graph store imports: two of nodes, four of edges."""
    return {
        "documents": documents, "provisions": provisions,
        "has_provision": provisions.where("parent_id is null").select("document_id", F.col("provision_id")),
        "has_child": provisions.where("parent_id is not null").select("parent_id", F.col("provision_id").alias("child_id")),
        "document_relations": document_relations, "provision_relations": provision_relations,
    }


# Labels, ends and types of the six tables; an end is (column, label).
NODES = {"documents": ("document_id", "Document"), "provisions": ("provision_id", "Provision")}
EDGES = {
    "has_provision": (("document_id", "Document"), ("provision_id", "Provision"), "HAS_PROVISION"),
    "has_child": (("parent_id", "Provision"), ("child_id", "Provision"), "HAS_CHILD"),
    "document_relations": (("source_document_id", "Document"), ("target_document_id", "Document"), "RELATES_TO"),
    "provision_relations": (("source_provision_id", "Provision"), ("target_provision_id", "Provision"), "PROVISION_RELATES_TO"),
}
FLOATS = ("confidence_score",)


def in_dialect(tables: dict[str, DataFrame], typed: bool) -> dict[str, DataFrame]:
    """The graph's tables with the headers that an importer asks for.

    The typed dialect names the space of each id and end, marks numbers and has :LABEL and :TYPE; the plain one names ends
    by their kind and has node_label and type.
    """
    out = {}
    for name, df in tables.items():
        key, label = NODES.get(name, (None, None))
        ends, kind = {}, None
        if name in EDGES:
            (start, a), (end, b), kind = EDGES[name]
            ends = {start: f":START_ID({a})", end: f":END_ID({b})"} if typed else {start: f"start_{a.lower()}_id", end: f"end_{b.lower()}_id"}
        shown = lambda c: f"{c}:ID({label})" if typed and c == key else f"{c}:float" if typed and c in FLOATS else ends.get(c, c)  # noqa: E731, B023
        rows = df.select(*(F.col(c).alias(shown(c)) for c in df.columns))
        last = (":LABEL" if typed else "node_label", label) if label else (":TYPE" if typed else "type", kind)
        out[name] = rows.withColumn(last[0], F.lit(last[1]))
    return out
