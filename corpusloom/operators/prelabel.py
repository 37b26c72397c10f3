"""Proposed annotations: semantic phrases of provisions and their relations, and items of an annotation tool.

Chunks are rows (doc_id, provision_id, start, content), start being the chunk's offset in the document's text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases and patterns by which the semantic parts of a provision are found, in the order tried.
NAME_TAIL = r"[^,.;:\n]{0,120}"
CLAUSE_TAIL = r"[^.;:\n]{0,180}"
BARE_SUBJECTS = ("Cơ quan", "Co quan", "Tổ chức", "To chuc", "Cá nhân", "Ca nhan")
PERSONS = (r"Người\s+[A-ZÀ-Ỵa-zà-ỹ]", r"Nguoi\s+[A-Za-z]")
NAMED_SUBJECTS = ("Nhà đầu tư", "Nha dau tu", "Doanh nghiệp", "Doanh nghiep", "Ủy ban nhân dân", "Uy ban nhan dan", "Bộ trưởng", "Bo truong", "Chủ đầu tư", "Chu dau tu")
MODALS = ("không được", "khong duoc", "được quyền", "duoc quyen", "có quyền", "co quyen", "có trách nhiệm", "co trach nhiem", "phải", "phai")
VERBS = ("thực hiện", "thuc hien", "nộp", "nop", "đăng ký", "dang ky", "cấp", "cap", "thu hồi", "thu hoi", "sử dụng", "su dung", "quản lý", "quan ly", "thanh toán", "thanh toan", "bồi thường", "boi thuong")
MORE_VERBS = ("chấm dứt", "cham dut", "chuyển nhượng", "chuyen nhuong", "giao", "cho thuê", "cho thue")
OBJECT_LEADS = ("phải", "phai", "được", "duoc", "không được", "khong duoc", "có quyền", "co quyen", "được quyền", "duoc quyen")
CONDITIONS = ("trường hợp", "truong hop", "khi", "nếu", "neu")
EXCEPTIONS = ("trừ trường hợp", "tru truong hop", "trừ khi", "tru khi", "không áp dụng đối với", "khong ap dung doi voi")
CONSEQUENCES = ("sẽ bị", "se bi", "bị", "bi", "không có giá trị", "khong co gia tri")
OBJECT_BODY = r"[^.;:\n]{5,180}"
SEMANTIC_LABELS = ("EXCEPTION", "CONDITION", "SUBJECT", "ACTION", "LEGAL_OBJECT", "CONSEQUENCE")
# Relation type, end of the identifier, label of the other end, whether the action is the source.
ACTION_RELATIONS = (
    ("SUBJECT_OF", "subject-of", "SUBJECT", False),
    ("ACTS_ON", "acts-on", "LEGAL_OBJECT", True),
    ("HAS_CONDITION", "condition", "CONDITION", True),
    ("HAS_EXCEPTION", "exception", "EXCEPTION", True),
    ("HAS_CONSEQUENCE", "consequence", "CONSEQUENCE", True),
)
# Result types of the annotation tool that hold labels, and keys that may name the file or hold the text.
LABEL_TYPES = ("labels", "hypertextlabels", "taxonomy")
NAME_KEYS = ("source_file_name", "file_name", "document_name", "title")
LINK_KEYS = ("pdf", "text", "document_url")
TEXT_KEYS = ("text", "content", "body")


def _any(phrases) -> str:
    return "(?:" + "|".join(phrases) + ")"


def _patterns() -> dict[str, list[tuple[str, str, str]]]:
    """Label -> (flags, what stands before the phrase, the phrase)."""
    clause = lambda phrases: [("iU", r"\b", rf"{p}\b{CLAUSE_TAIL}") for p in phrases]
    subjects = [*BARE_SUBJECTS, *(p + NAME_TAIL for p in (*PERSONS, *NAMED_SUBJECTS))]
    return {
        "EXCEPTION": clause(EXCEPTIONS),
        "CONDITION": clause(CONDITIONS),
        "SUBJECT": [("U", r"\b", _any(subjects) + r"\b")],
        "ACTION": [("iU", r"\b", _any([p]) + r"\b") for p in MODALS] + [("iU", r"\b", _any((*VERBS, *MORE_VERBS)) + r"\b")],
        "LEGAL_OBJECT": [("iU", _any((*OBJECT_LEADS, *VERBS)) + r"\s+", OBJECT_BODY)],
        "CONSEQUENCE": clause(CONSEQUENCES),
    }


def _found(text: Column, label: str, patterns) -> Column:
    """The first pattern's first place: struct(label, at, text), at from 0; null without one."""
    tries = []
    for flags, lead, body in patterns:
        pattern = f"(?s{flags})^(.*?{lead})({body})"
        got = F.regexp_replace(F.regexp_extract(text, pattern, 2), r"^[ \t\n:;,]+|[ \t\n:;,]+$", "")
        place = F.struct(F.lit(label).alias("label"), F.length(F.regexp_extract(text, pattern, 1)).alias("at"), got.alias("text"))
        tries.append(F.when(F.length(got) >= 2, place))
    return F.coalesce(*tries)


def semantic_entities(chunks: DataFrame) -> DataFrame:
    """At most one phrase per label and chunk, numbered by place within the provision.

    Null and empty chunks have none; a chunk that is listed twice counts once.
    """
    found = F.array_compact(F.array(*(_found(F.col("content"), label, p) for label, p in _patterns().items())))
    rows = chunks.select("doc_id", "provision_id", "start", F.explode(found).alias("f"))
    begin = (F.col("start") + F.col("f.at")).cast("long")
    rows = rows.select("doc_id", "provision_id", "f.label", "f.text", begin.alias("begin"), (begin + F.length("f.text")).alias("end"))
    rows = rows.dropDuplicates(["doc_id", "provision_id", "label", "begin", "end"])
    n = F.row_number().over(Window.partitionBy("doc_id", "provision_id").orderBy("begin", "end", "label"))
    return rows.withColumn("n", n).withColumn("entity_id", F.concat_ws("-", F.lit("sem"), "provision_id", F.lower("label"), "n"))


def semantic_relations(entities: DataFrame) -> DataFrame:
    """Relations between the first action of a provision and its first subject, object, condition, exception, consequence.

    One aggregate per provision; provisions without an action have none.
    """
    first = lambda label: F.min(F.when(F.col("label") == label, F.struct("n", "entity_id")))["entity_id"]
    firsts = entities.groupBy("doc_id", "provision_id").agg(*(first(label).alias(label) for label in SEMANTIC_LABELS)).where("ACTION is not null")
    made = []
    for kind, end, label, from_action in ACTION_RELATIONS:
        ids = ("ACTION", label) if from_action else (label, "ACTION")
        row = F.struct(F.concat_ws("-", F.lit("sem-rel"), "provision_id", F.lit(end)).alias("relation_id"), F.lit(kind).alias("relation_type"), F.col(ids[0]).alias("source_id"), F.col(ids[1]).alias("target_id"))
        made.append(F.when(F.col(label).isNotNull(), row))
    return firsts.select("doc_id", "provision_id", F.explode(F.array_compact(F.array(*made))).alias("r")).select("doc_id", "provision_id", "r.*")


_RESULT = "array<struct<id: string, type: string, from_id: string, to_id: string, labels: array<string>, score: double, value: map<string, string>>>"
_ITEM = f"struct<data: map<string, string>, annotations: array<struct<result: {_RESULT}>>, predictions: array<struct<result: {_RESULT}>>>"
_PRELABELS = "array<struct<id: string, label: string, text: string, normalized_value: string, attributes: map<string, string>>>"


def _filled(*xs: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))


def tool_items(items: DataFrame, item_col: str = "item") -> DataFrame:
    """Exported items of the annotation tool (JSON texts) as documents with their result rows.

    Reviewed annotations come before predictions; an item without either, or that is no JSON, is a draft.
    """
    # a column of its own, so that an item is read once and not for each field
    name = next(n for n in ("_item" + "_" * i for i in range(len(items.columns) + 1)) if n not in items.columns)
    read = items.withColumn(name, F.from_json(F.col(item_col), _ITEM))
    x = F.col(name)
    given = lambda key: F.coalesce(F.size(x[key]) > 0, F.lit(False))
    key = lambda k: x["data"][k]
    base = [F.substring(F.regexp_replace(key(k), r"(?s)^.*/", ""), 1, 255) for k in LINK_KEYS]
    status = F.when(given("annotations"), "reviewed").when(given("predictions"), "predicted").otherwise("draft")
    result = F.when(given("annotations"), x["annotations"][0]["result"]).when(given("predictions"), x["predictions"][0]["result"])
    return read.select(
        *items.columns,
        key("document_id").try_cast("long").alias("document_id"),
        _filled(*map(key, NAME_KEYS), *base).alias("source_file_name"),
        _filled(*map(key, TEXT_KEYS)).alias("source_text"),
        _filled(key("language"), F.lit("vi")).alias("language"),
        status.alias("review_status"),
        F.from_json(key("metadata_prelabels"), _PRELABELS).alias("prelabels"),
        result.alias("result"),
    )


def _labels(r: Column, value_first: bool) -> Column:
    own, inner = r["labels"], F.from_json(r["value"]["labels"], "array<string>")
    some = [F.when(F.size(x) > 0, x) for x in ((inner, own) if value_first else (own, inner))]
    return F.trim(F.coalesce(*some)[0])


def tool_entities(documents: DataFrame, id_col: str) -> DataFrame:
    """Entities of ``tool_items``: metadata first, then the labelled spans."""
    m = documents.select(id_col, F.posexplode("prelabels").alias("i", "p"))
    text = F.trim(_filled(F.col("p.text"), F.col("p.normalized_value")))
    m = m.select(id_col, _filled(F.col("p.id"), F.concat(F.lit("metadata-"), F.col("i") + 1)).alias("entity_id"), F.trim("p.label").alias("label"), text.alias("text"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), _filled(F.col("p.normalized_value"), text).alias("normalized_value"), F.lit(None).cast("double").alias("score"))
    m = m.where("label != '' and text != ''")
    s = documents.select(id_col, F.explode("result").alias("r")).where(F.lower("r.type").isin(*LABEL_TYPES))
    v = F.col("r.value")
    s = s.select(id_col, F.coalesce("r.id", F.lit("")).alias("entity_id"), _labels(F.col("r"), True).alias("label"), F.coalesce(v["text"], F.lit("")).alias("text"), v["start"].try_cast("int").alias("start"), v["end"].try_cast("int").alias("end"), _filled(v["normalized_value"]).alias("normalized_value"), F.col("r.score").alias("score"))
    return m.unionByName(s.where("label != ''"))


def tool_relations(documents: DataFrame, id_col: str) -> DataFrame:
    """Relations of ``tool_items``; without a label they are RELATED_TO."""
    r = documents.select(id_col, F.explode("result").alias("r")).where(F.lower("r.type") == "relation")
    at = lambda name: F.coalesce(f"r.{name}", F.lit(""))
    kind = F.coalesce(_filled(_labels(F.col("r"), False)), F.lit("RELATED_TO"))
    return r.select(id_col, _filled(F.col("r.id"), F.concat(at("from_id"), F.lit("->"), at("to_id"))).alias("relation_id"), kind.alias("relation_type"), at("from_id").alias("source_id"), at("to_id").alias("target_id"), F.col("r.score").alias("confidence_score"))


def import_summary(documents: DataFrame, entities: DataFrame, relations: DataFrame, id_col: str, provision_labels: tuple[str, ...]) -> DataFrame:
    """Counts per document, 0 where there are none."""
    e = entities.groupBy(id_col).agg(F.count("*").alias("entity_count"), F.count_if(F.col("label").isin(*provision_labels)).alias("provision_count"), F.count_if(F.col("label").isin(*SEMANTIC_LABELS)).alias("semantic_entity_count"))
    r = relations.groupBy(id_col).agg(F.count("*").alias("relation_count"))
    out = reduce(lambda a, b: a.join(b, id_col, "left"), (e, r), documents)
    return out.fillna(0, ["entity_count", "provision_count", "semantic_entity_count", "relation_count"])
