"""Metadata that the first lines of a document tell: type, code, authority, dates, status, domain, title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.numeric import parse_date
from corpusloom.functions.text import ascii_slug, ascii_upper, collapse, contains_any, document_code, file_base, file_code, first_hit, fold, nullable, segments, sentence_case

# Words that open a document and its type, in the order they are tried.
TYPE_MARKERS = (
    ("bo luat", "bo-luat"), ("luat", "luat"), ("nghi quyet", "nghi-quyet"), ("nghi dinh", "nghi-dinh"), ("thong tu lien tich", "thong-tu-lien-tich"),
    ("thong tu", "thong-tu"), ("quyet dinh", "quyet-dinh"), ("chi thi", "chi-thi"), ("van ban hop nhat", "van-ban-hop-nhat"), ("an le", "an-le"),
)
CODE_TYPES = (("/ND-", "nghi-dinh"), ("/TTLT-", "thong-tu-lien-tich"), ("/TT-", "thong-tu"), ("/QD-", "quyet-dinh"), ("/CT-", "chi-thi"), ("/VBHN-", "van-ban-hop-nhat"), ("/NQ-", "nghi-quyet"), ("/QH", "luat"))
# Folded authority names and their labels, in the order they are tried.
AUTHORITIES = (
    ("hoi dong tham phan toa an nhan dan toi cao", "Hội đồng Thẩm phán Tòa án nhân dân tối cao"), ("van phong quoc hoi", "Văn phòng Quốc hội"), ("quoc hoi", "Quốc hội"),
    ("uy ban thuong vu quoc hoi", "Ủy ban Thường vụ Quốc hội"), ("chinh phu", "Chính phủ"), ("thu tuong chinh phu", "Thủ tướng Chính phủ"),
    ("bo tai nguyen va moi truong", "Bộ Tài nguyên và Môi trường"), ("bo nong nghiep va moi truong", "Bộ Nông nghiệp và Môi trường"),
    ("bo nong nghiep va phat trien nong thon", "Bộ Nông nghiệp và Phát triển nông thôn"), ("bo tai chinh", "Bộ Tài chính"), ("bo tu phap", "Bộ Tư pháp"),
    ("toa an nhan dan toi cao", "Tòa án nhân dân tối cao"), ("vien kiem sat nhan dan toi cao", "Viện kiểm sát nhân dân tối cao"),
)
AUTHORITY_CODES = (
    ("VBHN-VPQH", "Văn phòng Quốc hội"), ("/QH", "Quốc hội"), ("UBTVQH", "Ủy ban Thường vụ Quốc hội"), ("/ND-CP", "Chính phủ"), ("QD-TTG", "Thủ tướng Chính phủ"), ("CT-TTG", "Thủ tướng Chính phủ"),
    ("-BTNMT", "Bộ Tài nguyên và Môi trường"), ("-BNNMT", "Bộ Nông nghiệp và Môi trường"), ("-BNNPTNT", "Bộ Nông nghiệp và Phát triển nông thôn"), ("-BTC", "Bộ Tài chính"), ("-BTP", "Bộ Tư pháp"),
)
STATUS_ALIASES = (
    *((a, "active") for a in ("active", "con-hieu-luc", "co-hieu-luc", "dang-co-hieu-luc")), *((a, "expired") for a in ("expired", "het-hieu-luc")),
    *((a, "repealed") for a in ("repealed", "bi-bai-bo", "bi-thay-the", "bi-thay-the-bai-bo")), *((a, "draft") for a in ("draft", "du-thao")), *((a, "unknown") for a in ("unknown", "chua-ro", "khong-ro")),
)
DOMAIN_HINTS = {
    "lao-dong": ("lao dong", "hop dong lao dong", "thu viec", "tien luong", "lam them gio", "ky luat lao dong", "sa thai", "bao hiem xa hoi", "tranh chap lao dong", "nghi viec"),
    "hon-nhan-va-gia-dinh": ("hon nhan va gia dinh", "ly hon", "nuoi con", "cap duong", "chia tai san", "ket hon"),
    "dat-dai": ("dat dai", "quyen su dung dat", "thu hoi dat", "boi thuong giai phong mat bang", "so do"),
}
CODE = r"(?iu)\b([0-9]{1,4}\s*/\s*[0-9]{4}\s*/\s*[A-ZĂÂĐÊÔƠƯ][A-ZĂÂĐÊÔƠƯ0-9]*(?:[ ._-]+[A-ZĂÂĐÊÔƠƯ][A-ZĂÂĐÊÔƠƯ0-9]*)*)\b"
DATE_WORDS = r"(?iu)(?:ngày|ngay)\s+(\d{1,2})\s+(?:tháng|thang)\s+(\d{1,2})\s+(?:năm|nam)\s+(\d{4})"
DATE_DIGITS = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
SKIPPED = ("can cu", "dieu ", "khoan ", "muc ", "chuong ")


def head(text: Column, n: int) -> Column:
    return F.slice(segments(text), 1, n)


def code_of(text: Column, file_name: Column) -> Column:
    cited = F.regexp_extract(text, CODE, 1)
    return F.when(cited != "", document_code(cited)).otherwise(file_code(file_name))


def type_of(text: Column, code: Column) -> Column:
    lines = F.transform(head(text, 20), fold)
    out = None
    for marker, value in TYPE_MARKERS:
        hit = F.exists(lines, lambda x: x.rlike(f"^{marker}( |$)"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    known = document_code(F.coalesce(code, F.lit("")))
    for part, value in CODE_TYPES:
        out = out.when(F.contains(known, F.lit(part)), value)
    return out.otherwise("khac")


def authority_of(text: Column, code: Column) -> Column:
    """Named before the first line that begins with the legal basis, else told by the code."""
    lines = head(text, 20)
    basis = F.array_position(F.transform(lines, lambda x: F.startswith(fold(x), F.lit("can cu"))), True)
    header = F.when(basis == 1, F.slice(lines, 1, 8)).when(basis > 1, F.slice(lines, F.lit(1), basis.cast("int") - 1)).otherwise(lines)
    folded = fold(F.array_join(header, "\n"))
    known = document_code(F.coalesce(code, F.lit("")))
    return F.coalesce(first_hit(folded, AUTHORITIES, None), first_hit(known, AUTHORITY_CODES, None))


def level_of(authority: Column, code: Column) -> Column:
    a, c = fold(F.coalesce(authority, F.lit(""))), document_code(F.coalesce(code, F.lit("")))
    has = lambda x, *needles: contains_any(x, needles)
    return (
        F.when(has(a, "van phong quoc hoi") | has(c, "VBHN-VPQH"), "van-phong-quoc-hoi").when(has(a, "quoc hoi") | has(c, "/QH"), "quoc-hoi").when(has(c, "UBTVQH"), "uy-ban-thuong-vu-quoc-hoi")
        .when(has(a, "thu tuong chinh phu") | c.rlike("(QD|CT)-TTG$"), "thu-tuong-chinh-phu").when(has(a, "chinh phu") | has(c, "/ND-CP"), "chinh-phu")
        .when(F.startswith(a, F.lit("bo ")) | c.rlike("/(TT|TTLT|QD)-B[A-Z]+"), "bo").when(has(a, "toa an nhan dan toi cao"), "toa-an-nhan-dan-toi-cao").when(has(a, "vien kiem sat nhan dan toi cao"), "vien-kiem-sat-nhan-dan-toi-cao")
    )


def _date(x: Column, pattern: str) -> Column:
    part = lambda i: F.regexp_extract(x, pattern, i)
    return F.when(x.rlike(pattern), F.try_to_date(F.concat_ws("/", part(1), part(2), part(3)), "d/M/yyyy"))


def signed_date(text: Column) -> Column:
    """First valid date of the first 30 lines that do not begin like a provision."""
    lines = F.filter(head(text, 30), lambda x: ~fold(x).rlike("^(" + "|".join(SKIPPED) + ")"))
    dates = F.transform(lines, lambda x: F.coalesce(_date(x, DATE_WORDS), _date(x, DATE_DIGITS)))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))


def _dated(text: Column, *patterns: str) -> Column:
    folded = fold(text)
    return F.coalesce(*(F.try_to_date(F.nullif(F.replace(F.regexp_extract(folded, p, 1), F.lit("-"), F.lit("/")), F.lit("")), "d/M/yyyy") for p in patterns))


def effective_date(text: Column) -> Column:
    when = r"hieu luc(?: thi hanh)?(?: ke tu| tu)? ngay\s+(\d{1,2}[/-]\d{1,2}[/-]\d{4})"
    return _dated(text, "co " + when, when)


def expiry_date(text: Column) -> Column:
    return _dated(text, r"het hieu luc(?: ke tu| tu)? ngay\s+(\d{1,2}[/-]\d{1,2}[/-]\d{4})", r"co hieu luc den het ngay\s+(\d{1,2}[/-]\d{1,2}[/-]\d{4})")


def status_of(text: Column, since: Column, until: Column, day: Column) -> Column:
    draft = F.contains(fold(F.array_join(head(text, 20), "\n")), F.lit("du thao"))
    return F.when(draft, "draft").when(F.contains(fold(text), F.lit("bai bo")), "repealed").when(until < day, "expired").when(since > day, "draft").otherwise("active")


def title_of(text: Column) -> Column:
    """First line that is no heading, date, number or bare authority, in sentence case."""
    bare = "|".join(m for m, _ in (*TYPE_MARKERS, *AUTHORITIES))
    noise = rf"^(so |so:|ngay |ngay,|can cu|dieu |khoan |muc |chuong |phan |noi nhan|kinh gui)|^({bare})$|ngay\s+\d{{1,2}}\s+thang|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}|\b\d{{1,4}}\s*/\s*\d{{4}}\s*/"
    clean = F.transform(head(text, 25), lambda x: F.regexp_replace(x, r"^[ .:\t-]+|[ .:\t-]+$", ""))
    good = F.filter(clean, lambda x: (x != "") & ~fold(x).rlike(noise) & (F.length(x) <= 240))
    first = F.get(good, F.lit(0))
    return F.when(first == F.upper(first), sentence_case(F.lower(first))).otherwise(sentence_case(first))


def infer(docs: DataFrame, day: Column) -> DataFrame:
    """Documents (doc_id, text, file_name) with code, type, authority, level, title, three dates and status."""
    text = F.col("text")
    out = docs.withColumn("document_code", code_of(text, F.col("file_name")))
    out = out.withColumn("document_type", type_of(text, F.col("document_code"))).withColumn("issuing_authority", authority_of(text, F.col("document_code")))
    out = out.withColumn("authority_level", level_of(F.col("issuing_authority"), F.col("document_code"))).withColumn("title", title_of(text))
    out = out.withColumn("signed_date", signed_date(text)).withColumn("effective_date", effective_date(text)).withColumn("expiry_date", expiry_date(text))
    return out.withColumn("legal_status", status_of(text, F.col("effective_date"), F.col("expiry_date"), day))


MOST_CATEGORIES = 1000


def domain_scores(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """Best category (slug, name, description, position) of each text: 4 per name or description, 3 per hint; first of equals.

    Categories are a small dimension: more than MOST_CATEGORIES raise, since each is tried on each text.
    """
    if categories.limit(MOST_CATEGORIES + 1).count() > MOST_CATEGORIES:
        raise ValueError(f"there are at most {MOST_CATEGORIES} categories")
    hints = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in DOMAIN_HINTS.items() for x in kv))
    rows = docs.select("doc_id", fold(F.col("text")).alias("f")).join(F.broadcast(categories), F.lit(True))
    named = sum((F.when((fold(F.coalesce(F.col(c), F.lit(""))) != "") & F.contains(F.col("f"), fold(F.col(c))), 4).otherwise(0) for c in ("name", "description")), F.lit(0))
    hinted = F.aggregate(F.coalesce(F.try_element_at(hints, F.col("slug")), F.array().cast("array<string>")), F.lit(0), lambda s, h: s + F.when(F.contains(F.col("f"), h), 3).otherwise(0))
    rows = rows.withColumn("score", named + hinted)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "position"))
    return rows.withColumn("p", place).where("p = 1").select("doc_id", F.col("slug").alias("legal_domain"), "score")


def normalise_payload(df: DataFrame) -> DataFrame:
    """Clean metadata columns as they are stored."""
    slugged = {c: F.nullif(ascii_slug(F.col(c)), F.lit("")) for c in ("source_type", "legal_domain", "authority_level", "document_type") if c in df.columns}
    spaced = {c: nullable(F.col(c)) for c in ("source_reference", "storage_path", "summary") if c in df.columns}
    out = df.withColumns(slugged | spaced)
    code = F.replace(F.replace(F.replace(F.upper(nullable(F.col("document_code"))), F.lit(" / "), F.lit("/")), F.lit("- "), F.lit("-")), F.lit(" -"), F.lit("-"))
    alias = ascii_slug(F.col("legal_status"))
    status = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS_ALIASES for x in kv)), alias), F.nullif(alias, F.lit("")))
    return out.withColumns({"document_code": code, "legal_status": status, "title": sentence_case(nullable(F.col("title"))), "file_name": file_base(F.col("file_name"))})


def merged(stored: Column, inferred: Column) -> Column:
    """The stored value, or the inferred one where it is empty."""
    return F.coalesce(F.nullif(F.trim(stored), F.lit("")), inferred)


def placeholder_title(title: Column, file_name: Column) -> Column:
    """A title that is empty, has a bracketed note, repeats the file name or is a number."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*\[[^\]]+\]\s*$", ""))
    print_ = lambda x: collapse(F.regexp_replace(F.lower(ascii_upper(x)), "[^a-z0-9]+", " "))
    t, stem = print_(clean), print_(F.regexp_replace(F.coalesce(file_base(file_name), F.lit("")), r"\.[^.]*$", ""))
    digits = F.length(F.regexp_replace(clean, r"\D", ""))
    count = F.size(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    named = (stem != "") & ((t == stem) | F.contains(t, stem) & (digits >= 4) | (count <= 2) & (digits >= 4))
    return (clean == "") | (clean != F.trim(F.coalesce(title, F.lit("")))) | named


def date_of(x: Column) -> Column:
    return parse_date(F.trim(x), "yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "yyyy/MM/dd")
