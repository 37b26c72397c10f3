"""Repair of scanned statutes: confused letters, lines, titles and accents, and a preview of further corrections.

Texts stay in Column expressions.  Words that may be misread are looked up once each: distinct words meet the
lexicon through deletion neighbourhoods in an equi-join, and what meets is verified by the ratio of matching blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corpusloom.functions.context import computed_once
from corpusloom.functions.shared import Tables
from corpusloom.functions.text import collapse, fold, words
from corpusloom.operators.editing import LEXICON, scanned_lines, unconfused
from corpusloom.operators.structure import ARTICLE, CHAPTER, CLAUSE, DECIMAL_CLAUSE, PART, POINT, SECTION, TITLE_CHARS, repair_line

# Folded phrases of statutes and how they are written.
PHRASES = (
    ("cong hoa xa hoi chu nghia viet nam", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), ("doc lap tu do hanh phuc", "Độc lập - Tự do - Hạnh phúc"), ("chinh phu", "CHÍNH PHỦ"),
    ("nghi dinh", "NGHỊ ĐỊNH"), ("quyet dinh", "QUYẾT ĐỊNH"), ("thong tu", "THÔNG TƯ"), ("sua doi", "sửa đổi"), ("bo sung", "bổ sung"), ("mot so dieu", "một số điều"),
    ("cua nghi dinh so", "của Nghị định số"), ("quy dinh ve", "quy định về"), ("quy dinh chung", "QUY ĐỊNH CHUNG"), ("tien su dung dat", "tiền sử dụng đất"), ("tien thue dat", "tiền thuê đất"),
    ("quy phat trien dat", "quỹ phát triển đất"), ("can cu", "Căn cứ"), ("luat to chuc chinh phu", "Luật Tổ chức Chính phủ"), ("luat dat dai so", "Luật Đất đai số"), ("luat dat dai", "Luật Đất đai"),
    ("theo de nghi cua", "Theo đề nghị của"), ("bo truong bo tai chinh", "Bộ trưởng Bộ Tài chính"), ("pham vi dieu chinh", "Phạm vi điều chỉnh"), ("doi tuong ap dung", "Đối tượng áp dụng"),
    ("dieu khoan thi hanh", "Điều khoản thi hành"), ("hieu luc thi hanh", "Hiệu lực thi hành"), ("trach nhiem thi hanh", "Trách nhiệm thi hành"), ("giay chung nhan", "Giấy chứng nhận"),
    ("quyen su dung dat", "quyền sử dụng đất"), ("quyen so huu tai san gan lien voi dat", "quyền sở hữu tài sản gắn liền với đất"), ("quy hoach", "quy hoạch"), ("boi thuong", "bồi thường"),
    ("ho tro", "hỗ trợ"), ("tai dinh cu", "tái định cư"),
)
HEADING_LINES = (
    ("chinh phu", "CHÍNH PHỦ"), ("nghi dinh", "NGHỊ ĐỊNH"), ("quyet dinh", "QUYẾT ĐỊNH"), ("thong tu", "THÔNG TƯ"), ("bo tai chinh", "BỘ TÀI CHÍNH"), ("bo tai nguyen va moi truong", "BỘ TÀI NGUYÊN VÀ MÔI TRƯỜNG"),
)
ARTICLE_TITLES = (
    "pham vi dieu chinh", "doi tuong ap dung", "giai thich tu ngu", "nguyen tac ap dung", "nguyen tac", "quyen va nghia vu", "quyen, nghia vu", "dieu khoan thi hanh", "hieu luc thi hanh", "trach nhiem thi hanh",
)
HEADING_WORDS = (("dieu", "Điều"), ("khoan", "Khoản"), ("diem", "Điểm"), ("phan", "Phần"), ("chuong", "Chương"), ("muc", "Mục"), ("so", "số"), ("ngay", "ngày"), ("thang", "tháng"), ("nam", "năm"), ("ha", "Hà"), ("noi", "Nội"), ("cua", "của"))
OTHER_PHRASES = ("Chính phủ", "Cộng hòa xã hội chủ nghĩa Việt Nam", "Độc lập - Tự do - Hạnh phúc", "Hà Nội", "ngày", "tháng", "năm", "Điều", "Khoản", "Điểm", "Chương", "Mục", "Phần", "Nghị định", "Quyết định", "Thông tư")
WRITTEN = (
    "số một bộ sửa đổi phần mục chương điều khoản điểm ngày tháng năm hà nội đất đai nghị định luật chính phủ quỹ về sử dụng thuê căn cứ"
)
ACCENTABLE = (
    "chinh", "phu", "cong", "hoa", "xa", "hoi", "chu", "nghia", "viet", "nam", "doc", "lap", "tu", "hanh", "phuc", "nghi", "dinh", "quyet", "thong", "sua", "doi", "bo", "sung", "mot", "so",
    "dieu", "cua", "quy", "ve", "tien", "su", "dung", "dat", "thue", "can", "cu", "luat", "to", "chuc", "ngay", "thang", "ha", "noi",
)
MISREAD_YEARS = ("am", "na", "nqm", "nm", "mam")
NO_WORDS = ("qh15", "nd", "cp")
NAMED_POINT = r"(Điểm|Diem|ĐIỂM|DIEM)\s+([a-zđ])\s+(.*?)(?=(?:\s+(?:Điểm|Diem|ĐIỂM|DIEM)\s+[a-zđ]\s+)|$)"
WORD = "[A-Za-zÀ-ỹĐđ0-9/-]+"
REPAIR_RATIO, SUGGEST_RATIO = 0.84, 0.88


def _folded(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", x.lower().replace("đ", "d")) if unicodedata.category(c) != "Mn")


def _surfaces() -> dict[str, str]:
    """Folded word to its written form: the first in the phrases, then the words that are fixed."""
    out: dict[str, str] = {}
    for phrase in (*(written for _, written in PHRASES), *OTHER_PHRASES):
        for word in re.findall("[A-Za-zÀ-ỹĐđ]+", phrase):
            out.setdefault(_folded(word), word.lower())
    return out | {_folded(w): w for w in WRITTEN.split()}


SURFACES = _surfaces()
SPELLINGS = tuple(sorted(LEXICON | SURFACES.keys()))


# --- an index of approximate words


@lru_cache(maxsize=1 << 16)
def matching(a: str, b: str) -> int:
    """Letters in matching blocks: the longest common block (the first in a, then in b), then the same on both its sides."""
    best, at, to = 0, 0, 0
    ends = [0] * (len(b) + 1)
    for i in range(len(a)):
        row = [0] * (len(b) + 1)
        for j in range(len(b)):
            if a[i] == b[j]:
                row[j + 1] = ends[j] + 1
                if row[j + 1] > best:
                    best, at, to = row[j + 1], i + 1, j + 1
        ends = row
    return best and best + matching(a[: at - best], b[: to - best]) + matching(a[at:], b[to:])


def _deletions(word: str, cutoff: float) -> set[str]:
    """The word and what is left of it without as many letters as a partner at the cutoff can lack."""
    most = int(len(word) * (2 - 2 * cutoff) / (2 - cutoff) + 1e-9)
    return {"".join(word[i] for i in kept) for n in range(len(word) - most, len(word) + 1) for kept in combinations(range(len(word)), n)}


def closest(candidates: DataFrame, lexicon: tuple[str, ...], cutoff: float) -> DataFrame:
    """(word, match, ratio): the entry of a fixed lexicon with the highest ratio of matching letters, at least ``cutoff``, per distinct word.

    Two strings of that ratio have a common subsequence that lacks few letters of either, so both have it among
    their deletions and meet by an equi-join.  Words much longer than any entry have none.  Of equal ratios the
    entry that sorts last counts.
    """
    longest = int(max(map(len, lexicon)) * (2 - cutoff) / cutoff + 1e-9)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, k) for w in batch["word"] for k in _deletions(w, cutoff)], columns=["word", "key"])

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ratio = [2 * matching(m, w) / (len(m) + len(w)) for w, m in zip(batch["word"], batch["match"])]
            yield batch.assign(ratio=ratio)[lambda x: x["ratio"] >= cutoff]

    distinct = candidates.select("word").where((F.length("word") > 0) & (F.length("word") <= longest)).distinct()
    entries = candidates.sparkSession.createDataFrame([(m, k) for m in lexicon for k in sorted(_deletions(m, cutoff))], "match string, key string")
    pairs = distinct.mapInPandas(keys, "word string, key string").join(F.broadcast(entries), "key").select("word", "match").distinct()
    met = pairs.mapInPandas(ratios, "word string, match string, ratio double")
    return met.groupBy("word").agg(F.max(F.struct("ratio", "match")).alias("b")).select("word", "b.match", "b.ratio")


# --- confused letters

_TOKEN = r"(?U)^(\W*)(\w+)(\W*)$"


def _cased(x: Column, like: Column) -> Column:
    first, rest = F.substring(like, 1, 1), F.substring(like, 2, 1 << 20)
    capital = F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))
    letters = F.lower(like) != F.upper(like)
    lower_rest = (rest == F.lower(rest)) & (rest != F.upper(rest))
    return F.when(letters & (like == F.upper(like)), F.upper(x)).when((first == F.upper(first)) & (first != F.lower(first)) & lower_rest, capital).otherwise(x)


def token_repairs(tokens: DataFrame) -> DataFrame:
    """(token, fixed) of the distinct tokens whose digits are misread letters of a word of the lexicon."""
    core = F.regexp_extract("token", _TOKEN, 2)
    rows = tokens.select("token").distinct().withColumn("core", core).withColumn("word", fold(unconfused(F.col("core"))))
    rows = rows.where((F.length("core") >= 2) & F.col("core").rlike("[013457]") & F.col("core").rlike(r"(?U)[^\d]"))
    known = F.col("word").isin(*sorted(LEXICON))
    near = rows.where(~known & (F.length("word") >= 4) & F.col("word").rlike(r"^\p{L}+$"))
    found = rows.join(closest(near, tuple(sorted(LEXICON)), REPAIR_RATIO), "word", "left")
    fixed = F.when(known, F.col("word")).otherwise(F.col("match"))
    found = found.withColumn("fixed", fixed).where(F.col("fixed").isNotNull() & (F.col("fixed") != fold(F.col("core"))))
    return found.select("token", F.concat(F.regexp_extract("token", _TOKEN, 1), _cased(F.col("fixed"), F.col("core")), F.regexp_extract("token", _TOKEN, 3)).alias("fixed"))


def respelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with tokens repaired and white space collapsed; only documents with misread tokens take part in a join."""
    suspects = F.array_distinct(F.filter(words(F.col(text_col)), lambda t: t.rlike("[013457]") & t.rlike(r"\p{L}")))
    asked = docs.select(id_col, F.explode(suspects).alias("token"))
    fixes = asked.join(token_repairs(asked), "token").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("token", "fixed"))).alias("fixes"))
    own = words(F.coalesce(F.col(text_col), F.lit("")))
    fixed = F.transform(own, lambda t: F.coalesce(F.try_element_at("fixes", t), t))
    out = docs.join(fixes, id_col, "left")
    return out.withColumn(text_col, F.array_join(F.when(F.col("fixes").isNull(), own).otherwise(fixed), " ")).drop("fixes")


# --- lines


def _group(x: Column, pattern: str, i: int) -> Column:
    return F.trim(F.call_function("regexp_extract", x, F.lit(pattern), F.lit(i)))


def _labelled(x: Column, content) -> Column | None:
    """The line with its article, clause or point in the usual form; ``content`` makes what follows the number, null for other lines."""
    glue = lambda head, stop, rest: F.when(rest == "", head).otherwise(F.concat(head, stop, rest))
    article = F.concat(F.lit("Điều "), _group(x, ARTICLE, 2))
    clause, point = F.concat(_group(x, CLAUSE, 2), F.lit(".")), F.concat(F.lower(_group(x, POINT, 2)), F.lit(")"))
    more = lambda p, last: (_group(x, p, 1) != "") | (_group(x, p, last) != "")
    space = F.lit(" ")
    return (
        F.when(x.rlike(ARTICLE), glue(article, F.lit(". "), content(_group(x, ARTICLE, 3), True)))
        .when(x.rlike(CLAUSE) & more(CLAUSE, 3), glue(clause, space, content(_group(x, CLAUSE, 3), False)))
        .when(x.rlike(POINT) & more(POINT, 4), glue(point, space, content(_group(x, POINT, 4), False)))
    )


def usual_line(x: Column) -> Column:
    line = repair_line(x)
    for pattern, word in ((r"(?iU)^(PHẦN|Phan)\b", "Phần"), (r"(?iU)^(Chương|Chuong)\b", "Chương"), (r"(?iU)^(Mục|Muc)\b", "Mục")):
        line = F.regexp_replace(line, pattern, word)
    return F.coalesce(_labelled(line, lambda rest, _: rest), line)


def named_points(x: Column) -> Column:
    """The line's parts where points are named inside it."""
    labels, texts = F.regexp_extract_all(x, F.lit(NAMED_POINT), F.lit(2)), F.regexp_extract_all(x, F.lit(NAMED_POINT), F.lit(3))
    points = F.zip_with(labels, texts, lambda a, t: F.trim(F.concat(a, F.lit(") "), repair_line(t))))
    head = F.trim(F.element_at(F.split(x, NAMED_POINT, 2), 1))
    return F.when(x.rlike(NAMED_POINT), F.filter(F.concat(F.array(head), points), lambda s: s != "")).otherwise(F.array(x))


def _is_heading(x: Column) -> Column:
    return x.rlike(PART) | x.rlike(CHAPTER) | x.rlike(SECTION)


def is_structural(x: Column) -> Column:
    clause = x.rlike(CLAUSE) & (F.length(_group(x, CLAUSE, 2)) <= 3)
    return _is_heading(x) | x.rlike(ARTICLE) | clause | x.rlike(DECIMAL_CLAUSE) | x.rlike(POINT)


def looks_like_title(x: Column) -> Column:
    w, letter = words(x), r"\p{L}"
    first = lambda t: F.substring(t, 1, 1)
    n = F.size(w)
    upper = F.size(F.filter(w, lambda t: t.rlike(letter) & (t == F.upper(t))))
    capital = F.size(F.filter(w, lambda t: t.rlike(letter) & (first(t) == F.upper(first(t))) & (first(t) != F.lower(first(t)))))
    enough = (upper >= F.greatest(F.lit(1), F.ceil(n * 0.6))) | (capital >= F.greatest(F.lit(2), F.ceil(n * 0.7)))
    return (F.length(x) <= TITLE_CHARS) & ~is_structural(x) & (n >= 2) & enough


_BARE = r"(?iu)^(PHẦN|Phan|han|Chương|Chuong|huong|Mục|Muc|uc)$"
_FLAGS = ("heading", "article", "structural", "title", "dot", "stop", "low", "bare")


def _line_flags(x: Column) -> Column:
    """What joining needs to know of a line: bits in the order of _FLAGS, then the number of words."""
    first = F.substring(x, 1, 1)
    low = (first == F.lower(first)) & (first != F.upper(first)) | first.rlike(r"(?U)\d")
    tests = (_is_heading(x), x.rlike(ARTICLE), is_structural(x), looks_like_title(x), F.contains(x, F.lit(".")), x.rlike(r"[.;:?!]$"), low, x.rlike(_BARE))
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return (bits + F.size(words(x)) * (1 << len(tests))).cast("int")


@F.pandas_udf(ArrayType(StringType()))
def _joints(flags: pd.Series) -> pd.Series:
    """What stands before each line: a line feed, or a space or full stop where it goes on from the one before."""
    out = []
    for lines in flags:
        joints: list[str] = []
        heading = article = structural = dot = stop = bare = False
        n = 0
        for i, code in enumerate(lines.tolist()):
            own = {name: bool(code >> k & 1) for k, name in enumerate(_FLAGS)}
            size = code >> len(_FLAGS)
            title = own["title"] and (heading or article and not dot)
            broken = not (structural or own["structural"] or stop or own["title"]) and (own["low"] or n <= 5)
            if i and (title or broken):
                joints.append(". " if title and article and not heading else " ")
                # a heading's word alone becomes a heading by what follows
                heading = structural = heading or bare if broken and not title else heading
                structural = structural or heading or article
                dot, stop, bare, n = dot or own["dot"] or joints[-1] == ". ", own["stop"], False, n + size
            else:
                joints.append("\n" if i else "")
                heading, article, structural, dot, stop, bare, n = own["heading"], own["article"], own["structural"], own["dot"], own["stop"], own["bare"], size
        out.append(joints)
    return pd.Series(out)


def split_title(x: Column) -> Column:
    """An article's line, and what follows a usual title as a line of its own."""
    rest = _group(x, ARTICLE, 3)
    folded, w = fold(rest), words(rest)
    n = None
    for title in ARTICLE_TITLES:
        hit, size = F.startswith(folded, F.lit(title)), len(title.split())
        n = F.when(hit, size) if n is None else n.when(hit, size)
    head = F.concat(F.lit("Điều "), _group(x, ARTICLE, 2), F.lit(". "))
    both = F.array(F.concat(head, F.array_join(F.slice(w, F.lit(1), n), " ")), F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " "))
    return F.when(x.rlike(ARTICLE) & n.isNotNull(), F.when(F.size(w) <= n, F.array(F.concat(head, rest))).otherwise(both)).otherwise(F.array(x))


# --- accents

_ORDERED = sorted((phrase for phrase, _ in PHRASES), key=lambda p: -len(p.split()))
_PHRASE = "(?<![^ ])(?:" + "|".join(" ".join(f"{w}\x02[^ ]*" for w in p.split()) for p in _ORDERED) + ")(?![^ ])"


def _lookup(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def restored(x: Column, headings: bool = False) -> Column:
    """Words with the accents of known phrases: from the left, the longest phrase first; with ``headings`` also single words.

    Each word is written with its folded form before it, so that one pattern finds the phrases and the words between keep their spelling.
    """
    found = F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    coded = F.array_join(F.transform(found, lambda w: F.concat(fold(w), F.lit("\x02"), w)), " ")
    parts = F.split(F.regexp_replace(coded, _PHRASE, "\x03$0\x03"), "\x03")
    own = lambda t: F.substring_index(t, "\x02", -1)
    single = lambda t: F.coalesce(F.try_element_at(_lookup(HEADING_WORDS), F.substring_index(t, "\x02", 1)), own(t)) if headings else own(t)
    between = lambda s: F.array_join(F.transform(F.filter(F.split(s, " "), lambda t: t != ""), single), " ")
    phrase = lambda s: F.try_element_at(_lookup(PHRASES), F.regexp_replace(s, "\x02[^ ]*", ""))
    out = F.array_join(F.filter(F.transform(parts, lambda s, i: F.when(i % 2 == 1, phrase(s)).otherwise(between(s))), lambda s: s != ""), " ")
    return F.when(F.size(found) == 0, x).otherwise(out)


def has_known_phrase(folded: Column) -> Column:
    out = F.lit(False)
    for phrase, _ in PHRASES:
        out = out | F.contains(folded, F.lit(phrase))
    return out


def restored_line(x: Column) -> Column:
    folded = fold(x)
    number, name = F.element_at(words(_group(x, CHAPTER, 2)), 1), F.array_join(F.slice(words(_group(x, CHAPTER, 2)), 2, 1 << 20), " ")
    chapter = F.concat(F.lit("Chương "), number, F.when(name == "", "").otherwise(F.concat(F.lit(" "), restored(name, True))))
    titled = lambda word, pattern: F.trim(F.concat(F.lit(word), restored(_group(x, pattern, 2), True)))
    labelled = _labelled(x, lambda rest, is_article: F.trim(restored(rest, is_article)))
    return F.coalesce(
        F.try_element_at(_lookup(HEADING_LINES), folded), labelled,
        F.when(x.rlike(CHAPTER), chapter).when(x.rlike(SECTION), titled("Mục ", SECTION)).when(x.rlike(PART), titled("Phần ", PART)).when(has_known_phrase(folded), restored(x)), x,
    )


def repair_scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of a scanned statute repaired: letters, line breaks, joined lines, titles, accents."""
    out = respelled(docs, id_col, text_col)
    lines = F.filter(F.transform(F.split(scanned_lines(F.col(text_col)), "\n"), usual_line), lambda s: s != "")
    out = out.withColumn("_lines", F.flatten(F.transform(lines, named_points)))
    out = out.withColumn("_joints", _joints(F.transform("_lines", _line_flags)))
    joined = F.split(F.array_join(F.zip_with("_joints", "_lines", lambda j, s: F.concat(j, s)), ""), "\n")
    out = out.withColumn("_lines", F.flatten(F.transform(joined, split_title)))
    return out.withColumn(text_col, F.trim(F.array_join(F.transform("_lines", restored_line), "\n"))).drop("_lines", "_joints")


# --- suggestions


def suggestions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line_number, token_index, original, corrected, confidence, reason) of each token of repaired texts that a reviewer should see."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    folded = fold(F.col("line"))
    lines = lines.withColumn("structural", is_structural(F.col("line")) | has_known_phrase(folded))
    # a token goes with its neighbours, as a line of n tokens would be copied n times
    beside = lambda tokens: F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.get(tokens, i - 1).alias("before"), F.get(tokens, i + 1).alias("after")))
    lines = lines.select(id_col, "at", "structural", computed_once(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), beside).alias("tokens"))
    rows = lines.select(id_col, "at", "structural", F.posexplode("tokens").alias("token_index", "t")).select(id_col, "at", "structural", "token_index", "t.*")
    token = F.col("token")
    rows = rows.withColumn("word", fold(unconfused(token))).withColumn("digits", token.rlike(r"(?U)\d"))
    quiet = (F.length("token") < 2) | (F.col("word") == "") | token.rlike(r"(?U)^\d{4}$") | fold(token).isin(*NO_WORDS)
    rows = rows.where(~quiet).where("structural or digits or word in ('" + "', '".join(MISREAD_YEARS) + "')")
    # words are looked up and met again: without a table each use would read and fold all lines
    rows = Tables(docs.sparkSession, "suggestions").save(rows, "rows")
    near = closest(rows.where(F.col("structural") | F.col("digits")).where(~F.col("word").isin(*SPELLINGS)), SPELLINGS, SUGGEST_RATIO)
    rows = rows.join(near, "word", "left")

    word, surfaces = F.col("word"), _lookup(SURFACES.items())
    shown = lambda x: _cased(F.coalesce(F.try_element_at(surfaces, x), x), token)
    has_surface, loud = F.try_element_at(surfaces, word).isNotNull(), F.col("structural") | F.col("digits")
    dated = ((fold(F.coalesce("before", F.lit(""))) == "thang") | F.coalesce(F.col("after").rlike(r"(?U)^\d{4}$"), F.lit(False))) & word.isin(*MISREAD_YEARS)
    bare = F.translate(F.lower(token), "đ", "d") == fold(token)
    accent = F.col("structural") & word.isin(*ACCENTABLE) & (word != "nam") & bare & has_surface & (shown(word) != token)
    similar = F.col("match").isNotNull() & loud & (shown(F.col("match")) != token)
    confused = (fold(token) != word) & has_surface & (word != "nam") & loud & (shown(word) != token)
    say = lambda x, sure, why: F.struct(x.alias("corrected"), sure.cast("double").alias("confidence"), F.lit(why).alias("reason"))
    told = (
        F.when(dated, say(_cased(F.lit("năm"), token), F.lit(0.94), "date_context")).when(F.col("digits") & has_surface, say(shown(word), F.lit(0.97), "ocr_confusable_character"))
        .when(accent, say(shown(word), F.lit(0.9), "legal_heading_accent")).when(similar, say(shown(F.col("match")), F.bround(F.greatest(F.lit(0.82), F.col("ratio")), 2), "lexicon_similarity"))
        .when(confused, say(shown(word), F.lit(0.9), "normalized_confusable_match"))
    )
    rows = rows.withColumn("told", told).where(F.col("told").isNotNull() & (F.col("told.corrected") != token))
    return rows.select(id_col, (F.col("at") + 1).alias("line_number"), "token_index", F.col("token").alias("original"), "told.corrected", "told.confidence", "told.reason")


def preview_corrections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, normalised, corrected, changed_tokens, suggestions (all of them), review_required."""
    # written, as a repair costs far more than reading it again for the tokens and for the corrected text
    fixed = Tables(docs.sparkSession, "scans").save(repair_scans(docs, id_col, text_col).select(id_col, F.col(text_col).alias("text")), "fixed")
    found = suggestions(fixed, id_col, "text")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("line_number", "token_index"))
    ranked = found.withColumn("place", order)
    item = F.struct("place", "line_number", "token_index", "original", "corrected", "confidence", "reason")
    key = F.struct("line_number", "token_index")
    told = ranked.groupBy(id_col).agg(
        F.count("*").cast("int").alias("changed_tokens"), F.array_sort(F.collect_list(item)).alias("suggestions"),
        F.map_from_entries(F.collect_list(F.struct(key, "corrected"))).alias("by_place"),
    )

    def mended(line: Column, at: Column) -> Column:
        between, tokens = F.split(line, WORD), F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
        new = F.transform(tokens, lambda t, i: F.coalesce(F.try_element_at("by_place", F.struct((at + 1).alias("line_number"), i.alias("token_index"))), t))
        return F.array_join(F.transform(F.arrays_zip(between.alias("b"), new.alias("t")), lambda x: F.concat(F.coalesce(x["b"], F.lit("")), F.coalesce(x["t"], F.lit("")))), "")

    out = fixed.join(told, id_col, "left")
    corrected = F.when(F.col("by_place").isNull(), F.col("text")).otherwise(F.trim(F.array_join(F.transform(F.split("text", "\n"), mended), "\n")))
    return out.select(
        id_col, F.col("text").alias("normalised"), corrected.alias("corrected"), F.coalesce("changed_tokens", F.lit(0)).alias("changed_tokens"),
        F.coalesce("suggestions", F.array().cast(dict(out.dtypes)["suggestions"])).alias("suggestions"), F.col("suggestions").isNotNull().alias("review_required"),
    )
