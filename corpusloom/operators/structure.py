"""Hierarchies and chunks of structured texts, by windows over (document, line).

Lines are classified by patterns; running sums and last values over the lines
of a document take the place of a parser's state.  Every step is a Column
expression; the only exchange is the one by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusloom.functions.text import LINE_BREAK, collapse, digits_padded, slug
from corpusloom.functions.text import segments as text_segments

# Line patterns of statutes (with the damage that scanning does to first letters).
PART = r"(?iu)^(PHẦN|Phan|han)\s+(.+)$"
CHAPTER = r"(?iu)^(Chương|Chuong|huong)\s+(.+)$"
SECTION = r"(?iu)^(Mục|Muc|uc)\s+(.+)$"
ARTICLE = r"(?iu)^(Điều|Dieu|ieu)\s+(\d+[A-Za-z]*)\s*[\.:\-]?\s*(.*)$"
CLAUSE = r"(?iu)^((?:Khoản|Khoan|hoan)\s+)?(\d+)(?!\.\d)[\.:\-]?\s*(.*)$"
POINT = r"^((?:Điểm|Diem|iem)\s+)?([a-zđ])([\)\.:\-])?\s*(.*)$"
ROMAN = r"(?iu)^([IVXLC]+)\.\s*(.*)$"
OUTLINE = r"(?iu)^(\d+)[\.\-:]\s*(.*)$"
DECIMAL_CLAUSE = r"(?iu)^(\d+\.\d+)[\.\-:]?\s*(.*)$"
REPAIRS = (
    (r"(?iu)^(ieu)(\s+\d+[A-Za-z]*)", "Điều$2"),
    (r"(?iu)^(hoan)(\s+\d+)", "Khoản$2"),
    (r"(?iu)^(iem)(\s+[a-zđ])", "Điểm$2"),
    (r"(?iu)^(huong)(\s+[IVXLC0-9])", "Chương$2"),
    (r"(?iu)^(uc)(\s+[IVXLC0-9A-Za-z])", "Mục$2"),
    (r"(?iu)^(han)(\s+[IVXLC0-9A-Za-z])", "Phần$2"),
)
TITLE_CHARS = 220


def repair_line(x: Column) -> Column:
    out = collapse(x)
    for pattern, to in REPAIRS:
        out = F.regexp_replace(out, pattern, to)
    return out


def lines(docs: DataFrame, repair: bool = True) -> DataFrame:
    """(doc_id, pos, seg) of the non-empty lines."""
    norm = repair_line if repair else collapse
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), LINE_BREAK), norm), lambda s: s != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "seg"))


@dataclass(frozen=True)
class Grammar:
    """The parser takes any number as a clause; the chunker no number of more than ``clause_digits`` digits."""

    clause_digits: int | None = None

    def clause(self, x: Column) -> Column:
        plain = x.rlike(CLAUSE)
        if self.clause_digits is not None:
            plain = plain & (F.length(F.regexp_extract(x, CLAUSE, 2)) <= self.clause_digits)
        return plain | x.rlike(DECIMAL_CLAUSE)

    def classify(self, x: Column) -> Column:
        head = F.when(x.rlike(PART), "part").when(x.rlike(CHAPTER), "chapter").when(x.rlike(SECTION), "section")
        outline = x.rlike(OUTLINE) & (F.length(F.regexp_extract(x, OUTLINE, 1)) <= 3)
        return head.when(x.rlike(ARTICLE), "article").when(x.rlike(ROMAN), "roman").when(outline, "outline").otherwise("body")


def clause_number(x: Column) -> Column:
    return F.when(x.rlike(CLAUSE), F.regexp_extract(x, CLAUSE, 2)).when(x.rlike(DECIMAL_CLAUSE), F.regexp_extract(x, DECIMAL_CLAUSE, 1))


def clause_content(x: Column) -> Column:
    inline = F.when(x.rlike(CLAUSE), F.regexp_extract(x, CLAUSE, 3)).when(x.rlike(DECIMAL_CLAUSE), F.regexp_extract(x, DECIMAL_CLAUSE, 2))
    return F.nullif(F.trim(inline), F.lit(""))


def outline_rows(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """Lines with their place in the hierarchy: kind, region, article, clause, point and context.

    article is 0 outside articles; clause and point are 0 before the first of their parent.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    seg = F.col("seg")
    rows = rows.withColumn("kind", grammar.classify(seg)).withColumn("is_clause", grammar.clause(seg)).withColumn("is_point", seg.rlike(POINT))
    heads = ("part", "chapter", "section")
    bare = (F.col("kind") == "article") & (F.trim(F.regexp_extract(seg, ARTICLE, 3)) == "")
    bare = bare | (F.col("kind") == "roman") & (F.trim(F.regexp_extract(seg, ROMAN, 2)) == "")
    rows = rows.withColumn("wants", F.col("kind").isin(*heads) | bare)
    title = ~F.col("kind").isin(*heads, "article") & ~F.col("is_clause") & ~F.col("is_point") & (F.length(seg) <= TITLE_CHARS)
    # in a run of lines that could each be the title of the line before, every other one is
    rows = rows.withColumn("link", title & F.coalesce(F.lag("wants").over(doc), F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("link")).cast("int")).over(upto))
    in_run = Window.partitionBy("doc_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("consumed", F.col("link") & (F.sum(F.col("link").cast("int")).over(in_run) % 2 == 1))
    rows = rows.withColumn("title", F.when(F.lead("consumed").over(doc), F.lead("seg").over(doc))).where("not consumed")

    standard = F.col("kind").isin("article", "roman")
    rows = rows.withColumn("region", F.sum((F.col("kind").isin(*heads) | standard).cast("int")).over(upto))
    in_region = Window.partitionBy("doc_id", "region").orderBy("pos")
    rows = rows.withColumn("standard", F.first(standard).over(in_region))
    rows = rows.withColumn("opens", standard | (F.col("kind") == "outline") & ~F.col("standard"))
    rows = rows.withColumn("article", F.sum(F.col("opens").cast("int")).over(upto))
    opened = F.max("opens").over(in_region.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("article", F.when(opened & ~F.col("kind").isin(*heads), F.col("article")).otherwise(0))

    glued = F.concat_ws(" ", "seg", "title")
    for head in heads:
        rows = rows.withColumn(head, F.last(F.when(F.col("kind") == head, glued), ignorenulls=True).over(upto))
    number = F.when(F.col("kind") == "article", F.regexp_extract(seg, ARTICLE, 2)).when(F.col("kind") == "roman", F.upper(F.regexp_extract(seg, ROMAN, 1))).when(F.col("kind") == "outline", F.regexp_extract(seg, OUTLINE, 1))
    own = F.when(F.col("kind") == "article", F.regexp_extract(seg, ARTICLE, 3)).when(F.col("kind") == "roman", F.regexp_extract(seg, ROMAN, 2)).when(F.col("kind") == "outline", F.regexp_extract(seg, OUTLINE, 2))
    own = F.coalesce(F.nullif(F.trim(own), F.lit("")), F.col("title"))
    lead = F.when(F.col("kind") == "article", F.concat(F.lit("Điều "), number)).otherwise(F.concat(number, F.lit(".")))
    dotted = F.when(F.col("kind") == "article", F.concat(lead, F.lit(". "), own)).otherwise(F.concat(lead, F.lit(" "), own))
    rows = rows.withColumn("heading", F.when(F.col("opens"), F.coalesce(dotted, lead))).withColumn("number", F.when(F.col("opens"), number)).withColumn("inline", F.when(F.col("opens"), own))

    in_article = Window.partitionBy("doc_id", "article").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts_clause = F.col("is_clause") & ~F.col("opens") & (F.col("article") > 0)
    rows = rows.withColumn("starts_clause", starts_clause)
    rows = rows.withColumn("clause", F.when(F.col("article") > 0, F.sum(F.col("starts_clause").cast("int")).over(in_article)).otherwise(0))
    in_clause = Window.partitionBy("doc_id", "article", "clause").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("starts_point", F.col("is_point") & ~F.col("starts_clause") & (F.col("clause") > 0))
    return rows.withColumn("point", F.when(F.col("clause") > 0, F.sum(F.col("starts_point").cast("int")).over(in_clause)).otherwise(0))


def _joined(name: str, test: Column, value: Column | None = None) -> Column:
    """Texts of the lines that pass a test, in order."""
    value = F.col("seg") if value is None else value
    kept = F.array_sort(F.collect_list(F.when(test & value.isNotNull(), F.struct("pos", value.alias("text")))))
    return F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias(name)


def parse_provisions(docs: DataFrame) -> DataFrame:
    """Articles, clauses and points of each document (doc_id, text), numbered in reading order by seq.

    A repeated number makes a repeated temporary id; the parent is then its last holder.
    """
    rows = outline_rows(lines(docs), Grammar()).where("article > 0")
    heading = F.max(F.when(F.col("opens"), F.col("heading")))
    context = [F.first(c).alias(c) for c in ("part", "chapter", "section")]
    per_article = rows.groupBy("doc_id", "article").agg(
        heading.alias("article_heading"), F.max("number").alias("article_number"), F.max(F.when(F.col("opens"), F.col("inline"))).alias("article_inline"), F.max("clause").alias("clauses"),
        F.min(F.when(F.col("opens"), F.struct("part", "chapter", "section"))).alias("context"), _joined("article_body", ~F.col("opens") & (F.col("clause") == 0)),
    )
    del context
    clauses = rows.where("clause > 0").groupBy("doc_id", "article", "clause").agg(
        F.max(F.when(F.col("starts_clause"), F.col("seg"))).alias("clause_heading"), _joined("clause_body", ~F.col("starts_clause") & (F.col("point") == 0))
    )
    points = rows.where("point > 0").groupBy("doc_id", "article", "clause", "point").agg(
        F.max(F.when(F.col("starts_point"), F.col("seg"))).alias("point_heading"), _joined("point_body", ~F.col("starts_point"))
    )
    text = lambda *parts: F.trim(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n"))
    a = per_article.withColumn("citation", F.when(F.col("article_heading").rlike(ARTICLE), F.concat(F.lit("Điều "), F.col("article_number"))).otherwise(F.col("article_heading")))
    a = a.withColumn("asort", digits_padded(F.col("article_number"))).withColumn("aid", F.concat(F.lit("article:"), F.col("article_number")))
    c = clauses.join(a.drop("article_body", "article_inline"), ["doc_id", "article"]).withColumn("clause_number", clause_number(F.col("clause_heading")))
    c = c.withColumn("csort", digits_padded(F.col("clause_number"))).withColumn("cid", F.concat("aid", F.lit(":clause:"), "clause_number"))
    c = c.withColumn("ccitation", F.concat("citation", F.lit(" Khoản "), "clause_number"))
    p = points.join(c.drop("clause_body"), ["doc_id", "article", "clause"]).withColumn("point_code", F.regexp_extract("point_heading", POINT, 2))
    psort = F.when(F.col("point_code") == "đ", "177").otherwise(F.lpad((F.ascii("point_code") - 96).cast("string"), 3, "0"))
    null = F.lit(None).cast("string")
    shape = lambda df, level, clause, point, heading, content, citation, key, temp, parent, cn, pc: df.select(
        "doc_id", "article", clause.alias("clause"), point.alias("point"), F.lit(level).alias("provision_level"), "article_number", cn.alias("clause_number"), pc.alias("point_code"),
        F.substring(heading, 1, 500).alias("heading"), content.alias("content"), F.substring(citation, 1, 255).alias("citation_label"), key.alias("sort_key"), temp.alias("temp_id"), parent.alias("parent_temp_id"), "context",
    )
    zero, dot = F.lit(0), F.lit(".")
    articles = shape(a, "article", zero, zero, F.col("article_heading"), text(F.col("article_inline"), F.col("article_body")), F.col("citation"), F.concat("asort", F.lit(".000.000")), F.col("aid"), null, null, null)
    clause_rows = shape(c, "clause", F.col("clause"), zero, F.col("clause_heading"), text(clause_content(F.col("clause_heading")), F.col("clause_body")), F.col("ccitation"), F.concat("asort", dot, "csort", F.lit(".000")), F.col("cid"), F.col("aid"), F.col("clause_number"), null)
    point_rows = shape(
        p, "point", F.col("clause"), F.col("point"), F.col("point_heading"), text(F.nullif(F.trim(F.regexp_extract("point_heading", POINT, 4)), F.lit("")), F.col("point_body")),
        F.concat("ccitation", F.lit(" Điểm "), "point_code"), F.concat("asort", dot, "csort", dot, psort), F.concat("cid", F.lit(":point:"), "point_code"), F.col("cid"), F.col("clause_number"), F.col("point_code"),
    )
    rows = articles.unionByName(clause_rows).unionByName(point_rows)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("article", "clause", "point")))
    holders = rows.groupBy("doc_id", F.col("temp_id").alias("parent_temp_id")).agg(F.max("seq").alias("parent_seq"))
    out = rows.join(holders, ["doc_id", "parent_temp_id"], "left")
    return out.select("doc_id", "seq", "parent_seq", "provision_level", "article_number", "clause_number", "point_code", "heading", "content", "citation_label", "sort_key", "context.part", "context.chapter", "context.section")


def legal_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, section_title, content): preambles, articles, clauses and points with their context lines.

    Documents without any heading or article give none.
    """
    rows = outline_rows(lines(docs, repair=False), Grammar(clause_digits=3))
    by_doc = Window.partitionBy("doc_id")
    in_article = Window.partitionBy("doc_id", "article")
    in_clause = Window.partitionBy("doc_id", "article", "clause")
    head = F.col("kind").isin("part", "chapter", "section")
    rows = rows.withColumn("structured", F.max(head | F.col("opens")).over(by_doc)).where(F.col("structured") & ~head)
    rows = rows.withColumn("article_heading", F.max(F.when(F.col("opens"), F.col("heading"))).over(in_article)).withColumn("clause_heading", F.max(F.when(F.col("starts_clause"), F.col("seg"))).over(in_clause))
    rows = rows.withColumn("ref", F.max(F.when(F.col("opens"), F.when(F.col("kind") == "article", F.concat(F.lit("Điều "), F.col("number"))).otherwise(F.concat("number", F.lit("."))))).over(in_article))
    # the heading line belongs to the article's own unit, a clause's line to the clause's unit
    rows = rows.withColumn("unit_text", F.when(F.col("opens"), F.col("article_heading")).otherwise(F.col("seg")))
    units = rows.groupBy("doc_id", F.when(F.col("article") == 0, F.col("region")).alias("region"), "article", "clause", "point").agg(
        F.min("pos").alias("pos"), _joined("body", F.lit(True), F.col("unit_text")), F.count("*").alias("n"), F.first("article_heading").alias("article_heading"), F.first("clause_heading").alias("clause_heading"),
        F.first("ref").alias("ref"), F.min(F.struct("pos", "part", "chapter", "section", "seg")).alias("c"), F.max(F.when(F.col("starts_point"), F.regexp_extract("seg", POINT, 2))).alias("point_code"),
    )
    more = units.groupBy("doc_id", "article").agg(F.max("clause").alias("clauses")).where("article > 0")
    deeper = units.where("clause > 0").groupBy("doc_id", "article", "clause").agg(F.max("point").alias("points"))
    units = units.join(more, ["doc_id", "article"], "left").join(deeper, ["doc_id", "article", "clause"], "left")
    # headings alone make no unit where something below them does
    only_heading = (F.col("n") == 1) & ((F.col("article") > 0) & (F.col("clause") == 0) & (F.col("clauses") > 0) | (F.col("clause") > 0) & (F.col("point") == 0) & (F.col("points") > 0))
    units = units.where(~F.coalesce(only_heading, F.lit(False)))
    context = F.array_compact(F.array("c.part", "c.chapter", "c.section"))
    clause_title = F.concat("ref", F.lit(" | Khoản "), F.coalesce(clause_number(F.col("clause_heading")), F.lit("?")))
    preamble = F.when(F.size(context) > 0, F.array_join(context, " | ")).otherwise(F.col("c.seg"))
    title = F.when(F.col("article") == 0, preamble).when(F.col("clause") == 0, F.col("article_heading")).when(F.col("point") == 0, clause_title).otherwise(F.concat(clause_title, F.lit(" | Điểm "), "point_code"))
    prefix = F.when(F.col("clause") == 0, context).when(F.col("point") == 0, F.concat(context, F.array("article_heading"))).otherwise(F.concat(context, F.array("article_heading", "clause_heading")))
    content = F.array_join(F.concat(prefix, F.array("body")), "\n")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return units.select("doc_id", index.alias("chunk_index"), F.substring(title, 1, 255).alias("section_title"), content.alias("content"))


def _upper(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


_RUNS = ArrayType(StructType([StructField("start", IntegerType()), StructField("n", IntegerType())]))


@F.pandas_udf(_RUNS)
def _packed(words: pd.Series, borders: pd.Series, most: pd.Series, target: pd.Series) -> pd.Series:
    """Runs of pieces that make chunks, in one pass over their numbers of words; each begins with the last piece before."""
    out = []
    for counts, marks, limit, enough in zip(words, borders, most, target):
        runs, start, total, last = [], 0, 0, 0
        for i, (n, border) in enumerate(zip(counts.tolist(), marks.tolist())):
            if i and (total + n > limit or total >= enough and border):
                runs.append((start, i - start))
                start, total = i - 1, last
            total, last = total + n, n
        runs.append((start, len(counts) - start))
        out.append([{"start": a, "n": n} for a, n in runs])
    return pd.Series(out)


def _pieces(segments: Column, max_words: int) -> Column:
    """Lines of at most ``max_words`` words: longer ones are cut at sentence ends, then by words."""
    count = lambda x: F.size(F.split(x, " "))
    sentences = lambda x: F.filter(F.transform(F.split(x, r"(?<=[\.!?;:])\s+"), collapse), lambda s: s != "")
    steps = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / max_words).cast("int"))
    blocks = lambda x: F.transform(F.array(F.split(x, " ")), lambda t: F.transform(steps(F.size(t)), lambda i: F.array_join(F.slice(t, i * max_words + 1, F.lit(max_words)), " ")))[0]
    cut = lambda x: F.when(count(x) <= max_words, F.array(x)).otherwise(blocks(x))
    long = lambda x: F.flatten(F.transform(sentences(x), cut))
    return F.flatten(F.transform(segments, lambda x: F.when(count(x) <= max_words, F.array(x)).otherwise(long(x))))


def fallback_chunks(docs: DataFrame, max_words: int = 320, target_words: int = 220) -> DataFrame:
    """(doc_id, chunk_index, section_title, content) of texts without structure.

    Long lines are cut at sentence ends, long sentences by words; pieces are packed up to
    ``max_words``, or to ``target_words`` where a line looks like a border, and each chunk
    repeats the last piece of the one before.  A document is one row throughout, nothing is shuffled; only the
    pieces' numbers of words and borders go to Python, which answers with the places to cut.
    """
    grammar = Grammar(clause_digits=3)
    # a test of the text, since one of its pieces would cut it a second time
    written = docs.where(F.col("text").rlike(r"(?U)[^\s\x1C-\x1E]"))
    rows = written.select("doc_id", _pieces(text_segments(F.col("text")), max_words).alias("pieces"))
    # cheap tests first: most lines are no border
    border = lambda x: F.endswith(x, F.lit(":")) | (F.length(x) <= TITLE_CHARS) & _upper(x) | x.rlike(POINT) | x.rlike(PART) | x.rlike(CHAPTER) | x.rlike(SECTION) | x.rlike(ARTICLE) | grammar.clause(x)
    rows = rows.withColumns({"words": F.transform("pieces", lambda x: F.size(F.split(x, " "))), "borders": F.transform("pieces", border)})
    rows = rows.withColumn("runs", _packed("words", "borders", F.lit(max_words), F.lit(target_words)))
    chunks = F.transform("runs", lambda r: F.array_join(F.slice(F.col("pieces"), r["start"] + 1, r["n"]), "\n"))
    out = rows.select("doc_id", F.posexplode(chunks).alias("at", "content"))
    first = F.trim(F.substring_index("content", ".", 1))
    return out.select("doc_id", (F.col("at") + 1).alias("chunk_index"), F.when(F.length(first) >= 12, F.substring(first, 1, 120)).alias("section_title"), "content")


_BREAKS = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
_BLANK = rf"[\s&&[^{_BREAKS}]]"
# the beginnings of PART, CHAPTER, SECTION, ARTICLE, ROMAN and OUTLINE in one pattern, so that a text is read once
_STRUCTURE = (
    rf"(?iU)(?:^|[{_BREAKS}]){_BLANK}*(?:(?:PHẦN|Phan|han|Chương|Chuong|huong|Mục|Muc|uc){_BLANK}+[^\s]|(?:Điều|Dieu|ieu){_BLANK}+[0-9]|[IVXLC]+\.|[0-9]{{1,3}}[.\-:])"
)


def is_structured(text: Column) -> Column:
    """Some line of the text is a heading, an article or a numbered outline; the first of these opens a unit."""
    return text.rlike(_STRUCTURE)


def build_chunks(docs: DataFrame) -> DataFrame:
    """Structured chunks where a document has structure, fallback chunks elsewhere."""
    rows = docs.withColumn("structured", F.coalesce(is_structured(F.col("text")), F.lit(False)))
    legal = legal_chunks(rows.where("structured").drop("structured"))
    rest = rows.where("not structured").drop("structured")
    return legal.withColumn("strategy", F.lit("legal")).unionByName(fallback_chunks(rest).withColumn("strategy", F.lit("fallback")))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds chunk_type, the three numbers, citation_label, hierarchy_path and token_count."""
    grammar = Grammar(clause_digits=3)
    rows = F.filter(F.transform(F.split("content", LINE_BREAK), F.trim), lambda s: s != "")
    first = lambda test: F.get(F.filter(F.col("rows"), test), F.lit(0))
    heads = F.filter(F.col("rows"), lambda x: x.rlike(PART) | x.rlike(CHAPTER) | x.rlike(SECTION))
    out = chunks.withColumn("rows", rows).withColumn("heads", heads)
    out = out.withColumn("article_number", F.regexp_extract(first(lambda x: x.rlike(ARTICLE)), ARTICLE, 2)).withColumn("clause_number", clause_number(first(grammar.clause))).withColumn("point_number", F.regexp_extract(first(lambda x: x.rlike(POINT)), POINT, 2))
    kind = F.when(F.col("point_number").isNotNull(), "point").when(F.col("clause_number").isNotNull(), "clause").when(F.col("article_number").isNotNull(), "article").otherwise("preamble")
    label = F.concat_ws(" ", F.concat(F.lit("Điều "), "article_number"), F.concat(F.lit("Khoản "), "clause_number"), F.concat(F.lit("Điểm "), "point_number"))
    numbers = F.array_compact(F.array(F.concat(F.lit("dieu-"), F.lower("article_number")), F.concat(F.lit("khoan-"), F.lower("clause_number")), F.concat(F.lit("diem-"), F.lower("point_number"))))
    path = F.array_join(F.filter(F.concat(F.transform("heads", slug), numbers), lambda s: s != ""), "/")
    out = out.withColumn("chunk_type", kind).withColumn("citation_label", F.substring(F.coalesce(F.nullif(label, F.lit("")), F.col("section_title"), F.lit("Preamble")), 1, 255))
    out = out.withColumn("hierarchy_path", F.substring(F.coalesce(F.nullif(path, F.lit("")), slug(F.coalesce("section_title", F.lit("preamble")))), 1, 1000))
    return out.withColumn("token_count", F.size(F.filter(F.split(F.trim("content"), r"(?U)\s+"), lambda w: w != ""))).drop("rows", "heads")


def structure_diagnostics(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Counts per level, score, label and status of each document."""
    level = lambda name: F.count_if(F.col("provision_level") == name).alias(f"{name}_count")
    counts = provisions.groupBy("doc_id").agg(level("article"), level("clause"), level("point"), F.count("*").alias("provision_count"))
    out = docs.select("doc_id", F.length(F.trim(F.coalesce("text", F.lit("")))).alias("chars")).join(counts, "doc_id", "left").na.fill(0)
    gain = lambda test, points: F.when(test, points).otherwise(0.0)
    a, c, p, n = (F.col(f"{x}_count") for x in ("article", "clause", "point", "provision"))
    score = F.when(F.col("chars") >= 1000, 20.0).when(F.col("chars") >= 300, 10.0).otherwise(0.0) + gain(a > 0, 35.0) + gain(c > 0, 20.0) + gain(p > 0, 10.0) + gain((n >= a) & (n > 0), 10.0) - gain((a == 0) & (F.col("chars") >= 500), 15.0)
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    label = F.when(F.col("score") >= 85, "high").when(F.col("score") >= 60, "medium").when(F.col("score") > 0, "low").otherwise("missing")
    status = F.when(n == 0, "failed").when(a > 0, "parsed").otherwise("partial")
    return out.withColumn("label", label).withColumn("status", status)
