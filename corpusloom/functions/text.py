"""String functions as Column expressions, so that they stay inside whole-stage code generation.

Python's ``\\w``, ``\\s`` and ``\\b`` know all of Unicode, Java's only ASCII; hence ``(?U)`` in the patterns.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question (accent-folded).
STOP_WORDS = [
    "cua", "cho", "co", "can", "cau", "duoc", "hay", "khi", "la", "lam", "nguoi", "nay", "neu", "nhung", "sau", "tai", "thi", "the", "theo", "toi", "tren", "va", "voi",
]

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _fold_pairs() -> tuple[str, str]:
    """Lower-case letters with marks, and the letters below the marks."""
    pairs = {}
    for a, b in ((0xC0, 0x24F), (0x1E00, 0x1EFF)):
        for c in map(chr, range(a, b + 1)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if c == c.lower() and base != c and len(base) == 1:
                pairs[c] = base
    pairs["đ"] = "d"
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_pairs()


def collapse(x: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fold(x: Column) -> Column:
    """Lower case without accents, white space collapsed."""
    plain = F.regexp_replace(F.translate(F.lower(x), FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")
    return collapse(plain)


def blank(x: Column) -> Column:
    return x.isNull() | (F.length(F.trim(x)) == 0)


def words(x: Column) -> Column:
    return F.filter(F.split(F.trim(x), r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def tokens(x: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of the folded text of three letters or more that are no stop words."""
    found = F.regexp_extract_all(fold(x), F.lit(r"(?U)(\w+)"), F.lit(1))
    stop = F.array(*map(F.lit, stop_words)).cast("array<string>")
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def excerpt(x: Column, n: int = 320) -> Column:
    c = collapse(x)
    return F.concat(F.rtrim(F.substring(c, 1, n)), F.when(F.length(c) > n, "...").otherwise(""))


def summary(x: Column, n: int = 320) -> Column:
    return F.substring(collapse(x), 1, n)


def slug(x: Column, n: int = 120) -> Column:
    """Path component: folded, other runs than a-z and 0-9 become a hyphen."""
    return F.substring(F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n)


def ascii_slug(x: Column) -> Column:
    """As ``slug``, but letters that do not decompose (such as đ) are dropped, not folded."""
    source = "".join(c for c in FOLD_FROM if c != "đ")
    target = "".join(b for a, b in zip(FOLD_FROM, FOLD_TO) if a != "đ")
    plain = F.regexp_replace(F.translate(F.lower(x), source, target), r"[^\x00-\x7F]+", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def nullable(x: Column) -> Column:
    """White space collapsed; empty is null."""
    return F.nullif(collapse(x), F.lit(""))


def sentence_case(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def file_base(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"(?<=[.!?。])\s+|\n+"), F.trim), lambda s: s != "")


def segments(x: Column) -> Column:
    """Lines with white space collapsed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), LINE_BREAK), collapse), lambda s: s != "")


MARK = "\x01"


def marked(x: Column) -> Column:
    """Text with a mark on both sides of every word and of every other character.

    Whole words and phrases are then plain substrings, which is far cheaper than a pattern per needle.
    """
    return F.concat(F.lit(MARK), F.regexp_replace(x, r"(?U)(\W)", f"{MARK}$1{MARK}"), F.lit(MARK))


def whole_word_count(text: Column, needle: Column) -> Column:
    """Occurrences, without overlap, of a word or phrase in marked text."""
    wanted = marked(needle)
    found = F.length(text) - F.length(F.replace(text, wanted, F.lit("")))
    return F.when(needle == "", 0).otherwise((found / F.length(wanted)).cast("int"))


def digits_padded(x: Column, n: int = 3) -> Column:
    """Digits filled with zeros to n; without digits the first n letters in upper case."""
    d = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")
    fill = F.when(F.length(d) >= n, d).otherwise(F.lpad(d, n, "0"))
    return F.when(d != "", fill).otherwise(F.lpad(F.upper(F.substring(F.coalesce(x, F.lit("")), 1, n)), n, "0"))


def clean_title(x: Column) -> Column:
    """Without a trailing bracketed note."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s*\[[^\]]+\]\s*$", "")), F.lit(""))


_ASCII_FROM = "".join(c for c in FOLD_FROM if c != "đ")
_ASCII_TO = "".join(b for a, b in zip(FOLD_FROM, FOLD_TO) if a != "đ")


def ascii_upper(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.translate(F.lower(x), _ASCII_FROM, _ASCII_TO)), r"[^\x00-\x7F]+", "")


def document_code(x: Column) -> Column:
    """``number/year/SUFFIX`` where there is one, else the cleaned text in upper case."""
    up = ascii_upper(x)
    canonical = r"(?<!\d)(\d{1,4})\s*/\s*(\d{4})\s*/\s*([A-Z]{1,16}[A-Z0-9]*(?:[ ._-]+[A-Z]{1,16}[A-Z0-9]*)*)(?![A-Z0-9])"
    suffix = F.array_join(F.regexp_extract_all(F.regexp_extract(up, canonical, 3), F.lit("[A-Z0-9]+"), F.lit(0)), "-")
    made = F.concat_ws("/", F.regexp_extract(up, canonical, 1), F.regexp_extract(up, canonical, 2), suffix)
    loose = F.regexp_replace(F.regexp_replace(up, "[^A-Za-z0-9/._ -]+", " "), r"\s+", " ")
    loose = F.regexp_replace(loose, r"^[ ./_-]+|[ ./_-]+$", "")
    return F.when(up.rlike(canonical), made).otherwise(F.replace(F.replace(loose, F.lit("."), F.lit("")), F.lit("--"), F.lit("-")))


def file_code(file_name: Column) -> Column:
    """Document code that a file name spells with blanks, dots, hyphens or underscores."""
    stem = ascii_upper(F.regexp_replace(file_base(file_name), r"\.[^.]*$", ""))
    pattern = r"(?<!\d)(\d{1,4})[\s._-]+(\d{4})[\s._-]+([A-Z]{1,16}[A-Z0-9]*(?:[\s._-]+[A-Z]{1,16}[A-Z0-9]*)*)(?![A-Z0-9])"
    code = F.concat_ws("/", *(F.regexp_extract(stem, pattern, i) for i in (1, 2, 3)))
    return F.when(stem.rlike(pattern), document_code(code))


def code_aliases(code: Column, file_name: Column) -> Column:
    both = F.array(F.when(~blank(code), document_code(code)), file_code(file_name))
    return F.array_distinct(F.filter(both, lambda c: c.isNotNull() & (c != "")))


def years(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"((?:19|20)\d{2})"), F.lit(1))


def contains_any(x: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(x, F.lit(n))
    return out


def first_hit(x: Column, table, default: str) -> Column:
    """Value of the first (needle, value) of an ordered table whose needle the text contains."""
    out = None
    for needle, value in table:
        hit = F.contains(x, F.lit(needle))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def codes_that_hold(*tests: tuple[Column, str]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, name) for test, name in tests)))
