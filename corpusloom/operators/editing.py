"""Repairs of extracted text as an editor applies them, and of scanned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = r"^(?i)\s*(Điều|Dieu|Chương|Chuong|Mục|Muc|Phần|Phan|Khoản|Khoan|\d+\.|[a-zđ]\))"


def normalise_white_space(x: Column) -> Column:
    """Blanks and tabs of each line collapsed, three or more line feeds to two."""
    lines = F.transform(F.split(x, r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def drop_blank_lines(x: Column) -> Column:
    return F.array_join(F.filter(F.split(x, r"\r?\n"), lambda s: F.trim(s) != ""), "\n")


def join_broken_lines(x: Column) -> Column:
    """A line goes on from the one before unless either is blank or begins like a heading.

    A line that goes on is joined to one that is neither, so a joined line begins like a heading only if its
    last part's neighbour does, and each line is decided by itself and the one before.
    """
    lines = F.transform(F.split(x, r"\r?\n"), F.trim)
    stops = F.transform(lines, lambda s: (s == "") | s.rlike(_HEAD))
    mark = lambda i: F.when(F.get(stops, i) | F.get(stops, i - 1), "\n").otherwise(" ")
    return F.array_join(F.transform(lines, lambda s, i: F.concat(F.when(i == 0, "").otherwise(mark(i)), s)), "")


def split_headings(x: Column) -> Column:
    """Articles and numbered clauses inside a line begin a new one."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)[ \t]+(?=(?:Điều|Chương|Mục|Phần)\s+\d)", "\n"), r"[ \t]+(?=\d+\.\s+\p{Lu})", "\n")


def find_next(text: Column, needle: Column, start: Column) -> Column:
    """Position (from 1) of the next occurrence after ``start``, around the end; null if there is none."""
    low, n = F.lower(text), F.lower(needle)
    return F.nullif(F.coalesce(F.nullif(F.position(n, low, start), F.lit(0)), F.position(n, low)), F.lit(0))


def replace_all(text: Column, needle: str, by: str) -> Column:
    """Every occurrence of a literal, in any case."""
    import re

    quoted = r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.regexp_replace(text, "(?iu)" + quoted, re.sub(r"([\\$])", r"\\\1", by))


# Digits that scanning takes for letters.
CONFUSED = ("013457", "oieast")
# Folded syllables of statutes.
LEXICON = frozenset((
    "ap", "biet", "bo", "ca", "cap", "chi", "chinh", "chiu", "chuong", "co", "cua", "dac", "dai", "dat", "dieu", "diem", "dinh", "do", "doi", "doanh", "du", "dung", "giai",
    "hanh", "hieu", "hoi", "hop", "khoan", "kien", "luat", "luc", "muc", "nghia", "nghi", "ngu", "nguyen", "ngoai", "nhan", "noi", "nuoc", "phep", "pham", "phu", "quoc", "quyen", "quy", "tai",
    "tac", "thich", "thi", "thong", "tiet", "to", "truong", "tu", "tuong", "van", "vi", "vu", "xet",
))


def unconfused(x: Column) -> Column:
    return F.translate(x, *CONFUSED)


# What a line of a scanned statute begins with.
_LETTER = "[A-ZĐÀÁẢÃẠĂÂa-zđ]"
SCANNED_STARTS = (
    r"(?:PHẦN|Phần|Phan|Chương|Chuong|Mục|Muc)\s+[A-Z0-9IVXLCĐđ]", r"(?:Điều|Dieu)\s+\d+[A-Za-z]*", rf"(?:Khoản|Khoan)\s+\d+\s+{_LETTER}", rf"\d+[\.:\-]\s+{_LETTER}", rf"[a-zđ][\)\.:\-]\s+{_LETTER}",
)


def scanned_lines(x: Column) -> Column:
    """Line breaks before headings, articles, clauses and points of a text that scanning has run together."""
    out = x
    for start in SCANNED_STARTS:
        out = F.regexp_replace(out, rf"(?iU)\s+(?={start})", "\n")
    return out
