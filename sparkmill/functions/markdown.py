"""Clean-up of converted documents, line by line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


# What marks a line of an index, a page number at its end, and the title of a section.
DOTS = r"[.\·•·∙⋅··…]"
INDEX_LINE = rf"^\s*\d*(\.\d+)*\s*[^\d{DOTS}]+?\s{DOTS}{{4,}}\s*\d{{1,4}}\s*$"
TRAILING_PAGE = rf"{DOTS}{{3,}}\s*\d{{1,4}}\s*$"
NUMBERED_TITLE = r"^\d+(\.\d+)*\s+[A-ZÁÉÍÓÚÑ0-9].{2,}$"
NAMED_TITLE = r"(?iU)^(CAP[IÍ]TULO|ANEXO|AP[EÉ]NDICE)\b"
CAPITALS_TITLE = r"^[A-ZÁÉÍÓÚÑ0-9][A-ZÁÉÍÓÚÑ0-9\s\-–,:;.()]{4,}$"


def looks_like_heading(line: Column) -> Column:
    """CHK09: a line of at most 120 characters that is numbered, names a chapter or an annex, or has several words in capitals; no line of an index."""
    text = strip(line)
    title = text.rlike(NUMBERED_TITLE) | text.rlike(NAMED_TITLE) | (text.rlike(CAPITALS_TITLE) & text.contains(" "))
    return F.when(F.length(text) > 120, False).otherwise(title & ~text.rlike(INDEX_LINE) & ~text.rlike(TRAILING_PAGE))


def lines(c: Column) -> Column:
    """Lines; a line break at the end ends the last one, it begins no other."""
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\R\z", ""), r"\R", -1)


def clean_lines(c: Column) -> Column:
    """CHK01: lines without white space at their ends, blank ones dropped."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def without_dot_leaders(c: Column) -> Column:
    """MD01: lines of dots are dropped; dots between a title and its page number become a space."""

    def one(line: Column) -> Column:
        found = line.rlike(r"\.{3,}\s*\d")
        left = strip(F.regexp_extract(line, r"^((?:.*[^.])?)\.{3,}\s*(\d.*)$", 1))
        right = strip(F.regexp_extract(line, r"^((?:.*[^.])?)\.{3,}\s*(\d.*)$", 2))
        return F.when(found, strip(F.concat(left, F.lit(" "), right))).otherwise(line)

    kept = F.filter(lines(c), lambda x: ~F.coalesce(strip(x).rlike(r"^\.+$"), F.lit(False)))
    return F.array_join(F.transform(kept, one), "\n")


def upper_ratio(line: Column) -> Column:
    """Share of the letters that are upper case; 0 without letters."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def is_upper(line: Column) -> Column:
    """MD03: at least seven tenths of the letters are upper case."""
    return upper_ratio(line) >= 0.7


def with_headings(c: Column) -> Column:
    """MD02: numbered titles become headings by the depth of their number.

    A marker ends with a dot and white space follows it: one number (its title mostly upper case), two, three, each of
    one or two digits, or a capital letter with any numbers. Indented lines, lists, quotes, tables and headings stay.
    """

    def one(line: Column) -> Column:
        text = strip(line)
        marker, title = (F.regexp_extract(text, r"^(\S+)\s+(\S.*)$", i) for i in (1, 2))
        marks = (
            F.when(marker.rlike(r"^\d{1,2}\.$") & is_upper(title), "# ")
            .when(marker.rlike(r"^(\d{1,2}\.){2}$"), "## ")
            .when(marker.rlike(r"^(\d{1,2}\.){3}$") | marker.rlike(r"^\p{Lu}\.(\d+\.)+$"), "### ")
        )
        stays = line.rlike(r"^[ \t\-*>|<]") | text.startswith("#") | (text == "")
        return F.when(stays | marks.isNull(), line).otherwise(F.concat(marks, marker, F.lit(" "), title))

    return F.array_join(F.transform(lines(c), one), "\n")


def joined_pages(pages: Column) -> Column:
    """MD04: (number, text) pages in order, empty ones left out."""
    return F.array_join(F.filter(F.transform(F.array_sort(pages), lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")


def fitted_size(width: Column, height: Column, most: int = 1600) -> Column:
    """MD06: (width, height) with the longer side at most ``most``."""
    longest = F.greatest(width, height)
    scale = F.when(longest > most, most / longest).otherwise(F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale)).alias("width"), F.greatest(F.lit(1), F.floor(height * scale)).alias("height"))
