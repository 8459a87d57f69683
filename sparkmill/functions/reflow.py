"""Converted text to Markdown: lines joined to paragraphs, titles that depend on the next line, index entries as links.

All are column expressions over whole texts. Work within a text is one pass over arrays of its lines; patterns are
possessive or begin at a fixed place, so a very long line or run costs no more than its length. Null counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .markdown import is_upper, lines

# Bullets of converted files, the letters of a title in capitals, and those of an anchor.
BULLETS = "•◦·▪▫●"
CAPITALS = r"^[A-ZÁÉÍÓÚÜÑ0-9 .,:;/()\-]{8,}$"
NOT_IN_ANCHOR = r"[^a-z0-9áéíóúñü ]+"
#: Lines among which the main title is looked for. Fixed value.
MAIN_WITHIN = 15
#: White space of any kind.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_WORD = r"[\p{L}\p{N}_]"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reflowed(c: Column) -> Column:
    """2.12a: no bullets, words cut by a hyphen at a line's end joined, single breaks to spaces, longer runs to one blank line.

    A word that is cut twice is joined once, as its second part has been used.
    """
    c = F.translate(F.coalesce(c, F.lit("")), BULLETS, "")
    c = F.regexp_replace(c, rf"(?<!{_WORD})({_WORD}++)-\n({_WORD}++)", "$1$2")
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?<![ \t])[ \t]++\n", "\n")


def slug(title: Column) -> Column:
    """2.12c: the anchor of a title: lower case, other characters dropped, spaces to hyphens."""
    return F.replace(_strip(F.regexp_replace(F.lower(title), NOT_IN_ANCHOR, "")), F.lit(" "), F.lit("-"))


def index_title(line: Column) -> Column:
    """2.12d: the title of a line of an index, which ends with five dots or more and a page number; else null."""

    def of(text: Column, tail: Column) -> Column:
        before = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        short = F.regexp_replace(before, r"(?U)\s\z", "")
        return F.when((tail != "") & (before != ""), short).when(tail.startswith("......"), ".")

    found = lambda text: _let(F.regexp_extract(text, r"(?U)(?<!\.)\.{5,}+\s?+\d++\z", 0), lambda tail: of(text, tail))
    return F.when(F.contains(line, F.lit(".....")), _let(_strip(line), found))


def with_index_links(c: Column) -> Column:
    """2.12d: lines of an index as links to the anchors of their titles."""

    def one(line: Column) -> Column:
        return _let(index_title(line), lambda title: F.when(title.isNull(), line).otherwise(F.concat(F.lit("- ["), title, F.lit("](#"), slug(title), F.lit(")"))))

    return F.array_join(F.transform(lines(c), one), "\n")


def _numbers(token: Column) -> Column:
    """Whether a text of digits and dots has no empty number."""
    return ~F.contains(token, F.lit(".."))


def _kind(line: Column, following: Column) -> Column:
    """One letter: B blank, H a heading already, 1 a number whose title follows, E a numbered title, T one in capitals, X other.

    ``following`` is null after the last line.
    """
    return _let(_strip(line), lambda text: _kind_of(text, following))


def _kind_of(text: Column, following: Column) -> Column:
    after = _strip(following)
    number = text.rlike(r"^[IVXLCDM]+\.$") | text.rlike(r"^\p{Nd}+\.$") | (text.rlike(r"^[A-Z]\.\p{Nd}[\p{Nd}.]*\.$") & _numbers(text))
    several = text.rlike(r"^\p{Nd}[\p{Nd}.]*$") & text.rlike(r"\.\p{Nd}") & _numbers(text)
    subtitle = F.regexp_extract(text, r"(?U)^(\p{Nd}[\p{Nd}.]*\.)\s", 1)
    return (
        F.when(text == "", "B")
        .when(text.startswith("#"), "H")
        .when(following.isNotNull() & ((number & after.rlike(CAPITALS)) | several), "1")
        .when((subtitle != "") & _numbers(subtitle), "E")
        .when(text.rlike(CAPITALS), "T")
        .otherwise("X")
    )


def _marked(c: Column) -> Column:
    """Per line (line, following, mark): as :func:`_kind`, S for a number that takes the next line, C for that line, M for the main title."""

    def paired(all_: Column) -> Column:
        return F.zip_with(all_, F.slice(all_, F.lit(2), F.size(all_)), lambda line, following: F.struct(line.alias("line"), following.alias("following")))

    def marked(pairs: Column) -> Column:
        kinds = F.array_join(F.transform(pairs, lambda p: _kind(p["line"], p["following"])), "")
        # from left to right, what takes the next line hides what that would be
        marks = F.regexp_replace(F.regexp_replace(kinds, "1.", "SC"), rf"^([^T]{{0,{MAIN_WITHIN - 1}}}+)T", "$1M")
        return F.zip_with(pairs, F.regexp_extract_all(marks, F.lit("."), F.lit(0)), lambda p, m: F.struct(p["line"].alias("line"), p["following"].alias("following"), m.alias("mark")))

    return _let(_let(lines(c), paired), marked)


def title_levels(c: Column) -> Column:
    """2.12b: an array of (at, level, title): the headings that :func:`with_titles` makes, by line."""

    def one(p: Column, at: Column) -> Column:
        text, mark = _strip(p["line"]), p["mark"]
        numbered = F.concat(F.rtrim(text, F.lit(".")), F.lit(". "), _strip(p["following"]))
        level = F.when(mark == "M", 1).when(mark.isin("S", "T"), 2).when(mark == "E", 3)
        return F.struct(at.alias("at"), level.alias("level"), F.when(mark == "S", numbered).otherwise(text).alias("title"))

    return F.filter(F.transform(_marked(c), one), lambda x: x["level"].isNotNull())


def with_titles(c: Column) -> Column:
    """2.12b: numbers that stand alone with the title on the next line, numbered titles and lines in capitals as headings.

    The first line in capitals among the first ``MAIN_WITHIN`` lines is the main title. A number of several parts takes
    the next line whatever it is; others only one in capitals. A line that was taken is nothing else.
    """

    def one(p: Column) -> Column:
        text, mark = _strip(p["line"]), p["mark"]
        numbered = F.concat(F.lit("\n## "), F.rtrim(text, F.lit(".")), F.lit(". "), _strip(p["following"]), F.lit("\n"))
        return (
            F.when(mark == "S", numbered)
            .when(mark == "E", F.concat(F.lit("### "), text))
            .when(mark == "M", F.concat(F.lit("\n# "), text, F.lit("\n")))
            .when(mark == "T", F.concat(F.lit("\n## "), text, F.lit("\n")))
            .when(mark != "C", p["line"])
        )

    return F.array_join(F.filter(F.transform(_marked(c), one), lambda x: x.isNotNull()), "\n")


def processed(c: Column) -> Column:
    """2.12a: the whole clean-up of a converted text: re-flow, links of the index, titles; an empty text stays empty."""
    return with_titles(with_index_links(reflowed(c)))


def numbered_heading(line: Column) -> Column:
    """2.12e: (level, title) of a numbered line; null for any other.

    One number needs a title in capitals; more give their count as level, a letter and numbers one more than the
    numbers, at most 6.
    """
    text = _strip(line)
    digits = F.regexp_extract(text, r"(?U)^(\p{Nd}[\p{Nd}.]*)\s+.", 1)
    lettered = F.regexp_extract(text, r"(?U)^([A-ZÁÉÍÓÚÜÑ]\.\p{Nd}[\p{Nd}.]*)\s+.", 1)

    def found(token: Column, parts: Column) -> Column:
        title = _strip(F.substring(text, F.length(token) + 1, F.length(text)))
        clean = F.rtrim(token, F.lit("."))
        return F.struct(F.least(F.lit(6), parts(clean)).alias("level"), F.concat(clean, F.lit(". "), title).alias("title")), title

    dots = lambda t: F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    plain, title = found(digits, lambda t: dots(t) + 1)
    letter, _ = found(lettered, lambda t: dots(t) + 1)
    long = F.length(text) >= 3
    return F.when(long & (digits != "") & _numbers(digits) & ((plain["level"] > 1) | is_upper(title)), plain).when(long & (digits == "") & (lettered != "") & _numbers(lettered), letter)


def plain_heading(line: Column) -> Column:
    """Whether a line without a number is a title: four characters or more, mostly capitals, no colon at its end."""
    text = _strip(line)
    return (F.length(text) >= 4) & ~text.endswith(":") & is_upper(text)


def with_bullet(line: Column) -> Column:
    """2.12f: a list item's marker as a hyphen; any other line as it is."""
    text = F.ltrim(line, F.lit(SPACES))
    marker = text.rlike(r"(?U)^[-*•·\x{F0D8}o]\s")
    return F.when(marker, F.concat(F.lit("- "), _strip(F.substring(text, F.lit(2), F.length(text))))).otherwise(line)


def markdown_of(c: Column) -> Column:
    """2.12g: plain text as Markdown, line by line: numbered titles, titles in capitals, list items; blank lines empty."""

    def one(line: Column) -> Column:
        heading = numbered_heading(line)
        return (
            F.when(_strip(line) == "", "")
            .when(heading.isNotNull(), F.concat(F.repeat(F.lit("#"), heading["level"]), F.lit(" "), heading["title"]))
            .when(plain_heading(line), F.concat(F.lit("# "), _strip(line)))
            .otherwise(with_bullet(line))
        )

    return F.array_join(F.transform(lines(c), one), "\n")


def without_first_dots(c: Column) -> Column:
    """2.12h: lines of dots dropped; the first run of dots before a number becomes a space, whatever follows the number."""

    def one(line: Column) -> Column:
        left = F.regexp_extract(line, r"(?U)^(.*?)(?<!\.)\.{3,}+(?=\s*+\d)", 1)
        found = F.regexp_extract(line, r"(?U)^.*?(?<!\.)\.{3,}+(?=\s*+\d)", 0)
        right = F.substring(line, F.length(found) + 1, F.length(line))
        return F.when(found != "", F.concat(_strip(left), F.lit(" "), _strip(right))).otherwise(line)

    only = lambda line: (_strip(line) != "") & (F.replace(_strip(line), F.lit("."), F.lit("")) == "")
    return F.array_join(F.transform(F.filter(lines(c), lambda x: ~only(x)), one), "\n")


def with_numbered_headings(c: Column) -> Column:
    """2.12i: numbered lines as headings by patterns: one to three numbers of at most two digits, or a capital letter and numbers.

    One number needs a title in capitals; after a letter's code a space and a title may be missing. Indented lines,
    lists, quotes, tables, HTML and headings stay.
    """

    def one(line: Column) -> Column:
        text = _strip(line)
        token, title = (F.regexp_extract(text, r"(?U)^((?:\p{Nd}{1,2}\.){1,3}+)\s+(.+)$", i) for i in (1, 2))
        depth = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
        first = F.concat(F.substring_index(text, "..", 1), F.when(F.contains(text, F.lit("..")), ".").otherwise(""))
        code = F.regexp_extract(first, r"^[A-Z]\.\p{Nd}[\p{Nd}.]*\.", 0)
        rest = _strip(F.substring(text, F.length(code) + 1, F.length(text)))
        stays = line.rlike(r"^[ \t\-*>|<]") | text.startswith("#") | (text == "")
        numbered = (token != "") & ((depth > 1) | is_upper(title))
        heading = F.when(numbered, F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), token, F.lit(" "), _strip(title)))
        heading = heading.when(code != "", F.concat(F.lit("### "), code, F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise("")))
        return F.when(stays, line).otherwise(F.coalesce(heading, line))

    return F.array_join(F.transform(lines(c), one), "\n")
