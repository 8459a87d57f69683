"""Markdown to HTML: a subset of blocks and inline marks, everything else escaped."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# The classes of the page that shows the result.
CODE_CLASS, TABLE_CLASS = "rag-code-block", "rag-table-wrap"

_FENCE = re.compile(r"\s*```([\w-]*)\s*")
_RULE = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*")
_HEADING = re.compile(r"(#{1,4})\s+(.+)")
_QUOTE = re.compile(r"\s*>\s?")
_ITEMS = {"u": re.compile(r"\s*[-*+]\s+(.+)"), "o": re.compile(r"\s*\d+[.)]\s+(.+)")}
#: Lines that no paragraph goes on with, beside those that begin another block.
_BREAKS = re.compile(r"\s*```|#{1,4}\s|\s*[-*+]\s|\s*\d+[.)]\s")
#: Blocks as patterns over one letter a line. A capital letter is a line with a bar, t one that begins a table.
_BLOCKS = re.compile(r"(?P<fence>[fgFG][^fF]*[fF]?)|(?P<table>[tT].[A-Z]*)|(?P<heading>[hH])|(?P<quote>[qQ]+)|(?P<ul>[uU]+)|(?P<ol>[oO]+)|(?P<blank>b+)|(?P<text>[xXvV][xX]*)")
_MARKS = re.compile(r"`([^`]+)`")
_STYLES = ((re.compile(r"\*\*([^*]+)\*\*"), "strong"), (re.compile(r"__([^_]+)__"), "strong"), (re.compile(r"\*([^*\n]+)\*"), "em"), (re.compile(r"_([^_\n]+)_"), "em"))


def _escaped(text: str) -> str:
    return html.escape(text).replace("&#x27;", "&#39;")


def inline(text: str) -> str:
    """Code, strong and emphasis of one line; marks inside code stand for themselves."""
    codes: list[str] = []

    def hold(m: re.Match) -> str:
        codes.append(f"<code>{_escaped(m[1])}</code>")
        return f"\0{len(codes) - 1}\0"

    out = _escaped(_MARKS.sub(hold, text.replace("\0", "")))
    for pattern, tag in _STYLES:
        out = pattern.sub(rf"<{tag}>\1</{tag}>", out)
    return re.sub("\0(\\d+)\0", lambda m: codes[int(m[1])], out)


def _letter(line: str, following: str) -> str:
    if not line.strip():
        return "b"
    if m := _FENCE.fullmatch(line):
        kind = "g" if m[1] else "f"
    elif "|" in line and _RULE.fullmatch(following):
        kind = "t"
    elif _HEADING.fullmatch(line):
        kind = "h"
    elif _QUOTE.match(line):
        kind = "q"
    else:
        kind = next((k for k, p in _ITEMS.items() if p.fullmatch(line)), "v" if _BREAKS.match(line) else "x")
    return kind.upper() if "|" in line else kind


def _cells(line: str) -> list[str]:
    return [inline(c.strip()) for c in re.sub(r"^\||\|$", "", line.strip()).split("|")]


def _row(line: str, tag: str) -> str:
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in _cells(line)) + "</tr>"


def _fence(lines: list[str]) -> str:
    closed = len(lines) > 1 and (m := _FENCE.fullmatch(lines[-1])) and not m[1]
    return f'<pre class="{CODE_CLASS}"><code>{_escaped("\n".join(lines[1 : -1 if closed else None]))}</code></pre>'


def _table(lines: list[str]) -> str:
    return f'<div class="{TABLE_CLASS}"><table><thead>{_row(lines[0], "th")}</thead><tbody>{"".join(_row(x, "td") for x in lines[2:])}</tbody></table></div>'


def _heading(lines: list[str]) -> str:
    marks, text = _HEADING.fullmatch(lines[0]).groups()
    return f"<h{len(marks) + 2}>{inline(text)}</h{len(marks) + 2}>"


def _list(kind: str) -> Callable[[list[str]], str]:
    return lambda lines: f"<{kind}l>" + "".join(f"<li>{inline(_ITEMS[kind].fullmatch(x)[1])}</li>" for x in lines) + f"</{kind}l>"


_RENDER: dict[str, Callable[[list[str]], str]] = {
    "fence": _fence,
    "table": _table,
    "heading": _heading,
    "quote": lambda lines: f"<blockquote>{'<br>'.join(inline(_QUOTE.sub('', x, count=1)) for x in lines)}</blockquote>",
    "ul": _list("u"),
    "ol": _list("o"),
    "blank": lambda lines: "",
    "text": lambda lines: f"<p>{'<br>'.join(inline(x.strip()) for x in lines)}</p>",
}


def rendered(markdown: str) -> str:
    """The HTML of one text: its lines as letters, the blocks as runs of letters."""
    lines = re.sub(r"\r\n?", "\n", markdown).split("\n")
    letters = "".join(map(_letter, lines, [*lines[1:], ""]))
    out, at = [], 0
    while at < len(letters):
        m = _BLOCKS.match(letters, at)
        out.append(_RENDER[m.lastgroup](lines[at : m.end()]))
        at = m.end()
    return "".join(out)


def _html(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(rendered, na_action="ignore").astype(object)


def html_of(markdown: Column) -> Column:
    """MD05: Markdown as HTML: fences (an unclosed one goes to the end), tables, headings one to four as three to six, quotes, lists, paragraphs.

    What a text holds as HTML is shown as text. Null counts as empty.
    """
    return F.pandas_udf(_html, "string")(F.coalesce(markdown, F.lit("")))
