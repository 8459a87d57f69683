"""Web pages: title, links, label tables and licences of their rows as column expressions over raw HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkmill.functions.text import squeeze, strip


def plain(c: Column) -> Column:
    """Text of a fragment: scripts, styles, comments and tags dropped, the commonest entities read, spaces squeezed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return squeeze(c)


def title(html: Column) -> Column:
    """SRC06: the text of the title, null without one."""
    return F.nullif(plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def hrefs(html: Column) -> Column:
    """SRC08, GEN02: targets of all links in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'<a [^>]*href="([^"]*)"'), 1)


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page: whole addresses stay, paths from the root are put behind the page's host."""
    host = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    return F.when(link.rlike(r"^[a-z]+://"), link).when(F.startswith(link, F.lit("/")), F.concat(host, link)).otherwise(F.concat(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", ""), link))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, at, link): a row for each link of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("at", "href"))
    return rows.select("page_id", "at", absolute(F.col("url"), F.col("href")).alias("link"))


def label_values(html: Column) -> Column:
    """SRC07: a map of the cells that follow a heading cell or term."""
    cells = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:th|dt)[^>]*>(.*?)</(?:th|dt)>\s*<(?:td|dd)[^>]*>.*?</(?:td|dd)>"), 0)
    pair = F.transform(cells, lambda x: F.struct(plain(F.regexp_extract(x, r"(?is)<(?:th|dt)[^>]*>(.*?)</(?:th|dt)>", 1)).alias("k"), plain(F.regexp_extract(x, r"(?is)<(?:td|dd)[^>]*>(.*?)</(?:td|dd)>", 1)).alias("v")))
    return F.map_from_entries(F.filter(pair, lambda p: strip(p["k"]) != ""))


# Ids of the tender pages' fields and of their table of documents. Fixed values.
HEAD_SPANS = {"organ_id": ":form1:text_IdOrganoContratacion", "unit": ":form1:text_UbicacionOrganica", "number": ":form1:text_Expediente", "object": ":form1:text_ObjetoContrato"}
HEAD_LINKS = {"organ_url": ":URLOrganoContratacion", "link": ":form1:link_EnlaceLicPLACE"}
DOCUMENTS_TABLE = "myTablaDetalleVISUOE"


def _text(html: Column) -> Column:
    return F.nullif(plain(html), F.lit(""))


def _target(base: Column, href: Column) -> Column:
    """A link's address; null for none and for one to the page itself."""
    return F.when((href != "") & (href != "#"), absolute(base, href))


def head_fields(base: Column, html: Column) -> Column:
    """SRC06: organ_url, organ_id, unit, number, object and link of a tender page's head table, null where they are missing or blank."""
    spans = [_text(F.regexp_extract(html, rf'(?is)<span\b[^>]*\bid="[^"]*{i}[^"]*"[^>]*>(.*?)</span>', 1)).alias(name) for name, i in HEAD_SPANS.items()]
    links_ = [_target(base, F.regexp_extract(F.regexp_extract(html, rf'(?is)<a\b[^>]*\bid="[^"]*{i}[^"]*"[^>]*>', 0), r'(?i)\bhref="([^"]*)"', 1)).alias(name) for name, i in HEAD_LINKS.items()]
    return F.struct(*spans, *links_)


def document_rows(pages: DataFrame) -> DataFrame:
    """SRC08, GEN02: rows of the table of documents of pages (page_id, url, html) that hold anything.

    page_id, at, published, document, urls (joined by bars), doue_sent, doue_url (that of the last link) and doue_date
    (its text; without a link that of the output span).
    """
    table = F.regexp_extract("html", rf'(?is)<table\b[^>]*\bid="{DOCUMENTS_TABLE}"[^>]*>(.*?)</table>', 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    out = pages.select("page_id", "url", F.posexplode(rows).alias("at", "row"))
    out = out.withColumn("cells", F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    found = F.filter(F.transform(hrefs(cell(2)), lambda h: _target(F.col("url"), h)), lambda h: h.isNotNull())
    last = F.regexp_extract(cell(3), r'(?is).*(<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>)', 1)
    sent = _text(F.regexp_extract(cell(3), r'(?is)class="[^"]*\bflex\b[^"]*"[^>]*>.*?<span\b[^>]*>(.*?)</span>', 1))
    shown = F.regexp_extract(cell(3), r'(?is)<span\b[^>]*class="[^"]*\boutputText\b[^"]*"[^>]*>(.*?)</span>', 1)
    out = out.select(
        "page_id",
        "at",
        _text(cell(0)).alias("published"),
        _text(cell(1)).alias("document"),
        F.nullif(F.array_join(found, " | "), F.lit("")).alias("urls"),
        sent.alias("doue_sent"),
        _target(F.col("url"), F.regexp_extract(last, r'(?i)\bhref="([^"]*)"', 1)).alias("doue_url"),
        F.when(last != "", _text(last)).otherwise(_text(shown)).alias("doue_date"),
    )
    return out.where(F.coalesce("published", "document", "urls", "doue_sent", "doue_url", "doue_date").isNotNull())


#: Texts of the links to a tender's two specifications. Fixed values.
LINK_LABELS = ("Pliego Prescripciones Técnicas", "Pliego Cláusulas Administrativas")


def labelled_links(pages: DataFrame, labels: tuple[str, ...] = LINK_LABELS) -> DataFrame:
    """GEN02: (page_id, label, link) of pages (page_id, html): for each label the first link whose text holds it, in any case.

    A label without such a link, and one whose first link has no address, has no row; the address is as it stands.
    """
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), 1)
    rows = pages.select("page_id", F.explode(F.array(*map(F.lit, labels))).alias("label"), anchors.alias("anchors"))
    first = F.get(F.filter("anchors", lambda a: F.contains(F.lower(plain(a)), F.lower("label"))), F.lit(0))
    link = F.regexp_extract(F.regexp_extract(first, r"(?is)^<a\b[^>]*>", 0), r'(?i)\bhref="([^"]*)"', 1)
    return rows.select("page_id", "label", link.alias("link")).where("link != ''")


def with_publication(rows: DataFrame) -> DataFrame:
    """2.12j: rows (number, publication) with a number and the address of a publication abroad, trimmed; blank and ``vacío`` are none."""
    said = strip(F.col("publication"))
    none = F.coalesce(F.lower(said), F.lit("")).isin("", "vacío", "vacio")
    return rows.where((F.coalesce("number", F.lit("")) != "") & ~none).withColumn("publication", said)
