"""Queries of converted texts: re-flow, titles, index anchors, plain text as Markdown, numbered headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkmill.functions import markdown as M, reflow as W
from sparkmill.operators import anchors
from sparkmill.sources import html as H


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: What stands in place of a document's i-th line, by (i + doc_id) % 17; every other line stays. x is the line.
_ODD = {
    0: "'II.'", 1: "'OBJETO DEL CONTRATO ' || i % 4", 2: "'1.' || i % 5 || '.'", 3: "i % 9 || '. ' || x", 4: "'Titulo ' || i % 3 || ' ....... ' || i", 5: "'G.2.' || i % 4 || '.'", 6: "'• ' || x",
    7: "''", 8: "substr(x, 1, 20) || '-'", 9: "'# Titulo ' || i % 3", 10: "'7.'", 11: "'2.' || i % 3 || '. ' || substr(x, 1, 12)", 12: "'- ' || x", 13: "'LOTE ' || i % 3 || ': OBRAS.....' || i", 14: "'3. SOLVENCIA Y MEDIOS'", 15: "case i % 3 when 0 then 'Anexo ' || i % 5 || ' de obra' when 1 then '4 Plazos ' || i else 'Capítulo' || i end",
}
_CASE = "case (i + doc_id) % 17 " + " ".join(f"when {k} then {v}" for k, v in _ODD.items()) + " else x end"


def _converted(s: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Documents whose lines look like those of a converted file; every second has a blank line between any two."""
    docs = _t(s, d, "documents").select("doc_id", "text")
    lines = F.expr(f"transform(split(text, '\\n', -1), (x, i) -> {_CASE})")
    return docs, F.when(F.col("doc_id") % 2 == 0, F.array_join(lines, "\n")).otherwise(F.array_join(lines, "\n\n"))


def reflowed_text(s: SparkSession, d: str) -> DataFrame:
    docs, text = _converted(s, d)
    out = W.reflowed(text)
    return docs.select("doc_id", F.md5(out).alias("h"), F.length(out).alias("n_chars"))


def processed_text(s: SparkSession, d: str) -> DataFrame:
    docs, text = _converted(s, d)
    return docs.select("doc_id", F.md5(W.processed(text)).alias("h"))


def title_levels(s: SparkSession, d: str) -> DataFrame:
    docs, text = _converted(s, d)
    return docs.select("doc_id", F.explode(W.title_levels(text)).alias("x")).select("doc_id", F.col("x.at").alias("at"), F.col("x.level").alias("level"), F.col("x.title").alias("title"))


def titled_text(s: SparkSession, d: str) -> DataFrame:
    docs, text = _converted(s, d)
    return docs.select("doc_id", F.md5(W.with_titles(text)).alias("h"))


def index_anchors(s: SparkSession, d: str) -> DataFrame:
    docs, text = _converted(s, d)
    return anchors.resolved(docs, W.with_titles(W.with_index_links(text))).fillna(-1, "target")


def text_as_markdown(s: SparkSession, d: str) -> DataFrame:
    docs, text = _converted(s, d)
    return docs.select("doc_id", F.md5(W.markdown_of(text)).alias("h"))


def line_headings(s: SparkSession, d: str) -> DataFrame:
    """2.12e, f: what each line is."""
    docs, text = _converted(s, d)
    rows = docs.select("doc_id", F.posexplode(M.lines(text)).alias("at", "line"))
    found = W.numbered_heading(F.col("line"))
    return rows.select("doc_id", "at", F.coalesce(found["level"], F.lit(0)).alias("level"), found["title"].alias("title"), W.plain_heading(F.col("line")).alias("plain"), F.md5(W.with_bullet(F.col("line"))).alias("bullet"))


def numbered_headings(s: SparkSession, d: str) -> DataFrame:
    """2.12h, i."""
    docs, text = _converted(s, d)
    return docs.select("doc_id", F.md5(W.with_numbered_headings(text)).alias("headings"), F.md5(W.without_first_dots(text)).alias("dots"))


def published_abroad(s: SparkSession, d: str) -> DataFrame:
    """2.12j: tenders made of parts, some without a number or with an empty publication."""
    n = F.col("p_partkey") % 6
    doue = F.when(n == 0, F.lit(None)).when(n == 1, "  ").when(n == 2, " Vacío ").when(n == 3, "VACIO").otherwise(F.concat(F.lit(" https://x.org/"), "p_partkey", F.lit(" ")))
    rows = _t(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise("").alias("number"), doue.alias("publication"))
    return H.with_publication(rows)


_CONVERTED = f"""raw as (
    select doc_id, (unnest(generate_series(1, len(w))) - 1)::int i, w from (select doc_id, string_split(text, chr(10)) w from documents)
), changed as (select doc_id, i, {_CASE} line from (select doc_id, i, w[i + 1] x from raw)),
converted as (select doc_id, case when doc_id % 2 = 0 then string_agg(line, chr(10) order by i) else string_agg(line, chr(10) || chr(10) order by i) end t from changed group by doc_id)"""
_REFLOWED = r"""joined as (select doc_id, regexp_replace(regexp_replace(t, '[•◦·▪▫●]', '', 'g'), '([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g') t from converted),
reflowed as (select doc_id, regexp_replace(array_to_string(list_transform(regexp_split_to_array(t, '\n\n+'), lambda x: replace(x, chr(10), ' ')), chr(10) || chr(10)), '[ \t]+\n', chr(10), 'g') t from joined)"""


def _lines(of: str, name: str) -> str:
    """A table of the lines (doc_id, i, line, s) of the texts ``of``; a break at the end begins no line."""
    return rf"""{name} as (select doc_id, i, w[i + 1] line, regexp_replace(w[i + 1], '^\s+|\s+$', '', 'g') s from (
    select doc_id, w, (unnest(generate_series(1, len(w))) - 1)::int i from (select doc_id, string_split(regexp_replace(t, '\n\z', ''), chr(10)) w from {of})))"""


def _indexed(of: str, name: str) -> str:
    """The texts ``of`` with index lines as links."""
    return rf"""{_lines(of, name + '_lines')}, {name}_entries as (
    select *, regexp_extract(s, '^(.+?)\s?\.{{5,}}\s?\d+$', 1) title from {name}_lines
), {name} as (select doc_id, string_agg(case when title != '' then '- [' || title || '](#' || replace(trim(regexp_replace(lower(title), '[^a-z0-9áéíóúñü ]+', '', 'g')), ' ', '-') || ')' else line end, chr(10) order by i) t from {name}_entries group by 1)"""


_CAPITALS = r"'^[A-ZÁÉÍÓÚÜÑ0-9 .,:;/()\-]{8,}$'"


def _titles(of: str) -> str:
    """A table ``titled`` (doc_id, i, line, level, title): titles of the texts ``of``; lines that were taken are absent."""
    return rf"""{_lines(of, 'tl')}, ahead as (
    select *, lead(s) over w "after" from tl window w as (partition by doc_id order by i)
), takes as (
    select *, s != '' and s not like '#%' and "after" is not null and (regexp_matches(s, '^\d+(\.\d+)+\.?$') or (regexp_matches(s, '^([IVXLCDM]+|[A-Z](\.\d+)+|\d+)\.$') and regexp_matches("after", {_CAPITALS}))) takes from ahead
), run as (
    select *, (i - 1 - coalesce(max(case when not takes then i end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), -1)) % 2 = 1 taken from takes
), kinds as (
    select *, case when s = '' or s like '#%' then 'other' when takes then 'number' when regexp_matches(s, '^\d+(\.\d+)*\.\s+.+$') then 'subtitle' when regexp_matches(s, {_CAPITALS}) then 'capitals' else 'other' end kind from run where not taken
), titled as (
    select doc_id, i, line, case when kind = 'number' then rtrim(s, '.') || '. ' || "after" else s end title,
        case kind when 'number' then 2 when 'subtitle' then 3 when 'capitals' then case when i < 15 and i = min(case when kind = 'capitals' then i end) over (partition by doc_id) then 1 else 2 end end "level"
    from kinds
), marked as (
    select doc_id, string_agg(case "level" when 3 then '### ' || title when 2 then chr(10) || '## ' || title || chr(10) when 1 then chr(10) || '# ' || title || chr(10) else line end, chr(10) order by i) t from titled group by 1
)"""


_UPPER = r"(length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) > 0 and length(regexp_replace({0}, '[^\p{{Lu}}]', '', 'g')) / length(regexp_replace({0}, '[^\p{{L}}]', '', 'g')) >= 0.7)"
_HEADINGS = rf"""{_lines('converted', 'hl')}, parts as (
    select *, regexp_extract(s, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 1) num, regexp_extract(s, '^(\d+(?:\.\d+)*\.?)\s+(.+)$', 2) rest, regexp_extract(s, '^([A-ZÁÉÍÓÚÜÑ]\.\d+(?:\.\d+)*\.?)\s+(.+)$', 1) code, regexp_extract(s, '^([A-ZÁÉÍÓÚÜÑ]\.\d+(?:\.\d+)*\.?)\s+(.+)$', 2) more from hl
), found as (
    select *, case when length(s) < 3 then null when num != '' then case when len(string_split(rtrim(num, '.'), '.')) > 1 then least(6, len(string_split(rtrim(num, '.'), '.'))) when {_UPPER.format('rest')} then 1 end
        when code != '' then least(6, len(string_split(rtrim(code, '.'), '.'))) end "level", case when num != '' then rtrim(num, '.') || '. ' || rest else rtrim(code, '.') || '. ' || more end title,
        length(s) >= 4 and s not like '%:' and {_UPPER.format('s')} plain,
        case when regexp_matches(line, '^\s*[-*•·o]\s') then '- ' || regexp_replace(s, '^.\s+', '') else line end bullet from parts
)"""

QUERIES = {
    "reflowed_text": (reflowed_text, f"with {_CONVERTED}, {_REFLOWED} select doc_id, md5(t) h, length(t)::int n_chars from reflowed"),
    "processed_text": (processed_text, f"with {_CONVERTED}, {_REFLOWED}, {_indexed('reflowed', 'linked')}, {_titles('linked')} select doc_id, md5(t) h from marked"),
    "title_levels": (title_levels, f'with {_CONVERTED}, {_titles("converted")} select doc_id, i as "at", "level", title from titled where "level" is not null'),
    "titled_text": (titled_text, f"with {_CONVERTED}, {_titles('converted')} select doc_id, md5(t) h from marked"),
    "index_anchors": (
        index_anchors,
        rf"""with {_CONVERTED}, {_indexed('converted', 'linked')}, {_titles('linked')}, {_lines('marked', 'al')}, heads as (
            select doc_id, i, replace(trim(regexp_replace(lower(regexp_extract(line, '^#{{1,6}}\s+(.*)$', 1)), '[^a-z0-9áéíóúñü ]+', '', 'g')), ' ', '-') slug from al where regexp_matches(line, '^#{{1,6}}\s+.')
        ), entries as (select doc_id, i as "at", regexp_extract(line, '^- \[(.*)\]\(#', 1) title, regexp_extract(line, '\(#([^()]*)\)$', 1) slug from al where regexp_matches(line, '^- \[.*\]\(#[^()]*\)$'))
        select doc_id, "at", title, slug, count(i) headings, coalesce(min(i), -1) target, case count(i) when 0 then 'dangling' when 1 then 'linked' else 'ambiguous' end state from entries left join heads using (doc_id, slug) group by doc_id, "at", title, slug""",
    ),
    "text_as_markdown": (
        text_as_markdown,
        f"""with {_CONVERTED}, {_HEADINGS} select doc_id, md5(string_agg(case when s = '' then '' when "level" is not null then repeat('#', "level"::int) || ' ' || title when plain then '# ' || s else bullet end, chr(10) order by i)) h from found group by 1""",
    ),
    "line_headings": (line_headings, f'with {_CONVERTED}, {_HEADINGS} select doc_id, i as "at", coalesce("level", 0)::int as "level", case when "level" is not null then title end title, plain, md5(bullet) bullet from found'),
    "numbered_headings": (
        numbered_headings,
        rf"""with {_CONVERTED}, {_lines('converted', 'nl')}, cut as (
            select *, regexp_extract(s, '^(?:(\d{{1,2}})|(\d{{1,2}}\.\d{{1,2}})|(\d{{1,2}}\.\d{{1,2}}\.\d{{1,2}}))\.\s+.+$', 0) != '' numbered, regexp_extract(s, '^([\d.]+)\s', 1) num, regexp_replace(s, '^[\d.]+\s+', '') rest,
                regexp_extract(s, '^([A-Z]\.\d+(?:\.\d+)*\.)\s*(.*)$', 1) code, regexp_extract(s, '^([A-Z]\.\d+(?:\.\d+)*\.)\s*(.*)$', 2) more, regexp_matches(line, '^[ \t\-*>|<#]') or s = '' stays from nl
        ), heads as (
            select *, case when stays then line when numbered and (len(string_split(num, '.')) > 2 or {_UPPER.format('rest')}) then repeat('#', (len(string_split(num, '.')) - 1)::int) || ' ' || num || ' ' || rest when code != '' then rtrim('### ' || code || ' ' || more) else line end head from cut
        ), dots as (select *, regexp_extract(line, '^(.*?)(\.{{3,}})(\s*\d+.*?)$', 1) a, regexp_extract(line, '^(.*?)(\.{{3,}})(\s*\d+.*?)$', 3) b from heads)
        select doc_id, md5(string_agg(head, chr(10) order by i)) headings, md5(string_agg(case when b != '' then trim(a) || ' ' || trim(b) else line end, chr(10) order by i) filter (s = '' or not regexp_matches(s, '^\.+$'))) dots from dots group by 1""",
    ),
    "published_abroad": (
        published_abroad,
        "select p_partkey, p_brand number, 'https://x.org/' || p_partkey publication from part where p_partkey % 6 > 3 and p_size % 5 != 0",
    ),
}
