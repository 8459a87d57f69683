"""Queries of what is stored and shown: tables written in one step, messages by patterns, HTML, labelled links, prompts, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmill.functions import text as T
from sparkmill.functions.html import CODE_CLASS, TABLE_CLASS, html_of
from sparkmill.operators import indexing as X, messages
from sparkmill.sources import commits, html as H


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def committed_answers(s: SparkSession, d: str) -> DataFrame:
    """SNK08, SNK14: orders as answers and their items as fragments, in two batches, of which one is sent twice; every seventh has no user."""
    items = _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("ranking"), F.concat("l_partkey", F.lit("/"), "l_suppkey").alias("chunk"))).alias("fragments"))
    answers = _t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("user_id")).join(items, "id")
    root = commits.passing(s, "answers")
    for batch, rows in (("even", answers.where("id % 2 = 0")), ("odd", answers.where("id % 2 = 1")), ("even", answers)):
        commits.persist_answers(root, batch, rows, 3)
    kept = commits.table(s, root, "answers", "id long, user_id long, fragments array<struct<ranking:bigint,chunk:string>>")
    bridge = commits.table(s, root, "bridge", "id long, chunk string, ranking long")
    return kept.select("id", "user_id", F.size("fragments").cast("long").alias("fragments")).join(bridge, "id")


_PATTERNS = [
    (1, r"Converted (?P<n>\d+) files\.", "done"),
    (2, r"Converted (?P<n>\d+) files and (?P<bad>\d+) failed\.", "done_bad"),
    (2, r"Converted (?P<n>\d+) files and (?P<some>\w+) failed\.", "never"),
    (3, r"Page (?P<page>\d+)/(?P<total>\d+) of (?P<name>.+)", "page"),
    (4, r"Page .*", "odd_page"),
]


def localized_messages(s: SparkSession, d: str) -> DataFrame:
    """STR22: messages made of parts; some keys have no text in the language, one text an argument that no pattern gives."""
    n = F.col("p_size").cast("string")
    message = (
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("Converted "), n, F.lit(" files.")))
        .when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("Converted "), n, F.lit(" files and 2 failed.")))
        .when(F.col("p_partkey") % 7 == 2, F.concat(F.lit("Page 1/"), n, F.lit(" of "), F.col("p_name")))
        .when(F.col("p_partkey") % 7 == 3, "Page x")
        .when(F.col("p_partkey") % 7 == 4, "done_bad")
        .when(F.col("p_partkey") % 7 == 5, F.concat(F.lit(" Converted "), n, F.lit(" files.")))
    )
    patterns = s.createDataFrame(_PATTERNS, "seq int, pattern string, key string")
    texts = s.createDataFrame([("es", "done", "{n} hechos"), ("en", "done", "{n} done"), ("en", "done_bad", "{n} done, {bad} bad"), ("es", "page", "{name}: {page} de {total}"), ("es", "odd_page", "odd {what}")], "language string, key string, text string")
    rows = _t(s, d, "part").select("p_partkey", message.alias("message"))
    return messages.localized(rows, patterns, texts, "es", "en").select("p_partkey", "shown")


def markdown_html(s: SparkSession, d: str) -> DataFrame:
    """MD05: a document's first line in every kind of block, the fence at the end unclosed."""
    first = F.regexp_replace(F.split("text", "\n")[0], r"[`*_|#>+\\-]", "")
    first = F.concat(F.lit("a "), F.trim(F.regexp_replace(first, r"\s+", " ")), F.lit(" <b> & 'c'"))
    blocks = [F.lit("# "), first, F.lit("\n"), first, F.lit("\nand **"), first, F.lit("**\n- x `<i>`\n* "), first, F.lit("\n\n1. "), first, F.lit("\n2) y\n> "), first, F.lit("\n>z\n| h | "), first, F.lit(" |\n|---|:---:|\n| 1 | "), first, F.lit(" |\n\n```py\n"), first, F.lit("\n# no heading")]
    return _t(s, d, "documents").select("doc_id", F.md5(html_of(F.concat(*blocks))).alias("h"))


def labelled_links(s: SparkSession, d: str) -> DataFrame:
    """GEN02: pages made of parts, with two links to the technical specification and none or an empty one to the other."""
    k = F.col("p_partkey").cast("string")
    other = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, '<a class="x">Pliego Cláusulas Administrativas</a><a href="/late">Pliego Cláusulas Administrativas</a>').otherwise(F.concat(F.lit('<A HREF="/adm/'), k, F.lit('"> ver PLIEGO  Cláusulas\n<b>Administrativas</b></A>')))
    page = F.concat(F.lit('<p><a href="/x">Pliego</a><a id="q" href="/tec/'), k, F.lit('">Pliego Prescripciones Técnicas (pdf)</a><a href="/second">Pliego Prescripciones Técnicas</a>'), other, F.lit("</p>"))
    return H.labelled_links(_t(s, d, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html")))


def profile_prompts(s: SparkSession, d: str) -> DataFrame:
    """STR17: benchmark items as questions of all profiles and of an unknown one."""
    names = [*X.PROFILE_TASKS, "unknown"]
    profile = F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") % len(names) + 1).cast("int"))
    blocks = F.when(F.col("item_id") % 4 != 0, F.transform(F.sequence(F.lit(1), (F.col("item_id") % 4).cast("int")), lambda i: F.concat(F.lit("[CHUNK #"), i, F.lit("]"))))
    return _t(s, d, "benchmark").select("item_id", X.profile_prompt(profile, F.col("text"), blocks).alias("prompt"))


def shown_dates(s: SparkSession, d: str) -> DataFrame:
    """DT07, DT08, STR28."""
    o = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return _t(s, d, "orders").select("o_orderkey", T.day_shown(o).alias("day"), T.month_shown(F.col("o_orderdate"), "fr").alias("mes"), T.month_shown(F.col("o_orderdate"), "en").alias("month"), T.trimmed(F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit(" \t"), "o_orderstatus", F.lit("\n")))).alias("status"))


def _names(language: str) -> str:
    return "[" + ", ".join(f"'{n[0].upper() + n[1:]}'" for n in T.MONTHS[language]) + "]"


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), chr(34), '&quot;')"
_TASKS = "case item_id % 12 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate([*X.PROFILE_TASKS.values(), X.PROFILE_TASKS["general"]])) + " end"

QUERIES = {
    "committed_answers": (
        committed_answers,
        """with f as (select l_orderkey id, l_linenumber ranking, l_partkey || '/' || l_suppkey as chunk, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey || '/' || l_suppkey) n, o_custkey user_id from lineitem join orders on l_orderkey = o_orderkey where o_custkey % 7 != 0)
        select id, user_id, count(*) over (partition by id) fragments, chunk, ranking from f where n <= 3""",
    ),
    "localized_messages": (
        localized_messages,
        """select p_partkey, case p_partkey % 7 when 0 then p_size || ' hechos' when 1 then p_size || ' done, 2 bad' when 2 then p_name || ': 1 de ' || p_size when 3 then 'odd {what}' when 4 then '{n} done, {bad} bad' when 5 then ' Converted ' || p_size || ' files.' end shown from part""",
    ),
    "markdown_html": (
        markdown_html,
        rf"""with r as (select doc_id, 'a ' || trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[`*_|#>+\\-]', '', 'g'), '\s+', ' ', 'g')) || ' <b> & ''c''' x from documents), e as (select doc_id, {_ESCAPE.format('x')} e from r)
        select doc_id, md5('<h3>' || e || '</h3><p>' || e || '<br>and <strong>' || e || '</strong></p><ul><li>x <code>&lt;i&gt;</code></li><li>' || e || '</li></ul><ol><li>' || e || '</li><li>y</li></ol><blockquote>' || e || '<br>z</blockquote><div class="{TABLE_CLASS}"><table><thead><tr><th>h</th><th>' || e
            || '</th></tr></thead><tbody><tr><td>1</td><td>' || e || '</td></tr></tbody></table></div><pre class="{CODE_CLASS}"><code>' || e || chr(10) || '# no heading</code></pre>') h from e""",
    ),
    "labelled_links": (
        labelled_links,
        """select p_partkey page_id, 'Pliego Prescripciones Técnicas' "label", '/tec/' || p_partkey link from part union all select p_partkey, 'Pliego Cláusulas Administrativas', '/adm/' || p_partkey from part where p_size % 3 = 2""",
    ),
    "profile_prompts": (
        profile_prompts,
        f"""select item_id, {_TASKS} || chr(10) || 'Use nothing but the fragments (' || case item_id % 4 when 0 then '-' when 1 then 'CHUNK #1' else 'CHUNK #1-' || item_id % 4 end || ').' || chr(10) || chr(10) || 'Question:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Fragments:' || chr(10)
            || case item_id % 4 when 0 then '' when 1 then '[CHUNK #1]' when 2 then '[CHUNK #1]' || chr(10) || '[CHUNK #2]' else '[CHUNK #1]' || chr(10) || '[CHUNK #2]' || chr(10) || '[CHUNK #3]' end || chr(10) prompt from benchmark""",
    ),
    "shown_dates": (
        shown_dates,
        f"""select o_orderkey, case when o_orderkey % 9 != 0 then strftime(o_orderdate, '%d/%m/%Y') else '-' end as "day", {_names('es')}[month(o_orderdate)] || ' ' || year(o_orderdate) as mes, {_names('en')}[month(o_orderdate)] || ' ' || year(o_orderdate) as "month", case when o_orderkey % 9 != 0 then o_orderstatus else '' end as "status" from orders""",
    ),
}
