"""Queries of inputs: pages of tenders, files and their names, question lists, streamed answers, prompts and vectors from a given model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T_

from sparkmill.functions import text as T
from sparkmill.operators import chunking, evaluation as E, indexing as X, records as Q, retrieval as R, usage as U
from sparkmill.plans.reflow import _CONVERTED, _converted, _lines
from sparkmill.plans.usage import _MONTHS, _dated, _orders
from sparkmill.sources import html as H, readers


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tender(s: SparkSession, d: str) -> DataFrame:
    """Pages of tenders made of part numbers: a head table and two rows of documents."""
    k = F.col("p_partkey").cast("string")
    link = F.when(F.col("p_size") % 3 == 0, "#").when(F.col("p_size") % 3 == 1, F.concat(F.lit("/lic/"), k)).otherwise(F.concat(F.lit("https://x.org/"), k))
    head = F.concat(
        F.lit('<table><tbody><tr><td><a id="v:URLOrganoContratacion" class="c" href="organ?id='), k, F.lit('">o</a><span id="v:form1:text_IdOrganoContratacion"> '), k,
        F.lit(' </span></td></tr><tr><td><span class="x" id="v:form1:text_Expediente">EXP &amp; '), F.col("p_brand"), F.lit('</span></td></tr><tr><td><span id="v:form1:text_ObjetoContrato">\n<b>'), F.col("p_name"),
        F.lit('</b></span></td></tr><tr><td><a href="'), link, F.lit('" id="v:form1:link_EnlaceLicPLACE">l</a></td></tr></tbody></table>'),
    )
    table = F.concat(
        F.lit('<table id="myTablaDetalleVISUOE"><tbody class="tabla-detalle"><tr><td> 01/02/2024 </td><td>Pliego '), k, F.lit('</td><td><a href="#">x</a><a href="/d/'), k, F.lit('">a</a><a class="q" href="https://y.org/z">b</a></td>'),
        F.lit('<td><div class="flex"><span>sent '), k, F.lit('</span></div><a href="first">1</a><a href="/doue/'), k, F.lit('">02/02/2024</a></td></tr><tr><td></td><td> </td><td></td><td><span class="outputText">'),
        F.when(F.col("p_size") % 2 == 0, "").otherwise("later"), F.lit("</span></td></tr></tbody></table>"),
    )
    parts = _t(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    parts = parts.repartition(4 * s.sparkContext.defaultParallelism, "p_partkey")  # a page is some twenty times its part, whose file is one task
    return parts.select(F.col("p_partkey").alias("page_id"), F.lit("https://h.org/a/b?c=1#d").alias("url"), F.concat(head, F.lit("\n"), table).alias("html"))


def tender_heads(s: SparkSession, d: str) -> DataFrame:
    return _tender(s, d).select("page_id", H.head_fields(F.col("url"), F.col("html")).alias("f")).select("page_id", "f.*")


def tender_documents(s: SparkSession, d: str) -> DataFrame:
    return H.document_rows(_tender(s, d))


def file_names(s: SparkSession, d: str) -> DataFrame:
    """STR09, STR10, STR21: what file names say, and a name in snake case."""
    title = F.when(F.col("p_size") % 3 == 0, "Pliego_Técnico").when(F.col("p_size") % 3 == 1, "Pliego_Administrativo").otherwise("Anexo")
    name = F.when(F.col("p_size") % 5 == 0, F.concat(title, F.lit("_2.pdf"))).otherwise(F.concat("p_brand", F.lit("__"), title, F.lit("_1.pdf")))
    found = T.named_file(name)
    snake = T.snake(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    return _t(s, d, "part").select("p_partkey", found["number"].alias("number"), found["kind"].alias("kind"), snake.alias("snake"))


def sections(s: SparkSession, d: str) -> DataFrame:
    """CHK09: documents whose lines look like those of a converted file."""
    docs, text = _converted(s, d)
    return chunking.sections(docs.select("doc_id", text.alias("text"))).select("doc_id", "section", "title", F.md5("text").alias("h"))


def json_arrays(s: SparkSession, d: str) -> DataFrame:
    """SRC09: orders of a customer as a JSON array, some with a text for a number; some arrays are damaged."""
    number = F.when(F.col("o_orderkey") % 5 == 0, F.lit('"x"')).otherwise(F.col("o_orderkey").cast("string"))
    one = F.concat(F.lit('{"n":'), number, F.lit(',"s":"'), F.col("o_orderstatus"), F.lit('","more":[1]}'))
    whole = F.concat(F.lit("["), F.array_join(F.collect_list(one), ", "), F.when(F.col("o_custkey") % 7 != 0, "]").otherwise(""))
    texts = _t(s, d, "orders").groupBy("o_custkey").agg(whole.alias("text"))
    return readers.json_elements(texts, F.col("text"), T_.StructType().add("n", "long").add("s", "string"))


def question_lists(s: SparkSession, d: str) -> DataFrame:
    """SRC10: questions as objects, as JSON strings and plain."""
    n = F.col("conv_id") % 3
    value = F.when(n == 0, F.concat(F.lit('{"question":"q'), "conv_id", F.lit('","evidence":"e'), "turn", F.lit('"}'))).when(n == 1, F.concat(F.lit(' "q'), "conv_id", F.lit('"'))).otherwise(F.concat(F.lit("q"), "conv_id"))
    return readers.questions(_t(s, d, "conversations").select(value.alias("value")))


def streamed_answers(s: SparkSession, d: str) -> DataFrame:
    """SRC15: turns as lines of a stream, in two forms; the fourth says that the answer is done."""
    piece = F.concat(F.lit("t"), F.col("turn").cast("string"))
    line = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"message":{"content":"'), piece, F.lit('"}}'))).otherwise(F.concat(F.lit('{"response":"'), piece, F.lit('","done":'), (F.col("turn") == 3).cast("string"), F.lit("}")))
    return readers.streamed_answer(_t(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"), line.alias("line")))


def prompts(s: SparkSession, d: str) -> DataFrame:
    """STR17, EVA09: a question and its context in a template, and the metrics that are asked for."""
    asked = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("context_recall"), F.lit("nonsense"), F.lit("faithfulness"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("nonsense")))
    filled = X.prompt("C:{context}|Q:{question}", F.concat(F.lit("{context}"), "item_id"), F.lit("ctx"))
    return _t(s, d, "benchmark").select("item_id", filled.alias("prompt"), F.array_join(E.chosen(asked), ",").alias("metrics"))


def embedded(s: SparkSession, d: str) -> DataFrame:
    """EVA07, UDF01: vectors from a given model, here a text's length and words."""
    text = F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 != 1, F.col("text"))
    rows = X.embedded(_t(s, d, "documents").select("doc_id", text.alias("text")), lambda batch: [[float(len(t)), float(len(t.split(" ")))] for t in batch])
    return rows.select("doc_id", F.get("vector", F.lit(0)).cast("long").alias("length"), F.get("vector", F.lit(1)).cast("long").alias("words"))


def sampled(s: SparkSession, d: str) -> DataFrame:
    """SRT13: three rows of each segment in an order that looks random: how many there are, each a row of its segment."""
    own = Q.shuffled(_t(s, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", 3)
    return own.join(_t(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("of")), "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("of") == F.col("c_mktsegment")).alias("own"))


def daily_12m(s: SparkSession, d: str) -> DataFrame:
    """AGG05, AGG06: every day of the last twelve months."""
    return _dated(U.by_day_12m(_orders(s, d)))


def keyset_page(s: SparkSession, d: str) -> DataFrame:
    """SRC12, WIN10: the next 25 rows after a key."""
    return R.after(_t(s, d, "embeddings"), "vec_id", 100, 25).select("vec_id")


def json_safe(s: SparkSession, d: str) -> DataFrame:
    """PRJ03: structs with maps of arrays of numbers, and arrays of structs, as JSON, with null for what JSON cannot hold."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    value = F.when(F.col("p_size") % 3 == 0, nan).when(F.col("p_size") % 3 == 1, inf).otherwise(F.lit(0.5))
    inner = F.when(F.col("p_size") % 2 == 0, F.struct(value.alias("v"), F.col("p_brand").alias("b")))
    nested = F.struct(F.create_map(F.col("p_size"), F.array(value, F.lit(1.5))).alias("m"), F.array(inner).alias("a"))
    parts = _t(s, d, "part")
    return parts.select("p_partkey", Q.json_text(parts, nested).alias("json"))


_KIND = "case p_size % 3 when 0 then 'tecnico' when 1 then 'administrativo' end"

QUERIES = {
    "tender_heads": (
        tender_heads,
        (
            "select p_partkey page_id, p_partkey::varchar organ_id, null::varchar unit, 'EXP & ' || p_brand \"number\", p_name as \"object\", "
            "'https://h.org/a/organ?id=' || p_partkey organ_url, case p_size % 3 when 1 then 'https://h.org/lic/' || p_partkey when 2 then "
            "'https://x.org/' || p_partkey end link from part"
        ),
    ),
    "tender_documents": (
        tender_documents,
        """select p_partkey page_id, 0::int as "at", '01/02/2024' published, 'Pliego ' || p_partkey as document, 'https://h.org/d/' || p_partkey || ' | https://y.org/z' urls, 'sent ' || p_partkey doue_sent, 'https://h.org/doue/' || p_partkey doue_url, '02/02/2024' doue_date from part
        union all select p_partkey, 1, null, null, null, null, null, 'later' from part where p_size % 2 != 0""",
    ),
    "file_names": (file_names, f"select p_partkey, case when p_size % 5 != 0 then p_brand end \"number\", {_KIND} kind, replace(p_name, ' ', '_') snake from part"),
    "sections": (
        sections,
        rf"""with {_CONVERTED}, {_lines('converted', 'sl')}, heads as (
            select *, length(s) <= 120 and not regexp_matches(s, '^\s*\d*(\.\d+)*\s*[^\d.·•∙⋅…]+?\s[.·•∙⋅…]{{4,}}\s*\d{{1,4}}\s*$') and not regexp_matches(s, '[.·•∙⋅…]{{3,}}\s*\d{{1,4}}\s*$')
                and (regexp_matches(s, '^\s*\d+(\.\d+)*\s+[A-ZÁÉÍÓÚÑ0-9].{{2,}}$') or regexp_matches(s, '(?i)^(CAP[IÍ]TULO|ANEXO|AP[EÉ]NDICE)\b') or (regexp_matches(s, '^[A-ZÁÉÍÓÚÑ0-9][A-ZÁÉÍÓÚÑ0-9\s\-–,:;.()]{{4,}}$') and contains(s, ' '))) head from sl
        ), numbered as (select *, count(*) filter (head) over (partition by doc_id order by i) section from heads),
        bodies as (select doc_id, section, coalesce(max(s) filter (head), 'Preámbulo') title, regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (not head), ''), '^\s+|\s+$', '', 'g') t from numbered group by 1, 2)
        select doc_id, section, title, md5(t) h from bodies where t != ''""",
    ),
    "json_arrays": (json_arrays, "select o_orderkey n, o_orderstatus s from orders where o_orderkey % 5 != 0 and o_custkey % 7 != 0"),
    "question_lists": (question_lists, (
        "select 'q' || conv_id question, null::varchar ground_truth, case conv_id % 3 when 0 then 'e' || turn end evidence from "
        "conversations"
    )),
    "streamed_answers": (streamed_answers, "select conv_id id, string_agg('t' || turn, '' order by turn) answer from conversations where turn <= 3 group by 1"),
    "prompts": (
        prompts,
        (
            "select item_id, 'C:ctx|Q:{context}' || item_id prompt, case item_id % 3 when 0 then 'context_recall,faithfulness' else "
            "'faithfulness,answer_relevancy,context_precision,context_recall,context_relevancy,answer_correctness' end metrics from benchmark"
        ),
    ),
    "embedded_texts": (embedded, (
        "with x as (select doc_id, case when doc_id % 4 in (0, 1) or trim(coalesce(text, '')) = '' then ' ' else text end t from "
        "documents) select doc_id, length(t)::bigint length, len(string_split(t, ' '))::bigint words from x"
    )),
    "sampled_rows": (sampled, "select c_mktsegment, least(3, count(*)) n, true own from customer group by 1"),
    "daily_counts_12m": (
        daily_12m,
        f"""with d as (select unnest(generate_series((select min(month) from {_MONTHS}), (select last_day(max(month)) from {_MONTHS}), interval 1 day))::date as day)
        select day::varchar as day, coalesce(n, 0) n, coalesce(round(s, 2), 0.0) avg_seconds from d left join (select o_orderdate::date as day, count(*) n, avg(o_totalprice) s from orders group by 1) using (day)""",
    ),
    "keyset_page": (keyset_page, "select vec_id from embeddings where vec_id > 100 order by 1 limit 25"),
    "json_safe": (json_safe, """with x as (select *, case when p_size % 3 = 2 then '0.5' else 'null' end v from part)
        select p_partkey, '{"m":{"' || p_size || '":[' || v || ',1.5]},"a":[' || case when p_size % 2 = 0 then '{"v":' || v || ',"b":"' || p_brand || '"}' else 'null' end || ']}' json from x"""),
}
