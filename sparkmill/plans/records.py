"""Queries of records around questions and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmill.functions import markdown as M
from sparkmill.operators import evaluation as E, records as X
from sparkmill.plans.usage import _dated, _log


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def user_filter(s: SparkSession, d: str) -> DataFrame:
    nation = _t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    c = _t(s, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "country", (F.col("c_acctbal") > 0).alias("is_admin"))
    return X.users(c, "1", nation.join(_t(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").select("country"), True).select("id", "name")


def best_or_empty(s: SparkSession, d: str) -> DataFrame:
    hits = _t(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return X.best_or_empty(_t(s, d, "customer").select(F.col("c_custkey").alias("qid")), hits)


def json_numbers(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.json_number(raw).alias("tax"))


def merged_by_question(s: SparkSession, d: str) -> DataFrame:
    talk = _t(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    judged = talk.select(F.concat(F.lit(" "), "question").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("conv_id") % 7).alias("score"))
    return X.merged_by_question(talk, judged).select("conv_id", "turn", "score")


def payload_fetch(s: SparkSession, d: str) -> DataFrame:
    table = _t(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    ids = _t(s, d, "labels").select(F.when(F.col("quality") == 1, F.concat(F.col("doc_id"), F.lit(" "))).otherwise(" ").alias("id"))
    return X.payloads(table, ids).select("id", "lang")


def evaluation_rows(s: SparkSession, d: str) -> DataFrame:
    talk = _t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" ").alias("t")))).alias("x"))
    rows = talk.select("conv_id", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("e").alias("evidence"), F.when(F.col("conv_id") % 2 == 0, "truth").otherwise(" ").alias("ground_truth"), F.transform("x", lambda v: v["t"]).alias("contexts"))
    return E.evaluation_rows(rows).select("conv_id", "reference", F.size("retrieved_contexts").alias("n"), F.md5(F.array_join("retrieved_contexts", "|")).alias("h"))


def stored_fragments(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_list(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ranking"), F.col("l_partkey").cast("string").alias("chunk"))).alias("fragments"))
    return X.stored_fragments(rows)[1]


def logins(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("id"), "ts")
    users = _t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("login_count"), F.lit(None).cast("timestamp_ntz").alias("last_login"))
    return X.logged_in(users, e)


def stale_jobs(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events")
    job = e.select("event_id", F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").otherwise("done").alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("started"), F.col("ts").alias("created"))
    return X.failed_if_stale(job, F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "status")


def routes(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", X.routed(F.col("p_type"), [("brass", "metal"), ("steel", "metal"), ("economy", "cheap")], "other").alias("tab"))


def json_fallbacks(s: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"message":"m'), "event_id", F.lit('"}'))).when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"detail":"d","error":"e'), "event_id", F.lit('"}'))).otherwise(F.col("props"))
    models = F.when(F.col("user_id") % 2 == 0, '[{"name":" View","size_vram":5},{"name":"click"}]').otherwise("[]")
    return _t(s, d, "events").select("event_id", X.error_detail(body).alias("detail"), X.device_of(models, F.col("event_type"), F.lit("unknown")).alias("device"))


def joined_pages(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("text")).otherwise("").alias("text"))
    return p.groupBy("conv_id").agg(M.joined_pages(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.md5("t").alias("h"))


def image_sizes(s: SparkSession, d: str) -> DataFrame:
    box = M.fitted_size(F.col("p_size") * 100, F.col("p_partkey") % 3000 + 1)
    return _t(s, d, "part").select("p_partkey", box["width"].alias("width"), box["height"].alias("height"))


def translations(s: SparkSession, d: str) -> DataFrame:
    n = _t(s, d, "nation")
    texts = n.where("n_regionkey = 0").select(F.lit("es").alias("language"), F.col("n_name").alias("key"), F.concat(F.lit("país {arg} "), F.col("n_name")).alias("text")).union(n.where("n_regionkey < 3").select(F.lit("en"), "n_name", F.concat(F.lit("country {arg} "), F.col("n_name"))))
    return X.translated(n.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("arg")), texts, "es", "en")


def top_logins(s: SparkSession, d: str) -> DataFrame:
    own = _t(s, d, "events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = _t(s, d, "customer").join(own, "c_custkey", "left").select(F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n"))
    return X.ranked_with_rest(c, 10)


QUERIES = {
    "user_filter": (user_filter, (
        "select c_custkey id, c_name as name from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 and c_acctbal > "
        "0 and c_name like '%1%'"
    )),
    "best_or_empty": (
        best_or_empty,
        (
            "select c_custkey qid, coalesce(o_orderkey, -1) id, coalesce(o_totalprice, 0.0) score from customer left join (select * from "
            "orders where o_totalprice > 200000 qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1) "
            "on c_custkey = o_custkey"
        ),
    ),
    "json_numbers": (json_numbers, "select l_orderkey, l_linenumber, case when l_linenumber > 2 then l_tax end tax from lineitem"),
    "merged_by_question": (merged_by_question, (
        "with l as (select trim(text) q, arg_max(conv_id % 7, conv_id * 1000 + turn) score from conversations group by 1) select conv_id, "
        "turn, score from conversations join l on trim(text) = q"
    )),
    "payload_fetch": (payload_fetch, "select doc_id::varchar id, lang from documents where doc_id in (select doc_id from labels where quality = 1)"),
    "home_metrics": (lambda s, d: _dated(X.home_metrics(_log(s, d).withColumn("seconds", F.when(F.col("event_id") % 3 != 0, F.col("seconds"))))), (
        "select user_id, count(*) total, count(distinct event_type) models, count(distinct ts::date) active_days, round(avg(case when "
        "event_id % 3 = 0 then 0.0 else value end), 2) avg_seconds, max(ts::date)::varchar last_day from events group by 1"
    )),
    "evaluation_rows": (
        evaluation_rows,
        (
            "with x as (select conv_id, list(text order by turn) filter (turn % 2 = 0 and trim(text) != '') c from conversations group by 1) "
            "select conv_id, case conv_id % 2 when 0 then 'truth' else 'e' end reference, len(coalesce(c, [])[1:3])::int n, "
            "md5(array_to_string(coalesce(c, [])[1:3], '|')) h from x"
        ),
    ),
    "stored_fragments": (stored_fragments, (
        "select l_suppkey id, l_partkey::varchar chunk, l_orderkey * 10 + l_linenumber ranking from lineitem qualify row_number() over "
        "(partition by l_suppkey order by l_orderkey * 10 + l_linenumber, l_partkey::varchar) <= 10"
    )),
    "login_counts": (logins, (
        "select c_custkey id, c_nationkey + count(user_id) login_count, max(ts) last_login from customer left join (select * from events "
        "where event_type = 'signup') on c_custkey = user_id group by c_custkey, c_nationkey"
    )),
    "stale_jobs": (stale_jobs, (
        "select event_id, case when event_type in ('view', 'click') and ts < '2024-01-10' then 'failed' when event_type = 'view' then "
        "'running' when event_type = 'click' then 'queued' else 'done' end status from events"
    )),
    "tab_routes": (routes, (
        "select p_partkey, case when lower(p_type) like '%brass%' or lower(p_type) like '%steel%' then 'metal' when lower(p_type) like "
        "'%economy%' then 'cheap' else 'other' end tab from part"
    )),
    "json_fallbacks": (
        json_fallbacks,
        (
            "select event_id, case user_id % 3 when 0 then 'm' || event_id when 1 then 'e' || event_id end detail, case when user_id % 2 = 0 "
            "and event_type = 'view' then 'GPU' when user_id % 2 = 0 and event_type = 'click' then 'CPU' else 'unknown' end device from events"
        ),
    ),
    "joined_pages": (joined_pages, (
        "select conv_id, md5(coalesce(string_agg(text, chr(10) || chr(10) order by turn) filter (turn % 3 != 1 and text != ''), '')) h "
        "from conversations group by 1"
    )),
    "image_sizes": (
        image_sizes,
        (
            "with x as (select p_partkey, p_size * 100 w, p_partkey % 3000 + 1 h from part), y as (select *, case when greatest(w, h) > 1600 "
            "then 1600 / greatest(w, h) else 1.0::double end z from x) select p_partkey, greatest(1, floor(w * z))::bigint width, greatest(1, "
            "floor(h * z))::bigint height from y"
        ),
    ),
    "translations": (translations, (
        "select n_name as key, n_nationkey arg, case when n_regionkey = 0 then 'país ' || n_nationkey || ' ' || n_name when n_regionkey < "
        "3 then 'country ' || n_nationkey || ' ' || n_name else n_name end shown from nation"
    )),
    "top_logins": (top_logins, (
        "select name, n from (select c_name as name, count(user_id) n from customer left join (select * from events where event_type = "
        "'signup') on c_custkey = user_id group by c_custkey, c_name order by n desc, name limit 10) where n > 0"
    )),
}
