"""Queries of indexing, joins with dimensions and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmill.operators import indexing as X, usage as U


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tender_files(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part")
    doc = F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Pliego "), "p_name")).otherwise(F.col("p_name")).alias("Documento"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("http://a/"), "p_partkey", F.lit(" | http://b"))).alias("urls"), F.col("p_partkey").alias("k"))
    tenders = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", doc.alias("doc")))).alias("all"))
    tenders = tenders.select(F.struct(F.col("p_brand").alias("Expediente"), F.transform("all", lambda x: x["doc"]).alias("Documentos")).alias("datos"))
    return X.tender_files(tenders)


def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    li = _t(s, d, "lineitem").select(F.col("l_partkey").alias("document_id"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("sha256"), (F.col("l_linenumber") - 2).alias("segment"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return X.chunk_rows(li)


def synced_documents(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    old = docs.where("lang != 'es'").select(F.col("doc_id").alias("path"), F.col("source").alias("hash"), F.col("lang").alias("markdown"), F.lit("indexado").alias("status"))
    new = docs.where("lang != 'fr'").select(F.col("doc_id").alias("path"), F.when(F.col("lang") == "de", "new").otherwise(F.col("source")).alias("hash"))
    return X.synced(old, new)


def job_states(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events")
    event = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("queued")
    return X.job_states(e.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), event.alias("event")))


def response_times(s: SparkSession, d: str) -> DataFrame:
    li = _t(s, d, "orders").join(_t(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    elapsed = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity"))
    started = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate"))
    return li.select("l_orderkey", "l_linenumber", X.response_seconds(elapsed, started, F.col("l_shipdate"), F.col("o_orderdate")).alias("seconds"))


def best_fragment(s: SparkSession, d: str) -> DataFrame:
    li = _t(s, d, "lineitem")
    bridge = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("b"), "l_partkey").alias("chunk"), F.col("l_linenumber").alias("ranking"))
    own = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("ranking"), F.concat(F.lit("f"), "l_partkey").alias("chunk"))).alias("fragments"))
    asked = _t(s, d, "orders").select(F.col("o_orderkey").alias("id")).join(own, "id", "left")
    return X.best_fragment(asked, bridge)


def merged_metadata(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "customer")
    own = F.create_map(F.lit("name"), F.col("c_name"), F.lit("kind"), F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.lit("own")))
    other = F.create_map(F.lit("kind"), F.col("c_mktsegment"), F.lit("name"), F.lit("other"))
    m = X.merged_metadata(own, other)
    return c.select("c_custkey", m["name"].alias("name"), m["kind"].alias("kind"), F.size(m).alias("keys"))


def country_lookup(s: SparkSession, d: str) -> DataFrame:
    """JOI17: a dimension of 25 rows, unknown codes to a default."""
    names = _t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country"))
    sup = _t(s, d, "supplier").withColumn("k", F.when(F.col("s_suppkey") % 7 == 0, 99).otherwise(F.col("s_nationkey")))
    return sup.join(names, "k", "left").select("s_suppkey", F.coalesce("country", F.lit("SPAIN")).alias("country"))


def active_days(s: SparkSession, d: str) -> DataFrame:
    """SET05: days with a question or a login, once each."""
    e = _t(s, d, "events")
    logins = e.where("event_type = 'signup'").select("user_id", F.to_date(F.col("ts") + F.expr("interval 1 day")).alias("day"))
    return e.select("user_id", F.to_date("ts").alias("day")).union(logins).distinct().select("user_id", F.col("day").cast("string").alias("day"))


def display_names(s: SparkSession, d: str) -> DataFrame:
    """PRJ09, STR26: what a user is called."""
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    mail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_name"), F.lit("@example.com")))
    shown = F.coalesce(F.nullif(F.trim(name), F.lit("")), mail, F.concat(F.lit("Usuario "), "c_custkey"))
    return _t(s, d, "customer").select("c_custkey", shown.alias("shown"), F.upper(F.substring(shown, 1, 1)).alias("initial"))


def ordered_options(s: SparkSession, d: str) -> DataFrame:
    """SET01, SET06, ARR01: default and configured names once each in order, and those known."""
    names = F.array_distinct(F.concat(F.array(F.lit("A"), F.lit("R")), F.array_sort(F.collect_set("l_returnflag")), F.array_sort(F.collect_set("l_linestatus"))))
    return _t(s, d, "lineitem").groupBy("l_suppkey").agg(names.alias("n")).select("l_suppkey", F.array_join("n", ",").alias("names"), F.array_join(F.array_intersect("n", F.array(F.lit("O"), F.lit("R"))), ",").alias("known"))


def latest_done(s: SparkSession, d: str) -> DataFrame:
    """WIN05: the last finished job of each kind."""
    e = _t(s, d, "events").where("event_type in ('purchase', 'error')")
    return U.latest(e, ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id")


def owned(s: SparkSession, d: str) -> DataFrame:
    """JOI16: for each customer whether all of their orders are there and how many are open."""
    o = _t(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"))
    return _t(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") == F.col("open"), F.lit(False)).alias("all_open"))


QUERIES = {
    "tender_files": (
        tender_files,
        (
            "select p_brand number, 'Pliego ' || p_name as name, 'http://a/' || p_partkey url, (row_number() over (partition by p_brand order "
            "by p_partkey))::int nth from part where p_size % 2 = 0 and p_size % 3 != 0 union all select p_brand, p_name, 'http://a/' || "
            "p_partkey, 0 from part where p_size % 2 != 0 and p_size % 3 != 0 and lower(p_name) like '%pliego%'"
        ),
    ),
    "chunk_metadata": (
        chunk_metadata,
        (
            "select l_partkey document_id, l_returnflag sha256, (l_linenumber - 2)::int segment, max(l_orderkey * 10 + l_linenumber) seq from "
            "lineitem where l_returnflag != 'R' and l_linenumber >= 2 group by 1, 2, 3"
        ),
    ),
    "synced_documents": (
        synced_documents,
        (
            "select doc_id path, case lang when 'de' then 'new' else source end hash, case when lang in ('en', 'fr') then lang end markdown, "
            "case when lang in ('es', 'de') then 'cargado' else 'indexado' end status from documents"
        ),
    ),
    "job_states": (
        job_states,
        (
            "with l as (select user_id job, ts, case event_type when 'click' then 'running' when 'purchase' then 'done' when 'error' then "
            "'failed' else 'queued' end e from events) select job, arg_max(e, ts) status, min(ts) filter (e = 'running') started_at, max(ts) "
            "filter (e in ('done', 'failed')) finished_at from l group by 1"
        ),
    ),
    "response_times": (
        response_times,
        (
            "select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then l_quantity else greatest(0.0, epoch_us(l_shipdate) - "
            "epoch_us(case when l_linenumber % 2 = 0 then l_shipdate else o_orderdate end)) / 1e6 end as seconds from orders join lineitem on "
            "o_orderkey = l_orderkey"
        ),
    ),
    "best_fragment": (
        best_fragment,
        (
            "with f as (select l_orderkey id, 'f' || l_partkey chunk from lineitem where l_returnflag = 'R' qualify row_number() over "
            "(partition by l_orderkey order by case when l_linenumber = 2 then 0 else l_linenumber end, 'f' || l_partkey) = 1), b as (select "
            "l_orderkey id, 'b' || l_partkey chunk from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, 'b' "
            "|| l_partkey) = 1) select o_orderkey id, coalesce(f.chunk, b.chunk) chunk from orders left join f on f.id = o_orderkey left join "
            "b on b.id = o_orderkey"
        ),
    ),
    "merged_metadata": (merged_metadata, "select c_custkey, c_name as name, case c_custkey % 2 when 0 then c_mktsegment else 'own' end kind, 2::int keys from customer"),
    "country_lookup": (country_lookup, (
        "select s_suppkey, case when s_suppkey % 7 = 0 then 'SPAIN' else n_name end country from supplier join nation on s_nationkey = "
        "n_nationkey"
    )),
    "active_days": (active_days, (
        "select user_id, (ts::date)::varchar as day from events union select user_id, ((ts + interval 1 day)::date)::varchar from events "
        "where event_type = 'signup'"
    )),
    "display_names": (
        display_names,
        (
            "with x as (select c_custkey, case when c_custkey % 3 != 0 then c_name when c_custkey % 2 = 0 then lower(c_name) || '@example.com' "
            "else 'Usuario ' || c_custkey end shown from customer) select c_custkey, shown, upper(substr(shown, 1, 1)) initial from x"
        ),
    ),
    "ordered_options": (
        ordered_options,
        (
            "with x as (select l_suppkey, ['A', 'R'] || list_sort(list_filter(list(distinct l_returnflag), lambda v: v not in ('A', 'R'))) || "
            "list_sort(list_filter(list(distinct l_linestatus), lambda v: v not in ('A', 'R', 'N'))) n from lineitem group by 1) select "
            "l_suppkey, array_to_string(n, ',') as names, array_to_string(list_filter(n, lambda v: v in ('O', 'R')), ',') known from x"
        ),
    ),
    "latest_done": (latest_done, "select event_type, arg_max(event_id, ts) event_id from events where event_type in ('purchase', 'error') group by 1"),
    "ownership": (owned, (
        "select c_custkey, count(o_orderkey) n, count(o_orderkey) > 0 and count(o_orderkey) = count(*) filter (o_orderstatus = 'O') "
        "all_open from customer left join orders on c_custkey = o_custkey group by 1"
    )),
}
