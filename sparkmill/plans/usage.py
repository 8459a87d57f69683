"""Queries of usage analytics: ``events`` and ``orders`` stand for the question log, ``customer`` for its users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkmill.operators import retrieval as R, usage as U


def _log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    device = F.when(k % 3 == 0, "CPU").when(k % 3 == 1, "gpu")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", F.col("value").alias("seconds"), F.col("event_type").alias("model"), device.alias("device"), k.alias("tokens"))


def model_comparison(s: SparkSession, d: str) -> DataFrame:
    """AGG16: some jobs failed, some models have no name or spaces around it, one has no times, devices have long names."""
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.when(k % 11 == 0, F.when(k % 2 == 0, "")).when(k % 11 == 1, F.concat(F.lit(" "), "event_type", F.lit(" "))).otherwise(F.col("event_type"))
    device = F.when(k % 4 == 0, "cuda Gpu 0 with cpu").when(k % 4 == 1, "Cpu (2 threads)").when(k % 4 == 2, "none")
    rows = s.read.parquet(f"{d}/events.parquet").select("user_id", model.alias("model"), device.alias("device"), k.alias("tokens"), F.when(F.col("event_type") != "error", F.col("value")).alias("seconds"), F.when(k % 7 == 0, "failed").otherwise("done").alias("status"))
    return U.models(rows, "default")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("seconds"), F.col("o_orderpriority").alias("model"))


def _users(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, which both engines write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def users_by_country(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("country"))
    return U.per_country(_users(spark, d).join(nation, "nation")).select("country", "n", F.array_join("names", ",").alias("names"))


def history_page(spark: SparkSession, d: str) -> DataFrame:
    rows = U.history(_log(spark, d), day="2024-01-05", device="CPU")
    return R.page(rows, [F.desc("ts"), F.desc("event_id")], 2, 20).select("event_id", "user_id", "ts")


def latest_match_left_join(spark: SparkSession, d: str) -> DataFrame:
    """JOI02: each user's latest model, a dash for users without one."""
    last = U.latest(_log(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select(F.col("user_id").alias("id"), "model")
    return _users(spark, d).join(last, "id", "left").select("id", F.coalesce("model", F.lit("-")).alias("model"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Question jobs of the log: a purchase is a finished one, the device its model."""
    status = F.when(F.col("model") == "purchase", "done").otherwise("running")
    return _log(spark, d).select("user_id", (F.col("tokens") % 10).alias("question"), status.alias("status"), F.upper("device").alias("model"))


def semi_join_exists_model(spark: SparkSession, d: str) -> DataFrame:
    """JOI01: views for which a finished job of the same user and question used a model."""
    views = _log(spark, d).where("model = 'view'").withColumn("question", F.col("tokens") % 10)
    return U.used_model(views, _jobs(spark, d), "GPU").select("event_id", "user_id")


def history_filtered(spark: SparkSession, d: str) -> DataFrame:
    """FLT08, FLT10: all filters of the history at once."""
    rows = _log(spark, d).withColumn("question", F.col("tokens") % 10)
    return U.history(rows, user_id=1, device="GPU", jobs=_jobs(spark, d), model="CPU").select("event_id")


def history_sorted(spark: SparkSession, d: str) -> DataFrame:
    """SRT04: each user's place of a row in the four orders of the history; an unknown order is the first."""
    places = {name: F.row_number().over(Window.partitionBy("user_id").orderBy(*R.history_order(name), "event_id")) for name in ("date_desc", "date_asc", "time_desc", "time_asc", "unknown")}
    return _log(spark, d).withColumns(places).select("event_id", *places)


def activity_streak(spark: SparkSession, d: str) -> DataFrame:
    logins = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'").groupBy(F.col("user_id").alias("id")).agg((F.max("ts") + F.expr("interval 1 day")).alias("last_login"))
    users = _users(spark, d).join(logins, "id", "left").select(F.col("id").alias("user_id"), "last_login")
    return _dated(U.streaks(_log(spark, d).select("user_id", F.to_date("ts").alias("day")), users))


def summary_by_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG16's grand summary beside its models."""
    return _log(spark, d).rollup("model").agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg("seconds"), 2).alias("avg_seconds")).select(F.coalesce("model", F.lit("(all)")).alias("model"), "uses", "avg_seconds")


def shares(spark: SparkSession, d: str) -> DataFrame:
    """AGG30: each model's share of all and of the most used."""
    own = _log(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))
    return own.select("model", "n", F.round(F.col("n") / F.sum("n").over(every), 4).alias("share"), F.round(F.col("n") / F.max("n").over(every), 4).alias("heat"))


_JSON = "(props->>'k')::bigint"
_LOG = (
    f"(select event_id, user_id, ts, value as seconds, event_type as model, case {_JSON} % 3 when 0 then 'CPU' when 1 then 'GPU' end "
    f"device, {_JSON} tokens from events)"
)
_DAYS = "(select unnest(generate_series((select min(ts)::date from events), (select max(ts)::date from events), interval 1 day))::date as day)"
_MONTHS = (
    "(select unnest(generate_series((select date_trunc('month', max(o_orderdate)) - interval 11 month from orders), (select "
    "date_trunc('month', max(o_orderdate)) from orders), interval 1 month))::date as month)"
)

QUERIES = {
    "usage_summary": (lambda s, d: U.summary(_log(s, d)), (
        "select count(*) total, coalesce(round(avg(value), 2), 0) avg_seconds, count(distinct ts::date) active_days, min(ts) first_ts, "
        "max(ts) last_ts from events"
    )),
    "monthly_counts_12m": (
        lambda s, d: _dated(U.by_month(_orders(s, d))),
        (
            f"select month::varchar as month, coalesce(n, 0) n, coalesce(round(s, 2), 0.0) avg_seconds from {_MONTHS} left join (select "
            f"date_trunc('month', o_orderdate)::date as month, count(*) n, avg(o_totalprice) s from orders group by 1) using (month)"
        ),
    ),
    "daily_counts": (lambda s, d: _dated(U.by_day(_log(s, d))), (
        f"select day::varchar as day, coalesce(n, 0) n, coalesce(round(s, 2), 0.0) avg_seconds from {_DAYS} left join (select ts::date as "
        f"day, count(*) n, avg(value) s from events group by 1) using (day)"
    )),
    "day_hour_matrix": (
        lambda s, d: _dated(U.by_day_and_hour(_log(s, d))),
        (
            f"select day::varchar as day, hour::int as hour, coalesce(n, 0) n from (select day, unnest(generate_series(0, 23)) as hour from "
            f"{_DAYS}) left join (select ts::date as day, hour(ts) as hour, count(*) n from events group by 1, 2) using (day, hour)"
        ),
    ),
    "weekday_hist": (lambda s, d: U.histogram(_log(s, d), F.weekday("ts"), 7), (
        "select b::int bucket, coalesce(n, 0) n from (select unnest(generate_series(0, 6)) b) left join (select isodow(ts) - 1 b, count(*) "
        "n from events group by 1) using (b)"
    )),
    "hour_hist": (lambda s, d: U.histogram(_log(s, d), F.hour("ts"), 24), (
        "select b::int bucket, coalesce(n, 0) n from (select unnest(generate_series(0, 23)) b) left join (select hour(ts) b, count(*) n "
        "from events group by 1) using (b)"
    )),
    "counts_zero_filled": (lambda s, d: U.per_user(_log(s, d), _users(s, d)), "select c_custkey id, c_name as name, count(event_id) n from customer left join events on c_custkey = user_id group by 1, 2"),
    "counts_per_user": (lambda s, d: U.per_user(_log(s, d), _users(s, d), zeros=False), "select c_custkey id, c_name as name, count(*) n from customer join events on c_custkey = user_id group by 1, 2"),
    "top10_users": (lambda s, d: U.top_users(_log(s, d), _users(s, d)), "select c_name as name, count(*)::bigint n from customer join events on c_custkey = user_id group by 1 order by 2 desc, 1 limit 10"),
    "user_distribution": (
        lambda s, d: U.distribution(U.per_user(_log(s, d), _users(s, d), zeros=False)),
        (
            "select round(avg(n), 2) mean, round(median(n), 2) median, coalesce(round(var_samp(n), 2), 0.0) variance from (select user_id, "
            "count(*) n from events group by 1)"
        ),
    ),
    "users_by_country": (users_by_country, (
        "select n_name country, count(*) n, array_to_string(list_sort(list(c_name)), ',') names from customer join nation on c_nationkey = "
        "n_nationkey group by 1"
    )),
    "month_calendar": (
        lambda s, d: _dated(U.calendar(_log(s, d))),
        (
            "with t as (select max(ts)::date today from events), m as (select today, unnest(generate_series(date_trunc('month', today), "
            "last_day(today), interval 1 day))::date as day from t), c as (select day, today, coalesce(n, 0) n from m left join (select "
            "ts::date as day, count(*) n from events group by 1) using (day)) select day::varchar as day, n, round(n / max(n) over (), 2) "
            "intensity, day = today is_today, (isodow(day) - 1)::int as weekday, ((day(day) - 1 + isodow(date_trunc('month', day)) - 1) // "
            "7)::int as week from c"
        ),
    ),
    "activity_streak": (
        activity_streak,
        """with l as (select user_id, max(ts) + interval 1 day seen from events where event_type = 'signup' group by 1),
        x as (select user_id, ts::date as day from events union select user_id, seen::date from l),
        g as (select *, day - (row_number() over (partition by user_id order by day))::int run from x),
        r as (select user_id, run, count(*) as days, max(day) l from g group by 1, 2),
        s as (select user_id, arg_max(days, l) streak, max(l) last_day from r group by 1)
        select c_custkey user_id, coalesce(streak, 0) streak, last_day::varchar last_day from customer left join s on c_custkey = user_id""",
    ),
    "model_comparison": (
        model_comparison,
        """with x as (select *, (props->>'k')::bigint k from events), y as (
            select user_id, k, case when event_type != 'error' then value end as secs, trim(case k % 11 when 0 then 'default' else event_type end) model from x where k % 7 != 0
        ) select model, count(*) uses, count(distinct user_id) users, sum(k)::bigint tokens, coalesce(round(avg(secs), 2), 0) avg_seconds, count(*) filter (k % 4 = 0) gpu, count(*) filter (k % 4 = 1) cpu, count(*) filter (k % 4 > 1) "unknown" from y group by 1""",
    ),
    "model_summary_rollup": (summary_by_rollup, (
        "select coalesce(event_type, '(all)') model, count(*) uses, round(avg(value), 2) avg_seconds from events group by rollup "
        "(event_type)"
    )),
    "model_shares": (shares, (
        "select event_type model, count(*) n, round(count(*) / sum(count(*)) over (), 4) share, round(count(*) / max(count(*)) over (), 4) "
        "heat from events group by 1"
    )),
    "model_month_pivot": (
        lambda s, d: U.model_months(_orders(s, d)),
        (
            "with t as (select max(date_trunc('month', o_orderdate)) last from orders), o as (select o_orderpriority model, 12 - "
            "date_diff('month', o_orderdate, last) nth from orders, t) select model, "
        )
        + ", ".join(f"count(*) filter (nth = {i}) m{i:02}" for i in range(1, 13))
        + " from o where nth > 0 group by 1",
    ),
    "weekly_weighted_avg": (
        lambda s, d: _dated(U.weekly(_log(s, d))),
        (
            "select date_trunc('week', day)::date::varchar as week, sum(n)::bigint n, round(sum(n * s) / sum(n), 2) avg_seconds from (select "
            "ts::date as day, count(*) n, avg(value) s from events group by 1) group by 1"
        ),
    ),
    "percentiles_by_stage": (
        lambda s, d: U.timings(_log(s, d), "model").select("stage", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95"))),
        (
            "select event_type stage, count(*) n, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, "
            "round(quantile_cont(value, 0.95), 6) p95 from events group by 1"
        ),
    ),
    "history_page": (
        history_page,
        "select event_id, user_id, ts from (select event_id, user_id, ts, row_number() over (order by ts desc, event_id desc) p, count(*) over () c"
        f" from {_LOG} where ts >= '2024-01-05' and ts < '2024-01-06' and device = 'CPU') where ceil(p / 20) = least(2, greatest(1, ceil(c / 20)))",
    ),
    "history_filtered": (
        history_filtered,
        (
            f"select event_id from {_LOG} v where user_id = 1 and device = 'GPU' and exists (select 1 from {_LOG} p where p.user_id = v.user_id "
            f"and p.tokens % 10 = v.tokens % 10 and p.model = 'purchase' and p.device = 'CPU')"
        ),
    ),
    "history_sorted": (
        history_sorted,
        f"""select event_id, (row_number() over (partition by user_id order by ts desc, event_id))::int date_desc, (row_number() over (partition by user_id order by ts, event_id))::int date_asc,
        (row_number() over (partition by user_id order by seconds desc, event_id))::int time_desc, (row_number() over (partition by user_id order by seconds, event_id))::int time_asc,
        (row_number() over (partition by user_id order by ts desc, event_id))::int as "unknown" from {_LOG}""",
    ),
    "query_donut": (lambda s, d: U.donut(_log(s, d), 1), "select count(*) filter (user_id = 1) mine, count(*) filter (user_id != 1) others from events"),
    "latest_match_left_join": (
        latest_match_left_join,
        (
            "select c_custkey id, coalesce(event_type, '-') model from customer left join (select user_id, event_type from events qualify "
            "row_number() over (partition by user_id order by ts desc, event_id desc) = 1) on c_custkey = user_id"
        ),
    ),
    "semi_join_exists_model": (
        semi_join_exists_model,
        (
            f"select event_id, user_id from {_LOG} v where model = 'view' and exists (select 1 from {_LOG} p where p.user_id = v.user_id and "
            f"p.tokens % 10 = v.tokens % 10 and p.model = 'purchase' and p.device = 'GPU')"
        ),
    ),
    "job_progress": (
        lambda s, d: U.progress(_log(s, d), "user_id", "event_id").select("event_id", "percent"),
        "select event_id, floor(100 * row_number() over (partition by user_id order by event_id) / count(*) over (partition by user_id))::int percent from events",
    ),
    "axis_ticks": (
        lambda s, d: _dated(U.ticks(U.by_day(_log(s, d)), "day", 8).select("day", "n")),
        (
            f"select day::varchar as day, n from (select day, coalesce(n, 0) n, row_number() over (order by day) p, count(*) over () c from "
            f"{_DAYS} left join (select ts::date as day, count(*) n from events group by 1) using (day)) where (p - 1) % ceil(c / 8)::int = 0 "
            f"or p = c"
        ),
    ),
}
