"""Usage analytics over a log of questions (user_id, ts, seconds, model, device): spines, tops, distributions, streaks.

Every time series is an aggregate of at most one row a day, month or hour, joined with its spine after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def summary(log: DataFrame) -> DataFrame:
    """AGG02: questions, mean seconds, active days, first and last time; zeros and nulls for an empty log."""
    return log.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg(F.coalesce("seconds", F.lit(0.0))), 2), F.lit(0.0)).alias("avg_seconds"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def month_spine(log: DataFrame, months: int = 12) -> DataFrame:
    """WIN06: the last months up to that of the log's last row."""
    last = log.agg(F.trunc(F.to_date(F.max("ts")), "month").alias("last")).where("last is not null")
    return last.select(F.explode(F.sequence(F.add_months("last", 1 - months), F.col("last"), F.expr("interval 1 month"))).alias("month"))


def by_month(log: DataFrame, months: int = 12) -> DataFrame:
    """AGG03, AGG04: questions and mean seconds of each of the last months, zeros where there are none."""
    own = log.groupBy(F.trunc(F.to_date("ts"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("s"))
    return month_spine(log, months).join(own, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("avg_seconds"))


def day_spine(log: DataFrame) -> DataFrame:
    span = log.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("day"))


def by_day(log: DataFrame) -> DataFrame:
    """AGG05, AGG06: questions and mean seconds of every day of the log's span."""
    own = log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("s"))
    return day_spine(log).join(own, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("avg_seconds"))


def by_day_12m(log: DataFrame) -> DataFrame:
    """AGG05, AGG06: questions and mean seconds of every day of the twelve months up to the log's last, days without any too."""
    last = log.agg(F.to_date(F.max("ts")).alias("b")).where("b is not null")
    days = last.select(F.explode(F.sequence(F.add_months(F.trunc("b", "month"), -11), F.last_day("b"))).alias("day"))
    own = log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("s"))
    return days.join(own, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("avg_seconds"))


def by_day_and_hour(log: DataFrame) -> DataFrame:
    """AGG07: questions of every hour of every day."""
    own = log.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = day_spine(log).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spine.join(own, ["day", "hour"], "left").select("day", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(log: DataFrame, bucket: Column, size: int) -> DataFrame:
    """AGG08, AGG09: questions in each of ``size`` buckets, empty ones too."""
    own = log.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return log.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(own, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def per_user(log: DataFrame, users: DataFrame, zeros: bool = True) -> DataFrame:
    """AGG01, JOI06, JOI07: questions of each user (id, name), those without any too unless ``zeros`` is off."""
    own = log.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return users.join(own, "id", "left" if zeros else "inner").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def top_users(log: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """AGG10: the k names with most questions; homonyms are one."""
    own = log.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(users, "id")
    return own.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def distribution(counts: DataFrame) -> DataFrame:
    """AGG11: mean, median and sample variance of n; variance 0 for one row, zeros for none."""
    zero = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    return counts.agg(zero(F.avg("n")).alias("mean"), zero(F.median("n")).alias("median"), zero(F.var_samp("n")).alias("variance"))


def per_country(users: DataFrame) -> DataFrame:
    """AGG12: users of each country and their names, sorted."""
    return users.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("name") != "", F.col("name")))).alias("names"))


def calendar(log: DataFrame) -> DataFrame:
    """AGG13, WIN07: every day of the last month: questions, share of the busiest day, weekday from Monday and week row."""
    last = log.agg(F.to_date(F.max("ts")).alias("today")).where("today is not null")
    days = last.select("today", F.explode(F.sequence(F.trunc("today", "month"), F.last_day("today"))).alias("day"))
    own = log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = days.join(own, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.max("n").over(Window.partitionBy("today"))
    blank = F.weekday(F.trunc("day", "month"))
    return out.select("day", "n", F.when(most > 0, F.round(F.col("n") / most, 2)).otherwise(0.0).alias("intensity"), (F.col("day") == F.col("today")).alias("is_today"), F.weekday("day").alias("weekday"), F.floor((F.dayofmonth("day") - 1 + blank) / 7).cast("int").alias("week"))


def streaks(active: DataFrame, users: DataFrame) -> DataFrame:
    """WIN02: for each user (user_id, last_login) the length of the run of consecutive days up to their last active one.

    active: (user_id, day). A last login counts as an active day; users without any day have 0.
    """
    logins = users.where("last_login is not null").select("user_id", F.to_date("last_login").alias("day"))
    days = active.select("user_id", "day").unionByName(logins).distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = days.withColumn("run", run).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("days"), F.max("day").alias("last"))
    last = runs.groupBy("user_id").agg(F.max_by("days", "last").alias("streak"), F.max("last").alias("last_day"))
    return users.select("user_id").join(last, "user_id", "left").select("user_id", F.coalesce("streak", F.lit(0)).alias("streak"), "last_day")


def models(log: DataFrame, default: str = "") -> DataFrame:
    """AGG16: uses, users, tokens, mean seconds and devices of each model, over finished jobs if the log has a status.

    A model's name is trimmed, ``default`` stands for none. A device is a GPU or a CPU if its name holds that in any
    case, GPU first. The mean is 0 where no time is known.
    """
    done = log.where("status = 'done'") if "status" in log.columns else log
    device = F.upper(F.coalesce("device", F.lit("")))
    gpu, cpu = device.contains("GPU"), device.contains("CPU")
    return done.groupBy(F.trim(F.coalesce(F.nullif("model", F.lit("")), F.lit(default))).alias("model")).agg(
        F.count(F.lit(1)).alias("uses"),
        F.countDistinct("user_id").alias("users"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.round(F.avg("seconds"), 2), F.lit(0.0)).alias("avg_seconds"),
        F.count(F.when(gpu, 1)).alias("gpu"),
        F.count(F.when(~gpu & cpu, 1)).alias("cpu"),
        F.count(F.when(~gpu & ~cpu, 1)).alias("unknown"),
    )


def model_months(log: DataFrame, months: int = 12) -> DataFrame:
    """AGG17: uses of each model in the last months up to the log's last, a column a month (m01 the oldest); older rows are dropped."""
    month = F.year("ts") * 12 + F.month("ts")
    last = log.agg(F.max(month).alias("last")).scalar()
    own = log.withColumn("nth", month - last + months).where(F.col("nth") > 0)
    counts = own.groupBy("model").pivot("nth", list(range(1, months + 1))).count().fillna(0)
    return counts.withColumnsRenamed({str(i): f"m{i:02}" for i in range(1, months + 1)})


def weekly(log: DataFrame) -> DataFrame:
    """AGG29, JOI15: questions of each Monday week and their mean seconds, weighted by the days' counts."""
    days = log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("s"))
    return days.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("s")) / F.sum("n"), 2).alias("avg_seconds"))


def timings(log: DataFrame, stage: str) -> DataFrame:
    """AGG25, AGG26: rows, mean, median and 95th percentile of the seconds of each stage."""
    return log.groupBy(F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"), F.percentile("seconds", 0.5).alias("p50"), F.percentile("seconds", 0.95).alias("p95"))


def used_model(log: DataFrame, jobs: DataFrame, model: str) -> DataFrame:
    """JOI01: rows of the log (user_id, question) for which a finished job (user_id, question, status, model) used the model."""
    done = jobs.where((F.col("status") == "done") & (F.col("model") == model)).select("user_id", "question").distinct()
    return log.join(done, ["user_id", "question"], "left_semi")


def history(log: DataFrame, user_id: int | None = None, day: str | None = None, device: str | None = None, jobs: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """FLT08, FLT10: a user's rows of one day on one device, answered by one model; what is not given does not filter."""
    if jobs is not None and model:
        log = used_model(log, jobs, model)
    if user_id is not None:
        log = log.where(F.col("user_id") == user_id)
    if day is not None:
        start = F.to_date(F.lit(day)).cast("timestamp_ntz")
        log = log.where((F.col("ts") >= start) & (F.col("ts") < F.date_add(F.to_date(F.lit(day)), 1).cast("timestamp_ntz")))
    if device in ("CPU", "GPU"):
        log = log.where(F.upper("device") == device)
    return log


def donut(log: DataFrame, user_id: int) -> DataFrame:
    """AGG15: a user's questions and those of all others."""
    mine = F.count(F.when(F.col("user_id") == user_id, 1))
    return log.agg(mine.alias("mine"), F.greatest(F.count(F.lit(1)) - mine, F.lit(0)).alias("others"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """WIN04, WIN05, JOI02: the first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def progress(rows: DataFrame, key: str, order: str) -> DataFrame:
    """WIN08: how much of its key's rows is done at each row, in whole per cent."""
    w = Window.partitionBy(key)
    return rows.withColumn("percent", F.floor(100 * F.row_number().over(w.orderBy(order)) / F.count(F.lit(1)).over(w)).cast("int"))


def ticks(rows: DataFrame, order: str, most: int) -> DataFrame:
    """SRT14: every n-th row so that about ``most`` remain, and the last; rows are those of one chart."""
    every = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) / most)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return rows.withColumns({"__e": every, "__p": place, "__n": n}).where("(__p - 1) % __e = 0 or __p = __n").drop("__e", "__p", "__n")
