"""Records around questions and users: projections with defaults, merges, look-ups and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def users(table: DataFrame, name: str | None = None, countries: list[str] | DataFrame | None = None, admin: bool | None = None) -> DataFrame:
    """FLT07, FLT09, SRT08: users by part of their name, country (names, or a table of them) and role, in the order of name and id."""
    if name:
        table = table.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if isinstance(countries, DataFrame):
        table = table.join(countries, "country", "left_semi")
    elif countries:
        table = table.where(F.col("country").isin(*countries))
    if admin is not None:
        table = table.where(F.col("is_admin") == admin)
    return table.orderBy("name", "id")


def best_or_empty(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """PRJ02: each asked qid with its best hit (qid, id, score), or the record that stands for none."""
    top = hits.groupBy("qid").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("b"))
    empty = F.struct(F.lit(-1).cast("long").alias("id"), F.lit(0.0).alias("score"))
    return asked.join(top, "qid", "left").select("qid", F.coalesce("b", empty).alias("b")).select("qid", "b.id", "b.score")


def json_number(c: Column) -> Column:
    """PRJ03: a number as JSON can hold it; NaN and infinite ones are null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def json_safe(value: Column, kind: T.DataType) -> Column:
    """PRJ03: a value of any nested kind as JSON can hold it: keys of maps as text, NaN and infinite numbers null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return json_number(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: json_safe(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_keys(F.transform_values(value, lambda _, v: json_safe(v, kind.valueType)), lambda k, _: k.cast("string"))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def json_text(rows: DataFrame, nested: Column) -> Column:
    """PRJ03: a map, array or struct of rows as JSON text, whatever it holds; null members stay."""
    kind = rows.select(nested.alias("x")).schema["x"].dataType
    return F.to_json(json_safe(nested, kind), {"ignoreNullFields": "false"})


def merged_by_question(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """JOI03: rows (question) with the score of the judged row (question, seq, score) of the same trimmed text, the last by seq."""
    last = judged.groupBy(F.trim("question").alias("__q")).agg(F.max_by("score", "seq").alias("score"))
    return rows.join(last, F.trim("question") == F.col("__q"), "left").drop("__q")


def payloads(table: DataFrame, ids: DataFrame) -> DataFrame:
    """JOI09: rows of the wanted ids; blank and unknown ones give none."""
    wanted = ids.where(F.coalesce(F.trim("id"), F.lit("")) != "").select(F.trim("id").alias("id")).distinct()
    return table.join(wanted, "id")


def home_metrics(log: DataFrame) -> DataFrame:
    """AGG14: each user's questions, models, active days, mean seconds (null as 0) and last day."""
    return log.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(F.nullif(F.trim("model"), F.lit(""))).alias("models"),
        F.countDistinct(F.to_date("ts")).alias("active_days"),
        F.round(F.avg(F.coalesce("seconds", F.lit(0.0))), 2).alias("avg_seconds"),
        F.max(F.to_date("ts")).alias("last_day"),
    )


def stored_fragments(answers: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """SNK08, SRT12: answers with their first k fragments by rank, and a bridge row (id, chunk, ranking) for each fragment."""
    ordered = F.array_sort(F.transform("fragments", lambda x: F.struct(x["ranking"].alias("ranking"), x["chunk"].alias("chunk"))))
    kept = answers.withColumn("fragments", F.slice(ordered, 1, k))
    return kept, kept.select("id", F.explode("fragments").alias("f")).select("id", "f.chunk", "f.ranking")


def logged_in(table: DataFrame, logins: DataFrame) -> DataFrame:
    """UPD01: users (id, login_count, last_login) after the logins (id, ts)."""
    new = logins.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__t"))
    return table.join(new, "id", "left").select("id", (F.col("login_count") + F.coalesce("__n", F.lit(0))).alias("login_count"), F.greatest("last_login", "__t").alias("last_login"))


def failed_if_stale(jobs: DataFrame, boot: Column) -> DataFrame:
    """FSM03: jobs (status, started, created) with those that were active before the process began as failed."""
    stale = F.col("status").isin("queued", "running") & (F.coalesce("started", "created") < boot)
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def routed(c: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """STR20: the target of the first keyword that a text holds."""
    out = None
    for word, target in routes:
        found = F.contains(F.lower(c), F.lit(word))
        out = F.when(found, target) if out is None else out.when(found, target)
    return F.lit(default) if out is None else out.otherwise(default)


def error_detail(body: Column, most: int = 500) -> Column:
    """JSN01, JSN06: the first of error, message and detail of a JSON body, cut."""
    return F.substring(F.coalesce(*(F.get_json_object(body, f"$.{k}") for k in ("error", "message", "detail"))), 1, most)


def device_of(body: Column, model: Column, default: Column) -> Column:
    """JSN04: GPU if the model of this name holds video memory, CPU if not, the default without such a model."""
    found = F.filter(F.from_json(body, "array<struct<name:string,size_vram:bigint>>"), lambda m: F.lower(F.trim(m["name"])) == F.lower(F.trim(model)))
    first = F.get(found, F.lit(0))
    return F.when(first.isNull(), default).when(F.coalesce(first["size_vram"], F.lit(0)) > 0, "GPU").otherwise("CPU")


def translated(keys: DataFrame, texts: DataFrame, language: str, default: str) -> DataFrame:
    """JOI18: keys (key, arg) with their text in a language, else in the default one, else the key; ``{arg}`` filled in. texts: (language, key, text)."""
    pick = lambda lang, name: texts.where(F.col("language") == lang).select("key", F.col("text").alias(name))
    out = keys.join(pick(language, "__a"), "key", "left").join(pick(default, "__b"), "key", "left")
    return out.select("key", "arg", F.replace(F.coalesce("__a", "__b", "key"), F.lit("{arg}"), F.col("arg").cast("string")).alias("shown"))


def ranked_with_rest(counts: DataFrame, k: int) -> DataFrame:
    """SRT07: the k largest (name, n) that are above zero after the limit."""
    return counts.orderBy(F.desc("n"), "name").limit(k).where("n > 0")


def shuffled(rows: DataFrame, key: str, most: int, seed: int = 7) -> DataFrame:
    """SRT13: the first ``most`` rows of each key in an order that looks random but is always the same."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(F.lit(seed), *rows.columns)))
    return rows.withColumn("__p", place).where(F.col("__p") <= most).drop("__p")
