"""URL filters [native]: rules by host and path, else an Empirical-Bayes reputation of the host.

Labelled page outcomes (good or not) give every host a beta posterior. Its prior is centred on the registered
domain's shrunk rate, the domain's on its suffix's, the suffix's on the overall rate; how much weight each prior has
is estimated from how far the rates at this level spread beyond chance (the beta-binomial's moments). A host without
outcomes has its prior: what its domain, else its suffix, else all pages say. A page is blocked if the posterior's
upper bound says that its host is mostly bad, otherwise allowed.

Only SQL functions run here. Pages meet the host table through a join that Spark can split where one host is hot;
the counts are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import scratch

#: (rule, what it does)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Suffixes of two labels under which names are registered; any other last label is a suffix. Fixed values.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: A host is bad if the upper bound of its share of good pages is below MIN_GOOD; the bound lies Z deviations above the mean.
MIN_GOOD, Z = 0.5, 1.645
#: Weight of a prior, in pages, is kept within these.
WEIGHTS = (1.0, 1000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "://([^/?#]*)([^?#]*)"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` of ``url``; null or without ``://``: both empty."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), "path": F.regexp_extract(url, _URL, 2)})


def _rule(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict), or null."""
    fits = []
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        within = (host == name) | F.endswith(host, F.lit("." + name))
        fits.append(F.when(within & F.startswith(path, F.lit("/" + rest)), F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def _domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    last_two, last_three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    long = last_two.isin(*LONG_SUFFIXES)
    return F.when(long, last_two).otherwise(F.substring_index(host, ".", -1)), F.when(long, last_three).otherwise(last_two)


def _weight(level: DataFrame) -> Column:
    """Prior weight for rows (n, k, p0): pages n, good ones k, and the rate p0 expected from the level above, as one aggregate.

    The moments of the beta-binomial: sum n (k/n - p0)^2 / (p0 (1 - p0)) is one a row for binomial rows and grows with
    the correlation rho within rows; the weight is 1 / rho - 1.
    """
    inside = F.col("p0") * (1 - F.col("p0"))
    chi = F.sum(F.when(inside > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p0"), 2) / inside).otherwise(0.0))
    extra = F.sum(F.when(inside > 0, F.col("n") - 1).otherwise(0))
    rows = F.sum(F.when(inside > 0, 1).otherwise(0))
    rho = F.when(extra > 0, (chi - rows) / extra).otherwise(0.0)
    low, high = WEIGHTS
    return F.when(rho * (high + 1) <= 1, high).otherwise(F.greatest(F.lit(low), 1 / rho - 1))


def reputation(labelled: DataFrame, judged: DataFrame) -> DataFrame:
    """Posterior of every host of labelled (host, good) and judged (host): (host, n, k, mean, upper, bad).

    A host without outcomes has n = 0. Rows with a null outcome do not count, a null host is left out; without any
    outcomes the posterior is null.
    """
    suffix, domain = _domain(F.col("host"))
    outcome = F.col("good").cast("long")
    rows = labelled.where("good is not null").select("host", F.lit(1).alias("n"), outcome.alias("k")).unionByName(judged.select("host", F.lit(0).alias("n"), F.lit(0).cast("long").alias("k")))
    hosts = rows.where("host is not null").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumns({"suffix": suffix, "domain": domain})
    hosts = scratch.keep(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.try_divide(F.sum("k"), F.sum("n")).alias("p"))

    def shrunk(level: DataFrame) -> DataFrame:
        """Rows with p0 get the weight of their prior, m, and the rate after it, p."""
        m = level.where("n > 0").agg(_weight(level).alias("m")).scalar()
        return level.withColumn("m", m).withColumn("p", (F.col("k") + F.col("m") * F.col("p0")) / (F.col("n") + F.col("m")))

    suffixes = shrunk(suffixes.withColumn("p0", overall.scalar()))
    domains = scratch.keep(shrunk(domains.join(suffixes.select("suffix", F.col("p").alias("p0")), "suffix")), "domains")
    hosts = shrunk(hosts.join(domains.select("domain", F.col("p").alias("p0")), "domain"))
    spread = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") + F.col("m") + 1))
    return hosts.select("host", "n", "k", F.col("p").alias("mean"), (F.col("p") + Z * spread).alias("upper"), (F.col("p") + Z * spread < MIN_GOOD).alias("bad"))


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url; other columns do not matter): page_id, host, path, rule, verdict.

    labelled: (url, good) outcomes of pages. A rule decides where one fits (the longest; of equally long ones the
    later by name), else the host's posterior; without any outcomes pages are allowed. Null urls have an empty host and
    are judged like any other host; repeated rows are judged each for itself.
    """
    with scratch.steps(pages.sparkSession):
        return _judged(pages, labelled, rules)


def _judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    pages = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path")
    found = pages.withColumn("found", _rule(rules, F.col("host"), F.col("path")))
    outcomes = with_host_and_path(labelled.select("url", "good")).select("host", "good")
    known = scratch.keep(reputation(outcomes, pages.select("host")).where("bad").select("host", "bad"), "bad-hosts", stay=True)
    out = found.join(known, "host", "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op1_url_filter``: every page; a page's outcome is the quality of the document with its number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return judged(pages, pages.select("page_id", "url").join(good, "page_id").select("url", "good"))


def _weight_sql(level: str) -> str:
    """:func:`_weight` of a table (n, k, p0)."""
    inside = "p0 * (1 - p0) > 0"
    return f"""
    select case when rho * 1001 <= 1 then 1000.0 else greatest(1.0, 1 / rho - 1) end m from (
        select case when extra > 0 then (chi - hosts) / extra else 0 end rho from (
            select sum(case when {inside} then n * pow(k / n - p0, 2) / (p0 * (1 - p0)) else 0 end) chi, sum(case when {inside} then n - 1 else 0 end) extra, sum(case when {inside} then 1 else 0 end) hosts
            from {level} where n > 0
        )
    )"""


SQL = f"""
with u as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) path
    from pages
), rules(rule, name, start, verdict) as (values
    ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
    ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), hit as (
    select distinct host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
    from (select distinct host, path from u) x join rules on (host = name or ends_with(host, '.' || name)) and starts_with(path, start) group by host, path
), split as (
    select host, count(quality) n, count(*) filter (quality = 1) k, string_split(host, '.') part,
        case when array_to_string(part[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') then 2 else 1 end tail
    from u left join labels on page_id = doc_id group by host
), h as (
    select host, n, k, array_to_string(part[-tail:], '.') suffix, array_to_string(part[-(tail + 1):], '.') domain from split
), d0 as (select suffix, domain, sum(n) n, sum(k) k from h group by suffix, domain)
, s0 as (select suffix, sum(n) n, sum(k) k from d0 group by suffix)
, s1 as (select *, (select sum(k) / sum(n) from s0) p0 from s0)
, sm as ({_weight_sql('s1')})
, s as (select suffix, (k + m * p0) / (n + m) p from s1, sm)
, d1 as (select domain, n, k, p p0 from d0 join s using (suffix))
, dm as ({_weight_sql('d1')})
, d as (select domain, (k + m * p0) / (n + m) p from d1, dm)
, h1 as (select host, n, k, p p0 from h join d using (domain))
, hm as ({_weight_sql('h1')})
, post as (select host, (k + m * p0) / (n + m) p, n + m + 1 w from h1, hm)
select page_id, u.host, u.path, rule, coalesce(verdict, case when p + 1.645 * sqrt(p * (1 - p) / w) < 0.5 then 'block' else 'allow' end) verdict
from u left join hit on u.host = hit.host and u.path = hit.path left join post on u.host = post.host
"""
