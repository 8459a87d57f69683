"""License scans [native]: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

A text is a sequence of terms, whatever its lines. Every run of as many terms as a template has is a possible notice,
so a header or licence file is found however it is wrapped and whatever stands before and after it. A run reaches the
threshold with a template only if its text holds one of the template's longer terms, and terms with enough weight
together (no others can give that cosine): two filters of words, without a shuffle, pass on the few texts that do. Their terms
are weighted, summed along the text, and the runs with enough weight get their exact cosine. Licence files declare
their best licence for their directory, and every directory takes the nearest one above it: its ancestors are joined
with the declaring directories by path.

Only SQL functions run here.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import scratch

#: Licence and the notice that stands for it. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD = 0.7
#: Words on which the filter of texts does not depend where it can do without them. Fixed values.
COMMON = ("a", "and", "are", "be", "by", "for", "in", "is", "of", "or", "that", "the", "this", "to", "under", "use", "v", "with", "without", "work")
#: Names of files that declare a licence for their directory.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$"
#: Directories up to which the table of their licences is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

_TERM = "[a-z0-9]+"


def _terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


class Model:
    """Templates as weighted terms.

    names, lengths: of the templates; shares: for each term its weight and its share in each unit template; other: the
    weight of any other term; needed: terms of which every run at the threshold holds one.
    """

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.names = sorted(templates)
        bags = [_terms(templates[n]) for n in self.names]
        self.lengths = [len(b) for b in bags]
        weight = {t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1 for b in bags for t in b}
        self.shares: dict[str, tuple[float, list[float]]] = {t: (w, [0.0] * len(bags)) for t, w in weight.items()}
        self.other = math.log(1 + len(bags)) + 1
        needed: set[str] = set()
        for i, bag in enumerate(bags):
            value = {t: bag.count(t) * weight[t] for t in bag}
            norm = math.sqrt(sum(x * x for x in value.values()))
            light = 0.0
            for t, x in sorted(value.items(), key=lambda p: (p[0] not in COMMON, len(p[0]), p[0])):  # these and short ones stand in most texts
                self.shares[t][1][i] = x / norm
                if math.sqrt(light + (x / norm) ** 2) < threshold - 1e-9:
                    light += (x / norm) ** 2  # these together do not reach the threshold
                else:
                    needed.add(t)
        self.needed = sorted(needed)


def _noticed(files: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The files of which a run may reach the threshold, with a number (uid)."""
    low = F.lower("text")  # of a text in A-Z and other letters, a superset
    # a run's cosine to a template is at most the root of the squared shares of the terms that both hold
    squares = [F.create_map(*(F.lit(x) for t, (_, s) in model.shares.items() if s[i] for x in (t, s[i] ** 2))) for i in range(len(model.names))]
    known = F.array_intersect(F.regexp_extract_all(low, F.lit(f"({_TERM})"), 1), F.array(*map(F.lit, model.shares)))
    weighty = F.exists(F.array(*squares), lambda m: F.aggregate(known, F.lit(0.0), lambda a, t: a + F.coalesce(m[t], F.lit(0.0))) >= threshold**2 - 1e-9)
    texts = files.where(low.rlike(f"(?<![a-z0-9])(?:{'|'.join(model.needed)})(?![a-z0-9])")).where(weighty)
    return scratch.keep(texts.select("file_id", "repo", "path", F.md5("text").alias("digest"), "text").withColumn("uid", F.monotonically_increasing_id()), "licence-texts")


def _table(spark: SparkSession, model: Model) -> DataFrame:
    """The terms of the templates: term, weight, share; as large as these."""
    return spark.createDataFrame([(t, w, s) for t, (w, s) in model.shares.items()], "term string, weight double, share array<double>")


def _weighted(texts: DataFrame, model: Model) -> DataFrame:
    """The terms of texts: uid, at, weight, share (in each template; null where it is in none)."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = texts.select("uid", F.posexplode(F.regexp_extract_all(lowered, F.lit(f"({_TERM})"), 1)).alias("at", "term"))
    return terms.join(F.broadcast(_table(texts.sparkSession, model)), "term", "left").select("uid", "at", F.coalesce("weight", F.lit(model.other)).alias("weight"), "share")


def notices(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Files (file_id, repo, path, text) with a run of terms whose cosine to a template reaches the threshold: file_id, repo, path, digest (md5 of the text), licence, score.

    A run has as many terms as the template; a text of fewer is one run. Of equally near templates the first by name
    is taken. Null texts have no terms.
    """
    model, spark = Model(templates, threshold), files.sparkSession
    texts = _noticed(files, model, threshold)
    terms = _weighted(texts.select("uid", "text").repartition("uid"), model)  # texts move, not their terms
    text = Window.partitionBy("uid")
    sums = {"all": F.count(F.lit(1)).over(text)}
    for i, length in enumerate(model.lengths):
        run = text.orderBy("at").rowsBetween(0, length - 1)
        sums[f"n{i}"] = F.count(F.lit(1)).over(run)
        sums[f"dot{i}"] = F.sum(F.col("weight") * F.coalesce(F.get("share", F.lit(i)), F.lit(0.0))).over(run)
        sums[f"squares{i}"] = F.sum(F.col("weight") * F.col("weight")).over(run)
    found = terms.select("uid", "at", "weight", "share").withColumns(sums)
    runs = []
    for i, length in enumerate(model.lengths):
        whole = (F.col(f"n{i}") == length) | ((F.col("at") == 0) & (F.col("all") < length))
        # repeated terms make a run longer than its squares say
        near = F.pow(f"dot{i}", F.lit(2)) >= (threshold**2 - 1e-9) * F.col(f"squares{i}")
        runs.append(F.when(whole & near, F.struct(F.lit(i).alias("template"), F.col(f"n{i}").alias("length"), F.col(f"dot{i}").alias("dot"))))
    runs = found.select("uid", F.col("at").alias("start"), F.explode(F.array(*runs)).alias("r")).where("r is not null").select("uid", "start", "r.*")
    runs = scratch.keep(runs, "licence-runs")
    own = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "template", "dot")).alias("runs"))
    own = scratch.keep(own, "licence-runs-of-texts")
    if own.count() <= BROADCAST_ROWS:  # else the texts with runs move once more
        own = F.broadcast(own)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = texts.select("uid", "text").join(own, "uid").select("uid", F.regexp_extract_all(lowered, F.lit(f"({_TERM})"), 1).alias("terms"), F.explode("runs").alias("r"))
    held = held.select("uid", "r.start", "r.template", "r.dot", F.explode(F.slice("terms", F.col("r.start") + 1, F.col("r.length").cast("int"))).alias("term"))
    bag = held.groupBy("uid", "start", "template", "dot", "term").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(_table(spark, model).drop("share")), "term", "left")
    bag = bag.withColumn("value", F.col("n") * F.coalesce("weight", F.lit(model.other)))
    scored = bag.groupBy("uid", "start", "template", "dot").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    scored = scored.select("uid", "template", (F.col("dot") / F.col("norm")).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("uid").agg(F.min(F.struct((-F.round("score", 9)).alias("far"), "template")).alias("best"))
    licence = F.element_at(F.array(*map(F.lit, model.names)), F.col("best.template") + 1)
    return texts.join(best, "uid").select("file_id", "repo", "path", "digest", licence.alias("licence"), (-F.col("best.far")).alias("score"))


def _best() -> Column:
    """The nearest licence, of equally near ones the first by name, as (score, licence)."""
    least = F.min(F.struct((-F.round("score", 9)).alias("score"), F.col("licence").alias("licence")))
    return F.struct((-least["score"]).alias("score"), least["licence"].alias("licence"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def licensed(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every row of files (file_id, repo, path, text; other columns do not matter).

    Returns file_id, repo, path, own (by its text), score, inherited (from the nearest directory at or above its own
    that holds a licence file with a notice) and licence, the first of both that is there. Null texts, paths and repos
    are kept: a null text has no own licence, a null path or repo inherits none. Repeated rows each get the same
    result. Of several licence files in a directory the nearest to a template counts, then the first by name.
    """
    with scratch.steps(files.sparkSession):
        files = files.select("file_id", "repo", "path", "text")
        names = ["file_id", "repo", "path", "digest"]  # rows of one name with other texts are files of their own
        found = scratch.keep(notices(files, templates, threshold), "notices")
        own = scratch.keep(found.groupBy(*names).agg(_best().alias("best")), "own-licences", stay=True)
        declared = own.where(F.col("path").rlike(LICENCE_FILE)).select("repo", _directory(F.col("path")).alias("ancestor"), "best.score", "best.licence")
        declared = scratch.keep(declared.groupBy("repo", "ancestor").agg(_best()["licence"].alias("inherited")), "declared")
        if declared.count() <= BROADCAST_ROWS:
            declared = F.broadcast(declared)
        parts = F.filter(F.split("directory", "/"), lambda p: p != "")
        places = files.where("repo is not null and path is not null").select("repo", _directory(F.col("path")).alias("directory")).distinct().withColumn("parts", parts)
        above = places.select("repo", "directory", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
        above = above.withColumn("ancestor", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
        nearest = above.join(declared, ["repo", "ancestor"]).groupBy("repo", "directory").agg(F.max(F.struct("depth", "inherited"))["inherited"].alias("inherited"))
        nearest = scratch.keep(nearest, "inherited", stay=True)
        if nearest.count() <= BROADCAST_ROWS:
            nearest = F.broadcast(nearest)
        own = own.select(*(F.col(c).alias(f"own_{c}") for c in names), "best")
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
        out = files.withColumn("digest", F.md5("text")).drop("text").withColumn("directory", _directory(F.col("path"))).join(own, same, "left").join(nearest, ["repo", "directory"], "left")
        return out.select("file_id", "repo", "path", F.col("best.licence").alias("own"), F.col("best.score").alias("score"), "inherited", F.coalesce("best.licence", "inherited").alias("licence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op2_license``: all documents as files of their source; short texts stand for the licence files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.col("n_chars") <= 400, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", "lang", F.floor(F.col("doc_id") / 1024).cast("string"), F.floor(F.col("doc_id") / 32).cast("string"), name)
    out = licensed(docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), path.alias("path"), "text"))
    return out.select(F.col("file_id").alias("doc_id"), "path", "own", F.round("score", 6).alias("score"), "inherited", "licence")


def _sql() -> str:
    model = Model(TEMPLATES, THRESHOLD)
    k = range(len(model.names))
    values = ", ".join(f"('{t}', {w!r}::double, {', '.join(f'{x!r}::double' for x in s)})" for t, (w, s) in model.shares.items())
    licences = ", ".join(f"({i}, '{n}')" for i, n in enumerate(model.names))
    over = [f"over (partition by doc_id order by pos rows between current row and {n - 1} following)" for n in model.lengths]
    sums = ", ".join(f"count(*) {over[i]} n{i}, sum(w * coalesce(s{i}, 0)) {over[i]} dot{i}, sum(w * w) {over[i]} squares{i}" for i in k)
    runs = " union all ".join(
        f"select doc_id, pos start, {i} i, n{i} n, dot{i} dot from sums where (n{i} = {n} or (pos = 1 and whole < {n})) and dot{i} * dot{i} >= {THRESHOLD**2 - 1e-9!r} * squares{i}"
        for i, n in enumerate(model.lengths)
    )
    return rf"""
with f as (
    select doc_id, source repo, concat_ws('/', lang, floor(doc_id / 1024)::bigint, floor(doc_id / 32)::bigint, case when n_chars <= 400 then 'LICENSE.' || doc_id else doc_id || '.txt' end) path, text from documents
), t(term, weight, {', '.join(f's{i}' for i in k)}) as (values {values}), names(i, licence) as (values {licences})
, b as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') terms from f)
, e as (select doc_id, unnest(generate_series(1, len(terms))) pos, unnest(terms) term from b)
, w as (select e.*, coalesce(weight, {model.other!r}) w, {', '.join(f's{i}' for i in k)} from e left join t using (term))
, sums as (select doc_id, pos, count(*) over (partition by doc_id) whole, {sums} from w)
, runs as ({runs})
, bag as (select runs.doc_id, start, i, dot, term, count(*) * any_value(w) value from runs join w on w.doc_id = runs.doc_id and pos between start and start + n - 1 group by runs.doc_id, start, i, dot, term)
, scored as (select doc_id, i, dot / sqrt(sum(value * value)) score from bag group by doc_id, start, i, dot)
, own as (
    select doc_id, repo, path, licence, score from (
        select f.*, licence, score, row_number() over (partition by f.doc_id order by round(score, 9) desc, licence) r from scored join names using (i) join f using (doc_id) where score >= {THRESHOLD})
    where r = 1
), declared as (
    select repo, d ancestor, licence from (
        select repo, regexp_replace(path, '/?[^/]*$', '') d, licence, row_number() over (partition by repo, d order by round(score, 9) desc, licence) r from own where regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$'))
    where r = 1
), near as (
    select doc_id, arg_max(declared.licence, length(ancestor)) inherited
    from f join declared on f.repo = declared.repo and (ancestor = '' or starts_with(f.path, ancestor || '/')) group by doc_id
)
select f.doc_id, f.path, own.licence own, round(own.score, 6) score, inherited, coalesce(own.licence, inherited) licence from f left join own using (doc_id) left join near using (doc_id)
"""


SQL = _sql()
