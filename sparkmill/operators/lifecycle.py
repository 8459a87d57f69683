"""The life of a stored document: clean pages, chunks with vectors, states, deletion with all that hangs on it, results read back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkmill.functions.markdown import INDEX_LINE, TRAILING_PAGE, lines
from sparkmill.functions.text import bytes_shown, one_decimal, strip
from sparkmill.operators.chunking import chunked, cut_up

# What marks a header, a section title, and the end of a sentence.
HEADER = r"(?iu)^\s*(Página\s+\d+|ÍNDICE|INDEX|CONTENIDOS?)\s*$"
LEADERS = r"(?:\.\s*){3,}|·{3,}|…{1,}"
TITLE = r"^\s*(\d+(?:\.\d+)*)[\s\-—:]+(.*\S)\s*$"
SENTENCE = r"(?<!\w\.\w.)(?<![A-ZÁÉÍÓÚÑ][a-záéíóúñ]\.)(?<=\.|\?|!)\s"

#: States of a document. Fixed values.
LOADED, WITH_TEXT, INDEXING, INDEXED, FAILED = "cargado", "con markdown", "procesando", "indexado", "error"


def clean_page(text: Column) -> Column:
    """CHK08: a page's lines without headers, lines of an index and page numbers after dots."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.rlike(HEADER) & ~x.rlike(INDEX_LINE) & ~x.rlike(TRAILING_PAGE))
    return F.array_join(kept, "\n")


def sentence_packs(text: str, least: int = 800, most: int = 1200) -> list[str]:
    """CHK07: sentences packed to at most ``most`` characters; a pack shorter than ``least`` takes the next one whatever its length, a short last one is dropped."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in filter(None, map(str.strip, re.split(SENTENCE, text))):
        if size + len(sentence) > most and size >= least:
            out.append(" ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += len(sentence) + 1
    return out + [" ".join(held)] * (size >= least)


def packed_sentences(docs: DataFrame, least: int = 800, most: int = 1200) -> DataFrame:
    """CHK07: the columns of documents (text and any others) but ``text``, with segment and chunk: its :func:`sentence_packs`.

    A null text has none; ids of any type, null and repeated ones, stay as they are.
    """
    return cut_up(docs, F.col("text"), lambda text: sentence_packs(text or "", least, most))


def index_line(line: Column) -> Column:
    """A short line with leading dots and a number at its end, or one of an index with a number at its end."""
    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    number = text.rlike(r"\d+\s*$")
    return (text.rlike(LEADERS) & number & (F.length(text) < 160)) | (number & F.contains(F.upper(text), F.lit("ÍNDICE")))


def section_title(line: Column) -> Column:
    """A numbered title that does not end in a digit and has no leading dots."""
    text = F.trim(F.regexp_replace(line, r"\s+", " "))
    return text.rlike(TITLE) & ~text.rlike(LEADERS) & ~index_line(line) & ~text.rlike(r"\d\s*$")


def without_index(rows: DataFrame) -> DataFrame:
    """CHK10: lines (doc_id, at, line) outside of an index: it begins with a line that names it and ends before the next section title.

    A line that names the index begins it, a title ends it; one that does both turns the state. The state before a line
    is that after the last line which fixes it, turned as often as lines since then turn it.
    """
    upper = F.upper("line")
    names = F.contains(upper, F.lit("ÍNDICE")) | F.contains(upper, F.lit("INDICE"))
    dotted, title = index_line(F.col("line")), section_title(F.col("line"))
    rows = rows.withColumns({"__names": names, "__title": title, "__dotted": dotted})
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("__names") & F.col("__title")).cast("int")
    rows = rows.withColumn("__turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    fixed = F.when(F.col("__names") != F.col("__title"), F.struct(F.col("__names").alias("inside"), F.col("__turned").alias("turned")))
    rows = rows.withColumn("__fixed", F.last(fixed, ignorenulls=True).over(before))
    since = F.col("__turned") - F.coalesce("__fixed.turned", F.lit(0))
    inside = F.coalesce("__fixed.inside", F.lit(False)) != (since % 2 == 1)
    return rows.where(~F.col("__dotted") & ((inside & F.col("__title")) | (~inside & ~F.col("__names")))).select("doc_id", "at", "line")


def points(docs: DataFrame, embed: Callable[[Column], Column], most: int = 512) -> DataFrame:
    """PIP01: points (point_id, document_id, sha, segment, chunk, vector) of documents (doc_id, sha, text).

    ``embed`` gives the vector of a chunk, a column of a column. A document of which any chunk has no vector gives no
    points at all; nor does one without text. Rows of one doc_id with other hashes are documents of their own; rows
    equal in both give the same points, once each.
    """
    cut = chunked(docs.select("doc_id", "sha", "text"), most).withColumn("vector", embed(F.col("chunk")))
    whole = F.count(F.when(F.col("vector").isNull(), 1)).over(Window.partitionBy("doc_id", "sha")) == 0
    point = F.sha2(F.concat_ws("/", F.col("doc_id").cast("string"), "sha", F.col("segment").cast("string")), 256)
    once = F.row_number().over(Window.partitionBy("doc_id", "sha", "segment").orderBy("chunk")) == 1
    return cut.withColumns({"__whole": whole, "__once": once}).where("__whole and __once").select(point.alias("point_id"), F.col("doc_id").alias("document_id"), "sha", "segment", "chunk", "vector")


def reindexed(old: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], most: int = 512) -> tuple[DataFrame, DataFrame]:
    """PIP02: the points after documents (doc_id, sha, markdown, pdf_text) are indexed again, and (doc_id, status, n).

    The Markdown is preferred to the text of the file. Old points of these documents go before the new ones come;
    without any chunk indexing has failed.
    """
    text = F.coalesce(F.nullif(strip(F.col("markdown")), F.lit("")), F.col("pdf_text"))
    new = points(docs.select("doc_id", "sha", text.alias("text")), embed, most)
    kept = old.join(docs.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_anti").select(*new.columns)
    counts = docs.select("doc_id").distinct().join(new.groupBy(F.col("document_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")), "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    return kept.unionByName(new), counts.select("doc_id", F.when(n > 0, INDEXED).otherwise(FAILED).alias("status"), n.alias("n"))


def next_status(status: Column, event: Column, markdown: Column) -> Column:
    """FSM01: the status after an event: text (a Markdown came), sync (is it there?), indexing, indexed, failed; others change nothing."""
    has = F.coalesce(strip(markdown), F.lit("")) != ""
    textual = F.when(has, WITH_TEXT).otherwise(LOADED)
    return (
        F.when(event == "text", F.when(status == INDEXED, status).otherwise(textual))
        .when(event == "sync", F.when(status.isin(LOADED, WITH_TEXT), textual).otherwise(status))
        .when(event == "indexing", INDEXING)
        .when(event == "indexed", INDEXED)
        .when(event == "failed", FAILED)
        .otherwise(status)
    )


def job_result(status: Column, cancelled: Column, error: Column) -> Column:
    """FSM03: a job's status when its result comes: cancelled if that was asked for, failed with an error, else done; ended ones stay."""
    ended = status.isin("done", "failed", "cancelled")
    return F.when(ended, status).when(F.coalesce(cancelled, F.lit(False)), "cancelled").when(error.isNotNull(), "failed").otherwise("done")


def conversion_outcome(markdown: Column, converted: Column) -> Column:
    """FSM04: skipped where there is a Markdown already, converted where one came, else failed."""
    filled = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    return F.when(filled(markdown), "skipped").when(filled(converted), "converted").otherwise("failed")


def role_toggled(admin: Column, chosen: Column) -> Column:
    """UPD01: the role of chosen users turned over; a null role counts as none."""
    return F.coalesce(admin, F.lit(False)) != F.coalesce(chosen, F.lit(False))


def cascaded(gone: DataFrame, documents: DataFrame, bridge: DataFrame, vectors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """JOI05, DEL02: the four tables without documents (document_id): their bridge rows, the vectors of those, their chunks.

    bridge: document_id, vector_id; vectors: vector_id, chunk_id; chunks: chunk_id. A vector or chunk that another
    document still holds stays.
    """
    gone = gone.select("document_id").distinct()
    left = bridge.join(gone, "document_id", "left_anti")
    loose = bridge.join(gone, "document_id", "left_semi").select("vector_id").distinct().join(left.select("vector_id"), "vector_id", "left_anti")
    vectors_left = vectors.join(loose, "vector_id", "left_anti")
    free = vectors.join(loose, "vector_id", "left_semi").select("chunk_id").distinct().join(vectors_left.select("chunk_id"), "chunk_id", "left_anti")
    return documents.join(gone, "document_id", "left_anti"), left, vectors_left, chunks.join(free, "chunk_id", "left_anti")


def deleted_if_owned(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """DEL03: rows (id, user_id) left when wanted ones (id, user_id) are deleted; a user's deletions are all done, or none if one is not theirs."""
    asked = wanted.select("id", F.col("user_id").alias("by")).distinct()
    checked = asked.join(table.select("id", F.col("user_id").alias("owner")), "id", "left").withColumn("own", F.coalesce(F.col("owner") == F.col("by"), F.lit(False)))
    allowed = checked.groupBy("by").agg(F.min("own").alias("all")).where("all").select("by")
    return table.join(checked.join(allowed, "by", "left_semi").select("id"), "id", "left_anti")


def users_deleted(users: DataFrame, questions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEL04: users (user_id) and questions (user_id) without those users and theirs."""
    gone = gone.select("user_id").distinct()
    return users.join(gone, "user_id", "left_anti"), questions.join(gone, "user_id", "left_anti")


def scope(asked: Column, admin: Column) -> Column:
    """FLT19: what a usage query covers: an administrator's user or global, another's own or global; anything else is the user's."""
    own = F.when(admin, "user").otherwise("own")
    return F.when(asked == "global", "global").when((asked == "user") & admin, "user").when((asked == "own") & ~admin, "own").otherwise(own)


def in_scope(log: DataFrame, asked: str, user_id: int, admin: bool) -> DataFrame:
    """FLT19: the rows (user_id) of a usage query."""
    return log.where((scope(F.lit(asked), F.lit(admin)) == "global") | (F.col("user_id") == user_id))


def to_point(content: Column, metadata: Column, vector: Column, model: str, size: int, most: int) -> Column:
    """PRJ06: a chunk as a stored point: its payload and its vector."""
    payload = F.struct(content.alias("content"), metadata.alias("metadata"), F.lit(model).alias("model_id"), F.lit(size).alias("embedding_size"), F.lit(most).alias("max_input_length"))
    return F.struct(payload.alias("payload"), vector.alias("vector"))


def from_point(point: Column) -> Column:
    """PRJ06: content, metadata and vector of a stored point; empty ones where they are missing."""
    nothing = F.create_map().cast("map<string,string>")
    return F.struct(F.coalesce(point["payload"]["content"], F.lit("")).alias("content"), F.coalesce(point["payload"]["metadata"], nothing).alias("metadata"), point["vector"].alias("vector"))


def has_text(markdown: Column) -> Column:
    """PRJ07: whether a document has a Markdown."""
    return F.coalesce(markdown, F.lit("")) != ""


def with_aliases(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """PRJ08: a column under its common name beside each one that has another; names that are there already stay."""
    return rows.withColumns({to: F.col(name) for name, to in aliases.items() if name in rows.columns and to not in rows.columns})


def latest_result(jobs: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """PRJ10: per kind the result (JSON) of its latest job (kind, at, id, result), a column a part; ``{}`` for missing ones and broken JSON."""
    last = jobs.groupBy("kind").agg(F.max_by("result", F.struct("at", "id")).alias("result"))
    return last.select("kind", *(F.coalesce(F.get_json_object("result", f"$.{p}"), F.lit("{}")).alias(p) for p in parts))


def named(rows: DataFrame, name: str) -> DataFrame:
    """AGG33: how many rows have exactly this file name."""
    return rows.where(F.col("name") == name).agg(F.count(F.lit(1)).alias("n"))


def urls_of(rows: DataFrame) -> DataFrame:
    """GEN03: per tender its pages' addresses, once each, in the order of rows (tender, seq, url); blank ones do not count."""
    pairs = F.array_sort(F.collect_list(F.when(F.coalesce(F.trim("url"), F.lit("")) != "", F.struct("seq", "url"))))
    return rows.groupBy("tender").agg(F.array_distinct(F.transform(pairs, lambda x: x["url"])).alias("urls"))


def detail(record: Column) -> Column:
    """GEN04: a record (a map) with its values trimmed and those left out that are blank."""
    return F.map_filter(F.transform_values(record, lambda _, v: strip(v)), lambda _, v: F.coalesce(v, F.lit("")) != "")


def regrouped(names: Column, values: Column) -> Column:
    """MAP02: a map of the first as many names and values as both have; of a repeated name the last value."""
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    pairs = F.slice(pairs, F.lit(1), F.least(F.size(names), F.size(values)))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.transform(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"]), p["name"]))
    return F.map_from_entries(last)


def json_objects(text: Column) -> Column:
    """JSN02: the objects in a JSON array, as JSON; empty for what is no array or is broken."""
    items = F.from_json(text, "array<string>")
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(strip(x).startswith("{"), F.lit(False)))


def json_count(value: Column) -> Column:
    """JSN03: a JSON number that is not negative, without its decimals; null for anything else."""
    return F.when(value.rlike(r"^\s*\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), F.floor(value.cast("double")).cast("long"))


def token_count(result: Column, question: Column, estimate: Callable[[Column], Column]) -> Column:
    """STR16: tokens of a result (JSON): its counters one after another, then the usage's, else an estimate of question and answer."""
    known = [json_count(F.get_json_object(result, f"$.{p}")) for p in ("total_tokens", "tokens", "eval_count", "usage.total_tokens")]
    answer = F.coalesce(F.get_json_object(result, "$.answer"), F.lit(""))
    return F.coalesce(*known, estimate(F.concat(F.coalesce(question, F.lit("")), F.lit(" "), answer)))


def progress_shown(model: Column, status: Column, digest: Column, completed: Column, total: Column, largest: str = "TB") -> Column:
    """JSN05: a download's progress as text: percent within 0 and 100 with one decimal, and the bytes, in units up to ``largest``."""
    percent = F.least(F.lit(100.0), F.greatest(F.lit(0.0), completed * 100.0 / total))
    done = bytes_shown(completed, largest)
    of = F.concat(F.lit(" "), one_decimal(percent), F.lit("% ("), done, F.lit(" / "), bytes_shown(total, largest), F.lit(")"))
    part = F.when(completed.isNotNull() & (total > 0), of).when(completed.isNotNull(), F.concat(F.lit(" ("), done, F.lit(")"))).otherwise("")
    short = F.coalesce(F.substring(F.trim(digest), 1, 12), F.lit(""))
    return F.trim(F.concat(model, F.lit(": "), F.coalesce(F.nullif(status, F.lit("")), F.lit("descargando")), F.when(short != "", F.concat(F.lit(" "), short)).otherwise(""), part))


def throttled(events: DataFrame, interval: float) -> DataFrame:
    """WIN09: of each job's progress (job, at in seconds, seq, status, text, done) the records to show: job, at, seq.

    A record is shown if its text differs from that of the last one shown and ``interval`` has passed since then, or
    the job is done; records without a status or a text do not count. Jobs are streamed in order, one record at a time,
    so a job may be of any length. A null job is one.
    """
    rows = events.where("coalesce(status, '') != '' and text is not null").select("job", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), "text", "done")
    kind = rows.schema["job"].dataType.simpleString()

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, text, last = object(), "", None
        for batch in batches:
            shown = []
            for i, (name, at, said, done) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                if name != job:
                    job, text, last = name, "", None
                due = last is None or done or (at is not None and at - last >= interval)
                if said != text and due:
                    text, last = said, at
                    shown.append(i)
            yield batch.select([0, 1, 2]).take(pa.array(shown, pa.int64()))

    return rows.repartition("job").sortWithinPartitions("job", "at", "seq").mapInArrow(show, f"job {kind}, at double, seq long")


def created_at(stamp: Column, now: Column, zone: str = "Europe/Madrid") -> Column:
    """DT01: a stamp with a zone (text) as local time without one; now where it is missing or cannot be read."""
    zoned = F.when(stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.from_utc_timestamp(F.try_to_timestamp(stamp), zone).cast("timestamp_ntz"))
    return F.coalesce(zoned, F.expr("null").cast("timestamp_ntz"), F.when(~stamp.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(stamp).cast("timestamp_ntz")), now)


def later(a: Column, b: Column, zone: str = "UTC") -> Column:
    """DT05: whether time a (with a zone) is after b (without one, taken to be of the zone); null counts as before all."""
    naive = F.to_utc_timestamp(b.cast("timestamp"), zone)
    return F.when(a.isNull(), False).when(b.isNull(), True).otherwise(a > naive)


def pdf_name(number: Column, title: Column, i: Column) -> Column:
    """STR11: the name of a tender's i-th file."""
    return F.format_string("%s__%s_%d.pdf", number, title, i)


def failed_page(number: Column, total: Column, error: Column) -> Column:
    """STR23: what stands for a page that could not be read: a comment with the error on one line, and a line that is seen."""
    message = strip(F.replace(F.coalesce(error, F.lit("")), F.lit("\n"), F.lit(" ")))
    place = F.concat_ws("/", number.cast("string"), total.cast("string"))
    return F.concat(F.lit("<!-- OCR failed on page "), place, F.lit(": "), message, F.lit(" -->\n\n> [OCR no disponible para la página "), place, F.lit(". La conversión continuó con el resto del documento.]"))


def kind_label(kind: Column, labels: dict[str, str]) -> Column:
    """STR30: the label of a kind; an unknown one as it is, a dash for none."""
    value = F.lower(strip(F.coalesce(kind, F.lit(""))))
    names = F.create_map(*(F.lit(x) for p in labels.items() for x in p))
    return F.coalesce(names[value], F.nullif(value, F.lit("")), F.lit("-"))
