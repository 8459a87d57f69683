"""Line dedup [native]: content-defined chunks of lines, and runs of lines of 50 words; those that stand earlier are cut out.

Lines are those that are not blank. A rolling hash over the hashes of the last ``SPAN`` lines ends a chunk where it is
divisible by ``CUT``, so the same passage is cut alike wherever it stands; chunks of at least two lines count. A
passage's own lines do not fix the boundaries beside it, so two kinds of pieces are added that depend on nothing but
their own lines: from each line on, and up to each line, the fewest lines with ``LONG_WORDS`` words. Any run of lines
with so many words has the same such pieces wherever it stands, and they cover all of it.

Of every piece that occurs more than once the first occurrence by (doc_id, place) stays, the lines of the others go.
The first occurrence of a line is in no later occurrence of a piece, so every line stays somewhere.

Only SQL functions run here. One pass over the texts leaves a narrow table of line hashes, word counts and chunk ends;
pieces are lists of line hashes, and only hashes of these are counted. The lines of repeated pieces are then compared
byte by byte, by grouping on the lines themselves; a piece holding a line whose hash stands for different texts stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

#: Lines in the rolling hash, its divisor at a boundary, and words that make a passage of any lines.
SPAN, CUT, LONG_WORDS = 2, 3, 50
#: Rows up to which a table of ids is broadcast (some 100 bytes a row); larger ones are shuffled.
BROADCAST_ROWS = 250_000
_LOW = (1 << 32) - 1


def _words(line: Column) -> Column:
    """Parts between runs of spaces; 0 for a blank line."""
    trimmed = F.trim(line)
    spaces = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    count = F.when(F.contains(trimmed, F.lit("  ")), F.size(F.split(trimmed, " +"))).otherwise(spaces + 1)
    return F.when(trimmed == "", 0).otherwise(count)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row and, of the lines that are not blank, arrays: at (place in the text, from 0), h, words, cut (the hash of the boundaries)."""
    line = lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), _words(x).alias("words"), F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long").alias("cut"))
    out = docs.select("doc_id", "row", F.transform(_lines(F.col("text")), line).alias("lines"))
    out = out.withColumn("lines", F.filter("lines", lambda x: x["words"] > 0))
    return out.select("doc_id", "row", "lines.at", "lines.h", "lines.words", "lines.cut")


def _range(first: Column, last: Column) -> Column:
    """Two line numbers in one, which sets of them can hold."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(last.cast("long"))


def _weighted(factor: int):
    return lambda a, b: a + b * factor


def _with_chunks(sketch: DataFrame) -> DataFrame:
    """``sketch`` and ``chunks``: the ranges of lines (numbers among the lines that are not blank, from 1) that count."""
    rolled = F.col("cut")
    for k in range(1, SPAN):  # the hashes of the lines before, each with its own power
        before = F.concat(F.array_repeat(F.lit(0).cast("long"), k), F.slice("cut", 1, F.greatest(F.size("cut") - k, F.lit(0))))
        rolled = F.zip_with(rolled, F.slice(before, 1, F.size("cut")), _weighted(31**k))
    ends = F.filter(F.transform(rolled, lambda r, i: F.when(r % CUT == 0, i + 1)), lambda i: i.isNotNull())
    out = sketch.withColumn("ends", F.array_distinct(F.concat(ends, F.array(F.size("cut")))))
    chunks = F.zip_with(F.slice(F.concat(F.array(F.lit(0)), "ends"), 1, F.size("ends")), "ends", lambda a, b: F.when(b > a + 1, _range(a + 1, b)))
    return out.withColumn("chunks", chunks).drop("ends", "cut")


def _reach(i: Column, step: int) -> Column:
    """How many lines from the i-th on (``step`` 1) or up to it (-1) have ``LONG_WORDS`` words together; null if all have fewer."""
    near = [F.coalesce(F.get("words", i - 1 + step * k), F.lit(0)) for k in range(3)]
    least, most = (i, F.least(i + LONG_WORDS - 1, F.size("words"))) if step > 0 else (i, F.greatest(i - LONG_WORDS + 1, F.lit(1)))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    more = lambda a, j: F.when(a["words"] >= LONG_WORDS, a).otherwise(F.struct((a["words"] + F.get("words", j - 1)).alias("words"), (a["n"] + 1).alias("n")))
    far = F.aggregate(F.sequence(least, most), start, more, lambda a: F.when(a["words"] >= LONG_WORDS, a["n"]))
    one, two, three = near[0], near[0] + near[1], near[0] + near[1] + near[2]
    return F.when(one >= LONG_WORDS, 1).when(two >= LONG_WORDS, 2).when(three >= LONG_WORDS, 3).otherwise(far)


def _pieces(sketch: DataFrame) -> DataFrame:
    """A row for each piece: doc_id, row, first, last (lines of the text, from 0), ids (hashes of its lines).

    Lines are got one by one: a slice would copy its whole array for each piece.
    """
    each = F.sequence(F.lit(1), F.size("words"))
    on = F.transform(each, lambda i: _range(i, i - 1 + _reach(i, 1)))
    up = F.transform(each, lambda i: _range(i + 1 - _reach(i, -1), i))
    ranges = F.when(F.size("words") > 0, F.filter(F.array_distinct(F.concat("chunks", on, up)), lambda r: r.isNotNull()))
    first, last = lambda r: F.shiftright(r, 32).cast("int"), lambda r: r.bitwiseAND(_LOW).cast("int")
    piece = lambda r: F.struct(F.get("at", first(r) - 1).alias("first"), F.get("at", last(r) - 1).alias("last"), F.transform(F.sequence(first(r), last(r)), lambda j: F.get("h", j - 1)).alias("ids"))
    out = _with_chunks(sketch).select("doc_id", "row", F.explode_outer(F.transform(ranges, piece)).alias("p"))
    return out.where("p is not null").select("doc_id", "row", "p.*")


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _of(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Rows of docs (doc_id, __row, ...) joined with those of ``table`` (doc_id, row, ...)."""
    table = _sized(table.withColumnsRenamed({"doc_id": "__doc", "row": "__with"}))
    return docs.join(table, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__with")), how).drop("__doc", "__with")


def _runs(ranges: DataFrame) -> DataFrame:
    """Per document its ranges of lines (doc_id, row, first, last) as one: doc_id, row, __runs (structs, in order: lines before since the run before, own lines)."""
    text = Window.partitionBy("doc_id", "row")
    order = text.orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("fresh", F.coalesce((F.col("first") > reached + 1).cast("int"), F.lit(1)))
    ranges = ranges.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = ranges.groupBy("doc_id", "row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    runs = runs.withColumn("before", F.col("first") - F.coalesce(F.lag("last").over(text.orderBy("first")), F.lit(-1)) - 1)
    runs = runs.select("doc_id", "row", F.struct("first", "before", (F.col("last") - F.col("first") + 1).alias("lines")).alias("r"))
    return runs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("r")).alias("__runs"))


def _chosen(inside: bool) -> Column:
    """The lines of ``text`` that are (or are not) in its ``__runs``."""
    flags = F.flatten(F.transform("__runs", lambda r: F.concat(F.array_repeat(F.lit(False), r["before"]), F.array_repeat(F.lit(True), r["lines"]))))
    lines = F.zip_with(_lines(F.col("text")), flags, lambda line, held: F.when(F.coalesce(held, F.lit(False)) == inside, line))
    return F.filter(lines, lambda line: line.isNotNull())


def _ambiguous(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Hashes (h) that stand for different lines among those of the pieces ``found``."""
    held = _of(keyed, scratch.keep(_runs(found.select("doc_id", "row", "first", "last")), "piece-lines"), "inner")
    lines = held.select(F.explode_outer(_chosen(True)).alias("line")).groupBy("line").agg(F.xxhash64("line").alias("h"))
    return scratch.keep(lines.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "ambiguous")


def _repeated(keyed: DataFrame) -> DataFrame:
    """Per document the runs of lines to cut out (see :func:`_runs`)."""
    sketch = scratch.keep(_sketch(keyed.select("doc_id", "text", F.col("__row").alias("row"))), "line-hashes")
    pieces = scratch.keep(_pieces(sketch).withColumn("h", F.xxhash64("ids")), "pieces")
    often = scratch.keep(pieces.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    found = scratch.keep(pieces.join(_sized(often), "h", "left_semi"), "repeated")
    odd = _ambiguous(keyed, found)
    if not odd.isEmpty():  # practically never
        held = found.select("ids").distinct().select("ids", F.explode("ids").alias("h")).join(odd, "h", "left_semi").select("ids").distinct()
        found = scratch.keep(found.join(held, "ids", "left_anti"), "repeated")
    place = F.struct("doc_id", "row", "first", "last")
    least = found.groupBy("ids").agg(F.min(place).alias("p"), F.max(place).alias("q")).where("p != q").select("ids", "p")
    later = found.join(_sized(scratch.keep(least, "first")), "ids").where(place != F.col("p")).select("doc_id", "row", "first", "last").distinct()
    return _runs(later)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The columns of docs (doc_id, text and more) with later pieces cut out of ``text``, and ``n_removed``, the lines cut out.

    Blank lines between removed ones go with them. Null text stays null, an empty one empty. Documents are ordered by
    doc_id (null first), those of one doc_id by a hash of their text; rows equal in both count as one document and all
    keep what is first in it. A column of docs named n_removed is replaced, other columns pass through.
    """
    with scratch.steps(docs.sparkSession):
        docs = docs.drop("n_removed").withColumn("__row", F.xxhash64("doc_id", "text"))
        gone = scratch.keep(_repeated(docs.select("doc_id", "text", "__row")), "gone", stay=True)
        both = _of(docs, gone, "left")
        kept = F.array_join(_chosen(False), "\n")
        removed = F.aggregate("__runs", F.lit(0), lambda n, r: n + r["lines"])
        out = both.withColumns({"text": F.when(F.col("__runs").isNull(), F.col("text")).otherwise(kept), "n_removed": F.coalesce(removed, F.lit(0)).cast("long")})
        return out.drop("__row", "__runs")


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_line_dedup``: all documents."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


SQL = r"""
with l as (
    select doc_id, i, lines[i] line from (select doc_id, string_split(coalesce(text, ''), chr(10)) lines, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) i from documents)
), x as (
    select doc_id, i, line, k, n, words, h, sum(words) over (partition by doc_id order by k) upto
    from (select *, row_number() over (partition by doc_id order by i) k, count(*) over (partition by doc_id) n, len(regexp_split_to_array(trim(line), ' +')) words, ('0x' || substr(md5(line), 1, 8))::bigint h from l where trim(line) != '')
), e as (
    select doc_id, k, coalesce(sum(ends) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) c
    from (select doc_id, k, case when (h + 31 * coalesce(lag(h) over (partition by doc_id order by k), 0)) % 3 = 0 then 1 else 0 end ends from x)
), w as (
    select doc_id, k, max(k) over (partition by doc_id order by upto - words range between current row and 49 following) far, sum(words) over (partition by doc_id order by upto - words range between current row and 49 following) far_words,
        min(k) over (partition by doc_id order by upto range between 49 preceding and current row) near, sum(words) over (partition by doc_id order by upto range between 49 preceding and current row) near_words
    from x
), p as (
    select doc_id, min(k) a, max(k) b from e group by doc_id, c having count(*) > 1
    union select doc_id, k, far from w where far_words >= 50
    union select doc_id, near, k from w where near_words >= 50
), t as (
    select p.doc_id, a, b, min(i) first, max(i) last, string_agg(line, chr(10) order by k) piece from p join x on x.doc_id = p.doc_id and k between a and b group by p.doc_id, a, b
), f as (
    select *, row_number() over (partition by piece order by doc_id, first, last) r from t
), g as (
    select distinct l.doc_id, i from f join l on l.doc_id = f.doc_id and i between first and last where r > 1
), o as (
    select l.doc_id, count(g.i) n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') text from l left join g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
)
select o.doc_id, n_removed::bigint n_removed, length(o.text)::bigint n_chars, md5(o.text) text_md5 from o join documents d using (doc_id) where d.text is not null
union all select doc_id, 0, null, null from documents where text is null
"""
