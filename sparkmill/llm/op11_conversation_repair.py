"""Conversations repaired at least cost: a recursive query over turns, keeping the cheapest edits for each state of the grammar.

A repaired conversation is empty or an optional system row followed by pairs of a user and an assistant row. States of
the grammar: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.

Method:

1.  Rows are put in order by a range partitioning, which can cut a conversation anywhere, and numbered. A conversation's
    rows under the same ``BLOCK`` numbers are a block. Only flags of the rows move, texts stay where they are.
2.  Blocks are hash-partitioned and go to DuckDB in batches. Its recursive query advances all blocks by one turn at a
    time and keeps, for each state at the start of a block and each state now, the least cost and its first audit.
3.  A block is then one step, like a turn, of ``FAN`` blocks at a time: the same query joins them until a conversation
    is one block. So no batch grows with a conversation.
4.  Audits are spelled out to edits by position, which meet the texts again.

The best audit of a part is part of the best audit of the whole: two audits of a state differ at a letter, as they cover
the same rows at the same cost, so what follows cannot change their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

#: Bits of the row number within a block; blocks joined at once; rows or blocks that go to DuckDB at once; its memory.
BLOCK, FAN, BATCH, MEMORY = 7, 64, 16_384, "256MB"
#: Costs of the edits, and of a truncated row that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space of texts.
SPACE = " \t\n\v\f\r"
#: Faults of a row as the recursive query sees them.
_SOUND, _CUT, _GONE = 0, 1, 2
_INITIALS = "sua"
_NEXT = (2, 2, 3, 2)  # the state after a user or assistant row that fits here

_ADVANCE = """
with recursive best as (
    select grp, 0::int as i, s as start, s as state, 0::bigint as cost, '' as audit from (select distinct grp from steps), (values (0), (1), (2), (3)) v(s)
    union all
    select grp, i, start, state, least.cost, least.audit from (
        select b.grp, b.i + 1 as i, b.start, m.dst as state, min({'cost': b.cost + m.cost, 'audit': b.audit || m.audit}) as least
        from best b join steps s on s.grp = b.grp and s.i = b.i + 1 join moves m on m.kind = s.kind and m.src = b.state
        group by all)
)
select grp, start::int src, state::int dst, cost, audit from best join (select grp, max(i) i from steps group by grp) using (grp, i)
order by grp
"""


def _inserts(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after no, one and two inserted rows; a third only comes back to where the first was."""
    one = _NEXT[state]
    return [(state, 0, ""), (one, INSERT, "I"), (_NEXT[one], 2 * INSERT, "II")]


def _moves() -> pa.Table:
    """The cheapest way from state to state by inserts and then one row, for each kind of row: 3 * initial + fault.

    A kept system row is an L, which stands between I and R as K does, so that audits alone tell the roles.
    """
    rows = []
    for kind in range(12):
        initial, fault = divmod(kind, 3)
        for src in range(4):
            best: dict[int, tuple[int, str]] = {}
            for state, cost, audit in _inserts(src):
                ways = [(state, DELETE, "D")]
                if fault != _GONE:
                    more = TRUNCATED * (fault == _CUT)
                    ways.append((_NEXT[state], REROLE + more, "R"))
                    if initial == 0 and state == 0:
                        ways.append((1, KEEP + more, "L"))
                    if initial in (1, 2) and _NEXT[state] == initial + 1:
                        ways.append((initial + 1, KEEP + more, "K"))
                for dst, c, letter in ways:
                    best[dst] = min(best.get(dst, (1 << 40, "")), (cost + c, audit + letter))
            rows += [(kind, src, dst, *found) for dst, found in best.items()]
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "src", "dst", "cost", "audit"])


def _changes(*columns: np.ndarray | pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any column; the first does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        c = c if isinstance(c, np.ndarray) else c.dictionary_encode().indices.to_numpy()
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def _advanced(level: int):
    """Sorted rows (key, block, ord, kind), or at later levels (key, block, at, src, dst, cost, audit), to the moves of their blocks."""
    names = ["key", "block", "src", "dst", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})

        def solved(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            key, block = (t.column(c).combine_chunks() for c in ("key", "block"))
            new = _changes(key, block.to_numpy())
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            if level:
                step = new | _changes(t.column("at").to_numpy())
                kind = np.cumsum(step) - 1
                moves = pa.table({"kind": pa.array(kind), **{c: t.column(c) for c in ("src", "dst", "cost", "audit")}})
                own = np.flatnonzero(step)
                group, kind = group[own], np.arange(len(own))
            else:
                moves, kind = _moves(), t.column("kind").to_numpy()
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            i = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group)))) + 1
            con.register("steps", pa.table({"grp": pa.array(group), "i": pa.array(i, pa.int32()), "kind": pa.array(kind)}))
            con.register("moves", moves)
            out = con.sql(_ADVANCE).to_arrow_table().combine_chunks()
            row = pa.array(at[out.column("grp").to_numpy()])
            columns = [key.take(row), block.take(row), *(out.column(c).combine_chunks() for c in names[2:])]
            return pa.RecordBatch.from_arrays([c.cast(f) for c, f in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=names)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > BATCH:
                cut = np.flatnonzero(_changes(held.column("key").combine_chunks(), held.column("block").to_numpy()))
                end = int(cut[max(1, np.searchsorted(cut, BATCH, side="right") - 1)]) if len(cut) > 1 else 0
                if not end:  # one group; it has a bound, and ends with the next rows
                    break
                yield solved(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield solved(held)
        con.close()

    return run


_MOVES = "key string, block long, src int, dst int, cost long, audit string"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, audit) to a row for each letter: (key, seq, position, edit, role); position counts rows, an inserted one has none."""
    schema = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string())])
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for key, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state, position = 0, 0
            for seq, letter in enumerate(audit):
                role = None
                if letter == "L":
                    state = 1
                elif letter != "D":
                    state = _NEXT[state]
                    role = "user" if state == 2 else "assistant"
                if letter != "I":
                    position += 1
                for column, value in zip(out, (key, seq, None if letter == "I" else position, "K" if letter == "L" else letter, None if letter == "K" else role), strict=True):
                    column.append(value)
                if len(out[0]) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, line) sorted by key and place: one hash a key of its lines, newline-joined, as they pass."""
    key, running = None, hashlib.sha256()
    for batch in batches:
        keys, hashes = [], []
        for k, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(running.hexdigest())
                key, running = k, hashlib.sha256(line.encode())
            else:
                running.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], names=["key", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], names=["key", "repaired_sha256"])


def _key(conv_id: str = "conv_id") -> Column:
    """A text for each conv_id, null too."""
    return F.concat(F.when(F.col(conv_id).isNull(), "-").otherwise("+"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")))


def _last(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find the cheapest edits of conversations (conv_id, turn, role, text; other columns do not matter).

    Returns two tables. The first has a row for each conv_id, null is one: gaps (turns missing between the least and the
    largest), blank, duplicate, truncated (rows by their first fault), illegal (neighbours that may not follow each
    other), cost, audit (the edits' initials in order: Keep, Rerole, Delete, Insert). The second has the rows of the
    repaired conversations: conv_id, seq (their order), role, text, edit.

    Rows are taken by turn, null first, then by role and the hash of the text; rows equal in all are interchangeable,
    and all but one of them are duplicates. A null role or text is one space. A null, empty or unknown role fits
    nowhere; a role fits by its first letter, s, u or a. A blank or duplicate row goes; repeated turns are no gaps; gaps
    beyond a long are null. An empty table gives empty tables. A conversation may hold any share of the rows; its audit
    is one text.
    """
    with scratch.steps(conversations.sparkSession):
        return _repaired(conversations)


def _repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(_key().alias("key"), "conv_id", F.col("turn").try_cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = scratch.keep(rows.withColumn("id", F.monotonically_increasing_id()), "conversation-rows", stay=True)  # numbers that stay, once written
    last, initial = _last(F.col("text")), F.substring("role", 1, 1)
    thin = rows.select("key", "turn", "role", "id", F.md5(F.concat_ws(":", F.length("role"), "role", "text")).alias("hash"), initial.alias("initial"), (last == "").alias("blank"), F.instr(F.lit(".!?"), last).alias("ends"))
    # the first of the rows equal in role and text, found before the shuffle in each task
    first = thin.groupBy("key", "hash").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "id")).alias("first")).select(F.col("first.id").alias("id"), F.lit(True).alias("new"))
    thin = thin.join(first, "id", "left")
    duplicate = F.col("new").isNull() & ~F.col("blank")
    truncated = ~F.col("blank") & F.col("new").isNotNull() & (F.col("ends") == 0)
    fault = F.when(F.col("blank") | duplicate, _GONE).when(truncated, _CUT).otherwise(_SOUND)
    letter = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), F.col("initial")), F.lit(0)) - 1, F.lit(3))
    letter = F.when(F.col("initial") == "", 3).otherwise(letter)
    thin = thin.select("key", "turn", "role", "hash", "id", letter.alias("initial"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), (3 * letter + fault).cast("int").alias("kind"))
    order = ["key", F.asc_nulls_first("turn"), "role", "hash", "id"]
    thin = scratch.keep(thin, "flags")  # its order is found from a sample, which reads it once more
    thin = thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    thin = scratch.keep(thin.withColumn("block", F.shiftright("ord", BLOCK)).drop("hash"), "ordered")

    parts = int(thin.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work for each
    level = thin.select("key", "block", "ord", "kind").repartition(parts, "key", "block").sortWithinPartitions("key", "block", "ord").mapInArrow(_advanced(0), _MOVES)
    level = scratch.keep(level, "blocks")
    while not level.groupBy("key").agg((F.max("block") != F.min("block")).alias("several")).where("several").isEmpty():
        at = F.dense_rank().over(Window.partitionBy("key").orderBy("block")) - 1
        level = level.withColumn("at", at).withColumn("block", F.floor(F.col("at") / FAN)).select("key", "block", "at", "src", "dst", "cost", "audit")
        level = scratch.keep(level.repartition("key", "block").sortWithinPartitions("key", "block", "at").mapInArrow(_advanced(1), _MOVES), "blocks")
    ends = F.when(F.col("dst") == 1, 2).when(F.col("dst") == 2, 1).otherwise(0)  # rows to insert at the end
    least = F.min(F.struct((F.col("cost") + INSERT * ends).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), ends)).alias("audit")))
    audits = scratch.keep(level.where("src = 0").groupBy("key").agg(least.alias("least")).select("key", "least.*"), "audits", stay=True)

    found = _found(thin)
    ids = conversations.select("conv_id").distinct().withColumn("key", _key())
    said = ids.join(found, "key", "left").join(audits.withColumn("audit", F.translate("audit", "L", "K")), "key", "left")
    said = scratch.keep(said.select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "said", stay=True)

    blocks = thin.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).drop("n")
    placed = thin.join(blocks, ["key", "block"]).select("key", (F.col("before") + F.col("ord") - F.col("first") + 1).alias("position"), "id")
    edits = audits.select("key", "audit").mapInArrow(_spelled, "key string, seq long, position long, edit string, role string").where("edit != 'D'")
    edits = edits.join(placed, ["key", "position"], "left").select("key", "seq", "edit", F.col("role").alias("given"), "id")
    lines = edits.join(rows.select("id", "role", "text"), "id", "left")
    lines = lines.select("key", "seq", F.coalesce("given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    lines = scratch.keep(lines, "repaired", stay=True)
    return said, lines


def _found(thin: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal); neighbours are looked at within blocks, then between them."""
    legal = {(0, 1), (1, 2), (2, 1)}

    def bad(a: Column, b: Column) -> Column:
        fits = F.lit(False)
        for x, y in sorted(legal):
            fits |= (a == x) & (b == y)
        return (a.isNotNull() & ~fits).cast("long")

    within = thin.withColumn("last", F.lag("initial").over(Window.partitionBy("key", "block").orderBy("ord")))
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    blocks = within.groupBy("key", "block").agg(*counts, F.sum(bad(F.col("last"), F.col("initial"))).alias("illegal"), F.min(F.struct("ord", "initial"))["initial"].alias("begins"), F.max(F.struct("ord", "initial"))["initial"].alias("ends"))
    blocks = blocks.withColumn("last", F.lag("ends").over(Window.partitionBy("key").orderBy("block")))
    sums = blocks.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + bad(F.col("last"), F.col("begins"))).alias("illegal"))
    turns = thin.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count(F.lit(1)).alias("n"))
    turns = turns.select("key", F.try_subtract(F.try_subtract("high", "low"), F.col("n") - 1).alias("gaps"), F.lit(True).alias("has"))
    return sums.join(turns, "key", "left").withColumn("gaps", F.when(F.col("has"), F.col("gaps")).otherwise(0)).drop("has")


def damaged(conversations: DataFrame) -> DataFrame:
    """Damage that the crc32 of ``conv_id:turn`` (null: one space), modulo 20, deals: 0 drops a row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("way")).where("way != 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def digest(conversations: DataFrame, originals: DataFrame) -> DataFrame:
    """The findings for every conv_id of ``originals``, and the sha256 of the repaired ``role:text`` rows, newline-joined.

    A conversation without rows has zeros, an empty audit and the hash of the empty text.
    """
    said, lines = repair(conversations)
    line = F.concat_ws(":", "role", "text")
    hashes = lines.select("key", "seq", line.alias("line")).repartition("key").sortWithinPartitions("key", "seq").select("key", "line").mapInArrow(_hashed, "key string, repaired_sha256 string")
    known = said.drop("conv_id").withColumn("gaps_known", F.lit(True)).join(hashes, "key", "left")
    out = originals.select("conv_id").distinct().withColumn("key", _key()).join(known, "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("gaps_known"), F.col("gaps")).otherwise(0).cast("long").alias("gaps")
    return out.select("conv_id", gaps, *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op11_conversation_repair``: all conversations, damaged by rule and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digest(damaged(rows), rows)


SQL = r"""
with recursive crc as (
    select list(c order by i) t from (select i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint) c from range(256) r(i))
), raw as (
    select conv_id, turn, coalesce(role, ' ') "role", coalesce(text, ' ') text,
        xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 20 way
    from conversations, crc
), damaged as (
    select conv_id, turn, case when way = 4 then 'user' else "role" end "role", case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
    from (select *, unnest(case when way = 3 then [0, 1] else [0] end) from raw where way != 0)
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, "role", text) i, left("role", 1) initial from damaged
), judged as (
    select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, "role", text order by i) > 1 then 'duplicate'
        when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end fault,
        coalesce(lag(initial) over (partition by conv_id order by i) || initial not in ('su', 'ua', 'au'), false) illegal
    from numbered
), inserts as (
    select * from (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)), (3, 2, 5, 'I', 'user:' || chr(10)), (2, 3, 5, 'I', 'assistant:' || chr(10)),
        (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
        (3, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 10, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))) v(src, mid, price, letters, lines)
), edits as (
    select * from (values (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (3, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'),
        (0, 2, '', 1, 'R'), (1, 2, '', 1, 'R'), (3, 2, '', 1, 'R'), (2, 3, '', 1, 'R'), (0, 0, '', 2, 'D'), (1, 1, '', 2, 'D'), (2, 2, '', 2, 'D'), (3, 3, '', 2, 'D')) v(mid, dst, needs, price, letter)
), best as (
    select conv_id, 0::bigint i, 0 state, 0::bigint cost, '' audit, '' repaired from (select distinct conv_id from judged)
    union all
    select conv_id, i, state, b.cost, b.audit, b.repaired from (
        select r.conv_id, r.i, e.dst state, min({'cost': x.cost + n.price + e.price + case when r.fault = 'truncated' and letter != 'D' then 5 else 0 end, 'audit': x.audit || n.letters || e.letter,
            'repaired': x.repaired || n.lines || case letter when 'K' then r."role" || ':' || r.text || chr(10) when 'R' then case e.dst when 2 then 'user' else 'assistant' end || ':' || r.text || chr(10) else '' end}) b
        from best x join judged r on r.conv_id is not distinct from x.conv_id and r.i = x.i + 1 join inserts n on n.src = x.state join edits e on e.mid = n.mid
        where (letter = 'D' or r.fault not in ('blank', 'duplicate')) and (letter != 'K' or e.needs = r.initial)
        group by all)
), counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) n, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') "duplicate",
        count(*) filter (fault = 'truncated') "truncated", count(*) filter (illegal) illegal from judged group by 1
), ended as (
    select conv_id, min({'cost': cost + price, 'audit': audit || letters, 'repaired': repaired || lines}) b
    from best join counted using (conv_id) join inserts on src = state where i = n and mid in (0, 3) group by 1
)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce("duplicate", 0) "duplicate", coalesce("truncated", 0) "truncated", coalesce(illegal, 0) illegal,
    coalesce(b.cost, 0)::bigint "cost", coalesce(b.audit, '') audit, sha256(coalesce(b.repaired[:-2], '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""
