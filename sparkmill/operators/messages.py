"""Stored messages by a table of patterns: the key that each stands for, its arguments, and its text in a language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Patterns that a table may hold, as all of them go to every task; distinct messages that a worker remembers.
PATTERNS, REMEMBERED = 10_000, 100_000


def matched(rows: DataFrame, patterns: DataFrame, column: str = "message") -> DataFrame:
    """STR22: rows with (key, args) of the first pattern, by order, that matches a whole message; null and an empty map without one.

    patterns: (seq, pattern, key), a pattern with named groups, which become the arguments; of equal seq the first by
    pattern and key. A null message and a null pattern match nothing; a pattern that cannot be compiled is an error.
    """
    known = patterns.where("pattern is not null").select("seq", "pattern", "key").orderBy("seq", "pattern", "key").limit(PATTERNS + 1).collect()
    if len(known) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} patterns")
    shared = rows.sparkSession.sparkContext.broadcast([(re.compile(r["pattern"]), r["key"]) for r in known])

    @F.pandas_udf("key string, args map<string,string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[str | None, dict]] = {}

        def one(message: str | None) -> tuple[str | None, dict]:
            if message is None:
                return None, {}
            if message not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                hits = ((m, key) for pattern, key in shared.value if (m := pattern.fullmatch(message)))
                m, key = next(hits, (None, None))
                seen[message] = key, {k: v for k, v in m.groupdict().items() if v is not None} if m else {}
            return seen[message]

        for messages in batches:
            yield pd.DataFrame([one(m) for m in messages], columns=["key", "args"])

    return rows.withColumn("__found", find(F.col(column))).withColumns({"key": F.col("__found.key"), "args": F.col("__found.args")}).drop("__found")


def localized(rows: DataFrame, patterns: DataFrame, texts: DataFrame, language: str, default: str, column: str = "message") -> DataFrame:
    """STR22, JOI18: rows with ``shown``: the text of a message's key in a language, else in the default one, its ``{arguments}`` filled in.

    A message that is a key itself stands for that key. One that nothing knows is shown as it is, as is a text of which
    an argument is missing. texts: (language, key, text), one row each.
    """
    pick = lambda lang, name: texts.where(F.col("language") == lang).groupBy("key").agg(F.min("text").alias(name))
    found = matched(rows, patterns, column).withColumn("__key", F.coalesce("key", F.col(column)))
    for lang, name in ((language, "__a"), (default, "__b")):
        found = found.join(pick(lang, name).withColumnRenamed("key", "__key"), "__key", "left")
    text = F.coalesce("__a", "__b", F.col("key"), F.col(column))
    names = F.map_keys("args")
    filled = F.aggregate(F.map_entries("args"), text, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    wanted = F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), 1)
    whole = F.size(F.array_except(wanted, names)) == 0
    return found.withColumn("shown", F.when(whole, filled).otherwise(text)).drop("__key", "__a", "__b", "key", "args")
