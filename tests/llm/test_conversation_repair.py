"""Repair of conversations against an exhaustive search and against its SQL."""

import hashlib
import itertools
import random
import re

import pytest
from compare import connect, plain

from sparkmill.llm import op11_conversation_repair as op11

SCHEMA = "conv_id long, turn long, role string, text string, cost string, key int"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, lines) by trying every edit of every row and up to two inserted rows in every gap."""
    best = None
    found = faults(rows)
    for ways in itertools.product(*(["D"] if f in ("blank", "duplicate") else ["K", "Ruser", "Rassistant", "D"] for f in found)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            for first in itertools.product(("user", "assistant"), repeat=sum(g > 0 for g in gaps)):
                cost, audit, lines, k = 0, "", [], 0
                for i, gap in enumerate(gaps):
                    if gap:
                        names = [first[k], "user" if first[k] == "assistant" else "assistant"][:gap]
                        k += 1
                        lines += [(n, "") for n in names]
                        cost, audit = cost + 5 * gap, audit + "I" * gap
                    if i < len(rows):
                        way, (role, text) = ways[i], rows[i]
                        cost += {"K": 0, "R": 1, "D": 2}[way[0]] + 5 * (way != "D" and found[i] == "truncated")
                        audit += way[0]
                        if way != "D":
                            lines.append((way[1:] or role, text))
                if re.fullmatch("(s?(ua)+)?", "".join(n[:1] or "?" for n, _ in lines)):
                    best = min(best or (99, "", []), (cost, audit, lines))
    return best


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_small_conversations_against_all_edits(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut", " \t\n", "", "Why?  \n", "long " * 50 + "end."]
    rows, want = [], {}
    for c in range(60):
        own = []
        for t in range(rng.randrange(1, 4)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice([*texts, None, f"Own {t}."])
            own.append((role, text))
            rows.append((c, 3 * t if t else None, role, text, "own", 1))
        shown = [(" " if r is None else r, " " if x is None else x) for r, x in own]
        found = faults(shown)
        initials = [r[:1] for r, _ in shown]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        want[c] = (*(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *exhaustive(shown))
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = op11.digest(table, table).collect()
    assert len(got) == 60
    for r in got:
        *counts, cost, audit, lines = want[r["conv_id"]]
        assert [r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]] == [*counts, cost, audit]
        assert r["repaired_sha256"] == digest(lines)


def plainly(rows):
    """The same by states over ordered rows, for long conversations."""
    found, best = faults(rows), {0: (0, "", [])}

    def inserted(best):
        out = dict(best)
        for state, (cost, audit, lines) in best.items():
            for n in (1, 2):
                name = "assistant" if state == 2 else "user"
                state, cost, audit, lines = 3 if state == 2 else 2, cost + 5, audit + "I", [*lines, (name, "")]
                out[state] = min(out.get(state, (10**9, "")), (cost, audit, lines))
        return out

    for fault, (role, text) in zip(found, rows, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            name = "assistant" if state == 2 else "user"
            ways = [(state, cost + 2, audit + "D", lines)]
            if fault in ("", "truncated"):
                more = cost + 5 * (fault == "truncated")
                ways.append((3 if state == 2 else 2, more + 1, audit + "R", [*lines, (name, text)]))
                if role[:1] == name[0]:
                    ways.append((3 if state == 2 else 2, more, audit + "K", [*lines, (role, text)]))
                if role[:1] == "s" and state == 0:
                    ways.append((1, more, audit + "K", [*lines, (role, text)]))
            for to, *rest in ways:
                after[to] = min(after.get(to, (10**9, "")), tuple(rest))
        best = after
    ended = inserted(best)
    return min(ended[s] for s in (0, 3) if s in ended)


@pytest.mark.parametrize(("block", "fan"), [(1, 2), (3, 3), (7, 64)])
def test_long_conversations_in_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(op11, "BLOCK", block)
    monkeypatch.setattr(op11, "FAN", fan)
    rng = random.Random(block)
    rows, want = [], {}
    for c, n in [(None, 500), (7, 150), (8, 1), (-9, 40)]:
        own = [(rng.choice(["user", "assistant", "system", "sysop", "x"]), rng.choice(["Yes.", f"Own {t}.", f"cut {t}", " ", f"Two {t}?\n"])) for t in range(n)]
        rows += [(c, 2 * t + 10, *r, "own", 1) for t, r in enumerate(own)]
        want[c] = (n - 1, *plainly(own))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    said, lines = op11.repair(table)
    got = {r["conv_id"]: r for r in said.collect()}
    assert set(got) == set(want)
    text = {}
    for r in sorted(lines.collect(), key=lambda r: (r["key"], r["seq"])):
        text.setdefault(r["key"], []).append((r["role"], r["text"]))
    for c, (gaps, cost, audit, kept) in want.items():
        assert (got[c]["gaps"], got[c]["cost"], got[c]["audit"]) == (gaps, cost, audit)
        assert text.get(got[c]["key"], []) == kept


def test_ties_and_repeated_rows(spark):
    """Rows of one turn come by role; rows equal in all but one place are duplicates; a turn may repeat."""
    rows = [(1, 5, "user", "Hi.", "", 0)] * 300 + [(1, 5, "assistant", "Yes.", "", 0), (1, 6, "assistant", "Done.", "", 0), (1, 2**62, "user", "x.", "", 0), (2, None, "user", "Hi.", "", 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    said, _ = op11.repair(table)
    got = {r["conv_id"]: r for r in said.collect()}
    assert got[1]["audit"] == "D" + "K" + "D" * 299 + "KD" and got[1]["cost"] == 2 * 301
    assert (got[1]["duplicate"], got[1]["illegal"], got[1]["gaps"]) == (299, 299, 2**62 - 5 + 1 - 3)
    assert (got[2]["gaps"], got[2]["audit"], got[2]["cost"]) == (0, "D", 2)


def test_damage_and_rows_without_any(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in (None, 1, 2, 3) for t in (None, 0, 1, 2, 3, 4, 5, 6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = (c, t, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
        want += [one] * (0 if way == 0 else 2 if way == 3 else 1)
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, op11.damaged(table).collect()), key=order) == sorted(want, key=order)
    nothing = op11.digest(table.limit(0), table).collect()
    assert len(nothing) == 4 and {tuple(r)[1:] for r in nothing} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert op11.digest(table.limit(0), table.limit(0)).count() == 0


def test_query_against_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert plain(op11.query(spark, folder).toPandas()) == plain(connect(folder).execute(op11.SQL).fetchdf())
