import hashlib
import random
import re
import zlib
from functools import cache

import duckdb
import numpy as np
import pytest

from cityweave.llm import repair

NOTHING = hashlib.sha256(b"").hexdigest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else str(x) for x in (conv, turn)]
        d = zlib.crc32(":".join(spaced).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
    return out


def brute_repair(rows):
    """By trying every sequence of edits from every state: (cost, audit, lines) of the least."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    move = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i, state, put):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        asked = "assistant" if state == 2 else "user"
        to = move[state][asked[0]]
        if put < 3:
            c, a, t = best(i, to, put + 1)
            found.append((c + repair.COSTS[repair.INSERT], "I" + a, (asked + ":",) + t))
        if i < len(rows):
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            _, _, role, text = rows[i]
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] in move[state]:
                    c, a, t = best(i + 1, move[state][role[:1]], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}",) + t))
                c, a, t = best(i + 1, to, 0)
                found.append((c + more + 1, "R" + a, (f"{asked}:{text}",) + t))
        return min(found, default=(10 ** 9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    turns = {r[1] for r in rows if r[1] is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(r, conv, n):
    rows = []
    for turn in range(n):
        role = r.choice(["user", "assistant", ("user", "assistant")[turn % 2], ("user", "assistant")[turn % 2], "system" if turn == 0 else "user", "tool", "", None])
        text = r.choice(["", " \n", "Yes.", "Yes.", "no end", "What? ", f"number {turn}.", f"number {turn}.", f"number {turn}!", f"cut {turn}", None, "é。", "two\nlines."])
        rows.append((conv, r.choice([turn, turn, turn, turn + 1, turn * 2, None]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [1024, 3, 1])
def test_cheapest_edits_least_audit(spark, monkeypatch, chunk):
    """Conversations of many lengths, in one chunk and cut into many."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    r = random.Random(chunk)
    rows = [x for c in range(120) for x in made(r, c, r.choice([1, 1, 2, 3, 4, 5, 7, 9, 14]))] + made(r, None, 8)
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as pos", "'x' as conv", "2 as cost", "3 as last").repartition(5)
    ids = spark.createDataFrame([(c,) for c in [*range(121), None, 5]], "conv_id long").selectExpr("*", "0 as gaps")
    spaced = [(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in rows]
    want = {c: brute_repair([x for x in spaced if x[0] == c]) for c in [*range(121), None]}
    got = {x[0]: tuple(x)[1:] for x in repair.repair(df, ids).collect()}
    assert got == want
    assert want[120] == (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert {k for w in want.values() for k in w[6]} == set("DKR")  # deleting a row is always cheaper than inserting one


def test_damage_and_check_sql(spark, tmp_path):
    r = random.Random(9)
    rows = [x for c in range(150) for x in made(r, c, r.choice([1, 2, 3, 4, 6, 8]))] + [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho.")] + [(500, t, "user", None) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda x: tuple((v is not None, v) if v is not None else (False, 0) for v in x)
    assert sorted((tuple(x) for x in repair.damaged(df).collect()), key=key) == sorted(brute_damage(rows), key=key)
    df.coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(repair.ORACLE_SQL).fetchall(), key=key)
    got = sorted((tuple(x) for x in repair.op13_conversation_repair(spark, str(tmp_path)).collect()), key=key)
    hurt = brute_damage(rows)
    by_hand = sorted(((c, *brute_repair([x for x in hurt if x[0] == c])) for c in {x[0] for x in rows}), key=key)
    assert got == by_hand
    assert want == by_hand


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 64)
    r = random.Random(2)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["", "same.", f"{t}.", f"{t}", f"{t}?"])) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = repair.repair(df, df).collect()
    import sys
    sys.setrecursionlimit(20_000)
    assert [tuple(x) for x in got] == [(1, *brute_repair(rows))]


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = repair.repair(df, df).first()
    assert got.audit == "KK" and got.repaired_sha256 == hashlib.sha256(("user:" + "x" * 300_000 + ".\nassistant:Yes.").encode()).hexdigest()
    assert repair.repair(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("insert", [1, 2, 5])
def test_ranks_order_whole_audits(monkeypatch, insert):
    """The choice by ranks of doubled lengths is that of comparing whole strings, also where turns are cheap to insert."""
    monkeypatch.setitem(repair.COSTS, repair.INSERT, insert)
    ends = np.array([[0, 2 * insert, insert, 0]])
    r = np.random.default_rng(insert)
    letters = set()
    for _ in range(150):
        n = int(r.integers(1, 12))
        code, fault = r.integers(0, 4, n), r.integers(0, 3, n)
        paths = repair.Paths(code, fault, np.array([0]), np.array([n]), ends, np.array([True]))
        _, _, letter = paths.walk(np.array([0]))
        rows = [(0, i, ("system", "user", "assistant", "tool")[c], f"{i}." if f == 0 else f"{i}" if f == 1 else "") for i, (c, f) in enumerate(zip(code, fault))]
        assert ("".join(repair.LETTERS[k] for k in letter), paths.cost[0, 0]) == (brute_repair(rows)[6], brute_repair(rows)[5])
        letters |= {repair.LETTERS[k] for k in letter}
    assert ("I" in letters) == (insert < 5)
