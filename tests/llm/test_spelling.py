import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from cityweave.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def brute_counts(rows, least=7):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def variants(r, n, alphabet):
    words = {"".join(r.choice(alphabet) for _ in range(r.randint(3, 9))) for _ in range(n)}
    for w in list(words):
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(w))
            words.add(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1:]]))
    words.discard("")
    return {w: r.choice([2, 3, 20, 30, 200, 3000, 3000]) for w in words}


@pytest.mark.parametrize("block, tile, held", [(512, 1 << 22, 1 << 15), (4, 1 << 22, 1 << 15), (1, 60, 5), (40, 300, 50)])
def test_near_words_forms_and_roots(spark, monkeypatch, block, tile, held):
    """Blocks opened down to one place, tiles smaller than a meeting, batches that part meetings."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    counts = {**variants(random.Random(block), 150, "abß"), **variants(random.Random(3), 100, "xyzéäöüñ"), "a": 5, "aa": 50, "aaa": 500, "a" * 700: 2, "a" * 701: 40,
              "好的意思": 3, "好的意": 40, "😀😀b": 2, "😀b": 30}
    df = spark.createDataFrame([*counts.items()], "word string, n long").selectExpr("*", "1 as form", "2 as L", "3 as key").repartition(3)
    run = spelling.compared

    def small(cells):
        def patched(it):
            spelling.TILE, spelling.HELD_ROWS = tile, held
            return it
        spelling.TILE, spelling.HELD_ROWS = tile, held
        return run(cells.mapInArrow(patched, cells.schema))

    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "HELD_ROWS", held)
    monkeypatch.setattr(spelling, "compared", small)
    got = spelling.group_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute(counts)


def test_texts_to_words(spark):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdéÀ×÷Z") for _ in range(r.randint(5, 11))) for _ in range(60)]
    rows = [(i, r.choice([" ", ", ", "1", "中", "\n"]).join(r.choices(vocabulary, k=60))) for i in range(60)] + [(None, " ".join(vocabulary)), (7, None), (8, ""), (9, "Abcdefgh " * 50_000)]
    rows += [(3, "samesame word"), (3, "samesame word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n").repartition(4)
    assert {x.word: x.n for x in spelling.word_counts(df).collect()} == brute_counts(rows)


def test_counts_are_handed_on_in_parts(spark):
    rows = [(i, f"{chr(97 + i % 26) * 8} {chr(97 + i % 7) * 9}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {x.word: x.n for x in spelling.word_counts(df).collect()} == brute_counts(rows)


def test_ties_nulls_and_empty(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "zzzzzzz": 9}
    df = spark.createDataFrame([*counts.items(), (None, 4), ("", 9)], "word string, n long")
    got = sorted(tuple(r) for r in spelling.group_variants(df).collect())
    assert got == brute(counts) and got[0][1] == "abcdefh"
    assert spelling.group_variants(df.limit(0)).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_check_sql_on_a_fixture(spark, tmp_path):
    r = random.Random(4)
    vocabulary = [*variants(r, 30, "abcdefgé")]
    vocabulary = [w * 2 for w in vocabulary if len(w) > 3]
    rows = [(i, " ".join(r.choices(vocabulary, weights=[1 + 300 * (k % 9 == 0) for k in range(len(vocabulary))], k=300)).upper()) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(spelling.ORACLE_SQL).fetchall())
    got = sorted(tuple(x) for x in spelling.op12_spelling_variants(spark, str(tmp_path)).collect())
    assert got == want == brute(brute_counts(rows))
    assert any(x[1] for x in got)
