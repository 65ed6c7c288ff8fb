import random

import numpy as np
import pytest

from cityweave.llm import minhash

from . import brute

def run(spark, rows, percent, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", "doc_id as component_id", "text as set_id", "1 as id", "2 as key")
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent).collect()), key=str)


def check(spark, rows, percent, **kw):
    want = sorted(((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute.groups(rows, percent))), key=str)
    assert run(spark, rows, percent, **kw) == want


@pytest.mark.parametrize("tile_rows,percent", [(512, 85), (20, 80)])
def test_groups_of_near_copies(spark, prose, monkeypatch, tile_rows, percent):
    """Copies with one to three words changed lie on both sides of the threshold, and no original is there."""
    monkeypatch.setattr(minhash, "TILE_ROWS", tile_rows)
    rng, rows = random.Random(3), []
    for g in range(2):
        base = prose(130, g)
        for _ in range(70):
            w = list(base)
            for _ in range(rng.choice([1, 2, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((len(rows) * 7 % 1000, " ".join(w)))
    rows += [(2000 + i, " ".join(prose(40, 100 + i))) for i in range(30)]
    check(spark, rows, percent)


def test_edges(spark, prose):
    long_ = " ".join(prose(30_000, 1))
    text = " ".join(prose(30, 2))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, text), (7, text), (8, text.upper()), (9, text + " Z"),
            (10, long_), (11, long_ + " end"), (None, text), (None, None), (12, "É é"), (13, "é é"), (14, "a\x00b c"), (15, "a b c")]
    check(spark, rows, 85, extra=True)


def test_empty(spark):
    assert run(spark, [], 80) == []


def test_signature_is_a_min_wise_estimate(prose):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2 ** 63, 900, dtype=np.uint64), rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    x, y = np.unique(a), np.unique(np.concatenate([a[:600], b]))
    sig = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 2048)
    assert abs(np.mean(sig[0] == sig[1]) - 600 / 1200) < 0.05


def test_delta_links_against_sets(prose):
    rng = np.random.default_rng(2)
    base = rng.choice(10_000, 200, replace=False).astype(np.uint64)
    sets = []
    for _ in range(40):
        drop = rng.choice(200, rng.integers(0, 40), replace=False)
        sets.append(np.unique(np.concatenate([np.delete(base, drop), rng.integers(10_000, 10_060, rng.integers(0, 30)).astype(np.uint64)])))
    got = minhash.delta_links(np.array([len(s) for s in sets]), [np.setxor1d(s, base) for s in sets], 85)
    for i in range(40):
        for j in range(40):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both))


def near(prose, seed):
    """A text and two others: each like the one before, the first and last unlike."""
    w = prose(100, seed)
    one, two = [*w[:92], *prose(8, seed + 1)], [*prose(8, seed + 2), *w[8:92], *prose(8, seed + 1)]
    return [" ".join(x) for x in (w, one, two)]


def test_texts_of_null_ids_alone_take_part(spark, prose):
    """A null-id near copy is linked, and two documents are linked through one."""
    a, b, c = near(prose, 400)
    x, y, z = near(prose, 500)
    rows = [(5, a), (None, b), (6, c), (None, x), (None, y), (None, z), (None, a + " q"), (7, " ".join(prose(50, 9)))]
    assert {d: g for (d, _), (_, g) in zip(rows, brute.groups(rows, 80)) if d is not None} == {5: 5, 6: 5, 7: 7}
    check(spark, rows, 80)


def test_one_row_of_a_group_stays(spark, prose):
    """Copies under null ids, rows of one id and rows repeated whole give one row; texts without words stay."""
    a, b, c = near(prose, 400)
    x, y, z = near(prose, 500)
    rows = [(None, a), (None, a), (None, b), (None, c), (3, x), (3, x), (3, y), (4, z), (8, None), (8, None), (9, " "), (None, None), (7, " ".join(prose(50, 9)))]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, _id long").withColumnRenamed("_id", "n").repartition(3)
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    th = {r.text: r.th for r in df.selectExpr("text", "xxhash64(text) AS th").collect()}
    want = [(None, min((a, b, c), key=th.get)), (3, min((x, y), key=th.get)), *rows[8:]]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
