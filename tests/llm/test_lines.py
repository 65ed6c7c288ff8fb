import random

import pytest

from cityweave.llm import lines

from . import brute


def check(spark, rows, percent=80, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if extra:
        df = df.selectExpr("doc_id as id", "1 as line", "'x' as lines", "*", "9 as n_lines")
    out = lines.dedup_lines(df, percent)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    want = brute.without_lines(list(dict.fromkeys(rows)), percent)
    texts = dict(rows)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n, left = (0, 0) if texts[r.doc_id] is None else (texts[r.doc_id].count("\n") + 1, r.n_lines - r.n_removed)
        assert r.text == want[r.doc_id] and r.n_lines == n, r
        assert texts[r.doc_id] is None or left == 0 or left == r.text.count("\n") + 1


@pytest.mark.parametrize("tile_rows,hot,percent", [(512, 10_000, 95), (10, 1, 80)])
def test_near_lines(spark, prose, monkeypatch, tile_rows, hot, percent):
    """Lines with no to three words changed, the original last; common passages inside longer lines."""
    monkeypatch.setattr(lines, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(lines, "HOT", hot)
    rng, rows = random.Random(3), []
    bases = [prose(n, 50 + n) for n in (40, 70, 100)]
    passage = prose(30, 7)
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10 ** 6)}"
            text.append(" ".join(w))
        text += [" ".join(prose(rng.randint(1, 12), 900 + i % 20)), "", " ".join(prose(20, 3000 + i) + passage + prose(20, 4000 + i))]
        rng.shuffle(text)
        rows.append((i * 7 % 61, "\n".join(text)))
    rows.append((100, "\n".join(" ".join(b) for b in bases)))
    check(spark, rows, percent)


def test_edges(spark, prose):
    line = " ".join(prose(25, 1))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line + "\n" + line.upper() + "\n"), (5, line), (None, line + " z"), (6, "a\nb c\nA"), (7, "a\r\nb"), (8, "\n" + line + "\n\n x"),
            (9, " ".join(prose(30_000, 5))), (10, "\n".join(["same old words here again and again"] * 3000)), (11, "é\nÉ")]
    check(spark, rows, extra=True)
    check(spark, [])
    repeated = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(repeated).collect()) == [(1, line), (1, line), (2, "")]


def test_texts_that_share_an_id_are_documents_of_their_own(spark, prose):
    """Null ids and one repeated id: what goes from one text stays in the others."""
    base = [" ".join(prose(20, 70 + k)) for k in range(6)]
    own = lambda k: " ".join(prose(20, 100 + k))
    rows = [(i, "\n".join([own(10 * n + k), base[n % 6], own(10 * n + 5 + k), base[(n + k) % 6] + " z"])) for n, i in enumerate([None] * 6 + [7] * 6 + [8]) for k in (0, 1)]
    rows += [(None, rows[0][1]), (7, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = sorted({(r.doc_id is not None, r.doc_id or 0, r.th, r.text) for r in df.selectExpr("*", "xxhash64(text) AS th").collect() if r.text is not None})
    want = brute.without_lines([(n, d[3]) for n, d in enumerate(docs)], 80)
    left = {(d[1] if d[0] else None, d[3]): want[n] for n, d in enumerate(docs)}
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(df).collect()), key=str) == sorted(
        ((i, t and left[i, t], 0 if t is None else t.count("\n") - left[i, t].count("\n")) for i, t in rows), key=str)
