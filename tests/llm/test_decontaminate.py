import hashlib
import random

from pyspark.sql import functions as F

from cityweave.llm import decontaminate

from . import brute


def check(spark, rows, items, extra=False):
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    if extra:
        docs = docs.selectExpr("*", "1 as key", "text as window", "2 as len", "doc_id as n_hit")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    want = []
    for d, text in rows:
        n, h, named = brute.hit(text, items)
        ids = sorted(str(i) for i in named if i is not None)
        want.append((d, n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0))
    assert got == sorted(want, key=str)
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.filter("doc_id is not null").collect()) == sorted((w[0], r[1]) for w, r in zip(want, rows) if not w[2] and w[0] is not None) if all(r[1] is not None for r in rows if r[0] is not None) else True
    assert left.filter(F.col("text").isNull()).count() == sum(r[1] is None for r in rows)


def test_windows_in_documents(spark, prose):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng.choice([12, 30, 10]), i))) for i in range(12)]
    items += [(50, items[0][1]), (51, items[1][1] + " tail"), (60, "alpha, Beta: gamma"), (61, "zeta eta"), (62, "omega")]
    rows = []
    for i in range(50):
        w = prose(rng.randint(3, 80), 500 + i)
        if i % 3 == 0:
            v = brute.item_words(rng.choice(items)[1])
            a = rng.randrange(len(v))
            at = rng.randrange(len(w))
            w[at:at] = v[a:a + rng.randint(1, 25)]
        if i % 10 == 1:
            w += ["ALPHA", "beta--gamma"]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    check(spark, rows, items, extra=True)


def test_edges(spark, prose):
    text = " ".join(prose(40, 3))
    long_ = " ".join(prose(20_000, 4)) + " " + text
    items = [(1, text), (1, " ".join(prose(15, 9))), (None, " ".join(prose(15, 10))), (2, None), (3, ""), (4, "?!"), (5, "É été"), (7, text.upper())]
    rows = [(1, None), (2, ""), (3, "..."), (4, text), (4, text), (5, long_), (None, " ".join(prose(15, 10))), (6, "é ÉTÉ"), (7, "É été x"), (8, text * 3), (4, "else")]
    check(spark, rows, items)


def test_empty(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c"), (2, None)], [])
    check(spark, [(1, "a b c")], [(1, None)])
