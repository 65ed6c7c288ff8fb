import random
from collections import Counter, defaultdict

from cityweave.llm import packing


def one_by_one(lengths, opening):
    """Best fit decreasing, an item at a time: (capacity, used) of the bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += n
        else:
            bins.append([opening(n), n])
    return Counter(map(tuple, bins))


def test_groups_of_bins_are_best_fit():
    rng = random.Random(1)
    for _ in range(40):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 300))]
        for size in (64, 100):
            opening = lambda n, size=size: size if rng is None or n <= size else 100
            got = Counter()
            for at in packing.fill(Counter(lengths), opening).by_space.values():
                for _, n, capacity, used, _ in at:
                    got[capacity, used] += n
            assert got == one_by_one(lengths, opening)


def check(spark, rows, capacities=(8, 16, 32)):
    df = spark.createDataFrame(rows, "doc_id long, n_words long").repartition(3).selectExpr("*", "1 as length", "2 as bin", "3 as piece", "4 as low")
    got = packing.pack(df, capacities).collect()
    top = max(capacities)
    want = Counter((d, p, p * top, min(n - p * top, top)) for d, n in ((d, max(n or 0, 0)) for d, n in rows) for p in range(max(1, -(-n // top))))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        if r.length:
            bins[r.bin].append(r)
        else:
            assert r.bin is None and r.capacity is None and r.offset is None
    assert sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        assert len({r.capacity for r in held}) == 1 and held[0].capacity in capacities
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= held[0].capacity and not [c for c in capacities if at <= c < held[0].capacity]
    return got, bins


def test_every_piece_has_its_place(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 100)) for i in range(500)] + [(1000 + i, 7) for i in range(300)]
    got, bins = check(spark, rows)
    used = sum(r.length for r in got)
    assert used / sum(h[0].capacity for h in bins.values()) > 0.97


def test_edges(spark):
    check(spark, [(1, None), (2, 0), (3, -5), (4, 32), (4, 32), (None, 5), (None, None), (5, 1_000), (-(1 << 60), 1)])
    check(spark, [(1, 0), (2, None)])
    assert check(spark, [])[0] == []


def test_opens_the_cheapest_size():
    best = packing.plan({600: 10}, (512, 1024, 2048))
    total = sum(g[1] * packing.cost(g[2]) for g in best)
    assert total <= 10 * packing.cost(1024) and total <= 4 * packing.cost(2048)


def test_texts(spark):
    df = spark.createDataFrame([(1, "a b  c\n d"), (2, None), (3, " ")], "doc_id long, text string")
    assert {(r.doc_id, r.length) for r in packing.pack_texts(df).collect()} == {(1, 4), (2, 0), (3, 0)}
