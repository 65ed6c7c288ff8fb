import numpy as np
import pytest

from cityweave.llm import vectors


def brute(rows, threshold):
    ok, vec = [], []
    for _, e, label in rows:
        good = label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)
        ok.append(good)
        vec.append(np.array(e, np.float32).astype(np.float64) if good else None)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]):
                link[i, j] = vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j]) >= threshold
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == comp:
            break
        comp = new
    names = {}
    for i in range(n):
        names.setdefault(comp[i], []).append(rows[i][0])
    cid = [min((x for x in names[comp[i]] if x is not None), default=None) for i in range(n)]
    return sorted(((rows[i][0], int(link[i].sum()), cid[i], rows[i][0] == cid[i]) for i in range(n)), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).selectExpr("*", "1 as node", "2 as part", "3 as n_links")
    return sorted((tuple(r) for r in vectors.near_duplicates(df, **kw).collect()), key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(150):
        v = centres[i % 6] + rng.normal(size=24) * rng.choice([0.1, 0.2, 0.3, 2.0])
        rows.append((i * 7 % 1000, [float(np.float32(x)) for x in v], int(i % 3) if i % 17 else None))
    rows += [(2000 + i, rows[0][1], rows[1][2]) for i in range(30)]
    assert run(spark, rows, block=block) == brute(rows, 0.93)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [1.0, inf], 0), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, -0.0], 0), (11, [1.0, 0.0, 0.0], 0), (None, [3.0, 0.0], 0), (12, [1.0, 0.0], 1), (None, None, 0)]
    assert run(spark, rows) == brute(rows, 0.93)
    assert run(spark, []) == []


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) * rng.lognormal(sigma=2, size=(300, 64))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, r, e = vectors.quantize(u)
    approx = (q.astype(np.float64) @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - approx) <= e[:, None] + r[:, None] * e[None, :] + 1e-12).all()
