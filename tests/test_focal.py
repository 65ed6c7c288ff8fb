"""Kernels of any shape slide at the cost of their outline and give what every offset by itself gives."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityweave.operators import raster as ra

GAUSS = {(a, b): math.exp(-(a * a + b * b) / 6.0) for a in range(-3, 4) for b in range(-3, 4)}
KERNELS = {"disk": ra.disk(7.5, 1.0), "square": ra.square(5), "gauss": GAUSS, "one": {(0, 0): 2.0}, "lopsided": {(0, 1): 1.0, (0, 2): 1.0, (-2, 0): 3.0, (1, -4): 0.5},
           "ring": {k: 1.0 for k in ra.disk(5, 1.0) if k not in ra.disk(3, 1.0)}, "row": {(0, b): 1.0 for b in range(-6, 7)}, "negative": {(a, b): float(a) for a in range(-2, 3) for b in range(-1, 2) if a}}


def brute(cells, kernel, how, nearest):
    rows, cols = [k[0] for k in cells], [k[1] for k in cells]
    box = min(rows), max(rows), min(cols), max(cols)
    out = {}
    for r, c in cells:
        seen = []
        for (a, b), w in kernel.items():
            at = (min(max(r + a, box[0]), box[1]), min(max(c + b, box[2]), box[3])) if nearest else (r + a, c + b)
            if at in cells:
                seen.append((w, cells[at]))
        out[r, c] = max((v for _, v in seen), default=-math.inf) if how == "max" else sum(w * v for w, v in seen)
        if how == "mean":
            out[r, c] /= sum(w for w, _ in seen)
    return out


@pytest.mark.parametrize("name", KERNELS)
@pytest.mark.parametrize("how", ["mean", "sum", "max"])
def test_against_every_offset(spark, name, how):
    kernel, r = KERNELS[name], random.Random(1)
    if how == "mean" and name in ("negative", "lopsided"):
        pytest.skip("weights that may add up to nothing")
    full = how == "sum"
    cells = {(i, j): round(r.random() * 100, 2) for i in range(-9, 12) for j in range(20) if full or r.random() < 0.9 or name in ("ring",)}
    grid = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row int, col int, value double")
    for mode in ("existing", "nearest") if full else ("existing",):
        want = brute(cells, kernel, how, mode == "nearest")
        got = {(x.row, x.col): x.focal for x in ra.focal(grid, kernel, how=how, mode=mode, tile=8).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_work_follows_the_outline():
    steps = lambda k, flat=False: sum(map(len, ra.kernel_plan(k, flat)))
    wide = ra.disk(1000, 8)
    assert len(wide) > 49_000 and steps(wide) == 251 and steps(wide, True) == 251
    assert steps(ra.square(101)) == 2 and steps(GAUSS) <= 14


def test_sums_of_a_wide_disk():
    x = np.random.default_rng(1).random((40 + 60, 40 + 60))
    kernel = ra.disk(30, 1.0)
    want = sum(x[30 + a:70 + a, 30 + b:70 + b] for a, b in kernel)
    plan = ra.kernel_plan(kernel)
    assert np.allclose(ra._sums(x, plan, 40, 30, 30), want)
    assert np.array_equal(ra._highest(x, ra.kernel_plan(kernel, True), 40, 30, 30), np.maximum.reduce([x[30 + a:70 + a, 30 + b:70 + b] for a, b in kernel]))
