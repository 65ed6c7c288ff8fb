"""Running counts of tables with many keys: hot keys go by chunks, others whole, and results are the same."""
import random

import pytest
from pyspark.sql import functions as F

from cityweave.operators import ingest as ig
from cityweave.operators import scale
from cityweave.params import DEFAULT


@pytest.mark.parametrize("hot", [0, 40, 1000])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_before_hot(spark, monkeypatch, hot, width):
    """All, some or no keys are hot; the null key counts for itself."""
    monkeypatch.setattr(scale, "HOT_ROWS", hot)
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice([None, "a", "b"]), i, rnd.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    got = scale.running_before_hot(df, ["k"], ["o"], F.floor(F.col("o") / width), F.col("x"), "s")
    assert sorted(got.columns) == ["k", "o", "s", "x"]
    got, seen = {r["o"]: r["s"] for r in got.collect()}, {}
    assert len(got) == len(rows)
    for k, o, x in rows:
        assert got[o] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + x


def readings(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("AAAB"), n, rnd.choice([20.0, 70.0])) for n in range(200)]
    return spark.createDataFrame(rows, "entity string, seq bigint, measure double").select(
        "*", F.lit("air_sensors").alias("source"), F.lit("air.pm25").alias("category"), F.lit(False).alias("fault"), F.lit(True).alias("located"))


def test_islands_of_hot_keys_are_those_of_whole_keys(spark, monkeypatch):
    p, shown = DEFAULT.but(chunk_rows=5), []
    for hot in (0, 1000):
        monkeypatch.setattr(scale, "HOT_ROWS", hot)
        shown.append(sorted((r.entity, r.seq, r.island) for r in ig.mark_islands(readings(spark), p).collect()))
    assert shown[0] == shown[1] and len(shown[0]) == 200


def test_keys_that_are_not_hot_need_no_totals(spark):
    """Chunks of 500 positions over many entities hold about a row each: totals were a second table of that size, joined."""
    plan = ig.mark_islands(readings(spark), DEFAULT.but(chunk_rows=5))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1
