"""Events of a stream, upserted batch by batch, are those of the batch operators."""
import os
import random

import pytest
from pyspark.sql import functions as F

from cityweave.functions import ids
from cityweave.operators import ingest as ig
from cityweave.params import DEFAULT
from cityweave.streaming import live, upserts

P = DEFAULT.but(chunk_rows=5)
T0 = 1_758_700_000


def cut(df, column, bounds):
    """The rows of each batch."""
    edges = [None, *bounds, None]
    for a, b in zip(edges, edges[1:]):
        d = df if a is None else df.filter(F.col(column) >= a)
        yield d if b is None else d.filter(F.col(column) < b)


def run(writer, batches, again=()):
    for n, b in enumerate(batches):
        writer(b, n)
        if n in again:
            writer(b, n)  # a retried batch changes nothing


def shown(events):
    return sorted(str(tuple(r)) for r in events.select(*sorted(events.columns)).collect())


@pytest.fixture(scope="module")
def readings(spark):
    r = random.Random(4)
    rows = []
    for seq in range(160):
        entity = r.choice(["A", "A", "A", "A", "B", "C"])  # one entity holds most readings
        value = r.choice([None, -1.0, 20.0, 70.0, 90.0, 120.0, 61.0])
        rows.append((entity, seq, T0 + 60 * (seq // 2), value, value is None or value == -1.0, r.random() < 0.85, round(r.choice([0.3, 0.6, 0.9]), 2)))
    d = spark.createDataFrame(rows, "entity string, seq bigint, s bigint, measure double, fault boolean, located boolean, confidence double")
    t = F.timestamp_seconds("s")
    return d.select(F.lit("air_sensors").alias("source"), "entity", F.lit("air.pm25").alias("category"), "seq", t.alias("t"), F.lit(26.9).alias("lat"), F.lit(75.8).alias("lon"), "located",
                    F.lit(7).cast("bigint").alias("h3_cell"), "measure", "fault", ids.ref_at_epoch("air_sensors", F.col("entity"), t).alias("raw_ref"), "confidence",
                    F.lit("direct").alias("resolution"))


@pytest.mark.parametrize("bounds, drop", [([], False), ([5, 7, 8, 60, 61, 62, 150], True), ([80], False)])
def test_episodes_of_any_cut_are_the_batchs(spark, tmp_path, readings, bounds, drop):
    """One entity's readings, cut into up to eight batches and each batch into chunks of five positions."""
    marked = ig.mark_islands(readings, P, drop)
    root = str(tmp_path / "s")
    run(upserts.episode_writer(root, P, drop, candidates=True), cut(readings, "seq", bounds), again=(1, 3))
    got = spark.read.parquet(f"{root}/candidates").drop("batch")
    assert shown(got) == shown(ig.island_candidates(marked).select(*got.columns))
    want = ig.fold(ig.build_events(ig.island_episodes(marked).drop("n_candidates"))).drop("seq", "n_candidates")
    assert shown(upserts.current_events(spark, root)) == shown(want)
    if bounds:
        left = os.listdir(f"{root}/open")
        assert sorted(left) == sorted(f"batch={k}" for k in (len(bounds) - 1, len(bounds)))  # no older state is kept
        upserts.compact(spark, root, len(bounds))
        assert os.listdir(f"{root}/versions") == [f"batch={len(bounds)}"] and shown(upserts.current_events(spark, root)) == shown(want)


@pytest.mark.parametrize("bounds", [[], [20, 21, 22, 60]])
def test_outages_of_any_cut_are_the_batchs(spark, tmp_path, bounds):
    r = random.Random(6)
    rows = []
    for seq in range(120):
        restore = r.random() < 0.45
        emits = [] if restore else [(c, m) for c, m in (("power.outage", 900.0), ("traffic.signal_down", 2.0)) if r.random() < 0.7]
        rows.append((r.choice(["F1", "F1", "F1", "F2", "F3"]), seq, T0 + 60 * (seq // 3), restore, emits or None, r.random() < 0.9, None if r.random() < 0.8 else 0.4))
    d = spark.createDataFrame(rows, "entity string, seq bigint, s bigint, is_restore boolean, emits array<struct<category:string,measure:double>>, resolved boolean, cap double")
    t = F.timestamp_seconds("s")
    records = d.select(F.lit("power_discom").alias("source"), "entity", "seq", t.alias("t"), F.lit(26.9).alias("lat"), F.lit(75.8).alias("lon"), F.lit(7).cast("bigint").alias("h3_cell"),
                       "resolved", "is_restore", "emits", "cap", ids.ref_at_epoch("power_discom", F.col("entity"), t).alias("raw_ref"), F.lit(0.72).alias("confidence"),
                       F.lit("registry").alias("resolution"), (~F.col("is_restore") & (F.coalesce(F.size("emits"), F.lit(0)) > 0)).alias("opens"))
    root = str(tmp_path / "s")
    run(upserts.outage_writer(root, P, candidates=True), cut(records, "seq", bounds), again=(2,))
    want = ig.outage_candidates(ig.pair_outages(records, P))
    got = spark.read.parquet(f"{root}/candidates").drop("batch")
    assert shown(got) == shown(want.select(*got.columns)) and got.filter("end_utc is not null").count() > 10
    assert shown(upserts.current_events(spark, root)) == shown(ig.fold(ig.build_events(want)).drop("seq", "n_candidates"))


@pytest.mark.parametrize("bounds", [[2000, 4000, 4100, 8000]])
def test_complaints_count_their_neighbours_also_when_late(spark, tmp_path, bounds):
    """Records arrive up to 500 seconds late, some twice, once closed; a third is of one cell."""
    r = random.Random(8)
    rows = []
    for seq in range(140):
        t = r.randrange(0, 9000)
        rows.append((seq, f"C-{seq}", T0 + t, r.choice([1, 1, 2, 3]), r.choice(["complaint.waterlogging", "complaint.waterlogging", "complaint.garbage", "traffic.signal_down"]), "OPEN", t + r.randrange(0, 500)))
        if r.random() < 0.2:
            rows.append((seq + 1000, *rows[-1][1:5], "CLOSED", min(rows[-1][6] + 60, t + 590)))
    d = spark.createDataFrame(rows, "seq bigint, complaint_id string, s bigint, h3_cell bigint, category string, status string, arrived bigint")
    records = d.select("seq", "complaint_id", F.timestamp_seconds("s").alias("t"), "h3_cell", "category", "status", "arrived", F.lit(26.9).alias("lat"), F.lit(75.8).alias("lon"),
                       F.lit(None).cast("string").alias("drop_reason"))
    root = str(tmp_path / "s")
    run(upserts.complaint_writer(root, P, late_sec=600), cut(records, "arrived", bounds), again=(1,))
    want = ig.cluster_complaints(ig.fold(ig.build_events(ig.complaint_candidates(records))), P).drop("seq", "n_candidates")
    got = upserts.current_events(spark, root)
    assert shown(got) == shown(want) and got.agg(F.max("measure")).first()[0] > 5
    if bounds:  # what is carried is the last half hour and ten minutes, not the whole past
        kept = spark.read.parquet(f"{root}/recent/batch={len(bounds)}")
        assert kept.agg(F.min("start_sec")).first()[0] >= T0 + 8999 - 600 - 1800 - 200 and kept.count() < got.count()


def test_complaints_later_than_the_limit_are_left_out(spark, tmp_path):
    row = lambda seq, s: (seq, f"C-{seq}", T0 + s)
    make = lambda rows: spark.createDataFrame(rows, "seq bigint, complaint_id string, s bigint").select(
        "seq", "complaint_id", F.timestamp_seconds("s").alias("t"), F.lit(1).cast("bigint").alias("h3_cell"), F.lit("complaint.garbage").alias("category"), F.lit("OPEN").alias("status"),
        F.lit(26.9).alias("lat"), F.lit(75.8).alias("lon"), F.lit(None).cast("string").alias("drop_reason"))
    root = str(tmp_path / "s")
    run(upserts.complaint_writer(root, P, late_sec=100), [make([row(1, 1000)]), make([row(2, 899), row(3, 901)]), make([]), make([row(4, 1001)])])
    got = {r.raw_ref.split(":")[1]: r.measure for r in upserts.current_events(spark, root).collect()}
    assert got == {"C-1": 2.0, "C-3": 1.0, "C-4": 3.0}


def test_state_of_many_batches_is_that_of_the_last(spark, tmp_path):
    """After many batches the clocks and health states of two batches are left, and no more was read."""
    t = lambda s: F.timestamp_seconds(F.lit(s))
    reveals = spark.createDataFrame([("S1", 100), ("S2", 250)], "situation_id string, s bigint").select("situation_id", F.timestamp_seconds("s").alias("reveal_utc"))
    ms = reveals.select("situation_id", F.col("reveal_utc").alias("milestone"))
    deltas, health = live.delta_writer(reveals, ms, str(tmp_path / "d")), live.health_writer(str(tmp_path / "h"))
    for n in range(12):
        deltas(spark.range(1).select(t(60 + 20 * n).alias("t")), n)
        health(spark.range(1).select(F.lit("weather_imd").alias("feed"), t(300 * n + (5000 if n > 8 else 0)).alias("t")), n)
    assert sorted(os.listdir(tmp_path / "d" / "clock")) == sorted(os.listdir(tmp_path / "h" / "state")) == ["batch=10", "batch=11"]
    assert sorted((r.situation_id, r.action) for r in spark.read.parquet(str(tmp_path / "d" / "deltas")).collect()) == [("S1", "created"), ("S2", "created")]
    got = sorted((r.s, r.state) for r in spark.read.parquet(str(tmp_path / "h" / "changes")).select(F.unix_timestamp("t").alias("s"), "state").collect())
    assert got == [(0, "live"), (3301, "stale"), (7700, "live")]
