"""Ingest by units: one narrow shuffle a feed, the same events as all candidates folded at once."""
import random
import re

import pytest
from pyspark.sql import functions as F

from cityweave.operators import ingest as ig, places, scale
from cityweave.params import Params
from cityweave.plans import city
from test_ingest import IN, feeds, folder  # noqa: F401


def odd_feeds(spark):
    """Many units, some with references that other units have too: a time that can't be read, an "@" in a name."""
    rnd = random.Random(5)
    at = lambda k: f"2026-09-24T{6 + k // 60 % 12:02d}:{k % 60:02d}:00Z"
    ch = [{"tag": "LVL_CM", "v": 90.0}, {"tag": "BATT_V", "v": 12.6}]
    drains = [(rnd.choice(["R1", "R2", "R3", "R@4", None]), rnd.choice(["24/09/2026 18:00", "24/09/2026 18:10", "never"]),
               rnd.choice([[], ch, [{**ch[0], "v": 20.0}], [{**ch[0], "v": 120.5}, {**ch[1], "v": 10.0}]]), i) for i in range(150)]
    air = [(*rnd.choice([("a@1", at(i // 30)), ("a", "1@" + at(i // 30)), ("b", at(i // 30))]), rnd.choice([70.0, 90.25, 10.0, -1.0]), i, rnd.choice([26.9124, 10.0])) for i in range(150)]
    weather = [(rnd.choice("XYZ"), 1758719520 + 60 * (i // 20), rnd.choice([26.9124, 10.0, None]), 75.7873, rnd.choice([0.0, 6.0, 40.0, None]), rnd.choice([20.0, 45.0]), 50, i) for i in range(150)]
    power = [(rnd.choice(["F1", "F2", "F@3", None]), rnd.choice(["TRIP", "RESTORE", "SCHEDULED_CUT", None]), rnd.choice(["2026-09-24T18:00:00", "2026-09-24T18:10:00", "never"]),
              rnd.choice([10, 4000, None]), rnd.choice([True, False, None]), rnd.choice([0, 3, None]), i) for i in range(150)]
    complaints = [(f"J-{i % 60}" if i % 7 else None, f"24/09/2026 6:{i % 50:02d} PM", "W", "Sindhi Camp", "", "Water Logging", "", rnd.choice(["OPEN", "CLOSED"]), i) for i in range(80)]
    place = "id string, lat double, lon double"
    return dict(
        weather=spark.createDataFrame(weather, "station_id string, ts bigint, lat double, lon double, rain_mm_15min double, temp_c double, rh_pct int, seq bigint"),
        complaints=spark.createDataFrame(complaints, "complaint_id string, lodged_at string, ward string, locality string, landmark string, complaint_type string, text string, status string, seq bigint"),
        power=spark.createDataFrame(power, "feeder_id string, event string, reported_time string, affected_connections int, carries_signals boolean, signal_junctions int, seq bigint"),
        drains=spark.createDataFrame(drains, "rtu string, polled string, ch array<struct<tag: string, v: double>>, seq bigint"),
        air=spark.createDataFrame(air, "sensor string, captured string, pm25 double, seq bigint, latitude double").select(
            "sensor", "captured", "pm25", "seq", F.struct("latitude", F.lit(75.7873).alias("longitude")).alias("loc"), F.lit(True).alias("calibrated"), F.lit(50).alias("battery_pct")),
        feeders=spark.createDataFrame([(x, *IN.values(), 2) for x in ("F1", "F2", "F@3")], f"{place}, signal_junctions int"),
        channels=spark.createDataFrame([(x, *IN.values(), 100.0) for x in ("R1", "R2", "R@4")], f"{place}, capacity_cm double"))


@pytest.mark.parametrize("hot", [10, 40, 100_000])
def test_ingest_by_units_is_that_of_all_candidates_folded_at_once(spark, monkeypatch, hot):
    """All, some or no units are hot; what references share is folded over all units."""
    p, f = Params(chunk_rows=7), odd_feeds(spark)
    readings = [(ig.weather_measures(f["weather"]), True), (ig.air_readings(f["air"]), False), (ig.drain_readings(f["drains"], f["channels"]), True)]
    records = ig.power_records(f["power"], f["feeders"])
    candidates = [ig.island_episodes(ig.mark_islands(x, p, drop)) for x, drop in readings]
    candidates += [ig.outage_candidates(ig.pair_outages(records, p)), ig.complaint_candidates(ig.complaint_records(f["complaints"]))]
    union = ig.build_events(candidates[0])
    for c in candidates[1:]:
        union = union.unionByName(ig.build_events(c))
    folded = ig.fold(union)
    assert folded.filter("raw_ref is null").count() and folded.filter("raw_ref rlike '@.*@'").count() and folded.filter("n_candidates > 1").count()
    want = ig.cluster_complaints(folded, p).drop("seq", "n_candidates")
    monkeypatch.setattr(scale, "HOT_ROWS", hot)
    got = city.ingest(spark, p=p, **f)
    assert got.events.columns == want.columns
    assert sorted(map(str, got.events.collect())) == sorted(map(str, want.collect()))
    n = lambda d, *by: {tuple(r)[:-1]: r["count"] for r in d.groupBy(*by).count().collect()}
    drops = {(r["feed"], r["drop_reason"]): r["n"] for r in got.ledger.collect()}
    for (x, _), source in zip(readings[1:], ("air_sensors", "drain_scada")):
        reason = F.when(~F.col("located"), "unresolved").when(F.col("fault"), "faulty").alias("reason")
        assert {(source, *k): v for k, v in n(x, reason).items() if k[0]} == {k: v for k, v in drops.items() if k[0] == source}
    assert drops[("power_discom", "unresolved")] == records.filter("not resolved").count()


def test_ingest_leaves_no_readings_behind(spark, folder):
    """Five feeds' normalised readings stayed staged, beside the shuffles of whole rows: a job's disk was that of all feeds."""
    before = set(scale._staged)
    city.ingest(spark, **feeds(spark, folder))
    names = {x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in set(scale._staged) - before}
    assert names == {f"{x}-events" for x in ("weather", "air", "drains", "power", "register")} | {"feed-stats"}


def test_a_units_rows_are_shuffled_once(spark):
    """From a feed's columns to folded events: the shuffle by unit serves the island count, the islands and the fold."""
    f = odd_feeds(spark)
    parts = lambda c: ig.fold_parts(ig.build_events(c, keep=("entity",)), within=("entity",))
    islands = lambda x: parts(ig.island_episodes(ig.mark_islands(x, whole=True)))
    for d in (islands(ig.weather_measures(f["weather"].repartition("station_id"))), islands(ig.drain_readings(f["drains"], f["channels"], gather=True)),
              parts(ig.outage_candidates(ig.pair_outages(ig.power_records(f["power"], f["feeders"], gather=True), whole=True)))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_hot_units_are_dealt_out_by_chunk_after_a_shuffled_registry(spark, monkeypatch):
    """The join has all rows of a unit in one task; counted there, a hot unit would be sorted whole."""
    monkeypatch.setattr(scale, "HOT_ROWS", 10)
    monkeypatch.setattr(places, "broadcast_if_small", lambda df: df)
    f, limit = odd_feeds(spark), "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        d = ig.mark_islands(ig.drain_readings(f["drains"], f["channels"]), Params(chunk_rows=7))
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, old)
    window = plan[plan.index("Window ["):]
    assert re.match(r"Window .*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange hashpartitioning\([^\n]*_chunk", window), plan
