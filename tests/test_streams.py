"""Streams over several micro-batches give what the batch operators give."""
import json
import os

from pyspark.sql import functions as F

from cityweave.operators import ingest as ig
from cityweave.sources import readers
from cityweave.streaming import live, upserts


def test_episodes_across_micro_batches(spark, tmp_path):
    values = [0, 6, 9, 7, 1, 0, 8, 8, 2, 30, 31, 32]
    recs = [{"station_id": s, "ts": 1758719520 + 300 * i, "lat": 26.9, "lon": 75.8, "rain_mm_15min": float(x), "temp_c": 20.0, "rh_pct": 50, "wind_kph": 1}
            for i, x in enumerate(values) for s in ("A", "B")]
    src = tmp_path / "in"
    src.mkdir()
    for i in range(0, len(recs), 5):
        f = src / f"p{i:03d}.json"
        f.write_text("\n".join(json.dumps(r) for r in recs[i:i + 5]) + "\n")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order
    batch = readers.read_jsonl(spark, str(src), "weather_imd").withColumn("seq", F.col("ts"))
    marked = ig.mark_islands(ig.weather_measures(batch), drop_unlocated=True)
    want = sorted(str(tuple(r)) for r in ig.island_candidates(marked).select("entity", "category", "seq", "raw_ref", "start_utc", "end_utc", "measure").collect())
    stream = live.feed_stream(spark, str(src), "weather_imd", files_per_trigger=1).withColumn("seq", F.col("ts"))
    q = (ig.weather_measures(stream).writeStream.foreachBatch(upserts.episode_writer(str(tmp_path / "out"), drop_unlocated=True, candidates=True))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(str(tuple(r)) for r in spark.read.parquet(str(tmp_path / "out" / "candidates")).select("entity", "category", "seq", "raw_ref", "start_utc", "end_utc", "measure").collect())
    assert got == want and len(got) > 10


def test_health_changes_across_batches(spark, tmp_path):
    write = live.health_writer(str(tmp_path / "h"))
    def batch(n, rows):
        write(spark.createDataFrame(rows, "feed string, s bigint").select("feed", F.timestamp_seconds("s").alias("t")), n)
    batch(0, [("weather_imd", 0), ("weather_imd", 300), ("civic_complaints", 0), ("civic_complaints", 900)])
    batch(1, [("weather_imd", 5000), ("civic_complaints", 960)])
    batch(1, [("weather_imd", 5000), ("civic_complaints", 960)])  # a retried batch changes nothing
    got = sorted((r["feed"], r["state"], r["s"]) for r in spark.read.parquet(str(tmp_path / "h" / "changes")).select("feed", "state", F.unix_timestamp("t").alias("s")).collect())
    assert got == sorted([("weather_imd", "live", 0), ("weather_imd", "stale", 1201), ("weather_imd", "live", 5000), ("civic_complaints", "live", 0), ("civic_complaints", "stale", 181),
                          ("civic_complaints", "live", 900), ("civic_complaints", "stale", 1141)])


def test_deltas_across_batches(spark, tmp_path):
    t = lambda s: F.timestamp_seconds(F.lit(s))
    reveals = spark.createDataFrame([("S1", 100), ("S2", 250)], "situation_id string, s bigint").select("situation_id", F.timestamp_seconds("s").alias("reveal_utc"))
    ms = spark.createDataFrame([("S1", 50), ("S1", 100), ("S1", 260), ("S2", 200), ("S2", 250)], "situation_id string, s bigint").select("situation_id", F.timestamp_seconds("s").alias("milestone"))
    write = live.delta_writer(reveals, ms, str(tmp_path / "d"))
    for n, s in enumerate((60, 120, 300)):
        write(spark.range(1).select(t(s).alias("t")), n)
    got = sorted((r["clock"], r["situation_id"], r["action"]) for r in spark.read.parquet(str(tmp_path / "d" / "deltas")).collect())
    assert got == [(120, "S1", "created"), (300, "S1", "updated"), (300, "S2", "created")]


def test_messages_of_situations_that_share_their_shown_text(spark, tmp_path):
    """Each situation gets its own action and payload, in the batch form and in the stream's."""
    from cityweave.operators import serve
    keys = ["SIT-abcdef" + str(k) * 34 for k in range(3)]
    when = lambda rows, c: spark.createDataFrame(rows, "situation_id string, s bigint").select("situation_id", F.timestamp_seconds("s").alias(c))
    reveals = when([(k, 100 + 100 * n) for n, k in enumerate(keys)], "reveal_utc")
    ms = when([(keys[0], 250)], "milestone").unionByName(when([(k, 90) for k in keys], "milestone"))
    ms = ms.selectExpr("*", "0.5D as severity", "0.5D as confidence", "'a' as source", "'b' as category")
    situations = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "situation_id string, pulse_score bigint").selectExpr("*", "'low' as confidence_level", "'green' as alert_level", "'active' as status")
    shown = serve.partial_situations(situations, ms, reveals, 300)
    said = serve.situation_message(shown, serve.situation_deltas(reveals, ms, 150, 300), 300).collect()
    want = sorted([(keys[0], "updated", 0), (keys[1], "created", 1), (keys[2], "created", 2)])
    assert sorted((r.situation_id, r.action, json.loads(r.data)["pulse_score"]) for r in said) == want
    assert {json.loads(r.data)["situation_id"] for r in said} == {"SIT-abcdef"}
    write = live.delta_writer(reveals, ms, str(tmp_path / "d"), situations)
    for n, s in enumerate((150, 300)):
        write(spark.range(1).select(F.timestamp_seconds(F.lit(s)).alias("t")), n)
    got = spark.read.parquet(str(tmp_path / "d" / "deltas")).filter("clock = 300").collect()
    assert sorted((r.situation_id, r.action, json.loads(r.data)["pulse_score"]) for r in got) == want
