"""A stream of a table has a bounded number of micro-batches, whatever the table's size, and ticks don't depend on them."""
import random

from pyspark.sql import functions as F

from catalog import streams
from cityweave.operators import serve
from cityweave.streaming import live


def test_slices_do_not_become_more_with_the_rows(spark, tmp_path, monkeypatch):
    """50 ticks of rows, of which some spans have none or fewer rows than files: each row comes once, in order."""
    monkeypatch.setattr(streams, "SLICE_ROWS", 20)
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    rows = lambda: spark.range(1000).select("id", F.when(F.col("id") < 990, F.col("id") % 400).otherwise(F.col("id") * 10).alias("at"))
    x = streams.sliced(spark, str(tmp_path), "unit", rows, "at")
    seen = []
    q = x.writeStream.foreachBatch(lambda b, n: seen.append(sorted((r.at, r.id) for r in b.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == streams.MOST
    got = [r for b in seen for r in b]
    assert sorted(id for _, id in got) == list(range(1000)) and [a for a, _ in got] == sorted(a for a, _ in got)


def test_ticks_of_a_batch_are_those_of_batches_of_a_tick(spark, tmp_path):
    """Deltas and messages don't depend on how ticks are cut into batches, also where a situation appears without a member."""
    r = random.Random(5)
    when = lambda rows, c: spark.createDataFrame(rows, f"situation_id string, s bigint, severity double, confidence double, source string, category string").withColumn(c, F.timestamp_seconds("s")).drop("s")
    keys = [f"SIT-{k:06d}" + "0" * 34 for k in range(6)]
    ms = when([(k, r.randrange(0, 900), r.random(), round(r.random(), 2), r.choice("abc"), r.choice("xyz")) for k in keys for _ in range(9)], "milestone").localCheckpoint()
    reveals = spark.createDataFrame([(k, 90 * i + 45) for i, k in enumerate(keys)], "situation_id string, s bigint").select("situation_id", F.timestamp_seconds("s").alias("reveal_utc")).localCheckpoint()
    situations = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "situation_id string, pulse_score bigint").selectExpr("*", "'high' as confidence_level", "'green' as alert_level", "'active' as status")
    clock = [(n, t) for n in range(10) if n != 4 for t in (90 * n + 3, 90 * n + 80)]  # the fifth tick has no event
    ticks = lambda ns: spark.createDataFrame([x for x in clock if x[0] in ns], "tick bigint, s bigint").select("tick", F.timestamp_seconds("s").alias("t"))
    shown = {}
    for name, cut in (("one", [[n] for n in range(10) if n != 4]), ("many", [[0, 1, 2], [3, 5, 6, 7, 8, 9]])):
        write = live.delta_writer(reveals, ms, str(tmp_path / name), situations)
        for n, b in enumerate(cut):
            x = ticks(b)
            write(x if name == "many" else x.drop("tick"), n)
        rows = spark.read.parquet(str(tmp_path / name / "deltas")).collect()
        shown[name] = sorted((x.clock, x.situation_id, x.action, x.data) for x in rows)
    assert shown["one"] == shown["many"] and len(shown["one"]) >= 30 and len({x[0] for x in shown["one"]}) == 9
    for prev, t in ((260, 350), (620, 710)):  # as the snapshot at that time has it
        said = serve.situation_message(serve.partial_situations(situations, ms, reveals, t), serve.situation_deltas(reveals, ms, prev, t), t).collect()
        assert sorted((t, x.situation_id, x.action, x.data) for x in said) == [x for x in shown["many"] if x[0] == t] != []
