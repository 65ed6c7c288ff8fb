"""Slices of a stream are read by many tasks, and streams of several feeds run side by side."""
import os
import threading

from pyspark.sql import functions as F

from catalog import base, streams
from cityweave.streaming import live


def test_a_slice_has_a_file_for_every_core(spark, tmp_path, monkeypatch):
    """Slices of fewer rows than a file holds were one file, so one task, each."""
    monkeypatch.setattr(streams, "SLICE_ROWS", 20)
    monkeypatch.setattr(streams, "TASK_ROWS", 20)
    rows = lambda: spark.range(1000).select("id", (F.col("id") * 3).alias("at"))
    path, schema, files, (lo, hi, ticks) = streams.slices_of(spark, str(tmp_path), "unit-files", rows, "at")
    assert files == min(7, spark.sparkContext.defaultParallelism) and (lo, hi, ticks) == (0, 2997, 50)
    got = spark.read.schema(schema).parquet(path)
    assert len(got.inputFiles()) == files * streams.MOST
    assert sorted(r.id for r in got.collect()) == list(range(1000))


def test_stores_are_drained_side_by_side(spark, tmp_path, monkeypatch):
    """Each store waits for the others to begin; one after the other they would never meet."""
    meet = threading.Barrier(3)
    made = lambda name: lambda s, d: (meet.wait(20), name)[1]
    monkeypatch.setattr(streams, "STORES", {f: made(f) for f in "abc"})
    assert streams.all_stores(spark, str(tmp_path)) == list("abc")
    base._MEMO.clear()


def test_state_is_a_partition_a_core(spark, tmp_path):
    """A micro-batch wrote the files of as many states as the session has shuffle partitions, most of them empty."""
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        spark.range(40).select(F.timestamp_seconds("id").alias("received_at"), F.lit("a").alias("source")).write.parquet(str(tmp_path / "in"))
        x = spark.readStream.schema("received_at timestamp, source string").parquet(str(tmp_path / "in"))
        got = live.run_once(live.live_rates(x, 10, 0), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert sorted((r.t, r.n) for r in got.collect()) == [(0, 10), (10, 10), (20, 10)]
        states = [f for f in os.listdir(tmp_path / "cp" / "state" / "0") if f.isdigit()]
        assert len(states) == spark.sparkContext.defaultParallelism and spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
