"""Steps that every registered stream of episodes or outages takes: slices, writes of a batch, versions to events."""
import threading

from pyspark.sql import functions as F

from catalog import columns, streams
from cityweave.streaming import upserts


def test_slices_are_one_shuffle(spark, tmp_path, monkeypatch):
    """Every slice was shuffled anew to make its files. The rows come in order, so that a task of the first pass has one slice."""
    monkeypatch.setattr(streams, "SLICE_ROWS", 20)
    monkeypatch.setattr(streams, "TASK_ROWS", 20)
    x, calls = spark.range(0, 1000, 1, 8), []
    was = type(x).repartition
    monkeypatch.setattr(type(x), "repartition", lambda d, *a: (calls.append(a), was(d, *a))[1])
    path, schema, files, _ = streams.slices_of(spark, str(tmp_path), "unit-once", lambda: x, "id")
    assert len(calls) == 1
    parts = spark.read.schema(schema).parquet(path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()
    assert len(parts) == files * streams.MOST and sum(r.n for r in parts) == 1000 and max(r.n for r in parts) < 60


def test_weather_slices_hold_what_the_stream_reads(spark):
    """They held four more texts a row than it reads, written twice."""
    x = streams.weather_stream(spark, "/root/testdata/sf0.001")
    assert set(streams.slices_of(spark, "/root/testdata/sf0.001", "rows", None, "event_id")[1].names) == {"event_id", "entity", "t", "value", "lat", "lon"}
    assert x.isStreaming


def test_writes_run_side_by_side(spark):
    meet = threading.Barrier(3)
    upserts.together(spark, *[lambda: meet.wait(20)] * 3)


def readings(spark, rows):
    return spark.createDataFrame(rows, "entity string, seq bigint, measure double").select(
        "*", F.lit("air_sensors").alias("source"), F.lit("air.pm25").alias("category"), F.lit(False).alias("fault"), F.lit(True).alias("located"),
        F.timestamp_seconds("seq").alias("t"), F.concat(F.lit("air_sensors:"), "entity", F.lit("@"), F.col("seq").cast("string")).alias("raw_ref"), F.lit(26.9).alias("lat"),
        F.lit(75.8).alias("lon"), F.lit(7).cast("bigint").alias("h3_cell"), F.lit(0.9).alias("confidence"), F.lit("direct").alias("resolution"))


def test_events_of_versions_are_one_shuffle(spark, tmp_path):
    """Versions met by key and opening, and events then by key, each with rows of all columns shuffled and sorted."""
    write = upserts.episode_writer(str(tmp_path))
    for n, rows in enumerate(([("A", 1, 70.0), ("B", 2, 20.0)], [("A", 3, 90.0), ("B", 4, 80.0)], [("A", 5, 10.0)])):
        write(readings(spark, rows), n)
    e = upserts.current_events(spark, str(tmp_path))
    assert e._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = sorted((r.raw_ref, r.measure, r.ended) for r in e.select("raw_ref", "measure", F.col("end_utc").isNotNull().alias("ended")).collect())
    assert got == [("air_sensors:A@1", 90.0, True), ("air_sensors:B@4", 80.0, False)]


def test_readings_are_written_once(spark, tmp_path, monkeypatch):
    """A batch was staged as it came and, for candidates, once more with its marks."""
    names, was = [], upserts.stage
    monkeypatch.setattr(upserts, "stage", lambda table, name, held: (names.append(name), was(table, name, held))[1])
    upserts.episode_writer(str(tmp_path), candidates=True)(readings(spark, [("A", 1, 70.0), ("A", 2, 20.0)]), 0)
    assert names == ["live-marked", "live-segments"]
    assert spark.read.parquet(str(tmp_path / "candidates")).count() == 2


def test_writes_of_outages_run_side_by_side(spark, tmp_path, monkeypatch):
    """Versions, open trips and candidates were written one after the other; each now waits for the others to begin."""
    meet, was, seen = threading.Barrier(3), upserts.together, []

    def together(s, *writes):
        seen.append(len(writes))
        was(s, *[lambda w=w: (meet.wait(60), w()) for w in writes])

    monkeypatch.setattr(upserts, "together", together)
    records = columns.power_records(spark, "/root/testdata/sf0.001")
    upserts.outage_writer(str(tmp_path), candidates=True)(records, 0)
    trips = records.filter("resolved and opens").select(F.sum(F.size("emits"))).first()[0]
    assert seen == [3] and spark.read.parquet(str(tmp_path / "versions")).count() == trips > 0
    assert spark.read.parquet(str(tmp_path / "candidates")).count() >= trips and (tmp_path / "open" / "batch=0").exists()
