"""The same operators over streams: feeds, live windows and anomalies, duplicates, deltas, health
changes and rates. Episodes, outages and complaints as they become known are in ``upserts``."""
from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import severity as sv, times
from ..operators import detect as dt
from ..operators import ingest as ig
from ..operators import serve as srv
from ..params import DEFAULT, Params
from ..sources import readers
from .upserts import Carried, own


# ------------------------------------------------------------------ sources and clocks -----
def feed_stream(spark: SparkSession, folder: str, feed: str, files_per_trigger: int = 100) -> DataFrame:
    """A feed folder as a stream of parsed rows with ``arrived`` (file time) for ordering."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
             .withColumn("arrived", F.col("_metadata.file_modification_time")))
    if feed == "civic_complaints":
        return readers.parse_complaint_lines(lines)
    return readers.parse_json_lines(lines, feed)


def tolerate(stream: DataFrame, t: str = "t", drift_sec: int = 90, delay_sec: int = 0) -> DataFrame:
    """Watermark wide enough for clocks that drift and feeds that are held back."""
    return stream.withWatermark(t, f"{drift_sec + delay_sec} seconds")


def drop_resent(stream: DataFrame, key: str = "event_id", t: str = "start_utc", within_sec: int = 7200) -> DataFrame:
    """Each event counts once even when it is served again inside the watermark."""
    return stream.withWatermark(t, f"{within_sec} seconds").dropDuplicatesWithinWatermark([key])


@contextmanager
def state_a_core(spark: SparkSession):
    """A stream with state that starts inside keeps it in a partition a core, or fewer where the session says so. Every
    partition of state writes and commits its files in every micro-batch, however few rows it holds, and nothing
    joins small ones afterwards as in a batch. A stream keeps the number it began with."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(int(was), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into parquet and return the table."""
    with state_a_core(stream.sparkSession):
        q = (stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# ------------------------------------------------------------------ windows and rates -------
def live_windows(events: DataFrame, p: Params = DEFAULT, late_sec: int = 600) -> DataFrame:
    """Sliding counts with late data up to ``late_sec``; a window is emitted once it is final. Events are
    first reduced to a row a step, as in the batch form, and steps feed the windows over them."""
    steps = (events.withWatermark("start_utc", f"{late_sec} seconds")
             .groupBy(F.window("start_utc", f"{p.step_sec} seconds").alias("step"), "h3_cell", "category")
             .agg(F.count("*").alias("n"), F.sum(F.col("severity").cast(dt.SEV)).alias("sev"), F.collect_set("source").alias("src")))
    return (steps.groupBy(F.window(F.window_time("step"), f"{p.window_sec} seconds", f"{p.step_sec} seconds"), "h3_cell", "category")
            .agg(F.sum("n").alias("observed"), F.sum("sev").cast("double").alias("severity_weighted"), F.collect_set("src").alias("src"))
            .select("h3_cell", "category", F.unix_timestamp("window.start").alias("w"), "observed", "severity_weighted",
                    F.array_sort(F.array_distinct(F.flatten("src"))).alias("source_feeds")))


LEARNT = "grain string, h3_cell bigint, category string, hour bigint, support bigint, rate double, active_cells bigint, n_days double, p_rare double"


def publish_baseline(baseline: DataFrame, n_days: float, p_rare: float, path: str, version: int) -> None:
    """Store what windows are tested against (``baseline.learn``, its days and the rare threshold) as a version;
    a running stream takes it up with its next batch."""
    rows = baseline.withColumn("n_days", F.lit(float(n_days))).withColumn("p_rare", F.lit(float(p_rare)))
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def anomaly_writer(path: str, baselines: str, events: Callable[[SparkSession, int, int], DataFrame], since: int | None = None,
                   degraded_feeds=(), p: Params = DEFAULT):
    """``foreachBatch`` function over final windows (``live_windows``): tests them against the newest stored
    baseline, and writes the anomalies and the bridge to their events. ``events(spark, t0, t1)`` gives the
    events that start from t0 to t1, of which the flagged windows' are read; windows from before
    ``since``, when the stream began, are not whole and left out. A batch that is run again keeps to the
    version it began with."""
    state = Carried(path)

    @own
    def write(batch: DataFrame, n: int, keep) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(LEARNT + ", version bigint").parquet(baselines)
        state.settle(known.agg(F.max("version").alias("version")), "used", n)
        version = state.settled(spark, "used", "version bigint", n).first()[0]
        base = known.filter(F.col("version") == version)
        learnt = base.select("n_days", "p_rare").first()
        windows = batch if since is None else batch.filter(F.col("w") >= since)
        tested = dt.test_windows(keep(windows, "live-windows"), base.drop("n_days", "p_rare", "version"), learnt["n_days"], dims.categories(spark), p)
        found = keep(dt.flag(tested, learnt["p_rare"], degraded_feeds, p), "live-anomalies")
        state.put(found, "anomalies", n)
        t0, t1 = found.agg(F.min(times.epoch(F.col("window_start_utc"))), F.max(times.epoch(F.col("window_end_utc")))).first()
        if t0 is not None:
            state.put(dt.anomaly_members(found, events(spark, t0, t1), p), "members", n)

    return write


def live_rates(events: DataFrame, tick_sec: int = 1, late_sec: int = 90) -> DataFrame:
    """Events per tick and feed."""
    return (events.withWatermark("received_at", f"{late_sec} seconds")
            .groupBy(F.window("received_at", f"{tick_sec} seconds"), "source").agg(F.count("*").alias("n"))
            .select(F.unix_timestamp("window.start").alias("t"), "source", "n"))


def tick_totals(events: DataFrame, tick_sec: int = 1, late_sec: int = 90) -> DataFrame:
    """Events per tick over all feeds, with how many feeds spoke."""
    return (events.withWatermark("received_at", f"{late_sec} seconds")
            .groupBy(F.window("received_at", f"{tick_sec} seconds")).agg(F.count("*").alias("events"), F.size(F.collect_set("source")).cast("bigint").alias("feeds"))
            .select(F.unix_timestamp("window.start").alias("t"), "events", "feeds"))


# ------------------------------------------------------------------ deltas ------------------
def delta_writer(reveals: DataFrame, ms: DataFrame, path: str, situations: DataFrame = None):
    """``foreachBatch`` function over a stream of clock times ``t``: emits situations created and
    updated since the previous tick, with their message as far as they are known by then where
    ``situations`` are given. A batch is one tick; with a column ``tick`` it holds the whole of several, in their order, which
    are worked on at once. A batch reads the clock that the one before it left and rewrites only its own
    folders, so a retried batch gives the same output."""
    state = Carried(path)

    @own
    def write(batch: DataFrame, batch_id: int, keep) -> None:
        spark = batch.sparkSession
        t = times.epoch(F.col("t"))
        tick = F.col("tick") if "tick" in batch.columns else F.lit(0)
        ticks = batch.groupBy(tick.alias("tick")).agg(F.min(t).alias("first"), F.max(t).alias("clock"))
        prev = state.before(spark, "clock", "clock bigint", batch_id).agg(F.max("clock")).first()[0]
        before = F.max("clock").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1))  # one row a tick
        prev_of = F.greatest(before, F.lit(prev).cast("bigint"))  # of those that are known
        spans = ticks.select(F.coalesce(prev_of, F.col("first") - 1).alias("prev"), "clock").filter("clock > prev")
        spans = keep(spans, "live-ticks")
        cur = spans.agg(F.max("clock")).first()[0]
        if cur is None:
            state.leave(spark.range(0, 1, 1, 1).select(F.lit(prev).cast("bigint").alias("clock")), "clock", batch_id)
            return
        d = srv.deltas_of_ticks(reveals, ms, spans)
        if situations is not None:
            d = keep(d, "live-deltas")
            known = srv.partial_situations_at(situations, ms, reveals, d, spans)
            said = srv.situation_message(known, d, F.timestamp_seconds("clock"), ["clock"])
            d = said.select("situation_id", "action", "data", "clock")
        state.put(d, "deltas", batch_id)
        state.leave(spark.range(0, 1, 1, 1).select(F.lit(int(cur)).cast("bigint").alias("clock")), "clock", batch_id)
    return write


# ------------------------------------------------------------------ health ------------------
def health_writer(path: str, p: Params = DEFAULT, late_sec: int = 90):
    """``foreachBatch`` function over arrivals (feed, t): writes (feed, state, t) whenever a feed's
    state changes. Rows with a null feed are ticks of a clock (see ``with_clock``): they move the time
    on, so a feed falls silent even when nothing at all arrives. A batch is first reduced to the last arrival per feed and minute, so a busy
    feed costs its minutes; the state kept between batches is one row per feed, and the batch before
    left it. Like ``delta_writer``, a batch rewrites only its own folders."""
    carried, state_ddl = Carried(path), "feed string, last bigint, state string"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        limit = F.coalesce(sv.interval_of(F.col("feed")) * p.stale_intervals, F.lit(0))
        t = times.epoch(F.col("t"))
        prev = carried.before(spark, "state", state_ddl, batch_id)
        now = batch.agg(F.max(t)).first()[0]
        if now is None:
            carried.leave(prev, "state", batch_id)
            return
        m = batch.filter("feed is not null").groupBy("feed", F.floor(t / 60).alias("minute")).agg(F.max(t).alias("last"))
        rows = m.select("feed", "last", F.lit(None).cast("string").alias("state")).unionByName(prev)
        w = Window.partitionBy("feed").orderBy("last", F.col("state").isNull())
        d = rows.withColumn("_p", F.lag("last").over(w)).withColumn("_s", F.lag("state").over(w))
        new = d.filter("state is null")
        gap = F.col("_p").isNotNull() & (F.col("last") - F.col("_p") > limit)
        live = new.filter(F.col("_p").isNull() | gap | (F.col("_s") == "stale")).select("feed", F.lit("live").alias("state"), F.col("last").alias("t"))
        late = new.filter(gap & ~F.coalesce(F.col("_s") == "stale", F.lit(False))).select("feed", F.lit("stale").alias("state"), (F.col("_p") + limit + 1).alias("t"))
        tail = rows.groupBy("feed").agg(F.max("last").alias("last"), F.max_by("state", F.struct("last", F.col("state").isNull())).alias("state"))
        silent = F.col("last") + limit < now - late_sec
        ends = tail.filter(silent & ~F.coalesce(F.col("state") == "stale", F.lit(False))).select("feed", F.lit("stale").alias("state"), (F.col("last") + limit + 1).alias("t"))
        out = live.unionByName(late).unionByName(ends)
        carried.put(out.select("feed", "state", F.timestamp_seconds("t").alias("t")), "changes", batch_id)
        state = tail.select("feed", "last", F.when(silent | (F.col("state") == "stale"), "stale").otherwise("live").alias("state"))
        carried.leave(state, "state", batch_id)
    return write


def stale_feeds(arrivals: DataFrame, feeds: DataFrame, now, p: Params = DEFAULT) -> DataFrame:
    """Feeds whose last arrival is older than the limit (batch view of the same rule)."""
    return ig.feed_health(arrivals, feeds, now, p=p).filter("state = 'stale'").select("feed", "age_sec")


def with_clock(arrivals: DataFrame, clock: DataFrame) -> DataFrame:
    """Arrivals (feed, t) and the ticks ``t`` of a clock stream, such as the rate source's, as one stream."""
    return arrivals.select("feed", "t").unionByName(clock.select(F.lit(None).cast("string").alias("feed"), "t"))
