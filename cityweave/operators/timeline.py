"""The city at every tick at once: counts and level as a sweep over change points.

An event is active over an interval of ticks, a situation from its reveal on, its pulse steady between two
milestones. Counts are running sums of what begins and ends at a tick. The highest pulse at a tick is the
highest over the situations' intervals that hold it: an interval is a few aligned blocks of 1, 2, 4, ... ticks,
a block keeps its highest pulse, and a tick lies in one block of each size. So the work follows the events,
milestones and ticks, not their products, and no tick, cell or situation gathers rows in one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as sv, times
from ..params import DEFAULT, Params
from . import serve as srv
from .scale import broadcast_if_small, running_before, stage

SPAN = 1 << 12  # ticks that a task sums along


def _first_at(t: Column, t0: int, tick_sec: int) -> Column:
    """The first tick at or after a second."""
    return F.ceil((t - t0) / tick_sec)


def _running(ticks: DataFrame, changes: DataFrame, out: str) -> DataFrame:
    """``ticks`` (tick) with the sum of ``changes`` (tick, change) up to each of them; a change before the
    first tick counts from there on."""
    at = changes.groupBy(F.greatest(F.col("tick"), F.lit(0)).alias("tick")).agg(F.sum("change").alias("change"))
    d = ticks.join(at, "tick", "left").withColumn("change", F.coalesce("change", F.lit(0))).withColumn("_all", F.lit(0))
    d = running_before(d, ["_all"], ["tick"], F.floor(F.col("tick") / SPAN), F.col("change"), out)
    return d.select("tick", (F.col(out) + F.col("change")).alias(out))


def pulse_intervals(situations: DataFrame, ms: DataFrame, reveals: DataFrame) -> DataFrame:
    """(situation_id, from_t, to_t, pulse_score) in seconds, the end excluded and null for ever: the pulse of a
    situation as its members become known, from its reveal on. Members confirmed at one time are one
    row before the running sums, so a situation costs its steps."""
    t = times.epoch(F.col("milestone"))
    steps = ms.groupBy("situation_id", t.alias("t")).agg(F.max("severity").alias("sev"), F.sum(F.col("confidence").cast("decimal(9,4)")).alias("conf"), F.count("*").alias("n"))
    news = ms.groupBy("situation_id", "source").agg(F.min(t).alias("t")).groupBy("situation_id", "t").agg(F.count("*").alias("src"))
    facts = situations.join(reveals, "situation_id").select("situation_id", F.col("pulse_score").alias("final"), times.epoch(F.col("reveal_utc")).alias("rev"))
    nothing = facts.select("situation_id", F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("double").alias("sev"), F.lit(0).cast("decimal(9,4)").alias("conf"),
                           F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("src"))  # before the first milestone
    d = steps.join(news, ["situation_id", "t"], "left").na.fill(0, ["src"]).select("situation_id", "t", "sev", "conf", "n", "src").unionByName(nothing)
    w = Window.partitionBy("situation_id").orderBy(F.col("t").asc_nulls_first())
    whole = Window.partitionBy("situation_id")
    d = d.select("situation_id", "t", F.lead("t").over(w).alias("to_t"), F.max("sev").over(w).alias("sev"), F.sum("conf").over(w).cast("double").alias("conf"),
                 F.sum("n").over(w).alias("known"), F.sum("src").over(w).alias("src"), F.sum("n").over(whole).alias("total"))
    d = d.join(facts, "situation_id")
    pulse = F.when(F.col("known") == 0, 0).when(F.col("known") < F.col("total"), sv.pulse(F.col("sev"), F.col("conf") / F.col("known"), F.col("src"))).otherwise(F.col("final"))
    start = F.greatest(F.coalesce("t", "rev"), F.col("rev"))
    return d.select("situation_id", start.alias("from_t"), "to_t", pulse.cast("bigint").alias("pulse_score")).filter("to_t is null or to_t > from_t")


def _highest(ticks: DataFrame, intervals: DataFrame, n: int, value: str) -> DataFrame:
    """``ticks`` with the highest ``value`` of the intervals (a, b, value) of ticks, b excluded, that hold each.

    Of a size of 2^j ticks an interval takes at most its first and its last block, if they are odd and even."""
    levels = range(max(n, 1).bit_length())
    blocks = []
    for j in levels:
        lo, hi = F.ceil(F.col("a") / (1 << j)).cast("bigint"), F.floor(F.col("b") / (1 << j)).cast("bigint")
        some = lo < hi
        blocks += [F.when(some & (lo % 2 == 1), F.struct(F.lit(j).alias("j"), lo.alias("k"))), F.when(some & (hi % 2 == 1), F.struct(F.lit(j).alias("j"), (hi - 1).alias("k")))]
    kept = intervals.select(value, F.explode(F.array_compact(F.array(*blocks))).alias("x")).groupBy("x.j", "x.k").agg(F.max(value).alias(value))
    kept = broadcast_if_small(stage(kept, "tick-blocks"))
    at = ticks.select("tick", F.posexplode(F.array(*[F.shiftright(F.col("tick"), j) for j in levels])).alias("j", "k"))
    return at.join(kept, ["j", "k"]).groupBy("tick").agg(F.max(value).alias(value))


def tick_timeline(events: DataFrame, situations: DataFrame, ms: DataFrame, reveals: DataFrame, t0: int, n: int, tick_sec: int = 1, p: Params = DEFAULT) -> DataFrame:
    """(tick, sim_time_utc, events_active, events_new, situations_active, cells_touched, created, updated,
    city_pulse_score, city_alert_level) at the seconds t0, t0 + tick_sec, ..., n of them: at each what
    ``serve.counts``, ``serve.city_rollup`` and ``serve.situation_deltas`` say of it."""
    spark = events.sparkSession
    ticks = spark.range(n).withColumnRenamed("id", "tick")
    at = lambda t: _first_at(t, t0, tick_sec)
    start, end = times.epoch(F.col("start_utc")), times.epoch(F.col("end_utc"))
    e = events.select(at(start).alias("a"), F.when(end.isNotNull(), F.floor((end + p.active_window_sec - t0) / tick_sec) + 1).alias("b"))
    e = e.groupBy("a", "b").agg(F.count("*").alias("n")).filter("b is null or b > a").filter(F.col("a") < n)
    e = stage(e, "tick-events")
    moves = e.select(F.col("a").alias("tick"), F.col("n").alias("change")).unionByName(e.filter(F.col("b") < n).select(F.col("b").alias("tick"), (-F.col("n")).alias("change")))
    new = events.filter(start > t0 - tick_sec).groupBy(at(start).alias("tick")).agg(F.count("*").alias("events_new"))

    shown = situations.filter(F.col("status") == "active")
    seen = reveals.withColumn("rev", times.epoch(F.col("reveal_utc"))).select("situation_id", "rev")
    active = stage(shown.join(seen, "situation_id").select("situation_id", "is_decoy", "h3_cells", at(F.col("rev")).alias("tick")), "tick-situations")
    one = F.lit(1).cast("bigint")
    cells = active.select(F.explode("h3_cells").alias("cell"), "tick").groupBy("cell").agg(F.min("tick").alias("tick"))
    city = active.filter(~F.col("is_decoy")).select("situation_id")
    spans = pulse_intervals(situations, ms, reveals).join(city, "situation_id", "left_semi")
    spans = spans.select(F.greatest(at(F.col("from_t")), F.lit(0)).alias("a"), F.least(F.coalesce(at(F.col("to_t")), F.lit(n)), F.lit(n)).alias("b"), "pulse_score").filter("a < b")

    created = seen.filter(F.col("rev") > t0 - tick_sec).groupBy(at(F.col("rev")).alias("tick")).agg(F.count("*").alias("created"))
    hit = ms.select("situation_id", times.epoch(F.col("milestone")).alias("m")).join(seen, "situation_id").withColumn("tick", at(F.col("m")))
    hit = hit.filter((F.col("m") > t0 - tick_sec) & (F.col("rev") <= t0 + (F.col("tick") - 1) * tick_sec))
    updated = hit.select("situation_id", "tick").distinct().groupBy("tick").agg(F.count("*").alias("updated"))

    d = _running(ticks, moves, "events_active")
    for table in (_running(ticks, active.select("tick", one.alias("change")), "situations_active"), _running(ticks, cells.select("tick", one.alias("change")), "cells_touched"),
                  new, created, updated, _highest(ticks, spans, n, "pulse_score")):
        d = d.join(table, "tick", "left")
    pulse = F.coalesce("pulse_score", F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return d.select("tick", F.timestamp_seconds(F.lit(t0) + F.col("tick") * tick_sec).alias("sim_time_utc"),
                    *[zero(c) for c in ("events_active", "events_new", "situations_active", "cells_touched", "created", "updated")],
                    pulse.cast("bigint").alias("city_pulse_score"), sv.alert_level(pulse).alias("city_alert_level"))


def tick_messages(timeline: DataFrame, speed: float, state: str = "playing") -> DataFrame:
    """The clock's message of every tick."""
    d = timeline.select("sim_time_utc", "tick", F.lit(float(speed)).alias("speed"), F.lit(state).alias("state"), "events_active", "situations_active", "city_pulse_score", "city_alert_level")
    return srv._message(d, "tick", F.col("sim_time_utc"), d.columns)
