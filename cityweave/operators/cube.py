"""One additive table of (cell, category, step): what baseline, windows and calibration are sums over.

A row counts the events of a step of a cell and category, by source, with their severity and first and last
second. Rows of one key add up, so a day is added without reading the days before, and every slice of time
that begins on a step is a filter. Hours, held-out days, histories and windows are such slices; a slice
that begins within a step takes that one step from the events."""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import times
from ..params import DEFAULT, Params
from .scale import with_scalars

KEYS = ["h3_cell", "category"]
SEV = "decimal(9,4)"  # severities have 4 decimals, so decimal sums do not depend on row order
DDL = "h3_cell bigint, category string, pane bigint, source string, n bigint, sev decimal(19,4), first bigint, last bigint"


def steps(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The cube's rows of events (h3_cell, category, source, severity, start_utc)."""
    t = times.epoch(F.col("start_utc"))
    return events.groupBy(*KEYS, (F.floor(t / p.step_sec) * p.step_sec).alias("pane"), "source").agg(
        F.count("*").alias("n"), F.sum(F.col("severity").cast(SEV)).alias("sev"), F.min(t).alias("first"), F.max(t).alias("last"))


def add(parts: DataFrame) -> DataFrame:
    """Rows of one key as one."""
    return parts.groupBy(*KEYS, "pane", "source").agg(F.sum("n").alias("n"), F.sum("sev").cast("decimal(19,4)").alias("sev"), F.min("first").alias("first"), F.max("last").alias("last"))


def store(events: DataFrame, path: str, p: Params = DEFAULT, batch: str = "0") -> None:
    """Add events to a stored cube, by day. ``batch`` names what is added: adding it again replaces it."""
    rows = steps(events, p).withColumn("day", F.to_date(F.timestamp_seconds("pane")))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, first_day=None, last_day=None) -> DataFrame:
    """A stored cube, or the days of it from ``first_day`` to ``last_day``."""
    d = spark.read.schema(DDL + ", batch string, day date").parquet(path)
    for bound, keep in ((first_day, F.col("day") >= F.lit(first_day)), (last_day, F.col("day") <= F.lit(last_day))):
        d = d if bound is None else d.filter(keep)
    return add(d.select(*[c.split()[0] for c in DDL.split(", ")]))


@dataclass
class Slices:
    """A cube and its events, cut at any second."""
    cube: DataFrame
    events: DataFrame
    p: Params

    @cached_property
    def sources(self) -> list[str]:
        return sources_of(self.cube)

    def span(self, t0: int | None = None, t1: int | None = None) -> DataFrame:
        """The cube's rows of events from t0 to before t1."""
        step, pane = self.p.step_sec, F.col("pane")
        whole, d = [], self.cube
        if t0 is not None:
            d = d.filter(pane >= -(-t0 // step) * step)
            whole += [(t0, min(-(-t0 // step) * step, t1 if t1 is not None else t0 + step))] if t0 % step else []
        if t1 is not None:
            d = d.filter(pane < t1 // step * step)
            whole += [(max(t1 // step * step, t0 if t0 is not None else t1 - step), t1)] if t1 % step and not (t0 is not None and t0 // step == t1 // step and t0 % step) else []
        for a, b in whole:  # parts of a step, from the events
            s = F.col("start_utc")
            d = d.unionByName(steps(self.events.filter((s >= F.timestamp_seconds(F.lit(a))) & (s < F.timestamp_seconds(F.lit(b)))), self.p))
        return d


def hourly(cube: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(h3_cell, category, hour, n): events by local hour of the day. Time zones differ by whole steps."""
    hour = times.local_hour(F.timestamp_seconds("pane"), p.tz).cast("bigint")
    return cube.groupBy(*KEYS, hour.alias("hour")).agg(F.sum("n").alias("n"))


def bounds(cube: DataFrame) -> tuple[int | None, int | None]:
    """(first, last) second of the cube's events: two numbers."""
    return tuple(cube.agg(F.min("first"), F.max("last")).first())


def pairs(cube: DataFrame) -> DataFrame:
    return cube.agg(F.count_distinct(*KEYS).alias("pairs"), F.sum("n").alias("events"))


def sources_of(cube: DataFrame) -> list[str]:
    """The feeds' names, in order: a handful."""
    return sorted(r["source"] for r in cube.select("source").distinct().collect() if r["source"] is not None)


def windows(cube: DataFrame, p: Params = DEFAULT, sources: list[str] | None = None) -> DataFrame:
    """(h3_cell, category, w, observed, severity_weighted, source_feeds) of every non-empty window of the step
    grid that lies within the slice, or begins with its first step.

    Sums run over a cell and category's steps, and a window is the difference of two of them: of the last
    step it holds and of the one before it. Each window is made once, by the first step it holds, so a hot
    cell costs its steps and its windows, and one shuffle deals all of it out."""
    step = p.step_sec
    if p.window_sec % step:
        raise ValueError("window_sec must be a multiple of step_sec")
    reach = p.window_sec - step
    sources = sources_of(cube) if sources is None else sources
    span = cube.agg(F.min("first").alias("t0"), F.max("last").alias("t1"))
    lo = F.floor(F.col("t0") / step) * step
    hi = F.when(F.col("t1") > F.col("t0") + p.window_sec, F.ceil((F.col("t1") - p.window_sec) / step) * step).otherwise(lo)
    span = span.select(lo.alias("lo"), hi.alias("hi"))

    # columns are named by their place: 0 counts, 1 severity, then a count for each source
    parts = [F.sum("n"), F.sum("sev"), *[F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)) for s in sources]]
    count = range(len(parts))
    panes = cube.repartition(*KEYS).groupBy(*KEYS, "pane").agg(*[x.alias(f"own{c}") for c, x in zip(count, parts)])
    along = Window.partitionBy(*KEYS).orderBy("pane")
    d = panes.select("*", *[F.sum(f"own{c}").over(along).alias(f"run{c}") for c in count], F.lag("pane").over(along).alias("before"))
    # a step, and the windows whose first step it is at the step where they end
    first = f"greatest(coalesce(before + {step}, pane - {reach}), pane - {reach})"
    d = d.selectExpr(*KEYS, *[f"run{c}" for c in count], *[f"run{c} - own{c} AS base{c}" for c in count],
                     f"explode(concat(array(named_struct('at', pane, 'w', CAST(NULL AS BIGINT))), transform(sequence({first}, pane, {step}L), w -> named_struct('at', w + {reach}, 'w', w)))) AS x")
    upto = Window.partitionBy(*KEYS).orderBy("at", F.col("w").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(*KEYS, "x.at", "x.w", *[f"base{c}" for c in count], F.when(F.col("x.w").isNull(), F.struct(*[f"run{c}" for c in count])).alias("run"))
    d = d.select(*KEYS, "w", *[f"base{c}" for c in count], F.last("run", ignorenulls=True).over(upto).alias("end")).filter("w is not null")
    d = with_scalars(d, span).filter("w between lo and hi")
    feeds = ", ".join(f"if(end.run{c + 2} > base{c + 2}, {_quoted(s)}, NULL)" for c, s in enumerate(sources))
    return d.selectExpr(*KEYS, "w", "end.run0 - base0 AS observed", "CAST(end.run1 - base1 AS DOUBLE) AS severity_weighted",
                        f"array_compact(CAST(array({feeds}) AS ARRAY<STRING>)) AS source_feeds")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
