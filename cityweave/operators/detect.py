"""Unusual windows: sliding counts, tail test, triggers, calibration."""
from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, times
from ..functions.poisson import with_poisson_tail
from ..params import DEFAULT, Params
from . import baseline as bl
from . import cube as cb
from .scale import one_row, stage, with_scalars
from ..functions.numbers import round_exact

SEV = cb.SEV


def window_counts(detection: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Count, severity and sources of every non-empty window of the step grid: events become the rows of a
    cube, windows are differences of its running sums (``cube.windows``)."""
    return cb.windows(stage(cb.steps(detection, p), "steps"), p)


def test_windows(windows: DataFrame, base: DataFrame, n_days: float, cats: DataFrame,
                 p: Params = DEFAULT) -> DataFrame:
    """Rate of the local hour the window starts in, tail probability and both trigger flags
    (``rare_ok`` is the rare rule without its probability threshold)."""
    d = windows.withColumn("hour", times.local_hour(F.timestamp_seconds("w"), p.tz).cast("bigint"))
    d = bl.expected_rate(d, base, n_days, p)
    hours = p.window_sec / 3600.0
    d = d.withColumn("expected", F.col("lam") * hours)
    d = with_poisson_tail(d, F.col("observed"), F.col("expected"), "p")
    if p.rare_rate == "all_hours":
        d = bl.all_hours_rate(d, base, n_days, p)
        d = with_poisson_tail(d, F.col("observed"), F.col("lam_all") * hours, "p_rare").drop("lam_all")
    else:
        d = d.withColumn("p_rare", F.col("p"))
    d = d.join(cats.select("category", "rare_eligible", "feeds"), "category", "left")
    volume = (F.col("observed") >= p.min_count) & (F.col("p") < p.p_volume)
    rare_ok = ((F.col("observed") >= p.rare_min_count) & F.coalesce("rare_eligible", F.lit(False))
               & (F.col("severity_weighted") >= p.rare_min_severity))
    return d.withColumn("volume", volume).withColumn("rare_ok", rare_ok)


def flag(tested: DataFrame, p_rare: float, degraded_feeds=(), p: Params = DEFAULT) -> DataFrame:
    """Anomalies: windows either rule fires on. ``volume`` wins the label."""
    bad = F.array(*[F.lit(f) for f in sorted(degraded_feeds)]).cast("array<string>")
    d = tested.filter(F.col("volume") | (F.col("rare_ok") & (F.col("p_rare") < p_rare)))
    start = F.timestamp_seconds("w")
    return d.select(
        ids.short_id("ANOM-", ids.KEY, F.col("h3_cell").cast("string"), F.col("category"), times.iso(start)).alias("anomaly_id"),
        "h3_cell", "category", start.alias("window_start_utc"),
        F.timestamp_seconds(F.col("w") + p.window_sec).alias("window_end_utc"),
        F.col("observed").alias("observed_count"), round_exact("expected", 4).alias("expected_count"),
        round_exact("p", 6).alias("p_value"), F.when(F.col("volume"), "volume").otherwise("rare").alias("trigger"),
        round_exact("severity_weighted", 4).alias("severity_weighted"), "source_feeds",
        F.array_sort(F.array_intersect(F.coalesce("feeds", "source_feeds"), bad)).alias("degraded_by_stale_feeds"))


def anomaly_members(anomalies: DataFrame, detection: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Bridge (anomaly_id, event_id): the steps of a flagged window, equi-joined to events."""
    step = p.step_sec
    w = anomalies.select("anomaly_id", "h3_cell", "category", F.explode(F.sequence(
        times.epoch(F.col("window_start_utc")), times.epoch(F.col("window_end_utc")) - step, F.lit(step).cast("bigint"))).alias("pane"))
    ev = detection.select("event_id", "h3_cell", "category",
                          (F.floor(times.epoch(F.col("start_utc")) / step) * step).alias("pane"))
    return w.join(ev, ["h3_cell", "category", "pane"]).select("anomaly_id", "event_id")


def blocks(tested: DataFrame) -> DataFrame:
    """(cell, category, clock hour) blocks with whether volume fired and the lowest rare p."""
    hour = F.date_format(F.timestamp_seconds("w"), "yyyy-MM-dd'T'HH")
    return tested.groupBy("h3_cell", "category", hour.alias("block")).agg(
        F.max("volume").alias("volume"), F.min(F.when(F.col("rare_ok"), F.col("p_rare"))).alias("p_min"))


def calibration_sweep(tested: DataFrame, day: DataFrame, thresholds=None, p: Params = DEFAULT) -> DataFrame:
    """Flagged blocks per threshold in one aggregate, with the false-alarm budget of the (cell, category)
    pairs of ``day`` (events or cube rows)."""
    thresholds = p.rare_thresholds if thresholds is None else thresholds
    hit = lambda th: F.count(F.when(F.col("volume") | (F.col("p_min") < th), 1))
    counts = blocks(tested).agg(*[hit(th).alias(f"t{i}") for i, th in enumerate(thresholds)])
    pairs = day.agg(F.count_distinct("h3_cell", "category").alias("pairs"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(float(th)).alias("threshold"),
                                        F.col(f"t{i}").alias("blocks")) for i, th in enumerate(thresholds)]))
    d = with_scalars(counts.select(rows.alias("x")).select("x.*"), pairs)
    trials = F.greatest(F.lit(1), F.col("pairs") * 24)
    q = p.p_volume
    return (d.withColumn("trials", trials)
            .withColumn("budget", F.col("trials") * q + 2 * F.sqrt(F.greatest(F.lit(1e-9), F.col("trials") * q * (1 - q))))
            .withColumn("rate", F.col("blocks") / F.col("trials")))


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """The loosest threshold within budget, else the strictest."""
    fits = F.col("blocks") <= F.col("budget")
    key = F.when(fits, F.col("rank")).otherwise(1000 - F.col("rank"))
    return sweep.agg(F.min_by(F.struct("threshold", "rate", "budget", "blocks"), key).alias("c")).select("c.*")


def day_tested(history: cb.Slices, day: int, cats: DataFrame, p: Params = DEFAULT, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cube rows of a day, its windows tested against the days before it): slices of the history's cube,
    which ends at ``end``."""
    train, held = history.span(None, day), history.span(day, day + 86400 if end is None else min(day + 86400, end))
    n = bl.days_between(cb.bounds(train)[0], day)
    base = stage(bl.learn_hours(cb.hourly(train, p), n), "day-baseline")
    return held, test_windows(cb.windows(held, p, history.sources), base, n, cats, p)


def calibrate(history: cb.Slices, cats: DataFrame, p: Params = DEFAULT, end: int | None = None):
    """Fit the rare threshold on the second-last day of a history; None with too few days."""
    day = bl.held_out_pane(history.span(None, end), 2)
    if day is None:
        return None
    held, tested = day_tested(history, day, cats, p, end)
    return choose_threshold(calibration_sweep(tested, held, p=p)).first()["threshold"]


def false_alarm(history: cb.Slices, cats: DataFrame, p_rare: float, p: Params = DEFAULT, end: int | None = None) -> DataFrame:
    """Held-out last day: flagged blocks against trials x p, as a z score."""
    held, tested = day_tested(history, bl.held_out_pane(history.span(None, end), 1), cats, p, end)
    b = blocks(tested).agg(F.count(F.when(F.col("volume") | (F.col("p_min") < p_rare), 1)).alias("blocks"))
    q = p.p_volume
    d = one_row(b, cb.pairs(held)).withColumn("trials", F.greatest(F.lit(1), F.col("pairs") * 24))
    mu = F.col("trials") * q
    sigma = F.sqrt(F.greatest(F.lit(1e-9), mu * (1 - q)))
    return d.select("events", "pairs", "trials", "blocks", (F.col("blocks") / F.col("trials")).alias("rate"),
                    mu.alias("expected"), sigma.alias("sigma"), ((F.col("blocks") - mu) / sigma).alias("z"),
                    ((F.col("blocks") - mu) / sigma <= 3).alias("within_3_sigma"))
