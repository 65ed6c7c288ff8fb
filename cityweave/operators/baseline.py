"""Historical rates and the test of a window against them."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import times
from ..params import DEFAULT, Params
from .scale import with_scalars


def detection_start(events: DataFrame, p: Params = DEFAULT) -> dt.datetime:
    """Newest start minus the look-back: one number, so the split below becomes a literal
    range filter that reaches the scan."""
    top = events.agg(F.max(times.epoch(F.col("start_utc")))).first()[0]
    if top is None:
        raise ValueError("no events")
    return int(top - p.lookback_hours * 3600)


def split(events: DataFrame, start_epoch: int):
    """(history, detection) around an instant; the instant itself belongs to detection."""
    cut = F.timestamp_seconds(F.lit(start_epoch))
    return events.filter(F.col("start_utc") < cut), events.filter(F.col("start_utc") >= cut)


def days_between(first: int | None, end: int) -> float:
    return 0.0 if first is None else max(1e-6, (end - first) / 86400)


def history_days(history: DataFrame, start_epoch: int) -> float:
    return days_between(history.agg(F.min(times.epoch(F.col("start_utc")))).first()[0], start_epoch)


def learn(history: DataFrame, n_days: float, p: Params = DEFAULT) -> DataFrame:
    """Counts and rates at four grains, of events."""
    hourly = (history.withColumn("hour", times.local_hour(F.col("start_utc"), p.tz).cast("bigint"))
              .groupBy("h3_cell", "category", "hour").agg(F.count("*").alias("n")))
    return learn_hours(hourly, n_days)


def learn_hours(hourly: DataFrame, n_days: float) -> DataFrame:
    """Counts and rates at four grains in one GROUPING SETS pass over hourly counts (h3_cell, category,
    hour, n): cell+category+hour, cell+category, category+hour, category."""
    cells = hourly.agg(F.greatest(F.lit(1), F.count_distinct("h3_cell")).alias("active_cells"))
    g = hourly.groupingSets(
        [["h3_cell", "category", "hour"], ["h3_cell", "category"], ["category", "hour"], ["category"]],
        "h3_cell", "category", "hour").agg(
        F.sum("n").alias("support"), F.grouping("h3_cell").alias("_c"), F.grouping("hour").alias("_h"))
    days = F.lit(float(n_days))
    city = F.col("_c") == 1
    all_day = F.col("_h") == 1
    g = with_scalars(g, cells)
    rate = F.col("support") / (days * F.when(all_day, 24.0).otherwise(1.0)
                               * F.when(city, F.col("active_cells")).otherwise(1))
    grain = (F.when(~city & ~all_day, "cell_category_hour").when(~city, "cell_category")
             .when(~all_day, "category_hour").otherwise("category"))
    return g.select(grain.alias("grain"), "h3_cell", "category", "hour", "support", rate.alias("rate"), "active_cells")


def expected_rate(windows: DataFrame, baseline: DataFrame, n_days: float, p: Params = DEFAULT) -> DataFrame:
    """Add ``lam`` (events per hour) and ``level`` to rows with h3_cell, category and hour:
    the bucket's own count shrunk toward the city-wide rate of the hour, then of the category."""
    cell = baseline.filter("grain = 'cell_category_hour'").select("h3_cell", "category", "hour", F.col("support").alias("_n"))
    hourly = baseline.filter("grain = 'category_hour'").select("category", "hour", F.col("rate").alias("_rh"))
    daily = baseline.filter("grain = 'category'").select("category", F.col("rate").alias("_rc"))
    d = (windows.join(cell, ["h3_cell", "category", "hour"], "left")
         .join(hourly, ["category", "hour"], "left").join(daily, "category", "left"))
    days = max(1e-9, n_days)
    prior = F.coalesce(F.when(F.col("_rh") > 0, F.col("_rh")), F.when(F.col("_rc") > 0, F.col("_rc")), F.lit(p.min_lambda))
    n = F.coalesce("_n", F.lit(0))
    lam = F.greatest((n + p.prior_days * prior) / (days + p.prior_days), F.lit(p.min_lambda))
    level = F.when(n >= p.min_support, "cell_category_hour").otherwise("shrunk_to_prior")
    return d.withColumn("lam", lam).withColumn("level", level).drop("_n", "_rh", "_rc")


def all_hours_rate(pairs: DataFrame, baseline: DataFrame, n_days: float, p: Params = DEFAULT) -> DataFrame:
    """Add ``lam_all``: the same shrinkage over all hours of a (cell, category)."""
    own = baseline.filter("grain = 'cell_category'").select("h3_cell", "category", F.col("support").alias("_n"))
    city = baseline.filter("grain = 'category'").select("category", F.col("rate").alias("_rc"))
    d = pairs.join(own, ["h3_cell", "category"], "left").join(city, "category", "left")
    hours, alpha = max(1e-9, n_days * 24.0), p.prior_days * 24.0
    prior = F.coalesce(F.when(F.col("_rc") > 0, F.col("_rc")), F.lit(p.min_lambda))
    lam = F.greatest((F.coalesce("_n", F.lit(0)) + alpha * prior) / (hours + alpha), F.lit(p.min_lambda))
    return d.withColumn("lam_all", lam).drop("_n", "_rc")


def held_out_day(history: DataFrame, back: int = 2):
    """Epoch of the ``back``-th last day with history, or None when there are under three days.
    Only the last three distinct days reach the driver."""
    days = [r[0] for r in history.select(F.unix_timestamp(F.date_trunc("day", "start_utc")).alias("d"))
            .distinct().orderBy(F.desc("d")).limit(3).collect()]
    return days[back - 1] if len(days) >= 3 else None


def held_out_pane(history: DataFrame, back: int = 2):
    """``held_out_day`` of a history's cube."""
    return held_out_day(history.select(F.timestamp_seconds("pane").alias("start_utc")), back)


def day_slice(history: DataFrame, day_epoch: int):
    """(training rows before the day, rows of the day)."""
    a, b = F.timestamp_seconds(F.lit(day_epoch)), F.timestamp_seconds(F.lit(day_epoch + 86400))
    s = F.col("start_utc")
    return history.filter(s < a), history.filter((s >= a) & (s < b))


RARE_THRESHOLDS = v.RARE_THRESHOLDS
