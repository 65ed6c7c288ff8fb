"""Five feeds to one canonical event table.

Sensor series become episodes by counting breaks: with a running count of breaks before each
row, an episode is one (entity, category, count) group holding its readings and the one break
that closes it. So the fold is an ordinary partial aggregate, and only the running count needs
an order (hot keys' taken by chunks, see ``scale.running_before_hot``)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import ids, severity as sv, text as tx, times
from ..functions.hexgrid import HexGrid, in_bbox
from ..params import DEFAULT, Params
from . import places
from .scale import one_row, running_before_hot
from ..functions.numbers import round_exact

GRID = HexGrid()


# ------------------------------------------------------------------ readings per feed ----
def weather_measures(feed: DataFrame, p: Params = DEFAULT, grid: HexGrid = GRID) -> DataFrame:
    """One row per station reading and measure; readings outside the city are flagged."""
    measures = {"weather.rain": F.coalesce("rain_mm_15min", F.lit(0.0)),
                "weather.heat": sv.heat_index(F.col("temp_c"), F.col("rh_pct").cast("double"))}
    d = feed.select(  # exploded, not unpivoted: rows that a shuffle has brought together stay so
        F.lit("weather_imd").alias("source"), F.col("station_id").alias("entity"), "seq",
        times.from_epoch(F.col("ts")).alias("t"), "lat", "lon",
        in_bbox(F.col("lat"), F.col("lon"), p.bbox).alias("located"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("category"), x.cast("double").alias("measure")) for k, x in measures.items()])).alias("m"))
    return d.select(
        "source", "entity", "m.category", "seq", "t", "lat", "lon", grid.cell(F.col("lat"), F.col("lon")).alias("h3_cell"),
        "m.measure", F.lit(False).alias("fault"), F.col("located"),
        ids.ref_at_epoch("weather_imd", F.col("entity"), F.col("t")).alias("raw_ref"),
        sv.confidence(F.lit(v.CONF_CALIBRATED), F.lit(v.MULT_DIRECT)).alias("confidence"),
        F.lit("direct").alias("resolution"))


def air_readings(feed: DataFrame, p: Params = DEFAULT, grid: HexGrid = GRID) -> DataFrame:
    lat, lon = F.col("loc.latitude"), F.col("loc.longitude")
    low = F.when(F.coalesce(F.col("battery_pct"), F.lit(100)) < v.LOW_BATTERY_PCT,
                 v.MULT_LOW_BATTERY).otherwise(1.0)
    base = F.when(F.coalesce(F.col("calibrated"), F.lit(False)), v.CONF_CALIBRATED).otherwise(v.CONF_UNCALIBRATED)
    return feed.select(
        F.lit("air_sensors").alias("source"), F.col("sensor").alias("entity"),
        F.lit("air.pm25").alias("category"), "seq", times.from_iso_z(F.col("captured")).alias("t"),
        lat.alias("lat"), lon.alias("lon"), grid.cell(lat, lon).alias("h3_cell"),
        F.col("pm25").alias("measure"),
        (F.col("pm25").isNull() | (F.col("pm25") == v.PM_FAULT)).alias("fault"),
        in_bbox(lat, lon, p.bbox).alias("located"),
        ids.ref_verbatim("air_sensors", F.col("sensor"), F.col("captured")).alias("raw_ref"),
        sv.confidence(base, F.lit(v.MULT_DIRECT), low).alias("confidence"), F.lit("direct").alias("resolution"))


def drain_levels(feed: DataFrame) -> DataFrame:
    """What of a drain's reading needs no registry, as narrow rows."""
    level, volts = tx.channel(F.col("ch"), "LVL_CM"), tx.channel(F.col("ch"), "BATT_V")
    return feed.select("rtu", "seq", times.from_scada(F.col("polled")).alias("t"), level.alias("level"), (volts < v.LOW_BATTERY_VOLTS).alias("low"))


def level_fault(level) -> Column:
    return level.isNull() | (level == v.LEVEL_FAULT)


def drain_readings(feed: DataFrame, registry: DataFrame, p: Params = DEFAULT, grid: HexGrid = GRID, gather: bool = False) -> DataFrame:
    """Level as percent of channel capacity. Rows of unknown units stay, unresolved. ``gather``: a unit's
    rows meet in one task, still narrow."""
    d = drain_levels(feed)
    d = places.registry_lookup(d.repartition("rtu") if gather else d, registry, "rtu", grid, ["capacity_cm"])
    low = F.when(F.col("low"), v.MULT_LOW_BATTERY).otherwise(1.0)
    fault = level_fault(F.col("level"))
    return d.select(
        F.lit("drain_scada").alias("source"), F.col("rtu").alias("entity"),
        F.lit("drain.overflow").alias("category"), "seq", "t", "lat", "lon", "h3_cell",
        F.when(~fault, percent_of_capacity(F.col("level"), F.col("reg_capacity_cm"))).alias("measure"),
        fault.alias("fault"), F.col("resolved").alias("located"),
        ids.ref_at_epoch("drain_scada", F.col("rtu"), F.col("t")).alias("raw_ref"),
        sv.confidence(F.lit(v.CONF_CALIBRATED), F.lit(v.MULT_REGISTRY), low).alias("confidence"),
        F.lit("registry").alias("resolution"))


def percent_of_capacity(level, capacity) -> Column:
    return round_exact(level / capacity * 100.0, 1)


# ------------------------------------------------------------------ threshold episodes ----
def mark_islands(readings: DataFrame, p: Params = DEFAULT, drop_unlocated: bool = False, whole: bool = False) -> DataFrame:
    """Add ``above`` and ``island`` (breaks seen before the row). A reading below the floor or
    a fault is a break; a missing reading is no row and breaks nothing. Feeds that skip
    unplaceable readings altogether pass ``drop_unlocated``; ``whole``: no unit is hot."""
    d = readings.filter("located") if drop_unlocated else readings
    above = ~F.col("fault") & F.coalesce(sv.crosses_floor(F.col("category"), F.col("measure")), F.lit(False))
    d = d.withColumn("above", above)
    return running_before_hot(d, ["entity", "category", "source"], ["seq"],  # a sort tells most rows apart by its first column
                              F.floor(F.col("seq") / p.chunk_rows), F.when(F.col("above"), 0).otherwise(1), "island", whole)


def island_candidates(marked: DataFrame) -> DataFrame:
    """One candidate per contributing reading: each reading above the floor, and the break that
    closes an open episode (it carries the peak and the end). All share the opener's reference."""
    keys = ["source", "entity", "category", "island"]
    head = marked.filter("above").groupBy(*keys).agg(
        F.min_by("raw_ref", "seq").alias("open_ref"), F.min_by("t", "seq").alias("open_t"),
        F.max("measure").alias("peak"))
    d = marked.join(head, keys).filter("located")
    return d.select(
        "source", "entity", "category", "seq", F.col("open_ref").alias("raw_ref"), F.col("open_t").alias("start_utc"),
        F.when(~F.col("above"), F.col("t")).alias("end_utc"), "lat", "lon", "h3_cell",
        F.when(F.col("above"), F.col("measure")).otherwise(F.col("peak")).alias("measure"),
        "confidence", "resolution")


def island_episodes(marked: DataFrame) -> DataFrame:
    """The candidates of each island already folded: same rows as folding
    ``island_candidates``, in one partial aggregate and without the join."""
    keys = ["source", "entity", "category", "island"]
    emitted = F.col("located")
    closes = ~F.col("above")
    a = marked.groupBy(*keys).agg(
        F.count(F.when(F.col("above"), 1)).alias("n_above"),
        F.count(F.when(emitted, 1)).alias("n_emitted"),
        F.min_by(F.when(F.col("above"), F.struct("raw_ref", "t")), F.when(F.col("above"), F.col("seq"))).alias("o"),
        F.max(F.when(F.col("above"), F.col("measure"))).alias("peak"),
        F.max(F.when(F.col("above") & emitted, F.col("measure"))).alias("peak_emitted"),
        F.max(F.when(closes & emitted, F.col("t"))).alias("end_utc"),
        F.min(F.when(emitted, F.col("confidence"))).alias("confidence"),
        F.min_by(F.when(emitted, F.struct("lat", "lon", "h3_cell", "resolution")),
                 F.when(emitted, F.col("seq"))).alias("f"),
        F.min(F.when(emitted, F.col("seq"))).alias("seq"))
    return a.filter("n_above > 0 and n_emitted > 0").select(
        "source", "entity", "category", "seq", F.col("o.raw_ref").alias("raw_ref"), F.col("o.t").alias("start_utc"),
        "end_utc", "f.lat", "f.lon", "f.h3_cell",
        F.when(F.col("end_utc").isNotNull(), F.col("peak")).otherwise(F.col("peak_emitted")).alias("measure"),
        "confidence", "f.resolution", F.col("n_emitted").alias("n_candidates"))


# ------------------------------------------------------------------ power -----------------
def power_reports(feed: DataFrame) -> DataFrame:
    """What of a feeder's record needs no registry, as narrow rows."""
    return feed.select("feeder_id", "seq", "event", times.from_local_iso(F.col("reported_time")).alias("t"), "affected_connections", "carries_signals", "signal_junctions")


def power_records(feed: DataFrame, registry: DataFrame, grid: HexGrid = GRID, gather: bool = False) -> DataFrame:
    """Feeder records with place, what each trip emits (``emits``) and whether it opens. ``gather``: a
    feeder's rows meet in one task, still narrow."""
    d = power_reports(feed)
    d = places.registry_lookup(d.repartition("feeder_id") if gather else d, registry, "feeder_id", grid, ["signal_junctions"])
    t = F.col("t")
    connections = F.coalesce(F.col("affected_connections").cast("double"), F.lit(0.0))
    junctions = F.coalesce(F.expr("nullif(signal_junctions, 0)").cast("double"),
                           F.expr("nullif(reg_signal_junctions, 0)").cast("double"), F.lit(1.0))
    restore = F.coalesce(F.col("event") == "RESTORE", F.lit(False))
    out = F.filter(F.array(
        F.when(connections >= sv.floor_of(F.lit("power.outage")),
               F.struct(F.lit("power.outage").alias("category"), connections.alias("measure"))),
        F.when(F.coalesce(F.col("carries_signals"), F.lit(False)),
               F.struct(F.lit("traffic.signal_down").alias("category"), junctions.alias("measure")))),
        lambda x: x.isNotNull())
    d = d.select(
        F.lit("power_discom").alias("source"), F.col("feeder_id").alias("entity"), "seq", "event", "t",
        "lat", "lon", "h3_cell", "resolved", restore.alias("is_restore"),
        F.when(~restore, out).alias("emits"),
        F.when(F.col("event") == "SCHEDULED_CUT", F.lit(v.SCHEDULED_CUT_CAP)).alias("cap"),
        ids.ref_at_epoch("power_discom", F.col("feeder_id"), t).alias("raw_ref"),
        sv.confidence(F.lit(v.CONF_CALIBRATED), F.lit(v.MULT_REGISTRY)).alias("confidence"),
        F.lit("registry").alias("resolution"))
    return d.withColumn("opens", ~F.col("is_restore") & (F.size("emits") > 0))


def pair_outages(records: DataFrame, p: Params = DEFAULT, whole: bool = False) -> DataFrame:
    """Give every resolved record the number of opening trips up to and including it: a group
    is one opening trip and the restores after it, of which the first closes it. ``whole``: no feeder is hot."""
    d = running_before_hot(records.filter("resolved"), ["entity"], ["seq"], F.floor(F.col("seq") / p.chunk_rows),
                           F.when(F.col("opens"), 1).otherwise(0), "opened", whole)
    return d.withColumn("opened", F.col("opened") + F.when(F.col("opens"), 1).otherwise(0))


def outage_spans(paired: DataFrame) -> DataFrame:
    """One row per (feeder, opening): the trip, its first restore and how many were unmatched."""
    restore = F.col("is_restore")
    a = paired.groupBy("entity", "opened").agg(
        F.max(F.when(F.col("opens"), F.struct("seq", "raw_ref", "t", "emits", "cap", "lat", "lon", "h3_cell",
                                              "confidence", "resolution", "source"))).alias("o"),
        F.min_by(F.when(restore, F.col("t")), F.when(restore, F.col("seq"))).alias("end_utc"),
        F.count(F.when(restore, 1)).alias("restores"))
    return a.withColumn("unmatched", F.col("restores") - F.when(
        F.col("o").isNotNull() & (F.col("restores") > 0), 1).otherwise(0))


def outage_candidates(paired: DataFrame) -> DataFrame:
    """Trips fan out to their categories; the closing restore re-emits them with an end."""
    s = outage_spans(paired).filter(F.col("o").isNotNull())
    d = s.select("entity", "end_utc", "o.*").withColumn("e", F.explode("emits"))
    opened = F.lit(None).cast("timestamp")
    d = d.withColumn("end_utc", F.explode(F.when(F.col("end_utc").isNotNull(), F.array(opened, F.col("end_utc"))).otherwise(F.array(opened))))
    return d.select("source", "entity", F.col("e.category").alias("category"), "seq", "raw_ref",
                    F.col("t").alias("start_utc"), "end_utc", "lat", "lon", "h3_cell",
                    F.col("e.measure").alias("measure"), "confidence", "resolution", "cap")


# ------------------------------------------------------------------ complaints -------------
def complaint_records(feed: DataFrame, p: Params = DEFAULT, grid: HexGrid = GRID) -> DataFrame:
    """Category, time and place of each register row and the first reason to drop it."""
    d = feed.withColumn("category", tx.complaint_category(F.col("complaint_type")))
    d = d.withColumn("t", times.from_complaint(F.col("lodged_at")))
    d = d.withColumn("pos", places.locate(F.col("landmark"), F.col("locality")))
    d = d.withColumn("drop_reason", F.coalesce(
        F.when(F.col("category").isNull(), F.lit("unmapped_type")),
        F.when(F.col("t").isNull(), F.lit("bad_timestamp")),
        F.when(F.col("pos").isNull(), F.lit("unresolved"))))
    f = places.landmark_fields(F.col("pos"), grid)
    return d.withColumn("lat", f["lat"]).withColumn("lon", f["lon"]).withColumn("h3_cell", f["h3_cell"])


def complaint_candidates(records: DataFrame) -> DataFrame:
    closed = F.upper(F.trim(F.coalesce("status", F.lit("")))) == "CLOSED"
    d = records.filter(F.col("drop_reason").isNull())
    received = sv.received_at(F.col("t"), F.lit(60))
    return d.select(
        F.lit("civic_complaints").alias("source"), F.col("complaint_id").alias("entity"), "category", "seq",
        ids.ref_record("civic_complaints", F.col("complaint_id")).alias("raw_ref"), F.col("t").alias("start_utc"),
        F.when(closed, received).alias("end_utc"), "lat", "lon", "h3_cell", F.lit(1.0).alias("measure"),
        sv.confidence(F.lit(v.CONF_RESIDENT), F.lit(v.MULT_LANDMARK)).alias("confidence"),
        F.lit("landmark").alias("resolution"))


# ------------------------------------------------------------------ canonical events -------
def build_events(candidates: DataFrame, namespace: str = v.EVENT_NAMESPACE, keep: tuple = ()) -> DataFrame:
    """Canonical columns for candidates; the only place the event shape is made. ``keep``: columns that stay besides."""
    d = candidates
    for name, kind in (("cap", "double"), ("observed", "timestamp")):
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    d = d.withColumn("received_at", sv.received_at(F.col("start_utc"), sv.interval_of(F.col("source")), F.col("observed")))
    return d.select(
        ids.event_id(F.col("raw_ref"), F.col("category"), namespace).alias("event_id"), "source", "category", "h3_cell",
        round_exact(F.col("lat").cast("double"), 5).alias("lat"), round_exact(F.col("lon").cast("double"), 5).alias("lon"),
        "start_utc", "end_utc",
        sv.severity(F.col("category"), F.col("measure"), F.col("cap")).alias("severity"), "confidence",
        "received_at", sv.freshness(F.col("received_at"), F.col("start_utc")).alias("freshness_sec"),
        F.lit(True).alias("is_simulated"), "raw_ref", "resolution",
        round_exact(F.col("measure").cast("double"), 3).alias("measure"), "seq", *keep)


_FOLD, _FIRST = ["raw_ref", "category", "source"], ["h3_cell", "lat", "lon", "is_simulated", "resolution"]


def _folds(events: DataFrame, by: list, measure: Column, first: Column, n: Column) -> DataFrame:
    return events.groupBy(*by).agg(
        F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"), F.max(measure).alias("m"),
        F.min("confidence").alias("confidence"), F.max("received_at").alias("received_at"),
        F.min_by(first, "seq").alias("f"), F.min("seq").alias("seq"), F.sum(n).alias("n_candidates"))


def fold_parts(events: DataFrame, first: list = _FIRST, within: tuple = ()) -> DataFrame:
    """Events folded as far as those of ``within`` go, to be joined by ``join_parts``."""
    return _folds(events, [*_FOLD, *within], F.struct("measure", (-F.col("seq")).alias("at"), "severity"), F.struct(*first), F.lit(1))


def join_parts(parts: DataFrame) -> DataFrame:
    """The parts of an event to one: folding in two steps gives what folding at once does."""
    return _folds(parts, _FOLD, F.col("m"), F.col("f"), F.col("n_candidates")).select(*parts.columns)


def one_unit(raw_ref: Column) -> Column:
    """Whether a reference feed:unit@instant can be read in one way only, so no other unit has it. One that is
    missing, or whose unit or instant has an ``@``, may be shared."""
    return F.coalesce(F.regexp_count(raw_ref, F.lit("@")) == 1, F.lit(False))


def fold(events: DataFrame) -> DataFrame:
    """One event per (source, raw_ref, category): earliest start, peak measure with its severity,
    latest close and sighting, most cautious confidence, the rest from the first candidate.
    The source is part of the key, so two feeds reporting one thing stay two events."""
    return folded(fold_parts(events, ["event_id", *_FIRST]), F.col("f.event_id"))


def folded(parts: DataFrame, event_id: Column) -> DataFrame:
    return parts.select(
        event_id.alias("event_id"), "source", "category", "f.h3_cell", "f.lat", "f.lon", "start_utc", "end_utc", "m.severity",
        "confidence", "received_at", sv.freshness(F.col("received_at"), F.col("start_utc")).alias("freshness_sec"),
        "f.is_simulated", "raw_ref", "f.resolution", "m.measure", "seq", "n_candidates")


def fold_counts(folded: DataFrame) -> DataFrame:
    return folded.groupBy("source").agg(F.sum(F.col("n_candidates") - 1).alias("removed"))


def source_split(events: DataFrame, category: str = "traffic.signal_down") -> DataFrame:
    return events.filter(F.col("category") == category).groupBy("source").agg(F.count("*").alias("n"))


def trailing_counts(events: DataFrame, keys: list, t: str, order: list, seq: str, window_sec: int,
                    chunk_rows: int, out: str) -> DataFrame:
    """Rows of the same key within the trailing window, ties counted in order.

    Earlier seconds come from per-second counts (one row per key and second) over two time
    buckets; the position among equal seconds is a chunked rank. No frame spans a whole key."""
    secs = events.groupBy(*keys, F.col(t).alias("_t")).agg(F.count("*").alias("_n"))
    b = F.floor(F.col("_t") / window_sec)
    two = secs.withColumn("_b", F.explode(F.array(b, b + 1))).withColumn("_own", F.col("_b") == b)
    w = Window.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-window_sec, -1)
    before = (two.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
              .filter("_own").select(*keys, F.col("_t").alias(t), "_before"))
    ranked = running_before_hot(events, [*keys, t], order, F.floor(F.col(seq) / chunk_rows), F.lit(1), "_pos")
    return (ranked.join(before, [*keys, t]).withColumn(out, F.col("_before") + F.col("_pos") + 1)
            .drop("_before", "_pos"))


def cluster_complaints(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rescale complaint severity by how many like complaints the cell had in the window."""
    resident = F.col("category").startswith("complaint.")
    c = events.filter(resident).withColumn("_s", times.epoch(F.col("start_utc")))
    c = trailing_counts(c, ["h3_cell", "category"], "_s", ["seq", "event_id"], "seq", p.cluster_window_sec,
                        p.chunk_rows, "_n")
    c = (c.withColumn("measure", F.col("_n").cast("double"))
         .withColumn("severity", sv.severity(F.col("category"), F.col("measure"))))
    return events.filter(~resident).unionByName(c.select(*events.columns))


# ------------------------------------------------------------------ ledgers and health -----
def sensor_ledger(marked: DataFrame, all_readings: DataFrame) -> DataFrame:
    """Per feed: records, faulty, unresolved, episodes and candidates."""
    cands = island_episodes(marked).groupBy("source").agg(
        F.count("*").alias("episodes"), F.sum("n_candidates").alias("candidates"))
    base = all_readings.groupBy("source").agg(
        F.count_distinct("entity").alias("entities"), F.count("*").alias("readings"),
        F.count(F.when(F.col("fault"), 1)).alias("dropped_faulty"),
        F.count(F.when(~F.col("located"), 1)).alias("dropped_unresolved"))
    return base.join(cands, "source", "left").na.fill(0, ["episodes", "candidates"])


def power_ledger(records: DataFrame, paired: DataFrame) -> DataFrame:
    trip = ~F.col("is_restore")
    a = records.agg(
        F.count("*").alias("records"), F.count(F.when(~F.col("resolved"), 1)).alias("dropped_unresolved"),
        F.count(F.when(F.col("resolved") & trip, 1)).alias("trips"),
        F.count(F.when(F.col("resolved") & F.col("is_restore"), 1)).alias("restores"),
        F.sum(F.when(F.col("resolved") & trip, F.size("emits")).otherwise(0)).alias("trip_candidates"),
        F.count(F.when(F.col("resolved") & trip & ~F.exists("emits", lambda e: e["category"] == "power.outage"), 1)).alias("below_floor"),
        F.count(F.when(F.col("resolved") & trip & F.exists("emits", lambda e: e["category"] == "traffic.signal_down"), 1)).alias("signal_down_emitted"))
    b = outage_spans(paired).agg(F.sum("unmatched").alias("restores_unmatched"))
    return one_row(a, b)


def complaint_ledger(records: DataFrame) -> DataFrame:
    kept = F.col("drop_reason").isNull()
    pii = tx.count_pii(F.col("text"))
    d = records.withColumn("_pii", F.when(kept, pii).otherwise(F.lit(0)))
    reason = lambda r: F.count(F.when(F.col("drop_reason") == r, 1))
    return d.agg(
        F.count("*").alias("records"), F.count(F.when(kept, 1)).alias("candidates"),
        reason("unmapped_type").alias("dropped_unmapped_type"), reason("bad_timestamp").alias("dropped_bad_timestamp"),
        reason("unresolved").alias("dropped_unresolved"), F.sum("_pii").alias("pii_items_seen"),
        F.count(F.when(F.col("_pii") > 0, 1)).alias("records_with_pii"),
        F.count(F.when(kept & (F.upper(F.trim(F.coalesce("status", F.lit("")))) == "CLOSED"), 1)).alias("closed_rows"))


def unhealthy_entities(readings: DataFrame) -> DataFrame:
    return readings.filter(F.col("fault") & F.col("located")).select("source", "entity").distinct()


def unit_counts(readings: DataFrame, unit: str, by: list) -> DataFrame:
    """(entity, by, n, t): readings and the newest time of each unit, in one narrow pass over a feed."""
    return readings.groupBy(F.col(unit).alias("entity"), *by).agg(F.count("*").alias("n"), F.max("t").alias("t"))


def feed_stats(rows: DataFrame, reason: Column, n: Column | None = None) -> DataFrame:
    """(feed, drop_reason, n, last): counts and newest arrival per drop reason over every raw row of
    a feed (``source``, ``t``), dropped ones included. ``n``: the raw rows that a row stands for."""
    seen = sv.received_at(F.col("t"), sv.interval_of(F.col("source")))
    return rows.groupBy(F.col("source").alias("feed"), reason.alias("drop_reason")).agg((F.count("*") if n is None else F.sum(n)).alias("n"), F.max(seen).alias("last"))


def feed_health(arrivals: DataFrame, feeds: DataFrame, now: Column, killed=(), errors=None,
                drops: DataFrame = None, p: Params = DEFAULT) -> DataFrame:
    """State per feed: error, then stopped, then never seen, then older than N intervals, else live."""
    d = feeds.join(arrivals, "feed", "left").withColumn("now", now)
    d = d.join(drops, "feed", "left") if drops is not None else d.withColumn("records_dropped", F.lit(0).cast("bigint"))
    errors = errors or {}
    err = sv._lookup(F.col("feed"), errors) if errors else F.lit(None).cast("string")
    age = times.epoch(F.col("now")) - times.epoch(F.col("last"))
    old = age > p.stale_intervals * F.col("interval_sec")
    dead = F.col("feed").isin(*killed) if killed else F.lit(False)
    return d.select(
        "feed",
        F.when(err.isNotNull(), "error").when(dead, "killed").when(F.col("last").isNull(), "stale")
        .when(old, "stale").otherwise("live").alias("state"),
        F.col("last").alias("last_record_utc"), age.alias("age_sec"), "interval_sec",
        F.coalesce("records", F.lit(0)).alias("records_total"),
        F.coalesce("records_dropped", F.lit(0)).alias("records_dropped"),
        F.when(err.isNotNull(), err).when(dead, "Stopped by operator").when(F.col("last").isNull(), "No records seen")
        .when(old, F.concat(F.lit("No update for "), F.greatest(F.lit(1), F.floor(age / 60)).cast("string"), F.lit(" min")))
        .alias("message"))


def event_arrivals(events: DataFrame) -> DataFrame:
    """The weaker signal: last sighting per feed from events alone."""
    return events.groupBy(F.col("source").alias("feed")).agg(
        F.max("received_at").alias("last"), F.count("*").alias("records"))


def degraded(health: DataFrame) -> DataFrame:
    return health.filter(F.col("state").isin("stale", "error")).select("feed", "age_sec")
