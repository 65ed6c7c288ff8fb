"""The composite jobs: ingest, detect, link, as_of, score."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import ids, times
from ..functions.hexgrid import HexGrid, in_bbox
from ..operators import baseline as bl
from ..operators import cube as cb
from ..operators import detect as dt
from ..operators import ingest as ig
from ..operators import link as lk
from ..operators import quality
from ..operators import score as sc
from ..operators import serve as srv
from ..operators import situations as st
from ..operators import timeline as tl
from ..operators import places
from ..operators.scale import broadcast_if_small, delete_staged, hot_keys, release, stage
from ..params import DEFAULT, Params


@dataclass
class Ingested:
    events: DataFrame
    ledger: DataFrame
    health: DataFrame
    arrivals: DataFrame


def _unit_events(feed: DataFrame, unit: str, units: DataFrame, candidates, p: Params, name: str) -> list[DataFrame]:
    """A feed's events as staged parts. A unit's rows meet in one task, in one shuffle of the feed's own columns, and all
    that follows is done there; the rows of hot units go by chunks, apart from the others. A feed's shuffle files
    go before the next feed's are written. ``candidates(rows, whole)``: from rows of the feed."""
    same = lambda hot: feed[unit].eqNullSafe(hot["entity"])
    hot = hot_keys(units, ["entity"], F.col("n"))
    rows = [(feed, True)]
    if hot is not None:
        hot = broadcast_if_small(stage(hot, f"{name}-hot"))
        rows = [(feed.join(hot, same(hot), "left_anti"), True), (feed.join(hot, same(hot), "left_semi"), False)]
    parts = []
    for some, whole in rows:
        built = ig.build_events(candidates(some, whole), p.namespace, ("entity",))
        parts.append(stage(ig.fold_parts(built, within=("entity",)).withColumn("one_unit", ig.one_unit(F.col("raw_ref"))).drop("entity"), f"{name}-events"))
        release(feed.sparkSession)
    return parts


def ingest(spark: SparkSession, weather: DataFrame, complaints: DataFrame, power: DataFrame, drains: DataFrame,
           air: DataFrame, feeders: DataFrame, channels: DataFrame, now=None, p: Params = DEFAULT, widths: dict = None) -> Ingested:
    """Five raw feeds (each with ``seq``) and two registries to canonical events, a drop ledger
    and feed health as of ``now`` (default: the newest arrival).

    Each feed is read twice: once to count its units, once for its events, in one shuffle of its own columns. What
    is kept is a row a unit and the events, without what can be told from their other columns; a feed's shuffle
    files go before the next feed's are written. ``widths`` gives the span of ``seq`` that one task sorts for
    feeds whose ``seq`` isn't a row number."""
    grid = HexGrid(p.hex_edge_m, *p.centre)
    of = lambda feed: p.but(chunk_rows=(widths or {}).get(feed, p.chunk_rows))
    temporary: list[str] = []
    keep = lambda df, name: stage(df, name, temporary)
    located, fault = F.col("located"), F.coalesce("fault", F.lit(False))
    wx = weather.select("station_id", times.from_epoch(F.col("ts")).alias("t"), in_bbox(F.col("lat"), F.col("lon"), p.bbox).alias("located"), F.lit(False).alias("fault"))
    levels = ig.drain_levels(drains).withColumn("fault", ig.level_fault(F.col("level")))
    places_of = lambda units, registry: places.registry_lookup(units, registry.select("id", "lat", "lon"), "entity", grid, []).withColumnRenamed("resolved", "located")
    w = keep(ig.unit_counts(wx, "station_id", ["located", "fault"]), "weather-units")
    a = keep(ig.unit_counts(ig.air_readings(air, p, grid), "entity", ["located", "fault"]), "air-units")
    d = keep(ig.unit_counts(levels, "rtu", ["fault"]), "drain-units")
    f = keep(ig.unit_counts(ig.power_reports(power), "feeder_id", []), "feeder-units")
    register = keep(ig.complaint_records(complaints, p, grid).select("complaint_id", "status", "category", "seq", "t", "lat", "lon", "h3_cell", "drop_reason"), "register")
    release(spark)

    def sensors(readings, feed, drop_unlocated=False):
        return lambda rows, whole: ig.island_episodes(ig.mark_islands(readings(rows, whole), of(feed), drop_unlocated, whole))

    gathered = lambda rows, unit, whole: rows.repartition(unit) if whole else rows
    parts = _unit_events(drains, "rtu", d, sensors(lambda x, whole: ig.drain_readings(x, channels, p, grid, whole), "drain_scada", True), p, "drains")
    parts += _unit_events(weather, "station_id", w, sensors(lambda x, whole: ig.weather_measures(gathered(x, "station_id", whole), p, grid), "weather_imd", True), p, "weather")
    parts += _unit_events(power, "feeder_id", f, lambda x, whole: ig.outage_candidates(ig.pair_outages(ig.power_records(x, feeders, grid, whole), of("power_discom"), whole)), p, "power")
    parts += _unit_events(air, "sensor", a, sensors(lambda x, whole: ig.air_readings(gathered(x, "sensor", whole), p, grid), "air_sensors"), p, "air")
    built = ig.build_events(ig.complaint_candidates(register), p.namespace)
    parts.append(stage(ig.fold_parts(built).withColumn("one_unit", F.lit(True)), "register-events"))
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    shared = union.filter(~F.col("one_unit"))
    if not shared.isEmpty():
        union = union.filter("one_unit").unionByName(stage(ig.join_parts(shared.drop("one_unit")), "shared-events").withColumn("one_unit", F.lit(True)))
    folded = ig.folded(union, ids.event_id(F.col("raw_ref"), F.col("category"), p.namespace))
    events = ig.cluster_complaints(folded, of("civic_complaints")).drop("seq", "n_candidates")

    # units give newest arrival, totals and drops
    reason = F.when(~located, "unresolved").when(fault, "faulty")
    feed = lambda units, name: units.withColumn("source", F.lit(name))
    stats = ig.feed_stats(feed(w, "weather_imd"), reason, F.col("n"))
    stats = stats.unionByName(ig.feed_stats(feed(a, "air_sensors"), reason, F.col("n")))
    stats = stats.unionByName(ig.feed_stats(feed(places_of(d, channels), "drain_scada"), reason, F.col("n")))
    stats = stats.unionByName(ig.feed_stats(feed(places_of(f, feeders), "power_discom"), F.when(~located, "unresolved"), F.col("n")))
    stats = stats.unionByName(ig.feed_stats(feed(register, "civic_complaints"), F.col("drop_reason")))
    stats = stage(stats, "feed-stats")
    delete_staged(spark, temporary)
    release(spark)
    # complaints of unknown type do not count as a sign of life
    arrivals = stats.groupBy("feed").agg(F.max(F.when(~F.col("drop_reason").eqNullSafe("unmapped_type"), F.col("last"))).alias("last"),
                                         F.sum("n").alias("records"))
    drops = stats.filter("drop_reason is not null").select("feed", "drop_reason", "n")
    if now is None:
        now = F.lit(arrivals.agg(F.max("last")).first()[0])
    health = ig.feed_health(arrivals, dims.feeds(spark), now, p=p)
    return Ingested(events, drops, health, arrivals)


@dataclass
class Detected:
    anomalies: DataFrame
    members: DataFrame
    history: DataFrame
    detection: DataFrame
    baseline: DataFrame
    tested: DataFrame
    start: int
    n_days: float
    p_rare: float
    cube: cb.Slices = None


def detect(events: DataFrame, degraded_feeds=(), p: Params = DEFAULT, calibrate: bool = True, cube: DataFrame = None) -> Detected:
    """Canonical events to anomalies and their member bridge. Events are read once into a cube of steps
    (``cube``: one that is stored); history, baseline, calibration and windows are slices of it."""
    spark = events.sparkSession
    cats = dims.categories(spark)
    cube = stage(cb.steps(events, p), "cube") if cube is None else cube
    first, last = cb.bounds(cube)
    if last is None:
        raise ValueError("no events")
    start = int(last - p.lookback_hours * 3600)
    history, detection = bl.split(events, start)
    whole = cb.Slices(cube, events, p)
    n_days = bl.days_between(first if first < start else None, start)
    base = stage(bl.learn_hours(cb.hourly(whole.span(None, start), p), n_days), "baseline")
    p_rare = (dt.calibrate(whole, cats, p, start) if calibrate else None)
    p_rare = p.p_rare if p_rare is None else p_rare
    tested = stage(dt.test_windows(cb.windows(whole.span(start, None), p, whole.sources), base, n_days, cats, p), "tested")
    anomalies = stage(dt.flag(tested, p_rare, degraded_feeds, p), "anomalies")
    return Detected(anomalies, dt.anomaly_members(anomalies, detection, p), history, detection, base, tested, start, n_days, p_rare, whole)


@dataclass
class Linked:
    episodes: DataFrame
    episode_members: DataFrame
    seconds: DataFrame
    lift: DataFrame
    links: DataFrame
    components: DataFrame
    anchors: DataFrame
    pruned: DataFrame
    resolved: DataFrame
    eligible: DataFrame
    sit_ids: DataFrame
    keyed: DataFrame
    members: DataFrame
    chain: DataFrame
    situations: DataFrame
    rejected: DataFrame


def link(anomalies: DataFrame, history: DataFrame, detection: DataFrame, degraded: DataFrame = None,
         edges: DataFrame = None, p: Params = DEFAULT) -> Linked:
    """Anomalies and events to situations and rejected candidates. Tables that several later steps
    read are staged once in the shared folder."""
    spark = anomalies.sparkSession
    grid = HexGrid(p.hex_edge_m, *p.centre)
    edges = dims.plausible_pairs(spark) if edges is None else edges
    cats, phrases = dims.categories(spark), dims.phrases(spark)
    if degraded is None:
        degraded = spark.createDataFrame([], "feed string, age_sec bigint")
    numbered = lk.number_episodes(anomalies)
    em = stage(lk.episode_members(numbered, detection, p), "episode-members")
    episodes = stage(lk.build_episodes(numbered, em), "episodes")
    seconds = stage(lk.episode_seconds(em), "seconds")
    lift = stage(lk.lift_table(history, edges, p), "lift")
    links = stage(lk.candidate_links(episodes, seconds, edges, lift, p), "links")
    comps = lk.connected_components(episodes, links)
    anchor = lk.anchors(episodes, links)
    pruned = stage(lk.prune_evidence(em, anchor, p), "pruned")
    resolved = lk.resolved_episodes(pruned)
    eligible = lk.eligible_components(comps, episodes, edges, cats, p)
    sit_ids = stage(st.situation_ids(eligible, comps, episodes), "situation-ids")
    keyed, members = st.keyed_members(pruned, comps, sit_ids)
    members = stage(members, "members")
    chain = stage(st.chain(resolved, keyed, phrases), "chain")
    sits = stage(st.assemble(sit_ids, members, chain, keyed, links, edges, lift, phrases, degraded, grid, p), "situations")
    rej = stage(lk.rejected(episodes, comps, seconds, edges, p), "rejected")
    return Linked(episodes, em, seconds, lift, links, comps, anchor, pruned, resolved, eligible, sit_ids, keyed, members, chain, sits, rej)


@dataclass
class AsOf:
    """Everything the as-of queries read, prepared once; ``t`` stays an argument."""
    events: DataFrame
    anomalies: DataFrame
    situations: DataFrame
    rejected: DataFrame
    milestones: DataFrame
    reveals: DataFrame
    edges: DataFrame
    p: Params = field(default_factory=Params)
    problems: DataFrame = None

    def snapshot(self, t, stopped: DataFrame = None, delays: DataFrame = None) -> dict:
        """City, counts, events, situations, predictions, feed health and rejected links as of t.
        ``stopped`` feeds read as killed and lower the situations with a member of theirs known by t. The
        events of a feed in ``delays`` (feed, delay_sec) are seen that much later, and so are the
        members they confirm and the situations they reveal."""
        events, ms, reveals = self.events, self.milestones, self.reveals
        if delays is not None:
            events, ms = srv.delayed_events(events, t, delays), srv.delayed_milestones(ms, delays)
            reveals = srv.reveal_times(ms, self.situations)
        part = srv.partial_situations(self.situations, ms, reveals, t)
        part_shown, killed = part, ()
        if stopped is not None:
            part_shown = srv.apply_stopped(part, ms.filter(F.col("milestone") <= srv.at(t)), stopped, self.p)
            killed = [r["feed"] for r in stopped.select("feed").distinct().collect()]  # some of the known feeds
        spark = self.events.sparkSession
        tables = {
            "city": srv.city_rollup(part_shown), "cells": srv.cell_rollup(part_shown),
            "counts": srv.counts(events, part, t, self.p), "events": srv.active_events(events, t, self.p),
            "situations": part_shown, "predictions": srv.partial_predictions(part, self.edges),
            "feed_health": ig.feed_health(ig.event_arrivals(srv.revealed_events(events, t)), dims.feeds(spark), srv.at(t), killed=killed, p=self.p),
            "rejected_candidates": srv.rejected_as_of(self.rejected, t),
            "anomalies": srv.anomalies_as_of(self.anomalies, t),
        }
        if self.problems is not None:
            tables["data_warning"] = quality.data_warning(self.problems)
        return {name: ids.with_public(table) for name, table in tables.items()}


    def timeline(self, t0: int, n: int, tick_sec: int = 1) -> DataFrame:
        """What the clock says at each of n ticks from t0 on (``timeline.tick_timeline``)."""
        return tl.tick_timeline(self.events, self.situations, self.milestones, self.reveals, t0, n, tick_sec, self.p)


def as_of(events: DataFrame, d: Detected, l: Linked, p: Params = DEFAULT, problems: DataFrame = None) -> AsOf:
    """``problems``: what ``readers.data_version`` found, shown with every snapshot."""
    spark = events.sparkSession
    facts = events.select("event_id", "start_utc")
    m = l.members.select("situation_id", "event_id", "category", "severity", "confidence", "source").join(facts, "event_id")
    ms = stage(srv.milestones(m, srv.event_window_end(d.members, d.anomalies)), "milestones")
    reveals = stage(srv.reveal_times(ms, l.situations), "reveals")
    return AsOf(events, d.anomalies, l.situations, l.rejected, ms, reveals, dims.plausible_pairs(spark), p, problems)


def score(situations: DataFrame, members: DataFrame, truths: DataFrame, truth_members: DataFrame,
          decoy_members: DataFrame, p: Params = DEFAULT, min_overlap: float = 0.5) -> dict:
    """Scorecard and its per-situation and per-decoy tables."""
    m = sc.match(truths, truth_members, situations, members, min_overlap)
    per = stage(sc.per_truth(m, truths, situations, p), "per-truth")
    fps = sc.false_positives(per, situations, members, decoy_members)
    dec = sc.decoy_status(decoy_members, members)
    tables = {"scorecard": sc.scorecard(per, fps, dec), "per_truth": per, "false_positives": fps, "decoys": dec}
    return {name: ids.with_public(table) for name, table in tables.items()}
