"""Streaming operators drained over the tables read as streams."""
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from cityweave.functions import severity as sv
from cityweave.operators import ingest as ig
from cityweave.operators.scale import delete_staged, stage, stage_root
from cityweave.streaming import live, upserts

from .base import CANON, EV, GRID, INTERVAL, P, ROWS, duck, iso, memo, portable, query, r6, ts
from .columns import R, REG_SQL, WEATHER, power_feed
from .feeds import CATS, DREG_SQL, INGEST, OUT, PD, PS, _CSEL, _PC, _WS, air, cand_out, complaint_feed, drains, island_sql
from .feeds import rows as event_rows
from .situations import ANOM, DET, MILS, _anom, anom_out, asof, detected

C = F.col


SLICES, SLICE_ROWS = 4, 25_000  # at least so many ticks of a clock, of about so many rows at most
MOST, FILE_ROWS = 8, 500_000  # micro-batches at most, and about so many rows a file at most
TASK_ROWS = 20_000  # a slice of more rows has a file for every core, so that its micro-batch is read side by side


def tick_of(order, lo, hi, ticks):
    """Which of ``ticks`` equal spans from lo to hi a row is in."""
    return F.least(F.floor((C(order) - lo).cast("double") * ticks / F.lit(float(hi - lo + 1))), F.lit(ticks - 1))


def slices_of(s, d, name, rows, order):
    """(path, schema, files a slice, (lo, hi, ticks)): the rows in slices of whole ticks, one after the other. Every
    slice has the same number of files, which grows with the rows; the slices don't become more. The table is read
    once for the bounds and once to part its rows by slice, which is the one shuffle: each of as many tasks as a slice
    has files writes a file of every slice, and a slice's files are then copied in turn, a task a file."""
    def build():
        path, parted = f"{stage_root(s)}/slices-{name}-{uuid.uuid4().hex}", f"{stage_root(s)}/parted-{name}-{uuid.uuid4().hex}"
        x = rows()
        lo, hi, n = x.agg(F.min(order), F.max(order), F.count("*")).first()
        ticks = max(SLICES, -(-n // SLICE_ROWS))
        slices = min(ticks, MOST)
        of = lambda per: max(1, -(-n // (slices * per)))
        files = max(of(FILE_ROWS), min(of(TASK_ROWS), s.sparkContext.defaultParallelism))
        at = F.floor(tick_of(order, lo, hi, ticks) * slices / ticks)
        # dealt by number, not by value, so that every part has rows from all over the table and is a file of each slice
        dealt = x.withColumn("_slice", at.cast("int")).withColumn("_deal", F.monotonically_increasing_id())
        dealt.repartition(files, "_deal").drop("_deal").write.partitionBy("_slice").parquet(parted)
        parts = s.read.schema(dealt.drop("_deal").schema).parquet(parted)
        for k in range(slices):
            part = parts.filter(C("_slice") == k).drop("_slice")
            part = part.coalesce(files) if part.rdd.getNumPartitions() >= files else part.repartition(files)
            part.write.mode("append").parquet(path)
            there = len(s.read.schema(x.schema).parquet(path).inputFiles()) if files > 1 else k + 1
            for _ in range((k + 1) * files - there):  # a part without rows gives no file
                s.createDataFrame([], x.schema).coalesce(1).write.mode("append").parquet(path)
        delete_staged(s, [parted])
        return path, x.schema, files, (lo, hi, ticks)

    return memo(s, d, f"slices-{name}", build)


def sliced(s, d, name, rows, order):
    """The rows as a stream of several micro-batches: slices of equal span of ``order``, a slice a trigger. Each
    micro-batch costs its jobs and its states' files besides its rows, so there are ``MOST`` at most and a larger
    table makes larger ones, spread over more files and tasks."""
    path, schema, files, _ = slices_of(s, d, name, rows, order)
    return s.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(s, x, mode="append"):
    root = f"{stage_root(s)}/stream-{uuid.uuid4().hex}"
    return live.run_once(x, f"{root}/out", f"{root}/checkpoint", mode)


def weather_stream(s, d):
    x = sliced(s, d, "rows", lambda: portable(s, d, ROWS).select("event_id", "entity", "t", "value", "lat", "lon"), "event_id")  # what is read below
    f = x.select(C("event_id").alias("seq"), C("entity").alias("station_id"), C("t").alias("ts"),
                 F.when((C("value") >= 30) & (C("value") < 32), C("lat") + 1).otherwise(C("lat")).alias("lat"), "lon",
                 F.when(C("value") >= 2, C("value") * 0.2).alias("rain_mm_15min"), (C("value") * 0.2 + 22).alias("temp_c"), F.lit(60).alias("rh_pct"))
    return ig.weather_measures(f, P, GRID)


def canon_stream(s, d):
    x = sliced(s, d, "canon", lambda: portable(s, d, CANON), "t")
    return (x.filter(sv.crosses_floor(C("category"), C("measure"))).withColumn("severity", sv.severity(C("category"), C("measure")))
            .withColumn("h3_cell", GRID.cell(C("lat"), C("lon"))).withColumn("start_utc", F.timestamp_seconds("t"))
            .withColumn("received_at", F.timestamp_seconds(C("t") + sv.interval_of(C("source")))))


query("r1_feed_ingest", R + f"SELECT seq, category, round(measure, 6) AS measure FROM ({WEATHER})")(
    lambda s, d: drain(s, weather_stream(s, d).select("seq", "category", "measure")).select("seq", "category", r6("measure").alias("measure")))
def written(s, x, name, writer):
    """The folder that a ``foreachBatch`` function wrote, once the stream is drained."""
    root = f"{stage_root(s)}/{name}-{uuid.uuid4().hex}"
    x.writeStream.foreachBatch(writer(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return root


def candidates(s, root):
    return s.read.parquet(f"{root}/candidates")


def power_stream(s, d):
    return ig.power_records(sliced(s, d, "power", lambda: power_feed(s, d), "seq"), portable(s, d, REG_SQL))


def late_register(s, d):
    """The register as it comes in: records are up to 500 seconds late."""
    known = event_rows(s, d).select(C("event_id").alias("seq"), C("t").alias("_t"))
    return stage(complaint_feed(s, d).join(known, "seq").withColumn("arrived", C("_t") + F.pmod(F.hash("seq"), F.lit(500))).drop("_t"), "register")


STORES = {
    "weather_imd": lambda s, d: written(s, weather_stream(s, d), "weather", lambda r: upserts.episode_writer(r, PS, True, candidates=True)),
    "air_sensors": lambda s, d: written(s, ig.air_readings(sliced(s, d, "air", lambda: air(s, d), "seq"), PS, GRID), "air", lambda r: upserts.episode_writer(r, PS)),
    "drain_scada": lambda s, d: written(s, ig.drain_readings(sliced(s, d, "drains", lambda: drains(s, d), "seq"), portable(s, d, DREG_SQL), PD, GRID), "drains",
                                        lambda r: upserts.episode_writer(r, PD, True)),
    "power_discom": lambda s, d: written(s, power_stream(s, d), "power", lambda r: upserts.outage_writer(r, PS, candidates=True)),
    "civic_complaints": lambda s, d: written(s, ig.complaint_records(sliced(s, d, "complaints", lambda: late_register(s, d), "arrived"), PS, GRID), "complaints",
                                             lambda r: upserts.complaint_writer(r, PS))}


def store(s, d, feed):
    """A feed's store of versions, drained once for all queries that read it."""
    return memo(s, d, f"store-{feed}", lambda: STORES[feed](s, d))


def all_stores(s, d):
    """Every feed's store. The streams run side by side: a small batch of one leaves most cores to the others."""
    with ThreadPoolExecutor(len(STORES)) as pool:
        return list(pool.map(lambda feed: store(s, d, feed), STORES))


_live = INGEST.replace("WITH ", "WITH " + CATS + ", ", 1).replace("arg_min(h3_cell, seq) AS h3_cell,", "max(measure) AS measure, arg_min(h3_cell, seq) AS h3_cell,").replace(
    "conf AS confidence, raw_ref FROM fo", f"conf AS confidence, raw_ref, round(coalesce(n, measure), 3) AS measure, {ts('t + ' + INTERVAL)} AS received_at FROM fo")


def event_out(e):
    return e.select("event_id", "source", "category", "h3_cell", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc"), "severity", "confidence", "raw_ref",
                    F.round("measure", 3).alias("measure"), iso("received_at").alias("received_at"))


for _name, _feed in (("r1_weather_episodes", "weather_imd"), ("r1_air_episodes", "air_sensors"), ("r1_drain_episodes", "drain_scada"), ("r1_power_events", "power_discom"),
                     ("r1_complaint_events", "civic_complaints")):
    query(_name, f"SELECT * FROM ({_live}) live WHERE source = '{_feed}'")(lambda s, d, feed=_feed: event_out(upserts.current_events(s, store(s, d, feed))))
query("r1_live_events", _live)(lambda s, d: event_out(upserts.current_events(s, all_stores(s, d))))
query("r2_stateful_episodes", _WS + island_sql("wm") + " " + _CSEL)(
    lambda s, d: cand_out(candidates(s, store(s, d, "weather_imd"))))
query("r3_stateful_outages", f"WITH {OUT}{_PC} SELECT seq, category, measure, {ts('t')} AS start_utc, NULL::varchar AS end_utc FROM pc UNION ALL SELECT seq, category, measure, {ts('t')}, {ts('t_end')} FROM pc WHERE t_end IS NOT NULL")(
    lambda s, d: candidates(s, store(s, d, "power_discom"))
    .select("seq", "category", "measure", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc")))
query("r4_live_windows", f"WITH {EV}, k AS (SELECT h3_cell, category, t // 300 * 300 - 300 * i AS w, severity FROM ev, range(12) r(i)) SELECT h3_cell, category, w, count(*) AS observed, round(sum(severity), 4) AS severity_weighted FROM k WHERE w + 3600 <= (SELECT max(t) FROM ev) - 600 GROUP BY ALL")(
    lambda s, d: drain(s, live.live_windows(canon_stream(s, d), P, 600)).select("h3_cell", "category", "w", "observed", F.round("severity_weighted", 4).alias("severity_weighted")))


def live_anomalies(s, d):
    """The detection part of the events as a stream, tested against the stored baseline of the part before."""
    x = detected(s, d)
    root = f"{stage_root(s)}/baselines-{uuid.uuid4().hex}"
    live.publish_baseline(x.baseline.filter("false"), 1.0, 0.0, root, 0)  # replaced before the stream begins
    live.publish_baseline(x.baseline, x.n_days, x.p_rare, root, 1)
    first = x.detection.agg(F.min("t")).first()[0] // P.step_sec * P.step_sec
    events = canon_stream(s, d).filter(C("t") >= x.start)
    span = lambda spark, t0, t1: x.detection.filter(C("t").between(t0, t1))
    out = f"{stage_root(s)}/anomalies-{uuid.uuid4().hex}"
    with live.state_a_core(s):
        q = (live.live_windows(events, P, 600).writeStream.foreachBatch(live.anomaly_writer(out, root, span, first, p=P))
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


_final = "we <= (SELECT max(t) FROM ev) - 600"
query("r4_live_anomalies", f"{DET} SELECT {_anom} FROM an WHERE {_final}")(lambda s, d: anom_out(s.read.parquet(f"{live_anomalies(s, d)}/anomalies")))
query("r4_live_members", f"{DET} SELECT anomaly_id, event_id FROM an JOIN de ON an.h3_cell = de.h3_cell AND an.category = de.category AND t >= ws AND t < we WHERE {_final}")(
    lambda s, d: s.read.parquet(f"{live_anomalies(s, d)}/members").drop("batch"))
query("r5_drop_resent", f"WITH {EV} SELECT event_id, {ts('t')} AS start_utc FROM ev")(
    lambda s, d: drain(s, live.drop_resent(canon_stream(s, d).select("event_id", "start_utc", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_duplicate"))).drop("is_duplicate"))
    .select("event_id", iso("start_utc").alias("start_utc")))


_n = f"greatest({SLICES}, (count(*) + {SLICE_ROWS - 1}) // {SLICE_ROWS})"
_step = "LEAST(n - 1, (t - lo) * n // (hi - lo + 1))"


@query("r6_situation_deltas", MILS + f""", spn AS (SELECT min(t) AS lo, max(t) AS hi, {_n} AS n FROM ({duck(CANON)}) z), tk AS (SELECT {_step} AS k, min(t) AS first, max(t) AS cur FROM ev, spn GROUP BY ALL), b AS (SELECT cur, coalesce(lag(cur) OVER (ORDER BY k), first - 1) AS prev FROM tk)
 SELECT sit AS situation_id, cur AS clock, 'created' AS action FROM rv, b WHERE rev > prev AND rev <= cur UNION ALL SELECT DISTINCT sit, cur, 'updated' FROM ms JOIN rv USING (sit), b WHERE rev <= prev AND m > prev AND m <= cur""")
def r6_deltas(s, d):
    a = asof(s, d)
    root = f"{stage_root(s)}/deltas-{uuid.uuid4().hex}"
    lo, hi, n = slices_of(s, d, "canon", lambda: portable(s, d, CANON), "t")[-1]
    ticks = canon_stream(s, d).select(C("start_utc").alias("t"), tick_of("t", lo, hi, n).alias("tick"))
    q = (ticks.writeStream.foreachBatch(live.delta_writer(a.reveals, a.milestones, root, a.situations)).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return s.read.parquet(f"{root}/deltas").filter(F.get_json_object("data", "$.members_known") > 0).select("situation_id", "clock", "action")


@query("r7_health_changes", f"""WITH {EV}, m AS (SELECT source AS feed, t_recv // 60 AS minute, max(t_recv) AS t FROM ev GROUP BY ALL), k AS (SELECT feed, t, lag(t) OVER (PARTITION BY feed ORDER BY t) AS p, 3 * CASE feed WHEN 'weather_imd' THEN 300 WHEN 'civic_complaints' THEN 60 ELSE 120 END AS lim FROM m)
 SELECT feed, 'live' AS state, {ts('t')} AS t FROM k WHERE p IS NULL OR t - p > lim UNION ALL SELECT feed, 'stale', {ts('p + lim + 1')} FROM k WHERE t - p > lim
 UNION ALL SELECT feed, 'stale', {ts('max(t) + max(lim) + 1')} FROM k GROUP BY feed HAVING max(t) + max(lim) < (SELECT greatest(max(t_recv), (SELECT max(t) FROM ({duck(CANON)}) c)) FROM ev) - 90""")
def r7(s, d):
    root = f"{stage_root(s)}/health-{uuid.uuid4().hex}"
    x = canon_stream(s, d).select(C("source").alias("feed"), C("received_at").alias("t"))
    clock = sliced(s, d, "clock", lambda: portable(s, d, CANON).select("t"), "t").select(F.timestamp_seconds("t").alias("t"))
    x = live.with_clock(x, clock)  # the clock says the same times once more
    x.writeStream.foreachBatch(live.health_writer(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/changes").select("feed", "state", iso("t").alias("t"))


_rate = f"WITH {EV}, k AS (SELECT t_recv // 3600 * 3600 AS t, source, count(*) AS n FROM ev GROUP BY ALL) SELECT t, source, n FROM k WHERE t + 3600 <= (SELECT max(t_recv) FROM ev) - "
query("r9_late_and_drifting_clocks", f"WITH {EV}, k AS (SELECT t_recv // 3600 * 3600 AS t, source, count(*) AS n FROM ev GROUP BY ALL) SELECT t, source, n FROM k WHERE t + 3600 <= (SELECT max(t_recv) FROM ev) - 690")(
    lambda s, d: drain(s, live.tolerate(canon_stream(s, d), "received_at", 90, 600).groupBy(F.window("received_at", "1 hour"), "source").agg(F.count("*").alias("n"))
                       .select(F.unix_timestamp("window.start").alias("t"), "source", "n")))
query("r10_running_rates", _rate + "90")(lambda s, d: drain(s, live.live_rates(canon_stream(s, d), 3600)))
query("r10_tick_totals", f"WITH {EV}, k AS (SELECT t_recv // 3600 * 3600 AS t, count(*) AS events, count(DISTINCT source) AS feeds FROM ev GROUP BY ALL) SELECT t, events, feeds FROM k WHERE t + 3600 <= (SELECT max(t_recv) FROM ev) - 90")(
    lambda s, d: drain(s, live.tick_totals(canon_stream(s, d), 3600)))
