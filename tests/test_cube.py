"""The additive cube: slices, windows by running sums, calibration, days added; the timeline of all ticks."""
import math
import random

import pytest
from pyspark.sql import functions as F

from cityweave import dims
from cityweave.functions import poisson
from cityweave.operators import baseline as bl, cube as cb, detect as dt, timeline as tl
from cityweave.params import DEFAULT, Params
from cityweave.plans import city

DAY, T0 = 86400, 1758672000


def made(n, seed, days=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        hot = r.random() < 0.35
        rows.append((f"e{i:05d}", 1 if hot else r.randrange(1, 7), "complaint.garbage" if hot else r.choice(["weather.rain", "complaint.garbage"]), r.choice(["weather_imd", "civic_complaints", "odd"]),
                     round(r.random(), 4), T0 + (r.randrange(3) * 700 if r.random() < 0.1 else r.randrange(days * DAY))))
    return rows


def frame(spark, rows):
    d = spark.createDataFrame(rows, "event_id string, h3_cell bigint, category string, source string, severity double, t bigint")
    return d.withColumn("start_utc", F.timestamp_seconds("t"))


def brute_windows(rows, p=DEFAULT):
    ts = [x[5] for x in rows]
    lo = min(ts) // p.step_sec * p.step_sec
    hi = math.ceil((max(ts) - p.window_sec) / p.step_sec) * p.step_sec if max(ts) > min(ts) + p.window_sec else lo
    out = {}
    for _, cell, cat, src, sev, t in rows:
        first = t // p.step_sec * p.step_sec
        for w in range(first - p.window_sec + p.step_sec, first + 1, p.step_sec):
            if lo <= w <= hi:
                n, s, feeds = out.get((cell, cat, w), (0, 0, set()))
                out[cell, cat, w] = n + 1, s + round(sev * 10000), feeds | {src}
    return {k: (n, round(s / 10000, 4), sorted(f)) for k, (n, s, f) in out.items()}


@pytest.mark.parametrize("n, days", [(1, 1), (5, 1), (400, 1), (900, 6)])
def test_windows_are_differences_of_running_sums(spark, n, days):
    rows = made(n, n, days)
    got = {(r.h3_cell, r.category, r.w): (r.observed, round(r.severity_weighted, 4), r.source_feeds) for r in dt.window_counts(frame(spark, rows)).collect()}
    assert got == brute_windows(rows)


def test_windows_of_nothing(spark):
    assert dt.window_counts(frame(spark, [("a", 1, "weather.rain", "weather_imd", 0.5, T0)]).limit(0)).count() == 0


@pytest.mark.parametrize("t0, t1", [(None, None), (T0 + 1000, None), (None, T0 + 2 * DAY + 17), (T0 + 300, T0 + 600), (T0 + 301, T0 + 599), (T0 + 301, T0 + 5000), (T0 + 450, T0 + 750), (T0 + 600, T0 + 700),
                                    (T0 + 650, T0 + 650)])
def test_slices_cut_at_any_second(spark, t0, t1):
    rows = made(600, 3, 3)
    ev = frame(spark, rows)
    got = cb.Slices(cb.steps(ev), ev, DEFAULT).span(t0, t1)
    d = [x for x in rows if (t0 is None or x[5] >= t0) and (t1 is None or x[5] < t1)]
    r = got.agg(F.sum("n"), F.min("first"), F.max("last"), F.sum("sev")).first()
    assert (r[0] or 0, r[1], r[2]) == (len(d), min((x[5] for x in d), default=None), max((x[5] for x in d), default=None))
    assert float(r[3] or 0) == pytest.approx(sum(x[4] for x in d))


def test_days_are_added_to_a_stored_cube(spark, tmp_path):
    """A day's events, added once or again, change that day alone; detection from the stored cube is that from the events."""
    ev = frame(spark, made(1000, 5, 3))
    path = str(tmp_path / "cube")
    for k in range(3):
        part = ev.filter((F.col("t") >= T0 + k * DAY) & (F.col("t") < T0 + (k + 1) * DAY))
        for _ in range(2 if k == 1 else 1):
            cb.store(part, path, batch=str(k))
    cols = ["h3_cell", "category", "pane", "source", "n", "sev", "first", "last"]
    show = lambda d: sorted(str(tuple(r)) for r in d.select(*cols).collect())
    assert show(cb.stored(spark, path)) == show(cb.steps(ev))
    import datetime as dt_
    day = dt_.datetime.fromtimestamp(T0 + 2 * DAY, dt_.timezone.utc).date()
    assert show(cb.stored(spark, path, day, day)) == show(cb.steps(ev.filter((F.col("t") >= T0 + 2 * DAY) & (F.col("t") < T0 + 3 * DAY))))
    p = Params(lookback_hours=30, rare_thresholds=(0.5, 0.2, 0.1, 0.05, 0.01))
    ev = ev.withColumn("confidence", F.lit(0.6)).withColumn("end_utc", F.lit(None).cast("timestamp"))
    a, b = city.detect(ev, p=p), city.detect(ev, p=p, cube=cb.stored(spark, path))
    assert a.p_rare == b.p_rare and show_ids(a) == show_ids(b) and len(show_ids(a)) > 5


def show_ids(d):
    return sorted((r.anomaly_id, r.observed_count, r.p_value) for r in d.anomalies.collect())


def test_calibration_from_slices_is_that_from_events(spark):
    """Rates, windows and tails of a held-out day, made from its events alone."""
    ev = frame(spark, made(1500, 9))
    p = Params(rare_thresholds=(0.5, 0.2, 0.1, 0.05, 0.02, 0.01))
    cats = dims.categories(spark)
    end = T0 + 5 * DAY + 40_000
    history = ev.filter(F.col("t") < end)
    day = bl.held_out_day(history, 2)
    train, held = bl.day_slice(history, day)
    n = bl.history_days(train, day)
    tested = dt.test_windows(dt.window_counts(held, p), bl.learn(train, n, p), n, cats, p)
    want = dt.choose_threshold(dt.calibration_sweep(tested, held, p=p)).first()["threshold"]
    cube = cb.Slices(cb.steps(ev), ev, p)
    assert dt.calibrate(cube, cats, p, end) == want and day == T0 + 4 * DAY
    assert dt.calibrate(cb.Slices(cb.steps(ev.limit(1)), ev.limit(1), p), cats, p, end) is None
    got = dt.false_alarm(cube, cats, want, p, end).first()
    last = [x for x in made(1500, 9) if T0 + 5 * DAY <= x[5] < end]
    assert got["events"] == len(last) and got["pairs"] == len({(x[1], x[2]) for x in last})


def test_poisson_tail_on_a_grid(spark):
    """Error below 1e-12 up to 10,000, and no lambda in the plan."""
    rows = [(k, max(k + z * math.sqrt(k), 1e-9)) for k in (1, 2, 5, 20, 31, 32, 33, 34, 50, 100, 1000, 10_000) for z in (-9, -5, -3, -1, -0.2, 0, 0.2, 1, 3, 5, 9)]
    rows += [(0, 3.0), (3, 0.0), (5, 1e-6), (40, 1e-6), (3, 900.0), (40, 5000.0)]
    d = poisson.with_poisson_tail(spark.createDataFrame(rows, "k bigint, lam double"), F.col("k"), F.col("lam"), "p")
    assert "lambda" not in d._jdf.queryExecution().toString()
    for r in d.collect():
        assert r.p == pytest.approx(exact_tail(r.k, r.lam), abs=1e-12), (r.k, r.lam)


def exact_tail(k, lam):
    from decimal import Decimal, getcontext
    getcontext().prec = 60
    x = Decimal(lam)
    term = (-x).exp()
    below = Decimal(0)
    for j in range(k):
        below += term
        term = term * x / (j + 1)
    return float(1 - below)


# ------------------------------------------------------------------ timeline -----------------
@pytest.mark.parametrize("tick_sec, n, t0", [(7, 40, 0), (1, 1, 120)])
def test_every_tick_is_what_a_snapshot_says(spark, tick_sec, n, t0):
    from cityweave.operators import serve
    r = random.Random(n)
    ev = spark.createDataFrame([(f"e{i}", T0 + r.randrange(200), r.choice([None, 0, 5, 60])) for i in range(60)], "event_id string, s bigint, d bigint").select(
        "event_id", F.timestamp_seconds("s").alias("start_utc"), F.when(F.col("d").isNotNull(), F.timestamp_seconds(F.col("s") + F.col("d"))).alias("end_utc"))
    p = DEFAULT.but(active_window_sec=20)
    sits, ms = [], []
    for k in range(9):
        members = r.choice([1, 2, 3, 8])
        sits.append((f"S{k}", r.choice(["active", "active", "closed"]), k == 4, r.randrange(100), [r.randrange(6) for _ in range(2)], T0 + 150))
        for m in range(members):
            ms.append((f"S{k}", f"e{m}", r.choice(["a", "b", "c"]), r.choice(["x", "y"]), round(r.random(), 4), r.choice([0.6, 0.45, 0.9]), T0 + r.randrange(4, 15) * 10))
    S = spark.createDataFrame(sits, "situation_id string, status string, is_decoy boolean, pulse_score bigint, h3_cells array<bigint>, c bigint").withColumn("created_utc", F.timestamp_seconds("c")) \
             .withColumn("confidence_level", F.lit("med")).withColumn("alert_level", F.lit("green"))
    M = spark.createDataFrame(ms, "situation_id string, event_id string, source string, category string, severity double, confidence double, m bigint").withColumn("milestone", F.timestamp_seconds("m"))
    R = serve.reveal_times(M, S)
    got = tl.tick_timeline(ev, S, M, R, T0 + t0, n, tick_sec, p).orderBy("tick").collect()
    assert [x.tick for x in got] == list(range(n))
    for x in r.sample(got, min(n, 5)):
        t = T0 + t0 + x.tick * tick_sec
        part = serve.partial_situations(S, M, R, t)
        c, level = serve.counts(ev, part, t, p).first(), serve.city_rollup(part).first()
        assert (x.events_active, x.situations_active, x.cells_touched, x.city_pulse_score, x.city_alert_level) == (c[0], c[1], c[2], level[0], level[1]), t
        deltas = [q.action for q in serve.situation_deltas(R, M, t - tick_sec, t).collect()]
        assert (x.created, x.updated, x.events_new) == (deltas.count("created"), deltas.count("updated"), serve.new_events(ev, t - tick_sec, t).count()), t
