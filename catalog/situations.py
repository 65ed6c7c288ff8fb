"""Detection, linking, situations and as-of answers over the events table."""
from pyspark.sql import functions as F

from cityweave import dims, vocabulary as v
from cityweave.functions import ids, severity as sv, times
from cityweave.operators import baseline as bl, detect as dt, ingest as ig, link as lk, serve, situations as st
from cityweave.operators.scale import one_row
from cityweave.plans import city

from .base import EV, FEEDS, MARKS, P, PAIRS, canon, cells, dist, hav, iso, joined, lit, memo, portable, query, r6, rnd, ts, values
from .columns import OFF, _clat, _clon

C = F.col
LOOK = int(P.lookback_hours * 3600)


# ------------------------------------------------------------------ staged once per folder --
def events(s, d):
    return memo(s, d, "events", lambda: city.stage(canon(s, d), "canon"))


def detected(s, d):
    return memo(s, d, "detected", lambda: city.detect(events(s, d), p=P))


def linked(s, d):
    def build():
        x = detected(s, d)
        return city.link(x.anomalies, x.history, x.detection, degraded=bad_feeds(s), p=P)
    return memo(s, d, "linked", build)


def asof(s, d):
    return memo(s, d, "asof", lambda: city.as_of(events(s, d), detected(s, d), linked(s, d), P))


def bad_feeds(s):
    return s.createDataFrame([("weather_imd", 1500)], "feed string, age_sec bigint")


edges = dims.plausible_pairs

# ------------------------------------------------------------------ check SQL ---------------
CUT = f"""cutt AS (SELECT max(t) - {LOOK} AS cut FROM ev), h AS (SELECT ev.*, ((t + {OFF}) // 3600) % 24 AS hour FROM ev, cutt WHERE t < cut), de AS (SELECT ev.* FROM ev, cutt WHERE t >= cut),
nd AS (SELECT greatest(1e-6, (max(cut) - min(t)) / 86400.0::double) AS n_days FROM h, cutt)"""
BASE = """c3 AS (SELECT h3_cell, category, hour, count(*) AS n FROM h GROUP BY ALL), c2 AS (SELECT h3_cell, category, count(*) AS n FROM h GROUP BY ALL),
ch AS (SELECT category, hour, count(*) AS n FROM h GROUP BY ALL), cc AS (SELECT category, count(*) AS n FROM h GROUP BY ALL), ac AS (SELECT greatest(1, count(DISTINCT h3_cell)) AS active FROM h)"""


def win_sql(src, out):
    return f"""{out}_g AS (SELECT min(t) // 300 * 300 AS lo, CASE WHEN max(t) > min(t) + 3600 THEN cast(ceil((max(t) - 3600) / 300.0) * 300 as bigint) ELSE min(t) // 300 * 300 END AS hi FROM {src}),
{out}_e AS (SELECT e.*, t // 300 * 300 - 300 * i AS w FROM {src} e, range(12) r(i)), {out}_m AS (SELECT e.* FROM {out}_e e, {out}_g WHERE w BETWEEN lo AND hi),
{out} AS (SELECT h3_cell, category, w, count(*) AS observed, round(sum(severity), 4) AS sev, list_sort(list(DISTINCT source)) AS src, ((w + {OFF}) // 3600) % 24 AS hour FROM {out}_m GROUP BY h3_cell, category, w)"""


def test_sql(win, out, c3="c3", ch="ch", cc="cc", ac="ac", nd="nd"):
    prior = f"coalesce(nullif(ch.n, 0) / (active * n_days), cc.n / (24 * active * n_days), 1e-6)"
    return f"""{out}_l AS (SELECT w.*, greatest(1e-6, (coalesce(c3.n, 0) + 5.0::double * {prior}) / (n_days + 5.0)) AS lam, CASE WHEN coalesce(c3.n, 0) >= 5 THEN 'cell_category_hour' ELSE 'shrunk_to_prior' END AS level
  FROM {win} w LEFT JOIN {c3} c3 ON c3.h3_cell = w.h3_cell AND c3.category = w.category AND c3.hour = w.hour LEFT JOIN {ch} ch ON ch.category = w.category AND ch.hour = w.hour LEFT JOIN {cc} cc ON cc.category = w.category, {ac}, {nd}),
{out} AS (SELECT x.*, p < 0.01 AND observed >= 3 AS volume, rare AND sev >= 0.4 AS rare_ok FROM (SELECT l.*, list_sum(list_transform(range(0, 200), lambda i: exp(-lam + (observed + i) * ln(lam) - lgamma(observed + i + 1)))) AS p FROM {out}_l l) x JOIN cats USING (category))"""


DAYS = """dl AS (SELECT max(t // 86400) * 86400 AS last FROM h), dp AS (SELECT max(t // 86400) * 86400 AS prev FROM h, dl WHERE t < last)"""


def day_sql(day):
    return f"""tr AS (SELECT h.* FROM h, {day[0]} WHERE t < {day[1]}), hd AS (SELECT h.* EXCLUDE (hour) FROM h, {day[0]} WHERE t >= {day[1]} AND t < {day[1]} + 86400),
nd2 AS (SELECT (max({day[1]}) - min(t)) / 86400.0::double AS n_days FROM tr, {day[0]}), k3 AS (SELECT h3_cell, category, hour, count(*) AS n FROM tr GROUP BY ALL), kh AS (SELECT category, hour, count(*) AS n FROM tr GROUP BY ALL),
kc AS (SELECT category, count(*) AS n FROM tr GROUP BY ALL), ka AS (SELECT greatest(1, count(DISTINCT h3_cell)) AS active FROM tr), """ + win_sql("hd", "hwin") + ", " + test_sql("hwin", "htst", "k3", "kh", "kc", "ka", "nd2") + """,
blk AS (SELECT h3_cell, category, w // 3600 AS b, bool_or(volume) AS volume, min(CASE WHEN rare_ok THEN p END) AS p_min FROM htst GROUP BY ALL)"""


_th = values("th", "rank, threshold", list(enumerate(P.rare_thresholds)))
# the calibrated rare threshold, from the second-last day of the history
SWEEP = f"""{DAYS}, {day_sql(('dp', 'prev'))}, {_th}, pr AS (SELECT count(DISTINCT (h3_cell, category)) AS pairs FROM hd),
sw AS (SELECT rank, threshold, (SELECT count(*) FROM blk WHERE volume OR p_min < threshold) AS blocks, pairs * 24 AS trials, pairs * 24 * 0.01::double + 2 * sqrt(pairs * 24 * 0.01::double * 0.99) AS budget FROM th, pr),
chosen AS (SELECT threshold, blocks FROM sw ORDER BY blocks > budget, CASE WHEN blocks <= budget THEN rank ELSE -rank END LIMIT 1)"""
ANOM = f"""an AS (SELECT 'ANOM-' || substr(sha1(h3_cell || '|' || category || '|' || {ts('w')}), 1, 8) AS anomaly_id, h3_cell, category, w AS ws, w + 3600 AS we, observed, lam, p, CASE WHEN volume THEN 'volume' ELSE 'rare' END AS trig, sev, src
  FROM tst WHERE volume OR (rare_ok AND p < (SELECT threshold FROM chosen)))"""
DET = "WITH RECURSIVE " + EV + ", " + CUT + ", " + BASE + ", " + SWEEP + ", " + win_sql("de", "win") + ", " + test_sql("win", "tst") + ", " + ANOM

# ------------------------------------------------------------------ A4..A14, T13, T14 --------
query("a4_history_split", f"WITH {EV}, {CUT} SELECT (SELECT count(*) FROM h) AS history, (SELECT count(*) FROM de) AS detection, {ts('cut')} AS boundary, round(n_days, 6) AS n_days FROM cutt, nd")(
    lambda s, d: (lambda x: one_row(x.history.agg(F.count("*").alias("history")), x.detection.agg(F.count("*").alias("detection"))).select(
        "history", "detection", iso(F.timestamp_seconds(F.lit(x.start))).alias("boundary"), F.round(F.lit(x.n_days), 6).alias("n_days")))(detected(s, d)))
query("a5_baseline_grains", f"""WITH {EV}, {CUT}, {BASE} SELECT grain, h3_cell, category, hour, n AS support, round(rate, 9) AS rate FROM (
 SELECT 'cell_category_hour' AS grain, h3_cell, category, hour, n, n / n_days AS rate FROM c3, nd UNION ALL SELECT 'cell_category', h3_cell, category, NULL, n, n / (n_days * 24) FROM c2, nd
 UNION ALL SELECT 'category_hour', NULL, category, hour, n, n / (n_days * active) FROM ch, nd, ac UNION ALL SELECT 'category', NULL, category, NULL, n, n / (n_days * 24 * active) FROM cc, nd, ac) z""")(
    lambda s, d: (lambda x: bl.learn(x.history, x.n_days, P))(detected(s, d)).select("grain", "h3_cell", "category", "hour", "support", F.round("rate", 9).alias("rate")))
query("a6_shrunk_rate", f"{DET} SELECT h3_cell, category, w, round(lam, 9) AS lam, level FROM tst")(
    lambda s, d: detected(s, d).tested.select("h3_cell", "category", "w", F.round("lam", 9).alias("lam"), "level"))
query("a7_all_hours_rate", f"""WITH {EV}, {CUT}, {BASE} SELECT h3_cell, category, round(greatest(1e-6, (coalesce(c2.n, 0) + 120 * coalesce(cc.n / (24 * active * n_days), 1e-6)) / (n_days * 24 + 120)), 9) AS lam_all
 FROM (SELECT DISTINCT h3_cell, category FROM ev) k LEFT JOIN c2 USING (h3_cell, category) LEFT JOIN cc USING (category), nd, ac""")(
    lambda s, d: (lambda x: bl.all_hours_rate(events(s, d).select("h3_cell", "category").distinct(), x.baseline, x.n_days, P))(detected(s, d)).select("h3_cell", "category", F.round("lam_all", 9).alias("lam_all")))
query("a8_window_counts", f"WITH {EV}, {win_sql('ev', 'win')} SELECT h3_cell, category, w, observed FROM win")(lambda s, d: dt.window_counts(events(s, d), P).select("h3_cell", "category", "w", "observed"))
query("a9_window_payload", f"WITH {EV}, {win_sql('ev', 'win')} SELECT h3_cell, category, w, sev AS severity_weighted, array_to_string(src, ',') AS source_feeds FROM win")(
    lambda s, d: dt.window_counts(events(s, d), P).select("h3_cell", "category", "w", F.round("severity_weighted", 4).alias("severity_weighted"), joined("source_feeds").alias("source_feeds")))
query("a9_window_members", f"{DET} SELECT anomaly_id, event_id FROM an JOIN de ON an.h3_cell = de.h3_cell AND an.category = de.category AND t >= ws AND t < we")(lambda s, d: detected(s, d).members)
query("a11_triggers", f"{DET} SELECT h3_cell, category, w, volume, rare_ok FROM tst")(lambda s, d: detected(s, d).tested.select("h3_cell", "category", "w", "volume", "rare_ok"))
_anom = f"anomaly_id, h3_cell, category, {ts('ws')} AS window_start_utc, {ts('we')} AS window_end_utc, observed AS observed_count, {rnd('lam', 4)} AS expected_count, {rnd('p', 6)} AS p_value, trig AS trigger, sev AS severity_weighted, array_to_string(src, ',') AS source_feeds"


def anom_out(a):
    return a.select("anomaly_id", "h3_cell", "category", iso("window_start_utc").alias("window_start_utc"), iso("window_end_utc").alias("window_end_utc"), "observed_count",
                    "expected_count", "p_value", "trigger", "severity_weighted", joined("source_feeds").alias("source_feeds"))


@query("c2_detect", f"{DET} SELECT {_anom} FROM an")
def c2(s, d):
    return anom_out(city.detect(city.stage(canon(s, d), "canon"), p=P).anomalies)


query("a12_degraded_feeds", f"{DET} SELECT anomaly_id, CASE category WHEN 'traffic.signal_down' THEN 'civic_complaints' WHEN 'complaint.waterlogging' THEN 'civic_complaints' WHEN 'complaint.road_damage' THEN 'civic_complaints' ELSE '' END AS degraded FROM an")(
    lambda s, d: (lambda x: dt.flag(x.tested, x.p_rare, {"drain_scada", "civic_complaints"}, P))(detected(s, d)).select("anomaly_id", joined("degraded_by_stale_feeds").alias("degraded")))
query("a13_threshold_sweep", f"WITH {EV}, {CUT}, {SWEEP} SELECT rank, threshold, blocks, trials, round(budget, 6) AS budget FROM sw")(
    lambda s, d: sweep(s, d).select(C("rank").cast("bigint").alias("rank"), "threshold", "blocks", "trials", r6("budget").alias("budget")))


def sweep(s, d):
    x = detected(s, d)
    held, tested = dt.day_tested(x.cube, bl.held_out_day(x.history, 2), dims.categories(s), P, x.start)
    return dt.calibration_sweep(tested, held, p=P)


query("a13_chosen_threshold", f"WITH {EV}, {CUT}, {SWEEP} SELECT threshold, blocks FROM chosen")(lambda s, d: dt.choose_threshold(sweep(s, d)).select("threshold", "blocks"))
query("a14_held_out_day", f"WITH {EV}, {CUT}, {DAYS}, {day_sql(('dp', 'prev'))} SELECT {ts('prev')} AS day, (SELECT count(*) FROM tr) AS train, (SELECT count(*) FROM hd) AS held, round(n_days, 6) AS n_days FROM dp, nd2")(lambda s, d: held_out(s, d))


def held_out(s, d):
    h = detected(s, d).history
    day = bl.held_out_day(h, 2)
    a, b = bl.day_slice(h, day)
    return one_row(a.agg(F.count("*").alias("train")), b.agg(F.count("*").alias("held"))).select(
        iso(F.timestamp_seconds(F.lit(day))).alias("day"), "train", "held", F.round(F.lit(bl.history_days(a, day)), 6).alias("n_days"))


query("a31_false_alarm_z", f"""WITH {EV}, {CUT}, {DAYS}, {day_sql(('dl', 'last'))}, x AS (SELECT (SELECT count(DISTINCT (h3_cell, category)) FROM hd) AS pairs, (SELECT count(*) FROM blk WHERE volume OR p_min < {P.p_rare}) AS blocks, (SELECT count(*) FROM hd) AS events)
 SELECT events, pairs, pairs * 24 AS trials, blocks, round((blocks - pairs * 24 * 0.01::double) / sqrt(pairs * 24 * 0.01::double * 0.99), 6) AS z FROM x""")(
    lambda s, d: (lambda x: dt.false_alarm(x.cube, dims.categories(s), P.p_rare, P, x.start))(detected(s, d)).select("events", "pairs", "trials", "blocks", r6("z").alias("z")))
MID = "(SELECT (cut + max(t)) // 2 FROM ev, cutt GROUP BY cut)"


def mid(s, d):
    x = detected(s, d)
    top = memo(s, d, "top", lambda: events(s, d).agg(F.max("t")).first()[0])
    return int((x.start + top) // 2)


query("t14_anomalies_as_of", f"{DET} SELECT anomaly_id FROM an WHERE we <= {MID}")(lambda s, d: serve.anomalies_as_of(detected(s, d).anomalies, mid(s, d)).select("anomaly_id"))

# ------------------------------------------------------------------ episodes and lift -------
EPI = f""", n1 AS (SELECT *, CASE WHEN lag(we) OVER q IS NULL OR ws > lag(we) OVER q THEN 1 ELSE 0 END AS nw FROM an WINDOW q AS (PARTITION BY h3_cell, category ORDER BY ws)),
n2 AS (SELECT *, sum(nw) OVER (PARTITION BY h3_cell, category ORDER BY ws) AS run FROM n1),
n3 AS (SELECT *, lpad(h3_cell::varchar, 14, '0') || ' ' || category || ' ' || lpad((min(ws) OVER (PARTITION BY h3_cell, category, run))::varchar, 11, '0') AS eid FROM n2),
em AS (SELECT DISTINCT eid, de.* FROM n3 JOIN de ON n3.h3_cell = de.h3_cell AND n3.category = de.category AND t >= ws AND t < we),
e1 AS (SELECT eid, any_value(h3_cell) AS h3_cell, any_value(category) AS category, CASE WHEN bool_or(trig = 'rare') THEN 'rare' ELSE 'volume' END AS trig, min(ws) AS ws, max(we) AS we, min(p) AS p, list_sort(list(DISTINCT anomaly_id)) AS aids FROM n3 GROUP BY eid),
e2 AS (SELECT eid, count(*) AS n, round(sum(severity), 4) AS sev, min(t) AS rep_t, max(t) AS last_t, arg_min(event_id, (t, event_id)) AS rep, list_sort(list(DISTINCT source)) AS src FROM em GROUP BY eid),
ep AS (SELECT * FROM e1 JOIN e2 USING (eid))"""
query("w6_episode_collapse", DET + EPI + " SELECT anomaly_id, eid AS episode_id FROM n3")(lambda s, d: lk.number_episodes(detected(s, d).anomalies).select("anomaly_id", "episode_id"))
query("a15_episodes", DET + EPI + f" SELECT eid AS episode_id, h3_cell, category, trig AS trigger, {ts('ws')} AS window_start_utc, {ts('we')} AS window_end_utc, n AS observed_count, sev AS severity_weighted, rep AS rep_event_id, array_to_string(aids, ',') AS anomaly_ids, array_to_string(src, ',') AS source_feeds FROM ep")(
    lambda s, d: linked(s, d).episodes.select("episode_id", "h3_cell", "category", "trigger", iso("window_start_utc").alias("window_start_utc"), iso("window_end_utc").alias("window_end_utc"), "observed_count",
                                              F.round("severity_weighted", 4).alias("severity_weighted"), "rep_event_id", joined(F.transform("anomaly_ids", ids.public)).alias("anomaly_ids"), joined("source_feeds").alias("source_feeds")))
_ring = values("rg", "k, off", [(k, dq * 2097152 + dr) for k in (1, 2) for dq in range(-k, k + 1) for dr in range(-k, k + 1) if max(abs(dq), abs(dr), abs(dq + dr)) <= k])
LIFT = f""", {PAIRS}, {_ring}, lg AS (SELECT a.event_id, p.cause, p.effect, p.lo, p.hi, a.t, a.h3_cell FROM h a JOIN pairs p ON a.category = p.cause),
hits AS (SELECT l.event_id, l.cause, l.effect, min(b.t - l.t) AS lag FROM lg l JOIN rg ON k = 1 JOIN h b ON b.h3_cell = l.h3_cell + off AND b.category = l.effect AND b.t - l.t BETWEEN l.lo AND l.hi GROUP BY ALL),
loc AS (SELECT b.h3_cell + off AS h3_cell, b.category AS effect, count(*) AS n FROM h b JOIN rg ON k = 1 GROUP BY ALL), sp AS (SELECT greatest(1.0, max(t) - min(t)) AS span FROM h),
ex AS (SELECT l.cause, l.effect, sum(1 - exp(-coalesce(loc.n, 0) * (hi - lo) / span)) AS expected FROM lg l LEFT JOIN loc ON loc.h3_cell = l.h3_cell AND loc.effect = l.effect, sp GROUP BY l.cause, l.effect),
ob AS (SELECT cause, effect, count(*) AS n, list_sort(list(lag))[len(list(lag)) // 2 + 1] AS med FROM hits GROUP BY ALL),
lt AS (SELECT p.*, coalesce(cc1.n, 0) AS n_cause, coalesce(cc2.n, 0) AS n_effect, coalesce(ob.n, 0) AS o, coalesce(expected, 0.0) AS e, med, span FROM pairs p LEFT JOIN ob USING (cause, effect) LEFT JOIN ex USING (cause, effect) LEFT JOIN cc cc1 ON cc1.category = cause LEFT JOIN cc cc2 ON cc2.category = effect, sp),
lift AS (SELECT *, {rnd('(o + 0.5) / (e + 0.5)', 3)} AS val, {rnd('o / (span / 3600.0)', 6)} AS orate, {rnd('e / (span / 3600.0)', 6)} AS brate FROM lt)"""
HB = f"WITH RECURSIVE {EV}, {CUT}, {BASE}"
query("a16_lift_table", HB + LIFT + " SELECT cause, effect, n_cause, n_effect, o AS cooccurrences, " + rnd("e", 4) + " AS expected, val AS value, orate AS observed_rate, hi - lo AS window_sec FROM lift")(
    lambda s, d: linked(s, d).lift.select("cause", "effect", "n_cause", "n_effect", "cooccurrences", C("expected_cooccurrences").alias("expected"), "value", C("observed_rate_per_hour").alias("observed_rate"), "window_sec"))
query("a17_upper_median_lag", HB + LIFT + " SELECT cause, effect, med AS median_lag_sec FROM lift")(lambda s, d: linked(s, d).lift.select("cause", "effect", "median_lag_sec"))
query("j8_ring_neighbours", f"WITH {EV}, {_ring}, c AS (SELECT h3_cell, category, count(*) AS n FROM ev GROUP BY ALL) SELECT a.h3_cell, a.category, k, sum(b.n)::bigint AS nearby FROM c a JOIN rg ON true JOIN c b ON b.h3_cell = a.h3_cell + off AND b.category = a.category GROUP BY ALL")(
    lambda s, d: ring_sums(s, d))


def ring_sums(s, d):
    from cityweave.functions.hexgrid import ring
    c = events(s, d).groupBy("h3_cell", "category").agg(F.count("*").alias("n"))
    out = None
    for k in (1, 2):
        near = c.select(F.explode(ring(C("h3_cell"), k)).alias("h3_cell"), "category", "n").groupBy("h3_cell", "category").agg(F.sum("n").alias("nearby"))
        x = c.select("h3_cell", "category").join(near, ["h3_cell", "category"]).withColumn("k", F.lit(k).cast("bigint"))
        out = x if out is None else out.unionByName(x)
    return out


query("j9_cause_effect_lags", HB + LIFT + " SELECT cause, effect, lag, count(*) AS n FROM hits GROUP BY ALL")(
    lambda s, d: lk.cause_effect_lags(detected(s, d).history, edges(s), P).filter("lag is not null").groupBy("cause", "effect", "lag").agg(F.sum("n").alias("n")))

# ------------------------------------------------------------------ links -------------------
D_IJ = dist("a.h3_cell", "b.h3_cell")
LNK = f""", el0 AS (SELECT a.eid AS i, b.eid AS j, cause, effect, lo, hi, {D_IJ} AS dist, y.t - x.t AS gap, x.t AS ta, x.event_id AS ea, y.t AS tb, y.event_id AS eb
  FROM ep a JOIN pairs ON cause = a.category JOIN ep b ON b.category = effect AND {D_IJ} <= 1 JOIN em x ON x.eid = a.eid JOIN em y ON y.eid = b.eid WHERE y.t - x.t BETWEEN lo AND hi),
el1 AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY gap, ta, ea, tb, eb) AS rn FROM el0),
el AS (SELECT l.*, val, {rnd("0.4::double * CASE WHEN dist = 0 THEN 1.0 ELSE 0.6 END + 0.4::double * greatest(0.0, 1.0 - (gap - l.lo) / greatest(1.0, l.hi - l.lo)::double) + 0.2::double * CASE WHEN val > 0 THEN least(1.0, val / 1.5::double) ELSE 0 END", 4)} AS score
  FROM el1 l JOIN lift USING (cause, effect) WHERE rn = 1)"""
LINKS = DET + EPI + LIFT + LNK
query("j10_candidate_links", LINKS + " SELECT i, j, cause, effect, dist AS distance, val AS lift_value FROM el")(lambda s, d: linked(s, d).links.select("i", "j", "cause", "effect", "distance", "lift_value"))
query("j11_best_event_pair", LINKS + " SELECT i, j, gap AS gap_sec, ea AS cause_event_id, eb AS effect_event_id FROM el")(lambda s, d: linked(s, d).links.select("i", "j", "gap_sec", "cause_event_id", "effect_event_id"))
query("g1_link_score", LINKS + " SELECT i, j, score FROM el")(lambda s, d: linked(s, d).links.select("i", "j", "score"))
COMP = """, und AS (SELECT i AS u, j AS w FROM el UNION SELECT j, i FROM el), reach(u, w) AS (SELECT eid, eid FROM ep UNION SELECT r.u, und.w FROM reach r JOIN und ON und.u = r.w),
cmp AS (SELECT u AS eid, min(w) AS comp FROM reach GROUP BY u)"""
COMPS = LINKS + COMP
query("g2_connected_components", COMPS + " SELECT eid AS episode_id, comp AS component FROM cmp")(lambda s, d: linked(s, d).components)
query("w11_best_link_per_pair", LINKS + " SELECT least(i, j) AS a, greatest(i, j) AS b, max(score) AS score FROM el GROUP BY ALL")(lambda s, d: lk.best_link_per_pair(linked(s, d).links).select("a", "b", "score"))
ANCH = f""", inc AS (SELECT j, eb, tb, row_number() OVER (PARTITION BY j ORDER BY gap, score DESC, i) AS rn FROM el),
anc AS (SELECT ep.eid, coalesce(eb, rep) AS aev, coalesce(tb, rep_t) AS a_t FROM ep LEFT JOIN inc ON j = eid AND rn = 1), pm AS (SELECT em.*, aev, a_t FROM em JOIN anc USING (eid) WHERE abs(t - a_t) <= 3600),
re AS (SELECT eid, h3_cell, category, aev, a_t, count(*) AS n, round(sum(severity), 4) AS sev, list_sort(list(DISTINCT source)) AS src FROM pm GROUP BY ALL)"""
ANCHS = COMPS + ANCH
query("w7_anchor_choice", ANCHS + " SELECT eid AS episode_id, aev AS anchor_event_id FROM anc")(lambda s, d: linked(s, d).anchors.select("episode_id", "anchor_event_id"))
query("g3_pruned_evidence", ANCHS + " SELECT eid AS episode_id, n AS n_events, sev AS severity_weighted, array_to_string(src, ',') AS source_feeds FROM re")(
    lambda s, d: linked(s, d).resolved.select("episode_id", "n_events", F.round("severity_weighted", 4).alias("severity_weighted"), joined("source_feeds").alias("source_feeds")))
ELIG = """, sz AS (SELECT comp, count(*) AS n FROM cmp GROUP BY comp), el9 AS (SELECT comp, sz.n AS size FROM sz JOIN ep ON eid = comp JOIN cats USING (category) WHERE sz.n > 1 OR (rare AND category IN (SELECT cause FROM pairs) AND sev >= 0.25))"""
query("g4_standalone_gate", ANCHS + ELIG + " SELECT comp AS component, size, size = 1 AS standalone FROM el9")(lambda s, d: linked(s, d).eligible)
query("g5_edge_table", f"WITH {EV}, {PAIRS}, c AS (SELECT DISTINCT category FROM ev) SELECT category, (SELECT string_agg(effect, ',' ORDER BY effect) FROM pairs WHERE cause = category) AS successors, (SELECT string_agg(cause, ',' ORDER BY cause) FROM pairs WHERE effect = category) AS predecessors FROM c")(
    lambda s, d: events(s, d).select("category").distinct().join(lk.successors(edges(s)), "category", "left").join(lk.predecessors(edges(s)), "category", "left").select("category", joined("successors").alias("successors"), joined("predecessors").alias("predecessors")))

query("g5_related", f"""WITH {EV}, {PAIRS}, c AS (SELECT DISTINCT category FROM ev) SELECT x.category AS a, y.category AS b, p.cause IS NOT NULL OR z.cause IS NOT NULL AS related, p.lo AS min_gap_sec, p.hi AS max_gap_sec, p.why_en
 FROM c x, c y LEFT JOIN pairs p ON p.cause = x.category AND p.effect = y.category LEFT JOIN pairs z ON z.cause = y.category AND z.effect = x.category""")(lambda s, d: related(s, d))


def related(s, d):
    c = events(s, d).groupBy(F.lit(0).alias("_")).agg(F.collect_set("category").alias("c"))  # the known categories
    pairs = c.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b"))
    return lk.pair_facts(pairs, edges(s)).select("a", "b", "related", C("min_gap_sec").cast("bigint").alias("min_gap_sec"), C("max_gap_sec").cast("bigint").alias("max_gap_sec"), "why_en")


# ------------------------------------------------------------------ rejected ----------------
REJ = f""", np AS (SELECT a.eid AS i, b.eid AS j, a.category AS ci, b.category AS cj, a.h3_cell AS hi_c, b.h3_cell AS hj_c, {D_IJ} AS dist, list_sort(list_concat(a.aids, b.aids)) AS aids
  FROM ep a JOIN cmp ca ON ca.eid = a.eid JOIN ep b ON a.eid < b.eid AND {D_IJ} <= 2 JOIN cmp cb ON cb.eid = b.eid WHERE ca.comp <> cb.comp),
ng AS (SELECT i, j, arg_min(y.t - x.t, (abs(y.t - x.t), x.t, x.event_id, y.t)) AS gap FROM np JOIN em x ON x.eid = i JOIN em y ON y.eid = j GROUP BY i, j),
nr AS (SELECT np.*, gap, coalesce(f.cause, w.cause) AS cause, coalesce(f.effect, w.effect) AS effect, CASE WHEN f.cause IS NOT NULL THEN gap ELSE -gap END AS g, coalesce(f.lo, w.lo) AS lo, coalesce(f.hi, w.hi) AS hi
  FROM np JOIN ng USING (i, j) LEFT JOIN pairs f ON f.cause = ci AND f.effect = cj LEFT JOIN pairs w ON w.cause = cj AND w.effect = ci WHERE abs(gap) <= 5400)"""
REJS = COMPS + REJ
_ren = """CASE WHEN cause IS NULL THEN ci || ' and ' || cj || ' overlapped in time and space but this category pair is not in the plausibility table'
 WHEN dist > 1 THEN cause || ' and ' || effect || ' fit the expected time gap but the areas are ' || dist || ' apart, not adjacent' WHEN g < lo THEN effect || ' showed up before ' || cause || ' would plausibly cause it'
 ELSE cause || ' and ' || effect || ' are more than ' || (hi // 60) || ' minutes apart, outside the usual window' END"""
_rhi = """CASE WHEN cause IS NULL THEN ci || ' और ' || cj || ' समय और स्थान में साथ थे लेकिन यह जोड़ी प्रशंसनीयता तालिका में नहीं है'
 WHEN dist > 1 THEN cause || ' और ' || effect || ' का समय अंतर ठीक है लेकिन क्षेत्र सटे हुए नहीं हैं (' || dist || ' दूर)' WHEN g < lo THEN effect || ', ' || cause || ' के असर में आने से पहले ही दिख गया'
 ELSE cause || ' और ' || effect || ' के बीच ' || (hi // 60) || ' मिनट से ज़्यादा का अंतर है' END"""
_rid = "'REJ-' || substr(sha1(array_to_string(aids, '|')), 1, 8)"
query("j12_closest_signed_gap", REJS + " SELECT i, j, gap FROM nr")(
    lambda s, d: (lambda l: lk.closest_gaps(lk.near_miss_pairs(l.episodes, l.components, P), l.seconds, P))(linked(s, d)))
query("j13_rejected_links", REJS + f" SELECT {_rid} AS rejected_id, abs(gap) AS gap_sec, dist AS grid_distance, array_to_string(list_sort(list_distinct([ci, cj])), ',') AS categories FROM nr")(
    lambda s, d: linked(s, d).rejected.select("rejected_id", "gap_sec", "grid_distance", joined("categories").alias("categories")))
query("t6_rejection_reason", REJS + f" SELECT {_rid} AS rejected_id, {_ren} AS reason_en, {_rhi} AS reason_hi FROM nr")(lambda s, d: linked(s, d).rejected.select("rejected_id", "reason_en", "reason_hi"))
query("t13_rejected_as_of", REJS + f", rv AS (SELECT {_rid} AS rejected_id, max(we) AS rev FROM (SELECT *, unnest(aids) AS aid FROM nr) z JOIN an ON anomaly_id = aid GROUP BY ALL) SELECT rejected_id, {ts('rev')} AS reveal_utc FROM rv WHERE rev <= {MID}")(
    lambda s, d: serve.rejected_as_of(linked(s, d).rejected, mid(s, d)).select("rejected_id", iso("reveal_utc").alias("reveal_utc")))

# ------------------------------------------------------------------ situations --------------
_ph = values("ph", "category, noun_en, noun_hi, start_en, start_hi, then_hi", v.CATEGORY_PHRASES)
_ef = values("ef", "category, effect_en, effect_hi", v.EFFECT_PHRASES)
SIT = f""", {MARKS}, mk AS (SELECT * FROM marks), {cells('mk', 'mkc')}, {_ph}, {_ef},
si AS (SELECT comp, size = 1 AS standalone, list_sort(flatten(list(aids))) AS aids, max(we) AS created FROM el9 JOIN cmp USING (comp) JOIN ep USING (eid) GROUP BY ALL),
sid AS (SELECT *, 'SIT-' || substr(sha1(array_to_string(aids, '|')), 1, 6) AS sit FROM si), sm AS (SELECT sit, pm.* FROM sid JOIN cmp USING (comp) JOIN pm USING (eid)),
c0 AS (SELECT sit, eid, h3_cell, category, aev, a_t, n, row_number() OVER (PARTITION BY sit ORDER BY a_t, h3_cell, eid) AS step FROM sid JOIN cmp USING (comp) JOIN re USING (eid)),
c1 AS (SELECT *, lag(a_t) OVER q AS pt, lag(h3_cell) OVER q AS pcell, lag(aev) OVER q AS pev FROM c0 WINDOW q AS (PARTITION BY sit ORDER BY step)),
chn AS (SELECT *, a_t - pt AS gap, {dist('pcell', 'h3_cell')} AS pd FROM c1)"""
SITS = ANCHS + ELIG + SIT
query("w8_chain_steps", SITS + f" SELECT sit AS situation_id, step, aev AS event_id, {ts('a_t')} AS t_utc, category, h3_cell FROM chn")(
    lambda s, d: linked(s, d).chain.select("situation_id", "step", "event_id", iso(F.timestamp_seconds("t")).alias("t_utc"), "category", "h3_cell"))
query("w9_consecutive_gaps", SITS + " SELECT sit AS situation_id, pev AS from_event_id, aev AS to_event_id, gap AS gap_sec FROM chn WHERE pev IS NOT NULL")(
    lambda s, d: linked(s, d).chain.filter("from_event_id is not null").select("situation_id", "from_event_id", C("event_id").alias("to_event_id"), "gap_sec"))
_m = "greatest(1, round_even(gap / 60.0, 0)::bigint)"
query("t1_chain_text", SITS + f""" SELECT sit AS situation_id, step, CASE WHEN pt IS NULL THEN start_en || CASE WHEN n > 1 THEN ' (' || n || ' reports)' ELSE '' END ELSE {_m} || ' minutes later, ' || lower(start_en[1]) || start_en[2:] || CASE pd WHEN 0 THEN ' at the same spot' WHEN 1 THEN ' one area away' ELSE ' a couple of areas away' END || CASE WHEN n > 1 THEN ', ' || n || ' reports' ELSE '' END END AS text_en,
 CASE WHEN pt IS NULL THEN start_hi || CASE WHEN n > 1 THEN ' (' || n || ' रिपोर्ट)' ELSE '' END ELSE {_m} || ' मिनट बाद, ' || CASE pd WHEN 0 THEN 'उसी जगह ' WHEN 1 THEN 'एक क्षेत्र दूर ' ELSE 'कुछ क्षेत्र दूर ' END || then_hi || CASE WHEN n > 1 THEN ', ' || n || ' रिपोर्ट' ELSE '' END END AS text_hi FROM chn JOIN ph USING (category)""")(
    lambda s, d: linked(s, d).chain.select("situation_id", "step", "text_en", "text_hi"))
ZON = f""", zn AS (SELECT sit, list_sort(list(DISTINCT h3_cell)) AS cl, arg_min(h3_cell, (-severity, eid, event_id)) AS lc, {rnd('sum(round(lat, 5)) / count(*)', 5)} AS lat, {rnd('sum(round(lon, 5)) / count(*)', 5)} AS lon FROM sm GROUP BY sit),
ct AS (SELECT h3_cell, {_clat} AS clat, {_clon} AS clon FROM (SELECT DISTINCT lc AS h3_cell FROM zn) z), nn AS (SELECT h3_cell, arg_min(pos, km) AS pos FROM (SELECT ct.h3_cell, m.pos, {hav('ct.clat', 'ct.clon', 'm.lat', 'm.lon')} AS km FROM ct, marks m) GROUP BY h3_cell),
zp AS (SELECT zn.sit, max({dist('x', 'y')}) AS maxd FROM zn, unnest(cl) a(x), unnest(cl) b(y) GROUP BY zn.sit),
zo AS (SELECT zn.*, maxd, len(cl) AS nc, CASE WHEN m.h3_cell = lc THEN name ELSE 'Near ' || name END || CASE WHEN len(cl) > 1 THEN ' + ' || (len(cl) - 1) || ' nearby area' || CASE WHEN len(cl) > 2 THEN 's' ELSE '' END ELSE '' END AS len_,
 CASE WHEN m.h3_cell = lc THEN name_hi ELSE name_hi || ' के पास' END || CASE WHEN len(cl) > 1 THEN ' + ' || (len(cl) - 1) || ' और क्षेत्र' ELSE '' END AS lhi FROM zn JOIN zp ON zp.sit = zn.sit JOIN nn ON nn.h3_cell = lc JOIN mkc m ON m.pos = nn.pos)"""
ZONS = SITS + ZON
query("a19_zone_roll_up", ZONS + " SELECT sit AS situation_id, array_to_string(cl, ',') AS h3_cells, len_ AS label_en, lhi AS label_hi, lat, lon FROM zo")(
    lambda s, d: linked(s, d).situations.select("situation_id", joined("h3_cells").alias("h3_cells"), "label_en", "label_hi", "lat", "lon"))
query("a20_max_grid_distance", ZONS + " SELECT sit AS situation_id, maxd AS max_grid_distance FROM zo")(lambda s, d: linked(s, d).situations.select("situation_id", "max_grid_distance"))
FACT = f""", fa AS (SELECT sit, max(severity) AS sev, sum(confidence) / count(*) AS conf, min(confidence) AS minc, list_sort(list(DISTINCT source)) AS src, bool_and(t_end IS NOT NULL) AS closed, count(*) AS n FROM sm GROUP BY sit),
mg AS (SELECT sit, coalesce(max(gap), 0) AS max_gap FROM chn GROUP BY sit),
st0 AS (SELECT sid.sit, standalone, created, fa.* EXCLUDE (sit), zo.* EXCLUDE (sit, lat, lon), zo.lat AS zlat, zo.lon AS zlon, max_gap, round_even((sev * 0.6::double + conf * 0.2::double + least(len(src), 3) / 3.0::double * 0.2::double) * 100, 0)::bigint AS pulse,
  CASE WHEN len(src) >= 3 AND maxd <= 1 AND max_gap <= 1800 THEN 2 WHEN minc < 0.5 OR maxd = 2 OR len(src) < 2 THEN 0 ELSE 1 END AS lv0 FROM sid JOIN fa ON fa.sit = sid.sit JOIN zo ON zo.sit = sid.sit JOIN mg ON mg.sit = sid.sit),
st AS (SELECT *, CASE WHEN pulse >= 75 THEN 'red' WHEN pulse >= 50 THEN 'orange' WHEN pulse >= 25 THEN 'yellow' ELSE 'green' END AS alert, CASE WHEN standalone THEN least(lv0, 1) ELSE lv0 END AS lv1, list_contains(src, 'weather_imd') AS bad FROM st0),
sx AS (SELECT *, ['low', 'med', 'high'][CASE WHEN bad THEN greatest(0, lv1 - 1) ELSE lv1 END + 1] AS level, CASE WHEN closed THEN 'closed' ELSE 'active' END AS status FROM st)"""
FACTS = ZONS + FACT
query("a18_pulse_score", FACTS + " SELECT sit AS situation_id, pulse AS pulse_score, alert AS alert_level FROM sx")(lambda s, d: linked(s, d).situations.select("situation_id", "pulse_score", "alert_level"))
_reason = """CASE WHEN bad THEN 'weather imd feed stale 25 min, confidence lowered' WHEN standalone AND lv0 = 2 THEN 'A single strong signal with no second report to corroborate it yet'
 WHEN lv0 = 2 THEN len(src) || ' separate feeds, all within one area, in the expected order' WHEN lv0 = 0 AND minc < 0.5 THEN 'At least one report is low-confidence on its own' WHEN lv0 = 0 AND maxd = 2 THEN 'The areas involved are close but not adjacent'
 WHEN lv0 = 0 THEN 'Only one feed reported this' WHEN len(src) >= 2 AND max_gap > 1800 THEN len(src) || ' feeds agree, but the reports are more than 30 minutes apart' ELSE len(src) || ' separate feeds agree on this' END"""
query("t3_confidence_level", FACTS + f" SELECT sit AS situation_id, level AS confidence_level, {_reason} AS reason_en FROM sx")(
    lambda s, d: linked(s, d).situations.select("situation_id", "confidence_level", C("confidence_reason_en").alias("reason_en")))
query("t5_status", FACTS + " SELECT sit AS situation_id, status, n AS n_members FROM sx")(lambda s, d: linked(s, d).situations.select("situation_id", "status", "n_members"))
query("t8_created_time", FACTS + f" SELECT sit AS situation_id, {ts('created')} AS created_utc FROM sx")(lambda s, d: linked(s, d).situations.select("situation_id", iso("created_utc").alias("created_utc")))
HEAD = """, ends AS (SELECT sit, arg_min(category, step) AS root, arg_max(category, step) AS lastc FROM chn GROUP BY sit),
hd9 AS (SELECT e.sit, root, lastc, regexp_replace(len_, '^Near ', '') AS z, regexp_replace(lhi, ' के पास$', '') AS zh, r.noun_en AS re_, r.noun_hi AS rh_, coalesce(ef.effect_en, 'is linked to ' || lower(l.noun_en)) AS ee, coalesce(ef.effect_hi, l.noun_hi || ' से जुड़ा है') AS eh
  FROM ends e JOIN zo USING (sit) JOIN ph r ON r.category = root JOIN ph l ON l.category = lastc LEFT JOIN ef ON ef.category = lastc)"""
query("t4_headline", FACTS + HEAD + " SELECT sit AS situation_id, CASE WHEN root = lastc THEN re_ || ' reported near ' || z ELSE re_ || ' near ' || z || ' ' || ee END AS headline_en, CASE WHEN root = lastc THEN zh || ' के पास ' || rh_ || ' की सूचना' ELSE zh || ' के पास ' || rh_ || ' ' || eh END AS headline_hi FROM hd9")(
    lambda s, d: linked(s, d).situations.select("situation_id", "headline_en", "headline_hi"))
USED = """, ub AS (SELECT sit, cause, effect, row_number() OVER (PARTITION BY sit ORDER BY score DESC, i, j) AS rn FROM el JOIN cmp ON cmp.eid = i JOIN sid USING (comp)),
up AS (SELECT c.sit, coalesce(ub.cause, c.category) AS cause, coalesce(ub.effect, (SELECT min(effect) FROM pairs p WHERE p.cause = c.category), c.category) AS effect FROM chn c LEFT JOIN ub ON ub.sit = c.sit AND rn = 1 WHERE step = 1)"""
_note = """CASE WHEN o >= 3 AND val >= 1.5 THEN CASE WHEN orate > 0 THEN 'These normally appear together about once every ' || round_even(1 / orate, 0)::bigint || ' hours here' ELSE 'These appear together more often than chance here' END
 WHEN o >= 3 THEN 'These appear together about as often as chance would predict here' ELSE 'Too few past cases here to say how unusual this combination is' END"""
_sp = """CASE WHEN nc <= 1 THEN 'All reports came from the same area' WHEN maxd <= 1 THEN 'All ' || nc || ' areas involved are adjacent to each other' WHEN maxd <= 2 THEN 'The ' || nc || ' areas involved are close but not adjacent' ELSE 'Reports span ' || nc || ' areas across the wider zone' END"""
query("t2_evidence", FACTS + USED + f" SELECT up.sit AS situation_id, up.cause || ',' || up.effect AS pair, val AS lift_value, {_note} AS lift_note, {_sp} AS note_en FROM up JOIN lift USING (cause, effect) JOIN zo ON zo.sit = up.sit")(
    lambda s, d: linked(s, d).situations.select("situation_id", joined("pair").alias("pair"), "lift_value", "lift_note", "note_en"))
query("t7_predicted_next", FACTS + HEAD + """, pn AS (SELECT sit, l.effect, l.lo, l.hi, l.o, row_number() OVER (PARTITION BY sit ORDER BY val DESC, l.effect) AS rn FROM ends JOIN lift l ON l.cause = lastc WHERE n_cause > 0 AND (sit, l.effect) NOT IN (SELECT (sit, category) FROM chn))
 SELECT sit AS situation_id, effect AS next_category, lo AS lag_from_sec, hi AS lag_to_sec, o || ' historical co-occurrences' AS based_on FROM pn WHERE rn = 1""")(
    lambda s, d: linked(s, d).situations.filter("next_category is not null").select("situation_id", "next_category", "lag_from_sec", "lag_to_sec", "based_on"))
query("c3_link", FACTS + " SELECT sit AS situation_id, status, pulse AS pulse_score, alert AS alert_level, level AS confidence_level, n AS n_members FROM sx")(lambda s, d: c3(s, d))


def c3(s, d):
    e = city.stage(canon(s, d), "canon")
    x = city.detect(e, p=P)
    return city.link(x.anomalies, x.history, x.detection, degraded=bad_feeds(s), p=P).situations.select("situation_id", "status", "pulse_score", "alert_level", "confidence_level", "n_members")


query("a15_documents", FACTS + " SELECT sit AS situation_id, len(list_distinct(list(event_id))) AS members, max(sx.pulse) AS pulse_score FROM sm JOIN sx USING (sit) GROUP BY sit")(
    lambda s, d: (lambda l: st.nest(l.situations, l.members, l.chain, 5))(linked(s, d)).groupBy("situation_id").agg(F.sum(F.size("member_event_ids")).alias("members"), F.first("pulse_score").alias("pulse_score")))

# ------------------------------------------------------------------ as of -------------------
query("t9_revealed_and_active_events", f"WITH {EV}, {CUT} SELECT event_id, t_end IS NULL OR t_end >= {MID} - 1800 AS active FROM ev WHERE t <= {MID}")(
    lambda s, d: (lambda e, t: serve.revealed_events(e, t).select("event_id").join(serve.active_events(e, t, P).select("event_id", F.lit(True).alias("a")), "event_id", "left").select("event_id", F.coalesce("a", F.lit(False)).alias("active")))(events(s, d), mid(s, d)))
query("t16_feed_delay", f"WITH {EV}, {CUT} SELECT event_id FROM ev WHERE t + CASE source WHEN 'power_discom' THEN 86400 ELSE 0 END <= {MID}")(
    lambda s, d: serve.delayed_events(events(s, d), mid(s, d), s.createDataFrame([("power_discom", 86400)], "feed string, delay_sec bigint")).select("event_id"))
query("t17_new_events", f"WITH {EV}, {CUT} SELECT event_id FROM ev WHERE t > {MID} - 7200 AND t <= {MID}")(lambda s, d: serve.new_events(events(s, d), mid(s, d) - 7200, mid(s, d)).select("event_id"))
query("j15_event_window_end", f"{DET} SELECT event_id, {ts('max(we)')} AS window_end_utc FROM an JOIN de ON an.h3_cell = de.h3_cell AND an.category = de.category AND t >= ws AND t < we GROUP BY event_id")(
    lambda s, d: (lambda x: serve.event_window_end(x.members, x.anomalies))(detected(s, d)).select("event_id", iso("window_end_utc").alias("window_end_utc")))
MIL = f""", wl AS (SELECT event_id, max(we) AS wend FROM an JOIN de ON an.h3_cell = de.h3_cell AND an.category = de.category AND t >= ws AND t < we GROUP BY event_id),
ms0 AS (SELECT sm.*, coalesce(wend, t) AS m FROM sm LEFT JOIN wl USING (event_id)), ms AS (SELECT *, row_number() OVER (PARTITION BY sit ORDER BY m, event_id) AS k FROM ms0),
rv AS (SELECT sx.sit, coalesce((SELECT m FROM ms WHERE ms.sit = sx.sit AND k = 2), created) AS rev FROM sx), tt AS (SELECT {MID} AS now),
pa AS (SELECT sit, count(*) AS total, count(*) FILTER (m <= now) AS known, max(severity) FILTER (m <= now) AS sev, avg(confidence) FILTER (m <= now) AS conf, count(DISTINCT source) FILTER (m <= now) AS ns,
  list_sort(list(DISTINCT category) FILTER (m <= now)) AS kc, count(DISTINCT category) AS nc FROM ms, tt GROUP BY sit),
pp AS (SELECT sx.sit, total, known, kc, pa.nc AS ncat, known < total AS part, level, CASE WHEN known < total THEN CASE WHEN known = 0 THEN 0 ELSE round_even((pa.sev * 0.6::double + pa.conf * 0.2::double + least(ns, 3) / 3.0::double * 0.2::double) * 100, 0)::bigint END ELSE pulse END AS pulse, status, cl, len_, created
  FROM sx JOIN rv USING (sit) JOIN pa USING (sit), tt WHERE rev <= now),
pq AS (SELECT * EXCLUDE (level), CASE WHEN part AND coalesce(len(kc), 0) / ncat < 0.5 AND level = 'high' THEN 'med' WHEN part AND coalesce(len(kc), 0) / ncat < 0.35 THEN 'low' ELSE level END AS level,
  CASE WHEN pulse >= 75 THEN 'red' WHEN pulse >= 50 THEN 'orange' WHEN pulse >= 25 THEN 'yellow' ELSE 'green' END AS alert FROM pp)"""
MILS = FACTS + MIL


def partials(s, d, t=None):
    a = asof(s, d)
    return serve.partial_situations(a.situations, a.milestones, a.reveals, mid(s, d) if t is None else t)


query("w10_milestones", MILS + f" SELECT sit AS situation_id, event_id, {ts('m')} AS milestone, k AS n FROM ms")(
    lambda s, d: serve.number_milestones(asof(s, d).milestones).select("situation_id", "event_id", iso("milestone").alias("milestone"), "n"))
query("w10_reveal_times", MILS + f" SELECT sit AS situation_id, {ts('rev')} AS reveal_utc FROM rv")(lambda s, d: asof(s, d).reveals.select("situation_id", iso("reveal_utc").alias("reveal_utc")))
query("t10_revealed_situations", MILS + " SELECT sit AS situation_id FROM pq")(lambda s, d: partials(s, d).select("situation_id"))
query("t11_partial_situations", MILS + " SELECT sit AS situation_id, part AS partial, known AS members_known, total AS partial_of, pulse AS pulse_score, alert AS alert_level, level AS confidence_level FROM pq")(
    lambda s, d: partials(s, d).select("situation_id", "partial", "members_known", "partial_of", "pulse_score", "alert_level", "confidence_level"))
# one hour after a situation shows, the partial ones are many: predictions at their reveal time
query("t12_partial_predictions", MILS + """, xr AS (SELECT ms.sit, category FROM ms JOIN rv USING (sit) WHERE m <= rev GROUP BY ALL), xn AS (SELECT ms.sit FROM ms JOIN rv USING (sit) GROUP BY ms.sit HAVING count(*) FILTER (m <= rev) < count(*)),
 xp AS (SELECT sit, effect, min(cause) AS trig FROM xr JOIN xn USING (sit) JOIN pairs ON cause = category WHERE (sit, effect) NOT IN (SELECT (sit, category) FROM xr) GROUP BY ALL),
 xo AS (SELECT *, row_number() OVER (PARTITION BY sit ORDER BY trig, effect) AS rk FROM xp) SELECT sit AS situation_id, rk AS rank, xo.effect AS category, trig AS trigger_category, why_en AS plausible_because_en FROM xo JOIN pairs p ON p.cause = trig AND p.effect = xo.effect WHERE rk <= 2""")(
    lambda s, d: predictions_at_reveal(s, d))


def predictions_at_reveal(s, d):
    a = asof(s, d)
    m = a.milestones.join(a.reveals, "situation_id")
    seen = C("milestone") <= C("reveal_utc")
    k = m.groupBy("situation_id").agg((F.count(F.when(seen, 1)) < F.count("*")).alias("partial"), F.array_compact(F.collect_set(F.when(seen, C("category")))).alias("known_categories"))
    return serve.partial_predictions(k, a.edges).select("situation_id", C("rank").cast("bigint").alias("rank"), "category", "trigger_category", "plausible_because_en")


STOP = ", stp AS (SELECT DISTINCT sit FROM sm WHERE source = 'power_discom')"
stopped = lambda s: s.createDataFrame([("power_discom",)], "feed string")
query("j16_stopped_feed_members", FACTS + STOP + " SELECT sit AS situation_id, 'power_discom' AS feeds FROM stp")(lambda s, d: serve.stopped_situations(asof(s, d).milestones, stopped(s)).select("situation_id", joined("stopped_feeds").alias("feeds")))
query("t15_stopped_feed_penalty", FACTS + STOP + """ SELECT sit AS situation_id, CASE WHEN hit THEN CASE WHEN level = 'high' THEN 'med' ELSE 'low' END ELSE level END AS confidence_level, p AS pulse_score,
 CASE WHEN p >= 75 THEN 'red' WHEN p >= 50 THEN 'orange' WHEN p >= 25 THEN 'yellow' ELSE 'green' END AS alert_level, CASE WHEN hit THEN 'power_discom feed stopped — confidence lowered' END AS reason
 FROM (SELECT *, sit IN (SELECT sit FROM stp) AS hit, CASE WHEN sit IN (SELECT sit FROM stp) THEN greatest(0, pulse - 5) ELSE pulse END AS p FROM sx) z""")(
    lambda s, d: serve.apply_stopped(linked(s, d).situations, asof(s, d).milestones, stopped(s), P).select(
        "situation_id", "confidence_level", "pulse_score", "alert_level", F.when(C("stopped_feeds").isNotNull(), C("confidence_reason_en")).alias("reason")))
_al = lambda p: f"CASE WHEN {p} >= 75 THEN 'red' WHEN {p} >= 50 THEN 'orange' WHEN {p} >= 25 THEN 'yellow' ELSE 'green' END"
query("a21_city_roll_up", MILS + f" SELECT coalesce(max(pulse), 0) AS pulse_score, {_al('coalesce(max(pulse), 0)')} AS alert_level FROM pq WHERE status = 'active'")(lambda s, d: serve.city_rollup(partials(s, d)))
query("a22_cell_roll_up", MILS + f" SELECT c AS h3_cell, max(pulse) AS pulse_score, {_al('max(pulse)')} AS alert_level FROM pq, unnest(cl) u(c) WHERE status = 'active' GROUP BY c")(lambda s, d: serve.cell_rollup(partials(s, d)))
query("a23_snapshot_counts", MILS + """ SELECT (SELECT count(*) FROM ev, tt WHERE t <= now AND (t_end IS NULL OR t_end >= now - 1800)) AS events_active, count(*) AS situations_active, (SELECT count(DISTINCT c) FROM pq, unnest(cl) u(c) WHERE status = 'active') AS cells_touched FROM pq WHERE status = 'active'""")(
    lambda s, d: serve.counts(events(s, d), partials(s, d), mid(s, d), P))
query("t17_situation_deltas", MILS + """ SELECT sit AS situation_id, 'created' AS action FROM rv, tt WHERE rev > now - 21600 AND rev <= now UNION ALL SELECT DISTINCT sit, 'updated' FROM ms JOIN rv USING (sit), tt WHERE rev <= now - 21600 AND m > now - 21600 AND m <= now""")(
    lambda s, d: serve.situation_deltas(asof(s, d).reveals, asof(s, d).milestones, mid(s, d) - 21600, mid(s, d)))
query("j14_member_expansion", FACTS + f" SELECT sit AS situation_id, event_id, row_number() OVER (PARTITION BY sit ORDER BY t, event_id) AS n FROM sm")(lambda s, d: serve.member_events(asof(s, d).milestones).select("situation_id", "event_id", "n"))
query("t19_situation_detail", FACTS + f" SELECT sit AS situation_id, {lit(v.FRAMING_EN)} AS framing_text, {lit(v.FRAMING_HI)} AS framing_text_hi FROM sx")(lambda s, d: serve.detail(linked(s, d).situations).select("situation_id", "framing_text", "framing_text_hi"))


@query("t18_snapshot", MILS + """, {HL} SELECT 'city' AS part, max(pulse)::varchar AS value FROM pq WHERE status = 'active' UNION ALL SELECT 'events', count(*)::varchar FROM ev, tt WHERE t <= now AND (t_end IS NULL OR t_end >= now - 1800)
 UNION ALL SELECT 'situations', count(*)::varchar FROM pq UNION ALL SELECT 'anomalies', count(*)::varchar FROM an, tt WHERE we <= now""".replace(", {HL}", ""))
def t18(s, d):
    x = asof(s, d).snapshot(mid(s, d))
    n = lambda k: x[k].agg(F.count("*").cast("string").alias("value")).select(F.lit(k).alias("part"), "value")
    return (x["city"].select(F.lit("city").alias("part"), C("pulse_score").cast("string").alias("value")).unionByName(n("events")).unionByName(n("situations")).unionByName(n("anomalies")))


_j = lambda k: F.get_json_object("data", f"$.{k}")
query("p28_situation_message", MILS + f""", dlt AS (SELECT sit, 'created' AS action FROM rv, tt WHERE rev > now - 21600 AND rev <= now UNION ALL SELECT DISTINCT sit, 'updated' FROM ms JOIN rv USING (sit), tt WHERE rev <= now - 21600 AND m > now - 21600 AND m <= now)
 SELECT 'situation' AS type, {ts('now')} AS sent_utc, action, sit AS situation_id, pulse AS pulse_score, alert AS alert_level, level AS confidence_level, part AS partial, known AS members_known, total AS partial_of FROM pq JOIN dlt USING (sit), tt""")(
    lambda s, d: serve.situation_message(partials(s, d), serve.situation_deltas(asof(s, d).reveals, asof(s, d).milestones, mid(s, d) - 21600, mid(s, d)), mid(s, d)).select(
        "type", "sent_utc", "action", _j("situation_id").alias("situation_id"), _j("pulse_score").cast("bigint").alias("pulse_score"), _j("alert_level").alias("alert_level"), _j("confidence_level").alias("confidence_level"),
        _j("partial").cast("boolean").alias("partial"), _j("members_known").cast("bigint").alias("members_known"), _j("partial_of").cast("bigint").alias("partial_of")))
query("p28_feedhealth_message", MILS + f""", {FEEDS}, la AS (SELECT source, max(t_recv) AS last, count(*) AS n FROM ev, tt WHERE t <= now GROUP BY source)
 SELECT 'feedhealth' AS type, {ts('now')} AS sent_utc, feed, CASE WHEN last IS NULL OR now - last > 3 * interval_sec THEN 'stale' ELSE 'live' END AS state, now - last AS age_sec, coalesce(n, 0) AS records_total, {ts('last')} AS last_record_utc FROM feeds LEFT JOIN la ON source = feed, tt""")(
    lambda s, d: serve.feedhealth_message(asof(s, d).snapshot(mid(s, d))["feed_health"], mid(s, d)).select(
        "type", "sent_utc", _j("feed").alias("feed"), _j("state").alias("state"), _j("age_sec").cast("bigint").alias("age_sec"), _j("records_total").cast("bigint").alias("records_total"), _j("last_record_utc").alias("last_record_utc")))
query("p28_tick_message", MILS + f""" SELECT 'tick' AS type, {ts('now')} AS sent_utc, {ts('now')} AS sim_time_utc, 7 AS tick, 2.0::double AS speed, (SELECT count(*) FROM ev, tt WHERE t <= now AND (t_end IS NULL OR t_end >= now - 1800)) AS events_active,
 (SELECT count(*) FROM pq WHERE status = 'active') AS situations_active, (SELECT coalesce(max(pulse), 0) FROM pq WHERE status = 'active') AS city_pulse_score FROM tt""")(lambda s, d: tick(s, d))


def tick(s, d):
    x = asof(s, d).snapshot(mid(s, d))
    m = serve.tick_message(x["counts"], x["city"], mid(s, d), 7, 2.0)
    return m.select("type", "sent_utc", _j("sim_time_utc").alias("sim_time_utc"), _j("tick").cast("int").alias("tick"), _j("speed").cast("double").alias("speed"), _j("events_active").cast("bigint").alias("events_active"),
                    _j("situations_active").cast("bigint").alias("situations_active"), _j("city_pulse_score").cast("bigint").alias("city_pulse_score"))


# stopped feeds: health reads killed, and members known by then lower their situations
_stk = MILS + f", stk AS (SELECT DISTINCT ms.sit FROM ms JOIN sm USING (sit, event_id), tt WHERE sm.source = 'power_discom' AND m <= now)"
query("t18_snapshot_stopped", _stk + f""" SELECT 'situation' AS part, pq.sit AS name, CASE WHEN stk.sit IS NULL THEN pulse ELSE greatest(0, pulse - 5) END::varchar AS value, CASE WHEN stk.sit IS NULL THEN level WHEN level = 'high' THEN 'med' ELSE 'low' END AS state FROM pq LEFT JOIN stk ON stk.sit = pq.sit
 UNION ALL SELECT 'feed', f.feed, (SELECT count(*) FROM ev, tt WHERE t <= now AND source = f.feed)::varchar, 'killed' FROM (SELECT 'power_discom' AS feed) f""")(lambda s, d: snapshot_stopped(s, d))


def snapshot_stopped(s, d):
    x = asof(s, d).snapshot(mid(s, d), stopped(s))
    f = x["feed_health"].filter("state = 'killed'").select(F.lit("feed").alias("part"), C("feed").alias("name"), C("records_total").cast("string").alias("value"), "state")
    return x["situations"].select(F.lit("situation").alias("part"), C("situation_id").alias("name"), C("pulse_score").cast("string").alias("value"), C("confidence_level").alias("state")).unionByName(f)


# a delayed feed: its events, the members they confirm and the situations they reveal are seen a day later
_late = MILS.replace("coalesce(wend, t) AS m FROM sm", "coalesce(wend, t) + CASE sm.source WHEN 'power_discom' THEN 86400 ELSE 0 END AS m FROM sm")
query("t18_snapshot_delayed", _late + """ SELECT 'situation' AS part, sit AS name, pulse::varchar AS value, known AS n FROM pq UNION ALL SELECT 'events', NULL, NULL, count(*) FROM ev, tt
 WHERE t + CASE source WHEN 'power_discom' THEN 86400 ELSE 0 END <= now AND (t_end IS NULL OR t_end >= now - 1800) UNION ALL SELECT 'feed', source, NULL, count(*) FROM ev, tt WHERE t + CASE source WHEN 'power_discom' THEN 86400 ELSE 0 END <= now GROUP BY source""")(
    lambda s, d: snapshot_delayed(s, d))


def snapshot_delayed(s, d):
    x = asof(s, d).snapshot(mid(s, d), delays=s.createDataFrame([("power_discom", 86400)], "feed string, delay_sec bigint"))
    none = F.lit(None).cast("string")
    sits = x["situations"].select(F.lit("situation").alias("part"), C("situation_id").alias("name"), C("pulse_score").cast("string").alias("value"), C("members_known").alias("n"))
    ev = x["events"].agg(F.count("*").alias("n")).select(F.lit("events").alias("part"), none.alias("name"), none.alias("value"), "n")
    return sits.unionByName(ev).unionByName(x["feed_health"].filter("records_total > 0").select(F.lit("feed").alias("part"), C("feed").alias("name"), none.alias("value"), C("records_total").alias("n")))


TICK = 300
_tk = f""", tk AS (SELECT i AS tick, cut + {TICK} * i AS now, cut + {TICK} * (i - 1) AS prev FROM cutt, range({LOOK // TICK + 60}) r(i)),
te AS (SELECT tick, count(*) FILTER (t_end IS NULL OR t_end >= now - 1800) AS active, count(*) FILTER (t > prev) AS fresh FROM tk JOIN ev ON t <= now GROUP BY tick),
tp AS (SELECT tick, now, ms.sit, count(*) AS total, count(*) FILTER (m <= now) AS known, max(severity) FILTER (m <= now) AS sev, avg(confidence) FILTER (m <= now) AS conf, count(DISTINCT source) FILTER (m <= now) AS ns,
  max(rev) AS rev, bool_or(rev <= prev AND m > prev AND m <= now) AS upd, max(prev) AS prev FROM tk JOIN rv ON rev <= now JOIN ms ON ms.sit = rv.sit GROUP BY tick, now, ms.sit),
tq AS (SELECT tp.*, status, cl, CASE WHEN known < total THEN CASE WHEN known = 0 THEN 0 ELSE round_even((tp.sev * 0.6::double + tp.conf * 0.2::double + least(ns, 3) / 3.0::double * 0.2::double) * 100, 0)::bigint END ELSE pulse END AS p FROM tp JOIN sx USING (sit)),
tr9 AS (SELECT tick, count(*) FILTER (status = 'active') AS sits, max(p) FILTER (status = 'active') AS p, count(*) FILTER (tq.rev > tq.prev) AS created, count(*) FILTER (upd) AS updated FROM tq GROUP BY tick),
tc AS (SELECT tick, count(DISTINCT c) AS cells FROM tq, unnest(cl) u(c) WHERE status = 'active' GROUP BY tick)"""
query("a21_tick_timeline", MILS + _tk + f""" SELECT tick, {ts('now')} AS sim_time_utc, coalesce(active, 0) AS events_active, coalesce(fresh, 0) AS events_new, coalesce(sits, 0) AS situations_active, coalesce(cells, 0) AS cells_touched,
 coalesce(created, 0) AS created, coalesce(updated, 0) AS updated, coalesce(p, 0) AS city_pulse_score, {_al('coalesce(p, 0)')} AS city_alert_level FROM tk LEFT JOIN te USING (tick) LEFT JOIN tr9 USING (tick) LEFT JOIN tc USING (tick)""")(
    lambda s, d: asof(s, d).timeline(detected(s, d).start, LOOK // TICK + 60, TICK).withColumn("sim_time_utc", iso("sim_time_utc")))
query("c4_as_of", MILS + " SELECT sit AS situation_id, pulse AS pulse_score, alert AS alert_level, level AS confidence_level, known AS members_known FROM pq")(
    lambda s, d: asof(s, d).snapshot(mid(s, d))["situations"].select("situation_id", "pulse_score", "alert_level", "confidence_level", "members_known"))

# ------------------------------------------------------------------ views -------------------
_c2f = values("c2f", "category, feed", [(c, f) for c, fs, *_ in v.CATEGORIES for f in sorted(fs)])
query("a28_feed_alerts", FACTS + f", {_c2f} SELECT feed, max(pulse) AS pulse_score, {_al('max(pulse)')} AS alert_level FROM sx JOIN (SELECT DISTINCT sit, feed FROM chn JOIN c2f USING (category)) z USING (sit) WHERE status = 'active' GROUP BY feed")(
    lambda s, d: serve.feed_alerts(linked(s, d).situations, linked(s, d).chain, dims.categories(s)).select("feed", "pulse_score", "alert_level"))
query("a29_distinct_feeds", FACTS + f", {_c2f}, one AS (SELECT category, min(feed) AS feed FROM c2f GROUP BY category HAVING count(*) = 1) SELECT sit AS situation_id, len(src) AS feeds_by_source, coalesce((SELECT count(DISTINCT feed) FROM chn JOIN one USING (category) WHERE chn.sit = sx.sit), 0) AS feeds_by_chain FROM sx")(
    lambda s, d: serve.distinct_feeds(linked(s, d).members, linked(s, d).chain, dims.categories(s)))
query("w14_primary_situation", FACTS + " SELECT sit AS situation_id, alert AS alert_level, pulse AS pulse_score FROM sx WHERE status = 'active' ORDER BY pulse // 25 DESC, pulse DESC, created DESC, sit LIMIT 1")(lambda s, d: serve.primary_situation(linked(s, d).situations))
query("w15_visible_list", FACTS + " SELECT sit AS situation_id, pulse AS pulse_score FROM sx")(lambda s, d: serve.visible(linked(s, d).situations).select("situation_id", "pulse_score"))


# reveal, then full view: the level of a situation can rise between the two
def updates(s, d):
    a = asof(s, d)
    m = a.milestones.join(a.reveals, "situation_id").filter(C("milestone") <= C("reveal_utc"))
    first = m.groupBy("situation_id").agg(F.max("severity").alias("sev"), F.avg("confidence").alias("conf"), F.size(F.collect_set("source")).alias("ns"))
    base = a.situations.join(first, "situation_id").join(a.reveals, "situation_id")
    c = base.select("situation_id", C("reveal_utc").alias("t"), F.lit(1).alias("seq"), F.lit("created").alias("action"), sv.alert_level(sv.pulse(C("sev"), C("conf"), C("ns"))).alias("alert_level"), "label_en", "status", "is_decoy")
    u = base.select("situation_id", C("created_utc").alias("t"), F.lit(2).alias("seq"), F.lit("updated").alias("action"), "alert_level", "label_en", "status", "is_decoy")
    return c.unionByName(u)


query("w13_alert_transitions", MILS + """, f1 AS (SELECT ms.sit, max(severity) AS sev, avg(confidence) AS conf, count(DISTINCT source) AS ns FROM ms JOIN rv USING (sit) WHERE m <= rev GROUP BY ms.sit),
 f2 AS (SELECT f1.sit, rev, created, status, round_even((f1.sev * 0.6::double + f1.conf * 0.2::double + least(ns, 3) / 3.0::double * 0.2::double) * 100, 0)::bigint // 25 AS l1, pulse // 25 AS l2 FROM f1 JOIN sx USING (sit) JOIN rv USING (sit)),
 f3 AS (SELECT sit, rev AS t, 1 AS seq, 'new' AS kind FROM f2 WHERE status <> 'closed' UNION ALL SELECT sit, created, 2, 'worse' FROM f2 WHERE status <> 'closed' AND least(l2, 3) > least(l1, 3))
 SELECT sit AS situation_id, kind FROM f3 ORDER BY t DESC, seq DESC, sit LIMIT 3""")(lambda s, d: serve.alert_transitions(updates(s, d)).select("situation_id", "kind"))
query("a27_feed_rates", f"""WITH {EV}, k AS (SELECT t_recv // 3600 AS tick, source, count(*) AS n FROM ev GROUP BY ALL), tot AS (SELECT tick, sum(n) AS total FROM k GROUP BY tick)
 SELECT tick, source, n, round((SELECT sum(total) FROM tot b WHERE b.tick BETWEEN k.tick - 9 AND k.tick) / least(10, tick - (SELECT min(tick) FROM k) + 1), 6) AS per_tick FROM k""")(
    lambda s, d: serve.feed_rates(events(s, d), 3600).select("tick", "source", "n", r6("per_tick").alias("per_tick")))
query("w12_latest_per_feed", f"WITH {EV}, {CUT}, k AS (SELECT source, event_id, row_number() OVER (PARTITION BY source ORDER BY t DESC, seq DESC) AS rank FROM ev WHERE t <= {MID}) SELECT * FROM k WHERE rank <= 50")(
    lambda s, d: serve.latest_records(events(s, d).withColumn("t_utc", C("start_utc")), "source", mid(s, d)).select("source", "event_id", C("rank").cast("bigint").alias("rank")))
from .feeds import COMPLAINTS, _PII  # noqa: E402

query("t20_raw_viewer", f"WITH c AS ({COMPLAINTS}), r AS (SELECT event_id, value FROM {{events}}), k AS (SELECT complaint_id, {_PII} AS items_masked, row_number() OVER (ORDER BY seq DESC) AS rank FROM c JOIN r ON event_id = seq) SELECT * FROM k WHERE rank <= 50")(
    lambda s, d: serve.raw_view(portable(s, d, COMPLAINTS).withColumn("t_utc", F.timestamp_seconds("seq")), "civic_complaints", None).select("complaint_id", "items_masked", C("rank").cast("bigint").alias("rank")))
# lineage: every power record against the outages it opened or falls inside
from .columns import power_records  # noqa: E402
from .feeds import OUT, PS, _PC  # noqa: E402

query("j18_record_lineage", f"""WITH {OUT}{_PC}, e AS (SELECT raw_ref || '' AS ref, pc.entity, pc.category, min(pc.t) AS s, max(pc.t_end) AS e FROM pc JOIN po ON po.seq = pc.seq GROUP BY ALL), ev2 AS (SELECT ref || '|' || category AS event_id, ref, 'power_discom:' || entity || '@' AS ent, s, coalesce(e, s + 3600) AS e FROM e),
 rec AS (SELECT seq, raw_ref, 'power_discom:' || feeder_id || '@' AS ent, t FROM pw),
 hit AS (SELECT seq, event_id, CASE WHEN ref = raw_ref THEN 0 WHEN starts_with(ref, raw_ref) OR starts_with(raw_ref, ref) THEN 1 WHEN t BETWEEN s AND e THEN 2 END AS kind FROM rec JOIN ev2 USING (ent)),
 best AS (SELECT seq, min(kind) AS kind FROM hit GROUP BY seq) SELECT DISTINCT seq AS record_id, event_id, kind FROM hit JOIN best USING (seq, kind)""")(lambda s, d: lineage(s, d))


def lineage(s, d):
    rec = city.stage(power_records(s, d), "records")
    ev = ig.fold(ig.build_events(ig.outage_candidates(ig.pair_outages(rec, PS)))).withColumn("event_id", F.concat_ws("|", "raw_ref", "category"))
    ev = city.stage(ev, "outages")
    r = rec.select(C("seq").alias("record_id"), "raw_ref", F.regexp_extract("raw_ref", "^[^@]*@", 0).alias("entity_ref"), times.epoch(C("t")).alias("t"))
    return serve.lineage(r, ev).select("record_id", "event_id", C("kind").cast("bigint").alias("kind")).distinct()


