"""Scoring, grids, terrain and water views."""
from pyspark.sql import functions as F


from cityweave.operators import raster as ra, score as sc, serve
from cityweave.params import Params

from . import situations as si
from .base import EV, P, joined, memo, portable, query, r6, rnd, values
from .situations import FACTS, SITS, detected, events, linked

C = F.col

# ------------------------------------------------------------------ planted truth -----------
# truths: the events of one (cell, 6-hour block) of the detection window; decoys: rows of one cell
TR = f"""tm AS (SELECT 'T-' || h3_cell || '-' || (t // 21600) AS truth_id, event_id FROM de), dm AS (SELECT 'D-' || category || '-' || (t // 86400) AS decoy_id, event_id FROM de WHERE severity < 0.3),
tp AS (SELECT truth_id, row_number() OVER (ORDER BY truth_id) - 1 AS pos, min(t) AS onset, min(t) + 14400 AS detect_by, CASE WHEN max(severity) > 0.9 THEN 'red' ELSE 'orange' END AS expected FROM tm JOIN de USING (event_id) GROUP BY truth_id)"""


def truth(s, d):
    e = detected(s, d).detection
    m = e.select(F.concat_ws("-", F.lit("T"), C("h3_cell").cast("string"), F.floor(C("t") / 21600).cast("string")).alias("truth_id"), "event_id", "t", "severity", "h3_cell")
    g = m.groupBy("truth_id", "h3_cell").agg(F.min("t").alias("o"), F.max("severity").alias("_s"))
    from cityweave.operators.scale import rank_in
    # order of the truths by id, as a chunked rank over cells
    t = rank_in(g.withColumn("_k", F.lit(0)), ["_k"], ["truth_id"], C("h3_cell"), "pos").select(
        "truth_id", (C("pos") - 1).alias("pos"), F.timestamp_seconds("o").alias("onset_utc"), F.timestamp_seconds(C("o") + 14400).alias("detect_by_utc"),
        F.when(C("_s") > 0.9, "red").otherwise("orange").alias("expected_alert_level"))
    decoys = e.filter("severity < 0.3").select(F.concat_ws("-", F.lit("D"), "category", F.floor(C("t") / 86400).cast("string")).alias("decoy_id"), "event_id")
    return t, m.select("truth_id", "event_id"), decoys


MIN_OVERLAP = 0.3


def scored(s, d, strict=False):
    from cityweave.plans import city
    t, tm, dm = truth(s, d)
    l = linked(s, d)
    return city.score(l.situations, l.members, t, tm, dm, P.but(strict_deadline=strict), MIN_OVERLAP)


# greedy in truth order, one truth after the other, carrying the list of used situations
GRE = f""", {TR}, ts_ AS (SELECT truth_id, count(*) AS size FROM tm GROUP BY truth_id), ov AS (SELECT pos, truth_id, sit, count(*) / any_value(size) AS o, any_value(created) AS created FROM tm JOIN sm USING (event_id) JOIN sid USING (sit) JOIN ts_ USING (truth_id) JOIN tp USING (truth_id) GROUP BY ALL),
ovl AS (SELECT pos, list((o, created, sit) ORDER BY o DESC, created, sit) AS opts FROM (SELECT pos, sit, o, created FROM ov) z GROUP BY pos),
walk(pos, used, pick, o) AS (SELECT -1::bigint, []::varchar[], NULL::varchar, 0.0::double UNION ALL
 SELECT w.pos + 1, CASE WHEN b.o >= {MIN_OVERLAP} THEN list_append(w.used, b.sit) ELSE w.used END, CASE WHEN b.o >= {MIN_OVERLAP} THEN b.sit END, coalesce(b.o, 0.0)::double
 FROM walk w LEFT JOIN LATERAL (SELECT ov.o, ov.sit FROM ov WHERE ov.pos = w.pos + 1 AND NOT list_contains(w.used, ov.sit) ORDER BY ov.o DESC, ov.created, ov.sit LIMIT 1) b ON true WHERE w.pos + 1 < (SELECT count(*) FROM tp)),
mt AS (SELECT tp.*, pick AS sit, o FROM tp JOIN walk USING (pos))"""
query("j17_truth_overlap", SITS + f", {TR}, ts_ AS (SELECT truth_id, count(*) AS size FROM tm GROUP BY truth_id) SELECT truth_id, sit AS situation_id, count(*) AS shared, round(count(*) / any_value(size), 6) AS overlap FROM tm JOIN sm USING (event_id) JOIN ts_ USING (truth_id) GROUP BY truth_id, sit")(
    lambda s, d: sc.overlaps(truth(s, d)[1], linked(s, d).members).select("truth_id", "situation_id", "shared", r6("overlap").alias("overlap")))


@query("j17_greedy_match", SITS + GRE + " SELECT truth_id, sit AS situation_id, round(o, 6) AS overlap FROM mt")
def j17(s, d):
    t, tm, _ = truth(s, d)
    l = linked(s, d)
    return sc.match(t, tm, l.situations, l.members, MIN_OVERLAP).select("truth_id", "situation_id", r6("overlap").alias("overlap"))


PT = f""", pt AS (SELECT truth_id, mt.sit, CASE WHEN mt.sit IS NULL THEN 'missed' WHEN created > detect_by THEN 'matched_late' ELSE 'matched' END AS status, expected, alert, CASE WHEN mt.sit IS NOT NULL THEN created - onset END AS lag, {rnd('o', 2)} AS overlap FROM mt LEFT JOIN sx ON sx.sit = mt.sit),
fp AS (SELECT count(*) AS n FROM sx WHERE sit NOT IN (SELECT sit FROM pt WHERE sit IS NOT NULL)), dc AS (SELECT decoy_id, bool_or(event_id IN (SELECT event_id FROM sm)) AS leak FROM dm GROUP BY decoy_id)"""


def card(hit, missed):
    return PT + f""", k AS (SELECT count(*) AS n, count(*) FILTER ({hit}) AS m, count(*) FILTER (status = 'matched_late' AND {hit}) AS ml, count(*) FILTER ({missed}) AS mi, count(*) FILTER ({hit} AND expected = alert) AS ok, list_sort(list(lag) FILTER (lag IS NOT NULL)) AS lags FROM pt),
 r AS (SELECT *, m / greatest(1, m + fp.n) AS pr, m / greatest(1, m + mi) AS rc, fp.n AS fpn FROM k, fp) SELECT r.n AS truth_situations, m + fpn AS detected_situations, m AS matched, ml AS matched_late, mi AS missed, fpn AS false_positives, (SELECT count(*) FROM dc) AS decoys_planted, (SELECT count(*) FROM dc WHERE NOT leak) AS decoys_correctly_ignored,
 {rnd('pr', 2)} AS precision, {rnd('rc', 2)} AS recall, {rnd('CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END', 2)} AS f1, {rnd('ok / greatest(1, m)', 2)} AS alert_level_accuracy, lags[len(lags) // 2 + 1] AS median_detection_lag_sec FROM r"""


_HIT = "status IN ('matched', 'matched_late')"
query("a26_scorecard", FACTS + GRE + card(_HIT, "status = 'missed'"))(lambda s, d: scored(s, d)["scorecard"])
query("a26_scorecard_strict_deadline", FACTS + GRE + card("status = 'matched'", "status <> 'matched'"))(lambda s, d: scored(s, d, True)["scorecard"])
query("c5_score", FACTS + GRE + PT + " SELECT truth_id, sit AS situation_id, status, lag AS detection_lag_sec, overlap AS member_overlap FROM pt")(lambda s, d: scored(s, d)["per_truth"].select("truth_id", "situation_id", "status", "detection_lag_sec", "member_overlap"))
query("a32_recall_by_category", SITS + f", {TR}, fl AS (SELECT DISTINCT event_id FROM em) SELECT truth_id, category, count(*) AS total, count(fl.event_id) AS flagged FROM tm JOIN de USING (event_id) LEFT JOIN fl ON fl.event_id = tm.event_id GROUP BY ALL")(
    lambda s, d: sc.recall_by_category(truth(s, d)[1], events(s, d), detected(s, d).members))
query("a32_link_coverage", SITS + f", {TR}, fl AS (SELECT DISTINCT event_id FROM em), k AS (SELECT truth_id, category, count(*) AS total, count(fl.event_id) AS flagged FROM tm JOIN de USING (event_id) LEFT JOIN fl ON fl.event_id = tm.event_id GROUP BY ALL) SELECT truth_id, sum(total)::bigint AS total, sum(flagged)::bigint AS flagged, count(*) AS links, count(*) FILTER (flagged > 0) AS links_covered FROM k GROUP BY truth_id")(
    lambda s, d: sc.link_coverage(sc.recall_by_category(truth(s, d)[1], events(s, d), detected(s, d).members)).drop("overlap"))
query("a33_decoy_status", SITS + f", {TR} SELECT decoy_id, count(x.event_id) AS leaked, CASE WHEN count(x.event_id) > 0 THEN 'decoy_alerted' ELSE 'decoy_ignored' END AS status FROM dm LEFT JOIN (SELECT DISTINCT event_id FROM sm) x USING (event_id) GROUP BY decoy_id")(
    lambda s, d: sc.decoy_status(truth(s, d)[2], linked(s, d).members))


@query("a33_decoy_leaks", SITS + GRE + " SELECT decoy_id, count(DISTINCT sm.event_id) AS leaked_any, count(DISTINCT sm.event_id) FILTER (sm.sit IN (SELECT sit FROM mt WHERE sit IS NOT NULL)) AS leaked_matched FROM dm LEFT JOIN sm USING (event_id) GROUP BY decoy_id")
def a33_(s, d):
    t, tm, dm = truth(s, d)
    l = linked(s, d)
    return sc.decoy_leaks(dm, l.members, sc.match(t, tm, l.situations, l.members, MIN_OVERLAP))


# ------------------------------------------------------------------ grids from lineitem -----
GRIDS = """SELECT l_suppkey AS row, cast(floor(l_quantity) as bigint) AS col, floor(max(l_extendedprice)) AS value FROM {lineitem} GROUP BY l_suppkey, floor(l_quantity)"""
FRAMES = """SELECT cast(l_linenumber - 1 as bigint) AS frame, l_suppkey AS row, cast(floor(l_quantity) as bigint) AS col, floor(max(l_discount * l_tax) * 128e1) / 128 AS value FROM {lineitem} GROUP BY l_linenumber, l_suppkey, floor(l_quantity)"""


def dem(s, d):
    return memo(s, d, "dem", lambda: si.city.stage(portable(s, d, GRIDS), "dem"))


def depth(s, d):
    return memo(s, d, "depth", lambda: si.city.stage(portable(s, d, FRAMES), "depth"))


G = f"g AS (SELECT * FROM ({GRIDS}) z)"
D = f"f AS (SELECT * FROM ({FRAMES}) z)"
BOX = "(SELECT min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1 FROM {}) bx"
query("a34_block_mean", f"WITH {G} SELECT (row - r0) // 2 AS brow, (col - c0) // 2 AS bcol, round(avg(value), 6) AS mean FROM g, {BOX.format('g')} WHERE row <= r0 + (r1 - r0 + 1) // 2 * 2 - 1 AND col <= c0 + (c1 - c0 + 1) // 2 * 2 - 1 GROUP BY ALL")(lambda s, d: ra.block_mean(dem(s, d), 2).select("brow", "bcol", r6("mean").alias("mean")))
query("a35_block_depth_series", f"""WITH {D}, b AS (SELECT frame, (row - r0) // 2 AS brow, (col - c0) // 2 AS bcol, avg(value) AS mean FROM f, {BOX.format('f')} WHERE row <= r0 + (r1 - r0 + 1) // 2 * 2 - 1 AND col <= c0 + (c1 - c0 + 1) // 2 * 2 - 1 GROUP BY ALL), nf AS (SELECT max(frame) + 1 AS n FROM f), k AS (SELECT DISTINCT brow, bcol FROM b WHERE mean >= 0.03),
 s AS (SELECT k.brow, k.bcol, i AS frame, coalesce(round_even(mean * 100, 0), 0)::bigint AS cm FROM k, nf, range(n) r(i) LEFT JOIN b ON b.brow = k.brow AND b.bcol = k.bcol AND b.frame = i)
 SELECT brow, bcol, coalesce(min(frame) FILTER (cm > 0), max(frame) + 1) AS "offset", coalesce(string_agg(cm::varchar, ',' ORDER BY frame) FILTER (frame >= coalesce((SELECT min(frame) FROM s x WHERE x.brow = s.brow AND x.bcol = s.bcol AND cm > 0), 99)), '') AS depth_cm, arg_max(frame, (cm, -frame)) AS peak_frame FROM s GROUP BY brow, bcol""")(
    lambda s, d: depth_series(s, d))


def depth_series(s, d):
    f = depth(s, d)
    n = f.agg(F.max("frame")).first()[0] + 1
    b = ra.block_mean(f, 2, keys=["frame"])
    return ra.depth_series(b, n, Params().display_from_m).select("brow", "bcol", "offset", joined("depth_cm").alias("depth_cm"), "peak_frame")


query("a36_frame_summary", f"WITH {D} SELECT frame, bool_or(value >= 0.02) AS wet, round(count(*) FILTER (value >= 0.02) * 1444 / 1e6, 6) AS wet_area_km2, round(max(value) * 100, 4) AS max_depth_cm, round(sum(value) * 1444, 3) AS volume_m3, coalesce(sum(row + col) FILTER (value >= 0.1), 0)::double AS people FROM f GROUP BY frame")(
    lambda s, d: ra.frame_summary(depth(s, d).withColumn("p", (C("row") + C("col")).cast("double")), 38.0, "p").select(
        "frame", "wet", r6("wet_area_km2").alias("wet_area_km2"), F.round("max_depth_cm", 4).alias("max_depth_cm"), F.round("volume_m3", 3).alias("volume_m3"), C("people_over_10cm").alias("people")))
query("a37_zonal_frames", f"WITH {D} SELECT row // 10 AS zone, frame, round(100.0 * count(*) FILTER (value >= 0.1) / count(*), 6) AS over10_pct, round(max(value) * 100, 4) AS max_depth_cm FROM f GROUP BY ALL")(
    lambda s, d: ra.zonal_frames(depth(s, d).withColumn("zone", F.floor(C("row") / 10)), "zone").select("zone", "frame", r6("over10_pct").alias("over10_pct"), F.round("max_depth_cm", 4).alias("max_depth_cm")))
query("a37_zonal_peaks", f"""WITH {D}, px AS (SELECT row // 10 AS zone, row, col, max(value) AS peak, arg_min(frame, (-value, frame)) AS a FROM f GROUP BY ALL)
 SELECT zone, round(max(peak) * 100, 4) AS peak_depth_cm, arg_min(a, (-peak, row, col)) AS peak_frame, round(100.0 * count(*) FILTER (peak >= 0.1) / count(*), 6) AS area_over_10cm_pct FROM px GROUP BY zone HAVING max(peak) >= 0.02""")(
    lambda s, d: ra.zonal_peaks(depth(s, d).withColumn("zone", F.floor(C("row") / 10)), "zone").select("zone", F.round("peak_depth_cm", 4).alias("peak_depth_cm"), "peak_frame", r6("area_over_10cm_pct").alias("area_over_10cm_pct")))
# gauges: nations as stations, orders of their customers as readings
GAUGE = "SELECT c_nationkey AS gauge, @EPOCH(o_orderdate) AS t, max(o_totalprice) / 1e4 AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderdate"
PROBE = "SELECT c_nationkey AS gauge, @EPOCH(o_orderdate) + 43200 - 864000 AS t FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderdate"
query("j19_gauge_as_of", f"WITH g AS ({GAUGE}), p AS ({PROBE}) SELECT p.gauge::bigint AS gauge, p.t, round(coalesce(g.value, 0), 6) AS rate FROM p ASOF LEFT JOIN g ON g.gauge = p.gauge AND g.t <= p.t")(
    lambda s, d: ra.gauge_as_of(portable(s, d, GAUGE), portable(s, d, PROBE), 86400 * 30).select(C("gauge").cast("bigint").alias("gauge"), "t", r6("rate").alias("rate")))
GF = "SELECT cast(l_linenumber - 1 as bigint) AS frame, cast(s_nationkey * 3 as double) AS grow, cast((s_nationkey * 7) % 50 as double) AS gcol, avg(l_extendedprice) / 1e4 AS rate FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_linenumber, s_nationkey"
query("a38_idw_interpolation", f"WITH {D}, gg AS ({GF}), w AS (SELECT f.frame, f.row, f.col, rate, 1.0::double / pow(greatest(sqrt(pow(f.row - grow, 2) + pow(f.col - gcol, 2)) * 38.0::double, 38.0::double), 2) AS w FROM f JOIN gg USING (frame)) SELECT frame, row, col, round(sum(w * rate) / sum(w), 6) AS value FROM w GROUP BY ALL")(
    lambda s, d: ra.interpolate(depth(s, d).select("frame", "row", "col"), portable(s, d, GF), 38.0).select("frame", "row", "col", r6("value").alias("value")))
query("a40_share_below", f"WITH {G} SELECT row, col, round(100.0 * (rank() OVER (ORDER BY value) - 1) / count(*) OVER (), 6) AS pct FROM g")(lambda s, d: ra.share_below(dem(s, d), "value", "pct").select("row", "col", r6("pct").alias("pct")))
query("a41_city_quantiles", f"WITH {G} SELECT q, round(v, 6) AS value FROM (SELECT unnest([0.1::double, 0.5::double, 0.9::double]) AS q, unnest(quantile_cont(value, [0.1, 0.5, 0.9])) AS v FROM g) z")(lambda s, d: ra.quantiles(dem(s, d), "value").select("q", r6("value").alias("value")))
_d8 = values("k8", "o, dr, dc", [(o, a, b) for o, (a, b) in enumerate(ra.D8)])
FLOW = f"""{G}, {_d8}, dd AS (SELECT a.row, a.col, b.row AS nr, b.col AS nc, o, (a.value - b.value) / CASE WHEN dr <> 0 AND dc <> 0 THEN 1.414::double ELSE 1.0::double END AS drop_ FROM g a, k8 JOIN g b ON b.row = a.row + dr AND b.col = a.col + dc),
fd AS (SELECT row, col, arg_max(nr, (drop_, -o)) AS drow, arg_max(nc, (drop_, -o)) AS dcol FROM dd WHERE drop_ > 0 GROUP BY row, col)"""
query("g6_flow_direction", f"WITH {FLOW} SELECT * FROM fd")(lambda s, d: ra.flow_direction(dem(s, d)))
query("g7_flow_accumulation", f"WITH RECURSIVE {FLOW}, up(row, col, src) AS (SELECT row, col, row * 1000 + col FROM g UNION ALL SELECT drow, dcol, src FROM up JOIN fd USING (row, col)) SELECT row, col, count(*) AS upstream FROM up GROUP BY row, col")(lambda s, d: ra.flow_accumulation(dem(s, d)))
import math  # noqa: E402

GAUSS = {(a, b): math.exp(-(a * a + b * b) / (2 * 1.5 ** 2)) for a in range(-3, 4) for b in range(-3, 4)}
_gk = values("gk", "dr, dc, w", [(a, b, w) for (a, b), w in GAUSS.items()])
# beyond the edges the nearest pixel is repeated
_near = f"""WITH {G}, {_gk}, w AS (SELECT a.row, a.col, w, least(greatest(a.row + dr, r0), r1) AS nr, least(greatest(a.col + dc, c0), c1) AS nc FROM g a, gk, {BOX.format('g')})
 SELECT w.row, w.col, round(sum(b.value * w) / sum(w), 4) AS focal FROM w JOIN g b ON b.row = nr AND b.col = nc GROUP BY ALL"""
query("g8_gaussian_focal", _near)(lambda s, d: ra.focal(dem(s, d), GAUSS, mode="nearest").select("row", "col", F.round("focal", 4).alias("focal")))
query("g8_focal_tiles", f"WITH {G}, {_gk} SELECT a.row, a.col, round(sum(b.value * w) / sum(w), 4) AS focal FROM g a, gk JOIN g b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL")(
    lambda s, d: ra.focal(dem(s, d), GAUSS, tile=32).select("row", "col", F.round("focal", 4).alias("focal")))
query("g8_focal_max", f"WITH {G} SELECT a.row, a.col, max(b.value) AS focal FROM g a JOIN g b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL")(
    lambda s, d: ra.focal(dem(s, d), ra.square(5), how="max"))
query("g8_disk_share", f"WITH {G} SELECT a.row, a.col, round(avg(b.value), 4) AS mean FROM g a JOIN g b ON sqrt((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) * 38.0 <= 250.0 GROUP BY ALL")(
    lambda s, d: ra.focal(dem(s, d), ra.disk(250.0, 38.0)).select("row", "col", F.round("focal", 4).alias("mean")))
from .situations import _ring  # noqa: E402

query("g8_ring_contrast", f"WITH {EV}, {_ring}, c AS (SELECT h3_cell, avg(severity) AS v FROM ev GROUP BY h3_cell) SELECT a.h3_cell, round(any_value(a.v) - avg(b.v), 6) AS contrast FROM c a JOIN rg ON k = 2 AND off <> 0 JOIN c b ON b.h3_cell = a.h3_cell + off GROUP BY a.h3_cell")(
    lambda s, d: ra.ring_contrast(events(s, d).groupBy("h3_cell").agg(F.avg("severity").alias("v")), "v").select("h3_cell", r6("contrast").alias("contrast")))
_terrain = f"""WITH RECURSIVE {FLOW}, {_ring}, up(row, col, src) AS (SELECT row, col, row * 1000 + col FROM g UNION ALL SELECT drow, dcol, src FROM up JOIN fd USING (row, col)), acc AS (SELECT row, col, count(*) AS upstream FROM up GROUP BY row, col),
 fm AS (SELECT a.row, a.col, max(b.upstream) AS flow FROM acc a JOIN acc b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL), pc AS (SELECT row, col, 100.0 * (rank() OVER (ORDER BY flow) - 1) / count(*) OVER () AS pct FROM fm),
 cl AS (SELECT row, col, value, (row // 5 + 1048576) * 2097152 + col // 10 + 1048576 AS h3_cell FROM g), fp AS (SELECT h3_cell, max(pct) AS flow_pct FROM cl JOIN pc USING (row, col) GROUP BY h3_cell), mz AS (SELECT h3_cell, avg(value) AS z FROM cl GROUP BY h3_cell),
 rc AS (SELECT a.h3_cell, any_value(a.z) - avg(b.z) AS rel FROM mz a JOIN rg ON k = 2 AND off <> 0 JOIN mz b ON b.h3_cell = a.h3_cell + off GROUP BY a.h3_cell) SELECT h3_cell, round(rel, 4) AS rel_m, round(flow_pct, 4) AS flow_pct FROM rc JOIN fp USING (h3_cell)"""
query("j20_terrain_facts", _terrain)(lambda s, d: ra.terrain_facts(
    dem(s, d).withColumn("h3_cell", (F.floor(C("row") / 5) + 1048576) * 2097152 + F.floor(C("col") / 10) + 1048576), "h3_cell").select(
    "h3_cell", F.round("rel_m", 4).alias("rel_m"), F.round("flow_pct", 4).alias("flow_pct")))
# named places: pixels on one row; pool: all pixels in (row, col) order
_hash = lambda a, b, n: f"(('0x' || substr(md5('42:' || {a} || ':' || {b}), 1, 15))::bigint % {n})"
query("a39_resampled_p_value", f"""WITH {G}, pl AS (SELECT row_number() OVER (ORDER BY row, col) - 1 AS pos, value, row FROM g), hot AS (SELECT avg(value) AS hot_mean, count(*) AS k FROM pl WHERE row = 7), n AS (SELECT count(*) AS n FROM pl),
 pi AS MATERIALIZED (SELECT i, {_hash('i', '-1', 'n')} AS pos FROM range(500) r(i), n), pool AS MATERIALIZED (SELECT i, value FROM pi JOIN pl USING (pos)),
 dj AS MATERIALIZED (SELECT draw, {_hash('draw', 'j', '500')} AS i FROM range(20000) r(draw), hot, range(60) q(j) WHERE j < k), dr AS (SELECT draw, avg(value) AS m FROM dj JOIN pool USING (i) GROUP BY draw)
 SELECT round(hot_mean, 4) AS hot_mean, round(avg(CASE WHEN m >= hot_mean THEN 1.0 ELSE 0.0 END), 6) AS p_value FROM dr, hot GROUP BY hot_mean""")(lambda s, d: resampled(s, d))


def places_of(s, d):
    from cityweave.operators.scale import rank_in
    return rank_in(dem(s, d).withColumn("_k", F.lit(0)), ["_k"], ["row", "col"], F.floor(C("row") / 16), "pos").withColumn("pos", C("pos") - 1)


def resampled(s, d):
    p = places_of(s, d)
    return ra.resample_p(p, "value", p.filter("row = 7")).select(F.round("hot_mean", 4).alias("hot_mean"), r6("p_value").alias("p_value"))


query("a39_place_against_city", f"WITH {G} SELECT row, col, round(value / (SELECT avg(value) FROM g), 6) AS vs_city FROM g WHERE row = 7")(
    lambda s, d: ra.against_city(dem(s, d).filter("row = 7"), "value", dem(s, d).agg(F.avg("value").alias("city"))).select("row", "col", r6("vs_city").alias("vs_city")))

# ------------------------------------------------------------------ terrain and water text --
TERR = f"""tc AS (SELECT h3_cell, round(avg(measure) % 7 - 3.5, 1) AS rel_m, count(*) % 100 AS flow_pct FROM ev GROUP BY h3_cell), nm AS (SELECT h3_cell, CASE WHEN h3_cell % 3 = 0 THEN 'Area ' || h3_cell END AS landmark FROM tc),
fs AS (SELECT DISTINCT sit FROM chn WHERE category IN ('weather.rain', 'complaint.waterlogging')), ar AS (SELECT sit, pos, h3_cell FROM (SELECT sit, unnest(cl) AS h3_cell, unnest(range(len(cl))) AS pos FROM zo JOIN fs USING (sit)) z)"""


def terrain(s, d):
    t = events(s, d).groupBy("h3_cell").agg(F.round(F.avg("measure") % 7 - 3.5, 1).alias("rel_m"), (F.count("*") % 100).alias("flow_pct"))
    return t, t.select("h3_cell", F.when(C("h3_cell") % 3 == 0, F.concat(F.lit("Area "), C("h3_cell").cast("string"))).alias("landmark"))


query("j20_terrain_context", FACTS + ", " + TERR + """, a1 AS (SELECT ar.*, rel_m, flow_pct, landmark, row_number() OVER (PARTITION BY sit, landmark IS NULL ORDER BY pos) AS k FROM ar JOIN tc USING (h3_cell) JOIN nm USING (h3_cell)),
 a2 AS (SELECT *, coalesce(landmark, CASE WHEN k = 1 THEN 'one area' ELSE 'another area' END) AS name, rel_m <= -2 AS low, flow_pct >= 60 AS dr, round(abs(rel_m), 0)::bigint AS m FROM a1),
 a3 AS (SELECT *, name || CASE WHEN low AND dr THEN ' sits ' || m || ' m below its surroundings on a drainage path' WHEN low THEN ' sits ' || m || ' m below its surroundings' WHEN dr THEN ' is on a drainage path (more runoff than ' || flow_pct || '% of the city)'
  WHEN rel_m >= 2 THEN ' sits ' || m || ' m above its surroundings' ELSE ' is level with its surroundings' END AS txt FROM a2)
 SELECT sit AS situation_id, count(*) AS areas, count(*) FILTER (low OR dr) AS supporting, CASE WHEN count(*) FILTER (low OR dr) = count(*) THEN 'Terrain supports this' WHEN count(*) FILTER (low OR dr) = 0
  THEN 'Terrain doesn''t explain this: blocked drains or local low spots are more likely' ELSE 'Terrain only partly explains this: local drainage likely matters' END || '. ' || string_agg(txt, '; ' ORDER BY pos) || '.' AS context FROM a3 GROUP BY sit""")(
    lambda s, d: serve.terrain_context(linked(s, d).situations, linked(s, d).chain, *terrain(s, d)))
query("j21_frame_lookup", f"WITH {EV}, {si.CUT} SELECT event_id, greatest(-1, least(99, (t - cut) // 300))::bigint AS frame FROM de, cutt")(
    lambda s, d: detected(s, d).detection.select("event_id", serve.frame_index(C("start_utc"), F.timestamp_seconds(F.lit(detected(s, d).start)), F.lit(100), 300).cast("bigint").alias("frame")))
query("j21_water_context", FACTS + ", " + TERR + """, wc AS (SELECT h3_cell, abs(rel_m) * 10 AS pct, flow_pct::double AS dep FROM tc WHERE rel_m < 1), w0 AS (SELECT ar.*, coalesce(pct, 0) AS pct, coalesce(dep, 0) AS dep, landmark FROM ar LEFT JOIN wc USING (h3_cell) LEFT JOIN nm USING (h3_cell)),
 w1 AS (SELECT *, row_number() OVER (PARTITION BY sit, landmark IS NULL ORDER BY pos) AS k FROM w0 WHERE pct >= 0.5), w2 AS (SELECT sit, string_agg(floor(pct + 0.5)::bigint || '% of ' || coalesce(landmark, CASE WHEN k = 1 THEN 'one area' ELSE 'another area' END), ' and ' ORDER BY pos) AS parts FROM w1 GROUP BY sit)
 SELECT w0.sit AS situation_id, CASE WHEN any_value(parts) IS NULL THEN 'Rain model at 7:30 pm: no water over 10 cm in these areas.' ELSE 'Rain model at 7:30 pm: water over 10 cm on ' || any_value(parts) || ' (deepest ' || floor(max(dep) + 0.5)::bigint || ' cm).' END AS context FROM w0 LEFT JOIN w2 ON w2.sit = w0.sit GROUP BY w0.sit""")(
    lambda s, d: (lambda t: serve.water_context(linked(s, d).situations, linked(s, d).chain, t[0].filter("rel_m < 1").select("h3_cell", (F.abs("rel_m") * 10).alias("over10_pct"), C("flow_pct").cast("double").alias("max_depth_cm")), t[1], F.lit("7:30 pm")))(terrain(s, d)))

