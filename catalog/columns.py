"""Scalar operators over whole tables."""
from pyspark.sql import functions as F

from cityweave import dims, vocabulary as v
from cityweave.functions import geo, hexgrid, ids, poisson, severity as sv, text as tx, times
from cityweave.operators import ingest as ig, places

from .base import (CATS, CANON, EV, GRID, INTERVAL, MARKS, ROWS, canon, cells, dist, duck, hav, iso, joined, lit, portable, q_of,
                   query, r6, r_of, rnd, rows, table, ts, values, when)

C = F.col
R = "WITH r AS (" + ROWS + ") "


def column(name, build, sql, extra=""):
    """A query of one or more expressions over the events as feed rows."""
    cols = build if isinstance(build, dict) else {"out": build}
    sqls = sql if isinstance(sql, dict) else {"out": sql}
    text = R + "SELECT event_id, " + ", ".join(f"{e} AS {k}" for k, e in sqls.items()) + f" FROM r {extra}"
    query(name, text)(lambda s, d: rows(s, d).select("event_id", *[x().alias(k) for k, x in cols.items()]))


OFF = 19800
naive = "epoch(strptime(naive_iso, '%Y-%m-%dT%H:%M:%S'))::bigint"
minute = "epoch(strptime(scada_time, '%d/%m/%Y %H:%M'))::bigint"
column("p1_epoch_to_utc", lambda: iso(times.from_epoch(C("t"))), ts("t"))
column("p2_iso_z_parse", lambda: times.epoch(times.from_iso_z(F.concat("naive_iso", F.lit("Z")))), naive)
column("p3_local_iso_to_utc", lambda: iso(times.from_local_iso(C("naive_iso"))), ts(f"{naive} - {OFF}"))
column("p4_register_time_to_utc", lambda: iso(times.from_complaint(C("register_time"))), ts(f"{minute} - {OFF}"))
column("p5_scada_time_to_utc", lambda: iso(times.from_scada(C("scada_time"))), ts(f"{minute} - {OFF}"))
column("p6_utc_iso_text", lambda: iso(F.timestamp_seconds("t")), ts("t"))
column("p7_local_hour", lambda: times.local_hour(F.timestamp_seconds("t")).cast("bigint"), f"((t + {OFF}) // 3600) % 24")
column("p8_record_references", {
    "weather": lambda: ids.ref_at_epoch("weather_imd", C("entity"), F.timestamp_seconds("t")),
    "air": lambda: ids.ref_verbatim("air_sensors", C("entity"), C("naive_iso")),
    "power": lambda: ids.ref_at_epoch("power_discom", C("entity"), times.from_local_iso(C("naive_iso"))),
    "drain": lambda: ids.ref_at_epoch("drain_scada", C("entity"), times.from_scada(C("scada_time"))),
    "complaint": lambda: ids.ref_record("civic_complaints", C("entity"))}, {
    "weather": "'weather_imd:' || entity || '@' || t", "air": "'air_sensors:' || entity || '@' || naive_iso",
    "power": f"'power_discom:' || entity || '@' || ({naive} - {OFF})", "drain": f"'drain_scada:' || entity || '@' || ({minute} - {OFF})",
    "complaint": "'civic_complaints:' || entity"})


@query("p9_record_identity", R + f"""SELECT event_id, CASE WHEN value < 5 THEN '' ELSE 'power_discom:' || entity || '@' || ({naive} - {OFF}) END AS raw_ref,
 CASE WHEN value < 5 THEN '' ELSE 'power_discom:' || entity || '@' END AS entity_ref, CASE WHEN value < 5 THEN NULL ELSE {ts(f'{naive} - {OFF}')} END AS t_utc FROM r""")
def p9(s, d):
    from cityweave.sources.readers import raw_identity
    x = rows(s, d).withColumn("feeder_id", C("entity")).withColumn("reported_time", F.when(C("value") < 5, "not a time").otherwise(C("naive_iso")))
    return raw_identity(x, "power_discom").select("event_id", "raw_ref", "entity_ref", "t_utc")


NS = v.EVENT_NAMESPACE.replace("-", "")
_h = f"sha1(unhex('{NS}') || encode(entity || '@' || t || '|' || event_type))"
_var = f"substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::int % 4 + 1, 1)"
query("p10_name_based_uuid", R + f"""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || {_var} || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS out
 FROM (SELECT event_id, {_h} AS h FROM r)""")(
    lambda s, d: rows(s, d).select("event_id", ids.event_id(F.concat("entity", F.lit("@"), C("t").cast("string")), C("event_type")).alias("out")))
column("p11_short_ids", {
    "anomaly": lambda: ids.short_id("ANOM-", 8, C("entity"), C("event_type"), iso(F.timestamp_seconds("t"))),
    "situation": lambda: ids.set_id("SIT-", 6, F.array("entity", "event_type", "naive_iso"))}, {
    "anomaly": f"'ANOM-' || substr(sha1(entity || '|' || event_type || '|' || {ts('t')}), 1, 8)",
    "situation": "'SIT-' || substr(sha1(array_to_string(list_sort([entity, event_type, naive_iso]), '|')), 1, 6)"})


def ramp(cat, m):
    lo, hi = next((a, b) for c, _, a, b in v.CATEGORIES if c == cat)
    return f"CASE WHEN {m} <= {lo}::double THEN 0.0 ELSE {rnd(f'least(1.0, ({m} - {lo}::double) / {hi - lo}::double)', 4)} END"


column("p12_severity_ramp", {
    "rain": lambda: sv.severity(F.lit("weather.rain"), C("value")), "air": lambda: sv.severity(F.lit("air.pm25"), C("value")),
    "complaint": lambda: sv.severity(F.lit("complaint.smoke"), C("value")), "outage": lambda: sv.severity(F.lit("power.outage"), C("value") * 20)}, {
    "rain": ramp("weather.rain", "value"), "air": ramp("air.pm25", "value"), "complaint": ramp("complaint.smoke", "value"), "outage": ramp("power.outage", "value * 20")})
column("p13_severity_cap", lambda: sv.severity(F.lit("power.outage"), C("value") * 20, F.when(C("event_type") == "error", v.SCHEDULED_CUT_CAP)),
       f"CASE WHEN event_type = 'error' THEN least(0.4::double, {ramp('power.outage', 'value * 20')}) ELSE {ramp('power.outage', 'value * 20')} END")
column("p14_confidence", lambda: sv.confidence(
    F.when(C("event_type") == "view", v.CONF_CALIBRATED).when(C("event_type") == "click", v.CONF_RESIDENT).otherwise(v.CONF_UNCALIBRATED),
    F.when(C("event_type") == "view", v.MULT_REGISTRY).when(C("event_type") == "click", v.MULT_LANDMARK).otherwise(v.MULT_DIRECT),
    F.when(C("value") < 15, v.MULT_LOW_BATTERY).otherwise(1.0)),
    "greatest(0.3::double, CASE WHEN value < 15 THEN CASE event_type WHEN 'view' THEN 0.36::double WHEN 'click' THEN 0.3::double ELSE 0.3::double END"
    " ELSE CASE event_type WHEN 'view' THEN 0.72::double WHEN 'click' THEN 0.6::double ELSE 0.6::double END END)")
column("p15_received_at", {
    "modelled": lambda: iso(sv.received_at(F.timestamp_seconds("t"), F.lit(300))),
    "observed": lambda: iso(sv.received_at(F.timestamp_seconds("t"), F.lit(300), F.when(C("value") >= 10, F.timestamp_seconds(C("t") + C("whole") - 20))))}, {
    "modelled": ts("t + 300"), "observed": ts("CASE WHEN value >= 10 THEN greatest(t, t + whole - 20) ELSE t + 300 END")})
column("p16_freshness", lambda: sv.freshness(F.timestamp_seconds(C("t") + C("whole") - 20), F.timestamp_seconds("t")).cast("bigint"), "greatest(0, whole - 20)")
_t, _h2 = "(value * 9 / 5 + 32)", "(60.0::double)"
c_ = v.ROTHFUSZ
_hi = " + ".join(f"({k!r}::double){m}" for k, m in zip(c_, [
    "", f" * {_t}", f" * {_h2}", f" * {_t} * {_h2}", f" * {_t} * {_t}", f" * {_h2} * {_h2}", f" * {_t} * {_t} * {_h2}", f" * {_t} * {_h2} * {_h2}", f" * {_t} * {_t} * {_h2} * {_h2}"]))
column("p17_heat_index", lambda: r6(sv.heat_index(C("value"), F.lit(60.0))), f"round(CASE WHEN {_t} < 80 THEN value ELSE ({_hi} - 32) * 5 / 9 END, 6)")

_types = values("types", "k, category", v.COMPLAINT_TYPES)
TYPE_TEXT = """SELECT event_id, CASE event_type WHEN 'click' THEN '  Water   Logging ' WHEN 'view' THEN 'GARBAGE burning' WHEN 'error' THEN 'Street  Light'
 WHEN 'signup' THEN 'Signal Not Working  ' ELSE CASE WHEN value < 2e1 THEN 'Other' WHEN value < 4e1 THEN '' ELSE 'Potholes' END END AS raw_type FROM {events}"""
query("p18_complaint_type", f"WITH {_types}, x AS ({TYPE_TEXT}) SELECT event_id, folded, category FROM (SELECT event_id, trim(regexp_replace(lower(raw_type), '\\s+', ' ', 'g')) AS folded FROM x) LEFT JOIN types ON folded = k")(
    lambda s, d: portable(s, d, TYPE_TEXT).select("event_id", tx.fold_space(C("raw_type")).alias("folded"), tx.complaint_category(C("raw_type")).alias("category")))

CH = lambda: F.when(C("value") < 5, F.array(F.struct(F.lit("BATT_V").alias("tag"), C("value").alias("v")))).otherwise(
    F.array(F.struct(F.lit("LVL_CM").alias("tag"), F.when(C("value") < 10, -999.0).otherwise(C("value")).alias("v")),
            F.struct(F.lit("BATT_V").alias("tag"), (C("value") / 10 + 8).alias("v"))))
_lvl = "CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN -999.0 ELSE value END"
query("p19_tagged_channel", R + f"SELECT event_id, {_lvl} AS level, CASE WHEN value < 5 THEN value ELSE value / 10 + 8 END AS volts FROM r")(
    lambda s, d: rows(s, d).withColumn("ch", CH()).select("event_id", tx.channel(C("ch"), "LVL_CM").alias("level"), tx.channel(C("ch"), "BATT_V").alias("volts")))
column("p20_percent_of_capacity", lambda: ig.percent_of_capacity(C("value"), F.lit(128.0)), rnd("value / 128.0::double * 100.0", 1))
query("p21_fault_readings", R + f"SELECT event_id, (lvl IS NULL OR lvl = -999.0) AS drain_fault, (value < 3) AS air_fault FROM (SELECT *, {_lvl} AS lvl FROM r)")(
    lambda s, d: (lambda x: x.select("event_id", C("drain").alias("drain_fault"), C("air").alias("air_fault")))(
        rows(s, d).withColumn("ch", CH()).withColumn("l", tx.channel(C("ch"), "LVL_CM")).withColumn("drain", C("l").isNull() | (C("l") == v.LEVEL_FAULT))
        .withColumn("pm", F.when(C("value") < 1.5, F.lit(None)).when(C("value") < 3, -1.0).otherwise(C("value")))
        .withColumn("air", C("pm").isNull() | (C("pm") == v.PM_FAULT))))
AIR_SQL = """SELECT event_id, 'A-' || cast(user_id as string) AS sensor, event_id AS seq, value, naive_iso, lat, lon, t, entity FROM (""" + ROWS + ") z"
query("p22_low_battery", R + "SELECT event_id, CASE WHEN whole < 15 THEN 0.3::double ELSE 0.6::double END AS confidence FROM r")(
    lambda s, d: ig.air_readings(rows(s, d).select(
        C("event_id").alias("seq"), C("entity").alias("sensor"), F.concat("naive_iso", F.lit("Z")).alias("captured"), C("value").alias("pm25"),
        F.struct(C("lat").alias("latitude"), C("lon").alias("longitude")).alias("loc"), F.lit(False).alias("calibrated"), C("whole").cast("int").alias("battery_pct")))
    .select(C("seq").alias("event_id"), "confidence"))


def weather_feed(s, d):
    return rows(s, d).select(C("event_id").alias("seq"), C("entity").alias("station_id"), C("t").alias("ts"), "lat", "lon",
                             F.when(C("value") >= 2, C("value") * 0.2).alias("rain_mm_15min"), (C("value") * 0.2 + 22).alias("temp_c"), F.lit(60).alias("rh_pct"))


_tt = "((value * 0.2::double + 22) * 9 / 5 + 32)"
_heat = "CASE WHEN " + _tt + " < 80 THEN value * 0.2::double + 22 ELSE (" + _hi.replace(_t, _tt) + " - 32) * 5 / 9 END"
WEATHER = f"""SELECT event_id AS seq, entity, 'weather.rain' AS category, CASE WHEN value >= 2 THEN value * 0.2::double ELSE 0.0 END AS measure, t, lat, lon FROM r
 UNION ALL SELECT event_id, entity, 'weather.heat', {_heat}, t, lat, lon FROM r"""
query("p23_unpivot_measures", R + f"SELECT seq, category, round(measure, 6) AS measure FROM ({WEATHER})")(
    lambda s, d: ig.weather_measures(weather_feed(s, d)).select("seq", "category", r6("measure").alias("measure")))

# orders as power records, customers outside one segment as the feeder registry
POWER_SQL = """SELECT o_orderkey AS seq, 'F-' || cast(o_custkey as string) AS feeder_id,
 CASE o_orderstatus WHEN 'F' THEN 'RESTORE' WHEN 'P' THEN 'SCHEDULED_CUT' ELSE 'TRIP' END AS event, @EPOCH(o_orderdate) AS t_local,
 cast(floor(o_totalprice / 100) as int) AS affected_connections, substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AS carries_signals,
 cast(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 0 END as int) AS signal_junctions FROM {orders}"""
REG_SQL = """SELECT 'F-' || cast(c_custkey as string) AS id, 268e-1 + (c_custkey % 25) * 4e-3 AS lat, 757e-1 + (c_nationkey % 20) * 5e-3 AS lon,
 cast(c_nationkey % 4 as int) AS signal_junctions FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"""


def power_feed(s, d):
    return portable(s, d, POWER_SQL).withColumn("reported_time", F.date_format(F.timestamp_seconds("t_local"), "yyyy-MM-dd'T'HH:mm:ss")).drop("t_local")


def power_records(s, d):
    return ig.power_records(power_feed(s, d), portable(s, d, REG_SQL))


POWER = ("pw0 AS (" + duck(POWER_SQL) + "), reg0 AS (" + duck(REG_SQL) + "), " + cells("reg0", "reg") + f""",
pw AS (SELECT p.*, t_local - {OFF} AS t, r.id IS NOT NULL AS resolved, r.lat, r.lon, r.h3_cell, event = 'RESTORE' AS is_restore,
  CASE WHEN event <> 'RESTORE' AND affected_connections >= 200 THEN affected_connections::double END AS m_out,
  CASE WHEN event <> 'RESTORE' AND carries_signals THEN coalesce(nullif(p.signal_junctions, 0), nullif(r.signal_junctions, 0), 1)::double END AS m_sig,
  CASE WHEN event = 'SCHEDULED_CUT' THEN 0.4::double END AS cap, 'power_discom:' || feeder_id || '@' || (t_local - {OFF}) AS raw_ref
  FROM pw0 p LEFT JOIN reg r ON r.id = p.feeder_id)""")
query("p24_record_fan_out", f"WITH {POWER} SELECT seq, category, measure FROM (SELECT seq, 'power.outage' AS category, m_out AS measure FROM pw WHERE resolved UNION ALL SELECT seq, 'traffic.signal_down', m_sig FROM pw WHERE resolved) WHERE measure IS NOT NULL")(
    lambda s, d: power_records(s, d).filter("resolved").select("seq", F.explode("emits").alias("e")).select("seq", "e.category", "e.measure"))
query("p25_first_truthy_measure", f"WITH {POWER} SELECT seq, m_sig AS junctions FROM pw WHERE resolved AND m_sig IS NOT NULL")(
    lambda s, d: power_records(s, d).filter("resolved").select("seq", F.explode("emits").alias("e")).filter("e.category = 'traffic.signal_down'").select("seq", C("e.measure").alias("junctions")))

_EVSEL = ("event_id, source, category, h3_cell, round(lat, 5) AS lat, round(lon, 5) AS lon, {s} AS start_utc, {e} AS end_utc, severity, confidence, {r} AS received_at, t_recv - t AS freshness_sec, raw_ref, "
          "@M AS measure").format(s=ts("t"), e=ts("t_end"), r=ts("t_recv")).replace("@M", rnd("measure", 3))


@query("p26_canonical_event", f"WITH {EV} SELECT seq, {_EVSEL.replace('event_id, ', '')} FROM ev")
def p26(s, d):
    x = ig.build_events(canon(s, d).select("source", "category", "raw_ref", "start_utc", "end_utc", "lat", "lon", "h3_cell", "measure", "confidence", "resolution", "seq"))
    return x.select("seq", "source", "category", "h3_cell", "lat", "lon", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc"), "severity", "confidence",
                    iso("received_at").alias("received_at"), C("freshness_sec").cast("bigint").alias("freshness_sec"), "raw_ref", "measure")


column("p27_alert_level", {"level": lambda: sv.alert_level(C("whole")), "capped": lambda: sv.alert_level(C("whole"), C("event_type") == "error")}, {
    "level": "CASE WHEN whole >= 75 THEN 'red' WHEN whole >= 50 THEN 'orange' WHEN whole >= 25 THEN 'yellow' ELSE 'green' END",
    "capped": "CASE WHEN event_type = 'error' AND whole >= 50 THEN 'yellow' WHEN whole >= 75 THEN 'red' WHEN whole >= 50 THEN 'orange' WHEN whole >= 25 THEN 'yellow' ELSE 'green' END"})


query("p9_complaint_identity", R + "SELECT event_id, 'civic_complaints:C-' || event_id AS raw_ref, '' AS entity_ref, NULL::varchar AS t_utc FROM r")(lambda s, d: complaint_identity(s, d))


def complaint_identity(s, d):
    from cityweave.sources.readers import raw_identity
    x = rows(s, d).withColumn("complaint_id", F.concat(F.lit("C-"), C("event_id").cast("string")))
    return raw_identity(x, "civic_complaints").select("event_id", "raw_ref", "entity_ref", "t_utc")


@query("p28_event_message", f"WITH {EV} SELECT event_id, 'event' AS type, '2024-01-15T00:00:00Z' AS sent_utc, category, {ts('t')} AS start_utc, severity, t_recv - t AS freshness_sec, true AS has_end_key FROM ev")
def p28(s, d):
    from cityweave.operators import serve
    m = serve.event_message(canon(s, d), "2024-01-15T00:00:00Z")
    j = lambda k: F.get_json_object("data", f"$.{k}")
    return m.select("event_id", "type", "sent_utc", j("category").alias("category"), j("start_utc").alias("start_utc"), j("severity").cast("double").alias("severity"),
                    j("freshness_sec").cast("bigint").alias("freshness_sec"), F.contains("data", F.lit('"end_utc":')).alias("has_end_key"))


@query("p29_duplicate_message", f"WITH {EV} SELECT event_id, '2024-01-20T12:00:00Z' AS received_at, true AS is_duplicate FROM ev")
def p29(s, d):
    from cityweave.operators import serve
    return serve.duplicate_message(canon(s, d), "2024-01-20T12:00:00Z").select("event_id", iso("received_at").alias("received_at"), "is_duplicate")


_pl = lambda n, w: f"({n})::varchar || ' {w}' || CASE WHEN ({n}) = 1 THEN '' ELSE 's' END"
_mins = "floor(sec / 60 + 0.5)::bigint"
_dur = (f"CASE WHEN sec < 60 THEN 'less than a minute' WHEN {_mins} < 60 THEN {_pl(_mins, 'minute')} WHEN {_mins} % 60 = 0 THEN {_pl(_mins + ' // 60', 'hour')}"
        f" ELSE {_pl(_mins + ' // 60', 'hour')} || ' ' || {_pl(_mins + ' % 60', 'minute')} END")
query("p30_time_wording", R + f"""SELECT event_id, {_dur} AS duration, CASE WHEN sec < 5 THEN 'just now' WHEN sec < 60 THEN {_pl('sec', 'second')} || ' ago' ELSE {_dur} || ' ago' END AS ago,
 ((hl + 11) % 12 + 1)::varchar || ':' || lpad((((t + {OFF}) // 60) % 60)::varchar, 2, '0') || CASE WHEN hl < 12 THEN ' am' ELSE ' pm' END AS clock
 FROM (SELECT *, ((t + {OFF}) // 3600) % 24 AS hl, (floor(value) * floor(value))::bigint AS sec FROM r)""")(
    lambda s, d: rows(s, d).withColumn("sec", C("whole") * C("whole")).select(
        "event_id", times.duration_text(C("sec")).alias("duration"), times.time_ago(F.timestamp_seconds("t"), F.timestamp_seconds(C("t") + C("sec"))).alias("ago"),
        times.local_clock(F.timestamp_seconds("t")).alias("clock")))
_lab = values("lab", "category, label_en, label_hi", v.CATEGORY_LABELS)
_act = values("act", "category, action_en, action_hi", v.ACTIONS)
_fl = values("fl", "source, feed_en, feed_hi", [(f[0], f[4], f[5]) for f in v.FEEDS])
query("p31_labels_and_actions", f"WITH {EV}, {_lab}, {_act}, {_fl} SELECT event_id, label_en, label_hi, action_en, action_hi, feed_en, feed_hi FROM ev JOIN lab USING (category) JOIN act USING (category) JOIN fl USING (source)")(
    lambda s, d: canon(s, d).join(dims.labels(s), "category").join(dims.feeds(s).select(C("feed").alias("source"), "feed_en", "feed_hi"), "source")
    .select("event_id", "label_en", "label_hi", "action_en", "action_hi", "feed_en", "feed_hi"))

# ------------------------------------------------------------------ X: functions ------------
_near = "268e-1 + (event_id % 97) * 2e-3"
GEO = """SELECT event_id, 268e-1 + (event_id % 211) * 11e-4 AS lat, 757e-1 + (user_id % 97) * 23e-4 AS lon FROM {events}"""
geo_rows = lambda s, d: portable(s, d, GEO)
query("x5_haversine", f"WITH g AS ({GEO}) SELECT event_id, round({hav('lat', 'lon', '26.9124::double', '75.7873::double')}, 6) AS km FROM g")(
    lambda s, d: geo_rows(s, d).select("event_id", r6(hexgrid.haversine_km(C("lat"), C("lon"), F.lit(26.9124), F.lit(75.7873))).alias("km")))
_kx, _ky, _e = GRID._kx, GRID._ky, GRID.edge_m
_clat = f"({GRID.lat0}::double + {r_of('h3_cell')} * {1.5 * _e / _ky!r}::double)"
_clon = f"({GRID.lon0}::double + ({q_of('h3_cell')} + {r_of('h3_cell')} / 2.0::double) * {3 ** 0.5 * _e / _kx!r}::double)"
query("x6_hex_cells", f"WITH g AS ({GEO}), {cells('g', 'gc')} SELECT event_id, h3_cell, round({_clat}, 6) AS clat, round({_clon}, 6) AS clon, {hav('lat', 'lon', _clat, _clon)} * 1000 <= 532 AS within_edge, 7 AS ring_points FROM gc")(
    lambda s, d: geo_rows(s, d).withColumn("h3_cell", GRID.cell(C("lat"), C("lon"))).select(
        "event_id", "h3_cell", r6(GRID.centroid(C("h3_cell"))[0]).alias("clat"), r6(GRID.centroid(C("h3_cell"))[1]).alias("clon"),
        (hexgrid.haversine_km(C("lat"), C("lon"), *GRID.centroid(C("h3_cell"))) * 1000 <= 532).alias("within_edge"),
        F.size(GRID.boundary(C("h3_cell"))).cast("bigint").alias("ring_points")))
# the box of each event type's whole degrees of value, as far as its events reach
BOXES = "SELECT event_type, cast(floor(value / 10) as bigint) AS band, min(lat) - 5e-3 AS lat0, min(lon) - 5e-3 AS lon0, max(lat) + 5e-3 AS lat1, max(lon) + 5e-3 AS lon1 FROM (" + ROWS + ") z GROUP BY event_type, floor(value / 10)"
query("x6_bbox_cells", f"""WITH bx AS ({BOXES}), qr AS (SELECT bx.*, q, r, (q + 1048576) * 2097152 + r + 1048576 AS c FROM bx, range(-80, 81) a(q), range(-80, 81) b(r)),
 k AS (SELECT *, {_clat.replace('h3_cell', 'c')} AS clat, {_clon.replace('h3_cell', 'c')} AS clon FROM qr)
 SELECT event_type, band, c AS h3_cell FROM k WHERE clat BETWEEN lat0 AND lat1 AND clon BETWEEN lon0 AND lon1""")(
    lambda s, d: hexgrid.cells_in_boxes(portable(s, d, BOXES), GRID, ["event_type", "band"]))
_o = lambda k: [(dq, dr) for dq in range(-k, k + 1) for dr in range(-k, k + 1) if max(abs(dq), abs(dr), abs(dq + dr)) <= k]
_offs = values("offs", "k, dq, dr", [(k, a, b) for k in (1, 2) for a, b in _o(k)])
query("x7_ring_and_distance", f"""WITH g AS ({GEO}), {cells('g', 'gc')}, {_offs}, one AS (SELECT DISTINCT h3_cell FROM gc)
 SELECT h3_cell, k, count(*) AS n, max({dist('h3_cell', '(h3_cell + dq * 2097152 + dr)')}) AS far, cast(sum(h3_cell + dq * 2097152 + dr) as bigint) AS checksum FROM one, offs GROUP BY ALL""")(
    lambda s, d: geo_rows(s, d).select(GRID.cell(C("lat"), C("lon")).alias("h3_cell")).distinct()
    .select("h3_cell", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), hexgrid.ring(C("h3_cell"), k).alias("r")) for k in (1, 2)])).alias("x"))
    .select("h3_cell", "x.k", F.explode("x.r").alias("o")).groupBy("h3_cell", "k").agg(
        F.count("*").alias("n"), F.max(hexgrid.distance(C("h3_cell"), C("o"))).alias("far"), F.sum("o").alias("checksum")))
_n13 = 256 * 2 ** 13
_px, _py = f"((lon + 180) / 360 * {_n13})", f"((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_n13})"
query("x8_web_mercator", f"WITH g AS ({GEO}) SELECT event_id, round({_px}, 4) AS px, round({_py}, 4) AS py, round(lat, 5) AS lat, round(lon, 5) AS lon FROM g")(
    lambda s, d: geo_rows(s, d).withColumn("px", geo.lonlat_to_pixel(C("lat"), C("lon"), 13)[0]).withColumn("py", geo.lonlat_to_pixel(C("lat"), C("lon"), 13)[1]).select(
        "event_id", F.round("px", 4).alias("px"), F.round("py", 4).alias("py"), F.round(geo.pixel_to_lonlat(C("px"), C("py"), 13)[0], 5).alias("lat"),
        F.round(geo.pixel_to_lonlat(C("px"), C("py"), 13)[1], 5).alias("lon")))
LI = "SELECT l_orderkey, l_linenumber, cast(l_orderkey % 256 as double) AS r, cast(l_partkey % 256 as double) AS g, cast(l_suppkey % 256 as double) AS b FROM {lineitem}"
query("x9_elevation_pixels", f"WITH x AS ({LI}) SELECT l_orderkey, l_linenumber, r * 256 + g + b / 256 - 32768 AS metres FROM x")(
    lambda s, d: portable(s, d, LI).select("l_orderkey", "l_linenumber", geo.elevation(C("r"), C("g"), C("b")).alias("metres")))
import math  # noqa: E402
_d2 = f"(pow((lat - 26.9239::double) * 111, 2) + pow((lon - 75.8230::double) * {111.0 * math.cos(math.radians(26.9239))!r}::double, 2))"
query("x10_density_surface", f"WITH g AS ({GEO}), h AS (SELECT *, event_id // 100 AS row, event_id % 100 AS col FROM g) SELECT event_id, round((2500 + 13000 * exp(-{_d2} / 56.25) + 42000 * exp(-{_d2} / {1.8 ** 2!r}::double)) * 1444 / 1e6 * (0.6 + 0.8 * ((row * 7919 + col * 104729) % 1000) / 1000.0::double), 6) AS people FROM h")(
    lambda s, d: geo_rows(s, d).select("event_id", r6(geo.sample_people(C("lat"), C("lon"), F.floor(C("event_id") / 100), C("event_id") % 100, 1444.0)).alias("people")))
query("x11_array_sets", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(x * 10) as bigint)) AS a, list_transform(list_reverse(embedding), lambda x: cast(floor(x * 20) as bigint)) AS b FROM {embeddings})
 SELECT vec_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either, len(list_distinct(a)) AS n FROM e""")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 10)).alias("a"),
                                                  F.transform(F.reverse("embedding"), lambda x: F.floor(x.cast("double") * 20)).alias("b")).select(
        "vec_id", joined(F.sort_array(F.array_intersect("a", "b"))).alias("both"), joined(F.sort_array(F.array_union("a", "b"))).alias("either"),
        F.size(F.array_distinct("a")).cast("bigint").alias("n")))
query("x12_json_scalars", "SELECT event_id, cast(json_extract(props, '$.k') as bigint) AS k FROM {events}")(
    lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))

# ------------------------------------------------------------------ Q1, Q2, A10, J5, J6 -----
query("q1_bbox_filter", f"WITH g AS ({GEO}) SELECT event_id FROM g WHERE lat BETWEEN 26.79 AND 26.99 AND lon BETWEEN 75.69 AND 75.89")(
    lambda s, d: geo_rows(s, d).filter(hexgrid.in_bbox(C("lat"), C("lon"))).select("event_id"))
query("q2_floor_filter", f"WITH {CATS}, c AS ({CANON}) SELECT event_id, category FROM c JOIN cats USING (category) WHERE measure >= flo")(
    lambda s, d: portable(s, d, CANON).filter(sv.crosses_floor(C("category"), C("measure"))).select("event_id", "category"))
KL = "SELECT event_id, cast(1 + floor(value / 10) as bigint) AS k, 1e-2 + (event_id % 500) * 6e-2 AS lam FROM {events}"
query("a10_poisson_tail", f"""WITH x AS ({KL}) SELECT event_id, round(list_sum(list_transform(range(0, 300), lambda i: exp(-lam + (k + i) * ln(lam) - lgamma(k + i + 1)))), 9) AS p FROM x""")(
    lambda s, d: poisson.with_poisson_tail(portable(s, d, KL), C("k"), C("lam"), "p").select("event_id", F.round("p", 9).alias("p")))
_nearest = f"(SELECT arg_min(pos, ({hav('c.clat', 'c.clon', 'm.lat', 'm.lon')}, pos)) FROM marks m)"
NEAR = f"""g AS ({GEO}), {cells('g', 'gc')}, mk AS (SELECT * FROM marks), {cells('mk', 'mkc')}, c AS (SELECT DISTINCT h3_cell, {_clat} AS clat, {_clon} AS clon FROM gc),
 nn AS (SELECT h3_cell, arg_min(pos, km) AS pos FROM (SELECT c.h3_cell, m.pos, {hav('c.clat', 'c.clon', 'm.lat', 'm.lon')} AS km FROM c, marks m) GROUP BY h3_cell)"""
query("j5_nearest_landmark", f"WITH {MARKS}, {NEAR} SELECT h3_cell, pos::bigint AS pos FROM nn")(
    lambda s, d: geo_rows(s, d).select(GRID.cell(C("lat"), C("lon")).alias("h3_cell")).distinct()
    .withColumn("la", GRID.centroid(C("h3_cell"))[0]).withColumn("lo", GRID.centroid(C("h3_cell"))[1]).select(
        "h3_cell", places.nearest_landmark("la", "lo").cast("bigint").alias("pos")))
query("j6_zone_labels", f"""WITH {MARKS}, {NEAR} SELECT event_id, CASE WHEN m.h3_cell = gc.h3_cell THEN name ELSE 'Near ' || name END || ' + 2 nearby areas' AS en,
 CASE WHEN m.h3_cell = gc.h3_cell THEN name_hi ELSE name_hi || ' के पास' END || ' + 2 और क्षेत्र' AS hi FROM gc JOIN nn ON nn.h3_cell = gc.h3_cell JOIN mkc m ON m.pos = nn.pos""")(
    lambda s, d: (lambda x: x.select("event_id", places.with_nearby(C("zone_en"), C("zone_hi"), F.lit(3))[0].alias("en"),
                                     places.with_nearby(C("zone_en"), C("zone_hi"), F.lit(3))[1].alias("hi")))(
        places.zone_labels(geo_rows(s, d).withColumn("h3_cell", GRID.cell(C("lat"), C("lon"))), "h3_cell", GRID)))
