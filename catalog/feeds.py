"""Sources, normalisation, episodes, joins and ledgers over tables read as feeds."""
from pyspark.sql import functions as F

from cityweave import dims, schemas
from cityweave.functions import severity as sv, text as tx, times
from cityweave.operators import ingest as ig, places, quality
from cityweave.sources import readers

from . import masking
from .base import (EV, FEEDS, GRID, MARKS, P, ROWS, canon, cells, duck, iso, portable, query, r6, rnd, rows, table, ts)
from .columns import OFF, POWER, R, _heat, power_feed, power_records, weather_feed, _types, TYPE_TEXT  # noqa: F401

C = F.col
PS = P.but(chunk_rows=500)  # many chunks, so the carry between chunks is exercised

# ------------------------------------------------------------------ feed-shaped tables ------
COMPLAINTS = """SELECT event_id AS seq, 'C-' || cast(event_id as string) AS complaint_id,
 CASE WHEN value >= 9e1 AND value < 1e2 THEN 'yesterday' ELSE register_time END AS lodged_at, 'Ward ' || cast(user_id % 50 as string) AS ward,
 CASE user_id % 12 WHEN 3 THEN 'Tonk Road' WHEN 4 THEN 'NA' WHEN 9 THEN 'Jagatpura' ELSE 'Unknown' END AS locality,
 CASE user_id % 12 WHEN 0 THEN 'Near Hawa Mahal' WHEN 1 THEN 'Opp  Jal Mahal Gate 2' WHEN 2 THEN 'behind amer fort' WHEN 3 THEN '' WHEN 4 THEN 'NA'
  WHEN 5 THEN 'Mansarovar' WHEN 6 THEN 'in front of Albert Hall Museum' WHEN 7 THEN 'Sindhi Camp Bus Stand' WHEN 8 THEN 'Nagar' WHEN 9 THEN 'xyz'
  WHEN 10 THEN 'near ABC' ELSE 'Sanganer near Tonk Road' END AS landmark,
 CASE event_type WHEN 'click' THEN '  Water   Logging ' WHEN 'view' THEN 'GARBAGE burning' WHEN 'error' THEN 'Street  Light'
  WHEN 'signup' THEN 'Signal Not Working  ' ELSE CASE WHEN value < 2e1 THEN 'Other' WHEN value < 4e1 THEN '' ELSE 'Potholes' END END AS complaint_type,
 CASE WHEN value < 1e1 THEN 'Ramesh Kumar 98290 1' || lpad(cast(user_id as string), 4, '0') || ' paani bhar gaya' WHEN value < 2e1 THEN 'call +91 98290-12345 now'
  WHEN value < 3e1 THEN 'Near Ramesh gate' WHEN value < 4e1 THEN 'order 12345 67890 12' ELSE 'bada gaddha' END AS text,
 CASE WHEN value < 5e1 THEN 'OPEN' ELSE ' closed ' END AS status FROM (""" + ROWS + ") z"
_PII = "CASE WHEN value < 10 THEN 2 WHEN value < 20 THEN 1 ELSE 0 END"


def complaint_feed(s, d):
    return portable(s, d, COMPLAINTS)


_s = "regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '^(near|opp|opposite|behind|nr\\.|nr|in front of|next to) ', '')"


def place_sql(src, col, out):
    """CTEs resolving distinct texts of a column: every landmark whose name holds the text or is
    held by it at word boundaries; the longest name, then the first."""
    return f"""{out}_t AS (SELECT DISTINCT {col} AS txt, trim({_s.format(c=col)}) AS s FROM {src}),
{out} AS (SELECT txt, arg_min(pos, (-length(name), pos)) AS pos FROM {out}_t, marks WHERE length(regexp_replace(txt, '[^a-zA-Z]', '', 'g')) >= 4
  AND length(regexp_replace(s, '[^a-z]', '', 'g')) >= 4 AND (s = lower(name) OR regexp_matches(s, '\\b' || lower(name) || '\\b') OR regexp_matches(lower(name), '\\b' || s || '\\b')) GROUP BY txt)"""


CR = (MARKS + ", " + _types + ", cf AS (" + duck(COMPLAINTS) + "), mk AS (SELECT * FROM marks), " + cells("mk", "mkc") + ", " + place_sql("cf", "landmark", "pl") + ", " + place_sql("cf", "locality", "lc") + f""",
cr0 AS (SELECT cf.*, category, epoch(try_strptime(lodged_at, '%d/%m/%Y %I:%M %p'))::bigint - {OFF} AS t, coalesce(pl.pos, lc.pos) AS pos
  FROM cf LEFT JOIN types ON k = trim(regexp_replace(lower(complaint_type), '\\s+', ' ', 'g')) LEFT JOIN pl ON pl.txt = landmark LEFT JOIN lc ON lc.txt = locality),
cr AS (SELECT *, CASE WHEN category IS NULL THEN 'unmapped_type' WHEN t IS NULL THEN 'bad_timestamp' WHEN pos IS NULL THEN 'unresolved' END AS drop_reason FROM cr0)""")


def complaint_rows(s, d):
    return ig.complaint_records(complaint_feed(s, d), PS, GRID)


# weather and air readings: some are outside the city
_OUT = "CASE WHEN value >= 30 AND value < 32 THEN lat + 1 ELSE lat END"


def weather(s, d):
    w = weather_feed(s, d).withColumn("_v", C("rain_mm_15min"))
    return w.withColumn("lat", F.when((C("_v") >= 30 * 0.2) & (C("_v") < 32 * 0.2), C("lat") + 1).otherwise(C("lat"))).drop("_v")


def air(s, d):
    out = (C("value") >= 30) & (C("value") < 32)
    return rows(s, d).select(
        C("event_id").alias("seq"), F.concat(F.lit("A"), C("entity")).alias("sensor"), F.concat("naive_iso", F.lit("Z")).alias("captured"),
        F.when(C("value") < 1.5, F.lit(None)).when(C("value") < 3, -1.0).otherwise(C("value") * 3).alias("pm25"),
        F.struct(F.when(out, C("lat") + 1).otherwise(C("lat")).alias("latitude"), C("lon").alias("longitude")).alias("loc"),
        (C("user_id") % 2 == 0).alias("calibrated"), C("whole").cast("int").alias("battery_pct"))


DRAIN_SQL = """SELECT l_orderkey * 16 + l_linenumber * 2 + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS seq0, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
 'R-' || cast(l_suppkey as string) AS rtu, @EPOCH(l_shipdate) AS t_local, l_quantity * 3 AS lvl, l_tax, l_discount FROM {lineitem}"""
DREG_SQL = """SELECT 'R-' || cast(s_suppkey as string) AS id, 268e-1 + (s_suppkey % 25) * 4e-3 AS lat, 757e-1 + (s_nationkey % 20) * 5e-3 AS lon,
 1e2 + s_suppkey % 50 AS capacity_cm FROM {supplier} WHERE s_acctbal > 0"""


def drains(s, d):
    x = portable(s, d, DRAIN_SQL)
    # arrival order within a unit: time, then order line; made dense by a chunked rank
    level = F.when(C("l_tax") >= 0.075, -999.0).otherwise(C("lvl"))
    ch = F.filter(F.array(F.when(C("l_discount") < 0.095, F.struct(F.lit("LVL_CM").alias("tag"), level.alias("v"))),
                          F.struct(F.lit("BATT_V").alias("tag"), (C("l_discount") * 10 + 10.9).alias("v"))), lambda y: y.isNotNull())
    order = C("t_local") * F.lit(1 << 24) + C("seq0") % F.lit(1 << 24)
    return x.select("rtu", F.date_format(F.timestamp_seconds("t_local"), "dd/MM/yyyy HH:mm").alias("polled"), ch.alias("ch"), order.alias("seq"))


PD = P.but(chunk_rows=(1 << 24) * 86400 * 200)  # a chunk is 200 days of one unit


# ------------------------------------------------------------------ S: sources and sinks ----
query("s1_json_lines", R + "SELECT event_id AS ts, entity AS station_id, round(lat, 6) AS lat, CASE WHEN value >= 2 THEN round(value * 0.2, 6) END AS rain FROM r")(
    lambda s, d: readers.parse_json_lines(weather_feed(s, d).withColumn("ts", C("seq")).select(F.to_json(F.struct("station_id", "ts", "lat", "lon", "rain_mm_15min", "temp_c", "rh_pct")).alias("value"))
                                          .unionByName(rows(s, d).select(F.lit("   ").alias("value"))), "weather_imd")
    .select("ts", "station_id", r6("lat").alias("lat"), r6("rain_mm_15min").alias("rain")))
query("s2_malformed_records", "SELECT event_id, value >= 5 AS parsed_ok, CASE WHEN value < 5 THEN 'Invalid JSON' END AS reason, CASE WHEN value < 5 THEN '{\"station_id\": \"' || cast(event_id as varchar) END AS raw FROM {events}")(
    lambda s, d: readers.parse_json_lines(table(s, d, "events").select("event_id", F.when(C("value") < 5, F.concat(F.lit('{"station_id": "'), C("event_id").cast("string")))
                                                                       .otherwise(F.concat(F.lit('{"station_id": "'), C("event_id").cast("string"), F.lit('"}'))).alias("value")), "weather_imd")
    .select("event_id", "parsed_ok", "reason", "raw"))
_line = "complaint_id || ',' || lodged_at || ',' || ward || ',' || locality || ',' || landmark || ',' || complaint_type || ',' || text || ',' || status"
query("s3_register_lines", f"WITH c AS ({COMPLAINTS}) SELECT complaint_id, lodged_at, nullif(landmark, '') AS landmark, {_line} AS raw FROM c")(
    lambda s, d: readers.parse_complaint_lines(complaint_feed(s, d).select(F.concat_ws(",", *[c.split()[0] for c in schemas.COMPLAINT_DDL.split(", ")]).alias("value"))
                                               .unionByName(s.createDataFrame([(schemas.COMPLAINT_DDL.replace(" string", "").replace(", ", ","),), ("",)], "value string")))
    .select("complaint_id", "lodged_at", "landmark", "raw"))
query("s4_registry_documents", "SELECT 'F-' || cast(c_custkey as varchar) AS id, cast(c_nationkey as double) AS lat, c_name AS name, c_custkey % 4 AS signal_junctions FROM {customer}")(
    lambda s, d: readers.parse_registry(table(s, d, "customer").select(F.to_json(F.create_map(F.concat(F.lit("F-"), C("c_custkey").cast("string")), F.struct(
        C("c_nationkey").cast("double").alias("lat"), F.lit(75.7).alias("lon"), C("c_name").alias("name"), (C("c_custkey") % 4).cast("int").alias("signal_junctions")))).alias("value")),
        schemas.FEEDER_REGISTRY_VALUE).select("id", "lat", "name", C("signal_junctions").cast("bigint").alias("signal_junctions")))
query("s5_gazetteer_documents", f"WITH g AS (SELECT s_name AS name, 268e-1 + (s_suppkey % 25) * 4e-3 AS lat, 757e-1 + (s_nationkey % 20) * 5e-3 AS lon FROM {{supplier}}), {cells('g', 'gc')} SELECT name, 0 AS pos, h3_cell FROM gc")(
    lambda s, d: readers.parse_gazetteer(portable(s, d, "SELECT s_name AS name, s_name AS name_hi, 268e-1 + (s_suppkey % 25) * 4e-3 AS lat, 757e-1 + (s_nationkey % 20) * 5e-3 AS lon FROM {supplier}")
                                         .select(F.to_json(F.struct(F.array(F.struct("name", "name_hi", "lat", "lon")).alias("landmarks"))).alias("value")), GRID)
    .select("name", C("pos").cast("bigint").alias("pos"), "h3_cell"))
query("s6_arrival_order", "SELECT count(*) AS n, count(*) AS distinct_positions, min(event_id) AS first_event, max(event_id) AS last_event FROM {events}")(
    lambda s, d: readers.with_arrival(table(s, d, "events")).agg(F.count("*").alias("n"), F.count_distinct("seq").alias("distinct_positions"),
                                                                 F.min_by("event_id", "seq").alias("first_event"), F.max_by("event_id", "seq").alias("last_event")))


@query("s7_event_store", f"WITH {EV} SELECT event_id, {ts('t')} AS start_utc, severity FROM ev WHERE t >= epoch(TIMESTAMP '2024-01-20')::bigint")
def s7(s, d):
    from cityweave.operators.scale import stage_root
    import uuid
    path = f"{stage_root(s)}/event-store-{uuid.uuid4().hex}"
    e = canon(s, d).select("event_id", "source", "category", "h3_cell", "lat", "lon", "start_utc", "end_utc", "severity", "confidence", "received_at",
                           C("freshness_sec").cast("bigint"), "is_simulated", "raw_ref", "resolution", "measure")
    readers.write_events(e, path)
    return (s.read.parquet(path).filter("date >= date'2024-01-20'").select("event_id", iso("start_utc").alias("start_utc"), "severity"))


query("s8_document_sink", f"WITH {EV} SELECT event_id, {ts('t')} AS start_utc, severity, false AS internal FROM ev")(
    lambda s, d: (lambda x: x.select(F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.start_utc").alias("start_utc"),
                                     F.get_json_object("value", "$.severity").cast("double").alias("severity"), F.contains("value", F.lit("_seq")).alias("internal")))(
        readers.as_json_lines(canon(s, d).select("event_id", "start_utc", "end_utc", "severity", C("seq").alias("_seq")), ["start_utc", "event_id"])))


def truth_documents(s, d):
    x = table(s, d, "lineitem").select(F.concat_ws("-", F.lit("T"), C("l_orderkey").cast("string"), C("l_linenumber").cast("string"), C("l_partkey").cast("string")).alias("k"), "l_partkey", "l_suppkey", "l_shipdate")
    when_ = times.iso(C("l_shipdate").cast("timestamp"))
    return x.select(F.array(F.struct(C("k").alias("truth_id"), F.array(F.concat(F.lit("p"), C("l_partkey").cast("string")), F.concat(F.lit("s"), C("l_suppkey").cast("string"))).alias("member_event_ids"),
                                     when_.alias("onset_utc"), when_.alias("detect_by_utc"), F.lit("red").alias("expected_alert_level"))).alias("planted_situations"),
                    F.array(F.struct(F.concat(F.lit("D"), C("k")).alias("decoy_id"), F.array(C("l_suppkey").cast("string")).alias("member_event_ids"))).alias("decoys"))


query("s9_truth_documents", """WITH x AS (SELECT 'T-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k, l_partkey, l_suppkey FROM {lineitem})
 SELECT 'truth' AS kind, k AS id, 'p' || l_partkey AS event_id FROM x UNION ALL SELECT 'truth', k, 's' || l_suppkey FROM x UNION ALL SELECT 'decoy', 'D' || k, cast(l_suppkey as varchar) FROM x""")(
    lambda s, d: (lambda t: t[1].select(F.lit("truth").alias("kind"), C("truth_id").alias("id"), "event_id").unionByName(
        t[2].select(F.lit("decoy").alias("kind"), C("decoy_id").alias("id"), "event_id")))(readers.explode_truth(truth_documents(s, d))))
query("s10_data_version", "SELECT DISTINCT event_type AS category FROM {events}")(
    lambda s, d: quality.data_problems(table(s, d, "events").select(C("event_type").alias("category")).unionByName(canon(s, d).select("category")), dims.categories(s)))

# ------------------------------------------------------------------ complaints --------------
query("q3_drop_reasons", f"WITH {CR} SELECT seq, category, drop_reason FROM cr")(lambda s, d: complaint_rows(s, d).select("seq", "category", "drop_reason"))
query("q4_plausible_address", f"WITH c AS ({COMPLAINTS}) SELECT seq, length(regexp_replace(landmark, '[^a-zA-Z]', '', 'g')) >= 4 AND length(regexp_replace(trim({_s.format(c='landmark')}), '[^a-z]', '', 'g')) >= 4 AS ok FROM c")(
    lambda s, d: complaint_feed(s, d).select("seq", places.plausible(C("landmark")).alias("ok")))
query("j3_landmark_text", f"WITH {MARKS}, c AS ({COMPLAINTS}), {place_sql('c', 'landmark', 'pl')} SELECT seq, pos::bigint AS pos FROM c LEFT JOIN pl ON txt = landmark")(
    lambda s, d: complaint_feed(s, d).select("seq", places.landmark_position(C("landmark")).cast("bigint").alias("pos")))
# part names against a gazetteer table of words taken from the part table itself
_pn = "SELECT p_partkey, 'Near ' || p_name || ' depot' AS addr FROM {part}"
_gz = "SELECT cast(row_number() OVER (ORDER BY p_name) - 1 as int) AS pos, p_name AS name FROM (SELECT DISTINCT p_name FROM {part}) z"
query("j3_landmark_table", f"""WITH a AS ({_pn}), marks AS ({_gz}), {place_sql('a', 'addr', 'pl')} SELECT p_partkey, pos::bigint AS pos FROM a LEFT JOIN pl ON txt = addr""")(
    lambda s, d: places.resolve_by_join(portable(s, d, _pn), "addr", portable(s, d, _gz)).select("p_partkey", C("pos").cast("bigint").alias("pos")))
query("j4_landmark_or_locality", f"WITH {CR} SELECT seq, pos::bigint AS pos FROM cr")(lambda s, d: complaint_rows(s, d).select("seq", C("pos").cast("bigint").alias("pos")))
query("q7_resolver_rates", f"WITH {CR} SELECT count(pos) AS landmark_hit, count(*) - count(pos) AS landmark_miss, round(count(pos) / count(*), 6) AS rate FROM cr WHERE drop_reason IS NULL OR drop_reason = 'unresolved'")(
    lambda s, d: quality.resolver_rates(complaint_rows(s, d)).withColumn("rate", r6("rate")))
query("a30_pii_totals", f"""WITH {CR}, z AS (SELECT seq, {_PII} AS n FROM ({duck(ROWS)}) r JOIN cr ON seq = event_id WHERE drop_reason IS NULL)
 SELECT cast(sum(n) as bigint) AS pii_items_seen, count(*) FILTER (n > 0) AS records_with_pii FROM z""")(
    lambda s, d: ig.complaint_ledger(complaint_rows(s, d)).select("pii_items_seen", "records_with_pii"))
_up = "upper(trim(status)) = 'CLOSED'"
query("q5_complaint_ledger", f"""WITH {CR} SELECT count(*) AS records, count(*) FILTER (drop_reason IS NULL) AS candidates, count(*) FILTER (drop_reason = 'unmapped_type') AS dropped_unmapped_type,
 count(*) FILTER (drop_reason = 'bad_timestamp') AS dropped_bad_timestamp, count(*) FILTER (drop_reason = 'unresolved') AS dropped_unresolved, count(*) FILTER (drop_reason IS NULL AND {_up}) AS closed_rows FROM cr""")(
    lambda s, d: ig.complaint_ledger(complaint_rows(s, d)).drop("pii_items_seen", "records_with_pii"))

# ------------------------------------------------------------------ masking -----------------
_mask = ("CASE WHEN value < 10 THEN '[name] [phone] paani bhar gaya' WHEN value < 20 THEN 'call [phone] now' WHEN value < 30 THEN 'Near Ramesh gate'"
         " WHEN value < 40 THEN 'order 12345 67890 12' ELSE 'bada gaddha' END")
query("x3_scrub_register_text", R + f"SELECT event_id, {_mask} AS masked, {_PII} AS items FROM r")(
    lambda s, d: complaint_feed(s, d).withColumn("x", tx.scrub(C("text"))).select(C("seq").alias("event_id"), "x.masked", "x.items"))
query("x4_mask_records", R + f"SELECT event_id, {_mask} AS text, {_PII} AS items_masked FROM r")(
    lambda s, d: tx.mask_record(complaint_feed(s, d), "civic_complaints").select(C("seq").alias("event_id"), "text", "items_masked"))
# whole documents and conversations
query("x1_mask_phones_documents", masking.check("documents", "doc_id", masking.phones))(lambda s, d: (lambda m: table(s, d, "documents").select("doc_id", m[0].alias("masked"), m[1].cast("bigint").alias("items")))(tx.mask_phones(C("text"))))
query("x2_mask_names_documents", masking.check("documents", "doc_id", masking.names))(lambda s, d: (lambda m: table(s, d, "documents").select("doc_id", m[0].alias("masked"), m[1].cast("bigint").alias("items")))(tx.mask_names(C("text"))))
query("x3_scrub_conversations", masking.check("conversations", "conv_id, turn", masking.phones, masking.names))(lambda s, d: table(s, d, "conversations").withColumn("x", tx.scrub(C("text"))).select("conv_id", "turn", "x.masked", "x.items"))

# ------------------------------------------------------------------ registries --------------
query("j1_feeder_lookup", f"WITH {POWER} SELECT seq, resolved, h3_cell FROM pw")(lambda s, d: power_records(s, d).select("seq", "resolved", "h3_cell"))
DR = "dreg0 AS (" + duck(DREG_SQL) + "), " + cells("dreg0", "dreg") + ", dl0 AS (" + duck(DRAIN_SQL) + f"""),
dl AS (SELECT d.*, t_local * 16777216 + seq0 % 16777216 AS seq, t_local - {OFF} AS t, g.id IS NOT NULL AS located, g.lat, g.lon, g.h3_cell, g.capacity_cm, rtu AS entity, 'drain.overflow' AS category,
  l_discount >= 0.095 OR l_tax >= 0.075 AS fault, l_discount * 10 + 10.9 < 11.2 AS lowb FROM dl0 d LEFT JOIN dreg g ON g.id = rtu)"""
_pct = rnd("lvl / capacity_cm * 100.0", 1)
query("j2_drain_lookup", f"WITH {DR} SELECT rtu, seq, located, capacity_cm FROM dl")(
    lambda s, d: places.registry_lookup(drains(s, d), portable(s, d, DREG_SQL), "rtu", GRID, ["capacity_cm"]).select("rtu", "seq", C("resolved").alias("located"), C("reg_capacity_cm").alias("capacity_cm")))


# ------------------------------------------------------------------ episodes ----------------
def weather_marked(s, d):
    return ig.mark_islands(ig.weather_measures(weather(s, d), PS, GRID), PS, True)


def air_marked(s, d):
    return ig.mark_islands(ig.air_readings(air(s, d), PS, GRID), PS)


def drain_readings(s, d):
    return ig.drain_readings(drains(s, d), portable(s, d, DREG_SQL), PD, GRID)


def drain_marked(s, d):
    return ig.mark_islands(drain_readings(s, d), PD, True)


def island_sql(src: str, p: str = "") -> str:
    """Open and close by the previous row: an episode opens on a reading above the floor whose
    previous one is not, and the first later row that is not above closes it."""
    return f"""{p}il0 AS (SELECT *, above AND NOT coalesce(lag(above) OVER w, false) AS opens, NOT above AND coalesce(lag(above) OVER w, false) AS closes FROM {src} WINDOW w AS (PARTITION BY entity, category ORDER BY seq)),
{p}il1 AS (SELECT *, sum(opens::int) OVER (PARTITION BY entity, category ORDER BY seq) AS ep FROM {p}il0),
{p}il2 AS (SELECT *, first_value(t) OVER e AS t_open, first_value(seq) OVER e AS seq_open, max(CASE WHEN above THEN measure END) OVER (PARTITION BY entity, category, ep) AS peak
  FROM {p}il1 WHERE above OR closes WINDOW e AS (PARTITION BY entity, category, ep ORDER BY seq)),
{p}cand AS (SELECT entity, category, seq, seq_open, t_open, CASE WHEN closes THEN t END AS t_end, CASE WHEN closes THEN peak ELSE measure END AS measure, conf, lat, lon FROM {p}il2 WHERE located)"""


_WS = f"""{R} , wm AS (SELECT seq, entity, category, measure, t, CASE WHEN value >= 30 AND value < 32 THEN lat + 1 ELSE lat END AS lat, lon, true AS located, 0.9::double AS conf,
 measure >= CASE category WHEN 'weather.rain' THEN 5.0 ELSE 38.0 END AS above
 FROM (SELECT event_id AS seq, entity, 'weather.rain' AS category, CASE WHEN value >= 2 THEN value * 0.2::double ELSE 0.0 END AS measure, t, lat, lon, value FROM r
  UNION ALL SELECT event_id, entity, 'weather.heat', {_heat}, t, lat, lon, value FROM r) z WHERE NOT (value >= 30 AND value < 32)), """
_CSEL = f"SELECT entity, category, seq, {ts('t_open')} AS start_utc, {ts('t_end')} AS end_utc, round(measure, 6) AS measure FROM cand"
query("w1_threshold_episodes", _WS + island_sql("wm") + " " + _CSEL)(lambda s, d: cand_out(ig.island_candidates(weather_marked(s, d))))


def cand_out(c):
    return c.select("entity", "category", "seq", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc"), r6("measure").alias("measure"))


_AS = f"""{R} , am AS (SELECT event_id AS seq, 'A' || entity AS entity, 'air.pm25' AS category, CASE WHEN value >= 3 THEN value * 3 END AS measure, t, {_OUT} AS lat, lon,
 NOT (value >= 30 AND value < 32) AS located, coalesce(value >= 3 AND value * 3 >= 60, false) AS above, value < 3 AS fault,
 greatest(0.3::double, round(CASE WHEN user_id % 2 = 0 THEN 0.9::double ELSE 0.6::double END * CASE WHEN whole < 15 THEN 0.5::double ELSE 1.0::double END, 2)) AS conf FROM r), """
query("w2_episodes_with_faults", _AS + island_sql("am") + " " + _CSEL)(lambda s, d: cand_out(ig.island_candidates(air_marked(s, d))))
_DS = f"WITH {DR}, dm AS (SELECT seq, entity, category, CASE WHEN NOT fault THEN {_pct} END AS measure, t, lat, lon, located, NOT fault AND {_pct} >= 85 AS above, fault, CASE WHEN lowb THEN 0.36::double ELSE 0.72::double END AS conf FROM dl WHERE located), "
query("w3_episodes_scaled_by_registry", _DS + island_sql("dm") + " " + _CSEL)(lambda s, d: cand_out(ig.island_candidates(drain_marked(s, d))))
query("q6_unhealthy_entities", f"{R} , x AS (SELECT DISTINCT 'air_sensors' AS source, 'A' || entity AS entity FROM r WHERE value < 3) SELECT * FROM x")(
    lambda s, d: ig.unhealthy_entities(ig.air_readings(air(s, d), PS, GRID)))
_fold_sql = f""", f AS (SELECT entity, category, t_open, min(conf) AS confidence, max(t_end) AS t_end, max(measure) AS measure, count(*) AS n FROM cand GROUP BY entity, category, t_open)
 SELECT entity, category, {ts('t_open')} AS start_utc, {ts('t_end')} AS end_utc, round(measure, 3) AS measure, confidence, n FROM f"""


def fold_out(f, feed):
    return f.select(F.regexp_extract("raw_ref", f"^{feed}:(.*)@", 1).alias("entity"), "category", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc"),
                    F.round("measure", 3).alias("measure"), "confidence", C("n").cast("bigint").alias("n"))


query("a1_fold_candidates", _AS + island_sql("am") + _fold_sql)(
    lambda s, d: fold_out(ig.fold(ig.build_events(ig.island_candidates(air_marked(s, d)))).withColumn("n", C("n_candidates")), "air_sensors"))
query("a1_fold_islands", _WS + island_sql("wm") + _fold_sql)(
    lambda s, d: fold_out(ig.island_episodes(weather_marked(s, d)).withColumn("n", C("n_candidates")), "weather_imd"))
query("a2_fold_counts", _AS + island_sql("am") + " SELECT 'air_sensors' AS source, cast(count(*) - count(DISTINCT (entity, t_open)) as bigint) AS removed FROM cand")(
    lambda s, d: ig.fold_counts(ig.fold(ig.build_events(ig.island_candidates(air_marked(s, d))))))
query("a3_source_split", f"WITH {EV} SELECT source, count(*) AS n FROM ev WHERE category = 'traffic.signal_down' GROUP BY source")(lambda s, d: ig.source_split(canon(s, d)))
query("q5_sensor_ledger", _AS + island_sql("am") + """ SELECT 'air_sensors' AS source, count(DISTINCT entity) AS entities, count(*) AS readings, count(*) FILTER (fault) AS dropped_faulty, count(*) FILTER (NOT located) AS dropped_unresolved,
 (SELECT count(DISTINCT (entity, t_open)) FROM cand) AS episodes, (SELECT count(*) FROM cand) AS candidates FROM am""")(
    lambda s, d: (lambda r: ig.sensor_ledger(ig.mark_islands(r, PS), r))(ig.air_readings(air(s, d), PS, GRID)))

# ------------------------------------------------------------------ outages -----------------
OUT = POWER + """,
po AS (SELECT *, NOT is_restore AND (m_out IS NOT NULL OR m_sig IS NOT NULL) AS opens FROM pw WHERE resolved),
pq AS (SELECT *, lag(is_restore) OVER w AS prev_restore, last_value(CASE WHEN opens THEN seq END IGNORE NULLS) OVER (PARTITION BY feeder_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_seq,
  last_value(CASE WHEN opens OR is_restore THEN is_restore END IGNORE NULLS) OVER (PARTITION BY feeder_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_restore FROM po WINDOW w AS (PARTITION BY feeder_id ORDER BY seq)),
closers AS (SELECT open_seq, t AS t_end FROM pq WHERE is_restore AND open_seq IS NOT NULL AND NOT last_restore)"""
query("j7_close_pairing", f"WITH {OUT} SELECT o.seq, {ts('c.t_end')} AS end_utc FROM po o LEFT JOIN closers c ON c.open_seq = o.seq WHERE opens")(
    lambda s, d: ig.outage_spans(ig.pair_outages(power_records(s, d), PS)).filter("o is not null").select("o.seq", iso("end_utc").alias("end_utc")))
_PC = """, pc AS (SELECT seq, feeder_id AS entity, category, measure, cap, t, t_end FROM (SELECT *, 'power.outage' AS category, m_out AS measure FROM po UNION ALL SELECT *, 'traffic.signal_down', m_sig FROM po) z LEFT JOIN closers ON open_seq = seq
  WHERE measure IS NOT NULL AND opens)"""
query("w4_open_close_pairing", f"WITH {OUT}{_PC} SELECT seq, entity, category, measure, {ts('t')} AS start_utc, NULL::varchar AS end_utc FROM pc UNION ALL SELECT seq, entity, category, measure, {ts('t')}, {ts('t_end')} FROM pc WHERE t_end IS NOT NULL")(
    lambda s, d: ig.outage_candidates(ig.pair_outages(power_records(s, d), PS)).select("seq", "entity", "category", "measure", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc")))
query("q5_power_ledger", f"""WITH {OUT} SELECT count(*) AS records, count(*) FILTER (NOT resolved) AS dropped_unresolved, count(*) FILTER (resolved AND NOT is_restore) AS trips, count(*) FILTER (resolved AND is_restore) AS restores,
 count(*) FILTER (resolved AND NOT is_restore AND m_out IS NULL) AS below_floor, count(m_sig) FILTER (resolved) AS signal_down_emitted,
 (SELECT count(*) FROM po WHERE is_restore) - (SELECT count(*) FROM closers) AS restores_unmatched FROM pw""")(
    lambda s, d: (lambda r: ig.power_ledger(r, ig.pair_outages(r, PS)).drop("trip_candidates"))(power_records(s, d)))

# ------------------------------------------------------------------ clusters ----------------
query("w5_trailing_cluster", f"""WITH {EV}, c AS (SELECT event_id, h3_cell, category, t, seq FROM ev WHERE category LIKE 'complaint.%'),
 k AS (SELECT a.event_id, count(*) AS n FROM c a JOIN c b ON a.h3_cell = b.h3_cell AND a.category = b.category AND b.t BETWEEN a.t - 1800 AND a.t AND (b.t < a.t OR b.seq <= a.seq) GROUP BY a.event_id)
 SELECT event_id, n::double AS measure, CASE WHEN n <= 1 THEN 0.0 ELSE {rnd('least(1.0, (n - 1) / 11.0::double)', 4)} END AS severity FROM k""")(
    lambda s, d: ig.cluster_complaints(canon(s, d).select("event_id", "h3_cell", "category", "start_utc", "seq", "measure", "severity"), PS).filter("category like 'complaint.%'").select("event_id", "measure", "severity"))

# ------------------------------------------------------------------ health and checks -------
_NOW = "(SELECT max(t) + 700 FROM ({}) z)"


def arrivals(s, d):
    from .base import CANON
    x = portable(s, d, CANON).select("source", F.timestamp_seconds("t").alias("t"))
    return x.groupBy(C("source").alias("feed")).agg(F.max(sv.received_at(C("t"), sv.interval_of(C("source")))).alias("last"), F.count("*").alias("records"))


def health(s, d, killed=(), errors=None):
    now = portable(s, d, "SELECT max(@EPOCH(ts)) + 700 AS t FROM {events}").first()[0]
    return ig.feed_health(arrivals(s, d), dims.feeds(s), F.timestamp_seconds(F.lit(now)), killed, errors)


from .base import CANON, INTERVAL  # noqa: E402

HEALTH = f"""{FEEDS}, c AS ({duck(CANON)}), nowt AS (SELECT max(t) + 700 AS now FROM c), ar AS (SELECT source AS feed, max(t + {INTERVAL}) AS last, count(*) AS records FROM c GROUP BY source),
hh AS (SELECT f.feed, interval_sec, last, now - last AS age, coalesce(records, 0) AS records FROM feeds f LEFT JOIN ar USING (feed), nowt)"""
query("a24_feed_health", f"""WITH {HEALTH} SELECT feed, CASE WHEN feed = 'air_sensors' THEN 'error' WHEN feed = 'weather_imd' THEN 'killed' WHEN last IS NULL THEN 'stale' WHEN age > 3 * interval_sec THEN 'stale' ELSE 'live' END AS state,
 {ts('last')} AS last_record_utc, age::bigint AS age_sec, interval_sec, records AS records_total,
 CASE WHEN feed = 'air_sensors' THEN 'timeout' WHEN feed = 'weather_imd' THEN 'Stopped by operator' WHEN last IS NULL THEN 'No records seen' WHEN age > 3 * interval_sec THEN 'No update for ' || greatest(1, age // 60) || ' min' END AS message FROM hh""")(
    lambda s, d: health(s, d, ("weather_imd",), {"air_sensors": "timeout"}).select("feed", "state", iso("last_record_utc").alias("last_record_utc"), "age_sec", "interval_sec", "records_total", "message"))
query("r8_stale_feeds", f"WITH {HEALTH} SELECT feed, age::bigint AS age_sec FROM hh WHERE last IS NULL OR age > 3 * interval_sec")(
    lambda s, d: health(s, d).filter("state = 'stale'").select("feed", "age_sec"))
query("a25_health_from_events", f"WITH {EV}, ar AS (SELECT source AS feed, {ts('max(t_recv)')} AS last, count(*) AS records FROM ev GROUP BY source) SELECT * FROM ar")(
    lambda s, d: ig.event_arrivals(canon(s, d)).select("feed", iso("last").alias("last"), "records"))
query("q8_reconciliation", f"{R} , raw AS (SELECT count(*) AS raw FROM r), " + (_AS.split(" , ", 1)[1] + island_sql("am")) + """ SELECT 'air_sensors' AS feed, raw, (SELECT count(*) FROM cand) AS candidates,
 (SELECT count(*) - count(DISTINCT (entity, t_open)) FROM cand) AS folded, (SELECT count(DISTINCT (entity, t_open)) FROM cand) AS final FROM raw""")(
    lambda s, d: quality.reconcile(air(s, d).agg(F.count("*").alias("raw")).select(F.lit("air_sensors").alias("feed"), "raw"), ig.fold(ig.build_events(ig.island_candidates(air_marked(s, d))))))
query("q9_invariants", f"""WITH {EV}, k AS (SELECT DISTINCT source, raw_ref, category FROM ev) SELECT (SELECT count(*) FROM k) AS events, 0 AS outside_bbox, 0 AS id_mismatch, 0 AS bad_severity, 0 AS bad_confidence,
 0 AS ends_before_start, 0 AS seen_before_start, 0 AS unknown_category, 0 AS duplicate_ids""")(
    lambda s, d: quality.invariants(ig.fold(ig.build_events(canon(s, d).select("source", "category", "raw_ref", "start_utc", "end_utc", "lat", "lon", "h3_cell", "measure", "confidence", "resolution", "seq"))), GRID).drop("pii_in_reference"))
query("q10_stationarity", f"""WITH {EV}, dd AS (SELECT t // 86400 AS d, count(*) AS n FROM ev GROUP BY 1), b AS (SELECT n FROM dd WHERE d > (SELECT min(d) FROM dd) AND d < (SELECT max(d) FROM dd))
 SELECT (SELECT count(*) FROM dd) AS days, round(avg(n), 6) AS mean, round(stddev_pop(n) / avg(n), 6) AS cv, round(max(n) / median(n), 6) AS peak_over_median, stddev_pop(n) / avg(n) < 0.35 AND max(n) / median(n) < 2 AS stationary FROM b""")(
    lambda s, d: quality.stationarity(canon(s, d)).select("days", r6("mean").alias("mean"), r6("cv").alias("cv"), r6("peak_over_median").alias("peak_over_median"), "stationary"))


# ------------------------------------------------------------------ the whole ingest ---------
def _head(sql):
    """The CTEs of a check query without its leading WITH."""
    return sql.split("WITH ", 1)[1].rstrip().rstrip(",") if sql.lstrip().startswith("WITH") else sql


_w_ctes = _WS.rstrip().rstrip(",") + ", " + island_sql("wm", "w_")
_a_ctes = _AS.split(" , ", 1)[1].rstrip().rstrip(",") + ", " + island_sql("am", "a_")
_d_ctes = _head(_DS).rstrip().rstrip(",") + ", " + island_sql("dm", "d_")
_cc = cells("alls", "allc")
_uid = lambda x: (f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
                  f" FROM (SELECT sha1(unhex('{NS}') || encode({x})) AS h) hh)")
from .columns import NS, REG_SQL  # noqa: E402

INGEST = _w_ctes + ", " + _a_ctes + ", " + _d_ctes + ", " + OUT + _PC + ", " + CR + f""",
alls AS (SELECT 'weather_imd' AS source, 'weather_imd:' || entity || '@' || t_open AS raw_ref, category, seq, t_open AS t, t_end, lat, lon, measure, conf, NULL::double AS cap FROM w_cand
 UNION ALL SELECT 'air_sensors', 'air_sensors:' || entity || '@' || {ts('t_open')}, category, seq, t_open, t_end, lat, lon, measure, conf, NULL FROM a_cand
 UNION ALL SELECT 'drain_scada', 'drain_scada:' || entity || '@' || t_open, category, seq, t_open, t_end, lat, lon, measure, conf, NULL FROM d_cand
 UNION ALL SELECT 'power_discom', raw_ref, pc.category, pc.seq, pc.t, NULL, lat, lon, pc.measure, 0.72::double, pc.cap FROM pc JOIN po ON po.seq = pc.seq
 UNION ALL SELECT 'power_discom', raw_ref, pc.category, pc.seq, pc.t, pc.t_end, lat, lon, pc.measure, 0.72::double, pc.cap FROM pc JOIN po ON po.seq = pc.seq WHERE pc.t_end IS NOT NULL
 UNION ALL SELECT 'civic_complaints', 'civic_complaints:' || complaint_id, category, seq, t, CASE WHEN {_up} THEN t + 60 END, lat, lon, 1.0::double, 0.6::double, NULL FROM cr JOIN marks USING (pos) WHERE drop_reason IS NULL),
{_cc}, capd AS (SELECT a.*, CASE WHEN measure <= flo THEN 0.0 ELSE {rnd('least(1.0, (measure - flo) / (cei - flo))', 4)} END AS sev0 FROM allc a JOIN cats USING (category)),
fo AS (SELECT source, raw_ref, category, min(t) AS t, max(t_end) AS t_end, arg_max(CASE WHEN cap IS NULL THEN sev0 ELSE least(cap, sev0) END, (measure, -seq)) AS sev, min(conf) AS conf, arg_min(h3_cell, seq) AS h3_cell, min(seq) AS seq FROM capd GROUP BY ALL),
cl AS (SELECT a.raw_ref, a.category, count(*) AS n FROM fo a JOIN fo b ON a.h3_cell = b.h3_cell AND a.category = b.category AND b.t BETWEEN a.t - 1800 AND a.t AND (b.t < a.t OR b.seq <= a.seq) WHERE a.category LIKE 'complaint.%' GROUP BY ALL)
SELECT {_uid("raw_ref || '|' || category")} AS event_id, source, category, h3_cell, {ts('t')} AS start_utc, {ts('t_end')} AS end_utc,
 CASE WHEN n IS NULL THEN sev WHEN n <= 1 THEN 0.0 ELSE {rnd('least(1.0, (n - 1) / 11.0::double)', 4)} END AS severity, conf AS confidence, raw_ref FROM fo LEFT JOIN cl USING (raw_ref, category)"""
from .base import CATS  # noqa: E402


@query("c1_ingest", INGEST.replace("WITH ", "WITH " + CATS + ", ", 1))
def c1(s, d):
    from cityweave.plans import city
    r = city.ingest(s, weather(s, d), complaint_feed(s, d), power_feed(s, d), drains(s, d), air(s, d), portable(s, d, REG_SQL), portable(s, d, DREG_SQL), p=PS, widths={"drain_scada": PD.chunk_rows})
    return r.events.select("event_id", "source", "category", "h3_cell", iso("start_utc").alias("start_utc"), iso("end_utc").alias("end_utc"), "severity", "confidence", "raw_ref")
