"""Real feed formats, small literal cases."""
import json

import pytest
from pyspark.sql import functions as F

from cityweave import dims
from cityweave.functions import times
from cityweave.functions.hexgrid import HexGrid
from cityweave.operators import ingest as ig
from cityweave.params import Params
from cityweave.plans import city
from cityweave.sources import readers

GRID = HexGrid()
IN = dict(lat=26.9124, lon=75.7873)


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def w(ts, rain, sid="IMD-1", temp=20.0, lat=26.9124):
    return {"station_id": sid, "ts": ts, "lat": lat, "lon": 75.7873, "rain_mm_15min": rain, "temp_c": temp, "rh_pct": 50, "wind_kph": 3}


@pytest.fixture
def folder(tmp_path):
    t = 1758719520
    write(tmp_path / "raw_weather_imd.jsonl", [
        w(t, 0.0), w(t + 300, 6.0), w(t + 600, 40.0), "", w(t + 700, 99.0, lat=10.0), w(t + 900, 2.0), w(t + 1200, None), w(t + 1500, 5.0), "{broken"])
    write(tmp_path / "raw_civic_complaints.csv", [
        "complaint_id,lodged_at,ward,locality,landmark,complaint_type,text,status",
        "J-1,24/09/2026 6:42 PM,W,Sindhi Camp,Near Sindhi Camp Bus Stand,Water Logging,Ramesh 98290 12345,OPEN",
        "J-2,24/09/2026 6:44 PM,W,Sindhi Camp,,water logging  ,,OPEN",
        "J-3,24/09/2026 6:44 PM,W,Sindhi Camp,,WATERLOGGING,,CLOSED",
        "J-4,24/09/2026 6:44 PM,W,NA,NA,Water Logging,,OPEN",
        "J-5,24/09/2026 6:44 PM,W,Sindhi Camp,,Other,,OPEN",
        "J-6,soon,W,Sindhi Camp,,Pothole,,OPEN",
        'J-7,24/09/2026 7:20 PM,W,x,"Opp Hawa Mahal, gate 2",Signal Not Working,,OPEN'])
    p = lambda f, e, at, n, s, j=None: {"feeder_id": f, "substation": "S", "event": e, "reported_time": f"2026-09-24T{at}", "est_restore_min": 10,
                                        "affected_connections": n, "carries_signals": s, "signal_junctions": j, "cause": "X"}
    write(tmp_path / "raw_power_discom.jsonl", [
        p("F1", "RESTORE", "18:00:00", 0, False), p("F1", "TRIP", "18:44:00", 4120, True, 3), p("F1", "TRIP", "18:50:00", 300, False),
        p("F1", "TRIP", "18:51:00", 10, False), p("F1", "RESTORE", "19:00:00", 0, False), p("F1", "RESTORE", "19:05:00", 0, False),
        p("F2", "SCHEDULED_CUT", "18:00:00", 8000, True, 0), p("F9", "TRIP", "18:00:00", 8000, True)])
    d = lambda at, v, b=12.6, r="R1": {"rtu": r, "polled": f"24/09/2026 {at}", "ch": ([{"tag": "LVL_CM", "v": v}] if v is not None else []) + [{"tag": "BATT_V", "v": b}]}
    write(tmp_path / "raw_drain_scada.jsonl", [d("18:00", 85.0), d("18:10", 110.0, 11.0), d("18:20", -999), d("18:30", 90.0), d("18:40", None), d("18:50", 10.0), d("18:00", 99.0, r="R9")])
    a = lambda at, pm, b=50, cal=True: {"sensor": "A1", "captured": f"2026-09-24T{at}Z", "pm25": pm, "pm10": 1.0, "loc": {"latitude": 26.9124, "longitude": 75.7873}, "calibrated": cal, "battery_pct": b}
    write(tmp_path / "raw_air_sensors.jsonl", [a("13:00:00", 70.0), a("14:30:00", 180.0, 10), a("14:29:00", 59.0), a("14:40:00", 61.0, cal=False), a("14:43:00", -1), a("14:50:00", None)])
    (tmp_path / "feeder_registry.json").write_text(json.dumps({
        "F1": {**IN, "h3_cell": "x", "name": "n", "carries_signals": True, "signal_junctions": 4, "connections": 1},
        "F2": {**IN, "h3_cell": "x", "name": "n", "carries_signals": True, "signal_junctions": 5, "connections": 1}}))
    (tmp_path / "drain_sensor_registry.json").write_text(json.dumps({"R1": {**IN, "h3_cell": "x", "name": "n", "capacity_cm": 100.0}}))
    return tmp_path


def feeds(spark, folder):
    j = lambda f: readers.read_jsonl(spark, f"{folder}/raw_{f}.jsonl", f).filter("parsed_ok")
    return dict(weather=j("weather_imd"), complaints=readers.read_complaints(spark, f"{folder}/raw_civic_complaints.csv"), power=j("power_discom"),
                drains=j("drain_scada"), air=j("air_sensors"), feeders=readers.read_registry(spark, f"{folder}/feeder_registry.json", "feeder"),
                channels=readers.read_registry(spark, f"{folder}/drain_sensor_registry.json", "drain"))


def test_malformed_lines_are_kept(spark, folder):
    d = readers.read_jsonl(spark, f"{folder}/raw_weather_imd.jsonl", "weather_imd")
    assert d.count() == 8
    assert [tuple(r) for r in d.filter("not parsed_ok").select("reason", "raw").collect()] == [("Invalid JSON", "{broken")]


@pytest.mark.parametrize("chunk", [1, 1_000_000])
def test_whole_ingest(spark, folder, chunk):
    r = city.ingest(spark, p=Params(chunk_rows=chunk), **feeds(spark, folder))
    ev = {(e["raw_ref"], e["category"]): e for e in r.events.withColumn("s", times.iso(F.col("start_utc"))).withColumn("e", times.iso(F.col("end_utc"))).collect()}
    t = 1758719520
    got = {k: (e["s"], e["e"], e["severity"], e["confidence"], e["measure"]) for k, e in ev.items()}
    iso = lambda x: __import__("datetime").datetime.fromtimestamp(x, __import__("datetime").timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert got[(f"weather_imd:IMD-1@{t + 300}", "weather.rain")] == (iso(t + 300), iso(t + 900), 1.0, 0.9, 40.0)
    assert got[(f"weather_imd:IMD-1@{t + 1500}", "weather.rain")] == (iso(t + 1500), None, 0.0, 0.9, 5.0)
    # complaints: three like reports in the cell, ties counted in order, the closed one has an end
    c = lambda i, cat="complaint.waterlogging": got[(f"civic_complaints:J-{i}", cat)]
    assert c(1) == ("2026-09-24T13:12:00Z", None, 0.0, 0.6, 1.0)
    assert c(2)[2:] == (round(1 / 11, 4), 0.6, 2.0) and c(3)[2:] == (round(2 / 11, 4), 0.6, 3.0) and c(3)[1] == "2026-09-24T13:15:00Z"
    assert c(7, "traffic.signal_down")[0] == "2026-09-24T13:50:00Z"
    # power: the second trip replaces the first, the one below the floor does not, one restore closes it
    f = lambda at, cat: got[(f"power_discom:{at}", cat)]
    ist = lambda hh, mm: int(__import__("datetime").datetime(2026, 9, 24, hh, mm, tzinfo=__import__("datetime").timezone.utc).timestamp()) - 19800
    assert f(f"F1@{ist(18, 44)}", "power.outage")[1] is None and f(f"F1@{ist(18, 44)}", "traffic.signal_down")[4] == 3.0
    assert f(f"F1@{ist(18, 50)}", "power.outage")[1] == "2026-09-24T13:30:00Z"
    assert (f"power_discom:F1@{ist(18, 51)}", "power.outage") not in got
    assert f(f"F2@{ist(18, 0)}", "power.outage")[2] == 0.4 and f(f"F2@{ist(18, 0)}", "traffic.signal_down")[4] == 5.0
    # drains: exactly 85 % opens, a fault closes, a low battery lowers the confidence of the whole
    d = got[(f"drain_scada:R1@{ist(18, 0)}", "drain.overflow")]
    assert d[1:] == ("2026-09-24T12:50:00Z", round(25 / 45, 4), 0.36, 110.0)
    assert got[(f"drain_scada:R1@{ist(18, 30)}", "drain.overflow")][1] == "2026-09-24T13:10:00Z"
    # air: arrival order decides, the clock going back still closes; missing stretch did not
    a = got[("air_sensors:A1@2026-09-24T13:00:00Z", "air.pm25")]
    assert a == ("2026-09-24T13:00:00Z", "2026-09-24T14:29:00Z", 0.5, 0.45, 180.0)
    assert got[("air_sensors:A1@2026-09-24T14:40:00Z", "air.pm25")][1:4] == ("2026-09-24T14:43:00Z", round(1 / 240, 4), 0.6)
    drops = {(x["feed"], x["drop_reason"]): x["n"] for x in r.ledger.collect()}
    assert drops == {("weather_imd", "unresolved"): 1, ("civic_complaints", "unmapped_type"): 1, ("civic_complaints", "bad_timestamp"): 1,
                     ("civic_complaints", "unresolved"): 1, ("power_discom", "unresolved"): 1, ("drain_scada", "unresolved"): 1,
                     ("drain_scada", "faulty"): 2, ("air_sensors", "faulty"): 2}
    h = {x["feed"]: (x["state"], x["records_total"]) for x in r.health.collect()}
    assert h["weather_imd"][1] == 7 and h["civic_complaints"][1] == 7 and h["power_discom"][1] == 8
    assert "live" in {x[0] for x in h.values()} and "stale" in {x[0] for x in h.values()}


def test_candidates_fold_to_island_episodes(spark, folder):
    f = feeds(spark, folder)
    m = ig.mark_islands(ig.air_readings(f["air"]))
    cols = ["raw_ref", "category", "start_utc", "end_utc", "measure", "confidence", "severity"]
    a = ig.fold(ig.build_events(ig.island_candidates(m))).select(*cols).collect()
    b = ig.fold(ig.build_events(ig.island_episodes(m))).select(*cols).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_two_sources_of_one_signal_stay_two(spark):
    rows = [("power_discom", "r1"), ("civic_complaints", "r1"), ("civic_complaints", "r1")]
    c = spark.createDataFrame([(s, "traffic.signal_down", r, i) for i, (s, r) in enumerate(rows)], "source string, category string, raw_ref string, seq bigint")
    c = (c.withColumn("start_utc", F.timestamp_seconds(F.lit(1000))).withColumn("end_utc", F.lit(None).cast("timestamp")).withColumn("lat", F.lit(26.9)).withColumn("lon", F.lit(75.8))
         .withColumn("h3_cell", F.lit(1).cast("bigint")).withColumn("measure", F.lit(2.0)).withColumn("confidence", F.lit(0.7)).withColumn("resolution", F.lit("registry")))
    folded = ig.fold(ig.build_events(c))
    assert {r["source"]: r["n"] for r in ig.source_split(folded).collect()} == {"power_discom": 1, "civic_complaints": 1}
    assert {r["source"]: r["removed"] for r in ig.fold_counts(folded).collect()} == {"power_discom": 0, "civic_complaints": 1}


def test_truth_document(spark, tmp_path):
    doc = {"scenario": "s", "sim_start_utc": "2026-09-24T12:00:00Z", "sim_end_utc": "2026-09-24T15:00:00Z",
           "planted_situations": [{"truth_id": "GT-1", "expected_chain": ["weather.rain"], "expected_alert_level": "red", "expected_pulse_score": 73,
                                   "member_event_ids": ["a", "b"], "onset_utc": "2026-09-24T12:40:00Z", "detect_by_utc": "2026-09-24T13:40:00Z"}],
           "decoys": [{"decoy_id": "DC-1", "member_event_ids": ["z"], "must_not_alert_above": "yellow"}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=1))
    truths, members, decoys = readers.read_truth(spark, str(tmp_path / "t.json"))
    assert truths.first()["truth_id"] == "GT-1" and members.count() == 2 and [tuple(r) for r in decoys.collect()] == [("DC-1", "z")]


def test_data_version_reports_problems(spark, tmp_path):
    (tmp_path / "raw_weather_imd.jsonl").write_text("{}\n")
    ev = spark.createDataFrame([("complaint.unknown",), ("weather.rain",)], "category string")
    got = {(r["problem"], r["what"]) for r in readers.data_version(spark, str(tmp_path), ev, dims.categories(spark), 1).collect()}
    assert ("unknown category", "complaint.unknown") in got and ("missing feed", "air_sensors") in got and ("older than feed", "weather_imd") in got
