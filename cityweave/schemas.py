"""Explicit schemas (DDL) of the feeds and of the tables the pipeline exchanges."""

WEATHER = ("station_id string, ts bigint, lat double, lon double, rain_mm_15min double, "
             "temp_c double, rh_pct int, wind_kph int")
COMPLAINT_DDL = ("complaint_id string, lodged_at string, ward string, locality string, "
                 "landmark string, complaint_type string, text string, status string")
COMPLAINT = COMPLAINT_DDL
POWER = ("feeder_id string, substation string, event string, reported_time string, "
           "est_restore_min int, affected_connections int, carries_signals boolean, "
           "signal_junctions int, cause string")
DRAIN = ("rtu string, polled string, ch array<struct<tag:string,v:double>>")
AIR = ("sensor string, captured string, pm25 double, pm10 double, "
         "loc struct<latitude:double,longitude:double>, calibrated boolean, battery_pct int")
FEEDER_REGISTRY_VALUE = ("struct<lat:double,lon:double,h3_cell:string,name:string,"
                         "carries_signals:boolean,signal_junctions:int,connections:int>")
DRAIN_REGISTRY_VALUE = "struct<lat:double,lon:double,h3_cell:string,name:string,capacity_cm:double>"
EVENT = ("event_id string, source string, category string, h3_cell bigint, lat double, lon double, "
           "start_utc timestamp, end_utc timestamp, severity double, confidence double, "
           "received_at timestamp, freshness_sec bigint, is_simulated boolean, raw_ref string, "
           "resolution string, measure double")
ANOMALY = ("anomaly_id string, h3_cell bigint, category string, window_start_utc timestamp, "
             "window_end_utc timestamp, observed_count bigint, expected_count double, p_value double, "
             "`trigger` string, severity_weighted double, source_feeds array<string>, "
             "degraded_by_stale_feeds array<string>")
TRUTH = ("scenario string, sim_start_utc string, sim_end_utc string, "
           "planted_situations array<struct<truth_id:string,expected_chain:array<string>,"
           "expected_alert_level:string,expected_pulse_score:int,member_event_ids:array<string>,"
           "onset_utc:string,detect_by_utc:string>>, "
           "decoys array<struct<decoy_id:string,member_event_ids:array<string>,must_not_alert_above:string>>")
FEEDS = {"weather_imd": WEATHER, "civic_complaints": COMPLAINT, "power_discom": POWER,
         "drain_scada": DRAIN, "air_sensors": AIR}
