"""Registry of queries over the given tables, the tables' reading as feeds, and shared SQL.

``portable`` SQL derives feed-shaped rows from the tables with expressions both engines read the
same way; the operators then run on them in Spark, and the check SQL states the expected result
independently."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave import vocabulary as v
from cityweave.functions import ids, severity as sv, times
from cityweave.functions.hexgrid import HexGrid
from cityweave.operators.scale import drop_staged
from cityweave.params import Params
from cityweave.sources.readers import ready

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
GRID = HexGrid()
# thresholds suited to the density of the events table
P = Params(lookback_hours=120, p_rare=0.12, rare_thresholds=(0.2, 0.16, 0.12, 0.1, 0.08, 0.05, 0.02, 0.005, 1e-3, 0.0))
ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name  # results are shown with their short ids
        QUERIES[name] = lambda s, d: ids.with_public(fn(s, d))
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf}/{name}.parquet")


def portable(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    text = re.sub(r"@EPOCH\(([^()]*)\)", r"unix_timestamp(cast(\1 as timestamp))", sql)
    return spark.sql(text, **{n: table(spark, sf, n) for n in names})


def duck(sql: str) -> str:
    """The portable text for DuckDB; only names of tables in braces are replaced."""
    text = re.sub(r"@EPOCH\(([^()]*)\)", r"cast(floor(epoch(\1)) as bigint)", sql)
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", text)


def ts(expr: str) -> str:
    """Epoch seconds to ISO text in the check SQL."""
    return f"strftime(make_timestamp(cast(({expr}) * 1000000 as bigint)), {ISO})"


def rnd(expr: str, n: int) -> str:
    """Correctly rounded to n decimals (half-even on the exact value)."""
    return f"cast(format('{{:.{n}f}}', cast({expr} as double)) as double)"


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x) if isinstance(x, int) else f"cast({x!r} as double)"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(lit(i) for i in x) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def when(col: str, mapping: dict, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(k)} THEN {lit(x)}" for k, x in mapping.items()) + f" ELSE {other} END"


CATS = values("cats", "category, feeds, flo, cei, rare", [
    (c, sorted(f), lo, hi, c not in v.SUSTAINED_CATEGORIES) for c, f, lo, hi in v.CATEGORIES])
PAIRS = values("pairs", "cause, effect, lo, hi, why_en, why_hi", [
    (c, e, lo * 60, hi * 60, a, b) for c, e, lo, hi, a, b in v.PLAUSIBLE_PAIRS])
FEEDS = values("feeds", "feed, interval_sec, format, file, feed_en, feed_hi", v.FEEDS)
MARKS = values("marks", "pos, name, name_hi, lat, lon", [(i, *m) for i, m in enumerate(v.LANDMARKS)])


def cells(src: str, out: str) -> str:
    """CTEs adding h3_cell to ``src`` (lat, lon)."""
    import math
    g = GRID
    kx, ky = g._kx / g.edge_m, g._ky / g.edge_m
    return f"""{out}_a AS (SELECT *, (lon - cast({g.lon0!r} as double)) * {kx!r}::double AS _x, (lat - cast({g.lat0!r} as double)) * {ky!r}::double AS _y FROM {src}),
{out}_b AS (SELECT *, _x * {math.sqrt(3) / 3!r}::double - _y / 3 AS _q, _y * 2 / 3 AS _r FROM {out}_a),
{out}_c AS (SELECT *, floor(_q + 0.5) AS _rq, floor(_r + 0.5) AS _rr, floor(-_q - _r + 0.5) AS _rs FROM {out}_b),
{out}_d AS (SELECT *, abs(_rq - _q) AS _dq, abs(_rr - _r) AS _dr, abs(_rs + _q + _r) AS _ds FROM {out}_c),
{out} AS (SELECT * EXCLUDE (_x, _y, _q, _r, _rq, _rr, _rs, _dq, _dr, _ds), CASE WHEN lat IS NULL OR lon IS NULL THEN NULL ELSE
 (cast(CASE WHEN _dq > _dr AND _dq > _ds THEN -_rr - _rs ELSE _rq END as bigint) + 1048576) * 2097152
 + cast(CASE WHEN _dq > _dr AND _dq > _ds THEN _rr WHEN _dr > _ds THEN -_rq - _rs ELSE _rr END as bigint) + 1048576 END AS h3_cell FROM {out}_d)"""


def q_of(c: str) -> str:
    return f"({c} // 2097152 - 1048576)"


def r_of(c: str) -> str:
    return f"({c} % 2097152 - 1048576)"


def dist(a: str, b: str) -> str:
    dq, dr = f"({q_of(b)} - {q_of(a)})", f"({r_of(b)} - {r_of(a)})"
    return f"greatest(abs({dq}), abs({dr}), abs({dq} + {dr}))"


def hav(la1, lo1, la2, lo2) -> str:
    return (f"(2 * 6371.0088::double * asin(sqrt(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2}))"
            f" * pow(sin(radians({lo2} - {lo1}) / 2), 2))))")


# ------------------------------------------------------------------ events as feed rows -----
_pad = lambda f, n=2: f"lpad(cast({f}(ts) as string), {n}, '0')"
ROWS = f"""SELECT event_id, user_id, event_type, value, @EPOCH(ts) AS t,
 {_pad('year', 4)} || '-' || {_pad('month')} || '-' || {_pad('day')} || 'T' || {_pad('hour')} || ':' || {_pad('minute')} || ':' || {_pad('second')} AS naive_iso,
 {_pad('day')} || '/' || {_pad('month')} || '/' || {_pad('year', 4)} || ' ' || cast((hour(ts) + 11) % 12 + 1 as string) || ':' || {_pad('minute')}
   || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS register_time,
 {_pad('day')} || '/' || {_pad('month')} || '/' || {_pad('year', 4)} || ' ' || {_pad('hour')} || ':' || {_pad('minute')} AS scada_time,
 floor(value * 10) / 10 AS tenth, cast(floor(value) as bigint) AS whole,
 cast('U-' as string) || cast(user_id as string) AS entity,
 268e-1 + (user_id % 30) * 4e-3 + 3e-2 AS lat, 757e-1 + (user_id % 29) * 5e-3 + 3e-2 AS lon
 FROM {{events}}"""

# canonical events read from the events table: five event types play five kinds of reports
CANON = """SELECT 'ev-' || lpad(cast(event_id as string), 12, '0') AS event_id, event_id AS seq, user_id, @EPOCH(ts) AS t,
 CASE event_type WHEN 'view' THEN 'weather_imd' WHEN 'error' THEN 'power_discom'
   WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'power_discom' ELSE 'civic_complaints' END ELSE 'civic_complaints' END AS source,
 CASE event_type WHEN 'view' THEN CASE WHEN user_id % 4 = 3 THEN 'weather.heat' ELSE 'weather.rain' END WHEN 'error' THEN 'power.outage'
   WHEN 'signup' THEN 'traffic.signal_down' WHEN 'click' THEN 'complaint.waterlogging' ELSE 'complaint.road_damage' END AS category,
 CASE event_type WHEN 'view' THEN CASE WHEN user_id % 4 = 3 THEN 2e1 + value * 3e-1 ELSE value * 4e-1 END WHEN 'error' THEN value * 4e1
   WHEN 'signup' THEN value * 5e-2 ELSE value * 1e-1 END AS measure,
 CASE event_type WHEN 'view' THEN 9e-1 WHEN 'error' THEN 72e-2 WHEN 'signup' THEN 72e-2 ELSE CASE WHEN value < 2e0 THEN 45e-2 ELSE 6e-1 END END AS confidence,
 CASE WHEN value < 6e1 THEN @EPOCH(ts) + cast(floor(value) as bigint) * 60 END AS t_end,
 268e-1 + (user_id % 30) * 4e-3 + 3e-2 AS lat, 757e-1 + (user_id % 29) * 5e-3 + 3e-2 AS lon
 FROM {events}"""
INTERVAL = when("source", {f[0]: f[1] for f in v.FEEDS})


def rows(spark, sf) -> DataFrame:
    return portable(spark, sf, ROWS)


def canon(spark, sf) -> DataFrame:
    d = portable(spark, sf, CANON)
    d = (d.filter(sv.crosses_floor(F.col("category"), F.col("measure")))
         .withColumn("severity", sv.severity(F.col("category"), F.col("measure")))
         .withColumn("h3_cell", GRID.cell(F.col("lat"), F.col("lon")))
         .withColumn("start_utc", F.timestamp_seconds("t")).withColumn("end_utc", F.timestamp_seconds("t_end"))
         .withColumn("received_at", sv.received_at(F.col("start_utc"), sv.interval_of(F.col("source"))))
         .withColumn("freshness_sec", sv.freshness(F.col("received_at"), F.col("start_utc")))
         .withColumn("is_simulated", F.lit(True)).withColumn("resolution", F.lit("direct")))
    return d.withColumn("raw_ref", F.concat("source", F.lit(":U-"), F.col("user_id").cast("string"), F.lit("@"), F.col("t").cast("string")))


EV = (CATS + ",\ncanon0 AS (" + duck(CANON) + "),\n" + cells("canon0", "canon1") + f""",
ev AS (SELECT c.*, CASE WHEN measure <= flo THEN 0.0 ELSE {rnd("least(1.0, (measure - flo) / (cei - flo))", 4)} END AS severity,
  t + {INTERVAL} AS t_recv, source || ':U-' || cast(user_id as string) || '@' || cast(t as string) AS raw_ref
  FROM canon1 c JOIN cats USING (category) WHERE measure >= flo)""")


def iso(c):
    return times.iso(F.col(c) if isinstance(c, str) else c)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c, sep=","):
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), sep)


_MEMO: dict = {}


def memo(spark, sf, key: str, build):
    """Stage tables shared by several queries are built once per session and data folder."""
    k = (spark.sparkContext.applicationId, sf, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def forget(spark=None):
    """Start from nothing staged; with a session, the staged tables are deleted too."""
    _MEMO.clear()
    if spark is not None:
        drop_staged(spark)
