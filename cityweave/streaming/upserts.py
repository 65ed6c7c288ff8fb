"""Canonical events from streams, one row an event: a store of versions, upserted batch by batch.

A micro-batch is worked on by the batch operators, so a hot entity is cut into chunks there as well. What is
open at its end is a table of one row a key, a sum of segments: an episode's segment is a set of sums,
minima and maxima, so what an earlier batch left open is the left operand of the batch's first segment. Batch n
reads the state that batch n - 1 left and nothing older, and writes its own folders alone, so a batch that
is run again changes nothing."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import ingest as ig
from ..operators.scale import delete_staged, stage
from ..params import DEFAULT, Params

KEYS = ["raw_ref", "category", "source"]  # what tells most rows apart comes first: sorts compare it first
#: a version: an event as far as it is known; ``opener`` tells episodes apart that share a reference
VERSION = ("source string, entity string, category string, opener bigint, seq bigint, raw_ref string, start_utc timestamp, end_utc timestamp, lat double, lon double, "
           "h3_cell bigint, measure double, confidence double, resolution string, cap double, n_candidates bigint")
CANDIDATE = ["source", "entity", "category", "seq", "raw_ref", "start_utc", "end_utc", "lat", "lon", "h3_cell", "measure", "confidence", "resolution"]


class Carried:
    """Tables that a ``foreachBatch`` function leaves for the next batch, below ``path``."""

    def __init__(self, path: str):
        self.path = path

    def folder(self, name: str, n: int) -> str:
        return f"{self.path}/{name}/batch={n}"

    def before(self, spark: SparkSession, name: str, schema, n: int) -> DataFrame:
        """What batch n - 1 left; nothing before batch 0."""
        return spark.read.schema(schema).parquet(self.folder(name, n - 1)) if n else spark.createDataFrame([], schema)

    def leave(self, table: DataFrame, name: str, n: int) -> None:
        """Leave a table for batch n + 1. That of batch n - 2 isn't needed even if this batch is run again."""
        table.write.mode("overwrite").parquet(self.folder(name, n))
        if n > 1:
            delete_staged(table.sparkSession, [self.folder(name, n - 2)])

    def settle(self, table: DataFrame, name: str, n: int) -> None:
        """Write a table once: a batch that is run again keeps to the first one."""
        if not self._there(table.sparkSession, f"{self.folder(name, n)}/_SUCCESS"):
            table.write.mode("overwrite").parquet(self.folder(name, n))

    def settled(self, spark: SparkSession, name: str, schema, n: int) -> DataFrame:
        return spark.read.schema(schema).parquet(self.folder(name, n))

    @staticmethod
    def _there(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def put(self, table: DataFrame, name: str, n: int) -> None:
        """Add a batch's part of a result, which stays."""
        table.write.mode("overwrite").parquet(self.folder(name, n))


def own(write):
    """A ``foreachBatch`` function from one that is also given ``keep(table, name)`` to stage with: what it
    stages goes with the batch. Streams that run side by side don't meet."""
    def run(batch: DataFrame, n: int) -> None:
        held: list[str] = []
        try:
            write(batch, n, lambda table, name: stage(table, name, held))
        finally:
            delete_staged(batch.sparkSession, held)
    return run


def together(spark: SparkSession, *writes) -> None:
    """Writes that don't need each other, side by side: the last tasks of one leave cores to the others."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]:
            done.result()


def _dated(versions: DataFrame) -> DataFrame:
    """With the date of the start, in its order, so that a reader of some days skips the rest of a file. A folder a
    day would be as many files a batch as it touches days."""
    names = [f.split()[0] for f in VERSION.split(", ")]
    return versions.select(*names, F.to_date("start_utc").alias("date")).sortWithinPartitions("date")


# ------------------------------------------------------------------ episodes -----------------
EPISODE = ["entity", "category", "source"]
SEGMENT = ("source string, entity string, category string, island bigint, n_above bigint, n_emitted bigint, breaks bigint, fresh bigint, "
           "open struct<seq:bigint,raw_ref:string,t:timestamp>, peak double, peak_emitted double, end_utc timestamp, confidence double, "
           "first struct<seq:bigint,lat:double,lon:double,h3_cell:bigint,resolution:string>")


def segments(marked: DataFrame) -> DataFrame:
    """One row per island of ``ingest.mark_islands`` rows: sums, minima and maxima, which ``joined`` joins."""
    above, located = F.col("above"), F.col("located")
    return marked.groupBy(*EPISODE, "island").agg(
        F.count(F.when(above, 1)).alias("n_above"), F.count(F.when(located, 1)).alias("n_emitted"), F.count(F.when(~above, 1)).alias("breaks"), F.count("*").alias("fresh"),
        F.min(F.when(above, F.struct("seq", "raw_ref", "t"))).alias("open"), F.max(F.when(above, F.col("measure"))).alias("peak"),
        F.max(F.when(above & located, F.col("measure"))).alias("peak_emitted"), F.max(F.when(~above & located, F.col("t"))).alias("end_utc"),
        F.min(F.when(located, F.col("confidence"))).alias("confidence"), F.min(F.when(located, F.struct("seq", "lat", "lon", "h3_cell", "resolution"))).alias("first"))


def joined(parts: DataFrame) -> DataFrame:
    """Segments of one island as one; the order of the parts doesn't matter."""
    return parts.groupBy(*EPISODE, "island").agg(
        *[F.sum(c).alias(c) for c in ("n_above", "n_emitted", "breaks", "fresh")], F.min("open").alias("open"), F.max("peak").alias("peak"),
        F.max("peak_emitted").alias("peak_emitted"), F.max("end_utc").alias("end_utc"), F.min("confidence").alias("confidence"), F.min("first").alias("first"))


def episode_writer(path: str, p: Params = DEFAULT, drop_unlocated: bool = False, candidates: bool = False):
    """``foreachBatch`` function over readings: writes a version of every episode that a batch touches, and
    with ``candidates`` a row for every contributing reading. What it carries is one open episode a key."""
    state = Carried(path)

    @own
    def write(batch: DataFrame, n: int, keep) -> None:
        spark = batch.sparkSession
        marked = ig.mark_islands(batch, p, drop_unlocated)  # the search for hot keys reads the keys' columns alone
        marked = keep(marked, "live-marked") if candidates else marked  # read once more below
        left = state.before(spark, "open", SEGMENT, n)
        parts = segments(marked).filter("n_above > 0 or island = 0")  # of the others, breaks alone, only the first may close what was left open
        whole = keep(joined(parts.unionByName(left)), "live-segments")
        seen = whole.filter("fresh > 0 and n_above > 0 and n_emitted > 0")
        closed = F.col("end_utc").isNotNull()
        versions = seen.select(
            *EPISODE, F.col("open.seq").alias("opener"), F.col("first.seq").alias("seq"), F.col("open.raw_ref").alias("raw_ref"), F.col("open.t").alias("start_utc"), "end_utc",
            "first.lat", "first.lon", "first.h3_cell", F.when(closed, F.col("peak")).otherwise(F.col("peak_emitted")).alias("measure"), "confidence", "first.resolution",
            F.lit(None).cast("double").alias("cap"), F.col("n_emitted").alias("n_candidates"))
        still = whole.filter("breaks = 0 and n_above > 0").withColumn("island", F.lit(0).cast("bigint")).withColumn("fresh", F.lit(0).cast("bigint"))
        writes = [lambda: state.put(_dated(versions), "versions", n), lambda: state.leave(still, "open", n)]
        if candidates:
            head = whole.filter("n_above > 0").select(*EPISODE, "island", "open", "peak")
            d = marked.filter("located").join(head, [*EPISODE, "island"])
            c = d.select(*EPISODE, "seq", F.col("open.raw_ref").alias("raw_ref"), F.col("open.t").alias("start_utc"), F.when(~F.col("above"), F.col("t")).alias("end_utc"),
                         "lat", "lon", "h3_cell", F.when(F.col("above"), F.col("measure")).otherwise(F.col("peak")).alias("measure"), "confidence", "resolution")
            writes.append(lambda: state.put(c, "candidates", n))
        together(spark, *writes)

    return write


# ------------------------------------------------------------------ outages ------------------
TRIP = ["seq", "raw_ref", "t", "emits", "cap", "lat", "lon", "h3_cell", "confidence", "resolution", "source"]
OPEN_TRIP = ("entity string, opened bigint, o struct<seq:bigint,raw_ref:string,t:timestamp,emits:array<struct<category:string,measure:double>>,cap:double,lat:double,lon:double,"
             "h3_cell:bigint,confidence:double,resolution:string,source:string>, r struct<seq:bigint,t:timestamp>, fresh bigint, fresh_trip bigint")


def outage_writer(path: str, p: Params = DEFAULT, candidates: bool = False):
    """``foreachBatch`` function over power records: writes a version of every trip that a batch opens or
    closes, and with ``candidates`` a row for each opening and closing. What it carries is one open trip a feeder."""
    state = Carried(path)

    @own
    def write(batch: DataFrame, n: int, keep) -> None:
        spark = batch.sparkSession
        paired = ig.pair_outages(keep(batch, "live-batch"), p)
        opens, restore = F.col("opens"), F.col("is_restore")
        new = paired.groupBy("entity", "opened").agg(
            F.max(F.when(opens, F.struct(*TRIP))).alias("o"), F.min(F.when(restore, F.struct("seq", "t"))).alias("r"),
            F.count(F.when(opens | restore, 1)).alias("fresh"), F.count(F.when(opens, 1)).alias("fresh_trip"))
        left = state.before(spark, "open", OPEN_TRIP, n)  # the trip before the batch's first one
        whole = new.unionByName(left).groupBy("entity", "opened").agg(F.max("o").alias("o"), F.min("r").alias("r"), F.sum("fresh").alias("fresh"), F.sum("fresh_trip").alias("fresh_trip"))
        whole = keep(whole.filter("o is not null"), "live-trips")
        d = whole.filter("fresh > 0").select("entity", "r", "fresh_trip", "o.*").withColumn("e", F.explode("emits"))
        row = ["source", "entity", F.col("e.category").alias("category"), "seq", "raw_ref", F.col("t").alias("start_utc")]
        place = ["lat", "lon", "h3_cell", F.col("e.measure").alias("measure"), "confidence", "resolution"]
        versions = d.select(*row, F.col("seq").alias("opener"), F.col("r.t").alias("end_utc"), *place, "cap", (F.lit(1) + F.col("r").isNotNull().cast("bigint")).alias("n_candidates"))
        last = whole.groupBy("entity").agg(F.max_by(F.struct("o", "r"), "opened").alias("x"))
        zero = F.lit(0).cast("bigint")
        still = last.filter("x.r is null").select("entity", zero.alias("opened"), "x.o", "x.r", zero.alias("fresh"), zero.alias("fresh_trip"))
        writes = [lambda: state.put(_dated(versions), "versions", n), lambda: state.leave(still, "open", n)]
        if candidates:
            opened = d.filter("fresh_trip > 0").select(*row, F.lit(None).cast("timestamp").alias("end_utc"), *place, "cap")
            both = opened.unionByName(d.filter("r is not null").select(*row, F.col("r.t").alias("end_utc"), *place, "cap"))
            writes.append(lambda: state.put(both, "candidates", n))
        together(spark, *writes)

    return write


# ------------------------------------------------------------------ complaints ---------------
RECENT = VERSION + ", event_id string, start_sec bigint"


def complaint_writer(path: str, p: Params = DEFAULT, late_sec: int = 600):
    """``foreachBatch`` function over register records: writes a version of every complaint that a batch brings
    or changes. Severity counts the like complaints of the cell in the window before, so a late record
    raises those after it, which get a new version. What is carried is the complaints of the last
    window and ``late_sec``; records later than that are left out."""
    state = Carried(path)
    changing = ["start_utc", "end_utc", "measure", "confidence", "n_candidates"]

    @own
    def write(batch: DataFrame, n: int, keep) -> None:
        spark = batch.sparkSession
        clock = state.before(spark, "clock", "latest bigint", n).agg(F.max("latest")).first()[0]
        known = state.before(spark, "recent", RECENT, n)
        new = ig.complaint_candidates(batch)
        if clock is not None:
            new = new.filter(times.epoch(F.col("start_utc")) >= clock - late_sec)
        new = new.withColumn("cap", F.lit(None).cast("double")).withColumn("n_candidates", F.lit(1).cast("bigint"))
        both = known.select(*new.columns).unionByName(new)
        least = F.min(F.struct("seq", "entity", "lat", "lon", "h3_cell", "resolution")).alias("f")
        folded = both.groupBy(*KEYS).agg(F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc"), F.min("confidence").alias("confidence"),
                                         F.sum("n_candidates").alias("n_candidates"), least)
        d = folded.select(*KEYS, "start_utc", "end_utc", "confidence", "n_candidates", "f.*", F.concat_ws("|", "raw_ref", "category").alias("event_id"),
                          F.lit(1.0).alias("measure"), F.lit(None).cast("double").alias("severity"))
        counted = ig.cluster_complaints(keep(d, "live-recent"), p).drop("severity")
        old = known.select(*KEYS, F.struct(*changing).alias("_old"))
        # what is older than any record that still counts is settled: its own window may no longer be whole here
        settled = F.col("_old").isNotNull() & (times.epoch(F.col("start_utc")) < (clock - late_sec if clock is not None else 0))
        d = counted.join(old, KEYS, "left").withColumn("measure", F.when(settled, F.col("_old.measure")).otherwise(F.col("measure")))
        d = keep(d.withColumn("_fresh", F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.struct(*changing))), "live-clustered")
        fresh, d = d.filter("_fresh").drop("_old", "_fresh"), d.drop("_old", "_fresh")
        made = lambda x: x.withColumn("opener", F.lit(0).cast("bigint")).withColumn("cap", F.lit(None).cast("double"))
        state.put(_dated(made(fresh)), "versions", n)
        top = d.agg(F.max(times.epoch(F.col("start_utc")))).first()[0]
        latest = max((t for t in (clock, top) if t is not None), default=None)
        kept = made(d).withColumn("start_sec", times.epoch(F.col("start_utc")))
        kept = kept if latest is None else kept.filter(F.col("start_sec") >= latest - late_sec - p.cluster_window_sec)
        state.leave(kept.select(*[f.split()[0] for f in RECENT.split(", ")]), "recent", n)
        state.leave(spark.range(0, 1, 1, 1).select(F.lit(latest).cast("bigint").alias("latest")), "clock", n)

    return write


# ------------------------------------------------------------------ the store ----------------
def latest_versions(spark: SparkSession, paths, days: Column | None = None) -> DataFrame:
    """The last version of every episode, trip or complaint in the stores below ``paths``; ``days`` restricts the
    dates of starts that are read (a condition on ``date``). All versions of an event meet in one task, sorted, so
    that folding them needs no further shuffle; they are as many as the batches and openings that share its reference."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    d = spark.read.schema(VERSION + ", date date, batch bigint")
    d = reduce(DataFrame.unionByName, [d.parquet(f"{path}/versions") for path in paths])
    d = d if days is None else d.filter(days)
    rest = [c for c in d.columns if c not in (*KEYS, "opener", "batch", "date")]
    return d.repartition(*KEYS).groupBy(*KEYS, "opener").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*KEYS, "opener", "x.*")


def current_events(spark: SparkSession, paths, p: Params = DEFAULT, days: Column | None = None) -> DataFrame:
    """Canonical events as far as they are known, one row an event, from the stores below ``paths``."""
    built = ig.build_events(latest_versions(spark, paths, days), p.namespace).drop("n_candidates")
    return ig.fold(built).drop("seq", "n_candidates")


def compact(spark: SparkSession, path: str, n: int) -> None:
    """Replace the versions of batches 0 to n by the last ones, as those of batch n; batch n + 1 may not have
    begun. The new folder is whole before the old ones go."""
    last = latest_versions(spark, path).select(*[f.split()[0] for f in VERSION.split(", ")])
    held: list[str] = []
    ranged = stage(_dated(last), "live-compacted", held).repartitionByRange("date").sortWithinPartitions("date", *KEYS)
    ranged.write.mode("overwrite").parquet(f"{path}/versions/batch={n}")
    delete_staged(spark, held + [f"{path}/versions/batch={k}" for k in range(n)])
