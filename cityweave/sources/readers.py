"""Feed, registry and table scans with explicit schemas, and the sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas, vocabulary as v
from ..functions import ids, times
from ..functions.hexgrid import HexGrid
from ..operators.scale import id_pages


def ready(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on. A local session that names no ``spark.checkpoint.dir``
    stages its tables below its warehouse; on a cluster the setting is required."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.conf.get("spark.master", "").startswith("local"):
        spark.conf.set("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def with_arrival(df: DataFrame) -> DataFrame:
    """Arrival order of a file scan as one gapless bigint ``seq``: files by path, blocks of a file by
    place, rows of a block as they stand. Spark packs files into tasks by size, so the task order is
    not that order; the rows before each block come from one count a block."""
    d = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                  F.monotonically_increasing_id().alias("_at"))
    blocks = d.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_path", "_start")) - F.col("_n")  # one row a block of a file
    d = d.join(blocks.select("_path", "_start", "_first", before.alias("_before")), ["_path", "_start"])
    return d.withColumn("seq", F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, "seq")


def read_jsonl(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """JSON lines of a feed, read as lines so that a bad one stays whole, with ``parsed_ok`` false
    and a reason; blank lines are skipped."""
    return parse_json_lines(with_arrival(spark.read.text(path)), feed)


def parse_json_lines(lines: DataFrame, feed: str, line: str = "value") -> DataFrame:
    """The same over a column of lines (a stream or a text table). Only a line that isn't a JSON
    object is bad; in a good one a value of another type is cast, or null where it can't be."""
    kept = lines.filter(F.trim(line) != "")
    ddl = schemas.FEEDS[feed] + ", _corrupt string"
    d = kept.withColumn("_r", F.from_json(line, ddl, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    d = d.withColumn("_v", F.when(F.col("_r._corrupt").isNotNull(), F.try_parse_json(line)))
    off_type = F.schema_of_variant("_v").startswith("OBJECT")
    d = d.withColumn("_off", F.coalesce(off_type, F.lit(False)))
    fields = d.schema["_r"].dataType.fields
    cast = [F.when(F.col("_off"), F.try_variant_get("_v", F.lit(f"$.{f.name}"), f.dataType.simpleString())).otherwise(F.col(f"_r.{f.name}")).alias(f.name)
            for f in fields if f.name != "_corrupt"]
    bad = F.col("_r._corrupt").isNotNull() & ~F.col("_off")
    return d.select(*[c for c in lines.columns if c != line], *cast, F.when(bad, F.col("_r._corrupt")).alias("raw"), (~bad).alias("parsed_ok"),
                    F.when(bad, "Invalid JSON").alias("reason"))


def parse_complaint_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Register lines to fields; each row keeps its literal line. Header and blank lines go."""
    header = schemas.COMPLAINT_DDL.replace(" string", "").replace(", ", ",")
    d = lines.filter((F.trim(line) != "") & (F.col(line) != header))
    return (d.withColumn("_r", F.from_csv(line, schemas.COMPLAINT_DDL, {"mode": "PERMISSIVE"}))
            .select(*[c for c in lines.columns if c != line], F.col(line).alias("raw"), "_r.*"))


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    return parse_complaint_lines(with_arrival(spark.read.text(path)))


def parse_registry(docs: DataFrame, value_type: str, doc: str = "value") -> DataFrame:
    """One row per id of a JSON object {id: {...}}."""
    m = F.from_json(doc, f"map<string,{value_type}>")
    return docs.select(F.explode(m).alias("id", "_v")).select("id", "_v.*")


def read_registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    t = {"feeder": schemas.FEEDER_REGISTRY_VALUE, "drain": schemas.DRAIN_REGISTRY_VALUE}[kind]
    return parse_registry(spark.read.option("wholetext", True).text(path), t)


def parse_gazetteer(docs: DataFrame, grid: HexGrid, doc: str = "value") -> DataFrame:
    t = "struct<landmarks:array<struct<name:string,name_hi:string,lat:double,lon:double>>>"
    d = docs.select(F.posexplode(F.from_json(doc, t)["landmarks"]).alias("pos", "_l")).select("pos", "_l.*")
    return d.withColumn("h3_cell", grid.cell(F.col("lat"), F.col("lon")))


def read_gazetteer(spark: SparkSession, path: str, grid: HexGrid) -> DataFrame:
    return parse_gazetteer(spark.read.option("wholetext", True).text(path), grid)


def read_truth(spark: SparkSession, path: str):
    """(truths, truth members, decoy members) of a ground-truth document."""
    return explode_truth(spark.read.schema(schemas.TRUTH).option("multiLine", True).json(path))


def explode_truth(doc: DataFrame):
    ts = doc.select(F.posexplode("planted_situations").alias("pos", "s"))
    truths = ts.select("s.truth_id", "pos", "s.expected_alert_level", times.from_iso_z(F.col("s.onset_utc")).alias("onset_utc"),
                       times.from_iso_z(F.col("s.detect_by_utc")).alias("detect_by_utc"))
    members = ts.select("s.truth_id", F.explode("s.member_event_ids").alias("event_id"))
    decoys = (doc.select(F.explode("decoys").alias("d")).select("d.decoy_id", F.explode("d.member_event_ids").alias("event_id")))
    return truths, members, decoys


def raw_identity(records: DataFrame, feed: str) -> DataFrame:
    """Add raw_ref, entity_ref and t_utc (time text) to raw feed rows."""
    ref, ent, t = ids.record_identity(feed)
    return records.withColumn("raw_ref", ref).withColumn("entity_ref", ent).withColumn("t_utc", t)


# ------------------------------------------------------------------ sinks -------------------
def write_events(events: DataFrame, path: str) -> None:
    """Canonical store: partitioned by day, sorted inside, so as-of reads prune."""
    (events.withColumn("date", F.to_date("start_utc")).repartitionByRange("date", "start_utc")
     .sortWithinPartitions("date", "start_utc", "event_id").write.partitionBy("date").parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVENT).parquet(path)


def as_json_lines(df: DataFrame, order: list) -> DataFrame:
    """Document rows in sink order with internal (underscore) fields left out and times as text."""
    cols = [times.iso(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
            for f in df.schema.fields if not f.name.startswith("_")]
    return df.orderBy(*order).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, order: list) -> None:
    as_json_lines(df, order).write.text(path)


def anomaly_documents(anomalies: DataFrame, members: DataFrame, page_size: int = 10_000) -> DataFrame:
    """Anomalies with their event ids, one row per page of ids in their order."""
    pages = id_pages(members, "anomaly_id", "event_id", page_size)
    return ids.with_public(anomalies.join(pages, "anomaly_id").withColumnRenamed("ids", "contributing_event_ids"))


def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(feed, present, modified): which raw files exist and how new they are."""
    hconf = spark._jsc.hadoopConfiguration()
    path_t = spark._jvm.org.apache.hadoop.fs.Path
    rows = []
    for feed, _, _, name, *_ in v.FEEDS:
        p = path_t(f"{folder}/{name}")
        fs = p.getFileSystem(hconf)
        ok = fs.exists(p)
        rows.append((feed, ok, int(fs.getFileStatus(p).getModificationTime() // 1000) if ok else None))
    return spark.createDataFrame(rows, "feed string, present boolean, modified bigint")


def data_version(spark: SparkSession, folder: str, events: DataFrame, cats: DataFrame, derived_modified: int = None, chain: DataFrame = None) -> DataFrame:
    """One row per problem: missing feeds, unknown categories of events and of situations' steps,
    derived tables older than feeds."""
    from ..operators.quality import data_problems
    files = feed_files(spark, folder)
    a = files.filter("not present").select(F.lit("missing feed").alias("problem"), F.col("feed").alias("what"))
    b = data_problems(events, cats, chain).select(F.lit("unknown category").alias("problem"), F.col("category").alias("what"))
    c = (files.filter(F.col("modified") > F.lit(derived_modified)).select(F.lit("older than feed").alias("problem"), F.col("feed").alias("what"))
         if derived_modified is not None else a.limit(0))
    return a.unionByName(b).unionByName(c)
