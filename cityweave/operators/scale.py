"""Building blocks that keep ordered and iterative operators whole under skew.

One entity, cell or category may hold a third of all rows, so nothing here sorts or
collects a full key in one task: running operators work per (key, chunk) and carry chunk
totals; as-of lookups work per (key, time bucket)."""
from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import ids

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
PAGE = 10_000
HOT_ROWS = 200_000  # a key of more rows is cut into chunks; others are sorted whole, spilling as they must


def stage_root(spark) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return root


_staged: list[str] = []


def stage(df: DataFrame, name: str, owner: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and the data
    survives the loss of any executor. Who no longer needs what was staged drops it, with
    ``staging`` or ``drop_staged``; an ``owner`` is given the path and deletes it."""
    path = f"{stage_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_staged if owner is None else owner).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_count() -> int:
    return len(_staged)


def take_staged(since: int) -> list[str]:
    """Take over the tables staged after the first ``since``: who takes them deletes them."""
    taken = _staged[since:]
    del _staged[since:]
    return taken


def delete_staged(spark, paths: list[str]) -> None:
    path_t, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = path_t(path)
        p.getFileSystem(conf).delete(p, True)


def drop_staged(spark, since: int = 0) -> None:
    """Delete the tables staged by this process, or those after the first ``since``."""
    delete_staged(spark, take_staged(since))


@contextmanager
def staging(spark):
    """What is staged inside is deleted at the end; results must have been written by then."""
    mark = len(_staged)
    try:
        yield
    finally:
        drop_staged(spark, mark)


def release(spark) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them when the driver's garbage is
    collected, which on a quiet driver may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that the side is within ``max_rows`` and, as text,
    ``max_bytes``; a larger side goes unhinted to a shuffle join (split by AQE where a key is hot)."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, most = df.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= max_rows and (most or 0) <= max_bytes else df


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as scalar subqueries: computed once, no join."""
    return df.select("*", *[row.select(c).scalar().alias(c) for c in row.columns])


def one_row(*rows: DataFrame) -> DataFrame:
    """The columns of several one-row aggregates side by side."""
    return rows[0].sparkSession.range(1).select(*[r.select(c).scalar().alias(c) for r in rows for c in r.columns])


def running_before(df: DataFrame, keys: list, order: list, chunk: Column, value: Column,
                   out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per key in ``order``.

    ``chunk`` must be non-decreasing along the order. Rows are sorted per (key, chunk) and
    chunk totals, one row each, carry the sum over; so the hot key is spread over its chunks."""
    d = df.withColumn("_chunk", chunk).withColumn("_val", value.cast("bigint"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    totals = d.groupBy(*keys, "_chunk").agg(F.sum("_val").alias("_tot"))
    carry = totals.select(*keys, "_chunk", (F.sum("_tot").over(
        Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_tot")).alias("_carry"))
    d = d.withColumn("_run", F.sum("_val").over(
        local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_val"))
    return (d.join(carry, [*keys, "_chunk"])
            .withColumn(out, F.col("_run") + F.col("_carry"))
            .drop("_chunk", "_val", "_run", "_carry"))


def hot_keys(df: DataFrame, keys: list, n: Column | None = None) -> DataFrame | None:
    """The keys of more than ``HOT_ROWS`` rows; None if there are none, which one count a key tells. ``n``: the rows
    that a row of ``df`` stands for."""
    hot = df.groupBy(*keys).agg((F.count("*") if n is None else F.sum(n)).alias("_n")).filter(F.col("_n") > HOT_ROWS).select(*keys)
    return None if hot.isEmpty() else hot


def running_before_hot(df: DataFrame, keys: list, order: list, chunk: Column, value: Column, out: str,
                       whole: bool = False) -> DataFrame:
    """``running_before`` for tables of many keys, of which few or none are hot: a key of at most ``HOT_ROWS`` rows is
    one chunk whatever ``chunk`` says, so it needs no totals and no join. Null keys are keys like others. ``whole``: no
    key is hot, as the caller has counted."""
    d, at = df.withColumn("_val", value.cast("bigint")), [F.col(k) for k in keys]
    run = F.sum("_val").over
    before = lambda *by: run(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_val")
    hot = None if whole else hot_keys(df, keys)
    if hot is None:
        return d.withColumn(out, before(*at)).drop("_val")
    same = lambda a, b, on: [a[k].eqNullSafe(b[f"_{k}_"]) for k in on]
    named = lambda x, on: x.withColumnsRenamed({k: f"_{k}_" for k in on})
    hot = broadcast_if_small(named(hot, keys).withColumn("_hot", F.lit(True)))
    d = d.join(hot, same(d, hot, keys), "left").drop(*[f"_{k}_" for k in keys])
    d = d.withColumn("_chunk", F.when(F.col("_hot"), chunk))
    d = d.repartition(*at, F.col("_chunk"))  # else rows that a join has brought together by key would stay in one task
    totals = d.filter("_hot").groupBy(*keys, "_chunk").agg(F.sum("_val").alias("_tot"))
    carry = totals.select(*keys, "_chunk", (F.sum("_tot").over(Window.partitionBy(*keys).orderBy("_chunk")) - F.col("_tot")).alias("_carry"))
    d = d.withColumn("_run", before(*at, F.col("_chunk")))
    on = [*keys, "_chunk"]
    carry = named(carry, on)
    d = d.join(carry, same(d, carry, on), "left").withColumn(out, F.col("_run") + F.coalesce("_carry", F.lit(0)))
    return d.drop("_val", "_run", "_carry", "_hot", "_chunk", *[f"_{k}_" for k in on])


def rank_in(df: DataFrame, keys: list, order: list, chunk: Column, out: str) -> DataFrame:
    """1-based position per key in ``order``, by chunks (see ``running_before``)."""
    return running_before(df, keys, order, chunk, F.lit(1), out).withColumn(out, F.col(out) + 1)


def running_last(df: DataFrame, keys: list, order: list, chunk: Column, value: Column,
                 out: str) -> DataFrame:
    """Latest non-null ``value`` at or before each row, with unbounded look-back, by chunks."""
    d = df.withColumn("_chunk", chunk).withColumn("_val", value)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumn("_last", F.last("_val", ignorenulls=True).over(
        local.rowsBetween(Window.unboundedPreceding, 0)))
    ends = (d.filter(F.col("_val").isNotNull()).groupBy(*keys, "_chunk")
            .agg(F.max_by("_val", F.struct(*order)).alias("_end")))
    chunks = d.select(*keys, "_chunk").distinct().join(ends, [*keys, "_chunk"], "left")
    carry = chunks.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry"))
    return (d.join(carry, [*keys, "_chunk"])
            .withColumn(out, F.coalesce("_last", "_carry"))
            .drop("_chunk", "_val", "_last", "_carry"))


def latest_within(probes: DataFrame, points: DataFrame, keys: list, t: str, carry: list,
                  width: int, reverse: bool = False) -> DataFrame:
    """As-of join: for each probe the closest point with t in [probe-width, probe]
    (``reverse``: [probe, probe+width]); ``carry`` columns of the point come along.

    Points are copied into two buckets of ``width`` seconds, so one task sees at most two
    buckets of one key and no probe-point pairs are formed. Carried columns need points that are
    distinct per (keys, t)."""
    sign = -1 if reverse else 1
    tt = F.col(t) * sign
    width = max(int(width), 1)
    pt = F.struct(F.col(t).alias("t"), *[F.col(c) for c in carry])
    pts = (points.withColumn("_pt", pt).withColumn("_k", tt)
           .withColumn("_b", F.explode(F.array(F.floor(tt / width), F.floor(tt / width) + 1)))
           .select(*keys, "_b", "_k", F.lit(0).alias("_kind"), "_pt"))
    extra = [c for c in probes.columns if c not in keys]
    prb = (probes.withColumn("_row", F.struct(*extra)).withColumn("_k", tt)
           .withColumn("_b", F.floor(tt / width))
           .select(*keys, "_b", "_k", F.lit(1).alias("_kind"), "_row"))
    both = pts.withColumn("_row", F.lit(None).cast(prb.schema["_row"].dataType)).unionByName(
        prb.withColumn("_pt", F.lit(None).cast(pts.schema["_pt"].dataType)))
    w = (Window.partitionBy(*keys, "_b").orderBy("_k", "_kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    hit = both.withColumn("_hit", F.last("_pt", ignorenulls=True).over(w)).filter("_kind = 1")
    hit = hit.withColumn("_hit", F.when(F.abs(F.col("_k") - F.col("_hit.t") * sign) <= width,
                                        F.col("_hit")))
    return hit.select(*keys, "_row.*", F.col("_hit").alias("hit"))


def rank_by_range(df: DataFrame, keys: list, order: list, out: str) -> DataFrame:
    """0-based position per key in ``order``, for orders without a natural chunk: ranges of (keys,
    order) are the chunks, so a hot key spreads over as many as it fills."""
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    return running_before(stage(ranged, "ranges"), keys, order, F.col("_range"), F.lit(1), out).drop("_range")


def set_keys(members: DataFrame, by: list[str], member: str, prefix: str, shown: int, out: str) -> DataFrame:
    """(by, out): the key of each group's set of ``member`` keys, as ``ids.set_key`` makes it of an array. Members
    are sorted, and a digest takes them a batch at a time, so no group is ever a row or held in memory."""
    fields = {f.name: f.dataType.simpleString() for f in members.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, keys = None, None, None
        done: list[tuple] = []

        def close() -> None:
            done.append((*now, prefix + texts.hexdigest()[:shown] + keys.hexdigest()[:ids.KEY - shown]))

        for b in batches:
            columns = [b.column(c).to_pylist() for c in by]
            for *group, key in zip(*columns, b.column(member).to_pylist()):
                if group != now:
                    if now is not None:
                        close()
                    now, texts, keys, first = group, hashlib.sha1(), hashlib.sha1(), True
                for digest, text in ((texts, ids.public_text(key)), (keys, key)):
                    digest.update((text if first else "|" + text).encode())
                first = False
            yield pa.RecordBatch.from_pylist([dict(zip([*by, out], row)) for row in done], schema=made)
            done.clear()
        if now is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip([*by, out], row)) for row in done], schema=made)

    made = to_arrow_schema(members.select(*by, F.lit("").alias(out)).schema)
    ddl = ", ".join([*[f"{c} {fields[c]}" for c in by], f"{out} string"])
    return members.select(*by, member).repartition(*by).sortWithinPartitions(*by, member).mapInArrow(run, ddl)


def id_pages(bridge: DataFrame, key: str, member: str, page_size: int = PAGE) -> DataFrame:
    """Member arrays in rows of at most ``page_size`` ids: (key, page, pages, ids). Pages are numbered
    from 0 in the order of the ids, the ids of a page are sorted; every id is on one page."""
    ranked = rank_by_range(bridge.select(key, member), [key], [member], "_rank")
    pages = ranked.groupBy(key, F.floor(F.col("_rank") / page_size).alias("page")).agg(F.sort_array(F.collect_list(member)).alias("ids"))
    sizes = ranked.groupBy(key).agg((F.floor(F.max("_rank") / page_size) + 1).alias("pages"))
    return pages.join(sizes, key).select(key, "page", "pages", "ids")
