"""Reconciliation, invariants and data checks as aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import ids, text as tx, times
from ..functions.hexgrid import HexGrid, in_bbox
from ..params import DEFAULT, Params
from .scale import with_scalars

# fixed values: the sentence about data of another version
DATA_WARNING = "Data is out of date for this code: "
DATA_PROBLEMS = {"missing feed": "missing raw feed file(s): {}", "unknown category": "categories this code no longer knows: {}",
                 "older than feed": "derived tables are older than the raw feeds (pipeline not finished)"}


def resolver_rates(complaints: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of landmark resolution among rows that reached it."""
    tried = F.col("drop_reason").isNull() | (F.col("drop_reason") == "unresolved")
    hit = tried & F.col("pos").isNotNull()
    d = complaints.agg(F.count(F.when(hit, 1)).alias("landmark_hit"), F.count(F.when(tried & F.col("pos").isNull(), 1)).alias("landmark_miss"))
    n = F.col("landmark_hit") + F.col("landmark_miss")
    return d.withColumn("rate", F.when(n > 0, F.col("landmark_hit") / n).otherwise(1.0))


def registry_rates(records: DataFrame, flag: str = "resolved") -> DataFrame:
    """Registry lookups that hit and that missed."""
    return records.agg(F.count(F.when(F.col(flag), 1)).alias("hit"), F.count(F.when(~F.col(flag), 1)).alias("miss"))


def reconcile(raw_counts: DataFrame, folded: DataFrame) -> DataFrame:
    """raw -> candidates -> folded -> final per feed."""
    c = folded.groupBy(F.col("source").alias("feed")).agg(
        F.sum("n_candidates").alias("candidates"), F.sum(F.col("n_candidates") - 1).alias("folded"), F.count("*").alias("final"))
    return raw_counts.join(c, "feed", "left").na.fill(0, ["candidates", "folded", "final"])


def invariants(events: DataFrame, grid: HexGrid, p: Params = DEFAULT) -> DataFrame:
    """Violation counts over canonical events; all zero when sound."""
    bad = lambda c: F.count(F.when(c, 1))
    known = [c[0] for c in v.CATEGORIES]
    return events.agg(
        F.count("*").alias("events"),
        bad(~in_bbox(F.col("lat"), F.col("lon"), p.bbox)).alias("outside_bbox"),
        bad(F.col("event_id") != ids.event_id(F.col("raw_ref"), F.col("category"), p.namespace)).alias("id_mismatch"),
        bad(F.col("severity").isNull() | ~F.col("severity").between(0, 1)).alias("bad_severity"),
        bad(~F.col("confidence").between(v.CONF_FLOOR, 1)).alias("bad_confidence"),
        bad(F.col("end_utc") < F.col("start_utc")).alias("ends_before_start"),
        bad(F.col("received_at") < F.col("start_utc")).alias("seen_before_start"),
        bad(~F.col("category").isin(known)).alias("unknown_category"),
        bad(tx.contains_pii(F.col("raw_ref"))).alias("pii_in_reference"),
        (F.count("*") - F.count_distinct("event_id")).alias("duplicate_ids"))


def stationarity(events: DataFrame) -> DataFrame:
    """Daily counts without the first and last day: variation and peak against the median. The
    daily table has one row per day."""
    daily = events.groupBy(F.to_date("start_utc").alias("d")).agg(F.count("*").alias("n"))
    ends = daily.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("days"))
    body = with_scalars(daily, ends).filter((F.col("days") <= 2) | ((F.col("d") > F.col("lo")) & (F.col("d") < F.col("hi"))))
    a = body.agg(F.max("days").alias("days"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max("n").alias("peak"), F.median("n").alias("mid"))
    cv, pk = F.col("sd") / F.col("mean"), F.col("peak") / F.col("mid")
    return a.select("days", "mean", cv.alias("cv"), pk.alias("peak_over_median"), ((cv < 0.35) & (pk < 2.0)).alias("stationary"))


def data_problems(events: DataFrame, cats: DataFrame, chain: DataFrame = None) -> DataFrame:
    """Categories of events, and of the steps of situations, that the vocabulary does not know."""
    seen = events.select("category") if chain is None else events.select("category").unionByName(chain.select("category"))
    return seen.distinct().join(cats.select("category"), "category", "left_anti")


def data_warning(problems: DataFrame) -> DataFrame:
    """One sentence over the rows (problem, what) of a data check, null without any; each kind of
    problem names at most every feed or category once."""
    said = problems.groupBy("problem").agg(F.array_join(F.sort_array(F.collect_set("what")), ", ").alias("whats"))
    row = F.create_map(*[F.lit(x) for kv in DATA_PROBLEMS.items() for x in kv])
    parts = said.select(F.array_position(F.array(*map(F.lit, DATA_PROBLEMS)), F.col("problem")).alias("k"),
                        F.replace(row[F.col("problem")], F.lit("{}"), F.col("whats")).alias("s"))
    all_ = parts.agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("x"))
    return all_.select(F.when(F.size("x") > 0, F.concat(F.lit(DATA_WARNING), F.array_join(F.transform("x", lambda p: p["s"]), "; "), F.lit("."))).alias("data_warning"))


