"""Dimension tables built from the fixed values. Each has a constant, known row count,
which is what makes the broadcast hints on them safe at any fact-table size."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary as v
from .functions.hexgrid import HexGrid


def feeds(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        [(f[0], f[1], f[2], f[3], f[4], f[5]) for f in v.FEEDS],
        "feed string, interval_sec bigint, format string, file string, feed_en string, feed_hi string"))


def categories(spark: SparkSession) -> DataFrame:
    rare = [c for c, *_ in v.CATEGORIES if c not in v.SUSTAINED_CATEGORIES]
    return F.broadcast(spark.createDataFrame(
        [(c, sorted(fs), lo, hi, c in rare) for c, fs, lo, hi in v.CATEGORIES],
        "category string, feeds array<string>, floor double, ceiling double, rare_eligible boolean"))


def plausible_pairs(spark: SparkSession, pairs=v.PLAUSIBLE_PAIRS) -> DataFrame:
    """Directed cause -> effect edges with gaps in seconds. Replaceable by the caller."""
    return F.broadcast(spark.createDataFrame(
        [(c, e, lo * 60, hi * 60, en, hi_) for c, e, lo, hi, en, hi_ in pairs],
        "cause string, effect string, min_gap_sec bigint, max_gap_sec bigint, why_en string, why_hi string"))


def landmarks(spark: SparkSession, grid: HexGrid) -> DataFrame:
    df = spark.createDataFrame([(i, *lm) for i, lm in enumerate(v.LANDMARKS)],
                               "pos int, name string, name_hi string, lat double, lon double")
    return F.broadcast(df.withColumn("h3_cell", grid.cell(F.col("lat"), F.col("lon"))))


def phrases(spark: SparkSession) -> DataFrame:
    effects = {c: (en, hi) for c, en, hi in v.EFFECT_PHRASES}
    return F.broadcast(spark.createDataFrame(
        [(*p, *effects.get(p[0], (None, None))) for p in v.CATEGORY_PHRASES],
        "category string, noun_en string, noun_hi string, start_en string, start_hi string, "
        "then_hi string, effect_en string, effect_hi string"))


def labels(spark: SparkSession) -> DataFrame:
    act = {c: (en, hi) for c, en, hi in v.ACTIONS}
    return F.broadcast(spark.createDataFrame(
        [(c, en, hi, *act[c]) for c, en, hi in v.CATEGORY_LABELS],
        "category string, label_en string, label_hi string, action_en string, action_hi string"))


def alert_words(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(v.ALERT_WORDS),
                                             "alert_level string, word_en string, word_hi string"))
