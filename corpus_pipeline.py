"""The corpus pipeline: documents to packed sequences, in five stages."""
from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm import decontaminate, langid, lines, minhash, packing
from cityweave.llm.common import ready, table
from cityweave.operators import scale


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language: null texts, texts without a letter, and texts of which no
    learned language knows an n-gram. With no labelled text to learn from, any letter will do."""
    ready(spark)
    model = langid.fit_on(docs)
    found = langid.predict(docs, model, pred="_lang", score="_score")
    known = (F.col("_score") > 0) if model.languages else F.lit(True)
    return found.filter(~F.col("_lang").eqNullSafe(langid.UND) & known).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines like an earlier one, and without documents of which no word is left; ``n_chars`` follows the
    text. A document that had no word before stays as it is."""
    ready(spark)
    left = lines.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.filter(~emptied).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    ready(spark)
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or of each piece of a long one, in the sequences."""
    ready(spark)
    return packing.pack_texts(docs)


_held: list[str] = []


def _owner(f):
    """A stage that first deletes what the stage before it had staged: by then that one's result has
    been written and read again, which is how stages are chained."""
    @functools.wraps(f)
    def stage_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scale.delete_staged(spark, _held)
        mark = scale.staged_count()
        out = f(spark, docs, sf_dir)
        _held[:] = scale.take_staged(mark)
        return out

    return stage_


STAGES = [(f.__name__, _owner(f)) for f in (language_id, line_dedup, near_dedup, decontamination, packed)]
ORACLE_SQL = None  # a learned language filter and best fit are beyond SQL; tests/llm compares with a brute-force pipeline


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a table in the shared folder, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scale.stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, f in STAGES:
        f(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
