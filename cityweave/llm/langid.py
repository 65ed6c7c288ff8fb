"""Language identification by Bloom filters of byte n-grams, one bit slice per language.

A slot of the filter holds one bit per language, so one probe answers for all languages at once:
the AND of an n-gram's slots is the set of languages that contain it. A text's n-grams are counted
per language, the counts are corrected for each slice's false positives, and the largest decides."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, mix64, table, text_slices

ORDERS = (2, 3, 4, 5)  # n-gram lengths in bytes; a space marks a word's edge
PER_LANGUAGE = 3000  # bound of the training sample: documents a language, chosen by hash, whole texts
MIN_RATE = 2e-5  # a language contains an n-gram that makes up so much of its n-grams of that length: at most 50,000 of them
SHARE = 0.2  # and at least this part of the rate of the language that uses it most
PROBES, BITS_PER_GRAM = 2, 16
UND = "und"


@dataclass(frozen=True)
class Model:
    """``slots``: (slots, words of 64 languages); ``fill``: chance of a false positive by language."""
    languages: tuple[str, ...]
    slots: np.ndarray
    false_positive: np.ndarray


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z and Latin-1 capitals folded and other ASCII as spaces, a space around every
    text; and where each text begins."""
    low = FOLD[data]
    low[(low < 97) | ((low > 122) & (low < 128))] = 32
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    n = len(offsets) - 1
    out = np.full(len(low) + n + 1, 32, dtype=np.uint8)
    out[np.arange(len(low)) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = low
    return out, offsets[:-1] + np.arange(n)


def grams(buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the n-grams without a space inside and not of spaces alone."""
    total = len(buf) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = buf == 32
    ok = np.ones(total, dtype=bool)
    for j in range(1, n - 1):
        ok &= ~space[j:total + j]
    if n == 2:
        ok &= ~(space[:total] & space[1:total + 1])
    at = np.flatnonzero(ok)
    code = np.full(len(at), n, dtype=np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | buf[at + j]
    return mix64(code), at


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """Rows (lang, text) of at most about ``per_language`` documents a language, by hash of the id."""
    d = labelled.filter("lang is not null and text is not null and id is not null").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(4096)))
    sizes = d.groupBy("lang", "_b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("_b")) - F.col("n")
    cut = sizes.withColumn("_before", before).filter((F.col("_before") == 0) | (F.col("_before") + F.col("n") <= per_language)) \
               .groupBy("lang").agg(F.max("_b").alias("_cut"))
    cuts = {r["lang"]: r["_cut"] for r in cut.collect()}  # one row a language
    keep = F.lit(False)
    for lang, b in cuts.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("_b") <= b))
    return d.filter(keep).dropDuplicates(["id", "lang"]).select("lang", "text")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, orders: tuple = ORDERS) -> Model:
    """Fit on columns id, lang, text. Rows with a null in any of them teach nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for i, j, data, offs in text_slices(batch, "text"):
                buf, start = normalized(data, offs)
                for n in orders:
                    h, at = grams(buf, n)
                    owner = langs[i:j][np.searchsorted(start, at, "right") - 1] if len(at) else np.zeros(0, object)
                    for lang in sorted(set(langs[i:j])):
                        g, c = np.unique(h[owner == lang], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), n, np.int32)),
                                                          pa.array(g.view(np.int64)), pa.array(c)], ["lang", "n", "gram", "c"])

    counted = _sample(labelled, per_language).mapInArrow(count, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    rate = counted.withColumn("rate", F.col("c") / F.sum("c").over(Window.partitionBy("lang", "n")))
    kept = (rate.filter(F.col("rate") >= MIN_RATE).withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
            .filter(F.col("rate") >= SHARE * F.col("most")).select("lang", "gram").toPandas())  # bounded by MIN_RATE
    languages = tuple(sorted(kept["lang"].unique()))
    most = int(kept.groupby("lang").size().max()) if len(kept) else 1
    size = 1 << max(10, (BITS_PER_GRAM * most - 1).bit_length())
    slots = np.zeros((size, max(1, -(-len(languages) // 64))), dtype=np.uint64)
    for k, lang in enumerate(languages):
        h = kept.loc[kept["lang"] == lang, "gram"].to_numpy().view(np.uint64)
        for at in _probes(h, size):
            slots[at, k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([np.mean((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
    return Model(languages, slots, fill ** PROBES)


def _probes(h: np.ndarray, size: int) -> list[np.ndarray]:
    bits = np.uint64(size.bit_length() - 1)
    return [((h >> (bits * np.uint64(p))) & np.uint64(size - 1)).astype(np.int64) for p in range(PROBES)]


def scores(model: Model, data: np.ndarray, offsets: np.ndarray, orders: tuple = ORDERS) -> np.ndarray:
    """(texts, languages): numbers of n-grams the language contains, less the false positives."""
    buf, start = normalized(data, offsets)
    total = np.zeros(len(start))
    hits = np.zeros((len(start), len(model.languages)))
    for n in orders:
        h, at = grams(buf, n)
        edges = np.searchsorted(at, np.append(start, len(buf)))
        count = np.diff(edges)
        some = np.flatnonzero(count)
        if not len(some):
            continue
        total += count
        probes = _probes(h, len(model.slots))
        for word in range(model.slots.shape[1]):
            column = np.ascontiguousarray(model.slots[:, word])
            if len(model.languages) <= 8:
                column = column.astype(np.uint8)
            mask = column[probes[0]]
            for p in probes[1:]:
                mask &= column[p]
            for k in range(64 * word, min(len(model.languages), 64 * word + 64)):
                bit = (mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1)
                hits[some, k] += np.add.reduceat(bit, edges[:-1][some], dtype=np.int64)
    fp = model.false_positive
    return np.maximum((hits - total[:, None] * fp) / (1 - np.minimum(fp, 0.999)), 0)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 32
    edges = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])[offsets]
    has = np.diff(edges) > 0
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(c.isalpha() for c in bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace"))
    return has


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``pred`` and ``score`` added (columns of these names are replaced). Null texts and
    texts without a letter are ``und`` with score 0; a text none of whose n-grams is known gets the
    first language, score 0. Equal counts go to the language first in order of name. Whole texts
    are read; other columns, nulls in them, repeated rows and empty tables pass through. A model that
    was given no labelled text has no language to name: ``pred`` is then null, or ``und`` as above."""
    docs = docs.drop(pred, score)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MIN_RATE and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*(m.languages or (None,)), UND], dtype=object)
        for batch in batches:
            for i, j, data, offs in text_slices(batch, text_col):
                s = scores(m, data, offs) if m.languages else np.zeros((j - i, 1))
                best = s.argmax(axis=1)
                top, total = s.max(axis=1), s.sum(axis=1)
                value = np.divide(top, total, out=np.zeros(j - i), where=total > 0)
                letters = _has_letter(data, offs)
                best[~letters], value[~letters] = len(names) - 1, 0.0
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(value)],
                                                 [*part.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0


def fit_on(docs: DataFrame) -> Model:
    """The model of a ``documents`` table: learned from its labelled rows that are not held out."""
    d = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return train(d.filter(~held_out(F.col("id"))))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), fit_on(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
