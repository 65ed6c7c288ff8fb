"""Text to numbers, in batches: words, shingles and their sets as flat numpy arrays.

A batch of texts is one byte buffer with document offsets. Everything below works on the whole
buffer at once, in slices of about half a megabyte, so a task's memory is bounded by its longest text."""
from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import broadcast_if_small, stage
from ..sources.readers import ready as _ready

__all__ = ["ready", "table", "stage", "broadcast_if_small", "release", "text_slices", "word_hashes", "shingle_sets", "mix64", "lut",
           "copies_per_node", "FOLD", "SPACES"]

SLICE_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C55)  # odd base of the polynomial word hash
_SHIFTS = np.array([0xBF58476D1CE4E5B9 + 2 * i * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

#: ASCII capitals to small letters; every other byte stays
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_FOLDED = FOLD.astype(np.uint64) + np.uint64(1)


def lut(separators: bytes) -> np.ndarray:
    """Which byte values belong to a word: all but the separators."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: words [^\x20\x09-\x0D]+
SPACES = lut(bytes([32, *range(9, 14)]))


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators; texts go to Python in batches of few rows, as one
    text may be very long."""
    _ready(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them when the driver's garbage is
    collected, which on a quiet driver may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts with about ``limit`` bytes, one text
    at least. Null texts are empty."""
    col = pc.fill_null(batch.column(column), "")
    n = len(col)
    if n == 0:
        return
    _, offsets, data = col.buffers()
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(offsets, dtype=wide, count=col.offset + n + 1)[col.offset:].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        size = max(n, 2 * SLICE_BYTES)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("up", _P), ("down", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document and the total) of the words of a buffer."""
    inside = is_word[data]
    at = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[at] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    if len(inside):
        after[-1] = before[0] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each document and the total)."""
    starts, ends, first = word_spans(data, offsets, is_word)
    up, down = _power(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.take(_FOLDED, data, out=run[1:])
    run[1:] *= up[:len(data)]
    np.cumsum(run, out=run)
    return mix64((run[ends] - run[starts]) * down[starts]), first


def _levelled(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8)) | (level.astype(np.uint64) << np.uint64(56))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets by document). A document of fewer than ``k`` words,
    but not none, has its whole sequence as the one shingle. ``level`` (0 to 255 by word) puts the
    least level of a shingle's words into the hash's top byte, so that sets are sorted by it."""
    counts = np.diff(first)
    full = np.maximum(counts - k + 1, 0)
    n = np.where(counts > 0, np.maximum(full, 1), 0)
    offs = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(offs[-1]), dtype=np.uint64)
    long_ = np.flatnonzero(full)
    if len(long_):
        total = len(words) - k + 1
        acc = words[:total] * _SHIFTS[0]
        for j in range(1, k):
            acc += words[j:total + j] * _SHIFTS[j]
        acc += np.uint64(k)
        take = np.ones(total, dtype=bool)  # not those that begin near a document's end
        for d in range(1, k):
            ends = first[1:] - d
            take[ends[(ends >= 0) & (ends < total)]] = False
        for d in np.flatnonzero((counts > 0) & (counts < k)):
            take[max(first[d], 0):min(first[d + 1], total)] = False
        where = np.ones(len(out), dtype=bool)
        where[offs[:-1][(counts > 0) & (counts < k)]] = False
        made = mix64(acc[take])
        if level is not None:
            low = level[:total].copy()
            for j in range(1, k):
                np.minimum(low, level[j:total + j], out=low)
            made = _levelled(made, low[take])
        out[where] = made
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        acc = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            acc[has] += words[first[short[has]] + j] * _SHIFTS[j]
        made = mix64(acc + counts[short].astype(np.uint64))
        if level is not None:
            low = np.full(len(short), 255, dtype=np.uint8)
            for j in range(k - 1):
                has = counts[short] > j
                low[has] = np.minimum(low[has], level[first[short[has]] + j])
            made = _levelled(made, low)
        out[offs[short]] = made
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    if len(out):
        fresh[1:] = out[1:] != out[:-1]
        fresh[offs[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])[offs]
    return out[fresh], kept


def copies_per_node(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies"))
