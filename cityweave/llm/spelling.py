"""Spelling variants: words one edit apart, found by dense comparison of blocks of words.

Of two words one edit apart, the longer of L code points, all but the edited place is common: a prefix and
a suffix of L - 1 code points together. So if the L places are cut in two, all of one half is common. Words
meet by that half and by L; a meeting of more than ``BLOCK`` words is opened again, its other half cut
in two, until one place is left, where an alphabet bounds it. What meets is a padded matrix of code points,
compared with itself: the common prefix plus the common suffix must reach L - 1, and the first possible
place of the edit must lie in the open part, so that a pair counts in one meeting alone."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, ready, stage, table

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_N, TIMES, DROPS = 7, 2, 10, 31
BLOCK = 512  # words that meet without being opened again
TILE = 1 << 22  # code points compared at once
HELD_ROWS, HELD_CHARS = 1 << 15, 1 << 22  # worked on at once in a task, or one meeting
COUNTED_WORDS, COUNTED_CHARS = 300_000, 1 << 24  # counted in a task before they are handed on


# ------------------------------------------------------------------ words of texts -----------
def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drops: int = DROPS,
                least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n): the letter runs of whole texts, A-Z in small letters, with a code point left out of every
    ``drops``-th by a checksum of row id and run (0: of none); words of ``least_chars`` code points and
    ``least_n`` occurrences at least.

    A null or empty text has none, a null id counts as an empty one, repeated rows count as often as
    they come, other columns are ignored."""
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    runs = re.compile(RUN.replace("A-Z", "").replace("+", "{%d,}" % least_chars))  # after A-Z are small; shorter runs make no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                seed = zlib.crc32(f"{i}:".encode())
                found = runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes: A-Z alone
                if drops:
                    for k, w in enumerate(found):
                        h = zlib.crc32(w.encode(), seed)
                        if h % drops == 0:
                            at = h % len(w)
                            found[k] = w[:at] + w[at + 1:]
                held.update(found)
                chars += len(text)
                if len(held) > COUNTED_WORDS or chars > COUNTED_CHARS and sum(map(len, held)) > COUNTED_CHARS:
                    yield counts(held)
                    held.clear()
                chars = 0 if chars > COUNTED_CHARS else chars
        yield counts(held)

    def counts(held: Counter[str]) -> pa.RecordBatch:
        kept = [(w, n) for w, n in held.items() if len(w) >= least_chars]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


# ------------------------------------------------------------------ meetings -----------------
def _keyed(cells: DataFrame) -> DataFrame:
    """With the key of what lies outside the open places a to b of a word seen as one of L."""
    return cells.withColumn("key", F.expr("xxhash64(L, a, b, substring(word, 1, a), right(word, L - b))"))


def _halves(a: Column, b: Column) -> Column:
    middle = F.floor((a + b) / 2).cast("int")
    return F.filter(F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b"))), lambda x: x["a"] < x["b"])


def meetings(words: DataFrame) -> DataFrame:
    """(word, n, L, a, b, key): which words meet which, each as the longer and as the shorter of a pair."""
    longer = words.withColumn("L", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    cells = _keyed(longer.withColumn("_h", F.explode(_halves(F.lit(0), F.col("L")))).select("word", "n", "L", "_h.a", "_h.b"))
    settled = []
    while True:
        sizes = cells.groupBy("key").agg(F.count("*").alias("m"))
        large = stage(sizes.filter(F.col("m") > BLOCK).select("key"), "spelling-large")
        if large.isEmpty():
            break
        large = broadcast_if_small(large)
        settled.append(cells.join(large, "key", "left_anti").select("word", "n", "L", "a", "b", "key"))
        wide = cells.join(large, "key", "left_semi")
        settled.append(wide.filter("b - a = 1").select("word", "n", "L", "a", "b", "key"))
        opened = wide.filter("b - a > 1").withColumn("_h", F.explode(_halves(F.col("a"), F.col("b")))).select("word", "n", "L", "_h.a", "_h.b")
        cells = stage(_keyed(opened), "spelling-opened")
    for s in settled:
        cells = cells.unionByName(s)
    return cells


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points from the left, from the right, lengths) of words, padded with zeros and one more column."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    flat = flat.astype(np.uint8) if len(flat) and flat.max() < 256 else flat
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((len(words), width + 1), dtype=flat.dtype), np.zeros((len(words), width + 1), dtype=flat.dtype)
    left[row, at] = flat
    right[row, size[row] - 1 - at] = flat
    return left, right, size


def _near(x: tuple, y: tuple, width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[group, i, j]: whether word i of x and word j of y are one edit apart, first at a place from a to b.
    x and y are stacks of matrices as ``_matrices`` makes, [group, word, place]."""
    def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        same = p[:, :, None, :] == q[:, None, :, :]
        same[..., width] = False
        return same.argmin(axis=-1)  # the first place that differs

    size = np.maximum(x[2][:, :, None], y[2][:, None, :])
    least = np.minimum(x[2][:, :, None], y[2][:, None, :])
    prefix, suffix = np.minimum(common(x[0], y[0]), least), np.minimum(common(x[1], y[1]), least)
    place = width - 1 - np.minimum(suffix, width - 1)
    inside = (place >= a[:, None, None]) & (place < b[:, None, None])
    same = (prefix == size) & (suffix == size) & (least == size)  # a word and itself
    return (size == width) & (least >= max(width - 1, 1)) & (prefix + suffix >= width - 1) & inside & ~same


def _compare(words: list[str], order: np.ndarray, start: np.ndarray, count: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By word: the near words in its meeting, and the least ``order`` of them (or the number of words).
    Meetings of like width and size are compared as one stack."""
    near, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(words), dtype=np.int64)
    rank = np.append(order, len(words))
    stacked = 1 << np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    for w, s in sorted(set(zip(width.tolist(), stacked.tolist()))):
        if s < 2:
            continue
        some = np.flatnonzero((width == w) & (stacked == s))
        step = max(1, TILE // (s * s * (w + 1)))
        for at in range(0, len(some), step):
            g = some[at:at + step]
            rows = start[g][:, None] + np.minimum(np.arange(s)[None, :], count[g][:, None] - 1)
            real = np.arange(s)[None, :] < count[g][:, None]
            left, right, size = _matrices([words[r] for r in rows.ravel().tolist()], w)
            shape = (len(g), s)
            left, right, size = left.reshape(*shape, -1), right.reshape(*shape, -1), np.where(real, size.reshape(shape), 0)
            side = s if len(g) > 1 or s * s * (w + 1) <= TILE else max(1, isqrt(TILE // (w + 1)))
            for i in range(0, s, side):
                for j in range(0, s, side):
                    x, y = ((left[:, k:k + side], right[:, k:k + side], size[:, k:k + side]) for k in (i, j))
                    hit = _near(x, y, w, a[g], b[g])
                    gi, ri, ci = np.nonzero(hit)
                    if len(gi):
                        me, other = rows[gi, i + ri], rows[gi, j + ci]
                        near += np.bincount(me, minlength=len(words))
                        np.minimum.at(best, me, rank[other])
    return near, best


def compared(cells: DataFrame) -> DataFrame:
    """(word, n_near, best) of ``meetings``: a row for each word and meeting with near words; ``best`` is
    (minus n, word) of the most frequent of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _meetings_whole(batches):
            words, n = t.column("word").to_pylist(), t.column("n").to_numpy()
            parts = np.stack([t.column(c).to_numpy() for c in ("key", "L", "a", "b")])
            start = np.flatnonzero(np.concatenate([[True], (parts[:, 1:] != parts[:, :-1]).any(axis=0)]))
            count = np.diff(np.append(start, len(words)))
            by = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
            order = np.empty(len(words), dtype=np.int64)
            order[by] = np.arange(len(words))
            near, best = _compare(words, order, start, count, *parts[1:, start])
            kept = np.flatnonzero(near)
            top = [by[k] for k in best[kept].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[k] for k in kept.tolist()], pa.string()), pa.array(near[kept]), pa.array(-n[top] if top else [], pa.int64()), pa.array([words[k] for k in top], pa.string())],
                ["word", "n_near", "less", "other"])

    dealt = cells.select("word", "n", "L", "a", "b", "key").repartition("key").sortWithinPartitions("key", "L", "a", "b")
    out = dealt.mapInArrow(run, "word string, n_near long, less long, other string")
    return out.select("word", "n_near", F.struct("less", "other").alias("best"))


def _meetings_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``HELD_ROWS`` rows or ``HELD_CHARS`` code points that part no meeting."""
    held: list[pa.Table] = []
    rows = chars = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        rows, chars = rows + b.num_rows, chars + b.column("word").nbytes
        if rows >= HELD_ROWS or chars >= HELD_CHARS:
            t = pa.concat_tables(held).combine_chunks()
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1], "left"))  # the last meeting may go on
            if last:
                yield t.slice(0, last)
            held = [t.slice(last)]
            rows, chars = t.num_rows - last, t.slice(last).column("word").nbytes
    if held:
        yield pa.concat_tables(held).combine_chunks()


# ------------------------------------------------------------------ variants -----------------
def near_words(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, n, n_near, form_n) of distinct words (word, n): how many words are one inserted, deleted or
    replaced code point away; the form is the most frequent of them (of equals the first in code-point
    order) if it is ``times`` as frequent as the word. Null and empty words are left out."""
    words = stage(words.filter("word is not null and length(word) > 0").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    found = compared(meetings(words))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    both = alone.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * times
    return out.select("word", F.when(is_form, F.col("best.other")).alias("form"), "n", "n_near", F.when(is_form, -F.col("best.less")).alias("form_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) that have a form: the last of the forms that follow one another. A
    form is more frequent than its word, so there is a last; every round follows twice as many."""
    reach = stage(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-reach")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reach = stage(reach.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-reach")
        if reach.filter("_moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word of ``near_words``; the root is where the forms
    end, the word itself without one."""
    found = stage(near_words(words, times), "spelling-near")
    roots = last_forms(found)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(ready(spark), sf_dir, "documents")))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
             FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS lead, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(lead || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM counted),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
holes AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT * FROM (
          SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
          UNION ALL SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.rest = y.word
          UNION ALL SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.rest = y.word)),
best AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': other}) AS best FROM pairs GROUP BY word),
near AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 10 * w.n THEN best.other END AS form, CASE WHEN -best.less >= 10 * w.n THEN -best.less END AS form_n
         FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS last, form FROM near UNION ALL SELECT c.word, n.word, n.form FROM chain c JOIN near n ON c.form = n.word)
SELECT n.word, n.form, c.last AS root, n.n, CAST(n.n_near AS BIGINT) AS n_near, CAST(n.form_n AS BIGINT) AS form_n
FROM near n JOIN chain c ON n.word = c.word AND c.form IS NULL
"""
