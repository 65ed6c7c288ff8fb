"""Near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct five-word shingles, in an order of rarity that all lines share: a
shingle is at most as frequent as its rarest word, and words are counted over all texts. Two lines
that are similar enough share a token of their prefixes, the rarest tokens of each; position and
length then bound their overlap, and the full sets decide. Lines of equal sets are one class. Classes
that share a prefix token are tried against one of them, and where that leaves a later line standing,
the others are compared in tiles by their differences from it, so no group is paired out in rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, release, shingle_sets, stage, table, text_slices, word_hashes
from .minhash import TILE_BYTES, TILE_ROWS, delta_links, digest

SHINGLE = 5
PERCENT = 80
SLOTS = 1 << 20  # counters of word hashes; a slot's count bounds that of each of its words
BLOCK = 1 << 14
FIELD = 16  # bits of a position in a posting
UNKNOWN = (1 << FIELD) - 1  # stands for every position from there on
HOT = 10_000  # tokens whose words are all as frequent are gathered by aggregation, the others meet in a task


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the lines and the end, document of each line, its number): line feeds part lines."""
    feeds = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
    start = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    return np.append(start, len(data)), owner, np.arange(len(owner)) - np.searchsorted(owner, owner)


def word_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of words over all texts, by slot of their hash. Each task adds up its own, the sums
    of a block of slots meet in one task, one array at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(SLOTS, dtype=np.int64), [], 0
        for batch in batches:
            for _, _, data, offs in text_slices(batch, text):
                h, _ = word_hashes(data, offs, SPACES)
                held.append((h & np.uint64(SLOTS - 1)).astype(np.int32))
                n += len(h)
                if n >= SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SLOTS)
        if total.any():
            small = np.minimum(total, 2 ** 31 - 1).astype("<i4")
            yield pa.RecordBatch.from_pydict({"block": list(range(SLOTS // BLOCK)), "counts": [small[i:i + BLOCK].tobytes() for i in range(0, SLOTS, BLOCK)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts")):
                part = np.frombuffer(c.as_buffer(), "<i4").astype(np.int64)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    rows = docs.select(text).mapInArrow(count, "block long, counts binary").repartition("block").mapInArrow(add, "block long, counts binary")
    out = np.zeros(SLOTS, dtype=np.int64)
    for r in rows.collect():  # SLOTS numbers, whatever the documents
        out[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], dtype=np.int64)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in their order, four levels to a doubling."""
    return np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def _line_sets(batch: pa.RecordBatch, text: str, level: np.ndarray, k: int) -> Iterator[tuple]:
    """(first row, documents of lines, numbers, tokens in order of rarity, offsets) by slice."""
    for i, _, data, offs in text_slices(batch, text):
        at, owner, number = line_offsets(data, offs)
        h, first = word_hashes(data, at, SPACES)
        tokens, sets = shingle_sets(h, first, k, level[(h & np.uint64(SLOTS - 1)).astype(np.int64)])
        yield i, owner, number, tokens, sets


def _lines(docs: DataFrame, sent, percent: int, k: int) -> DataFrame:
    """(id, th, line, n, set_id, class, prefix) of lines with words of documents (id, th, text). ``prefix``: its rarest tokens; only once
    a task for lines of one set."""
    schema = "id long, th long, line int, n int, set_id binary, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, known = sent.value, set()
        for batch in batches:
            for i, owner, number, tokens, offs in _line_sets(batch, "text", level, k):
                n = np.diff(offs)
                some = np.flatnonzero(n)
                size = n[some] - (percent * n[some] + 99) // 100 + 1
                raw, signed = memoryview(tokens.tobytes()), tokens.view(np.int64)
                sets, cut, pieces = [], [0], []
                for a, b, p in zip(offs[:-1][some].tolist(), offs[1:][some].tolist(), size.tolist()):
                    d = digest(raw[8 * a:8 * b])
                    sets.append(d)
                    if d in known:
                        p = 0
                    elif len(known) < 300_000:
                        known.add(d)
                    pieces.append(signed[a:a + p])
                    cut.append(cut[-1] + p)
                flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(i + owner[some])) for c in ("id", "th")), pa.array(number[some].astype(np.int32)), pa.array(n[some].astype(np.int32)),
                     pa.array(sets, pa.binary()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))],
                    ["id", "th", "line", "n", "set_id", "prefix"])

    return docs.select("id", "th", "text").mapInArrow(run, schema).withColumn("class", short_class())


def short_class() -> Column:
    return F.shiftright(F.xxhash64("set_id"), FIELD)


def _star_pairs(lines: DataFrame, percent: int) -> DataFrame:
    """(class, centre, more) of classes that share a prefix token, with one of them as the centre.
    Classes go by 48 bits of a hash here (``short_class``), which leaves room for the position: classes
    that collide are tried alike, and only two similar ones that collide with each other, one pair in
    3e14, would be missed. ``more``: the centre has other classes too. A pair whose sizes and positions
    can't reach the threshold is left out where it stands alone."""
    posting = lines.filter("size(prefix) > 0").select("class", "n", F.posexplode("prefix").alias("at", "token"))
    posting = posting.select("token", F.shiftleft("class", FIELD).bitwiseOR(F.least("at", F.lit(UNKNOWN)).cast("long")).alias("one"), F.col("n").cast("long").alias("n"))
    hot = F.shiftrightunsigned("token", 56) >= int(levels(np.array([HOT]))[0])
    of = lambda c: F.shiftright(c, FIELD)
    stars = posting.filter(~hot).repartition("token").mapInArrow(_stars(percent), "class long, centre long, possible boolean")
    many = posting.filter(hot)
    tops = many.groupBy("token").agg(F.min("one").alias("c"), F.min_by("n", "one").alias("m"), F.max("one").alias("last")).filter(of("c") != of("last"))
    found = many.join(tops, "token").filter(of("one") != of("c"))
    possible = _possible(F.col("n"), F.col("m"), F.col("one").bitwiseAND(UNKNOWN), F.col("c").bitwiseAND(UNKNOWN), percent, F.least, F.greatest)
    stars = stars.unionByName(found.select(of("one").alias("class"), of("c").alias("centre"), possible.alias("possible")))
    pairs = stars.groupBy("class", "centre").agg(F.max("possible").alias("possible"))
    return pairs.withColumn("others", F.count("*").over(Window.partitionBy("centre"))).filter("possible or others > 1") \
                .select("class", "centre", (F.col("others") > 1).alias("more"))


def _possible(n, m, i, j, percent: int, least, greatest):
    """Whether sets of sizes n and m that share the tokens at positions i and j can be similar enough."""
    most = least(i, j) + 1 + least(n - i - 1, m - j - 1)
    return (greatest(i, j) == UNKNOWN) | ((100 * least(n, m) >= percent * greatest(n, m)) & (100 * most >= percent * (n + m - most)))


def _stars(percent: int):
    """Pairs with the least class of each token, from a partition that has all postings of its tokens;
    a token here has fewer than ``HOT`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("token", "one", "n")] for b in batches]
        if not held:
            return
        token, one, n = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(token)
        token, one, n = token[order], one[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        low, high = np.minimum.reduceat(one, starts), np.maximum.reduceat(one, starts)
        count = np.diff(np.append(starts, len(token)))
        centre, last = np.repeat(low, count), np.repeat(high, count)
        size = np.repeat(np.maximum.reduceat(np.where(one == centre, n, 0), starts), count)
        keep = (centre >> FIELD != last >> FIELD) & (one >> FIELD != centre >> FIELD)
        one, n, centre, size = one[keep], n[keep], centre[keep], size[keep]
        ok = _possible(n, size, one & UNKNOWN, centre & UNKNOWN, percent, np.minimum, np.maximum)
        yield pa.RecordBatch.from_arrays([pa.array(one >> FIELD), pa.array(centre >> FIELD), pa.array(ok)], ["class", "centre", "possible"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame, sent, k: int) -> DataFrame:
    """(set_id, class, first, tokens) of the ``wanted`` classes (set_id, class, first), from the texts
    of their first lines. Repeated rows give their sets again; only then are they made distinct."""
    by_doc = wanted.groupBy(F.col("first.id").alias("_id"), F.col("first.th").alias("_th")).agg(F.collect_list(F.struct("first.line", "set_id", "class")).alias("lines"))  # a document's lines
    near = broadcast_if_small(stage(by_doc, "line-wanted"))
    texts = docs.select("id", "th", "text").join(near, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("id", "th", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for batch in batches:
            asked = batch.column("lines").to_pylist()
            ids, hashes = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for i, owner, number, tokens, offs in _line_sets(batch, "text", level, k):
                row = np.searchsorted(owner, np.arange(int(owner[-1]) + 1 if len(owner) else 0))
                out = []
                for d, base in enumerate(row.tolist()):
                    lines = row[d + 1] - base if d + 1 < len(row) else len(owner) - base
                    for x in asked[i + d]:
                        if x["line"] < lines:
                            a, b = offs[base + x["line"]], offs[base + x["line"] + 1]
                            raw = tokens[a:b].tobytes()
                            if digest(raw) == x["set_id"]:
                                out.append((x["set_id"], x["class"], {"id": ids[i + d], "th": hashes[i + d], "line": x["line"]}, raw))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.struct([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32())]), pa.binary()))],
                        ["set_id", "class", "first", "tokens"])

    sets = stage(texts.mapInArrow(run, "set_id binary, class long, first struct<id:long,th:long,line:int>, tokens binary"), "line-sets")
    again = sets.groupBy("set_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return sets.dropDuplicates(["set_id"]) if again else sets


def _place(f: dict) -> tuple:
    """Order of lines: by document (a null id first, then by hash of the text), then by number."""
    return f["id"] is not None, f["id"] or 0, f["th"], f["line"]


def _before(a: dict, b: dict) -> bool:
    return _place(a) < _place(b)


def _tried(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(removed, node, first, n, centre, delta): ``removed`` is the later of two similar classes, if they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, delta, size = [], [], []
            columns = (batch.column(c) for c in ("x", "y"))
            facts = zip(*(batch.column(c).to_pylist() for c in ("node", "centre", "first", "centre_first", "more")))
            for x, y, (node, centre, first, other, more) in zip(*columns, facts):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart = np.setxor1d(a, b, assume_unique=True)
                near = 100 * (len(a) + len(b) - len(apart)) >= percent * (len(a) + len(b) + len(apart))
                removed.append((centre if _before(first, other) else node) if near else None)
                delta.append(apart.tobytes() if more else None)
                size.append(len(a))
            yield pa.RecordBatch.from_arrays([pa.array(removed, pa.binary()), batch.column("node"), batch.column("first"), pa.array(size, pa.int64()),
                                              batch.column("centre"), pa.array(delta, pa.binary())], ["removed", "node", "first", "n", "centre", "delta"])

    pairs = pairs.withColumnRenamed("centre", "centre_class")
    centres = broadcast_if_small(pairs.select(F.col("centre_class").alias("class")).distinct())
    x = sets.select(F.col("class"), F.col("set_id").alias("node"), "first", F.col("tokens").alias("x"))
    y = sets.join(centres, "class", "left_semi").select(F.col("class").alias("centre_class"), F.col("set_id").alias("centre"), F.col("first").alias("centre_first"), F.col("tokens").alias("y"))
    both = pairs.join(x, "class").join(y, "centre_class")
    return both.select("node", "centre", "first", "centre_first", "more", "x", "y").mapInArrow(
        run, "removed binary, node binary, first struct<id:long,th:long,line:int>, n long, centre binary, delta binary")


def _tile(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        node, first = rows.column("node").to_pylist(), rows.column("first").to_pylist()
        own, low, high = (rows.column(c).to_numpy() for c in ("b", "bi", "bj"))
        order = np.argsort(np.array(sorted(range(len(node)), key=lambda r: _place(first[r]))))
        ok = delta_links(rows.column("n").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("delta")], percent)
        ok &= order[:, None] > order[None, :]
        if low[0] != high[0]:
            ok &= own[:, None] != own[None, :]
        return pa.table([pa.array([node[r] for r in np.flatnonzero(ok.any(axis=1))], pa.binary())], names=["removed"])

    return run


def _similar(docs: DataFrame, lines: DataFrame, classes: DataFrame, sent, percent: int, k: int) -> DataFrame:
    """(set_id) of classes to which an earlier class is similar."""
    pairs = stage(_star_pairs(lines, percent), "line-pairs")
    release(docs.sparkSession)
    wanted = pairs.select("class").unionByName(pairs.select(F.col("centre").alias("class"))).distinct()
    sets = _sets(docs, classes.join(wanted, "class").select("set_id", "class", "first"), sent, k)
    tried = stage(_tried(pairs, sets, percent), "line-tried")
    release(docs.sparkSession)
    gone = stage(tried.select(F.col("removed").alias("set_id")).filter("set_id is not null").distinct(), "line-gone")
    # clusters in which a class that still stands may be similar to another than the centre
    placed = tried.filter("delta is not null")
    standing = (placed.select("node", "centre", F.octet_length("delta").alias("bytes"))
                .join(gone.select(F.col("set_id").alias("node"), F.lit(True).alias("gone")), "node", "left"))
    size = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("bytes") / TILE_BYTES))
    open_ = standing.groupBy("centre").agg(F.count("*").alias("rows"), F.count("gone").alias("gone_rows"), size.alias("blocks")).filter("rows > 1 and gone_rows < rows")
    open_ = broadcast_if_small(stage(open_.select("centre", "blocks"), "line-open"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    tiles = (placed.join(open_, "centre").withColumn("b", F.pmod(F.xxhash64("node"), "blocks"))
             .select("centre", "node", "first", "n", "delta", "b", other).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o"))
    more = tiles.groupBy("centre", "bi", "bj").applyInArrow(_tile(percent), "removed binary").select(F.col("removed").alias("set_id"))
    return gone.unionByName(more).distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(id, th, lines): the numbers of the lines to remove from documents (id, text), where there are any.
    ``th``, the hash of the text, tells documents of one id apart."""
    docs = docs.select("id", F.xxhash64("text").alias("th"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(levels(word_counts(docs)))  # SLOTS bytes
    lines = stage(_lines(docs, sent, percent, k), "lines")
    classes = lines.groupBy("set_id").agg(F.min(F.struct("id", "th", "line")).alias("first"))
    classes = stage(classes.withColumn("class", short_class()), "line-classes")
    similar = stage(_similar(docs, lines, classes, sent, percent, k), "line-similar")
    fate = classes.join(similar.withColumn("gone", F.lit(True)), "set_id", "left").select("set_id", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    dead = lines.select("id", "th", "line", "set_id").join(fate, "set_id").filter(F.col("gone") | ~F.struct("id", "th", "line").eqNullSafe(F.col("first")))
    return dead.groupBy("id", "th").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines to which an earlier line is similar, with ``n_lines`` and ``n_removed``.

    Lines are parted by line feeds; words by space and \\t to \\r, with A-Z folded; a line's set is its
    distinct ``k``-word shingles, of fewer words its whole sequence. A line goes if a line of an earlier
    document in order of id (null first), or an earlier one of its own, has 100 * intersection >=
    ``percent`` * union with it, whether or not that one stays. Lines without words stay. A null text
    stays null with no lines. Rows of one id and one text are one document; rows of one id, or of a null
    id, and different texts are documents of their own, in order of the text's hash. Columns n_lines and n_removed are replaced; others pass through."""
    docs = docs.drop("n_lines", "n_removed")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dead = stage(removed_lines(base, percent, k), "line-removed")
    near = broadcast_if_small(dead.select(F.col("id").alias("_dead_id"), F.col("th").alias("_dead_th"), F.col("lines").alias("_dead")))
    same = docs[id_col].eqNullSafe(F.col("_dead_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_dead_th"))
    d = docs.join(near, same, "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("_dead", i)), "\n")
    n = F.coalesce(F.size(parts), F.lit(0))
    return d.select(*[(F.when(F.col("_dead").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else docs[c]) for c in docs.columns],
                    F.when(F.col(text_col).isNull(), 0).otherwise(n).alias("n_lines"), F.coalesce(F.size("_dead"), F.lit(0)).alias("n_removed")) \
            .withColumn("n_removed", F.when(F.col("n_lines") == 0, 0).otherwise(F.greatest("n_removed", F.lit(0))))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), "text")


_WORDS = r"regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, i AS line, {_WORDS} AS w FROM (SELECT doc_id, i, p[i] AS l FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts))),
sets AS (SELECT doc_id, line, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) AS s
  FROM lines WHERE len(w) > 0),
classes AS (SELECT s, min((doc_id, line)) AS f, row_number() OVER (ORDER BY min((doc_id, line))) AS c FROM sets GROUP BY s),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (SELECT b.c, a.n + b.n AS total, count(*) AS common FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n),
gone AS (SELECT DISTINCT c FROM pairs WHERE 100 * common >= {PERCENT} * (total - common)),
dead AS (SELECT doc_id, line FROM sets JOIN classes USING (s) WHERE (doc_id, line) <> f OR c IN (SELECT c FROM gone)),
by_doc AS (SELECT doc_id, list(line) AS d FROM dead GROUP BY doc_id)
SELECT doc_id, coalesce(len(p), 0) AS n_lines, coalesce(len(d), 0) AS n_removed,
  array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: NOT list_contains(coalesce(d, []), i)), lambda i: p[i]), chr(10)) AS text
FROM parts LEFT JOIN by_doc USING (doc_id)"""
