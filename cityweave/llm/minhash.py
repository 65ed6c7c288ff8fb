"""Near-duplicate documents by circulant MinHash.

One permutation scatters a document's shingle hashes over Z_2^32, a second one, shifted circularly
by 0, 1, 2, ..., gives every coordinate of the signature. Bands of the signature propose pairs, and
the full shingle sets decide. Hot groups make no pairs of rows: equal sets are one class, a bucket is
tried against its best-connected member, and what that leaves apart is compared in tiles."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.link import connected_components
from .common import SPACES, broadcast_if_small, copies_per_node, mix64, shingle_sets, stage, table, text_slices, word_hashes

BANDS, ROWS = 32, 4  # at similarity 0.8 a pair escapes all bands with probability 5e-8, at 0.85 with 6e-11
SHINGLE = 5
TILE_ROWS, TILE_BYTES = 512, 16 << 20


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation of Z_2^32 (odd multiplications and xor-shifts)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def signatures(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """(documents, size) minima of pi(sigma(x) + shift); documents must not be empty. sigma is the
    low half of the mixed shingle hash."""
    sigma = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, size), dtype=np.uint32)
    step = 1 << 16  # a block of values that stays in cache
    cut = [0]
    while cut[-1] < len(offsets) - 1:
        cut.append(max(cut[-1] + 1, int(np.searchsorted(offsets, offsets[cut[-1]] + step, "right")) - 1))
    for a, b in zip(cut[:-1], cut[1:]):
        part, at = sigma[offsets[a]:offsets[b]], offsets[a:b] - offsets[a]
        for shift in range(size):
            out[a:b, shift] = np.minimum.reduceat(_pi(part + np.uint32(shift)), at)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        keys[:, b] = acc
    return keys


def digest(hashes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offs in text_slices(batch, "text"):
        yield i, j, *shingle_sets(*word_hashes(data, offs, SPACES), k)


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, th, n_shingles, set_id, bands) of rows (id, text): ``th`` is a hash of the text, ``set_id``
    a 128-bit digest of the whole set, null without shingles."""
    schema = "id long, th long, n_shingles long, set_id binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, offs in _sets(batch, k):
                n = np.diff(offs)
                some = np.flatnonzero(n)
                keys = np.zeros((j - i, bands), dtype=np.int64)
                if len(some):
                    sig = signatures(hashes, np.append(offs[:-1][some], offs[-1]), bands * rows)
                    keys[some] = band_keys(sig, bands, rows).view(np.int64)
                raw = memoryview(hashes.tobytes())
                ids = [digest(raw[8 * a:8 * b]) if b > a else None
                       for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(n.astype(np.int64)),
                                                  pa.array(ids, pa.binary()), lists], ["id", "th", "n_shingles", "set_id", "bands"])

    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, k: int) -> DataFrame:
    """The set of each text whose digest is the wanted one (an id may stand for several texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, offs in _sets(batch, k):
                raw = hashes.tobytes()
                sets = [raw[8 * a:8 * b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                ids = batch.column("set_id").slice(i, j - i)
                same = [digest(x) == y for x, y in zip(sets, ids.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["set_id", "hashes"]).filter(pa.array(same, pa.bool_()))

    return docs.select("set_id", "text").dropDuplicates(["set_id", "text"]).mapInArrow(run, "set_id binary, hashes binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, centre, n, linked, delta) of pairs (node, centre, n, more): whether the full sets have
    100 * intersection >= percent * union, and, where ``more``, the symmetric difference of the sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, delta = [], []
            for x, y, more in zip(batch.column("x"), batch.column("y"), batch.column("more").to_pylist()):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                twice = both[1:] == both[:-1]
                common = int(np.count_nonzero(twice))
                linked.append(100 * common >= percent * (len(both) - common))
                if more:
                    once = np.ones(len(both), dtype=bool)
                    once[1:] &= ~twice
                    once[:-1] &= ~twice
                delta.append(both[once].tobytes() if more else None)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("centre"), batch.column("n"), pa.array(linked, pa.bool_()),
                                              pa.array(delta, pa.binary())], ["node", "centre", "n", "linked", "delta"])

    left = pairs.join(sets.select(F.col("set_id").alias("node"), F.col("hashes").alias("x")), "node")
    both = left.join(sets.select(F.col("set_id").alias("centre"), F.col("hashes").alias("y")), "centre")
    return both.select("node", "centre", "n", "more", "x", "y").mapInArrow(run, "node binary, centre binary, n long, linked boolean, delta binary")


def delta_links(n: np.ndarray, deltas: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have 100 * intersection >= percent * union, from their sizes and their symmetric
    differences with one common set: |a ^ b| = |a ^ c| + |b ^ c| - 2 |(a ^ c) & (b ^ c)|."""
    size = np.array([len(d) for d in deltas])
    row = np.repeat(np.arange(len(deltas)), size)
    _, column, count = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    shared = count > 1  # an element of one difference alone is in no intersection
    rank = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], rank[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(deltas), len(deltas)), dtype=np.float32)
    wide = 4096
    for low in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [low, low + wide])
        part = np.zeros((len(deltas), wide), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    apart = size[:, None] + size[None, :] - 2 * common.astype(np.int64)
    total = n[:, None] + n[None, :]
    return 100 * (total - apart) >= percent * (total + apart)  # twice the intersection, twice the union


def _tile(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        node, label = rows.column("node").to_pylist(), rows.column("component").to_pylist()
        own, first, second = (rows.column(c).to_numpy() for c in ("b", "bi", "bj"))
        deltas = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("delta")]
        ok = delta_links(rows.column("n").to_numpy(), deltas, percent)
        _, group = np.unique(np.array([x.hex() for x in label]), return_inverse=True)
        ok &= group[:, None] != group[None, :]
        if first[0] != second[0]:
            ok &= own[:, None] != own[None, :]
        root = np.arange(len(node))  # a spanning forest of what the tile links
        x, y = np.nonzero(np.triu(ok, 1))
        while len(x):
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            if (root == before).all():
                break
        moved = [(label[k], label[r]) for k, r in enumerate(root.tolist()) if r != k]
        return pa.table([pa.array([m[0] for m in moved], pa.binary()), pa.array([m[1] for m in moved], pa.binary())], names=["i", "j"])

    return run


def links(docs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(set_id, component) of every class that shares a bucket: pairs proposed by the bands, confirmed
    on full sets.

    Each bucket's members are tried against its centre, the member with the most bucket neighbours.
    Members that end in different components, though they share a centre, are then compared in tiles
    by their differences from that centre, which are short among near copies; a tile returns a
    spanning forest. So every pair of a bucket is decided, and none but the centre's is made a row."""
    rows = classes.select("set_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(rows.join(shared, "key"), "minhash-members")

    degree = members.groupBy("set_id").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "set_id")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "set_id")).alias("c"))
    pairs = (ranked.join(centre, "key").select(F.col("set_id").alias("node"), F.col("c.set_id").alias("centre"), "n")
             .filter("node <> centre").distinct())
    pairs = pairs.join(pairs.groupBy("centre").agg((F.count("*") > 1).alias("more")), "centre")
    pairs = stage(pairs, "minhash-pairs")
    tried = stage(verify(pairs, _texts(docs, classes, pairs, k), percent), "minhash-tried")
    nodes = members.select(F.col("set_id").alias("episode_id")).distinct()
    found = tried.filter("linked").select(F.col("node").alias("i"), F.col("centre").alias("j"))
    component = connected_components(nodes, found).select(F.col("episode_id").alias("set_id"), "component")

    label = component.select(F.col("set_id").alias("node"), "component")
    placed = tried.filter("delta is not null")
    size = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("bytes") / TILE_BYTES))
    open_ = (placed.select("node", "centre", F.octet_length("delta").alias("bytes")).join(label, "node")
             .groupBy("centre").agg(F.min("component").alias("a"), F.max("component").alias("b"), size.alias("blocks"))
             .filter("a <> b").select("centre", "blocks"))
    open_ = broadcast_if_small(stage(open_, "minhash-open"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    tiles = (placed.join(open_, "centre").join(label, "node").withColumn("b", F.pmod(F.xxhash64("node"), "blocks"))
             .select("centre", "node", "n", "component", "delta", "b", other)
             .withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o"))
    more = stage(tiles.groupBy("centre", "bi", "bj").applyInArrow(_tile(percent), "i binary, j binary").distinct(), "minhash-more")
    labels = component.select(F.col("component").alias("episode_id")).distinct()
    merged = connected_components(labels, more).select(F.col("episode_id").alias("component"), F.col("component").alias("_to"))
    return component.join(merged, "component").select("set_id", F.col("_to").alias("component"))


def _texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Full sets of the classes in ``pairs``, each from its first document (id, hash of the text)."""
    wanted = pairs.select(F.col("node").alias("set_id")).unionByName(pairs.select(F.col("centre").alias("set_id"))).distinct()
    wanted = stage(classes.select("set_id", F.col("first.id").alias("_id"), F.col("first.th").alias("_th")).join(wanted, "set_id"), "minhash-wanted")
    texts = docs.join(broadcast_if_small(wanted), F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")))
    return stage(_full_sets(texts, k), "minhash-sets")


def _groups(base: DataFrame, percent: int, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, th, first) of rows (id, text), one for each. ``first`` is the first document of
    the group: (none, id, th), ``none`` for a null id, which comes last; null without shingles."""
    sk = stage(sketch(base, k, bands, rows), "minhash-sketch")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    classes = (sk.filter("set_id is not null")
               .groupBy("set_id").agg(F.min(place).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    classes = stage(classes, "minhash-classes")
    component = links(base, classes, percent, k)
    named = classes.select("set_id", "first").join(component, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    named = named.select("set_id", "component").join(smallest, "component").select("set_id", "first")
    return sk.select("id", "n_shingles", "th", "set_id").join(named, "set_id", "left").select("id", "n_shingles", "th", "first")


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept): groups of documents linked by 100 * intersection
    >= ``percent`` * union of their distinct ``k``-word shingles (A-Z folded, words split at spaces).

    One row per input row. Null and empty texts have no shingles, are linked with nothing and stay.
    Rows of one id and one text are alike: they get the same answer. A null id never names a
    component while another member has one; ``kept`` compares null-safely. Other columns are ignored, whatever they are called; an
    empty table gives no rows."""
    out = _groups(_base(docs, id_col, text_col), percent, k, bands, rows)
    out = out.withColumn("component_id", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: that of the smallest id (a null id
    last), then of the smallest hash of the text, then the first of equal rows. Rows whose text has no
    shingles stay."""
    out = _groups(_base(docs, id_col, text_col), percent, k, BANDS, ROWS).filter("first is not null")
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    out = stage(out.select(F.col("id").alias("_id"), F.col("th").alias("_th"), is_first.alias("_first")), "minhash-fate")
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_th"))
    left = docs.join(broadcast_if_small(out.filter("not _first").select("_id", "_th").distinct()), same, "left_anti")
    again = stage(copies_per_node(out.filter("_first"), ["_id", "_th"]).filter("copies > 1").select("_id", "_th"), "minhash-again")
    if not again.limit(1).count():
        return left
    again = broadcast_if_small(again)
    rows = left.join(again, same).withColumn("_row", F.monotonically_increasing_id())
    one = rows.groupBy("_id", "_th").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), "_row").alias("_one"))
    return left.join(again, same, "left_anti").unionByName(one.select("_one.*"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


ORACLE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, c FROM reach JOIN links ON x = doc_id)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN reach USING (doc_id) GROUP BY doc_id"""
