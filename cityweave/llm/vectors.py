"""Near-duplicate vectors within a label by int8 tile products with rigorous error bounds.

Unit vectors are rounded to int8 with a scale of their own. For x = s_x q_x + e_x the product of two
unit vectors differs from s_x s_y (q_x . q_y) by at most |e_x| + |s_x q_x| |e_y|, so a pair whose
approximation plus that bound stays below the threshold is out for certain; the others are computed
in double precision. Equal vectors are one class, and a tile returns counts and a spanning forest,
so a group of copies costs its rows and not its pairs."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.link import connected_components
from .common import stage, table

BLOCK = 1024  # vectors on a tile's side
PAIRS_AT_ONCE = 1 << 16


def quantize(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of the rounded vector, norm of the error) of unit vectors, by row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(unit - rounded, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between the rows of ``a`` and ``b`` (``same``: i < j)."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ra, ea = quantize(a / na[:, None])
    qb, sb, _, eb = quantize(b / nb[:, None])
    # products of int8 codes are exact in float32 up to 1,000 dimensions, in float64 beyond
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    dots = qa.astype(kind) @ qb.astype(kind).T
    bound = ea[:, None] + ra[:, None] * eb[None, :] + 1e-9
    maybe = dots * sa[:, None] * sb[None, :] + bound >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    for k in range(0, len(i), PAIRS_AT_ONCE):
        x, y = i[k:k + PAIRS_AT_ONCE], j[k:k + PAIRS_AT_ONCE]
        yes = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
        yield x[yes], y[yes]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest reachable index of each of n nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for x, y in pairs:
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
        root = root[root]
        if (root == before).all():
            return root


def _tile(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        sides = rows.column("members").combine_chunks()
        flat = sides.flatten()
        node, copies, raw = (flat.field(f) for f in ("node", "copies", "vec"))
        dim = len(raw[0].as_py()) // 4
        vec = np.frombuffer(b"".join(raw.to_pylist()), dtype="<f4").reshape(-1, dim).astype(np.float64)
        weight, cut, same = copies.to_numpy(zero_copy_only=False), len(sides[0]), len(sides) == 1
        first, second = (vec, vec) if same else (vec[:cut], vec[cut:])
        pairs = [(x, y if same else y + cut) for x, y in tile_links(first, second, threshold, same)]
        links = np.zeros(len(vec), dtype=np.int64)
        for x, y in pairs:
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
        has = np.flatnonzero(links)
        root = _roots(len(vec), pairs)
        return pa.table([node.take(pa.array(has)), pa.array(links[has]), node.take(pa.array(root[has]))], names=["node", "links", "root"])

    return run


def packed(vectors: DataFrame) -> DataFrame:
    """(id, part, vec): little-endian float32 of each vector, null where it can't be compared;
    ``part`` is label and length."""
    x = F.col("embedding")
    usable = (F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
              & F.exists(x, lambda v: v != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding").to_pylist()
            raw = [None if v is None else (np.asarray(v, dtype="<f4") + np.float32(0)).tobytes() for v in lists]  # + 0: one zero
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(raw, pa.binary())], ["id", "part", "vec"])

    part = F.concat_ws(":", F.col("label").cast("string"), F.size(x).cast("string"))
    return vectors.select("id", part.alias("part"), F.when(usable, x).alias("embedding")).mapInArrow(pack, "id long, part string, vec binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of a table (vec_id, embedding, label), one row per input row.

    Only rows of one label and one length are compared. A null label, a null, empty or zero vector,
    and a vector with a null or non-finite component link with nothing: n_links 0, component_id
    their own id. Repeated rows are equal vectors: each is linked to all others. A null id never
    names a component while another member has one; ``kept`` compares null-safely. Extra columns are
    ignored; an empty table gives no rows."""
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").alias("label"))
    rows = stage(packed(base).withColumn("node", F.unhex(F.md5(F.concat(F.col("part").cast("binary"), "vec")))), "vectors")
    classes = rows.filter("vec is not null").groupBy("part", "vec", "node").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    classes = stage(classes, "vector-classes")
    blocks = classes.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = (classes.join(blocks, "part").withColumn("b", F.pmod(F.xxhash64("node"), "blocks"))
               .groupBy("part", "blocks", "b").agg(F.collect_list(F.struct("node", "copies", "vec")).alias("members")))  # about ``block`` rows each
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    tiles = members.select("part", "b", "members", other).select("part", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "members")
    found = stage(tiles.groupBy("part", "i", "j").applyInArrow(_tile(threshold), "node binary, links long, root binary"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("episode_id")).distinct(),
                                     found.filter("node <> root").select(F.col("node").alias("i"), F.col("root").alias("j")).distinct())
    named = (classes.join(counts, "node", "left")
             .join(component.select(F.col("episode_id").alias("node"), "component"), "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(named, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), cid.alias("component_id"),
                      F.col("id").eqNullSafe(cid).alias("kept"))


def op9_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, cast(embedding AS double[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT y, c FROM reach JOIN links ON x = vec_id),
named AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id), counted AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN counted USING (vec_id)"""
