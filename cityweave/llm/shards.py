"""Shards of even size with few cut links, by balanced label propagation.

Documents begin spread over the shards. In each round every linked document counts its neighbours'
shards by joins and asks to move to the one with most of them; a matrix of wishes, one number for
each pair of shards, is fitted to the quotas, and that many moves are made. Rounds move downwards and
upwards in turn, so two neighbours can't swap for ever. Unlinked documents fill what is left."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import rank_in
from .common import stage, table

SHARDS = 8
ROUNDS = 16


def _hash_chunk(h: str) -> Column:
    return (F.shiftright(h, 52) + 2048).cast("long")  # 0 to 4095, in the order of the signed hash


def _ranked(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """1-based rank by hash of the node."""
    d = df.withColumn("_all", F.lit(0)).withColumn("_h", F.xxhash64("node"))
    return rank_in(d, keys or ["_all"], ["_h", "node"], _hash_chunk("_h"), out).drop("_all", "_h")


def quotas(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def allowed(wishes: dict[tuple[int, int], int], sizes: list[int], limits: list[int], down: bool) -> dict[tuple[int, int], int]:
    """How many of the wished moves keep every shard within its limit. All moves of a round go one
    way, so the shards at that end are settled first and what leaves a shard makes room in it."""
    shards = range(len(sizes))
    granted: dict[tuple[int, int], int] = {}
    for j in shards if down else reversed(shards):
        leaving = sum(x for (a, _), x in granted.items() if a == j)
        room = limits[j] - sizes[j] + leaving
        for i in sorted((i for i, to in wishes if to == j), key=lambda i: -wishes[i, j]):
            granted[i, j] = min(wishes[i, j], max(room, 0))
            room -= granted[i, j]
    return granted


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, limits: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(node, label) of linked ``nodes``; ``edges`` (u, w) are undirected, once each."""
    labels = stage(_ranked(nodes, [], "_r").select("node", F.pmod(F.col("_r") - 1, F.lit(shards)).cast("int").alias("label")), "shard-labels")
    links = stage(edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w"))), "shard-links")
    idle = 0
    for r in range(rounds):
        down = r % 2 == 0
        theirs = links.join(labels.select(F.col("node").alias("w"), F.col("label").alias("to")), "w")
        votes = theirs.groupBy("u", "to").agg(F.count("*").alias("n"))
        best = (votes.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy("u", "label")
                .agg(F.max(F.struct("n", (-F.col("to")).alias("to"))).alias("best"), F.coalesce(F.sum(F.when(F.col("to") == F.col("label"), F.col("n"))), F.lit(0)).alias("own")))
        to = -F.col("best.to")
        wish = (best.filter((F.col("best.n") > F.col("own")) & ((to < F.col("label")) if down else (to > F.col("label"))))
                .select(F.col("u").alias("node"), "label", to.alias("to"), (F.col("best.n") - F.col("own")).alias("gain")))
        wish = stage(wish, "shard-wishes")
        matrix = {(x["label"], x["to"]): x["n"] for x in wish.groupBy("label", "to").agg(F.count("*").alias("n")).collect()}
        idle = idle + 1 if not matrix else 0
        if idle == 2:
            break
        if not matrix:
            continue
        sizes = {x["label"]: x["n"] for x in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
        granted = allowed(matrix, [sizes.get(j, 0) for j in range(shards)], limits, down)
        if any(granted[k] < n for k, n in matrix.items()):
            level = 30 - F.least(F.floor(F.log2("gain")), F.lit(30))  # larger gains first
            d = wish.withColumn("_h", F.xxhash64("node")).withColumn("_g", level)
            d = rank_in(d, ["label", "to"], ["_g", "_h", "node"], F.col("_g") * 4096 + _hash_chunk("_h"), "_r")
            most = F.lit(0)
            for (i, j), n in granted.items():
                most = F.when((F.col("label") == i) & (F.col("to") == j), F.lit(n)).otherwise(most)
            wish = d.filter(F.col("_r") <= most)
        moved = labels.join(wish.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").cast("int").alias("label"))
        labels = stage(moved, "shard-labels")
    return labels


def balanced(nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) of every node (unique, not null); the shards' counts are at most one apart."""
    total = nodes.count()
    limits = quotas(total, shards)
    linked = stage(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("w").alias("node"))).distinct(), "shard-linked")
    placed = propagate(linked, edges, shards, limits, rounds)
    used = {x["label"]: x["n"] for x in placed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    free = _ranked(nodes.select("node").join(placed, "node", "left_anti"), [], "_r")
    shard, end = F.lit(shards - 1), total - sum(used.values())
    for j in reversed(range(shards)):
        shard = F.when(F.col("_r") <= end, F.lit(j)).otherwise(shard)
        end -= limits[j] - used.get(j, 0)
    return placed.select("node", F.col("label").alias("shard")).unionByName(free.select("node", shard.cast("int").alias("shard")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard), one row per input row, by the law ``rows``.

    Links: documents of one text, each with the first of them in order of id. ``size`` is the UTF-8
    bytes plus 1; a null text has no bytes, checksum 0 and no links, an empty one is a text like
    others. Slots follow the ids (nulls first); repeated rows are rows of their own. With fewer rows
    than shards the last shards stay empty. Extra columns are ignored."""
    raw = F.col(text_col).cast("string").cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
                    F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.unhex(F.md5(raw)).alias("text"))
    rows = stage(d.withColumn("node", F.monotonically_increasing_id()), "shard-rows")  # fixed once written
    groups = rows.filter("text is not null").groupBy("text", "size").agg(F.count("*").alias("n"), F.min(F.struct("id", "node")).alias("hub")).filter("n > 1")
    edges = rows.join(groups, ["text", "size"]).select(F.col("node").alias("u"), F.col("hub.node").alias("w")).filter("u <> w")
    placed = stage(balanced(rows.select("node"), stage(edges, "shard-edges"), shards, rounds), "shard-placed")
    out = rows.select("id", "size", "text_crc32", "node").join(placed, "node")
    chunk = F.coalesce(F.floor(F.col("id") / 65536), F.lit(-(1 << 62)))
    out = rank_in(stage(out, "shard-out"), ["shard"], ["id", "node"], chunk, "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                      (F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
