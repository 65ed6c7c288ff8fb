"""Variable-capacity best-fit packing of documents into sequences of permitted lengths.

Only lengths matter to a packing, and there are no more of them than the largest capacity. So the
lengths are counted on the cluster, that histogram is packed by best fit in decreasing order (equal
bins are one group, so the work doesn't grow with the documents), and documents find their place by
their rank among those of their length. The packing is the one that best fit would make of the whole
corpus at once, not of blocks of it."""
from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import rank_in
from .common import stage, table

CAPACITIES = (512, 1024, 2048, 4096, 8192)
PER_BIN, QUADRATIC = 16.0, 65_536.0  # cost of a sequence of n: PER_BIN + n + n * n / QUADRATIC


def cost(capacity: int) -> float:
    return PER_BIN + capacity + capacity * capacity / QUADRATIC


class Bins:
    """Open bins in groups of equals: first bin, number, capacity, used, items as (parent, length, per bin, offset)."""

    def __init__(self):
        self.by_space: dict[int, list] = defaultdict(list)
        self.spaces: list[int] = []
        self.n = 0

    def put(self, group: tuple) -> None:
        space = group[2] - group[3]
        if not self.by_space[space]:
            insort(self.spaces, space)
        self.by_space[space].append(group)

    def tightest(self, length: int) -> tuple | None:
        """Take out a group with the least space that holds ``length``."""
        at = bisect_left(self.spaces, length)
        if at == len(self.spaces):
            return None
        space = self.spaces[at]
        group = self.by_space[space].pop()
        if not self.by_space[space]:
            del self.spaces[at]
        return group

    def open(self, n: int, capacity: int) -> tuple:
        self.n += n
        return self.n - n, n, capacity, 0, None


def fill(histogram: dict[int, int], opening) -> Bins:
    """Best fit in decreasing order; ``opening(length)`` is the capacity of a new bin."""
    bins = Bins()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            group = bins.tightest(length)
            if group is None:
                capacity = opening(length)
                group = bins.open(-(-left // (capacity // length)), capacity)
            first, n, capacity, used, items = group
            each = (capacity - used) // length  # a bin just used is the tightest, until it is full
            whole = min(n, left // each)
            if whole:
                bins.put((first, whole, capacity, used + each * length, (items, length, each, used)))
                left -= whole * each
            if whole < n and 0 < left < each:
                bins.put((first + whole, 1, capacity, used + left * length, (items, length, left, used)))
                whole, left = whole + 1, 0
            if whole < n:
                bins.put((first + whole, n - whole, capacity, used, items))
    return bins


def downsized(used: int, capacities: tuple) -> int:
    return capacities[bisect_left(capacities, used)]


def plan(histogram: dict[int, int], capacities: tuple = CAPACITIES) -> list[tuple]:
    """(first bin, bins, capacity, items) of the cheapest packing among these ways to open a bin: the
    size of least cost for each document of this length, or always one certain size or the next that
    holds it."""
    best, least = None, None
    rules = [lambda n: min((c for c in capacities if c >= n), key=lambda c: (cost(c) / (c // n), c))]
    rules += [lambda n, size=size: next(c for c in capacities if c >= max(n, size)) for size in capacities]
    for rule in rules:
        bins = fill(histogram, rule)
        groups = [(g[0], g[1], downsized(g[3], capacities), g[4]) for at in bins.by_space.values() for g in at]
        total = sum(g[1] * cost(g[2]) for g in groups)
        if least is None or total < least:
            best, least = groups, total
    return sorted(best, key=lambda g: g[0])


def places(groups: list[tuple]) -> pd.DataFrame:
    """Ranks [low, high) of a length and where they go: bin = first + (rank - low) // each, at
    offset + (rank - low) % each * length."""
    rows, seen = [], defaultdict(int)
    for first, n, capacity, items in groups:
        while items:
            items, length, each, offset = items
            rows.append((length, seen[length], seen[length] + n * each, first, each, offset, capacity))
            seen[length] += n * each
    return pd.DataFrame(rows, columns=["length", "low", "high", "first", "each", "at", "capacity"])


def pack(docs: DataFrame, capacities: tuple = CAPACITIES, id_col: str = "doc_id", length_col: str = "n_words") -> DataFrame:
    """(id_col, piece, start, length, bin, capacity, offset): each document, cut into pieces of the
    largest capacity where it is longer, has its words ``start`` to ``start + length`` at ``offset``
    of a bin. Bins are numbered from 0 without gaps; what they hold is within ``capacity``.

    A document without words (a length null or below 1) is one row with length 0 and null bin, capacity
    and offset. Equal lengths go by id (nulls first); repeated rows are packed as often as they come.
    Extra columns are ignored; an empty table gives no rows."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)))).alias("piece")
    pieces = stage(d.select("id", "n", piece).select("id", "piece", F.least(F.col("n") - F.col("piece") * top, F.lit(top)).alias("length")), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``top`` rows
    if not histogram:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("bin", "long"), ("capacity", "int"), ("offset", "long"))]
        return pieces.select(F.col("id").alias(id_col), "piece", F.lit(0).cast("long").alias("start"), "length", *none)
    found = docs.sparkSession.createDataFrame(places(plan(histogram, capacities)), "length long, low long, high long, first long, each long, at long, capacity int")
    chunk = F.coalesce(F.floor(F.col("id") / 65536), F.lit(-(1 << 62)))
    ranked = rank_in(pieces, ["length"], ["id", "piece"], chunk, "rank").withColumn("rank", F.col("rank") - 1)
    p, q = ranked.alias("p"), F.broadcast(found).alias("q")  # as large as the largest capacity allows, whatever the documents
    out = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    nth = F.col("rank") - F.col("low")
    return out.select(F.col("p.id").alias(id_col), "piece", (F.col("piece") * top).alias("start"), F.col("p.length").alias("length"),
                      (F.col("first") + F.floor(nth / F.col("each"))).alias("bin"), "capacity",
                      (F.col("at") + nth % F.col("each") * F.col("p.length")).alias("offset"))


def pack_texts(docs: DataFrame, capacities: tuple = CAPACITIES) -> DataFrame:
    """Pack documents (doc_id, text) by their numbers of words between white space."""
    n = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"))
    return pack(docs.select("doc_id", n.alias("n_words")), capacities)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))
