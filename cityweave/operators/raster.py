"""Grids as long tables (row, col, value), frames as (frame, row, col, value)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .scale import running_before, running_last, stage, with_scalars

D8 = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def block_mean(grid: DataFrame, k: int, value: str = "value", keys=()) -> DataFrame:
    """Mean of each whole k x k block, counted from the grid's first row and column; the blocks cut by
    its last row or column are left out."""
    edge = grid.agg(F.min("row").alias("_r0"), F.min("col").alias("_c0"), F.max("row").alias("_r1"), F.max("col").alias("_c1"))
    d = with_scalars(grid, edge)
    at = lambda x, low: F.floor((F.col(x) - F.col(low)) / k)
    whole = lambda b, low, high: (F.col(b) + 1) * k <= F.col(high) - F.col(low) + 1
    d = d.withColumn("brow", at("row", "_r0")).withColumn("bcol", at("col", "_c0"))
    return d.filter(whole("brow", "_r0", "_r1") & whole("bcol", "_c0", "_c1")).groupBy(*keys, "brow", "bcol").agg(F.avg(value).alias("mean"))


def depth_series(blocks: DataFrame, frames: int, from_m: float) -> DataFrame:
    """Blocks that ever reach ``from_m``: centimetres per frame from the first wet frame on, its
    offset and the frame of the peak. The array has one entry per frame, a bounded axis."""
    cm = F.bround(F.col("mean") * 100, 0).cast("bigint")
    a = blocks.groupBy("brow", "bcol").agg(
        F.max("mean").alias("peak"), F.map_from_entries(F.collect_list(F.struct("frame", cm.alias("cm")))).alias("m"))
    a = a.filter(F.col("peak") >= from_m)
    full = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0)))
    a = a.withColumn("_d", full)
    first = F.array_position(F.transform("_d", lambda x: x > 0), True)
    a = a.withColumn("_o", F.when(first > 0, first - 1).otherwise(F.size("_d")).cast("int"))
    return a.select("brow", "bcol", F.col("_o").cast("bigint").alias("offset"),
                    F.slice("_d", F.col("_o") + 1, F.greatest(F.lit(0), F.size("_d") - F.col("_o"))).alias("depth_cm"),
                    (F.array_position("_d", F.array_max("_d")) - 1).alias("peak_frame"))


def frame_summary(depth: DataFrame, cell_m: float, people: str = None, p: Params = DEFAULT) -> DataFrame:
    area = cell_m * cell_m
    wet = F.col("value") >= p.show_depth_m
    crowd = F.col(people) if people else F.lit(0.0)
    return depth.groupBy("frame").agg(
        (F.count(F.when(wet, 1)) > 0).alias("wet"), (F.count(F.when(wet, 1)) * area / 1e6).alias("wet_area_km2"),
        (F.max("value") * 100).alias("max_depth_cm"), (F.sum("value") * area).alias("volume_m3"),
        F.coalesce(F.sum(F.when(F.col("value") >= 0.10, crowd)), F.lit(0.0)).alias("people_over_10cm"))


def zonal_frames(depth: DataFrame, zone: str) -> DataFrame:
    """Share at or over 10 cm and the deepest value per zone and frame."""
    return depth.groupBy(zone, "frame").agg(
        (F.avg(F.when(F.col("value") >= 0.10, 1.0).otherwise(0.0)) * 100).alias("over10_pct"),
        (F.max("value") * 100).alias("max_depth_cm"))


def zonal_peaks(depth: DataFrame, zone: str, p: Params = DEFAULT) -> DataFrame:
    """Per zone: deepest value, the frame it came in, share of pixels whose peak is 10 cm or more."""
    px = depth.groupBy(zone, "row", "col").agg(
        F.max("value").alias("peak"), F.min_by("frame", F.struct((-F.col("value")).alias("v"), "frame")).alias("at"))
    z = px.groupBy(zone).agg(
        F.max("peak").alias("_p"), F.min_by("at", F.struct((-F.col("peak")).alias("v"), "row", "col")).alias("peak_frame"),
        (F.avg(F.when(F.col("peak") >= 0.10, 1.0).otherwise(0.0)) * 100).alias("area_over_10cm_pct"))
    return z.filter(F.col("_p") >= p.show_depth_m).select(zone, (F.col("_p") * 100).alias("peak_depth_cm"), "peak_frame", "area_over_10cm_pct")


# ------------------------------------------------------------------ gauges ------------------
def gauge_as_of(readings: DataFrame, probes: DataFrame, chunk_sec: int = 86400) -> DataFrame:
    """Latest gauge value at or before each probe time, zero before the first. Both frames:
    gauge, t (epoch); readings add ``value`` (distinct per gauge and t)."""
    r = readings.select("gauge", "t", F.lit(0).alias("kind"), F.col("value").cast("double").alias("value"))
    q = probes.select("gauge", "t", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("value"))
    d = running_last(r.unionByName(q), ["gauge"], ["t", "kind"], F.floor(F.col("t") / chunk_sec), F.col("value"), "rate")
    return d.filter("kind = 1").select("gauge", "t", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def _idw(cell_m: float, power: float):
    def run(cells: pa.Table, gauges: pa.Table) -> pa.Table:
        names, kinds = ["frame", "row", "col", "top", "bot"], [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not cells.num_rows or not gauges.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        frame, row, col = (cells.column(c).to_numpy() for c in ("frame", "row", "col"))
        spots, spot = np.unique(np.stack([row, col]), axis=1, return_inverse=True)
        gframe, grow, gcol, rate = (gauges.column(c).to_numpy() for c in ("frame", "grow", "gcol", "rate"))
        places, place = np.unique(np.stack([grow, gcol]), axis=1, return_inverse=True)
        dist = np.hypot(spots[0][:, None] - places[0], spots[1][:, None] - places[1]) * cell_m
        weight = 1.0 / np.maximum(dist, cell_m) ** power  # once for a place, whatever the frames
        frames = np.unique(frame)
        at = np.searchsorted(frames, gframe)
        known = (at < len(frames)) & (frames[np.minimum(at, len(frames) - 1)] == gframe)
        rates, there = np.zeros((places.shape[1], len(frames))), np.zeros((places.shape[1], len(frames)))
        np.add.at(rates, (place.ravel()[known], at[known]), rate[known])
        np.add.at(there, (place.ravel()[known], at[known]), 1.0)
        top, bot, f = weight @ rates, weight @ there, np.searchsorted(frames, frame)
        spot = spot.ravel()
        return pa.table([pa.array(x, k) for x, k in zip((frame, row, col, top[spot, f], bot[spot, f]), kinds)], names=names)

    return run


def interpolate(cells: DataFrame, gauges: DataFrame, cell_m: float, p: Params = DEFAULT, tile: int = 64, block: int = 1024) -> DataFrame:
    """Inverse-distance weighted value at each (frame, row, col) from the gauges (grow, gcol, rate) of
    its frame. Every gauge weighs on every cell: tiles of cells meet blocks of gauge places, a weight
    is worked out once for a cell and a place, and the blocks' sums are added up."""
    box = cells.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()
    places = gauges.select("grow", "gcol").distinct().count()
    if box[0] is None or not places:
        return cells.limit(0).withColumn("value", F.lit(0.0))
    wide, blocks = int(box[3] - box[1]) // tile + 1, -(-places // block)
    tiles = (int(box[2] - box[0]) // tile + 1) * wide
    many = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    t = (F.floor((F.col("row") - box[0]) / tile) * wide + F.floor((F.col("col") - box[1]) / tile)).cast("int")
    c = cells.select(*[F.col(x).cast("bigint").alias(x) for x in ("frame", "row", "col")], t.alias("t"), many(blocks, "b"))
    g = (gauges.select(F.col("frame").cast("bigint").alias("frame"), *[F.col(x).cast("double").alias(x) for x in ("grow", "gcol", "rate")])
         .withColumn("b", F.pmod(F.xxhash64("grow", "gcol"), F.lit(blocks)).cast("int")).select("*", many(tiles, "t")))
    part = c.groupBy("t", "b").cogroup(g.groupBy("t", "b")).applyInArrow(_idw(float(cell_m), p.idw_power), "frame bigint, row bigint, col bigint, top double, bot double")
    return part.groupBy("frame", "row", "col").agg((F.sum("top") / F.sum("bot")).alias("value")).filter(F.col("value").isNotNull())


# ------------------------------------------------------------------ ranks and quantiles -----
def cumulative_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, before): rows strictly below each distinct value, without a global sort: ranges of
    values, as many as their number asks for, are the chunks of a running count."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange("value").withColumn("_range", F.spark_partition_id()), "value-counts")
    return running_before(ranged.withColumn("_all", F.lit(0)), ["_all"], ["value"], F.col("_range"), F.col("n"), "before").drop("_all", "_range")


def share_below(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percent of rows strictly below each row's value."""
    c = cumulative_counts(df, value)
    c = with_scalars(c, df.agg(F.count("*").alias("_total"))).select(F.col("value").alias(value), (F.col("before") * 100.0 / F.col("_total")).alias(out))
    return df.join(c, value)


def quantiles(df: DataFrame, value: str, probs=(0.1, 0.5, 0.9)) -> DataFrame:
    """Exact linear-interpolated quantiles from the cumulative counts."""
    c = cumulative_counts(df, value)
    pr = F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q")
    d = with_scalars(c, df.agg(F.count("*").alias("_total"))).select("*", pr)
    pos = F.col("q") * (F.col("_total") - 1)
    covers = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    d = d.filter(covers(F.floor(pos)) | covers(F.ceil(pos)))
    frac = pos - F.floor(pos)
    return d.groupBy("q").agg(
        (F.max(F.when(covers(F.floor(pos)), F.col("value"))) * (1 - F.max(frac))
         + F.max(F.when(covers(F.ceil(pos)), F.col("value"))) * F.max(frac)).alias("value"))


# ------------------------------------------------------------------ focal operators ---------
def disk(radius_m: float, cell_m: float) -> dict:
    """Offsets of the pixels whose centres are within ``radius_m``, with weight 1."""
    n = int(radius_m // cell_m)
    return {(a, b): 1.0 for a in range(-n, n + 1) for b in range(-n, n + 1) if (a * a + b * b) ** 0.5 * cell_m <= radius_m}


def square(n: int) -> dict:
    """Offsets of an n x n window, n odd."""
    return {(a, b): 1.0 for a in range(-(n // 2), n // 2 + 1) for b in range(-(n // 2), n // 2 + 1)}


def _line_runs(weights: dict) -> list[tuple[int, int, float]]:
    """(first, last, weight) of the runs of equal weights along a line of {offset: weight}."""
    out: list[list] = []
    for b, w in sorted(weights.items()):
        if out and out[-1][1] == b - 1 and out[-1][2] == w:
            out[-1][1] = b
        else:
            out.append([b, b, w])
    return [tuple(x) for x in out]


def kernel_plan(kernel: dict, flat: bool = False) -> tuple[list, list]:
    """How to slide a kernel: (row steps, column runs). A kernel that is a column times a row is two passes along
    a line, whose runs of equal weight are differences of running sums: ([(a0, a1, weight)], [runs of
    the row]). Any other one is a run or more for each of its rows: ([], [(a, b0, b1, weight)]). The work
    follows the kernel's outline, not its area. ``flat``: weights don't count."""
    kernel = {k: 1.0 for k in kernel} if flat else {k: float(w) for k, w in kernel.items()}
    rows: dict[int, dict] = {}
    for (a, b), w in kernel.items():
        rows.setdefault(a, {})[b] = w
    full = max(rows.values(), key=len)
    b0 = max(full, key=lambda b: abs(full[b]))
    if full[b0] and all(set(r) == set(full) for r in rows.values()):
        column = {a: r[b0] / full[b0] for a, r in rows.items()}
        if all(abs(r[b] - column[a] * full[b]) <= 1e-12 * abs(full[b0]) for a, r in rows.items() for b in full):
            return _line_runs(column), _line_runs(full)
    return [], [(a, *run) for a, r in sorted(rows.items()) for run in _line_runs(r)]


def _sums(x: np.ndarray, plan: tuple[list, list], tile: int, ry: int, rx: int) -> np.ndarray:
    """The kernel's weighted sums over an array with a halo of its reach."""
    along = lambda y: np.concatenate([np.zeros((len(y), 1)), np.cumsum(y, axis=1)], axis=1)
    part = lambda s, a, b, r: s[:, r + b + 1:r + b + 1 + tile] - s[:, r + a:r + a + tile] if b > a else None

    def line(y: np.ndarray, runs: list, r: int) -> np.ndarray:
        s = along(y) if any(b > a for a, b, _ in runs) else None
        return sum(w * (part(s, a, b, r) if b > a else y[:, r + a:r + a + tile]) for a, b, w in runs)

    if plan[0]:
        return line(line(x, plan[1], rx).T, plan[0], ry).T
    s = along(x)
    return sum(w * (s[ry + a:ry + a + tile, rx + d + 1:rx + d + 1 + tile] - s[ry + a:ry + a + tile, rx + c:rx + c + tile]) for a, c, d, w in plan[1])


def _highest(x: np.ndarray, plan: tuple[list, list], tile: int, ry: int, rx: int) -> np.ndarray:
    """The kernel's maximum: that of a run is that of the two blocks of 2^k that cover it."""
    def blocks(y: np.ndarray, longest: int) -> list[np.ndarray]:
        out = [y]
        while 2 << len(out) - 1 <= longest:
            step = 1 << len(out) - 1
            y = out[-1]
            out.append(np.maximum(y, np.concatenate([y[:, step:], np.full((len(y), min(step, y.shape[1])), -np.inf)], axis=1)))
        return out

    def run(levels: list, a: int, b: int, r: int, rows: slice = slice(None)) -> np.ndarray:
        k = (b - a + 1).bit_length() - 1
        return np.maximum(levels[k][rows, r + a:r + a + tile], levels[k][rows, r + b + 1 - (1 << k):r + b + 1 - (1 << k) + tile])

    def line(y: np.ndarray, runs: list, r: int) -> np.ndarray:
        levels = blocks(y, max(b - a + 1 for a, b, _ in runs))
        return np.maximum.reduce([run(levels, a, b, r) for a, b, _ in runs])

    if plan[0]:
        return line(line(x, plan[1], rx).T, plan[0], ry).T
    levels = blocks(x, max(d - c + 1 for _, c, d, _ in plan[1]))
    return np.maximum.reduce([run(levels, c, d, rx, slice(ry + a, ry + a + tile)) for a, c, d, _ in plan[1]])


def _focal(kernel: dict, tile: int, box: tuple, how: str, nearest: bool):
    ry, rx = (max(abs(o[k]) for o in kernel) for k in (0, 1))
    plan = kernel_plan(kernel, how == "max")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * tile - ry, key[1].as_py() * tile - rx
        row, col = rows.column("row").to_numpy(), rows.column("col").to_numpy()
        i, j = row - r0, col - c0
        v, m = (np.zeros((tile + 2 * ry, tile + 2 * rx)) for _ in range(2))
        v[i, j], m[i, j] = rows.column("v").to_numpy(), 1.0
        if nearest:  # beyond the grid's edge the nearest pixel is repeated
            at = np.ix_(*(np.clip(np.arange(n), low - first, high - first) for n, first, low, high in
                          ((v.shape[0], r0, box[0], box[2]), (v.shape[1], c0, box[1], box[3]))))
            v, m = v[at], m[at]
        if how == "max":
            made = _highest(np.where(m > 0, v, -np.inf), plan, tile, ry, rx)
        else:
            made = _sums(v, plan, tile, ry, rx)
        own = (i >= ry) & (i < ry + tile) & (j >= rx) & (j < rx + tile)
        out = made[i[own] - ry, j[own] - rx]
        if how == "mean":
            out = out / _sums(m, plan, tile, ry, rx)[i[own] - ry, j[own] - rx]
        return pa.table([pa.array(row[own]), pa.array(col[own]), pa.array(out)], names=["row", "col", "focal"])

    return run


def focal(grid: DataFrame, kernel: dict, value: str = "value", how: str = "mean", mode: str = "existing", tile: int = None) -> DataFrame:
    """Weighted ``mean`` or ``sum``, or the ``max``, over {(drow, dcol): weight} around each pixel, for
    kernels of any size (see ``kernel_plan``): tiles with a halo of the kernel's reach, each a bounded
    array in its task. ``existing`` takes the pixels there are; ``nearest`` repeats the edge pixels beyond
    the edges. Tiles are 256 pixels wide, for wide kernels up to 1,024."""
    ry, rx = (max(abs(o[k]) for o in kernel) for k in (0, 1))
    tile = max(256, min(1024, 4 * max(ry, rx))) if tile is None else tile
    box = tuple(grid.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first())

    def around(c, r):
        return F.sequence(F.floor((c - r) / tile), F.floor((c + r) / tile))

    halo = (grid.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col(value).cast("double").alias("v"))
            .withColumn("tr", F.explode(around(F.col("row"), ry))).withColumn("tc", F.explode(around(F.col("col"), rx))))
    return halo.groupBy("tr", "tc").applyInArrow(_focal(kernel, tile, box, how, mode == "nearest"), "row bigint, col bigint, focal double")


def terrain_facts(dem: DataFrame, cell: str, upstream: DataFrame = None) -> DataFrame:
    """(cell, rel_m, flow_pct) of the cells a DEM's pixels (row, col, value, ``cell``) lie in: the cell's
    mean height against its two rings, and the percent of pixels whose flow, taken as the largest
    upstream count in a 5 x 5 window, is below that of the cell's largest."""
    up = flow_accumulation(dem) if upstream is None else upstream
    near = focal(up, square(5), "upstream", "max").withColumnRenamed("focal", "flow")
    ranked = share_below(near, "flow", "pct")
    flow = dem.select("row", "col", cell).join(ranked, ["row", "col"]).groupBy(cell).agg(F.max("pct").alias("flow_pct"))
    mean = dem.groupBy(F.col(cell).alias("h3_cell")).agg(F.avg("value").alias("_z"))
    rel = ring_contrast(mean, "_z").select(F.col("h3_cell").alias(cell), F.col("contrast").alias("rel_m"))
    return rel.join(flow, cell)


def ring_contrast(cells: DataFrame, value: str, k: int = 2) -> DataFrame:
    """A cell's value minus the mean of the other cells within k rings."""
    from ..functions.hexgrid import ring
    near = cells.select(F.col("h3_cell").alias("_from"), F.col(value).alias("_v"), F.explode(ring(F.col("h3_cell"), k)).alias("h3_cell")).filter("_from <> h3_cell")
    m = near.groupBy("h3_cell").agg(F.avg("_v").alias("_m"))
    return cells.join(m, "h3_cell").withColumn("contrast", F.col(value) - F.col("_m")).drop("_m")


# ------------------------------------------------------------------ flow --------------------
def flow_direction(dem: DataFrame) -> DataFrame:
    """(row, col, drow, dcol): steepest drop among eight neighbours (diagonals over 1.414), first
    neighbour on a tie; pixels without a lower neighbour are absent."""
    k = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for o, (dr, dc) in enumerate(D8)]))
    want = dem.select("row", "col", F.col("value").alias("z"), k.alias("k")).select(
        "row", "col", "z", "k.o", (F.col("row") + F.col("k.dr")).alias("nr"), (F.col("col") + F.col("k.dc")).alias("nc"),
        ((F.col("k.dr") != 0) & (F.col("k.dc") != 0)).alias("diag"))
    n = want.join(dem.select(F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("value").alias("nz")), ["nr", "nc"])
    drop = (F.col("z") - F.col("nz")) / F.when(F.col("diag"), 1.414).otherwise(1.0)
    n = n.withColumn("drop", drop).filter("drop > 0")
    return n.groupBy("row", "col").agg(F.max_by(F.struct("nr", "nc"), F.struct("drop", -F.col("o"))).alias("d")).select(
        "row", "col", F.col("d.nr").alias("drow"), F.col("d.nc").alias("dcol"))


def flow_accumulation(dem: DataFrame, salts: int = 16) -> DataFrame:
    """Upstream pixel count including self, by pointer doubling: after k rounds a pixel counts
    everything within 2^k steps, so rounds grow with the logarithm of the longest path. A pixel's
    pointer target may be shared by many, so the pointer lookup is salted."""
    node = lambda r, c: F.struct(F.col(r).cast("bigint").alias("r"), F.col(c).cast("bigint").alias("c"))
    flow = flow_direction(dem)
    s = (dem.select("row", "col").join(flow, ["row", "col"], "left")
         .select(node("row", "col").alias("x"), F.when(F.col("drow").isNotNull(), node("drow", "dcol")).alias("to"), F.lit(1).cast("bigint").alias("acc")))
    s = stage(s, "flow")
    while True:  # flow runs downhill, so every path ends
        live = s.filter("to is not null")
        if live.limit(1).count() == 0:
            return s.select(F.col("x.r").alias("row"), F.col("x.c").alias("col"), F.col("acc").alias("upstream"))
        add = live.groupBy(F.col("to").alias("x")).agg(F.sum("acc").alias("_add"))
        hop = (s.filter("to is not null").select(F.col("x").alias("to"), F.col("to").alias("_next"))
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
        salted = s.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int"))
        s = stage(salted.join(hop, ["to", "_salt"], "left").join(add, "x", "left")
                  .select("x", F.col("_next").alias("to"), (F.col("acc") + F.coalesce("_add", F.lit(0))).alias("acc")), "flow")


# ------------------------------------------------------------------ resampling test ---------
def hash_index(draw, j, n, seed: int) -> Column:
    """Reproducible index in [0, n) from a seed, a draw number and a position."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), j.cast("string")).cast("binary")), 1, 15), 16, 10)
    return F.pmod(h.cast("bigint"), n)


def resample_p(places: DataFrame, share: str, named: DataFrame, draws: int = 20_000, pool: int = 500, seed: int = 42) -> DataFrame:
    """How often k random places average at least the named places' mean. ``places``: pos (dense
    from 0) and a share; a pool of ``pool`` of them is drawn by hash, then ``draws`` samples of
    k = number of named places from the pool."""
    spark = places.sparkSession
    n = places.agg(F.count("*").alias("n"))
    hot = named.agg(F.avg(share).alias("hot_mean"), F.count("*").alias("k"))
    pool_df = (with_scalars(spark.range(pool).withColumnRenamed("id", "i"), n)
               .withColumn("pos", hash_index(F.col("i"), F.lit(-1), F.col("n"), seed)).join(places.select("pos", share), "pos")
               .select("i", F.col(share).alias("s")))
    d = (with_scalars(spark.range(draws).withColumnRenamed("id", "draw"), hot)
         .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
         .withColumn("i", hash_index(F.col("draw"), F.col("j"), F.lit(pool), seed)).join(F.broadcast(pool_df), "i"))  # pool rows
    m = d.groupBy("draw", "hot_mean").agg(F.avg("s").alias("m"))
    return m.agg(F.max("hot_mean").alias("hot_mean"), F.avg(F.when(F.col("m") >= F.col("hot_mean"), 1.0).otherwise(0.0)).alias("p_value"))


def against_city(named: DataFrame, share: str, city_share: DataFrame) -> DataFrame:
    """Local share over the city-wide share per named place. ``city_share``: one row."""
    return with_scalars(named, city_share).withColumn("vs_city", F.col(share) / F.greatest("city", F.lit(1e-9)))


