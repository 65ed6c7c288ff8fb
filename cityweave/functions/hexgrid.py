"""Hexagonal cells as pure Column arithmetic (axial coordinates on a local plane).

A cell id packs (q, r) into one bigint, so a k-ring is "id + constant offsets" and a
neighbour join is an equi-join. Grid distance is an integer expression of two ids."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v

BIAS = 1 << 20
SHIFT = 1 << 21


@dataclass(frozen=True)
class HexGrid:
    edge_m: float = v.HEX_EDGE_M
    lat0: float = v.CITY_CENTRE[0]
    lon0: float = v.CITY_CENTRE[1]

    @property
    def _ky(self):
        return math.radians(1) * v.EARTH_RADIUS_KM * 1000

    @property
    def _kx(self):
        return self._ky * math.cos(math.radians(self.lat0))

    def fractional(self, lat, lon):
        x = (lon - F.lit(self.lon0)) * F.lit(self._kx / self.edge_m)
        y = (lat - F.lit(self.lat0)) * F.lit(self._ky / self.edge_m)
        return x * F.lit(math.sqrt(3) / 3) - y / F.lit(3.0), y * F.lit(2.0) / F.lit(3.0)

    def cell(self, lat, lon) -> Column:
        q, r = self.fractional(lat, lon)
        half = F.lit(0.5)
        rq, rr, rs = F.floor(q + half), F.floor(r + half), F.floor(-q - r + half)
        dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
        fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
        fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
        return pack(fq, fr)

    def cell_of(self, lat: float, lon: float) -> int:
        """The cell of one known place (a constant), by the same arithmetic as ``cell``."""
        x, y = (lon - self.lon0) * (self._kx / self.edge_m), (lat - self.lat0) * (self._ky / self.edge_m)
        q, r = x * (math.sqrt(3) / 3) - y / 3.0, y * 2.0 / 3.0
        rq, rr, rs = (math.floor(z + 0.5) for z in (q, r, -q - r))
        dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs + q + r)
        if dq > dr and dq > ds:
            rq = -rr - rs
        elif dr > ds:
            rr = -rq - rs
        return (rq + BIAS) * SHIFT + rr + BIAS

    def centroid(self, cell):
        """(lat, lon) of the cell centre."""
        q, r = axial(cell)
        lon = F.lit(self.lon0) + (q + r / F.lit(2.0)) * F.lit(math.sqrt(3) * self.edge_m / self._kx)
        lat = F.lit(self.lat0) + r * F.lit(1.5 * self.edge_m / self._ky)
        return lat, lon

    def boundary(self, cell) -> Column:
        """Closed ring of [lng, lat] vertices."""
        lat, lon = self.centroid(cell)
        pts = []
        for k in list(range(6)) + [0]:
            a = math.radians(60 * k - 30)
            pts.append(F.array(lon + F.lit(self.edge_m * math.cos(a) / self._kx),
                               lat + F.lit(self.edge_m * math.sin(a) / self._ky)))
        return F.array(*pts)


def _span(low, high) -> Column:
    return F.explode(F.sequence(F.floor(low).cast("bigint") - 1, F.ceil(high).cast("bigint") + 1))


def cells_in_boxes(boxes, grid: HexGrid, keys: list):
    """(keys, h3_cell): the cells whose centre lies in a box (lat0, lon0, lat1, lon1), edges included.
    Rows of cells come from the latitudes, cells of a row from the longitudes."""
    _, r0 = grid.fractional(F.col("lat0"), F.col("lon0"))
    _, r1 = grid.fractional(F.col("lat1"), F.col("lon0"))
    rows = boxes.select(*keys, "lat0", "lon0", "lat1", "lon1", _span(r0, r1).alias("_r"))
    lat = F.lit(grid.lat0) + F.col("_r") * F.lit(1.5 * grid.edge_m / grid._ky)
    q0, q1 = (grid.fractional(lat, F.col(x))[0] for x in ("lon0", "lon1"))
    cells = rows.select(*keys, "lat0", "lon0", "lat1", "lon1", "_r", _span(q0, q1).alias("_q")).withColumn("h3_cell", pack(F.col("_q"), F.col("_r")))
    clat, clon = grid.centroid(F.col("h3_cell"))
    return cells.filter(clat.between(F.col("lat0"), F.col("lat1")) & clon.between(F.col("lon0"), F.col("lon1"))).select(*keys, "h3_cell")


def pack(q, r) -> Column:
    return ((q + F.lit(BIAS)) * F.lit(SHIFT) + (r + F.lit(BIAS))).cast("bigint")


def axial(cell):
    return (F.floor(cell / F.lit(SHIFT)) - F.lit(BIAS)).cast("bigint"), \
        (cell % F.lit(SHIFT) - F.lit(BIAS)).cast("bigint")


def ring_offsets(k: int):
    return [dq * SHIFT + dr for dq in range(-k, k + 1) for dr in range(-k, k + 1)
            if max(abs(dq), abs(dr), abs(dq + dr)) <= k]


def ring(cell, k: int = 1) -> Column:
    """Array of the cell and everything within k steps: 7 cells for k=1, 19 for k=2."""
    return F.array(*[cell + F.lit(o).cast("bigint") for o in ring_offsets(k)])


def distance(a, b) -> Column:
    (qa, ra), (qb, rb) = axial(a), axial(b)
    dq, dr = qb - qa, rb - ra
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def spread(cell_aggs) -> Column:
    """Largest pairwise grid distance of a group, from six running extremes:
    (min q, max q, min r, max r, min q+r, max q+r). Exact, and a plain partial aggregate."""
    a, b, c, d, e, f = cell_aggs
    return F.greatest(b - a, d - c, f - e)


def spread_aggs(cell):
    q, r = axial(cell)
    return [F.min(q), F.max(q), F.min(r), F.max(r), F.min(q + r), F.max(q + r)]


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = (F.pow(F.sin(dp / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2))
    return F.lit(2 * v.EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def in_bbox(lat, lon, bbox=v.CITY_BBOX) -> Column:
    return lat.between(bbox[0], bbox[2]) & lon.between(bbox[1], bbox[3])
