"""Hexagonal grid cells and distances as column arithmetic.

Points are projected equirectangularly at a reference latitude, put on an axial hexagon grid by cube rounding
and packed into one long. Because packing is linear, a neighbour's cell is the cell plus a constant. The edge
is that of the reference's fixed grid resolution, but cell ids are not interchangeable with other grids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormweave.functions.binding import bind

EARTH_RADIUS_KM = 6371.0088
_SHIFT = 2_097_152  # 2^21 values per axis
_ORIGIN = 1_048_576


@dataclass(frozen=True)
class HexGrid:
    """A grid with the given edge; east-west scale is exact at the reference latitude only.

    `east` is the largest longitude that counts as valid: that of the world, unless a map is laid out further eastwards.
    """

    edge_km: float = 1.22
    reference_latitude: float = 22.5
    east: float = 180.0

    @property
    def kx(self) -> float:
        return EARTH_RADIUS_KM * math.pi / 180.0 * math.cos(math.radians(self.reference_latitude)) / self.edge_km

    @property
    def ky(self) -> float:
        return EARTH_RADIUS_KM * math.pi / 180.0 / self.edge_km

    def cell(self, latitude: Column, longitude: Column) -> Column:
        """Cell of a point; null when either coordinate is missing."""
        x = longitude * F.lit(self.kx)
        y = latitude * F.lit(self.ky)
        q = x * F.lit(math.sqrt(3.0) / 3.0) - y * F.lit(1.0 / 3.0)
        r = y * F.lit(2.0 / 3.0)
        def rounded(point: Column) -> Column:
            """Round to the nearest cell: the axis with the largest error follows from the other two."""
            axes = [point["q"], point["r"], -point["q"] - point["r"]]
            rq, rr, rs = (F.floor(v + F.lit(0.5)) for v in axes)
            dq, dr, ds = (F.abs(n - v) for n, v in zip((rq, rr, rs), axes, strict=True))
            q_worst = (dq > dr) & (dq > ds)
            axial_q = F.when(q_worst, -rr - rs).otherwise(rq)
            axial_r = F.when(~q_worst & (dr > ds), -rq - rs).otherwise(rr)
            return pack(axial_q, axial_r)

        here = F.struct(q.alias("q"), r.alias("r"))
        return F.when(latitude.isNotNull() & longitude.isNotNull(), bind(here, rounded))


GRID = HexGrid()


def pack(q: Column, r: Column) -> Column:
    return ((q + F.lit(_ORIGIN)) * F.lit(_SHIFT) + r + F.lit(_ORIGIN)).cast("bigint")


def axial_q(cell: Column) -> Column:
    return F.shiftright(cell, 21) - F.lit(_ORIGIN)


def axial_r(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_SHIFT - 1)) - F.lit(_ORIGIN)


def is_cell(cell: Column, grid: HexGrid = GRID) -> Column:
    """True for a packed cell inside the range that the grid's coordinates can reach."""
    limit = min(round(60_000 * max(grid.east / 180.0, 1.0)), _ORIGIN - 1)
    return (cell > 0) & (F.abs(axial_q(cell)) <= limit) & (F.abs(axial_r(cell)) <= limit)


def cell_distance(a: Column, b: Column) -> Column:
    dq = axial_q(a) - axial_q(b)
    dr = axial_r(a) - axial_r(b)
    return ((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / F.lit(2)).cast("int")


def ring_offsets(k: int) -> list[int]:
    """Packed offsets of all cells at most k steps away, the cell itself included."""
    return [
        dq * _SHIFT + dr
        for dq in range(-k, k + 1)
        for dr in range(max(-k, -dq - k), min(k, -dq + k) + 1)
    ]


def k_ring(cell: Column, k: int = 1) -> Column:
    """Array of the cell and its neighbours up to k steps; null for a null cell."""
    around = F.transform(F.array(*[F.lit(d).cast("bigint") for d in ring_offsets(k)]), lambda d: d + cell)
    return F.when(cell.isNotNull(), around)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def within_km(latitude: Column, longitude: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    """Radius predicate: a latitude/longitude box that reaches the scan, then the exact distance."""
    dlat = math.degrees(radius_km / EARTH_RADIUS_KM) * 1.000001
    box = latitude.between(lat0 - dlat, lat0 + dlat)
    # The widest longitude span of a circle on the sphere; the box is dropped near a pole or the date line.
    reach = math.sin(math.radians(dlat)) / max(math.cos(math.radians(lat0)), 1e-12)
    if reach < 1.0:
        dlon = math.degrees(math.asin(reach)) * 1.000001
        if -180.0 <= lon0 - dlon and lon0 + dlon <= 180.0:
            # Longitudes that went round the world are left to the distance, which takes them as the angles they are.
            box = box & (longitude.between(lon0 - dlon, lon0 + dlon) | ~longitude.between(-180.0, 180.0))
    return box & (haversine_km(latitude, longitude, F.lit(lat0), F.lit(lon0)) <= F.lit(radius_km))


def ewkt_point(latitude: Column, longitude: Column) -> Column:
    """`SRID=4326;POINT(lon lat)`; null unless both coordinates are present."""
    return F.concat(
        F.lit("SRID=4326;POINT("), longitude.cast("string"), F.lit(" "), latitude.cast("string"), F.lit(")")
    )
