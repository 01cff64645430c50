"""Hexagonal spatial binning as a Catalyst expression.

A planar pointy-top hexagon grid around an origin (one city per origin):

* equirectangular projection to km:
  ``x = (lon - lon0) * kx``, ``y = (lat - lat0) * ky`` with
  ``kx = 111.32 * cos(lat0)`` and ``ky = 110.574``;
* hexagon circumradius ``s = sqrt(2 A / (3 sqrt 3))`` for the mean cell
  area ``A`` of the resolution (0..15, ``schema.HEX_AREA_KM2``);
* fractional axial coordinates ``q = (sqrt3/3 * x - y / 3) / s``,
  ``r = (2/3 * y) / s``, then cube rounding to the nearest cell centre;
* id ``"{res}:{q}:{r}"``.

All constants are computed here once and enter the plan as double literals,
so each row costs a handful of IEEE + - * / and ``floor`` operations inside
whole-stage codegen. The same constants render the SQL form
(``hex_cell_sql``), so any engine doing IEEE arithmetic assigns identical
cells. Cell ids and borders differ from other hexagon libraries; everything
downstream depends only on the grouping.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbscope.schema import (DEFAULT_CENTER, HEX_AREA_KM2, KM_PER_DEG_LAT,
                              KM_PER_DEG_LON_EQUATOR)


@dataclass(frozen=True)
class HexGrid:
    resolution: int
    lat0: float
    lon0: float
    kx: float
    ky: float
    size: float
    c_q: float   # sqrt(3) / 3
    c_r: float   # 2 / 3


def hex_grid_constants(resolution: int = 9, origin: tuple[float, float] = DEFAULT_CENTER) -> HexGrid:
    if resolution not in HEX_AREA_KM2:
        raise ValueError(f"resolution must be one of {sorted(HEX_AREA_KM2)}, got {resolution}")
    lat0, lon0 = float(origin[0]), float(origin[1])
    area = HEX_AREA_KM2[resolution]
    return HexGrid(
        resolution=resolution, lat0=lat0, lon0=lon0,
        kx=KM_PER_DEG_LON_EQUATOR * math.cos(math.radians(lat0)),
        ky=KM_PER_DEG_LAT,
        size=math.sqrt(2.0 * area / (3.0 * math.sqrt(3.0))),
        c_q=math.sqrt(3.0) / 3.0,
        c_r=2.0 / 3.0,
    )


def hex_axial(lat: Column, lon: Column, g: HexGrid) -> tuple[Column, Column]:
    """Integer axial (q, r) of the cell containing (lat, lon)."""
    lit = F.lit
    x = (lon - lit(g.lon0)) * lit(g.kx)
    y = (lat - lit(g.lat0)) * lit(g.ky)
    return _rounded((lit(g.c_q) * x - y / lit(3.0)) / lit(g.size), (lit(g.c_r) * y) / lit(g.size))


def _rounded(qf: Column, rf: Column) -> tuple[Column, Column]:
    """Nearest cell centre of fractional axial coordinates (cube rounding)."""
    yf = -qf - rf
    rq, ry, rr = (F.floor(v + F.lit(0.5)) for v in (qf, yf, rf))
    dq, dy, dr = F.abs(rq - qf), F.abs(ry - yf), F.abs(rr - rf)
    q_fix = (dq > dy) & (dq > dr)
    q = F.when(q_fix, -ry - rr).otherwise(rq)
    r = F.when(q_fix | (dy > dr), rr).otherwise(-rq - ry)
    return q, r


def hex_cell_id(lat: Column, lon: Column, resolution: int = 9,
                origin: tuple[float, float] = DEFAULT_CENTER) -> Column:
    g = hex_grid_constants(resolution, origin)
    q, r = hex_axial(lat, lon, g)
    return F.concat_ws(":", F.lit(str(resolution)), q.cast("string"), r.cast("string"))


@dataclass(frozen=True)
class City:
    """A grid origin: the cells around it carry its name."""

    name: str
    lat: float
    lon: float


#: Origins up to which the choice is one expression over all of them.
MOST_CITIES = 1000


def nearest_city(lat: Column, lon: Column, cities: list[City]) -> Column:
    """Place in ``cities`` of the one nearest to (lat, lon) by great-circle
    distance (equal ones: the first); NULL for a NULL coordinate.

    Compares squared chords between points on the unit sphere, one
    sum of products per city; the city list is a bounded constant.
    """
    if not 1 <= len(cities) <= MOST_CITIES:
        raise ValueError(f"1 to {MOST_CITIES} cities, got {len(cities)}")
    la, lo = F.radians(lat), F.radians(lon)
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    near = []
    for i, c in enumerate(cities):
        cla, clo = math.radians(c.lat), math.radians(c.lon)
        dx, dy, dz = x - F.lit(math.cos(cla) * math.cos(clo)), y - F.lit(math.cos(cla) * math.sin(clo)), z - F.lit(math.sin(cla))
        near.append(F.struct((dx * dx + dy * dy + dz * dz).alias("d"), F.lit(i).alias("i")))
    best = F.least(*near) if len(near) > 1 else near[0]
    return F.when(lat.isNotNull() & lon.isNotNull(), best["i"])


def add_city_cells(df: DataFrame, cities: list[City], resolution: int = 9, lat: str = "latitude",
                   lon: str = "longitude", out: str = "hex_id") -> DataFrame:
    """Add the cell on the grid of the nearest city, projected around that
    city: ``"{city}:{res}:{q}:{r}"`` (NULL for a NULL coordinate).

    Each step comes out of a one-row generator, so that the choice of the
    city and the projection are computed once a record and not again in every
    term of the rounding. The grids' constants are an array picked from by
    the city's place: one projection a record, not one for each city.
    """
    grids = [hex_grid_constants(resolution, (c.lat, c.lon)) for c in cities]
    g = grids[0]
    consts = F.array(*[F.struct(F.lit(c.name).alias("_city"), F.lit(k.lon0).alias("_lon0"), F.lit(k.kx).alias("_kx"), F.lit(k.lat0).alias("_lat0"))
                       for c, k in zip(cities, grids)])
    keep = df.columns
    one = lambda *fields: F.inline(F.array(F.struct(*fields)))
    df = df.select("*", one(nearest_city(F.col(lat), F.col(lon), cities).alias("_place")))
    df = df.select(*keep, one(F.get(consts, F.col("_place")).alias("_grid"))).select(*keep, "_grid.*")
    x, y = (F.col(lon) - F.col("_lon0")) * F.col("_kx"), (F.col(lat) - F.col("_lat0")) * F.lit(g.ky)
    df = df.select(*keep, "_city", one(((F.lit(g.c_q) * x - y / F.lit(3.0)) / F.lit(g.size)).alias("_qf"),
                                       ((F.lit(g.c_r) * y) / F.lit(g.size)).alias("_rf")))
    q, r = _rounded(F.col("_qf"), F.col("_rf"))
    cell = F.concat_ws(":", "_city", F.lit(str(resolution)), q.cast("string"), r.cast("string"))
    return df.select(*keep, F.when(F.col("_city").isNotNull(), cell).alias(out))


def hex_cell_sql(lat: str, lon: str, resolution: int = 9,
                 origin: tuple[float, float] = DEFAULT_CENTER) -> str:
    """The same cell id as ANSI SQL text (used by the DuckDB oracle)."""
    g = hex_grid_constants(resolution, origin)

    def d(v: float) -> str:
        return f"CAST('{v!r}' AS DOUBLE)"

    x = f"(({lon} - {d(g.lon0)}) * {d(g.kx)})"
    y = f"(({lat} - {d(g.lat0)}) * {d(g.ky)})"
    qf = f"((({d(g.c_q)} * {x}) - ({y} / {d(3.0)})) / {d(g.size)})"
    rf = f"(({d(g.c_r)} * {y}) / {d(g.size)})"
    yf = f"((-{qf}) - {rf})"
    rq, ry, rr = (f"floor({v} + {d(0.5)})" for v in (qf, yf, rf))
    dq, dy, dr = (f"abs({a} - {b})" for a, b in ((rq, qf), (ry, yf), (rr, rf)))
    q_fix = f"(({dq} > {dy}) AND ({dq} > {dr}))"
    q = f"CAST(CASE WHEN {q_fix} THEN (-{ry}) - {rr} ELSE {rq} END AS BIGINT)"
    r = f"CAST(CASE WHEN {q_fix} OR ({dy} > {dr}) THEN {rr} ELSE (-{rq}) - {ry} END AS BIGINT)"
    return f"('{resolution}' || ':' || CAST({q} AS VARCHAR) || ':' || CAST({r} AS VARCHAR))"
