"""Hexagonal binning: every point lies in the cell whose centre is nearest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curbscope.functions.grid import hex_cell_id, hex_grid_constants

NEIGHBOURS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]


def centre(q, r, g):
    """Planar (x, y) km of the centre of axial cell (q, r)."""
    return g.size * math.sqrt(3) * (q + r / 2), g.size * 1.5 * r


@pytest.mark.parametrize("res", [5, 7, 8, 9, 10, 12])
def test_points_bin_to_nearest_centre(spark, res):
    g = hex_grid_constants(res)
    rnd = random.Random(res)
    pts = [(i, 12.9716 + rnd.uniform(-0.2, 0.2), 77.5946 + rnd.uniform(-0.2, 0.2))
           for i in range(4000)]
    df = spark.createDataFrame(pts, "i int, lat double, lon double")
    ids = {r.i: r.h for r in df.select("i", hex_cell_id(F.col("lat"), F.col("lon"), res)
                                       .alias("h")).collect()}
    for i, lat, lon in pts:
        r_, q, r = (int(v) for v in ids[i].split(":"))
        assert r_ == res
        x = (lon - g.lon0) * g.kx
        y = (lat - g.lat0) * g.ky
        cx, cy = centre(q, r, g)
        d = math.hypot(x - cx, y - cy)
        assert d <= g.size * 1.0000001             # inside the circumcircle
        for dq, dr in NEIGHBOURS:
            nx, ny = centre(q + dq, r + dr, g)
            assert d <= math.hypot(x - nx, y - ny) + 1e-9


def test_cell_area_matches_resolution():
    for res, area in [(7, 5.161), (8, 0.737), (9, 0.105), (10, 0.015)]:
        g = hex_grid_constants(res)
        assert 3 * math.sqrt(3) / 2 * g.size ** 2 == pytest.approx(area)
    with pytest.raises(ValueError):
        hex_grid_constants(16)


def test_cells_around_several_cities(spark):
    """Every point lies in a cell of its nearest city, on that city's grid."""
    import math
    import random

    from curbscope.functions.grid import City, add_city_cells, hex_cell_id
    from pyspark.sql import functions as F

    cities = [City("a", 12.97, 77.59), City("b", 28.61, 77.21), City("c", -33.87, 151.21), City("d", 64.15, -21.94)]
    rng = random.Random(5)
    points = [(c.lat + rng.uniform(-3, 3), c.lon + rng.uniform(-3, 3)) for c in cities for _ in range(60)]
    points += [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(60)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    own = [hex_cell_id(F.col("latitude"), F.col("longitude"), 7, (c.lat, c.lon)).alias(c.name) for c in cities]
    got = add_city_cells(df, cities, 7).select("*", *own).collect()
    assert len(got) == len(points)

    def far(r, c):
        a, b = math.radians(r.latitude), math.radians(c.lat)
        half = math.radians(r.longitude - c.lon) / 2
        return math.sin((a - b) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(half) ** 2

    for r in got:
        if r.latitude is None or r.longitude is None:
            assert r.hex_id is None
        else:
            c = min(cities, key=lambda c: far(r, c))
            assert r.hex_id == f"{c.name}:{r[c.name]}"


def test_city_list_is_bounded(spark):
    import pytest

    from curbscope.functions.grid import City, nearest_city
    from pyspark.sql import functions as F

    for n in (0, 1001):
        with pytest.raises(ValueError):
            nearest_city(F.lit(1.0), F.lit(1.0), [City(str(i), 0.0, 0.0) for i in range(n)])
