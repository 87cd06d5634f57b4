"""Rings, polygons with holes, GeoJSON of them, and points in them."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cadastra.functions.geo import cell_ring, laea, lonlat
from cadastra.operators import geometry
from cadastra.operators import polygons as area
from cadastra.sinks.export import feature


def squares(spark, rows):
    """rows: territory, x, y, side."""
    out = [(t, [[float(x), float(y)], [float(x + s), float(y)], [float(x + s), float(y + s)], [float(x), float(y + s)]]) for t, x, y, s in rows]
    return spark.createDataFrame(out, "territory string, ring array<array<double>>")


def found(spark, rows):
    rings = area.stored(area.assembled(area.boundary(squares(spark, rows))))
    return {r.territory: r for r in area.polygons(rings, 3.0).collect()}


def test_parts_holes_and_islands(spark):
    ring = [(x, y) for x in range(5) for y in range(5) if not (1 <= x <= 3 and 1 <= y <= 3)]
    rows = [("island", x, y, 1) for x, y in ring] + [("island", 2, 2, 1)]
    rows += [("diamond", x, y, 1) for x, y in ((1, 0), (0, 1), (2, 1), (1, 2))]  # four that touch in points; the gap is no hole
    rows += [("bent", x, y, 1) for x, y in ((0, 0), (1, 0), (2, 0), (2, 1), (0, 1), (0, 2), (1, 2))]  # its hole touches the outside
    rows += [("apart", 0, 0, 1), ("apart", 7, 0, 2)]
    rows += [("holes", x, y, 1) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))]  # holes that touch
    got = found(spark, rows)
    shape = {t: (r.area, r.n_parts, r.n_holes) for t, r in got.items()}
    assert shape == {"island": (17.0, 2, 1), "diamond": (4.0, 4, 0), "bent": (7.0, 1, 1), "apart": (5.0, 2, 0), "holes": (14.0, 1, 2)}
    parts = got["island"].parts
    assert [len(p) for p in parts] == [2, 1] and {(p.x, p.y) for p in parts[1][0]} == {(2, 2), (3, 2), (3, 3), (2, 3)}
    for r in got.values():
        for part in r.parts:
            for ring in part:
                assert len({(p.x, p.y) for p in ring}) == len(ring)


def test_geojson_of_two_parts_and_a_hole(spark):
    x0, y0 = 4_000_000, 2_800_000
    rows = [("t", x0 + 1000 * x, y0 + 1000 * y, 1000) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [("t", x0 + 9000, y0, 1000), ("u", x0, y0, 1000)]
    shapes = area.polygons(area.stored(area.assembled(area.boundary(squares(spark, rows)))), 2000.0)
    lines = {r.territory: json.loads(r.json) for r in shapes.select("territory", feature(F.col("parts"), {"id": F.col("territory")}).alias("json")).collect()}
    two, one = lines["t"]["geometry"], lines["u"]["geometry"]
    assert lines["t"]["properties"] == {"id": "t"} and two["type"] == "MultiPolygon" and [len(p) for p in two["coordinates"]] == [2, 1]
    assert one["type"] == "Polygon" and len(one["coordinates"]) == 1
    for ring in [r for p in two["coordinates"] for r in p] + one["coordinates"]:
        assert ring[0] == ring[-1] and len(ring) >= 5
        assert all(4 < lon < 9 and 47 < lat < 50 for lon, lat in ring)
    back = spark.createDataFrame([(49.1, 6.7), (52.0, 10.0), (47.5, 12.25)], "lat double, lon double").select("lat", "lon", *[c.alias(n) for c, n in zip(laea(F.col("lat"), F.col("lon")), "xy")])
    for r in back.select("lat", "lon", *[c.alias(n) for c, n in zip(lonlat(F.col("x"), F.col("y")), ("lo", "la"))]).collect():
        assert math.isclose(r.lo, r.lon, abs_tol=1e-8) and math.isclose(r.la, r.lat, abs_tol=1e-8)


def test_points_in_overlapping_shapes(spark):
    rng = random.Random(4)
    shapes, rows = {}, []
    for i in range(12):
        n, cx, cy = rng.randint(3, 30), rng.uniform(0, 100), rng.uniform(0, 100)
        ring = [(cx + rng.uniform(5, 40) * math.cos(2 * math.pi * k / n), cy + rng.uniform(5, 40) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        shapes[i] = ring
        rows += [(i, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    points = [(k, rng.uniform(-20, 120), rng.uniform(-20, 120)) for k in range(2000)]

    def odd(ring, x, y):
        return sum((y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) < x for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    want = {(k, i) for k, x, y in points for i, ring in shapes.items() if odd(ring, x, y)}
    edges = spark.createDataFrame(rows, "shape long, x1 double, y1 double, x2 double, y2 double")
    spots = spark.createDataFrame(points, "point long, x double, y double")
    for size in (7.0, 60.0):
        got = [tuple(r) for r in area.inside(spots, edges, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n, spread", [(2, 9000), (50, 40000), (400, 60000)])
def test_cells_share_their_corners(n, spread):
    rng = random.Random(n)
    sites = [(rng.uniform(0, spread), rng.uniform(0, spread)) for _ in range(n)]
    edges = set()
    total = 0.0
    for s in sites:
        ring = cell_ring(s, sorted((q for q in sites if q != s and math.dist(s, q) < 12000), key=lambda q: math.dist(s, q)), 6000.0)
        total += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
        ring = [(round(x, 3), round(y, 3)) for x, y in ring]
        edges |= {(a, b) for a, b in zip(ring, ring[1:] + ring[:1]) if a != b}
    rim = [(a, b) for a, b in edges if (b, a) not in edges]
    assert sorted(a for a, _ in rim) == sorted(b for _, b in rim)
    assert math.isclose(total, sum(a[0] * b[1] - b[0] * a[1] for a, b in rim) / 2, rel_tol=1e-6)


def test_places_that_share_a_point_share_its_cell(spark, tmp_path):
    from cadastra import queries as core

    for name in ("nation", "region", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    some = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey < 6")
    again = some.withColumns({"c_custkey": F.col("c_custkey") + 58000, "c_nationkey": (F.col("c_nationkey") + 3) % 25})  # points come again after 58,000 keys
    some.union(again).write.parquet(f"{tmp_path}/customer.parquet")
    found = core.QUERIES["territory_polygons"](spark, str(tmp_path)).collect()
    assert found and all(r.same_area and r.whole for r in found)


def test_a_cell_looks_no_farther_than_it_must():
    def outward():
        yield from ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (3.0, 3.0))
        raise AssertionError("a site was asked for that can't cut the cell")

    assert sorted(set(cell_ring((0.0, 0.0), outward(), 100.0))) == [(-0.5, -0.5), (-0.5, 0.5), (0.5, -0.5), (0.5, 0.5)]


def test_crowded_cells_are_those_of_all_others(spark):
    points = [(f"p{i:03}", 48.5 + random.Random(i).random() / 50, 6.0 + random.Random(-1 - i).random() / 50) for i in range(300)]
    frame = spark.createDataFrame(points, "id string, lat double, lon double")
    x, y = laea(F.col("lat"), F.col("lon"))
    at = {r.id: (r.x, r.y) for r in frame.select("id", x.alias("x"), y.alias("y")).collect()}
    for r in geometry.cells(frame, 500.0).collect():
        others = sorted((p for i, p in at.items() if i != r.id), key=lambda p: math.dist(p, at[r.id]))
        assert [tuple(p) for p in r.ring] == [tuple(round(c, 3) for c in p) for p in cell_ring(at[r.id], others, 500.0)], r.id


def test_the_smallest_territory_needs_no_rings(spark):
    edges = area.boundary(squares(spark, [("wide", 0, 0, 4), ("wide", 4, 0, 4), ("small", 3, 1, 2)]))
    points = spark.createDataFrame([(1, 1.0, 1.5), (2, 4.0, 2.0), (3, 9.0, 1.0)], "point int, x double, y double")
    sizes = spark.createDataFrame([("wide", 9), ("small", 2)], "territory string, settlements int")
    assert sorted(map(tuple, area.smallest_at(points, edges, sizes, 1.0).collect())) == [(1, "wide", 9), (2, "small", 2)]
