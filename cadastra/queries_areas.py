"""Queries of areas: territories dissolved from cells, and which of them a point is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.geo import laea
from cadastra.operators import geometry as geo
from cadastra.operators import hierarchy as tree
from cadastra.operators import polygons as area
from cadastra.plans.adapter import FIRST, LAST, from_tables, sql_views
from cadastra.queries_geo import laea_sql
from cadastra.registry import query
from cadastra.sinks import export

YEAR, RADIUS_M = 1998, 6000.0
#: How far the rim of a cell, a line of 96 corners, lies inside its circle at most.
RIM_M = 3.3


@query("""WITH RECURSIVE squares AS (SELECT DISTINCT n_regionkey AS t, c_custkey * 37 % 20 AS x, c_custkey * 53 % 23 AS y FROM customer JOIN nation ON c_nationkey = n_nationkey),
beside AS (SELECT a.t, a.x, a.y, b.x AS bx, b.y AS by FROM squares a JOIN squares b ON a.t = b.t AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT t, x, y, x AS rx, y AS ry FROM squares UNION SELECT r.t, r.x, r.y, b.bx, b.by FROM reach r JOIN beside b ON b.t = r.t AND b.x = r.rx AND b.y = r.ry),
roots AS (SELECT t, x, y, min({'x': rx, 'y': ry}) AS root FROM reach GROUP BY t, x, y),
parts AS (SELECT t, count(DISTINCT root) AS n_parts, count(*) AS n FROM roots GROUP BY t),
pairs AS (SELECT t, count(*) // 2 AS n FROM beside GROUP BY t),
sides AS (SELECT r.t, root, r.x + ax AS x1, r.y + ay AS y1, r.x + bx AS x2, r.y + cy AS y2 FROM roots r CROSS JOIN (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 0, 1, 1, 1), (-1, 0, 0, 0, 0, 1)) v (dx, dy, ax, ay, bx, cy)
  WHERE NOT EXISTS (SELECT 1 FROM squares s WHERE s.t = r.t AND s.x = r.x + dx AND s.y = r.y + dy)),
ways AS (SELECT t, root, x1 AS x, y1 AS y, x2 AS bx, y2 AS cy FROM sides UNION ALL SELECT t, root, x2, y2, x1, y1 FROM sides),
lines AS (SELECT DISTINCT t, root, x, y, x AS rx, y AS ry FROM ways UNION SELECT l.t, l.root, l.x, l.y, w.bx, w.cy FROM lines l JOIN ways w ON w.t = l.t AND w.root = l.root AND w.x = l.rx AND w.y = l.ry),
points AS (SELECT t, root, x, y, min({'x': rx, 'y': ry}) AS line FROM lines GROUP BY t, root, x, y),
corners AS (SELECT t, count(*) AS v, count(DISTINCT {'root': root, 'line': line}) AS c FROM points GROUP BY t),
edges AS (SELECT t, count(*) AS e FROM sides GROUP BY t)
SELECT p.t AS territory, p.n::double AS area, n_parts::int AS n_parts, (e.e - k.v + k.c - n_parts)::int AS n_holes, 4 * p.n - 2 * coalesce(i.n, 0) AS outline
FROM parts p JOIN edges e ON e.t = p.t JOIN corners k ON k.t = p.t LEFT JOIN pairs i ON i.t = p.t""")
def dissolved_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit square a customer, on a grid; each region's squares as polygons with holes. The twin counts the parts that hang together by sides, and by Euler's formula for their borders the holes of each."""
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    x, y = (F.col("c_custkey") * 37 % 20).cast("double"), (F.col("c_custkey") * 53 % 23).cast("double")
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1))
    rings = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("territory"), ring.alias("ring")).distinct()
    edges = area.boundary(rings)
    found = area.polygons(area.assembled(edges), 4.0)
    return found.join(edges.groupBy("territory").agg(F.count("*").alias("outline")), "territory").select("territory", "area", "n_parts", "n_holes", "outline")


def _cells(spark: SparkSession, sf_dir: str, first: int, last: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The cells, the members of all territories in these years, the cells of settlements, and the runs of years."""
    ds = from_tables(spark, sf_dir)
    located = ds.places.where("kind = 'settlement' and lat is not null")
    point = [F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")]
    owners = geo.cell_owners(located.withColumns({"approximate": F.lit(False), "confidence_order": F.lit(0)})).select("owner", F.col("lat5").alias("lat"), F.col("lon5").alias("lon"))
    cells = area.stored(geo.cells(owners.withColumnRenamed("owner", "id"), RADIUS_M), "cells")
    cell_of = located.select(F.col("id").alias("settlement"), *point).join(owners, ["lat", "lon"]).select("settlement", F.col("owner").alias("id"))
    members = area.stored(tree.members(tree.edges_by_year(ds.memberships, first, last), ds.places).join(located.select(F.col("id").alias("settlement")), "settlement", "left_semi"), "members")
    return cells, members, cell_of, area.stored(tree.versions(members), "versions")


def _areas(spark: SparkSession, sf_dir: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """The areas of all territories in these years, and km2, what their distinct cells have together at the start of each run of years."""
    cells, members, cell_of, versions = _cells(spark, sf_dir, first, last)
    own = members.withColumnRenamed("year", "from_year").join(versions.select("territory", "from_year"), ["territory", "from_year"]).join(cell_of, "settlement")
    sums = own.select("territory", "from_year", "id").distinct().join(cells.select("id", "area_km2"), "id").groupBy("territory", "from_year").agg(F.sum("area_km2").alias("km2"))
    return area.territory_areas(cells, members, cell_of, versions, RADIUS_M), sums


def territory_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, from_year, to_year, json: each territory's area in each run of years as a GeoJSON feature, simplified to 30 m."""
    found, _ = _areas(spark, sf_dir, FIRST, LAST)
    kinds = from_tables(spark, sf_dir).places.select(F.col("id").alias("territory"), "place_type")
    found = area.simplified(found, 30.0).join(kinds, "territory")
    properties = {"id": F.col("territory"), "from_year": F.col("from_year"), "to_year": F.col("to_year"), "settlements": F.col("n_members"), "place_type": F.col("place_type")}
    return found.select(F.col("territory").alias("id"), "from_year", "to_year", export.feature(F.col("parts"), properties).alias("json"))


VIEWS = "WITH RECURSIVE " + sql_views()
#: year, territory and settlement, by the shortest way down; settlements end it.
MEMBERS = f"""years AS (SELECT unnest(range({FIRST}, {LAST + 1}))::int AS year), edges AS (SELECT y.year, m.child_id, m.parent_id FROM memberships m JOIN years y ON coalesce(m.from_year, -9999) <= y.year AND y.year <= coalesce(m.to_year, 9999)),
down AS (SELECT year, parent_id AS territory, child_id AS id FROM edges UNION SELECT d.year, d.territory, e.child_id FROM down d JOIN edges e ON e.year = d.year AND e.parent_id = d.id WHERE d.id NOT LIKE 'c%'),
members AS (SELECT year, territory, id AS settlement FROM down WHERE id LIKE 'c%')"""


@query(f"""{VIEWS}, {MEMBERS}, sets AS (SELECT territory, year, count(*) AS n, list_sort(list(settlement))::varchar AS key FROM members GROUP BY ALL),
marked AS (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM key AND last = year - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY territory ORDER BY year) AS run FROM (SELECT *, lag(key) OVER (PARTITION BY territory ORDER BY year) AS before, lag(year) OVER (PARTITION BY territory ORDER BY year) AS last FROM sets))
SELECT territory AS id, min(year)::int AS from_year, max(year)::int AS to_year, any_value(n) AS settlements, true AS same_area, true AS whole FROM marked GROUP BY territory, run""")
def territory_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each polygon has the area of its members' cells together, and whether its rims and holes make up all of it."""
    found, sums = _areas(spark, sf_dir, FIRST, LAST)
    rings = F.flatten("parts")
    parts = F.aggregate(rings, F.lit(0.0), lambda s, r: s + area.signed_area(r))
    rims = F.forall("parts", lambda p: (area.signed_area(p[0]) > 0) & F.forall(F.slice(p, 2, F.size(p)), lambda h: area.signed_area(h) < 0))
    found = found.join(sums, ["territory", "from_year"])
    near = lambda a, b: F.abs(a - b) <= 1e-6 * b
    return found.select(F.col("territory").alias("id"), "from_year", "to_year", F.col("n_members").alias("settlements"), near(F.col("area"), F.col("km2") * 1e6).alias("same_area"), (near(parts, F.col("area")) & rims).alias("whole"))


_POINT = {"lat": "48 + (o_orderkey * 7919 % 20011) / 10000.0e0", "lon": "5.5e0 + (o_orderkey * 6007 % 29009) / 10000.0e0"}


@query(f"""{VIEWS}, {MEMBERS}, sites AS (SELECT id, {laea_sql("lat", "lon")} AS at FROM places WHERE lat IS NOT NULL),
points AS (SELECT o_orderkey, {laea_sql(_POINT["lat"], _POINT["lon"])} AS at FROM orders),
near AS (SELECT o_orderkey, s.id, sqrt(pow(p.at.x - s.at.x, 2) + pow(p.at.y - s.at.y, 2)) AS d FROM points p JOIN sites s ON abs(p.at.x - s.at.x) <= {RADIUS_M} AND abs(p.at.y - s.at.y) <= {RADIUS_M}),
nearest AS (SELECT o_orderkey, arg_min(id, d) AS id, min(d) AS d FROM near GROUP BY o_orderkey),
now AS (SELECT territory, settlement FROM members WHERE year = {YEAR}), counts AS (SELECT territory, count(*) AS settlements FROM now GROUP BY territory)
SELECT o_orderkey AS point, arg_min(territory, (settlements, territory)) AS territory, min(settlements) AS settlements FROM nearest JOIN now ON settlement = id JOIN counts USING (territory) WHERE d <= {RADIUS_M - RIM_M} GROUP BY o_orderkey""")
def smallest_territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest territory at a point of each order. Points within the rim's coarseness are left out, as the twin knows circles only."""
    cells, members, cell_of, versions = _cells(spark, sf_dir, YEAR, YEAR)
    edges = area.boundary(area.territory_rings(cells, members, cell_of, versions)).withColumn("territory", F.col("territory.territory"))
    x, y = laea(F.col("lat"), F.col("lon"))
    orders = area.spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("point")), "point")
    points = area.stored(orders.select("point", *[F.expr(e.replace("o_orderkey", "point")).alias(c) for c, e in _POINT.items()]).select("point", x.alias("x"), y.alias("y")), "points")
    sites = from_tables(spark, sf_dir).places.where("lat is not null").select(F.col("id").alias("site"), x.alias("x"), y.alias("y"))
    inner = geo.nearest_in_plane(points, sites, RADIUS_M).where(F.col("metres") <= RADIUS_M - RIM_M)
    # Squares of two of the rim's edges, so that a point meets few edges however many cells there are.
    return area.smallest_at(inner.join(points, "point").select("point", "x", "y"), edges, versions.select("territory", F.col("n_members").alias("settlements")), RADIUS_M / 8)


query()(territory_features)
