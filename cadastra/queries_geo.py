"""Queries of geography and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.geo import laea, laea_constants
from cadastra.operators import geometry as geo
from cadastra.plans.adapter import from_tables, sql_views
from cadastra.registry import query
from cadastra.sinks import export

VIEWS = "WITH RECURSIVE " + sql_views()
KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(a.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(a.lat)) * pow(sin((radians(a.lon) - radians(p.lon)) / 2), 2))))"
ANCHORS = "members AS (SELECT parent_id AS territory, lat, lon FROM memberships JOIN places ON id = child_id WHERE lat IS NOT NULL), anchors AS (SELECT territory AS anchor, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon FROM members GROUP BY territory)"


def _members(ds):
    return ds.memberships.join(ds.places.select(F.col("id").alias("child_id"), "lat", "lon"), "child_id").select(F.col("parent_id").alias("territory"), "lat", "lon")


def _anchors(ds):
    return geo.mean_centres(_members(ds)).withColumnRenamed("territory", "anchor")


@query(f"{VIEWS}, {ANCHORS} SELECT anchor AS territory, lat, lon FROM anchors")
def member_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.mean_centres(_members(from_tables(spark, sf_dir)))


@query(f"{VIEWS}, {ANCHORS} SELECT territory, list_sort(list(lat))[count(*) // 2 + 1] AS lat, list_sort(list(lon))[count(*) // 2 + 1] AS lon FROM members GROUP BY territory HAVING count(*) >= 3")
def upper_median_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.median_centres(_members(from_tables(spark, sf_dir)))


@query(f"{VIEWS}, {ANCHORS} SELECT p.id, a.anchor, round({KM}, 6) AS km FROM places p JOIN anchors a ON {KM} <= 25 WHERE p.lat IS NOT NULL")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return geo.within(ds.places, _anchors(ds), 25).withColumn("km", F.round("km", 6))


@query(f"{VIEWS}, {ANCHORS}, d AS (SELECT p.id, a.anchor, round({KM}, 9) AS km FROM places p JOIN anchors a ON {KM} <= 100 WHERE p.lat IS NOT NULL) SELECT id, arg_min(anchor, (km, anchor)) AS anchor, round(min(km), 6) AS km FROM d GROUP BY id")
def haversine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return geo.nearest(ds.places, _anchors(ds), 100).withColumn("km", F.round("km", 6))


@query(f"{VIEWS}, a AS (SELECT id AS owner, lat, lon FROM places WHERE id LIKE 'c%5'), d AS (SELECT p.id, a.owner, round({KM}, 9) AS km FROM places p JOIN a ON {KM} <= 6 WHERE p.lat IS NOT NULL) SELECT id, arg_min(owner, (km, owner)) AS owner FROM d GROUP BY id")
def attach_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = from_tables(spark, sf_dir).places
    return geo.attached(places, places.filter("id like 'c%5'").select(F.col("id").alias("owner"), "lat", "lon"))


@query(f"""{VIEWS}, rounded AS (SELECT id, round(round(lat, 1), 5) AS lat5, round(round(lon, 1), 5) AS lon5, length(id) % 2 = 0 AS approximate, length(name) % 3 AS c FROM places WHERE lat IS NOT NULL) SELECT lat5, lon5, arg_min(id, (approximate, c, id)) AS owner, count(*) AS n FROM rounded GROUP BY ALL""")
def colocated_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = from_tables(spark, sf_dir).places.withColumns({"lat": F.round("lat", 1), "lon": F.round("lon", 1), "approximate": F.length("id") % 2 == 0, "confidence_order": F.length("name") % 3})
    return geo.cell_owners(places)


@query(f"{VIEWS} SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM places")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.bounding_box(from_tables(spark, sf_dir).places)


_E = "sqrt(0.00669438002290::double)"
_Q = lambda s: f"((1 - 0.00669438002290::double) * ({s} / (1 - 0.00669438002290::double * {s} * {s}) - ln((1 - {_E} * {s}) / (1 + {_E} * {s})) / (2 * {_E})))"


def laea_sql(lat: str, lon: str) -> str:
    """The projection of a latitude and a longitude in DuckDB's SQL: a structure of x and y."""
    radius, beta0, pole = (f"{v!r}::double" for v in map(float, laea_constants()))
    beta, turn = f"asin({_Q(f'sin(radians({lat}))')} / {pole})", f"(radians({lon}) - radians(10.0::double))"
    scale = f"(6378137.0::double * cos(radians(52.0::double)) / sqrt(1 - 0.00669438002290::double * sin(radians(52.0::double)) ^ 2) / ({radius} * cos({beta0})))"
    b = f"({radius} * sqrt(2 / (1 + sin({beta0}) * sin({beta}) + cos({beta0}) * cos({beta}) * cos({turn}))))"
    return f"{{'x': 4321000 + {b} * {scale} * cos({beta}) * sin({turn}), 'y': 3210000 + {b} / {scale} * (cos({beta0}) * sin({beta}) - sin({beta0}) * cos({beta}) * cos({turn}))}}"


@query(f"""{VIEWS}, k AS (SELECT {_Q("1.0::double")} AS qp, {_Q("sin(radians(52.0::double))")} AS q0), c AS (SELECT qp, asin(q0 / qp) AS beta0, 6378137.0::double * sqrt(qp / 2) AS r FROM k),
d AS (SELECT *, 6378137.0::double * cos(radians(52.0::double)) / sqrt(1 - 0.00669438002290::double * sin(radians(52.0::double)) ^ 2) / (r * cos(beta0)) AS scale FROM c),
p AS (SELECT id, asin({_Q("sin(radians(lat))")} / qp) AS beta, radians(lon) - radians(10.0::double) AS turn, d.* FROM places, d WHERE lat IS NOT NULL),
b AS (SELECT *, r * sqrt(2 / (1 + sin(beta0) * sin(beta) + cos(beta0) * cos(beta) * cos(turn))) AS b FROM p)
SELECT id, round(4321000 + b * scale * cos(beta) * sin(turn), 2) AS x, round(3210000 + b / scale * (cos(beta0) * sin(beta) - sin(beta0) * cos(beta) * cos(turn)), 2) AS y FROM b""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = laea(F.col("lat"), F.col("lon"))
    return from_tables(spark, sf_dir).places.filter("lat is not null").select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query()
def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geo.cells(from_tables(spark, sf_dir).places.dropDuplicates(["lat", "lon"]))
    return found.select("id", F.size("ring").alias("corners"), F.round("area_km2", 4).alias("area_km2"))


@query("""WITH squares AS (SELECT n_regionkey AS territory, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation), edges AS (
  SELECT territory, x::double AS x1, y::double AS y1, x + 1.0::double AS x2, y::double AS y2 FROM squares UNION ALL SELECT territory, x + 1.0, y, x + 1.0, y + 1.0 FROM squares UNION ALL SELECT territory, x, y + 1.0, x + 1.0, y + 1.0 FROM squares UNION ALL SELECT territory, x, y, x, y + 1.0 FROM squares)
SELECT territory, x1::double AS x1, y1::double AS y1, x2::double AS x2, y2::double AS y2 FROM edges GROUP BY ALL HAVING count(*) = 1""")
def dissolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit square a nation, on a grid; the outline of each region."""
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y + 1))
    return geo.outline(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("territory"), ring.alias("ring")))


@query(f"""{VIEWS}, cand AS (SELECT p.id AS place_id, a.anchor AS candidate, (length(a.anchor) + ascii(right(a.anchor, 1)) % 3)::int AS score, round({KM}, 9) AS km, a.lat, a.lon FROM places p JOIN anchors a ON {KM} <= 60 WHERE p.lat IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, km, candidate) AS nth FROM cand)
SELECT b.place_id, b.candidate, b.score, bool_or(p.candidate <> b.candidate AND {KM.replace('a.', 'b.')} > 3) AS ambiguous FROM best b JOIN cand p ON p.place_id = b.place_id AND p.score = b.score WHERE nth = 1 GROUP BY ALL""".replace("WITH RECURSIVE " + sql_views(), "WITH RECURSIVE " + sql_views() + ", " + ANCHORS, 1))
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    anchors = _anchors(ds)
    found = geo.within(ds.places, anchors, 60).join(anchors, "anchor")
    score = (F.length("anchor") + F.ascii(F.right("anchor", F.lit(1))) % 3).cast("int")
    return geo.best_candidates(found.select(F.col("id").alias("place_id"), F.col("anchor").alias("candidate"), score.alias("score"), F.round("km", 9).alias("km"), "lat", "lon", F.col("anchor").alias("seq")))


@query(f"""{VIEWS}, j AS (SELECT '{{' || concat_ws(',', '"seq":' || seq, '"place_id":"' || place_id || '"', '"right_type":"' || right_type || '"', '"holder_id":"' || holder_id || '"', '"share":"' || share || '"', CASE WHEN status <> 'held' THEN '"status":"' || status || '"' END,
  CASE WHEN is_disputed THEN '"is_disputed":true' END, '"from_year":' || from_year, '"to_year":' || to_year, '"disputed_with":["' || opponent || '"]') || '}}' AS json FROM rights) SELECT json, strlen(json)::int AS bytes FROM j""")
def compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = from_tables(spark, sf_dir).rights
    return export.compact(rights.drop("opponent"), {"status": "held"}).withColumn("bytes", F.octet_length("json"))


@query(f"""{VIEWS}, lines AS (SELECT sha256(seq || ',' || place_id || ',' || holder_id || ',' || coalesce(share, '')) AS h FROM rights) SELECT count(*) AS lines, sum(('0x' || substr(h, 1, 12))::bigint)::varchar AS version FROM lines""")
def content_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = from_tables(spark, sf_dir).rights
    return export.content_version(rights.select(F.concat_ws(",", F.col("seq").cast("string"), "place_id", "holder_id", F.coalesce("share", F.lit(""))).alias("line")))
