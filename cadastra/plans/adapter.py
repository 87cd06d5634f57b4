"""The dataset as frames, and the test tables mapped to it by integer arithmetic on their keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.shared import parts

#: The years in which the test tables' facts lie.
FIRST, LAST = 1995, 2001


@dataclass
class Dataset:
    """places: id, kind, place_type, name, lat, lon. entities: id, entity_type, rank. memberships: child_id,
    parent_id, pos, from_year, to_year, is_disputed. rights: seq, place_id, right_type, holder_id, share, status,
    is_disputed, disputed_with, from_year, to_year. events: seq, year, place_id, right_type, from_holder, to_holder,
    event_type."""

    places: DataFrame
    entities: DataFrame
    memberships: DataFrame
    rights: DataFrame
    events: DataFrame
    first: int = FIRST
    last: int = LAST


RIGHTS = """
SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 10 < 7 THEN concat('c', cast(o_custkey AS {string})) WHEN o_orderkey % 10 < 9 THEN concat('n', cast(o_custkey % 25 AS {string})) ELSE concat('r', cast(o_custkey % 5 AS {string})) END AS place_id,
  o_orderpriority AS right_type, concat('h', cast(o_orderkey % 97 AS {string})) AS holder_id,
  CASE WHEN o_orderkey % 3 = 1 THEN concat('1/', cast(1 + o_orderkey % 4 AS {string})) END AS share,
  CASE o_orderstatus WHEN 'F' THEN 'held' WHEN 'O' THEN 'pledged' ELSE 'claimed' END AS status,
  o_orderkey % 13 = 0 AS is_disputed, CASE WHEN o_orderkey % 13 = 0 THEN concat('h', cast((o_orderkey + 1) % 97 AS {string})) END AS opponent,
  CASE WHEN o_orderkey % 5 <> 0 THEN cast(year(o_orderdate) AS int) END AS from_year,
  CASE WHEN o_orderkey % 7 <> 0 THEN cast(year(o_orderdate) + o_orderkey % 4 AS int) END AS to_year
FROM orders"""
PLACES = """
SELECT concat('c', cast(c_custkey AS {string})) AS id, 'settlement' AS kind, lower(c_mktsegment) AS place_type, c_name AS name,
  48 + (c_custkey * 37 % 2000) / 1000.0e0 AS lat, 5.5e0 + (c_custkey * 53 % 2900) / 1000.0e0 AS lon FROM customer
UNION ALL SELECT concat('n', cast(n_nationkey AS {string})), 'territory', CASE WHEN n_nationkey % 3 = 0 THEN 'lordship' ELSE 'office' END, n_name, NULL, NULL FROM nation
UNION ALL SELECT concat('r', cast(r_regionkey AS {string})), 'territory', CASE WHEN r_regionkey % 2 = 0 THEN 'county' ELSE 'provostship' END, r_name, NULL, NULL FROM region"""
MEMBERSHIPS = """
SELECT concat('c', cast(c_custkey AS {string})) AS child_id, concat('n', cast(c_nationkey AS {string})) AS parent_id, 1 AS pos, CASE WHEN c_custkey % 11 = 0 THEN 1999 END AS from_year, cast(NULL AS int) AS to_year, c_custkey % 17 = 0 AS is_disputed FROM customer
UNION ALL SELECT concat('n', cast(n_nationkey AS {string})), concat('r', cast(n_regionkey AS {string})), 1, NULL, NULL, false FROM nation
UNION ALL SELECT concat('n', cast(n_nationkey AS {string})), concat('n', cast((n_nationkey * 7 + 1) % 25 AS {string})), 2, NULL, NULL, false FROM nation WHERE n_nationkey % 6 = 0
UNION ALL SELECT concat('r', cast(r_regionkey AS {string})), concat('n', cast(r_regionkey * 6 AS {string})), 2, NULL, NULL, false FROM region WHERE r_regionkey < 2"""
EVENTS = """
SELECT seq, year, place_id, right_type, from_holder, holder_id AS to_holder, event_type FROM (
  SELECT seq, coalesce(from_year, to_year) AS year, place_id, right_type, holder_id,
    CASE WHEN seq % 4 <> 0 THEN lag(holder_id) OVER (PARTITION BY place_id, right_type ORDER BY coalesce(from_year, to_year), seq) END AS from_holder,
    CASE seq % 3 WHEN 0 THEN 'purchase' WHEN 1 THEN 'pledge' ELSE 'inheritance' END AS event_type
  FROM ({rights}) WHERE coalesce(from_year, to_year) IS NOT NULL) WHERE seq % 2 = 0"""


def sql_views(string: str = "varchar") -> str:
    """The dataset's tables as common table expressions for the SQL twins."""
    rights = RIGHTS.format(string=string)
    return f"rights AS ({rights}), places AS ({PLACES.format(string=string)}), memberships AS ({MEMBERSHIPS.format(string=string)}), transfers AS ({EVENTS.format(rights=rights)})"


def entities_of(rights: DataFrame) -> DataFrame:
    """Every holder, ranked by its number of rights, then by id."""
    from cadastra.operators.aggregates import prominence

    return prominence(rights).withColumn("entity_type", F.when(F.substring("id", 2, 3).cast("int") % 10 == 0, "duchy").otherwise("county"))


def from_tables(spark: SparkSession, sf_dir: str) -> Dataset:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rights = spark.sql(RIGHTS.format(string="string").replace("FROM orders", "FROM {orders}"), orders=table("orders"))
    rights = rights.withColumn("disputed_with", F.array_compact(F.array("opponent")))
    names = {n: table(n) for n in ("customer", "nation", "region")}
    swap = lambda sql: sql.format(string="string").replace("FROM customer", "FROM {customer}").replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}")
    # In as many parts as the rows need, since the events before one another are sought in order; rows are counted from the file's footer.
    apart = rights.drop("disputed_with", "opponent").repartition(parts(table("orders")), "place_id", "right_type")
    events = spark.sql(EVENTS.format(rights="SELECT * FROM {rights}"), rights=apart)
    return Dataset(spark.sql(swap(PLACES), **names), entities_of(rights), spark.sql(swap(MEMBERSHIPS), **names), rights, events)
