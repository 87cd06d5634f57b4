"""The registered queries of the temporal engine and their SQL twins.

Each query reads its tables through the adapter and calls the library; each twin
says the same in DuckDB's SQL over the raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import aggregates as agg
from cadastra.operators import hierarchy as tree
from cadastra.operators import snapshot as snap
from cadastra.plans.adapter import FIRST, LAST, from_tables, sql_views
from cadastra.registry import ORACLE, QUERIES, query

YEAR, PLACE, HOLDER, RIGHT, ROOT = 1998, "n3", "h7", "1-URGENT", "r1"

VIEWS = "WITH RECURSIVE " + sql_views()
YEARS = f"years AS (SELECT unnest(range({FIRST}, {LAST + 1}))::int AS year)"
ACTIVE = "act AS (SELECT y.year, r.* FROM rights r JOIN years y ON coalesce(r.from_year, -9999) <= y.year AND y.year <= coalesce(r.to_year, 9999))"
FORCE = """force AS (SELECT * EXCLUDE (comes, own_comes) FROM (SELECT *, coalesce(max(from_year = year) OVER (PARTITION BY year, place_id, right_type), false) AS comes,
  coalesce(max(from_year = year) OVER (PARTITION BY year, place_id, right_type, holder_id), false) AS own_comes FROM act)
  WHERE NOT (comes AND coalesce(to_year = year, false) AND NOT coalesce(from_year = year, false) AND NOT own_comes))"""
EDGES = "edges AS (SELECT y.year, m.child_id, m.parent_id, m.pos FROM memberships m JOIN years y ON coalesce(m.from_year, -9999) <= y.year AND y.year <= coalesce(m.to_year, 9999))"
CLOSURE = """walk AS (SELECT year, child_id AS id, parent_id AS ancestor, 1 AS depth, [pos] AS path, [child_id, parent_id] AS seen FROM edges
  UNION ALL SELECT w.year, w.id, e.parent_id, w.depth + 1, list_append(w.path, e.pos), list_append(w.seen, e.parent_id) FROM walk w JOIN edges e ON e.year = w.year AND e.child_id = w.ancestor
  WHERE NOT list_contains(w.seen, e.parent_id)),
ancestors AS (SELECT year, id, ancestor, min({'depth': depth, 'path': path}) AS k FROM walk WHERE id <> ancestor GROUP BY ALL)"""
ONE_RIGHT = ACTIVE.replace("rights r", f"(SELECT * FROM rights WHERE right_type = '{RIGHT}') r")
ONE_YEAR = f"years AS (SELECT {YEAR} AS year)"
SHARE = "coalesce(try_cast(split_part(share, '/', 1) AS double) / nullif(try_cast(split_part(share, '/', 2) AS double), 0), 0)"
RANKS = "ranks AS (SELECT holder_id AS id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, holder_id) AS rank FROM rights GROUP BY holder_id)"
RESOLVED = f"""near AS (SELECT a.year, a.id AS place_id, h.right_type, a.ancestor, row_number() OVER (PARTITION BY a.year, a.id, h.right_type ORDER BY a.k) AS nth
  FROM ancestors a JOIN (SELECT DISTINCT year, place_id, right_type FROM force) h ON h.year = a.year AND h.place_id = a.ancestor
  WHERE NOT EXISTS (SELECT 1 FROM force f WHERE f.year = a.year AND f.place_id = a.id AND f.right_type = h.right_type)),
resolved AS (SELECT f.*, NULL::varchar AS inherited_from FROM force f WHERE place_id IN (SELECT id FROM places)
  UNION ALL SELECT f.* REPLACE (n.place_id AS place_id), n.ancestor FROM near n JOIN force f ON f.year = n.year AND f.place_id = n.ancestor AND f.right_type = n.right_type WHERE n.nth = 1)"""
SUMMARY = f"""summary AS (SELECT year, place_id, right_type, inherited_from, arg_min(s.holder_id, (-{SHARE}, coalesce(rank, 2147483647), seq)) FILTER (status IN ('held', 'pledged')) AS primary_holder,
  count(DISTINCT s.holder_id) FILTER (status IN ('held', 'pledged')) > 1 AS shared, bool_or(is_disputed OR status IN ('claimed', 'contested')) AS contested, count(*) AS n_rows
  FROM resolved s LEFT JOIN ranks ON ranks.id = s.holder_id GROUP BY year, place_id, right_type, inherited_from)"""
ROW = "seq, year, place_id, right_type, holder_id, share, status"


def _sql(*parts: str) -> str:
    return ", ".join(parts[:-1]) + " " + parts[-1]


def _row(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*ROW.split(", "), *more)


@query(_sql(VIEWS, ONE_YEAR, ACTIVE, FORCE, f"SELECT {ROW} FROM force"))
def snapshot_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(snap.snapshot(from_tables(spark, sf_dir).rights, YEAR))


@query(_sql(VIEWS, YEARS, ACTIVE, FORCE, f"SELECT {ROW} FROM force"))
def snapshot_all_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(snap.snapshot_years(from_tables(spark, sf_dir).rights, FIRST, LAST))


@query(_sql(VIEWS, YEARS, ACTIVE, "SELECT year, count(*) AS n_active, count(DISTINCT place_id) AS n_places FROM act GROUP BY year"))
def active_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = snap.active_years(from_tables(spark, sf_dir).rights, FIRST, LAST)
    return act.groupBy("year").agg(F.count("*").alias("n_active"), F.count_distinct("place_id").alias("n_places"))


@query(_sql(VIEWS, ONE_YEAR, ACTIVE, FORCE, f"SELECT {ROW} FROM force WHERE place_id = '{PLACE}'"))
def rights_at_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(snap.rights_at_place(from_tables(spark, sf_dir).rights, PLACE, YEAR))


@query(_sql(VIEWS, ONE_YEAR, ACTIVE, FORCE, f"SELECT {ROW} FROM force WHERE holder_id = '{HOLDER}'"))
def direct_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row(snap.direct_holdings(from_tables(spark, sf_dir).rights, HOLDER, YEAR))


@query(_sql(VIEWS, ONE_YEAR, ACTIVE, FORCE, f"SELECT right_type, count(*) AS n_rows, count(DISTINCT place_id) AS n_places FROM force WHERE holder_id = '{HOLDER}' GROUP BY right_type"))
def holdings_by_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.holdings_by_right(snap.direct_holdings(from_tables(spark, sf_dir).rights, HOLDER, YEAR))


def _ancestors(spark, sf_dir, first=YEAR, last=YEAR):
    return tree.ancestors(tree.edges_by_year(from_tables(spark, sf_dir).memberships, first, last))


@query(_sql(VIEWS, ONE_YEAR, EDGES, CLOSURE, "SELECT year, id, ancestor, k.depth AS depth, array_to_string(k.path, '.') AS path FROM ancestors"))
def ancestors_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ancestors(spark, sf_dir).select("year", "id", "ancestor", "depth", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@query(_sql(VIEWS, ONE_YEAR, EDGES, "SELECT year, parent_id, count(DISTINCT child_id) AS n_members, string_agg(DISTINCT child_id, '|' ORDER BY child_id) AS members FROM edges GROUP BY year, parent_id"))
def children_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.children(tree.year_edges(from_tables(spark, sf_dir).memberships, YEAR))
    return found.select("year", "parent_id", "n_members", F.array_join("members", "|").alias("members"))


@query(_sql(VIEWS, ONE_YEAR, EDGES, f"SELECT DISTINCT child_id AS id, kind FROM edges JOIN places ON id = child_id WHERE parent_id = '{PLACE}'"))
def direct_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return tree.direct_members(tree.year_edges(ds.memberships, YEAR), ds.places, PLACE)


@query(_sql(VIEWS, f"SELECT DISTINCT child_id FROM memberships WHERE parent_id = '{PLACE}' AND is_disputed AND coalesce(from_year, -9999) <= {YEAR} AND coalesce(to_year, 9999) >= {YEAR}"))
def contested_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.contested(from_tables(spark, sf_dir).memberships, PLACE, YEAR)


def _of_one_right(spark, sf_dir, first, last):
    """The dataset, its rows of one right in force in these years, and the memberships."""
    ds = from_tables(spark, sf_dir)
    rights = ds.rights.filter(F.col("right_type") == RIGHT)
    return ds, snap.snapshot_years(rights, first, last), tree.edges_by_year(ds.memberships, first, last)


@query(_sql(VIEWS, ONE_YEAR, ONE_RIGHT, FORCE, EDGES, CLOSURE, RANKS, RESOLVED, SUMMARY, "SELECT * FROM summary"))
def resolve_right_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds, force, edges = _of_one_right(spark, sf_dir, YEAR, YEAR)
    return snap.summarised_by_edges(force, edges, ds.places, ds.entities).select(*snap.KEY, "inherited_from", "primary_holder", "shared", "contested", "n_rows")


TIMELINE = """runs AS (SELECT *, year - row_number() OVER (PARTITION BY place_id, right_type, holder_id, status, share, inherited_from, is_disputed ORDER BY year) AS island
  FROM (SELECT DISTINCT year, place_id, right_type, holder_id, status, share, inherited_from, is_disputed FROM resolved))"""


@query(_sql(VIEWS, YEARS, ONE_RIGHT, FORCE, EDGES, CLOSURE, RESOLVED, TIMELINE, "SELECT place_id, right_type, holder_id, status, share, inherited_from, is_disputed, min(year) AS from_run, max(year) AS to_run FROM runs GROUP BY place_id, right_type, holder_id, status, share, inherited_from, is_disputed, island"))
def timeline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds, force, edges = _of_one_right(spark, sf_dir, FIRST, LAST)
    return snap.timeline_by_edges(force, edges, ds.places)


@query(_sql(VIEWS, ONE_YEAR, ACTIVE, FORCE, """SELECT year, place_id, right_type, string_agg(holder_id || ':' || status, '|' ORDER BY seq) AS parties,
  coalesce(string_agg(DISTINCT opponent, '|' ORDER BY opponent), '') AS against FROM force GROUP BY year, place_id, right_type HAVING bool_or(is_disputed OR status IN ('claimed', 'contested'))"""))
def disputes_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snap.disputes(snap.snapshot(from_tables(spark, sf_dir).rights, YEAR))
    party = F.transform("parties", lambda p: F.concat(p["holder_id"], F.lit(":"), p["status"]))
    return found.select("year", "place_id", "right_type", F.array_join(party, "|").alias("parties"), F.array_join("against", "|").alias("against"))


MEMBERS = """down AS (SELECT e.year, e.parent_id AS territory, e.child_id AS id, [e.parent_id, e.child_id] AS seen, p.kind = 'settlement' AS lands FROM edges e JOIN places p ON p.id = e.child_id
  UNION ALL SELECT d.year, d.territory, e.child_id, list_append(d.seen, e.child_id), p.kind = 'settlement' FROM down d JOIN edges e ON e.year = d.year AND e.parent_id = d.id JOIN places p ON p.id = e.child_id
  WHERE NOT d.lands AND NOT list_contains(d.seen, e.child_id)),
member_sets AS (SELECT DISTINCT year, territory, id AS settlement FROM down WHERE lands)"""


@query(_sql(VIEWS, YEARS, EDGES, MEMBERS, "SELECT year, territory, count(*) AS n FROM member_sets GROUP BY year, territory"))
def territory_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    found = tree.members(tree.edges_by_year(ds.memberships, FIRST, LAST), ds.places)
    return found.groupBy("year", "territory").agg(F.count("*").alias("n"))


@query(_sql(VIEWS, YEARS, EDGES, MEMBERS, """keyed AS (SELECT territory, year, count(*) AS n_members, sha256(string_agg(settlement, '|' ORDER BY settlement)) AS members_key FROM member_sets GROUP BY territory, year)""",
  """runs AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY territory ORDER BY year) AS run FROM (SELECT *, coalesce(lag(members_key) OVER w = members_key AND lag(year) OVER w = year - 1, false) AS same FROM keyed WINDOW w AS (PARTITION BY territory ORDER BY year)))""",
  "SELECT territory, members_key, n_members, min(year) AS from_year, max(year) AS to_year FROM runs GROUP BY territory, run, members_key, n_members"))
def territory_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return tree.versions(tree.members(tree.edges_by_year(ds.memberships, FIRST, LAST), ds.places), named=True).select("territory", "members_key", "n_members", "from_year", "to_year")


_FEUDAL = "(" + ", ".join(f"'{t}'" for t in tree.FEUDAL) + ")"


def _levels(kind: str | None) -> str:
    counts = {None: "1", "admin": f"(place_type NOT IN {_FEUDAL})::int", "feudal": f"(place_type IN {_FEUDAL})::int"}[kind]
    pick = "max" if kind == "feudal" else "min"
    return _sql(VIEWS, ONE_YEAR, EDGES, f"realm AS (SELECT id, {counts} AS counts FROM places WHERE kind = 'territory')", f"""down AS (SELECT e.year, e.child_id AS id, ['{ROOT}', e.child_id] AS seen, counts AS level, counts FROM edges e JOIN realm ON realm.id = e.child_id WHERE e.parent_id = '{ROOT}'
  UNION ALL SELECT d.year, e.child_id, list_append(d.seen, e.child_id), d.level + r.counts, r.counts FROM down d JOIN edges e ON e.year = d.year AND e.parent_id = d.id JOIN realm r ON r.id = e.child_id WHERE NOT list_contains(d.seen, e.child_id))""",
      f"SELECT year, id, {pick}(level)::int AS level FROM down WHERE counts = 1 GROUP BY year, id")


def _level_query(kind):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = from_tables(spark, sf_dir)
        return tree.levels(tree.year_edges(ds.memberships, YEAR), ds.places, ROOT, kind)

    run.__name__ = f"territory_levels_{kind or 'all'}"
    return run


for _kind in (None, "admin", "feudal"):
    query(_levels(_kind))(_level_query(_kind))

REACH = """reach AS (SELECT child_id AS a, parent_id AS b, [child_id, parent_id] AS seen FROM memberships UNION ALL SELECT r.a, m.parent_id, list_append(r.seen, m.parent_id) FROM reach r JOIN memberships m ON m.child_id = r.b WHERE NOT list_contains(r.seen, m.parent_id))"""


@query(_sql(VIEWS, REACH, "SELECT DISTINCT child_id, parent_id FROM memberships m WHERE child_id = parent_id OR EXISTS (SELECT 1 FROM reach WHERE a = m.parent_id AND b = m.child_id)"))
def membership_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.cycles(from_tables(spark, sf_dir).memberships)


@query(_sql(VIEWS, RANKS, "SELECT id, n, rank::int AS rank FROM ranks"))
def holder_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.prominence(from_tables(spark, sf_dir).rights)


@query(_sql(VIEWS, RANKS, "SELECT id, n, rank::int AS rank FROM ranks ORDER BY rank LIMIT 3"))
def top_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.prominence(from_tables(spark, sf_dir).rights).orderBy("rank").limit(3)


@query(_sql(VIEWS, ONE_YEAR, ONE_RIGHT, FORCE, EDGES, CLOSURE, RANKS, RESOLVED, SUMMARY,
  """counted AS (SELECT primary_holder AS holder_id, count(*) AS n, any_value(rank) AS rank FROM summary JOIN ranks ON ranks.id = primary_holder GROUP BY 1)""",
  """banded AS (SELECT *, row_number() OVER (ORDER BY rank) <= 3 AS top FROM counted)""", """ordered AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY n DESC, rank) AS nth FROM banded)""",
  """SELECT 'top' AS band, holder_id, n FROM banded WHERE top UNION ALL SELECT 'other', holder_id, n FROM ordered WHERE NOT top AND nth <= 8 UNION ALL SELECT 'rest', NULL, coalesce(sum(n), 0)::bigint FROM ordered WHERE NOT top AND nth > 8"""))
def legend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds, force, edges = _of_one_right(spark, sf_dir, YEAR, YEAR)
    return agg.legend(snap.summarised_by_edges(force, edges, ds.places, ds.entities), ds.entities)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_CELL = "string_agg(holder_id || coalesce(' ' || share, '') || CASE WHEN status = 'held' THEN '' ELSE ' (' || status || ')' END, ' / ' ORDER BY seq)"


@query(_sql(VIEWS, ONE_YEAR, ACTIVE, FORCE, "SELECT place_id, " + ", ".join(f"coalesce({_CELL} FILTER (right_type = '{p}'), '') AS \"{p}\"" for p in PRIORITIES) + " FROM force GROUP BY place_id"))
def rights_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.matrix(snap.snapshot(from_tables(spark, sf_dir).rights, YEAR), PRIORITIES)
    return found.select("place_id", *[F.coalesce(F.col(f"`{p}`"), F.lit("")).alias(p) for p in PRIORITIES])


@query(_sql(VIEWS, YEARS, "counted AS (SELECT y.year, count(t.seq) AS n FROM years y LEFT JOIN transfers t ON t.year = y.year GROUP BY y.year)", "SELECT year, n, CASE WHEN max(n) OVER () = 0 THEN 0.0 ELSE n / max(n) OVER () END::double AS share FROM counted"))
def changes_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.yearly_histogram(from_tables(spark, sf_dir).events, spark, FIRST, LAST)


@query(_sql(VIEWS, """SELECT entity, year, sum(gain)::bigint AS gained, sum(1 - gain)::bigint AS lost FROM (SELECT to_holder AS entity, year, 1 AS gain FROM transfers WHERE to_holder IS NOT NULL UNION ALL SELECT from_holder, year, 0 FROM transfers WHERE from_holder IS NOT NULL) GROUP BY entity, year"""))
def gained_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap.gained_and_lost(from_tables(spark, sf_dir).events)


from cadastra import queries_areas, queries_book, queries_flow, queries_geo, queries_parts, queries_release, queries_resolve, queries_rules, queries_sources, queries_text  # noqa: E402, F401  # they register theirs

__all__ = ["ORACLE", "QUERIES"]
