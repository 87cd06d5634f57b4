"""Queries of resolution, geocoding and the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import naming as nm
from cadastra.functions import temporal
from cadastra.functions import text as tx
from cadastra.operators import curate, geocode, resolve, views
from cadastra.operators import hierarchy as tree
from cadastra.operators import snapshot as snap
from cadastra.plans.adapter import FIRST, LAST, from_tables, sql_views
from cadastra.registry import query
from cadastra.sinks import export

VIEWS = "WITH RECURSIVE " + sql_views()
KM = lambda a, b, c, d: f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"
FOLD = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9-]+', ' ', 'g'))"
_S = lambda c: c.cast("string")


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


_KINDS = ("office", "lordship", "mairie", "county", "village")
_NAMES = ("Office de ", "Seigneurie de ", "Mairie de ", "Terre de ", "")


def _mention(spark, sf_dir):
    """Parts as mentions: seq, name, kind, place_type, base."""
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % 5 + 1).cast("int"))
    base = F.concat(F.lit("B"), _S(F.col("p_size")))
    return _part(spark, sf_dir).select(k.alias("seq"), F.concat(pick(_NAMES), base).alias("name"), F.when(k % 5 == 4, "settlement").otherwise("territory").alias("kind"), pick(_KINDS).alias("place_type"), F.lit("L1").alias("section"), F.lit("").alias("index_name"))


MENTIONS = f"""m AS (SELECT p_partkey AS seq, {list(_NAMES)}[p_partkey % 5 + 1] || 'B' || p_size AS name, CASE WHEN p_partkey % 5 = 4 THEN 'settlement' ELSE 'territory' END AS kind, {list(_KINDS)}[p_partkey % 5 + 1] AS place_type, 'b' || p_size AS base, p_size,
  CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN 'domain' ELSE {list(_KINDS)}[p_partkey % 5 + 1] END AS grp FROM part),
counted AS (SELECT base, place_type, count(*) AS n, min(seq) AS first FROM m WHERE grp = 'domain' GROUP BY ALL), pref AS (SELECT base, arg_max(place_type, (n, -first)) AS place_type FROM counted GROUP BY base)"""


@query(f"WITH {MENTIONS} SELECT base, place_type FROM pref")
def preferred_domain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.preferred_types(_mention(spark, sf_dir))


@query(f"""WITH {MENTIONS}, claims AS (SELECT m.*, CASE WHEN p_size = 11 AND kind = 'territory' THEN 'hand-11' WHEN name = 'Office de B12' THEN 'hand-12-office' WHEN name = 'Terre de B12' THEN 'hand-12-land' END AS claim FROM m),
carried AS (SELECT *, CASE WHEN kind = 'territory' THEN last_value(claim IGNORE NULLS) OVER (PARTITION BY grp, base, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS held FROM claims),
half AS (SELECT *, kind = 'territory' AND p_size = 9 AND place_type IN ('office', 'lordship', 'county') AS split FROM carried)
SELECT m.seq, CASE WHEN m.name = 'Office de B7' THEN 'alias-7' WHEN split THEN CASE WHEN m.place_type = 'office' THEN 'office-nine' ELSE 'fief-nine' END
  WHEN kind = 'territory' THEN coalesce(held, coalesce(CASE WHEN grp = 'domain' THEN pref.place_type END, m.place_type) || '-' || m.base) WHEN p_size % 10 = 3 THEN m.base || '-c' || p_size ELSE m.base END AS place_id, kind,
  CASE WHEN m.name = 'Office de B7' THEN 'alias' WHEN split THEN 'split realm' WHEN claim IS NOT NULL THEN 'manual' WHEN kind = 'territory' THEN 'same territory' WHEN p_size % 10 IN (3, 5) THEN 'index' ELSE 'name' END AS how
FROM half m LEFT JOIN pref USING (base)""")
def resolve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by alias, split realm, hand-made place (two of one base claim it in turn), same territory, index (by label where a name is shared) and name."""
    mentions = _mention(spark, sf_dir)
    ends = lambda n: F.col("size") % 10 == n
    sizes = spark.range(1, 51).select(F.col("id").alias("size"))
    base = F.concat(F.lit("B"), _S(F.col("size")))
    label = F.concat(base, F.lit(" ()"))
    entries = sizes.filter(ends(3) | ends(5)).select(F.col("size").alias("entry"), label.alias("label"), base.alias("name"), F.concat(F.lit("C"), _S(F.col("size"))).alias("canton"), F.lit("M.").alias("dept_code"))
    # Entries that end with 3 share their name with another one, so only their label finds them.
    names = entries.select(tx.fold(F.col("name")).alias("folded"), "entry")
    names = names.unionByName(names.filter(F.col("entry") % 10 == 3).select("folded", (F.col("entry") + 1000).alias("entry")))
    size = F.regexp_extract("name", "B([0-9]+)$", 1).cast("int")
    mentions = mentions.withColumn("index_name", F.when((F.col("kind") == "settlement") & (size % 10).isin(3), F.concat("name", F.lit(" ()"))).otherwise(""))
    aliases = spark.createDataFrame([("", "office de b7", "alias-7")], "scope string, name string, target string")
    manual = spark.createDataFrame([(1, "hand-11", "territory", ["Comté de B11"]), (2, "hand-12-office", "territory", ["Office de B12"]), (3, "hand-12-land", "territory", ["Terre de B12"])], "seq int, id string, kind string, names array<string>")
    splits = spark.createDataFrame([("b9", "office-nine", "fief-nine")], "base string, admin string, feudal string")
    return resolve.resolve_places(mentions, aliases, manual, splits, names, entries)


@query(f"""WITH e AS (SELECT p_partkey AS entry, 'N' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Var' || p_partkey ELSE '' END AS variant, CASE WHEN p_partkey % 4 = 0 THEN 'See' || p_partkey % 50 ELSE '' END AS see FROM part WHERE p_partkey % 5 <> 0),
own AS (SELECT {FOLD('name')} AS folded, entry FROM e UNION SELECT {FOLD('variant')}, entry FROM e WHERE variant <> ''), every AS (SELECT * FROM own UNION SELECT {FOLD('see')}, entry FROM e WHERE see <> ''),
one AS (SELECT folded, min(entry) AS entry FROM every GROUP BY folded HAVING count(DISTINCT entry) = 1),
led AS (SELECT 'ref' || p_partkey AS folded, entry FROM part JOIN one ON one.folded = 'n' || (p_partkey + 1) WHERE p_partkey % 5 = 0)
SELECT folded, entry FROM every UNION SELECT folded, entry FROM led""")
def index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = _part(spark, sf_dir).select("p_partkey")
    entries = part.filter(k % 5 != 0).select(k.alias("entry"), F.concat(F.lit("N"), _S(k)).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("Var"), _S(k))).otherwise("").alias("variants"), F.when(k % 4 == 0, F.concat(F.lit("See"), _S(k % 50))).otherwise("").alias("see"), F.lit("1").alias("pages"))
    references = part.filter(k % 5 == 0).select(F.concat(F.lit("Ref"), _S(k)).alias("name"), F.concat(F.lit("N"), _S(k + 1)).alias("see"))
    return resolve.index_names(entries, references)


@query(f"""WITH p AS (SELECT p_partkey AS seq, 'id' || p_partkey AS id, 'territory' AS kind, ['Office de ', 'Comte de '][p_partkey % 2 + 1] || 'B' || p_size || '-' || p_partkey % 3 AS name FROM part), f AS (SELECT *, {FOLD('name')} AS folded, regexp_replace({FOLD('name')}, '^(office|comte) de ', '') AS base FROM p)
SELECT 'full' AS claim, folded AS name, arg_min(id, seq) AS id FROM f GROUP BY folded UNION ALL SELECT 'base', base, min(id) FROM f GROUP BY base HAVING count(DISTINCT id) = 1""")
def manual_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 2 == 0, "Office de ").otherwise("Comté de "), F.lit("B"), _S(F.col("p_size")), F.lit("-"), _S(k % 3))
    full, base = resolve.manual_names(_part(spark, sf_dir).select(k.alias("seq"), F.concat(F.lit("id"), _S(k)).alias("id"), F.lit("territory").alias("kind"), F.array(name, F.lit("")).alias("names")))
    return full.select(F.lit("full").alias("claim"), F.col("folded").alias("name"), "id").unionByName(base.select(F.lit("base").alias("claim"), F.col("base").alias("name"), "id"))


@query("""WITH m AS (SELECT o_orderkey AS seq, 'p' || o_custkey AS place_id, CASE WHEN o_orderkey % 7 = 0 THEN 'bourg de X' WHEN o_orderkey % 7 = 1 THEN 'Bourg de X' ELSE 'Name ' || o_orderkey % 4 END AS name FROM orders), c AS (SELECT place_id, name, count(*) AS n, min(seq) AS first FROM m WHERE name LIKE 'Name%' GROUP BY ALL)
SELECT place_id, arg_max(name, (n, -first)) AS usual FROM c GROUP BY place_id""")
def usual_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 7 == 0, "bourg de X").when(k % 7 == 1, "Bourg de X").otherwise(F.concat(F.lit("Name "), _S(k % 4)))
    return resolve.usual_names(spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("seq"), F.concat(F.lit("p"), _S(F.col("o_custkey"))).alias("place_id"), name.alias("name")))


@query("""WITH m AS (SELECT o_orderkey AS seq, 'h' || o_custkey AS id, o_orderpriority AS name_fr, o_orderstatus AS entity_type FROM orders), a AS (SELECT id, name_fr, count(*) AS n, min(seq) AS first FROM m GROUP BY ALL), b AS (SELECT id, entity_type, count(*) AS n, min(seq) AS first FROM m GROUP BY ALL)
SELECT id, x.name_fr, y.entity_type, y.entity_type = 'O' AS state FROM (SELECT id, arg_max(name_fr, (n, -first)) AS name_fr FROM a GROUP BY id) x JOIN (SELECT id, arg_max(entity_type, (n, -first)) AS entity_type FROM b GROUP BY id) y USING (id)""")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("h"), _S(F.col("o_custkey"))).alias("id"), F.col("o_orderpriority").alias("name_fr"), F.col("o_orderstatus").alias("entity_type"))
    found = resolve.entity_names(rows, ("name_fr", "entity_type"))
    return found.join(resolve.states(found, ("O",)).withColumn("state", F.lit(True)), "id", "left").withColumn("state", F.coalesce("state", F.lit(False)))


@query(f"""{VIEWS}, f AS (SELECT seq, CASE WHEN seq % 11 = 0 THEN '' ELSE place_id END AS place_id, CASE WHEN seq % 13 = 0 THEN NULL ELSE holder_id END AS holder_id FROM rights)
SELECT CASE WHEN coalesce(place_id, '') = '' THEN 'missing place' WHEN holder_id IS NULL THEN 'missing holder' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY 1""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    rows = from_tables(spark, sf_dir).rights.select("seq", F.when(seq % 11 == 0, "").otherwise(F.col("place_id")).alias("place_id"), F.when(seq % 13 != 0, F.col("holder_id")).alias("holder_id"))
    kept, gone = resolve.kept_facts(rows, {"place_id": "missing place", "holder_id": "missing holder"})
    return gone.unionByName(kept.groupBy().agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n"))


@query(f"""{VIEWS} SELECT child_id, parent_id, pos FROM memberships WHERE child_id <> parent_id AND child_id NOT IN ('r1', 'r2') AND parent_id NOT IN ('r1', 'r2')""")
def memberships_without_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = spark.createDataFrame([("r1",), ("r2",)], "id string")
    return resolve.without_states(from_tables(spark, sf_dir).memberships.select("child_id", "parent_id", "pos"), states)


REALMS = "realms AS (SELECT 'n' || n AS admin, 'f' || n AS feudal FROM (SELECT unnest([1, 4, 7]) AS n)), ms AS (SELECT child_id, parent_id, from_year, 1 AS page FROM memberships UNION ALL SELECT 'c' || c_custkey, 'f' || c_nationkey, NULL, 2 FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey IN (1, 4, 7) UNION ALL SELECT 'c' || c_custkey, 'x', NULL, 3 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'f1', 'top', NULL, 4)"


@query(f"""{VIEWS}, {REALMS}, out_ AS (SELECT * FROM ms WHERE NOT (child_id = 'f1' AND parent_id = 'top')),
added AS (SELECT child_id, admin AS parent_id FROM ms JOIN realms ON parent_id = feudal WHERE child_id LIKE 'c%' UNION SELECT child_id, feudal FROM ms JOIN realms ON parent_id = admin WHERE child_id LIKE 'c%' AND child_id NOT IN (SELECT child_id FROM ms WHERE parent_id = 'x')
  UNION SELECT 'n1', 'top' UNION SELECT feudal, admin FROM realms)
SELECT child_id, parent_id FROM out_ UNION ALL SELECT * FROM added WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.child_id = added.child_id AND ms.parent_id = added.parent_id)""")
def split_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    row = lambda child, parent, page: (child.alias("child_id"), parent.alias("parent_id"), F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year"), F.array(F.lit(page)).alias("pages"))
    child = F.concat(F.lit("c"), _S(k))
    rows = ds.memberships.select("child_id", "parent_id", "from_year", "to_year", F.array(F.lit(1)).alias("pages"))
    rows = rows.unionByName(customer.filter((k % 3 == 0) & n.isin(1, 4, 7)).select(*row(child, F.concat(F.lit("f"), _S(n)), 2))).unionByName(customer.filter(k % 10 == 0).select(*row(child, F.lit("x"), 3))).unionByName(spark.range(1).select(*row(F.lit("f1"), F.lit("top"), 4)))
    realms = spark.createDataFrame([(f"n{i}", f"f{i}") for i in (1, 4, 7)], "admin string, feudal string")
    extra = spark.createDataFrame([("x", "territory", "fief"), ("top", "territory", "bailiwick"), *[(f"f{i}", "territory", "lordship") for i in (1, 4, 7)]], "id string, kind string, place_type string")
    places = ds.places.filter("id not like 'n%' or place_type <> 'lordship'").select("id", "kind", "place_type").unionByName(extra)
    return resolve.split_memberships(rows, realms, places, tree.FEUDAL).select("child_id", "parent_id")


@query(f"""{VIEWS} SELECT DISTINCT id FROM (SELECT place_id AS id FROM rights UNION SELECT holder_id FROM rights UNION SELECT opponent FROM rights UNION SELECT child_id FROM memberships UNION SELECT parent_id FROM memberships) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM places WHERE kind = 'territory')""")
def used_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the facts name, without the hand-made places (the territories)."""
    ds = from_tables(spark, sf_dir)
    used = resolve.used_ids([(ds.rights, ["place_id", "holder_id", "disputed_with"]), (ds.memberships, ["child_id", "parent_id"])])
    return used.join(ds.places.filter("kind = 'territory'").select("id"), "id", "left_anti")


# Geocoding


def _geo(spark, sf_dir):
    """Customers as places, their segments' names as what is looked up; parts' like as candidates: every place's name fits three."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    k = F.col("k")
    lat, lon = 48 + (k * 37 % 2000) / 1000.0, 5.5 + (k * 53 % 2900) / 1000.0
    places = c.select(k.alias("place_id"), F.when(k % 4 == 0, "DE").otherwise("").alias("country"), F.when(k % 5 == 0, "castle").otherwise("village").alias("place_type"), F.when(k % 3 != 0, lat).alias("alat"), F.when(k % 3 != 0, lon).alias("alon"), F.concat(F.lit("Canton"), _S(k)).alias("canton"))
    names = c.select(k.alias("place_id"), F.concat(F.lit("name "), _S(k)).alias("folded"))
    j = F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("j")
    cand = c.filter(k % 7 != 0).select("k", "n", j)
    i = F.col("j")
    name = F.array(F.concat(F.lit("Name "), _S(k)))
    candidates = cand.select(
        F.concat(F.lit("Q"), _S(k * 10 + i)).alias("candidate"), (lat + i * 0.05 * (k % 9)).alias("lat"), (lon + i * 0.01).alias("lon"), F.when((k + i) % 4 == 0, "DE").otherwise("FR").alias("country"), F.when((k + i) % 2 == 0, name).otherwise(F.array(F.lit("Other"))).alias("labels"), name.alias("matched"),
        ((k + i) % 3 != 0).alias("settles"), ((k + i) % 5 == 0).alias("fortified"), ((k + i) % 6 == 0).alias("excluded"), (k * 10 + i).alias("seq"),
    )
    return places, names, candidates


_GEO = """pl AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'DE' ELSE '' END AS country, CASE WHEN c_custkey % 5 = 0 THEN 'castle' ELSE 'village' END AS place_type, 48 + (c_custkey * 37 % 2000) / 1000.0e0 AS lat, 5.5e0 + (c_custkey * 53 % 2900) / 1000.0e0 AS lon FROM customer),
ca AS (SELECT *, k * 10 + i AS seq, lat + i * 0.05e0 * (k % 9) AS clat, lon + i * 0.01e0 AS clon, CASE WHEN (k + i) % 4 = 0 THEN 'DE' ELSE 'FR' END AS cc, (k + i) % 3 <> 0 AS settles, (k + i) % 5 = 0 AS fort, (k + i) % 6 = 0 AS excl, (k + i) % 2 = 0 AS own FROM (SELECT *, unnest([0, 1, 2]) AS i FROM pl WHERE k % 7 <> 0)),
sc AS (SELECT *, CASE WHEN settles THEN 3.0 ELSE 0 END + CASE WHEN place_type = 'castle' AND fort THEN 3.0 ELSE 0 END + CASE WHEN own THEN 1.0 ELSE 0 END AS score, CASE WHEN k % 3 <> 0 THEN """ + KM("lat", "lon", "clat", "clon") + """ END AS km FROM ca WHERE NOT (excl AND NOT settles AND NOT fort) AND NOT (country <> '' AND cc <> country)),
rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, coalesce(km, 0), seq) AS nth FROM sc), top AS (SELECT * FROM rk WHERE nth = 1),
riv AS (SELECT r.k, string_agg('Q' || r.seq, ', ' ORDER BY r.nth) FILTER (r.pick <= 3) AS rivals FROM (SELECT r.*, row_number() OVER (PARTITION BY r.k ORDER BY r.nth) AS pick FROM rk r JOIN top t ON t.k = r.k AND t.score = r.score AND r.nth > 1 AND """ + KM("r.clat", "r.clon", "t.clat", "t.clon") + """ > 3) r GROUP BY r.k),
best AS (SELECT t.*, 'Q' || seq AS candidate, rivals, CASE WHEN km > 25 THEN 'medium' WHEN rivals IS NOT NULL AND km IS NULL THEN 'low' WHEN score >= 3 AND (km IS NOT NULL OR rivals IS NULL) THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN km > 25 THEN printf('%.0f', km) || ' km from the index''s canton' WHEN rivals IS NOT NULL AND km IS NULL THEN 'ambiguous without canton; also ' || rivals WHEN km IS NOT NULL THEN '' ELSE 'no canton anchor' END AS note FROM top t LEFT JOIN riv USING (k))"""


@query(f"WITH {_GEO} SELECT k AS place_id, candidate, confidence, note FROM best")
def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geocode.best_candidates(*_geo(spark, sf_dir)).select("place_id", "candidate", "confidence", "note")


def _entries(spark, sf_dir):
    """Of every second place an entry of its name, of some others one with a letter too many, within reach or not."""
    k = F.col("k")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    lat, lon = 48 + (k * 37 % 2000) / 1000.0, 5.5 + (k * 53 % 2900) / 1000.0
    name = F.concat(F.when(k % 2 == 0, "name ").otherwise("names number "), _S(k))
    return c.select(k.alias("geonameid"), F.concat(F.lit("Entry "), _S(k)).alias("name"), (lat + F.when(k % 8 == 0, 1.0).otherwise(0.02)).alias("lat"), lon.alias("lon"), F.when(k % 4 == 0, "DE").otherwise("FR").alias("country"), F.when(k % 6 == 0, "S.CSTL").otherwise("P.PPL").alias("feature"), F.array(name).alias("names"))


@query(f"""WITH {_GEO}, gn AS (SELECT k, k AS geonameid, lat + CASE WHEN k % 8 = 0 THEN 1.0e0 ELSE 0.02e0 END AS glat, lon AS glon, CASE WHEN k % 3 <> 0 THEN 'high' ELSE 'medium' END AS gconfidence FROM pl WHERE k % 2 = 0 AND NOT (k % 8 = 0 AND k % 3 <> 0)),
-- An entry spelled like the place: its number has one digit more or less, which is the least that reaches 0.92.
en AS (SELECT k, country, lat + CASE WHEN k % 8 = 0 THEN 1.0e0 ELSE 0.02e0 END AS glat, lon AS glon, CASE WHEN k % 4 = 0 THEN 'DE' ELSE 'FR' END AS cc, k::varchar AS digits FROM pl WHERE k % 2 = 0),
sp AS (SELECT p.k, e.k AS geonameid, e.glat, e.glon, CASE WHEN length(p.k::varchar) < length(e.digits) THEN p.k::varchar ELSE e.digits END AS short, CASE WHEN length(p.k::varchar) < length(e.digits) THEN e.digits ELSE p.k::varchar END AS long FROM pl p JOIN en e ON abs(length(p.k::varchar) - length(e.digits)) = 1 AND p.country IN ('', e.cc)
  WHERE p.k % 3 <> 0 AND p.k NOT IN (SELECT k FROM gn) AND {KM("p.lat", "p.lon", "e.glat", "e.glon")} <= 25),
fz AS (SELECT k, arg_min(geonameid, (-length(short), geonameid)) AS geonameid, arg_min(glat, (-length(short), geonameid)) AS glat, arg_min(glon, (-length(short), geonameid)) AS glon, 'low' AS gconfidence FROM sp
  WHERE length(short) >= 2 AND list_contains(list_transform(range(1, length(long) + 1), lambda i: left(long, i - 1) || substr(long, i + 1)), short) GROUP BY k),
ge AS (SELECT * FROM gn UNION ALL SELECT * FROM fz),
l AS (SELECT pl.*, b.candidate, b.clat, b.clon, b.confidence, b.note, g.geonameid, g.glat, g.glon, g.gconfidence, b.candidate IS NOT NULL AND NOT (coalesce(contains(b.note, 'km from'), false) AND g.geonameid IS NOT NULL) AS use FROM pl LEFT JOIN best b USING (k) LEFT JOIN ge g USING (k)),
m AS (SELECT *, CASE WHEN k % 50 = 1 THEN 'override' WHEN use THEN 'wikidata' WHEN geonameid IS NOT NULL THEN 'geonames' WHEN k % 3 <> 0 THEN 'approximate' ELSE 'unlocated' END AS method FROM l)
SELECT k AS place_id, method, round(CASE method WHEN 'override' THEN 49.5e0 WHEN 'wikidata' THEN round(clat, 5) WHEN 'geonames' THEN round(glat, 5) WHEN 'approximate' THEN round(lat, 5) END, 4) AS lat, CASE WHEN method = 'wikidata' THEN candidate END AS candidate, CASE WHEN method = 'geonames' THEN geonameid END AS geonameid,
  CASE method WHEN 'override' THEN 'high' WHEN 'wikidata' THEN CASE WHEN contains(note, 'km from') THEN 'low' ELSE confidence END WHEN 'geonames' THEN gconfidence ELSE 'low' END AS confidence FROM m""")
def geocode_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    places, names, candidates = _geo(spark, sf_dir)
    overrides = places.filter("place_id % 50 = 1").select("place_id", F.lit(49.5).alias("lat"), F.lit(6.0).alias("lon"), F.lit("by hand").alias("note"))
    found = geocode.locate(places, names, candidates, _entries(spark, sf_dir), overrides)
    return found.select("place_id", "method", F.round("lat", 4).alias("lat"), "candidate", "geonameid", "confidence")


_POINTS = f"""{VIEWS}, pts AS (SELECT id, lat, lon, CASE WHEN length(id) % 3 = 0 THEN 'low' ELSE 'high' END AS confidence FROM places WHERE lat IS NOT NULL), ed AS (SELECT DISTINCT child_id, parent_id FROM memberships)"""


def _located(ds):
    confidence = F.when(F.length("id") % 3 == 0, "low").otherwise("high")
    return ds.places.filter("lat is not null").select(F.col("id").alias("place_id"), F.lit("wikidata").alias("method"), "lat", "lon", F.lit("Q").alias("candidate"), F.lit(None).cast("long").alias("geonameid"), confidence.alias("confidence"), F.lit("").alias("note"))


@query(f"""{_POINTS}, asks AS (SELECT child_id AS place_id, parent_id FROM ed WHERE parent_id <> 'n2'), cen AS (SELECT a.place_id, a.parent_id, list_sort(list(p.lat))[count(*) // 2 + 1] AS lat, list_sort(list(p.lon))[count(*) // 2 + 1] AS lon FROM asks a JOIN ed e ON e.parent_id = a.parent_id AND e.child_id <> a.place_id JOIN pts p ON p.id = e.child_id AND p.confidence <> 'low' GROUP BY ALL HAVING count(*) >= 3),
own AS (SELECT place_id, avg(lat) AS xlat, avg(lon) AS xlon FROM cen GROUP BY place_id),
up AS (SELECT DISTINCT a.child_id AS place_id, b.parent_id FROM ed a JOIN ed b ON b.child_id = a.parent_id WHERE a.child_id NOT IN (SELECT place_id FROM own) AND b.parent_id <> 'n2'), cen2 AS (SELECT a.place_id, a.parent_id, list_sort(list(p.lat))[count(*) // 2 + 1] AS lat, list_sort(list(p.lon))[count(*) // 2 + 1] AS lon FROM up a JOIN ed e ON e.parent_id = a.parent_id AND e.child_id <> a.place_id JOIN pts p ON p.id = e.child_id AND p.confidence <> 'low' GROUP BY ALL HAVING count(*) >= 3)
SELECT place_id, round(xlat, 6) AS xlat, round(xlon, 6) AS xlon FROM own UNION ALL SELECT place_id, round(avg(lat), 6), round(avg(lon), 6) FROM cen2 GROUP BY place_id""")
def territory_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    found = geocode.territory_context(_located(ds), ds.memberships, spark.createDataFrame([("n2",)], "id string"))
    return found.select("place_id", F.round("xlat", 6).alias("xlat"), F.round("xlon", 6).alias("xlon"))


@query(f"""{_POINTS} SELECT id AS place_id, CASE WHEN id LIKE '%7' THEN CASE WHEN id LIKE '%17' THEN 'approximate' ELSE 'unlocated' END ELSE 'wikidata' END AS method, CASE WHEN id LIKE '%17' THEN (SELECT lat FROM pts WHERE id = 'c1') WHEN id LIKE '%7' THEN NULL ELSE lat END AS lat, CASE WHEN id LIKE '%7' THEN 'low' ELSE confidence END AS confidence,
  CASE WHEN id LIKE '%17' THEN 'placed at c1 (rules.yaml)' WHEN id LIKE '%7' THEN 'lost' ELSE '' END AS note FROM pts""")
def placement_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    located = _located(from_tables(spark, sf_dir))
    rules = located.filter("place_id like '%7'").select("place_id", F.when(F.col("place_id").endswith("17"), "c1").alias("approximate"), F.when(~F.col("place_id").endswith("17"), "lost").alias("note"))
    return geocode.placed(located, rules).select("place_id", "method", "lat", "confidence", "note")


@query(f"""{_POINTS}, named AS (SELECT id, 's' || substr(id, 2)::int % 40 AS base, lat, lon FROM pts), seat AS (SELECT base, max(id) AS seat FROM named GROUP BY base), mem AS (SELECT parent_id AS place_id, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon, count(*) AS n FROM ed JOIN pts ON id = child_id GROUP BY 1),
ter AS (SELECT id AS place_id, CASE WHEN length(id) = 2 THEN 's' || substr(id, 2) ELSE 'none' END AS base FROM places WHERE kind = 'territory')
SELECT ter.place_id, coalesce(p.lat, mem.lat) AS lat, CASE WHEN seat IS NOT NULL THEN 'seat: ' || seat WHEN n > 0 THEN 'centre of ' || n || ' member settlement(s)' ELSE 'no seat or located members' END AS note FROM ter LEFT JOIN seat USING (base) LEFT JOIN pts p ON p.id = seat LEFT JOIN mem ON mem.place_id = ter.place_id""")
def territory_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    located = _located(ds).withColumn("name", F.concat(F.lit("S"), _S(F.substring("place_id", 2, 20).cast("long") % 40)))
    territories = ds.places.filter("kind = 'territory'").select(F.col("id").alias("place_id"), F.when(F.length("id") == 2, F.concat(F.lit("Office de S"), F.substring("id", 2, 9))).otherwise("None").alias("name"))
    return geocode.label_points(territories, located, ds.memberships).select("place_id", "lat", "note")


@query("""WITH g AS (SELECT c_custkey AS place_id, ['wikidata', 'geonames', 'approximate', 'territory', 'unlocated'][c_custkey % 5 + 1] AS method, ['high', 'low', 'medium'][c_custkey % 3 + 1] AS confidence, ['', '40 km from its territory''s other members', 'geonames spelling match X (0.93)'][c_custkey % 7 % 3 + 1] AS note FROM customer),
s AS (SELECT method, confidence, count(*) AS n FROM g GROUP BY ALL)
SELECT g.place_id, method = 'approximate' OR (confidence = 'low' AND note <> '') AS excluded, CASE WHEN method <> 'territory' AND confidence <> 'high' THEN CASE method WHEN 'unlocated' THEN 0 WHEN 'approximate' THEN 1 ELSE 2 END END AS rank, s.n FROM g JOIN s USING (method, confidence)""")
def geocodes_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What doesn't add land, what is to be checked (by rank), and how many have one's method and confidence."""
    k = F.col("c_custkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    g = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("place_id"), pick(("wikidata", "geonames", "approximate", "territory", "unlocated"), k % 5).alias("method"), pick(("high", "low", "medium"), k % 3).alias("confidence"),
        pick(("", "40 km from its territory's other members", "geonames spelling match X (0.93)"), k % 7 % 3).alias("note"), F.lit(1.0).alias("lat"),
    )
    out = g.join(geocode.excluded_from_areas(g).withColumn("excluded", F.lit(True)), "place_id", "left").join(views.geocodes_to_check(g).select("place_id", "rank"), "place_id", "left")
    return out.join(geocode.geocode_stats(g).drop("located"), ["method", "confidence"]).select("place_id", F.coalesce("excluded", F.lit(False)).alias("excluded"), "rank", "n")


@query("""SELECT 'Q' || p_size AS qid, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS matcheds, count(DISTINCT p_type) AS n_classes, CASE WHEN p_size % 2 = 0 THEN 'x' END AS fr FROM part GROUP BY p_size""")
def candidate_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    none = F.lit(None).cast("string")
    rows = _part(spark, sf_dir).select(F.concat(F.lit("Q"), _S(size)).alias("qid"), F.col("p_brand").alias("matched"), F.col("p_type").alias("class"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("FR").alias("country"), F.when(size % 2 == 0, "x").alias("fr"), none.alias("de"))
    return geocode.grouped_bindings(rows).select("qid", F.array_join("matcheds", "|").alias("matcheds"), F.size("classs").alias("n_classes"), "fr")


# Names


@query("""SELECT p_partkey, ['splits', 'nested'][p_partkey % 2 + 1] AS realm, CASE p_partkey % 2 WHEN 0 THEN 'admin' ELSE 'feudal' END AS side, 'Remilly' AS plain, 'L1-C02-S' || lpad((p_size % 9 + 1)::varchar, 2, '0') AS toc, 'Siersberg|Sankt' AS variants, 'Burg X' AS building,
  '1576–1612' AS reign, CASE WHEN p_partkey % 3 = 0 THEN '1609' WHEN p_partkey % 3 = 1 THEN '1600–1609' END AS book, p_partkey % 3 = 1 AS contradicts, 'Forbach管区' AS ja, 48.5::double AS lat, '"a\\"b"@fr' AS literal, p_size BETWEEN 10 AND 18 AS year_ok, '1/2' AS share, 'd=x' AS translated FROM part""".replace("['splits', 'nested'][p_partkey % 2 + 1]", "CASE p_partkey % 2 WHEN 0 THEN 'splits' ELSE 'nested' END").replace("'\"a\\\\\"b\"@fr'", "'\"a\\\"b\"@fr'"))
def naming_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    folded = F.when(k % 2 == 0, "office de forbach").otherwise("seigneurie et mairie de forbach")
    note = F.concat(F.lit("reign 1576–1612 from standard references"), F.when(k % 3 == 0, "; the book attests 1609–1609").when(k % 3 == 1, "; the book gives 1600-1609").otherwise(""))
    dates = nm.ruler_dates(note)
    name = tx.name_variants(F.lit("bourg de Siersberg"))
    return _part(spark, sf_dir).select(
        "p_partkey", F.when(nm.splits_realm(folded, F.lit("lordship")), "splits").otherwise("nested").alias("realm"), nm.split_side(folded, F.lit("office")).alias("side"), nm.clean_ascii(F.lit("Rémilly")).alias("plain"),
        nm.toc_id(F.lit("section"), F.lit(1), F.lit(2), (size % 9 + 1).cast("int"), F.lit("x")).alias("toc"), F.concat_ws("|", F.get(F.filter(name, lambda x: x == "Siersberg"), F.lit(0)), F.substring_index(F.get(F.filter(tx.name_variants(F.lit("Saint-Avold")), lambda x: F.startswith(x, F.lit("Sankt"))), F.lit(0)), " ", 1)).alias("variants"),
        F.get(nm.building_names(F.lit("X"), F.lit("castle")), F.lit(1)).alias("building"), dates["reign"].alias("reign"), dates["book"].alias("book"), dates["contradicts"].alias("contradicts"),
        nm.territory_name_ja(F.lit(None).cast("string"), F.lit("Office de Forbach"), F.lit("管区（アムト）"), F.lit("Forbach")).alias("ja"), nm.coordinates(F.lit("Point(6.2 48.5)"))["lat"].alias("lat"), nm.literal(F.lit('a"b'), "fr").alias("literal"),
        temporal.valid_year(size * 100).isNotNull().alias("year_ok"), temporal.valid_share(F.lit("1/2")).alias("share"), F.concat_ws("=", F.lit("d"), F.try_element_at(nm.translations({"de": F.lit("x"), "en": F.lit("")}), F.lit("de"))).alias("translated"),
    )


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Seigneurie de Forbach' WHEN 1 THEN 'Prévôté d''Amance' WHEN 2 THEN 'Prévôté rurale de Sierck' ELSE 'Terre commune' END AS fr, CASE n_nationkey % 4 WHEN 0 THEN 'Herrschaft Forbach' WHEN 1 THEN 'Schultheißerei Almenz' WHEN 2 THEN 'Landschultheißerei Sirk' ELSE 'Terre commune' END AS de,
  CASE n_nationkey % 4 WHEN 0 THEN 'Lordship of Forbach' WHEN 1 THEN 'Provostship of Amance' WHEN 2 THEN 'Rural provostship of Sierck' ELSE 'Terre commune' END AS en FROM nation""")
def territory_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 4
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    label = F.create_map(F.lit("fr"), pick("seigneurie", "prévôté", "prévôté", "office"), F.lit("de"), pick("Herrschaft", "Schultheißerei (Prévôté)", "Schultheißerei", "Amt"), F.lit("en"), pick("lordship", "provostship", "provostship", "office"))
    seat = F.struct(pick("Forbach", "Amance", "Sierck", "x").alias("name_fr"), F.nullif(pick("", "Almenz", "Sirk", "x"), F.lit("")).alias("name_de"), pick("F", "A", "S", "x").alias("name_en"))
    made = nm.territory_names(pick("Forbach", "Prévôté d'Amance", "Prévôté rurale de Sierck", "Terre commune"), label, seat, F.lit(False))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", made["fr"].alias("fr"), made["de"].alias("de"), made["en"].alias("en"))


# Views


@query(f"""{VIEWS} SELECT id, name, row_number() OVER (ORDER BY name, id) AS nth FROM places WHERE kind = 'settlement'""")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = from_tables(spark, sf_dir).places.filter("kind = 'settlement'").select("id", "name")
    return views.locale_ordered(places, F.col("name"), ["id"])


@query(f"""{VIEWS}, p AS (SELECT parent_id, child_id, pos, is_disputed, kind FROM memberships JOIN places ON id = child_id) SELECT 'inside' AS section, pos::bigint AS nth, parent_id AS key, CASE WHEN is_disputed THEN 'disputed' ELSE '' END AS value FROM memberships WHERE child_id = 'n3' UNION ALL SELECT 'members', 0, kind, count(DISTINCT child_id)::varchar FROM p WHERE parent_id = 'n3' GROUP BY kind
UNION ALL SELECT 'rights', seq, right_type, holder_id || coalesce(' ' || share, '') || CASE WHEN status = 'held' THEN '' ELSE ' (' || status || ')' END FROM rights WHERE place_id = 'n3' AND seq % 3 = 0 UNION ALL SELECT 'inherited', seq, right_type, holder_id || coalesce(' ' || share, '') || CASE WHEN status = 'held' THEN '' ELSE ' (' || status || ')' END || ' from r1' FROM rights WHERE place_id = 'n3' AND seq % 3 = 1""")
def place_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    near = ds.rights.filter("seq % 3 = 1").withColumn("inherited_from", F.lit("r1"))
    members = ds.memberships.join(ds.places.select(F.col("id").alias("child_id"), "kind"), "child_id")
    return views.place_panel(ds.rights.filter("seq % 3 = 0"), near, ds.memberships, members, "n3")


@query(f"""{VIEWS}, lv AS (SELECT id, 1 + length(id) % 2 AS level, place_type FROM places WHERE kind = 'territory' AND id <> 'n5'), g AS (SELECT *, CASE place_type WHEN 'office' THEN 'districts' WHEN 'lordship' THEN 'fiefs' ELSE 'other' END AS grp, CASE WHEN place_type IN ('lordship', 'county') THEN 'feudal' ELSE 'admin' END AS hierarchy FROM lv)
SELECT 'count' AS what, hierarchy || '/' || grp || '/' || place_type AS id, count(*)::int AS n FROM g GROUP BY ALL UNION ALL SELECT 'level', id, 1 FROM lv WHERE level = 1 UNION ALL SELECT 'kind', id, 1 FROM lv WHERE place_type = 'lordship' UNION ALL SELECT 'types', 'districts: office', 1
UNION ALL SELECT 'neighbour', id, 1 FROM places WHERE id = 'n5' AND id NOT IN (SELECT child_id FROM memberships)""")
def territories_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    levels = ds.places.filter("kind = 'territory' and id <> 'n5'").select("id", (1 + F.length("id") % 2).alias("level"))
    groups = {"office": "districts", "lordship": "fiefs"}
    _, counts = views.territories_view(levels, ds.places, groups)
    out = counts.select(F.lit("count").alias("what"), F.concat_ws("/", "hierarchy", "group", "place_type").alias("id"), F.col("n").cast("int").alias("n"))
    one = lambda rows, what: rows.select(F.lit(what).alias("what"), "id", F.lit(1).alias("n"))
    out = out.unionByName(one(views.realms_shown(levels, ds.places, ds.memberships, level=1), "level")).unionByName(one(views.realms_shown(levels, ds.places, ds.memberships, kind="lordship"), "kind"))
    near = views.realms_shown(levels, ds.places, ds.memberships, level=99, neighbours=True)
    kinds = spark.createDataFrame([("types", "districts: " + ", ".join(views.types_in(groups, "districts")), 1)], out.schema)
    return out.unionByName(one(near, "neighbour")).unionByName(kinds)


@query(f"""{VIEWS}, m AS (SELECT parent_id AS territory, place_type FROM memberships JOIN places ON id = child_id WHERE kind = 'settlement') SELECT DISTINCT territory, place_type FROM m""")
def settlement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return views.settlement_types(ds.places.filter("kind = 'settlement'"), ds.memberships.select(F.col("parent_id").alias("territory"), F.col("child_id").alias("settlement")))


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_partkey AS entry FROM lineitem) SELECT row, entry, p_name AS title, CASE WHEN p_size <= 40 THEN 'division ' || p_size ELSE 'd' || p_size END AS name, 'found' AS what FROM c JOIN part ON p_partkey = entry AND p_partkey % 3 <> 0 UNION ALL SELECT row, entry, NULL, NULL, 'missing' FROM c WHERE entry NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)""")
def comparison_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_partkey").alias("entry"))
    d = F.concat(F.lit("d"), _S(F.col("p_size")))
    entries = _part(spark, sf_dir).filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("entry"), d.alias("division"), F.col("p_name").alias("title"))
    divisions = spark.range(1, 41).select(F.concat(F.lit("d"), _S(F.col("id"))).alias("division"), F.concat(F.lit("division "), _S(F.col("id"))).alias("name"))
    found, missing = views.comparison(citations, entries, divisions)
    none = F.lit(None).cast("string")
    return found.select("row", "entry", "title", "name", F.lit("found").alias("what")).unionByName(missing.select("row", "entry", none.alias("title"), none.alias("name"), F.lit("missing").alias("what")))


@query(f"""{VIEWS}, t AS (SELECT seq, year, place_id, from_holder FROM transfers) SELECT seq, CASE WHEN seq % 10 = 0 THEN 'own words' WHEN seq % 4 = 0 THEN 'english ' || seq END AS en, CASE WHEN seq % 4 = 0 THEN 'français' END AS fr FROM t""".replace("CASE WHEN seq % 10 = 0 THEN 'own words' WHEN seq % 4 = 0 THEN 'english ' || seq END AS en", "CASE WHEN seq % 4 = 0 THEN CASE WHEN seq % 10 = 0 THEN 'own words' ELSE 'english ' || seq END END AS en"))
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = from_tables(spark, sf_dir).events.select("seq", "year", "place_id", "from_holder")
    text = lambda c: F.when(F.col("seq") % 4 == 0, c)
    key = ["seq", "year", "place_id", "from_holder"]
    summaries = events.filter("seq % 4 = 0").select(*key, F.concat(F.lit("english "), _S(F.col("seq"))).alias("en"), F.lit("français").alias("fr"), F.lit("").alias("de"), F.lit(None).cast("string").alias("ja"))
    manual = events.filter("seq % 10 = 0").select(*key, F.lit("own words").alias("description"))
    found = views.event_texts(events, summaries, manual, key)
    return found.select("seq", F.try_element_at("texts", F.lit("en")).alias("en"), F.try_element_at("texts", F.lit("fr")).alias("fr"))


@query(f"""{VIEWS} SELECT child_id, string_agg(parent_id || ':' || coalesce(from_year::varchar, ''), '|' ORDER BY parent_id, from_year NULLS FIRST) AS parents FROM memberships GROUP BY child_id""")
def parents_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.parents_nested(from_tables(spark, sf_dir).memberships)
    return found.select("child_id", F.array_join(F.transform("parents", lambda p: F.concat(p["parent_id"], F.lit(":"), F.coalesce(_S(p["from_year"]), F.lit("")))), "|").alias("parents"))


@query(f"""{VIEWS}, b AS (SELECT id, 'b' || n_regionkey AS base FROM places JOIN nation ON id = 'n' || n_nationkey) SELECT base, string_agg(id, ',' ORDER BY id) AS ids FROM b GROUP BY base HAVING count(*) > 1""")
def territories_of_one_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n = F.col("n_nationkey")
    name = F.concat(F.when(n % 2 == 0, "Office de ").otherwise("Comté du "), F.lit("B"), _S(F.col("n_regionkey")))
    found = views.same_base(nation.select(F.concat(F.lit("n"), _S(n)).alias("id"), F.lit("territory").alias("kind"), name.alias("name")))
    return found.withColumn("ids", F.array_join("ids", ","))


@query(f"""{VIEWS}, n AS (SELECT holder_id AS id, count(*) AS n FROM rights GROUP BY 1), e AS (SELECT id, substr(id, 2)::int AS k FROM n WHERE substr(id, 2)::int < 20), i AS (SELECT 'house-' || id AS id, k * 2 AS seq, n FROM e JOIN n USING (id) UNION ALL SELECT 'county-' || id, k * 2 + 1, 0 FROM e)
SELECT b.id AS dropped, a.id AS kept, 1.0::double AS score FROM i a JOIN i b ON a.id = 'house-' || split_part(b.id, '-', 2) AND b.id LIKE 'county%'""")
def entity_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    n = ds.rights.groupBy(F.col("holder_id").alias("h")).agg(F.count("*").alias("n")).withColumn("k", F.substring("h", 2, 9).cast("int")).filter("k < 20")
    far = F.sha2("h", 256)  # names that aren't alike
    rows = n.select((F.col("k") * 2).alias("seq"), F.concat(F.lit("house-"), "h").alias("id"), far.alias("name")).unionByName(n.select((F.col("k") * 2 + 1).alias("seq"), F.concat(F.lit("county-"), "h").alias("id"), F.reverse(far).alias("name")))
    return views.suggestions(rows, n.select(F.concat(F.lit("house-"), "h").alias("id"), "n"))


@query(f"""{VIEWS} SELECT 1 AS section, 1 AS nth, '- rights: ' || count(*) AS line FROM rights UNION ALL SELECT 2, 1, '| error | rights | bad | 3 | 1, 2, 3 |' UNION ALL SELECT 3, 1, '| `a` | `b` | 1.0 |' UNION ALL SELECT 4, 1, '- base: `x`, `y`' UNION ALL SELECT 5, 1, '| p | unlocated | low |  | note |'
UNION ALL SELECT 6, (row_number() OVER (ORDER BY seq))::int, '| ' || seq || ' | ' || place_id || ' | ' || right_type || ' | ' || holder_id || ' | 1 |  |' FROM (SELECT * FROM rights WHERE seq % 5 = 0 ORDER BY seq LIMIT 150)""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = from_tables(spark, sf_dir).rights
    coverage = rights.agg(F.count("*").alias("rights"))
    issues = spark.createDataFrame([("error", "rights", "bad", 3, ["1", "2", "3"])], "level string, table_name string, pattern string, n int, rows array<string>")
    merges = spark.createDataFrame([("a", "b", 1.0)], "dropped string, kept string, score double")
    bases = spark.createDataFrame([("base", ["x", "y"])], "base string, ids array<string>")
    unsure = spark.createDataFrame([("p", "unlocated", "low", None, None, "note", 0)], "place_id string, method string, confidence string, lat double, lon double, note string, rank int")
    low = rights.filter("seq % 5 = 0").select(F.col("seq").alias("line"), "place_id", "right_type", "holder_id", F.lit("1").alias("source_page"), F.lit(None).cast("string").alias("notes"))
    return views.report(coverage, issues, merges, bases, unsure, low)


@query(f"""{VIEWS} SELECT '"' || place_id || '","' || seq || '"' AS line FROM rights WHERE holder_id = 'h7' AND place_id LIKE 'n%'""")
def matrix_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = from_tables(spark, sf_dir).rights.select("place_id", "seq", "holder_id")
    ancestors = rights.filter("place_id like 'n%'").select(F.col("place_id").alias("id"), F.lit("top").alias("ancestor"))
    chosen = views.matrix_rows(rights.filter("holder_id = 'h7'"), ancestors, "top", rights, "h7")
    return views.matrix_csv(chosen, ["place_id", "seq"])


@query(f"""{VIEWS} SELECT seq, from_year <= 1997 AND coalesce(to_year, 9999) >= 1996 AS inside, lo, hi FROM (SELECT seq, coalesce(from_year, -9999) AS from_year, to_year, CASE WHEN seq % 2 = 0 AND from_year IS NOT NULL AND to_year IS NOT NULL THEN from_year ELSE from_year END AS lo, to_year AS hi FROM rights)""")
def rulers_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights as rulers; half of them with their years swapped, which are put in order first."""
    rows = from_tables(spark, sf_dir).rights.select("seq", "from_year", "to_year")
    swap = (F.col("seq") % 2 == 0) & F.col("from_year").isNotNull() & F.col("to_year").isNotNull()
    mixed = rows.select("seq", F.when(swap, F.col("to_year")).otherwise(F.col("from_year")).alias("a"), F.when(swap, F.col("from_year")).otherwise(F.col("to_year")).alias("b"))
    low, high = temporal.ordered(F.col("a"), F.col("b"))
    rows = mixed.select("seq", low.alias("from_year"), high.alias("to_year"))
    found = views.rulers_in_span(rows, 1996, 1997).select("seq", F.lit(True).alias("inside"))
    return rows.join(found, "seq", "left").select("seq", F.coalesce("inside", F.lit(False)).alias("inside"), F.col("from_year").alias("lo"), F.col("to_year").alias("hi"))


@query("""WITH s AS (SELECT 'c' || c_custkey AS id, 'S' || c_custkey AS name_fr, CASE WHEN c_custkey % 2 = 0 THEN '名' || c_custkey || ' (x)' END AS label FROM customer WHERE c_custkey <= 100), t AS (SELECT 'n' || n_nationkey AS id, n_nationkey AS n FROM nation)
SELECT id, '名' || substr(id, 2) AS name_ja, 'wikidata' AS source FROM s WHERE label IS NOT NULL AND id <> 'c4' UNION ALL SELECT 'c4', '手', 'manual' UNION ALL SELECT id, CASE WHEN n % 2 = 0 THEN CASE WHEN n = 4 THEN '手' ELSE '名' || n END || '管区' ELSE 'S' || n || ' 管区' END, CASE WHEN n % 2 = 0 THEN 'seat + type' ELSE 'french + type' END FROM t""")
def ja_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    settled = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey <= 100").select(F.concat(F.lit("c"), _S(k)).alias("id"), F.lit("settlement").alias("kind"), F.concat(F.lit("S"), _S(k)).alias("name_fr"), F.lit("village").alias("place_type"))
    realms = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), _S(n)).alias("id"), F.lit("territory").alias("kind"), F.concat(F.lit("Office de S"), _S(n)).alias("name_fr"), F.lit("office").alias("place_type"))
    number = F.substring("id", 2, 9)
    labels = settled.filter(number.cast("int") % 2 == 0).select("id", F.concat(F.lit("名"), number, F.lit(" (x)")).alias("label"))
    manual = spark.createDataFrame([("c4", "手")], "id string, name_ja string")
    words = spark.createDataFrame([("office", "管区（アムト）")], "place_type string, ja string")
    return views.ja_names(settled.unionByName(realms), labels, spark.createDataFrame([("n2", "c2")], "id string, seat string"), manual, words)


@query(f"""{VIEWS}, ch AS (SELECT year, sum(g) AS gained, sum(1 - g) AS lost FROM (SELECT year, 1 AS g FROM transfers WHERE to_holder = 'h7' UNION ALL SELECT year, 0 FROM transfers WHERE from_holder = 'h7') WHERE year BETWEEN 1996 AND 1998 GROUP BY year)
SELECT 'rights' AS section, right_type AS key, count(DISTINCT place_id)::bigint AS n FROM rights WHERE holder_id = 'h7' GROUP BY right_type UNION ALL SELECT 'gained', year::varchar, gained::bigint FROM ch WHERE gained > 0 UNION ALL SELECT 'lost', year::varchar, lost::bigint FROM ch WHERE lost > 0
UNION ALL SELECT 'rulers', 'person ' || seq % 5, count(*) FROM rights WHERE holder_id = 'h7' AND coalesce(from_year, -9999) <= 1998 AND coalesce(to_year, 9999) >= 1996 GROUP BY 2""")
def holder_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    rulers = ds.rights.select(F.col("holder_id").alias("entity_id"), F.concat(F.lit("person "), _S(F.col("seq") % 5)).alias("person_name"), "from_year", "to_year")
    return views.holder_view(ds.rights, snap.gained_and_lost(ds.events), rulers, "h7", 1996, 1998)


# Curation


_MERGE_KEY = "place_id, right_type, holder_id, share, status"
_ROW = "{'seq': seq, 'from_year': from_year, 'to_year': to_year, 'pages': pages, 'confidence': c, 'is_disputed': is_disputed, 'disputed_with': against, 'notes': notes}"
_OVERLAPS = lambda a, b: f"(least(coalesce({a}.to_year, {LAST + 1}), coalesce({b}.to_year, {LAST + 1})) >= greatest(coalesce({a}.from_year, {FIRST - 1}), coalesce({b}.from_year, {FIRST - 1})) AND NOT (least(coalesce({a}.to_year, {LAST + 1}), coalesce({b}.to_year, {LAST + 1})) = greatest(coalesce({a}.from_year, {FIRST - 1}), coalesce({b}.from_year, {FIRST - 1})) AND ({a}.to_year IS NOT DISTINCT FROM {b}.from_year OR {b}.to_year IS NOT DISTINCT FROM {a}.from_year)))"


@query(f"""{VIEWS}, facts AS (SELECT {_MERGE_KEY.replace('place_id', "'p' || seq % 40 AS place_id").replace('holder_id', "'h' || seq % 3 AS holder_id")}, seq, from_year, to_year, [(seq % 50)::int] AS pages, seq % 3 AS c, is_disputed, CASE WHEN opponent IS NULL THEN [] ELSE [opponent] END AS against, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN 'note ' || seq END AS notes FROM rights),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_MERGE_KEY} ORDER BY -((from_year IS NOT NULL)::int + (to_year IS NOT NULL)::int), coalesce(from_year, 0), seq) AS nth FROM facts),
step AS (SELECT {_MERGE_KEY}, nth, [{_ROW}] AS kept FROM ranked WHERE nth = 1
  UNION ALL SELECT s.place_id, s.right_type, s.holder_id, s.share, s.status, r.nth, CASE WHEN len(list_filter(kept, lambda k: {_OVERLAPS('k', 'r')})) = 0 THEN list_append(kept, {_ROW.replace(': ', ': r.')}) ELSE
    list_transform(kept, lambda k: CASE WHEN k.seq = list_filter(kept, lambda q: {_OVERLAPS('q', 'r')})[1].seq THEN {{'seq': k.seq, 'from_year': k.from_year, 'to_year': k.to_year, 'pages': list_sort(list_distinct(list_concat(k.pages, r.pages))), 'confidence': greatest(k.confidence, r.c), 'is_disputed': k.is_disputed OR r.is_disputed,
      'disputed_with': list_sort(list_distinct(list_concat(k.disputed_with, r.against))), 'notes': coalesce(nullif(k.notes, ''), r.notes, k.notes)}} ELSE k END) END
    FROM step s JOIN ranked r ON r.nth = s.nth + 1 AND r.place_id = s.place_id AND r.right_type = s.right_type AND r.holder_id = s.holder_id AND r.share IS NOT DISTINCT FROM s.share AND r.status = s.status),
last AS (SELECT {_MERGE_KEY}, unnest(arg_max(kept, nth)) AS k FROM step GROUP BY {_MERGE_KEY})
SELECT {_MERGE_KEY}, k.seq AS seq, k.from_year AS from_year, k.to_year AS to_year, array_to_string(k.pages, ',') AS pages, ['low', 'medium', 'high'][k.confidence + 1] AS confidence, k.is_disputed AS is_disputed, array_to_string(k.disputed_with, '|') AS disputed_with, k.notes AS notes FROM last""")
def merge_same_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights folded to 40 places and 3 holders, so that keys have many rows."""
    seq = F.col("seq")
    rows = from_tables(spark, sf_dir).rights.withColumns({
        "place_id": F.concat(F.lit("p"), _S(seq % 40)), "holder_id": F.concat(F.lit("h"), _S(seq % 3)), "pages": F.array((seq % 50).cast("int")), "confidence": F.element_at(F.array(*map(F.lit, curate.CONFIDENCE)), (seq % 3 + 1).cast("int")),
        "notes": F.when(seq % 3 == 0, "").when(seq % 3 == 1, F.concat(F.lit("note "), _S(seq))),
    })
    found = curate.merge_overlapping(rows, _MERGE_KEY.split(", "), FIRST, LAST, ("notes",))
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ",")).withColumn("disputed_with", F.array_join("disputed_with", "|"))


@query(f"""{VIEWS}, q AS (SELECT seq, place_id, CASE WHEN seq % 4 = 0 THEN 'about ' || seq END AS description FROM rights WHERE seq % 2 = 0) SELECT seq, CASE WHEN seq % 8 = 0 THEN 'in short' END AS description, 'public' AS what FROM q UNION ALL SELECT seq, description, 'text' FROM q WHERE description IS NOT NULL""")
def book_text_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    events = from_tables(spark, sf_dir).rights.filter(seq % 2 == 0).select("seq", "place_id", F.when(seq % 4 == 0, F.concat(F.lit("about "), _S(seq))).alias("description"))
    summaries = events.filter(seq % 8 == 0).select("seq", "place_id", F.lit("in short").alias("summary"))
    public, texts = export.quarantine(events, summaries, ["seq", "place_id"])
    return public.select("seq", "description", F.lit("public").alias("what")).unionByName(texts.select("seq", "description", F.lit("text").alias("what")))
