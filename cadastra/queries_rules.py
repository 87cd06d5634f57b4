"""Queries of validation and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import temporal
from cadastra.operators import aggregates as agg
from cadastra.operators import curate, validate
from cadastra.plans.adapter import FIRST, LAST, from_tables, sql_views
from cadastra.registry import query

VIEWS = "WITH RECURSIVE " + sql_views()
LO, HI = FIRST - 1, LAST + 1
OVERLAP = lambda a, b: f"(least(coalesce({a}.to_year, {HI}), coalesce({b}.to_year, {HI})) - greatest(coalesce({a}.from_year, {LO}), coalesce({b}.from_year, {LO})) + 1)"
PAIRS = f"""pairs AS (SELECT a.place_id, a.right_type, a.seq AS aseq, b.seq AS bseq, a.holder_id AS ah, b.holder_id AS bh, a.share AS ash, b.share AS bsh, a.status AS ast, b.status AS bst, a.is_disputed OR b.is_disputed AS disputed,
  {OVERLAP('a', 'b')} AS n, coalesce(a.to_year = b.from_year, false) OR coalesce(b.to_year = a.from_year, false) AS meets
  FROM rights a JOIN rights b ON a.place_id = b.place_id AND a.right_type = b.right_type AND a.seq < b.seq),
found AS (SELECT * FROM pairs WHERE n > 0 AND NOT (n = 1 AND meets))"""
ISSUE = "level, table_name, row, message"


@query(f"""{VIEWS}, {PAIRS} SELECT 'warning' AS level, 'rights' AS table_name, bseq::varchar AS row, 'duplicates line ' || aseq || ': same holder of ' || right_type || ' at ' || place_id || ' in overlapping years' AS message FROM found WHERE ah = bh AND ash IS NULL AND bsh IS NULL AND ast = bst
UNION ALL SELECT CASE WHEN right_type = '5-LOW' THEN 'info' ELSE 'warning' END, 'rights', bseq::varchar, right_type || ' at ' || place_id || ' overlaps line ' || aseq || ' (' || ah || ' vs ' || bh || ')' FROM found
WHERE ah <> bh AND NOT (ash IS NOT NULL AND bsh IS NOT NULL) AND NOT (ast IN ('claimed', 'contested') OR bst IN ('claimed', 'contested') OR disputed)""")
def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.overlapping(from_tables(spark, sf_dir).rights, FIRST, LAST, ("5-LOW",))


@query(f"""{VIEWS}, bounds AS (SELECT DISTINCT place_id, right_type, unnest([from_year, to_year, {FIRST}, {LAST}]) AS year FROM rights),
held AS (SELECT r.*, b.year, max(coalesce(from_year = b.year, false)) OVER (PARTITION BY r.place_id, r.right_type, b.year) AS starts FROM rights r JOIN bounds b ON r.place_id = b.place_id AND r.right_type = b.right_type
  WHERE status IN ('held', 'pledged') AND coalesce(from_year, 0) <= b.year AND b.year <= coalesce(to_year, 9999)),
sums AS (SELECT place_id, right_type, year, sum(12 // split_part(share, '/', 2)::int * split_part(share, '/', 1)::int)::bigint AS n FROM held WHERE share IS NOT NULL AND NOT (starts AND coalesce(to_year = year, false) AND NOT coalesce(from_year = year, false)) GROUP BY ALL)
SELECT place_id, right_type, year, (n // gcd(n, 12)) || '/' || (12 // gcd(n, 12)) AS total FROM sums WHERE n > 12""")
def share_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.share_sums(from_tables(spark, sf_dir).rights, FIRST, LAST)


@query(f"""{VIEWS}, wanted AS (SELECT seq, year, place_id, right_type, to_holder AS holder, CASE WHEN from_holder IS NULL THEN 'holds' ELSE 'starts' END AS what FROM transfers WHERE to_holder IS NOT NULL
  UNION ALL SELECT seq, year, place_id, right_type, from_holder, 'ends' FROM transfers WHERE from_holder IS NOT NULL),
judged AS (SELECT w.*, count(r.seq) > 0 AS there, coalesce(bool_or(CASE what WHEN 'holds' THEN coalesce(r.from_year, 0) <= w.year AND w.year <= coalesce(r.to_year, 9999) WHEN 'starts' THEN coalesce(abs(r.from_year - w.year) <= 1, false) ELSE coalesce(abs(r.to_year - w.year) <= 1, false) END) FILTER (r.seq IS NOT NULL), false) AS ok
  FROM wanted w LEFT JOIN rights r ON r.place_id = w.place_id AND r.right_type = w.right_type AND r.holder_id = w.holder GROUP BY ALL)
SELECT CASE WHEN there THEN 'warning' ELSE 'info' END AS level, 'events' AS table_name, seq::varchar AS row, what || ': ' || holder || ' ' || right_type || ' at ' || place_id || ' in ' || year AS message FROM judged WHERE NOT ok""")
def event_rights_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return validate.event_mismatches(ds.events, ds.rights)


@query(f"""{VIEWS} SELECT 'error' AS level, 'rights' AS table_name, seq::varchar AS row, 'place_id ''' || place_id || ''' is not in places' AS message FROM rights WHERE place_id NOT IN (SELECT id FROM places WHERE place_type <> 'building')
UNION ALL SELECT 'error', 'events', seq::varchar, 'place_id ''' || place_id || ''' is not in places' FROM transfers WHERE place_id NOT IN (SELECT id FROM places WHERE place_type <> 'building')""")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    some = ds.places.filter("place_type <> 'building'")
    return validate.missing_keys(ds.rights, "rights", "seq", "place_id", some, "places").unionByName(validate.missing_keys(ds.events, "events", "seq", "place_id", some, "places"))


@query(f"""{VIEWS} SELECT 'error' AS level, 'places' AS table_name, id AS row, 'place_type ''' || place_type || ''' is not in the vocabulary' AS message FROM places WHERE place_type NOT IN ('building', 'machinery', 'office', 'county')""")
def vocab_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(k,) for k in ("building", "machinery", "office", "county")], "key string")
    return validate.outside_vocabulary(from_tables(spark, sf_dir).places, "places", "id", "place_type", words)


@query("""WITH lines AS (SELECT p_partkey AS line, p_name AS id FROM part), firsts AS (SELECT id, min(line) AS first FROM lines GROUP BY id HAVING count(*) > 1)
SELECT 'error' AS level, 'parts' AS table_name, line::varchar AS row, 'duplicate id ''' || id || ''' (first on line ' || first || ')' AS message FROM lines JOIN firsts USING (id) WHERE line > first""")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("line"), F.col("p_name").alias("id"))
    return validate.duplicate_ids(parts, "parts")


@query(f"""{VIEWS} SELECT 'warning' AS level, 'rights' AS table_name, seq::varchar AS row, 'is_disputed is set but disputed_with is empty' AS message FROM rights WHERE is_disputed AND opponent IS NULL
UNION ALL SELECT 'warning', 'rights', seq::varchar, 'disputed_with is given but is_disputed is false' FROM rights WHERE NOT is_disputed AND opponent IS NOT NULL
UNION ALL SELECT 'error', 'rights', seq::varchar, 'holder is listed in its own disputed_with' FROM rights WHERE opponent = holder_id""")
def dispute_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dispute_flags(from_tables(spark, sf_dir).rights)


@query(f"""{VIEWS} SELECT 'info' AS level, 'rights' AS table_name, seq::varchar AS row, 'period ' || coalesce(from_year::varchar, '…') || '-' || coalesce(to_year::varchar, '…') || ' lies outside 1996-1999' AS message FROM rights WHERE coalesce(from_year, -9999) > 1999 OR coalesce(to_year, 9999) < 1996""")
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.out_of_range(from_tables(spark, sf_dir).rights, "rights", "seq", 1996, 1999)


@query(f"""{VIEWS} SELECT 'warning' AS level, 'places' AS table_name, id AS row, 'type ''' || place_type || ''' does not apply to ' || kind AS message FROM places WHERE kind = 'territory' AND place_type NOT IN ('office', 'county') OR kind = 'settlement' AND place_type <> 'building'""")
def type_kind_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    applies = spark.createDataFrame([("office", "territory"), ("county", "territory"), ("building", "settlement")], "place_type string, kind string")
    return validate.type_of_other_kind(from_tables(spark, sf_dir).places, applies)


@query(f"""{VIEWS}, turned AS (SELECT parent_id AS child_id, child_id AS parent_id FROM memberships) SELECT 'error' AS level, 'memberships' AS table_name, child_id || '→' || parent_id AS row, 'a territory cannot belong to a settlement' AS message
FROM turned WHERE child_id IN (SELECT id FROM places WHERE kind = 'territory' AND place_type <> 'ban') AND parent_id IN (SELECT id FROM places WHERE kind = 'settlement')""")
def wrong_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memberships turned round, so that the rule finds something."""
    ds = from_tables(spark, sf_dir)
    turned = ds.memberships.select(F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id"))
    return validate.wrong_direction(turned, ds.places)


@query(f"""{VIEWS}, faulty AS (SELECT id, CASE WHEN id LIKE '%7' THEN NULL ELSE lat END AS lat, lon FROM places) SELECT 'error' AS level, 'places' AS table_name, id AS row, 'lat and lon go together' AS message FROM faulty WHERE (lat IS NULL) <> (lon IS NULL)""")
def half_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.half_coordinates(from_tables(spark, sf_dir).places.withColumn("lat", F.when(~F.col("id").endswith("7"), F.col("lat"))))


@query(f"""{VIEWS}, sourced AS (SELECT seq, CASE WHEN seq % 9 = 0 THEN '' WHEN seq % 9 > 1 THEN 'p' || seq END AS source_page FROM rights) SELECT 'error' AS level, 'rights' AS table_name, seq::varchar AS row, 'source_page is required for facts' AS message FROM sourced WHERE coalesce(source_page, '') = ''""")
def missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.when(F.col("seq") % 9 == 0, "").when(F.col("seq") % 9 > 1, F.concat(F.lit("p"), F.col("seq").cast("string")))
    return validate.without_source(from_tables(spark, sf_dir).rights.withColumn("source_page", page), "rights", "seq")


@query(f"""{VIEWS}, checked AS (SELECT seq, from_year, to_year, CASE WHEN seq % 4 = 0 THEN 'exact' END AS fp FROM rights) SELECT seq, NOT (from_year > to_year) IS TRUE AND NOT (fp IS NOT NULL AND from_year IS NULL) AS valid FROM checked""".replace("NOT (from_year > to_year) IS TRUE", "NOT coalesce(from_year > to_year, false)"))
def period_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    precision = F.when(F.col("seq") % 4 == 0, "exact")
    return from_tables(spark, sf_dir).rights.select("seq", temporal.valid_period(F.col("from_year"), F.col("to_year"), precision, F.lit(None)).alias("valid"))


@query(f"""{VIEWS}, kinds AS (SELECT level, table_name, regexp_replace(regexp_replace(message, '''[^'']*''', '…', 'g'), '\\b\\d{{3,4}}\\b', '…', 'g') AS pattern, row FROM (SELECT 'info' AS level, 'rights' AS table_name, seq::varchar AS row, 'period ' || coalesce(from_year::varchar, '…') || '-' || coalesce(to_year::varchar, '…') || ' lies outside 1996-1999' AS message FROM rights WHERE coalesce(from_year, -9999) > 1999 OR coalesce(to_year, 9999) < 1996))
SELECT level, table_name, pattern, count(*) AS n, array_to_string(list_sort(list(row))[1:5], '|') AS rows FROM kinds GROUP BY level, table_name, pattern""")
def issue_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.issue_patterns(validate.out_of_range(from_tables(spark, sf_dir).rights, "rights", "seq", 1996, 1999))
    return found.withColumn("rows", F.array_join("rows", "|"))


@query(f"""{VIEWS}, held AS (SELECT DISTINCT place_id FROM rights) SELECT count(*) AS places, count_if(kind = 'settlement') AS settlements, count_if(id IN (SELECT place_id FROM held)) AS with_rights, count_if(kind = 'settlement' AND lat IS NOT NULL) AS geocoded,
  (SELECT count(*) FROM rights) AS rights, (SELECT count_if(seq % 5 = 0) FROM rights) AS low_confidence FROM places""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return agg.coverage(ds.places, ds.rights, F.col("seq") % 5 == 0)


@query(f"""{VIEWS}, ends AS (SELECT r.seq, arg_min(t.year, t.seq) AS y FROM rights r JOIN transfers t ON t.place_id = r.place_id AND t.right_type = r.right_type AND t.from_holder = r.holder_id WHERE r.to_year IS NULL AND (r.from_year IS NULL OR r.from_year <= t.year) GROUP BY r.seq),
starts AS (SELECT r.seq, arg_min(t.year, t.seq) AS y FROM rights r JOIN transfers t ON t.place_id = r.place_id AND t.right_type = r.right_type AND t.to_holder = r.holder_id WHERE r.from_year IS NULL AND (r.to_year IS NULL OR t.year <= r.to_year) GROUP BY r.seq)
SELECT r.seq, coalesce(r.from_year, s.y) AS from_year, coalesce(r.to_year, e.y) AS to_year FROM rights r LEFT JOIN ends e ON e.seq = r.seq LEFT JOIN starts s ON s.seq = r.seq""")
def date_rights_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    return curate.dated_by_events(ds.rights, ds.events).select("seq", "from_year", "to_year")


FACTS = "facts AS (SELECT *, [(seq % 50)::int, (seq % 7)::int] AS pages, ['low', 'medium', 'high'][seq % 3 + 1] AS confidence, CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN 'note ' || seq END AS notes FROM rights)"


def _facts(spark, sf_dir):
    seq = F.col("seq")
    return from_tables(spark, sf_dir).rights.withColumns({
        "pages": F.array((seq % 50).cast("int"), (seq % 7).cast("int")), "confidence": F.element_at(F.array(*map(F.lit, agg.CONFIDENCE)), (seq % 3 + 1).cast("int")),
        "notes": F.when(seq % 3 == 0, "").when(seq % 3 == 1, F.concat(F.lit("note "), seq.cast("string"))),
    })


@query(f"""{VIEWS}, {FACTS} SELECT place_id, right_type, holder_id, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages, ['low', 'medium', 'high'][max(seq % 3) + 1] AS confidence, bool_or(is_disputed) AS is_disputed,
  coalesce(string_agg(DISTINCT opponent, '|' ORDER BY opponent), '') AS disputed_with, min(seq) AS seq, arg_min(notes, seq) FILTER (notes <> '') AS notes FROM facts GROUP BY place_id, right_type, holder_id""")
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.keyed_merge(_facts(spark, sf_dir), ["place_id", "right_type", "holder_id"], ["notes"])
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ",")).withColumn("disputed_with", F.array_join("disputed_with", "|"))


@query(f"""{VIEWS} SELECT seq, place_id, right_type, holder_id FROM rights WHERE seq % 10 = 0 UNION ALL SELECT seq, place_id, right_type, holder_id FROM rights WHERE seq % 10 = 1
UNION ALL SELECT seq, place_id, right_type, holder_id FROM rights r WHERE seq % 10 > 1 AND NOT EXISTS (SELECT 1 FROM rights m WHERE m.seq % 10 = 0 AND m.place_id = r.place_id AND m.right_type = r.right_type)""")
def manual_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth right as a manual one, the next as added, the others as found."""
    rows = from_tables(spark, sf_dir).rights.select("seq", "place_id", "right_type", "holder_id")
    part = F.col("seq") % 10
    return curate.with_precedence(rows.filter(part == 0), rows.filter(part == 1), rows.filter(part > 1), ["place_id", "right_type"])


@query(f"""{VIEWS} SELECT seq, CASE WHEN holder_id = 'h3' THEN 'first' WHEN status = 'claimed' AND right_type = '5-LOW' THEN 'second' WHEN share IS NULL AND holder_id = 'h5' THEN 'third' END AS drop_reason FROM rights""")
def rules_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "first", "h3", None, None, None), (2, "second", None, "claimed", "5-LOW", None), (3, "third", "h5", None, None, "None")], "rule_seq int, reason string, holder_id string, status string, right_type string, share string")
    return curate.dropped_by(from_tables(spark, sf_dir).rights, rules, ["holder_id", "status", "right_type", "share"]).select("seq", "drop_reason")


@query(f"""{VIEWS} SELECT coalesce(CASE WHEN holder_id = 'h3' THEN 'first' WHEN status = 'claimed' THEN 'second' END, 'kept') AS reason, count(*) AS n FROM rights GROUP BY 1""")
def dropped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "first", "h3", None), (2, "second", None, "claimed")], "rule_seq int, reason string, holder_id string, status string")
    found = curate.dropped_by(from_tables(spark, sf_dir).rights, rules, ["holder_id", "status"])
    return found.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{VIEWS}, one AS (SELECT seq, CASE WHEN holder_id = 'h3' THEN 'pledged' ELSE status END AS status, holder_id, share FROM rights)
SELECT seq, CASE WHEN status = 'pledged' AND share IS NULL THEN 'h0' ELSE holder_id END AS holder_id, status, CASE WHEN status = 'pledged' AND share IS NULL THEN 'joint' ELSE share END AS share FROM one""")
def rules_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [({"holder_id": "h3"}, {"status": "pledged"}), ({"status": "pledged", "share": "None"}, {"holder_id": "h0", "share": "joint"})]
    found = curate.overridden(from_tables(spark, sf_dir).rights, rules, {"status": "string", "holder_id": "string", "share": "string"})
    return found.select("seq", "holder_id", "status", "share")


@query("""SELECT p_partkey AS seq, CASE WHEN p_brand = 'Brand#11' AND p_size < 10 THEN 'by section' WHEN p_size < 20 THEN 'by kind' WHEN p_size < 40 THEN 'by name' END AS alias FROM part""".replace("p_brand = 'Brand#11'", "p_brand = (SELECT min(p_brand) FROM part)"))
def alias_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("section"), F.when(F.col("p_size") < 20, "small").otherwise("large").alias("kind"), F.col("p_size").cast("string").alias("name"))
    brand = parts.agg(F.min("p_brand").alias("scope")).select(F.concat(F.lit("section:"), "scope").alias("scope"))
    size = lambda n: spark.range(1, n).select(F.col("id").cast("string").alias("name"))
    aliases = brand.crossJoin(size(10)).select("scope", "name", F.lit("by section").alias("target"))
    aliases = aliases.unionByName(size(20).select(F.lit("kind:small").alias("scope"), "name", F.lit("by kind").alias("target"))).unionByName(size(40).select(F.lit("").alias("scope"), "name", F.lit("by name").alias("target")))
    return curate.scoped_alias(rows, aliases).select("seq", "alias")


@query(f"""{VIEWS}, counted AS (SELECT holder_id, right_type, count(*) AS n, min(seq) AS first FROM rights GROUP BY ALL) SELECT holder_id, arg_max(right_type, (n, -first)) AS right_type, max(n) AS n FROM counted GROUP BY holder_id""")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.first_seen_mode(from_tables(spark, sf_dir).rights, ["holder_id"], "right_type")


@query(f"""{VIEWS}, counted AS (SELECT place_id, right_type, count(*) AS n, min(seq) AS first FROM rights WHERE right_type < '4' GROUP BY ALL) SELECT place_id, arg_max(right_type, (n, -first)) AS right_type, max(n) AS n FROM counted GROUP BY place_id""")
def preferred_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.first_seen_mode(from_tables(spark, sf_dir).rights.filter("right_type < '4'"), ["place_id"], "right_type")


@query(f"""{VIEWS}, dated AS (SELECT child_id, parent_id, coalesce(from_year, 1996 + length(child_id)) AS from_year, 1997 + pos AS to_year FROM memberships)
SELECT child_id, parent_id, CASE WHEN EXISTS (SELECT 1 FROM transfers t WHERE t.place_id = d.child_id AND abs(t.year - d.from_year) <= 1) THEN from_year END::int AS from_year, CASE WHEN EXISTS (SELECT 1 FROM transfers t WHERE t.place_id = d.child_id AND abs(t.year - d.to_year) <= 1) THEN to_year END::int AS to_year FROM dated d""")
def membership_years_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    dated = ds.memberships.select("child_id", "parent_id", F.coalesce("from_year", 1996 + F.length("child_id")).alias("from_year"), (1997 + F.col("pos")).alias("to_year"))
    return curate.backed_years(dated, ds.events).select("child_id", "parent_id", "from_year", "to_year")


@query(f"""{VIEWS}, other AS (SELECT id, 'found ' || id AS name, 1.5 AS lat FROM places WHERE kind = 'territory') SELECT p.id, coalesce(nullif(CASE WHEN p.id LIKE '%1' THEN '' ELSE p.name END, ''), o.name) AS name, coalesce(p.lat, o.lat)::double AS lat FROM places p LEFT JOIN other o ON o.id = p.id""")
def geocoding_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = from_tables(spark, sf_dir).places
    other = places.filter("kind = 'territory'").select("id", F.concat(F.lit("found "), "id").alias("name"), F.lit(1.5).alias("lat"))
    return curate.filled(places.withColumn("name", F.when(F.col("id").endswith("1"), "").otherwise(F.col("name"))), other, "id", ["name", "lat"]).select("id", "name", "lat")


@query(f"""{VIEWS} SELECT id, CASE WHEN kind = 'territory' THEN 'new ' || id ELSE name END AS name FROM places""")
def names_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = from_tables(spark, sf_dir).places
    return curate.overlaid(places, places.filter("kind = 'territory'").select("id", F.concat(F.lit("new "), "id").alias("name")), "id", ["name"]).select("id", "name")


@query(f"""{VIEWS} SELECT seq, CASE WHEN place_id LIKE 'n%' AND right_type IN ('1-URGENT', '2-HIGH') THEN place_id || '-fief' WHEN place_id LIKE 'n%' AND right_type = '5-LOW' THEN place_id || '-office' ELSE place_id END AS place_id FROM rights""")
def split_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    realms = ds.places.filter("id LIKE 'n%'").select(F.col("id").alias("place_id"), F.concat("id", F.lit("-office")).alias("admin"), F.concat("id", F.lit("-fief")).alias("feudal"))
    return curate.split_realms(ds.rights, realms, ("1-URGENT", "2-HIGH"), ("5-LOW",)).select("seq", "place_id")


@query("""WITH one AS (SELECT p_name AS folded, count(DISTINCT p_partkey) AS n, min(p_partkey) AS entry FROM part GROUP BY p_name) SELECT p_partkey, entry FROM part JOIN one ON folded = p_name WHERE n = 1""")
def gazetteer_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    entries = parts.select(F.col("p_name").alias("folded"), F.col("p_partkey").alias("entry"))
    return curate.unique_hits(parts.select("p_partkey", F.col("p_name").alias("folded")), entries).select("p_partkey", "entry")


@query("""WITH named AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, p_size FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN slug || '-' || p_size ELSE slug END AS id_text FROM named""")
def shared_name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("canton", F.col("p_size").cast("string"))
    return curate.shared_name_ids(parts, F.lower("p_name"), "canton").select("p_partkey", "id_text")


_NEXT = "CASE WHEN c_custkey % 60 = 0 THEN c_custkey + 47 ELSE c_custkey - 1 - c_custkey % 3 END"


@query(f"""WITH RECURSIVE links AS (SELECT c_custkey AS a, {_NEXT} AS b FROM customer WHERE c_custkey % 90 <> 7),
walk AS (SELECT a, b AS now, [a] AS seen FROM links UNION ALL SELECT w.a, l.b, list_append(seen, w.now) FROM walk w JOIN links l ON l.a = w.now WHERE NOT list_contains(seen, w.now))
SELECT a AS alias, arg_max(now, len(seen)) AS canonical FROM walk GROUP BY a""")
def alias_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as aliases of others: chains that join, some of which end on cycles."""
    k = F.col("c_custkey")
    to = F.when(k % 60 == 0, k + 47).otherwise(k - 1 - k % 3)
    return curate.canonical(spark.read.parquet(f"{sf_dir}/customer.parquet").where(k % 90 != 7).select(k.alias("alias"), to.alias("target")))


_SPAN = lambda x, c: f"coalesce({x}.{c}_year, {LO if c == 'from' else HI})"
_MEET = lambda a, b: f"(least({_SPAN(a, 'to')}, {_SPAN(b, 'to')}) >= greatest({_SPAN(a, 'from')}, {_SPAN(b, 'from')}) AND NOT (least({_SPAN(a, 'to')}, {_SPAN(b, 'to')}) = greatest({_SPAN(a, 'from')}, {_SPAN(b, 'from')}) AND ({a}.to_year IS NOT DISTINCT FROM {b}.from_year OR {b}.to_year IS NOT DISTINCT FROM {a}.from_year)))"
_MEMBER = "{'seq': seq, 'from_year': from_year, 'to_year': to_year, 'pages': pages}"


@query(f"""{VIEWS}, moves AS (SELECT DISTINCT place_id, year FROM transfers WHERE event_type IN ('purchase', 'pledge', 'inheritance') AND right_type IN ('1-URGENT', '2-HIGH')),
attested AS (SELECT seq, place_id AS child_id, 'n' || seq % 3 AS parent_id, from_year, to_year, [(seq % 50)::int] AS pages FROM rights WHERE place_id LIKE 'c%'),
dated AS (SELECT a.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM moves m WHERE m.place_id = a.child_id AND abs(m.year - a.from_year) <= 1) THEN from_year END AS from_year, CASE WHEN EXISTS (SELECT 1 FROM moves m WHERE m.place_id = a.child_id AND abs(m.year - a.to_year) <= 1) THEN to_year END AS to_year) FROM attested a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY child_id, parent_id ORDER BY -((from_year IS NOT NULL)::int + (to_year IS NOT NULL)::int), seq) AS nth FROM dated),
step AS (SELECT child_id, parent_id, nth, [{_MEMBER}] AS kept FROM ranked WHERE nth = 1
  UNION ALL SELECT s.child_id, s.parent_id, r.nth, CASE WHEN len(list_filter(kept, lambda k: {_MEET('k', 'r')})) = 0 THEN list_append(kept, {_MEMBER.replace(': ', ': r.')}) ELSE
    list_transform(kept, lambda k: CASE WHEN k.seq = list_filter(kept, lambda q: {_MEET('q', 'r')})[1].seq THEN {{'seq': k.seq, 'from_year': k.from_year, 'to_year': k.to_year, 'pages': list_sort(list_distinct(list_concat(k.pages, r.pages)))}} ELSE k END) END
    FROM step s JOIN ranked r ON r.nth = s.nth + 1 AND r.child_id = s.child_id AND r.parent_id = s.parent_id),
last AS (SELECT child_id, parent_id, unnest(arg_max(kept, nth)) AS k FROM step GROUP BY child_id, parent_id),
one AS (SELECT child_id, parent_id, k.from_year AS from_year, k.to_year AS to_year, arg_max({{'seq': k.seq, 'pages': k.pages}}, k.seq) AS r FROM last GROUP BY ALL)
SELECT child_id, parent_id, from_year, to_year, r.seq AS seq, array_to_string(r.pages, ',') AS pages FROM one""")
def memberships_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights as attested memberships, several a pair, and the transfers as what moves members."""
    ds = from_tables(spark, sf_dir)
    seq = F.col("seq")
    attested = ds.rights.where("place_id like 'c%'").select("seq", F.col("place_id").alias("child_id"), F.concat(F.lit("n"), (seq % 3).cast("string")).alias("parent_id"), "from_year", "to_year", F.array((seq % 50).cast("int")).alias("pages"))
    found = curate.normalized_memberships(attested, ds.events, FIRST, LAST, ("1-URGENT", "2-HIGH"))
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))
