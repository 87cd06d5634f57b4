"""Queries of releases, and of what goes into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import book, curate, records, validate
from cadastra.operators.shared import new_path, spread, stored
from cadastra.plans.adapter import from_tables, sql_views
from cadastra.registry import query
from cadastra.sinks import export, release

VIEWS = "WITH RECURSIVE " + sql_views()


@query(f"""{VIEWS} SELECT 'places' AS name, count(*) AS n, sum(strlen(id) + strlen(coalesce(place_type, '')))::bigint AS size, 'kept' AS refused FROM places UNION ALL SELECT 'rights', count(*), sum(strlen(place_id) + strlen(holder_id))::bigint, 'kept' FROM rights UNION ALL SELECT 'memberships', count(*), sum(strlen(child_id) + strlen(parent_id))::bigint, 'kept' FROM memberships""")
def dataset_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files released and read back; then a release with errors and one over its budget, which leave the first in place."""
    ds, path = from_tables(spark, sf_dir), new_path(spark, "release")
    good = validate.half_coordinates(ds.places)
    as_json = lambda df, *order: df.select(*order, F.to_json(F.struct(*df.columns)).alias("json"))
    with release.Release(spark, path, good) as out:
        out.lines("places", as_json(ds.places, "id"), ["id"], budget=1 << 40)
        out.lines("rights", export.compact(ds.rights.drop("opponent"), {"status": "held"}).withColumn("n", F.monotonically_increasing_id()), ["n"])
        out.table("memberships", ds.memberships, ["child_id", "parent_id", "from_year", "is_disputed"], ["child_id", "parent_id"])
    first = release.released(spark, path)
    refused = []
    bad = validate.wrong_direction(ds.memberships.select(F.col("parent_id").alias("child_id"), F.col("child_id").alias("parent_id")), ds.places)
    for issues, budget in ((bad, None), (good, 10)):
        try:
            with release.Release(spark, path, issues) as out:
                out.lines("places", as_json(ds.places.limit(5), "id"), ["id"], budget=budget)
        except release.Refused:
            refused.append(release.released(spark, path) == first)
    kept = F.lit("kept" if refused == [True, True] else "lost")
    size = lambda *c: F.sum(sum((F.octet_length(F.coalesce(x, F.lit(""))) for x in c), F.lit(0))).cast("long").alias("size")
    back = lambda name, schema: spark.read.schema(schema).json(f"{first}/{name}")
    parts = [
        back("places", "id string, place_type string").agg(F.count("*").alias("n"), size("id", "place_type")).select(F.lit("places").alias("name"), "n", "size"),
        back("rights", "place_id string, holder_id string").agg(F.count("*").alias("n"), size("place_id", "holder_id")).select(F.lit("rights").alias("name"), "n", "size"),
        spark.read.csv(f"{first}/memberships", header=True, schema="child_id string, parent_id string, from_year int, is_disputed string").agg(F.count("*").alias("n"), size("child_id", "parent_id")).select(F.lit("memberships").alias("name"), "n", "size"),
    ]
    return validate.united(parts).withColumn("refused", kept)


_HEAD = "'# S' || doc_id || ' — 1. ' || source || chr(10) || '# Livre 2, chapitre 3: ' || lang || chr(10) || '# Printed pages 4–5' || chr(10) || chr(10)"


@query(f"""SELECT 'S' || doc_id || '_' || regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '.txt' AS file, sha256({_HEAD} || coalesce(text, '') || chr(10)) AS text_sha256 FROM documents""")
def section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections, a file each, and their digests as read back."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "sections")
    key, title = F.concat(F.lit("S"), F.col("doc_id").cast("string")), F.col("source")
    text = release.section_text(key, F.lit(1), title, F.lit(2), F.lit(3), F.col("lang"), F.lit(4), F.lit(5), F.coalesce("text", F.lit("")))
    with release.Release(spark, path) as out:
        out.texts("sections", docs.select(release.section_file(key, title, title).alias("file"), text.alias("text")))
    return release.read_texts(spark, f"{release.released(spark, path)}/sections").select("file", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH j AS (SELECT 'S' || doc_id % 40 AS section_id, length(coalesce(text, ''))::bigint AS chars, n_chars // 4 AS tokens, doc_id % 3 = 0 AS done FROM documents),
t AS (SELECT count(*) FILTER (NOT done) AS chunks, count(DISTINCT section_id) FILTER (NOT done) AS sections, count(*) FILTER (done) AS done, sum(tokens) FILTER (NOT done) AS tokens, sum(chars) FILTER (NOT done) AS chars FROM j),
r AS (SELECT unnest([{{'label': 'narrative', 'rate': 5}}, {{'label': 'mixed', 'rate': 12}}, {{'label': 'list-heavy', 'rate': 25}}]) AS r)
SELECT r.label AS label, chunks, sections, done, tokens::bigint AS tokens, chars::bigint AS chars, (chars::bigint * r.rate * 2 + 1000) // 2000 / 100.0::double AS usd, (chars::bigint * r.rate + 1000) // 2000 / 100.0::double AS batch_usd FROM t, r""")
def extraction_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    jobs = docs.select(F.concat(F.lit("S"), (F.col("doc_id") % 40).cast("string")).alias("section_id"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("n_chars") / 4).alias("tokens"), (F.col("doc_id") % 3 == 0).alias("done"))
    return book.estimate(jobs, {"narrative": 0.05, "mixed": 0.12, "list-heavy": 0.25})


@query("""SELECT o_orderkey // 20 AS page, coalesce(avg((o_orderkey % 97)::double) FILTER (o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0), 0) AS confidence, count(*) FILTER (o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0) AS words FROM orders GROUP BY 1""")
def recognition_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    words = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(k / 20).alias("page"), F.when(k % 6 == 0, "  ").otherwise("word").alias("text"), F.when(k % 5 == 0, -1.0).otherwise((k % 97).cast("double")).alias("conf"))
    return book.mean_confidence(words, ["page"])


@query(f"""{VIEWS}, own AS (SELECT seq, place_id, right_type, holder_id, status, from_year, to_year, CASE WHEN seq % 5 = 0 THEN 'own ' || seq WHEN seq % 5 = 1 THEN '' END AS snippet FROM rights),
notes AS (SELECT place_id, right_type, holder_id, status, from_year, to_year, arg_max('note ' || seq, seq) AS found FROM rights WHERE seq % 4 <> 0 GROUP BY ALL)
SELECT o.seq, coalesce(nullif(o.snippet, ''), n.found) AS snippet FROM own o LEFT JOIN notes n ON n.place_id = o.place_id AND n.right_type = o.right_type AND n.holder_id = o.holder_id AND n.status = o.status AND n.from_year IS NOT DISTINCT FROM o.from_year AND n.to_year IS NOT DISTINCT FROM o.to_year""")
def snippets_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    rights = from_tables(spark, sf_dir).rights.select("seq", *curate.RIGHT_KEY)
    own = rights.withColumn("snippet", F.when(seq % 5 == 0, F.concat(F.lit("own "), seq.cast("string"))).when(seq % 5 == 1, ""))
    notes = rights.where("seq % 4 <> 0").withColumn("snippet", F.concat(F.lit("note "), seq.cast("string")))
    return curate.with_snippets(own, notes).select("seq", "snippet")


_EVENT = "OBJECT<confidence: STRING, description: STRING, event_type: STRING, from_holder: STRING, place: STRING, right_type: STRING, source_page: STRING, to_holder: STRING, year: BIGINT>"
_MEMBER = "OBJECT<child: STRING, from_year: {0}, parent: STRING, source_page: STRING, to_year: BIGINT>"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS broken, o_orderkey % 11 = 0 AS short FROM orders)
SELECT k AS chunk_id, NULL AS part, NULL::int AS pos, 'not an object' AS problems FROM o WHERE broken UNION ALL SELECT k, NULL, NULL, 'rulers: no list|sundries: not a list of a record' FROM o WHERE short AND NOT broken
UNION ALL SELECT k, 'memberships', 0, CASE WHEN k % 7 = 0 THEN 'fields: {_MEMBER.format("STRING")}' ELSE '' END FROM o WHERE NOT broken
UNION ALL SELECT k, 'events', 0, concat_ws('|', CASE WHEN k % 3 = 0 THEN 'confidence: ''sure'' is not in confidence' END, CASE WHEN k % 5 = 0 THEN 'event_type: ''sale'' is not in event_types' END, CASE WHEN k % 4 = 2 THEN 'right_type: ''toll'' is not in right_types' END) FROM o WHERE NOT broken
UNION ALL SELECT k, 'places', 0, CASE WHEN k % 2 = 0 THEN 'kind: ''realm'' is not in kinds' ELSE '' END FROM o WHERE NOT broken""")
def records_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extraction records with faults of every kind; the rows that are kept have no problems."""
    k = F.col("o_orderkey")
    text = lambda v: F.lit(v)
    member = F.struct(F.lit("a").alias("child"), F.lit("b").alias("parent"), F.lit(1600).alias("to_year"), text("3").alias("source_page"))
    number, word = member.withField("from_year", F.lit(0)), member.withField("from_year", F.lit("0"))
    event = F.struct(
        F.lit(1611).alias("year"), text("p").alias("place"), F.when(k % 4 == 2, "toll").when(k % 4 == 1, "suzerain").otherwise("").alias("right_type"), text("").alias("from_holder"), text("h").alias("to_holder"),
        F.when(k % 5 == 0, "sale").otherwise("purchase").alias("event_type"), text("d").alias("description"), text("4").alias("source_page"), F.when(k % 3 == 0, "sure").otherwise("high").alias("confidence"),
    )
    place = F.struct(text("n").alias("name_in_text"), text("").alias("index_name"), F.when(k % 2 == 0, "realm").otherwise("territory").alias("kind"), text("office").alias("place_type"), F.array().cast("array<string>").alias("other_names"))
    none = F.array().cast("array<string>")
    fields = [F.array(F.when(k % 7 == 0, F.to_json(word)).otherwise(F.to_json(number))), F.array(F.to_json(event)), F.array(F.to_json(place))]
    listed = lambda name, c: F.concat(F.lit(f'"{name}":['), F.array_join(c, ","), F.lit("]"))
    body = F.concat_ws(",", listed("memberships", fields[0]), listed("events", fields[1]), listed("places", fields[2]), listed("entities", none), listed("rights", none), F.when(k % 11 == 0, F.lit('"sundries":[]')).otherwise(listed("rulers", none)))
    # The keys are dealt into as many parts as they need before they become records; what is judged is stored once, as both halves are read.
    keys = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(k), "o_orderkey")
    raw = keys.select(k.alias("chunk_id"), F.when(k % 13 == 0, "{oops").otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("json"))
    words = [("event_types", "purchase"), ("right_types", "suzerain"), ("confidence", "high"), ("place_types", "office")]
    found = stored(records.checked(raw, spark.createDataFrame(words, "vocab string, key string")).drop("row"), "judged")
    good, bad = records.apart(found)
    return good.withColumn("problems", F.array().cast("array<string>")).unionByName(bad).select("chunk_id", "part", "pos", F.array_join("problems", "|").alias("problems"))
