"""Queries of the loaders: each writes a file of test rows into the shared folder and loads it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.shared import shared_dir
from cadastra.plans.adapter import from_tables, sql_views
from cadastra.registry import query
from cadastra.sinks import export
from cadastra.sources import tables

VIEWS = "WITH RECURSIVE " + sql_views()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through Spark's file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _rights_file(spark, sf_dir) -> str:
    rights = from_tables(spark, sf_dir).rights
    seq = F.col("seq")
    rows = rights.withColumns({"from_year": F.col("from_year") - 400, "to_year": F.col("to_year") - 400, "share": F.when(seq % 50 == 0, "half").otherwise(F.col("share")), "notes": F.when(seq % 9 == 0, F.concat(F.lit('a "note", of\nline '), seq.cast("string")))})
    columns = ["place_id", "right_type", "holder_id", "share", "status", "is_disputed", "disputed_with", "from_year", "to_year", "notes"]
    folder = _folder(spark)
    export.as_table(rows.orderBy("seq"), columns).write.csv(f"{folder}/rights.csv", header=True, quote='"', escape='"', emptyValue="")
    return folder


NUMBERED = f"{VIEWS}, numbered AS (SELECT *, row_number() OVER (ORDER BY seq) + 1 AS line FROM rights)"


@query(f"""{NUMBERED} SELECT line, place_id, right_type, holder_id, share, status, is_disputed, coalesce(opponent, '') AS disputed_with, (from_year - 400)::int AS from_year, (to_year - 400)::int AS to_year, 'high' AS confidence,
  CASE WHEN seq % 9 = 0 THEN 'a "note", of' || chr(10) || 'line ' || seq END AS notes FROM numbered WHERE seq % 50 <> 0""")
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = tables.load(spark, _rights_file(spark, sf_dir), "rights")
    return rows.select("line", "place_id", "right_type", "holder_id", "share", "status", "is_disputed", F.array_join("disputed_with", "|").alias("disputed_with"), "from_year", "to_year", "confidence", "notes")


@query(f"""{NUMBERED} SELECT 'error' AS level, 'rights' AS table_name, line AS row, 'share: not a share' AS message FROM numbered WHERE seq % 50 = 0
UNION ALL SELECT 'error', 'places', 1, 'unknown columns: r_comment, r_name, r_regionkey' UNION ALL SELECT 'warning', 'events', NULL, 'file missing (treated as empty)'""".replace("r_comment, r_name, r_regionkey", "r_name, r_regionkey, zone"))
def load_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _rights_file(spark, sf_dir)
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    region.select("r_regionkey", "r_name", F.lit("z").alias("zone")).coalesce(1).write.csv(f"{folder}/places.csv", header=True)
    return tables.load(spark, folder, "rights")[1].unionByName(tables.load(spark, folder, "places")[1]).unionByName(tables.load(spark, folder, "events")[1])


@query("SELECT c_custkey::varchar AS id, c_name AS name, '' AS blank, row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT '', '', '', NULL WHERE false".replace("row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer WHERE c_custkey % 10 <> 0", "line FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) + 1 AS line FROM customer) WHERE c_custkey % 10 <> 0"))
def read_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row has blanks only: it is left out, but counts as a line."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey")
    cell = lambda c: F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(c)
    path = f"{_folder(spark)}/cells.csv"
    rows.select(cell(F.col("c_custkey").cast("string")).alias("id"), cell(F.col("c_name")).alias("name"), F.lit("").alias("blank")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return tables.read_cells(spark, path)


def _nations(spark, sf_dir):
    return sorted((r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect())  # 25 rows


@query("""SELECT CASE n_regionkey % 2 WHEN 0 THEN 'place_types' ELSE 'right_types' END AS vocab, 'k' || n_nationkey AS key, n_name AS en, CASE WHEN n_nationkey % 3 = 0 THEN 'der ' || n_name END AS de, CASE WHEN n_nationkey % 4 = 0 THEN 'territory' END AS applies_to, n_nationkey % 5 = 0 AS core FROM nation""")
def load_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies: dict[str, list[str]] = {"place_types": [], "right_types": []}
    for key, name, region in _nations(spark, sf_dir):
        extra = (f", de: 'der {name}'" if key % 3 == 0 else "") + (", applies_to: territory" if key % 4 == 0 else "") + (", core: true" if key % 5 == 0 else "")
        vocabularies["place_types" if region % 2 == 0 else "right_types"].append(f"  k{key}: {{en: '{name}'{extra}}}")
    path = f"{_folder(spark)}/vocab.yaml"
    put(spark, path, "\n".join(f"{v}:\n" + "\n".join(rows) for v, rows in vocabularies.items()))
    label = lambda x: F.try_element_at("labels", F.lit(x)).alias(x)
    return tables.load_vocabulary(spark, path).select("vocab", "key", label("en"), label("de"), "applies_to", "core")


@query("""SELECT 'place_aliases' AS section, (row_number() OVER (ORDER BY n_nationkey) - 1)::int AS seq, n_name AS key, 'id-' || n_nationkey AS plain, NULL AS place, NULL AS share FROM nation
UNION ALL SELECT 'right_overrides', (row_number() OVER (ORDER BY n_nationkey) - 1)::int, '', NULL, n_name, '1/' || (n_nationkey + 1) FROM nation""")
def load_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nations(spark, sf_dir)
    text = "place_aliases:\n" + "\n".join(f"  {n}: id-{k}" for k, n, _ in rows) + "\nright_overrides:\n" + "\n".join(f"  - match: {{place: {n}}}\n    set: {{share: 1/{k + 1}}}" for k, n, _ in rows) + "\nempty:\n"
    path = f"{_folder(spark)}/rules.yaml"
    put(spark, path, text)
    field = lambda name, out: F.try_element_at("fields", F.lit(name)).alias(out)
    return tables.load_rules(spark, path).select("section", "seq", "key", field("", "plain"), field("match.place", "place"), field("set.share", "share"))


@query("""SELECT 'L1_' || n_regionkey AS chunk_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::int AS pos, n_name AS place, 'h' || n_nationkey AS holder_id, (1600 + n_nationkey)::int AS from_year, 'a|b' AS disputed_with FROM nation""")
def load_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = _folder(spark), _nations(spark, sf_dir)
    for region in sorted({r for *_, r in rows}):
        rights = [{"place": n, "holder_id": f"h{k}", "from_year": 1600 + k, "disputed_with": ["a", "b"]} for k, n, r in rows if r == region]
        put(spark, f"{folder}/L1_{region}.json", json.dumps({"model": "x", "extraction": {"rights": rights, "places": []}}, indent=1))
    put(spark, f"{folder}/other.json", "{}")
    return tables.load_extractions(spark, folder, "rights").select("chunk_id", "pos", "place", "holder_id", "from_year", F.array_join("disputed_with", "|").alias("disputed_with"))


def gazetteer_file(spark, sf_dir) -> str:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey")
    k = F.col("p_partkey")
    path = f"{_folder(spark)}/gazetteer.csv"
    canton = F.expr("repeat(chr(cast(97 + p_size % 6 as int)), 9)")
    refers = k % 7 == 0
    part.select(
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 200)).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("V"), k.cast("string"))).otherwise("").alias("variants"), F.when(refers, "Elsewhere").otherwise("").alias("see"), F.lit("M.").alias("dept_code"),
        F.lit("Moselle").alias("department"), F.lit("FR").alias("country"), canton.alias("canton"), F.when(refers, "").otherwise(F.col("p_size").cast("string")).alias("pages"), F.lit("raw").alias("raw"),
    ).write.csv(path, header=True, emptyValue="")
    return path


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) + 1 AS line FROM part), e AS (SELECT *, min(line) OVER (PARTITION BY p_name, p_size % 6) AS entry FROM r WHERE p_partkey % 7 <> 0)
SELECT line, entry, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name, 'entry' AS what FROM e UNION ALL SELECT line, NULL, upper(substr(p_name, 1, 1)) || substr(p_name, 2), 'reference' FROM r WHERE p_partkey % 7 = 0""")
def load_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, references = tables.load_gazetteer(spark, gazetteer_file(spark, sf_dir))
    return entries.select("line", "entry", "name", F.lit("entry").alias("what")).unionByName(references.select("line", F.lit(None).cast("long").alias("entry"), "name", F.lit("reference").alias("what")))


@query("""SELECT c_custkey AS geonameid, c_name AS name, (48 + c_custkey % 30 / 10.0)::double AS lat, (5 + c_custkey % 40 / 10.0)::double AS lon, 'FR' AS country, CASE WHEN c_custkey % 2 = 0 THEN 'P.PPL' ELSE 'S.CSTL' END AS feature, array_to_string(list_sort(list_distinct([trim(regexp_replace(lower(c_name), '[^a-z0-9-]+', ' ', 'g')), 'alt ' || c_custkey])), '|') AS names
FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 30 BETWEEN 1 AND 19 AND c_custkey % 40 BETWEEN 1 AND 39""")
def load_geonames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, F.lit("T\tMT")).when(k % 2 == 0, "P\tPPL").otherwise("S\tCSTL")
    line = F.concat_ws("\t", k.cast("string"), "c_name", "c_name", F.concat(F.lit("Alt "), k.cast("string"), F.lit(",")), (48 + k % 30 / 10.0).cast("string"), (5 + k % 40 / 10.0).cast("string"), kind, F.lit("FR"), F.lit("rest"))
    path = f"{_folder(spark)}/FR.txt"
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(line).write.text(path)
    found = tables.load_geonames(spark, path, (48.0, 5.0, 50.0, 9.0), ("P", "S.CSTL"))
    return found.withColumn("names", F.array_join("names", "|"))


@query("""SELECT 's' || n_nationkey AS id, 'list' AS how FROM nation WHERE n_nationkey IN (3, 7) UNION ALL SELECT 's' || n_nationkey, 'priority' FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0""")
def select_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    index = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("s"), n.cast("string")).alias("id"), F.col("n_regionkey").alias("livre"), (n % 2).alias("chapter"))
    chosen = tables.select_sections(index, "s3, s7", []).select("id", F.lit("list").alias("how"))
    return chosen.unionByName(tables.select_sections(index, "priority", [(1, 0)]).select("id", F.lit("priority").alias("how")))


@query("""SELECT 'n' || n_nationkey AS id, n_name AS name_fr FROM nation WHERE n_nationkey < 15 UNION ALL SELECT 'n' || n_nationkey, 'suggested' FROM nation WHERE n_nationkey >= 15""")
def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name_fr"))
    return tables.known_entities(rows.filter("n_nationkey < 15"), rows.filter("n_nationkey >= 10").withColumn("name_fr", F.lit("suggested")))


@query("""SELECT c_custkey AS geonameid, 'P' AS kind FROM customer WHERE c_custkey % 2 = 0""")
def write_and_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV in order of its key and loaded again."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("geonameid"), F.lit("P").alias("kind"))
    path = f"{_folder(spark)}/table.csv"
    export.write_table(rows, ["geonameid", "kind"], ["geonameid"], path)
    return spark.read.csv(path, header=True, schema="geonameid long, kind string")
