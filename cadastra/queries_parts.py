"""Queries of small parts that other operators are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra import queries as core
from cadastra.functions import naming as nm
from cadastra.functions import text as tx
from cadastra.operators import book, curate, geometry, textflow, validate, views
from cadastra.operators import snapshot as snap
from cadastra.plans.adapter import from_tables, sql_views
from cadastra.queries_flow import page_number_sql
from cadastra.registry import query

VIEWS = "WITH RECURSIVE " + sql_views()


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderkey", "k")


@query("""SELECT o_orderkey AS k, array_to_string(list_concat(range(o_orderkey % 90 + 1, o_orderkey % 90 + 2 + o_orderkey % 4), [o_orderkey % 50, o_orderkey % 7]), ',') AS pages FROM orders""")
def curated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    s = lambda c: c.cast("string")
    text = F.concat(s(k % 90 + 1), F.lit("-"), s(k % 90 + 1 + k % 4), F.lit(";"), s(k % 50), F.lit(";"), s(k % 7))
    return _orders(spark, sf_dir).select("k", F.array_join(tx.parse_pages(text).cast("array<string>"), ",").alias("pages"))


@query(f"""{VIEWS} SELECT seq, concat_ws('|', year::varchar, place_id, right_type, coalesce(from_holder, ''), to_holder, event_type) AS key, CASE WHEN seq % 3 > 0 THEN 'p' || seq END AS page FROM transfers""")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["year", "place_id", "right_type", "from_holder", "to_holder", "event_type"]
    events = from_tables(spark, sf_dir).events.withColumn("key", nm.event_key(fields))
    page = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("seq").cast("string")))
    return events.select("seq", F.concat_ws("|", *[F.col(f"key.{c}") for c in fields]).alias("key"), nm.page_or_none(page).alias("page"))


@query(r"""WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'duchy-of-' || p_partkey WHEN 1 THEN 'Name (' || p_name WHEN 2 THEN repeat(p_name || ' ', 4) WHEN 3 THEN 'Ban-' || p_partkey WHEN 4 THEN 'Name (' || p_size || ')' ELSE p_name END AS name FROM part)
SELECT k, length(name) <= 60 AND length(replace(name, '(', '')) = length(replace(name, ')', '')) AND NOT regexp_matches(name, '(?i)^(duchy|ban)-[a-z0-9-]+$') AS usable FROM n""")
def usable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    s = lambda c: c.cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit("duchy-of-"), s(k))).when(k % 6 == 1, F.concat(F.lit("Name ("), n)).when(k % 6 == 2, F.repeat(F.concat(n, F.lit(" ")), 4)).when(k % 6 == 3, F.concat(F.lit("Ban-"), s(k))).when(k % 6 == 4, F.concat(F.lit("Name ("), s(F.col("p_size")), F.lit(")"))).otherwise(n)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), nm.usable_name(name).alias("usable"))


@query("""WITH g AS (SELECT o_orderkey AS line, i, substr(o_orderpriority, i::int, 1) AS c FROM orders, range(1, 20) r(i) WHERE i <= length(o_orderpriority))
SELECT line, string_agg(CASE WHEN i > 1 AND (line + i) % 5 = 0 THEN ' ' ELSE '' END || c, '' ORDER BY i) AS text FROM g GROUP BY line""")
def letterspaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as single glyphs, of which some stand farther apart."""
    glyphs = _orders(spark, sf_dir).select(F.col("k").alias("line"), F.posexplode(F.split("o_orderpriority", "")).alias("i", "char")).where("char <> ''").withColumn("i", F.col("i") + 1)
    x0 = F.col("i") * 10.0
    x1 = x0 + F.when((F.col("line") + F.col("i") + 1) % 5 == 0, 4.0).otherwise(9.0)
    return textflow.letterspaced(glyphs.select("line", x0.alias("x0"), x1.alias("x1"), F.lit(10.0).alias("size"), "char"))


@query(f"""{VIEWS}, f AS (SELECT 'p' || seq % 40 AS place_id, right_type, 'h' || seq % 3 AS holder_id, share, status, from_year, to_year, seq, (seq % 50)::int AS page, seq % 3 AS c, is_disputed, opponent, CASE WHEN seq % 3 = 1 THEN 'note ' || seq ELSE '' END AS notes FROM rights)
SELECT place_id, right_type, holder_id, share, status, from_year, to_year, min(seq) AS seq, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, ['low', 'medium', 'high'][max(c) + 1] AS confidence, bool_or(is_disputed) AS is_disputed, coalesce(string_agg(DISTINCT opponent, '|' ORDER BY opponent), '') AS disputed_with, arg_min(notes, seq) FILTER (notes <> '') AS notes FROM f
GROUP BY place_id, right_type, holder_id, share, status, from_year, to_year""")
def rights_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights whose places and holders have been changed to fewer."""
    seq = F.col("seq")
    rows = from_tables(spark, sf_dir).rights.withColumns({
        "place_id": F.concat(F.lit("p"), (seq % 40).cast("string")), "holder_id": F.concat(F.lit("h"), (seq % 3).cast("string")), "pages": F.array((seq % 50).cast("int")), "confidence": F.element_at(F.array(*map(F.lit, curate.CONFIDENCE)), (seq % 3 + 1).cast("int")),
        "notes": F.when(seq % 3 == 1, F.concat(F.lit("note "), seq.cast("string"))).otherwise(""),
    })
    found = curate.rekeyed(rows, ["place_id", "right_type", "holder_id", "share", "status", "from_year", "to_year"], ["notes"])
    return found.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ",")).withColumn("disputed_with", F.array_join("disputed_with", "|"))


@query("""WITH v AS (SELECT p_partkey AS k, p_name AS en, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS fr, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS de FROM part),
l AS (SELECT k, unnest([{'lang': 'en', 'label': en}, {'lang': 'fr', 'label': fr}, {'lang': 'de', 'label': de}]) AS l FROM v)
SELECT 'error' AS level, 'vocab' AS table_name, 'key' || k AS row, 'parts.key' || k || ': no label in ' || l.lang AS message FROM l WHERE coalesce(l.label, '') = ''""")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("parts").alias("vocabulary"), F.concat(F.lit("key"), k.cast("string")).alias("key"), n.alias("en"), F.when(k % 3 == 0, "").otherwise(n).alias("fr"), F.when(k % 4 > 0, n).alias("de"))
    return validate.missing_labels(words)


@query("""SELECT c_custkey AS k, 4 + (c_custkey % 3 > 0)::int AS corners, round(4.0 * (c_custkey % 10 + 1) + CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 10 + 1) ELSE 0 END, 6)::double AS total_x FROM customer""")
def simplified_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring a customer, of which one corner strays from a side by 0, 2 or 4 tenths of its size; it stays if that is more than a tenth."""
    k, s = F.col("c_custkey"), (F.col("c_custkey") % 10 + 1).cast("double")
    point = lambda x, y: F.array(x * s, y * s)
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point(F.lit(1.0), (k % 3) * 0.2), point(F.lit(2.0), F.lit(0.0)), point(F.lit(2.0), F.lit(2.0)), point(F.lit(0.0), F.lit(2.0)))
    found = geometry.simplified(spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), ring.alias("ring")), 0.1)
    return found.select("k", F.size("ring").alias("corners"), F.round(F.aggregate("ring", F.lit(0.0), lambda t, p: t + p[0]), 6).alias("total_x"))


@query(core._sql(core.VIEWS, core.ONE_YEAR, core.ACTIVE, core.FORCE, """found AS (SELECT place_id, right_type FROM force GROUP BY place_id, right_type HAVING bool_or(is_disputed OR status IN ('claimed', 'contested')))""",
  """named AS (SELECT f.place_id, f.right_type, coalesce(p.name, f.place_id) AS name FROM found f LEFT JOIN places p ON p.id = f.place_id)""",
  """SELECT place_id, right_type, name, row_number() OVER (ORDER BY lower(name), place_id, right_type) AS nth FROM named"""))
def disputes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = from_tables(spark, sf_dir)
    found = snap.disputes(snap.snapshot(ds.rights, core.YEAR))
    return views.disputes_view(found, ds.places.select(F.col("id").alias("place_id"), "name")).select("place_id", "right_type", "name", "nth")


@query(page_number_sql("pdf % 9 <> 8"))
def page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each hundred orders; the pages with few characters count as plates."""
    k = F.col("k")
    pdf = (k % 100).cast("int")
    printed = pdf - F.floor(pdf / 9).cast("int")
    read = F.when((pdf % 9 == 8) | (pdf % 4 == 0), F.array().cast("array<int>")).otherwise(F.array(printed))
    pages = _orders(spark, sf_dir).select(F.floor(k / 100).alias("book"), pdf.alias("pdf"), read.alias("candidates"), F.when(pdf % 9 == 8, 20).otherwise(900).alias("chars"))
    return book.page_map(pages, textflow.page_numbers, 100, 0)
