"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import temporal
from cadastra.functions import text as tx
from cadastra.operators import fuzzy
from cadastra.plans.adapter import from_tables, sql_views
from cadastra.registry import query


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9-]+', ' ', 'g')) AS folded FROM documents) SELECT doc_id, folded, regexp_replace(regexp_replace(folded, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM f""")
def fold_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.fold(F.col("text")).alias("folded"), tx.slug(F.col("text")).alias("slug"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE rtrim(CASE WHEN contains(substr(text, 1, 199), ' ') THEN regexp_replace(substr(text, 1, 199), ' [^ ]*$', '', 's') ELSE substr(text, 1, 199) END, ' ,;:') || '…' END AS clipped FROM documents""")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.clip(F.col("text")).alias("clipped"))


@query(r"""SELECT doc_id, replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \x{00A0}\t]+', ' ', 'g'), ' '), ' +([,.)])', '\1', 'g'), '\( +', '(', 'g'), 'zzz', 'zzz') AS spaced FROM documents""")
def normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_spaces(F.col("text")).alias("spaced"))


_WORDS = "['office de ', 'la seigneurie de la ', 'comte du ', 'l ban d ', 'x '][c_custkey % 5 + 1]"


@query(rf"""WITH n AS (SELECT c_custkey, {_WORDS} || lower(replace(c_name, '#', ' ')) AS folded FROM customer)
SELECT c_custkey, coalesce(nullif(regexp_replace(folded, '^(?:(?:la|le|les|l) +)?(?:{"|".join(sorted(tx.TYPE_WORDS, key=len, reverse=True))}) +(?:(?:de|du|des|d) +)?(?:(?:la|le|les|l) +)?', ''), ''), folded) AS base FROM n""")
def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("office de ", "la seigneurie de la ", "comte du ", "l ban d ", "x "))), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(word, F.lower(F.replace("c_name", F.lit("#"), F.lit(" ")))).alias("folded"))
    return rows.select("c_custkey", tx.base_name(F.col("folded")).alias("base"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '|Borg' WHEN 1 THEN c_name || '|Hove' WHEN 2 THEN c_name ELSE c_name || '|A|B' END AS names FROM customer""")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, (" ou Borg", " (Hove)", " (le château)", " alias A ou B"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat("c_name", end).alias("name"))
    return rows.select("c_custkey", F.array_join(tx.split_names(F.col("name")), "|").alias("names"))


_PAGES = """p AS (SELECT o_orderkey, (o_orderkey % 400)::int AS lo, (o_orderkey % 400 + o_orderkey % 13)::int AS hi, (o_orderkey % 97)::int AS other FROM orders),
e AS (SELECT o_orderkey, list_sort(list_distinct(list_filter(list_concat(CASE WHEN hi - lo BETWEEN 1 AND 9 THEN range(lo, hi + 1) ELSE [lo] END, [other]), lambda x: x BETWEEN 1 AND 310))) AS pages FROM p)"""


def _pages(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("p. "), (k % 400).cast("string"), F.lit("-"), (k % 400 + k % 13).cast("string"), F.lit(", "), (k % 97).cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", tx.pages_of(ref).alias("pages"))


@query(f"WITH {_PAGES} SELECT o_orderkey, array_to_string(pages, ',') AS pages FROM e")
def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("o_orderkey", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(f"""WITH {_PAGES}, r AS (SELECT o_orderkey, page, page - row_number() OVER (PARTITION BY o_orderkey ORDER BY page) AS island FROM (SELECT o_orderkey, unnest(pages) AS page FROM e)),
s AS (SELECT o_orderkey, min(page) AS lo, max(page) AS hi FROM r GROUP BY o_orderkey, island)
SELECT o_orderkey, coalesce(string_agg(CASE WHEN lo = hi THEN lo::varchar ELSE lo || '-' || hi END, ';' ORDER BY lo), '') AS ref FROM (SELECT o_orderkey FROM e) LEFT JOIN s USING (o_orderkey) GROUP BY o_orderkey""")
def page_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("o_orderkey", tx.page_ref(F.col("pages")).alias("ref"))


@query("SELECT p_partkey, (p_size % 39 + 1)::int AS value FROM part")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals written from a number, and read back."""
    n = (F.col("p_size") % 39 + 1).cast("int")
    ones = F.element_at(F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), n % 10 + 1)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.numeral(F.concat(F.expr(f"repeat('X', cast(({'p_size % 39 + 1'}) / 10 as int))"), F.replace(ones, F.lit("I"), F.lit("1")))).alias("value"))


@query(f"""WITH RECURSIVE {sql_views()} SELECT seq, coalesce(from_year::varchar, '…') || '–' || coalesce(to_year::varchar, '…') AS years, CASE WHEN share IS NULL THEN 0 ELSE split_part(share, '/', 1)::double / split_part(share, '/', 2)::double END AS share_value,
  least(greatest(from_year, 1996), 1999) AS clamped, upper(substr('duchy of h', 1, 1)) || 'uchy Of ' || upper(substr(holder_id, 1, 1)) || substr(holder_id, 2) AS title, substr(sha256(place_id || chr(0) || right_type), 1, 16) AS request,
  round((seq * 3.0 + 15.0 * (seq % 100)) / 1e6 * CASE WHEN is_disputed THEN 0.5 ELSE 1 END, 9)::double AS price, coalesce(CASE WHEN seq % 2 = 0 THEN 'de ' || holder_id END, CASE WHEN seq % 3 = 0 THEN 'en ' || holder_id END, holder_id) AS name,
  CASE WHEN is_disputed THEN 'true' ELSE '' END AS flag_cell, coalesce(opponent, '') AS list_cell FROM rights""".replace("least(greatest(from_year, 1996), 1999)", "CASE WHEN from_year IS NULL THEN 1996 ELSE least(greatest(from_year, 1996), 1999) END"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    names = F.map_filter(F.create_map(F.lit("de"), F.when(seq % 2 == 0, F.concat(F.lit("de "), "holder_id")), F.lit("en"), F.when(seq % 3 == 0, F.concat(F.lit("en "), "holder_id"))), lambda _, v: v.isNotNull())
    return from_tables(spark, sf_dir).rights.select(
        "seq", temporal.years_text(F.col("from_year"), F.col("to_year")).alias("years"), temporal.share_value(F.col("share")).alias("share_value"), temporal.clamp(F.col("from_year"), 1996, 1999).alias("clamped"),
        tx.title_of(F.concat(F.lit("duchy-of-"), "holder_id")).alias("title"), tx.request_hash(F.col("place_id"), F.col("right_type")).alias("request"),
        F.round(tx.price(seq, seq % 100, 3.0, 15.0, F.col("is_disputed")), 9).alias("price"), tx.name(names, "de", F.col("holder_id")).alias("name"),
        tx.cell(F.col("is_disputed"), "boolean").alias("flag_cell"), tx.cell(F.col("disputed_with"), "array<string>").alias("list_cell"),
    )


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two closest part names of each part name with its first letter changed."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("entry")).distinct()
    return fuzzy.close_matches(parts.select(F.concat(F.lit("x"), F.substring("entry", 2, 200)).alias("name")), parts)


@query()
def merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.merge_suggestions(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct())
