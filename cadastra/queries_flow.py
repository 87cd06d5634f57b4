"""Queries of the text flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators import textflow
from cadastra.queries_book import LINES, joined_sql
from cadastra.registry import query

_LINES = "SELECT l_orderkey AS block, l_linenumber * 1000000000::bigint + l_partkey * 1000 + l_suppkey % 1000 AS nth, l_partkey % 7 AS x0, 40 + l_suppkey % 15 AS x1, l_returnflag AS text FROM lineitem"


@query("""WITH marks AS (SELECT l_orderkey AS page, l_partkey % 1000 AS y0, l_partkey % 1000 + l_quantity::bigint AS y1 FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 1000, 1000 FROM lineitem),
run AS (SELECT *, greatest(0, coalesce(max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cursor FROM marks)
SELECT page, cursor::bigint AS y0, y0::bigint AS y1 FROM run WHERE y0 - cursor > 60""")
def uncovered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y0 = F.col("l_partkey") % 1000
    intervals = lines.select(F.col("l_orderkey").alias("page"), y0.alias("y0"), (y0 + F.col("l_quantity").cast("long")).alias("y1"))
    pages = lines.select(F.col("l_orderkey").alias("page"), F.lit(0).cast("long").alias("top"), F.lit(1000).cast("long").alias("bottom")).distinct()
    return textflow.uncovered(pages, intervals, 60)


@query(f"""WITH lines AS ({_LINES}), edge AS (SELECT block, median(x0) AS l, max(x1) AS r FROM lines GROUP BY block),
opened AS (SELECT lines.*, coalesce(lag(r - x1 > 8) OVER (PARTITION BY block ORDER BY nth), true) OR x0 - l > 2 AS opens FROM lines JOIN edge USING (block)),
numbered AS (SELECT *, sum(opens::int) OVER (PARTITION BY block ORDER BY nth) AS paragraph FROM opened)
SELECT block, paragraph::bigint AS paragraph, string_agg(text, ' ' ORDER BY nth) AS text FROM numbered GROUP BY block, paragraph""")
def block_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.select(F.col("l_orderkey").alias("block"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("nth"), (F.col("l_partkey") % 7).alias("x0"), (F.col("l_suppkey") % 15 + 40).alias("x1"), F.col("l_returnflag").alias("text"))
    return textflow.paragraphs(lines, 2, 8)


@query("""SELECT p_partkey, lower(p_brand) AS name, p_type AS variants, 'S.' AS code, 'Canton ' || p_size AS canton, p_size || ',' || (p_size + 2) || ',' || (p_size + 3) AS pages FROM part""")
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size").cast("string")
    entry = F.concat(F.lower("p_brand"), F.lit(", "), "p_type", F.lit(" (S., Canton "), size, F.lit(") "), size, F.lit(", "), (F.col("p_size") + 2).cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string"))
    row = part.select("p_partkey", textflow.index_row(entry).alias("r"))
    return row.select("p_partkey", "r.name", F.array_join("r.variants", "|").alias("variants"), "r.code", "r.canton", F.array_join("r.pages", ",").alias("pages"))


_BRACKETS = "length(replace({0}, ')', '')) - length(replace({0}, '(', ''))"


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM (SELECT doc_id, {LINES} AS lines FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, nth, line, 0 AS entry, {_BRACKETS.format("line")} AS depth FROM l WHERE nth = 1
  UNION ALL SELECT doc_id, nth, line, CASE WHEN goes_on THEN entry ELSE entry + 1 END, CASE WHEN goes_on THEN depth ELSE 0 END + {_BRACKETS.format("line")}
  FROM (SELECT l.doc_id, l.nth, l.line, w.entry, w.depth, regexp_matches(l.line, '^[\p{{Nd}}\p{{Ll}}()\-–—=]') OR w.depth > 0 OR right(w.line, 1) IN (',', '-', '=', '—') AS goes_on FROM w JOIN l ON l.doc_id = w.doc_id AND l.nth = w.nth + 1)),
g AS (SELECT doc_id, entry, list(line ORDER BY nth) AS lines FROM w GROUP BY doc_id, entry)
SELECT doc_id, entry AS nth, {joined_sql("lines")} AS entry FROM g""")
def wrap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(textflow.index_entries(F.split("text", "\n"))).alias("nth", "entry"))


_FITS = "w.size + 1 + length(s.piece) <= 5000"
_STARTS = "(NOT r.mark AND (f.chunk = 0 OR f.held + length(r.text) > 5000))"
_OPENS = "('[p. ' || r.page || ']')"


@query(rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: NOT starts_with(x, '# ')), chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
p AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS nth FROM d),
m AS (SELECT *, regexp_matches(text, '^\[p\. \d+\]$') AS mark, coalesce(last_value(nullif(regexp_extract(text, '^\[p\. (\d+)\]$', 1), '')::int IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS page FROM p),
s AS (SELECT doc_id, nth, page, mark, by_line, unnest(ss) AS piece, generate_subscripts(ss, 1) AS k FROM (SELECT *, contains(text, chr(10)) AS by_line, CASE WHEN length(text) <= 5000 THEN [text] WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE string_split(regexp_replace(text, '([.;]) ', '\1' || chr(1), 'g'), chr(1)) END AS ss FROM m)),
w AS (SELECT doc_id, nth, k, 1 AS grp, length(piece) AS size FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.nth, s.k, CASE WHEN {_FITS} THEN w.grp ELSE w.grp + 1 END, CASE WHEN {_FITS} THEN w.size + 1 ELSE 0 END + length(s.piece) FROM w JOIN s ON s.doc_id = w.doc_id AND s.nth = w.nth AND s.k = w.k + 1),
parts AS (SELECT doc_id, nth, grp, any_value(page) AS page, any_value(mark) AS mark, CASE WHEN any_value(by_line) THEN string_agg(piece, chr(10) ORDER BY k) ELSE string_agg(piece, ' ' ORDER BY k) END AS text FROM w JOIN s USING (doc_id, nth, k) GROUP BY doc_id, nth, grp),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth, grp) AS n FROM parts),
f AS (SELECT doc_id, 0::bigint AS n, 0 AS chunk, NULL::varchar AS text, '' AS waiting, NULL::int AS first, NULL::int AS last, 0::bigint AS held FROM (SELECT DISTINCT doc_id FROM numbered)
  UNION ALL SELECT f.doc_id, r.n, CASE WHEN {_STARTS} THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN {_STARTS} THEN {_OPENS} || chr(10) || chr(10) || r.text WHEN r.mark THEN f.text ELSE f.text || f.waiting || chr(10) || chr(10) || r.text END,
    CASE WHEN NOT r.mark THEN '' WHEN f.chunk = 0 THEN f.waiting ELSE f.waiting || chr(10) || chr(10) || r.text END, CASE WHEN {_STARTS} THEN r.page ELSE f.first END, CASE WHEN r.mark THEN f.last ELSE r.page END,
    CASE WHEN {_STARTS} THEN length({_OPENS}) + length(r.text) WHEN r.mark AND f.chunk = 0 THEN f.held ELSE f.held + length(r.text) END FROM f JOIN numbered r ON r.doc_id = f.doc_id AND r.n = f.n + 1)
SELECT doc_id, chunk - 1 AS nth, arg_max(text, n) AS text, arg_max(first, n) AS first_page, arg_max(last, n) AS last_page FROM f WHERE chunk > 0 GROUP BY doc_id, chunk""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(textflow.chunks(F.col("text"), F.lit(1))).alias("nth", "c")).select("doc_id", "nth", "c.text", "c.first_page", "c.last_page")


_STAY = "(f.cost[i] + CASE WHEN r.cand IS NULL THEN 0.3::double WHEN r.pdf - (i - 1) = r.cand THEN 0 ELSE 1 END)"
_SHIFT = "((CASE WHEN i = 1 THEN 'inf'::double ELSE f.cost[i - 1] END) + CASE WHEN r.has_text THEN 3.0::double ELSE 0.8::double END)"


def page_number_sql(has_text: str) -> str:
    """Page numbers of a book for each hundred orders; has_text: which pages aren't plates."""
    return f"""WITH RECURSIVE p AS (SELECT o_orderkey // 100 AS book, (o_orderkey % 100)::int AS pdf FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pdf) AS n, CASE WHEN pdf % 9 <> 8 AND pdf % 4 <> 0 THEN pdf - pdf // 9 END AS cand, {has_text} AS has_text FROM p),
f AS (SELECT book, 0::bigint AS n, list_prepend(0::double, list_transform(range(20), lambda i: 'inf'::double)) AS cost, []::boolean[][] AS flags FROM (SELECT DISTINCT book FROM p)
  UNION ALL SELECT f.book, r.n, list_transform(range(1, 22), lambda i: least({_STAY}, {_SHIFT})), list_append(f.flags, list_transform(range(1, 22), lambda i: {_SHIFT} <= {_STAY})) FROM f JOIN r ON r.book = f.book AND r.n = f.n + 1),
done AS (SELECT book, n, flags, list_position(cost, list_min(cost)) AS spot FROM f QUALIFY row_number() OVER (PARTITION BY book ORDER BY n DESC) = 1),
b AS (SELECT book, n, flags, spot FROM done WHERE n > 0 UNION ALL SELECT book, n - 1, flags, spot - flags[n][spot]::int FROM b WHERE n > 1)
SELECT b.book, r.pdf, CASE WHEN NOT b.flags[b.n][b.spot] THEN (r.pdf - (b.spot - 1))::bigint END AS printed FROM b JOIN r ON r.book = b.book AND r.n = b.n"""


@query(page_number_sql("pdf % 9 <> 8"))
def page_number_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # A book for each hundred orders; every ninth page is an insert, and every fourth footer isn't read.
    pdf = (F.col("o_orderkey") % 100).cast("int")
    printed = pdf - F.floor(pdf / 9).cast("int")
    read = F.when((pdf % 9 == 8) | (pdf % 4 == 0), F.array().cast("array<int>")).otherwise(F.array(printed))
    pages = orders.select(F.floor(F.col("o_orderkey") / 100).alias("book"), pdf.alias("pdf"), read.alias("candidates"), (pdf % 9 != 8).alias("has_text"))
    return textflow.page_numbers(pages)
