"""Queries of the book's structure and of the layout steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import text as tx
from cadastra.operators import book, textflow
from cadastra.operators.shared import stored
from cadastra.registry import query

_ROMAN = "['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII', 'XIII', 'XIV', 'XV', 'XVI', 'XVII', 'XVIII', 'XIX', 'XX', 'XXI', 'XXII', 'XXIII', 'XXIV', 'XXV']"
_NUMERALS = tuple(x.strip(" '") for x in _ROMAN.strip("[]").split(","))


def _customers(spark, sf_dir):
    """Customers as sections: book (by tens of thousands), chapter, number (1 to 25) and page."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), F.lower("c_mktsegment").alias("segment"))
    return rows.withColumn("book_id", F.floor(F.col("k") / 500)).withColumn("number", (F.col("k") % 25 + 1).cast("int")).withColumn("chapter", (F.floor(F.col("k") % 500 / 25) + 1).cast("int")).withColumn("page", (F.col("k") % 500 + 10).cast("int"))


def toc_lines(rows: DataFrame) -> DataFrame:
    """The lines of a table of contents: a book's heading and subtitle, chapters on two lines, titles broken over two lines."""
    roman = lambda n: F.element_at(F.array(*map(F.lit, _NUMERALS)), n)
    line = lambda at, text: F.struct(F.lit(at).alias("at"), text.alias("text"))
    first, opens = F.col("page") == 10, F.col("number") == 1
    lines = F.concat(
        F.when(first, F.array(line(0, F.lit("LIVRE PREMIER")), line(1, F.lit("II. Le sous-titre 7")), line(2, F.lit("Avant-Propos . . . 3")))).otherwise(F.array().cast("array<struct<at:int,text:string>>")),
        F.when(opens, F.array(line(3, F.concat(F.lit("Chapitre "), F.when(F.col("chapter") == 1, "premier").otherwise(roman(F.col("chapter"))), F.lit(". Le chapitre"))), line(4, F.lit("et sa suite.")))).otherwise(F.array().cast("array<struct<at:int,text:string>>")),
        F.array(line(5, F.concat(roman(F.col("number")), F.lit(". Le titre "), "segment", F.lit(" du pa-"))), line(6, F.concat(F.lit("ys numéro "), F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij"), F.lit(" . . . "), F.col("page").cast("string")))),
    )
    return rows.select("book_id", "page", F.explode(lines).alias("l")).select("book_id", (F.col("page") * 10 + F.col("l.at")).alias("nth"), F.col("l.text").alias("text"))


_SECTIONS = "s AS (SELECT c_custkey AS k, lower(c_mktsegment) AS segment, c_custkey // 500 AS book_id, (c_custkey % 25 + 1)::int AS number, (c_custkey % 500 // 25 + 1)::int AS chapter, (c_custkey % 500 + 10)::int AS page FROM customer)"
_TITLE = "'Le titre ' || segment || ' du pays numéro ' || translate(k::varchar, '0123456789', 'abcdefghij')"


@query(f"""WITH {_SECTIONS}, has AS (SELECT book_id, max((page = 10)::int) = 1 AS named, min(CASE WHEN number = 1 THEN page END) AS first_open FROM s GROUP BY book_id),
chap AS (SELECT s.*, named, max(CASE WHEN number = 1 THEN chapter END) OVER (PARTITION BY s.book_id ORDER BY page) AS own FROM s JOIN has USING (book_id))
SELECT book_id, 'section' AS kind, {_TITLE} AS title, page, CASE WHEN named THEN 1 END::int AS livre, own::int AS chapter, number, CASE WHEN own IS NOT NULL THEN 'Le chapitre et sa suite' END AS chapter_title,
  CASE WHEN named AND own IS NOT NULL THEN printf('L%d-C%02d-S%02d', 1, own, number) END AS id FROM chap
UNION ALL SELECT book_id, 'other', 'Avant-Propos', 3, NULL, NULL, NULL, NULL, 'avant-propos' FROM s WHERE page = 10""")
def table_of_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = book.parse_toc(toc_lines(_customers(spark, sf_dir)))
    # A book that the rows begin in the middle of has sections without a book or a chapter: they have no id.
    whole = F.when(F.col("kind") == "other", F.col("id")).when(F.col("livre").isNotNull() & F.col("chapter").isNotNull(), F.col("id"))
    return found.withColumn("id", whole).drop("nth")


def _paragraphs(spark, sf_dir):
    """Three paragraphs a page: the end of the section before, the heading (misread on every fourth page), the text."""
    rows = _customers(spark, sf_dir)
    roman = F.element_at(F.array(*map(F.lit, _NUMERALS)), F.col("number"))
    title = F.concat(F.lit("Le titre "), "segment", F.lit(" numéro "), F.col("k").cast("string"))
    head = F.when(F.col("page") % 4 == 0, F.concat(F.lit("unreadable "), F.col("k").cast("string"))).otherwise(F.concat(roman, F.lit(". "), title))
    text = F.when(F.col("page") % 7 == 0, "Chapitre II. Suite").otherwise(F.concat(F.lit("text of "), F.col("k").cast("string")))
    at = F.row_number().over(_along()) * 3
    page = rows.withColumn("base", at - 3).select("book_id", F.col("page").alias("printed"), F.posexplode(F.array(F.concat(F.lit("end before "), F.col("k").cast("string")), head, text)).alias("i", "text"), "base")
    entries = rows.select("book_id", F.col("page").alias("nth"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("id"), F.lit("section").alias("kind"), title.alias("title"), "number", "page")
    return stored(page.select("book_id", (F.col("base") + F.col("i")).cast("long").alias("at"), "printed", "text"), "paragraphs"), stored(entries, "entries")


def _along():
    from pyspark.sql import Window

    return Window.partitionBy("book_id").orderBy("page")


_STARTS = f"""WITH {_SECTIONS}, p AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY page) - 1) * 3 AS base FROM s), st AS (SELECT *, base + CASE WHEN page % 4 = 0 THEN 0 ELSE 1 END AS spot FROM p)"""


@query(_STARTS + " SELECT book_id, 'e' || k AS id, spot::bigint AS \"at\", page % 4 <> 0 AS found FROM st")
def section_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.section_starts(*_paragraphs(spark, sf_dir)).select("book_id", "id", "at", "found")


@query(f"""{_STARTS}, n AS (SELECT *, lead(spot) OVER (PARTITION BY book_id ORDER BY page) AS nxt, lead(page) OVER (PARTITION BY book_id ORDER BY page) AS next_page, lead(k) OVER (PARTITION BY book_id ORDER BY page) AS next_k, coalesce(lead(base) OVER (PARTITION BY book_id ORDER BY page), base + 3) AS next_base FROM st)
SELECT book_id, 'e' || k AS id, page AS first_page, CASE WHEN page % 7 <> 0 AND coalesce(nxt > next_base, false) THEN next_page ELSE page END AS last_page, page % 4 <> 0 AS found,
  '[p. ' || page || ']' || chr(10) || chr(10) || CASE WHEN page % 4 = 0 THEN 'end before ' || k || chr(10) || chr(10) || 'unreadable ' || k ELSE {_ROMAN}[number] || '. Le titre ' || segment || ' numéro ' || k END
  || CASE WHEN page % 7 = 0 THEN '' ELSE chr(10) || chr(10) || 'text of ' || k || CASE WHEN coalesce(nxt > next_base, false) THEN chr(10) || chr(10) || '[p. ' || next_page || ']' || chr(10) || chr(10) || 'end before ' || next_k ELSE '' END END AS text FROM n""")
def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.split_sections(*_paragraphs(spark, sf_dir))


@query(f"""WITH {_SECTIONS}, spans AS (SELECT printf('L%d-C%02d', book_id, chapter) AS chapter_id, min(page) AS first_page, max(page) AS last_page FROM s GROUP BY 1),
notes AS (SELECT DISTINCT page AS printed FROM s WHERE page % 3 = 0)
SELECT chapter_id, first_page, last_page, coalesce((SELECT string_agg('[p. ' || printed || ']' || chr(10) || chr(10) || 'first' || chr(10) || chr(10) || 'second', chr(10) || chr(10) ORDER BY printed) FROM notes WHERE printed BETWEEN first_page AND last_page), '') AS text FROM spans""")
def chapter_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    pages = rows.filter("page % 3 = 0").select(F.col("page").alias("printed")).distinct()
    notes = pages.select("printed", F.posexplode(F.array(F.lit("first"), F.lit("second"))).alias("nth", "text"))
    return book.chapter_notes(notes, rows.select(F.col("book_id").cast("int").alias("livre"), "chapter", F.col("page").alias("first_page"), F.col("page").alias("last_page")))


@query("""WITH e AS (SELECT 'label ' || p_partkey AS label, [p_size, p_size + 3] AS pages FROM part), s AS (SELECT 's' || n_nationkey AS section_id, n_nationkey AS a, n_nationkey + 2 AS b FROM nation)
SELECT section_id, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM s JOIN (SELECT label, unnest(pages) AS page FROM e) ON page BETWEEN a AND b GROUP BY section_id""")
def index_entries_for_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("label "), F.col("p_partkey").cast("string")).alias("label"), F.array("p_size", F.col("p_size") + 3).alias("pages"))
    n = F.col("n_nationkey")
    sections = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("s"), n.cast("string")).alias("section_id"), n.alias("first_page"), (n + 2).alias("last_page"))
    return book.entries_for_pages(entries, sections).withColumn("labels", F.array_join("labels", "|"))


@query("""SELECT n_name || '_1' AS id, n_name AS section_id, 1 AS part, 1 AS parts, 5 AS first_page, 5 AS last_page, substr(sha256('v1' || chr(0) || '[p. 5]' || chr(10) || chr(10) || 'about ' || n_name), 1, 16) AS request_hash FROM nation""")
def section_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("section_id"), F.concat(F.lit("# title\nabout "), "n_name").alias("text"), F.lit(5).alias("first_page"))
    return book.jobs(sections, lambda text, page: textflow.chunks(text, page), [F.lit("v1")]).drop("text")


@query("""SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 7 = 0 THEN 'max_tokens' END AS failed, ((o_orderkey * 3 + o_custkey * 15) * CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 10 END + 500) // 1000 / 10000.0::double AS cost_usd, o_orderkey AS input_tokens, CASE WHEN o_orderkey % 7 <> 0 THEN 'facts' END AS text FROM orders""")
def extraction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text"))
    message = F.struct(F.lit("m").alias("model"), F.when(k % 7 == 0, "max_tokens").otherwise("end_turn").alias("stop_reason"), F.struct(k.alias("input_tokens"), F.col("o_custkey").alias("output_tokens")).alias("usage"), F.array(block("thinking", "hm"), block("text", "facts")).alias("content"))
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("chunk_id"), F.to_json(F.struct((k % 2 == 0).alias("batch"), message.alias("message"))).alias("json"))
    return book.extraction_records(raw, {"input_tokens": 3.0, "output_tokens": 15.0}).select("chunk_id", "failed", "cost_usd", "input_tokens", "text")


_LETTER = r"[\p{L}\p{N}_]"


LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), lambda x: x <> '')"


def joined_sql(lines: str) -> str:
    """SQL of the paragraph that a list of lines without blank ones makes."""
    text = rf"""list_reduce(list_prepend('', {lines}), lambda a, b: CASE WHEN a = '' THEN b WHEN NOT a LIKE '%-' OR a LIKE '% -' THEN a || ' ' || b
  WHEN regexp_matches(b, '^\p{{Ll}}') AND regexp_extract(b, '^({_LETTER}*)', 1) NOT IN ({", ".join(f"'{p}'" for p in tx.PARTICLES)}) THEN substr(a, 1, length(a) - 1) || b ELSE a || b END)"""
    return rf"regexp_replace(regexp_replace(trim(regexp_replace({text}, '[ \x{{00A0}}\t]+', ' ', 'g'), ' '), ' +([,.)])', '\1', 'g'), '\( +', '(', 'g')"


@query(f"SELECT doc_id, {joined_sql(LINES)} AS joined FROM documents WHERE text IS NOT NULL")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", tx.dehyphenate(F.split("text", "\n")).alias("joined"))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS block, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, (l_partkey % 40)::double AS x0, (l_suppkey % 4)::double AS y0, (60 + l_partkey % 9)::double AS x1, (l_suppkey % 4 + 10)::double AS y1, 't' || l_partkey || '.' || l_suppkey AS text FROM lineitem WHERE l_orderkey % 5 = 0),
m AS (SELECT block, nth, 1 AS line, x0, y0, x1, y1, text FROM l WHERE nth = 1
  UNION ALL SELECT l.block, l.nth, CASE WHEN abs(l.y0 - m.y0) < 2 THEN line ELSE line + 1 END, CASE WHEN abs(l.y0 - m.y0) < 2 THEN least(m.x0, l.x0) ELSE l.x0 END, CASE WHEN abs(l.y0 - m.y0) < 2 THEN least(m.y0, l.y0) ELSE l.y0 END,
    CASE WHEN abs(l.y0 - m.y0) < 2 THEN greatest(m.x1, l.x1) ELSE l.x1 END, CASE WHEN abs(l.y0 - m.y0) < 2 THEN greatest(m.y1, l.y1) ELSE l.y1 END, CASE WHEN abs(l.y0 - m.y0) < 2 THEN m.text || ' ' || l.text ELSE l.text END FROM m JOIN l ON l.block = m.block AND l.nth = m.nth + 1)
SELECT block, line::int AS line, arg_max(x0, nth) AS x0, arg_max(y0, nth) AS y0, arg_max(x1, nth) AS x1, arg_max(y1, nth) AS y1, arg_max(text, nth) AS text FROM m GROUP BY block, line""")
def merge_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey % 5 = 0")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    num = lambda c: c.cast("double")
    rows = lines.select(F.col("l_orderkey").alias("block"), nth.alias("nth"), num(F.col("l_partkey") % 40).alias("x0"), num(F.col("l_suppkey") % 4).alias("y0"), num(60 + F.col("l_partkey") % 9).alias("x1"), num(F.col("l_suppkey") % 4 + 10).alias("y1"), F.concat(F.lit("t"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string")).alias("text"))
    found = textflow.merged_baselines(rows, 2.0).select("block", F.posexplode("lines").alias("at", "l"))
    return found.select("block", (F.col("at") + 1).alias("line"), "l.x0", "l.y0", "l.x1", "l.y1", "l.text")


@query("""WITH b AS (SELECT l_orderkey AS page, (l_partkey % 100)::double AS x0, (l_linenumber * 1000 + l_suppkey % 500 + l_partkey % 999 / 1000.0)::double AS y0, 'a' || l_partkey || chr(10) || 'LICENCE x' || chr(10) || 'b' || l_suppkey AS text FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0 > min(x0) OVER (PARTITION BY page) + 25, y0, text) AS block FROM (SELECT *, min(x0) OVER (PARTITION BY page) AS l FROM b) b2), x AS (SELECT page, block, unnest(list_filter(string_split(text, chr(10)), lambda t: NOT starts_with(t, 'LICENCE'))) AS line, unnest([1, 2]) AS i FROM o)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY block, i)::int AS nth, line FROM x""".replace("x0 > min(x0) OVER (PARTITION BY page) + 25", "x0 > l + 25"))
def column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat(F.lit("a"), F.col("l_partkey").cast("string"), F.lit("\nLICENCE x\nb"), F.col("l_suppkey").cast("string"))
    y0 = (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 500 + F.col("l_partkey") % 999 / 1000.0).cast("double")
    blocks = rows.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 100).cast("double").alias("x0"), y0.alias("y0"), text.alias("text"))
    return textflow.column_lines(blocks, 100.0, ("LICENCE",))


@query("""WITH l AS (SELECT l_orderkey AS block, l_linenumber * 100000000::bigint + l_partkey * 1000 + l_suppkey AS nth, (l_partkey % 50)::double AS x0, (l_suppkey % 90)::double AS y0, (l_partkey % 50 + 30 + l_suppkey % 20)::double AS x1, 'text ' || l_partkey AS text FROM lineitem),
w AS (SELECT *, lead(y0) OVER (PARTITION BY block ORDER BY nth) - y0 AS way FROM l), b AS (SELECT block, max(x1) - min(x0) AS width, median(way) AS way, count(*) AS n, sum(x1 - x0) / greatest(1, sum(length(text))) AS each FROM w GROUP BY block)
SELECT block, width <= 60 AND CASE WHEN n > 1 THEN way < 9 ELSE each < 4.5 END AS is_note FROM b""")
def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    lines = rows.select(F.col("l_orderkey").alias("block"), (F.col("l_linenumber") * F.lit(100_000_000).cast("long") + p * 1000 + s).alias("nth"), (p % 50).cast("double").alias("x0"), (s % 90).cast("double").alias("y0"), (p % 50 + 30 + s % 20).cast("double").alias("x1"), F.concat(F.lit("text "), p.cast("string")).alias("text"))
    return textflow.note_blocks(lines, 100.0)


@query("""SELECT p_partkey, p_name AS person, p_size || ',' || (p_size + 1) AS person_pages, lower(p_brand) AS term, p_type || ' thing' AS gloss, 'Moselle' AS department, 'DE' AS country, lower(p_brand) || ' (x)' AS label, p_size % 9 > 4 AS spaced, 'one two' AS ocr,
  CASE WHEN p_size = 1 THEN 'map' WHEN p_size < 5 THEN 'front' WHEN p_size > 45 THEN 'back' WHEN p_size % 10 = 0 THEN 'plate' WHEN p_size > 40 THEN 'back' WHEN p_size % 3 <> 0 THEN 'text' WHEN p_size % 2 = 0 THEN 'ocr' ELSE 'blank' END AS kind FROM part""")
def index_and_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    pages = F.concat(F.lit(" "), size.cast("string"), F.lit("-"), (size + 1).cast("string"))
    kind = textflow.page_kind(size == 1, F.when(size % 10 != 0, size), size.between(5, 45), size < 5, F.when(size % 3 != 0, 500).otherwise(3), size % 2 == 0, 41, 100)
    person, gloss = textflow.person_row(F.concat("p_name", F.lit(","), pages)), textflow.glossary_row(F.concat(F.lower("p_brand"), F.lit(", "), "p_type", F.lit(" thing"), pages))
    spaced = F.when(size % 9 > 4, "x D u c h é").otherwise("not so at all")
    return part.select(
        "p_partkey", person["name"].alias("person"), F.array_join(person["pages"].cast("array<string>"), ",").alias("person_pages"), gloss["term"].alias("term"), gloss["gloss"].alias("gloss"), textflow.department(F.lit("M.")).alias("department"), textflow.country(F.lit("S.")).alias("country"),
        textflow.index_label(F.concat(F.lower("p_brand"), F.lit(" (x) 12")), F.col("p_name")).alias("label"), tx.is_letterspaced(spaced).alias("spaced"), F.array_join(textflow.ocr_paragraphs(F.lit("\n \none  two\n\n  \n")), "|").alias("ocr"), kind.alias("kind"),
    )


@query("""SELECT l_orderkey AS line, string_agg(CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 2 = 0 THEN ' [' || l_linenumber || ']' ELSE 'w' || l_partkey END, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 2 = 0 THEN 5 ELSE 10 END AS size, max(CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 2 = 0 THEN 5 ELSE 10 END) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE true GROUP BY l_orderkey HAVING max(top) = 10
UNION ALL SELECT l_orderkey, string_agg(l_linenumber::varchar, '' ORDER BY l_linenumber, l_partkey, l_suppkey) FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_linenumber % 2 = 0 AND l_suppkey % 2 = 0)""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    small = (F.col("l_linenumber") % 2 == 0) & (F.col("l_suppkey") % 2 == 0)
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    spans = rows.select(F.col("l_orderkey").alias("line"), nth.alias("nth"), F.when(small, 5.0).otherwise(10.0).alias("size"), F.when(small, F.col("l_linenumber").cast("string")).otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).alias("text"))
    return textflow.line_text(spans)
