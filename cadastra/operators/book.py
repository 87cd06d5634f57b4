"""A book's table of contents, its sections and endnotes, and the work that each section makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text as tx
from cadastra.functions.naming import toc_id
from cadastra.operators.fuzzy import ratio
from cadastra.operators.shared import stored

#: How the parts of a table of contents open, the entries that aren't sections, and where a chapter starts in the text.
BOOK = r"(?i)^LIVRE\s+(PREMIER|II|III)\b"
CHAPTER = r"(?i)^Chapitre\s+(premier|[IVX]+)\.\s*(.*)$"
SECTION = r"^([IVX]+)\s*\.+\s*(.*)$"
OTHERS = ("Avant-Propos", "Conclusion", "Bibliographie", "Table des noms", "Glossaire", "Table des gravures", "Table des matières")
SKIPPED = ("Table des Mati", "IMPRIMERIE")
CHAPTER_START = r"(?i)^\s*(Chapitre\s+(premier|[IVX]+)|Livre\s+(premier|deuxième|troisième))\b"
HEADING = r"(?s)^\s*([IVXl/1]{1,5})\s*[.,]+\s*(.+)"
_AT_END = r"^(.*?)[\s.]*\b(\d{1,3})$"


def parse_toc(lines: DataFrame) -> DataFrame:
    """book_id, nth, id, kind, title, page, livre, chapter, number, chapter_title of each entry. lines: book_id, nth, text.

    An entry opens with a numeral or one of OTHERS and ends with the line that ends with a page; what stands between
    two entries and isn't a book's or chapter's heading goes. The line after a book's heading is its subtitle. Parts
    are carried along by windows: the last heading before a line, the last opening, the last page.
    """
    along = Window.partitionBy("book_id").orderBy("nth")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    full = lines.withColumn("text", tx.strip(F.col("text"))).filter((F.col("text") != "") & ~F.col("text").rlike("^(?:" + "|".join(SKIPPED) + ")"))
    # The line after a book's heading is no heading, even if it looks like one; the line after that may be one again. So
    # of lines in a row that look like books every second one is a subtitle.
    full = full.withColumn("is_book", F.col("text").rlike(BOOK)).withColumn("others", F.count_if(~F.col("is_book")).over(along))
    full = full.withColumn("in_row", F.count_if("is_book").over(Window.partitionBy("book_id", "others").orderBy("nth")))
    after_book = F.coalesce(F.lag("is_book").over(along) & (F.lag("in_row").over(along) % 2 == 1), F.lit(False))
    full = full.withColumn("sub", F.when(F.col("is_book"), F.col("in_row") % 2 == 0).otherwise(after_book)).filter(~F.col("sub"))
    text = F.col("text")
    full = full.withColumns({"is_chapter": ~F.col("is_book") & text.rlike(CHAPTER), "is_section": text.rlike(SECTION), "is_other": text.rlike("^(?:" + "|".join(OTHERS) + ")")})
    heading = F.col("is_book") | F.col("is_chapter")
    opens = ~heading & (F.col("is_section") | F.col("is_other"))
    line = F.when(opens & F.col("is_section"), F.regexp_extract("text", SECTION, 2)).otherwise(text)
    full = full.withColumns({"heading": heading, "opens": opens, "line": line}).withColumn("ends", ~F.col("heading") & (F.col("line") != "") & F.col("line").rlike(_AT_END))
    full = full.withColumn("opened", F.last(F.when(F.col("opens"), F.col("nth")), ignorenulls=True).over(along))
    # An end closes what is open; a line is inside if something opened after the last end before it.
    closed = F.last(F.when(F.col("ends"), F.col("nth")), ignorenulls=True).over(before)
    full = full.withColumn("inside", F.col("opened").isNotNull() & (closed.isNull() | (F.col("opened") > closed)) & ~F.col("heading"))
    carry = lambda rule, value: F.last(F.when(rule, value), ignorenulls=True).over(along)
    numeral = F.upper(F.regexp_extract("text", CHAPTER, 1))
    full = full.withColumns({
        "livre": carry(F.col("is_book"), F.when(F.upper(F.regexp_extract("text", BOOK, 1)) == "PREMIER", 1).otherwise(tx.roman(F.upper(F.regexp_extract("text", BOOK, 1))))),
        "chapter": carry(F.col("is_chapter"), F.when(numeral == "PREMIER", 1).otherwise(tx.roman(numeral))), "chapter_at": carry(F.col("is_chapter"), F.col("nth")),
    })
    full = stored(full, "toc")
    joined = lambda c: tx.dehyphenate(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(c).alias("t")))), lambda x: x["t"]))
    bare = lambda t: F.regexp_replace(t, "[ .]+$", "")
    part = full.filter("inside").withColumn("shown", F.when(F.col("ends"), F.regexp_extract("line", _AT_END, 1)).otherwise(F.col("line")))
    entries = part.groupBy("book_id", "opened").agg(
        joined("shown").alias("title"), F.max(F.when(F.col("ends"), F.regexp_extract("line", _AT_END, 2).cast("int"))).alias("page"), F.max_by("livre", "nth").alias("livre"), F.max_by("chapter", "nth").alias("chapter"), F.max_by("chapter_at", "nth").alias("chapter_at"),
        F.min_by(F.when(F.col("is_section"), tx.roman(F.regexp_extract("text", SECTION, 1))), "nth").alias("number"),
    ).filter("page is not null")
    # A chapter's title goes on over the lines that belong to no entry.
    chapter = full.filter((F.col("is_chapter") | (~F.col("inside") & ~F.col("heading"))) & F.col("chapter_at").isNotNull())
    chapter = chapter.withColumn("shown", F.when(F.col("is_chapter"), F.regexp_extract("text", CHAPTER, 2)).otherwise(text)).groupBy("book_id", "chapter_at").agg(bare(joined("shown")).alias("chapter_title"))
    rows = entries.join(chapter, ["book_id", "chapter_at"], "left").withColumn("kind", F.when(F.col("number").isNull(), "other").otherwise("section"))
    only = lambda c: F.when(F.col("kind") == "section", F.col(c)).alias(c)
    rows = rows.withColumn("title", bare(F.col("title")))
    return rows.select("book_id", F.col("opened").alias("nth"), toc_id(F.col("kind"), F.col("livre"), F.col("chapter"), F.col("number"), F.col("title")).alias("id"), "kind", "title", "page", only("livre"), only("chapter"), "number", only("chapter_title"))


def is_heading(paragraph: Column, title: Column, number: Column) -> tuple[Column, Column, Column]:
    """What a paragraph's likeness to a section's heading is judged by: the two texts to compare (30 letters at most), and the least ratio that they need; null where the paragraph opens with no numeral or another one's."""
    rest, wanted = tx.norm(F.regexp_extract(paragraph, HEADING, 2)), tx.norm(title)
    most = F.least(F.length(wanted), F.lit(30))
    read = tx.numeral(F.regexp_extract(paragraph, HEADING, 1))
    least = F.when(paragraph.rlike(HEADING), F.when(read.isNull(), 0.85).when(read == number, 0.6))
    return F.substring(rest, F.lit(1), most), F.substring(wanted, F.lit(1), most), least


def section_starts(paragraphs: DataFrame, entries: DataFrame) -> DataFrame:
    """book_id, id, kind, at, found: where each entry starts, in order of their pages.

    A section's heading is the first paragraph on its page, the one before or the one after, behind the start before
    it, that is like its title; else the top of its page. paragraphs: book_id, at (numbered from 0), printed, text;
    entries: book_id, nth, id, kind, title, number, page. The starts of one book follow each other, so they are found
    by a fold over its entries, each with its few candidates.
    """
    window = entries.filter("kind = 'section'").select("book_id", "id", "title", "number", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("printed"))
    pairs = window.join(paragraphs.select("book_id", "at", "printed", "text"), ["book_id", "printed"])
    a, b, least = is_heading(F.col("text"), F.col("title"), F.col("number"))
    like = pairs.select("book_id", "id", "at", a.alias("a"), b.alias("b"), least.alias("least")).filter("least is not null").filter(ratio("a", "b") >= F.col("least"))
    heads = like.groupBy("book_id", "id").agg(F.array_sort(F.collect_list("at")).alias("heads"))
    tops = paragraphs.groupBy("book_id", "printed").agg(F.min("at").alias("top"))
    n = paragraphs.groupBy("book_id").agg((F.max("at") + 1).alias("n"))
    there = entries.join(tops.withColumnRenamed("printed", "page"), ["book_id", "page"]).join(heads, ["book_id", "id"], "left").join(n, "book_id")
    row = F.struct("page", "nth", "id", "kind", F.coalesce("heads", F.array().cast("array<bigint>")).alias("heads"), F.col("top").cast("long").alias("top"))
    by = there.groupBy("book_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<struct<id:string,kind:string,at:bigint,found:boolean>>").alias("out"), F.lit(-1).cast("long").alias("cursor"))

    def step(s: Column, r: Column) -> Column:
        head = F.get(F.filter(r["heads"], lambda x: x > s["cursor"]), F.lit(0))
        at = F.coalesce(head, F.greatest(r["top"], s["cursor"]))
        return F.struct(F.array_append(s["out"], F.struct(r["id"].alias("id"), r["kind"].alias("kind"), at.alias("at"), head.isNotNull().alias("found"))).alias("out"), at.alias("cursor"))

    return by.select("book_id", F.explode(F.aggregate("rows", start, step)["out"]).alias("s")).select("book_id", "s.*")


def split_sections(paragraphs: DataFrame, entries: DataFrame) -> DataFrame:
    """book_id, id, first_page, last_page, found, text of each section: from its start to the next one's, or to the next chapter's title, with a marker before each page's first paragraph."""
    starts = section_starts(paragraphs, entries)
    along = Window.partitionBy("book_id").orderBy("at", "nth")
    nth = entries.select("book_id", "id", "nth", "page")
    starts = starts.join(nth, ["book_id", "id"]).withColumn("next", F.lead("at").over(along))
    starts = stored(starts.filter("kind = 'section'"), "starts")
    # A paragraph belongs to the last start at or before it.
    marks = starts.select("book_id", F.col("at"), F.lit(0).alias("what"), "id", F.col("at").alias("start"), "next")
    flow = paragraphs.select("book_id", "at", F.lit(1).alias("what"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("next"), "printed", "text")
    carried = Window.partitionBy("book_id").orderBy("at", "what")
    both = marks.withColumn("printed", F.lit(None).cast("int")).withColumn("text", F.lit(None).cast("string")).unionByName(flow)
    last = lambda c: F.last(c, ignorenulls=True).over(carried)
    # A start's next is null for the last one, so the three go along together.
    both = both.withColumn("own", F.last(F.when(F.col("what") == 0, F.struct("id", "start", "next")), ignorenulls=True).over(carried)).filter("what = 1 and own is not null")
    inside = both.select("book_id", "at", "printed", "text", "own.id", "own.start", "own.next").filter("next is null or at < next")
    stop = F.min(F.when((F.col("at") > F.col("start")) & F.col("text").rlike(CHAPTER_START), F.col("at"))).over(Window.partitionBy("book_id", "id"))
    inside = inside.withColumn("stop", stop).filter("stop is null or at < stop")
    turn = F.coalesce(F.lag("printed").over(Window.partitionBy("book_id", "id").orderBy("at")) != F.col("printed"), F.lit(True))
    shown = inside.withColumn("shown", F.when(turn, F.concat(F.lit("[p. "), F.col("printed").cast("string"), F.lit("]\n\n"), "text")).otherwise(F.col("text")))
    made = shown.groupBy("book_id", "id").agg(F.min("printed").alias("first_page"), F.max("printed").alias("last_page"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), "\n\n").alias("text"))
    out = starts.join(made, ["book_id", "id"], "left")
    return out.select("book_id", "id", F.coalesce("first_page", "page").alias("first_page"), F.coalesce("last_page", "first_page", "page").alias("last_page"), "found", F.coalesce("text", F.lit("")).alias("text"))


def chapter_notes(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """chapter_id, first_page, last_page, text: the endnotes on the pages of each chapter, each page under its marker. notes: printed, nth, text; sections: livre, chapter, first_page, last_page."""
    key = F.format_string("L%d-C%02d", "livre", "chapter")
    spans = sections.withColumn("chapter_id", key).groupBy("chapter_id").agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
    pages = notes.groupBy("printed").agg(F.concat(F.lit("[p. "), F.first("printed").cast("string"), F.lit("]\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n")).alias("text"))
    at = spans.withColumn("printed", F.explode(F.sequence("first_page", "last_page"))).join(pages, "printed")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("printed", "text"))), lambda x: x["text"]), "\n\n")
    return spans.join(at.groupBy("chapter_id").agg(text.alias("text")), "chapter_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def entries_for_pages(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """section_id, labels: the index's labels of entries that name one of a section's pages, sorted. entries: label, pages (array); sections: section_id, first_page, last_page."""
    pages = sections.select("section_id", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    named = entries.select("label", F.explode("pages").alias("page"))
    return pages.join(named, "page").groupBy("section_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def jobs(sections: DataFrame, chunks_of, fixed: list[Column]) -> DataFrame:
    """id, section_id, part, parts, first_page, last_page, text, request_hash: a row a chunk of each section. sections: section_id, text, first_page; chunks_of: the function that cuts a text; fixed: what else a request holds."""
    rows = sections.select("section_id", chunks_of(F.col("text"), F.col("first_page")).alias("c"))
    rows = rows.select("section_id", F.size("c").alias("parts"), F.posexplode("c").alias("at", "piece")).withColumn("part", F.col("at") + 1)
    return rows.select(F.concat("section_id", F.lit("_"), F.col("part").cast("string")).alias("id"), "section_id", "part", "parts", "piece.first_page", "piece.last_page", "piece.text", tx.request_hash(*fixed, F.col("piece.text")).alias("request_hash"))


def page_map(pages: DataFrame, page_numbers, least_chars: int, start_offset: int = 1) -> DataFrame:
    """book, pdf, printed: numbers fitted to what was read at the pages' feet; a page with few characters counts as one without text."""
    rows = pages.select("book", "pdf", "candidates", (F.col("chars") >= least_chars).alias("has_text"))
    return page_numbers(rows, start_offset)


_USAGE = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def extraction_records(raw: DataFrame, rates: dict[str, float], discount: float = 0.5) -> DataFrame:
    """chunk_id, model, batch, the tokens used, cost_usd, failed, text of saved responses (chunk_id, json).

    rates: the price of a million tokens of each kind of _USAGE; a batch costs discount of it. failed names a response
    that was refused or cut off, which has no text.
    """
    usage = ", ".join(f"{u}: bigint" for u in _USAGE)
    schema = f"request_hash string, batch boolean, seconds double, message struct<model: string, stop_reason: string, usage: struct<{usage}>, content: array<struct<type: string, text: string>>>"
    r = raw.select("chunk_id", F.from_json("json", schema).alias("r")).select("chunk_id", "r.*")
    tokens = {u: F.coalesce(F.col(f"message.usage.{u}"), F.lit(0)) for u in _USAGE}
    # In decimals, so that what lies between two roundings goes up everywhere.
    exact = lambda v: F.lit(str(v)).cast("decimal(18,8)")
    cost = F.expr("cast(0 as decimal(38,8))")
    for u in _USAGE:
        cost = (cost + (tokens[u].cast("decimal(18,0)") * exact(rates.get(u, 0))).cast("decimal(38,8)")).cast("decimal(38,8)")
    cost = F.round((cost * F.when(F.col("batch"), exact(discount)).otherwise(exact(1))).cast("decimal(38,10)") / F.lit(1_000_000), 4).cast("double")
    failed = F.when(F.col("message.stop_reason").isin("refusal", "max_tokens"), F.col("message.stop_reason"))
    text = F.get(F.filter("message.content", lambda b: b["type"] == "text"), F.lit(0))["text"]
    return r.select("chunk_id", F.col("message.model").alias("model"), F.coalesce("batch", F.lit(False)).alias("batch"), *[c.alias(u) for u, c in tokens.items()], cost.alias("cost_usd"), failed.alias("failed"), F.when(failed.isNull(), text).alias("text"))


def estimate(jobs: DataFrame, rates: dict[str, float], discount: float = 0.5) -> DataFrame:
    """label, chunks, sections, done, tokens, chars, usd, batch_usd: what extracting the open jobs comes to, a row a rate.

    jobs: section_id, text (what is sent), tokens, done; rates: the price of a thousand characters by label; a batch
    costs discount of it. Sums are exact; prices are rounded to cents. Without open jobs the counts are 0.
    """
    open_ = ~F.coalesce("done", F.lit(False))
    one = lambda c: F.when(open_, c)
    total = jobs.agg(
        F.count(one(F.lit(1))).alias("chunks"), F.count_distinct(one(F.col("section_id"))).alias("sections"), F.count_if(~open_).alias("done"),
        F.coalesce(F.sum(one(F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.sum(one(F.length("text"))), F.lit(0)).cast("long").alias("chars"),
    )
    price = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(str(v)).cast("decimal(10,4)").alias("rate")) for k, v in rates.items()])).alias("r")
    usd = F.col("chars").cast("decimal(20,0)") * F.col("r.rate") / 1000
    cents = lambda c: F.round(c.cast("decimal(30,10)"), 2).cast("double")
    return total.select("*", price).select("r.label", "chunks", "sections", "done", "tokens", "chars", cents(usd).alias("usd"), cents(usd * F.lit(str(discount)).cast("decimal(6,4)")).alias("batch_usd"))


def mean_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, confidence, words: the mean of what recognised words are sure of; blank words and negative marks don't count, and without any it is 0. words: keys, text, conf."""
    counts = (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0)
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(counts, F.col("conf"))), F.lit(0.0)).alias("confidence"), F.count(F.when(counts, 1)).alias("words"))
