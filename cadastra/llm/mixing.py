"""Mixing sources to target weights by entropy balancing.

The sources' targets are filled up by weight, none above twice its source's
size. The rates w of the documents keep as near to one copy each as the targets
allow: the Fermi-Dirac entropy of w over (0, 2) is maximised under one token
constraint a source, sum(w * size) = target. The dual is convex with one
multiplier a source and gives w = 2 / (1 + exp(-m * size / mean size)), an
exponential tilt of the odds. Newton iterations on the dual run as Spark
aggregations over the counts of (source, size).

Rates are rounded to whole copies by systematic sampling: along the documents
of a source in order of size, then of a hash of the id, a document gets its
extra copy where the running sum of the fractional rates passes a whole number.
The running sum is in whole millionths and is found from counts of (source,
size, salt), so no task holds a source. Of 32 starting points the one with the
total nearest to the target is taken; then, up to twice, the document whose
size is nearest to what a source still lacks (or has too much) gains (or loses)
a copy. Nothing is random: reruns agree.

Null texts have size 0, a null source is a source of its own, and null or
repeated ids are rows like others. A source without words has the target 0, and
its rows, like all of size 0, the copies that their rate gives and no words.
Ties of size go by a hash of the id, then by the id. Texts of any length are
counted whole. The result has only the columns named; mixed() keeps all columns,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import stored

#: The weights that repeat along the sources, the share of all sizes, and the most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
_UNIT = 1_000_000
_ITERATIONS = 12
_STARTS = 32
_GROUP = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, size: words between white space; row_id is the id, or a hash of the text where it is null."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.xxhash64(text)).alias("row_id"), "doc_id", "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """k, source, source_size, target of each source, in order of code points, null last.

    Filling up by weight until none is above its cap is a common level: a source gets min(cap, weight * level). The level
    rises round by round, as what the capped ones leave is shared again; each round is an aggregation, so sources may be many.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # Sorted over all tasks; a source's number is its place in its part and the sizes of the parts before.
    by = stored(by.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    by = by.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    parts = by.groupBy("part").agg(F.count("*").alias("n"))  # a row a part
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    by = by.join(parts, "part").withColumn("k", F.col("before") + F.col("at") + 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("k") - 1, F.lit(len(weights))).cast("int") + 1)
    by = by.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    by = stored(by.select("k", "source", "source_size", "n_docs", "weight", "cap"), "mix-sources")
    total = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    level, seen = 0.0, None
    while True:
        full = F.col("cap") <= F.col("weight") * level
        n, capped, rest = by.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not rest:
            break
        seen, level = n, max(level, (total - capped) / rest)
    if not rest:
        level = float("inf")
    return by.select("k", "source", "source_size", "n_docs", F.least("cap", F.when(F.col("cap") > 0, F.col("weight") * level).otherwise(0.0)).alias("target"))


def _scaled():
    """A document's size over the mean of its source; 0 in a source without words."""
    return F.coalesce(F.try_divide(F.col("size") * F.col("n_docs"), F.col("source_size")), F.lit(0.0))


def _rate(most: float):
    return F.when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), F.lit(most)).otherwise(most / (1 + F.exp(-F.col("m") * F.col("x"))))


def balance(cells: DataFrame, by: DataFrame, most: float = MOST) -> DataFrame:
    """by with the multiplier m of each source. cells: k, size, n."""
    x = _scaled()
    by = by.withColumn("m", F.lit(0.0))
    for _ in range(_ITERATIONS):
        rows = cells.join(by, "k").withColumn("x", x).withColumn("w", _rate(most))
        step = rows.groupBy("k").agg(
            F.sum(F.col("n") * F.col("w") * F.col("size")).alias("made"),
            F.sum(F.col("n") * F.col("w") * (1 - F.col("w") / most) * F.col("size") * F.col("x")).alias("slope"),
        )
        move = F.coalesce((F.col("target") - F.col("made")) / F.when(F.col("slope") > 0, F.col("slope")), F.lit(0.0))
        # A step is held to 2, as Newton overshoots where the curve is flat.
        by = stored(by.join(step, "k", "left").withColumn("m", F.round(F.col("m") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move)), 12)).drop("made", "slope"), "mix-duals")
    return by.withColumn("m", F.round("m", 9))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """row_id, doc_id, size, source_size, target, rate, copies, taken of every row."""
    sized = stored(sizes(docs), "mix-sizes")
    by = stored(targets(sized, weights, share, most), "mix-targets")
    keyed = sized.join(by.select("k", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).select("row_id", "doc_id", "size", "k")
    cells = stored(keyed.groupBy("k", "size").agg(F.count("*").alias("n")), "mix-cells")
    by = balance(cells, by, most)
    x = _scaled()
    rates = cells.join(by, "k").withColumn("x", x).withColumn("rate", F.round(_rate(most), 6))
    rates = rates.withColumn("whole", F.floor("rate")).withColumn("part", F.round((F.col("rate") - F.col("whole")) * _UNIT).cast("long"))
    rates = rates.select("k", "size", "rate", "whole", "part", "source_size", "target", F.ceil(F.col("n") / _GROUP).alias("salts"))
    rows = keyed.join(rates, ["k", "size"]).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("salts")))
    parts = rows.groupBy("k", "size", "salt", "whole", "part", "target").agg(F.count("*").alias("n"))
    along = Window.partitionBy("k").orderBy("size", "salt")
    parts = parts.withColumn("upto", F.sum(F.col("n") * F.col("part")).over(along)).withColumn("base", F.col("upto") - F.col("n") * F.col("part"))
    parts = stored(parts, "mix-parts")
    passed = lambda a, b, u: F.floor((b + u) / _UNIT) - F.floor((a + u) / _UNIT)
    tried = parts.withColumn("u", F.explode(F.array(*[F.lit(i * (_UNIT // _STARTS)) for i in range(_STARTS)])))
    tried = tried.groupBy("k", "u", "target").agg(F.sum(F.col("size") * (F.col("n") * F.col("whole") + passed(F.col("base"), F.col("upto"), F.col("u")))).alias("made"))
    start = tried.groupBy("k").agg(F.min(F.struct(F.abs(F.col("made") - F.col("target")), "u"))["u"].alias("u"))
    rank = F.row_number().over(Window.partitionBy("k", "size", "salt").orderBy(F.xxhash64("row_id", F.lit(7)), "row_id"))
    out = rows.withColumn("rank", rank).join(parts.select("k", "size", "salt", "base").join(start, "k"), ["k", "size", "salt"])
    at = F.col("base") + F.col("rank") * F.col("part")
    out = out.withColumn("copies", (F.col("whole") + passed(at - F.col("part"), at, F.col("u"))).cast("long"))
    out = stored(out.select("row_id", "doc_id", "k", "size", "salt", "rank", "source_size", "target", "rate", "copies"), "mix-copies")
    for _ in range(2):
        out = _repaired(out, most)
    return out.select("row_id", "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _repaired(rows: DataFrame, most: float) -> DataFrame:
    """One copy more or less for at most one row of each source, where that brings the source nearer to its target."""
    lacks = rows.groupBy("k", "target").agg((F.col("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack")).drop("target")
    can = F.when(F.col("lack") > 0, F.col("copies") + 1 <= most).otherwise(F.col("copies") >= 1)
    off = F.abs(F.col("size") - F.abs("lack"))
    # One candidate of each (size, copies): what is joined and compared by source are few rows.
    kinds = rows.groupBy("k", "size", "copies").agg(F.min(F.struct("salt", "rank")).alias("one")).select("k", "size", "copies", "one.salt", "one.rank")
    pick = kinds.join(lacks, "k").filter(can & (off < F.abs("lack")))
    pick = pick.groupBy("k").agg(F.min(F.struct(off.alias("off"), "size", "salt", "rank", F.signum("lack").cast("long").alias("change"))).alias("p")).select("k", "p.size", "p.salt", "p.rank", "p.change")
    fixed = rows.join(pick, ["k", "size", "salt", "rank"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
    return stored(fixed, "mix-copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    nth = lambda *by: F.row_number().over(Window.partitionBy("m_id").orderBy(*by))  # noqa: E731  # rows that share an id
    plan = mix(docs).select(F.col("row_id").alias("m_id"), "size", "copies").withColumn("m_nth", nth("size", "copies"))
    text = F.coalesce("text", F.lit(""))
    count = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.xxhash64(text)).alias("m_id"), count.alias("m_size"))
    rows = rows.withColumn("m_nth", nth("m_size"))
    return rows.join(plan.select("m_id", "m_nth", "copies"), ["m_id", "m_nth"]).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("c")).select("row.*")
