"""Aggregations of the views and of curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prominence(rights: DataFrame) -> DataFrame:
    """id, n, rank of the holders: most rights first, then by id.

    Holders with one count are numbered together, after all those with more; no task holds all holders unless all
    have one count.
    """
    count = rights.groupBy(F.col("holder_id").alias("id")).agg(F.count("*").alias("n"))
    by = count.groupBy("n").agg(F.count("*").alias("same"))
    before = by.withColumn("before", F.coalesce(F.sum("same").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("n").orderBy("id"))
    return count.join(before.select("n", "before"), "n").select("id", "n", (F.col("before") + within).cast("int").alias("rank"))


def first_seen_mode(rows: DataFrame, keys: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The most frequent value of each key; of those, the one seen first."""
    count = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return count.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def first_text(value: Column, seq: Column) -> Column:
    """The first non-empty text in order of seq."""
    full = value.isNotNull() & (value != "")
    return F.min_by(F.when(full, value), F.when(full, seq))


CONFIDENCE = ("low", "medium", "high")


def keyed_merge(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """One row a key: pages and opponents pooled, the best confidence, any dispute, the first of each text.

    rows: keys, seq, pages (array), confidence, is_disputed, disputed_with (array), texts.
    """
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    return rows.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.max(rank).cast("int")).alias("confidence"),
        F.max("is_disputed").alias("is_disputed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("disputed_with")))).alias("disputed_with"),
        F.min("seq").alias("seq"),
        *[first_text(F.col(t), F.col("seq")).alias(t) for t in texts],
    )


def legend(summary: DataFrame, ranks: DataFrame, top: int = 3, others: int = 8) -> DataFrame:
    """group, holder_id, n: the best-ranked holders, the most frequent others, and the sum of those left."""
    n = summary.filter(F.col("primary_holder").isNotNull()).groupBy(F.col("primary_holder").alias("holder_id")).agg(F.count("*").alias("n"))
    n = n.join(ranks.select(F.col("id").alias("holder_id"), "rank"), "holder_id", "left")
    best = n.orderBy("rank").limit(top).select(F.lit("top").alias("band"), "holder_id", "n")
    left = n.join(best.select("holder_id"), "holder_id", "left_anti")
    next_ = left.orderBy(F.desc("n"), "rank").limit(others).select(F.lit("other").alias("band"), "holder_id", "n")
    rest = left.join(next_.select("holder_id"), "holder_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.unionByName(next_).unionByName(rest.select(F.lit("rest").alias("band"), F.lit(None).cast("string").alias("holder_id"), "n"))


def matrix(force: DataFrame, rights: list[str]) -> DataFrame:
    """One row a place, a column of texts a right: holders with share and status, joined by " / "."""
    text = F.concat("holder_id", F.coalesce(F.concat(F.lit(" "), "share"), F.lit("")), F.when(F.col("status") == "held", "").otherwise(F.concat(F.lit(" ("), F.col("status"), F.lit(")"))))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), " / ")
    return force.groupBy("place_id").pivot("right_type", rights).agg(cell)


def yearly_histogram(events: DataFrame, spark, first: int, last: int) -> DataFrame:
    """year, n, share of the fullest year; years without events count 0."""
    count = events.groupBy("year").agg(F.count("*").alias("n"))
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    full = years.join(count, "year", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.max("n").over(Window.partitionBy())
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), most), F.lit(0.0)))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def coverage(places: DataFrame, rights: DataFrame, low: Column) -> DataFrame:
    """The counts of the coverage report, in one row."""
    held = rights.select(F.col("place_id").alias("id")).distinct().withColumn("held", F.lit(True))
    p = places.join(held, "id", "left").agg(
        F.count("*").alias("places"), F.count_if(F.col("kind") == "settlement").alias("settlements"), F.count_if(F.col("held")).alias("with_rights"),
        F.count_if((F.col("kind") == "settlement") & F.col("lat").isNotNull()).alias("geocoded"),
    )
    return p.crossJoin(rights.agg(F.count("*").alias("rights"), F.count_if(low).alias("low_confidence")))


def issue_patterns(issues: DataFrame) -> DataFrame:
    """level, table_name, pattern, n and the first five rows: messages alike but for names and numbers."""
    pattern = F.regexp_replace(F.regexp_replace("message", r"'[^']*'", "…"), r"\b\d{3,4}\b", "…")
    key = ["level", "table_name", "pattern"]
    issues = issues.withColumn("pattern", pattern)
    # Spark cuts each task's share of a pattern to its first five before it sends them.
    first = issues.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("row"))).where("nth <= 5")
    rows = first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda x: x["row"]).alias("rows"))
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    return issues.groupBy(*key).agg(F.count("*").alias("n")).alias("i").join(rows.alias("r"), same).select("i.*", "r.rows")
