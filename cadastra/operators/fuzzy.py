"""Similarity of names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cadastra.operators.shared import stored


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over the length of both (Ratcliff and Obershelp)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def can_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether two texts' lengths allow that ratio."""
    return 2 * F.least(F.length(a), F.length(b)) >= cutoff * (F.length(a) + F.length(b))


def _shortened(text: Column, most: Column) -> Column:
    """The texts that text becomes without up to most of its letters."""
    drop = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    step = lambda a: F.array_distinct(F.concat(a, F.flatten(F.transform(F.filter(a, lambda t: t != ""), drop))))
    out = F.array(text)
    for n in range(1, _DROPPED + 1):
        out = F.when(most >= n, step(out)).otherwise(out)
    return out


#: So many letters at most are left out of a text to meet others; longer texts meet by a piece that both have.
_DROPPED = 2


def alike_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """a, b, ratio: the pairs of texts whose ratio is cutoff or more, once each. left: a; right: b.

    The blocks that match are a text M letters long that both become without some letters. M is cutoff / 2 of both
    lengths at least, so a text loses at most (1 - cutoff / (2 - cutoff)) of its letters and both together 1 - cutoff of
    theirs. Short texts meet by what is left of them. Of a long one, cut into as many pieces and one as letters may be
    lost, a piece stands whole in the other, moved by at most as many; the other is as long at least as what is left of
    the first, and they meet by that piece and where it stands.
    """
    share, tasks = 1 - cutoff / (2 - cutoff), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Only texts of lengths that some text of the other side is near to.
    lengths = left.select(F.length("a").alias("la")).distinct().join(right.select(F.length("b").alias("lb")).distinct(), 2 * F.least("la", "lb") >= cutoff * (F.col("la") + F.col("lb")))
    near = lambda rows, c: rows.distinct().join(lengths, F.length(c) == F.col("l" + c), "left_semi").repartition(tasks, c)
    left, right = stored(near(left, "a"), "alike-left"), stored(near(right, "b"), "alike-right")
    most = lambda c: F.floor(F.length(c) * share + 1e-9).cast("int")
    short = lambda c: most(c) <= _DROPPED
    key = lambda rows, c: rows.where(short(c)).select(c, F.explode(_shortened(F.col(c), most(c))).alias("rest"))
    # Spark takes both for as small as they were before the letters were left out.
    met = key(left, "a").join(key(right, "b").hint("merge"), "rest").where(2 * F.length("rest") >= cutoff * (F.length("a") + F.length("b")) - 1e-9).select("a", "b")

    least = int((_DROPPED + 1) / share * (1 - share))  # a shorter text can't be like a long one
    lost = F.floor((1 - cutoff) * F.length("a") * (2 / cutoff) + 1e-9).cast("int")
    some = left.where(F.length("a") >= least).withColumn("pieces", lost + 1)
    size = F.floor(F.length("a") / F.col("pieces")).cast("int")
    cut = some.select("a", "pieces", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i")).where("size > 0")
    cut = cut.select("a", "size", (F.col("i") * F.col("size") + 1).alias("start"), F.expr("substring(a, i * size + 1, size)").alias("piece"))
    asked = cut.select("a", "piece", "size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("start") - lost), F.col("start") + lost)).alias("start"))
    sizes = cut.select("size").distinct()
    long_ = right.where(F.length("b") >= least).join(sizes, F.col("size") <= F.length("b"))
    stands = long_.select("b", "size", F.explode(F.sequence(F.lit(1), F.length("b") - F.col("size") + 1)).alias("start"))
    stands = stands.select("b", "size", "start", F.expr("substring(b, start, size)").alias("piece"))
    apart = asked.join(stands.hint("merge"), ["size", "start", "piece"]).where(~(short("a") & short("b"))).select("a", "b")
    pairs = met.unionByName(apart).distinct().where(can_reach(F.col("a"), F.col("b"), cutoff))
    return pairs.withColumn("ratio", ratio("a", "b")).where(F.col("ratio") >= cutoff)


def _grams(df: DataFrame, name: str, out: str, n: int = 2) -> DataFrame:
    """The different pairs of letters of each name, the ends marked."""
    padded = F.concat(F.lit("^"), F.col(out), F.lit("$"))
    at = F.sequence(F.lit(1), F.length(padded) - n + 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(padded, i, F.lit(n))))
    return df.select(F.col(name).alias(out)).withColumn("gram", F.explode(grams))


def close_matches(names: DataFrame, entries: DataFrame, cutoff: float = 0.88, n: int = 2) -> DataFrame:
    """name, entry, ratio, nth: the n closest of the different entries. names: name; entries: entry.

    Pairs come from shared pairs of letters, rare ones first: a ratio of cutoff leaves at most (1 - cutoff) of both
    texts unmatched, and each unmatched letter or break between blocks breaks two pairs, so of a name with g pairs a
    close one misses at most 2 * (1 - cutoff) * (a + b) + 2; only that many + 1 of its rarest pairs have to be looked up.
    """
    left, right = names.select("name").distinct(), entries.select("entry").distinct()
    count = _grams(right, "entry", "entry").groupBy("gram").agg(F.count("*").alias("df"))
    # b <= a * (2 / cutoff - 1), so the bound depends on the name alone.
    most = F.floor(2 * (1 - cutoff) * F.length("name") * (2 / cutoff)) + 3
    look = _grams(left, "name", "name").join(count, "gram", "left").withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("df", F.lit(0)), "gram"))).filter(F.col("nth") <= most)
    pairs = look.select("name", "gram").join(_grams(right, "entry", "entry"), "gram").select("name", "entry").distinct()
    pairs = pairs.filter(can_reach(F.col("name"), F.col("entry"), cutoff)).withColumn("ratio", ratio("name", "entry")).filter(F.col("ratio") >= cutoff)
    order = Window.partitionBy("name").orderBy(F.desc("ratio"), F.desc("entry"))
    return pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def merge_suggestions(names: DataFrame, cutoff: float = 0.85, limit: int = 60) -> DataFrame:
    """Pairs of different names that are close, the first by name; a report of at most limit."""
    pairs = close_matches(names, names.select(F.col("name").alias("entry")), cutoff, 1 << 20)
    return pairs.filter("name < entry").select("name", "entry", "ratio").orderBy("name", "entry").limit(limit)
