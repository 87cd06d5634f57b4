"""Cutting lineage by a table in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where a local session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = _OWN["dir"] = tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for forget() to know."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: lost executors cost no recomputation of what lies before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How many rows spread() gives a task at most, but for keys that many rows share.
PART_ROWS = 1 << 20


def parts(df: DataFrame) -> int:
    """How many parts df's rows need, at least the session's number for shuffles."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // PART_ROWS))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df parted by the columns, in as many parts as its rows need, at least the session's number for shuffles.

    Spark's own parts after a shuffle are of a number that doesn't grow, or are put together by their compressed bytes,
    which rows that are alike have few of; what a task sorts then grows with the table. df is counted first, so it
    should be a scan or stored.
    """
    return df.repartition(parts(df), *by)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "numbered") -> DataFrame:
    """rows with place (from 0) in their group by order, nulls first, and of, the number of rows in the group.

    All are sorted by range, so a large group lies in many partitions: a row's place is that in its partition and the
    counts before it. Rows that are equal in group and order come in any order among themselves. No window holds more
    than one row a partition.
    """
    by = F.coalesce(F.to_json(F.struct(*group)), F.lit("")) if group else F.lit("")
    keyed = stored(rows.withColumns({"_by": by, "_tie": F.monotonically_increasing_id()}), name)
    at = stored(keyed.repartitionByRange("_by", *order, "_tie").sortWithinPartitions("_by", *order, "_tie").withColumn("_at", F.monotonically_increasing_id()), name)
    at = at.withColumn("_part", F.shiftright("_at", 33))
    counts = at.groupBy("_by", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    whole = Window.partitionBy("_by")
    before = F.coalesce(F.sum("_held").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_by", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_held").over(whole).alias("of"))
    return at.join(counts, ["_by", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).select(*rows.columns, "place", "of")


def forget(spark: SparkSession) -> int:
    """Deletes what this process has stored so far; the number of tables. For when the results that need them are written."""
    done = 0
    while _WRITTEN:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return done
