"""Places in an order that doesn't depend on how rows lie in partitions, and ties."""

import pytest
from pyspark.sql import functions as F

from cadastra.operators import textflow, views


@pytest.mark.parametrize("names", [1_000_000, 7])
def test_places_count_each_row_once(spark, names):
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        wide = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat("id", i.cast("string")), 256)), "")
        rows = spark.range(4000).select(F.col("id").cast("string")).select("id", F.concat(F.lit("N"), F.lpad((F.col("id").cast("int") % names).cast("string"), 6, "0")).alias("name"), wide.alias("wide"))
        got = [(int(r.id), r.nth) for r in views.locale_ordered(rows, F.col("name"), ["id"]).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted(range(4000), key=lambda i: (i % names, str(i)))
    assert sorted(got, key=lambda r: r[1]) == [(i, nth) for nth, i in enumerate(order, 1)]


def test_blocks_at_one_height_go_by_their_text(spark):
    rows = [(1, 3.0, 5.0, "b"), (1, 1.0, 5.0, "c"), (1, 2.0, 5.0, "a"), (1, 90.0, 1.0, "z"), (1, 0.0, 9.0, "d")]
    for order in (rows, rows[::-1]):
        blocks = spark.createDataFrame(order, "page int, x0 double, y0 double, text string").coalesce(1)
        got = textflow.column_lines(blocks, 100.0)
        assert [(r.nth, r.line) for r in got.orderBy("nth").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "z")]
