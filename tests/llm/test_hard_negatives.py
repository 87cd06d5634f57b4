"""Hard negatives against all scores computed one by one, and against their SQL."""

import collections
import math
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from cadastra.llm import hard_negatives  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, row string, q int, score string"


def brute(rows, positives=5, negatives=3):
    """Rows are told apart by their place."""
    kept = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    key = lambda m: (-m[0], m[1] is None, m[1] or 0)
    for i, (vec_id, label, q) in enumerate(kept):
        if vec_id is None or vec_id % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, o[2])), o[0], o[1]) for j, o in enumerate(kept) if j != i]
        for score, positive, _ in sorted((m for m in scored if m[2] == label), key=key)[:positives]:
            fits = sorted((m for m in scored if m[2] != label and 50 * score <= 100 * m[0] <= 95 * score), key=key)
            out += [(vec_id, positive, k + 1, m[1], score, m[0]) for k, m in enumerate(fits[:negatives])]
    return collections.Counter(out)


def table(n, dims, seed, spread=0.3, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        rows.append((i, [struct_float(c + rng.gauss(0, spread / 3)) for c in centres[label]], label if i % 11 else rng.randrange(10), "a", 1, "b"))
    return rows


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def found(spark, rows):
    return hard_negatives.mine_every_50th(spark.createDataFrame(rows, SCHEMA).repartition(4))


@pytest.mark.parametrize("n, dims, spread", [(400, 8, 0.3), (300, 3, 4.0), (300, 20, 3000.0)])
def test_against_all_scores(spark, n, dims, spread):
    rows = table(n, dims, n + dims, spread)
    got = found(spark, rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and dict(got.dtypes)["rank"] == "int"
    want = brute(rows)
    assert len(want) > 5 and collections.Counter(map(tuple, got.collect())) == want


def test_awkward_rows(spark):
    rows = table(200, 4, 3)
    rows[50] = (50, [1.0, 1.0, 1.0, 1.0], 3, "a", 1, "b")
    rows[100] = (100, [0.0] * 4, 3, "a", 1, "b")  # all scores are 0
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0], 3, "a", 1, "b") for i in range(40)]  # copies with and without its label
    rows += [(400 + i, [0.5, 1.0, 0.5, 1.0], 5, "a", 1, "b") for i in range(40)]
    rows += [rows[50], rows[3], (50, [0.5, 0.5, 0.5, 0.5], 3, None, None, None)]  # rows that repeat an id
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 3, None, None, None), (None, [0.8] * 4, 2, None, None, None), (550, None, 3, None, None, None), (600, [1.0] * 4, None, None, None, None)]
    rows += [(650, [math.nan, 1.0, 1.0, 1.0], 3, None, None, None), (700, [None, 1.0, 1.0, 1.0], 3, None, None, None), (750, [math.inf, 1.0, 1.0, 1.0], 3, None, None, None)]
    rows += [(800, [1.0, 0.9], 3, None, None, None), (850, [], 3, None, None, None), (801, [1.0, 0.9, 0.1, 0.1, 0.7], 3, None, None, None), (802, [0.75, 0.6], 4, None, None, None)]
    assert collections.Counter(map(tuple, found(spark, rows).collect())) == brute(rows)


def test_small_blocks_copies_and_nothing(spark, monkeypatch):
    rows = table(300, 6, 9)
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = collections.Counter(map(tuple, hard_negatives.mine_every_50th(frame).collect()))
    monkeypatch.setattr(hard_negatives, "_ROWS", 37)
    monkeypatch.setattr(hard_negatives.mine, "__defaults__", (5, 3, 50, 95, 2))
    assert collections.Counter(map(tuple, hard_negatives.mine_every_50th(frame).collect())) == whole == brute(rows)
    assert hard_negatives.mine_every_50th(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives.mine_every_50th(frame.where("vec_id % 50 != 0")).count() == 0
    few = hard_negatives.first_of_copies(hard_negatives.prepared(spark.createDataFrame([(i, [1.0], 1, None, None, None) for i in range(5000)], SCHEMA), F.col("label")), 6)
    assert sorted(r.vec_id for r in few.collect()) == list(range(6))
    with pytest.raises(Exception, match="2.53"):
        hard_negatives.mine_every_50th(spark.createDataFrame([(i, [1e7, 1e7], i % 2, None, None, None) for i in range(60)], SCHEMA)).count()


def test_sql_twin(spark):
    import duckdb

    path = "/root/testdata/sf0.01/embeddings.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}'")
    want = collections.Counter(duckdb.sql(hard_negatives.ORACLE).fetchall())
    assert collections.Counter(map(tuple, hard_negatives.mine_every_50th(spark.read.parquet(path)).collect())) == want and len(want) > 20
