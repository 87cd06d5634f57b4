"""Hard negatives for contrastive training, by a vector-approximation file.

A vector's components become whole numbers, floor(256 x); a row's score is its
inner product with an anchor. The positives of an anchor are the best rows of
its label. For each of them the hard negatives are the best rows of other labels
whose score lies between two shares of the positive's. Equal scores go by
vec_id, the smaller first.

The approximation file holds a byte a dimension: the cell that the component is
in. Cells hold about equally many rows (quantiles), and a table has the smallest
and largest component of each cell. Looked up there, a row's cells give a lower
and an upper bound of its score with an anchor: the smaller or larger end of
each cell, by the sign of the anchor's component. A scan of the file keeps, for
each anchor, the rows whose upper bound reaches the count-th largest lower bound
that the task has seen of rows that are surely in the window; the others can't
be among the best. Only rows kept get exact scores, by a join with the vectors,
and the best of those are the result, exactly.

Anchors are a stated share of the rows, so they go in blocks of about block
(fewer if vectors are long), each sent to the tasks and held against the whole file; no pair of rows is made
but those kept. Of rows with one label and vector only the first positives + 1
by vec_id enter the file: they have the same score with any anchor, so the
others can't be among the first. A group of copies thus costs no more than one.

Rows with a null label, a null vector, or a null, NaN or infinite component take
no part. Vectors may differ in length; the shorter is zero beyond its end, also
an empty one. A vec_id may repeat or be null: such rows are rows of their own,
an anchor is not a positive of itself, its copies are; a null vec_id is last
among equals and no anchor. Scores are exact up to 2^53; components beyond 2^40
or scores that may exceed it are an error. Other columns make no difference.
Without anchors, positives or negatives there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import stored

CELLS = 256
#: Components of a block of anchors at most, however long the vectors are: what is sent to the tasks is 32 MB.
_SENT = 1 << 22
#: Rows and anchors that are compared at once: some 30 MB of bounds.
_ROWS, _ANCHORS = 8192, 512


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """row (a number of its own), vec_id, label and q, the components as whole numbers, of the rows that take part."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    small = F.forall(value, lambda x: F.abs(x) < float(1 << 40))
    q = F.when(small, F.transform(value, lambda x: F.floor(x * 256))).otherwise(F.raise_error(F.lit("a component is beyond 2^40")).cast("array<long>"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("q")).withColumn("row", F.monotonically_increasing_id())


def first_of_copies(rows: DataFrame, most: int) -> DataFrame:
    """The first rows, by vec_id, of those with one label and vector."""
    copies = Window.partitionBy("label", "q").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    return rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= most).drop("copy")


class Cells:
    """For each dimension, the least and the greatest component of each cell."""

    def __init__(self, ends: np.ndarray):
        #: ends[d]: ascending upper ends of the cells, the last one the largest component of all; low[d] is where a cell begins.
        self.high = ends[:, 1:]
        self.low = np.concatenate([ends[:, :1], ends[:, 1:-1] + 1], axis=1)
        self.low = np.minimum(self.low, self.high)

    def of(self, q: np.ndarray) -> np.ndarray:
        """The cells of rows of components."""
        out = np.empty(q.shape, np.uint8)
        for d in range(q.shape[1]):
            out[:, d] = np.searchsorted(self.high[d], q[:, d])
        return out

    def ends(self, cells: np.ndarray, kind: type) -> np.ndarray:
        """Row by row the lower ends of all dimensions, then the upper ones."""
        d = np.arange(cells.shape[1])
        return np.concatenate([self.low[d, cells], self.high[d, cells]], axis=1).astype(kind)


def cells_of(rows: DataFrame) -> Cells:
    """Cells by quantiles: one aggregation, whose result has a row a dimension. The ends of the first and last cell are exact."""
    width = rows.agg(F.max(F.size("q"))).head()[0] or 0
    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))
    at = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    found = rows.select(F.posexplode(padded).alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.percentile_approx("x", at, 10_000).alias("b"), F.max("x").alias("c"))
    ends = np.zeros((width, CELLS + 1), np.int64)
    for r in found.collect():
        ends[r.d] = [r.a, *r.b, r.c]
    return Cells(ends)


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of the same width, zeros beyond the lists' ends."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def approximated(rows: DataFrame, cells) -> DataFrame:
    """The approximation file: row, label and the cells, a byte a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = cells.value
        width = len(found.low)
        for batch in batches:
            codes = found.of(_dense(batch.column("q"), width)).tobytes()
            held = pa.array([codes[i * width : (i + 1) * width] for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), held], names=["row", "label", "cells"])

    return rows.select("row", "label", "q").mapInArrow(run, "row long, label long, cells binary")


class Block:
    """A block of anchors with their windows of scores: a bounded number, so the driver and every task can hold it.

    An anchor without windows has one that is open, named by its own row.
    """

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        self.row, self.label = table.column("row").to_numpy(), table.column("label").to_numpy()
        self.q = _dense(table.column("q").chunk(0), width)
        self.windows = table.column("windows").to_pylist() if "windows" in table.column_names else None

    def sides(self, ends: Cells) -> tuple[np.ndarray, np.ndarray]:
        """What gives, times the ends of a row's cells, its lower and its upper bound. Exact: whole numbers within a float's or a double's digits."""
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        reach = max(np.abs(ends.low).max(initial=0), np.abs(ends.high).max(initial=0))
        size = float(np.abs(self.q).astype(float).sum(axis=1).max(initial=0)) * float(reach)
        if size >= 1 << 53:
            raise ValueError("scores may exceed 2^53")
        kind = np.float32 if size < 1 << 24 else np.float64
        return np.concatenate([up, down], axis=1).astype(kind), np.concatenate([down, up], axis=1).astype(kind)


class _Kept:
    """Rows that may be among the best count of one window, and what they have to reach."""

    __slots__ = ("lower", "row", "upper")

    def __init__(self):
        self.row = np.zeros(0, np.int64)
        self.lower = self.upper = np.zeros(0)

    def add(self, row: np.ndarray, lower: np.ndarray, upper: np.ndarray, count: int) -> None:
        """lower: -inf for rows that aren't surely in the window."""
        self.row, self.lower, self.upper = np.concatenate([self.row, row]), np.concatenate([self.lower, lower]), np.concatenate([self.upper, upper])
        if len(self.row) > count:
            reach = np.partition(self.lower, -count)[-count]
            keep = self.upper >= reach
            self.row, self.lower, self.upper = self.row[keep], self.lower[keep], self.upper[keep]


def scan(file: DataFrame, cells, block, count: int) -> DataFrame:
    """window and row, of the rows of the file that may be among the best count in a window of the block.

    Anchors without windows meet rows of their label but themselves, others rows of other labels.
    """

    def same_label(b: Block, kept: dict[int, _Kept], row: np.ndarray, label: np.ndarray, sides: tuple, ends: np.ndarray) -> None:
        for one in np.intersect1d(b.label, label):
            mine, theirs = np.flatnonzero(b.label == one), np.flatnonzero(label == one)
            for at in range(0, len(mine), _ANCHORS):
                some = mine[at : at + _ANCHORS]
                low, high = (side[some] @ ends[theirs].T for side in sides)
                for k, n in enumerate(some.tolist()):
                    good = np.flatnonzero(row[theirs] != b.row[n])
                    if len(good) > count:
                        good = good[high[k, good] >= np.partition(low[k, good], -count)[-count]]
                    kept[int(b.row[n])].add(row[theirs[good]], low[k, good], high[k, good], count)

    def other_labels(b: Block, kept: dict[int, _Kept], row: np.ndarray, label: np.ndarray, sides: tuple, ends: np.ndarray) -> None:
        least = np.array([min(w["least"] for w in ws) for ws in b.windows])
        most = np.array([max(w["most"] for w in ws) for ws in b.windows])
        for at in range(0, len(b.row), _ANCHORS):
            some = slice(at, at + _ANCHORS)
            low, high = (side[some] @ ends.T for side in sides)
            where, good = np.nonzero((high >= least[some, None]) & (low <= most[some, None]) & (label[None, :] != b.label[some, None]))
            begin = np.searchsorted(where, np.arange(len(low) + 1))
            for k in np.flatnonzero(np.diff(begin)).tolist():
                found = good[begin[k] : begin[k + 1]]
                lower, upper = low[k, found].astype(float), high[k, found].astype(float)
                for w in b.windows[at + k]:
                    inside = np.flatnonzero((upper >= w["least"]) & (lower <= w["most"]))
                    if len(inside):
                        l, u = lower[inside], upper[inside]
                        sure = (l >= w["least"]) & (u <= w["most"])
                        kept[w["window"]].add(row[found[inside]], np.where(sure, l, -np.inf), np.minimum(u, w["most"]), count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, b = cells.value, block.value
        sides = b.sides(table)
        names = b.row.tolist() if b.windows is None else [w["window"] for ws in b.windows for w in ws]
        kept = {n: _Kept() for n in names}
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                codes = np.frombuffer(b"".join(piece.column("cells").to_pylist()), np.uint8).reshape(piece.num_rows, len(table.low))
                add = same_label if b.windows is None else other_labels
                add(b, kept, piece.column("row").to_numpy(), piece.column("label").to_numpy(), sides, table.ends(codes, sides[0].dtype))
        found = [(np.full(len(k.row), n, np.int64), k.row) for n, k in kept.items() if len(k.row)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["window", "row"])

    return file.mapInArrow(run, "window long, row long")


def exact(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (anchor, row, ...) with the vec_id of row and the exact score."""
    theirs = rows.select("row", "vec_id", "q")
    anchors = rows.select(F.col("row").alias("anchor"), F.col("q").alias("anchor_q"))
    products = F.zip_with("q", "anchor_q", lambda x, y: F.coalesce(x * y, F.lit(0)))
    score = F.aggregate(products, F.lit(0).cast("long"), lambda a, b: a + b)
    return pairs.join(theirs, "row").join(anchors, "anchor").withColumn("score", score).drop("q", "anchor_q")


def _best(scored: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def candidates(anchors: DataFrame, file: DataFrame, cells, width: int, count: int, block: int, name: str) -> DataFrame:
    """window and row for all anchors (row, label, q and, if they have some, windows), from one scan of the file a block."""
    spark = file.sparkSession
    blocks = -(-anchors.count() // block)
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))), name)
    out = spark.createDataFrame([], "window long, row long")
    for n in range(blocks):
        table = anchors.where(F.col("block") == n).drop("block").toArrow()
        if table.num_rows:
            sent = spark.sparkContext.broadcast(Block(table, width))
            out = out.unionByName(stored(scan(file, cells, sent, count), name))
            sent.unpersist()
    return out


def mine(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = 8192) -> DataFrame:
    """For each anchor and positive the first negatives with least to most hundredths of the positive's score.

    vectors: vec_id, embedding, label; anchor: whether a row is one; label: the
    label that counts. anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; and anchor_row, positive_row, negative_row, numbers that tell
    rows with one vec_id apart.
    """
    rows = stored(prepared(vectors, label).withColumn("is_anchor", F.coalesce(anchor, F.lit(False))), "vectors")
    few = stored(first_of_copies(rows.drop("is_anchor"), max(positives + 1, negatives)), "vectors-few")
    anchors = rows.where("is_anchor")
    spark = vectors.sparkSession
    found = cells_of(few)
    width = len(found.low)
    cells = spark.sparkContext.broadcast(found)
    block = max(1, min(block, _SENT // max(width, 1)))
    file = stored(approximated(few, cells), "approximation")

    pairs = candidates(anchors.select("row", "label", "q"), file, cells, width, positives, block, "positive-candidates").withColumnRenamed("window", "anchor")
    every = few.select("row", "vec_id", "q").unionByName(anchors.join(few.select("row"), "row", "left_anti").select("row", "vec_id", "q"))
    best = _best(exact(pairs, every), ["anchor"], positives)
    best = stored(best.withColumn("window", F.monotonically_increasing_id()).select("window", "anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # 100 * score >= least * positive's, and <= most * positive's, in whole numbers.
    low, high = F.expr(f"-floor(-({least} * cast(positive_score as decimal(30,0))) / 100)"), F.expr(f"floor({most} * cast(positive_score as decimal(30,0)) / 100)")
    windows = stored(best.select("window", "anchor", low.cast("long").alias("least"), high.cast("long").alias("most")).where("least <= most"), "windows")
    per_anchor = windows.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("window", "least", "most"))).alias("windows"))  # at most positives
    pairs = candidates(anchors.select("row", "label", "q").join(per_anchor, "row"), file, cells, width, negatives, block, "negative-candidates")
    pairs = pairs.join(windows, "window")
    scored = exact(pairs, every).where(F.col("score").between(F.col("least"), F.col("most")))
    ranked = _best(scored, ["window"], negatives).select("window", "rank", F.col("row").alias("negative_row"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        ranked.join(best, "window")
        .join(named, "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("anchor").alias("anchor_row"), F.col("positive").alias("positive_row"), "negative_row")
    )


def mine_every_50th(vectors: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7 the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    found = mine(vectors, F.col("vec_id") % 50 == 0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
, positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
, negatives AS (SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
