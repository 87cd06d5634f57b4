"""Document fingerprints from closed syncmers.

A k-mer of the UTF-8 bytes is an anchor where the smallest hash of its inner
s-mers is that of the first or the last one. Whether it is depends on the k-mer
alone, so two texts that share a passage share its anchors, wherever it stands
and whatever is around it; anchors() returns them with their positions.

A fingerprint keeps, for each of 64 ranges of anchor hashes, 16 bits of the
smallest and the byte where that anchor first stands: 12 hexadecimal digits a
range, dashes for a range without an anchor. Two fingerprints are matched by
position: an anchor that both have counts if it stands at the same place in
both, or if another common anchor lies as far from its own place, by 64 bytes at
most. So a passage counts wherever it was moved to, and anchors that agree by
chance don't. The likeness is the share of ranges that count among those that
either one fills; 1 for two fingerprints without any anchor, so for two empty
texts.

Null counts as empty. A text without an anchor, such as one shorter than k, is
one anchor as a whole. Rows with the same id come in order of their texts, null
ids last; of an anchor's places the first counts. A text of any length is read
whole and held as a whole. An empty table gives an empty result; columns other
than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import Rolling, mix64, slices, text_bytes

K, S = 16, 9
BINS = 64
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row, by the first."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def syncmers(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in data, hash) of the anchors of all texts; one for a text that has none and isn't empty."""
    n, length = len(offsets) - 1, np.diff(offsets)
    rolling = Rolling(data)
    row = at = np.zeros(0, np.int64)
    value = np.zeros(0, np.uint64)
    if len(data) >= k:
        inner = rolling.every(s)
        least = sliding_min(inner, k - s + 1)
        found = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
        row = np.searchsorted(offsets, found, "right") - 1
        inside = found + k <= offsets[row + 1]
        row, at = row[inside], found[inside]
        value = rolling.spans(at, at + k)
    none = np.flatnonzero((np.bincount(row, minlength=n) == 0) & (length > 0))
    if len(none):
        row, at = np.concatenate([row, none]), np.concatenate([at, offsets[none]])
        value = np.concatenate([value, rolling.spans(offsets[none], offsets[none + 1])])
    return row, at, value


def sketches(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> np.ndarray:
    """The fingerprints: (texts, BINS, 2) numbers, an anchor's 16 bits and its place; 65536 and 0 in a range without an anchor."""
    n = len(offsets) - 1
    row, at, value = syncmers(data, offsets, k, s)
    value = mix64(value)
    least = np.full(n * BINS, _NONE, np.uint64)
    own = row * BINS + (value >> np.uint64(58)).astype(np.int64)
    np.minimum.at(least, own, value)
    hit = np.flatnonzero(value == least[own])
    place = np.full(n * BINS, 1 << 32, np.int64)
    np.minimum.at(place, own[hit], at[hit] - offsets[row[hit]])
    none = least == _NONE
    return np.stack([np.where(none, 1 << 16, (mix64(least) >> np.uint64(48)).astype(np.int64)), np.where(none, 0, place)], 1).reshape(n, BINS, 2)


def as_text(sketch: np.ndarray) -> list[str]:
    wide = BINS * 12
    digits = np.concatenate([sketch[:, :, :1].astype(">u2").view(np.uint8), sketch[:, :, 1:].astype(">u4").view(np.uint8)], 2).tobytes().hex()
    out = [digits[i * wide : (i + 1) * wide] for i in range(len(sketch))]
    for i in np.flatnonzero((sketch[:, :, 0] == 1 << 16).any(1)).tolist():
        out[i] = "".join("-" * 12 if v == 1 << 16 else out[i][12 * j : 12 * j + 12] for j, v in enumerate(sketch[i, :, 0].tolist()))
    return out


def likeness(a: np.ndarray, b: np.ndarray, slack: int = 64) -> np.ndarray:
    some = (a[:, :, 0] != 1 << 16) | (b[:, :, 0] != 1 << 16)
    total = some.sum(1)
    # What isn't common lies apart from all else.
    apart = (1 << 40) + np.arange(BINS) * (1 << 34)
    way = np.sort(np.where((a[:, :, 0] == b[:, :, 0]) & some, a[:, :, 1] - b[:, :, 1], apart), 1)
    close = np.diff(way, axis=1) <= slack
    beside = np.zeros(way.shape, bool)
    beside[:, 1:] |= close
    beside[:, :-1] |= close
    return np.where(total == 0, 1.0, (beside | (way == 0)).sum(1) / np.maximum(total, 1))


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, position (in bytes), anchor: every anchor of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                row, at, value = syncmers(data, offsets, k, s)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(at - offsets[row]), pa.array(value.view(np.int64))], ["doc_id", "position", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, position long, anchor long")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, text, tail: in each bucket a run of documents by descending id, in order within a partition.

    The last row of a bucket (tail) is the first document of the next one, of the first one after the last.
    Buckets are cut at quantiles of the ids; only their bounds pass through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = 3 * parts
    bounds = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 100 * wanted).alias("b")).first()["b"]
    cuts = np.unique(np.array(bounds or [], np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        place = len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy().astype(np.int64))
        return pd.Series(np.where(known, place, len(cuts) + 1), dtype="int32")

    ids = rows.select("doc_id").withColumn("bucket", bucket("doc_id"))
    first = ids.groupBy("bucket").agg(F.max("doc_id").alias("first"))
    heads = first.collect()  # one row a bucket
    order = sorted(r["bucket"] for r in heads)
    before = [(b, order[i - 1]) for i, b in enumerate(order)]
    rows = rows.withColumn("bucket", bucket("doc_id"))
    if not order:
        return rows.withColumn("tail", F.lit(False))
    top = spark.createDataFrame([(r["bucket"], r["first"]) for r in heads], "bucket int, first long").join(spark.createDataFrame(before, "bucket int, to int"), "bucket")
    tails = rows.filter(F.col("doc_id").isNull() | F.col("doc_id").isin([r["first"] for r in heads if r["first"] is not None]))
    tails = tails.join(F.broadcast(top), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    tails = tails.groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    tails = tails.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("tail"))
    every = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    return every.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of which the last row opens the next piece too."""
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                if last is not None:
                    part = pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0]
                yield part
                last = part.slice(part.num_rows - 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            own = np.flatnonzero(~part.column("tail").to_numpy(zero_copy_only=False)[:-1])
            if not len(own):
                continue
            texts = part.column("text").to_pylist()
            sketch = sketches(*text_bytes(part.column("text")), k, s)
            edited, n_chars = [], []
            for i in own.tolist():
                a, m = texts[i], len(texts[i]) // 3
                n_chars.append(len(a))
                edited.append((a[: len(a) - m] + texts[i + 1][:m]).encode())
            other = sketches(*text_bytes(pa.array(edited, pa.binary()).cast(pa.large_binary()).view(pa.large_utf8())), k, s)
            mine = sketch[own]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(own)), pa.array(n_chars, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array(as_text(mine)), pa.array(as_text(other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, sketch[own + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs).mapInArrow(each, SCHEMA)
