"""Exact dedup by an extendible-hash index on shared files.

Each distinct normalised text is an entry under a 64-bit key. The top bits of
the key pick a pointer of the directory; a bucket that holds more entries than
its capacity is split on its next bit, and where its depth is that of the
directory, the directory doubles. Buckets are dealt to owner tasks by ranges of
pointers of 16 bits; a pointer that is overfull by itself is split further by
its owner, as deep as its entries ask for. All rows of a text come to the owner
of its bucket, who chains the entries that share a key, compares their bytes,
and finds the row that stays and the number of rows. What comes is combined on
the way, so a text with very many copies comes once for each batch of rows.

The index is one file an owner, in order of buckets. Rows look their entry up
by key and SHA-256, which names the entry of a chain whose bytes were compared.

Nulls count as empty texts. Of the same texts the row with most code points
stays, then the one with the smallest id (a null id comes last); of rows that
agree in both, one stays. A text of any length is compared as a whole, and is
held as a whole by its owner. An empty table gives an empty result. Other
columns are neither read nor returned; drop_copies() keeps all, whatever their
names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import WHITE, stored, text_bytes, tidied

#: Bits of the pointers that the driver and every task hold: 65,536 of them, whatever the input's size.
TOP = 16
_SENT = "owner int, key long, norm string, keep_id long, best_chars int, group_size long"
_INDEX = "bucket string, depth int, key long, chain int, sha string, keep_id long, best_chars int, group_size long"


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, key, norm, n_chars."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.regexp_replace(text, WHITE + "+", "").alias("norm"), F.length(text).alias("n_chars"))
    return rows.select("doc_id", F.xxhash64("norm").alias("key"), "norm", "n_chars")


def split_directory(counts: dict[int, int], capacity: int, bits: int) -> list[tuple[int, int]]:
    """(first pointer, pointers) of each bucket, from the entries under each pointer of so many bits.

    Starts from one bucket; an overfull bucket splits in two, down to a single pointer.
    """
    starts = sorted(counts)
    upto = [0]
    for p in starts:
        upto.append(upto[-1] + counts[p])
    held = lambda a, b: upto[bisect.bisect_left(starts, b)] - upto[bisect.bisect_left(starts, a)]
    done, open_ = [], [(0, 1 << bits)]
    while open_:
        first, width = open_.pop()
        if held(first, first + width) > capacity and width > 1:
            open_ += [(first, width // 2), (first + width // 2, width // 2)]
        else:
            done.append((first, width))
    return sorted(done)


def split_keys(keys: np.ndarray, capacity: int, depth: int) -> np.ndarray:
    """The depth of each key's bucket, below a bucket of that depth that holds them all. keys: ascending, unsigned."""
    out, open_ = np.full(len(keys), depth), [(0, len(keys), depth)]
    while open_:
        a, b, d = open_.pop()
        if b - a <= capacity or d == 64:
            out[a:b] = d
            continue
        bit = np.uint64(63 - d)
        middle = a + int(np.searchsorted((keys[a:b] >> bit) & np.uint64(1), 1))
        open_ += [(a, middle, d + 1), (middle, b, d + 1)]
    return out


def _chained(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row for each text, with its number in the chain of its key, in order of keys. Texts are compared only where a key comes twice."""
    key = rows.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    if new.all():
        return rows.take(pa.array(order)), np.zeros(len(key), np.int64)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(key)]]))
    keep, chain = [order[first]], [np.zeros(len(first), np.int64)]
    ids, best, count = (rows.column(c).to_pylist() for c in ("keep_id", "best_chars", "group_size"))
    norm = rows.column("norm")
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        entries: dict[str, int] = {}
        for r in order[a : a + n].tolist():
            e = entries.setdefault(norm[r].as_py(), r)
            if e != r:
                count[e] += count[r]
                if (-best[r], ids[r] is None, ids[r] or 0) < (-best[e], ids[e] is None, ids[e] or 0):
                    best[e], ids[e] = best[r], ids[r]
        more = list(entries.values())[1:]
        keep.append(np.array(more, np.int64)), chain.append(np.arange(1, len(entries)))
    keep, chain = np.concatenate(keep), np.concatenate(chain)
    again = np.lexsort((chain, rows.column("key").to_numpy()[keep]))
    keep, chain = keep[again], chain[again]
    columns = {"keep_id": pa.array(ids, pa.int64()), "best_chars": pa.array(best, pa.int32()), "group_size": pa.array(count, pa.int64())}
    merged = pa.RecordBatch.from_arrays([columns.get(c, rows.column(c)) for c in rows.schema.names], rows.schema.names)
    return merged.take(pa.array(keep)), chain


def build_index(docs: DataFrame, capacity: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The rows' metadata and the index's entries, both on shared files.

    rows: doc_id, n_chars, key, sha. entries: bucket (its bits), depth, key, chain, sha, keep_id, best_chars, group_size.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = normalised(docs)
    meta = stored(rows.select("doc_id", "n_chars", "key", F.sha2("norm", 256).alias("sha")), "dedup-rows")
    pointer = F.shiftrightunsigned("key", 64 - TOP).cast("int")
    counts = {r["p"]: r["n"] for r in meta.groupBy(pointer.alias("p")).agg(F.count_distinct("key").alias("n")).collect()}
    buckets = split_directory(counts, capacity, TOP)
    depth_of = np.zeros(1 << TOP, np.int64)
    for first, width in buckets:
        depth_of[first : first + width] = TOP - (width.bit_length() - 1)
    total, before, table = max(1, sum(counts.values())), 0, []
    for first, width in buckets:
        inside = [p for p in range(first, first + width) if p in counts]
        table += [(p, before * owners // total) for p in inside]
        before += sum(counts[p] for p in inside)
    directory = F.broadcast(spark.createDataFrame(table, "pointer int, owner int"))  # 2^TOP rows at most

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _chained(batch)[0]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of keys. Entries are held to the end of their pointer, without their texts."""
        carry: pa.RecordBatch | None = None
        held: list[tuple] = []

        def placed() -> pa.RecordBatch:
            keys = np.array([h[0] for h in held], np.int64).view(np.uint64)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            depth = split_keys(keys, capacity, int(depth_of[int(keys[0] >> np.uint64(64 - TOP))]))
            rows = [held[i] for i in order.tolist()]
            names = [format(int(k), "064b")[:d] for k, d in zip(keys.tolist(), depth.tolist(), strict=True)]
            held.clear()
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(depth, pa.int32()), *columns], [c.split()[0] for c in _INDEX.split(", ")])

        def taken(some: pa.RecordBatch, chain: np.ndarray) -> Iterator[pa.RecordBatch]:
            data, offsets = text_bytes(some.column("norm"))
            view = memoryview(np.ascontiguousarray(data))
            for i, (k, c, keep, best, n) in enumerate(zip(some.column("key").to_pylist(), chain.tolist(), *(some.column(c).to_pylist() for c in ("keep_id", "best_chars", "group_size")), strict=True)):
                if held and (held[0][0] ^ k) >> (64 - TOP):
                    yield placed()
                held.append((k, c, hashlib.sha256(view[offsets[i] : offsets[i + 1]]).hexdigest(), keep, best, n))

        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            rows, chain = _chained(batch)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            carry = rows.slice(cut)
            yield from taken(rows.slice(0, cut), chain[:cut])
        if carry is not None:
            yield from taken(*_chained(carry))
        if held:
            yield placed()

    sent = rows.withColumn("pointer", pointer).join(directory, "pointer").select("owner", "key", "norm", F.col("doc_id").cast("long").alias("keep_id"), F.col("n_chars").alias("best_chars"), F.lit(1).cast("long").alias("group_size"))
    dealt = sent.mapInArrow(tidied(combine), _SENT).repartitionById(owners, F.col("owner")).sortWithinPartitions("key")
    return meta, stored(dealt.mapInArrow(tidied(own), _INDEX), "dedup-index")


def exact_dedup(docs: DataFrame, capacity: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too."""
    meta, entries = build_index(docs, capacity)
    found = meta.join(entries.select("key", "sha", "keep_id", "best_chars", "group_size"), ["key", "sha"])
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best_chars"))
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    # Only rows equal to the one that stays can tie with it; the rest needs no window.
    ties = found.filter(first).withColumn("kept", F.row_number().over(Window.partitionBy("key", "sha").orderBy("doc_id")) == 1)
    return ties.select(*out).unionByName(found.filter(~first).withColumn("kept", F.lit(False)).select(*out))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    text = F.coalesce("text", F.lit(""))
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d_id"), F.sha2(F.regexp_replace(text, WHITE + "+", ""), 256).alias("d_sha"), F.length(text).alias("d_chars"))
    hit = packed.join(kept, F.col("d_id").eqNullSafe(F.col("k_id")) & (F.col("d_sha") == F.col("k_sha")), "left_semi")
    # Rows that agree in id and text: one, with most code points.
    return hit.groupBy("d_id", "d_sha").agg(F.max_by("row", "d_chars").alias("row")).select("row.*")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s
  FROM documents),
r AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY c DESC, doc_id) AS k, count(*) OVER (PARTITION BY s) AS g,
    first_value(doc_id) OVER (PARTITION BY s ORDER BY c DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, g AS group_size, k = 1 AS kept, s AS text_sha256 FROM r
"""
