"""Substring dedup by sparse suffix arrays in a logarithmic index family.

A byte goes where a string of length bytes (50) that covers it also starts in a
document with a smaller id. Suffixes are taken where the content says so: in
each window of length bytes, at the 24-mer with the smallest hash, its anchor.
Equal windows have equal anchors, so every match is found from an anchor, and
about one suffix in fourteen is kept. The windows with one anchor in a row are
a segment, of 76 bytes at most.

1. The texts are stored once, compressed, in pieces of some MB, with the places
   of their anchors. The table is bucketed by piece, so what later comes back to
   a piece is all that moves.
2. The anchors that only one document has can't match. Each piece sends the
   names (32 bits in one of the parts) of its anchors, and gets a bit for each.
3. The other suffixes go to the part of their anchor, with the bytes of their
   segment. A piece's share in a part is a batch: its suffixes in the order of
   their bytes from the anchor on, which is a suffix array. The part merge-scans
   the batch against the levels that it holds, finds equal segments and adds
   the rest as a level; levels of like size merge, so there are logarithmically
   many. At the end all are one array, and where neighbours share their anchor
   and enough bytes to both sides, their windows are compared one by one.
4. Spans go back to the piece, which cuts them out.

All matches are of bytes; hashes only deal the work out.

What a piece sees to be a copy of a segment of its own is settled there, so a
passage in a third of all documents reaches a part once for each piece. An
anchor with more than HOT different segments in one piece is hot: its windows
are dealt by their own bytes in a second round, and its part sends there what
it got of it from other pieces, so no part gathers a hot anchor's segments.
Rows that are dealt hold a piece's share of a part, as a shuffle's blocks do.

Null texts are empty. A null id comes after all others and before none. Rows
that share an id don't match each other; of rows tied with the smallest id all
keep what they have. Other columns are neither read nor returned. An empty table
gives an empty result. A text is never cut: one that is longer than a piece is
a piece alone and is held as a whole in one task, with about 60 bytes for each
of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import Rolling, mix64, new_path, slices, stored, text_bytes
from cadastra.llm.fingerprints import sliding_min

LENGTH, ANCHOR = 50, 24
SIDE = LENGTH - ANCHOR  # bytes of a window on either side of its anchor, together
#: A suffix's bytes: the anchor, what follows it and (backwards) what stands before it, padded, and the lengths of both.
WIDTH = ANCHOR + 2 * SIDE + 2
HOT = 256
_AT = np.uint64((1 << 28) - 1)
_LAST = np.int64(2**63 - 1)
_PIECE = 4 << 20
_BLOCK = 1 << 18
_SUFFIX, _WINDOW, _HOT, _SPAN = range(4)
_BLOB = "piece long, ids binary, known binary, size binary, n_anchors binary, runs binary, text binary"
_ROWS = "what int, part int, piece long, docs binary, doc binary, start binary, keys binary"


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, windows and bytes before it of every anchor: the windows that have it, and how far it stands behind the first one's start.

    A row's anchors come in order and every window has one, so these numbers give their places.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none
    gram = Rolling(data).every(ANCHOR)
    least = sliding_min((gram & ~_AT) | np.arange(len(gram), dtype=np.uint64), SIDE + 1)
    end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    window = np.flatnonzero(np.arange(n) + LENGTH <= end)
    if not len(window):
        return none, none, none
    at = (least[window] & _AT).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.concatenate([first, [len(at)]]))
    return np.searchsorted(offsets, at[first], "right") - 1, count, at[first] - window[first]


def _frame(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], list(names))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}


def pieces(docs: DataFrame, buckets: int, piece_bytes: int = _PIECE) -> DataFrame:
    """The texts in pieces of whole rows, stored in the shared folder in buckets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, number = zstandard.ZstdCompressor(level=1), 0
        held: list[tuple[np.ndarray, ...]] = []

        def made(part: int) -> pa.RecordBatch:
            ids, known, size, n_anchors, count, before, text = (np.concatenate([h[i] for h in held]) for i in range(7))
            runs = squeeze.compress(np.concatenate([count, before]).astype(np.uint8).tobytes())
            held.clear()
            return _frame(_BLOB, [((part << 32) + number, ids.tobytes(), known.tobytes(), size.astype(np.uint32).tobytes(), n_anchors.astype(np.uint32).tobytes(), runs, squeeze.compress(text.tobytes()))])

        part = 0
        for batch in batches:
            for rows in slices(batch, "text", min(piece_bytes, 1 << 20)):
                part = rows.column("part")[0].as_py()
                data, offsets = text_bytes(rows.column("text"))
                row, count, before = anchors(data, offsets)
                ids = rows.column("doc_id")
                if held and sum(len(h[6]) for h in held) + len(data) > piece_bytes:
                    yield made(part)
                    number += 1
                held.append((ids.fill_null(int(_LAST)).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), np.bincount(row, minlength=rows.num_rows), count, before, data))
        if held:
            yield made(part)

    text = F.coalesce("text", F.lit(""))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.spark_partition_id().cast("long").alias("part")).mapInArrow(each, _BLOB)
    spark, name = docs.sparkSession, f"suffix_pieces_{uuid.uuid4().hex}"
    made.write.bucketBy(buckets, "piece").option("path", new_path(spark, "suffix-pieces")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the files are the shared folder's
    return out


def _names(anchor: np.ndarray, parts: int) -> np.ndarray:
    """For each anchor (a row of bytes) its part, and 32 bits of it in the lower half."""
    words = anchor.view(np.uint64)
    h = mix64(words[:, 0] ^ mix64(words[:, 1] ^ mix64(words[:, 2] + np.uint64(0x9E3779B97F4A7C15))))
    return ((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


class Piece:
    """A stored piece at work: its bytes, and row, start (of the segment), place, bytes before and after it of each anchor."""

    def __init__(self, blob: dict):
        self.text = np.frombuffer(zstandard.decompress(blob["text"]), np.uint8) if blob["text"] else np.zeros(0, np.uint8)
        self.ids = np.frombuffer(blob["ids"], np.int64)
        size = np.frombuffer(blob["size"], np.uint32).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        own = np.frombuffer(blob["n_anchors"], np.uint32).astype(np.int64)
        count, before = np.frombuffer(zstandard.decompress(blob["runs"]), np.uint8).astype(np.int64).reshape(2, -1) if own.sum() else np.zeros((2, 0), np.int64)
        self.row = np.repeat(np.arange(len(size)), own)
        ends = np.cumsum(count)
        base = np.concatenate([[0], ends])[np.cumsum(own) - own]
        self.first = ends - count - base[self.row]  # in the row
        self.before, self.after = before, count - 1 + SIDE - before
        self.at = self.offsets[self.row] + self.first + before

    def names(self, parts: int) -> np.ndarray:
        """For each anchor its part, and 32 bits of it in the lower half."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        return _names(np.lib.stride_tricks.sliding_window_view(self.text, ANCHOR)[self.at].copy(), parts)

    def keys(self, own: np.ndarray) -> np.ndarray:
        """The suffixes' bytes of the anchors own."""
        text = np.concatenate([np.zeros(SIDE, np.uint8), self.text, np.zeros(SIDE, np.uint8)])
        out = np.empty((len(own), WIDTH), np.uint8)
        around = np.lib.stride_tricks.sliding_window_view(text, ANCHOR + 2 * SIDE)[self.at[own]]
        out[:, : ANCHOR + SIDE], out[:, ANCHOR + SIDE : -2] = around[:, SIDE:], around[:, SIDE - 1 :: -1]
        reach = np.arange(SIDE)
        out[:, ANCHOR : ANCHOR + SIDE][reach >= self.after[own, None]] = 0
        out[:, ANCHOR + SIDE : -2][reach >= self.before[own, None]] = 0
        out[:, -2], out[:, -1] = self.before[own], self.after[own]
        return out.reshape(-1).view(f"S{WIDTH}")


@dataclass
class Suffixes:
    """A suffix array: the bytes of each (keys, in their order), the document's id, its piece and row there, where the segment starts, and how far it comes again and again.

    extra: equal segments of one document that start at most LENGTH bytes apart are one entry, since all their windows go or stay together; it is the way from the first start to the last.
    """

    keys: np.ndarray
    id: np.ndarray
    piece: np.ndarray
    row: np.ndarray
    start: np.ndarray
    extra: np.ndarray

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, f.name)[at] for f in fields(self)))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Suffixes)))

    def bytes(self) -> np.ndarray:
        return self.keys.view(np.uint8).reshape(-1, WIDTH)

    def ends(self) -> np.ndarray:
        raw = self.bytes()
        return self.start.astype(np.int64) + raw[:, -2] + raw[:, -1] + ANCHOR + self.extra

    def ordered(self) -> Suffixes:
        """By bytes. Two sorted runs are merged in one go."""
        return self.take(np.argsort(self.keys, kind="stable"))

    def collapsed(self) -> Suffixes:
        """Segments that a document repeats at once, as a run of one character has them, as one. In order of keys, then of rows and starts; one piece's."""
        if not len(self.keys):
            return self
        start = self.start.astype(np.int64)
        new = np.concatenate([[True], (self.keys[1:] != self.keys[:-1]) | (self.row[1:] != self.row[:-1]) | (start[1:] - start[:-1] > LENGTH)])
        first = np.flatnonzero(new)
        out = self.take(first)
        out.extra = (start[np.concatenate([first[1:], [len(start)]]) - 1] - start[first]).astype(np.uint32)
        return out

    def behind(self) -> np.ndarray:
        """Whether the same bytes have a smaller id; in order of keys."""
        if not len(self.keys):
            return np.zeros(0, bool)
        new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        return self.id > np.minimum.reduceat(self.id, np.flatnonzero(new))[np.cumsum(new) - 1]

    def packed(self, what: int, part: np.ndarray) -> pa.RecordBatch:
        """A row for each part, with its entries in their order."""
        squeeze, rows = zstandard.ZstdCompressor(level=1), []
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = self.take(order[a:b])
            _, one, doc = np.unique(np.stack([own.piece, own.row.astype(np.int64)], 1), axis=0, return_index=True, return_inverse=True) if len(set(own.piece[[0, -1]].tolist())) > 1 or (own.piece != own.piece[0]).any() else (None, *np.unique(own.row, return_index=True, return_inverse=True)[1:])
            docs = np.stack([own.id[one], own.piece[one], own.row[one].astype(np.int64)])
            rows.append((what, int(part[a]), None, docs.tobytes(), doc.reshape(-1).astype(np.uint32).tobytes(), squeeze.compress(np.concatenate([own.start, own.extra]).astype(np.uint32).tobytes()), squeeze.compress(own.keys.tobytes())))
        return _frame(_ROWS, rows)

    @staticmethod
    def unpacked(row: dict) -> Suffixes:
        docs, doc = np.frombuffer(row["docs"], np.int64).reshape(3, -1), np.frombuffer(row["doc"], np.uint32)
        return Suffixes(np.frombuffer(zstandard.decompress(row["keys"]), f"S{WIDTH}"), docs[0][doc], docs[1][doc], docs[2][doc].astype(np.uint32), *np.frombuffer(zstandard.decompress(row["start"]), np.uint32).reshape(2, -1))


class LogIndex:
    """Suffix arrays of batches in levels that merge when they are of like size. gone gets every suffix whose segment has come with a smaller id."""

    def __init__(self, gone: Callable[[Suffixes], None]):
        self.levels: list[Suffixes] = []
        self.gone = gone

    def add(self, batch: Suffixes) -> None:
        batch = self._settled(batch.ordered())
        for level in self.levels:
            if not len(batch.keys):
                return
            # Equal suffixes of a level have one id, its smallest so far.
            a, b = np.searchsorted(level.keys, batch.keys), np.searchsorted(level.keys, batch.keys, "right")
            hit = np.flatnonzero(a < b)
            known = level.id[a[hit]]
            older = hit[batch.id[hit] < known]
            count = b[older] - a[older]
            self.gone(level.take(np.repeat(a[older] - (np.cumsum(count) - count), count) + np.arange(count.sum())))
            stay = np.ones(len(batch.keys), bool)
            stay[hit[batch.id[hit] > known]] = False
            self.gone(batch.take(~stay))
            batch = batch.take(stay)
        if not len(batch.keys):
            return
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].keys) <= 2 * len(self.levels[-1].keys):
            self._merge()

    def _settled(self, ordered: Suffixes) -> Suffixes:
        behind = ordered.behind()
        self.gone(ordered.take(behind))
        return ordered.take(~behind)

    def _merge(self) -> None:
        both = Suffixes.joined([self.levels.pop(-2), self.levels.pop()]).ordered()
        self.levels.append(both.take(~both.behind()))  # what goes here is known since add()

    def whole(self) -> Suffixes | None:
        """All levels in one."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else None


def _shared_bytes(a: np.ndarray) -> np.ndarray:
    """For each row of a sorted byte matrix, how many leading bytes the neighbour that shares most has."""
    lcp = np.argmin(np.concatenate([a[1:] == a[:-1], np.zeros((max(0, len(a) - 1), 1), bool)], 1), 1) if len(a) > 1 else np.zeros(0, np.int64)
    return np.maximum(np.concatenate([[0], lcp]), np.concatenate([lcp, [0]]))


def windows_behind(some: Suffixes, group: np.ndarray) -> np.ndarray:
    """(suffixes, SIDE + 1): whether the window that starts so many bytes before the anchor has come with a smaller id. some: in order; group: a number for each different anchor, ascending."""
    raw = some.bytes()
    out = np.zeros((len(raw), SIDE + 1), bool)
    name = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    after, before = raw[:, ANCHOR : ANCHOR + SIDE], raw[:, ANCHOR + SIDE : -2]
    to_right = _shared_bytes(np.concatenate([name, after], 1))
    order = np.argsort(np.concatenate([name, before], 1).reshape(-1).view(f"S{4 + SIDE}"), kind="stable")
    to_left = np.empty(len(raw), np.int64)
    to_left[order] = _shared_bytes(np.concatenate([name, before], 1)[order])
    # 4 bytes of each are the group's.
    can = (to_right >= 4) & (to_left >= 4) & (to_right + to_left - 8 >= SIDE)
    for n in range(SIDE + 1):
        own = np.flatnonzero(can & (raw[:, -2] >= n) & (raw[:, -1] >= SIDE - n))
        if len(own) < 2:
            continue
        key = np.concatenate([name[own], before[own, :n], after[own, : SIDE - n]], 1).reshape(-1).view(f"S{4 + SIDE}")
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        out[own, n] = some.id[own] > np.minimum.reduceat(some.id[own], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def windows_of(some: Suffixes) -> Suffixes:
    """Each window of the suffixes as one of its own."""
    raw, found = some.bytes(), []
    for n in range(SIDE + 1):
        own = np.flatnonzero((raw[:, -2] >= n) & (raw[:, -1] >= SIDE - n))
        key = raw[own]
        key[:, ANCHOR + SIDE - n : ANCHOR + SIDE], key[:, ANCHOR + SIDE + n : -2], key[:, -2], key[:, -1] = 0, 0, n, SIDE - n
        one = some.take(own)
        one.start = (one.start + raw[own, -2] - n).astype(np.uint32)
        one.keys = key.reshape(-1).view(f"S{WIDTH}")
        found.append(one)
    return Suffixes.joined(found)


def _window_part(some: Suffixes, parts: int) -> np.ndarray:
    words = np.concatenate([some.bytes(), np.zeros((len(some.keys), -WIDTH % 8), np.uint8)], 1).view(np.uint64)
    h = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        h = mix64(h ^ words[:, i])
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _part_of(some: Suffixes, parts: int) -> np.ndarray:
    """The part of each one's anchor."""
    return (_names(np.ascontiguousarray(some.bytes()[:, :ANCHOR]), parts) >> np.uint64(32)).astype(np.int64)


def _groups(some: Suffixes) -> np.ndarray:
    """A number for each different anchor; in order of keys."""
    anchor = some.bytes()[:, :ANCHOR]
    return np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]).any(1)])) if len(anchor) else np.zeros(0, np.int64)


def union_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of intervals in order of their starts."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.concatenate([new[1:] - 1, [len(start) - 1]])]


def _spans(piece: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each piece; the spans of one document that meet are one."""
    order = np.lexsort((start, row, piece))
    piece, row, start, end = (x[order].astype(np.int64) for x in (piece, row, start, end))
    if len(piece):
        doc = np.cumsum(np.concatenate([[0], (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])]))
        a, b = union_of(start + (doc << 33), end + (doc << 33))
        first = np.searchsorted(doc, a >> 33)
        piece, row, start, end = piece[first], row[first], a & ((1 << 33) - 1), b & ((1 << 33) - 1)
    cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)] if len(piece) else [0]
    squeeze = zstandard.ZstdCompressor(level=1)
    pack = lambda x: squeeze.compress(x.astype(np.uint32).tobytes())
    return _frame(_ROWS, [(_SPAN, int(piece[a] % parts), int(piece[a]), None, pack(row[a:b]), pack(start[a:b]), pack(end[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _to_pieces(blobs: DataFrame, sent: DataFrame, *columns: str) -> DataFrame:
    """Each piece with the rows sent to it in the column sent; only those are shuffled, as the pieces lie in buckets."""
    by = sent.groupBy("piece").agg(F.collect_list(F.struct(*columns)).alias("sent"))
    return blobs.join(by.hint("shuffle_hash"), "piece", "left")


def _shared_anchors(blobs: DataFrame, parts: int) -> DataFrame:
    """piece, part, bits: for each different anchor of a piece in a part, in order of names, whether several documents have it (or one of its name)."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in _rows_of(batches):
            piece = Piece(blob)
            name = piece.names(parts)
            order = np.argsort(name, kind="stable")
            name, ids = name[order], piece.ids[piece.row[order]]
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else order
            several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(name) else np.zeros(0, bool)
            name = name[first]
            part = (name >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else [0]
            yield _frame("part int, piece long, names binary, several binary", [(int(part[a]), blob["piece"], name[a:b].astype(np.uint32).tobytes(), np.packbits(several[a:b]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a part."""
        rows = list(_rows_of(batches))
        own = [np.frombuffer(r["names"], np.uint32) for r in rows]
        if not rows:
            return
        every = np.sort(np.concatenate(own))
        common = np.unique(every[1:][every[1:] == every[:-1]])
        for at in range(0, len(rows), 1000):
            bits = []
            for r, n in zip(rows[at : at + 1000], own[at : at + 1000], strict=True):
                several = np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(n)).astype(bool)
                bits.append(np.packbits(several | _within(n, common)).tobytes())
            yield _frame("piece long, part int, bits binary", [(r["piece"], r["part"], b) for r, b in zip(rows[at:], bits, strict=False)])

    sent = blobs.mapInArrow(names, "part int, piece long, names binary, several binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(look, "piece long, part int, bits binary")


def _within(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _suffixes(pieces_: DataFrame, parts: int, hot: int) -> DataFrame:
    """The shared suffixes of each piece, dealt by anchor, and the spans that are settled in it. pieces_: with the bits of their anchors in sent."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blob in _rows_of(batches):
            if not blob["sent"]:
                continue
            piece = Piece(blob)
            name = piece.names(parts)
            every, at = np.unique(name, return_inverse=True)
            count = np.bincount((every >> np.uint64(32)).astype(np.int64), minlength=parts)
            bits = [np.unpackbits(np.frombuffer(s["bits"], np.uint8), count=count[s["part"]]) for s in sorted(blob["sent"], key=lambda s: s["part"])]
            own = np.flatnonzero(np.concatenate(bits).astype(bool)[at])
            blocks = []
            for a in range(0, len(own), _BLOCK):
                some = own[a : a + _BLOCK]
                block = Suffixes(piece.keys(some), piece.ids[piece.row[some]], np.full(len(some), blob["piece"]), piece.row[some].astype(np.uint32), piece.first[some].astype(np.uint32), np.zeros(len(some), np.uint32))
                blocks.append(block.ordered().collapsed())
            if not blocks:
                continue
            found = Suffixes.joined(blocks).ordered() if len(blocks) > 1 else blocks[0]
            part = _part_of(found, parts)
            behind = found.behind()
            gone = found.take(behind)
            yield _spans(gone.piece, gone.row, gone.start, gone.ends(), parts)
            found, part = found.take(~behind), part[~behind]
            group = _groups(found)
            much = np.bincount(group)[group] > hot if len(group) else np.zeros(0, bool)
            yield found.take(~much).packed(_SUFFIX, part[~much])
            if much.any():
                windows = windows_of(found.take(much)).ordered()
                behind = windows.behind()
                gone, windows = windows.take(behind), windows.take(~behind)
                yield _spans(gone.piece, gone.row, gone.start, gone.ends(), parts)
                yield windows.packed(_WINDOW, _window_part(windows, parts))
                first = np.flatnonzero(much & np.concatenate([[True], group[1:] != group[:-1]]))
                yield _frame(_ROWS, [(_HOT, int(part[i]), blob["piece"], None, None, None, found.bytes()[i, :ANCHOR].tobytes()) for i in first.tolist()])

    return pieces_.mapInArrow(each, _ROWS)


def _scan(dealt: DataFrame, parts: int, windows: bool) -> DataFrame:
    """The spans that match, for their pieces; a partition is a part. windows: it is the second round, of windows alone; else windows are only passed on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []

        def gone(some: Suffixes) -> None:
            if len(some.keys):
                found.append((some.piece, some.row, some.start, some.ends()))

        index, hot = LogIndex(gone), set()
        for row in _rows_of(batches):
            if row["what"] == _HOT:
                hot.add(row["keys"])
            elif row["what"] == _SPAN or (row["what"] == _WINDOW and not windows):
                yield _frame(_ROWS, [tuple(row.values())])
            else:
                index.add(Suffixes.unpacked(row))
        whole = index.whole()
        if whole is not None and not windows:
            group = _groups(whole)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            is_hot = np.array([bytes(a) in hot for a in whole.bytes()[first, :ANCHOR]])[group] if hot else np.zeros(len(group), bool)
            own = np.flatnonzero((np.bincount(group)[group] > 1) & ~is_hot)
            some = whole.take(own)
            if len(own):
                edge = np.diff(np.pad(windows_behind(some, group[own]).astype(np.int8), ((0, 0), (1, 1))), axis=1)
                at, least = np.nonzero(edge == 1)
                most = np.nonzero(edge == -1)[1] - 1
                place = some.start[at].astype(np.int64) + some.bytes()[at, -2]
                found.append((some.piece[at], some.row[at], place - most, place - least + LENGTH + some.extra[at]))
            if is_hot.any():
                some = windows_of(whole.take(is_hot))
                yield some.packed(_WINDOW, _window_part(some, parts))
        if found:
            yield _spans(*(np.concatenate([f[i] for f in found]) for i in range(4)), parts)

    return dealt.mapInArrow(each, _ROWS)


def _removed(pieces_: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans and the kept text if wanted. pieces_: with their spans in sent."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda raw: np.frombuffer(zstandard.decompress(raw), np.uint32).astype(np.int64)
        for blob in _rows_of(batches):
            text = memoryview(zstandard.decompress(blob["text"])) if blob["text"] else memoryview(b"")
            ids, known = np.frombuffer(blob["ids"], np.int64), np.frombuffer(blob["known"], bool)
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(blob["size"], np.uint32), dtype=np.int64)]).tolist()
            row, start, end = (np.concatenate([np.zeros(0, np.int64), *(read(s[c]) for s in blob["sent"] or [])]) for c in ("doc", "start", "keys"))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            cut = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
            out = []
            for i in range(len(ids)):
                own = text[offsets[i] : offsets[i + 1]]
                a, b = union_of(start[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]])
                edges = [0, *np.stack([a, b], 1).reshape(-1).tolist(), len(own)]
                kept = b"".join(own[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)) if len(a) else bytes(own)
                one = (int(ids[i]) if known[i] else None, len(own), len(own) - len(kept), len(a), hashlib.sha256(kept).hexdigest())
                out.append((*one, np.stack([a, b], 1).tolist(), kept.decode(errors="replace")) if with_text else one)
                if len(out) == 5000 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kinds[j]) for j in range(len(names))], names)
                    out = []

    return pieces_.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<long>>, kept string" if with_text else ""))


def remove_repeats(docs: DataFrame, with_text: bool = False, piece_bytes: int = _PIECE, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text: spans (in bytes) and kept too.

    Where a cut splits a character, its bytes that stay show as U+FFFD in kept; the hash is of the bytes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blobs = pieces(docs, min(parts, 100_000), piece_bytes)
    shared = _to_pieces(blobs, _shared_anchors(blobs, parts), "part", "bits")
    found = stored(_scan(_suffixes(shared, parts, hot).repartitionById(parts, F.col("part")), parts, windows=False), "suffix-spans")
    second = found.filter(F.col("what") == _WINDOW).repartitionById(parts, F.col("part"))
    spans = found.filter(F.col("what") == _SPAN).unionByName(_scan(second, parts, windows=True))
    return _removed(_to_pieces(blobs, spans, "doc", "start", "keys"), with_text)
