"""SentencePiece encoding and decoding with Gumbel top-k sampling.

A text's lattice has every segmentation of " " + text into the pieces of a
fixed public vocabulary (bytes for characters that it lacks). A piece of rank r
weighs 1 / (r + 2.7), an unknown character 1e-9; a segmentation's probability is
the product of its weights over that of all. The lattice falls into units where no
piece of the vocabulary can cross: between characters that stand together in no
piece, such as a letter and the space after it. Nothing is lost by that, and a
unit may be of any length.

Samples without replacement: every segmentation has its log-probability plus a
Gumbel number, and the k with the largest sums are emitted, in order. The
search is top-down and best-first, as in A*: a node of the search tree stands
for a set of segmentations, and the largest sum in it is known exactly (a Gumbel
at the log of their summed probability, by backward sums). A path is drawn edge
by edge; all segmentations that leave it within one unit are one node beside
it, with one number. Such a node is opened only when it is the best: the place
where it leaves the path is drawn, what is left of it is a node again, and the
path goes on from there. The drawing is done for all units of a chunk of texts
at once.

inclusion is the probability that a segmentation with that log-probability
exceeds the (k+1)th largest sum, 1 if there is none. The numbers come from the
row's key and the place in the text only, so reruns and any partitioning agree.

encode_samples() returns 1 to k rows a document. Null texts are empty; an empty
text has one segmentation, a lone space mark. Null keys share one seed, and
rows that share key and text get the same samples. Other columns are neither
read nor returned. An empty table gives an empty result. decode() is the
inverse: its result is the text, exactly. A chunk is whole texts, so memory is
proportional to the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm import lattice
from cadastra.llm.common import Rolling, held, mix64, slices, text_bytes, tidied

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_UNKNOWN = 1e-9
_KNOWN = 100_000
_LEARNED = 10_000
_K, _L = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[str], int]:
    """The pieces by id ("" for control and byte pieces), with a space for the space mark, and the id of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    skip = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    pieces = ["" if s else model.id_to_piece(i).replace(lattice.SPACE, " ") for i, s in enumerate(skip)]
    return pieces, model.piece_to_id("<0x00>")


class Crossed:
    """Which pairs of characters stand together in a piece; between others a text falls into units."""

    def __init__(self, pieces: list[str]):
        data, first, _ = lattice.codes(pieces)
        inner = np.ones(len(data), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        self.pairs = np.unique(pair_of(data[at - 1], data[at]))
        a, b = self.pairs >> 21, self.pairs & ((1 << 21) - 1)
        latin = (a < 256) & (b < 256)
        self.latin = np.zeros((256, 256), bool)
        self.latin[a[latin], b[latin]] = True

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where units begin. begins: where texts do."""
        new = np.ones(len(data), bool)
        a, b = data[:-1], data[1:]
        small = (a < 256) & (b < 256)
        new[1:] = ~(small & self.latin[np.minimum(a, 255), np.minimum(b, 255)])
        other = np.flatnonzero(~small)
        if len(other) and len(self.pairs):
            pair = pair_of(a[other], b[other])
            new[other + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] != pair
        new[begins] = True
        return np.flatnonzero(new)


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 21) | b.astype(np.int64)


class Decoder:
    def __init__(self, pieces: list[str], byte0: int):
        raw = [p.encode() for p in pieces]
        for b in range(256):
            raw[byte0 + b] = bytes([b])
        self.size = np.array([len(r) for r in raw])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all pieces, the first space mark too."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def _appended(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """held, of which n values are in use, with more after them; copied only where it doubles."""
    if n + len(more) > len(held):
        old, held = held, np.empty((max(n, 1024) * 3 // 2 + len(more), *held.shape[1:]), held.dtype)
        held[:n] = old[:n]
    held[n : n + len(more)] = more
    return held


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers over 0, up to 1, from 64 bits each."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class _Path:
    """A sampled path: its edges, of which those of unit begin at at[unit - unit0], and the first fixed ones of that unit were given."""

    __slots__ = ("log_p", "sum", "edges", "unit0", "at", "fixed", "fixed_log")

    def __init__(self, log_p: float, total: float, edges: np.ndarray, unit0: int, at: np.ndarray, fixed: int, fixed_log: float):
        self.log_p, self.sum, self.edges, self.unit0, self.at, self.fixed, self.fixed_log = log_p, total, edges, unit0, at, fixed, fixed_log


class Sampler:
    """Samples for chunks of texts; remembers units' lattices up to a bound."""

    def __init__(self, pieces: list[str], byte0: int):
        self.byte0 = byte0
        used = [i for i, p in enumerate(pieces) if p]
        self.piece_id = np.array([*used, -1])
        self.vocabulary = lattice.Pieces([pieces[i] for i in used])
        self.crossed = Crossed(self.vocabulary.pieces)
        weight = 1 / (np.arange(len(used)) + 2.7)
        self.p = np.concatenate([weight / weight.sum(), [_UNKNOWN]])[:, None]
        self.log_w = np.log(self.p)
        self.forget()

    def forget(self) -> None:
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the known units, in order of names
        self.base = np.zeros(0, np.int64)  # each unit's first node
        self.nodes, self.edges = 0, 0
        self.first = np.zeros(1, np.int64)  # of each node's edges; the last node of a unit has none
        self.piece = np.zeros(0, np.int32)
        # Of each edge, in one row as they are read together: its probability at its node, that of all beside it, the logarithm of the first, and where it ends.
        self.table = np.zeros((0, 4))

    def numbered(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each unit; unknown ones are learned."""
        name, one, at = np.unique(Rolling(data).spans(start, start + size), return_index=True, return_inverse=True)
        if len(self.names) > _KNOWN:
            self.forget()
        place = np.minimum(np.searchsorted(self.names, name), max(0, len(self.names) - 1))
        known = self.names[place] == name if len(self.names) else np.zeros(len(name), bool)
        number = np.empty(len(name), np.int64)
        number[known] = self.numbers[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            # Long units are learned apart, as their sums run in logarithms.
            new = new[np.argsort(size[one[new]] > lattice.SHORT, kind="stable")]
            number[new] = len(self.base) + np.arange(len(new))
            short = int((size[one[new]] <= lattice.SHORT).sum())
            for a, b in [(a, min(a + _LEARNED, short)) for a in range(0, short, _LEARNED)] + [(a, a + 1) for a in range(short, len(new))]:
                self.learn(data, start[one[new[a:b]]], size[one[new[a:b]]])
            names, numbers = np.concatenate([self.names, name[new]]), np.concatenate([self.numbers, number[new]])
            order = np.argsort(names, kind="stable")
            self.names, self.numbers = names[order], numbers[order]
        return number[at]

    def learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        lat = lattice.build_from(data, start, size, self.vocabulary)
        beta = lattice.backward(lat, self.log_w)[:, 0]
        q = np.exp(self.log_w[lat.piece, 0] + beta[lat.end] - beta[lat.start])
        # What leaves a node beside an edge, without a difference from nearly 1.
        large = q > 0.5
        small = np.add.reduceat(np.where(large, 0, q), lat.first[:-1][lat.first[:-1] < lat.first[1:]]) if len(q) else q
        of = np.cumsum(np.concatenate([[0], lat.start[1:] != lat.start[:-1]])) if len(q) else q.astype(np.int64)
        beside = np.where(large, small[of], 1 - q)
        one = np.diff(lat.first)[lat.start] == 1
        beside[one] = 0
        order = np.arange(len(q))
        if len(q):
            # The likeliest edge of a node comes first.
            first = lat.first[:-1][lat.first[:-1] < lat.first[1:]]
            top = np.flatnonzero(q == np.maximum.reduceat(q, first)[of])
            most = np.empty(len(first), np.int64)
            most[of[top][::-1]] = top[::-1]
            order[first], order[most] = most, first
        self.base = np.concatenate([self.base, lat.node + self.nodes])
        self.first = _appended(self.first, self.nodes, lat.first + self.edges)  # the last is the next unit's first
        piece = np.where(lat.unknown < 0, self.piece_id[lat.piece], -1 - lat.unknown)
        with np.errstate(divide="ignore"):
            log_q = np.log(q)
        table = np.empty((len(q), 4))
        for i, column in enumerate((q, beside, log_q, lat.end + self.nodes)):
            table[:, i] = column[order]
        self.piece, self.table = _appended(self.piece, self.edges, piece[order]), _appended(self.table, self.edges, table)
        self.edges += len(q)
        self.nodes += len(lat.first) - 1

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draws the rest of each unit from node on: the edges taken, where each unit's begin, the log-probabilities, and what all that leaves the path weighs."""
        n = len(node)
        log_p, before, rest, node = np.zeros(n), np.ones(n), np.zeros(n), node.copy()
        act, steps, turn = np.flatnonzero(self.first[node] < self.first[node + 1]), [], 0
        while len(act):
            at = node[act]
            edge = self.first[at]
            more = self.first[at + 1] - edge - 1
            got = self.table[edge]
            on = np.flatnonzero(more)
            u = _uniform(mix64(seed[act[on]] + np.uint64(((turn + 1) * int(_L)) % (1 << 64)))) - got[on, 0]
            while True:
                go = np.flatnonzero(u > 0)
                if not len(go):
                    break
                on, u = on[go], u[go]
                edge[on] += 1
                more[on] -= 1
                row = self.table[edge[on]]
                got[on] = row
                u = np.where(more[on] > 0, u - row[:, 0], 0)
            rest[act] += before[act] * got[:, 1]
            before[act] *= got[:, 0]
            log_p[act] += got[:, 2]
            steps.append((act, edge))
            at = got[:, 3].astype(np.int64)
            node[act] = at
            act, turn = act[self.first[at] < self.first[at + 1]], turn + 1
        count = np.zeros(n + 1, np.int64)
        for act, _ in steps:
            count[act + 1] += 1
        opens = np.cumsum(count)
        taken = np.empty(opens[-1], np.int64)
        for turn, (act, edge) in enumerate(steps):
            taken[opens[act] + turn] = edge
        return taken, opens, log_p, rest

    def leave(self, path: _Path, unit: int, node: int, gone: tuple, u: float) -> tuple[int, int, float, float]:
        """Draws where a segmentation leaves a path within a unit, other than at gone: the number of the path's edges that it keeps, its next edge, the log-probability of both, and that of all other ways to leave (-inf if there are none)."""
        a, b = int(path.at[unit - path.unit0]), int(path.at[unit - path.unit0 + 1])
        own, done = path.edges[a:b].tolist(), path.fixed if unit == path.unit0 else 0
        log_before = path.fixed_log if unit == path.unit0 else 0.0
        for e in own[:done]:
            node = int(self.table[e, 3])
        found, before = [], 1.0
        for i, e in enumerate(own[done:], done):
            x, y = int(self.first[node]), int(self.first[node + 1])
            if y - x > 1:
                q = self.table[x:y, 0].tolist()
                found += [(before * q[s - x], i, s) for s in range(x, y) if s != e and (i, s) not in gone]
            before *= float(self.table[e, 0])
            node = int(self.table[e, 3])
        total, at = sum(f[0] for f in found), 0
        u *= total
        while at < len(found) - 1 and u > found[at][0]:
            u -= found[at][0]
            at += 1
        left = sum(f[0] for j, f in enumerate(found) if j != at)
        return found[at][1], found[at][2], log_before + math.log(found[at][0]), log_before + math.log(left) if left > 0 else -math.inf

    def sample(self, texts: list[str | None], seeds: np.ndarray, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """(log-probability, sum, inclusion, ids) of 1 to k samples of each text."""
        n = len(texts)
        if not n:
            return []
        data, begins, length = lattice.codes([" " + (t or "") for t in texts])
        start = self.crossed.cuts(data, begins)
        number = self.numbered(data, start, np.diff(np.concatenate([start, [len(data)]])))
        base = self.base[number]
        first = np.searchsorted(start, begins)
        last = np.concatenate([first[1:], [len(start)]])
        doc = np.repeat(np.arange(n), last - first)
        # The place is a character's, not a unit's.
        place = mix64(seeds[doc] + (start - begins[doc]).astype(np.uint64) * _L)
        # The root's sum is a Gumbel number at 0.
        root = np.minimum(-np.log(-np.log(_uniform(mix64(seeds ^ _K)))), 700.0)
        paths: list[list[_Path]] = [[] for _ in range(n)]
        open_: list[list[tuple]] = [[] for _ in range(n)]
        docs, unit, node, before, offset, top = np.arange(n), first, base[first], np.zeros(n), np.zeros(n), root
        heads: list = [(np.zeros(0, np.int64), 0)] * n
        for turn in range(k):
            # The units from unit[d] on of each document in docs; the first goes on from node[d] with before[d].
            count = last[docs] - unit
            who = np.repeat(np.arange(len(docs)), count)
            opens = np.cumsum(count) - count
            own = np.repeat(unit - opens, count) + np.arange(count.sum())
            at, given = base[own], np.zeros(len(own))
            at[opens], given[opens] = node, before
            seed = mix64(place[own] + np.uint64((turn * int(_K)) % (1 << 64)))
            taken, cut, log_p, rest = self.walk(at, seed)
            log_p += given
            ends = np.cumsum(log_p)
            whole = ends - log_p - (ends[opens] - log_p[opens])[who] + offset[who]  # of all units before, from the text's start
            log_all = np.add.reduceat(log_p, opens) + offset
            for i, d in enumerate(docs.tolist()):
                head, fixed = heads[i]
                a, z = int(opens[i]), int(opens[i] + count[i])
                edges = np.concatenate([head, taken[cut[a] : cut[z]]])
                where = cut[a : z + 1] - cut[a] + len(head)
                where[0] -= fixed
                paths[d].append(_Path(float(log_all[i]), float(top[i]), edges, int(unit[i]), where, fixed, float(before[i])))
            # The sum of a node beside the path is -log(exp(-sum of the path) + exp(-w)), so w ranks them.
            with np.errstate(divide="ignore"):
                w = whole + given + np.log(rest) - np.log(-np.log(_uniform(mix64(seed ^ _K))))
            for _ in range(k - turn):
                best = np.maximum.reduceat(w, opens)
                hit = np.flatnonzero((w == best[who]) & (w > -np.inf))
                if not len(hit):
                    break
                w[hit], value = -np.inf, w[hit]
                i = who[hit]
                for i_, value_, u_, before_ in zip(i.tolist(), (-np.logaddexp(-top[i], -value)).tolist(), own[hit].tolist(), whole[hit].tolist(), strict=True):
                    d = int(docs[i_])
                    open_[d].append((value_, len(paths[d]) - 1, u_, before_, ()))
            if turn == k - 1:
                break
            go = [d for d in docs.tolist() if open_[d]]
            rows, heads = [], []
            for d in go:
                item = max(open_[d])
                open_[d].remove(item)
                value, p, u, before_u, gone = item
                path = paths[d][p]
                x = mix64(np.array([int(place[u]) ^ (turn + 1) * 0x632BE59B, int(place[u]) ^ (turn + 1) * 0x2545F491], np.uint64))
                draw = _uniform(x).tolist()
                keep, edge, log_q, log_left = self.leave(path, u, int(base[u]), gone, draw[0])
                if log_left > -math.inf and draw[1] < 1:
                    left = before_u + log_left - math.log(-math.log(draw[1]))
                    open_[d].append((float(-np.logaddexp(-value, -left)), p, u, before_u, (*gone, (keep, edge))))
                heads.append((np.concatenate([path.edges[: path.at[u - path.unit0] + keep], [edge]]), keep + 1))
                rows.append((u, int(self.table[edge, 3]), log_q, before_u, value))
            if not go:
                break
            docs = np.array(go)
            unit, node = (np.array([r[i] for r in rows], np.int64) for i in range(2))
            before, offset, top = (np.array([r[i] for r in rows]) for i in range(2, 5))
        out, flat = [], [path.edges for own in paths for path in own]
        ids = iter(self.ids_of(flat))
        for d in range(n):
            limit = max((o[0] for o in open_[d]), default=-math.inf)
            include = [-math.expm1(-math.exp(min(700.0, path.log_p - limit))) if limit > -math.inf else 1.0 for path in paths[d]]
            out.append([(path.log_p, path.sum, x, next(ids)) for path, x in zip(paths[d], include, strict=True)])
        return out

    def ids_of(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each path's pieces; an unknown character is its bytes."""
        size = np.array([len(p) for p in paths])
        ids = self.piece[np.concatenate(paths)].astype(np.int64)
        unknown = np.flatnonzero(ids < 0)
        ends = np.cumsum(size)
        if len(unknown):
            raw = [chr(-1 - c).encode(errors="surrogatepass") for c in ids[unknown].tolist()]
            many = np.ones(len(ids), np.int64)
            many[unknown] = [len(r) for r in raw]
            to = np.cumsum(many)
            ends = to[ends - 1]
            out = np.repeat(ids, many)
            at = np.repeat(to[unknown] - many[unknown], many[unknown])
            step = np.arange(len(at)) - np.repeat(np.cumsum(many[unknown]) - many[unknown], many[unknown])
            out[at + step] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + self.byte0
            ids = out
        return np.split(ids.astype(np.int32), ends[:-1])


def encode_samples(docs: DataFrame, k: int = 2, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """doc_id, sample, n_pieces, log_prob, perturbed, inclusion, lossless, ids: 1 to k rows a document.

    key: the column that seeds the sampling. lossless: decoding gives the text back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))  # the vocabulary's size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, decoder = held(f"sampler {vocabulary}", lambda: (Sampler(*shared.value), Decoder(*shared.value)))
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                seeds = mix64(part.column("seed").to_numpy().view(np.uint64))
                found = sampler.sample(part.column("text").to_pylist(), seeds, k)
                count = np.array([len(f) for f in found])
                rows = [r for f in found for r in f]
                ids = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int32)
                size = np.array([len(r[3]) for r in rows])
                raw = decoder(ids)
                ends = np.cumsum(np.add.reduceat(decoder.size[ids], np.cumsum(size) - size)) if rows else []
                data, offsets = text_bytes(part.column("text"))
                same = [np.array_equal(raw[a + 1 : b], data[offsets[d] : offsets[d + 1]]) for d, a, b in zip(np.repeat(np.arange(len(found)), count).tolist(), [0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(np.repeat(np.arange(len(found)), count))), pa.array([i + 1 for f in found for i in range(len(f))], pa.int32()), pa.array(size, pa.int64()),
                        pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array(same, pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32())),
                    ],
                    ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "lossless", "ids"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("seed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(each), f"doc_id {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, lossless boolean, ids array<int>")


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of a column of ids."""
    pieces, byte0 = load_vocabulary(vocabulary)

    @F.pandas_udf("string")
    def each(column: pd.Series) -> pd.Series:
        decoder = Decoder(pieces, byte0)
        return column.map(lambda x: None if x is None else decoder(np.asarray(x, np.int64)).tobytes()[1:].decode(errors="replace"))

    return each(ids)
