"""Masked pseudo-likelihood by a bidirectional window network, trained in numpy.

A text's tokens are its words (lower case, between white space). The score of a
text is the sum over its tokens of log p(token | two tokens to the left and two
to the right), where the token itself is masked. p is factored by classes: the
network gives the class from both sides, the corpus the word within its class.
There are about twice the square root of the number of different words classes,
CLASSES at least. The most frequent words are classes of their own, for half of
them; the others share the other half by hash. A class's probability is that of
a path through a binary tree, so its cost grows with the logarithm of the number
of classes. A word's share of its class comes from the counts of all words,
which are joined to the texts' words by part; only those of the most frequent
words reach every task. A word that was never counted has a part of 1 in the
class's count plus 1.

Everything the model learns comes from all documents: word counts are summed
over all tasks, and in each round every task trains its own copy of the network
on masked positions of all its texts; the copies are averaged by their number of
positions, in steps, so no task and not the driver gathers more than a few. A
position belongs to one of mask_every lots, by a hash of its word and its place
in the text, and each round masks the next lot, so mask_every rounds use every
position once, as they do by default: two rounds of two lots.

A score that is asked for doesn't depend on how rows are spread over tasks, but
the network does: copies see what their task holds.

Null and empty texts have no tokens: score 0 and a null mean. Repeated rows
count as often as they come and score alike. Words tied in count are ordered by
their hash. A text of any length is scored whole. Other columns are neither read
nor returned. An empty table gives an empty result. Sums of numbers run in a fixed order within a task; scores of two runs
agree to about six digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import Rolling, mix64, runs, slices, stored, text_bytes

HIDDEN = 32
CLASSES = 128  # at least; always a power of two
AROUND = (-2, -1, 1, 2)
_WHITE = np.zeros(256, bool)
_HELD = 1 << 20  # words that a task holds before it deals them
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit name) of each token, in order."""
    data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    row, start, end = runs(data, _WHITE[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
    return row, Rolling(data).spans(start, end)


def classes_for(words: int) -> int:
    """The number of classes for so many different words."""
    return max(CLASSES, 1 << int(np.ceil(np.log2(2 * np.sqrt(max(words, 1))))))


def shared_class(names: np.ndarray, classes: int) -> np.ndarray:
    return classes // 2 + (mix64(names ^ np.uint64(0xABCDEF)) % np.uint64(classes // 2)).astype(np.int64)


@dataclass
class Words:
    """names: the most frequent words, sorted; kind: each one's class; log_n: of its count; whole: the count of each class; counts: of all words, (part, names, n), packed."""

    names: np.ndarray
    kind: np.ndarray
    log_n: np.ndarray
    whole: np.ndarray
    parts: int
    counts: DataFrame | None

    def __call__(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, log-probability within it, and whether that is final: if not, the logarithm of the word's count is to be added."""
        kind = shared_class(names, len(self.whole))
        if not len(self.names):
            return kind, -np.log(self.whole[kind] + 1), np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[at] == names
        kind[known] = self.kind[at[known]]
        return kind, np.where(known, self.log_n[at], 0) - np.log(self.whole[kind] + 1), known


def count_words(docs: DataFrame, vocabulary: int = 8192) -> Words:
    """From the counts of every word of every text; what reaches the driver is a row a class and the most frequent words, vocabulary of them and all with a class of their own."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                names, n = np.unique(tokens(piece.column("text"))[1], return_counts=True)
                part = (mix64(names) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                names, n = names[order], n[order].astype(np.int32)
                full = [p for p in range(parts) if cut[p] < cut[p + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([names[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()), pa.array([n[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary())], ["part", "names", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All words of each part, sorted, and their counts."""
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, names, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = held.setdefault(part, ([], []))
                a.append(np.frombuffer(names, np.uint64)), b.append(np.frombuffer(n, np.int32))
        for names, n in held.values():
            own, at = np.unique(np.concatenate(names), return_inverse=True)
            sums = np.bincount(at, np.concatenate(n)).astype(np.int64)
            part = int(mix64(own[:1])[0] % np.uint64(parts))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["part", "names", "n"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, n in zip(batch.column("names").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["name", "n"])

    dealt = docs.select("text").mapInArrow(count, "part int, names binary, n binary").repartition(parts // 4, "part")
    packed = stored(dealt.mapInArrow(total, "part int, names binary, n binary"), "lm-counts")
    classes = classes_for((packed.agg(F.sum(F.length("names"))).first()[0] or 0) // 8)
    own = classes // 2
    counts = packed.select("names", "n").mapInArrow(single, "name long, n long")
    top = counts.orderBy(F.desc("n"), "name").limit(max(vocabulary, own)).toPandas()
    names, n = top["name"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    kind = np.where(np.arange(len(names)) < own, np.arange(len(names)), shared_class(names, classes))

    @F.pandas_udf("long")
    def home_class(name: pd.Series) -> pd.Series:
        return pd.Series(shared_class(name.to_numpy().view(np.uint64), classes))

    by = counts.groupBy(home_class("name").alias("kind")).agg(F.sum("n").alias("n")).toPandas()
    whole = np.zeros(classes)
    whole[by["kind"]] = by["n"]
    # The words with classes of their own leave the shared ones.
    np.subtract.at(whole, shared_class(names[:own], classes), n[:own])
    whole[: len(n[:own])] = n[:own]
    order = np.argsort(names)
    return Words(names[order], kind[order], np.log(n)[order], whole, parts, packed)


class Network:
    """Hidden = tanh(sum over the four places of a vector of the class there); at each node of a binary tree over the classes, the left side has the sigmoid of out * hidden + bias."""

    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES):
        if flat is not None:
            classes = (len(flat) - (len(AROUND) + 1) * HIDDEN) // ((len(AROUND) + 1) * HIDDEN + 1)
        shapes = ((len(AROUND), classes + 1, HIDDEN), (HIDDEN,), (classes, HIDDEN), (classes,))
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            random = np.random.default_rng(3)
            flat = np.concatenate([random.standard_normal(n) * (0.1 if len(s) > 1 else 0) for n, s in zip(sizes, shapes, strict=True)])
        self.flat, self.classes, self.depth = flat.astype(np.float32), classes, classes.bit_length() - 1
        self.squares = np.full(len(self.flat), 1e-3, np.float32)
        cuts = np.cumsum([0, *sizes])
        views = lambda x: [x[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False)]
        self.places, self.shift, self.out, self.bias = self.values = views(self.flat)
        self.sums = views(self.squares)

    def start(self, counts: np.ndarray) -> None:
        """The biases by which the tree gives the classes' shares of counts."""
        total = np.concatenate([np.zeros(self.classes), counts])
        for node in range(self.classes - 1, 0, -1):
            total[node] = total[2 * node] + total[2 * node + 1]
        left, right = total[2::2], total[3::2]
        self.bias[1:] = np.log((left + 0.5) / (right + 0.5))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        x = self.shift + self.places[0][around[0]]
        for i in range(1, len(AROUND)):
            x += self.places[i][around[i]]
        return np.tanh(x)

    def _path(self, hidden: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """node, whether it turns right there, and the log-odds of the way taken, from the root to each class."""
        leaf = kind + self.classes
        for d in range(self.depth, 0, -1):
            node = leaf >> d
            right = (leaf >> (d - 1)) & 1
            x = np.einsum("nh,nh->n", hidden, self.out[node]) + self.bias[node]
            yield node, right, x * (1 - 2 * right).astype(np.float32)

    def log_p(self, around: np.ndarray, kind: np.ndarray, block: int = 8192) -> np.ndarray:
        """Of each token's class, from the classes around it."""
        out = np.zeros(len(kind))
        for a in range(0, len(kind), block):
            total = np.zeros(len(kind[a : a + block]))
            for _, _, x in self._path(self.hidden(around[:, a : a + block]), kind[a : a + block]):
                # log(1 + exp(-x)) without an overflow: beyond 30 the 1 doesn't count.
                total -= np.log1p(np.exp(-np.maximum(x, -30))) + np.maximum(-30 - x, 0)
            out[a : a + block] = total
        return out

    def _step(self, rows: np.ndarray, rate: float, what: list[tuple[np.ndarray, np.ndarray, np.ndarray]], times: np.ndarray | None = None) -> None:
        """Adagrad on the rows that have gradients, summed by row. what: values, their sums of squares, gradients (of every n-th row, if times has a factor for each)."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        own = rows[first]
        for values, squares, grad in what:
            if times is None:
                each = grad[order]
            elif grad is times:
                each = times[order]
            else:
                each = grad[order % len(grad)]
                each *= times[order, None]
            g = np.add.reduceat(each, first)
            held = squares[own] + g * g
            squares[own] = held
            values[own] -= rate * g / np.sqrt(held)

    def learn(self, around: np.ndarray, kind: np.ndarray, rate: float = 0.05) -> None:
        """One step by Adagrad."""
        h = self.hidden(around)
        n = len(kind)
        nodes, odds = np.empty((self.depth, n), np.int64), np.empty((self.depth, n), np.float32)
        back = np.zeros_like(h)
        for i, (node, right, x) in enumerate(self._path(h, kind)):
            # The gradient by the log-odds of left is (sigmoid - 1) on the way taken, turned for a turn to the right.
            g = (np.float32(-1) / (1 + np.exp(np.minimum(x, 80))) * (1 - 2 * right)).astype(np.float32) / np.float32(n)
            back += g[:, None] * self.out[node]
            nodes[i], odds[i] = node, g
        # The levels of the tree have no node in common, so they make one step.
        small = np.int16 if self.classes < 1 << 14 else np.int32
        flat = odds.reshape(-1)
        self._step(nodes.reshape(-1).astype(small), rate, [(self.values[2], self.sums[2], h), (self.values[3], self.sums[3], flat)], flat)
        back *= 1 - h * h
        shift = back.sum(0)
        self.sums[1] += shift * shift
        self.values[1] -= rate * shift / np.sqrt(self.sums[1])
        for i in range(len(AROUND)):
            self._step(around[i].astype(small), rate, [(self.values[0][i], self.sums[0][i], back)])


def around(row: np.ndarray, kind: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The classes at the four places around each token; the number of classes beyond a text's ends."""
    out = np.full((len(AROUND), len(kind)), classes, np.int64)
    for i, o in enumerate(AROUND):
        a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
        same = row[a] == row[b]
        out[i, a][same] = kind[b][same]
    return out


def _averaged(copies: DataFrame, groups: int) -> DataFrame:
    """Copies (part, weight, flat) averaged into groups of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, weight, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = held.setdefault(part % groups, [0.0, 0.0])
                h[0] += weight
                h[1] = h[1] + weight * np.frombuffer(flat, np.float32).astype(np.float64)
        for part, (weight, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()])], ["part", "weight", "flat"])

    return copies.repartition(groups, F.col("part") % groups).sortWithinPartitions("part").mapInArrow(each, "part long, weight double, flat binary")


def train(docs: DataFrame, words: Words, rounds: int = 2, mask_every: int = 2, batch: int = 1024) -> Network:
    spark = docs.sparkSession
    known, tasks = spark.sparkContext.broadcast(replace(words, counts=None)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    network = Network(classes=len(words.whole))
    network.start(words.whole)
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(network.flat)

        def learn(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            own, seen, part, waiting = Network(now.value.copy()), 0, None, []
            for b in batches:
                for piece in slices(b, "text"):
                    part = piece.column("part")[0].as_py() if part is None else part
                    row, name = tokens(piece.column("text"))
                    kind, *_ = known.value(name)
                    place = (np.arange(len(name)) - np.searchsorted(row, row)).astype(np.uint64)  # in its text
                    at = np.flatnonzero(mix64(name + place * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(mask_every) == turn % mask_every)
                    waiting.append((around(row, kind, own.classes)[:, at], kind[at]))
                    if sum(len(w[1]) for w in waiting) < batch:
                        continue
                    places, kinds = np.concatenate([w[0] for w in waiting], 1), np.concatenate([w[1] for w in waiting])
                    full = len(kinds) // batch * batch
                    for a in range(0, full, batch):
                        own.learn(places[:, a : a + batch], kinds[a : a + batch])
                    seen, waiting = seen + full, [(places[:, full:], kinds[full:])]
            for places, kinds in waiting:
                if len(kinds):
                    own.learn(places, kinds)
                    seen += len(kinds)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([float(seen)]), pa.array([own.flat.tobytes()])], ["part", "weight", "flat"])

        copies = docs.select(F.spark_partition_id().cast("long").alias("part"), "text").mapInArrow(learn, "part long, weight double, flat binary")
        got = _averaged(_averaged(_averaged(copies, tasks), min(tasks, 32)), min(tasks, 4)).toPandas().sort_values("part")
        if not len(got):
            break
        flat = np.average(np.stack([np.frombuffer(f, np.float32) for f in got["flat"]]).astype(np.float64), 0, got["weight"])
        network = Network(flat)
    return network


def score(docs: DataFrame, words: Words, network: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token of each row."""
    spark = docs.sparkSession
    known, shared = spark.sparkContext.broadcast(replace(words, counts=None)), spark.sparkContext.broadcast(network.flat)  # both grow with the square root of the number of words
    tasks, parts = int(spark.conf.get("spark.sql.shuffle.partitions")), words.parts
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: documents (ids, a: counts of tokens, b: sums so far); of kind 1: words of them that wait for their counts (a: names, b: places of the documents)."""
        own, at, ids, counts, sums, names, rows, docs_held, held = Network(shared.value), None, [], [], [], [], [], 0, 0

        def made() -> pa.RecordBatch:
            ids_ = pa.concat_arrays(ids)
            name, row = np.concatenate(names), np.concatenate(rows).astype(np.uint32)
            part = (mix64(name) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut, name, row = np.searchsorted(part[order], np.arange(parts + 1)).tolist(), name[order], row[order]
            full = [p for p in range(parts) if cut[p] < cut[p + 1]]
            offsets = pa.array([0, *[len(ids_)] * (len(full) + 1)], pa.int32())
            a = [np.concatenate(counts).astype(np.int64).tobytes(), *(name[cut[p] : cut[p + 1]].tobytes() for p in full)]
            b = [np.concatenate(sums).tobytes(), *(row[cut[p] : cut[p + 1]].tobytes() for p in full)]
            return pa.RecordBatch.from_arrays(
                [pa.array([at] * len(a), pa.int64()), pa.array([-1, *full], pa.int32()), pa.array([0] + [1] * len(full), pa.int32()), pa.ListArray.from_arrays(offsets, ids_), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                ["piece", "part", "kind", "ids", "a", "b"],
            )

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                at = piece.column("piece")[0].as_py() << 32 if at is None else at
                n = piece.num_rows
                row, name = tokens(piece.column("text"))
                kind, within, final = known.value(name)
                ids.append(piece.column("doc_id")), counts.append(np.bincount(row, minlength=n))
                sums.append(np.bincount(row, own.log_p(around(row, kind, own.classes), kind) + within, minlength=n))
                names.append(name[~final]), rows.append(row[~final] + docs_held)
                docs_held, held = docs_held + n, held + len(names[-1])
                if held >= _HELD or docs_held >= _HELD:
                    yield made()
                    at, ids, counts, sums, names, rows, docs_held, held = at + 1, [], [], [], [], [], 0, 0
        if ids:
            yield made()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document of a piece, the sum of the logarithms of its words' counts; a part's counts come before its words."""
        part, known_names, log_n = None, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for piece, own, kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "kind", "a", "b")), strict=True):
                if own != part:
                    part, known_names, log_n = own, np.zeros(0, np.uint64), np.zeros(0)
                name = np.frombuffer(a, np.uint64)
                if kind == 0:
                    known_names, log_n = name, np.log(np.frombuffer(b, np.int64))
                elif len(known_names):
                    at = np.minimum(np.searchsorted(known_names, name), len(known_names) - 1)
                    docs_, place = np.unique(np.frombuffer(b, np.uint32), return_inverse=True)
                    more = np.bincount(place, np.where(known_names[at] == name, log_n[at], 0))
                    yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([1], pa.int32()), pa.array([docs_.tobytes()], pa.binary()), pa.array([more.tobytes()], pa.binary())], ["piece", "kind", "a", "b"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, count, total = None, None, None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, pa.array(count), pa.array(total), pa.array(total / np.maximum(count, 1), mask=count == 0)], ["doc_id", "n_tokens", "log_likelihood", "per_token"])

        for batch in batches:
            for i in range(batch.num_rows):
                piece, kind, a, b = (batch.column(c)[i].as_py() for c in ("piece", "kind", "a", "b"))
                if kind == 0:
                    if at is not None:
                        yield made()
                    at, ids, count, total = piece, batch.column("ids")[i].values, np.frombuffer(a, np.int64), np.frombuffer(b, np.float64).copy()
                else:
                    total[np.frombuffer(a, np.uint32)] += np.frombuffer(b, np.float64)
        if at is not None:
            yield made()

    first = stored(docs.select(F.spark_partition_id().cast("long").alias("piece"), "doc_id", "text").mapInArrow(each, f"piece long, part int, kind int, ids array<{kind_of_id}>, a binary, b binary"), "lm-scores")
    counts = words.counts.select(F.lit(0).cast("long").alias("piece"), "part", F.lit(0).alias("kind"), F.col("names").alias("a"), F.col("n").alias("b"))
    asked = counts.unionByName(first.filter("kind = 1").select("piece", "part", "kind", "a", "b"))
    found = asked.repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(look_up, "piece long, kind int, a binary, b binary")
    rows = first.filter("kind = 0").select("piece", "kind", "ids", "a", "b").unionByName(found.withColumn("ids", F.lit(None).cast(f"array<{kind_of_id}>")))
    return rows.repartition(tasks, "piece").sortWithinPartitions("piece", "kind").mapInArrow(add, f"doc_id {kind_of_id}, n_tokens long, log_likelihood double, per_token double")


def train_and_score(docs: DataFrame, **options) -> DataFrame:
    words = count_words(docs)
    return score(docs, words, train(docs, words, **options))
