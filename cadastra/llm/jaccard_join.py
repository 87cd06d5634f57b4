"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words (lower case, between white
space; a text of one to four words is one shingle). Texts with equal sets are
one class from the start, so what is joined are different sets.

Chosen path: in each run a set goes to a bucket for every token j it has with
r(j) < 1 / (similarity * size), for a random r that all sets share; two sets of
at least that similarity share one bucket a run on average, or more. The runs
are repeated until two such sets share at least needs buckets with the target
recall; sets that share fewer than that with all others together drop out, so a
passage or a line in common brings few texts further. A bucket of more than
limit sets is split again on tokens sampled in the same way below its own path,
deep_runs times; one that does not split, because its sets are alike, stays
whole, which a split of limit / 4 of its members or so decides beforehand. That
choice is of cost alone: a whole bucket is compared in all its pairs. A pair that shares n buckets is missed by a split of all with a
probability of exp(-deep_runs * n).

Brute force: the buckets whose smallest member is the same are compared
together (their home), in blocks of at most block sets a side, so neither a
common passage nor a large group of near copies fills one task. Of a home of
more than one block, the members that are so like its smallest one that any two
of them must be similar (half the distance allowed, as Jaccard distances obey
the triangle inequality) are a ball: they are linked without being compared, and
blocks of one ball don't meet. Exact intersections decide the rest; of a shingle's hash, 48 bits are kept. A pair that meets in several homes counts in the smallest
only; no list of pairs is made. Links join to classes by connected components.

Result, one row per document: doc_id, class_id (the smallest id in its class)
and n_links, the documents it is linked to by a similarity of at least 0.8,
copies included.

Null and empty texts have no shingles: they are classes of their own without
links. A row with a null id is known by its text. Rows that share an id share
their text: they are copies. Ties have no effect: classes and links are those of
sets. A text of any length is one set, held as a whole. Columns other than
doc_id and text aren't read; keep_one() keeps all, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import Rolling, mix64, runs, slices, stored, text_bytes, tidied

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_C = np.uint64(0x9E3779B97F4A7C15)
_TOP = float(1 << 64)


def _seed(*at: int) -> np.uint64:
    x = 0
    for a in at:
        x = int(mix64(np.array([(x + a * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64)], np.uint64))[0])
    return np.uint64(x)


def runs_for(target: float, needs: int) -> int:
    """The runs after which a Poisson number with that mean reaches needs with the target probability."""
    n = needs
    while sum(math.exp(-n + i * math.log(n) - math.lgamma(i + 1)) for i in range(needs)) > 1 - target:
        n += 1
    return n


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order."""
    data, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    row, start, end = runs(data, _WHITE[data], owner)
    word = Rolling(data).spans(start, end)
    count = np.bincount(row, minlength=n)
    x = word.copy()
    for j in range(1, width):
        x[: len(x) - j] = mix64(x[: len(x) - j] * _C + word[j:])
    whole = np.zeros(len(word), bool)
    whole[: max(0, len(word) - width + 1)] = row[: max(0, len(word) - width + 1)] == row[width - 1 :]
    r, h = row[whole], x[whole]
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        y = word[first[short]]
        for j in range(1, width - 1):
            more = count[short] > j
            y[more] = mix64(y[more] * _C + word[first[short][more] + j])
        r, h = np.concatenate([r, short]), np.concatenate([h, mix64(y + count[short].astype(np.uint64))])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def chosen(row: np.ndarray, token: np.ndarray, size: np.ndarray, similarity: float, n_runs: int, path: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the buckets that each row chooses, below a path where one is given for each token."""
    most = np.minimum(_TOP - 4096, _TOP / (similarity * np.maximum(size, 1))).astype(np.uint64)[row]
    below = token if path is None else token ^ mix64(path)
    rows, keys = [], []
    for r in range(n_runs):
        hit = np.flatnonzero(mix64(below ^ _seed(r)) < most)
        rows.append(row[hit])
        keys.append(mix64(below[hit] + _seed(r, 1)))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def _lists(row: np.ndarray, value: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32()), pa.array(value.view(np.int64)))


def _summed(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The wrapping sum of each row's values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    end = np.cumsum(np.bincount(row, minlength=n))
    return total[end] - total[np.concatenate([[0], end[:-1]]).astype(np.int64)]


def described(docs: DataFrame, similarity: float, n_runs: int) -> DataFrame:
    """node, doc_id, size, a and b (a 128-bit fingerprint of the set), keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                row, token = shingle_sets(part.column("text"))
                size = np.bincount(row, minlength=n)
                a, b = _summed(row, mix64(token), n), _summed(row, mix64(token ^ _C), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("doc_id"), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(*chosen(row, token, size, similarity, n_runs), n)],
                    ["node", "doc_id", "size", "a", "b", "keys"],
                )

    return _known(docs).mapInArrow(tidied(each), "node long, doc_id long, size long, a long, b long, keys array<long>")


def _known(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.xxhash64(text)).alias("node"), "doc_id", text.alias("text"))


def packed_tokens(token: np.ndarray) -> bytes:
    """The upper 48 bits of each number: what is stored and sent of a set."""
    return np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked_tokens(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _token_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, tokens (sorted numbers, 48 bits of each) of the nodes. Texts are compressed before they are shuffled."""

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                view = memoryview(np.ascontiguousarray(data))
                cut = offsets.tolist()
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([squeeze.compress(view[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["node", "packed"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                text = pa.array([zstandard.decompress(z) if z else b"" for z in rows.column("packed").to_pylist()], pa.binary()).cast(pa.string())
                for part in slices(pa.RecordBatch.from_arrays([rows.column("node"), text], ["node", "text"]), "text"):
                    row, token = shingle_sets(part.column("text"))
                    cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                    sets = [packed_tokens(token[cut[i] : cut[i + 1]]) for i in range(part.num_rows)]
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "tokens"])

    packed = _known(docs).select("node", "text").mapInArrow(tidied(squeezed), "node long, packed binary")
    rows = packed.join(nodes, "node").dropDuplicates(["node"])
    return rows.mapInArrow(tidied(each), "node long, tokens binary")


def _split(sets: DataFrame, hot: DataFrame, similarity: float, n_runs: int) -> DataFrame:
    """node, parent, key: what the members of hot buckets (node, key) choose below them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parents, keys = [], [], []
            for node, tokens, paths in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                token = unpacked_tokens(tokens)
                path = np.array(paths, np.int64).view(np.uint64)
                row = np.repeat(np.arange(len(path)), len(token))
                r, k = chosen(row, np.tile(token, len(path)), np.full(len(path), len(token)), similarity, n_runs, path[row])
                nodes.append(np.full(len(r), node)), parents.append(path[r].view(np.int64)), keys.append(k.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, parents, keys)], ["node", "parent", "key"])

    paths = hot.groupBy("node").agg(F.collect_list("key").alias("paths"))
    return sets.join(paths, "node").mapInArrow(tidied(each), "node long, parent long, key long").distinct()


def buckets(sets: DataFrame, first: DataFrame, similarity: float, n_runs: int, limit: int, depth: int) -> DataFrame:
    """node, key: the final buckets, of two sets at least. first: node, key, n (the bucket's size)."""
    final, now = [], first
    for level in range(depth):
        hot = now.filter(F.col("n") > limit)
        final.append(now.filter(F.col("n") <= limit).select("node", "key"))
        if level == depth - 1 or hot.isEmpty():
            final.append(hot.select("node", "key"))
            break
        # A bucket of which a half or more of some members stays together is of sets that are alike: it stays whole, and all its members are compared.
        some = hot.filter(F.pmod(F.xxhash64("node", "key"), F.col("n")) < limit // 4).select("node", "key")
        tried = _split(sets, some, similarity, n_runs).groupBy(F.col("parent").alias("key"), F.col("key").alias("part")).agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("most"))
        whole = some.groupBy("key").agg(F.count("*").alias("n")).join(tried, "key", "left")
        whole = stored(whole.filter(F.coalesce("most", F.lit(0)) * 2 >= F.col("n")).select("key"), "join-whole")
        final.append(hot.join(whole, "key", "left_semi").select("node", "key"))
        split = stored(_split(sets, hot.join(whole, "key", "left_anti").select("node", "key"), similarity, n_runs), "join-split")
        count = split.groupBy("parent", "key").agg(F.count("*").alias("n"))
        parts = split.join(count.filter("n >= 2"), ["parent", "key"])
        now = stored(parts.select("node", "key", "n"), "join-level")
    out = final[0]
    for x in final[1:]:
        out = out.unionByName(x)
    return out


def compare(tokens: list[np.ndarray], homes: list[np.ndarray], keys: list[np.ndarray], weight: np.ndarray, home: int, left: np.ndarray, right: np.ndarray, similarity: float, ball: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, leader) of each member of one home: the weight of the members it is linked to, and the smallest index in its component.

    left and right: the members of the two blocks; the same array for a block with itself. ball: each member's, -1 for
    none; members of one ball are linked elsewhere.
    """
    n = len(tokens)
    size = np.array([len(t) for t in tokens])
    meets = _meet(n, [k[h == home] for h, k in zip(homes, keys, strict=True)], left, right)
    before = _meet(n, [k[h < home] for h, k in zip(homes, keys, strict=True)], left, right)
    open_ = (meets > 0) & (before == 0) & (left[:, None] != right[None, :])
    if ball is not None:
        open_ &= (ball[left][:, None] < 0) | (ball[left][:, None] != ball[right][None, :])
    # |a & b| <= min(|a|, |b|), so sizes too far apart can't be similar.
    small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
    open_ &= small >= similarity * large - 1e-9
    links, leader = np.zeros(n, np.int64), np.arange(n)
    if not open_.any():
        return links, leader
    own = set(left[open_.any(1)].tolist()) | set(right[open_.any(0)].tolist())
    both = _meet(n, [t if i in own else t[:0] for i, t in enumerate(tokens)], left, right)
    linked = open_ & (both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-6)
    links += np.bincount(left, (linked * weight[right][None, :]).sum(1), minlength=n).astype(np.int64)
    if left is not right:
        links += np.bincount(right, (linked * weight[left][:, None]).sum(0), minlength=n).astype(np.int64)
    a, b = np.nonzero(linked)
    a, b = left[a], right[b]
    while True:
        least = leader.copy()
        np.minimum.at(least, a, leader[b])
        np.minimum.at(least, b, leader[a])
        least = least[least]
        if (least == leader).all():
            return links, leader
        leader = least


def _meet(n: int, values: list[np.ndarray], left: np.ndarray, right: np.ndarray, wide: int = 4096) -> np.ndarray:
    """How many values each pair of members shares; values that only one member has are left out first."""
    row = np.repeat(np.arange(n), [len(v) for v in values])
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(row):
        return out
    _, column, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(number[-1]) + 1
    for at in range(0, total, wide):
        a, b = np.searchsorted(column, [at, at + wide])
        m = np.zeros((n, min(wide, total - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return out


def _brute_force(rows: DataFrame, similarity: float) -> DataFrame:
    """node, links, leader. rows: home, i, j, side, node, weight, tokens, homes, keys, ball in order of (home, i, j) within a partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, out = [], None, []

        def done() -> None:
            home, i, j = at
            nodes, weight = [g[4] for g in group], np.array([g[5] for g in group])
            tokens = [unpacked_tokens(g[6]) for g in group]
            homes, keys = ([np.array(g[c], np.int64) for g in group] for c in (7, 8))
            side = np.array([g[3] for g in group])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if i == j else 1))
            # Balls are named by nodes, which may be any number: here by their place in the group.
            names: dict = {None: -1}
            ball = np.array([names.setdefault(g[9], len(names)) for g in group])
            links, leader = compare(tokens, homes, keys, weight, home, left, left if i == j else right, similarity, ball)
            out.extend((nodes[x], int(links[x]), nodes[leader[x]]) for x in np.flatnonzero(links).tolist())

        def block() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["node", "links", "leader"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if group:
                        done()
                    group, at = [], row[:3]
                    if len(out) > 10_000:
                        yield block()
                group.append(row)
        if group:
            done()
        yield block()

    return rows.mapInArrow(tidied(each), "node long, links long, leader long")


def balls(at: DataFrame, tokens: DataFrame, similarity: float, block: int) -> DataFrame:
    """node, ball: the members of homes that lie within half the allowed distance of the home's own set; in the smallest such home. at: home, node."""
    big = at.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = at.join(big, "home").select("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("what"), "node")
    centres = big.select("home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("what"), F.col("home").alias("node"))
    rows = centres.unionByName(members).join(tokens, "node").select("home", "part", "what", "node", "tokens")
    least = 1 - (1 - similarity) / 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for home, part, what, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpacked_tokens(raw)
                if what == 0:
                    at_, centre = (home, part), own
                elif (home, part) == at_:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    if both >= least * (len(own) + len(centre) - both):
                        out.append((node, home))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], ["node", "ball"])

    found = rows.repartition("home", "part").sortWithinPartitions("home", "part", "what").mapInArrow(tidied(each), "node long, ball long")
    return found.groupBy("node").agg(F.min("ball").alias("ball"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), by large-star and small-star rounds until nothing changes. edges: node, leader."""
    e = stored(edges.filter(F.col("node") != F.col("leader")).select(F.greatest("node", "leader").alias("u"), F.least("node", "leader").alias("v")).distinct(), "components")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u <> v").distinct(), "components")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def jaccard_classes(docs: DataFrame, similarity: float = 0.8, target_recall: float = 0.99999, needs: int = 6, deep_runs: int = 2, limit: int = 256, depth: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, class_id, n_links of every row, and node (its id, or a hash of its text where that is null)."""
    n_runs = runs_for(target_recall, needs)
    texts = stored(described(docs, similarity, n_runs), "join-texts")
    full = texts.filter("size > 0")
    sets = stored(full.groupBy("a", "b").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.min_by("keys", "node").alias("keys")), "join-sets")
    pairs = sets.select("node", F.explode("keys").alias("key"))
    count = pairs.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2")
    met = stored(pairs.join(count, "key").select("node", "key", "n"), "join-met")
    first = met.join(met.groupBy("node").agg(F.count("*").alias("met")).filter(F.col("met") >= needs), "node", "left_semi")
    first = stored(first.select("node", "key", "n"), "join-first")
    tokens = stored(_token_sets(docs, first.select("node").distinct()), "join-tokens")
    members = stored(buckets(tokens, first, similarity, deep_runs, limit, depth), "join-buckets")
    home = members.groupBy("key").agg(F.min("node").alias("home"))
    placed = stored(members.join(home, "key"), "join-homes")
    known = placed.groupBy("node").agg(F.collect_list("home").alias("homes"), F.collect_list("key").alias("keys"))
    at = stored(placed.select("home", "node").distinct(), "join-members")
    # Most homes are one block. Only the members of larger ones are counted, dealt and compared block by block.
    large = stored(at.groupBy("home").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("home"), "join-large")
    in_large = stored(at.join(large, "home", "left_semi"), "join-in-large")
    ball = stored(balls(in_large, tokens, similarity, block), "join-balls")
    # Members of one ball may meet in a small home too, where they aren't compared either.
    small = at.join(large, "home", "left_anti").join(ball, "node", "left").select("home", "node", "ball", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    at = in_large.join(ball, "node", "left")
    # A home's members are dealt to blocks, those of a ball apart from the others; blocks are numbered along the home.
    parts = at.groupBy("home", "ball").agg(F.ceil(F.count("*") / block).cast("int").alias("own_blocks"))
    along = Window.partitionBy("home").orderBy(F.col("ball").isNotNull(), "ball")
    parts = parts.withColumn("upto", F.sum("own_blocks").over(along)).withColumn("blocks", F.sum("own_blocks").over(Window.partitionBy("home")))
    parts = parts.select("home", F.col("ball").alias("of"), "own_blocks", (F.col("upto") - F.col("own_blocks")).cast("int").alias("first_block"), F.col("blocks").cast("int").alias("blocks"))
    at = at.join(parts.withColumnRenamed("home", "h"), (F.col("home") == F.col("h")) & F.col("ball").eqNullSafe(F.col("of"))).withColumn("own", (F.col("first_block") + F.pmod(F.xxhash64("node"), F.col("own_blocks"))).cast("int"))
    # Each block meets itself and every other one once, but for those of its own ball.
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.col("ball").isNull() | (o < F.col("first_block")) | (o >= F.col("first_block") + F.col("own_blocks")))
    at = at.withColumn("other", F.explode(other)).select("home", "node", "ball", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    at = small.unionByName(at)
    rows = at.join(tokens.join(known, "node").join(sets.select("node", "weight"), "node"), "node").select("home", "i", "j", "side", "node", "weight", "tokens", "homes", "keys", "ball")
    found = stored(_brute_force(rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j", "node"), similarity), "join-links")
    inside = ball.join(sets.select("node", "weight"), "node")
    inside = inside.join(inside.groupBy("ball").agg(F.sum("weight").alias("all")), "ball").select("node", (F.col("all") - F.col("weight")).alias("links"), F.col("ball").alias("leader"))
    found = found.unionByName(inside)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "leader"))
    named = sets.select("a", "b", "node", "least_id", "weight").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "join-classes")
    least = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(least, "root").select("a", "b", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = full.join(named, ["a", "b"]).select("doc_id", "class_id", "n_links", "node")
    return linked.unionByName(texts.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "node"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one of each class (the one with the smallest id), with all their columns.

    Texts without shingles and rows without an id that aren't linked all stay.
    """
    found = jaccard_classes(docs, **options)
    gone = found.filter(F.col("class_id").isNotNull() & (~F.col("class_id").eqNullSafe(F.col("doc_id")))).select(F.col("node").alias("j_node")).distinct()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.xxhash64(text)).alias("j_node"))
    return rows.join(gone, "j_node", "left_anti").select("row.*")
