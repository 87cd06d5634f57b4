"""A Merkle manifest of a table: a tree a source, and one tree over the sources' roots.

A leaf is the SHA-256 (lower-case hex) of a row's fields, each "-" if null, else
its length in bytes, ":" and its value. Within a source leaves ascend by doc_id
(null first), rows with one doc_id by their leaves; the hex digests of every 16
consecutive nodes (of fewer at the end, even of one) make the node above, until
one is left. The sources' roots, ascending by the source's bytes (null first),
make the last tree in the same way. A null source is a source.

Superblocks: a node at place i of its tree belongs to bucket i / 16^k, and one
task's group collapses k levels of a bucket at once (applyInPandas), so a bucket
holds at most 16^k digests, however large its source is. The buckets' roots are
the nodes of the next round, until every tree is one node. Proofs come down the
same way: a bucket's nodes get their siblings within the bucket, and after them
those of the bucket's own root, which are the same for all of them. No list of
nodes is held whole anywhere; places come from one sort of the digests by range
and the counts of its partitions.

manifest() returns one row for each row: doc_id, source, leaf, changed (the leaf
of the changed row; null where nothing is changed), subroot, root and proof: an
array with a structure a level, from the leaf up, of the siblings to the left
and to the right, as one string of digests each. fold() computes a root from a
leaf and a proof; both are Spark functions, as is leaf(). Rows that are the same
are leaves of their own. Other columns than the five fields make no difference.
An empty table has no rows and no root. Texts of any length are hashed where
they are read and go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels that a superblock collapses: 16^3 digests, some hundred KB.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: Iterable[Column]) -> Column:
    """The digest of a row's fields."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one string: level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def placed(nodes: DataFrame, tree: str, order: Sequence[str], name: str) -> DataFrame:
    """nodes with place (from 0) in their tree, by order, and nodes, their number in the tree. (tree, *order) tells rows apart.

    The rows are sorted over all trees by range, so a large tree lies in many
    partitions; a row's place is that in its partition and the counts before it.
    """
    at = stored(nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id()), name)
    at = at.withColumn("part", F.shiftright("at", 33))
    counts = at.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    in_tree = Window.partitionBy(tree)
    before = F.sum("held").over(in_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(tree, "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(in_tree).alias("nodes"))
    return at.join(counts, [tree, "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _levels_of(nodes: int) -> int:
    """Levels of a tree of so many nodes."""
    levels = 0
    while nodes > 1:
        nodes = -(-nodes // FANOUT)
        levels += 1
    return levels


def _above(level: list[str]) -> list[str]:
    return [hashlib.sha256("".join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]


def _collapse(digests: list[str], levels: int) -> list[list[str]]:
    """The levels of a bucket, from the one given to the one above the last of levels."""
    out = [digests]
    for _ in range(levels):
        out.append(_above(out[-1]))
    return out


def reduce_once(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The buckets' roots: tree, place, nodes and digest of the next round, for trees of more than one node or one.

    nodes: tree, place, nodes, digest.
    """

    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        total = int(rows["nodes"].iloc[0])
        steps = min(levels, _levels_of(total))
        top = _collapse(rows["digest"].tolist(), steps)[-1]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1].tolist(), "place": [int(rows["bucket"].iloc[0])], "nodes": [-(-total // FANOUT**steps)], "digest": top})

    rows = nodes.withColumn("bucket", F.expr(f"place div {FANOUT**levels}"))
    return rows.groupBy("tree", "bucket").applyInPandas(collapse, "tree string, place long, nodes long, digest string")


def reduced(nodes: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of every round, up to one node a tree; each round is stored. A round more for 16^levels times the nodes."""
    rounds = [nodes]
    while rounds[-1].where("nodes > 1").limit(1).count():
        rounds.append(stored(reduce_once(rounds[-1], levels), name))
    return rounds


_PROOF = "left array<string>, right array<string>"


def _bucket_proofs(digests: list[str], place: list[int], levels: int) -> tuple[list[list[str]], list[list[str]]]:
    """The siblings, to the left and to the right, of each node of a bucket at each of so many levels."""
    all_levels = _collapse(digests, levels)[:-1]
    left: list[list[str]] = [[] for _ in place]
    right: list[list[str]] = [[] for _ in place]
    for up, level in enumerate(all_levels):
        # A node's ancestors at this level share what is beside them, so each string is made once.
        beside = []
        for j in range(len(level)):
            run = j - j % FANOUT
            beside.append(("".join(level[run:j]), "".join(level[j + 1 : run + FANOUT])))
        for n in range(len(place)):
            a, b = beside[n // FANOUT**up]
            left[n].append(a)
            right[n].append(b)
    return left, right


def proofs(nodes: DataFrame, above: DataFrame, keep: str, levels: int = LEVELS) -> DataFrame:
    """nodes with the siblings up to their tree's root.

    nodes: tree, place, nodes, digest and the columns of keep (a schema); above:
    the next round's tree and place with left, right and top, the tree's root.
    """
    kept = [c.strip().split(" ")[0] for c in keep.split(",")] if keep else []

    def prove(rows: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        steps = min(levels, _levels_of(int(rows["nodes"].iloc[0])))
        left, right = _bucket_proofs(rows["digest"].tolist(), rows["place"].tolist(), steps)
        upper_left, upper_right = list(bucket["left"].iloc[0]), list(bucket["right"].iloc[0])
        out = rows[["tree", "place", "digest", *kept]].copy()
        out["top"] = bucket["top"].iloc[0]
        out["left"] = [a + upper_left for a in left]
        out["right"] = [b + upper_right for b in right]
        return out

    rows = nodes.withColumn("bucket", F.expr(f"place div {FANOUT**levels}")).groupBy("tree", "bucket")
    above = above.withColumn("bucket", F.col("place")).select("tree", "bucket", "left", "right", "top").groupBy("tree", "bucket")
    schema = f"tree string, place long, digest string, {keep + ', ' if keep else ''}top string, {_PROOF}"
    return rows.cogroup(above).applyInPandas(prove, schema)


def _down(rounds: list[DataFrame], top: DataFrame, keep: str, name: str, levels: int) -> DataFrame:
    """The proofs of the first round's nodes. top: the last round's tree, place, left, right and top."""
    for i in range(len(rounds) - 2, -1, -1):
        top = proofs(rounds[i], top, "" if i else keep, levels)
        top = stored(top, name) if i else top
    return top


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A row's leaf, its source's subroot, the root and the proof. changed: the leaf of a changed row, null where it isn't."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # "-" comes before "="
    changed = F.lit(None).cast("string") if changed is None else changed
    own = docs.select(F.col("doc_id"), tree.alias("tree"), leaf([F.col(c) for c in FIELDS]).alias("digest"), changed.alias("changed"))
    own = stored(own.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = placed(own, "tree", ["doc_id", "digest", "row"], "merkle-places").drop("row")
    rounds = reduced(stored(rows, "merkle-nodes"), "merkle-round", levels)

    roots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    roots = placed(roots, "tree", ["of"], "merkle-roots")
    upper = reduced(stored(roots, "merkle-nodes"), "merkle-upper", levels)
    nothing = F.array().cast("array<string>")
    top = upper[-1].select("tree", "place", nothing.alias("left"), nothing.alias("right"), F.col("digest").alias("top"), *(["of", "digest"] if len(upper) == 1 else []))
    top = _down(upper, top, "of string", "merkle-upper", levels).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "left", "right", F.struct("digest", "top").alias("ends"))
    top = stored(top.select("tree", "place", "left", "right", F.concat("ends.digest", "ends.top").alias("top")), "merkle-tops")

    if len(rounds) == 1:
        found = rounds[0].join(top.drop("place"), "tree")
    else:
        found = _down(rounds, top, f"doc_id {kind}, changed string", "merkle-proofs", levels)
    return found.select(
        "doc_id",
        F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias("source"),
        F.col("digest").alias("leaf"),
        "changed",
        F.substring("top", 1, 64).alias("subroot"),
        F.substring("top", 65, 64).alias("root"),
        F.arrays_zip("left", "right").alias("proof"),
    )


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of docs, held against rows of which every fifth (by crc32 of its id) has the ASCII letters of its text lower-cased."""
    fields = [F.col(c) for c in FIELDS[:-1]] + [F.translate("text", UPPER, LOWER)]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(fields))
    found = manifest(docs, tampered).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(depth: int = 6) -> str:
    """DuckDB SQL for audit(), for trees of at most 16^depth nodes."""

    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"

    def levels(s: str) -> str:
        return "".join(
            f", {s}{k + 1} AS (SELECT tree, i // {FANOUT} AS i, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(h, '' ORDER BY {s}{k}.i)) AS h FROM {s}{k} WHERE n > 1 GROUP BY tree, {s}{k}.i // {FANOUT}, n)" for k in range(depth)
        )

    def climb(s: str, f: str) -> str:
        out = ""
        for k in range(depth):
            out += f""", {s}_beside{k} AS (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {s}{k} a JOIN {s}{k} b ON a.tree = b.tree AND a.i // {FANOUT} = b.i // {FANOUT} WHERE a.n > 1 GROUP BY a.tree, a.i)
, {f}{k + 1} AS (SELECT doc_id, leaf, own, tree, i // {FANOUT} AS i, CASE WHEN l IS NULL THEN h ELSE sha256(l || h || r) END AS h, p || coalesce(l || r, '') AS p FROM {f}{k} LEFT JOIN {s}_beside{k} USING (tree, i))"""
        return out

    known = " || ".join(field(c) for c in FIELDS[:-1])
    crc_byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: {crc_byte}), 4294967295)"
    roots = " UNION ALL ".join(f"SELECT tree, h FROM s{k} WHERE n = 1" for k in range(depth + 1))
    top = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(depth + 1))
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256({known} || {field("text")}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({known} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed FROM documents)
, numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves)
, s0 AS (SELECT tree, i, n, leaf AS h FROM numbered){levels("s")}
, subroots AS ({roots})
, t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree AS own FROM subroots){levels("t")}
, top AS ({top})
, f0 AS (SELECT doc_id, leaf, tree AS own, tree, i, coalesce(changed, leaf) AS h, '' AS p FROM numbered){climb("s", "f")}
, g0 AS (SELECT f.doc_id, f.leaf, f.own, '' AS tree, t0.i, f.h, f.p FROM f{depth} f JOIN t0 ON t0.own = f.own){climb("t", "g")}
SELECT doc_id, leaf, t0.h AS subroot, top.h AS root, sha256(p) AS proof_sha256, g.h AS folded_root, g.h = top.h AS verified
FROM g{depth} g JOIN t0 ON t0.own = g.own CROSS JOIN top
"""
