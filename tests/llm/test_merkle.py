"""The Merkle manifest against a tree built in plain Python, and against its SQL."""

import collections
import hashlib
import os
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus  # noqa: E402

from cadastra.llm import merkle  # noqa: E402


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    """The root, and each node's siblings by level."""
    paths, at, first = [[] for _ in nodes], list(range(len(nodes))), True
    while len(nodes) > 1 or (first and not nodes):
        first = False
        for n, i in enumerate(at):
            run = i - i % 16
            paths[n].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([m[2] for m in sorted(groups[s], key=lambda m: m[:3])]) for s in names}
    root, upper = tree_of([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for member, path in zip(sorted(groups[s], key=lambda m: m[:3]), trees[s][1]):
            row, own = member[3], member[2]
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                node = leaf_of(row, row[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER)))
            for left, right in path + above:
                node = digest(left + node + right)
            out.append((row[0], own, trees[s][0], root, digest("".join(a + b for a, b in path + above)), node, node == root))
    return out


def shaped(sizes, seed=2):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        rows += [(rng.randrange(10**6), rng.choice(["Ab C", "über Ä", "", None, "x" * 3000 + "Y", f"T{k}"]), rng.choice(["en", None]), source, rng.choice([1, None]), 1, 1, "c") for k in range(n)]
    rng.shuffle(rows)
    return rows


BIG = {"big": 700, None: 17, "é": 16, "a": 1, "=": 33}


@pytest.mark.parametrize("sizes, levels", [({"a": 1}, 2), ({None: 1, "": 1, "-": 1}, 1), (BIG, 1), (BIG, 2), (BIG, 3), ({f"s{i}": 1 + i % 3 for i in range(40)}, 3)])
def test_against_plain_trees(spark, monkeypatch, sizes, levels):
    rows = shaped(sizes)
    rows.append(rows[0])
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, levels))
    found = merkle.audit(spark.createDataFrame(rows, corpus.SCHEMA).repartition(3))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute(rows))


def test_awkward_rows_and_real_outputs(spark):
    rows = corpus.rows()
    docs = corpus.frame(spark)
    found = merkle.audit(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute(rows))
    whole = merkle.manifest(docs)
    assert whole.columns == ["doc_id", "source", "leaf", "changed", "subroot", "root", "proof"]
    assert whole.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert collections.Counter(r.source for r in whole.collect()) == collections.Counter(r[3] for r in rows)
    assert merkle.manifest(corpus.empty(spark)).count() == 0


def test_sql_twin(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    columns = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = duckdb.sql(f"SELECT {columns} FROM ({merkle.oracle()})").fetchall()
    assert collections.Counter(map(tuple, merkle.audit(documents).collect())) == collections.Counter(want)
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)
