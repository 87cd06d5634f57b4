"""The longest feudal ways: on graphs with very many of them, and on cycles."""

import random

from pyspark.sql import functions as F

from cadastra.operators import hierarchy


def levels(spark, edges, feudal):
    """By year 1; places in feudal count."""
    frame = spark.createDataFrame([(1, c, p, 1) for p, c in edges], "year int, child_id string, parent_id string, pos int")
    ids = sorted({x for e in edges for x in e})
    places = spark.createDataFrame([(i, "territory", "county" if i in feudal else "office") for i in ids], "id string, kind string, place_type string")
    return {r.id: r.level for r in hierarchy.levels(frame, places, "root", "feudal").collect()}


def test_forty_layers_of_diamonds(spark):
    edges, above = [], ["root"]
    for k in range(40):
        pair = [f"n{k}a", f"n{k}b"]
        edges += [(p, c) for p in above for c in pair]
        above = pair
    edges += [("root", "n39a"), ("n0a", "n30b")]
    feudal = {f"n{k}a" for k in range(40)} | {"n39b"}
    assert levels(spark, edges, feudal) == {f"n{k}a": k + 1 for k in range(40)} | {"n39b": 40}


def test_cycles_against_all_simple_ways(spark):
    rng = random.Random(3)
    ids = ["root", *[f"p{i}" for i in range(9)]]
    edges = sorted({(rng.choice(ids), rng.choice(ids[1:])) for _ in range(17)} | {("root", "p0"), ("p1", "p2"), ("p2", "p1"), ("p2", "p2")})
    feudal = set(ids[1:7])
    best = {}

    def walk(at, seen, level):
        for p, c in edges:
            if p == at and c not in seen:
                on = level + (c in feudal)
                best[c] = max(best.get(c, 0), on)
                walk(c, seen | {c}, on)

    walk("root", {"root"}, 0)
    assert levels(spark, edges, feudal) == {c: n for c, n in best.items() if c in feudal}
    knots = {}
    for r in hierarchy.on_cycles(spark.createDataFrame(edges, "parent_id string, child_id string")).collect():
        knots.setdefault(r.knot, set()).add(r.id)
    reach = {a: {a} for a in ids}
    for _ in ids:
        for p, c in edges:
            for a in ids:
                if p in reach[a]:
                    reach[a].add(c)
    want = {frozenset(b for b in ids if b in reach[a] and a in reach[b]) for a in ids}
    assert {frozenset(k) for k in knots.values()} == {k for k in want if len(k) > 1}
