"""Members of territories and the versions that they make."""

import hashlib

from cadastra.operators import hierarchy


def test_a_version_is_named_by_its_members(spark):
    names = [f"c{i}" for i in range(500)]
    rows = [(y, t, s) for y in (1, 2, 3) for t in ("a", "b") for s in names if s != "c7" or t == "a" or y == 3]
    sets = spark.createDataFrame(rows, "year int, territory string, settlement string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.territory, r.from_year, r.to_year, r.n_members): r.members_key for r in hierarchy.versions(sets, named=True).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    key = lambda some: hashlib.sha256("|".join(sorted(some)).encode()).hexdigest()
    less = key(set(names) - {"c7"})
    assert got == {("a", 1, 3, 500): key(names), ("b", 1, 2, 499): less, ("b", 3, 3, 500): key(names)}


def test_parents_that_lead_to_one_territory(spark):
    edges = [(1, "c1", "n1", 1), (1, "c1", "n2", 2), (2, "c1", "n1", 1), (1, "c1", "n1", 3), (1, "n1", "r", 1), (1, "n2", "r", 1), (2, "n1", "r", 1), (1, "c2", "r", 1)]
    places = [("c1", "settlement", "x"), ("c2", "settlement", "x"), ("n1", "territory", "x"), ("n2", "territory", "x"), ("r", "territory", "x")]
    found = hierarchy.members(spark.createDataFrame(edges, "year int, child_id string, parent_id string, pos int"), spark.createDataFrame(places, "id string, kind string, place_type string"))
    assert sorted(map(tuple, found.collect())) == [(1, "n1", "c1"), (1, "n2", "c1"), (1, "r", "c1"), (1, "r", "c2"), (2, "n1", "c1"), (2, "r", "c1")]
