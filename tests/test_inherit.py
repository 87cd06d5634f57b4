"""What places inherit, from summaries and runs of years of those that they inherit from."""

import random

from cadastra.operators import snapshot

FORCE = "seq long, year int, place_id string, right_type string, holder_id string, share string, status string, is_disputed boolean, disputed_with array<string>, from_year int, to_year int"


def test_summaries_and_runs_are_those_of_all_rows(spark):
    pick = random.Random(3)
    places = ["r", "n1", "n2", *[f"c{i}" for i in range(12)]]
    rows = [(i, pick.randint(1, 6), pick.choice(places), pick.choice("ab"), pick.choice("xyz"), pick.choice([None, "1/2", "1/3"]), pick.choice(["held", "pledged", "claimed"]), pick.random() < 0.2, [], None, None) for i in range(70)]
    edges = [(y, c, p, pos) for y in range(1, 7) for c, p, pos in [("n1", "r", 1), ("n2", "r", 1), *[(f"c{i}", "n1" if i % 2 else "n2", 1) for i in range(12)], *([("c1", "n2", 2)] if y > 3 else [])]]
    force, entities = spark.createDataFrame(rows, FORCE), spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    edges = spark.createDataFrame(edges, "year int, child_id string, parent_id string, pos int")
    at = spark.createDataFrame([(p,) for p in places], "id string")
    every = snapshot.resolved_by_edges(force, edges, at)
    rows_of = lambda df, columns: sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))
    for want, got in ((snapshot.summarised(every, entities, [*snapshot.KEY, "inherited_from"]), snapshot.summarised_by_edges(force, edges, at, entities)), (snapshot.timeline(every), snapshot.timeline_by_edges(force, edges, at))):
        assert rows_of(got, want.columns) == rows_of(want, want.columns) != []
