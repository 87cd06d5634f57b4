"""Ancestors, descendants, levels and cycles of a dated, cyclic, multi-parent hierarchy.

Walks go level by level over DataFrames; each level is a table in the shared
folder, so plans don't grow with depth. Places without members are joined once,
at the end: only the inner graph is walked.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.temporal import is_active, years_of
from cadastra.operators.shared import stored

#: The kinds of realms of the feudal hierarchy.
FEUDAL = ("principality", "marquisate", "county", "barony", "lordship", "fief", "advocacy", "allod")


def year_edges(memberships: DataFrame, year: int) -> DataFrame:
    """year, child_id, parent_id, pos of the memberships in force."""
    return memberships.filter(is_active(F.col("from_year"), F.col("to_year"), year)).select(F.lit(year).alias("year"), "child_id", "parent_id", "pos")


def edges_by_year(memberships: DataFrame, first: int, last: int) -> DataFrame:
    return memberships.select(F.explode(years_of(F.col("from_year"), F.col("to_year"), first, last)).alias("year"), "child_id", "parent_id", "pos")


def children(edges: DataFrame) -> DataFrame:
    """parent_id and its members."""
    return edges.groupBy("year", "parent_id").agg(F.array_sort(F.collect_set("child_id")).alias("members"), F.count_distinct("child_id").alias("n_members"))


def _walk(edges: DataFrame) -> DataFrame:
    """year, id, ancestor, depth, path: the first of the shortest ways up to each ancestor. It ends where a step finds nobody new, whatever the depth."""
    level = edges.groupBy("year", F.col("child_id").alias("id"), F.col("parent_id").alias("ancestor")).agg(F.min("pos").alias("pos")).filter("id <> ancestor")
    level = stored(level.select("year", "id", "ancestor", F.lit(1).alias("depth"), F.array("pos").alias("path")), "ancestors")
    found, depth = level, 1
    up = edges.select("year", F.col("child_id").alias("ancestor"), F.col("parent_id").alias("next"), "pos")
    while not level.isEmpty():
        depth += 1
        step = level.join(up, ["year", "ancestor"]).filter("next <> id")
        step = step.groupBy("year", "id", F.col("next").alias("ancestor")).agg(F.min(F.array_append("path", F.col("pos"))).alias("path"))
        level = step.join(found.select("year", "id", "ancestor"), ["year", "id", "ancestor"], "left_anti")
        level = stored(level.select("year", "id", "ancestor", F.lit(depth).alias("depth"), "path"), "ancestors")
        found = found.unionByName(level)
    return found


def inner_ancestors(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ancestors of all that have members themselves, and the edges of those that have none."""
    parents = edges.select("year", F.col("parent_id").alias("child_id")).distinct()
    inner = edges.join(parents, ["year", "child_id"], "left_semi").select(*edges.columns)
    return stored(_walk(inner), "ancestors-inner"), edges.join(parents, ["year", "child_id"], "left_anti").select(*edges.columns)


def ancestors(edges: DataFrame) -> DataFrame:
    """year, id, ancestor, depth, path: nearest first by (depth, path), the order of a breadth-first search.

    path holds the positions of the parents on the way; a cycle ends at a place already seen.
    """
    walked, outer = inner_ancestors(edges)
    leaves = outer.select("year", F.col("child_id").alias("id"), F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth"), F.array("pos").alias("path"))
    above = leaves.select("year", F.col("id").alias("leaf"), F.col("ancestor").alias("id"), F.col("path").alias("own"))
    above = above.join(walked, ["year", "id"]).select("year", F.col("leaf").alias("id"), "ancestor", (F.col("depth") + 1).alias("depth"), F.concat("own", "path").alias("path"))
    first = leaves.unionByName(above).groupBy("year", "id", "ancestor").agg(F.min(F.struct("depth", "path")).alias("k"))
    return walked.unionByName(first.select("year", "id", "ancestor", "k.depth", "k.path"))


def members(edges: DataFrame, places: DataFrame, no_land: tuple[str, ...] = ()) -> DataFrame:
    """year, territory, settlement: the settlements under each territory; a settlement ends the way down.

    Settlements of a type in no_land are walked through like territories. A settlement's parents come together in one
    row first; only in a year in which it has several may two of them lead to one territory.
    """
    kinds = places.select("id", ((F.col("kind") == "settlement") & ~F.col("place_type").isin(*no_land, "")).alias("lands"))
    down = edges.join(kinds.withColumnRenamed("id", "child_id"), "child_id")
    inner = down.filter("not lands").select("year", "child_id", "parent_id", "pos")
    over = stored(_walk(inner), "members-inner").select("year", F.col("id").alias("parent_id"), F.col("ancestor").alias("territory"))
    every = over.unionByName(down.filter("lands").select("year", "parent_id", F.col("parent_id").alias("territory")).distinct())
    every = stored(every, "members-over")
    own = down.filter("lands").groupBy(F.col("child_id").alias("settlement")).agg(F.collect_set(F.struct("year", "parent_id")).alias("own"))
    several = lambda e: F.size(F.filter("own", lambda o: o["year"] == e["year"])) > 1
    marked = F.transform("own", lambda e: F.struct(e["year"].alias("year"), e["parent_id"].alias("parent_id"), several(e).alias("several")))
    direct = stored(own.select("settlement", F.explode(marked).alias("e")).select("settlement", "e.*"), "members-direct")
    found = lambda rows: rows.join(every, ["year", "parent_id"]).select("year", "territory", "settlement")
    return found(direct.where("not several")).unionByName(found(direct.where("several")).distinct())


def _set_key(member: str) -> Column:
    """A key of a set of texts, each given once, from sums of two hashes of them: no task holds a set."""
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), total(F.col(member)), total(F.lit(1), F.reverse(member), F.col(member))), 256)


def _named_keys(member_sets: DataFrame) -> DataFrame:
    """territory, year, members_key: the SHA-256 (hex) of each set's members in order, joined by a bar. Rows are read one after another in their order, so no task holds a set."""
    keys = ["territory", "year", "settlement"]
    rows = member_sets.select(*keys).repartition("territory", "year").sortWithinPartitions(*keys)

    def hashed(batches):
        at, digest = None, None
        for batch in batches:
            out = []
            for territory, year, settlement in zip(*(batch.column(k).to_pylist() for k in keys), strict=True):
                if (territory, year) != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (territory, year), hashlib.sha256(settlement.encode())
                else:
                    digest.update(b"|" + settlement.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, digest.hexdigest()), strict=True))], schema)

    names = ["territory", "year", "members_key"]
    schema = pa.schema([("territory", pa.string()), ("year", pa.int32()), ("members_key", pa.string())])
    return rows.mapInArrow(hashed, "territory string, year int, members_key string")


def versions(member_sets: DataFrame, named: bool = False) -> DataFrame:
    """territory, from_year, to_year, members_key, n_members: runs of years with one set of members.

    Sets are compared by keys from sums. named: members_key is the hash of the members' names in order instead, taken once a run.
    """
    by_year = member_sets.groupBy("territory", "year").agg(F.count("*").alias("n_members"), _set_key("settlement").alias("members_key"))
    along = Window.partitionBy("territory").orderBy("year")
    same = (F.lag("members_key").over(along) == F.col("members_key")) & (F.lag("year").over(along) == F.col("year") - 1)
    run = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(along)
    runs = by_year.withColumn("run", run).groupBy("territory", "run", "members_key", "n_members").agg(F.min("year").alias("from_year"), F.max("year").alias("to_year")).drop("run")
    if not named:
        return runs
    runs = stored(runs.drop("members_key"), "versions")
    first = runs.select("territory", F.col("from_year").alias("year"))
    return runs.join(_named_keys(member_sets.join(first, ["territory", "year"])).withColumnRenamed("year", "from_year"), ["territory", "from_year"])


def hierarchy_of(place_type):
    return F.when(place_type.isin(*FEUDAL), "feudal").otherwise("admin")


def levels(edges: DataFrame, places: DataFrame, root: str, hierarchy: str | None = None) -> DataFrame:
    """year, id, level of the territories under root.

    With a hierarchy, only its realms count on the way down: by the shortest way, or the longest of feudal realms.
    Both go by steps from the root, each keeping what it makes shorter or longer.
    """
    realm = places.filter("kind = 'territory'")
    counts = F.lit(1) if hierarchy is None else (hierarchy_of(F.col("place_type")) == hierarchy).cast("int")
    realm = realm.select(F.col("id").alias("child_id"), counts.alias("counts"))
    down = stored(edges.join(realm, "child_id").filter(F.col("child_id") != root).select("year", "parent_id", "child_id", "counts").distinct(), "levels-down")
    if hierarchy != "feudal":
        return _shortest(down, root)
    return _longest(down, root)


def on_cycles(edges: DataFrame) -> DataFrame:
    """id, knot of the places on cycles; places that reach each other have one knot. edges: parent_id, child_id.

    What no way comes into or goes out of is taken off first, until nothing changes. Then the largest id is passed
    forward to all that it reaches, and those of one id that also reach back to it are a knot; so on with the rest.
    """
    edges = stored(edges.select("parent_id", "child_id").where("parent_id <> child_id").distinct(), "knots")
    out = edges.sparkSession.createDataFrame([], "id string, knot string")
    while True:
        edges = _trimmed(edges)
        if edges.isEmpty():
            return out
        nodes = edges.select(F.col("parent_id").alias("id")).union(edges.select("child_id")).distinct()
        colour = stored(nodes.withColumn("colour", F.col("id")).withColumn("moved", F.lit(True)), "knots-colour")
        while not colour.where("moved").isEmpty():
            come = edges.join(colour.where("moved").select(F.col("id").alias("parent_id"), F.col("colour").alias("theirs")), "parent_id").groupBy(F.col("child_id").alias("id")).agg(F.max("theirs").alias("theirs"))
            better = F.coalesce(F.col("theirs") > F.col("colour"), F.lit(False))
            colour = stored(colour.drop("moved").join(come, "id", "left").select("id", F.when(better, F.col("theirs")).otherwise(F.col("colour")).alias("colour"), better.alias("moved")), "knots-colour")
        of = lambda c, name: colour.select(F.col("id").alias(c), F.col("colour").alias(name))
        same = stored(edges.join(of("parent_id", "a"), "parent_id").join(of("child_id", "b"), "child_id").where("a = b").select("parent_id", "child_id"), "knots-same")
        front = back = stored(colour.where("id = colour").select("id", F.col("colour").alias("knot")), "knots-back")
        while not front.isEmpty():
            step = same.join(front.select(F.col("id").alias("child_id"), "knot"), "child_id").select(F.col("parent_id").alias("id"), "knot").distinct()
            front = stored(step.join(back.select("id"), "id", "left_anti"), "knots-back")
            back = back.unionByName(front)
        back = stored(back, "knots-back")
        many = back.groupBy("knot").agg(F.count("*").alias("n")).where("n > 1").select("knot")
        out = out.unionByName(stored(back.join(many, "knot").select("id", "knot"), "knots"))
        gone = back.select("id")
        edges = stored(edges.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti").join(gone.withColumnRenamed("id", "child_id"), "child_id", "left_anti").select("parent_id", "child_id"), "knots")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that others lead to and lead on from, until all are such."""
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
        inner = inner.join(edges.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_semi")
        edges = stored(inner.select("parent_id", "child_id"), "knots")
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _longest(down: DataFrame, root: str) -> DataFrame:
    """year, id, level: the most realms that count on a way from root that passes no place twice. down: year, parent_id, child_id, counts (of the child).

    Without its cycles the hierarchy is layered, and the longest ways follow by steps, however many ways there are. A
    way enters a knot of cycles once; inside, all simple ways from where it enters are followed. Knots are faults in
    the data that validation reports, so they are small.
    """
    knots = stored(on_cycles(down), "levels-knots")
    of = lambda c: knots.select(F.col("id").alias(c), F.col("knot").alias("knot_" + c))
    down = stored(down.join(of("parent_id"), "parent_id", "left").join(of("child_id"), "child_id", "left").where("parent_id <> child_id"), "levels-down")
    inside = stored(down.where("knot_parent_id = knot_child_id").select("year", F.col("parent_id").alias("id"), F.col("child_id").alias("next"), "counts"), "levels-inside")
    across = down.where("knot_parent_id is null or knot_child_id is null or knot_parent_id <> knot_child_id")
    # A place of a knot stands twice: where a way enters (true) and where it may leave or end (false).
    entry = F.col("knot_child_id").isNotNull()
    steps = across.select("year", F.struct(F.col("parent_id").alias("id"), F.lit(False).alias("enters")).alias("a"), F.struct(F.col("child_id").alias("id"), entry.alias("enters")).alias("b"), F.col("counts").alias("more"))
    ways = across.where(entry).select("year", F.col("child_id").alias("start"), F.col("child_id").alias("id"), F.array("child_id").alias("seen"), F.lit(0).alias("more")).distinct()
    ways = found = stored(ways, "levels-ways")
    while not ways.isEmpty():
        on = ways.join(inside, ["year", "id"]).where(~F.array_contains("seen", F.col("next")))
        ways = stored(on.select("year", "start", F.col("next").alias("id"), F.array_append("seen", F.col("next")).alias("seen"), (F.col("more") + F.col("counts")).alias("more")).distinct(), "levels-ways")
        found = found.unionByName(ways)
    through = found.groupBy("year", "start", "id").agg(F.max("more").alias("more"))
    steps = steps.unionByName(through.select("year", F.struct(F.col("start").alias("id"), F.lit(True).alias("enters")).alias("a"), F.struct("id", F.lit(False).alias("enters")).alias("b"), "more"))
    steps = stored(steps, "levels-steps")
    at_root = F.struct(F.lit(root).alias("id"), F.lit(False).alias("enters"))
    best = front = stored(down.select("year").distinct().select("year", at_root.alias("a"), F.lit(0).alias("level")), "levels")
    while not front.isEmpty():
        step = front.join(steps, ["year", "a"]).groupBy("year", F.col("b").alias("a")).agg(F.max(F.col("level") + F.col("more")).alias("level"))
        front = stored(step.join(best.select("year", "a", F.col("level").alias("known")), ["year", "a"], "left").where("known is null or level > known").drop("known"), "levels")
        best = stored(best.unionByName(front).groupBy("year", "a").agg(F.max("level").alias("level")), "levels")
    counted = down.where("counts = 1").select("year", F.col("child_id").alias("id")).distinct()
    return best.where("not a.enters").select("year", "a.id", "level").join(counted, ["year", "id"])


def _shortest(down: DataFrame, root: str) -> DataFrame:
    step = down.filter(F.col("parent_id") == root).select("year", F.col("child_id").alias("id"), F.col("counts").alias("level"), "counts")
    best = front = stored(step.groupBy("year", "id", "counts").agg(F.min("level").alias("level")), "levels")
    while not front.isEmpty():
        step = front.select("year", F.col("id").alias("parent_id"), "level").join(down, ["year", "parent_id"])
        step = step.groupBy("year", F.col("child_id").alias("id"), "counts").agg(F.min(F.col("level") + F.col("counts")).alias("level"))
        known = best.select("year", "id", F.col("level").alias("known"))
        front = stored(step.join(known, ["year", "id"], "left").filter("known is null or level < known").drop("known"), "levels")
        best = stored(best.unionByName(front).groupBy("year", "id", "counts").agg(F.min("level").alias("level")), "levels")
    return best.filter("counts = 1").select("year", "id", "level")


def direct_members(edges: DataFrame, places: DataFrame, territory: str) -> DataFrame:
    """The members of one territory, with their kind."""
    return edges.filter(F.col("parent_id") == territory).select(F.col("child_id").alias("id")).distinct().join(places.select("id", "kind"), "id")


def contested(memberships: DataFrame, root: str, year: int) -> DataFrame:
    """Places whose membership of root is disputed in a year."""
    return memberships.filter((F.col("parent_id") == root) & F.col("is_disputed") & is_active(F.col("from_year"), F.col("to_year"), year)).select("child_id").distinct()


def cycles(memberships: DataFrame) -> DataFrame:
    """The memberships that lie on a cycle, whatever their years: seq of columns child_id, parent_id."""
    edges = memberships.select(F.lit(0).alias("year"), "child_id", "parent_id", F.lit(1).alias("pos")).distinct()
    inner = edges.join(edges.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_semi").select("year", "child_id", "parent_id", "pos")
    walked = _walk(inner).select(F.col("id").alias("parent_id"), F.col("ancestor").alias("child_id"))
    own = edges.filter("child_id = parent_id").select("child_id", "parent_id")
    return edges.join(walked, ["child_id", "parent_id"], "left_semi").select("child_id", "parent_id").unionByName(own).distinct()
