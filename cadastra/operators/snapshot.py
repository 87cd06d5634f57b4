"""Who holds what in a year: the handover rule, inheritance, runs of years, disputes.

Rows of rights carry seq, their order in the source; it breaks every tie. Frames
that hold several years have a year column, so a year against periods is an
explosion of each period (bounded by first..last) and then equality, never a
range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.temporal import is_active, share_value, years_of
from cadastra.operators.hierarchy import inner_ancestors
from cadastra.operators.shared import stored

KEY = ["year", "place_id", "right_type"]
HOLDING = ("held", "pledged")


def active(rows: DataFrame, year: int) -> DataFrame:
    """The rows of a year, before the handover rule."""
    return rows.filter(is_active(F.col("from_year"), F.col("to_year"), year)).withColumn("year", F.lit(year))


def active_years(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.withColumn("year", F.explode(years_of(F.col("from_year"), F.col("to_year"), first, last)))


def in_force(act: DataFrame) -> DataFrame:
    """Drops the rows that end in a year in which another row of the place and right starts.

    A row stays if it starts in that year itself, or if its holder is among those that come in. Only rows that end
    in their year are joined.
    """
    leaves = F.coalesce(F.col("to_year") == F.col("year"), F.lit(False)) & ~F.coalesce(F.col("from_year") == F.col("year"), F.lit(False))
    comes = act.filter(F.col("from_year") == F.col("year")).select(*KEY, "holder_id").distinct()
    out = act.filter(leaves)
    untouched = out.join(comes.select(*KEY).distinct(), KEY, "left_anti")
    renewed = out.join(comes, [*KEY, "holder_id"], "left_semi").select(*act.columns)
    return act.filter(~leaves).unionByName(untouched).unionByName(renewed)


def snapshot(rights: DataFrame, year: int) -> DataFrame:
    return in_force(active(rights, year))


def snapshot_years(rights: DataFrame, first: int, last: int) -> DataFrame:
    return in_force(active_years(rights, first, last))


def rights_at_place(rights: DataFrame, place_id: str, year: int) -> DataFrame:
    """Own rows of every right at a place."""
    return snapshot(rights.filter(F.col("place_id") == place_id), year)


def direct_holdings(rights: DataFrame, holder_id: str, year: int) -> DataFrame:
    """A holder's own rows; the handover rule needs all holders, so the filter comes after it."""
    mine = rights.filter(F.col("holder_id") == holder_id).select("place_id", "right_type").distinct()
    return snapshot(rights.join(mine, ["place_id", "right_type"], "left_semi").select(*rights.columns), year).filter(F.col("holder_id") == holder_id)


def holdings_by_right(holdings: DataFrame) -> DataFrame:
    """Rows and places of each right."""
    return holdings.groupBy("right_type").agg(F.count("*").alias("n_rows"), F.count_distinct("place_id").alias("n_places"))


def summarised(rows: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """primary holder, shared, contested and the number of rows of each group.

    The primary has the largest share of those that hold or have it in pledge, then the best rank, then comes first.
    """
    ranked = rows.join(entities.select(F.col("id").alias("holder_id"), "rank"), "holder_id", "left")
    holds = F.col("status").isin(*HOLDING)
    order = F.struct((-share_value(F.col("share"))).alias("s"), F.coalesce("rank", F.lit(2**31 - 1)).alias("r"), F.col("seq").alias("q"))
    return ranked.groupBy(*keys).agg(
        F.min_by(F.when(holds, F.col("holder_id")), F.when(holds, order)).alias("primary_holder"),
        (F.count_distinct(F.when(holds, F.col("holder_id"))) > 1).alias("shared"),
        F.max(F.col("is_disputed") | F.col("status").isin("claimed", "contested")).alias("contested"),
        F.count("*").alias("n_rows"),
    )


def resolved(force: DataFrame, ancestors: DataFrame, places: DataFrame) -> DataFrame:
    """force's rows for each place: its own, else those of the nearest ancestor that has any for the right.

    ancestors: year, id, ancestor, depth, path. Adds inherited_from (null for own rows).
    """
    have = force.select(*KEY).distinct()
    near = ancestors.join(places.select("id"), "id", "left_semi").join(have.withColumnRenamed("place_id", "ancestor"), ["year", "ancestor"])
    nearest = near.groupBy("year", "id", "right_type").agg(F.min(F.struct("depth", "path", "ancestor"))["ancestor"].alias("ancestor"))
    return _with_inherited(force, nearest, have, places)


def nearest_by_edges(have: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """year, id, right_type, ancestor: the nearest above each place that has the right. have: KEY of the places that have one; edges: the memberships in force (year, child_id, parent_id, pos).

    The nearest that has a right is found once for each place with members; what has none takes it from its own
    parents. So rows are of a place and its parents, never of a place and all above it.
    """
    walked, outer = inner_ancestors(edges)
    inner = walked.join(have.withColumnRenamed("place_id", "ancestor"), ["year", "ancestor"])
    inner = stored(inner.groupBy("year", "id", "right_type").agg(F.min(F.struct("depth", "path", "ancestor")).alias("k")), "nearest")
    # A parent that has the right itself is nearer than anything above it.
    itself = have.join(outer.select("year", F.col("parent_id").alias("place_id")).distinct(), ["year", "place_id"], "left_semi")
    at = itself.select("year", F.col("place_id").alias("parent_id"), "right_type", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"), F.col("place_id").alias("ancestor"))
    above = inner.select("year", F.col("id").alias("parent_id"), "right_type", "k.*").join(itself.withColumnRenamed("place_id", "parent_id"), ["year", "parent_id", "right_type"], "left_anti")
    given = outer.join(at.unionByName(above.select(*at.columns)), ["year", "parent_id"])
    order = F.struct((F.col("depth") + 1).alias("depth"), F.concat(F.array("pos"), "path").alias("path"), "ancestor")
    leaves = given.groupBy("year", F.col("child_id").alias("id"), "right_type").agg(F.min(order).alias("k"))
    return inner.unionByName(leaves).select("year", "id", "right_type", "k.ancestor").join(places.select("id"), "id", "left_semi")


def resolved_by_edges(force: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """As resolved(), from the memberships in force."""
    have = force.select(*KEY).distinct()
    return _with_inherited(force, nearest_by_edges(have, edges, places), have, places)


def summarised_by_edges(force: DataFrame, edges: DataFrame, places: DataFrame, entities: DataFrame) -> DataFrame:
    """summarised() of what resolved_by_edges() gives, by KEY and inherited_from.

    A place that inherits has its ancestor's summary, so the ancestor's rows are summed up once and not sent to each place.
    """
    own = stored(summarised(force, entities, KEY), "summaries")
    have = own.select(*KEY)
    return _with_inherited(own, nearest_by_edges(have, edges, places), have, places)


def timeline_by_edges(force: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """timeline() of what resolved_by_edges() gives.

    The runs of an ancestor's rows are found once; a place that inherits has their overlaps with the runs of years in
    which it inherits from there. Both are as long as can be, so their overlaps are too.
    """
    same = ["right_type", "holder_id", "status", "share", "is_disputed"]
    runs = stored(runs_of_years(force, ["place_id", *same]), "runs")
    have = stored(force.select(*KEY).distinct(), "have")
    nearest = nearest_by_edges(have, edges, places).withColumnRenamed("id", "place_id").join(have, KEY, "left_anti")
    spans = stored(runs_of_years(nearest, ["place_id", "right_type", "ancestor"]), "spans").withColumnsRenamed({"from_run": "first", "to_run": "last"})
    columns = ["place_id", "right_type", "holder_id", "status", "share", "inherited_from", "is_disputed", "from_run", "to_run"]
    own = runs.join(places.select(F.col("id").alias("place_id")), "place_id", "left_semi").withColumn("inherited_from", F.lit(None).cast("string"))
    source = runs.withColumnRenamed("place_id", "ancestor").join(spans.select("ancestor").distinct(), "ancestor", "left_semi")
    above = spans.join(stored(source, "runs-above"), ["ancestor", "right_type"]).where("from_run <= last and first <= to_run")
    above = above.withColumns({"from_run": F.greatest("from_run", "first"), "to_run": F.least("to_run", "last")}).withColumnRenamed("ancestor", "inherited_from")
    return own.select(*columns).unionByName(above.select(*columns))


def _with_inherited(force: DataFrame, nearest: DataFrame, have: DataFrame, places: DataFrame) -> DataFrame:
    own = force.join(places.select(F.col("id").alias("place_id")), "place_id", "left_semi").select(*force.columns).withColumn("inherited_from", F.lit(None).cast("string"))
    nearest = nearest.withColumnRenamed("id", "place_id").join(have, KEY, "left_anti")
    above = force.withColumnRenamed("place_id", "ancestor").join(nearest, ["year", "right_type", "ancestor"])
    return own.unionByName(above.withColumnRenamed("ancestor", "inherited_from").select(*own.columns))


def runs_of_years(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, from_run, to_run: unbroken years of each key. Equal keys in one year count once."""
    once = rows.select("year", *key).distinct()
    island = F.col("year") - F.row_number().over(Window.partitionBy(*key).orderBy("year"))
    return once.withColumn("island", island).groupBy(*key, "island").agg(F.min("year").alias("from_run"), F.max("year").alias("to_run")).drop("island")


def timeline(resolved_years: DataFrame) -> DataFrame:
    """Runs of years with one holder, status, share, source of inheritance and dispute flag."""
    return runs_of_years(resolved_years, ["place_id", "right_type", "holder_id", "status", "share", "inherited_from", "is_disputed"])


def disputes(force: DataFrame) -> DataFrame:
    """Places and rights with any disputed, claimed or contested row: all parties, and the opponents named."""
    hit = F.max(F.col("is_disputed") | F.col("status").isin("claimed", "contested"))
    grouped = force.groupBy(*KEY).agg(
        hit.alias("hit"),
        F.array_sort(F.collect_list(F.struct("seq", "holder_id", "status"))).alias("parties"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("disputed_with")))).alias("against"),
    )
    return grouped.filter("hit").drop("hit")


def gained_and_lost(events: DataFrame) -> DataFrame:
    """entity, year, gained, lost."""
    side = lambda c, g: events.filter(F.col(c).isNotNull()).select(F.col(c).alias("entity"), "year", F.lit(g).alias("gain"))
    both = side("to_holder", 1).unionByName(side("from_holder", 0))
    return both.groupBy("entity", "year").agg(F.sum("gain").alias("gained"), F.sum(1 - F.col("gain")).alias("lost"))
