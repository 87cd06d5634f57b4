"""Areas from cells: the union of a territory's cells as polygons with holes, and which polygons a point is in.

Rings that share a border share its corners exactly and run counter-clockwise.
What two of them share is run through in both directions and drops out; each of
the other edges goes on with one edge that begins where it ends, so they are
cycles. A cycle is found and put in order by pointer doubling: in each round
every edge learns what the edge it points at knows, and points twice as far. A
ring of n edges takes 2 log n rounds, each a join, however the rings are spread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.geo import thinned
from cadastra.operators.shared import spread, stored

_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
EDGE = ("x1", "y1", "x2", "y2")


def ring_edges(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """rings without ring, but a row an edge (x1, y1, x2, y2), in the ring's direction. A ring may repeat its first point at its end."""
    points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    edges = rings.withColumn("e", F.explode(F.arrays_zip(points.alias("a"), after.alias("b"))))
    edges = edges.withColumns({"x1": F.col("e.a.x"), "y1": F.col("e.a.y"), "x2": F.col("e.b.x"), "y2": F.col("e.b.y")})
    return edges.drop("e", ring).where("x1 <> x2 or y1 <> y2")


def boundary(rings: DataFrame) -> DataFrame:
    """territory and the directed edges that aren't shared by two of a territory's rings; the area is to their left. rings: territory, ring."""
    edges = ring_edges(rings.select("territory", "ring"))
    flip = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    way = lambda a, b: F.when(flip, F.col(a)).otherwise(F.col(b))
    one = edges.select("territory", way("x2", "x1").alias("xa"), way("y2", "y1").alias("ya"), way("x1", "x2").alias("xb"), way("y1", "y2").alias("yb"), F.when(flip, -1).otherwise(1).alias("n"))
    net = one.groupBy("territory", "xa", "ya", "xb", "yb").agg(F.sum("n").alias("n")).where("n <> 0")
    side = lambda a, b: F.when(F.col("n") > 0, F.col(a)).otherwise(F.col(b))
    return net.select("territory", side("xa", "xb").alias("x1"), side("ya", "yb").alias("y1"), side("xb", "xa").alias("x2"), side("yb", "ya").alias("y2"))


def _following(edges: DataFrame) -> DataFrame:
    """id and next: of the edges that begin where an edge ends, the one that bounds the same piece of area, which is the first clockwise from the way back."""
    out = edges.select("territory", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), (F.col("x2") - F.col("x1")).alias("ox"), (F.col("y2") - F.col("y1")).alias("oy"))
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    turn = F.pmod(back - F.atan2("oy", "ox"), F.lit(2 * math.pi))
    turn = F.when(turn < 1e-12, 2 * math.pi).otherwise(turn)
    return edges.join(out, ["territory", "x2", "y2"]).groupBy("id").agg(F.min_by("next", turn).alias("next"))


def _ring_of(links: DataFrame) -> DataFrame:
    """id, ring: the smallest id-independent name (the first edge by coordinates) of the cycle that each edge is in. links: id, next, own."""
    state = stored(links.select("id", F.col("next").alias("to"), F.col("own").alias("least")), "rings-least")
    while True:
        other = state.select(F.col("id").alias("to"), F.col("to").alias("onward"), F.col("least").alias("theirs"))
        state = stored(state.join(other, "to").select("id", F.col("onward").alias("to"), F.least("least", "theirs").alias("least"), (F.col("theirs") < F.col("least")).alias("moved")), "rings-least")
        if state.where("moved").isEmpty():
            return state.select("id", F.col("least").alias("ring"))


def _places_in_ring(links: DataFrame) -> DataFrame:
    """id, to_go: how many edges come after it before the ring's first one. links: id, next, own, ring."""
    first = links.where("own = ring").select(F.col("id").alias("next"), F.lit(True).alias("ends"))
    state = links.join(first, "next", "left").select("id", F.when(F.col("ends").isNull(), F.col("next")).alias("to"), F.when(F.col("ends").isNull(), 1).otherwise(0).cast("long").alias("to_go"))
    state = stored(state, "rings-place")
    while not state.where("to is not null").isEmpty():
        other = state.select(F.col("id").alias("to"), F.col("to").alias("onward"), F.col("to_go").alias("more"))
        state = stored(state.join(other, "to", "left").select("id", F.col("onward").alias("to"), (F.col("to_go") + F.coalesce("more", F.lit(0))).alias("to_go")), "rings-place")
    return state.select("id", "to_go")


def signed_area(points: Column) -> Column:
    """Positive for a counter-clockwise ring. points: array of structures x, y. Taken from the first point, for the digits."""
    x0, y0 = points[0]["x"], points[0]["y"]
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    part = F.zip_with(points, after, lambda a, b: (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0))
    return F.aggregate(part, F.lit(0.0), lambda s, v: s + v) / 2


def _loops(points: list) -> list[list[dict]]:
    """A ring that comes twice through a point, as rings that don't."""
    way, at, out = [], {}, []
    for p in points:
        key = (p["x"], p["y"])
        if key in at:
            loop = way[at[key] :]
            del way[at[key] :]
            for q in loop:
                del at[(q["x"], q["y"])]
            out.append(loop)
        at[key] = len(way)
        way.append({"x": key[0], "y": key[1]})
    return [*out, way]


def assembled(edges: DataFrame) -> DataFrame:
    """territory, points (array of x, y in order), area (square metres; negative: a hole), of the rings that the edges are.

    No ring passes a point twice: parts that touch in a point are rings of their own, and so are holes that touch a rim.
    edges: what boundary() gives.
    """
    edges = stored(edges.withColumn("id", F.monotonically_increasing_id()), "rings-edges")
    own = F.struct(*EDGE)
    links = stored(edges.select("id", own.alias("own")).join(_following(edges), "id"), "rings-next")
    links = links.join(_ring_of(links), "id")
    rows = edges.join(links.select("id", "ring"), "id").join(_places_in_ring(links), "id")
    order = F.sort_array(F.collect_list(F.struct((-F.col("to_go")).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    rings = rows.groupBy("territory", "ring").agg(order.alias("points")).select("territory", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    rings = stored(rings, "rings")
    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def parted(column: pa.Array) -> pa.Array:
        return pa.array([_loops(points) for points in column.to_pylist()], _RINGS)

    touches = F.size(F.array_distinct("points")) < F.size("points")
    parts = rings.where(~touches).unionByName(rings.where(touches).select("territory", F.explode(parted("points")).alias("points")))
    return parts.withColumn("area", signed_area(F.col("points"))).where("area <> 0")


def inside(points: DataFrame, edges: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """point and shape, of the shapes (rings or polygons with holes, as directed or undirected edges) that each point is in.

    The plane is a grid of squares of the given size. A shape is kept as the edges in each square and, for each square,
    whether a mark on its left side is inside: as many edges cross the row's middle line to the left of it, odd or
    even. Squares without edges lie whole inside or outside; those inside are kept too. A point meets the shapes of its
    square by equality, and goes from there to the mark, along the row's line and up or down, and counts the edges that
    it crosses. points: point, x, y and by; edges: shape, x1, y1, x2, y2 and by; only rows that are equal in by meet.
    """
    cell = lambda c: F.floor(c / size)
    #: A little off the middle, so that no corner of a map lies on it.
    line = lambda row: (row + 0.4142135623730951) * size
    names = ["shape", *by]
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(cell(low), cell(high))))
    slope = F.when(F.col("y1") == F.col("y2"), None).otherwise((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * slope
    a, b = F.greatest(low, F.col("cy") * size), F.least(high, (F.col("cy") + 1) * size)
    xa, xb = F.when(slope.isNull(), F.col("x1")).otherwise(at(a)), F.when(slope.isNull(), F.col("x2")).otherwise(at(b))
    crosses = (F.col("y1") <= line(F.col("cy"))) != (F.col("y2") <= line(F.col("cy")))
    rows = rows.withColumns({"from": cell(F.least(xa, xb) - 1e-6 * size), "upto": cell(F.greatest(xa, xb) + 1e-6 * size), "crossing": F.when(crosses, at(line(F.col("cy"))))})
    held = rows.select(*names, *EDGE, "cy", "crossing", F.explode(F.sequence("from", "upto")).alias("cx"))
    # The crossing counts in the one square that it is in.
    held = stored(held.withColumn("crossing", F.when(cell(F.col("crossing")) == F.col("cx"), F.col("crossing"))), "inside-edges")

    along = Window.partitionBy(*names, "cy").orderBy("cx")
    squares = held.groupBy(*names, "cy", "cx").agg(F.count("crossing").alias("n"))
    squares = squares.withColumn("left", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).withColumn("following", F.lead("cx").over(along))
    squares = stored(squares, "inside-squares")
    gap = squares.where("following > cx + 1 and (left + n) % 2 = 1")
    whole = gap.select(*names, "cy", F.explode(F.sequence(F.col("cx") + 1, F.col("following") - 1)).alias("cx"))

    # Points go once to their square, where a shape's edges lie together, so what a point meets is neither sent nor sorted.
    points = spread(stored(points.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y"))), "inside-points"), "cy", "cx")
    at_once = points.join(whole.hint("merge"), ["cy", "cx", *by]).select("point", "shape")
    there = held.groupBy(*names, "cy", "cx").agg(F.collect_list(F.struct(*EDGE, "crossing")).alias("edges"))
    there = there.join(squares.select(*names, "cy", "cx", "left"), [*names, "cy", "cx"])
    near = points.join(there.hint("merge"), ["cy", "cx", *by])
    x, y, mid = F.col("x"), F.col("y"), line(F.col("cy"))

    def crossed(e: Column) -> Column:
        """Whether the edge lies to the left of the point's foot on the line, and whether between the point and its foot."""
        foot = F.coalesce((e["crossing"] < x).cast("int"), F.lit(0))
        over = (e["x1"] < x) != (e["x2"] < x)  # what lies at x is to the right of it, as in foot
        height = e["y1"] + (x - e["x1"]) * (e["y2"] - e["y1"]) / F.when(over, e["x2"] - e["x1"])
        return foot + F.coalesce((over & ((height <= y) != (height <= mid))).cast("int"), F.lit(0))

    close = near.where(F.aggregate("edges", F.col("left").cast("int"), lambda s, e: s + crossed(e)) % 2 == 1).select("point", "shape")
    return at_once.unionByName(close)


def polygons(rings: DataFrame, size: float) -> DataFrame:
    """territory, parts, area, n_parts, n_holes: parts is an array of polygons, each an array of rings, the rim before its holes; the largest first.

    A hole belongs to the smallest rim that it is in. rings: what assembled() gives; size: of the grid, some edges long.
    """
    rings = stored(rings.withColumn("shape", F.monotonically_increasing_id()), "polygons-rings")
    rims, holes = rings.where("area > 0"), rings.where("area < 0")
    # The middle of a hole's first edge isn't on any rim.
    middle = lambda c: (F.col("points")[0][c] + F.col("points")[1][c]) / 2
    spots = holes.select(F.col("shape").alias("point"), "territory", middle("x").alias("x"), middle("y").alias("y"))
    edges = ring_edges(rims.join(holes.select("territory").distinct(), "territory", "left_semi").select("territory", "shape", F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("ring")))
    owner = inside(spots, edges, size, ("territory",)).join(rims.select("shape", "area"), "shape").groupBy("point").agg(F.min_by("shape", F.struct("area", "shape")).alias("rim"))
    placed = holes.join(owner.withColumnRenamed("point", "shape"), "shape").groupBy("rim").agg(F.sort_array(F.collect_list(F.struct(F.col("area"), F.col("points")))).alias("holes"))
    whole = rims.join(placed.withColumnRenamed("rim", "shape"), "shape", "left").withColumn("holes", F.coalesce("holes", F.expr("cast(array() as array<struct<area:double,points:array<struct<x:double,y:double>>>>)")))
    part = F.struct((-F.col("area")).alias("order"), F.concat(F.array("points"), F.transform("holes", lambda h: h["points"])).alias("rings"), F.aggregate("holes", F.col("area"), lambda s, h: s + h["area"]).alias("area"))
    found = whole.groupBy("territory").agg(F.sort_array(F.collect_list(part)).alias("found"))
    return found.select(
        "territory",
        F.transform("found", lambda p: p["rings"]).alias("parts"),
        F.aggregate("found", F.lit(0.0), lambda s, p: s + p["area"]).alias("area"),
        F.size("found").alias("n_parts"),
        F.aggregate("found", F.lit(0), lambda s, p: s + F.size(p["rings"]) - 1).alias("n_holes"),
    )


def smallest_at(points: DataFrame, edges: DataFrame, settlements: DataFrame, size: float) -> DataFrame:
    """point, territory, settlements: of the territories that a point is in, the one with the fewest settlements, then the smallest id.

    points: point, x, y; edges: territory and edges in any order, what boundary() gives, as no rings are needed; settlements: territory, settlements.
    """
    found = inside(points, edges.withColumnRenamed("territory", "shape"), size).withColumnRenamed("shape", "territory").join(settlements, "territory")
    return found.groupBy("point").agg(F.min(F.struct("settlements", "territory")).alias("least")).select("point", "least.territory", "least.settlements")


def simplified(parts: DataFrame, tolerance: float) -> DataFrame:
    """parts with fewer corners, none that goes farther than tolerance from what stays. A ring that would lose its area keeps its corners."""

    def ring(points: list) -> list:
        line = np.array([(p["x"], p["y"]) for p in [*points, points[0]]])
        least = thinned(line, tolerance)[:-1]
        return [{"x": x, "y": y} for x, y in (least if len(least) > 2 else line[:-1]).tolist()]

    @F.arrow_udf("array<array<array<struct<x:double,y:double>>>>")
    def fewer(column: pa.Array) -> pa.Array:
        return pa.array([[[ring(r) for r in part] for part in parts] for parts in column.to_pylist()], pa.list_(_RINGS))

    return parts.withColumn("parts", fewer("parts"))


def territory_rings(cells: DataFrame, members: DataFrame, cell_of: DataFrame, versions: DataFrame) -> DataFrame:
    """territory (structure of territory and from_year) and ring: the distinct cells of each territory's members at the start of each run of years."""
    own = members.withColumnRenamed("year", "from_year").join(versions.select("territory", "from_year"), ["territory", "from_year"]).join(cell_of, "settlement")
    key = F.struct("territory", "from_year")
    return own.select(key.alias("territory"), "id").distinct().join(cells.select("id", "ring"), "id").select("territory", "ring")


def territory_areas(cells: DataFrame, members: DataFrame, cell_of: DataFrame, versions: DataFrame, size: float) -> DataFrame:
    """territory, from_year, to_year, n_members, parts, area, n_parts, n_holes: a territory's area in each run of years with the same members.

    cells: id, ring; members: territory, year, settlement; cell_of: settlement, id, the cell that a settlement has or
    shares; versions: territory, from_year, to_year, n_members. Territories without cells have no rows.
    """
    found = polygons(assembled(boundary(territory_rings(cells, members, cell_of, versions))), size)
    found = found.select("territory.territory", "territory.from_year", "parts", "area", "n_parts", "n_holes")
    return versions.select("territory", "from_year", "to_year", "n_members").join(found, ["territory", "from_year"])
