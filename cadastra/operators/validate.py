"""Integrity rules. Each gives issues: level, table_name, row, message; row is the row's seq or id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.functions.temporal import is_handover, share_parts, touches
from cadastra.operators.hierarchy import cycles
from cadastra.operators.shared import parts, spread, stored

CONTESTED = ("claimed", "contested")


def issues(df: DataFrame, level: str | Column, table: str, row: str | Column, message: Column) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    row = F.col(row) if isinstance(row, str) else row
    return df.select(level.alias("level"), F.lit(table).alias("table_name"), row.cast("string").alias("row"), message.alias("message"))


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def missing_keys(df: DataFrame, table: str, row: str, column: str, target: DataFrame, target_name: str, key: str = "id") -> DataFrame:
    """Values of a column that aren't ids of the target."""
    known = target.select(F.col(key).alias(column)).distinct()
    lost = df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
    return issues(lost, "error", table, row, F.concat(F.lit(f"{column} '"), F.col(column), F.lit(f"' is not in {target_name}")))


def outside_vocabulary(df: DataFrame, table: str, row: str, column: str, vocabulary: DataFrame) -> DataFrame:
    """Values that aren't keys of the vocabulary (column key)."""
    lost = df.filter(F.col(column).isNotNull()).join(vocabulary.select(F.col("key").alias(column)), column, "left_anti")
    return issues(lost, "error", table, row, F.concat(F.lit(f"{column} '"), F.col(column), F.lit("' is not in the vocabulary")))


def missing_labels(vocabulary: DataFrame, langs: tuple[str, ...] = ("en", "fr", "de")) -> DataFrame:
    """Keys without a label in one of the languages. vocabulary: vocabulary, key and a column a language."""
    rows = vocabulary.select("vocabulary", "key", F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.col(x).alias("label")) for x in langs])).alias("l"))
    lost = rows.filter(F.coalesce("l.label", F.lit("")) == "")
    return issues(lost, "error", "vocab", "key", F.concat("vocabulary", F.lit("."), "key", F.lit(": no label in "), F.col("l.lang")))


def duplicate_ids(df: DataFrame, table: str, key: str = "id", line: str = "line") -> DataFrame:
    """Every row after the first of an id."""
    first = df.groupBy(key).agg(F.min(line).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = df.join(first, key).filter(F.col(line) > F.col("first"))
    return issues(later, "error", table, line, F.concat(F.lit("duplicate id '"), F.col(key), F.lit("' (first on line "), F.col("first").cast("string"), F.lit(")")))


def type_of_other_kind(places: DataFrame, applies: DataFrame) -> DataFrame:
    """Place types that don't apply to the place's kind. applies: place_type, kind."""
    return issues(places.join(applies, ["place_type", "kind"], "left_anti"), "warning", "places", "id", F.concat(F.lit("type '"), "place_type", F.lit("' does not apply to "), "kind"))


def half_coordinates(places: DataFrame) -> DataFrame:
    return issues(places.filter(F.col("lat").isNull() != F.col("lon").isNull()), "error", "places", "id", F.lit("lat and lon go together"))


def wrong_direction(memberships: DataFrame, places: DataFrame) -> DataFrame:
    """Territories (but a ban) that belong to a settlement."""
    child = places.filter("kind = 'territory' AND place_type <> 'ban'").select(F.col("id").alias("child_id"))
    parent = places.filter("kind = 'settlement'").select(F.col("id").alias("parent_id"))
    bad = memberships.join(child, "child_id", "left_semi").join(parent, "parent_id", "left_semi")
    return issues(bad, "error", "memberships", F.concat("child_id", F.lit("→"), "parent_id"), F.lit("a territory cannot belong to a settlement"))


def without_source(df: DataFrame, table: str, row: str) -> DataFrame:
    return issues(df.filter(F.coalesce("source_page", F.lit("")) == ""), "error", table, row, F.lit("source_page is required for facts"))


def out_of_range(df: DataFrame, table: str, row: str, first: int, last: int) -> DataFrame:
    outside = ~touches(F.col("from_year"), F.col("to_year"), first, last)
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("…"))
    return issues(df.filter(outside), "info", table, row, F.concat(F.lit("period "), show("from_year"), F.lit("-"), show("to_year"), F.lit(f" lies outside {first}-{last}")))


def membership_cycles(memberships: DataFrame) -> DataFrame:
    return issues(cycles(memberships), "error", "memberships", F.concat("child_id", F.lit("→"), "parent_id"), F.concat(F.lit("membership cycle through '"), "child_id", F.lit("'")))


def dispute_flags(rights: DataFrame) -> DataFrame:
    named = F.size("disputed_with") > 0
    return united([
        issues(rights.filter(F.col("is_disputed") & ~named), "warning", "rights", "seq", F.lit("is_disputed is set but disputed_with is empty")),
        issues(rights.filter(named & ~F.col("is_disputed")), "warning", "rights", "seq", F.lit("disputed_with is given but is_disputed is false")),
        issues(rights.filter(F.array_contains("disputed_with", F.col("holder_id"))), "error", "rights", "seq", F.lit("holder is listed in its own disputed_with")),
    ])


#: Years that a period is cut into for meeting others; rows of a key and bin that meet others at once; and pairs that a task compares, about.
_BIN, _BLOCK, _PART_PAIRS = 8, 1 << 12, 1 << 26


def overlapping_pairs(rows: DataFrame, by: list[str], first: int, last: int, kind: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """by, carried, a, b: r of both rows (a.seq < b.seq) of the pairs of one key in overlapping years that is no handover; open ends reach one year beyond first..last.

    rows: by, seq, from_year, to_year, r (a struct with seq and what else is told of a row), carried (columns that by
    fixes) and, if named, kind, a flag that at least one row of a pair must have.

    A period lies in bins of some years. Two that overlap meet in the bin in which the later one begins, and only there,
    so a key of many disjoint rows costs no more than its rows. A bin's rows are dealt into blocks, and blocks meet one
    another in tasks of their own. The later rows of a block that have one period and kind meet an earlier row as one
    list, which fits as a whole or not at all, so what is compared row by row is nearly all result.
    """
    start, end = F.coalesce("from_year", F.lit(first - 1)), F.coalesce("to_year", F.lit(last + 1))
    rows = rows.withColumns({"start": start, "end": end, "flag": F.col(kind) if kind else F.lit(True)}).where("start <= end")
    bin_of = lambda c: F.floor(F.col(c) / _BIN)
    rows = rows.select(*by, *carried, "r", "from_year", "to_year", "start", "end", "flag", F.explode(F.sequence(bin_of("start"), bin_of("end"))).alias("bin"))
    begins, key = F.col("bin") == bin_of("start"), [*by, "bin"]
    held = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(begins).alias("later")).where(F.col("n") > _BLOCK)
    held = stored(held, "crowds")
    pairs = held.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("later")), F.lit(0.0))).first()[0]
    n_parts = parts(rows) + int(pairs / _PART_PAIRS)

    blocks = lambda c: F.coalesce(F.greatest(F.ceil(F.col(c) / _BLOCK), F.lit(1)), F.lit(1))
    dealt = rows.join(held, key, "left").withColumns({"of_one": blocks("n"), "of_two": blocks("later")})
    block = lambda c: F.pmod(F.xxhash64("r.seq"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    one = dealt.select(*key, *carried, F.col("r").alias("one"), *[F.col(c).alias(f"{c}1") for c in ("from_year", "to_year", "start", "end", "flag")], block("of_one").alias("i"), each("of_two").alias("j"))
    two = dealt.where(begins).withColumn("j", block("of_two")).groupBy(*key, "of_one", "j", "from_year", "to_year", "start", "flag").agg(F.collect_list("r").alias("twos"))
    two = two.select(*key, "j", "twos", *[F.col(c).alias(f"{c}2") for c in ("from_year", "to_year", "start", "flag")], each("of_one").alias("i"))

    meet = [*key, "i", "j"]
    handover = is_handover(F.col("from_year1"), F.col("to_year1"), F.col("from_year2"), F.col("to_year2"), first, last)
    met = one.repartition(n_parts, *meet).join(two.repartition(n_parts, *meet), meet).where(F.col("start2").between(F.col("start1"), F.col("end1")) & (F.col("flag1") | F.col("flag2")) & ~handover)
    met = met.select(*by, *carried, "one", (F.col("start1") < F.col("start2")).alias("before"), F.explode("twos").alias("two"))
    in_order = F.col("one.seq") < F.col("two.seq")
    met = met.where(F.col("before") | in_order)
    return met.select(*by, *carried, F.when(in_order, F.col("one")).otherwise(F.col("two")).alias("a"), F.when(in_order, F.col("two")).otherwise(F.col("one")).alias("b"))


def overlapping(rights: DataFrame, first: int, last: int, commonly_shared: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of a place and right in overlapping years that neither shares, a claim nor a dispute explains."""
    shared = F.col("right_type").isin(*commonly_shared) if commonly_shared else F.lit(False)
    line, unshared = F.col("seq").cast("string"), F.col("share").isNull()
    key = ["place_id", "right_type"]
    told = rights.withColumn("r", F.struct("seq", line.alias("line"))).where(unshared)
    twice = overlapping_pairs(told, [*key, "holder_id", "status"], first, last)
    # What a message says of the key and of a row is put together once for the row, not once a pair.
    told = rights.withColumns({
        "unshared": unshared, "level": F.when(shared, "info").otherwise("warning"), "head": F.concat("right_type", F.lit(" at "), "place_id", F.lit(" overlaps line ")),
        "r": F.struct("seq", "holder_id", line.alias("line"), F.concat(line, F.lit(" ("), "holder_id", F.lit(" vs ")).alias("text")),
    }).where(~(F.col("status").isin(*CONTESTED) | F.col("is_disputed")))
    open_ = overlapping_pairs(told, key, first, last, "unshared", ("level", "head")).where("a.holder_id <> b.holder_id")
    return united([
        issues(twice, "warning", "rights", F.col("b.line"), F.concat(F.lit("duplicates line "), "a.line", F.lit(": same holder of "), "right_type", F.lit(" at "), "place_id", F.lit(" in overlapping years"))),
        issues(open_, F.col("level"), "rights", F.col("b.line"), F.concat("head", "a.text", "b.holder_id", F.lit(")"))),
    ])


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, 96 steps: enough for any pair of 64-bit numbers."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("a"), b.alias("b")), step)["a"]


def share_sums(rights: DataFrame, first: int, last: int) -> DataFrame:
    """place_id, right_type, year, total ("7/6") where numeric shares held in a boundary year exceed the whole.

    Sums are exact: numerators over the least common multiple of the denominators, in whole numbers.
    """
    key = ["place_id", "right_type"]
    bounds = rights.select(*key, F.explode(F.array_compact(F.array("from_year", "to_year", F.lit(first), F.lit(last)))).alias("year")).distinct()
    held = rights.filter(F.col("status").isin("held", "pledged")).join(bounds, key).filter((F.coalesce("from_year", F.lit(0)) <= F.col("year")) & (F.col("year") <= F.coalesce("to_year", F.lit(9999))))
    starts = held.filter("from_year = year").select(*key, "year").distinct()
    ends = F.coalesce(F.col("to_year") == F.col("year"), F.lit(False)) & ~F.coalesce(F.col("from_year") == F.col("year"), F.lit(False))
    held = held.filter(~ends).unionByName(held.filter(ends).join(starts, [*key, "year"], "left_anti").select(*held.columns))
    n, d = share_parts(F.col("share"))
    by = held.withColumn("n", n).withColumn("d", d).filter("d > 0").groupBy(*key, "year", "d").agg(F.sum("n").alias("n"))
    whole = by.groupBy(*key, "year").agg(F.collect_list(F.struct("n", "d")).alias("parts"))
    div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  # whole numbers, not through doubles
    whole = whole.withColumn("base", F.aggregate("parts", F.lit(1).cast("long"), lambda a, p: div(a, gcd(a, p["d"])) * p["d"]))
    whole = whole.withColumn("top", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"] * div(F.col("base"), p["d"])))
    over = whole.filter("top > base").withColumn("g", gcd(F.col("top"), F.col("base")))
    return over.select(*key, "year", F.concat(div(F.col("top"), F.col("g")).cast("string"), F.lit("/"), div(F.col("base"), F.col("g")).cast("string")).alias("total"))


def event_mismatches(events: DataFrame, rights: DataFrame) -> DataFrame:
    """Changes that the rights don't mirror within a year: a warning where the holder has rows, else information."""
    facts = rights.select("place_id", "right_type", F.col("holder_id").alias("holder"), "from_year", "to_year")
    moves = events.filter(F.col("right_type").isNotNull())
    side = lambda rows, c, what: rows.filter(F.col(c).isNotNull()).select("seq", "year", "place_id", "right_type", F.col(c).alias("holder"), F.lit(what).alias("what"))
    wanted = united([
        side(moves.filter(F.col("from_holder").isNull()), "to_holder", "holds"),
        side(moves.filter(F.col("from_holder").isNotNull()), "to_holder", "starts"),
        side(moves, "from_holder", "ends"),
    ])
    # A holder's rows come together as their different periods, which years bound, so no change meets a row each.
    key = ["place_id", "right_type", "holder"]
    periods = spread(facts, *key).groupBy(*key).agg(F.collect_set(F.struct("from_year", "to_year")).alias("periods"))
    near = lambda y: F.coalesce(F.abs(y - F.col("year")) <= 1, F.lit(False))
    within = lambda p: (F.coalesce(p["from_year"], F.lit(0)) <= F.col("year")) & (F.col("year") <= F.coalesce(p["to_year"], F.lit(9999)))
    fits = lambda p: F.when(F.col("what") == "starts", near(p["from_year"])).when(F.col("what") == "ends", near(p["to_year"])).otherwise(within(p))
    joined = spread(stored(wanted, "changes"), *key).join(periods.hint("merge"), key, "left")
    found = joined.withColumn("rows", F.col("periods").isNotNull()).withColumn("ok", F.when(F.col("rows"), F.exists("periods", fits)).otherwise(False))
    found = found.filter("not ok").select("seq", "year", *key, "what", "rows", "ok").distinct()
    return issues(found.filter("not ok"), F.when(F.col("rows"), "warning").otherwise("info"), "events", "seq", F.concat("what", F.lit(": "), "holder", F.lit(" "), "right_type", F.lit(" at "), "place_id", F.lit(" in "), F.col("year").cast("string")))


def validate(places: DataFrame, entities: DataFrame, memberships: DataFrame, rights: DataFrame, events: DataFrame, first: int, last: int) -> DataFrame:
    """All rules that need nothing but the dataset."""
    edge = memberships.withColumn("edge", F.concat("child_id", F.lit("→"), "parent_id"))
    opponents = rights.select("seq", F.explode("disputed_with").alias("disputed_with"))
    return united([
        missing_keys(edge, "memberships", "edge", "child_id", places, "places"), missing_keys(edge, "memberships", "edge", "parent_id", places, "places"),
        missing_keys(rights, "rights", "seq", "place_id", places, "places"), missing_keys(rights, "rights", "seq", "holder_id", entities, "entities"),
        missing_keys(opponents, "rights", "seq", "disputed_with", entities, "entities"), missing_keys(events, "events", "seq", "place_id", places, "places"),
        missing_keys(events, "events", "seq", "from_holder", entities, "entities"), missing_keys(events, "events", "seq", "to_holder", entities, "entities"),
        half_coordinates(places), wrong_direction(memberships, places), membership_cycles(memberships), dispute_flags(rights),
        out_of_range(rights, "rights", "seq", first, last), overlapping(rights, first, last), event_mismatches(events, rights),
    ])
