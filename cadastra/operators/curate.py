"""Rule-driven curation: resolution, drops, overrides, merges, precedence.

Everything that depends on order carries seq, the row's place in its source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators.aggregates import CONFIDENCE, keyed_merge
from cadastra.operators.shared import stored


def dropped_by(rows: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """rows with drop_reason: the first rule (by rule_seq) of which every given field equals the row's, compared as text.

    rules: rule_seq, reason and the fields, null where a rule doesn't ask. A literal "None" asks for null. Rules are
    few and joined by broadcast only as far as Spark finds them small.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    asks = rules.select("rule_seq", "reason", *[F.col(f).cast("string").alias("rule_" + f) for f in fields])
    fits = reduce(Column.__and__, [F.col("rule_" + f).isNull() | (F.col("rule_" + f) == text(f)) for f in fields])
    first = rows.select("seq", *fields).join(asks, fits).groupBy("seq").agg(F.min_by("reason", "rule_seq").alias("drop_reason"))
    return rows.join(first, "seq", "left")


def overridden(rows: DataFrame, rules: list[tuple[dict, dict]], casts: dict[str, str]) -> DataFrame:
    """Overrides (match, set) from first to last; a later one sees what earlier ones have set."""
    for match, change in rules:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
        fits = reduce(Column.__and__, [text(c) == str(v) for c, v in match.items()], F.lit(True))
        rows = rows.withColumns({c: F.when(fits, F.lit(v).cast(casts[c])).otherwise(F.col(c)) for c, v in change.items()})
    return rows


def scoped_alias(rows: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """rows with alias: that of the section first, then of the kind, then the global one. aliases: scope, name, target."""
    pick = lambda rule, out: aliases.filter(rule).select(F.col("scope").alias(out + "_scope"), F.col("name").alias(name), F.col("target").alias(out))
    a, b, c = pick("scope LIKE 'section:%'", "a1"), pick("scope LIKE 'kind:%'", "a2"), pick("scope = ''", "a3").drop("a3_scope")
    out = rows.withColumn("a1_scope", F.concat(F.lit("section:"), "section")).withColumn("a2_scope", F.concat(F.lit("kind:"), "kind"))
    out = out.join(a, ["a1_scope", name], "left").join(b, ["a2_scope", name], "left").join(c, name, "left")
    return out.withColumn("alias", F.coalesce("a1", "a2", "a3")).drop("a1_scope", "a2_scope", "a1", "a2", "a3")


def canonical(aliases: DataFrame) -> DataFrame:
    """alias, canonical: where following the aliases from each one ends; on a cycle, at the first place of it that is reached.

    Pointer jumping: in each round every alias takes over where its target points, so a chain of n takes log n rounds.
    What still points at an alias after as many steps as there are aliases runs on a cycle; cycles are then cut and the
    ways to them followed again. Of several targets of one alias the smallest counts. aliases: alias, target.
    """
    links = stored(aliases.where("alias is not null and target is not null").groupBy("alias").agg(F.min("target").alias("target")), "aliases")
    found, running = _followed(links, links.count())
    cycle = stored(running.select(F.col("at").alias("alias")).distinct().join(links.select("alias").hint("merge"), "alias", "left_semi"), "aliases-cycle")
    if cycle.isEmpty():
        return found.select("alias", F.col("at").alias("canonical"))
    cut = stored(links.join(cycle.hint("merge"), "alias", "left_anti"), "aliases-cut")
    ways, _ = _followed(cut, None)
    return ways.select("alias", F.col("at").alias("canonical")).unionByName(cycle.select("alias", F.col("alias").alias("canonical")))


def _followed(links: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """alias, at after following to the end, or for more than most steps; and the rows of those that had not ended before the last round."""
    state, steps = links.select("alias", F.col("target").alias("at")), 1
    while True:
        # Not by broadcast: the aliases of every round would go through the driver.
        onward = state.select(F.col("alias").alias("at"), F.col("at").alias("next")).hint("merge")
        jumped = state.join(onward, "at", "left")
        state = stored(jumped.select("alias", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("runs")), "aliases-at")
        steps *= 2
        running = state.where("runs")
        if running.isEmpty() or (most is not None and steps > most):
            return state, running


def dated_by_events(rights: DataFrame, events: DataFrame) -> DataFrame:
    """Open ends of rights closed by transfers: the first event (by seq) ends the outgoing and starts the incoming holder's row.

    An event fits a row of its place, right and holder with an open end, if the year isn't beyond its other end.
    """
    ends = events.select("place_id", "right_type", F.col("from_holder").alias("holder_id"), F.col("year").alias("end_year"), F.col("seq").alias("end_seq")).filter("holder_id is not null")
    starts = events.select("place_id", "right_type", F.col("to_holder").alias("holder_id"), F.col("year").alias("start_year"), F.col("seq").alias("start_seq")).filter("holder_id is not null")
    key = ["place_id", "right_type", "holder_id"]
    close = rights.filter("to_year is null").join(ends, key).filter("from_year is null or from_year <= end_year").groupBy("seq").agg(F.min_by("end_year", "end_seq").alias("end_year"))
    open_ = rights.filter("from_year is null").join(starts, key).filter("to_year is null or start_year <= to_year").groupBy("seq").agg(F.min_by("start_year", "start_seq").alias("start_year"))
    out = rights.join(close, "seq", "left").join(open_, "seq", "left")
    return out.withColumn("to_year", F.coalesce("to_year", "end_year")).withColumn("from_year", F.coalesce("from_year", "start_year")).drop("end_year", "start_year")


def merge_overlapping(rows: DataFrame, keys: list[str], first: int, last: int, texts: tuple[str, ...] = (), by_year: bool = True) -> DataFrame:
    """Rows of one key merged where their periods overlap: each goes into the first kept row that it overlaps.

    Rows with more known years come first, then (by_year) by from_year (none is 0), then by seq. A kept row keeps its own years
    and pools the others' pages; if rows have confidence, is_disputed, disputed_with (array) or the columns of texts,
    it takes the highest confidence, any dispute, all opponents and the first text that isn't empty. A key is one
    holder of one right at one place, with one status and share, or one membership. rows: keys, seq, from_year,
    to_year, pages (array).

    Rows of one period find the same kept row, so only a key's different periods are folded, by their first rows. A
    period that doesn't overlap itself (one year, or turned round) and finds none stays a kept row for each of its rows:
    no row kept later overlaps it, or that one would have gone into it.
    """
    more = [c for c in ("confidence", "is_disputed", "disputed_with", *texts) if c in rows.columns]
    known = F.col("from_year").isNotNull().cast("int") + F.col("to_year").isNotNull().cast("int")
    order = F.struct((-known).alias("o1"), (F.coalesce("from_year", F.lit(0)) if by_year else F.lit(0)).alias("o2"), F.col("seq").alias("o3"))
    periods = rows.groupBy(*keys, "from_year", "to_year").agg(F.min(order).alias("first"))
    entry = F.struct("first", F.col("first.o3").alias("seq"), "from_year", "to_year")
    by = periods.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("periods"))

    def overlap(a: Column, b: Column) -> Column:
        low = F.greatest(F.coalesce(a["from_year"], F.lit(first - 1)), F.coalesce(b["from_year"], F.lit(first - 1)))
        high = F.least(F.coalesce(a["to_year"], F.lit(last + 1)), F.coalesce(b["to_year"], F.lit(last + 1)))
        hands_over = a["to_year"].eqNullSafe(b["from_year"]) | b["to_year"].eqNullSafe(a["from_year"])
        return (high >= low) & ~((high == low) & hands_over)

    def step(done: Column, p: Column) -> Column:
        """done with p, and into: the kept period that it goes into, or its own, or null where each of its rows is kept."""
        hit = F.get(F.filter(done, lambda k: k["keeps"] & overlap(k, p)), F.lit(0))["seq"]
        return F.concat(done, F.array(F.struct(p["seq"].alias("seq"), p["from_year"].alias("from_year"), p["to_year"].alias("to_year"), hit.isNull().alias("keeps"), F.coalesce(hit, F.when(overlap(p, p), p["seq"])).alias("into"))))

    none = F.transform(F.slice("periods", 1, 0), lambda p: F.struct(p["seq"].alias("seq"), p["from_year"].alias("from_year"), p["to_year"].alias("to_year"), F.lit(True).alias("keeps"), F.when(F.lit(False), p["seq"]).alias("into")))
    into = by.select(*keys, F.explode(F.aggregate("periods", none, step)).alias("p")).select(*[F.col(k).alias("_" + k) for k in keys], F.col("p.from_year").alias("_from_year"), F.col("p.to_year").alias("_to_year"), F.col("p.into").alias("_into"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_" + c)) for c in (*keys, "from_year", "to_year")])
    rows = rows.join(into, same).withColumn("_into", F.coalesce("_into", "seq")).withColumn("_order", order)

    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence")), F.lit(0)) if "confidence" in more else None
    all_of = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))))
    own = lambda c: F.min_by(c, "_order")
    alone = F.count(F.lit(1)) == 1
    pooled = {
        "pages": lambda: F.when(alone, own("pages")).otherwise(all_of("pages")),
        "confidence": lambda: F.min_by("confidence", F.struct((-rank).alias("r"), "_order")),
        "is_disputed": lambda: F.when(F.bool_or("is_disputed"), True).when(F.count("is_disputed") == F.count(F.lit(1)), False),
        "disputed_with": lambda: F.when(alone, own("disputed_with")).otherwise(all_of("disputed_with")),
    } | {c: lambda c=c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("_order"))), F.min(c)) for c in texts}
    values = [(pooled[c]() if c in pooled else own(c)).alias(c) for c in ("from_year", "to_year", "pages", *more)]
    found = rows.groupBy(*keys, "_into").agg(*values)
    return found.withColumnRenamed("_into", "seq").select(*keys, "seq", "from_year", "to_year", "pages", *more)


def rekeyed(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Rows that have the same key, after an update, as one: the first one's values, merged as by keyed_merge."""
    return keyed_merge(rows, keys, texts)


def with_precedence(manual: DataFrame, added: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Manual rows, then added ones, then those found of which no manual row has the keys."""
    rest = found.join(manual.select(*keys).distinct(), keys, "left_anti").select(*found.columns)
    return manual.unionByName(added, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


#: The kinds of events that move a place between territories, if they are about one of the rights named or about none.
TRANSFER_EVENTS = ("purchase", "pledge", "redemption", "inheritance", "enfeoffment", "exchange", "cession", "occupation")
TERRITORY_RIGHTS = ("suzerain", "high_justice")


def normalized_memberships(memberships: DataFrame, events: DataFrame, first: int, last: int, rights: tuple[str, ...] = TERRITORY_RIGHTS) -> DataFrame:
    """Memberships as standing facts: a year stays only where a transfer of the member within a year of it backs it; rows of one pair that then overlap are one, with all their pages.

    A membership's years are mostly those of a document that attests it. Rows with more known years come first, then as
    they came. Of rows that end up with the same pair and years the last stays. memberships: seq, child_id, parent_id,
    from_year, to_year, pages and others, which the row that stays keeps; events: place_id, year, event_type, right_type.
    """
    moves = events.where(F.col("event_type").isin(*TRANSFER_EVENTS) & (F.col("right_type").isNull() | F.col("right_type").isin(*rights)))
    dated = backed_years(memberships, moves)
    kept = merge_overlapping(dated.select("seq", "child_id", "parent_id", "from_year", "to_year", "pages"), ["child_id", "parent_id"], first, last, by_year=False)
    key = ["child_id", "parent_id", "from_year", "to_year"]
    kept = kept.groupBy(*key).agg(F.max_by(F.struct("seq", "pages"), "seq").alias("r")).select(*key, "r.seq", "r.pages")
    rest = [c for c in memberships.columns if c not in (*key, "pages", "seq")]
    return kept.join(memberships.select("seq", *rest), "seq").select(*memberships.columns)


def backed_years(memberships: DataFrame, events: DataFrame) -> DataFrame:
    """Years of memberships that no event of the member within a year backs become open."""
    dates = events.select(F.col("place_id").alias("child_id"), F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("y")).distinct()
    for c in ("from_year", "to_year"):
        mark = dates.withColumnRenamed("y", c).withColumn("backed", F.lit(True))
        memberships = memberships.join(mark, ["child_id", c], "left").withColumn(c, F.when(F.col("backed"), F.col(c))).drop("backed")
    return memberships


def filled(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Empty cells filled from another table."""
    joined = rows.join(other.select(key, *[F.col(c).alias("other_" + c) for c in columns]), key, "left")
    full = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    return joined.withColumns({c: F.coalesce(full(c), F.col("other_" + c)) for c in columns}).drop(*["other_" + c for c in columns])


def overlaid(rows: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells overwritten where another table has a value."""
    joined = rows.join(other.select(key, *[F.col(c).alias("other_" + c) for c in columns]), key, "left")
    return joined.withColumns({c: F.coalesce(F.col("other_" + c), F.col(c)) for c in columns}).drop(*["other_" + c for c in columns])


def split_realms(rights: DataFrame, realms: DataFrame, fief_rights: tuple[str, ...], office_rights: tuple[str, ...]) -> DataFrame:
    """Rights of a split realm moved to its office or fief by their type. realms: place_id, admin, feudal."""
    joined = rights.join(realms, "place_id", "left")
    to = F.when(F.col("right_type").isin(*fief_rights), F.col("feudal")).when(F.col("right_type").isin(*office_rights), F.col("admin"))
    return joined.withColumn("place_id", F.coalesce(to, "place_id")).drop("admin", "feudal")


def unique_hits(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """name, entry: names with one entry of the same folded name; an ambiguous name has none. gazetteer: folded, entry."""
    one = gazetteer.groupBy("folded").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry")).filter("n = 1").drop("n")
    return names.join(one, "folded")


def shared_name_ids(places: DataFrame, folded: Column, canton: str) -> DataFrame:
    """id_text: the slug, with the canton where more than one place has the name."""
    named = places.withColumn("slug", F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", ""))
    n = named.groupBy("slug").agg(F.count("*").alias("n"))
    return named.join(n, "slug").withColumn("id_text", F.when(F.col("n") > 1, F.concat("slug", F.lit("-"), F.col(canton))).otherwise(F.col("slug"))).drop("n")


#: What tells a right from others by hand.
RIGHT_KEY = ("place_id", "right_type", "holder_id", "from_year", "to_year", "status")


def with_snippets(rights: DataFrame, snippets: DataFrame, keys: tuple[str, ...] = RIGHT_KEY) -> DataFrame:
    """rights, an empty snippet filled from the snippets of the same keys, where nulls are equal and equal to empty texts; the last by seq counts. snippets: seq, keys, snippet."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key_" + c)
    last = snippets.groupBy(*map(text, keys)).agg(F.max_by("snippet", "seq").alias("found"))
    joined = rights.select("*", *map(text, keys)).join(last, ["key_" + c for c in keys], "left")
    return joined.withColumn("snippet", F.coalesce(F.nullif("snippet", F.lit("")), "found")).select(*rights.columns)
