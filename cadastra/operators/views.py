"""Reports and views over the dataset: disputes, a place's panel, territories, comparisons, the review report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text as tx
from cadastra.operators import fuzzy
from cadastra.operators.hierarchy import hierarchy_of
from cadastra.operators.shared import numbered, stored


def disputes_view(disputes: DataFrame, names: DataFrame) -> DataFrame:
    """disputes with each place's name, in order of the names as a reader sorts them (accents and case apart only at ties), nth from 1. names: place_id, name."""
    rows = disputes.join(names, "place_id", "left").withColumn("name", F.coalesce("name", "place_id"))
    return locale_ordered(rows, F.col("name"), ["place_id", "right_type"])


def locale_ordered(rows: DataFrame, name: Column, ties: list[str]) -> DataFrame:
    """rows with nth, their place in the order of a name under the root collation. They are sorted by ranges; a part's place is the sizes of those before it and its own.

    The sorted rows are stored, so that a row is in one and the same part when parts are counted and when rows are numbered.
    """
    ordered = rows.withColumn("_name", F.collate(name, "UNICODE")).orderBy("_name", *ties).drop("_name")
    ordered = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    ordered = ordered.withColumn("_part", part).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a part
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(before, "_part").withColumn("nth", F.col("_before") + F.col("_in") + 1).drop("_at", "_part", "_in", "_before")


def place_panel(force: DataFrame, near: DataFrame, memberships: DataFrame, members: DataFrame, place: str) -> DataFrame:
    """section, nth, key, value: what a place's page shows in a year: its rights, those it inherits, the territories it is in, its members."""
    right = F.concat_ws(" ", "holder_id", F.when(F.coalesce("share", F.lit("")) != "", F.col("share")), F.when(F.col("status") != "held", F.concat(F.lit("("), "status", F.lit(")"))))
    own = force.filter(F.col("place_id") == place).select(F.lit("rights").alias("section"), F.col("seq").cast("long").alias("nth"), F.col("right_type").alias("key"), right.alias("value"))
    inherited = near.filter((F.col("place_id") == place) & F.col("inherited_from").isNotNull()).select(F.lit("inherited"), F.col("seq").cast("long"), "right_type", F.concat(right, F.lit(" from "), "inherited_from"))
    inside = memberships.filter(F.col("child_id") == place).select(F.lit("inside"), F.col("pos").cast("long"), "parent_id", F.when(F.col("is_disputed"), "disputed").otherwise(""))
    under = members.filter(F.col("parent_id") == place).groupBy("kind").agg(F.count_distinct("child_id").alias("n")).select(F.lit("members"), F.lit(0).cast("long"), "kind", F.col("n").cast("string"))
    return reduce(DataFrame.union, (own, inherited, inside, under))


def holder_view(force: DataFrame, changes: DataFrame, rulers: DataFrame, holder: str, first: int, last: int) -> DataFrame:
    """section, key, n: what a holder's page shows: rights held by type with the number of places, what it gained and lost by year, and its rulers in the span. changes: entity, year, gained, lost; rulers: entity_id, person_name."""
    own = force.filter(F.col("holder_id") == holder).groupBy("right_type").agg(F.count_distinct("place_id").alias("n")).select(F.lit("rights").alias("section"), F.col("right_type").alias("key"), F.col("n").cast("long").alias("n"))
    moved = changes.filter((F.col("entity") == holder) & F.col("year").between(first, last))
    gained = moved.filter("gained > 0").select(F.lit("gained"), F.col("year").cast("string"), F.col("gained").cast("long"))
    lost = moved.filter("lost > 0").select(F.lit("lost"), F.col("year").cast("string"), F.col("lost").cast("long"))
    who = rulers_in_span(rulers.filter(F.col("entity_id") == holder), first, last).groupBy("person_name").agg(F.count("*").alias("n")).select(F.lit("rulers"), "person_name", F.col("n").cast("long"))
    return reduce(DataFrame.union, (own, gained, lost, who))


def rulers_in_span(rulers: DataFrame, first: int, last: int) -> DataFrame:
    """Rulers of whom any year lies in first..last."""
    return rulers.filter((F.coalesce("from_year", F.lit(-9999)) <= last) & (F.coalesce("to_year", F.lit(9999)) >= first))


def territories_view(levels: DataFrame, places: DataFrame, group_of: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The realms of a year with level, kind, group and hierarchy; and how many there are of each (hierarchy, group, kind). group_of: kind of realm to group."""
    table = F.create_map(*[F.lit(x) for kv in group_of.items() for x in kv])
    rows = levels.join(places.select("id", "place_type", "name"), "id").withColumn("group", F.coalesce(F.try_element_at(table, F.col("place_type")), F.lit("other"))).withColumn("hierarchy", hierarchy_of(F.col("place_type")))
    return rows, rows.groupBy("hierarchy", "group", "place_type").agg(F.count("*").alias("n"))


def realms_shown(levels: DataFrame, places: DataFrame, memberships: DataFrame, level: int | None = None, kind: str | None = None, neighbours: bool = False) -> DataFrame:
    """id, why: the realms of a level or a kind, and those outside the root's realms that aren't in any other (the neighbours)."""
    chosen = levels
    if level is not None:
        chosen = chosen.filter(F.col("level") == level)
    if kind is not None:
        chosen = chosen.join(places.filter(F.col("place_type") == kind).select("id"), "id", "left_semi")
    out = chosen.select("id", F.lit("chosen").alias("why"))
    if not neighbours:
        return out
    free = places.filter("kind = 'territory'").select("id").join(levels.select("id"), "id", "left_anti").join(memberships.select(F.col("child_id").alias("id")), "id", "left_anti")
    return out.unionByName(free.select("id", F.lit("neighbour").alias("why")))


def settlement_types(places: DataFrame, members: DataFrame) -> DataFrame:
    """territory, place_type: the kinds of settlements that a territory has. members: territory, settlement."""
    return members.join(places.select(F.col("id").alias("settlement"), "place_type"), "settlement").select("territory", "place_type").distinct()


def types_in(group_of: dict[str, str], group: str) -> list[str]:
    """The kinds of realms of a group, in their order."""
    return [kind for kind, own in group_of.items() if own == group]


def matrix_csv(matrix: DataFrame, columns: list[str]) -> DataFrame:
    """line: a matrix's rows as quoted CSV; the caller writes them under its header with a byte-order mark."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return matrix.select(F.concat_ws(",", *quoted).alias("line"))


def matrix_rows(matrix: DataFrame, ancestors: DataFrame | None = None, territory: str | None = None, holdings: DataFrame | None = None, holder: str | None = None) -> DataFrame:
    """The matrix's rows under a territory, of a holder, or both. ancestors: id, ancestor; holdings: place_id, holder_id."""
    if territory is not None:
        matrix = matrix.join(ancestors.filter(F.col("ancestor") == territory).select(F.col("id").alias("place_id")), "place_id", "left_semi")
    if holder is not None:
        matrix = matrix.join(holdings.filter(F.col("holder_id") == holder).select("place_id"), "place_id", "left_semi")
    return matrix


def comparison(citations: DataFrame, entries: DataFrame, divisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each citation of an entry with the entry's division; and the citations of entries that aren't there. citations: row, entry; entries: entry, division, title; divisions: division, name."""
    found = citations.join(entries, "entry").join(divisions, "division", "left").select("row", "entry", "title", "division", F.coalesce("name", "division").alias("name"))
    return found, citations.join(entries.select("entry"), "entry", "left_anti").select("row", "entry")


def event_texts(events: DataFrame, summaries: DataFrame, manual: DataFrame, key: list[str]) -> DataFrame:
    """events with texts, a map of languages: the summary's, the English of hand-made events their own. Keys match null with empty. summaries: key, en, fr, de, ja; manual: key, description."""
    keyed = lambda df: df.withColumns({f"k_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key})
    ks = [f"k_{c}" for c in key]
    own = keyed(manual).groupBy(*ks).agg(F.max("description").alias("own"))
    told = keyed(summaries).dropDuplicates(ks).select(*ks, *[F.col(x).alias(f"t_{x}") for x in ("en", "fr", "de", "ja")])
    rows = keyed(events).join(told, ks, "left").join(own, ks, "left")
    en = F.coalesce(F.nullif(F.col("own"), F.lit("")), F.col("t_en"))
    texts = F.map_filter(F.create_map(F.lit("en"), en, F.lit("fr"), F.col("t_fr"), F.lit("de"), F.col("t_de"), F.lit("ja"), F.col("t_ja")), lambda _, v: F.coalesce(v, F.lit("")) != "")
    return rows.withColumn("texts", F.when(F.col("t_en").isNotNull(), texts)).drop(*ks, "own", *[f"t_{x}" for x in ("en", "fr", "de", "ja")])


def parents_nested(memberships: DataFrame) -> DataFrame:
    """child_id, parents: its memberships in order of parent, years."""
    one = F.struct("parent_id", "from_year", "to_year", "is_disputed")
    return memberships.groupBy("child_id").agg(F.array_sort(F.collect_list(one)).alias("parents"))


def ja_names(places: DataFrame, settlement_names: DataFrame, seats: DataFrame, manual: DataFrame, labels: DataFrame) -> DataFrame:
    """id, name_ja, source: hand-made names, else a settlement's label, else a territory's seat and the word for its kind, or its French name and that word.

    places: id, kind, name_fr, place_type; settlement_names: id, label; seats: id, seat; manual: id, name_ja; labels: place_type, ja.
    """
    from cadastra.functions import naming as nm

    own = settlement_names.select("id", nm.plain_label(F.col("label")).alias("name_ja"), F.lit("wikidata").alias("source")).join(manual.select("id"), "id", "left_anti")
    named = own.unionByName(manual.join(places.filter("kind = 'settlement'").select("id"), "id", "left_semi").select("id", "name_ja", F.lit("manual").alias("source")))
    by_name = named.join(places.select("id", "name_fr"), "id").groupBy(tx.fold(F.col("name_fr")).alias("folded")).agg(F.max_by("name_ja", "id").alias("by_name"))
    rows = places.filter("kind = 'territory'").join(labels.select("place_type", "ja"), "place_type", "left").join(seats.select("id", F.col("seat").alias("seat_id")), "id", "left")
    rows = rows.join(named.select(F.col("id").alias("seat_id"), F.col("name_ja").alias("seat_ja")), "seat_id", "left").withColumn("folded", tx.fold(nm.french_base(F.col("name_fr")))).join(by_name, "folded", "left")
    made = nm.territory_name_ja(F.col("seat_ja"), F.col("name_fr"), F.coalesce("ja", F.lit("")), F.col("by_name"))
    rows = rows.select("id", made.alias("name_ja")).filter("name_ja is not null").join(manual.select("id"), "id", "left_anti")
    rows = rows.withColumn("source", F.when(F.contains("name_ja", F.lit(" ")), "french + type").otherwise("seat + type"))
    return named.filter("source <> 'manual'").unionByName(rows).unionByName(manual.select("id", "name_ja", F.lit("manual").alias("source")))


def suggestions(entities: DataFrame, usage: DataFrame, cutoff: float = 0.85, limit: int = 60) -> DataFrame:
    """dropped, kept, score: pairs of entities with one stem (1.0) or alike names, the less used one dropped; a report of at most limit, the most alike first. entities: seq, id, name; usage: id, n."""
    rows = entities.select("seq", "id", tx.entity_stem(F.col("id")).alias("stem"), tx.base_name(tx.fold(F.col("name"))).alias("plain"))
    a, b = (rows.select(*[F.col(c).alias(c + s) for c in rows.columns]) for s in ("_a", "_b"))
    same = a.join(b, F.col("stem_a") == F.col("stem_b")).filter("seq_a < seq_b").select("id_a", "id_b", F.lit(1.0).alias("score"))
    names = rows.select("plain").distinct()
    close = fuzzy.close_matches(names.select(F.col("plain").alias("name")), names.select(F.col("plain").alias("entry")), cutoff, 1 << 20)
    pairs = close.select(F.col("name").alias("plain_a"), F.col("entry").alias("plain_b"), F.col("ratio").alias("score"))
    alike = a.join(pairs, "plain_a").join(b, "plain_b").filter("seq_a < seq_b and stem_a <> stem_b").select("id_a", "id_b", "score")
    n = lambda s: usage.select(F.col("id").alias("id" + s), F.col("n").alias("n" + s))
    every = same.unionByName(alike).join(n("_a"), "id_a", "left").join(n("_b"), "id_b", "left")
    first = F.coalesce("n_a", F.lit(0)) >= F.coalesce("n_b", F.lit(0))
    shown = every.select(F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("dropped"), F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("kept"), F.round("score", 2).alias("score"))
    return shown.orderBy(F.desc("score"), "dropped", "kept").limit(limit)


def same_base(places: DataFrame) -> DataFrame:
    """base, ids: territories of one name but for the word for their kind. places: id, kind, name."""
    rows = places.filter("kind = 'territory'").withColumn("base", tx.base_name(tx.fold(F.col("name"))))
    return rows.groupBy("base").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)


def geocodes_to_check(geocoding: DataFrame) -> DataFrame:
    """Settlements whose point isn't sure, in the order of a review: unlocated, approximate, the others; low confidence first; by id."""
    some = geocoding.filter((F.col("method") != "territory") & (F.col("confidence") != "high"))
    rank = F.when(F.col("method") == "unlocated", 0).when(F.col("method") == "approximate", 1).otherwise(2)
    return some.withColumn("rank", rank).orderBy("rank", F.col("confidence") != "low", "place_id")


def report(coverage: DataFrame, issues: DataFrame, merges: DataFrame, bases: DataFrame, unsure: DataFrame, low: DataFrame, most_low: int = 150) -> DataFrame:
    """section, nth, line: the review report as lines of Markdown, most actionable first. issues: level, table_name, pattern, n, rows (array of text); unsure: as geocodes_to_check; low: line, place_id, right_type, holder_id, source_page, notes."""
    bar = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(x.cast("string"), F.lit("")) for x in c]), F.lit(" |"))
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))

    def part(nth: int, rows: DataFrame, order: list, line: Column) -> DataFrame:
        names = [f"_o{i}" for i in range(len(order))]
        rows = rows.select(*[c.alias(n) for n, c in zip(names, order, strict=True)], line.alias("line"))
        return numbered(rows, [], names, "report").select(F.lit(nth).alias("section"), (F.col("place") + 1).cast("int").alias("nth"), "line")

    items = coverage.select(F.explode(F.array(*[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in coverage.columns])).alias("line"))
    return reduce(DataFrame.unionByName, (
        part(1, items, [F.col("line")], F.col("line")),
        part(2, issues, [F.col("level") != "error", -F.col("n"), F.col("table_name"), F.col("pattern")], bar(F.col("level"), F.col("table_name"), F.col("pattern"), F.col("n"), F.array_join(F.slice("rows", 1, 5), ", "))),
        part(3, merges, [-F.col("score"), F.col("dropped"), F.col("kept")], bar(code("dropped"), code("kept"), F.col("score"))),
        part(4, bases, [F.col("base")], F.concat(F.lit("- "), "base", F.lit(": "), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("`"), i, F.lit("`"))), ", "))),
        part(5, unsure, [F.col("rank"), F.col("confidence") != "low", F.col("place_id")], bar(F.col("place_id"), F.col("method"), F.col("confidence"), F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string")), F.col("note"))),
        part(6, low.orderBy("line").limit(most_low), [F.col("line")], bar(F.col("line"), F.col("place_id"), F.col("right_type"), F.col("holder_id"), F.col("source_page"), F.substring(F.coalesce("notes", F.lit("")), 1, 80))),
    ))
