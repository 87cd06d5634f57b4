"""Resolution of mentions to places and entities.

A mention's id comes from the first of: its alias, the half of a split realm, a
hand-made territory, the first mention of the same territory, the index, a
hand-made settlement, and its own name. Each step is a join on folded names; the
only order that matters, who was mentioned first, is seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import naming as nm
from cadastra.functions import text as tx
from cadastra.operators import fuzzy
from cadastra.operators.aggregates import first_seen_mode
from cadastra.operators.curate import scoped_alias
from cadastra.operators.shared import parts, stored


def index_names(entries: DataFrame, references: DataFrame) -> DataFrame:
    """folded, entry: the names by which an index entry is found.

    Its own and its variants; the other name that it gives ("Bergweiler = Weiler im Loch") and a cross-reference's
    name, unless that is another entry's own. entries: entry, name, variants (bars), see, pages; references: name, see.
    """
    names = lambda c: F.explode(F.filter(F.concat(F.array("name"), F.split("variants", r"\|")), lambda n: n != "")) if c is None else c
    own = entries.select("entry", names(None).alias("n")).select(tx.fold(F.col("n")).alias("folded"), "entry").distinct()
    other = entries.filter("pages <> '' and see <> ''").select("entry", F.explode(F.split("see", ", | et ")).alias("n")).filter(F.col("n").rlike(r"^\p{Lu}"))
    other = other.select(tx.fold(F.col("n")).alias("folded"), "entry").join(own.select("folded"), "folded", "left_anti")
    every = own.unionByName(other).distinct()
    one = every.groupBy("folded").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry")).filter("n = 1").drop("n")
    led = references.select(tx.fold(F.col("name")).alias("own"), tx.fold(F.col("see")).alias("folded")).join(one, "folded").select(F.col("own").alias("folded"), "entry")
    return every.unionByName(led.join(every.select("folded"), "folded", "left_anti")).distinct()


def index_match(names: DataFrame, by_name: DataFrame, cutoff: float = 0.88) -> DataFrame:
    """folded, entry: the only entry of a name, else, where no entry has it, the only one of the two closest names."""
    count = by_name.groupBy("folded").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry"))
    exact = names.select("folded").distinct().join(count, "folded", "left")
    close = fuzzy.close_matches(exact.filter("n is null").select(F.col("folded").alias("name")), by_name.select(F.col("folded").alias("entry")).distinct(), cutoff)
    near = close.select(F.col("name").alias("folded"), F.col("entry").alias("other")).join(by_name.select(F.col("folded").alias("other"), "entry"), "other")
    near = near.groupBy("folded").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry")).filter("n = 1")
    return exact.filter("n = 1").select("folded", "entry").unionByName(near.select("folded", "entry"))


def manual_names(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of hand-made places: kind, folded, id of full names (the first row's where several share one), and kind, base, id of names without the word for their kind, if only one place of that kind has it. places: seq, id, kind, names (array)."""
    each = places.select("seq", "id", "kind", F.explode("names").alias("n")).filter("n <> ''").withColumn("folded", tx.fold(F.col("n")))
    full = each.groupBy("kind", "folded").agg(F.min_by("id", "seq").alias("id"))
    base = each.withColumn("base", tx.base_name(F.col("folded"))).groupBy("kind", "base").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")
    return full, base


def preferred_types(mentions: DataFrame) -> DataFrame:
    """base, place_type: the kind of domain that most mentions of a territory's name give; ties go to the first."""
    some = mentions.filter((F.col("kind") == "territory") & F.col("place_type").isin(*nm.DOMAIN_TYPES)).withColumn("base", tx.base_name(tx.fold(F.col("name"))))
    return first_seen_mode(some, ["base"], "place_type").select("base", "place_type")


def _slug(folded: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def resolve_places(mentions: DataFrame, aliases: DataFrame, manual: DataFrame, splits: DataFrame, by_name: DataFrame, entries: DataFrame, territory_types: tuple[str, ...] = ()) -> DataFrame:
    """seq, place_id, kind, how of each mention.

    mentions: seq, section, name, kind, place_type, index_name. aliases: scope ("section:", "kind:" or ""), name
    (folded), target. manual: seq, id, kind, names. splits: base, admin, feudal. by_name: folded, entry; entries:
    entry, label, name, canton, dept_code. how says which step found it.
    """
    rows = mentions.withColumn("kind", F.when(F.col("place_type").isin(*territory_types), "territory").otherwise(F.col("kind")))
    rows = stored(rows.withColumn("folded", tx.fold(F.col("name"))).withColumn("base", tx.base_name(F.col("folded"))), "mentions")
    rows = scoped_alias(rows.withColumnRenamed("name", "as_written").withColumn("name", F.col("folded")).withColumn("section", tx.fold(F.coalesce("section", F.lit("")))), aliases).drop("name")
    full, base = manual_names(manual)
    rows = rows.join(full.withColumnRenamed("id", "manual_full"), ["kind", "folded"], "left").join(base.withColumnRenamed("id", "manual_base"), ["kind", "base"], "left")
    rows = rows.join(splits.select("base", "admin", "feudal"), "base", "left")
    side = nm.split_side(F.col("folded"), F.col("place_type"))
    half = F.when((F.col("kind") == "territory") & nm.splits_realm(F.col("folded"), F.col("place_type")), F.when(side == "admin", F.col("admin")).otherwise(F.col("feudal")))
    prefer = preferred_types(mentions.select("seq", "name", "kind", "place_type")).withColumnRenamed("place_type", "preferred")
    rows = rows.withColumn("half", half).join(prefer, "base", "left")
    domain = F.col("place_type").isin(*nm.DOMAIN_TYPES)
    made = F.concat(_slug(F.when(domain, F.coalesce("preferred", "place_type")).otherwise(F.col("place_type"))), F.lit("-"), _slug(F.col("base")))
    rows = rows.withColumn("group", F.when(domain, "domain").otherwise(F.col("place_type")))
    # A territory is what a mention of its group last claimed by hand, up to the mention itself; before any claim, the id
    # that is made for the group. An alias or a half of a realm claims nothing.
    counts = (F.col("kind") == "territory") & F.col("alias").isNull() & F.col("half").isNull()
    so_far = Window.partitionBy("group", "base").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    claim = F.last(F.when(counts, F.coalesce("manual_full", "manual_base")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("group_id", F.when(counts, F.coalesce(claim, made)))
    labels = entries.groupBy("label").agg(F.min("entry").alias("label_entry"))
    rows = rows.join(labels.withColumnRenamed("label", "index_name"), "index_name", "left")
    settled = rows.filter("kind <> 'territory'").select("folded").distinct()
    rows = rows.join(index_match(settled, by_name).withColumnRenamed("entry", "name_entry"), "folded", "left")
    rows = rows.withColumn("entry", F.coalesce("label_entry", "name_entry")).join(index_ids(entries, by_name), "entry", "left")
    territory = F.col("kind") == "territory"
    steps = [("alias", F.col("alias")), ("split realm", F.col("half")), ("manual", F.when(territory, F.coalesce("manual_full", "manual_base"))), ("same territory", F.when(territory, F.col("group_id"))), ("manual", F.coalesce("manual_full", "manual_base")), ("index", F.col("index_id")), ("name", _slug(F.col("folded")))]
    how = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in steps])
    return rows.select("seq", F.coalesce(*[c for _, c in steps]).alias("place_id"), "kind", how.alias("how"))


def index_ids(entries: DataFrame, by_name: DataFrame) -> DataFrame:
    """entry, index_id: the name as an id, with the canton (else the department) where several entries are found by that name."""
    shared = by_name.groupBy("folded").agg((F.count_distinct("entry") > 1).alias("shared"))
    rows = entries.dropDuplicates(["entry"]).withColumn("folded", tx.fold(F.col("name"))).join(shared, "folded", "left")
    where = F.coalesce(F.nullif(F.col("canton"), F.lit("")), F.nullif(F.col("dept_code"), F.lit("")), F.lit("x"))
    return rows.select("entry", F.when(F.col("shared"), F.concat(_slug(F.col("folded")), F.lit("-"), _slug(tx.fold(where)))).otherwise(_slug(F.col("folded"))).alias("index_id"))


def usual_names(mentions: DataFrame) -> DataFrame:
    """place_id, usual: the spelling used most, of those that open with a capital and have no " de "; ties go to the first. mentions: seq, place_id, name."""
    plain = mentions.filter(F.col("name").rlike(r"^\p{Lu}") & ~F.contains("name", F.lit(" de ")))
    return first_seen_mode(plain, ["place_id"], "name").select("place_id", F.col("name").alias("usual"))


def entity_names(mentions: DataFrame, columns: tuple[str, ...] = ("name_fr", "name_en", "name_de", "entity_type")) -> DataFrame:
    """id and its most frequent value in each column (ties: first seen). mentions: seq, id and the columns."""
    out = mentions.select("id").distinct()
    for c in columns:
        out = out.join(first_seen_mode(mentions.select("seq", "id", c).filter(F.col(c).isNotNull()), ["id"], c).select("id", c), "id", "left")
    return out


def states(entities: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The ids that name a sovereign state, not a place. entities: id, entity_type."""
    return entities.filter(F.col("entity_type").isin(*kinds)).select("id")


def kept_facts(rows: DataFrame, needed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows in which every needed column is there (neither null nor empty), and reason, n of those that go. needed: column, reason; a row counts under the first."""
    reason = F.coalesce(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(why)) for c, why in needed.items()])
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def without_states(memberships: DataFrame, states_: DataFrame) -> DataFrame:
    """Memberships of which neither side is a state, and none of a place in itself."""
    rows = memberships.filter("child_id <> parent_id")
    for c in ("child_id", "parent_id"):
        rows = rows.join(states_.select(F.col("id").alias(c)), c, "left_anti")
    return rows.select(*memberships.columns)


def split_memberships(memberships: DataFrame, realms: DataFrame, places: DataFrame, feudal_types: tuple[str, ...], top_type: str = "bailiwick") -> DataFrame:
    """memberships in which an office and its fief share their lands.

    The fief's settlements are in the office too, the office's (those in no other fief) in the fief; where the fief was
    listed in the top territory the office takes its place; and the fief lies in its office. No membership is added
    that is there. memberships: child_id, parent_id, from_year, to_year, pages; realms: admin, feudal; places: id, kind,
    place_type.
    """
    columns = ["child_id", "parent_id", "from_year", "to_year", "pages"]
    rows = stored(memberships.select(*columns), "memberships")
    # In as many parts as the rows need, not as few as their compressed bytes make.
    apart = lambda df, *by: df.repartition(n_parts, *by)
    n_parts = parts(rows)
    # The realms are a short list made by hand; without the hint the memberships that meet them may be sent instead.
    pair = F.broadcast(realms.select("admin", "feudal").distinct())
    # What grows with the places meets by merge: Spark would send it through the driver as long as its compressed bytes look few.
    settled = apart(places.filter("kind = 'settlement'").select(F.col("id").alias("child_id")), "child_id").hint("merge")
    fiefs = places.filter(F.col("place_type").isin(*feudal_types)).select(F.col("id").alias("parent_id"))
    in_fief = rows.join(fiefs, "parent_id", "left_semi").select("child_id", F.col("parent_id").alias("fief")).distinct()
    of_fief = rows.join(pair.withColumnRenamed("feudal", "parent_id"), "parent_id").join(settled, "child_id", "left_semi")
    to_office = of_fief.select("child_id", F.col("admin").alias("parent_id"), "from_year", "to_year", "pages")
    of_office = rows.join(pair.withColumnRenamed("admin", "parent_id"), "parent_id").join(settled, "child_id", "left_semi")
    elsewhere = of_office.select("child_id", "feudal").join(in_fief.hint("merge"), "child_id").filter("fief <> feudal").select("child_id", "feudal").distinct()
    to_fief = of_office.join(elsewhere.hint("merge"), ["child_id", "feudal"], "left_anti").select("child_id", F.col("feudal").alias("parent_id"), "from_year", "to_year", "pages")
    top = places.filter(F.col("place_type") == top_type).select(F.col("id").alias("parent_id"))
    moved = rows.join(top, "parent_id", "left_semi").join(pair.withColumnRenamed("feudal", "child_id"), "child_id")
    lifted = moved.select(F.col("admin").alias("child_id"), "parent_id", "from_year", "to_year", "pages")
    stay = rows.join(moved.select("child_id", "parent_id").distinct().hint("merge"), ["child_id", "parent_id"], "left_anti").select(*columns)
    cited = rows.select(F.explode(F.array_distinct(F.array("child_id", "parent_id"))).alias("feudal"), F.explode("pages").alias("page")).groupBy("feudal").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    lies = pair.join(cited.hint("merge"), "feudal", "left").select(F.col("feudal").alias("child_id"), F.col("admin").alias("parent_id"), F.lit(None).cast("int").alias("from_year"), F.lit(None).cast("int").alias("to_year"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))
    added = to_office.unionByName(to_fief).unionByName(lifted).unionByName(lies)
    listed = apart(rows.select("child_id", "parent_id"), "child_id", "parent_id").distinct()
    added = apart(added, "child_id", "parent_id").join(listed.hint("merge"), ["child_id", "parent_id"], "left_anti")
    first = Window.partitionBy("child_id", "parent_id").orderBy(F.col("from_year").isNull(), "from_year", "to_year", F.concat_ws(";", F.col("pages").cast("array<string>")))
    added = added.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select(*columns)
    return stay.unionByName(added)


def used_ids(frames: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """id: every one that any of the columns (plain or arrays) names."""
    out = None
    for frame, columns in frames:
        kinds = dict(frame.dtypes)
        for c in columns:
            ids = frame.select((F.explode(c) if kinds[c].startswith("array") else F.col(c)).alias("id"))
            out = ids if out is None else out.unionByName(ids)
    return out.filter("id is not null and id <> ''").distinct()
