"""Where places lie: candidates scored by kind, country and distance, then by the company of a territory.

candidates: candidate, lat, lon, country, labels (array), matched (array), settles,
fortified, excluded (booleans of its classes), seq. Distances meet through grid
cells or through equality of names, never by all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions import text as tx
from cadastra.functions.geo import km
from cadastra.operators.fuzzy import alike_pairs, ratio
from cadastra.operators.shared import numbered, stored

FAR_KM, NEAR_KM, RIVAL_KM, CONTEXT_KM = 25.0, 25.0, 3.0, 35.0
STRONG = ("castle", "abbey", "priory")


def grouped_bindings(bindings: DataFrame) -> DataFrame:
    """A row an item of query bindings (qid, matched, lat, lon, country, class, fr, de): its classes and names as sets, of the rest the first that is there."""
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    return bindings.groupBy("qid").agg(*[F.array_sort(F.collect_set(c)).alias(c + "s") for c in ("matched", "class")], *map(first, ("lat", "lon", "country", "fr", "de")))


def score(excluded: Column, settles: Column, fortified: Column, country: Column, wanted_country: Column, place_type: Column, own_label: Column) -> Column:
    """How well a candidate fits, null if it can't be: 3 for a settlement, 3 for a castle or abbey that is sought, 1 for a label that is one of our names."""
    bad = (excluded & ~settles & ~fortified) | F.coalesce((wanted_country != "") & (country != "") & (wanted_country != country), F.lit(False))
    points = F.when(settles, 3.0).otherwise(0.0) + F.when(place_type.isin(*STRONG) & fortified, 3.0).otherwise(0.0) + F.when(own_label, 1.0).otherwise(0.0)
    return F.when(~bad, points)


def best_candidates(places: DataFrame, names: DataFrame, candidates: DataFrame) -> DataFrame:
    """place_id, candidate, clat, clon, confidence, note: the best scored, then the nearest to the anchor, then the first.

    places: place_id, country, place_type, alat, alon (the anchor, or null). names: place_id, folded. A place without
    any candidate isn't in the result.
    """
    matched = candidates.select("candidate", F.explode("matched").alias("m")).select("candidate", tx.fold(F.col("m")).alias("folded")).distinct()
    labels = candidates.select("candidate", F.explode("labels").alias("m")).select("candidate", tx.fold(F.col("m")).alias("folded")).distinct()
    pairs = names.join(matched, "folded").select("place_id", "candidate").distinct()
    own = names.join(labels, "folded").select("place_id", "candidate").distinct().withColumn("own", F.lit(True))
    facts = candidates.select("candidate", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.col("country").alias("ccountry"), "settles", "fortified", "excluded", F.col("seq").alias("cseq"))
    rows = pairs.join(places, "place_id").join(facts, "candidate").join(own, ["place_id", "candidate"], "left")
    rows = rows.withColumn("score", score(F.col("excluded"), F.col("settles"), F.col("fortified"), F.col("ccountry"), F.col("country"), F.col("place_type"), F.coalesce("own", F.lit(False)))).filter("score is not null")
    rows = rows.withColumn("km", F.when(F.col("alat").isNotNull(), km(F.col("alat"), F.col("alon"), F.col("clat"), F.col("clon"))))
    order = Window.partitionBy("place_id").orderBy(F.desc("score"), F.coalesce("km", F.lit(0.0)), "cseq")
    rows = stored(rows.withColumn("nth", F.row_number().over(order)), "candidates")
    top = rows.filter("nth = 1")
    far = km(F.col("clat"), F.col("clon"), F.col("tlat"), F.col("tlon")) > RIVAL_KM
    rivals = rows.filter("nth > 1").join(top.select("place_id", "score", F.col("clat").alias("tlat"), F.col("clon").alias("tlon")), ["place_id", "score"]).filter(far)
    rivals = rivals.groupBy("place_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("nth", "candidate"))), 1, 3), lambda x: x["candidate"]).alias("rivals"))
    out = top.join(rivals, "place_id", "left")
    anchored, apart = F.col("alat").isNotNull(), F.col("km") > FAR_KM
    confidence = F.when(anchored & apart, "medium").when(F.col("rivals").isNotNull() & ~anchored, "low").when((F.col("score") >= 3) & (anchored | F.col("rivals").isNull()), "high").otherwise("medium")
    note = F.when(anchored & apart, F.format_string("%.0f km from the index's canton", "km")).when(F.col("rivals").isNotNull() & ~anchored, F.concat(F.lit("ambiguous without canton; also "), F.array_join("rivals", ", "))).otherwise(F.when(anchored, "").otherwise("no canton anchor"))
    return out.select("place_id", "candidate", "clat", "clon", confidence.alias("confidence"), note.alias("note"))


def gazetteer_matches(places: DataFrame, names: DataFrame, entries: DataFrame, cutoff: float = 0.92) -> DataFrame:
    """place_id, geonameid, glat, glon, gconfidence, gnote: an entry of the same name, populated places first, then the nearest; else, near the anchor, the most alike of those with the same first letter.

    places: place_id, country, alat, alon; entries: geonameid, name, lat, lon, country, feature, names (folded).
    """
    flat = entries.select("geonameid", F.col("name").alias("gname"), F.col("lat").alias("glat"), F.col("lon").alias("glon"), F.col("country").alias("gcountry"), "feature", F.explode("names").alias("folded"))
    right = F.coalesce(F.col("country"), F.lit("")).isin("") | (F.col("country") == F.col("gcountry"))
    apart = km(F.col("alat"), F.col("alon"), F.col("glat"), F.col("glon"))
    exact = names.join(places, "place_id").join(flat, "folded").filter(right & (F.col("alat").isNull() | (apart <= NEAR_KM)))
    rank = F.struct((~F.startswith("feature", F.lit("P."))).alias("r1"), F.coalesce(apart, F.lit(0.0)).alias("r2"), F.col("geonameid").alias("r3"), "gname", "glat", "glon", F.col("alat").isNotNull().alias("anchored"))
    exact = exact.groupBy("place_id").agg(F.min(rank).alias("e"))
    exact = exact.select("place_id", F.col("e.r3").alias("geonameid"), "e.glat", "e.glon", F.when(F.col("e.anchored"), "high").otherwise("medium").alias("gconfidence"), F.lit("geonames exact").alias("gnote"))
    left = places.filter("alat is not null").join(exact.select("place_id"), "place_id", "left_anti")
    high, wide = NEAR_KM / 111.0, NEAR_KM / 55.0
    cell = lambda c, s: F.floor(F.col(c) / s)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    asks = left.join(names, "place_id").withColumn("dy", step).withColumn("dx", step).withColumn("cy", cell("alat", high) + F.col("dy")).withColumn("cx", cell("alon", wide) + F.col("dx")).withColumn("initial", F.substring("folded", 1, 1)).filter("initial <> ''").withColumnRenamed("folded", "asked")
    squeeze = lambda c: F.regexp_replace(c, "[ -]", "")
    # Texts meet first, each pair once, and only those alike meet the places and entries that have them.
    asks, flat = stored(asks.withColumn("a", squeeze("asked")), "asks"), flat.withColumn("b", squeeze("folded"))
    alike = stored(alike_pairs(asks.select("a"), flat.select("b"), cutoff), "alike")
    there = flat.withColumns({"cy": cell("glat", high), "cx": cell("glon", wide), "initial": F.substring("folded", 1, 1)})
    near = asks.join(alike, "a").join(there, ["cy", "cx", "initial", "b"]).filter(right & (apart <= NEAR_KM))
    best = near.groupBy("place_id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "geonameid", "gname", "glat", "glon")).alias("e"))
    note = F.format_string("geonames spelling match %s (%.2f)", F.col("e.gname"), -F.col("e.r"))
    fuzzy_ = best.select("place_id", "e.geonameid", "e.glat", "e.glon", F.lit("medium").alias("gconfidence"), note.alias("gnote"))
    return exact.unionByName(fuzzy_)


def locate(places: DataFrame, names: DataFrame, candidates: DataFrame, entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """place_id, lat, lon, candidate, geonameid, method, confidence, note of every place.

    By hand, else the best candidate (unless it lies far from the anchor and the gazetteer has one near it), else the
    gazetteer, else the anchor itself: where the index gives a name like the place's it is its modern name, else the
    commune that it belongs to. places: place_id, country, place_type, alat, alon, canton; overrides: place_id, lat, lon, note.
    """
    found = best_candidates(places, names, candidates)
    known = gazetteer_matches(places, names, entries)
    rows = places.join(found, "place_id", "left").join(known, "place_id", "left")
    hand = overrides.select("place_id", F.col("lat").alias("hlat"), F.col("lon").alias("hlon"), F.col("note").alias("hnote"), F.lit(True).alias("by_hand"))
    alike = names.join(places.filter("alat is not null").select("place_id", tx.fold(F.col("canton")).alias("c")), "place_id").filter(ratio("folded", "c") >= 0.85).select("place_id").distinct().withColumn("modern", F.lit(True))
    rows = rows.join(hand, "place_id", "left").join(alike, "place_id", "left")
    far = F.coalesce(F.contains("note", F.lit("km from")), F.lit(False))
    use_candidate = F.col("candidate").isNotNull() & ~(far & F.col("geonameid").isNotNull())
    spelled = F.regexp_extract(F.coalesce("gnote", F.lit("")), r"\(([0-9.]+)\)$", 1)
    case = F.when(F.col("by_hand"), "override").when(use_candidate, "wikidata").when(F.col("geonameid").isNotNull(), "geonames").when(F.col("alat").isNotNull() & F.col("modern"), "index-modern-name").when(F.col("alat").isNotNull(), "approximate").otherwise("unlocated")
    rows = rows.withColumn("method", case)
    by = lambda **v: F.when(F.col("method") == "override", v["override"]).when(F.col("method") == "wikidata", v["wikidata"]).when(F.col("method") == "geonames", v["geonames"]).when(F.col("method") == "unlocated", v["none"]).otherwise(v["anchor"])
    none = F.lit(None)
    return rows.select(
        "place_id", "method",
        by(override=F.col("hlat"), wikidata=F.round("clat", 5), geonames=F.round("glat", 5), anchor=F.round("alat", 5), none=none).alias("lat"),
        by(override=F.col("hlon"), wikidata=F.round("clon", 5), geonames=F.round("glon", 5), anchor=F.round("alon", 5), none=none).alias("lon"),
        F.when(F.col("method") == "wikidata", F.col("candidate")).alias("candidate"), F.when(F.col("method") == "geonames", F.col("geonameid")).alias("geonameid"),
        by(override=F.lit("high"), wikidata=F.when(far, "low").otherwise(F.col("confidence")), geonames=F.when((spelled != "") & (spelled.try_cast("double") < 0.95), "low").otherwise(F.col("gconfidence")), anchor=F.when(F.col("method") == "approximate", "low").otherwise("medium"), none=F.lit("low")).alias("confidence"),
        by(
            override=F.coalesce("hnote", F.lit("")), wikidata=F.col("note"), geonames=F.col("gnote"),
            anchor=F.when(F.col("method") == "approximate", F.concat(F.lit("not in Wikidata/GeoNames; placed at "), "canton", F.lit(" (index location)"))).otherwise(F.concat(F.lit("the book's index names it "), "canton")),
            none=F.lit("no candidate (and no canton for a fuzzy search)"),
        ).alias("note"),
    )


def _middles(pools: DataFrame, c: str) -> DataFrame:
    """parent_id, of, at: how many members a territory has, and by place in the order of (c, child_id) the two or three around the middle."""
    near = numbered(pools, ["parent_id"], [c, "child_id"], "middles").where(F.col("place").between(F.floor((F.col("of") - 1) / 2), F.floor((F.col("of") - 1) / 2) + 1))
    return near.groupBy("parent_id", "of").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct(F.col(c).alias("v"), F.col("child_id").alias("id"))))).alias("at"))


def territory_context(located: DataFrame, memberships: DataFrame, top: DataFrame, least: int = 3) -> DataFrame:
    """place_id, xlat, xlon: the mean of its territories' centres, each the upper median of its other reliable members, of least of them; without any, those of the territories above.

    The direct members of the top territories (top: id) span too much to be a centre. The median without a member
    follows from its place in the order of all, so no row carries a territory's members.
    """
    reliable = located.filter("lat is not null and confidence <> 'low'").select(F.col("place_id").alias("child_id"), "lat", "lon")
    edges = memberships.select("child_id", "parent_id").distinct()
    pools = edges.join(reliable, "child_id").join(top.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("parent_id", "child_id", "lat", "lon")
    middles = {c: stored(_middles(pools, c), "middles") for c in ("lat", "lon")}
    inside = pools.select("parent_id", F.col("child_id").alias("place_id"), F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon"))

    def centres(asks: DataFrame) -> DataFrame:
        rows = asks.join(inside, ["parent_id", "place_id"], "left")
        for c, middle in middles.items():
            rows = rows.join(middle, "parent_id")
            # Without a member that stands before the middle, the middle of the others is the next one.
            others = F.col("of") - F.col(f"own_{c}").isNotNull().cast("long")
            stands = F.struct(F.col(f"own_{c}").alias("v"), F.col("place_id").alias("id"))
            after = F.when(F.col(f"own_{c}").isNull(), F.element_at("at", F.floor(F.col("of") / 2))).otherwise(F.when(stands <= F.element_at("at", F.floor((F.col("of") - 1) / 2)), F.element_at("at", F.floor((F.col("of") - 1) / 2) + 1)).otherwise(F.element_at("at", F.floor((F.col("of") - 1) / 2))))
            rows = rows.where(others >= least).withColumn(c, after["v"]).drop("at", "of")
        return rows.groupBy("place_id").agg(F.avg("lat").alias("xlat"), F.avg("lon").alias("xlon"))

    own = centres(edges.select(F.col("child_id").alias("place_id"), "parent_id"))
    above = edges.select(F.col("child_id").alias("place_id"), F.col("parent_id").alias("via")).join(edges.withColumnRenamed("child_id", "via"), "via").select("place_id", "parent_id")
    return own.unionByName(centres(above.join(own.select("place_id"), "place_id", "left_anti")))


def refine(located: DataFrame, context: DataFrame, places: DataFrame, names: DataFrame, candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """located, with places that lie far from their territory's others, or are weakly known, matched again near them; those that stay far are flagged.

    It works on what was located at first: one place's change doesn't move another's context.
    """
    at = located.join(context, "place_id", "left").filter("method <> 'override' and xlat is not null")
    far = F.col("lat").isNull() | (km(F.col("xlat"), F.col("xlon"), F.col("lat"), F.col("lon")) > CONTEXT_KM)
    weak = (F.col("confidence") == "low") | F.contains("note", F.lit("no canton")) | F.contains("note", F.lit("ambiguous"))
    asks = stored(at.withColumn("far", far).filter(F.col("far") | weak).filter(~((F.col("method") == "approximate") & F.col("far"))), "refine")
    there = places.drop("alat", "alon").join(asks.select("place_id", F.col("xlat").alias("alat"), F.col("xlon").alias("alon")), "place_id")
    own = names.join(asks.select("place_id"), "place_id", "left_semi")
    near = best_candidates(there, own, candidates).select("place_id", F.col("candidate").alias("c2"), "clat", "clon")
    known = gazetteer_matches(there, own, entries).withColumnRenamed("geonameid", "g2")
    rows = asks.join(near, "place_id", "left").join(known, "place_id", "left")
    fits = F.col("c2").isNotNull() & (km(F.col("xlat"), F.col("xlon"), F.col("clat"), F.col("clon")) <= CONTEXT_KM)
    case = F.when(fits & ~F.col("c2").eqNullSafe(F.col("candidate")), "moved").when(fits & F.startswith("note", F.lit("ambiguous")), "settled").when(F.col("glat").isNotNull() & F.col("far"), "gazetteer").when(F.col("far") & F.col("lat").isNotNull(), "flagged").otherwise("same")
    rows = rows.withColumn("case", case)
    text = "chosen near its territory's other members"
    gap = F.format_string("%.0f km from its territory's other members", km(F.col("xlat"), F.col("xlon"), F.col("lat"), F.col("lon")))
    pick = lambda moved, settled, gazetteer, flagged, same: F.when(F.col("case") == "moved", moved).when(F.col("case") == "settled", settled).when(F.col("case") == "gazetteer", gazetteer).when(F.col("case") == "flagged", flagged).otherwise(same)
    keep = lambda c: (F.col(c),) * 3
    lat, lon = pick(F.round("clat", 5), F.col("lat"), F.round("glat", 5), *keep("lat")[:2]), pick(F.round("clon", 5), F.col("lon"), F.round("glon", 5), *keep("lon")[:2])
    changed = rows.select(
        "place_id", pick(F.lit("wikidata"), F.col("method"), F.lit("geonames"), *keep("method")[:2]).alias("method"), lat.alias("lat"), lon.alias("lon"),
        pick(F.col("c2"), F.col("candidate"), F.lit(None), *keep("candidate")[:2]).alias("candidate"), pick(F.lit(None), F.col("geonameid"), F.col("g2"), *keep("geonameid")[:2]).alias("geonameid"),
        pick(F.lit("medium"), F.lit("medium"), F.when(F.contains("gnote", F.lit("exact")), "medium").otherwise("low"), F.lit("low"), F.col("confidence")).alias("confidence"),
        pick(F.lit(text), F.lit(text), F.concat("gnote", F.lit("; " + text)), F.concat_ws("; ", F.nullif(F.col("note"), F.lit("")), gap), F.col("note")).alias("note"),
    )
    return located.join(changed.select("place_id"), "place_id", "left_anti").select(*located.columns).unionByName(changed.select(*located.columns))


def placed(located: DataFrame, rules: DataFrame) -> DataFrame:
    """located, with rules for places that no database has: at another place's point, or nowhere. rules: place_id, approximate (a place or null), note."""
    target = located.select(F.col("place_id").alias("approximate"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    ruled = rules.select("place_id", "approximate", F.col("note").alias("rnote"), F.lit(True).alias("ruled")).join(target, "approximate", "left")
    rows = located.join(ruled, "place_id", "left")
    has = F.col("tlat").isNotNull()
    change = {
        "lat": F.col("tlat"), "lon": F.col("tlon"), "candidate": F.lit(None), "geonameid": F.lit(None), "confidence": F.lit("low"), "method": F.when(has, "approximate").otherwise("unlocated"),
        "note": F.coalesce("rnote", F.when(has, F.concat(F.lit("placed at "), "approximate", F.lit(" (rules.yaml)"))).otherwise("site unknown (rules.yaml)")),
    }
    return rows.select(*[F.when(F.col("ruled"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in located.columns])


def label_points(territories: DataFrame, located: DataFrame, memberships: DataFrame) -> DataFrame:
    """place_id, lat, lon, note: a territory's point is its seat's (the located settlement of its base name, the last by id), else the mean of its located members. territories: place_id, name; located: place_id, name, lat, lon."""
    base = lambda df: df.withColumn("base", tx.base_name(tx.fold(F.col("name"))))
    there = located.filter("lat is not null")
    seats = base(there).groupBy("base").agg(F.max(F.struct("place_id", "lat", "lon")).alias("s"))
    seats = seats.select("base", F.col("s.place_id").alias("seat"), F.col("s.lat").alias("slat"), F.col("s.lon").alias("slon"))
    inside = memberships.select(F.col("child_id").alias("place_id"), "parent_id").distinct().join(there.select("place_id", "lat", "lon"), "place_id").groupBy(F.col("parent_id").alias("place_id")).agg(F.round(F.avg("lat"), 5).alias("mlat"), F.round(F.avg("lon"), 5).alias("mlon"), F.count("*").alias("n"))
    rows = base(territories).join(seats, "base", "left").join(inside, "place_id", "left")
    note = F.when(F.col("seat").isNotNull(), F.concat(F.lit("seat: "), "seat")).when(F.col("n") > 0, F.format_string("centre of %d member settlement(s)", "n")).otherwise("no seat or located members")
    return rows.select("place_id", F.coalesce("slat", "mlat").alias("lat"), F.coalesce("slon", "mlon").alias("lon"), note.alias("note"))


def excluded_from_areas(geocoding: DataFrame) -> DataFrame:
    """place_id of places whose point must not add land: placed approximately, or doubtful (far from their territory, or by spelling)."""
    doubtful = (F.col("confidence") == "low") & (F.contains("note", F.lit("from its territory")) | F.contains("note", F.lit("spelling match")))
    return geocoding.filter((F.col("method") == "approximate") | doubtful).select("place_id")


def geocode_stats(geocoding: DataFrame) -> DataFrame:
    return geocoding.groupBy("method", "confidence").agg(F.count("*").alias("n"), F.count("lat").alias("located"))
