"""Steps whose cost must follow the input where many rows share a key."""

import csv
import random
import time
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastra.operators import curate, fuzzy, geocode, geometry, resolve, shared, textflow, validate
from cadastra.sources import tables


def counted(spark, monkeypatch, module):
    """The number of pairs of texts that module asks the ratio of, from now on."""
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    monkeypatch.setattr(module, "ratio", ratio)
    return asked


def gazetteer(path, rows):
    with open(path, "w", newline="") as out:
        write = csv.writer(out)
        write.writerow(["name", "variants", "see", "dept_code", "department", "country", "canton", "pages", "raw"])
        write.writerows([name, "", "", "M.", "Moselle", "FR", canton, "1", "raw"] for name, canton in rows)
    return str(path)


def test_gazetteer_twins_are_those_of_all_pairs(spark, tmp_path):
    random.seed(5)
    cantons = ["", "abcdefgh", "abcdefgx", "abcdexgx", "bacdefgh", "zbcdefgh", "hgfedcba", "abcdabcd"]
    rows = [(random.choice(["Alt", "Neu"]), random.choice(cantons)) for _ in range(60)]
    entries, _ = tables.load_gazetteer(spark, gazetteer(tmp_path / "g.csv", rows))
    alike = lambda a, b: SequenceMatcher(None, a, b, False).ratio() >= 0.8
    before = {x: [y for y in range(x) if rows[y][0] == rows[x][0] and alike(rows[y][1], rows[x][1])] for x in range(len(rows))}
    want = {x + 2: min((y for y in before[x] if not before[y]), default=x) + 2 for x in before}
    assert {r.line: r.entry for r in entries.collect()} == want


def test_gazetteer_compares_each_canton_once(spark, tmp_path, monkeypatch):
    asked = counted(spark, monkeypatch, tables)
    entries, _ = tables.load_gazetteer(spark, gazetteer(tmp_path / "g.csv", [("Neuville", "abcdefgh" if i % 2 else "abcdefgx") for i in range(2000)]))
    assert {r.entry for r in entries.collect()} == {2} and asked.value < 100


def test_a_table_in_several_files_is_numbered_through(spark, tmp_path):
    rows = spark.range(600).select("id", F.when(F.col("id") % 7 == 0, " ").otherwise(F.col("id").cast("string")).alias("a"), F.when(F.col("id") % 7 == 0, " ").otherwise('b "x",\ny').alias("b"))
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").select("a", "b").write.csv(str(tmp_path / "t.csv"), header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = tables.read_cells(spark, str(tmp_path / "t.csv"))
    assert sorted((r.line, int(r.a)) for r in got.collect()) == [(i + 2, i) for i in range(600) if i % 7]


@pytest.mark.parametrize("cutoff", [0.92, 0.8])
def test_alike_pairs_are_those_of_all_pairs(spark, cutoff):
    random.seed(7)

    def changed(t):
        for _ in range(random.randint(0, 4)):
            i = random.randint(0, len(t))
            t = random.choice([t[:i] + t[i + 1 :], t[:i] + random.choice("ab") + t[i:], t[:i] + random.choice("ab") + t[i + 1 :]])
        return t

    base = ["".join(random.choice("abcdef") for _ in range(n)) for n in (1, 2, 5, 9, 12, 13, 14, 19, 20, 21, 24, 30, 45) for _ in range(3)]
    left, right = sorted({"", *(changed(t) for t in base * 3)}), sorted({"", *(changed(t) for t in base * 3)})
    frame = lambda names, c: spark.createDataFrame([(n,) for n in names], f"{c} string")
    got = fuzzy.alike_pairs(frame(left, "a"), frame(right, "b"), cutoff).collect()
    want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b, False).ratio() >= cutoff}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and max(len(a) for a, _ in want) > 30


def test_spelling_matches_compare_few_pairs(spark, monkeypatch):
    asked = counted(spark, monkeypatch, fuzzy)
    k = F.col("k")
    ids = spark.range(2000).select((F.col("id") + 10_000).alias("k"))
    places = ids.select(k.alias("place_id"), F.lit("").alias("country"), F.lit(48.0).alias("alat"), F.lit(6.0).alias("alon"))
    names = ids.select(k.alias("place_id"), F.concat(F.lit("name "), k.cast("string")).alias("folded"))
    entries = ids.select(k.alias("geonameid"), F.lit("n").alias("name"), F.lit(48.01).alias("lat"), F.lit(6.01).alias("lon"), F.lit("FR").alias("country"), F.lit("P.PPL").alias("feature"), F.array(F.concat(F.lit("name "), (k * 10).cast("string"))).alias("names"))
    got = {(r.place_id, r.geonameid) for r in geocode.gazetteer_matches(places, names, entries).collect()}
    gone = lambda t: {t[:i] + t[i + 1 :] for i in range(len(t))}
    numbers = {str(i * 10): i for i in range(10_000, 12_000)}
    want = {p: min((e for n, e in numbers.items() if str(p) in gone(n)), default=None) for p in range(10_000, 12_000)}
    assert got == {(p, e) for p, e in want.items() if e} and asked.value < 60_000


def folded(rows, first, last):
    """Rows of one key, one after another, each into the first kept one that it overlaps."""
    kept = []
    for row in sorted(rows, key=lambda r: (-(r[1] is not None) - (r[2] is not None), r[1] or 0, r[0])):
        for k in kept:
            low, high = (max(first - 1 if x is None else x for x in (k[1], row[1]))), (min(last + 1 if x is None else x for x in (k[2], row[2])))
            if high >= low and not (high == low and (k[2] == row[1] or row[2] == k[1])):
                k[3], k[4] = sorted(set(k[3]) | set(row[3])), (k[4] or (row[4] if row[4] is not None else k[4]))
                break
        else:
            kept.append([*row])
    return {(*k[:3], tuple(k[3]), k[4]) for k in kept}


def test_merged_periods_are_those_of_a_fold(spark):
    random.seed(11)
    year = lambda: random.choice([None, 1600, 1601, 1602, 1603, 1605])
    rows = [(i, year(), year(), [random.randint(1, 9)] * random.randint(1, 2), random.choice([None, "", "x", "y"])) for i in range(400)]
    key = {r[0]: random.choice(["p", "q", "r", None]) for r in rows}
    frame = spark.createDataFrame([(key[r[0]], *r) for r in rows], "place string, seq long, from_year int, to_year int, pages array<int>, notes string")
    got = curate.merge_overlapping(frame, ["place"], 1600, 1605, ("notes",)).collect()
    want = {(p, *row) for p in ("p", "q", "r", None) for row in folded([r for r in rows if key[r[0]] == p], 1600, 1605)}
    assert {(r.place, r.seq, r.from_year, r.to_year, tuple(r.pages), r.notes) for r in got} == want and len(got) == len(want)


def test_many_rows_of_one_year_are_not_compared_with_each_other(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit("p").alias("place"), F.col("id").alias("seq"), F.lit(1601).alias("from_year"), F.lit(1601).alias("to_year"), F.array(F.lit(1)).alias("pages"))
    began = time.time()
    assert curate.merge_overlapping(rows, ["place"], 1600, 1605).count() == n and time.time() - began < 60  # a fold of the rows takes n * n / 2 comparisons


def test_alias_chains_are_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.stored(df, name)

    monkeypatch.setattr(curate, "stored", seen)
    links = spark.range(200).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("a"), (F.col("id") + 1).cast("string")).alias("target"))
    assert {r.canonical for r in curate.canonical(links.unionByName(spark.createDataFrame([("x", "x")], "alias string, target string"))).collect()} == {"a200", "x"}
    assert len(plans) > 8 and not any("BroadcastHashJoin" in p for p in plans)


def test_nearest_sites_in_parts_that_grow(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 40)
    dice = random.Random(1)
    sites = [(f"s{i:02}", float(dice.randrange(0, 9000)), float(dice.randrange(0, 9000))) for i in range(60)] + [("a", 100.0, 100.0), ("b", 100.0, 100.0)]
    points = [(i, float(dice.randrange(-7000, 16000)), float(dice.randrange(-7000, 16000))) for i in range(400)] + [(400, 100.0, 100.0)]
    made = geometry.nearest_in_plane(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(sites, "site string, x double, y double"), 3000.0)
    best = {p: min((((x - sx) ** 2 + (y - sy) ** 2) ** 0.5, s) for s, sx, sy in sites) for p, x, y in points}
    assert {r.point: r.site for r in made.collect()} == {p: s for p, (d, s) in best.items() if d <= 3000}
    assert made.rdd.getNumPartitions() >= 10
    degrees = lambda rows, names: spark.createDataFrame([(n, 48 + y / 1e5, 6 + x / 1e5) for n, x, y in rows], names)
    places, anchors = degrees(points, "id long, lat double, lon double"), degrees(sites, "anchor string, lat double, lon double")
    pairs = geometry.within(places, anchors, 3.0).groupBy("id").agg(F.min(F.struct(F.round("km", 9).alias("km"), "anchor")).alias("n")).select("id", "n.anchor", "n.km")
    found = geometry.nearest(places, anchors, 3.0)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pairs.collect()))


def test_windows_over_parts_that_grow(spark, monkeypatch):
    monkeypatch.setattr(shared, "PART_ROWS", 20)
    glyphs = spark.range(300).selectExpr("id div 3 as line", "id % 3 * 10.0D as x0", "id % 3 * 10.0D + 9 as x1", "10.0D as size", "'x' as char")
    made = textflow.letterspaced(glyphs)
    assert made.rdd.getNumPartitions() >= 15 and {r.text for r in made.collect()} == {"xxx"}
    marks = spark.range(300).selectExpr("id div 3 as page", "id % 3 * 100 as y0", "id % 3 * 100 + 10 as y1")
    gaps = textflow.uncovered(spark.range(100).selectExpr("id as page", "0L as top", "1000L as bottom"), marks)
    assert gaps.rdd.getNumPartitions() >= 20 and gaps.count() == 300


def test_changes_meet_a_holders_periods_and_no_rows(spark):
    rights = spark.range(3000).selectExpr("id as seq", "'p' as place_id", "'toll' as right_type", "'h' as holder_id", "cast(1600 + id % 3 as int) as from_year", "if(id % 2 = 0, 1650, cast(null as int)) as to_year")
    events = [(1, 1603, "p", "toll", None, "h"), (2, 1603, "p", "toll", "h", "h"), (3, 1604, "p", "toll", "x", "h"), (4, 1599, "p", "toll", None, "h"), (5, 1700, "p", "toll", "h", None), (5, 1700, "p", "toll", "h", None), (6, None, "p", "toll", None, "h"), (7, None, "q", "toll", None, "h")]
    found = validate.event_mismatches(spark.createDataFrame(events, "seq int, year int, place_id string, right_type string, from_holder string, to_holder string"), rights)
    got = sorted((r.level, r.row, (r.message or "").split(":")[0]) for r in found.collect())
    assert got == [("info", "3", "ends"), ("info", "7", ""), ("warning", "2", "ends"), ("warning", "3", "starts"), ("warning", "4", "holds"), ("warning", "5", "ends")]
    assert "collect_set" in found._jdf.queryExecution().optimizedPlan().toString()


def test_split_memberships_send_nothing_that_grows(spark):
    rows = spark.createDataFrame([("a", "fief", None, None, [1]), ("b", "office", 1600, None, [2])], "child_id string, parent_id string, from_year int, to_year int, pages array<int>")
    realms = spark.createDataFrame([("office", "fief")], "admin string, feudal string")
    places = spark.createDataFrame([("a", "settlement", "village"), ("b", "settlement", "village"), ("fief", "territory", "fief"), ("office", "territory", "office")], "id string, kind string, place_type string")
    found = resolve.split_memberships(rows, realms, places, ("fief",))
    assert sorted((r.child_id, r.parent_id) for r in found.collect()) == [("a", "fief"), ("a", "office"), ("b", "fief"), ("b", "office"), ("fief", "office")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("LeftAnti" in line or "LeftSemi" in line and "[child_id" in line)]


def test_overlaps_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(validate, "_BLOCK", 8)
    monkeypatch.setattr(validate, "_PART_PAIRS", 1 << 10)
    random.seed(7)
    year = lambda low, high: random.choice([None, *range(low, high)])
    rows = [
        (i, random.choice(["p", "p", "p", "q", None]), random.choice(["r", "s"]), f"h{random.randrange(4)}", random.choice([None, "1/2"]), random.choice(["held", "held", "claimed"]), random.random() < 0.1, year(1598, 1625), year(1605, 1633))
        for i in range(300)
    ]
    first, last, want = 1600, 1630, []
    for b in rows:
        for a in rows[: b[0]]:
            low = max(first - 1 if r[7] is None else r[7] for r in (a, b))
            high = min(last + 1 if r[8] is None else r[8] for r in (a, b))
            meets = (a[8] is not None and a[8] == b[7]) or (b[8] is not None and b[8] == a[7])
            if a[1] is None or a[1:3] != b[1:3] or low > high or (low == high and meets):
                continue
            if a[3] == b[3] and a[4] is None and b[4] is None and a[5] == b[5]:
                want.append(("warning", str(b[0]), f"duplicates line {a[0]}: same holder of {a[2]} at {a[1]} in overlapping years"))
            if a[3] != b[3] and None in (a[4], b[4]) and "claimed" not in (a[5], b[5]) and not (a[6] or b[6]):
                want.append(("info" if a[2] == "s" else "warning", str(b[0]), f"{a[2]} at {a[1]} overlaps line {a[0]} ({a[3]} vs {b[3]})"))
    frame = spark.createDataFrame(rows, "seq long, place_id string, right_type string, holder_id string, share string, status string, is_disputed boolean, from_year int, to_year int")
    got = [(r.level, r.row, r.message) for r in validate.overlapping(frame, first, last, ("s",)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 1000


def test_overlaps_cost_what_they_find(spark):
    n, open_ = 60_000, 3
    of_all = [F.lit("p").alias("place_id"), F.lit("r").alias("right_type"), F.lit("held").alias("status"), F.lit(False).alias("is_disputed"), F.lit(1600).alias("from_year"), F.lit(1604).alias("to_year")]
    rows = spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("h"), "id").alias("holder_id"), F.when(F.col("id") >= open_, "1/9").alias("share"), *of_all)
    began = time.time()
    assert validate.overlapping(rows, 1600, 1630).count() == open_ * (n - open_) + open_ * (open_ - 1) // 2
    assert time.time() - began < 60  # all pairs are 1.8 thousand million
