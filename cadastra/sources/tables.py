"""Loaders of the dataset's files: curated tables, vocabulary, rules, extraction records, gazetteers, section lists.

Paths are read by Spark, so they may be in any store that it knows. A loader of a
table returns its rows and a frame of issues (level, table_name, row, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cadastra.functions import text as tx
from cadastra.operators.fuzzy import can_reach, ratio
from cadastra.operators.shared import stored

_PROVENANCE = "source_page:pages confidence:confidence notes:text"
_PERIOD = "from_year:year to_year:year from_precision:text to_precision:text"
#: The columns of each table and what they hold, in the files' order.
TABLES = {
    "places": f"id:slug kind:kind name_fr:needed name_de:text name_en:text variants:list place_type:needed lat:latitude lon:longitude wikidata_id:item geonames_id:whole modern_country:country {_PROVENANCE}",
    "entities": f"id:slug name_en:needed name_fr:needed name_de:text entity_type:needed color:colour {_PROVENANCE}",
    "rulers": f"entity_id:slug person_name:needed title:text {_PERIOD} {_PROVENANCE}",
    "memberships": f"child_id:slug parent_id:slug is_disputed:flag {_PERIOD} {_PROVENANCE}",
    "rights": f"place_id:slug right_type:needed holder_id:slug share:share status:text is_disputed:flag disputed_with:list {_PERIOD} snippet:text {_PROVENANCE}",
    "events": f"year:needed_year place_id:slug right_type:text from_holder:slug_or_none to_holder:slug_or_none event_type:needed description:text {_PROVENANCE}",
}
ISSUE = "level string, table_name string, row long, message string"
_SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def columns_of(table: str) -> list[str]:
    return [c.split(":")[0] for c in TABLES[table].split()]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_cells(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """The rows of a CSV file that aren't blank, all cells as text, and line: the row's number in the file, where the header is 1.

    path may be a folder of files, each with the header; their rows are numbered on from one to the next, by the files'
    names. A missing file gives no rows (columns names those of it). One file is one task: a cell may hold line ends.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns or []])).withColumn("line", F.lit(0).cast("long"))
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', inferSchema=False, enforceSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = [c for c in raw.columns]
    # A file lies whole in one partition, so its rows have consecutive numbers there.
    at = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    at = stored(at.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in cells], "_file", "_at"), "cells")
    files = at.groupBy("_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))  # a row a file
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_file", (before - F.col("_first") + 2).alias("_shift"))
    numbered = at.join(files, "_file").select(*[f"`{c}`" for c in cells], (F.col("_at") + F.col("_shift")).alias("line"))
    return numbered.filter(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in cells]) != "")


def _checked(cell: Column, kind: str) -> tuple[Column, Column]:
    """A cell's value, and what is wrong with it (null if nothing)."""
    t = F.trim(cell)
    value = F.nullif(t, F.lit(""))
    must = F.when(value.isNull(), "a value is needed")
    fits = lambda rule, what: F.when(value.isNotNull() & ~value.rlike(rule), what)
    number = lambda to: F.expr("1") if to is None else value.try_cast(to)
    between = lambda v, low, high, what: F.when(value.isNotNull() & ~F.coalesce(v.between(low, high), F.lit(False)), what)
    year = number("int")
    return {
        "text": (value, F.lit(None).cast("string")),
        "needed": (value, must),
        "slug": (value, F.coalesce(must, fits(_SLUG, "not an id"))),
        "slug_or_none": (value, fits(_SLUG, "not an id")),
        "kind": (value, F.coalesce(must, fits("^(settlement|territory)$", "not a kind of place"))),
        "country": (value, fits("^(FR|DE|LU)$", "not a country")),
        "confidence": (F.coalesce(value, F.lit("high")), fits("^(high|medium|low)$", "not a confidence")),
        "pages": (value, fits(r"^\d+(-\d+)?(;\d+(-\d+)?)*$", "not a list of pages")),
        "share": (value, fits(r"^(\d+/\d+|joint)$", "not a share")),
        "colour": (value, fits("^#[0-9a-fA-F]{6}$", "not a colour")),
        "item": (value, fits(r"^Q\d+$", "not an item's id")),
        "whole": (number("long"), F.when(value.isNotNull() & number("long").isNull(), "not a whole number")),
        "year": (year, between(year, 1000, 1800, "not a year from 1000 to 1800")),
        "needed_year": (year, F.coalesce(must, between(year, 1000, 1800, "not a year from 1000 to 1800"))),
        "latitude": (number("double"), between(number("double"), -90, 90, "not a latitude")),
        "longitude": (number("double"), between(number("double"), -180, 180, "not a longitude")),
        "flag": (F.coalesce(F.lower(t).isin("true", "1", "yes"), F.lit(False)), F.when(value.isNotNull() & ~F.lower(t).isin("true", "1", "yes", "false", "0", "no"), "neither true nor false")),
        "list": (tx.list_cell(cell), F.lit(None).cast("string")),
    }[kind]


def load(spark: SparkSession, folder: str, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a table with their types and lines, and its issues.

    A missing file is a warning and no rows; unknown columns are an error and no rows; a row with a cell that doesn't
    fit is left out, with an error for each such cell. Missing columns are empty.
    """
    columns = [c.split(":") for c in TABLES[table].split()]
    path, none = f"{folder}/{table}.csv", spark.createDataFrame([], ISSUE)
    issue = lambda *row: spark.createDataFrame([row], ISSUE)
    there = exists(spark, path)
    cells = read_cells(spark, path, [n for n, _ in columns])
    unknown = sorted(set(cells.columns) - {n for n, _ in columns} - {"line"})
    if unknown:
        cells = cells.limit(0)
    for name, _ in columns:
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(""))
    values, faults = [], []
    for name, kind in columns:
        value, fault = _checked(F.col(name), kind)
        values.append(value.alias(name))
        faults.append(F.when(fault.isNotNull(), F.concat(F.lit(name + ": "), fault)))
    period = F.when(F.col("v.from_year") > F.col("v.to_year"), "row: from_year is after to_year") if "from_year" in dict(columns) else F.lit(None).cast("string")
    # Stored twice: the checks are long expressions, which a filter over them would repeat.
    judged = stored(cells.select("line", F.struct(*values).alias("v"), F.array(*faults).alias("f")), f"load-{table}")
    judged = stored(judged.select("line", "v", F.array_compact(F.concat("f", F.array(period))).alias("faults")), f"load-{table}")
    rows = judged.filter(F.size("faults") == 0).select("v.*", "line")
    issues = judged.select(F.lit("error").alias("level"), F.lit(table).alias("table_name"), F.col("line").alias("row"), F.explode("faults").alias("message"))
    if not there:
        issues = issue("warning", table, None, "file missing (treated as empty)")
    elif unknown:
        issues = issue("error", table, 1, f"unknown columns: {', '.join(unknown)}")
    return rows, none.unionByName(issues)


def _yaml(spark: SparkSession, path: str):
    """A small YAML file's content; null for a missing or empty one. Vocabularies and rules are written by hand."""
    import yaml

    if not exists(spark, path):
        return None
    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """vocab, key, labels (by language), applies_to, core."""
    found = [(v, k, {x: str(t) for x, t in entry.items() if x in ("en", "fr", "de", "ja")}, entry.get("applies_to"), bool(entry.get("core"))) for v, keys in (_yaml(spark, path) or {}).items() for k, entry in keys.items()]
    return spark.createDataFrame(found, "vocab string, key string, labels map<string,string>, applies_to string, core boolean")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """section, seq, key, fields: a row a rule in order; a rule that is a plain value has it under ""; lists are joined by bars, nested fields by dots."""
    text = lambda v: "|".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)

    def flat(rule) -> dict[str, str]:
        if not isinstance(rule, dict):
            return {"": text(rule)}
        return {f"{k}.{n}" if n else str(k): v for k, inner in rule.items() for n, v in flat(inner).items()}

    rows = []
    for section, rules in (_yaml(spark, path) or {}).items():
        each = rules.items() if isinstance(rules, dict) else enumerate(rules or [])
        rows += [(section, i, str(k) if isinstance(rules, dict) else "", flat(rule)) for i, (k, rule) in enumerate(each)]
    return spark.createDataFrame(rows, "section string, seq int, key string, fields map<string,string>")


#: The lists of an extraction record and their fields.
EXTRACTION = {
    "places": "name_in_text string, index_name string, kind string, place_type string, other_names array<string>",
    "entities": "id string, name_fr string, name_en string, name_de string, entity_type string",
    "memberships": "child string, parent string, from_year int, to_year int, source_page string",
    "rulers": "entity_id string, person_name string, title string, from_year int, to_year int, source_page string, confidence string",
    "rights": "place string, right_type string, holder_id string, share string, status string, is_disputed boolean, disputed_with array<string>, from_year int, to_year int, from_precision string, to_precision string, source_page string, snippet string, confidence string, notes string",
    "events": "year int, place string, right_type string, from_holder string, to_holder string, event_type string, description string, source_page string, confidence string",
}


def load_extractions(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """chunk_id, pos and the fields of one list of all extraction records L*_*.json: (chunk_id, pos) is the order in which facts were found."""
    schema = f"extraction struct<{table}: array<struct<{EXTRACTION[table].replace(' ', ': ').replace(',: ', ', ')}>>>"
    if not exists(spark, f"{folder}/L*_*.json"):
        return spark.createDataFrame([], f"chunk_id string, pos int, {EXTRACTION[table]}")
    records = spark.read.schema(schema).json(f"{folder}/L*_*.json", multiLine=True)
    named = records.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("chunk_id"), F.posexplode(f"extraction.{table}").alias("pos", "row"))
    return named.select("chunk_id", "pos", "row.*")


def load_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries and cross-references of a place index: name, variants, see, dept_code, canton, pages, raw, line, and entry.

    entry is the line of the first entry with the same folded name and department whose canton is alike (ratio 0.8 or
    more): the index repeats some entries with a slip in the canton. A reference has see and no pages.
    """
    rows = read_cells(spark, path, ["name", "variants", "see", "dept_code", "department", "country", "canton", "pages", "raw"])
    rows = stored(rows.withColumn("folded", tx.fold(F.col("name"))).withColumn("place", tx.fold(F.col("canton"))), "gazetteer")
    refers = (F.col("see") != "") & (F.col("pages") == "")
    entries = rows.filter(~refers)
    # Only an entry that has no twin before it can be a twin. All that counts is in the different cantons of a name and
    # the first line of each: a later line of one has its first one before it.
    name = ["folded", "dept_code"]
    cantons = stored(entries.groupBy(*name, "place").agg(F.min("line").alias("line")), "gazetteer-cantons")
    others = cantons.select(*name, F.col("place").alias("other"), F.col("line").alias("first"))
    pairs = cantons.join(others, name).where((F.col("other") != F.col("place")) & can_reach(F.col("other"), F.col("place"), 0.8))
    near = stored(pairs.filter(ratio("other", "place") >= 0.8), "gazetteer-near")
    own = [*name, "place"]
    heads = stored(cantons.join(near.filter("first < line").select(*own), own, "left_anti"), "gazetteer-heads")
    alike = near.select(*own, "first").join(heads.select(*name, F.col("line").alias("first")), [*name, "first"]).select(*own, "first")
    twin = alike.unionByName(heads.select(*own, F.col("line").alias("first"))).groupBy(*own).agg(F.min("first").alias("entry"))
    entries = entries.join(twin, own, "left").withColumn("entry", F.least("line", F.coalesce("entry", "line")))
    return entries.drop("folded", "place"), rows.filter(refers).drop("folded", "place")


def load_geonames(spark: SparkSession, path: str, box: tuple[float, float, float, float], features: tuple[str, ...]) -> DataFrame:
    """geonameid, name, lat, lon, country, feature, names (folded): the places of a GeoNames table within (south, west, north, east) of the classes or codes in features ("P", "S.CSTL")."""
    raw = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    south, west, north, east = box
    lat, lon = at(4).try_cast("double"), at(5).try_cast("double")
    code = F.concat(at(6), F.lit("."), at(7))
    some = raw.filter((lat > south) & (lat < north) & (lon > west) & (lon < east) & (at(6).isin(*features) | code.isin(*features)))
    some = some.select(at(0).cast("long").alias("geonameid"), at(1).alias("name"), lat.alias("lat"), lon.alias("lon"), at(8).alias("country"), code.alias("feature"), F.concat(F.array(at(1), at(2)), F.split(at(3), ",")).alias("n"))
    folded = some.select("geonameid", F.explode("n").alias("n")).filter("n <> ''").select("geonameid", tx.fold(F.col("n")).alias("n")).filter("n <> ''")
    return some.drop("n").join(folded.groupBy("geonameid").agg(F.array_sort(F.collect_set("n")).alias("names")), "geonameid")


def select_sections(index: DataFrame, which: str, priority: list[tuple[int, int]]) -> DataFrame:
    """The sections of an index that are wanted: "all", "priority" (of those books and chapters), or a list of ids; an id that isn't there is an error."""
    if which == "all":
        return index
    if which == "priority":
        return index.filter(F.struct(F.col("livre").cast("int"), F.col("chapter").cast("int")).isin([F.struct(F.lit(a), F.lit(b)) for a, b in priority]))
    wanted = sorted({w.strip() for w in which.split(",")})
    chosen = index.filter(F.col("id").isin(*wanted))
    missing = sorted(set(wanted) - {r["id"] for r in chosen.select("id").distinct().collect()})  # as many as were asked for
    if missing:
        raise ValueError(f"unknown section ids: {missing}")
    return chosen


def known_entities(curated: DataFrame, suggested: DataFrame) -> DataFrame:
    """id, name_fr: curated entities and those suggested that aren't among them."""
    return curated.select("id", "name_fr").unionByName(suggested.select("id", "name_fr").join(curated.select("id"), "id", "left_anti"))


def read_blocks_schema() -> StructType:
    """What a text layer's reader has to give: page, x0, y0, x1, y1 and the lines of each block."""
    return StructType.fromDDL("page int, x0 double, y0 double, x1 double, y1 double").add("lines", ArrayType(StringType()))
