"""Checking extracted records against the vocabulary: good facts go on, bad ones apart, with what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators.shared import stored

_TEXT, _NUMBER, _FLAG, _LIST = "STRING", "BIGINT", "BOOLEAN", "ARRAY<STRING>"
_DATED = {"from_year": _NUMBER, "to_year": _NUMBER, "from_precision": _TEXT, "to_precision": _TEXT}

#: The lists of a record, and the fields that each of their rows must have.
SHAPES: dict[str, dict[str, str]] = {
    "places": {"name_in_text": _TEXT, "index_name": _TEXT, "kind": _TEXT, "place_type": _TEXT, "other_names": _LIST},
    "entities": {"id": _TEXT, "name_fr": _TEXT, "name_en": _TEXT, "name_de": _TEXT, "entity_type": _TEXT, "is_new": _FLAG, "source_page": _TEXT},
    "memberships": {"child": _TEXT, "parent": _TEXT, "from_year": _NUMBER, "to_year": _NUMBER, "source_page": _TEXT},
    "rulers": _DATED | {"entity_id": _TEXT, "person_name": _TEXT, "title": _TEXT, "source_page": _TEXT, "confidence": _TEXT},
    "rights": _DATED | {"place": _TEXT, "right_type": _TEXT, "holder_id": _TEXT, "share": _TEXT, "status": _TEXT, "is_disputed": _FLAG, "disputed_with": _LIST, "source_page": _TEXT, "snippet": _TEXT, "confidence": _TEXT, "notes": _TEXT},
    "events": {"year": _NUMBER, "place": _TEXT, "right_type": _TEXT, "from_holder": _TEXT, "to_holder": _TEXT, "event_type": _TEXT, "description": _TEXT, "source_page": _TEXT, "confidence": _TEXT},
}
#: List, field and the vocabulary whose keys it takes; the last tells whether it may be empty.
KEYED = (
    ("places", "place_type", "place_types", False),
    ("entities", "entity_type", "entity_types", False),
    ("rulers", "confidence", "confidence", False),
    ("rulers", "from_precision", "date_precisions", True),
    ("rulers", "to_precision", "date_precisions", True),
    ("rights", "right_type", "right_types", False),
    ("rights", "status", "statuses", False),
    ("rights", "confidence", "confidence", False),
    ("rights", "from_precision", "date_precisions", True),
    ("rights", "to_precision", "date_precisions", True),
    ("events", "right_type", "right_types", True),
    ("events", "event_type", "event_types", False),
    ("events", "confidence", "confidence", False),
)
KINDS = ("settlement", "territory")


def shape_of(fields: dict[str, str]) -> str:
    """How Spark names the type of an object with just these fields."""
    return "OBJECT<" + ", ".join(f"{k}: {fields[k]}" for k in sorted(fields)) + ">"


def _of_part(values: dict[str, Column | str]) -> Column:
    """The value for the row's list, null for lists without one."""
    found = F.lit(None).cast("string")
    for part, value in values.items():
        found = F.when(F.col("part") == part, F.lit(value)).otherwise(found)
    return found


def checked(raw: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """chunk_id, part, pos, row (JSON), problems of every row of every list; a record that is no object of the six lists has a row of its own, with part and pos null.

    A row must have all fields of its list, no others, each of its type and not null; keyed fields must be in the
    vocabulary (vocab, key) as it stands in the table, so a new key needs no new code. Rows are checked one by one: a
    bad one doesn't take the record's others along. raw: chunk_id, json; a null or repeated chunk_id is one like others.

    A record is parsed once, and each row is judged where it stands: a list's keyed fields stand side by side, and each
    looks its key up, so no problems go back to their rows by a join.
    """
    none, empty = F.array().cast("array<string>"), F.expr("cast(array() as array<variant>)")
    records = raw.select("chunk_id", "json", F.try_parse_json("json").alias("v"))
    records = records.select("chunk_id", "json", F.when(F.col("v").isNotNull(), F.json_object_keys("json")).alias("names"), *[F.try_variant_get("v", f"$.{t}", "array<variant>").alias(t) for t in SHAPES])
    known = F.array(*map(F.lit, SHAPES))
    odd = F.greatest(*[F.col(t).isNull() for t in SHAPES]) | (F.size("names") > len(SHAPES))
    missing = F.filter(F.array(*[F.when(F.col(t).isNull(), F.lit(f"{t}: no list")) for t in SHAPES]), lambda x: x.isNotNull())
    extra = F.transform(F.array_except("names", known), lambda k: F.concat(k, F.lit(": not a list of a record")))
    faults = F.when(F.col("names").isNull(), F.array(F.lit("not an object"))).when(odd, F.concat(missing, extra)).otherwise(none)
    records = records.select("chunk_id", "json", faults.alias("faults"), *SHAPES)

    # A record with faults has one more row, of no list.
    of_list = lambda t, rows: F.struct(F.lit(t).cast("string").alias("part"), rows.alias("rows"), F.lit(shape_of(SHAPES[t]) if t else None).cast("string").alias("shape"))
    each = F.array(*[of_list(t, F.coalesce(t, empty)) for t in SHAPES], of_list(None, F.when(F.size("faults") > 0, F.expr("array(parse_json('null'))")).otherwise(empty)))
    rows = records.select("chunk_id", "json", "faults", F.explode(each).alias("l")).select("chunk_id", "json", "faults", "l.part", "l.shape", F.posexplode("l.rows").alias("pos", "r"))
    rows = rows.withColumn("found", F.replace(F.schema_of_variant("r"), F.lit("ARRAY<VOID>"), F.lit(_LIST)))
    rows = rows.withColumn("shape_fault", F.when(F.col("part").isNotNull() & (F.col("found") != F.col("shape")), F.concat(F.lit("fields: "), "found"))).drop("found", "shape")

    fits = F.col("shape_fault").isNull()
    value = lambda field: F.try_variant_get("r", f"$.{field}", "string")
    asks = {t: [k for k in KEYED if k[0] == t] for t in SHAPES}
    slots = range(max(map(len, asks.values())))
    for i in slots:
        asked = {t: asks[t][i] for t in SHAPES if i < len(asks[t])}
        key = _of_part({t: F.nullif(value(f), F.lit("")) if optional else value(f) for t, (_, f, _, optional) in asked.items()})
        rows = rows.withColumns({f"field{i}": _of_part({t: f for t, (_, f, _, _) in asked.items()}), f"vocab{i}": _of_part({t: v for t, (_, _, v, _) in asked.items()}), f"key{i}": F.when(fits, key)})
    rows = rows.withColumn("kind", F.when(fits & (F.col("part") == "places"), value("kind")))
    words = stored(vocabulary.select("vocab", "key").distinct(), "vocabulary")
    for i in slots:
        rows = rows.join(words.select(F.col("vocab").alias(f"vocab{i}"), F.col("key").alias(f"key{i}"), F.lit(True).alias(f"known{i}")), [f"vocab{i}", f"key{i}"], "left")
    lost = [F.when(F.col(f"key{i}").isNotNull() & F.col(f"known{i}").isNull(), F.concat(f"field{i}", F.lit(": '"), f"key{i}", F.lit("' is not in "), f"vocab{i}")).alias(f"lost{i}") for i in slots]
    wrong = F.when(~F.col("kind").isin(*KINDS), F.concat(F.lit("kind: '"), "kind", F.lit("' is not in kinds"))).alias("wrong")
    rows = rows.select("chunk_id", "part", "pos", "r", "json", "faults", "shape_fault", *lost, wrong)
    told = ["shape_fault", *[f"lost{i}" for i in slots], "wrong"]
    problems = F.when(F.coalesce(*told).isNotNull(), F.array_sort(F.filter(F.array(*told), lambda x: x.isNotNull()))).otherwise(none)
    whole = F.col("part").isNull()
    return rows.select("chunk_id", "part", F.when(~whole, F.col("pos")).alias("pos"), F.when(whole, F.col("json")).otherwise(F.to_json("r")).alias("row"), F.when(whole, F.col("faults")).otherwise(problems).alias("problems"))


def apart(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows (chunk_id, part, pos, row), and the others with their problems."""
    good = F.size("problems") == 0
    return judged.where(good).drop("problems"), judged.where(~good)
