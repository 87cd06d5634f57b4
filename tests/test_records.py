"""Records of every kind of fault."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastra.operators import records

WORDS = [("place_types", "office"), ("event_types", "purchase"), ("right_types", "suzerain"), ("confidence", "high"), ("entity_types", "abbey"), ("date_precisions", "year"), ("statuses", "held")]
MEMBER = {"child": "a", "parent": "b", "from_year": 0, "to_year": 1600, "source_page": "3"}
PLACE = {"name_in_text": "x", "index_name": "", "kind": "territory", "place_type": "office", "other_names": ["y"]}


def record(**lists):
    return json.dumps({t: [] for t in records.SHAPES} | lists)


def test_rows_are_judged_one_by_one(spark):
    rows = [
        ("good", record(memberships=[MEMBER], places=[PLACE, PLACE | {"other_names": []}])),
        ("bad", record(memberships=[MEMBER, MEMBER | {"from_year": None}, {"child": "a"}, MEMBER | {"more": 1}, MEMBER | {"to_year": 1.5}, "text"], places=[PLACE | {"kind": "k", "place_type": "shed"}])),
        ("short", '{"memberships": [], "places": 5}'), ("list", "[1]"), ("broken", "{"), (None, None), ("empty", ""),
    ]
    judged = records.checked(spark.createDataFrame(rows, "chunk_id string, json string"), spark.createDataFrame(WORDS, "vocab string, key string"))
    got = {(r.chunk_id, r.part, r.pos): r.problems for r in judged.collect()}
    assert [got["good", t, i] for t, i in (("memberships", 0), ("places", 0), ("places", 1))] == [[], [], []]
    assert got["bad", "memberships", 0] == [] and all(len(got["bad", "memberships", i]) == 1 for i in range(1, 6))
    assert got["bad", "places", 0] == ["kind: 'k' is not in kinds", "place_type: 'shed' is not in place_types"]
    assert got["short", None, None] == [f"{t}: no list" for t in records.SHAPES if t != "memberships"]
    assert all(got[k, None, None] == ["not an object"] for k in ("list", "broken", None, "empty"))
    good, bad = records.apart(judged)
    assert good.count() == 4 and bad.count() == len(got) - 4
    nothing = spark.createDataFrame([], "chunk_id string, json string")
    assert records.checked(nothing, spark.createDataFrame(WORDS, "vocab string, key string")).count() == 0


RIGHT = {"from_year": 1, "to_year": 2, "from_precision": "", "to_precision": "year", "place": "p", "right_type": "suzerain", "holder_id": "h", "share": "", "status": "held", "is_disputed": False, "disputed_with": ["x"], "source_page": "1", "snippet": "", "confidence": "high", "notes": ""}


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_a_record_is_read_once_and_judged_on_its_own(spark, threshold):
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts

    faulty = RIGHT | {"right_type": "", "from_precision": "day", "to_precision": "hour", "status": "lost", "confidence": "sure"}
    odd = record(rights=[RIGHT, None]).replace("{", '{"zeta": [], "alpha": 1, ', 1)
    rows = [("same", record(rights=[RIGHT])), ("same", record(rights=[faulty])), (None, record(rights=[faulty | {"right_type": "suzerain"}])), (None, odd)]
    raw = spark.createDataFrame(rows, "chunk_id string, json string").withColumn("json", counted("json"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = records.checked(raw, spark.createDataFrame(WORDS, "vocab string, key string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    lost = ["confidence: 'sure' is not in confidence", "from_precision: 'day' is not in date_precisions", "right_type: '' is not in right_types", "status: 'lost' is not in statuses", "to_precision: 'hour' is not in date_precisions"]
    want = [("same", 0, []), ("same", 0, lost), (None, 0, [p for p in lost if "right" not in p]), (None, 0, []), (None, 1, ["fields: VOID"]), (None, None, ["zeta: not a list of a record", "alpha: not a list of a record"])]
    assert sorted(((r.chunk_id, r.pos, r.problems) for r in got), key=str) == sorted(want, key=str)
    assert {r.row for r in got if r.part is None} == {odd} and json.loads(next(r.row for r in got if r.problems == lost)) == faulty
    assert read.value == len(rows)
