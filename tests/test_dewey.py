import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brinewell.operators import dewey

AS_LIST, AS_JSON = {"$.data.bets"}, {"$.data", "$.data.bets"}


def bets(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "line int, raw string, path string")
    nodes = dewey.label_json(rows, F.col("line"), F.col("raw"), AS_LIST, AS_JSON).where("path = '$.data.bets[]'")
    return {(r.row_id, r.pos, r.id, r.up) for r in nodes.select("row_id", dewey.place(F.col("dewey")).alias("pos"), F.col("fields")["id"].alias("id"), dewey.dotted(dewey.parent(F.col("dewey"))).alias("up")).collect()}  # noqa: E501


def test_shapes(spark):
    frame = lambda b: json.dumps({"type": "x", "data": {"bets": b}})
    texts = [
        frame([{"id": "a"}, None, {"id": "b"}]), frame([[{"id": "a"}], [None, [{"id": "b"}]], {"id": "c"}]), frame({"id": "a"}), frame([]), frame(None),
        json.dumps({"data": json.dumps({"bets": [{"id": "a"}]})}), chr(0xFEFF) + frame([{"id": "a"}]), frame([{"id": "a"}])[:-1], "pong", "null", "[]", "", None,
        json.dumps({"meta": 1, "data": {"meta": {}, "bets": [{"id": "a", "fills": [{"id": "f"}]}]}}), frame(["text", 3, {"id": "a"}]), "[" * 100_000, frame([{}]),
    ]
    assert bets(spark, texts) == {
        (0, 0, "a", "1.0"), (0, 2, "b", "1.0"), (1, 0, "a", "1.0"), (1, 2, "b", "1.0"), (1, 3, "c", "1.0"), (2, 0, "a", "1.0"), (5, 0, "a", "0.0"), (6, 0, "a", "1.0"),
        (13, 0, "a", "1.1"), (14, 2, "a", "1.0"), (16, 0, None, "1.0"),
    }


def test_children_reach_their_parent(spark):
    text = json.dumps({"data": {"bets": [{"id": "a", "fills": [{"amount": 1.5}, {"amount": 2}]}, {"id": "b", "fills": [{"amount": None}]}]}})
    rows = spark.createDataFrame([(1, text)], "line int, raw string")
    nodes = dewey.label_json(rows, F.col("line"), F.col("raw"), AS_LIST, AS_JSON)
    fills = nodes.where("path = '$.data.bets[].fills[]'").select(dewey.parent(F.col("dewey"), 2).alias("label"), F.col("fields")["amount"].alias("amount"))
    joined = fills.join(nodes.where("path = '$.data.bets[]'").select(F.col("dewey").alias("label"), F.col("fields")["id"].alias("id")), "label")
    assert sorted((r.id, r.amount) for r in joined.collect() if r.amount) == [("a", "1.5"), ("a", "2")]


def test_typed_lists(spark):
    rows = spark.createDataFrame([(1, [(5,), None, (6,)]), (2, []), (3, None)], "line int, bets array<struct<x: int>>")
    got = dewey.label_list(rows, F.col("line"), F.col("bets"), [0, 0]).select("row_id", dewey.dotted(F.col("dewey")).alias("d"), "member.x").collect()
    assert [(r.row_id, r.d, r.x) for r in got] == [(1, "0.0.0", 5), (1, "0.0.2", 6)]


def test_typed_and_text_have_the_same_labels(spark):
    names = {"$": ["type", "data"], "$.data": ["bets"]}
    typed = spark.createDataFrame([(1, ([(5,), None, (6,)],))], "line int, data struct<bets: array<struct<x: int>>>")
    texts = ['{"data": {"meta": {}, "bets": [{"x": 5}, null, {"x": 6}]}, "other": {}, "type": "t"}', '{"type": "t", "data": "{\\"bets\\": [{\\"x\\": 5}, null, {\\"x\\": 6}]}"}']
    want = [("1.1.0.0", "1"), ("1.1.0.2", "1")]
    d, levels = F.col("dewey"), 3
    picked = lambda df: sorted(tuple(r) for r in df.select(dewey.label(F.col("row_id"), d), dewey.label(F.col("row_id"), dewey.parent(d, levels))).collect())
    assert picked(dewey.label_list(typed, F.col("line"), F.col("data.bets"), dewey.ordinals("$.data.bets", names))) == want
    for text in texts:
        rows = spark.createDataFrame([(1, text)], "line int, raw string")
        nodes = dewey.label_json(rows, F.col("line"), F.col("raw"), AS_LIST, AS_JSON, names)
        assert picked(nodes.where("path = '$.data.bets[]'")) == want
        assert "1" in [r[0] for r in nodes.where("path = '$'").select(dewey.label(F.col("row_id"), d)).collect()]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_every_bet_has_one_frame(spark):
    at = "/root/testdata/sf0.001"
    bets, frames = (entry.queries()[q](spark, at) for q in ("p3_bets", "p3_frames"))
    joined = bets.join(frames.select("origin", F.col("label").alias("parent"), F.lit(1).alias("one")), ["origin", "parent"], "left")
    assert joined.where("one is null").count() == 0 and joined.count() == bets.count() and frames.select("origin", "label").distinct().count() == frames.count()
