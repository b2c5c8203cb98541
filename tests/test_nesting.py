from __future__ import annotations

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.operators.nesting import contained, label_nodes, node_table

ANY = [("any", re.compile(""))]
values = st.recursive(st.none() | st.integers() | st.text(alphabet="abc", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="kxy", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(values, max_size=3))
def test_intervals_contain_exactly_the_descendants(value):
    nodes = list(label_nodes(json.dumps(value), ANY))
    count = lambda v: 1 + sum(map(count, v.values() if isinstance(v, dict) else v if isinstance(v, list) else []))
    assert len(nodes) == count(value)
    assert sorted(n[1] for n in nodes) == list(range(1, len(nodes) + 1))
    for _, pre, post, depth, *_ in nodes:
        inside = [n for n in nodes if pre < n[1] <= post]
        assert all(n[3] > depth and n[2] <= post for n in inside)


def test_deep_record_and_wrapped_text():
    deep = "[" * 900 + "]" * 900
    assert max(n[3] for n in label_nodes(deep, ANY)) == 899
    wrapped = json.dumps("﻿" + json.dumps({"a": json.dumps([{"b": 1}])}))
    assert [n[6] for n in label_nodes(wrapped, [("b", re.compile("/a/#/b$"))])] == ["1"]
    for bad in (None, "", "nonsense", "{", '"text"', "null"):
        assert list(label_nodes(bad, ANY)) in ([], [("any", 1, 1, 0, "", 0, None)])


def test_places_count_nulls_and_lone_objects_are_lists(spark):
    rows = [("r1", json.dumps({"U 1": {"m": [None, {"n": " A "}, {}, {"n": None}]}, "x": {"m": [{"n": "no"}]}})), ("r2", json.dumps({"U 1": {"m": {"n": "lone"}}})), ("r3", None), ("r1", None)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "id string, rec string, name string")
    nodes = node_table(df, "id", F.col("rec"), {"rule": "^/U [^/]*$", "element*": "^/U [^/]*/m/#$", "leaf": "^/U [^/]*/m/#/n$"}, lists="^/U [^/]*/m$")
    linked = contained(contained(nodes, ["row_id"], "rule", "in_rule"), ["row_id"], "element", "in_element")
    inner = lambda r: (r["in_element"] or {"place": None})["place"]
    got = {(r["row_id"], r["node_type"], r["place"], r["scalar"], r["in_rule"]["name"], inner(r)) for r in linked.where("node_type <> 'rule'").collect()}
    elements = {("r1", "element", p, None, "U 1", None) for p in (2, 3, 4)} | {("r2", "element", 1, None, "U 1", None)}
    assert got == elements | {("r1", "leaf", 1, " A ", "U 1", 2), ("r1", "leaf", 1, None, "U 1", 4), ("r2", "leaf", 1, "lone", "U 1", 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, rec string")
    assert node_table(df, "id", F.col("rec"), {"any": ""}).count() == 0
