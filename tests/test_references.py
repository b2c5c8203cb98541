"""Orphan references against brute force, and the cases the docstrings define."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tracelode.operators.references import Reference, orphan_references, plain_key, uuid_key
from tracelode.operators.skew import hot_keys, salted_left_join

T0 = datetime(2025, 1, 1)
ROWS = "row_id string, ref string, ingested_at timestamp, reason string, k0 string"
TARGETS = "id string, ingested_at timestamp, seen string"
LOG = "src_table string, row_key string, purge_op string, purged_at timestamp"
REF = Reference("rows", "row_id", ["ref"], "targets", ["id"])


def at(hours: int) -> datetime:
    return T0 + timedelta(hours=hours)


def got(spark, rows, targets, log=(), ref=REF):
    r = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in rows], ROWS)
    t = spark.createDataFrame([(a, b, "z") for a, b in targets], TARGETS)
    return {tuple(x) for x in orphan_references(r, t, ref, spark.createDataFrame(list(log), LOG)).collect()}


def test_reasons(spark):
    rows = [("a", "K1", at(5)), ("b", "{k1} ", at(1)), ("c", "nope", at(5)), ("d", None, at(5)), ("e", "  ", at(5)), ("f", "k2", at(9)), ("g", "k3", at(9)), ("h", "k1", None)]
    targets = [("k1", at(3)), ("k1", at(8)), ("k2", at(1)), ("K3", at(1)), (None, at(1))]
    log = [("targets", "k2", "delete", at(4)), ("targets", "k3", "delete", at(4)), ("targets", "K3", "restore", at(6)), ("other", "k1", "delete", at(7)), ("targets", None, "delete", at(7))]
    assert got(spark, rows, targets, log) == {("rows", "b", "late"), ("rows", "c", "absent"), ("rows", "f", "removed")}


def test_same_instant_restore_wins_and_copies_count_by_first(spark):
    rows = [("a", "k", at(9)), ("a", "k", at(1)), ("b", "j", at(9))]
    log = [("targets", "j", "restore", at(4)), ("targets", "j", "delete", at(4))]
    assert got(spark, rows, [("k", at(5)), ("j", at(0))], log) == {("rows", "a", "late")}


@pytest.mark.parametrize("rows,targets", [([], []), ([], [("k", at(1))]), ([("a", "k", at(1))], [])])
def test_empty_tables(spark, rows, targets):
    assert got(spark, rows, targets) == {("rows", r[0], "absent") for r in rows}


def test_partly_null_keys_by_match_rule(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("b", "1", None), ("c", "9", None), ("d", None, None), ("e", "1", "y")], "row_id string, p string, q string")
    targets = spark.createDataFrame([("1", "x"), ("2", "y")], "p string, q string")

    def reasons(match):
        ref = Reference("rows", "row_id", ["p", "q"], "targets", ["p", "q"], match, None, None, plain_key)
        return {(x["row_id"], x["reason"]) for x in orphan_references(rows, targets, ref).collect()}

    assert reasons("simple") == {("e", "absent")}
    assert reasons("partial") == {("c", "absent"), ("e", "absent")}
    assert reasons("full") == {("b", "mixed"), ("c", "mixed"), ("e", "absent")}


def test_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(7)
    targets = [(f"k{i}", at(rnd.randrange(50))) for i in range(40)]
    rows = [(f"r{i}", "k0" if i % 3 == 0 else f"k{rnd.randrange(60)}", at(rnd.randrange(50))) for i in range(4000)]
    first = {}
    for k, s in targets:
        first[k] = min(s, first.get(k, s))
    want = {("rows", r, "absent" if k not in first else "late") for r, k, s in rows if k not in first or first[k] > s}
    assert got(spark, rows, targets) == want


def test_hot_keys_are_few_and_salting_keeps_rows(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"c{i}") for i in range(6000)] + [(9999, None)], "id long, k string")
    assert [r["k"] for r in hot_keys(df, ["k"], df.count()).collect()] == ["hot"]
    lookup = spark.createDataFrame([("hot", 1), ("c2", 2)], "k string, v int")
    joined = salted_left_join(df, lookup, ["k"], df["id"])
    assert joined.count() == 6001
    assert joined.where("v = 1").count() == 3000 and joined.where("v = 2").count() == 1


def test_uuid_key(spark):
    df = spark.createDataFrame([(" {ABC-1}\t",), ("",), (None,), ("{}",)], "v string")
    assert [r[0] for r in df.select(uuid_key(df["v"])).collect()] == ["abc-1", None, None, None]
