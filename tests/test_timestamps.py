from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracelode.operators.timestamps import DECLARED, best_path, readings, to_instants
from tracelode.queries.problems import p4_found


def us(*parts: int, micro: int = 0) -> int:
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("2025-03-01T10:00:00+05:30", "Asia/Kolkata", False, us(2025, 3, 1, 4, 30)),
    ("2025-03-01 10:00:00,250", "Europe/Berlin", False, us(2025, 3, 1, 9, 0, 0, micro=250_000)),
    ("20250301T100000Z", "America/Chicago", True, us(2025, 3, 1, 10)),
    (" 2025-12-07t06:38:26z", "Asia/Kolkata", False, us(2025, 12, 7, 6, 38, 26)),
    ("2025-03-01T10:00:00.123456789Z", "Asia/Kolkata", False, us(2025, 3, 1, 10, micro=123_456)),
    ("2025-03-01T10:00:00+01", "Asia/Kolkata", False, us(2025, 3, 1, 9)),
    ("2025-11-02T00:59:37-05:00[America/Chicago]", "Asia/Kolkata", False, us(2025, 11, 2, 5, 59, 37)),
    ("2025-07-01 08:00:00 CEST", "Europe/Berlin", False, us(2025, 7, 1, 6)),
    ("05/03/2025 10:00", "Europe/Lisbon", False, us(2025, 3, 5, 10)),
    ("3/5/2025 1:02:03 PM", "America/Chicago", True, us(2025, 3, 5, 19, 2, 3)),
    ("12/1/2025 12:00:00 AM", "Europe/Lisbon", False, us(2025, 1, 12, 0)),
    ("05-MAR-26 12.10.25.345237 AM", "Europe/Lisbon", False, us(2026, 3, 5, 0, 10, 25, micro=345_237)),
    ("7 Feb 2026, 14:50", "Europe/Lisbon", False, us(2026, 2, 7, 14, 50)),
    ("Sun, 27 Apr 2025 08:17:19 +0530", "Europe/Lisbon", False, us(2025, 4, 27, 2, 47, 19)),
    ("Sun Mar  2 16:33:05 2025", "Europe/Berlin", False, us(2025, 3, 2, 15, 33, 5)),
    ("1769962717", "America/Chicago", True, 1769962717_000_000),
    ("1758883764524", None, False, 1758883764_524_000),
    ("1747232657222221", "Europe/Berlin", False, 1747232657222221),
    ("1763382574.359", "Europe/Berlin", False, 1763382574_359_000),
    # A time that occurs twice is the first, a skipped one takes the offset before the change.
    ("2025-10-26 02:30:00", "Europe/Berlin", False, us(2025, 10, 26, 0, 30)),
    ("2025-03-30 02:30:00", "Europe/Berlin", False, us(2025, 3, 30, 1, 30)),
    *[(v, "Europe/Berlin", False, None) for v in (None, "", " ", "unknown", "N/A", "--", "2025-02-30T11:20:00", "0000-00-00 00:00:00", "2025-01-01 25:00:00", "13:00", "30/02/2025 10:00", "1/2/2025 13:00:00 PM", "x" * 50_000)],
]


@pytest.mark.parametrize("strict", [True, False])
def test_readings(spark, strict):
    rows = [(i, v, z or "Asia/Kolkata", m) for i, (v, z, m, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, v string, z string, m boolean")
    got = {r["i"]: [x["utc_us"] for x in r["r"] if x["cost"] < DECLARED] for r in df.select("i", readings(F.col("v"), F.col("z"), F.col("m"), not strict).alias("r")).collect()}
    assert got == {i: [] if c[3] is None else [c[3]] for i, c in enumerate(CASES)}


def test_path_prefers_one_form_and_forward_time():
    day = 86_400_000_000
    fixed = (["numeric_dmy"], [10 * day], [0.0])
    either = (["numeric_dmy", "numeric_mdy"], [11 * day, 40 * day], [0.0, 0.0])
    assert best_path([fixed, either], None) == [0, 0]
    # The other order would jump back in time twice.
    assert best_path([(["a", "b"], [50, 10], [0.0, 0.0]), (["b"], [20], [0.0])], ("b", 5)) == [1, 0]


def test_table_edges(spark):
    schema = "id string, v string, z string, m boolean, o timestamp, row string, block string"
    rows = [("a", "05/03/2025 10:00", "UTC", False, datetime(2025, 3, 5), "x", "y")] * 2 + [("b", None, "UTC", False, None, None, None)]
    out = lambda rows: to_instants(spark.createDataFrame(rows, schema), "id", F.col("v"), F.lit("s"), F.col("o"), F.col("z"), F.col("m")).collect()
    assert [(r["row"], r["utc_us"]) for r in out(rows)] == [("a", us(2025, 3, 5, 10))] * 2
    assert out([]) == []


def test_undeclared_reading_is_taken_only_where_nothing_else_is_valid(spark):
    df = spark.createDataFrame([("a", "25/12/2025 10:00"), ("b", "03/04/2025 10:00")], "id string, v string")
    got = {r["row"]: r["form"] for r in to_instants(df, "id", F.col("v"), F.lit("s"), F.lit(datetime(2025, 1, 1)), F.lit("UTC"), F.lit(True)).collect()}
    assert got == {"a": "numeric_dmy", "b": "numeric_mdy"}


def test_abbreviation_says_which_side_of_a_repeated_time(spark):
    rows = [
        ("a", "2025-10-26 02:30:00 CET", "Europe/Berlin", us(2025, 10, 26, 1, 30)),
        ("b", "2025-10-26 02:30:00 CEST", "Europe/Berlin", us(2025, 10, 26, 0, 30)),
        ("c", "2025-10-26 02:30:00 CST", "Europe/Berlin", us(2025, 10, 26, 0, 30)),  # names neither side
        ("d", "2025-11-02 01:04:51 CST", "America/Chicago", us(2025, 11, 2, 7, 4, 51)),
        ("e", "2025-04-06 02:08:00 ACST", "Australia/Adelaide", us(2025, 4, 5, 16, 38)),
        ("f", "Sun Oct 26 01:18:55 WET 2025", "Europe/Lisbon", us(2025, 10, 26, 1, 18, 55)),
        ("g", "2025-10-26 03:00:00 CET", "Europe/Berlin", us(2025, 10, 26, 2)),
        ("h", "2025-10-26 01:59:59 CEST", "Europe/Berlin", us(2025, 10, 25, 23, 59, 59)),
        ("i", "2025-10-26T02:30:00[Europe/Berlin]", "Asia/Kolkata", us(2025, 10, 26, 0, 30)),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id string, v string, z string")
    for undeclared in (True, False):
        got = to_instants(df, "id", F.col("v"), F.lit("s"), F.lit(datetime(2025, 1, 1)), F.col("z"), F.lit(False), undeclared)
        assert {r["row"]: r["utc_us"] for r in got.collect()} == {r[0]: r[3] for r in rows}
    # Both sides are readings, so the pass over the rows has them to choose from.
    found = df.select("id", F.size(readings(F.col("v"), F.col("z"), F.lit(False))).alias("n")).collect()
    assert {r["id"]: r["n"] for r in found} == {x: 1 if x in "gh" else 2 for x in "abcdefghi"}


def test_p4_found_takes_the_order_of_an_unknown_site_from_the_path(spark, tmp_path):
    at = lambda month, day: datetime(2025, month, day, 12)
    sessions = [
        # Hours apart: what lies before and behind decides that 3/4 is the 4th of March, not the 3rd of April.
        ("a", "2025-03-03T10:00:00Z", "xxx", at(3, 3)), ("b", "3/4/2025 10:00", "xxx", at(3, 4)), ("c", "2025-03-05T10:00:00Z", "xxx", at(3, 5)),
        # The same at sites that declare day before month, month before day, and at no site.
        ("d", "2025-03-03T10:00:00Z", "lis", at(3, 3)), ("e", "3/4/2025 10:00", "lis", at(3, 4)), ("f", "2025-03-05T10:00:00Z", "lis", at(3, 5)),
        ("g", "3/4/2025 10:00", "chi", at(3, 4)), ("h", "25/12/2025 10:00", "chi", at(12, 25)), ("i", "3/4/2025 10:00", None, at(3, 4)),
    ]
    spark.createDataFrame(sessions, "session_id string, created_at string, site string, ingested_at timestamp").write.parquet(f"{tmp_path}/sessions.parquet")
    crashes = spark.createDataFrame([], "crash_id bigint, crash_info struct<timestamp: string>, site string, ingested_at timestamp")
    crashes.write.parquet(f"{tmp_path}/segmentation_fault_extraction.parquet")
    spark.createDataFrame([("lis", "Europe/Lisbon", "dmy"), ("chi", "America/Chicago", "mdy")], "site string, tz_name string, date_order string").write.parquet(f"{tmp_path}/sites.parquet")
    got = {r["row_id"]: r["utc_us"] for r in p4_found(spark, str(tmp_path)).collect()}
    assert got == {
        "a": us(2025, 3, 3, 10), "b": us(2025, 3, 4, 4, 30), "c": us(2025, 3, 5, 10), "d": us(2025, 3, 3, 10), "e": us(2025, 4, 3, 9),
        "f": us(2025, 3, 5, 10), "g": us(2025, 3, 4, 16), "i": us(2025, 4, 3, 4, 30),
    }
