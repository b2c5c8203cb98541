from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.llm.splitting import split_oversized, trimmed

TEXTS = {
    1: None, 2: "", 3: "short", 4: "x" * 2000, 5: "x" * 2001, 6: "\n" * 5000, 7: ("word " * 900).strip(), 8: "\n".join(["line of text"] * 400), 9: "日本語。" * 1500,
    10: "para one. " * 60 + "\n\n" + "para two. " * 300, 11: "🙂" * 4100, 12: "a" * 50_000 + "\n" + "b" * 10, 13: "t\n" + "y" * 4000,
}


def pieces(spark, texts, limit=2000, overlap=200):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts.items()], "key long, text string, piece string, n_pieces int")
    out = {}
    for r in split_oversized(df, "key", F.col("text"), limit, overlap).collect():
        out.setdefault(r["key"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def check(texts, got, limit, overlap):
    assert set(got) == {k for k, t in texts.items() if t and len(t) > limit}
    for k, rows in got.items():
        assert [r["piece_no"] for r in rows] == list(range(1, len(rows) + 1)) and all(r["n_pieces"] == len(rows) for r in rows)
        assert all(0 < len(r["piece"]) <= limit and r["n_overlap"] <= overlap for r in rows)
        assert "".join(r["piece"][r["n_overlap"] :] for r in rows) == texts[k]
        for a, b in zip(rows, rows[1:]):
            assert a["piece"].endswith(b["piece"][: b["n_overlap"]])


def test_round_trip_and_limits(spark):
    got = pieces(spark, TEXTS)
    check(TEXTS, got, 2000, 200)
    # Lines end pieces where there are lines, blanks where there are only words.
    assert all(r["piece"].endswith("\n") for r in got[8][:-1])
    assert all(r["piece"].endswith(" ") for r in got[7][:-1])
    assert got[10][0]["piece"].endswith("\n\n") or got[10][0]["piece"].endswith(". ")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n。é", min_size=0, max_size=120), min_size=1, max_size=6))
def test_round_trip_of_any_text(spark, texts):
    given_texts = dict(enumerate(texts))
    check(given_texts, pieces(spark, given_texts, 40, 8), 40, 8)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 2500)] * 3, "key long, text string")
    assert split_oversized(df, "key", F.col("text")).count() == 2
    assert split_oversized(df.limit(0), "key", F.col("text")).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "key", F.col("text"), 100, 60)


def test_trim_of_any_script(spark):
    df = spark.createDataFrame([(" 　 a b \n",)], "t string")
    assert df.select(trimmed(F.col("t"))).first()[0] == "a b"
