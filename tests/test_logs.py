from __future__ import annotations

import re

from pyspark.sql import functions as F

from tracelode.operators.logs import Miner, classify, common, entries_of, layouts, mine, parse_logs, tokens

LOG = "\n".join(
    [
        "start of capture",
        "[2026-03-09T12:54:12.233Z] [FATAL] [phyw.link] assertion failed: x != 1",
        "  detail: 0x12",
        "",
        "2026-03-09 12:54:15,840 - store.chunker - WARNING - warning threshold, error count 3\r",
        "Mar  7 16:41:47 rack18 ngqpd[3531]: notice: returned -34",
        "Mar 27 16:41:48 rack9 mcqsd[2573]: warning threshold reached",
        "Traceback (most recent call last):",
        "\x1b[33m[NR_RRC]   link is up",
        "[54] slot 6118 owner schq",
        "W0403 02:37:54.863240  8240 vrrm_task.cc:40] cell 12 up",
        "\x1b[0m61147.026652 [PHY] E received",
        "01/28 22:59:10.816: [xnhb] CRITICAL: sent (../src/xnhb/main.c:629)",
        'time=2025-07-16T05:41:11Z level=info component=sdqm msg="queue depth" n=50',
        '{"ts":"1770182348.459","lvl":"error","mod":"du.f1kx","msg":"link is up"}',
        "{",
        '  "ts": "2026-02-04T05:18:44+00:00",',
        '  "lvl": "Info",',
        '  "mod": "du.gtpv",',
        '  "msg": "no answer"',
        "}",
        "openradio/l2/rlxa/x.c:766:36: fatal error: too few arguments",
        "  766 |   f(&ctx);",
        "   ",
    ]
)
WANT = [
    (2, 3, "2026-03-09T12:54:12.233Z", "FATAL", "phyw.link"), (5, 5, "2026-03-09 12:54:15,840", "WARN", "store.chunker"), (6, 6, "Mar  7 16:41:47", "INFO", "ngqpd"),
    (7, 8, "Mar 27 16:41:48", "", "mcqsd"), (9, 10, "", "", "NR_RRC"), (11, 11, "0403 02:37:54.863240", "WARN", "vrrm_task.cc"), (12, 12, "61147.026652", "ERROR", "PHY"),
    (13, 13, "01/28 22:59:10.816", "FATAL", "xnhb"), (14, 14, "2025-07-16T05:41:11Z", "INFO", "sdqm"), (15, 15, "1770182348.459", "ERROR", "du.f1kx"),
    (16, 21, "2026-02-04T05:18:44+00:00", "INFO", "du.gtpv"), (22, 23, "", "FATAL", "openradio/l2/rlxa/x.c"),
]


def test_entries_by_mined_layouts(spark):
    df = spark.createDataFrame([("f", LOG, "clash", 1), ("f", LOG, "clash", 1), ("n", None, None, 2), ("e", "", "", 3), ("p", "only prose. Nothing else", "", 4)], "id string, text string, row_id string, first_line int")
    patterns = layouts(mine(df))
    assert len(patterns) >= 11
    got = parse_logs(df, "id", F.col("text"), patterns, messages=True).collect()
    assert {r["row_id"] for r in got} == {"f"} and len(got) == 2 * len(WANT)
    assert sorted({tuple(r)[1:6] for r in got}) == sorted(WANT)
    first = next(r for r in got if r["first_line"] == 2)
    assert first["message"] == "assertion failed: x != 1\n  detail: 0x12"


def test_empty_table_has_no_layouts(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert layouts(mine(df)) == []
    assert parse_logs(df, "id", F.col("text"), []).count() == 0


def test_common_subsequence_is_longest():
    assert len(common(tuple("abcbdab"), tuple("bdcaba"))) == 4
    assert common((), ("a",)) == []


def test_templates_merge_by_subsequence_but_not_headers():
    miner = Miner()
    for line in ("12:00:00.1 | INFO | a_am | one two", "12:00:00.1 | WARN | b_am | three", "Caused by: X was not confirmed", "Caused by: Y Z was not confirmed"):
        miner.add(line)
    found = miner.templates()
    assert sum(1 for cut, _, _ in found if cut) == 1
    assert sum(s for _, _, s in found) == 4 and len(found) == 2


def test_no_header_in_continuations_and_prose():
    for line in ("[54] slot 1 owner x", "0xc6a8: 4f 2a 00", '  File "x.py", line 3, in f', "ValueError: x", "----> a = 0x1 (was 3)", "Expected: ACK is sent once", "    at f (a/b.c:3)", "[Note] text", ""):
        assert classify(tokens(line)) is None, line


def test_very_long_line_and_many_lines():
    known = [re.compile(p) for p in layouts([(c, p, s) for c, p, s in _mined(LOG)])]
    text = "12345.678901 [PHY] W " + "x" * 200_000 + "\n" + "\n" * 1000
    assert [(e[0], e[1]) for e in entries_of(text, known)] == [(1, 1)]


def _mined(text):
    miner = Miner()
    for line in text.split("\n"):
        miner.add(re.sub("\x1b\\[[0-9;]*m", "", line).rstrip("\r"))
    return miner.templates()
