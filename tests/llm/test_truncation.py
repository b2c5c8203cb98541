from __future__ import annotations

import random

from tracelode.llm.truncation import find_truncated, mask, segments, tail_of

SENTENCES = [
    "The retry counter reaches {n} and the task aborts with SIGBUS.", "A missing branch leaves {w} unset for the second kind.", "The backtrace shows {f} called from {f} with a null pointer.",
    "It looks like {w} is not initialised when the timer fires early.",
]


def made(rnd: random.Random) -> str:
    pick = lambda: rnd.choice(SENTENCES).format(n=rnd.randrange(99), w=rnd.choice(["gapPattern", "securityHint"]), f=rnd.choice(["rrc_send_req", "mac_check_rep"]))
    return " ".join(pick() for _ in range(rnd.randrange(2, 5)))


def test_cut_values_come_out(spark):
    rnd = random.Random(5)
    rows, want = [], set()
    for i in range(400):
        text, kind = made(rnd), i % 8
        if kind == 0:
            last = text.rfind(". ") + 2
            at = rnd.randrange(last + 12, len(text) - 9)
            text = text[:at].rstrip() + rnd.choice(["", "...", "…", " [truncated]", "\n"])
            want.add(i)
        elif kind == 1:
            text = text[:-1] + rnd.choice(["", " etc", " :(", "...", ", and so on ..."])
        rows.append((i, "src", text, "clash"))
    rows += [(1000, None, None, ""), (1001, "src", "", ""), (1002, "src", "Entirely new words without any likeness", ""), rows[0]]
    df = spark.createDataFrame(rows, "id long, src string, text string, cut string")
    found = find_truncated(df, ["id"], "src", "text").collect()
    got = {r["id"] for r in found if r["cut"]}
    assert not {1000, 1001} & {r["id"] for r in found}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 4, (sorted(want - got), sorted(got - want))


def test_limit_decides_open_endings(spark):
    rows = [(i, "src", f"The counter reaches {10 ** 20 + i}"[:28]) for i in range(12)] + [(100 + i, "src", "It got to " + "9" * (i % 4 + 1) + ".") for i in range(20)]
    got = {r["id"] for r in find_truncated(spark.createDataFrame(rows, "id long, source string, text string"), ["id"], "source", "text").collect() if r["cut"]}
    assert got == set(range(12))


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, source string, text string")
    assert find_truncated(df, ["id"], "source", "text").count() == 0


def test_forms():
    assert mask("0x4f") == ("0xhh", "0xhh") and mask("123,")[0] == "0" and mask("cellIdentityMap.")[1] == "I" and mask("rrc_send()")[0] == "w()"
    assert segments("One. Two\r\n\x1b[1mthree\n\n") == ["One.", "Two", "three"]
    assert tail_of('{"ts":"1","msg":"no ans')[2] and tail_of("a�")[2] and tail_of('{\n  "ts": "1",')[2] and not tail_of('{"a":"b"}')[2]
    assert tail_of("x" * 60_000)[1] == 60_000


def test_prefix_counts_equal_brute_force(spark):
    from tracelode.llm.prefixes import END, prefix_counts

    rnd = random.Random(3)
    word = lambda most: "".join(rnd.choice("ab é") for _ in range(rnd.randrange(most)))
    held = {word(7) + END: rnd.randrange(1, 5) for _ in range(900)}
    asked = {word(5) for _ in range(200)} | {"", "zz", "\U0001f600"}
    strings = spark.createDataFrame(list(held.items()), "s string, n long").repartition(5)
    got = {r["s"]: (r["ends"], r["longer"]) for r in prefix_counts(strings, spark.createDataFrame([(a,) for a in asked] * 2 + [(None,)], "s string")).collect()}
    want = {a: (held.get(a + END, 0), sum(n for s, n in held.items() if s.startswith(a) and s != a + END)) for a in asked}
    assert got == want
    assert {tuple(r) for r in prefix_counts(strings.limit(0), spark.createDataFrame([("a",)], "s string")).collect()} == {("a", 0, 0)}


def test_steps_are_named_and_a_null_source_has_limits(spark):
    rows = [(i, None, f"The counter reaches {10 ** 20 + i}"[:28]) for i in range(12)] + [(100 + i, None, "It got to " + "9" * (i % 4 + 1) + ".") for i in range(20)]
    rows += [(200 + i, "a", f"The timer of unit {i} has fired. All is well.") for i in range(30)] + [(300, "a", "All is well. The timer of unit 7 has fi")]
    found = find_truncated(spark.createDataFrame(rows, "id long, src string, text string"), ["id"], "src", "text").collect()
    assert {r["id"] for r in found if r["cut"]} == set(range(12)) | {300}
    assert {r["ending"] for r in found if r["id"] == 300} == {"prefix"}


def test_long_runs_are_read_in_linear_time():
    for text in ("x" * 300_000, " " * 300_000 + "x", "a_" * 100_000, "." * 300_000, "x" * 300_000 + "!"):
        tail_of(text)
