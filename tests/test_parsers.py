from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.functions import scalars as C
from tracelode.operators import parsers as P
from tracelode.operators import relational as R
from tracelode.operators import text as T


def one(spark, text):
    return spark.createDataFrame([(1, text, "clash"), (2, None, None), (3, "", "")], "k int, t string, line string")


def test_c_entities(spark):
    code = '/* int no(void) { } */\n#include <a.h>\nstruct box {\n  int w;\n};\nstatic int sum(int a, int b)\n{\n  char *s = "}{"; // }\n  int total = a;\n  if (a) { return b; }\n  return total;\n}\n\nint x = 3;\nvoid open(void) {\n  unclosed();\n'
    got = {(r["kind"], r["name"], r["start_line"], r["end_line"]) for r in P.c_entities(one(spark, code), ["k"], "t").collect()}
    assert got == {("struct", "box", 3, 5), ("function", "sum", 6, 12), ("function", "open", 15, 16 + 1)} or got == {("struct", "box", 3, 5), ("function", "sum", 6, 12), ("function", "open", 15, 16)}
    body = "int f() { int total = 1; char *name; struct ue x; return total; int total; }"
    assert spark.range(1).select(P.local_names(F.lit(body)).alias("n")).first()["n"] == ["total", "name", "x"]


def test_settings(spark):
    conf = "# c\nport = 5 # in line\n; x=1\nname: 'a b';\nempty =\nbroken line\n"
    assert [(r["line_no"], r["name"], r["value"]) for r in P.conf_params(one(spark, conf), ["k"], "t").orderBy("line_no").collect()] == [(2, "port", "5"), (4, "name", "a b"), (5, "empty", "")]
    cmake = "set(CMAKE_C_STANDARD 11)\ntarget_link_libraries(app m pthread)\nmessage(no)\nfind_package(X)\n"
    assert {(r["name"], r["value"]) for r in P.cmake_params(one(spark, cmake), ["k"], "t").collect()} == {("set.CMAKE_C_STANDARD", "11"), ("target_link_libraries.app", "m pthread"), ("find_package", "X")}


LOG = f"""commit {"a" * 40}
Merge: 1234567 89abcde
Author: Ann Example <ann@example.org>
Date:   Mon Jan 6 10:00:00 2025 +0530

    Fix the crash

    Code patches:
      - rrc_send (l3/rrc.c)
      2. mac_run (l2/mac.c)
    Config patches:
      - port (gnb.conf)

commit {"b" * 40}
Author: Bo <bo@example.org>
Date:   2025-01-05 09:00:00 +0000

    Second
"""


def test_commits(spark):
    commits = P.git_commits(one(spark, LOG), ["k"], "t")
    got = commits.orderBy("pos").collect()
    assert [(r["commit_hash"][0], r["merge"], r["author_email"], r["subject"]) for r in got] == [("a", "1234567 89abcde", "ann@example.org", "Fix the crash"), ("b", None, "bo@example.org", "Second")]
    lists = P.patch_lists(commits, ["commit_hash"], "body").collect()
    assert {(r["section"], r["name"], r["file"]) for r in lists} == {("code", "rrc_send", "l3/rrc.c"), ("code", "mac_run", "l2/mac.c"), ("config", "port", "gnb.conf")}
    dates = [r["d"].isoformat() for r in commits.orderBy("pos").select(C.commit_date(F.col("date")).alias("d")).collect()]
    assert dates == ["2025-01-06T04:30:00", "2025-01-05T09:00:00"]


def test_diffs(spark):
    diff = "diff --git a/x.c b/x.c\nindex 1..2\n--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,2 @@\n same\n-old\n+new\ndiff --git a/y b/y\n@@ -1 +1 @@\n-port = 1;\n+port = \"2\";\n"
    got = {r["file"]: (r["old"], r["new"]) for r in P.diff_sides(one(spark, diff), ["k"], "t").collect()}
    assert got == {"x.c": ("same\nold", "same\nnew"), "y": ("port = 1;", 'port = "2";')}
    values = spark.createDataFrame([('port = "2";',), ("port: 'x'",), ("port=7, b",), ("none",)], "l string").select(P.config_change(F.col("l")).alias("v"))
    assert [r["v"] for r in values.collect()] == ["2", "x", "7", None]
    kinds = spark.createDataFrame([(x,) for x in ("+++ b/x", "--- a/x", "@@ -1 @@", "+a", "-b", " c", "diff --git a b")], "l string").select(T.diff_line_kind(F.col("l")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["file", "file", "hunk", "add", "remove", "context", "meta"]
    states = P.status_lines(one(spark, " M a.c\n?? new.c\nR  old.c -> b.c\n"), ["k"], "t").collect()
    assert [(r["state"], r["path"], r["tracked"]) for r in states] == [("M", "a.c", True), ("??", "new.c", False), ("R", "b.c", True)]


def test_numstat_rows(spark):
    lines = T.lines_of(one(spark, "5\t2\tsrc/file.py\n-\t-\tassets/logo.png\nbad-line\n"), ["k"], "t")
    parts = lines.select(F.split("line", "\t").alias("p")).where(F.size("p") == 3).collect()
    assert [r["p"][2] for r in parts] == ["src/file.py", "assets/logo.png"]


def test_steps_crash_and_definitions(spark):
    steps = P.numbered_steps(one(spark, "intro\n1. one\n  more\n2. two\n3) three"), ["k"], "t", [1, 3])
    assert {(r["step"], r["text"]) for r in steps.collect()} == {(1, "1. one\n  more"), (3, "3) three")}
    crash = "a\nb\nThread 1 received signal SIGSEGV\n#0  0x0 in rrc_send (x=1) at l3/rrc.c:42\n#1  0x1 in main () at m.c:1\n"
    got = P.crash_scan(one(spark, crash), ["k"], "t").collect()
    assert [(r["signal"], r["crash_line"], r["faulting_function"], r["faulting_file"], r["faulting_line"], r["n_frames"], r["n_before"]) for r in got] == [("SIGSEGV", 3, "rrc_send", "l3/rrc.c", "42", 2, 2)]
    asn = "text\nA-Type ::= SEQUENCE {\n  a  INTEGER,\n  b  SEQUENCE {\n  }\n}\nprose\nB ::= INTEGER\nmore"
    blocks = P.asn1_blocks(one(spark, asn), ["k"], "t").orderBy("first_line").collect()
    assert [(r["name"], r["first_line"], r["body"].count("\n")) for r in blocks] == [("A-Type", 2, 4), ("B", 8, 0)]


def test_free_text(spark):
    text = "so:\n```json\n{\"a\": 1}\n```\nand ```x``` no"
    row = spark.createDataFrame([(text, "pre {\"b\": [1]} post", "none")], "a string, b string, c string").select(
        P.fenced_blocks(F.col("a")).alias("f"), F.to_json(P.salvaged_json(F.col("a"))).alias("a"), F.to_json(P.salvaged_json(F.col("b"))).alias("b"), P.salvaged_json(F.col("c")).isNull().alias("c")
    ).first()
    assert row["f"] == ['{"a": 1}\n'] and row["a"] == '{"a":1}' and row["b"] == '{"b":[1]}' and row["c"]
    nested = spark.createDataFrame([(1, '{"x": [{"IE_Name": "A", "y": {"IE_Name": "B"}}, {"IE_Name": null}]}')], "id int, t string")
    assert sorted(r["ie_name"] for r in P.ie_entries(nested, "id", F.col("t")).collect()) == ["A", "B"]
    lists = spark.createDataFrame([(1, '{"depth_2": ["c"], "depth_0": ["a", "b"]}')], "id int, t string")
    assert [(r["depth"], r["chunk"]) for r in P.depth_lists(lists, ["id"], "t").orderBy("depth", "place").collect()] == [(0, "a"), (0, "b"), (2, "c")]


def test_scalars(spark):
    row = spark.range(1).select(
        C.ie_type_name(F.lit("UE CONTEXT  SETUP REQUEST")).alias("t"), C.slug(F.lit(" a/b c! ")).alias("s"), C.ipv4s(F.lit("x 10.0.0.1 y 10.0.0.1 z 1.2.3.4")).alias("i"),
        C.graded(F.lit("1: 0.9 - good\n3: 1.7"), 3).alias("g"), C.network_params(F.lit("NGAP port 38412\nport=9")).alias("n"), C.keywords_in(F.lit("an AMF is up"), ["amf", "gnb"]).alias("k"),
        C.undefined_symbols(F.lit("a.o: undefined reference to `foo'\nundefined reference to `foo'")).alias("u"), C.name_variants(F.lit("A-b")).alias("v"), C.collapsed(F.lit(" a \n b ")).alias("c"),
        F.size(F.split(C.smart_cut(F.lit("\n".join(map(str, range(500))))), "\n")).alias("cut"), T.duration_label(F.lit(185_000)).alias("d"),
    ).first()
    assert row["t"] == "UeContextSetupRequestIEs" and row["s"] == "a_b_c" and row["i"] == ["10.0.0.1", "1.2.3.4"] and row["g"] == [0.9, 0.3, 1.0]
    assert row["n"]["port"] == 38412 and row["k"] == ["amf"] and row["u"] == ["foo"] and row["v"][-1] == "ab" and row["c"] == "a b" and row["cut"] == 121 and row["d"] == "3m 5s"
    prompts = spark.createDataFrame([("ok\nbuild failed\n",), (None,)], "p string").select(C.text_function()(F.col("p")).alias("a"))
    assert [r["a"] for r in prompts.collect()] == ["build failed", ""]


def test_compiler_context_and_clusters(spark):
    log = "a.c: In function ‘f’:\na.c:3:5: error: unknown type name ‘T’\na.c:9:5: error: unknown type name ‘T’\nb.c:4: error: ‘y’ undeclared\na.c:8:1: warning: no"
    errors = R.compiler_errors(T.lines_of(one(spark, log), ["k"], "t"), ["k"])
    got = errors.orderBy("line_no").collect()
    assert [(r["file_path"], r["line_number"], r["column_number"], r["function_name"], r["category"], r["symbols"]) for r in got] == [
        ("a.c", 3, 5, "f", "unknown_type_name", ["T"]), ("a.c", 9, 5, "f", "unknown_type_name", ["T"]), ("b.c", 4, 0, None, "undeclared_identifier", ["y"]),
    ]
    clusters = R.error_clusters(errors, ["k"]).orderBy("cluster_id").collect()
    assert [(r["cluster_id"], r["n_errors"], r["min_line"], r["functions"]) for r in clusters] == [("c0", 2, 3, ["f"]), ("c1", 1, 4, [])]


def test_chunk_regimes(spark):
    words = lambda n, dot=0: " ".join(f"w{i}" + ("." if dot and i % dot == 0 else "") for i in range(n))
    texts = ["", " ", words(300), words(500), words(900), words(900, 40), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [len(c.split()) for c in r["c"]] if r["c"] is not None else None for r in df.select("i", T.chunk_words(F.col("t")).alias("c")).collect()}
    assert got[0] == [] and got[1] == [] and got[2] == [300] and got[3] == [275, 275] and got[4] == [300, 300, 300, 150]
    assert sum(got[5]) == 900 and max(got[5]) <= 300 and got[6] in (None, [])
