"""Parsers of source code, settings, commits and diffs into typed rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators.frames import frames
from tracelode.operators.nesting import node_table
from tracelode.operators.text import lines_of

_CODE_NOISE = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
# Words before a parenthesis that are no function names.
_CONTROL = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "defined"}
_HEAD = re.compile(r"(?P<type>[A-Za-z_][\w\s\*]*?[\s\*])(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^;{}]*)\)\s*$")
_COMPOSITE = re.compile(r"\b(struct|union|enum)\s+([A-Za-z_]\w*)\s*$")


def _blanked(code: str) -> str:
    """The code with comments and literals blanked, places and line ends kept."""
    return _CODE_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def code_entities(code: str | None) -> Iterator[tuple[str, str, int, int, str, str]]:
    """(kind, name, first line, last line, signature, body) of each function, struct, union and
    enum at the top level.  An unclosed body ends with the text."""
    if not code:
        return
    flat = _blanked(code)
    depth, head_from, open_at, head = 0, 0, 0, ""
    for m in re.finditer(r"[{};]", flat):
        at, c = m.start(), m.group()
        if c == "{":
            if depth == 0:
                head, open_at = flat[head_from:at], at
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
            if depth == 0 and head:
                yield from _entity(code, flat, head, head_from, open_at, at)
                head, head_from = "", at + 1
        elif depth == 0:
            head_from = at + 1
    if depth and head:
        yield from _entity(code, flat, head, head_from, open_at, len(code) - 1)


def _entity(code: str, flat: str, head: str, start: int, open_at: int, close: int) -> Iterator[tuple]:
    bare = re.sub(r"^\s*#[^\n]*$", lambda m: " " * len(m.group()), head, flags=re.M)
    first = start + len(bare) - len(bare.lstrip())
    line = lambda at: code.count("\n", 0, at) + 1
    body = code[first : close + 1]
    signature = re.sub(r"\s+", " ", code[first:open_at]).strip()
    if got := _HEAD.search(bare):
        if got["name"] not in _CONTROL:
            yield "function", got["name"], line(first), line(close), signature, body
    elif got := _COMPOSITE.search(bare):
        yield got[1], got[2], line(first), line(close), signature, body


def c_entities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, name, start_line, end_line, signature, body): S2, S3; of entities of one kind
    and name that start less than three lines apart in a text the first is kept."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = ["kind", "name", "start_line", "end_line", "signature", "body"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*key, *e) for *key, code in batch[[*keys, text]].itertuples(index=False, name=None) for e in code_entities(code)]
            yield from frames(out, [*keys, *names])

    found = df.select(*keys, text).where(F.col(text).isNotNull()).mapInPandas(scan, f"{kinds}, kind string, name string, start_line int, end_line int, signature string, body string")
    w = Window.partitionBy(*keys, "kind", "name").orderBy("start_line")
    gap = F.col("start_line") - F.lag("start_line").over(w)
    return found.withColumn("__gap", gap).where(F.coalesce(F.col("__gap") >= 3, F.lit(True))).drop("__gap")


def conf_params(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, name, value): S4; key=value, else key:value, comments and quotes stripped.

    Blanks, tabs and a byte order mark before the name and white space behind the value are left
    out; a value may hold any character but a line feed."""
    lines = lines_of(df, keys, text).withColumn("line", F.regexp_replace("line", r"^[\s\uFEFF]+|\s+$", "")).where(~F.col("line").rlike("^(#|//|;)") & (F.col("line") != ""))
    pair = r"(?s)^([A-Za-z_][A-Za-z0-9_.-]*)\s*[=:]\s*(.*)$"
    value = F.trim(F.regexp_replace(F.regexp_extract("line", pair, 2), r"(?s)\s+[#;].*$", ""))
    bare = F.regexp_replace(F.regexp_replace(value, r";\z", ""), r"(?s)^(?:\"(.*)\"|'(.*)')\z", "$1$2")
    return lines.where(F.col("line").rlike(pair)).select(*keys, "line_no", F.regexp_extract("line", pair, 1).alias("name"), bare.alias("value"))


# Build commands that are kept.
CMAKE = [
    "set", "option", "add_executable", "add_library", "target_link_libraries", "target_include_directories", "target_compile_definitions", "target_compile_options",
    "include_directories", "find_package", "add_subdirectory", "add_definitions",
]


def cmake_params(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no, name, value): S6; one-line commands, named set.VAR, target_x.TARGET or by command."""
    call = r"^\s*([A-Za-z_]+)\s*\(\s*([^()]*)\)\s*$"
    lines = lines_of(df, keys, text).where(F.col("line").rlike(call))
    command = F.lower(F.regexp_extract("line", call, 1))
    args = F.filter(F.split(F.trim(F.regexp_extract("line", call, 2)), r"\s+"), lambda a: a != "")
    first = F.coalesce(F.get(args, F.lit(0)), F.lit(""))
    named = F.when(command.rlike("^(set|target_|add_executable|add_library)"), F.concat(command, F.lit("."), first)).otherwise(command)
    rest = F.when(command == named, F.array_join(args, " ")).otherwise(F.array_join(F.slice(args, 2, F.greatest(F.size(args), F.lit(1))), " "))
    return lines.where(command.isin(CMAKE)).select(*keys, "line_no", named.alias("name"), rest.alias("value"))


def git_commits(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each commit of `git log` text: S8, T4."""
    block = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "(?m)(?=^commit [a-f0-9]{40})")).alias("pos", "b")).where(F.col("b").rlike("^commit [a-f0-9]{40}"))
    part = lambda p: F.nullif(F.regexp_extract("b", p, 1), F.lit(""))
    message = F.filter(F.transform(F.split(F.regexp_extract("b", r"(?s)\n\n(.*)$", 1), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return block.select(
        *keys, "pos", part("^commit ([a-f0-9]{40})").alias("commit_hash"), part(r"(?m)^Merge: ([a-f0-9]+ [a-f0-9]+)").alias("merge"), part(r"(?m)^Author: +(.*?) *<").alias("author_name"),
        part(r"(?m)^Author: .*<(.*)>").alias("author_email"), part(r"(?m)^Date: +(.*)$").alias("date"), F.get(message, F.lit(0)).alias("subject"),
        F.array_join(F.slice(message, 2, F.greatest(F.size(message), F.lit(1))), "\n").alias("body"),
    )


def patch_lists(commits: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, section, name, file): S9; entries `name (file)` under `Code patches:` or `Config patches:`."""
    lines = lines_of(commits, keys, body)
    header = F.nullif(F.lower(F.regexp_extract("line", r"(?i)^\s*(code|config) patches:", 1)), F.lit(""))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    entry = r"^\s*(?:[-*]|[0-9]+[.)])?\s*(\S+)\s+\(([^()]+)\)\s*$"
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(w)).where(F.col("section").isNotNull() & F.col("line").rlike(entry)).select(*keys, "section", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).alias("file"))


def status_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, state, path, tracked): S10; `git status --porcelain`, the new name of a rename."""
    lines = lines_of(df, keys, text).where(F.length("line") > 3)
    state, path = F.substring("line", 1, 2), F.regexp_replace(F.expr("substring(line, 4)"), "^.* -> ", "")
    return lines.select(*keys, F.trim(state).alias("state"), path.alias("path"), (state != "??").alias("tracked"))


def diff_sides(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, file, old, new): S10, S11; both sides of every file of a unified diff."""
    lines = lines_of(df, keys, text)
    header = F.nullif(F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1), F.lit(""))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = lines.withColumn("file", F.last(header, ignorenulls=True).over(w)).where(F.col("file").isNotNull() & ~F.col("line").rlike(r"^(diff --git|index |@@|---|\+\+\+|new file|deleted file|similarity|rename)"))
    lead, rest = F.substring("line", 1, 1), F.expr("substring(line, 2)")
    side = lambda marks: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(lead.isin(*marks), F.struct("line_no", rest.alias("t"))))), lambda x: x["t"]), "\n")
    return body.groupBy(*keys, "file").agg(side([" ", "-"]).alias("old"), side([" ", "+"]).alias("new"))


def config_change(line: Column) -> Column:
    """The value of a line of settings, by three forms in order: S12."""
    forms = [r"[=:]\s*\"([^\"]*)\"", r"[=:]\s*'([^']*)'", r"[=:]\s*([^\s;,#]+)"]
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in forms])


def numbered_steps(df: DataFrame, keys: list[str], text: str, wanted: list[int]) -> DataFrame:
    """(keys, step, text): S21; the wanted numbered steps of a text, each up to the next."""
    lines = lines_of(df, keys, text)
    number = F.nullif(F.regexp_extract("line", r"^\s*([0-9]{1,3})[.)]\s", 1), F.lit("")).cast("int")
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("step", F.last(number, ignorenulls=True).over(w)).where(F.col("step").isin(wanted))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return tagged.groupBy(*keys, "step").agg(joined.alias("text"))


def crash_scan(df: DataFrame, keys: list[str], text: str, before: int = 30) -> DataFrame:
    """(keys, signal, crash_line, faulting_function, faulting_file, faulting_line, n_frames,
    n_before): S23; the first signal of a log, its frames and the lines before it."""
    lines = lines_of(df, keys, text)
    w = Window.partitionBy(*keys).orderBy("line_no")
    signal = F.nullif(F.regexp_extract("line", r"\b(SIG[A-Z]{3,5})\b", 1), F.lit(""))
    place = r"\bat\s+(\S+?):([0-9]+)"
    frame = r"^\s*#([0-9]+)\s+.*?\bin\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("
    marked = lines.select(*keys, "line_no", "line", signal.alias("sig"), F.nullif(F.regexp_extract("line", place, 1), F.lit("")).alias("file"), F.regexp_extract("line", place, 2).alias("at"),
                          F.nullif(F.regexp_extract("line", frame, 2), F.lit("")).alias("fn"), F.lag("line").over(w).alias("above"))
    crash = marked.groupBy(*keys).agg(
        F.min_by("sig", F.when(F.col("sig").isNotNull(), F.col("line_no"))).alias("signal"), F.min(F.when(F.col("sig").isNotNull(), F.col("line_no"))).alias("crash_line"),
        F.min_by("fn", F.when(F.col("fn").isNotNull(), F.col("line_no"))).alias("faulting_function"), F.min_by(F.struct("file", "at"), F.when(F.col("file").isNotNull(), F.col("line_no"))).alias("place"),
        F.count("fn").alias("n_frames"),
    )
    return crash.where("signal is not null").select(
        *keys, "signal", "crash_line", "faulting_function", F.col("place.file").alias("faulting_file"), F.col("place.at").alias("faulting_line"), "n_frames", F.least(F.col("crash_line") - 1, F.lit(before)).alias("n_before")
    )


def fenced_blocks(text: Column) -> Column:
    """array<string>: the bodies of fenced code blocks: S28."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```[A-Za-z0-9_+-]*[ \t]*\n(.*?)```"), 1)


def salvaged_json(text: Column) -> Column:
    """variant: JSON inside free text, fences stripped, the first object or list: S29."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^```[A-Za-z]*[ \t]*$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)([{\[].*[}\]])", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))


def local_names(body: Column, most: int | None = 20) -> Column:
    """array<string>: names declared in a function body, each once, first twenty or, with None, all: S32."""
    found = F.regexp_extract_all(body, F.lit(r"(?:^|(?<=[;{]))\s*(?:const\s+|static\s+|unsigned\s+|struct\s+)*[A-Za-z_][A-Za-z0-9_]*\s*\*?\s+\*?([A-Za-z_][A-Za-z0-9_]*)\s*(?:=|;|\[)"), 1)
    names = F.array_distinct(F.filter(found, lambda n: ~n.isin("return", "goto", "case")))
    return names if most is None else F.slice(names, 1, most)


def asn1_blocks(df: DataFrame, keys: list[str], text: str, most: int = 12_000) -> DataFrame:
    """(keys, name, first_line, n_lines, body): S33; a definition runs while its braces are open.
    n_lines counts the whole definition, body shows its first most characters."""
    lines = lines_of(df, keys, text)
    head = F.nullif(F.regexp_extract("line", r"^\s*([A-Za-z][A-Za-z0-9-]*)\s*::=", 1), F.lit(""))
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    block = lines.withColumn("head", head).withColumn("block", F.sum(F.col("head").isNotNull().cast("int")).over(w)).where("block > 0")
    inner = Window.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    depth = block.withColumn("before", F.coalesce(F.sum(count("{") - count("}")).over(inner), F.lit(0)))
    kept = depth.where((F.col("before") > 0) | F.col("head").isNotNull())
    closed = Window.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # Once closed, a block stays closed.
    kept = kept.withColumn("gap", F.col("line_no") - F.coalesce(F.max("line_no").over(closed), F.col("line_no") - 1)).withColumn("broken", F.sum((F.col("gap") > 1).cast("int")).over(w)).where("broken = 0 or head is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy(*keys, "block").agg(F.max("head").alias("name"), F.min("line_no").alias("first_line"), F.count(F.lit(1)).cast("int").alias("n_lines"), F.substring(joined, 1, most).alias("body")).drop("block")


def ie_entries(df: DataFrame, row_id: str, record: Column, name: str = "IE_Name") -> DataFrame:
    """(row_id, pre, ie_name): S34; every object of a nested record that names an element."""
    nodes = node_table(df, row_id, record, {"name": f"/{name}$"})
    return nodes.where("scalar is not null").select("row_id", "pre", F.col("scalar").alias("ie_name"))


def depth_lists(df: DataFrame, keys: list[str], record: str, most: int = 20) -> DataFrame:
    """(keys, depth, place, chunk): S31, S35; lists keyed by depth flattened in order of depth,
    the first twenty chunks of each record."""
    pairs = df.select(*keys, F.explode(F.from_json(record, "map<string,array<string>>")).alias("level", "chunks")).select(*keys, F.regexp_extract("level", "([0-9]+)$", 1).try_cast("int").alias("depth"), F.posexplode("chunks").alias("place", "chunk"))
    w = Window.partitionBy(*keys).orderBy("depth", "place")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")
