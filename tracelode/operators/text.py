"""Line and text operators: scans, windows of lines, chunking, cleaning, rules over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLOUR = "\x1b\\[[0-9;]*m"


def without_colour(text: Column) -> Column:
    """Text without terminal colours."""
    return F.regexp_replace(text, COLOUR, "")


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line_no from 1, line): the lines of a text without colours and line ends.

    Null texts have no lines, an empty text has one empty line.
    """
    return (
        df.where(F.col(text).isNotNull())
        .select(*keys, F.posexplode(F.split(F.replace(without_colour(F.col(text)), F.lit("\r"), F.lit("")), "\n")).alias("__p", "line"))
        .select(*keys, (F.col("__p") + 1).alias("line_no"), "line")
    )


def line_context(lines: DataFrame, keys: list[str], hit: Column, before: int, after: int) -> DataFrame:
    """(keys, line_no, context): each line for which hit holds, with the lines around it.

    The frame stays within one text, which bounds the window partition.
    """
    frame = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(frame), "\n")).where(hit).select(*keys, "line_no", "context")


def forward_fill(lines: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """lines with the last value that was not null, up to and with the line itself."""
    frame = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(frame))


def anchor_lines(lines: DataFrame, keys: list[str], patterns: list[str], most: int = 20) -> DataFrame:
    """The first `most` distinct lines that match a pattern, errors before warnings before the
    rest, in order of first occurrence; a top-k report."""
    matching = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike("(?i)" + "|".join(patterns)))
    once = matching.groupBy(*keys, "line").agg(F.min("line_no").alias("first_line"))
    low = F.lower("line")
    severity = F.when(low.contains("error") | low.contains("failed") | low.contains("no amf"), 0).when(low.contains("warn"), 1).otherwise(2)
    w = Window.partitionBy(*keys).orderBy("severity", "first_line")
    return once.withColumn("severity", severity).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def matched_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """array<string>: labels of the rules whose pattern occurs in text, in rule order."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), F.lit(label)) for p, label in rules]))


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first rule whose pattern occurs in text."""
    out = None
    for p, label in rules:
        hit = text.rlike("(?i)" + p)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def occurrences(text: Column, needle: str) -> Column:
    """How often needle stands in text, case ignored, without overlap."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("long")


def keyword_score(subject: Column, body: Column, functions: Column, words: list[str]) -> Column:
    """Two a keyword in the subject, one in the body, three in a function name; tenths, 1 at most."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.lower(subject).contains(w), 2).otherwise(0) + F.when(F.lower(body).contains(w), 1).otherwise(0)
        total = total + F.when(F.lower(functions).contains(w), 3).otherwise(0)
    return F.least(total / 10.0, F.lit(1.0))


def word_stride(words: Column, size: int, overlap: int) -> Column:
    """array<array<string>>: windows of size words, each starting size - overlap after the last."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1 - overlap, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: F.slice(words, i + 1, size))


def midpoint(words: Column, overlap: int) -> Column:
    """Two halves that share half the overlap on each side of the middle."""
    n, half = F.size(words), overlap // 2
    mid = F.floor(n / 2).cast("int")
    return F.array(F.slice(words, 1, mid + half), F.slice(words, F.greatest(mid - half, F.lit(0)) + 1, n))


def greedy_sentences(sentences: Column, most: int) -> Column:
    """array<string>: sentences packed in order while they fit `most` words; a fold."""
    count = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        fits = (acc["n"] + count(s) <= most) | (acc["n"] == 0)
        return F.when(
            fits,
            F.struct(acc["done"].alias("done"), F.when(acc["n"] == 0, s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"), (acc["n"] + count(s)).alias("n")),
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open"), count(s).alias("n")))

    return F.aggregate(sentences, start, add, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def chunk_words(text: Column, most: int = 300, overlap: int = 50) -> Column:
    """Chunks by word count: whole up to most words, halves with overlap up to twice that, beyond
    it sentences packed greedily, or strides where there is a single sentence.  Null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    joined = lambda parts: F.transform(parts, lambda p: F.array_join(p, " "))
    return (
        F.when(F.size(words) == 0, F.array().cast("array<string>"))
        .when(F.size(words) <= most, F.array(F.array_join(words, " ")))
        .when(F.size(words) <= 2 * most, joined(midpoint(words, overlap)))
        .when(F.size(sentences) > 1, greedy_sentences(sentences, most))
        .otherwise(joined(word_stride(words, most, overlap)))
    )


def fixed_pieces(text: Column, size: int) -> Column:
    """Pieces of a fixed width, trimmed, empty ones dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.trim(F.substring(text, i + 1, F.lit(size)))), lambda p: p != "")


def paragraphs(lines: DataFrame, keys: list[str], furniture: str) -> DataFrame:
    """(keys, paragraph, text): lines joined up to a blank one, page furniture dropped, words
    hyphenated over a line end joined."""
    kept = lines.withColumn("line", F.trim("line")).where(~F.col("line").rlike(furniture))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = kept.withColumn("paragraph", F.sum((F.col("line") == "").cast("int")).over(w)).where(F.col("line") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy(*keys, "paragraph").agg(F.replace(joined, F.lit("- "), F.lit("")).alias("text"))


# Labels of function names by what the name contains.
CATEGORIES = [
    ("amf", ["amf"]), ("gnb", ["gnb", "gnodeb"]), ("ngap", ["ngap"]), ("rrc", ["rrc"]), ("nas", ["nas"]), ("sctp", ["sctp"]),
    ("handler", ["handle", "handler"]), ("setup", ["setup", "init", "initialize"]), ("registration", ["register", "associate"]),
    ("connection", ["connect", "establish"]), ("selection", ["select", "choose"]), ("error_handling", ["error", "fail", "failure"]),
]


def categories(name: Column) -> Column:
    """array<string>: all labels that fit a name, general where none does."""
    low = F.lower(name)
    anyof = lambda words: low.rlike("|".join(words))
    found = F.array_compact(F.array(*[F.when(anyof(words), F.lit(label)) for label, words in CATEGORIES]))
    return F.when(F.size(found) == 0, F.array(F.lit("general"))).otherwise(found)


def call_priority(name: Column, calls: Column, callers: Column) -> Column:
    """Priority of a function in the call graph from its name and its degree."""
    low = F.lower(name)
    return F.round(
        F.when(low.rlike("amf|gnb|ngap|rrc|nas"), 10.0).otherwise(0.0)
        + F.when(low.rlike("error|handle|fail|setup|register"), 5.0).otherwise(0.0)
        + F.least((calls + callers) * 0.5, F.lit(10.0))
        + F.when(callers > 5, 3.0).otherwise(0.0)
        + F.when(calls > 10, 2.0).otherwise(0.0),
        2,
    )


def for_role(name: Column, path: Column, role: str) -> Column:
    """Whether a function suits the role of the node that logged."""
    parts = {"CU": ("du", "ue"), "DU": ("cu", "ue"), "UE": ("cu", "du")}
    low_path, low_name = F.lower(path), F.lower(name)
    if role in parts:
        a, b = parts[role]
        return ~low_path.rlike(f"/{a}/|/{b}/") & ~low_name.rlike(f"^({a}_|{b}_)")
    if role == "gNB":
        return low_path.rlike("gnb|ngap") | low_name.rlike("^(gnb_|ngap_)")
    return F.lit(True)


def canonical_path(path: Column) -> Column:
    """Slashes one way, lower case, without the prefix of a checkout."""
    slashed = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.regexp_replace(slashed, r"^(?:[a-z]:)?(?:/opt/build/|/work/|.*?openradio-main/)", "")


def diff_line_kind(line: Column) -> Column:
    """Kind of a line of a unified diff."""
    return (
        F.when(line.startswith("+++") | line.startswith("---"), "file")
        .when(line.startswith("@@"), "hunk")
        .when(line.startswith("diff --git") | line.startswith("index "), "meta")
        .when(line.startswith("+"), "add")
        .when(line.startswith("-"), "remove")
        .otherwise("context")
    )


def duration_label(ms: Column) -> Column:
    """A duration as people write it: <1s, 42s, 3m 5s, 2h 7m."""
    s = F.floor(ms / 1000).cast("long")
    return (
        F.when(s < 1, "<1s")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )
