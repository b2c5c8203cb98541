"""Scalar functions over columns, all on the JVM side but the pluggable text function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_token(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")


def collapsed(value: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def ie_type_name(message: Column) -> Column:
    """UE CONTEXT SETUP REQUEST -> UeContextSetupRequestIEs."""
    return F.concat(F.array_join(F.transform(F.split(collapsed(message), " "), lambda w: F.initcap(F.lower(w))), ""), F.lit("IEs"))


def name_variants(name: Column) -> Column:
    """array<string>: spellings of a name, longest first, ties by alphabet."""
    forms = F.array_distinct(F.array(name, F.lower(name), F.upper(name), F.replace(name, F.lit(" "), F.lit("_")), F.replace(name, F.lit("-"), F.lit("_")), bare_token(name)))
    return F.array_sort(forms, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def keywords_in(text: Column, words: list[str]) -> Column:
    """array<string>: the words that stand in text as whole ASCII words."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])"), F.lit(w)) for w in words]))


def ipv4s(text: Column) -> Column:
    """array<string>: dotted addresses in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"), 1))


def network_params(text: Column) -> Column:
    """struct<ips, port, state>: addresses, first port by priority of wording, association state."""
    port = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)ngap[^\n]*port[^0-9\n]*([0-9]{2,5})", r"(?i)port[ =:]+([0-9]{2,5})")])
    state = F.when(F.lower(text).contains("no amf is associated"), "none").when(F.lower(text).rlike("association (established|up)|associated"), "up").otherwise("unknown")
    return F.struct(ipv4s(text).alias("ips"), port.try_cast("int").alias("port"), state.alias("state"))


def did_you_mean(text: Column) -> Column:
    """array<struct<wrong, suggested>>: what a compiler suggests instead."""
    p = "[‘']([^’']+)[’'][^\n]*?did you mean [‘']([^’']+)[’']"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 1).alias("wrong"), F.regexp_extract_all(text, F.lit(p), 2).alias("suggested"))


def undefined_symbols(text: Column) -> Column:
    """array<string>: symbols a linker did not find."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("undefined reference to [`‘']([^'’]+)['’]"), 1))


def smart_cut(code: Column, head: int = 100, tail: int = 20, most: int = 8000) -> Column:
    """First head and last tail lines of long code, most characters at most."""
    lines = F.split(code, "\n")
    shown = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), F.lit("\n...\n"), F.array_join(F.slice(lines, F.size(lines) - tail + 1, tail), "\n"))
    return F.substring(F.when(F.size(lines) <= head + tail, code).otherwise(shown), 1, most)


def commit_date(text: Column) -> Column:
    """Instant of a commit date in ISO or either form of git."""
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3} ", ""), F.lit("MMM d HH:mm:ss yyyy Z")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")),
    )


def age_days(at: Column, as_of: Column) -> Column:
    """Whole days from at to as_of; time is always given, never read from the clock."""
    return F.datediff(as_of, at)


def slug(value: Column) -> Column:
    """Safe as a file name."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def search_text(name: Column, body: Column, path: Column, most: int = 2000) -> Column:
    """Text to embed for a function or a setting: V1."""
    return F.concat_ws("\n", name, F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("..."))).otherwise(body), path)


def graded(answer: Column, n: int) -> Column:
    """array<double>: grades `i: score - reason` of n candidates, 1 at most, 0.3 where missing: V25."""
    found = F.map_from_entries(
        F.filter(
            F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.alias("k"), F.call_function("regexp_extract", answer, F.concat(F.lit("(?m)^\\s*"), i.cast("string"), F.lit("\\s*:\\s*([0-9]*\\.?[0-9]+)")), F.lit(1)).try_cast("double").alias("v"))),
            lambda e: e["v"].isNotNull(),
        )
    )
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.least(F.coalesce(F.try_element_at(found, i), F.lit(0.3)), F.lit(1.0)))


def text_function(answer: Callable[[pd.Series], pd.Series] | None = None):
    """A pluggable prompt -> text function; by default the deterministic fallback, the first line
    that names an error."""

    def fallback(prompts: pd.Series) -> pd.Series:
        first = lambda p: next((x for x in (p or "").split("\n") if "error" in x.lower() or "fail" in x.lower()), "")
        return prompts.map(first)

    given = answer or fallback

    @F.pandas_udf("string")
    def apply(prompts: pd.Series) -> pd.Series:
        return given(prompts)

    return apply


def readable_json(value: Column) -> Column:
    """Whether value is one JSON text and nothing else; false where null.

    A key may stand twice in an object; NaN and Infinity are numbers; nesting goes to about 1,000 levels.
    """
    # The parser stops behind the first value, so value is read inside a list and inside an object:
    # what follows or closes too early is broken in one of the two.
    strict = {"allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", strict)
    kept = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string, bad string", strict | {"columnNameOfCorruptRecord": "bad"})
    return F.coalesce((F.size(listed) == 1) & kept["bad"].isNull(), F.lit(False))
