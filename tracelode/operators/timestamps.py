"""Timestamps of many written forms to one UTC instant.

Each value gets an array of all its valid readings: both orders of a purely numeric date and both
sides of a wall-clock time that occurs twice.  A reading is (form, utc_us, cost); the cost is 0 for
what the row's site and the value declare and DECLARED for each thing that a reading contradicts.
A Viterbi pass over each source's rows in record order then picks one reading a row, with a penalty
for a change of form and for a jump back in time.  DECLARED exceeds the most that the two
transitions of a row can cost, so a valid declared reading always stands and the transitions decide
what the declaration leaves open: the order of numeric dates of a source that declares none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.frames import frames
from tracelode.operators.skew import spread

DECLARED = 1000.0
SWITCH = 1.0
BACKWARD = 2.0

# English month abbreviations in order.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_MONTH = "(" + "|".join(MONTHS) + ")[A-Z]*"
_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?: ?(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?))?(?: ?\[([A-Z0-9_+/-]+)\])?(?: ([A-Z]{2,5}))?"
# Minutes from UTC that zone abbreviations stand for.  They only tell the two sides of a
# wall-clock time that occurs twice apart, so one of several meanings is the one its zone has.
ABBREVIATIONS = {
    "WET": [0], "WEST": [60], "GMT": [0], "BST": [60], "IST": [60, 120, 330], "CET": [60], "CEST": [120], "EET": [120], "EEST": [180], "MSK": [180], "IDT": [180],
    "NST": [-210], "NDT": [-150], "AST": [-240], "ADT": [-180], "EST": [-300], "EDT": [-240], "CST": [-360], "CDT": [-300], "MST": [-420], "MDT": [-360],
    "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480], "ACST": [570], "ACDT": [630], "AEST": [600], "AEDT": [660], "NZST": [720], "NZDT": [780],
}

#: (form, pattern, groups by role); roles: y year, m month, M month name, d day, a/b the two
#: numbers of a purely numeric date, h min s frac the clock, p AM or PM, o offset, z zone name,
#: n zone abbreviation.
FORMS = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK}{_ZONE}$", ["y", "m", "d", "h", "min", "s", "frac", "o", "z", "n"]),
    ("iso_date", r"^(\d{4})-(\d{2})-(\d{2})$", ["y", "m", "d"]),
    ("basic", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?" + _ZONE + "$", ["y", "m", "d", "h", "min", "s", "frac", "o", "z", "n"]),
    ("numeric", rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}),? {_CLOCK}(?: ?([AP]M))?{_ZONE}$", ["a", "b", "y", "h", "min", "s", "frac", "p", "o", "z", "n"]),
    ("day_name_first", rf"^(?:[A-Z]{{3,9}},? )?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{2}}(?:\d{{2}})?),? {_CLOCK}(?: ?([AP]M))?{_ZONE}$", ["d", "M", "y", "h", "min", "s", "frac", "p", "o", "z", "n"]),
    ("ctime", rf"^[A-Z]{{3}} {_MONTH} +(\d{{1,2}}) {_CLOCK}(?: ([A-Z]{{2,5}}))? (\d{{4}})$", ["M", "d", "h", "min", "s", "frac", "n", "y"]),
]
#: (form, pattern of a count since 1970, microseconds of one unit)
EPOCHS = [
    ("epoch_s", r"^\d{9,10}(?:\.\d{1,9})?$", 1_000_000),
    ("epoch_ms", r"^\d{12,13}$", 1_000),
    ("epoch_us", r"^\d{15,16}$", 1),
]


_HOUR = 3_600_000_000


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _instants(c: Column) -> Column:
    """array of the readings of one date and clock (form, at, shift, zone, says, micros, cost): one, or
    two where the clock of the zone shows it twice.  Of two the later one costs nothing if the
    abbreviation is that of its offset alone, else the first one."""
    reading = lambda us, more: F.struct(c["form"].alias("form"), (us + c["micros"]).alias("utc_us"), (c["cost"] + more).alias("cost"))
    one = lambda us: F.array(reading(us, F.lit(0.0)))
    means = F.create_map(*[x for name, minutes in ABBREVIATIONS.items() for x in (F.lit(name), F.array(*[F.lit(m) for m in minutes]))])
    named = lambda offset: F.coalesce(F.array_contains(means[c["says"]], (offset / 60_000_000).cast("int")), F.lit(False))

    def sides(first: Column, after: Column) -> Column:
        twice = (c["at"] - after > first) & (_clock(c["at"] - after, c["zone"]) == c["at"])
        costs = F.when(named(after) & ~named(c["at"] - first), F.array(F.lit(DECLARED), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(DECLARED)))
        return F.when(twice, _bound(costs, lambda x: F.array(reading(first, x[0]), reading(c["at"] - after, x[1])))).otherwise(one(first))

    # The offset in force soon after: another one only near a change of the clock.
    local = lambda first: _bound(_clock(first + 3 * _HOUR, c["zone"]) - (first + 3 * _HOUR), lambda after: sides(first, after))
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c["at"]), c["zone"]))
    return F.when(c["shift"].isNotNull(), one(c["at"] - c["shift"])).otherwise(_bound(first, local))


def _clock(us: Column, zone: Column) -> Column:
    """What the clock of zone shows at the instant us, as microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _form_readings(text: Column, pattern: str, form: str, roles: list[str], zone: Column, month_first: Column) -> Column:
    """array of the dates and clocks of one form, as _instants takes them; the pattern runs once and its
    groups are bound to g."""
    groups = F.split(F.regexp_replace(text, pattern, "\x1f".join(f"${i + 1}" for i in range(len(roles)))), "\x1f")
    matched = F.array_compact(F.array(F.when(text.rlike(pattern), groups)))

    def read(g: Column) -> Column:
        part = {role: g[i] for i, role in enumerate(roles)}
        number = lambda role: F.coalesce(part[role].try_cast("int"), F.lit(0)) if role in part else F.lit(0)
        year = number("y")
        year = F.when(year < 100, year + 2000).otherwise(year)
        hour = number("h")
        if "p" in part:
            twelve = F.when(hour.between(1, 12), hour % 12 + F.when(part["p"] == "PM", 12).otherwise(0))
            hour = F.when(part["p"] == "", hour).otherwise(twelve)
        micros = F.substring(F.rpad(part["frac"], 6, "0"), 1, 6).try_cast("long") if "frac" in part else F.lit(0)
        if "M" in part:
            month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part["M"]).cast("int")
            dates = [(form, month, number("d"), F.lit(0.0))]
        elif "a" in part:
            dates = [
                ("numeric_dmy", number("b"), number("a"), F.when(month_first, DECLARED).otherwise(0.0)),
                ("numeric_mdy", number("a"), number("b"), F.when(~month_first, DECLARED).otherwise(0.0)),
            ]
        else:
            dates = [(form, number("m"), number("d"), F.lit(0.0))]
        fits = (hour < 24) & (number("min") < 60) & (number("s") < 60)
        offset = part.get("o", F.lit(""))
        digits = F.replace(F.substring(offset, 2, 5), F.lit(":"), F.lit(""))
        minutes = F.substring(digits, 1, 2).try_cast("long") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("long"), F.lit(0))
        shift = F.when(offset.startswith("+"), minutes).when(offset.startswith("-"), -minutes).when(offset != "", F.lit(0)) * 60_000_000
        place = zone
        if "z" in part:
            # A zone in brackets without an offset: Area/City of the zone database.
            named = F.replace(F.initcap(F.replace(F.lower(part["z"]), F.lit("/"), F.lit(" / "))), F.lit(" / "), F.lit("/"))
            place = F.when(part["z"].rlike("^[A-Z]+/[A-Z]+$"), named).otherwise(zone)
        out = []
        for name, month, day, cost in dates:
            at = F.unix_micros(F.try_make_timestamp(year, month, day, hour, number("min"), number("s"), F.lit("UTC")))
            fields = {"form": F.lit(name), "at": at, "shift": shift, "zone": place, "says": part.get("n", F.lit("")), "micros": micros, "cost": cost}
            out.append(F.when(fits, F.struct(*[x.alias(k) for k, x in fields.items()])))
        return F.filter(F.array_compact(F.array(*out)), lambda c: c["at"].isNotNull())

    return F.flatten(F.transform(matched, read))


def readings(value: Column, zone: Column, month_first: Column, undeclared: bool = True) -> Column:
    """array<struct<form, utc_us, cost>>: every valid reading of value, none as an empty array.

    month_first: the declared day-month order, null for none; then both orders cost 0.
    undeclared: also readings that contradict what is declared, at cost DECLARED and more.

    Null, blank and meaningless values have none; digits beyond microseconds are dropped;
    missing seconds are zero; a wall-clock time that occurs twice means the first, unless a zone
    abbreviation says the second, one that is skipped takes the offset in force before the change
    (as java.time has it).
    """
    text = F.upper(F.regexp_replace(F.regexp_replace(value, r"^[\s ﻿]+|[\s ﻿]+$", ""), r"[\s ]+", " "))
    every = []
    for form, pattern, unit in EPOCHS:
        us = F.floor(text.try_cast("decimal(28,9)") * unit).cast("long")
        every.append(F.when(text.rlike(pattern), F.struct(F.lit(form).alias("form"), us.alias("utc_us"), F.lit(0.0).alias("cost"))))
    dated = F.concat(*[_form_readings(text, p, form, roles, zone, month_first) for form, p, roles in FORMS])
    listed = F.concat(F.array_compact(F.array(*every)), F.flatten(F.transform(dated, _instants)))
    return listed if undeclared else F.filter(listed, lambda r: r["cost"] < DECLARED)


def best_path(rows: list[tuple[list[str], list[int], list[float]]], start: tuple[str, int] | None) -> list[int]:
    """Viterbi over consecutive rows; of equal paths the earlier reading of a row wins."""
    score: list[float] = []
    back: list[list[int]] = []
    before: tuple[list[str], list[int]] = ([start[0]], [start[1]]) if start else ([], [])
    for i, (forms, instants, costs) in enumerate(rows):
        now, origin = [], []
        for form, at, cost in zip(forms, instants, costs):
            best, where = 0.0, -1
            for j, (f, t) in enumerate(zip(*before)):
                step = (score[j] if i else 0.0) + SWITCH * (f != form) + BACKWARD * (at < t)
                if where < 0 or step < best:
                    best, where = step, j
            now.append(best + cost)
            origin.append(where)
        score, before = now, (forms, instants)
        back.append(origin)
    pick = min(range(len(score)), key=lambda j: (score[j], j))
    path = [pick]
    for origin in reversed(back[1:]):
        path.append(origin[path[-1]])
    return path[::-1]


def _follow(batches: Iterator[pd.DataFrame], below: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by block and order; a row of one reading fixes the path, so only the rows
    between two such rows are held.  Rows whose picked reading costs below or more are left out."""
    block, last, held = None, None, []

    def close() -> list[tuple]:
        nonlocal last
        if not held:
            return []
        path = best_path([(x[1], x[2], x[3]) for x in held], last)
        done = [(x[0], x[1][k], int(x[2][k]), x[3][k]) for x, k in zip(held, path)]
        last = (done[-1][1], done[-1][2])
        held.clear()
        return [x for x in done if x[3] < below]

    for batch in batches:
        out: list[tuple] = []
        for where, row, forms, instants, costs in zip(batch["block"], batch["row"], batch["forms"], batch["instants"], batch["costs"]):
            if where != block:
                out += close()
                block, last = where, None
            if not len(forms):
                continue
            held.append((row, list(forms), [int(x) for x in instants], list(costs)))
            if len(forms) == 1:
                out += close()
        yield from frames([(r[0], r[2], r[1]) for r in out], ["row", "utc_us", "form"])
    yield from frames([(r[0], r[2], r[1]) for r in close()], ["row", "utc_us", "form"])


def to_instants(
    df: DataFrame, row_id: str, value: Column, source: Column, order: Column, zone: Column, month_first: Column, undeclared: bool = True
) -> DataFrame:
    """(row, utc_us, form) of each row of df with a valid reading; rows without one are left out.

    source and order give the record order of the path; repeated rows and ties keep their place by
    row id.  Where month_first is declared the costs alone decide, so the path runs within one source
    and hour of order, which splits a source that holds most rows; the other rows of a source are
    followed from first to last by one task.  undeclared: also rows of which every reading
    contradicts what is declared.  An empty df gives no rows.
    """
    hour = F.when(month_first.isNotNull(), F.date_trunc("hour", order))
    listed = (
        spread(df, row_id).select(
            F.xxhash64(source, hour).alias("block"),
            order.alias("ord"),
            F.col(row_id).cast("string").alias("row"),
            readings(value, zone, month_first).alias("r"),
        )
        .select("block", "ord", "row", F.col("r.form").alias("forms"), F.col("r.utc_us").alias("instants"), F.col("r.cost").alias("costs"))
    )
    ordered = listed.repartition("block").sortWithinPartitions("block", "ord", "row").drop("ord")
    below = math.inf if undeclared else DECLARED
    return ordered.mapInPandas(lambda batches: _follow(batches, below), "row string, utc_us long, form string")
