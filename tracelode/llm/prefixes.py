"""Self-join by prefix: how often longer strings continue a string, and how often they end there.

Strings are sorted over all tasks: a bounded sample gives the borders of the ranges, every string
goes to its range, and a string in question goes to each range that can hold a longer one.  One
pass over a sorted range then counts, for all strings in question at once, what starts with them.
Only distinct strings are sorted, so a frequent one is a single row with its count.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.operators.frames import frames

#: Stands behind every complete string, so that its end sorts before all that goes on.
END = "\x04"
#: Strings sampled for each range; the sample alone comes to the driver.
SAMPLE = 20


def borders(strings: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 strings that part the distinct strings evenly; the sample holds the
    strings of the smallest hashes, so it is the same each time."""
    rows = strings.select("s").orderBy(F.xxhash64("s"), "s").limit(ranges * SAMPLE).collect()
    sample = sorted(r["s"] for r in rows)
    return [sample[i * SAMPLE] for i in range(1, len(sample) // SAMPLE)]


def scan(rows: Iterator[tuple[str, bool, int]]) -> Iterator[tuple[str, int, int]]:
    """(asked string, ends, longer) from rows (string, asked, count) in sorted order, an asked one
    before an equal one.  Prefixes of the present string that are asked stand on a stack."""
    stack: list[list] = []

    def close() -> tuple[str, int, int]:
        s, ends, longer = stack.pop()
        if stack:
            stack[-1][2] += ends + longer
        return s, ends, longer

    for s, asked, n in rows:
        while stack and not s.startswith(stack[-1][0]):
            yield close()
        if asked:
            if not stack or stack[-1][0] != s:
                stack.append([s, 0, 0])
        elif stack:
            if len(s) == len(stack[-1][0]) + 1 and s[-1] == END:
                stack[-1][1] += n
            else:
                stack[-1][2] += n
    while stack:
        yield close()


def prefix_counts(strings: DataFrame, asked: DataFrame) -> DataFrame:
    """(s, ends, longer) for each distinct string s of asked.

    strings: (s, n), distinct strings closed by END, with counts.  ends counts those equal to s,
    longer those that go on behind it.  Nulls are left out; an empty side gives zero or no rows.
    """
    ranges = max(8, int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    between = borders(strings, ranges)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for s, is_asked, n in zip(batch["s"], batch["asked"], batch["n"]):
                first = (bisect_left if is_asked else bisect_right)(between, s)
                last = bisect_right(between, s + "\U0010ffff") if is_asked else first
                out += [(part, s, is_asked, n) for part in range(first, last + 1)]
            yield from frames(out, ["part", "s", "asked", "n"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(part: int | None = None) -> Iterator[tuple[int, str, bool, int]]:
            for batch in batches:
                yield from zip(batch["part"], batch["s"], batch["asked"], batch["n"])

        out: list[tuple] = []
        part, held = None, rows()
        following = next(held, None)
        while following is not None:
            part = following[0]

            def of_part() -> Iterator[tuple[str, bool, int]]:
                nonlocal following
                while following is not None and following[0] == part:
                    yield following[1:]
                    following = next(held, None)

            for found in scan(of_part()):
                out.append(found)
                if len(out) >= 20_000:
                    yield from frames(out, ["s", "ends", "longer"])
                    out = []
        yield from frames(out, ["s", "ends", "longer"])

    both = strings.select("s", F.lit(False).alias("asked"), F.col("n").cast("long").alias("n")).unionByName(
        asked.select("s", F.lit(True).alias("asked"), F.lit(0).cast("long").alias("n")).distinct()
    )
    placed = both.where(F.col("s").isNotNull()).mapInPandas(place, "part int, s string, asked boolean, n long")
    ordered = placed.repartition(ranges, "part").sortWithinPartitions("part", "s", F.desc("asked"))
    return ordered.mapInPandas(count, "s string, ends long, longer long").groupBy("s").agg(F.sum("ends").alias("ends"), F.sum("longer").alias("longer"))
