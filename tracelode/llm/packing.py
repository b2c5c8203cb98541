"""Whole items into containers of fixed capacity.

Harmonic packing: an item of length l belongs to class floor(capacity / l), the number of its
like that fit one container, and each class fills containers of a fixed item count.  A plain
harmonic packing leaves the rest of every container empty; here the plan is refined: it works on
the histogram of lengths (at most ``capacity`` numbers whatever the data) and fills the rest of
each kind of container with the longest shorter lengths that fit.  A kind of container is a
fixed list of lengths and a count of containers.  Workers then place every item by its rank
among the items of its length, independently of one another.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators.skew import spread
from tracelode.session import cut_lineage

TOKENIZER = os.environ.get("TRACELODE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pattern that cuts text before byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks are counted within (length, salt), so that a length of many items is no single group.
SALTS = 64


@lru_cache(maxsize=2)
def _encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: Column, path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of each row; null and empty texts count 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch["__text"]]
            yield pd.DataFrame({key: batch[key], "n_tokens": sizes})

    # Keys travel as text: pandas would turn integers beside a null into floats.
    rows = spread(df.select(F.col(key).cast("string").alias(key), text.alias("__text")), key)
    counted = rows.mapInPandas(count, f"`{key}` string, n_tokens int")
    return counted.select(F.col(key).cast(df.schema[key].dataType).alias(key), "n_tokens")


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of containers: ([(length, items of it)], containers).

    Longest lengths first.  A kind starts with as many items of its length as its harmonic class
    allows and takes the longest lengths that fit until nothing fits; it is repeated as long as
    all its lengths last.  Each round uses up a length or lowers it below its class count, so
    there are at most a few kinds for each length.
    """
    left = {size: n for size, n in histogram.items() if n > 0 and 0 < size <= capacity}
    sizes = sorted(left)
    kinds = []
    while sizes:
        room, items, top = capacity, [], len(sizes)
        while top:
            top = bisect_right(sizes, room, 0, top)
            if not top:
                break
            size = sizes[top - 1]
            n = min(left[size], room // size)
            items.append((size, n))
            room -= n * size
            top -= 1
        times = min(left[size] // n for size, n in items)
        kinds.append((items, times))
        for size, n in items:
            left[size] -= n * times
            if not left[size]:
                sizes.remove(size)
    return kinds


def pack(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, part, n_tokens, container) of every item of sizes (key, n_tokens).

    An item above capacity is cut into parts: full containers of its own and a rest that is
    packed like an item.  Items of no size, null or negative ones too, go to container 0.  Keys are expected once; a
    repeated key is an item of its own.  An empty table gives no rows.  The numbers that come
    to the driver are counts by length and salt, at most capacity x SALTS.
    """
    # The count of tokens is the dear step: it is kept in the shared folder and read twice.
    items = cut_lineage(
        sizes.select(
            F.col(key),
            F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n"),
            F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    over = F.col("n") > capacity
    counted = items.withColumn("rest", F.when(over, F.col("n") % capacity).otherwise(F.col("n"))).withColumn(
        "whole", F.when(over, F.floor(F.col("n") / capacity)).otherwise(F.lit(0).cast("long"))
    )
    cells = counted.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("k"), F.sum("whole").alias("whole")).collect()
    histogram: dict[int, int] = {}
    for c in cells:
        histogram[c["rest"]] = histogram.get(c["rest"], 0) + c["k"]
    kinds = plan_containers(histogram, capacity)

    spark = sizes.sparkSession
    starts, ranks, whole_before = [], {}, sum(times for _, times in kinds)
    for c in sorted(cells, key=lambda c: (c["rest"], c["salt"])):
        starts.append((int(c["rest"]), int(c["salt"]), ranks.get(c["rest"], 0), whole_before))
        ranks[c["rest"]] = ranks.get(c["rest"], 0) + c["k"]
        whole_before += int(c["whole"])
    # For each length: runs of ranks (lo to hi) that lie n to a container from a first container on.
    runs, first, taken = [], 0, {}
    for kind, times in kinds:
        for size, n in kind:
            begin = taken.get(size, 0)
            runs.append((size, begin, begin + n * times, n, first))
            taken[size] = begin + n * times
        first += times
    base = spark.createDataFrame(starts or [(-1, -1, 0, 0)], "rest long, salt int, base long, wbase long")
    plan = (
        spark.createDataFrame(runs or [(-1, 0, 0, 1, 0)], "rest long, lo long, hi long, per int, first long")
        .groupBy("rest")
        .agg(F.collect_list(F.struct("lo", "hi", "per", "first")).alias("runs"))
    )
    cell = Window.partitionBy("rest", "salt").orderBy(key)
    before = cell.rowsBetween(Window.unboundedPreceding, -1)
    # Both tables are bounded by the capacity, not by the data.
    placed = (
        counted.withColumn("rank", F.row_number().over(cell) - 1)
        .withColumn("wrank", F.coalesce(F.sum("whole").over(before), F.lit(0)))
        .join(F.broadcast(base), ["rest", "salt"], "left")
        .join(F.broadcast(plan), "rest", "left")
        .withColumn("rank", F.col("rank") + F.col("base"))
        .withColumn("run", F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0])
        .withColumn("own", F.coalesce(F.col("run.first") + F.floor((F.col("rank") - F.col("run.lo")) / F.col("run.per")), F.lit(0)))
        .withColumn("wfirst", F.col("wbase") + F.col("wrank"))
    )
    full = F.transform(
        F.when(F.col("whole") > 0, F.sequence(F.lit(1).cast("long"), "whole")).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct(i.alias("part"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("wfirst") + i - 1).alias("container")),
    )
    last = F.when(
        (F.col("rest") > 0) | (F.col("n") == 0),
        F.array(F.struct((F.col("whole") + 1).alias("part"), F.col("rest").alias("n_tokens"), F.col("own").alias("container"))),
    ).otherwise(F.array().cast("array<struct<part:bigint,n_tokens:bigint,container:bigint>>"))
    return placed.select(key, F.explode(F.concat(full, last)).alias("p")).select(key, "p.part", "p.n_tokens", "p.container")
