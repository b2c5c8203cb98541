"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; at most so many keys can be hot,
#: which bounds the broadcast of hot keys whatever the data.
HOT_SHARE = 256


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The keys that hold more than total / HOT_SHARE rows: fewer than HOT_SHARE of them.

    The count combines on the map side.  Rows whose key has a null are left out.
    """
    least = max(total // HOT_SHARE, 1000)
    known = rows.select(*keys)
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(*keys)


def salted_left_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, salts: int = 24
) -> DataFrame:
    """rows LEFT JOIN lookup on keys, with every hot key of rows spread over many tasks.

    lookup has at most one row for a key, and no column of rows except the keys.  spread is an
    expression over rows that differs between the rows of a key, as a row id.  Only the lookup
    rows of hot keys (fewer than HOT_SHARE) are repeated.  An empty rows or lookup is allowed;
    a null key finds nothing.
    """
    total = rows.count()
    hot = F.broadcast(hot_keys(rows, keys, total).withColumn("__hot", F.lit(True)))
    salted = rows.join(hot, keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    spread_out = lookup.join(hot, keys, "left").withColumn(
        "__salt",
        F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted.drop("__hot").join(spread_out.drop("__hot"), [*keys, "__salt"], "left").drop("__salt")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over at least as many tasks as there are cores.

    A table of one small file is read by one task; costly work on its rows would use one core.
    Tables of enough parts stay as they are and are not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(2 * cores, key)
