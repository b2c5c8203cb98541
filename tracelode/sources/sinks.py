"""Tables to files: snapshots, appends, adjacency and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """K1: replaces what is at path."""
    df.write.mode("overwrite").format(kind).save(path)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """K2, K4: adds rows; readers never see half of a write."""
    df.write.mode("append").format(kind).save(path)


def snapshot(df: DataFrame, path: str, run: str) -> None:
    """K3: one partition for each run."""
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """K3: the rows of the last run, found by its partition."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("run")).first()[0]
    return rows.where(F.col("run") == last).drop("run")


def adjacency(edges: DataFrame) -> DataFrame:
    """K6: the targets of every node with their kinds, in order."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("dst", "kind"))).alias("targets"))


def report(df: DataFrame, line: Column) -> DataFrame:
    """K8: rows as lines of a text report."""
    return df.select(line.alias("value"))


def nested_by_level(nodes: DataFrame, key: str, parent: str, label: str, levels: int) -> DataFrame:
    """A tree as JSON text, nested bottom up; children sorted by key."""
    tree = nodes.select(key, parent, label, F.lit("[]").alias("children"))
    for _ in range(levels):
        below = tree.select(F.col(parent).alias(key), F.col(key).alias("__k"), F.concat(F.lit('{"id":"'), F.col(key), F.lit('","title":"'), F.coalesce(label, F.lit("")), F.lit('","children":'), F.col("children"), F.lit("}")).alias("__j")).where(F.col(key).isNotNull())
        lists = below.groupBy(key).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__j"))), lambda x: x["__j"]), ","), F.lit("]")).alias("__c"))
        tree = nodes.select(key, parent, label).join(lists, key, "left").select(key, parent, label, F.coalesce("__c", F.lit("[]")).alias("children"))
    return tree
