"""Run state kept by merging change logs: upserts, status ranks, incremental sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank of a status; a later or equal rank replaces.
STATUS_RANK = {"not_completed": 0, "in_progress": 1, "completed": 2, "failed": 3}


def upsert_latest(changes: DataFrame, keys: list[str], order: list[str], first: list[str], coalesced: list[str], latest: list[str]) -> DataFrame:
    """One row for each key after all changes in order.

    first keeps the value of the first change, coalesced the last value that was not null,
    latest the value of the last change, null or not.  Changes combine on the map side.
    """
    o = F.struct(*order)
    agg = [F.min_by(c, o).alias(c) for c in first]
    agg += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in coalesced]
    agg += [F.max_by(F.struct(c), o)[c].alias(c) for c in latest]
    return changes.groupBy(*keys).agg(*agg)


def status_rank(status: Column) -> Column:
    """Rank of a status, -1 for one that is not known."""
    out = None
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, rank) if out is None else out.when(status == name, rank)
    return out.otherwise(-1)


def monotone_status(changes: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """The highest-ranked status of each key; of equal ranks the latest."""
    return changes.groupBy(*keys).agg(F.max(F.struct(status_rank(F.col(status)).alias("rank"), F.col(order).alias("at"), F.col(status).alias("status"))).alias("m")).select(
        *keys, "m.status", "m.rank", "m.at"
    )


def overall_status(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """failed if any failed, else in_progress if any is, else completed if all are."""
    s = F.col(status)
    return rows.groupBy(*keys).agg(
        F.when(F.coalesce(F.bool_or(s == "failed"), F.lit(False)), "failed")
        .when(F.coalesce(F.bool_or(s == "in_progress"), F.lit(False)), "in_progress")
        .when(F.coalesce(F.bool_and(s == "completed"), F.lit(False)), "completed")
        .otherwise("not_completed")
        .alias("overall")
    )


def incremental_replace(old: DataFrame, changed: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of changed keys, and the fresh rows; a key in both counts as changed."""
    kept = old.join(changed.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh)


def append_unseen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and the rows of new whose key is not there yet, each key once."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def progress(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Counts by status and the share that is completed, in percent."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in STATUS_RANK]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts).withColumn("percent", F.round(F.col("n_completed") * 100.0 / F.col("n"), 2))
