"""References to records that do not exist, have been removed, or came later.

Composite keys may be partly null.  References are grouped by their null mask, that is by which
key columns are not null, and each mask is joined on exactly those columns; what a mask means
is declared by the match rule, as in SQL:

- simple:  a reference with any null refers to nothing and is never an orphan;
- partial: the columns that are not null must agree with some live target;
- full:    all null refers to nothing; partly null is always an orphan (reason "mixed").
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.operators.skew import salted_left_join

RESULT = ["src_table", "row_id", "reason"]


def uuid_key(value: Column) -> Column:
    """A UUID in one form: no white space around, no braces, lower case; blank becomes null."""
    bare = F.lower(F.regexp_replace(value, r"^[\s {]+|[\s }]+$", ""))
    return F.when(bare != "", bare)


def plain_key(value: Column) -> Column:
    """The value itself."""
    return value


@dataclass(frozen=True)
class Reference:
    """One declared foreign key: columns of a table that name rows of a target table."""

    table: str
    row_id: str
    columns: list[str]
    target: str
    target_columns: list[str]
    match: str = "simple"
    seen: str | None = "ingested_at"
    target_seen: str | None = "ingested_at"
    key: object = field(default=uuid_key)


def latest_removed(log: DataFrame, target: str, key=uuid_key) -> DataFrame:
    """Keys of target whose latest logged operation is delete, as column k0.

    Rows of the log are in no order; at the same instant a restore wins over a delete.  Rows
    without a key or a time are left out.
    """
    return (
        log.where(F.lower(F.trim("src_table")) == target)
        .select(key(F.col("row_key")).alias("k0"), F.lower(F.trim("purge_op")).alias("op"), F.col("purged_at").alias("at"))
        .where(F.col("k0").isNotNull() & F.col("at").isNotNull())
        .groupBy("k0")
        .agg(F.max(F.struct("at", "op")).alias("last"))
        .where(F.col("last.op") == "delete")
        .select("k0", F.lit(True).alias("removed"))
    )


def orphan_references(rows: DataFrame, targets: DataFrame, ref: Reference, purge_log: DataFrame | None = None) -> DataFrame:
    """(src_table, row_id, reason) of each row whose reference finds no live, earlier target.

    reason is absent (no row), removed (latest purge is a delete), late (the target was first
    ingested after the row) or mixed (a partly null reference under full match).  Rows are
    distinct.  A row without a reference, and one whose own ingestion time is unknown in the
    question of lateness, is no case.  Repeated rows and targets count by their first
    ingestion.  Columns that are not named in ref are never read.
    """
    width = len(ref.columns)
    names = [f"k{i}" for i in range(width)]
    seen = F.col(ref.seen) if ref.seen else F.lit(None).cast("timestamp")
    keyed = rows.select(
        F.col(ref.row_id).cast("string").alias("row_id"),
        seen.alias("seen"),
        *[ref.key(F.col(c)).alias(n) for c, n in zip(ref.columns, names)],
    )
    target_seen = F.col(ref.target_seen) if ref.target_seen else F.lit(None).cast("timestamp")
    known = (
        targets.select(*[ref.key(F.col(c)).alias(n) for c, n in zip(ref.target_columns, names)], target_seen.alias("tseen"))
        .groupBy(*names)
        .agg(F.min("tseen").alias("tseen"))
    )
    if purge_log is not None and width == 1:
        known = known.join(latest_removed(purge_log, ref.target, ref.key), "k0", "left")
    else:
        known = known.withColumn("removed", F.lit(None).cast("boolean"))
    live = F.col("removed").isNull()

    found = []
    for mask in product([True, False], repeat=width):
        kept = [n for n, on in zip(names, mask) if on]
        here = reduce(lambda a, b: a & b, [F.col(n).isNotNull() if on else F.col(n).isNull() for n, on in zip(names, mask)])
        if not kept or (ref.match == "simple" and len(kept) < width):
            continue
        part = keyed.where(here).select("row_id", "seen", *kept)
        if len(kept) < width and ref.match == "full":
            found.append(part.select("row_id", F.lit("mixed").alias("reason")))
            continue
        lookup = known
        for n in kept:
            lookup = lookup.where(F.col(n).isNotNull())
        if len(kept) < width:
            lookup = lookup.groupBy(*kept).agg(
                F.min(F.when(live, F.col("tseen"))).alias("tseen"),
                F.when(F.count_if(live) == 0, F.lit(True)).alias("removed"),
            )
        lookup = lookup.select(*kept, "tseen", "removed", F.lit(True).alias("there"))
        joined = salted_left_join(part, lookup, kept, F.col("row_id"))
        reason = (
            F.when(F.col("there").isNull(), "absent")
            .when(F.col("removed"), "removed")
            .when(F.col("tseen") > F.col("seen"), "late")
        )
        found.append(joined.select("row_id", reason.alias("reason")).where(F.col("reason").isNotNull()))
    if not found:
        return keyed.select(F.lit(ref.table).alias("src_table"), "row_id", F.lit("").alias("reason")).limit(0)
    # Copies of a row may differ in "late" only by their own ingestion: any of them decides.
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("row_id")
        .agg(F.min("reason").alias("reason"))
        .select(F.lit(ref.table).alias("src_table"), "row_id", "reason")
    )
