"""Predicates and small rankings over candidates, paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name parts of functions that deal with errors.
HANDLERS = "[Rr]eject|[Ee]rror|[Ff]ailure|[Cc]leanup|[Rr]emove.*[Uu][Ee]|[Gg]enerate.*[Rr]eject"


def one_path(path: Column) -> Column:
    """Slashes one way and lower case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def active_path(path: Column, active: list[str]) -> Column:
    """Path holds an active one or is held by it; an empty list keeps all: F2, F3."""
    if not active:
        return F.lit(True)
    p = one_path(path)
    hits = [p.contains(a.lower()) | F.lit(a.lower()).contains(p) | p.endswith("/" + a.lower().rsplit("/", 1)[-1]) for a in active]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def handler_score(name: Column) -> Column:
    """0.9 for names of error handlers, else null: F7."""
    return F.when(name.rlike(HANDLERS), F.lit(0.9))


def guarded(df: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Rows that pass, or all rows of a group in which none does: F9."""
    passes = F.coalesce(keep, F.lit(False))
    return df.withColumn("__k", passes).withColumn("__n", F.sum(F.col("__k").cast("int")).over(Window.partitionBy(*keys))).where("__k or __n = 0").drop("__k", "__n")


def selected(df: DataFrame, key: str, chosen: list[str]) -> DataFrame:
    """Rows chosen by the text they show; no choice means all: F12."""
    return df.where(F.col(key).isin(chosen)) if chosen else df


def without_banned(items: Column, banned: str) -> Column:
    """An array without the elements that match: F15."""
    return F.filter(items, lambda x: x.isNotNull() & ~x.rlike("(?i)" + banned))


def first_not_empty(*columns: Column) -> Column:
    """The first value that is neither null nor empty: F20."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def strict_argmax(df: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """The first row with the highest score of each group, in the old order: F13."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), position)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def compared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys with what is missing on which side: J19."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, keys, "full")
    return both.select(*keys, F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").otherwise("same").alias("verdict"))


def raised(df: DataFrame, truth: DataFrame, key: str, score: str, least: float) -> DataFrame:
    """Scores of rows that the truth names raised to at least `least`; rows only the truth has are
    added with it: V21."""
    named = truth.select(key).distinct().withColumn("__t", F.lit(True))
    joined = df.join(named, key, "full")
    return joined.withColumn(score, F.when(F.col("__t"), F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(least))).otherwise(F.col(score))).drop("__t")


def title_score(title: Column, tokens: list[str], core: str) -> Column:
    """Twelve for the core phrase, two a token: V23."""
    low = F.lower(title)
    return F.when(low.contains(core), 12).otherwise(0) + sum((F.when(low.contains(t), 2).otherwise(0) for t in tokens), F.lit(0))


def rank_boost(rank: Column, in_set: Column, outcome: Column) -> Column:
    """A rank raised for members of a set and, above them, for outcomes: V26."""
    return F.greatest(rank, F.when(in_set, 1e6).otherwise(0.0), F.when(outcome, 2e6).otherwise(0.0))
