"""Vector search and ranking over array<float> columns.

Search is exact: corpus and queries are cut into blocks, every pair of blocks is one matrix
product, and the best of each are merged.  No pair of rows is ever a row of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORPUS_BLOCK, QUERY_BLOCK = 20_000, 2_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; null where a side is null."""
    double = lambda x: (F.col(x) if isinstance(x, str) else x).cast("array<double>")
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    size = F.sqrt(dot(v, v))
    double = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    return F.when(size > 0, F.transform(double, lambda x: x / size)).otherwise(double)


def _blocks(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def nearest(
    corpus: DataFrame, queries: DataFrame, corpus_id: str, query_id: str, vector: str, k: int, metric: str = "cosine",
    corpus_rows: int | None = None, query_rows: int | None = None, keep_above: float | None = None, same: bool = False,
    boost: Column | None = None, digits: int | None = None, group: str | None = None,
) -> DataFrame:
    """(query_id, corpus_id, score): the k best corpus rows of every query.

    metric is cosine (higher is better), ip or l2 (lower is better, a true distance).  Ties go
    to the smaller corpus id.  Rows without a vector or an id are left out.  keep_above drops weaker
    scores before the k best are taken; same keeps a row's match with its own id.  boost, a number of
    each corpus row, is then added to the score, 1 at most in all, and digits rounds it, both before
    the k best are taken.  group, a column of corpus, gives the k best of each of its values instead,
    null being one; it stands in the result.
    """
    nc = _blocks(corpus.count() if corpus_rows is None else corpus_rows, CORPUS_BLOCK)
    nq = _blocks(queries.count() if query_rows is None else query_rows, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (
        corpus.where(F.col(vector).isNotNull() & F.col(corpus_id).isNotNull())
        .select(F.col(corpus_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.lit(0.0) if boost is None else boost).cast("double").alias("b"), (F.lit("") if group is None else F.col(group).cast("string")).alias("g"))
        .withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(nc)).cast("int"))
        .withColumn("qb", every(nq))
    )
    right = (
        queries.where(F.col(vector).isNotNull() & F.col(query_id).isNotNull())
        .select(F.col(query_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int"))
        .withColumn("cb", every(nc))
    )
    lower, boosted = metric == "l2", boost is not None

    def first(usable: np.ndarray, row: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(usable) > k:
            kth = np.partition(row[usable], len(usable) - k)[len(usable) - k]
            usable = usable[row[usable] >= kth]
            # Many may share the capped score; the smaller ids come first.
            usable = usable[np.lexsort((ids[usable], -row[usable]))[:k]]
        return usable

    def best(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"q": [], "c": [], "score": [], "g": []}).astype({"q": "int64", "c": "int64", "score": "float64", "g": "object"})
        ids, qids = c["id"].to_numpy(), q["id"].to_numpy()
        extra = c["b"].to_numpy()
        values, members = c["g"].to_numpy(), [np.asarray(m) for m in c.groupby("g", dropna=False, sort=False).indices.values()] if group else []
        a, b = np.stack(c["v"].to_numpy()), np.stack(q["v"].to_numpy())
        if metric == "cosine":
            a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
            b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        s = b @ a.T
        if lower:
            s = -np.sqrt(np.maximum((b * b).sum(1)[:, None] + (a * a).sum(1)[None, :] - 2 * s, 0))
        out = []
        for i, qid in enumerate(qids):
            row = s[i]
            usable = np.arange(len(ids)) if same else np.flatnonzero(ids != qid)
            if keep_above is not None:
                usable = usable[row[usable] > keep_above]
            if boosted:
                row = np.minimum(1.0, row + extra)
            if digits is not None:
                row = np.round(row, digits)
            if group:
                fit = np.zeros(len(ids), bool)
                fit[usable] = True
                usable = np.concatenate([first(m[fit[m]], row, ids) for m in members])
            else:
                usable = first(usable, row, ids)
            out.append(pd.DataFrame({"q": qid, "c": ids[usable], "score": row[usable], "g": values[usable]}))
        return pd.concat(out)

    part = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(best, "q long, c long, score double, g string")
    place = Window.partitionBy("q", "g").orderBy(F.desc("score"), "c")
    named = [F.col("g").cast(corpus.schema[group].dataType).alias(group)] if group else []
    return (
        part.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), *named, F.col("c").alias(corpus_id), (-F.col("score") if lower else F.col("score")).alias("score"), "rank")
    )


def nearest_sparse(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, k: int, keep_above: float, digits: int = 6) -> DataFrame:
    """(query_id, row_id, score, rank): the k best rows of every query by the inner product of
    sparse vectors (columns terms, weights), rounded to digits, above keep_above.

    Rows and queries are cut into blocks as in nearest; within a pair of blocks the postings of
    the queries are added up term by term, so no row of a shared term is ever listed.  A row is
    not its own match; ties go to the smaller row id; rows without terms match nothing.
    """
    nc, nq = _blocks(rows.count(), CORPUS_BLOCK), _blocks(queries.count(), QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.col(row_id).cast("long").alias("id"), "terms", "weights").withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(nc * 8)).cast("int")).withColumn("qb", every(nq))
    # Fresh names: queries may come from rows themselves.
    right = queries.select(F.col(query_id).cast("long").alias("id"), F.col("terms").alias("terms"), F.col("weights").alias("weights")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("cb", every(nc * 8))

    def best(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        postings: dict[str, tuple[list, list]] = {}
        for i, (terms, weights) in enumerate(zip(q["terms"], q["weights"])):
            for t, w in zip(terms, weights):
                places, values = postings.setdefault(t, ([], []))
                places.append(i)
                values.append(w)
        packed = {t: (np.array(a), np.array(b)) for t, (a, b) in postings.items()}
        qids = q["id"].to_numpy()
        out: list[list[tuple[float, int]]] = [[] for _ in qids]
        for own, terms, weights in zip(c["id"], c["terms"], c["weights"]):
            total = np.zeros(len(qids))
            for t, w in zip(terms, weights):
                if (hit := packed.get(t)) is not None:
                    total[hit[0]] += w * hit[1]
            total = np.round(total, digits)
            for i in np.flatnonzero(total > keep_above):
                if qids[i] != own:
                    out[i].append((-total[i], own))
        rows_out = [(int(qids[i]), int(own), float(-s)) for i, found in enumerate(out) for s, own in heapq.nsmallest(k, found)]
        return pd.DataFrame(rows_out, columns=["q", "c", "score"]).astype({"q": "int64", "c": "int64", "score": "float64"})

    part = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(best, "q long, c long, score double")
    place = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return part.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("c").alias(row_id), "score", "rank")


def coarse_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector of each label."""
    parts = df.where(F.col(vector).isNotNull()).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def keep_best(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """One row for each key: the highest score, of equal ones the smallest tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row for each key: the first by position."""
    w = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def best_with_first_source(df: DataFrame, key: str, score: str, source: str, position: str) -> DataFrame:
    """Highest score of each key, but the source that named the key first."""
    return df.groupBy(key).agg(F.max(score).alias(score), F.min_by(source, position).alias(source))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in the given order, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def anchor_boost(text: Column, anchors: list[str], file_boost: Column, base: Column) -> Column:
    """base plus file_boost plus 0.1 an anchor with a word of over three letters in text, 0.2 at
    most; 1 at most in all."""
    low = F.lower(text)
    hit = lambda a: F.lit(any(len(w) > 3 for w in a.split())) & (
        F.greatest(*[low.contains(w.lower()).cast("int") for w in [*a.split(), ""] if len(w) > 3], F.lit(0)) == 1
    )
    matches = sum((hit(a).cast("int") for a in anchors), F.lit(0))
    return F.least(F.lit(1.0), base + file_boost + F.least(F.lit(0.2), matches * 0.1))


def commit_rank(similarity: Column, is_fix: Column, overlap: Column, age_days: Column) -> Column:
    """Re-rank of a commit: similarity, kind, shared keywords and age."""
    recency = F.when(age_days < 30, 0.05).when(age_days < 90, 0.03).when(age_days < 365, 0.01).otherwise(0.0)
    return 0.6 * similarity + F.when(is_fix, 0.2).otherwise(0.0) + F.least(0.05 * overlap, F.lit(0.15)) + recency


def decision(best: Column, is_fix: Column, third: Column) -> Column:
    """What to do with the best candidate, from its score, kind and the spread to the third."""
    return (
        F.when(is_fix & (best >= 0.75), "auto_select")
        .when(is_fix & (best >= 0.60), "suggest")
        .when((best - third < 0.15) & (best >= 0.50), "needs_llm")
        .when(best < 0.50, "none")
        .otherwise("suggest_low")
    )


def frame_priority(frame: Column) -> Column:
    """Priority of a backtrace frame by its number."""
    return F.when(frame == 0, 1.00).when(frame == 1, 0.95).when(frame == 2, 0.90).when(frame <= 5, 0.85).otherwise(0.80)


def order_score(df: DataFrame, keys: list[str], position: str, name: str = "score") -> DataFrame:
    """(n - i) / n by order, for lists without a score of their own."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, (F.count(F.lit(1)).over(w) - F.row_number().over(w.orderBy(position)) + 1) / F.count(F.lit(1)).over(w))


def within_budget(df: DataFrame, source: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows of each source, in order, while their sizes sum to at most budget."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


Metric = Callable[[Column, Column], Column]
