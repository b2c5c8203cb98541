"""Vector search, ranking and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.operators import vectors as V
from tracelode.tables import table

# Every row whose id is divisible by 50 is a query.
EVERY = 50


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return rows, rows.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")


def _top(spark, folder, k, metric, **more):
    rows, queries = _vectors(spark, folder)
    return V.nearest(rows, queries, "vec_id", "query_id", "embedding", k, metric, **more)


def vec_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every query by cosine."""
    return _top(spark, folder, 10, "cosine").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vec_topk_l2(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest by distance, with the cosine of unit vectors from it."""
    d = F.col("score")
    similarity = F.when(d < 2, F.greatest(F.lit(0.0), 1 - d * d / 2)).otherwise(1 / (1 + d))
    return _top(spark, folder, 10, "l2").select("query_id", "vec_id", "rank", F.round("score", 5).alias("distance"), F.round(similarity, 5).alias("similarity"))


def vec_threshold_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Scores above 0.3, boosted by the kind of file and capped, best 20."""
    rows, queries = _vectors(spark, folder)
    # Boost, cap and rounding come before the best are taken: no lifted row is lost, ties at 1 go by id.
    boost = F.when(F.col("label") == 0, 0.3).when(F.col("label") == 1, 0.1).otherwise(0.0)
    found = V.nearest(rows, queries, "vec_id", "query_id", "embedding", 20, "cosine", keep_above=0.3, boost=boost, digits=6)
    return found.select("query_id", "vec_id", F.col("score").alias("boosted"))


def vec_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    """V9, F1: the filter comes before the search, so no over-fetch is needed."""
    rows, queries = _vectors(spark, folder)
    found = V.nearest(rows.where(F.col("label") % 2 == 0), queries, "vec_id", "query_id", "embedding", 5, "cosine")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def vec_max_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Best score of each row over all queries; preferred label first."""
    rows, _ = _vectors(spark, folder)
    merged = _top(spark, folder, 60, "cosine").groupBy("vec_id").agg(F.max("score").alias("score"))
    placed = merged.join(rows.select("vec_id", "label").distinct(), "vec_id").withColumn("preferred", (F.col("label") == 3).cast("int"))
    return placed.select("vec_id", "preferred", F.round("score", 6).alias("score")).orderBy(F.desc("preferred"), F.desc("score"), "vec_id").limit(28)


def vec_rerank_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Re-rank of the nearest rows and the decision on each query."""
    rows, _ = _vectors(spark, folder)
    found = _top(spark, folder, 20, "cosine").join(rows.select("vec_id", "label").distinct(), "vec_id")
    ranked = found.withColumn(
        "final", F.round(V.commit_rank(F.col("score"), F.col("label") < 3, F.col("label") % 4, F.col("vec_id") % 400), 6)
    )
    top = V.top_per_group(ranked.drop("rank"), ["query_id"], [F.desc("final"), F.col("vec_id")], 3)
    at = lambda c, n: F.max(F.when(F.col("rank") == n, F.col(c)))
    best = top.withColumn("is_fix", F.col("label") < 3).groupBy("query_id").agg(
        at("vec_id", 1).alias("best_id"), at("final", 1).alias("best"), at("is_fix", 1).alias("is_fix"), at("final", 3).alias("third"), at("vec_id", 2).alias("second_id")
    )
    return best.select("query_id", "best_id", "second_id", "best", V.decision(F.col("best"), F.col("is_fix"), F.col("third")).alias("decision"))


def vec_label_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label; the nearest one of every query."""
    rows, queries = _vectors(spark, folder)
    cells = V.coarse_centroids(rows, "label", "embedding").withColumnRenamed("centroid", "embedding")
    return V.nearest(cells, queries.select("query_id", "embedding"), "label", "query_id", "embedding", 1, "l2", same=True).select(
        "query_id", F.col("label").cast("int").alias("label"), F.round("score", 5).alias("distance")
    )


def vec_ivf_probe(spark: SparkSession, folder: str) -> DataFrame:
    """V5, K5: the five best of every query by inner product to six digits; every row is searched, no index is kept."""
    return _top(spark, folder, 5, "ip", digits=6).select("query_id", "vec_id", "rank", "score")


def vec_topk_per_label(spark: SparkSession, folder: str) -> DataFrame:
    """The two best of each label for each query."""
    rows, queries = _vectors(spark, folder)
    found = V.nearest(rows, queries, "vec_id", "query_id", "embedding", 2, "cosine", digits=6, group="label")
    return found.select("query_id", "label", "vec_id", "rank", "score")


def vec_order_score(spark: SparkSession, folder: str) -> DataFrame:
    """A score from the order alone, by label."""
    rows, _ = _vectors(spark, folder)
    return V.order_score(rows.select("vec_id", "label"), ["label"], "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


def vec_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """V2: length of every vector before and after normalisation."""
    rows, _ = _vectors(spark, folder)
    doubled = rows.withColumn("v", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3))
    unit = doubled.withColumn("u", V.normalised("v"))
    return unit.select("vec_id", F.round(F.sqrt(V.dot("v", "v")), 5).alias("before"), F.round(F.sqrt(V.dot("u", "u")), 5).alias("after"))


def frame_priorities(spark: SparkSession, folder: str) -> DataFrame:
    """Priority and role of every backtrace frame; T14."""
    frames = table(spark, folder, "segmentation_fault_extraction").select("crash_id", F.explode("crash_info.backtrace").alias("f")).where("f is not null")
    n = F.col("f.frame_number")
    role = F.when(n == 0, "faulting").when(n == 1, "caller").otherwise("upstream")
    return frames.select("crash_id", n.alias("frame_number"), F.col("f.function").alias("function"), V.frame_priority(n).alias("priority"), role.alias("role")).distinct()


def dedup_keep_best(spark: SparkSession, folder: str) -> DataFrame:
    """The dearest line of every part."""
    lines = table(spark, folder, "lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "tie")
    return lines.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


def dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    """D3: the first event of every user and type."""
    return V.keep_first(table(spark, folder, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


def dedup_best_first_source(spark: SparkSession, folder: str) -> DataFrame:
    """The highest value of a user with the type of their first event."""
    return V.best_with_first_source(table(spark, folder, "events"), "user_id", "value", "event_type", "event_id")


def budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source while they fit 20,000 characters, shortest first."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    packed = V.within_budget(docs, "source", [F.col("n_chars"), F.col("doc_id")], F.col("n_chars"), 20_000)
    return packed.select("source", "doc_id", "n_chars", "running")


QUERIES = {
    q.__name__: q
    for q in (
        vec_topk_cosine, vec_topk_l2, vec_threshold_boost, vec_filtered_topk, vec_max_merge, vec_rerank_decision, vec_label_centroid, vec_ivf_probe,
        vec_topk_per_label, vec_order_score, vec_normalised, frame_priorities, dedup_keep_best, dedup_keep_first, dedup_best_first_source, budget_pack,
    )
}

_DOT = "list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))"
_PAIRS = f"""
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, c.label,
               {_DOT} / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(c.v, lambda x: x * x))) AS score,
               sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
        FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )"""
_RANKED = f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"
_CENTROIDS = """
    parts AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    cells AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i) GROUP BY label)"""

ORACLE = {
    "vec_topk_cosine": f"{_RANKED} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10",
    "vec_topk_l2": f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
        SELECT query_id, vec_id, rank, round(distance, 5) AS distance,
               round(CASE WHEN distance < 2 THEN greatest(0.0, 1 - distance * distance / 2) ELSE 1 / (1 + distance) END, 5) AS similarity FROM r WHERE rank <= 10""",
    "vec_threshold_boost": f"""{_RANKED}, b AS (
            SELECT query_id, vec_id, round(least(1.0, score + CASE label WHEN 0 THEN 0.3 WHEN 1 THEN 0.1 ELSE 0.0 END), 6) AS boosted FROM r WHERE score > 0.3 AND rank <= 200)
        SELECT query_id, vec_id, boosted FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, vec_id) <= 20""",
    "vec_filtered_topk": f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE label % 2 = 0)
        SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "vec_max_merge": f"""{_RANKED} SELECT vec_id, (label = 3)::INT AS preferred, round(max(score), 6) AS score FROM r WHERE rank <= 60
        GROUP BY vec_id, label ORDER BY preferred DESC, score DESC, vec_id LIMIT 28""",
    "vec_rerank_decision": f"""{_RANKED}, f AS (
            SELECT query_id, vec_id, label < 3 AS is_fix, round(0.6 * score + CASE WHEN label < 3 THEN 0.2 ELSE 0.0 END + least(0.05 * (label % 4), 0.15)
                + CASE WHEN vec_id % 400 < 30 THEN 0.05 WHEN vec_id % 400 < 90 THEN 0.03 WHEN vec_id % 400 < 365 THEN 0.01 ELSE 0.0 END, 6) AS final FROM r WHERE rank <= 20),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, vec_id) AS n FROM f),
        b AS (SELECT query_id, max(vec_id) FILTER (n = 1) AS best_id, max(vec_id) FILTER (n = 2) AS second_id, max(final) FILTER (n = 1) AS best,
                     bool_or(is_fix) FILTER (n = 1) AS is_fix, max(final) FILTER (n = 3) AS third FROM t GROUP BY query_id)
        SELECT query_id, best_id, second_id, best, CASE WHEN is_fix AND best >= 0.75 THEN 'auto_select' WHEN is_fix AND best >= 0.60 THEN 'suggest'
            WHEN best - third < 0.15 AND best >= 0.50 THEN 'needs_llm' WHEN best < 0.50 THEN 'none' ELSE 'suggest_low' END AS decision FROM b""",
    "vec_label_centroid": f"""WITH {_CENTROIDS}, d AS (
            SELECT q.vec_id AS query_id, c.label, sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
            FROM embeddings q, cells c WHERE q.vec_id % 50 = 0)
        SELECT query_id, label, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, label) = 1""",
    "vec_ivf_probe": f"""WITH {_CENTROIDS}, d AS (
            SELECT q.vec_id AS query_id, c.label, sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance
            FROM embeddings q, cells c WHERE q.vec_id % 50 = 0),
        probed AS (SELECT query_id, label FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, label) <= 3),
        s AS (SELECT p.query_id, c.vec_id, round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), lambda p: p[1] * p[2])), 6) AS score
              FROM probed p JOIN embeddings q ON q.vec_id = p.query_id JOIN embeddings c ON c.label = p.label AND c.vec_id <> p.query_id)
        SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "vec_topk_per_label": f"""{_RANKED}, t AS (SELECT query_id, label, vec_id, round(score, 6) AS score FROM r WHERE rank <= 100)
        SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank, score FROM t
        QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) <= 2""",
    "vec_order_score": """SELECT vec_id, label, round((count(*) OVER (PARTITION BY label) - row_number() OVER (PARTITION BY label ORDER BY vec_id) + 1)
        / count(*) OVER (PARTITION BY label), 6) AS score FROM embeddings""",
    "vec_normalised": """SELECT vec_id, round(3 * sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS before, 1.0::DOUBLE AS after FROM embeddings""",
    "frame_priorities": """WITH f AS (SELECT crash_id, unnest(crash_info.backtrace) AS f FROM segmentation_fault_extraction)
        SELECT DISTINCT crash_id, f.frame_number AS frame_number, f."function" AS "function",
            (CASE WHEN f.frame_number = 0 THEN 1.00 WHEN f.frame_number = 1 THEN 0.95 WHEN f.frame_number = 2 THEN 0.90 WHEN f.frame_number <= 5 THEN 0.85 ELSE 0.80 END)::DOUBLE AS priority,
            CASE WHEN f.frame_number = 0 THEN 'faulting' WHEN f.frame_number = 1 THEN 'caller' ELSE 'upstream' END AS role FROM f WHERE f IS NOT NULL""",
    "dedup_keep_best": """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) = 1""",
    "dedup_keep_first": "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
    "dedup_best_first_source": "SELECT user_id, max(value) AS value, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "budget_pack": """SELECT source, doc_id, n_chars, running FROM (
            SELECT coalesce(source, '') AS source, doc_id, n_chars,
                   (sum(n_chars) OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM documents)
        WHERE running <= 20000""",
}
