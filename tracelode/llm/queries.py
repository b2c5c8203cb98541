"""Queries over texts, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.contamination import find_leaks
from tracelode.llm.packing import pack, token_counts
from tracelode.llm.splitting import split_oversized, trimmed
from tracelode.llm.toxicity import THRESHOLD, score_texts
from tracelode.llm.truncation import find_truncated
from tracelode.tables import table

SECTION_LIMIT, SECTION_OVERLAP = 2000, 200
CONTAINER = 2048


def _section_text() -> Column:
    lines = F.concat_ws("\n", F.filter("content_lines", lambda x: x.isNotNull()))
    head = F.concat(F.coalesce("section_id", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\n"))
    return trimmed(F.concat(head, F.coalesce(lines, F.lit(""))))


def _cut_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fix_suggestions")
    named = [F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in (("error_text", F.col("error_text")), ("reason", F.col("fix_suggestion.reason")))]
    values = rows.select("suggestion_id", "source", F.explode(F.array(*named)).alias("v")).select("suggestion_id", "source", "v.name", "v.value")
    return find_truncated(values, ["suggestion_id"], "source", "value", F.col("name")).withColumnRenamed("field", "field_name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that end before their author or program did."""
    return _cut_values(spark, folder).where("cut").select("suggestion_id", "field_name").distinct()


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source delivers cut values, by field; of repeated deliveries that name
    several sources the last in the alphabet counts."""
    values = _cut_values(spark, folder).groupBy("suggestion_id", "field_name").agg(F.max("source").alias("source"), F.max("cut").alias("cut"))
    return values.groupBy("field_name", F.coalesce("source", F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate")
    )


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every oversized section, with its pages in order."""
    return split_oversized(
        table(spark, folder, "section_nodes"),
        "section_key",
        _section_text(),
        SECTION_LIMIT,
        SECTION_OVERLAP,
        keep={"page_numbers": F.array_sort("page_numbers")},
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sections that had to be cut."""
    return p6_pieces(spark, folder).select("section_key").distinct()


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or part of an oversized one, in its container."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", F.col("text"))
    return pack(sizes, "doc_id", CONTAINER)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of space left unused."""
    filled = p7_packed(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    return filled.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("k").alias("n_items"),
        F.sum("n").alias("n_tokens"),
        F.max("n").alias("fullest"),
        (1 - F.sum("n") / (F.count(F.lit(1)) * CONTAINER)).alias("unused"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of document and leaked benchmark item."""
    return find_leaks(table(spark, folder, "documents"), "doc_id", F.col("text"), table(spark, folder, "benchmark"), "item_id", F.col("text"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it, by suite."""
    suites = table(spark, folder, "benchmark").select("item_id", "suite").distinct()
    counts = p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return suites.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score."""
    return score_texts(table(spark, folder, "documents"), "doc_id", F.col("text"), keep=["source"])


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are abusive, hateful or sexually explicit."""
    return p9_scores(spark, folder).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the share of abusive ones for each source."""
    return (
        p9_scores(spark, folder)
        .groupBy(F.coalesce("source", F.lit("")).alias("source"))
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.count_if(F.col("score") >= THRESHOLD).alias("n_abusive"),
            F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("rate"),
        )
    )


QUERIES = {q.__name__: q for q in (p3_found, p3_rates, p6_found, p6_pieces, p7_packed, p7_fill, p8_found, p8_items, p9_found, p9_scores, p9_rates)}
ORACLE: dict[str, str] = {
    "p6_found": r"""
        WITH t AS (
            SELECT section_key, coalesce(section_id, '') || ' ' || coalesce(title, '') || chr(10)
                || coalesce(array_to_string(list_filter(content_lines, lambda x: x IS NOT NULL), chr(10)), '') AS text
            FROM section_nodes
        )
        SELECT DISTINCT section_key FROM t
        WHERE length(regexp_replace(text, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+$', '', 'g')) > 2000
    """,
}
