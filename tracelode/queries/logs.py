"""Log entries of raw files and of error texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.logs import layouts, mine, parse_logs
from tracelode.operators.skew import spread
from tracelode.tables import table


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "rca_logs").select(F.lit("rca_logs").alias("src_table"), F.col("file_id").cast("string").alias("row_id"), F.col("log_text").alias("text"))
    fixes = table(spark, folder, "fix_suggestions").select(F.lit("fix_suggestions").alias("src_table"), F.col("suggestion_id").cast("string").alias("row_id"), F.col("error_text").alias("text"))
    return spread(files.unionByName(fixes), "row_id")


def _entries(spark: SparkSession, folder: str, messages: bool) -> DataFrame:
    texts = _texts(spark, folder)
    patterns = layouts(mine(texts))
    keyed = texts.withColumn("key", F.concat_ws(":", "src_table", "row_id"))
    found = parse_logs(keyed, "key", F.col("text"), patterns, messages)
    table_of, row_of = (F.split("row_id", ":", 2)[i] for i in (0, 1))
    return found.select(table_of.alias("src_table"), row_of.alias("row_id"), *found.columns[1:])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each log entry, by the header shapes found in the same texts."""
    return _entries(spark, folder, messages=False).distinct()


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries with their messages, further lines kept; of repeated deliveries one."""
    return _entries(spark, folder, messages=True).dropDuplicates(["src_table", "row_id", "first_line"])


def p1_templates(spark: SparkSession, folder: str) -> DataFrame:
    """The mined templates: tokens, slots of the header and support."""
    found = mine(_texts(spark, folder))
    rows = [(i, " ".join(f"<{p[2]}>" if p[2] in ("ts", "level", "component") else p[3] or p[0] for p in parts), cut, int(n)) for i, (cut, parts, n) in enumerate(found)]
    return spark.createDataFrame(rows, "template_id int, template string, header_tokens int, support long")


def p1_level_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by table, component and level."""
    return p1_found(spark, folder).groupBy("src_table", "component", "log_level").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (p1_found, p1_entries, p1_templates, p1_level_counts)}
