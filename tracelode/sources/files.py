"""Files as tables: listing, routing by kind, newest file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of file by ending.
KINDS = {"c": ["c", "h"], "conf": ["conf", "cfg"], "json": ["json"], "cmake": ["cmake"], "text": ["txt", "log", "out", "md"]}
# Folders that hold no sources.
EXCLUDED = ["/.git/", "/build/", "/node_modules/", "/__pycache__/"]


def list_files(spark: SparkSession, root: str, endings: list[str], folders: list[str] | None = None) -> DataFrame:
    """(path, length, modified): S1; files below root by ending, each once, contents not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    kept = found.where(F.lower("path").rlike(r"\.(" + "|".join(endings) + ")$"))
    for folder in EXCLUDED:
        kept = kept.where(~F.col("path").contains(folder))
    if folders:
        kept = kept.where(F.col("path").rlike("/(" + "|".join(folders) + ")/"))
    return kept.distinct()


def read_texts(spark: SparkSession, root: str, endings: list[str]) -> DataFrame:
    """(path, kind, text): S7; whole files by ending with their kind."""
    glob = "*.{" + ",".join(endings) + "}"
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = None
    for name, ends in KINDS.items():
        kind = F.when(ending.isin(ends), name) if kind is None else kind.when(ending.isin(ends), name)
    return text.withColumn("kind", kind)


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """The newest file of each key; of equal times the last by path: S30."""
    w = Window.partitionBy(*keys).orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
