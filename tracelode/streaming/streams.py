"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.state import status_rank
from tracelode.session import checkpoint_dir

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string, corrupt string"


def ndjson_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """ST2: lines of JSON as a stream; blank lines are skipped, lines that cannot be read keep
    their text in `corrupt` and are not lost."""
    lines = spark.readStream.text(folder).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return lines.select(parsed.alias("e")).select("e.*")


def status_stream(events: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """ST4: highest-ranked, then latest status of each key as a streaming aggregate."""
    best = F.max(F.struct(status_rank(F.col(status)).alias("rank"), F.col(order).alias("at"), F.col(status).alias("status")))
    return events.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.status", "m.at")


def window_counts(events: DataFrame, at: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts of tumbling windows behind a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, at: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Counts of sessions that end after a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its result.

    Offsets and state lie in the shared folder (ST3): a restart goes on where it stopped.  In
    complete mode each batch replaces the result, otherwise batches are appended under their
    number, so that a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    out = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        target = f"{out}/data" if mode == "complete" else f"{out}/data/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/data")
    return rows


def sync_on_arrival(stream: DataFrame, table_path: str, key: str, checkpoint: str):
    """ST7, ST8: each batch adds the rows whose key is not in the table yet; starts the query.

    A batch is written under its number, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(table_path).where(F.col("batch") != number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except Exception as none_yet:  # the table is made by the first batch
            if "PATH_NOT_FOUND" not in str(none_yet) and "UNABLE_TO_INFER_SCHEMA" not in str(none_yet):
                raise
        fresh.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
