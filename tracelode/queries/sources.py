"""Parsers over the text tables, and streams over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions import scalars as C
from tracelode.operators import parsers as P
from tracelode.queries.relations import EVENT_STATUS
from tracelode.streaming import streams as ST
from tracelode.tables import table


def conf_settings(spark: SparkSession, folder: str) -> DataFrame:
    """All settings in configuration notes."""
    notes = table(spark, folder, "documents").where("doc_type = 'config_note'").select("doc_id", "text")
    return P.conf_params(notes, ["doc_id"], "text").select("doc_id", "line_no", "name", "value")


def code_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Functions in code documents."""
    code = table(spark, folder, "documents").where("doc_type = 'code_comment'").select("doc_id", "text")
    got = P.c_entities(code, ["doc_id"], "text")
    return got.select("doc_id", "kind", "name", "start_line", "end_line", F.size(P.local_names(F.col("body"), None)).alias("n_locals"))


def code_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in code that name a known function, as edges from the document."""
    docs = table(spark, folder, "documents").where("doc_type = 'code_comment'").select("doc_id", "text")
    known = table(spark, folder, "segmentation_fault_extraction").select(F.explode("crash_info.backtrace.function").alias("name")).where("name is not null").distinct()
    named = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z0-9]+(?:_[a-z0-9]+)+) *[(]"), 1))).alias("name"))
    return named.join(known, "name", "left_semi").select("doc_id", "name")


def asn1_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Definitions in sections with their length in lines."""
    rows = table(spark, folder, "section_nodes").select("section_key", F.array_join("content_lines", "\n").alias("text")).dropDuplicates(["section_key"])
    got = P.asn1_blocks(rows, ["section_key"], "text")
    return got.select("section_key", "name", "first_line", "n_lines")


def crash_scans(spark: SparkSession, folder: str) -> DataFrame:
    """The first signal of each error text."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text").distinct()
    return P.crash_scan(rows, ["suggestion_id"], "error_text").select("suggestion_id", "signal", "crash_line", "n_before")


def compiler_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions of the compiler: what was written and what it proposes."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text").distinct()
    return rows.select("suggestion_id", F.explode(C.did_you_mean(F.col("error_text"))).alias("h")).select("suggestion_id", "h.wrong", "h.suggested")


def type_names(spark: SparkSession, folder: str) -> DataFrame:
    """Type names made of message names, with their spellings counted."""
    rows = table(spark, folder, "segmentation_fault_extraction").select(F.explode("crash_info.scenario_flow").alias("s")).where("s is not null")
    name = F.regexp_replace("s", " [a-z]+$", "")
    return rows.select(name.alias("message")).distinct().select("message", C.ie_type_name(F.col("message")).alias("type_name"), C.bare_token(F.col("message")).alias("token"))


def _as_json(spark: SparkSession, folder: str) -> str:
    """The events as lines of JSON in the shared folder, with a line that cannot be read."""
    path = ST.shared_path(spark, "events-json")
    rows = table(spark, folder, "events").select(F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props")).alias("value"))
    rows.unionByName(spark.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return path


def stream_ndjson(spark: SparkSession, folder: str) -> DataFrame:
    """ST1, ST2: events read as a stream of lines; unreadable ones counted apart."""
    events = ST.ndjson_events(spark, _as_json(spark, folder))
    kind = F.when(F.col("corrupt").isNotNull(), "unreadable").otherwise(F.col("event_type"))
    return ST.run_available(events.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")), "ndjson", "complete")


def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    """ST4, ST6: the status merge as a stream; equals status_merge."""
    events = ST.ndjson_events(spark, _as_json(spark, folder)).where("corrupt is null")
    status = None
    for kind, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == kind, name) if status is None else status.when(F.col("event_type") == kind, name)
    merged = ST.status_stream(events.withColumn("status", status).withColumn("milestone", F.col("event_id") % 3), ["user_id", "milestone"], "status", "event_id")
    return ST.run_available(merged.withColumnRenamed("at", "event_id"), "status", "complete")


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts by type from the stream."""
    events = ST.ndjson_events(spark, _as_json(spark, folder)).where("corrupt is null")
    counts = ST.window_counts(events, "ts", "1 day", "1 hour", ["event_type"])
    return ST.run_available(counts, "windows", "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {q.__name__: q for q in (conf_settings, code_functions, code_identifiers, asn1_definitions, crash_scans, compiler_hints, type_names, stream_ndjson, stream_status, stream_windows)}

_STATUS = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END"
ORACLE = {
    "conf_settings": r"""WITH l AS (SELECT doc_id, trim(unnest(parts)) AS line, generate_subscripts(parts, 1) AS line_no FROM (SELECT doc_id, string_split(replace(regexp_replace(text, '\x1b\[[0-9;]*m', '', 'g'), chr(13), ''), chr(10)) AS parts FROM documents WHERE doc_type = 'config_note')),
        p AS (SELECT doc_id, line_no, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.-]*)\s*[=:]\s*(.*)$', ['name', 'value']) AS m FROM l WHERE NOT regexp_matches(line, '^(#|//|;)'))
        SELECT doc_id, line_no, m.name AS name, trim(regexp_replace(m.value, '\s+[#;].*$', '')) AS value FROM p WHERE regexp_matches(m.name, '^[a-z0-9]+_(port|timer_ms|log_level)$')""",
    "code_identifiers": """WITH k AS (SELECT DISTINCT b."function" AS name FROM (SELECT unnest(crash_info.backtrace) AS b FROM segmentation_fault_extraction)),
        n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([a-z0-9]+(?:_[a-z0-9]+)+) *[(]', 1)) AS name FROM documents WHERE doc_type = 'code_comment')
        SELECT doc_id, name FROM n WHERE name IN (SELECT name FROM k WHERE name IS NOT NULL)""",
    "compiler_hints": """WITH e AS (SELECT DISTINCT suggestion_id, error_text FROM fix_suggestions),
        h AS (SELECT suggestion_id, unnest(regexp_extract_all(error_text, '[‘'']([^’'']+)[’''][^\n]*?did you mean [‘'']([^’'']+)[’'']', 1)) AS wrong, unnest(regexp_extract_all(error_text, '[‘'']([^’'']+)[’''][^\n]*?did you mean [‘'']([^’'']+)[’'']', 2)) AS suggested FROM e)
        SELECT suggestion_id, wrong, suggested FROM h""",
    "type_names": """WITH s AS (SELECT DISTINCT regexp_replace(s, ' [a-z]+$', '') AS message FROM (SELECT unnest(crash_info.scenario_flow) AS s FROM segmentation_fault_extraction) WHERE s IS NOT NULL)
        SELECT message, array_to_string(list_transform(string_split(message, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || 'IEs' AS type_name, regexp_replace(lower(message), '[^a-z0-9]+', '', 'g') AS token FROM s""",
    "stream_ndjson": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'unreadable', 1",
    "stream_status": f"""SELECT user_id, event_id % 3 AS milestone, event_id, CASE {_STATUS} WHEN 0 THEN 'not_completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'failed' END AS status
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY {_STATUS} DESC, event_id DESC) = 1""",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
