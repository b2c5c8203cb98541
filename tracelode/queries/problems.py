"""The general data problems: pN queries over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.nesting import contained, node_table
from tracelode.operators.references import Reference, orphan_references
from tracelode.operators.timestamps import to_instants
from tracelode.tables import table

# Where a row without a site counts as written.  A site that the table of sites lacks
# gets the zone only: its order is not declared, and the path decides it.
DEFAULT_ZONE, DEFAULT_ORDER = "Asia/Kolkata", "dmy"

REFERENCES = [
    Reference("agent_runs", "agent_run_id", ["stage_run_id"], "stage_runs", ["stage_run_id"]),
    Reference("stage_runs", "stage_run_id", ["session_id"], "sessions", ["session_id"]),
    Reference("code_validations", "validation_id", ["session_id"], "sessions", ["session_id"]),
]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose reference finds no live target that came first."""
    log = table(spark, folder, "purge_log")
    found = [
        orphan_references(table(spark, folder, r.table), table(spark, folder, r.target), r, log) for r in REFERENCES
    ]
    return reduce(DataFrame.unionByName, found).select("src_table", "row_id")


def p2_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans by table, month of created_at (UTC) and reason, beside all rows of that month."""
    log = table(spark, folder, "purge_log")
    parts = []
    for r in REFERENCES:
        rows = table(spark, folder, r.table)
        found = orphan_references(rows, table(spark, folder, r.target), r, log)
        month = F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM")
        months = rows.groupBy(F.col(r.row_id).alias("row_id")).agg(F.min(F.coalesce(month, F.lit("unknown"))).alias("month"))
        parts.append(
            months.join(found.drop("src_table"), "row_id", "left")
            .groupBy("month")
            .agg(
                F.count(F.lit(1)).alias("n_rows"),
                *[F.count_if(F.col("reason") == x).alias(f"n_{x}") for x in ("absent", "removed", "late")],
            )
            .select(F.lit(r.table).alias("src_table"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


def _with_site(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    # sites is a fixed table of a handful of rows, read whole into a broadcast.
    sites = table(spark, folder, "sites").select("site", "tz_name", "date_order")
    return (
        rows.join(F.broadcast(sites), "site", "left")
        .withColumn("tz_name", F.coalesce("tz_name", F.lit(DEFAULT_ZONE)))
        .withColumn("date_order", F.when(F.col("site").isNull(), DEFAULT_ORDER).otherwise(F.col("date_order")))
    )


def _written(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    sessions = table(spark, folder, "sessions").select(F.col("session_id").alias("id"), F.col("created_at").alias("written"), "site", "ingested_at")
    crashes = table(spark, folder, "segmentation_fault_extraction").select(
        F.col("crash_id").cast("string").alias("id"), F.col("crash_info.timestamp").alias("written"), "site", "ingested_at"
    )
    return {"sessions": sessions, "segmentation_fault_extraction": crashes}


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, rows in _written(spark, folder).items():
        placed = _with_site(spark, folder, rows.where(F.col("written").isNotNull()))
        got = to_instants(
            placed,
            "id",
            F.col("written"),
            F.concat_ws("|", F.lit(name), F.coalesce("site", F.lit(""))),
            F.col("ingested_at"),
            F.col("tz_name"),
            F.col("date_order") == "mdy",
            undeclared=False,
        )
        parts.append(got.select(F.lit(name).alias("src_table"), F.col("row").alias("row_id"), "utc_us", "form"))
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One UTC instant for each value that holds one."""
    return _instants(spark, folder).select("src_table", "row_id", "utc_us").distinct()


def p4_set_apart(spark: SparkSession, folder: str) -> DataFrame:
    """The values that hold no instant, null ones too, as they were written."""
    written = [rows.select(F.lit(name).alias("src_table"), F.col("id").alias("row_id"), "written") for name, rows in _written(spark, folder).items()]
    return reduce(DataFrame.unionByName, written).join(p4_found(spark, folder).select("src_table", "row_id"), ["src_table", "row_id"], "left_anti").distinct()


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """How often each table writes each form."""
    return _instants(spark, folder).groupBy("src_table", "form").agg(F.count(F.lit(1)).alias("n"))


PATCHES = {"element*": r"^/code_patches/#$", "leaf": r"^/code_patches/#/file_path$"}
FRAMES = {"element*": r"^/backtrace/#$", "leaf": r"^/backtrace/#/function$"}
MESSAGES = {
    "rule": r"^/User Intent[^/]*$",
    "element*": r"^/User Intent[^/]*/messages/#$",
    "leaf": r"^/User Intent[^/]*/messages/#/msg_name$",
}


def nested_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of the three nested columns, with interval labels."""
    keep = {"ignoreNullFields": "false"}
    fixes = node_table(
        table(spark, folder, "fix_suggestions").withColumn("record", F.to_json(F.struct("fix_suggestion.code_patches"), keep)).where("fix_suggestion.code_patches is not null"),
        "suggestion_id", F.col("record"), PATCHES,
    )
    crashes = node_table(
        table(spark, folder, "segmentation_fault_extraction").withColumn("record", F.to_json(F.struct("crash_info.backtrace"), keep)).where("crash_info.backtrace is not null"),
        "crash_id", F.col("record"), FRAMES,
    )
    rules = node_table(table(spark, folder, "ltm_mapping_rules"), "rule_file_id", F.col("rules"), MESSAGES, lists=r"^/User Intent[^/]*/messages$")
    named = [("fix_suggestions", fixes), ("segmentation_fault_extraction", crashes), ("ltm_mapping_rules", rules)]
    return reduce(DataFrame.unionByName, [n.select(F.lit(t).alias("src_table"), "*") for t, n in named])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Patches, frames and messages as flat rows linked to record, rule and place."""
    keys = ["src_table", "row_id"]
    linked = contained(contained(nested_nodes(spark, folder), keys, "rule", "in_rule"), keys, "element", "in_element")
    is_element, is_leaf = F.col("node_type") == "element", F.col("node_type") == "leaf"
    text = F.when(F.col("src_table") == "ltm_mapping_rules", F.regexp_replace("scalar", r"^[\s ]+|[\s ]+$", "")).otherwise(F.col("scalar"))
    return (
        linked.where(is_element | is_leaf)
        .withColumn("at", F.when(is_element, F.col("pre")).otherwise(F.col("in_element.pre")))
        .groupBy(*keys, "at")
        .agg(
            F.max(F.when(is_element, F.coalesce("in_rule.name", F.lit("")))).alias("rule_key"),
            F.max(F.when(is_element, F.col("place"))).alias("pos"),
            F.coalesce(F.max(F.when(is_leaf, text)), F.lit("")).alias("leaf"),
        )
        .where(F.col("pos").isNotNull())
        .select(*keys, "rule_key", "pos", "leaf")
    )


QUERIES = {q.__name__: q for q in (p2_found, p2_orphans_by_month, p4_found, p4_set_apart, p4_forms, p5_found)}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x{{A0}}{{]+|[\s\x{{A0}}}}]+$', '', 'g')), '')"


def _reference_sql(r: Reference) -> str:
    child, target = _KEY.format(r.columns[0]), _KEY.format(r.target_columns[0])
    return f"""
        SELECT '{r.table}' AS src_table, c.id AS row_id,
               CASE WHEN t.k IS NULL THEN 'absent' WHEN p.op = 'delete' THEN 'removed' WHEN t.seen > c.seen THEN 'late' END AS reason
        FROM (SELECT {r.row_id} AS id, {child} AS k, ingested_at AS seen FROM {r.table}) c
        LEFT JOIN (SELECT {target} AS k, min(ingested_at) AS seen FROM {r.target} GROUP BY 1) t ON c.k = t.k
        LEFT JOIN (SELECT {_KEY.format('row_key')} AS k, arg_max(purge_op, purged_at) AS op FROM purge_log WHERE src_table = '{r.target}' GROUP BY 1) p ON c.k = p.k
        WHERE c.k IS NOT NULL"""


_ORPHANS = " UNION ALL ".join(_reference_sql(r) for r in REFERENCES)
_MESSAGES = """
    raw AS (SELECT DISTINCT rule_file_id, ltrim(rules, chr(65279)) AS t FROM ltm_mapping_rules WHERE json_valid(ltrim(rules, chr(65279)))),
    doc AS (SELECT rule_file_id, CASE WHEN json_type(t) = 'VARCHAR' THEN ltrim(t::JSON ->> '$', chr(65279)) ELSE t END AS t FROM raw),
    rule AS (SELECT rule_file_id, t, unnest(json_keys(t)) AS rule_key FROM doc WHERE json_valid(t)),
    m0 AS (SELECT rule_file_id, rule_key, json_extract(t, '$."' || rule_key || '".messages') AS m FROM rule WHERE starts_with(rule_key, 'User Intent')),
    m1 AS (SELECT rule_file_id, rule_key, CASE WHEN json_type(m) = 'VARCHAR' THEN (m ->> '$')::JSON ELSE m END AS m FROM m0),
    m2 AS (SELECT rule_file_id, rule_key, CASE WHEN json_type(m) = 'OBJECT' THEN json_array(m) ELSE m END AS m FROM m1),
    m3 AS (SELECT rule_file_id, rule_key, unnest(from_json(m, '["JSON"]')) AS e, generate_subscripts(from_json(m, '["JSON"]'), 1) AS pos FROM m2 WHERE json_type(m) = 'ARRAY')"""
ORACLE = {
    "p2_found": f"SELECT DISTINCT src_table, row_id FROM ({_ORPHANS}) WHERE reason IS NOT NULL",
    "p5_found": f"""WITH {_MESSAGES},
        c AS (SELECT suggestion_id, unnest(fix_suggestion.code_patches) AS e, generate_subscripts(fix_suggestion.code_patches, 1) AS pos FROM fix_suggestions),
        b AS (SELECT crash_id, unnest(crash_info.backtrace) AS e, generate_subscripts(crash_info.backtrace, 1) AS pos FROM segmentation_fault_extraction)
        SELECT DISTINCT 'fix_suggestions' AS src_table, suggestion_id::VARCHAR AS row_id, '' AS rule_key, pos::INT AS pos, coalesce(e.file_path, '') AS leaf FROM c WHERE e IS NOT NULL
        UNION SELECT 'segmentation_fault_extraction', crash_id::VARCHAR, '', pos::INT, coalesce(e."function", '') FROM b WHERE e IS NOT NULL
        UNION SELECT 'ltm_mapping_rules', rule_file_id::VARCHAR, rule_key, pos::INT, coalesce(trim(e ->> '$.msg_name', ' ' || chr(9) || chr(10)), '') FROM m3 WHERE e IS NOT NULL AND json_type(e) <> 'NULL'""",
}


def _months_sql(r: Reference) -> str:
    return f"""
        SELECT '{r.table}' AS src_table, month, count(*) AS n_rows, {', '.join(f"count(*) FILTER (reason = '{x}') AS n_{x}" for x in ('absent', 'removed', 'late'))}
        FROM (SELECT {r.row_id} AS id, min(coalesce(strftime(try_cast(created_at AS TIMESTAMPTZ), '%Y-%m'), 'unknown')) AS month FROM {r.table} GROUP BY 1) m
        LEFT JOIN (SELECT row_id, min(reason) AS reason FROM ({_reference_sql(r)}) WHERE reason IS NOT NULL GROUP BY row_id) o ON m.id = o.row_id GROUP BY month"""


ORACLE["p2_orphans_by_month"] = " UNION ALL ".join(_months_sql(r) for r in REFERENCES)
