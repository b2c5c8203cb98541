"""Scans and rules over logs, error texts and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import scalars as C
from tracelode.operators import text as T
from tracelode.operators import vectors as V
from tracelode.tables import table

# What makes a log line worth keeping, most important first.
ANCHORS = ["ERROR", "WARN", "failed", "NGAP", "SCTP", "F1AP", "association", "timeout"]
# Steps a log may show, in order.
MILESTONES = [
    ("cell [0-9]+ up", "cell up"), ("link is up", "link up"), ("timer T-[0-9a-z]+ started", "timer started"), ("entering state WAIT_[0-9]+", "waiting"),
    ("peer closed association", "peer lost"), ("assertion failed", "assertion failed"), ("Traceback", "exception"),
]
# Signs of the node that logged, most specific first.
ROLES = [("f1ap.*cu|cu task|central unit", "CU"), ("f1ap.*du|du task|distributed unit|du[.][a-z]", "DU"), ("task_phy_ue|ue task|user equipment", "UE"), ("gnb_app|ngap.*gnb", "gNB")]
# Kinds of a log, in order of precedence.
KINDS = [
    ("no such file", "dependency"), ("SIG[A-Z]+|Traceback|assertion failed", "runtime"), ("CMake Error", "cmake"),
    ("[.][ch]:[0-9]+:[0-9]+: (fatal )?error:", "build"),
]


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rca_logs").select("file_id", "log_text").distinct()


def _errors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text").distinct()


def text_line_context(spark: SparkSession, folder: str) -> DataFrame:
    """Five lines around every line with an exception."""
    lines = T.lines_of(_logs(spark, folder), ["file_id"], "log_text")
    got = T.line_context(lines, ["file_id"], F.col("line").contains("ValueError"), 5, 5)
    return got.select("file_id", "line_no", F.md5("context").alias("context_md5"))


def text_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The last source file named, carried onto later lines."""
    lines = T.lines_of(_errors(spark, folder), ["suggestion_id"], "error_text")
    path = F.nullif(F.regexp_extract("line", r"([a-z0-9_/]+[.][ch]):[0-9]+", 1), F.lit(""))
    filled = T.forward_fill(lines, ["suggestion_id"], path, "path").where("path is not null")
    return filled.select("suggestion_id", F.col("line_no").cast("long").alias("line_no"), "path")


def text_anchor_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty most telling lines of every log."""
    got = T.anchor_lines(T.lines_of(_logs(spark, folder), ["file_id"], "log_text"), ["file_id"], ANCHORS)
    return got.select("file_id", "rank", "severity", "first_line", F.md5("line").alias("line_md5"))


def text_milestones(spark: SparkSession, folder: str) -> DataFrame:
    """Steps each log shows, in rule order."""
    got = _logs(spark, folder).select("file_id", T.matched_rules(F.col("log_text"), MILESTONES).alias("steps"))
    return got.select("file_id", F.array_join("steps", " > ").alias("flow"))


def text_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Role of every log: first rule that matches, else the role named most often."""
    text = F.col("log_text")
    counts = [(T.occurrences(text, word), role) for word, role in (("f1ap", "CU"), ("rlc", "DU"), ("phy", "UE"), ("ngap", "gNB"))]
    best = F.greatest(*[c for c, _ in counts])
    most = F.when(best == 0, "Unknown")
    for c, role in counts:
        most = most.when(c == best, role)
    role = T.first_rule(text, ROLES, "")
    return _logs(spark, folder).where("log_text is not null").select("file_id", F.when(role != "", role).otherwise(most).alias("role"))


def text_log_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of every error text, counted."""
    kind = T.first_rule(F.coalesce("error_text", F.lit("")), KINDS, "none")
    return _errors(spark, folder).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def text_keyword_score(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes scored by keywords in reason, text and functions; best five a source."""
    rows = table(spark, folder, "fix_suggestions").select(
        "suggestion_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("fix_suggestion.reason", F.lit("")).alias("r"), F.coalesce("error_text", F.lit("")).alias("t"),
        F.coalesce(F.array_join("fix_suggestion.suspected_functions", " "), F.lit("")).alias("f"),
    ).distinct()
    scored = rows.withColumn("score", F.round(T.keyword_score(F.col("r"), F.col("t"), F.col("f"), ["pointer", "context", "paging", "handle"]), 3))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "suggestion_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("source", "rank", "suggestion_id", "score")


def text_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of every section without page furniture."""
    sections = table(spark, folder, "section_nodes").select("section_key", "content_lines").dropDuplicates(["section_key"])
    lines = sections.select("section_key", F.posexplode("content_lines").alias("line_no", "line")).where("line is not null")
    got = T.paragraphs(lines, ["section_key"], r"^Release [0-9]+\s|^[0-9]+$")
    return got.select("section_key", "paragraph", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of documents by word count."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(T.chunk_words(F.coalesce("text", F.lit("")))).alias("chunk_no", "chunk"))
    return docs.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


def text_word_strides(spark: SparkSession, folder: str) -> DataFrame:
    """Strides of 300 words that share 50."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n\r\t]+"), lambda w: w != "")
    docs = table(spark, folder, "documents").select("doc_id", words.alias("words")).where(F.size("words") > 0)
    return docs.select("doc_id", F.posexplode(T.word_stride(F.col("words"), 300, 50)).alias("stride", "part")).select("doc_id", F.col("stride").cast("long").alias("stride"), F.size("part").cast("long").alias("n_words"))


def text_fixed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of 1,500 characters, trimmed."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(T.fixed_pieces(F.coalesce("text", F.lit("")), 1500)).alias("piece", "part"))
    return docs.select("doc_id", "piece", F.length("part").alias("n_chars"))


def text_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Name labels, A6: how many functions of backtraces carry each label, and their share."""
    frames = table(spark, folder, "segmentation_fault_extraction").select(F.explode("crash_info.backtrace.function").alias("name")).where("name is not null").distinct()
    total = frames.count()
    labels = frames.select("name", F.explode(T.categories(F.col("name"))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return labels.select("category", "n", F.round(F.col("n") * 100.0 / total, 2).alias("percent"))


def text_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the text: one row for each document with its class and the size of the class."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    classes = docs.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    return docs.join(classes, "digest").select("doc_id", "class_id", "n_copies")


def text_numstat(spark: SparkSession, folder: str) -> DataFrame:
    """Added and removed lines of every file of a change; binary files count 0."""
    rows = table(spark, folder, "code_validations").select("validation_id", "git_diff_output").distinct()
    parts = T.lines_of(rows, ["validation_id"], "git_diff_output").select("validation_id", F.split("line", "\t").alias("p")).where(F.size("p") == 3)
    count = lambda i: F.when(F.col("p")[i] == "-", 0).otherwise(F.col("p")[i].try_cast("long"))
    return parts.select("validation_id", count(0).alias("added"), count(1).alias("removed"), F.col("p")[2].alias("path")).where("added is not null and removed is not null")


def text_numstat_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Files and lines of changes by directory."""
    stats = text_numstat(spark, folder)
    return stats.groupBy(F.substring_index("path", "/", 2).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def text_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Lines up to two before and after each code line of a compiler message, by range."""
    lines = T.lines_of(_errors(spark, folder), ["suggestion_id"], "error_text")
    return T.line_context(lines, ["suggestion_id"], F.col("line").rlike("^ *[0-9]+ [|]"), 2, 2).select("suggestion_id", F.col("line_no").cast("long").alias("line_no"), F.length("context").cast("long").alias("n_chars"))


def text_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path extraction, F19: distinct source paths of each error text in one spelling."""
    rows = _errors(spark, folder).where("error_text is not null")
    found = rows.select("suggestion_id", F.explode(F.array_distinct(F.regexp_extract_all("error_text", F.lit("[a-z][a-z0-9_]*(?:/[a-z0-9_]+)+[.][ch]"), 0))).alias("path"))
    return found.select("suggestion_id", T.canonical_path(F.col("path")).alias("path")).distinct()


def text_role_filter(spark: SparkSession, folder: str) -> DataFrame:
    """frames that suit the role DU."""
    frames = table(spark, folder, "segmentation_fault_extraction").select("crash_id", F.explode("crash_info.backtrace").alias("f")).where("f.function is not null and f.file is not null")
    path = F.replace("f.file", F.lit("\\"), F.lit("/"))
    return frames.where(T.for_role(F.col("f.function"), path, "DU") & (path != "")).select("crash_id", F.col("f.function").alias("function"), path.alias("file")).distinct()


def text_json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and values of the JSON of agent runs as rows."""
    rows = table(spark, folder, "agent_runs").select("agent_run_id", "input_json").distinct()
    pairs = rows.select("agent_run_id", F.explode(F.from_json("input_json", "map<string,string>")).alias("key", "value"))
    return pairs.select("agent_run_id", "key", "value")


# Tables of the run state and their keys.
_STATE_KEYS = {"sessions": "session_id", "stage_runs": "stage_run_id", "agent_runs": "agent_run_id", "code_validations": "validation_id"}


def text_json_checked(spark: SparkSession, folder: str) -> DataFrame:
    """S29, Q-S6: values of the JSON columns of the run state that are missing, can be read and cannot, by table and column."""
    found = None
    for name, key in _STATE_KEYS.items():
        rows = table(spark, folder, name)
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in rows.columns if c.endswith("_json")])
        # Repeated deliveries count once.
        part = rows.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), F.explode(cells).alias("c")).select("table_name", "key", "c.column_name", "c.value").distinct()
        found = part if found is None else found.unionByName(part)
    read = found.withColumn("read", C.readable_json(F.col("value")))
    return read.groupBy("table_name", "column_name").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count_if("read").alias("n_read"),
        F.count_if(F.col("value").isNotNull() & ~F.col("read")).alias("n_bad"),
    )


def text_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Ten documents nearest by TF-IDF cosine to every document whose id is divisible by 50."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 4)
    docs = table(spark, folder, "documents").select("doc_id", words.alias("words"))
    tf = docs.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, "term").withColumn("w", F.col("tf") * F.log((1.0 + n) / (1.0 + F.col("df"))))
    vectors = weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws"))
    unit = vectors.where("norm > 0").select("doc_id", "terms", F.transform("ws", lambda w: w / F.col("norm")).alias("weights"))
    return V.nearest_sparse(unit, unit.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id"), "doc_id", "query_id", 10, 0.01).select("query_id", "doc_id", "rank", "score")


def text_pattern_match(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns of which an error text holds at least 80 % of the words, best first."""
    # Patterns by id.
    patterns = [("null_pointer", "backtrace ends in null pointer"), ("late_timer", "timer fires before the message arrives"), ("stale_value", "related to stale value kept"), ("build_type", "build fails with an unknown type")]
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("error_text", F.lit(""))), "[^a-z]+"), lambda w: w != ""))
    rows = _errors(spark, folder).select("suggestion_id", words.alias("words"))
    out = []
    for name, p in patterns:
        own = sorted(set(p.split()))
        share = F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in own]))) / len(own)
        out.append(F.struct(F.lit(name).alias("pattern_id"), F.round(share, 4).alias("share")))
    return rows.select("suggestion_id", F.explode(F.array(*out)).alias("m")).where("m.share >= 0.8").select("suggestion_id", "m.pattern_id", "m.share")


def text_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """For each section the share of its listed elements that its prose names."""
    rows = table(spark, folder, "section_nodes").select("section_key", "content_lines").dropDuplicates(["section_key"])
    lines = F.filter("content_lines", lambda x: x.isNotNull())
    listed = F.array_distinct(F.filter(F.transform(F.filter(lines, lambda x: x.contains(" | ")), lambda x: F.substring_index(x, " | ", 1)), lambda x: x != "IE/Group Name"))
    prose = F.lower(F.array_join(F.filter(lines, lambda x: ~x.contains(" | ")), " "))
    got = rows.select("section_key", listed.alias("listed"), prose.alias("prose")).where(F.size("listed") > 0)
    covered = F.size(F.filter("listed", lambda x: F.col("prose").contains(F.lower(x))))
    return got.select("section_key", F.size("listed").alias("n_listed"), covered.alias("n_covered"), F.round(covered * 100.0 / F.size("listed"), 2).alias("percent"))


def text_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Duration labels and diff kinds of scalars: labels of event gaps."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    gaps = table(spark, folder, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(w).cast("timestamp")))
    return gaps.where("ms is not null").groupBy(T.duration_label(F.col("ms")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    q.__name__: q
    for q in (
        text_line_context, text_forward_fill, text_anchor_lines, text_milestones, text_roles, text_log_kinds, text_keyword_score, text_paragraphs, text_chunks,
        text_word_strides, text_fixed_pieces, text_categories, text_exact_copies, text_numstat, text_numstat_totals, text_snippets, text_paths, text_role_filter,
        text_json_flatten, text_json_checked, text_tfidf, text_pattern_match, text_coverage, text_durations,
    )
}

_LINES = r"""
    l AS (SELECT k, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no
          FROM (SELECT {key} AS k, string_split(replace(regexp_replace({text}, '\x1b\[[0-9;]*m', '', 'g'), chr(13), ''), chr(10)) AS parts
                FROM (SELECT DISTINCT {key}, {text} FROM {table}) WHERE {text} IS NOT NULL))"""
_LOG = _LINES.format(key="file_id", text="log_text", table="rca_logs")
_ERR = _LINES.format(key="suggestion_id", text="error_text", table="fix_suggestions")
_ERRORS = "(SELECT DISTINCT suggestion_id, error_text FROM fix_suggestions)"
_ROLE = " ".join(f"WHEN regexp_matches(log_text, '(?i){p}') THEN '{r}'" for p, r in ROLES)
_KIND = " ".join(f"WHEN regexp_matches(coalesce(error_text, ''), '(?i){p}') THEN '{k}'" for p, k in KINDS)
_STEPS = ", ".join(f"CASE WHEN regexp_matches(log_text, '(?i){p}') THEN '{s}' END" for p, s in MILESTONES)
_COUNT = lambda w: f"((length(lower(log_text)) - length(replace(lower(log_text), '{w}', ''))) // {len(w)})"
_KEYS = " + ".join(
    f"CASE WHEN contains(lower(r), '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(t), '{w}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(f), '{w}') THEN 3 ELSE 0 END"
    for w in ("pointer", "context", "paging", "handle")
)
_LABELS = ", ".join(f"CASE WHEN regexp_matches(lower(name), '{'|'.join(words)}') THEN '{label}' END" for label, words in T.CATEGORIES)

ORACLE = {
    "text_line_context": f"""WITH {_LOG}, c AS (SELECT k AS file_id, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY k ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS context FROM l)
        SELECT file_id, line_no, md5(context) AS context_md5 FROM c WHERE contains(line, 'ValueError')""",
    "text_forward_fill": f"""WITH {_ERR}, p AS (SELECT k, line_no, nullif(regexp_extract(line, '([a-z0-9_/]+[.][ch]):[0-9]+', 1), '') AS path FROM l)
        SELECT k AS suggestion_id, line_no, last_value(path IGNORE NULLS) OVER (PARTITION BY k ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS path FROM p QUALIFY path IS NOT NULL OR last_value(path IGNORE NULLS) OVER (PARTITION BY k ORDER BY line_no ROWS UNBOUNDED PRECEDING) IS NOT NULL""",
    "text_anchor_lines": f"""WITH {_LOG}, m AS (SELECT k AS file_id, trim(line) AS line, min(line_no) AS first_line FROM l WHERE regexp_matches(trim(line), '(?i){'|'.join(ANCHORS)}') GROUP BY k, trim(line)),
        s AS (SELECT *, CASE WHEN contains(lower(line), 'error') OR contains(lower(line), 'failed') OR contains(lower(line), 'no amf') THEN 0 WHEN contains(lower(line), 'warn') THEN 1 ELSE 2 END AS severity FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY severity, first_line) AS rank FROM s)
        SELECT file_id, rank, severity, first_line, md5(line) AS line_md5 FROM r WHERE rank <= 20""",
    "text_milestones": f"SELECT file_id, array_to_string(list_filter([{_STEPS}], lambda x: x IS NOT NULL), ' > ') AS flow FROM (SELECT DISTINCT file_id, log_text FROM rca_logs)",
    "text_roles": f"""WITH c AS (SELECT file_id, log_text, {_COUNT('f1ap')} AS a, {_COUNT('rlc')} AS b, {_COUNT('phy')} AS c, {_COUNT('ngap')} AS d FROM (SELECT DISTINCT file_id, log_text FROM rca_logs) WHERE log_text IS NOT NULL)
        SELECT file_id, CASE {_ROLE} WHEN greatest(a, b, c, d) = 0 THEN 'Unknown' WHEN a = greatest(a, b, c, d) THEN 'CU' WHEN b = greatest(a, b, c, d) THEN 'DU' WHEN c = greatest(a, b, c, d) THEN 'UE' ELSE 'gNB' END AS role FROM c""",
    "text_log_kinds": f"SELECT CASE {_KIND} ELSE 'none' END AS kind, count(*) AS n FROM {_ERRORS} GROUP BY 1",
    "text_keyword_score": f"""WITH b AS (SELECT DISTINCT suggestion_id, coalesce(source, '') AS source, coalesce(fix_suggestion.reason, '') AS r, coalesce(error_text, '') AS t,
                coalesce(array_to_string(list_filter(fix_suggestion.suspected_functions, lambda x: x IS NOT NULL), ' '), '') AS f FROM fix_suggestions),
        s AS (SELECT source, suggestion_id, round(least(({_KEYS}) / 10.0, 1.0), 3)::DOUBLE AS score FROM b)
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, suggestion_id) AS rank, suggestion_id, score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, suggestion_id) <= 5""",
    "text_word_strides": r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n\r\t]+'), lambda x: x <> '')) AS n FROM documents),
        s AS (SELECT doc_id, n, unnest(range(0, greatest(n - 1 - 50, 0) + 1, 250)) AS start FROM w WHERE n > 0)
        SELECT doc_id, start // 250 AS stride, least(300, n - start) AS n_words FROM s""",
    "text_fixed_pieces": """WITH s AS (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, greatest(length(coalesce(text, '')) - 1, 0) + 1, 1500)) AS start FROM documents)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS piece, length(trim(substring(text, (start + 1)::BIGINT, 1500)))::INT AS n_chars FROM s WHERE trim(substring(text, (start + 1)::BIGINT, 1500)) <> ''""",
    "text_categories": f"""WITH f AS (SELECT DISTINCT b."function" AS name FROM (SELECT unnest(crash_info.backtrace) AS b FROM segmentation_fault_extraction) WHERE b."function" IS NOT NULL),
        g AS (SELECT name, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS c FROM f), u AS (SELECT unnest(CASE WHEN len(c) = 0 THEN ['general'] ELSE c END) AS category FROM g)
        SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM f), 2)::DOUBLE AS percent FROM u GROUP BY category""",
    "text_exact_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS class_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS n_copies FROM documents",
    "text_numstat": """WITH l AS (SELECT validation_id, string_split(replace(unnest(string_split(git_diff_output, chr(10))), chr(13), ''), chr(9)) AS p FROM (SELECT DISTINCT validation_id, git_diff_output FROM code_validations))
        SELECT validation_id, CASE WHEN p[1] = '-' THEN 0 ELSE try_cast(p[1] AS BIGINT) END AS added, CASE WHEN p[2] = '-' THEN 0 ELSE try_cast(p[2] AS BIGINT) END AS removed, p[3] AS path FROM l
        WHERE len(p) = 3 AND (p[1] = '-' OR try_cast(p[1] AS BIGINT) IS NOT NULL) AND (p[2] = '-' OR try_cast(p[2] AS BIGINT) IS NOT NULL)""",
    "text_snippets": f"""WITH {_ERR}, c AS (SELECT k AS suggestion_id, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY k ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM l)
        SELECT suggestion_id, line_no, length(context) AS n_chars FROM c WHERE regexp_matches(line, '^ *[0-9]+ [|]')""",
    "text_json_flatten": """WITH r AS (SELECT DISTINCT agent_run_id, input_json FROM agent_runs WHERE input_json IS NOT NULL), k AS (SELECT agent_run_id, input_json, unnest(json_keys(input_json)) AS key FROM r)
        SELECT agent_run_id, key, json_extract_string(input_json, '$."' || key || '"') AS value FROM k""",
    "text_json_checked": """SELECT count(*) FILTER (resolved_summary_json IS NULL) AS n_null, count(*) FILTER (json_valid(resolved_summary_json)) AS n_read, count(*) FILTER (NOT json_valid(resolved_summary_json)) AS n_bad
        FROM (SELECT DISTINCT session_id, resolved_summary_json FROM sessions)""",
    "text_tfidf": """WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS term FROM documents) WHERE length(term) >= 4 GROUP BY doc_id, term),
        d AS (SELECT term, count(*) AS df FROM t GROUP BY term), w AS (SELECT doc_id, t.term, tf * ln((1.0 + (SELECT count(*) FROM documents))::DOUBLE / (1.0 + df)) AS w FROM t JOIN d ON t.term = d.term),
        n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id), u AS (SELECT w.doc_id, term, w / norm AS w FROM w JOIN n ON w.doc_id = n.doc_id WHERE norm > 0),
        s AS (SELECT q.doc_id AS query_id, c.doc_id, round(sum(q.w * c.w), 6) AS score FROM u q JOIN u c ON q.term = c.term AND q.doc_id % 50 = 0 AND q.doc_id <> c.doc_id GROUP BY q.doc_id, c.doc_id)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM s WHERE score > 0.01 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
    "text_coverage": """WITH r AS (SELECT section_key, list_filter(any_value(content_lines), lambda x: x IS NOT NULL) AS ls FROM section_nodes GROUP BY section_key),
        g AS (SELECT section_key, list_distinct(list_filter(list_transform(list_filter(ls, lambda x: contains(x, ' | ')), lambda x: string_split(x, ' | ')[1]), lambda x: x <> 'IE/Group Name')) AS listed,
                     lower(array_to_string(list_filter(ls, lambda x: NOT contains(x, ' | ')), ' ')) AS prose FROM r),
        c AS (SELECT section_key, len(listed) AS n, len(list_filter(listed, lambda x: contains(prose, lower(x)))) AS k FROM g WHERE len(listed) > 0)
        SELECT section_key, n::INT AS n_listed, k::INT AS n_covered, round(k * 100.0 / n, 2)::DOUBLE AS percent FROM c""",
    "text_pattern_match": """WITH e AS (SELECT suggestion_id, list_distinct(regexp_split_to_array(lower(coalesce(error_text, '')), '[^a-z]+')) AS words FROM (SELECT DISTINCT suggestion_id, error_text FROM fix_suggestions)),
        p(pattern_id, own) AS (VALUES ('null_pointer', list_distinct(string_split('backtrace ends in null pointer', ' '))), ('late_timer', list_distinct(string_split('timer fires before the message arrives', ' '))),
            ('stale_value', list_distinct(string_split('related to stale value kept', ' '))), ('build_type', list_distinct(string_split('build fails with an unknown type', ' '))))
        SELECT suggestion_id, pattern_id, round(len(list_intersect(words, own)) / len(own), 4) AS share FROM e, p WHERE len(list_intersect(words, own)) / len(own) >= 0.8""",
}
ORACLE["text_numstat_totals"] = f"""SELECT CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE path END AS folder, count(*) AS n_files, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed
    FROM ({ORACLE['text_numstat']}) GROUP BY 1"""
ORACLE["text_paths"] = """WITH e AS (SELECT suggestion_id, unnest(list_distinct(regexp_extract_all(error_text, '[a-z][a-z0-9_]*(?:/[a-z0-9_]+)+[.][ch]'))) AS path FROM fix_suggestions WHERE error_text IS NOT NULL)
    SELECT DISTINCT suggestion_id, lower(path) AS path FROM e"""
ORACLE["text_role_filter"] = """WITH f AS (SELECT crash_id, unnest(crash_info.backtrace) AS f FROM segmentation_fault_extraction)
    SELECT DISTINCT crash_id, f."function" AS "function", replace(f.file, chr(92), '/') AS file FROM f WHERE f."function" IS NOT NULL AND f.file IS NOT NULL AND f.file <> ''
    AND NOT regexp_matches(lower(replace(f.file, chr(92), '/')), '/cu/|/ue/') AND NOT regexp_matches(lower(f."function"), '^(cu_|ue_)')"""
ORACLE["text_durations"] = """WITH g AS (SELECT (epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id)) // 1000 AS s FROM events), p AS (SELECT s FROM g WHERE s IS NOT NULL)
    SELECT CASE WHEN s < 1 THEN '<1s' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS label, count(*) AS n FROM p GROUP BY 1"""
ORACLE["text_paragraphs"] = r"""WITH s AS (SELECT section_key, any_value(content_lines) AS ls FROM section_nodes WHERE content_lines IS NOT NULL GROUP BY section_key),
    l AS (SELECT section_key, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS n FROM s),
    k AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY section_key ORDER BY n ROWS UNBOUNDED PRECEDING) AS paragraph FROM l WHERE line IS NOT NULL AND NOT regexp_matches(line, '^Release [0-9]+\s|^[0-9]+$')),
    t AS (SELECT section_key, paragraph, replace(string_agg(line, ' ' ORDER BY n), '- ', '') AS text FROM k WHERE line <> '' GROUP BY section_key, paragraph)
    SELECT section_key, paragraph::BIGINT AS paragraph, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM t"""
