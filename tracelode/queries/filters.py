"""Filters, comparisons and small rankings over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.operators import filters as X
from tracelode.operators import graph as G
from tracelode.operators import vectors as V
from tracelode.queries.relations import compiler_error_clusters, compiler_error_rows, section_references
from tracelode.queries.relations_sql import ORACLE as RELATIONS
from tracelode.queries.vectors import ORACLE as VECTORS
from tracelode.tables import table

# Settings files in use.
ACTIVE = ["openradio/core", "gnb.conf", "openradio/l2"]


def _patches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", F.posexplode("fix_suggestion.code_patches").alias("pos", "p")).where("p is not null")
    return rows.select("suggestion_id", "pos", "p.function_name", "p.file_path", "p.patch_type").distinct()


def _suspects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fix_suggestions").select("suggestion_id", F.explode("fix_suggestion.suspected_functions").alias("function_name")).where("function_name is not null").distinct()


def filter_active_paths(spark: SparkSession, folder: str) -> DataFrame:
    """patches whose file belongs to an active part."""
    return _patches(spark, folder).where(X.active_path(F.col("file_path"), ACTIVE) & (F.col("file_path") != "")).select("suggestion_id", "pos", X.one_path(F.col("file_path")).alias("path"))


def filter_handlers(spark: SparkSession, folder: str) -> DataFrame:
    """Functions that handle something, with their fixed score."""
    names = table(spark, folder, "segmentation_fault_extraction").select(F.explode("crash_info.backtrace.function").alias("name")).where("name is not null").distinct()
    return names.select("name", F.coalesce(X.handler_score(F.col("name")), F.when(F.col("name").rlike("_(handle|release|check)_"), 0.95)).alias("score")).where("score is not null")


def filter_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """patches of suspected kinds, or all patches of a suggestion without one."""
    return X.guarded(_patches(spark, folder), ["suggestion_id"], F.col("function_name").contains("_handle_")).select("suggestion_id", "pos", "function_name")


def filter_banned_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lines of every section without banned words, counted."""
    rows = table(spark, folder, "section_nodes").select("section_key", "content_lines").dropDuplicates(["section_key"]).where("content_lines is not null")
    return rows.select("section_key", F.size(X.without_banned(F.col("content_lines"), "NOTE [0-9]+|further study")).alias("n_kept"))


def filter_valid_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """lines whose return flag and status are an allowed pair."""
    allowed = spark.createDataFrame([("A", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return table(spark, folder, "lineitem").join(F.broadcast(allowed), ["l_returnflag", "l_linestatus"], "left_semi").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def filter_path_depth(spark: SparkSession, folder: str) -> DataFrame:
    """patch paths of at most five parts that do not climb."""
    p = X.one_path(F.col("file_path"))
    return _patches(spark, folder).where((F.size(F.split(p, "/")) <= 5) & ~p.contains("..") & (p != "")).groupBy(p.alias("path")).agg(F.count(F.lit(1)).alias("n"))


def filter_allowed_targets(spark: SparkSession, folder: str) -> DataFrame:
    """config patches by kind of target, with a name where one is given."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", F.explode("fix_suggestion.config_patches").alias("p")).where("p is not null").distinct()
    target = F.when(F.lower("p.file_path").rlike("[.](conf|cfg)$"), "runtime").when(F.lower("p.file_path").rlike("cmake"), "cmake").otherwise("other")
    return rows.groupBy(target.alias("target")).agg(F.count(F.lit(1)).alias("n"), F.count(X.first_not_empty(F.col("p.config_name"))).alias("n_named"))


def flow_messages(spark: SparkSession, folder: str) -> DataFrame:
    """messages of each flow without their state, each once, in the order of first mention."""
    rows = table(spark, folder, "segmentation_fault_extraction").select("crash_id", F.array_distinct(F.transform(F.filter("crash_info.scenario_flow", lambda s: s.isNotNull()), lambda s: F.regexp_replace(s, " [a-z]+$", ""))).alias("m")).distinct()
    return rows.where("m is not null").select("crash_id", F.array_join("m", " > ").alias("messages"))


def best_per_target(spark: SparkSession, folder: str) -> DataFrame:
    """best patch of every function of a suggestion by kind, first of equals."""
    score = F.when(F.col("patch_type").contains("mod"), 2.0).when(F.col("patch_type").isNull(), 0.5).otherwise(1.0)
    return X.strict_argmax(_patches(spark, folder).withColumn("score", score), ["suggestion_id", "function_name"], "score", "pos").select("suggestion_id", "function_name", "pos", "score")


def compare_suspects(spark: SparkSession, folder: str) -> DataFrame:
    """Suspected functions against patched ones."""
    patched = _patches(spark, folder).where("function_name is not null").select("suggestion_id", "function_name")
    return X.compared(_suspects(spark, folder), patched, ["suggestion_id", "function_name"])


def primary_error_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A2: every error row of the first cluster of its text."""
    first = compiler_error_clusters(spark, folder).where("cluster_id = 'c0'").select("suggestion_id", "category")
    return compiler_error_rows(spark, folder).join(first, ["suggestion_id", "category"], "left_semi").select("suggestion_id", "line_no", "category")


def validation_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Checks in code documents by kind."""
    docs = table(spark, folder, "documents").where("doc_type = 'code_comment'").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n = lambda p: F.size(F.regexp_extract_all("t", F.lit(p), 0)).alias
    return docs.select("doc_id", n("== NULL")("null_checks"), n("log_err[(]")("error_checks"), n("return -[0-9]+")("return_checks"))


def first_fix(spark: SparkSession, folder: str) -> DataFrame:
    """First rule with a keyword in the reason, its fix counted."""
    # Keywords and fixes in order.
    rules = [(["null pointer"], "check the pointer"), (["listens on", "port"], "align the ports"), (["renamed"], "use the new type"), (["expires"], "hold a reference")]
    fix = F.lit(None).cast("string")
    for words, name in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.col("r").contains(w)
        fix = F.when(hit, name).otherwise(fix)
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", F.coalesce("fix_suggestion.reason", F.lit("")).alias("r")).distinct()
    return rows.groupBy(F.coalesce(fix, F.lit("none")).alias("fix")).agg(F.count(F.lit(1)).alias("n"))


def anchor_boosts(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of reasons raised by anchors in them."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", F.coalesce("fix_suggestion.reason", F.lit("")).alias("r")).distinct()
    score = V.anchor_boost(F.col("r"), ["retry counter", "null pointer", "port"], F.when(F.col("r").contains("clause"), 0.1).otherwise(0.0), F.lit(0.5))
    return rows.select("suggestion_id", F.round(score, 4).alias("score"))


def raised_by_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Patched functions of a suggestion raise its suspects to 0.99 or join them."""
    key = F.concat_ws("|", F.col("suggestion_id").cast("string"), F.col("function_name"))
    suspects = _suspects(spark, folder).select(key.alias("k"), F.lit(0.5).alias("score"))
    truth = _patches(spark, folder).where("function_name is not null").select(key.alias("k"))
    return X.raised(suspects, truth, "k", "score", 0.99)


def title_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The best section of each document by its title; ties to the smaller id."""
    rows = table(spark, folder, "section_nodes").where("section_id is not null").select("doc_id", "section_id", F.coalesce("title", F.lit("")).alias("t")).distinct()
    scored = rows.withColumn("score", X.title_score(F.col("t"), ["procedure", "context", "timing"], "paging"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "section_id", "t")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "section_id", "score")


def rank_boosts(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of sections raised for procedures and outcomes."""
    rows = table(spark, folder, "section_nodes").select("section_key", "title", "level").dropDuplicates(["section_key"])
    boosted = X.rank_boost(F.coalesce(F.col("level").cast("double"), F.lit(0.0)), F.coalesce(F.col("title").contains("procedure"), F.lit(False)), F.coalesce(F.lower("title").contains("unsuccessful"), F.lit(False)))
    return rows.select("section_key", boosted.alias("rank"))


def semantic_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest rows of another label as edges, five of ten candidates, with their inverse."""
    rows = table(spark, folder, "embeddings")
    near = V.nearest(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", "embedding", 10, "cosine").drop("rank")
    labels = rows.select("vec_id", "label").distinct()
    pairs = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label <> own")
    five = V.top_per_group(pairs, ["query_id"], [F.desc("score"), F.col("vec_id")], 5)
    edges = five.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.when(F.col("label") > F.col("own"), "DEPENDS_ON").otherwise("RELATED_TO").alias("kind"))
    return G.with_inverse(edges, {"DEPENDS_ON": "PREREQUISITE_FOR"})


def reference_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Sections reached from those of level 1 by up to three references."""
    node = lambda c: F.concat_ws("#", "doc_id", c)
    edges = section_references(spark, folder).select(node("src").alias("src"), node("dst").alias("dst"), F.lit("REFERENCES").alias("kind"))
    seeds = edges.select(F.col("src").alias("node")).distinct()
    return G.bfs(edges, seeds, 3).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


def stages_of_session(spark: SparkSession, folder: str) -> DataFrame:
    """Q-S6, Q-S7: stages of every completed session in order of creation."""
    done = table(spark, folder, "sessions").where("lower(status) = 'completed'").select("session_id").distinct()
    rows = table(spark, folder, "stage_runs").select("session_id", "stage_name", "created_at", "stage_run_id").distinct()
    w = Window.partitionBy("session_id").orderBy("created_at", "stage_run_id")
    return rows.join(done, "session_id", "left_semi").select("session_id", "stage_name", F.row_number().over(w).alias("place"))


def text_tails(spark: SparkSession, folder: str) -> DataFrame:
    """O3: digest of the last 10,000 characters of every log."""
    rows = table(spark, folder, "rca_logs").where("log_text is not null").select("file_id", "log_text").distinct()
    return rows.select("file_id", F.md5(F.right("log_text", F.lit(10_000))).alias("tail_md5"))


QUERIES = {
    q.__name__: q
    for q in (
        filter_active_paths, filter_handlers, filter_guarded, filter_banned_lines, filter_valid_pairs, filter_path_depth, filter_allowed_targets, flow_messages, best_per_target,
        compare_suspects, primary_error_rows, validation_patterns, first_fix, anchor_boosts, raised_by_truth, title_scores, rank_boosts, semantic_edges, reference_chain,
        stages_of_session, text_tails,
    )
}

_P = """p0 AS (SELECT suggestion_id, unnest(fix_suggestion.code_patches) AS p, generate_subscripts(fix_suggestion.code_patches, 1) - 1 AS pos FROM fix_suggestions),
    pt AS (SELECT DISTINCT suggestion_id, pos, p.function_name, p.file_path, p.patch_type FROM p0 WHERE p IS NOT NULL)"""
_S = "su AS (SELECT DISTINCT suggestion_id, function_name FROM (SELECT suggestion_id, unnest(fix_suggestion.suspected_functions) AS function_name FROM fix_suggestions) WHERE function_name IS NOT NULL)"
_LOW = "lower(replace(file_path, chr(92), '/'))"
_ACTIVE = " OR ".join(f"contains({_LOW}, '{a}') OR contains('{a}', {_LOW}) OR ends_with({_LOW}, '/{a.rsplit('/', 1)[-1]}')" for a in ACTIVE)
_REASON = "rs AS (SELECT DISTINCT suggestion_id, coalesce(fix_suggestion.reason, '') AS r FROM fix_suggestions)"
_WORDS = lambda a: "(" + " OR ".join(f"contains(lower(r), '{w}')" for w in a.split() if len(w) > 3) + ")::INT"
ORACLE = {
    "filter_active_paths": f"WITH {_P} SELECT suggestion_id, pos, {_LOW} AS path FROM pt WHERE file_path <> '' AND ({_ACTIVE})",
    "filter_handlers": f"""WITH n AS (SELECT DISTINCT b."function" AS name FROM (SELECT unnest(crash_info.backtrace) AS b FROM segmentation_fault_extraction) WHERE b."function" IS NOT NULL)
        SELECT name, (CASE WHEN regexp_matches(name, '{X.HANDLERS}') THEN 0.9 ELSE 0.95 END)::DOUBLE AS score FROM n WHERE regexp_matches(name, '{X.HANDLERS}') OR regexp_matches(name, '_(handle|release|check)_')""",
    "filter_guarded": f"WITH {_P} SELECT suggestion_id, pos, function_name FROM pt QUALIFY coalesce(contains(function_name, '_handle_'), false) OR NOT coalesce(bool_or(contains(function_name, '_handle_')) OVER (PARTITION BY suggestion_id), false)",
    "filter_banned_lines": """SELECT section_key, len(list_filter(any_value(content_lines), lambda x: x IS NOT NULL AND NOT regexp_matches(x, '(?i)NOTE [0-9]+|further study')))::INT AS n_kept FROM section_nodes WHERE content_lines IS NOT NULL GROUP BY section_key""",
    "filter_valid_pairs": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O') GROUP BY ALL",
    "filter_path_depth": f"WITH {_P} SELECT {_LOW} AS path, count(*) AS n FROM pt WHERE len(string_split({_LOW}, '/')) <= 5 AND NOT contains({_LOW}, '..') AND {_LOW} <> '' GROUP BY 1",
    "filter_allowed_targets": """WITH c AS (SELECT DISTINCT suggestion_id, p FROM (SELECT suggestion_id, unnest(fix_suggestion.config_patches) AS p FROM fix_suggestions) WHERE p IS NOT NULL)
        SELECT CASE WHEN regexp_matches(lower(p.file_path), '[.](conf|cfg)$') THEN 'runtime' WHEN contains(lower(p.file_path), 'cmake') THEN 'cmake' ELSE 'other' END AS target, count(*) AS n, count(nullif(p.config_name, '')) AS n_named FROM c GROUP BY 1""",
    "best_per_target": f"""WITH {_P}, s AS (SELECT *, (CASE WHEN contains(patch_type, 'mod') THEN 2.0 WHEN patch_type IS NULL THEN 0.5 ELSE 1.0 END)::DOUBLE AS score FROM pt)
        SELECT suggestion_id, function_name, pos, score FROM s QUALIFY row_number() OVER (PARTITION BY suggestion_id, function_name ORDER BY score DESC, pos) = 1""",
    "compare_suspects": f"""WITH {_P}, {_S}, b AS (SELECT DISTINCT suggestion_id, function_name FROM pt WHERE function_name IS NOT NULL)
        SELECT coalesce(su.suggestion_id, b.suggestion_id) AS suggestion_id, coalesce(su.function_name, b.function_name) AS function_name,
               CASE WHEN b.suggestion_id IS NULL THEN 'missing' WHEN su.suggestion_id IS NULL THEN 'extra' ELSE 'same' END AS verdict FROM su FULL JOIN b ON su.suggestion_id = b.suggestion_id AND su.function_name = b.function_name""",
    "validation_patterns": """SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '== NULL'))::INT AS null_checks, len(regexp_extract_all(coalesce(text, ''), 'log_err[(]'))::INT AS error_checks,
        len(regexp_extract_all(coalesce(text, ''), 'return -[0-9]+'))::INT AS return_checks FROM documents WHERE doc_type = 'code_comment'""",
    "first_fix": f"""WITH {_REASON} SELECT CASE WHEN contains(r, 'null pointer') THEN 'check the pointer' WHEN contains(r, 'listens on') OR contains(r, 'port') THEN 'align the ports' WHEN contains(r, 'renamed') THEN 'use the new type'
        WHEN contains(r, 'expires') THEN 'hold a reference' ELSE 'none' END AS fix, count(*) AS n FROM rs GROUP BY 1""",
    "anchor_boosts": f"""WITH {_REASON} SELECT suggestion_id, round(least(1.0, 0.5 + CASE WHEN contains(r, 'clause') THEN 0.1 ELSE 0.0 END + least(0.2, 0.1 * ({' + '.join(_WORDS(a) for a in ('retry counter', 'null pointer', 'port'))}))), 4)::DOUBLE AS score FROM rs""",
    "raised_by_truth": f"""WITH {_P}, {_S}, b AS (SELECT DISTINCT suggestion_id || '|' || function_name AS k FROM pt WHERE function_name IS NOT NULL), a AS (SELECT suggestion_id || '|' || function_name AS k FROM su)
        SELECT coalesce(a.k, b.k) AS k, (CASE WHEN b.k IS NOT NULL THEN 0.99 ELSE 0.5 END)::DOUBLE AS score FROM a FULL JOIN b ON a.k = b.k""",
    "title_scores": """WITH s AS (SELECT DISTINCT doc_id, section_id, coalesce(title, '') AS t FROM section_nodes WHERE section_id IS NOT NULL),
        c AS (SELECT *, CASE WHEN contains(lower(t), 'paging') THEN 12 ELSE 0 END + CASE WHEN contains(lower(t), 'procedure') THEN 2 ELSE 0 END + CASE WHEN contains(lower(t), 'context') THEN 2 ELSE 0 END + CASE WHEN contains(lower(t), 'timing') THEN 2 ELSE 0 END AS score FROM s)
        SELECT doc_id, section_id, score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section_id, t) = 1""",
    "rank_boosts": """SELECT section_key, greatest(coalesce(any_value(level), 0)::DOUBLE, CASE WHEN contains(any_value(title), 'procedure') THEN 1e6 ELSE 0 END, CASE WHEN contains(lower(any_value(title)), 'unsuccessful') THEN 2e6 ELSE 0 END)::DOUBLE AS rank FROM section_nodes GROUP BY section_key""",
    "stages_of_session": """WITH r AS (SELECT DISTINCT session_id, stage_name, created_at, stage_run_id FROM stage_runs WHERE session_id IN (SELECT session_id FROM sessions WHERE lower(status) = 'completed'))
        SELECT session_id, stage_name, row_number() OVER (PARTITION BY session_id ORDER BY created_at, stage_run_id) AS place FROM r""",
    "text_tails": "SELECT DISTINCT file_id, md5(right(log_text, 10000)) AS tail_md5 FROM rca_logs WHERE log_text IS NOT NULL",
}
ORACLE |= {
    "flow_messages": """WITH f AS (SELECT DISTINCT crash_id, list_transform(list_filter(crash_info.scenario_flow, lambda s: s IS NOT NULL), lambda s: regexp_replace(s, ' [a-z]+$', '')) AS m FROM segmentation_fault_extraction WHERE crash_info.scenario_flow IS NOT NULL),
        u AS (SELECT crash_id, m, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM f), o AS (SELECT crash_id, m, x, min(i) AS i FROM u GROUP BY ALL),
        a AS (SELECT crash_id, m, string_agg(x, ' > ' ORDER BY i) AS messages FROM o GROUP BY crash_id, m)
        SELECT f.crash_id, coalesce(messages, '') AS messages FROM f LEFT JOIN a ON f.crash_id = a.crash_id AND f.m = a.m""",
    "primary_error_rows": f"""WITH e AS ({RELATIONS['compiler_error_rows']}), c AS ({RELATIONS['compiler_error_clusters']})
        SELECT suggestion_id, line_no, category FROM e WHERE EXISTS (SELECT 1 FROM c WHERE c.cluster_id = 'c0' AND c.suggestion_id = e.suggestion_id AND c.category = e.category)""",
    "semantic_edges": f"""WITH near AS ({VECTORS['vec_topk_cosine']}), l AS (SELECT DISTINCT vec_id, label FROM embeddings),
        p AS (SELECT near.query_id, near.vec_id, near.rank, b.label, a.label AS own FROM near JOIN l a ON a.vec_id = near.query_id JOIN l b ON b.vec_id = near.vec_id WHERE a.label <> b.label),
        five AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5)
        SELECT query_id AS src, vec_id AS dst, CASE WHEN label > own THEN 'DEPENDS_ON' ELSE 'RELATED_TO' END AS kind FROM five
        UNION SELECT vec_id, query_id, CASE WHEN label > own THEN 'PREREQUISITE_FOR' ELSE 'RELATED_TO' END FROM five""",
    "reference_chain": f"""WITH RECURSIVE e AS (SELECT DISTINCT doc_id || '#' || src AS src, doc_id || '#' || dst AS dst FROM ({RELATIONS['section_references']})),
        w AS (SELECT DISTINCT src AS node, 0 AS depth FROM e UNION ALL SELECT e.dst, depth + 1 FROM w JOIN e ON w.node = e.src WHERE depth < 3)
        SELECT depth, count(*) AS n FROM (SELECT node, min(depth) AS depth FROM w GROUP BY node) GROUP BY depth""",
}
