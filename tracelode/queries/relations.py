"""Joins, aggregates, graphs and run state over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.operators import graph as G
from tracelode.operators import relational as R
from tracelode.operators import state as S
from tracelode.operators import text as T
from tracelode.queries.relations_sql import ORACLE  # noqa: F401  (the registry reads it here)
from tracelode.tables import table

EVENT_STATUS = {"view": "not_completed", "click": "in_progress", "purchase": "completed", "error": "failed", "signup": "in_progress"}


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = table(spark, folder, "segmentation_fault_extraction").select("crash_id", F.posexplode("crash_info.backtrace").alias("pos", "f"))
    return frames.select("crash_id", "pos", F.col("f.function").alias("function"), F.col("f.file").alias("file")).where("f is not null and function is not null").distinct()


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """Caller to callee: each frame is called by the next."""
    w = Window.partitionBy("crash_id").orderBy("pos", "function", "file")
    edges = _frames(spark, folder).withColumn("caller", F.lead("function").over(w)).where("caller is not null and caller <> function")
    return edges.select(F.col("caller").alias("src"), F.col("function").alias("dst"), F.lit("calls").alias("kind")).distinct()


def _trade(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier to nation, customer to nation, nation to region; ids with a letter for the kind."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    supplier = table(spark, folder, "supplier").select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst"), F.lit("in_nation").alias("kind"))
    nation = table(spark, folder, "nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("in_region").alias("kind"))
    return G.edge_union(supplier, nation)


def _status(spark: SparkSession, folder: str) -> DataFrame:
    status = None
    for kind, name in EVENT_STATUS.items():
        status = F.when(F.col("event_type") == kind, name) if status is None else status.when(F.col("event_type") == kind, name)
    return table(spark, folder, "events").withColumn("status", status).withColumn("milestone", F.col("event_id") % 3)


def join_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """Suspected functions with the first file a backtrace names for them, or Unknown."""
    names = table(spark, folder, "fix_suggestions").select("suggestion_id", F.explode("fix_suggestion.suspected_functions").alias("function")).where("function is not null").distinct()
    files = _frames(spark, folder).where("file is not null").select("function", "file").distinct()
    return R.first_match(names, files, "function", "file", ["file"], {"file": "Unknown"}).select("suggestion_id", "function", "file")


def join_ignoring_case(spark: SparkSession, folder: str) -> DataFrame:
    """Stage names and agent sessions matched without regard to case."""
    frames = _frames(spark, folder).select(F.upper("function").alias("u")).distinct()
    names = table(spark, folder, "fix_suggestions").select(F.explode("fix_suggestion.suspected_functions").alias("function")).where("function is not null").distinct()
    return names.join(frames, F.upper("function") == F.col("u"), "left_semi").select("function")


def join_path_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Patches and frames of one function whose paths agree up to a prefix."""
    patch = table(spark, folder, "fix_suggestions").select("suggestion_id", F.explode("fix_suggestion.code_patches").alias("p"))
    rows = patch.select("suggestion_id", F.col("p.function_name").alias("function"), F.col("p.file_path").alias("path")).where("function is not null and path is not null").distinct()
    nodes = _frames(spark, folder).where("file is not null").select("function", F.col("file").alias("node_path")).distinct()
    return R.suffix_match(rows, nodes, "function", "path", "node_path").select("suggestion_id", "function", "path", "node_path", "fits")


def join_substring(spark: SparkSession, folder: str) -> DataFrame:
    """First part whose name holds each hint; the hints are a short fixed list."""
    hints = ["widget", "ring", "red", "blue", "bolt"]
    parts = table(spark, folder, "part").select("p_partkey", F.explode(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.lower("p_name").contains(h))).alias("hint"))
    return parts.groupBy("hint").agg(F.min("p_partkey").alias("p_partkey"))


def join_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with and without orders, counted by segment."""
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = customers.join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_with"))
    lack = customers.join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_without"))
    return have.join(lack, "c_mktsegment", "full").select("c_mktsegment", F.coalesce("n_with", F.lit(0)).alias("n_with"), F.coalesce("n_without", F.lit(0)).alias("n_without"))


def join_earliest_before(spark: SparkSession, folder: str) -> DataFrame:
    """Errors linked to the first view of the same user, if it came before."""
    events = table(spark, folder, "events")
    got = R.earliest_before(events.where("event_type = 'error'").select("event_id", "user_id"), events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id")), ["user_id"], "event_id", "view_id", "view_id")
    return got.select("event_id", "user_id", "linked")


def join_interval_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Lines from each traceback to the next or the end of the log."""
    logs = table(spark, folder, "rca_logs").select("file_id", "log_text").distinct()
    lines = T.lines_of(logs, ["file_id"], "log_text")
    last = lines.groupBy("file_id").agg(F.max("line_no").alias("last"))
    w = Window.partitionBy("file_id").orderBy("line_no")
    heads = lines.where(F.col("line").startswith("Traceback")).withColumn("until", F.lead("line_no").over(w) - 1)
    return heads.join(last, "file_id").select("file_id", F.col("line_no").alias("first_line"), F.coalesce("until", "last").alias("last_line"))


def join_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of sessions, given ones over defaults."""
    rows = table(spark, folder, "sessions").select("session_id", "site", "template_path").distinct()
    # Defaults of missing fields.
    defaults = F.create_map(F.lit("site"), F.lit("pnq"), F.lit("template_path"), F.lit("none"))
    given = F.map_filter(F.create_map(F.lit("site"), F.col("site"), F.lit("template_path"), F.col("template_path")), lambda _, v: v.isNotNull())
    both = F.map_zip_with(given, defaults, lambda _, a, b: F.coalesce(a, b))
    return rows.select("session_id", both["site"].alias("site"), both["template_path"].alias("template_path"))


def version_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Of the versions named in an error text the one nearest to 18.4.0; ties to the higher."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text").distinct()
    found = rows.select("suggestion_id", F.explode(F.regexp_extract_all("error_text", F.lit("[0-9]{2}[.][0-9][.][0-9]"), 0)).alias("version"))
    d = R.version_distance(F.col("version"), F.lit("18.4.0"))
    v = R.version_parts(F.col("version"))
    rank = F.struct(F.when(v[0] == 18, 0).otherwise(1), d, -(v[0] * 10000 + v[1] * 100 + v[2]))
    return found.groupBy("suggestion_id").agg(F.min_by("version", rank).alias("version"), F.min_by(d, rank).alias("distance"))


def section_references(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses named in sections that exist in the same document, with how often."""
    sections = table(spark, folder, "section_nodes").select("section_key", "doc_id", "section_id", F.array_join("content_lines", "\n").alias("text")).dropDuplicates(["section_key"])
    named = sections.select("doc_id", F.col("section_id").alias("src"), F.explode(F.regexp_extract_all("text", F.lit("[cC]lause ([0-9]+(?:[.][0-9]+)+)"), 1)).alias("dst"))
    there = sections.select("doc_id", F.col("section_id").alias("dst")).distinct()
    return named.where("src <> dst").join(there, ["doc_id", "dst"], "left_semi").groupBy("doc_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def section_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest existing ancestor and level of every section."""
    return G.nearest_ancestor(table(spark, folder, "section_nodes"), ["doc_id"], "section_id").select("doc_id", "section_id", "ancestor", "level")


def section_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """Siblings as membership: each section with its parent and how many share it."""
    rows = table(spark, folder, "section_nodes").where("parent is not null").select("doc_id", "section_id", "parent").distinct()
    return rows.select("doc_id", "section_id", "parent", (F.count(F.lit(1)).over(Window.partitionBy("doc_id", "parent")) - 1).alias("n_siblings"))


def section_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Number of sections below each section, by prefix."""
    base = table(spark, folder, "section_nodes").select("doc_id", "section_id").where("section_id is not null").distinct()
    above = base.select("doc_id", F.explode(G.dotted_prefixes(F.col("section_id"))).alias("section_id")).groupBy("doc_id", "section_id").agg(F.count(F.lit(1)).alias("n"))
    return base.join(above, ["doc_id", "section_id"], "left").select("doc_id", "section_id", F.coalesce("n", F.lit(0)).alias("n_below"))


def section_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Sections that are no one's parent."""
    base = table(spark, folder, "section_nodes").select("doc_id", "section_id", "parent").distinct()
    parents = base.where("parent is not null").select("doc_id", F.col("parent").alias("section_id")).distinct()
    return base.join(parents, ["doc_id", "section_id"], "left_anti").select("doc_id", "section_id").distinct()


def toc_order(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of a document in order of their numbers."""
    base = table(spark, folder, "section_nodes").select("doc_id", "section_id").where("section_id is not null").distinct()
    w = Window.partitionBy("doc_id").orderBy(G.dotted_key(F.col("section_id")), "section_id")
    return base.withColumn("place", F.row_number().over(w))


def compiler_error_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every compiler error with its kind and first symbol."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text").distinct()
    got = R.compiler_errors(T.lines_of(rows, ["suggestion_id"], "error_text"), ["suggestion_id"])
    return got.select("suggestion_id", "line_no", "file_path", "line_number", "column_number", "category", "error_text", F.get("symbols", F.lit(0)).alias("symbol"))


def compiler_error_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of the compiler errors of each text."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text").distinct()
    errors = R.compiler_errors(T.lines_of(rows, ["suggestion_id"], "error_text"), ["suggestion_id"])
    return R.error_clusters(errors, ["suggestion_id"]).select("suggestion_id", "cluster_id", "cluster_key", "category", "n_errors", "min_line")


def compiler_error_files(spark: SparkSession, folder: str) -> DataFrame:
    """Errors by file with the first four messages' count, ten files."""
    errors = compiler_error_rows(spark, folder)
    return errors.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_errors"), F.count_if(F.col("category") == "unknown_type_name").alias("n_types")).orderBy(F.desc("n_errors"), "file_path").limit(10)


def edge_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and nodes of the trade graph by kind."""
    edges = _trade(spark, folder)
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.countDistinct("dst").alias("n_targets"))


def call_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, callers and priority of every function of the backtraces."""
    got = G.degree_rollup(_calls(spark, folder))
    return got.select(F.col("node").alias("function"), F.col("n_out").alias("calls"), F.col("n_in").alias("callers"), T.call_priority(F.col("node"), F.col("n_out"), F.col("n_in")).alias("priority"))


def graph_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes within two hops of region 1 in either direction, with a predecessor."""
    edges = _trade(spark, folder)
    seeds = spark.createDataFrame([("r1",), ("missing",)], "node string")
    return G.bfs(edges, seeds, 2, both=True)


def graph_bfs_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """One direction and one kind of edge only."""
    seeds = spark.createDataFrame([("s1",), ("s2",)], "node string")
    return G.bfs(_trade(spark, folder), seeds, 2, kinds=["in_nation"])


def graph_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Callers and callees of the first function by name, scored by hops."""
    edges = _calls(spark, folder)
    seeds = edges.agg(F.min("src").alias("node"))
    return G.chain_scores(edges, seeds)


def graph_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers that supply parts of supplier 1, with how many."""
    edges = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return G.shared_targets(edges, spark.createDataFrame([(1,)], "node long"))


def hist_fixed_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Events by fifths of the value up to 100; the last bin is closed."""
    rows = table(spark, folder, "events").withColumn("bin", R.fixed_bins(F.col("value"), 20.0, 5))
    return rows.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Best rule of each file for an intent by message names; none where nothing scores."""
    # The messages an intent names.
    wanted = ["CONTEXT SETUP REQUEST", "MEASURE REPORT", "RELEASE COMPLETE"]
    rules = table(spark, folder, "ltm_mapping_rules").select("rule_file_id", F.regexp_replace("rules", "^﻿", "").alias("rules")).distinct()
    pairs = rules.select("rule_file_id", F.explode(F.from_json("rules", "map<string,string>")).alias("rule_key", "body")).where(F.col("rule_key").startswith("User Intent"))
    score = sum((F.when(F.col("body").contains(m), 10).otherwise(0) for m in wanted), F.lit(0))
    w = Window.partitionBy("rule_file_id").orderBy(F.desc("score"), "rule_key")
    return pairs.withColumn("score", score).withColumn("rn", F.row_number().over(w)).where("rn = 1 and score > 0").select("rule_file_id", "rule_key", "score")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each user in batches of six."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    numbered = table(spark, folder, "events").withColumn("batch", F.ceil(F.row_number().over(w) / 6).cast("long"))
    return numbered.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def dominant_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent type of each user; ties to the first by name."""
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "n")


def merge_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a source merged: longest reason, distinct kinds of patch, totals."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "source", F.col("fix_suggestion.reason").alias("reason"), F.size(F.coalesce("fix_suggestion.code_patches", F.array())).alias("n")).dropDuplicates(["suggestion_id"])
    longest = F.max(F.struct(F.length("reason").alias("n"), (-F.col("suggestion_id")).alias("id")))
    return rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_suggestions"), F.sum(F.greatest("n", F.lit(0))).alias("n_patches"), (-longest["id"]).alias("longest_id"))


def patch_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Patches that change something, each once by normalised path, function and code."""
    patch = table(spark, folder, "fix_suggestions").select("suggestion_id", F.posexplode("fix_suggestion.code_patches").alias("pos", "p")).where("p is not null")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[ \t\r\n]+", "")
    rows = patch.select("suggestion_id", "pos", F.col("p.function_name").alias("function_name"), F.col("p.file_path").alias("file_path"), bare(F.col("p.original_code")).alias("o"), bare(F.col("p.patched_code")).alias("n")).distinct()
    rows = rows.where((F.col("n") != "") & (F.col("o") != F.col("n")))
    w = Window.partitionBy("suggestion_id", F.lower("file_path"), "function_name", "o", "n").orderBy("pos")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("suggestion_id", "pos", "function_name", "file_path")


def grounded_patches(spark: SparkSession, folder: str) -> DataFrame:
    """config patches whose value stands in the error text of their suggestion."""
    rows = table(spark, folder, "fix_suggestions").select("suggestion_id", "error_text", F.explode("fix_suggestion.config_patches").alias("p")).where("p.config_name is not null")
    bare = F.regexp_replace(F.coalesce("error_text", F.lit("")), "[ \t\r\n]+", " ")
    return rows.select("suggestion_id", F.col("p.config_name").alias("config_name"), bare.contains(F.col("p.config_name")).alias("grounded")).distinct()


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """F16, 2.9: sizes of union, intersection and differences of customer keys and order keys."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("c", F.lit(1))
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("o", F.lit(1))
    both = c.join(o, "k", "full")
    return both.agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.expr("c = 1 and o = 1")).alias("n_both"), F.count_if(F.expr("o is null")).alias("n_only_customer"), F.count_if(F.expr("c is null")).alias("n_only_order"))


def state_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Q-S2, Q-S3: run state of every user after all events."""
    changes = table(spark, folder, "events").withColumn("note", F.when(F.col("event_type") == "purchase", F.col("props"))).withColumn("kind", F.col("event_type"))
    return S.upsert_latest(changes.withColumn("first_id", F.col("event_id")), ["user_id"], ["event_id"], ["first_id"], ["note"], ["kind"])


def state_stage_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Q-S3, Q-S7: latest row of every session and stage by ingestion."""
    rows = table(spark, folder, "stage_runs").where("session_id is not null").select("session_id", "stage_name", "stage_run_id", "stage_status", F.unix_micros("ingested_at").alias("at"))
    last = F.max(F.struct("at", "stage_run_id", "stage_status"))
    return rows.groupBy("session_id", "stage_name").agg(last.alias("m"), F.min(F.struct("at", "stage_run_id"))["stage_run_id"].alias("first_run_id")).select("session_id", "stage_name", "first_run_id", "m.stage_status")


def state_agent_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Q-S4, Q-S5: completed and failed runs of every agent, first completion kept."""
    rows = table(spark, folder, "agent_runs").dropDuplicates(["agent_run_id"])
    return rows.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("run_status") == "completed").alias("n_completed"), F.count_if(F.col("run_status") == "failed").alias("n_failed"),
        F.count_if(F.col("error_json").isNotNull()).alias("n_errors"), F.min("completed_at").alias("first_completed"),
    )


def status_merge(spark: SparkSession, folder: str) -> DataFrame:
    """ST4, ST5: highest status of every user and milestone."""
    got = S.monotone_status(_status(spark, folder), ["user_id", "milestone"], "status", "event_id")
    return got.select("user_id", "milestone", "status", F.col("at").alias("event_id"))


def status_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Overall status of every user over the last status of its milestones."""
    rows = _status(spark, folder).groupBy("user_id", "milestone").agg(F.max_by("status", "event_id").alias("status"))
    return S.overall_status(rows, ["user_id"], "status")


def progress_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by status and percent completed of every user."""
    return S.progress(_status(spark, folder), ["user_id"], "status")


def open_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Time from each event to the next of the user in microseconds, the last to a fixed end."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = table(spark, folder, "events").withColumn("until", F.coalesce(us(F.lead("ts").over(w)), F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp"))))
    return rows.groupBy("user_id").agg(F.sum(F.col("until") - us(F.col("ts"))).alias("total_us"))


def incremental_sync(spark: SparkSession, folder: str) -> DataFrame:
    """ST7, J10: documents of changed sources replaced; counts after the sync."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    changed = docs.where("source like 'chat/%'").select("source").distinct()
    fresh = docs.where("source like 'chat/%' and n_chars > 300").withColumn("n_chars", F.col("n_chars") + 1)
    return S.incremental_replace(docs, changed, fresh, ["source"]).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def append_once(spark: SparkSession, folder: str) -> DataFrame:
    """ST8, K2, K4: runs appended by key, known keys skipped."""
    rows = table(spark, folder, "agent_runs").select("agent_run_id", "run_status")
    old = rows.where("run_status = 'completed'").dropDuplicates(["agent_run_id"])
    return S.append_unseen(old, rows, "agent_run_id").groupBy("run_status").agg(F.count(F.lit(1)).alias("n"))


def near_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user less than three ids after the last are near-copies; counts kept."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, folder, "events").withColumn("gap", F.col("event_id") - F.lag("event_id").over(w))
    return rows.groupBy("user_id").agg(F.count_if(F.coalesce(F.col("gap") >= 3, F.lit(True))).alias("n_kept"), F.count_if(F.col("gap") < 3).alias("n_near"))


def fallback_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """for each user the events of the first stage that has any."""
    events = table(spark, folder, "events")
    stage = F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    w = Window.partitionBy("user_id")
    return events.withColumn("stage", stage).withColumn("best", F.min("stage").over(w)).where("stage = best").select("user_id", "event_id", "stage")


def template_choice(spark: SparkSession, folder: str) -> DataFrame:
    """first of a priority list that a user has, else the first by name."""
    # Priority of kinds.
    priority = F.array(*[F.lit(x) for x in ("purchase", "signup", "error")])
    kinds = table(spark, folder, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    chosen = F.coalesce(F.get(F.filter(priority, lambda p: F.array_contains("kinds", p)), F.lit(0)), F.get("kinds", F.lit(0)))
    return kinds.select("user_id", chosen.alias("chosen"))


QUERIES = {
    q.__name__: q
    for q in (
        join_first_match, join_ignoring_case, join_path_suffix, join_substring, join_membership, join_earliest_before, join_interval_slice, join_overlay, version_nearest,
        section_references, section_hierarchy, section_siblings, section_descendants, section_leaves, toc_order, compiler_error_rows, compiler_error_clusters, compiler_error_files,
        edge_histogram, call_rollup, graph_bfs, graph_bfs_kinds, graph_chain, graph_shared, hist_fixed_bins, rule_scores, batches, dominant_kind, merge_batches, patch_filter,
        grounded_patches, set_operations, state_upsert, state_stage_runs, state_agent_runs, status_merge, status_overall, progress_summary, open_durations, incremental_sync,
        append_once, near_gap, fallback_ladder, template_choice,
    )
}
