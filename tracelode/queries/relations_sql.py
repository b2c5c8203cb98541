"""SQL twins of the queries in relations."""

from __future__ import annotations

_FRAMES = """
    fr0 AS (SELECT crash_id, unnest(crash_info.backtrace) AS f, generate_subscripts(crash_info.backtrace, 1) - 1 AS pos FROM segmentation_fault_extraction),
    fr AS (SELECT DISTINCT crash_id, pos, f."function" AS fn, f.file AS file FROM fr0 WHERE f IS NOT NULL AND f."function" IS NOT NULL)"""
_CALLS = f"""{_FRAMES},
    nx AS (SELECT fn, lead(fn) OVER (PARTITION BY crash_id ORDER BY pos, fn, file) AS caller FROM fr),
    calls AS (SELECT DISTINCT caller AS src, fn AS dst FROM nx WHERE caller IS NOT NULL AND caller <> fn)"""
_TRADE = """
    edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 'in_nation' AS kind FROM supplier
              UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in_region' FROM nation)"""
_SECTIONS = "sec AS (SELECT DISTINCT doc_id, section_id FROM section_nodes WHERE section_id IS NOT NULL)"
_PREFIXES = """
    pre AS (SELECT doc_id, section_id, array_to_string(string_split(section_id, '.')[1:n], '.') AS ancestor, n
            FROM (SELECT doc_id, section_id, unnest(range(1, len(string_split(section_id, '.')))) AS n FROM sec))"""
_LINES = r"""
    l AS (SELECT suggestion_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no
          FROM (SELECT suggestion_id, string_split(replace(regexp_replace(error_text, '\x1b\[[0-9;]*m', '', 'g'), chr(13), ''), chr(10)) AS parts
                FROM (SELECT DISTINCT suggestion_id, error_text FROM fix_suggestions) WHERE error_text IS NOT NULL)),
    e0 AS (SELECT suggestion_id, line_no, regexp_extract(trim(line), '^(.+?):([0-9]+):(?:([0-9]+):)?\s*(?:fatal )?error:\s*(.+)$', ['file_path', 'ln', 'cn', 'msg']) AS m
           FROM l WHERE regexp_matches(trim(line), '^(.+?):([0-9]+):(?:([0-9]+):)?\s*(?:fatal )?error:\s*(.+)$')),
    errs AS (SELECT suggestion_id, line_no, m.file_path AS file_path, m.ln::INT AS line_number, coalesce(nullif(m.cn, '')::INT, 0) AS column_number,
                CASE WHEN contains(lower(m.msg), 'unknown type name') THEN 'unknown_type_name' WHEN contains(lower(m.msg), 'not a structure or union') THEN 'member_access_on_non_struct'
                     WHEN contains(lower(m.msg), 'incompatible type for argument') THEN 'incompatible_argument_type' WHEN contains(lower(m.msg), 'undeclared') THEN 'undeclared_identifier' ELSE 'compiler_error' END AS category,
                trim(m.msg) AS error_text, regexp_extract_all(m.msg, '[‘'']([^’'']+)[’'']', 1)[1] AS symbol FROM e0)"""
_STATUS = """
    st AS (SELECT *, CASE event_type WHEN 'view' THEN 'not_completed' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'in_progress' END AS status,
                  event_id % 3 AS milestone FROM events)"""
_RANK = "CASE status WHEN 'not_completed' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'completed' THEN 2 ELSE 3 END"
_US = "epoch_us(ts)"

ORACLE = {
    "join_first_match": f"""WITH {_FRAMES}, n AS (SELECT DISTINCT suggestion_id, fn FROM (SELECT suggestion_id, unnest(fix_suggestion.suspected_functions) AS fn FROM fix_suggestions) WHERE fn IS NOT NULL),
        one AS (SELECT fn, min(file) AS file FROM fr WHERE file IS NOT NULL GROUP BY fn)
        SELECT suggestion_id, n.fn AS "function", coalesce(one.file, 'Unknown') AS file FROM n LEFT JOIN one ON n.fn = one.fn""",
    "join_ignoring_case": f"""WITH {_FRAMES} SELECT DISTINCT fn AS "function" FROM (SELECT unnest(fix_suggestion.suspected_functions) AS fn FROM fix_suggestions) n
        WHERE fn IS NOT NULL AND upper(fn) IN (SELECT upper(fn) FROM fr)""",
    "join_path_suffix": f"""WITH {_FRAMES}, p AS (SELECT DISTINCT suggestion_id, p.function_name AS fn, p.file_path AS path FROM (SELECT suggestion_id, unnest(fix_suggestion.code_patches) AS p FROM fix_suggestions) WHERE p.function_name IS NOT NULL AND p.file_path IS NOT NULL),
        n AS (SELECT DISTINCT fn, file FROM fr WHERE file IS NOT NULL), j AS (SELECT suggestion_id, p.fn, path, file, (ends_with(path, file) OR ends_with(file, path)) AS fits FROM p JOIN n ON p.fn = n.fn)
        SELECT suggestion_id, fn AS "function", path, file AS node_path, fits FROM j QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY suggestion_id, fn, path)""",
    "join_substring": "SELECT hint, min(p_partkey) AS p_partkey FROM part JOIN (SELECT unnest(['widget', 'ring', 'red', 'blue', 'bolt']) AS hint) ON contains(lower(p_name), hint) GROUP BY hint",
    "join_membership": """SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS n_with, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_without FROM customer GROUP BY c_mktsegment""",
    "join_earliest_before": """WITH v AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'view' GROUP BY user_id)
        SELECT event_id, e.user_id, CASE WHEN first < event_id THEN first END AS linked FROM events e LEFT JOIN v ON e.user_id = v.user_id WHERE event_type = 'error'""",
    "join_interval_slice": r"""WITH l AS (SELECT file_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n, len(parts) AS total FROM (SELECT file_id, string_split(regexp_replace(log_text, '\x1b\[[0-9;]*m', '', 'g'), chr(10)) AS parts FROM (SELECT DISTINCT file_id, log_text FROM rca_logs)))
        SELECT file_id, n AS first_line, coalesce(lead(n) OVER (PARTITION BY file_id ORDER BY n) - 1, total) AS last_line FROM l WHERE starts_with(line, 'Traceback')""",
    "join_overlay": "SELECT DISTINCT session_id, coalesce(site, 'pnq') AS site, coalesce(template_path, 'none') AS template_path FROM sessions",
    "version_nearest": """WITH v AS (SELECT suggestion_id, unnest(regexp_extract_all(error_text, '[0-9]{2}[.][0-9][.][0-9]')) AS version FROM (SELECT DISTINCT suggestion_id, error_text FROM fix_suggestions)),
        p AS (SELECT *, string_split(version, '.')[1]::INT AS a, string_split(version, '.')[2]::INT AS b, string_split(version, '.')[3]::INT AS c FROM v),
        d AS (SELECT *, CASE WHEN a = 18 THEN abs(b - 4) * 100 + abs(c - 0) ELSE abs(a * 10000 + b * 100 + c - 180400) END AS distance FROM p)
        SELECT suggestion_id, version, distance FROM d QUALIFY row_number() OVER (PARTITION BY suggestion_id ORDER BY (a <> 18), distance, -(a * 10000 + b * 100 + c)) = 1""",
    "section_references": f"""WITH t AS (SELECT section_key, any_value(doc_id) AS doc_id, any_value(section_id) AS src, any_value(array_to_string(list_filter(content_lines, lambda x: x IS NOT NULL), chr(10))) AS text FROM section_nodes GROUP BY section_key),
        r AS (SELECT doc_id, src, unnest(regexp_extract_all(text, '[cC]lause ([0-9]+(?:[.][0-9]+)+)', 1)) AS dst FROM t), {_SECTIONS}
        SELECT r.doc_id, src, dst, count(*) AS n FROM r JOIN sec ON sec.doc_id = r.doc_id AND sec.section_id = r.dst WHERE src <> dst GROUP BY r.doc_id, src, dst""",
    "section_hierarchy": f"""WITH {_SECTIONS}, {_PREFIXES}, a AS (SELECT pre.doc_id, pre.section_id, arg_max(ancestor, n) AS ancestor FROM pre JOIN sec s ON s.doc_id = pre.doc_id AND s.section_id = pre.ancestor GROUP BY pre.doc_id, pre.section_id)
        SELECT sec.doc_id, sec.section_id, ancestor, len(string_split(sec.section_id, '.'))::INT AS level FROM sec LEFT JOIN a ON sec.doc_id = a.doc_id AND sec.section_id = a.section_id""",
    "section_siblings": "SELECT doc_id, section_id, parent, count(*) OVER (PARTITION BY doc_id, parent) - 1 AS n_siblings FROM (SELECT DISTINCT doc_id, section_id, parent FROM section_nodes WHERE parent IS NOT NULL)",
    "section_descendants": "WITH s AS (SELECT DISTINCT doc_id, section_id FROM section_nodes WHERE section_id IS NOT NULL) SELECT a.doc_id, a.section_id, count(b.section_id) AS n_below FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND starts_with(b.section_id, a.section_id || '.') GROUP BY a.doc_id, a.section_id",
    "section_leaves": "SELECT DISTINCT doc_id, section_id FROM section_nodes s WHERE NOT EXISTS (SELECT 1 FROM section_nodes c WHERE c.doc_id = s.doc_id AND c.parent = s.section_id)",
    "toc_order": f"""WITH {_SECTIONS} SELECT doc_id, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(section_id, '.'), lambda x: coalesce(try_cast(x AS INT), -1)), section_id) AS place FROM sec""",
    "compiler_error_rows": f"WITH {_LINES} SELECT suggestion_id, line_no, file_path, line_number, column_number, category, error_text, symbol FROM errs",
    "compiler_error_files": f"""WITH {_LINES} SELECT file_path, count(*) AS n_errors, count(*) FILTER (category = 'unknown_type_name') AS n_types FROM errs GROUP BY file_path ORDER BY n_errors DESC, file_path LIMIT 10""",
    "compiler_error_clusters": f"""WITH {_LINES}, k AS (SELECT *, category || '|' || lower(replace(file_path, '\\', '/')) || '|' || CASE category WHEN 'unknown_type_name' THEN coalesce(symbol, 'unknown') WHEN 'undeclared_identifier' THEN coalesce(symbol, substring(error_text, 1, 80))
                WHEN 'compiler_error' THEN '_|' || line_number ELSE '_|' END AS cluster_key FROM errs),
        g AS (SELECT suggestion_id, cluster_key, category, count(*) AS n_errors, min(line_number) AS min_line, min(line_no) AS first_line FROM k GROUP BY ALL)
        SELECT suggestion_id, 'c' || (row_number() OVER (PARTITION BY suggestion_id ORDER BY first_line, cluster_key) - 1) AS cluster_id, cluster_key, category, n_errors, min_line FROM g""",
    "edge_histogram": f"WITH {_TRADE} SELECT kind, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM edges GROUP BY kind",
    "call_rollup": f"""WITH {_CALLS}, d AS (SELECT node, sum(o) AS calls, sum(i) AS callers FROM (SELECT src AS node, 1 AS o, 0 AS i FROM calls UNION ALL SELECT dst, 0, 1 FROM calls) GROUP BY node)
        SELECT node AS "function", calls::BIGINT AS calls, callers::BIGINT AS callers, round(CASE WHEN regexp_matches(lower(node), 'amf|gnb|ngap|rrc|nas') THEN 10.0 ELSE 0.0 END + CASE WHEN regexp_matches(lower(node), 'error|handle|fail|setup|register') THEN 5.0 ELSE 0.0 END
            + least((calls + callers) * 0.5, 10.0) + CASE WHEN callers > 5 THEN 3.0 ELSE 0.0 END + CASE WHEN calls > 10 THEN 2.0 ELSE 0.0 END, 2)::DOUBLE AS priority FROM d""",
    "graph_bfs": f"""WITH {_TRADE}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
        h1 AS (SELECT dst AS node, min(src) AS via FROM b WHERE src = 'r1' GROUP BY dst),
        h2 AS (SELECT dst AS node, min(src) AS via FROM b WHERE src IN (SELECT node FROM h1) AND dst <> 'r1' AND dst NOT IN (SELECT node FROM h1) GROUP BY dst)
        SELECT 'r1' AS node, 0 AS depth, NULL AS via UNION ALL SELECT node, 1, via FROM h1 UNION ALL SELECT node, 2, via FROM h2""",
    "graph_bfs_kinds": f"""WITH {_TRADE} SELECT DISTINCT src AS node, 0 AS depth, NULL AS via FROM edges WHERE src IN ('s1', 's2')
        UNION ALL SELECT dst, 1, min(src) FROM edges WHERE src IN ('s1', 's2') AND kind = 'in_nation' GROUP BY dst""",
    "graph_shared": """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)
        SELECT src AS node, count(*) AS n_shared FROM e WHERE dst IN (SELECT dst FROM e WHERE src = 1) AND src <> 1 GROUP BY src""",
    "hist_fixed_bins": "SELECT least(floor(value / 20.0), 4)::INT AS bin, count(*) AS n FROM events WHERE value >= 0 AND value <= 100 GROUP BY 1",
    "batches": """SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT user_id, event_id, ceil(row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 6)::BIGINT AS batch FROM events) GROUP BY user_id, batch""",
    "dominant_kind": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "merge_batches": """WITH r AS (SELECT suggestion_id, any_value(source) AS source, any_value(fix_suggestion.reason) AS reason, max(coalesce(len(fix_suggestion.code_patches), 0)) AS n FROM fix_suggestions GROUP BY suggestion_id)
        SELECT coalesce(source, '') AS source, count(*) AS n_suggestions, sum(n)::BIGINT AS n_patches, arg_max(suggestion_id, coalesce(length(reason), -1) * 1000000000 - suggestion_id) AS longest_id FROM r GROUP BY 1""",
    "patch_filter": r"""WITH p AS (SELECT suggestion_id, unnest(fix_suggestion.code_patches) AS p, generate_subscripts(fix_suggestion.code_patches, 1) - 1 AS pos FROM fix_suggestions),
        r AS (SELECT DISTINCT suggestion_id, pos, p.function_name, p.file_path, regexp_replace(coalesce(p.original_code, ''), '[ \t\r\n]+', '', 'g') AS o, regexp_replace(coalesce(p.patched_code, ''), '[ \t\r\n]+', '', 'g') AS n FROM p WHERE p IS NOT NULL)
        SELECT suggestion_id, pos, function_name, file_path FROM r WHERE n <> '' AND o <> n QUALIFY row_number() OVER (PARTITION BY suggestion_id, lower(file_path), function_name, o, n ORDER BY pos) = 1""",
    "grounded_patches": r"""WITH p AS (SELECT suggestion_id, error_text, unnest(fix_suggestion.config_patches) AS p FROM fix_suggestions)
        SELECT DISTINCT suggestion_id, p.config_name AS config_name, contains(regexp_replace(coalesce(error_text, ''), '[ \t\r\n]+', ' ', 'g'), p.config_name) AS grounded FROM p WHERE p.config_name IS NOT NULL""",
    "set_operations": """SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS n_union, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS n_both,
        (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_only_customer, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS n_only_order""",
    "state_upsert": "SELECT user_id, min(event_id) AS first_id, arg_max(props, event_id) FILTER (event_type = 'purchase') AS note, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id",
    "state_stage_runs": """WITH r AS (SELECT session_id, stage_name, stage_run_id, stage_status, ingested_at FROM stage_runs WHERE session_id IS NOT NULL)
        SELECT session_id, stage_name, first(stage_run_id ORDER BY ingested_at, stage_run_id) AS first_run_id, last(stage_status ORDER BY ingested_at, stage_run_id, stage_status) AS stage_status FROM r GROUP BY session_id, stage_name""",
    "state_agent_runs": """WITH r AS (SELECT agent_run_id, any_value(agent_name) AS agent_name, any_value(run_status) AS run_status, any_value(error_json) AS error_json, any_value(completed_at) AS completed_at FROM agent_runs GROUP BY agent_run_id)
        SELECT agent_name, count(*) AS n_runs, count(*) FILTER (run_status = 'completed') AS n_completed, count(*) FILTER (run_status = 'failed') AS n_failed, count(error_json) AS n_errors, min(completed_at) AS first_completed FROM r GROUP BY agent_name""",
    "status_merge": f"WITH {_STATUS} SELECT user_id, milestone, status, event_id FROM st QUALIFY row_number() OVER (PARTITION BY user_id, milestone ORDER BY {_RANK} DESC, event_id DESC) = 1",
    "status_overall": f"""WITH {_STATUS}, m AS (SELECT user_id, milestone, arg_max(status, event_id) AS status FROM st GROUP BY user_id, milestone)
        SELECT user_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'in_progress') THEN 'in_progress' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'not_completed' END AS overall FROM m GROUP BY user_id""",
    "progress_summary": f"""WITH {_STATUS} SELECT user_id, count(*) AS n, count(*) FILTER (status = 'not_completed') AS n_not_completed, count(*) FILTER (status = 'in_progress') AS n_in_progress, count(*) FILTER (status = 'completed') AS n_completed,
        count(*) FILTER (status = 'failed') AS n_failed, round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 2)::DOUBLE AS percent FROM st GROUP BY user_id""",
    "open_durations": f"""SELECT user_id, sum(until - {_US})::BIGINT AS total_us FROM (SELECT user_id, ts, coalesce(lead({_US}) OVER (PARTITION BY user_id ORDER BY event_id), epoch_us(TIMESTAMP '2024-02-01 00:00:00')) AS until FROM events) GROUP BY user_id""",
    "incremental_sync": """SELECT coalesce(source, '') AS source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM (
            SELECT source, n_chars FROM documents WHERE source IS NULL OR source NOT LIKE 'chat/%' UNION ALL SELECT source, n_chars + 1 FROM documents WHERE source LIKE 'chat/%' AND n_chars > 300) GROUP BY 1""",
    "append_once": """WITH r AS (SELECT agent_run_id, any_value(run_status) AS run_status FROM agent_runs GROUP BY agent_run_id) SELECT run_status, count(*) AS n FROM r GROUP BY run_status""",
    "near_gap": """WITH g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events)
        SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= 3) AS n_kept, count(*) FILTER (gap < 3) AS n_near FROM g GROUP BY user_id""",
    "fallback_ladder": """WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND value > 90 THEN 1 WHEN event_type = 'purchase' THEN 2 ELSE 3 END AS stage FROM events)
        SELECT user_id, event_id, stage FROM s QUALIFY stage = min(stage) OVER (PARTITION BY user_id)""",
    "template_choice": """WITH k AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN list_contains(kinds, 'purchase') THEN 'purchase' WHEN list_contains(kinds, 'signup') THEN 'signup' WHEN list_contains(kinds, 'error') THEN 'error' ELSE kinds[1] END AS chosen FROM k""",
    "rule_scores": """WITH r AS (SELECT DISTINCT rule_file_id, ltrim(rules, chr(65279)) AS rules FROM ltm_mapping_rules WHERE json_valid(ltrim(rules, chr(65279))) AND json_type(ltrim(rules, chr(65279))) = 'OBJECT'),
        k AS (SELECT rule_file_id, rules, unnest(json_keys(rules)) AS rule_key FROM r),
        s AS (SELECT rule_file_id, rule_key, list_sum([CASE WHEN contains(json_extract(rules, '$."' || rule_key || '"')::VARCHAR, m) THEN 10 ELSE 0 END FOR m IN ['CONTEXT SETUP REQUEST', 'MEASURE REPORT', 'RELEASE COMPLETE']])::INT AS score
              FROM k WHERE starts_with(rule_key, 'User Intent'))
        SELECT rule_file_id, rule_key, score FROM s QUALIFY row_number() OVER (PARTITION BY rule_file_id ORDER BY score DESC, rule_key) = 1 AND score > 0""",
}
ORACLE["graph_chain"] = f"""WITH {_CALLS}, seed AS (SELECT min(src) AS node FROM calls),
    up1 AS (SELECT DISTINCT src AS node FROM calls WHERE dst IN (SELECT node FROM seed) AND src NOT IN (SELECT node FROM seed)),
    up2 AS (SELECT DISTINCT src AS node FROM calls WHERE dst IN (SELECT node FROM up1) AND src NOT IN (SELECT node FROM seed UNION ALL SELECT node FROM up1)),
    dn1 AS (SELECT DISTINCT dst AS node FROM calls WHERE src IN (SELECT node FROM seed) AND dst NOT IN (SELECT node FROM seed)),
    dn2 AS (SELECT DISTINCT dst AS node FROM calls WHERE src IN (SELECT node FROM dn1) AND dst NOT IN (SELECT node FROM seed UNION ALL SELECT node FROM dn1)),
    s AS (SELECT node, 0.95 AS score, 'seed' AS role FROM seed UNION ALL SELECT node, 0.7, 'caller' FROM up1 UNION ALL SELECT node, 0.6, 'caller' FROM up2 UNION ALL SELECT node, 0.6, 'callee' FROM dn1 UNION ALL SELECT node, 0.5, 'callee' FROM dn2)
    SELECT node, score::DOUBLE AS score, role FROM s QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, role) = 1"""
