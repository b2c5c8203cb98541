from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from tracelode.functions.scalars import readable_json
from tracelode.queries import texts as Q


def test_every_json_column_is_checked(spark, tmp_path):
    made = {
        "sessions": ("session_id string, resolved_summary_json string, ambiguity_questions_json string", [("a", "{}", "{bad"), ("a", "{}", "{bad"), ("b", None, "[1]")]),
        "stage_runs": ("stage_run_id string, output_json string, input_summary_json string", [("s", "{", None)]),
        "agent_runs": ("agent_run_id string, input_json string, output_json string, error_json string", [("r", "1", '"x', None)]),
        "code_validations": ("validation_id string, results_json string, status_messages_json string", [("v", "[", "[]")]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["table_name"], r["column_name"]): (r["n_null"], r["n_read"], r["n_bad"]) for r in Q.text_json_checked(spark, str(tmp_path)).collect()}
    assert got == {
        ("sessions", "resolved_summary_json"): (1, 1, 0), ("sessions", "ambiguity_questions_json"): (0, 1, 1), ("stage_runs", "output_json"): (0, 0, 1),
        ("stage_runs", "input_summary_json"): (1, 0, 0), ("agent_runs", "input_json"): (0, 1, 0), ("agent_runs", "output_json"): (0, 0, 1),
        ("agent_runs", "error_json"): (1, 0, 0), ("code_validations", "results_json"): (0, 0, 1), ("code_validations", "status_messages_json"): (0, 1, 0),
    }


READ = ['{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 2}}', "null", "1", '"]"', " {} \n", "[]", '{"v": [1, {"x": null}]}', "NaN"]
BAD = ["", " ", "{} {}", '{"a": 1} cut off', '{"a": 1}}', "[1],[2]", "1],[2", "1, 2", '1},{"v": 2', '1, "v": 2', "{'a': 1}", "{a: 1}", "01", "\ufeff{}", "// c\n{}"]


def test_a_json_value_is_read_to_its_end_and_may_repeat_a_key(spark):
    """As json_valid of the SQL has it."""
    df = spark.createDataFrame([(v,) for v in [*READ, *BAD, None]], "v string").select("v", readable_json(F.col("v")).alias("ok"))
    assert {r["v"] for r in df.collect() if r["ok"]} == set(READ)
    con = duckdb.connect()
    assert [v for v in [*READ, *BAD] if con.execute("SELECT json_valid(?::VARCHAR)", [v]).fetchone()[0]] == READ


def test_repeated_keys_and_trailing_text_in_a_column(spark, tmp_path):
    summaries = [(str(i), v) for i, v in enumerate([*READ, *BAD, None])]
    for name, columns in {"sessions": "session_id", "stage_runs": "stage_run_id", "agent_runs": "agent_run_id", "code_validations": "validation_id"}.items():
        spark.createDataFrame(summaries, f"{columns} string, resolved_summary_json string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = Q.text_json_checked(spark, str(tmp_path)).where("table_name = 'sessions'").select("n_null", "n_read", "n_bad").collect()
    rows = duckdb.connect()
    rows.execute(f"CREATE VIEW sessions AS SELECT * FROM '{tmp_path}/sessions.parquet/*.parquet'")
    assert [tuple(r) for r in got] == rows.execute(Q.ORACLE["text_json_checked"]).fetchall() == [(1, len(READ), len(BAD))]
