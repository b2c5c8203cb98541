from __future__ import annotations

from tracelode.queries import sources as Q


def test_all_settings_of_notes_come_out(spark, tmp_path):
    note = "# cell_list = 9\ncell_list = [1, 2]\nenable_x: \"yes\"\ncu_port = 5 ; own\npagingPriority=7\n\nno setting here"
    docs = spark.createDataFrame([(1, "config_note", note), (2, "report", "a = 1"), (3, "config_note", None)], "doc_id long, doc_type string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["line_no"], r["name"], r["value"]) for r in Q.conf_settings(spark, str(tmp_path)).collect())
    assert got == [(1, 2, "cell_list", "[1, 2]"), (1, 3, "enable_x", "yes"), (1, 4, "cu_port", "5"), (1, 5, "pagingPriority", "7")]


def test_marks_tabs_and_odd_line_ends_lose_no_setting(spark, tmp_path):
    note = "\ufeffcu_port = 5\n\tdu_port = 6\t\nxn_log_level = a\u2028b # c\u2028d\nname = \u0085\nquoted = 'it\"\nlast = \"x\";\r\n\t# no = 1\n\ufeff\n"
    spark.createDataFrame([(1, "config_note", note)], "doc_id long, doc_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["line_no"], r["name"], r["value"]) for r in Q.conf_settings(spark, str(tmp_path)).collect())
    assert got == [(1, "cu_port", "5"), (2, "du_port", "6"), (3, "xn_log_level", "a\u2028b"), (4, "name", "\u0085"), (5, "quoted", "'it\""), (6, "last", "x")]


def test_counts_are_of_the_whole_body(spark, tmp_path):
    code = "int f(void)\n{\n" + "".join(f"  int v{i} = {i};\n" for i in range(30)) + "}\n"
    spark.createDataFrame([(1, "code_comment", code)], "doc_id long, doc_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["name"], r["n_locals"]) for r in Q.code_functions(spark, str(tmp_path)).collect()] == [("f", 30)]
    lines = ["Long-Type ::= SEQUENCE {", *[f"  field{i:04d}  INTEGER (0..65535)," for i in range(800)], "}"]
    spark.createDataFrame([("s", lines)], "section_key string, content_lines array<string>").write.parquet(f"{tmp_path}/section_nodes.parquet")
    assert [(r["name"], r["n_lines"]) for r in Q.asn1_definitions(spark, str(tmp_path)).collect()] == [("Long-Type", 802)]
