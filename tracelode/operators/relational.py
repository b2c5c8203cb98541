"""Joins and roll-ups that the built-in operators state in a few lines, under the name of what
they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rows: DataFrame, lookup: DataFrame, key: str, order: str, columns: list[str], defaults: dict[str, object]) -> DataFrame:
    """rows with columns of the first row of lookup for their key, or defaults."""
    w = Window.partitionBy(key).orderBy(order)
    one = lookup.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(key, *columns)
    joined = rows.join(one, key, "left")
    for c, value in defaults.items():
        joined = joined.withColumn(c, F.coalesce(c, F.lit(value)))
    return joined


def suffix_match(rows: DataFrame, nodes: DataFrame, name: str, path: str, node_path: str) -> DataFrame:
    """rows joined with nodes of the same name whose paths are equal or one the end of the other;
    where no path fits, all nodes of the name are kept."""
    joined = rows.join(nodes, name)
    fits = F.coalesce(F.col(path).endswith(F.col(node_path)) | F.col(node_path).endswith(F.col(path)), F.lit(False))
    w = Window.partitionBy(*rows.columns)
    return joined.withColumn("fits", fits).withColumn("__any", F.max(F.col("fits").cast("int")).over(w)).where((F.col("__any") == 0) | F.col("fits")).drop("__any")


def earliest_before(rows: DataFrame, earlier: DataFrame, keys: list[str], at: str, earlier_at: str, earlier_id: str) -> DataFrame:
    """rows with the id of the earliest row of earlier with the same keys, if it came before."""
    first = earlier.groupBy(*keys).agg(F.min_by(earlier_id, earlier_at).alias("linked"), F.min(earlier_at).alias("linked_at"))
    joined = rows.join(first, keys, "left")
    before = F.col("linked_at") < F.col(at)
    return joined.withColumn("linked", F.when(before, F.col("linked"))).drop("linked_at")


def fixed_bins(value: Column, width: float, n: int) -> Column:
    """0 to n - 1; the last bin is closed, values outside have none."""
    return F.when((value >= 0) & (value <= width * n), F.least(F.floor(value / width), F.lit(n - 1)).cast("int"))


def version_parts(version: Column) -> Column:
    """array<int> of a dotted version."""
    return F.transform(F.split(version, "[.]"), lambda p: p.try_cast("int"))


def version_distance(version: Column, target: Column) -> Column:
    """Distance of two versions of three parts: within a major 100 a minor and 1 a patch, else the
    difference of 10,000 a major, 100 a minor and 1 a patch."""
    v, t = version_parts(version), version_parts(target)
    near = F.abs(v[1] - t[1]) * 100 + F.abs(v[2] - t[2])
    far = F.abs((v[0] * 10000 + v[1] * 100 + v[2]) - (t[0] * 10000 + t[1] * 100 + t[2]))
    return F.when(v[0] == t[0], near).otherwise(far)


def error_category(message: Column) -> Column:
    """Kind of a compiler error by its wording."""
    low = F.lower(message)
    return (
        F.when(low.contains("unknown type name"), "unknown_type_name")
        .when(low.contains("not a structure or union"), "member_access_on_non_struct")
        .when(low.contains("incompatible type for argument"), "incompatible_argument_type")
        .when(low.contains("undeclared"), "undeclared_identifier")
        .otherwise("compiler_error")
    )


def compiler_errors(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each compiler error of the lines: place, message, kind, quoted symbols and the
    function named last for the same file."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # How compilers write a context and an error.
    context = r"^(.+?):\s*In function [‘'](.+?)[’']:"
    error = r"^(.+?):([0-9]+):(?:([0-9]+):)?\s*(?:fatal )?error:\s*(.+)$"
    line = F.trim("line")
    named = F.when(line.rlike(context), F.struct(F.regexp_extract(line, context, 1).alias("file"), F.regexp_extract(line, context, 2).alias("name")))
    part = lambda i: F.regexp_extract(line, error, i)
    got = lines.withColumn("ctx", F.last(named, ignorenulls=True).over(w)).where(line.rlike(error))
    message = F.trim(part(4))
    return got.select(
        *keys,
        "line_no",
        part(1).alias("file_path"),
        part(2).cast("int").alias("line_number"),
        F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)).alias("column_number"),
        F.when(F.col("ctx.file") == part(1), F.col("ctx.name")).alias("function_name"),
        message.alias("error_text"),
        error_category(message).alias("category"),
        F.slice(F.regexp_extract_all(message, F.lit("[‘']([^’']+)[’']"), 1), 1, 8).alias("symbols"),
    )


def error_clusters(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of compiler errors by a key that depends on their kind, numbered by first place."""
    symbol = F.get("symbols", F.lit(0))
    function = F.coalesce("function_name", F.lit("_"))
    path = F.lower(F.replace("file_path", F.lit("\\"), F.lit("/")))
    by_kind = (
        F.when(F.col("category") == "unknown_type_name", F.coalesce(symbol, F.lit("unknown")))
        .when(F.col("category") == "undeclared_identifier", F.coalesce(symbol, F.substring("error_text", 1, 80)))
        .when(F.col("category") == "member_access_on_non_struct", F.concat_ws("|", function, F.regexp_extract("error_text", "(?i)request for member [‘']([^’']+)[’']", 1)))
        .when(F.col("category") == "incompatible_argument_type", F.concat_ws("|", function, F.regexp_extract("error_text", r"(?i)argument\s+[0-9]+\s+of\s+[‘']([^’']+)[’']", 1)))
        .otherwise(F.concat_ws("|", function, F.col("line_number").cast("string")))
    )
    grouped = (
        errors.withColumn("cluster_key", F.concat_ws("|", F.col("category"), path, by_kind))
        .groupBy(*keys, "cluster_key", "category")
        .agg(F.count(F.lit(1)).alias("n_errors"), F.min("line_number").alias("min_line"), F.min("line_no").alias("first_line"), F.array_sort(F.collect_set("function_name")).alias("functions"))
    )
    w = Window.partitionBy(*keys).orderBy("first_line", "cluster_key")
    return grouped.withColumn("cluster_id", F.concat(F.lit("c"), (F.row_number().over(w) - 1).cast("string")))
