"""Graphs as edge tables (src, dst, kind): building, rolling up and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.session import cut_lineage


def edge_union(*edges: DataFrame) -> DataFrame:
    """Distinct edges of several tables."""
    out = edges[0].select("src", "dst", "kind")
    for e in edges[1:]:
        out = out.unionByName(e.select("src", "dst", "kind"))
    return out.where("src is not null and dst is not null").distinct()


def merged_kinds(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst) with its kinds in order."""
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def with_inverse(edges: DataFrame, names: dict[str, str]) -> DataFrame:
    """edges and their inverses under the given names; kinds without a name are symmetric."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("kind")], F.col("kind")) if names else F.col("kind")
    return edge_union(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), kind.alias("kind")))


def degree_rollup(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of every node of the edges."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, both: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(node, depth, via): nodes within depth hops of the seeds, with the least depth and the
    smallest predecessor one hop nearer; seeds at 0.

    seeds has a column node; seeds outside the graph are dropped.  Each hop joins the frontier
    with the edges and leaves out what was seen; the lineage is cut in the shared folder after
    each hop, so a lost executor costs one hop at most.
    """
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    e = e.select("src", "dst").where("src is not null and dst is not null").distinct()
    if both:
        e = e.union(e.select("dst", "src")).distinct()
    known = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    seen = cut_lineage(seeds.select("node").distinct().join(known, "node", "left_semi").select("node", F.lit(0).alias("depth"), F.lit(None).cast(e.schema["src"].dataType).alias("via")))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = (
            e.join(frontier.select(F.col("node").alias("src")), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("src").alias("via"))
            .join(seen.select("node"), "node", "left_anti")
            .select("node", F.lit(hop).alias("depth"), "via")
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def chain_scores(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, score, role): walk of two hops to callers and callees of the seeds, best score of
    each node kept; of equal scores the smaller role."""
    # Score by direction and hop.
    up = bfs(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"), seeds, 2)
    down = bfs(edges, seeds, 2)
    score = lambda near, far: F.when(F.col("depth") == 0, 0.95).when(F.col("depth") == 1, near).otherwise(far)
    both = up.select("node", score(0.7, 0.6).alias("score"), F.when(F.col("depth") == 0, "seed").otherwise("caller").alias("role")).unionByName(
        down.select("node", score(0.6, 0.5).alias("score"), F.when(F.col("depth") == 0, "seed").otherwise("callee").alias("role"))
    )
    w = Window.partitionBy("node").orderBy(F.desc("score"), "role")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def shared_targets(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, n_shared): nodes that share targets with the seeds, with how many they share.

    Two equi-joins through the shared target; pairs are added up and never listed.
    """
    targets = edges.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("dst").distinct()
    others = edges.join(targets, "dst", "left_semi").select("src", "dst").distinct()
    return others.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_shared")).join(seeds.select("node").distinct(), "node", "left_anti")


def dotted_prefixes(section: Column) -> Column:
    """array<string>: the proper prefixes of a dotted id, longest first."""
    parts = F.split(section, "[.]")
    return F.when(F.size(parts) > 1, F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ".")))).otherwise(
        F.array().cast("array<string>")
    )


def dotted_key(section: Column) -> Column:
    """array<int> by which dotted ids sort as numbers."""
    return F.transform(F.split(section, "[.]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


def nearest_ancestor(sections: DataFrame, keys: list[str], section: str) -> DataFrame:
    """(keys, section, ancestor, level): the longest existing proper prefix of every dotted id."""
    base = sections.select(*keys, section).where(F.col(section).isNotNull()).distinct()
    wanted = base.select(*keys, section, F.posexplode(dotted_prefixes(F.col(section))).alias("nearness", "ancestor"))
    found = wanted.join(base.select(*keys, F.col(section).alias("ancestor")), [*keys, "ancestor"]).groupBy(*keys, section).agg(F.min_by("ancestor", "nearness").alias("ancestor"))
    return base.join(found, [*keys, section], "left").withColumn("level", F.size(F.split(section, "[.]")))
