"""Graphs of capsules: call graph, breadth-first search, expansion from seeds, relation filters.

Edges are (src, dst, type); a search keeps one frontier of (seed, node) for all seeds and joins it with the edges
once per level, dropping what was seen, so its cost is that of the nodes reached.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators import running


def names(capsules: DataFrame, last: bool = True) -> DataFrame:
    """(name, target): the capsule that a name means, the last (or first) in the order of capsules."""
    order = F.struct("file_path", "start_line", "seq")
    return capsules.groupBy("name").agg((F.max_by if last else F.min_by)("id", order).alias("target"))


def call_edges(capsules: DataFrame, per_file: bool = False) -> DataFrame:
    """An edge for each call that names a capsule, repeats kept; per_file resolves names within a file only."""
    calls = capsules.select("id", "file_path", F.posexplode("calls").alias("pos", "name"))
    if per_file:
        own = capsules.groupBy("file_path", "name").agg(F.max_by("id", F.struct("start_line", "seq")).alias("target"))
        hit = calls.join(own, ["file_path", "name"])
    else:
        hit = calls.join(names(capsules), "name")
    return hit.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("LLAMA").alias("type"), "pos")


def called_by(capsules: DataFrame, per_file: bool = False) -> DataFrame:
    """(id, called_by): sorted distinct ids of the callers."""
    return call_edges(capsules, per_file).groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("called_by"))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, level): nodes reached over out-edges and the fewest steps to them; a seed is level 0.

    seeds has one column, seed. Each level is one join of the frontier with the edges and one anti-join.
    """
    out = edges.select("src", "dst").distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("level")).distinct()
    front = seen
    for level in range(1, depth + 1):
        step = front.join(out, front.node == out.src).select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def subgraph(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the node table that a search reaches, with their level, and the distinct edges out of nodes above the depth."""
    reach = bfs(edges, seeds, depth).groupBy("node").agg(F.min("level").alias("level"))
    inside = reach.join(nodes, reach.node == nodes.id).drop("node")
    used = edges.join(reach.where(F.col("level") < depth), edges.src == F.col("node")).select("src", "type", "dst").distinct()
    return inside, used


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 200) -> DataFrame:
    """Nodes reached from seeds (seed, place), seed by seed, up to and including the seed that takes the total over most.

    (id, place, level): the first seed that reaches a node, and the steps from it. Unknown seeds are skipped.
    """
    known = seeds.join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi")
    reach = bfs(edges, known, depth).join(known, "seed")
    first = reach.groupBy("node").agg(F.min(F.struct("place", "level")).alias("f")).select(F.col("node").alias("id"), "f.place", "f.level")
    first = first.join(nodes.select("id"), "id", "left_semi")
    totals = known.select("place").distinct().join(first.groupBy("place").agg(F.count("*").alias("n")), "place", "left")
    return first.join(running.within(totals, "place", F.coalesce("n", F.lit(0)), most - 1, past=True).select("place"), "place")


def filter_by_relation(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges of the given types, and the nodes that these touch or that are seeds."""
    kept = edges.where(F.col("type").isin(types))
    touched = kept.select(F.col("src").alias("id")).union(kept.select("dst")).union(seeds.select("seed")).distinct()
    return nodes.join(touched, "id", "left_semi"), kept


def find_by_name(nodes: DataFrame, query: str, most: int = 5) -> DataFrame:
    return nodes.where(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("id").limit(most)
