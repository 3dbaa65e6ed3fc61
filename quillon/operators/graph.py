"""Call graph: callers, callees, bounded reachability and statistics, all on names without case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row tables in one row."""
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def name_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs of lower-case names."""
    return edges.select(F.lower("caller_name").alias("src"), F.col("callee_lc").alias("dst")).distinct()


def reach(edges: DataFrame, start: str, depth: int = 1, direction: str = "out") -> DataFrame:
    """name, depth of what is called from start (direction out) or calls it (in) within depth steps, nearest depth each.

    Breadth first: every round joins the newest names with the edges once and leaves out what is known. The start is no result.
    """
    pairs = name_edges(edges)
    pairs = cut(pairs if direction == "out" else pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start.lower(), 0)], "name string, depth int")
    newest = seen
    for d in range(1, max(1, int(depth)) + 1):
        step = pairs.join(newest.select(F.col("name").alias("src")), "src").select(F.col("dst").alias("name")).distinct()
        newest = cut(step.join(seen, "name", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(newest)
    return seen.where("depth > 0")


def defined(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that define the names found."""
    nodes = chunks.select(F.lower("symbol_name").alias("name"), "symbol_name", "relative_path", "start_line").distinct()
    return names.join(nodes, "name").select("symbol_name", "relative_path", "start_line", "depth")


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes with at least one call or caller, and calls counted one by one."""
    ends = edges.select(F.lower("caller_name").alias("n")).union(edges.select("callee_lc")).distinct()
    return one_row(edges.agg(F.count(F.lit(1)).alias("edges")), ends.agg(F.count(F.lit(1)).alias("nodes")))
