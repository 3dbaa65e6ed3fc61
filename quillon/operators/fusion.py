"""Hybrid search: file, text, BM25, vector and graph signals merged into one ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import bm25, vectors
from quillon.operators.graph import name_edges
from quillon.operators.search import find_files, substring_chunks

WEIGHTS = {"fff": 0.3, "vector": 0.5, "graph": 0.2, "bm25": 0.35}
SOURCES = ["fff", "text", "bm25", "vector", "graph"]


def _signal(rows: DataFrame, slot: str, source: str, score: Column) -> DataFrame:
    return rows.select("chunk_id", F.lit(slot).alias("slot"), F.lit(source).alias("source"), score.alias("score"))


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), "relative_path", "symbol_name", "start_line")


def merge_signals(signals: DataFrame, limit: int) -> DataFrame:
    """(chunk_id, slot, source, score) -> ranked hits: the maximum per slot, at least 0; slots are summed; sources in a fixed order."""
    slots = [F.greatest(F.lit(0.0), F.max(F.when(F.col("slot") == s, F.col("score")))).alias(f"{s}_score") for s in WEIGHTS]
    merged = signals.groupBy("chunk_id").agg(*[F.coalesce(c, F.lit(0.0)).alias(f"{s}_score") for s, c in zip(WEIGHTS, slots, strict=True)], F.collect_set("source").alias("found"))
    total = reduce(lambda a, b: a + b, [F.col(f"{s}_score") for s in WEIGHTS])
    rounded = [F.round(f"{s}_score", 6).alias(f"{s}_score") for s in WEIGHTS]
    sources = F.filter(F.array(*[F.lit(s) for s in SOURCES]), lambda s: F.array_contains("found", s)).alias("sources")
    hits = merged.select("chunk_id", F.round(total, 6).alias("score"), *rounded, sources)
    best = hits.orderBy(F.desc("score"), "chunk_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "chunk_id")))  # over at most limit rows


def hybrid_signals(chunks: DataFrame, query: str, limit: int, vector_rows: DataFrame | None = None, query_vector: list[float] | None = None, edges: DataFrame | None = None, frecency: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All candidates of a query with their weighted scores by slot."""
    w = WEIGHTS
    keyed = chunks.withColumn("chunk_id", F.col("id"))
    files = find_files(chunks.select(F.col("relative_path").alias("path")).distinct(), query, limit * 3, frecency)
    by_file = keyed.join(files.select(F.col("path").alias("relative_path"), "rank", "n"), "relative_path")
    parts = [_signal(by_file, "fff", "fff", (1 - F.col("rank") / F.col("n")) * w["fff"])]
    parts.append(_signal(substring_chunks(keyed, query), "fff", "text", F.lit(0.5 * w["fff"])))
    texts = bm25.search(chunks, query, limit=limit * 5, index=index).withColumnRenamed("key", "chunk_id")
    most = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(1.1920929e-7))  # over at most 5 x limit rows
    parts.append(_signal(texts.withColumn("score", F.col("score") / most), "bm25", "bm25", F.col("score") * w["bm25"]))
    if vector_rows is not None and query_vector is not None:
        near = vectors.top_k(vector_rows, "chunk_id", query_vector, limit * 5)
        parts.append(_signal(near, "vector", "vector", F.col("score") * w["vector"]))
    if edges is not None:
        name = query.lower()
        pairs = name_edges(edges)
        around = pairs.where(F.col("dst") == name).select(F.col("src").alias("name")).union(pairs.where(F.col("src") == name).select("dst")).distinct()
        known = pairs.where((F.col("dst") == name) | (F.col("src") == name)).limit(1).select(F.lit(name).alias("name"))
        lower = keyed.withColumn("name", F.lower("symbol_name"))
        parts.append(_signal(lower.join(around, "name"), "graph", "graph", F.lit(0.8 * w["graph"])))
        parts.append(_signal(lower.join(known, "name"), "graph", "graph", F.lit(1.0 * w["graph"])))
    return reduce(lambda a, b: a.unionByName(b), parts)


def hybrid_search(chunks: DataFrame, query: str, limit: int = 20, path: str | None = None, prefilter: bool = False, **sources) -> DataFrame:
    """Ranked hits of a query over chunks(id, relative_path, symbol_name, content, ...), which may repeat rows.

    path keeps hits whose path contains it, after ranking (fewer than limit may be left) or, with prefilter, before. Vectors of unknown
    chunks stay, without chunk columns.
    """
    if path and prefilter:
        chunks = chunks.where(F.contains("relative_path", F.lit(path)))
    hits = merge_signals(hybrid_signals(chunks, query, limit, **sources), limit)
    shown = hits.join(_named(chunks), "chunk_id", "left").distinct()  # limit rows, and their repetitions
    return shown.where(F.contains("relative_path", F.lit(path))) if path and not prefilter else shown


def semantic_search(chunks: DataFrame, vector_rows: DataFrame, query_vector: list[float], limit: int = 20) -> DataFrame:
    """The nearest vectors with their chunks where known; the score is the plain cosine."""
    near = vectors.top_k(vector_rows, "chunk_id", query_vector, limit)
    return near.join(_named(chunks), "chunk_id", "left").distinct()
