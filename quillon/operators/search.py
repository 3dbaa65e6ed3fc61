"""Look-ups over chunks and files: substring, symbol, file, grep, fuzzy paths, paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import has_regex_marks, lines_of, search_blob


def substring_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks whose symbol, path or content contains the query, without case; an empty query matches all."""
    return chunks.where(F.contains(search_blob(F.col("symbol_name"), F.col("relative_path"), F.col("content")), F.lit(query.lower())))


def by_symbol(chunks: DataFrame, symbol: str) -> DataFrame:
    return chunks.where(F.lower("symbol_name") == symbol.lower())


def by_id(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.where(F.col("id") == key)


def of_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("relative_path") == path).orderBy("start_line", "id")


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page with total and has_more on each of its rows."""
    total = rows.count()
    part = rows.orderBy(*order).offset(offset).limit(limit)
    return part.withColumn("total", F.lit(total).cast("bigint")).withColumn("has_more", F.lit(total > offset + limit))


def get_chunks(chunks: DataFrame, path: str | None = None, query: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a file's chunks, or else of the chunks containing a query."""
    if path is None and query is None:
        raise ValueError("give a path or a query")
    found = chunks.where(F.col("relative_path") == path) if path is not None else substring_chunks(chunks, query)
    return page(found, ["relative_path", "start_line", "id"], limit, offset)


def line_predicate(line: Column, query: str) -> Column:
    """Regular expression if the query has such marks, literal otherwise; case counts only if the query has upper case."""
    insensitive = query == query.lower()
    if has_regex_marks(query):
        re.compile(query)
        return line.rlike(("(?i)" if insensitive else "") + query)
    return F.contains(F.lower(line) if insensitive else line, F.lit(query))


def grep(files: DataFrame, query: str, per_file: int = 10, max_bytes: int = 10 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, line_number, line of matching lines, trimmed, the first per_file of each row of files; larger files are left out.

    Lines are matched and cut within a row, so nothing is moved. keep: further columns of files to carry along.
    """
    lines = F.transform(lines_of(F.col("content")), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("raw")))
    hits = F.filter(lines, lambda x: line_predicate(x.raw, query))
    found = files.where(F.octet_length("content") <= max_bytes).select("path", *keep, F.inline(F.slice(hits, 1, per_file)))
    return found.select("path", *keep, "line_number", F.trim(F.col("raw"), F.lit(" \t\r")).alias("line"))


def fuzzy_score(path: Column, query: str) -> Column:
    """Null if the query's letters do not occur in order. Otherwise 100 less what the nearest of path, name and stem differs, with
    bonuses for containing the query: 60 in the name, 30 elsewhere, 40 for the whole stem."""
    q = query.lower().replace(" ", "")
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    in_order = low.rlike(".*".join(re.escape(c) for c in q)) if q else F.lit(True)
    bonus = F.when(F.contains(name, F.lit(q)), 60).when(F.contains(low, F.lit(q)), 30).otherwise(0) + F.when(stem == q, 40).otherwise(0)
    return F.when(in_order, F.lit(100) - F.least(F.levenshtein(stem, F.lit(q)), F.lit(100)) + bonus)


def find_files(paths: DataFrame, query: str, limit: int = 20, frecency: DataFrame | None = None) -> DataFrame:
    """path, score, rank (from 0) and n, the number returned: best fuzzy score first, how often and lately a path was opened adding up to 20."""
    scored = paths.select("path", fuzzy_score(F.col("path"), query).alias("score")).where("score IS NOT NULL")
    if frecency is not None:
        scored = scored.join(frecency.select("path", F.least(F.col("frecency") * 2, F.lit(20.0)).alias("f")), "path", "left")
        scored = scored.select("path", F.round(F.col("score") + F.coalesce("f", F.lit(0.0)), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "path").limit(limit)
    whole = Window.partitionBy().orderBy(F.desc("score"), "path")  # over at most limit rows
    return best.withColumn("rank", F.row_number().over(whole) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))


def frecency(log: DataFrame, now: str, half_life_days: float = 14.0) -> DataFrame:
    """path, frecency: the sum over distinct accesses of 2^(-age / half life); later ones than now count as now. Null paths are left out."""
    age = F.greatest((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400_000_000.0), F.lit(0.0))
    return log.where("path IS NOT NULL AND ts IS NOT NULL").select("path", "ts").distinct().groupBy("path").agg(F.round(F.sum(F.pow(F.lit(0.5), age / half_life_days)), 6).alias("frecency"))
