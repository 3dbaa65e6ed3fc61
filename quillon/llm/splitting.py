"""Splitting of oversized items at natural boundaries (problem 7): a dynamic programme over boundary positions.

A piece that starts at a line may end at any of the next ``max_lines`` lines, or takes all that remain if no more are left. An end costs

    imbalance * (max_lines - length) + cut * max_lines unless the piece ends with an empty line in its upper half

and the best end of every start follows, from the last line back, from its own cost and that of the start it leads to. With
``early_first`` costs are compared piece by piece, earlier pieces first; otherwise their sum is least. Full weights and early
pieces first give the rule of TESTDATA. Lines are counted and told empty or not inside the JVM; of items beyond their limit, only
these flags reach Python, in Arrow batches. There is no shuffle; time is in proportion to lines times limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import table

EMPTY_LINE = r"^[ \t\r]*$"


def content_lines(content: Column) -> Column:
    """Lines end at a line feed; a final one starts no further line. An empty text has no line."""
    parts = F.split(content, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def best_pieces(empty: np.ndarray, limit: int, overlap: int, cut: float = 1.0, imbalance: float = 1.0, early_first: bool = True) -> list[tuple[int, int]]:
    """(first_line, last_line) of the pieces of an item of len(empty) lines, from line 1.

    An overlap so large that a piece would not start behind its predecessor is cut to what still advances.
    """
    n = len(empty)
    length = np.arange(1, limit + 1)
    natural, plain = imbalance * (limit - length), imbalance * (limit - length) + cut * limit
    upper, advance = length > limit // 2, np.maximum(length - overlap, 1)
    total, taken = np.zeros(n + 2), np.zeros(n + 2, np.int64)
    start = np.arange(max(1, n - limit + 1), n + 1)
    total[start], taken[start] = imbalance * (limit - (n - start + 1)), n - start + 1
    for first in range(n - limit, 0, -1):
        cost = np.where(empty[first - 1 : first - 1 + limit] & upper, natural, plain)
        whole = cost + total[first + advance]
        if early_first:
            best = np.flatnonzero(cost == cost.min())
            pick = best[0] if len(best) == 1 else best[np.argmin(whole[best])]
        else:
            pick = np.argmin(whole)
        total[first], taken[first] = whole[pick], length[pick]
    pieces, first = [], 1
    while first <= n:
        last = first + int(taken[first]) - 1
        pieces.append((first, last))
        if last >= n:
            break
        first = max(last - overlap + 1, first + 1)
    return pieces


def piece_bounds(empty: Column, limit: Column, overlap: Column, cut: float, imbalance: float, early_first: bool) -> Column:
    """best_pieces as array<struct<first_line, last_line>>."""

    @F.pandas_udf("array<struct<first_line:int,last_line:int>>")
    def run(empty: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        rows = zip(empty, limit, overlap, strict=True)
        return pd.Series([[{"first_line": a, "last_line": b} for a, b in best_pieces(np.asarray(e, dtype=bool), int(m), int(o), cut, imbalance, early_first)] for e, m, o in rows], dtype=object)

    return run(empty, limit, overlap)


def split_items(
    items: DataFrame, limits: DataFrame, key: str = "id", content: str = "content", kind: str = "symbol_kind", cut: float = 1.0, imbalance: float = 1.0, early_first: bool = True
) -> DataFrame:
    """Pieces of every item longer than its kind's limit: key, piece_no, first_line, last_line, piece.

    limits: kind, max_lines, overlap_lines; one row per kind. Items of an unknown or null kind, with null content or
    within their limit give no row. Repeated items give repeated pieces. Columns besides these are ignored, so names
    cannot clash. Limits below one line count as one. cut, imbalance and early_first weigh the costs.
    """
    rules = limits.select(
        F.col(kind).alias("_kind"),
        F.greatest(F.col("max_lines"), F.lit(1)).alias("_limit"),
        F.greatest(F.coalesce("overlap_lines", F.lit(0)), F.lit(0)).alias("_overlap"),
    ).where(F.col("max_lines").isNotNull())
    lines = items.select(F.col(key).alias("_key"), F.col(kind).alias("_kind"), content_lines(F.col(content)).alias("_lines"))
    long = lines.join(rules, "_kind").where(F.size("_lines") > F.col("_limit"))
    empty = F.transform("_lines", lambda x: x.rlike(EMPTY_LINE))
    bounds = long.withColumn("_pieces", piece_bounds(empty, F.col("_limit"), F.col("_overlap"), cut, imbalance, early_first))
    pieces = bounds.select("_key", "_lines", F.posexplode("_pieces").alias("_no", "_at"))
    return pieces.select(
        F.col("_key").alias(key),
        (F.col("_no") + 1).alias("piece_no"),
        F.col("_at.first_line").alias("first_line"),
        F.col("_at.last_line").alias("last_line"),
        F.array_join(F.slice("_lines", F.col("_at.first_line"), F.col("_at.last_line") - F.col("_at.first_line") + 1), "\n").alias("piece"),
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_items(table(spark, folder, "chunks"), table(spark, folder, "split_limits"))
    return pieces.select("id", "piece_no", "first_line", "last_line").distinct()


P7_SQL = r"""
WITH RECURSIVE items AS (
  SELECT DISTINCT id, max_lines AS m, overlap_lines AS o,
         CASE WHEN content LIKE '%' || chr(10) THEN string_split(content[:-2], chr(10)) ELSE string_split(content, chr(10)) END AS l
  FROM chunks JOIN split_limits USING (symbol_kind) WHERE content <> ''),
long AS (SELECT * FROM items WHERE len(l) > m),
empty AS (SELECT id, e.i AS i FROM (SELECT id, unnest(list_zip(l, range(1, len(l) + 1))) AS t FROM long), LATERAL (SELECT t[1] AS s, t[2] AS i) e
          WHERE regexp_full_match(e.s, '[ \t\r]*')),
pieces AS (
  SELECT id, m, o, len(l) AS n, 1 AS piece_no, 1 AS first_line,
         CAST(CASE WHEN m >= len(l) THEN len(l) ELSE coalesce((SELECT max(i) FROM empty e WHERE e.id = long.id AND i > m // 2 AND i <= m), m) END AS INT) AS last_line
  FROM long
  UNION ALL
  SELECT id, m, o, n, piece_no + 1, last_line - o + 1,
         CAST(CASE WHEN last_line - o + m >= n THEN n
              ELSE coalesce((SELECT max(i) FROM empty e WHERE e.id = p.id AND i > last_line - o + m // 2 AND i <= last_line - o + m), last_line - o + m) END AS INT)
  FROM pieces p WHERE last_line < n)
SELECT DISTINCT id, piece_no, first_line, last_line FROM pieces
"""
