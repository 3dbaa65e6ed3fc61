"""One ranking from several differently scaled scores (problem 3): robust rank aggregation.

Each signal ranks a group's items by itself; a rank divided by the number of items is uniform if the signal says
nothing. An item's normalised ranks are sorted, and the k-th smallest is held against the distribution of the k-th order
statistic of as many uniform numbers, a beta distribution: P(Beta(k, m-k+1) <= r). The least of these probabilities, times
the number of signals, is the item's significance; a small one stands first. Only orders count, so units, spreads and
outliers of a signal have no say.

Ranks are computed without gathering a group in one task: scores are first reduced to distinct values with counts, spread
over range partitions, summed up inside each partition and shifted by the totals of the partitions before.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.session import cut
from quillon.sources.tables import table

SIGNALS = ["fff_score", "vector_score", "graph_score", "bm25_score"]


def order_statistic_tail(r: Column, k: int, m: int) -> Column:
    """Probability that the k-th smallest of m uniform numbers is at most r."""
    return reduce(lambda a, b: a + b, [F.lit(float(comb(m, j))) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(k, m + 1)])


def _average_ranks(scores: DataFrame) -> DataFrame:
    """(_g, _s, _v) -> (_g, _s, _v, _rank): rank of each distinct score among all rows of its group, ties averaged."""
    counted = scores.groupBy("_g", "_s", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = cut(counted.repartitionByRange(F.col("_g"), F.col("_s"), F.col("_v").desc()).withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy("_g", "_s", "_p").agg(F.sum("_c").alias("_t"))
    before = totals.select("_g", "_s", "_p", (F.sum("_t").over(Window.partitionBy("_g", "_s").orderBy("_p")) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy("_g", "_s", "_p").orderBy(F.col("_v").desc())
    return (
        placed.withColumn("_upto", F.sum("_c").over(inside))
        .join(before, ["_g", "_s", "_p"])
        .select("_g", "_s", "_v", (F.col("_before") + F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias("_rank"))
    )


def aggregate_ranks(hits: DataFrame, group: str = "query_id", item: str = "chunk_id", signals: list[str] | None = None) -> DataFrame:
    """One row per group and item: group, item, significance, mean_rank, ordinal (1 = best).

    An item's score of a signal is its greatest one over its rows; NaN counts as null. A null score is worst (normalised rank 1),
    so an item without any score has significance 1. Equal significances are ordered by mean normalised rank, then
    item. Rows with a null group or item are left out. Other columns are ignored.
    """
    signals = signals or SIGNALS
    m = len(signals)
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(f"_s{i}") for i, s in enumerate(signals)]
    items = cut(
        hits.where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(group).alias("_g"), F.col(item).alias("_i"))
        .agg(*clean)
    )
    sizes = items.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    long = items.select("_g", "_i", F.posexplode(F.array(*[f"_s{i}" for i in range(m)])).alias("_s", "_v")).where("_v IS NOT NULL")
    ranked = long.join(_average_ranks(long), ["_g", "_s", "_v"]).groupBy("_g", "_i").agg(F.collect_list("_rank").alias("_ranks"))
    scored = items.select("_g", "_i").join(sizes, "_g").join(ranked, ["_g", "_i"], "left")
    known = F.array_sort(F.transform(F.coalesce("_ranks", F.array().cast("array<double>")), lambda x: x / F.col("_n")))
    ordered = scored.select("_g", "_i", F.concat(known, F.array_repeat(F.lit(1.0), F.lit(m) - F.size(known))).alias("_r"))
    tails = [order_statistic_tail(F.get("_r", k - 1), k, m) for k in range(1, m + 1)]
    result = ordered.select(
        F.col("_g").alias(group),
        F.col("_i").alias(item),
        F.least(F.lit(1.0), F.lit(float(m)) * (F.least(*tails) if m > 1 else tails[0])).alias("significance"),
        (F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / m).alias("mean_rank"),
    )
    order = [F.round(F.log10("significance"), 9), F.round("mean_rank", 9), F.col(item)]
    return result.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "hits").select("query_id", "chunk_id", *SIGNALS)
    return aggregate_ranks(hits).where("ordinal <= 5").select("query_id", "chunk_id")


_TAILS = ", ".join(
    " + ".join(f"{comb(4, j)} * pow(r[{k}], {j}) * pow(1 - r[{k}], {4 - j})" for j in range(k, 5)) for k in range(1, 5)
)
P3_SQL = f"""
WITH items AS (SELECT query_id, chunk_id, {", ".join(f"max({s}) AS s{i}" for i, s in enumerate(SIGNALS))} FROM hits GROUP BY ALL),
sizes AS (SELECT query_id, count(*) AS n FROM items GROUP BY ALL),
long AS ({" UNION ALL ".join(f"SELECT query_id, chunk_id, {i} AS s, s{i} AS v FROM items" for i in range(4))}),
ranks AS (SELECT query_id, chunk_id, CASE WHEN v IS NULL THEN 1.0 ELSE
            (rank() OVER w + (count(*) OVER (PARTITION BY query_id, s, v) - 1) / 2.0) / n END AS x
          FROM long JOIN sizes USING (query_id) WINDOW w AS (PARTITION BY query_id, s ORDER BY v DESC NULLS LAST)),
lists AS (SELECT query_id, chunk_id, list(x ORDER BY x) AS r, avg(x) AS mean FROM ranks GROUP BY ALL),
tails AS (SELECT query_id, chunk_id, mean, least({_TAILS}) AS p FROM lists),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(log10(least(1.0, 4 * p)), 9), round(mean, 9), chunk_id) AS i FROM tails)
SELECT query_id, chunk_id FROM numbered WHERE i <= 5
"""
