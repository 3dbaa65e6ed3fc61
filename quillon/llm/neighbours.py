"""The most similar vectors of every vector (problem 4): collision-counting hashing.

Vectors have unit length, so cosine order is distance order. The index of a cell is PROJECTIONS random projections, each one
a sorted array. A query opens a window around its own value in every array; a vector that lies in at least
COLLIDE * PROJECTIONS windows is verified by its exact cosine. Windows widen with the radius R = 1/4, 1/2, 2 (virtual
rehashing: the arrays stay, only the windows grow) until the k-th best verified distance is at most R, so that everything
as near has had its chance; the last radius spans all vectors. (At R = 1 the windows would hold nearly all of them already.)

Windows of single projections hold a fixed share of all vectors, which alone would make the work quadratic. The collection
is therefore first laid out in cells around pivots, a bounded random sample of the vectors (one for CELL of them); a vector is indexed in
the cell of its nearest pivot and queries the PROBES nearest cells. Dense regions get pivots in proportion. A cell beyond SHARD rows, of
index or of queries, is split and the parts' results are merged. Equal vectors are indexed k + 1 times at most: further
copies take the first k others of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.frames import frame
from quillon.session import cut
from quillon.sources.tables import table

PROJECTIONS = 32
#: Half a window in units of the radius, and the share of windows to be met; a vector at distance R misses with p < 0.01.
HALF_WINDOW, COLLIDE = 1.36, 0.66
RADII = (0.25, 0.5, 2.0)
CELL, MAX_PIVOTS, PROBES, SHARD = 128, 1 << 15, 16, 8192
#: Queries worked on at once, and a cosine below all others.
BLOCK, ABSENT = 256, -9.0


def usable_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(_id, _v): one row per key with a vector of the width, of finite numbers that are not all zero.

    Of several different usable vectors of a key the least counts.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    kept = rows.where(F.col(key).isNotNull() & (F.size(vector) == width) & finite)
    return kept.groupBy(F.col(key).alias("_id")).agg(F.min(F.col(vector).cast("array<float>")).alias("_v"))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assigner(pivots: np.ndarray, probes: int):
    pivots = pivots.T.astype(np.float32)

    def nearest_cells(x: np.ndarray) -> np.ndarray:
        cos = x.astype(np.float32) @ pivots
        at = np.argpartition(-cos, probes - 1, axis=1)[:, :probes] if probes < cos.shape[1] else np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
        order = np.argsort(-np.take_along_axis(cos, at, 1), axis=1, kind="stable")
        return np.take_along_axis(at, order, 1).astype(np.int32)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in range(0, len(f), BLOCK):
                part = f.iloc[start : start + BLOCK]
                yield part.assign(_cells=list(nearest_cells(_unit(part["_v"]))))

    return assign


def _windows(px: np.ndarray, pq: np.ndarray, places: np.ndarray, half: float) -> np.ndarray:
    """Per query and indexed vector in how many projections the vector's place lies in the query's window."""
    met = np.zeros((len(pq), px.shape[0]), np.uint8)
    for j in range(px.shape[1]):
        line = np.sort(px[:, j])
        low = np.searchsorted(line, pq[:, j] - half, "left").astype(np.int32)
        high = np.searchsorted(line, pq[:, j] + half, "right").astype(np.int32)
        # one unsigned comparison tells low <= place < high
        met += (places[:, j][None, :] - low[:, None]).view(np.uint32) < (high - low).view(np.uint32)[:, None]
    return met


def _best(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, equal ones in their order."""
    if cos.shape[1] > k:
        edge = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        tied = (cos >= edge[:, None]).sum(1) > k
        if tied.any():
            at[tied] = np.argsort(-cos[tied], axis=1, kind="stable")[:, :k]
        at = np.sort(at, axis=1)
    else:
        at = np.broadcast_to(np.arange(cos.shape[1]), cos.shape)
    order = np.argsort(-np.take_along_axis(cos, at, 1), axis=1, kind="stable")
    return np.take_along_axis(at, order, 1)


def _search(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(index) or not len(queries):
        return frame({"_id": [], "_other": [], "_cos": []})
    index = index.sort_values("_id", kind="stable")
    x, q = _unit(index["_v"]), _unit(queries["_w"])
    names, own = index["_id"].to_numpy(), queries["_me"].to_numpy()
    me = pd.Series(np.arange(len(names)), index=names).reindex(own).fillna(-1).to_numpy().astype(np.int64)
    lines = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], PROJECTIONS))
    px, pq = x @ lines, q @ lines
    places = np.empty(px.shape, np.int32)
    np.put_along_axis(places, np.argsort(px, axis=0, kind="stable"), np.arange(len(px), dtype=np.int32)[:, None], 0)
    need, out = int(np.ceil(COLLIDE * PROJECTIONS)), []
    for start in range(0, len(q), BLOCK):
        open_ = np.arange(start, min(start + BLOCK, len(q)))
        for radius in RADII:
            cos = np.round(q[open_] @ x.T, 9)
            if radius < RADII[-1]:
                cos[_windows(px, pq[open_], places, HALF_WINDOW * radius) < need] = ABSENT
            mine = me[open_] >= 0
            cos[np.flatnonzero(mine), me[open_][mine]] = ABSENT
            at = _best(cos, k)
            value = np.take_along_axis(cos, at, 1)
            full = at.shape[1] == k
            done = np.full(len(open_), radius == RADII[-1]) | (full and (value[:, -1] > ABSENT) & (2 - 2 * value[:, -1] <= radius * radius))
            row, col = np.nonzero(done[:, None] & (value > ABSENT))
            out.append((own[open_[row]], names[at[row, col]], value[row, col]))
            open_ = open_[~done]
            if not len(open_):
                break
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return frame(dict(zip(["_id", "_other", "_cos"], columns, strict=True)))


def nearest(rows: DataFrame, key: str, vector: str = "vector", k: int = 5, width: int = 64, cell: int = CELL, probes: int | None = PROBES) -> DataFrame:
    """item_id, neighbour_id, cosine: the k other keys of highest cosine for every key with a usable vector.

    Ties are ordered by key. Repeated rows count once. Fewer than k others give fewer rows. Other columns are ignored. There is a pivot for
    every `cell` rows, MAX_PIVOTS at most; of these cells each vector asks the `probes` nearest. None asks all of them, which is exact.
    """
    spark = rows.sparkSession
    vectors = cut(usable_vectors(rows, key, vector, width).withColumn("_h", F.xxhash64("_v")).withColumn("_h2", F.xxhash64(F.lit(1), "_v")))
    heads = vectors.withColumn("_nth", F.row_number().over(Window.partitionBy("_h", "_h2").orderBy("_id"))).where(F.col("_nth") <= k + 1)
    heads = cut(heads)
    n = heads.count()
    pivots = max(1, min(MAX_PIVOTS, n // cell))
    sample = heads.orderBy(F.xxhash64("_id"), "_id").limit(pivots).select("_v").collect()  # at most MAX_PIVOTS rows
    if not sample:
        return spark.createDataFrame([], f"item_id {dict(rows.dtypes)[key]}, neighbour_id {dict(rows.dtypes)[key]}, cosine double")
    id_type = dict(rows.dtypes)[key]
    placed = cut(
        heads.select("_id", "_v").mapInPandas(_assigner(_unit([r._v for r in sample]), min(probes or len(sample), len(sample))), f"_id {id_type}, _v array<float>, _cells array<int>")
    )
    homes = {r.c: r.n for r in placed.select(F.get("_cells", 0).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = {r.c: r.n for r in placed.select(F.explode("_cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = spark.createDataFrame([(c, -(-homes.get(c, 0) // SHARD), -(-asks[c] // SHARD)) for c in asks], "_cell int, _xs int, _qs int")
    index = placed.select("_id", "_v", F.get("_cells", 0).alias("_cell")).join(F.broadcast(parts), "_cell")  # a row per pivot
    index = index.select("_id", "_v", "_cell", F.pmod(F.xxhash64("_id"), "_xs").cast("int").alias("_x"), F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)).alias("_q"))
    asked = placed.select(F.col("_id").alias("_me"), F.col("_v").alias("_w"), F.explode("_cells").alias("_cell")).join(F.broadcast(parts), "_cell").where("_xs > 0")
    asked = asked.select(
        "_me",
        "_w",
        F.col("_cell").alias("_c"),
        F.explode(F.sequence(F.lit(0), F.col("_xs") - 1)).alias("_y"),
        F.pmod(F.xxhash64("_me"), "_qs").cast("int").alias("_z"),
    )
    near = index.groupBy("_cell", "_x", "_q").cogroup(asked.groupBy("_c", "_y", "_z")).applyInPandas(lambda a, b: _search(a, b, k), f"_id {id_type}, _other {id_type}, _cos double")
    best = Window.partitionBy("_id").orderBy(F.desc("_cos"), "_other")
    found = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).select("_id", "_other", "_cos")
    copies = vectors.join(heads.select("_id"), "_id", "left_anti").select("_id", "_h", "_h2")
    copied = copies.join(heads.where(F.col("_nth") <= k).select("_h", "_h2", F.col("_id").alias("_other")), ["_h", "_h2"])
    both = found.union(copied.select("_id", "_other", F.lit(1.0).alias("_cos")))
    return both.select(F.col("_id").alias("item_id"), F.col("_other").alias("neighbour_id"), F.col("_cos").alias("cosine"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    wiki = nearest(table(spark, folder, "wiki_vectors").select("slug", "vector"), "slug")
    chunks = nearest(table(spark, folder, "chunk_vectors").select("chunk_id", "vector"), "chunk_id")
    return wiki.union(chunks).select("item_id", "neighbour_id")


def recall(rows: DataFrame, key: str, k: int = 5, width: int = 64, share: int = 20, **options) -> DataFrame:
    """true_neighbours, recall: of the keys whose hash is divisible by share, the true neighbours by brute force over all rows, and what part is found.

    The rows are met in blocks, each against the queries of one block.
    """
    vectors = cut(usable_vectors(rows, key, "vector", width))
    kind = dict(rows.dtypes)[key]
    asked = vectors.where(F.pmod(F.xxhash64("_id"), F.lit(share)) == 0)
    parts = max(1, vectors.count() // SHARD)  # of the rows; queries are a share-th of them
    queries = asked.select(F.col("_id").alias("_me"), F.col("_v").alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_c"), F.pmod(F.hash("_id"), F.lit(-(-parts // share))).alias("_z"))
    base = vectors.select("_id", "_v", F.pmod(F.xxhash64("_v"), F.lit(parts)).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(-(-parts // share) - 1))).alias("_y"))

    def brute(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"_id": [], "_other": [], "_cos": []}
        if len(a) and len(b):
            cos, names = np.round(_unit(b["_w"]) @ _unit(a["_v"]).T, 9), a["_id"].to_numpy()
            for i, me in enumerate(b["_me"]):
                row = np.where(names == me, ABSENT, cos[i])
                edge = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                best = sorted((-row[j], names[j]) for j in np.flatnonzero(row >= max(edge, -2)))[:k]
                out["_id"] += [me] * len(best)
                out["_other"] += [x for _, x in best]
                out["_cos"] += [-c for c, _ in best]
        return frame(out)

    true = base.groupBy("_b", "_y").cogroup(queries.groupBy("_c", "_z")).applyInPandas(brute, f"_id {kind}, _other {kind}, _cos double")
    best = Window.partitionBy("_id").orderBy(F.desc("_cos"), "_other")
    true = true.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    found = nearest(rows, key, k=k, width=width, **options).select(F.col("item_id").alias("_id"), F.col("neighbour_id").alias("_other"), F.lit(1).alias("_hit"))
    return true.join(found, ["_id", "_other"], "left").agg(F.count(F.lit(1)).alias("true_neighbours"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 4).alias("recall"))


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall in the table of chunk vectors."""
    return recall(table(spark, folder, "chunk_vectors").select("chunk_id", "vector"), "chunk_id")


def p4_recall_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """Recall in the table of wiki vectors."""
    return recall(table(spark, folder, "wiki_vectors").select("slug", "vector"), "slug")
