"""Vectors: hashed embeddings, cosine, exact top-k and similar pairs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.frames import frame
from quillon.functions.text import words

#: Rows of a block of vectors, and query vectors that are sent to every task rather than joined.
BLOCK_ROWS, BROADCAST_QUERIES = 4096, 1 << 14


def usable(rows: DataFrame, key: str, width: int, vector: str = "vector") -> DataFrame:
    """(key, vector) with one usable vector of the width per key: finite numbers, not all zero."""
    good = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull() & good).groupBy(key).agg(F.min(vector).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different widths or without length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def top_k(vectors: DataFrame, key: str, query: list[float], k: int = 10) -> DataFrame:
    """key, score of the k vectors nearest to one query vector; the query is a literal, the plan a scan and a top-k."""
    if k < 1:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col("vector"), literal), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _unit(v) -> np.ndarray:
    x = np.stack([np.asarray(a, dtype=np.float64) for a in v])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _blocks(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BLOCK_ROWS))


def _block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def batch_top_k(base: DataFrame, queries: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """query_key, key, score, rank: exact top k of every query vector by matrix products, cut to k within each task before anything moves.

    Up to BROADCAST_QUERIES query vectors go to the tasks that scan base; more are met block by block, so that a task holds two blocks. A vector is
    never its own neighbour if both tables hold the same id. Ties are ordered by id.
    """
    kind, asked_kind = dict(base.dtypes)[key], dict(queries.dtypes)[query_key]
    left = base.select(F.col(key).alias("l"), F.col("vector").alias("lv"))
    right = queries.select(F.col(query_key).alias("r"), F.col("vector").alias("rv"))

    def best(names: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        out: dict = {"q": [], "n": [], "score": []}
        cos = np.round(q @ x.T, 6)
        for i, me in enumerate(asked):
            row = np.where(names == me, -9.0, cos[i])
            at = np.flatnonzero(row >= np.partition(row, -min(k, len(row)))[-min(k, len(row))])
            top = sorted((-row[j], names[j]) for j in at if row[j] > -9)[:k]
            out["q"] += [me] * len(top)
            out["n"] += [x for _, x in top]
            out["score"] += [-s for s, _ in top]
        return frame(out)

    schema = f"q {asked_kind}, n {kind}, score double"
    if queries.count() <= BROADCAST_QUERIES:
        few = right.toPandas()
        names, q = few["r"].to_numpy(), _unit(few["rv"]) if len(few) else None

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f) and len(names):
                    yield best(f["l"].to_numpy(), _unit(f["lv"]), names, q)

        near = left.mapInPandas(scan, schema)
    else:
        n, m = _blocks(base), _blocks(queries)
        one = left.withColumn("lb", _block_of("l", n)).withColumn("la", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        other = right.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("ra", _block_of("r", m))
        find = lambda a, b: best(a["l"].to_numpy(), _unit(a["lv"]), b["r"].to_numpy(), _unit(b["rv"])) if len(a) and len(b) else frame({"q": [], "n": [], "score": []})
        near = one.groupBy("lb", "la").cogroup(other.groupBy("rb", "ra")).applyInPandas(find, schema)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(f"query_{query_key}"), F.col("n").alias(key), "score", "rank")


def similar_pairs(vectors: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """key_a < key_b, score of all pairs with a cosine above least, by products of blocks; two blocks meet once."""
    kind, n = dict(vectors.dtypes)[key], _blocks(vectors)

    def find(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"a": [], "b": [], "score": []}
        if len(a) and len(b):
            names, others = a["l"].to_numpy(), b["r"].to_numpy()
            cos = np.round(_unit(a["lv"]) @ _unit(b["rv"]).T, 6)
            i, j = np.nonzero(cos > least)
            kept = names[i] < others[j] if a["lb"].iloc[0] == b["rb"].iloc[0] else names[i] != others[j]
            i, j = i[kept], j[kept]
            swap = names[i] > others[j]
            out = {"a": list(np.where(swap, others[j], names[i])), "b": list(np.where(swap, names[i], others[j])), "score": cos[i, j]}
        return frame(out)

    def side(x: str, others: Column) -> DataFrame:
        return vectors.select(F.col(key).alias(x), F.col("vector").alias(f"{x}v"), _block_of(key, n).alias(f"{x}b")).withColumn(f"{x}w", F.explode(others))

    low = side("l", F.sequence(F.col("lb"), F.lit(n - 1)))  # meets blocks from its own on
    high = side("r", F.sequence(F.lit(0), F.col("rb")))
    met = low.groupBy("lb", "lw").cogroup(high.groupBy("rw", "rb")).applyInPandas(find, f"a {kind}, b {kind}, score double")
    return met.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), "score")


# Hashed embeddings. One rule gives the bucket and the sign of a feature in both forms below: of the MD5 of "salt feature" the first
# eight hex digits modulo the width are the bucket, the ninth digit's parity is the sign.
SALTS = ("a", "b")


def embed_sparse(docs: DataFrame, key: str, text: str, width: int = 256) -> DataFrame:
    """(key, bucket, weight) of word features, of unit length: the relational form, for checks and sparse joins."""
    tf = docs.select(F.col(key).alias("key"), F.explode(words(F.col(text))).alias("w")).groupBy("key", "w").agg(F.sqrt(F.count(F.lit(1))).alias("x"))
    salted = tf.select("key", "x", F.explode(F.array(*[F.md5(F.concat(F.lit(s + " "), "w")) for s in SALTS])).alias("h"))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(width)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring("h", 9, 1), 16, 10).cast("int"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    summed = salted.groupBy("key", bucket.alias("bucket")).agg(F.sum(sign * F.col("x")).alias("s"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("key")))
    return summed.withColumn("n", norm).select(F.col("key").alias(key), "bucket", F.when(F.col("n") > 1e-10, F.col("s") / F.col("n")).otherwise(0.0).alias("weight"))


def embed_text(text: str, width: int = 1024) -> np.ndarray:
    """The dense form with all features: words, identifier parts, original-case names, character 2- to 4-grams and line marks."""
    features: Counter = Counter()
    lower = text.lower()
    for token in re.findall(r"\w+", lower):
        for part in re.findall(r"\d+|\D+", token):
            if len(part.encode()) > 1 or part.isdigit():
                features["w " + part] += 1.0
    features = Counter({f: c**0.5 for f, c in features.items()})
    for size, weight in ((2, 0.25), (3, 0.5), (4, 0.75)):
        for i in range(len(lower) - size + 1):
            features[f"g{size} " + lower[i : i + size]] += weight
    for token in re.findall(r"[^\W_]+", text):
        for part in re.findall(r"\d+|[A-Z]+[a-z]*|[a-z]+|[^\W\d_a-zA-Z]+", token):
            if len(part.encode()) > 1:
                features["p " + part.lower()] += 0.5
        if len(token.encode()) > 2 and re.search(r"[A-Z0-9]", token):
            features["c " + token] += 0.3
    for line in text.split("\n"):
        s = line.strip()
        if re.match(r"(?:pub |async |export |static )*(?:fn|def|func|function|class|struct|enum|trait|interface|impl)\b", s):
            features["l definition"] += 0.5
        if "->" in s or "=>" in s:
            features["l arrow"] += 0.35
        if s.startswith(("//", "#", "/*", "*", "--")):
            features["l comment"] += 0.25
    v = np.zeros(width)
    for f, x in features.items():
        for salt in SALTS:
            h = hashlib.md5(f"{salt} {f}".encode()).hexdigest()
            v[int(h[:8], 16) % width] += x if int(h[8], 16) % 2 == 0 else -x
    size = np.linalg.norm(v)
    return v / size if size > 1e-10 else v


def embed(docs: DataFrame, text: Column, width: int = 1024, out: str = "vector") -> DataFrame:
    """docs with a dense vector of text; nulls and texts without a feature have the zero vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: embed_text(t or "", width).astype(np.float32))

    return docs.withColumn(out, run(text))


EMBEDDERS = {"local": embed_text, "hash": embed_text, "none": embed_text}


def embedder(name: str, **functions):
    """The function text -> vector of a provider; remote ones are passed in by the caller."""
    try:
        return (EMBEDDERS | functions)[name]
    except KeyError:
        raise ValueError(f"unknown embedding provider {name!r}") from None
