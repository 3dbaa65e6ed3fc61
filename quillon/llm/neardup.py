"""Near-duplicate records with small edits (problem 2): an inverted join over signature coordinates.

A record is its set of words. Records with equal sets form a class, and classes are compared.

* A class's signature has COORDINATES min-hashes. Sets of Jaccard similarity J agree in a coordinate with probability J, so
  two sets of at least ``threshold`` agree in ``need`` coordinates but for about one pair in 10,000 that lie exactly at it,
  and far fewer above.
* Posting: a class is posted under (coordinate, value). Two classes that agree in ``need`` coordinates share at least one of
  the first COORDINATES - need + 1 in any common order, so only that prefix is posted. The order puts coordinates first whose
  minimum is a rare word, which keeps lists short however frequent some words are. Frequent words are known from a
  bounded sample; that touches the order only, never the result.
* Skipping: a collision is dropped at once, inside the join, if the sizes rule the similarity out or if 192 further min-hashes
  of one bit, carried in the posting, agree in too few places.
* Merging: the matches of a pair are counted over its whole signatures, pairs of ``need`` or more are retained, and every one is
  decided by the exact similarity of its sets.

``exact`` is the way without a loss: it posts the rarest words of a set themselves, so many that alike sets share one for certain, and
skips by size alone. It costs more; ``p2_recall`` measures the first way by it.

Lists and classes of more than SPLIT rows are split: one side by hash, the other repeated, so no task meets all pairs of a group.
A set's identity is a 64-bit hash of its words' hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut, spread
from quillon.sources.tables import table

COORDINATES = 32
BITS = 192
SEED = 20_231
#: Rows of one list or class that a task may meet on one side, and rows of postings in a task.
SPLIT, TASK_ROWS = 8192, 250_000
#: Largest table of groups to be split that is broadcast.
HOT_ROWS = 1 << 16
#: Size of the table of frequent words, and rows of the sample it is counted on.
FREQUENT, SAMPLE_ROWS = 4095, 20_000
#: log2 of the bits of the filter that spares words of records without a candidate partner the shuffle.
FILTER_BITS = 22


def below(n: int, p: float, miss: float) -> int:
    """The largest count that a binomial(n, p) variable falls short of with at most probability miss."""
    total, k = 0.0, 0
    while k <= n:
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > miss:
            return k
        k += 1
    return n


def word_hashes(text: Column) -> Column:
    """Sorted hashes of the distinct longest runs of a-z, 0-9 and _ in the lower-cased text."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]++"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _frequent(sample: DataFrame, text: str) -> dict[int, int]:
    """Hash of a word -> 1..FREQUENT, the more frequent the greater."""
    counted = (
        sample.select(F.explode(word_hashes(F.col(text))).alias("w"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 2")
        .orderBy(F.desc("n"), "w")
        .limit(FREQUENT)
    )
    return {r.w: FREQUENT - i for i, r in enumerate(counted.collect())}


def _places(frequent: dict[int, int]):
    """Hashes of words -> 0 for rare ones, else 1..FREQUENT."""
    words = np.array(sorted(frequent), dtype=np.int64)
    ranks = np.array([frequent[w] for w in words.tolist()], dtype=np.uint64)

    def places(flat: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flat), np.uint64)
        if len(words):
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            hit = words[at] == flat
            out[hit] = ranks[at[hit]]
        return out

    return places


def _with(batch: pa.RecordBatch, posted: pa.Array, bits: np.ndarray) -> pa.RecordBatch:
    cols = [*batch.columns, posted, *(pa.array(np.ascontiguousarray(bits[:, j]).view(np.int64)) for j in range(BITS // 64))]
    return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "_tokens", *(f"_b{j}" for j in range(BITS // 64))])


def _signer(frequent: dict[int, int]):
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 62, COORDINATES + BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 62, COORDINATES + BITS, dtype=np.uint64)
    places = _places(frequent)
    low = np.uint64(0xFFF)

    def least(h: np.ndarray, starts: np.ndarray, i: int, tag: np.ndarray | None) -> np.ndarray:
        x = (h ^ salt[i]) * odd[i]
        if tag is not None:
            x = (x & ~low) | tag
        return np.minimum.reduceat(x, starts)

    def sign(batches):
        for batch in batches:
            lists, n = batch.column("_h"), batch.num_rows
            if not n:
                continue
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            starts, h = (offsets[:-1] - offsets[0]).astype(np.int64), flat.view(np.uint64)
            tag = places(flat)
            mins = np.stack([least(h, starts, i, tag) for i in range(COORDINATES)], 1)
            order = mins & low
            tokens = (mins >> np.uint64(12)) * np.uint64(64) + np.arange(COORDINATES, dtype=np.uint64)
            first = np.lexsort((tokens, order), axis=1)
            posted = np.take_along_axis(tokens, first, 1).view(np.int64)
            bits = np.zeros((n, BITS // 64), np.uint64)
            for i in range(BITS):
                bits[:, i // 64] |= ((least(h, starts, COORDINATES + i, None) >> np.uint64(40)) & np.uint64(1)) << np.uint64(i % 64)
            yield _with(batch, pa.ListArray.from_arrays(np.arange(0, posted.size + 1, COORDINATES, dtype=np.int32), posted.ravel()), bits)

    return sign


def _exact_signer(frequent: dict[int, int], threshold: float):
    """Posts of n words the n - least + 1 rarest ones, least being the size of the smallest overlap with an alike set."""
    places = _places(frequent)

    def sign(batches):
        for batch in batches:
            lists, n = batch.column("_h"), batch.num_rows
            if not n:
                continue
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(offsets)
            posts = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
            order = np.lexsort((flat, places(flat), np.repeat(np.arange(n), sizes)))
            nth = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
            posted = flat[order][nth < np.repeat(posts, sizes)]
            ends = np.concatenate([[0], np.cumsum(posts)]).astype(np.int32)
            yield _with(batch, pa.ListArray.from_arrays(ends, posted), np.zeros((n, BITS // 64), np.uint64))

    return sign


def _hot(rows: DataFrame, group: str) -> DataFrame | None:
    """(group, _parts) of the groups beyond SPLIT rows, None without any."""
    hot = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > SPLIT)
    hot = cut(hot.select(group, F.ceil(F.col("_size") / SPLIT).cast("int").alias("_parts")))
    n = hot.count()
    return None if n == 0 else F.broadcast(hot) if n <= HOT_ROWS else hot


def _self_join(rows: DataFrame, group: str, key: str, join, tasks: int | None = None) -> DataFrame:
    """join(one, other, on) of the rows of each group with themselves. Groups beyond SPLIT rows are parted by key on one side and repeated on the other."""
    hot = _hot(rows, group)
    cold = rows if hot is None else rows.join(hot, group, "left_anti")
    cold = cold.repartition(tasks, group) if tasks else cold
    met = join(cold, cold, [group])
    if hot is None:
        return met
    parted = rows.join(hot, group)
    one = parted.withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")
    other = parted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return met.union(join(one, other, [group, "_part"]))


def _candidates(classes: DataFrame, threshold: float, prefix: int, tasks: int, asked: DataFrame | None = None) -> DataFrame:
    """Pairs (_a, _b) of classes, _a < _b, that collide in the first prefix tokens; asked: only pairs with one of these classes(_k)."""
    least = F.ceil(F.col("_n") * F.lit(threshold) - 1e-9).cast("int").alias("_least")  # size of the smallest set that can be alike
    columns = ("_k", "_n", "_least", "_b0", "_b1", "_b2")
    postings = classes.select("_k", "_n", least, "_b0", "_b1", "_b2", F.explode(F.slice("_tokens", 1, prefix)).alias("_t"))
    most = BITS - below(BITS, (1 + threshold) / 2, 2e-4)

    def join(one: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        if asked is not None:
            one = one.join(asked, "_k", "left_semi")
        a = one.select(*on, *[F.col(c).alias(f"a{c}") for c in columns])
        b = other.select(*on, *[F.col(c).alias(f"b{c}") for c in columns])
        differ = sum((F.bit_count(F.col(f"a_b{j}").bitwiseXOR(F.col(f"b_b{j}"))) for j in range(3)), F.lit(0))
        sizes = (F.col("a_n") >= F.col("b_least")) & (F.col("b_n") >= F.col("a_least"))
        once = F.col("a_k") < F.col("b_k") if asked is None else F.col("a_k") != F.col("b_k")
        return a.join(b, on).where(once & sizes & (differ <= most)).select(F.least("a_k", "b_k").alias("_a"), F.greatest("a_k", "b_k").alias("_b"))

    return _self_join(postings, "_t", "_k", join, tasks).distinct()


def _bit_filter(keys: DataFrame, column: str) -> Column:
    """True for every key of the table and for few others; as many bits at any size."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))
    words = keys.select(F.shiftright(place, 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int")).alias("m"))
    table_ = [0] * (1 << (FILTER_BITS - 6))
    for r in words.groupBy("i").agg(F.bit_or("m").alias("m")).collect():
        table_[r.i] = r.m
    packed = F.from_json(F.lit("[" + ",".join(map(str, table_)) + "]"), "array<bigint>")
    return F.getbit(F.get(packed, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1


def similar_sets(records: DataFrame, key: str, text: str, threshold: float = 0.7, min_words: int = 20, exact: bool = False, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: key, class; one row per distinct key with at least min_words distinct words. links: class_a < class_b,
    similarity; every pair of different word sets whose Jaccard similarity is at least threshold. Members of one class
    have equal word sets. Null and short texts and null keys are in no class; a key with several texts takes part with each of them.
    Other columns are ignored. exact: no pair is missed, at a higher cost. asked, a condition on the key, keeps links of classes with such a member.
    """
    sets = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), word_hashes(F.col(text)).alias("_h"))
    sets = sets.where(F.size("_h") >= min_words).select("_id", F.xxhash64("_h").alias("_k"), F.size("_h").alias("_n"), "_h")
    step = max(1, records.count() // SAMPLE_ROWS)
    frequent = _frequent(records.where(F.pmod(F.xxhash64(key), F.lit(step)) == 0), text)
    need = below(COORDINATES, threshold, 1e-4)
    signer = _exact_signer(frequent, threshold) if exact else _signer(frequent)
    signed = cut(sets.mapInArrow(signer, f"_id {dict(sets.dtypes)['_id']}, _k long, _n int, _h array<bigint>, _tokens array<bigint>, _b0 long, _b1 long, _b2 long"))
    members = signed.select(F.col("_id").alias(key), F.col("_k").alias("class")).distinct()
    columns = ["_n", "_tokens", "_b0", "_b1", "_b2"]
    classes = signed.groupBy("_k").agg(F.first(F.struct(*columns)).alias("_s")).select("_k", "_s.*")
    wanted = members.where(asked).select(F.col("class").alias("_k")).distinct() if asked is not None else None
    prefix = 1 << 30 if exact else COORDINATES - need + 1
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), signed.count() * (COORDINATES - need + 1) // TASK_ROWS)
    pairs = cut(_candidates(classes, threshold, prefix, tasks, wanted))
    ends = pairs.select(F.col("_a").alias("_k")).union(pairs.select("_b"))
    whole = signed.select("_k", "_h", "_tokens").where(_bit_filter(ends, "_k")).groupBy("_k").agg(F.first(F.struct("_h", "_tokens")).alias("_s"))
    whole = cut(whole.join(ends, "_k", "left_semi").select("_k", "_s.*"))
    both = pairs
    for x in "ab":
        both = both.join(whole.select(F.col("_k").alias(f"_{x}"), F.col("_h").alias(f"_h{x}"), F.col("_tokens").alias(f"_t{x}")), f"_{x}")
    if not exact:
        both = both.where(F.size(F.array_intersect("_ta", "_tb")) >= need)
    common = both.select("_a", "_b", (F.size("_ha") + F.size("_hb")).alias("_all"), F.size(F.array_intersect("_ha", "_hb")).alias("_common"))
    links = common.select(F.col("_a").alias("class_a"), F.col("_b").alias("class_b"), (F.col("_common") / (F.col("_all") - F.col("_common"))).alias("similarity"))
    return members, links.where(F.col("similarity") >= threshold)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "chunks").select("id", "relative_path", "start_line", "end_line", "content"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of alike chunks; pairs of overlapping spans of one file aside."""
    chunks = _chunks(spark, folder)
    members, links = similar_sets(chunks, "id", "content")
    spans = chunks.select("id", "relative_path", "start_line", "end_line").distinct()
    members = cut(members.join(spans, "id"))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns])

    across = links.select("class_a", "class_b").join(side(members, "a"), "class_a").join(side(members, "b"), "class_b")
    columns = ["id_a", "id_b", "relative_path_a", "relative_path_b", "start_line_a", "start_line_b", "end_line_a", "end_line_b"]

    def copies(one: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
        a, b = side(one, "a"), side(other, "b")
        same = [F.col(f"{c}_a") == F.col(f"{c}_b") for c in on]
        return a.join(b, same).where("id_a < id_b").select(*columns)

    pairs = across.select(*columns).union(_self_join(members, "class", "id", copies))
    apart = F.expr("coalesce(NOT (relative_path_a = relative_path_b AND start_line_a <= end_line_b AND start_line_b <= end_line_a), true)")
    return pairs.where(apart & (F.col("id_a") != F.col("id_b"))).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk: its class (the least id with the same words), copies in it and links of the class to others."""
    members, links = similar_sets(_chunks(spark, folder), "id", "content")
    ends = links.select(F.col("class_a").alias("class")).union(links.select("class_b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    heads = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    rows = members.join(heads, "class").join(ends, "class", "left")
    return rows.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the links found for the chunks whose hash is divisible by 20, against the way without a loss over all rows."""
    chunks, asked = _chunks(spark, folder), F.pmod(F.xxhash64("id"), F.lit(20)) == 0
    true = similar_sets(chunks, "id", "content", exact=True, asked=asked)[1].select("class_a", "class_b")
    found = similar_sets(chunks, "id", "content")[1].select("class_a", "class_b", F.lit(1).alias("_hit"))
    both = true.join(found, ["class_a", "class_b"], "left")
    return both.agg(F.count(F.lit(1)).alias("true_links"), F.round(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0)), 4).alias("recall"))


P2_WORDS = """
words AS (SELECT DISTINCT id, relative_path AS p, start_line AS s, end_line AS e, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS w FROM chunks),
sized AS (SELECT id, p, s, e, count(*) AS n FROM words GROUP BY ALL HAVING count(*) >= 20),
common AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
"""
P2_SQL = f"""
WITH {P2_WORDS}
SELECT id_a, id_b FROM common JOIN sized a ON a.id = id_a JOIN sized b ON b.id = id_b
WHERE c >= 0.7 * (a.n + b.n - c) AND NOT (a.p = b.p AND a.s <= b.e AND b.s <= a.e)
"""
