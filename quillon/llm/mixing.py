"""Mixing sources to target weights (problem 9).

Every distinct text gets a 64-bit hash. A source's budget in tokens is met by taking all its texts some whole number of
times and, once more, those whose hash lies below a threshold. The threshold is found by histograms: tokens are summed by
source and the upper bits of the hash; the bucket in which the budget ends is the only one that is looked at again, by its
next bits, until its texts are told apart. Selection is then a filter. Nothing is sorted, and what reaches the driver
is one row per source and level. Thresholds are nested: a larger budget keeps all that a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.encoding import Encoder
from quillon.session import cut, spread, stored
from quillon.sources.tables import table

#: Bits of the hash per level; five levels leave two texts of one source together once in 2^60 pairs.
LEVEL_BITS = 12
LEVELS = 5


def normal_source(source):
    return F.lower(F.trim(source))


def sized_texts(docs: DataFrame) -> DataFrame:
    """(_doc, _source, _hash, _tokens): one row per distinct text.

    A text that several rows hold counts once, under its least doc_id and that row's source; copies are put together before anything is
    encoded. Texts without a token are left out: they weigh nothing.
    """
    encoder = Encoder(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("_doc"), normal_source(F.col("source")).alias("_source"), F.col("text").alias("_text"))
    one = rows.groupBy("_text").agg(F.min(F.struct("_doc", "_source")).alias("_one")).select("_one.*", "_text")
    looked = encoder.looked_up(one, "_text", encoder.frequent(rows, "_text"))
    hashed = F.shiftrightunsigned(F.xxhash64(F.md5("_text")), 64 - LEVEL_BITS * LEVELS).alias("_hash")
    texts = stored(looked.select("_doc", "_source", hashed, F.aggregate("_runs", F.lit(0), lambda n, run: n + F.size(run)).alias("_known"), "_open"))
    words = encoder.folded(texts.select("_doc", "_hash", F.explode("_open").alias("_word")), "_word")
    more = words.groupBy("_doc", "_hash").agg(F.sum(F.size("ids")).alias("_more"))
    whole = texts.drop("_open").join(more, ["_doc", "_hash"], "left")
    return whole.select("_doc", "_source", "_hash", (F.col("_known") + F.coalesce("_more", F.lit(0))).cast("int").alias("_tokens"))


def _thresholds(texts: DataFrame, budgets: dict[str, int]) -> dict[str, int]:
    """Per source the hash below which its texts' tokens come as near to the budget as whole texts allow, from below."""
    spark = texts.sparkSession
    state = {s: (0, b) for s, b in budgets.items() if b > 0}  # hash prefix found so far, budget left
    schema = "_source string, _prefix bigint, _left bigint"
    for level in range(LEVELS):
        if not state:
            break
        rest = LEVEL_BITS * (LEVELS - level - 1)
        edge = spark.createDataFrame([(s, p, b) for s, (p, b) in state.items()], schema)
        held = texts.join(F.broadcast(edge), "_source")  # one row per source of the target table
        if level:
            held = held.where(F.shiftright("_hash", rest + LEVEL_BITS) == F.col("_prefix"))
        histogram = held.groupBy("_source", "_left", F.shiftright("_hash", rest).alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_bucket"))  # at most 2^LEVEL_BITS rows a source
        over = histogram.withColumn("_upto", upto).where("_upto > _left")
        found = over.groupBy("_source").agg(F.min(F.struct("_bucket", (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("left"))).alias("_b"))
        state = {r["_source"]: (r["_b"]["_bucket"], r["_b"]["left"]) for r in found.collect()}
    return {s: p for s, (p, _) in state.items()}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: doc_id, source, tokens, repeats; one row per text used. report, one row per target source: source,
    target_share, available_tokens, max_repeats, mixed_tokens, share, met.

    total_tokens is the size of the mixture. None stands for the largest size at which every source that has any text can give
    its share; a source without text then stays at 0 (met = false) and the others keep their proportions. With
    a larger size, a source that cannot give its share gives all its texts max_repeats times. ``met``: the tokens are
    within the source's largest text of its share. Sources compare without case and outer spaces. Rows of no or an
    unnamed source are not used. Null or non-positive shares count as 0, null or negative max_repeats as 0.
    """
    goals = targets.select(
        normal_source(F.col("source")).alias("_source"),
        F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)).alias("_share"),
        F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("_most"),
    ).where("_source IS NOT NULL")
    goal = {r["_source"]: (float(r["_share"]), int(r["_most"])) for r in goals.collect()}  # one row per named source
    texts = cut(sized_texts(docs.where(normal_source(F.col("source")).isin(list(goal)))))
    have = {r["_source"]: (int(r["n"]), int(r["top"])) for r in texts.groupBy("_source").agg(F.sum("_tokens").alias("n"), F.max("_tokens").alias("top")).collect()}
    room = {s: have.get(s, (0, 0))[0] * most for s, (_, most) in goal.items()}
    if total_tokens is None:
        total_tokens = int(min((room[s] / share for s, (share, _) in goal.items() if share > 0 and room[s] > 0), default=0))
    plan, partial = {}, {}
    for s, (share, most) in goal.items():
        size = have.get(s, (0, 0))[0]
        budget = min(round(share * total_tokens), room[s])
        plan[s] = min(budget // size, most) if size else 0
        if size and plan[s] < most:
            partial[s] = budget - plan[s] * size
    limits = _thresholds(texts, partial)
    rules = texts.sparkSession.createDataFrame([(s, plan[s], limits.get(s, 0)) for s in goal], "_source string, _base int, _limit bigint")
    repeats = (F.col("_base") + (F.col("_hash") < F.col("_limit")).cast("int")).alias("repeats")
    chosen = (
        texts.join(F.broadcast(rules), "_source")  # one row per source of the target table
        .select(F.col("_doc").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), repeats)
        .where("repeats > 0")
    )
    spec = texts.sparkSession.createDataFrame(
        [(s, share, have.get(s, (0, 0))[0], most, round(share * total_tokens), have.get(s, (0, 0))[1]) for s, (share, most) in goal.items()],
        "source string, target_share double, available_tokens bigint, max_repeats int, _want bigint, _top bigint",
    )
    mixed = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    report = spec.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # over the report's few rows
    report = report.withColumn("share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
    near = F.abs(F.col("mixed_tokens") - F.col("_want")) <= F.col("_top")
    report = report.withColumn("met", (F.col("target_share") == 0) | (near & (F.col("available_tokens") > 0)))
    return chosen, report.drop("_want", "_top")


def _tables(spark: SparkSession, folder: str):
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source")), table(spark, folder, "mix_targets")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mix(*_tables(spark, folder))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix(*_tables(spark, folder))[1]


def p9_shares_out_of_reach(spark: SparkSession, folder: str) -> DataFrame:
    """The report for a mixture of a fixed size that small sources cannot fill."""
    return mix(*_tables(spark, folder), total_tokens=1_000_000_000_000)[1]
