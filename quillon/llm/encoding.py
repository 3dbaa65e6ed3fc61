"""Byte-level BPE encoding of text columns with a public vocabulary (problem 8).

Everything runs inside the JVM, in three steps:

1. A text is cut into words by the tokenizer's pattern and its words are looked up as byte arrays. What is found gives ids at once;
   words that are no token leave a mark. Until the end a text's ids are one string of numbers, which is stored and read as one value.
2. The distinct words that are no token are folded, each one once: ``aggregate`` joins, step by step, the adjacent pair of lowest
   rank, until no pair is left that has a rank.
3. The folded words are joined back to the texts that hold them, and put in place of the marks.

The rank map is a literal of the plan: a table of one row, an array of small maps addressed by crc32 (Spark scans a map from its
start), put into expressions as a scalar subquery. So plans carry a reference to it and not its text. The most frequent words that need
folding (at most ``max_words``, counted on a bounded sample) are folded first and looked up in the same map; it keeps words that
stand in many texts out of the join. The result doesn't depend on which words these are.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import spread, stored
from quillon.sources.tables import table

#: The public pattern of the tokenizer, written without backtracking; (?U) makes \s the Unicode white space.
WORD_PATTERN = r"(?U)'(?:[stmd]|re|ve|ll)| ?+(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s++"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

BUCKETS = 1 << 16
NO_RANK = 1 << 30
#: Words of more bytes are folded by a way that costs more per step and takes fewer steps: all places of a pair in one.
LONG = 512
#: Marks around a piece in that way; outside the 256 chars that stand for bytes.
LEFT, RIGHT = "Ā", "ā"
#: Bits of a place in a word of at most LONG bytes.
PLACE = 10
ALL = (1 << PLACE) - 1
#: Between the numbers of a text's ids, and in place of a word that is still open.
COMMA, OPEN = ",", "_"
#: Bounds of the table of frequent words and of the sample it is counted on.
MAX_WORDS, SAMPLE_ROWS = 1 << 16, 4_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; a fold over nothing hands it on without a copy."""
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def _look_up(table: Column, key: Column) -> Column:
    return F.try_element_at(F.get(table, F.crc32(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), key)


def _rank(table: Column, piece: Column) -> Column:
    return F.coalesce(_look_up(table, piece), F.lit(NO_RANK))


def fold_word(word: Column, table: Column) -> Column:
    """The ids of one word (its bytes), by ranked merges; table has the ranks."""
    return F.when(F.octet_length(word) <= LONG, _fold(word, table)).otherwise(_fold_long(word, table))


def _fold(word: Column, table: Column) -> Column:
    """State: a number for each pair of adjacent pieces, in order: rank, start, border and end of the pair, so the least is the first of lowest rank.

    A step takes that pair out and makes the numbers of its two neighbours again, which are known by their borders.
    """
    n = F.octet_length(word)

    def part(pair: Column, shift: int) -> Column:
        return F.shiftright(pair, shift).bitwiseAND(F.lit(ALL)).cast("int")

    def start(pair: Column) -> Column:
        return part(pair, 2 * PLACE)

    def border(pair: Column) -> Column:
        return part(pair, PLACE)

    def end(pair: Column) -> Column:
        return part(pair, 0)

    def rank(start: Column, end: Column) -> Column:
        return _rank(table, F.substring(word, start + 1, end - start))

    def pair(start: Column, border: Column, end: Column) -> Column:
        return rank(start, end).cast("bigint") * (1 << 3 * PLACE) + (start * (1 << 2 * PLACE) + border * (1 << PLACE) + end)

    def step(pairs: Column, _: Column) -> Column:
        def joined(low: Column) -> Column:
            # its start and its end, as they stand in a neighbour's number for the border
            before, behind = F.shiftright(low.bitwiseAND(F.lit(ALL << 2 * PLACE)), PLACE), F.shiftleft(low.bitwiseAND(F.lit(ALL)), PLACE)

            def ranked(before: Column, behind: Column) -> Column:
                def again(p: Column) -> Column:
                    at = p.bitwiseAND(F.lit(ALL << PLACE))
                    return F.when(at == before, pair(start(p), start(low), end(low))).when(at == behind, pair(start(low), end(low), end(p))).otherwise(p)

                return F.transform(F.array_remove(pairs, low), again)

            return let(before, lambda x: let(behind, lambda y: ranked(x, y)))

        return let(F.array_min(pairs), lambda low: F.when(low < NO_RANK << 3 * PLACE, joined(low)).otherwise(pairs))

    borders = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    first = F.when(n > 1, F.transform(borders, lambda i: pair(i - 1, i, i + 1))).otherwise(F.array().cast("array<bigint>"))

    def ids(pairs: Column) -> Column:
        last = F.coalesce(border(F.get(pairs, F.size(pairs) - 1)), F.lit(0))
        return F.array_append(F.transform(pairs, lambda p: rank(start(p), border(p))), rank(last, n))

    return let(F.aggregate(borders, first, step), ids)


def _fold_long(word: Column, table: Column) -> Column:
    """State: the marked pieces as one string with a char per byte. A step joins the pair of lowest rank wherever it stands."""

    def pieces(marked: Column) -> Column:
        return F.split(F.substring(marked, F.lit(2), F.length(marked) - 2), RIGHT + LEFT)

    def rank(piece: Column) -> Column:
        return _rank(table, F.encode(piece, "ISO-8859-1"))

    def lowest(p: Column) -> Column:
        return F.array_min(
            F.transform(
                F.sequence(F.lit(0), F.size(p) - 2),
                lambda i: F.struct(rank(F.concat(F.get(p, i), F.get(p, i + 1))).alias("rank"), F.get(p, i).alias("left"), F.get(p, i + 1).alias("right")),
            )
        )

    def step(state: Column, _: Column) -> Column:
        def merged(m: Column) -> Column:
            pair = F.concat(F.lit(LEFT), m.left, F.lit(RIGHT + LEFT), m.right, F.lit(RIGHT))
            text = F.replace(state.text, pair, F.concat(F.lit(LEFT), m.left, m.right, F.lit(RIGHT)))
            return F.when(
                m.rank < NO_RANK,
                F.struct(text.alias("text"), (F.instr(text, RIGHT + LEFT) > 0).alias("open")),
            ).otherwise(F.struct(state.text.alias("text"), F.lit(False).alias("open")))

        return F.when(state.open, let(let(pieces(state.text), lowest), merged)).otherwise(state)

    start = F.struct(F.regexp_replace(F.decode(word, "ISO-8859-1"), "(?s)(.)", f"{LEFT}$1{RIGHT}").alias("text"), F.lit(True).alias("open"))
    done = F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step, lambda state: pieces(state.text))
    return F.transform(done, rank)


class Encoder:
    """Encodes text columns with one vocabulary; what it broadcasts is bounded by the vocabulary's file and ``max_words``."""

    def __init__(self, spark: SparkSession, path: str = VOCABULARY, max_words: int = MAX_WORDS, sample_rows: int = SAMPLE_ROWS):
        self.spark, self.max_words, self.sample_rows = spark, max_words, sample_rows
        self.ranks = load_ranks(path)

    def _map(self, entries: dict, kind: pa.DataType) -> Column:
        """entries as an array of maps; the entry of key k lies in map crc32(k) mod BUCKETS."""
        maps: list[list] = [[] for _ in range(BUCKETS)]
        for entry in entries.items():
            maps[zlib.crc32(entry[0]) % BUCKETS].append(entry)
        return self.spark.createDataFrame(pa.table({"maps": pa.array([maps], pa.list_(pa.map_(pa.binary(), kind)))})).scalar()

    def _found(self, texts: DataFrame, text: str, ids: dict, kind: pa.DataType, body) -> DataFrame:
        """texts with _looked = body(words, found): the words of the text and what ids, of this kind, has for each (null for words that are no key)."""

        def found(maps: Column, words: Column) -> Column:
            return F.transform(words, lambda w: _look_up(maps, w.cast("binary")))

        looked = let(F.col("_maps"), lambda m: let(split_words(F.col(text)), lambda w: let(found(m, w), lambda f: body(w, f))))
        return texts.withColumn("_maps", self._map(ids, kind)).withColumn("_looked", looked).drop("_maps")

    def _looked_up(self, texts: DataFrame, text: str, frequent: dict[bytes, list[int]], body) -> DataFrame:
        """texts with _looked = body(words, found, open): the words of the text, the ids of each (null for words that are no key) and the places of these, from 1."""

        def places(found: Column) -> Column:
            return F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: F.get(found, i - 1).isNull()))

        ids = {token: [rank] for token, rank in self.ranks.items()} | frequent
        return self._found(texts, text, ids, pa.list_(pa.int32()), lambda w, f: let(places(f), lambda o: body(w, f, o)))

    def fold(self, words: DataFrame, word: str) -> DataFrame:
        """words with a column ids: the ids of each row's word."""
        folded = words.withColumn("_maps", self._map(self.ranks, pa.int32()))
        return folded.withColumn("ids", let(F.col("_maps"), lambda m: let(F.col(word).cast("binary"), lambda w: fold_word(w, m)))).drop("_maps")

    def frequent(self, texts: DataFrame, text: str) -> dict[bytes, list[int]]:
        """Ids of words that often need folding: at most max_words, counted on about sample_rows rows."""
        if self.max_words < 1:
            return {}
        step = max(1, texts.count() // self.sample_rows)
        sample = self._looked_up(texts.where(F.pmod(F.xxhash64(text), F.lit(step)) == 0).select(text), text, {}, _unknown)
        unknown = sample.select(F.explode("_looked").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
        top = unknown.where("_n > 1").orderBy(F.desc("_n"), "_word").limit(self.max_words)
        rows = self.fold(top.select("_word").repartition(self.spark.sparkContext.defaultParallelism), "_word").toArrow()
        return {w.encode(): ids for w, ids in zip(rows.column("_word").to_pylist(), rows.column("ids").to_pylist(), strict=True)}

    def looked_up(self, texts: DataFrame, text: str, frequent: dict[bytes, list[int]]) -> DataFrame:
        """texts with _open, the words that are neither tokens nor frequent, in order, and _runs, the ids before, between and behind them."""

        def parts(words: Column, found: Column, places: Column) -> Column:
            def run(place: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(places, i - 1)).otherwise(F.lit(0))
                return F.flatten(F.slice(found, before + 1, place - before - 1))

            runs = F.transform(F.array_append(places, F.size(found) + 1), run)
            return F.struct(runs.alias("_runs"), _unknown(words, found, places).alias("_open"))

        looked = self._looked_up(texts, text, frequent, parts)
        return looked.select(*texts.columns, "_looked.*")

    def marked(self, texts: DataFrame, text: str, frequent: dict[bytes, list[int]]) -> DataFrame:
        """texts with _numbers, their ids as one string with OPEN for words that are neither tokens nor frequent, and _open, these words, in order."""

        def parts(words: Column, found: Column) -> Column:
            return F.struct(F.array_join(found, COMMA, OPEN).alias("_numbers"), F.filter(words, lambda _, i: F.get(found, i).isNull()).alias("_open"))

        ids = {token: str(rank) for token, rank in self.ranks.items()} | {w: COMMA.join(map(str, ids)) for w, ids in frequent.items()}
        return self._found(texts, text, ids, pa.string(), parts).select(*texts.columns, "_looked.*")

    def folded(self, rows: DataFrame, word: str, form=lambda ids: ids) -> DataFrame:
        """rows with the column ids of their word, in this form; every distinct word is folded once."""
        words = self.fold(rows.select(word).distinct(), word)
        return rows.join(words.withColumn("ids", form(F.col("ids"))).hint("shuffle_hash"), word)


def _unknown(words: Column, found: Column, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(words, i - 1))


def encode_table(texts: DataFrame, column: str = "text", out: str = "ids", path: str = VOCABULARY, max_words: int = MAX_WORDS, keep: list[str] | None = None) -> DataFrame:
    """texts with a further column of ids; an existing column of that name is replaced. keep: the columns wanted, all by default.

    Null and empty texts have an empty list. Repeated rows and further columns change nothing; an empty table gives an empty one.
    """
    encoder = Encoder(texts.sparkSession, path, max_words)
    kept = [c for c in (keep if keep is not None else texts.columns) if c != out]
    renamed = texts.select(F.col(column).alias("_text"), F.struct(*kept).alias("_kept")) if kept else texts.select(F.col(column).alias("_text"))
    numbered = renamed.withColumn("_row", F.monotonically_increasing_id())
    rows = stored(encoder.marked(numbered, "_text", encoder.frequent(renamed, "_text")).drop("_text"))
    words = encoder.folded(rows.select("_row", F.posexplode("_open").alias("_at", "_word")), "_word", lambda ids: F.array_join(ids.cast("array<string>"), COMMA))
    # gathered where they are needed, and met by hash: neither texts' ids nor words are sorted
    lists = words.repartition("_row").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "ids"))).alias("_lists")).hint("shuffle_hash")
    filled = F.array_join(F.transform(F.split("_numbers", OPEN), lambda part, i: F.concat(part, F.coalesce(F.get("_lists.ids", i), F.lit("")))), "")
    whole = rows.drop("_open").join(lists, "_row", "left").select(*(["_kept"] if kept else []), filled.alias("_filled"))
    ids = F.when(F.col("_filled") == "", F.array().cast("array<int>")).otherwise(F.split("_filled", COMMA).cast("array<int>"))
    return whole.select(*(["_kept.*"] if kept else []), ids.alias(out))


def decode_table(rows: DataFrame, column: str = "ids", out: str = "text", path: str = VOCABULARY) -> DataFrame:
    """rows with the text of a list of ids: their binary pieces in a row, read as UTF-8. Null for a null list."""
    ranks = load_ranks(path)
    order = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = rows.sparkSession.createDataFrame(pa.table({"pieces": [[t.hex() for t in order]]})).scalar()
    text = let(F.col("_pieces"), lambda p: F.decode(F.unhex(F.array_join(F.transform(column, lambda i: F.get(p, i)), "")), "UTF-8"))
    return rows.withColumn("_pieces", pieces).withColumn(out, text).drop("_pieces")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_table(spread(table(spark, folder, "documents").select("doc_id", "text")), keep=["doc_id"])
