"""BM25 over chunk fields: queries in a small language, and batches of queries over an inverted index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions.text import words
from quillon.session import cut, spread, stored

K1, B = 1.2, 0.75
#: Largest table of asked terms that is broadcast.
BROADCAST_TERMS = 1 << 16
#: Words of queries that are scored in one pass over the texts; more are scored in several.
ASKED_WORDS = 1 << 18
#: Keys and postings that are scored at once.
BLOCK_KEYS, BLOCK_POSTINGS = 1 << 15, 1 << 20
#: A word that occurs in more than this share of a block's keys has its weights as a row over all of them.
DENSE = 1 / 32
#: Scores are compared when rounded to six places, and added up in single precision before; bounds leave room for both.
SLACK, SINGLE = 2e-6, 2.0**-22


def _text(field: str) -> Column:
    return F.coalesce(F.col(field).cast("string"), F.lit(""))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(avgdl, F.lit(1e-9))))


def postings(docs: DataFrame, key: str, fields: list[str], only: DataFrame | None = None) -> DataFrame:
    """(key, field, term, tf, dl), dl being the number of the field's terms; only the terms of a table, where given. Repeated docs count once."""
    numbered = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("_row"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), words(_text(f)))])).alias("field", "terms"))
    terms = numbered.select("key", "_row", "field", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    if only is not None:
        terms = terms.join(only, "term", "left_semi")
    return terms.groupBy("key", "field", "term", "dl", "_row").agg(F.count(F.lit(1)).alias("tf")).drop("_row").distinct().select("key", "field", "term", "dl", "tf")


def lengths(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n, avgdl), one row a field: documents and their mean number of terms."""
    sizes = docs.select(F.col(key).alias("key"), *[F.size(words(_text(f))).alias(f"d{i}") for i, f in enumerate(fields)]).distinct()
    one = sizes.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"d{i}").alias(f"a{i}") for i in range(len(fields))])
    return one.select("n", F.explode(F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), F.coalesce(F.col(f"a{i}"), F.lit(0.0)))])).alias("field", "avgdl"))


@dataclass(frozen=True)
class Clause:
    """Words that stand next to each other in a field, or in any; sign: + required, - excluded, else optional."""

    sign: str
    field: str | None
    terms: tuple[str, ...]


def parse_query(query: str, fields: tuple[str, ...] = ("content", "symbol_name")) -> list[Clause] | None:
    """Words, "phrases", +required, -excluded and field:word. A word of several parts (read_file, foo::bar) is a phrase.

    None if it cannot be read: blank, an open quotation mark, or a clause without a letter or digit. A prefix that is no field is text.
    """
    if query.count('"') % 2 or not query.strip():
        return None
    out = []
    prefix = "|".join(re.escape(f) for f in fields)
    for sign, field, phrase, word in re.findall(rf'([+-]?)(?:({prefix}):(?!:))?(?:"([^"]*)"|([^\s"]+))', query):
        terms = tuple(w for w in re.split(r"[^\w]+|_", (phrase or word).lower()) if w)
        if not terms:
            return None
        out.append(Clause(sign, field or None, terms))
    return out


def score_queries(docs: DataFrame, queries: DataFrame, key: str, fields: list[str], index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, key, score) for queries(query_id, query): sums over words and fields; a word asked for twice counts twice.

    Only terms that are asked for leave the scan, and no text is moved; document frequencies come from the same postings. index: stored
    (postings, lengths) that are read in place of docs.
    """
    asked = queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    asked = cut(asked)
    terms = asked.select("term").distinct()
    small = (lambda t: F.broadcast(t)) if terms.count() <= BROADCAST_TERMS else (lambda t: t)
    stored, totals = index or (None, lengths(docs, key, fields))
    wanted = cut(stored.where(F.col("field").isin(fields)).join(small(terms), "term", "left_semi") if index else postings(docs, key, fields, small(terms)))
    df = wanted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = df.join(F.broadcast(totals), "field")  # one row per field
    weight = _idf(F.col("n"), F.col("df")) * _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"))
    weighted = wanted.join(small(stats), ["field", "term"]).select("key", "term", weight.alias("w"))
    return weighted.join(small(asked) if asked.count() <= BROADCAST_TERMS else asked, "term").groupBy("query_id", "key").agg(F.sum(F.col("w") * F.col("qf")).alias("score"))


def best_of_queries(docs: DataFrame, queries: DataFrame, key: str, fields: list[str], limit: int) -> DataFrame:
    """(query_id, key, score) for queries(query_id, query): a superset of the best limit keys of each query, at most limit a task.

    Scores are sums over words, fields and the distinct rows of a key, rounded to six places; ties go to the least key. A word asked for twice
    counts twice. Rows equal in all columns count once, rows of one key with as many words in a field are one document, a missing text has no
    length. Texts are cut up where they are read; a row of numbers per key is shuffled and stored once. Pairs of queries and documents
    are never rows: each task keeps the best keys of all queries while it reads its documents.
    """
    asked = cut(queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")))
    passes = max(1, -(-asked.count() // ASKED_WORDS))
    groups = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) for i in range(passes)] if passes > 1 else [asked]
    return reduce(DataFrame.union, [_best_of(docs, g, key, fields, limit) for g in groups])


def _best_of(docs: DataFrame, asked: DataFrame, key: str, fields: list[str], limit: int) -> DataFrame:
    out = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("key", docs.schema[key].dataType), StructField("score", DoubleType())])
    table = asked.toArrow()
    terms = pc.unique(table["term"]).sort()
    if not len(terms) or limit < 1:
        return docs.sparkSession.createDataFrame([], out)
    ids = table["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    query, term = ids.indices.to_numpy(), pc.index_in(table["term"], terms).to_numpy()
    order = np.lexsort((term, query))
    ends = np.searchsorted(query[order], np.arange(len(ids.dictionary) + 1))
    listed = ids.dictionary, ends, term[order], table["qf"].to_numpy()[order].astype(float)

    row = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]).alias("row")
    cut_up = docs.select(F.col(key).alias("key"), row, *[words(F.col(f).cast("string")).alias(f"w{i}") for i, f in enumerate(fields)])
    kind = StructType([out["key"]])
    numbers = cut_up.mapInArrow(_counted(terms, len(fields)), f"{_ddl(kind)}, row long, lens array<int>, codes array<int>, tfs array<int>")
    by_key = numbers.repartition("key").groupBy("key").agg(F.collect_set(F.struct("row", "lens", "codes", "tfs")).alias("rows"))
    rows = stored(by_key.mapInArrow(_merged(len(terms), len(fields)), f"{_ddl(kind)}, n long, sums array<long>, counts array<long>, codes array<int>, tfs array<int>, dls array<int>"))

    places = range(len(fields))
    one = rows.agg(F.sum("n").alias("n"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("sums", "counts") for i in places]).first()  # one row
    met = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row per asked word and field
    df = np.zeros(len(fields) * len(terms))
    df[met["code"].to_numpy()] = met["df"].to_numpy()
    idf = np.log(1 + ((one.n or 0) - df + 0.5) / (df + 0.5))
    avgdl = np.array([(one[f"sums{i}"] or 0) / max(one[f"counts{i}"] or 0, 1) for i in places])
    narrow = spread(rows.select("key", "codes", "tfs", "dls")).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    return narrow.mapInArrow(_scored(listed, idf, avgdl, len(terms), limit), out)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of lists, -1 for null, and the number of the list that each is in."""
    return pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _as_lists(owner: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    """Lists 0 to n - 1 of the items, which lie in order of their lists."""
    ends = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(c, pa.int32())) for c in columns]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _counted(terms: pa.Array, fields: int) -> Callable:
    """Of each row the number of words in each field, null without a text, and the asked words (field x terms + term) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = fields * len(terms)
        for b in batches:
            met, lens = [], []
            for i in range(fields):
                texts = b.column(2 + i)
                lens.append(pc.list_value_length(texts))
                code = pc.fill_null(pc.index_in(texts.flatten(), terms.cast(texts.type.value_type)), -1).to_numpy(zero_copy_only=False)
                at = np.flatnonzero(code >= 0)
                met.append(pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)[at].astype(np.int64) * wide + i * len(terms) + code[at])
            place, tf = np.unique(np.concatenate(met), return_counts=True)
            side_by_side = pa.concat_arrays([x.cast(pa.int32()) for x in lens]).take(pa.array(np.arange(fields * b.num_rows).reshape(fields, -1).T.ravel()))
            ends = pa.array(np.arange(b.num_rows + 1) * fields, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, side_by_side), *_as_lists(place // wide, b.num_rows, place % wide, tf)], ["key", "row", "lens", "codes", "tfs"])

    return run


def _merged(terms: int, fields: int) -> Callable:
    """One row a key: its distinct rows, the sums and numbers of their lengths by field, and their postings with the lengths these are weighed by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rows = b.num_rows, b.column(1)
            of_key = pc.list_parent_indices(rows).to_numpy(zero_copy_only=False)
            _, lens, codes, tfs = rows.flatten().flatten()
            lens, (code, of_row), (tf, _) = _flat(lens)[0].reshape(-1, fields), _flat(codes), _flat(tfs)
            owner, dl = of_key[of_row], lens[of_row, code // terms]
            if len(of_key) > n:
                order = np.lexsort((dl, code, owner))
                owner, code, dl, tf = owner[order], code[order], dl[order], tf[order]
                if len(first := _starts(owner, code, dl)):
                    owner, code, dl, tf = owner[first], code[first], dl[first], np.add.reduceat(tf, first)
            sums, counts = np.zeros((n, fields), np.int64), np.zeros((n, fields), np.int64)
            np.add.at(sums, of_key, np.maximum(lens, 0))
            np.add.at(counts, of_key, lens >= 0)
            ends = pa.array(np.arange(n + 1) * fields, pa.int32())
            totals = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (sums, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(of_key, minlength=n)), *totals, *_as_lists(owner, n, code, tf, dl)], ["key", "n", "sums", "counts", "codes", "tfs", "dls"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, keys, items = [], 0, 0
    for b in batches:
        held, keys, items = [*held, b], keys + b.num_rows, items + len(b.column(1).flatten())
        if keys >= BLOCK_KEYS or items >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held)
            held, keys, items = [], 0, 0
    if keys:
        yield pa.Table.from_batches(held)


def _scored(listed: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray], idf: np.ndarray, avgdl: np.ndarray, terms: int, limit: int) -> Callable:
    """The best limit keys of every query among a task's keys. listed: query ids, where each one's words end, the words and their counts.

    Weights are added up block by block in single precision, for blocks whose greatest weights can reach the query's least score so far. What may
    be among the best by that is scored anew in double precision.
    """
    ids, ends, asked, counts = listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(len(ids))]
        least = np.full(len(ids), -np.inf)
        kind = None
        for block in _blocks(batches):
            keys, codes, tfs, dls = (c.combine_chunks() for c in block.columns)
            n, kind = len(keys), keys.type
            order = pc.sort_indices(keys, null_placement="at_start")
            keys, place = keys.take(order), np.empty(n, np.int64)
            place[order.to_numpy()] = np.arange(n)
            (code, owner), (tf, _), (dl, _) = _flat(codes), _flat(tfs), _flat(dls)
            if not len(code):
                continue
            weight = idf[code] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / np.maximum(avgdl[code // terms], 1e-9))))
            where = (code % terms).astype(np.int64) * n + place[owner]
            order = np.argsort(where, kind="stable")
            first = _starts(where[order])
            where, weight = where[order][first], np.add.reduceat(weight[order], first)
            doc, begin = where % n, np.searchsorted(where, np.arange(terms + 1) * n)
            peak, met = np.zeros(terms), np.flatnonzero(begin[1:] > begin[:-1])
            peak[met] = np.maximum.reduceat(weight, begin[met])
            single, rows = weight.astype(np.float32), {}
            for t in np.flatnonzero(np.diff(begin) > DENSE * n).tolist():
                rows[t] = np.zeros(n, np.float32)
                rows[t][doc[begin[t] : begin[t + 1]]] = single[begin[t] : begin[t + 1]]
            names, begin, total, width = keys.to_pylist(), begin.tolist(), np.empty(n, np.float32), n // (4 * limit)
            for q in range(len(ids)):
                own, qf = asked[ends[q] : ends[q + 1]], counts[ends[q] : ends[q + 1]]
                most = qf * peak[own]
                bound = float(most.sum())
                slack = SLACK + SINGLE * (len(own) + 2) * bound
                floor = float(least[q]) - slack
                if bound <= 0 or bound < floor:
                    continue
                total[:] = 0
                for t, f in zip(own.tolist(), qf.tolist()):
                    if t in rows:
                        total += rows[t] if f == 1 else f * rows[t]
                    else:
                        total[doc[begin[t] : begin[t + 1]]] += f * single[begin[t] : begin[t + 1]]
                if floor == -np.inf and width >= 8:  # the limit-th of the greatest totals of parts is a bound for that of all
                    parts = total[: width * 4 * limit].reshape(4 * limit, width).max(axis=1)
                    floor = float(np.partition(parts, -limit)[-limit]) - 2 * slack
                found = np.flatnonzero(total >= max(floor, 1e-30))
                if len(found) > limit:
                    some = total[found]
                    found = found[some >= float(np.partition(some, -limit)[-limit]) - 2 * slack]
                if not len(found):
                    continue
                score = np.zeros(len(found))
                for t, f in zip(own.tolist(), qf.tolist()):
                    a, z = begin[t], begin[t + 1]
                    if z > a:
                        at = np.minimum(np.searchsorted(doc[a:z], found), z - a - 1) + a
                        score += np.where(doc[at] == found, f * weight[at], 0.0)
                score = np.floor(score * 1e6 + 0.5) / 1e6
                top = np.lexsort((found, -score))[:limit]
                top = top[score[top] >= least[q]]
                new = [(-s, names[i] is not None, names[i]) for s, i in zip(score[top].tolist(), found[top].tolist())]
                best[q] = sorted([*best[q], *new])[:limit] if best[q] else new
                if len(best[q]) == limit:
                    least[q] = -best[q][-1][0]
        if kind is not None:
            query = np.repeat(np.arange(len(ids)), [len(x) for x in best])
            flat = [x for own in best for x in own]
            found = pa.table({"query_id": ids.take(pa.array(query)), "key": pa.array([x[2] for x in flat], kind), "score": pa.array([-x[0] for x in flat], pa.float64())})
            yield from found.to_batches(max_chunksize=1 << 16)

    return run


def search(docs: DataFrame, query: str, key: str = "id", fields: tuple[str, ...] = ("content", "symbol_name"), limit: int = 20, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The best limit keys of one query in the query language; blank or unreadable queries and limit 0 find nothing.

    A document is found if every required clause occurs in it, no excluded one does and, without a required one, some optional clause does.
    Its score is the sum over the clauses and fields in which they occur of the BM25 weights of their words. One pass over the texts
    leaves a row of numbers per document; repeated documents count once. Queries of single optional words are answered from an index of stored
    (postings, lengths), where one is given.
    """
    clauses = parse_query(query, fields)
    if clauses is None or limit < 1 or all(c.sign == "-" for c in clauses):
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)
    if index and all(not c.sign and c.field is None and len(c.terms) == 1 for c in clauses):
        asked = docs.sparkSession.createDataFrame([(0, " ".join(c.terms[0] for c in clauses))], "query_id int, query string")
        scored = score_queries(docs, asked, key, list(fields), index)
        return scored.select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)
    terms = sorted({t for c in clauses for t in c.terms})
    cut_up = docs.select(F.col(key).alias("key"), *[words(_text(f)).alias(f"w{i}") for i, f in enumerate(fields)])

    def frequency(i: int, term: str) -> Column:
        return F.size(F.filter(f"w{i}", lambda w: w == term))

    def occurs(i: int, c: Clause) -> Column:
        if c.field not in (None, fields[i]):
            return F.lit(False)
        if len(c.terms) == 1:
            return F.array_contains(f"w{i}", c.terms[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(f"w{i}", " "), F.lit(" ")), F.lit(" " + " ".join(c.terms) + " "))

    places = range(len(fields))
    numbers = [F.size(f"w{i}").alias(f"dl{i}") for i in places]
    numbers += [frequency(i, t).alias(f"tf{i}_{j}") for i in places for j, t in enumerate(terms)]
    numbers += [occurs(i, c).alias(f"in{i}_{k}") for i in places for k, c in enumerate(clauses)]
    rows = cut(cut_up.select("key", *numbers).distinct())
    counts = [F.count_if(F.col(f"tf{i}_{j}") > 0).alias(f"df{i}_{j}") for i in places for j in range(len(terms))]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"dl{i}").alias(f"a{i}") for i in places], *counts).first()  # one row

    def weight(i: int, term: str) -> Column:
        j = terms.index(term)
        return _idf(F.lit(stats.n), F.lit(stats[f"df{i}_{j}"])) * _saturated(F.col(f"tf{i}_{j}"), F.col(f"dl{i}"), F.lit(stats[f"a{i}"] or 0.0))

    def found(k: int) -> Column:
        return F.greatest(*[F.col(f"in{i}_{k}") for i in places]) if len(fields) > 1 else F.col(f"in0_{k}")

    must = [k for k, c in enumerate(clauses) if c.sign == "+"]
    rules = [found(k) for k in must] + [~found(k) for k, c in enumerate(clauses) if c.sign == "-"]
    if not must:
        rules.append(sum((found(k).cast("int") for k, c in enumerate(clauses) if not c.sign), F.lit(0)) > 0)
    for rule in rules:
        rows = rows.where(rule)
    parts = [F.when(F.col(f"in{i}_{k}"), sum((weight(i, t) for t in c.terms), F.lit(0.0))).otherwise(0.0) for k, c in enumerate(clauses) if c.sign != "-" for i in places]
    return rows.select("key", F.round(sum(parts, F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)
