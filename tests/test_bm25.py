"""BM25 for batches of queries: against SQL on odd rows, against all scores over many blocks, and the disk it takes."""

import os
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from quillon.operators import bm25
from quillon.plans.catalogue import QUERIES, SQL
from quillon.session import ensure_checkpoint_dir
from tests.oracle import rows_by_sql, rows_of


def folder_of(spark, path, chunks, queries):
    spark.createDataFrame(chunks, "id string, language string, symbol_name string, content string").toPandas().to_parquet(f"{path}/chunks.parquet")
    spark.createDataFrame(queries, "query_id long, query string").toPandas().to_parquet(f"{path}/search_queries.parquet")
    return str(path)


def disk(spark):
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return sum(os.path.getsize(os.path.join(at, name)) for folder in folders for at, _, names in os.walk(folder) for name in names)


def test_batch_takes_less_disk_than_four_times_its_texts(spark, tmp_path):
    some = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    chunks = [(f"c{i}", "rust", f"name_{i}", " ".join(some.choices(words, k=150))) for i in range(1500)]
    folder = folder_of(spark, tmp_path, chunks, [(i, " ".join(some.sample(words, 4))) for i in range(400)])
    before = disk(spark)
    assert len(QUERIES["bm25_batch"](spark, folder).collect()) == 4000
    assert disk(spark) - before < 4 * sum(len(c[3]) for c in chunks)


def test_batch_on_odd_rows(spark, tmp_path):
    chunks = [(f"k{i:02d}", "rust", f"name_{i % 7}", "alpha beta " * (i % 5 + 1) + f"w{i % 11} gamma") for i in range(12)]
    chunks += chunks[:3] + [("k03", "go", *chunks[3][2:]), ("k04", "rust", "x", "w5"), ("n1", None, None, None), ("n2", None, None, "gamma"), ("n3", None, "w5", None), ("n4", "", "", "")]
    queries = [(1, "alpha gamma"), (2, "w3 beta beta"), (2, "w3 beta beta"), (3, "name"), (3, "w5"), (4, None), (5, "missing"), (None, "w7")]
    folder = folder_of(spark, tmp_path, chunks, queries)
    assert rows_of(QUERIES["bm25_batch"](spark, folder)) == rows_by_sql(folder, SQL["bm25_batch"])
    assert rows_of(QUERIES["bm25_batch"](spark, folder_of(spark, tmp_path, chunks[:0], queries)))[1].total() == 0
    assert rows_of(QUERIES["bm25_batch"](spark, folder_of(spark, tmp_path, chunks, queries[:0])))[1].total() == 0


def test_batch_in_several_passes(spark, data, monkeypatch):
    monkeypatch.setattr(bm25, "ASKED_WORDS", 3)
    assert rows_of(QUERIES["bm25_batch"](spark, data)) == rows_by_sql(data, SQL["bm25_batch"])


def test_best_keys_over_many_blocks(monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_KEYS", 64)
    some, terms, limit = np.random.default_rng(7), 30, 2
    asked = [np.sort(some.choice(terms, some.integers(1, 9), replace=False)) for _ in range(50)]
    qf = [some.integers(1, 3, len(a)).astype(float) for a in asked]
    idf, avgdl = np.abs(some.normal(2, 1.5, 2 * terms)), np.array([20.0, 3.0])
    docs, scores = [], defaultdict(list)
    for i in range(1000):
        code = np.sort(some.choice(2 * terms, some.integers(0, 12), replace=False))
        tf, dl = some.integers(1, 4, len(code)), np.where(code < terms, 20, 3)  # few different rows: many ties
        docs.append({"key": f"d{i * 7919 % 1000:03d}", "codes": code, "tfs": tf, "dls": dl})
        weight = dict(zip(code.tolist(), (idf[code] * tf * 2.2 / (tf + 1.2)).tolist()))
        for q, own in enumerate(asked):
            score = sum(f * (weight.get(t, 0) + weight.get(t + terms, 0)) for t, f in zip(own.tolist(), qf[q]))
            if score > 0:
                scores[q].append((-round(score, 6), docs[-1]["key"]))
    table = pa.Table.from_pylist(docs, pa.schema([("key", pa.string()), *[(c, pa.list_(pa.int32())) for c in ("codes", "tfs", "dls")]]))
    listed = pa.array(range(50)), np.cumsum([0, *map(len, asked)]), np.concatenate(asked), np.concatenate(qf)
    got = defaultdict(list)
    for b in bm25._scored(listed, idf, avgdl, terms, limit)(iter(table.to_batches(max_chunksize=32))):
        for r in b.to_pylist():
            got[r["query_id"]].append((-r["score"], r["key"]))
    assert got == {q: sorted(x)[:limit] for q, x in scores.items()}
