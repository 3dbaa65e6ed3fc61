"""Index tables in a shared folder: one writer, parts that are only ever added, an atomic pointer.

An upsert writes one part of every table, of the paths it touches alone, and a list of these paths; the pointer file is replaced last, once.
A reader sees the former or the new state, whole. Rows of a path count if no later part touches the path. After COMPACT parts the
next write puts all rows in force in one. All files are reached through Spark's file systems, so any shared or object store will do.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import vectors
from quillon.operators.bm25 import postings
from quillon.operators.chunking import call_edges, structure_chunks
from quillon.session import stored

#: Parts after which a write compacts, and touched paths that are broadcast.
COMPACT, BROADCAST_PATHS = 16, 1 << 17
FIELDS = ["content", "symbol_name"]


class _Folder:
    """Small files of a folder on any of Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._conf, self._path = conf, self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(conf)
        self.fs.mkdirs(self._path(self.root))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> str | None:
        path = self._path(self.at(name))
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside the file and renames over it."""
        fresh = self._path(self.at(f"{name}.{uuid.uuid4().hex[:8]}"))
        out = self.fs.create(fresh, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        gateway_array = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        gateway_array[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else self.fs.getUri(), self._conf)
        context.rename(fresh, self._path(self.at(name)), gateway_array)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)


class IndexStore:
    """Tables chunks, state (path, content_hash), postings, sizes, edges and vectors; all have the path of their file.

    postings: key, field, term, tf, dl; sizes: key, field, dl.
    """

    TABLES = ("chunks", "state", "postings", "sizes", "edges", "vectors")

    def __init__(self, spark: SparkSession, root: str, width: int = 256):
        self.spark, self.root, self.width = spark, root, width
        self.folder = _Folder(spark, root)
        self.folder.replace(".gitignore", "*\n") if self.folder.read(".gitignore") is None else None

    def _pointer(self) -> dict:
        return json.loads(self.folder.read("CURRENT") or "{}")

    def exists(self, name: str) -> bool:
        return name in self.TABLES and bool(self._pointer().get("parts"))

    def read(self, name: str) -> DataFrame:
        """The rows in force of a table."""
        parts = self._pointer()["parts"]
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(self.folder.at(f"{v}/{name}")).withColumn("_part", F.lit(i)) for i, v in enumerate(parts)])
        if len(parts) > 1:
            touched = reduce(DataFrame.union, [self.spark.read.parquet(self.folder.at(f"{v}/touched")).select("path", F.lit(i).alias("_last")) for i, v in enumerate(parts) if i])
            last = touched.groupBy("path").agg(F.max("_last").alias("_last"))
            last = F.broadcast(last) if touched.count() <= BROADCAST_PATHS else last
            rows = rows.join(last, "path", "left").where(F.col("_part") >= F.coalesce("_last", F.lit(0)))
        return rows.drop("_part", "_last")

    def commit(self, tables: dict[str, DataFrame], touched: DataFrame, whole: bool = False) -> None:
        """Adds a part of all tables for the paths touched and switches to it; whole: it stands in place of all others, which are removed at the next write."""
        pointer, version = self._pointer(), f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(self.folder.at(f"{version}/{name}"))
        touched.select("path").distinct().write.parquet(self.folder.at(f"{version}/touched"))
        parts = [version] if whole else [*pointer.get("parts", []), version]
        old = pointer.get("parts", []) if whole else []
        self.folder.replace("CURRENT", json.dumps({"parts": parts, "width": self.width, "old": old}))
        for v in pointer.get("old", []):
            self.folder.delete(v)
        if len(parts) > COMPACT:
            self.compact()

    def compact(self) -> None:
        """Puts the rows in force in one part."""
        self.commit({name: self.read(name) for name in self.TABLES}, self.read("state"), whole=True)

    def changed(self, files: DataFrame) -> DataFrame:
        """Files whose content the index does not hold."""
        if not self.exists("state"):
            return files
        return files.join(self.read("state"), ["path", "content_hash"], "left_anti")

    def upsert(self, files: DataFrame, complete: bool = True) -> int:
        """Index changed files; returns the number of chunks made anew.

        complete: files are all there are, so paths that are gone leave the index; else only the given paths are touched.
        Unchanged files are not read into chunks, postings, edges or vectors again, and doing the same twice changes nothing. A width
        other than the stored one makes the vectors of all chunks anew.
        """
        new = self.changed(files)
        fresh = stored(structure_chunks(new).withColumn("path", F.col("relative_path")))
        made, touched = fresh.count(), new.select("path")
        known = self.exists("state")
        if known and self._pointer()["width"] != self.width:
            kept = {name: self.read(name).join(touched, "path", "left_anti") for name in self.TABLES}
            if complete:
                kept = {name: df.join(files.select("path"), "path", "left_semi") for name, df in kept.items()}
            kept["vectors"] = self._vectors(kept["chunks"])
            added = self._derived(fresh, new)
            self.commit({name: kept[name].unionByName(added[name]) for name in self.TABLES}, touched, whole=True)
            return made
        if known and complete:
            touched = touched.union(self.read("state").select("path").join(files.select("path"), "path", "left_anti"))
        touched = stored(touched.distinct())
        if not known or not touched.isEmpty():
            self.commit(self._derived(fresh, new), touched)
        return made

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        text = F.format_string("%s %s %s\n%s", "language", "symbol_kind", "symbol_name", "content")
        return vectors.embed(chunks.select("path", F.col("id").alias("chunk_id"), text.alias("_text")), F.col("_text"), self.width).select("path", "chunk_id", "vector")

    def _derived(self, chunks: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
        """Rows of all tables of new chunks. Postings lie in order of terms, so that a reader of few terms skips the rest."""
        paths = chunks.select(F.col("id").alias("key"), "path").distinct()
        terms = postings(chunks, "id", FIELDS).join(paths, "key")
        sizes = terms.select("path", "key", "field", "dl").distinct()
        return {
            "chunks": chunks,
            "state": files.select("path", "content_hash").distinct(),
            "postings": terms.repartitionByRange("term").sortWithinPartitions("term"),
            "sizes": sizes,
            "edges": call_edges(chunks).withColumn("path", F.col("caller_file")),
            "vectors": self._vectors(chunks),
        }

    def bm25_index(self) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) for bm25.score_queries; a field without a term in a chunk counts as empty there."""
        n = self.read("chunks").select("id").distinct().count()
        sums = self.read("sizes").groupBy("field").agg(F.sum("dl").alias("_sum"))
        every = self.spark.createDataFrame([(f,) for f in FIELDS], "field string").join(sums, "field", "left")
        return self.read("postings").drop("path"), every.select(F.lit(n).alias("n"), "field", (F.coalesce("_sum", F.lit(0)) / F.lit(max(n, 1))).alias("avgdl"))

    def remove_file(self, path: str) -> None:
        """Takes a file out of all tables: a part without rows that touches it."""
        gone = self.spark.createDataFrame([(path,)], "path string")
        self.commit({name: self.read(name).limit(0) for name in self.TABLES}, gone)
