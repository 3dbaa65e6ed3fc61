"""Registered queries of the core and the SQL they are checked against. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import bm25, chunking, fusion, graph, search, vectors, wiki
from quillon.operators.context import within_budget
from quillon.session import spread
from quillon.sources import markdown
from quillon.sources.language import detect_language
from quillon.sources.tables import chunks, files_in_force, latest, table, versioned

NOW = "2025-08-28 00:00:00"
WIDTH = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Tables in force, shared by the SQL below.
_FILES = "SELECT path, arg_max(content, indexed_at) AS content FROM files WHERE path IS NOT NULL GROUP BY path"
_CHUNKS = "SELECT DISTINCT * FROM chunks"
_WIKI = "SELECT DISTINCT * FROM wiki"
_USABLE = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_COS = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"
_LINES = "CASE WHEN content = '' THEN [] WHEN content LIKE '%' || chr(10) THEN string_split(content[:-2], chr(10)) ELSE string_split(content, chr(10)) END"


def _vectors(name: str, key: str) -> str:
    return f"SELECT {key}, CAST(min(vector) AS DOUBLE[]) AS v FROM {name} WHERE {_USABLE} GROUP BY {key}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Files and chunks


@query(f"""
WITH f AS ({_FILES}), l AS (SELECT path, list_transform({_LINES}, lambda x: rtrim(x, chr(13))) AS l FROM f),
s AS (SELECT path, l, unnest(range(0, len(l), 80)) AS a FROM l WHERE len(l) > 0)
SELECT path || ':block@L' || (a + 1) || ':' || (a + 1) || '-' || least(a + 80, len(l)) AS id, CAST(a + 1 AS INT) AS start_line, CAST(least(a + 80, len(l)) AS INT) AS end_line,
       md5(array_to_string(l[a + 1 : a + 80], chr(10))) AS content_md5 FROM s""")
def chunk_blocks(spark, folder):
    files = table(spark, folder, "files").withColumn("language", F.lit(None).cast("string"))
    blocks = chunking.block_chunks(versioned(files), keep=("_at",)).select("relative_path", "_at", "id", "start_line", "end_line", F.md5("content").alias("content_md5"))
    return latest(blocks, files, "relative_path").drop("relative_path")


@query(f"WITH c AS ({_CHUNKS}) SELECT count(DISTINCT relative_path) AS files, count(*) AS chunks, count(DISTINCT lower(symbol_name)) AS symbols FROM c")
def chunk_stats(spark, folder):
    c = chunks(spark, folder, "relative_path", "symbol_name")
    return c.agg(F.count_distinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.lower("symbol_name")).alias("symbols"))


@query(f"WITH c AS ({_CHUNKS}) SELECT id, CAST(len({_LINES}) AS INT) AS lines, line_count FROM c WHERE line_count IS DISTINCT FROM len({_LINES})")
def wrong_line_counts(spark, folder):
    lines = T.line_count(F.col("content"))
    return table(spark, folder, "chunks").select("id", lines.alias("lines"), "line_count").where(~F.col("lines").eqNullSafe(F.col("line_count"))).distinct()


@query("SELECT DISTINCT id, CAST(strlen(content) // 4 + 1 AS INT) AS tokens FROM chunks")
def token_estimate(spark, folder):
    return table(spark, folder, "chunks").select("id", T.token_estimate(F.col("content")).alias("tokens")).distinct()


@query("""
WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE left(text, CAST((SELECT max(k) FROM range(0, 201) r(k) WHERE strlen(left(text, CAST(k AS INT))) <= 200) AS INT)) || '...' END AS preview FROM t""")
def preview_truncate(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(f"""
WITH f AS ({_FILES}), e AS (SELECT path, lower(regexp_extract(path, '[^/]\\.([A-Za-z0-9]+)$', 1)) AS x, regexp_extract(content, '^#![^\\n]*?([a-z]+)[0-9.]*[ \\t\\r]*(?:\\n|$)', 1) AS i FROM f)
SELECT path, coalesce(CASE x WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java'
  WHEN 'md' THEN 'markdown' WHEN 'json' THEN 'json' WHEN 'toml' THEN 'toml' END, CASE WHEN i IN ('python', 'bash', 'ruby', 'perl', 'php', 'lua') THEN i WHEN i = 'sh' THEN 'bash' WHEN i = 'node' THEN 'javascript' WHEN i = 'deno' THEN 'typescript' END) AS language FROM e""")
def detect_languages(spark, folder):
    known = detect_language(F.col("path"), F.col("content")).alias("language")
    return files_in_force(table(spark, folder, "files").withColumn("language", known), "language")


@query("""
WITH b AS (SELECT path, sha256(arg_min(content, indexed_at)) AS old, sha256(arg_max(content, indexed_at)) AS new FROM files WHERE path IS NOT NULL GROUP BY path)
SELECT path, new AS content_hash FROM b WHERE old <> new""")
def incremental_skip(spark, folder):
    """Files to index anew if the first state of each path has been indexed."""
    files = table(spark, folder, "files").where("path IS NOT NULL").select("path", "indexed_at", F.sha2("content", 256).alias("content_hash"))
    state = files.groupBy("path").agg(F.min_by("content_hash", "indexed_at").alias("content_hash"))
    return files_in_force(files, "content_hash").join(state, ["path", "content_hash"], "left_anti")


# Look-ups


@query(f"WITH c AS ({_CHUNKS}) SELECT id FROM c WHERE contains(lower(symbol_name || ' ' || relative_path || ' ' || content), 'queue')")
def substring_search(spark, folder):
    return search.substring_chunks(table(spark, folder, "chunks"), "Queue").select("id").distinct()


@query(f"WITH c AS ({_CHUNKS}) SELECT id, symbol_kind FROM c WHERE lower(symbol_name) = 'init'")
def symbol_lookup(spark, folder):
    return search.by_symbol(chunks(spark, folder, "symbol_name", "symbol_kind"), "INIT").select("id", "symbol_kind")


@query(f"WITH c AS ({_CHUNKS}), p AS (SELECT min(relative_path) AS p FROM c) SELECT id, start_line FROM c, p WHERE relative_path = p")
def chunks_for_file(spark, folder):
    c = chunks(spark, folder, "relative_path", "start_line")
    first = c.agg(F.min("relative_path")).first()[0]
    return search.of_file(c, first).select("id", "start_line")


def _grep_sql(test: str) -> str:
    return f"""
WITH f AS ({_FILES}), l AS (SELECT path, list_transform({_LINES}, lambda x: rtrim(x, chr(13))) AS l FROM f WHERE strlen(content) <= 10485760),
n AS (SELECT path, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS line_number FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number) AS i FROM n WHERE {test})
SELECT path, CAST(line_number AS INT) AS line_number, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM h WHERE i <= 10"""


def _grep(spark, folder, query):
    files = table(spark, folder, "files")
    return latest(search.grep(versioned(files), query, keep=("_at",)), files)


@query(_grep_sql("contains(lower(raw), 'cache')"))
def grep_smart_case(spark, folder):
    return _grep(spark, folder, "cache")


@query(_grep_sql("contains(raw, 'TODO')"))
def grep_literal(spark, folder):
    return _grep(spark, folder, "TODO")


@query(_grep_sql("regexp_matches(lower(raw), 'retry\\s+\\w+|queue[0-9]')"))
def grep_regex(spark, folder):
    return _grep(spark, folder, r"retry\s+\w+|queue[0-9]")


_FRECENCY = f"""SELECT path, round(sum(pow(0.5, greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts), 0) / 86400000000.0 / 14.0)), 6) AS frecency
FROM (SELECT DISTINCT path, ts FROM access_log WHERE path IS NOT NULL AND ts IS NOT NULL) GROUP BY path"""


@query(f"WITH r AS ({_FRECENCY}) SELECT path, frecency FROM r WHERE path IN (SELECT path FROM files)")
def frecency_rank(spark, folder):
    live = table(spark, folder, "files").select("path").distinct()
    return search.frecency(table(spark, folder, "access_log"), NOW).join(live, "path", "left_semi")


_FUZZY = r"""fz AS (SELECT path, CASE WHEN regexp_matches(lower(path), 's.*h.*a.*r.*d') THEN
    100 - least(levenshtein(regexp_replace(regexp_extract(lower(path), '([^/]+)$', 1), '\.[^.]*$', ''), 'shard'), 100)
    + CASE WHEN contains(regexp_extract(lower(path), '([^/]+)$', 1), 'shard') THEN 60 WHEN contains(lower(path), 'shard') THEN 30 ELSE 0 END
    + CASE WHEN regexp_replace(regexp_extract(lower(path), '([^/]+)$', 1), '\.[^.]*$', '') = 'shard' THEN 40 ELSE 0 END END AS s FROM paths)"""


@query(f"""
WITH paths AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL), {_FUZZY}, fr AS ({_FRECENCY}),
t AS (SELECT path, round(s + CASE WHEN frecency IS NULL THEN 0.0 ELSE least(frecency * 2, 20.0) END, 6) AS score FROM fz LEFT JOIN fr USING (path) WHERE s IS NOT NULL),
o AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) - 1 AS rank FROM t)
SELECT path, score, CAST(rank AS INT) AS rank FROM o WHERE rank < 30""")
def find_files_fuzzy(spark, folder):
    paths = table(spark, folder, "files").where("path IS NOT NULL").select("path").distinct()
    return search.find_files(paths, "shard", 30, search.frecency(table(spark, folder, "access_log"), NOW)).select("path", "score", "rank")


@query(f"""
WITH c AS ({_CHUNKS}), o AS (SELECT id, row_number() OVER (ORDER BY relative_path, start_line, id) AS n, count(*) OVER () AS total FROM c)
SELECT id, total, total > 60 AS has_more FROM o WHERE n > 40 AND n <= 60""")
def paginate(spark, folder):
    return search.page(chunks(spark, folder, "relative_path", "start_line"), ["relative_path", "start_line", "id"], 20, 40).select("id", "total", "has_more")


# BM25


def _bm25_sql(fields: list[str], queries: str) -> str:
    parts = " UNION ALL ".join(f"SELECT id, '{f}' AS field, list_filter(regexp_split_to_array(lower({f}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND strlen(w) < 40) AS t FROM c" for f in fields)
    return f"""
c AS ({_CHUNKS}), d AS ({parts}), tf AS (SELECT id, field, len(t) AS dl, unnest(t) AS w FROM d), p AS (SELECT id, field, dl, w, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT field, w, count(*) AS df FROM p GROUP BY ALL), tot AS (SELECT field, count(*) AS n, avg(len(t)) AS av FROM d GROUP BY field),
q AS (SELECT query_id, w, count(*) AS qf FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w FROM ({queries})) GROUP BY ALL),
s AS (SELECT query_id, id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score
      FROM q JOIN p USING (w) JOIN df USING (field, w) JOIN tot USING (field) GROUP BY ALL),
r AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s)"""


def _ranked(scores: DataFrame, limit: int) -> DataFrame:
    rounded = scores.select("query_id", F.col("key").alias("id"), F.round("score", 6).alias("score"))
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)


_ONE = "SELECT 1 AS query_id, 'stale queue shuffle' AS query"


@query(f"WITH {_bm25_sql(['content'], _ONE)} SELECT id, score FROM r WHERE rank <= 100")
def bm25_single_field(spark, folder):
    return bm25.search(table(spark, folder, "chunks"), "stale queue shuffle", fields=("content",), limit=100).select(F.col("key").alias("id"), "score")


@query(f"WITH {_bm25_sql(['content', 'symbol_name'], _ONE)} SELECT id, score FROM r WHERE rank <= 100")
def bm25_two_field(spark, folder):
    return bm25.search(table(spark, folder, "chunks"), "stale queue shuffle", limit=100).select(F.col("key").alias("id"), "score")


@query(f"WITH {_bm25_sql(['content', 'symbol_name'], 'SELECT DISTINCT query_id, query FROM search_queries')} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def bm25_batch(spark, folder):
    asked = table(spark, folder, "search_queries").select("query_id", "query").distinct()
    return _ranked(bm25.best_of_queries(table(spark, folder, "chunks"), asked, "id", ["content", "symbol_name"], 10), 10)


def _clauses_sql(phrase: str, rule: str) -> str:
    """BM25 of the words of a phrase of two words in the fields that hold it, of the word queue in those that hold that; rule tells which chunks are found."""
    return f"""
WITH {_bm25_sql(["content", "symbol_name"], "SELECT 1 AS query_id, 'queue stale shard' AS query")},
o AS (SELECT id, field, ' ' || array_to_string(t, ' ') || ' ' AS s FROM d),
x AS (SELECT id, field, w, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) AS y FROM p JOIN df USING (field, w) JOIN tot USING (field) WHERE w IN ('queue', 'stale')),
z AS (SELECT id, sum(y * (CAST(w = 'queue' AS INT) + CAST(contains(s, ' {phrase} ') AS INT))) AS score FROM x JOIN o USING (id, field) GROUP BY id),
h AS (SELECT id, bool_or(contains(s, ' queue ')) AS queue, bool_or(contains(s, ' shard ')) AS shard, bool_or(contains(s, ' {phrase} ')) AS phrase FROM o GROUP BY id)
SELECT id, round(score, 6) AS score FROM z JOIN h USING (id) WHERE {rule} ORDER BY 2 DESC, 1 LIMIT 50"""


@query(_clauses_sql("stale queue", "queue AND NOT shard"))
def bm25_query_language(spark, folder):
    """A required and an excluded word and an optional phrase."""
    return bm25.search(table(spark, folder, "chunks"), '+queue -shard "stale queue"', limit=50).select(F.col("key").alias("id"), "score")


@query(_clauses_sql("-", "queue AND NOT id IN (SELECT id FROM o WHERE contains(s, ' stale queue '))"))
def bm25_excluded_phrase(spark, folder):
    return bm25.search(table(spark, folder, "chunks"), 'queue -"stale queue"', limit=50).select(F.col("key").alias("id"), "score")


@query(_clauses_sql("stale queue", "queue OR phrase"))
def bm25_word_of_parts(spark, folder):
    """A word of two parts is an optional phrase."""
    return bm25.search(table(spark, folder, "chunks"), "stale_queue queue", limit=50).select(F.col("key").alias("id"), "score")


# Vectors


def _own(spark, folder, name, key):
    return vectors.usable(table(spark, folder, name), key, WIDTH)


@query(f"WITH v AS ({_vectors('wiki_vectors', 'slug')}) SELECT slug, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM v")
def vector_norms(spark, folder):
    v = _own(spark, folder, "wiki_vectors", "slug")
    return v.select("slug", F.round(F.sqrt(vectors.dot(F.col("vector"), F.col("vector"))), 4).alias("norm"))


@query(f"WITH v AS ({_vectors('chunk_vectors', 'chunk_id')}) SELECT count(*) AS vectors, CAST(max(len(v)) AS INT) AS width FROM v")
def vector_stats(spark, folder):
    return _own(spark, folder, "chunk_vectors", "chunk_id").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("vector")).alias("width"))


def _first_vector(spark, folder) -> list[float]:
    return list(_own(spark, folder, "wiki_vectors", "slug").orderBy("slug").first().vector)


_TOP = f"w AS ({_vectors('wiki_vectors', 'slug')}), b AS (SELECT v FROM w ORDER BY slug LIMIT 1), a AS ({_vectors('chunk_vectors', 'chunk_id')})"


@query(f"WITH {_TOP} SELECT chunk_id, {_COS} AS score FROM a, b ORDER BY score DESC, chunk_id LIMIT 25")
def knn_cosine(spark, folder):
    return vectors.top_k(_own(spark, folder, "chunk_vectors", "chunk_id"), "chunk_id", _first_vector(spark, folder), 25)


@query(f"""
WITH a AS ({_vectors('chunk_vectors', 'chunk_id')}), b AS ({_vectors('wiki_vectors', 'slug')}),
s AS (SELECT slug AS query_slug, chunk_id, {_COS} AS score FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_slug ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_slug, chunk_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def knn_batch(spark, folder):
    """The ten chunks nearest to every wiki entry."""
    return vectors.batch_top_k(_own(spark, folder, "chunk_vectors", "chunk_id"), _own(spark, folder, "wiki_vectors", "slug"), "chunk_id", "slug", 10)


@query(f"WITH a AS ({_vectors('wiki_vectors', 'slug')}), b AS ({_vectors('wiki_vectors', 'slug')}) SELECT a.slug AS slug_a, b.slug AS slug_b, {_COS} AS score FROM a JOIN b ON a.slug < b.slug WHERE {_COS} > 0.85")
def similar_pairs(spark, folder):
    return vectors.similar_pairs(_own(spark, folder, "wiki_vectors", "slug"), "slug")


@query(f"""
WITH {_TOP}, t AS (SELECT chunk_id, {_COS} AS score FROM a, b ORDER BY score DESC, chunk_id LIMIT 20)
SELECT chunk_id, score, relative_path, symbol_name, start_line FROM t LEFT JOIN (SELECT DISTINCT id, relative_path, symbol_name, start_line FROM chunks) c ON c.id = t.chunk_id""")
def semantic_search_join(spark, folder):
    c = chunks(spark, folder, "relative_path", "symbol_name", "start_line")
    return fusion.semantic_search(c, _own(spark, folder, "chunk_vectors", "chunk_id"), _first_vector(spark, folder))


@query(f"""
WITH w AS ({_WIKI}), t AS (SELECT slug, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND strlen(w) < 40)) AS f FROM w WHERE slug NOT IN ('index', 'log')),
x AS (SELECT slug, f, sqrt(count(*)) AS x FROM t GROUP BY ALL), h AS (SELECT slug, x, md5(s || ' ' || f) AS h FROM x, (VALUES ('a'), ('b')) v(s)),
b AS (SELECT slug, CAST(('0x' || substr(h, 1, 8))::BIGINT % 256 AS INT) AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN x ELSE -x END) AS s FROM h GROUP BY ALL)
SELECT slug, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY slug)), 6) + 0.0 AS weight FROM b""")
def hash_embed_sparse(spark, folder):
    e = vectors.embed_sparse(wiki.entries(table(spark, folder, "wiki")).select("slug", "content"), "slug", "content")
    return e.select("slug", "bucket", (F.round("weight", 6) + F.lit(0.0)).alias("weight"))


# Call graph

_WORDS = ", ".join(f"'{w}'" for w in chunking.NO_CALLS[""])
_MORE = " OR ".join(
    f"(language IN ({', '.join(repr(x) for x in (['javascript', 'typescript'] if k == 'javascript' else [k]))}) AND n IN ({', '.join(repr(w) for w in v)}))" for k, v in chunking.NO_CALLS.items() if k
)
_EDGES = f"""
e0 AS (SELECT symbol_name AS caller_name, relative_path AS caller_file, start_line AS caller_line, coalesce(language, '') AS language, unnest(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) AS n FROM ({_CHUNKS})),
edges AS (SELECT caller_name, caller_file, caller_line, n AS callee_name, lower(n) AS callee_lc FROM e0 WHERE strlen(n) >= 2 AND n NOT IN ({_WORDS}) AND NOT ({_MORE}) AND n <> caller_name),
pairs AS (SELECT DISTINCT lower(caller_name) AS src, callee_lc AS dst FROM edges)"""


def _edges(spark, folder):
    return chunking.call_edges(table(spark, folder, "chunks"))


@query(f"WITH {_EDGES} SELECT caller_name, caller_file, caller_line, callee_name, count(*) AS calls FROM edges GROUP BY ALL")
def call_edges(spark, folder):
    return _edges(spark, folder).groupBy("caller_name", "caller_file", "caller_line", "callee_name").agg(F.count(F.lit(1)).alias("calls"))


def _reach_sql(start: str, depth: int, src: str, dst: str) -> str:
    return f"""
WITH RECURSIVE {_EDGES}, r AS (SELECT '{start}' AS name, 0 AS depth UNION SELECT {dst}, depth + 1 FROM r JOIN pairs ON {src} = name WHERE depth < {depth})
SELECT name, CAST(min(depth) AS INT) AS depth FROM r WHERE name <> '{start}' GROUP BY name"""


@query(_reach_sql("push", 1, "dst", "src"))
def callers_d1(spark, folder):
    return graph.reach(_edges(spark, folder), "push", 1, "in")


@query(_reach_sql("init", 1, "src", "dst"))
def callees_d1(spark, folder):
    return graph.reach(_edges(spark, folder), "init", 1, "out")


@query(_reach_sql("init", 3, "src", "dst"))
def callees_d3(spark, folder):
    return graph.reach(_edges(spark, folder), "Init", 3, "out")


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM (SELECT src FROM pairs UNION SELECT dst FROM pairs)) AS nodes")
def graph_stats(spark, folder):
    return graph.graph_stats(_edges(spark, folder))


@query(f"WITH {_EDGES} SELECT DISTINCT symbol_name, relative_path, start_line FROM ({_CHUNKS}) WHERE lower(symbol_name) IN (SELECT dst FROM pairs WHERE src = 'init' AND dst <> 'init')")
def callee_definitions(spark, folder):
    found = graph.reach(_edges(spark, folder), "init", 1, "out")
    return graph.defined(found, table(spark, folder, "chunks")).select("symbol_name", "relative_path", "start_line")


# Fusion and context


@query("""
WITH m AS (SELECT query_id, chunk_id, greatest(0, coalesce(max(fff_score), 0)) AS f, greatest(0, coalesce(max(vector_score), 0)) AS v, greatest(0, coalesce(max(graph_score), 0)) AS g, greatest(0, coalesce(max(bm25_score), 0)) AS b FROM hits GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(f + v + g + b, 6) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def signal_merge(spark, folder):
    """The greatest score of each signal, summed, for every query of the hits table."""
    slots = ["fff_score", "vector_score", "graph_score", "bm25_score"]
    merged = table(spark, folder, "hits").groupBy("query_id", "chunk_id").agg(*[F.greatest(F.lit(0.0), F.coalesce(F.max(s), F.lit(0.0))).alias(s) for s in slots])
    scored = merged.select("query_id", F.col("chunk_id").alias("key"), sum((F.col(s) for s in slots[1:]), F.col(slots[0])).alias("score"))
    return _ranked(scored, 20).withColumnRenamed("id", "chunk_id")


@query("""
WITH r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT query_id, chunk_id, max(fff_score) AS s FROM hits GROUP BY ALL) WHERE s IS NOT NULL)
SELECT query_id, chunk_id, round(1 - i / n, 6) AS decay FROM r""")
def rank_decay_signal(spark, folder):
    best = table(spark, folder, "hits").groupBy("query_id", "chunk_id").agg(F.max("fff_score").alias("s")).where("s IS NOT NULL")
    by = Window.partitionBy("query_id")
    rank = F.row_number().over(by.orderBy(F.desc("s"), "chunk_id")) - 1
    return best.select("query_id", "chunk_id", F.round(1 - rank / F.count(F.lit(1)).over(by), 6).alias("decay"))


def _hybrid_parts(limit: int) -> str:
    return f"""
{_bm25_sql(['content', 'symbol_name'], "SELECT 1 AS query_id, 'shard' AS query")}, {_EDGES}, {_TOP},
paths AS (SELECT DISTINCT relative_path AS path FROM c), {_FUZZY},
ff AS (SELECT path, row_number() OVER (ORDER BY s DESC, path) - 1 AS k FROM fz WHERE s IS NOT NULL QUALIFY k < {limit * 3}),
fn AS (SELECT path, k, count(*) OVER () AS n FROM ff),
bm AS (SELECT id, score FROM r WHERE rank <= {limit * 5}),
vv AS (SELECT chunk_id, {_COS} AS score FROM a, b ORDER BY score DESC, chunk_id LIMIT {limit * 5}),
nb AS (SELECT src AS name FROM pairs WHERE dst = 'shard' UNION SELECT dst FROM pairs WHERE src = 'shard'),
sig AS (SELECT id AS chunk_id, 'f' AS slot, 'fff' AS source, (1 - k / n) * 0.3 AS score FROM c JOIN fn ON path = relative_path
  UNION ALL SELECT id, 'f', 'text', 0.15 FROM c WHERE contains(lower(symbol_name || ' ' || relative_path || ' ' || content), 'shard')
  UNION ALL SELECT id, 'b', 'bm25', score / (SELECT greatest(max(score), 1.1920929e-7) FROM bm) * 0.35 FROM bm
  UNION ALL SELECT chunk_id, 'v', 'vector', score * 0.5 FROM vv
  UNION ALL SELECT id, 'g', 'graph', 0.16 FROM c WHERE lower(symbol_name) IN (SELECT name FROM nb)
  UNION ALL SELECT id, 'g', 'graph', 0.2 FROM c WHERE lower(symbol_name) = 'shard' AND EXISTS (SELECT 1 FROM pairs WHERE src = 'shard' OR dst = 'shard')),
agg AS (SELECT chunk_id, greatest(0, coalesce(max(score) FILTER (slot = 'f'), 0)) AS f, greatest(0, coalesce(max(score) FILTER (slot = 'v'), 0)) AS v, greatest(0, coalesce(max(score) FILTER (slot = 'g'), 0)) AS g,
  greatest(0, coalesce(max(score) FILTER (slot = 'b'), 0)) AS bb, list(DISTINCT source) AS so FROM sig GROUP BY chunk_id),
top AS (SELECT chunk_id, round(f + v + g + bb, 6) AS score, round(f, 6) AS fff_score, round(v, 6) AS vector_score, round(g, 6) AS graph_score, round(bb, 6) AS bm25_score,
  list_filter(['fff', 'text', 'bm25', 'vector', 'graph'], lambda x: list_contains(so, x)) AS sources, CAST(row_number() OVER (ORDER BY round(f + v + g + bb, 6) DESC, chunk_id) AS INT) AS rank FROM agg QUALIFY rank <= {limit})"""


def _hybrid(spark, folder, **options):
    return fusion.hybrid_search(table(spark, folder, "chunks"), "shard", 20, vector_rows=_own(spark, folder, "chunk_vectors", "chunk_id"), query_vector=_first_vector(spark, folder), edges=_edges(spark, folder), **options)


@query(f"WITH {_hybrid_parts(20)} SELECT rank, chunk_id, score, fff_score, vector_score, graph_score, bm25_score, sources FROM top")
def hybrid_search(spark, folder):
    """All five signals for one query."""
    return _hybrid(spark, folder).select("rank", "chunk_id", "score", "fff_score", "vector_score", "graph_score", "bm25_score", "sources")


@query(f"WITH {_hybrid_parts(20)} SELECT rank, chunk_id, score FROM top JOIN (SELECT DISTINCT id, relative_path FROM chunks) k ON k.id = chunk_id WHERE contains(relative_path, 'shard')")
def hybrid_path_filter(spark, folder):
    return _hybrid(spark, folder, path="shard").select("rank", "chunk_id", "score")


@query("""
WITH k AS (SELECT query_id, chunk_id, min(rank) AS rank FROM hits WHERE rank IS NOT NULL GROUP BY ALL), t AS (SELECT DISTINCT id, strlen(content) // 4 + 1 AS tokens FROM chunks),
r AS (SELECT query_id, k.rank, chunk_id, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY k.rank, chunk_id ROWS UNBOUNDED PRECEDING) AS running_tokens FROM k JOIN t ON t.id = chunk_id)
SELECT query_id, chunk_id, CAST(running_tokens AS BIGINT) AS running_tokens FROM r WHERE running_tokens <= 2000""")
def context_budget(spark, folder):
    """For every query the first hits that fit 2000 tokens."""
    ranked = table(spark, folder, "hits").where("rank IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    sized = table(spark, folder, "chunks").select(F.col("id").alias("chunk_id"), T.token_estimate(F.col("content")).alias("tokens")).distinct()
    return within_budget(ranked.join(sized, "chunk_id"), ["query_id"], ["rank", "chunk_id"], "tokens", 2000).select("query_id", "chunk_id", "running_tokens")


@query("""
SELECT query_id, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean, list_sort(list(score))[CAST(round((count(*) - 1) * 0.5) AS INT) + 1] AS p50,
  list_sort(list(score))[CAST(round((count(*) - 1) * 0.95) AS INT) + 1] AS p95 FROM hits GROUP BY query_id""")
def nearest_rank_percentiles(spark, folder):
    n = F.count("score")
    sorted_ = F.array_sort(F.collect_list("score"))
    at = lambda p: F.get(sorted_, F.round((n - 1) * p).cast("int"))
    return table(spark, folder, "hits").groupBy("query_id").agg(F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"), F.round(F.avg("score"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(f"""
WITH c AS ({_CHUNKS}), {_EDGES} SELECT (SELECT count(DISTINCT relative_path) FROM c) AS files, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM edges) AS edges,
  (SELECT count(*) FROM ({_vectors('chunk_vectors', 'chunk_id')})) AS vectors, (SELECT count(DISTINCT slug) FROM wiki WHERE slug NOT IN ('index', 'log')) AS wiki_entries""")
def index_status(spark, folder):
    c = chunks(spark, folder, "relative_path").agg(F.count_distinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    parts = [
        _edges(spark, folder).agg(F.count(F.lit(1)).alias("edges")),
        _own(spark, folder, "chunk_vectors", "chunk_id").agg(F.count(F.lit(1)).alias("vectors")),
        wiki.entries(table(spark, folder, "wiki")).agg(F.count_distinct("slug").alias("wiki_entries")),
    ]
    return graph.one_row(c, *parts)


# Wiki

_LINKS = f"""
w AS ({_WIKI}), l0 AS (SELECT slug AS src, list_filter(list_transform(regexp_extract_all(content, '(?s)\\[\\[(.*?)\\]\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS l FROM w WHERE slug NOT IN ('index', 'log')),
links AS (SELECT DISTINCT src, unnest(l) AS dst FROM l0), live AS (SELECT DISTINCT slug, coalesce(entry_type, 'concept') AS kind, updated FROM w WHERE slug NOT IN ('index', 'log'))"""


def _wiki(spark, folder):
    return table(spark, folder, "wiki")


@query(f"WITH {_LINKS} SELECT src, dst FROM links")
def wiki_links(spark, folder):
    return wiki.links(_wiki(spark, folder)).select("src", "dst")


@query(f"WITH {_LINKS} SELECT dst AS slug, count(*) AS inbound FROM links WHERE dst IN (SELECT slug FROM live) GROUP BY dst")
def wiki_inbound(spark, folder):
    return wiki.inbound(_wiki(spark, folder))


@query(f"WITH {_LINKS} SELECT src, dst FROM links WHERE dst NOT IN (SELECT slug FROM live)")
def wiki_dead_links(spark, folder):
    return wiki.dead_links(_wiki(spark, folder))


@query(f"WITH {_LINKS} SELECT slug FROM live WHERE kind <> 'source' AND slug NOT IN (SELECT dst FROM links)")
def wiki_orphans(spark, folder):
    return wiki.orphans(_wiki(spark, folder))


@query(f"""
WITH {_LINKS} SELECT slug, updated FROM live WHERE kind <> 'source'
  AND CASE WHEN length(updated) = 10 THEN epoch(CAST(updated AS TIMESTAMP)) ELSE epoch(TRY_CAST(updated AS TIMESTAMPTZ)) END < epoch(TIMESTAMP '{NOW}' - INTERVAL 60 DAY)""")
def wiki_stale(spark, folder):
    return wiki.stale(_wiki(spark, folder), NOW, 60)


@query("SELECT split_part(slug, '/', 1) AS area, count(DISTINCT slug) AS entries FROM wiki WHERE slug NOT IN ('index', 'log') GROUP BY 1 HAVING count(DISTINCT slug) < 30")
def wiki_thin_areas(spark, folder):
    return wiki.thin_areas(_wiki(spark, folder), 30)


@query(f"""
WITH a AS ({_vectors('wiki_vectors', 'slug')}), b AS ({_vectors('wiki_vectors', 'slug')}),
p AS (SELECT a.slug AS slug_a, b.slug AS slug_b, {_COS} AS score FROM a JOIN b ON a.slug < b.slug WHERE {_COS} > 0.85 ORDER BY score DESC, slug_a, slug_b LIMIT 20),
n AS (SELECT slug, bool_or(len(list_intersect(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), ['not', 'no', 'never', 'deprecated', 'instead', 'avoid'])) > 0) AS n FROM wiki WHERE slug NOT IN ('index', 'log') GROUP BY slug)
SELECT slug_a, slug_b, score FROM p JOIN n x ON x.slug = slug_a JOIN n y ON y.slug = slug_b WHERE x.n AND y.n""")
def wiki_contradictions(spark, folder):
    return wiki.contradictions(_wiki(spark, folder), similar_pairs(spark, folder))


@query(f"SELECT slug, title, entry_type, updated FROM ({_WIKI}) WHERE slug NOT IN ('index', 'log') AND list_has_any(tags, ['title', 'patch'])")
def wiki_list_by_tag(spark, folder):
    return wiki.list_entries(_wiki(spark, folder), ["title", "patch"])


_WSEARCH = f"v AS ({_vectors('wiki_vectors', 'slug')}), b AS (SELECT v FROM v ORDER BY slug LIMIT 1), s AS (SELECT slug, {_COS} AS score FROM v a, b)"


def _wiki_ranked(spark, folder):
    v = _own(spark, folder, "wiki_vectors", "slug")
    query_vector = F.array(*[F.lit(float(x)) for x in _first_vector(spark, folder)])
    return v.select("slug", F.round(vectors.cosine(F.col("vector"), query_vector), 6).alias("score"))


@query(f"""
WITH {_WSEARCH}, t AS (SELECT slug, score, entry_type FROM s JOIN ({_WIKI}) w USING (slug) WHERE slug NOT IN ('index', 'log') AND list_has_any(tags, ['title', 'patch', 'salt', 'header']) ORDER BY score DESC, slug LIMIT 10)
SELECT slug, score FROM t WHERE entry_type = 'source'""")
def wiki_search(spark, folder):
    return wiki.search(_wiki(spark, folder), _wiki_ranked(spark, folder), ["title", "patch", "salt", "header"], "source").select("slug", "score")


@query(f"""
WITH {_WSEARCH}, t AS (SELECT slug, score, content, row_number() OVER (ORDER BY score DESC, slug) AS rank FROM s JOIN ({_WIKI}) w USING (slug) WHERE slug NOT IN ('index', 'log') QUALIFY rank <= 10)
SELECT CAST(rank AS INT) AS rank, slug, score, CASE WHEN rank <= 3 THEN content ELSE left(content, 200) END AS text,
  CASE WHEN rank <= 3 THEN array_to_string(list_filter(list_transform(regexp_extract_all(content, '(?s)\\[\\[(.*?)\\]\\]', 1), lambda x: trim(x)), lambda x: x <> ''), ' ') ELSE '' END AS links FROM t""")
def wiki_query_bundle(spark, folder):
    return wiki.query_bundle(_wiki(spark, folder), _wiki_ranked(spark, folder)).select("rank", "slug", "score", "text", F.array_join("links", " ").alias("links"))


@query(f"""
WITH w AS ({_WIKI}), o AS (SELECT split_part(slug, '/', 1) AS area, row_number() OVER (PARTITION BY split_part(slug, '/', 1) ORDER BY updated DESC, slug) AS ord, slug, title, content FROM w WHERE slug NOT IN ('index', 'log'))
SELECT area, CAST(ord AS INT) AS ord, slug, '- [[' || slug || ']] — ' || title || ' (' || left(regexp_extract(content, '(?m)^[ \\t]*(\\S.*?)\\s*$', 1), 100) || ')' AS line, ord = 1 AS header FROM o""")
def wiki_index_render(spark, folder):
    return wiki.index_lines(_wiki(spark, folder))


@query("SELECT DISTINCT title, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM wiki")
def slugify(spark, folder):
    return _wiki(spark, folder).select("title", T.slugify(F.col("title")).alias("slug")).distinct()


@query("""
WITH q AS (SELECT DISTINCT query AS title, 'sources/' || coalesce(nullif(trim(regexp_replace(lower(query), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS base FROM search_queries),
u AS (SELECT title, base, i, base || CASE WHEN i = 1 THEN '' ELSE '-' || i END AS s FROM q, range(1, 50) r(i))
SELECT title, arg_min(s, i) AS source_slug, 'concepts/' || replace(any_value(base), 'sources/', '') AS suggested FROM u WHERE s NOT IN (SELECT slug FROM wiki) GROUP BY title""")
def ingest_plan(spark, folder):
    titles = table(spark, folder, "search_queries").select(F.col("query").alias("title"))
    return wiki.ingest_plan(_wiki(spark, folder).select("slug"), titles)


@query(f"""
WITH w AS ({_WIKI}), o AS (SELECT split_part(slug, '/', 1) AS area, row_number() OVER (PARTITION BY split_part(slug, '/', 1) ORDER BY updated DESC, slug) AS ord, slug, title, content FROM w WHERE slug NOT IN ('index', 'log')),
l AS (SELECT area, ord, CASE WHEN ord = 1 THEN chr(10) || '## ' || area || chr(10) ELSE '' END || '- [[' || slug || ']] — ' || title || ' (' || left(regexp_extract(content, '(?m)^[ \\t]*(\\S.*?)\\s*$', 1), 100) || ')' || chr(10) AS line FROM o)
SELECT left('# Index' || chr(10) || string_agg(line, '' ORDER BY area, ord), 4000) AS text FROM l""")
def wiki_index_text(spark, folder):
    return wiki.index_text(_wiki(spark, folder))


@query(f"""
WITH {_WSEARCH}, w AS ({_WIKI}), t AS (SELECT slug, score, content, row_number() OVER (ORDER BY score DESC, slug) AS rank FROM s JOIN w USING (slug) WHERE slug NOT IN ('index', 'log') QUALIFY rank <= 10),
n0 AS (SELECT rank, list_filter(list_transform(regexp_extract_all(content, '(?s)\\[\\[(.*?)\\]\\]', 1), lambda x: trim(x)), lambda x: x <> '') AS l FROM t), n1 AS (SELECT rank, unnest(l) AS slug, unnest(range(len(l))) AS i FROM n0),
n AS (SELECT slug, min(rank * 1000000 + i) AS o FROM n1 GROUP BY slug)
SELECT 'source' AS part, 1 AS ord, 'sources/cache-notes' AS slug UNION ALL SELECT 'related', CAST(rank AS INT), slug FROM t UNION ALL SELECT 'neighbour', CAST(row_number() OVER (ORDER BY o) AS INT), slug FROM n
UNION ALL SELECT 'suggested', 1, 'analyses/cache-notes' UNION ALL SELECT 'suggested', CAST(rank + 1 AS INT), slug FROM t""")
def wiki_ingest(spark, folder):
    """A text is written as a source; its related entries, their links and the suggested slugs as rows."""
    done = wiki.ingest(_wiki(spark, folder), "Notes on a cache.", lambda _: _wiki_ranked(spark, folder), "2025-09-01T00:00:00Z", "Cache notes", "analysis")
    parts = {"source": [done.source_slug], "related": [s for s, _ in done.related], "neighbour": done.neighbours, "suggested": done.suggested}
    return spark.createDataFrame([(part, i + 1, slug) for part, slugs in parts.items() for i, slug in enumerate(slugs)], "part string, ord int, slug string")


@query(f"WITH w AS ({_WIKI}), v AS (SELECT DISTINCT slug FROM wiki_vectors) SELECT slug, slug IN (SELECT slug FROM v) AS kept FROM w WHERE slug NOT IN ('index', 'log') GROUP BY slug")
def wiki_reconcile(spark, folder):
    """Vectors whose entry is there, and entries without a vector."""
    kept, missing = wiki.reconcile(_wiki(spark, folder), table(spark, folder, "wiki_vectors"))
    both = kept.select("slug", F.lit(True).alias("kept")).union(missing.select("slug", F.lit(False)))
    return both.distinct()


@query(f"SELECT slug, title, coalesce(entry_type, 'concept') AS entry_type, coalesce(tags, []) AS tags, coalesce(sources, []) AS sources, created, updated, content FROM ({_WIKI})")
def front_matter_round_trip(spark, folder):
    """Entries written as Markdown and read again."""
    return markdown.parse_front_matter(markdown.render_front_matter(_wiki(spark, folder).distinct())).select("slug", "title", "entry_type", "tags", "sources", "created", "updated", "content")


@query(f"""
WITH f AS ({_FILES}), l AS (SELECT path, {_LINES} AS l FROM f WHERE path LIKE '%.json'), s AS (SELECT path, l, unnest(range(0, len(l), 80)) AS a FROM l WHERE len(l) > 0)
SELECT path || ':block@L' || (a + 1) || ':' || (a + 1) || '-' || least(a + 80, len(l)) AS id, 'block' AS symbol_kind, CAST(least(80, len(l) - a) AS INT) AS line_count FROM s""")
def structure_chunks_of_data(spark, folder):
    """Chunks of files whose language has no items: all are blocks."""
    return _structure(spark, folder).where("relative_path LIKE '%.json'").select("id", "symbol_kind", "line_count")


def _structure(spark, folder):
    files = table(spark, folder, "files").withColumn("language", detect_language(F.col("path"), F.col("content")))
    made = chunking.structure_chunks(spread(versioned(files).select("path", "language", "content", "_at")), "_at")
    narrow = made.select("relative_path", "_at", "id", "symbol_name", "symbol_kind", "line_count", F.md5("content").alias("content_md5"))
    return latest(narrow, files, "relative_path")


@query()
def structure_chunks(spark, folder):
    """Items of all files in force; checked on small files in the tests."""
    return _structure(spark, folder).select("id", "symbol_kind", "line_count", "content_md5")
