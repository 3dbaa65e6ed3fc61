import duckdb  # noqa: F401
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.operators import bm25, chunking, context, fusion, graph, search, vectors, wiki
from quillon.sources import filetree, markdown
from quillon.sources.language import detect_language
from quillon.sources.store import IndexStore
from quillon.streaming import ingest

CHUNK = "id string, relative_path string, language string, symbol_name string, symbol_kind string, start_line int, end_line int, content string"


def chunk_rows(*items):
    return [(f"{p}:{n}:1-{c.count(chr(10)) + 1}", p, "rust", n, "fn", 1, c.count("\n") + 1, c) for p, n, c in items]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        chunk_rows(
            ("auth/login.rs", "verify_password", "fn verify_password(p) { hash_password(p); compare(p) }"),
            ("auth/token.rs", "issue_token", "fn issue_token(u) { sign(u); verify_password(u); if (u) {} }"),
            ("auth/hash.rs", "hash_password", "fn hash_password(p) { sha(p) }"),
            ("sort/quick.rs", "quick_sort", "fn quick_sort(v) { partition(v); quick_sort(v); swap!(v) }"),
            ("sort/part.rs", "partition", "fn partition(v) { swap_items(v) }"),
            ("loop/a.rs", "ping", "fn ping() { Pong() }"),
            ("loop/b.rs", "pong", "fn pong() { ping() }"),
        ),
        CHUNK,
    )


@pytest.mark.parametrize(("lines", "spans"), [(80, [(1, 80)]), (81, [(1, 80), (81, 81)]), (160, [(1, 80), (81, 160)]), (0, [])])
def test_block_chunks(spark, lines, spans):
    files = spark.createDataFrame([("a.txt", None, "".join(f"l{i}\n" for i in range(lines)))], "path string, language string, content string")
    got = chunking.block_chunks(files).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == spans
    assert all(r.symbol_name == f"block@L{r.start_line}" and r.line_count == r.end_line - r.start_line + 1 for r in got)


def test_structure_chunks(spark):
    python = "import os\n\n@deco\ndef top(a):\n    return a\n\nclass Box:\n    def get(self):\n        return 1\n"
    rust = "use x;\n\npub struct Point {\n    x: i32,\n}\n\nimpl Point {\n    pub fn len(&self) -> f64 {\n        // }\n        let s = \"}\";\n        1.0\n    }\n}\n"
    files = spark.createDataFrame([("a.py", "python", python), ("b.rs", "rust", rust), ("c.py", "python", "def broken(:\n"), ("d.txt", None, "")], "path string, language string, content string")
    got = {(r.relative_path, r.symbol_name, r.symbol_kind, r.start_line, r.end_line) for r in chunking.structure_chunks(files).collect()}
    assert got == {("a.py", "top", "function", 3, 5), ("a.py", "Box", "class", 7, 9), ("a.py", "get", "method", 8, 9), ("b.rs", "Point", "struct", 3, 5), ("b.rs", "Point", "impl", 7, 13), ("b.rs", "len", "function", 8, 12), ("c.py", "block@L1", "block", 1, 1)}


def test_call_edges(spark):
    rows = chunk_rows(("a.rs", "bb", "fn bb() { cc(); dd(); if (x) {} bb(); f(1); p!(x) }"))
    got = [r.callee_name for r in chunking.call_edges(spark.createDataFrame(rows, CHUNK)).collect()]
    assert sorted(got) == ["cc", "dd"]


def test_reach_is_breadth_first_and_finds_cycles(corpus):
    edges = chunking.call_edges(corpus)
    near = {r.name: r.depth for r in graph.reach(edges, "issue_token", 3).collect()}
    assert near == {"sign": 1, "verify_password": 1, "hash_password": 2, "compare": 2, "sha": 3}
    assert {r.name for r in graph.reach(edges, "PING", 5).collect()} == {"pong"}
    assert {r.name for r in graph.reach(edges, "hash_password", 2, "in").collect()} == {"verify_password", "issue_token"}
    found = graph.defined(graph.reach(edges, "issue_token", 1), corpus).collect()
    assert [r.symbol_name for r in found] == ["verify_password"]


def test_bm25_exact_name_first_and_bad_queries(corpus):
    assert bm25.search(corpus, "quick sort").first().key.startswith("sort/quick.rs")
    for bad in ("", "   ", '"open', "!!!"):
        assert bm25.search(corpus, bad).count() == 0
    assert bm25.search(corpus, "sort", limit=0).count() == 0
    keys = lambda q: [r.key.split(":")[0] for r in bm25.search(corpus, q).collect()]
    assert keys('+password -token +"verify password"') == ["auth/login.rs"]
    assert keys('+password -token "verify password"') == ["auth/login.rs", "auth/hash.rs"]  # the phrase only adds to the score
    assert keys('password -"verify password"') == ["auth/hash.rs"] and keys("password -verify_password") == ["auth/hash.rs"]
    assert set(keys("no_such sort")) == {"sort/quick.rs"} and keys("no::such") == [] and keys("symbol_name:pong content:pong") != []
    assert keys("symbol_name:pong") == ["loop/b.rs"] and keys("-password") == []
    assert [r.key for r in bm25.search(corpus.union(corpus), "quick sort").collect()] == [r.key for r in bm25.search(corpus, "quick sort").collect()]


def test_search_predicates(spark, corpus):
    assert search.by_symbol(corpus, "PING").count() == 1
    assert search.substring_chunks(corpus, "").count() == corpus.count()
    assert search.substring_chunks(corpus, "AUTH/").count() == 3
    files = spark.createDataFrame([("a", "\n".join(["x Cache"] * 15)), ("b", "cache")], "path string, content string")
    assert search.grep(files, "cache").count() == 11
    assert search.grep(files, "Cache").count() == 10
    assert search.grep(files, "^x .*e$").count() == 10
    page = search.get_chunks(corpus, query="", limit=3, offset=3).collect()
    assert len(page) == 3 and page[0].total == 7 and page[0].has_more
    with pytest.raises(ValueError):
        search.get_chunks(corpus)


def test_fusion_worked_example(spark):
    w = fusion.WEIGHTS
    signals = spark.createDataFrame(
        [("c", "fff", "fff", 1.0 * w["fff"]), ("c", "fff", "text", 0.5 * w["fff"]), ("c", "bm25", "bm25", 0.5 * w["bm25"]), ("c", "vector", "vector", 0.6 * w["vector"]), ("c", "graph", "graph", w["graph"]), ("d", "vector", "vector", -0.2)],
        "chunk_id string, slot string, source string, score double",
    )
    c, d = fusion.merge_signals(signals, 5).orderBy("rank").collect()
    assert (c.chunk_id, c.score, c.fff_score, c.bm25_score, c.vector_score, c.graph_score) == ("c", 0.975, 0.3, 0.175, 0.3, 0.2)
    assert c.sources == ["fff", "text", "bm25", "vector", "graph"]
    assert (d.score, d.sources) == (0.0, ["vector"])


def test_hybrid_search_with_every_signal(corpus):
    v = vectors.embed(corpus, F.col("content"), 128).select(F.col("id").alias("chunk_id"), "vector")
    q = [float(x) for x in vectors.embed_text("verify_password", 128)]
    hits = fusion.hybrid_search(corpus, "verify_password", 5, vector_rows=v, query_vector=q, edges=chunking.call_edges(corpus)).orderBy("rank").collect()
    assert hits[0].symbol_name == "verify_password" and {"text", "bm25", "graph"} <= set(hits[0].sources)
    kept = fusion.hybrid_search(corpus, "verify_password", 5, path="token", prefilter=True).collect()
    assert {h.relative_path for h in kept} == {"auth/token.rs"}


def test_embedding_is_ordinal():
    near = lambda a, b: float(vectors.embed_text(a, 512) @ vectors.embed_text(b, 512))
    assert abs(np.linalg.norm(vectors.embed_text("some text", 512)) - 1) < 1e-9
    assert not vectors.embed_text("", 512).any()
    assert near("fn parse_user(id)", "fn parse_user_name(id)") > near("fn parse_user(id)", "matrix multiply kernel")
    assert near("größe übung", "grösse übung") > near("größe übung", "select from table")
    with pytest.raises(ValueError):
        vectors.embedder("unknown")


def test_vectors_edge_cases(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [float("nan"), 1.0]), ("f", [1.0]), ("b", [0.0, 2.0])]
    v = vectors.usable(spark.createDataFrame(rows, "k string, vector array<float>"), "k", 2)
    assert {r.k for r in v.collect()} == {"a", "b"}
    assert [(r.k, r.score) for r in vectors.top_k(v, "k", [1.0, 1.0], 1).collect()] == [("a", 0.707107)]
    assert vectors.top_k(v, "k", [1.0, 1.0], 0).count() == 0
    assert vectors.similar_pairs(v, "k", -0.5).count() == 1
    assert vectors.batch_top_k(v.limit(0), v, "k", "k", 3).count() == 0


def test_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    x = np.random.default_rng(3).standard_normal((40, 4))
    v = spark.createDataFrame([(f"k{i:02d}", [float(a) for a in row]) for i, row in enumerate(x)], "k string, vector array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(x @ x.T, 6)
    got = {(r.k_a, r.k_b, r.score) for r in vectors.similar_pairs(v, "k", 0.5).collect()}
    assert got == {(f"k{i:02d}", f"k{j:02d}", cos[i, j]) for i in range(40) for j in range(i + 1, 40) if cos[i, j] > 0.5}
    few = {tuple(r) for r in vectors.batch_top_k(v, v, "k", "k", 3).select("query_k", "rank", "score").collect()}
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 5)
    assert few == {tuple(r) for r in vectors.batch_top_k(v, v, "k", "k", 3).select("query_k", "rank", "score").collect()} and len(few) == 120


def test_relational_embedding_matches_dense_words(spark):
    text = "alpha beta alpha gamma"
    got = {r.bucket: r.weight for r in vectors.embed_sparse(spark.createDataFrame([("d", text)], "d string, t string"), "d", "t", 64).collect()}
    import hashlib

    want = np.zeros(64)
    for w, n in (("alpha", 2), ("beta", 1), ("gamma", 1)):
        for s in vectors.SALTS:
            h = hashlib.md5(f"{s} {w}".encode()).hexdigest()
            want[int(h[:8], 16) % 64] += n**0.5 * (1 if int(h[8], 16) % 2 == 0 else -1)
    want /= np.linalg.norm(want)
    assert all(abs(got.get(i, 0.0) - want[i]) < 1e-9 for i in range(64))


def test_context_budget(spark, corpus):
    rows = spark.createDataFrame([(i, 3000) for i in (1, 2, 3)], "rank int, tokens int")
    assert context.within_budget(rows, [], ["rank"], "tokens", 8000).count() == 2
    hits = fusion.hybrid_search(corpus, "password", 3)
    made = context.build_context("password", hits, corpus, chunking.call_edges(corpus), path="auth/hash.rs", budget=400)
    assert [s[0] for s in made.sections][0] == "Primary hits" and made.used <= 400
    assert not context.build_context("zzzz", hits.limit(0), corpus, chunking.call_edges(corpus)).sections


WIKI = "slug string, title string, entry_type string, tags array<string>, sources array<string>, created string, updated string, content string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [
            ("concepts/a", 'Say "A"', "concept", ["x"], [], "2025-01-01T00:00:00Z", "2025-06-01T00:00:00Z", "See [[concepts/b]] and [[concepts/gone]]."),
            ("concepts/b", "B", None, ["x", "y"], ["sources/s"], "2025-01-01T00:00:00Z", "2024-01-01", "Links are never checked."),
            ("concepts/b", "B", None, ["x", "y"], ["sources/s"], "2025-01-01T00:00:00Z", "2024-01-01", "Links are never checked."),
            ("sources/s", "S", "source", None, [], "2025-01-01T00:00:00Z", "nonsense", None),
            ("index", "Index", None, [], [], None, None, "[[concepts/a]]"),
        ],
        WIKI,
    )


def test_wiki_reports(pages):
    assert [(r.src, r.dst) for r in wiki.dead_links(pages).collect()] == [("concepts/a", "concepts/gone")]
    assert [r.slug for r in wiki.orphans(pages).collect()] == ["concepts/a"]
    assert [r.slug for r in wiki.stale(pages, "2025-06-02 00:00:00", 180).collect()] == ["concepts/b"]
    assert {(r.area, r.entries) for r in wiki.thin_areas(pages).collect()} == {("concepts", 2), ("sources", 1)}
    assert [r.slug for r in wiki.list_entries(pages, ["y"]).collect()] == ["concepts/b"]


def test_wiki_writes(spark, pages):
    new = pages.where("slug = 'concepts/a'").withColumn("content", F.lit("new"))
    after = wiki.upsert(pages, new, "2025-07-01T00:00:00Z")
    row = wiki.read(after, "concepts/a").first()
    assert (row.created, row.updated, row.content) == ("2025-01-01T00:00:00Z", "2025-07-01T00:00:00Z", "new")
    for bad in ("index", "../x", "sources/s"):
        with pytest.raises(ValueError):
            wiki.upsert(pages, new.withColumn("slug", F.lit(bad)), "2025-07-01T00:00:00Z")
    assert wiki.read(wiki.delete(pages, "concepts/b"), "concepts/b").isEmpty()
    with pytest.raises(KeyError):
        wiki.delete(pages, "concepts/none")
    plan = wiki.ingest_plan(pages, spark.createDataFrame([("Borrowing",), ("S",)], "title string")).collect()
    assert {(r.source_slug, r.suggested) for r in plan} == {("sources/borrowing", "concepts/borrowing"), ("sources/s-2", "concepts/s")}


def test_wiki_lint_follows_entry_types(spark):
    rows = [
        ("sources/x", "X", "concept", [], [], None, "2020-01-01T00:00:00+02:00", "Avoid [[sources/x]] and [[log]]."),
        ("concepts/y", "Y", "source", [], [], None, "2020-01-01T00:00:00Z", "It is deprecated: [[concepts/none]]."),
        ("concepts/z", "Z", None, [], [], None, "2024-06-01T00:00:00Z", "Nothing."),
    ]
    pages = spark.createDataFrame(rows, WIKI)
    assert [r.slug for r in wiki.orphans(pages).collect()] == ["concepts/z"]  # x links to itself, y is a source
    assert [r.slug for r in wiki.stale(pages, "2024-07-01 00:00:00", 180).collect()] == ["sources/x"]
    assert {tuple(r) for r in wiki.dead_links(pages).collect()} == {("sources/x", "log"), ("concepts/y", "concepts/none")}
    assert [tuple(r) for r in wiki.inbound(pages).collect()] == [("sources/x", 1)]
    pairs = spark.createDataFrame([("sources/x", "concepts/y", 0.9), ("sources/x", "concepts/z", 0.95)], "slug_a string, slug_b string, score double")
    assert [(r.slug_a, r.slug_b) for r in wiki.contradictions(pages, pairs).collect()] == [("sources/x", "concepts/y")]
    assert wiki.index_lines(pages).where("slug = 'concepts/z'").first().line == "- [[concepts/z]] — Z (Nothing.)"
    assert [wiki.normalise_area(x) for x in ("ADR", "analysis", "gotcha", "arch", "what")] == ["adrs", "analyses", "gotchas", "arch", "concepts"]


def test_wiki_ingest(spark, pages):
    rank = lambda w: wiki.entries(w).select("slug", F.length("slug").cast("double").alias("score")).distinct()
    done = wiki.ingest(pages, "text", rank, "2025-07-01T00:00:00Z", "S", "adr", "http://x")
    assert done.source_slug == "sources/s-2" and done.suggested == ["adrs/s", "concepts/a", "concepts/b", "sources/s"]
    assert done.related[0] == ("sources/s-2", 11.0) and done.neighbours == ["concepts/b", "concepts/gone"]
    row = wiki.read(done.wiki, "sources/s-2").first()
    assert (row.entry_type, row.sources, row.content, row.created) == ("source", ["http://x"], "text", "2025-07-01T00:00:00Z")
    assert done.log.first().line == "## [2025-07-01] ingest | S (sources/s-2)"
    kept, missing = wiki.reconcile(pages, spark.createDataFrame([("concepts/a", 1), ("gone", 2), ("index", 3)], "slug string, v int"))
    assert [r.slug for r in kept.collect()] == ["concepts/a"] and sorted(r.slug for r in missing.collect()) == ["concepts/b", "sources/s"]


def test_wiki_commands(spark, tmp_path, capsys, monkeypatch):
    import io

    from quillon.__main__ import main

    root = str(tmp_path / "wiki")
    run = lambda *args: (main([args[0], root, *args[1:]]), capsys.readouterr().out)[1]
    (tmp_path / "note.md").write_text("Caches expire. See [[concepts/queue]].")
    run("wiki-write", "concepts/cache", "Cache", "--file", str(tmp_path / "note.md"), "--tags", "a, b")
    monkeypatch.setattr("sys.stdin", io.StringIO("Queues hold jobs until a worker is free."))
    assert '"source_slug": "sources/queues"' in run("wiki-ingest", "Queues", "--area", "adr", "--source", "http://x")
    assert run("wiki-read", "concepts/cache") == "Caches expire. See [[concepts/queue]].\n"
    assert run("wiki-search", "queue of jobs").splitlines()[0].startswith("sources/queues")
    assert "concepts/cache concepts/queue" in run("wiki-lint") and "Cache" in run("wiki-list", "--tags", "b")
    assert "- [[concepts/cache]] — Cache (Caches expire." in (tmp_path / "wiki" / "index.md").read_text()
    assert [x.split("] ")[1] for x in (tmp_path / "wiki" / "log.md").read_text().splitlines() if x.startswith("## ")] == ["write | Cache (concepts/cache)", "ingest | Queues (sources/queues)"]
    run("wiki-delete", "concepts/cache")
    assert "cache" not in run("wiki-query", "jobs")


def test_front_matter(spark, pages):
    back = {r.slug: r for r in markdown.parse_front_matter(markdown.render_front_matter(pages.distinct())).collect()}
    assert back["concepts/a"].title == 'Say "A"' and back["concepts/b"].tags == ["x", "y"] and back["concepts/b"].entry_type == "concept"
    plain = markdown.parse_front_matter(spark.createDataFrame([("n", "no front matter")], "slug string, text string")).first()
    assert (plain.title, plain.entry_type, plain.content) == ("n", "concept", "no front matter")
    with pytest.raises(Exception, match="unclosed"):
        markdown.parse_front_matter(spark.createDataFrame([("n", "---\ntitle: x\n")], "slug string, text string")).collect()
    moved = markdown.migrate_legacy(spark.createDataFrame([("Old Note", "t", None, [], [], None, None, "c"), ("old-note", "t", None, [], [], None, None, "c")], WIKI))
    assert sorted(r.slug for r in moved.collect()) == ["concepts/legacy-old-note", "concepts/legacy-old-note-2"]


def test_language_detection(spark):
    rows = [("a.rs", ""), ("b.py", ""), ("c.tsx", ""), ("d.md", ""), ("run", "#!/usr/bin/env python3\nx"), ("run2", "#!/bin/sh\n"), ("none", "text"), (".hidden", "")]
    got = [r.l for r in spark.createDataFrame(rows, "p string, t string").select(detect_language(F.col("p"), F.col("t")).alias("l")).collect()]
    assert got == ["rust", "python", "tsx", "markdown", "python", "bash", None, None]


def test_file_tree(spark, tmp_path):
    for name, raw in {"a.py": b"x = 1\n", "sub/b.rs": b"fn x() {}", "skip/c.py": b"y", "bad.py": b"\xff\xfe", ".git/config.toml": b"", "run": b"#!/usr/bin/env python3\n", ".gitignore": b"skip/\n*.log\n", "n.log": b"l"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(raw)
    got = {r.path: r.language for r in filetree.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "sub/b.rs": "rust", "run": "python"}
    assert "skip/c.py" in {r.path for r in filetree.read_files(spark, str(tmp_path), respect_ignore=False).collect()}
    assert filetree.git_root(str(tmp_path / "sub")) == str(tmp_path)


def with_hash(df):
    return df.withColumn("content_hash", F.sha2("content", 256))


def test_store_upsert_is_incremental(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 64)
    rows = [("a.py", "python", "def a():\n    return b()\n"), ("b.py", "python", "def b():\n    return 1\n")]
    files = with_hash(spark.createDataFrame(rows, "path string, language string, content string"))
    assert store.upsert(files) == 2
    assert store.upsert(files) == 0
    changed = with_hash(spark.createDataFrame([("a.py", "python", "def a2():\n    return 3\n")], "path string, language string, content string"))
    assert store.upsert(changed) == 1
    assert [r.symbol_name for r in store.read("chunks").collect()] == ["a2"]
    assert store.read("vectors").count() == 1 and store.read("edges").count() == 0
    store.remove_file("a.py")
    assert store.read("chunks").count() == 0


def test_store_parts_and_index(spark, tmp_path, monkeypatch):
    from quillon.sources import store as module

    schema = "path string, language string, content string"
    made = lambda *rows: with_hash(spark.createDataFrame([(p, "python", c) for p, c in rows], schema))
    store = IndexStore(spark, str(tmp_path / "index"), 64)
    first = [(f"f{i}.py", f"def f{i}():\n    return token{i % 3}(shared)\n") for i in range(6)]
    store.upsert(made(*first))
    store.upsert(made(("f1.py", "def g():\n    return other()\n"), ("f2.py", "")), complete=False)
    assert len(store._pointer()["parts"]) == 2
    assert spark.read.parquet(store.folder.at(store._pointer()["parts"][1] + "/vectors")).count() == 1  # only what changed is embedded
    names = lambda: sorted(r.symbol_name for r in store.read("chunks").collect())
    assert names() == ["f0", "f3", "f4", "f5", "g"]
    for q in ("token0", "shared other", "absent"):
        scan, stored_ = (bm25.search(store.read("chunks"), q, index=i).collect() for i in (None, store.bm25_index()))
        assert scan == stored_
    monkeypatch.setattr(module, "COMPACT", 2)
    store.remove_file("f0.py")
    assert len(store._pointer()["parts"]) == 1 and names() == ["f3", "f4", "f5", "g"]
    assert store.read("postings").where("term = 'token0'").count() == 1 and store.read("edges").count() == 4
    wider = IndexStore(spark, str(tmp_path / "index"), 32)
    wider.upsert(made(("f3.py", first[3][1])))
    assert {len(r.vector) for r in wider.read("vectors").collect()} == {32} and wider.read("chunks").count() == 1


def test_chunks_of_more_languages():
    rows = lambda language, text: [r[2:6] for r in chunking._rows_of("p", language, text)]
    typescript = "export class A {\n  private x(a: number): void {\n    if (a) { go(); }\n  }\n  get y() { return 1; }\n}\nnamespace N.M {\n  function q() {}\n}\n"
    assert rows("typescript", typescript) == [("A", "class", 1, 6), ("x", "method", 2, 4), ("y", "method", 5, 5), ("N.M", "module", 7, 9), ("q", "function", 8, 8)]
    assert rows("c", "static int add(int a, int b) {\n  if (a) { return b; }\n  return a;\n}\nstruct P { int x; };\n") == [("add", "function", 1, 4), ("P", "struct", 5, 5)]
    assert rows("java", "class Foo {\n  int size() { return n; }\n  void run() {\n    while (x) { y(); }\n  }\n}\n") == [("Foo", "class", 1, 6), ("size", "method", 2, 2), ("run", "method", 3, 5)]
    assert rows("kotlin", "data class P(val x: Int) {\n  fun sum(): Int {\n    return x\n  }\n}\n") == [("P", "class", 1, 5), ("sum", "function", 2, 4)]
    assert rows("csharp", "namespace A.B {\n  public class C {\n    public int F(int x) { return x; }\n  }\n}\n") == [("A.B", "module", 1, 5), ("C", "class", 2, 4), ("F", "method", 3, 3)]
    assert rows("php", "class A {\n  public function f() { return 1; }\n}\n") == [("A", "class", 1, 3), ("f", "function", 2, 2)]
    assert rows("go", "no items here\n") == [("block@L1", "block", 1, 1)]


def test_stream_upsert(spark, tmp_path):
    src, store = str(tmp_path / "in"), IndexStore(spark, str(tmp_path / "index"), 64)
    batch = lambda rows: spark.createDataFrame(rows, "path string, language string, content string, indexed_at string").withColumn("indexed_at", F.to_timestamp("indexed_at")).write.mode("append").parquet(src)
    run = lambda: ingest.start(ingest.file_stream(spark, src), store, str(tmp_path / "ck"), once=True).awaitTermination()
    batch([("a.py", "python", "def one(): pass\n", "2025-01-01"), ("a.py", "python", "def two(): pass\n", "2025-01-02")])
    run()
    assert [r.symbol_name for r in store.read("chunks").collect()] == ["two"]
    batch([("b.py", "python", "def three(): pass\n", "2025-01-03")])
    run()
    run()
    assert sorted(r.symbol_name for r in store.read("chunks").collect()) == ["three", "two"]


def test_config_layers(tmp_path):
    (tmp_path / "g.toml").write_text("[query]\ndefault_max_results = 5\n[project]\nroot = 'x'\n")
    (tmp_path / "p.toml").write_text("[query]\nfff_weight = 0.9\n")
    got = config.load(str(tmp_path / "g.toml"), str(tmp_path / "missing.toml"), str(tmp_path / "p.toml"))
    assert (got["query"]["default_max_results"], got["query"]["fff_weight"], got["query"]["bm25_weight"], got["root"]) == (5, 0.9, 0.35, "x")


def test_frecency(spark):
    log = spark.createDataFrame([("a", "2025-01-15 00:00:00"), ("a", "2025-01-15 00:00:00"), ("b", "2025-01-01 00:00:00"), (None, "2025-01-15 00:00:00")], "path string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert {r.path: r.frecency for r in search.frecency(log, "2025-01-15 00:00:00").collect()} == {"a": 1.0, "b": 0.5}
