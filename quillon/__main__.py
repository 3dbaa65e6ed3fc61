"""Command line: index a tree, search it, show its status, look into the wiki."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import config, render
from quillon.operators import fusion, graph, search, vectors, wiki
from quillon.session import local_session
from quillon.sources.filetree import git_root, read_files
from quillon.sources.markdown import WikiFolder
from quillon.sources.store import IndexStore


def _ranked(query: str, width: int):
    """The entries of a wiki nearest to a text, as (slug, score)."""

    def rank(w: DataFrame) -> DataFrame:
        text = F.concat_ws("\n", F.concat_ws(" ", F.col("title"), F.array_join("tags", " ")), F.col("content"))
        embedded = vectors.embed(wiki.entries(w).select("slug", text.alias("_text")), F.col("_text"), width)
        return vectors.top_k(embedded, "slug", [float(x) for x in vectors.embed_text(query, width)], 10_000)

    return rank


def _wiki(spark: SparkSession, a: argparse.Namespace, limit: int, width: int) -> int:
    folder = WikiFolder(spark, a.root)
    w, now = folder.entries(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    said = lambda: open(a.file, encoding="utf-8").read() if a.file else sys.stdin.read()  # noqa: E731, SIM115
    tags = [t.strip() for t in a.tags.split(",") if t.strip()]
    if a.command == "wiki-lint":
        parts = {"orphans": wiki.orphans(w), "dead links": wiki.dead_links(w), "stale": wiki.stale(w, now[:19].replace("T", " "), a.days), "thin areas": wiki.thin_areas(w)}
        for title, rows in parts.items():
            print(title)
            for r in rows.limit(limit).collect():
                print("  " + " ".join(str(x) for x in r))
    elif a.command == "wiki-list":
        print("\n".join(f"{r.slug} — {r.title}" for r in wiki.list_entries(w, tags).limit(limit).collect()))
    elif a.command == "wiki-read":
        found = wiki.read(w, a.slug).first()
        if found is None:
            raise SystemExit(f"no entry {a.slug}")
        print(found.content)
    elif a.command == "wiki-search":
        rows = wiki.search(w, _ranked(a.query, width)(w), tags, limit=limit).orderBy(F.desc("score"), "slug").collect()
        print("\n".join(f"{r.slug} — {r.title} ({r.score:.3f})" for r in rows))
    elif a.command == "wiki-query":
        print(wiki.index_text(w).first().text)
        for r in wiki.query_bundle(w, _ranked(a.query, width)(w), limit).orderBy("rank").collect():
            print(f"\n[[{r.slug}]] ({r.score:.3f})\n{r.text}" + ("\nlinks: " + " ".join(f"[[{x}]]" for x in r.links) if r.links else ""))
    elif a.command == "wiki-write":
        schema = "slug string, title string, entry_type string, tags array<string>, sources array<string>, content string"
        new = spark.createDataFrame([(a.slug, a.title, a.type, tags, [a.source] if a.source else [], said())], schema)
        folder.write(wiki.upsert(w, new, now), [a.slug], wiki.log_lines(new, "write", now))
    elif a.command == "wiki-delete":
        folder.write(wiki.delete(w, a.slug), [a.slug], wiki.log_lines(w.where(F.col("slug") == a.slug), "delete", now))
    elif a.command == "wiki-ingest":
        text = said()
        done = wiki.ingest(w, text, _ranked(text, width), now, a.title, a.area, a.source)
        folder.write(done.wiki, [done.source_slug], done.log)
        print(json.dumps({"source_slug": done.source_slug, "related": done.related, "neighbours": done.neighbours, "suggested": done.suggested}, indent=2))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("--config")
    p.add_argument("--data", default=".quillon")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"index": ["root"], "search": ["query"], "grep": ["root", "query"], "files": ["root", "query"], "symbol": ["symbol"], "calls": ["function"], "status": [], "wiki-lint": ["root"], "wiki-list": ["root"], "wiki-read": ["root", "slug"], "wiki-search": ["root", "query"], "wiki-query": ["root", "query"], "wiki-write": ["root", "slug", "title"], "wiki-delete": ["root", "slug"], "wiki-ingest": ["root", "title"], "version": []}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        s.add_argument("--limit", type=float)
        s.add_argument("--depth", type=float, default=1)
        s.add_argument("--days", type=int, default=180)
        s.add_argument("--file", help="text of wiki-write and wiki-ingest; standard input without it")
        s.add_argument("--type", default="concept")
        s.add_argument("--tags", default="")
        s.add_argument("--area", default="concepts")
        s.add_argument("--source")
    a = p.parse_args(argv)
    if a.command == "version":
        from quillon import __version__

        print(__version__)
        return 0
    from quillon.functions.text import resolve_page

    here = git_root(os.getcwd()) or os.getcwd()
    settings = config.load(os.path.expanduser("~/.config/quillon/config.toml"), os.path.join(here, "quillon.toml"), a.config)
    limit, _ = resolve_page(a.limit, None, settings["query"]["default_max_results"])
    spark = local_session()
    if a.command.startswith("wiki-"):
        return _wiki(spark, a, limit, settings["embedding"]["dimensions"])
    store = IndexStore(spark, os.path.abspath(a.data), min(settings["embedding"]["dimensions"], 1024))
    if a.command == "index":
        files = read_files(spark, a.root, settings["indexer"]["respect_gitignore"], settings["indexer"]["max_file_size"])
        print(f"{store.upsert(files)} chunks made anew")
    elif a.command == "search":
        chunks = store.read("chunks")
        vector = [float(x) for x in vectors.embed_text(a.query, store.width)]
        found = fusion.hybrid_search(chunks, a.query, limit, vector_rows=store.read("vectors"), query_vector=vector, edges=store.read("edges"), index=store.bm25_index())
        print(render.hits(found.orderBy("rank")))
    elif a.command == "grep":
        print(render.grouped_lines(search.grep(read_files(spark, a.root), a.query).limit(limit)))
    elif a.command == "files":
        print("\n".join(r.path for r in search.find_files(read_files(spark, a.root), a.query, limit).orderBy("rank").collect()))
    elif a.command == "symbol":
        print(render.chunk_page(search.page(search.by_symbol(store.read("chunks"), a.symbol), ["relative_path", "start_line"], limit)))
    elif a.command == "calls":
        edges = store.read("edges")
        for way, title in (("in", "callers"), ("out", "callees")):
            print(title)
            for r in graph.reach(edges, a.function, int(a.depth), way).orderBy("depth", "name").limit(limit).collect():
                print(f"  {r.depth} {r.name}")
    elif a.command == "status":
        chunks = store.read("chunks")
        print(render.status(chunks.agg(F.count_distinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.lower("symbol_name")).alias("symbols"))))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

