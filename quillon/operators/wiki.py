"""Linked knowledge base: entries in a table, links, search, reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import preview, slugify, wikilinks

RESERVED = ["index", "log"]
#: Words that mark a statement as contradicting another.
NEGATIONS = ["not", "no", "never", "deprecated", "instead", "avoid"]
#: Names of areas by what callers write; anything else is a concept.
AREAS = {
    "concept": "concepts", "concepts": "concepts", "entity": "entities", "entities": "entities", "analysis": "analyses", "analyses": "analyses",
    "adr": "adrs", "adrs": "adrs", "arch": "arch", "gotcha": "gotchas", "gotchas": "gotchas", "source": "sources", "sources": "sources",
}
#: Of search hits, how many are related entries, and how many slugs are suggested.
RELATED, SUGGESTED = 10, 15


def entries(wiki: DataFrame) -> DataFrame:
    """Distinct entries without the reserved ones."""
    return wiki.distinct().where(~F.col("slug").isin(RESERVED))


def area(slug: Column) -> Column:
    return F.split_part(slug, F.lit("/"), F.lit(1))


def normalise_area(name: str) -> str:
    return AREAS.get(name.strip().lower(), "concepts")


def parsed_time(text: Column) -> Column:
    """RFC 3339 times, and dates and times without an offset as UTC; null where none fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def kind(entry_type: Column) -> Column:
    return F.coalesce(entry_type, F.lit("concept"))


def links(wiki: DataFrame) -> DataFrame:
    """src, dst, ord: links in order of first mention."""
    return entries(wiki).select(F.col("slug").alias("src"), F.posexplode(wikilinks(F.coalesce("content", F.lit("")))).alias("ord", "dst"))


def _live(wiki: DataFrame, name: str) -> DataFrame:
    return entries(wiki).select(F.col("slug").alias(name)).distinct()


def dead_links(wiki: DataFrame) -> DataFrame:
    """Links to what is no entry; the reserved pages are none."""
    return links(wiki).select("src", "dst").join(_live(wiki, "dst"), "dst", "left_anti").select("src", "dst")


def inbound(wiki: DataFrame) -> DataFrame:
    """slug, inbound: entries linking to an entry, itself included; entries without a link to them have no row."""
    return links(wiki).join(_live(wiki, "dst"), "dst", "left_semi").groupBy(F.col("dst").alias("slug")).agg(F.count(F.lit(1)).alias("inbound"))


def orphans(wiki: DataFrame) -> DataFrame:
    """Entries that are no sources and that no entry links to."""
    own = entries(wiki).where(kind(F.col("entry_type")) != "source").select("slug").distinct()
    return own.join(links(wiki).select(F.col("dst").alias("slug")).distinct(), "slug", "left_anti")


def stale(wiki: DataFrame, now: str, days: int = 180) -> DataFrame:
    """Entries that are no sources, last updated more than days before now; unreadable times are not stale."""
    at = parsed_time(F.col("updated"))
    return entries(wiki).where((kind(F.col("entry_type")) != "source") & (at < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))).select("slug", "updated")


def thin_areas(wiki: DataFrame, least: int = 3) -> DataFrame:
    return entries(wiki).select("slug").distinct().groupBy(area(F.col("slug")).alias("area")).agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") < least)


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w) for w in NEGATIONS]))


def contradictions(wiki: DataFrame, pairs: DataFrame, top: int = 20) -> DataFrame:
    """Of the top most similar pairs(slug_a, slug_b, score) those in which both texts negate."""
    best = pairs.orderBy(F.desc("score"), "slug_a", "slug_b").limit(top)
    says = entries(wiki).groupBy("slug").agg(F.max(has_negation(F.coalesce("content", F.lit("")))).alias("negates"))
    a, b = says.select(F.col("slug").alias("slug_a"), F.col("negates").alias("na")), says.select(F.col("slug").alias("slug_b"), F.col("negates").alias("nb"))
    return best.join(a, "slug_a").join(b, "slug_b").where("na AND nb").select("slug_a", "slug_b", "score")


def list_entries(wiki: DataFrame, tags: list[str] | None = None, entry_type: str | None = None) -> DataFrame:
    found = entries(wiki)
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if entry_type:
        found = found.where(F.col("entry_type") == entry_type)
    return found.select("slug", "title", "entry_type", "updated").orderBy(F.desc("updated"), "slug")


def search(wiki: DataFrame, ranked: DataFrame, tags: list[str] | None = None, entry_type: str | None = None, limit: int = 10, prefilter: bool = False) -> DataFrame:
    """Entries of ranked(slug, score): tags are filtered before the best limit are taken, types after, or before with prefilter."""
    found = entries(wiki).select("slug", "title", "entry_type", "tags", "content")
    if tags:
        found = found.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if entry_type and prefilter:
        found = found.where(F.col("entry_type") == entry_type)
    best = ranked.join(found, "slug").orderBy(F.desc("score"), "slug").limit(limit)
    return best.where(F.col("entry_type") == entry_type) if entry_type and not prefilter else best


def index_rows(wiki: DataFrame) -> DataFrame:
    """area, ord, line: the rendered index line by line, an area's first one under its heading."""
    return index_lines(wiki).select("area", "ord", F.concat(F.when(F.col("header"), F.concat(F.lit("\n## "), "area", F.lit("\n"))).otherwise(""), "line", F.lit("\n")).alias("line"))


def index_text(wiki: DataFrame, limit: int = 4000) -> DataFrame:
    """One row, text: the first limit characters of the rendered index. Lines beyond the limit are not gathered."""
    lines = index_rows(wiki)
    first = lines.orderBy("area", "ord").limit(limit)  # a line has a character at least
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("area", "ord", "line"))), lambda x: x.line), "")
    return first.agg(F.left(F.concat(F.lit("# Index\n"), text), F.lit(limit)).alias("text"))


def query_bundle(wiki: DataFrame, ranked: DataFrame, limit: int = 10) -> DataFrame:
    """rank, slug, score, text, links: whole texts for the first three, previews of 200 characters for the rest."""
    best = search(wiki, ranked, limit=limit)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "slug"))  # over at most limit rows
    told = best.withColumn("rank", rank)
    first = F.col("rank") <= 3
    return told.select("rank", "slug", "score", F.when(first, F.col("content")).otherwise(F.left("content", F.lit(200))).alias("text"), F.when(first, wikilinks(F.col("content"))).otherwise(F.array().cast("array<string>")).alias("links"))


def summary(text: Column) -> Column:
    """The first line that is not blank, trimmed, of at most 100 characters."""
    return F.left(F.regexp_extract(text, r"(?m)^[ \t]*(\S.*?)\s*$", 1), F.lit(100))


def index_lines(wiki: DataFrame) -> DataFrame:
    """area, ord, slug, line, header: the rendered index, areas in order, newest entries first; header marks an area's first line."""
    by = Window.partitionBy("area").orderBy(F.desc("updated"), "slug")
    rows = entries(wiki).withColumn("area", area(F.col("slug"))).withColumn("ord", F.row_number().over(by))
    line = F.format_string("- [[%s]] — %s (%s)", "slug", "title", summary(F.coalesce("content", F.lit(""))))
    return rows.select("area", "ord", "slug", line.alias("line"), (F.col("ord") == 1).alias("header"))


def ingest_plan(wiki: DataFrame, titles: DataFrame, area_name: str = "concept") -> DataFrame:
    """title, source_slug, suggested: a free slug under sources/ for each title, numbered from 2 if taken, and where notes should go."""
    base = titles.select("title", F.concat(F.lit("sources/"), slugify(F.col("title"))).alias("base")).distinct()
    taken = wiki.select("slug").distinct().select(F.regexp_extract("slug", r"^(.*?)(?:-(\d+))?$", 1).alias("base"), F.col("slug"))
    used = base.join(taken.select("base", "slug").union(wiki.select("slug", F.col("slug"))).distinct(), "base").groupBy("base").agg(F.collect_set("slug").alias("used"))
    free = base.join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    numbers = F.transform(F.sequence(F.lit(2), F.size("used") + 2), lambda i: F.concat("base", F.lit("-"), i.cast("string")))
    first = F.get(F.filter(F.concat(F.array("base"), numbers), lambda s: ~F.array_contains("used", s)), 0)
    return free.select("title", first.alias("source_slug"), F.concat(F.lit(normalise_area(area_name) + "/"), slugify(F.col("title"))).alias("suggested"))


@dataclass
class Ingested:
    """What an ingested source leads to; the lists are bounded by RELATED and SUGGESTED."""

    wiki: DataFrame
    log: DataFrame
    source_slug: str
    related: list[tuple[str, float]]
    neighbours: list[str]
    suggested: list[str]


def ingest(wiki: DataFrame, content: str, rank: Callable[[DataFrame], DataFrame], now: str, title: str | None = None, area_name: str = "concepts", source_uri: str | None = None) -> Ingested:
    """Writes a text as a source under a free slug and plans the notes to be made of it.

    rank: the entries of a wiki as (slug, score) for the text, from whatever index the caller has. Related are the best hits, neighbours what
    they link to in order of mention, suggested a fresh slug in the area and the hits.
    """
    spark = wiki.sparkSession
    plan = ingest_plan(wiki, spark.createDataFrame([(title or "untitled",)], "title string"), area_name).first()
    row = [(plan.source_slug, title or "Untitled source", "source", [], [source_uri] if source_uri else [], content)]
    new = spark.createDataFrame(row, "slug string, title string, entry_type string, tags array<string>, sources array<string>, content string")
    written = upsert(wiki, new, now)
    hits = search(written, rank(written), limit=RELATED).select("slug", "score", wikilinks(F.coalesce("content", F.lit(""))).alias("links")).collect()  # at most RELATED rows
    suggested = [h.slug for h in hits if h.slug != plan.source_slug][: SUGGESTED - 1]
    fresh = [plan.suggested] if plan.suggested not in suggested else []
    return Ingested(
        written,
        log_lines(new, "ingest", now),
        plan.source_slug,
        [(h.slug, h.score) for h in hits],
        list(dict.fromkeys(x for h in hits for x in h.links)),
        (fresh + suggested)[:SUGGESTED],
    )


def log_lines(rows: DataFrame, op: str, now: str) -> DataFrame:
    """day, op, title, slug, line: what the log gains for rows(slug, title) written, deleted or ingested; the caller appends it."""
    day = F.lit(now[:10])
    return rows.select(day.alias("day"), F.lit(op).alias("op"), "title", "slug", F.format_string("## [%s] %s | %s (%s)", day, F.lit(op), "title", "slug").alias("line"))


def reconcile(pages: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, missing): of what is indexed(slug, ...) the rows whose page is still there, and the pages(slug, ...) to index anew. Edits are not seen."""
    there = entries(pages)
    kept = indexed.where(~F.col("slug").isin(RESERVED)).join(there.select("slug").distinct(), "slug", "left_semi")
    return kept, there.join(indexed.select("slug").distinct(), "slug", "left_anti")


def upsert(wiki: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """wiki with rows written over entries of the same slug; created is kept, updated is now. Reserved and invalid slugs and
    existing sources fail."""
    from quillon.functions.text import is_valid_slug

    bad = rows.where(~is_valid_slug(F.col("slug")) | F.col("slug").isin(RESERVED)).select("slug").limit(5).collect()
    if bad:
        raise ValueError(f"slugs that cannot be written: {[r.slug for r in bad]}")
    fixed = rows.where(F.startswith("slug", F.lit("sources/"))).join(wiki.select("slug").distinct(), "slug", "left_semi").select("slug").limit(5).collect()
    if fixed:
        raise ValueError(f"sources are written once: {[r.slug for r in fixed]}")
    born = wiki.groupBy("slug").agg(F.min("created").alias("_born"))
    new = rows.drop("created", "updated").join(born, "slug", "left").withColumn("created", F.coalesce("_born", F.lit(now))).withColumn("updated", F.lit(now))
    return wiki.join(rows.select("slug"), "slug", "left_anti").unionByName(new.select(*wiki.columns))


def delete(wiki: DataFrame, slug: str) -> DataFrame:
    if slug in RESERVED or slug.startswith("sources/"):
        raise ValueError(f"{slug} cannot be deleted")
    if wiki.where(F.col("slug") == slug).isEmpty():
        raise KeyError(slug)
    return wiki.where(F.col("slug") != slug)


def read(wiki: DataFrame, slug: str) -> DataFrame:
    return entries(wiki).where(F.col("slug") == slug)


def previews(wiki: DataFrame) -> DataFrame:
    return entries(wiki).select("slug", preview(F.coalesce("content", F.lit(""))).alias("content_preview"))
