"""Wiki entries as Markdown files with a front matter of six keys."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import split_csv
from quillon.operators.wiki import index_rows

KEYS = ["title", "type", "tags", "sources", "created", "updated"]


def parse_front_matter(rows: DataFrame, slug: str = "slug", text: str = "text") -> DataFrame:
    """slug, title, entry_type, tags, sources, created, updated, content.

    Without a leading '---' the whole text is content, the title is the slug, the type concept; an unclosed front matter fails.
    """
    t = F.regexp_replace(F.col(text), "\r\n", "\n")
    opened = F.startswith(t, F.lit("---\n"))
    block = F.regexp_extract(t, r"(?s)\A---\n(.*?)(?:\n)?---(?:\n|\z)", 1)
    closed = t.rlike(r"(?s)\A---\n.*?---(?:\n|\z)")
    body = F.regexp_replace(t, r"(?s)\A---\n.*?---(?:\n|\z)\n?", "")
    read = rows.select(F.col(slug).alias("slug"), opened.alias("_o"), F.when(~opened | closed, True).otherwise(F.raise_error(F.concat(F.lit("unclosed front matter in "), F.col(slug)))).alias("_ok"), block.alias("_b"), F.when(opened, body).otherwise(t).alias("content")).where("_ok")

    def value(key: str) -> Column:
        raw = F.trim(F.regexp_extract("_b", rf"(?m)^{key}:[ \t]*(.*)$", 1))
        quoted = raw.rlike(r'^".*"$')
        plain = F.when(quoted, F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('\\"'), F.lit('"'))).otherwise(raw)
        return F.when(plain != "", plain)

    items = lambda key: F.coalesce(split_csv(F.regexp_replace(value(key), r"^\[|\]$", "")), F.array().cast("array<string>"))
    return read.select(
        "slug",
        F.coalesce(value("title"), "slug").alias("title"),
        F.coalesce(value("type"), F.lit("concept")).alias("entry_type"),
        items("tags").alias("tags"),
        items("sources").alias("sources"),
        value("created").alias("created"),
        value("updated").alias("updated"),
        "content",
    )


def render_front_matter(wiki: DataFrame) -> DataFrame:
    """slug, text of every entry; titles are quoted, lists are comma-separated, nulls are left empty."""
    title = F.concat(F.lit('"'), F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    one = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    text = F.format_string("---\ntitle: %s\ntype: %s\ntags: %s\nsources: %s\ncreated: %s\nupdated: %s\n---\n\n%s", title, one("entry_type"), listed("tags"), listed("sources"), one("created"), one("updated"), one("content"))
    return wiki.select("slug", text.alias("text"))


def read_wiki(spark: SparkSession, root: str) -> DataFrame:
    """Entries of all Markdown files below root, index and log aside."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.input_file_name().alias("p"))
    slug = F.regexp_extract(F.url_decode("p"), r"^(?:file:)?/*" + root.strip("/").replace(".", r"\.") + r"/(.*)\.md$", 1)
    return parse_front_matter(files.select(slug.alias("slug"), F.col("value").alias("text")).where(~F.col("slug").isin("index", "log")))


def migrate_legacy(wiki: DataFrame) -> DataFrame:
    """Entries in no area move to concepts/legacy-<name>, numbered where that is taken."""
    from pyspark.sql import Window

    from quillon.functions.text import slugify

    old = ~F.contains("slug", F.lit("/"))
    base = F.concat(F.lit("concepts/legacy-"), slugify(F.col("slug")))
    nth = F.row_number().over(Window.partitionBy("_new").orderBy("slug"))
    moved = wiki.where(old).withColumn("_new", base).withColumn("_n", nth)
    moved = moved.withColumn("slug", F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.concat("_new", F.lit("-"), F.col("_n").cast("string")))).drop("_new", "_n")
    return wiki.where(~old).unionByName(moved.withColumn("entry_type", F.coalesce("entry_type", F.lit("concept"))))


class WikiFolder:
    """A folder of Markdown entries on the driver's machine, as people edit it; index.md and log.md follow every write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        os.makedirs(self.root, exist_ok=True)

    def entries(self) -> DataFrame:
        return read_wiki(self.spark, self.root)

    def _put(self, name: str, text: str, mode: str = "w") -> None:
        path = os.path.join(self.root, f"{name}.md")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, mode, encoding="utf-8") as f:
            f.write(text)

    def write(self, wiki: DataFrame, slugs: list[str], log: DataFrame) -> None:
        """Files of the entries of these slugs as the table has them; a slug without an entry loses its file."""
        there = {r.slug: r.text for r in render_front_matter(wiki.where(F.col("slug").isin(slugs))).collect()}  # as many rows as slugs
        lines = [r.line for r in log.collect()]
        for slug in slugs:
            if slug in there:
                self._put(slug, there[slug])
            elif os.path.exists(os.path.join(self.root, f"{slug}.md")):
                os.remove(os.path.join(self.root, f"{slug}.md"))
        head = "---\ntitle: {0}\ntype: {1}\ntags: \nsources: \ncreated: \nupdated: \n---\n\n# {0}\n"
        if not os.path.exists(os.path.join(self.root, "log.md")):
            self._put("log", head.format("Log", "log"))
        self._put("log", "".join(f"{x}\n" for x in lines), "a")
        rows = index_rows(self.entries()).orderBy("area", "ord").toLocalIterator()
        self._put("index", head.format("Index", "index") + "".join(r.line for r in rows))
