"""Source files of a directory tree."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.language import detect_language, language_by_path

MAX_BYTES = 10 << 20
#: Directories that are never source.
ALWAYS_EXCLUDED = [".git", ".hg", ".svn", ".quillon"]


def git_root(path: str) -> str:
    """The enclosing work tree's root, or the path itself."""
    at = os.path.abspath(path)
    while at != os.path.dirname(at):
        if os.path.exists(os.path.join(at, ".git")):
            return at
        at = os.path.dirname(at)
    return os.path.abspath(path)


def ignore_patterns(root: str) -> list[str]:
    """The patterns of all ignore files below root, as regular expressions over relative paths; later ones with ! re-include."""
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in ALWAYS_EXCLUDED]
        if ".gitignore" in names:
            base = os.path.relpath(folder, root).replace(os.sep, "/")
            for line in open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace"):
                rule = line.rstrip("\n").strip()
                if rule and not rule.startswith("#"):
                    found.append(_as_regex(rule, "" if base == "." else base + "/"))
    return found


def _as_regex(rule: str, base: str) -> str:
    negated, rule = rule.startswith("!"), rule.lstrip("!")
    only_dir, rule = rule.endswith("/"), rule.rstrip("/")
    anchored = "/" in rule
    body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, x if x.startswith("[") else re.escape(x)) for x in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]*\]|.", rule.lstrip("/")))
    return ("!" if negated else "") + "^" + re.escape(base) + ("" if anchored else "(?:.*/)?") + body + ("/.*" if only_dir else "(?:/.*)?") + "$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """The last matching pattern decides."""
    out = F.lit(False)
    for p in patterns:
        out = F.when(path.rlike(p.lstrip("!")), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def read_files(spark: SparkSession, root: str, respect_ignore: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (relative), language, content, size_bytes, content_hash of the UTF-8 files of known language below root.

    Hidden files count, version control directories do not. Files outside root, over max_bytes or not valid UTF-8 are left out.
    """
    root = os.path.realpath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    relative = F.regexp_extract(F.url_decode("path"), r"^(?:file:)?/*" + re.escape(root.strip("/")) + r"/(.*)$", 1)
    rows = raw.select(relative.alias("path"), "length", "content").where("path <> ''")
    segments = F.split("path", "/")
    rows = rows.where(~F.arrays_overlap(segments, F.array(*[F.lit(x) for x in ALWAYS_EXCLUDED])))
    if respect_ignore:
        rows = rows.where(~is_ignored(F.col("path"), ignore_patterns(root)))
    text = rows.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"), F.col("length").alias("size_bytes"))
    known = text.withColumn("language", detect_language(F.col("path"), F.col("content"))).where("language IS NOT NULL")
    return known.select("path", "language", "content", "size_bytes", F.sha2("content", 256).alias("content_hash"))


def indexable(path: str) -> bool:
    """Whether a path alone names a known language."""
    from quillon.sources.language import EXTENSIONS

    return fnmatch.fnmatch(path, "*.*") and path.rsplit(".", 1)[1].lower() in EXTENSIONS


__all__ = ["git_root", "ignore_patterns", "is_ignored", "indexable", "language_by_path", "read_files"]
