"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line, an empty text has none."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r$", ""))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    ends = F.length(text) - F.length(F.translate(text, "\n", ""))
    return (ends + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down, plus one."""
    return (F.floor(F.octet_length(text) / 4) + 1).cast("int")


def preview(text: Column, limit: int = 200) -> Column:
    """At most limit bytes, cut back to a whole character; three dots mark a cut."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - back).cast("string")) for back in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.coalesce(*cuts), F.lit("...")))


def search_blob(symbol: Column, path: Column, content: Column) -> Column:
    return F.lower(F.concat_ws(" ", symbol, path, content))


def slugify(text: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "untitled").otherwise(slug)


def is_valid_slug(slug: Column) -> Column:
    """Not empty, no empty segment, no '..', backslash or NUL."""
    return F.coalesce((slug != "") & ~slug.rlike(r"\.\.|\\|\x00|^/|/$|//"), F.lit(False))


def wikilinks(text: Column) -> Column:
    """Targets of [[...]] in order of first mention; trimmed, without empty ones."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != ""))


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of less than 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (F.octet_length(w) < 40))


def identifier_parts(token: Column) -> Column:
    """Cut at lower-upper and digit boundaries: fooBar2 -> foo, Bar, 2."""
    return F.regexp_extract_all(token, F.lit(r"([0-9]+|\p{Lu}+\p{Ll}*|\p{Ll}+|\p{Lo}+)"), F.lit(1))


def has_regex_marks(query: str) -> bool:
    return any(c in query for c in "\\.+*?()[]{}|^$")


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def resolve_page(limit: float | None, offset: float | None = None, default: int = 20) -> tuple[int, int]:
    """Numbers as callers send them to (limit, offset): unusable limits give the default, others round half away from zero."""
    import math

    ok = limit is not None and math.isfinite(limit) and limit > 0
    size = max(1, math.floor(limit + 0.5)) if ok else default
    skip = max(0, math.trunc(offset)) if offset is not None and math.isfinite(offset) else 0
    return size, skip
