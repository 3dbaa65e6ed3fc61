"""Language of a file by its path, else by the interpreter its first line names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension or file name to language.
EXTENSIONS = {
    "c": "c", "cc": "cpp", "clj": "clojure", "cpp": "cpp", "cs": "csharp", "css": "css", "dart": "dart", "ex": "elixir", "go": "go", "h": "c", "hpp": "cpp", "hs": "haskell", "html": "html",
    "java": "java", "js": "javascript", "json": "json", "jsx": "javascript", "kt": "kotlin", "lua": "lua", "md": "markdown", "mjs": "javascript", "ml": "ocaml", "php": "php", "pl": "perl",
    "proto": "proto", "py": "python", "r": "r", "rb": "ruby", "rs": "rust", "scala": "scala", "sh": "bash", "sql": "sql", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "tsx",
    "xml": "xml", "yaml": "yaml", "yml": "yaml", "zig": "zig",
}
#: Interpreter to language.
INTERPRETERS = {"bash": "bash", "deno": "typescript", "lua": "lua", "node": "javascript", "perl": "perl", "php": "php", "python": "python", "ruby": "ruby", "sh": "bash"}


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def language_by_path(path: Column) -> Column:
    return _mapped(F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)), EXTENSIONS)


def language_by_first_line(text: Column) -> Column:
    return _mapped(F.regexp_extract(text, r"^#![^\n]*?([a-z]+)[0-9.]*[ \t\r]*(?:\n|\z)", 1), INTERPRETERS)


def detect_language(path: Column, text: Column) -> Column:
    return F.coalesce(language_by_path(path), language_by_first_line(text))


def is_indexable(path: Column) -> Column:
    return language_by_path(path).isNotNull()
