"""From files to chunks, and from chunks to call edges."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.frames import frame
from quillon.functions.text import line_count, lines_of

BLOCK_LINES = 80
CHUNK_SCHEMA = "relative_path string, language string, symbol_name string, symbol_kind string, start_line int, end_line int, content string"

#: Words before a bracket that are no calls, by language; "" holds for every language.
NO_CALLS = {
    "": "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while".split(),
    "python": "and assert async await class def del elif except finally from global import is lambda nonlocal not or pass print raise try with yield".split(),
    "javascript": "async await case catch class default delete do export extends finally function import instanceof new of switch throw try typeof var void yield".split(),
    "go": "case chan default defer fallthrough func go goto import interface map package range select switch var".split(),
    "java": "abstract assert case catch class default do extends final finally implements import instanceof interface new package private protected public switch synchronized this throw throws try void".split(),
}


def enrich(raw: DataFrame) -> DataFrame:
    """Adds id (path:name:start-end) and line_count; unnamed items are called kind@Lstart."""
    named = raw.withColumn("symbol_name", F.coalesce(F.nullif("symbol_name", F.lit("")), F.format_string("%s@L%d", "symbol_kind", "start_line")))
    key = F.concat("relative_path", F.lit(":"), "symbol_name", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return named.withColumn("id", key).withColumn("line_count", line_count(F.col("content")))


def block_chunks(files: DataFrame, size: int = BLOCK_LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive blocks of size lines of files(path, language, content, ...); an empty file has none. keep: further columns of files to carry along."""
    lines = files.select("path", "language", *keep, lines_of(F.col("content")).alias("l")).where(F.size("l") > 0)
    starts = lines.select("path", "language", *keep, "l", F.explode(F.sequence(F.lit(1), F.size("l"), F.lit(size))).alias("start_line"))
    return enrich(
        starts.select(
            F.col("path").alias("relative_path"),
            "language",
            *keep,
            F.format_string("block@L%d", "start_line").alias("symbol_name"),
            F.lit("block").alias("symbol_kind"),
            "start_line",
            F.least(F.col("start_line") + size - 1, F.size("l")).alias("end_line"),
            F.array_join(F.slice("l", F.col("start_line"), F.lit(size)), "\n").alias("content"),
        )
    )


#: Headers of items in brace languages and the kind they give.
ITEM_HEADERS = {
    "rust": [(r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", "function"), (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"), (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"), (r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"), (r"impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)", "impl"), (r"(?:pub\s+)?mod\s+(\w+)\s*\{", "module")],
    "go": [(r"func\s+(?:\([^)]*\)\s*)?(\w+)", "function"), (r"type\s+(\w+)\s+struct", "struct"), (r"type\s+(\w+)\s+interface", "interface")],
    "java": [(r"(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+(\w+)", "class"), (r"(?:(?:public|private|protected|static)\s+)*interface\s+(\w+)", "interface"), (r"(?:(?:public|private|protected|static)\s+)*enum\s+(\w+)", "enum"), (r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w, ]+)?\s*\{", "method")],
    "javascript": [(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"), (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"(?:export\s+)?interface\s+(\w+)", "interface"), (r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", "enum"), (r"(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w.]+)", "module"), (r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?#?(\w+)\s*(?:<[^<>()]*>)?\([^;{}]*\)\s*(?::[^;{}]+)?\{", "method")],
    "c": [(r"(?:static\s+|inline\s+|extern\s+)*[\w*]+[\w\s*]*?[\s*](\w+)\s*\([^;{}]*\)\s*\{", "function"), (r"(?:typedef\s+)?struct\s+(\w+)", "struct"), (r"(?:typedef\s+)?enum\s+(\w+)", "enum")],
    "csharp": [(r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*class\s+(\w+)", "class"), (r"(?:(?:public|internal)\s+)*interface\s+(\w+)", "interface"), (r"(?:(?:public|internal|readonly)\s+)*struct\s+(\w+)", "struct"), (r"(?:(?:public|internal)\s+)*enum\s+(\w+)", "enum"), (r"namespace\s+([\w.]+)", "module"), (r"(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\], ?]+\s+(\w+)\s*\([^;{}]*\)\s*\{", "method")],
    "kotlin": [(r"(?:(?:public|private|internal|protected|open|data|sealed|abstract)\s+)*class\s+(\w+)", "class"), (r"(?:(?:public|private|internal)\s+)*interface\s+(\w+)", "interface"), (r"(?:(?:private|internal)\s+)*object\s+(\w+)", "class"), (r"(?:(?:public|private|internal|protected|override|open|inline|suspend|operator)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)", "function")],
    "php": [(r"(?:abstract\s+|final\s+)*class\s+(\w+)", "class"), (r"interface\s+(\w+)", "interface"), (r"trait\s+(\w+)", "trait"), (r"(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)", "function")],
    "scala": [(r"(?:(?:private|protected|final|sealed|abstract|case|implicit)\s+)*class\s+(\w+)", "class"), (r"(?:case\s+)?object\s+(\w+)", "class"), (r"(?:sealed\s+)?trait\s+(\w+)", "trait"), (r"(?:(?:private|protected|override|final|implicit)\s+)*def\s+(\w+)", "function")],
    "swift": [(r"(?:(?:public|private|internal|open|final)\s+)*class\s+(\w+)", "class"), (r"(?:(?:public|private|internal)\s+)*struct\s+(\w+)", "struct"), (r"(?:(?:public|private|internal)\s+)*enum\s+(\w+)", "enum"), (r"(?:(?:public|private)\s+)*protocol\s+(\w+)", "interface"), (r"(?:(?:public|private|internal|static|override|mutating)\s+)*func\s+(\w+)", "function")],
}
ITEM_HEADERS["typescript"], ITEM_HEADERS["cpp"] = ITEM_HEADERS["javascript"], [*ITEM_HEADERS["c"], (r"class\s+(\w+)", "class"), (r"namespace\s+(\w+)", "module")]
#: Words before a bracket and a brace that are no methods.
NO_METHODS = frozenset("if for while switch catch function return with synchronized else do try".split())


def _python_items(text: str) -> list[tuple[str, str, int, int]]:
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    found = []

    def walk(node: ast.AST, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            kind = kinds.get(type(child))
            if kind:
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                found.append((child.name, "method" if kind == "function" and inside else kind, first, child.end_lineno))
            walk(child, isinstance(child, ast.ClassDef) if kind else inside)

    walk(ast.parse(text), False)
    return sorted(found, key=lambda x: x[2])


_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.){1,9}'", re.S)


def _brace_items(text: str, headers: list[tuple[str, str]]) -> list[tuple[str, str, int, int]]:
    shadow = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    opened, closes = [], {}
    for b in re.finditer(r"[{}]", shadow):
        if b.group() == "{":
            opened.append(b.start())
        elif opened:
            closes[opened.pop()] = b.start()
    starts = np.array([m.start() for m in re.finditer("\n", shadow)])
    line = lambda at: int(np.searchsorted(starts, at)) + 1
    found, taken = [], set()
    for pattern, kind in headers:
        for m in re.finditer(rf"^[ \t]*{pattern}", shadow, re.M):
            at = shadow.find("{", m.end() - 1 if shadow[m.end() - 1] == "{" else m.end())
            stop = shadow.find(";", m.end())
            if at < 0 or (0 <= stop < at) or (kind == "method" and (at in taken or m.group(1) in NO_METHODS)):
                continue
            taken.add(at)
            found.append((m.group(1), kind, line(m.start()), line(closes.get(at, len(shadow) - 1))))
    return sorted(set(found), key=lambda x: (x[2], -x[3]))


def _rows_of(path: str, language: str | None, text: str) -> Iterator[tuple]:
    lines = text.splitlines()
    try:
        items = _python_items(text) if language == "python" else _brace_items(text, ITEM_HEADERS.get(language, []))
    except (SyntaxError, ValueError, RecursionError):
        items = []
    for n, k, a, b in items:
        yield path, language, n, k, a, b, "\n".join(lines[a - 1 : b])
    if not items:
        for a in range(0, len(lines), BLOCK_LINES):
            yield path, language, f"block@L{a + 1}", "block", a + 1, min(a + BLOCK_LINES, len(lines)), "\n".join(lines[a : a + BLOCK_LINES])


def _items(version: str | None):
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")] + ([version] if version else [])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            marks = [(v,) for v in f[version]] if version else [()] * len(f)
            rows = [row + mark for *file, mark in zip(f["path"], f["language"], f["content"], marks, strict=True) for row in _rows_of(*file)]
            yield frame({n: [r[i] for r in rows] for i, n in enumerate(names)})

    return run


def structure_chunks(files: DataFrame, version: str | None = None) -> DataFrame:
    """One chunk per item of files(path, language, content), nested ones too; blocks where no item is found. version: a bigint column of files to carry along."""
    kept = files.where(F.col("content").isNotNull() & F.col("path").isNotNull()).select("path", "language", "content", *([version] if version else []))
    return enrich(kept.mapInPandas(_items(version), CHUNK_SCHEMA + (f", {version} bigint" if version else "")))


def call_edges(chunks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """caller_name, caller_file, caller_line, callee_name, callee_lc: one row per call written in a chunk's content.

    A call is a name before a bracket. Names of one byte, words of the language and the chunk's own name are none. Repeated chunks count
    once: they are told by their names and calls, so no content is moved.
    """
    own = [c for c in ("id", *keep) if c in chunks.columns]
    calls = (
        chunks.select(
            *own,
            F.col("symbol_name").alias("caller_name"),
            F.col("relative_path").alias("caller_file"),
            F.col("start_line").alias("caller_line"),
            F.coalesce("language", F.lit("")).alias("language"),
            F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)).alias("_calls"),
        )
        .where(F.size("_calls") > 0)
        .distinct()
        .withColumn("callee_name", F.explode("_calls"))
    )
    words = F.col("callee_name").isin(NO_CALLS[""])
    for language, names in NO_CALLS.items():
        if language:
            spoken = ["javascript", "typescript"] if language == "javascript" else [language]
            words = words | (F.col("language").isin(spoken) & F.col("callee_name").isin(names))
    kept = calls.where((F.octet_length("callee_name") >= 2) & ~words & (F.col("callee_name") != F.col("caller_name")))
    return kept.select("caller_name", "caller_file", "caller_line", "callee_name", F.lower("callee_name").alias("callee_lc"), *keep)
