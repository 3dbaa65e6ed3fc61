"""Functions paired with their documentation (problem 5).

A state machine reads source text: it knows strings, comments, brackets and, for Python, line structure, so that a brace,
a colon or a comment mark inside a string has no effect. It finds function headers, delimits a function by
its matching braces (Python: by indentation), and attaches the documentation that its language has for it:

* Python: the string that is the body's first statement (plain, raw or unicode; no bytes, no formatted string);
* Rust: ``///`` lines, ``/** */`` blocks and ``#[doc = "..."]`` right before the item, attributes in between;
* Go: a ``//`` or ``/* */`` comment right before ``func``, directives aside;
* Java, JavaScript, TypeScript: a ``/** */`` block right before the header, annotations in between. In JavaScript and TypeScript
  functions and arrow functions that are assigned to a name count as well, in Java constructors.

Comments inside the body count for nothing, Rust's ``//!`` and ``/*! */`` at its head excepted, which are documentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.frames import frame
from quillon.llm.lexing import language_of
from quillon.session import spread
from quillon.sources.tables import table

#: Words of which statements consist that documentation is missing, pending, elsewhere or made by a tool.
PLACEHOLDER_WORDS = frozenset(
    """a above add added an are as at auto autogenerated automatically available be been below by coming comment comments created
    default describe described description desc do doc docs docstring document documentation documented done edit elsewhere
    explain explained file filled fill fixme follow follows for from function generated goes has have helper here implementation implement
    implemented in info information internal is it its later machine made manually me method missing modify more n need needed
    needs no none not nothing of on only other pending placeholder please produced provided purposes purpose refer see self
    since someday soon stub tba tbc tbd template text that the there this to todo tool undocumented unknown update
    use used wip will with write written xxx yet""".split()
)
#: Words a statement adds when it only restates the name.
FILLER_WORDS = frozenset("a an the this that is it function functions func fn method methods def procedure routine for of to".split())
#: Headings of sections in documentation comments.
SECTION_HEADS = frozenset(
    """args arguments attributes deprecated errors example examples keyword note notes other panics parameters params raises return returns
    safety see throws todo usage warning warnings yields""".split()
)

#: name, raw documentation, start, end, and where documentation stands inside.
Found = tuple[str, str, int, int, tuple[int, int] | None]

_TOKEN = {
    "brace": re.compile(
        r"""(?P<doc>///(?!/)[^\n]*|/\*\*(?![*/]).*?\*/)|(?P<note>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<raw>r(?P<h>\#*)"(?:.*?)"(?P=h))|(?P<str>"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*')"""
        r"""|(?P<attr>\#!?\[)|(?P<at>@[\w.]+)|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>=>|->|::|[(){}\[\];=<>,:*&])|(?P<nl>\n)""",
        re.S,
    ),
    "python": re.compile(
        r"""(?P<note>\#[^\n]*)|(?P<str>(?:[rRuUbBfF]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<word>[^\W\d]\w*)|(?P<op>[(){}\[\]:])|(?P<nl>\n)""",
        re.S,
    ),
}
_RUST_LIFETIME = re.compile(r"'[A-Za-z_]\w*(?!')")
#: Words before a name that is declared.
_MODIFIERS = frozenset("export default const let var public private protected static readonly declare override".split())
_FUNCTION_VALUE = re.compile(r"\s*(?:async\b\s*)?(?:(?P<function>function\b\s*\*?\s*[\w$]*\s*(?:<[^<>()]*>\s*)?\()|(?:<[^<>()]*>\s*)?\(|(?P<bare>[A-Za-z_$][\w$]*\s*=>\s*))")
_ARROW = re.compile(r"\s*(?::[^=;{}]*(?:\{[^{}]*\}[^=;{}]*)?)?=>\s*")
_INNER_DOC = re.compile(r"\s*((?://![^\n]*(?:\n\s*|$))+|/\*!.*?\*/)", re.S)
_NOT_NAMES = frozenset("if for while switch catch return match loop else do try new await async unsafe super this constructor_ function func fn with synchronized throw typeof".split())


def _skip(text: str, at: int, scan: re.Pattern, ends: str) -> int:
    """Position behind the bracket that closes the one open at ``at``; the end of text if none does."""
    depth = 0
    for m in scan.finditer(text, at):
        if m.lastgroup in ("op", "attr"):
            t = m.group()
            if t in ("(", "{", "[", "#[", "#!["):
                depth += 1
            elif t in (")", "}", "]"):
                depth -= 1
                if depth <= 0:
                    return m.end()
    return len(text)


def _python_functions(text: str, first_only: bool) -> Iterator[Found]:
    scan = _TOKEN["python"]
    depth, header, name, fresh, start = 0, False, None, True, 0
    for m in scan.finditer(text):
        kind, t = m.lastgroup, m.group()
        if kind == "op":
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
            elif t == ":" and depth == 0 and header and name:
                doc, inner = _python_doc(text, m.end())
                yield name, doc, start, _python_end(text, start, m.end()), inner
                if first_only:
                    return
                header, name = False, None
            fresh = False
        elif kind == "nl":
            if depth == 0:
                fresh = True
        elif kind == "word":
            if header and name is None:
                name = t
            elif t == "def" and fresh and depth == 0:
                header, name, start = True, None, text.rfind("\n", 0, m.start()) + 1
            if t != "async":
                fresh = False
        elif kind == "str":
            fresh = False


def _python_doc(text: str, at: int) -> tuple[str, tuple[int, int] | None]:
    """The string that stands first behind position at, and where it stands."""
    docs, scan, span = [], _TOKEN["python"], None
    for m in scan.finditer(text, at):
        between = text[at : m.start()]
        if between.strip(" \t\r;") or (docs and ";" in between):
            break
        at = m.end()
        if m.lastgroup == "str":
            body = re.match(r"([rRuU]?)(\"\"\"|'''|\"|')(.*)\2\Z", m.group(), re.S)
            if not body:
                break
            docs.append(body.group(3))
            span = (span[0] if span else m.start(), m.end())
        elif m.lastgroup == "nl":
            if docs:
                break
        elif m.lastgroup != "note":
            if docs:
                return "", None
            break
    else:
        return "".join(docs), span
    if docs and text[at - 1 : at] != "\n" and re.match(r"[ \t]*[^\s;#]", text[at:]):
        return "", None  # the string is part of an expression
    return "".join(docs), span


def _python_end(text: str, start: int, body: int) -> int:
    indent = len(re.match(r"[ \t]*", text[start:]).group())
    end, depth = body, 0
    for m in re.finditer(r"(?m)^([ \t]*)(?=\S)", text[body:]):
        if m.start() and len(m.group(1)) <= indent and text[body + m.end()] not in "#)]}":
            return body + m.start()
        end = len(text)
    return max(end, body) if depth == 0 else len(text)


def _brace_functions(text: str, language: str, first_only: bool) -> Iterator[Found]:
    if language == "rust":
        text = _RUST_LIFETIME.sub(lambda m: "_" * len(m.group()), text)
    scan = _TOKEN["brace"]
    docs: list[str] = []
    first, pos, words, newlines, angles = None, 0, [], 0, 0

    def reset() -> None:
        nonlocal docs, first, words, angles
        docs, first, words, angles = [], None, [], 0

    while (m := scan.search(text, pos)) is not None:
        kind, t, pos = m.lastgroup if m.lastgroup != "h" else "raw", m.group(), m.end()
        if kind == "nl":
            newlines += 1
            continue
        if kind in ("doc", "note"):
            block = t.startswith("/*")
            if language == "go" and not re.match(r"//(go:|line |export |nolint)", t):
                if newlines > 1 or block or (docs and docs[-1].startswith("/*")):
                    docs = []
                docs.append(t)
            elif kind == "doc" and (language == "rust" or block):
                if language != "rust":
                    docs = []
                docs.append(t)
            newlines = 0
            continue
        if language == "go" and docs and newlines > 1:
            reset()
        newlines = 0
        if kind == "attr":
            stop = _skip(text, m.start(), scan, "]")
            doc = re.match(r'#\[\s*doc\s*=\s*"((?:[^"\\]|\\.)*)"\s*\]\Z', text[m.start() : stop], re.S)
            if doc:
                docs.append("///" + re.sub(r"\\n", "\n///", doc.group(1)).replace('\\"', '"'))
            first = m.start() if first is None else first
            pos = stop
        elif kind == "at":
            first = m.start() if first is None else first
            if text[pos : pos + 1] == "(":
                pos = _skip(text, pos, scan, ")")
        elif kind == "word":
            first = m.start() if first is None else first
            if not angles:
                words.append(t)
        elif t == "<":
            angles += bool(words)
        elif t == ">":
            angles = max(0, angles - 1)
        elif t == "(":
            close = _skip(text, m.start(), scan, ")")
            name, rest = _header(text, close, words, language)
            if language == "go" and words and words[-1] == "func":
                got = re.match(r"\s*([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(", text[close:])
                if got:
                    name, close = got.group(1), _skip(text, close + got.end() - 1, scan, ")")
                    rest = _body(text, close)
            if name and rest is not None:
                end = _skip(text, rest, scan, "}") if text[rest : rest + 1] == "{" else rest + 1
                inner = _INNER_DOC.match(text, rest + 1) if language == "rust" and text[rest : rest + 1] == "{" else None
                told = docs + re.sub(r"(?m)^\s*//!", "///", inner.group(1)).replace("/*!", "/**").split("\n") if inner else docs
                yield name, "\n".join(told), first if first is not None else m.start(), end, inner.span(1) if inner else None
                if first_only:
                    return
                inner = rest + 1
                pos = inner if language in ("javascript", "typescript") else end
                reset()
            else:
                pos = close
        elif t == "=" and words and language in ("javascript", "typescript"):
            body = _function_value(text, pos, scan)
            if body is not None:
                end = _skip(text, body, scan, "}") if text[body : body + 1] == "{" else _expression_end(text, body, scan)
                yield _assigned(text[first:pos], words), "\n".join(docs), first, end, None
                if first_only:
                    return
                pos = body + 1
                reset()
        elif t in (";", "{", "}"):
            reset()


def _function_value(text: str, at: int, scan: re.Pattern) -> int | None:
    """Position of the body of the function or arrow function that is the value at this place."""
    m = _FUNCTION_VALUE.match(text, at)
    if not m:
        return None
    if m["bare"]:
        return m.end()
    close = _skip(text, m.end() - 1, scan, ")")
    if m["function"]:
        body = _body(text, close)
        return body if body is not None and text[body] == "{" else None
    arrow = _ARROW.match(text, close)
    return arrow.end() if arrow else None


def _expression_end(text: str, at: int, scan: re.Pattern) -> int:
    """Where an arrow function's expression ends: before a semicolon, a comma, a closing bracket or a line's end outside brackets."""
    depth = 0
    for m in scan.finditer(text, at):
        t = m.group()
        if m.lastgroup == "nl" or (m.lastgroup == "op" and t in (";", ",")):
            if depth == 0 and text[at : m.start()].strip():
                return m.start()
        elif m.lastgroup == "op" and t in ("(", "{", "["):
            depth += 1
        elif m.lastgroup == "op" and t in (")", "}", "]"):
            depth -= 1
            if depth < 0:
                return m.start()
    return len(text)


def _assigned(target: str, words: list[str]) -> str:
    """The name that gets a value: of a member the last part, else the first word that is no modifier (types follow it)."""
    if re.search(r"[\w$]\.[\w$]+\s*=$", target):
        return words[-1]
    return next((w for w in words if w not in _MODIFIERS), words[-1])


def _body(text: str, at: int) -> int | None:
    """Position of the body's brace (or the semicolon of a bodyless one) behind a parameter list."""
    m = re.compile(r"""(?:[^{};=()"'`]|\([^()]*\)|=>?(?=[^{;]*[{;]))*?([{;])""").match(text, at)
    return m.end() - 1 if m else None


def _header(text: str, close: int, words: list[str], language: str) -> tuple[str | None, int | None]:
    if not words:
        return None, None
    name = words[-1]
    if language == "rust":
        if "fn" not in words[:-1]:
            cut = [i for i, w in enumerate(words) if w == "fn"]
            if not cut or cut[-1] + 1 >= len(words):
                return None, None
        name = words[max(i for i, w in enumerate(words) if w == "fn") + 1]
        return name, _body(text, close)
    if language == "go":
        return (name, _body(text, close)) if "func" in words[:-1] else (None, None)
    if name in _NOT_NAMES:
        return None, None
    rest = _body(text, close)
    if rest is None or (text[rest] == ";" and language != "java"):
        return None, None
    constructor = len(words) == 1 and name[0].isupper() and not name.isupper() and text[rest] == "{"
    if "function" in words or (language == "java" and (len(words) > 1 or constructor) and "new" not in words) or (language != "java" and not re.search(r"[=.]\s*$", text[: text.rfind(name, 0, close)])):
        between = text[close:rest]
        if language != "java" and between.strip() and not between.strip().startswith(":"):
            return None, None
        return name, rest
    return None, None


def functions_of(text: str, language: str | None, first_only: bool = False) -> Iterator[Found]:
    """(name, raw documentation, start, end, place of documentation inside or None) of the functions of a text; first_only stops at the first."""
    if language == "python":
        yield from _python_functions(text, first_only)
    elif language in ("rust", "go", "java", "javascript", "typescript"):
        yield from _brace_functions(text, language, first_only)


def code_of(text: str, start: int, end: int, inner: tuple[int, int] | None) -> str:
    """The function without its documentation; a line that held nothing else goes as a whole."""
    if inner is None:
        return text[start:end].strip("\n")
    a, b = inner
    line = text.rfind("\n", 0, a) + 1
    rest = re.match(r"[ \t]*;?[ \t]*\r?(?:\n|\Z)", text[b:])
    if rest and not text[line:a].strip():
        a, b = line, b + rest.end()
    return (text[start:a] + text[b:end]).strip("\n")


_MARK = re.compile(r"^\s*(?:///?!?|/\*[*!]?|\*(?!\*)|\*/)?\s?|\s*\*+/\s*$")
_TAG = re.compile(r"^\s*[@\\:](?:param|arg|argument|type|tparam|typeparam|return|returns|rtype|throws|raises|exception|see|since|deprecated|yields?)\b:?\s*(?:\{[^}]*\}\s*)?", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def clean_description(raw: str) -> str:
    """Documentation without comment marks, bare section heads and bare tags."""
    kept = []
    for line in raw.replace("\r\n", "\n").split("\n"):
        s = _MARK.sub("", line, count=2).strip()
        s = re.sub(r"\*/\s*$", "", s).strip()
        s = re.sub(r"<[^<>\n]{1,60}>", " ", s).strip()
        tag = _TAG.match(s)
        if tag:
            said = s[tag.end() :].strip()
            names = 1 if re.match(r"\s*[@\\:](?:param|arg|argument|tparam|typeparam|throws|raises|exception|type)\b", s, re.I) else 0
            s = said if len(_WORD.findall(said)) > names else ""
        head = re.sub(r"^[#*=\s]+|[:#*=\s-]+$", "", s).lower()
        if head in SECTION_HEADS or not _WORD.search(s):
            s = ""
        if s:
            kept.append(s)
    return "\n".join(kept)


def _name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)]


def is_trivial(description: str, name: str) -> bool:
    """Empty, under four words, only the name again, or only a statement that there is no documentation here."""
    words = [w.lower() for w in _WORD.findall(description)]
    if len(words) < 4:
        return True
    parts = [p.lower() for w in _WORD.findall(description.replace("_", " ")) for p in (_name_words(w) or [w])]
    mine = set(_name_words(name)) | {name.lower()}
    if all(p in mine or p in FILLER_WORDS for p in parts):
        return True
    flat = [p for w in words for p in re.split(r"['’-]", w)]
    return all(p in PLACEHOLDER_WORDS for p in flat)


def _describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = {"id": [], "name": [], "description": [], "code": []}
        for key, path, language, content in zip(f["id"], f["relative_path"], f["language"], f["content"], strict=True):
            spoken = language_of(path) or (language or "").lower() or None
            if "." not in (path or "").rsplit("/", 1)[-1]:
                spoken = spoken or "python"
            got = next(functions_of(content, spoken, first_only=True), None)
            if got and got[1]:
                name, raw, *place = got
                text = clean_description(raw)
                if not is_trivial(text, name):
                    out["id"].append(key)
                    out["name"].append(name)
                    out["description"].append(text)
                    out["code"].append(code_of(content, *place))
        yield frame(out)


def described_chunks(chunks: DataFrame) -> DataFrame:
    """id, name, description, code of every function or method chunk with real documentation, the code without it.

    The language is that of the path's extension, else the column's, else, for paths without an extension, Python. Null or empty
    content, null ids and other kinds give no row; repeated chunks give one row per repetition. Other columns are ignored.
    """
    kept = chunks.where(F.col("symbol_kind").isin("function", "fn", "method") & F.col("content").isNotNull() & F.col("id").isNotNull())
    return kept.select("id", "relative_path", "language", "content").mapInPandas(_describe, "id string, name string, description string, code string")


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = {"path": [], "indexed_at": [], "name": [], "first_line": [], "description": [], "code": []}
        for path, at, content in zip(f["path"], f["indexed_at"], f["content"], strict=True):
            for name, raw, start, end, inner in functions_of(content, language_of(path, content)):
                text = clean_description(raw) if raw else ""
                if not is_trivial(text, name):
                    out["path"].append(path)
                    out["indexed_at"].append(at)
                    out["name"].append(name)
                    out["first_line"].append(content.count("\n", 0, start) + 1)
                    out["description"].append(text)
                    out["code"].append(code_of(content, start, end, inner))
        yield frame(out)


def described_functions(files: DataFrame) -> DataFrame:
    """path, name, first_line, description, code of every function of whole source files with real documentation.

    Of several rows of a path the one with the latest indexed_at counts, where there is such a column; a null time is earlier than any. Functions are found before these are
    told apart, so that texts stay where they are read.
    """
    at = F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(1 << 62))) if "indexed_at" in files.columns else F.lit(0).cast("bigint")
    kept = files.where(F.col("path").isNotNull()).select("path", at.alias("indexed_at"), "content")
    found = kept.where(F.col("content").isNotNull()).mapInPandas(_pairs, "path string, indexed_at bigint, name string, first_line int, description string, code string")
    latest = kept.groupBy("path").agg(F.max("indexed_at").alias("indexed_at"))
    return found.join(latest, ["path", "indexed_at"]).drop("indexed_at").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return described_chunks(spread(table(spark, folder, "chunks"))).select("id").distinct()


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of every documented chunk."""
    return described_chunks(spread(table(spark, folder, "chunks"))).distinct()


def p5_pairs_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from whole files: functions are found and delimited by the state machine."""
    return described_functions(table(spark, folder, "files").select("path", "content", "indexed_at"))
