"""Source files that do not parse (problem 1).

1. Lexing. Each file becomes a string of token classes, and rows are made of it: its distinct pairs of adjacent tokens,
   its brackets (pairs closed at once left out), and its distinct statements.
2. Pairs are anti-joined with the permissible pairs that follow from each language's grammar.
3. Nesting: a window over a file's brackets gives every bracket its depth; a closing bracket must be preceded, at its
   depth, by an opening one of its kind, and the last depth must be 0.
4. Statements are held against the productions they must match.

A file fails if any of the three finds a fault. Strings and comments are single tokens, so that text about damage in them is
no damage. Markdown and files of no known language never fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.frames import frame
from quillon.llm.grammar import BAD_STATEMENTS, LANGUAGES, Classes, permissible_pairs, token_pattern
from quillon.llm.lexing import language_of
from quillon.session import cut, spread
from quillon.sources.tables import table

_GROUP = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_CALL, _NAMED = re.compile(r"\([^()\[\]{}]*=[^()\[\]{}]*\)"), re.compile(r"[im](?::[^=]*)?=")
_NO_BRACKET = re.compile(r"[^()\[\]{}]+")
_CLOSED = re.compile(r"\(\)|\[\]|\{\}")
_LEAF = re.compile(r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]")
_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_VALUES = re.compile(r"(?:N?d?[ns],N?){2,}")
_GO_PARAMETERS = re.compile(r"ii|i2i|i[FMS]|iz")
_JAVA_PARAMETERS = re.compile(r"(?:^|[;,m])(?:[iy.]|i?b[ib2,.]*)*[iyb2z]i(?=$|[,=:])")
_ANNOTATION = re.compile(r"@i(?:\.i)*[14]?")
_MORE_FIELDS, _MORE_ITEMS = re.compile(r"(?:,s:[snv])+"), re.compile(r"(?:,[snv])+")


def _misplaced(group: str) -> bool:
    """Whether a plain item follows one with a name and a value; items behind a star and lambdas aside."""
    named = False
    for item in group[1:-1].split(",") if "l" not in group else ():
        if item[:1] == "d":
            break
        if _NAMED.match(item):
            named = True
        elif item and named:
            return True
    return False


def _collapsed(statement: str, found: set[str] | None = None) -> str:
    while (shorter := _GROUP.sub("G", statement)) != statement:
        if found is not None and any(map(_misplaced, _CALL.findall(statement))):
            found.add("(=,")
        statement = shorter
    return statement


def _logical_lines(text: str, tokens: list[str], classes: str, statements: set[str]) -> str:
    """Python's line structure: line ends inside brackets go, indents and dedents come."""
    widths = [len(t.expandtabs()) - 1 for t in tokens if t[0] == "\n"]
    out, stack, depth, logical, indent, tries = ["^"], [0], 0, "", 0, {}
    for i, part in enumerate(classes.split("N")):
        if not part:
            continue
        if depth == 0:
            indent = widths[i - 1] if i else len(text) - len(text.lstrip(" \t"))
            logical = ""
        logical += part
        depth += part.count("(") + part.count("[") + part.count("{") - part.count(")") - part.count("]") - part.count("}")
        if depth > 0:
            continue
        depth = 0
        if indent > stack[-1]:
            stack.append(indent)
            out.append("+")
        while indent < stack[-1]:
            tries_open = tries.pop(len(stack), False)
            out.append("V" if tries_open else "-")
            stack.pop()
        if indent != stack[-1]:
            out.append("V")
        if tries.pop(len(stack), False) and logical[0] != "B":
            out.append("V")
        statements.add(_collapsed(logical, statements))
        if logical[0] == "T":
            tries[len(stack)] = True
        out.append(logical + ("H" if logical[-1] == ":" and logical[0] in "KFDCBTAm" else "Y" if logical[0] == "@" else "N"))
    if depth > 0:
        out.append(logical)
    if tries:
        out.append("V")
    return "".join(out) + "-" * (len(stack) - 1) + "$"


def _nested_statements(s: str, language: str) -> set[str]:
    """Statements of a language with braces, one level at a time from the innermost brackets outwards; see BAD_STATEMENTS for their marks."""
    out: set[str] = set()
    if language == "java":
        if re.search(r"R[i.]+\{", s):
            return out  # a module
        s = s.replace("R", "i")
    if language in ("java", "javascript", "typescript"):
        s = re.sub("[;N]+(?=[HB])", "", s)  # else may follow a statement of its own
    ends = re.compile(r";|(?<=[ins1-6epr])N" if language == "go" else r"[;N]" if language in ("javascript", "typescript") else ";")

    def braces(mark: str, inner: str) -> None:
        parts = ends.split(_VALUES.sub("n,", inner))
        parts = [p.replace("N", "") for p in parts]
        if language == "java":
            parts = [_ANNOTATION.sub("", p) for p in parts]
        out.update(mark + p for p in parts[:-1])
        out.add(("L" if mark == "B" and parts[-1] and language == "java" else mark) + parts[-1])

    def group(m: re.Match) -> str:
        inner = m[0][1:-1]
        before = m.string[m.start() - 1 : m.start()]
        if m[0][0] == "{":
            braces("S" if language == "go" and before == "S" else "B", inner)
            return "3"
        inner = _VALUES.sub("n,", inner)
        flat = inner.replace("N", "")
        if m[0][0] == "[":
            if language == "typescript":
                out.add("A" + flat)
            return "2"
        if language == "go":
            if before in ("I", "D"):
                return "1"
            if re.search(r"[ins1-4]N", inner):
                return "6"
        if language == "java":
            flat = _ANNOTATION.sub("", flat)
            if not re.search("[oak]", flat) and _JAVA_PARAMETERS.search(flat):
                out.add("P" + flat)
                return "4"
        elif language == "go" and _GO_PARAMETERS.search(flat):
            out.add("P" + flat)
            return "4"
        out.add("A" + flat)
        return "1"

    while True:
        shorter = _INNER.sub(group, s)
        if shorter == s:
            break
        s = shorter
    if not re.search(r"[()\[\]{}]", s):  # otherwise brackets are at fault already
        braces("T", s)
    return out


def lexed(text: str, language: str, classes: Classes) -> tuple[str, set[str]]:
    """The classes of a text's tokens between ^ and $, and its distinct statements."""
    tokens = token_pattern(language).findall(text)
    s = "".join(map(classes.__getitem__, tokens))
    statements: set[str] = set()
    if language == "python":
        return _logical_lines(text, tokens, s, statements), statements
    if language == "toml":
        depth, line = 0, ""
        for part in s.split("N"):
            line += part
            depth += part.count("[") + part.count("{") - part.count("]") - part.count("}")
            if depth <= 0:
                if line:
                    statements.add(_collapsed(line) if "=" not in line else line[: line.index("=") + 1] + _collapsed(line[line.index("=") + 1 :]))
                depth, line = 0, ""
        if line:
            statements.add(line)
    elif language == "json":
        while True:
            leaves = _LEAF.findall(s)
            statements.update(_MORE_ITEMS.sub(",v", x) if x[0] == "[" else _MORE_FIELDS.sub(",s:v", x) for x in leaves)
            if not leaves:
                break
            s2 = _LEAF.sub("v", s)
            if len(s2) >= len(s):
                break
            s = s2
        statements.add(s)
        s = "".join(map(classes.__getitem__, tokens))
    elif language in BAD_STATEMENTS:
        flat = s.replace("N", "")
        statements.update(x for x in re.split(r"[;}]|(?<=[){])", flat) if ":" in x)
        if flat[:3] == "{s:":
            statements.add("{s:")
    if language in ("go", "rust", "java", "javascript", "typescript"):
        statements |= _nested_statements(s, language)
    if language == "rust" and text.rstrip().rpartition("\n")[2].lstrip().startswith("///"):
        s += "V"
    return "^" + re.sub("N+", "N", s) + "$", statements


def _facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = {x: Classes(x) for x in LANGUAGES}
    for f in frames:
        out = {"path": [], "language": [], "indexed_at": [], "pairs": [], "brackets": [], "statements": []}
        for path, text, at in zip(f["path"], f["content"], f["indexed_at"], strict=True):
            language = language_of(path, text)
            pairs, brackets, statements = [], "", []
            if language in known and text is not None:
                s, found = lexed(text, language, known[language])
                pairs = sorted({a + b for a, b in set(zip(s, s[1:], strict=False))})
                brackets = _NO_BRACKET.sub("", s)
                for _ in range(3):
                    brackets = _CLOSED.sub("", brackets)
                statements = sorted(found)
            out["path"].append(path)
            out["language"].append(language)
            out["indexed_at"].append(at)
            out["pairs"].append(pairs)
            out["brackets"].append(brackets)
            out["statements"].append(statements)
        yield frame(out)


def lex_files(files: DataFrame) -> DataFrame:
    """path, language, pairs, brackets, statements of each path's row in force (the latest indexed_at; null is earliest)."""
    kept = files.where(F.col("path").isNotNull()).select("path", "content", F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).cast("long").alias("indexed_at"))
    facts = kept.mapInPandas(_facts, "path string, language string, indexed_at long, pairs array<string>, brackets string, statements array<string>")
    return facts.groupBy("path").agg(F.max_by(F.struct("language", "pairs", "brackets", "statements"), "indexed_at").alias("f")).select("path", "f.*")


def unparsable(files: DataFrame) -> DataFrame:
    """path, language, faulty of every path with a known language: files(path, content, indexed_at).

    Null content counts as no file and an empty one parses, except that JSON needs a value. Repeated rows count once. Other columns
    are ignored.
    """
    facts = cut(lex_files(files).where("language IS NOT NULL"))
    spark = files.sparkSession
    grammar = spark.createDataFrame([(x, p) for x in LANGUAGES for p in sorted(permissible_pairs(x))], "language string, pair string")
    pairs = facts.select("path", "language", F.explode("pairs").alias("pair"))
    strange = pairs.join(F.broadcast(grammar), ["language", "pair"], "left_anti").select("path")  # bounded by the grammars

    brackets = facts.where("brackets <> ''").select("path", F.posexplode(F.split("brackets", "")).alias("at", "b"))
    opens = F.col("b").isin("(", "[", "{")
    line = Window.partitionBy("path").orderBy("at")
    levelled = brackets.withColumn("after", F.sum(F.when(opens, 1).otherwise(-1)).over(line))
    levelled = levelled.withColumn("depth", F.when(opens, F.col("after")).otherwise(F.col("after") + 1))
    before = F.lag("b").over(Window.partitionBy("path", "depth").orderBy("at"))
    after = F.lead("b").over(Window.partitionBy("path", "depth").orderBy("at"))
    partner = F.translate(F.col("b"), "([{)]}", ")]}([{")
    unmatched = levelled.withColumn("before", before).withColumn("after", after)
    unmatched = unmatched.where(F.when(opens, ~F.col("after").eqNullSafe(partner)).otherwise(~F.col("before").eqNullSafe(partner))).select("path")

    said = facts.where(F.col("language").isin(list(BAD_STATEMENTS))).select("path", "language", F.explode("statements").alias("s"))
    broken = said.where(" OR ".join(f"(language = '{x}' AND s RLIKE r'{rule}')" for x, rule in BAD_STATEMENTS.items())).select("path")
    bad = strange.union(unmatched).union(broken).distinct().withColumn("faulty", F.lit(True))
    return facts.select("path", "language").join(bad, "path", "left").select("path", "language", F.coalesce("faulty", F.lit(False)).alias("faulty"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return unparsable(spread(table(spark, folder, "files").select("path", "content", "indexed_at"))).where("faulty").select("path")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of unparsable files by repository and language."""
    checked = unparsable(spread(table(spark, folder, "files").select("path", "content", "indexed_at")))
    return checked.groupBy(F.split("path", "/")[0].alias("repository"), "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("faulty").alias("faulty"), F.round(F.avg(F.col("faulty").cast("int")), 6).alias("rate")
    )
