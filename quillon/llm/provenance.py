"""Source files that were not written by hand where they lie (problem 6).

* Vendored: a Merkle tree over repositories, directories, files and blocks (paragraphs of code). A node's hash follows from its
  children's hashes, bottom-up. A file or directory that occurs in two unrelated repositories is a copy; so is a file in a
  directory for third-party code or with a header that says so, a file a good part of whose blocks occurs under the same library
  name in an unrelated repository, and a file that bears the name of a library found in one of these ways and shares a block
  with it. Repositories with equal roots are one repository.
* Generated: a header comment that says a tool made the file, in one of several languages; a name or directory that only
  generators use.
* Minified: scripts with hardly any white space on long lines, or so named.
* Data: code that is hardly anything but literals behind a declaration.

Everything but the tree is a row-wise expression; only hashes and flags are shuffled, never content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut, spread
from quillon.sources.tables import table

#: Statements of generators and of vendored copies in header comments, lower case.
GENERATED_HEADER = (
    r"code generated (?:by|from)|@generated\b|<auto-?generated|auto-?generated (?:file|by|code|from|with|using)|autogenerated\b|generated (?:by|from|with|using|automatically) |"
    r"automatically (?:generated|produced|created|written)|(?:produced|created|written|built) automatically|machine[- ](?:written|generated|made|produced)|"
    r"output of [^\n]* edit [^\n]*instead|(?:do not|don.t) (?:edit|modify)[^\n]{0,12} by hand|do not edit|changes will be lost|manual (?:edits|changes) (?:are|will be) (?:overwritten|lost)|"
    r"(?:maschinell|automatisch) (?:erzeugt|erstellt|generiert)|(?:erzeugt|generiert) von|nicht (?:von hand )?(?:bearbeiten|ändern)|"
    r"(?:fichier|code) (?:produit|généré|créé|écrit)|généré (?:par|automatiquement)|ne pas (?:modifier|éditer)|"
    r"(?:archivo|fichero|código) (?:generado|producido|creado|escrito)|generado (?:por|automáticamente)|no (?:editar|modificar)"
)
VENDORED_HEADER = (
    r"vendored (?:copy|from|version)|(?:copied|imported|vendored) (?:verbatim |unchanged )?from upstream|third[- ]party(?: copy|:[^\n]*\b(?:library|project|package|authors)\b)|"
    r"(?:copied|imported|taken|pulled|synced|extracted) (?:verbatim |unchanged )?from [^\s,]+,? (?:at |@ ?)?(?:revision|rev\.?|version|commit|tag|release|v?\d+\.\d)"
)
GENERATED_NAME = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|\.gen\.\w+|\.g\.(?:ts|dart|cs)|\.generated\.\w+|[a-z0-9_]Grpc\.java|_generated\.\w+)$"
GENERATED_DIRECTORY = r"/(?:__generated__|generated|autogen|auto-generated|gen|target/(?:debug|release))/"
VENDOR_DIRECTORY = r"/(?:vendor|third_party|third-party|thirdparty|3rdparty|_vendor|node_modules|bower_components|external|Godeps|deps/[^/]+-src)/"
MINIFIED_NAME = r"\.(?:min|bundle)\.(?:js|css|mjs)$"
CODE = ["py", "rs", "ts", "js", "go", "java", "mjs", "css", ""]

#: Characters of text that a shared node must have, and of a block to be compared.
NODE_SIZE, BLOCK_SIZE = 240, 60
#: Share of a file's block characters that must lie under its library's name in an unrelated repository too.
SHARED_WEIGHT = 0.25


def header_comment(content: Column) -> Column:
    """The comment and empty lines a text begins with, as one lower-case line each."""
    lines = F.transform(F.split(content, "\n", -1), lambda x: F.trim(x))
    code = F.transform(lines, lambda x: ~x.rlike(r"^(?:\r?$|//|#|/?\*|--|;|<!--)"))
    at = F.array_position(code, True)
    return F.lower(F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(lines), "\n"))


def blocks(content: Column) -> Column:
    """array<struct<h, n>>: hash and length of a text's paragraphs; comment-only ones and short ones aside."""
    parts = F.split(F.regexp_replace(F.regexp_replace(content, "\r", ""), r"(?m)^[ \t]+|[ \t]+$", ""), r"\n\n+")
    own = F.filter(parts, lambda x: (F.length(x) >= BLOCK_SIZE) & ~x.rlike(r"^(?:/\*|#[^\[]|//)[^\n]*(?:\n ?(?:\*|#|//)[^\n]*)*\z"))
    return F.transform(own, lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))


def _features(path: Column, content: Column) -> list[Column]:
    size = F.greatest(F.length(content), F.lit(1))
    solid = F.length(F.translate(content, " \t\r\n", ""))
    lines = F.greatest(F.length(content) - F.length(F.translate(content, "\n", "")) + 1, F.lit(1))
    bare = F.translate(F.regexp_replace(content, r""""[^"\n]*"|'[^'\n]*'|\b0[xX][0-9a-fA-F]+\b|\b[0-9][0-9.eE]*\b""", ""), " \t\r\n,[](){}-+", "")
    head = header_comment(content)
    script = path.rlike(r"\.(?:js|mjs|css)$")
    return [
        (head.rlike(GENERATED_HEADER) | path.rlike(GENERATED_NAME) | path.rlike(GENERATED_DIRECTORY)).alias("generated"),
        (script & (path.rlike(MINIFIED_NAME) | ((size / lines >= 80) & (1 - solid / size < 0.09)))).alias("minified"),
        ((solid >= 500) & (F.length(bare) < 0.12 * solid) & bare.contains("=")).alias("data"),
        (head.rlike(VENDORED_HEADER) | path.rlike(VENDOR_DIRECTORY)).alias("vendor_mark"),
        blocks(content).alias("blocks"),
        F.xxhash64(F.translate(content, " \t\r\n", "")).alias("whole"),
    ]


def _node(children: DataFrame, key: list[str]) -> DataFrame:
    """One hash per key over children with (_hash, _size), in no order and with map-side sums."""
    low, high = F.col("_hash").bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned("_hash", 33)
    summed = children.groupBy(*key).agg(F.sum(low).alias("a"), F.sum(high).alias("b"), F.count(F.lit(1)).alias("c"), F.sum("_size").alias("_size"))
    return summed.select(*key, F.xxhash64("a", "b", "c").alias("_hash"), "_size")


def shared_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """path of every file that lies under a node found in unrelated repositories, and _root of each _repo. files: path, _hash, _size."""
    repo = F.split("node", "/")[0]
    level = cut(files.select(F.col("path").alias("node"), "_hash", "_size", F.size(F.split("path", "/")).alias("_depth")))
    nodes, inner = level.drop("_depth"), level.drop("_depth").limit(0)
    depth = level.agg(F.max("_depth")).first()[0] or 0
    for d in range(depth - 1, 0, -1):
        children = inner.union(level.where(F.col("_depth") == d + 1).drop("_depth"))
        parent = F.array_join(F.slice(F.split("node", "/"), 1, d), "/").alias("node")
        inner = cut(_node(children.select(parent, "_hash", "_size"), ["node"]))
        if d > 1:
            nodes = nodes.union(inner)
    roots = inner.select(F.col("node").alias("_repo"), F.col("_hash").alias("_root"))
    spread = nodes.withColumn("_repo", repo).join(roots, "_repo").where(F.col("_size") >= NODE_SIZE)
    wide = spread.groupBy("_hash").agg(F.min("_root").alias("l"), F.max("_root").alias("m")).where("l <> m").select("_hash")
    copies = spread.join(wide, "_hash", "left_semi").select("node").distinct()
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("path", "/")), F.lit(2))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    return files.select("path", F.explode(above).alias("node")).join(copies, "node", "left_semi").select("path").distinct(), roots


def shared_blocks(named: DataFrame, roots: DataFrame) -> DataFrame:
    """path of every file with enough blocks that unrelated repositories have under the same library name. named: path, _lib, _hash, _size.

    A first word that most of its files bear without such blocks is an ordinary word and no library's name.
    """
    owned = named.withColumn("_repo", F.split("path", "/")[0]).join(roots, "_repo")
    wide = owned.groupBy("_lib", "_hash").agg(F.min("_root").alias("l"), F.max("_root").alias("m")).where("l <> m").select("_lib", "_hash", F.lit(True).alias("_wide"))
    heavy = F.coalesce((F.col("_shared") >= NODE_SIZE) & (F.col("_shared") >= SHARED_WEIGHT * F.col("_all")), F.lit(False))
    weights = named.join(wide, ["_lib", "_hash"], "left").groupBy("path", "_lib").agg(F.sum("_size").alias("_all"), F.sum(F.when(F.col("_wide"), F.col("_size"))).alias("_shared"))
    weights = cut(weights.select("path", "_lib", heavy.alias("_heavy")))
    libraries = weights.groupBy("_lib").agg(F.avg(F.col("_heavy").cast("int")).alias("_part")).where("_part >= 0.5").select("_lib")
    return weights.where("_heavy").join(libraries, "_lib", "left_semi").select("path")


def provenance(files: DataFrame) -> DataFrame:
    """path, generated, minified, data, vendored of every code file in force (the latest indexed_at of its path; null is earliest).

    Null content counts as empty; an empty file is judged by its path. Repeated rows count once. Markdown, JSON and TOML are no
    code and have no row. Other columns are ignored.
    """
    rows = files.where(F.col("path").isNotNull()).select("path", F.coalesce("content", F.lit("")).alias("content"), "indexed_at")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    rows = rows.where(extension.isin(CODE)).select("path", F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).alias("at"), F.struct(*_features(F.col("path"), F.col("content"))).alias("f"))
    facts = cut(rows.groupBy("path").agg(F.max_by("f", "at").alias("f")).select("path", "f.*"))

    parts = facts.select("path", F.explode("blocks").alias("b")).select("path", F.col("b.h").alias("_hash"), F.col("b.n").cast("bigint").alias("_size"))
    small = facts.where(F.size("blocks") == 0).select("path", F.col("whole").alias("_hash"), F.lit(0).cast("bigint").alias("_size"))  # in the tree, but no start of a match
    copies, roots = shared_nodes(_node(parts, ["path"]).union(small))
    library = F.lower(F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), r"^([A-Za-z0-9]{3,}?)[_.-]", 1))
    named = parts.withColumn("_lib", library).where("_lib <> ''")
    marked = cut(facts.select("path").where("vendor_mark").union(copies).union(shared_blocks(named, roots)).distinct())

    known = named.join(marked, "path", "left_semi").select("_lib", "_hash").distinct()
    edited = named.join(marked, "path", "left_anti").join(known, ["_lib", "_hash"], "left_semi").select("path").distinct()
    vendored = marked.union(edited).distinct().withColumn("vendored", F.lit(True))
    return facts.select("path", "generated", "minified", "data").join(vendored, "path", "left").withColumn("vendored", F.coalesce("vendored", F.lit(False)))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = provenance(spread(table(spark, folder, "files").select("path", "content", "indexed_at")))
    return found.where("generated OR minified OR data OR vendored").select("path")


def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each kind by repository; a file may be of several."""
    found = provenance(spread(table(spark, folder, "files").select("path", "content", "indexed_at")))
    kinds = ["generated", "minified", "data", "vendored"]
    by_hand = ~(F.col("generated") | F.col("minified") | F.col("data") | F.col("vendored"))
    return found.groupBy(F.split("path", "/")[0].alias("repository")).agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(F.col(k)).alias(k) for k in kinds], F.count_if(by_hand).alias("by_hand")
    )
