import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import docpairs, encoding, mixing, provenance, ranking, spam, splitting

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = encoding.VOCABULARY.replace(".tiktoken", ".json")


# Encoding


@pytest.fixture(scope="module")
def tokenizer():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


TEXTS = [None, "", " ", "\n\n  \t", "Hello world's  end...", "naïve café — 東京タワー 😀😀", "a" * 5000, "=" * 777 + " x", "\u00a0\u2003x\u200b", "don't WE'LL they're 's", "<|endoftext|>", "é" * 300, "ab" * 2000 + "ba" * 99, "١٢٣ ½ ²", "word " * 20_000, "\r\n\r\n x", "xq" * 40, "Ā ā Ă"]


def test_ids_equal_the_tokenizers(spark, tokenizer):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "i int, text string").withColumn("ids", F.lit("clash"))
    got = encoding.encode_table(df).select("i", "ids").collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.ids == tokenizer.encode(TEXTS[r.i] or "", add_special_tokens=False).ids, repr(TEXTS[r.i])[:40]
    assert encoding.encode_table(df.limit(0)).count() == 0


def test_words_known_beforehand_change_nothing(spark, tokenizer):
    texts = ["the quxozzle of quxozzle zzyzx"] * 3 + ["quxozzles"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for most in (0, 1, 100):
        assert [r.ids for r in encoding.encode_table(df, max_words=most).orderBy("i").collect()] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_texts_ids_are_one_string_with_marks_for_open_words(spark, tokenizer):
    texts = ["the quxozzle of quxozzle", "quxozzle", " of", "", None]
    one = lambda t: ",".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids))
    encoder, df = encoding.Encoder(spark), spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [(r._numbers, r._open) for r in encoder.marked(df, "text", {}).orderBy("i").collect()]
    assert got == [(f"{one('the')},_,{one(' of')},_", [" quxozzle"] * 2), ("_", ["quxozzle"]), (one(" of"), []), ("", []), ("", [])]
    known = {" quxozzle".encode(): tokenizer.encode(" quxozzle", add_special_tokens=False).ids}
    assert encoder.marked(df, "text", known).where("i = 0").first()._numbers == one(texts[0])


def test_words_up_to_the_bound_are_folded_from_the_left(spark, tokenizer):
    words = ["q", "qq", "abababa", "aaaaaaa", "zqxjkvbw" * 5, "é" * 31, "x" * 255, "ab" * (encoding.LONG // 2), "a" * (encoding.LONG + 1)]
    got = encoding.Encoder(spark).fold(spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    assert {r.w: r.ids for r in got} == {w: tokenizer.encode(w, add_special_tokens=False).ids for w in words}


def test_decode_gives_the_text_back(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string")
    back = encoding.decode_table(encoding.encode_table(df), out="back")
    assert back.count() == len(TEXTS) - 1 and back.where("NOT text <=> back").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF, categories=("L", "N", "P", "S", "Zs")), max_size=60), min_size=1, max_size=20))
def test_random_texts(spark, tokenizer, texts):
    got = encoding.encode_table(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), max_words=len(texts[0])).orderBy("i")
    assert [r.ids for r in got.collect()] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# Splitting


def pieces(text, limit, overlap):
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    out, first = [], 1
    if len(lines) <= limit:
        return []
    while True:
        if first + limit - 1 >= len(lines):
            return [*out, (first, len(lines))]
        last = first + limit - 1
        for i in range(limit, limit // 2, -1):
            if not lines[first + i - 2].strip(" \t\r"):
                last = first + i - 1
                break
        out.append((first, last))
        first = max(last - overlap + 1, first + 1)


def test_splitting_equals_the_plain_rule(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.choice("ab"), "".join(rng.choice(["x\n", "\n", " \t\n", "\r\n", "y y\n"]) for _ in range(rng.randint(0, 90))) + rng.choice(["", "z"])) for i in range(120)]
    rules = [("a", 10, 2), ("b", 7, 0)]
    items = spark.createDataFrame(rows, "id string, symbol_kind string, content string").selectExpr("*", "5 _limit", "6 piece_no", "7 _lines")
    got = {}
    for r in splitting.split_items(items, spark.createDataFrame(rules, "symbol_kind string, max_lines int, overlap_lines int")).orderBy("piece_no").collect():
        got.setdefault(r.id, []).append((r.first_line, r.last_line))
        assert len(r.piece.split("\n")) == r.last_line - r.first_line + 1
    for key, kind, text in rows:
        _, limit, overlap = next(x for x in rules if x[0] == kind)
        assert got.get(key, []) == pieces(text, limit, overlap), repr(text)


def test_pieces_of_least_total_cost():
    rng = random.Random(4)

    def cheapest(empty, limit, overlap, first=1):
        n = len(empty)
        if first + limit > n:
            return limit - (n - first + 1)
        ends = range(1, limit + 1)
        cost = lambda e: limit - e + (0 if empty[first + e - 2] and e > limit // 2 else 0.5 * limit)
        return min(cost(e) + cheapest(empty, limit, overlap, max(first + e - overlap, first + 1)) for e in ends)

    for _ in range(60):
        empty, limit, overlap = [rng.random() < 0.3 for _ in range(rng.randint(1, 14))], rng.randint(2, 6), rng.randint(0, 2)
        got = splitting.best_pieces(np.array(empty), limit, overlap, cut=0.5, early_first=False)
        assert got[0][0] == 1 and got[-1][1] == len(empty) and all(b - a < limit for a, b in got)
        paid = sum(limit - (b - a + 1) + (0 if b == len(empty) or (empty[b - 1] and b - a + 1 > limit // 2) else 0.5 * limit) for a, b in got)
        assert paid == cheapest(empty, limit, overlap)


def test_splitting_edges(spark):
    rules = spark.createDataFrame([("k", 4, 9), ("one", 1, 0), ("n", None, None)], "symbol_kind string, max_lines int, overlap_lines int")
    rows = [("a", "k", "1\n2\n3\n4\n5\n6"), ("b", None, "x\n" * 9), ("c", "k", None), ("d", "none", "x\n" * 9), ("e", "one", "1\n2\n3"), ("f", "n", "x\n" * 9), ("g", "one", "x\n" * 3000)]
    got = {}
    for r in splitting.split_items(spark.createDataFrame(rows, "id string, symbol_kind string, content string"), rules).collect():
        got.setdefault(r.id, set()).add((r.piece_no, r.first_line, r.last_line))
    assert set(got) == {"a", "e", "g"}
    assert got["a"] == {(1, 1, 4), (2, 2, 5), (3, 3, 6)} and got["e"] == {(i, i, i) for i in (1, 2, 3)} and len(got["g"]) == 3000


# Ranking


def test_rank_aggregation_ignores_scale_and_outliers(spark):
    rows = [("q", f"c{i:02d}", float(i), 1000.0 * i, i / 1e6, -50.0 + i) for i in range(30)] + [("q", "loud", 1e12, 0.0, None, None), ("q", "c29", 1.0, None, None, None), ("q", "none", None, None, None, None), (None, "x", 1.0, 1.0, 1.0, 1.0), ("q", "nan", float("nan"), None, None, None)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, fff_score double, vector_score double, graph_score double, bm25_score double").selectExpr("*", "1 _g", "2 ordinal")
    got = {r.chunk_id: r for r in ranking.aggregate_ranks(hits).collect()}
    order = sorted(got, key=lambda c: got[c].ordinal)
    assert order[:5] == ["c29", "c28", "c27", "c26", "c25"] and len(order) == 33
    assert got["none"].significance == 1.0 and got["none"].mean_rank == 1.0
    assert ranking.aggregate_ranks(hits.limit(0)).count() == 0


def test_ties_share_their_rank(spark):
    rows = [("q", c, 1.0, 1.0) for c in "abcd"]
    got = ranking.aggregate_ranks(spark.createDataFrame(rows, "query_id string, chunk_id string, s double, t double"), signals=["s", "t"]).orderBy("ordinal").collect()
    assert [r.chunk_id for r in got] == list("abcd") and len({r.significance for r in got}) == 1 and got[0].mean_rank == 0.625


# Documentation


def first(text, language):
    got = next(docpairs.functions_of(text, language, True))
    return got[0], docpairs.clean_description(got[1])


@pytest.mark.parametrize(
    ("language", "text", "name", "description"),
    [
        ("python", '@d("def x(:")\nasync def f(a=":", b={1: 2}) -> "T":\n    # c\n    r"""Reads the file.\n\n    Args:\n        a: x\n    """\n    pass', "f", "Reads the file.\na: x"),
        ("python", "def f():\n    x = 1\n    'no documentation here at all'", "f", ""),
        ("python", "def f():\n    f'no {x} documentation'", "f", ""),
        ("python", "def f(): 'One line of text.'", "f", "One line of text."),
        ("rust", "/// Adds two.\n/// # Errors\n#[inline]\npub fn add<'a>(a: &'a str) -> u8 { // no\n 1 }", "add", "Adds two."),
        ("rust", '#[doc = "Adds \\"two\\"."]\nfn add() {}', "add", 'Adds "two".'),
        ("rust", "// plain comment here\nfn add() {}", "add", ""),
        ("go", "// Add adds.\n// More text.\nfunc (t *T) Add(a func(int) error) (int, error) {\n// inside\n}", "Add", "Add adds.\nMore text."),
        ("go", "//go:noinline\nfunc Add() {}", "Add", ""),
        ("java", "/**\n * Adds <b>two</b> numbers.\n * @param a\n * @return\n */\n@Override\npublic static <T> List<T> add(int a, Map<A, B> b) throws E {", "add", "Adds  two  numbers."),
        ("javascript", "/** Adds two. */\nexport default async function add(a = '(', { b }) {", "add", "Adds two."),
        ("typescript", "/* no doc form */\n  private async add<T>(a: Array<T>, b?: () => void): Promise<T> {\n", "add", ""),
    ],
)
def test_documentation_forms(language, text, name, description):
    assert first(text, language) == (name, description)


@pytest.mark.parametrize(("text", "name", "trivial"), [("", "f", True), ("TODO: document this", "f", True), ("Description to be written.", "f", True), ("The load flag function.", "load_flag", True), ("load_flag()", "load_flag", True), ("Opens the old file.", "f", False), ("See above for the documentation.", "f", True), ("No description field is used here.", "f", False), ("Auto-generated names are allowed here", "f", False)])
def test_trivial_descriptions(text, name, trivial):
    assert docpairs.is_trivial(text, name) is trivial


def test_functions_are_delimited(spark):
    files = spark.createDataFrame([("a.js", "/** Adds the two numbers. */\nfunction add(a, b) {\n  return '}' + a; // }\n}\n\n/** TODO */\nfunction no() {}\n"), ("b.py", "class A:\n    def f(self):\n        '''Gives the value back.'''\n        return {\n}\n\ndef g(): pass\n"), ("c.py", None), (None, "x"), ("d.rs", "")], "path string, content string")
    got = {(r.path, r.name, r.first_line, r.description, r.code.count("\n")) for r in docpairs.described_functions(files).collect()}
    assert got == {("a.js", "add", 2, "Adds the two numbers.", 2), ("b.py", "f", 2, "Gives the value back.", 2)}
    assert docpairs.described_functions(files.limit(0)).count() == 0


def test_chunks_of_other_kinds_and_nulls(spark):
    doc = "/// Adds the two numbers up.\nfn f() {}"
    rows = [("1", "a.rs", "fn", doc), ("2", "a.rs", "struct", doc), ("3", "a.rs", "function", None), (None, "a.rs", "fn", doc), ("4", "a.rs", "method", "/// " + "long " * 100_000 + "\nfn g() {}"), ("5", None, "fn", doc), ("6", "a.rs", None, doc)]
    got = docpairs.described_chunks(spark.createDataFrame(rows, "id string, relative_path string, symbol_kind string, content string").withColumn("language", F.lit(None).cast("string")).withColumn("name", F.lit(1)))
    assert {r.id for r in got.collect()} == {"1", "4"}


# Provenance


def kinds(spark, rows):
    df = spark.createDataFrame([(p, c, "2025-01-01") for p, c in rows], "path string, content string, at string").selectExpr("path", "content", "cast(at as timestamp) indexed_at", "1 data", "2 f")
    return {r.path: {k for k in ("generated", "minified", "data", "vendored") if r[k]} for r in provenance.provenance(df).collect()}


BODY = "".join(f"def part_{i}(value):\n    result = value * {i} + offset_{i}\n    return transform_{i}(result)\n\n" for i in range(12))


def test_provenance_kinds(spark):
    rows = [
        ("r1/lib/liba_x.py", BODY), ("r2/src/y.py", BODY), ("r3/src/liba_z.py", BODY.replace("part_3", "piece_3").replace("offset_7", "moved_7")), ("r4/own.py", BODY.replace("result", "outcome")),
        ("r1/gen.go", "/*\n * Licence text.\n */\n\n// Code generated by tool. DO NOT EDIT.\npackage x\n"), ("r1/maker.py", 'HEADER = "# Code generated by me. DO NOT EDIT."\n' + "x = compute()\n" * 5), ("r1/a_pb2.py", "x = 1\n"), ("r1/generated_reports/r.py", "x = f(1)\n"),
        ("r1/app.js", "var a=function(b){return b.c(1)};" * 60), ("r1/x.min.js", "a"), ("r1/data.py", "TABLE = [\n" + "    1, 2, 3, 4, 5, 6, 7,\n" * 60 + "]\n"), ("r1/third_party/l/q.rs", "fn x() {}"), ("r1/vendors/q.rs", "fn x() {}"),
        ("r1/conf.json", "[" + "1," * 600 + "1]"), ("r1/none.py", None), (None, "x"), ("r1/long.py", "y = g(1)\n" * 100_000),
    ]
    got = kinds(spark, rows)
    assert "r1/conf.json" not in got and None not in got
    assert {p: k for p, k in got.items() if k} == {
        "r1/lib/liba_x.py": {"vendored"}, "r2/src/y.py": {"vendored"}, "r3/src/liba_z.py": {"vendored"}, "r1/gen.go": {"generated"}, "r1/a_pb2.py": {"generated"},
        "r1/app.js": {"minified"}, "r1/x.min.js": {"minified"}, "r1/data.py": {"data"}, "r1/third_party/l/q.rs": {"vendored"},
    }


def edited_body(*parts: int) -> str:
    return "\n\n".join(p.replace("result", f"outcome_{i}") if i in parts else p for i, p in enumerate(BODY.split("\n\n")))


def test_copies_of_which_none_is_whole(spark):
    """Every copy edited, none in a directory for third-party code; files that only share a function or a common first word are no copies."""
    short = "def own_{0}(value):\n    first = value.open_{0}()\n    second = first.read_{0}(value)\n    return second.close_{0}()\n\n"
    own = lambda name: "".join(short.format(f"{name}{i}") for i in range(30))
    shared = "def shared_helper(value):\n    return [x.normalise() for x in value.parts() if x.is_ready()]\n\n"
    rows = [
        ("r1/src/moqano_x.py", edited_body(1, 2)), ("r2/app/deep/moqano_y.py", edited_body(4, 5)), ("r2/app/other.py", edited_body(7)), ("r1/src/keep_a.py", shared + own("a")), ("r2/src/keep_b.py", shared + own("b")),
        *[(f"r{i}/src/queue_{i}.py", own(f"q{i}") if i > 2 else edited_body(i).replace("transform", "convert")) for i in range(1, 8)],
        ("r1/a.py", "# imported from moqano at revision 051a7b4b, do not patch locally\nx = f(1)\n"), ("r1/b.go", "// Third-party: moqano library, (c) the moqano authors\npackage b\n"), ("r1/c.rs", "// copied from moqano, version 2.1\nfn c() {}\n"),
        ("r1/d.py", "# Rows are imported from the store at start; third-party: none.\nx = f(1)\n"), ("r1/e.py", 'NOTE = "# imported from moqano at revision 051a7b4b"\nx = f(1)\n'),
    ]
    assert {p for p, k in kinds(spark, rows).items() if k} == {"r1/src/moqano_x.py", "r2/app/deep/moqano_y.py", "r1/a.py", "r1/b.go", "r1/c.rs"}


def test_equal_repositories_are_one(spark):
    assert not any(kinds(spark, [("fork1/a.py", BODY), ("fork2/a.py", BODY)]).values())
    assert kinds(spark, []) == {}


# Mixing


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 40))) + f" {i}", rng.choice(["A", "a ", "b"])) for i in range(400)]
    rows += [(1000 + i, rows[i][1], "b") for i in range(30)] + [(2000, None, "a"), (2001, "", "a"), (2002, "unused text", "zz"), (2003, "no source", None), (None, "no id", "a"), (2004, "small source text", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_source", F.lit(1))
    goals = spark.createDataFrame([("a", 0.5, 2), ("B", 0.5, 1), ("nothing", 0.0, 3)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs, goals)
    report = {r.source: r for r in report.collect()}
    assert abs(report["a"].share - 0.5) < 0.01 and abs(report["b"].share - 0.5) < 0.01 and report["a"].met and report["b"].met
    got = used.collect()
    assert sum(r.tokens * r.repeats for r in got if r.source == "a") == report["a"].mixed_tokens
    assert all(1 <= r.repeats <= (2 if r.source == "a" else 1) for r in got) and len({r.doc_id for r in got}) == len(got)
    texts = {i: t for i, t, _ in rows}
    assert len({texts[r.doc_id] for r in got}) == len(got)


def test_mixture_out_of_reach_and_nested(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 5), "ab"[i % 2]) for i in range(200)] + [(999, "tiny", "c")], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 1), ("c", 0.2, 3), ("d", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mix(docs, goals, 1000)[1].collect()}
    assert report["a"].met and not report["c"].met and report["c"].mixed_tokens == 3 * report["c"].available_tokens and not report["d"].met and report["d"].share == 0
    small, large = ({r.doc_id for r in mixing.mix(docs, goals, n)[0].where("source = 'a'").collect()} for n in (300, 600))
    assert small < large
    assert mixing.mix(docs.limit(0), goals)[0].count() == 0


# Spam

PROSE = "The second index waits for the result because the memory is full. We agreed to write the value before the next run begins. "


def test_spam_kinds(spark):
    rng = random.Random(4)
    words = ["best price", "download now", "zorbo", "cheap tool", "fast grep"]
    stuffed = lambda sep: sep.join(rng.choice(words) for _ in range(150))
    link = lambda: f"[{rng.choice(words)}](https://a{rng.randint(0, 99)}.example/x/{rng.randint(0, 999)})"
    prose = lambda: " ".join(rng.choice(["The", "A", "Our", "That"]) + f" {rng.choice(['reader', 'index', 'queue', 'team'])} {rng.choice(['waits', 'looks', 'asks', 'works'])} for the {rng.choice(['file', 'node', 'page', 'row'])} {i} because it is {rng.choice(['late', 'full', 'new', 'old'])}." for i in range(12))
    spam_texts = [PROSE + "\n\n" + stuffed(sep) for sep in (", ", " - ", "\n", " | ", " ") for _ in range(6)] + ["\n".join("- " + link() for _ in range(25)) for _ in range(10)] + [" ".join("#" + rng.choice(words).replace(" ", "") for _ in range(120)) for _ in range(6)] + ["Looking for zorbo? Our zorbo is the zorbo you need. Get zorbo with zorbo today. " * 14 for _ in range(4)]
    ham = [prose() for _ in range(60)] + [prose() + "\n\nLinks\n" + "\n".join("- " + link() for _ in range(3)) for _ in range(8)] + ["import os\n\ndef run(x):\n    return os.path.join(x, 'a')\n" + "".join(f"\ndef g{i}(a):\n    return h(a, {rng.randint(0, 99)})\n" for i in range(8)) for _ in range(10)] + [prose() + "\n" + "\n".join(f"2025-01-{d:02d}T03:04:05Z WARN retry {d}" for d in range(1, 20)) for _ in range(6)]
    rows = [(i, t, "Host ", "s") for i, t in enumerate(spam_texts + ham)] + [(900, None, None, None), (901, "", "h", "s"), (902, " \n", "h", "s"), (903, "word " * 50_000 , "h", "s"), (None, "x", "h", "s")]
    got = {r.doc_id: r.spam for r in spam.spam_scores(spark.createDataFrame(rows, "doc_id long, text string, repo string, source string").withColumn("_p", F.lit(1)), host=["repo", "source"]).collect()}
    assert [i for i in range(len(spam_texts)) if got[i] <= 0.5] == []
    assert [i for i in range(len(spam_texts), len(spam_texts) + len(ham)) if got[i] > 0.5] == []
    assert got[900] < 0.1 and got[901] < 0.1 and got[902] < 0.1 and None not in got


def test_spam_of_one_class_or_none(spark):
    df = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    assert spam.spam_scores(df).first().spam < 0.5
    assert spam.spam_scores(df.limit(0)).count() == 0


def test_small_files_of_a_shared_directory_are_copies_too(spark):
    block = lambda seed: "\n".join(f"function f{seed}_{i}(a, b) {{ return a * {i} + b - {seed}; }}" for i in range(3))
    big = "\n\n".join(block(i) for i in range(4))
    rows = [(f"{repo}/{name}", text, "2025-01-01") for repo, own in (("ra", 50), ("rb", 60)) for name, text in (("util/x/big.js", big), ("util/x/tiny.js", "export * from './big';\n"), ("own/app.js", block(own) + "\n\n" + block(own + 1)))]
    rows.append(("rb/own/other.js", "export * from './big';\n", "2025-01-01"))
    df = spark.createDataFrame(rows, "path string, content string, at string").selectExpr("path", "content", "cast(at as timestamp) indexed_at")
    got = {r.path for r in provenance.provenance(df).where("vendored").collect()}
    assert got == {f"{repo}/util/x/{name}.js" for repo in ("ra", "rb") for name in ("big", "tiny")}


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("javascript", "/** Adds two numbers up front. */\nconst add = (a, b) => {\n  return a + b;\n};\n", ("add", "const add = (a, b) => {\n  return a + b;\n}")),
        ("javascript", "/** Doubles the given number x. */\nexport const dbl = async x => x * 2;\n", ("dbl", "export const dbl = async x => x * 2")),
        ("javascript", "/** Runs it in the background. */\nconst run = async function (q) { go(q); };\n", ("run", "const run = async function (q) { go(q); }")),
        ("typescript", "class A {\n  /** Handles every event it gets. */\n  private handle: F = (e: Event): void => { this.x(e); };\n}\n", ("handle", "private handle: F = (e: Event): void => { this.x(e); }")),
        ("java", "class Foo {\n  /** Makes a foo of size n. */\n  Foo(int n) { this.n = n; }\n}\n", ("Foo", "Foo(int n) { this.n = n; }")),
        ("rust", "fn f(x: u8) -> u8 {\n    //! Says what the thing does.\n    x // }\n}\nfn g() {}\n", ("f", "fn f(x: u8) -> u8 {\n    x // }\n}")),
        ("python", 'def f(a):\n    """Say what the thing does."""\n    return a\n\nx = 1\n', ("f", "def f(a):\n    return a")),
        ("python", "def g(): 'One line of real documentation.'; return 1\n", ("g", "def g(): ; return 1")),
    ],
)
def test_code_comes_without_documentation(language, text, want):
    found = [(name, docpairs.code_of(text, *place)) for name, raw, *place in docpairs.functions_of(text, language) if raw]
    assert [(name, code.rstrip()) for name, code in found] == [want]


def test_functions_of_states_in_force(spark):
    state = 'def f():\n    """{}"""\n    return 1\n'.format
    rows = [("a.py", state("What the old state did."), "2025-01-01"), ("a.py", state("What the new state does."), "2025-01-02"), ("a.py", state("What the new state does."), "2025-01-02"), ("b.py", state("No time is told here."), None)]
    df = spark.createDataFrame(rows, "path string, content string, at string").selectExpr("path", "content", "cast(at as timestamp) indexed_at")
    assert sorted(r.description for r in docpairs.described_functions(df).collect()) == ["No time is told here.", "What the new state does."]
