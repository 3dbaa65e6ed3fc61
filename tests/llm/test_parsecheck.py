import ast
import json

import pytest

from quillon.llm.grammar import BAD_STATEMENTS, LANGUAGES, permissible_pairs
from quillon.llm.lexing import language_of
from quillon.llm.parsecheck import unparsable

GOOD = {
    "a.py": "#!/usr/bin/env python3\nimport os\nfrom . import x, y as z\n\n\n@deco(1)\nasync def f(a, *, b: int = 1, **k) -> dict[str, int]:\n    '''<<<<<<< HEAD\n=======\n'''\n    try:\n        x = [i async for i in a if i]\n    except (A, B) as e:\n        raise X('}') from e\n    finally:\n        pass\n    if a and not b: return None\n    elif c is not d:\n        z = lambda q, *r: q if q else {**k}\n    else:\n        del z[1:2, ::3]\n    with open(p) as f, g() as (h, i):\n        f.write(f\"{a!r:>{w}} {{}}\")\n    while True:\n        x, *y = 1, 2\n        match x:\n            case [1, _]:\n                break\n    return (yield)\n\nclass C(B, m=M):\n    a: int\n    b = ...\n",
    "b.json": '{"a": [1, -2.5e3, true, null, {"b": []}], "c": {}}',
    "c.toml": '# c\na = 1\n[t.x]\nb = "x[" # y\nc = [\n  1,\n  2, # z\n]\n[[u]]\nd.e = { f = 1, g = [2] }\nh = 2024-01-02T03:04:05Z\n',
    "d.rs": "//! doc\nuse a::{b, c as d};\n#[derive(Debug)]\npub struct P<'a, T: X + 'a> where T: Y { x: &'a str, y: Vec<Option<T>> }\nimpl<T> Q for P<'_, T> {\n    fn f(&mut self, a: u8) -> Result<(), E> {\n        let c = '{'; let s = r#\"}\"#; /* } */\n        if let Some(x) = a.b::<u8>().c()? { return Err(E::F { x, ..g }); }\n        for i in 0..=9 { s[i..].map(|y| y + 1).filter(|(a, _)| **a != b'x'); }\n        match a { 1 | 2 => {} x @ 3..=9 if x > 4 => h!(\"{}\", x), _ => unreachable!() }\n        loop { break 'o; }\n        Ok(())\n    }\n}\nmacro_rules! m { ($x:expr) => { $x } }\n",
    "e.go": 'package x\n\nimport (\n\t"fmt"\n\ty "z"\n)\n\nconst a, b = 1, \'{\'\n\ntype T struct {\n\tA int `json:"a"`\n\tm map[string][]*U\n}\n\nfunc (t *T) F(a ...int) (n int, err error) {\n\tif v, ok := t.m["}"]; ok && !v {\n\t\treturn\n\t}\n\tfor i := range a[:2] {\n\t\tgo func() { c <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t\tn++\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\treturn fmt.Sprintf(`%d`, n), nil\n}\n',
    "f.java": 'package a.b;\nimport static c.D.*;\n@A(x = "}")\npublic final class E<T extends F & G> extends H<T> implements I {\n  private static final int[] J = {1, 2};\n  @Override public <U> U k(List<? super T> l, int... m) throws N {\n    for (var o : l) { if (o instanceof P p && !p.q()) continue; }\n    char c = \'{\'; String s = """\n      }"""; Runnable r = () -> { }; var f = Foo::new;\n    try (var x = y()) { switch (z) { case 1: break; default: throw new Q("x"); } } catch (A | B e) { } finally { }\n    return a ? (U) b : null;\n  }\n  enum R { S, T }\n}\n',
    "g.js": 'import a, { b as c } from "d";\nexport default async function* e(f = 1, { g, h: i }, ...j) {\n  const k = `x${l}}`, re = /[}/]\\/{2}/g;\n  for (const m of n) o?.[p] ?? q;\n  if (r) s(); else t = u ? { v, [w]: 1, ...x } : [, y];\n  label: while (1) break label;\n  try { await z } catch { throw new A() }\n  return b => c\n}\nclass B extends C { static #d = 1; get e() { return this.#d } async f() {} }\n',
    "h.ts": "import type { A } from './a';\nexport interface B<T = unknown> extends C { readonly x?: number; [k: string]: T | undefined; m(a: string): void }\nabstract class D<T> implements B<T> {\n  private constructor(public x?: number, protected y: Array<Map<string, T[]>> = []) { super(); }\n  static async f<T extends keyof B>(this: void, a: T, ...b: (() => void)[]): Promise<T | null> {\n    const g = (a as unknown) as string; let h = <T,>(x: T): x is T => true;\n    return g!.length satisfies number;\n  }\n}\nenum E { A = 1, B }\ntype F = { [K in keyof E]?: E[K] } & G<'x'>;\ndeclare module 'm' { export const n: typeof o; }\n",
    "i.md": "<<<<<<< HEAD\nany ( text",
    "j": "#!/usr/bin/env python3\nprint('x')\n",
    "k.unknown": "((((",
}

BAD = {
    "open.py": "def f(a):\n    return (a\n", "colon.py": "while not", "empty_block.py": "if a:\n", "dedent.py": "if a:\n        b\n    c\n", "string.py": 'x = "abc\n', "doc.py": '"""abc\n', "mix.py": "x = [1, 2)\n",
    "conflict.py": "a = 1\n<<<<<<< HEAD\nb = 2\n=======\nb = 3\n>>>>>>> x\n", "half.py": "a = 1\n=======\nb = 2\n", "try.py": "try:\n    a\nb\n", "head.py": "foo(x) as y:\n    z\n", "java.py": "package a;\npublic class B { }\n",
    "tail.json": '{"a": [1, 2', "pair.json": '{"a" 1}', "comma.json": "[1, 2,]", "array.json": '["a": 1]', "empty.json": "", "toml.json": "a = 1",
    "open.toml": "a = [1,", "key.toml": "abc", "str.toml": 'a = "x', "json.toml": '{\n "a": 1\n}',
    "tail.rs": "fn f() {\n    let a = 1;\n", "go.rs": "package x\n\nfunc f() {\n}\n", "note.rs": "/* fn f() {}", "doc.rs": "fn f() {}\n/// dangling\n", "json.rs": '{"a": 1}',
    "tail.go": "package x\n\nfunc f() {\n\tif a {\n", "head.go": "func f() {\n}\n", "py.go": "def f(x):\n    return x\n", "mark.go": "package x\n\n>>>>>>> y\n", "tail.java": "class A { void f() { int x = ", "js.java": "function f(a){return a}\n", "py.java": "import os\ndef f(): pass\n",
    "tail.js": "function f() { return [1,", "html.js": "<!DOCTYPE html>\n<html></html>\n", "ts.js": "function f(a: string): void { }\n", "json.js": '{"a": 1}', "tick.js": "const a = `x", "rust.ts": "fn f(a: &str) -> u8 { a }\n", "tail.ts": "interface A { x: number",
    "md.py": "# Title\n\nSome words of text here.\n",
}


def check(spark, files):
    rows = [(p, c, "2025-01-01") for p, c in files.items()]
    df = spark.createDataFrame(rows, "path string, content string, at string").selectExpr("path", "content", "cast(at as timestamp) indexed_at", "1 faulty", "2 pairs")
    return {r.path: r.faulty for r in unparsable(df).collect()}


def test_valid_files_pass(spark):
    ast.parse(GOOD["a.py"])
    json.loads(GOOD["b.json"])
    got = check(spark, GOOD)
    assert [p for p, bad in got.items() if bad] == []
    assert set(got) == set(GOOD) - {"k.unknown"}


def test_damaged_files_fail(spark):
    got = check(spark, BAD)
    assert [p for p in BAD if not got[p]] == []


STATEMENTS = {
    "decl.java": "class A { void f() { int a = b\n int c = d; } }", "calls.java": "class A { void f() { foo()\n bar(); } }", "args.java": "class A { void f() { int x = g(a b); } }", "params.java": "class A { void f(int a int b) { } }",
    "last.java": "class A { void f() { x = g() } }", "args.go": "package x\n\nfunc g() {\n\tf(a b)\n}\n", "head.go": "package x\n\nfunc f {\n}\n", "name.go": "package x\n\nfunc {\n}\n", "equals.go": 'package x\n\nvar a []string{"b"}\n',
    "head.rs": "fn f {\n}\n", "let.rs": "fn f() {\n    let a = b()\n    let c = 1;\n}\n", "impl.rs": "struct A;\nimpl A;\n", "line.ts": "foo() bar()\n", "args.ts": "foo(a b);\n", "head.ts": "function f {\n}\n", "type.ts": "function f: void {\n}\n",
}
FRAGMENTS = {
    "end.go": "package x\n\nfunc f() {\n\tx := 5 +\n}\n", "else.go": "package x\n\nfunc f() {\n\telse {\n\t}\n}\n", "func.go": "package x\n\nfunc f() {\n\tfunc () {\n\t}\n}\n", "top.go": "package x\n\nx := 5\n", "java.go": "package a.b;\npublic class X { void f() { } }\n",
    "return.java": "class A { int f() { return 5 } }", "else.java": "class A { void f() { else { x(); } } }", "try.java": "class A { void f() { try { x(); } } }", "catch.java": "class A { void f() { catch (E e) { } } }", "for.java": "class A { void f() { for (int i = 0; i < 3) { } } }",
    "const.js": "const x;\n", "line.js": "foo() bar()\n", "try.js": "try { x() }\ny()\n", "function.js": "function (a) {}\n", "case.js": "case 1: x()\n", "else.js": "else { x() }\n",
    "const.ts": "const x;\n", "try.ts": "try { x() }\n", "function.ts": "function (a) {}\n", "case.ts": "case 1: x()\n", "python.ts": "class A:\n    def f(self):\n        return 1\n", "java.ts": "package a.b;\npublic class X { void f() { } }\n",
    "arrow.rs": "fn f() -> {\n}\n", "else.rs": "fn f() {\n    else {\n    }\n}\n", "number.py": "1 = x\n", "args.py": "f(a=1, 2)\n", "defaults.py": "def f(a=1, b): pass\n",
}
WHOLE = {
    "a.py": "f(a=1, *b, **c)\ndef g(a, *, b=1, c): pass\nh(key=lambda x, y: x, z=(w := 1, 2))\nif (n := f(1)) and n: pass\nprint(a := 1, 2) if x == 1 else y[1] == 2\n",
    "a.js": "var x\nlet y, z\nfor (const a of b) c()\ntry { d() }\ncatch (e) { f() }\nfinally { g() }\nif (h) { i() }\nelse { j() }\ndo { k() } while (l)\nclass M { catch() { } finally() { } static n = 1 }\nexport default function () { }\nconst o = { p() { }, q: 1, try: 2 }\nswitch (r) { case 1: s(); break; default: t() }\n;(function () { })()\n",
    "a.ts": "try { d() }\ncatch { f() }\ndeclare const x: number\nexport const enum A { B }\nconst c: D = e\nfor (const [f, g] of h) { }\nif (a) { b() }\nelse if (c) { d() }\n",
    "a.java": "class A { void f() throws B { try { c(); } catch (D d) { } finally { e(); } try (var g = h(); var i = j()) { } catch (K k) { } do { l(); } while (m); if (n) { } else if (o) { } else { } for (int p = 0; p < 3; p++) { } for (;;) { } } }",
    "a.go": "package x\n\nfunc f() {\n\tif a {\n\t} else if b {\n\t} else {\n\t}\n\tfunc() {\n\t}()\n\tx := y +\n\t\tz\n\tfor i := 0; i < 3; i++ {\n\t}\n}\n",
    "a.rs": "fn f() -> u8 { let Some(x) = y else { return 1 }; if a { b() } else { loop { } } }\nfn g(h: fn(u8) -> u8) -> impl Fn(u8) -> u8 { move |x| { x } }\n",
}
SOUND = {
    "a.java": "@A(b = 1) class C { int d = (int) e; @F G h(I i, J<K> j) throws L { if (m) n(); for (O o : p) { q -> r(); } Object s = t instanceof U u ? (V) w : new X<>(y) { int z; }; return (a, b) -> c; } }",
    "b.java": "enum A { B(1), C(2); final int d; A(int e) { this.d = e; } record F(int g, H h) { } int i(J j) { switch (j) { case K k: break; default: return 1; } } }",
    "a.go": "package x\n\nimport \"y\"\n\ntype A interface {\n\tB(c int, d ...string) (e error)\n}\n\nvar f = func(g int) h { return h{1} }\n\nfunc (a *A[T]) I(j func(k int) l, m []n) (o, p error) {\n\tgo func(q r) { s() }(t)\n\tvar u v = w\n\tx := []struct{ y int }{{1}}\n\tz(a,\n\t\tb,\n\t)\n\treturn\n}\n",
    "a.rs": "pub(crate) fn a<T>(b: fn(c) -> d) -> impl E { let f = if g { 1 } else { 2 }; match j { K(l) if m => 1, _ => 2 } }\nimpl<T> N for O {}\nstatic P: &[u8] = &[1];\n#[q(r)]\nconst S: Box<dyn T + U> = v!(w, x);\n",
    "a.ts": "class B { get c() { return 1 } e: F }\nfoo()\nbar()\nfunction g(h: I[], j?: K): l is M { return n as O }\nconst [p, q] = r\nfor (const [s] of t) u((v: W): X => ({ y }))\ndeclare module 'z' { function a(): b }\n",
}


def test_statements_that_only_hold_permissible_pairs(spark):
    got = check(spark, STATEMENTS | SOUND)
    assert [p for p in STATEMENTS if not got[p]] == []
    assert [p for p in SOUND if got[p]] == []


def test_fragments_fail_and_their_like_pass(spark):
    got = check(spark, FRAGMENTS | WHOLE)
    assert [p for p in FRAGMENTS if not got[p]] == []
    assert [p for p in WHOLE if got[p]] == []


def test_row_in_force_nulls_and_empty_table(spark):
    rows = [("a.py", "x = (", "2025-01-01"), ("a.py", "x = 1", "2025-01-02"), ("a.py", "x = 1", "2025-01-02"), ("b.py", "x = 1", None), ("b.py", "(", "2025-01-01"), ("c.py", None, "2025-01-01"), (None, "(", "2025-01-01"), ("d.py", "", "2025-01-01"), ("e.rs", "fn f() { " + "g(); " * 200_000 + "}", "2025-01-01")]
    df = spark.createDataFrame(rows, "path string, content string, at string").selectExpr("path", "content", "cast(at as timestamp) indexed_at")
    assert {r.path: r.faulty for r in unparsable(df).collect()} == {"a.py": False, "b.py": True, "c.py": False, "d.py": False, "e.rs": False}
    assert unparsable(df.limit(0)).count() == 0


def test_python_agrees_with_its_parser(spark):
    base = GOOD["a.py"]
    files = {f"t{i}.py": base[:i] for i in range(0, len(base), 7)}

    def parses(text):
        try:
            ast.parse(text)
        except SyntaxError:
            return True
        return False

    got = check(spark, files)
    missed = [p for p, c in files.items() if got[p] != parses(c)]
    assert len(missed) <= 0.04 * len(files), missed


@pytest.mark.parametrize("language", LANGUAGES)
def test_grammar_is_bounded(language):
    assert 0 < len(permissible_pairs(language)) < 3000
    assert all(len(p) == 2 for p in permissible_pairs(language))
    assert set(BAD_STATEMENTS) <= set(LANGUAGES)


def test_language_of():
    assert [language_of(*x) for x in (("a/b.PY", ""), ("x", "#!/usr/bin/python3\n"), ("x", "#!/bin/node\r\n"), ("x", None), (None, ""), (".rs", ""), ("a.b/c", ""))] == ["python", "python", "javascript", None, None, None, None]
