import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.glr import Grammar, recognise
from quarryline.llm.parsers import LANGUAGE_OF_SUFFIX, first_error, grammar
from quarryline.llm.syntax import first_errors

GOOD = {
    "javascript": ["a\n++b", "let x = a / b / c; var r = /ab+c/gi.test(s)", "async function* g(){ for await (const x of y) yield* x; }", "const {a, b: {c=1}, ...d} = e", "class A extends B { #p = 1; get y(){return this.#p} static { init() } }", "`a${b+`c${d}`}e`", "var a = b => ({}), c = async x => await x", "x = y\n(z)", "return 1", "({a} = b)", "while(1) if (a) b; else {c}", "#!/usr/bin/env node\nx", "const re = /[/]/"],
    "typescript": ["const x = y as unknown as Foo<Bar>;", "type A<T> = T extends string ? 'a' : never;", "type M = { readonly [K in keyof T]?: T[K] };", "abstract class A<T> extends B<T> implements C { constructor(private readonly x: number) { super(); } abstract f(): void; }", "import type { A } from 'x'", "let f = <T>(x: T): T => x", "let a = <const>[1]; { using b = c(); await using d = e; for (using x of y) {} let using = 1; using(a); using.b() }", "x = a < b || c > d", "export const d: Record<string,number>={a: 1}", "interface I { a: string\n b(): void }", "@Dec() class X { @In() y: string }"],
    "go": ["package a\nfunc f() {}\n", "package a\nimport \"x\"\nfunc (r *T) m(a, b int) (x int, err error) { for i := range 10 { if x, ok := m[k]; ok { continue } else if y { break } }; switch { case 1 < 2: return }; return }", "package a\ntype S struct { A int `json:\"a\"`; *B }\nvar y = map[string]T{\"a\": {1, 2}}\n", "package a\nfunc f() { defer m.Unlock(); go func() { x() }(); defer a[0](1, b...); go []f(x) }", "package a\nfunc M[T, U any](x []T, f func(T) U) []U { return nil }"],
    "java": ["class A { List<Map<String,int[]>> c = new ArrayList<>(); }", "record P(int x) { P { if (x<0) throw new E(); } }", "class A { void f() { int z = switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; if (o instanceof String t && t.length() > 3) {} Function<A,B> g = a -> a.b(); g = A::new; x >>>= 2; } }", 'class A { String s = """\n  hi "q"\n  """; }'],
    "rust": ["fn main() { let x = vec![1, 2]; println!(\"{}\", x[0]); }", "impl<T: Clone + 'static> Foo<T> for Bar<T> where T: Debug { fn f(&self) -> Result<Vec<T>, Box<dyn Error>> { let Some(x) = y else { return Err(z) }; match x { A::B { c, .. } => 1, 1..=5 | 7 => { 2 } _ if q => return Ok(3), }; Ok(()) } }", "#[derive(Debug)]\npub(crate) struct A<'a, T = u8>(&'a T);", "extern \"C\" { fn p(f: *const u8, ...) -> i32; }", "fn f() { if a == b { 1 } else { 2 }; s.iter().map(|x| x * 2).collect::<Vec<_>>() } /* a /* b */ c */"],
    "json": ['{"a": [1, -2.5e3, "x\\n", null, {}]}', "[]"],
    "python": ["match x:\n    case [1, *r] if r: pass\n    case {'a': b, **c}: pass\n    case A(b=1) | None: pass\n", "type X[T] = list[T]\n", "f'{a!r:>{w}} {b=}'\n", "with (open(a) as b, c): pass\n", "async def f(a, /, b, *, c=1, **d) -> int:\n    return [x async for x in y if x]\n", "lambda *a, b=1: (yield)\n", "x = y if z else w\nprint(*a, **b)\n", "try:\n    pass\nexcept* A as e:\n    pass\n"],
}
BAD = {
    "javascript": ["const x;", "let a: number = 1", "import a from 'b'", '{"a": 1, "b": 2}', "a b", "foo(;", "const x = {a: 1", "`abc", "function f() { return 1", "if (a)", "a = b +", "}", "<<<<<<< HEAD\nx"],
    "typescript": ["let x: = 3", "class A { foo( { }", "const x: Foo<Bar = 1", "export class A<T> {\n  private x: Map<string"],
    "go": ["func f() {}", "package a\nimport fmt", "package a\nfunc f() {", "package a\nx = 1", "package a\nfunc f()\n{\n}\n", "package a\nfunc f() { defer x }", "package a\nfunc f() { go func() {} }"],
    "java": ["class A {", "class A { int x }", "class A { void f() { a + b; } }", "class A { void f() { foo() } }", "fn main() {}"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "package a", "let x = 1;", "fn f() { a b }", "class A {}", "fn f(x) {}"],
    "json": ["{'a':1}", "[1,]", "// x\n{}", "NaN", "01", '"a\nb"', "{} {}"],
    "python": ["x = = 1", "def f(:\n  pass", "if x\n  y", "print 'x'", "  x\ny"],
}


@pytest.mark.parametrize("language", GOOD)
def test_accepts(language):
    assert {x: first_error(language, x) for x in GOOD[language] if first_error(language, x)} == {}


@pytest.mark.parametrize("language", BAD)
def test_rejects(language):
    assert [x for x in BAD[language] if not first_error(language, x)] == []


def test_first_error_is_where_the_text_stops_being_valid():
    assert first_error("python", "a = 1\nb = = 2\n")[0] == 2
    assert first_error("json", '{"a": 1')[1] == "<end>"
    assert first_error("json", None) is None and first_error("go", " \n") is None


def test_ambiguous_grammar_stays_polynomial():
    g = Grammar("s : s s | 'a' ;")
    assert recognise(g, ["a"] * 300) == -1
    assert recognise(g, ["a", "b"]) == 1
    assert recognise(g, []) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='{}[]",:01.e-\\u a\nntrue', max_size=25))
def test_json_equals_the_library(text):
    try:
        json.loads(text, parse_constant=lambda x: 1 / 0)
        good = True
    except (ValueError, ZeroDivisionError, RecursionError):
        good = False
    if text.strip():
        assert (first_error("json", text) is None) == good


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["x = 1", "if x:", "    y()", "else:", "    return", "def f(a, b=1):", "    pass", "for i in x:", "print(x[1:2])", "a = [", "]", "@d", "class A(B):", "x: int = 3", "import a.b as c", "lambda x: x", "", "# c"]), max_size=6))
def test_python_rejects_nothing_the_library_accepts(lines):
    text = "\n".join(lines) + "\n"
    try:
        ast.parse(text)
    except SyntaxError:
        return
    assert first_error("python", text) is None


def test_long_texts_and_deep_nesting():
    assert first_error("json", "[" * 5000 + "]" * 5000) is None
    assert first_error("javascript", "f(" * 300 + "x" + ")" * 300) is None
    assert first_error("go", "package a\n" + "var x = 1\n" * 20000) is None


def test_tables_are_complete():
    for language in set(LANGUAGE_OF_SUFFIX.values()):
        g = grammar(language)
        assert not [t for t in g.terminals if t.startswith("<") and t.endswith(">") and len(t) > 3]


def test_relation(spark):
    rows = [(1, "a.py", "x = 1", "k"), (2, "b.PY", "x = = 1", "k"), (3, "c.txt", "x = =", "k"), (4, "d.go", None, "k"), (5, "e.json", "", "k"), (2, "b.PY", "x = = 1", "k"), (6, None, "x", None)]
    df = spark.createDataFrame(rows, "file_id long, relative_path string, content string, language string")
    got = first_errors(df).where("syntax.line is not null").select("file_id").distinct().collect()
    assert [r[0] for r in got] == [2]
    assert first_errors(df.where("false")).count() == 0
    assert {r.file_id: r.syntax.language for r in first_errors(df).collect()} == {1: "python", 2: "python", 4: "go", 5: "json"}
