import json

import pytest

from quarryline.operators.elements import analyse, css_specificity, dependencies, elements, html_attributes, parse

CASES = {
    "javascript": ("import a, { b as c } from 'x';\nexport class A extends B {\n  m(x) {\n    if (x) { return 1 }\n  }\n}\nconst g = async (x) => {\n};\n", [("A", "class", 1, 6), ("m", "method", 2, 5), ("g", "function", 6, 8)], [("a", "x", None), ("b", "x", "c")]),
    "typescript": ("export interface I {\n  a: string;\n}\nexport type T = 'a';\n", [("I", "interface", 0, 3), ("T", "class", 3, 4)], []),
    "rust": ("use std::{fmt, io::{self, Read as R}};\n\n\npub fn a() {\n}\nstruct S;\n", [("a", "function", 3, 5), ("S", "struct", 5, 6)], [("fmt", "std::fmt", None), ("io", "std::io", None), ("Read", "std::io::Read", "R")]),
    "golang": ('package a\nimport (\n\t"fmt"\n\tx "a/b"\n)\nfunc (s *S) M(a int) error {\n}\nfunc F() {\n}\n', [("M", "method", 5, 7), ("F", "function", 7, 9)], [("fmt", "fmt", None), ("b", "a/b", "x")]),
    "java": ("package a;\nimport java.util.List;\npublic abstract class A {\n  private static final int X = 1;\n  public A(int x) {\n  }\n}\n", [("A", "class", 2, 7), ("X", "variable", 3, 4), ("A", "method", 4, 6)], [("a", "a", None), ("List", "java.util.List", None)]),
    "kotlin": ("import b.c as d\ndata class A(val x: Int)\nclass B {\n  fun g() {\n  }\n}\n", [("A", "class", 1, 2), ("B", "class", 2, 6), ("g", "method", 3, 5)], [("c", "b.c", "d")]),
    "c": ("#include <a.h>\n#define X 1\nstatic int f(int a) {\n  return a;\n}\n", [("X", "constant", 1, 2), ("f", "function", 2, 5)], [("a.h", "a.h", None)]),
    "cpp": ("using namespace std;\nclass A {\npublic:\n  int f() {\n  }\n};\n", [("A", "class", 1, 6), ("f", "function", 3, 5)], [("std", "std", None)]),
    "csharp": ("using X = A.B;\npublic class A {\n  public int P { get; set; }\n}\n", [("A", "class", 1, 4), ("P", "variable", 2, 3)], [("B", "A.B", "X")]),
    "swift": ("import UIKit\nclass A {\n  func f() -> Int {\n  }\n}\n", [("A", "class", 1, 5), ("f", "method", 2, 4)], [("UIKit", "UIKit", None)]),
    "ruby": ("require 'a'\nclass A\n  def f\n    if x\n    end\n  end\nend\n", [("A", "class", 1, 7), ("f", "method", 2, 6)], [("a", "a", None)]),
    "php": ("<?php\nuse C\\D as E;\nclass A {\n  private $p = 1;\n}\n", [("A", "class", 2, 5), ("p", "variable", 3, 4)], [("D", "C\\D", "E")]),
    "css": ("@import 'b.css';\n#a .b {\n  color: red;\n}\n", [("#a .b", "class", 1, 4)], [("b.css", "b.css", None)]),
    "sql": ("CREATE TABLE t (\n  id INT\n);\nSELECT * FROM a;\n", [("t", "class", 0, 3)], [("a", "a", None)]),
    "bash": ("source ./b.sh\nfoo() {\n  return 3\n}\n", [("foo", "function", 1, 4)], [("b.sh", "./b.sh", None)]),
    "dart": ("import 'dart:io';\nclass A extends StatelessWidget {\n}\nclass _AState extends State<A> {\n}\n", [("A", "class", 1, 3), ("_AState", "class", 3, 5)], [("dart:io", "dart:io", None)]),
    "nextjs": ("export default function HomePage() {\n}\nexport async function GET(req) {\n}\n", [("HomePage", "class", 0, 2), ("GET", "function", 2, 4)], []),
    "python": ("import os as o\nfrom .a import b\nclass A(B):\n    def m(self):\n        pass\n", [("A", "class", 2, 5), ("m", "function", 3, 5)], [("os", "os", "o"), ("b", ".a", None)]),
    "html": ("<!doctype html>\n<div id=\"m\" class=\"c d\">\n</div>\n<img src=x.png>\n", [("doctype", "module", 0, 1), ("m.c", "module", 1, 3), ("img", "variable", 3, 4)], [("x.png", "x.png", None)]),
    "generic": ("[main]\nkey = 1\n", [("main", "namespace", 0, 1), ("key", "variable", 1, 2)], []),
}


@pytest.mark.parametrize("key", CASES)
def test_parser(key):
    text, els, deps = CASES[key]
    e, d = parse(text, key)
    assert [x[:4] for x in e] == els
    assert [(x[0], x[2], x[3]) for x in d] == deps
    for x in e:
        json.loads(x[6])


def test_parsers_survive_anything():
    for key in (*CASES, "react", "nothing"):
        assert parse(None, key) == ([], []) == parse("", key)
        parse("\n" * 50 + "}}}{{{((( \x00 class", key)
        parse("x" * 200_000, key)


def test_visibility():
    e, _ = parse("class A\n  private\n  def g\n  end\n  public\n  def h\n  end\nend\n", "ruby")
    assert {x[0]: x[4] for x in e if x[5] == "def"} == {"g": "private", "h": "public"}
    e, _ = parse("class A {\n  int a() {\n  }\npublic:\n  int b() {\n  }\n};\n", "cpp")
    assert {x[0]: x[4] for x in e if x[1] == "function"} == {"a": "private", "b": "public"}
    e, _ = parse("func Abc() {\n}\nfunc abc() {\n}\n", "golang")
    assert [x[4] for x in e] == ["public", "private"]


def test_keywords_are_no_functions():
    e, _ = parse("function f() {\n  if (a) {\n  }\n  while (b) {\n  }\n}\n", "javascript")
    assert [x[0] for x in e] == ["f"]


def test_parameters_and_returns():
    m = json.loads(parse("pub fn f(a: u8, b: &mut Vec<u8>) -> Option<u8> {\n}\n", "rust")[0][0][6])
    assert [p["name"] for p in m["parameters"]] == ["a", "b"] and m["return_type"] == "Option<u8>"


def test_small_helpers():
    assert html_attributes("a=\"1\" b='2' c=3 disabled") == {"a": "1", "b": "2", "c": "3", "disabled": ""}
    assert css_specificity("#a.b p") == 111


def test_kinds_of_scripts():
    ts = "@Component({})\nexport class A {\n}\nconst o = {\n  run: async (x) => {\n  },\n  stop: function (y) {\n  },\n};\n"
    e, _ = parse(ts, "typescript")
    assert [(x[0], x[1], x[5]) for x in e] == [("@Component", "class", "decorator"), ("A", "class", "class"), ("o", "constant", "const"), ("run", "function", "object_method"), ("stop", "function", "object_method")]
    jsx = "import React, { useState as s } from 'react';\nimport Link from 'next/link';\nexport default function Card({ title, size = 2 }) {\n  const [n, setN] = useState(0);\n  useEffect(() => { go(n); }, [n]);\n  useEffect(() => {}, []);\n  return <Box><Link href='x'/></Box>;\n}\n"
    e, d = parse(jsx, "nextjs")
    m = json.loads(next(x for x in e if x[5] == "component")[6])
    assert m["props"] == ["size", "title"] and m["state_hooks"] == ["n"] and m["effect_hooks"] == ["n", "no dependencies"] and m["jsx_elements"] == ["Box", "Link"]
    h = json.loads(next(x for x in e if x[5] == "hook")[6])
    assert (h["hook_name"], h["hook_type"], h["is_destructured"]) == ("useState", "state", True)
    assert {(x[0], x[1], x[3]) for x in d if x[1] != "import"} == {("React", "react_import", None), ("useState", "react_import", "s"), ("Link", "nextjs_import", None)}


def test_shell_figures():
    e, d = parse("# git is only told of\ncurl x | sort\nPORT=80\nexport HOME_DIR=/a/b\nwords=(a b c)\nalias ll='ls -l'\nf() {\n  # no\n  if x; then\n    exit 2\n  fi\n}\n", "bash")
    m = {x[0]: json.loads(x[6]) for x in e}
    assert m["PORT"]["variable_type"] == "integer" and m["HOME_DIR"]["variable_type"] == "path" and m["words"]["array_elements"] == 3 and m["ll"]["alias_command"] == "ls -l"
    assert m["f"]["command_count"] == 5 and m["f"]["has_conditionals"] and not m["f"]["has_loops"] and m["f"]["exit_codes"] == ["2"]
    assert [x[0] for x in d if x[1] == "external_command"] == ["curl", "sort"]


def test_braces_in_shell_comments():
    e, _ = parse("f() {\n  # a } here\n  x=${y:-z}\n}\necho }\n", "bash")
    assert next(x[2:4] for x in e if x[0] == "f") == (0, 4)


def test_resources_of_style_sheets():
    _, d = parse("a {\n  background: url(x.png);\n  cursor: url('y.cur');\n}\n@import 'b.css';\n", "css")
    assert [(x[1], x[2]) for x in d] == [("image", "x.png"), ("resource", "y.cur"), ("import", "b.css")]


def test_short_data_files():
    assert [x[:4] for x in parse('{\n  "a": 1,\n  "b": {"c": 2}\n}', "generic", ".json")[0]] == [("a", "variable", 1, 2), ("b", "variable", 2, 3)]
    assert [x[0] for x in parse("a: 1\nb:\n  c: 2\n", "generic", ".yaml")[0]] == ["a", "b"]
    assert [(x[0], x[1]) for x in parse("<r>\n<x y='1'/>\n</r>", "generic", ".xml")[0]] == [("r", "class"), ("x", "class")]
    assert [x[0] for x in parse("FROM a\nRUN b\n", "generic", ".dockerfile")[0]] == ["FROM_0", "RUN_1"]
    assert parse("x = 1\n" * 60, "generic", ".xml")[0][0][5] == "key"


def test_sql_parameters_and_tests():
    m = json.loads(parse("CREATE FUNCTION f(a INT, IN b NUMERIC(3, 2)) RETURNS INT AS $$\nselect 1;\n$$;\n", "sql")[0][0][6])
    assert m["parameters"] == [{"name": "a", "type": "INT"}, {"name": "b", "type": "NUMERIC(3, 2)"}]
    m = json.loads(parse("import pytest\ndef test_e2e_login():\n    assert 1\n", "python")[0][0][6])
    assert (m["test_type"], m["test_framework"], m["assertions_count"]) == ("integration", "pytest", 1)


def test_a_registered_language_reaches_the_workers(spark):
    from quarryline.operators import languages as L

    try:
        L.register(L.Language("zig", (L._p("fn", "function", r"(?:pub[ \t]+)?fn[ \t]+(?P<name>\w+)"),), (L._i("import", r"const[ \t]+\w+[ \t]*=[ \t]*@import\(\"(?P<source>[^\"]+)\"\)"),)), suffixes=(".zig",))
        L.register(L.Language("words", (), parser=lambda t: ([(w, "variable", 0, 1, "public", "word", "{}") for w in t.split()], [])), languages=("plain",))
        df = spark.createDataFrame([(1, "a.zig", "unknown", 'const s = @import("std");\npub fn main() void {\n}\n'), (2, "b", "plain", "x y")], "id int, relative_path string, language string, content string").repartition(2)
        a = analyse(df)
        assert {(r.id, r.parser, r.pattern, r.name) for r in elements(a, "id").collect()} == {(1, "zig", "fn", "main"), (2, "words", "word", "x"), (2, "words", "word", "y")}
        assert [(r.id, r.import_type, r.source) for r in dependencies(a, "id").collect()] == [(1, "import", "std")]
    finally:
        for k in ("zig", "words"):
            L.LANGUAGES.pop(k, None)
        L.BY_SUFFIX.pop(".zig", None)
        L.BY_LANGUAGE.pop("plain", None)


def test_shell_columns(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import lookups

    got = spark.createDataFrame([("a=(x y  z)", "alias l='ls -l'", "true", "# c\n\n  ls\npwd")], "arr string, al string, v string, t string").select(
        lookups.array_size(F.col("arr")), lookups.alias_command(F.col("al")), lookups.variable_type(F.col("v")), lookups.command_count(F.col("t")), lookups.test_type(F.lit("test_perf_x"))
    )
    assert tuple(got.first()) == (3, "ls -l", "boolean", 2, "performance")


def test_relations(spark):
    df = spark.createDataFrame([(1, "a.py", "python", "import os\ndef f(): pass\n"), (2, "x.jsx", "unknown", "function A() {\n}\n"), (3, "b.yaml", "yaml", "a: 1"), (4, "c.py", "python", None)], "id int, relative_path string, language string, content string")
    a = analyse(df)
    assert {r.id: r.parser for r in a.collect()} == {1: "python", 2: "nextjs", 4: "python"}
    assert {(r.id, r.name) for r in elements(a, "id").collect()} == {(1, "f"), (2, "A")}
    assert [(r.id, r.source) for r in dependencies(a, "id").collect()] == [(1, "os")]
