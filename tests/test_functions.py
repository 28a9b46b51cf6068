from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import text as T
from quarryline.operators import chunking


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int' if isinstance(v, int) else 'double'}" for k, v in cols.items()))
    return df.select(col).first()[0]


def test_extension_and_language(spark):
    rows = [("a/b.PY", ".py"), ("x.d.ts", ".ts"), (".bashrc", ""), ("a/.env.local", ".local"), ("Makefile", ""), ("a.b/c", ""), (None, None)]
    got = spark.createDataFrame([(p,) for p, _ in rows], "p string").select(P.extension(F.col("p"))).collect()
    assert [g[0] for g in got] == [e for _, e in rows]
    assert one(spark, P.language(F.col("p")), p="a/b.GO") == "golang"
    assert one(spark, P.language(F.col("p")), p="a/b.zig") == "unknown"


def test_exclude_globs(spark):
    cases = {"a/node_modules/b.js": True, "node_modules": True, "a/latest.py": True, "a/b.log": True, "a/.env.local": True, "a/x.py": False, "a/builder/x.py": False, "a/build/x.py": True, "deep/a/yarn.lock": True}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", P.excluded(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == cases
    assert one(spark, P.excluded(F.col("p"), ()), p="node_modules/a") is False
    other = ("src/*", "*/a/*.py", "a/b", "*/a/b/*", "*/x*/*")
    for p in ("src/a.py", "a/c.py", "a/b", "q/a/b/c", "x1/y"):
        assert one(spark, P.excluded(F.col("p"), other), p=p) is False
    assert one(spark, P.excluded(F.col("p"), ("*/x*/*",)), p="a/x*/b") is True


def test_include_globs(spark):
    assert one(spark, P.included(F.col("p"), ("*.py",)), p="a/b.py") is True
    assert one(spark, P.included(F.col("p"), ("src/*.py",)), p="x/src/b.py") is True
    assert one(spark, P.included(F.col("p"), ("src/*.py",)), p="src/x/b.py") is False
    assert one(spark, P.included(F.col("p"), None), p="any") is True


def test_text_sniff(spark):
    f = P.looks_text(F.col("p"), F.col("c"))
    assert one(spark, f, p="a.exe", c="x") is False
    assert one(spark, f, p="a.py", c="\x00") is True
    assert one(spark, f, p="a.bin2", c="a\x00b") is False
    assert one(spark, f, p="a", c=None) is True
    assert one(spark, f, p="a", c="é" * 255 + "a\x00") is False and one(spark, f, p="a", c="é" * 256 + "\x00") is True


def test_tokens_and_truncate(spark):
    assert one(spark, T.count_tokens(F.col("c")), c=None) == 0
    assert one(spark, T.count_tokens(F.col("c")), c="abcde") == 2
    assert one(spark, T.count_tokens(F.col("c"), lambda t: len(t.split())), c="a b c") == 3 and one(spark, T.count_tokens(F.col("c"), len), c=None) == 0
    assert one(spark, T.truncate(F.col("c"), 100), c="x" * 400) == "x" * 400
    assert one(spark, T.truncate(F.col("c"), 100), c="x" * 401) == "x" * 360 + T.CUT_MARK


def test_durations(spark):
    assert one(spark, T.duration_text(F.col("s")), s=59.96) == "60.0s"
    assert one(spark, T.duration_text(F.col("s")), s=90.0) == "1.5m"
    assert one(spark, T.duration_text(F.col("s")), s=5400.0) == "1.5h"
    assert one(spark, T.elapsed_text(F.lit(None).cast("double")), s=1.0) == "Unknown"


def test_blocks_match_a_plain_walk(spark):
    text = "fn a() {\n  if x {\n  }\n}\n\nfn b() {}\ntail"
    assert one(spark, T.brace_block_end(F.col("t"), F.lit(0)), t=text) == 4
    py = "def a():\n    x\n\n    y\nz\n"
    assert one(spark, T.indent_block_end(F.col("t"), F.lit(0)), t=py) == 4
    assert one(spark, T.indent_block_end(F.col("t"), F.lit(4)), t=py) == 6


def test_css_specificity(spark):
    assert one(spark, T.css_specificity(F.col("s")), s="#a .b:hover p") == 121


LINES = st.lists(st.text(alphabet="ab ", max_size=40), max_size=40)


@settings(max_examples=200, deadline=None)
@given(LINES, st.integers(1, 12), st.integers(0, 15))
def test_packing_covers_every_line_in_order(lines, size, overlap):
    spans = chunking.pack_lines(lines, size, overlap)
    if not lines:
        assert spans == []
        return
    assert spans[0][0] == 0 and spans[-1][1] == len(lines)
    for (a, b), (c, e) in zip(spans, spans[1:]):
        assert a < b and a < c <= b < e  # advances, no gap
    # the same by prefix sums: an end is the first line, after the one forced in, at which the size is passed
    cum = [0]
    for x in lines:
        cum.append(cum[-1] + chunking.char_tokens(x))
    want, s, e = [], 0, next((i for i in range(1, len(lines)) if cum[i + 1] > size), len(lines))
    while True:
        want.append((s, e))
        if e == len(lines):
            break
        s = e - min((e - s) * overlap // size, max(e - s - 1, 0))
        e = next((i for i in range(e + 1, len(lines)) if cum[i + 1] - cum[s] > size), len(lines))
    assert spans == want


def test_packing_examples():
    assert chunking.pack_lines(["x" * 4] * 5, 2, 0) == [(0, 2), (2, 4), (4, 5)]
    assert chunking.pack_lines(["x" * 400], 2, 1) == [(0, 1)]
    assert chunking.pack_lines(["x" * 4] * 4, 3, 1) == [(0, 3), (2, 4)]


def test_chunks_by_language():
    py = "import os\n\ndef a():\n    return 1\n\nclass B:\n    def m(self):\n        pass\n"
    assert [(a, b, k) for a, b, k, _ in chunking.chunk_text(py, "python")] == [(2, 4, "function"), (5, 8, "class"), (6, 8, "function")]
    rs = "use x;\nfn a() {\n" + "    let y = 1;\n" * 20 + "}\n"
    assert [(a, b, k) for a, b, k, _ in chunking.chunk_text(rs, "rust")] == [(1, 23, "function")]
    assert [k for *_, k, _ in chunking.chunk_text("a\nb", "text")] == ["block"]
    assert chunking.chunk_text("def broken(:\n", "python")


def test_chunk_relation_handles_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "text"), (2, "", "text"), (3, "a\nb", None)], "id int, content string, language string")
    got = chunking.chunks(df, size=1, overlap=0).select("id", "chunk_no", "chunk").orderBy("id", "chunk_no").collect()
    assert [tuple(r) for r in got] == [(3, 0, "a"), (3, 1, "b")]
