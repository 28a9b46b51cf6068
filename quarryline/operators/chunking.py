"""Chunks: syntax-tree, pattern and size-bounded, with the re-split of oversize ones."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

SIZE, OVERLAP = 2000, 400
LEAST_PATTERN_TOKENS = 50
OVERSIZE = 1.5
LARGE = 4

Tokens = Callable[[str], int]


def char_tokens(text: str) -> int:
    return (len(text) + 3) // 4


def pack_lines(lines: list[str], size: int, overlap: int, tokens: Tokens = char_tokens) -> list[tuple[int, int]]:
    """Greedy spans [start, end) of lines, each next one starting on the last ``len * overlap / size`` lines of the one before.

    A line is always taken by the chunk it opens, so one over-long line stands
    alone or with overlap.  With an overlap not below the size nothing would
    advance, so the overlap is held under the length of the chunk.
    """
    n = len(lines)
    cost = [tokens(x) for x in lines]
    out, start, total = [], 0, 0
    for i in range(n):
        if i > start and total + cost[i] > size:
            out.append((start, i))
            start = i - min((i - start) * overlap // size if size else 0, i - start - 1 if i - start > 1 else 0)
            total = sum(cost[start:i])
        total += cost[i]
    if n:
        out.append((start, n))
    return out


#: column-0 openers of each language, own expressions written from the grammars
PATTERNS = {
    "python": [("function", r"(?:async[ \t]+)?def[ \t]+\w+"), ("class", r"class[ \t]+\w+"), ("decorated", r"@\w[\w.]*")],
    "rust": [("function", r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*fn[ \t]+\w+"), ("struct", r"(?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum)[ \t]+\w+"), ("impl", r"impl\b"), ("trait", r"(?:pub(?:\([^)]*\))?[ \t]+)?trait[ \t]+\w+")],
    "golang": [("function", r"func[ \t]+(?:\([^)]*\)[ \t]*)?\w+"), ("type", r"type[ \t]+\w+"), ("declaration", r"(?:var|const)\b")],
    "javascript": [("function", r"(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b"), ("class", r"(?:export[ \t]+)?(?:default[ \t]+)?class[ \t]+\w+"), ("arrow", r"(?:export[ \t]+)?(?:const|let|var)[ \t]+\w+[ \t]*=[ \t]*(?:async[ \t]*)?(?:\([^)\n]*\)|\w+)[ \t]*=>")],
}
PATTERNS["typescript"] = PATTERNS["javascript"] + [("interface", r"(?:export[ \t]+)?interface[ \t]+\w+")]
#: fixed values: languages that are cut by patterns; Python is cut by its syntax tree, all others by lines
BY_PATTERN = ("rust", "javascript", "typescript")
_COMPILED = {k: [(n, re.compile("(?m)^" + p)) for n, p in v] for k, v in PATTERNS.items()}


def block_end(lines: list[str], start: int, indented: bool) -> int:
    if indented:
        depth = len(lines[start]) - len(lines[start].lstrip())
        for i in range(start + 1, len(lines)):
            if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= depth:
                return i
        return len(lines)
    total = 0
    for i in range(start, len(lines)):
        total += lines[i].count("{") - lines[i].count("}")
        if i > start and total <= 0:
            return i + 1
    return len(lines)


def generic_chunks(text: str, size: int, overlap: int, tokens: Tokens) -> list[tuple[int, int, str]]:
    return [(a, b, "block") for a, b in pack_lines(text.split("\n"), size, overlap, tokens)]


def pattern_chunks(text: str, language: str, size: int, overlap: int, tokens: Tokens) -> list[tuple[int, int, str]]:
    lines = text.split("\n")
    out = []
    for kind, rx in _COMPILED.get(language, ()):
        start = at = 0
        for m in rx.finditer(text):
            start += text.count("\n", at, m.start())
            at = m.start()
            end = block_end(lines, start, language == "python")
            if tokens("\n".join(lines[start:end])) > LEAST_PATTERN_TOKENS:
                out.append((start, end, kind))
    return out or generic_chunks(text, size, overlap, tokens)


def python_chunks(text: str, size: int, overlap: int, tokens: Tokens) -> list[tuple[int, int, str]]:
    """One chunk a function and class, breadth first; methods stand in their class and by themselves."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return pattern_chunks(text, "python", size, overlap, tokens)
    out = [
        (x.lineno - 1, x.end_lineno, "class" if isinstance(x, ast.ClassDef) else "function")
        for x in ast.walk(tree)
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
    ]
    return out or generic_chunks(text, size, overlap, tokens)


def chunk_text(text: str, language: str, size: int = SIZE, overlap: int = OVERLAP, tokens: Tokens = char_tokens, optimise: bool = True) -> list[tuple[int, int, str, int]]:
    """(start_line, end_line, type, tokens) of the chunks of one text; lines from 0, the end exclusive."""
    if language == "python":
        first = python_chunks(text, size, overlap, tokens)
    elif language in BY_PATTERN:
        first = pattern_chunks(text, language, size, overlap, tokens)
    else:
        first = generic_chunks(text, size, overlap, tokens)
    lines = text.split("\n")
    out = []
    for a, b, kind in first:
        n = tokens("\n".join(lines[a:b]))
        if n <= OVERSIZE * size or not optimise:
            out.append((a, b, kind, n))
            continue
        parts = pack_lines(lines[a:b], size, overlap, tokens)
        if len(parts) < 2:
            out.append((a, b, kind, n))
        else:
            out += [(a + x, a + y, "block", tokens("\n".join(lines[a + x : a + y]))) for x, y in parts]
    return out


_SPANS = "array<struct<start_line:int,end_line:int,chunk_type:string,tokens:bigint,first:int,length:int>>"


def chunks(files: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP, tokens: Tokens = char_tokens, strategy: str = "auto", text: str = "content", language: str = "language", with_text: bool = True, optimise: bool = True) -> DataFrame:
    """The files exploded to chunks; the other columns of a file, but for its text, stand beside each of its chunks.

    Only spans come back from Python; chunk texts are cut by their offsets in
    the JVM before the explode, so the whole text is not carried along with each
    chunk.  Without ``with_text`` no text is cut at all, without ``optimise``
    oversize chunks are not cut again.  Empty and null contents
    give no chunk.
    """

    @arrow_udf(_SPANS)
    def spans(t: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(t, g):
            if not a:
                out.append([])
                continue
            ls = a.split("\n")
            if strategy == "generic":
                found = [(x, y, "block", tokens("\n".join(ls[x:y]))) for x, y in pack_lines(ls, size, overlap, tokens)]
            else:
                found = chunk_text(a, b or "unknown", size, overlap, tokens, optimise)
            at = [0, *accumulate(len(x) + 1 for x in ls)]
            out.append([{"start_line": x, "end_line": y, "chunk_type": k, "tokens": n, "first": at[x], "length": max(0, at[y] - at[x] - 1)} for x, y, k, n in found])
        return pd.Series(out, dtype=object)

    keep = [c for c in files.columns if c != text]
    found = spans(F.col(text), F.col(language))
    fields = ["start_line", "end_line", "chunk_type", "tokens"]
    if with_text:
        rows = files.withColumn("__spans", found)
        found = F.transform("__spans", lambda s: F.struct(*[s[f].alias(f) for f in fields], F.substring(F.col(text), s["first"] + 1, s["length"]).alias("chunk")))
        fields = [*fields, "chunk"]
    else:
        rows = files
    return rows.select(*keep, F.posexplode(found).alias("chunk_no", "__c")).select(*keep, "chunk_no", *[f"__c.{f}" for f in fields])


def explode_lines(files: DataFrame, *, text: str = "content") -> DataFrame:
    return files.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
