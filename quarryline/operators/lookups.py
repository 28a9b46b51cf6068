"""Lines and elements looked up by nearness, balance or name."""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf


def nearest_before(lines: DataFrame, key: str, wanted: Column, mark: Column, *, within: int | None = None, out: str = "nearest") -> DataFrame:
    """For each wanted line of a file the nearest earlier line that is marked, within so many lines if given.

    ``lines`` has the key, line_no and line; the window lies within one file.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-within if within else Window.unboundedPreceding, -1)
    return lines.withColumn(out, F.last(F.when(mark, F.col("line")), ignorenulls=True).over(w)).where(wanted)


def nearest_in_text(text: Column, wanted: Callable[[Column], Column], mark: Callable[[Column], Column]) -> Column:
    """(line_no, nearest) of each wanted line of a text with the nearest earlier marked one: one walk over its lines, nothing is shuffled."""
    kind = "struct<i:int,last:string,out:array<struct<line_no:int,nearest:string>>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<line_no:int,nearest:string>>").alias("out")).cast(kind)
    walk = F.aggregate(
        F.split(text, "\n"),
        start,
        lambda a, x: F.struct(
            (a["i"] + 1).alias("i"),
            F.when(mark(x), x).otherwise(a["last"]).alias("last"),
            F.when(wanted(x), F.concat(a["out"], F.array(F.struct(a["i"].alias("line_no"), a["last"].alias("nearest"))))).otherwise(a["out"]).alias("out"),
        ).cast(kind),
    )
    return walk["out"]


def block_spans(text: str | None, opener: re.Pattern, indented: bool) -> list[tuple[int, int]]:
    """(start, end) of the blocks whose first line the opener matches, in one walk.

    By braces a block ends after the first later line at which no more are open
    than before it, by indentation at the first later line that is not blank and
    no deeper; else with the text.  Open blocks wait in order of their depth.
    """
    if text is None:
        return []
    lines, waiting, ends, depth = text.split("\n"), [], {}, 0
    for i, line in enumerate(lines):
        if indented:
            bare = line.strip(" \t\r")
            at = len(line) - len(line.replace("\t", " ").lstrip(" ")) if bare else None
            base = at
        else:
            base, at = depth, depth + line.count("{") - line.count("}")
            depth = at
        while at is not None and waiting and waiting[-1][0] >= at:
            ends[waiting.pop()[1]] = i if indented else i + 1
        if opener.match(line):
            ends[i] = len(lines)
            insort(waiting, (base or 0, i))
    return sorted(ends.items())


def blocks(text: Column, opener: str, *, indented: bool = False) -> Column:
    """Spans of the blocks of a text, as an array."""

    @arrow_udf("array<struct<start_line:int,end_line:int>>")
    def spans(t: pd.Series) -> pd.Series:
        rx = re.compile(opener)
        return t.map(lambda x: [{"start_line": a, "end_line": b} for a, b in block_spans(x, rx, indented)])

    return spans(text)


def brace_balance(lines: DataFrame, key: str) -> DataFrame:
    """The lines, as their numbers and deltas (``brace_delta``), with the balance of braces up to each."""
    return lines.withColumn("balance", F.sum("delta").over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def brace_delta(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))


def widget_states(elements: DataFrame, key: str) -> DataFrame:
    """Widgets with the state class named after them, null if there is none."""
    w = elements.where("pattern = 'widget'").select(key, F.col("name").alias("widget"), F.concat(F.lit("_"), "name", F.lit("State")).alias("state_name"))
    s = elements.where("pattern = 'state'").select(key, F.col("name").alias("state_name"), F.col("start_line").alias("state_line"))
    return w.join(s, [key, "state_name"], "left").select(key, "widget", F.when(F.col("state_line").isNotNull(), F.col("state_name")).alias("state"))


def test_framework(text: Column) -> Column:
    return F.when(text.contains("import unittest") | text.contains("unittest.TestCase"), "unittest").when(text.contains("import pytest") | text.contains("@pytest."), "pytest").when(text.contains("def test_"), "plain")


def assertion_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^[ \t]*(?:assert[ (]|self\.assert[A-Za-z]+\()")).cast("bigint")


def test_type(name: Column) -> Column:
    """Kind of a test by its name; unit where it says nothing."""
    low = F.lower(name)
    return F.when(low.contains("integration") | low.contains("e2e"), "integration").when(low.contains("unit"), "unit").when(low.contains("perf"), "performance").otherwise("unit")


def command_count(text: Column) -> Column:
    """Lines of a script that are neither blank nor a comment."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+", "").rlike(r"^[^#\s]"))).cast("bigint")


def variable_type(value: Column) -> Column:
    """Kind of the value of a shell variable: integer, boolean, reference, path or string."""
    return F.when(value.rlike(r"^\d+$"), "integer").when(F.lower(value).isin("true", "false"), "boolean").when(value.startswith("$"), "reference").when(value.contains("/"), "path").otherwise("string")


def array_size(definition: Column) -> Column:
    """Number of the words between the first brackets of an array, 0 without brackets."""
    inner = F.regexp_extract(definition, r"\(([^)]*)\)", 1)
    return F.size(F.filter(F.split(inner, r"\s+"), lambda x: x != "")).cast("bigint")


def alias_command(definition: Column) -> Column:
    """What an alias stands for, without its quotes."""
    return F.regexp_replace(F.trim(F.regexp_extract(definition, r"=(.*)", 1)), r"^(['\"])(.*)\1$", "$2")


def shell_type(text: Column) -> Column:
    """Shell by the first line: bash, zsh, fish, ksh, else sh."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^#![^\n]*\b(bash|zsh|fish|ksh)\b", 1), F.lit("")), F.lit("sh"))


def exit_codes(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:exit|return)[ \t]+([0-9]+)"), F.lit(1)))), ",")


def next_route(path: Column) -> dict[str, Column]:
    """File type, router and route of a page of the Next framework."""
    name = F.regexp_extract(path, r"([^/]+)\.(?:jsx?|tsx?)$", 1)
    app = path.rlike(r"(^|/)app/")
    pages = path.rlike(r"(^|/)pages/")
    kind = F.when(app & name.isin("page", "layout", "route", "loading", "error", "template", "not-found"), name).when(path.rlike(r"(^|/)pages/api/"), "api").when(name == "middleware", "middleware").when(pages & name.isin("_app", "_document"), F.substring(name, 2, 20)).when(pages, "page").otherwise("module")
    base = F.regexp_extract(path, r"(?:^|/)(?:app|pages)/(.*)\.(?:jsx?|tsx?)$", 1)
    route = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(base, r"(^|/)(page|layout|route|index|loading|error|template|not-found)$", ""), r"\([^)]*\)/", ""))
    return {"file_type": kind, "router": F.when(app, "app").when(pages, "pages").otherwise("none"), "route": F.when(app | pages, route)}
