"""Scalar functions on text, tokens, models and figures as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

#: fixed values: context sizes of models, in tokens
CONTEXT_LIMITS = {
    "gpt-4": 8192, "gpt-4-turbo": 128000, "gpt-4o": 128000, "gpt-3.5-turbo": 4096, "gpt-3.5-turbo-16k": 16384, "sonar-large-chat": 16384, "sonar-medium-chat": 16384, "sonar-small-chat": 16384,
    "sonar-large-online": 16384, "sonar-medium-online": 16384, "claude-3-opus-20240229": 200000, "claude-3-sonnet-20240229": 200000, "claude-3-haiku-20240307": 200000, "claude-2.1": 200000,
    "claude-2.0": 100000, "claude-instant-1.2": 100000, "MiniMax-M3": 1000000, "MiniMax-M2.7": 1000000, "MiniMax-M2.5": 1000000, "MiniMax-M2.1": 1000000,
}
DEFAULT_CONTEXT = 4096
RESERVE = 1000
COST_PER_TOKEN = 0.00002
CUT_MARK = "\n[cut to fit]"
CUT_RESERVE = 10


def count_tokens(text: Column, tokenizer: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text: by a tokenizer of one's own, in Arrow batches, or a deterministic estimate, a quarter of the characters rounded up; null and empty count 0."""
    if tokenizer is not None:

        @arrow_udf("bigint")
        def counted(t: pd.Series) -> pd.Series:
            return pd.Series([tokenizer(x) if x else 0 for x in t], dtype="int64")

        return counted(text)
    return F.coalesce(((F.length(text) + 3) / 4).cast("bigint"), F.lit(0).cast("bigint"))


def context_limit(model: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CONTEXT_LIMITS.items() for x in kv])
    return F.coalesce(names[model], F.lit(DEFAULT_CONTEXT))


def content_budget(model: Column, max_tokens: Column) -> Column:
    return F.least(context_limit(model) - RESERVE, F.coalesce(max_tokens, F.lit(16000)))


def truncate(text: Column, limit: Column | int) -> Column:
    """Unchanged when it fits, else its first ``limit - 10`` tokens and a mark."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    keep = F.greatest((limit - CUT_RESERVE) * 4, F.lit(0))
    return F.when(count_tokens(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), keep.cast("int")), F.lit(CUT_MARK)))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_index(text: Column, offset: Column) -> Column:
    """Line, from 0, of a character offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n")))


def line_metrics(text: Column) -> dict[str, Column]:
    ls = lines(F.coalesce(text, F.lit("")))
    total = F.size(ls)
    return {"total_lines": total, "code_lines": F.size(F.filter(ls, lambda x: F.trim(F.regexp_replace(x, r"[\t\r\f]", "")) != "")), "complexity": F.when(total > 50, "medium").otherwise("low")}


def visibility(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(^|[^A-Za-z0-9_])pub(lic)?($|[^A-Za-z0-9_])"), "public")
        .when(text.rlike(r"(^|[^A-Za-z0-9_])private($|[^A-Za-z0-9_])"), "private")
        .when(text.rlike(r"(^|[^A-Za-z0-9_])protected($|[^A-Za-z0-9_])"), "protected")
        .otherwise("private")
    )


def confidence(base: Column, known: Column, braces: Column) -> Column:
    return F.round(F.least(F.lit(1.0), base + F.when(known, 0.1).otherwise(0.0) + F.when(braces, 0.1).otherwise(0.0)), 2)


def css_specificity(selector: Column) -> Column:
    """100 for an id, 10 for a class, attribute or pseudo class, 1 for an element name."""
    ids = F.regexp_count(selector, F.lit(r"#[A-Za-z_-][A-Za-z0-9_-]*"))
    classes = F.regexp_count(selector, F.lit(r"\.[A-Za-z_-][A-Za-z0-9_-]*|\[[^\]]*\]|:[A-Za-z-]+"))
    bare = F.regexp_replace(selector, r"[#.:][A-Za-z0-9_-]+|\[[^\]]*\]|\([^)]*\)", " ")
    return (ids * 100 + classes * 10 + F.regexp_count(bare, F.lit(r"[A-Za-z][A-Za-z0-9]*"))).cast("bigint")


def _rounded(seconds: Column, scale: int) -> Column:
    """Half up on the decimal digits, not on the binary fraction."""
    return F.round(seconds.cast("decimal(18,6)"), scale).cast("double")


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.1fs", _rounded(seconds, 1)))
        .when(seconds < 3600, F.format_string("%.1fm", _rounded(seconds / 60, 1)))
        .otherwise(F.format_string("%.1fh", _rounded(seconds / 3600, 1)))
    )


def elapsed_text(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "Unknown").otherwise(F.format_string("%.2f seconds", _rounded(seconds, 2)))


def cost(tokens: Column) -> Column:
    return F.round(tokens * F.lit(COST_PER_TOKEN), 6)


def preview(text: Column, size: int = 200) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def title_case(text: Column) -> Column:
    return F.initcap(text)


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def provider_of(model: Column) -> Column:
    """Provider by the prefix of the model's name."""
    return F.when(model.startswith("claude-"), "anthropic").when(model.startswith("sonar-"), "perplexity").otherwise("openai")


def join_blocks(blocks: Column) -> Column:
    """Text of a response: its text blocks joined, other blocks skipped."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


#: what stands around language, path and content in the prompt of a file, a chunk and an aggregation
PROMPTS = {
    "file": ("Describe the purpose, structure and dependencies of this ", " file.\nPath: ", "\n\n"),
    "chunk": ("Describe this part of a ", " file.\nPath: ", "\n\n"),
    "aggregate": ("Write one overview of a ", " code base from these notes.\nRoot: ", "\n\n"),
}


def render_prompt(kind: str, *, language: str | None, path: str, content: str) -> str:
    """The prompt of one request, as ``prompt`` renders it over columns."""
    a, b, c = PROMPTS[kind]
    return f"{a}{language or 'unknown'}{b}{path}{c}{content}"


def fit(text: str, limit: int) -> str:
    """One text as ``truncate`` cuts it over columns."""
    return text if (len(text) + 3) // 4 <= limit else text[: max((limit - CUT_RESERVE) * 4, 0)] + CUT_MARK


def prompt(kind: str, **cols: Column) -> Column:
    """Prompt of a file, a chunk or an aggregation."""
    head = PROMPTS[kind]
    return F.concat(F.lit(head[0]), F.coalesce(cols["language"], F.lit("unknown")), F.lit(head[1]), cols["path"], F.lit(head[2]), cols["content"])


def brace_block_end(text: Column, start: Column) -> Column:
    """Line after the block that starts on a line: the first later line at which opened braces are closed, else the end.

    One prefix sum over the lines, not a sum for each candidate.
    """
    ls = lines(text)
    delta = F.transform(ls, lambda x: F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}")))
    rest = F.slice(delta, start + 1, F.greatest(F.size(delta) - start, F.lit(0)))
    walk = F.aggregate(
        rest,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("end")),
        lambda a, d: F.struct((a["sum"] + d).alias("sum"), (a["i"] + 1).alias("i"), F.when((a["end"] < 0) & (a["i"] > 0) & (a["sum"] + d <= 0), a["i"]).otherwise(a["end"]).alias("end")),
    )
    return F.when(walk["end"] >= 0, start + walk["end"] + 1).otherwise(F.size(ls))


def indent_block_end(text: Column, start: Column) -> Column:
    """First later line that is not blank and no deeper than the first, else the end."""
    ls = lines(text)
    depth = F.transform(ls, lambda x: F.when(F.trim(F.regexp_replace(x, r"[\t\r]", "")) == "", F.lit(None)).otherwise(F.length(x) - F.length(F.ltrim(F.regexp_replace(x, "\t", " ")))))
    first = F.get(depth, start)
    after = F.filter(F.sequence(start + 1, F.size(ls)), lambda i: F.get(depth, i) <= first)
    return F.coalesce(F.get(after, F.lit(0)), F.size(ls))
