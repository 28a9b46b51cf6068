"""Reports in Markdown, JSON and text, from aggregated rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_counts(responses: DataFrame) -> DataFrame:
    """(error, n): the failures by their message."""
    return responses.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def report_lines(providers: DataFrame, run: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(line_no, line) of the Markdown report; the provider part only if there is more than one, the errors only if there are some."""
    stats = run.select(
        F.posexplode(
            F.array(
                F.lit("# Code base report"),
                F.lit(""),
                F.format_string("- Responses: %d", "responses"),
                F.format_string("- Tokens: %d", "tokens"),
                F.format_string("- Errors: %d", "errors"),
                F.format_string("- Fallbacks: %d", F.coalesce("fallbacks", F.lit(0).cast("bigint"))),
            )
        ).alias("n", "line")
    ).select(F.col("n").cast("bigint").alias("line_no"), "line")
    # windows over as many rows as there are providers
    body = providers.select("provider", F.format_string("- %s: %d attempts, %d tokens, %d errors", "provider", "attempts", "tokens", "errors").alias("line"), F.expr("row_number() over (order by provider)").alias("k"), F.expr("count(*) over ()").alias("n"))
    body = body.where("n > 1").select((F.col("k") + 5).cast("bigint").alias("line_no"), "line")
    out = stats.unionByName(body)
    if errors is None:
        return out
    # as many rows as there are different messages; they come after all providers
    told = errors.select(F.expr("row_number() over (order by n desc, error)").alias("k"), F.format_string("- %s (%d)", "error", "n").alias("line"))
    told = told.select((F.col("k") + 1_000_000).cast("bigint").alias("line_no"), "line")
    head = told.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(1_000_000).cast("bigint").alias("line_no"), F.lit("\n## Errors\n").alias("line"))
    return out.unionByName(head).unionByName(told)


#: characters of all summaries a report file holds; beyond that the rows are written as a table
MOST_IN_REPORT = 256 * 1024 * 1024


def summaries_by_path(files: DataFrame) -> dict[str, str]:
    """Summaries by path, for a report of one file; their size is checked first."""
    size = files.agg(F.coalesce(F.sum(F.length("summary") + F.length("relative_path")), F.lit(0))).first()[0]
    if size > MOST_IN_REPORT:
        raise ValueError("the summaries do not fit one report file; write them with write_summaries")
    return {r["relative_path"]: r["summary"] for r in files.select("relative_path", "summary").orderBy("relative_path").toLocalIterator()}


def write_summaries(files: DataFrame, folder: str) -> None:
    """The summaries as JSON lines, one file for each partition; nothing passes the driver."""
    files.select("codebase", "relative_path", "summary").write.mode("overwrite").json(folder)


def json_report(master: DataFrame, files: DataFrame, run: DataFrame) -> dict:
    """Master text, summaries by path and figures as one object; for results whose size fits a report."""
    return {"master": (master.first() or [""])[0], "files": summaries_by_path(files), "statistics": dict(run.first().asDict())}


def text_report(master: str) -> str:
    return "=" * 60 + "\nCODE BASE REPORT\n" + "=" * 60 + "\n\n" + master + "\n"


def fallback_report(files: DataFrame) -> DataFrame:
    """Per language, previews of its first files, when nothing could be aggregated."""
    from quarryline.functions import text as T
    from quarryline.operators.aggregates import top_files

    return top_files(files).where("error is null").select(T.title_case(F.col("language")).alias("language"), "rank", "relative_path", T.preview(F.col("summary")).alias("preview"))


def write_text(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_report(path: str, fmt: str, *, master: str, lines: list[str] | None = None, data: dict | None = None) -> None:
    if fmt == "json":
        write_text(path, json.dumps(data or {"master": master}, indent=2, default=str, ensure_ascii=False))
    elif fmt == "text":
        write_text(path, text_report(master))
    elif fmt == "markdown":
        write_text(path, "\n".join(lines or []) + "\n\n## Overview\n\n" + master + "\n")
    else:
        raise ValueError(f"unknown report format {fmt!r}")
