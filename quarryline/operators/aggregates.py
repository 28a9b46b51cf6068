"""Aggregations, rankings, ledgers and the hierarchical reduce."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators.materialize import cut

FAN_IN = 10
TOP_FILES, TOP_NAMES, MOST_ELEMENTS = 10, 20, 200


def run_summary(responses: DataFrame) -> DataFrame:
    """Counters of a run: responses, requests, fallbacks, tokens, errors, times."""
    return responses.agg(
        F.count("*").alias("responses"),
        F.count_distinct("request_id").alias("requests"),
        F.sum(F.col("fallback_used").cast("bigint")).alias("fallbacks"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens"),
        F.count("error").alias("errors"),
        F.round(F.avg("processing_time"), 6).alias("avg_time"),
        F.round(F.min("processing_time"), 6).alias("min_time"),
        F.round(F.max("processing_time"), 6).alias("max_time"),
    )


def usage_by_provider(attempts: DataFrame) -> DataFrame:
    """Requests, tokens, one error a failed attempt, and the cost by provider."""
    return (
        attempts.groupBy("provider")
        .agg(F.count("*").alias("attempts"), F.count_if("ok").alias("answers"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(~F.col("ok")).alias("errors"))
        .withColumn("cost", T.cost(F.col("tokens")))
    )


def language_profile(files: DataFrame) -> DataFrame:
    m = T.line_metrics(F.col("content"))
    return files.select("language", F.octet_length("content").alias("b"), m["total_lines"].alias("l"), T.count_tokens(F.col("content")).alias("t")).groupBy("language").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes"), F.sum("l").cast("bigint").alias("lines"), F.sum("t").cast("bigint").alias("tokens")
    )


def profile(files: DataFrame, *by: str) -> DataFrame:
    """Size of a code base and the settings recommended for it."""
    return (
        files.groupBy(*by)
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.count_distinct("language").alias("languages"), F.array_sort(F.collect_set("language")).alias("names"))
        .withColumn("size_mb", T.megabytes(F.col("bytes")))
        .withColumn("workers", F.when((F.col("files") > 1000) | (F.col("bytes") > 100 * 1048576), 12).when(F.col("files") < 50, 4).otherwise(8))
        .withColumn("chunk_size", F.when((F.col("files") > 1000) | (F.col("bytes") > 100 * 1048576), 3000).when(F.col("files") < 50, 1500).otherwise(2000))
        .withColumn("fallback", ~(F.col("files") < 50))
        .withColumn("advice", F.concat_ws("; ", F.when(F.col("files") > 500, "narrow the globs"), F.when(F.array_contains("names", "python") & F.array_contains("names", "javascript"), "mixed languages"), F.when(F.col("bytes") > 50 * 1048576, "raise the chunk size")))
        .withColumn("names", F.array_join("names", ","))
    )


def success_rate(ok: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(ok, total), F.lit(0.0)), 6)


def top_files(files: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """The first files of each language, before any filter on their summaries; a partial rank in each partition comes first."""
    w = Window.partitionBy("language").orderBy("relative_path", "file_id")
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cap_elements(elements: DataFrame, key: str, n: int = MOST_ELEMENTS) -> DataFrame:
    w = Window.partitionBy(key).orderBy("start_line", "pattern", "name")
    return elements.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hints(analysed: DataFrame, *keep: str, n: int = TOP_NAMES, analysis: str = "analysis") -> DataFrame:
    """First names in order of lines and number of dependencies of each file, from its own row: nothing is shuffled."""
    names = F.transform(F.col(f"{analysis}.elements"), lambda e: e["name"])
    return analysed.select(*keep, F.slice(names, 1, n).alias("top_elements"), F.size(f"{analysis}.dependencies").cast("bigint").alias("dependency_count"))


def ledger(rows: DataFrame, *, by: str, order: list[Column], tokens: str, seconds: str) -> DataFrame:
    """Running totals in completion order, one ledger for each ``by``: done, share, tokens, mean time, time left.

    The rows are cut into ranges of (by, order), summed within each, and each
    range starts from the totals of the ranges before it, so no task sees a
    whole ledger, whatever share of the rows has one time or none.  ``order``
    must name the rows one by one; the ranges are written first, as both uses
    must see the same ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, F.col(by), *order).withColumn("__b", F.spark_partition_id()))
    rows = rows.withColumn("__t", F.coalesce(F.col(tokens), F.lit(0))).withColumn("__s", F.round(F.coalesce(F.col(seconds), F.lit(0.0)) * 1_000_000).cast("bigint"))
    sums = rows.groupBy(by, "__b").agg(F.count("*").alias("n"), F.sum("__t").alias("t"), F.sum("__s").alias("s"))
    before = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    prior = sums.select(
        by, "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.sum("n").over(Window.partitionBy(by)).alias("total")
    )
    w = Window.partitionBy(by, "__b").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = rows.select("*", F.row_number().over(w).alias("__n"), F.sum("__t").over(run).alias("__rt"), F.sum("__s").over(run).alias("__rs"))
    done = F.col("__n") + F.col("n0")
    # whole microseconds, so that sums do not depend on their order
    mean = F.floor((F.col("__rs") + F.col("s0")) / done)
    keep = [c for c in rows.columns if not c.startswith("__")]
    return inner.join(prior, [by, "__b"]).select(
        *keep,
        done.cast("bigint").alias("done"),
        (F.floor(done * 10_000 / F.col("total")) / 100).alias("percent"),
        (F.col("__rt") + F.col("t0")).cast("bigint").alias("tokens_so_far"),
        (mean / 1_000_000).alias("mean_seconds"),
        (mean * (F.col("total") - done) / 1_000_000).alias("eta_seconds"),
    )


def dedup_elements(elements: DataFrame, key: str, *also: str) -> DataFrame:
    """First by pass of the elements with one name and line."""
    w = Window.partitionBy(key, "name", "start_line", *also).orderBy("element_no")
    return elements.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reduce_levels(n: int, fan_in: int = FAN_IN) -> list[int]:
    """Sizes of the levels of the tree that reduces ``n`` summaries to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan_in))
    return out


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Position of each row in its group, from 0."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def positions(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Position of each row in its group, from 0, without one task for a group.

    The rows are cut into ranges of (group, order), numbered within each, and
    shifted by a running count of the ranges before.  The ranges are written
    first, because both uses must see the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *by, *order).withColumn("__p", F.spark_partition_id()))
    local = numbered(ranged, [*by, "__p"], order)
    w = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = local.groupBy(*by, "__p").agg(F.count("*").alias("n")).select(*by, "__p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__off"))
    return local.join(before, [*by, "__p"]).withColumn("position", F.col("position") + F.col("__off")).drop("__p", "__off")


def reduce_once(rows: DataFrame, by: list[str], combine: Callable[[Column], Column], fan_in: int = FAN_IN, levels: int = 1) -> DataFrame:
    """One level, or several with one shuffle: consecutive tens of each group joined in order and combined.

    ``rows`` has the group columns, position and summary; so has the result.
    A group is never gathered as a whole, only the rows that end in one node.
    With several levels ``combine`` must be made of built-in expressions.
    """
    part = F.expr(f"position div {fan_in**levels}")
    out = rows.groupBy(*by, part.alias("position")).agg(F.array_sort(F.collect_list(F.struct(F.col("position").cast("bigint").alias("position"), "summary"))).alias("__x"))
    for _ in range(levels - 1):
        nodes = F.array_distinct(F.transform("__x", lambda x: _div(x["position"], fan_in)))
        joined = lambda n: F.array_join(F.transform(F.filter("__x", lambda x: _div(x["position"], fan_in) == n), lambda x: x["summary"]), "\n\n")
        out = out.withColumn("__x", F.transform(nodes, lambda n: F.struct(n.alias("position"), combine(joined(n)).alias("summary"))))
    return out.select(*by, "position", combine(F.array_join(F.transform("__x", lambda x: x["summary"]), "\n\n")).alias("summary"))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def levels_of(rows: DataFrame, by: list[str], fan_in: int = FAN_IN) -> int:
    """How many levels reduce the largest group to one row."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return len(reduce_levels(most, fan_in)) - 1


def hierarchical_reduce(rows: DataFrame, by: list[str], combine: Callable[[Column], Column], *, fan_in: int = FAN_IN, at_once: int = 2) -> DataFrame:
    """Levels until each group holds one row; the depth is the logarithm of the largest group.

    Two levels share a shuffle: the hundred rows under a node hold no more text
    than the ten joined ones would.
    """
    left = levels_of(rows, by, fan_in)
    while left > 0:
        rows = reduce_once(rows, by, combine, fan_in, min(at_once, left))
        left -= at_once
    return rows.select(*by, "summary")


def concat_texts(df: DataFrame, by: list[str], order: list[str], text: str, sep: str = "\n\n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x[text]), sep).alias(text))
