"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, canonical, generated, lookalike, packing, pairs, repetition, secrets, syntax
from .common import cut, spread

#: parameter of the clean-up of tokens_used: no answer of these models is longer, larger figures are dirt and are counted as dropped
MOST_TOKENS = 65_536
#: fixed values: other spellings of the language names in files
LANGUAGE_NAMES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "golang", "rs": "rust", "yml": "yaml", "md": "markdown", "sh": "bash", "shell": "bash", "txt": "text", "htm": "html"}


def _table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet").select(*cols))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return generated.classify(_table(spark, d, "files", "file_id", "codebase", "relative_path", "content")).select("file_id")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "files", "file_id", "codebase", "relative_path", "content")
    ids = spark.read.parquet(f"{d}/files.parquet").select("file_id", "codebase").dropDuplicates(["file_id"])
    return generated.classify(files).join(ids, "file_id").groupBy("codebase", "kind").agg(F.count("*").alias("files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "files", "file_id", "relative_path", "content")
    return syntax.first_errors(files).where("syntax.line is not null").select("file_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "files", "file_id", "codebase", "relative_path", "content")
    rows = syntax.first_errors(files).select("file_id", "codebase", F.col("syntax.language").alias("language"), F.col("syntax.line").isNotNull().alias("broken")).distinct()
    return rows.groupBy("codebase", "language").agg(F.count("*").alias("files"), F.count_if("broken").alias("broken")).withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_table(spark, d, "requests", "request_id", "content", "answer_lang"), _table(spark, d, "responses", "response_id", "request_id", "summary"))


def _prints(spark: SparkSession, d: str) -> DataFrame:
    return cut(canonical.fingerprints(_table(spark, d, "requests", "request_id", "content", "file_path", "language")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.duplicate_pairs(_prints(spark, d))


def p4_copies(spark: SparkSession, d: str) -> DataFrame:
    return canonical.copies(_prints(spark, d)).select("keep_id", "n_copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = repetition.repetition(_table(spark, d, "responses", "response_id", "summary"), shares=False)
    return rows.where("repetition.repetitive").select("response_id").distinct()


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = repetition.repetition(_table(spark, d, "responses", "response_id", "summary"))
    return rows.select("response_id", F.round("repetition.ratio", 4).alias("ratio"), F.col("repetition.band").alias("band"), F.round("repetition.share", 4).alias("share"), "repetition.repetitive").dropDuplicates(["response_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.secret_lines(_table(spark, d, "requests", "request_id", "content"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = secrets.redact(_table(spark, d, "requests", "request_id", "content"))
    return rows.select("request_id", F.col("redacted").alias("content")).dropDuplicates(["request_id"])


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """Totals by source, language and domain; doc_id is unique in this table, so no row is looked for twice."""
    docs = _table(spark, d, "documents", "doc_id", "text", "source", "lang", "domain")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.trim("source"), F.lit("unknown")).alias("source"),
        F.coalesce(F.lower(F.split(F.trim("lang"), "-")[0]), F.lit("unknown")).alias("lang"),
        F.coalesce(F.trim("domain"), F.lit("unknown")).alias("domain"),
        bpe.token_count(F.col("text")).alias("tokens"),
    )
    # the finest cells first, with map-side combining; the cube then runs over these few rows
    cells = rows.groupBy("source", "lang", "domain").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    cube = cells.cube("source", "lang", "domain").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return cube.select(*[F.coalesce(x, F.lit("(all)")).alias(x) for x in ("source", "lang", "domain")], "docs", "tokens")


def p7_responses(spark: SparkSession, d: str, most: int = MOST_TOKENS) -> DataFrame:
    """Totals by provider and language; ``dropped`` counts the figures that are null, not above 0 or above ``most``."""
    read = lambda t, *c: spark.read.parquet(f"{d}/{t}.parquet").select(*c)
    r = read("responses", "response_id", "request_id", "tokens_used", "provider_used").dropDuplicates(["response_id"])
    q = read("requests", "request_id", "file_id").dropDuplicates(["request_id"])
    raw = F.lower(F.trim("language"))
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    f = read("files", "file_id", "language").dropDuplicates(["file_id"]).select("file_id", F.when(F.coalesce(raw, F.lit("")).isin("", "unknown"), "unknown").otherwise(F.coalesce(names[raw], raw)).alias("language"))
    ok = F.col("tokens_used").between(1, most)
    rows = (
        r.join(q, "request_id", "left")
        .join(f, "file_id", "left")
        .select(F.coalesce(F.lower(F.trim("provider_used")), F.lit("unknown")).alias("provider"), F.coalesce("language", F.lit("unknown")).alias("language"), F.when(ok, F.col("tokens_used")).alias("t"))
    )
    cells = rows.groupBy("provider", "language").agg(F.count("*").alias("responses"), F.count("t").alias("counted"), F.sum("t").alias("tokens"))
    cube = cells.cube("provider", "language").agg(F.sum("responses").alias("responses"), F.sum("counted").alias("counted"), (F.sum("responses") - F.sum("counted")).alias("dropped"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return cube.select(F.coalesce("provider", F.lit("(all)")).alias("provider"), F.coalesce("language", F.lit("(all)")).alias("language"), "responses", "counted", "dropped", "tokens")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_table(spark, d, "documents", "doc_id", "text"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", bpe.token_count(F.col("text")).alias("tokens"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), spark.read.parquet(f"{d}/pack_limits.parquet"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_packing(spark, d), spark.read.parquet(f"{d}/pack_limits.parquet"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(cut(lookalike.prints(_table(spark, d, "documents", "doc_id", "text"))))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize(_table(spark, d, "documents", "doc_id", "text")).select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_kinds, p2_found, p2_rates, p3_found, p4_found, p4_copies, p5_found, p5_shares, p6_found, p6_redacted, p7_documents, p7_responses, p8_ids, p9_packing, p9_fill, p10_found, p10_forms)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    other = " ".join(f"when '{a}' then '{b}'" for a, b in LANGUAGE_NAMES.items())
    return {
        "p7_responses": f"""
with r as (select distinct response_id, request_id, tokens_used, provider_used from responses),
q as (select distinct request_id, file_id from requests),
f as (select distinct file_id, case when coalesce(lower(trim(language)), '') in ('', 'unknown') then 'unknown' else case lower(trim(language)) {other} else lower(trim(language)) end end as language from files),
x as (select coalesce(lower(trim(provider_used)), 'unknown') as provider, coalesce(language, 'unknown') as language, case when tokens_used between 1 and {MOST_TOKENS} then tokens_used end as t
      from r left join q using (request_id) left join f using (file_id))
select case when grouping(provider) = 1 then '(all)' else provider end as provider, case when grouping(language) = 1 then '(all)' else language end as language,
       count(*) as responses, count(t) as counted, count(*) - count(t) as dropped, cast(coalesce(sum(t), 0) as bigint) as tokens
from x group by cube (provider, language)"""
    }
