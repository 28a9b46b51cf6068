"""Enrichment by summarizers: provider fallback, retries, attempts, combination."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as T

RETRIES = 3


@dataclass(frozen=True)
class Provider:
    """A named summarizer: text and language in, summary out, an exception for a failure.

    A prompted one gets the rendered prompt, its content cut to the budget of its
    model, in place of the bare text.  One with ``aggregate`` can write one text
    of many; without it summaries are joined.
    """

    name: str
    model: str
    summarize: Callable[[str, str], str]
    prompted: bool = False
    max_tokens: int = 16000
    aggregate: Callable[[str, str], str] | None = None

    @property
    def budget(self) -> int:
        return min(T.CONTEXT_LIMITS.get(self.model, T.DEFAULT_CONTEXT) - T.RESERVE, self.max_tokens)

    def ask(self, text: str, language: str, kind: str = "file", path: str = "") -> str:
        call = self.aggregate if kind == "aggregate" and self.aggregate else self.summarize
        if not self.prompted:
            return call(text, language)
        return call(T.render_prompt(kind, language=language, path=path, content=T.fit(text, self.budget)), language)


def first_sentence(text: str, language: str = "", cap: int = 200) -> str:
    """Offline default: the first line that says something, capped."""
    for line in (text or "").split("\n"):
        if line.strip():
            return line.strip()[:cap]
    return "Empty file"


OFFLINE = Provider("offline", "first-line", first_sentence)


def complete(text: str, language: str, providers: tuple[Provider, ...], *, retries: int = RETRIES, fallback: bool = True, wait: Callable[[float], None] = time.sleep, kind: str = "file", path: str = "") -> tuple[dict, list[dict]]:
    """(response, attempts): providers in order, each up to ``retries`` times with waits of 1, 2, 4 … seconds."""
    attempts: list[dict] = []
    error = "no provider"
    started = time.monotonic()
    for k, p in enumerate(providers):
        for n in range(retries):
            try:
                summary = p.ask(text, language, kind, path)
            except Exception as e:  # noqa: BLE001 - the failure of a provider is data
                error = f"{type(e).__name__}: {e}"
                attempts.append({"provider": p.name, "attempt": n + 1, "ok": False, "tokens": 0})
                if n + 1 < retries:
                    wait(float(2**n))
                continue
            used = (len(text) + 3) // 4 + (len(summary) + 3) // 4
            attempts.append({"provider": p.name, "attempt": n + 1, "ok": True, "tokens": used})
            return {"summary": summary, "tokens_used": used, "processing_time": time.monotonic() - started, "model_used": p.model, "provider_used": p.name, "error": None, "fallback_used": k > 0}, attempts
        if not fallback:
            break
    return {"summary": None, "tokens_used": 0, "processing_time": time.monotonic() - started, "model_used": None, "provider_used": None, "error": error, "fallback_used": len(providers) > 1 and fallback}, attempts


_OUT = "summary string, tokens_used bigint, processing_time double, model_used string, provider_used string, error string, fallback_used boolean, attempts array<struct<provider:string,attempt:int,ok:boolean,tokens:bigint>>"


def summarize(requests: DataFrame, providers: tuple[Provider, ...] = (OFFLINE,), *, keys: tuple[str, ...] = ("relative_path",), text: str = "content", language: str = "language", retries: int = RETRIES, fallback: bool = True, wait: Callable[[float], None] = time.sleep, kind: Column | str = "file", path: Column | str = "") -> DataFrame:
    """One response a request, with its attempts; a failure is a row with an error, never a failed task.

    ``kind`` and ``path`` say which prompt a prompted provider gets.  Write the
    result before using it twice (``cut``): calls are not repeated when the
    written rows are read again.
    """
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    src = requests.select(*keys, F.col(text).alias("__t"), F.col(language).alias("__g"), as_column(kind).alias("__k"), as_column(path).alias("__p"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for t, g, k, p in zip(b["__t"], b["__g"], b["__k"], b["__p"]):
                if t is None or not str(t).strip():
                    rows.append(({"summary": "Empty file", "tokens_used": 0, "processing_time": 0.0, "model_used": None, "provider_used": None, "error": None, "fallback_used": False}, []))
                else:
                    rows.append(complete(t, g or "unknown", providers, retries=retries, fallback=fallback, wait=wait, kind=k or "file", path=p or ""))
            out = b[list(keys)].copy()
            for c in ("summary", "tokens_used", "processing_time", "model_used", "provider_used", "error", "fallback_used"):
                out[c] = [r[0][c] for r in rows]
            out["attempts"] = [r[1] for r in rows]
            yield out

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keys).schema)
    return src.mapInPandas(run, f"{head}, {_OUT}")


def attempts_of(responses: DataFrame, *keys: str) -> DataFrame:
    return responses.select(*keys, F.explode("attempts").alias("a")).select(*keys, "a.*")


ALL_FAILED = "No part of this file could be described."


def combine_parts(parts: DataFrame, by: str | list[str], order: str = "chunk_no") -> DataFrame:
    """Parts of a file that did not fail, joined in order; a fixed sentence if all did."""
    ok = F.when(F.col("error").isNull(), F.col("summary"))
    ordered = F.array_sort(F.collect_list(F.when(ok.isNotNull(), F.struct(order, ok.alias("s")))))
    return parts.groupBy(*([by] if isinstance(by, str) else by)).agg(F.coalesce(F.nullif(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n"), F.lit("")), F.lit(ALL_FAILED)).alias("summary"), F.count("error").alias("failed_parts"))


def chain_outcomes(attempts: DataFrame, *, key: str = "request_id") -> DataFrame:
    """What became of each request from its recorded tries: tries, providers, first and last, answered, fallback used."""
    t = F.struct("attempted_at", "attempt", "provider")
    return attempts.groupBy(key).agg(
        F.count("*").alias("tries"),
        F.count_distinct("provider").alias("providers"),
        F.min_by("provider", t).alias("first_provider"),
        F.max_by("provider", t).alias("last_provider"),
        F.bool_or("ok").alias("answered"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens"),
    ).withColumn("fallback_used", F.col("first_provider") != F.col("last_provider"))


def backoff_seconds(attempt: Column) -> Column:
    """Wait before the try after this one: 1, 2, 4 … seconds."""
    return F.pow(F.lit(2.0), attempt - 1)
