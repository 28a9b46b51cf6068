"""The whole run: scan, analyse, chunk, enrich, combine, reduce, report."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import config as C
from quarryline.functions import text as T
from quarryline.operators import aggregates as A
from quarryline.operators import chunking, elements, report
from quarryline.operators import summarize as S
from quarryline.operators.materialize import cut
from quarryline.plans.stages import Context, Registry, error_rows
from quarryline.sources import scan_directory

KEY = ["codebase", "relative_path"]
#: name of a run over one tree
SINGLE = "all"


class Engine:
    """A configured run over one or several trees; every step is a DataFrame to use by itself.

    ``roots`` maps the names of code bases to their trees; without it there is
    one, the path of the configuration.  All of them go through the same jobs,
    told apart by the column ``codebase``.  The responses are written once, under
    ``work`` or to the shared checkpoint folder, so no provider is called twice
    for a request.
    """

    def __init__(self, spark: SparkSession, cfg: C.Config, *, providers: tuple[S.Provider, ...] = (S.OFFLINE,), stages: Registry | None = None, work: str | None = None, roots: dict[str, str] | None = None):
        self.spark, self.cfg, self.providers, self.work = spark, cfg, providers, work
        self.stages = stages or Registry()
        self.roots = roots or {SINGLE: cfg.codebase_path}

    @classmethod
    def create(cls, spark: SparkSession, source: C.Config | dict | str, **kw) -> Engine:
        """From a configuration, a dict, a settings file, or the path of a tree."""
        if isinstance(source, C.Config):
            cfg = source
        elif isinstance(source, dict):
            cfg = C.from_dict(source)
        elif source.endswith((".toml", ".json")):
            cfg = C.from_dict(C.load_file(source))
        else:
            cfg = C.from_dict(C.template("minimal", source))
        return cls(spark, cfg, **kw)

    def update(self, **changes) -> Engine:
        """A new engine with changed settings, checked again."""
        raw = {k: v for k, v in asdict(replace(self.cfg, **changes)).items()}
        return Engine(self.spark, C.from_dict(raw), providers=self.providers, stages=self.stages, work=self.work, roots=self.roots if "codebase_path" not in changes else None)

    def _at(self, point: str, df: DataFrame, **tables: DataFrame) -> DataFrame:
        """The rows through the steps at a point; what fails there is shown to the steps at ``on_error``."""
        known = len(self.stages.errors)
        out = self.stages.run(point, df, Context(self.cfg, tables=tables), strict=self.cfg.strict_stages)
        if point != "on_error" and len(self.stages.errors) > known and self._listens("on_error"):
            self._at("on_error", self.spark.createDataFrame(self.stages.errors[known:], "point string, source string, error string"))
        return out

    def _listens(self, point: str) -> bool:
        return any(s.supports(point) for s in self.stages.order())

    def providers_of(self, wanted: str | None) -> tuple[S.Provider, ...]:
        """Providers of a stage: those its model names, all if it names none."""
        names = {x for m in C.select_models(self.cfg.models, wanted) for x in (m.name, m.provider, m.model)}
        return tuple(p for p in self.providers if {p.name, p.model} & names) or self.providers

    def files(self) -> DataFrame:
        """The files of all trees; a step before the scan may change the trees and the globs."""
        c = self.cfg
        asked = [(n, p, list(c.include_patterns or ()), None if c.exclude_patterns is None else list(c.exclude_patterns), c.max_file_size) for n, p in self.roots.items()]
        plan = self.spark.createDataFrame(asked, "codebase string, root string, include array<string>, exclude array<string>, max_file_size bigint")
        scans = None
        for r in self._at("before_scan", plan).collect() if self._listens("before_scan") else plan.collect():  # one row a tree
            one = scan_directory(self.spark, r.root, include=tuple(r.include or ()), exclude=None if r.exclude is None else tuple(r.exclude), max_file_size=r.max_file_size, codebase=r.codebase)
            scans = one if scans is None else scans.unionByName(one)
        return self._at("after_scan", scans)

    def route(self, files: DataFrame) -> DataFrame:
        """The files with their tokens and way: empty, regular or large."""
        t = T.count_tokens(F.col("content"))
        blank = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\s]", "")) == ""
        return files.withColumn("tokens", t).withColumn("route", F.when(blank, "empty").when(t > chunking.LARGE * self.cfg.chunk_size, "large").otherwise("regular"))

    def analyse(self, files: DataFrame) -> DataFrame:
        return elements.analyse(files)

    def requests(self, routed: DataFrame) -> DataFrame:
        """One request for each regular file and for each chunk of a large one, a chunk with the hints of its file.

        The hints come from the file's own row, so no join is needed.
        """
        whole = routed.where("route <> 'large'").select(*KEY, "language", "content", F.lit(0).alias("chunk_no"), F.lit("file").alias("chunk_type"), F.lit(None).cast("string").alias("hints"))
        large = elements.analyse(routed.where("route = 'large'").select(*KEY, "language", "content"), keep_all=True)
        found = A.hints(large, *KEY, "language", "content")
        told = F.concat(F.lit("Elements: "), F.array_join("top_elements", ", "), F.lit("; dependencies: "), F.col("dependency_count").cast("string"))
        large = found.select(*KEY, "language", "content", F.when(F.size("top_elements") > 0, told).alias("hints"))
        parts = chunking.chunks(self._at("before_chunk", large), size=self.cfg.chunk_size, overlap=self.cfg.chunk_overlap)
        parts = self._at("after_chunk", parts).select(*KEY, "language", F.col("chunk").alias("content"), "chunk_no", "chunk_type", "hints")
        return self._at("before_request", whole.unionByName(parts))

    def responses(self, requests: DataFrame) -> DataFrame:
        """Answers, written once, so that no call is repeated whatever is done with them."""
        kind = F.when(F.col("chunk_type") == "file", "file").otherwise("chunk")
        path = F.concat_ws("\n", "relative_path", "hints")
        keys = (*KEY, "chunk_no", "chunk_type", "language")
        out = S.summarize(requests, self.providers_of(self.cfg.file_model), keys=keys, retries=max(1, self.cfg.retry_attempts), fallback=self.cfg.enable_fallback, kind=kind, path=path)
        if self.work:
            out.write.mode("overwrite").parquet(f"{self.work}/responses")
            out = self.spark.read.parquet(f"{self.work}/responses")
        else:
            out = cut(out)
        out = self._at("after_response", out)
        if self._listens("on_chunk_complete"):
            of_chunk = F.col("chunk_type") != "file"
            out = out.where(~of_chunk).unionByName(self._at("on_chunk_complete", out.where(of_chunk)), allowMissingColumns=True)
        if self._listens("on_error"):
            self._at("on_error", error_rows(out))
        return out

    def usage(self, responses: DataFrame) -> DataFrame:
        """Tries with their tokens by provider, after the steps that watch them."""
        return A.usage_by_provider(self._at("on_token_usage", S.attempts_of(responses, *KEY)))

    def summaries(self, responses: DataFrame) -> DataFrame:
        per = S.combine_parts(responses, KEY)
        lang = responses.groupBy(*KEY).agg(F.min("language").alias("language"), F.min("error").alias("error"))
        return self._at("on_file_complete", per.join(lang, KEY))

    def masters(self, summaries: DataFrame) -> DataFrame:
        """(codebase, summary, error): one text for each code base.

        One that fits the budget is joined at once, others by the tree of tens.
        Providers that can aggregate write every node anew; without one, nodes
        are joined and cut to their share.  A failure anywhere stands as error.
        """
        providers = tuple(p for p in self.providers_of(self.cfg.aggregation_model) if p.aggregate)
        budget = min((p.budget for p in providers), default=T.DEFAULT_CONTEXT - T.RESERVE)
        text = F.concat(F.col("relative_path"), F.lit(": "), F.col("summary"))
        rows = self._at("before_aggregate", summaries).where(~F.col("summary").startswith("Error:")).select("codebase", "relative_path", text.alias("summary"))
        rows = cut(rows)
        sizes = rows.groupBy("codebase").agg(F.sum(T.count_tokens(F.col("summary"))).alias("tokens"))
        fits = sizes.where(F.col("tokens") <= budget).select("codebase")
        small = A.concat_texts(rows.join(fits, "codebase", "left_semi"), ["codebase"], ["relative_path"], "summary").withColumn("error", F.lit(None).cast("string"))
        nodes = A.positions(rows.join(fits, "codebase", "left_anti"), ["codebase"], ["relative_path"]).select("codebase", "position", "summary")
        levels = A.levels_of(nodes, ["codebase"])
        nodes = nodes.withColumn("error", F.lit(None).cast("string"))
        for _ in range(levels):
            failed = nodes.groupBy("codebase", (F.col("position") / A.FAN_IN).cast("bigint").alias("position")).agg(F.min("error").alias("error"))
            shared = self._at("during_aggregate", A.reduce_once(nodes, ["codebase"], lambda s: s if providers else T.truncate(s, budget // A.FAN_IN)))
            nodes = cut(self._written(shared, providers, ["codebase", "position"]).join(failed.withColumnRenamed("error", "__e"), ["codebase", "position"]).withColumn("error", F.coalesce("__e", "error")).drop("__e"))
        out = self._written(small, providers, ["codebase"]).unionByName(nodes.select("codebase", "summary", "error"))
        return self._at("after_aggregate", cut(out))

    def _written(self, rows: DataFrame, providers: tuple[S.Provider, ...], keys: list[str]) -> DataFrame:
        """The texts as an aggregating provider writes them, with its error; as they are without one."""
        if not providers:
            return rows.select(*keys, "summary", F.lit(None).cast("string").alias("error"))
        asked = rows.select(*keys, "summary", F.lit("mixed").alias("language"))
        out = S.summarize(asked, providers, keys=tuple(keys), text="summary", retries=max(1, self.cfg.retry_attempts), fallback=self.cfg.enable_fallback, kind="aggregate", path=F.col("codebase"))
        return out.select(*keys, "summary", "error")

    def report(self, codebase: str, master: DataFrame, summaries: DataFrame, responses: DataFrame) -> dict:
        """The report of one code base: its text, or previews of its first files where none could be written, and its figures."""
        row = master.where(F.col("codebase") == codebase).first()
        text, error = (row.summary, row.error) if row else ("", None)
        if row and (error or text is None):  # at most ten files for each language
            plain = report.fallback_report(summaries.where(F.col("codebase") == codebase).withColumn("file_id", F.col("relative_path")))
            text = "\n".join(f"- {r.language}: {r.relative_path}: {r.preview}" for r in plain.orderBy("language", "rank").collect())
        own = responses.where(F.col("codebase") == codebase).withColumn("request_id", F.xxhash64("relative_path", "chunk_no"))
        run = A.run_summary(own)
        lines = self._at("before_output", report.report_lines(self.usage(own), run, report.error_counts(own)))
        told = [r[0] for r in lines.orderBy("line_no").select("line").collect()]  # a line for each provider and message
        return {"master": text, "error": error, "statistics": run.first().asDict(), "lines": told}

    def write(self, out: dict, summaries: DataFrame) -> None:
        c = self.cfg
        if not c.output_dest:
            return
        data = None
        if c.output_format == "json":
            data = {"master": out["master"], "files": report.summaries_by_path(summaries), "statistics": out["statistics"]}
        report.write_report(c.output_dest, c.output_format, master=out["master"], lines=out["lines"], data=data)
        if self._listens("after_output"):
            self._at("after_output", self.spark.createDataFrame([(c.output_dest, c.output_format)], "path string, format string"))

    def run_all(self) -> dict[str, dict]:
        """Reports by code base; scan, analysis, requests and reduce run once for all of them."""
        responses = self.responses(self.requests(self.route(self.files())))
        summaries = cut(self.summaries(responses))
        masters = self.masters(summaries)
        return {name: self.report(name, masters, summaries, responses) | {"summaries": summaries.where(F.col("codebase") == name)} for name in self.roots}

    def run(self) -> dict:
        """The report of the tree, or of all trees together in one file, written where the settings say."""
        out = self.run_all()[next(iter(self.roots))]
        self.write(out, out.pop("summaries"))
        return out


def analyse_batch(spark: SparkSession, paths: dict[str, str], *, providers: tuple[S.Provider, ...] = (S.OFFLINE,), stages: Registry | None = None, work: str | None = None, **settings) -> tuple[dict[str, dict], dict[str, str]]:
    """Runs over several code bases in one set of jobs: results and failures by name.

    A tree that cannot be listed is a failure of its own and stops no other.
    """
    good, failed = {}, {}
    for name, path in paths.items():
        try:
            scan_directory(spark, path)
            good[name] = path
        except Exception as e:  # noqa: BLE001 - one code base does not stop the others
            failed[name] = f"{type(e).__name__}: {e}"
    if not good:
        return {}, failed
    cfg = C.from_dict(C.merge(C.template("minimal", next(iter(good.values()))), {"output_dest": "", **settings}))
    done = Engine(spark, cfg, providers=providers, stages=stages, work=work, roots=good).run_all()
    return {n: {k: v for k, v in r.items() if k != "summaries"} for n, r in done.items()}, failed


class Workflow:
    """Method-chained batch: add code bases, connect follow-up steps, run."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._after = spark, {}, []

    def add(self, name: str, path: str) -> Workflow:
        self._paths[name] = path
        return self

    def then(self, step) -> Workflow:
        self._after.append(step)
        return self

    def run(self, **settings) -> dict:
        done, failed = analyse_batch(self.spark, self._paths, **settings)
        out = {"results": done, "failures": failed, "success_rate": len(done) / max(1, len(self._paths))}
        for s in self._after:
            out = s(out)
        return out


def summarize(spark: SparkSession, path: str, **settings) -> dict:
    """The whole run over a tree with given settings."""
    return Engine(spark, C.from_dict(C.merge(C.template("minimal", path), settings))).run()


def summarize_file(spark: SparkSession, path: str) -> dict:
    """The whole run over one file."""
    import os

    return summarize(spark, os.path.dirname(os.path.abspath(path)), include_patterns=[os.path.basename(path)], exclude_patterns=[], output_dest="")
