"""Registry of the core queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import config as C
from quarryline.functions import paths as P
from quarryline.functions import text as T
from quarryline.operators import aggregates as A
from quarryline.operators import chunking, elements, lookups, report
from quarryline.operators import summarize as S
from quarryline.plans import stages
from quarryline.sources import profile_figures, scan_directory, spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(col: str, names: dict, default: str) -> str:
    return f"case {col} " + " ".join(f"when {_q(k)} then {_q(v) if isinstance(v, str) else v}" for k, v in names.items()) + f" else {default} end"


EXT_SQL = r"lower(regexp_extract(relative_path, '[^/.][^/]*?(\.[^/.]+)$', 1))"
LANG_SQL = _case(EXT_SQL, P.LANGUAGES, "'unknown'")
TOK_SQL = "cast(coalesce((length(content) + 3) // 4, 0) as bigint)"
#: one record for each id; the ids of the files table repeat only as whole rows
FILES_SQL = "(select distinct file_id, codebase, path, relative_path, content from files)"


def _files(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Files by id and path, with the language their path stands for."""
    keep = ["file_id", "relative_path", *[c for c in cols if c not in ("file_id", "relative_path")]]
    return table(spark, d, "files", *keep).withColumn("language", P.language(F.col("relative_path")))


# -- sources, filters, routing
@query(
    f"select distinct file_id, {EXT_SQL} as extension, {LANG_SQL} as language, substring(md5(path), 1, 8) as hash, cast(coalesce(octet_length(encode(content)), 0) as bigint) as bytes from files"
)
def s01_file_inventory(spark, d):
    p = F.col("relative_path")
    return table(spark, d, "files", "file_id", "path", "relative_path", "content").select("file_id", P.extension(p).alias("extension"), P.language(p).alias("language"), P.file_id(F.col("path")).alias("hash"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("bytes")).distinct()


@query()
def s02_directory_scan(spark, d):
    return scan_directory(spark, __file__.rsplit("/", 1)[0], include=("*.py",), exclude=("*/__pycache__/*",)).select("relative_path", "language", "size", "hash")


@query(f"select count(*) as files, cast(sum(b) as bigint) as bytes, count(distinct g) as languages from (select distinct file_id, {LANG_SQL} as g, coalesce(octet_length(encode(content)), 0) as b from files)")
def s03_profile_scan(spark, d):
    return profile_figures(_files(spark, d, "content").select("file_id", "language", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes")).distinct())


#: fixed values: the registry as it has to come out
_REGISTRY_SQL = """(values ('minimax', 'MiniMax', 'https://api.minimax.io/anthropic', 'MINIMAX_API_KEY'), ('deepseek', 'DeepSeek', 'https://api.deepseek.com/anthropic', 'DEEPSEEK_API_KEY'), ('anthropic', 'Anthropic', '', 'ANTHROPIC_API_KEY'),
('openai', 'OpenAI', 'https://api.openai.com/v1', 'OPENAI_API_KEY'), ('perplexity', 'Perplexity', 'https://api.perplexity.ai', 'PPLX_API_KEY'), ('kimi', 'Kimi', 'https://api.moonshot.cn/v1', 'KIMI_API_KEY'),
('qwen', 'Qwen', 'https://dashscope.aliyuncs.com/compatible-mode/v1', 'QWEN_API_KEY'), ('ollama', 'Ollama', 'http://localhost:11434/v1', 'OLLAMA_API_KEY'), ('offline', 'Offline', '', '')) t(name, label, base_url, env)"""


@query(f"select * from {_REGISTRY_SQL}")
def s10_provider_registry(spark, d):
    return spark.createDataFrame([(n, *v) for n, v in C.PROVIDERS.items()], "name string, label string, base_url string, env string")


@query(
    f"select m.name, m.provider, coalesce(nullif(m.base_url, ''), r.base_url, '') as endpoint, coalesce(r.label, m.provider) as label, coalesce(r.env, upper(m.provider) || '_API_KEY') as env from (select name, provider, base_url from models union all values ('local', 'mill', null)) m left join {_REGISTRY_SQL.replace(' t(', ' r(')} on r.name = m.provider"
)
def j05_provider_endpoints(spark, d):
    """Models with the endpoint and key of their provider; an unknown provider gets what its name implies."""
    m = table(spark, d, "models", "name", "provider", "base_url").unionByName(spark.createDataFrame([("local", "mill", None)], "name string, provider string, base_url string"))
    r = s10_provider_registry(spark, d).select(F.col("name").alias("provider"), "label", F.col("base_url").alias("url"), "env")
    out = m.join(r, "provider", "left")
    return out.select("name", "provider", F.coalesce(F.nullif("base_url", F.lit("")), "url", F.lit("")).alias("endpoint"), F.coalesce("label", "provider").alias("label"), F.coalesce("env", F.concat(F.upper("provider"), F.lit("_API_KEY"))).alias("env"))


#: fixed values: names that exclude what lies under them or bears them, and beginnings and ends that do
_EXCLUDED_SQL = """list_has_any(string_split(relative_path, '/'), ['.git', '.svn', '.hg', '.bzr', '_darcs', 'node_modules', '.venv', 'venv', 'env', '.env', '.conda', '.pix', '.direnv', '.uv', 'vendor', '.pnpm-store', '__pycache__', 'target', 'build', 'dist',
'.gradle', '.m2', '.cargo', '.nuget', '.pytest_cache', '.tox', '.nox', 'coverage', '.nyc_output', '.jacoco', '.hypothesis', '.next', '.nuxt', '.svelte-kit', '.turbo', '.parcel-cache', '.cache', '__pypackages__', '.vscode', '.idea', '.vs', '.atom',
'.sublime', '.emacs.d', '.vim', '.nvim', '.DS_Store', 'Thumbs.db', 'desktop.ini', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'Cargo.lock', 'go.sum', 'composer.lock', '.gitignore'])
or len(list_filter(string_split(relative_path, '/'), lambda p: starts_with(p, '._') or starts_with(p, '.env') or ends_with(p, '.log') or ends_with(p, '.tmp'))) > 0 or contains(string_split(relative_path, '/')[-1], 'test')"""


@query(f"select distinct file_id, {_EXCLUDED_SQL} as excluded from files where relative_path is not null")
def f01_exclude_globs(spark, d):
    return table(spark, d, "files", "file_id", "relative_path").where("relative_path is not null").select("file_id", P.excluded(F.col("relative_path")).alias("excluded")).distinct()


@query("select distinct file_id from files where ends_with(relative_path, '.py') or ends_with(relative_path, '.rs') or ends_with(relative_path, '.go') or ends_with(relative_path, '.js') or ends_with(relative_path, '.ts')")
def f05_include_globs(spark, d):
    return table(spark, d, "files", "file_id", "relative_path").where(P.included(F.col("relative_path"))).select("file_id").distinct()


@query("select distinct file_id, size from files where size <= 2000")
def f03_size_filter(spark, d):
    return table(spark, d, "files", "file_id", "size").where("size <= 2000").distinct()


@query(
    f"select distinct file_id, case when {EXT_SQL} in ({', '.join(map(_q, P.BINARY_SUFFIXES))}) then false when {EXT_SQL} in ({', '.join(map(_q, P.LANGUAGES))}) then true else not (instr(coalesce(content, ''), chr(0)) > 0 and octet_length(encode(substring(content, 1, instr(content, chr(0)) - 1))) < 512) end as is_text from files"
)
def f04_text_sniff(spark, d):
    return table(spark, d, "files", "file_id", "relative_path", "content").select("file_id", P.looks_text(F.col("relative_path"), F.col("content")).alias("is_text")).distinct()


@query("select distinct file_id, 'Empty file' as summary, 0 as tokens_used from files where regexp_matches(coalesce(content, ''), '^[ \\t\\r\\n\\f]*$')")
def f07_blank_files(spark, d):
    return table(spark, d, "files", "file_id", "content").where(F.coalesce("content", F.lit("")).rlike(r"^[ \t\r\n\f]*\z")).select("file_id", F.lit("Empty file").alias("summary"), F.lit(0).alias("tokens_used")).distinct()


@query(f"select distinct file_id, {TOK_SQL} as tokens, case when regexp_matches(coalesce(content, ''), '^[ \\t\\r\\n\\f]*$') then 'empty' when {TOK_SQL} > 400 then 'large' else 'regular' end as route, case when {TOK_SQL} > 100 then 'file' else 'chunk' end as prompt from files")
def f08_route(spark, d):
    t = T.count_tokens(F.col("content"))
    blank = F.coalesce("content", F.lit("")).rlike(r"^[ \t\r\n\f]*\z")
    return table(spark, d, "files", "file_id", "content").select("file_id", t.alias("tokens"), F.when(blank, "empty").when(t > 4 * 100, "large").otherwise("regular").alias("route"), F.when(t > 100, "file").otherwise("chunk").alias("prompt")).distinct()


@query("select distinct response_id from responses where error is null and summary is not null and not starts_with(summary, 'Error:')")
def f09_valid_summaries(spark, d):
    return table(spark, d, "responses", "response_id", "summary", "error").where("error is null and summary is not null and not startswith(summary, 'Error:')").select("response_id").distinct()


@query("select m.name, w.wanted from models m, (values ('fast'), ('loom-long'), ('nothing')) w(wanted) where m.name = w.wanted or m.model = w.wanted or not exists (select 1 from models x where x.name = w.wanted or x.model = w.wanted)")
def f11_stage_models(spark, d):
    # a fixed table of settings, chosen on the driver
    models = tuple(C.ModelConfig(r["name"], r["provider"], r["model"]) for r in table(spark, d, "models", "name", "provider", "model").collect())
    return spark.createDataFrame([(m.name, w) for w in ("fast", "loom-long", "nothing") for m in C.select_models(models, w)], "name string, wanted string")


@query("select distinct name, case when starts_with(model, 'claude-') then 'anthropic' when starts_with(model, 'sonar-') then 'perplexity' else 'openai' end as provider from models")
def f12_provider_detection(spark, d):
    return table(spark, d, "models", "name", "model").select("name", T.provider_of(F.col("model")).alias("provider")).distinct()


@query(f"select coalesce({_case(LANG_SQL, elements.BY_LANGUAGE, 'null')}, {_case(EXT_SQL, elements.BY_SUFFIX, 'null')}, 'skipped') as parser, count(distinct file_id) as files from files group by 1")
def f13_parser_routing(spark, d):
    return _files(spark, d).select(F.coalesce(elements.parser_key(F.col("language"), F.col("relative_path")), F.lit("skipped")).alias("parser"), "file_id").groupBy("parser").agg(F.count_distinct("file_id").alias("files"))


_CASES = [
    ("empty", {}),
    ("good", C.template("multi", "/x")),
    ("size", {**C.template("minimal", "/x"), "chunk_size": 99}),
    ("workers", {**C.template("minimal", "/x"), "max_workers": 33, "timeout": 4}),
    ("bool", {**C.template("minimal", "/x"), "retry_attempts": True}),
    ("provider", {"codebase_path": "/x", "models": [{"name": "a", "provider": "nobody", "model": "m"}]}),
    ("format", {**C.template("minimal", "/x"), "output_format": "pdf"}),
]


@query(
    "select * from (values ('empty', 'codebase_path is required'), ('empty', 'models must be a list that is not empty'), ('size', 'chunk_size must lie in 100..50000'), ('size', 'chunk_overlap must lie in 0..chunk_size-1'),"
    " ('workers', 'max_workers must lie in 1..32'), ('workers', 'timeout must lie in 5..300'), ('bool', 'retry_attempts must be a number'), ('provider', 'models[0].provider is unknown'), ('format', 'output_format is unknown')) t(name, message)"
)
def f15_config_violations(spark, d):
    return spark.createDataFrame([(n, m) for n, c in _CASES for m in C.violations(c)], "name string, message string")


# -- scalar functions
@query(f"select distinct file_id, {TOK_SQL} as tokens from files")
def x01_token_counts(spark, d):
    return table(spark, d, "files", "file_id", "content").select("file_id", T.count_tokens(F.col("content")).alias("tokens")).distinct()


@query(
    f"select name, model, {_case('model', T.CONTEXT_LIMITS, '4096')} as context_limit, least({_case('model', T.CONTEXT_LIMITS, '4096')} - 1000, coalesce(max_tokens, 16000)) as budget from (select name, model, max_tokens from models union all values ('a', 'gpt-4o', 16000), ('b', 'claude-2.1', 300000))"
)
def x05_content_budget(spark, d):
    m = table(spark, d, "models", "name", "model", "max_tokens").unionByName(spark.createDataFrame([("a", "gpt-4o", 16000), ("b", "claude-2.1", 300000)], "name string, model string, max_tokens int"))
    return m.select("name", "model", T.context_limit(F.col("model")).alias("context_limit"), T.content_budget(F.col("model"), F.col("max_tokens")).alias("budget"))


@query(f"select distinct file_id, md5(case when {TOK_SQL} <= 120 then content else concat(substring(content, 1, 440), chr(10) || '[cut to fit]') end) as cut_md5, length(case when {TOK_SQL} <= 120 then content else concat(substring(content, 1, 440), chr(10) || '[cut to fit]') end) as n from files where content is not null")
def x04_truncate(spark, d):
    cut = T.truncate(F.col("content"), 120)
    return table(spark, d, "files", "file_id", "content").where("content is not null").select("file_id", F.md5(cut).alias("cut_md5"), F.length(cut).cast("bigint").alias("n")).distinct()


@query("select distinct file_id, length(substring(content, 1, 500)) - length(replace(substring(content, 1, 500), chr(10), '')) as line from files where content is not null")
def x08_line_of_offset(spark, d):
    return table(spark, d, "files", "file_id", "content").where("content is not null").select("file_id", T.line_index(F.col("content"), F.lit(500)).cast("bigint").alias("line")).distinct()


def _blocks(spark, d, suffix, opener, indented):
    """Blocks of the files of a suffix: one walk over each text, only spans leave it."""
    rows = spread(table(spark, d, "files", "file_id", "relative_path", "content").where(f"content is not null and endswith(relative_path, '{suffix}')"))
    spans = rows.select("file_id", F.explode(lookups.blocks(F.col("content"), opener, indented=indented)).alias("b"))
    return spans.select("file_id", F.col("b.start_line").cast("bigint").alias("start_line"), F.col("b.end_line").cast("bigint").alias("end_line")).distinct()


@query(
    r"""with f as (select distinct file_id, string_split(content, chr(10)) as ls from files where content is not null and ends_with(relative_path, '.go')),
s as (select file_id, ls, i from f, unnest(range(0, len(ls))) r(i) where regexp_matches(ls[i + 1], '^func ')),
c as (select file_id, i, len(ls) as n, j, sum(length(ls[j + 1]) - length(replace(ls[j + 1], '{', '')) - (length(ls[j + 1]) - length(replace(ls[j + 1], '}', '')))) over (partition by file_id, i order by j) as depth from s, unnest(range(i, len(ls))) r(j))
select file_id, i as start_line, coalesce(min(case when j > i and depth <= 0 then j + 1 end), max(n)) as end_line from c group by file_id, i"""
)
def x09_brace_blocks(spark, d):
    return _blocks(spark, d, ".go", "func ", False)


@query(
    r"""with f as (select distinct file_id, string_split(content, chr(10)) as ls from files where content is not null and ends_with(relative_path, '.py')),
s as (select file_id, ls, i from f, unnest(range(0, len(ls))) r(i) where regexp_matches(ls[i + 1], '^[ ]*(?:async )?def ')),
c as (select file_id, i, len(ls) as n, j, length(ls[j + 1]) - length(ltrim(ls[j + 1])) as d, length(ls[i + 1]) - length(ltrim(ls[i + 1])) as d0, trim(replace(replace(ls[j + 1], chr(9), ''), chr(13), '')) as body from s, unnest(range(i, len(ls))) r(j))
select file_id, i as start_line, coalesce(min(case when j > i and body <> '' and d <= d0 then j end), max(n)) as end_line from c group by file_id, i"""
)
def x10_indent_blocks(spark, d):
    return _blocks(spark, d, ".py", "[ ]*(?:async )?def ", True)


@query(
    "select distinct file_id, len(string_split(coalesce(content, ''), chr(10))) as total_lines, len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\r\\f]', '', 'g')) <> '')) as code_lines, case when len(string_split(coalesce(content, ''), chr(10))) > 50 then 'medium' else 'low' end as complexity from files"
)
def x12_line_metrics(spark, d):
    m = T.line_metrics(F.col("content"))
    return table(spark, d, "files", "file_id", "content").select("file_id", m["total_lines"].cast("bigint").alias("total_lines"), m["code_lines"].cast("bigint").alias("code_lines"), m["complexity"].alias("complexity")).distinct()


@query(
    r"""with l as (select distinct file_id, trim(unnest(string_split(content, chr(10)))) as line from files where ends_with(relative_path, '.java') or ends_with(relative_path, '.rs'))
select case when regexp_matches(line, '(^|[^A-Za-z0-9_])pub(lic)?($|[^A-Za-z0-9_])') then 'public' when regexp_matches(line, '(^|[^A-Za-z0-9_])private($|[^A-Za-z0-9_])') then 'private' when regexp_matches(line, '(^|[^A-Za-z0-9_])protected($|[^A-Za-z0-9_])') then 'protected' else 'private' end as visibility, count(*) as lines
from l where regexp_matches(line, '^(pub|public|private|protected)[ (]') group by 1"""
)
def x13_visibility(spark, d):
    rows = table(spark, d, "files", "file_id", "relative_path", "content").where("endswith(relative_path, '.java') or endswith(relative_path, '.rs')").select("file_id", F.explode(F.split("content", "\n")).alias("x")).select("file_id", F.trim("x").alias("line")).where(F.col("line").rlike("^(pub|public|private|protected)[ (]")).distinct()
    return rows.groupBy(T.visibility(F.col("line")).alias("visibility")).agg(F.count("*").alias("lines"))


@query(f"select distinct file_id, round(least(1.0, 0.7 + (case when {LANG_SQL} <> 'unknown' then 0.1 else 0.0 end) + (case when contains(coalesce(content, ''), '{{') then 0.1 else 0.0 end)), 2)::double as confidence from files")
def x14_confidence(spark, d):
    return _files(spark, d, "content").select("file_id", T.confidence(F.lit(0.7), F.col("language") != "unknown", F.contains(F.coalesce("content", F.lit("")), F.lit("{"))).cast("double").alias("confidence")).distinct()


@query(
    r"""with s as (select distinct trim(regexp_extract(unnest(string_split(content, chr(10))), '^([^{}@;/]+)\{', 1)) as selector from files where ends_with(relative_path, '.css'))
select selector, 100 * len(regexp_extract_all(selector, '#[A-Za-z_-][A-Za-z0-9_-]*')) + 10 * len(regexp_extract_all(selector, '\.[A-Za-z_-][A-Za-z0-9_-]*|\[[^\]]*\]|:[A-Za-z-]+')) + len(regexp_extract_all(regexp_replace(selector, '[#.:][A-Za-z0-9_-]+|\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[A-Za-z][A-Za-z0-9]*')) as specificity from s where selector <> ''"""
)
def x15_css_specificity(spark, d):
    rows = table(spark, d, "files", "relative_path", "content").where("endswith(relative_path, '.css')").select(F.explode(F.split("content", "\n")).alias("line"))
    rows = rows.select(F.trim(F.regexp_extract("line", r"^([^{}@;/]+)\{", 1)).alias("selector")).where("selector <> ''").distinct()
    return rows.select("selector", T.css_specificity(F.col("selector")).alias("specificity"))


@query(
    "select distinct response_id, printf('%.2f seconds', round(cast(processing_time as decimal(18,6)), 2)::double) as elapsed, case when processing_time * 20 < 60 then printf('%.1fs', round(cast(processing_time * 20 as decimal(18,6)), 1)::double) when processing_time * 20 < 3600 then printf('%.1fm', round(cast(processing_time * 20 / 60 as decimal(18,6)), 1)::double) else printf('%.1fh', round(cast(processing_time * 20 / 3600 as decimal(18,6)), 1)::double) end as duration, round(tokens_used * 0.00002::double, 6) as cost from responses where processing_time is not null and tokens_used is not null"
)
def x24_durations_and_cost(spark, d):
    s = F.col("processing_time")
    return table(spark, d, "responses", "response_id", "processing_time", "tokens_used").where("processing_time is not null and tokens_used is not null").select("response_id", T.elapsed_text(s).alias("elapsed"), T.duration_text(s * 20).alias("duration"), T.cost(F.col("tokens_used")).alias("cost")).distinct()


@query(f"select distinct file_id, md5(concat(substring(content, 1, 200), '...')) as preview_md5, upper(substring({LANG_SQL}, 1, 1)) || substring({LANG_SQL}, 2) as title, round(size / 1048576.0::double, 2) as mb from files where content is not null")
def x28_preview_title_size(spark, d):
    return _files(spark, d, "content", "size").where("content is not null").select("file_id", F.md5(T.preview(F.col("content"))).alias("preview_md5"), T.title_case(F.col("language")).alias("title"), T.megabytes(F.col("size")).alias("mb")).distinct()


@query(f"select distinct file_id, md5('Describe the purpose, structure and dependencies of this ' || {LANG_SQL} || ' file.' || chr(10) || 'Path: ' || relative_path || chr(10) || chr(10) || content) as prompt_md5 from files where content is not null and relative_path is not null")
def x31_prompts(spark, d):
    p = T.prompt("file", language=F.col("language"), path=F.col("relative_path"), content=F.col("content"))
    return _files(spark, d, "content").where("content is not null and relative_path is not null").select("file_id", F.md5(p).alias("prompt_md5")).distinct()


@query("select distinct response_id, coalesce(summary, '') || ' by ' || coalesce(model_used, '') as text from responses")
def x27_response_text(spark, d):
    """Text blocks of an answer joined, a block of another type between them left out."""
    block = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    blocks = F.array(block("text", F.col("summary")), block("tool", F.col("provider_used")), block("text", F.lit(" by ")), block("text", F.col("model_used")))
    return table(spark, d, "responses", "response_id", "summary", "provider_used", "model_used").select("response_id", T.join_blocks(blocks).alias("text")).distinct()


@query("select distinct attempt, power(2.0, attempt - 1) as seconds from attempts where attempt is not null")
def x32_backoff(spark, d):
    return table(spark, d, "attempts", "attempt").where("attempt is not null").distinct().select("attempt", S.backoff_seconds(F.col("attempt")).alias("seconds"))


# -- table-generating operators
def _pack_sql(size: int, overlap: int) -> str:
    return f"""with recursive f as (select distinct file_id, string_split(content, chr(10)) as ls from files where content is not null and content <> ''),
a as (select file_id, ls, len(ls) as n, list_transform(range(0, len(ls)), lambda i: list_sum(list_transform(ls[1:i + 1], lambda x: (length(x) + 3) // 4))) as cum from f),
c as (select file_id, ls, n, cum, 0 as chunk_no, 0::bigint as s, coalesce(list_min(list_filter(range(1, n), lambda i: cum[i + 1] > {size})), n)::bigint as e from a
  union all
  select file_id, ls, n, cum, chunk_no + 1, e - ((e - s) * {overlap} // {size}),
    coalesce(list_min(list_filter(range(e + 1, n), lambda i: cum[i + 1] - (case when e - ((e - s) * {overlap} // {size}) = 0 then 0 else cum[e - ((e - s) * {overlap} // {size})] end) > {size})), n)::bigint from c where e < n)
select file_id, chunk_no::bigint as chunk_no, s as start_line, e as end_line, cast((length(array_to_string(ls[s + 1:e], chr(10))) + 3) // 4 as bigint) as tokens from c"""


def _packed(spark, d, size, overlap):
    rows = chunking.chunks(spread(_files(spark, d, "content")), size=size, overlap=overlap, strategy="generic", with_text=False)
    return rows.select("file_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "tokens").distinct()


@query(_pack_sql(100, 0))
def g04_chunks(spark, d):
    return _packed(spark, d, 100, 0)


@query(_pack_sql(100, 20))
def g04_chunks_overlap(spark, d):
    return _packed(spark, d, 100, 20)


@query()
def g01_chunks_by_language(spark, d):
    """Syntax-tree chunks for Python, pattern chunks for Rust, Go and scripts, packed lines for the rest, oversize ones re-split."""
    rows = chunking.chunks(spread(_files(spark, d, "content")), size=200, overlap=40, with_text=False)
    return rows.select("file_id", "chunk_no", "start_line", "end_line", "chunk_type", "tokens").distinct()


@query(_pack_sql(200, 40).replace("content <> ''", f"content <> '' and {EXT_SQL} not in ('.py', '.rs', '.js', '.ts')"))
def g01_chunks_by_lines(spark, d):
    """Files of the languages that are dispatched to the packer, those without a parser of chunks included."""
    rows = _files(spark, d, "content").where(~F.col("language").isin("python", *chunking.BY_PATTERN))
    out = chunking.chunks(spread(rows), size=200, overlap=40, with_text=False, optimise=False)
    return out.select("file_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "tokens").distinct()


_RUST_KINDS = (("function", "(?:pub(?:[(][^)]*[)])?[ \\t]+)?(?:async[ \\t]+|unsafe[ \\t]+|const[ \\t]+)*fn[ \\t]+[A-Za-z0-9_]"), ("struct", "(?:pub(?:[(][^)]*[)])?[ \\t]+)?(?:struct|enum)[ \\t]+[A-Za-z0-9_]"), ("impl", "impl\\b"), ("trait", "(?:pub(?:[(][^)]*[)])?[ \\t]+)?trait[ \\t]+[A-Za-z0-9_]"))


@query(
    f"""with f as (select distinct file_id, string_split(content, chr(10)) as ls from files where content is not null and {EXT_SQL} = '.rs'),
s as (select file_id, ls, i, k.kind from f, unnest(range(0, len(ls))) r(i), (values {', '.join(f"({_q(n)}, {_q('^' + x)})" for n, x in _RUST_KINDS)}) k(kind, rx) where regexp_matches(ls[i + 1], k.rx)),
c as (select file_id, kind, i, len(ls) as n, j, sum(length(ls[j + 1]) - length(replace(ls[j + 1], '{{', '')) - (length(ls[j + 1]) - length(replace(ls[j + 1], '}}', '')))) over (partition by file_id, kind, i order by j) as depth from s, unnest(range(i, len(ls))) r(j)),
b as (select file_id, kind, i as start_line, coalesce(min(case when j > i and depth <= 0 then j + 1 end), max(n)) as end_line from c group by file_id, kind, i)
select file_id, kind as chunk_type, start_line, end_line, ((length(array_to_string(ls[start_line + 1:end_line], chr(10))) + 3) // 4)::bigint as tokens from b join f using (file_id) where (length(array_to_string(ls[start_line + 1:end_line], chr(10))) + 3) // 4 > 50"""
)
def g03_pattern_chunks(spark, d):
    """Blocks of Rust files by pattern, with more than 50 tokens; files without one are packed by lines and left out here."""
    out = chunking.chunks(spread(_files(spark, d, "content").where("language = 'rust'")), size=200, overlap=40, with_text=False, optimise=False).where("chunk_type <> 'block'")
    return out.select("file_id", "chunk_type", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "tokens").distinct()


@query("with l as (select distinct file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as line_no from files where content is not null) select file_id, count(*) as lines, sum(length(line))::bigint as characters, max(line_no)::bigint as last_line from l group by file_id")
def g08_lines(spark, d):
    # the lines of a row meet where they are; repeated rows are told apart by their number and dropped as figures
    rows = table(spark, d, "files", "file_id", "content").where("content is not null").withColumn("row", F.monotonically_increasing_id())
    lines = chunking.explode_lines(rows).groupBy("file_id", "row").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("bigint").alias("characters"), F.max("line_no").cast("bigint").alias("last_line"))
    return lines.drop("row").distinct()


def _parsed(spark, d, language: str | None = None):
    rows = _files(spark, d, "content")
    return elements.analyse(spread(rows.where(F.col("language") == language) if language else rows))


def _analysed(spark, d):
    return _parsed(spark, d)


@query()
def g06_elements(spark, d):
    return elements.elements(_analysed(spark, d), "file_id").drop("element_no").distinct()


@query()
def g07_dependencies(spark, d):
    return elements.dependencies(_analysed(spark, d), "file_id").distinct()


def _line_sql(suffix: str, rx: str, cols: str) -> str:
    return f"with l as (select distinct file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n from files where {EXT_SQL} = '{suffix}') select file_id, {cols} from l where regexp_matches(line, {_q(rx)})"


_RUST_FN = r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:async|unsafe|const)[ \t]+)*fn[ \t]+([A-Za-z0-9_]+)"


@query(_line_sql(".rs", _RUST_FN, f"regexp_extract(line, {_q(_RUST_FN)}, 1) as name, n::bigint as start_line, case when regexp_matches(line, '^[ \\t]*pub') then 'public' else 'private' end as visibility"))
def g06_rust_functions(spark, d):
    return elements.elements(_parsed(spark, d, "rust"), "file_id").where("pattern = 'function'").select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line"), "visibility").distinct()


_GO_METHOD = r"^func[ \t]*\([^)\n]*\)[ \t]*([A-Za-z0-9_]+)"


@query(_line_sql(".go", _GO_METHOD, f"regexp_extract(line, {_q(_GO_METHOD)}, 1) as name, n::bigint as start_line, case when regexp_matches(regexp_extract(line, {_q(_GO_METHOD)}, 1), '^[A-Z]') then 'public' else 'private' end as visibility"))
def g06_go_methods(spark, d):
    return elements.elements(_parsed(spark, d, "golang"), "file_id").where("pattern = 'method'").select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line"), "visibility").distinct()


_SQL_TABLE = r"^[ \t]*(?i:create)[ \t]+(?i:table)[ \t]+(?i:if[ \t]+not[ \t]+exists[ \t]+)?([A-Za-z0-9_.]+)"


@query(_line_sql(".sql", _SQL_TABLE, f"regexp_extract(line, {_q(_SQL_TABLE)}, 1) as name, n::bigint as start_line"))
def g06_sql_tables(spark, d):
    return elements.elements(_parsed(spark, d, "sql"), "file_id").where("pattern = 'table'").select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line")).distinct()


_JAVA_IMPORT = r"^[ \t]*import[ \t]+([A-Za-z0-9_.*]+)[ \t]*;"


@query(_line_sql(".java", _JAVA_IMPORT, f"regexp_extract(line, {_q(_JAVA_IMPORT)}, 1) as source, n::bigint as line_number"))
def g07_java_imports(spark, d):
    return elements.dependencies(_parsed(spark, d, "java"), "file_id").where("import_type = 'import'").select("file_id", "source", F.col("line_number").cast("bigint").alias("line_number")).distinct()


_RUST_USE = r"^[ \t]*use[ \t]+([A-Za-z0-9_:]+)[ \t]*;"


@query(_line_sql(".rs", _RUST_USE, f"regexp_extract(line, {_q(_RUST_USE)}, 1) as source, n::bigint as line_number"))
def g09_rust_uses(spark, d):
    return elements.dependencies(_parsed(spark, d, "rust"), "file_id").where("import_type = 'use'").select("file_id", "source", F.col("line_number").cast("bigint").alias("line_number")).distinct()


def _register(name: str, sql: str, f: Query) -> None:
    f.__name__ = name
    query(sql)(f)


def _lines_of(suffixes: tuple[str, ...]) -> str:
    return f"(select distinct file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n from files where {EXT_SQL} in ({', '.join(map(_q, suffixes))}))"


def _element_query(name: str, pattern: str, parsers: tuple[str, ...], suffixes: tuple[str, ...], rx: str) -> None:
    """Names and lines of one kind of element, against a pattern of its own over the lines."""

    def run(spark, d):
        rows = table(spark, d, "files", "file_id", "relative_path", "content").where(P.extension(F.col("relative_path")).isin(*suffixes)).withColumn("language", P.language(F.col("relative_path")))
        found = elements.elements(elements.analyse(spread(rows)), "file_id").where((F.col("pattern") == pattern) & F.col("parser").isin(*parsers))
        return found.select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line")).distinct()

    _register(name, f"select distinct file_id, regexp_extract(line, {_q(rx)}, 1) as name, n::bigint as start_line from {_lines_of(suffixes)} where regexp_matches(line, {_q(rx)})", run)


def _dependency_query(name: str, kinds: tuple[str, ...], suffixes: tuple[str, ...], rx: str) -> None:
    """Sources and lines of one kind of dependency, against a pattern of its own over the lines."""

    def run(spark, d):
        rows = table(spark, d, "files", "file_id", "relative_path", "content").where(P.extension(F.col("relative_path")).isin(*suffixes)).withColumn("language", P.language(F.col("relative_path")))
        found = elements.dependencies(elements.analyse(spread(rows)), "file_id").where(F.col("import_type").isin(*kinds))
        return found.select("file_id", "source", F.col("line_number").cast("bigint").alias("line_number")).distinct()

    _register(name, f"select distinct file_id, unnest(regexp_extract_all(line, {_q(rx)}, 1)) as source, n::bigint as line_number from {_lines_of(suffixes)}", run)


_element_query("g06_python_defs", "def", ("python",), (".py",), r"^[ \t]*(?:async +)?def +([A-Za-z0-9_]+)")
_element_query("g06_python_classes", "class", ("python",), (".py",), r"^[ \t]*class +([A-Za-z0-9_]+)")
_element_query("g06_js_functions", "function", ("javascript", "typescript"), (".js", ".ts"), r"^[ \t]*(?:export +(?:default +)?)?(?:async +)?function *[*]? *([A-Za-z_$][A-Za-z0-9_$]*) *(?:<[^>(]*>)?[(]")
_element_query("g06_ts_interfaces", "interface", ("typescript",), (".ts",), r"^[ \t]*(?:export +)?(?:declare +)?interface +([A-Za-z_$][A-Za-z0-9_$]*)")
_element_query("g06_go_functions", "function", ("golang",), (".go",), r"^[ \t]*func +([A-Za-z0-9_]+) *[[(]")
_element_query("g06_go_structs", "struct", ("golang",), (".go",), r"^[ \t]*type +([A-Za-z0-9_]+) +struct\b")
_element_query("g06_java_classes", "class", ("java",), (".java",), r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed) +)*class +([A-Za-z0-9_]+)")
_element_query("g06_rust_structs", "struct", ("rust",), (".rs",), r"^[ \t]*(?:pub(?:[(][^)]*[)])? +)?struct +([A-Za-z0-9_]+)")
_element_query("g06_rust_enums", "enum", ("rust",), (".rs",), r"^[ \t]*(?:pub(?:[(][^)]*[)])? +)?enum +([A-Za-z0-9_]+)")
_element_query("g06_bash_functions", "function", ("bash",), (".sh",), r"^[ \t]*(?:function +)?([A-Za-z_][A-Za-z0-9_.:-]*) *[(][)] *[{]")
_element_query("g06_settings_sections", "section", ("generic",), (".ini", ".cfg", ".conf", ".toml"), r"^[ \t]*\[([^\]]+)\][ \t]*$")
_element_query("g06_sql_indexes", "index", ("sql",), (".sql",), r"^[ \t]*(?i:create) +(?i:unique +)?(?i:index) +(?i:if +not +exists +)?([A-Za-z0-9_.]+)")
_dependency_query("g07_python_from", ("from",), (".py",), r"^[ \t]*from +([.A-Za-z0-9_]+) +import\b")
_dependency_query("g07_js_imports", ("import",), (".js", ".ts"), r"""^[ \t]*import +(?:[^'"]*\bfrom *)?['"]([^'"]+)['"]""")
_dependency_query("g07_js_requires", ("require",), (".js", ".ts"), r"""^[ \t]*(?:(?:const|let|var) +(?:[{][^}]*[}]|[A-Za-z_$][A-Za-z0-9_$]*) *= *)?require *[(] *['"]([^'"]+)['"] *[)]""")
_dependency_query("g07_sql_tables", ("from", "join", "into"), (".sql",), r"(?i)\b(?:from|join|into)[ \t]+([A-Za-z_][A-Za-z0-9_.]*)")


@query(
    "select distinct file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(content, '(?m)#.*$', '', 'g'), '\\b(awk|sed|grep|find|xargs|sort|uniq|cut|curl|wget|ssh|scp|rsync|tar|gzip|zip|git|docker|kubectl|npm|pip|make|cmake|python|node|java|gcc|clang)\\b', 1))), ',') as commands from files where content is not null and ends_with(relative_path, '.sh') and regexp_matches(regexp_replace(content, '(?m)#.*$', '', 'g'), '\\b(awk|sed|grep|find|xargs|sort|uniq|cut|curl|wget|ssh|scp|rsync|tar|gzip|zip|git|docker|kubectl|npm|pip|make|cmake|python|node|java|gcc|clang)\\b')"
)
def g07_shell_commands(spark, d):
    found = elements.dependencies(_parsed(spark, d, "bash"), "file_id").where("import_type = 'external_command'").select("file_id", "source").distinct()
    return found.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("commands"))


_SNIPPETS = [
    ("kotlin", "a.kt", "package a\nimport b.c as d\ndata class A(val x: Int)\nclass B {\n  private fun g(a: Int): Int {\n    return a\n  }\n}\n"),
    ("c", "a.c", '#include <stdio.h>\n#define LIMIT 3\nstatic int f(int a) {\n  return a;\n}\nstruct S {\n  int a;\n};\n'),
    ("cpp", "a.cpp", "#include <v>\nusing namespace std;\nclass A : public B {\npublic:\n  virtual int f() const {\n    return 1;\n  }\n};\n"),
    ("csharp", "a.cs", "using System;\nnamespace N {\n  public class A : B {\n    public int P { get; set; }\n    private static int F(int a) {\n    }\n  }\n}\n"),
    ("swift", "a.swift", "import UIKit\npublic class A: B {\n  private var x = 1\n  func f(_ a: Int) -> Int {\n  }\n}\n"),
    ("ruby", "a.rb", "require 'a'\nclass A < B\n  attr_reader :x\n  def f(a)\n    a\n  end\n  private\n  def g\n  end\nend\n"),
    ("php", "a.php", "<?php\nuse C\\D as E;\nclass A extends B {\n  private $p = 1;\n  public static function f(int $a): int {\n  }\n}\n"),
    ("dart", "a.dart", "import 'package:flutter/material.dart';\nclass A extends StatelessWidget {\n  Widget build(BuildContext c) {\n    return Text('x');\n  }\n}\n"),
    ("unknown", "page.tsx", "import { useState } from 'react';\nexport default function HomePage() {\n  const [a, b] = useState(0);\n  return <div/>;\n}\nexport async function GET(req) {\n}\n"),
    ("html", "a.html", "<!doctype html>\n<html>\n<body>\n<div id=\"m\" class=\"c d\">\n<img src=x.png>\n</div></body></html>\n"),
    ("css", "a.css", "@import 'b.css';\n:root {\n  --c: #fff;\n}\n#a .b {\n  color: red;\n}\n"),
    ("bash", "a.sh", "source ./b.sh\nexport X=1\nfoo() {\n  local y=2\n  return 3\n}\n"),
]


@query(
    """select * from (values ('a.kt', 'kotlin', 'A', 'class', 2, 3, 'public', 'class'), ('a.kt', 'kotlin', 'B', 'class', 3, 8, 'public', 'class'), ('a.kt', 'kotlin', 'g', 'method', 4, 7, 'private', 'fun'),
('a.c', 'c', 'LIMIT', 'constant', 1, 2, 'public', 'macro'), ('a.c', 'c', 'f', 'function', 2, 5, 'private', 'function'), ('a.c', 'c', 'S', 'struct', 5, 8, 'public', 'struct'),
('a.cpp', 'cpp', 'A', 'class', 2, 8, 'public', 'class'), ('a.cpp', 'cpp', 'f', 'function', 4, 7, 'public', 'function'),
('a.cs', 'csharp', 'N', 'namespace', 1, 8, 'internal', 'namespace'), ('a.cs', 'csharp', 'A', 'class', 2, 7, 'public', 'class'), ('a.cs', 'csharp', 'P', 'variable', 3, 4, 'public', 'property'), ('a.cs', 'csharp', 'F', 'method', 4, 6, 'private', 'method'),
('a.swift', 'swift', 'A', 'class', 1, 6, 'public', 'class'), ('a.swift', 'swift', 'x', 'variable', 2, 3, 'private', 'property'), ('a.swift', 'swift', 'f', 'method', 3, 5, 'internal', 'func'),
('a.rb', 'ruby', 'A', 'class', 1, 10, 'public', 'class'), ('a.rb', 'ruby', 'x', 'variable', 2, 3, 'public', 'attr'), ('a.rb', 'ruby', 'f', 'method', 3, 6, 'public', 'def'), ('a.rb', 'ruby', 'g', 'method', 7, 9, 'private', 'def'),
('a.php', 'php', 'A', 'class', 2, 7, 'public', 'class'), ('a.php', 'php', 'p', 'variable', 3, 4, 'private', 'property'), ('a.php', 'php', 'f', 'method', 4, 6, 'public', 'function'),
('a.dart', 'dart', 'A', 'class', 1, 6, 'public', 'widget'), ('a.dart', 'dart', 'build', 'method', 2, 5, 'public', 'build'),
('page.tsx', 'nextjs', 'HomePage', 'class', 1, 5, 'public', 'page'), ('page.tsx', 'nextjs', '[a, b]', 'variable', 2, 3, 'public', 'hook'), ('page.tsx', 'nextjs', 'GET', 'function', 5, 7, 'public', 'route_handler'),
('a.html', 'html', 'doctype', 'module', 0, 1, 'public', 'doctype'), ('a.html', 'html', 'html', 'module', 1, 6, 'public', 'tag'), ('a.html', 'html', 'body', 'module', 2, 6, 'public', 'tag'), ('a.html', 'html', 'm.c', 'module', 3, 6, 'public', 'tag'),
('a.html', 'html', 'img', 'variable', 4, 5, 'public', 'tag'), ('a.css', 'css', ':root', 'class', 1, 4, 'public', 'rule'), ('a.css', 'css', '--c', 'variable', 2, 3, 'public', 'custom_property'), ('a.css', 'css', '#a .b', 'class', 4, 7, 'public', 'rule'),
('a.sh', 'bash', 'X', 'variable', 1, 2, 'public', 'export'), ('a.sh', 'bash', 'foo', 'function', 2, 6, 'public', 'function'), ('a.sh', 'bash', 'y', 'variable', 3, 4, 'public', 'local'))
t(relative_path, parser, name, element_type, start_line, end_line, visibility, pattern)"""
)
def g06_elements_other_languages(spark, d):
    """Languages the tables do not hold, on fixed snippets whose elements were read off by hand."""
    files = spark.createDataFrame(_SNIPPETS, "language string, relative_path string, content string")
    return elements.elements(elements.analyse(files), "relative_path").drop("element_no", "metadata")


@query(
    r"""select * from (values ('a.kt', 'a', 'package', 'a', null, 0), ('a.kt', 'c', 'import', 'b.c', 'd', 1), ('a.c', 'stdio.h', 'system_include', 'stdio.h', null, 0), ('a.cpp', 'v', 'system_include', 'v', null, 0), ('a.cpp', 'std', 'using_namespace', 'std', null, 1),
('a.cs', 'System', 'using', 'System', null, 0), ('a.swift', 'UIKit', 'import', 'UIKit', null, 0), ('a.rb', 'a', 'require', 'a', null, 0), ('a.php', 'D', 'use', 'C\D', 'E', 1), ('a.dart', 'material.dart', 'flutter', 'package:flutter/material.dart', null, 0),
('page.tsx', 'useState', 'import', 'react', null, 0), ('page.tsx', 'useState', 'react_import', 'react', null, 0), ('a.html', 'x.png', 'image', 'x.png', null, 4), ('a.css', 'b.css', 'import', 'b.css', null, 0), ('a.sh', 'b.sh', 'source', './b.sh', null, 0))
t(relative_path, name, import_type, source, alias, line_number)"""
)
def g07_dependencies_other_languages(spark, d):
    """Their dependencies, read off by hand."""
    files = spark.createDataFrame(_SNIPPETS, "language string, relative_path string, content string")
    return elements.dependencies(elements.analyse(files), "relative_path").drop("parser")


# -- lookups
@query()
def j01_hint_join(spark, d):
    h = A.hints(_analysed(spark, d), "file_id").select("file_id", F.array_join("top_elements", ",").alias("top_elements"), "dependency_count").distinct()
    c = chunking.chunks(spread(_files(spark, d, "content")), size=200, overlap=0, strategy="generic", with_text=False).select("file_id", "chunk_no", "tokens").distinct()
    return c.join(h, "file_id", "left").select("file_id", "chunk_no", "tokens", F.coalesce("top_elements", F.lit("")).alias("top_elements"), F.coalesce("dependency_count", F.lit(0).cast("bigint")).alias("dependency_count"))


_SETTINGS = (".ini", ".cfg", ".conf")
_HINT_SQL = "regexp_matches(line, '^[ \\t]*\\[[^\\]]+\\][ \\t]*$')"


@query(
    f"""with l as (select distinct file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as n, len(string_split(content, chr(10))) as total from files where content is not null and content <> '' and {EXT_SQL} in ('.ini', '.cfg', '.conf')),
s as (select file_id, n, regexp_extract(line, '^[ \\t]*\\[([^\\]]+)\\][ \\t]*$', 1) as name, row_number() over (partition by file_id order by n) as k from l where {_HINT_SQL}),
h as (select file_id, string_agg(name, ',' order by n) as sections from s where k <= 20 group by file_id)
select distinct l.file_id, total::bigint as lines, coalesce(h.sections, '') as sections from l left join h using (file_id)"""
)
def j01_sections_as_hints(spark, d):
    """Settings files with their first section names, from their own rows."""
    rows = _files(spark, d, "content").where(P.extension(F.col("relative_path")).isin(*_SETTINGS)).where("content is not null and content <> ''")
    a = elements.analyse(spread(rows)).withColumn("analysis", F.struct(F.filter("analysis.elements", lambda e: e["pattern"] == "section").alias("elements"), "analysis.dependencies"))
    h = A.hints(a, "file_id", "content")
    return h.select("file_id", F.size(F.split("content", "\n")).cast("bigint").alias("lines"), F.array_join("top_elements", ",").alias("sections")).distinct()


@query(
    "with r as (select distinct response_id, request_id, summary from responses), q as (select distinct request_id, file_id from requests), f as (select distinct file_id, relative_path from files) select response_id, file_id, relative_path, coalesce(length(summary), 0) as n from r join q using (request_id) join f using (file_id)"
)
def j02_summaries_of_files(spark, d):
    r = table(spark, d, "responses", "response_id", "request_id", "summary").select("response_id", "request_id", F.coalesce(F.length("summary"), F.lit(0)).cast("bigint").alias("n")).distinct()
    q = table(spark, d, "requests", "request_id", "file_id").distinct()
    f = table(spark, d, "files", "file_id", "relative_path").distinct()
    return r.join(q, "request_id").join(f, "file_id").select("response_id", "file_id", "relative_path", "n")


@query("select r.response_id, m.name, m.max_tokens from (select distinct response_id, model_used from responses) r left join models m on m.model = r.model_used")
def j04_response_models(spark, d):
    r = table(spark, d, "responses", "response_id", "model_used").distinct()
    m = table(spark, d, "models", "name", "model", "max_tokens")  # a fixed table; Spark broadcasts it by its size
    return r.join(m, r.model_used == m.model, "left").select("response_id", "name", "max_tokens")


@query("select * from (values ('a', 'public'), ('b', 'private'), ('c', 'public')) t(name, visibility)")
def j11_nearest_visibility(spark, d):
    """Definitions with the visibility word that stands nearest above them, within nine lines."""
    text = "class A\n  def a\n  end\n  private\n  def b\n  end\n  public\n  def c\n  end\nend"
    files = spark.createDataFrame([("ruby", "x.rb", text)], "language string, relative_path string, content string")
    return elements.elements(elements.analyse(files), "relative_path").where("pattern = 'def'").select("name", "visibility")


# -- aggregations
RESP_SQL = "(select distinct response_id, request_id, tokens_used, processing_time, model_used, provider_used, error, fallback_used, received_at from responses)"
_RESP = ("response_id", "request_id", "tokens_used", "processing_time", "model_used", "provider_used", "error", "fallback_used", "received_at")
ATT_SQL = "(select distinct * from attempts)"


@query(
    f"select count(*) as responses, count(distinct request_id) as requests, cast(sum(fallback_used::int) as bigint) as fallbacks, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens, count(error) as errors, round(avg(processing_time), 6) as avg_time, round(min(processing_time), 6) as min_time, round(max(processing_time), 6) as max_time from {RESP_SQL}"
)
def a01_run_summary(spark, d):
    return A.run_summary(table(spark, d, "responses", *_RESP).distinct())


@query(f"select provider, count(*) as attempts, count(*) filter (where ok) as answers, cast(coalesce(sum(tokens), 0) as bigint) as tokens, count(*) filter (where not ok) as errors, round(cast(coalesce(sum(tokens), 0) as bigint) * 0.00002::double, 6) as cost from {ATT_SQL} group by provider")
def a04_provider_usage(spark, d):
    return A.usage_by_provider(table(spark, d, "attempts").distinct())


@query(f"select {LANG_SQL} as language, count(*) as files, cast(sum(coalesce(octet_length(encode(content)), 0)) as bigint) as bytes, cast(sum(len(string_split(coalesce(content, ''), chr(10)))) as bigint) as lines, cast(sum({TOK_SQL}) as bigint) as tokens from {FILES_SQL} group by 1")
def a05_language_profile(spark, d):
    m = T.line_metrics(F.col("content"))
    rows = _files(spark, d, "content").select("file_id", "language", F.coalesce(F.octet_length("content"), F.lit(0)).alias("b"), m["total_lines"].alias("l"), T.count_tokens(F.col("content")).alias("t")).distinct()
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.sum("b").cast("bigint").alias("bytes"), F.sum("l").cast("bigint").alias("lines"), F.sum("t").cast("bigint").alias("tokens"))


@query(
    "with recursive n as (select coalesce(codebase, 'unknown') as codebase, count(distinct file_id) as n from files group by 1), l as (select codebase, 0 as level, n as nodes from n union all select codebase, level + 1, (nodes + 9) // 10 from l where nodes > 1) select codebase, level::bigint as level, nodes::bigint as nodes from l"
)
def a06_reduce_levels(spark, d):
    per = table(spark, d, "files", "codebase", "file_id").groupBy(F.coalesce("codebase", F.lit("unknown")).alias("codebase")).agg(F.count_distinct("file_id").alias("n"))
    # 10, 100, … cover any count a bigint holds
    steps = F.filter(F.sequence(F.lit(0), F.lit(18)), lambda k: (k == 0) | (F.ceil(F.col("n") / F.pow(F.lit(10.0), k - 1)) > 1))
    return per.select("codebase", F.explode(steps).alias("level"), "n").select("codebase", F.col("level").cast("bigint").alias("level"), F.ceil(F.col("n") / F.pow(F.lit(10.0), F.col("level"))).cast("bigint").alias("nodes"))


_NOTES_SQL = "(select file_id, coalesce(codebase, 'unknown') as codebase, relative_path || ': ' || coalesce(content, '') as summary, row_number() over (partition by coalesce(codebase, 'unknown') order by relative_path, file_id) - 1 as position from (select distinct file_id, codebase, relative_path, content from files where relative_path is not null))"


def _notes(spark, d):
    rows = table(spark, d, "files", "file_id", "codebase", "relative_path", "content").where("relative_path is not null")
    rows = rows.select("file_id", F.coalesce("codebase", F.lit("unknown")).alias("codebase"), "relative_path", F.concat("relative_path", F.lit(": "), F.coalesce("content", F.lit(""))).alias("summary")).distinct()
    return A.positions(rows, ["codebase"], ["relative_path", "file_id"]).select("codebase", "position", "summary")


@query(f"select codebase, position // 10 as position, md5(string_agg(summary, chr(10) || chr(10) order by position)) as summary_md5 from {_NOTES_SQL} group by 1, 2")
def a06_reduce_groups(spark, d):
    out = A.reduce_once(_notes(spark, d), ["codebase"], lambda s: s)
    return out.select("codebase", "position", F.md5("summary").alias("summary_md5"))


@query(f"select codebase, length(string_agg(summary, chr(10) || chr(10) order by position)) as n, md5(string_agg(summary, chr(10) || chr(10) order by position)) as summary_md5 from {_NOTES_SQL} group by 1")
def a06_hierarchical_reduce(spark, d):
    """One text for each code base, the whole contents of its files joined by tens on every level."""
    return A.hierarchical_reduce(_notes(spark, d), ["codebase"], lambda s: s).select("codebase", F.length("summary").cast("bigint").alias("n"), F.md5("summary").alias("summary_md5"))


@query(
    f"""with p as (select coalesce(codebase, 'unknown') as codebase, count(*) as files, cast(sum(coalesce(octet_length(encode(content)), 0)) as bigint) as bytes, count(distinct {LANG_SQL}) as languages, string_agg(distinct {LANG_SQL}, ',' order by {LANG_SQL}) as names from {FILES_SQL} group by 1)
select codebase, files, bytes, languages, names, round(bytes / 1048576.0::double, 2) as size_mb, case when files > 1000 or bytes > 104857600 then 12 when files < 50 then 4 else 8 end as workers, case when files > 1000 or bytes > 104857600 then 3000 when files < 50 then 1500 else 2000 end as chunk_size, not files < 50 as fallback,
concat_ws('; ', case when files > 500 then 'narrow the globs' end, case when list_contains(string_split(names, ','), 'python') and list_contains(string_split(names, ','), 'javascript') then 'mixed languages' end, case when bytes > 52428800 then 'raise the chunk size' end) as advice from p"""
)
def a09_codebase_profile(spark, d):
    rows = _files(spark, d, "codebase", "content").select("file_id", F.coalesce("codebase", F.lit("unknown")).alias("codebase"), "language", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes")).distinct()
    return A.profile(rows, "codebase")


@query(
    f"with r as (select coalesce(a.codebase, 'unknown') as codebase, count(distinct a.request_id) as requests, count(distinct case when a.ok then a.request_id end) as answered, count(distinct a.provider) as providers, cast(coalesce(sum(a.tokens), 0) as bigint) as tokens from {ATT_SQL} a group by 1) select *, round(coalesce(answered / nullif(requests, 0), 0), 6) as success_rate from r"
)
def a10_batch_stats(spark, d):
    a = table(spark, d, "attempts").distinct().withColumn("codebase", F.coalesce("codebase", F.lit("unknown")))
    # by request first: distinct counts then need no second pass over all tries
    per = a.groupBy("codebase", "request_id").agg(F.bool_or("ok").alias("ok"), F.sum("tokens").alias("t"), F.collect_set("provider").alias("p"))
    out = per.groupBy("codebase").agg(F.count("*").alias("requests"), F.count_if("ok").alias("answered"), F.size(F.array_distinct(F.flatten(F.collect_set("p")))).cast("bigint").alias("providers"), F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("tokens"))
    return out.withColumn("success_rate", A.success_rate(F.col("answered"), F.col("requests")))


@query(
    "with f as (select codebase, count(distinct file_id) as files, count(distinct extension) as kinds from files where codebase is not null group by 1), s as (select domain, codebase, codebase || ': ' || coalesce(files, 0) || ' files of ' || coalesce(kinds, 0) || ' kinds' as summary from codebases left join f using (codebase)) select domain, string_agg(summary, chr(10) || chr(10) order by codebase) as summary from s group by domain"
)
def a11_batch_report(spark, d):
    """The summaries of the code bases of each domain, joined in order of their names."""
    f = table(spark, d, "files", "codebase", "file_id", "extension").where("codebase is not null").groupBy("codebase").agg(F.count_distinct("file_id").alias("files"), F.count_distinct("extension").alias("kinds"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    rows = table(spark, d, "codebases", "codebase", "domain").join(f, "codebase", "left").select("domain", "codebase", F.concat("codebase", F.lit(": "), zero("files"), F.lit(" files of "), zero("kinds"), F.lit(" kinds")).alias("summary"))
    return A.concat_texts(rows, ["domain"], ["codebase"], "summary")


@query(
    f"""with s as (select distinct file_id, n, regexp_extract(line, '^[ \\t]*\\[([^\\]]+)\\][ \\t]*$', 1) as name from {_lines_of((".ini", ".cfg", ".conf"))} where {_HINT_SQL})
select file_id, name, n::bigint as start_line from (select *, row_number() over (partition by file_id order by n) as k from s) where k <= 3"""
)
def w04_capped_elements(spark, d):
    """The first three sections of each settings file, by the cap that holds files to their first 200 elements."""
    rows = _files(spark, d, "content").where(P.extension(F.col("relative_path")).isin(*_SETTINGS))
    e = elements.elements(elements.analyse(spread(rows)), "file_id").where("pattern = 'section'").drop("element_no").distinct()
    return A.cap_elements(e, "file_id", 3).select("file_id", "name", F.col("start_line").cast("bigint").alias("start_line"))


@query()
def a13_file_analysis(spark, d):
    """Elements (at most 200), methods, classes, dependencies and lines of each file, from its own row."""
    capped = F.slice("analysis.elements", 1, A.MOST_ELEMENTS)
    of = lambda kind: F.size(F.filter(capped, lambda e: e["element_type"] == kind))
    return _analysed(spark, d).select("file_id", "parser", F.size(F.split("content", "\n")).alias("lines"), F.size("analysis.dependencies").alias("dependencies"), F.size(capped).alias("elements"), of("method").alias("methods"), of("class").alias("classes")).distinct()


@query()
def a05_element_histogram(spark, d):
    return elements.elements(_analysed(spark, d), "file_id").select("file_id", "parser", "element_type", "name", "start_line").distinct().groupBy("parser", "element_type").agg(F.count("*").alias("elements"))


@query()
def a05_dependency_fan_in(spark, d):
    return elements.dependencies(_analysed(spark, d), "file_id").select("file_id", "parser", "source").distinct().groupBy("parser", "source").agg(F.count("*").alias("files"))


# -- windows, sets, control
@query(f"with f as (select distinct file_id, relative_path, {LANG_SQL} as language, size from files where relative_path is not null), r as (select *, row_number() over (partition by language order by relative_path, file_id) as rank from f) select language, rank::bigint as rank, file_id, relative_path from r where rank <= 10")
def w02_top_files(spark, d):
    rows = _files(spark, d).where("relative_path is not null").distinct()
    return A.top_files(rows).select("language", F.col("rank").cast("bigint").alias("rank"), "file_id", "relative_path")


@query(
    f"""with r as (select response_id, coalesce(model_used, 'none') as model, received_at, coalesce(tokens_used, 0) as t, cast(round(coalesce(processing_time, 0) * 1000000) as bigint) as s from {RESP_SQL}),
w as (select *, row_number() over o as done, count(*) over (partition by model) as total, sum(t) over o as tk, sum(s) over o as sc from r window o as (partition by model order by received_at nulls last, response_id rows between unbounded preceding and current row))
select response_id, model, done, (done * 10000 // total) / 100 as percent, tk::bigint as tokens_so_far, (sc // done) / 1000000 as mean_seconds, ((sc // done) * (total - done)) / 1000000 as eta_seconds from w"""
)
def w05_token_ledger(spark, d):
    rows = table(spark, d, "responses", *_RESP).distinct().select("response_id", F.coalesce("model_used", F.lit("none")).alias("model"), "received_at", "tokens_used", "processing_time")
    out = A.ledger(rows, by="model", order=[F.col("received_at").asc_nulls_last(), F.col("response_id")], tokens="tokens_used", seconds="processing_time")
    return out.drop("received_at", "tokens_used", "processing_time")


@query()
def u02_dedup_elements(spark, d):
    """Of what several passes find under one name and line the first; g06_elements drops the others while it parses."""
    e = elements.elements(elements.analyse(spread(_files(spark, d, "content")), dedup=False), "file_id").distinct()
    return A.dedup_elements(e, "file_id").select("file_id", "name", "start_line", "element_type")


@query(
    f"""with a as {ATT_SQL} select request_id, count(*) as tries, count(distinct provider) as providers, bool_or(ok) as answered, cast(coalesce(sum(case when ok then tokens end), 0) as bigint) as tokens,
arg_min(provider, (attempted_at, attempt, provider)) as first_provider, arg_max(provider, (attempted_at, attempt, provider)) as last_provider, arg_min(provider, (attempted_at, attempt, provider)) <> arg_max(provider, (attempted_at, attempt, provider)) as fallback_used from a group by request_id"""
)
def c02_fallback_chains(spark, d):
    return S.chain_outcomes(table(spark, d, "attempts").distinct())


def _flaky(text: str, language: str) -> str:
    if len(text) % 3 == 0:
        raise RuntimeError("busy")
    return S.first_sentence(text)


_STRIP_SQL = "regexp_replace({}, '^[ \\t\\r\\f\\v]+|[ \\t\\r\\f\\v]+$', '', 'g')"


@query(
    f"""with q as (select distinct request_id, content, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {_STRIP_SQL.format('x')}), lambda x: x <> '')[1] as first from requests)
select request_id, case when first is null then null when length(content) % 3 = 0 then 'offline' else 'flaky' end as provider_used, first is not null and length(content) % 3 = 0 as fallback_used,
case when first is null then 0 else (length(content) + 3) // 4 + (length(substring(first, 1, 200)) + 3) // 4 end::bigint as tokens_used, case when first is null then 0 when length(content) % 3 = 0 then 3 else 1 end as tries from q"""
)
def c03_summarize_with_retries(spark, d):
    """A failing and a sound offline provider over the requests; one row each with provider, fallback and number of tries."""
    rows = spread(table(spark, d, "requests", "request_id", "content", "language"))
    out = S.summarize(rows, (S.Provider("flaky", "m", _flaky), S.OFFLINE), keys=("request_id",), retries=2, wait=lambda s: None)
    return out.select("request_id", "provider_used", "fallback_used", "tokens_used", F.size("attempts").alias("tries")).distinct()


@query(
    "with q as (select distinct request_id, file_id, file_path from requests), r as (select distinct response_id, request_id, summary, error from responses), x as (select q.file_id, r.response_id, case when r.error is null then r.summary end as s, r.error from q join r using (request_id)) select file_id, md5(coalesce(nullif(string_agg(s, chr(10) || chr(10) order by response_id), ''), 'No part of this file could be described.')) as summary_md5, count(error) as failed_parts from x group by file_id"
)
def c04_combine_parts(spark, d):
    q = table(spark, d, "requests", "request_id", "file_id", "file_path").distinct()
    r = table(spark, d, "responses", "response_id", "request_id", "summary", "error").distinct()
    return S.combine_parts(r.join(q, "request_id"), "file_id", "response_id").select("file_id", F.md5("summary").alias("summary_md5"), "failed_parts")


@query(
    f"""with q as (select distinct request_id, file_id from requests), r as (select distinct response_id, request_id, summary, error from responses),
s as (select file_id, coalesce(nullif(string_agg(case when r.error is null then r.summary end, chr(10) || chr(10) order by response_id), ''), 'No part of this file could be described.') as summary from q join r using (request_id) group by file_id),
f as (select distinct file_id, relative_path, {LANG_SQL} as language from files where relative_path is not null), k as (select *, row_number() over (partition by language order by relative_path, file_id) as rank from f join s using (file_id))
select upper(language[1]) || language[2:] as language, rank::bigint as rank, relative_path, substring(summary, 1, 200) || '...' as preview from k where rank <= 10"""
)
def c05_fallback_report(spark, d):
    """Previews of the combined summaries of the first files of each language."""
    q = table(spark, d, "requests", "request_id", "file_id").distinct()
    r = table(spark, d, "responses", "response_id", "request_id", "summary", "error").distinct()
    s = S.combine_parts(r.join(q, "request_id"), "file_id", "response_id").select("file_id", "summary")
    files = _files(spark, d).where("relative_path is not null").distinct().join(s, "file_id").withColumn("error", F.lit(None).cast("string"))
    return report.fallback_report(files).withColumn("rank", F.col("rank").cast("bigint"))


_EDGES = {"scan": (), "filter": ("scan",), "parse": ("filter",), "chunk": ("filter",), "enrich": ("chunk", "parse"), "reduce": ("enrich",), "report": ("reduce",)}


@query(
    "with recursive e(s, d) as (values ('filter', 'scan'), ('parse', 'filter'), ('chunk', 'filter'), ('enrich', 'chunk'), ('enrich', 'parse'), ('reduce', 'enrich'), ('report', 'reduce')), l as (select 'scan' as s, 0 as depth union all select e.s, l.depth + 1 from l join e on e.d = l.s), m as (select s, max(depth) as depth from l group by s) select s as stage, (row_number() over (order by depth, s) - 1)::bigint as position from m"
)
def c06_stage_order(spark, d):
    return spark.createDataFrame([(n, i) for i, n in enumerate(stages.topological(_EDGES))], "stage string, position bigint")


@query(f"select distinct response_id, error from {RESP_SQL} where error is not null")
def c07_error_view(spark, d):
    return stages.error_rows(table(spark, d, "responses", "response_id", "error")).distinct()


@query(
    f"""with s as (select count(*) as responses, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens, count(error) as errors, cast(coalesce(sum(fallback_used::int), 0) as bigint) as fallbacks from {RESP_SQL}),
h as (select unnest([0, 1, 2, 3, 4, 5])::bigint as line_no, unnest(['# Code base report', '', '- Responses: ' || responses, '- Tokens: ' || tokens, '- Errors: ' || errors, '- Fallbacks: ' || fallbacks]) as line from s),
p as (select provider, count(*) as attempts, cast(coalesce(sum(tokens), 0) as bigint) as tokens, count(*) filter (where not ok) as errors from {ATT_SQL} group by provider),
e as (select error, count(*) as n from {RESP_SQL} where error is not null group by error)
select * from h union all select (5 + row_number() over (order by provider))::bigint, '- ' || provider || ': ' || attempts || ' attempts, ' || tokens || ' tokens, ' || errors || ' errors' from p where (select count(*) from p) > 1
union all select 1000000, chr(10) || '## Errors' || chr(10) where (select count(*) from e) > 0 union all select (1000000 + row_number() over (order by n desc, error))::bigint, '- ' || error || ' (' || n || ')' from e"""
)
def k02_markdown_report(spark, d):
    return report.report_lines(a04_provider_usage(spark, d), a01_run_summary(spark, d), report.error_counts(table(spark, d, "responses", *_RESP).distinct()))


@query("select response_id, summary from (select distinct response_id, summary from responses) where summary is not null")
def k03_json_rows(spark, d):
    rows = table(spark, d, "responses", "response_id", "summary").where("summary is not null").distinct()
    packed = rows.select(F.to_json(F.struct("response_id", "summary")).alias("j"))
    return packed.select(F.from_json("j", "response_id bigint, summary string").alias("r")).select("r.*")


@query("select date_trunc('hour', attempted_at) as hour, provider, count(*) as attempts, cast(coalesce(sum(tokens), 0) as bigint) as tokens, count(*) filter (where not ok) as errors from (select distinct * from attempts where attempted_at is not null) group by 1, 2")
def z01_usage_by_hour(spark, d):
    a = table(spark, d, "attempts").where("attempted_at is not null").distinct()
    return a.groupBy(F.date_trunc("hour", "attempted_at").alias("hour"), "provider").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"), F.count_if(~F.col("ok")).alias("errors"))


# -- nearness, balance, frameworks
_LINES_SQL = "(select file_id, unnest(range(0, len(ls))) as line_no, unnest(ls) as line from (select distinct file_id, string_split(content, chr(10)) as ls from files where content is not null and ends_with(relative_path, '{}')))"


def _of_suffix(spark, d, suffix):
    return table(spark, d, "files", "file_id", "relative_path", "content").where(f"content is not null and endswith(relative_path, '{suffix}')").select("file_id", "content")


@query(
    f"with w as (select *, last_value(case when trim(line) <> '' then line end ignore nulls) over (partition by file_id order by line_no rows between unbounded preceding and 1 preceding) as nearest from {_LINES_SQL.format('.rs')}) select file_id, line_no::bigint as line_no, nearest from w where regexp_matches(line, '^pub fn ')"
)
def w06_nearest_line_before(spark, d):
    found = lookups.nearest_in_text(F.col("content"), lambda x: x.rlike("^pub fn "), lambda x: F.trim(x) != "")
    return _of_suffix(spark, d, ".rs").select("file_id", F.explode(found).alias("f")).select("file_id", F.col("f.line_no").cast("bigint").alias("line_no"), "f.nearest").distinct()


@query(
    f"with w as (select file_id, line_no, sum(length(line) - length(replace(line, '{{', '')) - (length(line) - length(replace(line, '}}', '')))) over (partition by file_id order by line_no) as balance from {_LINES_SQL.format('.go')}) select file_id, max(balance)::bigint as deepest, arg_max(balance, line_no)::bigint as last from w group by file_id"
)
def w07_brace_balance(spark, d):
    # only numbers leave the text
    deltas = chunking.explode_lines(_of_suffix(spark, d, ".go")).select("file_id", "line_no", lookups.brace_delta(F.col("line")).alias("delta")).distinct()
    rows = lookups.brace_balance(deltas, "file_id")
    return rows.groupBy("file_id").agg(F.max("balance").cast("bigint").alias("deepest"), F.max_by("balance", "line_no").cast("bigint").alias("last"))


@query("select 'a.dart' as relative_path, 'A' as widget, '_AState' as state union all select 'a.dart', 'B', null")
def j09_widget_states(spark, d):
    text = "class A extends StatefulWidget {\n}\nclass _AState extends State<A> {\n}\nclass B extends StatelessWidget {\n}\n"
    files = spark.createDataFrame([("dart", "a.dart", text)], "language string, relative_path string, content string")
    return lookups.widget_states(elements.elements(elements.analyse(files), "relative_path"), "relative_path")


@query(
    "select distinct file_id, case when contains(content, 'import unittest') or contains(content, 'unittest.TestCase') then 'unittest' when contains(content, 'import pytest') or contains(content, '@pytest.') then 'pytest' when contains(content, 'def test_') then 'plain' end as framework, len(regexp_extract_all(content, '(?m)^[ \\t]*(?:assert[ (]|self\\.assert[A-Za-z]+\\()'))::bigint as assertions from files where content is not null and ends_with(relative_path, '.py')"
)
def x19_test_frameworks(spark, d):
    c = F.col("content")
    return table(spark, d, "files", "file_id", "relative_path", "content").where("content is not null and endswith(relative_path, '.py')").select("file_id", lookups.test_framework(c).alias("framework"), lookups.assertion_count(c).alias("assertions")).distinct()


@query(
    "select distinct file_id, coalesce(nullif(regexp_extract(content, '^#![^\\n]*\\b(bash|zsh|fish|ksh)\\b', 1), ''), 'sh') as shell, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\b(?:exit|return)[ \\t]+([0-9]+)', 1))), ',') as exit_codes from files where content is not null and ends_with(relative_path, '.sh')"
)
def x21_shell_figures(spark, d):
    c = F.col("content")
    return table(spark, d, "files", "file_id", "relative_path", "content").where("content is not null and endswith(relative_path, '.sh')").select("file_id", lookups.shell_type(c).alias("shell"), lookups.exit_codes(c).alias("exit_codes")).distinct()


_ROUTE_PATHS = ("app/(shop)/cart/page.tsx", "pages/api/user.ts", "pages/index.jsx", "pages/_app.tsx", "src/app/blog/[slug]/layout.tsx", "middleware.ts", "lib/x.ts")
_IN_APP, _IN_PAGES = "(starts_with(path, 'app/') or contains(path, '/app/'))", "(starts_with(path, 'pages/') or contains(path, '/pages/'))"


@query(
    rf"""with p as (select distinct relative_path as path from files where relative_path is not null and regexp_matches(relative_path, '\.(js|jsx|ts|tsx)$') union select unnest([{', '.join(map(_q, _ROUTE_PATHS))}])),
n as (select path, {_IN_APP} as app, {_IN_PAGES} as pages, regexp_replace(string_split(path, '/')[-1], '\.[a-z]+$', '') as name, regexp_replace(regexp_replace(path, '\.[a-z]+$', ''), '^(.*?/)??(app|pages)/', '') as base from p)
select path, case when app and name in ('page', 'layout', 'route', 'loading', 'error', 'template', 'not-found') then name when starts_with(path, 'pages/api/') or contains(path, '/pages/api/') then 'api' when name = 'middleware' then 'middleware'
  when pages and name in ('_app', '_document') then name[2:] when pages then 'page' else 'module' end as file_type, case when app then 'app' when pages then 'pages' else 'none' end as router,
  case when app or pages then '/' || regexp_replace(regexp_replace(base, '(^|/)(page|layout|route|index|loading|error|template|not-found)$', ''), '\([^)]*\)/', '', 'g') end as route from n"""
)
def x23_next_routes(spark, d):
    """File type, router and route of every script of the tables, and of paths that show each kind."""
    paths = table(spark, d, "files", "relative_path").where(r"relative_path rlike '[.](js|jsx|ts|tsx)$'").select(F.col("relative_path").alias("path"))
    shown = spark.createDataFrame([(p,) for p in _ROUTE_PATHS], "path string")
    return paths.unionByName(shown).distinct().select("path", *[v.alias(k) for k, v in lookups.next_route(F.col("path")).items()])


_BATCHES = [("good", {"workflow": {"type": "batch", "name": "n"}}), ("empty", {}), ("settings", {"workflow": {"type": "batch"}, "settings": C.template("minimal", ""), "execution": {"max_concurrent": 0}})]


@query(
    "select * from (values ('empty', 'workflow is required'), ('settings', 'workflow.name is required'), ('settings', 'settings: codebase_path is required'), ('settings', 'execution.max_concurrent must be a positive whole number')) t(name, message)"
)
def f18_batch_violations(spark, d):
    return spark.createDataFrame([(n, m) for n, b in _BATCHES for m in C.batch_violations(b)], "name string, message string")
