import json

import pytest
from pyspark.sql import functions as F

from quarryline import catalog, cli
from quarryline import config as C
from quarryline.functions import text as T
from quarryline.operators import aggregates as A
from quarryline.operators import summarize as S
from quarryline.plans import pipeline, stages
from quarryline.sources import scan_directory


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "src/blank.py").write_text("  \n")
    (tmp_path / "src/big.py").write_text("\n\n".join(f"def f{i}():\n    return {i}" for i in range(400)))
    (tmp_path / "src/notes.txt").write_text("hello")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\x00x")
    (tmp_path / "node_modules/x.js").write_text("x")
    return tmp_path


def test_scan(spark, tree):
    got = {r.relative_path: r for r in scan_directory(spark, str(tree)).collect()}
    assert set(got) == {"src/a.py", "src/blank.py", "src/big.py", "src/bad.py"}
    assert got["src/bad.py"].error and got["src/bad.py"].content is None
    assert got["src/a.py"].size == 22 and got["src/a.py"].language == "python"
    assert "src/big.py" not in {r.relative_path for r in scan_directory(spark, str(tree), max_file_size=100).collect()}
    with pytest.raises(Exception):
        scan_directory(spark, str(tree / "none")).count()


def test_run(spark, tree, tmp_path):
    cfg = C.from_dict({**C.template("minimal", str(tree)), "chunk_size": 200, "chunk_overlap": 20, "output_dest": str(tmp_path / "out/r.json"), "output_format": "json"})
    out = pipeline.Engine(spark, cfg, work=str(tmp_path / "work")).run()
    assert out["statistics"]["errors"] == 0
    data = json.loads((tmp_path / "out/r.json").read_text())
    assert data["files"]["src/blank.py"] == "Empty file" and "def f0" in data["files"]["src/big.py"]
    done, failed = pipeline.analyse_batch(spark, {"a": str(tree), "b": str(tree / "none")})
    assert set(done) == {"a"} and set(failed) == {"b"}


def test_each_provider_is_called_once_a_request(spark, tree, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def record(text, language):
        import tempfile

        with tempfile.NamedTemporaryFile("w", dir=str(log), delete=False) as f:
            f.write(text)
        if "def f():" in text:
            raise RuntimeError("busy")
        return "a summary"

    def overview(text, language):
        with open(log / "aggregate", "a") as f:
            f.write("x" + text)
        return "one overview"

    cfg = C.from_dict({**C.template("minimal", str(tree)), "chunk_size": 200, "chunk_overlap": 0, "retry_attempts": 1, "enable_fallback": False, "output_dest": str(tmp_path / "r.md"), "models": [{"name": "p", "provider": "offline", "model": "m"}]})
    seen = {}

    def watch(df, ctx):
        seen.setdefault(ctx.point, 0)
        seen[ctx.point] += 1
        return df

    reg = stages.Registry([stages.FunctionStage("watch", tuple(stages.POINTS), watch)])
    out = pipeline.Engine(spark, cfg, providers=(S.Provider("p", "m", record, prompted=True, aggregate=overview), S.OFFLINE), stages=reg).run()
    calls = [p.read_text() for p in log.iterdir() if p.name != "aggregate"]
    chunks = out["statistics"]["requests"] - 3  # one file, a blank one, one that is not UTF-8; only the first of these is asked for
    assert len(calls) == 1 + chunks and len(set(calls)) == len(calls)
    assert out["master"] == "one overview" and (log / "aggregate").read_text().count("x" + T.PROMPTS["aggregate"][0]) == 1
    assert sum("Elements: f0, f1" in c and T.PROMPTS["chunk"][0] in c for c in calls) == chunks and sum(T.PROMPTS["file"][0] in c for c in calls) == 1
    assert set(seen) == set(stages.POINTS) - {"during_aggregate"}  # nothing was too large for one step
    assert out["statistics"]["errors"] == 1 and "## Errors" in (tmp_path / "r.md").read_text() and "RuntimeError: busy (1)" in (tmp_path / "r.md").read_text()


def test_aggregation_falls_back_to_the_plain_report(spark, tree, tmp_path):
    def fail(text, language):
        raise RuntimeError("down")

    cfg = C.from_dict({**C.template("minimal", str(tree)), "retry_attempts": 1, "output_dest": ""})
    out = pipeline.Engine(spark, cfg, providers=(S.Provider("offline", "first-line", S.first_sentence, aggregate=fail),)).run()
    assert out["error"] == "RuntimeError: down" and "Python: src/a.py: def f():" in out["master"]


def test_large_code_bases_are_reduced_by_tens(spark, tmp_path):
    for i in range(130):
        (tmp_path / f"m{i:03}.py").write_text(f"value_{i} = " + "1 + " * 60 + "1\n")
    cfg = C.from_dict({**C.template("minimal", str(tmp_path)), "output_dest": ""})
    joined = S.Provider("offline", "first-line", S.first_sentence, aggregate=lambda t, g: " ".join(w for w in t.split() if w.startswith("value_")))
    out = pipeline.Engine(spark, cfg, providers=(joined,)).run()
    assert out["master"].split() == [f"value_{i}" for i in range(130)]
    plain = pipeline.Engine(spark, cfg).run()
    assert "m000.py: value_0" in plain["master"] and plain["statistics"]["requests"] == 130


def test_stage_models(spark, tree):
    cfg = C.from_dict({"codebase_path": str(tree), "models": [{"name": "fast", "provider": "offline", "model": "m1"}, {"name": "deep", "provider": "offline", "model": "m2"}], "file_model": "fast", "aggregation_model": "m2"})
    one, two = S.Provider("fast", "m1", S.first_sentence), S.Provider("deep", "m2", S.first_sentence)
    e = pipeline.Engine(spark, cfg, providers=(one, two))
    assert e.providers_of(cfg.file_model) == (one,) and e.providers_of(cfg.aggregation_model) == (two,) and e.providers_of("other") == (one, two)


def test_failing_steps_are_strict_or_told(spark, tree):
    def broken(df, ctx):
        return df.select("nothing_here")

    told = []
    reg = stages.Registry([stages.FunctionStage("broken", ("after_scan",), broken), stages.FunctionStage("told", ("on_error",), lambda d, c: told.append([tuple(r) for r in d.collect()]) or d)])
    cfg = C.from_dict({**C.template("minimal", str(tree)), "output_dest": ""})
    pipeline.Engine(spark, cfg, stages=reg).files()
    assert told[0][0][:2] == ("after_scan", "broken")
    with pytest.raises(stages.StageError):
        pipeline.Engine(spark, C.from_dict({**C.template("minimal", str(tree)), "strict_stages": True}), stages=reg).files()


def test_engine_creation_and_update(spark, tree):
    e = pipeline.Engine.create(spark, str(tree))
    assert e.update(chunk_size=500).cfg.chunk_size == 500
    with pytest.raises(C.ConfigError):
        e.update(chunk_size=1)


def test_fallback_and_retries():
    calls = []

    def bad(t, g):
        calls.append(t)
        raise RuntimeError("down")

    waits = []
    r, a = S.complete("x", "py", (S.Provider("bad", "m", bad), S.OFFLINE), retries=3, wait=waits.append)
    assert r["provider_used"] == "offline" and r["fallback_used"] and len(calls) == 3 and waits == [1.0, 2.0]
    assert [x["ok"] for x in a] == [False, False, False, True]
    r, a = S.complete("x", "py", (S.Provider("bad", "m", bad), S.OFFLINE), retries=1, fallback=False, wait=waits.append)
    assert r["error"] and len(a) == 1


def test_summaries_are_rows_even_when_all_fail(spark):
    def bad(t, g):
        raise RuntimeError("down")

    df = spark.createDataFrame([("a", "x", "py"), ("b", "", "py"), ("c", None, None)], "relative_path string, content string, language string")
    rows = {r.relative_path: r for r in S.summarize(df, (S.Provider("bad", "m", bad),), retries=1).collect()}
    assert rows["a"].error and rows["b"].summary == "Empty file" == rows["c"].summary


def test_combine_parts(spark):
    df = spark.createDataFrame([("a", 1, "two", None), ("a", 0, "one", None), ("b", 0, None, "e")], "relative_path string, chunk_no int, summary string, error string")
    got = {r.relative_path: r.summary for r in S.combine_parts(df, "relative_path").collect()}
    assert got == {"a": "one\n\ntwo", "b": S.ALL_FAILED}


def test_reduce(spark):
    assert A.reduce_levels(25) == [25, 3, 1] and A.reduce_levels(1) == [1] and A.reduce_levels(0) == [0]
    df = spark.range(125).select(F.lit("g").alias("g"), F.col("id").alias("position"), F.col("id").cast("string").alias("summary"))
    out = A.hierarchical_reduce(df, ["g"], lambda s: s).first()
    assert out.summary.split("\n\n") == [str(i) for i in range(125)]
    cut_to = lambda s: F.substring(s, 1, 40)
    sparse = df.where("id % 7 <> 3")
    for rows in (df, sparse):
        steps = rows
        for _ in range(3):
            steps = A.reduce_once(steps, ["g"], cut_to)
        assert A.hierarchical_reduce(rows, ["g"], cut_to).first().summary == steps.first().summary == A.hierarchical_reduce(rows, ["g"], cut_to, at_once=3).first().summary
    empty = df.where("false")
    assert A.hierarchical_reduce(empty, ["g"], lambda s: s).count() == 0


def test_reduce_takes_whole_contents(spark, tmp_path):
    files = [(i, "a" if i % 3 else None, f"p{i:02}", None if i == 4 else f"{i} " * (50 * i)) for i in range(40)]
    df = spark.createDataFrame([*files, files[7], (99, "a", None, "no path")], "file_id long, codebase string, relative_path string, content string")
    df.write.parquet(str(tmp_path / "files.parquet"))
    got = {r.codebase: r.n for r in catalog.queries()["a06_hierarchical_reduce"](spark, str(tmp_path)).collect()}
    texts = {g: "\n\n".join(f"{p}: {c or ''}" for _, x, p, c in files if (x or "unknown") == g) for g in ("a", "unknown")}
    assert got == {g: len(t) for g, t in texts.items()}


def test_ledger(spark):
    df = spark.sql("select * from values ('m', timestamp_ntz'2025-01-01 00:30:00', 1, 10, 1.0D), ('m', timestamp_ntz'2025-01-01 05:00:00', 2, null, 2.0D), ('m', null, 3, 5, null) t(by, at, id, tokens, secs)")
    rows = A.ledger(df, by="by", order=[F.col("at").asc_nulls_last(), F.col("id")], tokens="tokens", seconds="secs").orderBy("done").collect()
    assert [(r.id, r.done, r.tokens_so_far) for r in rows] == [(1, 1, 10), (2, 2, 10), (3, 3, 15)]
    assert rows[1].mean_seconds == 1.5


def test_stages(spark):
    r = stages.Registry()
    r.register(stages.FunctionStage("b", ("after_scan",), lambda d, c: d.withColumn("b", F.col("a") + 1), depends_on=("a",)))
    r.register(stages.FunctionStage("a", ("after_scan",), lambda d, c: d.withColumn("a", F.lit(1))))
    r.register(stages.FunctionStage("broken", ("after_scan",), lambda d, c: d.select("nothing_here")))
    assert [s.name for s in r.order()] == ["a", "b", "broken"]
    out = r.run("after_scan", spark.range(1), stages.Context(None))
    assert out.first().b == 2 and r.errors[0][1] == "broken"
    with pytest.raises(stages.StageError):
        r.run("after_scan", spark.range(1), stages.Context(None), strict=True)
    with pytest.raises(stages.StageError):
        stages.topological({"a": ("b",), "b": ("a",)})
    assert stages.check(object()) and r.info()["stages"] == 3


def test_configured_stages(spark):
    tag = stages.FunctionStage("tag", ("after_scan",), lambda d, c: d.withColumn("tag", F.lit(c.options.get("value", "none"))))
    off = stages.FunctionStage("off", ("after_scan",), lambda d, c: d.select("nothing_here"))
    r = stages.Registry.configured([C.StageConfig("tag", options={"value": "x"}, priority=5), C.StageConfig("off", enabled=False)], [tag, off])
    assert r.names() == ["tag"] and r.run("after_scan", spark.range(1), stages.Context(None)).first().tag == "x"
    with pytest.raises(stages.StageError):
        stages.Registry.configured([C.StageConfig("none")], [tag])
    assert stages.check(stages.FunctionStage("a", ("nowhere",), None)) == ["nowhere is no point of the pipeline"]
    info = stages.system_info(r)
    assert info["points"] == 15 and info["stages"] == 1 and info["providers"] == 9 and info["languages"] >= 21


def test_cli_takes_a_provider_of_ones_own():
    assert cli.load_object("quarryline.operators.summarize:OFFLINE") is S.OFFLINE
    args = cli.build_parser().parse_args(["analyze", "x", "--provider", "a:b", "--provider", "c:d", "--work", "/w"])
    assert args.provider == ["a:b", "c:d"] and args.work == "/w"


def test_config(tmp_path):
    assert C.violations({}) == ["codebase_path is required", "models must be a list that is not empty"]
    assert C.violations({**C.template("minimal", "/x"), "retry_attempts": True}) == ["retry_attempts must be a number"]
    assert C.merge({"a": {"b": 1, "c": 2}, "models": [1]}, {"a": {"b": 3}, "models": [2]}) == {"a": {"b": 3, "c": 2}, "models": [2]}
    with pytest.raises(C.ConfigError):
        C.from_dict({**C.template("minimal", "/x"), "nothing": 1})
    (tmp_path / "pyproject.toml").write_text('[tool.quarryline]\ncodebase_path = "/y"\n')
    assert C.load_file(C.discover(str(tmp_path))) == {"codebase_path": "/y"}
    assert C.discover(str(tmp_path / "none")) is None
    assert [m["name"] for m in C.from_environment({"ANTHROPIC_API_KEY": "k", "OPENAI_API_KEY": "k"})] == ["anthropic", "openai"]
    cfg = C.from_dict(C.template("multi", "/x"))
    assert C.select_models(cfg.models, "backup")[0].name == "backup" and len(C.select_models(cfg.models, "x")) == 2
    C.save(cfg, str(tmp_path / "d/c.json"))
    assert json.loads((tmp_path / "d/c.json").read_text())["chunk_size"] == 2000
    assert C.recommended("/x", 2000, 0, ["python"])["max_workers"] == 12
    assert C.provider_info("other")["env"] == "OTHER_API_KEY"


def test_cli(tmp_path, capsys):
    assert cli.main(["create-config", str(tmp_path / "c.json"), "--template", "single"]) == 0
    assert cli.main(["validate", str(tmp_path / "c.json")]) == 0
    (tmp_path / "bad.json").write_text("{}")
    assert cli.main(["validate", str(tmp_path / "bad.json")]) == 1
    assert cli.main(["validate-env"]) == 0 and cli.main(["list-stages"]) == 0
    assert cli.main(["analyze", "--config", str(tmp_path / "bad.json")]) == 2


def test_workflow(spark, tree):
    out = pipeline.Workflow(spark).add("a", str(tree)).then(lambda o: {**o, "n": len(o["results"])}).run()
    assert out["n"] == 1 and out["success_rate"] == 1.0
    assert pipeline.summarize_file(spark, str(tree / "src/a.py"))["statistics"]["responses"] == 1


def test_functional_api(spark, tree, tmp_path):
    import quarryline

    assert quarryline.init_config("/x", chunk_size=500).chunk_size == 500
    assert quarryline.validate_setup({}) and quarryline.validate_setup(C.template("minimal", "/x")) == []
    out = quarryline.quick_start(spark, str(tree), output_dest=str(tmp_path / "r.md"))
    assert out["statistics"]["responses"] >= 3 and (tmp_path / "r.md").read_text().startswith("# Code base report")
    with pytest.raises(C.ConfigError):
        C.save_batch({}, str(tmp_path / "b.json"))
    C.save_batch({"workflow": {"type": "batch", "name": "n"}}, str(tmp_path / "b.json"))
