"""Analytics of source-code and document corpora on PySpark."""

from __future__ import annotations

__version__ = "0.1.0"


def summarize(spark, path: str, **settings) -> dict:
    """The whole pipeline over a tree."""
    from quarryline.plans.pipeline import summarize as run

    return run(spark, path, **settings)


def init_config(path: str = ".", kind: str = "multi", **settings):
    """A checked configuration from a template and overrides."""
    from quarryline import config as C

    return C.from_dict(C.merge(C.template(kind, path), settings))


def quick_start(spark, path: str, **settings) -> dict:
    """The pipeline with settings recommended for the size of the tree."""
    from pyspark.sql import functions as F

    from quarryline import config as C
    from quarryline.plans.pipeline import Engine
    from quarryline.sources import profile_scan

    row = profile_scan(spark, path).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.collect_set("language")).first()
    return Engine(spark, C.from_dict(C.merge(C.recommended(path, row[0], row[1], [x for x in row[2] if x != "unknown"]), settings))).run()


def validate_setup(raw: dict | None = None) -> list[str]:
    """Messages about a configuration and the environment; empty if all is well."""
    from quarryline import config as C

    return C.violations(raw) if raw is not None else ([] if C.from_environment() else ["no provider key in the environment; the offline summarizer is used"])
