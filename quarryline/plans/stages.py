"""Stages: user steps at fixed points of the pipeline, in dependency order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from importlib.metadata import entry_points
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: points of the pipeline a step can hook on
POINTS = (
    "before_scan after_scan before_chunk after_chunk before_request after_response on_chunk_complete on_file_complete on_token_usage "
    "before_aggregate during_aggregate after_aggregate before_output after_output on_error"
).split()


class Stage(Protocol):
    name: str

    def supports(self, point: str) -> bool: ...

    def apply(self, df: DataFrame, context: Context) -> DataFrame: ...


@dataclass(frozen=True)
class Context:
    """What a step may read: settings, the point, and side tables; nothing is shared to be changed."""

    config: object
    point: str = ""
    tables: dict[str, DataFrame] = field(default_factory=dict)
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FunctionStage:
    name: str
    points: tuple[str, ...]
    function: Callable[[DataFrame, Context], DataFrame]
    depends_on: tuple[str, ...] = ()
    priority: int = 100

    def supports(self, point: str) -> bool:
        return point in self.points

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return self.function(df, context)


class StageError(RuntimeError):
    """A step that failed in strict mode, or steps that depend on each other in a circle."""


def check(stage: object) -> list[str]:
    """What is missing for an object to be a stage."""
    out = [f"{a} is missing" for a in ("name", "supports", "apply") if not hasattr(stage, a)]
    if hasattr(stage, "name") and not (isinstance(stage.name, str) and stage.name):
        out.append("name must be a text")
    if not isinstance(getattr(stage, "priority", 0), int):
        out.append("priority must be a whole number")
    deps = getattr(stage, "depends_on", ())
    if isinstance(deps, str) or not all(isinstance(d, str) for d in deps):
        out.append("depends_on must be a list of names")
    for p in getattr(stage, "points", ()):
        if p not in POINTS:
            out.append(f"{p} is no point of the pipeline")
    return out + [f"{a} must be callable" for a in ("supports", "apply") if hasattr(stage, a) and not callable(getattr(stage, a))]


class _Configured:
    """A stage with the place and options its settings give it."""

    def __init__(self, stage: Stage, priority: int, depends_on: tuple[str, ...], options: dict):
        self.stage, self.name, self.priority, self.options = stage, stage.name, priority, options
        self.depends_on = depends_on or tuple(getattr(stage, "depends_on", ()))

    def supports(self, point: str) -> bool:
        return self.stage.supports(point)

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return self.stage.apply(df, Context(context.config, context.point, context.tables, self.options))


class Registry:
    """Stages by name; ``order`` sorts by dependencies, then priority, then name."""

    def __init__(self, stages: Iterable[Stage] = ()):
        self._stages: dict[str, Stage] = {}
        self.errors: list[tuple[str, str, str]] = []
        for s in stages:
            self.register(s)

    def register(self, stage: Stage) -> Stage:
        if bad := check(stage):
            raise StageError("; ".join(bad))
        self._stages[stage.name] = stage
        return stage

    def get(self, name: str) -> Stage | None:
        return self._stages.get(name)

    def names(self) -> list[str]:
        return sorted(self._stages)

    def reset(self) -> None:
        self._stages.clear()
        self.errors.clear()

    def discover(self, group: str = "quarryline.stages") -> list[str]:
        """Registers what installed packages offer; returns the new names."""
        new = []
        for e in entry_points(group=group):
            s = e.load()
            new.append(self.register(s() if isinstance(s, type) else s).name)
        return new

    @classmethod
    def configured(cls, settings: Iterable, known: Iterable[Stage]) -> Registry:
        """The known stages that the settings name and do not switch off, with their priority and what they depend on."""
        found = {s.name: s for s in known}
        out = cls()
        for c in settings:
            if c.name not in found:
                raise StageError(f"unknown stage {c.name}")
            if c.enabled:
                out.register(_Configured(found[c.name], c.priority, tuple(c.depends_on), dict(c.options)))
        return out

    def order(self) -> list[Stage]:
        return [self._stages[n] for n in topological({n: getattr(s, "depends_on", ()) for n, s in self._stages.items()}, {n: getattr(s, "priority", 100) for n, s in self._stages.items()})]

    def run(self, point: str, df: DataFrame, context: Context, *, strict: bool = False) -> DataFrame:
        """The rows through every step at a point; a failing step is recorded and left out, or raises in strict mode."""
        for s in self.order():
            if not s.supports(point):
                continue
            try:
                df = s.apply(df, Context(context.config, point, context.tables))
            except Exception as e:  # noqa: BLE001 - a step of the user
                self.errors.append((point, s.name, f"{type(e).__name__}: {e}"))
                if strict:
                    raise StageError(f"{s.name} at {point}: {e}") from e
        return df

    def info(self) -> dict:
        return {"stages": len(self._stages), "points": {p: [s.name for s in self.order() if s.supports(p)] for p in POINTS}, "errors": len(self.errors)}


def system_info(registry: Registry | None = None) -> dict:
    """Counts of what is installed: points, stages, languages, routes, providers."""
    from quarryline import config as C
    from quarryline.operators import languages as L

    return {"points": len(POINTS), "stages": len(registry.names()) if registry else 0, "languages": len(L.LANGUAGES), "language_routes": len(L.BY_LANGUAGE), "suffix_routes": len(L.BY_SUFFIX), "providers": len(C.PROVIDERS)}


def topological(edges: dict[str, Iterable[str]], priority: dict[str, int] | None = None) -> list[str]:
    """Names so that each follows what it depends on; among free ones by priority, then name."""
    pri = priority or {}
    ts = TopologicalSorter({n: [d for d in deps if d in edges] for n, deps in edges.items()})
    try:
        ts.prepare()
    except CycleError as e:
        raise StageError("circle: " + " -> ".join(e.args[1])) from e
    out, ready = [], []
    while ts.is_active():
        ready += ts.get_ready()
        ready.sort(key=lambda n: (pri.get(n, 100), n))
        n = ready.pop(0)
        out.append(n)
        ts.done(n)
    return out


def error_rows(df: DataFrame) -> DataFrame:
    """The view behind ``on_error``."""
    return df.where(F.col("error").isNotNull())
