"""Settings: defaults, files, environment, merging, validation."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from quarryline.functions.paths import DEFAULT_EXCLUDE, DEFAULT_INCLUDE


class ConfigError(ValueError):
    """Settings that cannot be used."""


#: fixed values: provider -> (label, endpoint, environment variable)
PROVIDERS = {
    "minimax": ("MiniMax", "https://api.minimax.io/anthropic", "MINIMAX_API_KEY"),
    "deepseek": ("DeepSeek", "https://api.deepseek.com/anthropic", "DEEPSEEK_API_KEY"),
    "anthropic": ("Anthropic", "", "ANTHROPIC_API_KEY"),
    "openai": ("OpenAI", "https://api.openai.com/v1", "OPENAI_API_KEY"),
    "perplexity": ("Perplexity", "https://api.perplexity.ai", "PPLX_API_KEY"),
    "kimi": ("Kimi", "https://api.moonshot.cn/v1", "KIMI_API_KEY"),
    "qwen": ("Qwen", "https://dashscope.aliyuncs.com/compatible-mode/v1", "QWEN_API_KEY"),
    "ollama": ("Ollama", "http://localhost:11434/v1", "OLLAMA_API_KEY"),
    "offline": ("Offline", "", ""),
}
#: fixed values: inclusive ranges of the numeric settings
RANGES = {"chunk_size": (100, 50_000), "max_workers": (1, 32), "max_file_size": (1024, 100 * 1024 * 1024), "timeout": (5, 300), "retry_attempts": (0, 10)}
FORMATS = ("markdown", "json", "text")
FILE_NAMES = ("quarryline.toml", "quarryline.json", ".quarryline.toml", ".quarryline.json")
SECTION = "quarryline"


@dataclass(frozen=True)
class ModelConfig:
    name: str
    provider: str
    model: str
    temperature: float = 0.0
    max_tokens: int = 16000
    base_url: str | None = None


@dataclass(frozen=True)
class StageConfig:
    name: str
    enabled: bool = True
    priority: int = 100
    depends_on: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    codebase_path: str = ""
    models: tuple[ModelConfig, ...] = (ModelConfig("offline", "offline", "first-line"),)
    file_model: str | None = None
    aggregation_model: str | None = None
    chunk_size: int = 2000
    chunk_overlap: int = 400
    include_patterns: tuple[str, ...] = DEFAULT_INCLUDE
    exclude_patterns: tuple[str, ...] | None = None
    max_file_size: int = 10 * 1024 * 1024
    output_dest: str = "report.md"
    output_format: str = "markdown"
    max_workers: int = 8
    timeout: int = 30
    retry_attempts: int = 3
    enable_fallback: bool = True
    stages: tuple[StageConfig, ...] = ()
    strict_stages: bool = False

    @property
    def excluded(self) -> tuple[str, ...]:
        return DEFAULT_EXCLUDE if self.exclude_patterns is None else self.exclude_patterns


def merge(base: dict, over: dict) -> dict:
    """Deep merge: dicts by key, models replaced as a whole, everything else overridden."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if k != "models" and isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def violations(raw: dict) -> list[str]:
    """All messages about a raw configuration, in a fixed order; empty if it is valid."""
    out = []
    if not raw.get("codebase_path"):
        out.append("codebase_path is required")
    models = raw.get("models")
    if not isinstance(models, (list, tuple)) or not models:
        out.append("models must be a list that is not empty")
    else:
        for i, m in enumerate(models):
            m = m if isinstance(m, dict) else {}
            for k in ("name", "provider", "model"):
                if not m.get(k):
                    out.append(f"models[{i}].{k} is required")
            if m.get("provider") and m["provider"] not in PROVIDERS:
                out.append(f"models[{i}].provider is unknown")
    for k, (lo, hi) in RANGES.items():
        v = raw.get(k)
        if v is None:
            continue
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            out.append(f"{k} must be a number")
        elif not lo <= v <= hi:
            out.append(f"{k} must lie in {lo}..{hi}")
    if raw.get("output_format", "markdown") not in FORMATS:
        out.append("output_format is unknown")
    size, overlap = raw.get("chunk_size", 2000), raw.get("chunk_overlap", 400)
    if isinstance(size, int) and isinstance(overlap, int) and not 0 <= overlap < size:
        out.append("chunk_overlap must lie in 0..chunk_size-1")
    stages = raw.get("stages", [])
    if not isinstance(stages, (list, tuple)) or any(not isinstance(s, dict) or not s.get("name") for s in stages):
        out.append("stages must be a list of named blocks")
    return out


def from_dict(raw: dict) -> Config:
    """A checked configuration; unknown keys and every violation are named in the error."""
    known = {f.name for f in fields(Config)}
    bad = [f"unknown setting {k}" for k in sorted(set(raw) - known)] + violations(raw)
    if bad:
        raise ConfigError("; ".join(bad))
    kw = dict(raw)
    kw["models"] = tuple(ModelConfig(**m) if isinstance(m, dict) else m for m in raw["models"])
    kw["stages"] = tuple(StageConfig(**{**s, "depends_on": tuple(s.get("depends_on", ()))}) for s in raw.get("stages", ()))
    for k in ("include_patterns", "exclude_patterns"):
        if kw.get(k) is not None:
            kw[k] = tuple(kw[k])
    return Config(**kw)


def load_file(path: str) -> dict:
    """A JSON or TOML file; in TOML the section [tool.quarryline] or [quarryline] if there is one."""
    p = Path(path)
    if p.suffix == ".json":
        return json.loads(p.read_text())
    data = tomllib.loads(p.read_text())
    return data.get("tool", {}).get(SECTION) or data.get(SECTION) or data


def discover(*folders: str) -> str | None:
    """First settings file in the folders: own names first, then a pyproject with the section."""
    for d in folders:
        for n in FILE_NAMES:
            if (p := Path(d, n)).is_file():
                return str(p)
        p = Path(d, "pyproject.toml")
        if p.is_file() and SECTION in tomllib.loads(p.read_text()).get("tool", {}):
            return str(p)
    return None


def from_environment(env: dict[str, str] | None = None) -> list[dict]:
    """Models of the providers whose key stands in the environment, in the order of the registry."""
    env = dict(os.environ) if env is None else env
    return [{"name": n, "provider": n, "model": "default"} for n, (_, _, var) in PROVIDERS.items() if var and env.get(var)]


def select_models(models: tuple[ModelConfig, ...], wanted: str | None) -> tuple[ModelConfig, ...]:
    """Models of a stage by name or model; none found means all."""
    hit = tuple(m for m in models if wanted and wanted in (m.name, m.model))
    return hit or tuple(models)


def provider_info(name: str) -> dict:
    label, url, var = PROVIDERS.get(name, (name, "", f"{name.upper()}_API_KEY"))
    return {"name": name, "label": label, "base_url": url, "env": var}


def template(kind: str = "multi", path: str = ".") -> dict:
    """A starting configuration: multi, single or minimal."""
    models = [{"name": "offline", "provider": "offline", "model": "first-line"}]
    if kind == "minimal":
        return {"codebase_path": path, "models": models}
    if kind == "single":
        return {"codebase_path": path, "models": models, "chunk_size": 2000, "enable_fallback": False}
    return {"codebase_path": path, "models": [*models, {"name": "backup", "provider": "offline", "model": "first-line"}], "chunk_size": 2000, "chunk_overlap": 400, "enable_fallback": True}


def for_languages(base: dict, languages: list[str]) -> dict:
    """Globs of the languages named."""
    from quarryline.functions.paths import LANGUAGES

    globs = sorted("*" + s for s, g in LANGUAGES.items() if g in languages)
    return merge(base, {"include_patterns": globs})


def recommended(path: str, files: int, size: int, languages: list[str]) -> dict:
    """Settings for a code base of that size."""
    big, small = files > 1000 or size > 100 * 1024 * 1024, files < 50
    return for_languages(merge(template("multi", path), {"max_workers": 12 if big else 4 if small else 8, "chunk_size": 3000 if big else 1500 if small else 2000, "enable_fallback": not small}), languages)


def masked(cfg: Config) -> dict:
    """The settings as plain data, anything that may be secret masked."""

    def walk(v, key=""):
        if isinstance(v, dict):
            return {k: walk(x, k) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [walk(x, key) for x in v]
        return "***" if v and any(w in key.lower() for w in ("api_key", "secret", "password", "token_value")) else v

    return walk(asdict(cfg))


def save(cfg: Config, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(masked(cfg), indent=2))


def batch_violations(raw: dict) -> list[str]:
    """All messages about a batch: a workflow with type and name, valid settings, a positive number of runs at once."""
    out = []
    flow = raw.get("workflow")
    if not isinstance(flow, dict):
        out.append("workflow is required")
    else:
        out += [f"workflow.{k} is required" for k in ("type", "name") if not flow.get(k)]
    if "settings" in raw:
        out += [f"settings: {m}" for m in violations(raw["settings"] if isinstance(raw["settings"], dict) else {})]
    n = raw.get("execution", {}).get("max_concurrent", 1)
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        out.append("execution.max_concurrent must be a positive whole number")
    return out


def save_batch(raw: dict, path: str) -> None:
    """Writes a batch configuration that was checked first."""
    if bad := batch_violations(raw):
        raise ConfigError("; ".join(bad))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(raw, indent=2))
