"""Paths, globs and languages as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: suffix -> language
LANGUAGES = {
    ".py": "python", ".rs": "rust", ".go": "golang", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php",
    ".rb": "ruby", ".sh": "bash", ".sql": "sql", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".html": "html", ".css": "css", ".md": "markdown", ".txt": "text",
}
#: fixed values: suffixes of binary files
BINARY_SUFFIXES = (
    ".exe .dll .so .dylib .bin .obj .o .jpg .jpeg .png .gif .bmp .ico .svg .mp3 .mp4 .avi .mov .wav .pdf .zip .tar .gz .rar .7z .pkg .deb .rpm"
).split()
#: fixed values: default globs
DEFAULT_INCLUDE = ("*.py", "*.rs", "*.go", "*.js", "*.ts")
DEFAULT_EXCLUDE = (
    "*/.git/*", "*/.svn/*", "*/.hg/*", "*/.bzr/*", "*/_darcs/*", "*/node_modules/*", "*/.venv/*", "*/venv/*", "*/env/*", "*/.env/*", "*/.conda/*", "*/.pix/*", "*/.direnv/*", "*/.uv/*", "*/vendor/*",
    "*/.pnpm-store/*", "*/__pycache__/*", "*/target/*", "*/build/*", "*/dist/*", "*/.gradle/*", "*/.m2/*", "*/.cargo/*", "*/.nuget/*", "*/.pytest_cache/*", "*/.tox/*", "*/.nox/*", "*/coverage/*",
    "*/.nyc_output/*", "*/.jacoco/*", "*/.hypothesis/*", "*/.next/*", "*/.nuxt/*", "*/.svelte-kit/*", "*/.turbo/*", "*/.parcel-cache/*", "*/.cache/*", "*/__pypackages__/*", "*/.vscode/*", "*/.idea/*",
    "*/.vs/*", "*/.atom/*", "*/.sublime/*", "*/.emacs.d/*", "*/.vim/*", "*/.nvim/*", "*/.DS_Store/*", "*/._*", "*/Thumbs.db", "*/desktop.ini", "*/package-lock.json", "*/yarn.lock", "*/pnpm-lock.yaml",
    "*/poetry.lock", "*/Cargo.lock", "*/go.sum", "*/composer.lock", "*/.gitignore", "*/.env*", "*/*.log", "*/*.tmp", "*test*",
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot; '' for names without one and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]+)$", 1))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(names[extension(path)], F.lit("unknown"))


def file_id(path: Column) -> Column:
    """First eight hex digits of the md5 of the path."""
    return F.substring(F.md5(path), 1, 8)


def glob_regex(glob: str) -> str:
    """Regular expression, without anchors, of a glob within one path component."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.sub(r"([^\w/ -])", r"\\\1", c)
        i += 1
    return out


def exclude_regex(globs: tuple[str, ...] = DEFAULT_EXCLUDE) -> str:
    """One expression for all exclusions: ``*/X/*`` any component as it is, ``*/P`` any component by glob, ``P`` the file name by glob; other shapes exclude nothing."""
    parts, names = [], []
    for g in globs:
        if len(g) > 4 and g.startswith("*/") and g.endswith("/*") and "/" not in g[2:-2]:
            parts.append(re.sub(r"([^\w/ -])", r"\\\1", g[2:-2]))
        elif g.startswith("*/") and "/" not in g[2:]:
            parts.append(glob_regex(g[2:]))
        elif "/" not in g:
            names.append(glob_regex(g))
    out = []
    if parts:
        out.append(f"(?:^|/)(?:{'|'.join(parts)})(?:/|$)")
    if names:
        out.append(f"(?:^|/)(?:{'|'.join(names)})$")
    return "|".join(out)


def excluded(path: Column, globs: tuple[str, ...] | None = None) -> Column:
    """Whether a path is excluded; None means the default globs, an empty tuple excludes nothing."""
    globs = DEFAULT_EXCLUDE if globs is None else tuple(globs)
    rx = exclude_regex(globs)
    return path.rlike(rx) if rx else F.lit(False)


def included(path: Column, globs: tuple[str, ...] | None = DEFAULT_INCLUDE) -> Column:
    """Right-anchored glob match of any; None or empty keeps all."""
    if not globs:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [path.rlike("(?:^|/)" + "/".join(map(glob_regex, g.strip("/").split("/"))) + "$") for g in globs])


def looks_text(path: Column, content: Column) -> Column:
    """Binary suffixes no, known suffixes yes, others by a NUL in the first 512 bytes."""
    ext = extension(path)
    start = F.substring(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), 1, 512)
    return F.when(ext.isin(*BINARY_SUFFIXES), False).when(ext.isin(*LANGUAGES), True).otherwise(~F.contains(start, F.unhex(F.lit("00"))))
