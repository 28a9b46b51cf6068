"""Code elements and dependencies of a text, one Arrow pass for both."""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf
from quarryline.functions.paths import extension
from quarryline.operators.languages import BY_LANGUAGE, BY_SUFFIX, LANGUAGES, STOP, Language, Pattern, added

FLAGS = "static final abstract virtual override sealed async const readonly inline suspend operator infix data open unsafe extern explicit mutating lazy native synchronized transient volatile required convenience indirect default partial".split()
Element = tuple[str, str, int, int, str, str, str]  # name, type, start, end, visibility, pattern, metadata
Dependency = tuple[str, str, str, str | None, int]  # name, type, source, alias, line


def parser_key(language: Column, path: Column) -> Column:
    """Parser by language, else by suffix, else null: such files are skipped."""
    a = F.create_map(*[F.lit(x) for kv in BY_LANGUAGE.items() for x in kv])
    b = F.create_map(*[F.lit(x) for kv in BY_SUFFIX.items() for x in kv])
    return F.coalesce(a[language], b[extension(path)])


def generic_key(key: Column) -> Column:
    """Any key to a parser: unknown ones mean the generic parser."""
    return F.when(key.isin(*LANGUAGES), key).otherwise("generic")


# -- blocks
def _brace_end(lines: list[str], start: int) -> int:
    total, opened = 0, False
    first = lines[start].rstrip()
    if "{" not in first and first.count("(") == first.count(")") and not first.endswith((",", "=", ":", ">", "|", "&", "+", "(")):
        after = next((x for i in range(start + 1, len(lines)) if (x := lines[i].strip())), "")
        if not after.startswith(("{", "where", "throws", "extends", "implements", ":", "=>")):
            return start + 1  # a declaration without a body
    for i in range(start, len(lines)):
        o, c = lines[i].count("{"), lines[i].count("}")
        total += o - c
        opened = opened or o > 0
        if opened and total <= 0:
            return i + 1
        if not opened and lines[i].rstrip().endswith(";"):
            return i + 1
    return len(lines)


def _paren_end(lines: list[str], start: int) -> int:
    total = 0
    for i in range(start, len(lines)):
        total += lines[i].count("(") - lines[i].count(")")
        if total <= 0:
            return i + 1
    return len(lines)


def _indent_end(lines: list[str], start: int) -> int:
    depth = len(lines[start]) - len(lines[start].lstrip())
    for i in range(start + 1, len(lines)):
        if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= depth:
            return i
    return len(lines)


_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def _ruby_end(lines: list[str], start: int) -> int:
    depth = 0
    for i in range(start, len(lines)):
        x = re.sub(r"#.*$", "", lines[i])
        if _RUBY_OPEN.search(x):
            depth += 1
        if re.match(r"^\s*end\b", x):
            depth -= 1
            if depth <= 0:
                return i + 1
    return len(lines)


def _semi_end(lines: list[str], start: int) -> int:
    body = 0
    for i in range(start, len(lines)):
        x = lines[i].strip()
        body += x.count("$$")
        if i > start and not body % 2 and re.match(r"(?i)create\b", x):
            return i
        if not body % 2 and x.endswith(";"):
            return i + 1
    return len(lines)


_SHELL_COMMENT = re.compile(r"(?:^|(?<=\s))#.*$")


def _shell_end(lines: list[str], start: int) -> int:
    """Braces of a script, those in comments and after ``$`` apart."""
    total, opened = 0, False
    for i in range(start, len(lines)):
        x = re.sub(r"\$\{[^{}]*\}", "", _SHELL_COMMENT.sub("", lines[i]))
        total += x.count("{") - x.count("}")
        opened = opened or "{" in x
        if opened and total <= 0:
            return i + 1
    return len(lines)


_ENDS: dict[str, Callable[[list[str], int], int]] = {"shell": _shell_end, "brace": _brace_end, "paren": _paren_end, "indent": _indent_end, "end": _ruby_end, "semi": _semi_end, "line": lambda lines, i: i + 1}


class Lines:
    """The line of an offset, from a table of where lines begin."""

    def __init__(self, text: str):
        self.begins = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect_right(self.begins, offset) - 1


# -- shared metadata
def split_list(text: str, sep: str = ",") -> list[str]:
    """Parts of a list, not cut inside brackets or quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= not (c == ">" and text[i - 1 : i] in "-=")
        elif c == sep and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [x.strip() for x in out if x.strip()]


def parameters(decl: str, language: str) -> list[dict]:
    """Normalised parameters (name, type, optional, default) of a declaration."""
    a = decl.find("(")
    if language == "golang" and decl.lstrip().startswith("func ("):
        a = decl.find("(", decl.find(")"))
    if a < 0:
        return []
    depth, b = 0, len(decl)
    for i in range(a, len(decl)):
        depth += (decl[i] in "([{") - (decl[i] in ")]}")
        if depth == 0:
            b = i
            break
    out = []
    for p in split_list(decl[a + 1 : b]):
        p, _, default = (x.strip() for x in p.partition("=")) if "=" in p and "=>" not in p else (p, "", "")
        if language in ("java", "c", "cpp", "csharp", "dart", "php"):
            words = re.sub(r"@\w+(\([^)]*\))?", "", p).replace("*", " * ").split()
            name, kind = (words[-1] if words else p), " ".join(words[:-1])
        elif language == "golang":
            name, _, kind = p.partition(" ")
        else:
            name, _, kind = p.partition(":")
        name = name.strip().lstrip("&").removeprefix("mut ").strip()
        out.append({"name": name.rstrip("?"), "type": kind.strip() or None, "optional": name.endswith("?") or bool(default), "default": default or None})
    return out


_RETURN = {
    "rust": r"->\s*([^{;]+?)\s*(?:where\b|\{|;|$)",
    "swift": r"->\s*([^{]+?)\s*(?:where\b|\{|$)",
    "kotlin": r"\)\s*:\s*([\w<>?., ]+)",
    "typescript": r"\)\s*:\s*([^={;]+?)\s*(?:=>|\{|;|$)",
    "php": r"\)\s*:\s*(\??[\w\\|]+)",
    "golang": r"\)\s*(\([^)]*\)|[\w.*\[\]]+)\s*\{",
}


def _return_type(decl: str, name: str, language: str) -> str | None:
    if language in _RETURN:
        m = re.search(_RETURN[language], decl)
        return m[1].strip() if m else None
    if language in ("java", "c", "cpp", "csharp", "dart"):
        m = re.search(rf"([\w.<>\[\]?:]+)[ \t*&]+{re.escape(name)}\s*[(<]", decl)
        return m[1] if m and m[1] not in FLAGS and m[1] not in ("public", "private", "protected", "new", "return") else None
    return None


def _visibility(lang: Language, name: str, decl: str, mods: str, state: str | None) -> str:
    how = lang.visibility
    if how == "case":
        return "public" if name[:1].isupper() else "private"
    if how == "pub":
        return "public" if re.search(r"\bpub\b", decl.split("(")[0] + mods) else "private"
    if how == "export":
        return "private" if name.startswith(("#", "_")) or re.search(r"\bprivate\b", mods) else "protected" if re.search(r"\bprotected\b", mods) else "public"
    if how == "underscore":
        return "private" if name.startswith("_") else "public"
    if how == "static":
        return "private" if re.search(r"\bstatic\b", decl.split("(")[0]) else "public"
    if how in ("section", "ruby"):
        return state or "public"
    for w in ("public", "private", "protected", "internal", "fileprivate", "open"):
        if re.search(rf"\b{w}\b", mods):
            return {"fileprivate": "private", "open": "public"}.get(w, w)
    return lang.default_visibility


def _metadata(lang: Language, p: Pattern, name: str, decl: str, lead: str, mods: str, body: list[str], groups: dict) -> dict:
    words = set(re.findall(r"[a-z]+", mods)) | set(re.findall(r"\b(?:" + "|".join(FLAGS) + r")\b", decl.split(name)[0] if name in decl else ""))
    m: dict = {"pattern_type": p.kind, "indent_level": len(lead.expandtabs(4))}
    flags = [f for f in FLAGS if f in words]
    if flags:
        m["modifiers"] = flags
    if p.type in ("function", "method") and lang.name not in ("css", "sql", "bash", "generic"):
        m["parameters"] = parameters(decl, lang.name)
        if r := _return_type(decl, name, "typescript" if lang.name in ("react", "nextjs", "javascript") else lang.name):
            m["return_type"] = r
    if p.type in ("class", "interface", "struct") and (h := re.search(r"\b(?:extends|implements|:|<)\s*([\w.<>, ]+?)\s*(?:\{|$|where\b)", decl.partition(name)[2])):
        m["inheritance"] = [x.split("<")[0].strip() for x in re.split(r",|\bimplements\b|\bextends\b|\bwith\b", h[1]) if x.strip(" <>")]
    if groups.get("receiver"):
        m["receiver"] = groups["receiver"].strip()
    text = "\n".join(body)
    if lang.name in ("javascript", "typescript", "react", "nextjs"):
        m["is_exported"] = "export" in decl.split(name)[0] or p.kind == "assigned"
        m["is_default_export"] = "default" in decl.split(name)[0]
    if lang.name in ("react", "nextjs"):
        m["hooks_used"] = sorted(set(re.findall(r"\b(use[A-Z]\w*)\s*\(", text)))
        m["uses_jsx"] = bool(re.search(r"<[A-Za-z][\w.]*[\s/>]", text))
        if p.kind in ("component", "class_component", "page", "layout"):
            m.update(props=react_props(text), state_hooks=re.findall(r"const\s*\[\s*(\w+)[^\]]*\]\s*=\s*(?:React\.)?useState\b", text), effect_hooks=effect_dependencies(text), jsx_elements=sorted(set(re.findall(r"<([A-Z][\w.]*)", text))))
        if p.kind == "hook" and (h := re.search(r"\b(use[A-Z]\w*)", text)):
            m.update(hook_name=h[1], hook_type=HOOK_KINDS.get(h[1], "custom"), is_destructured=name.startswith("["))
    if lang.name == "sql":
        m.update(_sql(p.kind, text))
    if lang.name == "css":
        m.update(_css(p.kind, name, text))
    if lang.name == "bash" and p.type == "function":
        commands = [x for x in map(str.strip, body) if x and not x.startswith("#")]
        m.update(parameters=sorted(set(re.findall(r"\$\{?([1-9]\d*|@|\*|#)", text))), uses_local="local " in text, exit_codes=sorted(set(re.findall(r"\b(?:exit|return)\s+(\d+)", text))))
        m.update(command_count=len(commands), has_conditionals=bool(re.search(r"\b(?:if|case)\b", text)), has_loops=bool(re.search(r"\b(?:for|while|until)\b", text)))
    elif lang.name == "bash":
        value = shell_value(text)
        if p.kind == "array":
            m.update(array_elements=len(text.partition("(")[2].partition(")")[0].split()), is_associative=bool(re.search(r"\b(?:declare|typeset)\s+-A\b", text)))
        elif p.kind == "alias":
            m["alias_command"] = value
        else:
            m.update(initial_value=value, variable_type=shell_value_type(value), is_readonly=p.kind == "readonly", is_exported=p.kind == "export", is_local=p.kind == "local")
    if lang.name == "dart":
        m["is_private"] = name.startswith("_")
        m["flutter_widgets_used"] = sorted(set(re.findall(r"\b(Text|Column|Row|Container|Scaffold|AppBar|Center|Padding|ListView|Stack|Expanded|SizedBox|Icon|Card)\(", text)))
        if p.kind == "widget":
            m["state_class"] = f"_{name}State" if "StatefulWidget" in decl else None
    if lang.name == "generic":
        known = 0.8 if p.type in ("function", "class") else 0.6
        m["confidence"] = round(min(1.0, known + (0.1 if "{" in text else 0.0)), 2)
    return m


#: fixed values: kinds of the hooks of React
HOOK_KINDS = {
    "useState": "state", "useReducer": "state", "useEffect": "effect", "useLayoutEffect": "effect", "useContext": "context", "useRef": "ref", "useImperativeHandle": "ref", "useMemo": "memoization", "useCallback": "memoization",
}
#: fixed values: commands a script calls that are programs of their own
EXTERNAL_COMMANDS = "awk sed grep find xargs sort uniq cut curl wget ssh scp rsync tar gzip zip git docker kubectl npm pip make cmake python node java gcc clang".split()
_EXTERNAL = re.compile(r"\b(?:" + "|".join(EXTERNAL_COMMANDS) + r")\b")


def react_props(text: str) -> list[str]:
    """Names a component takes out of its first argument."""
    m = re.search(r"(?:function\s+\w+\s*|=\s*(?:async\s*)?|memo\(|forwardRef\()\(\s*\{([^{}]*)\}", text)
    return sorted({n for x in split_list(m[1]) if (n := re.split(r"[:=]", x)[0].strip(" ."))}) if m else []


def effect_dependencies(text: str) -> list[str]:
    """The dependency list of each effect that has one, in order; an empty one says so."""
    out = []
    for m in re.finditer(r"\buse(?:Layout)?Effect\s*\(", text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += (text[i] in "([{") - (text[i] in ")]}")
            i += 1
        if d := re.search(r",\s*\[([^\[\]]*)\]\s*\)$", text[m.start() : i]):
            out.append(d[1].strip() or "no dependencies")
    return out


def shell_value(text: str) -> str:
    """Right side of an assignment without its quotes."""
    v = text.partition("=")[2].strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v


def shell_value_type(value: str) -> str:
    if value.isdigit():
        return "integer"
    if value.lower() in ("true", "false"):
        return "boolean"
    return "reference" if value.startswith("$") else "path" if "/" in value else "string"


def _sql(kind: str, text: str) -> dict:
    m: dict = {"or_replace": bool(re.search(r"(?i)\bor\s+replace\b", text)), "if_not_exists": bool(re.search(r"(?i)\bif\s+not\s+exists\b", text))}
    if kind == "table" and (b := re.search(r"(?s)\((.*)\)", text)):
        parts = split_list(b[1])
        is_con = re.compile(r"(?i)^(?:primary|foreign|unique|check|constraint|exclude)\b")
        m["columns"] = [{"name": x.split()[0].strip('"`'), "type": " ".join(x.split()[1:2])} for x in parts if not is_con.match(x)]
        m["constraints"] = [x for x in parts if is_con.match(x)]
    if kind == "index" and (t := re.search(r"(?i)\bon\s+([\w.]+)", text)):
        m.update(table=t[1], is_unique=bool(re.search(r"(?i)\bunique\b", text)))
    if kind == "function" and (b := re.search(r"(?is)\b(?:function|procedure)\s+[\w.\"`]+\s*\((.*?)\)(?=\s*(?:returns|as|language|begin|is)\b|\s*$)", text)):
        words = [re.sub(r"(?i)^(?:in|out|inout)\s+", "", x).split() for x in split_list(b[1])]
        m["parameters"] = [{"name": w[0], "type": " ".join(w[1:]) or None} for w in words if w]
    if kind == "function" and (r := re.search(r"(?i)\breturns\s+([\w ()]+?)\s*(?:as|language|$|\n)", text)):
        m["return_type"] = r[1].strip()
    return m


def css_specificity(selector: str) -> int:
    ids = len(re.findall(r"#[A-Za-z_-][\w-]*", selector))
    classes = len(re.findall(r"\.[A-Za-z_-][\w-]*|\[[^\]]*\]|:[A-Za-z-]+", selector))
    bare = re.sub(r"[#.:][\w-]+|\[[^\]]*\]|\([^)]*\)", " ", selector)
    return 100 * ids + 10 * classes + len(re.findall(r"[A-Za-z][A-Za-z0-9]*", bare))


def _css(kind: str, name: str, text: str) -> dict:
    if kind == "rule":
        props = [x.split(":")[0].strip() for x in split_list(text.partition("{")[2].rpartition("}")[0].replace("\n", " "), ";") if ":" in x]
        return {"selector": name, "selector_specificity": css_specificity(name), "properties": props, "declaration_count": len(props)}
    if kind == "at_rule":
        m: dict = {"at_rule": name.split()[0].lstrip("@")}
        if m["at_rule"] == "media":
            m["breakpoints"] = re.findall(r"(\d+(?:\.\d+)?(?:px|em|rem))", name)
        if "keyframes" in m["at_rule"]:
            m["keyframe_selectors"] = re.findall(r"(?m)^\s*(from|to|\d+%)", text)
        return m
    if kind == "custom_property":
        v = text.partition(":")[2].strip(" ;")
        return {"value": v, "is_color": bool(re.match(r"#[0-9a-fA-F]{3,8}$|(?:rgb|hsl)a?\(", v)), "is_size": bool(re.match(r"-?\d*\.?\d+(?:px|em|rem|%|vh|vw|pt)$", v))}
    return {}


# -- languages with a parser of their own
def test_type(name: str) -> str:
    """Kind of a test by its name; unit where it says nothing."""
    low = name.lower()
    return "integration" if "integration" in low or "e2e" in low else "unit" if "unit" in low else "performance" if "perf" in low else "unit"


def test_framework(text: str, x: ast.AST) -> str:
    """Framework of a test by its decorators and what the file imports."""
    if re.search(r"(?m)^\s*(?:import|from)\s+pytest\b", text) or any("pytest" in ast.unparse(d) for d in x.decorator_list):
        return "pytest"
    return next((f for f in ("unittest", "nose", "doctest") if re.search(rf"(?m)^\s*(?:import|from)\s+{f}\b", text)), "unknown")


def _python(text: str) -> tuple[list[Element], list[Dependency]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_by_pattern(text)
    els: list[Element] = []
    deps: list[Dependency] = []
    for x in ast.walk(tree):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = x.args
            names = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
            m = {
                "is_async": isinstance(x, ast.AsyncFunctionDef),
                "decorators": [ast.unparse(d) for d in x.decorator_list],
                "parameters": [{"name": n.arg, "type": ast.unparse(n.annotation) if n.annotation else None} for n in names],
                "return_type": ast.unparse(x.returns) if x.returns else None,
                "is_test": x.name.startswith("test"),
                **({"test_type": test_type(x.name), "test_framework": test_framework(text, x)} if x.name.startswith("test") else {}),
                "assertions_count": sum(isinstance(y, ast.Assert) or (isinstance(y, ast.Call) and isinstance(y.func, ast.Attribute) and y.func.attr.startswith("assert")) for y in ast.walk(x)),
                "docstring": ast.get_docstring(x),
            }
            els.append((x.name, "function", x.lineno - 1, x.end_lineno, "private" if x.name.startswith("_") and not x.name.startswith("__") else "public", "def", json.dumps(m)))
        elif isinstance(x, ast.ClassDef):
            own = [y for y in x.body if isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef))]
            m = {"base_classes": [ast.unparse(b) for b in x.bases], "decorators": [ast.unparse(d) for d in x.decorator_list], "methods_count": len(own), "test_methods_count": sum(y.name.startswith("test") for y in own), "docstring": ast.get_docstring(x)}
            els.append((x.name, "class", x.lineno - 1, x.end_lineno, "private" if x.name.startswith("_") else "public", "class", json.dumps(m)))
        elif isinstance(x, ast.Import):
            deps += [(n.name, "import", n.name, n.asname, x.lineno - 1) for n in x.names]
        elif isinstance(x, ast.ImportFrom):
            deps += [(n.name, "from", "." * x.level + (x.module or ""), n.asname, x.lineno - 1) for n in x.names]
    return els, deps


_PY = (("def", "function", re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)")), ("class", "class", re.compile(r"(?m)^([ \t]*)class[ \t]+(\w+)")))
_PY_IMPORT = re.compile(r"(?m)^[ \t]*import[ \t]+([\w., \t]+)")
_PY_FROM = re.compile(r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#]+))")


def _python_by_pattern(text: str) -> tuple[list[Element], list[Dependency]]:
    lines, line = text.split("\n"), Lines(text).at
    els, deps = [], []
    for kind, etype, rx in _PY:
        for m in rx.finditer(text):
            i = line(m.start())
            els.append((m[2], etype, i, _indent_end(lines, i), "private" if m[2].startswith("_") else "public", kind, json.dumps({"pattern_based": True, "indent_level": len(m[1])})))
    for m in _PY_IMPORT.finditer(text):
        for x in m[1].split(","):
            n, _, a = x.strip().partition(" as ")
            if n:
                deps.append((n.strip(), "import", n.strip(), a.strip() or None, line(m.start())))
    for m in _PY_FROM.finditer(text):
        for x in (m[2] or m[3]).split(","):
            n, _, a = x.strip().partition(" as ")
            if n:
                deps.append((n.strip(), "from", m[1], a.strip() or None, line(m.start())))
    return els, deps


#: fixed values: tags that make elements, by the type they make
_TAGS = {
    **dict.fromkeys("html head body header footer main nav section article aside div".split(), "module"),
    **dict.fromkeys("form input button select textarea table".split(), "class"),
    **dict.fromkeys("script style".split(), "function"),
    **dict.fromkeys("title meta link img video audio iframe".split(), "variable"),
}
_TAG = re.compile(r"<([A-Za-z][\w-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"([A-Za-z_:@][\w:.@-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def html_attributes(text: str) -> dict[str, str]:
    """Attributes of a tag: quoted, bare and boolean ('')."""
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(text)}


def _html(text: str) -> tuple[list[Element], list[Dependency]]:
    els: list[Element] = []
    deps: list[Dependency] = []
    for m in re.finditer(r"(?i)<!doctype([^>]*)>", text):
        i = text.count("\n", 0, m.start())
        els.append(("doctype", "module", i, i + 1, "public", "doctype", json.dumps({"doctype": m[1].strip()})))
    clean = re.sub(r"(?s)<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = Lines(clean).at
    for m in _TAG.finditer(clean):
        tag, at = m[1].lower(), html_attributes(m[2])
        i = line(m.start())
        src = {"script": at.get("src"), "img": at.get("src"), "video": at.get("src"), "audio": at.get("src"), "iframe": at.get("src"), "source": at.get("src"), "link": at.get("href") if "stylesheet" in at.get("rel", "") else None}.get(tag)
        if src:
            deps.append((src, {"img": "image", "link": "stylesheet"}.get(tag, tag), src, None, i))
        if tag not in _TAGS:
            continue
        end = i + 1
        if tag not in _VOID and not m[2].rstrip().endswith("/"):
            c = re.compile(rf"(?i)</{tag}\s*>").search(clean, m.end())
            end = line(c.start()) + 1 if c else end
        first = (at.get("class", "").split() or [""])[0]
        name = (at.get("id") or tag) + (f".{first}" if first else "")
        meta = {"tag": tag, "attributes": at, "has_id": "id" in at, "has_class": "class" in at}
        els.append((name, _TAGS[tag], i, end, "public", "tag", json.dumps(meta)))
        if tag in ("script", "style"):
            c = re.compile(rf"(?i)</{tag}\s*>").search(clean, m.end())
            body = clean[m.end() : c.start()] if c else ""
            els.append((f"{tag}_block", "module", i, end, "public", "embedded", json.dumps({"embedded_language": "javascript" if tag == "script" else "css", "content_length": len(body.strip()), "has_content": bool(body.strip())})))
    return els, deps


#: languages whose module names are parted by dots
_DOTTED = frozenset("java kotlin csharp swift generic".split())


def _import_names(kind: str, m: re.Match, language: str) -> list[tuple[str, str, str | None]]:
    """(name, source, alias) of one import match."""
    g = m.groupdict()
    if kind == "use" and "names" in g:  # Rust trees
        return [(p.rsplit("::", 1)[-1], p, a) for p, a in _use_tree(re.sub(r"\s+", " ", g["names"]))]
    source, alias = g["source"], (g.get("alias") or "").strip() or None
    names = (g.get("names") or "").strip()
    if not names:
        if "include" in kind:
            return [(source, source, None)]
        return [(g.get("name") or re.split(r"[/\\]|::|(?<=\w)\.(?=\w)" if language in _DOTTED and "/" not in source else r"[/\\]|::", source)[-1] or source, source, alias)]
    names = re.sub(r"\bfrom\s*$", "", names).strip()
    names = re.sub(r"^type\b\s*", "", names)
    out = []
    for part in split_list(names):
        if part.startswith("{"):
            for x in part.strip("{} ").split(","):
                n, _, a = re.sub(r"^\s*type\s+", "", x.strip()).replace(":", " as ").partition(" as ")
                if n.strip():
                    out.append((n.strip(), source, a.strip() or None))
        else:
            n, _, a = part.partition(" as ")
            out.append((n.strip(), source, a.strip() or None))
    return out


def _use_tree(t: str, head: str = "") -> list[tuple[str, str | None]]:
    t = t.strip()
    i = t.find("{")
    if i < 0:
        p, _, a = t.partition(" as ")
        return [(head + p.strip().replace(" ", ""), a.strip() or None)]
    head += t[:i].strip().replace(" ", "")
    out = []
    for part in split_list(t[i + 1 : t.rfind("}")]):
        if part == "self":
            out.append((head.removesuffix("::"), None))
        else:
            out += _use_tree(part, head)
    return out


#: lines from which a data or markup file is read like any other text
LEAST_LINES = 50
#: short data and markup files: suffix -> what stands for an element, its type and its kind
_KEYS = {
    ".json": (re.compile(r'(?m)^[ \t]*"([^"\n]+)"[ \t]*:'), "variable", "json_key"),
    ".yaml": (re.compile(r"(?m)^([A-Za-z_]\w*)[ \t]*:"), "variable", "yaml_key"),
    ".yml": (re.compile(r"(?m)^([A-Za-z_]\w*)[ \t]*:"), "variable", "yaml_key"),
    ".xml": (re.compile(r"<([A-Za-z][\w:-]*)[^<>]*>"), "class", "xml_tag"),
    ".html": (re.compile(r"<([A-Za-z][\w-]*)[^<>]*>"), "class", "html_tag"),
    ".dockerfile": (re.compile(r"(?m)^([A-Z]+)[ \t]+\S"), "function", "dockerfile_instruction"),
}


def _by_keys(text: str, suffix: str) -> list[Element] | None:
    """Elements of a short data or markup file by its keys, tags or instructions; None for any other."""
    if suffix not in _KEYS or text.count("\n") + 1 >= LEAST_LINES:
        return None
    rx, etype, kind = _KEYS[suffix]
    line = Lines(text).at
    found = [(m[1], line(m.start(1))) for m in rx.finditer(text)]
    return [(f"{n}_{i}" if kind == "dockerfile_instruction" else n, etype, i, i + 1, "public", kind, json.dumps({"pattern_type": kind, "is_generic_parse": True})) for n, i in found]


def parse(text: str | None, key: str, suffix: str = "", own: dict[str, Language] | None = None, *, dedup: bool = True) -> tuple[list[Element], list[Dependency]]:
    """Elements sorted by line and dependencies of one text; broken matches are skipped, never raised.

    ``suffix`` tells the generic parser what a short data or markup file is;
    ``own`` holds languages that are registered beside the built-in ones.  Of the
    elements several passes find under one name and line the first is kept, or
    all are, in the order of the passes, for ``dedup_elements``.
    """
    if not text or not key:
        return [], []
    lang = (own or {}).get(key) or LANGUAGES.get(key) or LANGUAGES["generic"]
    if lang.parser:
        els, deps = lang.parser(text)
        els, deps = list(els), list(deps)
    elif key == "python":
        els, deps = _python(text)
    elif key == "html":
        els, deps = _html(text)
    elif lang.name == "generic" and (keys := _by_keys(text, suffix)) is not None:
        els, deps = keys, []
    else:
        lines, line = text.split("\n"), Lines(text).at
        els, deps, seen = [], [], set()
        state_at: dict[int, str] = {}
        if lang.visibility in ("section", "ruby"):
            now = None
            for i, x in enumerate(lines):
                state_at[i] = now  # that of a class is the state around it, that of its members follows
                if s := re.match(r"\s*(public|private|protected)\s*:?\s*$", x):
                    now = s[1]
                elif re.match(r"\s*(?:class|struct|module)\b", x):
                    now = "public" if lang.name == "ruby" or "struct" in x else "private"
                elif x.startswith(("}", "end")):
                    now = None
        for p in lang.patterns:
            for m in p.regex.finditer(text):
                name = m["name"].strip()
                if not name or name in STOP or text[m.start() : m.start("name")].lstrip().startswith((lang.line_comment, "*")):
                    continue
                i = line(m.start("name"))
                if dedup and (name, i) in seen:
                    continue
                seen.add((name, i))
                end = _ENDS[p.end](lines, i)
                g = m.groupdict()
                decl = " ".join(x.strip() for x in lines[i : min(end, i + 4)]).partition("{")[0] if p.end != "line" else lines[i]
                mods = g.get("mods") or ""
                etype = p.type
                if etype == "function" and g.get("lead") and lang.name in ("kotlin", "php", "swift", "dart", "csharp", "rust"):
                    etype = "method"
                meta = _metadata(lang, p, name, decl, g.get("lead") or "", mods, lines[i:end], g)
                if key == "cpp" and p.type in ("class", "struct", "function"):
                    above = next((x for j in range(i - 1, -1, -1) if (x := lines[j].strip())), "")
                    meta["is_template"] = above.startswith("template") or lines[i].lstrip().startswith("template")
                els.append((name, etype, i, end, _visibility(lang, name, decl, mods, state_at.get(i)), p.kind, json.dumps(meta)))
        for im in lang.imports:
            for m in im.regex.finditer(text):
                i = line(m.start())
                if m.groupdict().get("block") is not None:
                    for k, row in enumerate(m["block"].split("\n")):
                        if x := re.match(r'\s*(?:([\w.]+)\s+)?"([^"]+)"', row):
                            deps.append((x[2].rsplit("/", 1)[-1], "import", x[2], x[1], i + k))
                    continue
                deps += [(n, im.kind, s, a, i) for n, s, a in _import_names(im.kind, m, lang.name)]
        if key == "bash":
            deps += [(c, "external_command", c, None, 0) for c in set(_EXTERNAL.findall(re.sub(r"(?m)#.*$", "", text)))]
    els.sort(key=(lambda e: (e[2], e[5], e[0])) if dedup else (lambda e: e[2]))
    deps = sorted(set(deps), key=lambda d: (d[4], d[2], d[0], d[1], d[3] or ""))
    return els, deps


_OUT = (
    "struct<elements:array<struct<name:string,element_type:string,start_line:int,end_line:int,visibility:string,pattern:string,metadata:string>>,"
    "dependencies:array<struct<name:string,import_type:string,source:string,alias:string,line_number:int>>>"
)


def analyse(files: DataFrame, *, text: str = "content", language: str = "language", path: str = "relative_path", out: str = "analysis", keep_all: bool = False, dedup: bool = True) -> DataFrame:
    """The files with a parser and a struct of arrays: elements and dependencies of each.

    Files without a parser are left out, or stand with empty arrays if all are kept.
    """

    own = added()  # travels with the job, as workers only know the built-in ones

    @arrow_udf(_OUT)
    def run(t: pd.Series, k: pd.Series, s: pd.Series) -> pd.DataFrame:
        e_names = ("name", "element_type", "start_line", "end_line", "visibility", "pattern", "metadata")
        d_names = ("name", "import_type", "source", "alias", "line_number")
        es, ds = [], []
        for a, b, c in zip(t, k, s):
            els, deps = parse(a, b, c or "", own, dedup=dedup)
            es.append([dict(zip(e_names, x)) for x in els])
            ds.append([dict(zip(d_names, x)) for x in deps])
        return pd.DataFrame({"elements": es, "dependencies": ds})

    key = parser_key(F.col(language), F.col(path))
    return (files if keep_all else files.where(key.isNotNull())).withColumn("parser", key).withColumn(out, run(F.col(text), F.col("parser"), extension(F.col(path))))


def elements(analysed: DataFrame, *keep: str, analysis: str = "analysis") -> DataFrame:
    return analysed.select(*keep, "parser", F.posexplode(f"{analysis}.elements").alias("element_no", "e")).select(*keep, "parser", "element_no", "e.*")


def dependencies(analysed: DataFrame, *keep: str, analysis: str = "analysis") -> DataFrame:
    return analysed.select(*keep, "parser", F.explode(f"{analysis}.dependencies").alias("d")).select(*keep, "parser", "d.*")
