"""Generated, minified, vendored and blob files (problem 1).

Repositories may declare such paths in attribute files (``.gitattributes`` with
``linguist-generated`` / ``linguist-vendored``).  Those rules are parsed and
resolved as git does, each of the two attributes by itself: the file of the
deepest directory wins over its parents, within a file the last matching line
wins, an explicit unset keeps a file whatever speaks for that attribute, and an
unspecified one (``!``) says nothing.

Repositories without a declaration get equivalent patterns, in the same syntax
and through the same resolution: known ones, and ones mined from the corpus.
Mined are directory names and compound suffixes of files that are declared, or
whose header says who wrote them; each repository has one vote, so no large one
decides for the others, and a repository whose own files speak against a
pattern is left out.  Files that no path speaks for are decided by their text: a
header of a tool or a third party, the shape of minified code, literals that
make up nearly the whole file.

Defined results: null or empty paths and contents give no evidence, so such a
file is kept; files without a repository are one repository; repeated rows give
one result per id.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

from .common import cut

#: fixed values: known patterns of undeclared repositories
DIRECTORY_PATTERNS = "\n".join(
    f"**/{x}/** linguist-{kind}"
    for kind, names in {
        "vendored": "node_modules bower_components jspm_packages site-packages dist-packages vendor vendored third_party third-party thirdparty 3rdparty 3rd-party external extern externals Pods Carthage deps upstream _vendor Godeps elm-stuff",
        "generated": "gen generated generated-sources generated-src __generated__ _generated autogen pb",
    }.items()
    for x in names.split()
)
#: fixed values: dependency lock files, names that tools give, names of files compressed for delivery; letter case does not matter
NAME_PATTERNS = "\n".join(
    f"{x} linguist-generated"
    for x in (
        "package-lock.json npm-shrinkwrap.json pnpm-lock.yaml packages.lock.json *.lock.json *.lock bun.lock go.sum pubspec.lock "
        "*.generated.* *.gen.* *.pb.* *.g.* *.designer.* *.pb.gw.* *_pb2.* *_pb2_grpc.* *_pb.* *_gen.* *_generated.* *_stub.* *_stubs.* "
        "*[.-]min.js *[.-]min.mjs *[.-]min.cjs *[.-]min.css *.bundle.js *.bundle.css *.js.map *.css.map"
    ).split()
)

#: fixed values: a tool says that it wrote the file
_TOOL = (
    r"@generated\b|<auto-?generated|\bauto-?generated\b.{0,40}(?:file|source|code|do not|don't|edit|by)|\bauto-?generated\s*:|\bauto-?generated (?:file|code|source)"
    r"|\b(?:code|file|source|automatically|machine|tool)[- ](?:was |is )?(?:automatically |auto-?)?(?:generated|written|produced|created) (?:by|from|with|using)\b"
    r"|\bgenerated (?:source|code|file)\b\s*[.:,-]|^generated (?:by|from|with|using)\b|\bgenerated (?:automatically|by the)\b|\bmachine-(?:written|generated)\b"
    r"|\b(?:do not|don't) (?:modify|edit|change)\b.{0,30}\b(?:re-?generate|generated)|\bre-?generate (?:it |this |this file )?(?:with|by|using)\b|\bany changes? (?:will|made).{0,20} be lost\b"
    r"|\bproduit par\b|\bg[ée]n[ée]r[ée] (?:par|automatiquement)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b|\bnicht von hand (?:bearbeiten|[äa]ndern)\b|\bne pas modifier\b|\bgenerado (?:por|autom)|\bno (?:editar|modificar) a mano\b|\bgenerato (?:da|autom)"
)
#: fixed values: someone else wrote the file
_THIRD = (
    r"\bvendored from\b|\bcopied (?:verbatim |unchanged |as is )?from\b.{0,60}(?:\d|http|tag|commit|version)|\bimported (?:snapshot|copy) of\b|\bupstream\s*:\s*\S+|\(c\) (?:\d{4},? )?the [\w.-]+ (?:contributors|authors|project|developers)\b"
    r"|\bthis (?:file|copy) (?:is|was) (?:taken|copied|imported) from\b|\bdo not patch here\b|\bsync(?:ed)? with scripts/\S+"
)
#: fixed values: phrases by which the authors say the opposite, and words that do so before the statement
_OURS = r"\bno longer\b|\bmaintained by hand\b|\bhand-?(?:written|maintained|edited)\b|\bour own\b|\bis ours\b|\bedit freely\b|\bnot generated\b|\breplaces\b|\bused to be\b"
_BEFORE = r"\b(?:unlike|once|formerly|previously|originally|instead of)\b"

_TOOL_RX, _THIRD_RX, _OURS_RX, _BEFORE_RX = (re.compile(x, re.I) for x in (_TOOL, _THIRD, _OURS, _BEFORE))
_COMMENT = re.compile(r"^\s*(?:#(?![!\[])|//[/!]?|/\*+!?|\*+|--|<!--|;+|%|\"\"\"|''')\s?(.*)$")
_LITERAL = re.compile(r"\"[A-Za-z0-9+/=\\_-]{200,}\"|'[A-Za-z0-9+/=\\_-]{200,}'|`[A-Za-z0-9+/=\s_-]{200,}`|(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[fFuUlL]?\s*,\s*){24,}[-+]?[\w.]*")
HEAD_LINES, TAIL_LINES = 12, 4
#: shape of minified code: characters per line and the share of white space
MIN_LINE, MIN_BLANK = 180, 0.09
BLOB_SHARE = 0.75
#: a pattern is mined when, by the lower bound of its confidence interval, so large a share of its files is marked
MINE_SHARE, MINE_Z = 0.4, 1.96
#: parts over which the files of one directory are spread when they meet its rules
SALTS = 16
_OPEN, _CLOSE = re.compile(r"^\s*(?:/\*|<!--)"), re.compile(r"\*/|-->")


def _block(lines) -> list[str]:
    """What the comments say that stand before the first line of another kind."""
    said, inside = [], False
    for line in lines:
        m = _COMMENT.match(line)
        if inside or m:
            said.append(m[1] if m else line)
        elif line.strip() and not line.startswith(("#!", "<?")):
            break
        inside = (inside or bool(_OPEN.match(line))) and not _CLOSE.search(line)
    return said


def header_kind(text: str) -> str | None:
    """'generated' or 'vendored' if a comment at either end of the file says so: the whole first and last block, and single lines near them."""
    lines = text.split("\n")
    near = lines if len(lines) <= HEAD_LINES + TAIL_LINES + 1 else lines[:HEAD_LINES] + lines[-TAIL_LINES - 1 :]
    said = [m[1] for x in near if (m := _COMMENT.match(x))] + _block(lines)
    for line in reversed(lines):
        m = _COMMENT.match(line)
        if m:
            said.append(m[1])
        elif line.strip():
            break
    for x in said:
        x = x.strip(" */->\r")
        if _OURS_RX.search(x):
            continue
        for rx, kind in ((_TOOL_RX, "generated"), (_THIRD_RX, "vendored")):
            if (m := rx.search(x)) and not _BEFORE_RX.search(x, 0, m.start()):
                return kind
    return None


def is_minified(path: str, text: str) -> bool:
    """Code or style sheets whose lines were joined for delivery."""
    if not re.search(r"(?i)\.(?:js|mjs|cjs|css|ts|jsx)$", path):
        return False
    body = [x for x in text.split("\n") if x.strip() and not re.match(r"\s*(?://[#@]|/\*)", x) or len(x) > MIN_LINE]
    if not body:
        return False
    size = sum(map(len, body))
    blank = sum(x.count(" ") + x.count("\t") for x in body)
    marks = sum(x.count(";") + x.count("}") + x.count("{") + x.count(",") for x in body)
    return size / len(body) > MIN_LINE and blank < MIN_BLANK * size and marks > 0.03 * size


def is_blob(text: str) -> bool:
    """Number lists or one long encoded string make up nearly the whole text."""
    inside = sum(m.end() - m.start() for m in _LITERAL.finditer(text))
    return inside > BLOB_SHARE * len(text.strip()) and inside >= 200


def kind_of_text(path: str | None, text: str | None) -> str | None:
    """Evidence in the content: generated, vendored, minified, blob or None.

    Prose and data files are no code, so figures in them are no blob and lines
    that begin like a comment are none; of these a markup comment at the top counts.
    """
    if not text or not text.strip():
        return None
    path = path or ""
    if re.search(r"(?i)\.(?:md|txt|rst|json)$", path) and not re.search(r"(?i)lock", path):
        return header_kind(text[: text.find("-->") + 3]) if text.lstrip().startswith("<!--") else None
    if re.search(r"(?i)\.(?:ya?ml|html?)$", path):
        return header_kind(text)
    return header_kind(text) or ("minified" if is_minified(path, text) else None) or ("blob" if is_blob(text) else None)


# -- attribute files
def glob_regex(pattern: str) -> str | None:
    """Anchored regular expression of one attribute pattern, relative to its directory."""
    if not pattern or pattern.startswith("!") or pattern.endswith("/"):
        return None
    anchored = "/" in pattern
    p, out, i = pattern.lstrip("/"), "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"\&&")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$"


def parse_attributes(text: str | None) -> list[tuple[int, str, str, bool | None]]:
    """(line, regex, attribute, marked) for each generated / vendored statement, in file order; an unspecified one has no mark."""
    out = []
    for n, line in enumerate((text or "").split("\n")):
        m = re.match(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))\s+(.*)$', line)
        if not m or line.lstrip().startswith("#"):
            continue
        rx = glob_regex(m[1] if m[1] is not None else m[2])
        for a in m[3].split():
            k = re.fullmatch(r"([-!])?(?:linguist-)?(generated|vendored)(?:=(\w+))?", a)
            if k and rx:
                out.append((n, rx, k[2], None if k[1] == "!" else not k[1] and (k[3] or "true").lower() not in ("false", "0", "no", "unset")))
    return out


ATTRIBUTES = ("generated", "vendored")
#: what many patterns begin and end with
_SHARED = (("^(?:[^/]+/)*", "/.+$"), ("^(?:.*/)?", "$"))


def any_of(rxs: list[str]) -> str:
    """One expression for any of them; what many begin and end with is written once."""
    out, rest = [], list(rxs)
    for a, b in _SHARED:
        inner = [x[len(a) : -len(b)] for x in rest if x.startswith(a) and x.endswith(b)]
        rest = [x for x in rest if not (x.startswith(a) and x.endswith(b))]
        out += [f"{a}(?:{'|'.join(inner)}){b}"] if inner else []
    return "|".join(out + rest)


def rules_say(path: Column, attribute: str, text: str, flags: str = "") -> Column:
    """What the rules of an attribute file at the root say of a path, null for nothing; the last matching line wins."""
    groups: list[tuple[bool | None, list[str]]] = []
    for _, rx, a, marked in parse_attributes(text):
        if a == attribute:
            if not groups or groups[-1][0] != marked:
                groups.append((marked, []))
            groups[-1][1].append(rx)
    out = F.lit(None).cast("boolean")
    for marked, rxs in groups:
        out = F.when(path.rlike(f"(?s{flags})" + any_of(rxs)), F.lit(marked).cast("boolean")).otherwise(out)
    return out


_ATTRIBUTE_FILE = r"(^|/)\.gitattributes$"


def declared(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, generated, vendored) of the files that attribute files of their repository speak of, null where they say nothing, and the repositories that have one.


    ``files`` has id, repo (not null), path and text.  Only attribute files are
    exploded into rules; files of repositories that have one bring id and path
    and meet the rules of their ancestor directories by key, in salted parts, as
    the root of a large repository is one directory.
    """

    @arrow_udf("array<struct<line:int,rx:string,attribute:string,marked:boolean>>")
    def rules(text: pd.Series) -> pd.Series:
        return text.map(parse_attributes)

    attr = cut(
        files.where(F.col("path").rlike(_ATTRIBUTE_FILE))
        .select("repo", F.regexp_replace("path", r"/?\.gitattributes$", "").alias("dir"), rules("text").alias("rs"))
        .select("repo", "dir", F.explode_outer("rs").alias("r"))
        .select("repo", "dir", "r.*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    at = files.where("path is not null").select("id", "repo", "path").join(attr.select("repo").distinct(), "repo", "left_semi")
    at = at.select("id", "repo", "path", F.explode(dirs).alias("dir"), F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"))
    hit = at.join(attr, ["repo", "dir", "salt"]).where(F.expr("(case when dir = '' then path else substring(path, length(dir) + 2) end) rlike rx"))
    last = hit.groupBy("id", "attribute").agg(F.max_by("marked", F.struct(F.length("dir"), "line")).alias("marked"))
    return cut(last.groupBy("id").agg(*[F.max(F.when(F.col("attribute") == a, F.col("marked"))).alias(a) for a in ATTRIBUTES])), attr.select("repo").distinct()


def _bound(n: Column, of: Column, side: int) -> Column:
    """Lower (-1) or upper (1) bound of the share n / of, after Wilson."""
    z, p = MINE_Z, n / of
    return (p + z * z / (2 * of) + side * z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def mine(seen: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Patterns that hold over the repositories, (candidate, attribute), and where they do not, (repo, candidate, attribute); None if none holds.

    ``seen`` has repo, candidates (array) and one boolean for each attribute.
    The vote of a repository is the share of its files that are marked; the
    bound is taken over votes, so it does not depend on how many files there are.
    """
    marks = [F.count_if(F.coalesce(a, F.lit(False))).alias(a) for a in ATTRIBUTES]
    local = seen.select("repo", F.explode("candidates").alias("candidate"), *ATTRIBUTES).groupBy("repo", "candidate").agg(F.count("*").alias("of"), *marks)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("n")) for a in ATTRIBUTES])).alias("v")
    shares = local.groupBy("candidate").agg(F.count("*").alias("repos"), *[F.sum(F.col(a) / F.col("of")).alias(a) for a in ATTRIBUTES]).select("candidate", "repos", each).select("candidate", "repos", "v.*")
    holds = cut(shares.where(_bound(F.col("n"), F.col("repos"), -1) >= MINE_SHARE).select("candidate", "attribute"))
    if holds.isEmpty():
        return None
    votes = local.join(holds.select("candidate").distinct(), "candidate", "left_semi").select("repo", "candidate", "of", each).select("repo", "candidate", "of", "v.*")
    against = votes.where(_bound(F.col("n").cast("double"), F.col("of"), 1) < MINE_SHARE).select("repo", "candidate", "attribute")
    return holds, against.join(holds, ["candidate", "attribute"], "left_semi")


def classify(files: DataFrame, *, id: str = "file_id", repo: str = "codebase", path: str = "relative_path", text: str = "content") -> DataFrame:
    """One row (id, kind) for each file nobody of the repository wrote by hand.

    ``kind`` is declared or pattern, else what the text says (generated,
    vendored, minified, blob), else mined.  The content is read once, in place; only ids, paths
    and verdicts move.
    """

    @arrow_udf("string")
    def evidence(p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([kind_of_text(a, b) for a, b in zip(p, t)], dtype=object)

    # a name for the files without repository that no repository has
    key = F.coalesce(F.concat(F.lit("="), F.col(repo).cast("string")), F.lit(""))
    cols = files.select(F.col(id).alias("id"), key.alias("repo"), F.col(path).alias("path"), F.col(text).alias("text"))
    p = F.col("path")
    known = [F.coalesce(rules_say(p, a, NAME_PATTERNS, "i"), rules_say(p, a, DIRECTORY_PATTERNS), F.lit(False)).alias(f"known_{a}") for a in ATTRIBUTES]
    seen = cut(cols.select("id", "repo", "path", *known, evidence("path", "text").alias("kind")))
    rows, declares = seen.select("*", *[F.lit(None).cast("boolean").alias(a) for a in ATTRIBUTES]), None
    if not seen.where(p.rlike(_ATTRIBUTE_FILE)).isEmpty():  # only then are texts read once more, those of attribute files
        said, declares = declared(cols)
        rows = seen.join(said, "id", "left")
    by = {a: F.coalesce(F.col(a), F.col("kind") == a) for a in ATTRIBUTES}
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"([._-][A-Za-z0-9]+\.[A-Za-z0-9]+)$", 1)
    candidates = F.array_distinct(
        F.concat(
            F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("**/"), x, F.lit("/**"))),
            F.when(suffix != "", F.array(F.concat(F.lit("*"), suffix))).otherwise(F.array().cast("array<string>")),
        )
    )
    mined = mine(rows.where("path is not null").select("repo", candidates.alias("candidates"), *[by[a].alias(a) for a in ATTRIBUTES]))

    # each attribute by itself: an explicit unset keeps what speaks for it from counting
    way = {
        "vendored": F.when(F.col("known_vendored"), F.lit("pattern")).when(F.col("kind") == "vendored", F.col("kind")),
        "generated": F.when(F.col("known_generated"), F.lit("pattern")).when(F.col("kind") != "vendored", F.col("kind")),
    }
    ways = [F.when(F.coalesce(F.col(a), F.lit(True)), way[a]) for a in ATTRIBUTES]
    kind = F.when(F.coalesce(F.col("generated"), F.lit(False)) | F.coalesce(F.col("vendored"), F.lit(False)), F.lit("declared")).otherwise(F.coalesce(F.when(ways[0] == "pattern", ways[0]), F.when(ways[1] == "pattern", ways[1]), *ways))
    found = rows.select("id", kind.alias("kind")).where("kind is not null")
    if mined:
        plain = seen.where("path is not null and kind is null and not known_generated and not known_vendored")
        plain = plain.join(declares, "repo", "left_anti") if declares else plain
        told = plain.select("id", "repo", F.explode(candidates).alias("candidate")).join(mined[0], "candidate").join(mined[1], ["repo", "candidate", "attribute"], "left_anti")
        found = found.unionByName(told.select("id", F.lit("mined").alias("kind")))
    return found.groupBy("id").agg(F.min("kind").alias("kind")).select(F.col("id").alias(id), "kind")
