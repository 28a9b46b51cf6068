"""Duplicates hidden by formatting differences (problem 4).

Each content is brought to a canonical form: characters composed and brought to
their plain width, case folded, white space and punctuation removed (marks that
belong to a letter stay), fields put in one order (the keys of JSON objects at
any depth, the lines of settings files, the top-level entries of YAML).  The
form is hashed to 128 bits; groups are formed on hashes alone, so what is
shuffled is bounded by the number of records, and counts are combined before
the shuffle.

Whether fields are put in order depends on the kind of file, so one content may
stand under two forms.  Each record therefore carries a second hash, of its
text as it stands but for white space and case; forms that share a text are one
group.  Only such forms are linked, as hashes, and their links are followed until
nothing changes.

A collision of the 128 bits is looked for on two further, independent figures of
the form (its length and a second 64-bit hash): a group that holds more than one
value of them is split by them, so unequal contents never share a record.

Defined results: null and blank contents, and contents without any letter or
digit, are left out; repeated rows of one id count once; ties do not exist, the
kept id is the smallest.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

from .common import cut
from .lookalike import composed

SETTINGS = re.compile(r"(?i)(?:\.(?:env|ini|cfg|conf|properties|toml|cnf|editorconfig)|(?:^|/)\.env(?:\.[\w-]+)?|\.env\.[\w-]+)$")
YAML = re.compile(r"(?i)\.ya?ml$")
JSON = re.compile(r"(?i)\.(?:json|jsonl|geojson|webmanifest)$")
_SLICE = re.compile(r":\d+-\d+$")
_DROP = re.compile(r"[\W_]+")
# other alphabets: marks, which stand for vowels in some of them, belong to their letter
_DROP_WIDE = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def squeeze(text: str) -> str:
    """Characters composed and of plain width, case folded, letters with their marks and digits only."""
    if text.isascii():
        return _DROP.sub("", text.lower())
    return _DROP_WIDE.sub("", composed(composed(text).casefold()))


def _json_form(v) -> str:
    if isinstance(v, list) and v and isinstance(v[0], _Pair):
        return "{" + ",".join(sorted(f"{squeeze(p.key)}:{_json_form(p.value)}" for p in v)) + "}"
    if isinstance(v, _Empty):
        return "{}"
    if isinstance(v, list):
        return "[" + ",".join(map(_json_form, v)) + "]"
    if isinstance(v, str):
        return squeeze(v)
    return squeeze(json.dumps(v))


class _Pair:
    __slots__ = ("key", "value")

    def __init__(self, key, value):
        self.key, self.value = key, value


class _Empty:
    pass


def _pairs(items):
    return [_Pair(k, v) for k, v in items] or _Empty()


def canonical(text: str | None, path: str | None = None, language: str | None = None) -> str | None:
    """The canonical form, None for contents that are left out."""
    if text is None or not text.strip():
        return None
    p = _SLICE.sub("", path or "")
    lang = (language or "").strip().lower()
    body = text.strip()
    if body[:1] in "{[" and (JSON.search(p) or not re.search(r"\.\w+$", p) or lang == "json"):
        try:
            return "j" + _json_form(json.loads(body, object_pairs_hook=_pairs, parse_constant=str, parse_int=str, parse_float=str))
        except (ValueError, RecursionError):
            pass
    if SETTINGS.search(p):
        form = "\n".join(sorted(x for x in map(squeeze, body.splitlines()) if x))
    elif YAML.search(p) or (lang in ("yaml", "yml") and not p):
        entries: list[str] = []
        for line in body.splitlines():
            if entries and (line[:1] in " \t" or re.match(r"[-\]})]", line) or not line.strip()):
                entries[-1] += line
            else:
                entries.append(line)
        form = "\n".join(sorted(x for x in map(squeeze, entries) if x))
    else:
        form = squeeze(body)
    return "t" + form if form else None


def fingerprints(df: DataFrame, *, id: str = "request_id", text: str = "content", path: str = "file_path", language: str = "language") -> DataFrame:
    """(id, h1, h2, n, p1, p2): 128-bit hash, 64-bit hash and length of each canonical form, both halves of a 128-bit hash of the text but for white space and case."""

    @arrow_udf("struct<h1:string,h2:long,n:long,p1:long,p2:long>")
    def form(t: pd.Series, p: pd.Series, g: pd.Series) -> pd.DataFrame:
        import xxhash

        out = []
        for a, b, c in zip(t, p, g):
            f = canonical(a, b, c)
            if f is None:
                out.append((None,) * 5)
            else:
                raw = f.encode("utf-8", "surrogatepass")
                same = "".join(a.split()).casefold().encode("utf-8", "surrogatepass")
                halves = divmod(xxhash.xxh3_128_intdigest(same), 1 << 64)
                out.append((xxhash.xxh3_128_hexdigest(raw), xxhash.xxh64_intdigest(raw, 7) - (1 << 63), len(raw), *[h - (1 << 63) for h in halves]))
        return pd.DataFrame(out, columns=["h1", "h2", "n", "p1", "p2"], dtype=object)  # 64 bits, which a column with gaps would round

    return df.select(F.col(id).alias("id"), form(F.col(text), F.col(path), F.col(language)).alias("f")).where("f.h1 is not null").select("id", "f.*")


_FORM, _PLAIN = ["h1", "h2", "n"], ["p1", "p2"]


def _linked(prints: DataFrame) -> DataFrame | None:
    """(h1, h2, n, root) of the forms that share a text with another form, None if there is none.

    A text stands under at most four forms, one a kind of file.  Labels sink
    along the links until none changes; a chain needs two texts of different
    kinds a step, so there are few.
    """
    form = F.struct(*_FORM)
    # two figures of a fixed width tell which texts have several forms; only those bring their forms along
    several = cut(prints.groupBy(*_PLAIN).agg(F.min("h2").alias("least"), F.max("h2").alias("most")).where("least <> most").select(*_PLAIN))
    if several.isEmpty():
        return None
    forms = prints.join(several, _PLAIN, "left_semi").groupBy(*_PLAIN).agg(F.collect_set(form).alias("forms"))
    edges = cut(forms.select(F.array_min("forms").alias("a"), F.explode("forms").alias("b")).where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        lower = both.join(labels.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        following = cut(labels.join(lower, "a").select("a", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")))
        if not following.where("moved").limit(1).count():
            return labels.select("a.*", F.struct("root.*").alias("root"))
        labels = following.select("a", "root")


def _grouped(prints: DataFrame) -> DataFrame:
    """(id, h1, h2, n), one row an id, linked forms under one of them."""
    ids = prints.select("id", *_FORM).distinct()
    links = _linked(prints) if "p1" in prints.columns else None
    if links is None:
        return ids
    return ids.join(links, _FORM, "left").select("id", F.coalesce("root", F.struct(*_FORM)).alias("f")).select("id", "f.*")


def _counts(ids: DataFrame) -> DataFrame:
    return ids.groupBy(*_FORM).agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))


def copies(prints: DataFrame) -> DataFrame:
    """One row (keep_id, n_copies, h1) for each content; counts are combined before the shuffle."""
    return _counts(_grouped(prints))


def duplicate_pairs(prints: DataFrame) -> DataFrame:
    """(keep_id, copy_id): each copy under the smallest id of its content.

    The smallest id comes from an aggregate with map-side combining and is
    joined back on the hash, so a content that a third of all rows carry is
    split by the join instead of being sorted in one task.
    """
    ids = _grouped(prints)
    kept = _counts(ids).where("n_copies > 1").select(*_FORM, "keep_id")
    return ids.join(kept, _FORM).where("id > keep_id").select("keep_id", F.col("id").alias("copy_id"))
