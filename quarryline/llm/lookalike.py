"""Visually identical text with different characters (problem 10).

Normalization works on unstable segments only: a quick-check class, computed
from the character properties, finds the characters that any rule could change;
each run of them is normalized together with the character before it (the
boundary a combining mark may join) and spliced back, so unchanged text is never
copied character by character.

The form keeps what a reader sees: letters, digits, accents, case, line breaks
and the number of spaces.  Full-width and half-width forms, joined letters,
mathematical letters, kinds of space and of hyphen take their plain form,
invisible characters go, accents are composed, and inside a word of several
scripts look-alike letters take the script of the others.  Texts are compared on
the skeleton of the form, in which every look-alike letter is the Latin one.

Defined results: null texts have no form; empty texts have an empty form and
never make a pair; texts of equal characters are never paired.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

from .common import cut

#: documents of one text under one key
PER_TASK = 50_000


def _chars(points: str) -> str:
    return "".join(chr(int(x, 16)) for x in points.split())


#: fixed values: code points that have no width
INVISIBLE = _chars("00ad 034f 061c 115f 1160 17b4 17b5 180b 180c 180d 180e 180f 200b 200c 200d 200e 200f 202a 202b 202c 202d 202e 2060 2061 2062 2063 2064 2066 2067 2068 2069 fe00 fe01 fe02 fe03 fe04 fe05 fe06 fe07 fe08 fe09 fe0a fe0b fe0c fe0d fe0e fe0f feff")
#: fixed values: code points a reader sees as a space, as a hyphen
SPACES = _chars("00a0 1680 2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200a 202f 205f 3000")
HYPHENS = _chars("2010 2011 2012 2043 2212 fe63 ff0d 02d7")
#: fixed values: letters of other scripts and the Latin letters they look like
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ɡ": "g", "ɑ": "a", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ք": "p",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԁ": "D", "Ԍ": "G", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
#: fixed values: letters of Coptic, Cherokee and Lisu and the Latin letters they look like, in the order of the code points
_ALPHABETS = (
    ("2c80 2c82 2c88 2c8e 2c92 2c94 2c98 2c9a 2c9e 2c9f 2ca2 2ca3 2ca4 2ca5 2ca6 2ca8 2cac", "A B E H I K M N O o P p C c T Y X"),
    ("13a0 13a1 13a2 13aa 13ab 13ac 13b3 13b7 13bb 13c0 13c2 13c3 13da 13de 13df 13e2 13e6", "D R T A J E W M H G h Z S L C P K"),
    ("a4d0 a4d1 a4d3 a4d4 a4d6 a4d7 a4d9 a4da a4dc a4dd a4df a4e0 a4e1 a4e2 a4e3 a4e6 a4e7 a4ea a4eb a4ec a4ee a4f0 a4f2 a4f3 a4f4", "B P D T G K J C Z F M N L S R V H W X Y A E I O U"),
)
for _points, _letters in _ALPHABETS:
    LOOKALIKE.update(zip(_chars(_points), _letters.split()))
_TO_LATIN = str.maketrans(LOOKALIKE)
_PLAIN = {**dict.fromkeys(INVISIBLE, ""), **dict.fromkeys(SPACES, " "), **dict.fromkeys(HYPHENS, "-")}
_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _plain(c: str) -> str:
    """What one character is replaced by, itself if nothing."""
    if c in _PLAIN:
        return _PLAIN[c]
    d = unicodedata.decomposition(c)
    if d.startswith(_TAGS) or (d.startswith("<compat>") and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl")):
        return "".join(_PLAIN.get(x, x) for x in unicodedata.normalize("NFKC", c))
    return c


@lru_cache(None)
def _tables():
    """(class of unstable characters as a pattern, replacement of each)."""
    swap: dict[int, str] = {}
    runs: list[list[int]] = []
    for n in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)):  # all that has a decomposition or is invisible
        c = chr(n)
        p = "" if n >= 0xE0000 else _plain(c)
        if p != c:
            swap[n] = p
        elif not (unicodedata.combining(c) or 0x1161 <= n <= 0x11FF or n in (0x3099, 0x309A) or not unicodedata.is_normalized("NFC", c)):
            continue
        if n > 0xFFFF:
            continue  # one range below stands for all planes above the first, which keeps the class a table
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    body = "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)
    return re.compile(f"(?:[{body}]+|[{chr(0x10000)}-{chr(0x10FFFF)}]+)+"), swap


_OTHER = f"{chr(0x370)}-{chr(0x52F)}{chr(0x531)}-{chr(0x586)}{chr(0x251)}{chr(0x261)}{chr(0x13A0)}-{chr(0x13F5)}{chr(0x2C80)}-{chr(0x2CFF)}{chr(0xA4D0)}-{chr(0xA4FD)}"
_MIXED = re.compile(f"[^\\W\\d_]*(?:[A-Za-z][{_OTHER}]|[{_OTHER}][A-Za-z])[^\\W\\d_]*")
_OTHERS = re.compile(f"[{_OTHER}]")
_FROM_LATIN = {}
for _k, _v in LOOKALIKE.items():
    if 0x400 <= ord(_k) <= 0x52F:
        _FROM_LATIN.setdefault(_v, _k)


def _one_script(m: re.Match) -> str:
    w = m[0]
    cyr = sum(0x400 <= ord(c) <= 0x52F and c not in LOOKALIKE for c in w)
    lat = sum(c.isascii() and c not in _FROM_LATIN for c in w)
    return "".join(_FROM_LATIN.get(c, c) for c in w) if cyr > lat else w.translate(_TO_LATIN)


def composed(text: str) -> str:
    """The text with plain and composed characters, each letter left in its script."""
    if text.isascii():
        return text
    rx, swap = _tables()
    parts, done = [], 0
    for m in rx.finditer(text):
        a = max(m.start() - 1, done)  # the character a mark may join
        parts += (text[done:a], unicodedata.normalize("NFC", text[a : m.end()].translate(swap)))
        done = m.end()
    out = "".join(parts) + text[done:] if parts else text
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def normal_form(text: str | None) -> str | None:
    """The one consistent form of a text."""
    if text is None or text.isascii():
        return text
    out = composed(text)
    return _MIXED.sub(_one_script, out) if _OTHERS.search(out) else out


def skeleton(form: str) -> str:
    """The form with every look-alike letter in Latin, under whatever accents."""
    if form.isascii() or not _OTHERS.search(form):
        return form
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", form).translate(_TO_LATIN))


def normalize(df: DataFrame, *, text: str = "text", out: str = "form") -> DataFrame:
    """The rows with one more column, the consistent form of the text."""

    @arrow_udf("string")
    def form(t: pd.Series) -> pd.Series:
        return t.map(normal_form)

    return df.withColumn(out, form(F.col(text)))


def prints(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f1, f2, r1, r2): 128-bit hashes of the skeleton and of the text as it is, in two halves each."""

    @arrow_udf("struct<f1:long,f2:long,r1:long,r2:long>")
    def hashes(t: pd.Series) -> pd.DataFrame:
        import xxhash

        half, rows = 1 << 63, []
        for x in t:
            if not x:
                rows.append((None,) * 4)
                continue
            two = [divmod(xxhash.xxh3_128_intdigest(y.encode("utf-8", "surrogatepass")), 1 << 64) for y in (skeleton(normal_form(x)), x)]
            rows.append(tuple(v - half for h in two for v in h))
        return pd.DataFrame(rows, columns=["f1", "f2", "r1", "r2"], dtype=object)  # halves of 64 bits, which a column with gaps would round

    return df.select(F.col(id).alias("id"), hashes(F.col(text)).alias("h")).where("h.f1 is not null").select("id", "h.*")


FORM, TEXT = ["f1", "f2"], ["f1", "f2", "r1", "r2"]


def classes(p: DataFrame) -> DataFrame:
    """(id, f1, f2, r1, r2): membership of each document in its class of texts that look the same.

    Only classes that more than one text takes are kept: the least and the
    greatest hash of a form tell, in one aggregate with map-side combining, so
    exact copies and forms of one text go no further.
    """
    spans = p.groupBy(*FORM).agg(*[f(c).alias(f"{n}_{c}") for c in ("r1", "r2") for n, f in (("least", F.min), ("most", F.max))])
    several = spans.where("least_r1 <> most_r1 or least_r2 <> most_r2").select(*FORM)
    return p.select("id", *TEXT).join(several, FORM, "left_semi").distinct()


def text_pairs(members: DataFrame) -> DataFrame:
    """(f1, f2, then r1, r2, n of a and b): pairs of different texts of one class with the number of their documents, each once; no pair of documents is made."""
    texts = members.groupBy(*TEXT).agg(F.count("*").alias("n"))
    a, b = (texts.select(*FORM, *[F.col(c).alias(f"{c}_{x}") for c in ("r1", "r2", "n")]) for x in "ab")
    return a.join(b, FORM).where("r1_a < r1_b or (r1_a = r1_b and r2_a < r2_b)")


def pairs(p: DataFrame) -> DataFrame:
    """(doc_a, doc_b) whose texts agree in form and differ in characters.

    Different texts are paired first, as hashes; only those pairs are expanded
    to documents, so every row the joins make is a result.  Where a text has
    more than ``PER_TASK`` documents the pairs are cut into as many cells as the
    documents of both ask for, so that no key holds more of them on either side.
    """
    members = cut(classes(p))
    told = cut(text_pairs(members))
    side = {x: members.select(F.col("r1").alias(f"r1_{x}"), F.col("r2").alias(f"r2_{x}"), F.col("id").alias(x)) for x in "ab"}
    if (told.agg(F.max(F.greatest("n_a", "n_b"))).first()[0] or 0) <= PER_TASK:
        out = told.join(side["a"], ["r1_a", "r2_a"]).select("a", "r1_b", "r2_b").join(side["b"], ["r1_b", "r2_b"])
        return out.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
    keys = {x: [f"r1_{x}", f"r2_{x}", f"part_{x}"] for x in "ab"}
    number = {x: F.expr(f"cast(1 + n_{x} div {PER_TASK} as int)") for x in "ab"}
    texts = {x: told.select(f"r1_{x}", f"r2_{x}", number[x].alias("parts")).distinct() for x in "ab"}
    parts = {x: F.explode(F.sequence(F.lit(0), number[x] - 1)).alias(f"part_{x}") for x in "ab"}
    cells = told.select("r1_a", "r2_a", "r1_b", "r2_b", "n_b", parts["a"]).select(*keys["a"], "r1_b", "r2_b", parts["b"])
    found = {}
    for x in "ab":
        spread = side[x].join(texts[x], [f"r1_{x}", f"r2_{x}"]).withColumn(f"part_{x}", F.pmod(F.hash(x), F.col("parts"))).drop("parts")
        found[x] = cells.join(spread, keys[x])
    return found["a"].join(found["b"], [*keys["a"], *keys["b"]]).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
