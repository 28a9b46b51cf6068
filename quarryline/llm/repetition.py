"""Repeated content inside one document (problem 5).

Compression bands decide: the whole text and its fixed chunks are compressed
with zstandard, case and list marks removed, and the ratios are held against
limits for texts of that length.  Under the lowest limit a text is repetitive,
over the highest it is incompressible, and between the middle one and the
highest it is plain; all three are settled by the band.  What lies between the
lowest and the middle limit is checked exactly: it is repetitive if more than
half of its word characters lie in a run of words already seen earlier in the
text, first occurrences not counted, case and list marks ignored.

The same exact share is the measure given for each document, whatever its band.

Defined results: null, empty and blank texts have share 0.0, no ratio and the
band ``empty``; a text without words has share 0.0.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

CHUNK = 4096
#: (length in bytes up to which it holds, ratio under which a text is repetitive, from which none is, over which it is incompressible)
BANDS = (
    (64, 0.30, 2.0, 2.0),
    (128, 0.30, 0.9, 1.3),
    (256, 0.30, 0.75, 1.1),
    (512, 0.28, 0.62, 1.0),
    (1024, 0.22, 0.56, 0.95),
    (4096, 0.16, 0.5, 0.9),
    (1 << 62, 0.12, 0.48, 0.88),
)
#: shortest run of words that counts as a repetition
RUN = 4
_MARK = re.compile(r"(?m)^[ \t]*(?:[-*+•–]|\d+[.)]|[a-zA-Z][.)]|#+|>+)[ \t]+")
_WORD = re.compile(r"\w+", re.U)


def ratios(text: str) -> tuple[float, float, int]:
    """zstandard ratio of the whole text, the least ratio of its fixed chunks, and the length in bytes; the last chunk ends with the text."""
    import zstandard

    raw = _MARK.sub("", text.casefold()).encode("utf-8", "surrogatepass") or b" "
    n = len(raw)
    z = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
    whole = len(z.compress(raw)) / n
    if n <= CHUNK:
        return whole, whole, n
    return whole, min(len(z.compress(raw[i : i + CHUNK])) / CHUNK for i in (*range(0, n - CHUNK, CHUNK), n - CHUNK)), n


def band(size: int, whole: float, least: float) -> str:
    """'repetitive', 'check', 'plain' or 'incompressible'."""
    sure, none, dense = next(x[1:] for x in BANDS if size <= x[0])
    if whole > dense:
        return "incompressible"
    if whole < sure:
        return "repetitive"
    return "check" if min(whole, least) < none else "plain"


def repeated_share(text: str | None) -> float:
    """Share of the word characters that repeat what stands earlier in the text."""
    if not text:
        return 0.0
    words = _WORD.findall(_MARK.sub("", text.casefold()))
    n = len(words)
    total = sum(map(len, words))
    if n < 2 or not total:
        return 0.0
    ids: dict[str, int] = {}
    w = [ids.setdefault(x, len(ids)) for x in words]
    covered = bytearray(n)
    seen: set[tuple[int, ...]] = set()
    for i in range(n - RUN + 1):
        g = tuple(w[i : i + RUN])
        if g in seen:
            covered[i : i + RUN] = b"\1" * RUN
        else:
            seen.add(g)
    # the same word, or the same two or three words, at once again
    for p in (1, 2, 3):
        i = p
        while i < n:
            j = i
            while j < n and w[j] == w[j - p]:
                j += 1
            if j - i >= p and (j - i >= 2 * p or p > 1):
                covered[i:j] = b"\1" * (j - i)
            i = j + 1
    # whole lines and sentences shorter than a run
    at = 0
    units: set[tuple[int, ...]] = set()
    for part in re.split(r"(?<=[.!?。])\s+|\n", _MARK.sub("", text.casefold())):
        k = len(_WORD.findall(part))
        if 2 <= k < RUN:
            u = tuple(w[at : at + k])
            if u in units:
                covered[at : at + k] = b"\1" * k
            units.add(u)
        at += k
    return sum(len(x) for x, c in zip(words, covered) if c) / total


def measure(text: str | None, shares: bool = True) -> tuple[float | None, float | None, str, float | None, bool]:
    """(ratio, least ratio of a chunk, band, share, repetitive); the share is left out where neither the band nor ``shares`` asks for it."""
    if text is None or not text.strip():
        return None, None, "empty", 0.0, False
    whole, least, size = ratios(text)
    b = band(size, whole, least)
    share = repeated_share(text) if shares or b == "check" else None
    return whole, least, b, share, b == "repetitive" or (b == "check" and share > 0.5)


def repetition(df: DataFrame, *, text: str = "summary", out: str = "repetition", shares: bool = True) -> DataFrame:
    """The rows with a struct (ratio, least_chunk_ratio, band, share, repetitive).

    Without ``shares`` the exact share is measured only where the band leaves the verdict open.
    """

    @arrow_udf("struct<ratio:double,least_chunk_ratio:double,band:string,share:double,repetitive:boolean>")
    def m(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x, shares) for x in t], columns=["ratio", "least_chunk_ratio", "band", "share", "repetitive"])

    return df.withColumn(out, m(F.col(text)))
