"""Byte-pair encodings of public tokenizers: ids (problem 8) and counts (problem 7).

``encode`` works per word on a contiguous rank array: part boundaries and the
rank of each adjacent pair are held in two flat lists, the least rank is scanned
for, its boundary deleted, and the ranks left and right of it refreshed.  Words
over ``SHORT`` bytes use the same merges from a heap, so no word is quadratic.

``count`` needs no merges and builds no ids: an Aho-Corasick automaton of the
vocabulary gives the tokens that end at each byte, longest first, and the first
one that is compatible with the last token of the prefix before it is the last
token of the encoding of this prefix.  One walk over the word counts it.

Defined results: null and empty texts have no ids and count 0; a text of blanks
is encoded as it is; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.arrow import arrow_udf

#: where the vocabulary files lie; a parameter of every operator here
VOCABULARIES = os.environ.get("QUARRYLINE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: fixed value: how byte-level BPE of this family cuts a text into words
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 128
CACHE = 1 << 20
_NONE = 1 << 60


class Encoder:
    """Exact encodings of one vocabulary of ranked byte strings."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern).findall
        self._ids = _Cache(self._word_ids)
        self._counts = _Cache(self._word_count)
        self._tables = None

    # -- ids
    def merge(self, word: bytes, below: int = _NONE) -> list[int]:
        """Part boundaries of a word after all merges of a rank under ``below``."""
        n = len(word)
        if n > SHORT:
            return self._merge_long(word, below)
        get = self.ranks.get
        at = list(range(n + 1))
        rank = [get(word[i : i + 2], _NONE) for i in range(n - 1)]
        while rank:
            least = min(rank)
            if least >= below:
                break
            i = rank.index(least)
            del at[i + 1]
            del rank[i]
            if i < len(rank):
                rank[i] = get(word[at[i] : at[i + 2]], _NONE)
            if i:
                rank[i - 1] = get(word[at[i - 1] : at[i + 1]], _NONE)
        return at

    def _merge_long(self, word: bytes, below: int) -> list[int]:
        get, n = self.ranks.get, len(word)
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2], _NONE)) < below]
        heapq.heapify(heap)
        while heap:
            r, i, end = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or nxt[j] != end:
                continue
            alive[j] = 0
            nxt[i] = end
            if end < n:
                prv[end] = i
                if (r := get(word[i : nxt[end]], _NONE)) < below:
                    heapq.heappush(heap, (r, i, nxt[end]))
            p = prv[i]
            if p >= 0 and (r := get(word[p:end], _NONE)) < below:
                heapq.heappush(heap, (r, p, end))
        return [i for i in range(n) if alive[i]] + [n]

    def _word_ids(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        if (r := self.ranks.get(raw)) is not None:
            return (r,)
        at = self.merge(raw)
        return tuple(self.ranks[raw[a:b]] for a, b in zip(at, at[1:]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self._ids.__getitem__, self.words(text))))

    # -- counts
    def _compile(self):
        import ahocorasick

        size = max(self.ranks.values()) + 1
        left, right = list(range(size)), list(range(size))
        pair: dict[tuple[int, int], int] = {}
        auto = ahocorasick.Automaton()
        for raw, r in self.ranks.items():
            auto.add_word(raw.decode("latin-1"), (r, len(raw)))
            if len(raw) > 1:
                at = self.merge(raw, r)
                if len(at) == 3:  # else no merge leads to this token
                    left[r], right[r] = self.ranks[raw[: at[1]]], self.ranks[raw[at[1] :]]
                    pair[left[r], right[r]] = r
        auto.make_automaton()
        self._tables = (auto, left, right, pair)
        return self._tables

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is these two tokens.

        The merges that made both are undone from the latest on; if a merge
        across the boundary would have come before any of them, it is not.
        """
        _, left, right, pair = self._tables or self._compile()
        limit = _NONE
        while True:
            across = pair.get((a, b), _NONE)
            if across < limit:
                return False
            if a > b or (left[b] == b):
                if left[a] == a:
                    if left[b] == b:
                        return True
                    limit = b + 1 if b + 1 < limit else limit
                    b = left[b]
                    continue
                limit = a
                a = right[a]
            else:
                limit = b + 1
                b = left[b]

    def _word_count(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        if raw in self.ranks:
            return 1
        auto = (self._tables or self._compile())[0]
        n = len(raw)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (tok, size) in auto.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start and (last[start] < 0 or not self.compatible(last[start], tok)):
                continue
            last[end] = tok
            count[end] = count[start] + 1
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self._counts.__getitem__, self.words(text)))


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        v = self.make(key)
        if len(self) >= CACHE:
            self.clear()
        if len(key) <= 64:
            self[key] = v
        return v


@lru_cache(4)
def encoder(vocabulary: str = BYTE_BPE_50K, folder: str | None = None) -> Encoder:
    """The encoder of a vocabulary file, compiled once per process."""
    return Encoder(os.path.join(folder or VOCABULARIES, vocabulary))


def token_count(text: Column, vocabulary: str = BYTE_BPE_50K, folder: str | None = None) -> Column:
    """Exact number of tokens of a text column."""

    @arrow_udf("long")
    def count(t: pd.Series) -> pd.Series:
        return t.map(encoder(vocabulary, folder).count, na_action=None).astype("int64")

    return count(text)


def encode(df: DataFrame, *, id: str = "doc_id", text: str = "text", out: str = "ids", vocabulary: str = BYTE_BPE_50K, folder: str | None = None) -> DataFrame:
    """(id, ids) of each row, moved in Arrow batches without Python lists per row."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        e = encoder(vocabulary, folder)
        for b in it:
            flat: list[int] = []
            ends = [0]
            for t in b.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(e._ids.__getitem__, e.words(t))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.array(flat, "int32")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id, out])

    src = df.select(F.col(id).alias(id), F.col(text).cast("string").alias("__text"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(batches, f"`{id}` {kind}, `{out}` array<int>")
