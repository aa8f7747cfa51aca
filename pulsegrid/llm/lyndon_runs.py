"""Periodic runs of words by Lyndon factors, in linear time and by comparing symbols alone: no suffix array, no hashes.

Every run has a root that is the longest Lyndon word at its place, in the order of symbols or in the reverse one, so the
pairs (i, next smaller suffix of i) of both orders hold all runs; a pair is a run if what matches after and before it is
long enough. `edges` finds these pairs and how far both sides match on, `before` how far they match backwards. Both keep
the match that reaches farthest: within it every comparison has been made before, at its copy, and is read from there, so
that symbols are compared only beyond it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import small

#: A run has LEAST words and EXPONENT periods at least.
LEAST, EXPONENT = 6, 4
_WORD = re.compile("[^ \t-\r]+")


class Run(NamedTuple):
    start: int
    length: int
    period: int


def edges(s: list[int]) -> tuple[list[int], list[int]]:
    """For each i the start of the next suffix that is smaller than suffix i (len(s) if there's none), and how many symbols
    these two have in common.

    Goes from left to right over a chain of smaller suffixes. For r its elements l are compared with r, nearest first, until one is
    smaller. What they have in common with r never shrinks along the chain, so only ties with what the chain's own neighbours
    have in common need symbols, and of these only what lies beyond the farthest match.
    """
    n = len(s)
    following, match = [n] * n, [0] * n
    preceding, kept = [-1] * n, [0] * n
    reach = shift = 0
    for r in range(1, n):
        left, c = r - 1, 0
        while left >= 0:
            known = -1
            if r + c < reach:
                a, b = left - shift, r - shift
                if following[a] == b:
                    known = match[a]
                elif preceding[b] == a:
                    known = kept[b]
            if 0 <= known < reach - r:
                c = known
            else:
                c = max(c, reach - r)
                while r + c < n and s[left + c] == s[r + c]:
                    c += 1
                reach, shift = r + c, r - left
            if r + c < n and s[left + c] < s[r + c]:
                preceding[r], kept[r] = left, c
                break
            while True:
                following[left], match[left] = r, c
                k = kept[left]
                left = preceding[left]
                if left < 0 or k <= c:
                    break
            if left >= 0 and k < c:
                preceding[r], kept[r] = left, k
                break
    return following, match


def before(s: list[int], following: list[int]) -> list[int]:
    """For each i how many symbols before i and before following[i] are the same; from right to left, with the match that
    reaches farthest to the left."""
    n = len(s)
    out = [0] * n
    reach, shift = n, 0
    for i in range(n - 1, -1, -1):
        j = following[i]
        if j == n:
            continue
        c = 0
        if i > reach:
            c = min(out[i + shift], i - reach)
            if c < i - reach:
                out[i] = c
                continue
        while i > c and s[i - c - 1] == s[j - c - 1]:
            c += 1
        out[i] = c
        reach, shift = i - c, j - i
    return out


def _runs(s: list[int], least: int, exponent: int) -> set[Run]:
    found = set()
    for own in (s, [-x for x in s]):
        following, match = edges(own)
        back = before(own, following)
        for i, j in enumerate(following):
            p = j - i
            if back[i] < p and match[i] + back[i] >= p and p + match[i] + back[i] >= max(least, exponent * p):
                found.add(Run(i - back[i], p + match[i] + back[i], p))
    return found


def ranks(words: list) -> np.ndarray:
    """The words' places in sorted order; equal ones have the same."""
    out, last, rank = np.zeros(len(words), np.int64), None, -1
    for i in sorted(range(len(words)), key=words.__getitem__):
        if words[i] != last:
            last, rank = words[i], rank + 1
        out[i] = rank
    return out


def runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All stretches with a smallest period p and at least max(least, exponent * p) words (exponent: 2 or more) that can't be
    extended, by start and then period.

    A word of a run stands in it `exponent` times at least, so rarer ones can't, and part the words into stretches that are
    searched one by one; twice, as fewer words are frequent within a stretch. Nothing is lost by that.
    """
    r = ranks(words)
    at = np.arange(len(r))
    for _ in range(2):
        if not len(at):
            return []
        part = np.cumsum(np.diff(at, prepend=at[0]) != 1)
        _, which, times = np.unique(part * (len(r) + 1) + r[at], return_inverse=True, return_counts=True)
        at = at[times[which] >= exponent]
    found: set[Run] = set()
    for stretch in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []:
        if len(stretch) >= max(least, exponent):
            found |= {Run(int(stretch[0]) + a, n, p) for a, n, p in _runs(r[stretch].tolist(), least, exponent)}
    return sorted(found, key=lambda x: (x.start, x.period))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest length / period; of equals the first."""
    best = None
    for x in found:
        if best is None or x.length * best.period > best.length * x.period:
            best = x
    return best


def collapsed(words: list, found: list[Run]) -> list:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for x in found:
        gone[x.start + x.period] += 1
        gone[x.start + x.length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g]


def looped(words: list, doc_id: int | None) -> list:
    """The words, for a tenth of all ids with a tail that goes round: test input with known runs."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, loops: bool = False, text: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256 of every row
    of docs; with text=True also `collapsed`, the text without its repetitions; with loops=True of the words as `looped` gives them.

    Null, empty and blank texts have no words and no runs: four nulls and digests of nothing. Repeated rows are each searched; runs of
    equal exponent: the first start, then the least period; an empty table gives an empty one; other columns are not looked at. One
    pass over whole texts, nothing shuffled; memory grows with the longest text's words.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + (", collapsed string" if text else "")

    def row(doc_id, t: str | None) -> tuple:
        words = _WORD.findall(t or "")
        if loops:
            words = looped(words, doc_id)
        found = runs(words)
        best = strongest(found)
        kept = " ".join(collapsed(words, found) if found else words)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        own = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
        return (doc_id, len(found), *own, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)), *([kept] if text else []))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            rows = [row(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            types = [pa.int64()] * 6 + [pa.string()] * (3 if text else 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
