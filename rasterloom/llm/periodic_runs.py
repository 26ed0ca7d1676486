"""Runs of periodic words, found by Main and Lorentz's divide and conquer.

A text's words are interned as numbers. A stretch is cut in its middle, and the repetitions that cross the cut are found
for all periods at once from four Z-functions (of both halves, forwards and backwards); then the two halves follow.
Repetitions are extended as far as their period goes. Those with equal ends are one run, with the smallest period; a
repetition inside a run whose period divides its own is that run and is not extended again.

A run of ``shortest`` words or more, with a period of at most half its length, holds half of ``shortest`` words in a row
that come again inside it. So stretches without words that come again so are left without being cut further, which takes
no run away.

Documents are spread by Spark; one task holds a few hundred texts. Time is in proportion to n log n for a text of n words.

Edge cases: a null or empty text has no words, no runs and an empty rest. Repeated rows, null ids and extra columns
pass through; columns with the results' names are replaced. An empty table has an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .staging import bounded_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORTEST = 12
_RUNS = ArrayType(StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")]), False)


def z_function(s: list[int]) -> np.ndarray:
    """z[i]: how many of the first values the values from i on agree with; z[0] is the length."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = max(right - i, 0)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    if n:
        z[0] = n
    return np.array(z, np.int64)


def _crossing(ids: list[int], lo: int, mid: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, last + 1) of repetitions in lo..hi that cross mid, by period: for each period p at most one around
    mid - p and one around mid. Stretches are those seen from the cut: they may go on."""
    u, v = ids[lo:mid], ids[mid:hi]
    nu, nv = len(u), len(v)
    back = u[::-1]
    z_back, z_forth = z_function(back), z_function(v)
    z_over = z_function([*v, -1, *u])  # how far u's suffixes agree with v
    z_under = z_function([*back, -1, *v[::-1]])  # how far v's prefixes, read back, agree with u read back
    # Words around mid - p and p later agree: back from there, and on from there.
    p = np.arange(1, nu + 1)
    k1 = np.append(z_back[1:], 0)
    k2 = z_over[nv + 1 + nu - p]
    fits = k1 + k2 >= p
    left = p[fits], mid - p[fits] - k1[fits], mid + k2[fits]
    # Words around mid and p later agree.
    p = np.arange(1, nv + 1)
    k1 = z_under[nu + 1 + nv - p]
    k2 = np.append(z_forth[1:], 0)
    fits = k1 + k2 >= p
    right = p[fits], mid - k1[fits], mid + p[fits] + k2[fits]
    period, first, end = (np.concatenate(x) for x in zip(left, right, strict=True))
    order = np.argsort(period, kind="stable")
    return period[order], first[order], end[order]


def _extended(w: np.ndarray, first: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch with the period around first..end, which has it."""
    step = 16
    while end < len(w):
        same = w[end : end + step] == w[end - period : min(len(w), end + step) - period]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + len(same), 2 * step
    step = 16
    while first:
        lo = max(0, first - step)
        same = (w[lo:first] == w[lo + period : first + period])[::-1]
        if not same.all():
            first -= int(same.argmin())
            break
        first, step = lo, 2 * step
    return first, end


def _next_seen(w: np.ndarray, words: int) -> np.ndarray:
    """For each place the first place from which ``words`` words that occur there or later come again: from which on
    nothing is repeated it is past the end. A hash that two word sequences share only makes it smaller."""
    n = len(w) - words + 1
    code = np.zeros(n, np.uint64)
    for k in range(words):
        code = code * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(code, kind="stable")
    again = code[order[1:]] == code[order[:-1]]
    if not again.any():
        return np.empty(0, np.int64)
    seen = np.full(n, 2 * len(w), np.int64)
    seen[order[:-1][again]] = order[1:][again]
    return np.minimum.accumulate(seen[::-1])[::-1]


def runs(ids: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``shortest`` values at least, by start, then period."""
    w = np.array(ids, np.int64)
    half = max(1, shortest // 2)
    if len(w) < max(2, shortest):
        return []
    seen = _next_seen(w, half)
    found: dict[tuple[int, int], int] = {}
    stretches = [(0, len(w))] if len(seen) else []
    while stretches:
        lo, hi = stretches.pop()
        if hi - lo < max(2, shortest) or seen[lo] + half > hi:
            continue
        mid = (lo + hi) // 2
        period, first, end = _crossing(ids, lo, mid, hi)
        halves = {(lo, mid), (mid, hi)}
        while len(period):
            p = int(period[0])
            s, e = _extended(w, int(first[0]), int(end[0]), p)
            found[s, e] = min(p, found.get((s, e), p))
            if 2 * p <= shortest:  # any run inside this one would have its period
                halves -= {(a, b) for a, b in halves if s <= a and b <= e}
            other = (period % p != 0) | (first < s) | (end > e)
            other[0] = False
            period, first, end = period[other], first[other], end[other]
        stretches += halves
    return sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(shortest, 2 * p))


def interned(words: list[str]) -> list[int]:
    numbers: dict[str, int] = {}
    return [numbers.setdefault(word, len(numbers)) for word in words]


def _judged(text: str | None, shortest: int) -> tuple[int, list[dict[str, int]], str]:
    words = WORD.findall(text or "")
    found = runs(interned(words), shortest)
    if not found:
        return len(words), [], " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return len(words), [{"start": s, "length": n, "period": p} for s, n, p in found], " ".join([words[i] for i in kept.tolist()])


def with_runs(df: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """df with ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``collapsed``, the words
    joined by a space without those that repeat a run's first period."""
    bounded_batches(df.sparkSession)
    made = StructType([StructField("n_words", LongType()), StructField("runs", _RUNS), StructField("collapsed", StringType())])
    kept = [c for c in df.columns if c not in made.names]
    rows = df.select(*kept, F.col(text).alias("__text"))
    types = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                results = zip(*(_judged(t, shortest) for t in part.column("__text").to_pylist()), strict=True)
                new = [pa.array(x, kind) for x, kind in zip(results, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=[*kept, *made.names])

    return rows.mapInArrow(judge, StructType([*(df.schema[c] for c in kept), *made.fields]))
