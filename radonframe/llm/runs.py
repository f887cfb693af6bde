"""Runs (maximal repetitions) of words by Main-Lorentz divide and conquer.

1. Words between ASCII white space are interned; the documents of a slice are one array of ids, cut in halves level by level, all segments of
   a level at once.
2. At a midpoint, a run that crosses it has half of its words or more on one side. With an exponent of 4 or more this half starts at the
   midpoint with a square of the period q, so the Z-function of that half (read backwards on the left) is q or more at q. All q are probed by
   a few words at once; those left are taken in ascending order and compared with the half's start. A period q with value z settles every later
   q' whose square ends within q + z: it is a multiple of q. Once comparisons add up to ``SLOW`` times the half, its Z-function is
   computed in full by the linear algorithm, so that no text costs more than n log n.
3. Each candidate is extended both ways to the ends of its document. Equal intervals are one run of their smallest period; runs that are
   known already are recognised by period and place, and not extended again.

Defined cases: null and empty texts have no words and no runs; repeated rows are rows of their own; texts of any length are taken whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, EXPONENT = 6, 4
PROBES = 8
SLOW = 32
SLICE_WORDS = 1 << 18
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def z_function(w: list[int]) -> list[int]:
    """At each k above 0, how many words from k on equal those from 0 on."""
    n, z, left, right = len(w), [0] * len(w), 0, 0
    for k in range(1, n):
        x = min(right - k, z[k - left]) if k < right else 0
        while k + x < n and w[x] == w[k + x]:
            x += 1
        z[k] = x
        if k + x > right:
            left, right = k, k + x
    return z


def _equal(w: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from a on equal those from b on, in the direction of ``step``; ``most`` at most."""
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differ = w[a + done : a + done + n] != w[b + done : b + done + n]
        else:
            differ = (w[a - done - n + 1 : a - done + 1] != w[b - done - n + 1 : b - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + n, size * 4
    return most


class _Found:
    """The runs of one document: by period, intervals in order."""

    def __init__(self) -> None:
        self.by_period: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def covering(self, period: int, start: int, end: int) -> tuple[int, int] | None:
        """The known run of this period that holds the interval."""
        own = self.by_period.get(period)
        if own:
            k = bisect_right(own, (start, 1 << 62)) - 1
            if k >= 0 and own[k][1] >= end:
                return own[k]
        return None

    def add(self, period: int, start: int, end: int) -> None:
        own = self.by_period[period]
        own.insert(bisect_right(own, (start, end)), (start, end))


def _probed(w: np.ndarray, at: np.ndarray, room: np.ndarray, step: int, half: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, period) whose first words, up to ``PROBES``, agree with a square at the start of the half of ``room`` words from ``at`` on."""
    top = room // factor
    seg = np.repeat(np.arange(len(at)), top)
    q = np.arange(1, len(seg) + 1) - np.repeat(np.cumsum(top) - top, top)
    keep = (w[at[seg] + step * q] == w[at[seg]]) & (np.maximum(half, factor * q) <= room[seg])
    seg, q = seg[keep], q[keep]
    for k in range(1, PROBES):
        if not len(seg):
            break
        last = room[seg] - 1  # beyond it nothing is asked for
        keep = (np.maximum(half, factor * q) - q <= k) | (w[at[seg] + step * np.minimum(q + k, last)] == w[at[seg] + step * np.minimum(k, last)])
        seg, q = seg[keep], q[keep]
    return seg, q


def find_runs(w: np.ndarray, starts: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start and period; documents are the stretches of ``w`` that begin at ``starts`` (its size last)."""
    if exponent < 4:
        raise ValueError("the half of a run starts with a square only from exponent 4 on")
    half, factor = -(-length // 2), exponent // 2
    found = [_Found() for _ in range(len(starts) - 1)]
    doc = np.flatnonzero(np.diff(starts) >= length)
    lo, hi = starts[doc], starts[doc + 1]
    while len(lo):
        mid = (lo + hi) // 2
        for step, at, room in ((1, mid, hi - mid), (-1, mid - 1, mid - lo)):
            seg, period = _probed(w, at, room, step, half, factor)
            cuts = np.flatnonzero(np.diff(seg)) + 1
            for own in np.split(np.arange(len(seg)), cuts) if len(seg) else ():
                s = int(seg[own[0]])
                d = int(doc[s])
                _settle(w, period[own], int(at[s]), int(room[s]), step, (int(starts[d]), int(starts[d + 1])), found[d], half, factor)
        inner = np.concatenate([lo, mid]), np.concatenate([mid, hi]), np.concatenate([doc, doc])
        wide = inner[1] - inner[0] >= length
        lo, hi, doc = (x[wide] for x in inner)
    out = []
    for f, first in zip(found, starts[:-1].tolist(), strict=True):
        smallest: dict[tuple[int, int], int] = {}
        for p in sorted(f.by_period, reverse=True):
            for a, b in f.by_period[p]:
                smallest[a, b] = p
        out.append(sorted((a - first, b - a, p) for (a, b), p in smallest.items() if b - a >= max(length, exponent * p)))
    return out


def _settle(w: np.ndarray, periods: np.ndarray, at: int, room: int, step: int, ends: tuple[int, int], found: _Found, half: int, factor: int) -> None:
    """Add the runs that start with one of the ``periods`` (ascending) at the start of one half of a segment."""
    spent, z = 0, None
    while len(periods):
        q = int(periods[0])
        need = max(half, factor * q)
        known = found.covering(q, at, at + need) if step > 0 else found.covering(q, at - need + 1, at + 1)
        if known:
            value = min(room, known[1] - at if step > 0 else at + 1 - known[0]) - q
        elif z is not None:
            value = z[q]
        else:
            value = _equal(w, at, at + step * q, room - q, step)
            spent += value
            if spent > SLOW * room:
                z = z_function((w[at : at + room] if step > 0 else w[at - room + 1 : at + 1][::-1]).tolist())
        if value + q < need:
            periods = periods[1:]
            continue
        if not known:
            first = at if step > 0 else at + 1  # the midpoint
            right = _equal(w, first, first + q, ends[1] - first - q, 1) if step > 0 else _equal(w, first - q, first, ends[1] - first, 1)
            left = _equal(w, first - 1, first - 1 + q, first - ends[0], -1) if step > 0 else _equal(w, first - 1 - q, first - 1, first - q - ends[0], -1)
            found.add(q, *((first - left, first + q + right) if step > 0 else (first - q - left, first + right)))
        periods = periods[1:][np.maximum(half, factor * periods[1:]) > q + value]


def _slice(ids: list[int | None], texts: list[list[bytes]], length: int, exponent: int) -> pa.RecordBatch:
    known: dict[bytes, int] = {}
    w = np.fromiter((known.setdefault(x, len(known)) for t in texts for x in t), np.int32)
    starts = np.cumsum([0, *map(len, texts)])
    every, collapsed = find_runs(w, starts, length, exponent), []
    for t, runs in zip(texts, every, strict=True):
        if runs:
            steps = np.zeros(len(t) + 1, np.int64)
            for a, n, p in runs:
                steps[a + p] += 1
                steps[a + n] -= 1
            collapsed.append(b" ".join([t[k] for k in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()]))
        else:
            collapsed.append(b" ".join(t))
    flat = np.array([r for runs in every for r in runs], np.int64).reshape(-1, 3)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]), pa.int32()), rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(starts), pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _run(length: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held = [], [], 0
            for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(d)
                texts.append((text.as_py() or "").encode().split())
                held += len(texts[-1])
                if held >= SLICE_WORDS:
                    yield _slice(ids, texts, length, exponent)
                    ids, texts, held = [], [], 0
            if ids:
                yield _slice(ids, texts, length, exponent)

    return run


def periodic_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per document: its runs of at least ``length`` words and ``exponent`` periods (4 or more) by start
    and period, and its words, joined by one space, without those that any run contains after its first period."""
    if exponent < 4:
        raise ValueError("the half of a run starts with a square only from exponent 4 on")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(length, exponent), RUNS)


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes] | None:
    """The words with a periodic end, for each document whose id has a CRC-32 (of its decimal digits; none for a null id) divisible by 10; else None."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _with_echoes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = echoed(d, (text or "").encode().split())
            out.append(text if words is None else b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def with_echoes(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents, about a tenth of them with a periodic end."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_with_echoes, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run with the greatest exponent, the first of ties, and digests of all."""
    better = lambda best, r: best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
