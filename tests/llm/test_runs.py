import hashlib
import random
import zlib

import numpy as np
import pytest

from radonframe.llm import runs


def brute(w, length=6, exponent=4):
    """Every period, every maximal stretch; equal intervals keep the smallest period."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def made_up(rng):
    few = rng.choice((1, 2, 3, 30))
    w = [rng.randrange(few) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        period, k = [rng.randrange(few) for _ in range(rng.randint(1, 7))], rng.randint(0, len(w))
        w[k:k] = (period * 9)[: rng.randint(0, 40)]
    return w


@pytest.mark.parametrize("slow", [0.05, 32])
def test_equals_brute_force(slow, monkeypatch):
    monkeypatch.setattr(runs, "SLOW", slow)
    rng = random.Random(1)
    for _ in range(1500):
        texts = [made_up(rng) for _ in range(rng.randint(1, 6))]
        flat, starts = np.array([x for t in texts for x in t], np.int32), np.cumsum([0, *map(len, texts)])
        assert runs.find_runs(flat, starts) == [brute(t) for t in texts]
        assert runs.find_runs(flat, starts, 3, 5) == [brute(t, 3, 5) for t in texts]


@pytest.mark.parametrize(("w", "n"), [([0] * 40_000, 1), ([0, 1] * 20_000, 1), (([0] * 999 + [1]) * 40, 41), ([0] * 19_999 + [1] + [0] * 20_000, 2)])
def test_long_periodic_texts(w, n):
    got = runs.find_runs(np.array(w, np.int32), np.array([0, len(w)]))[0]
    assert len(got) == n
    for a, m, p in got:
        assert w[a : a + m - p] == w[a + p : a + m] and (a + m == len(w) or w[a + m] != w[a + m - p]) and (a == 0 or w[a - 1] != w[a - 1 + p])


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    number = {}
    found = brute([number.setdefault(x, len(number)) for x in words]) if n < 5000 else runs.find_runs(np.array([number.setdefault(x, len(number)) for x in words], np.int32), np.array([0, n]))[0]
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    kept = b" ".join(x for k, x in enumerate(words) if k not in gone)
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_documents_equal_brute_force(documents, odd, none):
    for docs in (documents, odd, none):
        got = runs.digests(runs.periodic_runs(runs.with_echoes(docs)))
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(r["doc_id"], r["text"])) for r in docs.select("doc_id", "text").collect())


def test_other_exponents(spark):
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 6, 3)
