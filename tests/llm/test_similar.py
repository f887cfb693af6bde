import random
from collections import Counter

import numpy as np
import pytest

from radonframe.llm import shingle_sets, simhash
from radonframe.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def linked(a, b, t=0.8):
    return 10 * len(a & b) >= round(10 * t) * len(a | b)


def brute(rows, t=0.8):
    """Least id of each document's group, by all pairs."""
    sets, least = [shingles(x) for _, x in rows], [d for d, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j], t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {d: least[root(k)] for k, d in enumerate(least)}


def corpus():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for g in range(70):
        n = (8, 9, 12, 20, 60, 200, 700)[g % 7]
        base = [word() for _ in range(n)]
        texts.append(base)
        for share in (0.1, 0.2, 0.24, 0.25, 0.27):
            texts.append(base + [word() for _ in range(int((n - 4) * share))])  # longer at the end
            texts.append(base[int((n - 4) * share * 0.8) :])  # cut at the start
        at = rng.randrange(n)
        texts.append(base[:at] + [word()] + base[at + 1 :])
    return [(k, " ".join(x)) for k, x in enumerate(texts)]


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_groups_of_a_hot_group_equal_all_pairs(spark, monkeypatch):
    """One text with many copies, each a few words off, so that most pairs of copies are unlike: meetings of many blocks."""
    monkeypatch.setattr(simhash, "BLOCK_ELEMENTS", 400)
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(60)], []
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(60), 1 + k % 2):
            own[at] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("size", [4, 5, 9, 30, 100, 900, 9000])
def test_similar_sets_meet(size):
    rng = np.random.default_rng(size)
    for _ in range(100):
        a = rng.integers(0, 2**63, size, np.int64).astype(np.uint64)
        more = rng.integers(0, 2**63, size // 4, np.int64).astype(np.uint64)
        b = np.concatenate([a, more])
        assert shingle_sets.similar(np.sort(a), np.sort(b), 0.8)
        assert np.intersect1d(shingle_sets.places(a), shingle_sets.places(b)).size


def changed(kind, words, share, rng):
    n = max(1, round(len(words) * share))
    new = lambda k: [f"n{rng.randrange(10**6)}" for _ in range(k)]
    if kind == "appended":
        return words + new(n)
    if kind == "cut":
        return words[n:]
    if kind == "block":
        return words[:20] + new(n) + words[20 + n :]
    out = list(words)
    for at in rng.sample(range(len(words)), max(1, n // 5)):
        out[at] = new(1)[0]
    return out


@pytest.mark.parametrize("kind", ["appended", "cut", "block", "substituted"])
def test_recall_by_similarity(kind):
    """Pairs that meet, of all pairs with a similarity of 0.8 or more, and of those just above it."""
    rng, found = random.Random(kind), {0.8: [], 0.85: [], 0.9: []}
    for k in range(600):
        words = [f"v{int(rng.paretovariate(0.7)) % 3000}" for _ in range((60, 200, 800)[k % 3])]
        texts = [" ".join(words), " ".join(changed(kind, words, rng.uniform(0.02, 0.25), rng))]
        a, b = map(shingles, texts)
        if linked(a, b):
            similarity = len(a & b) / len(a | b)
            met = np.intersect1d(*(shingle_sets.places(simhash.shingle_set(x)) for x in texts)).size > 0
            found[max(t for t in found if similarity >= t)].append(met)
    for hits in found.values():
        assert len(hits) > 20 and np.mean(hits) > 0.99


def test_one_row_of_each_group_stays(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away today".split()
    near, other = " ".join([*text, "again"]), "nothing at all is like this one text here"
    text = " ".join(text)
    rows = [(2, text, "a"), (1, near, "b"), (2, text, "c"), (2, other, "d"), (None, text, "e"), (None, None, "f"), (3, "", "g"), (3, "", "h"), (None, "of its own kind entirely", "i"), (None, "of its own kind entirely", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_0 string").repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.without_near_duplicates(docs).collect())
    assert kept == {(1, near): 1, (2, other): 1, (3, ""): 1, (None, "of its own kind entirely"): 1}
    assert simhash.without_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
