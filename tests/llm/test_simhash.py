import random
from collections import defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest
import xxhash

from radonframe.llm import components, simhash


def brute_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]).encode(), 42) for k in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, bits=4):
    """Least id reachable, by every pair of distinct fingerprints."""
    distinct = np.array(sorted({f for _, f in fps}), np.uint64)
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct ^ distinct[i]) <= bits):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    at, least = {int(f): k for k, f in enumerate(distinct)}, {}
    for d, f in fps:
        r = root(at[f])
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return {(d, f): least.get(root(at[f])) for d, f in fps}


def test_equals_brute_force(documents, odd):
    for docs in (documents, odd):
        fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
        want = sorted((str(d), f"{f:016x}", str(brute_components(fps)[d, f])) for d, f in fps)
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect()) == want


def test_shared_and_null_ids(spark, monkeypatch):
    far, near = 0x0F0F_3333_5555_00FF, (1 << 63) | 0x1234
    fps = {"A": far, "A+": far ^ 1, "B": near, "B+": near ^ 6, "C": near ^ 6 ^ 0xF0, "chain": near ^ 6 ^ 0xF00, "lone": 0x7777_1111_2222_4444}
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    rows = [(1, "A"), (5, "A+"), (5, "B"), (9, "B+"), (None, "C"), (20, "chain"), (None, "lone")]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: spark.createDataFrame([(d, signed[k]) for d, k in rows], "doc_id long, fp long"))
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(None).collect()}
    want = brute_components([(d, fps[k]) for d, k in rows])
    assert got == {(d, f"{f:016x}"): c for (d, f), c in want.items()}
    assert [got[d, f"{fps[k]:016x}"] for d, k in rows] == [1, 1, 5, 5, 5, 20, None] or got[20, f"{fps['chain']:016x}"] == 5


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.without_near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_no_link_is_lost_in_blocks(spark, block):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(rng.choice((0, 1, 3, 30))):
            x = b
            for k in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << k
            fps.add(x)
    rows = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(sorted(fps))]
    entries = spark.createDataFrame(rows, "node long, fp long").select("node", F.array("fp").alias("seek"), F.array("fp").alias("check"))
    found = {r["node"]: r["component"] for r in components.components(simhash.links(entries, 4, block)).collect()}
    want = brute_components([(k, f) for k, f in enumerate(sorted(fps))])
    assert all(found.get(k, k) == c for (k, _), c in want.items())


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 7), (3, 900), (900, 2)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {2: 2, 3: 2, 900: 2}


def test_stage_drops_near_copies_and_keeps_the_rest(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, groups = [], defaultdict(list)
    for g in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((60, 200, 800)))]
        for _ in range(rng.choice((1, 1, 2, 4))):
            copy = list(words)
            for k in rng.sample(range(len(copy)), len(copy) // 100):
                copy[k] = rng.choice(vocabulary)
            groups[g].append(len(rows))
            rows.append((len(rows), " ".join(copy)))
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(g[0] in kept for g in groups.values())  # the least id of a group stays
    left = sum(len(kept & set(g[1:])) for g in groups.values())
    assert left <= 0.05 * sum(len(g) - 1 for g in groups.values())


def test_stage_keeps_all_columns(odd):
    got = simhash.without_near_duplicates(odd)
    assert got.columns == odd.columns
    assert got.filter("doc_id is null").count() == 1 and got.filter("doc_id = 10").count() == 0
