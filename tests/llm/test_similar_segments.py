"""Documents of the near-duplicate stage meet by segments of SimHash bits."""

import numpy as np
import pytest

from radonframe.llm import shingle_sets, simhash, storage


def bits_of(elements):
    """The SimHash bits, one by one: those that over half of the elements' hashes have."""
    hashes = shingle_sets.widened(elements, shingle_sets.WORDS)
    return np.array([2 * sum(int(h) >> k & 1 for h in word) > len(elements) for word in hashes for k in range(64)])


def sets(rng, n, size):
    base = rng.integers(0, 2**63, size, np.int64).astype(np.uint64)
    return [np.sort(np.concatenate([base[: rng.integers(size - 12, size)], rng.integers(0, 2**63, 3, np.int64).astype(np.uint64)])) for _ in range(n)]


def test_places_are_segments_of_simhash_bits():
    for elements, tier in ((np.arange(5, dtype=np.uint64), 0), (np.arange(40, dtype=np.uint64), 1), (np.arange(90, dtype=np.uint64), 2)):
        spread, n = bits_of(elements), shingle_sets.segments(16, shingle_sets.SHARES[tier][1])
        want = {(k << 32) + sum(int(spread[at]) << x for x, at in enumerate(choice)) for k, choice in enumerate(shingle_sets.choices(16, n))}
        assert set(shingle_sets.places(elements).tolist()) == want and len(want) == n
        parts = [shingle_sets.places_of(simhash.sketch(elements)[None, :], np.array([len(elements)]), 16, k, 4)[1].tolist() for k in range(4)]
        assert sorted(sum(parts, [])) == sorted(want)


def test_met_entries_are_those_near_at_a_place(spark, monkeypatch):
    """All pairs, with places of many blocks, and copies among texts of their own."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = np.random.default_rng(4)
    # short sets share places by chance; the hot ones are near each other
    rows = [(k, x) for k, x in enumerate(sets(rng, 40, 90) + [rng.integers(0, 2**63, 8, np.int64).astype(np.uint64) for _ in range(60)])]
    entries = spark.createDataFrame([(k, len(x), bytearray(simhash.sketch(x).tobytes())) for k, x in rows], "node long, size long, sketch binary").repartition(5)
    got = {(r["place"], r["node"]) for r in simhash._met(entries, 0.8).collect()}
    limit, want = simhash.largest_distance(0.8, 128), set()
    at = [set(shingle_sets.places(x).tolist()) for _, x in rows]
    spread = [bits_of(x)[:128] for _, x in rows]
    for i, _ in rows:
        for j in range(i):
            if (spread[i] != spread[j]).sum() <= limit:
                want |= {(p, k) for p in at[i] & at[j] for k in (i, j)}
    assert got == want and len(want) > 1000


def test_meetings_of_many_pairs_are_compared_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 0)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base[: 60 - 3 * k], *(f"x{k}_{i}" for i in range(2))])) for k in range(6)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [simhash.shingle_set(x) for _, x in rows]
    links = [(i, j) for i in range(6) for j in range(i) if shingle_sets.similar(sets[i], sets[j], 0.8)]
    least = list(range(6))
    for _ in range(6):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert got == dict(enumerate(least)) and len(links) > 3


def grouped(n, pairs):
    """The least member of each one's group."""
    least = list(range(n))
    for _ in range(n):
        new = list(least)
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == least:
            return least
        least = new


@pytest.mark.parametrize("dense", [0, 8, 10**9])
def test_forest_joins_what_all_pairs_join(dense):
    rng = np.random.default_rng(11)
    rows = sets(rng, 60, 90) + sets(rng, 30, 40) + [rng.integers(0, 2**63, 8, np.int64).astype(np.uint64) for _ in range(60)] + [np.empty(0, np.uint64)]
    sizes, sketches = np.array([len(x) for x in rows]), np.array([simhash.sketch(x) for x in rows])
    edges = shingle_sets.forest(sizes, sketches, 0.8, 5, dense)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sizes[i] and shingle_sets.similar(rows[i], rows[j], 0.8)]
    got, want = grouped(len(rows), edges.tolist()), grouped(len(rows), near)
    assert all(got[i] == got[j] for i, j in near) and len(near) > 500
    assert len(edges) == len(rows) - len(set(got)) and len(set(got)) > 60 and len(set(want)) >= len(set(got))


def test_rows_of_a_hot_group_follow_its_size(spark):
    """Copies that are alike or nearly so: pairs that travel are a forest for each bucket, not all pairs."""
    rng = np.random.default_rng(6)
    for n in (40, 160):
        rows = [(k, len(x), bytearray(simhash.sketch(x).tobytes())) for k, x in enumerate(sets(rng, n, 90))]
        entries = spark.createDataFrame(rows, "node long, size long, sketch binary")
        assert n - 1 <= simhash._candidates(entries, 0.8).count() < 15 * n


def test_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "BUCKET", 8)
    monkeypatch.setattr(simhash, "TABLES", 7)
    rng = np.random.default_rng(9)
    every = sets(rng, 60, 90) + [x for _ in range(60) for x in sets(rng, 2, 90)]
    rows = [(k, len(x), bytearray(simhash.sketch(x).tobytes())) for k, x in enumerate(every)]
    found = simhash._candidates(spark.createDataFrame(rows, "node long, size long, sketch binary").repartition(3), 0.8)
    got = grouped(len(every), [(r["a"], r["b"]) for r in found.collect()])
    assert all(got[i] == got[j] for i in range(len(every)) for j in range(i) if shingle_sets.similar(every[i], every[j], 0.8))


def test_chosen_rows(spark):
    rows, name = storage.numbered(spark.range(100).repartition(7))
    ids = rows.filter("id % 3 = 0").select(name)
    assert sorted(r["id"] for r in rows.filter(storage.chosen(rows, name, ids)).collect()) == list(range(0, 100, 3))
    assert rows.filter(~storage.chosen(rows, name, ids.limit(0))).count() == 100
