import hashlib
import re
import time
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from radonframe.llm import decontaminate
from radonframe.llm.queries import op7_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = brute_words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i) if i is not None else "null")
    sizes = {len(w) for w in windows}
    for d, t in docs:
        own, hit, names = brute_words(t), set(), set()
        for n in sizes:
            for k in range(len(own) - n + 1):
                if found := windows.get(tuple(own[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        yield str(d), len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def rows(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()]))
    assert rows(op7_decontamination(spark, sf_dir)) == want and any(w[-1] for w in want)


ITEMS = [(1, "quick brown fox jumps over the lazy dog and runs"), (2, "ONE"), (3, None), (4, "?!"), (5, "word " * 12), (5, "word " * 12), (None, "minus id"), (6, "a b c d e f g h i j k"), (7, "one"), (8, "absent words")]


@pytest.mark.parametrize("block_bytes", [20, 8 << 20])
def test_odd_rows(spark, odd, none, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate.find_windows, "__defaults__", (10, block_bytes))
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")
    assert rows(decontaminate.contamination(odd, items)) == sorted(brute([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS))
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r[-1] for r in rows(decontaminate.contamination(odd, items.limit(0))))
    left = decontaminate.without_contaminated(odd, items)
    hit = [b[-1] for b in brute([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS)]
    assert left.columns == odd.columns and left.count() == len(hit) - sum(hit)


def test_shards_and_phrases_over_document_ends(spark):
    docs = spark.createDataFrame([(k, "a b c d e" if k % 2 else "f g h i j k") for k in range(40)], "doc_id long, text string")
    index = decontaminate.build_index(docs, shard_words=13)
    assert index.count() > 5
    assert not any(r["spans"] for r in decontaminate.find_windows(index, spark.createDataFrame([(1, "c d e f g")], "item_id long, text string")).collect())
    assert sum(r["spans"] == [1, 4] for r in decontaminate.find_windows(index, spark.createDataFrame([(1, "b c d")], "item_id long, text string")).collect()) == 20


def test_proximity():
    import numpy as np

    phrases = decontaminate.Phrases([(b"x", b"y", b"z")])
    lists = {0: np.array([5, 90]), 1: np.array([3, 50]), 2: np.array([7, 91])}
    assert list(decontaminate.near_matches(lists, phrases, 2)) == [(0, 3, 7)]
    assert list(decontaminate.near_matches(lists, phrases, 1)) == []


def test_many_windows():
    rng = np.random.default_rng(5)
    w = [b"%d" % k for k in rng.integers(0, 50_000, 200_009)]
    every = [tuple(w[k : k + 10]) for k in range(200_000)] + [(b"one",), (b"two", b"words")]
    began = time.time()
    p = decontaminate.Phrases(every)
    assert time.time() - began < 10
    names = list(p.vocabulary)
    for k in (0, 7, 199_999, 200_000, 200_001):
        assert tuple(names[x] for x in p[k]) == every[k] and {names[x] for x in p.padded[k]} == set(every[k])
    assert decontaminate.Phrases([]).padded.shape[0] == 0


def test_a_shard_is_a_row_group_and_search_reads_one_at_a_time(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c d e") for k in range(100)], "doc_id long, text string").coalesce(1)
    index = decontaminate.build_index(docs, shard_words=13)
    files = [pq.ParquetFile(urlparse(f).path).metadata for f in index.inputFiles()]
    assert sum(m.num_row_groups for m in files) > 20 and all(m.row_group(k).num_rows == 1 for m in files for k in range(m.num_row_groups))
    hits = decontaminate.find_windows(index, spark.createDataFrame([(1, "b c d"), (2, "a7")], "item_id long, text string"))
    assert "postings" not in hits._jdf.queryExecution().executedPlan().toString()  # shards do not pass through the JVM
    assert sorted((r["doc_id"], r["spans"], r["items"]) for r in hits.collect()) == [(k, [0, 4] if k == 7 else [1, 4], ["1", "2"] if k == 7 else ["1"]) for k in range(100)]


def test_texts_are_not_shuffled_to_drop_the_contaminated(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the hits are many
    try:
        left = decontaminate.without_contaminated(odd, items)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    hit = [b[-1] for b in brute([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS)]
    assert 0 < sum(hit) < len(hit) and left.count() == len(hit) - sum(hit)
