import random
from collections import Counter

import pytest
from test_decontaminate import brute_words

from radonframe.llm import decontaminate


def brute(docs, items, width, slop):
    """Each document's words in the minimal stretches, by every stretch."""
    windows = [(Counter(w[k : k + width]), str(i)) for i, t in items for w in [brute_words(t)] for k in (range(max(1, len(w) - width + 1)) if w else ())]
    for d, text in docs:
        own, hit, names = brute_words(text), set(), set()
        for need, name in windows:
            has = lambda a, b: not need - Counter(own[a:b])  # noqa: B023, E731
            for a in range(len(own)):
                for b in range(a + 1, min(len(own), a + need.total() + slop) + 1):
                    if has(a, b) and not has(a + 1, b) and not has(a, b - 1):
                        hit |= set(range(a, b))
                        names.add(name)
        yield d, len(own), sorted(hit), sorted(names)


def rows(df):
    return sorted((r["doc_id"], r["n_words"], sorted(x for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True) for x in range(a, b)), r["items"]) for r in df.collect())


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_equals_brute_force(spark, slop):
    rng = random.Random(slop)
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.choice((0, 1, 6, 25))))) for k in range(60)]
    items = [(1, "a b a c d"), (2, "f f f"), (3, "e a"), (4, "b c d e f a b"), (5, "absent a"), (6, "")]
    got = decontaminate.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5, slop)
    want = sorted(brute(docs, items, 5, slop))
    assert rows(got) == want and any(w[3] for w in want)


def test_one_inserted_or_reordered_word_in_ten(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [item, item.replace("five", "five extra"), item.replace("two three", "three two"), item.replace("ten", "nine"), "one two three four five", "six seven eight nine ten"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [bool(x[3]) for x in rows(decontaminate.proximity(docs, items))] == [True, True, True, False, False, False]
    assert [x["contaminated"] for x in sorted(decontaminate.contamination(docs, items).collect())] == [True] + [False] * 5
