import pytest

ODD = [
    # doc_id, text, source
    (1, None, None), (2, "", "a"), (3, " \t\n\x0b", "a"), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (None, "no id here at all", "a"), (None, None, "c"),
    (6, "Ünïcode ÀÉ \x1c \x85 \u3000 \u200b text don't <|endoftext|> x\U0001f600y", "b"), (7, "word " * 60_000, "a"), (8, "x" * 300_000, "c"),
    (9, "the quick brown fox jumps over the lazy dog and runs far away today", "a"), (10, "The QUICK brown fox jumps over the lazy dog and runs far away today", "a"), (-3, "minus id", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with names that operators use."""
    names = ("_key", "_row", "_doc", "n", "copies", "place", "target", "rate", "fp", "node", "seek", "word", "shard", "at", "block", "keep", "score", "lang", "n_chars")
    rows = [(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
