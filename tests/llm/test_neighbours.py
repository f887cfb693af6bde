import numpy as np
import pytest
from pyspark.sql import functions as F

from radonframe.llm import neighbours


def brute(rows, every, k):
    """(query_id, [(score, vec_id)]) of each query, all pairs in double precision."""
    good = [(v, np.array(x, float)) for v, x in rows if x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    dims = [len(x) for _, x in good]
    good = [(v, x) for v, x in good if len(x) == max(set(dims), key=lambda d: (dims.count(d), d))]
    out = []
    for i, (q, x) in enumerate(good):
        if q is not None and q % every == 0:
            near = [(-float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), v is None, v or 0) for j, (v, y) in enumerate(good) if j != i]
            out.append((q, [(-s, None if none else v) for s, none, v in sorted(near)[:k]]))
    return sorted(out, key=repr)


def found(df):
    by = {}
    for r in df.orderBy("rank").collect():
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(by[r["query_id"]])
    return by


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (50, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (9, None), (10, []), (11, [0.0, 0.0]),
            (12, [nan, 1.0]), (13, [inf, 1.0]), (14, [1.0, None]), (15, [1.0, 0.0, 0.0]), (None, [-1.0, 0.1]), (100, [1e-200, 2e-200]), (150, [1e200, -1e200]), (16, [-0.0, 1.0]), (17, [0.0, 1.0]), (200, None)]
    df = spark.createDataFrame([(v, x, "a", 1) for v, x in rows], "vec_id long, embedding array<double>, node string, rank int")
    got = found(neighbours.nearest_rows(df, 50))
    scaled = [(v, None if x is None else [c * (1e200 if v == 100 else 1e-200 if v == 150 else 1) if c is not None else None for c in x]) for v, x in rows]
    for q, want in brute(scaled, 50, 5):
        assert [round(s, 12) for s, _ in got[q]] == [round(s, 12) for s, _ in want], q
    assert [v for _, v in got[50]] == [2, 3, 4, 5, 6] and set(got) == {0, 50, 100, 150}
    assert neighbours.nearest_rows(df.limit(0), 50).count() == 0
    assert neighbours.nearest_rows(df.filter("vec_id in (9, 10, 11, 12)"), 50).count() == 0
    assert neighbours.nearest_rows(df.filter("vec_id = 50"), 50).count() == 0


def test_repeated_rows_find_each_other(spark):
    df = spark.createDataFrame([(50, [1.0, 2.0])] * 2 + [(1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest_rows(df, 50)
    assert sorted((r["rank"], r["vec_id"]) for r in got.collect()) == [(1, 50), (1, 50), (2, 1), (2, 1)]


@pytest.fixture(scope="module")
def cloud():
    """3,000 vectors in 24 dimensions, a third of them close to one, 400 equal to another."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24))
    x[1000:2000] = x[0] + 0.05 * rng.standard_normal((1000, 24))
    x[2000:2400] = x[1]
    return [(int(k), [float(c) for c in v]) for k, v in zip(rng.permutation(3000), x.astype(np.float32), strict=True)]


def test_recall_in_small_blocks(spark, cloud, monkeypatch):
    df = spark.createDataFrame(cloud, "vec_id long, embedding array<float>")
    rows = df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").persist()
    index = neighbours.build(rows, 16, 6, block=64)
    queries = rows.filter("vec_id % 50 = 0").select("row", F.col("vec_id").alias("query_id"), "embedding")
    got = found(neighbours.nearest(index, queries))
    want = brute(cloud, 50, 5)
    assert index.rounds > 1 and set(got) == {q for q, _ in want}
    # a neighbour that is as near as the fifth counts
    hits = sum(s >= near[-1][0] - 1e-12 for q, near in want for s, _ in got[q])
    assert hits >= 0.95 * 5 * len(want)
    # queries that are in no row of the index
    rng = np.random.default_rng(4)
    own = [(k, rng.standard_normal(24).tolist()) for k in range(20)]
    got = found(neighbours.nearest(index, spark.createDataFrame([(k, None, v) for k, v in own], "query_id long, row long, embedding array<double>")))
    hits = 0
    for k, v in own:
        near = sorted((-(np.array(v) @ np.array(x)) / np.linalg.norm(v) / np.linalg.norm(x), i) for i, x in cloud)[:5]
        hits += len({i for _, i in near} & {i for _, i in got[k]})
    assert hits >= 0.9 * 100
    index.remove()


def test_block_sizes_do_not_lose_nodes(spark, cloud):
    df = spark.createDataFrame(cloud[:700], "row long, embedding array<float>").withColumn("vec_id", F.col("row"))
    index = neighbours.build(df, 4, 6, block=50, rounds=1)
    assert index.graph.select("a").distinct().count() == index.vectors.count() == 700
    assert index.graph.groupBy("a").count().filter("count <> 4").count() == 0
    index.remove()
