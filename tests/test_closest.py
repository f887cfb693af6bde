import duckdb
import numpy as np
import pyarrow as pa
import pytest

from radonframe.operators import counts
from radonframe.operators.closest import closest
from radonframe.plans.queries import ORACLE_SQL, QUERIES

SQL = """SELECT n, t FROM (SELECT n, t, row_number() OVER (PARTITION BY n ORDER BY abs(x - f), abs(y - s), t) AS k FROM l, r) WHERE k = 1 ORDER BY n"""
PLAIN = [0.0, 0.1, 0.2, 0.3, -0.1, 0.7, 1.1, 100.1, 90.05, 110.15]
ODD = [*PLAIN, 1e17, 1e17 + 16, -1e17, float("inf"), -float("inf"), float("nan"), None]


@pytest.mark.parametrize("pool", [PLAIN, ODD, ODD[-4:], [float("nan"), None], [None], [5.0]])
@pytest.mark.parametrize("second", ["int", "float", "null"])
def test_closest_equals_all_pairs(pool, second):
    rng = np.random.default_rng(len(pool))
    for n in (1, 2, 40):
        pick = lambda m, of: [of[k] for k in rng.integers(0, len(of), m)]
        seconds, kind = {"int": (list(range(-8, 8)), pa.int64()), "float": (PLAIN + [1e17, None], pa.float64()), "null": ([None, 3, 4], pa.int64())}[second]
        l = pa.table({"n": range(60), "x": pa.array(pick(60, ODD), pa.float64()), "y": pa.array(pick(60, seconds), kind)})  # noqa: E741, F841
        r = pa.table({"f": pa.array(pick(n, pool), pa.float64()), "s": pa.array(pick(n, seconds), kind), "t": pa.array(rng.permutation(n))})
        want = [t for _, t in duckdb.sql(SQL).fetchall()]
        assert r["t"].take(pa.array(closest(l, r, ("x", "f"), ("y", "s"), "t"))).to_pylist() == want


def test_nearest_config_of_odd_rows_lists_no_pairs(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT k AS c_custkey, CASE WHEN k % 50 > 0 THEN k % 7 END AS c_nationkey, CASE WHEN k % 9 > 0 THEN CAST(k * 7919 % 2000 / 100 AS DOUBLE) END AS c_acctbal FROM range(1, 3000) t(k)")
    con.execute("INSERT INTO customer SELECT CASE WHEN c_custkey > 20 THEN c_custkey END, c_nationkey + 1, c_acctbal + 3 FROM customer WHERE c_custkey < 200")
    con.execute("CREATE TABLE supplier AS SELECT k AS s_suppkey, CASE WHEN k % 50 > 0 THEN k % 6 END AS s_nationkey, CASE WHEN k % 5 > 0 THEN CAST(k * 104729 % 1000 / 50 AS DOUBLE) END AS s_acctbal FROM range(1, 400) t(k)")
    for t in ("customer", "supplier"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = QUERIES["nearest_config"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(ORACLE_SQL["nearest_config"]).fetchall(), key=str)
    assert "SortMergeJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "CoGroup" in plan
    left, right = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("customer", "supplier"))
    columns = ("c_acctbal", "s_acctbal"), ("c_custkey", "s_suppkey"), "s_suppkey"
    same = lambda block: sorted(map(tuple, counts.nearest(left.withColumnRenamed("c_nationkey", "k"), right.withColumnRenamed("s_nationkey", "k"), ["k"], *columns, block=block).select("c_custkey", "s_suppkey").collect()), key=str)
    assert same(100) == same(1 << 20)  # a key's rows in several tasks


def test_decimals_are_refused(spark):
    df = spark.sql("SELECT 1 AS k, CAST(1 AS DECIMAL(5, 2)) AS v")
    with pytest.raises(TypeError):
        counts.nearest(df, df.toDF("k", "w"), ["k"], ("v", "w"), ("k", "k"), "w")
