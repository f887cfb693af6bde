"""Results of Spark and DuckDB, row by row."""

import duckdb
import numpy as np

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def oracle(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    columns = sorted(got.columns)
    keys = [c for c in columns if got[c].dtype.kind != "f"] + [c for c in columns if got[c].dtype.kind == "f"]
    as_text = lambda s: s.astype(str) if s.dtype.kind not in "fiu" else s
    got, want = (x[columns].sort_values(keys, key=as_text).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if got[c].dtype.kind == "f":
            a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
            assert (np.isnan(a) == np.isnan(b)).all(), c
            assert np.allclose(a, b, rtol=1e-6, atol=1e-6, equal_nan=True), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
