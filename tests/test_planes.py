import numpy as np
import pytest
from pyspark.sql import functions as F

from radonframe.operators import planes, rays


@pytest.mark.parametrize("most", [1 << 23, 0])
@pytest.mark.parametrize("given", [False, True])
def test_osem_of_planes_equals_numpy(spark, monkeypatch, most, given):
    """Both ways, with bins without counts, voxels that no bin sees, and planes beyond a whole chunk."""
    monkeypatch.setattr(rays, "MAX_VOXELS", most)
    rng = np.random.default_rng(1)
    bins, voxels, depth = 21, 9, 11
    h = np.where(rng.uniform(size=(bins, voxels)) < 0.5, rng.uniform(0, 2, (bins, voxels)), 0.0)
    h[5] = 0
    g = rng.poisson(5, (bins, depth)).astype(float)
    g[7] = 0
    g[:, 9] = 0
    matrix = spark.createDataFrame([(i, 3 * j, float(h[i, j])) for i in range(bins) for j in range(voxels) if h[i, j]], "i long, j long, h double")
    data = planes.wide(spark.createDataFrame([(i, z, float(g[i, z])) for i in range(bins) for z in range(depth) if i != 7], "i long, z int, value double"), "i")
    f = rng.uniform(0, 2, (voxels, depth)) if given else np.ones((voxels, depth))
    image = planes.wide(spark.createDataFrame([(3 * j, z, float(f[j, z])) for j in range(voxels) for z in range(depth)], "j long, z int, value double"), "j") if given else None
    for _ in range(2):
        for m in range(3):
            own = np.arange(bins) // 2 % 3 == m
            norm = h[own].sum(axis=0)[:, None]
            f = np.maximum(f + f / (norm + 1e-11) * (h[own].T @ (g[own] / (h[own] @ f + 1e-11)) - norm), 0)
    got = planes.long(planes.osem(matrix, data, 2, F.pmod(F.floor(F.col("i") / 2), F.lit(3)), 3, image), "j", depth)
    out = np.zeros((voxels, depth))
    for r in got.collect():
        out[r["j"] // 3, r["z"]] = r["value"]
    assert got.count() == voxels * depth and np.allclose(out, f, rtol=1e-9, atol=1e-12)
