"""Line integrals, SPECT projection and scalar physics against closed forms and NumPy."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from radonframe.functions import physics
from radonframe.operators import algebra, grid, rays, spect

GRID = rays.Grid((8, 7, 5), (2.0, 3.0, 4.0))


def some_rays(spark, n=40, seed=3):
    rng = np.random.default_rng(seed)
    ends = rng.normal(size=(n, 6)) * 30
    return spark.createDataFrame(pd.DataFrame(ends, columns=rays.ENDS).assign(i=range(n)))


def some_image(spark, seed=4):
    n = math.prod(GRID.shape)
    return spark.createDataFrame(pd.DataFrame({"j": range(n), "value": np.random.default_rng(seed).random(n)}))


def test_axis_parallel_rays_are_sums_over_voxels():
    # through the voxel centres (x, 2, 3) for all x: every weight is the spacing of x
    y, z = (2 - 3) * 3.0, (3 - 2) * 4.0
    ray, voxel, w = rays.joseph(np.array([[-100.0, y, z, 100.0, y, z]]), GRID)
    assert np.allclose(w, 2.0) and sorted(voxel) == [(x * 7 + 2) * 5 + 3 for x in range(8)]


def test_project_equals_the_stored_matrix_and_its_transpose(spark):
    r, image = some_rays(spark), some_image(spark)
    h = rays.weights(r, GRID)
    a = {x["i"]: x["value"] for x in rays.project(r, image, GRID).collect()}
    b = {x["i"]: x["value"] for x in algebra.forward(h, image).collect()}
    assert all(math.isclose(a[i], b.get(i, 0.0), abs_tol=1e-9) for i in a)
    back = rays.back_project(r.withColumn("value", F.lit(1.0)), GRID)
    both = image.withColumnRenamed("value", "f").join(back, "j").agg(F.sum(F.col("f") * F.col("value"))).first()[0]
    assert math.isclose(both, sum(a.values()), rel_tol=1e-9)  # <Hf, 1> = <f, H'1>


def test_time_bins_share_a_ray(spark):
    r, image = some_rays(spark, 10), some_image(spark)
    whole = {x["i"]: x["value"] for x in rays.project(r, image, GRID).collect()}
    bins = r.withColumn("offset", F.explode(F.array(*[F.lit(float(k * 10)) for k in range(-30, 31)])))
    parts = rays.project_tof(bins, image, GRID, 10.0, 8.0).groupBy("i").agg(F.sum("value").alias("value")).collect()
    assert all(math.isclose(p["value"], whole[p["i"]], rel_tol=1e-6, abs_tol=1e-9) for p in parts)


def test_spect_forward_and_backward(spark):
    n = 6
    turns = spect.stencil(spark, [0.0, 90.0, 30.0], n)
    v = np.random.default_rng(5).random((n, n, 2))
    image = spark.createDataFrame([(x, y, z, float(v[x, y, z])) for x in range(n) for y in range(n) for z in range(2)], "x int, y int, z int, value double")
    got = {(r["a"], r["r"], r["z"]): r["value"] for r in spect.forward(image, turns).collect()}
    assert all(math.isclose(got[0, r, z], v[:, r, z].sum(), rel_tol=1e-9) for r in range(n) for z in range(2))
    p = spark.createDataFrame([(a, r, z, float(a + r * z)) for a in range(3) for r in range(n) for z in range(2)], "a int, r int, z int, value double")
    back = {(r["x"], r["y"], r["z"]): r["value"] for r in spect.backward(p, turns, n).collect()}
    assert math.isclose(sum(got[k] * (k[0] + k[1] * k[2]) for k in got), sum(v[k] * x for k, x in back.items()), rel_tol=1e-9)


def test_feldkamp_recovers_a_ball(spark):
    g = rays.Grid((24, 24, 24), (2.0, 2.0, 2.0))
    place = np.stack(np.unravel_index(np.arange(24**3), g.shape), axis=1)
    ball = (np.linalg.norm((place - 11.5) * 2.0, axis=1) < 12).astype(float)
    angles, shape = 60, (48, 48)
    r = rays.cone_beam_rays(spark, angles, shape, 2.0, 300.0, 100.0)
    image = spark.createDataFrame(pd.DataFrame({"j": range(24**3), "value": ball}))
    p = rays.project(r, image, g).select(F.floor(F.col("i") / 2304).cast("int").alias("view"), F.pmod(F.floor(F.col("i") / 48), F.lit(48)).cast("int").alias("col"), F.pmod("i", F.lit(48)).cast("int").alias("row"), "value")
    out = rays.fdk(p, g, angles, shape, 2.0, 300.0, 100.0).toPandas().sort_values("j")["value"].to_numpy()
    inner = np.linalg.norm((place - 11.5) * 2.0, axis=1) < 8
    outer = np.linalg.norm((place - 11.5) * 2.0, axis=1) > 18
    assert abs(out[inner].mean() - 1) < 0.1 and abs(out[outer].mean()) < 0.1


def test_erf_and_digitize(spark):
    x = [-7.0, -1.5, -0.1, 0.0, 0.3, 2.0, 5.5]
    rows = spark.createDataFrame([(v,) for v in x], "v double").select("v", physics.erf(F.col("v")).alias("e")).collect()
    assert all(math.isclose(r["e"], math.erf(r["v"]), abs_tol=1e-12) for r in rows)
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in (-0.5, 0.0, 0.99, 3.0, 4.0)], "v double").select(physics.digitize(F.col("v"), 0, 4, 4)).collect()]
    assert bins == [-1, 0, 0, 3, 4]


def test_convolution_equals_numpy(spark):
    v = np.random.default_rng(6).random(9)
    df = spark.createDataFrame([(0, x, 0, 0, float(v[x])) for x in range(9)], "k int, x int, y int, z int, value double")
    kernel = grid.gaussian_kernel(1.2, 2)
    got = [r["value"] for r in grid.convolve(df, ["k"], "x", kernel).orderBy("x").collect()]
    assert np.allclose(got, np.convolve(v, kernel, "same"))


def test_neighbourhood_over_slabs(spark):
    v = np.random.default_rng(9).random((2, 37, 3, 4))
    df = spark.createDataFrame([(*map(int, k), float(x)) for k, x in np.ndenumerate(v)], "k int, x int, y int, z int, value double")
    padded = np.pad(v, ((0, 0), (1, 1), (1, 1), (1, 1)), mode="edge")
    rows = grid.neighbourhood(df, ["k"]).collect()
    assert len(rows) == v.size and all(np.allclose(r["near"], padded[r["k"], r["x"] : r["x"] + 3, r["y"] : r["y"] + 3, r["z"] : r["z"] + 3].ravel()) for r in rows)


def test_feldkamp_in_slabs(spark, monkeypatch):
    g = rays.Grid((6, 6, 5), (2.0, 2.0, 2.0))
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(v, c, r, float(rng.random())) for v in range(5) for c in range(8) for r in range(8)], "view int, col int, row int, value double")
    whole = {r["j"]: r["value"] for r in rays.fdk(p, g, 5, (8, 8), 2.0, 300.0, 100.0).collect()}
    monkeypatch.setattr(rays, "MAX_VOXELS", 70)
    parts = {r["j"]: r["value"] for r in rays.fdk(p, g, 5, (8, 8), 2.0, 300.0, 100.0).collect()}
    assert len(whole) == 180 and whole.keys() == parts.keys() and all(math.isclose(x, parts[j], rel_tol=1e-9, abs_tol=1e-12) for j, x in whole.items())
