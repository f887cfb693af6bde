"""Affines, files of volumes, callbacks and what goes with scans, against NumPy."""

import itertools
import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radonframe.functions import physics
from radonframe.operators import callbacks, counts, events, grid, pet, rays, solvers, spect
from radonframe.plans.fixtures import SCANNER
from radonframe.sources import imaging, volumes


def table(spark, v, names="xyz"):
    return spark.createDataFrame([(*map(int, k), float(x)) for k, x in np.ndenumerate(v)], ", ".join(f"{c} int" for c in names) + ", value double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r["value"]
    return out


def interpolated(v, m, shape):
    """Trilinear samples of v at m (p, 1), zero outside."""
    out, padded = np.zeros(shape), np.pad(v, 2)
    for p in np.ndindex(*shape):
        q = (np.array(m) @ [*p, 1])[:3]
        base = np.floor(q + 1e-12).astype(int)
        for c in itertools.product((0, 1), repeat=3):
            at = base + c
            if all(-2 <= a < n + 2 for a, n in zip(at, v.shape, strict=True)):
                out[p] += np.prod([1 - abs(x - a) for x, a in zip(q, at, strict=True)]) * padded[tuple(at + 2)]
    return out


def test_alignment_of_grids(spark):
    v = np.random.default_rng(0).random((4, 5, 3))
    source, target, shape = volumes.centred((4, 5, 3), (2.0, 3.0, 4.0)), volumes.centred((5, 4, 4), (1.5, 2.5, 2.0)), (5, 4, 4)
    got = dense(volumes.aligned(table(spark, v), source, target, shape), shape)
    assert np.allclose(got, interpolated(v, volumes.between(source, target), shape))
    region = np.where(v > 0.5, 7.0, 1.0)
    mask = {tuple(r) for r in volumes.aligned_mask(table(spark, region), 7.0, source, target, shape, 0.4).collect()}
    assert mask == set(map(tuple, np.argwhere(interpolated((region == 7) * 1.0, volumes.between(source, target), shape) > 0.4).tolist()))


def test_affines(spark):
    rows = [(z, [-10.0, 20.0, z], [1.5, 2.5], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0], 30.0) for z in (5.0, -3.0, 1.0)]
    m = volumes.of_slices(spark.createDataFrame(rows, "z_pos double, position array<double>, spacing array<double>, orientation array<double>, table_height double"))
    normal = np.cross([1, 0, 0], [0, 0, -1]) * 4.0
    assert np.allclose(m, [[1.5, 0, normal[0], -10], [0, 0, normal[1], -10], [0, -2.5, normal[2], -3], [0, 0, 0, 1]])
    assert volumes.of_file((1.0, 2.0, 3.0), (4.0, 5.0, 6.0)) == [[4.0, 0.0, 0.0, 1.0], [0.0, 5.0, 0.0, 2.0], [0.0, 0.0, 6.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    at = lambda **k: [r[3] for r in volumes.of_projections(k.pop("position"), 11, 2.0, 3.0, **k)[:3]]
    assert at(position=(1.0, 0.0, 100.0), table_height=7.0) == [-9.0, -17.0, 70.0] and at(position=(1.0, 4.0, 100.0)) == [1.0, 4.0, 70.0] and at(position=(1.0, 4.0, 100.0), centred_y=True) == [1.0, -10.0, 70.0]


def nifti(v, spacing, dtype="<f4", slope=0.0, code=16):
    raw = bytearray(352)
    raw[0:4] = struct.pack("<i", 348)
    raw[40:56] = struct.pack("<8h", 3, *v.shape, 1, 1, 1, 1)
    raw[70:72] = struct.pack("<h", code)
    raw[76:108] = struct.pack("<8f", 1, *spacing, 0, 0, 0, 0)
    raw[108:120] = struct.pack("<3f", 352, slope, 0.5)
    return bytes(raw) + v.astype(dtype).tobytes(order="F")


def test_nifti(spark, tmp_path):
    v = np.random.default_rng(1).integers(0, 50, (4, 3, 2)).astype(float)
    (tmp_path / "v.nii").write_bytes(nifti(v, (2.0, 2.0, 3.0), "<i2", 2.0, 4))
    assert np.allclose(dense(volumes.read_nifti(spark, f"{tmp_path}/v.nii"), v.shape), v * 2 + 0.5)
    (tmp_path / "f.nii").write_bytes(nifti(v, (2.0, 2.0, 3.0)))
    got = dense(volumes.attenuation_of_nifti(spark, f"{tmp_path}/f.nii", (3, 3, 2), (2.5, 2.0, 3.0)), (3, 3, 2))
    m = volumes.between(volumes.centred(v.shape, (-2.0, -2.0, 3.0)), volumes.centred((3, 3, 2), (2.5, 2.0, 3.0)))
    assert np.allclose(got, interpolated(v + 0.5, m, (3, 3, 2)) / 10)
    (tmp_path / "bad.nii").write_bytes(bytes(400))
    with pytest.raises(ValueError):
        volumes.nifti_header(spark, f"{tmp_path}/bad.nii")


def test_attenuation_by_a_text_header(spark, tmp_path):
    v = np.random.default_rng(2).random((2, 3, 4)).astype("<f4")  # z, y, x
    (tmp_path / "m.i33").write_bytes(v.tobytes())
    (tmp_path / "m.h33").write_text("".join(f"!matrix size [{k}] := {n}\nscaling factor (mm/pixel) [{k}] := {d}\n" for k, n, d in ((1, 4, 2.0), (2, 3, 2.5), (3, 2, 3.0))))
    got = dense(volumes.attenuation_of_interfile(spark, f"{tmp_path}/m.h33", f"{tmp_path}/m.i33", (4, 4, 3), (1.5, 2.0, 2.0)), (4, 4, 3))
    m = volumes.between(volumes.centred((4, 3, 2), (2.0, 2.5, 3.0)), volumes.centred((4, 4, 3), (1.5, 2.0, 2.0)))
    assert np.allclose(got, interpolated(v.transpose(2, 1, 0).astype(float), m, (4, 4, 3)) / 10)


def test_displacement_and_its_transpose(spark):
    rng = np.random.default_rng(3)
    v, w, move = rng.random((4, 3, 3)), rng.random((4, 3, 3)), rng.normal(size=(4, 3, 3, 3))
    field = spark.createDataFrame([(*map(int, k), *map(float, move[k])) for k in np.ndindex(4, 3, 3)], "x int, y int, z int, dx double, dy double, dz double")
    there, back = dense(grid.displace(table(spark, v), [], field), v.shape), dense(grid.displace_back(table(spark, w), [], field), v.shape)
    assert math.isclose((there * w).sum(), (v * back).sum(), rel_tol=1e-9)
    middle = grid.shift_to_middle(table(spark, v), [], (4, 3, 3)).first()
    assert np.allclose([middle["sx"], middle["sy"], middle["sz"]], [n / 2 - (v.sum(axis=tuple(b for b in range(3) if b != a)) * np.arange(n)).sum() / v.sum() for a, n in enumerate(v.shape)])


def test_callbacks_come_after_each_step(spark):
    rng = np.random.default_rng(4)
    h = rng.random((8, 4))
    rows = spark.createDataFrame([(int(i), int(j), float(x)) for (i, j), x in np.ndenumerate(h)], "i long, j long, h double")
    data = spark.createDataFrame([(i, float(i + 1), 0.5) for i in range(8)], "i long, g double, s double")
    store = callbacks.Iterates(spark.createDataFrame([(j, 1.0) for j in range(4)], "j long, value double"), rows, data)
    half = lambda image, n, m: image.withColumn("value", F.col("value") / 2)
    last = solvers.osem(rows, data).run(2, 2, callback=callbacks.several(callbacks.every(2, half), store))
    f, want = np.ones(4), [np.ones(4)]
    for n in range(2):
        for m in range(2):
            own, g = h[m::2], np.arange(1, 9)[m::2]
            f = f * (own.T @ (g / (own @ f + 0.5))) / own.sum(axis=0)
            f = f / 2 if n == 1 else f
            want.append(f)
    got = store.table().toPandas().pivot(index="k", columns="j", values="value").to_numpy()
    assert np.allclose(got, want) and np.allclose([r["value"] for r in last.orderBy("j").collect()], f)
    assert np.allclose([r["value"] for r in store.expected(2).orderBy("i").collect()], h @ want[2] + 0.5)


def test_time_bins_and_their_efficiency(spark):
    info = spark.createDataFrame([("a", 5, 500.0, 60.0), ("b", 4, 400.0, 47.1)], "scanner_name string, num_tof_bins int, tof_range double, tof_fwhm double")
    t = imaging.time_bins(info, "b")
    assert t.edges == [-200.0, -100.0, 0.0, 100.0, 200.0] and t.centres == [-150.0, -50.0, 50.0, 150.0] and math.isclose(t.sigma, 20.0)
    got = np.array(spark.range(1).select(physics.tof_efficiency(F.array(F.lit(-10.0), F.lit(25.0)), F.array(F.lit(0.0), F.lit(10.0), F.lit(30.0)), 15.0).alias("p")).first()["p"])
    raw = np.exp(-((np.array([[-10.0], [25.0]]) - [0.0, 10.0, 30.0]) ** 2) / (2 * 15.0**2))
    assert np.allclose(got, raw / raw.sum(axis=0))


def test_collimator_response(spark):
    a, b, c = physics.collimator_response(0.15, 2.5, 20.0, intrinsic_140=0.38, energy=208.0)
    assert np.allclose([a, b, c], [0.15 / 2.4 / 2.3548200450309493, 0.15 / 2.3548200450309493, 0.38 * math.sqrt(140 / 208) / 2.3548200450309493])
    assert physics.collimator_response(0.2, 2.0, 20.0, 0.3, shape="square") == (0.2 / 1.9 / 2, 0.1, 0.0)
    assert math.isclose(spark.range(1).select(physics.response_width(F.lit(3.0), (0.1, 0.2, 0.3))).first()[0], math.sqrt(0.25 + 0.09))


def test_window_estimates_and_their_variance(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 20, (3, 6, 7, 5)).astype(float)  # window, a, r, z
    rows = spark.createDataFrame([(*map(int, k), float(x)) for k, x in np.ndenumerate(v)], "window int, a int, r int, z int, value double")
    widths = {0: 20.0, 1: 5.0, 2: 8.0}
    got = counts.window_estimate(rows, widths, 0, 1, 2, sigmas={"a": 0.0, "r": 0.6, "z": 0.5}).collect()
    kernel = lambda s: np.array(grid.gaussian_kernel(s))

    def smooth(x, squared):
        for axis, s in ((1, 0.6), (2, 0.5)):
            k = kernel(s) ** 2 if squared else kernel(s)
            half = len(k) // 2
            pad = [(half, half) if d == axis else (0, 0) for d in range(3)]
            padded = np.pad(x, pad, mode="edge")
            x = sum(w * np.take(padded, np.arange(x.shape[axis]) + o, axis=axis) for o, w in enumerate(k))
        return x

    low, high = 20 / 5 * 0.5, 20 / 8 * 0.5
    value, variance = smooth(v[1] * low + v[2] * high, False), smooth(v[1] * low**2 + v[2] * high**2, True)
    assert len(got) == value.size and all(np.allclose([r["value"], r["variance"]], [value[r["a"], r["r"], r["z"]], variance[r["a"], r["r"], r["z"]]]) for r in got)
    mask = spark.createDataFrame([(r, z) for r in range(2, 5) for z in range(1, 4)], "r int, z int")
    stray = counts.stray_scatter(rows, mask, 0.5, widths, 0, 1, 2).first()["value"]
    assert math.isclose(stray, 0.5 * (v[1][:, 2:5, 1:4].mean() * low + v[2][:, 2:5, 1:4].mean() * high))
    views = spark.createDataFrame([(a, a * 3.0) for a in range(10)], "a int, angle double")
    assert [tuple(r) for r in counts.subsampled_views(views, 3, 1).orderBy("a").collect()] == [(0, 3.0), (1, 12.0), (2, 21.0)]


def test_average_probability_of_a_uniform_map(spark):
    n, angles = 5, [0.0, 90.0, 180.0, 270.0]
    mu = table(spark, np.full((n, n, 2), 0.1))
    got = dense(spect.average_probability(mu, spect.stencil(spark, angles, n), 0.5, 4), (n, n, 2))
    to_edge = lambda k: np.exp(-0.1 * 0.5 * (n - k - 0.5))
    want = np.array([[[np.mean([to_edge(x), to_edge(n - 1 - x), to_edge(y), to_edge(n - 1 - y)])] * 2 for y in range(n)] for x in range(n)])
    assert np.allclose(got, want)


def test_sensitivity_sinogram(spark):
    g = rays.Grid((4, 4, 3), (8.0, 8.0, 8.0))
    mu = spark.createDataFrame(pd.DataFrame({"j": range(48), "value": 0.01}))
    norm = events.norm_sinogram(events.combinations(events.scanner_lut(spark, SCANNER)).withColumn("weight", F.lit(2.0)), SCANNER)
    lines = pet.sinogram_rays(norm, SCANNER)
    out = {r["i"]: math.exp(-r["value"]) for r in rays.project(lines, mu, g).collect()}
    want = {r["i"]: r["value"] * out[r["i"]] for r in lines.collect()}
    got = {r["i"]: r["value"] for r in pet.sensitivity_sinogram(norm, SCANNER, g, mu).collect()}
    assert got.keys() == want.keys() and all(math.isclose(v, want[k], rel_tol=1e-9) for k, v in got.items())
