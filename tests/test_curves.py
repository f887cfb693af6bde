import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radonframe.operators import counts, curves, solvers
from radonframe.sources import imaging, volumes

ENERGIES = [60.0, 80.0, 100.0, 150.0, 200.0, 300.0, 400.0, 500.0]
TRUE = {"air": curves.Curve(2e-4, 3e-3, 0.03, 0.5), "water": curves.Curve(0.2, 1.5, 0.032, 0.55), "bone": curves.Curve(0.42, 30.0, 0.035, 0.62)}


@pytest.fixture(scope="module")
def materials(spark):
    rows = [(m, e, c.at(e)) for m, c in TRUE.items() for e in ENERGIES] + [("water", None, 1.0), ("bone", 70.0, None)]
    return spark.createDataFrame(rows, "material string, energy double, mu double").persist()


def test_curves_are_found_again(materials):
    got = dict(zip(TRUE, curves.curves_of(materials, list(TRUE)), strict=True))
    for name, c in TRUE.items():
        assert all(math.isclose(getattr(got[name], k), getattr(c, k), rel_tol=1e-6) for k in ("c1", "c2", "d1", "d2")), (name, got[name])
    assert curves.fit_curves(materials.limit(0)).count() == 0


def test_no_other_curve_fits_noisy_rows_better(spark):
    rng = np.random.default_rng(1)
    mu = np.array([TRUE["water"].at(e) for e in ENERGIES]) * (1 + 0.01 * rng.standard_normal(len(ENERGIES)))
    c = curves.curves_of(spark.createDataFrame([("w", e, float(m)) for e, m in zip(ENERGIES, mu, strict=True)], "material string, energy double, mu double"), ["w"])[0]
    root = np.sqrt(ENERGIES)
    best = sum((m - c.at(e)) ** 2 for e, m in zip(ENERGIES, mu, strict=True))
    for d1 in np.linspace(0.005, 1.5, 90):
        for d2 in np.linspace(d1, 1.5, 90):
            basis = np.stack([np.exp(-d1 * root), np.exp(-d2 * root)], axis=1)
            rest = mu - basis @ np.linalg.lstsq(basis, mu, rcond=None)[0]
            assert best <= (rest**2).sum() * (1 + 1e-9)


def peaks(x):
    """By the definition: the last bin of the curvature's strict local maxima whose prominence suffices."""
    n, edges = np.histogram(x[(x > 1200) & (x < 1600)], bins=10, density=True)
    c = np.gradient(np.gradient(n))
    out = []
    for k in range(1, 9):
        if c[k - 1] < c[k] > c[k + 1]:
            left, right = k, k
            while left > 0 and c[left - 1] <= c[k]:
                left -= 1
            while right < 9 and c[right + 1] <= c[k]:
                right += 1
            if c[k] - max(c[left : k + 1].min(), c[k : right + 1].min()) >= 8e-5:
                out.append(k)
    return edges[out[-1]] + (edges[1] - edges[0]) / 2 if out else None


def test_bone_peak(spark):
    rng = np.random.default_rng(2)
    for bump in ([], [1420.0], [1300.0, 1500.0], [1580.0]):
        x = np.concatenate([rng.uniform(1000, 1700, 3000), *[rng.normal(b, 12, 900) for b in bump]])
        got = counts.density_peak(spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "value double"))
        want = peaks(x)
        assert (got is None) == (want is None) and (want is None or math.isclose(got, want))
    assert counts.density_peak(spark.createDataFrame([(1.0,)], "value double")) is None
    assert counts.density_peak(spark.createDataFrame([(1300.0,)] * 5, "value double")) == peaks(np.full(5, 1300.0))


def test_conversion_by_the_bone_peak_or_the_voltage(spark, materials):
    at = 77.0
    number = curves.ct_number(TRUE["bone"], TRUE["water"], TRUE["air"], at)
    assert math.isclose(curves.energy_of_bone(number, TRUE["bone"], TRUE["water"], TRUE["air"]), at, rel_tol=1e-9)
    assert curves.energy_of_bone(1e6, TRUE["bone"], TRUE["water"], TRUE["air"]) == 550.0  # no crossing: least miss
    c = curves.conversion(None, 120.0, 208.0, materials)
    assert c.ct_energy == 90.0 and c.bone_peak is None
    for name in TRUE:
        hu = curves.ct_number(TRUE[name], TRUE["water"], TRUE["air"], 90.0)
        mu = c.a1 * hu + c.b1 if hu < 0 else c.a2 * hu + c.b2
        assert math.isclose(mu, TRUE[name].at(208.0), rel_tol=1e-5, abs_tol=1e-9)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(1000, 1700, 3000), rng.normal(1420, 12, 900)])
    c = curves.conversion(spark.createDataFrame([(float(v),) for v in x], "value double"), 120.0, 208.0, materials)
    assert math.isclose(c.bone_peak, peaks(x)) and math.isclose(c.ct_energy, curves.energy_of_bone(c.bone_peak, *[TRUE[m] for m in ("bone", "water", "air")]), rel_tol=1e-4)


def test_slices_to_an_aligned_map(spark, materials):
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 2000, (3, 4, 5))  # z, y, x
    order = [2, 0, 1]
    rows = [(10.0 * k, 1.5 if k else None, -1000.0 if k else None, raw[k].tolist(), [0.0, 0.0, 10.0 * k], [2.0, 3.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]) for k in order] + [(None, 1.0, 0.0, [[1]], None, None, None)]
    slices = spark.createDataFrame(rows, "z_pos double, slope double, intercept double, pixels array<array<int>>, position array<double>, spacing array<double>, orientation array<double>")
    want = {(x, y, z): raw[z, y, x] * (1.5 if z else 1.0) - (1000.0 if z else 0.0) for z in range(3) for y in range(4) for x in range(5)}
    plan = imaging.slices(spark, slices)._jdf.queryExecution().executedPlan().toString()
    assert "pixels" not in plan[plan.index("Window") :].split("\n+- ")[0] or plan.index("Window") > plan.index("Broadcast")
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in imaging.slices(spark, slices).collect()} == want
    whole = slices.filter("z_pos is not null")
    c = curves.conversion(imaging.slices(spark, whole), 120.0, 208.0, materials)
    mu = lambda v: max(c.a1 * v + c.b1 if v < 0 else c.a2 * v + c.b2, 0.0)
    same = volumes.of_slices(whole)
    got = {(r["x"], r["y"], r["z"]): r["value"] for r in volumes.attenuation_of_slices(spark, whole, same, (5, 4, 3), 208.0, 120.0, materials).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], mu(v), rel_tol=1e-9, abs_tol=1e-12) for k, v in want.items())
    flipped = {(r["x"], r["y"], r["z"]): r["value"] for r in volumes.attenuation_of_slices(spark, whole, volumes.centred((5, 4, 3), (0.2, 0.3, 1.0)), (5, 4, 3), 208.0, 120.0, materials, (0.2, 0.3, 1.0)).collect()}
    assert all(math.isclose(flipped[x, y, 2 - z], v, rel_tol=1e-6, abs_tol=1e-9) for (x, y, z), v in got.items())


def test_frames_of_several_heads(spark):
    rows = [(f"head{h}", k, 1 + k % 2, 10.3 * k + h, 100.0 + k, -20.0 * h, 1500.0 + k) for h in (1, 0) for k in range(4)]
    frames = imaging.head_frames(spark.createDataFrame(rows, "file string, frame int, window int, angle double, x double, y double, time double"), 2, 2.5)
    got = {r["a"]: r for r in frames.collect()}
    own = sorted(r for r in rows if r[2] == 2)
    assert len(got) == 4
    for a, (file, k, _, angle, x, y, time) in enumerate(own):
        t, r = math.radians(angle), got[a]
        assert (r["file"], r["frame"], r["angle"]) == (file, k, round(angle))
        assert math.isclose(r["radius"], (x * math.sin(t) + y * math.cos(t)) / 10) and math.isclose(r["offset"], (x * math.cos(t) - y * math.sin(t)) / 2.5) and math.isclose(r["time"], time / 1000)
    pixels = spark.createDataFrame([(f, k, 0.5 + h, [[10 * k + c + 100 * z for c in range(2)] for z in range(3)]) for h, f in enumerate(("head0", "head1")) for k in range(4)], "file string, frame int, scale double, pixels array<array<int>>")
    out = {(r["a"], r["r"], r["z"]): r["value"] for r in imaging.head_projections(pixels, frames).collect()}
    assert out == {(a, c, z): (10 * k + c + 100 * z) * (0.5 + int(f[-1])) for a, (f, k, *_) in enumerate(own) for c in range(2) for z in range(3)}


def test_variance_of_a_smoothed_term_keeps_what_neighbours_share(spark):
    """The quadratic form s (F x)^2, against the same sums in NumPy, in the uncertainty of two iterations."""
    rng = np.random.default_rng(5)
    angles, nr, nz, voxels = 4, 3, 2, 5
    h = rng.uniform(0, 1, (angles * nr * nz, voxels))
    g, s = rng.poisson(6, len(h)).astype(float), rng.uniform(0.5, 1, len(h))
    windows = [(w, a, r, z, float(rng.poisson(4))) for w in (0, 1, 2) for a in range(angles) for r in range(nr) for z in range(nz)]
    counted = spark.createDataFrame(windows, "window int, a int, r int, z int, value double")
    widths, sigmas = {0: 20.0, 1: 10.0, 2: 8.0}, {"a": 0.6, "r": 0.7, "z": 0.5}
    terms = counts.window_variance(counted, widths, 0, 1, 2, sigmas=sigmas, shape=(nr, nz))
    lower, upper = (np.array([v for w, *_, v in windows if w == k]).reshape(angles, nr, nz) for k in (1, 2))
    var = (20 / 10 * 0.5) ** 2 * lower + (20 / 8 * 0.5) ** 2 * upper

    def smooth(x):
        for axis, name in enumerate("arz"):
            k = np.array(counts.gaussian_kernel(sigmas[name]))
            half = len(k) // 2
            wide = np.pad(x, [(half, half) if n == axis else (0, 0) for n in range(3)], "wrap" if name == "a" else "edge") if half <= x.shape[axis] or name != "a" else np.take(x, np.arange(-half, x.shape[axis] + half) % x.shape[axis], axis)
            x = sum(np.take(wide, np.arange(o, o + x.shape[axis]), axis) * v for o, v in enumerate(k))
        return x

    x = rng.standard_normal(len(h))
    got = terms(spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, value double"))
    assert np.isclose(got.agg(F.sum("value")).first()[0], (var * smooth(x.reshape(var.shape)) ** 2).sum())
    matrix = spark.createDataFrame([(i, j, float(h[i, j])) for i in range(len(h)) for j in range(voxels)], "i long, j long, h double")
    data = spark.createDataFrame([(i, float(g[i]), float(s[i])) for i in range(len(h))], "i long, g double, s double")
    first = spark.createDataFrame([(j, 1.0) for j in range(voxels)], "j long, value double")
    solver = solvers.osem(matrix, data)
    iterates = [first, solver.run(1)]
    mask = spark.createDataFrame([(1, 1.0), (2, 1.0)], "j long, value double")
    e, norm = h.sum(axis=1) + s, h.sum(axis=0)
    scaled = np.array([0, 1, 1, 0, 0]) / norm
    v, w = h @ scaled / e, -(h @ scaled) * g / e**2
    want = np.sqrt((v**2 * g).sum() + (var * smooth(w.reshape(var.shape)) ** 2).sum())
    assert np.isclose(solvers.uncertainty(matrix, data, iterates, mask, additive_variance=terms).first()["value"], want)
    # a filter after the last iteration acts on the mask
    k = np.array([[0.5 if a == b else 0.25 if abs(a - b) == 1 else 0.0 for b in range(voxels)] for a in range(voxels)])
    table = spark.createDataFrame([(a, b, float(k[a, b])) for a in range(voxels) for b in range(voxels) if k[a, b]], "j long, l long, w double")
    after = lambda f: table.join(f.withColumnRenamed("j", "l"), "l").groupBy("j").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    v = h @ (k @ np.array([0, 1, 1, 0, 0]) / norm) / e
    assert np.isclose(solvers.uncertainty(matrix, data, iterates, mask, after=after).first()["value"], np.sqrt((v**2 * g).sum()))
