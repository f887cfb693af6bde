"""Conversions, simulated coincidences, curved panels and plane-wise solvers against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from radonframe.operators import callbacks, counts, events, planes, rays, solvers, spect
from radonframe.sources import coincidences

TABLE = [
    (140.0, 120.0, "opt imact6", 1.5e-4, 0.15, 1.1e-4, 0.15), (140.0, 80.0, "optimact6", 1.6e-4, 0.16, 1.2e-4, 0.16), (208.0, 120.0, "optimact6", 1.3e-4, 0.13, 1.0e-4, 0.13), (209.0, 110.0, "symbiat16", 9e-5, 0.12, 8e-5, 0.12),
]
COLUMNS = "Energy double, `CT Energy` double, `Model Name` string, `Lower Coeff` double, `Lower Constant` double, `Upper Coeff` double, `Upper Constant` double"


def test_conversion_takes_the_model_then_the_nearest_energies(spark):
    table = spark.createDataFrame(TABLE, COLUMNS)
    pick = lambda *a: tuple(counts.conversion(table, *a).first())
    assert pick("Opt-Imact 6", 150.0, 90.0) == (1.6e-4, 0.16, 1.2e-4, 0.16)
    assert pick("Opt-Imact 6", 150.0, 110.0) == (1.5e-4, 0.15, 1.1e-4, 0.15)
    assert pick("Opt-Imact 6", 300.0, 0.0)[0] == 1.3e-4 and pick("unknown", 300.0, 0.0)[0] == 9e-5
    volume = spark.createDataFrame([(-2000.0,), (-100.0,), (0.0,), (500.0,)], "value double")
    assert np.allclose([r["value"] for r in counts.converted(volume, table, "optimact6", 208.0, 120.0).collect()], [0.0, 0.13 - 0.013, 0.13, 0.18])


def test_lines_through_materials(spark):
    rows = lambda f: spark.createDataFrame([(float(e), f(e)) for e in range(40, 400, 20)], "energy double, mu double")
    of = {"air": lambda e: 1e-4 / e, "water": lambda e: 20.0 / e, "bone": lambda e: 45.0 / e + 900.0 / e**2}
    at = lambda m, e: float(np.interp(e, range(40, 400, 20), [of[m](x) for x in range(40, 400, 20)]))
    got = counts.material_lines(*map(rows, of.values()), 73.0, 210.0).first()
    hu = {m: (at(m, 73.0) - at("water", 73.0)) / (at("water", 73.0) - at("air", 73.0)) * 1000 for m in of}
    mu = {m: at(m, 210.0) for m in of}
    assert math.isclose(got["a1"], (mu["water"] - mu["air"]) / (hu["water"] - hu["air"]), rel_tol=1e-9) and got["b1"] == got["b2"] == mu["water"]
    assert math.isclose(got["a2"], (mu["bone"] - mu["water"]) / (hu["bone"] - hu["water"]), rel_tol=1e-9)


MACRO = """/gate/crystal/geometry/setXLength 20. mm
/gate/rsector/placement/setTranslation 300.0 0 0 mm
/gate/module/placement/setTranslation 0.5 0 0 mm
/gate/crystal/repeaters/insert cubicArray
/gate/crystal/cubicArray/setRepeatNumberX 1
/gate/crystal/cubicArray/setRepeatNumberY 4
/gate/crystal/cubicArray/setRepeatNumberZ 5
/gate/crystal/cubicArray/setRepeatVector 0. 4.1 5.2 mm
/gate/module/repeaters/insert linear
/gate/module/linear/setRepeatNumber 3
/gate/module/linear/setRepeatVector 0. 0. 30. mm
/gate/module/repeaters/insert cubicArray
/gate/module/cubicArray/setRepeatNumberX 1
/gate/module/cubicArray/setRepeatNumberY 2
/gate/module/cubicArray/setRepeatNumberZ 3
/gate/module/cubicArray/setRepeatVector 0. 17. 30. mm
/gate/rsector/repeaters/insert ring
/gate/rsector/ring/setRepeatNumber 12
"""


def test_scanner_of_a_macro(spark, tmp_path):
    (tmp_path / "g.mac").write_text(MACRO)
    s = coincidences.scanner_of_macro(spark, f"{tmp_path}/g.mac", depth=2.0)
    assert (s.crystal_trans, s.crystal_axial, s.submodule_trans, s.submodule_axial, s.module_trans, s.module_axial, s.rsector_trans, s.rsector_axial) == (4, 5, 1, 1, 2, 3, 12, 1)
    assert (s.crystal_trans_spacing, s.crystal_axial_spacing, s.module_trans_spacing, s.module_axial_spacing) == (4.1, 5.2, 17.0, 30.0)
    assert math.isclose(s.radius, 300.5 - 10 + 2) and s.per_ring == 96 and s.rings == 15


def test_kinds_of_coincidences(spark):
    names = [f"{c}_{k}" for k in (1, 2) for c in "xyz"]
    rows = [(1, 0, *[1.0] * 6), (2, 1, *[1.0] * 6), (3, 0, *[1.0] * 5, 2.0), (4, 1, *[1.0] * 5, 2.0)]
    df = spark.createDataFrame(rows, "e int, compton_1 int, " + ", ".join(f"{n} double" for n in names)).withColumns({c: F.lit(0) for c in ("compton_2", "rayleigh_1", "rayleigh_2")})
    pick = lambda **k: {r["e"] for r in coincidences.chosen(df, **k).collect()}
    assert pick() == {1, 2, 3, 4} and pick(randoms=False) == {1, 2} and pick(scatters=False) == {1, 3} and pick(randoms=False, scatters=False) == {1}
    assert pick(randoms_only=True) == {3, 4} and pick(scatters_only=True) == {2} and pick(randoms_only=True, scatters_only=True) == {3, 4}
    ids = coincidences.clinical_detectors(spark.createDataFrame([(2, 7, 0, 5)], "ring_1 int, crystal_1 int, ring_2 int, crystal_2 int"), 100).first()
    assert (ids["detector_1"], ids["detector_2"]) == (207, 5)


def test_rays_of_a_curved_panel(spark):
    view = (1, 0.3, 500.0, 10.0, 0.01, 2.0, -1.0, 1.5, 0.5)
    views = spark.createDataFrame([view], "view int, phi double, rho double, z double, dphi double, drho double, dz double, centre_column double, centre_row double")
    got = {r["i"]: r for r in rays.arc_rays(views, 4, 2, 900.0, 0.02, 3.0).collect()}
    assert len(got) == 8
    for c in range(4):
        for k in range(2):
            r = got[(4 + c) * 2 + k]
            assert np.allclose([r["x1"], r["y1"], r["z1"]], [502 * math.cos(0.31), 502 * math.sin(0.31), 9.0])
            t = 0.3 + (c - 1.5) * 0.02
            assert np.allclose([r["x2"], r["y2"], r["z2"]], [500 * math.cos(0.3) - 900 * math.cos(t), 500 * math.sin(0.3) - 900 * math.sin(t), 10 + (k - 0.5) * 3])


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(8)
    h = np.where(rng.random((24, 9)) < 0.5, rng.random((24, 9)), 0.0) + 0.01
    rows = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(h)], "i long, j long, h double")
    return h, rows, rng.random((24, 3)) * 10


def test_planes_are_solved_as_by_themselves(spark, system):
    h, rows, g = system
    data = spark.createDataFrame([(i, z, float(g[i, z])) for i in range(24) for z in range(3)], "i long, z int, value double")
    image = planes.long(planes.osem(rows, planes.wide(data, "i", 2), 2, subsets=3), "j", 3)
    got = {(r["j"], r["z"]): r["value"] for r in image.collect()}
    f = np.ones((9, 3))
    for _ in range(2):
        for m in range(3):
            own = h[m::3]
            norm = own.sum(axis=0)[:, None]
            f = f + f / (norm + 1e-11) * (own.T @ (g[m::3] / (own @ f + 1e-11)) - norm)
    assert all(math.isclose(v, f[k], rel_tol=1e-8) for k, v in got.items())


def test_deep_image_prior_loop(spark, system):
    h, rows, g = system
    data = spark.createDataFrame([(i, float(g[i, 0]), 0.1) for i in range(24)], "i long, g double, s double")
    network = lambda label, n: label.withColumn("value", F.col("value") * 0.5 + 0.25)
    got = {r["j"]: r["value"] for r in solvers.dip(rows, data, network, 3.0, 2, 2).collect()}
    dual, norm = np.zeros(9), h.sum(axis=0)
    f = out = np.ones(9) * 0.5 + 0.25
    for _ in range(2):
        for m in range(2):
            own, bins = h[m::2], g[m::2, 0]
            n = own.sum(axis=0)
            f = np.maximum(f, 0)
            em = f + f / (n + 1e-11) * (own.T @ (bins / (own @ f + 0.1 + 1e-11)) - n)
            u = out - dual - norm / 3.0
            f = 0.5 * u + 0.5 * np.sqrt(u * u + 4 * em * norm / 3.0)
        out = (f + dual) * 0.5 + 0.25
        dual = dual + f - out
    assert all(math.isclose(v, out[j], rel_tol=1e-8) for j, v in got.items())


def test_response_by_distance(spark):
    far = spark.range(5).select(spect.distance(5, 10.0, 0.5)(F.col("id")).alias("d")).collect()
    assert np.allclose([r["d"] for r in far], [11.0, 10.5, 10.0, 9.5, 9.0]) and spect.kernel_half(0.8, 0.3) == 8
    with pytest.raises(ValueError):
        spect.depth_blur(spark.createDataFrame([(0, 0, 0, 0, 1.0)], "a int, x int, y int, z int, value double"), lambda x: x, 1, shape="round")


def test_fine_time_bins(spark):
    rows = spark.createDataFrame([(-13,), (0,), (12,), (13,)], "t int").select(events.coarse_tof(F.col("t"), 13, 14).alias("b")).collect()
    assert [r["b"] for r in rows] == [15, 14, 14, 13]


def test_uncertainty_over_subsets_with_a_prior(spark, system):
    h, rows, g = system
    data = spark.createDataFrame([(i, float(g[i, 1]), 0.2) for i in range(24)], "i long, g double, s double")
    first = spark.createDataFrame([(j, 1.0 + j % 3) for j in range(9)], "j long, value double")
    store = callbacks.Iterates(first)
    solver = solvers.osem(rows, data)
    solver.image = first
    solver.run(2, 2, callback=store)
    bend = lambda f, x: f.withColumnRenamed("value", "f").join(x, "j").withColumn("value", F.col("f") * F.col("value") * 0.3).select("j", "value")
    mask = spark.createDataFrame([(j, 1.0) for j in range(4)], "j long, value double")
    spread = spark.createDataFrame([(i, 0.1 * (i + 1)) for i in range(24)], "i long, value double")
    got = solvers.uncertainty(rows, data, store.images, mask, 2, bend, spread).first()
    f = [1.0 + np.arange(9) % 3]
    for n in range(4):
        own = h[n % 2 :: 2]
        f.append(f[-1] * (own.T @ (g[n % 2 :: 2, 1] / (own @ f[-1] + 0.2))) / own.sum(axis=0))
    x, v, w = (np.arange(9) < 4) * 1.0, np.zeros(24), np.zeros(24)
    for n in range(3, -1, -1):
        own, k = h[n % 2 :: 2], slice(n % 2, None, 2)
        e, t = own @ f[n] + 0.2, x * f[n] / own.sum(axis=0)
        v[k] += own @ t / e
        w[k] += -(own @ t) * g[k, 1] / e**2
        x = own.T @ (-(own @ t) * g[k, 1] / e**2) + f[n + 1] / f[n] * x - 0.5 * 0.3 * f[n] * t
    want = math.sqrt((v**2 * g[:, 1]).sum() + (w**2 * 0.1 * (np.arange(24) + 1)).sum())
    assert math.isclose(got["value"], want, rel_tol=1e-6) and math.isclose(got["percent"], want / f[-1][:4].sum() * 100, rel_tol=1e-6)
