"""Scatter, sensitivity and sinogram space against loops in NumPy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radonframe.operators import algebra, events, pet, rays, scatter, solvers
from radonframe.plans.fixtures import SCANNER

GRID = rays.Grid((6, 6, 4), (6.0, 6.0, 8.0))
N = math.prod(GRID.shape)


def image(spark, values):
    return spark.createDataFrame(pd.DataFrame({"j": range(len(values)), "value": values}))


def integral(values, a, b):
    ray, voxel, w = rays.joseph(np.array([[*a, *b]]), GRID)
    return float((w * values[voxel]).sum())


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(1)
    f, mu = rng.random(N), 0.02 * rng.random(N)
    lut = events.scanner_lut(spark, SCANNER)
    sampled = scatter.sample_detectors(lut, SCANNER.per_ring, SCANNER.rings, 2, 4)
    ids = sorted(r["detector_id"] for r in sampled.collect())
    pairs = [(k, a, b) for k, (a, b) in enumerate(itertools.combinations(ids, 2)) if k % 5 == 0]
    voxels = image(spark, mu).select(*[e.cast("int").alias(c) for c, e in zip("xyz", (F.floor(F.col("j") / 24), F.pmod(F.floor(F.col("j") / 4), F.lit(6)), F.pmod("j", F.lit(4))), strict=True)], "value")
    points = scatter.scatter_points(voxels, 3, 0.004)
    places = {r["detector_id"]: np.array([r["x"], r["y"], r["z"]]) for r in lut.collect()}
    return f, mu, lut, sampled, pairs, points, places


def kn(e):
    a = e / 511
    return (1 + a) / a**2 * (2 * (1 + a) / (1 + 2 * a) - math.log(1 + 2 * a) / a) + math.log(1 + 2 * a) / (2 * a) - (1 + 3 * a) / (1 + 2 * a) ** 2


def brute(scene, centres=None, sigma=None, parts=1):
    f, mu, _, _, pairs, points, places = scene
    at = [((np.array([p["x"], p["y"], p["z"]]) - (np.array(GRID.shape) - 1) / 2) * GRID.spacing, p["value"]) for p in points.collect()]
    out = {}
    for i, a, b in pairs:
        for s, m in at:
            legs = [places[a] - s, places[b] - s]
            far = [np.linalg.norm(x) for x in legs]
            out_of = [math.exp(-integral(mu, s, places[d])) for d in (a, b)]
            cos = -legs[0] @ legs[1] / far[0] / far[1]
            e = 511 / (2 - cos)
            p = 1 / (2 - cos)
            section = 2.818e-13**2 / 2 * p * (1 - p * (1 - cos**2) + p**2) / (0.75 * 6.65e-25 * kn(511))
            efficiency = 0.5 * (1 - math.erf((430 - e) / (math.sqrt(2) * 511 * 0.15 / (2 * math.sqrt(2 * math.log(2))))))
            face = [x[:2] @ places[d][:2] / r / np.linalg.norm(places[d][:2]) for x, d, r in zip(legs, (a, b), far, strict=True)]
            factor = face[0] * face[1] * section * efficiency * m * out_of[0] * out_of[1] * math.prod(GRID.spacing) / (far[0] * far[1]) ** 2
            pieces = [[integral(f, s + x * k / parts, s + x * (k + 1) / parts) for k in range(parts)] for x in legs]
            slow = [v ** (kn(e) / kn(511) - 1) for v in out_of]
            for t, c in enumerate(centres or [0]):
                seen = []
                for k, sign in ((0, -1), (1, 1)):
                    if centres is None:
                        seen.append(pieces[k][0])
                        continue
                    mid = [(n + 0.5) / parts * far[k] for n in range(parts)]
                    raw = lambda o, m=mid: np.exp(-((o - np.array(m)) ** 2) / (2 * sigma**2))
                    total = sum(raw(sign * ((far[1] - far[0]) / 2 + o)) for o in centres)
                    own = raw(sign * ((far[1] - far[0]) / 2 + c))
                    seen.append(float((np.where(total > 0, own / np.where(total > 0, total, 1), 0) * pieces[k]).sum()))
                out.setdefault((i, t), []).append(factor * (seen[0] * slow[1] + seen[1] * slow[0]))
    return {k: float(np.mean(v)) for k, v in out.items()}


def test_single_scatter_equals_loops(spark, scene):
    f, mu, _, sampled, pairs, points, _ = scene
    rows = scatter.single_scatter(spark.createDataFrame(pairs, "i long, detector_1 int, detector_2 int"), sampled, points, image(spark, f), image(spark, mu), GRID).collect()
    want = brute(scene)
    assert len(rows) == len(want) and all(math.isclose(r["value"], want[r["i"], 0], rel_tol=1e-6, abs_tol=1e-18) for r in rows)


def test_single_scatter_with_time_bins_equals_loops(spark, scene):
    f, mu, _, sampled, pairs, points, _ = scene
    scene = (*scene[:4], pairs[::4], *scene[5:])
    rows = scatter.single_scatter(spark.createDataFrame(pairs[::4], "i long, detector_1 int, detector_2 int"), sampled, points, image(spark, f), image(spark, mu), GRID, tof=([-30.0, 0.0, 30.0], 25.0, 4)).collect()
    want = brute(scene, [-30.0, 0.0, 30.0], 25.0, 4)
    assert len(rows) == len(want) and all(math.isclose(r["value"], want[r["i"], r["tof"]], rel_tol=1e-6, abs_tol=1e-18) for r in rows)


def test_sensitivity_and_images_beyond_the_broadcast(spark, scene, monkeypatch):
    f, mu, lut, _, pairs, _, places = scene
    lines = pet.pair_rays(spark.createDataFrame(pairs, "i long, detector_1 int, detector_2 int"), lut)
    weights = spark.createDataFrame([(i, 1.0 / (1 + i % 3)) for i, _, _ in pairs], "i long, weight double")
    want = np.zeros(N)
    for i, a, b in pairs:
        _, voxel, w = rays.joseph(np.array([[*places[a], *places[b]]]), GRID)
        np.add.at(want, voxel, w * (math.exp(-integral(mu, places[a], places[b])) / (1 + i % 3) + 1e-11))
    for most in (1 << 23, 10):
        monkeypatch.setattr(rays, "MAX_VOXELS", most)
        got = {r["j"]: r["value"] for r in pet.sensitivity(lines, GRID, image(spark, mu), weights).collect()}
        assert all(math.isclose(got.get(j, 0.0), want[j], rel_tol=1e-9, abs_tol=1e-12) for j in range(N))


def test_listmode_step_divides_by_the_whole_sensitivity(spark, scene):
    _, _, lut, _, pairs, _, places = scene
    lines = pet.pair_rays(spark.createDataFrame(pairs, "i long, detector_1 int, detector_2 int"), lut)
    sensitivity = pet.sensitivity(lines, GRID)
    own = lines.filter("i % 10 = 0")
    h = rays.weights(own, GRID)
    data = own.select("i", F.lit(1.0).alias("g"), F.lit(0.1).alias("s"))
    solver = solvers.osem(h, data)
    solver.sensitivity = sensitivity
    got = {r["j"]: r["value"] for r in solver.run(1).collect()}
    norm, back = np.zeros(N), np.zeros(N)
    for i, a, b in pairs:
        _, voxel, w = rays.joseph(np.array([[*places[a], *places[b]]]), GRID)
        np.add.at(norm, voxel, w * (1 + 1e-11))
        if i % 10 == 0:
            np.add.at(back, voxel, w / (w.sum() + 0.1 + 1e-11))
    assert all(math.isclose(v, 1 + (back[j] - norm[j]) / (norm[j] + 1e-11), rel_tol=1e-6, abs_tol=1e-9) for j, v in got.items())


def test_axial_scale_and_first_image(spark):
    lut = events.scanner_lut(spark, SCANNER)
    g = rays.Grid((2, 2, 9), (5.0, 5.0, 3.0))
    z = [r["z"] for r in lut.collect()]
    low, high = min(z) / 3 + 4, max(z) / 3 + 4
    mid = (low + high) / 2
    got = {r["j"]: r["value"] for r in pet.prior_scale(lut, g).collect()}
    assert all(math.isclose(got[j], max((mid - abs(j % 9 - mid)) / mid, 0)) for j in range(36))
    first = {r["j"]: r["value"] for r in pet.initial_image(lut, g).collect()}
    assert all(first[j] == float(math.ceil(max(low, 0)) <= j % 9 < math.floor(max(high, 0))) for j in range(36))


def test_scatter_scale_equals_numpy(spark):
    rng = np.random.default_rng(2)
    h = np.where(rng.random((30, 12)) < 0.3, rng.random((30, 12)), 0.0)
    mu = np.where(np.arange(12) < 3, 0.01, 0.0)
    s, m, r = rng.random(30), rng.random(30) * 3, rng.random(30) * 0.4
    outside = h @ (mu > 0.004) == 0
    norm = h.sum(axis=0)
    back = lambda v: h.T @ (v * outside) / np.where(norm > 0, norm, 1)
    want = (back(s) * np.maximum(back(m) - back(r), 0)).sum() / (back(s) ** 2).sum()
    table = lambda v: spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "i long, value double")
    rows = spark.createDataFrame([(int(i), int(j), float(h[i, j])) for i, j in zip(*np.nonzero(h), strict=True)], "i long, j long, h double")
    got = scatter.scatter_scale(rows, table(s), table(m), table(mu).withColumnRenamed("i", "j"), randoms=table(r)).first()["value"]
    assert math.isclose(got, want, rel_tol=1e-9)


def test_bins_of_a_sinogram_lie_on_their_crystals(spark):
    p, lut = SCANNER.per_ring, {r["detector_id"]: (r["x"], r["y"], r["z"]) for r in events.scanner_lut(spark, SCANNER).collect()}
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(itertools.combinations(range(SCANNER.per_ring * SCANNER.rings), 2)) if a % p != b % p], "i long, detector_1 int, detector_2 int")
    cells = events.with_cells(pairs, SCANNER)
    bins = pet.sinogram_rays(cells.select("a", "r", "p", F.col("i").alias("pair"), "detector_1", "detector_2"), SCANNER).collect()
    assert len(bins) == pairs.count()
    for b in bins:
        ends = sorted([lut[b["detector_1"]], lut[b["detector_2"]]])
        got = sorted([(b["x1"], b["y1"], b["z1"]), (b["x2"], b["y2"], b["z2"])])
        assert np.allclose(ends, got, atol=1e-6)


def test_forward_of_a_sinogram_is_its_matrix(spark, scene):
    f = scene[0]
    bins = spark.createDataFrame([(a, r, p) for a in range(3) for r in range(8, 16) for p in range(2)], "a int, r int, p int")
    lines = pet.sinogram_rays(bins, SCANNER)
    a = {r["i"]: r["value"] for r in rays.project(lines, image(spark, f), GRID).collect()}
    b = {r["i"]: r["value"] for r in algebra.forward(rays.weights(lines, GRID), image(spark, f)).collect()}
    assert len(a) == 48 and all(math.isclose(v, b.get(i, 0.0), abs_tol=1e-9) for i, v in a.items())


def test_scatter_in_all_bins_equals_numpy(spark, scene):
    """Linear radial functions in each plane of sampled rings, then lines between rings, and the scale by back projections."""
    f, mu = scene[0], scene[1]
    per, rings = SCANNER.per_ring, SCANNER.rings
    lut = events.scanner_lut(spark, SCANNER)
    chosen = scatter.sample_detectors(lut, per, rings, 2, 4)
    ids = sorted(r["detector_id"] for r in chosen.collect())
    pairs = [(a * per * rings + b, a, b) for a, b in itertools.combinations(ids, 2) if a % per != b % per]
    table = spark.createDataFrame(pairs, "i long, detector_1 int, detector_2 int")
    own = mu * 0.004 / mu.max() * 2
    place = [(*map(int, np.unravel_index(j, GRID.shape)), float(v)) for j, v in enumerate(own)]
    points = scatter.scatter_points(spark.createDataFrame(place, "x int, y int, z int, value double"), 2)
    sparse = events.with_cells(scatter.single_scatter(table, chosen, points, image(spark, f), image(spark, own), GRID).join(table, "i"), SCANNER).select("a", "r", "p", "value")
    cells = {(r["_c1"], r["_c2"]): (r["a"], r["r"]) for r in events.cell_table(spark, SCANNER).collect() if r["_c1"] > r["_c2"]}
    planes = {(a, b): r for a in range(rings) for b in range(rings) for r in [spark.range(1).select(events.ring_plane(F.lit(a), F.lit(b), rings)).first()[0]]}
    z = {r["detector_id"] // per: r["z"] for r in lut.filter(F.pmod("detector_id", F.lit(per)) == 0).collect()}
    known = sorted({d // per for d in ids})
    nodes = np.array(sorted({cells[a, b] for a, b in itertools.permutations({d % per for d in ids}, 2) if a > b}), float)
    every = np.array(sorted(set(cells.values())), float)
    value = {(r["a"], r["r"], r["p"]): r["value"] for r in sparse.collect()}
    distance = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    n = len(nodes)
    system = np.block([[-distance(nodes, nodes), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    fitted = {}
    for s, t in itertools.product(known, known):
        w = np.linalg.solve(system, [*[value.get((*map(int, c), planes[s, t]), 0.0) for c in nodes], 0.0])
        fitted[s, t] = -distance(every, nodes) @ w[:n] + w[n]
    want = {}
    for a, b in itertools.product(range(rings), range(rings)):
        total = 0.0
        for s, t in itertools.product(known, known):
            share = lambda x, k: np.interp(-z[x], [-z[y] for y in known], np.eye(len(known))[known.index(k)])
            total = total + share(a, s) * share(b, t) * fitted[s, t]
        want |= {(*map(int, c), planes[a, b]): v for c, v in zip(every, total, strict=True)}
    got = {(r["a"], r["r"], r["p"]): r["value"] for r in scatter.interpolated(sparse, SCANNER, chosen).collect()}
    top = max(map(abs, want.values()))
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 * top for k, v in want.items())
    # the whole way
    rng = np.random.default_rng(4)
    counts = {k: float(x) for k, x in zip(sorted(want), rng.poisson(3, len(want)), strict=True)}
    measured = spark.createDataFrame([(*k, v) for k, v in counts.items()], "a int, r int, p int, value double")
    whole = {(r["a"], r["r"], r["p"]): r["value"] for r in scatter.estimate(image(spark, f), image(spark, own), measured, SCANNER, GRID, 2, 0.004, 2, 4).collect()}
    bins = pet.sinogram_rays(measured.select("a", "r", "p"), SCANNER).persist()
    number = {(r["a"], r["r"], r["p"]): r["i"] for r in bins.collect()}
    order = {i: k for k, i in enumerate(sorted(number.values()))}
    h = np.zeros((len(order), N))
    for r in rays.weights(bins.select("i", *rays.ENDS), GRID).collect():
        h[order[r["i"]], r["j"]] = r["h"]
    column = lambda d: np.array([x for _, x in sorted((order[number[k]], v) for k, v in d.items())])
    outside, norm = h @ (own > 0.004) == 0, h.sum(axis=0)
    assert 0 < outside.sum() < len(outside)
    back = lambda v: h.T @ (v * outside) / np.where(norm > 0, norm, 1)
    s, m = back(column(want)), back(column(counts))
    scale = (s * np.maximum(m, 0)).sum() / (s * s).sum()
    assert whole.keys() == want.keys() and all(abs(whole[k] - v * scale) < 1e-6 * top * abs(scale) for k, v in want.items())
    with pytest.raises(ValueError):
        scatter.MAX_NODES, most = 3, scatter.MAX_NODES
        try:
            scatter.interpolated(sparse, SCANNER, chosen)
        finally:
            scatter.MAX_NODES = most
