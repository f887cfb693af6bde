import numpy as np
import pytest
from pyspark.sql import functions as F

from radonframe.operators import beds, counts, grid, heads, rays, solvers, spect, systems
from radonframe.operators.rays import Grid


def dense(df, rows, columns):
    out = np.zeros((rows, columns))
    for r in df.collect():
        out[r["i"], r["j"]] += r["h"]
    return out


def column(df, key, n, value="value"):
    out = np.zeros(n)
    for r in df.collect():
        out[r[key]] += r[value]
    return out


def osem(h, g, s, iterations, parts):
    """Plain OSEM of dense arrays; parts: bins of each subset."""
    f = np.ones(h.shape[1])
    for _ in range(iterations):
        for p in parts:
            norm = h[p].sum(axis=0)
            f = f + f / (norm + 1e-11) * (h[p].T @ (g[p] / (h[p] @ f + s[p] + 1e-11)) - norm)
            f[f <= 0] = 0
    return f


G = Grid((5, 4, 3), (4.0, 4.0, 5.0))


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, rng.uniform(-30, -14, 3) * rng.choice([-1, 1], 3)), *map(float, rng.uniform(14, 30, 3) * rng.choice([-1, 1], 3)), float(rng.uniform(-6, 6))) for k in range(84)]
    return spark.createDataFrame(rows, "i long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, offset double").persist()


def measured(spark, h, seed):
    rng = np.random.default_rng(seed)
    g, s = rng.poisson(h @ rng.uniform(0, 3, h.shape[1])).astype(float), rng.uniform(0, 1, len(h))
    return g, s, spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(g, s, strict=True))], "i long, g double, s double")


@pytest.mark.parametrize("tof", [None, (6.0, 4.0)])
def test_rays_without_a_matrix(spark, lines, tof):
    n = 60
    h = dense(rays.weights(lines, G, tof), 84, n)
    g, s, data = measured(spark, h, 1)
    weight = spark.range(84).selectExpr("id AS i", "1.0 + id % 3 AS weight")
    w = 1.0 + np.arange(84) % 3
    for weights, m in ((None, h), (weight, h * w[:, None])):
        system = systems.Rays(lines, G, tof, weights)
        subsets = systems.by_view(3, 12)  # 7 views of 12 bins
        parts = [np.flatnonzero(np.arange(84) // 12 % 3 == k) for k in range(3)]
        assert [len(p) for p in parts] == [36, 24, 24]
        got = column(solvers.osem(system, data).run(2, subsets), "j", n)
        want = osem(m, g, s, 2, parts)
        assert np.allclose(got, want, rtol=1e-6, atol=1e-9)
        stored = column(solvers.osem(rays.weights(lines, G, tof) if weights is None else rays.weights(lines, G, tof).join(weights, "i").select("i", "j", (F.col("h") * F.col("weight")).alias("h")), data).run(2, subsets), "j", n)
        seen = m.sum(axis=0) > 0
        assert np.allclose(got[seen], stored[seen], rtol=1e-6, atol=1e-9)
        assert np.allclose(column(system.row_sums(), "i", 84), m.sum(axis=1)) and np.allclose(column(system.normalization(), "j", n), m.sum(axis=0))


def test_other_solvers_without_a_matrix(spark, lines):
    h = dense(rays.weights(lines, G), 84, 60)
    g, s, data = measured(spark, h, 2)
    system, matrix = systems.Rays(lines, G), rays.weights(lines, G).persist()
    for make in (lambda x: solvers.bsrem(x, data), lambda x: solvers.rbiem(x, data), lambda x: solvers.sart(x, data)):
        a, b = column(make(system).run(1, 2), "j", 60), column(make(matrix).run(1, 2), "j", 60)
        seen = h.sum(axis=0) > 0
        assert np.allclose(a[seen], b[seen], rtol=1e-6, atol=1e-9)
    step = solvers.osem(system, data)
    iterates = [spark.range(60).selectExpr("id AS j", "1.0D AS value"), *[step.run(1) for _ in range(2)]]
    mask = spark.createDataFrame([(k, 1.0) for k in range(10, 30)], "j long, value double")
    a = solvers.uncertainty(system, data, iterates, mask).first()
    b = solvers.uncertainty(matrix, data, iterates, mask).first()
    assert np.isclose(a["value"], b["value"]) and np.isclose(a["percent"], b["percent"])


N, PLANES = 6, 2


@pytest.fixture(scope="module")
def turns(spark):
    return spect.stencil(spark, [0.0, 37.0, 90.0, 135.0, 201.0, 270.0, 333.0], N).persist()


def turned_matrix(turns, seen=None, views=7):
    h = np.zeros((views, N, N, PLANES, N, N, PLANES))  # a, x, y, z of the turned volume, xi, yi, z of the image
    for r in turns.collect():
        for z in range(PLANES):
            h[r["a"], r["x"], r["y"], z, r["xi"], r["yi"], z] += r["w"] * (1.0 if seen is None else seen[r["a"], r["x"], r["y"], z])
    return h


def probability(spark, views=7):
    seen = np.random.default_rng(3).uniform(0.2, 1, (views, N, N, PLANES))
    rows = [(*map(int, k), float(v)) for k, v in np.ndenumerate(seen) for k in [k]]
    return seen, spark.createDataFrame(rows, "a int, x int, y int, z int, value double")


def test_turned_volumes_by_view(spark, turns):
    seen, table = probability(spark)
    h = turned_matrix(turns, seen).sum(axis=1).reshape(7 * N * PLANES, -1)
    g, s, data = measured(spark, h, 4)
    system = systems.Turned(turns, N, PLANES, table)
    assert turns.select("a", "x", "y").distinct().count() == 7 * N * N  # whole grids
    per = N * PLANES
    want = osem(h, g, s, 1, [np.flatnonzero(np.arange(len(h)) // per % 3 == k) for k in range(3)])
    got = column(solvers.osem(system, data).run(1, systems.by_view(3, per)), "j", N * N * PLANES)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9)
    named = spark.createDataFrame([(v, v % 3) for v in range(7)], "view int, subset int")
    again = column(solvers.osem(system, data).run(1, systems.of_views(named, per)), "j", N * N * PLANES)
    assert np.allclose(again, want, rtol=1e-6, atol=1e-9)


def test_blurred_system_has_its_transpose(spark, turns):
    rng = np.random.default_rng(5)
    system = systems.Turned(turns, N, PLANES, probability(spark)[1], lambda df: spect.depth_blur(df, lambda x: 0.4 + 0.2 * x, 2))
    f, p = rng.uniform(0, 1, N * N * PLANES), rng.uniform(0, 1, 7 * N * PLANES)
    image, data = (spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], f"{key} long, value double") for x, key in ((f, "j"), (p, "i")))
    forward, backward = column(system.forward(image), "i", len(p)), column(system.backward(data), "j", len(f))
    assert np.isclose(forward @ p, f @ backward)
    # rows of the blur, by hand
    turned = np.einsum("axyzijk,ijk->axyz", turned_matrix(turns, probability(spark)[0]), f.reshape(N, N, PLANES))
    want = np.zeros((7, N, PLANES))
    for x in range(N):
        k = np.exp(-np.arange(-2, 3) ** 2 / (2 * (0.4 + 0.2 * x) ** 2))
        for z in range(PLANES):
            want[:, :, z] += np.array([np.convolve(turned[a, x, :, z], k / k.sum(), "same") for a in range(7)])
    assert np.allclose(forward, want.ravel())


def test_matrix_of_turned_volumes_in_a_mask(spark, turns):
    seen, table = probability(spark)
    mask = spark.createDataFrame([(j,) for j in range(0, N * N * PLANES, 3)], "j long")
    h = turned_matrix(turns, seen).sum(axis=1).reshape(7 * N * PLANES, -1)
    assert np.allclose(dense(systems.Turned(turns, N, PLANES, table).matrix(), *h.shape), h)
    h[:, np.arange(h.shape[1]) % 3 != 0] = 0
    assert np.allclose(dense(systems.Turned(turns, N, PLANES, table).matrix(mask), *h.shape), h)


def test_operator_on_planes_and_its_transpose(spark):
    rng = np.random.default_rng(13)
    kernel, v = rng.uniform(0, 1, (3, 3)), rng.uniform(0, 1, (2, 3, 5, 4))

    def convolved(k):
        def run(plane, x):
            wide = np.pad(plane, 1)
            return sum(k[a, b] * (1 + x) * wide[a : a + plane.shape[0], b : b + plane.shape[1]] for a in range(3) for b in range(3))

        return run

    rows = spark.createDataFrame([(*map(int, at), float(x)) for at, x in np.ndenumerate(v)], "a int, x int, y int, z int, value double")
    for k in (kernel, kernel[::-1, ::-1]):
        got = np.zeros(v.shape)
        for r in spect.plane_operator(rows, convolved(k), (5, 4)).collect():
            got[r["a"], r["x"], r["y"], r["z"]] = r["value"]
        assert np.allclose(got, [[convolved(k)(v[a, x], x) for x in range(3)] for a in range(2)])
    w = rng.uniform(0, 1, (5, 4))
    assert np.isclose((convolved(kernel)(v[0, 1], 1) * w).sum(), (v[0, 1] * convolved(kernel[::-1, ::-1])(w, 1)).sum())


def test_sinogram_system_of_events(spark):
    from radonframe.operators import events, pet
    from radonframe.plans.fixtures import SCANNER

    rng = np.random.default_rng(14)
    own = Grid((3, 3, 2), (12.0, 12.0, 10.0))
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, SCANNER.per_ring * SCANNER.rings, (300, 2)) if a % SCANNER.per_ring != b % SCANNER.per_ring]
    system, data = pet.sinogram_of_events(spark.createDataFrame(pairs, "detector_1 int, detector_2 int"), SCANNER, own)
    rows = sorted((r["i"], r["g"]) for r in data.collect())
    assert len(rows) == SCANNER.per_ring * (SCANNER.per_ring - 1) // 2 * SCANNER.rings**2 + SCANNER.per_ring * SCANNER.rings**2 or sum(g for _, g in rows) == len(pairs)
    assert sum(g for _, g in rows) == len(pairs)
    number = {i: k for k, (i, _) in enumerate(rows)}
    h = np.zeros((len(rows), 18))
    for r in rays.weights(system.lines, own).collect():
        h[number[r["i"]], r["j"]] = r["h"]
    g = np.array([x for _, x in rows])
    per = (SCANNER.per_ring + 1) * SCANNER.rings**2
    parts = [np.array([i // per % 2 == m for i, _ in rows]) for m in range(2)]
    got = column(solvers.osem(system, data).run(1, pet.angle_subsets(SCANNER, 2)), "j", 18)
    assert np.allclose(got, osem(h, g, np.zeros(len(g)), 1, parts), rtol=1e-6, atol=1e-9)
    assert events.histogram(spark.createDataFrame(pairs, "detector_1 int, detector_2 int"), SCANNER).count() == (g > 0).sum()


def test_transforms_of_images(spark, lines):
    k = spark.createDataFrame([(j, l, 0.5 if j == l else 0.25) for j in range(60) for l in (j - 1, j, j + 1) if 0 <= l < 60], "j long, l long, w double")
    dense_k = np.zeros((60, 60))
    for r in k.collect():
        dense_k[r["j"], r["l"]] = r["w"]
    h = dense(rays.weights(lines, G), 84, 60) @ dense_k
    g, s, data = measured(spark, h, 6)
    double = systems.Transform(*[lambda p: p.withColumn("value", F.col("value") * 2)] * 2)
    system = systems.Transformed(systems.Rays(lines, G), [systems.image_operator(k)], [double])
    got = column(solvers.osem(system, data).run(1, 2), "j", 60)
    assert np.allclose(got, osem(2 * h, g, s, 1, [np.arange(84) % 2 == m for m in range(2)]), rtol=1e-6, atol=1e-9)


def test_saved_matrix_reads_one_subset_without_a_shuffle(spark, lines, tmp_path):
    h = rays.weights(lines, G)
    subsets, folder = systems.by_view(3, 12), f"file://{tmp_path}/h"
    saved = systems.save(h, "h_of_rays", folder, subsets, 4)
    m = dense(h, 84, 60)
    g, s, data = measured(spark, m, 7)
    want = osem(m, g, s, 1, [np.flatnonzero(np.arange(84) // 12 % 3 == k) for k in range(3)])
    seen = m.sum(axis=0) > 0
    assert np.allclose(column(solvers.osem(saved, data).run(1, subsets), "j", 60)[seen], want[seen], rtol=1e-6, atol=1e-9)
    own = saved.part(subsets, 1)
    ratio = data.filter("i % 2 = 0").select("i", F.col("g").alias("value")).hint("merge")
    executed = own.backward(ratio)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in executed.splitlines() if "FileScan" in line)
    assert "(m#" in scan[scan.index("PartitionFilters") : scan.index("PushedFilters")] and "SelectedBucketsCount" in scan
    # one exchange of the projections by i and one of the sums by j; none of the matrix
    assert executed.count("Exchange hashpartitioning(i") == 1 and executed.count("Exchange hashpartitioning") == 2
    spark.sql("DROP TABLE h_of_rays")
    again = systems.opened(spark, "h_of_rays", folder, subsets, 4)
    assert np.allclose(dense(again.h, 84, 60), m)
    with pytest.raises(ValueError):
        again.part(systems.by_view(2, 12), 0)
    spark.sql("DROP TABLE h_of_rays")


FRAMES = [(0, 40.0, 0.0, 1.0, 5.0), (1, 10.0, 1.25, 2.0, 4.0), (2, 40.0, -0.5, 0.5, 5.5), (3, 100.0, 2.0, 1.0, 4.5), (4, 10.0, -3.75, 1.5, 4.0)]


@pytest.mark.parametrize("blurred", [False, True])
def test_heads_with_offsets(spark, blurred):
    frames = spark.createDataFrame(FRAMES, "a int, angle double, offset double, time double, radius double")
    numbered = heads.turns_of(frames)
    assert sorted(map(tuple, numbered.collect())) == [(0, 10.0), (1, 40.0), (2, 100.0)]
    frames = frames.join(numbered, "angle").select("a", "turn", "offset", "time", "radius").persist()
    turns = spect.stencil(spark, [10.0, 40.0, 100.0], N)
    seen, table = probability(spark, 3)
    blur = heads.distance_blur(frames, lambda d: 0.2 + 0.1 * d, N, 0.5, 2) if blurred else None
    system = heads.Heads(turns, N, PLANES, table, blur, frames=frames, width=4)
    turned = turned_matrix(turns, seen, 3)
    h = np.zeros((5, 4, PLANES, N * N * PLANES))
    for a, angle, offset, time, radius in FRAMES:
        volume = turned[[10.0, 40.0, 100.0].index(angle)].reshape(N, N, PLANES, -1)
        if blurred:
            out = np.zeros_like(volume)
            for x in range(N):
                k = np.exp(-np.arange(-2, 3) ** 2 / (2 * (0.2 + 0.1 * max(radius - (x - (N - 1) / 2) * 0.5, 0)) ** 2))
                by_y = sum(np.pad(volume[x], ((2, 2), (0, 0), (0, 0)))[o : o + N] * v for o, v in enumerate(k / k.sum()))
                out[x] = sum(np.pad(by_y, ((0, 0), (2, 2), (0, 0)))[:, o : o + PLANES] * v for o, v in enumerate(k / k.sum()))
            volume = out
        line = volume.sum(axis=0)
        for y in range(N):
            for to in (int(np.floor(y + offset)), int(np.floor(y + offset)) + 1):
                if 0 <= to < N and 0 <= to - 1 < 4:
                    h[a, to - 1] += line[y] * (1 - abs(y + offset - to)) * time
    h = h.reshape(5 * 4 * PLANES, -1)
    f, p = np.random.default_rng(8).uniform(0, 1, h.shape[1]), np.random.default_rng(9).uniform(0, 1, h.shape[0])
    image, data = (spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], f"{key} long, value double") for x, key in ((f, "j"), (p, "i")))
    assert np.allclose(column(system.forward(image), "i", len(p)), h @ f)
    assert np.allclose(column(system.backward(data), "j", len(f)), h.T @ p)
    views = spark.createDataFrame([(a, angle) for a, angle, *_ in FRAMES], "view int, angle double")
    named = systems.subsets_by_angle(views, 2)
    assert sorted(map(tuple, named.collect())) == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 0)]
    if not blurred:
        g, s, counted = measured(spark, h, 10)
        got = column(solvers.osem(system, counted).run(1, systems.of_views(named, 4 * PLANES)), "j", h.shape[1])
        by = np.array([1, 0, 1, 0, 0])[np.arange(len(h)) // (4 * PLANES)]
        assert np.allclose(got, osem(h, g, s, 1, [np.flatnonzero(by == m) for m in range(2)]), rtol=1e-6, atol=1e-9)


SIZE = (2, 2, 8)


@pytest.fixture(scope="module")
def scan(spark):
    """Three beds of 8 planes: matrices, data, and places at 0, 5 and 10."""
    rng = np.random.default_rng(11)
    hs = [np.where(rng.uniform(0, 1, (20 + 4 * b, 32)) < 0.4, rng.uniform(0, 2, (20 + 4 * b, 32)), 0) for b in range(3)]
    data = [measured(spark, h, 12 + b) for b, h in enumerate(hs)]
    h = spark.createDataFrame([(b, int(i), int(j), float(v)) for b, m in enumerate(hs) for (i, j), v in np.ndenumerate(m) if v], "bed int, i long, j long, h double").persist()
    d = spark.createDataFrame([(b, i, float(x), float(y)) for b, (g, s, _) in enumerate(data) for i, (x, y) in enumerate(zip(g, s, strict=True))], "bed int, i long, g double, s double").persist()
    offsets = spark.createDataFrame([(0, 0, 0), (1, 1, 5), (2, 2, 10)], "bed int, place int, offset int")
    return hs, data, h, d, offsets


def test_beds_equal_beds_by_themselves(spark, scan):
    hs, data, h, d, offsets = scan
    solver = beds.solver(solvers.osem, h, d)
    image = solver.run(2, beds.subsets_of(2))
    alone = [osem(m, g, s, 2, [np.arange(len(m)) % 2 == k for k in range(2)]) for m, (g, s, _) in zip(hs, data, strict=True)]
    for r in beds.parted(image, "j").collect():
        assert np.isclose(r["value"], alone[r["bed"]][r["j"]], rtol=1e-6, atol=1e-9)
    rows = [(b, *map(int, np.unravel_index(j, SIZE)), float(v)) for b, f in enumerate(alone) for j, v in enumerate(f)]
    want = counts.stitch(spark.createDataFrame(rows, "bed int, x int, y int, z int, value double"), offsets, SIZE[2])
    key = lambda r: (r["x"], r["y"], r["z"])
    a, b = sorted(beds.stitched(image, offsets, SIZE).collect(), key=key), sorted(want.collect(), key=key)
    assert list(map(key, a)) == list(map(key, b)) and np.allclose([r["value"] for r in a], [r["value"] for r in b], rtol=1e-6, atol=1e-9)
    # shares and peaks are each bed's own
    for make in (solvers.rbiem, solvers.bsrem):
        together = {(r["bed"], r["j"]): r["value"] for r in beds.parted(beds.solver(make, h, d).run(1, beds.subsets_of(3)), "j").collect()}
        for k in range(3):
            single = make(h.filter(F.col("bed") == k).drop("bed"), d.filter(F.col("bed") == k).drop("bed")).run(1, 3)
            for r in single.collect():
                assert np.isclose(together[k, r["j"]], r["value"], rtol=1e-9)
    # a system for each bed
    each = [systems.Stored(h.filter(F.col("bed") == k).drop("bed")) for k in range(3)]
    again = {r["j"]: r["value"] for r in beds.solver(solvers.osem, each, d).run(1, beds.subsets_of(2)).collect()}
    one = {r["j"]: r["value"] for r in beds.solver(solvers.osem, h, d).run(1, beds.subsets_of(2)).collect()}
    assert again.keys() == one.keys() and all(np.isclose(again[k], v, rtol=1e-9) for k, v in one.items())


def test_uncertainty_of_stitched_beds(spark, scan):
    hs, data, h, d, offsets = scan
    solver, iterates = beds.solver(solvers.osem, h, d), []
    iterates = [beds.joined(h.select("bed", "j").distinct(), "j").withColumn("value", F.lit(1.0)), *[solver.run(1) for _ in range(2)]]
    mask = spark.createDataFrame([(x, y, z, 1.0) for x in range(2) for y in range(2) for z in range(4, 12)], "x int, y int, z int, value double")
    got = beds.uncertainty(h, d, iterates, mask, offsets, SIZE).first()
    variance, total = 0.0, 0.0
    weights = {r["bed"]: {} for r in offsets.collect()}
    planes = spark.createDataFrame([(b, z) for b in range(3) for z in range(8)], "bed int, z int")
    for r in counts.stitch_weights(planes, offsets, 8).collect():
        weights[r["bed"]][r["z"]] = r["weight"] if 4 <= r["plane"] < 12 else 0.0
    for k in range(3):
        own = [beds.parted(x, "j").filter(F.col("bed") == k).drop("bed") for x in iterates]
        rows = [(int(j), weights[k][int(np.unravel_index(j, SIZE)[2])]) for j in range(32)]
        part = spark.createDataFrame([r for r in rows if r[1]], "j long, value double")
        variance += solvers.uncertainty(h.filter(F.col("bed") == k).drop("bed"), d.filter(F.col("bed") == k).drop("bed"), own, part).first()["value"] ** 2
        last = {r["j"]: r["value"] for r in own[-1].collect()}
        total += sum(w * last.get(j, 0.0) for j, w in rows)
    assert np.isclose(got["value"], np.sqrt(variance)) and np.isclose(got["percent"], 100 * np.sqrt(variance) / total)
