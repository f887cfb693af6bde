"""Single scatter simulation for PET: sampled scatter points, sampled detector pairs, and the scale of the estimate.

The integrals from every point to every sampled crystal are a table, one row for each such ray. They go to the pairs in blocks of crystals, so
that what is shuffled grows with crystals times points and not with pairs times points. ``estimate`` is the whole way from an image to
the scaled scatter in all bins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..functions import physics, special
from . import algebra, events, pet, rays, systems
from .events import Scanner
from .rays import Grid, project

ENDS = ("x", "y", "z")
BLOCK = 64  # crystals
MAX_NODES = 8192  # of a plane's interpolation: a task holds the square of it


def scatter_points(attenuation: DataFrame, step: int = 4, cutoff: float = 0.004) -> DataFrame:
    """The voxels (x, y, z, value) on a strided lattice with more than the cutoff's attenuation."""
    on = (F.pmod("x", F.lit(step)) == 0) & (F.pmod("y", F.lit(step)) == 0) & (F.pmod("z", F.lit(step)) == 0)
    return attenuation.filter(on & (F.col("value") > cutoff))


def sample_detectors(ids: DataFrame, per_ring: int, rings: int, between_rings: int = 4, within_ring: int = 4) -> DataFrame:
    """Every ``within_ring``-th crystal of every ``between_rings``-th ring, the last ring always among them."""
    ring, place = F.floor(F.col("detector_id") / per_ring), F.pmod("detector_id", F.lit(per_ring))
    return ids.filter((F.pmod(place, F.lit(within_ring)) == 0) & ((F.pmod(ring, F.lit(between_rings)) == 0) | (ring == rings - 1)))


def _numbered(points: DataFrame, grid: Grid) -> DataFrame:
    """(s, mu, sx, sy, sz): the points in mm, numbered by their voxel."""
    nx, ny, nz = grid.shape
    at = [((F.col(c) - (n - 1) / 2) * d).alias(f"s{c}") for c, n, d in zip(ENDS, grid.shape, grid.spacing, strict=True)]
    return points.select(((F.col("x") * ny + F.col("y")) * nz + F.col("z")).cast("long").alias("s"), F.col("value").alias("mu"), *at)


def _rays(points: DataFrame, crystals: DataFrame, share: tuple[int, int] | None = None) -> DataFrame:
    """Rays from every point to every crystal, i = s * 2^20 + detector_id; share: (k, n), the k-th of n equal parts of each."""
    every = points.join(crystals.select("detector_id", *ENDS), F.lit(True))  # the table of rays is the product of both samples
    lo, hi = (0.0, 1.0) if share is None else (share[0] / share[1], (share[0] + 1) / share[1])
    on = lambda c, t: F.col(f"s{c}") + (F.col(c) - F.col(f"s{c}")) * t
    return every.select("s", "detector_id", (F.col("s") * (1 << 20) + F.col("detector_id")).alias("i"), *[on(c, t).alias(f"{c}{k}") for k, t in ((1, lo), (2, hi)) for c in ENDS])


def _legs(rows: pa.Table, parts: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Crystals in order, and by name an array of them by the points: where both are, what passes, and the emission (with a further axis for its parts)."""
    order = np.lexsort((rows.column("s").to_numpy(), rows.column("detector_id").to_numpy()))
    ids = rows.column("detector_id").to_numpy()[order]
    crystals = np.unique(ids)
    out = {c: rows.column(c).to_numpy()[order].reshape(len(crystals), -1) for c in (*ENDS, "pass", "mu", "sx", "sy", "sz")}
    emission = rows.column("emission").combine_chunks().flatten().to_numpy().reshape(-1, parts)[order]
    return crystals, out | {"emission": emission.reshape(len(crystals), -1, parts)}


def _pair_scatter(volume: float, resolution: float, threshold: float, tof: tuple[list[float], float, int] | None):
    """(i, tof, value) of the pairs of two groups of crystals, over all points at once."""
    whole, parts = special.compton_total(physics.ELECTRON_KEV), 1 if tof is None else tof[2]

    def seen(far: list[np.ndarray], k: int, emission: np.ndarray) -> np.ndarray:
        """By time bin: the emission integral's parts times the shares of the bins that see them."""
        centres, sigma, n = tof
        middles = (np.arange(n) + 0.5) / n * far[k][..., None]
        offsets = (-1 if k == 0 else 1) * ((far[1] - far[0])[..., None] / 2 + np.array(centres))
        raw = np.exp(-((offsets[..., :, None] - middles[..., None, :]) ** 2) / (2 * sigma**2))
        total = raw.sum(axis=-2, keepdims=True)
        return (np.divide(raw, total, out=np.zeros_like(raw), where=total > 0) * emission[..., None, :]).sum(axis=-1)

    def run(pairs: pa.Table, legs: pa.Table) -> pa.Table:
        i, ends = pairs.column("i").to_numpy(), [pairs.column(f"detector_{k}").to_numpy() for k in (1, 2)]
        side = legs.column("side").to_numpy()
        tables = [_legs(legs.filter(pa.array(side == k)), parts) for k in (0, 1)] if len(i) and len(side) else []
        out: dict[str, list] = {"i": [], "tof": [], "value": []}
        at = [np.searchsorted(crystals, e) for (crystals, _), e in zip(tables, ends, strict=False)]
        points = tables[0][1]["mu"].shape[1] if tables else 1
        bins = 1 if tof is None else len(tof[0])
        step = max(1, (1 << 18) // (points * parts * bins))
        for lo in range(0, len(i), step):
            one, two = ({c: v[x[lo : lo + step]] for c, v in t[1].items()} for t, x in zip(tables, at, strict=True))
            leg = [np.stack([t[c] - one[f"s{c}"] for c in ENDS]) for t in (one, two)]
            far = [np.sqrt((x * x).sum(axis=0)) for x in leg]
            cos = -(leg[0] * leg[1]).sum(axis=0) / (far[0] * far[1])  # of the angle by which the photon turns
            energy = special.energy_after_scatter(cos)
            more = special.compton_total(energy) / whole - 1
            face = 1.0
            for t, x, d in zip((one, two), leg, far, strict=True):  # cosine of the incidence on a crystal of a ring
                face = face * (x[0] * t["x"] + x[1] * t["y"]) / (d * np.hypot(t["x"], t["y"]))
            factor = face * volume / (far[0] * far[1]) ** 2 * one["pass"] * two["pass"] * one["mu"]
            factor *= special.compton_differential(cos) / whole * special.detector_efficiency(energy, resolution, threshold)
            # the photon that scatters passes its leg with less energy than the factor takes
            slower = [t["pass"] ** more for t in (one, two)]
            if tof is None:
                each = (factor * (one["emission"][..., 0] * slower[1] + two["emission"][..., 0] * slower[0]))[..., None]
            else:
                each = factor[..., None] * (seen(far, 0, one["emission"]) * slower[1][..., None] + seen(far, 1, two["emission"]) * slower[0][..., None])
            out["i"].append(np.repeat(i[lo : lo + step], bins))
            out["tof"].append(np.tile(np.arange(bins, dtype=np.int32), len(each)))
            out["value"].append(each.mean(axis=1).ravel())
        return pa.table({"i": pa.array(np.concatenate([[], *out["i"]]).astype(np.int64)), "tof": pa.array(np.concatenate([[], *out["tof"]]).astype(np.int32)), "value": pa.array(np.concatenate([[], *out["value"]]).astype(float))})

    return run


def single_scatter(
    pairs: DataFrame, lut: DataFrame, points: DataFrame, activity: DataFrame, attenuation: DataFrame, grid: Grid,
    resolution: float = 0.15, threshold: float = 430.0, tof: tuple[list[float], float, int] | None = None, block: int = BLOCK,
) -> DataFrame:
    """(i[, tof], value): mean over the points of the single-scatter probability of each pair (i, detector_1, detector_2).

    lut: (detector_id, x, y, z) of the sampled crystals; points: (x, y, z, value) in voxels; activity, attenuation: (j, value).
    tof: (centres of the time bins in mm, sigma in mm, parts that each ray's emission integral is cut into). Pairs of one ``block`` of crystals
    with another are a task's group: a crystal's integrals go to it once, whatever the number of pairs.
    """
    numbered = _numbered(points, grid)
    mu_rays = project(_rays(numbered, lut), attenuation, grid).select("i", F.exp(-F.col("value")).alias("pass"))
    if tof is None:
        emission = project(_rays(numbered, lut), activity, grid).select("i", F.array("value").alias("emission"))
    else:
        parts = [project(_rays(numbered, lut, (k, tof[2])), activity, grid).select("i", F.lit(k).alias("k"), "value") for k in range(tof[2])]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        emission = every.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", "value")))["value"].alias("emission"))
    every = numbered.join(lut.select("detector_id", *ENDS), F.lit(True)).withColumn("i", F.col("s") * (1 << 20) + F.col("detector_id"))  # points x crystals
    legs = kept(every.join(mu_rays, "i").join(emission, "i").drop("i"), "detector_id")
    blocks = max(1, -(-lut.count() // block))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.select("i", "detector_1", "detector_2", of("detector_1").alias("one"), of("detector_2").alias("two"))
    met = kept(dealt.select("one", "two").distinct(), "one")
    sides = [legs.withColumn("block", of("detector_id")).join(met.withColumnRenamed(name, "block"), "block").withColumnRenamed("block", name).withColumn("side", F.lit(k)) for k, name in enumerate(("one", "two"))]
    both = sides[0].unionByName(sides[1]).select(F.col("one").alias("b1"), F.col("two").alias("b2"), "side", "s", "detector_id", "mu", "sx", "sy", "sz", *ENDS, "pass", "emission")
    out = dealt.groupBy("one", "two").cogroup(both.groupBy("b1", "b2")).applyInArrow(_pair_scatter(math.prod(grid.spacing), resolution, threshold, tof), "i long, tof int, value double")
    return out.select("i", "value") if tof is None else out


def _planes(nodes: np.ndarray, cells: np.ndarray):
    """Linear radial functions with a constant through the values of each plane at the nodes, evaluated at all cells."""

    def run(rows: pa.Table) -> pa.Table:
        n = len(nodes)
        away = np.sqrt(((nodes[:, None, :] - nodes[None, :, :]) ** 2).sum(axis=2))
        system = np.block([[-away, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        planes, column = np.unique(rows.column("plane").to_numpy(), return_inverse=True)
        at = {tuple(x): k for k, x in enumerate(nodes.astype(int).tolist())}
        row = np.array([at[x] for x in zip(rows.column("a").to_pylist(), rows.column("r").to_pylist(), strict=True)])
        values = np.zeros((n + 1, len(planes)))
        values[row, column] = rows.column("value").to_numpy()
        weights = np.linalg.solve(system, values)
        out = []
        for lo in range(0, len(cells), 2048):
            some = cells[lo : lo + 2048]
            out.append(-np.sqrt(((some[:, None, :] - nodes[None, :, :]) ** 2).sum(axis=2)) @ weights[:n] + weights[n])
        value = np.concatenate(out)
        cell = np.repeat(cells.astype(np.int32), len(planes), axis=0)
        return pa.table({"a": cell[:, 0], "r": cell[:, 1], "plane": np.tile(planes, len(cells)), "value": value.ravel()})

    return run


def interpolated(sparse: DataFrame, scanner: Scanner, sampled: DataFrame) -> DataFrame:
    """(a, r, p[, tof], value) of all bins of a scanner, from values (a, r, p[, tof], value) at pairs of ``sampled`` crystals (detector_id).

    First each plane of two sampled rings: radial functions -|x| and a constant through its sampled cells, whose weights are solved for in the task
    that evaluates them; then between the sampled rings, bilinear in the places of both. Sampled cells without a value count as 0. The cells of
    a ring and its sampled ones come from the scanner alone; a task's system has as many rows as the sampled ones, ``MAX_NODES`` at most.
    """
    spark, per = sparse.sparkSession, scanner.per_ring
    names = [c for c in ("tof",) if c in sparse.columns]
    least = scanner.min_sector_difference * scanner.module_trans * scanner.crystal_trans
    places = sampled.select(F.pmod("detector_id", F.lit(per)).cast("int").alias("place")).distinct()
    apart = F.abs(F.col("_c1") - F.col("_c2"))
    cells = events.cell_table(spark, scanner).filter((F.col("_c1") > F.col("_c2")) & (apart >= least))
    own = cells.join(places.withColumnRenamed("place", "_c1"), "_c1").join(places.withColumnRenamed("place", "_c2"), "_c2")
    xy = lambda df: np.array(sorted({(r["a"], r["r"]) for r in df.select("a", "r").toLocalIterator()}), float).reshape(-1, 2)  # noqa: E731  of one ring
    nodes, every = xy(own), xy(cells)
    if len(nodes) > MAX_NODES:
        raise ValueError(f"{len(nodes)} sampled cells of a ring: sample fewer crystals than {MAX_NODES} pairs")
    rings = spark.range(scanner.rings).select(F.col("id").cast("int").alias("ring"))
    planes = rings.join(rings.withColumnRenamed("ring", "ring_2"), F.lit(True)).select(events.ring_plane(F.col("ring"), F.col("ring_2"), scanner.rings).alias("p"), F.col("ring").alias("r1"), F.col("ring_2").alias("r2"))  # the planes are the product of the rings
    near = ring_weights(spark, scanner, sampled)
    known = near.select("low").union(near.select("high")).distinct()
    square = known.select(F.col("low").alias("r1")).join(known.select(F.col("low").alias("r2")), F.lit(True))  # of sampled rings
    wanted = square.join(planes, ["r1", "r2"])
    key = F.col("r1").cast("long") * scanner.rings + F.col("r2")
    filled = sparse.join(F.broadcast(wanted), "p")
    key = key if not names else key + F.col("tof").cast("long") * scanner.rings**2
    inside = filled.join(F.broadcast(own.select("a", "r").distinct()), ["a", "r"]).groupBy(key.alias("plane"), "a", "r").agg(F.avg("value").alias("value"))
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dense = inside.groupBy(F.pmod(F.xxhash64("plane"), F.lit(groups))).applyInArrow(_planes(nodes, every), "a int, r int, plane long, value double")
    part = F.pmod("plane", F.lit(scanner.rings**2))
    dense = dense.withColumns({"s1": F.floor(part / scanner.rings).cast("int"), "s2": F.pmod(part, F.lit(scanner.rings)).cast("int"), "tof": F.floor(F.col("plane") / scanner.rings**2).cast("int")})
    shares = near.select("ring", F.explode(F.array(F.struct(F.col("low").alias("at"), (1 - F.col("share")).alias("w")), F.struct(F.col("high").alias("at"), F.col("share").alias("w")))).alias("x")).select("ring", "x.*").filter("w > 0")
    for k in (1, 2):
        dense = dense.join(F.broadcast(shares.select(F.col("at").alias(f"s{k}"), F.col("ring").alias(f"r{k}"), F.col("w").alias(f"w{k}"))), f"s{k}")  # two rows for each ring
    out = dense.groupBy("a", "r", "r1", "r2", *names).agg(F.sum(F.col("value") * F.col("w1") * F.col("w2")).alias("value"))
    return out.select("a", "r", events.ring_plane(F.col("r1"), F.col("r2"), scanner.rings).alias("p"), *names, "value")


def ring_weights(spark: SparkSession, scanner: Scanner, sampled: DataFrame) -> DataFrame:
    """(ring, low, high, share): the sampled rings around each ring and how far it is from the one to the other, by their places along the axis."""
    z = events.scanner_lut(spark, scanner).filter(F.pmod("detector_id", F.lit(scanner.per_ring)) == 0).select(F.floor(F.col("detector_id") / scanner.per_ring).cast("int").alias("ring"), "z")
    own = sampled.select(F.floor(F.col("detector_id") / scanner.per_ring).cast("int").alias("ring")).distinct().join(z, "ring")
    s = F.struct("ring", "z")
    low = z.alias("a").join(own.alias("b"), F.col("b.ring") <= F.col("a.ring")).groupBy("a.ring").agg(F.max(F.struct("b.ring", "b.z")).alias("lo"))
    high = z.alias("a").join(own.alias("b"), F.col("b.ring") >= F.col("a.ring")).groupBy("a.ring").agg(F.min(F.struct("b.ring", "b.z")).alias("hi"))
    rows = z.join(low, "ring").join(high, "ring")
    share = F.when(F.col("hi.ring") > F.col("lo.ring"), (F.col("z") - F.col("lo.z")) / (F.col("hi.z") - F.col("lo.z"))).otherwise(0.0)
    return rows.select("ring", F.col("lo.ring").alias("low"), F.col("hi.ring").alias("high"), share.alias("share"))


def estimate(
    activity: DataFrame, attenuation: DataFrame, measured: DataFrame, scanner: Scanner, grid: Grid, step: int = 4, cutoff: float = 0.004, between_rings: int = 4, within_ring: int = 4,
    resolution: float = 0.15, threshold: float = 430.0, tof: tuple[list[float], float, int] | None = None, randoms: DataFrame | None = None,
) -> DataFrame:
    """(a, r, p[, tof], value): the scatter in all bins, scaled to the measured counts (a, r, p[, tof], value), of an image and an attenuation map (j, value).

    Scatter points and crystals are sampled, single scatter is summed for their pairs, interpolated to all pairs and scaled where lines see
    no more attenuation than the cutoff. Crystals of a ring that are nearer than the scanner's least difference are not paired.
    """
    spark, per = activity.sparkSession, scanner.per_ring
    lut = events.scanner_lut(spark, scanner)
    chosen = kept(sample_detectors(lut, per, scanner.rings, between_rings, within_ring), "detector_id")
    ny, nz = grid.shape[1:]
    j = F.col("j")
    places = attenuation.select(F.floor(j / (ny * nz)).cast("int").alias("x"), F.pmod(F.floor(j / nz), F.lit(ny)).cast("int").alias("y"), F.pmod(j, F.lit(nz)).cast("int").alias("z"), "value")
    least = scanner.min_sector_difference * scanner.module_trans * scanner.crystal_trans
    place = lambda c: F.pmod(c, F.lit(per))
    pairs = events.combinations(chosen).filter(F.abs(place("detector_1") - place("detector_2")) >= max(least, 1)).withColumn("i", F.col("detector_1").cast("long") * (per * scanner.rings) + F.col("detector_2"))
    found = single_scatter(pairs, chosen, scatter_points(places, step, cutoff), activity, attenuation, grid, resolution, threshold, tof)
    named = events.with_cells(found.join(pairs, "i"), scanner, None if tof is None else len(tof[0]))
    keys = ["a", "r", "p", *([] if tof is None else ["tof"])]
    dense = kept(interpolated(named.select(*keys, "value"), scanner, chosen), "a")
    bins = kept(pet.sinogram_rays(dense.select("a", "r", "p").distinct(), scanner).select("i", "a", "r", "p", *rays.ENDS), "i")
    scale = scatter_scale(systems.Rays(bins, grid), *[None if x is None else x.join(bins.select("i", "a", "r", "p"), ["a", "r", "p"]).groupBy("i").agg(F.sum("value").alias("value")) for x in (dense, measured)], attenuation, cutoff,
                          None if randoms is None else randoms.join(bins.select("i", "a", "r", "p"), ["a", "r", "p"]).groupBy("i").agg(F.sum("value").alias("value")))
    return dense.join(F.broadcast(scale.withColumnRenamed("value", "scale"))).select(*keys, (F.col("value") * F.col("scale")).alias("value"))  # one row


def scatter_scale(h: DataFrame | systems.System, scatter: DataFrame, measured: DataFrame, attenuation: DataFrame, cutoff: float = 0.004, randoms: DataFrame | None = None) -> DataFrame:
    """One row, value: the scale of a scatter estimate (i, value) to the measured (i, value) in bins that see nothing denser than the cutoff.

    Both are back projected from those bins over the back projection of ones, less that of the randoms; negative voxels of what is left count
    as zero, and the scale is the least-squares one. h: (i, j, h) or a system; time bins of a bin i are rows of their own.
    """
    body = attenuation.select("j", F.when(F.col("value") > cutoff, 1.0).otherwise(0.0).alias("value"))
    inside = algebra.forward(h, body).filter("value > 0").select("i")
    norm = kept(algebra.normalization(h).withColumnRenamed("value", "norm"), "j")

    def back(rows: DataFrame, name: str) -> DataFrame:
        outside = rows.select("i", "value").join(inside, "i", "left_anti")
        return algebra.backward(h, outside).join(norm, "j").select("j", (F.col("value") / F.col("norm")).alias(name))

    both = back(scatter, "s").join(back(measured, "m"), "j", "full")
    both = both.withColumn("r", F.lit(0.0)) if randoms is None else both.join(back(randoms, "r"), "j", "left")
    left = F.greatest(F.coalesce("m", F.lit(0.0)) - F.coalesce("r", F.lit(0.0)), F.lit(0.0))
    return both.agg((F.sum(F.col("s") * left) / F.sum(F.col("s") * F.col("s"))).alias("value"))
