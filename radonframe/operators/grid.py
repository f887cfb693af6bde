"""Operators on dense grids: tables with key columns, x, y, z and value.

Neighbourhood operators work on lines: a window along one axis, or a line gathered into an array as long as the grid is wide. A
3 x 3 x 3 neighbourhood is three windows within slabs, one per axis, that carry arrays of 3, 9 and 27 values, rather than a join with 26 offsets.
Grids are dense; a missing voxel is not taken for zero.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
SLAB = 16  # planes of x that a task has together
OFFSETS = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


def _others(axis: str) -> list[str]:
    return [a for a in AXES if a != axis]


def reverse_cumulative(df: DataFrame, keys: Sequence[str], axis: str = "x") -> DataFrame:
    """value: the sum from each voxel to the end of its line, half of the voxel itself."""
    w = Window.partitionBy(*keys, *_others(axis)).orderBy(axis).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("value", F.sum("value").over(w) - F.col("value") / 2)


def detection_probability(mu: DataFrame, keys: Sequence[str], step: float) -> DataFrame:
    """value: exp(-integral of attenuation from each voxel to the detector at the end of its x line)."""
    return reverse_cumulative(mu.withColumn("value", F.col("value") * step), keys).withColumn("value", F.exp(-F.col("value")))


def neighbourhood(df: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """``df`` with near: the 27 values around each voxel, x slowest, the edge's own value beyond the edge.

    Planes are dealt to tasks in slabs of ``SLAB`` with the plane on either side, once: the three windows sort within slabs and shuffle nothing.
    """
    own = lambda x: F.floor(x / SLAB).cast("int")
    slabs = F.array_distinct(F.array(own(F.col("x") - 1), own(F.col("x")), own(F.col("x") + 1)))
    out = df.withColumn("_slab", F.explode(slabs)).repartition(*keys, "_slab").withColumn("near", F.array(column))
    for axis in reversed(AXES):
        w = Window.partitionBy(*keys, "_slab", *_others(axis)).orderBy(axis)
        before, after = F.coalesce(F.lag("near").over(w), F.col("near")), F.coalesce(F.lead("near").over(w), F.col("near"))
        out = out.withColumn("near", F.concat(before, "near", after))
    return out.filter(own(F.col("x")) == F.col("_slab")).drop("_slab")


def near_value(offset: tuple[int, int, int], near: str = "near") -> Column:
    i, j, k = offset
    return F.col(near)[(i + 1) * 9 + (j + 1) * 3 + k + 1]


def shifted(df: DataFrame, keys: Sequence[str], offset: tuple[int, int, int]) -> DataFrame:
    """value: that of the neighbour at an offset of -1, 0 or 1 along each axis."""
    return neighbourhood(df, keys).select(*keys, *AXES, near_value(offset).alias("value"))


def euclidean_weight(offset: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> float:
    return spacing[0] / math.sqrt(sum((d * o) ** 2 for d, o in zip(spacing, offset, strict=True)))


def quadratic(delta: float = 1.0) -> dict[str, Callable[[Column, Column], Column]]:
    return {"phi0": lambda r, s: (r - s) * (r - s) / (4 * delta * delta), "phi1": lambda r, s: (r - s) / delta}


def log_cosh(delta: float = 1.0) -> dict[str, Callable[[Column, Column], Column]]:
    return {"phi0": lambda r, s: F.log(F.cosh((r - s) / delta)), "phi1": lambda r, s: F.tanh((r - s) / delta)}


def relative_difference(gamma: float = 1.0, delta: float = 1e-11) -> dict[str, Callable[[Column, Column], Column]]:
    q = lambda r, s: r + s + gamma * F.abs(r - s) + delta
    return {
        "phi0": lambda r, s: (r - s) * (r - s) / q(r, s),
        "phi1": lambda r, s: (r - s) * (gamma * F.abs(r - s) + 3 * s + r + 2 * delta) / (q(r, s) * q(r, s)),
        "phi2_1": lambda r, s: 2 * (2 * s + delta) * (2 * s + delta) / (q(r, s) * q(r, s) * q(r, s)),
        "phi2_2": lambda r, s: -2 * (2 * r + delta) * (2 * s + delta) / (q(r, s) * q(r, s) * q(r, s)),
    }


def prior(df: DataFrame, keys: Sequence[str], phi: Callable[[Column, Column], Column], beta: float = 1.0, weight: Callable[[tuple[int, int, int]], float] = euclidean_weight) -> DataFrame:
    """value: beta times the weighted sum over the 26 neighbours of phi(voxel, neighbour)."""
    terms = [phi(F.col("value"), near_value(o)) * weight(o) for o in OFFSETS]
    return neighbourhood(df, keys).select(*keys, *AXES, (beta * sum(terms[1:], terms[0])).alias("value"))


def anatomy_prior(df: DataFrame, anatomy: DataFrame, keys: Sequence[str], phi: Callable[[Column, Column], Column], similarity: Callable[[Column, Column], Column], beta: float = 1.0) -> DataFrame:
    """As ``prior``, each weight times the similarity of the voxels' anatomy."""
    seen = neighbourhood(anatomy, keys).select(*keys, *AXES, F.col("value").alias("a"), F.col("near").alias("a_near"))
    both = neighbourhood(df, keys).join(seen, [*keys, *AXES])
    terms = [phi(F.col("value"), near_value(o)) * similarity(F.col("a"), near_value(o, "a_near")) * euclidean_weight(o) for o in OFFSETS]
    return both.select(*keys, *AXES, (beta * sum(terms[1:], terms[0])).alias("value"))


def _ranked(column: str = "near") -> Column:
    """Offset numbers (0 to 25) from the most similar neighbour to the least, ties by number."""
    parts = [F.struct(F.abs(F.col("value") - near_value(o, column)).alias("d"), F.lit(k).alias("k")) for k, o in enumerate(OFFSETS)]
    return F.transform(F.sort_array(F.array(*parts)), lambda p: p["k"])


def top_neighbours(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, x, y, z, rank, offset, neighbour): the n neighbours with the most similar values."""
    order = F.slice(_ranked(), 1, n)
    values = F.array(*[near_value(o) for o in OFFSETS])
    ranked = neighbourhood(df, keys).withColumn("values", values).select(*keys, *AXES, "values", F.posexplode(order).alias("rank", "offset"))
    return ranked.select(*keys, *AXES, "rank", "offset", F.element_at("values", F.col("offset") + 1).alias("neighbour"))


def kernel_matrix(df: DataFrame, keys: Sequence[str], n: int | None, scale: float, width: float) -> DataFrame:
    """(keys, x, y, z, i, j, k, w): kernel weights of a voxel to the voxels at its offsets, rows summing to 1.

    exp(-(difference / scale)^2 / 2) * exp(-(distance / width)^2 / 2), of the n most similar neighbours and the voxel itself.
    """
    own = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), F.lit(1.0).alias("w"))
    parts = []
    for number, o in enumerate(OFFSETS):
        d = (F.col("value") - near_value(o)) / scale
        w = F.exp(-d * d / 2) * math.exp(-sum(x * x for x in o) / (2 * width * width))
        if n:
            w = F.when(F.array_contains("top", number), w).otherwise(0.0)
        parts.append(F.struct(*[F.lit(v).alias(c) for v, c in zip(o, "ijk", strict=True)], w.alias("w")))
    near = neighbourhood(df, keys)
    near = near.withColumn("top", F.slice(_ranked(), 1, n)) if n else near
    rows = near.withColumn("parts", F.array(own, *parts)).withColumn("total", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"]))
    out = rows.select(*keys, *AXES, "total", F.explode("parts").alias("p")).filter("p.w > 0")
    return out.select(*keys, *AXES, "p.i", "p.j", "p.k", (F.col("p.w") / F.col("total")).alias("w"))


def gaussian_kernel(sigma: float, half: int | None = None) -> list[float]:
    """Normalised weights of offsets -half to half; half is 3 sigma unless given."""
    half = max(1, math.ceil(3 * sigma)) if half is None else half
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def lines(df: DataFrame, keys: Sequence[str], axis: str, axes: Sequence[str] = AXES, value: str = "value") -> DataFrame:
    """One row per line along an axis, line: its values in order."""
    rest = [a for a in axes if a != axis]
    gathered = F.sort_array(F.collect_list(F.struct(axis, value)))
    return df.groupBy(*keys, *rest).agg(F.transform(gathered, lambda p: p[value]).alias("line"))


def unlines(df: DataFrame, keys: Sequence[str], axis: str, axes: Sequence[str] = AXES, value: str = "value") -> DataFrame:
    rest = [a for a in axes if a != axis]
    return df.select(*keys, *rest, F.posexplode("line").alias(axis, value)).select(*keys, *axes, value)


def convolve(df: DataFrame, keys: Sequence[str], axis: str, kernel: Sequence[float], edge: str = "zero", axes: Sequence[str] = AXES) -> DataFrame:
    """value: the kernel's sum along an axis; beyond the edge there is zero, the edge's value (nearest), or the other end (circular)."""
    half, weights = len(kernel) // 2, list(kernel)

    def at(line: Column, p: Column) -> Column:
        n = F.size(line)
        if edge == "circular":
            return line[F.pmod(p, n)]
        if edge == "nearest":
            return line[F.least(F.greatest(p, F.lit(0)), n - 1)]
        return F.when((p < 0) | (p >= n), 0.0).otherwise(line[F.least(F.greatest(p, F.lit(0)), n - 1)])

    done = F.transform("line", lambda v, k: sum((at(F.col("line"), k + (o - half)) * w for o, w in enumerate(weights)), F.lit(0.0)))
    return unlines(lines(df, keys, axis, axes).withColumn("line", done), keys, axis, axes)


def gaussian_filter(df: DataFrame, keys: Sequence[str], sigmas: dict[str, float], edge: str = "zero") -> DataFrame:
    """Separable Gaussian blur along each axis with a positive sigma (in voxels)."""
    for axis, sigma in sigmas.items():
        if sigma > 0:
            df = convolve(df, keys, axis, gaussian_kernel(sigma), edge)
    return df


def pad(df: DataFrame, keys: Sequence[str], axis: str, by: int, edge: str = "zero", axes: Sequence[str] = AXES) -> DataFrame:
    """The grid with ``by`` more voxels at both ends of an axis, of zeros or the edge's value (nearest)."""
    line = F.col("line")
    first, last = (F.lit(0.0), F.lit(0.0)) if edge == "zero" else (line[0], F.element_at(line, -1))
    return unlines(lines(df, keys, axis, axes).withColumn("line", F.concat(F.array_repeat(first, by), line, F.array_repeat(last, by))), keys, axis, axes)


def crop(df: DataFrame, axis: str, by: int, size: int) -> DataFrame:
    """The grid without ``by`` voxels at both ends of an axis of ``size`` voxels."""
    return df.filter((F.col(axis) >= by) & (F.col(axis) < size - by)).withColumn(axis, F.col(axis) - by)


def pad_size(width: int) -> int:
    """Voxels to add at both ends so that a rotated square fits."""
    return math.ceil((math.sqrt(2) * width - width) / 2)


def resample(df: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], affine: Sequence[Sequence[float]], outside: float = 0.0) -> DataFrame:
    """The grid of ``shape`` whose voxel p has the trilinear value of ``df`` at affine * (p, 1); voxels without support have ``outside``.

    Input voxels are looked up by the eight corners of each output voxel: a join on (keys, corner), then one sum.
    """
    targets = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for axis, n in zip(AXES, shape, strict=True):
        targets = targets.withColumn(f"o{axis}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for axis, row in zip(AXES, affine, strict=True):
        targets = targets.withColumn(f"p{axis}", sum((F.col(f"o{a}") * float(v) for a, v in zip(AXES, row, strict=False)), F.lit(float(row[3]))))
    corners = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, c, strict=True)]) for c in itertools.product((0, 1), repeat=3)])
    at = targets.withColumn("c", F.explode(corners))
    weight = F.lit(1.0)
    for a in AXES:
        share = F.col(f"p{a}") - F.floor(f"p{a}")
        weight = weight * F.when(F.col(f"c.d{a}") == 1, share).otherwise(1 - share)
        at = at.withColumn(a, (F.floor(f"p{a}") + F.col(f"c.d{a}")).cast("int"))
    hit = at.withColumn("w", weight).filter("w > 0").join(df, [*keys, *AXES], "left")
    ends = [F.col(f"o{a}").alias(a) for a in AXES]
    return hit.groupBy(*keys, *[f"o{a}" for a in AXES]).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(outside))).alias("value")).select(*keys, *ends, "value")


def rotation(angle_deg: float, size: int) -> list[list[float]]:
    """Affine of an in-plane rotation about the centre of a size x size grid."""
    c, s, m = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg)), (size - 1) / 2
    return [[c, s, 0, m - c * m - s * m], [-s, c, 0, m + s * m - c * m], [0, 0, 1, 0]]


def rotate(df: DataFrame, keys: Sequence[str], angle_deg: float, shape: tuple[int, int, int]) -> DataFrame:
    return resample(df, keys, shape, rotation(angle_deg, shape[0]))


def shift(df: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], by: tuple[float, float, float]) -> DataFrame:
    """The grid moved by a number of voxels along each axis, linearly interpolated."""
    return resample(df, keys, shape, [[float(a == b) for b in range(3)] + [-by[a]] for a in range(3)])


def _displaced(keys: Sequence[str], field: DataFrame) -> DataFrame:
    """(keys, ox, oy, oz, x, y, z, w): the weights of the voxels around each voxel plus its displacement."""
    corners = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, c, strict=True)]) for c in itertools.product((0, 1), repeat=3)])
    at = field.select(*keys, *[F.col(a).alias(f"o{a}") for a in AXES], *[(F.col(a) + F.col(f"d{a}")).alias(f"p{a}") for a in AXES]).withColumn("c", F.explode(corners))
    weight = F.lit(1.0)
    for a in AXES:
        share = F.col(f"p{a}") - F.floor(f"p{a}")
        weight = weight * F.when(F.col(f"c.d{a}") == 1, share).otherwise(1 - share)
        at = at.withColumn(a, (F.floor(f"p{a}") + F.col(f"c.d{a}")).cast("int"))
    return at.withColumn("w", weight)


def displace(df: DataFrame, keys: Sequence[str], field: DataFrame) -> DataFrame:
    """The grid sampled at each voxel plus its displacement (keys, x, y, z, dx, dy, dz), trilinear, zero outside."""
    hit = _displaced(keys, field).join(df, [*keys, *AXES], "left")
    out = hit.groupBy(*keys, *[f"o{a}" for a in AXES]).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))
    return out.select(*keys, *[F.col(f"o{a}").alias(a) for a in AXES], "value")


def displace_back(df: DataFrame, keys: Sequence[str], field: DataFrame) -> DataFrame:
    """The transpose of ``displace``: each voxel's value goes to the voxels that it was sampled from. The grid's voxels are those of the field."""
    source = df.select(*keys, *[F.col(a).alias(f"o{a}") for a in AXES], "value")
    out = _displaced(keys, field).join(source, [*keys, *[f"o{a}" for a in AXES]]).groupBy(*keys, *AXES).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return field.select(*keys, *AXES).join(out, [*keys, *AXES], "left").fillna(0.0, ["value"])


def centre_of_mass(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.sum("value")
    return df.groupBy(*keys).agg(*[(F.sum(F.col("value") * F.col(a)) / total).alias(f"c{a}") for a in AXES])


def shift_to_middle(df: DataFrame, keys: Sequence[str], shape: tuple[int, int, int]) -> DataFrame:
    """(keys, sx, sy, sz): from the centre of mass to half the grid's size."""
    return centre_of_mass(df, keys).select(*keys, *[(F.lit(n / 2) - F.col(f"c{a}")).alias(f"s{a}") for a, n in zip(AXES, shape, strict=True)])


def best_line_angle(df: DataFrame, keys: Sequence[str], angles_deg: Sequence[int], shape: tuple[int, int]) -> DataFrame:
    """(keys, angle): the line through the middle voxel (n // 2) with the least sum of distances of the voxels that are not zero, ties by the smaller angle.

    Rows (x) go down and columns (y) to the right, as in an image.
    """
    row, column = F.col("x") - shape[0] // 2, F.col("y") - shape[1] // 2
    sums = [F.sum(F.when(F.col("value") != 0, F.abs(column * math.sin(math.radians(a)) - row * math.cos(math.radians(a)))).otherwise(0.0)).alias(f"d{k}") for k, a in enumerate(angles_deg)]
    options = F.array(*[F.struct(F.round(F.col(f"d{k}"), 9).alias("d"), F.lit(a).alias("angle")) for k, a in enumerate(angles_deg)])
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array_min(options)["angle"].alias("angle"))


def ball_masks(df: DataFrame, size: int, radius: float) -> DataFrame:
    """value, 0 outside of the discs of a radius about the grid's middle voxel (n // 2) in each of the three planes."""
    m = size // 2
    inside = lambda a, b: (F.col(a) - m) * (F.col(a) - m) + (F.col(b) - m) * (F.col(b) - m) <= radius * radius
    return df.withColumn("value", F.when(inside("x", "y") & inside("x", "z") & inside("y", "z"), F.col("value")).otherwise(0.0))


def between_shares(df: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """The voxels with values strictly between shares of the grid's largest."""
    top = F.max("value").over(Window.partitionBy(*keys))
    return df.withColumn("_top", top).filter((F.col("value") > low * F.col("_top")) & (F.col("value") < high * F.col("_top"))).drop("_top")


def block_mean(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The mean over blocks of n x n x n voxels."""
    return df.groupBy(*keys, *[F.floor(F.col(a) / n).cast("int").alias(a) for a in AXES]).agg(F.avg("value").alias("value"))
