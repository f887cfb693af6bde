"""SPECT projection by rotating and summing: for each angle the object is rotated to the detector, weighted and blurred by depth, and summed along x."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid

Stencil = DataFrame


def stencil(spark, angles_deg: Sequence[float], n: int) -> Stencil:
    """(a, x, y, xi, yi, w): rotated voxel (x, y) of each angle as a bilinear sum of voxels (xi, yi). As many rows as 4 n^2 per angle at most; each
    rotated voxel has one at least, of weight 0 where nothing is turned to it, so that turned volumes are whole grids."""
    out = spark.range(n).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = out.withColumn("angle", F.explode(F.array(*[F.struct(F.lit(k).alias("a"), F.lit(float(v)).alias("deg")) for k, v in enumerate(angles_deg)])))
    m, phi = (n - 1) / 2, F.radians("angle.deg")
    out = out.withColumns({"p": F.cos(phi) * (F.col("x") - m) + F.sin(phi) * (F.col("y") - m) + m, "q": -F.sin(phi) * (F.col("x") - m) + F.cos(phi) * (F.col("y") - m) + m})
    rows = out.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    share = lambda c, d: F.when(d == 1, F.col(c) - F.floor(c)).otherwise(1 - F.col(c) + F.floor(c))
    rows = rows.select(F.col("angle.a").alias("a"), "x", "y", (F.floor("p") + F.col("c.i")).cast("int").alias("xi"), (F.floor("q") + F.col("c.j")).cast("int").alias("yi"), (share("p", F.col("c.i")) * share("q", F.col("c.j"))).alias("w"), (F.col("c.i") + F.col("c.j") == 0).alias("first"))
    inside = F.col("xi").between(0, n - 1) & F.col("yi").between(0, n - 1)
    edge = {c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)) for c in ("xi", "yi")}
    rows = rows.withColumn("w", F.when(inside, F.col("w")).otherwise(0.0)).withColumns(edge)
    return rows.filter((F.col("w") > 1e-12) | F.col("first")).drop("first")


def rotated(image: DataFrame, turns: Stencil) -> DataFrame:
    """(a, x, y, z, value): the image at each angle."""
    source = image.select(F.col("x").alias("xi"), F.col("y").alias("yi"), "z", "value")
    return turns.join(source, ["xi", "yi"]).groupBy("a", "x", "y", "z").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def depth_blur(df: DataFrame, sigma: Callable[[Column], Column], half: int, axis: str = "y", shape: str = "gaussian", keys: Sequence[str] = ("a",)) -> DataFrame:
    """(keys, x, y, z, value) blurred along an axis with a width in voxels that depends on x, and on keys if it names them: weights sum to 1 over the kernel, and zeros lie beyond the edge.

    shape: "gaussian" of that standard deviation, or "square", the triangle of square holes that is 0 from that width on.
    """
    s = sigma(F.col("x"))
    if shape == "gaussian":
        weights = [F.when(s > 0, F.exp(-F.lit(float(o * o)) / (2 * s * s))).otherwise(1.0 if o == 0 else 0.0) for o in range(-half, half + 1)]
    elif shape == "square":
        weights = [F.greatest(1 - F.when(s > 0, abs(o) / s).otherwise(0.0 if o == 0 else 1.0), F.lit(0.0)) for o in range(-half, half + 1)]
    else:
        raise ValueError(f"{shape!r} is neither gaussian nor square")
    total = sum(weights[1:], weights[0])
    rows = grid.lines(df, keys, axis).withColumn("ws", F.transform(F.array(*weights), lambda w: w / total))
    n = F.size("line")
    at = lambda p: F.when((p < 0) | (p >= n), 0.0).otherwise(F.col("line")[F.least(F.greatest(p, F.lit(0)), n - 1)])
    done = F.transform("line", lambda v, k: sum((at(k + o) * F.col("ws")[o + half] for o in range(-half, half + 1)), F.lit(0.0)))
    return grid.unlines(rows.withColumn("line", done), keys, axis)


def plane_blur(df: DataFrame, sigma: Callable[[Column], Column], spacing: tuple[float, float], half: tuple[int, int], shape: str = "gaussian") -> DataFrame:
    """Blurred along y and then z, by a width in cm that depends on x; spacing: of voxels along y and z in cm."""
    for axis, d, h in zip("yz", spacing, half, strict=True):
        df = depth_blur(df, lambda x, d=d: sigma(x) / d, h, axis, shape)
    return df


def plane_operator(df: DataFrame, operator: Callable[[np.ndarray, int], np.ndarray], shape: tuple[int, int], keys: Sequence[str] = ("a",)) -> DataFrame:
    """(keys, x, y, z, value) with each plane of one depth x, an array of ``shape`` over y and z, replaced by operator(plane, x), which is linear.

    A response that no product of two lines gives, say of a collimator with hexagonal holes, is blurred by its own two-dimensional convolution;
    the transposed system takes the transposed operator. A plane is a task's group, as large as the detector; missing voxels count as 0.
    """
    ny, nz = shape

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros(shape)
        plane[frame["y"], frame["z"]] = frame["value"]
        out = np.asarray(operator(plane, int(frame["x"].iloc[0])), float)
        if out.shape != shape:
            raise ValueError(f"the operator gave {out.shape} for {shape}")
        y, z = np.divmod(np.arange(ny * nz, dtype=np.int32), nz)
        return pd.DataFrame({**{k: frame[k].iloc[0] for k in (*keys, "x")}, "y": y, "z": z, "value": out.ravel()})

    rows = df.select(*keys, *[F.col(c).cast("int").alias(c) for c in "xyz"], F.col("value").cast("double").alias("value"))
    return rows.groupBy(*keys, "x").applyInPandas(run, rows.schema)


def kernel_half(sigma_cm: float, spacing: float, deviations: float = 3.0) -> int:
    """Offsets to each side that a kernel needs for the widest response."""
    return math.ceil(sigma_cm / spacing * deviations)


def distance(n: int, radius: float, spacing: float) -> Callable[[Column], Column]:
    """Distance in cm of a plane x of n from a detector at a radius on the +x side; never negative."""
    return lambda x: F.greatest(F.lit(radius) - (x - (n - 1) / 2) * spacing, F.lit(0.0))


def cut_off(projections: DataFrame, mask: DataFrame) -> DataFrame:
    """(a, r, z, value), 0 outside of the mask's pixels (r, z). It is its own transpose."""
    inside = mask.select("r", "z").distinct().withColumn("inside", F.lit(True))
    return projections.join(inside, ["r", "z"], "left").select("a", "r", "z", F.when(F.col("inside"), F.col("value")).otherwise(0.0).alias("value"))


def forward(image: DataFrame, turns: Stencil, probability: DataFrame | None = None, blur: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, r, z, value). probability: (a, x, y, z, value), that a photon from a voxel is detected at an angle."""
    rows = rotated(image, turns)
    if probability is not None:
        rows = rows.join(probability.withColumnRenamed("value", "seen"), ["a", "x", "y", "z"]).withColumn("value", F.col("value") * F.col("seen")).drop("seen")
    if blur:
        rows = blur(rows)
    return rows.groupBy("a", F.col("y").alias("r"), "z").agg(F.sum("value").alias("value"))


def backward(projections: DataFrame, turns: Stencil, n: int, probability: DataFrame | None = None, blur: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(x, y, z, value): projections smeared along x, transformed in reverse, and rotated back by the transposed stencil."""
    rows = projections.select("a", F.col("r").alias("y"), "z", "value").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if blur:
        rows = blur(rows)
    if probability is not None:
        rows = rows.join(probability.withColumnRenamed("value", "seen"), ["a", "x", "y", "z"]).withColumn("value", F.col("value") * F.col("seen")).drop("seen")
    back = rows.join(turns, ["a", "x", "y"]).groupBy("xi", "yi", "z").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return back.select(F.col("xi").alias("x"), F.col("yi").alias("y"), "z", "value")


def attenuation(mu: DataFrame, turns: Stencil, step: float) -> DataFrame:
    """(a, x, y, z, value): detection probability of each voxel at each angle."""
    return grid.detection_probability(rotated(mu, turns), ["a"], step)


def average_probability(mu: DataFrame, turns: Stencil, step: float, angles: int) -> DataFrame:
    """(x, y, z, value): detection probability of each voxel, turned back from each angle and averaged over them."""
    back = attenuation(mu, turns, step).join(turns, ["a", "x", "y"]).groupBy("xi", "yi", "z").agg((F.sum(F.col("w") * F.col("value")) / angles).alias("value"))
    return back.select(F.col("xi").alias("x"), F.col("yi").alias("y"), "z", "value")
