"""PET systems: the space of sinograms and pairs, sensitivity images, and what listmode reconstruction takes from them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rays
from .events import Scanner, cell_table, histogram, ring_plane, scanner_lut, with_endpoints
from .rays import Grid
from .systems import Rays, Subsets, by_view

DELTA = 1e-11


def cell_space(spark, scanner: Scanner) -> DataFrame:
    """(a, r, x1, y1, x2, y2): the crystals' places of each cell of a sinogram, the larger place in the ring first."""
    ring = scanner_lut(spark, scanner).filter(F.col("detector_id") < scanner.per_ring)
    cells = cell_table(spark, scanner).filter("_c1 >= _c2")
    for k in (1, 2):
        cells = cells.join(ring.select(F.col("detector_id").alias(f"_c{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"_c{k}")
    return cells.select("a", "r", "x1", "y1", "x2", "y2")


def plane_space(spark, scanner: Scanner) -> DataFrame:
    """(p, z1, z2): the rings' places of each plane of a sinogram."""
    rings = scanner_lut(spark, scanner).filter(F.pmod("detector_id", F.lit(scanner.per_ring)) == 0).select(F.floor(F.col("detector_id") / scanner.per_ring).cast("int").alias("ring"), "z")
    first, second = rings.select(F.col("ring").alias("r1"), F.col("z").alias("z1")), rings.select(F.col("ring").alias("r2"), F.col("z").alias("z2"))
    return first.join(second, F.lit(True)).select(ring_plane(F.col("r1"), F.col("r2"), scanner.rings).alias("p"), "z1", "z2")  # the planes are the product of the rings


def sinogram_rays(bins: DataFrame, scanner: Scanner) -> DataFrame:
    """Bins (a, r, p, ..) with i, the bin's number, and the ends of their lines."""
    spark, planes = bins.sparkSession, scanner.rings**2
    i = (F.col("a").cast("long") * (scanner.per_ring + 1) + F.col("r")) * planes + F.col("p")
    return bins.join(cell_space(spark, scanner), ["a", "r"]).join(plane_space(spark, scanner), "p").withColumn("i", i)


def all_bins(spark, scanner: Scanner) -> DataFrame:
    """(a, r, p) of every bin of a scanner: cells of a ring times planes."""
    cells = cell_space(spark, scanner).select("a", "r").distinct()
    return cells.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(scanner.rings**2 - 1))))


def sinogram_system(spark, scanner: Scanner, grid: Grid, weights: DataFrame | None = None) -> tuple[Rays, DataFrame]:
    """The system of all bins of a scanner, and the bins (a, r, p, i); weights: a sinogram (a, r, p, value) of sensitivities, 0 where it has none."""
    lines = sinogram_rays(all_bins(spark, scanner), scanner)
    bins = lines.select("a", "r", "p", "i")
    own = None if weights is None else bins.join(weights, ["a", "r", "p"], "left").select("i", F.coalesce("value", F.lit(0.0)).alias("weight"))
    return Rays(lines.select("i", *rays.ENDS), grid, weights=own), bins


def angle_subsets(scanner: Scanner, count: int) -> Subsets:
    """Every ``count``-th angle of a sinogram is a subset."""
    return by_view(count, (scanner.per_ring + 1) * scanner.rings**2)


def sinogram_of_events(events: DataFrame, scanner: Scanner, grid: Grid, weights: DataFrame | None = None) -> tuple[Rays, DataFrame]:
    """The sinogram system of a listmode scan (detector_1, detector_2), and its counts (i, g, s), s of 0."""
    system, bins = sinogram_system(events.sparkSession, scanner, grid, weights)
    counts = bins.join(histogram(events, scanner), ["a", "r", "p"], "left")
    return system, counts.select("i", F.coalesce("value", F.lit(0.0)).alias("g"), F.lit(0.0).alias("s"))


def pair_rays(pairs: DataFrame, lut: DataFrame) -> DataFrame:
    """Pairs or events (i, detector_1, detector_2, ..) with the ends of their lines."""
    return with_endpoints(pairs, lut)


def survival(lines: DataFrame, attenuation: DataFrame, grid: Grid) -> DataFrame:
    """(i, value): the probability that both photons of a line leave the body."""
    return rays.project(lines, attenuation, grid).withColumn("value", F.exp(-F.col("value")))


def sensitivity(lines: DataFrame, grid: Grid, attenuation: DataFrame | None = None, weights: DataFrame | None = None, delta: float = DELTA) -> DataFrame:
    """(j, value): back projection of all lines (i, ends) of a system, each with its weight (i, weight) and its survival."""
    lines = lines.withColumn("value", F.lit(1.0))
    if weights is not None:
        lines = lines.join(weights.select("i", "weight"), "i").withColumn("value", F.col("weight"))
    if attenuation is not None:
        out = survival(lines, attenuation, grid).withColumnRenamed("value", "out")
        lines = lines.join(out, "i").withColumn("value", F.col("value") * F.col("out"))
    return rays.back_project(lines.withColumn("value", F.col("value") + delta), grid)


def sensitivity_sinogram(norm: DataFrame, scanner: Scanner, grid: Grid, attenuation: DataFrame | None = None) -> DataFrame:
    """(i, a, r, p, value) of a normalisation sinogram (a, r, p, value): times the survival of its bins' lines."""
    lines = sinogram_rays(norm, scanner)
    if attenuation is None:
        return lines.select("i", "a", "r", "p", "value")
    out = survival(lines, attenuation, grid).withColumnRenamed("value", "out")
    return lines.join(out, "i").select("i", "a", "r", "p", (F.col("value") * F.col("out")).alias("value"))


def axial_range(lut: DataFrame, grid: Grid) -> DataFrame:
    """One row (low, high): the voxels along the axis that the crystals reach."""
    middle, d = (grid.shape[2] - 1) / 2, grid.spacing[2]
    return lut.agg((F.min("z") / d + middle).alias("low"), (F.max("z") / d + middle).alias("high"))


def prior_scale(lut: DataFrame, grid: Grid) -> DataFrame:
    """(j, value): 1 in the middle of the crystals along the axis and falling towards the ends of the volume, for a solver's ``fov``."""
    n = math.prod(grid.shape)
    one = axial_range(lut, grid).select(((F.col("low") + F.col("high")) / 2).alias("mid"))
    voxels = lut.sparkSession.range(n).withColumn("z", F.pmod("id", F.lit(grid.shape[2])))
    return voxels.join(F.broadcast(one)).select(F.col("id").alias("j"), F.greatest((F.col("mid") - F.abs(F.col("z") - F.col("mid"))) / F.col("mid"), F.lit(0.0)).alias("value"))  # one row


def initial_image(lut: DataFrame, grid: Grid) -> DataFrame:
    """(j, value): ones where the crystals reach along the axis, zeros beyond."""
    n = math.prod(grid.shape)
    one = axial_range(lut, grid).select(F.ceil(F.greatest("low", F.lit(0.0))).alias("first"), F.floor(F.greatest("high", F.lit(0.0))).alias("end"))
    voxels = lut.sparkSession.range(n).withColumn("z", F.pmod("id", F.lit(grid.shape[2])))
    return voxels.join(F.broadcast(one)).select(F.col("id").alias("j"), F.when((F.col("z") >= F.col("first")) & (F.col("z") < F.col("end")), 1.0).otherwise(0.0).alias("value"))  # one row
