"""Volumes in space: affines from voxels to mm, NIfTI files, and alignment of one grid to another.

An affine is four rows of four numbers; those of slices come from a table with one row for each slice.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import physics
from ..operators import curves, grid
from . import ranges
from .imaging import header_value, read_header, read_raw, slice_thickness
from .imaging import slices as slices_of

Affine = list[list[float]]
_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}  # codes of the format


def centred(shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> Affine:
    """The affine of a grid whose middle is the origin; negative spacings run the other way."""
    return [[float(spacing[a]) if a == b else 0.0 for b in range(3)] + [-(shape[a] - 1) / 2 * spacing[a]] for a in range(3)] + [[0.0, 0.0, 0.0, 1.0]]


def of_slices(slices: DataFrame) -> Affine:
    """The affine of slices (z_pos, position array, spacing array, orientation array of six, table_height where the position is above a table)."""
    first = slices.orderBy("z_pos").select("position", "spacing", "orientation", *(["table_height"] if "table_height" in slices.columns else [])).first()
    where = slice_thickness(slices).first()
    along, down = np.array(first["orientation"][:3]), np.array(first["orientation"][3:])
    columns = np.stack([first["spacing"][0] * along, first["spacing"][1] * down, where["thickness"] * np.cross(along, down)], axis=1)
    y = first["position"][1] - (first["table_height"] or 0.0 if "table_height" in slices.columns else 0.0)
    return [[*map(float, r), float(o)] for r, o in zip(columns, (first["position"][0], y, where["lowest"]), strict=True)] + [[0.0, 0.0, 0.0, 1.0]]


def of_file(position: tuple[float, float, float], spacing: tuple[float, float, float]) -> Affine:
    """The affine of a volume in one file."""
    return [[float(spacing[a]) if a == b else 0.0 for b in range(3)] + [float(position[a])] for a in range(3)] + [[0.0, 0.0, 0.0, 1.0]]


def of_projections(position: tuple[float, float, float], rows: int, dx: float, dz: float, table_height: float = 0.0, centred_y: bool = False) -> Affine:
    """The affine of the object of an emission scan. A position of 0 down is the middle of a square above a table; centred_y: the middle in any case."""
    x, y, z = position
    if y == 0:
        x, y = x - (rows - 1) / 2 * dx, y - (rows - 1) / 2 * dx - table_height
    elif centred_y:
        y = -(rows - 1) / 2 * dx
    return of_file((x, y, z - (rows - 1) * dz), (dx, dx, dz))


def between(source: Affine, target: Affine) -> Affine:
    """From voxels of the target to voxels of the source: three rows."""
    return (np.linalg.inv(np.array(source)) @ np.array(target))[:3].tolist()


def aligned(volume: DataFrame, source: Affine, target: Affine, shape: tuple[int, int, int], outside: float = 0.0) -> DataFrame:
    """(x, y, z, value): a volume in the grid of another, trilinear."""
    return grid.resample(volume.select("x", "y", "z", "value"), [], shape, between(source, target), outside)


def aligned_mask(volume: DataFrame, label: float, source: Affine, target: Affine, shape: tuple[int, int, int], cutoff: float = 0.5) -> DataFrame:
    """(x, y, z): the voxels of another grid that a labelled region covers by more than the cutoff."""
    region = volume.withColumn("value", F.when(F.col("value") == label, 1.0).otherwise(0.0))
    return aligned(region, source, target, shape).filter(F.col("value") > cutoff).select("x", "y", "z")


def attenuation_of_slices(
    spark: SparkSession, slices: DataFrame, target: Affine, shape: tuple[int, int, int], energy: float, peak_kv: float, materials: DataFrame, centred_spacing: tuple[float, float, float] | None = None, outside: float = 0.0,
) -> DataFrame:
    """(x, y, z, value): the attenuation in 1/cm of CT slices in the grid of an emission scan, in one call.

    slices: (z_pos, slope, intercept, pixels, position, spacing, orientation[, table_height]); the CT numbers go through the conversion of their own
    bone peak (``curves.conversion``) and are resampled. centred_spacing: the slices' spacing in the unit of ``target`` where both grids share their
    middle, as scans with several heads do; their planes then run the other way.
    """
    volume = slices_of(spark, slices)
    c = curves.conversion(volume, peak_kv, energy, materials)
    mu = volume.withColumn("value", physics.bilinear_mu(F.col("value"), F.lit(c.a1), F.lit(c.a2), F.lit(c.b1), F.lit(c.b2)))
    if centred_spacing is None:
        return aligned(mu, of_slices(slices), target, shape, outside)
    n = volume.agg(*[(F.max(a) + 1).alias(a) for a in "xyz"]).first()
    out = aligned(mu, centred((n["x"], n["y"], n["z"]), centred_spacing), target, shape, outside)
    return out.withColumn("z", (F.lit(shape[2] - 1) - F.col("z")).cast("int"))


def nifti_header(spark: SparkSession, path: str) -> dict:
    """Shape, spacing, kind of numbers, where they start, and their slope and intercept: 348 bytes."""
    where = spark.read.format("binaryFile").load(path).select("path").first()["path"]
    with ranges.open_input(where) as f:
        raw = f.read(348)
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(f"{end}i", raw[:4])[0] != 348:
        raise ValueError(f"{path} is not a NIfTI file")
    dims, spacing = struct.unpack(f"{end}8h", raw[40:56]), struct.unpack(f"{end}8f", raw[76:108])
    start, slope, intercept = struct.unpack(f"{end}3f", raw[108:120])
    return {"shape": dims[1:4], "spacing": spacing[1:4], "dtype": end + _KINDS[struct.unpack(f"{end}h", raw[70:72])[0]], "start": int(start), "slope": slope or 1.0, "intercept": intercept}


def read_nifti(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, value) of an uncompressed NIfTI file, x fastest."""
    h = nifti_header(spark, path)
    nx, ny, nz = h["shape"]
    planes = ranges.read_planes(spark, path, ny, nx, h["dtype"], skip=h["start"]).filter(F.col("plane") < nz)
    return planes.select(F.col("column").alias("x"), F.col("row").alias("y"), F.col("plane").alias("z"), (F.col("value") * h["slope"] + h["intercept"]).alias("value"))


def attenuation_of_nifti(spark: SparkSession, path: str, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    """(x, y, z, value) in 1/mm of a map in 1/cm with the same middle as a grid; its x and y run the other way."""
    h = nifti_header(spark, path)
    dx, dy, dz = h["spacing"]
    out = aligned(read_nifti(spark, path), centred(h["shape"], (-dx, -dy, dz)), centred(shape, spacing), shape)
    return out.withColumn("value", F.col("value") / 10)


def attenuation_of_interfile(spark: SparkSession, header: str, data: str, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> DataFrame:
    """(x, y, z, value) in 1/mm of a raw map in 1/cm with the same middle as a grid, by its text header."""
    facts = read_header(spark, header)
    number = lambda key, kind: header_value(facts, key, kind).first()["values"][0]
    own = tuple(number(rf"matrix size \[{k}\]", "int") for k in (1, 2, 3))
    steps = tuple(number(rf"scaling factor \(mm/pixel\) \[{k}\]", "double") for k in (1, 2, 3))
    return aligned(read_raw(spark, data, own), centred(own, steps), centred(shape, spacing), shape).withColumn("value", F.col("value") / 10)
