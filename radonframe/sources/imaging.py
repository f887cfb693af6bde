"""Readers of text headers, raw volumes, CT views, scanner, collimator and material tables, and writers of raw volumes.

Raw files are read in ranges of planes; text comes through ``read.text``.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.physics import TimeBins
from .ranges import read_planes

DTYPES = {"float32": "<f4", "float64": "<f8", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint8": "u1"}


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, key, value) of ``key := value`` lines."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return header_lines(rows)


def header_lines(lines: DataFrame, sign: str = ":=") -> DataFrame:
    """Lines (.., value) with key and value in place of value, those that have the sign between them."""
    parts = lines.withColumn("p", F.split("value", sign, 2)).filter(F.size("p") == 2)
    rest = [c for c in lines.columns if c != "value"]
    return parts.select(*rest, F.lower(F.trim(F.regexp_replace(F.col("p")[0], r"^[!;\s]+", ""))).alias("key"), F.trim(F.col("p")[1]).alias("value"))


def header_value(header: DataFrame, key: str, kind: str = "double") -> DataFrame:
    """(file, values): all values of the keys that match a pattern, cast, in the order of lines; an absent key has no row."""
    value = F.struct("line", F.col("value").cast(kind).alias("v"))
    return header.filter(F.col("key").rlike(key)).groupBy("file").agg(F.sort_array(F.collect_list(value))["v"].alias("values"))


def view_angles(start: float, extent: float, n: int, clockwise: bool) -> Column:
    """Array of the angles of n views in [0, 360)."""
    k = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(k, lambda i: F.pmod((-(start + extent * i / n)) if clockwise else (start + extent * i / n), F.lit(360.0)))


def read_raw(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "float32", flip: tuple[bool, bool, bool] = (False, False, False)) -> DataFrame:
    """(file, x, y, z, value) of raw volumes stored with z slowest and x fastest, read plane by plane; flip: axes to reverse."""
    if dtype not in DTYPES:
        raise ValueError(f"{dtype!r} is not one of {', '.join(DTYPES)}")
    planes = read_planes(spark, path, shape[1], shape[0], DTYPES[dtype]).filter(F.col("plane") < shape[2])
    ends = {c: (F.lit(n - 1) - F.col(of) if f else F.col(of)).cast("int").alias(c) for c, of, n, f in zip("xyz", ("column", "row", "plane"), shape, flip, strict=True)}
    return planes.select("file", *ends.values(), "value")


def write_raw(volume: DataFrame, folder: str, shape: tuple[int, int, int], scale: Column | None = None) -> DataFrame:
    """Write (x, y, z, value) as 32-bit planes, one file per z; (z, file). A plane is one task's group, as large as the grid's x and y."""
    nx, ny, _ = shape
    rows = volume.select("x", "y", "z", (F.col("value") * (F.lit(1.0) if scale is None else scale)).alias("value"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((ny, nx), "<f4")
        plane[frame["y"], frame["x"]] = frame["value"]
        system, where = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(where)
        name = f"{where}/{int(frame['z'].iloc[0]):05d}-{uuid.uuid4().hex}.raw"
        with system.open_output_stream(name) as f:
            f.write(plane.tobytes())
        return pd.DataFrame({"z": [int(frame["z"].iloc[0])], "file": [name]})

    return rows.groupBy("z").applyInPandas(run, "z int, file string")


def to_uint16(volume: DataFrame, largest: float | None = None) -> DataFrame:
    """Values scaled to 0 .. 65535 by the largest and rounded half to even, with the slope that undoes it."""
    top = volume.agg(F.max("value").alias("top")) if largest is None else volume.sparkSession.range(1).select(F.lit(float(largest)).alias("top"))
    one = F.broadcast(top)  # one row
    return volume.join(one).withColumn("slope", F.col("top") / 65535).withColumn("stored", F.bround(F.col("value") / F.col("slope")).cast("int")).drop("top")


def slices(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(x, y, z, value) of slices (z_pos, slope, intercept, pixels array of rows): rescaled, numbered by position.

    Positions alone are ranked, one number for each slice, and joined to the pixels. Slices without a position have no place and are left out;
    slices at one position share their number.
    """
    places = rows.select("z_pos").filter("z_pos is not null").distinct()
    ranked = places.withColumn("z", (F.row_number().over(Window.orderBy("z_pos")) - 1).cast("int"))
    numbered = rows.join(F.broadcast(ranked), "z_pos")
    lines = numbered.select("z", F.coalesce("slope", F.lit(1.0)).alias("slope"), F.coalesce("intercept", F.lit(0.0)).alias("intercept"), F.posexplode("pixels").alias("y", "row"))
    return lines.select("slope", "intercept", "y", "z", F.posexplode("row").alias("x", "p")).select("x", "y", "z", (F.col("p") * F.col("slope") + F.col("intercept")).alias("value"))


def slice_thickness(rows: DataFrame) -> DataFrame:
    """One row (lowest, highest, thickness) of slice positions z_pos; the thickness is the first step."""
    low = rows.select("z_pos").distinct().orderBy("z_pos").limit(2)  # two rows
    return rows.agg(F.min("z_pos").alias("lowest"), F.max("z_pos").alias("highest")).join(F.broadcast(low.agg((F.max("z_pos") - F.min("z_pos")).alias("thickness"))))


def attenuation_scale(inverse: Column, factor: Column) -> Column:
    """Scale of a vendor's map: one over the first tag, else the second, else 1."""
    return F.coalesce(1 / inverse, factor, F.lit(1.0))


def camera_geometry(frames: DataFrame, nearest: float = 1.0) -> DataFrame:
    """Frames (angle, x, y) with theta, the angle rounded half to even to a step, and the radius and lateral offset of the detector, of the angle itself."""
    t = F.radians("angle")
    return frames.withColumns({"theta": F.bround(F.col("angle") / nearest) * nearest, "radius": F.col("x") * F.sin(t) + F.col("y") * F.cos(t), "offset": F.col("x") * F.cos(t) - F.col("y") * F.sin(t)})


def head_frames(frames: DataFrame, window: int, spacing: float, nearest: float = 1.0) -> DataFrame:
    """(a, file, frame, angle, offset, time, radius) of the frames of one energy window of a scan with several heads, for ``heads.Heads``.

    frames: (file, frame, window, angle, x, y, time), places in mm and times in ms; spacing: of pixels in mm. Frames are numbered by file and place
    in it, which one window over rows without pixels does. Angles are rounded to a step, offsets are in pixels, times in s, radii in cm.
    """
    own = camera_geometry(frames.filter(F.col("window") == window), nearest)
    number = (F.row_number().over(Window.orderBy("file", "frame")) - 1).cast("int")
    return own.select(number.alias("a"), "file", "frame", F.col("theta").alias("angle"), (F.col("offset") / spacing).alias("offset"), (F.col("time") / 1e3).alias("time"), (F.col("radius") / 10).alias("radius"))


def head_projections(pixels: DataFrame, numbered: DataFrame) -> DataFrame:
    """(a, r, z, value) of frames (file, frame, scale, pixels array of rows) that ``head_frames`` has numbered: columns are r and rows z, counts times the file's scale."""
    named = pixels.join(F.broadcast(numbered.select("file", "frame", "a")), ["file", "frame"])  # one row for each frame
    rows = named.select("a", "scale", F.posexplode("pixels").alias("z", "row"))
    return rows.select("a", "scale", "z", F.posexplode("row").alias("r", "p")).select("a", "r", "z", (F.col("p") * F.col("scale")).alias("value"))


def view_geometry(raw: bytes) -> list[float]:
    """Little-endian 32-bit floats of a CT view's tags."""
    return list(struct.unpack(f"<{len(raw) // 4}f", raw[: len(raw) // 4 * 4]))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated table with a header whose names have spaces around them, as scanner and conversion tables come."""
    return spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=True)


def scanner_info(table: DataFrame, name: str) -> DataFrame:
    """The row of a scanner with crystals per ring and rings."""
    return table.filter(F.col("scanner_name") == name).withColumns({
        "per_ring": F.col("crystalTransNr") * F.col("submoduleTransNr") * F.col("moduleTransNr") * F.col("rsectorTransNr"),
        "rings": F.col("crystalAxialNr") * F.col("submoduleAxialNr") * F.col("moduleAxialNr") * F.col("rsectorAxialNr"),
    })


def time_bins(table: DataFrame, name: str) -> TimeBins:
    """The time bins of a scanner: one row."""
    r = table.filter(F.col("scanner_name") == name).select("num_tof_bins", "tof_range", "tof_fwhm").first()
    return TimeBins(int(r["num_tof_bins"]), float(r["tof_range"]), float(r["tof_fwhm"]))


def read_collimators(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(code, diameter, septa, length) of the records (lines that start with ``*``) whose code has a text."""
    rows = spark.read.text(path).filter(F.startswith("value", F.lit("*"))).select(F.split(F.trim(F.regexp_replace("value", r"^\*\s*", "")), r"\s+").alias("p"))
    return rows.filter(F.contains(F.col("p")[0], F.lit(name))).select(F.col("p")[0].alias("code"), *[F.col("p")[k].cast("double").alias(c) for k, c in ((1, "diameter"), (2, "septa"), (3, "length"))])


def read_material(spark: SparkSession, path: str) -> DataFrame:
    """(file, energy in keV, mu in 1/cm) between 50 and 550 keV, of a density on the first line and rows of MeV, mu / rho."""
    rows = spark.read.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    density = F.split(F.trim(F.col("lines")[0]), r"\s+")
    each = rows.select("file", F.element_at(density, 1).cast("double").alias("rho"), F.posexplode("lines").alias("at", "line")).filter("at > 0")
    parts = each.withColumn("p", F.split(F.trim("line"), r"[\s,]+")).filter(F.size("p") >= 3)
    n = F.size("p")
    return parts.select("file", (F.col("p")[n - 3].cast("double") * 1000).alias("energy"), (F.col("p")[n - 2].cast("double") * F.col("rho")).alias("mu")).filter("energy > 50 and energy < 550")
