"""Line integrals through voxel grids by Joseph's method, and projectors that fuse them with the sums they feed.

Rays are tables (i, x1, y1, z1, x2, y2, z2) in mm, with time of flight also offset, the centre of their time bin in mm from the line's middle
towards its second end. A batch of rays is stepped at once along its main axis with bilinear interpolation in the other two. The
matrix of a large system is never stored: ``project`` multiplies by an image in the same pass, ``back_project`` sums within each Arrow
batch before the shuffle. An image of up to ``MAX_VOXELS`` voxels is broadcast; a larger one is joined to the rays' weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import erf
from . import algebra

MAX_VOXELS = 1 << 23  # 64 MB
ENDS = ["x1", "y1", "z1", "x2", "y2", "z2"]


@dataclass(frozen=True)
class Grid:
    """Voxels of a volume centred on the origin."""

    shape: tuple[int, int, int]
    spacing: tuple[float, float, float]


def joseph(rays: np.ndarray, grid: Grid, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, voxel, weight) of rays (n, 6): weights in mm. low, high: part of each ray to integrate over, as parameters in [0, 1]."""
    shape, d = np.array(grid.shape), np.array(grid.spacing)
    a, b = rays[:, :3] / d + (shape - 1) / 2, rays[:, 3:] / d + (shape - 1) / 2  # in voxels
    step, out = b - a, []
    length = np.linalg.norm(rays[:, 3:] - rays[:, :3], axis=1)
    main = np.argmax(np.abs(step), axis=1)
    for axis in range(3):
        k = np.flatnonzero((main == axis) & (np.abs(step[:, axis]) > 0))
        if not len(k):
            continue
        plane = np.arange(shape[axis])
        t = (plane[None, :] - a[k, axis, None]) / step[k, axis, None]
        inside = (t >= (0 if low is None else low[k, None])) & (t <= (1 if high is None else high[k, None]))
        per_plane = (length[k] / np.abs(step[k, axis]))[:, None] * inside
        others = [x for x in range(3) if x != axis]
        p = [a[k, o, None] + t * step[k, o, None] for o in others]
        base = [np.floor(x).astype(np.int64) for x in p]
        for du in (0, 1):
            for dv in (0, 1):
                u, v = base[0] + du, base[1] + dv
                w = np.abs(1 - du - (p[0] - base[0])) * np.abs(1 - dv - (p[1] - base[1])) * per_plane
                ok = (w > 0) & (u >= 0) & (u < shape[others[0]]) & (v >= 0) & (v < shape[others[1]])
                place = np.zeros((*u.shape, 3), np.int64)
                place[..., axis], place[..., others[0]], place[..., others[1]] = plane[None, :], u, v
                ray = np.broadcast_to(k[:, None], u.shape)
                voxel = (place[..., 0] * shape[1] + place[..., 1]) * shape[2] + place[..., 2]
                out.append((ray[ok], voxel[ok], w[ok]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate([x[n] for x in out]) for n in range(3))


def tof_shares(t: np.ndarray, length: np.ndarray, bins: np.ndarray, width: float, sigma: float) -> np.ndarray:
    """Share of a point at parameter t of a line that a time bin (centre in mm from the middle) sees: a Gaussian over the bin."""
    z = (t - 0.5) * length - bins
    return 0.5 * (erf((z + width / 2) / (sigma * math.sqrt(2))) - erf((z - width / 2) / (sigma * math.sqrt(2))))


def _kernel(x: pd.DataFrame, grid: Grid, tof: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, voxel, weight) of a frame of rays; tof: (width, sigma) of time bins in mm."""
    ends = x[ENDS].to_numpy(float)
    ray, voxel, w = joseph(ends, grid)
    if tof is not None:
        place = np.stack(np.unravel_index(voxel, grid.shape), axis=1)
        points = (place - (np.array(grid.shape) - 1) / 2) * np.array(grid.spacing)
        step = ends[ray, 3:] - ends[ray, :3]
        length = np.linalg.norm(step, axis=1)
        t = ((points - ends[ray, :3]) * step).sum(axis=1) / length**2
        w = w * tof_shares(t, length, x["offset"].to_numpy(float)[ray], *tof)
    return ray, voxel, w


def _columns(tof: tuple[float, float] | None, *more: str) -> list[str]:
    return ["i", *ENDS, *more, *(["offset"] if tof else [])]


def weights(rays: DataFrame, grid: Grid, tof: tuple[float, float] | None = None) -> DataFrame:
    """(i, j, h): the matrix of the rays, j = (x * ny + y) * nz + z."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            ray, voxel, w = _kernel(x, grid, tof)
            yield pd.DataFrame({"i": x["i"].to_numpy()[ray], "j": voxel, "h": w})

    return rays.select(*_columns(tof)).mapInPandas(run, "i long, j long, h double").groupBy("i", "j").agg(F.sum("h").alias("h"))


def project(rays: DataFrame, image: DataFrame, grid: Grid, tof: tuple[float, float] | None = None) -> DataFrame:
    """(i, value): the integral along each ray of the image (j, value)."""
    n = math.prod(grid.shape)
    if n > MAX_VOXELS:
        seen = algebra.forward(weights(rays, grid, tof), image)
        return rays.select("i").join(seen, "i", "left").fillna(0.0, ["value"])
    rows, f = image.select("j", "value").toArrow(), np.zeros(n)
    f[rows.column("j").to_numpy()] = rows.column("value").to_numpy()
    held = rays.sparkSession.sparkContext.broadcast(f)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            ray, voxel, w = _kernel(x, grid, tof)
            yield pd.DataFrame({"i": x["i"], "value": np.bincount(ray, w * held.value[voxel], len(x))})

    return rays.select(*_columns(tof)).mapInPandas(run, "i long, value double")


def project_tof(rays: DataFrame, image: DataFrame, grid: Grid, width: float, sigma: float) -> DataFrame:
    """(i, value) of rays with time bins."""
    return project(rays, image, grid, (width, sigma))


def back_project(rays: DataFrame, grid: Grid, tof: tuple[float, float] | None = None) -> DataFrame:
    """(j, value) of rays with a column value: sums within a batch, then over batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            ray, voxel, w = _kernel(x, grid, tof)
            j, at = np.unique(voxel, return_inverse=True)
            yield pd.DataFrame({"j": j, "value": np.bincount(at, w * x["value"].to_numpy(float)[ray], len(j))})

    return rays.select(*_columns(tof, "value")).mapInPandas(run, "j long, value double").groupBy("j").agg(F.sum("value").alias("value"))


def cone_beam_rays(spark, angles: int, shape: tuple[int, int], spacing: float, source: float, detector: float) -> DataFrame:
    """Rays of a flat panel: i = (view * columns + column) * rows + row; source and detector distances from the axis."""
    columns, rows = shape
    out = spark.range(angles * columns * rows).withColumnRenamed("id", "i")
    view, col, row = F.floor(F.col("i") / (columns * rows)), F.pmod(F.floor(F.col("i") / rows), F.lit(columns)), F.pmod("i", F.lit(rows))
    phi, u, v = 2 * F.pi() * view / angles, (col - (columns - 1) / 2) * spacing, (row - (rows - 1) / 2) * spacing
    c, s = F.cos(phi), F.sin(phi)
    return out.select("i", (c * source).alias("x1"), (s * source).alias("y1"), F.lit(0.0).alias("z1"), (-c * detector - s * u).alias("x2"), (-s * detector + c * u).alias("y2"), v.alias("z2"))


def arc_rays(views: DataFrame, columns: int, rows: int, source: float, pitch: float, height: float) -> DataFrame:
    """Rays of a third-generation scanner: a curved panel, ``source`` mm from the focal spot, that turns with it.

    views: (view, phi, rho, z, dphi, drho, dz, centre_column, centre_row): the focal spot's place with its shifts, and the panel's central element;
    pitch: angle between columns; height: mm between rows. i = (view * columns + column) * rows + row.
    """
    every = views.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    phi, rho, z = F.col("phi") + F.col("dphi"), F.col("rho") + F.col("drho"), F.col("z") + F.col("dz")
    turn = F.col("phi") + (F.col("column") - F.col("centre_column")) * pitch
    # the panel's middle of curvature is the focal spot without its shifts
    ends = {"x1": rho * F.cos(phi), "y1": rho * F.sin(phi), "z1": z, "x2": F.col("rho") * F.cos("phi") - source * F.cos(turn), "y2": F.col("rho") * F.sin("phi") - source * F.sin(turn), "z2": F.col("z") + (F.col("row") - F.col("centre_row")) * height}
    i = ((F.col("view") * columns + F.col("column")) * rows + F.col("row")).cast("long")
    return every.select(i.alias("i"), *[v.cast("double").alias(k) for k, v in ends.items()])


def ramp_filter(n: int) -> np.ndarray:
    """|FFT| of the band-limited ramp sampled at n points."""
    k = np.concatenate([np.arange(1, n // 2 + 1, 2), np.arange(n // 2 - 1, 0, -2)])
    f = np.zeros(n)
    f[0] = 0.25
    f[1::2] = -1 / (np.pi * k) ** 2
    return 2 * np.real(np.fft.fft(f))


def filter_lines(projections: DataFrame, keys: list[str], axis: str, window=None) -> DataFrame:
    """(keys, axis, value) with each line along an axis ramp filtered; window: a function of the frequency's share of its largest."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(axis)
        v = frame["value"].to_numpy(float)
        n = max(64, 1 << math.ceil(math.log2(2 * len(v))))
        response = ramp_filter(n)
        if window is not None:
            response = response * window(np.abs(np.fft.fftfreq(n)) * 2)
        out = np.real(np.fft.ifft(np.fft.fft(v, n) * response))[: len(v)] * 0.5
        return frame.assign(value=out)

    kind = projections.select(*keys, axis, "value").schema
    return projections.select(*keys, axis, "value").groupBy(*keys).applyInPandas(run, kind)


def fdk_weights(projections: DataFrame, source: float, detector: float, columns: int, rows: int, spacing: float) -> DataFrame:
    """(view, col, row, value) times the cosine of each ray with the central one."""
    u, v, d = (F.col("col") - (columns - 1) / 2) * spacing, (F.col("row") - (rows - 1) / 2) * spacing, source + detector
    return projections.withColumn("value", F.col("value") * d / F.sqrt(u * u + v * v + d * d))


def fdk(projections: DataFrame, grid: Grid, angles: int, shape: tuple[int, int], spacing: float, source: float, detector: float) -> DataFrame:
    """(j, value): Feldkamp's reconstruction of (view, col, row, value), voxel driven, with bilinear interpolation on the panel.

    A task adds its views up to one slab of the volume, of at most ``MAX_VOXELS`` voxels, at a time; what is shuffled is a slab for each task.
    """
    columns, rows = shape
    filtered = filter_lines(fdk_weights(projections, source, detector, columns, rows, spacing), ["view", "row"], "col")
    n, d = math.prod(grid.shape), np.array(grid.spacing)
    slabs = -(-n // MAX_VOXELS)
    parts = int(projections.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(out: np.ndarray, view: int, panel: np.ndarray, first: int) -> None:
        phi = 2 * math.pi * view / angles
        for lo in range(0, len(out), 1 << 18):
            part = out[lo : lo + (1 << 18)]
            place = np.stack(np.unravel_index(np.arange(first + lo, first + lo + len(part)), grid.shape), axis=1)
            x, y, z = ((place - (np.array(grid.shape) - 1) / 2) * d).T
            depth = source - (x * math.cos(phi) + y * math.sin(phi))
            scale = (source + detector) / depth
            u = (-x * math.sin(phi) + y * math.cos(phi)) * scale / spacing + (columns - 1) / 2
            v = z * scale / spacing + (rows - 1) / 2
            value = np.zeros(len(part))
            cu, cv = np.floor(u).astype(int), np.floor(v).astype(int)
            for du in (0, 1):
                for dv in (0, 1):
                    ok = (cu + du >= 0) & (cu + du < columns) & (cv + dv >= 0) & (cv + dv < rows)
                    w = np.abs(1 - du - (u - cu)) * np.abs(1 - dv - (v - cv))
                    value[ok] += w[ok] * panel[cu[ok] + du, cv[ok] + dv]
            part += value * (source / depth) ** 2 * (math.pi / angles) * (source + detector) / source / spacing

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slab, view, out, panel = None, None, np.zeros(0), np.zeros(shape)

        def flush() -> Iterator[pd.DataFrame]:
            for lo in range(0, len(out), 1 << 16):
                part = out[lo : lo + (1 << 16)]
                yield pd.DataFrame({"j": np.arange(slab * MAX_VOXELS + lo, slab * MAX_VOXELS + lo + len(part)), "value": part})

        for frame in frames:
            for (s, v), g in frame.groupby(["slab", "view"], sort=True):
                if (s, v) != (slab, view):
                    if view is not None:
                        add(out, view, panel, slab * MAX_VOXELS)
                    if s != slab:
                        yield from flush()
                        out = np.zeros(min(MAX_VOXELS, n - int(s) * MAX_VOXELS))
                    slab, view, panel = int(s), int(v), np.zeros(shape)
                panel[g["col"], g["row"]] = g["value"]
        if view is not None:
            add(out, view, panel, slab * MAX_VOXELS)
            yield from flush()

    dealt = filtered.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).repartition(parts, "slab", "view").sortWithinPartitions("slab", "view")
    return dealt.select("slab", "view", "col", "row", "value").mapInPandas(run, "j long, value double").groupBy("j").agg(F.sum("value").alias("value"))
