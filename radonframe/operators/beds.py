"""Scans of several beds: independent systems in one plan, images stitched, and the uncertainty of what is stitched.

A bed's bins and voxels keep their numbers below 2^``SHIFT``, with the bed's number above; so all beds go through each step of one solver
together, and its ``blocks`` keep shares and peaks apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts, solvers
from .solvers import Solver
from .systems import Stored, Subsets, System

SHIFT = 40


def keyed(bed: Column, key: Column) -> Column:
    return F.shiftleft(bed.cast("long"), SHIFT) + key


def bed_of(key: Column) -> Column:
    return F.shiftright(key, SHIFT).cast("int")


def within(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << SHIFT) - 1))


def joined(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (bed, keys, ..) with the bed in the keys."""
    return rows.withColumns({k: keyed(F.col("bed"), F.col(k)) for k in keys}).drop("bed")


def parted(rows: DataFrame, key: str) -> DataFrame:
    """(bed, key, ..) of rows whose key holds the bed."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(bed_of(F.col(key)).alias("bed"), within(F.col(key)).alias(key), *rest)


def subsets_of(subsets: int | Subsets) -> Subsets:
    """The subsets of each bed's own bins."""
    inner = subsets if isinstance(subsets, Subsets) else Subsets(subsets)
    return Subsets(inner.count, lambda i: inner.of(within(i)))


@dataclass(frozen=True)
class Beds(System):
    """One system for each bed, by its number."""

    systems: Sequence[System]

    def _each(self, rows: DataFrame, key: str, to: str, f: Callable[[System, DataFrame], DataFrame]) -> DataFrame:
        out = None
        for k, s in enumerate(self.systems):
            own = rows.filter(bed_of(F.col(key)) == k).withColumn(key, within(F.col(key)))
            one = f(s, own).withColumn(to, keyed(F.lit(k), F.col(to)))
            out = one if out is None else out.unionByName(one)
        return out

    def _all(self, f: Callable[[System], DataFrame], key: str) -> DataFrame:
        out = None
        for k, s in enumerate(self.systems):
            one = f(s).withColumn(key, keyed(F.lit(k), F.col(key)))
            out = one if out is None else out.unionByName(one)
        return out

    def forward(self, image: DataFrame) -> DataFrame:
        return self._each(image, "j", "i", lambda s, f: s.forward(f))

    def backward(self, projections: DataFrame) -> DataFrame:
        return self._each(projections, "i", "j", lambda s, p: s.backward(p))

    def bins(self) -> DataFrame:
        return self._all(lambda s: s.bins(), "i")

    def voxels(self) -> DataFrame:
        return self._all(lambda s: s.voxels(), "j")

    def normalization(self) -> DataFrame:
        return self._all(lambda s: s.normalization(), "j")

    def row_sums(self) -> DataFrame:
        return self._all(lambda s: s.row_sums(), "i")

    def part(self, subsets: Subsets, m: int) -> System:
        own = [Subsets(subsets.count, lambda i, k=k: subsets.of(keyed(F.lit(k), i))) for k in range(len(self.systems))]
        return replace(self, systems=[s.part(o, m) for s, o in zip(self.systems, own, strict=True)])

    def kept(self) -> System:
        return replace(self, systems=[s.kept() for s in self.systems])


def system(h: DataFrame | Sequence[System]) -> System:
    """One system of a matrix (bed, i, j, h), or of a system for each bed."""
    return Stored(joined(h, "i", "j")) if isinstance(h, DataFrame) else Beds(list(h))


def solver(make: Callable[..., Solver], h: DataFrame | Sequence[System], data: DataFrame, **more) -> Solver:
    """A solver of all beds, of data (bed, i, g, s); make: as ``solvers.osem``, with ``more`` as its arguments. A prior sees (bed, j, value) in and gives it out."""
    if "prior" in more and more["prior"] is not None:
        prior = more["prior"]
        more = more | {"prior": lambda image: joined(prior(parted(image, "j")), "j")}
    out = make(system(h), joined(data, "i"), **more)
    out.blocks = bed_of
    return out


def volumes(images: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(bed, x, y, z, value) of (bed, j, value), j = (x * ny + y) * nz + z."""
    _, ny, nz = shape
    j = F.col("j")
    return images.select("bed", F.floor(j / (ny * nz)).cast("int").alias("x"), F.pmod(F.floor(j / nz), F.lit(ny)).cast("int").alias("y"), F.pmod(j, F.lit(nz)).cast("int").alias("z"), "value")


def stitched(image: DataFrame, offsets: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(x, y, z, value) of a solver's image of all beds; offsets: (bed, place, offset), as ``counts.stitch`` takes them."""
    return counts.stitch(volumes(parted(image, "j"), shape), offsets, shape[2])


def bed_mask(mask: DataFrame, image: DataFrame, offsets: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(j, value) over all beds of a mask (x, y, z, value) of the stitched image: its part in each bed times the bed's weight there."""
    rows = volumes(parted(image.select("j"), "j").withColumn("value", F.lit(0.0)), shape)
    placed = counts.stitch_weights(rows.drop("value"), offsets, shape[2])
    named = mask.select("x", "y", F.col("z").alias("plane"), "value")
    _, ny, nz = shape
    j = (F.col("x").cast("long") * ny + F.col("y")) * nz + F.col("z")
    return placed.join(named, ["x", "y", "plane"]).select(keyed(F.col("bed"), j).alias("j"), (F.col("value") * F.col("weight")).alias("value")).filter("value <> 0")


def uncertainty(h: DataFrame | Sequence[System], data: DataFrame, iterates: list[DataFrame], mask: DataFrame, offsets: DataFrame, shape: tuple[int, int, int], subsets: int | Subsets = 1, **more) -> DataFrame:
    """One row (value, percent) of a mask of the stitched image, as ``solvers.uncertainty``: beds are independent, so their variances add up. iterates: of ``solver``."""
    own = bed_mask(mask, iterates[-1], offsets, shape)
    return solvers.uncertainty(system(h), joined(data, "i"), iterates, own, subsets_of(subsets), **more)
