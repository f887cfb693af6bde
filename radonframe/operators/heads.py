"""SPECT with several narrow heads: frames that share angles, each with a lateral offset, a distance and a time of its own.

A volume is turned once for each angle; its frames take the sums along the depth, shifted by their offsets, in the ``width`` pixels
around the middle. Frames are a table (a, turn, offset, time[, radius]): turn numbers the angles of the stencil, offsets are in pixels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import kept
from . import spect
from .systems import Subsets, Turned


def turns_of(frames: DataFrame) -> DataFrame:
    """(turn, angle): the distinct angles of frames (.., angle), numbered in order. As many rows as a scan has angles."""
    angles, before = frames.select("angle").distinct(), frames.select(F.col("angle").alias("other")).distinct()
    return angles.join(before, F.col("other") < F.col("angle"), "left").groupBy("angle").agg(F.count("other").cast("int").alias("turn")).select("turn", "angle")


def distance_blur(frames: DataFrame, sigma: Callable[[Column], Column], n: int, spacing: float, half: int) -> Callable[[DataFrame], DataFrame]:
    """A blur along y and z for ``Heads``: its width in pixels by the distance in cm from the frame's head."""

    def run(rows: DataFrame) -> DataFrame:
        named = rows.join(F.broadcast(frames.select("a", "radius")), "a")  # one row for each frame
        away = lambda x: F.greatest(F.col("radius") - (x - (n - 1) / 2) * spacing, F.lit(0.0))
        for axis in "yz":
            named = spect.depth_blur(named, lambda x: sigma(away(x)), half, axis, keys=("a", "radius"))
        return named.drop("radius")

    return run


@dataclass(frozen=True)
class Heads(Turned):
    """i = (frame * width + r) * planes + z. probability: by turn, as (a, x, y, z, value); blur: of rows (a, x, y, z, value) of frames. Subsets are of frames."""

    frames: DataFrame | None = None
    width: int = 16

    def _shift(self, rows: DataFrame, source: str, target: str, sign: int) -> DataFrame:
        """Rows (.., source, offset) at the two pixels beside their place plus ``sign`` times the offset, with the share of each as w; the transpose of the opposite sign."""
        at = F.col(source) + sign * F.col("offset")
        both = rows.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(target, (F.floor(at) + F.col("k")).cast("int"))
        return both.withColumn("w", 1 - F.abs(at - F.col(target))).filter((F.col("w") > 1e-12) & F.col(target).between(0, self.n - 1))

    def forward(self, image: DataFrame) -> DataFrame:
        rows = spect.rotated(self._image(image), self.turns)
        if self.probability is not None:
            rows = rows.join(self.probability.withColumnRenamed("value", "seen"), ["a", "x", "y", "z"]).withColumn("value", F.col("value") * F.col("seen"))
        rows = rows.select(F.col("a").alias("turn"), "x", "y", "z", "value")
        if self.blur:
            rows = self.blur(rows.join(self.frames.select("a", "turn"), "turn").select("a", "x", "y", "z", "value"))
            rows = rows.groupBy("a", "y", "z").agg(F.sum("value").alias("value")).join(self.frames.select("a", "offset", "time"), "a")
        else:
            rows = rows.groupBy("turn", "y", "z").agg(F.sum("value").alias("value")).join(self.frames, "turn")
        first = self.n // 2 - self.width // 2
        out = self._shift(rows, "y", "to", 1).withColumn("r", F.col("to") - first).filter(F.col("r").between(0, self.width - 1))
        bins = ((F.col("a").cast("long") * self.width + F.col("r")) * self.planes + F.col("z")).alias("i")
        return out.groupBy(bins).agg(F.sum(F.col("value") * F.col("w") * F.col("time")).alias("value"))

    def backward(self, projections: DataFrame) -> DataFrame:
        i, p = F.col("i"), self.planes
        rows = projections.select(F.floor(i / (self.width * p)).cast("int").alias("a"), (F.pmod(F.floor(i / p), F.lit(self.width)).cast("int") + (self.n // 2 - self.width // 2)).alias("to"), F.pmod(i, F.lit(p)).cast("int").alias("z"), "value")
        lines = self._shift(rows.join(self.frames, "a"), "to", "y", -1).withColumn("value", F.col("value") * F.col("w") * F.col("time"))
        if not self.blur:
            lines = lines.groupBy(F.col("turn").alias("a"), F.col("y").alias("r"), "z").agg(F.sum("value").alias("value"))
            return self._voxel(spect.backward(lines, self.turns, self.n, self.probability))
        wide = lines.groupBy("a", "y", "z").agg(F.sum("value").alias("value")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))))
        # lines that no bin reaches are zero, and a blur wants whole grids
        every = self.frames.select("a").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1)))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))))
        rows = (self.blur_back or self.blur)(every.join(wide, ["a", "x", "y", "z"], "left").fillna(0.0, ["value"]).select("a", "x", "y", "z", "value"))
        rows = rows.join(self.frames.select("a", "turn"), "a").groupBy(F.col("turn").alias("a"), "x", "y", "z").agg(F.sum("value").alias("value"))
        if self.probability is not None:
            rows = rows.join(self.probability.withColumnRenamed("value", "seen"), ["a", "x", "y", "z"]).withColumn("value", F.col("value") * F.col("seen"))
        back = rows.join(self.turns, ["a", "x", "y"]).groupBy("xi", "yi", "z").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
        return self._voxel(back.select(F.col("xi").alias("x"), F.col("yi").alias("y"), "z", "value"))

    def bins(self) -> DataFrame:
        return self._places(self.frames.select("a"), "a", self.width).withColumnRenamed("n", "i")

    def part(self, subsets: Subsets, m: int) -> Heads:
        own = self.frames.filter(subsets.of(F.col("a").cast("long") * self.width * self.planes) == m)
        return replace(self, frames=own, turns=self.turns.join(own.select(F.col("turn").alias("a")).distinct(), "a", "left_semi"))

    def kept(self) -> Heads:
        return replace(super().kept(), frames=kept(self.frames, "a"))
