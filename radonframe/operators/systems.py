"""Linear systems that solvers and likelihoods take: a matrix that is stored, rays that are projected in the pass, turned volumes that are summed.

A system maps images (j, value) to projections (i, value) and back. ``Subsets`` gives each bin i the number of its subset; ``part`` is the
system of one subset. Only ``Stored`` and ``Saved`` hold a matrix: the others take as much memory as an image or a batch of rays needs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import kept
from . import algebra, rays, spect
from .rays import Grid

MAX_VIEWS = 1 << 16  # whose subsets a table may name


@dataclass(frozen=True)
class Subsets:
    """``count`` subsets of bins; ``number``: of a bin's subset, by i, the remainder by default."""

    count: int = 1
    number: Callable[[Column], Column] | None = None

    def of(self, i: Column) -> Column:
        return (F.pmod(i, F.lit(self.count)) if self.number is None else self.number(i)).cast("int")


def by_view(count: int, per_view: int) -> Subsets:
    """Every ``count``-th view is a subset; i = view * per_view + place."""
    return Subsets(count, lambda i: F.pmod(F.floor(i / per_view), F.lit(count)))


def of_views(table: DataFrame, per_view: int) -> Subsets:
    """Subsets by a table (view, subset) of a scan's views, which goes into the plan: ``MAX_VIEWS`` views at most. Views that it does not name are in none (-1)."""
    rows = table.select("view", "subset").limit(MAX_VIEWS + 1).collect()
    if len(rows) > MAX_VIEWS:
        raise ValueError(f"more than {MAX_VIEWS} views")
    number = [-1] * (1 + max((r["view"] for r in rows), default=0))
    for r in rows:
        number[r["view"]] = r["subset"]
    every = F.array(*[F.lit(n) for n in number])
    return Subsets(1 + max(number), lambda i: F.coalesce(F.get(every, F.floor(i / per_view).cast("int")), F.lit(-1)))


def subsets_by_angle(views: DataFrame, count: int, angle: str = "angle") -> DataFrame:
    """(view, subset) of views (view, angle) of which several share an angle: every ``count``-th of the distinct angles, in order, is a subset. As many rows as views."""
    angles = views.select(angle).distinct()
    before = views.select(F.col(angle).alias("other")).distinct()
    rank = angles.join(before, F.col("other") < F.col(angle), "left").groupBy(angle).agg(F.count("other").alias("n"))  # a scan's distinct angles
    return views.join(rank, angle).select("view", F.pmod("n", F.lit(count)).cast("int").alias("subset"))


class System:
    """What solvers ask of a system. A subclass gives ``forward``, ``backward``, ``bins``, ``voxels`` and ``part``."""

    def forward(self, image: DataFrame) -> DataFrame:
        """(i, value) of an image (j, value); bins that see nothing may be left out."""
        raise NotImplementedError

    def backward(self, projections: DataFrame) -> DataFrame:
        """(j, value), the transpose of ``forward``."""
        raise NotImplementedError

    def bins(self) -> DataFrame:
        """(i)"""
        raise NotImplementedError

    def voxels(self) -> DataFrame:
        """(j)"""
        raise NotImplementedError

    def part(self, subsets: Subsets, m: int) -> System:
        """The system of one subset's bins."""
        raise NotImplementedError

    def kept(self) -> System:
        """The same system, with what each use would compute anew computed once."""
        return self

    def normalization(self) -> DataFrame:
        """(j, value): the back projection of ones."""
        return self.backward(self.bins().withColumn("value", F.lit(1.0)))

    def row_sums(self) -> DataFrame:
        """(i, value): the forward projection of ones."""
        return self.forward(self.voxels().withColumn("value", F.lit(1.0)))

    def normalizations(self, subsets: Subsets) -> DataFrame:
        """(j, m, norm) of each subset."""
        out = None
        for m in range(subsets.count):
            own = (self if subsets.count == 1 else self.part(subsets, m)).normalization().select("j", F.lit(m).alias("m"), F.col("value").alias("norm"))
            out = own if out is None else out.unionByName(own)
        return out


@dataclass(frozen=True)
class Stored(System):
    """A matrix (i, j, h)."""

    h: DataFrame

    def forward(self, image: DataFrame) -> DataFrame:
        return algebra.forward(self.h, image)

    def backward(self, projections: DataFrame) -> DataFrame:
        return algebra.backward(self.h, projections)

    def bins(self) -> DataFrame:
        return self.h.select("i").distinct()

    def voxels(self) -> DataFrame:
        return self.h.select("j").distinct()

    def part(self, subsets: Subsets, m: int) -> System:
        return Stored(self.h.filter(subsets.of(F.col("i")) == m))

    def kept(self) -> System:
        return Stored(kept(self.h, "i"))

    def normalization(self) -> DataFrame:
        return algebra.normalization(self.h)

    def row_sums(self) -> DataFrame:
        return algebra.row_sums(self.h)

    def normalizations(self, subsets: Subsets) -> DataFrame:
        return self.h.groupBy("j", subsets.of(F.col("i")).alias("m")).agg(F.sum("h").alias("norm"))


@dataclass(frozen=True)
class Saved(Stored):
    """A matrix table (m, i, j, h) written by ``save``: its files are dealt by subset and, within, by bin, so that a subset's part reads its own files and sums by bin need no shuffle of it."""

    subsets: Subsets = Subsets()

    def part(self, subsets: Subsets, m: int) -> System:
        if subsets is not self.subsets:
            raise ValueError("a saved matrix has the subsets that it was written with")
        return Stored(self.h.filter(F.col("m") == m))

    def kept(self) -> System:
        return self

    def normalizations(self, subsets: Subsets) -> DataFrame:
        return self.h.groupBy("j", "m").agg(F.sum("h").alias("norm"))


def save(h: DataFrame, name: str, folder: str, subsets: Subsets, buckets: int) -> Saved:
    """Write a matrix (i, j, h) once, for this and later sessions, which ``opened`` reads; name: of the table, folder: shared by the cluster."""
    rows = h.select("i", "j", "h", subsets.of(F.col("i")).alias("m")).repartition(buckets, "i")
    rows.write.partitionBy("m").bucketBy(buckets, "i").sortBy("i").option("path", folder).format("parquet").saveAsTable(name)
    return Saved(h.sparkSession.table(name), subsets)


def opened(spark: SparkSession, name: str, folder: str, subsets: Subsets, buckets: int) -> Saved:
    """The matrix that an earlier session saved; names and numbers as there."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} (i BIGINT, j BIGINT, h DOUBLE, m INT) USING parquet PARTITIONED BY (m) CLUSTERED BY (i) SORTED BY (i) INTO {buckets} BUCKETS LOCATION '{folder}'")
        spark.catalog.recoverPartitions(name)
    return Saved(spark.table(name), subsets)


@dataclass(frozen=True)
class Rays(System):
    """Rays (i, ends[, offset]) through a grid, projected in the pass: cone beams, sinograms, pairs and events, with or without time of flight.

    tof: (width, sigma) of time bins in mm. weights: (i, weight), by which a ray's integral is multiplied, as sensitivities are. Rays of
    measured events need the whole scanner's sensitivity beside them, which ``Solver`` takes.
    """

    lines: DataFrame
    grid: Grid
    tof: tuple[float, float] | None = None
    weights: DataFrame | None = None

    def _weighted(self, rows: DataFrame) -> DataFrame:
        if self.weights is None:
            return rows
        return rows.join(self.weights.select("i", "weight"), "i").withColumn("value", F.col("value") * F.col("weight")).drop("weight")

    def forward(self, image: DataFrame) -> DataFrame:
        return self._weighted(rays.project(self.lines, image, self.grid, self.tof))

    def backward(self, projections: DataFrame) -> DataFrame:
        rows = self._weighted(projections.select("i", "value"))
        return rays.back_project(self.lines.join(rows, "i"), self.grid, self.tof)

    def bins(self) -> DataFrame:
        return self.lines.select("i")

    def voxels(self) -> DataFrame:
        return self.lines.sparkSession.range(math.prod(self.grid.shape)).withColumnRenamed("id", "j")

    def part(self, subsets: Subsets, m: int) -> System:
        return replace(self, lines=self.lines.filter(subsets.of(F.col("i")) == m))

    def kept(self) -> System:
        return replace(self, lines=kept(self.lines.select(*rays._columns(self.tof)), "i"), weights=None if self.weights is None else kept(self.weights, "i"))


@dataclass(frozen=True)
class Turned(System):
    """Rotate and sum: voxels j = (x * n + y) * planes + z, bins i = (view * n + r) * planes + z.

    turns: the stencil of the views; probability: (a, x, y, z, value); blur: by depth, its own transpose unless ``blur_back`` is given.
    Subsets are of views.
    """

    turns: DataFrame
    n: int
    planes: int
    probability: DataFrame | None = None
    blur: Callable[[DataFrame], DataFrame] | None = None
    blur_back: Callable[[DataFrame], DataFrame] | None = None

    def _image(self, image: DataFrame) -> DataFrame:
        j, n, p = F.col("j"), self.n, self.planes
        return image.select(F.floor(j / (n * p)).cast("int").alias("x"), F.pmod(F.floor(j / p), F.lit(n)).cast("int").alias("y"), F.pmod(j, F.lit(p)).cast("int").alias("z"), "value")

    def _voxel(self, rows: DataFrame) -> DataFrame:
        return rows.select(((F.col("x") * self.n + F.col("y")).cast("long") * self.planes + F.col("z")).alias("j"), "value")

    def forward(self, image: DataFrame) -> DataFrame:
        out = spect.forward(self._image(image), self.turns, self.probability, self.blur)
        return out.select(((F.col("a").cast("long") * self.n + F.col("r")) * self.planes + F.col("z")).alias("i"), "value")

    def backward(self, projections: DataFrame) -> DataFrame:
        i, n, p = F.col("i"), self.n, self.planes
        rows = projections.select(F.floor(i / (n * p)).cast("int").alias("a"), F.pmod(F.floor(i / p), F.lit(n)).cast("int").alias("r"), F.pmod(i, F.lit(p)).cast("int").alias("z"), "value")
        return self._voxel(spect.backward(rows, self.turns, n, self.probability, self.blur_back or self.blur))

    def matrix(self, mask: DataFrame | None = None) -> DataFrame:
        """(i, j, h) of a system without blur, to be saved; mask: (j), the voxels that it is to have."""
        if self.blur:
            raise ValueError("a blurred system has as many weights as voxels times pixels")
        rows = self.turns.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(self.planes - 1))))
        seen = F.lit(1.0)
        if self.probability is not None:
            rows, seen = rows.join(self.probability.withColumnRenamed("value", "seen"), ["a", "x", "y", "z"]), F.col("seen")
        i, j = (F.col("a").cast("long") * self.n + F.col("y")) * self.planes + F.col("z"), (F.col("xi").cast("long") * self.n + F.col("yi")) * self.planes + F.col("z")
        out = rows.groupBy(i.alias("i"), j.alias("j")).agg(F.sum(F.col("w") * seen).alias("h")).filter("h <> 0")
        return out if mask is None else out.join(mask.select("j").distinct(), "j", "left_semi").select("i", "j", "h")

    def _places(self, df: DataFrame, first: str, size: int) -> DataFrame:
        """Each row of (first), of which there are few, with all places of ``size`` and the planes, as one number."""
        rows = df.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(self.planes - 1))))
        return rows.select(((F.col(first).cast("long") * size + F.col("p")) * self.planes + F.col("z")).alias("n"))

    def bins(self) -> DataFrame:
        return self._places(self.turns.select("a").distinct(), "a", self.n).withColumnRenamed("n", "i")

    def voxels(self) -> DataFrame:
        return self.turns.sparkSession.range(self.n * self.n * self.planes).withColumnRenamed("id", "j")

    def part(self, subsets: Subsets, m: int) -> System:
        return replace(self, turns=self.turns.filter(subsets.of(F.col("a").cast("long") * self.n * self.planes) == m))

    def kept(self) -> System:
        return replace(self, turns=kept(self.turns, "a"), probability=None if self.probability is None else kept(self.probability, "a"))


@dataclass(frozen=True)
class Transform:
    """A linear map between images (j, value), or between projections (i, value), with its transpose."""

    forward: Callable[[DataFrame], DataFrame]
    backward: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Transformed(System):
    """A system after transforms of the image, and before transforms of the projections, each in order."""

    inner: System
    image: Sequence[Transform] = ()
    projection: Sequence[Transform] = ()

    def forward(self, image: DataFrame) -> DataFrame:
        for t in self.image:
            image = t.forward(image)
        out = self.inner.forward(image)
        for t in self.projection:
            out = t.forward(out)
        return out

    def backward(self, projections: DataFrame) -> DataFrame:
        for t in reversed(self.projection):
            projections = t.backward(projections)
        out = self.inner.backward(projections)
        for t in reversed(self.image):
            out = t.backward(out)
        return out

    def bins(self) -> DataFrame:
        return self.inner.bins()

    def voxels(self) -> DataFrame:
        return self.inner.voxels()

    def part(self, subsets: Subsets, m: int) -> System:
        return replace(self, inner=self.inner.part(subsets, m))

    def kept(self) -> System:
        return replace(self, inner=self.inner.kept())


def image_operator(k: DataFrame) -> Transform:
    """The transform of images by a stored operator (j, l, w)."""
    return Transform(lambda f: algebra.apply(k, f), lambda f: algebra.transpose_apply(k, f))


def system(h: DataFrame | System) -> System:
    return h if isinstance(h, System) else Stored(h)


