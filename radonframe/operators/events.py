"""Coincidence events: identifiers, geometry lookups, histograms and corrections. Events are tables with detector_1, detector_2 and, with time of flight, tof."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scanner:
    """Counts and spacings (mm) of a cylindrical scanner's levels: crystals in submodules in modules in sectors."""

    crystal_trans: int
    crystal_axial: int
    submodule_trans: int
    submodule_axial: int
    module_trans: int
    module_axial: int
    rsector_trans: int
    rsector_axial: int = 1
    crystal_trans_spacing: float = 4.0
    crystal_axial_spacing: float = 4.0
    submodule_trans_spacing: float = 0.0
    submodule_axial_spacing: float = 0.0
    module_trans_spacing: float = 0.0
    module_axial_spacing: float = 0.0
    radius: float = 300.0
    first_crystal_axis: int = 1
    min_sector_difference: int = 0

    @property
    def per_ring(self) -> int:
        return self.crystal_trans * self.submodule_trans * self.module_trans * self.rsector_trans

    @property
    def rings(self) -> int:
        return self.crystal_axial * self.submodule_axial * self.module_axial * self.rsector_axial


LEVELS = ("crystal", "submodule", "module", "rsector")


def split_id(value: Column, trans: int) -> tuple[Column, Column]:
    """(transaxial, axial) part of a level's running number."""
    return F.pmod(value, F.lit(trans)), F.floor(value / trans).cast("int")


def detector_id(parts: dict[str, Column], scanner: Scanner) -> Column:
    """The detector number of transaxial and axial level numbers {"crystal_trans": ..., ...}: ring times crystals per ring, plus the place in the ring."""
    out = {}
    for way in ("trans", "axial"):
        total, radix = F.lit(0), 1
        for level in LEVELS:
            total = total + parts[f"{level}_{way}"] * radix
            radix *= getattr(scanner, f"{level}_{way}")
        out[way] = total
    return (out["axial"] * scanner.per_ring + out["trans"]).cast("int")


def all_parts(spark, scanner: Scanner) -> DataFrame:
    """One row per crystal with its eight level numbers and detector_id: as many rows as the scanner has crystals."""
    names = [f"{level}_{way}" for way in ("trans", "axial") for level in LEVELS]
    out, radix = spark.range(scanner.per_ring * scanner.rings), 1
    for name in names:
        n = getattr(scanner, name)
        out = out.withColumn(name, F.pmod(F.floor(F.col("id") / radix), F.lit(n)).cast("int"))
        radix *= n
    return out.drop("id").withColumn("detector_id", detector_id({n: F.col(n) for n in names}, scanner))


def scanner_lut(spark, scanner: Scanner) -> DataFrame:
    """(detector_id, x, y, z) of every crystal. The sector's axial number does not enter z."""

    def along(way: str) -> Column:
        total = F.lit(0.0)
        for level in LEVELS[:3]:
            n, d = getattr(scanner, f"{level}_{way}"), getattr(scanner, f"{level}_{way}_spacing")
            total = total + F.col(f"{level}_{way}") * d - (n - 1) * d / 2
        return total

    phi = 2 * F.pi() * F.col("rsector_trans") / scanner.rsector_trans
    rows = all_parts(spark, scanner).select("detector_id", phi.alias("phi"), along("trans").alias("t"), (-along("axial")).alias("z"))
    sign = -1.0 if scanner.first_crystal_axis == 0 else 1.0
    x, y = F.lit(scanner.radius) * F.cos("phi") - F.col("t") * F.sin("phi"), F.lit(scanner.radius) * F.sin("phi") + F.col("t") * F.cos("phi")
    return rows.select("detector_id", (sign * x).alias("x"), (sign * y).alias("y"), "z")


def combinations(ids: DataFrame, column: str = "detector_id") -> DataFrame:
    """(detector_1, detector_2) of all pairs of distinct ids, the smaller first. The space of pairs is the result; it comes from a range join."""
    a, b = ids.select(F.col(column).alias("detector_1")), ids.select(F.col(column).alias("detector_2"))
    return a.join(b, F.col("detector_1") < F.col("detector_2"))


def triangular_index(a: Column, b: Column, n: int) -> Column:
    """The place of a pair among all pairs a < b of n numbers in order; either order of the two."""
    low, high = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    return ((n - 1) * low + high - F.floor(low * (low + 1) / 2) - 1).cast("long")


def with_endpoints(events: DataFrame, lut: DataFrame) -> DataFrame:
    """Events with x1, y1, z1, x2, y2, z2 looked up."""
    for k in (1, 2):
        own = lut.select(F.col("detector_id").alias(f"detector_{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        events = events.join(own, f"detector_{k}")
    return events


def lor_radius() -> Column:
    """Signed distance of a line from the axis, of columns x1, y1, x2, y2; the end's own distance where the ends coincide."""
    d = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    cross = F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")
    return F.when(d > 0, cross / d).otherwise(F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1")))


def lor_angle() -> Column:
    """Angle of a line with the x axis, up to a quarter turn; infinite where the ends coincide."""
    d = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return F.when(d > 0, F.acos(F.abs(F.col("x2") - F.col("x1")) / d)).otherwise(F.lit(float("inf")))


def in_volume(half: tuple[float, float, float], pairs: tuple[tuple[str, str], ...] = (("x", "y"), ("x", "z"), ("y", "z"))) -> Column:
    """Whether the line of x1 .. z2 meets the box |x| <= half: the slabs' ranges of the line's parameter overlap, pair by pair of axes."""
    enter, leave = {}, {}
    for axis, h in zip("xyz", half, strict=True):
        a, d = F.col(f"{axis}1"), F.col(f"{axis}2") - F.col(f"{axis}1")
        flat = d == 0
        s, t = (-h - a) / F.when(flat, 1.0).otherwise(d), (h - a) / F.when(flat, 1.0).otherwise(d)
        inside = F.abs(a) <= h
        enter[axis] = F.when(flat, F.when(inside, float("-inf")).otherwise(float("inf"))).otherwise(F.least(s, t))
        leave[axis] = F.when(flat, F.when(inside, float("inf")).otherwise(float("-inf"))).otherwise(F.greatest(s, t))
    miss = F.lit(False)
    for p, q in pairs:
        miss = miss | (enter[p] > leave[q]) | (enter[q] > leave[p])
    return ~miss


def coarse_tof(tof: Column, per_bin: int, middle: int) -> Column:
    """A vendor's fine time bin as one of a scanner's coarse bins, which run the other way."""
    return (-F.floor(tof / per_bin) + middle).cast("long")


def ring_plane(r1: Column, r2: Column, rings: int) -> Column:
    """Number of the plane of two rings (from 0): direct planes first, then by ring difference, each way apart."""
    d = F.abs(r1 - r2)
    before = rings + (d - 1) * (2 * rings - d)  # planes with smaller differences: R + sum of 2 (R - k) for k < d
    return F.when(d == 0, r1).when(r1 < r2, before + r1).otherwise(before + rings - d + r1 - d).cast("int")


def sinogram_cells(df: DataFrame, c1: str, c2: str, scanner: Scanner) -> DataFrame:
    """``df`` with the (a, r) cell of two crystals of a ring; (0, 0) for pairs closer than the least sector difference.

    Steps are columns of their own, each computed once: nested in one expression they would multiply.
    """
    p = scanner.per_ring
    least = scanner.min_sector_difference * scanner.module_trans * scanner.crystal_trans
    back = scanner.module_trans * scanner.crystal_trans / 2
    size = p - 2 * (least - 1) - 1
    moved = {f"_m{k}": F.pmod(F.pmod(F.col(c), F.lit(p)) - back, F.lit(float(p))) for k, c in ((1, c1), (2, c2))}
    out = df.withColumns(moved).withColumns({"_lo": F.least("_m1", "_m2"), "_hi": F.greatest("_m1", "_m2")})
    lo, hi, both = F.col("_lo"), F.col("_hi"), F.col("_lo") + F.col("_hi")
    outer = (both >= 1.5 * p) | (both < p / 2)
    depth = F.when(lo == hi, -p / 2).otherwise((hi - lo - 1) / 2 - (p - (hi - lo + 1)) / 2)
    out = out.withColumn("_depth", F.floor(F.when(outer, depth).otherwise(-depth)))
    turn = F.when(both < p / 2, 2 * lo + p + F.col("_depth")).when(both >= 1.5 * p, 2 * lo - p + F.col("_depth")).otherwise(2 * lo - F.col("_depth"))
    near = hi - lo < least
    cells = {"a": F.when(near, 0).otherwise(F.floor(turn / 2)).cast("int"), "r": F.when(near, 0).otherwise(F.floor(F.col("_depth") + size / 2)).cast("int")}
    return out.withColumns(cells).drop("_m1", "_m2", "_lo", "_hi", "_depth")


def cell_table(spark, scanner: Scanner) -> DataFrame:
    """(_c1, _c2, a, r) of all pairs of places in a ring: as many rows as the square of a ring's crystals."""
    p = scanner.per_ring
    pairs = spark.range(p * p).select(F.floor(F.col("id") / p).cast("int").alias("_c1"), F.pmod("id", F.lit(p)).cast("int").alias("_c2"))
    return sinogram_cells(pairs, "_c1", "_c2", scanner)


def with_cells(events: DataFrame, scanner: Scanner, tof_bins: int | None = None) -> DataFrame:
    """Events with a, r, p (and tof mirrored): the end with the larger place in its ring goes first, and a swapped pair's time bin is mirrored."""
    p = scanner.per_ring
    places = {"_p1": F.pmod("detector_1", F.lit(p)), "_p2": F.pmod("detector_2", F.lit(p)), "_q1": F.floor(F.col("detector_1") / p), "_q2": F.floor(F.col("detector_2") / p)}
    rows = events.withColumns(places).withColumn("_swap", F.col("_p1") < F.col("_p2"))
    first = lambda one, two: F.when(F.col("_swap"), F.col(two)).otherwise(F.col(one))
    rows = rows.withColumns({"_c1": first("_p1", "_p2"), "_c2": first("_p2", "_p1"), "_r1": first("_q1", "_q2"), "_r2": first("_q2", "_q1")})
    out = rows.join(cell_table(events.sparkSession, scanner), ["_c1", "_c2"]).withColumn("p", ring_plane(F.col("_r1"), F.col("_r2"), scanner.rings))
    if tof_bins is not None:
        out = out.withColumn("tof", F.when(F.col("_swap"), tof_bins - 1 - F.col("tof")).otherwise(F.col("tof")))
    return out.drop("_p1", "_p2", "_q1", "_q2", "_swap", "_c1", "_c2", "_r1", "_r2")


def histogram(events: DataFrame, scanner: Scanner, weight: Column | None = None, tof_bins: int | None = None) -> DataFrame:
    """(a, r, p[, tof], value): weighted counts of the cells; time bins out of range are dropped."""
    rows = with_cells(events, scanner, tof_bins)
    keys = ["a", "r", "p"]
    if tof_bins is not None:
        rows, keys = rows.filter(F.col("tof").between(0, tof_bins - 1)), [*keys, "tof"]
    return rows.groupBy(*keys).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("value"))


def lookup_cells(events: DataFrame, sinogram: DataFrame, scanner: Scanner, tof_bins: int | None = None) -> DataFrame:
    """Events with the value of their cell, 0 where the sinogram has none."""
    keys = ["a", "r", "p", *(["tof"] if tof_bins is not None else [])]
    return with_cells(events, scanner, tof_bins).join(sinogram, keys, "left").fillna(0.0, ["value"])


def level_number(detector: Column, level: str, way: str, scanner: Scanner) -> Column:
    """A level's transaxial ("trans") or axial number of a detector."""
    value, radix = (F.pmod(detector, F.lit(scanner.per_ring)) if way == "trans" else F.floor(detector / scanner.per_ring)), 1
    for x in LEVELS[: LEVELS.index(level)]:
        radix *= getattr(scanner, f"{x}_{way}")
    return F.pmod(F.floor(value / radix), F.lit(getattr(scanner, f"{level}_{way}"))).cast("int")


def symmetry_key(events: DataFrame, scanner: Scanner) -> DataFrame:
    """Events with key: what pairs of equal sensitivity share, the smaller detector first.

    Both crystals' axial and transaxial numbers, the differences of axial submodules and modules (from 0), and the turn between sectors.
    """
    ends = {1: F.least("detector_1", "detector_2"), 2: F.greatest("detector_1", "detector_2")}
    parts = [level_number(d, "crystal", way, scanner).alias(f"crystal_{way}_{k}") for way in ("axial", "trans") for k, d in ends.items()]
    for level in ("submodule", "module"):
        difference = level_number(ends[2], level, "axial", scanner) - level_number(ends[1], level, "axial", scanner)
        parts.append((difference + getattr(scanner, f"{level}_axial") - 1).cast("int").alias(f"{level}_axial"))
    turn = level_number(ends[2], "rsector", "trans", scanner) - level_number(ends[1], "rsector", "trans", scanner)
    return events.withColumn("key", F.struct(*parts, F.pmod(turn, F.lit(scanner.rsector_trans)).cast("int").alias("turn")))


def normalization_weights(measured: DataFrame, pairs: DataFrame, scanner: Scanner, lut: DataFrame, cylinder: float, delta: float = 1e-11) -> DataFrame:
    """(detector_1, detector_2, weight) of all pairs: measured over possible pairs of its symmetry class, corrected for the source cylinder."""
    from ..functions.physics import geometric_correction

    seen = symmetry_key(measured, scanner).groupBy("key").agg(F.count("*").alias("seen"))
    keyed = symmetry_key(pairs, scanner)
    classes = keyed.groupBy("key").agg(F.count("*").alias("all")).join(seen, "key", "left")
    rows = with_endpoints(keyed.join(classes, "key"), lut).withColumn("radius", lor_radius())
    share = F.coalesce("seen", F.lit(0)) / F.col("all")
    return rows.select("detector_1", "detector_2", F.when(F.abs("radius") < cylinder, share * geometric_correction(F.col("radius"), cylinder, delta)).otherwise(0.0).alias("weight"))


def norm_sinogram(weights: DataFrame, scanner: Scanner) -> DataFrame:
    """(a, r, p, value) of all pairs' weights (detector_1, detector_2, weight): half of each pair's goes to the plane of its rings in either order, which the symmetry along the axis allows."""
    p = scanner.per_ring
    first = F.pmod("detector_1", F.lit(p)) >= F.pmod("detector_2", F.lit(p))
    ends = {k: F.when(first if k == 1 else ~first, F.col("detector_1")).otherwise(F.col("detector_2")) for k in (1, 2)}
    places = {f"_c{k}": F.pmod(d, F.lit(p)).cast("int") for k, d in ends.items()} | {f"_r{k}": F.floor(d / p).cast("int") for k, d in ends.items()}
    planes = F.array(ring_plane(F.col("_r1"), F.col("_r2"), scanner.rings), ring_plane(F.col("_r2"), F.col("_r1"), scanner.rings))
    placed = weights.withColumns(places).join(cell_table(weights.sparkSession, scanner), ["_c1", "_c2"]).withColumn("p", F.explode(planes))
    return placed.groupBy("a", "r", "p").agg((F.sum("weight") / 2).alias("value"))


def axial_sensitivity(z: Column, half: float) -> Column:
    """Triangular scale along the axis: 1 in the middle, 0 at the ends."""
    return F.greatest(1 - F.abs(z) / half, F.lit(0.0))
