"""Count data: energy-window scatter estimates, binning, masks, beds. Projections are tables (window, a, r, z, value) or parts of that."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.physics import bilinear_mu
from .closest import closest
from .grid import convolve, gaussian_kernel

CELL = ("a", "r", "z")


def window_pivot(counts: DataFrame, windows: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """One row per cell with a column w_<window> of counts for each named window, 0 where there are none."""
    return counts.groupBy(*cell).agg(*[F.sum(F.when(F.col("window") == w, F.col("value")).otherwise(0.0)).alias(f"w_{w}") for w in windows])


def window_scatter(lower: Column, upper: Column | None, width_lower: float, width_upper: float, width_peak: float, weight_lower: float = 0.5, weight_upper: float = 0.5) -> Column:
    """Counts of scatter in the peak window from those of the windows below and above."""
    estimate = lower / width_lower * weight_lower
    return (estimate if upper is None else estimate + upper / width_upper * weight_upper) * width_peak


def window_scatter_variance(lower: Column, upper: Column | None, width_lower: float, width_upper: float, width_peak: float, weight_lower: float = 0.5, weight_upper: float = 0.5) -> Column:
    """Its variance for Poisson counts."""
    v = lower * (width_peak / width_lower * weight_lower) ** 2
    return v if upper is None else v + upper * (width_peak / width_upper * weight_upper) ** 2


def smooth_scatter(scatter: DataFrame, sigmas: dict[str, float], keys: Sequence[str] = (), squared: bool = False) -> DataFrame:
    """Separable Gaussian blur of (a, r, z, value): around the circle of angles, with the edge's value along r and z. squared: by the squares of the weights, as variances are."""
    for axis, sigma in sigmas.items():
        if sigma > 0:
            kernel = [w * w if squared else w for w in gaussian_kernel(sigma)]
            scatter = convolve(scatter, keys, axis, kernel, "circular" if axis == "a" else "nearest", CELL)
    return scatter


def smooth_randoms(planes: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """The same over (a, r, z1, z2, value) of a randoms sinogram."""
    axes = ("a", "r", "z1", "z2")
    for axis, sigma in sigmas.items():
        if sigma > 0:
            planes = convolve(planes, (), axis, gaussian_kernel(sigma), "circular" if axis == "a" else "nearest", axes)
    return planes


def randoms_per_bin(sinogram: DataFrame, bins: int, bin_width: float, timing_width: float) -> DataFrame:
    """A randoms sinogram dealt evenly to time-of-flight bins: each has its width over the whole timing window (0.3 mm / ps / 2, both ways)."""
    share = bin_width / (2 * timing_width * 0.3 / 2)
    return sinogram.withColumn("value", F.col("value") * share).withColumn("tof", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))


def subsample(counts: DataFrame, n: int, angles: int, first: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over n x n pixels of every ``angles``-th angle from ``first``; angles are numbered anew."""
    kept = counts.filter((F.col("a") >= first) & (F.pmod(F.col("a") - first, F.lit(angles)) == 0))
    return kept.groupBy(*keys, F.floor((F.col("a") - first) / angles).cast("int").alias("a"), *[F.floor(F.col(c) / n).cast("int").alias(c) for c in "rz"]).agg(F.sum("value").alias("value"))


def weighted_sum(counts: DataFrame, weights: DataFrame, by: str, keys: Sequence[str]) -> DataFrame:
    """Regions' projections added up with a weight each: counts (by, keys, value), weights (by, weight)."""
    return counts.join(weights, by).groupBy(*keys).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def field_of_view(counts: DataFrame, contraction: int = 1) -> DataFrame:
    """One row (r_first, r_last, z_first, z_last): the box of pixels with counts, ``contraction`` pixels smaller at each end."""
    seen = counts.groupBy("r", "z").agg(F.sum("value").alias("value")).filter("value > 0")
    c = contraction
    return seen.agg((F.min("r") + c).alias("r_first"), (F.max("r") - c).alias("r_last"), (F.min("z") + c).alias("z_first"), (F.max("z") - c).alias("z_last"))


def stray_mean(blank: DataFrame, mask: DataFrame, duration_ratio: float) -> DataFrame:
    """One row, value: mean counts per pixel inside the mask (r, z) and angle of a blank scan, for another scan's duration."""
    inside = blank.join(mask, ["r", "z"], "left_semi")
    return inside.agg((F.sum("value") / (F.countDistinct("a") * F.countDistinct("r", "z")) * duration_ratio).alias("value"))


def density_peak(values: DataFrame, low: float = 1200.0, high: float = 1600.0, bins: int = 10, prominence: float = 8e-5) -> float | None:
    """The middle of the last bin, of equal ones between the least and the largest value inside (low, high), where the second gradient of the
    density has a peak that stands out by ``prominence``; none if there is no such peak.

    So it is the foot of a bump in the density and not its top: the second gradient is largest where the density turns up. Null and
    non-finite values take no part. Counts of the bins, a few numbers, come to the driver.
    """
    inside = values.filter((F.col("value") > low) & (F.col("value") < high))
    ends = inside.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    if ends["lo"] is None:
        return None
    lo, hi = (ends["lo"], ends["hi"]) if ends["hi"] > ends["lo"] else (ends["lo"] - 0.5, ends["hi"] + 0.5)
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1)).cast("int")  # the last bin has its upper end
    n = np.zeros(bins)
    for r in inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect():
        n[r["bin"]] = r["n"]
    curve = np.gradient(np.gradient(n / n.sum() / width)).tolist()
    for k in range(bins - 2, 0, -1):
        first = next((m for m in range(k, -1, -1) if curve[m] != curve[k]), None)  # of a flat top the last bin counts
        if curve[k + 1] >= curve[k] or first is None or curve[first] > curve[k]:
            continue
        sides = [curve[k::-1], curve[k:]]
        bases = [min(side[: next((m for m, v in enumerate(side) if v > curve[k]), len(side))]) for side in sides]
        if curve[k] - max(bases) >= prominence:
            return lo + (k + 0.5) * width
    return None


def bed_order(beds: DataFrame) -> DataFrame:
    """Beds (bed, z) with place: 0 for the lowest."""
    return beds.withColumn("place", F.row_number().over(Window.orderBy("z", "bed")) - 1)


def stitch_weights(planes: DataFrame, offsets: DataFrame, size: int) -> DataFrame:
    """Planes (bed, z) of beds ``size`` planes long with global plane and weight 0 or 1.

    offsets: (bed, place, offset), offset the bed's first plane. One edge plane of each end goes; of an overlap, the lower
    half is the lower bed's and the upper half the upper bed's.
    """
    w = Window.orderBy("place")
    around = offsets.withColumns({"down": F.col("offset") - F.lag("offset").over(w), "up": F.lead("offset").over(w) - F.col("offset")})
    overlap = lambda d: F.greatest(F.lit(size) - d, F.lit(0))
    low = F.coalesce(overlap(F.col("down")) - F.bround(overlap(F.col("down")) / 2), F.lit(0)).cast("int")
    high = F.coalesce(size - F.bround(overlap(F.col("up")) / 2), F.lit(size)).cast("int")
    rows = planes.join(around.select("bed", "offset", F.greatest(low, F.lit(1)).alias("low"), F.least(high, F.lit(size - 1)).alias("high")), "bed")
    return rows.withColumn("plane", F.col("z") + F.col("offset")).withColumn("weight", F.when((F.col("z") >= F.col("low")) & (F.col("z") < F.col("high")), 1.0).otherwise(0.0))


def stitch(images: DataFrame, offsets: DataFrame, size: int) -> DataFrame:
    """(x, y, z, value) of images (bed, x, y, z, value) put together."""
    weighted = stitch_weights(images, offsets, size)
    return weighted.groupBy("x", "y", "plane").agg(F.sum(F.col("value") * F.col("weight")).alias("value")).withColumnRenamed("plane", "z")


def fill_beds(projections: DataFrame, offsets: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """(bed, keys, z, value) of beds ``size`` planes long: of an overlap, a bed takes the half next to its neighbour from that neighbour.

    projections: (bed, keys, z, value); offsets: (bed, place, offset), offset the bed's first plane. A bed's planes below the middle of its
    overlap with the bed below come from that one, those above the middle of the other overlap from the bed above.
    """
    w = Window.orderBy("place")  # beds, a handful
    around = offsets.withColumns({"down": F.col("offset") - F.lag("offset").over(w), "up": F.lead("offset").over(w) - F.col("offset"), "below": F.lag("bed").over(w), "above": F.lead("bed").over(w)})
    half = lambda d: F.floor((F.lit(size) - d) / 2).cast("int")
    plan = around.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    z, low, high = F.col("z"), F.coalesce(half(F.col("down")), F.lit(0)), F.coalesce(F.col("up") + half(F.col("up")), F.lit(size))
    source = F.when(z >= high, F.struct(F.col("above").alias("bed"), (z - F.col("up")).cast("int").alias("z")))
    source = source.when(z < low, F.struct(F.col("below").alias("bed"), (z + F.col("down")).cast("int").alias("z"))).otherwise(F.struct(F.col("bed").alias("bed"), z.cast("int").alias("z")))
    plan = plan.select(F.col("bed").alias("_bed"), F.col("z").cast("int").alias("_z"), source.alias("_from")).select("_bed", "_z", "_from.*")
    return projections.join(plan, ["bed", "z"]).select(F.col("_bed").alias("bed"), *keys, F.col("_z").alias("z"), "value")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], first: tuple[str, str], second: tuple[str, str], tie: str, block: int = 1 << 20) -> DataFrame:
    """Each left row, once, with ``tie`` and the compared columns of the right row nearest by two differences in turn, of those with equal keys; ties by ``tie``.

    The columns of differences are integers or floats. Rows of a key meet in a task, which searches in sorted values (``closest``): no pairs are
    made. A key with more than ``block`` left rows is dealt to several tasks, which get its right rows each.
    """
    for df, k in ((left, 0), (right, 1)):
        for c in (first[k], second[k]):
            if not isinstance(df.schema[c].dataType, (T.IntegralType, T.FractionalType)) or isinstance(df.schema[c].dataType, T.DecimalType):
                raise TypeError(f"{c}: integers or floats are compared, not {df.schema[c].dataType.simpleString()}")
    known = lambda df: df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    taken = list(dict.fromkeys([first[1], second[1], tie]))
    left, right = known(left), known(right.select(*keys, *taken))
    hot = F.broadcast(left.groupBy(*keys).count().filter(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("_blocks")))  # a row for each ``block`` rows at most
    blocks = F.coalesce("_blocks", F.lit(1))
    own = left.join(hot, list(keys), "left").withColumn("_block", F.pmod(F.xxhash64(*left.columns), blocks).cast("int")).select(*left.columns, "_block")
    other = right.join(hot, list(keys), "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).select(*right.columns, "_block")
    columns = left.columns

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.select(columns).group_by(columns).aggregate([])
        if not (a.num_rows and b.num_rows):
            a, b = a.slice(0, 0), b.slice(0, 0)
        else:
            b = b.take(pa.array(closest(a, b, first, second, tie)))
        for c in taken:
            a = a.append_column(c, b[c])
        return a

    out = T.StructType([*left.schema.fields, *right.select(*taken).schema.fields])
    return own.groupBy(*keys, "_block").cogroup(other.groupBy(*keys, "_block")).applyInArrow(found, out)


def conversion(table: DataFrame, model: str, energy: float, ct_energy: float) -> DataFrame:
    """One row (a1, b1, a2, b2) of a table (Energy, CT Energy, Model Name, Lower Coeff, ..) of two-line conversions of CT numbers to attenuation.

    Of the rows of the scanner's model, if it has any, else of all, the one nearest in energy, then in that of the CT.
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[ -]", ""))
    own = F.when(plain(F.col("Model Name")) == model.replace(" ", "").replace("-", "").lower(), 0).otherwise(1)
    order = F.struct(own.alias("own"), F.abs(F.col("Energy") - energy).alias("d1"), F.abs(F.col("CT Energy") - ct_energy).alias("d2"))
    names = {"a1": "Lower Coeff", "b1": "Lower Constant", "a2": "Upper Coeff", "b2": "Upper Constant"}
    best = F.min_by(F.struct(*[F.col(c).cast("double").alias(k) for k, c in names.items()]), order)
    return table.agg(best.alias("b")).select("b.*")


def converted(volume: DataFrame, table: DataFrame, model: str, energy: float, ct_energy: float) -> DataFrame:
    """CT numbers (.., value) as attenuation, by the conversion of the table."""
    one = F.broadcast(conversion(table, model, energy, ct_energy))  # one row
    mu = bilinear_mu(F.col("value"), F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"))
    return volume.join(one).withColumn("value", mu).drop("a1", "b1", "a2", "b2")


def interpolated(material: DataFrame, energy: Column, name: str = "mu") -> DataFrame:
    """One row: the attenuation of a material (energy, mu) at an energy, on a line between the rows around it."""
    below = F.max_by(F.struct("energy", "mu"), F.when(F.col("energy") <= energy, F.col("energy")))
    above = F.min_by(F.struct("energy", "mu"), F.when(F.col("energy") >= energy, F.col("energy")))
    share = F.when(F.col("hi.energy") > F.col("lo.energy"), (energy - F.col("lo.energy")) / (F.col("hi.energy") - F.col("lo.energy"))).otherwise(0.0)
    return material.agg(below.alias("lo"), above.alias("hi")).select((F.col("lo.mu") + share * (F.col("hi.mu") - F.col("lo.mu"))).alias(name))


def material_lines(air: DataFrame, water: DataFrame, bone: DataFrame, ct_energy: float, energy: float) -> DataFrame:
    """One row (a1, b1, a2, b2): the two lines through air, water and bone, of their CT numbers at one energy and their attenuation at another."""
    one = None
    for name, rows in (("air", air), ("water", water), ("bone", bone)):
        both = interpolated(rows, F.lit(float(ct_energy)), f"{name}_ct").join(interpolated(rows, F.lit(float(energy)), name))  # one row each
        one = both if one is None else one.join(both)
    number = lambda m: (F.col(f"{m}_ct") - F.col("water_ct")) / (F.col("water_ct") - F.col("air_ct")) * 1000
    slope = lambda p, q: (F.col(q) - F.col(p)) / (number(q) - number(p))
    return one.select(slope("air", "water").alias("a1"), F.col("water").alias("b1"), slope("water", "bone").alias("a2"), F.col("water").alias("b2"))


def window_estimate(
    projections: DataFrame, widths: dict[int, float], peak: int, lower: int, upper: int | None = None, weight_lower: float = 0.5, weight_upper: float = 0.5, sigmas: dict[str, float] | None = None,
) -> DataFrame:
    """(a, r, z, value, variance): the scatter in the peak window of projections (window, a, r, z, value), and its variance, both smoothed if asked; widths: of the windows in keV.

    The variance is each bin's own; for sums over bins of a smoothed estimate, which are not independent, see ``window_variance``.
    """
    wide = window_pivot(projections, [lower, *([] if upper is None else [upper])])
    args = (F.col(f"w_{lower}"), None if upper is None else F.col(f"w_{upper}"), widths[lower], 1.0 if upper is None else widths[upper], widths[peak], weight_lower, weight_upper)
    value = wide.select(*CELL, window_scatter(*args).alias("value"))
    variance = wide.select(*CELL, window_scatter_variance(*args).alias("value"))
    if sigmas:
        # a sum of independent counts has the sum of their variances, each times its weight squared
        value, variance = smooth_scatter(value, sigmas), smooth_scatter(variance, sigmas, squared=True)
    return value.join(variance.withColumnRenamed("value", "variance"), list(CELL))


def smoothed_variance(variance: DataFrame, sigmas: dict[str, float], shape: tuple[int, int]) -> Callable[[DataFrame], DataFrame]:
    """For ``solvers.uncertainty``: the variance of a sum with weights x (i, value) of an estimate that was smoothed, as its terms s * (F x)^2.

    variance: (a, r, z, value), s of the bins before smoothing; F: the smoothing; i = (a * r's pixels + r) * z's pixels + z, ``shape`` the numbers of
    pixels. Neighbouring bins of a smoothed estimate share counts, which this keeps and a variance for each bin would not. Bins without a weight count as 0.
    """
    number = (F.col("a").cast("long") * shape[0] + F.col("r")) * shape[1] + F.col("z")
    cells = variance.withColumnRenamed("value", "var").withColumn("i", number)

    def terms(x: DataFrame) -> DataFrame:
        every = cells.join(x, "i", "left").fillna(0.0, ["value"])
        smooth = smooth_scatter(every.select(*CELL, "value"), sigmas)
        return smooth.join(cells, list(CELL)).select("i", (F.col("var") * F.col("value") * F.col("value")).alias("value"))

    return terms


def window_variance(
    projections: DataFrame, widths: dict[int, float], peak: int, lower: int, upper: int | None = None, weight_lower: float = 0.5, weight_upper: float = 0.5, *, sigmas: dict[str, float], shape: tuple[int, int],
) -> Callable[[DataFrame], DataFrame]:
    """``smoothed_variance`` of the scatter that ``window_estimate`` gives with the same arguments."""
    plain = window_estimate(projections, widths, peak, lower, upper, weight_lower, weight_upper)
    return smoothed_variance(plain.select(*CELL, F.col("variance").alias("value")), sigmas, shape)


def stray_scatter(blank: DataFrame, mask: DataFrame, duration_ratio: float, widths: dict[int, float], peak: int, lower: int, upper: int | None = None, weight_lower: float = 0.5, weight_upper: float = 0.5) -> DataFrame:
    """One row, value: the scatter that the stray counts of a blank scan's windows would be taken for in the peak window."""
    wide = None
    for w in [lower, *([] if upper is None else [upper])]:
        one = stray_mean(blank.filter(F.col("window") == w), mask, duration_ratio).withColumnRenamed("value", f"w_{w}")
        wide = one if wide is None else wide.join(one)  # one row each
    low, high = F.col(f"w_{lower}"), None if upper is None else F.col(f"w_{upper}")
    return wide.select(window_scatter(low, high, widths[lower], 1.0 if upper is None else widths[upper], widths[peak], weight_lower, weight_upper).alias("value"))


def subsampled_views(views: DataFrame, angles: int, first: int = 0) -> DataFrame:
    """Views (a, ..) of every ``angles``-th angle from ``first``, numbered anew, as ``subsample`` does with counts."""
    kept = views.filter((F.col("a") >= first) & (F.pmod(F.col("a") - first, F.lit(angles)) == 0))
    return kept.withColumn("a", F.floor((F.col("a") - first) / angles).cast("int"))
