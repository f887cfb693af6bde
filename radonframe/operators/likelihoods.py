"""Objectives and their gradients, over H (i, j, h) and measurements (i, g, s): counts and the additive term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra

DELTA = 1e-11


def _expected(h: DataFrame, data: DataFrame, image: DataFrame) -> DataFrame:
    """(i, g, s, fp): measurements beside the forward projection, 0 where no voxel is seen."""
    fp = algebra.forward(h, image).withColumnRenamed("value", "fp")
    return data.join(fp, "i", "left").withColumn("fp", F.coalesce("fp", F.lit(0.0)))


def poisson_gradient(h: DataFrame, data: DataFrame, image: DataFrame, delta: float = DELTA, norm: DataFrame | None = None) -> DataFrame:
    """(j, value): H^T (g / (H f + s + delta)) - H^T 1."""
    ratio = _expected(h, data, image).select("i", (F.col("g") / (F.col("fp") + F.col("s") + delta)).alias("value"))
    norm = (algebra.normalization(h) if norm is None else norm).withColumnRenamed("value", "norm")
    return norm.join(algebra.backward(h, ratio), "j", "left").select("j", (F.coalesce("value", F.lit(0.0)) - F.col("norm")).alias("value"))


def poisson_log_likelihood(h: DataFrame, data: DataFrame, image: DataFrame, delta: float = DELTA) -> DataFrame:
    """One row, value: sum of g log(H f + s) - (H f + s)."""
    e = _expected(h, data, image).withColumn("e", F.col("fp") + F.col("s"))
    return e.agg(F.sum(F.col("g") * F.log(F.col("e") + delta) - F.col("e")).alias("value"))


def gradient_ff(h: DataFrame, data: DataFrame, image: DataFrame, x: DataFrame, delta: float = DELTA) -> DataFrame:
    """(j, value): -H^T (H x * g / (e^2 + delta)), e the expected counts."""
    e = _expected(h, data, image).withColumn("e", F.col("fp") + F.col("s"))
    hx = algebra.forward(h, x)
    return algebra.backward(h, e.join(hx, "i").select("i", (-F.col("value") * F.col("g") / (F.col("e") * F.col("e") + delta)).alias("value")))


def gradient_gf(h: DataFrame, data: DataFrame, image: DataFrame, x: DataFrame, delta: float = DELTA) -> DataFrame:
    """(i, value): H x / (e + delta)."""
    e = _expected(h, data, image)
    return e.join(algebra.forward(h, x), "i").select("i", (F.col("value") / (F.col("fp") + F.col("s") + delta)).alias("value"))


def gradient_sf(h: DataFrame, data: DataFrame, image: DataFrame, x: DataFrame, delta: float = DELTA) -> DataFrame:
    """(i, value): -H x * g / (e + delta)^2."""
    e = _expected(h, data, image).withColumn("e", F.col("fp") + F.col("s") + delta)
    return e.join(algebra.forward(h, x), "i").select("i", (-F.col("value") * F.col("g") / (F.col("e") * F.col("e"))).alias("value"))


def mse_gradient(h: DataFrame, data: DataFrame, image: DataFrame, scale: float = 1.0, norm: DataFrame | None = None) -> DataFrame:
    """(j, value): scale * H^T (g - H f - s)."""
    rest = _expected(h, data, image).select("i", ((F.col("g") - F.col("fp") - F.col("s")) * scale).alias("value"))
    return algebra.backward(h, rest)


def sart_gradient(h: DataFrame, data: DataFrame, image: DataFrame, delta: float = DELTA, norm: DataFrame | None = None) -> DataFrame:
    """(j, value): H^T ((g - H f - s) / (H 1 + delta))."""
    rest = _expected(h, data, image).join(algebra.row_sums(h), "i")
    return algebra.backward(h, rest.select("i", ((F.col("g") - F.col("fp") - F.col("s")) / (F.col("value") + delta)).alias("value")))
