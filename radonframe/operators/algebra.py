"""The sparse bilinear operator H as a table (i, j, h): projections are a join and a grouped sum.

Images are tables (j, value), projections (i, value). Which side is broadcast is left to the optimizer, which checks sizes. The four
projections below also take a ``systems.System`` in place of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix(rows: DataFrame, i: str, j: str, weight: Column) -> DataFrame:
    """(i, j, h): one row per pair, weights added up."""
    return rows.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.sum(weight).alias("h"))


def forward(h: DataFrame, image: DataFrame) -> DataFrame:
    """(i, value): sum over j of h * image."""
    if not isinstance(h, DataFrame):
        return h.forward(image)
    return h.join(image, "j").groupBy("i").agg(F.sum(F.col("h") * F.col("value")).alias("value"))


def backward(h: DataFrame, projections: DataFrame) -> DataFrame:
    """(j, value): sum over i of h * projections."""
    if not isinstance(h, DataFrame):
        return h.backward(projections)
    return h.join(projections, "i").groupBy("j").agg(F.sum(F.col("h") * F.col("value")).alias("value"))


def normalization(h: DataFrame) -> DataFrame:
    """(j, value): the back projection of ones."""
    if not isinstance(h, DataFrame):
        return h.normalization()
    return h.groupBy("j").agg(F.sum("h").alias("value"))


def row_sums(h: DataFrame) -> DataFrame:
    """(i, value): the forward projection of ones."""
    if not isinstance(h, DataFrame):
        return h.row_sums()
    return h.groupBy("i").agg(F.sum("h").alias("value"))


def subset(rows: DataFrame, number: int | None, of: int, key: str = "i") -> DataFrame:
    """The rows whose key is in a strided subset; all of them with one subset or no number."""
    return rows if number is None or of == 1 else rows.filter(F.pmod(F.col(key), F.lit(of)) == number)


def subset_weights(h: DataFrame, of: int) -> DataFrame:
    """(subset, weight): each subset's share of the projections' rows."""
    rows = h.select("i").distinct()
    per = rows.groupBy(F.pmod("i", F.lit(of)).cast("int").alias("subset")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("all"))
    return per.join(F.broadcast(total)).select("subset", (F.col("n") / F.col("all")).alias("weight"))  # one row


def stack(matrices: Sequence[DataFrame]) -> DataFrame:
    """(k, i, j, h) of several matrices over one image."""
    out = matrices[0].withColumn("k", F.lit(0))
    for k, m in enumerate(matrices[1:], 1):
        out = out.unionByName(m.withColumn("k", F.lit(k)))
    return out


def stacked_forward(h: DataFrame, image: DataFrame) -> DataFrame:
    """(k, i, value). The image may have a column k, one image for each matrix, as for motion."""
    on = ["k", "j"] if "k" in image.columns else ["j"]
    return h.join(image, on).groupBy("k", "i").agg(F.sum(F.col("h") * F.col("value")).alias("value"))


def stacked_backward(h: DataFrame, projections: DataFrame) -> DataFrame:
    """(j, value), summed over the matrices."""
    return h.join(projections, ["k", "i"]).groupBy("j").agg(F.sum(F.col("h") * F.col("value")).alias("value"))


def compose(h: DataFrame, k: DataFrame) -> DataFrame:
    """The matrix H * K, of H (i, j, h) and an image-space operator K (j, l, w), as (i, j, h)."""
    return h.join(k, "j").groupBy("i", "l").agg(F.sum(F.col("h") * F.col("w")).alias("h")).withColumnRenamed("l", "j")


def transpose_apply(k: DataFrame, image: DataFrame) -> DataFrame:
    """(j, value) of the transpose of K (j, l, w) applied to an image over j."""
    return k.join(image, "j").groupBy(F.col("l").alias("j")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def apply(k: DataFrame, image: DataFrame) -> DataFrame:
    """(j, value) of K (j, l, w) applied to an image over l."""
    return k.join(image.select(F.col("j").alias("l"), "value"), "l").groupBy("j").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
