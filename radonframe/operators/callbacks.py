"""What a solver calls after each sub-iteration: (image, iteration, subset) to an image that takes its place, or None."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .likelihoods import _expected

Callback = Callable[[DataFrame, int, int], DataFrame | None]


def several(*callbacks: Callback) -> Callback:
    """One after the other, each on what the one before it gave."""

    def run(image: DataFrame, n: int, m: int) -> DataFrame:
        for c in callbacks:
            changed = c(image, n, m)
            image = image if changed is None else changed
        return image

    return run


class Iterates:
    """Keeps the image before each sub-iteration and after the last one; with H and the measurements, also the expected counts of each."""

    def __init__(self, initial: DataFrame, h: DataFrame | None = None, data: DataFrame | None = None):
        self.images, self.h, self.data = [initial], h, data

    def __call__(self, image: DataFrame, n: int, m: int) -> None:
        self.images.append(image)

    def table(self) -> DataFrame:
        """(k, j, value) of all of them; solvers have checkpointed them."""
        out = self.images[0].withColumn("k", F.lit(0))
        for k, image in enumerate(self.images[1:], 1):
            out = out.unionByName(image.withColumn("k", F.lit(k)))
        return out.select("k", "j", "value")

    def expected(self, k: int) -> DataFrame:
        """(i, value): the expected counts of an iterate, with the additive term."""
        return _expected(self.h, self.data, self.images[k]).select("i", (F.col("fp") + F.col("s")).alias("value"))


def every(n: int, callback: Callback) -> Callback:
    """After each ``n``-th iteration's sub-iterations only."""
    return lambda image, k, m: callback(image, k, m) if (k + 1) % n == 0 else None
