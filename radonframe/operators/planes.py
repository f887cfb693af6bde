"""Volumes whose planes share one matrix: no coupling along the axis, as in parallel-beam SPECT without blur along it.

An image of up to ``rays.MAX_VOXELS`` values is broadcast: each bin is then one row of its voxels, weights and counts, and a sub-iteration one
pass over the bins of its subset that projects, compares and back projects at once. A larger image goes through joins:

An image has a row for each in-plane voxel and chunk of ``WIDTH`` planes, (j, c, z0, z1, ..), and projections one for each in-plane bin and
chunk, (i, c, z0, z1, ..). A join with the in-plane matrix (i, j, h) then serves a chunk's planes at once, and sums run over columns; a chunk is
as wide as compiled code takes well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut, kept
from . import rays

DELTA = 1e-11
WIDTH = 8


def wide(rows: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(key, c, z0, ..) of rows (key, z, value); absent ones are 0, as are planes beyond the last one."""
    sums = [F.sum(F.when(F.col("z") % width == k, F.col("value")).otherwise(0.0)).alias(f"z{k}") for k in range(width)]
    return rows.groupBy(key, F.floor(F.col("z") / width).cast("int").alias("c")).agg(*sums)


def long(rows: DataFrame, key: str, planes: int) -> DataFrame:
    """(key, z, value) of rows (key, c, z0, ..)."""
    names = _planes(rows)
    each = rows.select(key, "c", F.posexplode(F.array(*names)).alias("k", "value"))
    return each.select(key, (F.col("c") * len(names) + F.col("k")).alias("z"), "value").filter(F.col("z") < planes)


def _planes(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("i", "j", "c")]


def _sums(h: DataFrame, rows: DataFrame, on: str, to: str) -> DataFrame:
    return h.join(rows, on).groupBy(to, "c").agg(*[F.sum(F.col("h") * F.col(c)).alias(c) for c in _planes(rows)])


def forward(h: DataFrame, image: DataFrame) -> DataFrame:
    return _sums(h, image, "j", "i")


def backward(h: DataFrame, projections: DataFrame) -> DataFrame:
    return _sums(h, projections, "i", "j")


def spect_matrix(turns: DataFrame, n: int) -> DataFrame:
    """(i, j, h) of a stencil of turned voxels (a, x, y, xi, yi, w): i = a * n + r, j = x * n + y; bins add up along the detector's axis."""
    return turns.groupBy((F.col("a") * n + F.col("y")).cast("long").alias("i"), (F.col("xi") * n + F.col("yi")).cast("long").alias("j")).agg(F.sum("w").alias("h"))


def osem(h: DataFrame, data: DataFrame, iterations: int, subset: Column | None = None, subsets: int = 1, image: DataFrame | None = None, delta: float = DELTA) -> DataFrame:
    """The image (j, c, z0, ..) after the iterations, from projections (i, c, z0, ..). subset: the number of a bin's subset, by i; the remainder by default."""
    names = _planes(data)
    h, data = cut(h), cut(data)
    chunks = 1 + (data.agg(F.max("c")).first()[0] or 0)
    voxels = h.agg(F.approx_count_distinct("j", 0.01)).first()[0] if image is None else image.select("j").distinct().count()
    if 1.2 * voxels * (chunks * len(names) + subsets) <= rays.MAX_VOXELS:
        return _osem_broadcast(h, data, iterations, subset, subsets, image, delta, chunks)
    number = (F.pmod("i", F.lit(subsets)) if subset is None else subset).cast("int").alias("m")
    h, data = kept(h.withColumn("m", number), "i"), kept(data.withColumn("m", number), "i")
    norms = cut(h.groupBy("j", "m").agg(F.sum("h").alias("norm")))
    if image is None:
        image = norms.select("j").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("j", "c", *[F.lit(1.0).alias(c) for c in names])
    for _ in range(iterations):
        for m in range(subsets):
            own, bins, norm = (x.filter(F.col("m") == m).drop("m") for x in (h, data, norms))
            seen = forward(own, image).select("i", "c", *[F.col(c).alias(f"f_{c}") for c in names])
            ratio = bins.join(seen, ["i", "c"]).select("i", "c", *[(F.col(c) / (F.col(f"f_{c}") + delta)).alias(c) for c in names])
            back = backward(own, ratio).select("j", "c", *[F.col(c).alias(f"b_{c}") for c in names])
            rows = image.join(norm, "j", "left").join(back, ["j", "c"], "left").fillna(0.0)
            new = [F.col(c) + F.col(c) / (F.col("norm") + delta) * (F.col(f"b_{c}") - F.col("norm")) for c in names]
            image = cut(rows.select("j", "c", *[F.greatest(v, F.lit(0.0)).alias(c) for v, c in zip(new, names, strict=True)]))
    return image


def _pass(held, delta: float, width: int, chunks: int):
    """(at, c, z0, ..): the back projection of the ratios of one subset's bins, summed within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        js, f = held.value
        out = np.zeros_like(f)
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy()
            at = np.searchsorted(js, b.column(0).flatten().to_numpy())
            h, g = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            seen = np.add.reduceat(h[:, None] * f[at], np.cumsum(sizes) - sizes, axis=0)
            back = h[:, None] * np.repeat(g / (seen + delta), sizes, axis=0)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            out[at[order][first]] += np.add.reduceat(back[order], first, axis=0)
        for lo in range(0, len(out), 4096):
            some = out[lo : lo + 4096].reshape(-1, width)
            on = np.flatnonzero(some.any(axis=1))
            place = lo * chunks + on
            yield pa.RecordBatch.from_arrays([pa.array(place // chunks), pa.array((place % chunks).astype(np.int32)), *[pa.array(some[on, k]) for k in range(width)]], ["at", "c", *[f"z{k}" for k in range(width)]])

    return run


def _osem_broadcast(h: DataFrame, data: DataFrame, iterations: int, subset: Column | None, subsets: int, image: DataFrame | None, delta: float, chunks: int) -> DataFrame:
    """``osem`` of an image that every task can hold."""
    spark, names = h.sparkSession, _planes(data)
    width, entry = len(names), F.collect_list(F.struct("j", "h"))
    none = F.array(*[F.lit(0.0)] * width)
    lines = F.map_from_entries(F.collect_list(F.struct("c", F.array(*names))))
    counts = data.groupBy("i").agg(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.coalesce(F.element_at(lines, c), none))).alias("g"))
    number = (F.pmod("i", F.lit(subsets)) if subset is None else subset).cast("int")
    # a bin's voxels are those along its line
    bins = h.groupBy("i").agg(F.transform(entry, lambda e: e["j"]).alias("js"), F.transform(entry, lambda e: e["h"]).alias("hs")).join(counts, "i", "left")
    bins = cut(bins.select(number.alias("m"), "js", "hs", F.coalesce("g", F.flatten(F.array(*[none] * chunks))).alias("g")).repartition(*[int(spark.conf.get("spark.sql.shuffle.partitions"))]))
    sums = bins.select("m", F.explode(F.arrays_zip("js", "hs")).alias("e")).groupBy(F.col("e.js").alias("j"), "m").agg(F.sum("e.hs").alias("norm")).toArrow()
    start = None if image is None else image.toArrow()
    js = np.unique(np.concatenate([sums.column("j").to_numpy(), [] if start is None else start.column("j").to_numpy()]).astype(np.int64))
    norms = np.zeros((subsets, len(js)))
    norms[sums.column("m").to_numpy(), np.searchsorted(js, sums.column("j").to_numpy())] = sums.column("norm").to_numpy()
    f = np.ones((len(js), chunks * width))
    if start is not None:
        f[:] = 0.0
        at, c = np.searchsorted(js, start.column("j").to_numpy()), start.column("c").to_numpy()
        for k, name in enumerate(names):
            f[at, c * width + k] = start.column(name).to_numpy()
    for _ in range(iterations):
        for m in range(subsets):
            held = spark.sparkContext.broadcast((js, f))
            kinds = "at long, c int, " + ", ".join(f"z{k} double" for k in range(width))
            part = bins.filter(F.col("m") == m).select("js", "hs", "g").mapInArrow(_pass(held, delta, width, chunks), kinds)
            rows = part.groupBy("at", "c").agg(*[F.sum(f"z{k}").alias(f"z{k}") for k in range(width)]).toArrow()
            back = np.zeros_like(f).reshape(len(js), chunks, width)
            if rows.num_rows:
                back[rows.column("at").to_numpy(), rows.column("c").to_numpy()] = np.stack([rows.column(f"z{k}").to_numpy() for k in range(width)], axis=1)
            held.destroy()
            norm = norms[m][:, None]
            f = np.maximum(f + f / (norm + delta) * (back.reshape(f.shape) - norm), 0.0)
    every = pa.table({"j": np.repeat(js, chunks), "c": np.tile(np.arange(chunks, dtype=np.int32), len(js)), **{name: f.reshape(-1, width)[:, k] for k, name in enumerate(names)}})
    return cut(spark.createDataFrame(every))
