"""Preconditioned gradient ascent: a driver loop over relational plans.

Every sub-iteration is f + C(f) * (likelihood gradient - w * prior gradient), w the subset's share of the measured bins, values at or
below a floor set to it, and its result is checkpointed. The system is a stored matrix or any other ``systems.System``. Where there are more
than ``FEW`` sub-iterations, it and the measurements are kept once, dealt to tasks by i: the joins on i and the forward projection's sums
need no further shuffle of them; with fewer, keeping them costs more than it saves. The subsets' normalisations are computed once.

``blocks`` makes one plan of many independent systems, as beds are: a bin's and a voxel's block (of the same number) are told by it, and
shares and peaks are each block's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut, kept
from . import algebra, likelihoods
from .rays import filter_lines
from .systems import Subsets, System, system

DELTA = likelihoods.DELTA
FEW = 2
Prior = Callable[[DataFrame], DataFrame]
Callback = Callable[[DataFrame, int, int], DataFrame | None]


@dataclass
class Parts:
    """What a preconditioner may use, as columns of one table over j."""

    f: Column = field(default_factory=lambda: F.col("value"))
    norm: Column = field(default_factory=lambda: F.col("norm"))  # of the subset
    whole: Column = field(default_factory=lambda: F.col("whole"))  # of all subsets
    prior: Column = field(default_factory=lambda: F.col("prior"))  # of the subset's share
    share: Column = field(default_factory=lambda: F.col("share"))  # of the measured bins that the subset has


@dataclass
class Solver:
    """precondition: C(f); gradient: of the likelihood, given the subset's matrix and data; fov: (j, value), scales of the prior's gradient by voxel."""

    h: DataFrame | System
    data: DataFrame
    precondition: Callable[[Parts, Column, int], Column]
    gradient: Callable[..., DataFrame] = likelihoods.poisson_gradient
    prior: Prior | None = None
    floor: float = 0.0
    uses_peak: bool = False  # of (norm + prior) / (whole + prior + delta), one number per sub-iteration
    image: DataFrame | None = None
    fov: DataFrame | None = None
    sensitivity: DataFrame | None = None  # (j, value) of the whole system where H has rows of measured events only; subsets have their share of it
    blocks: Callable[[Column], Column] | None = None

    def run(self, iterations: int, subsets: int | Subsets = 1, only: int | None = None, callback: Callback | None = None) -> DataFrame:
        """The image after the iterations; it is kept, so a later call goes on from there. callback: what it returns after a sub-iteration takes the image's place."""
        subsets = subsets if isinstance(subsets, Subsets) else Subsets(subsets)
        many = iterations * (subsets.count if only is None else 1) > FEW
        whole_h = system(self.h).kept() if many else system(self.h)
        data = kept(self.data, "i") if many else self.data
        block = (lambda key: F.lit(0)) if self.blocks is None else self.blocks
        number = subsets.of(F.col("i")).alias("m")
        counts = data.groupBy(number, block(F.col("i")).alias("block")).agg(F.count("*").alias("n"))
        totals = counts.groupBy("block").agg(F.sum("n").alias("all"))
        shares = cut(counts.join(totals, "block").select("m", "block", (F.col("n") / F.col("all")).alias("share")))  # one row for each subset and block
        if self.sensitivity is None:
            norms = cut(whole_h.normalizations(subsets))
        else:
            seen = self.sensitivity.withColumn("block", block(F.col("j"))).join(F.broadcast(shares), "block")
            norms = cut(seen.select("j", "m", (F.col("value") * F.col("share")).alias("norm")))
        whole = norms.groupBy("j").agg(F.sum("norm").alias("whole"))
        image = (whole if isinstance(self.h, DataFrame) or self.sensitivity is not None else whole_h.voxels()).select("j", F.lit(1.0).alias("value")) if self.image is None else self.image
        for n in range(iterations):
            for m in range(subsets.count) if only is None else [only]:
                own, bins = (whole_h, data) if subsets.count == 1 else (whole_h.part(subsets, m), data.filter(subsets.of(F.col("i")) == m))
                norm = norms.filter(F.col("m") == m).drop("m")
                step = self.gradient(own, bins, image, norm=norm.withColumnRenamed("norm", "value")).withColumnRenamed("value", "step")
                rows = image.join(whole, "j", "left").join(norm, "j", "left").join(step, "j", "left").fillna(0.0).withColumn("block", block(F.col("j")))
                rows = rows.join(F.broadcast(shares.filter(F.col("m") == m).select("block", "share")), "block", "left").fillna(0.0, ["share"])
                if self.prior is None:
                    rows = rows.withColumn("prior", F.lit(0.0))
                else:
                    rows = rows.join(self.prior(image).withColumnRenamed("value", "prior"), "j", "left").fillna(0.0).withColumn("prior", F.col("prior") * F.col("share"))
                    if self.fov is not None:
                        rows = rows.join(self.fov.withColumnRenamed("value", "fov"), "j", "left").fillna(0.0, ["fov"]).withColumn("prior", F.col("prior") * F.col("fov")).drop("fov")
                if self.uses_peak:
                    peaks = cut(rows.groupBy("block").agg(F.max((F.col("norm") + F.col("prior")) / (F.col("whole") + F.col("prior") + DELTA)).alias("peak")))  # one row for each block
                    rows = rows.join(F.broadcast(peaks), "block")
                new = F.col("value") + self.precondition(Parts(), F.col("peak"), n) * (F.col("step") - F.col("prior"))
                image = cut(rows.select("j", F.when(new <= self.floor, self.floor).otherwise(new).alias("value")))
                if callback:
                    changed = callback(image, n, m)
                    image = image if changed is None else changed
        self.image = image
        return image


def osem(h: DataFrame | System, data: DataFrame) -> Solver:
    """C = f / (H_m^T 1 + delta). With one subset, MLEM."""
    return Solver(h, data, lambda p, *_: p.f / (p.norm + DELTA))


def osmaposl(h: DataFrame | System, data: DataFrame, prior: Prior) -> Solver:
    """C = f / (H_m^T 1 + prior gradient + delta)."""
    return Solver(h, data, lambda p, *_: p.f / (p.norm + p.prior + DELTA), prior=prior)


def rbiem(h: DataFrame | System, data: DataFrame) -> Solver:
    """C = f / (H^T 1 * peak + delta), peak the largest H_m^T 1 / (H^T 1 + delta)."""
    return Solver(h, data, lambda p, peak, _: p.f / (p.whole * peak + DELTA), uses_peak=True)


def rbimap(h: DataFrame | System, data: DataFrame, prior: Prior) -> Solver:
    """C = f / (H^T 1 * peak + prior gradient + delta), peak with the prior's gradient above and below."""
    return Solver(h, data, lambda p, peak, _: p.f / (p.whole * peak + p.prior + DELTA), prior=prior, uses_peak=True)


def bsrem(h: DataFrame | System, data: DataFrame, prior: Prior | None = None, relaxation: Callable[[int], float] = lambda n: 1.0) -> Solver:
    """C = f * relaxation(n) / (w * H^T 1 + delta), w the subset's share of the bins; values at or below 1e-4 become 1e-4."""
    return Solver(h, data, lambda p, _, n: p.f * relaxation(n) / (p.share * p.whole + DELTA), prior=prior, floor=1e-4)


def sart(h: DataFrame | System, data: DataFrame, relaxation: Callable[[int], float] = lambda n: 1.0) -> Solver:
    """Weighted least squares; C = relaxation(n) / (H_m^T 1 + delta)."""
    return Solver(h, data, lambda p, _, n: F.lit(float(relaxation(n))) / (p.norm + DELTA), gradient=likelihoods.sart_gradient)


def kem(h: DataFrame, data: DataFrame, kernel: DataFrame, iterations: int, subsets: int = 1) -> DataFrame:
    """OSEM on the coefficients of a kernel (j, l, w); the image is the kernel applied to them."""
    return algebra.apply(kernel, osem(algebra.compose(h, kernel), data).run(iterations, subsets))


def uncertainty(
    h: DataFrame | System, data: DataFrame, iterates: list[DataFrame], mask: DataFrame, subsets: int | Subsets = 1, curvature: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    additive_variance: DataFrame | Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row (value, percent): the standard deviation of the masked sum of the last of ``iterates`` of OSEM (all sub-iterations and the first image), to first order in the counts.

    V = sum over n of B_n (Q_(n+1) ... Q_last mask), with Q_n x = d(f_(n+1))/d(f_n)^T x and B_n the same for the counts; the variance is the sum
    of V^2 g. curvature(f, x): the prior's second derivative at f times x, of which a subset's share acts. additive_variance: (i, value), variances
    of the additive term's independent bins, or, where it was smoothed, a function of V (i, value) that gives the terms of its quadratic form
    (``counts.smoothed_variance``); they add the same sum for it. after: a linear filter of the image, which is its own transpose, before the
    mask is applied.
    """
    subsets = subsets if isinstance(subsets, Subsets) else Subsets(subsets)
    h, data = system(h).kept(), kept(data, "i")
    norms = cut(h.normalizations(subsets))
    shares = {r["m"]: r["n"] for r in data.groupBy(subsets.of(F.col("i")).alias("m")).agg(F.count("*").alias("n")).collect()}  # one row for each subset
    mask = mask if after is None else cut(after(iterates[-1].select("j").join(mask, "j", "left").fillna(0.0, ["value"])))
    x = iterates[-1].select("j").join(mask, "j", "left").fillna(0.0, ["value"])  # what is not in the mask counts as 0
    v, w = None, None
    add = lambda whole, part: part if whole is None else whole.unionByName(part).groupBy("i").agg(F.sum("value").alias("value"))
    for n in range(len(iterates) - 2, -1, -1):
        m = n % subsets.count
        own, bins = (h, data) if subsets.count == 1 else (h.part(subsets, m), data.filter(subsets.of(F.col("i")) == m))
        f, following, norm = iterates[n], iterates[n + 1].withColumnRenamed("value", "following"), norms.filter(F.col("m") == m).drop("m")
        scaled = x.withColumnRenamed("value", "x").join(f, "j").join(norm, "j").select("j", (F.col("x") * F.col("value") / (F.col("norm") + DELTA)).alias("value"))
        v = cut(add(v, likelihoods.gradient_gf(own, bins, f, scaled)))
        if additive_variance is not None:
            w = cut(add(w, likelihoods.gradient_sf(own, bins, f, scaled)))
        if n:
            curve = likelihoods.gradient_ff(own, bins, f, scaled).withColumnRenamed("value", "curve")
            keep = x.withColumnRenamed("value", "x").join(f, "j").join(following, "j").join(curve, "j", "left")
            new = F.coalesce("curve", F.lit(0.0)) + F.col("following") / (F.col("value") + DELTA) * F.col("x")
            if curvature is not None:
                keep = keep.join(curvature(f, scaled).withColumnRenamed("value", "bent"), "j", "left")
                new = new - F.coalesce("bent", F.lit(0.0)) * (shares.get(m, 0) / sum(shares.values()))
            x = cut(keep.select("j", new.alias("value")))
    square = lambda t, c: t.select((F.col("value") * F.col("value") * F.col(c)).alias("s"))
    terms = square(data.join(v, "i"), "g")
    if w is not None and not isinstance(additive_variance, DataFrame):
        terms = terms.unionByName(additive_variance(w).select(F.col("value").alias("s")))
    elif w is not None:
        terms = terms.unionByName(square(w.join(additive_variance.withColumnRenamed("value", "var"), "i"), "var"))
    total = iterates[-1].join(mask.withColumnRenamed("value", "in"), "j").agg(F.sum(F.col("value") * F.col("in")).alias("total"))
    return terms.agg(F.sqrt(F.sum("s")).alias("value")).join(F.broadcast(total)).select("value", (F.col("value") / F.col("total") * 100).alias("percent"))  # one row


def filtered_back_projection(h: DataFrame, projections: DataFrame, angles: int, bins: int, window: Callable | None = None) -> DataFrame:
    """(j, value): back projection of ramp-filtered projections (i, value), i = angle * bins + bin, times pi over the number of angles.

    window: a further filter, of the frequency's share of its largest. A line of bins is a task's group, as long as the detector is wide.
    """
    lines = projections.select(F.floor(F.col("i") / bins).cast("long").alias("angle"), F.pmod("i", F.lit(bins)).cast("long").alias("bin"), "value")
    filtered = filter_lines(lines, ["angle"], "bin", window).select((F.col("angle") * bins + F.col("bin")).alias("i"), "value")
    return algebra.backward(h, filtered).withColumn("value", F.col("value") * F.lit(math.pi / angles))


def dip_step(em: DataFrame, network: DataFrame, dual: DataFrame, rho: float, norm: DataFrame) -> DataFrame:
    """(j, value): the closed-form update between an EM image, a network's output and the dual variable."""
    t = em.withColumnRenamed("value", "em").join(network.withColumnRenamed("value", "net"), "j").join(dual.withColumnRenamed("value", "dual"), "j").join(norm.withColumnRenamed("value", "norm"), "j")
    u = F.col("net") - F.col("dual") - F.col("norm") / rho
    return t.select("j", (0.5 * u + 0.5 * F.sqrt(u * u + 4 * F.col("em") * F.col("norm") / rho)).alias("value"))


def dip(h: DataFrame | System, data: DataFrame, network: Callable[[DataFrame, int], DataFrame], rho: float, iterations: int, subsets: int = 1, em_steps: int = 1) -> DataFrame:
    """The network's last output (j, value), by alternating steps: EM and its closed-form update, a fit of the network to what it is to give, and the dual variable.

    network(label, n): the output (j, value) of a network fitted to ``label`` in iteration n; what it is and where it runs is the caller's. Its
    output for an image of ones, n = 0, is where the iterations start.
    """
    solver = osem(h, data)
    norm = cut(algebra.normalization(system(h)))
    positive = lambda x: x.withColumn("value", F.greatest("value", F.lit(0.0)))
    image = out = cut(network(norm.select("j", F.lit(1.0).alias("value")), 0))
    dual = norm.select("j", F.lit(0.0).alias("value"))
    for n in range(iterations):
        for _ in range(em_steps):
            for m in range(subsets):
                solver.image = positive(image)
                em = solver.run(1, subsets, only=m)
                image = cut(dip_step(em, out, dual, rho, norm))
        label = image.join(dual.withColumnRenamed("value", "dual"), "j").select("j", (F.col("value") + F.col("dual")).alias("value"))
        out = cut(network(label, n + 1))
        moved = dual.withColumnRenamed("value", "dual").join(image, "j").join(out.withColumnRenamed("value", "net"), "j")
        dual = cut(moved.select("j", (F.col("dual") + F.col("value") - F.col("net")).alias("value")))
    return positive(out)
