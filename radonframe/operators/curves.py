"""Curves of attenuation by energy, fitted to tables of materials, and the conversion of CT numbers that follows from a scan's own bone peak.

The curve of a material is c1 exp(-d1 sqrt(E)) + c2 exp(-d2 sqrt(E)), fitted by least squares, one group of rows for each material. The
best fit does not depend on starting values; equal ones for both terms, as some programs take, would keep them equal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import density_peak

LOW, HIGH = 50.0, 550.0  # keV, the range of the tables
STARTS, STEPS = 48, 300  # places tried along each d, and the most steps from one start


@dataclass(frozen=True)
class Curve:
    c1: float
    c2: float
    d1: float
    d2: float

    def at(self, energy: float) -> float:
        return self.c1 * math.exp(-self.d1 * math.sqrt(energy)) + self.c2 * math.exp(-self.d2 * math.sqrt(energy))


def least_squares(energy: np.ndarray, mu: np.ndarray) -> tuple[float, float, float, float]:
    """(c1, c2, d1, d2) of the best curve: from the best pairs (d1, d2) of a coarse grid, damped Gauss-Newton steps."""
    root, d = np.sqrt(energy), np.geomspace(1e-3, 3.0, STARTS)
    e = np.exp(-d[:, None] * root)
    gram, b = e @ e.T, e @ mu
    one, two = np.triu_indices(STARTS, 1)
    det = gram[one, one] * gram[two, two] - gram[one, two] ** 2
    c1, c2 = (b[one] * gram[two, two] - b[two] * gram[one, two]) / det, (b[two] * gram[one, one] - b[one] * gram[one, two]) / det
    rest = ((mu - c1[:, None] * e[one] - c2[:, None] * e[two]) ** 2).sum(axis=1)
    best, least = None, np.inf
    for k in np.argsort(np.where(np.isfinite(rest), rest, np.inf), kind="stable")[:8]:
        p, damp = np.array([c1[k], c2[k], d[one[k]], d[two[k]]]), 1e-3
        model = lambda p: p[0] * np.exp(-p[2] * root) + p[1] * np.exp(-p[3] * root)
        now = ((mu - model(p)) ** 2).sum()
        for _ in range(STEPS):
            f1, f2 = np.exp(-p[2] * root), np.exp(-p[3] * root)
            slopes = np.stack([f1, f2, -p[0] * root * f1, -p[1] * root * f2], axis=1)
            size = np.maximum(np.linalg.norm(slopes, axis=0), 1e-300)
            system, right = np.concatenate([slopes / size, math.sqrt(damp) * np.eye(4)]), np.concatenate([mu - model(p), np.zeros(4)])
            step = np.linalg.lstsq(system, right, rcond=None)[0] / size
            after = ((mu - model(p + step)) ** 2).sum()
            if after < now:
                p, now, damp = p + step, after, max(damp * 0.2, 1e-18)
                if (np.abs(step) <= 1e-14 * np.abs(p)).all():
                    break
            elif damp > 1e8:
                break
            else:
                damp *= 5
        if now < least:
            best, least = p, now
    c1, c2, d1, d2 = best.tolist()
    return (c1, c2, d1, d2) if d1 <= d2 else (c2, c1, d2, d1)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    fit = least_squares(rows["energy"].to_numpy(float), rows["mu"].to_numpy(float))
    return pd.DataFrame([(rows["material"].iloc[0], *fit)], columns=["material", "c1", "c2", "d1", "d2"])


def fit_curves(materials: DataFrame) -> DataFrame:
    """(material, c1, c2, d1, d2): the least-squares curve of each material (material, energy in keV, mu), d1 <= d2; a table of a material is a group.

    Defined cases: rows with a null energy or attenuation take no part, and a material with fewer than four others has no curve; repeated
    rows count as often as they come; an empty table gives an empty result; further columns are ignored. Reruns agree.
    """
    rows = materials.select(F.col("material").cast("string"), F.col("energy").cast("double"), F.col("mu").cast("double")).dropna(subset=["energy", "mu"])
    enough = rows.groupBy("material").count().filter("count >= 4").select("material")
    return rows.join(enough, "material").groupBy("material").applyInPandas(_fit, "material string, c1 double, c2 double, d1 double, d2 double")


def curves_of(materials: DataFrame, names: Sequence[str]) -> list[Curve]:
    """The curves of a few materials by name."""
    fits = {r["material"]: Curve(r["c1"], r["c2"], r["d1"], r["d2"]) for r in fit_curves(materials.filter(F.col("material").isin(*names))).collect()}
    return [fits[n] for n in names]


def ct_number(material: Curve, water: Curve, air: Curve, energy: float) -> float:
    """The CT number of a material at one energy."""
    return (material.at(energy) - water.at(energy)) / (water.at(energy) - air.at(energy)) * 1000


def energy_of_bone(number: float, bone: Curve, water: Curve, air: Curve) -> float:
    """The energy between ``LOW`` and ``HIGH`` at which bone has the CT number, or comes nearest to it in attenuation."""
    miss = lambda e: bone.at(e) - number / 1000 * (water.at(e) - air.at(e)) - water.at(e)
    at = np.linspace(LOW, HIGH, 1001).tolist()
    values = [miss(e) for e in at]
    crossing = [k for k in range(1000) if values[k] == 0 or values[k] * values[k + 1] < 0]
    if not crossing:
        return at[int(np.argmin(np.abs(values)))]
    lo, hi = at[min(crossing, key=lambda k: abs(at[k] - 115))], 0.0
    hi, sign = lo + (HIGH - LOW) / 1000, miss(lo)
    for _ in range(60):
        mid = (lo + hi) / 2
        if miss(mid) * sign > 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@dataclass(frozen=True)
class Conversion:
    """Two lines from CT numbers to attenuation, and the CT's effective energy that they come from."""

    a1: float
    b1: float
    a2: float
    b2: float
    ct_energy: float
    bone_peak: float | None


def conversion(numbers: DataFrame | None, peak_kv: float, energy: float, materials: DataFrame, names: Sequence[str] = ("air", "water", "bone")) -> Conversion:
    """The conversion for emission at an ``energy`` from a scan's CT numbers (value) and tables of air, water and bone.

    The CT's effective energy is that at which bone has the number of the scan's bone peak; without a peak, or numbers, 0.75 of its peak voltage.
    """
    air, water, bone = curves_of(materials, names)
    peak = None if numbers is None else density_peak(numbers)
    ct = 0.75 * peak_kv if peak is None else energy_of_bone(peak, bone, water, air)
    hu, mu = [ct_number(m, water, air, ct) for m in (air, water, bone)], [m.at(energy) for m in (air, water, bone)]
    return Conversion((mu[1] - mu[0]) / (hu[1] - hu[0]), mu[1], (mu[2] - mu[1]) / (hu[2] - hu[1]), mu[1], ct, peak)
