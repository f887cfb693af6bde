"""Scalar physics as Column expressions; energies in keV unless named otherwise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ELECTRON_KEV = 511.0
ELECTRON_RADIUS_CM = 2.818e-13
THOMSON_CM2 = 6.65e-25
FWHM_PER_SIGMA = 2 * math.sqrt(2 * math.log(2))


def photon_energy_after_scatter(cos_theta: Column, energy: float | Column = ELECTRON_KEV) -> Column:
    """Energy after Compton scattering by an angle."""
    e = energy if isinstance(energy, Column) else F.lit(float(energy))
    return e / (1 + e / ELECTRON_KEV * (1 - cos_theta))


def compton_differential(cos_theta: Column, energy: Column) -> Column:
    """Klein-Nishina differential cross section."""
    p = 1 / (1 + energy / ELECTRON_KEV * (1 - cos_theta))
    return F.lit(ELECTRON_RADIUS_CM**2 / 2) * p * (1 - p * (1 - cos_theta * cos_theta) + p * p)


def compton_total(energy: Column) -> Column:
    """Klein-Nishina total cross section in cm^2."""
    a = energy / ELECTRON_KEV
    near = (1 + a) / (a * a) * (2 * (1 + a) / (1 + 2 * a) - F.log(1 + 2 * a) / a)
    return F.lit(0.75 * THOMSON_CM2) * (near + F.log(1 + 2 * a) / (2 * a) - (1 + 3 * a) / ((1 + 2 * a) * (1 + 2 * a)))


def erf(x: Column) -> Column:
    """Error function by its all-positive series within |x| < 6, which double precision cannot tell from 1 beyond.

    erf(x) = 2/sqrt(pi) exp(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!; 120 terms settle it to about 1e-15.
    """
    a = F.least(F.abs(x), F.lit(6.0))
    step = lambda s, n: F.struct((s["t"] * 2 * a * a / (2 * n + 1)).alias("t"), (s["sum"] + s["t"] * 2 * a * a / (2 * n + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(a.alias("t"), a.alias("sum")), step, lambda s: s["sum"])
    return F.signum(x) * F.least(F.lit(1.0), F.lit(2 / math.sqrt(math.pi)) * F.exp(-a * a) * series)


def detector_efficiency(energy: Column, resolution: float = 0.15, threshold: float = 430.0) -> Column:
    """Share of photons of an energy that the threshold accepts, for a resolution (FWHM as a share of 511 keV, the same at all energies)."""
    sigma = ELECTRON_KEV * resolution / FWHM_PER_SIGMA
    return 0.5 * (1 - erf((F.lit(threshold) - energy) / (math.sqrt(2) * sigma)))


def dual_sqrt_exponential(energy: Column, c1: float, c2: float, d1: float, d2: float) -> Column:
    return F.lit(c1) * F.exp(-d1 * F.sqrt(energy)) + F.lit(c2) * F.exp(-d2 * F.sqrt(energy))


def bilinear_mu(hu: Column, a1: Column | float, a2: Column | float, b1: Column | float, b2: Column | float) -> Column:
    """Attenuation from Hounsfield units: one line below 0, one from 0 on, never negative."""
    return F.greatest(F.when(hu < 0, hu * a1 + b1).otherwise(hu * a2 + b2), F.lit(0.0))


def hu_to_mu(hu: Column, water: Column | float, air: Column | float) -> Column:
    return hu / 1000 * (F.lit(water) - F.lit(air)) + water if not isinstance(water, Column) else hu / 1000 * (water - air) + water


def ramp(w: Column) -> Column:
    return F.abs(w)


def hamming(w: Column, low: float, high: float) -> Column:
    """1 up to ``low``, a raised cosine, 0 from ``high``; in units of half the sampling frequency."""
    a, lo, hi = F.abs(w), low / 2, high / 2
    return F.when(a <= lo, 1.0).when(a >= hi, 0.0).otherwise(0.5 * (1 + F.cos(math.pi * (a - lo) / (hi - lo))))


def psf_sigma(distance: Column, hole_diameter: float, hole_length: float, mu: float, intrinsic: float = 0.0) -> Column:
    """Width of a parallel-hole collimator's response at a distance, with the detector's own."""
    a = hole_diameter / (hole_length - 2 / mu) / FWHM_PER_SIGMA
    b = hole_diameter / FWHM_PER_SIGMA
    return F.sqrt((a * distance + b) * (a * distance + b) + intrinsic * intrinsic)


def geometric_correction(radius: Column, cylinder: float, delta: float) -> Column:
    share = F.abs(radius) / cylinder
    return 1 / (F.sqrt(1 - share * share) + delta)


def digitize(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value among equal bins: -1 below the first edge, ``bins`` from the last edge on."""
    return (F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)) - 1).cast("int")


def tof_efficiency(offsets: Column, centres: Column, sigma: float) -> Column:
    """Array by offset of arrays by centre: Gaussian weights of the centres around each offset, those of a centre adding up to 1 over the offsets."""
    raw = F.transform(offsets, lambda o: F.transform(centres, lambda c: F.exp(-(o - c) * (o - c) / (2 * sigma * sigma))))
    none = F.transform(centres, lambda c: F.lit(0.0))
    total = F.aggregate(raw, none, lambda s, r: F.zip_with(s, r, lambda x, y: x + y))
    return F.transform(raw, lambda r: F.zip_with(r, total, lambda x, t: F.when(t > 0, x / t).otherwise(0.0)))


@dataclass(frozen=True)
class TimeBins:
    """Time bins spread evenly about the middle of lines: their number, their whole range and the width of the uncertainty (FWHM), in mm."""

    number: int
    range: float
    fwhm: float

    @property
    def width(self) -> float:
        return self.range / self.number

    @property
    def sigma(self) -> float:
        return self.fwhm / 2.355

    @property
    def edges(self) -> list[float]:
        return [self.range * (k / self.number - 0.5) for k in range(self.number + 1)]

    @property
    def centres(self) -> list[float]:
        return [(k - self.number / 2 + 0.5) * self.width for k in range(self.number)]


def collimator_response(hole_diameter: float, hole_length: float, mu: float, intrinsic: float = 0.0, intrinsic_140: float | None = None, energy: float = 140.0, shape: str = "gaussian") -> tuple[float, float, float]:
    """(a, b, c) of a response's width sqrt((a d + b)^2 + c^2) at a distance d: its standard deviation, or of square holes half their shadow.

    intrinsic, intrinsic_140: the crystal's resolution (FWHM) at the energy or at 140 keV, from which it falls with the root of the energy.
    """
    slope = hole_diameter / (hole_length - 2 / mu)
    if shape == "square":
        return slope / 2, hole_diameter / 2, 0.0
    own = intrinsic if intrinsic_140 is None else intrinsic_140 * math.sqrt(140.0 / energy)
    return slope / FWHM_PER_SIGMA, hole_diameter / FWHM_PER_SIGMA, own / FWHM_PER_SIGMA


def response_width(distance: Column, response: tuple[float, float, float]) -> Column:
    a, b, c = response
    return F.sqrt((a * distance + b) * (a * distance + b) + c * c)
