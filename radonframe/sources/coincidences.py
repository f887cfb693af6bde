"""Simulated and clinical coincidences: which events count, what their detectors are, and the weights that come with them.

Simulated events have, for both photons, numbers of sector, module, submodule and crystal (rsector_1, .., crystal_2), where they came from
(x_1, .., z_2), how often they scattered in the body (compton_1, rayleigh_1, ..), and times in seconds (time_1, time_2).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import LEVELS, Scanner, detector_id, split_id

MM_PER_PS = 0.15  # light goes both ways


def is_random() -> Column:
    """Whether the photons of an event came from different places."""
    same = (F.col("x_1") == F.col("x_2")) & (F.col("y_1") == F.col("y_2")) & (F.col("z_1") == F.col("z_2"))
    return ~same


def is_scattered() -> Column:
    return F.col("compton_1") + F.col("compton_2") + F.col("rayleigh_1") + F.col("rayleigh_2") != 0


def chosen(events: DataFrame, randoms: bool = True, scatters: bool = True, randoms_only: bool = False, scatters_only: bool = False) -> DataFrame:
    """The events of the wanted kinds. Scatters alone are those that are no randoms; randoms alone come before scatters alone."""
    if randoms_only:
        return events.filter(is_random())
    if scatters_only:
        return events.filter(is_scattered() & ~is_random())
    if not randoms:
        events = events.filter(~is_random())
    return events if scatters else events.filter(~is_scattered())


def detectors(events: DataFrame, scanner: Scanner, edges: Sequence[float] | None = None, place: Column | None = None) -> DataFrame:
    """Events with detector_1, detector_2 and, given edges of time bins in mm, tof: -1 below the first, the number of bins from the last on, null without a place.

    place: in mm along the line, for events that have it; else it is that of the times, whose products round, so what lies on an edge may fall below it.
    """
    for k in (1, 2):
        parts = {}
        for level in LEVELS:
            parts[f"{level}_trans"], parts[f"{level}_axial"] = split_id(F.col(f"{level}_{k}"), getattr(scanner, f"{level}_trans"))
        events = events.withColumn(f"detector_{k}", detector_id(parts, scanner))
    if edges is not None:
        if place is None:
            place = -(F.col("time_2") - F.col("time_1")) * 1e12 * MM_PER_PS
        tof = sum((F.when(place >= e, 1).otherwise(0) for e in edges[1:]), F.when(place >= edges[0], 1).otherwise(0)) - 1
        events = events.withColumn("tof", F.when(place.isNotNull(), tof.cast("int")))
    return events


def clinical_detectors(events: DataFrame, per_ring: int, names: tuple[str, str, str, str] = ("ring_1", "crystal_1", "ring_2", "crystal_2")) -> DataFrame:
    """Events of rings and crystals with detector_1 and detector_2."""
    r1, c1, r2, c2 = map(F.col, names)
    return events.withColumns({"detector_1": (r1 * per_ring + c1).cast("int"), "detector_2": (r2 * per_ring + c2).cast("int")})


def correction_weight(attenuation: Column, sensitivity: Column) -> Column:
    return attenuation * sensitivity


def scanner_of_macro(spark: SparkSession, path: str, crystal: str = "crystal", depth: float = 0.0, min_sector_difference: int = 0) -> Scanner:
    """The scanner that a simulator's macro describes: volumes within volumes, each repeated as an array, a line or a ring.

    A macro is some dozens of lines, which the driver reads.
    """
    lines = [r["value"] for r in spark.read.text(path).collect()]

    def values(command: str) -> list[str] | None:
        for line in lines:
            if re.search(re.escape(command), line):
                return line.split()[1:]
        return None

    def number(command: str, at: int = 0) -> float:
        found = values(command)
        return float(found[at]) if found else 0.0

    found: dict[str, float] = {"submodule_trans": 1, "submodule_axial": 1}
    for level in LEVELS:
        kinds = [line.split()[1] for line in lines if f"/gate/{level}/repeaters/insert" in line]
        for kind in kinds:
            at = f"/gate/{level}/{kind}"
            if kind == "cubicArray":
                counts = [number(f"{at}/setRepeatNumber{c}") for c in "XYZ"]
                across = 0 if counts[0] >= counts[1] else 1
                found |= {f"{level}_trans": counts[across], f"{level}_axial": counts[2], f"{level}_trans_spacing": number(f"{at}/setRepeatVector", across), f"{level}_axial_spacing": number(f"{at}/setRepeatVector", 2)}
            elif kind == "linear":
                found |= {f"{level}_axial": number(f"{at}/setRepeatNumber"), f"{level}_axial_spacing": number(f"{at}/setRepeatVector", 2)}
            elif kind == "ring":
                found |= {f"{level}_trans": number(f"{at}/setRepeatNumber"), f"{level}_axial": 1}
    centre = sum(number(f"/gate/{level}/placement/setTranslation") for level in (*LEVELS, "world"))
    radius = centre - number(f"/gate/{crystal}/geometry/setXLength") / 2 + depth
    whole = {k: v if k.endswith("spacing") else int(v) for k, v in found.items() if not k.startswith("rsector") or not k.endswith("spacing")}
    return Scanner(**whole, radius=radius, min_sector_difference=min_sector_difference)
