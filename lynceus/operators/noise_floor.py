"""Expected error in pixels at a depth, and the classes and scores that follow from it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in for a figure the sensor's data sheet lacks.
DEFAULT_ANGLE_DEG, DEFAULT_RANGE_M, DEFAULT_EDGE_PX = 0.2, 0.02, 0.5


@dataclass(frozen=True)
class Floor:
    fx: float
    angle_deg: float = DEFAULT_ANGLE_DEG
    baseline_m: float = 0.1
    range_m: float = DEFAULT_RANGE_M
    edge_px: float = DEFAULT_EDGE_PX

    @property
    def angular(self) -> float:
        return self.fx * math.radians(self.angle_deg)

    def ranging(self, depth: Column) -> Column:
        return F.lit(self.fx * self.baseline_m * self.range_m) / (depth * depth)

    def at(self, depth: Column, strict: bool = False) -> Column:
        """Null where the depth is not positive; with ``strict`` that is an error."""
        ahead = F.when(depth > 0, depth)
        if strict:
            ahead = ahead.otherwise(F.when(depth <= 0, F.raise_error(F.lit("depth must be positive")).cast("double")))
        return F.sqrt(F.lit(self.angular**2 + self.edge_px**2) + F.pow(self.ranging(ahead), F.lit(2)))

    def dominant(self, depth: Column) -> Column:
        """The largest of the three terms by name; the first of equals."""
        best = F.greatest(F.lit(self.angular), self.ranging(depth), F.lit(self.edge_px))
        return F.when(best == self.angular, "angular").when(best == self.ranging(depth), "range").otherwise("edge")


def resolved_inputs(rigs: DataFrame) -> DataFrame:
    """Adds angle_deg, range_m, edge_px, baseline_m, three flags for what was not given, and warnings.

    ``rigs``: h_res_deg, v_res_deg, channels, vfov_deg, range_acc_m, edge_floor_px (all nullable), fx, tx, ty, tz. The
    coarser of both angular steps counts; a missing vertical one is the field of view over the channels. fx must be positive.
    """
    stacked = F.when((F.col("channels") > 0) & F.col("v_res_deg").isNull(), F.col("vfov_deg") / F.col("channels"))
    angle = F.greatest("h_res_deg", F.coalesce("v_res_deg", stacked))
    none_given, guessed = angle.isNull(), stacked.isNotNull() | angle.isNull()
    warned = F.array(
        F.when(none_given, "no angular resolution given; default used").when(stacked.isNotNull(), "vertical resolution taken from field of view and channels"),
        F.when(F.col("range_acc_m").isNull(), "no range accuracy given; default used"),
        F.when(F.col("edge_floor_px").isNull(), "no edge localisation floor given; default used"),
    )
    fx = F.when(F.col("fx") > 0, F.col("fx")).otherwise(F.raise_error(F.lit("fx must be positive")).cast("double"))
    return rigs.withColumns({
        "fx": fx, "angle_deg": F.coalesce(angle, F.lit(DEFAULT_ANGLE_DEG)), "range_m": F.coalesce("range_acc_m", F.lit(DEFAULT_RANGE_M)),
        "edge_px": F.coalesce("edge_floor_px", F.lit(DEFAULT_EDGE_PX)), "baseline_m": F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2),
        "angle_guessed": guessed, "range_guessed": F.col("range_acc_m").isNull(), "edge_guessed": F.col("edge_floor_px").isNull(), "warnings": F.array_compact(warned),
    })


def _absent(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def classify(value: Column, floor: Column, good: float = 2.0, warning: float = 5.0) -> Column:
    """GOOD, WARNING or BAD by multiples of the floor; FAIL where either is null or NaN."""
    return F.when(_absent(value) | _absent(floor), "FAIL").when(value < good * floor, "GOOD").when(value < warning * floor, "WARNING").otherwise("BAD")


def score(value: Column, floor: Column, good: float = 2.0, warning: float = 5.0) -> Column:
    """100 at 0, 80 at ``good`` floors, 50 at ``warning``; null where either is null or NaN or the floor is not positive. A negative value is an error."""
    power = math.log(0.25) / math.log(good / warning)
    measured = F.when(~_absent(value) & ~_absent(floor) & (floor > 0), value)
    sound = F.when(measured < 0, F.raise_error(F.lit("an error in pixels is never negative")).cast("double")).otherwise(measured)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 / (1 + F.pow(sound / floor / warning, F.lit(power))))) * F.when(sound.isNotNull(), 1)


def score_class(value: Column) -> Column:
    return F.when(_absent(value), "FAIL").when(value >= 80, "GOOD").when(value >= 50, "WARNING").otherwise("BAD")


#: Classes from best to worst.
RANKS = ("GOOD", "WARNING", "BAD", "FAIL")


def severity(kind: Column) -> Column:
    """0 to 3 from GOOD to FAIL; a missing or unknown class counts as FAIL."""
    return F.when(kind == "GOOD", 0).when(kind == "WARNING", 1).when(kind == "BAD", 2).otherwise(3)


def named(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RANKS)), level + 1)
