"""Classes and colours: a number in, a word out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed limits of the report.
STRONG, MODERATE, NEUTRAL = 0.6, 0.3, 0.05


def strength(corr: Column) -> Column:
    size = F.abs(corr)
    return F.when(size > STRONG, "Strong").when(size > MODERATE, "Moderate").otherwise("Weak")


def direction(corr: Column) -> Column:
    return (
        F.when(corr > NEUTRAL, "Positive (bad)")
        .when(corr < -NEUTRAL, "Negative (good)")
        .otherwise("Neutral")
    )


def status(value: Column, good: Column | float, bad: Column | float, reverse: bool = False) -> Column:
    """green, orange or red. With ``reverse`` a low value is good, as for a defect rate."""
    if reverse:
        return F.when(value <= good, "green").when(value >= bad, "red").otherwise("orange")
    return F.when(value >= good, "green").when(value <= bad, "red").otherwise("orange")


def trend(current: Column, previous: Column) -> Column:
    """up, down or same against the row before; empty where there is none."""
    return (
        F.when(previous.isNull(), "")
        .when(current > previous, "up")
        .when(current < previous, "down")
        .otherwise("same")
    )


def mean_band(value: Column, mean: Column, margin: float = 0.5) -> Column:
    """red when more than ``margin`` above the mean, orange when above it, else green."""
    return F.when(value > mean + margin, "red").when(value > mean, "orange").otherwise("green")


def peak_band(value: Column, peak: Column, mean: Column) -> Column:
    """red for the highest, orange when above the mean, else blue."""
    return F.when(value == peak, "red").when(value > mean, "orange").otherwise("blue")


def gauge_band(value: Column, limits: tuple[float, float] = (3.0, 5.0)) -> Column:
    good, warning = limits
    return F.when(value < good, "good").when(value < warning, "warning").otherwise("danger")


def percent_of(value: Column, highest: Column | float) -> Column:
    """Whole percent of a maximum, at most 100."""
    highest = F.lit(highest) if isinstance(highest, (int, float)) else highest
    return F.least(F.lit(100), F.round(F.try_divide(value, highest) * 100).cast("int"))
