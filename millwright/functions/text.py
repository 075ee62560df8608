"""Labels and texts for charts and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_label(day: Column | str) -> Column:
    return F.date_format(day, "MMM yyyy")


def short_month(day: Column | str) -> Column:
    return F.date_format(day, "MMM")


def day_label(day: Column | str) -> Column:
    return F.date_format(day, "dd MMM yyyy")


def period_text(first: Column | str, last: Column | str) -> Column:
    return F.concat(day_label(first), F.lit(" to "), day_label(last))


def shortened(text: Column | str, length: int) -> Column:
    return F.substring(text, 1, length)


def with_suffix(number: Column | str, suffix: str) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(number.cast("string"), F.lit(suffix))


def thousands(number: Column | str, digits: int = 0) -> Column:
    """1234567.8 -> 1,234,568"""
    return F.format_number(number, digits)


def hash_bar(value: Column | str, scale: int) -> Column:
    """A row of # signs, one for each whole 1/scale of the value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.repeat(F.lit("#"), F.floor(value * scale).cast("int"))
