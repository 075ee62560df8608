"""Exact quantiles of a column, whole or by group, with linear interpolation.

Equal values are counted map-side first, so a hot group or value reaches the shuffle as few rows. The
counts are settled; everything else (quartiles, whiskers, outliers, moments) is read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.ordering import running_total
from millwright.session import settle

GROUP, VALUE, N, UPTO = "_group", "_value", "_n", "_upto"


def value_counts(df: DataFrame, value: str, by: str | None, groups: list) -> DataFrame:
    """(_group, _value, _n) of the non-NULL values in the listed groups."""
    group = F.lit(groups[0]) if by is None else F.col(by)
    pairs = df.select(group.alias(GROUP), F.col(value).cast("double").alias(VALUE))
    pairs = pairs.where(F.col(VALUE).isNotNull())
    if by is not None:
        pairs = pairs.where(F.col(GROUP).isin(groups))
    return settle(pairs.groupBy(GROUP, VALUE).agg(F.count(F.lit(1)).alias(N)))


def ranked(counts: DataFrame) -> DataFrame:
    """Adds _upto, the number of rows of the group up to the value, and _total, all its rows.

    The running total is taken slice by slice, so no group is ever in one task.
    """
    overall = settle(running_total(counts, [GROUP, VALUE], N, "_overall"))
    # One row for each listed group, so small enough to broadcast.
    starts = overall.groupBy(GROUP).agg(
        F.min(F.col("_overall") - F.col(N)).alias("_start"), F.sum(N).alias("_total")
    )
    return (
        overall.join(F.broadcast(starts), GROUP)
        .withColumn(UPTO, F.col("_overall") - F.col("_start"))
        .drop("_overall", "_start")
    )


def _interpolated(p: float):
    """The quantile from the two values whose ranks lie around p * (total - 1)."""
    place = (F.col("_total") - 1) * F.lit(float(p))
    low, high = F.floor(place), F.ceil(place)

    def at(rank):
        covers = (rank < F.col(UPTO)) & (rank >= F.col(UPTO) - F.col(N))
        return F.max(F.when(covers, F.col(VALUE)))

    share = F.max(place - low)
    return at(low) + share * (at(high) - at(low))


def from_counts(counts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """One row per group: _group and a column for each named probability."""
    rows = ranked(counts)
    return rows.groupBy(GROUP).agg(*[_interpolated(p).alias(n) for n, p in probabilities.items()])


#: Size of a sketch: ranks are off by less than half a percent, almost surely.
SKETCH_K = 800


def month_sketches(df: DataFrame, value: str, date: str, *by: str) -> DataFrame:
    """(by..., month, sketch): a mergeable KLL sketch of the values of every month, some kilobytes each.

    Kept as a table, it answers for any span of months without the rows, and a new month is one row more.
    """
    dated = df.withColumn("month", F.trunc(date, "MM")).where(F.col(value).isNotNull())
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K))
    return dated.groupBy(*by, "month").agg(sketch.alias("sketch"))


def from_sketches(
    sketches: DataFrame, probabilities: dict[str, float], *by: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Quantiles of a span of months (both ends included, as dates), a column for each named probability, and ``n``."""
    if first is not None:
        sketches = sketches.where(F.col("month") >= F.to_date(F.lit(first)))
    if last is not None:
        sketches = sketches.where(F.col("month") <= F.to_date(F.lit(last)))
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in probabilities.items()]
    return merged.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *found)


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: str | None = None,
    groups: list | None = None,
    approx: bool = False,
) -> DataFrame:
    """Quantiles of ``value``, one column for each named probability.

    With ``by`` one row for each value listed in ``groups`` that occurs. ``approx`` trades exactness
    for one pass with a small sketch.
    """
    if by is not None and not groups:
        raise ValueError("list the groups to report")
    if approx:
        if by is not None:
            df = df.where(F.col(by).isin(groups))
        found = [
            F.percentile_approx(F.col(value).cast("double"), p, 10_000).alias(n)
            for n, p in probabilities.items()
        ]
        return df.groupBy(by).agg(*found) if by else df.agg(*found)
    counts = value_counts(df, value, by, groups or ["all"])
    found = from_counts(counts, probabilities)
    return found.withColumnRenamed(GROUP, by) if by else found.drop(GROUP)
