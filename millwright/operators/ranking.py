"""Top rows, picks, flags and month-to-month trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.bands import trend
from millwright.operators.rollup import with_overall


def top_rows(df: DataFrame, by: str, ties: list[str], columns: list[str], n: int = 5) -> DataFrame:
    """The n rows highest in ``by``, ranked. Each task keeps n rows; only those meet."""
    kept = df.select(*dict.fromkeys([by, *ties, *columns])).orderBy(F.desc(by), *ties).limit(n)
    order = Window.orderBy(F.desc(by), *ties)  # over n rows
    return kept.withColumn("rank", F.row_number().over(order)).select("rank", *columns)


def pick(df: DataFrame, by: str, ties: list[str], highest: bool) -> DataFrame:
    """The one row highest (or lowest) in ``by``, the first in the order of ``ties`` among equals."""
    rows = df.where(F.col(by).isNotNull())
    return rows.orderBy(F.desc(by) if highest else F.asc(by), *ties).limit(1)


def best_and_worst(summary: DataFrame, rate: str, ties: list[str], columns: list[str]) -> DataFrame:
    """Two rows, ``which`` = best (lowest rate) and worst (highest), from one pass over the summary.

    Among equals the first in the order of ``ties`` is taken.
    """
    row = F.struct(*columns).alias("row")
    order = [F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)]
    best = F.min(F.struct(F.col(rate).alias("rate"), *order, row))
    worst = F.min(F.struct((-F.col(rate)).alias("rate"), *order, row))
    pair = F.array(
        F.struct(F.lit("best").alias("which"), best.getField("row").alias("row")),
        F.struct(F.lit("worst").alias("which"), worst.getField("row").alias("row")),
    )
    found = summary.where(F.col(rate).isNotNull()).agg(pair.alias("pair"))
    return found.select(F.inline("pair")).where("row IS NOT NULL").select("which", "row.*")


def with_best_worst(summary: DataFrame, rate: str) -> DataFrame:
    """Flags the rows at the lowest (best) and highest (worst) rate; a tie flags them all."""
    flagged = with_overall(summary, _low=F.min(rate), _high=F.max(rate))
    return flagged.withColumns(
        {"is_best": F.col(rate) == F.col("_low"), "is_worst": F.col(rate) == F.col("_high")}
    ).drop("_low", "_high")


def with_trend(months: DataFrame, rate: str, month: str = "month", out: str = "trend") -> DataFrame:
    """up, down or same against the month before. One task: there are only so many months."""
    before = F.lag(rate).over(Window.orderBy(month))
    return months.withColumn(out, trend(F.col(rate), before))


def points(df: DataFrame, category: str, x: str, y: str) -> DataFrame:
    """Scatter data: every row as (category, x, y); take ``.sample(...)`` of it to draw less."""
    return df.select(
        F.col(category).alias("category"), F.col(x).cast("double").alias("x"), F.col(y).alias("y")
    )


def sample_per_group(df: DataFrame, by: list[str], keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """``k`` rows of every group, or all of a smaller one: those whose seeded MD5 of the keys is smallest.

    The same rows are drawn whatever the partitioning, here or in another engine. A task hands on at most ``k`` rows of
    a group, so a group that holds most of the table costs no more than another. NULL is a group like the others.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys]))
    placed = df.withColumn("_order", order)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_order", *keys))
    return placed.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_order", "_rank")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for the distinct values of each column, from one pass."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return long.where(F.col("value").isNotNull()).distinct()
