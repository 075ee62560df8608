"""Group summaries in one or two steps.

Sums and means are kept as sums and counts until the end, so a fact table can be added up by a
dimension's key first (map-side, whatever key is hot) and only the small result be joined with that
dimension and added up again by one of its columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.session import settle


@dataclass(frozen=True)
class Rollup:
    """Output name -> input column, for the sums and the means; ``runs`` names the row count."""

    sums: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)
    runs: str | None = None

    def by(self, fact: DataFrame, *keys: str, extra: list[Column] | None = None) -> DataFrame:
        """Adds up the fact. Rows with a NULL key belong to no group."""
        return self.added(_grouped(fact, keys), extra)

    def cells(self, fact: DataFrame, *keys: str, extra: list[Column] | None = None) -> DataFrame:
        """Adds up the fact by keys of which some summaries take only a few: a NULL key is kept as a key."""
        return self.added(fact.groupBy(*keys), extra)

    def added(self, grouped, extra: list[Column] | None = None) -> DataFrame:
        """Adds up a fact grouped in whatever way."""
        parts = [F.sum(column).alias(name) for name, column in self.sums.items()]
        for name, column in self.means.items():
            parts += [F.sum(column).alias(f"{name}_sum"), F.count(column).alias(f"{name}_n")]
        if self.runs:
            parts.append(F.count(F.lit(1)).alias(self.runs))
        return grouped.agg(*parts, *(extra or []))

    def again(self, summary: DataFrame, *keys: str, extra: list[Column] | None = None) -> DataFrame:
        """Adds up a summary made by ``by``."""
        names = [*self.sums]
        names += [f"{name}_{part}" for name in self.means for part in ("sum", "n")]
        if self.runs:
            names.append(self.runs)
        return _grouped(summary, keys).agg(*[F.sum(n).alias(n) for n in names], *(extra or []))

    def finished(self, summary: DataFrame) -> DataFrame:
        """Means from their sums and counts; a mean of decimals stays decimal, so that it rounds exactly."""
        means = {n: F.try_divide(f"{n}_sum", F.col(f"{n}_n").cast("decimal(20,0)")) for n in self.means}
        parts = [f"{n}_{part}" for n in self.means for part in ("sum", "n")]
        return summary.withColumns(means).drop(*parts) if means else summary


def _grouped(df: DataFrame, keys: tuple[str, ...]):
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*keys)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Rounds the named columns, as doubles."""
    return df.withColumns({name: F.round(name, n).cast("double") for name, n in digits.items()})


def with_overall(summary: DataFrame, **overall: Column) -> DataFrame:
    """Adds aggregates over the whole summary to each of its rows.

    The summary is settled first, so the fact behind it is read once however many rows the summary
    has, and the totals come back as a scalar rather than through a one-task window.
    """
    summary = settle(summary)
    totals = summary.agg(F.struct(*[c.alias(name) for name, c in overall.items()]).alias("t")).scalar()
    return summary.withColumns({name: totals.getField(name) for name in overall})


def with_share(summary: DataFrame, value: str, out: str = "share_pct", digits: int = 1) -> DataFrame:
    """Each row's percent of the column's total."""
    share = F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double")) * 100
    return (
        with_overall(summary, _total=F.sum(value))
        .withColumn(out, F.round(share, digits))
        .drop("_total")
    )
