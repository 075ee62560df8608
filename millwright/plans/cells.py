"""One pass over the runs for a whole report: a settled table of cells, which every roll-up is matched to.

A cell is a machine, a shift and a month (and a product, if asked for). It holds sums and counts, so any coarser summary
is a sum of cells, equal to what the runs themselves would give; its highest run says in which cells the highest runs
of all are to be looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import metrics
from millwright.operators.rollup import Rollup, rounded
from millwright.operators.star import dimension, runs
from millwright.session import settle
from millwright.sources.tables import FactoryTables

KEYS = ("machine_id", "shift", "month")
_SUMS = {"total_units": "units_made", "total_defects": "units_defective", "total_downtime": "downtime_hrs", "lost": "lost"}
_MEANS = {"avg_downtime": "downtime_hrs", "avg_temp": "temperature"}
#: What a cell holds of sums alone, and with the measures of the runs themselves, which cost more to take.
PLAIN = Rollup(_SUMS, _MEANS, "total_runs")
FULL = Rollup(_SUMS, {**_MEANS, "avg_efficiency": "efficiency", "mean_defect_rate": "rate"}, "total_runs")


@dataclass(frozen=True)
class Cells:
    """Runs that have all their dimensions, by machine, shift and month; rates and efficiencies of runs rounded to
    ``digits``. ``table`` also has first_date, last_date and, where ``sums`` is FULL, top_rate, the highest rate of a run."""

    table: DataFrame
    keys: tuple[str, ...]
    digits: int | None
    sums: Rollup = FULL
    #: Whether the table has the roll-ups by each single key and the total, told apart by ``set``, in place of cells.
    singly: bool = False

    def _by(self, *keys: str) -> DataFrame:
        rows = self.table
        if self.singly:
            rows = rows.where(F.col("set") == sum(1 << (len(self.keys) - 1 - i) for i, k in enumerate(self.keys) if k not in keys))
        return self.sums.finished(self.sums.again(rows, *keys, extra=_span()))

    def by(self, *keys: str) -> DataFrame:
        """Sums and means by some of the keys. Cells with a NULL key belong to no group."""
        return self._by(*keys)

    def machines(self, t: FactoryTables) -> DataFrame:
        named = self.by("machine_id").join(dimension(t, "machines", ("machine_name", "department", "age_years")), "machine_id")
        return rounded(_rate(named), avg_downtime=2, avg_temp=1).select(
            "machine_id", "total_units", "total_defects", "avg_downtime", "avg_temp", "machine_name", "department",
            "age_years", "defect_rate",
        ).orderBy(F.desc("defect_rate"), "machine_id")

    def shifts(self) -> DataFrame:
        return _rate(self.by("shift")).select("shift", "total_units", "total_defects", "defect_rate").orderBy(
            F.desc("defect_rate"), "shift"
        )

    def months(self) -> DataFrame:
        named = self.by("month").withColumn("month", metrics.month_key("month"))
        return rounded(_rate(named, "defect_pct"), avg_downtime=2, avg_temp=1).select(
            "month", "total_units", "total_defects", "avg_downtime", "avg_temp", "defect_pct"
        ).orderBy("month")

    def totals(self) -> DataFrame:
        """One row of sums and means over all cells, with what was lost and the span of dates."""
        whole = self._by()
        if self.sums is PLAIN:
            whole = whole.withColumn("avg_efficiency", F.lit(None).cast("decimal(38,6)"))
        return whole.withColumnRenamed("lost", "total_revenue_lost").drop("mean_defect_rate")

    def highest_runs(self, t: FactoryTables, n: int) -> FactoryTables:
        """``t`` with only those runs that can be among the ``n`` of the highest rates.

        They lie in the n cells whose highest runs are highest (and in cells level with the last of them). Where those are
        few, the machines and months are told to the scan, so the fact is not read again but looked up.
        """
        if self.sums is PLAIN:
            return t
        bound = self.table.select("top_rate").where("top_rate is not null").orderBy(F.desc("top_rate")).limit(n)
        low = bound.agg(F.min("top_rate").alias("low")).first().low
        if low is None:
            return _with_runs(t, F.lit(False))
        cells = self.table.where(F.col("top_rate") >= F.lit(low)).select("machine_id", "month").distinct()
        few = cells.limit(MOST_CELLS + 1).collect()
        if len(few) > MOST_CELLS:
            return t
        wanted = F.lit(False)
        for cell in few:
            days = F.col("prod_date").isNull()
            if cell.month is not None:
                days = F.col("prod_date").between(F.lit(cell.month), F.last_day(F.lit(cell.month)))
            wanted = wanted | ((F.col("machine_id") == F.lit(cell.machine_id)) & days)
        return _with_runs(t, wanted)


#: So many cells are looked up one by one; level with more, all runs are read.
MOST_CELLS = 50


def _with_runs(t: FactoryTables, wanted: Column) -> FactoryTables:
    from dataclasses import replace

    return replace(t, production=t.production.where(wanted))


def _span() -> list[Column]:
    return [F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]


def _rate(df: DataFrame, name: str = "defect_rate") -> DataFrame:
    return df.withColumn(name, metrics.rounded_ratio("total_defects", "total_units"))


def _added(t: FactoryTables, digits: int | None, sums: Rollup, joined: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """Runs with what a cell adds up, and what it holds beside the sums."""
    derived = {"month": F.trunc("prod_date", "MM"), "lost": F.col("units_defective") * F.col("price_per_unit")}
    extra = [F.min("prod_date").alias("first_date"), F.max("prod_date").alias("last_date")]
    if sums is FULL:
        derived |= {"efficiency": metrics.efficiency(digits), "rate": metrics.defect_rate(digits)}
        extra.append(F.max("rate").alias("top_rate"))
    return (runs(t, "products") if joined is None else joined).withColumns(derived), extra


def cells(t: FactoryTables, keys: tuple[str, ...] = KEYS, digits: int | None = 2, sums: Rollup = FULL) -> Cells:
    """The cells of all runs that have a machine, an employee and a product, added up in one pass and settled."""
    run, extra = _added(t, digits, sums)
    return Cells(settle(sums.cells(run, *keys, extra=extra)), keys, digits, sums)


def single_keys(t: FactoryTables, keys: tuple[str, ...] = KEYS, joined: DataFrame | None = None) -> Cells:
    """The same for summaries by one key at a time: a task hands on a row a machine, a shift and a month, not one for
    every three of them, so this is the smaller table where machines are many. ``joined`` are the runs that have all their
    dimensions, with their product's price, where a caller keeps them."""
    run, extra = _added(t, None, PLAIN, joined)
    sets = run.groupingSets([*[[k] for k in keys], []], *keys)
    table = PLAIN.added(sets, [*extra, F.grouping_id(*keys).alias("set")])
    return Cells(settle(table), keys, None, PLAIN, singly=True)
