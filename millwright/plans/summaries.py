"""The group summaries and key figures.

Where a dimension only labels the groups, runs are added up by its key before they are joined with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions import metrics, text
from millwright.operators.rollup import Rollup, rounded, with_share
from millwright.operators.star import dimension, runs
from millwright.session import settle
from millwright.sources.tables import FactoryTables

#: So many shifts beyond the listed ones can be columns of a pivot.
MOST_SHIFTS = 500

UNITS = {"total_units": "units_made", "total_defects": "units_defective"}


def _rate(df: DataFrame, name: str = "defect_rate") -> DataFrame:
    """Ratio of the sums; not the mean of the runs' rates."""
    return df.withColumn(name, metrics.rounded_ratio("total_defects", "total_units"))


# --- production -----------------------------------------------------------------------------------


def production_summary(t: FactoryTables) -> DataFrame:
    """The check after loading: rows, sums and means over all runs, joined with nothing."""
    run = t.production.withColumn("rate", metrics.defect_rate())
    total = Rollup(
        {**UNITS, "total_downtime": "downtime_hrs"},
        {"mean_defect_rate": "rate", "avg_temp": "temperature"},
        "total_runs",
    )
    return rounded(total.finished(total.by(run)), mean_defect_rate=2, avg_temp=1, total_downtime=0)


def machine_performance(t: FactoryTables) -> DataFrame:
    total = Rollup(
        UNITS,
        {"avg_downtime": "downtime_hrs", "avg_temp": "temperature", "avg_vibration": "vibration_level"},
        "total_runs",
    )
    by_machine = total.finished(total.by(t.production, "machine_id"))
    table = by_machine.join(dimension(t, "machines"), "machine_id")
    table = rounded(_rate(table, "defect_rate_pct"), avg_downtime=2, avg_temp=1, avg_vibration=2)
    return table.select(
        "machine_id", "machine_name", "department", "age_years", "total_runs", "total_units",
        "total_defects", "defect_rate_pct", "avg_downtime", "avg_temp", "avg_vibration",
    ).orderBy(F.desc("defect_rate_pct"), "machine_id")


def shift_analysis(t: FactoryTables) -> DataFrame:
    total = Rollup(
        UNITS,
        {"avg_downtime": "downtime_hrs", "avg_temp": "temperature", "avg_efficiency": "efficiency"},
        "total_runs",
    )
    run = runs(t).withColumn("efficiency", metrics.efficiency())
    table = rounded(_rate(total.finished(total.by(run, "shift"))), avg_downtime=2, avg_efficiency=2, avg_temp=6)
    return table.orderBy(F.desc("defect_rate"), "shift")


def monthly_trend(t: FactoryTables) -> DataFrame:
    """By month, from the production table alone."""
    return _months(t.production, {"avg_downtime": 2, "avg_temp": 1})


def _months(run: DataFrame, digits: dict[str, int]) -> DataFrame:
    total = Rollup(UNITS, {"avg_downtime": "downtime_hrs", "avg_temp": "temperature"})
    dated = run.withColumn("month", F.trunc("prod_date", "MM"))  # text is made for the months, not for the runs
    table = total.finished(total.by(dated, "month")).withColumn("month", metrics.month_key("month"))
    return rounded(_rate(table, "defect_pct"), **digits).orderBy("month")


def report_months(t: FactoryTables) -> DataFrame:
    """By month, of runs that have all their dimensions."""
    return _months(runs(t), {"avg_downtime": 2, "avg_temp": 1})


def department_analysis(t: FactoryTables) -> DataFrame:
    total = Rollup({**UNITS, "total_downtime": "downtime_hrs"}, {"avg_temp": "temperature"})
    by_machine = total.by(runs(t, later="machines"), "machine_id").join(
        dimension(t, "machines", ("department",)), "machine_id"
    )
    counted = total.again(
        by_machine, "department", extra=[F.countDistinct("machine_id").alias("machine_count")]
    )
    table = rounded(_rate(total.finished(counted)), total_downtime=1, avg_temp=6)
    return table.orderBy(F.desc("defect_rate"), "department")


def _by_product(t: FactoryTables) -> DataFrame:
    """Sums by product id with the product's columns; what is lost is its defects at its list price."""
    total = Rollup(UNITS)
    by_id = total.by(runs(t, later="products"), "product_id")
    lost = F.col("total_defects") * F.col("price_per_unit")
    return by_id.join(dimension(t, "products"), "product_id").withColumn("revenue_lost", lost)


def product_analysis(t: FactoryTables) -> DataFrame:
    table = rounded(_rate(_by_product(t)), revenue_lost=2)
    return table.select(
        "product_id", "product_name", "category", "total_units", "total_defects", "revenue_lost", "defect_rate"
    ).orderBy(F.desc("revenue_lost"), "product_id")


def revenue_lost_by_product(t: FactoryTables) -> DataFrame:
    table = _by_product(t).groupBy("product_name").agg(F.sum("revenue_lost").alias("revenue_lost"))
    return rounded(table, revenue_lost=2).orderBy(F.desc("revenue_lost"), "product_name")


def machine_mean_rates(t: FactoryTables, round_rows: bool = False) -> DataFrame:
    """Mean of the runs' own rates by machine name, with mean downtime, units and mean temperature."""
    total = Rollup(
        {"total_units": "units_made"},
        {"mean_defect_rate": "rate", "avg_downtime": "downtime_hrs", "avg_temp": "temperature"},
    )
    run = runs(t, later="machines").withColumn("rate", metrics.defect_rate(2 if round_rows else None))
    named = total.by(run, "machine_id").join(dimension(t, "machines", ("machine_name",)), "machine_id")
    table = total.finished(total.again(named, "machine_name"))
    return rounded(table, mean_defect_rate=2, avg_downtime=2, avg_temp=2).orderBy(
        F.desc("mean_defect_rate"), "machine_name"
    )


def shift_summary(t: FactoryTables) -> DataFrame:
    total = Rollup(UNITS, {"avg_downtime": "downtime_hrs"})
    table = rounded(_rate(total.finished(total.by(runs(t), "shift"))), avg_downtime=6)
    return table.orderBy(F.desc("defect_rate"), "shift")


def machine_shift_pivot(t: FactoryTables, shifts: tuple[str, ...] = ("Evening", "Morning", "Night")) -> DataFrame:
    """Mean of the runs' rates, machines down and shifts across; NULL where a pair has no run.

    ``shifts`` always are columns, in this order; every other shift found follows in alphabetical order.
    """
    total = Rollup({}, {"rate": "rate"})
    run = runs(t, later="machines").withColumn("rate", metrics.defect_rate())
    # One row for each machine and shift, settled, so that looking for shifts reads no run again.
    named = settle(
        total.by(run, "machine_id", "shift").join(dimension(t, "machines", ("machine_name",)), "machine_id")
    )
    found = named.select("shift").where(~F.col("shift").isin(*shifts)).distinct().limit(MOST_SHIFTS + 1)
    others = [r.shift for r in found.collect()]
    if len(others) > MOST_SHIFTS:
        raise ValueError(f"more than {MOST_SHIFTS} shifts to be columns")
    across = [*shifts, *sorted(others)]
    mean = F.round(F.try_divide(F.sum("rate_sum"), F.sum("rate_n")), 2)
    wide = named.groupBy("machine_name").pivot("shift", across).agg(mean)
    return wide.select("machine_name", *[F.col(f"`{s}`").alias(s.lower()) for s in across]).orderBy("machine_name")


def department_means(t: FactoryTables) -> DataFrame:
    total = Rollup(
        {}, {"mean_defect_rate": "rate", "avg_downtime": "downtime_hrs", "avg_temp": "temperature"}
    )
    run = runs(t, later="machines").withColumn("rate", metrics.defect_rate())
    by_machine = total.by(run, "machine_id").join(dimension(t, "machines", ("department",)), "machine_id")
    table = rounded(
        total.finished(total.again(by_machine, "department")), mean_defect_rate=2, avg_downtime=2, avg_temp=2
    )
    return table.withColumn("avg_temp_tenth", F.round(F.col("avg_temp") / 10, 4)).orderBy(
        F.desc("mean_defect_rate"), "department"
    )


def department_losses(t: FactoryTables) -> DataFrame:
    """Units, downtime and money lost by department.

    Prices have two digits and defects are whole, so pricing the sums by machine and product loses nothing, and the runs
    themselves never meet the prices.
    """
    total = Rollup({**UNITS, "total_downtime": "downtime_hrs"})
    later = Rollup({**{n: n for n in total.sums}, "revenue_lost": "revenue_lost"})
    sums = total.by(_unpriced(t), "machine_id", "product_id")
    priced = _priced(t, sums, "revenue_lost").join(dimension(t, "machines", ("department",)), "machine_id")
    table = rounded(_rate(later.by(priced, "department")), total_downtime=1, revenue_lost=0)
    return table.orderBy("department")


def _unpriced(t: FactoryTables) -> DataFrame:
    """Runs with an employee; machine and product are joined after adding up by their keys."""
    fact = t.production
    return fact if "employees" in t.trusted else fact.join(dimension(t, "employees", ()), "emp_id")


def _priced(t: FactoryTables, sums: DataFrame, out: str) -> DataFrame:
    """Sums by product with their loss: defects at the list price."""
    lost = F.col("total_defects") * F.col("price_per_unit")
    return sums.join(dimension(t, "products", ("price_per_unit",)), "product_id").withColumn(out, lost)


def monthly_chart(t: FactoryTables) -> DataFrame:
    """Months for a chart: short label, units in thousands, rate and temperature."""
    return _months(runs(t), {"avg_temp": 6}).select(
        "month",
        text.short_month(F.to_date(F.concat("month", F.lit("-01")))).alias("month_label"),
        "total_units",
        (F.col("total_units") / 1000).alias("units_thousands"),
        "total_defects",
        "defect_pct",
        "avg_temp",
    )


def report_machines(t: FactoryTables) -> DataFrame:
    total = Rollup(UNITS, {"avg_downtime": "downtime_hrs", "avg_temp": "temperature"})
    by_machine = total.finished(total.by(runs(t, later="machines"), "machine_id"))
    table = by_machine.join(dimension(t, "machines", ("machine_name", "department", "age_years")), "machine_id")
    return rounded(_rate(table), avg_downtime=2, avg_temp=1).orderBy(F.desc("defect_rate"), "machine_id")


def report_shifts(t: FactoryTables) -> DataFrame:
    return shift_summary(t).drop("avg_downtime")


# --- sales and maintenance ------------------------------------------------------------------------


def _sold(t: FactoryTables) -> DataFrame:
    """Sales by product id: quantity, revenue and number of sales, with the product's name."""
    by_id = t.sales.groupBy("product_id").agg(
        F.sum("qty_sold").alias("total_qty"),
        F.sum("revenue").alias("total_revenue"),
        F.count("revenue").alias("n"),
    )
    return by_id.join(dimension(t, "products", ("product_name",)), "product_id")


def sales_by_product(t: FactoryTables) -> DataFrame:
    """By product name; avg_price is the mean revenue of a sale, as the name it carries in the files."""
    table = _sold(t).groupBy("product_name").agg(
        F.sum("total_qty").alias("total_qty"),
        F.sum("total_revenue").alias("total_revenue"),
        F.try_divide(F.sum("total_revenue"), F.sum("n").cast("decimal(20,0)")).alias("avg_price"),
    )
    return rounded(table, total_revenue=2, avg_price=6).orderBy(F.desc("total_revenue"), "product_name")


def sales_share(t: FactoryTables) -> DataFrame:
    return with_share(sales_by_product(t), "total_revenue")


def revenue_by_product(t: FactoryTables) -> DataFrame:
    table = _sold(t).groupBy("product_name").agg(F.sum("total_revenue").alias("revenue"))
    return rounded(table, revenue=2).orderBy(F.desc("revenue"), "product_name")


def _known_sales(t: FactoryTables) -> DataFrame:
    return t.sales.join(dimension(t, "products", ()), "product_id")


def monthly_sales(t: FactoryTables) -> DataFrame:
    sale = _known_sales(t).withColumn("month", F.trunc("sale_date", "MM"))
    table = Rollup({"revenue": "revenue"}).by(sale, "month").withColumn("month", metrics.month_key("month"))
    return rounded(table, revenue=2).orderBy("month")


def revenue_by_region(t: FactoryTables) -> DataFrame:
    """Sales without a region belong to none and are left out."""
    return rounded(Rollup({"revenue": "revenue"}).by(_known_sales(t), "region"), revenue=2).orderBy("region")


def maintenance_cost_by_type(t: FactoryTables) -> DataFrame:
    total = Rollup({"cost": "cost"})
    visit = t.maintenance.join(dimension(t, "machines", ()), "machine_id")
    return rounded(total.by(visit, "maint_type"), cost=2).orderBy("maint_type")


# --- key figures ----------------------------------------------------------------------------------


def _production_kpis(t: FactoryTables, round_rows: bool) -> DataFrame:
    run = _unpriced(t).withColumn("efficiency", metrics.efficiency(2 if round_rows else None))
    total = Rollup({**UNITS, "total_downtime": "downtime_hrs"}, {"avg_efficiency": "efficiency"})
    span = [F.min("prod_date").alias("first_date"), F.max("prod_date").alias("last_date")]
    sums = total.by(run, "machine_id", "product_id", extra=span)
    if "machines" not in t.trusted:
        sums = sums.join(dimension(t, "machines", ()), "machine_id")
    priced = _priced(t, sums, "lost")
    whole = [F.sum("lost").alias("total_revenue_lost"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]
    return total.finished(total.again(priced, extra=whole))


def kpi_summary(t: FactoryTables, round_rows: bool = False, made: DataFrame | None = None) -> DataFrame:
    """One row of key figures over the three facts; ``made`` brings those of the runs if they are known already."""
    made = _production_kpis(t, round_rows) if made is None else made
    revenue = _known_sales(t).agg(F.sum("revenue")).scalar()
    upkeep = t.maintenance.join(dimension(t, "machines", ()), "machine_id").agg(F.sum("cost")).scalar()
    figures = made.withColumns(
        {
            "total_good": F.col("total_units") - F.col("total_defects"),
            "total_revenue": revenue,
            "total_maintenance_cost": upkeep,
        }
    )
    figures = rounded(
        _rate(figures), total_downtime=1, avg_efficiency=2, total_revenue=2, total_revenue_lost=2,
        total_maintenance_cost=2,
    )
    return figures.select(
        "total_units", "total_good", "total_defects", "defect_rate", "total_downtime", "total_revenue",
        "total_revenue_lost", "avg_efficiency", "total_maintenance_cost", "first_date", "last_date",
    )
