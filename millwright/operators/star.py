"""Joins of the facts with their dimensions.

A dimension is broadcast when it was counted and found small; otherwise Spark decides by its own size
estimate, and beyond that shuffles, splitting hot keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import metrics
from millwright.sources.tables import FactoryTables

LINKS = {"machines": "machine_id", "employees": "emp_id", "products": "product_id"}

# Columns each dimension adds to a run; those a source lacks are left out.
ATTRIBUTES = {
    "machines": ("machine_name", "department", "age_years", "capacity_per_hr"),
    "employees": ("emp_name", "experience_yrs"),
    "products": ("product_name", "category", "price_per_unit"),
}


def dimension(t: FactoryTables, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    table = getattr(t, name)
    wanted = ATTRIBUTES[name] if columns is None else columns
    rows = table.select(LINKS[name], *[c for c in wanted if c in table.columns])
    return F.broadcast(rows) if name in t.small else rows


def runs(t: FactoryTables, *wanted: str, later: str | None = None) -> DataFrame:
    """Production runs that have a machine, an employee and a product.

    ``wanted`` dimensions bring their columns. The others only vouch for the run: they are joined on
    their key, or not at all when trusted. ``later`` names a dimension that the caller joins after
    adding up by its key, which spares the fact table that join.
    """
    fact = t.production
    for name, key in LINKS.items():
        if name in wanted:
            fact = fact.join(dimension(t, name), key)
        elif name != later and name not in t.trusted:
            fact = fact.join(dimension(t, name, ()), key)
    return fact


def enriched_production(t: FactoryTables, round_rows: bool = False) -> DataFrame:
    """The full star with the derived measures; ``round_rows`` rounds each run to 2 digits."""
    return with_measures(runs(t, *LINKS), 2 if round_rows else None)


def with_measures(run: DataFrame, digits: int | None = None) -> DataFrame:
    derived: dict[str, Column] = {
        "defect_rate": metrics.defect_rate(digits),
        "efficiency": metrics.efficiency(digits),
        "good_units": metrics.good_units(),
        "month": metrics.month_key("prod_date"),
        "week": metrics.iso_week("prod_date"),
    }
    if "price_per_unit" in run.columns:
        derived["revenue_lost"] = metrics.revenue_lost(digits)
    return run.withColumns(derived)


def enriched_sales(t: FactoryTables) -> DataFrame:
    return t.sales.join(dimension(t, "products", ("product_name", "category")), "product_id")


def enriched_maintenance(t: FactoryTables) -> DataFrame:
    return t.maintenance.join(dimension(t, "machines", ("machine_name", "department")), "machine_id")


def sliced(
    run: DataFrame,
    machine: str | None = None,
    shift: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Runs of one machine, one shift or a span of days; Spark moves the filters to the scan."""
    if machine is not None:
        run = run.where(F.col("machine_name") == machine)
    if shift is not None:
        run = run.where(F.col("shift") == shift)
    if date_from is not None:
        run = run.where(F.col("prod_date") >= F.to_date(F.lit(date_from)))
    if date_to is not None:
        run = run.where(F.col("prod_date") <= F.to_date(F.lit(date_to)))
    return run
