"""Chart and dashboard data: bands, shares, flags, points and key-figure cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions import bands, text
from millwright.operators import ranking
from millwright.operators.rollup import with_overall, with_share
from millwright.plans import summaries
from millwright.sources.tables import FactoryTables


def machine_bands(t: FactoryTables, margin: float = 0.5) -> DataFrame:
    """Machines with their mean rate, its label, the mean over machines and the colour against it."""
    rates = with_overall(summaries.machine_mean_rates(t, round_rows=True), _mean=F.avg("mean_defect_rate"))
    rate = F.col("mean_defect_rate")
    return rates.select(
        "machine_name",
        "mean_defect_rate",
        "avg_downtime",
        "total_units",
        "avg_temp",
        text.with_suffix(rate, "%").alias("label"),
        F.round("_mean", 1).alias("overall_mean"),
        bands.mean_band(rate, F.col("_mean"), margin).alias("band"),
    )


def revenue_lost_bands(t: FactoryTables) -> DataFrame:
    """Products with what they lost, in thousands too, and the colour against peak and mean."""
    lost = F.col("revenue_lost")
    banded = with_overall(summaries.revenue_lost_by_product(t), _peak=F.max(lost), _mean=F.avg(lost))
    return banded.select(
        "product_name",
        "revenue_lost",
        F.round(lost / 1000, 6).alias("lost_thousands"),
        bands.peak_band(lost, F.col("_peak"), F.col("_mean")).alias("band"),
    )


def best_worst_flags(t: FactoryTables) -> DataFrame:
    return ranking.with_best_worst(summaries.machine_performance(t), "defect_rate_pct")


def month_trend(t: FactoryTables) -> DataFrame:
    return ranking.with_trend(summaries.monthly_trend(t), "defect_pct")


def shift_share(t: FactoryTables) -> DataFrame:
    shifts = summaries.shift_summary(t).select("shift", "total_units", "defect_rate")
    return with_share(shifts, "total_units")


def region_share(t: FactoryTables) -> DataFrame:
    return with_share(summaries.revenue_by_region(t), "revenue")


def maintenance_share(t: FactoryTables) -> DataFrame:
    return with_share(summaries.maintenance_cost_by_type(t), "cost")


def kpi_targets(
    t: FactoryTables,
    units_target: float = 900_000,
    rate_target: float = 3.0,
    gauge: tuple[float, float, float] = (3.0, 5.0, 8.0),
) -> DataFrame:
    """The three cards: value, target, difference and band. The targets are the caller's to set."""
    k = summaries.kpi_summary(t, round_rows=True)
    nothing = F.lit(None)

    def card(name, value, target, band):
        target = nothing if target is None else F.lit(float(target))
        return F.struct(
            F.lit(name).alias("kpi"),
            value.cast("double").alias("value"),
            target.cast("double").alias("target"),
            F.round(value.cast("double") - target.cast("double"), 2).alias("delta"),
            band.cast("string").alias("band"),
        )

    rate = F.col("defect_rate")
    cards = F.array(
        card("total_units", F.col("total_units"), units_target, nothing),
        card("defect_rate", rate, rate_target, bands.gauge_band(rate, gauge[:2])),
        card("total_revenue", F.round("total_revenue", 0), None, nothing),
    )
    return k.select(F.inline(cards))
