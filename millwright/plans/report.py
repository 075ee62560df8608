"""The report: key figures, tables with their marks, and insights found in the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import bands, text
from millwright.operators import ranking
from millwright.operators.rollup import with_overall
from millwright.operators.star import enriched_production
from millwright.plans import summaries
from millwright.plans.cells import Cells, cells, single_keys
from millwright.session import settle
from millwright.sources.tables import FactoryTables

RUN_COLUMNS = [
    "prod_date", "machine_name", "shift", "units_made", "units_defective", "defect_rate", "temperature", "emp_name",
]


def report_kpis(t: FactoryTables, of: Cells | None = None) -> DataFrame:
    k = summaries.kpi_summary(t, round_rows=True, made=None if of is None else of.totals())
    return k.withColumn("period", text.period_text("first_date", "last_date")).drop("first_date", "last_date")


def worst_runs(t: FactoryTables, n: int = 5, round_rows: bool = False, of: Cells | None = None) -> DataFrame:
    """The runs with the highest rates; among equals the first recorded comes first."""
    run = enriched_production(t if of is None else of.highest_runs(t, n), round_rows)
    ties = [c for c in ("prod_id",) if c in run.columns]
    ties += ["prod_date", "machine_name", "shift", "units_made", "units_defective", "temperature", "emp_name"]
    return ranking.top_rows(run, "defect_rate", ties, RUN_COLUMNS, n)


def machine_status(t: FactoryTables, of: Cells | None = None) -> DataFrame:
    """Machines with a badge against the mean of their rates, and the best and worst marked."""
    rate = F.col("defect_rate")
    table = with_overall(
        summaries.report_machines(t) if of is None else of.machines(t), _mean=F.avg(rate), _low=F.min(rate), _high=F.max(rate)
    )
    mean = F.col("_mean")
    return table.withColumns(
        {
            "status": bands.status(rate, mean * 0.8, mean * 1.2, reverse=True),
            "badge": text.with_suffix(rate, "%"),
            "is_best": rate == F.col("_low"),
            "is_worst": rate == F.col("_high"),
        }
    ).drop("_mean", "_low", "_high")


def shift_status(t: FactoryTables, good: float = 2.5, bad: float = 3.5, of: Cells | None = None) -> DataFrame:
    rate = F.col("defect_rate")
    shifts = summaries.report_shifts(t) if of is None else of.shifts()
    return shifts.withColumn("status", bands.status(rate, good, bad, reverse=True))


def month_status(t: FactoryTables, of: Cells | None = None) -> DataFrame:
    """Months with their trend, and the best and the worst one marked (the first of equals)."""
    months = settle(ranking.with_trend(summaries.report_months(t) if of is None else of.months(), "defect_pct"))
    best = ranking.pick(months, "defect_pct", ["month"], highest=False).select("month").scalar()
    worst = ranking.pick(months, "defect_pct", ["month"], highest=True).select("month").scalar()
    return months.withColumns({"is_best": F.col("month") == best, "is_worst": F.col("month") == worst})


def best_worst_picks(t: FactoryTables, of: Cells | None = None) -> DataFrame:
    """(what, name, value): the best and worst machine, shift and month, from one pass over the runs."""
    of = of or single_keys(t)

    def named(summary: DataFrame, what: str, rate: str, name: str, tie: str) -> DataFrame:
        pair = ranking.best_and_worst(summary, rate, [tie], [name, rate])
        return pair.select(
            F.concat("which", F.lit(f"_{what}")).alias("what"), F.col(name).alias("name"), F.col(rate).alias("value")
        )

    parts = [
        named(of.machines(t), "machine", "defect_rate", "machine_name", "machine_id"),
        named(of.shifts(), "shift", "defect_rate", "shift", "shift"),
        named(of.months(), "month", "defect_pct", "month", "month"),
    ]
    return reduce(DataFrame.unionByName, parts)


def insights(
    t: FactoryTables, importance: DataFrame | None = None, saving: float = 0.33, of: Cells | None = None
) -> DataFrame:
    """(position, topic, message), each found in the data; the predictor's row needs a model's importances.

    The runs are read once, into cells, or not at all where ``of`` brings them. ``saving`` is the share of the loss that a rate one point lower is taken to save.
    """

    def line(position: Column | int, topic: Column | str, *parts: Column | str) -> list[Column]:
        def column(x):
            return x if isinstance(x, Column) else F.lit(x)

        return [
            column(position).alias("position"),
            column(topic).alias("topic"),
            F.concat(*[column(p) for p in parts]).alias("message"),
        ]

    of = of or single_keys(t)
    rate = F.format_number("defect_rate", 2)
    worst = F.col("which") == "worst"
    machines = ranking.best_and_worst(
        of.machines(t), "defect_rate", ["machine_id"], ["machine_name", "defect_rate", "age_years"]
    )
    shifts = ranking.best_and_worst(of.shifts(), "defect_rate", ["shift"], ["shift", "defect_rate"])
    months = ranking.best_and_worst(of.months(), "defect_pct", ["month"], ["month", "defect_pct"])
    money = summaries.kpi_summary(t, round_rows=True, made=of.totals()).select("total_revenue_lost", "total_revenue")
    lost = F.col("total_revenue_lost")
    share = F.round(F.try_divide(lost, F.col("total_revenue")) * 100, 1)
    age = F.when(worst, F.concat(F.lit(" Age: "), F.col("age_years").cast("string"), F.lit(" years."))).otherwise("")
    found = [
        machines.select(
            *line(
                F.when(worst, 1).otherwise(2),
                F.when(worst, "Worst machine").otherwise("Best machine"),
                F.col("machine_name"), " has the ", F.when(worst, "highest").otherwise("lowest"), " defect rate: ",
                rate, "%.", age,
            )
        ),
        shifts.where(worst).select(
            *line(3, F.concat("shift", F.lit(" shift")), F.col("shift"), " shift has the highest defect rate: ", rate, "%.")
        ),
        money.select(
            *line(
                5, "Revenue loss", "Rs.", F.format_number(lost, 0), " lost to defective units, ",
                F.format_number(share, 1), "% of sales. One point less would save about Rs.",
                F.format_number(F.round(lost * saving), 0), ".",
            )
        ),
        months.where(~worst).select(
            *line(6, "Best month", F.col("month"), " had the lowest defect rate: ", F.format_number("defect_pct", 2), "%.")
        ),
    ]
    if importance is not None:
        top = importance.where("rank = 1")
        found.append(top.select(*line(4, "Top predictor", F.col("feature"), " matters most for the defect rate.")))
    return reduce(DataFrame.unionByName, found)


def bundle(t: FactoryTables, importance: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the report by name. The runs are read once, into cells; the worst runs are looked up in theirs."""
    of = cells(t)
    tables = {
        "kpis": report_kpis(t, of),
        "machines": machine_status(t, of),
        "months": month_status(t, of),
        "shifts": shift_status(t, of=of),
        "worst_runs": worst_runs(t, round_rows=True, of=of),
        "insights": insights(t, importance, of=of),
    }
    return tables | ({} if importance is None else {"importance": importance})
