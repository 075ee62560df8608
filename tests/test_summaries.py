from __future__ import annotations

import pytest
from conftest import EMPLOYEES, MACHINES, PRODUCTION, PRODUCTS, by, rows, run, tables

from millwright.operators import star
from millwright.operators.rollup import Rollup, rounded, with_share
from millwright.plans import charts, report, summaries


def test_star_keeps_only_runs_with_all_dimensions(factory):
    assert {r["prod_id"] for r in rows(star.enriched_production(factory))} == {1, 2, 3, 4, 5}
    assert {r["prod_id"] for r in rows(star.runs(factory))} == {1, 2, 3, 4, 5}
    assert {r["prod_id"] for r in rows(star.runs(factory, later="machines"))} == {1, 2, 3, 4, 5, 6}


def test_trusted_dimensions_are_joined_only_for_their_columns(factory):
    trusting = factory.trusting("machines", "employees", "products")
    assert {r["prod_id"] for r in rows(star.runs(trusting))} == {1, 2, 3, 4, 5, 6, 7}
    assert "price_per_unit" in star.runs(trusting, "products").columns


def test_zero_units_have_no_rate(factory):
    run = by(star.enriched_production(factory), "prod_id")
    assert run[5]["defect_rate"] is None and run[5]["efficiency"] is None
    assert run[1]["defect_rate"] == 2.0 and run[1]["good_units"] == 98
    assert run[2]["month"] == "2024-01" and run[2]["week"] == 1
    assert float(run[2]["revenue_lost"]) == 4800.0


def test_machine_performance_has_no_other_dimension(factory):
    table = by(summaries.machine_performance(factory), "machine_id")
    assert table["M1"]["total_runs"] == 3 and table["M1"]["total_units"] == 400
    assert table["M1"]["defect_rate_pct"] == 3.25
    assert table["M1"]["avg_temp"] == 75.0  # the NULL reading does not count
    assert table["M3"]["avg_vibration"] is None
    assert "M9" not in table


def test_ratio_of_sums_and_mean_of_rates_differ(factory):
    sums = by(summaries.report_machines(factory), "machine_id")
    means = by(summaries.machine_mean_rates(factory), "machine_name")
    assert sums["M1"]["defect_rate"] == 4.0  # 12 of 300
    assert means["Lathe"]["mean_defect_rate"] == 3.5  # of 2 % and 5 %
    assert means["Press"]["mean_defect_rate"] == 8.0  # the run without units has no rate


def test_department_counts_its_machines(factory):
    table = by(summaries.department_analysis(factory), "department")
    assert table["Cutting"]["machine_count"] == 2 and table["Cutting"]["total_units"] == 600
    assert table["Pressing"]["total_downtime"] == 1.5


def test_products_of_one_name_are_one_in_name_tables(factory):
    lost = by(summaries.revenue_lost_by_product(factory), "product_name")
    assert lost["Piston"]["revenue_lost"] == 10 * 250 + 3 * 10
    assert len(rows(summaries.product_analysis(factory))) == 3


def test_pivot_leaves_missing_pairs_empty(factory):
    wide = by(summaries.machine_shift_pivot(factory), "machine_name")
    assert wide["Lathe"] == {"machine_name": "Lathe", "evening": None, "morning": 2.0, "night": 5.0}


def test_sales_without_region_or_product(factory):
    assert by(summaries.revenue_by_region(factory), "region").keys() == {"North", "South"}
    assert by(summaries.revenue_by_region(factory), "region")["South"]["revenue"] == 50.0
    months = by(summaries.monthly_sales(factory), "month")
    assert months["2024-01"]["revenue"] == 3460.0


def test_key_figures(factory):
    k = rows(summaries.kpi_summary(factory))[0]
    assert (k["total_units"], k["total_good"], k["total_defects"]) == (700, 677, 23)
    assert k["defect_rate"] == 3.29 and k["total_downtime"] == 3.0
    assert k["total_revenue"] == 3510.0 and k["total_maintenance_cost"] == 2000.0
    assert k["total_revenue_lost"] == 10 * 250 + 10 * 480 + 3 * 10
    cards = by(charts.kpi_targets(factory, units_target=500), "kpi")
    assert cards["total_units"]["delta"] == 200.0 and cards["defect_rate"]["band"] == "warning"
    assert cards["total_revenue"]["target"] is None
    assert rows(report.report_kpis(factory))[0]["period"] == "05 Jan 2024 to 03 Feb 2024"


@pytest.mark.parametrize("keys", [("shift",), ("machine_id", "shift")])
def test_two_steps_give_what_one_does(factory, keys):
    total = Rollup({"made": "units_made"}, {"temp": "temperature"}, "n")
    once = total.finished(total.by(factory.production, *keys))
    twice = total.finished(total.again(total.by(factory.production, *keys, "prod_date"), *keys))
    order = lambda df: sorted(map(str, rows(rounded(df, temp=6).select(*keys, "made", "temp", "n"))))
    assert order(once) == order(twice)


def test_null_keys_belong_to_no_group(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int")
    assert rows(Rollup({"v": "v"}).by(df, "k")) == [{"k": "a", "v": 4}]


def test_shares_sum_to_a_hundred(factory):
    shares = rows(charts.maintenance_share(factory))
    assert sum(r["share_pct"] for r in shares) == pytest.approx(100)
    assert rows(with_share(summaries.sales_by_product(factory).limit(0), "total_revenue")) == []


def test_bands_and_flags(factory):
    bands = by(charts.machine_bands(factory), "machine_name")
    assert {m: b["band"] for m, b in bands.items()} == {"Lathe": "green", "Press": "red", "Mill": "green"}
    assert bands["Mill"]["label"] == "1.0%" and bands["Mill"]["overall_mean"] == 4.2
    lost = by(charts.revenue_lost_bands(factory), "product_name")
    assert lost["Cover"]["band"] == "red" and lost["Piston"]["band"] == "blue"
    flags = by(charts.best_worst_flags(factory), "machine_id")
    assert flags["M2"]["is_worst"] and flags["M3"]["is_best"] and not flags["M1"]["is_best"]


def test_slices(factory):
    run = star.enriched_production(factory)
    assert {r["prod_id"] for r in rows(star.sliced(run, machine="Lathe", shift="Night"))} == {2}
    assert {r["prod_id"] for r in rows(star.sliced(run, date_from="2024-01-06", date_to="2024-02-01"))} == {2, 3}


def test_report_bundle(factory):
    parts = report.bundle(factory)
    assert set(parts) == {"kpis", "machines", "months", "shifts", "worst_runs", "insights"}
    assert [r["topic"] for r in rows(parts["insights"].orderBy("position"))] == [
        "Worst machine", "Best machine", "Morning shift", "Revenue loss", "Best month",
    ]
    months = by(parts["months"], "month")
    assert months["2024-02"]["trend"] == "down" and months["2024-01"]["trend"] == ""
    assert months["2024-02"]["is_best"] and months["2024-01"]["is_worst"]


def test_worst_runs_break_ties_by_first_recorded(spark, factory):
    first = rows(report.worst_runs(factory, 2))
    assert [r["rank"] for r in first] == [1, 2]
    assert [r["machine_name"] for r in first] == ["Press", "Lathe"]


def test_plans_push_filters_and_read_few_columns(spark, tmp_path):
    factory_path = str(tmp_path / "production")
    tables(spark, production=PRODUCTION).production.write.parquet(factory_path)
    saved = spark.read.parquet(factory_path)
    run = saved.where("prod_date >= date'2024-02-01'").groupBy("shift").sum("units_made")
    plan = run._sc._jvm.PythonSQLUtils.explainString(run._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(prod_date), GreaterThanOrEqual(prod_date" in plan
    assert "ReadSchema: struct<prod_date:date,shift:string,units_made:int>" in plan


def test_pivot_keeps_shifts_that_nobody_listed(spark):
    made = [run(1, "2024-01-05", "M1", "E1", "P1", "General", 100, 2), run(2, "2024-01-05", "M1", "E1", "P1", "Morning", 100, 4)]
    t = tables(spark, machines=MACHINES, employees=EMPLOYEES, products=PRODUCTS, production=made)
    got = rows(summaries.machine_shift_pivot(t))
    assert got == [{"machine_name": "Lathe", "evening": None, "morning": 4.0, "night": None, "general": 2.0}]


def test_runs_never_meet_prices(factory):
    """Losses are priced after adding up: below the join that brings prices, runs are aggregated."""
    for table in (summaries.department_losses(factory), summaries.kpi_summary(factory)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("price_per_unit") < plan.index("sum(units_defective")
