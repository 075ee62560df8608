"""Published results of the reference data, rolled up from one another."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import by, day, rows, run, tables

from millwright.plans import charts, report, summaries

# Machine, name, department, age, units, defects, rate, mean downtime, mean temperature.
MACHINES = [
    ("M004", "Milling Machine Delta", "Machining", 7, 99980, 4332, 4.33, "red"),
    ("M002", "Hydraulic Press Beta", "Pressing", 5, 108574, 4223, 3.89, "red"),
    ("M006", "Grinding Unit Zeta", "Finishing", 4, 123674, 3472, 2.81, "orange"),
    ("M005", "Injection Mold Epsilon", "Molding", 1, 242743, 6019, 2.48, "orange"),
    ("M003", "Welding Robot Gamma", "Assembly", 3, 185950, 4446, 2.39, "green"),
    ("M001", "CNC Lathe Alpha", "Machining", 2, 150305, 3230, 2.15, "green"),
]
DEPARTMENTS = {
    "Pressing": (108574, 4223, 1, 3.89),
    "Machining": (250285, 7562, 2, 3.02),
    "Finishing": (123674, 3472, 1, 2.81),
    "Molding": (242743, 6019, 1, 2.48),
    "Assembly": (185950, 4446, 1, 2.39),
}
MONTHS = [
    ("2024-01", 155492, 4387, 2.82, ""),
    ("2024-02", 147953, 4222, 2.85, "up"),
    ("2024-03", 156740, 4335, 2.77, "down"),
    ("2024-04", 152163, 4361, 2.87, "up"),
    ("2024-05", 156323, 4358, 2.79, "down"),
    ("2024-06", 142555, 4059, 2.85, "up"),
]
SHIFTS = [
    ("Night", 156521, 6071, 3.88, "red"),
    ("Evening", 258731, 8493, 3.28, "orange"),
    ("Morning", 495974, 11158, 2.25, "green"),
]
# product, name, units, defects, list price, lost, rate, quantity sold, revenue, share
PRODUCTS = [
    ("P005", "Cylinder Head", 120005, 3508, 750, 2631000.0, 2.92, 10673, "8030985.71", 32.2),
    ("P002", "Gear Box Cover", 123472, 3535, 480, 1696800.0, 2.86, 8241, "3957053.09", 15.9),
    ("P006", "Brake Disc", 143882, 3969, 380, 1508220.0, 2.76, 9756, "3738038.76", 15.0),
    ("P003", "Axle Rod 40mm", 150462, 4165, 320, 1332800.0, 2.77, 8841, "2831185.72", 11.4),
    ("P007", "Clutch Plate", 137954, 3840, 290, 1113600.0, 2.78, 10191, "2950294.06", 11.8),
    ("P001", "Engine Piston", 103419, 2877, 250, 719250.0, 2.78, 10145, "2537763.56", 10.2),
    ("P004", "Ball Bearing", 132032, 3828, 95, 363660.0, 2.90, 9249, "877378.21", 3.5),
]
UNITS, DEFECTS, RATE = 911226, 25722, 2.82

EMPLOYEES = [("E1", "Someone", "All", "All", 1)]


def one_run_each(spark, what: str):
    """Tables with one production row for each line of a published table."""
    machines = [m[:4] for m in MACHINES]
    products = [(p[0], p[1], "Any", 1, Decimal(p[4])) for p in PRODUCTS]
    sales = [(i, day("2024-01-01"), p[0], p[7], Decimal(p[8]), "North", "C") for i, p in enumerate(PRODUCTS)]
    made = {
        "machines": [run(i, "2024-01-01", m[0], "E1", "P001", "Night", m[4], m[5]) for i, m in enumerate(MACHINES)],
        "months": [run(i, f"{m[0]}-15", "M001", "E1", "P001", "Night", m[1], m[2]) for i, m in enumerate(MONTHS)],
        "shifts": [run(i, "2024-01-01", "M001", "E1", "P001", s[0], s[1], s[2]) for i, s in enumerate(SHIFTS)],
        "products": [run(i, "2024-01-01", "M001", "E1", p[0], "Night", p[2], p[3]) for i, p in enumerate(PRODUCTS)],
    }
    return tables(
        spark, machines=machines, employees=EMPLOYEES, products=products, production=made[what], sales=sales
    )


def test_machines_and_departments(spark):
    t = one_run_each(spark, "machines")
    machines = rows(report.machine_status(t).orderBy("defect_rate", ascending=False))
    assert [(m["machine_id"], m["defect_rate"], m["status"]) for m in machines] == [
        (m[0], m[6], m[7]) for m in MACHINES
    ]
    assert machines[0]["is_worst"] and machines[-1]["is_best"]
    for name, d in by(summaries.department_analysis(t), "department").items():
        assert (d["total_units"], d["total_defects"], d["machine_count"], d["defect_rate"]) == DEPARTMENTS[name]


@pytest.mark.parametrize("what", ["machines", "months", "shifts", "products"])
def test_all_tables_roll_up_to_the_same_totals(spark, what):
    k = rows(summaries.kpi_summary(one_run_each(spark, what)))[0]
    assert (k["total_units"], k["total_defects"], k["defect_rate"]) == (UNITS, DEFECTS, RATE)


def test_months(spark):
    t = one_run_each(spark, "months")
    months = rows(report.month_status(t).orderBy("month"))
    assert [(m["month"], m["defect_pct"], m["trend"]) for m in months] == [(m[0], m[3], m[4]) for m in MONTHS]
    assert [m["month"] for m in months if m["is_best"]] == ["2024-03"]
    assert [m["month"] for m in months if m["is_worst"]] == ["2024-04"]


def test_shifts(spark):
    shifts = rows(report.shift_status(one_run_each(spark, "shifts")))
    assert [(s["shift"], s["defect_rate"], s["status"]) for s in shifts] == [(s[0], s[3], s[4]) for s in SHIFTS]


def test_products_sales_and_losses(spark):
    t = one_run_each(spark, "products")
    products = by(summaries.product_analysis(t), "product_id")
    for p in PRODUCTS:
        assert (products[p[0]]["revenue_lost"], products[p[0]]["defect_rate"]) == (p[5], p[6])
    shares = by(summaries.sales_share(t), "product_name")
    assert {n: s["share_pct"] for n, s in shares.items()} == {p[1]: p[9] for p in PRODUCTS}
    bands = by(charts.revenue_lost_bands(t), "product_name")
    assert bands["Cylinder Head"]["band"] == "red" and bands["Axle Rod 40mm"]["band"] == "blue"
    k = rows(summaries.kpi_summary(t))[0]
    assert (k["total_revenue_lost"], k["total_revenue"]) == (9365330.0, 24922699.11)
    loss = by(report.insights(t), "topic")["Revenue loss"]["message"]
    assert "37.6%" in loss and "9,365,330" in loss and "3,090,559" in loss
