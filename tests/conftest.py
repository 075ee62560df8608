from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millwright.session import local_session  # noqa: E402
from millwright.sources.schema import SCHEMAS  # noqa: E402
from millwright.sources.tables import FactoryTables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.chdir(tmp_path_factory.mktemp("work"))  # the warehouse of saved tables goes here
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def run(prod_id, date, machine, emp, product, shift, made, bad, down="0.50", temp="75.0", vib="2.00"):
    """One production row; None stays NULL."""

    def number(x):
        return None if x is None else Decimal(x)

    return (
        prod_id, day(date), machine, emp, product, shift, made, bad,
        number(down), number(temp), Decimal("5.00"), Decimal("50.0"), number(vib),
    )


def tables(spark, **rows) -> FactoryTables:
    """Factory tables from rows; tables not given are empty."""
    made = {}
    for name, schema in SCHEMAS.items():
        given = rows.get(name, [])
        wide = [tuple(r) + (None,) * (len(schema) - len(r)) for r in given]
        open_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        made[name] = spark.createDataFrame(wide, open_schema)
    return FactoryTables(**made)


MACHINES = [
    ("M1", "Lathe", "Cutting", 2, 100),
    ("M2", "Press", "Pressing", 5, 90),
    ("M3", "Mill", "Cutting", 7, 80),
]
EMPLOYEES = [("E1", "Asha", "Cutting", "Morning", 8), ("E2", "Ravi", "Pressing", "Night", 3)]
PRODUCTS = [
    ("P1", "Piston", "Engine", 500, Decimal("250.00")),
    ("P2", "Cover", "Gear", 300, Decimal("480.00")),
    ("P3", "Piston", "Spare", 100, Decimal("10.00")),
]
PRODUCTION = [
    run(1, "2024-01-05", "M1", "E1", "P1", "Morning", 100, 2),
    run(2, "2024-01-06", "M1", "E2", "P2", "Night", 200, 10, temp=None),
    run(3, "2024-02-01", "M2", "E1", "P1", "Morning", 100, 8, down="1.00", temp="85.0"),
    run(4, "2024-02-02", "M3", "E2", "P3", "Evening", 300, 3, vib=None),
    run(5, "2024-02-03", "M2", "E2", "P2", "Night", 0, 0),
    run(6, "2024-03-01", "M9", "E1", "P1", "Morning", 100, 1),
    run(7, "2024-03-02", "M1", "E9", "P1", "Morning", 100, 1),
]
SALES = [
    (1, day("2024-01-05"), "P1", 10, Decimal("2500.00"), "North", "A"),
    (2, day("2024-01-20"), "P2", 2, Decimal("960.00"), None, "B"),
    (3, day("2024-02-05"), "P3", 5, Decimal("50.00"), "South", "A"),
    (4, day("2024-02-06"), "P9", 5, Decimal("77.00"), "South", "A"),
]
MAINTENANCE = [
    (1, "M1", day("2024-01-07"), "Preventive", Decimal("500.00")),
    (2, "M2", day("2024-02-07"), "Breakdown", Decimal("1500.00")),
    (2, "M9", day("2024-02-08"), "Breakdown", Decimal("99.00")),
]


@pytest.fixture(scope="session")
def factory(spark) -> FactoryTables:
    return tables(
        spark, machines=MACHINES, employees=EMPLOYEES, products=PRODUCTS, production=PRODUCTION, sales=SALES,
        maintenance=MAINTENANCE,
    )


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def by(df, key) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
