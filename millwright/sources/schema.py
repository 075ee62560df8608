"""The six factory tables: types, keys and links."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


STRING, INT, LONG, DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()

MACHINES = _struct(
    ("machine_id", STRING, False),
    ("machine_name", STRING, False),
    ("department", STRING, False),
    ("age_years", INT, False),
    ("capacity_per_hr", INT, True),
    ("last_service", DATE, True),
)
EMPLOYEES = _struct(
    ("emp_id", STRING, False),
    ("emp_name", STRING, False),
    ("department", STRING, False),
    ("shift", STRING, False),
    ("experience_yrs", INT, True),
    ("supervisor", STRING, True),
)
PRODUCTS = _struct(
    ("product_id", STRING, False),
    ("product_name", STRING, False),
    ("category", STRING, False),
    ("target_qty", INT, True),
    ("price_per_unit", T.DecimalType(10, 2), True),
)
PRODUCTION = _struct(
    ("prod_id", LONG, False),
    ("prod_date", DATE, False),
    ("machine_id", STRING, False),
    ("emp_id", STRING, False),
    ("product_id", STRING, False),
    ("shift", STRING, False),
    ("units_made", INT, False),
    ("units_defective", INT, False),
    ("downtime_hrs", T.DecimalType(5, 2), False),
    ("temperature", T.DecimalType(5, 1), True),
    ("pressure", T.DecimalType(5, 2), True),
    ("humidity", T.DecimalType(5, 1), True),
    ("vibration_level", T.DecimalType(5, 2), True),
)
SALES = _struct(
    ("sale_id", LONG, False),
    ("sale_date", DATE, False),
    ("product_id", STRING, False),
    ("qty_sold", INT, False),
    ("revenue", T.DecimalType(12, 2), False),
    ("region", STRING, True),
    ("customer", STRING, True),
)
MAINTENANCE = _struct(
    ("maint_id", LONG, False),
    ("machine_id", STRING, False),
    ("maint_date", DATE, False),
    ("maint_type", STRING, False),
    ("cost", T.DecimalType(10, 2), False),
    ("hours_taken", T.DecimalType(5, 1), True),
    ("technician", STRING, True),
)

SCHEMAS = {
    "machines": MACHINES,
    "employees": EMPLOYEES,
    "products": PRODUCTS,
    "production": PRODUCTION,
    "sales": SALES,
    "maintenance": MAINTENANCE,
}

PRIMARY_KEYS = {
    "machines": "machine_id",
    "employees": "emp_id",
    "products": "product_id",
    "production": "prod_id",
    "sales": "sale_id",
    "maintenance": "maint_id",
}

# (fact, column, dimension): the column has the same name on both sides.
FOREIGN_KEYS = (
    ("production", "machine_id", "machines"),
    ("production", "emp_id", "employees"),
    ("production", "product_id", "products"),
    ("sales", "product_id", "products"),
    ("maintenance", "machine_id", "machines"),
)


def required_columns(table: str) -> list[str]:
    return [field.name for field in SCHEMAS[table] if not field.nullable]
