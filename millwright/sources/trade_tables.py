"""The trade test tables (suppliers, parts, order lines, events) read as a factory.

A supplier is a machine, a customer an employee, a part a product, an order line both a production
run and a sale, an event a maintenance visit. Money and rates become whole numbers first, so results
do not hang on binary rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.sources.tables import FactoryTables, within_rows

# The columns read, declared so that no job is spent on finding them.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def read_trade_tables(spark: SparkSession, folder: str) -> FactoryTables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    places = table("nation").join(table("region"), F.expr("n_regionkey = r_regionkey"))
    supplier, customer, orders = table("supplier"), table("customer"), table("orders")

    machines = supplier.join(places, F.expr("s_nationkey = n_nationkey")).selectExpr(
        "s_suppkey AS machine_id",
        "s_name AS machine_name",
        "r_name AS department",
        "CAST(1 + s_suppkey % 10 AS INT) AS age_years",
    )
    employees = customer.selectExpr(
        "c_custkey AS emp_id", "c_name AS emp_name", "CAST(1 + c_custkey % 12 AS INT) AS experience_yrs"
    )
    products = table("part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        "p_type AS category",
        "CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_unit",
    )

    lines = table("lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate",
        "CAST(l_quantity AS INT) AS q",
        "CAST(round(l_discount * 100) AS INT) AS d",
        "CAST(round(l_tax * 100) AS INT) AS t",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS x",
    )
    production = lines.join(
        orders.select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")
    ).selectExpr(
        "CAST(l_shipdate AS DATE) AS prod_date",
        "l_suppkey AS machine_id",
        "o_custkey AS emp_id",
        "l_partkey AS product_id",
        "CASE l_returnflag WHEN 'A' THEN 'Morning' WHEN 'N' THEN 'Evening' ELSE 'Night' END AS shift",
        "q * 20 AS units_made",
        "CAST(q * d DIV 5 AS INT) AS units_defective",
        "CAST(t / 10 AS DECIMAL(5,2)) AS downtime_hrs",
        "CAST((600 + 20 * d + 4 * q) / 10 AS DECIMAL(5,1)) AS temperature",
        "CAST((40 + l_orderkey % 41) / 10 AS DECIMAL(5,2)) AS pressure",
        "CAST((400 + x % 401) / 10 AS DECIMAL(5,1)) AS humidity",
        "CAST((50 + x % 400) / 100 AS DECIMAL(5,2)) AS vibration_level",
    )

    # Orders meet their customers before the lines, which are several times as many.
    placed = orders.join(customer, F.expr("o_custkey = c_custkey")).join(
        places, F.expr("c_nationkey = n_nationkey")
    )
    sales = lines.join(placed, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "CAST(o_orderdate AS DATE) AS sale_date",
        "l_partkey AS product_id",
        "q AS qty_sold",
        "CAST((x * (100 - d) + 50) DIV 100 / 100 AS DECIMAL(12,2)) AS revenue",
        "r_name AS region",
        "c_mktsegment AS customer",
    )

    maintenance = table("events").selectExpr(
        "event_id AS maint_id",
        "user_id AS machine_id",
        "CAST(ts AS DATE) AS maint_date",
        "event_type AS maint_type",
        "CAST(value AS DECIMAL(10,2)) AS cost",
    )
    # Machines are a join, whose size Spark overestimates; their count is the suppliers'. The other two
    # dimensions are plain scans that Spark sizes by itself.
    small = frozenset({"machines"}) if within_rows(supplier) else frozenset()
    return FactoryTables(machines, employees, products, production, sales, maintenance, small=small)
