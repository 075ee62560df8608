"""Results must not hang on the size of a dimension or on how the keys are spread."""

from __future__ import annotations

import dataclasses

import pandas as pd
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from millwright.operators import quality, star, stats
from millwright.plans import charts, report, summaries
from millwright.sources.trade_tables import read_trade_tables

FOLDER = "/root/testdata/sf0.001"
PLANS = [
    summaries.machine_performance, summaries.department_analysis, summaries.product_analysis,
    summaries.machine_shift_pivot, summaries.kpi_summary, summaries.sales_by_product, charts.machine_bands,
    report.worst_runs, report.insights, quality.orphans,
]


def explained(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture
def nothing_fits(spark):
    """No side of a join is small enough to broadcast, and any partition counts as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def usual(spark):
    t = read_trade_tables(spark, FOLDER)
    return {plan.__name__: sorted(map(str, rows(plan(t)))) for plan in PLANS}


@pytest.mark.parametrize("plan", PLANS, ids=lambda p: p.__name__)
def test_large_dimensions_give_the_same(spark, usual, nothing_fits, plan):
    t = dataclasses.replace(read_trade_tables(spark, FOLDER), small=frozenset())
    df = plan(t)
    assert sorted(map(str, rows(df))) == usual[plan.__name__]


def test_large_dimension_is_not_broadcast(spark, nothing_fits):
    t = dataclasses.replace(read_trade_tables(spark, FOLDER), small=frozenset())
    assert "BroadcastHashJoin" not in explained(star.enriched_production(t))


def test_labels_are_joined_after_adding_up(spark):
    """The fact is never joined with machines: their join reads the sums."""
    t = dataclasses.replace(read_trade_tables(spark, FOLDER), small=frozenset({"machines"}))
    plan = explained(summaries.machine_performance(t))
    tree = plan.split("== Physical Plan ==")[1].split("\n\n")[0]
    assert "CartesianProduct" not in tree and "BroadcastNestedLoopJoin" not in tree
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line and "l_orderkey" in line)
    assert "l_returnflag" not in scan and "l_shipdate" not in scan


def test_no_query_has_a_cross_join(spark):
    t = read_trade_tables(spark, FOLDER)
    run = star.enriched_production(t)
    plans = [plan(t) for plan in PLANS]
    plans += [
        stats.histogram(run, "defect_rate", "shift", ["Morning", "Night"]),
        stats.box_statistics(run, "defect_rate", "shift", ["Morning", "Night"]),
        stats.describe(run, ["units_made", "temperature"]),
        stats.line_points(stats.line_fit(run, "temperature", "defect_rate")),
        charts.kpi_targets(t),
    ]
    for df in plans:
        tree = explained(df)
        assert "CartesianProduct" not in tree and "BroadcastNestedLoopJoin" not in tree


def test_one_hot_machine(spark, nothing_fits):
    """Half of all runs belong to one machine, one shift and one product, many of them copies."""
    t = dataclasses.replace(read_trade_tables(spark, FOLDER), small=frozenset())
    hot = F.rand(4) < 0.5
    fact = t.production.repartition(5, "machine_id").withColumn("hot", hot)
    one = {"machine_id": F.lit(1).cast("bigint"), "shift": F.lit("Night"), "product_id": F.lit(2).cast("bigint")}
    fact = fact.withColumns({c: F.when(F.col("hot"), v).otherwise(F.col(c)) for c, v in one.items()}).drop("hot")
    t = dataclasses.replace(t, production=fact.checkpoint())
    found = by(summaries.machine_mean_rates(t), "machine_name")
    run = star.enriched_production(t).select("machine_name", "units_made", "units_defective", "shift").toPandas()
    want = (run.units_defective / run.units_made * 100).groupby(run.machine_name).mean()
    assert set(found) == set(want.index)
    for name, row in found.items():
        assert row["mean_defect_rate"] == pytest.approx(want[name], abs=0.0051)
    boxes = by(stats.box_statistics(star.enriched_production(t), "defect_rate", "shift", ["Night", "Morning"]), "shift")
    rate = pd.Series(run.units_defective / run.units_made * 100)
    for shift, box in boxes.items():
        assert box["median"] == pytest.approx(rate[run["shift"] == shift].median(), abs=1e-6)
        assert box["n"] == (run["shift"] == shift).sum()
