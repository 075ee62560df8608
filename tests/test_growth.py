"""What keeps its cost in bounds as tables grow: cells, batches, layouts, samples, sketches, footers, numbering."""

from __future__ import annotations

import dataclasses
import random

import numpy as np
import pytest
from conftest import EMPLOYEES, MACHINES, MAINTENANCE, PRODUCTION, PRODUCTS, SALES, by, rows, run, tables
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators import model, ordering, quality, quantiles, ranking, stats
from millwright.plans import cells, report, summaries
from millwright.sources import batches, layout
from millwright.sources.schema import SCHEMAS
from millwright.sources.trade_tables import read_trade_tables

FOLDER = "/root/testdata/sf0.001"


def explained(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def sorted_rows(df):
    return sorted(map(str, rows(df)))


# --- one cell table ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_factory(spark):
    """Runs without a shift, of unknown machines and employees, and with NULL measures."""
    more = [
        run(8, "2024-03-03", "M1", "E1", "P2", None, 100, 9),
        run(9, "2024-03-04", "M3", "E1", "P2", "Night", 50, 10),
        run(10, "2024-03-04", "M3", "E1", "P2", "Night", 50, 10),
    ]
    return tables(
        spark, machines=MACHINES, employees=EMPLOYEES, products=PRODUCTS, production=PRODUCTION + more, sales=SALES,
        maintenance=MAINTENANCE,
    )


@pytest.mark.parametrize("made", [cells.cells, cells.single_keys])
def test_cells_add_up_to_every_summary(odd_factory, made):
    of = made(odd_factory)
    for own, plan in (
        (of.machines(odd_factory), summaries.report_machines), (of.shifts(), summaries.report_shifts),
        (of.months(), summaries.report_months),
    ):
        want = plan(odd_factory)
        assert sorted(own.columns) == sorted(want.columns)
        assert rows(own.select(*sorted(own.columns))) == rows(want.select(*sorted(want.columns)))
    want = summaries.kpi_summary(odd_factory, round_rows=True)
    found = summaries.kpi_summary(odd_factory, made=of.totals())
    unknown = ["avg_efficiency"] if of.singly else []
    assert rows(found.drop(*unknown)) == rows(want.drop(*unknown))


@pytest.mark.parametrize("cells_looked_up", [1, 50])
def test_report_is_the_same_with_and_without_cells(odd_factory, monkeypatch, cells_looked_up):
    monkeypatch.setattr(cells, "MOST_CELLS", cells_looked_up)
    t = odd_factory
    found = report.bundle(t)
    assert sorted_rows(found["worst_runs"]) == sorted_rows(report.worst_runs(t, round_rows=True))
    assert sorted_rows(found["machines"]) == sorted_rows(report.machine_status(t))
    assert sorted_rows(found["months"]) == sorted_rows(report.month_status(t))
    assert sorted_rows(found["shifts"]) == sorted_rows(report.shift_status(t))
    assert sorted_rows(found["kpis"]) == sorted_rows(report.report_kpis(t))


def test_worst_runs_are_looked_up_not_searched(spark):
    t = read_trade_tables(spark, FOLDER)
    some = t.production.orderBy("prod_date", "machine_id").first()
    one = F.when((F.col("machine_id") == some.machine_id) & (F.col("prod_date") == some.prod_date), F.col("units_made"))
    t = dataclasses.replace(t, production=t.production.withColumn("units_defective", F.coalesce(one, F.lit(0)).cast("int")))
    of = cells.cells(t)
    few = of.highest_runs(t, 1)
    assert few.production.count() < 60
    assert sorted_rows(report.worst_runs(t, 1, True, of)) == sorted_rows(report.worst_runs(t, 1, True))


def test_no_runs_no_cells(spark):
    t = tables(spark, machines=MACHINES, employees=EMPLOYEES, products=PRODUCTS)
    of = cells.cells(t)
    assert of.table.count() == 0 and of.highest_runs(t, 5).production.count() == 0
    assert {name: df.count() for name, df in report.bundle(t).items()}["worst_runs"] == 0


def test_report_reads_the_runs_once(spark):
    t = read_trade_tables(spark, FOLDER)
    of = cells.cells(t)  # settled: nothing below reads a run
    assert rows(report.best_worst_picks(t)) == rows(report.best_worst_picks(t, of))
    assert explained(cells.single_keys(t).table).count("Scan parquet") == 0
    for df in (report.best_worst_picks(t, of), report.machine_status(t, of), report.month_status(t, of), report.shift_status(t, of=of)):
        assert "l_shipdate" not in explained(df)
    sales_only = explained(report.insights(t, of=of))
    assert "l_shipdate" not in sales_only and "l_extendedprice" in sales_only


# --- batches -------------------------------------------------------------------------------------------------------

SOLD = "Sale Date,Product ID,Qty Sold,Revenue\n"


def sold(tmp_path, name, *lines):
    path = tmp_path / f"{name}.csv"
    path.write_text(SOLD + "\n".join(lines) + "\n")
    return str(path)


def test_batches_count_once(spark, tmp_path):
    one = sold(tmp_path, "one", "2024-01-02,P1,1,10.00", "2024-01-01,P1,2,20.00", "2024-01-01,P1,2,20.00", "bad,P1,2,3")
    two = sold(tmp_path, "two", "2024-02-01,P2,3,30.00")
    into, rejects = str(tmp_path / "sales"), str(tmp_path / "rejects")
    assert batches.read(spark, into, SCHEMAS["sales"]).count() == 0 and batches.batches(spark, into, SCHEMAS["sales"]).count() == 0
    assert batches.import_batch(spark, one, "sales", into, "one", rejects)
    batches.stage(batches.read(spark, into, SCHEMAS["sales"]), into)  # an attempt that ends before its log entry
    assert not batches.import_batch(spark, one, "sales", into, "one", rejects)
    assert batches.import_batch(spark, two, "sales", into, "two", rejects)
    assert not batches.import_batch(spark, two, "sales", into, "two")
    found = rows(batches.read(spark, into, SCHEMAS["sales"]).orderBy("sale_id").select("sale_id", "product_id", "qty_sold"))
    assert [tuple(r.values()) for r in found] == [(1, "P1", 2), (2, "P1", 2), (3, "P1", 1), (4, "P2", 3)]
    assert [tuple(r.values()) for r in rows(batches.batches(spark, into, SCHEMAS["sales"]).orderBy("place"))] == [(0, "one", 3), (1, "two", 1)]
    assert [r.value for r in spark.read.text(f"{rejects}/one").collect()] == ["bad,P1,2,3"]
    assert batches.clear_failed(spark, into) == 1 and batches.read(spark, into, SCHEMAS["sales"]).count() == 4


def test_a_writer_that_comes_second_goes_on_from_the_first(spark, tmp_path):
    into, schema = str(tmp_path / "t"), T.StructType([T.StructField("id", T.LongType()), T.StructField("who", T.StringType())])
    made = []

    def mine(existing):
        if not made:  # another batch comes in while these rows are made
            made.append(1)
            other = spark.createDataFrame([(1, "other")], schema)
            assert batches.append(spark, into, "other", lambda e: other, schema)
        after = (existing.agg(F.max("id")).first()[0] or 0) + 1
        return spark.createDataFrame([(after, "mine")], schema)

    assert batches.append(spark, into, "mine", mine, schema)
    assert [tuple(r.values()) for r in rows(batches.read(spark, into, schema).orderBy("id"))] == [(1, "other"), (2, "mine")]
    assert batches.clear_failed(spark, into) == 1
    with pytest.raises(ValueError):
        batches.append(spark, into, "a\tb", mine, schema)


# --- layout by month -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    t = read_trade_tables(spark, FOLDER)
    path = str(tmp_path_factory.mktemp("layout") / "runs")
    runs = t.production.unionByName(t.production.limit(5).withColumn("prod_date", F.lit(None).cast("date")))
    runs = runs.checkpoint()
    layout.write_by_month(runs, path, tasks_a_month=2)
    return runs, path


def test_layout_keeps_every_run(spark, by_month):
    runs, path = by_month
    back = layout.read_by_month(spark, path, runs.schema).drop(layout.MONTH)
    assert sorted_rows(back) == sorted_rows(runs)
    months = rows(layout.read_months(spark, path))
    assert len(months) == runs.select(F.trunc("prod_date", "MM")).distinct().where("`trunc(prod_date, MM)` is not null").count()


def test_spans_and_calendars_leave_out_folders(spark, by_month):
    runs, path = by_month
    laid = layout.read_by_month(spark, path, runs.schema)
    span = layout.between(laid, "1994-02-10", "1994-05-03")
    plan = explained(span)
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "run_month" in line and "1994-02-01" in line and "1994-05-01" in line
    want = runs.where("prod_date between date'1994-02-10' and date'1994-05-03'")
    assert sorted_rows(span.drop(layout.MONTH)) == sorted_rows(want)
    first_quarters = layout.of_months(laid, layout.read_months(spark, path).where("quarter = 1"))
    assert "dynamicpruning" in explained(first_quarters)
    assert first_quarters.count() == runs.where("quarter(prod_date) = 1").count()


# --- samples, sketches, footers ------------------------------------------------------------------------------------


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 9}", None if i % 50 == 0 else "x") for i in range(3000)], "k int, g string, n string")
    drawn = ranking.sample_per_group(df.repartition(7), ["g"], ["k"], 20)
    counts = {r["g"]: r["count"] for r in rows(drawn.groupBy("g").count())}
    assert set(counts.values()) == {20} and drawn.columns == df.columns
    again = ranking.sample_per_group(df.repartition(3), ["g"], ["k"], 20)
    assert sorted_rows(drawn) == sorted_rows(again)
    assert sorted_rows(ranking.sample_per_group(df, ["g"], ["k"], 20, seed=1)) != sorted_rows(again)
    nulls = ranking.sample_per_group(df, ["n"], ["k"], 5)
    assert {r["n"]: r["count"] for r in rows(nulls.groupBy("n").count())} == {None: 5, "x": 5}
    plan = explained(drawn)
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan  # tasks keep 20 rows a group before the shuffle


def test_sketches_merge_over_months(spark):
    rng = random.Random(3)
    data = [(f"2024-{1 + i % 12:02d}-05", "ab"[i % 2], rng.gauss(10, 3) if i % 97 else None) for i in range(30_000)]
    df = spark.createDataFrame(data, "d string, g string, v double").select(F.to_date("d").alias("d"), "g", "v")
    sketches = quantiles.month_sketches(df, "v", "d", "g")
    assert sketches.count() == 12
    asked = {"p5": 0.05, "p50": 0.5, "p99": 0.99}
    for first, last, months in ((None, None, range(1, 13)), ("2024-03-01", "2024-08-01", range(3, 9))):
        found = by(quantiles.from_sketches(sketches, asked, "g", first=first, last=last), "g")
        for g in "ab":
            values = sorted(v for d, h, v in data if h == g and v is not None and int(d[5:7]) in months)
            if not values:
                continue
            assert found[g]["n"] == len(values)
            for name, p in asked.items():
                assert abs(np.searchsorted(values, found[g][name]) / len(values) - p) < 0.01


def test_counts_come_from_footers(spark):
    paths = {"lineitem": f"{FOLDER}/lineitem.parquet", "part": f"{FOLDER}/part.parquet"}
    found = quality.footer_counts(spark, paths)
    assert "PushedAggregation: [COUNT(*)]" in explained(found)
    assert {r["table_name"]: r["n"] for r in rows(found)} == {n: spark.read.parquet(p).count() for n, p in paths.items()}
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")  # other reads are as before


# --- numbering, correlations, the forest ---------------------------------------------------------------------------


def test_many_copies_are_numbered_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "COPIES", 100)
    settled = []
    monkeypatch.setattr(ordering, "settle", lambda df: settled.append(1) or df.checkpoint())
    df = spark.createDataFrame([("hot", None)] * 950 + [(f"k{i:03d}", float(i)) for i in range(50)], "k string, v double")
    got = rows(ordering.numbered(df.repartition(3), ["k"], "id").orderBy("id"))
    assert [r["id"] for r in got] == list(range(1, 1001)) and len(settled) == 1
    assert [r["k"] for r in got] == ["hot"] * 950 + [f"k{i:03d}" for i in range(50)]


def test_correlations_where_columns_are_missing(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(800, 5)) + 1e6  # far from 0: products must not lose their digits
    base[:, 1] += base[:, 0] * 0.5
    base[:, 4] = 7.25
    data = [[None if rng.random() < 0.2 and j < 4 else float(v) for j, v in enumerate(row)] for row in base]
    names = ["a", "b", "c", "d", "const"]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    want = df.toPandas().corr()
    found = stats.correlation_matrix(df, names, 6)
    for r in rows(found):
        if "const" in (r["row_name"], r["col_name"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(want.loc[r["row_name"], r["col_name"]], abs=2e-6)
    assert stats.comoments(df, names).count() <= 16  # a row for each set of columns present
    assert all(r["correlation"] is None for r in rows(stats.correlation_matrix(df.limit(0), names)))


def test_forest_rows_are_dealt_out_by_work(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(1000, numPartitions=1)
    assert model.spread(few, 1000).rdd.getNumPartitions() == 2 * cores
    visits = 2 * cores * model.VISITS
    assert model.spread(few, visits).rdd.getNumPartitions() == 1  # cut by size already
    assert model.spread(few, visits // model.TREES + model.VISITS, always=True).rdd.getNumPartitions() > 2 * cores


def test_a_batch_is_read_once_to_be_numbered(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        read.add(1)
        return value

    values = [("a" if i % 3 else "b", i // 2) for i in range(30)]
    path = tmp_path / "batch.csv"
    path.write_text("".join(f"{g},{v}\n" for g, v in values))
    batch = spark.read.schema("g string, v int").csv(str(path)).withColumn("g", counted("g"))
    found = rows(ordering.numbered(batch, ["g", "v"], "k").orderBy("k"))
    assert read.value == 30
    assert [r["k"] for r in found] == list(range(1, 31))
    assert [(r["g"], r["v"]) for r in found] == sorted(values)
