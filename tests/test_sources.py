from __future__ import annotations

import pytest
from conftest import MACHINES, by, rows, tables
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from millwright.operators import quality
from millwright.plans import summaries
from millwright.session import checkpoint_root
from millwright.sources import csv_files
from millwright.sources.schema import MACHINES as MACHINE_TYPES
from millwright.sources.tables import checked_sizes, read_catalog, read_folder, within_rows


MACHINE_NAMES = T.StructType([T.StructField("machine_id", T.StringType()), T.StructField("machine_name", T.StringType())])


def test_quality_checks(factory):
    assert by(quality.table_counts(factory), "table_name")["production"]["n"] == 7
    lost = {(r["table_name"], r["column_name"]): r["violations"] for r in rows(quality.orphans(factory))}
    assert lost == {
        ("production", "machine_id"): 1, ("production", "emp_id"): 1, ("production", "product_id"): 0,
        ("sales", "product_id"): 1, ("maintenance", "machine_id"): 1,
    }
    copies = by(quality.duplicate_keys(factory), "table_name")
    assert copies["maintenance"]["violations"] == 1 and copies["production"]["violations"] == 0
    assert sum(r["violations"] for r in rows(quality.nulls(factory))) == 0
    assert quality.report(factory).count() == 6 + 30 + 5


def test_nulls_are_counted(spark):
    t = tables(spark, machines=[(None, "x", "d", 1), ("M1", None, "d", None)])
    found = {r["column_name"]: r["violations"] for r in rows(quality.nulls(t)) if r["table_name"] == "machines"}
    assert found == {"machine_id": 1, "machine_name": 1, "department": 0, "age_years": 1}


def test_headers_are_cleaned_and_bad_rows_kept_apart(spark, tmp_path):
    path = tmp_path / "machines.csv"
    path.write_text(
        " Machine ID ,Machine Name, DEPARTMENT,Age Years\n"
        "M1,Lathe,Cutting,2\n"
        "M2,Press,Pressing,old\n"
        ",Mill,Cutting,7\n"
        "M4,\"Saw, small\",Cutting,1\n"
        "M5,Drill\n"
    )
    good, bad = csv_files.read_csv(spark, str(path), MACHINE_TYPES, ["machine_id", "machine_name"])
    assert [(r["machine_id"], r["machine_name"], r["age_years"]) for r in rows(good.orderBy("machine_id"))] == [
        ("M1", "Lathe", 2), ("M4", "Saw, small", 1),
    ]
    assert sorted(r["_corrupt_record"] for r in rows(bad)) == [",Mill,Cutting,7", "M2,Press,Pressing,old", "M5,Drill"]


def test_unknown_columns_and_missing_files_raise(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("Machine ID,Colour\nM1,red\n")
    with pytest.raises(ValueError, match="colour"):
        csv_files.read_csv(spark, str(path), MACHINE_TYPES, ["machine_id"])
    with pytest.raises(AnalysisException):
        csv_files.read_csv(spark, str(tmp_path / "none.csv"), MACHINE_TYPES, [])


def test_import_appends_and_numbers_facts(spark, tmp_path):
    folder, rejects = str(tmp_path / "maintenance"), str(tmp_path / "rejects")
    path = tmp_path / "m.csv"
    path.write_text("Machine ID,Maint Date,Maint Type,Cost\nM1,2024-01-05,Preventive,10.50\nM2,never,Breakdown,1\n")
    csv_files.import_csv(spark, str(path), "maintenance", folder, rejects)
    path.write_text("Machine ID,Maint Date,Maint Type,Cost\nM2,2024-01-06,Breakdown,7\nM1,2024-01-07,Breakdown,8\n")
    csv_files.import_csv(spark, str(path), "maintenance", folder, rejects)
    saved = rows(spark.read.parquet(folder).orderBy("maint_id"))
    assert [(r["maint_id"], r["machine_id"], float(r["cost"])) for r in saved] == [
        (1, "M1", 10.5), (2, "M1", 8.0), (3, "M2", 7.0),
    ]
    assert rows(spark.read.text(rejects)) == [{"value": "M2,never,Breakdown,1"}]


def test_files_of_unlike_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Machine ID,Machine Name\nM1,Lathe\n")
    (tmp_path / "b.csv").write_text("Machine Name,Machine ID\nPress,M2\n")
    good, _ = csv_files.read_csv(spark, str(tmp_path), MACHINE_NAMES, ["machine_id"])
    with pytest.raises(Exception, match="header"):
        good.collect()


def test_rejected_lines_can_be_read_again(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Machine ID,Machine Name,Age Years\nM1,"Saw, small",old\nM2,Press,3\n')
    schema = T.StructType([*MACHINE_NAMES, T.StructField("age_years", T.IntegerType())])
    good, bad = csv_files.read_csv(spark, str(tmp_path), schema, ["machine_id"])
    assert rows(good) == [{"machine_id": "M2", "machine_name": "Press", "age_years": 3}]
    assert rows(bad) == [{"_corrupt_record": 'M1,"Saw, small",old'}]


def test_folder_round_trip(spark, factory, tmp_path):
    for name, df in factory.items():
        df.write.parquet(f"{tmp_path}/{name}")
    again = read_folder(spark, str(tmp_path))
    assert rows(summaries.machine_performance(again)) == rows(summaries.machine_performance(factory))


def test_catalog_tables(spark, factory):
    spark.sql("CREATE DATABASE IF NOT EXISTS plant")
    try:
        for name, df in factory.items():
            df.write.mode("overwrite").saveAsTable(f"plant.{name}")
        again = read_catalog(spark, "plant")
        assert rows(summaries.shift_analysis(again)) == rows(summaries.shift_analysis(factory))
    finally:
        spark.sql("DROP DATABASE plant CASCADE")


def test_summary_file_keeps_order_and_header(spark, factory, tmp_path):
    table = summaries.machine_performance(factory)
    csv_files.write_summary(table, str(tmp_path / "out"), one_file=True)
    written = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    assert written[0].startswith("machine_id,machine_name,department,age_years,total_runs")
    assert [line.split(",")[0] for line in written[1:]] == [r["machine_id"] for r in rows(table)]


def test_only_small_dimensions_are_broadcast(spark, factory):
    assert checked_sizes(factory).small == {"machines", "employees", "products"}
    assert within_rows(spark.range(10), 10) and not within_rows(spark.range(11), 10)
    assert len(MACHINES) == factory.machines.count()


def test_checkpoints_go_where_the_session_says(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or checkpoint_root(spark) == named
