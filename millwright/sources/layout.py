"""Runs laid out by month, so that a span of days, or a filter on the calendar, reads only its months' files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTH = "run_month"
#: Rows of a file, at most; a month of more is written as several.
FILE_ROWS = 5_000_000


def write_by_month(runs: DataFrame, path: str, date: str = "prod_date", tasks_a_month: int = 1) -> None:
    """Writes the runs and their calendar: ``path/runs`` in a folder a month, ``path/months`` with a row a month.

    Rows are dealt by month before writing, so a month becomes a few files, not one a task. ``tasks_a_month`` splits
    months (a hot one too) over so many tasks. Runs without a date have a folder of their own.
    """
    dated = runs.withColumn(MONTH, F.trunc(date, "MM"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in runs.columns]), F.lit(tasks_a_month))
    dealt = dated.repartition(F.col(MONTH), salt)
    dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(MONTH).parquet(f"{path}/runs")
    months = runs.sparkSession.read.parquet(f"{path}/runs").select(MONTH).distinct().where(f"{MONTH} is not null")
    months.select(
        MONTH, F.year(MONTH).alias("year"), F.quarter(MONTH).alias("quarter"), F.month(MONTH).alias("month_no")
    ).coalesce(1).write.parquet(f"{path}/months")  # a row a month


def read_by_month(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The runs with ``run_month``, by which Spark leaves out folders."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(MONTH, T.DateType())])).parquet(f"{path}/runs")


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The calendar of the layout: run_month, year, quarter, month_no."""
    return spark.read.schema(f"{MONTH} date, year int, quarter int, month_no int").parquet(f"{path}/months")


def between(runs: DataFrame, date_from: str | None = None, date_to: str | None = None, date: str = "prod_date") -> DataFrame:
    """Runs of a span of days, both ends included. Only the span's months are read."""
    for text, earlier in ((date_from, True), (date_to, False)):
        if text is not None:
            day = dt.date.fromisoformat(text)
            edge, first = F.lit(day), F.lit(day.replace(day=1))
            runs = runs.where((F.col(MONTH) >= first) & (F.col(date) >= edge) if earlier else (F.col(MONTH) <= first) & (F.col(date) <= edge))
    return runs


def of_months(runs: DataFrame, months: DataFrame) -> DataFrame:
    """Runs of the months left in a filtered calendar; which folders that is, the join tells the scan at run time."""
    return runs.join(F.broadcast(months.select(MONTH)), MONTH)  # a row a month
