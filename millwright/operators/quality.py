"""Row counts and key checks, as tables of (table, check, column, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.sources.schema import FOREIGN_KEYS, PRIMARY_KEYS, required_columns
from millwright.sources.tables import FactoryTables


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_counts(t: FactoryTables) -> DataFrame:
    return _stacked(
        [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in t.items()]
    )


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, n) of Parquet tables, from the files' footers: no page of data is read.

    Counting is pushed into the reader, which only the newer Parquet source does; it is chosen for a session of its own,
    so that other reads of ``spark`` stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return _stacked(
        [
            own.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            for name, path in paths.items()
        ]
    )


def _finding(df: DataFrame, table: str, check: str, column: str) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.lit(column).alias("column_name"),
        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
    )


def orphans(t: FactoryTables) -> DataFrame:
    """Fact rows without their dimension row, for every link.

    Fact rows are counted by key before they meet the dimension, so a hot key travels as one row.
    """
    found = []
    for fact, key, dim in FOREIGN_KEYS:
        keys = getattr(t, fact).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        lost = keys.join(getattr(t, dim).select(key), key, "left_anti")
        found.append(_finding(lost.agg(F.sum("n").alias("violations")), fact, "foreign_key", key))
    return _stacked(found)


def nulls(t: FactoryTables) -> DataFrame:
    """NULLs in the columns that must not have any; one pass per table."""
    found = []
    for name, df in t.items():
        columns = [c for c in required_columns(name) if c in df.columns]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        long = counts.unpivot([], columns, "column_name", "violations")
        found.append(
            long.select(
                F.lit(name).alias("table_name"),
                F.lit("not_null").alias("check_name"),
                "column_name",
                F.col("violations").cast("bigint").alias("violations"),
            )
        )
    return _stacked(found)


def duplicate_keys(t: FactoryTables) -> DataFrame:
    """Rows beyond the first of each primary key; tables read without their key are left out."""
    found = []
    for name, df in t.items():
        key = PRIMARY_KEYS[name]
        if key in df.columns:
            copies = df.groupBy(key).agg((F.count("*") - 1).alias("extra")).where("extra > 0")
            found.append(_finding(copies.agg(F.sum("extra").alias("violations")), name, "primary_key", key))
    return _stacked(found)


def report(t: FactoryTables) -> DataFrame:
    return _stacked([duplicate_keys(t), nulls(t), orphans(t)])
