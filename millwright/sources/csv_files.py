"""CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators.ordering import surrogate_keys
from millwright.session import settle
from millwright.sources.schema import PRIMARY_KEYS, SCHEMAS, required_columns
from millwright.sources.tables import read_table

# Tables whose key is a running number given on insert.
NUMBERED = ("production", "sales", "maintenance")


def clean_name(header: str) -> str:
    """' Prod Date ' -> 'prod_date'"""
    return header.strip().lower().replace(" ", "_")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    required: list[str],
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) of a CSV file with a header.

    Every column is read as text and cast to its declared type. A row that loses a value to the cast,
    misses a required one or has the wrong number of fields goes to the bad rows, as a CSV line that can be
    read again (fields are quoted where they must be). All files of a folder must have the same header; one
    that differs raises an error, and so does a missing path.
    """
    raw_header = spark.read.option("header", True).csv(path).columns
    names = [clean_name(h) for h in raw_header]
    unknown = sorted(set(names) - set(schema.names))
    missing = sorted(set(required) - set(names))
    if unknown or missing or len(set(names)) != len(names):
        raise ValueError(f"CSV columns: unknown {unknown}, missing {missing}, read {names}")

    text = T.StructType([T.StructField(n, T.StringType()) for n in [*raw_header, "_line"]])
    rows = (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .csv(path)
        .toDF(*names, "_line")
    )
    cast = {n: F.col(n).try_cast(schema[n].dataType) for n in names}
    lost = [F.col(n).isNotNull() & cast[n].isNull() for n in names]
    absent = [F.col(n).isNull() for n in required]
    bad = F.col("_line").isNotNull()
    for test in [*lost, *absent]:
        bad = bad | test
    marked = rows.withColumn("_bad", bad)
    good = marked.where(~F.col("_bad")).select(*[cast[n].alias(n) for n in names])
    rejected = marked.where("_bad").select(
        F.coalesce("_line", F.to_csv(F.struct(*names))).alias("_corrupt_record")
    )
    return good, rejected


def import_csv(spark: SparkSession, path: str, table: str, into: str, rejects: str | None = None) -> None:
    """Appends a CSV file to the parquet folder of a factory table, and its bad rows to ``rejects``.

    A fact file may leave out its running number: the rows then go on from the highest in the folder.
    """
    key = PRIMARY_KEYS[table]
    own = [c for c in required_columns(table) if not (c == key and table in NUMBERED)]
    good, bad = read_csv(spark, path, SCHEMAS[table], own)
    if table in NUMBERED and key not in good.columns:
        good = surrogate_keys(good, key, table=_existing(spark, into, table))
    complete = [
        (F.col(f.name) if f.name in good.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[table]
    ]
    append(good.select(*complete), into)
    if rejects is not None:
        bad.write.mode("append").text(rejects)


def _existing(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """The rows already in the folder, or None where there is no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return read_table(spark, table, folder) if files.exists(path) else None


def append(rows: DataFrame, into: str) -> None:
    rows.write.mode("append").parquet(into)


def write_summary(summary: DataFrame, path: str, one_file: bool = False) -> None:
    """A result as CSV with a header, in its own order.

    It is written in several files, whose names sort in order; ``one_file`` is for a caller who knows that one task can
    write it.
    """
    whole = settle(summary).coalesce(1) if one_file else summary
    whole.write.mode("overwrite").option("header", True).csv(path)
