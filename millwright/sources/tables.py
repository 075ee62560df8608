"""Reading the six factory tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from millwright.sources.schema import SCHEMAS

# A dimension row as the plans use it (a key and a few short columns) stays under 200 bytes, so a
# dimension of this many rows makes a broadcast of at most 20 MB.
SMALL_ROWS = 100_000


@dataclass(frozen=True)
class FactoryTables:
    """The six tables as DataFrames, from whatever source Spark can read.

    ``trusted`` names dimensions whose links from production are known to hold, because the store
    enforces them or ``quality.orphans`` found none. An inner join to a trusted dimension can lose no
    row, so plans that need none of its columns leave the join out.

    ``small`` names dimensions counted and found within ``SMALL_ROWS``; they are broadcast. The others
    are left to Spark, which broadcasts by its own size estimate and shuffles beyond it.
    """

    machines: DataFrame
    employees: DataFrame
    products: DataFrame
    production: DataFrame
    sales: DataFrame
    maintenance: DataFrame
    trusted: frozenset[str] = frozenset()
    small: frozenset[str] = frozenset()

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in SCHEMAS]

    def trusting(self, *dimensions: str) -> FactoryTables:
        return replace(self, trusted=self.trusted | frozenset(dimensions))


def within_rows(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """Whether the table has at most ``limit`` rows; reads no further than that."""
    return df.limit(limit + 1).count() <= limit


def checked_sizes(t: FactoryTables) -> FactoryTables:
    """Counts the dimensions and marks the small ones."""
    dimensions = ("machines", "employees", "products")
    return replace(t, small=frozenset(d for d in dimensions if within_rows(getattr(t, d))))


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One table with its declared types; nothing is inferred, so no extra pass over the files."""
    reader = spark.read.schema(SCHEMAS[name]).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.load(path)


def read_folder(spark: SparkSession, folder: str, fmt: str = "parquet") -> FactoryTables:
    """All six tables, each in ``folder/<table name>``."""
    return FactoryTables(**{name: read_table(spark, name, f"{folder}/{name}", fmt) for name in SCHEMAS})


def read_catalog(spark: SparkSession, database: str) -> FactoryTables:
    """All six tables from a catalog database (bucketed and partitioned tables keep their layout)."""
    return FactoryTables(**{name: spark.table(f"{database}.{name}") for name in SCHEMAS})
