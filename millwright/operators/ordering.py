"""Running totals and numbering over a whole table, with no task holding the whole table.

The rows are range-partitioned by the sort columns and settled; each slice then runs on its own and
is shifted by the total of the slices before it. There are as many totals as shuffle partitions,
which bounds the one small window and the broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.session import settle, settle_columns

_SLICE, _PLACE, _BEFORE = "_slice", "_place_in_slice", "_before_slice"
_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its task here


def _in_slices(df: DataFrame, order_by: list[str]) -> DataFrame:
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return settle(
        ordered.select(
            "*",
            F.spark_partition_id().alias(_SLICE),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias(_PLACE),
        )
    )


def _shifts(slices: DataFrame, weight: Column) -> DataFrame:
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = slices.groupBy(_SLICE).agg(F.sum(weight).alias("_total"))
    return totals.select(_SLICE, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(_BEFORE))


def running_total(df: DataFrame, order_by: list[str], weight: str, out: str) -> DataFrame:
    """Adds the sum of ``weight`` up to and with each row, in the order given.

    The order must tell all rows apart but equal ones.
    """
    slices = _in_slices(df, order_by)
    so_far = Window.partitionBy(_SLICE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slices.withColumn(out, F.sum(weight).over(so_far))
        .join(F.broadcast(_shifts(slices, F.col(weight))), _SLICE)
        .withColumn(out, F.col(out) + F.col(_BEFORE))
        .drop(_SLICE, _PLACE, _BEFORE)
    )


#: Copies of one row beyond this many are numbered in several tasks.
COPIES = 100_000


def numbered(df: DataFrame, order_by: list[str], out: str, after: Column | int = 0) -> DataFrame:
    """Adds after+1, after+2, ... in the order given, without gaps; ties go by the other columns.

    Equal rows are counted and given copy numbers, so that the order tells all rows apart by what they hold: a retried
    task gives the same numbers, and copies, a third of the table even, spread over the slices. The counts are settled
    once and the table once, in its new order, and each slice goes on from the count of those before it.
    """
    names = [*order_by, *[c for c in df.columns if c not in order_by]]
    # Counted once and settled: the two steps below and the sampling of the ranges would each read the batch again.
    counted = settle_columns(df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies")))
    few = counted.withColumn("_first", F.lit(0).cast("long"))
    # Only a row of many copies takes a second step: its copies are dealt out in runs of COPIES.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long")))
    many = counted.where(F.col("_copies") > COPIES).withColumn("_first", chunk).repartition("_first", *names)
    runs = few.where(F.col("_copies") <= COPIES).unionByName(many)
    last = F.least(F.col("_copies"), F.col("_first") + COPIES) - 1
    copies = runs.withColumn("_copy", F.explode(F.sequence("_first", last))).drop("_copies", "_first")
    slices = _in_slices(copies, [*names, "_copy"])
    first = F.lit(after) if isinstance(after, int) else after
    return (
        slices.join(F.broadcast(_shifts(slices, F.lit(1))), _SLICE)
        .withColumn(out, (F.col(_BEFORE) + F.col(_PLACE) + 1 + first).cast("bigint"))
        .drop(_SLICE, _PLACE, _BEFORE, "_copy")
    )


def surrogate_keys(
    batch: DataFrame, key: str, order_by: list[str] | None = None, table: DataFrame | None = None
) -> DataFrame:
    """Numbers a batch to be appended, going on from the highest key the table holds."""
    after = 0 if table is None else F.coalesce(table.agg(F.max(key)).scalar(), F.lit(0))
    rows = numbered(batch, order_by or batch.columns, key, after)
    return rows.select(key, *batch.columns)
