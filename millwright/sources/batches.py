"""Tables that grow by batches, each of which counts once however often it is brought.

A table's folder holds ``data/<attempt>`` with the rows of one attempt at a batch, and ``log/<n>`` with one line for each
batch that counts: its name and its attempt. An attempt writes its rows first and then makes the next log entry, in one
step that fails if the entry exists. So a failed attempt leaves rows that no reader sees, a repeated batch finds its
name in the log and does nothing, and of two writers at once one is told to try again, from the keys that the other
left. Readers read the attempts in the log and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators.ordering import surrogate_keys
from millwright.sources.csv_files import NUMBERED, read_csv
from millwright.sources.schema import PRIMARY_KEYS, SCHEMAS, required_columns


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def log(spark: SparkSession, into: str) -> list[tuple[str, str]]:
    """(batch, attempt) of every batch that counts, in order."""
    path, files = _path(spark, f"{into}/log")
    if not files.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(path))
    names = [n for n in names if n.isdigit()]
    if not names:
        return []
    lines = spark.read.text([f"{into}/log/{n}" for n in names]).select(F.input_file_name().alias("file"), "value").collect()
    return [tuple(r.value.split("\t")) for r in sorted(lines, key=lambda r: r.file.rsplit("/", 1)[1])]


def _commit(spark: SparkSession, into: str, place: int, batch: str, attempt: str) -> bool:
    """Makes log entry ``place``, unless it exists. The entry is written aside and renamed, so it is never half there."""
    aside, files = _path(spark, f"{into}/log/_{attempt}")
    entry, _ = _path(spark, f"{into}/log/{place:08d}")
    out = files.create(aside, False)
    out.write(bytearray(f"{batch}\t{attempt}".encode()))
    out.close()
    made = not files.exists(entry) and files.rename(aside, entry)
    if not made:
        files.delete(aside, False)
    return made


def stage(rows: DataFrame, into: str) -> str:
    """Writes an attempt, which nobody reads until it is in the log; returns its name."""
    attempt = uuid.uuid4().hex
    rows.write.parquet(f"{into}/data/{attempt}")
    return attempt


def read(spark: SparkSession, into: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that count."""
    attempts = [attempt for _, attempt in log(spark, into)]
    if not attempts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{into}/data/{a}" for a in attempts])


def batches(spark: SparkSession, into: str, schema: T.StructType) -> DataFrame:
    """(place, batch, n): the batches that count with their rows."""
    found = log(spark, into)
    parts = [
        spark.read.schema(schema).parquet(f"{into}/data/{attempt}").agg(F.count("*").alias("n")).select(
            F.lit(place).alias("place"), F.lit(batch).alias("batch"), "n"
        )
        for place, (batch, attempt) in enumerate(found)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "place int, batch string, n long")


def append(
    spark: SparkSession, into: str, batch: str, rows_after: Callable[[DataFrame], DataFrame], schema: T.StructType,
    tries: int = 5,
) -> bool:
    """Appends a batch unless it counts already; says whether it did.

    ``rows_after`` makes the batch's rows from the table as it is. They are made again if another batch came in between.
    """
    if not batch or set(batch) & set("\t\r\n"):
        raise ValueError("a batch has a name of one line")
    for _ in range(tries):
        found = log(spark, into)
        if batch in {name for name, _ in found}:
            return False
        attempt = stage(rows_after(read(spark, into, schema)), into)
        if _commit(spark, into, len(found), batch, attempt):
            return True
    raise RuntimeError(f"{tries} other batches came in between")


def import_batch(spark: SparkSession, path: str, table: str, into: str, batch: str, rejects: str | None = None) -> bool:
    """Appends a CSV file to a factory table as a batch; its bad rows go to ``rejects/<batch>``, once too.

    A fact file may leave out its running number: the rows then go on from the highest in the table.
    """
    schema, key = SCHEMAS[table], PRIMARY_KEYS[table]
    own = [c for c in required_columns(table) if not (c == key and table in NUMBERED)]
    good, bad = read_csv(spark, path, schema, own)

    def rows(existing: DataFrame) -> DataFrame:
        numbered = good
        if table in NUMBERED and key not in good.columns:
            numbered = surrogate_keys(good, key, table=existing)
        return numbered.select(
            *[(F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        )

    done = append(spark, into, batch, rows, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    if done and rejects is not None:
        bad.write.mode("overwrite").text(f"{rejects}/{batch}")
    return done


def clear_failed(spark: SparkSession, into: str) -> int:
    """Removes attempts that are not in the log; for a time when nobody writes. Returns how many there were."""
    path, files = _path(spark, f"{into}/data")
    known = {attempt for _, attempt in log(spark, into)}
    stale = [s.getPath() for s in (files.listStatus(path) if files.exists(path) else []) if s.getPath().getName() not in known]
    for found in stale:
        files.delete(found, True)
    return len(stale)
