"""What the operators of this folder share: written tables, columns of ``documents``, connected groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import checkpoint_root

#: Characters that are no word characters (everything else, also every non-ASCII character, is).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a Parquet table of the shared folder, and read from there.

    It cuts the lineage: a lost executor costs only the tasks that read its part again.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: So many narrow rows are broadcast (some 100 MB in memory at most); more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, name: str) -> DataFrame:
    """``df``, narrow rows, written and counted; marked for broadcast if few, so that wide rows need no shuffle."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def looked_up(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``keys``, a frame of that distinct column; NULL finds NULL."""
    keys = broadcast_if_small(keys.select(F.col(key).alias("_key")), "keys")
    return df.join(keys, df[key].eqNullSafe(keys["_key"]), "left_semi")


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """Connected groups of an undirected graph: (node, root) of all nodes but the roots, a group's smallest nodes.

    Large-star and small-star steps in turn: every node hands its neighbours to the smallest node it sees, so the
    longest path shrinks by a factor in each round. All work is grouping and joins on node ids; a hub's rows are
    added up before they are shuffled, and joins on a hub are split at run time. Only the number of changed rows
    comes to the driver.
    """
    edges = written(
        links.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi"))
        .where("lo < hi")
        .distinct(),
        "edges",
    )
    state = None
    for _ in range(rounds):
        # Large star: the larger neighbours of a node go to the smallest of its neighbourhood.
        both = edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(
            edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        )
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
        large = (
            both.where("other > node")
            .join(least, "node")
            .select(F.col("least").alias("lo"), F.col("other").alias("hi"))
            .where("lo < hi")
            .distinct()
        )
        # Small star: a node and its smaller neighbours go to the smallest of them.
        down = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(down, "hi")
            .select(F.col("least").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
            .where("lo < hi")
            .distinct()
        )
        edges = written(small, "edges")
        now = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if state == tuple(now):
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"groups did not settle in {rounds} rounds")
