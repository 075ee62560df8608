from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from millwright.operators import ordering
from millwright.operators import quantiles as Q


@pytest.fixture(scope="module")
def numbers(spark):
    """Three groups, one of them holding most rows, with many copies of one value."""
    rng = random.Random(5)
    data = [("a", round(rng.gauss(50, 20), 2)) for _ in range(3000)]
    data += [("a", 7.0)] * 2500 + [("b", float(i % 7)) for i in range(40)] + [("c", 1.5)]
    data += [("a", None), (None, 3.0)]
    return spark.createDataFrame(data, "g string, v double").repartition(7)


def test_numbering_is_dense_even_among_copies(spark):
    df = spark.createDataFrame([(1, "x")] * 900 + [(i % 50, "y") for i in range(600)], "k int, t string")
    got = rows(ordering.numbered(df, ["k", "t"], "id").orderBy("id"))
    assert [r["id"] for r in got] == list(range(1, 1501))
    assert [(r["k"], r["t"]) for r in got] == sorted((r["k"], r["t"]) for r in got)


def test_copies_spread_over_slices(spark):
    df = spark.createDataFrame([(1,)] * 4000, "k int").repartition(4)
    placed = ordering.settle(df).withColumn("_tie", F.monotonically_increasing_id())
    joining = "spark.sql.adaptive.coalescePartitions.enabled"  # would join slices as small as these
    spark.conf.set(joining, "false")
    try:
        slices = ordering._in_slices(placed, ["k", "_tie"])
    finally:
        spark.conf.unset(joining)
    assert slices.groupBy("_slice").count().agg(F.max("count")).first()[0] < 4000


def test_surrogate_keys_go_on_from_the_table(spark):
    table = spark.createDataFrame([(41, "old")], "id int, t string")
    batch = spark.createDataFrame([("b",), ("a",)], "t string")
    got = rows(ordering.surrogate_keys(batch, "id", table=table).orderBy("id"))
    assert got == [{"id": 42, "t": "a"}, {"id": 43, "t": "b"}]
    empty = ordering.surrogate_keys(batch, "id", table=table.limit(0))
    assert sorted(r["id"] for r in rows(empty)) == [1, 2]


def test_running_total(spark):
    df = spark.range(1, 2001).select(F.col("id").alias("k"), (F.col("id") % 5).alias("w")).repartition(6)
    got = rows(ordering.running_total(df, ["k"], "w", "so_far").orderBy("k"))
    assert [r["so_far"] for r in got] == list(np.cumsum([r["w"] for r in got]))


def test_quantiles_equal_numpy(numbers):
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = by(Q.quantiles(numbers, "v", wanted, "g", ["a", "b", "c"]), "g")
    assert set(got) == {"a", "b", "c"}
    data = [(r["g"], r["v"]) for r in rows(numbers) if r["v"] is not None]
    for group, found in got.items():
        values = [v for g, v in data if g == group]
        for name, p in wanted.items():
            assert found[name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    whole = rows(Q.quantiles(numbers, "v", wanted))
    assert whole[0]["p90"] == pytest.approx(np.quantile([v for _, v in data], 0.9), abs=1e-9)


def test_approximate_quantiles_are_near(numbers):
    exact = rows(Q.quantiles(numbers.where("g = 'a'"), "v", {"p": 0.5}))[0]["p"]
    near = by(Q.quantiles(numbers, "v", {"p": 0.5}, "g", ["a"], approx=True), "g")["a"]["p"]
    assert near == pytest.approx(exact, abs=0.5)


def test_groups_must_be_listed(numbers):
    with pytest.raises(ValueError):
        Q.quantiles(numbers, "v", {"p": 0.5}, "g")
