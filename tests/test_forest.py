"""The forest for many rows, held against brute force and against Spark's own way of scoring."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from catalog import queries, shared
from millwright.operators import forest, model


@pytest.fixture(scope="module")
def labelled(spark):
    """Hot and shaking machines make more defects, and those of one department that is not the first or last by name."""
    rng = random.Random(5)
    data = []
    for i in range(3000):
        temperature, vibration = round(rng.uniform(60, 100), 1), rng.uniform(0.5, 4.5)
        department = rng.choice(["Cutting", "Milling", "Pressing"])
        rate = 0.05 * (temperature - 60) + vibration + 0.8 * (department == "Milling") + rng.gauss(0, 0.2)
        data.append(
            (
                i, temperature, rng.uniform(4, 8), rng.uniform(0, 2), rng.randint(1, 9), vibration, rng.uniform(40, 80),
                rng.randint(1, 10), rng.randint(50, 900), rng.choice(["Morning", "Evening", "Night"]), department, rate,
            )
        )
    df = spark.createDataFrame(
        data,
        "prod_id int, temperature double, pressure double, downtime_hrs double, age_years int, vibration_level double, "
        "humidity double, experience_yrs int, units_made int, shift string, department string, defect_rate double",
    )
    return model.settle(model.with_label(df.repartition(4)))


@pytest.fixture
def few_are_many(monkeypatch):
    monkeypatch.setattr(model, "MANY_ROWS", 100)
    monkeypatch.setattr(model, "fit", lambda *_, **__: pytest.fail("Spark's forest was grown on many rows"))


def test_cuts_lie_between_values():
    assert forest.candidate_cuts(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert forest.candidate_cuts(np.array([4.0])).tolist() == [] == forest.candidate_cuts(np.array([])).tolist()
    many = forest.candidate_cuts(np.arange(1000.0))
    assert len(many) == 31 and np.allclose(np.diff(many), 1000 / 32, atol=1.5)
    # One value that most rows have does not use up the cuts' order.
    heavy = forest.candidate_cuts(np.r_[np.zeros(5000), np.arange(1, 100)])
    assert heavy[0] == 0.5 and (np.diff(heavy) > 0).all() and len(heavy) <= 31


def test_draws_are_poisson_and_repeatable():
    table = forest._poisson()
    found, times = forest._drawn_rows(table, 42, 3, 7, 200_001)
    again, _ = forest._drawn_rows(table, 42, 3, 7, 200_001)
    other, _ = forest._drawn_rows(table, 42, 4, 7, 200_001)
    assert (found == again).all() and len(np.setxor1d(found, other)) > 50_000
    for k, p in ((0, 1), (1, 1), (2, 1 / 2), (3, 1 / 6), (4, 1 / 24)):
        share = (200_001 - len(found) if k == 0 else (times == k).sum()) / 200_001
        assert share == pytest.approx(p / math.e, abs=0.004)


def test_best_cuts_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    sizes, categorical = np.array([6, 4, 2, 1]), np.array([False, True, False, True])
    drawn = np.array([[0, 1, 3], [1, 2, 3], [0, 2, 3], [0, 1, 2]])
    counts = np.zeros((4, 3, forest.BINS, 2))
    for node, inputs in enumerate(drawn):
        labels = rng.integers(0, 2, 60)
        for j, f in enumerate(inputs):  # the same 60 rows, seen by each input
            np.add.at(counts[node, j], (rng.integers(0, sizes[f], 60), labels), 1)
    found = forest.best_cuts(counts, drawn, sizes, categorical, 2)

    def gini(c):
        return 1 - sum((x / c.sum()) ** 2 for x in c) if c.sum() else 0

    for node, inputs in enumerate(drawn):
        gains = {}
        for j, f in enumerate(inputs):
            c = counts[node, j, : sizes[f]]
            for bits in range(1, 2 ** int(sizes[f]) - 1):
                left = [b for b in range(sizes[f]) if bits >> b & 1]
                if not categorical[f] and left != list(range(len(left))):
                    continue
                a, b = c[left].sum(0), c.sum(0) - c[left].sum(0)
                if min(a.sum(), b.sum()) >= 2:
                    gains[f, bits] = gini(c.sum(0)) - a.sum() / 60 * gini(a) - b.sum() / 60 * gini(b)
        best = max(gains.values())
        chosen = found[node]
        assert chosen["gain"] == pytest.approx(best)
        assert gains[int(chosen["feature"]), int(chosen["left"])] == pytest.approx(best)
    nothing = forest.best_cuts(counts[:1] * [1, 0], drawn[:1], sizes, categorical, 2)
    assert nothing["feature"][0] == -1


def test_every_node_holds_the_rows_that_come_to_it(spark, labelled, tmp_path, monkeypatch):
    """All nodes of all trees, counted again row by row from the values themselves."""
    monkeypatch.setattr(forest, "BLOCK", 500)
    kept = []
    settle = forest.settle
    monkeypatch.setattr(forest, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    order = [*model.FEATURES, model.LABEL]
    trained = model.grow(labelled, labelled.count(), trees=4)
    nodes = trained.stages[-1]
    nodes.write().save(str(tmp_path / "forest"))
    saved = spark.read.parquet(str(tmp_path / "forest" / "data")).orderBy("treeID", "nodeData.id").collect()
    # Blocks hold rows as they came, so the same rows with their values are found by packing their number as well.
    indexed = labelled
    for stage in trained.stages[:2]:
        indexed = stage.transform(indexed)
    of_part = {p: part for p, part in enumerate(model.model_input(indexed).select(*order).rdd.glom().collect())}
    for tree in range(4):
        stats = {n.nodeData.id: np.zeros(2) for n in saved if n.treeID == tree}
        by_id = {n.nodeData.id: n.nodeData for n in saved if n.treeID == tree}
        for block, packed in kept[0].collect():
            part, place = block >> 24, (block & 0xFFFFFF) * 500
            values = of_part[part][place : place + len(packed) // 10]
            found, times = forest._drawn_rows(forest._poisson(), model.SEED, tree, block, len(values))
            for i, weight in zip(found, times):
                row, at = values[i], 0
                while True:
                    stats[at][row[10]] += weight
                    node = by_id[at]
                    if node.leftChild < 0:
                        break
                    x, split = row[node.split.featureIndex], node.split
                    left = x <= split.leftCategoriesOrThreshold[0] if split.numCategories < 0 else x in split.leftCategoriesOrThreshold
                    at = node.leftChild if left else node.rightChild
        for i, node in by_id.items():
            assert stats[i].tolist() == list(node.impurityStats) and node.rawCount == stats[i].sum() >= 2
        assert sum(n.leftChild >= 0 for n in by_id.values()) > 20
    assert sum(len(b.bins) for b in kept[0].collect()) == 10 * labelled.count()
    assert kept[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_many_rows_are_scored_as_spark_scores_them(spark, labelled, few_are_many, tmp_path):
    parts = model.split(labelled, ["prod_id"])
    trained = model.train(parts.where("not is_test"), trees=20)
    test = parts.where("is_test")
    assert model.scored_anywhere(trained) and model.scoring_set(test, always=True, model=trained) is test
    assert rows(model.accuracy(model.score(trained, test)))[0]["accuracy_pct"] > 85
    path = str(tmp_path / "model")
    model.save(trained, path)
    loaded = model.load(spark, path)
    assert model.scored_anywhere(loaded)
    wanted = [*test.columns, model.PREDICTION, model.PROBABILITY]
    found = [rows(model.score(m, test).orderBy("prod_id")) for m in (trained, loaded)]
    loaded.arrays = None
    by_spark = model.score(loaded, test).orderBy("prod_id")
    assert found[0] == found[1] == rows(by_spark) and by_spark.columns == wanted
    assert set(loaded.stages[-1].featureImportances.indices) >= {0, 4, 9}


def test_the_order_of_tasks_changes_no_tree(labelled, few_are_many, monkeypatch):
    whole = model.train(labelled, trees=3).stages[-1].toDebugString.split("\n")[1:]
    monkeypatch.setattr(forest, "TASK_ROWS", 100)  # the same blocks in many tasks
    assert model.train(labelled, trees=3).stages[-1].toDebugString.split("\n")[1:] == whole


def test_rows_without_an_input_are_an_error(labelled, few_are_many):
    for broken in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="lacks an input|not a number"):
            model.train(labelled.withColumn("pressure", F.when(F.col("prod_id") == 7, broken).otherwise(F.col("pressure"))), trees=2)


def test_rows_of_one_label_grow_no_branch(labelled, few_are_many):
    trained = model.train(labelled.withColumn(model.LABEL, F.lit(0)), trees=2)
    assert trained.stages[-1].totalNumNodes == 2
    assert rows(model.score(trained, labelled).select(model.PREDICTION, model.PROBABILITY).distinct()) == [{model.PREDICTION: 0, model.PROBABILITY: 0.0}]


def test_folds_of_many_rows(labelled, few_are_many):
    scores = rows(model.cross_validation(labelled, ["prod_id"], folds=3, trees=5).orderBy("fold"))
    assert [s["fold"] for s in scores] == [1, 2, 3] and sum(s["n"] for s in scores) == labelled.count()
    mean = sum(s["accuracy"] for s in scores) / 3
    assert scores[0]["mean_pct"] == pytest.approx(mean * 100, abs=0.01) and mean > 0.8


def test_checks_of_a_forest_on_many_rows(spark, few_are_many, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "_settled", {})
    forest_of = model.train(shared.split_runs(spark, folder).where("not is_test"), trees=3)
    monkeypatch.setattr(shared, "trained_model", lambda *_: forest_of)
    scored = shared.scored_test_runs(spark, folder)
    assert scored.inputFiles()  # kept by column, as no task needs its rows in an order
    found = rows(queries.queries()["model_checks"](spark, folder))[0]
    assert (found["scored"], found["changed_scores"], found["bad_probabilities"], found["disagreements"]) == (scored.count(), 0, 0, 0)
    everything = queries.queries()["score_production"](spark, folder)
    assert everything.count() == shared.model_runs(spark, folder).count()
