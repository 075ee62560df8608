from __future__ import annotations

import random

import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from catalog import queries, shared
from millwright.operators import model, star
from millwright.plans import cells, report


@pytest.fixture(scope="module")
def labelled(spark):
    """Hot and shaking machines make more defects; three quarters stay below the threshold."""
    rng = random.Random(1)
    data = []
    for i in range(1500):
        temperature, vibration = rng.uniform(60, 100), rng.uniform(0.5, 4.5)
        rate = 0.05 * (temperature - 60) + vibration + rng.gauss(0, 0.2)
        data.append(
            (
                i, temperature, rng.uniform(4, 8), rng.uniform(0, 2), rng.randint(1, 9), vibration, rng.uniform(40, 80),
                rng.randint(1, 10), rng.randint(50, 900), rng.choice(["Morning", "Evening", "Night"]),
                rng.choice(["Pressing", "Cutting"]), rate,
            )
        )
    df = spark.createDataFrame(
        data,
        "prod_id int, temperature double, pressure double, downtime_hrs double, age_years int, vibration_level double, "
        "humidity double, experience_yrs int, units_made int, shift string, department string, defect_rate double",
    )
    return model.settle(model.with_label(df.repartition(4)))


@pytest.fixture(scope="module")
def trained(labelled):
    return model.fit(model.training_set(model.split(labelled, ["prod_id"]).where("not is_test")), trees=20)


def test_threshold_is_rounded_before_the_comparison(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 3.333)], "defect_rate double")
    assert rows(model.defect_threshold(df)) == [{"threshold": 3.08}]
    assert sorted(r[model.LABEL] for r in rows(model.with_label(df))) == [0, 0, 0, 1]
    fixed = spark.createDataFrame([(1.5,)], "threshold double")
    assert sum(r[model.LABEL] for r in rows(model.with_label(df, fixed))) == 3


def test_label_balance(labelled):
    balance = by(model.label_balance(labelled), model.LABEL)
    assert balance[1]["n"] == pytest.approx(375, abs=5)
    assert balance[0]["share_pct"] + balance[1]["share_pct"] == pytest.approx(100)


def test_codes_are_alphabetical(labelled):
    codes = {(r["column"], r["category"]): r["code"] for r in rows(model.encode_categories(labelled, ["shift", "department"]))}
    assert codes == {
        ("shift", "Evening"): 0, ("shift", "Morning"): 1, ("shift", "Night"): 2,
        ("department", "Cutting"): 0, ("department", "Pressing"): 1,
    }


def test_pipeline_uses_the_same_codes(trained):
    assert trained.stages[0].labels == ["Evening", "Morning", "Night"]


def test_split_is_stratified_complete_and_repeatable(labelled):
    parts = model.split(labelled, ["prod_id"])
    assert parts.count() == labelled.count()
    for row in rows(parts.groupBy(model.LABEL).agg(F.avg(F.col("is_test").cast("int")).alias("share"))):
        assert row["share"] == pytest.approx(0.2, abs=0.005)
    once = {r["prod_id"] for r in rows(parts.where("is_test"))}
    again = {r["prod_id"] for r in rows(model.split(labelled.repartition(3), ["prod_id"]).where("is_test"))}
    other = {r["prod_id"] for r in rows(model.split(labelled, ["prod_id"], seed=7).where("is_test"))}
    assert once == again != other


def test_folds_are_equal_per_class(labelled):
    folds = rows(model.with_fold(labelled, ["prod_id"]).groupBy(model.LABEL, "fold").count())
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r[model.LABEL] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2


def test_forest_beats_the_larger_class(labelled, trained):
    scored = model.score(trained, model.split(labelled, ["prod_id"]).where("is_test"))
    result = rows(model.accuracy(scored))[0]
    assert result["accuracy_pct"] > 85
    assert result["correct"] + result["wrong"] == result["n"] == scored.count()


def test_importances(spark, trained):
    table = rows(model.feature_importance(spark, trained).orderBy("rank"))
    assert [r["rank"] for r in table] == list(range(1, 11))
    assert sum(r["importance"] for r in table) == pytest.approx(1)
    assert {table[0]["feature"], table[1]["feature"]} == {"temperature", "vibration_level"}
    assert [r["is_top"] for r in table] == [True] + [False] * 9
    assert table[0]["bar"] == "#" * int(table[0]["importance"] * 50)


def test_saved_model_predicts_the_same(spark, labelled, trained, tmp_path):
    path = str(tmp_path / "model")
    assert model.load(spark, path) is None
    model.save(trained, path)
    order = lambda m: rows(model.score(m, labelled).select("prod_id", model.PREDICTION, model.PROBABILITY).orderBy("prod_id"))
    assert order(model.load(spark, path)) == order(trained)


def test_importances_from_saved_nodes(spark, trained, tmp_path):
    model.save(trained, str(tmp_path / "forest"))
    own = by(model.importances_from_nodes(spark, str(tmp_path / "forest")), "feature")
    stated = trained.stages[-1].featureImportances.toArray()
    assert set(own) == set(model.FEATURES)
    for name, want in zip(model.FEATURES, stated):
        assert own[name]["importance"] == pytest.approx(want, abs=1e-9)
    nodes = model.saved_nodes(spark, str(tmp_path / "forest"))
    assert nodes.select("tree").distinct().count() == 20


def test_missing_model(labelled):
    with pytest.raises(ValueError):
        model.score(None, labelled)
    zero = model.score(None, labelled, on_missing="zero")
    assert rows(zero.agg(F.sum(model.PREDICTION).alias("p"), F.sum(model.PROBABILITY).alias("q"))) == [{"p": 0, "q": 0.0}]


def test_planned_runs(spark, trained):
    cases = spark.createDataFrame(
        [
            ("bad", 98.0, 7.2, 1.8, 7, 4.4, 70.0, 2, 200, "Night", "Cutting"),
            ("normal", 62.0, 5.0, 0.2, 1, 0.8, 55.0, 9, 400, "Morning", "Pressing"),
        ],
        "scenario string, temperature double, pressure double, downtime_hrs double, age_years int, "
        "vibration_level double, humidity double, experience_yrs int, units_made int, shift string, department string",
    )
    found = by(model.risk(trained, cases), "scenario")
    assert found["bad"]["risk"] == "HIGH DEFECT RISK" and found["normal"]["risk"] == "LOW DEFECT RISK"
    assert found["bad"]["low_pct"] + found["bad"]["high_pct"] == pytest.approx(100, abs=0.11)


def test_unseen_category_is_an_error(trained, labelled):
    with pytest.raises(Exception, match="(?i)unseen"):
        model.score(trained, labelled.withColumn("shift", F.lit("Dawn"))).collect()


def test_reports_from_counts(spark):
    pairs = [(0, 0)] * 50 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 35
    df = spark.createDataFrame(pairs, f"{model.LABEL} int, {model.PREDICTION} int")
    cells = {(r["actual"], r["predicted"]): (r["n"], r["row_pct"]) for r in rows(model.confusion_matrix(df))}
    assert cells == {(0, 0): (50, 83.3), (0, 1): (10, 16.7), (1, 0): (5, 12.5), (1, 1): (35, 87.5)}
    report = by(model.classification_report(df), "class")
    assert report["HIGH Defect"]["precision"] == pytest.approx(35 / 45, abs=1e-6)
    assert report["HIGH Defect"]["recall"] == pytest.approx(35 / 40)
    assert report["HIGH Defect"]["f1"] == pytest.approx(2 * 35 / (2 * 35 + 10 + 5), abs=1e-6)
    assert report["accuracy"]["f1"] == 0.85 and report["weighted avg"]["support"] == 100
    assert report["macro avg"]["recall"] == pytest.approx((50 / 60 + 35 / 40) / 2, abs=1e-6)


def test_absent_class_counts_zero(spark):
    df = spark.createDataFrame([(0, 0)] * 3, f"{model.LABEL} int, {model.PREDICTION} int")
    cells = {(r["actual"], r["predicted"]): (r["n"], r["row_pct"]) for r in rows(model.confusion_matrix(df))}
    assert cells == {(0, 0): (3, 100.0), (0, 1): (0, 0.0), (1, 0): (0, None), (1, 1): (0, None)}
    assert by(model.classification_report(df), "class")["HIGH Defect"]["f1"] == 0.0


def test_cross_validation(labelled):
    scores = rows(model.cross_validation(labelled, ["prod_id"], folds=3, trees=5).orderBy("fold"))
    assert [s["fold"] for s in scores] == [1, 2, 3]
    assert sum(s["n"] for s in scores) == labelled.count()
    mean = sum(s["accuracy"] for s in scores) / 3
    assert scores[0]["mean_pct"] == pytest.approx(mean * 100, abs=0.01) and mean > 0.8


def test_sample_keeps_the_order(labelled):
    scored = labelled.withColumn(model.PREDICTION, F.lit(0))
    sample = rows(model.prediction_sample(scored, ["prod_id"]))
    assert [s["sample"] for s in sample] == list(range(60))
    assert all(s["correct"] == (s["actual"] == 0) for s in sample)


def test_runs_without_a_rate_are_labelled_zero_and_divided(spark):
    run = spark.createDataFrame([(i, None if i % 10 == 0 else float(i)) for i in range(400)], "prod_id int, defect_rate double")
    labelled = model.with_label(run)
    assert labelled.where("high_defect is null").count() == 0
    assert labelled.where("defect_rate is null and high_defect = 0").count() == 40
    assert model.split(labelled, ["prod_id"]).count() == 400
    folds = by(model.with_fold(labelled, ["prod_id"]).groupBy("fold").count(), "fold")
    assert set(folds) == {0, 1, 2, 3, 4} and sum(f["count"] for f in folds.values()) == 400
    unlabelled = labelled.withColumn("high_defect", F.when(F.col("prod_id") > 20, F.col("high_defect")))
    assert model.split(unlabelled, ["prod_id"]).count() == 400
    with pytest.raises(Exception, match="no threshold"):
        model.with_label(run.where("defect_rate is null")).collect()


def test_a_forest_gets_like_rows_together(labelled):
    train = model.training_set(labelled)
    own = [c for c in train.columns if c != model.LABEL]
    for part in train.rdd.glom().collect():
        keys = [tuple(r[c] for c in own) for r in part]
        assert keys == sorted(keys)
    assert train.count() == labelled.count()


def test_a_forest_grows_in_few_large_tasks(spark, labelled, monkeypatch):
    """Every task of a level sends the counts of all nodes, so a forest's tasks are larger than those that only score."""
    least = 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(model, "VISITS", 1500)  # 1,500 rows would be dealt to 100 tasks
    assert model.training_set(labelled).rdd.getNumPartitions() == least
    monkeypatch.setattr(model, "GROWING_VISITS", 1500)
    assert model.training_set(labelled).rdd.getNumPartitions() == 100


def test_kept_nodes_grow_the_same_trees(labelled, monkeypatch):
    train = model.training_set(labelled)
    kept = model.fit(train, trees=5)
    assert kept.stages[-1].getCacheNodeIds()
    monkeypatch.setattr(model, "KEPT_ROWS", 10)
    looked_up = model.fit(train, trees=5)
    assert not looked_up.stages[-1].getCacheNodeIds()
    assert kept.stages[-1].toDebugString.split("\n")[1:] == looked_up.stages[-1].toDebugString.split("\n")[1:]


def test_a_bucket_made_before_divides_the_same(labelled):
    bucketed = model.with_bucket(labelled, ["prod_id"])
    for divide, out in ((model.split, "is_test"), (model.with_fold, "fold")):
        want = by(divide(labelled, ["prod_id"]), "prod_id")
        found = by(divide(bucketed, None), "prod_id")
        assert {k: r[out] for k, r in found.items()} == {k: r[out] for k, r in want.items()}


def test_runs_of_the_model_are_joined_once(spark):
    folder = "/root/testdata/sf0.001"
    own = spark._jvm.PythonSQLUtils
    for df in (shared.labelled_runs(spark, folder), shared.split_runs(spark, folder)):
        assert "l_shipdate" not in own.explainString(df._jdf.queryExecution(), "formatted")
    want = star.enriched_production(shared.factory(spark, folder)).select(*shared.RUN_COLUMNS)
    assert sorted(map(str, rows(shared.model_runs(spark, folder).drop(model.BUCKET)))) == sorted(map(str, rows(want)))


def test_the_split_writes_no_second_copy(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "_settled", {})
    parts = shared.split_runs(spark, folder)
    assert parts.inputFiles() == shared.model_runs(spark, folder).inputFiles()
    # The threshold and the cuts are kept: reading the parts counts nothing again.
    assert "Aggregate" not in spark._jvm.PythonSQLUtils.explainString(parts._jdf.queryExecution(), "formatted")


def test_scored_rows_lie_alike_in_full_rounds(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "_settled", {})
    forest = model.fit(model.training_set(shared.split_runs(spark, folder).where("not is_test")), trees=3)
    monkeypatch.setattr(shared, "trained_model", lambda *_: forest)
    scored = shared.scored_test_runs(spark, folder)
    assert scored.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    for part in scored.rdd.glom().collect():
        keys = [(r.temperature, r.pressure, r.downtime_hrs) for r in part]
        assert keys == sorted(keys)
    want = model.model_input(shared.split_runs(spark, folder).where("is_test"))  # scored inputs are doubles
    key = [*shared.RUN_KEY, model.LABEL]
    assert sorted(map(str, rows(scored.select(*key)))) == sorted(map(str, rows(want.select(*key))))


def test_a_forest_is_dealt_out_in_full_rounds(spark):
    cores = spark.sparkContext.defaultParallelism
    visits = (2 * cores + 1) * model.VISITS // model.TREES
    assert model.spread(spark.range(1000), visits, always=True).rdd.getNumPartitions() == 3 * cores


@pytest.fixture
def small_forest(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "_settled", {})
    forest = model.fit(model.training_set(shared.split_runs(spark, folder).where("not is_test")), trees=3)
    monkeypatch.setattr(shared, "trained_model", lambda *_: forest)
    return folder


def test_a_sample_scores_only_its_rows(spark, small_forest, monkeypatch):
    want = rows(model.prediction_sample(shared.scored_test_runs(spark, small_forest), shared.RUN_KEY))
    scored, score = [], model.score
    monkeypatch.setattr(model, "score", lambda forest, df: scored.append(df.count()) or score(forest, df))
    for name in ("prediction_sample", "sample_checks"):
        got = rows(queries.queries()[name](spark, small_forest))
        assert [r["sample"] for r in got] == list(range(60)) and all(r.get("consistent", True) for r in got)
        assert name != "prediction_sample" or got == want
    assert scored == [60, 60]


def test_scores_are_checked_where_they_lie(spark, small_forest, monkeypatch):
    dealt, deal = [], shared.test_runs
    monkeypatch.setattr(shared, "test_runs", lambda *of: dealt.append(of) or deal(*of))
    checks = queries.queries()["model_checks"]
    scored = shared.scored_test_runs(spark, small_forest)
    found = rows(checks(spark, small_forest))[0]
    assert len(dealt) == 1 and (found["scored"], found["changed_scores"]) == (scored.count(), 0)
    # A score that is not what the loaded forest gives is found.
    wrong = F.col("units_made") == 20
    monkeypatch.setattr(shared, "scored_test_runs", lambda *_: scored.withColumn(model.PROBABILITY, F.col(model.PROBABILITY) + F.when(wrong, 1e-6).otherwise(0)))
    assert rows(checks(spark, small_forest))[0]["changed_scores"] == scored.where(wrong).count() > 0


def test_insights_add_up_the_runs_that_the_forest_joined(spark, small_forest, monkeypatch):
    t = shared.factory(spark, small_forest)
    want = rows(report.insights(t, queries._importance(spark, small_forest)))
    monkeypatch.setattr(cells, "runs", lambda *_: pytest.fail("the runs are joined a second time"))
    got = rows(queries.queries()["model_insights"](spark, small_forest))
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 6
