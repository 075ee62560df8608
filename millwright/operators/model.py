"""The defect-risk model: label, split, forest, scores and reports.

Labels and folds are decided by expressions over single rows (a threshold, a hash bucket), so no class
of runs, however large, is ever sorted in one task.
"""

from __future__ import annotations

import importlib.util
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions import bands, metrics, text
from millwright.operators import forest
from millwright.operators.ordering import running_total
from millwright.operators.quantiles import quantiles
from millwright.session import own_folder, settle, settle_columns

LABEL, PREDICTION, PROBABILITY = "high_defect", "ml_prediction", "ml_probability"

# The model's inputs in order, and the forest's settings.
FEATURES = [
    "temperature", "pressure", "downtime_hrs", "age_years", "vibration_level",
    "humidity", "experience_yrs", "units_made", "shift_num", "dept_num",
]
TREES, DEPTH, MIN_LEAF, SEED = 100, 10, 2, 42

INDEXED = {"shift": "shift_num", "department": "dept_num"}
#: The columns that the inputs are made of.
INPUTS = [*(c for c in FEATURES if c not in INDEXED.values()), *INDEXED]
BUCKETS = 65_536
BUCKET = "hash_bucket"


# --- label and encoding ---------------------------------------------------------------------------


def defect_threshold(df: DataFrame, rate: str = "defect_rate", p: float = 0.75, digits: int = 2) -> DataFrame:
    """One row: the quantile of the rate, rounded before it is compared."""
    return quantiles(df, rate, {"threshold": p}).select(F.round("threshold", digits).alias("threshold"))


def with_label(df: DataFrame, threshold: DataFrame | None = None, rate: str = "defect_rate") -> DataFrame:
    """high_defect: 1 where the rate is above the threshold, else 0, also for a run without a rate.

    Where no run has a rate there is no threshold, and evaluating the label raises an error.
    """
    limit = (threshold if threshold is not None else defect_threshold(df, rate)).scalar()
    high = F.coalesce(F.col(rate) > limit, F.lit(False)).cast("int")
    none = F.raise_error(F.lit("no run has a rate, so there is no threshold")).cast("int")
    return df.withColumn(LABEL, F.when(limit.isNull(), none).otherwise(high))


def label_balance(labelled: DataFrame) -> DataFrame:
    counts = labelled.groupBy(LABEL).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())  # two rows
    return counts.withColumn("share_pct", metrics.rounded_ratio("n", whole, 1))


def encode_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, category, code): codes 0, 1, ... in alphabetical order within each column."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "category"
    )
    distinct = long.where(F.col("category").isNotNull()).distinct().withColumn("_one", F.lit(1))
    placed = settle(running_total(distinct, ["column", "category"], "_one", "_place"))
    first = placed.groupBy("column").agg(F.min("_place").alias("_first"))  # one row per column
    return placed.join(F.broadcast(first), "column").select(
        "column", "category", (F.col("_place") - F.col("_first")).cast("int").alias("code")
    )


# --- split and folds ------------------------------------------------------------------------------


def _bucket(keys: list[str], seed: int) -> Column:
    """One of BUCKETS (65,536) buckets: the first four digits of the MD5 of the seed and the keys as text.

    Any engine can compute it, so a split made here can be checked elsewhere.
    """
    named = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.left(F.md5(named), F.lit(4)), 16, 10).cast("int")


def with_bucket(df: DataFrame, keys: list[str], seed: int = SEED) -> DataFrame:
    """Adds the hash bucket that splits and folds go by, for a table that is divided more than once."""
    return df.withColumn(BUCKET, _bucket(keys, seed))


def with_part(
    labelled: DataFrame, keys: list[str] | None, fractions: list[float], out: str, seed: int = SEED
) -> DataFrame:
    """Cuts each class at the given cumulative fractions of its rows, in the order of a seeded hash.

    Adds the number of cuts below the row: 0 for the first part, 1 for the second... Rows fall into
    65,536 hash buckets; a cut runs along the edge of a bucket, so each class is divided as asked to
    within one bucket's rows, and rows with equal keys stay together. Rows without a label are a class of
    their own, divided like the others. Without ``keys`` the rows have their bucket, from ``with_bucket``.
    """
    bucket = F.col(BUCKET) if keys is None else _bucket(keys, seed)
    placed = labelled.withColumns({"_bucket": bucket, "_class": F.coalesce(F.col(LABEL), F.lit(-1))})
    counts = placed.groupBy("_class", "_bucket").agg(F.count("*").alias("n"))  # at most 3 * BUCKETS rows
    of_class = Window.partitionBy("_class")
    so_far = of_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("n").over(so_far), "_all": F.sum("n").over(of_class)})
    last_of = [
        F.coalesce(F.max(F.when(F.col("_upto") <= F.floor(F.col("_all") * f + 1e-9), F.col("_bucket"))), F.lit(-1))
        for f in fractions
    ]
    by_class = ranked.groupBy("_class").agg(F.array(*last_of).alias("cuts"))
    # One row, settled: whoever reads the parts again would count all rows again.
    cuts = settle(by_class.agg(F.map_from_entries(F.collect_list(F.struct("_class", "cuts"))).alias("cuts"))).scalar()
    mine = F.element_at(cuts, F.col("_class"))
    part = sum(((F.col("_bucket") > mine[i]).cast("int") for i in range(1, len(fractions))),
               (F.col("_bucket") > mine[0]).cast("int"))
    return placed.withColumn(out, part).drop("_bucket", "_class")


def split(labelled: DataFrame, keys: list[str] | None, test: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds is_test: a seeded, stratified share of the rows."""
    parts = with_part(labelled, keys, [1 - test], "is_test", seed)
    return parts.withColumn("is_test", F.col("is_test") == 1)


def with_fold(labelled: DataFrame, keys: list[str] | None, folds: int = 5, seed: int = SEED) -> DataFrame:
    return with_part(labelled, keys, [i / folds for i in range(1, folds)], "fold", seed)


# --- forest ---------------------------------------------------------------------------------------


def pipeline(seed: int = SEED, trees: int = TREES, handle_invalid: str = "error", keep_nodes: bool = False) -> Pipeline:
    """Indexers, assembler and forest in one, so that they are saved and loaded together.

    ``keep_nodes`` keeps the node of each row in each tree from level to level, so it is not looked for from the root
    again. The trees are the same; it takes some 900 bytes a row beside the 500 that the forest caches anyway.

    ``handle_invalid`` says what a NULL sensor or a category never seen does: error, skip or keep.
    """
    indexers = [
        StringIndexer(
            inputCol=column, outputCol=index, stringOrderType="alphabetAsc", handleInvalid=handle_invalid
        )
        for column, index in INDEXED.items()
    ]
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid=handle_invalid)
    forest = RandomForestClassifier(
        labelCol=LABEL,
        featuresCol="features",
        predictionCol="prediction",
        numTrees=trees,
        maxDepth=DEPTH,
        minInstancesPerNode=MIN_LEAF,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        seed=seed,
        maxMemoryInMB=1024,
        cacheNodeIds=keep_nodes,
        checkpointInterval=-1,  # ten levels are a short lineage
    )
    return Pipeline(stages=[*indexers, assembler, forest])


def model_input(df: DataFrame) -> DataFrame:
    """Sensor decimals as doubles, which the assembler needs."""
    numeric = [c for c in FEATURES if c not in INDEXED.values()]
    return df.withColumns({c: F.col(c).cast("double") for c in numeric})


#: Rows times trees that one task should visit: some ten seconds of work.
VISITS = 25_000_000
#: The same for each level of a forest that grows. Every task sends the counts of all nodes, so fewer tasks send less.
GROWING_VISITS = 100_000_000


def spread(df: DataFrame, rows: int, trees: int = TREES, always: bool = False, visits: int | None = None) -> DataFrame:
    """Deals ``rows`` out by the work that a forest makes of them, not by their bytes, to at least two tasks a core.

    Parts cut by size hold some 500,000 runs, which is about a task's work. So a table that fills all cores with such parts
    is left as it is, unless ``always``; only a smaller one, which would keep few cores busy, is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    least = 2 * cores
    # Whole rounds of the cores: in a last round of few tasks most cores would wait.
    parts = max(least, -(-rows * trees // ((visits or VISITS) * cores)) * cores)
    return df.repartition(parts) if always or parts == least else df


def training_set(labelled: DataFrame, *others: str) -> DataFrame:
    """The inputs and the label, computed once and dealt out by the work a forest makes of them: it passes over them
    many times.

    Each task has its rows sorted. Rows alike take the same way down a tree, one after the other, so the counts of its
    nodes are at hand; in any other order most visits would wait for memory. So the trees hang on no order of arrival.
    """
    numeric = [c for c in FEATURES if c not in INDEXED.values()]
    rows = model_input(labelled).select(*numeric, *INDEXED, LABEL, *others)
    dealt = spread(rows, labelled.count(), always=True, visits=GROWING_VISITS)
    return settle(dealt.sortWithinPartitions(*numeric, *INDEXED, LABEL, *others))


def scoring_set(runs: DataFrame, always: bool = False, model: PipelineModel | None = None) -> DataFrame:
    """The rows that a forest is to score, dealt out by its work and sorted by its inputs in each task, as it grew on them.

    Rows alike take the same way down a hundred trees, so these are at hand; in any other order most steps wait for memory.
    Where ``model`` is scored from arrays, which are at hand in any order, the many rows stay where they lie.
    """
    if model is not None and scored_anywhere(model):
        return runs
    numeric = [c for c in FEATURES if c not in INDEXED.values()]
    return spread(runs, runs.count(), always=always).sortWithinPartitions(*numeric, *INDEXED)


#: Up to so many rows (some 7 GB) a forest keeps their nodes; beyond, it would read them from disk, and gain nothing.
KEPT_ROWS = 5_000_000


def fit(train: DataFrame, **settings) -> PipelineModel:
    """Trains on rows from ``training_set``."""
    if "keep_nodes" not in settings:
        settings["keep_nodes"] = train.count() <= KEPT_ROWS
    return pipeline(**settings).fit(train)


#: Beyond so many training rows a forest is grown and scored by ``operators.forest``.
MANY_ROWS = 1_000_000


def many(rows: int) -> bool:
    """Whether a forest on so many rows is grown from blocks of bins; without pyarrow Spark grows them all."""
    return rows > MANY_ROWS and importlib.util.find_spec("pyarrow") is not None


def grow(labelled: DataFrame, n: int, seed: int = SEED, trees: int = TREES) -> PipelineModel:
    """The pipeline of ``pipeline``, with a forest grown by ``operators.forest`` on ``n`` labelled runs.

    They are read four times: for the categories of each of two columns, for the cuts and for the bins. Nothing of a run but its bins is written.
    """
    spark = labelled.sparkSession
    *indexers, assembler, settings = pipeline(seed, trees).getStages()
    numeric = [c for c in FEATURES if c not in INDEXED.values()]
    rows = model_input(labelled).select(*numeric, *INDEXED, LABEL)
    indexed = Pipeline(stages=indexers).fit(rows)
    sizes = {FEATURES.index(m.getOutputCol()): len(m.labels) for m in indexed.stages}
    nodes = forest.grow(indexed.transform(rows).select(*FEATURES, LABEL), n, sizes, trees, DEPTH, MIN_LEAF, seed)
    path = f"{own_folder(spark, 'models')}/grown-{uuid.uuid4().hex}"
    grown = forest.as_model(spark, nodes, len(FEATURES), settings, path)
    return _with_arrays(spark, PipelineModel([*indexed.stages, assembler, grown]), f"{path}/data")


def train(labelled: DataFrame, **settings) -> PipelineModel:
    """Trains on labelled runs, however many they are."""
    rows = labelled.count()
    return grow(labelled, rows, **settings) if many(rows) else fit(training_set(labelled), **settings)


def _with_arrays(spark: SparkSession, model: PipelineModel, nodes: str) -> PipelineModel:
    """The model with its trees as arrays, sent to every worker once."""
    found = forest.tables(spark.read.parquet(nodes).toDF("treeID", "nodeData"), len(FEATURES))
    model.arrays = found and spark.sparkContext.broadcast(found)
    return model


def scored_anywhere(model: PipelineModel) -> bool:
    """Whether its trees are arrays, so that rows need neither be sorted nor dealt out to be scored."""
    return getattr(model, "arrays", None) is not None


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved pipeline, or None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    model = PipelineModel.load(path)
    root = saved_nodes(spark, path).where("tree = 0 and node = 0").first()
    return _with_arrays(spark, model, f"{path}/stages/*RandomForest*/data") if many(root.n) else model


def score(model: PipelineModel | None, df: DataFrame, on_missing: str = "error") -> DataFrame:
    """Adds ml_prediction and ml_probability (of a high defect rate).

    Without a model: an error, or zeros with ``on_missing='zero'``.
    """
    if model is None:
        if on_missing != "zero":
            raise ValueError("no trained model")
        return df.withColumns({PREDICTION: F.lit(0), PROBABILITY: F.lit(0.0)})
    kept = df.columns
    if scored_anywhere(model):
        inputs = PipelineModel(model.stages[:-1]).transform(model_input(df))
        both = inputs.withColumn("_scored", forest.scored(model.arrays, F.col("features")))
        return both.select(*kept, F.col("_scored.prediction").alias(PREDICTION), F.col("_scored.probability").alias(PROBABILITY))
    scored = model.transform(model_input(df))
    return scored.select(
        *kept,
        F.col("prediction").cast("int").alias(PREDICTION),
        vector_to_array("probability")[1].alias(PROBABILITY),
    )


def risk(model: PipelineModel, scenarios: DataFrame) -> DataFrame:
    """Planned runs with both probabilities in percent and the risk in words."""
    scored = score(model, scenarios)
    high = F.col(PROBABILITY)
    return scored.withColumns(
        {
            "low_pct": F.round((1 - high) * 100, 1),
            "high_pct": F.round(high * 100, 1),
            "risk": F.when(F.col(PREDICTION) == 1, "HIGH DEFECT RISK").otherwise("LOW DEFECT RISK"),
        }
    )


def feature_importance(spark: SparkSession, model: PipelineModel, full_bar: float = 30.0) -> DataFrame:
    """The inputs by weight: rank, percent, a bar of # signs and the percent of a full bar."""
    weights = [float(w) for w in model.stages[-1].featureImportances.toArray()]
    table = spark.createDataFrame(list(zip(FEATURES, weights)), "feature string, importance double")
    pct = F.round(F.col("importance") * 100, 1)
    order = Window.orderBy(F.desc("importance"), "feature")  # ten rows
    peak = F.max("importance").over(Window.partitionBy())
    return table.select(
        F.row_number().over(order).alias("rank"),
        "feature",
        "importance",
        pct.alias("importance_pct"),
        text.hash_bar("importance", 50).alias("bar"),
        bands.percent_of(pct, full_bar).alias("bar_pct"),
        (F.col("importance") == peak).alias("is_top"),
    )


def saved_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a saved forest: (tree, node, feature, gain, n); a leaf has no feature. ``n`` is its weight of rows."""
    nodes = spark.read.parquet(f"{path}/stages/*RandomForest*/data")
    node = "nodeData" if "nodeData" in nodes.columns else "_2"
    tree = "treeID" if node == "nodeData" else "_1"
    inner = F.col(f"{node}.leftChild") >= 0
    n = F.aggregate(F.col(f"{node}.impurityStats"), F.lit(0.0), lambda a, x: a + x)
    return nodes.select(
        F.col(tree).alias("tree"), F.col(f"{node}.id").alias("node"), F.when(inner, F.col(f"{node}.split.featureIndex")).alias("feature"),
        F.when(inner, F.col(f"{node}.gain")).alias("gain"), n.alias("n"),
    )


def importances_from_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(feature, importance) of a saved forest, from its nodes: what each input gains, weighted by rows.

    A tree's gains are made to add up to 1 before the trees are added up; a tree without a split counts for none. The
    work is adding up a table, however many trees there are.
    """
    nodes = saved_nodes(spark, path).where("feature is not null")
    of_tree = nodes.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
    share = F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy("tree")))  # ten rows a tree
    total = of_tree.select("feature", share.alias("share")).groupBy("feature").agg(F.sum("share").alias("share"))
    whole = F.sum("share").over(Window.partitionBy())  # ten rows
    found = total.select("feature", F.try_divide("share", whole).alias("importance"))
    inputs = spark.createDataFrame(list(enumerate(FEATURES)), "feature int, name string")
    return inputs.join(F.broadcast(found), "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance")
    )


# --- evaluation -----------------------------------------------------------------------------------


def confusion_matrix(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """All four cells with their share of the actual class's rows."""
    classes = F.array(F.lit(0), F.lit(1))
    counts = scored.groupBy(
        F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count("*").alias("n"))
    # Cells that did not occur count 0; four rows from here on.
    cells = counts.agg(F.collect_list(F.struct("actual", "predicted", "n")).alias("seen")).select(
        "seen", F.explode(classes).alias("actual")
    ).select("seen", "actual", F.explode(classes).alias("predicted"))
    mine = F.filter("seen", lambda c: (c.actual == F.col("actual")) & (c.predicted == F.col("predicted")))
    filled = cells.select("actual", "predicted", F.coalesce(F.get(mine, F.lit(0)).getField("n"), F.lit(0)).alias("n"))
    of_actual = F.sum("n").over(Window.partitionBy("actual"))
    return filled.withColumn("row_pct", metrics.rounded_ratio("n", of_actual, 1))


def _outcomes(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    actual, predicted = F.col(label), F.col(prediction)

    def cell(a: int, p: int) -> Column:
        return F.count_if((actual == a) & (predicted == p)).cast("double")

    return scored.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def accuracy(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """One row: rows, correct, wrong, false alarms, misses and the percent correct."""
    right = F.col("tn") + F.col("tp")
    n = right + F.col("fp") + F.col("fn")
    return _outcomes(scored, label, prediction).select(
        n.cast("bigint").alias("n"),
        right.cast("bigint").alias("correct"),
        (F.col("fp") + F.col("fn")).cast("bigint").alias("wrong"),
        F.col("fp").cast("bigint").alias("false_alarms"),
        F.col("fn").cast("bigint").alias("missed"),
        metrics.rounded_ratio(right, n).alias("accuracy_pct"),
    )


def classification_report(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """precision, recall, f1 and support per class, their plain and weighted means, and the accuracy."""

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    one_row = _outcomes(scored, label, prediction).select(
        safe(tn, tn + fn).alias("p0"), safe(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"),
        safe(tp, tp + fp).alias("p1"), safe(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"),
        safe(tn + tp, tn + fp + fn + tp).alias("acc"),
    )
    one_row = one_row.withColumns(
        {f"f{c}": safe(2 * F.col(f"p{c}") * F.col(f"r{c}"), F.col(f"p{c}") + F.col(f"r{c}")) for c in (0, 1)}
    )
    n = F.col("s0") + F.col("s1")

    def line(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
            F.round(f, 6).alias("f1"), s.cast("bigint").alias("support"),
        )

    def mean(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return safe(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), n)

    acc = F.col("acc")
    lines = F.array(
        line("LOW Defect", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("HIGH Defect", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", acc, acc, acc, n),
        line("macro avg", mean("p"), mean("r"), mean("f"), n),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), n),
    )
    return one_row.select(F.inline(lines))


#: Up to so many rows all folds are trained at once.
FEW_ROWS = 1_000_000


def cross_validation(
    labelled: DataFrame, keys: list[str] | None, folds: int = 5, at_once: int | None = None, **settings
) -> DataFrame:
    """Accuracy of each fold, with their mean and standard deviation.

    The folds are trained at once (``at_once`` of them) over one settled table: all where rows are few, and two where a
    fold fills the cores by itself, as each keeps its rows' nodes. Their jobs go to scheduler pools of their
    own, which share the cores evenly where the session's ``spark.scheduler.mode`` is FAIR.
    """
    divided = with_fold(labelled, keys, folds)
    rows = divided.count()
    numeric = [c for c in FEATURES if c not in INDEXED.values()]
    if many(rows):  # each fold packs its rows, which are few bytes kept by column
        data = settle_columns(model_input(divided).select(*numeric, *INDEXED, LABEL, "fold"))
    else:
        data = training_set(divided, "fold")
    if at_once is None:
        at_once = folds if rows <= FEW_ROWS else 2
    context = data.sparkSession.sparkContext

    def score_fold(k: int) -> DataFrame:
        context.setLocalProperty("spark.scheduler.pool", f"fold {k}")
        others = data.where(F.col("fold") != k)
        model = grow(others, others.count(), **settings) if many(rows) else fit(others, **settings)
        result = accuracy(score(model, data.where(F.col("fold") == k)))
        share = F.try_divide(F.col("correct"), F.col("n"))
        return settle(result.select(F.lit(k + 1).alias("fold"), "n", share.alias("accuracy")))

    with ThreadPoolExecutor(at_once) as pool:
        scores = [f.result() for f in [pool.submit(inheritable_thread_target(data.sparkSession)(score_fold), k) for k in range(folds)]]
    scores = reduce(DataFrame.unionByName, scores)
    every = Window.partitionBy()  # one row per fold
    return scores.select(
        "fold",
        "n",
        F.round("accuracy", 6).alias("accuracy"),
        F.round(F.avg("accuracy").over(every) * 100, 2).alias("mean_pct"),
        F.round(F.stddev_pop("accuracy").over(every) * 100, 2).alias("std_pct"),
    )


def prediction_sample(scored: DataFrame, order_by: list[str], n: int = 60) -> DataFrame:
    """The first n rows in the order given: actual, predicted and whether they agree."""
    first = scored.orderBy(*order_by).limit(n)
    place = F.row_number().over(Window.orderBy(*order_by)) - 1  # over n rows
    return first.select(
        place.alias("sample"),
        F.col(LABEL).alias("actual"),
        F.col(PREDICTION).alias("predicted"),
        (F.col(LABEL) == F.col(PREDICTION)).alias("correct"),
    )
