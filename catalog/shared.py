"""The tables of a folder, and one trained model per folder and session."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from millwright.operators import model
from millwright.operators.star import enriched_production
from millwright.session import own_folder, settle, settle_columns
from millwright.sources import layout
from millwright.sources.tables import FactoryTables
from millwright.sources.trade_tables import read_trade_tables

# The test tables carry no run number, so a run is known by all its columns.
RUN_KEY = [
    "prod_date", "machine_id", "emp_id", "product_id", "shift", "units_made", "units_defective",
    "downtime_hrs", "temperature", "pressure", "humidity", "vibration_level",
]


_read: dict[tuple[str, str], FactoryTables] = {}


def factory(spark: SparkSession, folder: str) -> FactoryTables:
    """The tables of a folder, listed and sized once per session; no data is kept."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _read:
        _read[key] = read_trade_tables(spark, folder)
    return _read[key]


# What the model, its label and its split read of a run, and the price that insights beside it need.
RUN_COLUMNS = [*RUN_KEY, "age_years", "experience_yrs", "department", "defect_rate", "price_per_unit"]


def model_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs' columns that the model needs, with their bucket; joined once per session and folder."""

    def joined() -> DataFrame:
        runs = enriched_production(factory(spark, folder)).select(*RUN_COLUMNS)
        return settle_columns(model.with_bucket(runs, RUN_KEY))

    return _once(spark, folder, "runs", joined)


def labelled_runs(spark: SparkSession, folder: str) -> DataFrame:
    def threshold() -> DataFrame:
        return settle(model.defect_threshold(model_runs(spark, folder)))

    return model.with_label(model_runs(spark, folder), _once(spark, folder, "threshold", threshold))


def split_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled runs with their part, for training and test.

    The joined runs are kept, and so are the threshold and the cuts; what they make of a run is cheaper found again than
    all runs are written a second time.
    """
    return _once(spark, folder, "parts", lambda: model.split(labelled_runs(spark, folder), None))


_settled: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, what: str, make: Callable):
    """A settled table, or the path of a written one, of this session."""
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _settled:
        _settled[key] = make()
    return _settled[key]


def short_name(folder: str) -> str:
    """A name for a folder of tables that is good in paths."""
    return hashlib.sha1(folder.encode()).hexdigest()[:12]


_loaded: dict[str, PipelineModel] = {}


def model_path(spark: SparkSession, folder: str) -> str:
    """Where this session saves its model."""
    return f"{own_folder(spark, 'models')}/{short_name(folder)}"


def trained_model(spark: SparkSession, folder: str) -> PipelineModel:
    """The model of this session, trained, saved and loaded back the first time."""
    path = model_path(spark, folder)
    if path not in _loaded:
        if model.load(spark, path) is None:
            model.save(model.train(split_runs(spark, folder).where("not is_test")), path)
        _loaded[path] = model.load(spark, path)
    return _loaded[path]


def test_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The test rows as a forest scores them best; a fifth of all, so they are worth a shuffle to fill all cores."""
    forest = trained_model(spark, folder)
    return model.scoring_set(split_runs(spark, folder).where("is_test"), always=True, model=forest)


def scored_test_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Test runs with their inputs and predictions, settled once per session and folder for all that is read from them."""

    def scored() -> DataFrame:
        runs = model.score(trained_model(spark, folder), test_runs(spark, folder))
        inputs = [c for c in model.INPUTS if c not in RUN_KEY]
        runs = runs.select(*RUN_KEY, *inputs, model.LABEL, model.PREDICTION, model.PROBABILITY)
        # Rows that were dealt out stay so, as they are scored again; where that does not matter, columns take less disk.
        return settle_columns(runs) if model.scored_anywhere(trained_model(spark, folder)) else settle(runs)

    return _once(spark, folder, "scored", scored)


def scored_sample(spark: SparkSession, folder: str, n: int = 60) -> DataFrame:
    """The first ``n`` test runs by their key with their predictions. A run is scored by itself, so only these need be."""
    forest = trained_model(spark, folder)
    return model.score(forest, split_runs(spark, folder).where("is_test").orderBy(*RUN_KEY).limit(n))


def cross_validated(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the folds, trained once per session and folder."""
    return _once(spark, folder, "folds", lambda: settle(model.cross_validation(labelled_runs(spark, folder), None)))


def runs_by_month(spark: SparkSession, folder: str) -> str:
    """Where this session laid out the runs of a folder by month, written the first time."""

    def write() -> str:
        path = f"{own_folder(spark, 'results')}/months-{short_name(folder)}"
        layout.write_by_month(factory(spark, folder).production, path)
        return path

    return _once(spark, folder, "months", write)
