"""Every registered query: (spark, folder of the test tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import shared
from millwright.functions import metrics, text
from millwright.functions.bands import percent_of
from millwright.operators import model, ordering, quality, quantiles, ranking, star, stats
from millwright.plans import charts, report, summaries
from millwright.plans.cells import single_keys
from millwright.session import own_folder
from millwright.sources import batches, csv_files, layout
from millwright.sources.tables import FactoryTables

SHIFTS = ["Morning", "Evening", "Night"]
FACTORS = [
    "temperature", "pressure", "downtime_hrs", "age_years", "vibration_level", "humidity", "experience_yrs",
]
MATRIX = ["defect_rate", *FACTORS, "units_made", "efficiency"]
DESCRIBED = ["units_made", "units_defective", "defect_rate", "downtime_hrs", "temperature", "vibration_level"]

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, the same in every engine the results are compared with."""
    return df.select(
        *[
            F.col(f.name).cast("double" if isinstance(f.dataType, T.DecimalType) else "string").alias(f.name)
            if isinstance(f.dataType, (T.DecimalType, T.DateType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _on_tables(plan: Callable[[FactoryTables], DataFrame]) -> Query:
    return lambda spark, folder: plain(plan(shared.factory(spark, folder)))


def _on_runs(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_tables(lambda t: plan(star.enriched_production(t)))


def _derived_metrics(t: FactoryTables) -> DataFrame:
    run = star.with_measures(star.runs(t, "products"))
    return run.select(
        "prod_date", "machine_id", "emp_id", "product_id", "shift", "units_made", "units_defective",
        "defect_rate", "efficiency", "good_units", "revenue_lost", "month", "week",
    )


def _rounded_metrics(t: FactoryTables) -> DataFrame:
    run = star.with_measures(star.runs(t, "products"), digits=2)
    return run.select(
        "prod_date", "machine_id", "emp_id", "product_id", "defect_rate", "efficiency", "revenue_lost"
    )


def _date_labels(t: FactoryTables) -> DataFrame:
    return t.production.groupBy("prod_date").agg(F.count("*").alias("runs")).select(
        "prod_date",
        text.month_label("prod_date").alias("month_label"),
        text.short_month("prod_date").alias("short_month"),
        text.day_label("prod_date").alias("day_label"),
        metrics.iso_week("prod_date").alias("week"),
        "runs",
    )


def _label_text(t: FactoryTables) -> DataFrame:
    return summaries.product_analysis(t).select(
        "product_id",
        text.shortened("product_name", 12).alias("short_name"),
        text.thousands("total_units").alias("units_text"),
        text.with_suffix("defect_rate", "%").alias("rate_text"),
        text.hash_bar(F.col("defect_rate") / 100, 50).alias("bar"),
    )


def _slice(t: FactoryTables) -> DataFrame:
    run = star.sliced(
        star.runs(t, "machines"), shift="Night", date_from="1995-01-01", date_to="1996-12-31"
    )
    return run.select("prod_date", "machine_name", "shift", "units_made", "units_defective")


def _rule(df: DataFrame) -> DataFrame:
    """A run counts as predicted high when it is hot; stands in for a model where SQL must agree."""
    return df.withColumn(model.PREDICTION, (F.col("temperature") > 85).cast("int"))


def _labelled(df: DataFrame) -> DataFrame:
    labelled = model.with_label(df)
    return labelled.select(
        "prod_date", "machine_id", "emp_id", "product_id", "defect_rate", model.LABEL
    )


def _surrogate_key(t: FactoryTables) -> DataFrame:
    return ordering.surrogate_keys(t.sales, "sale_id")


def _ingest_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The maintenance table out to CSV under untidy headers, and back in."""
    visits = shared.factory(spark, folder).maintenance
    path = f"{own_folder(spark, 'ingest')}/{shared.short_name(folder)}"
    untidy = [f" {c.replace('_', ' ').title()} " for c in visits.columns]
    visits.toDF(*untidy).write.mode("overwrite").option("header", True).csv(path)
    schema = visits.schema
    good, bad = csv_files.read_csv(spark, path, schema, required=visits.columns)
    rejected = bad.agg(F.count("*")).scalar()
    return plain(good.withColumn("rejected_rows", rejected))


def _csv_result(spark: SparkSession, folder: str) -> DataFrame:
    """A summary written as CSV and read back."""
    table = plain(summaries.monthly_trend(shared.factory(spark, folder)))
    path = f"{own_folder(spark, 'results')}/{shared.short_name(folder)}"
    csv_files.write_summary(table, path, one_file=True)  # a row a month
    return spark.read.schema(table.schema).option("header", True).csv(path)


def _scenarios(t: FactoryTables) -> DataFrame:
    """Three planned runs per department, at its worst, best and middling conditions."""
    run = model.model_input(star.enriched_production(t))
    worse_high = ["temperature", "pressure", "downtime_hrs", "age_years", "vibration_level", "humidity"]
    worse_low = ["experience_yrs", "units_made"]
    cases = []
    for name, shift in (("bad", "Night"), ("normal", "Morning"), ("mixed", "Evening")):
        fields = [F.lit(name).alias("scenario"), F.lit(shift).alias("shift")]
        for column in [*worse_high, *worse_low]:
            extreme = F.avg if name == "mixed" else (F.max if (name == "bad") == (column in worse_high) else F.min)
            fields.append(extreme(column).alias(column))
        cases.append(F.struct(*fields))
    return run.groupBy("department").agg(F.array(*cases).alias("cases")).select("department", F.inline("cases"))


def _score_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    cases = _scenarios(shared.factory(spark, folder))
    return model.risk(shared.trained_model(spark, folder), cases)


def _score_production(spark: SparkSession, folder: str) -> DataFrame:
    forest = shared.trained_model(spark, folder)
    scored = model.score(forest, model.scoring_set(shared.model_runs(spark, folder), model=forest))
    return plain(scored.select(*shared.RUN_KEY[:5], "defect_rate", model.PREDICTION, model.PROBABILITY))


def _scored_test(plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plan(shared.scored_test_runs(spark, folder))


def _split_balance(spark: SparkSession, folder: str) -> DataFrame:
    parts = shared.split_runs(spark, folder)
    return parts.groupBy("is_test", model.LABEL).agg(F.count("*").alias("n"))


def _fold_sizes(spark: SparkSession, folder: str) -> DataFrame:
    parts = model.with_fold(shared.labelled_runs(spark, folder), None)
    return parts.groupBy("fold", model.LABEL).agg(F.count("*").alias("n"))


def _model_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the scored test set, whatever trees were grown: sizes that SQL can state, and counts of faults."""
    loaded = shared.trained_model(spark, folder)
    first = {model.PREDICTION: "_said", model.PROBABILITY: "_chance"}
    # The settled rows lie as a forest scores them best, so they are scored again where they are, and compared at once.
    scored = model.score(loaded, shared.scored_test_runs(spark, folder).withColumnsRenamed(first))
    actual, said, chance = F.col(model.LABEL), F.col("_said"), F.col("_chance")
    same = F.round(chance, 9).eqNullSafe(F.round(model.PROBABILITY, 9))
    importance = model.feature_importance(spark, loaded).agg(F.sum("importance_pct").alias("s")).first().s
    right, ones = F.sum((actual == said).cast("long")), F.sum(actual.cast("long"))
    return scored.agg(
        F.count("*").alias("scored"),
        ones.alias("actual_high"),
        F.sum((chance.isNull() | (chance < 0) | (chance > 1)).cast("long")).alias("bad_probabilities"),
        F.sum((said != (chance > 0.5).cast("int")).cast("long")).alias("disagreements"),
        F.count_if(~same).alias("changed_scores"),
        F.lit(abs(float(importance) - 100) < 1).alias("importances_complete"),
        (right >= F.greatest(ones, F.count("*") - ones)).alias("beats_larger_class"),
    )


def _fold_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the folds, and whether the accuracies are shares whose mean and deviation are those given."""
    scores = shared.cross_validated(spark, folder)
    found = scores.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std")).first()
    return scores.select(
        (F.col("fold") - 1).cast("int").alias("fold"),
        "n",
        F.col("accuracy").between(0.5, 1).alias("in_range"),
        (F.abs(F.col("mean_pct") - F.lit(found["mean"]) * 100) < 0.01).alias("mean_right"),
        (F.abs(F.col("std_pct") - F.lit(found["std"]) * 100) < 0.01).alias("std_right"),
    )


def _importance_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Importances added up from the saved forest's nodes, against those that the loaded model states."""
    loaded = shared.trained_model(spark, folder)
    own = model.importances_from_nodes(spark, shared.model_path(spark, folder))
    stated = model.feature_importance(spark, loaded).select("feature", F.col("importance").alias("stated"), "bar_pct")
    apart = F.abs(F.col("importance") - F.col("stated"))
    percent = F.round(F.col("stated") * 100, 1)
    bar = F.least(F.lit(100), F.round(percent / 30 * 100).cast("int"))
    return own.join(stated, "feature").select(
        "feature", (apart <= 1e-9).alias("agrees"), F.col("importance").between(0, 1).alias("in_range"),
        (F.col("bar_pct") == bar).alias("bar_right"),
    )


def _scenario_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The inputs of the planned runs, and whether their two percents and their words agree."""
    risk = _score_scenarios(spark, folder)
    said = F.when(F.col(model.PREDICTION) == 1, "HIGH DEFECT RISK").otherwise("LOW DEFECT RISK")
    columns = [c for c in model.FEATURES if c not in model.INDEXED.values()]
    return risk.select(
        "department", "scenario", "shift", *[F.round(c, 6).alias(c) for c in columns],
        (F.abs(F.col("low_pct") + F.col("high_pct") - 100) < 0.11).alias("adds_up"),
        (F.col("risk") == said).alias("words_right"),
        (F.col(model.PREDICTION) == (F.col(model.PROBABILITY) > 0.5).cast("int")).alias("prediction_right"),
    )


def _score_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The scored table by machine: runs, units and faulty scores."""
    scored = _score_production(spark, folder)
    chance, said = F.col(model.PROBABILITY), F.col(model.PREDICTION)
    faulty = chance.isNull() | (chance < 0) | (chance > 1) | (said != (chance > 0.5).cast("int"))
    return scored.groupBy("machine_id", "shift").agg(
        F.count("*").alias("runs"), F.round(F.avg("defect_rate"), 6).alias("mean_rate"), F.count_if(faulty).alias("faulty")
    )


def _prediction_sample(spark: SparkSession, folder: str) -> DataFrame:
    return model.prediction_sample(shared.scored_sample(spark, folder), shared.RUN_KEY)


def _sample_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The first runs of the test set: their places, their labels, and whether ``correct`` says what it should."""
    return _prediction_sample(spark, folder).select(
        "sample", "actual", (F.col("correct") == (F.col("actual") == F.col("predicted"))).alias("consistent")
    )


def _append_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Sales brought as two CSV batches, one of them failing once, both repeated: every sale counts once."""
    t = shared.factory(spark, folder)
    name = shared.short_name(folder)
    base, into = own_folder(spark, "ingest"), f"{own_folder(spark, 'ingest')}/sales-{name}"
    early = F.col("sale_date") < F.to_date(F.lit("1995-01-01"))
    paths = {"early": f"{base}/early-{name}", "late": f"{base}/late-{name}"}
    for batch, rows in (("early", t.sales.where(early)), ("late", t.sales.where(~early))):
        rows.write.mode("overwrite").option("header", True).csv(paths[batch])
    for attempt in ("early", "failed", "late", "early", "late"):
        if attempt == "failed":
            batches.stage(t.sales.where(~early), into)  # all rows are written, but the writer ends before the log entry
        else:
            batches.import_batch(spark, paths[attempt], "sales", into, attempt)
    return plain(batches.read(spark, into, csv_files.SCHEMAS["sales"]))


def _footer_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    return quality.footer_counts(spark, {name: f"{folder}/{name}.parquet" for name in names})


def _slice_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """First quarters of a span of days, from the runs laid out by month."""
    path = shared.runs_by_month(spark, folder)
    run = layout.read_by_month(spark, path, shared.factory(spark, folder).production.schema)
    run = layout.between(run, "1994-02-10", "1996-03-15")
    run = layout.of_months(run, layout.read_months(spark, path).where("quarter = 1"))
    return plain(run.select("prod_date", "machine_id", "shift", "units_made", "units_defective"))


def _sketch_quantiles(run: DataFrame) -> DataFrame:
    """How far quantiles from the months' sketches are from the ranks asked for: within one percent or not."""
    asked = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    first, last = "1993-03-01", "1997-10-01"
    rates = run.select("shift", "prod_date", "humidity")
    sketches = quantiles.month_sketches(rates, "humidity", "prod_date", "shift")
    found = quantiles.from_sketches(sketches, asked, "shift", first=first, last=last)
    dated = rates.where(f"trunc(prod_date, 'MM') between date'{first}' and date'{last}'")
    joined = dated.join(F.broadcast(found), "shift")  # a row a shift
    value = F.col("humidity").cast("double")
    ranks = []
    for name in asked:
        ranks += [F.avg((value < F.col(name)).cast("int")).alias(f"{name}_below"), F.avg((value <= F.col(name)).cast("int")).alias(f"{name}_upto")]
    rows = joined.groupBy("shift").agg(F.first("n").alias("n"), *ranks)
    near = [(F.lit(p + 0.01) >= F.col(f"{c}_below")) & (F.lit(p - 0.01) <= F.col(f"{c}_upto")) for c, p in asked.items()]
    return rows.select("shift", "n", *[ok.alias(f"{c}_near") for c, ok in zip(asked, near)])


def _rate_bars(t: FactoryTables) -> DataFrame:
    """Machines with the length of their bar, in percent of the longest."""
    machines = summaries.report_machines(t).select("machine_id", "defect_rate")
    highest = charts.with_overall(machines, _high=F.max("defect_rate"))
    return highest.select("machine_id", "defect_rate", percent_of(F.col("defect_rate"), F.col("_high")).alias("bar_pct"))


def _importance(spark: SparkSession, folder: str) -> DataFrame:
    return model.feature_importance(spark, shared.trained_model(spark, folder))


def _model_insights(spark: SparkSession, folder: str) -> DataFrame:
    """The forest's runs are joined and kept, so the other insights are added up from them."""
    t, importance = shared.factory(spark, folder), _importance(spark, folder)
    return report.insights(t, importance, of=single_keys(t, joined=shared.model_runs(spark, folder)))


def queries() -> dict[str, Query]:
    return {
        # scans, quality, sources and sinks
        "table_counts": _on_tables(quality.table_counts),
        "dq_orphans": _on_tables(quality.orphans),
        "dq_nulls": _on_tables(quality.nulls),
        "dq_dup_keys": _on_tables(quality.duplicate_keys),
        "surrogate_key": _on_tables(_surrogate_key),
        "ingest_csv": _ingest_csv,
        "csv_result": _csv_result,
        "append_batches": _append_batches,
        "footer_counts": _footer_counts,
        "slice_by_month": _slice_by_month,
        # joins and derived columns
        "enriched_production": _on_runs(
            lambda run: run.drop("week", "good_units", "month", "efficiency", "revenue_lost")
        ),
        "enriched_sales": _on_tables(star.enriched_sales),
        "enriched_maintenance": _on_tables(star.enriched_maintenance),
        "derived_metrics": _on_tables(_derived_metrics),
        "rounded_metrics": _on_tables(_rounded_metrics),
        "date_labels": _on_tables(_date_labels),
        "label_text": _on_tables(_label_text),
        "slice_filter": _on_tables(_slice),
        "scatter_points": _on_runs(lambda run: ranking.points(run, "department", "temperature", "defect_rate")),
        "scatter_sample": _on_runs(
            lambda run: ranking.sample_per_group(run, ["department"], shared.RUN_KEY, 60).select(
                "department", "defect_rate", *shared.RUN_KEY
            )
        ),
        "distinct_values": _on_runs(lambda run: ranking.distinct_values(run, ["machine_name", "department"])),
        # summaries
        "production_summary": _on_tables(summaries.production_summary),
        "kpi_summary": _on_tables(summaries.kpi_summary),
        "machine_performance": _on_tables(summaries.machine_performance),
        "shift_analysis": _on_tables(summaries.shift_analysis),
        "monthly_trend": _on_tables(summaries.monthly_trend),
        "department_analysis": _on_tables(summaries.department_analysis),
        "product_analysis": _on_tables(summaries.product_analysis),
        "sales_by_product": _on_tables(summaries.sales_share),
        "machine_mean_rates": _on_tables(summaries.machine_mean_rates),
        "shift_summary": _on_tables(summaries.shift_summary),
        "revenue_lost_by_product": _on_tables(summaries.revenue_lost_by_product),
        "revenue_by_product": _on_tables(summaries.revenue_by_product),
        "machine_shift_pivot": _on_tables(summaries.machine_shift_pivot),
        "department_means": _on_tables(summaries.department_means),
        "department_losses": _on_tables(summaries.department_losses),
        "monthly_chart": _on_tables(summaries.monthly_chart),
        "monthly_sales": _on_tables(summaries.monthly_sales),
        "maintenance_cost_by_type": _on_tables(summaries.maintenance_cost_by_type),
        "revenue_by_region": _on_tables(summaries.revenue_by_region),
        "report_machines": _on_tables(summaries.report_machines),
        "report_months": _on_tables(summaries.report_months),
        # ranking, flags, bands
        "month_trend": _on_tables(charts.month_trend),
        "best_worst_flags": _on_tables(charts.best_worst_flags),
        "machine_bands": _on_tables(charts.machine_bands),
        "rate_bars": _on_tables(_rate_bars),
        "shift_share": _on_tables(charts.shift_share),
        "region_share": _on_tables(charts.region_share),
        "maintenance_share": _on_tables(charts.maintenance_share),
        "revenue_lost_bands": _on_tables(charts.revenue_lost_bands),
        "worst_runs": _on_tables(report.worst_runs),
        "worst_runs_rounded": _on_tables(lambda t: report.worst_runs(t, round_rows=True)),
        "best_worst_picks": _on_tables(report.best_worst_picks),
        "bundle_worst_runs": _on_tables(lambda t: report.bundle(t)["worst_runs"]),
        "bundle_kpis": _on_tables(lambda t: report.bundle(t)["kpis"]),
        "machine_status": _on_tables(report.machine_status),
        "shift_status": _on_tables(report.shift_status),
        "month_status": _on_tables(report.month_status),
        # statistics
        "correlation_factors": _on_runs(lambda run: stats.correlation_factors(run, "defect_rate", FACTORS)),
        "correlation_matrix": _on_runs(lambda run: stats.correlation_matrix(run, MATRIX)),
        "correlation_lower": _on_runs(lambda run: stats.lower_triangle(stats.correlation_matrix(run, MATRIX))),
        "describe_stats": _on_runs(lambda run: stats.describe(run, DESCRIBED)),
        "trend_line_fit": _on_runs(lambda run: _rounded_fit(stats.line_fit(run, "temperature", "defect_rate"))),
        "trend_line_points": _on_runs(
            lambda run: _rounded_points(stats.line_points(stats.line_fit(run, "temperature", "defect_rate")))
        ),
        "shift_boxplot": _on_runs(lambda run: stats.box_statistics(run, "defect_rate", "shift", SHIFTS)),
        "shift_outliers": _on_runs(lambda run: stats.outliers(run, "revenue_lost", "shift", SHIFTS)),
        "label_histogram": _on_runs(
            lambda run: stats.histogram(model.with_label(run), "temperature", model.LABEL, [0, 1])
        ),
        "sketch_quantiles": _on_runs(_sketch_quantiles),
        "rate_histogram": _on_runs(lambda run: stats.histogram(run, "defect_rate", "shift", SHIFTS)),
        # model
        "high_defect_label": _on_runs(_labelled),
        "label_balance": _on_runs(lambda run: model.label_balance(model.with_label(run))),
        "category_encoding": _on_runs(
            lambda run: model.encode_categories(run, ["shift", "department", "product_name"])
        ),
        "confusion_matrix": _on_runs(lambda run: model.confusion_matrix(_rule(model.with_label(run)))),
        "classification_report": _on_runs(lambda run: model.classification_report(_rule(model.with_label(run)))),
        "rule_accuracy": _on_runs(lambda run: model.accuracy(_rule(model.with_label(run)))),
        "stratified_split": _split_balance,
        "fold_sizes": _fold_sizes,
        "model_checks": _model_checks,
        "model_accuracy": _scored_test(model.accuracy),
        "model_confusion": _scored_test(model.confusion_matrix),
        "model_report": _scored_test(model.classification_report),
        "feature_importance": _importance,
        "probability_histogram": _scored_test(
            lambda scored: stats.histogram(scored, model.PROBABILITY, model.LABEL, [0, 1])
        ),
        "prediction_sample": _prediction_sample,
        "score_scenarios": _score_scenarios,
        "score_production": _score_production,
        "cross_validation": shared.cross_validated,
        "fold_checks": _fold_checks,
        "importance_checks": _importance_checks,
        "scenario_checks": _scenario_checks,
        "score_checks": _score_checks,
        "sample_checks": _sample_checks,
        # report
        "kpi_targets": _on_tables(charts.kpi_targets),
        "report_kpis": _on_tables(report.report_kpis),
        "insights": _on_tables(report.insights),
        "model_insights": _model_insights,
    }


def _rounded_fit(fit: DataFrame) -> DataFrame:
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "x_min", "x_max")


def _rounded_points(line: DataFrame) -> DataFrame:
    return line.select("point", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
