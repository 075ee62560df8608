"""Correlation, description, least squares, boxes and histograms."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.bands import direction, strength
from millwright.operators import quantiles as Q
from millwright.session import settle


def correlation(x: str, y: str) -> Column:
    """Pearson's r over the rows where both are present; NULL when either is constant.

    ``corr`` itself raises an error for a constant column under ANSI rules.
    """
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), spread)


def correlation_factors(df: DataFrame, target: str, factors: list[str], digits: int = 6) -> DataFrame:
    """One row per factor: its correlation with the target, how strong and which way."""
    one_row = df.agg(*[F.round(correlation(target, f), digits).alias(f) for f in factors])
    return one_row.unpivot([], factors, "factor", "correlation").select(
        "factor",
        "correlation",
        F.abs("correlation").alias("abs_correlation"),
        strength(F.col("correlation")).alias("strength"),
        direction(F.col("correlation")).alias("direction"),
    )


def comoments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Plain sums for every pair of columns, by the set of columns present: one row a set, settled.

    ``mask`` has bit i where column i is present; ``n`` counts rows; ``s`` has a sum a column, ``lo`` and ``hi`` its extremes, ``p``
    a sum of products for each of ``_pairs``. Values are taken from near their mean (``c<i>``, that of the first rows found), so that
    products lose no digits. No row is multiplied, and a hot set of columns reaches the shuffle as one row a task.
    """
    if len(columns) > 60:
        raise ValueError("at most 60 columns")  # a bit each
    doubles = df.select([F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    near = doubles.limit(1000).agg(*[F.avg(c).alias(c) for c in doubles.columns]).first()
    centre = [float(near[c] or 0.0) for c in doubles.columns]
    present = [F.col(c).isNotNull() for c in doubles.columns]
    bits = [F.when(here, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, here in enumerate(present)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    off = [F.coalesce(F.col(c) - F.lit(m), F.lit(0.0)).alias(c) for c, m in zip(doubles.columns, centre)]
    centred = doubles.select(mask.alias("mask"), *off)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"s{i}") for i in range(len(columns))]]
    ends = [end(f"v{i}").alias(f"{name}{i}") for i in range(len(columns)) for name, end in (("lo", F.min), ("hi", F.max))]
    pairs = _pairs(columns)
    products = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]
    added = centred.groupBy("mask").agg(*sums, *ends, *products)
    packed = [F.array(*[f"{c}{i}" for i in range(len(columns))]).alias(c) for c in ("s", "lo", "hi")]
    return settle(added.select("mask", "n", *packed, F.array(*[f"p{k}" for k in range(len(pairs))]).alias("p")))


def _pairs(columns: list[str]) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(len(columns)), 2))


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """(row_idx, col_idx, row_name, col_name, correlation) for every pair, in one pass over the data.

    A pair's correlation is over the rows that have both columns: the sets of columns that hold both are added up. NULL
    where one of them is constant there.
    """
    pairs = _pairs(columns)
    place = {pair: k for k, pair in enumerate(pairs)}
    names = F.array(*[F.lit(c) for c in columns])
    # Where a pair's figures are: its columns, and its products with themselves and one another.
    where = [F.struct(*[F.lit(x).alias(n) for n, x in zip("ijabc", (i, j, place[i, i], place[j, j], place[i, j]))]) for i, j in pairs]
    each = comoments(df, columns).withColumn("at", F.explode(F.array(*where)))
    held = [F.expr(f"mask & shiftleft(1L, at.{c}) <> 0") for c in "ij"]
    added = (
        each.where(held[0] & held[1])
        .groupBy("at.i", "at.j")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(F.expr(e)).alias(c) for c, e in {"sx": "s[at.i]", "sy": "s[at.j]", "sxx": "p[at.a]", "syy": "p[at.b]", "sxy": "p[at.c]"}.items()],
            *[F.min(F.expr(f"lo[at.{c}]")).alias(f"lo{n}") for c, n in ("ix", "jy")],
            *[F.max(F.expr(f"hi[at.{c}]")).alias(f"hi{n}") for c, n in ("ix", "jy")],
        )
    )

    def spread(a: str, b: str, products: str) -> Column:
        return F.col(products) - F.col(a) * F.col(b) / F.col("n")

    varies = (F.col("lox") < F.col("hix")) & (F.col("loy") < F.col("hiy"))
    r = F.try_divide(spread("sx", "sy", "sxy"), F.sqrt(spread("sx", "sx", "sxx")) * F.sqrt(spread("sy", "sy", "syy")))
    found = added.select("i", "j", F.when(varies, F.round(r, digits)).alias("r"))
    known = found.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "r")))).scalar()  # one entry a pair
    cells = df.sparkSession.range(len(columns) ** 2).select(
        F.expr(f"cast(id div {len(columns)} as int)").alias("row_idx"), F.expr(f"cast(id % {len(columns)} as int)").alias("col_idx")
    )
    key = F.struct(F.least("row_idx", "col_idx").alias("i"), F.greatest("row_idx", "col_idx").alias("j"))
    return cells.select(
        "row_idx", "col_idx", F.get(names, F.col("row_idx")).alias("row_name"), F.get(names, F.col("col_idx")).alias("col_name"),
        F.try_element_at(known, key).alias("correlation"),
    )


def lower_triangle(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("row_idx") > F.col("col_idx"))


def describe(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column, from one pass over the data."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    counts = Q.value_counts(long, "value", "column", columns)
    n, v = F.col(Q.N), F.col(Q.VALUE)
    totals = counts.groupBy(Q.GROUP).agg(
        F.sum(n).alias("count"),
        (F.sum(n * v) / F.sum(n)).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    # As many rows as columns are described, so both broadcasts are small.
    spread = (
        counts.join(F.broadcast(totals.select(Q.GROUP, "count", "mean")), Q.GROUP)
        .groupBy(Q.GROUP)
        .agg(
            F.sqrt(
                F.try_divide(F.sum(n * F.pow(v - F.col("mean"), 2)), F.first("count") - 1)
            ).alias("std")
        )
    )
    quartiles = Q.from_counts(counts, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    rows = totals.join(F.broadcast(spread), Q.GROUP).join(F.broadcast(quartiles), Q.GROUP)
    figures = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return rows.select(
        F.col(Q.GROUP).alias("column"), "count", *[F.round(f, digits).alias(f) for f in figures]
    )


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x, with the span of x: one row."""
    x, y = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
    )


def line_points(fit: DataFrame, points: int = 100) -> DataFrame:
    """The fitted line at evenly spaced x, both ends included."""
    step = (F.col("x_max") - F.col("x_min")) / (points - 1)
    x = F.col("x_min") + F.col("point") * step
    return fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).select(
        "point", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y")
    )


def _boxed(df: DataFrame, value: str, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    counts = Q.value_counts(df, value, by, order)
    box = Q.from_counts(counts, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = box.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    return counts, fenced


def box_statistics(df: DataFrame, value: str, by: str, order: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 box lengths, and the count beyond them."""
    counts, fenced = _boxed(df, value, by, order)
    v, n = F.col(Q.VALUE), F.col(Q.N)
    within = v.between(F.col("low"), F.col("high"))
    names = F.array(*[F.lit(g) for g in order])
    # One row for each listed group: small enough to broadcast.
    return (
        counts.join(F.broadcast(fenced), Q.GROUP)
        .groupBy(Q.GROUP, "q1", "median", "q3")
        .agg(
            F.least(F.min(F.when(v >= F.col("low"), v)), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(v <= F.col("high"), v)), F.col("q3")).alias("whisker_high"),
            F.sum(F.when(within, 0).otherwise(n)).cast("bigint").alias("outliers"),
            F.sum(n).alias("n"),
        )
        .select(
            F.array_position(names, F.col(Q.GROUP)).cast("int").alias("position"),
            F.col(Q.GROUP).alias(by),
            "n",
            *[F.round(c, 6).alias(c) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")],
            "outliers",
        )
        .orderBy("position")
    )


def outliers(df: DataFrame, value: str, by: str, order: list[str]) -> DataFrame:
    """Each value beyond the whiskers, with how many rows have it."""
    counts, fenced = _boxed(df, value, by, order)
    return (
        counts.join(F.broadcast(fenced), Q.GROUP)
        .where(~F.col(Q.VALUE).between(F.col("low"), F.col("high")))
        .select(
            F.col(Q.GROUP).alias(by),
            F.round(Q.VALUE, 6).alias(value),
            F.col(Q.N).alias("points"),
        )
    )


def histogram(df: DataFrame, value: str, by: str, classes: list, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal bins over each class's own range; empty bins are kept.

    The classes are listed as for a pivot, so the ranges fit in one row.
    """
    v = F.col(value).cast("double")
    # Settled, so that the one row of ranges is found once for both its uses.
    ranges = settle(df.agg(
        F.array(
            *[
                F.struct(
                    F.min(F.when(F.col(by) == c, v)).alias("low"),
                    F.max(F.when(F.col(by) == c, v)).alias("high"),
                )
                for c in classes
            ]
        ).alias("r")
    ))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(by)).cast("int") - 1
    placed = (
        df.where(F.col(by).isin(classes) & v.isNotNull())
        .select(place.alias("_class"), v.alias("_v"))
        .withColumn("_range", F.element_at(ranges.scalar(), F.col("_class") + 1))
    )
    low, high = F.col("_range.low"), F.col("_range.high")
    # The last bin holds its upper end; a class of one value has a range of 1 around it.
    bin_no = F.when(high == low, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("_v") - low) / (high - low) * bins), F.lit(bins - 1))
    )
    # At most bins * classes rows, so small enough to broadcast.
    counts = (
        placed.withColumn("bin", bin_no.cast("int")).groupBy("_class", "bin").agg(F.count("*").alias("n"))
    )
    frame = ranges.select(F.posexplode("r").alias("_class", "_range")).where("_range.low is not null")
    frame = frame.select(
        "_class",
        F.when(high == low, low - 0.5).otherwise(low).alias("low"),
        F.when(high == low, low + 0.5).otherwise(high).alias("high"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
    )
    width = (F.col("high") - F.col("low")) / bins
    names = F.array(*[F.lit(c) for c in classes])
    return frame.join(F.broadcast(counts), ["_class", "bin"], "left").select(
        names[F.col("_class")].alias(by),
        "bin",
        F.round(F.col("low") + F.col("bin") * width, 6).alias("bin_low"),
        F.round(F.col("low") + (F.col("bin") + 1) * width, 6).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
