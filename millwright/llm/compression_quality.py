"""Quality by compression: one Zstandard dictionary from good texts, one from bad ones.

A text is cut into pieces of a few kilobytes, every piece is compressed with either dictionary, and the normalised
difference of the two sums of compressed sizes is turned into a probability by a logistic curve. The curve also sees
how small the text becomes, as text that only repeats itself is small under any dictionary. It is fitted across folds: a
row's sizes come from dictionaries that its fold had no part in, so few labels serve both, and its ridge keeps few rows
from being taken for sure.

Cases: a NULL text counts as empty; an empty text has the difference 0 and the mean size of the texts learnt from. Texts
may have any length, as pieces are compressed one by one; texts of over ``longest`` bytes are scored but not learnt from.
Equal texts get equal scores. Extra columns are kept whatever their names, but for those that ``score`` adds, which it
replaces; ``keep`` returns the columns it was given. Labels other than 0 and 1, and NULL labels, are not learnt
from. A document labelled more than once, or labels of a repeated key, count each time. Without two texts of either
label nothing is learnt: the model then gives every text the score 0.5, and none is rejected. Empty tables are scored to
empty tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 4096
LEVEL = 3
#: Folds of the labelled rows: dictionaries for a fold are made without it.
FOLDS = 4


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve ``1 / (1 + exp(-(slope * difference + size_slope * size + intercept)))``."""

    good: bytes = b" " * 8
    bad: bytes = b" " * 8
    slope: float = 0.0
    size_slope: float = 0.0
    intercept: float = 0.0
    mean_size: float = 0.0


def _compressors(good: bytes, bad: bytes, level: int) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
    def made(data: bytes) -> zstd.ZstdCompressor:
        held = zstd.ZstdCompressionDict(data)
        held.precompute_compress(level=level)
        return zstd.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    return made(good), made(bad)


def sizes(
    text: str | None, by_good: zstd.ZstdCompressor, by_bad: zstd.ZstdCompressor
) -> tuple[float, float | None]:
    """(bad size - good size) / (bad size + good size), above 0 where the good dictionary fits better, and the
    logarithm of the smaller of them by the text's own size (none for an empty text)."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return 0.0, None
    g = b = 0
    for i in range(0, len(data), PIECE):
        part = data[i : i + PIECE]
        g += len(by_good.compress(part))
        b += len(by_bad.compress(part))
    return (b - g) / (b + g), math.log(min(b, g) / len(data))


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    while name in df.columns:
        name += "_"
    return name


def _with_sizes(df: DataFrame, text: str, dictionaries: list[tuple[bytes, bytes]], fold: str | None = None) -> tuple[DataFrame, str, str]:
    """``df`` with the two sizes of its texts, and the names of their columns.

    There is one pair of dictionaries, or one a ``fold``.
    """
    own = [_free(df, "size_difference"), _free(df, "size_log")]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in own]])
    at, by = df.columns.index(text), None if fold is None else df.columns.index(fold)

    def run(batches):
        pairs = [_compressors(good, bad, LEVEL) for good, bad in dictionaries]
        for batch in batches:
            folds = [0] * batch.num_rows if by is None else batch.column(by).to_pylist()
            found = [sizes(x, *pairs[k]) for x, k in zip(batch.column(at).to_pylist(), folds)]
            more = [pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *own])

    return df.mapInArrow(run, schema), *own


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression of y on the columns of x by Newton steps: the weights, the constant's last."""
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    rows = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(
            rows.T @ (rows * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), rows.T @ (y - p) - ridge * w
        )
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return np.append(slopes, w[-1] - slopes @ middle)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "label",
    dictionary_rows: int = 1500,
    curve_rows: int = 20000,
    dictionary_bytes: int = 112640,
    longest: int = 100_000,
    learnt_bytes: int = 16_000_000,
) -> Model:
    """Learn from ``docs`` (``key``, ``text``) that ``labels`` (``key``, ``label`` 1 good or 0 bad) covers.

    ``dictionary_rows`` texts of either label, the first by a hash of their key, make the dictionaries: at most
    ``longest`` bytes each and ``learnt_bytes`` together come to the driver. The curve is fitted to the sizes of at most
    ``curve_rows`` rows, taken by the same hash, of which only sizes and labels come. These bounds concern the fit alone:
    every row is scored. Rows are picked from the labels, and their keys broadcast to the documents (23,000 at most).
    """
    rows = labels.select(F.col(key).alias("_of"), F.col(label).cast("int").alias("_label")).where("_of is not null and _label in (0, 1)")
    rows = rows.withColumn("_order", F.xxhash64(F.lit(7), "_of")).withColumn("_fold", F.pmod(F.xxhash64(F.lit(11), "_order"), F.lit(FOLDS)).cast("int"))
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def with_texts(some: DataFrame) -> DataFrame:
        return texts.join(F.broadcast(some), F.col("_key") == F.col("_of")).select("_text", "_label", "_order", "_fold")

    first = [rows.where(F.col("_label") == v).orderBy("_order", "_of").limit(dictionary_rows) for v in (1, 0)]
    learnt = with_texts(first[0].union(first[1])).withColumn("_size", F.octet_length("_text")).where(f"_size between 1 and {longest}")
    so_far = Window.partitionBy("_label").orderBy("_order", "_text")  # as many rows as make a dictionary
    learnt = learnt.withColumn("_upto", F.sum("_size").over(so_far)).where(F.col("_upto") <= learnt_bytes)
    samples: dict[int, list[tuple[int, bytes]]] = {1: [], 0: []}
    for r in learnt.orderBy("_order", "_text").collect():
        samples[r["_label"]].append((r["_fold"], r["_text"].encode("utf-8", "replace")))

    def made(but: int | None = None) -> tuple[bytes, bytes] | None:
        kept = [[t for k, t in samples[v] if k != but] for v in (1, 0)]
        return (_dictionary(kept[0], dictionary_bytes), _dictionary(kept[1], dictionary_bytes)) if all(kept) else None

    pairs = [made(k) for k in range(FOLDS)]
    if min(len(samples[0]), len(samples[1])) < 2 or not any(pairs):
        return Model()
    some = rows.orderBy("_order", "_of").limit(curve_rows)
    some = with_texts(some.where(F.col("_fold").isin([k for k in range(FOLDS) if pairs[k]])))
    seen, difference, size = _with_sizes(some, "_text", [p or (b" " * 8, b" " * 8) for p in pairs], "_fold")
    seen = seen.orderBy("_order", difference, size).select(F.col(difference).alias("d"), F.col(size).alias("s"), "_label").toPandas()
    if seen["_label"].nunique() < 2:
        return Model()
    mean = float(seen["s"].mean()) if seen["s"].notna().any() else 0.0
    x = seen[["d", "s"]].fillna({"s": mean}).to_numpy()
    slope, size_slope, intercept = _curve(x, seen["_label"].to_numpy(dtype=float))
    good, bad = made()
    return Model(good, bad, float(slope), float(size_slope), float(intercept), mean)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of texts too few to train on, their own bytes."""
    parts = [x[i : i + PIECE] for x in samples for i in range(0, len(x), PIECE)]
    size = min(size, max(256, sum(map(len, parts)) // 4))
    try:
        return zstd.train_dictionary(size, parts, k=256, d=8, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[:size].ljust(8, b" ")


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``size_difference``, ``size_log``, ``score`` (probability of label 1) and ``predicted`` (1 from 0.5 on)."""
    own = ("size_difference", "size_log", "score", "predicted")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in own or c == text]
    got, difference, size = _with_sizes(df.select(*kept), text, [(model.good, model.bad)])
    at: Column = model.slope * F.col(difference) + model.size_slope * F.coalesce(size, F.lit(model.mean_size)) + model.intercept
    return got.withColumn("score", 1 / (1 + F.exp(-at))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not reject, with the columns they came with."""
    got, difference, size = _with_sizes(df, text, [(model.good, model.bad)])
    at = model.slope * F.col(difference) + model.size_slope * F.coalesce(size, F.lit(model.mean_size)) + model.intercept
    return got.where(1 / (1 + F.exp(-at)) >= 0.5).select(*[F.col(f"`{c}`") for c in df.columns])
