"""Importance resampling towards a target: documents drawn by how much their word runs are like those of a target.

The features of a text are all its runs of 1 to ``max_n`` words, hashed into buckets. What a bucket gains is the log
ratio of its share of the target's features and of the corpus's, both smoothed by one; a document's weight is the mean
gain of its features, and adding Gumbel noise, which depends on nothing but its id, turns the highest scores into a
weighted sample without replacement. Tasks intern the runs of a batch in an open-addressed table (``grams.Table``):
a run is hashed and checked by bytes, its slot holds its bucket and its count, and occurrences gather gains by slot.
Both passes read the texts once; between them there is one number a bucket.

Cases: a NULL or empty text has no features and weight 0. A NULL id counts as the empty text in the noise and comes
first among equal scores. Rows are judged one by one, repeated ones too; repeated rows have equal scores and follow one
another in rank. An empty target gives every bucket the same smoothed share of it. Empty documents give no rows. Other
columns are not looked at, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm import grams
from millwright.llm.common import written
from millwright.operators.ordering import numbered

#: Bytes between words: ASCII other than letters and digits (the same as in ``common.NOT_WORD``).
KINDS = grams.kinds([b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)])


def _interned(texts: list[bytes], max_n: int, buckets: int):
    """The words of the texts, the table of their runs, the bucket of each slot, and the text of each occurrence."""
    words = grams.split(texts, KINDS)
    first, end, text = [], [], []
    for n in range(1, max_n + 1):
        at = words.runs(n)
        first.append(words.first[at])
        end.append(words.end[at + n - 1])
        text.append(words.text[at])
    first, end, text = np.concatenate(first), np.concatenate(end), np.concatenate(text)
    table = grams.Table(words.data, first, end - first)
    bucket = grams.crc32(words.data, first[table.owner], (end - first)[table.owner]) % np.uint32(buckets)
    return words, table, bucket, text


def bucket_counts(docs: DataFrame, text: str = "text", max_n: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): the features of all texts by bucket; buckets without any are left out."""

    def count(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in grams.parts(batch.column(0).to_pylist()):
                _, table, bucket, _ = _interned(part, max_n, buckets)
                total += np.bincount(bucket, weights=table.count, minlength=buckets).astype(np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """By bucket: 1000 times the log ratio of its shares, floored. ``buckets`` numbers come to the driver, no more."""

    def filled(counts: DataFrame, name: str) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in written(counts, name).collect():
            out[row.bucket] = row.n
        return out

    s, t = filled(corpus, "corpus"), filled(target, "target")
    share_s, share_t = (s + 1).astype(float) * float(t.sum() + buckets), (t + 1).astype(float) * float(s.sum() + buckets)
    return np.floor(1000 * np.log(share_t / share_s)).astype(np.int64).tolist()


def weights(docs: DataFrame, gain: list[int], key: str = "doc_id", text: str = "text", max_n: int = 2) -> DataFrame:
    """(key, n_words, n_features, weight) of every document."""
    buckets, table_of = len(gain), np.array(gain, np.int64)

    def weigh(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_words, n_features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for first, part in grams.parts(texts):
                words, table, bucket, of = _interned(part, max_n, buckets)
                here = slice(first, first + len(part))
                n_words[here] = np.bincount(words.text, minlength=len(part))
                n_features[here] = np.bincount(of, minlength=len(part))
                np.add.at(total[here], of, table_of[bucket][table.slots])
            mean = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(mean)],
                names=["key", "n_words", "n_features", "weight"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    numbers = [T.StructField(name, T.LongType(), False) for name in ("n_words", "n_features", "weight")]
    return rows.mapInArrow(weigh, T.StructType([T.StructField("key", rows.schema["key"].dataType), *numbers]))


def scores(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    max_n: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7,
) -> DataFrame:
    """Every document: key, n_features, weight, score, rank (1, 2, 3... of the drawn ones, else NULL).

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (floored) are drawn: the highest
    scores, equal ones by key.
    """
    gain = gains(bucket_counts(docs, text, max_n, buckets), bucket_counts(target, target_text, max_n, buckets), buckets)
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, key, text, max_n).withColumn("score", F.col("weight") + noise)
    late = (F.col("n_words") < min_words).alias("late")  # those that cannot be drawn go behind the others
    scored = written(scored.select("*", late, (-F.col("score")).alias("down")), "scored")
    drawn = scored.where("not late").count() * percent // 100
    place = numbered(scored, ["late", "down", "key"], "place")
    return place.select(
        F.col("key").alias(key), "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place")).alias("rank"),
    )


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The drawn rows of ``docs``. Keys must tell documents apart."""
    found = scores(docs, target, key, text, **settings).where("rank is not null")
    return docs.join(found.select(F.col(key).alias("_drawn")), docs[key].eqNullSafe(F.col("_drawn")), "left_semi")


#: The same for DuckDB. CRC-32 is linear in the bytes: each counts by its value and its distance from the end.
ORACLE_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] FROM benchmark),
feature AS (
  SELECT side, r, unnest(w) AS g FROM words
  UNION ALL
  SELECT side, r, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words),
counted AS (SELECT side, r, g, count(*) AS n FROM feature GROUP BY ALL),
gram AS (SELECT DISTINCT g, hex(encode(g)) AS x FROM counted),
bit AS (
  SELECT b, 0 AS k, b AS v FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bit WHERE k < 8),
step AS (SELECT b, v FROM bit WHERE k = 8),
far AS (
  SELECT b, CAST(0 AS BIGINT) AS d, v FROM step
  UNION ALL
  SELECT far.b, d + 1, xor(far.v >> 8, step.v) FROM far JOIN step ON step.b = (far.v & 255)
  WHERE d + 1 < (SELECT max(len(x)) // 2 FROM gram)),
zeros AS (
  SELECT CAST(0 AS BIGINT) AS d, CAST(4294967295 AS BIGINT) AS v
  UNION ALL
  SELECT d + 1, xor(zeros.v >> 8, step.v) FROM zeros JOIN step ON step.b = (zeros.v & 255)
  WHERE d + 1 <= (SELECT max(len(x)) // 2 FROM gram)),
byte AS (
  SELECT g, len(x) // 2 - i AS d, CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT) AS b
  FROM gram, range(1, len(x) // 2 + 1) t(i)),
crc AS (
  SELECT g, bit_xor(far.v) AS v FROM byte JOIN far ON far.d = byte.d AND far.b = byte.b GROUP BY g),
bucketed AS (
  SELECT gram.g, xor(xor(crc.v, zeros.v), 4294967295) % 10000 AS bucket
  FROM gram JOIN crc ON crc.g = gram.g JOIN zeros ON zeros.d = len(x) // 2),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN bucketed USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM totals) + 10000 AS DOUBLE))
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM totals) + 10000 AS DOUBLE)))) AS BIGINT) AS v FROM totals),
weight AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * v) AS BIGINT) AS v
  FROM counted JOIN bucketed USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (v - ((v % n) + n) % n) // n END AS weight,
    CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
  FROM words LEFT JOIN weight USING (r) WHERE side = 'd'),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM scored),
placed AS (
  SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS FIRST) AS place FROM noisy)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) FROM noisy WHERE n_words >= 20) * 25 // 100 THEN place END AS rank FROM placed
"""
