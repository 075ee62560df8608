"""Benchmark passages in training documents, found through a broadcast set of the benchmark's word windows.

Words are the runs of characters other than ASCII non-alphanumerics, after A-Z became a-z. A window is ``n`` words of an
item in a row; an item of fewer words, but not none, is one window. A document need not be probed at every word: a
window of L words that starts anywhere holds the g words, g = (L + 1) // 2, that start at the next multiple of
L - g + 1. So only those short grams are hashed and looked up in the broadcast set of all grams of the items; around
each hit the few windows that hold it are looked up, and compared word by word by the join on their text.

Cases: a NULL or empty text has no words and no hits; so has a NULL item. Rows of equal key and text are judged alike
and come back as often as they came; rows of equal key and unlike texts are judged apart. Items of equal windows are
all named. Empty tables give empty, or clean, results. The input's other columns are not looked at, whatever their
names. Documents of any length are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import NOT_WORD, ascii_lower, broadcast_if_small, written

#: So many windows of a benchmark are broadcast at most (about 100 MB); more are joined by shuffling.
BROADCAST_WINDOWS = 500_000


def words(text: Column | str) -> Column:
    """The words of a text, in order; none of NULL."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), NOT_WORD), ""), F.array().cast("array<string>"))


def _gram(length: int) -> tuple[int, int]:
    """Words of a gram, and the step between the places probed."""
    size = (length + 1) // 2
    return size, length - size + 1


def _probes(length: int, n_words: Column, size: int, step: int) -> Column:
    """Where grams for windows of so many words are looked up in a document of ``n_words``."""
    at = F.sequence(F.lit(1), n_words - size + 1, F.lit(step))
    probe = F.transform(at, lambda i: F.struct(F.lit(length).alias("length"), i.cast("int").alias("at")))
    return F.when(n_words >= length, probe).otherwise(F.array().cast("array<struct<length:int,at:int>>"))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """Distinct windows of the items: (length, place 0.. within its item, window text, words, items that have it)."""
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("w"))
        .where(F.size("w") > 0)
        .select("item", "w", F.least(F.size("w"), F.lit(n)).alias("length"))
        .select("item", "w", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
        .select("item", "length", F.slice("w", F.col("at"), F.col("length")).alias("of"))
        .groupBy("length", "of")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("window", F.array_join("of", " "))
    )


def hits(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", n: int = 10,
) -> DataFrame:
    """Per document: key, ``n_words``, ``n_hit``, ``items`` (sorted) and ``spans`` (sorted [first word, words])."""
    known = written(windows(benchmark, item, item_text, n), "windows")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most n numbers
    small = known.count() <= BROADCAST_WINDOWS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    grams = None
    for length in lengths:
        size, _ = _gram(length)
        at = F.explode(F.sequence(F.lit(1), F.lit(length - size + 1)))
        own = (
            known.where(F.col("length") == length)
            .select("of", at.alias("at"))
            .select(F.lit(length).alias("length"), F.xxhash64(F.slice("of", F.col("at"), size)).alias("gram"))
        )
        grams = own if grams is None else grams.union(own)
    # One more row a document, of length 0, carries its number of words along; its gram is always found.
    spark = docs.sparkSession
    always = spark.range(1).select(F.lit(0).alias("length"), F.lit(0).cast("long").alias("gram"))
    grams = always if grams is None else grams.distinct().union(always)

    n_words = F.size("w")
    places = [F.array(F.struct(F.lit(0).alias("length"), F.lit(0).alias("at")))]
    gram = F.when(F.col("probe.length") == 0, F.lit(0).cast("long"))
    first = F.when(F.col("length") == 0, F.lit(1))
    for length in lengths:
        size, step = _gram(length)
        places.append(_probes(length, n_words, size, step))
        gram = gram.when(
            F.col("probe.length") == length, F.xxhash64(F.slice("w", F.col("probe.at"), size))
        )
        first = first.when(F.col("length") == length, F.greatest(F.lit(1), F.col("at") - (step - 1)))
    found = (
        docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("same"), words(text).alias("w"))
        .select("key", "same", "w", F.explode(F.concat(*places)).alias("probe"))
        .select("key", "same", "w", F.col("probe.length").alias("length"), F.col("probe.at").alias("at"), gram.alias("gram"))
        .join(sent(grams), ["length", "gram"])
        .select("key", "same", "w", "length", "at", first.alias("lo"), F.least(F.col("at"), n_words - F.col("length") + 1).alias("hi"))
    )
    # Windows that hold the gram: word places count from 1 here; the marker row has the window "".
    starts = F.when(F.col("length") == 0, F.array(F.lit(0))).when(
        F.col("lo") <= F.col("hi"), F.sequence("lo", "hi")
    ).otherwise(F.array().cast("array<int>"))
    each = found.select("key", "same", "w", "length", F.explode(starts).alias("at")).select(
        "key", "same", "length", "at",
        F.when(F.col("length") == 0, n_words).alias("n_words"),
        F.when(F.col("length") == 0, F.lit("")).otherwise(F.array_join(F.slice("w", F.greatest("at", F.lit(1)), F.col("length")), " ")).alias("window"),
    )
    marker = spark.range(1).select(
        F.lit(0).alias("length"), F.lit("").alias("window"), F.array().cast("array<string>").alias("items")
    )
    matched = each.join(sent(known.select("length", "window", "items").union(marker)), ["length", "window"])
    real = F.col("length") > 0
    per_text = matched.groupBy("key", "same").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(~real, 1)).alias("copies"),
        F.collect_set(F.when(real, F.struct((F.col("at") - 1).alias("at"), F.col("length").alias("length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        F.col("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["at"] + x["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(a["end"], x["at"]))).alias("n"),
        ),
    )["n"]
    return (
        per_text.withColumn("spans", F.array_sort("spans"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(F.col("key").alias(key), "n_words", covered.alias("n_hit"), "items", "spans", F.col("same").alias("text_hash"))
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, mode: str = "documents", key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", n: int = 10,
) -> DataFrame:
    """``docs`` without the documents that hold a window, or (``mode="spans"``) without the words of such windows.

    A removed word goes with the characters before it back to the previous word.
    """
    found = hits(docs, benchmark, key, text, item, item_text, n).where("n_hit > 0")
    found = found.select(F.col(key).alias("_key"), F.col("text_hash").alias("_same"), F.col("spans").alias("_spans"))
    match = docs[key].eqNullSafe(found["_key"]) & (F.xxhash64(docs[text]) == found["_same"])
    if mode == "documents":
        found = broadcast_if_small(found.select("_key", "_same"), "found")
        match = docs[key].eqNullSafe(found["_key"]) & (F.xxhash64(docs[text]) == found["_same"])
        return docs.join(found, match, "left_anti")
    if mode != "spans":
        raise ValueError("mode is documents or spans")
    found = found.dropDuplicates(["_key", "_same"])
    word = NOT_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{word[:-1]}*[^{word[1:-1]}+|{word}"), F.lit(0))
    kept = F.filter(pieces, lambda x, i: ~F.exists("_spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["length"])))
    cut = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))
    return docs.join(found, match, "left").withColumn(text, cut).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The registered query: what was found in every document, with a digest of the items."""
    found = hits(docs, benchmark, n=n)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same for DuckDB.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
bw AS (
  SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM bw, range(1, len(w) - least(len(w), 10) + 2) r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
pos AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM dw, lens, range(1, len(w) - n + 2) r(i)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN iw ON pos.n = iw.n AND pos.t = iw.t),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), range(0, n) r(k) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
