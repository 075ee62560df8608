"""Phrases whose words go together more often than their parts do, counted exactly per language.

A phrase is a run of words within a piece of text (pieces end at punctuation and line ends). Which runs are frequent is
found by mergeable Misra-Gries summaries, in two steps: runs of one and two words, then longer ones all of whose pairs
may be frequent. Every task sums up its runs by hash and deals the sums to hash partitions; a run that reaches the
threshold within one task is frequent for sure and put aside. The summaries of a partition are merged in one pass with
more counters than the partition's mass divided by the threshold, so what merging takes from a counter stays below the
threshold and every frequent run survives. Survivors become one bitmap per partition (at most ``BITMAP_BYTES`` in all,
whatever the corpus; a fuller bitmap lets more runs through, but never loses one). A last pass interns by their bytes
the runs that the bitmaps let through and counts them exactly; scores are joins of those counts.

Cases: a NULL or empty text has no words; a NULL language is ``und``, together with one of that name. Repeated rows
count as often as they come. Equal scores go by count, then by the phrase's bytes. Empty tables give no rows, and so does
a corpus without frequent phrases. The input's other columns are not looked at, whatever their names. Texts and words
of any length are read whole. Products are taken as decimals, so no count overflows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.llm import grams
from millwright.llm.common import broadcast_if_small, written
from millwright.llm.shingles import _mixed

#: Words are kept apart by spaces and tabs; punctuation and line ends end a piece.
KINDS = grams.kinds([0x20, 0x09], [*b".,;:!?", *range(0x0A, 0x0E)])
#: Text bytes whose runs one hash partition sums up, about: its counters take some megabytes.
PARTITION_BYTES = 24_000_000
#: Sums a task holds before it hands them on, and counts it holds in the exact pass.
HELD, HELD_PHRASES = 3_000_000, 400_000
#: Size of all bitmaps of survivors together, which is what a task is sent at most.
BITMAP_BYTES = 64_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
ONE = "part int, mass long, hashes binary, counts binary, sure binary"


@dataclass
class Bitmaps:
    """Hashes that may be frequent: partition p owns 2**bits[p] bits from byte ``start[p]`` on (none: -1)."""

    start: np.ndarray
    bits: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, n_parts: int, rows: list) -> Bitmaps:
        start, bits, pieces, at = np.zeros(n_parts, np.int64), np.full(n_parts, -1, np.int64), [], 0
        for row in rows:
            start[row.part], bits[row.part] = at, row.bits
            pieces.append(np.frombuffer(bytes(row.bitmap), np.uint8))
            at += len(pieces[-1])
        return cls(start, bits, np.concatenate(pieces) if pieces else np.zeros(1, np.uint8))

    def sent(self, spark: SparkSession):
        """Broadcast as plain arrays, which tasks can read without this package."""
        return spark.sparkContext.broadcast((self.start, self.bits, self.data))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        part, rest = parted(hashes, len(self.start))
        bits = self.bits[part]
        bit = bit_of(rest, np.maximum(bits, 0))
        byte = np.where(bits < 0, 0, self.start[part] + (bit >> 3))
        return (bits >= 0) & ((self.data[byte] >> (bit & 7).astype(np.uint8)) & 1 == 1)


def parted(hashes: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of each hash, and what tells it apart there."""
    return ((hashes >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64), hashes.astype(np.uint32)


def bit_of(rest: np.ndarray, bits) -> np.ndarray:
    mixed = (rest.astype(np.uint64) * _STEP) >> np.uint64(32)
    return (mixed & ((np.uint64(1) << np.asarray(bits).astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes once, sorted, with the sum of their counts."""
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    if not len(h):
        return h, c
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(c, first)


class Summary:
    """Misra-Gries counters: merging keeps the ``capacity`` largest and takes the next one's count from all."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.hashes, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        h, c = _added([self.hashes, *hashes], [self.counts, *counts])
        if len(h) > self.capacity:
            taken = int(np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1])
            self.error += taken
            h, c = h[c > taken], c[c > taken] - taken
        self.hashes, self.counts = h, c

    def survivors(self, threshold: int) -> np.ndarray:
        """All hashes whose true count may reach the threshold."""
        return self.hashes[self.counts + self.error >= threshold]


def _runs(words: grams.Words, tag: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) of the runs of 1, 2... words; ``tag`` is the language's number of each word."""
    one = grams.xxhash64(words.data, words.first, words.end - words.first)
    run = one ^ _mixed(tag)
    for n in range(1, longest + 1):
        at = words.runs(n)
        if n > 1:
            run = run[: max(0, len(one) - n + 1)] * _STEP + one[n - 1 :]
        yield n, at, _mixed(run[at] + np.uint64(n))


def _tags(langs: list[str]) -> np.ndarray:
    raw = [s.encode("utf-8", "replace") for s in langs]
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    return grams.xxhash64(data, np.cumsum(size) - size, size, seed=1)


def _in_parts(batch, size: int = grams.PART_BYTES) -> Iterator[tuple[list[str], grams.Words]]:
    langs = batch.column(0).to_pylist()
    for first, part in grams.parts(batch.column(1).to_pylist(), size):
        yield langs[first : first + len(part)], grams.split(part, KINDS)


def _sums(rows: DataFrame, shortest: int, longest: int, n_parts: int, threshold: int, known) -> DataFrame:
    """Sums of the runs of some lengths, by task and partition; of longer runs only those whose pairs are all ``known``."""

    def deal(h: np.ndarray, c: np.ndarray) -> Iterator:
        import pyarrow as pa

        part, rest = parted(h, n_parts)
        order = np.argsort(part, kind="stable")
        part, rest, c = part[order], rest[order], c[order]
        cuts = np.searchsorted(part, np.arange(n_parts + 1))
        out = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            r, n = rest[cuts[p] : cuts[p + 1]], c[cuts[p] : cuts[p + 1]]
            few = n < threshold
            out.append((p, int(n[few].sum()), r[few].tobytes(), n[few].astype(np.uint16).tobytes(), r[~few].tobytes()))
        names = ("part", "mass", "hashes", "counts", "sure")
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for at in range(0, len(out), 256):
            columns = zip(*out[at : at + 256])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    def sum_up(batches) -> Iterator:
        held, size = [], 0
        pairs = Bitmaps(*known.value) if known is not None else None
        for batch in batches:
            for langs, words in _in_parts(batch):
                pair, found = None, []
                for n, at, h in _runs(words, _tags(langs)[words.text], longest):
                    if n == 2 and shortest > 2:
                        pair = np.zeros(len(words.first), bool)
                        pair[at] = pairs.has(h)
                    if n < shortest:
                        continue
                    if pair is not None:
                        fine = np.ones(len(at), bool)
                        for k in range(n - 1):
                            fine &= pair[at + k]
                        h = h[fine]
                    found.append(h)
                h, c = np.unique(np.concatenate(found), return_counts=True)
                held.append((h, c.astype(np.int64)))
                size += len(h)
                if size > HELD:
                    held = [_added(*zip(*held))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from deal(*held[0])
                        held, size = [], 0
        if held:
            yield from deal(*_added(*zip(*held)))

    return written(rows.mapInArrow(sum_up, ONE), "sums")


def _survivors(sums: DataFrame, n_parts: int, threshold: int) -> list:
    """Rows (part, bits, bitmap) of the runs that may be frequent."""
    room = max(1, BITMAP_BYTES // n_parts * 8).bit_length() - 1

    def bitmap(part: int, summary: Summary, sure: list[np.ndarray]) -> tuple:
        alive = np.unique(np.concatenate([summary.survivors(threshold), *sure]))
        bits = min(room, max(6, (16 * max(1, len(alive))).bit_length()))
        data = np.zeros(1 << (bits - 3) if bits > 3 else 1, np.uint8)
        bit = bit_of(alive, bits)
        np.bitwise_or.at(data, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        return part, bits, data.tobytes()

    def merge(batches) -> Iterator:
        import pyarrow as pa

        def out(row: tuple):
            columns = [pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "bits", "bitmap"])

        now, summary, sure, hashes, counts, held = None, None, [], [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != now:
                    if now is not None:
                        summary.merge(hashes, counts)
                        yield out(bitmap(now, summary, sure))
                    now, summary = row["part"], Summary(row["all"] // threshold + 1)
                    sure, hashes, counts, held = [], [], [], 0
                hashes.append(np.frombuffer(row["hashes"], np.uint32))
                counts.append(np.frombuffer(row["counts"], np.uint16).astype(np.int64))
                sure.append(np.frombuffer(row["sure"], np.uint32))
                held += len(hashes[-1])
                if held > 4 * summary.capacity + 100_000:
                    summary.merge(hashes, counts)
                    sure, hashes, counts, held = [np.unique(np.concatenate(sure))], [], [], 0
        if now is not None:
            summary.merge(hashes, counts)
            yield out(bitmap(now, summary, sure))

    masses = broadcast_if_small(sums.groupBy("part").agg(F.sum("mass").alias("all")), "masses")
    dealt = sums.join(masses, "part").select("part", "all", "hashes", "counts", "sure")
    dealt = dealt.repartition(n_parts, "part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(merge, "part int, bits int, bitmap binary"), "survivors").collect()


def _exact(rows: DataFrame, longest: int, threshold: int, known) -> DataFrame:
    """(lang, phrase, k, n): exact counts of the runs in the bitmaps; all words of a language as the phrase NULL of k = 0."""

    def out(counts: dict) -> Iterator:
        import pyarrow as pa

        items = list(counts.items())
        for at in range(0, len(items), 20_000):
            some = items[at : at + 20_000]
            phrase = [None if key[1] is None else key[1].decode("utf-8", "replace") for key, _ in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0] for key, _ in some], pa.string()), pa.array(phrase, pa.string()),
                 pa.array([key[2] for key, _ in some], pa.int32()), pa.array([n for _, n in some], pa.int64())],
                names=["lang", "phrase", "k", "n"],
            )

    def count(batches) -> Iterator:
        counts: dict = {}
        frequent = Bitmaps(*known.value)
        for batch in batches:
            for langs, words in _in_parts(batch, 4 * grams.PART_BYTES):
                names, number = np.unique(np.array(langs, object), return_inverse=True)
                number = number.astype(np.uint32)[words.text]
                for name, n in zip(names.tolist(), np.bincount(number, minlength=len(names)).tolist()):
                    counts[name, None, 0] = counts.get((name, None, 0), 0) + n
                raw = words.data.tobytes()
                for k, at, h in _runs(words, _tags(langs)[words.text], longest):
                    at = at[frequent.has(h)]
                    first, end, lang = words.first[at], words.end[at + k - 1], number[at]
                    table = grams.Table(words.data, first, end - first, lang)
                    of = table.owner
                    found = zip(lang[of].tolist(), first[of].tolist(), end[of].tolist(), table.count.tolist())
                    for name, a, b, n in found:
                        key = names[name], raw[a:b], k
                        counts[key] = counts.get(key, 0) + n
                if len(counts) > HELD_PHRASES:
                    yield from out(counts)
                    counts = {}
        yield from out(counts)

    each = rows.mapInArrow(count, "lang string, phrase string, k int, n long")
    return each.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= threshold))


def _both(one: list, other: list) -> list:
    """Bitmaps of two steps put together, by partition; the smaller one is repeated to the size of the larger."""
    from pyspark.sql import Row

    by_part: dict = {}
    for row in [*one, *other]:
        data = np.frombuffer(bytes(row.bitmap), np.uint8)
        if row.part in by_part:
            bits, held = by_part[row.part]
            size = max(len(held), len(data))
            data = np.tile(held, size // len(held)) | np.tile(data, size // len(data))
            by_part[row.part] = max(bits, row.bits), data
        else:
            by_part[row.part] = row.bits, data
    return [Row(part=p, bits=bits, bitmap=data.tobytes()) for p, (bits, data) in sorted(by_part.items())]


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, threshold: int = 30) -> DataFrame:
    """(lang, phrase, k, n): all phrases of 1 to ``longest`` words that occur ``threshold`` times or more in a language.

    One more row a language, phrase NULL and k = 0, counts all its words.
    """
    if not 1 < threshold < 1 << 16:
        raise ValueError("the threshold is 2 to 65,535")  # counts below it are sent as two bytes
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_parts = 1 + size // PARTITION_BYTES
    found = _survivors(_sums(rows, 1, min(2, longest), n_parts, threshold, None), n_parts, threshold)
    if longest > 2:
        pairs = Bitmaps.of(n_parts, found).sent(spark)
        found = _both(found, _survivors(_sums(rows, 3, longest, n_parts, threshold, pairs), n_parts, threshold))
    return written(_exact(rows, longest, threshold, Bitmaps.of(n_parts, found).sent(spark)), "phrases")


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, threshold: int = 30, inside: int = 80,
    top: int = 2000,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of the cut that scores lowest; the score is 2,000,000 a / (l + r),
    floored. Phrases inside a longer one that has ``inside`` per cent of their occurrences are left out.
    """
    known = frequent_phrases(docs, text, lang, longest, threshold)
    counts = known.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    candidate = known.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    longer = candidate.where("k > 2").select("lang", words.alias("w"), "k", "a")
    spans = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), p -> array_join(slice(w, p, s), ' '))))")
    holder = longer.select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left_out = _whole(F.col("held")) * 100 >= _whole(F.col("a")) * inside
    candidate = candidate.join(holder, ["lang", "phrase"], "left").where(~F.coalesce(left_out, F.lit(False))).drop("held")

    cuts = candidate.select("*", words.alias("w"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"),
        F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    all_words = known.where("k = 0").select("lang", "n")
    return (
        best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)  # tasks keep so many rows a language before they are shuffled
        .join(all_words, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


#: The same for DuckDB.
ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, [x FOR x IN string_split_regex(p, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM words, range(1, 5) t(k)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
f AS (SELECT lang, phrase, k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
holder AS (
  SELECT lang, phrase, max(f) AS held FROM (
    SELECT lang, f, unnest(flatten([[array_to_string(string_split(phrase, ' ')[p:p + s - 1], ' ')
      FOR p IN range(1, k - s + 2)] FOR s IN range(2, k)])) AS phrase FROM f WHERE k > 2) GROUP BY ALL),
candidate AS (
  SELECT f.lang, f.phrase, f.k, f.f AS a FROM f LEFT JOIN holder USING (lang, phrase)
  WHERE f.k > 1 AND NOT coalesce(CAST(held AS HUGEINT) * 100 >= CAST(f.f AS HUGEINT) * 80, false)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS head,
    array_to_string(string_split(c.phrase, ' ')[cut + 1:c.k], ' ') AS tail
  FROM candidate c, range(1, 4) t(cut) WHERE cut < c.k),
scored AS (
  SELECT cuts.*, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
