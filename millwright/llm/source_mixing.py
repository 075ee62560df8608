"""Mixing sources to target weights: how often which words of which document a training mix takes.

The words of a source, its documents in the order of their keys, form one stream that is packed into blocks of
``block`` words (its last block may be shorter). The mix has as many slots as the targets need, in shards of
``SHARD`` slots. Every slot draws its source by a seeded hash, so the counts of a shard are a multinomial draw; what the
draws of all shards have over a source's quota goes to the sources that lack slots, so the mix meets its targets to
within a block a source. The n-th slot of a source is mapped through a pseudorandom permutation of the source's block
numbers, another one for each pass over the source (swap-or-not: every round reflects a number at a hashed point or
leaves it, which is one-to-one for any count and needs no table), and slots meet documents by block number.

Whole passes take every block once; only a last, partial pass chooses. No source is passed more than ``most`` times, so
no document is taken more often than that. All is decided by hashes of numbers: reruns, retried tasks and other
partitionings give the same mix.

Cases: a NULL or empty text has no words and is taken 0 times. A NULL source is one of its own, the last. NULL keys come
first in a stream. Rows of equal key, source and size are counted together and laid out one after another; which of
them takes which place is not told, as nothing tells them apart. Empty tables give no rows. The input's other columns
are not looked at, whatever their names. There may be ``MAX_SOURCES`` sources; more raise a ValueError, as their list comes
to the driver. A document is dealt to its blocks, so neither a long document nor a large source is one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import written
from millwright.operators.ordering import running_total

#: Slots of a shard.
SHARD = 65_536
MAX_SOURCES = 1_000
#: Rounds of the permutation: each moves a number to a random place with one half.
ROUNDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> list[Fraction]:
    """Shares of the sum of ``sizes`` by weight (repeating), none above ``most`` sizes; the excess is shared again."""
    out, left = [Fraction(0)] * len(sizes), Fraction(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    rest = list(range(len(sizes)))
    while rest:
        all_weights = sum(weight[i] for i in rest)
        over = [i for i in rest if left * weight[i] > most * sizes[i] * all_weights]
        for i in over or rest:
            out[i] = Fraction(most * sizes[i]) if over else left * weight[i] / all_weights
        if not over:
            break
        left -= sum(out[i] for i in over)
        rest = [i for i in rest if i not in set(over)]
    return out


@dataclass(frozen=True)
class Mix:
    """The sources in order, with their words, targets, blocks and slots; and the documents by source.

    ``docs``: (source_no, key, size, copies, start): equal rows together, ``start`` counts words within the source.
    ``slots``: (slot, shard, source_no, pass, block) of the mix.
    """

    names: list
    sizes: list[int]
    targets: list[Fraction]
    n_blocks: list[int]
    n_slots: list[int]
    docs: DataFrame
    slots: DataFrame
    block: int

    def spans(self) -> DataFrame:
        """(source_no, start, key, size, block, words, first_word): the blocks that each document reaches into.

        ``first_word`` counts the document's words from 0. Copies are laid out one by one; documents without words have none.
        """
        places = F.explode(F.expr("transform(sequence(0L, copies - 1), c -> start + c * size)"))
        each = self.docs.where("size > 0").select("source_no", "key", "size", places.alias("start"))
        block, end = F.lit(self.block), F.col("start") + F.col("size")
        reach = F.expr(f"sequence(start div {self.block}, (start + size - 1) div {self.block})")
        first = F.greatest("start", F.col("block") * block)
        return each.select("*", F.explode(reach).alias("block")).select(
            "source_no", "start", "key", "size", "block",
            (F.least(end, (F.col("block") + 1) * block) - first).alias("words"),
            (first - F.col("start")).alias("first_word"),
        )


def _at(values: list, place: Column) -> Column:
    """The element of a list of one number a source."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), place + 1)


def rounds(seed: int, *key: Column, count: Column) -> Column:
    """What the rounds of a permutation of ``count`` numbers need: the point that each reflects at, and its salt."""

    def one(r: Column) -> Column:
        point = F.pmod(F.xxhash64(F.lit(seed), F.lit("point"), r, *key), F.greatest(count, F.lit(1).cast("long")))
        return F.struct(point.alias("point"), F.xxhash64(F.lit(seed), F.lit("salt"), r, *key).alias("salt"))

    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), one)


def permuted(number: Column, count: Column, steps: Column) -> Column:
    """``number`` (0.. below ``count``) moved by the permutation whose ``rounds`` are given."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r["point"] - x, count)
        return F.when(F.xxhash64(r["salt"], F.greatest(x, other)) < 0, other).otherwise(x)

    return F.aggregate(steps, number, step)


def _slots(spark, n_slots: list[int], n_blocks: list[int], seed: int) -> DataFrame:
    """(slot, shard, source_no, pass, block): which block each slot of the mix holds."""
    total, sources = sum(n_slots), range(len(n_slots))
    bounds = [sum(n_slots[: i + 1]) for i in sources]
    drawn_at = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "slot"), F.lit(max(1, total)))
    drawn = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds[:-1]] or [F.lit(None).cast("long")]), lambda b: b <= drawn_at))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {SHARD}").alias("shard")).withColumn("source_no", drawn)
    counts = written(slots.groupBy("shard", "source_no").agg(F.count("*").alias("n")), "draws")
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "source_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    found = {r.source_no: r.n for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    have = [found.get(i, 0) for i in sources]

    # What a source has over its quota is numbered through all sources and goes to those that lack slots, in order.
    over, lack = [max(0, have[i] - n_slots[i]) for i in sources], [max(0, n_slots[i] - have[i]) for i in sources]
    over_before, lack_upto = [sum(over[:i]) for i in sources], [sum(lack[: i + 1]) for i in sources]
    lack_before = [sum(lack[:i]) for i in sources]
    in_shard = Window.partitionBy("shard", "source_no").orderBy("slot")
    numbered = slots.withColumn("place", F.row_number().over(in_shard)).join(before, ["shard", "source_no"])
    own = F.col("place") + F.col("before") - 1
    spare = _at(over_before, F.col("source_no")) + F.col("own") - _at(n_slots, F.col("source_no"))
    taker = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in lack_upto]), lambda b: b <= F.col("spare")))
    moved = _at(have, F.col("taker")) + F.col("spare") - _at(lack_before, F.col("taker"))
    keeps = F.col("own") < _at(n_slots, F.col("source_no"))
    dealt = (
        numbered.withColumn("own", own)
        .withColumn("spare", F.when(~keeps, spare))
        .withColumn("taker", F.when(~keeps, taker))
        .select(
            "slot", "shard",
            F.when(keeps, F.col("source_no")).otherwise(F.col("taker")).alias("source_no"),
            F.when(keeps, F.col("own")).otherwise(moved).alias("own"),
        )
    )
    numbers = dealt.withColumn("count", _at(n_blocks, F.col("source_no"))).select(
        "slot", "shard", "source_no", "count", F.expr("own div count").alias("pass"), F.expr("own % count").alias("number")
    )
    passes = [(i, p, n_blocks[i]) for i in sources for p in range(-(-n_slots[i] // max(1, n_blocks[i])))]
    orders = spark.createDataFrame(passes, "source_no int, pass long, of long")  # a row for each pass over a source
    orders = orders.select("source_no", "pass", rounds(seed, F.col("source_no"), F.col("pass"), count=F.col("of")).alias("rounds"))
    return numbers.join(F.broadcast(orders), ["source_no", "pass"]).select(
        "slot", "shard", "source_no", "pass", permuted(F.col("number"), F.col("count"), F.col("rounds")).alias("block")
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 32, seed: int = 11,
) -> Mix:
    """The mix of all ``docs`` whose sources, in the order of their names' code points, have the weights."""
    spark = docs.sparkSession
    # One character stands for every run of blanks: a text has a word more than blanks between its ends.
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    size = F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size.cast("long").alias("size"))
    sized = written(rows.groupBy("source", "key", "size").agg(F.count("*").alias("copies")), "sizes")
    found = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    found = found.orderBy(F.asc_nulls_last("source")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names, sizes = [r.source for r in found], [int(r.words) for r in found]
    goal = targets(sizes, weights, most)
    n_blocks = [-(-n // block) for n in sizes]
    n_slots = []
    for n, blocks, words in zip(sizes, n_blocks, goal):
        whole = int(words / n) if n else 0
        n_slots.append(whole * blocks + (min(blocks, round((words - whole * n) / block)) if n else 0))

    no = spark.createDataFrame([(i, name) for i, name in enumerate(names)], "source_no int, name string")
    numbered = sized.join(F.broadcast(no), sized["source"].eqNullSafe(no["name"])).select(
        "source_no", "key", "size", "copies", (F.col("size") * F.col("copies")).alias("words")
    )
    # Words before a source are known, so one running total over all sources numbers the words of each.
    upto = running_total(numbered, ["source_no", "key", "size"], "words", "upto")
    start = F.col("upto") - F.col("words") - _at([sum(sizes[:i]) for i in range(len(sizes))] or [0], F.col("source_no"))
    laid = written(upto.select("source_no", "key", "size", "copies", start.alias("start")), "laid")
    slots = _slots(spark, n_slots, n_blocks, seed) if sum(n_slots) else spark.createDataFrame(
        [], "slot long, shard long, source_no int, pass long, block long"
    )
    return Mix(names, sizes, goal, n_blocks, n_slots, laid, slots, block)


def shares(made: Mix, key: str = "doc_id") -> DataFrame:
    """Every document's key, size, source_size, target and taken words."""
    spark = made.docs.sparkSession
    times = made.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = (
        made.spans().join(times, ["source_no", "block"], "left")
        .groupBy("source_no", "start")
        .agg(F.first("key").alias("key"), F.first("size").alias("size"), F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("source_no", "key", "size", "taken")
    )
    without = made.docs.where("size = 0").select(
        "source_no", "key", "size", F.lit(0).cast("long").alias("taken"), F.explode(F.expr("sequence(1L, copies)"))
    )
    sources = spark.createDataFrame(
        [(i, n, float(t)) for i, (n, t) in enumerate(zip(made.sizes, made.targets))], "source_no int, source_size long, target double"
    )
    rows = taken.unionByName(without.select("source_no", "key", "size", "taken")).join(F.broadcast(sources), "source_no")
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", "taken")


def texts(made: Mix, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, slot, place, key, words): the words of every slot, document after document. Keys must tell documents apart."""
    words = docs.select(F.col(key).alias("key"), F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)).alias("all"))
    spans = made.spans().select("source_no", "block", "key", "start", "first_word", "words").alias("s")
    cut = spans.join(words.alias("w"), F.col("s.key").eqNullSafe(F.col("w.key"))).select(
        "source_no", "block", "start", F.col("s.key").alias("key"),
        F.slice("all", (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")).alias("words"),
    )
    return made.slots.join(cut, ["source_no", "block"]).select("shard", "slot", F.col("start").alias("place"), F.col("key").alias(key), "words")
