"""Mixing sources, importance resampling and collocations: edge cases, and brute force where there is one."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millwright.llm import collocations, grams, importance_resampling, queries, source_mixing

LOWER = {i: i + 32 for i in range(65, 91)}
FOLDER = "/root/testdata/sf0.001"


def lorem(seed, n, size=400, word="w"):
    rng = np.random.default_rng(seed)
    return " ".join(f"{word}{int(x)}" for x in rng.zipf(1.3, n) % size)


# --- the table of slices -----------------------------------------------------------------------------------------


def slices(seed, letters, longest, n=4000):
    rng = np.random.default_rng(seed)
    data = np.concatenate([rng.integers(97, 97 + letters, 6000).astype(np.uint8), np.zeros(8, np.uint8)])
    length = rng.integers(0, longest, n)
    return data, rng.integers(0, 6000 - longest, n), length


def test_hashes_equal_the_libraries():
    data, first, length = slices(1, 26, 200)
    for seed in (0, 5):
        got = grams.xxhash64(data, first, length, seed)
        assert all(xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) == int(x) for a, n, x in zip(first, length, got))
    got = grams.crc32(data, first, length)
    assert all(zlib.crc32(data[a : a + n].tobytes()) == int(x) for a, n, x in zip(first, length, got))


def test_table_keeps_unlike_slices_apart(monkeypatch):
    data, first, length = slices(2, 2, 7)
    tag = np.random.default_rng(3).integers(0, 2, len(first)).astype(np.uint32)
    want = Counter((data[a : a + n].tobytes(), int(t)) for a, n, t in zip(first, length, tag))
    for bad_hash in (False, True):
        if bad_hash:  # all slices meet in the same places: only the bytes tell them apart
            monkeypatch.setattr(grams, "xxhash64", lambda data, first, length: np.zeros(len(first), np.uint64))
        table = grams.Table(data, first, length, tag)
        got = Counter()
        for owner, n in zip(table.owner, table.count):
            got[data[first[owner] : first[owner] + length[owner]].tobytes(), int(tag[owner])] += int(n)
        assert got == want and len(table.owner) == len(want)
        assert all(length[i] == length[table.owner[s]] for i, s in enumerate(table.slots))
    assert len(grams.Table(data, first[:0], length[:0]).owner) == 0


# --- importance resampling -----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_scores(docs, target, buckets=10_000):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(zlib.crc32(f.encode()) % buckets for f in features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for key, text in docs:
        n_words, found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in (zlib.crc32(f.encode()) % buckets for f in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = len(able) * 25 // 100
    ranks = defaultdict(list)
    for i, r in enumerate(able):
        ranks[r].append(i + 1 if i < drawn else None)
    return Counter((r[0], r[2], r[3], r[4], ranks[r].pop() if r[1] >= 20 else None) for r in rows)


def test_resampling_equals_brute_force(spark):
    docs = [(i, lorem(i, 15 + i)) for i in range(60)] + [(100, None), (101, ""), (102, "..!"), (None, lorem(5, 30)), (None, lorem(6, 30))]
    docs += [(103, "Ünï Cödé " * 20), (104, lorem(7, 30_000, 5000)), (105, lorem(9, 40)), (105, lorem(9, 40)), (106, "x" * 5000)]
    target = [lorem(3, 200), None, "", "Ünï cödé"]
    clash = [(k, t, "a", 1) for k, t in docs]
    frame = spark.createDataFrame(clash, "doc_id long, text string, rank string, key int")
    got = importance_resampling.scores(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(f.dataType.simpleString() == "bigint" for f in got.schema)
    assert Counter(map(tuple, got.collect())) == brute_scores(docs, target)
    drawn = importance_resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert drawn.columns == frame.columns
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got.where("rank is not null").collect()}


def test_resampling_prefers_what_is_like_the_target(spark):
    docs = [(i, lorem(i, 60, word="good" if i % 4 == 0 else "bad")) for i in range(400)]
    target = spark.createDataFrame([(lorem(1000 + i, 60, word="good"),) for i in range(20)], "text string")
    got = importance_resampling.scores(spark.createDataFrame(docs, "doc_id long, text string"), target)
    drawn = [r.doc_id % 4 == 0 for r in got.where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(drawn) > 60


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, lorem(1, 30)), (2, "a b")], "doc_id long, text string")
    assert importance_resampling.scores(none, some).count() == 0
    assert Counter(map(tuple, importance_resampling.scores(some, none).collect())) == brute_scores([(1, lorem(1, 30)), (2, "a b")], [])


# --- collocations ------------------------------------------------------------------------------------------------


def brute_collocations(docs, threshold=30, inside=80, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    phrases = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= threshold}
    out = defaultdict(list)
    held = Counter()
    for (lang, w), a in phrases.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = lang, w[i : i + k]
                held[part] = max(held[part], a)
    for (lang, w), a in phrases.items():
        if 100 * held[lang, w] >= inside * a:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))
        )
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, rows in out.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top])
    )


def text_of(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{int(x)}" for x in rng.zipf(1.5, 300) % 60]
    words[50:53] = ["New", "York", "City"]
    words[150:152] = ["São", "Paulo\t"]
    return "".join(w + (". " if rng.random() < 0.1 else "\r\n" if rng.random() < 0.02 else "  ") for w in words)


COLLOCATED = [("en" if i % 3 else None, text_of(i)) for i in range(40)] + [("und", text_of(99)), ("de", None), ("de", ""), ("de", "!?")]
COLLOCATED += [("fr", "a b " * 400), ("fr", "x" * 40_000 + " y"), ("en", "\x01 \x01 " * 20), ("", "z z z z z z")]


@pytest.mark.parametrize("threshold", [2, 5, 30])
def test_collocations_equal_brute_force(spark, threshold):
    frame = spark.createDataFrame([(lang, text, 1, "x") for lang, text in COLLOCATED], "lang string, text string, n int, phrase string")
    got = collocations.collocations(frame, threshold=threshold)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(COLLOCATED, threshold)


def test_collocations_with_little_room(spark, monkeypatch):
    """Many hash partitions, sums handed on early, full bitmaps, and a short list: the result stays the same."""
    monkeypatch.setattr(collocations, "PARTITION_BYTES", 2_000)
    monkeypatch.setattr(collocations, "HELD", 2_000)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 100)
    monkeypatch.setattr(collocations, "BITMAP_BYTES", 600)
    frame = spark.createDataFrame(COLLOCATED, "lang string, text string").repartition(5)
    got = collocations.collocations(frame, threshold=5, top=10)
    assert sorted(map(tuple, got.collect())) == brute_collocations(COLLOCATED, 5, top=10)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "lang string, text string"), threshold=70_000)


@pytest.mark.parametrize("seed", range(5))
def test_summaries_lose_nothing_frequent(seed):
    rng = np.random.default_rng(seed)
    items = (rng.zipf(1.2, 60_000) % 30_000).astype(np.uint32)
    true, threshold = Counter(items.tolist()), 30
    summary = collocations.Summary(len(items) // threshold + 1)
    for part in np.array_split(items, 40):
        h, c = np.unique(part, return_counts=True)
        summary.merge([h], [c.astype(np.int64)])
        assert len(summary.hashes) <= summary.capacity
    assert summary.error < threshold
    assert {h for h, n in true.items() if n >= threshold} <= set(summary.survivors(threshold).tolist())


# --- mixing sources ----------------------------------------------------------------------------------------------


def sizes_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


MIXED = [(i, f" {lorem(i, 30 + i)}\n", "big" if i % 3 else f"s{i % 7}") for i in range(120)]
MIXED += [(500, "one two\x0bthree\x0cfour\xa0five", None), (501, None, "s1"), (501, "", "s1"), (501, "", "s1"), (None, lorem(1, 40), "s2")]
MIXED += [(502, lorem(2, 50), "s2"), (502, lorem(2, 50), "s2"), (502, lorem(3, 50), "s2"), (503, lorem(4, 20_000), "é"), (504, "  ", "empty")]


def mixed(spark, rows=None, **settings):
    rows = MIXED if rows is None else rows
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, block string")
    return frame, source_mixing.mix(frame, **settings)


def test_targets():
    assert [float(t) for t in source_mixing.targets([100, 100, 100])] == [187.5, 75.0, 37.5]
    assert [float(t) for t in source_mixing.targets([10, 500, 490])] == [30.0, 1940 / 3, 970 / 3]  # the first stops at 30
    assert source_mixing.targets([]) == [] and source_mixing.targets([0, 0]) == [0, 0]
    found = source_mixing.targets([1, 2, 3, 1000, 0, 7])
    assert sum(found) == 1013 and all(t <= 3 * n for t, n in zip(found, [1, 2, 3, 1000, 0, 7]))


@pytest.mark.parametrize("count", [1, 2, 3, 17, 256, 1000])
def test_permutations_are_one_to_one(spark, count):
    n = F.lit(count).cast("long")
    numbers = spark.range(count).withColumn("rounds", source_mixing.rounds(3, F.lit(7), count=n))
    moved = numbers.select("id", source_mixing.permuted(F.col("id"), n, F.col("rounds")).alias("x"))
    found = [r.x for r in moved.orderBy("id").collect()]
    assert sorted(found) == list(range(count))
    if count > 200:  # no trend is left
        assert abs(np.corrcoef(range(count), found)[0, 1]) < 0.2


def test_mix_meets_targets_and_bounds(spark):
    frame, made = mixed(spark)
    rows = source_mixing.shares(made).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((k, sizes_of(t)) for k, t, _ in MIXED)
    names = sorted({s for _, _, s in MIXED if s is not None}) + [None]
    assert made.names == names
    assert made.sizes == [sum(sizes_of(t) for _, t, s in MIXED if s == name) for name in names]
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    for size, target in zip(made.sizes, map(float, made.targets)):
        assert abs(taken[size, target] - target) <= 2 * made.block
    slots = made.slots.collect()
    assert Counter(r.source_no for r in slots) == Counter({i: n for i, n in enumerate(made.n_slots) if n})
    assert sorted(r.slot for r in slots) == list(range(sum(made.n_slots)))
    by_pass = Counter((r.source_no, r["pass"], r.block) for r in slots)
    assert max(by_pass.values()) == 1 and all(0 <= b < made.n_blocks[s] for s, _, b in by_pass)


def test_mix_hands_out_the_words(spark):
    """What the slots hold, word by word, is what the shares count."""
    rows = [r for r in MIXED if r[0] not in (501, 502)]
    frame, made = mixed(spark, rows)
    text = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t, _ in rows}
    taken, per_slot = Counter(), Counter()
    for r in source_mixing.texts(made, frame).collect():
        taken[r.doc_id] += len(r.words)
        per_slot[r.slot] += len(r.words)
        joined, whole = " ".join(r.words), " ".join(text[r.doc_id])
        assert r.words and f" {joined} " in f" {whole} "
    assert max(per_slot.values()) == made.block and len(per_slot) == sum(made.n_slots)
    assert all(taken[r.doc_id] == r.taken for r in source_mixing.shares(made).collect())


def test_mix_is_the_same_again(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "SHARD", 50)  # many shards: counts differ by shard, totals do not
    frame, made = mixed(spark)
    want = Counter(map(tuple, source_mixing.shares(made).collect()))
    shards = defaultdict(Counter)
    for r in made.slots.collect():
        shards[r.shard][r.source_no] += 1
    assert len(shards) > 5 and len({frozenset(c.items()) for c in shards.values()}) > 3
    again = source_mixing.mix(frame.repartition(7))
    assert Counter(map(tuple, source_mixing.shares(again).collect())) == want


def test_mix_of_nothing(spark, monkeypatch):
    for rows in ([], [(1, None, "a"), (2, "", None)]):
        _, made = mixed(spark, rows)
        found = source_mixing.shares(made)
        assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert sorted(map(tuple, found.collect())) == [(k, 0, 0, 0.0, 0) for k, _, _ in rows]
    monkeypatch.setattr(source_mixing, "MAX_SOURCES", 3)
    with pytest.raises(ValueError):
        mixed(spark)


def test_mixing_query(spark):
    """Sources by code point weigh 5, 2, 1 and share all words; no Python worker in the plan."""
    docs = queries.table(spark, FOLDER, "documents")
    found = queries.op11_source_mixing(spark, FOLDER)
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    rows = {r.doc_id: r for r in found.collect()}
    size, taken = Counter(), Counter()
    for r in docs.collect():
        assert rows[r.doc_id]["size"] == sizes_of(r.text)
        size[r.source] += sizes_of(r.text)
        taken[r.source] += rows[r.doc_id].taken
    assert len(rows) == docs.count()
    target = {r.source: rows[r.doc_id].target for r in docs.collect()}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    names = sorted(target)
    free = [i for i, s in enumerate(names) if target[s] < 3 * size[s] - 1e-6]
    per_weight = {round(target[names[i]] / (5, 2, 1)[i % 3], 6) for i in free}
    assert len(per_weight) == 1 and all(target[s] <= 3 * size[s] for s in names)
    assert all(abs(taken[s] - target[s]) <= 64 for s in names)
