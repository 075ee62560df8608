"""Jaccard self-join on word shingles through a MinHash LSH forest, with exact verification.

Every distinct shingle set gets ``trees * depth`` MinHash labels, ``depth`` for each tree: its path in a prefix trie. Sets
that share a trie node at some depth are candidates. The join begins with whole paths, and shortens the prefix level by
level: at each level it takes the pairs whose longest common prefix in any tree has just that length, in the first tree
that has it, so a pair is looked at once. All candidates are verified on their full shingle sets. From the similarities of the links found so
far the links missed are estimated, each found one standing for 1 / (chance to find it), with three imagined links at
the threshold added. Shortening ends when the estimated recall reaches the target, or at the level where even
a pair at the threshold is found with that chance.

Equal sets are joined before and count with their multiplicity. The members of a large trie node are dealt by hash into blocks;
two blocks meet in a task, which hands on one packed row, so neither pairs nor node members are ever rows of their own kind in one place, and
no pair is left out. Results are one row a document: class (connected group; its smallest key) and number of links.

Cases: a NULL or empty text, or one without words, has no shingles, no links and a class of its own. Texts of fewer
words than a shingle are one shingle. Equal texts, and repeated rows, link to one another. A NULL key is allowed: it never names a
class that has another key. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import broadcast_if_small, components, looked_up, written
from millwright.llm.shingles import Shingler, factors, min_hashes

TREES, DEPTH = 20, 6
RECALL = 0.9999
#: Sets in a block; two blocks meet in a task, some 100 MB at worst for texts of common length.
BLOCK = 1024
BINS = 20


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That two sets share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def sketches(docs: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(doc, id, size, sig): id names the shingle set, sig are its labels; both NULL without shingles."""

    def run(batches):
        shingler, by = Shingler(n), factors(TREES * DEPTH)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = shingler.sets(part.column(1).to_pylist())
                full = [k for k, s in enumerate(sets) if len(s)]
                labels = min_hashes([sets[k] for k in full], by).astype(">u4") if full else []
                ids, sigs = [None] * len(sets), [None] * len(sets)
                for k, row in zip(full, labels):
                    ids[k], sigs[k] = _set_id(sets[k]), row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary())],
                    ["doc", "id", "size", "sig"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, f"doc {kind}, id binary, size int, sig binary"
    )


def _set_id(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _groups(batches, column: int = 0):
    """Rows of equal value in a sorted column, as tables; only one group's rows are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and held[-1].column(column)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _node(tree: int, depth: int):
    return F.xxhash64(F.lit(tree), F.substring("sig", 4 * DEPTH * tree + 1, 4 * depth))


def _forest(sets: DataFrame, depth: int) -> DataFrame:
    """(id, trees): the sets that share a node of this depth, and in which trees; a set is one row."""
    nodes = F.array(*[F.struct(F.lit(t).alias("tree"), _node(t, depth).alias("node")) for t in range(TREES)])
    rows = sets.select("id", F.explode(nodes).alias("at")).select("id", "at.tree", "at.node")
    shared = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(shared, "node").groupBy("id").agg(F.collect_list("tree").alias("trees"))


def _candidates(members: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """(cell, ids, left, right): candidate pairs of this depth, as places in ids, a row for each two blocks of a node."""
    node = F.lit(None).cast("long")
    for t in range(TREES):
        node = F.when(F.col("tree") == t, _node(t, depth)).otherwise(node)
    rows = members.join(sets.select("id", "sig"), "id").select("id", "sig", F.explode("trees").alias("tree"))
    rows = rows.select("id", "sig", "tree", node.alias("node"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), "id"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    dealt = rows.join(sizes, "node").select("id", "sig", "tree", "node", mine.alias("mine"), other)
    cells = dealt.select(
        F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"),
        "tree", (F.col("mine") == F.col("other")).alias("inner"), (F.col("mine") > F.col("other")).alias("second"), "id", "sig",
    )

    def run(batches):
        for table in _groups(batches):
            found = _pairs(table, depth)
            if found:
                yield found

    return (
        cells.repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(run, "cell long, ids array<binary>, left binary, right binary")
    )


def _pairs(table: pa.Table, depth: int):
    """The pairs of one cell whose longest common prefix has this length, and first has it in the cell's tree."""
    if table.num_rows < 2:
        return None
    ids, tree = table.column("id").to_pylist(), table.column("tree")[0].as_py()
    inner = table.column("inner")[0].as_py()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), ">u4").astype(np.uint64).reshape(len(ids), TREES, DEPTH)
    code, codes = np.zeros(sig.shape[:2], np.uint64), []
    for d in range(DEPTH):
        code = code * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d] + np.uint64(1)
        codes.append(code)
    here = codes[depth - 1]
    deeper = codes[depth] if depth < DEPTH else None
    second = np.array(table.column("second").to_pylist())
    rows = np.arange(len(ids)) if inner else np.flatnonzero(~second)
    columns = np.arange(len(ids)) if inner else np.flatnonzero(second)
    left, right = [], []
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        same = here[part][:, None, :] == here[columns][None, :, :]
        ok = same[:, :, tree] & ~same[:, :, :tree].any(axis=2)
        if deeper is not None:
            ok &= ~(deeper[part][:, None, :] == deeper[columns][None, :, :]).any(axis=2)
        if inner:
            ok &= part[:, None] < columns[None, :]
        a, b = np.nonzero(ok)
        left.append(part[a])
        right.append(columns[b])
    left, right = np.concatenate(left), np.concatenate(right)
    if not len(left):
        return None
    used, places = np.unique(np.r_[left, right], return_inverse=True)
    left, right = places[: len(left)].astype("<u2"), places[len(left) :].astype("<u2")
    return pa.RecordBatch.from_arrays(
        [
            table.column("cell").combine_chunks().slice(0, 1),
            pa.array([[ids[k] for k in used]], pa.list_(pa.binary())),
            pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()),
        ],
        ["cell", "ids", "left", "right"],
    )


def _verified(found: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, threshold: float, n: int) -> DataFrame:
    """(id, links, root) of sets with links in a cell, and per cell a row (NULL, ..., histogram of similarities)."""
    members = found.select("cell", F.posexplode("ids").alias("place", "id"))
    wanted = members.select("id").distinct().join(sets.select("id", "doc"), "id")
    texts = looked_up(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), wanted.select("doc").distinct(), "doc")

    def hashed(batches):
        shingler = Shingler(n)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                values = [s for s in shingler.sets(batch.column(1).slice(i, 200).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(s) for s in values], pa.binary()), pa.array([s.tobytes() for s in values], pa.binary())],
                    ["id", "items"],
                )

    # A key may stand for several texts; the set's own name tells them apart, and equal sets are needed once.
    items = texts.mapInArrow(hashed, "id binary, items binary").dropDuplicates(["id"])
    # A set meets its items once, with all its places, and goes to its cells from there.
    placed = members.groupBy("id").agg(F.collect_list(F.struct("cell", "place")).alias("places"))
    rows = placed.join(items, "id").join(sets.select("id", "copies"), "id").select("*", F.explode("places").alias("at")).select(
        "at.cell", "at.place", "id", "copies", "items", F.lit(None).cast("binary").alias("left"), F.lit(None).cast("binary").alias("right")
    )
    heads = found.select(
        "cell", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("copies"),
        F.lit(None).cast("binary").alias("items"), "left", "right",
    )

    def run(batches):
        for table in _groups(batches):
            yield _links(table, threshold)

    return (
        rows.union(heads).repartition("cell").sortWithinPartitions("cell", "place")
        .mapInArrow(run, "id binary, links long, root binary, histogram array<long>")
    )


def _links(table: pa.Table, threshold: float) -> pa.RecordBatch:
    left = np.frombuffer(table.column("left")[0].as_py(), "<u2").astype(np.int64)
    right = np.frombuffer(table.column("right")[0].as_py(), "<u2").astype(np.int64)
    ids = table.column("id").to_pylist()[1:]
    copies = table.column("copies").to_numpy()[1:]
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()[1:]]
    sizes = np.array([len(x) for x in items])
    shared = _shared(items, left, right)
    similar = shared / (sizes[left] + sizes[right] - shared)
    # Compared as whole numbers of a million, so that no rounding decides.
    ok = shared * 1_000_000 >= round(threshold * 1_000_000) * (sizes[left] + sizes[right] - shared)
    left, right, similar = left[ok], right[ok], similar[ok]
    links = np.bincount(left, copies[right], len(ids)) + np.bincount(right, copies[left], len(ids))
    root = np.arange(len(ids))
    while True:  # the smallest place spreads over all links
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(links > 0).tolist()
    bins = np.clip(((similar - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1) if threshold < 1 else np.zeros(len(similar), int)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*[ids[k] for k in linked], None], pa.binary()),
            pa.array([*[int(links[k]) for k in linked], 0], pa.int64()),
            pa.array([*[ids[root[k]] for k in linked], None], pa.binary()),
            pa.array([*[None] * len(linked), np.bincount(bins, minlength=BINS).tolist()], pa.list_(pa.int64())),
        ],
        ["id", "links", "root", "histogram"],
    )


def _shared(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many items the sets of each pair share."""
    if len(left) <= 3 * len(items):
        return np.array([len(np.intersect1d(items[a], items[b], assume_unique=True)) for a, b in zip(left, right)], np.int64)
    sizes = [len(x) for x in items]
    _, places, counts = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(items)), sizes)
    often = counts[places] > 1
    column = (np.cumsum(counts > 1) - 1)[places[often]]
    owner = owner[often]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(items), len(items)), np.float32)
    width = 4096
    for first in range(0, int((counts > 1).sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(items), width), np.float32)
        block[owner[a:b], column[a:b] - first] = 1
        total += block @ block.T
    return np.rint(total[left, right]).astype(np.int64)


def join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5, recall: float = RECALL
) -> DataFrame:
    """(key, class_id, n_links): every row of ``docs``, its group and how many other rows it is linked to."""
    docs = docs.select(key, text)
    sketch = written(sketches(docs, key, text, n), "sketches")
    sets = written(
        sketch.where("id is not null").groupBy("id").agg(
            F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("sig").alias("sig")
        ),
        "sets",
    )
    floor = max([1, *[d for d in range(1, DEPTH + 1) if chance(threshold, d) >= recall]])
    members = written(_forest(sets, floor), "forest")
    rounds, histogram = [], np.zeros(BINS)
    for depth in range(DEPTH, floor - 1, -1):
        found = written(_candidates(members, sets, depth), "candidates")
        checked = written(_verified(found, sets, docs, key, text, threshold, n), "verified")
        sums = [F.sum(F.col("histogram")[k]).alias(f"b{k}") for k in range(BINS)]
        histogram += np.array([x or 0 for x in checked.agg(*sums).first()], float)
        rounds.append(checked.where("id is not null").select("id", "links", "root"))
        if _estimated_recall(histogram, depth, threshold) >= recall:
            break
    links = rounds[0]
    for more in rounds[1:]:
        links = links.union(more)
    groups = components(links, "id", "root").withColumnRenamed("node", "id")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    each = sets.select("id", "doc", "copies").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = each.groupBy("root").agg(F.min("doc").alias("class_id"))
    result = (
        each.join(classes, "root").join(counts, "id", "left")
        .select("id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return sketch.select("doc", "id").join(result, "id", "left").select(
        F.col("doc").alias(key),
        F.when(F.col("id").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _estimated_recall(histogram: np.ndarray, depth: int, threshold: float) -> float:
    """The smaller of the recall of all links and that of the least similar links found: one large group of very similar
    texts does not end the search for the others."""
    at = threshold + (1 - threshold) * np.arange(BINS) / BINS
    p = np.array([chance(s, depth) for s in at])
    missed = (histogram * (1 - p) / p).sum() + 3 * (1 - p[0]) / p[0]
    lowest = p[np.flatnonzero(histogram)[:1]].sum()
    return float(min(histogram.sum() / (histogram.sum() + missed), lowest))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest key. All columns stay.

    Rows that share that key are one document, and all stay; a row without a key stays.
    """
    joined = join(docs, key, text, threshold)
    gone = joined.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone")).distinct()
    gone = broadcast_if_small(gone, "gone")
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
