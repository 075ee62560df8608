"""A forest for many rows: the trees that Spark ML's random forest grows, counted by numpy in tasks.

Spark's forest keeps some 600 bytes a row and walks through objects. Here a row is kept as one byte an input: twice the
number of the input's bin, and the label. All else is the same work: every tree sees every row, as often as a Poisson draw
of mean 1 says; each level adds up, for every node that still grows, the labels by bin of ceil(sqrt(inputs)) inputs drawn for
the node; the cut of most Gini gain wins; leaves have two rows at least; two leaves that say the same become one, as Spark
does. Categories are cut in the order of their share of ones. Candidate cuts are made as Spark makes them: between the values
of a seeded sample of rows, all of them where there are few, else at equal shares. Only the cuts come from a sample; every row is
binned and counted. The sample here is of 100,000 rows, Spark's of 10,000. The result is a model of Spark ML, so it is saved, loaded and read like any other.

A draw hangs on the seed, the tree, and the row's block and place in it, so it is made again on every level instead of kept, and so
is a row's way down to its node. Nothing is kept beside the blocks, and a level ships only the counts of a task by tree.

Poisson shares are rounded to 1 / 65,536. A row without an input or label is an error, as it is to Spark's assembler.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import settle

# Functions that run in tasks travel with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Rows of a block: what a step works on stays in a core's own cache.
BLOCK = 65_536
#: Rows of a task, at most: 40 MB of bins.
TASK_ROWS = 4_000_000
SAMPLE = 100_000
#: Values a byte of a row can have: a bin and a label.
CELLS = 2 * BINS

#: What is chosen for a node: input (-1: none), bins that go left, gain, and the labels on the left and in all.
CHOICE = np.dtype([("feature", "i1"), ("left", "u4"), ("gain", "f8"), ("l0", "f8"), ("l1", "f8"), ("n0", "f8"), ("n1", "f8")])


# --- bins -----------------------------------------------------------------------------------------


def candidate_cuts(values: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """Cuts between distinct values: between all of them, or at equal shares of the rows where they are many."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) <= most:
        return between
    stride = len(values) / (most + 1)
    wanted, cuts, before = stride, [], 0
    for cut, upto in zip(between.tolist(), np.cumsum(counts).tolist()):
        if before and abs(before - wanted) < abs(upto - wanted):
            cuts.append(last)
            wanted += stride
        before, last = upto, cut
    if abs(before - wanted) < abs(len(values) - wanted):
        cuts.append(last)
    return np.array(cuts)


def binned(columns: list[np.ndarray], label: np.ndarray, cuts: list[np.ndarray | None]) -> np.ndarray:
    """One byte for each input of a row: twice its bin, plus the label. Inputs without cuts are categories."""
    out = np.empty((len(label), len(columns)), np.uint8)
    for i, (values, cut) in enumerate(zip(columns, cuts)):
        out[:, i] = 2 * (values if cut is None else np.searchsorted(cut, values, side="left")) + label
    return out


def _packed(cuts: list[np.ndarray | None]):
    """Rows of inputs and label to (block, bins): blocks of BLOCK rows, the last of a task of fewer."""

    def run(batches):
        import pyarrow as pa

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out(rows: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | n], pa.int64()), pa.array([rows.tobytes()], pa.binary())], ["block", "bins"])

        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a run lacks an input or its label")
            *columns, label = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if any(np.isnan(c).any() for c in columns):
                raise ValueError("an input of a run is not a number")
            if not ((label == 0) | (label == 1)).all():
                raise ValueError("a label is neither 0 nor 1")
            held.append(binned(columns, label, cuts))
            size += batch.num_rows
            while size >= BLOCK:
                rows = np.concatenate(held)
                yield out(rows[:BLOCK])
                n, held, size = n + 1, [rows[BLOCK:]], size - BLOCK
        if size:
            yield out(np.concatenate(held))

    return run


# --- a level in tasks -----------------------------------------------------------------------------


def _poisson() -> np.ndarray:
    """Draws of mean 1 for each of 65,536 equal shares, in order."""
    shares, p = [], math.exp(-1)
    for k in range(1, 13):
        shares.append(p)
        p /= k
    return np.searchsorted(np.cumsum(shares), (np.arange(65_536) + 0.5) / 65_536).astype(np.float64)


def _drawn_rows(poisson: np.ndarray, seed: int, tree: int, block: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that a tree has, and how often."""
    raw = np.random.SFC64(np.random.SeedSequence((seed, 0, tree, block))).random_raw(-(-n // 4)).view(np.uint16)[:n]
    rows = np.flatnonzero(raw >= np.searchsorted(poisson, 1))
    return rows, poisson.take(raw.take(rows, mode="wrap"), mode="wrap")


def drawn_inputs(seed: int, tree: int, level: int, nodes: int, inputs: int, n: int) -> np.ndarray:
    """(nodes, n): the inputs that each node of a level looks at."""
    rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence((seed, 1, tree, level))))
    return np.sort(rng.random((nodes, inputs)).argsort(axis=1)[:, :n], axis=1)


@dataclass
class Growing:
    """Trees as arrays over places (children of p: 2p+1, 2p+2), and what the next level works on."""

    seed: int
    inputs: int
    feature: np.ndarray  # (trees, places); -1: a leaf, or not grown yet
    left: np.ndarray  # (trees, places): bit set of the bins that go left
    depth: int
    active: list[np.ndarray]  # by tree: places that are to be divided
    drawn: list[np.ndarray]  # by tree: (places, inputs drawn)


def _narrowest(most: int) -> type:
    return np.int16 if most < 2**15 else np.int32


def _children(feature: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where a row goes by its place and its byte of the input looked at; a leaf keeps its rows."""
    places = np.arange(len(feature))
    goes_left = (left[:, None] >> (np.arange(CELLS, dtype=np.uint32) >> 1)) & 1
    child = 2 * places[:, None] + 2 - goes_left.astype(np.int64)
    return np.where(feature[:, None] >= 0, child, places[:, None]).astype(_narrowest(2 * len(feature) + 2)).ravel()


def _walk(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, child: np.ndarray, cells: int, steps: int) -> np.ndarray:
    """The places that rows (which begin at ``base``) come to in a tree."""
    node, at = np.zeros(len(base), np.intp), np.empty(len(base), np.intp)
    seen, gone = np.empty(len(base), np.uint8), np.empty(len(base), child.dtype)
    for _ in range(steps):  # every index is in range; a mode but "raise" lets numpy skip its own buffers
        feature.take(node, out=at, mode="wrap")
        at += base
        flat.take(at, out=seen, mode="wrap")
        node *= cells
        node += seen
        child.take(node, out=gone, mode="wrap")
        node[:] = gone
    return node


def _counted(growing: Growing):
    """Blocks to (tree, counts) of a task: weights by drawn input, active node, bin and label."""

    def run(batches):
        import pyarrow as pa

        blocks = [(b, np.frombuffer(x, np.uint8)) for batch in batches for b, x in zip(*[c.to_pylist() for c in batch.columns])]
        poisson, inputs, above = _poisson(), growing.inputs, 2**growing.depth - 1
        for tree, (active, drawn) in enumerate(zip(growing.active, growing.drawn)):
            if not len(active) or not blocks:
                continue
            features, left = growing.feature[tree, : max(1, above)], growing.left[tree, : max(1, above)]
            feature, child = np.maximum(features, 0).astype(np.intp), _children(features, left)
            # A row in a leaf has a place above this level, or one without a slot.
            slot = np.full(2 * above + 1, -1, np.intp)
            slot[active] = np.arange(len(active))
            looked = [np.ascontiguousarray(d, np.intp) for d in drawn.T]
            sums = np.zeros((len(looked), len(active) * CELLS))
            for block, flat in blocks:
                rows, weight = _drawn_rows(poisson, growing.seed, tree, block, len(flat) // inputs)
                base = rows * inputs
                node = slot.take(_walk(flat, base, feature, child, CELLS, growing.depth), mode="wrap")
                if len(active) <= above:
                    kept = np.flatnonzero(node >= 0)
                    node, base, weight = node[kept], base[kept], weight[kept]
                at, seen, first, cell = np.empty_like(node), np.empty(len(node), np.uint8), node * CELLS, np.empty_like(node)
                for j, input_of in enumerate(looked):
                    input_of.take(node, out=at, mode="wrap")
                    at += base
                    flat.take(at, out=seen, mode="wrap")
                    np.add(first, seen, out=cell)
                    sums[j] += np.bincount(cell, weight, sums.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([_narrow(sums)], pa.binary())], ["tree", "counts"])

    return run


def _narrow(sums: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(sums.max(initial=0)))
    return bytes([kind.itemsize]) + sums.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.float64)


def _gini(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n = np.maximum(zeros + ones, 1)
    return 1 - (zeros / n) ** 2 - (ones / n) ** 2


def best_cuts(counts: np.ndarray, drawn: np.ndarray, sizes: np.ndarray, categorical: np.ndarray, min_leaf: int) -> np.ndarray:
    """The cut of most gain for each node. ``counts``: (nodes, inputs drawn, BINS, 2); the first of equal ones wins."""
    zeros, ones = counts[..., 0], counts[..., 1]
    # Categories in the order of their share of ones, those without rows last; bins as they are.
    n = zeros + ones
    by_share = np.where(n > 0, ones / np.maximum(n, 1), np.inf)
    key = np.where(categorical[drawn][..., None], by_share, np.arange(BINS))
    order = np.argsort(key, axis=-1, kind="stable")
    l0 = np.cumsum(np.take_along_axis(zeros, order, -1), -1)
    l1 = np.cumsum(np.take_along_axis(ones, order, -1), -1)
    n0, n1 = l0[..., -1:], l1[..., -1:]
    r0, r1, whole = n0 - l0, n1 - l1, np.maximum(n0 + n1, 1)
    gain = _gini(n0, n1) - (l0 + l1) / whole * _gini(l0, l1) - (r0 + r1) / whole * _gini(r0, r1)
    fits = (l0 + l1 >= min_leaf) & (r0 + r1 >= min_leaf) & (np.arange(BINS) < sizes[drawn][..., None] - 1)
    gain = np.where(fits, gain, -np.inf).reshape(len(counts), -1)
    best = gain.argmax(1)
    j, cut = np.divmod(best, BINS)
    nodes = np.arange(len(counts))
    bits = np.cumsum(np.uint32(1) << order[nodes, j].astype(np.uint32), -1, dtype=np.uint32)
    out = np.zeros(len(counts), CHOICE)
    grows = gain[nodes, best] > 0
    out["feature"] = np.where(grows, drawn[nodes, j], -1)
    out["left"], out["gain"] = bits[nodes, cut], gain[nodes, best]
    out["l0"], out["l1"] = l0[nodes, j, cut], l1[nodes, j, cut]
    out["n0"], out["n1"] = n0[:, 0, 0], n1[:, 0, 0]
    return out


def _chosen(growing: Growing, sizes: np.ndarray, categorical: np.ndarray, min_leaf: int):
    """(tree, counts) of all tasks to (tree, choices) by tree."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = _wide(packed.as_buffer().to_pybytes())
                sums[tree] = sums[tree] + counts if tree in sums else counts
        for tree, counts in sums.items():
            drawn = growing.drawn[tree]
            counts = counts.reshape(drawn.shape[1], drawn.shape[0], BINS, 2).swapaxes(0, 1)
            found = best_cuts(counts, drawn, sizes, categorical, min_leaf)
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["tree", "choices"])

    return run


# --- growing --------------------------------------------------------------------------------------


def blocks_of(rows: DataFrame, n: int, cuts: list[np.ndarray | None]) -> DataFrame:
    """``rows`` (inputs, then the label) as settled blocks, dealt out in whole rounds of the cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    packed = rows.mapInArrow(_packed(cuts), "block long, bins binary")
    return settle(packed.repartition(cores * max(1, -(-n // (cores * TASK_ROWS)))))


def grow(
    rows: DataFrame, n: int, sizes: dict[int, int], trees: int, depth: int, min_leaf: int, seed: int
) -> list[list[tuple]]:
    """The nodes of each tree, as Spark saves them, grown on ``rows``: ``n`` rows of inputs, then the label.

    ``sizes`` gives the number of categories of those inputs that are numbers of categories.
    """
    *names, label = rows.columns
    if too_many := [names[i] for i, size in sizes.items() if size > BINS]:
        raise ValueError(f"more than {BINS} categories: {', '.join(too_many)}")
    sampled = rows.select(*[c for i, c in enumerate(names) if i not in sizes])
    sampled = sampled.sample(min(1.0, SAMPLE / max(n, 1)), seed).toPandas()
    cuts = [None if i in sizes else candidate_cuts(sampled[c].dropna().to_numpy()) for i, c in enumerate(names)]
    bins = np.array([sizes[i] if cut is None else len(cut) + 1 for i, cut in enumerate(cuts)])
    categorical = np.array([cut is None for cut in cuts])
    blocks = blocks_of(rows, n, cuts)

    places, looked = 2 ** (depth + 1) - 1, math.ceil(math.sqrt(len(names)))
    forest = np.zeros((trees, places), CHOICE)
    forest["feature"] = -1
    active = [np.zeros(1, np.intp) for _ in range(trees)]
    parts = min(trees, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    for level in range(depth):
        if not any(len(a) for a in active):
            break
        drawn = [drawn_inputs(seed, tree, level, len(a), len(names), looked) for tree, a in enumerate(active)]
        growing = Growing(seed, len(names), forest["feature"].copy(), forest["left"].copy(), level, active, drawn)
        counts = blocks.mapInArrow(_counted(growing), "tree int, counts binary")
        choices = counts.repartition(parts, "tree").mapInArrow(_chosen(growing, bins, categorical, min_leaf), "tree int, choices binary")
        for tree, packed in choices.collect():  # a row a tree
            found, at = np.frombuffer(packed, CHOICE), active[tree]
            forest[tree, at] = found
            at, found = at[found["feature"] >= 0], found[found["feature"] >= 0]
            for side, zeros, ones in ((1, found["l0"], found["l1"]), (2, found["n0"] - found["l0"], found["n1"] - found["l1"])):
                forest["n0"][tree, 2 * at + side], forest["n1"][tree, 2 * at + side] = zeros, ones
            if level + 1 < depth:
                below = np.sort(np.r_[2 * at + 1, 2 * at + 2])
                active[tree] = below[(forest["n0"][tree, below] > 0) & (forest["n1"][tree, below] > 0)]
    return [_nodes(tree, cuts, bins) for tree in forest]


def _nodes(tree: np.ndarray, cuts: list[np.ndarray | None], sizes: np.ndarray) -> list[tuple]:
    """A tree's nodes from the root, left before right: two leaves that say the same are their parent's."""

    def built(place: int):
        node = tree[place]
        said = float(node["n1"] > node["n0"])
        if node["feature"] < 0:
            return place, said, None
        below = built(2 * place + 1), built(2 * place + 2)
        if all(b[2] is None for b in below) and below[0][1] == below[1][1]:
            return place, said, None
        return place, said, below

    out: list[tuple] = []

    def add(node) -> int:
        place, said, below = node
        at, (n0, n1) = len(out), (float(tree[place]["n0"]), float(tree[place]["n1"]))
        head = (at, said, float(_gini(n0, n1)), [n0, n1], int(n0 + n1))
        out.append((*head, -1.0, -1, -1, (-1, [], -1)))
        if below is not None:
            children = [add(b) for b in below]
            feature, left = int(tree[place]["feature"]), int(tree[place]["left"])
            going = [b for b in range(int(sizes[feature])) if left >> b & 1]
            cut = cuts[feature]
            split = (feature, [float(b) for b in going], int(sizes[feature])) if cut is None else (feature, [float(cut[len(going) - 1])], -1)
            out[at] = (*head, float(tree[place]["gain"]), *children, split)
        return at

    add(built(0))
    return out


NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def as_model(
    spark: SparkSession, forest: list[list[tuple]], inputs: int, settings: RandomForestClassifier, path: str
) -> RandomForestClassificationModel:
    """A model of Spark ML with these trees, saved at ``path`` and loaded from there."""
    few = spark.createDataFrame([(float(i), Vectors.dense([float(i)] * inputs)) for i in (0, 1)], [settings.getLabelCol(), settings.getFeaturesCol()])
    settings.fit(few).write().overwrite().save(path)  # its settings; the nodes follow
    rows = [(tree, node) for tree, nodes in enumerate(forest) for node in nodes]
    spark.createDataFrame(rows, NODES, verifySchema=False).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


# --- scoring --------------------------------------------------------------------------------------


#: A forest as arrays, which a worker needs to score rows: cuts by input (None for categories), and of each tree the input that
#: a node looks at, its children by bin, its shares of 0 and 1, and the tree's depth.
Tables = tuple[list[np.ndarray | None], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]]


def tables(nodes: DataFrame, inputs: int) -> Tables | None:
    """From nodes as Spark saves them (treeID, nodeData); None where an input has more cuts than a byte holds."""
    found: dict[int, list] = {}
    for tree, node in nodes.orderBy("treeID", "nodeData.id").collect():  # some 2,000 a tree
        found.setdefault(tree, []).append(node)
    every = [n for tree in found.values() for n in tree if n.leftChild >= 0]
    categorical = {n.split.featureIndex for n in every if n.split.numCategories >= 0}
    cuts = [
        None if i in categorical else np.unique([n.split.leftCategoriesOrThreshold[0] for n in every if n.split.featureIndex == i])
        for i in range(inputs)
    ]
    if any(c is not None and len(c) >= BINS for c in cuts) or any(n.split.numCategories > BINS for n in every):
        return None
    trees = []
    for _, tree in sorted(found.items()):
        feature, child = np.zeros(len(tree), np.intp), np.empty((len(tree), BINS), _narrowest(len(tree)))
        share, depth = np.zeros((2, len(tree))), np.zeros(len(tree), int)
        for n in tree:
            total = sum(n.impurityStats)
            if total:
                share[:, n.id] = [x / total for x in n.impurityStats]
            if n.leftChild < 0:
                child[n.id] = n.id
                continue
            i = feature[n.id] = n.split.featureIndex
            named = n.split.leftCategoriesOrThreshold
            left = np.isin(np.arange(BINS), named) if cuts[i] is None else np.arange(BINS) <= np.searchsorted(cuts[i], named[0])
            child[n.id] = np.where(left, n.leftChild, n.rightChild)
            depth[[n.leftChild, n.rightChild]] = depth[n.id] + 1
        trees.append((feature, child.ravel(), share[0], share[1], int(depth.max())))
    return cuts, trees


def chances(forest: Tables, inputs: np.ndarray, rows: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """(prediction, probability of 1) of rows, added up tree after tree as Spark does."""
    cuts, trees = forest
    said, chance = np.empty(len(inputs), np.int32), np.empty(len(inputs))
    for a in range(0, len(inputs), rows):
        part = inputs[a : a + rows]
        columns = [part[:, i] for i in range(part.shape[1])]
        flat = (binned(columns, np.zeros(len(part), int), cuts) >> 1).ravel()
        base = np.arange(len(part)) * part.shape[1]
        votes = np.zeros((2, len(part)))
        for feature, child, zero, one, depth in trees:
            node = _walk(flat, base, feature, child, BINS, depth)
            votes[0] += zero.take(node, mode="wrap")
            votes[1] += one.take(node, mode="wrap")
        said[a : a + rows] = votes[1] > votes[0]
        chance[a : a + rows] = votes[1] / (votes[0] + votes[1])
    return said, chance


def scored(forest: Broadcast[Tables], features: Column) -> Column:
    """struct(prediction int, probability double) of a column of assembled inputs."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def of(parts):
        for part in parts:
            inputs = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            said, chance = chances(forest.value, inputs)
            yield pa.StructArray.from_arrays([pa.array(said, pa.int32()), pa.array(chance, pa.float64())], ["prediction", "probability"])

    of.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(of, "prediction int, probability double")(vector_to_array(features))
