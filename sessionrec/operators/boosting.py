"""Boosted trees for a binary target, trained on all executors by histograms."""

from __future__ import annotations

import heapq
import math
import pickle
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.sources.events import staged, with_checkpoints

#: Bins of values of a feature; one more is for missing values.
BINS = 255
MISSING = BINS
#: Accuracy of the quantile sketch that sets bin edges.
SKETCH = 10_000
#: Rows of the training frame to a block, where each pass over the blocks is a job.
BLOCK_ROWS = 50_000
#: Rows that are trained in one task: up to some 200 bytes each there, temporaries included. Best-first trees have some 40 levels, and a job for each takes longer than all of a round in a task.
TASK_ROWS = 3_000_000
#: Rows of a node whose sums a task makes for all features at once.
FLAT_ROWS = 1_000
#: Gains that differ by this share or less are equal: the order in which rows are added up does not pick splits.
TIE = 1e-9
#: Rounds of a task; what a lost executor costs at most. The next task goes through the trees before it first, 10 ms each at 225,000 rows.
ROUNDS_OF_TASK = 125
#: Rounds between checkpoints of the margins, where each pass is a job.
INTERVAL = 10


@dataclass(frozen=True)
class Settings:
    """How trees are grown: rounds, leaves of a tree, step, least rows and curvature of a leaf, shares of rows and features that a tree sees."""

    rounds: int = 250
    leaves: int = 63
    step: float = 0.05
    least: int = 100
    least_curvature: float = 1e-3
    row_share: float = 0.9
    feature_share: float = 0.9
    seed: int = 42


@dataclass
class Tree:
    """Nodes as columns; node 0 is the root, a leaf has feature -1. Values up to the threshold go left, missing ones by missing_left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, rows: int, value: float) -> int:
        for column, x in zip((self.feature, self.threshold, self.missing_left, self.left, self.right, self.value, self.gain, self.rows), (-1, 0.0, False, -1, -1, value, 0.0, rows)):
            column.append(x)
        return len(self.feature) - 1

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The leaf values of rows, a column of x to a feature; NaN is missing."""
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
                continue
            v = x[rows, self.feature[node]]
            to_left = np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])
            todo += [(self.left[node], rows[to_left]), (self.right[node], rows[~to_left])]
        return out


NODES = "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double, gain double, rows long"


@dataclass
class BoostedTrees:
    features: tuple[str, ...]
    base: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.margins(x)
        return out

    def score(self) -> Column:
        """The probability of the target, from the features' columns."""
        def scored(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in columns:
                yield pd.Series(1 / (1 + np.exp(-self.margins(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in batch])))))

        return F.pandas_udf(scored, "double")(*[F.col(f).cast("double") for f in self.features])

    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row for each node of each tree."""
        rows = [(t, n, *values) for t, tree in enumerate(self.trees) for n, values in enumerate(zip(tree.feature, tree.threshold, tree.missing_left, tree.left, tree.right, tree.value, tree.gain, tree.rows))]
        return spark.createDataFrame(rows, NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(list(self.features), self.base, len(self.trees))], "features array<string>, base double, trees int").coalesce(1).write.json(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        model = spark.read.schema("features array<string>, base double, trees int").json(f"{path}/model").first()
        trees = [Tree() for _ in range(model.trees)]
        for r in spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect():  # a model's nodes: bounded by rounds and leaves
            tree = trees[r.tree]
            for column, x in zip((tree.feature, tree.threshold, tree.missing_left, tree.left, tree.right, tree.value, tree.gain, tree.rows), r[2:]):
                column.append(x)
        return cls(tuple(model.features), model.base, trees)


def bin_edges(frame: DataFrame, features: Iterable[str]) -> list[np.ndarray]:
    """For each feature the values at which its bins end, BINS - 1 at most, by a quantile sketch; missing values have none."""
    shares, features = [k / BINS for k in range(1, BINS)], list(features)
    value = lambda f: F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double"))
    values = frame.select(F.posexplode(F.array(*[value(f) for f in features])).alias("feature", "value"))
    # By feature, so that sketches of different features are merged in different tasks.
    found = dict(values.groupBy("feature").agg(F.percentile_approx("value", shares, SKETCH)).collect())  # a row for each feature
    return [np.unique(np.array(found.get(k) or [], dtype=float)) for k, _ in enumerate(features)]


@dataclass
class Block:
    """Rows of the training frame: bins by feature, targets, row keys, and margins so far."""

    bins: np.ndarray
    target: np.ndarray
    key: np.ndarray
    margin: np.ndarray


def binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]
            bins = np.stack([np.where(np.isnan(c), MISSING, np.searchsorted(e, c)).astype(np.uint8) for c, e in zip(columns, edges)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], type=pa.binary())], names=["key", "target", "bins"])

    return run


def blocks_of(features: int, base: float):
    def run(rows: Iterator) -> Iterator[Block]:
        found = [(r.key, r.target, r.bins) for r in rows]
        if found:
            key, target, bins = zip(*found)
            flat = np.frombuffer(b"".join(bins), dtype=np.uint8).reshape(len(found), features)
            yield Block(np.ascontiguousarray(flat.T), np.array(target, dtype=float), np.array(key, dtype=np.int64).view(np.uint64), np.full(len(found), base))

    return run


def sampled(key: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows a round sees: by their keys, so alike wherever rows lie."""
    x = key ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
    for shift in (33, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x >> np.uint64(40)) < np.uint64(int(share * 2**24))


#: A split by bins: node, feature, bin, whether missing values go left, left and right node.
Split = tuple[int, int, int, bool, int, int]


def parted(bins: np.ndarray, found: dict[int, np.ndarray], splits: list[Split]) -> dict[int, np.ndarray]:
    """The rows of each node after splits, parents before children; those of nodes that are gone from `found` were made before."""
    for node, feature, to, missing_left, left, right in splits:
        if node not in found:
            continue
        at = found.pop(node)
        b = bins[feature][at]
        to_left = (b <= to) & (b != MISSING) | ((b == MISSING) & missing_left)
        found[left], found[right] = at[to_left], at[~to_left]
    return found


def histograms(splits: list[Split], wanted: list[int], settings: Settings, turn: int):
    """Blocks to (nodes, 3, features, bins): rows, gradients and curvatures of the wanted nodes."""
    def run(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        for block in blocks:
            found = parted(block.bins, {0: np.flatnonzero(sampled(block.key, settings.seed, turn, settings.row_share))}, splits)
            rows = np.concatenate([found[n] for n in wanted])
            slot = np.repeat(np.arange(len(wanted)) * (BINS + 1), [len(found[n]) for n in wanted])
            p = 1 / (1 + np.exp(-block.margin[rows]))
            g, h = p - block.target[rows], p * (1 - p)
            out = np.empty((len(wanted), 3, len(block.bins), BINS + 1))
            for f, bins in enumerate(block.bins):
                code = slot + bins[rows]
                for k, weights in enumerate((None, g, h)):
                    out[:, k, f] = np.bincount(code, weights=weights, minlength=len(wanted) * (BINS + 1)).reshape(len(wanted), BINS + 1)
            yield out

    return run


@dataclass
class Distinct:
    """The rows of a task, those of equal bins once: bins by feature and by row, and margins so far; and of each row its key, target and place there.

    columns: features of few bins share a column of codes, which is counted once; the others have one of their own. Each with its features and their numbers of bins.
    """

    bins: np.ndarray
    by_row: np.ndarray
    columns: list[tuple[np.ndarray, list[int], list[int]]]
    margin: np.ndarray
    key: np.ndarray
    target: np.ndarray
    place: np.ndarray


class Turn:
    """A round in a task. A split moves the rows of its smaller child alone, which get a label; the other child keeps its parent's.

    Large nodes are found by their label, the others have a list of their rows.
    """

    def __init__(self, rows: Distinct, settings: Settings, turn: int):
        self.rows, n, p = rows, len(rows.margin), 1 / (1 + np.exp(-rows.margin))
        drawn = sampled(rows.key, settings.seed, turn, settings.row_share)
        place = rows.place[drawn]
        count = np.bincount(place, minlength=n).astype(float)
        #: Of the drawn rows of equal bins: how many, gradients and curvatures.
        self.weights = count, count * p - np.bincount(place, rows.target[drawn], n), count * p * (1 - p)
        self.labels = np.zeros(n, np.min_scalar_type(settings.leaves))
        self.label, self.size, self.lists = {0: 0}, {0: n}, {}

    def histograms(self, splits: list[Split], wanted: list[int]) -> list[np.ndarray]:
        """As histograms(); the wanted nodes are the root, or the smaller children of the splits, which are new."""
        found = [self.split(split, small) for split, small in zip(splits, wanted, strict=True)] if splits else [np.arange(self.size[0])]
        return [self.sums(at[self.weights[0][at] > 0]) for at in found]

    def split(self, split: Split, small: int) -> np.ndarray:
        """The smaller child's rows."""
        node, feature, to, missing_left, left, right = split
        other, at, label = left + right - small, self.lists.pop(node, None), self.label.pop(node)
        bins = self.rows.bins[feature] if at is None else self.rows.bins[feature][at]
        inside = (bins <= to) | (bins == MISSING) if missing_left else bins <= to
        if small == right:
            inside = ~inside
        if at is None:
            moved = np.flatnonzero(inside & (self.labels == label))
        else:
            moved, self.lists[other] = at[inside], at[~inside]
        self.lists[small], self.label[small], self.label[other] = moved, len(self.label) + 1, label
        self.labels[moved] = self.label[small]
        self.size[small], self.size[other] = len(moved), self.size[node] - len(moved)
        if at is None and self.size[other] < len(self.labels) / 8:
            self.lists[other] = np.flatnonzero(self.labels == label)
        return moved

    def sums(self, at: np.ndarray) -> np.ndarray:
        weights, n = [w[at] for w in self.weights], len(self.rows.bins)
        if len(at) <= FLAT_ROWS:
            code = (self.rows.by_row[at] + np.arange(n) * (BINS + 1)).ravel()
            return np.stack([np.bincount(code, np.repeat(w, n), n * (BINS + 1)) for w in weights]).reshape(3, n, BINS + 1)
        out = np.zeros((3, n, BINS + 1))
        for codes, features, sizes in self.rows.columns:
            code = codes[at].astype(np.intp)
            found = np.stack([np.bincount(code, w, math.prod(sizes)) for w in weights]).reshape(3, *sizes)
            for k, (f, size) in enumerate(zip(features, sizes)):
                out[:, f, :size] = found.sum(axis=tuple(j + 1 for j in range(len(sizes)) if j != k))
        return out

    def move(self, values: dict[int, float]) -> None:
        """Adds the values of the leaves to the rows' margins."""
        value = np.zeros(len(self.label))
        for node, label in self.label.items():
            value[label] = values[node]
        self.rows.margin += value[self.labels]


@dataclass
class Node:
    """A node of a tree that grows: its histogram and its best split (gain 0: none)."""

    sums: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    missing_left: bool = False
    children: tuple[int, int] | None = None


def best_split(sums: np.ndarray, features: list[int], settings: Settings) -> Node:
    """The split of the greatest gain over features, bins and both ways for missing values; the first among equals."""
    total = np.cumsum(sums[:, features[0]], axis=1)[:, -1]
    found = Node(sums)
    if total[0] < 2 * settings.least:
        return found
    value = lambda g, h: g**2 / np.maximum(h, 1e-300)
    sums, (_, all_g, all_h) = sums[:, features], total
    held, below = sums[0, :, :BINS] > 0, np.cumsum(sums[:, :, :BINS], axis=2)
    missing = np.flatnonzero(sums[0, :, MISSING])
    for missing_left in (False, True):
        if missing_left:  # the features without missing rows would give the same
            held, below = held[missing], below[:, missing] + sums[:, missing, MISSING:]
        # Ends of bins without rows split as the bin before them does.
        at = np.flatnonzero(held & (below[0] >= settings.least) & (below[0] <= total[0] - settings.least))
        g, h = below[1].ravel()[at], below[2].ravel()[at]
        gain = np.where(np.minimum(h, all_h - h) >= settings.least_curvature, value(g, h) + value(all_g - g, all_h - h) - value(all_g, all_h), 0.0)
        best = gain.max(initial=0.0)
        if best > found.gain * (1 + TIE):
            k = int(np.argmax(gain >= best * (1 - TIE)))
            f, b = divmod(int(at[k]), BINS)
            found.gain, found.feature, found.bin, found.missing_left = float(gain[k]), features[missing[f] if missing_left else f], b, missing_left
    return found


def grown(summed, features: list[int], settings: Settings, ahead: bool = True) -> tuple[dict[int, Node], list[int]]:
    """Nodes of a tree, and those that are split, in best-first order: always the leaf of the greatest gain next.

    summed(splits, wanted) gives histograms. ahead: a pass over all rows asks for the children of all leaves that may still be
    split, with all splits so far, so passes are as many as the tree is deep, not as it has leaves. Else for the next leaf's
    children, with their split alone. A child with more rows is its parent less its sibling.
    """
    nodes = {0: best_split(summed([], [0])[0], features, settings)}
    order, leaves = [], [(-nodes[0].gain, 0)]
    while True:
        while leaves and len(order) < settings.leaves - 1 and leaves[0][0] < 0 and nodes[leaves[0][1]].children:
            n = heapq.heappop(leaves)[1]
            order.append(n)
            for child in nodes[n].children:
                heapq.heappush(leaves, (-nodes[child].gain, child))
        if not leaves or len(order) == settings.leaves - 1 or leaves[0][0] == 0:
            return nodes, order
        # The next leaf's children are not known: they are asked for, with those of the leaves that could come after it.
        asked = [n for gain, n in heapq.nsmallest(settings.leaves - 1 - len(order), leaves) if gain < 0 and not nodes[n].children] if ahead else [leaves[0][1]]
        splits, first = splits_of(nodes, order) if ahead else [], len(nodes)
        ids = {n: (first + 2 * k, first + 2 * k + 1) for k, n in enumerate(asked)}
        splits += [(n, nodes[n].feature, nodes[n].bin, nodes[n].missing_left, *ids[n]) for n in asked]
        small = {}
        for n in asked:
            rows = nodes[n].sums[0, nodes[n].feature]
            in_left = rows[: nodes[n].bin + 1].sum() + (rows[MISSING] if nodes[n].missing_left else 0)
            small[n] = ids[n][int(2 * in_left > rows.sum())]
        for n, sums in zip(asked, summed(splits, [small[n] for n in asked])):
            for child in ids[n]:
                nodes[child] = best_split(sums if child == small[n] else nodes[n].sums - sums, features, settings)
            nodes[n].children = ids[n]


def splits_of(nodes: dict[int, Node], order: list[int]) -> list[Split]:
    return [(n, nodes[n].feature, nodes[n].bin, nodes[n].missing_left, *nodes[n].children) for n in order]


def tree_of(nodes: dict[int, Node], order: list[int], edges: list[np.ndarray], settings: Settings) -> tuple[Tree, dict[int, float]]:
    """The tree by values, and the leaves' values by node. The last bin has no edge: all that isn't missing is below it."""
    tree, at, values = Tree(), {}, {}

    def add(n: int) -> int:
        rows, g, h = nodes[n].sums[:, 0].sum(axis=1)
        values[n] = -settings.step * g / h if h > 0 else 0.0
        at[n] = tree.add(int(rows), float(values[n]))
        return at[n]

    add(0)
    for n in order:
        k, node = at[n], nodes[n]
        values.pop(n)
        ends = edges[node.feature]
        tree.feature[k], tree.threshold[k], tree.missing_left[k], tree.gain[k] = node.feature, float(ends[node.bin]) if node.bin < len(ends) else math.inf, node.missing_left, node.gain
        tree.left[k], tree.right[k] = (add(c) for c in node.children)
    return tree, values


def moved(splits: list[Split], values: dict[int, float]):
    def run(block: Block) -> Block:
        margin = block.margin.copy()
        for node, rows in parted(block.bins, {0: np.arange(len(margin))}, splits).items():
            margin[rows] += values[node]
        return Block(block.bins, block.target, block.key, margin)

    return run


def one_round(summed, turn: int, edges: list[np.ndarray], settings: Settings, ahead: bool = True) -> tuple[Tree, list[Split], dict[int, float]]:
    """The tree of a round, its splits by bins and its leaves' values by node."""
    draw = random.Random(f"{settings.seed}/{turn}")
    seen = sorted(draw.sample(range(len(edges)), max(1, round(settings.feature_share * len(edges)))))
    nodes, order = grown(summed, seen, settings, ahead)
    tree, values = tree_of(nodes, order, edges, settings)
    return tree, splits_of(nodes, order), values


def shared(bins: np.ndarray) -> list[tuple[np.ndarray, list[int], list[int]]]:
    """Columns of codes for Distinct, of BINS + 1 codes at most."""
    sizes, out = [int(b.max()) + 1 for b in bins], []
    for f in sorted(range(len(bins)), key=lambda f: sizes[f]):
        if out and math.prod(out[-1][2]) * sizes[f] <= BINS + 1:
            codes, features, used = out[-1]
            out[-1] = (codes.astype(np.uint16) * sizes[f] + bins[f]).astype(np.uint8), [*features, f], [*used, sizes[f]]
        else:
            out.append((bins[f], [f], [sizes[f]]))
    return out


def distinct(batches: Iterable[pa.RecordBatch], features: int, base: float) -> Distinct:
    """From batches of key, target and bins."""
    key, target, bins = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
    found = bins.dictionary_encode()
    by_row = np.frombuffer(b"".join(found.dictionary.to_pylist()), dtype=np.uint8).reshape(-1, features)
    bins = np.ascontiguousarray(by_row.T)
    return Distinct(bins, by_row, shared(bins), np.full(len(by_row), base), key.to_numpy().view(np.uint64), target.to_numpy(), found.indices.to_numpy().astype(np.intp))


def rounds_of_task(edges: list[np.ndarray], settings: Settings, base: float, before: list[tuple[list[Split], dict[int, float]]], turns: range):
    """Rounds over the rows of a task, from the margins that the trees before give."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = distinct(batches, len(edges), base)
        for splits, values in before:
            for node, at in parted(rows.bins, {0: np.arange(len(rows.margin))}, splits).items():
                rows.margin[at] += values[node]
        for turn in turns:
            step = Turn(rows, settings, turn)
            tree, splits, values = one_round(step.histograms, turn, edges, settings, ahead=False)
            step.move(values)
            yield pa.RecordBatch.from_arrays([pa.array([turn]), pa.array([pickle.dumps((tree, splits, values))])], names=["turn", "round"])

    return run


def train_boosted_trees(frame: DataFrame, target: str, features: Iterable[str], keys: Iterable[str], settings: Settings = Settings()) -> BoostedTrees:
    """Gradient boosting with logistic loss, best-first trees and a learned way for missing values (null or NaN).

    Features are cut into quantile bins once. In each round blocks of rows send histograms of their gradients and curvatures,
    which are summed by a tree of tasks; the driver sees those sums alone, whose size follows from leaves, features and bins,
    and picks splits. Rows never move. Margins stay beside the rows, and every INTERVAL rounds they are written to the
    checkpoint folder, so that a lost executor costs the rounds since then at most. Rows are drawn for each round by a hash of `keys`.
    A frame of TASK_ROWS rows at most goes through the same rounds in a task, ROUNDS_OF_TASK at a time, without a job for each pass;
    rows of equal bins have equal margins, so they are added up once for a round.

    An empty frame, or a target of one value, gives a model without trees.
    """
    spark, features = frame.sparkSession, tuple(features)
    n, positive = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0))).first()
    base = math.log(positive / (n - positive)) if 0 < positive < n else 0.0
    model = BoostedTrees(features, base, [])
    if not 0 < positive < n:
        return model
    edges = bin_edges(frame, features)
    rows = frame.select(F.xxhash64(*keys).alias("key"), F.col(target).cast("double").alias("target"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    rows = staged(rows.mapInArrow(binned(edges), "key long, target double, bins binary"), "binned")
    if n > TASK_ROWS:
        model.trees.extend(trees_by_passes(rows, -(-n // BLOCK_ROWS), base, edges, settings))
        return model
    made, alone = [], rows.coalesce(1)
    for start in range(0, settings.rounds, ROUNDS_OF_TASK):
        turns = range(start, min(start + ROUNDS_OF_TASK, settings.rounds))
        found = alone.mapInArrow(rounds_of_task(edges, settings, base, [r[1:] for r in made], turns), "turn long, round binary")
        made += [pickle.loads(r["round"]) for r in sorted(found.collect(), key=lambda r: r.turn)]  # trees: bounded by rounds and leaves
    model.trees.extend(r[0] for r in made)
    return model


def trees_by_passes(rows: DataFrame, parts: int, base: float, edges: list[np.ndarray], settings: Settings) -> list[Tree]:
    """The same trees with a job for each pass; the driver adds up histograms by a tree of tasks, and margins are written every INTERVAL rounds."""
    with_checkpoints(rows.sparkSession)
    blocks = rows.repartition(parts, "key").rdd.mapPartitions(blocks_of(len(edges), base)).persist(StorageLevel.MEMORY_AND_DISK)
    trees = []
    for turn in range(settings.rounds):
        tree, splits, values = one_round(lambda splits, wanted: blocks.mapPartitions(histograms(splits, wanted, settings, turn)).treeReduce(np.add), turn, edges, settings)  # noqa: B023
        trees.append(tree)
        before, blocks = blocks, blocks.map(moved(splits, values)).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % INTERVAL == INTERVAL - 1:
            blocks.checkpoint()
        blocks.count()
        before.unpersist()
    blocks.unpersist()
    return trees
