"""L4: tree learners over sparse features with very many slots.

Spark's tree learners hold the bin of every slot for every row.  Here only a
row's entries other than zero are held and counted: a feature's zero bin has
what is left of the node's total.  All trees of a call (those of a forest, of
all classes and of all folds) grow together, level by level:

1. the features' values are counted, and thresholds lie midway between values,
   or between shares of the rows where a feature has more than ``BINS`` values;
2. the rows are packed once into blocks of a fold, with the entries of a block
   in the order of their bins, two bytes each;
3. each task adds up the label statistics by open node and bin, block by block,
   with a few array operations a tree; a node's sums of all tasks are added up
   in the order of the tasks, and its best split found;
4. the splits, one row per node, go to all tasks for the next level.

Impurities (Gini, variance), depths, bags, features tried per node, residuals
and weights of boosting are those of Spark's learners.  A pass takes as many
open nodes as ``CELLS`` sums hold, so that no task's memory grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edspark.operators.sequence import running_sum
from edspark.session import ensure_checkpoint_dir

BINS, CELLS, NO_GAIN = 32, 16_000_000, 1e-12
BLOCK = 1 << 15  # rows of a block, at most 65,536
STEP = 0.1  # weight of all boosted trees but the first


def entries(features: str) -> tuple[Column, Column, Column]:
    """(size, indices, values) of a vector column, dense or sparse."""
    v = F.unwrap_udt(F.col(features))
    size = F.coalesce(v["size"], F.size(v["values"]))
    return size, F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)), v["values"]


@dataclass
class Table:
    """Thresholds of the features one after the other: feature f has its bins
    from ``start[f]``, one more than thresholds; ``upper``: the threshold above
    a bin (infinite above the last); ``zero``: the bin of the value zero."""

    start: np.ndarray
    upper: np.ndarray
    zero: np.ndarray

    @classmethod
    def of(cls, cuts: list[np.ndarray]) -> Table:
        start = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts]))).astype(np.int64)
        upper = np.concatenate([np.append(c, np.inf) for c in cuts]) if cuts else np.zeros(0)
        zero = np.array([start[f] + np.searchsorted(c, 0.0) for f, c in enumerate(cuts)], np.int64)
        return cls(start, upper, zero)

    def cells(self) -> np.ndarray:
        """By bin: its number among the bins that are not a feature's zero bin."""
        other = np.ones(len(self.upper), np.int64)
        other[self.zero] = 0
        return np.cumsum(other) - other

    def bins(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = self.start[feature], self.start[feature + 1] - 1
        open_ = np.flatnonzero(low < high)
        while len(open_):
            below, above = low[open_], high[open_]
            middle = (below + above) // 2
            right = value[open_] > self.upper[middle]
            low[open_] = below = np.where(right, middle + 1, below)
            high[open_] = above = np.where(right, above, middle)
            open_ = open_[below < above]
        return low


def fit_table(df: DataFrame, features: str) -> Table:
    size, index, value = entries(features)
    shape = df.agg(F.max(size).alias("size"), F.count(F.lit(1)).alias("n")).first()
    return table_of(df.select(index.alias("features"), value.alias("values")), shape["size"], shape["n"])


def table_of(df: DataFrame, size: int | None, n: int) -> Table:
    """The table of ``n`` rows (features, values) with so many features."""
    if not n:
        return Table.of([])
    ensure_checkpoint_dir(df.sparkSession)
    zipped = F.arrays_zip(F.col("features").alias("f"), F.col("values").alias("v"))
    found = df.select(F.explode(zipped).alias("e")).select("e.f", "e.v").filter("v != 0")
    found = found.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    zeros = found.groupBy("f").agg((F.lit(n) - F.sum("n")).alias("n")).select("f", F.lit(0.0).alias("v"), "n").filter("n > 0")
    counts = found.unionByName(zeros).checkpoint()
    kinds = counts.groupBy("f").agg(F.count(F.lit(1)).alias("kinds"))
    known = counts.join(kinds, "f")
    few = known.filter(F.col("kinds") <= BINS).select("f", F.col("v").alias("low"), F.col("v").alias("high"))
    many = known.filter(F.col("kinds") > BINS)
    if not many.isEmpty():
        part = F.floor((F.col("upto") - F.col("n")) * BINS / n)
        many = running_sum(many, "n", [F.col("v")], ["f"], name="upto").groupBy("f", part.alias("part")).agg(
            F.min("v").alias("low"), F.max("v").alias("high"))
        few = few.unionByName(many.select("f", "low", "high"))
    shares = few.toPandas().sort_values(["f", "low"])  # at most BINS rows a feature
    cuts = [np.zeros(0)] * size
    for f, s in shares.groupby("f"):
        cuts[f] = (s["high"].to_numpy()[:-1] + s["low"].to_numpy()[1:]) / 2
    return Table.of(cuts)


@dataclass
class Tree:
    """By node, the root first: the feature split on (-1: none), the largest
    value that goes left, the left child (the right one follows it), label
    statistics (class counts; or rows and sum)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    stats: list[list[float]] = field(default_factory=lambda: [[]])

    def add(self, stats: list[float]) -> int:
        for column, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.stats, stats)):
            column.append(v)
        return len(self.feature) - 1

    def place(self, rows: int, above: Callable[[int, float], np.ndarray]) -> np.ndarray:
        """The node that each row comes to; ``above(f, cut)``: whether the
        rows' values of feature f are over the cut."""
        at = np.zeros(rows, np.min_scalar_type(len(self.feature)))
        for node, f in enumerate(self.feature):  # children come after their parent
            if f >= 0:
                here = at == node
                at += here * at.dtype.type(self.left[node] - node)
                at += here & above(f, self.cut[node])
        return at

    def mean(self) -> np.ndarray:
        return np.array([s[1] / s[0] if s and s[0] else 0.0 for s in self.stats])


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of a column of lists."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers of all spans from low up to below high, one after the other."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Values:
    """Rows given by their entries, for trees that use few of the features."""

    def __init__(self, trees: Sequence[Tree], n_features: int, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray):
        used = np.unique(np.concatenate([np.zeros(0, np.int64)] + [np.array(t.feature) for t in trees]))
        used = used[used >= 0]
        self.rows, self.column = rows, np.full(n_features, -1)
        self.column[used] = np.arange(len(used))
        self.held = np.zeros((len(used), rows))
        at = self.column[feature]
        hit = at >= 0
        self.held[at[hit], row[hit]] = value[hit]

    def above(self, feature: int, cut: float) -> np.ndarray:
        return self.held[self.column[feature]] > cut


@dataclass(frozen=True)
class Plan:
    """``fold``: rows left out (-1: none); ``label``: the class boosted against
    the rest (-1: class counts); ``bag``: seed of Poisson weights (-1: each row
    once) and ``bag_at``, their place in a block; ``tried``: features tried at
    a node (0: all)."""

    fold: int
    depth: int
    label: int = -1
    bag: int = -1
    bag_at: int = -1
    tried: int = 0


def poisson(key: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) numbers that depend on the key and the seed alone."""
    x = key.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(below, share, side="right").astype(float)


def impurity(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, Gini impurity) of each line of class counts."""
    n = stats.sum(axis=1)
    some = np.maximum(n, 1)  # rows are whole numbers; without any, the impurity is not used
    return n, 1 - ((stats / some[:, None]) ** 2).sum(axis=1)


def explained(stats: np.ndarray) -> np.ndarray:
    """Sum squared by rows, of each line of (rows, sum, ...): what the mean
    takes off the sum of squares."""
    return stats[:, 1] ** 2 / np.maximum(stats[:, 0], 1)


class Block:
    """Rows of a fold.  The entries outside the zero bins lie in the order of
    their bins: ``bin[i]`` has the rows ``row[begin[i]:begin[i + 1]]``."""

    SCHEMA = "fold int, rows int, label binary, weight binary, bin binary, count binary, row binary"

    def __init__(self, table: Table, fold: int, rows: int, label: bytes, weight: bytes, bin: bytes, count: bytes, row: bytes):
        self.table, self.fold, self.rows = table, fold, rows
        self.label = np.frombuffer(label, np.int32)
        self.weight = np.frombuffer(weight, np.uint8).reshape(-1, rows)  # by bag
        self.bin = np.frombuffer(bin, np.int32).astype(np.int64)
        self.count = np.frombuffer(count, np.int32).astype(np.int64)
        self.row = np.frombuffer(row, np.uint16).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.count)))
        self.levels: dict[int, np.ndarray] = {}
        self.starts: dict[int, np.ndarray] = {}
        self.cell, self.held = np.empty(len(self.row), np.int64), np.empty(len(self.row))

    @classmethod
    def each(cls, table: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield cls(table, *(c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for c in batch.columns))

    def above(self, feature: int, cut: float) -> np.ndarray:
        start, end = self.table.start[feature], self.table.start[feature + 1]
        level = self.levels.get(feature)
        if level is None:
            level = np.full(self.rows, self.table.zero[feature] - start, np.min_scalar_type(end - start))
            a, b = np.searchsorted(self.bin, (start, end))
            level[self.row[self.begin[a]:self.begin[b]]] = np.repeat(self.bin[a:b] - start, self.count[a:b])
            self.levels[feature] = level
        return level > np.searchsorted(self.table.upper[start:end], cut)

    def sums(self, column: np.ndarray, width: int, weights: Sequence[np.ndarray | None]) -> list[np.ndarray]:
        """By weight (none: 1 a row), its sums by the block's bins and the
        rows' columns, of which there are ``width``."""
        if not len(self.row):
            return [np.zeros((0, width)) for _ in weights]
        if width == 1:
            return [(self.count if w is None else np.add.reduceat(np.take(w, self.row, out=self.held, mode="clip"), self.begin[:-1]))[:, None]
                    for w in weights]
        if width not in self.starts:
            self.starts[width] = np.repeat(np.arange(len(self.bin)) * width, self.count)
        np.take(column, self.row, out=self.cell, mode="clip")
        self.cell += self.starts[width]
        return [np.bincount(self.cell, None if w is None else np.take(w, self.row, out=self.held, mode="clip"),
                            len(self.bin) * width).reshape(-1, width) for w in weights]


def pack(data: DataFrame, table: Table, bags: Sequence[int]) -> DataFrame:
    """Blocks (:class:`Block`) of ``data`` (uid, fold, label, features,
    values), dealt evenly to as many tasks as run at once."""
    spark = data.sparkSession
    sent = spark.sparkContext.broadcast(table)
    names = [c.split()[0] for c in Block.SCHEMA.split(", ")]

    def blocks(uid: np.ndarray, fold: np.ndarray, label: np.ndarray, row: np.ndarray, bins: np.ndarray) -> Iterator[pa.RecordBatch]:
        for f in np.unique(fold):
            of_fold = np.flatnonzero(fold == f)
            for some in (of_fold[a:a + BLOCK] for a in range(0, len(of_fold), BLOCK)):
                place = np.full(len(fold), -1)
                place[some] = np.arange(len(some))
                at = place[row]
                hit = at >= 0
                key = np.sort(bins[hit] << 16 | at[hit])
                bin_of = key >> 16
                first = np.flatnonzero(np.diff(bin_of, prepend=-1))
                found, count = bin_of[first], np.diff(first, append=len(key))
                weight = np.array([poisson(uid[some], b) for b in bags], np.uint8).reshape(len(bags), -1)
                arrays = (label[some].astype(np.int32), weight, found.astype(np.int32), count.astype(np.int32), (key & 0xFFFF).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array([int(f)], pa.int32()), pa.array([len(some)], pa.int32()),
                                                  *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = sent.value, [], 0
        for batch in batches:
            row, feature = flat(batch.column("features"))
            feature = feature.astype(np.int64)
            bins = table.bins(feature, flat(batch.column("values"))[1])
            apart = bins != table.zero[feature]
            held.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "fold", "label")), n + row[apart], bins[apart]))
            n += batch.num_rows
            if n >= 2 * BLOCK:
                yield from blocks(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from blocks(*map(np.concatenate, zip(*held, strict=True)))

    made = data.select("uid", "fold", "label", "features", "values").mapInArrow(run, Block.SCHEMA)
    return made.repartition(spark.sparkContext.defaultParallelism).checkpoint()


class Slots:
    """Open nodes of a pass: where the sums of each lie.  A zero bin has no
    sums of its own."""

    def __init__(self, table: Table, plans: Sequence[Plan], classes: int):
        self.table, self.plans, self.classes = table, plans, classes
        self.n_features = len(table.zero)
        self.width = np.diff(table.start)
        self.k = classes if plans[0].label < 0 else 2  # class counts; or rows and sum

    def features(self, tree: int, node: int) -> np.ndarray:
        p = self.plans[tree]
        if not p.tried:
            return np.arange(self.n_features)
        chosen = np.random.default_rng([p.bag, p.fold + 1, node]).choice(self.n_features, min(p.tried, self.n_features), replace=False)
        return np.sort(chosen)

    def cells(self, tree: int, node: int) -> int:
        return int((self.width[self.features(tree, node)] - 1).sum())

    def best(self, tree: int, node: int, sums: np.ndarray, total: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
        """(feature or -1, threshold, statistics left, right)."""
        chosen = self.features(tree, node)
        width = self.width[chosen]
        begin = np.cumsum(width) - width
        bins = spans(self.table.start[chosen], self.table.start[chosen] + width)
        zero, full = begin + self.table.zero[chosen] - self.table.start[chosen], np.zeros((len(bins), self.k))
        other = np.ones(len(bins), bool)
        other[zero] = False
        full[other] = sums
        upto = np.concatenate((np.zeros((1, self.k)), np.cumsum(full, axis=0)))
        full[zero] = total[:self.k] - (upto[begin + width] - upto[begin])
        upto = np.concatenate((np.zeros((1, self.k)), np.cumsum(full, axis=0)))
        left = upto[1:] - np.repeat(upto[begin], width, axis=0)
        right = total[:self.k] - left
        if self.plans[tree].label < 0:
            (n, whole), (n_left, i_left), (n_right, i_right) = (impurity(s) for s in (total[None], left, right))
            gain = whole - (n_left * i_left + n_right * i_right) / max(n[0], 1)
        else:  # the squares cancel out of the loss of variance
            n_left, n_right, n = left[:, 0], right[:, 0], max(total[0], 1)
            gain = (explained(left) + explained(right) - explained(total[None])) / n
        gain[(n_left < 0.5) | (n_right < 0.5) | np.isinf(self.table.upper[bins])] = -1
        at = int(np.argmax(gain)) if len(gain) else -1
        if at < 0 or gain[at] <= NO_GAIN:
            return -1, 0.0, total, total
        return int(np.repeat(chosen, width)[at]), float(self.table.upper[bins[at]]), left[at], right[at]


def margins(trees: Sequence[Tree], leaves: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(leaves[0]))
    for i, (t, leaf) in enumerate(zip(trees, leaves, strict=True)):
        out += (STEP if i else 1.0) * t.mean()[leaf]
    return out


class Sums:
    """A task's sums for the open nodes of one tree."""

    def __init__(self, slots: Slots, number: int, tree: Tree, nodes: Sequence[int], before: Sequence[Tree]):
        self.slots, self.plan, self.tree, self.before, self.m = slots, slots.plans[number], tree, before, len(nodes)
        self.which = np.full(len(tree.feature), self.m)  # rows elsewhere
        self.which[list(nodes)] = np.arange(self.m)
        self.everywhere = list(nodes) == [0]
        self.boosted = self.plan.label >= 0
        self.total = np.zeros((self.m, 3 if self.boosted else slots.k))
        table = slots.table
        if self.plan.tried:
            self.chosen = [slots.features(number, n) for n in nodes]
            self.by_node = [np.zeros((slots.cells(number, n), slots.k)) for n in nodes]
        else:
            self.cells = table.cells()
            shape = len(table.upper) - slots.n_features, self.m * (1 if self.boosted else slots.k)
            self.all = [np.zeros(shape) for _ in range(2 if self.boosted else 1)]

    def add(self, block: Block) -> None:
        slot = self.which[self.tree.place(block.rows, block.above)]
        if self.boosted:
            y = np.where(block.label == self.plan.label, 1.0, -1.0)
            if self.before:
                y = 4 * y / (1 + np.exp(2 * y * margins(self.before, [t.place(block.rows, block.above) for t in self.before])))
            for i, w in enumerate((None, y, y * y)):
                self.total[:, i] += np.bincount(slot, w, self.m + 1)[:self.m]
            column, width, weights = slot, self.m, (None, y)
        else:
            k = self.slots.k
            w = block.weight[self.plan.bag_at].astype(float) if self.plan.bag >= 0 else None
            column, width, weights = slot * k + np.where(slot < self.m, block.label, 0), self.m * k, (w,)
            self.total += np.bincount(column, w, width + 1)[:width].reshape(self.m, k)
            if self.plan.tried:
                return self.add_tried(block, slot, w)
        over = 0 if self.boosted and self.everywhere else 1  # a column for rows elsewhere
        at = self.cells[block.bin]
        for held, found in zip(self.all, block.sums(column, width + over, weights), strict=True):
            held[at] += found[:, :width]

    def add_tried(self, block: Block, slot: np.ndarray, weight: np.ndarray | None) -> None:
        table, k = self.slots.table, self.slots.k
        for i, (chosen, held) in enumerate(zip(self.chosen, self.by_node, strict=True)):
            low, high = (np.searchsorted(block.bin, table.start[chosen + j]) for j in (0, 1))
            found = spans(low, high)
            row = block.row[spans(block.begin[found], block.begin[found + 1])]
            of = np.repeat(np.arange(len(chosen)), high - low)
            other = self.slots.width[chosen] - 1
            bins, feature = block.bin[found], chosen[of]
            cell = (np.cumsum(other) - other)[of] + bins - table.start[feature] - (bins > table.zero[feature])
            cell = np.repeat(cell, block.count[found])
            here = slot[row] == i
            row, cell = row[here], cell[here]
            np.add.at(held.reshape(-1), cell * k + block.label[row], 1.0 if weight is None else weight[row])

    def by_slot(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sums by cell, total) of each open node."""
        k = self.slots.k
        for i in range(self.m):
            if self.plan.tried:
                yield self.by_node[i], self.total[i]
            elif self.boosted:
                yield np.stack([x[:, i] for x in self.all], axis=1), self.total[i]
            else:
                yield np.ascontiguousarray(self.all[0][:, i * k:(i + 1) * k]), self.total[i]


def grow(blocks: DataFrame, table: Table, plans: Sequence[Plan], classes: int, before: Sequence[Sequence[Tree]] = ()) -> list[Tree]:
    """The trees of the plans, all of classes or all boosted, over the rows of
    the blocks; ``before``: the boosted trees so far."""
    spark, slots = blocks.sparkSession, Slots(table, plans, classes)
    before = before or [[] for _ in plans]
    trees, k = [Tree() for _ in plans], slots.k
    waiting = [(t, 0, 0) for t in range(len(plans))]
    while waiting:
        taken, total = [], 0
        while waiting and (not taken or total + slots.cells(*waiting[0][:2]) * k <= CELLS):
            taken.append(waiting.pop(0))
            total += slots.cells(*taken[-1][:2]) * k
        sent = spark.sparkContext.broadcast((slots, trees, taken, before))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, trees, taken, before = sent.value
            mine: dict[int, list[int]] = {}
            for slot, (t, _, _) in enumerate(taken):
                mine.setdefault(t, []).append(slot)
            sums = {t: Sums(slots, t, trees[t], [taken[s][1] for s in own], before[t]) for t, own in mine.items()}
            for block in Block.each(slots.table, batches):
                for s in sums.values():
                    if s.plan.fold != block.fold:
                        s.add(block)
            task = TaskContext.get().partitionId()
            for t, own in mine.items():
                for slot, (cells, whole) in zip(own, sums.pop(t).by_slot(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([task]), pa.array([cells.tobytes()]), pa.array([whole.tobytes()])],
                                                     names=["slot", "task", "cells", "whole"])

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows of a node come one after the other."""
            slots, _, taken, _ = sent.value
            slot, cells, whole = -1, np.zeros(0), np.zeros(0)

            def found() -> pa.RecordBatch:
                tree, node, _ = taken[slot]
                feature, cut, left, right = slots.best(tree, node, cells.reshape(-1, k), whole)
                return pa.RecordBatch.from_arrays([pa.array([x]) for x in (slot, feature, cut, whole.tolist(), left.tolist(), right.tolist())],
                                                  names=["slot", "feature", "cut", "whole", "left", "right"])

            for batch in batches:
                for i in range(batch.num_rows):
                    parts = [np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("cells", "whole")]
                    if (now := batch.column("slot")[i].as_py()) == slot:
                        cells += parts[0]
                        whole += parts[1]
                        continue
                    if slot >= 0:
                        yield found()
                    slot, cells, whole = now, parts[0].copy(), parts[1].copy()
            if slot >= 0:
                yield found()

        sums = blocks.mapInArrow(add_up, "slot bigint, task bigint, cells binary, whole binary")
        sums = sums.repartition(min(len(taken), spark.sparkContext.defaultParallelism), "slot").sortWithinPartitions("slot", "task")
        best = sums.mapInArrow(split, "slot bigint, feature bigint, cut double, whole array<double>, left array<double>, right array<double>")
        for r in sorted(best.collect(), key=lambda r: r["slot"]):  # a row for each open node
            t, node, depth = taken[r["slot"]]
            tree, whole = trees[t], np.array(r["whole"])
            tree.stats[node] = r["whole"][:k]
            if r["feature"] < 0:
                continue
            tree.feature[node], tree.cut[node], tree.left[node] = r["feature"], r["cut"], tree.add(list(r["left"]))
            tree.add(list(r["right"]))
            sides = np.array([r["left"], r["right"]])
            if plans[t].label < 0:
                mixed = impurity(sides)[1] > NO_GAIN
            else:  # what variance the two sides leave together
                mixed = np.repeat((whole[2] - explained(sides).sum()) / max(whole[0], 1) > NO_GAIN, 2)
            for child, open_ in zip((tree.left[node], tree.left[node] + 1), mixed, strict=True):
                if depth + 1 < plans[t].depth and open_:
                    waiting.append((t, child, depth + 1))
        sent.destroy()
    return trees


@dataclass
class Model:
    """Trees whose leaf shares are added up and divided (``boosted`` false), or
    for each class its boosted trees, whose margins are the raw scores."""

    boosted: bool
    n_features: int
    classes: int
    trees: list[list[Tree]]

    def scores(self, leaves: Iterator[np.ndarray]) -> np.ndarray:
        """By row and class, from the rows' leaves of each tree in turn."""
        if self.boosted:
            return np.stack([margins(ts, [next(leaves) for _ in ts]) for ts in self.trees], axis=1)
        out: np.ndarray | float = 0.0
        for t in self.trees[0]:
            stats = np.array([s or [0.0] * self.classes for s in t.stats])
            out = out + (stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300))[next(leaves)]
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)

    def save(self, spark: SparkSession, path: str) -> None:
        """A table with a row for each node."""
        rows = [(self.boosted, self.n_features, self.classes, c, i, n, t.feature[n], t.cut[n], t.left[n], t.stats[n])
                for c, ts in enumerate(self.trees) for i, t in enumerate(ts) for n in range(len(t.feature))]
        spark.createDataFrame(rows, "boosted boolean, n_features int, classes int, class int, tree int, node int, feature int, "
                                    "cut double, left int, stats array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).orderBy("class", "tree", "node").collect()
        trees: dict[int, dict[int, Tree]] = {}
        for r in rows:
            t = trees.setdefault(r["class"], {}).setdefault(r["tree"], Tree([], [], [], []))
            t.add(list(r["stats"]))
            t.feature[-1], t.cut[-1], t.left[-1] = r["feature"], r["cut"], r["left"]
        return cls(rows[0]["boosted"], rows[0]["n_features"], rows[0]["classes"], [list(ts.values()) for ts in trees.values()])


def scores_of(models: Sequence[Model], rows: Values | Block, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All models' scores side by side for the rows that differ in the leaf of
    a tree (or a label), the first row of each kind, and the kind of each row."""
    trees = [t for m in models for ts in m.trees for t in ts]
    leaves = [t.place(rows.rows, rows.above) for t in trees]
    kind, kinds = np.zeros(rows.rows, np.int64), 1
    for x, n in [*zip(leaves, (len(t.feature) for t in trees), strict=True), *((x, int(x.max(initial=0)) + 1) for x in labels)]:
        if kinds * n >= 2**62:
            kind = np.unique(kind, return_inverse=True)[1]
            kinds = int(kind.max(initial=0)) + 1
        kind, kinds = kind * n + x, kinds * n
    _, one, kind = np.unique(kind, return_index=True, return_inverse=True)
    each = iter([x[one] for x in leaves])
    return np.concatenate([m.scores(each) for m in models], axis=1), one, kind


def scored(df: DataFrame, models: Sequence[Model], features: str, out: str) -> DataFrame:
    """``df`` plus an array of all models' scores, side by side."""
    sent = df.sparkSession.sparkContext.broadcast(list(models))

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        models = sent.value
        trees = [t for m in models for ts in m.trees for t in ts]
        for index, value in batches:
            row, feature = flat(index)
            rows = Values(trees, models[0].n_features, len(index), row, feature.astype(np.int64), flat(value)[1])
            scores, _, kind = scores_of(models, rows)
            yield listed(scores[kind])

    _, index, value = entries(features)
    return df.withColumn(out, run(index, value))


def listed(rows: np.ndarray) -> pa.Array:
    """A list of numbers a row."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.reshape(-1))


def held_out_scores(packed: Packed, held_out: Sequence[Sequence[Model]]) -> DataFrame:
    """(label, scores, rows): the scores of every row by the models of the fold
    that left it out.  A block's rows of one label that come to the same leaf
    of every tree are one row here, with their number."""
    sent = packed.blocks.sparkSession.sparkContext.broadcast((packed.table, [list(models) for models in held_out]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held_out = sent.value
        for block in Block.each(table, batches):
            scores, one, kind = scores_of(held_out[block.fold], block, block.label)
            yield pa.RecordBatch.from_arrays([pa.array(block.label[one].astype(float)), listed(scores), pa.array(np.bincount(kind))],
                                             names=["label", "scores", "rows"])

    return packed.blocks.mapInArrow(run, "label double, scores array<double>, rows bigint")


@dataclass
class Packed:
    """The rows of a fit in blocks, once for all trees."""

    blocks: DataFrame
    table: Table
    classes: int


def packed(df: DataFrame, label: str, features: str, fold: str, seed: int, forest: int = 5) -> Packed:
    ensure_checkpoint_dir(df.sparkSession)
    size, index, value = entries(features)
    data = df.select(F.monotonically_increasing_id().alias("uid"), F.col(fold).cast("int").alias("fold"),
                     F.col(label).cast("int").alias("label"), size.alias("size"), index.alias("features"), value.alias("values")).checkpoint()
    shape = data.agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("label").alias("label")).first()
    table = table_of(data, shape["size"], shape["n"])
    return Packed(pack(data, table, [seed + i for i in range(forest)]), table, shape["label"] + 1)


def fit_stack(df: DataFrame, label: str, features: str, fold: str, folds: int, seed: int, forest: int = 5, rounds: int = 5,
              depth: int = 5, boosted_depth: int = 3) -> list[list[Model]]:
    """For each fold left out, and last for all rows: a bagged forest, one
    tree, and one-vs-rest boosted trees."""
    return stack_of(packed(df, label, features, fold, seed, forest), folds, seed, forest, rounds, depth, boosted_depth)


def stack_of(rows: Packed, folds: int, seed: int, forest: int = 5, rounds: int = 5, depth: int = 5,
             boosted_depth: int = 3) -> list[list[Model]]:
    """:func:`fit_stack` over packed rows."""
    classes, n = rows.classes, len(rows.table.zero)
    tried = math.ceil(math.sqrt(n)) if forest > 1 else 0
    fits = [*range(folds), -1]
    plans = [p for f in fits for p in (*(Plan(f, depth, bag=seed + i, bag_at=i, tried=tried) for i in range(forest)), Plan(f, depth))]
    grown = grow(rows.blocks, rows.table, plans, classes)
    boosted: list[list[Tree]] = [[] for _ in range(len(fits) * classes)]
    for _ in range(rounds):
        steps = grow(rows.blocks, rows.table, [Plan(f, boosted_depth, label=c) for f in fits for c in range(classes)], classes, boosted)
        boosted = [[*b, t] for b, t in zip(boosted, steps, strict=True)]
    out = []
    for i in range(len(fits)):
        own = grown[i * (forest + 1) : (i + 1) * (forest + 1)]
        out.append([Model(False, n, classes, [own[:forest]]), Model(False, n, classes, [own[forest:]]),
                    Model(True, n, classes, boosted[i * classes : (i + 1) * classes])])
    return out
