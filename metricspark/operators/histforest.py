"""Random forests of bounded depth for many rows.

The forest is the one that MLlib fits: at most 32 bins a feature, cut between values of a sample of some 10,000
rows, rows drawn for each tree with Poisson weights of mean 1, all features at every split, the largest decrease
of the variance, the mean of the trees.  The fit is laid out for many rows: they are binned once (one byte a
feature) and stored in blocks; a level of all trees is one pass, in which each task counts its blocks feature by
feature, only for the smaller child of each split (the other one is its parent less this); histograms are added
by tree and feature.  The driver gets the chosen splits only.

Labels are rounded to 2^-32 of their spread, so sums are whole numbers and do not depend on the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored

BINS = 32
#: Rows of a block at most; sums of its labels are exact in a double.
BLOCK_ROWS = 1 << 17
#: Rows, as expected, whose values give the cuts (MLlib's number).
CUT_ROWS = 10_000
#: Whole numbers that a label's spread makes.
UNITS = 2.0 ** 32
#: Bytes of histograms that a task adds up.
PART_BYTES = 1 << 26
#: A cut that no bin is above.
LEAF = 255
#: Shares of Poisson(1) up to 0, 1, 2, ... 7 draws.
DRAWN = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(8)]).astype(np.float32)

BLOCKS = "block long, n int, bins binary, y binary"
HISTOGRAM = "tree int, feature int, parent boolean, hist binary"
FOUND = "tree int, feature int, hist binary, gain binary, sums binary"
CHOSEN = "tree int, feature binary, gain binary, sums binary"


def cuts(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Between all neighbours of few distinct values, else where the bins' counts come nearest to equal ones."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(v) < 2:
        return np.zeros(0)
    between = v[:-1] / 2 + v[1:] / 2
    if len(v) > bins:
        stride = n.sum() / bins
        target, total, at = stride, n.cumsum(), []
        for i in range(1, len(v)):
            if abs(total[i - 1] - target) < abs(total[i] - target):
                at.append(i - 1)
                target += stride
        between = between[at]
    return between[~np.isnan(between)][:bins - 1]


def binned(x: np.ndarray, splits: list[np.ndarray]) -> np.ndarray:
    """Bins of rows, a row of the result per feature; bin <= b where x <= cut b.  Missing values (in rows to be
    predicted) come last."""
    out = np.empty((x.shape[1], len(x)), np.uint8)
    for f, s in enumerate(splits):
        out[f] = np.searchsorted(s, x[:, f])
    return out


def drawn(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    """How often each row of a block stands in a tree's sample."""
    u = np.random.default_rng((seed, block, tree)).random(n, dtype=np.float32)
    out = np.zeros(n, np.uint8)
    for bound in DRAWN:
        out += u >= bound
    return out


@dataclass
class Tree:
    """Nodes as arrays; a leaf leads to itself.  ``open`` are the nodes of the newest level."""
    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, LEAF, np.uint8))
    child: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    split: np.ndarray | None = None     # places in the level before whose nodes were split
    small: np.ndarray | None = None     # the smaller child of each (0: left)

    def reached(self, by_row: np.ndarray, rows: np.ndarray, steps: int) -> np.ndarray:
        """Nodes of rows of a block (its bins, a row's together) after so many steps.  The right child comes next to
        the left one, and no bin is above a leaf's cut."""
        flat, begin, at = by_row.reshape(-1), rows * by_row.shape[1], np.zeros(len(rows), np.int64)
        left = self.child[::2].copy()
        for _ in range(steps):
            right = flat.take(self.feature.take(at) + begin) > self.cut.take(at)
            at = left.take(at) + right
        return at

    def counted(self) -> tuple[np.ndarray, int]:
        """The place of each node whose rows are counted (-1: none), and how many there are."""
        place = np.full(len(self.feature), -1)
        nodes = self.open if self.small is None else self.open[2 * np.arange(len(self.small)) + self.small]
        place[nodes] = np.arange(len(nodes))
        return place, len(nodes)

    def grow(self, feature: np.ndarray, gain: np.ndarray, sums: np.ndarray) -> None:
        """Split the open nodes that gain; their children are open next."""
        cut, n, s, n_left, s_left = sums
        if self.small is None:
            self.value[0] = s[0] / max(1, n[0])
        at = np.flatnonzero(gain > 0.25)     # a pure node's gain is below, but for rounding it is 0
        nodes, made = self.open[at], len(self.feature) + np.arange(2 * len(at))
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature[at], cut[at], gain[at]
        self.child[2 * nodes], self.child[2 * nodes + 1] = made[::2], made[1::2]
        n2 = np.stack([n_left[at], n[at] - n_left[at]], axis=1)
        s2 = np.stack([s_left[at], s[at] - s_left[at]], axis=1)
        self.feature = np.append(self.feature, np.zeros(len(made), np.int64))
        self.cut = np.append(self.cut, np.full(len(made), LEAF, np.uint8))
        self.child = np.append(self.child, made.repeat(2))
        self.value = np.append(self.value, (s2 / n2).reshape(-1))
        self.gain = np.append(self.gain, np.zeros(len(made)))
        self.open, self.split, self.small = made, at, (n2[:, 1] < n2[:, 0]).astype(np.int64)


@dataclass
class HistForest:
    features: list[str]
    splits: list[np.ndarray]
    trees: list[Tree]
    depth: int
    base: float      # a prediction is base + unit * the mean of the trees' values
    unit: float

    def predict(self, df: DataFrame, keep: Sequence[str] = (), name: str = "prediction") -> DataFrame:
        """Kept columns (none named: all) and the mean of the trees' predictions."""
        spark, keep = df.sparkSession, list(keep or df.columns)
        ship_package(spark)
        rows = df.select(*keep, _array(self.features))
        shared = spark.sparkContext.broadcast((self.splits, self.trees, self.depth, self.base, self.unit))

        def run(batches):
            splits, trees, depth, base, unit = shared.value
            for b in batches:
                bins = np.ascontiguousarray(binned(_matrix(b.column("__x"), len(splits)), splits).T)
                each, total = np.arange(b.num_rows), np.zeros(b.num_rows)
                for t in trees:
                    total += t.value.take(t.reached(bins, each, depth))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(base + unit * total / len(trees))],
                                                 names=[*keep, name])

        return rows.mapInArrow(run, df.select(*keep, F.lit(0.0).alias(name)).schema)

    def importances(self) -> np.ndarray:
        """Share of each feature in the decrease of the squared error, the mean of the trees' shares; sums to 1
        unless no tree has a split."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            if t.gain.any():
                out += np.bincount(t.feature, t.gain, minlength=len(out)) / t.gain.sum()
        return out / out.sum() if out.any() else out


def _array(features: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in features]).alias("__x")


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(rows: DataFrame, splits: list[np.ndarray], n: int, base: float, unit: float) -> DataFrame:
    """Binned rows in blocks, dealt evenly to the cores.  The order of rows in a block does not depend on the
    shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        part, number, xs, ys, held = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            y = np.concatenate(ys)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + number]), pa.array([len(y)], pa.int32()), pa.array([np.concatenate(xs, axis=1).tobytes()], pa.binary()),
                 pa.array([y.tobytes()], pa.binary())], names=["block", "n", "bins", "y"])

        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(begin, BLOCK_ROWS)
                if held and held + b.num_rows > BLOCK_ROWS:
                    yield block()
                    number, xs, ys, held = number + 1, [], [], 0
                x = _matrix(b.column("__x"), len(splits))
                if not np.isfinite(x).all():
                    raise ValueError("a feature is missing or not finite")
                xs.append(binned(x, splits))
                ys.append(np.rint((b.column("__y").to_numpy() - base) / unit))
                held += b.num_rows
        if held:
            yield block()

    dealt = rows.repartition(cores * -(-n // (cores * BLOCK_ROWS))).sortWithinPartitions("__y", "__x")
    return stored(dealt.mapInArrow(run, BLOCKS), "forest-blocks")


def _counted(blocks: DataFrame, shared, width: int, level: int, seed: int, bootstrap: bool) -> DataFrame:
    """Histograms (drawn rows and sum of their labels by node and bin) of each task's blocks, a row per tree and
    feature."""
    def run(batches):
        held = [(k, bins, np.ascontiguousarray(bins.T), np.frombuffer(y)) for b in batches
                for k, n, x, y in zip(*(b.column(c).to_pylist() for c in ("block", "n", "bins", "y")))
                for bins in (np.frombuffer(x, np.uint8).reshape(width, n),)]
        for number, tree in enumerate(shared.value if held else []):
            place, nodes = tree.counted()
            if not nodes:
                continue
            out = np.zeros((width, 2, nodes * BINS), np.int64)
            for block, bins, by_row, y in held:
                w = drawn(seed, block, number, len(y)) if bootstrap else np.ones(len(y), np.uint8)
                rows = np.flatnonzero(w)
                at = place.take(tree.reached(by_row, rows, level))
                use = at >= 0
                rows, at = rows[use], at[use] * BINS
                w = w.take(rows).astype(np.float64)
                wy = w * y.take(rows)
                for f in range(width):
                    cell = at + bins[f].take(rows)
                    out[f, 0] += np.bincount(cell, w, nodes * BINS).astype(np.int64)
                    out[f, 1] += np.bincount(cell, wy, nodes * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([False] * width),
                 pa.array([h.tobytes() for h in out], pa.binary())], names=["tree", "feature", "parent", "hist"])

    return blocks.mapInArrow(run, HISTOGRAM)


def _found(counted: DataFrame, before: DataFrame | None, shared, last: bool, parts: int) -> DataFrame:
    """The open nodes' histograms by tree and feature, and the best cut of each.  A task adds up what comes, so it
    holds its share of the level's histograms, whatever the number of tasks that counted."""
    def run(batches):
        counts, parents = {}, {}
        for b in batches:
            for *key, is_parent, h in zip(*(b.column(c).to_pylist() for c in ("tree", "feature", "parent")), b.column("hist")):
                h, key = np.frombuffer(h.as_buffer(), np.int64).reshape(2, -1, BINS), tuple(key)
                if is_parent:
                    parents[key] = h.copy()
                elif key in counts:
                    counts[key] += h
                else:
                    counts[key] = h.copy()
        for key in sorted(counts):
            tree, all_ = shared.value[key[0]], counts.pop(key)
            if key in parents:
                parent, small, each = parents.pop(key), all_, np.arange(len(tree.split))
                all_ = np.empty((2, len(each), 2, BINS), np.int64)
                all_[:, each, tree.small] = small
                all_[:, each, 1 - tree.small] = parent[:, tree.split] - small
                all_ = all_.reshape(2, -1, BINS)
            left = all_.cumsum(axis=2)
            n, s = left[:, :, -1]
            n_left, s_left = left[:, :, :-1]
            n_right = n[:, None] - n_left
            off = s_left - n_left * (s / np.maximum(n, 1))[:, None]
            gain = np.where((n_left > 0) & (n_right > 0),
                            off * off * (n[:, None] / np.maximum(n_left * n_right.astype(np.float64), 1.0)), -1.0)
            k, each = gain.argmax(axis=1), np.arange(len(n))
            sums = np.stack([k, n, s, n_left[each, k], s_left[each, k]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int32()) for v in key]
                + [pa.array([v], pa.binary()) for v in (b"" if last else all_.tobytes(), gain[each, k].tobytes(), sums.tobytes())],
                names=["tree", "feature", "hist", "gain", "sums"])

    if before is not None:
        counted = counted.unionByName(before.select("tree", "feature", F.lit(True).alias("parent"), "hist"))
    return stored(counted.repartition(parts, "tree", "feature").mapInArrow(run, FOUND), "forest-level")


def _chosen(found: DataFrame) -> DataFrame:
    """The best feature of each open node, a row per tree; the first of equals."""
    def run(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("feature")
        gains = np.stack([np.frombuffer(g) for g in part.column("gain").to_pylist()])
        sums = np.stack([np.frombuffer(s, np.int64).reshape(5, -1) for s in part.column("sums").to_pylist()])
        best, each = gains.argmax(axis=0), np.arange(gains.shape[1])
        feature = part.column("feature").to_numpy()[best].astype(np.int64)
        return pa.Table.from_arrays(
            [pa.array([group[0].as_py()], pa.int32())]
            + [pa.array([v.tobytes()], pa.binary()) for v in (feature, gains[best, each], np.ascontiguousarray(sums[best, :, each].T))],
            names=["tree", "feature", "gain", "sums"])

    return found.select("tree", "feature", "gain", "sums").groupBy("tree").applyInArrow(run, CHOSEN)


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10, bootstrap: bool = True,
        seed: int = 42) -> HistForest:
    """Fit a forest.  Labels and features must have finite values, as in MLlib."""
    spark, features = df.sparkSession, list(features)
    ship_package(spark)
    rows = df.select(_array(features), F.col(label).cast("double").alias("__y"))
    y = F.col("__y")
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))).alias("bad"),
                  F.avg(y).alias("mean"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    if not st["n"] or st["bad"]:
        raise ValueError("no rows" if not st["n"] else f"{st['bad']} labels are missing or not finite")
    n, base = st["n"], st["mean"]
    unit = (max(st["hi"] - base, base - st["lo"]) or 1.0) / UNITS
    sample = rows.sample(fraction=CUT_ROWS / n, seed=seed) if n > CUT_ROWS else rows
    x = np.array([r[0] for r in sample.select("__x").collect()], dtype=np.float64).reshape(-1, len(features))
    splits = [cuts(c) for c in x.T]
    blocks = _blocks(rows, splits, n, base, unit)
    counting, cores = blocks.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    grown, found = [Tree() for _ in range(trees)], None
    for level in range(depth):
        shared = spark.sparkContext.broadcast(grown)
        counted = _counted(blocks, shared, len(features), level, seed, bootstrap)
        size = sum(t.counted()[1] for t in grown) * len(features) * 2 * BINS * 8
        found = _found(counted, found, shared, level == depth - 1, max(4 * cores, size * (counting + 1) // PART_BYTES))
        chosen = {r["tree"]: r for r in _chosen(found).collect()}
        shared.unpersist()
        for number, tree in enumerate(grown):
            if number in chosen:
                r = chosen[number]
                tree.grow(np.frombuffer(r["feature"], np.int64), np.frombuffer(r["gain"]), np.frombuffer(r["sums"], np.int64).reshape(5, -1))
            else:
                tree.open = tree.split = tree.small = np.zeros(0, np.int64)
        if not any(len(t.open) for t in grown):
            break
    return HistForest(features, splits, grown, depth, base, unit)
