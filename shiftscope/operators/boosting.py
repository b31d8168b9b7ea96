"""Gradient boosted trees, grown level by level on histograms of binned features.

The loss, splits and leaves are those of MLlib's GBTClassifier and GBTRegressor, with all rows in every tree. Features are binned once. A task keeps its rows as
blocks of small integers and counts them with numpy; only the smaller child of a node is counted, the other is what is left of the parent.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, functions as F

from shiftscope.session import shared_dir

DEPTH = 5
BLOCK = 1 << 17  # rows that are counted together
TASK_LEAST, TASK_MOST = 1 << 15, 1 << 22  # rows of a task
NOISE = 1e-13  # a gain below this part of what it is the difference of comes from rounding
SAVED = 20  # trees after which the margins are written, so that a lost executor costs few trees


# ---------------------------------------------------------------- bins
def cut_points(values: np.ndarray, weights: np.ndarray, total: float, bins: int) -> np.ndarray:
    """Thresholds of a feature: between all neighbouring values, or where the weight passes the next ``bins``-th part of ``total``."""
    some = values != 0
    seen, back = np.unique(values[some], return_inverse=True)
    weight = np.bincount(back, weights[some], minlength=len(seen))
    zero = total - weight.sum()
    if zero > np.finfo(float).eps * len(values) * 100:
        at = np.searchsorted(seen, 0.0)
        seen, weight = np.insert(seen, at, 0.0), np.insert(weight, at, zero)
    between = (seen[:-1] + seen[1:]) / 2
    if len(between) < bins:
        return between
    stride, upto, cuts = total / bins, np.cumsum(weight), []
    target = stride
    for k in range(len(between)):
        if abs(upto[k] - target) < abs(upto[k + 1] - target):
            cuts.append(between[k])
            target += stride
    return np.array(cuts)


def _matrix(features: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """[feature, row] of a list column."""
    flat = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).T if len(flat) else np.zeros((0, 0))


def _binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The bins of every feature, as small as they go."""
    return [np.searchsorted(c, v).astype(np.min_scalar_type(len(c))) for c, v in zip(cuts, x)]


def _small(y: np.ndarray) -> np.ndarray:
    """Labels in single precision where that is exact."""
    single = y.astype(np.float32)
    return single if np.array_equal(single, y) else y


# ---------------------------------------------------------------- trees
class Tree:
    """A tree of depth DEPTH: node k has the children 2k + 1 and 2k + 2, a node without a split sends all rows to the left."""

    def __init__(self):
        self.feature = np.full(2**DEPTH - 1, -1, np.int16)
        self.split = np.zeros(2**DEPTH - 1, np.int32)
        self.value = np.zeros(2 ** (DEPTH + 1) - 1)

    def place(self, bins: Sequence[np.ndarray], depth: int) -> np.ndarray:
        """The place of every row among the nodes of a level."""
        place = np.zeros(len(bins[0]), np.uint8)
        for d in range(depth):
            right = np.zeros(len(place), bool)
            for k in range(2**d):
                node = 2**d - 1 + k
                if self.feature[node] >= 0:
                    right |= (place == k) & (bins[self.feature[node]] > self.split[node])
            place = 2 * place + right
        return place

    def values(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        return self.value[2**DEPTH - 1 :].take(self.place(bins, DEPTH))


def _residuals(margin: np.ndarray | None, y: np.ndarray, classify: bool) -> np.ndarray:
    """What the next tree is fitted to: the labels at first, then the gradient of log-loss or of the squared error."""
    y = y.astype(float)
    if margin is None:
        return y
    return 4 * y / (1 + np.exp(2 * y * margin)) if classify else 2 * (y - margin)


def _count(bins: Sequence[np.ndarray], group: np.ndarray, groups: int, y: np.ndarray, sizes: np.ndarray, place: np.ndarray, nodes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of y) by [node, group, bin of every feature]."""
    ends = np.cumsum(sizes)
    rows, sums = np.zeros((len(nodes), groups, ends[-1]), np.int64), np.zeros((len(nodes), groups, ends[-1]))
    for i, node in enumerate(nodes):
        for g in range(groups):
            at = np.flatnonzero((place == node) & (group == g))
            if not len(at):
                continue
            own = y.take(at)
            for b, end, size in zip(bins, ends, sizes):
                cell = b.take(at).astype(np.int64)
                rows[i, g, end - size : end] = np.bincount(cell, minlength=size)
                sums[i, g, end - size : end] = np.bincount(cell, own, minlength=size)
    return rows, sums


def _best_split(rows: np.ndarray, sums: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> tuple[int, int, float, float, float] | None:
    """(feature, last bin of the left side, value left, value right, rows left) with the largest gain, the first of equal ones; none without a gain."""
    weight, total, n = weights @ rows, weights @ sums, rows.sum(axis=0)
    best, found = NOISE * float(total[: sizes[0]].sum()) ** 2 / float(weight[: sizes[0]].sum()), None
    for f, end in enumerate(np.cumsum(sizes)):
        own = slice(end - sizes[f], end)
        w, s, c = (np.cumsum(x[own]) for x in (weight, total, n))
        inside = (c[:-1] > 0) & (c[:-1] < c[-1])
        if not inside.any():
            continue
        lw, ls = np.where(inside, w[:-1], 1.0), s[:-1]
        rw, rs = np.where(inside, w[-1] - w[:-1], 1.0), s[-1] - ls
        gain = np.where(inside, ls * ls / lw + rs * rs / rw - s[-1] * s[-1] / w[-1], -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = float(gain[k]), (f, k, float(ls[k] / lw[k]), float(rs[k] / rw[k]), int(c[k]))
    return found


class Boosted(Transformer):
    """The trees as a transformer: prediction and, for classes, probability of the column ``features``."""

    def __init__(self, cuts: Sequence[np.ndarray], trees: Sequence[Tree], steps: Sequence[float], classify: bool):
        super().__init__()
        self.cuts, self.trees, self.steps, self.classify = cuts, trees, steps, classify

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, trees, steps = self.cuts, self.trees, self.steps

        @F.arrow_udf("double")
        def margin(features: pa.Array) -> pa.Array:
            total = np.zeros(len(features))
            if len(features):
                bins = _binned(_matrix(features), cuts)
                for tree, step in zip(trees, steps):
                    total += step * tree.values(bins)
            return pa.array(total)

        found = dataset.withColumn("_margin", margin(vector_to_array("features")))
        if self.classify:
            one = 1 / (1 + F.exp(-2 * F.col("_margin")))
            found = found.withColumns({"probability": array_to_vector(F.array(1 - one, one)), "prediction": (F.col("_margin") > 0).cast("double")})
        else:
            found = found.withColumn("prediction", F.col("_margin"))
        return found.drop("_margin")


# ---------------------------------------------------------------- training
def _blocks(rows: DataFrame, cuts: Sequence[np.ndarray]) -> RDD:
    """Binned rows (bins, labels, groups) in blocks, dealt evenly to all cores."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            packed = _binned(_matrix(table["x"]), cuts), _small(table["y"].to_numpy()), table["g"].to_numpy().astype(np.uint8)
            return pa.record_batch([pa.array([pickle.dumps(packed)], pa.binary())], ["block"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                yield block()
                held = []
        if sum(map(len, held)):
            yield block()

    packed = rows.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    return packed._reserialize(_ONE).persist(StorageLevel.MEMORY_AND_DISK_DESER)


_ONE = BatchedSerializer(CPickleSerializer(), 1)  # blocks are large, and RDDs of one batch size meet without another pass


def _delete(margins: RDD | None) -> None:
    """Delete the written copy of margins."""
    if margins is not None and (file := margins.getCheckpointFile()):
        path = margins.ctx._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(margins.ctx._jsc.hadoopConfiguration()).delete(path, True)


def boost(data: DataFrame, label: str, weights: Sequence[float], classify: bool, trees: int, step: float, bins: int, seed: int = 0) -> Boosted:
    """Boosted trees over the vector column ``features``. Classes 0 and 1 have the two ``weights``; numbers have one for all rows."""
    spark, weights = data.sparkSession, np.array(weights, float)
    group = F.col(label).cast("int") if classify else F.lit(0)
    y = (2 * F.col(label) - 1 if classify else F.col(label)).cast("double")
    rows = data.select(vector_to_array("features").alias("x"), y.alias("y"), group.alias("g"))
    bad = ~F.col("g").isin(0, 1) | ~F.col("y").isin(-1.0, 1.0) if classify else F.isnan("y")
    found = rows.agg(F.count("*"), F.count_if(F.coalesce(bad | F.col("y").isNull(), F.lit(True))), *[F.count_if(F.col("g") == g) for g in range(len(weights))]).first()
    n, wrong, per_group = found[0], found[1], np.array(found[2:], float)
    if not n or wrong:
        raise ValueError(f"{label}: {wrong} of {n} rows have no usable label")
    cores = spark.sparkContext.defaultParallelism
    # a pass of few rows is over sooner than its tasks start; with many, a task keeps the blocks of a few million
    rows = rows.repartition(min(cores, -(-n // TASK_LEAST)) if n <= cores * TASK_MOST else cores * -(-n // (cores * TASK_MOST)))

    # as many rows as MLlib finds its thresholds on
    bins = min(bins, n)
    need = max(bins * bins, 10_000)
    share = min(1.0, need / n)
    seen = (rows if share == 1.0 else rows.sample(share, seed)).select("x", "g").toArrow()
    of, total = weights[seen["g"].to_numpy()], share * float(weights @ per_group)
    cuts = [cut_points(v, of, total, bins) for v in _matrix(seen["x"])]
    sizes = np.array([len(c) + 1 for c in cuts])

    shared_dir(spark)
    blocks, grown, steps = _blocks(rows, cuts), [], []
    margins = before = saved = None
    for m in range(trees):
        tree = Tree()
        _grow(tree, blocks, margins, weights, sizes, classify)
        if before is not None:  # the first level has made the margins from those before
            before.unpersist()
        if margins is not None and margins.isCheckpointed():
            _delete(saved)
            saved = margins
        grown.append(tree)
        steps.append(1.0 if m == 0 else step)
        if m < trees - 1:
            before, margins = margins, _advanced(blocks, margins, tree, steps[-1], m % SAVED == SAVED - 1)
    for rdd in (margins, blocks):
        if rdd is not None:
            rdd.unpersist()
    _delete(saved)
    return Boosted(cuts, grown, steps, classify)


def _advanced(blocks: RDD, margins: RDD | None, tree: Tree, step: float, save: bool) -> RDD:
    """Margins after one more tree, made along with the first level of the next one."""
    if margins is None:
        new = blocks.map(lambda b: step * tree.values(b[0]))
    else:
        new = blocks.zip(margins).map(lambda p: p[1] + step * tree.values(p[0][0]))
    new = new._reserialize(_ONE).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    if save:
        new.checkpoint()
    return new


def _counted(blocks: RDD, margins: RDD | None, tree: Tree, depth: int, nodes: Sequence[int], groups: int, sizes: np.ndarray, classify: bool) -> tuple[np.ndarray, np.ndarray]:
    def count(pairs):
        total = None
        for (bins, y, group), margin in pairs:
            own = _count(bins, group, groups, _residuals(margin, y, classify), sizes, tree.place(bins, depth), nodes)
            total = own if total is None else (total[0] + own[0], total[1] + own[1])
        return [] if total is None else [total]

    found = (blocks.map(lambda b: (b, None)) if margins is None else blocks.zip(margins)).mapPartitions(count).collect()
    return sum(f[0] for f in found), sum(f[1] for f in found)


def _grow(tree: Tree, blocks: RDD, margins: RDD | None, weights: np.ndarray, sizes: np.ndarray, classify: bool) -> None:
    """Find the splits of a tree, level by level; each level is one pass over the rows."""
    held: dict[int, tuple] = {}  # histograms of the nodes of a level
    wanted, others = [0], {}
    for depth in range(DEPTH):
        first = 2**depth - 1
        if wanted:
            rows, sums = _counted(blocks, margins, tree, depth, [w - first for w in wanted], len(weights), sizes, classify)
            new = {w: (rows[i], sums[i]) for i, w in enumerate(wanted)}
            for node, (parent, sibling) in others.items():
                left = held[parent][0] - new[sibling][0]
                new[node] = left, np.where(left > 0, held[parent][1] - new[sibling][1], 0.0)
            held = new
        else:
            held = {}
        wanted, others = [], {}
        for node in range(first, 2 * first + 1):
            left, right = 2 * node + 1, 2 * node + 2
            tree.value[left] = tree.value[right] = tree.value[node]
            if node not in held:
                continue
            rows, sums = held[node]
            if node == 0:
                own = slice(0, sizes[0])
                tree.value[0] = tree.value[left] = tree.value[right] = (weights @ sums[:, own]).sum() / (weights @ rows[:, own]).sum()
            if (split := _best_split(rows, sums, weights, sizes)) is None:
                continue
            tree.feature[node], tree.split[node], tree.value[left], tree.value[right], n = split
            small, large = (left, right) if 2 * n <= rows[:, : sizes[0]].sum() else (right, left)
            wanted.append(small)
            others[large] = node, small
