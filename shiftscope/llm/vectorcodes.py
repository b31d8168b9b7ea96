"""Product codes: exact k-means of vector parts on metric trees of the anchors hierarchy.

Vectors are cut into equal consecutive parts, and every part position has its own codebook. Vectors come in blocks of bounded size, as the
scan delivers them, and a block gets one tree of balls for every part position, once. A tree is built middle-out: anchors, each the point
farthest from the anchor that owns it, take over what lies nearer to them (the triangle inequality says which points to look at);
the anchors' balls are joined upwards, always the two that fit the smallest ball, and split downwards in the same way. A ball
caches count and sum of its points.

To assign points to codebook entries a list of candidate entries goes down the tree. An entry leaves the list where another one is nearer to
the whole ball; a ball whose list has one entry left belongs to it as a whole and gives its cached sum and count. Components are
integers, and all sums and the distances of points that are left over are exact; floating point only discards what is beaten by far.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shiftscope.llm.common import saved

#: Vectors and components of a block, at most; points of a ball that is not split.
BLOCK = 8192
BLOCK_SIZE = 4 << 20
LEAF = 48
#: Components below this are kept as machine integers, others as integers of any length.
PLAIN = 1 << 40
LIMB = 32


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value), exact for every finite double."""
    with np.errstate(over="ignore"):
        product = np.floor(values * scale)
    if not len(product) or np.abs(product).max() < PLAIN:
        return product.astype(np.int64)
    whole = [int(p) if math.isfinite(p) else math.floor(Fraction(v) * scale) for v, p in zip(values.tolist(), product.tolist())]
    return np.array(whole, object)


def _compact(x: np.ndarray) -> np.ndarray:
    if x.dtype == object or not x.size:
        return x
    return x.astype(np.result_type(np.min_scalar_type(int(x.min())), np.min_scalar_type(-abs(int(x.max())) - 1)))


def _top(*arrays: np.ndarray) -> int:
    return max((max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size), default=0)


def _floats(x: np.ndarray, shift: int) -> np.ndarray:
    """x / 2**shift, cut to whole numbers."""
    return np.asarray(x >> shift if shift else x, float)


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("...i,...i->...", x, x))


def _anchors(points: np.ndarray, count: int) -> np.ndarray:
    """The anchor (0, 1, ...) that owns each point; fewer than ``count`` only if there are fewer different points."""
    places, owner, far = [0], np.zeros(len(points), np.int64), _norm(points - points[0])
    while len(places) < count:
        new = int(far.argmax())
        if far[new] == 0:
            break
        apart = _norm(points[places] - points[new])
        near = np.flatnonzero(far > apart[owner] / 2)
        d = _norm(points[near] - points[new])
        won = d < far[near]
        owner[near[won]], far[near[won]] = len(places), d[won]
        places.append(new)
    return owner


class _Builder:
    """Balls over ``points``, children before parents; ``kids`` has two numbers or the rows of an unsplit ball."""

    def __init__(self, points: np.ndarray):
        self.points, self.kids, self.centre, self.radius, self.count = points, [], [], [], []

    def _add(self, kids, centre, radius, count) -> int:
        for to, value in zip((self.kids, self.centre, self.radius, self.count), (kids, centre, radius, count)):
            to.append(value)
        return len(self.kids) - 1

    def ball(self, rows: np.ndarray) -> int:
        points = self.points[rows]
        owner = _anchors(points, math.isqrt(len(rows) - 1) + 1) if len(rows) > LEAF else np.zeros(len(rows), int)
        if not owner.any():
            centre = points.mean(axis=0)
            return self._add(rows, centre, _norm(points - centre).max(), len(rows))
        return self._joined([self.ball(rows[owner == a]) for a in range(owner.max() + 1)])

    def _joined(self, nodes: list[int]) -> int:
        """Two balls at a time, those that fit the smallest ball, until one is left."""
        node = list(nodes)
        centre, radius = np.array([self.centre[i] for i in node]), np.array([self.radius[i] for i in node])
        around = np.array([self._around(centre, radius, i) for i in range(len(node))])
        for _ in range(len(node) - 1):
            i, j = divmod(int(around.argmin()), len(node))
            a, b = node[i], node[j]
            n = self.count[a] + self.count[b]
            middle = (self.centre[a] * self.count[a] + self.centre[b] * self.count[b]) / n
            reach = max(_norm(self.centre[k] - middle) + self.radius[k] for k in (a, b))
            node[i] = self._add((a, b), middle, reach, n)
            centre[i], radius[i], radius[j] = middle, reach, np.inf
            around[i] = around[:, i] = self._around(centre, radius, i)
            around[j] = around[:, j] = np.inf
        return node[i] if len(node) > 1 else node[0]

    @staticmethod
    def _around(centre: np.ndarray, radius: np.ndarray, i: int) -> np.ndarray:
        """Radius of the ball around ball i and each other one."""
        size = np.maximum((_norm(centre - centre[i]) + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
        size[i] = np.inf
        return size


def tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """The metric tree of one part: node 0 is the root, a node's points are ``order[start:end]``, ``left`` is -1 in unsplit balls."""
    shift = max(0, _top(x).bit_length() - 52)
    points = _floats(x, shift)
    built = _Builder(points)
    root = built.ball(np.arange(len(x)))
    number, order, spans, todo = {}, [], [], [(root, False)]
    at = 0
    while todo:  # depth first, so that every ball is one stretch of the order
        node, closed = todo.pop()
        if closed:
            spans[number[node]][1] = at
            continue
        number[node] = len(spans)
        spans.append([at, at])
        todo.append((node, True))
        kids = built.kids[node]
        if isinstance(kids, tuple):
            todo += [(kids[1], False), (kids[0], False)]
        else:
            order.append(kids)
            at += len(kids)
    place = sorted(number, key=number.get)
    kids = np.array([[number[k] for k in built.kids[n]] if isinstance(built.kids[n], tuple) else [-1, -1] for n in place], np.int32)
    order = np.concatenate(order).astype(np.int32)
    span = np.array(spans, np.int32)
    sums = np.zeros((len(x) + 1, x.shape[1]), object if x.dtype == object else np.int64)
    np.cumsum(x[order], axis=0, out=sums[1:], dtype=sums.dtype)
    centre = np.array([built.centre[n] for n in place]).reshape(len(place), -1)
    return {"order": order, "start": span[:, 0], "end": span[:, 1], "left": kids[:, 0], "right": kids[:, 1],
            "centre": centre, "radius": np.array([built.radius[n] for n in place]), "sums": sums[span[:, 1]] - sums[span[:, 0]], "shift": shift}


def _pairs(x: np.ndarray, entries: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """The nearest of the open entries of every row of x, exact, ties to the lower one."""
    row, entry = np.nonzero(open_)
    off = x[row] - entries[entry]
    squares = (off * off).sum(axis=1)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(squares, starts)
    hit = np.flatnonzero(squares == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    return entry[hit[np.unique(row[hit], return_index=True)[1]]]


def nearest(ball: dict[str, np.ndarray], x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(wholly owned balls, their entries, rows of the points left over, their entries)."""
    top = _top(x, entries)
    if 2 * (top.bit_length() + 1) + max(1, x.shape[1]).bit_length() > 62:
        x, entries = x.astype(object), entries.astype(object)
    else:
        x, entries = x.astype(np.int64), entries.astype(np.int64)
    more = max(0, top.bit_length() - 52)
    scale = 2.0 ** (ball["shift"] - more)
    # what rounding to whole numbers after the shift may change of any distance
    slack = 4.0 * math.sqrt(max(1, x.shape[1])) if more else 0.0
    codes = _floats(entries, more)
    apart = _norm(codes[:, None] - codes)
    node, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    owned, owner, rows, row_owner = [], [], [], []
    while len(node):
        centre, radius = ball["centre"][node] * scale, ball["radius"][node] * scale
        far = np.where(open_, _norm(centre[:, None] - codes), np.inf)
        best = far.argmin(axis=1)
        least = far[np.arange(len(node)), best][:, None]
        with np.errstate(invalid="ignore"):
            # the bisector of an entry and the best one misses the ball
            beaten = far**2 - least**2 > 2 * apart[best] * radius[:, None] + 1e-9 * (far**2 + least**2 + (apart[best] + 1) * radius[:, None]) + slack * (far + least + apart[best] + radius[:, None] + slack)
        open_ = open_ & ~(beaten | np.isinf(far))
        open_[np.arange(len(node)), best] = True
        single = open_.sum(axis=1) == 1
        owned.append(node[single])
        owner.append(best[single])
        leaf = ~single & (ball["left"][node] < 0)
        if leaf.any():
            at = node[leaf]
            size = ball["end"][at] - ball["start"][at]
            place = np.concatenate([ball["order"][s:e] for s, e in zip(ball["start"][at], ball["end"][at])])
            rows.append(place)
            row_owner.append(_pairs(x[place], entries, np.repeat(open_[leaf], size, axis=0)))
        inner = ~single & ~leaf
        node, open_ = np.concatenate([ball["left"][node[inner]], ball["right"][node[inner]]]).astype(np.int64), np.concatenate([open_[inner]] * 2)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(owned), join(owner), join(rows), join(row_owner)


def _cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * i // parts, dim * (i + 1) // parts) for i in range(parts)]


def sound_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """vec_id, label, x (array<double>) of the rows whose vector is not null and holds no null, NaN or infinite component."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("string")
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))


def tree_blocks(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """ids, labels and data (components and trees) of every block, no shuffle."""
    room = max(1, min(BLOCK, BLOCK_SIZE // max(1, dim)))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, lists = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        x = integers(lists.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(ids), dim)
        data = pickle.dumps({"x": _compact(x), "trees": [tree(x[:, a:b]) for a, b in _cuts(dim, parts)]}, 5)
        both = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*both, pa.array([data], pa.binary())], ["ids", "labels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, room - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == room:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("data", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def improved(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: every entry the floor of the mean of the parts nearest to it; unused entries stay.

    A task gives one row for each used entry and limb of 32 bits of its sums; their totals, at most as many rows as all tasks share, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(c.shape, object) for c in codebooks]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        for batch in batches:
            for data in batch.column(0):
                held = pickle.loads(data.as_py())
                for (a, b), codes, ball, total, count in zip(_cuts(held["x"].shape[1], len(codebooks)), codebooks, held["trees"], sums, counts):
                    part = held["x"][:, a:b]
                    owned, owner, rows, row_owner = nearest(ball, part, codes)
                    np.add.at(total, owner, ball["sums"][owned].astype(object))
                    np.add.at(count, owner, (ball["end"] - ball["start"])[owned])
                    np.add.at(total, row_owner, part[rows].astype(object))
                    np.add.at(count, row_owner, 1)
        out = []
        for p, (total, count) in enumerate(zip(sums, counts)):
            limbs = _top(total).bit_length() // LIMB + 1
            for e in np.flatnonzero(count):
                for k in range(limbs):
                    cut = [int(v) >> LIMB * k for v in total[e]]
                    out.append((p, int(e), k, int(count[e]) if k == 0 else 0, cut if k == limbs - 1 else [v & (1 << LIMB) - 1 for v in cut]))
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "limb", "n", "s"), r)) for r in out], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    width = max(c.shape[1] for c in codebooks)
    found = blocks.select("data").mapInArrow(run, "part int, entry int, limb int, n long, s array<long>")
    totals = found.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()
    count = {(r.part, r.entry): r.n for r in totals if r.limb == 0}
    new = [c.astype(object) for c in codebooks]
    for p, e in count:
        new[p][e] = 0
    for r in totals:
        new[r.part][r.entry] += np.array([r[f"s{i}"] << LIMB * r.limb for i in range(new[r.part].shape[1])], object)
    for (p, e), n in count.items():
        new[p][e] = [int(v) // n for v in new[p][e]]
    return [c if _top(c) >= PLAIN else c.astype(np.int64) for c in new]


def coded(blocks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (array<int>, one entry a part) and error (squared distances summed over parts; null beyond 64 bits)."""
    label = blocks.schema["labels"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = pickle.loads(batch.column(2)[row].as_py())
                n, dim = held["x"].shape
                codes, error = np.zeros((n, len(codebooks)), np.int32), np.zeros(n, object)
                for p, ((a, b), entries, ball) in enumerate(zip(_cuts(dim, len(codebooks)), codebooks, held["trees"])):
                    part = held["x"][:, a:b]
                    owned, owner, rows, row_owner = nearest(ball, part, entries)
                    for node, entry in zip(owned, owner):
                        codes[ball["order"][ball["start"][node] : ball["end"][node]], p] = entry
                    codes[rows, p] = row_owner
                    small = 2 * (_top(part, entries).bit_length() + 1) + max(1, b - a).bit_length() <= 62
                    off = part.astype(np.int64 if small else object) - entries.astype(np.int64 if small else object)[codes[:, p]]
                    error += (off * off).sum(axis=1).astype(object)
                ends = np.arange(n + 1, dtype=np.int32) * len(codebooks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row].values, batch.column(1)[row].values, pa.ListArray.from_arrays(ends, codes.ravel()), pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())],
                    ["vec_id", "label", "codes", "error"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    return blocks.select("ids", "labels", "data").mapInArrow(run, schema)


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes, error, label_error of every sound vector; the codebooks, one array a part).

    A component x counts as floor(scale * x). Vectors that are null or hold null, NaN or infinite components are left out, as are those whose
    length is not that of the sound vector with the smallest id. Codebooks start from the ``entries`` smallest ids (null last, equal
    ids by the vector); with fewer vectors they have fewer entries. A length that ``parts`` doesn't divide gives parts that differ by
    one. Repeated rows and ids are rows like others. ``label_error`` sums the error over equal labels, nulls together; errors and sums
    beyond 64 bits are null. Other columns, whatever their names, play no part. An empty table gives no rows and no codebooks.
    """
    rows = sound_vectors(vectors, id_col, vector_col, label_col)
    shape = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("dim")).limit(1).collect()
    if not shape:
        return rows.limit(0).select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    dim = shape[0].dim
    rows = rows.where(F.size("x") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = integers(np.array([r.x for r in first], float).ravel(), scale).reshape(len(first), dim)
    codebooks = [start[:, a:b] for a, b in _cuts(dim, parts)]
    blocks = saved(tree_blocks(rows, dim, parts, scale), "trees")
    for _ in range(rounds):
        codebooks = improved(blocks, codebooks)
    out = saved(coded(blocks, codebooks), "codes")
    whole = F.when(F.count(F.lit(1)) == F.count("error"), F.sum(F.col("error").cast("decimal(19,0)")))
    sums = out.groupBy(F.col("label").alias("of_label")).agg(whole.try_cast("long").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label"), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """sha256 (hex) of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for c in codebooks for v in c.ravel()).encode()).hexdigest()
