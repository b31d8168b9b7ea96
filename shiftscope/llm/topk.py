"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are cut by hash of their id into blocks of bounded size. A block keeps, for every dimension, its vectors sorted by that component.
A query reads all lists side by side, from the top where its own component is positive and from the bottom where it is negative; every
vector met is scored in full. What no list has shown yet scores at most the sum of the components at the reading position times
the query's. As soon as this bound is below the query's k-th score so far, the block holds nothing more for it.

Queries come in blocks as well; a task takes one block of queries through one block of vectors after the other, and bounds carry over.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shiftscope.llm.common import saved

BLOCK = 4096
QUERY_BLOCK = 1024
#: Blocks of vectors that one task takes a block of queries through.
STRIDE = 4
#: Growth of the reading position from one look at the bound to the next.
STEP = 4
#: Scores are ordered by limbs of so many bits.
LIMB_BITS = 62
LIMB = (1 << LIMB_BITS) - 1


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array<double>): floor(scale * component), the component as double; a double holds these whole numbers exactly.

    Rows whose vector is null or holds null, NaN or infinite components are left out, as are those where a product is beyond any double
    (components of 2**1016 and more), and rows without an id.
    """
    whole = lambda v: F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)
    x = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double") * F.lit(float(scale)))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null").where(F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", F.transform("x", whole).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    """Whole numbers, as machine integers where they fit with room to spare, else as integers of any length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy()
    plain = values.dtype != float or not len(values) or np.abs(values).max() < 2.0**53
    return (values.astype(np.int64) if plain else np.array([int(v) for v in values.tolist()], object)).reshape(len(flat), dim)


def _largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """The index: dim, number, ids, values and sorted lists (row numbers by rising component, one list a dimension), as bytes."""
    number = vectors.groupBy(F.size("x").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = vectors.withColumn("dim", F.size("x")).join(F.broadcast(number), "dim").withColumn("number", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))

    def build(key, rows):
        rows = rows.sort_by("vec_id")
        dim, number = (int(k.as_py()) for k in key)
        x = _matrix(rows["x"], dim)
        lists = np.argsort(x, axis=0, kind="stable").T.astype("<i4")
        data = pickle.dumps(x) if x.dtype == object else x.astype("<i8").tobytes()
        return pa.table({"dim": pa.array([dim], pa.int32()), "number": pa.array([number], pa.int32()), "ids": [rows["vec_id"].to_numpy().tobytes()], "x": [data], "plain": [x.dtype != object], "lists": [lists.tobytes()]})

    return rows.select("dim", "number", "vec_id", "x").groupBy("dim", "number").applyInArrow(build, "dim int, number int, ids binary, x binary, plain boolean, lists binary")


def place(score: int) -> list[int]:
    """Numbers that order as lists as the scores do: how many limbs, with the sign, then the limbs from the top."""
    limbs = [score & LIMB]
    score >>= LIMB_BITS
    while score not in (0, -1):
        limbs.append(score & LIMB)
        score >>= LIMB_BITS
    return [-len(limbs) if score else len(limbs), *limbs[::-1]]


class _Best:
    """The k best of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)  # scores may become objects

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        if len(score) > 4 * self.k:  # only what reaches the k-th score, ties included
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= least], ids[score >= least]
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]

    def beaten(self, bound: int) -> bool:
        """Nothing that scores at most ``bound`` can enter. An equal score could, with a smaller id."""
        return len(self.score) == self.k and self.score[-1] > bound


def search_block(query: np.ndarray, own: int, best: _Best, ids: np.ndarray, exact: np.ndarray, lists: np.ndarray, tops: np.ndarray) -> int:
    """The threshold algorithm on one block; returns how many vectors were scored. ``tops`` has the components in list order."""
    n, used = len(ids), np.flatnonzero(query)
    seen, scored, depth, low = np.zeros(n, bool), 0, max(best.k, 16), 0
    down = query[used] > 0
    while True:
        depth = min(depth, n)
        if low == 0 and depth < n:  # the bound before any reading may end it at once
            first = np.where(down, tops[used, n - 1], tops[used, 0])
            if best.beaten(int((first * query[used]).sum())):
                return scored
        met = np.zeros(n, bool)
        if depth == n or len(used) == 0:
            met[:] = True
        else:
            met[lists[used[down], n - depth : n - low].ravel()] = True
            met[lists[used[~down], low:depth].ravel()] = True
        met &= ~seen
        at = np.flatnonzero(met)
        seen |= met
        if len(at):
            scored += len(at)
            score = exact[at] @ query.astype(exact.dtype)
            score = score if score.dtype == object else score.astype(np.int64)
            keep = ids[at] != own
            if len(best.score) == best.k:
                keep &= score >= best.score[-1]
            best.add(score[keep], ids[at][keep])
        if depth == n or len(used) == 0 or scored == n:
            return scored
        frontier = np.where(down, tops[used, n - depth], tops[used, depth - 1])
        if best.beaten(int((frontier * query[used]).sum())):
            return scored
        low, depth = depth, depth * STEP


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` vectors of greatest inner product with every query, itself (its id) left out.

    Both tables have vec_id and x (array<long>, or array<double> of whole numbers of any size). Scores are exact and so is their order; one
    that doesn't fit 64 bits is null in the result. Ties go to the smaller id; a query with fewer candidates returns all. Only vectors of the
    query's own dimension are candidates. Repeated ids are candidates like others. Empty tables give no rows.
    """
    index = saved(blocks(vectors, block).withColumn("stride", F.floor(F.col("number") / STRIDE).cast("int")), "lists")
    asked = queries.select("vec_id", "x", F.size("x").alias("dim"))
    # a task is one block of queries and one stride of blocks; both sides are repeated as often as the other has parts
    parts = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    strides = index.groupBy("dim").agg((F.max("stride") + 1).alias("strides"))
    sides = saved(parts.join(strides, "dim"), "sides")
    left = index.join(sides.select("dim", "parts"), "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = asked.join(sides, "dim").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("stride", F.explode(F.sequence(F.lit(0), F.col("strides") - 1)))

    def search(blocks, questions):
        if not (blocks.num_rows and questions.num_rows):
            return pa.table({**{c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")}, "place": pa.array([], pa.list_(pa.int64()))})
        dim = blocks["dim"][0].as_py()
        own, query = questions["vec_id"].to_numpy(), _matrix(questions["x"], dim)
        best = [_Best(k) for _ in own]
        for ids, x, plain, lists in zip(*(blocks[c].to_pylist() for c in ("ids", "x", "plain", "lists"))):
            ids = np.frombuffer(ids, "<i8")
            lists = np.frombuffer(lists, "<i4").reshape(dim, len(ids))
            x = np.frombuffer(x, "<i8").reshape(len(ids), dim) if plain else pickle.loads(x)
            tops = np.take_along_axis(x.T, lists, axis=1)
            bits = 2 * max(_largest(x), _largest(query)).bit_length() + dim.bit_length()
            # floating point where it is exact, then machine integers, then integers of any length
            exact = x.astype(float if bits < 53 else np.int64 if bits < 63 else object)
            asked = query.astype(np.int64 if bits < 63 else object)
            tops = tops.astype(asked.dtype)
            for i, b in enumerate(best):
                search_block(asked[i], int(own[i]), b, ids, exact, lists, tops)
        values = [(int(q), int(i), int(s)) for q, b in zip(own, best) for i, s in zip(b.ids, b.score)]
        fits = [s if -(2**63) <= s < 2**63 else None for _, _, s in values]
        return pa.table({"query_id": pa.array([q for q, _, _ in values], pa.int64()), "vec_id": pa.array([i for _, i, _ in values], pa.int64()), "score": pa.array(fits, pa.int64()),
                         "place": pa.array([place(s) for _, _, s in values], pa.list_(pa.int64()))})

    key = ["dim", "part", "stride"]
    found = left.select(*key, "ids", "x", "plain", "lists").groupBy(*key).cogroup(right.select(*key, "vec_id", "x").groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long, place array<long>")
    order = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
