"""Vector banks: group splits, coresets, nearest distances and image-level scores."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shiftscope.functions.hashing import hash_percent
from shiftscope.functions.ordered import positions
from shiftscope.functions.quantiles import exact_quantile
from shiftscope.session import cut_lineage

BANK_BLOCK = 2048  # vectors of a block
PIVOTS, STRIDE = 16, 8  # bank vectors that bound distances; blocks of BANK_BLOCK of the bank a task works off
TILE = 2  # blocks of BANK_BLOCK of the queries that a task takes together
EASE = 1 + 1e-9  # bounds are this much wider than computed


# ---------------------------------------------------------------- splits
def split_every(df: DataFrame, group: str, every: int = 3) -> DataFrame:
    """Whole groups go to 'test' (each ``every``-th in sorted order) or 'train'."""
    groups = positions(df.select(F.col(group).alias("_g")).distinct(), [], "_g", out="_p")
    marked = groups.select("_g", F.when((F.col("_p") - 1) % every == 0, "test").otherwise("train").alias("split"))
    return df.join(marked, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def split_hashed(df: DataFrame, group: str, seeds: list[int], test_share: float = 0.3) -> DataFrame:
    """One random split per seed; a group falls wholly on one side. Needs no shuffle."""
    bucket = hash_percent(F.concat_ws("|", F.col(group).cast("string"), F.col("seed").cast("string")))
    rows = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return rows.withColumn("split", F.when(bucket < round(test_share * 100), "test").otherwise("train"))


# ---------------------------------------------------------------- coreset
def _farthest_first(v: np.ndarray, size: int) -> np.ndarray:
    """Indices of a greedy k-center selection, starting at the first vector."""
    chosen = np.zeros(min(size, len(v)), dtype=int)
    dist = np.full(len(v), np.inf)
    for i in range(1, len(chosen)):
        step = v - v[chosen[i - 1]]
        dist = np.minimum(dist, np.einsum("ij,ij->i", step, step))
        chosen[i] = int(np.argmax(dist))
    return chosen


def kcenter_coreset(
    vectors: DataFrame, key: str, vector: str, size: int, projected: int | None = None, pool: int | None = None, seed: int = 0,
    chunk: int = 20_000,
) -> DataFrame:
    """``size`` vectors that cover all others, by greedy k-center on chunks and then on the chosen ones.

    Every task holds at most ``chunk`` vectors at a time and passes on ``size`` per chunk. Rounds repeat, each on far
    fewer rows, until the rest fits one chunk. ``projected`` compares vectors in a random low-dimensional projection;
    ``pool`` first draws that many at random (a sampling option, off by default).
    """
    rows = vectors.select(key, vector)
    if pool is not None:
        rows = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(pool)
    if chunk < 4 * size:
        raise ValueError("chunk must hold at least four times the coreset")
    schema = rows.schema

    def reduce_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def pick(frames: list[pd.DataFrame]) -> pd.DataFrame:
            frame = pd.concat(frames).sort_values(key, ignore_index=True)
            v = np.stack(frame[vector].to_numpy()).astype(np.float64)
            if projected:
                v = v @ np.random.default_rng(seed).standard_normal((v.shape[1], projected)) / np.sqrt(projected)
            return frame.iloc[_farthest_first(v, size)]

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= chunk:
                yield pick(held)
                held, count = [], 0
        if held:
            yield pick(held)

    n = rows.count()
    while n > chunk:
        parts = max(1, -(-n // chunk))
        mixed = rows.repartition(parts, F.xxhash64(F.col(key), F.lit(seed)))
        rows = cut_lineage(mixed.mapInPandas(reduce_chunks, schema))
        smaller = rows.count()
        if smaller >= n:
            break
        n = smaller
    return rows.repartition(1).mapInPandas(reduce_chunks, schema)  # at most `chunk` rows are left


# ---------------------------------------------------------------- nearest distance
def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to the few rows of b, without cancellation."""
    return np.stack([np.sqrt(((a - p) ** 2).sum(axis=1)) for p in b], axis=1)


def packed(rows: DataFrame, id_: Column, vector: str, pivots: np.ndarray, block: int) -> DataFrame:
    """(cell, number, low, high, data): blocks of at most about ``block`` vectors that share their nearest pivot.

    ``low`` and ``high`` bound the block's distances to every pivot; ``data`` has ids and vectors.
    """

    kind = np.float32 if rows.schema[vector].dataType.elementType.typeName() == "float" else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(_rows(batch.column(1)), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int32))], ["id", "v", "cell"])

    placed = cut_lineage(rows.select(id_.cast("bigint").alias("id"), F.col(vector).alias("v")).distinct().mapInArrow(place, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", rows.schema[vector].dataType), T.StructField("cell", T.IntegerType())])))
    number = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each pivot
    placed = placed.join(F.broadcast(number), "cell").withColumn("number", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))

    def pack(key, table):
        table = table.sort_by("id")
        v = _rows(table["v"])
        far = _distances(v, pivots)
        data = pickle.dumps((table["id"].to_numpy(), v.astype(kind)))  # distances to the pivots are computed again where it goes
        cells = [pa.array([int(k.as_py())], pa.int32()) for k in key]
        return pa.table([*cells, pa.array([far.min(axis=0).tolist()]), pa.array([far.max(axis=0).tolist()]), pa.array([data], pa.binary())], ["cell", "number", "low", "high", "data"])

    return cut_lineage(placed.select("cell", "number", "id", "v").groupBy("cell", "number").applyInArrow(pack, "cell int, number int, low array<double>, high array<double>, data binary"))


def _rows(column) -> np.ndarray:
    """A list column as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def pivots_of(bank: DataFrame, bank_key: str, vector: str, count: int) -> np.ndarray:
    """Bank vectors picked by hash."""
    chosen = bank.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector, bank_key)).select(vector).limit(count).collect()
    return np.array([r[0] for r in chosen], float)


def met_blocks(asked: DataFrame, held: DataFrame, pivots: int) -> DataFrame:
    """(q_cell, q_number, b_cell, b_number, least): pairs of packed blocks of which one may hold a nearest neighbour of the other."""
    spark = asked.sparkSession
    # which cells can hold a neighbour of which: a row for each pair of pivots at most
    bounds = [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(pivots) for c, f in (("low", F.min), ("high", F.max))]
    cells = [side.groupBy("cell").agg(*bounds).collect() for side in (asked, held)]
    gap = lambda q, b: max(max(q[f"low{i}"] - b[f"high{i}"], b[f"low{i}"] - q[f"high{i}"], 0.0) for i in range(pivots))
    meets = [(q.cell, b.cell) for q in cells[0] for b in cells[1] if gap(q, b) <= min(q[f"high{i}"] for i in range(pivots)) * EASE]
    meets = spark.createDataFrame(meets, "q_cell int, b_cell int")
    ends = lambda side, name: side.select(*[F.col(c).alias(f"{name}_{c}") for c in ("cell", "number", "low", "high")])
    gaps = F.zip_with(F.zip_with("q_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "q_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    pairs = ends(asked, "q").join(F.broadcast(meets), "q_cell").join(ends(held, "b"), "b_cell").withColumn("least", F.array_max(gaps))
    return pairs.where(F.col("least") <= F.array_min("q_high") * EASE).select("q_cell", "q_number", "b_cell", "b_number", "least")


def nearest_distance(queries: DataFrame, bank: DataFrame, key: str, bank_key: str, vector: str, block: int = BANK_BLOCK, pivots: int = PIVOTS, stride: int | None = None) -> DataFrame:
    """(key, distance, nearest): Euclidean distance to the closest bank vector, ties to the smaller id.

    Queries and bank are packed in blocks around a few pivots, which are bank vectors. A query is no farther from its nearest neighbour than from
    the nearest pivot, and by the triangle inequality two blocks are no nearer than their distances to any pivot differ, so
    most pairs of blocks never meet. Some blocks of queries make a tile. The blocks of the bank that a tile still has to see are worked off in strides (of
    ``stride`` blocks), each a task, nearest first and with the same bound for single vectors. Any size of bank takes one job; the driver sees the pivots only.
    A key that is given twice is one query.
    """
    points = pivots_of(bank, bank_key, vector, pivots)
    if not len(points):
        return queries.limit(0).select(key, F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("nearest"))
    asked = packed(queries.where(F.col(vector).isNotNull()), F.col(key), vector, points, block)
    held = packed(bank.where(F.col(vector).isNotNull()), F.col(bank_key), vector, points, block)
    # a block of the bank goes to a tile once, however many of its blocks want it
    many = lambda blocks: max(1, blocks * BANK_BLOCK // block)
    tile = F.floor(F.col("number") / many(TILE)).cast("int")
    met = met_blocks(asked, held, len(points)).groupBy("q_cell", F.floor(F.col("q_number") / many(TILE)).cast("int").alias("q_tile"), "b_cell", "b_number").agg(F.min("least").alias("least"))
    # near ones spread over the strides, so that every task soon has a good bound
    order = Window.partitionBy("q_cell", "q_tile").orderBy("least", "b_cell", "b_number")
    pairs = met.withColumn("place", F.row_number().over(order))
    pairs = pairs.withColumn("strides", F.ceil(F.count("*").over(Window.partitionBy("q_cell", "q_tile")) / (stride or many(STRIDE))))
    pairs = cut_lineage(pairs.withColumn("stride", (F.col("place") % F.col("strides")).cast("int")).drop("place", "strides"))
    here = ["q_cell", "q_tile", "stride"]
    left = pairs.join(held.select(F.col("cell").alias("b_cell"), F.col("number").alias("b_number"), "data"), ["b_cell", "b_number"]).select(*here, "least", "data")
    right = pairs.select(*here).distinct().join(asked.select(F.col("cell").alias("q_cell"), tile.alias("q_tile"), "data"), ["q_cell", "q_tile"]).select(*[F.col(c).alias(f"of_{c}") for c in here], "data")

    def load(data):
        ids, v = (np.concatenate(c) for c in zip(*[pickle.loads(d) for d in data]))
        v = v.astype(float)
        return ids, v, _distances(v, points)

    def search(banks, questions):
        ids, v, far = load(questions["data"].to_pylist())
        best, name = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
        for k in np.argsort(banks["least"].to_numpy(), kind="stable"):
            other, w, away = load([banks["data"][int(k)].as_py()])
            bound = np.minimum(best, far.min(axis=1)) * EASE
            reach = np.maximum(far - away.max(axis=0), away.min(axis=0) - far).max(axis=1)
            open_ = np.flatnonzero(reach <= bound)
            if not len(open_):
                continue
            q = v[open_]
            length, width = (q * q).sum(axis=1), (w * w).sum(axis=1)
            square = length[:, None] + width[None, :] - 2 * q @ w.T
            # what rounding leaves in doubt is computed again without cancellation
            row, col = np.nonzero(square <= (square.min(axis=1) + 1e-9 * (length + width.max()))[:, None])
            exact = np.sqrt(((w[col] - q[row]) ** 2).sum(axis=1))
            order = np.lexsort((other[col], exact, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            at, new = open_[row[first]], other[col[first]]
            better = (exact[first] < best[at]) | ((exact[first] == best[at]) & (new < name[at]))
            best[at[better]], name[at[better]] = exact[first][better], new[better]
        found = np.flatnonzero(np.isfinite(best))
        return pa.table({"id": ids[found], "distance": best[found], "nearest": name[found]})

    met = left.groupBy(*here).cogroup(right.groupBy(*[f"of_{c}" for c in here])).applyInArrow(search, "id bigint, distance double, nearest bigint")
    best = met.groupBy("id").agg(F.min(F.struct("distance", "nearest")).alias("b"))
    return best.select(F.col("id").cast(queries.schema[key].dataType).alias(key), "b.distance", "b.nearest")


# ---------------------------------------------------------------- scores
def group_anomaly_score(patches: DataFrame, group: str, score: str, patch: str) -> DataFrame:
    """The highest patch score of every image and where it is; equal scores go to the smallest patch id."""
    best = patches.groupBy(group).agg(F.max_by(F.struct(patch, score), F.struct(F.col(score), -F.col(patch))).alias("b"))
    return best.select(group, F.col(f"b.{score}").alias("image_score"), F.col(f"b.{patch}").alias("peak"))


def pointing_accuracy(peaks: DataFrame, regions: DataFrame, group: str, tolerance: float) -> DataFrame:
    """Share of images whose peak (x, y) lies in a true region (x1, y1, x2, y2) grown by ``tolerance``."""
    near = lambda p, a, z: F.col(p).between(F.col(a) - tolerance, F.col(z) + tolerance)
    hits = peaks.join(regions, group).where(near("x", "x1", "x2") & near("y", "y1", "y2")).select(group).distinct()
    marked = peaks.join(regions.select(group).distinct(), group, "left_semi").join(hits.withColumn("hit", F.lit(1)), group, "left")
    return marked.agg(F.count("*").alias("images"), F.avg(F.coalesce("hit", F.lit(0))).alias("pointing_accuracy"))


def recall_at_fpr(scores: DataFrame, label: str, score: str, false_positive_rate: float = 0.05) -> DataFrame:
    """Recall at the threshold that rejects at most that share of the negatives."""
    cut = exact_quantile(scores.where(F.col(label) == 0), score, 1 - false_positive_rate)
    found = F.when(F.col(score) > F.lit(cut), 1.0).otherwise(0.0)
    return scores.where(F.col(label) == 1).agg(F.lit(cut).alias("threshold"), F.avg(found).alias("recall"))


def repeat_summary(runs: DataFrame, by: str, value: Column) -> DataFrame:
    """Mean, population deviation and number of runs per metric."""
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("runs"))
