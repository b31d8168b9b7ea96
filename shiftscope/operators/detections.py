"""Boxes found in images: overlaps and greedy non-maximum suppression.

Boxes are (image_id, box_id, x1, y1, x2, y2, score).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.session import cut_lineage

SMALL_IMAGE = 5_000  # boxes of one image a single task may hold
BATCH, SLICE = 4_096, 16_384  # best open boxes decided together; open boxes of an image that meet the kept ones in one task
SIDES = ["x1", "y1", "x2", "y2"]


def iou(a: str, b: str) -> Column:
    """Intersection over union of the box structs ``a`` and ``b``; 0 for empty boxes."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    area = lambda s: (F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(f"{s}.y2") - F.col(f"{s}.y1"))
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def _cells(boxes: DataFrame, cell: float) -> DataFrame:
    """Every grid cell a box touches; two overlapping boxes always share at least one."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    return boxes.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def iou_pairs(boxes: DataFrame, threshold: float, cell: float) -> DataFrame:
    """Pairs of boxes of one image that overlap by more than ``threshold``.

    Candidates come from shared grid cells; a pair is counted in the cell of its top-left common corner only.
    """
    packed = _cells(boxes.withColumn("b", F.struct("box_id", "x1", "y1", "x2", "y2")), cell).select("image_id", "cx", "cy", "b")
    left, right = packed.withColumnRenamed("b", "p"), packed.withColumnRenamed("b", "q")
    pairs = left.join(right, ["image_id", "cx", "cy"]).where(F.col("p.box_id") < F.col("q.box_id"))
    corner = (F.floor(F.greatest("p.x1", "q.x1") / cell) == F.col("cx")) & (F.floor(F.greatest("p.y1", "q.y1") / cell) == F.col("cy"))
    scored = pairs.where(corner).select("image_id", F.col("p.box_id").alias("box_a"), F.col("q.box_id").alias("box_b"), iou("p", "q").alias("iou"))
    return scored.where(F.col("iou") > threshold)


def _suppress(boxes: np.ndarray, order: np.ndarray, threshold: float) -> np.ndarray:
    """Indices kept by the greedy rule, walking in ``order``."""
    x1, y1, x2, y2 = boxes.T
    area = (x2 - x1) * (y2 - y1)
    alive, kept = np.ones(len(boxes), dtype=bool), []
    for i in order:
        if not alive[i]:
            continue
        kept.append(i)
        w = np.minimum(x2[i], x2) - np.maximum(x1[i], x1)
        h = np.minimum(y2[i], y2) - np.maximum(y1[i], y1)
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        union = area[i] + area - inter
        alive &= ~(np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) > threshold)
    return np.array(kept, dtype=int)


def _nms_small(boxes: DataFrame, threshold: float) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["box_id"], -pdf["score"]))
        return pdf.iloc[_suppress(pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), order, threshold)][["image_id", "box_id"]]

    return boxes.groupBy("image_id").applyInPandas(one, "image_id bigint, box_id bigint")


def _without_hits(rest: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``rest`` that no box of ``kept`` overlaps by more than the threshold. Slices of an image meet its kept boxes as arrays."""
    slices = rest.groupBy("image_id").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    dealt = rest.join(slices, "image_id").withColumn("slice", F.pmod(F.xxhash64("x1", "y1", "x2", "y2", "m"), F.col("slices")).cast("int")).drop("slices")
    sent = kept.join(slices, "image_id").select(F.col("image_id").alias("of_image"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("of_slice"), *SIDES)

    def free(open_, kept):
        mine, other = (np.stack([t[c].to_numpy(zero_copy_only=False) for c in SIDES]) for t in (open_, kept))
        alive = np.arange(open_.num_rows)
        for at in range(0, other.shape[1], 64):
            x1, y1, x2, y2 = mine[:, alive, None]
            p1, q1, p2, q2 = other[:, None, at : at + 64]
            inter = np.clip(np.minimum(x2, p2) - np.maximum(x1, p1), 0, None) * np.clip(np.minimum(y2, q2) - np.maximum(y1, q1), 0, None)
            union = (x2 - x1) * (y2 - y1) + (p2 - p1) * (q2 - q1) - inter
            over = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) > threshold
            alive = alive[~over.any(axis=1)]
        return open_.take(alive).drop(["slice"])

    return dealt.groupBy("image_id", "slice").cogroup(sent.groupBy("of_image", "of_slice")).applyInArrow(free, rest.schema)


def _best_first(open_boxes: DataFrame, threshold: float, batch: int) -> tuple[DataFrame, DataFrame]:
    """(kept, still open): the ``batch`` best open boxes of every image are decided in one task, and what they keep removes others."""
    order = Window.partitionBy("image_id").orderBy(F.desc("m"))
    best = cut_lineage(open_boxes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= batch))

    def decide(table):
        table = table.sort_by("place")
        sides = np.stack([table[c].to_numpy(zero_copy_only=False) for c in SIDES], axis=1)
        return table.take(_suppress(sides, np.arange(len(sides)), threshold)).drop(["place"])

    kept = cut_lineage(best.groupBy("image_id").applyInArrow(decide, open_boxes.schema))
    last = best.groupBy("image_id").agg(F.min("m").alias("last"))
    rest = open_boxes.join(last, "image_id").where(F.col("m") < F.col("last")).drop("last")
    return kept, cut_lineage(_without_hits(rest.select(*open_boxes.columns), kept, threshold))


def _best_of_cells(open_boxes: DataFrame, threshold: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """(kept, still open): a box that is best in all its grid cells has no better open neighbour, so it is kept.

    The best of a cell is found with a map-side combine. Each cell then holds at most one new kept box, which removes the open
    boxes it overlaps. Nothing is paired beyond (box, kept box of its cell).
    """
    spread = _cells(open_boxes, cell)
    leaders = spread.groupBy("image_id", "cx", "cy").agg(F.max(F.struct("m", *SIDES)).alias("lead"))
    seen = spread.join(leaders, ["image_id", "cx", "cy"])
    box = ["image_id", *SIDES, "m"]
    wins = seen.groupBy(*box).agg(F.bool_and(F.col("lead.m") == F.col("m")).alias("won")).where("won").drop("won")
    wins = cut_lineage(wins)
    tops = _cells(wins, cell).select("image_id", "cx", "cy", F.struct(*SIDES, "m").alias("w"))
    rest = open_boxes.join(wins.select(*box), box, "left_anti").withColumn("b", F.struct(*SIDES))
    hit = _cells(rest, cell).join(tops, ["image_id", "cx", "cy"]).where(iou("b", "w") > threshold).select(*box).distinct()
    return wins, cut_lineage(rest.drop("b").join(hit, box, "left_anti"))


def _nms_large(boxes: DataFrame, threshold: float, cell: float, batch: int = BATCH) -> DataFrame:
    """Exact suppression for images of any size, in rounds.

    A round decides the best open boxes of every image together, which ends piles of boxes soon. While some image has many more, it also
    keeps what is best in all its grid cells, which ends wide images soon.
    """
    if threshold >= 1:  # no overlap is larger than that
        return boxes.select("image_id", "box_id")
    # equal boxes suppress each other, so only the best of a group of copies can survive
    best = F.struct(F.col("score"), (-F.col("box_id")).alias("neg_id"))
    open_boxes = boxes.groupBy("image_id", *SIDES).agg(F.max(best).alias("m"))
    empty = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    kept = boxes.where(empty).select("image_id", "box_id")
    open_boxes = cut_lineage(open_boxes.where(~empty))
    while not open_boxes.isEmpty():
        rounds = [_best_first(open_boxes, threshold, batch)]
        if (rounds[-1][1].groupBy("image_id").count().agg(F.max("count")).first()[0] or 0) > 8 * batch:
            rounds.append(_best_of_cells(rounds[-1][1], threshold, cell))
        for wins, open_boxes in rounds:
            kept = kept.unionByName(wins.select("image_id", (-F.col("m.neg_id")).alias("box_id")))
    return kept


def nms(boxes: DataFrame, threshold: float = 0.5, cell: float = 64.0, small: int = SMALL_IMAGE) -> DataFrame:
    """(image_id, box_id) kept by greedy suppression: best score first, ties to the smaller box id.

    Images up to ``small`` boxes are solved in one task each; larger ones go through the grid rounds. Both are exact.
    """
    rows = boxes.select("image_id", "box_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "score")])
    sizes = rows.groupBy("image_id").agg(F.count("*").alias("_n"))
    sized = rows.join(sizes, "image_id")
    big = sized.where(F.col("_n") > small).drop("_n")
    out = _nms_small(sized.where(F.col("_n") <= small).drop("_n"), threshold)
    if big.isEmpty():
        return out
    return out.unionByName(_nms_large(big, threshold, cell))
