"""K: vectors and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import table
from shiftscope.operators import detections as D, vectors as V


def vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("image", F.col("vec_id") % 25)


@query("K1_group_split", """select vec_id, image, case when (dense_rank() over (order by image) - 1) % 3 = 0 then 'test' else 'train' end as split
    from (select vec_id, vec_id % 25 as image from embeddings)""")
def _(spark, sf):
    return V.split_every(vectors(spark, sf), "image").select("vec_id", "image", "split")


@query("K1_hashed_split", """select seed, case when (('0x' || substr(md5(image || '|' || seed), 1, 8))::bigint & 2147483647) % 100 < 30 then 'test' else 'train' end as split,
    count(distinct image) as images, count(*) as vectors from (select vec_id % 25 as image, unnest([0, 1, 2]) as seed from embeddings) group by 1, 2""")
def _(spark, sf):
    rows = V.split_hashed(vectors(spark, sf).select("vec_id", "image"), "image", [0, 1, 2])
    return rows.groupBy("seed", "split").agg(F.count_distinct("image").alias("images"), F.count("*").alias("vectors"))


@query("K2_kcenter_coreset")
def _(spark, sf):
    # small chunks, so that several rounds are needed at this size too
    return V.kcenter_coreset(vectors(spark, sf), "vec_id", "embedding", 50, projected=32, chunk=200)


_NEAR = """nd as (select q.vec_id, q.image, q.label, min(list_distance(q.embedding::double[], b.embedding::double[])) as distance
    from (select *, vec_id % 25 as image from embeddings) q cross join (select * from embeddings where vec_id % 25 % 3 <> 0 and label <> 0) b
    where q.image % 3 = 0 group by 1, 2, 3)"""


def _near(spark, sf):
    rows = vectors(spark, sf)
    bank = rows.where((F.col("image") % 3 != 0) & (F.col("label") != 0))
    tests = rows.where(F.col("image") % 3 == 0)
    return V.nearest_distance(tests, bank, "vec_id", "vec_id", "embedding", block=300).join(tests.select("vec_id", "image", "label"), "vec_id")


@query("K3_nearest_distance", "select vec_id, round(distance, 6) as distance from nd", _NEAR)
def _(spark, sf):
    return rounded(_near(spark, sf).select("vec_id", "distance"), "distance")


@query("K4_group_anomaly_score", """select image, round(distance, 6) as image_score, vec_id as peak from nd
    qualify row_number() over (partition by image order by distance desc, vec_id) = 1""", _NEAR)
def _(spark, sf):
    return rounded(V.group_anomaly_score(_near(spark, sf), "image", "distance", "vec_id"), "image_score")


@query("K5_pointing_accuracy", """select count(*) as images, round(avg(hit), 6) as pointing_accuracy from (select p.image,
    max(case when x between x1 - 0.3 and x2 + 0.3 and y between y1 - 0.3 and y2 + 0.3 then 1 else 0 end) as hit from (
      select vec_id % 25 as image, embedding[1] as x, embedding[2] as y from embeddings
      qualify row_number() over (partition by vec_id % 25 order by embedding[3] desc, vec_id) = 1) p
    join (select vec_id % 25 as image, embedding[4] as x1, embedding[5] as y1, embedding[4] + 0.3 as x2, embedding[5] + 0.3 as y2 from embeddings where label = 1) r
    on r.image = p.image group by 1)""")
def _(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = vectors(spark, sf).select("vec_id", "image", "label", *[e(i).alias(f"e{i}") for i in range(5)])
    peaks = V.group_anomaly_score(rows, "image", "e2", "vec_id").select("image", F.col("peak").alias("vec_id")).join(
        rows.select("vec_id", F.col("e0").alias("x"), F.col("e1").alias("y")), "vec_id")
    regions = rows.where("label = 1").select("image", F.col("e3").alias("x1"), F.col("e4").alias("y1"), (F.col("e3") + 0.3).alias("x2"), (F.col("e4") + 0.3).alias("y2"))
    return rounded(V.pointing_accuracy(peaks.drop("vec_id"), regions, "image", 0.3), "pointing_accuracy")


_BOXES = """bx as (select vec_id % 20 as image_id, vec_id as box_id, x1, y1, x1 + w as x2, y1 + h as y2, score from (
    select vec_id, abs(embedding[1]::double) * 400 as x1, abs(embedding[2]::double) * 400 as y1, 20 + abs(embedding[3]::double) * 300 as w, 20 + abs(embedding[4]::double) * 300 as h,
      embedding[5]::double as score from embeddings))"""


def boxes(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("image_id"), F.col("vec_id").alias("box_id"),
                                                 (F.abs(e(0)) * 400).alias("x1"), (F.abs(e(1)) * 400).alias("y1"),
                                                 (F.abs(e(2)) * 300 + 20).alias("w"), (F.abs(e(3)) * 300 + 20).alias("h"), e(4).alias("score"))
    return rows.select("image_id", "box_id", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "score")


_PAIRS = _BOXES + """, pr as (select *, inter / (aa + ab - inter) as iou from (select a.image_id, a.box_id as box_a, b.box_id as box_b, a.score as sa, b.score as sb,
    greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as inter,
    (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ab from bx a join bx b on a.image_id = b.image_id and a.box_id < b.box_id))"""


@query("K6_iou_pairs", "select image_id, box_a, box_b, round(iou, 6) as iou from pr where iou > 0.3", _PAIRS)
def _(spark, sf):
    return rounded(D.iou_pairs(boxes(spark, sf), 0.3, 64.0), "iou")


# the greedy rule as recursion over the rank of a box inside its image
_NMS = _PAIRS + """, rk as (select *, row_number() over (partition by image_id order by score desc, box_id) as r from bx),
    ov as (select image_id, box_a as x, box_b as y from pr where iou > 0.5 union all select image_id, box_b, box_a from pr where iou > 0.5),
    walk as (select image_id, 1 as r, [box_id] as kept from rk where r = 1 union all
      select k.image_id, k.r, case when exists (select 1 from ov o where o.image_id = k.image_id and o.x = k.box_id and list_contains(w.kept, o.y))
        then w.kept else list_append(w.kept, k.box_id) end from walk w join rk k on k.image_id = w.image_id and k.r = w.r + 1)"""
_NMS_SQL = "select image_id, unnest(kept) as box_id from (select image_id, kept from walk qualify row_number() over (partition by image_id order by r desc) = 1)"


@query("K7_nms", _NMS_SQL, _NMS)
def _(spark, sf):
    return D.nms(boxes(spark, sf), 0.5)


@query("K7_nms_large_images", _NMS_SQL, _NMS)
def _(spark, sf):
    return D.nms(boxes(spark, sf), 0.5, cell=64.0, small=0)


@query("K8_recall_at_fpr", """select round(cut, 8) as threshold, round((select avg(case when embedding[1]::double > cut then 1.0 else 0 end) from embeddings where label = 1), 6) as recall
    from (select quantile_cont(embedding[1]::double, 0.95) as cut from embeddings where label = 0)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").where("label in (0, 1)").select("label", F.col("embedding")[0].cast("double").alias("score"))
    return rounded(rounded(V.recall_at_fpr(rows, "label", "score"), "threshold", digits=8), "recall")


@query("K9_repeat_summary", """select l_returnflag as metric, round(avg(l_quantity), 6) as mean, round(stddev_pop(l_quantity), 6) as std, count(*) as runs
    from lineitem group by 1""")
def _(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("metric"), "l_quantity")
    return rounded(V.repeat_summary(runs, "metric", F.col("l_quantity")), "mean", "std")
