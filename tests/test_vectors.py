import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from shiftscope.operators import detections as D, vectors as V


def _frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, v array<float>")


def test_coreset_keeps_rare_points_and_all_clusters(spark):
    rng = np.random.default_rng(0)
    centres = np.eye(8)[:4] * 50
    v = np.vstack([c + rng.normal(0, 1, (300, 8)) for c in centres] + [np.full((1, 8), 500.0)])
    got = V.kcenter_coreset(_frame(spark, v), "id", "v", 12, chunk=200).collect()
    assert len(got) == 12
    ids = {r.id for r in got}
    assert 1200 in ids and all(any(300 * c <= i < 300 * c + 300 for i in ids) for c in range(4))


def test_coreset_covers_as_the_greedy_choice_does(spark):
    """The farthest vector from a coreset made in chunks is little farther than from one made by the greedy rule over all vectors."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 6)) + rng.integers(0, 4, (900, 1)) * 10
    ids = [r.id for r in V.kcenter_coreset(_frame(spark, v), "id", "v", 30, chunk=300).collect()]
    far = np.sqrt(((v - v[0]) ** 2).sum(1))
    for _ in range(29):
        far = np.minimum(far, np.sqrt(((v - v[far.argmax()]) ** 2).sum(1)))
    cover = np.sqrt(((v[:, None] - v[ids][None]) ** 2).sum(-1)).min(1).max()
    assert len(set(ids)) == 30 and cover < 1.5 * far.max()


@pytest.mark.parametrize("spread", [0.0, 30.0])
def test_nearest_distance_in_blocks(spark, spread):
    """Clusters that pivots tell apart and a cloud that they don't, with ties, zero distances and a repeated query."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 6)) * spread
    q, b = (rng.normal(size=(n, 6)) + centre[rng.integers(0, 8, n)] for n in (150, 270))
    q[:5], b[100:140] = b[:5], b[100]
    far = np.sqrt(((q[:, None].astype("float32").astype(float) - b[None].astype("float32").astype(float)) ** 2).sum(-1))
    for block, stride in ((1000, 8), (16, 2)):
        rows = _frame(spark, q).unionByName(_frame(spark, q[:1]))
        got = V.nearest_distance(rows, _frame(spark, b), "id", "id", "v", block=block, stride=stride, pivots=6).orderBy("id").toPandas()
        assert got["id"].tolist() == list(range(150)) and np.allclose(got["distance"], far.min(1), atol=1e-12) and got["nearest"].tolist() == far.argmin(1).tolist()
    assert V.nearest_distance(rows, _frame(spark, b).limit(0), "id", "id", "v").count() == 0


def test_far_blocks_never_meet(spark):
    """With clusters far apart, far fewer pairs of blocks are compared than there are."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, (60, 4)) + c for c in (np.eye(4) * 1000)])
    out = V.nearest_distance(_frame(spark, v), _frame(spark, v + 0.01), "id", "id", "v", block=10, pivots=8)
    assert out.agg(F.max("distance")).first()[0] < 0.021
    met = V.met_blocks(*[V.packed(_frame(spark, x), F.col("id"), "v", V.pivots_of(_frame(spark, v), "id", "v", 8), 10) for x in (v, v)], 8)
    pairs = met.count()
    assert 24 <= pairs < 24 * 24 / 3


def _greedy(boxes, t):
    kept = []
    for i in sorted(range(len(boxes)), key=lambda i: (-boxes[i][6], boxes[i][1])):
        a = boxes[i]
        ok = True
        for j in kept:
            b = boxes[j]
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            inter = max(w, 0) * max(h, 0)
            union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter
            ok &= not (union > 0 and inter / union > t)
        if ok:
            kept.append(i)
    return {boxes[i][1] for i in kept}


@pytest.mark.parametrize("small", [5000, 0])
def test_nms_equals_the_greedy_rule(spark, small):
    rng = np.random.default_rng(2)
    xy, wh = rng.uniform(0, 200, (60, 2)), rng.uniform(10, 80, (60, 2))
    boxes = [(1, i, *map(float, xy[i]), *map(float, xy[i] + wh[i]), float(rng.integers(0, 20))) for i in range(60)]
    boxes += [(1, 60 + i, *boxes[i][2:6], boxes[i][6]) for i in range(10)]  # exact copies
    boxes += [(1, 90, 5.0, 5.0, 5.0, 9.0, 0.5)]  # an empty box
    df = spark.createDataFrame(boxes, "image_id bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    assert {r.box_id for r in D.nms(df, 0.5, small=small).collect()} == _greedy(boxes, 0.5)


def test_text_and_huge_groups_are_kept_apart(spark):
    df = spark.createDataFrame([("a", 2**53), ("b", 2**53 + 1), ("c", 2**53), (None, 5)], "g string, n bigint")
    assert V.split_every(df, "g").count() == 4
    assert V.split_every(df.select("n"), "n", 2).groupBy("n").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert V.split_every(df.select("n").distinct(), "n", 2).where("split = 'test'").count() == 2


def test_groups_are_never_split(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 12)
    for out in (V.split_every(df, "g"), V.split_hashed(df, "g", [7])):
        assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_best_cosines_of_tiles_equal_all_pairs(spark, monkeypatch):
    import shiftscope.operators.retrieval as R

    monkeypatch.setattr(R, "TILE", 16)
    monkeypatch.setattr(R, "STRIDE", 32)
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (150, 4)).astype(float)  # many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200 + i, [1.0, 1.0, 2.0, 0.0]) for i in range(40)]
    rows += [(300, None), (301, [1.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [0.0] * 4), (304, [None, 1.0, 1.0, 1.0])]
    bank = spark.createDataFrame(rows, "id bigint, v array<double>")
    asked = bank.withColumnRenamed("id", "q")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    want = R.cosine_scores(bank, asked, "id", "v", "q").withColumn("p", F.row_number().over(order)).where("p <= 3").drop("p")
    key = lambda df: sorted((r["q"], r["id"], str(r["score"])) for r in df.select("q", "id", "score").collect())
    assert key(R.cosine_scores(bank, asked, "id", "v", "q", top=3)) == key(want)
    small = bank.where("id < 2")  # fewer rows than wanted
    assert R.cosine_scores(small, asked.where("q < 5"), "id", "v", "q", top=3).count() == 10


def test_nms_in_few_rounds(spark, monkeypatch):
    """A pile of boxes takes few rounds, in batches with and without the grid, and gives the greedy rule."""
    rng = np.random.default_rng(8)
    corner, size = rng.uniform(0, 120, (600, 2)), rng.uniform(20, 160, (600, 2))
    score = rng.integers(0, 60, 600) / 60
    boxes = [(1 + i % 2, i, *map(float, c), *map(float, c + s), float(p)) for i, (c, s, p) in enumerate(zip(corner, size, score))]
    df = spark.createDataFrame(boxes, "image_id bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    want = {(r.image_id, r.box_id) for r in D.nms(df, 0.5).collect()}
    rounds = []
    first = D._best_first
    monkeypatch.setattr(D, "_best_first", lambda *a: rounds.append(1) or first(*a))
    for batch, slice_, most in ((64, 50, 5), (8, 16_384, 40)):
        monkeypatch.setattr(D, "SLICE", slice_)
        rounds.clear()
        assert {(r.image_id, r.box_id) for r in D._nms_large(df, 0.5, 64.0, batch).collect()} == want
        assert len(rounds) <= most


def test_a_bank_block_goes_to_a_tile_once(spark):
    """What is sent does not grow with the number of small query blocks."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6))
    plan = V.nearest_distance(_frame(spark, v[:200]), _frame(spark, v[200:]), "id", "id", "v", block=10, pivots=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "q_tile" in plan
    out = V.nearest_distance(_frame(spark, v[:200]), _frame(spark, v[200:]), "id", "id", "v", block=10, pivots=2).toPandas().set_index("id")
    far = np.sqrt(((v[:200, None].astype(np.float32).astype(float) - v[None, 200:].astype(np.float32).astype(float)) ** 2).sum(axis=2))
    assert (out.loc[range(200), "nearest"].to_numpy() == far.argmin(axis=1)).all()
