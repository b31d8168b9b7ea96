"""Work that grows with the tables goes to more tasks, not to larger ones."""

from datetime import date, timedelta

from pyspark.sql import functions as F

import checks.learn, checks.mart, checks.planting  # noqa: E401, F401  (they register their queries)
from checks.registry import QUERIES
from checks.standin import shop as standin
from shiftscope import session
from shiftscope.operators import learn as L, mart as M, planting as P, retrieval as R, text as X
from shiftscope.sources import corpus


def _largest(df) -> int:
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_dropped_orders_are_counted_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    shop = P.drop_orders(standin(spark, sf), "NATION_3", "1997-04-01", "1997-05-01", 60)
    rows = shop.order_items.groupBy("order_id").count()
    assert shop.order_items.count() > 3000 and _largest(rows) < 300
    many = {tuple(r) for r in QUERIES["H1_drop_orders"](spark, sf).collect()}
    monkeypatch.undo()
    assert many == {tuple(r) for r in QUERIES["H1_drop_orders"](spark, sf).collect()}


def test_repeated_payments_are_counted_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    payments = M.fact_payments(standin(spark, sf))
    assert payments.count() > 3000 and _largest(payments) < 500
    many = {tuple(r) for r in QUERIES["D10_repeated_payment_rows"](spark, sf).collect()}
    monkeypatch.undo()
    assert many == {tuple(r) for r in QUERIES["D10_repeated_payment_rows"](spark, sf).collect()}


def test_late_features_are_made_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    few = sorted(map(str, L.late_features(standin(spark, sf)).drop("order_value", "freight", "freight_ratio").collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    rows = L.late_features(standin(spark, sf))
    assert len(few) > 1500 and _largest(rows) < 400
    assert few == sorted(map(str, rows.drop("order_value", "freight", "freight_ratio").collect()))


def test_items_of_other_orders_go_before_they_are_reduced(spark, sf):
    plan = L.late_features(standin(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    semi = [line for line in plan.split("\n") if "Join LeftSemi" in line]
    reduced = [line for line in plan.split("\n") if "Aggregate [order_id" in line and "seller_id" in line]
    assert len(semi) == 1 and len(reduced) == 1 and plan.index(reduced[0]) < plan.index(semi[0])  # inputs stand below


def test_merging_rare_levels_moves_no_rows(spark):
    rows = spark.range(100_000).select("id", F.concat(F.lit("c"), F.least(F.col("id") % 300, F.lit(3))).alias("c"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        got = L.merge_rare(rows, rows.where("id < 15000"), ["c"], 51)
        assert {r["c"]: r["count"] for r in got.groupBy("c").count().collect()} == {"(rare)": 1002, "c3": 98_998}
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_readings_are_put_in_order_once(spark, sf, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), checks.learn.readings

    @F.udf("bigint")
    def seen(unit):
        made.add(1)
        return unit

    monkeypatch.setattr(checks.learn, "readings", lambda *a: plain(*a).withColumn("unit", seen.asNondeterministic()("unit")))
    monkeypatch.setattr(L, "rul_models", lambda train, test, features: train.select("unit", "cycle", *features, "rul"))
    got = QUERIES["J24_rul_models"](spark, sf)
    rows = plain(spark, sf)
    assert made.value == rows.count()
    want = L.window_features(rows, checks.learn._USED).join(L.rul_target(rows).select("unit", "cycle", "rul"), ["unit", "cycle"])
    want = want.where(F.pmod(F.xxhash64("unit"), F.lit(2)) == 0).select(got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_chunks_are_made_once_for_an_export(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text {i}"

    rows = spark.range(500, numPartitions=4).select(F.lit("d").alias("dataset"), (F.col("id") * 7 % 500).alias("doc_id"), F.lit(0).alias("chunk_no"), text("id").alias("text"))
    path = session.scratch_path(spark, "export")
    corpus.export_chunks(rows, path)
    assert made.value == 500 and spark.read.parquet(path).count() == 500


def test_chunks_and_buckets_come_in_batches(spark):
    text = "a\n\n\n b \n\n\x0b\n\n" + "x" * 899 + "\n\né Kİ AB1_c"
    row = spark.createDataFrame([(text,)], "text string").select(X.chunks_of(F.col("text")).alias("c"), X.embed_buckets(F.col("text")).alias("b"), X.tokens(F.col("text"), X.EMBED_TOKEN).alias("t"))
    got = row.select("c", "b", F.transform("t", lambda t: X.md5_mod(t, X.EMBED_DIMS)).alias("same")).first()
    assert got.c == ["a\n\nb", "x" * 899, "é Kİ AB1_c"] and got.b == got.same and len(got.b) >= 5
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan


def test_days_that_no_window_tells_apart_count_together(spark, monkeypatch):
    rows = [(i, 0, None if i % 10 == 0 else date(2018, 1, 1) + timedelta(i), ["a", f"t{i % 3}"]) for i in range(100)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, doc_date date, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a", "t1"], date(2018, 2, 1), date(2018, 3, 1)), (2, ["t2"], None, None)], "query_id long, tokens array<string>, first_day date, last_day date")
    asked, plain = [], R.statistics
    monkeypatch.setattr(R, "statistics", lambda daily, days, q: asked.append(days) or plain(daily, days, q))
    got = {tuple(r) for r in R.bm25_statistics(chunks, queries).collect()}
    assert asked[0].select("doc_date").distinct().count() <= 4
    assert got == {tuple(r) for r in plain(R.day_totals(chunks), R.term_days(chunks), queries).collect()}
