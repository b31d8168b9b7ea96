import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.standin import shop as standin
from shiftscope.operators import change as C, planting as P
from shiftscope.plans.explain import explain_change
from shiftscope.plans.metrics import MetricSpec, metric_catalog, resolve_joins

A, B = ("2018-03-01", "2018-04-01"), ("2018-04-01", "2018-05-01")


def test_joins_follow_their_parents():
    assert resolve_joins(["products", "sellers", "order_items"]) == ["order_items", "products", "sellers"]
    with pytest.raises(ValueError):
        resolve_joins(["nowhere"])


@pytest.mark.parametrize("bad", [dict(kind="median"), dict(date_column="o_date"), dict(period_a=("2018-13-01", "2018-04-01")),
                                 dict(joins=("order_items", "order_payments"))])
def test_spec_is_checked_before_any_job(bad):
    with pytest.raises(ValueError):
        MetricSpec(**{**dict(name="x", kind="total", order_value="1", period_a=A, period_b=B), **bad})


def test_a_value_does_not_depend_on_its_spelling(spark, sf):
    shop = standin(spark, sf)
    a, b = ("1997-01-01", "1997-07-01"), ("1997-07-01", "1998-01-01")
    twice = shop.with_tables(orders=shop.orders.unionByName(shop.orders.limit(500))) if hasattr(shop, "with_tables") else shop
    plain = MetricSpec("x", "total", "SUM(oi.price)", a, b, ("order_items",))
    other = MetricSpec("x", "total", "SUM(oi.price) + 0", a, b, ("order_items",))
    rows = lambda spec: sorted((r.order_id, r.period, None if r.v is None else round(r.v, 4)) for r in C.base_values(twice, spec).collect())
    assert rows(plain) == rows(other)


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(3)
    rows = [("state", f"s{i}", float(rng.randint(0, 50)), float(rng.randint(0, 80)), float(rng.randint(60, 90)), float(rng.randint(0, 90) + 90)) for i in range(12)]
    return spark.createDataFrame(rows, "dimension string, segment string, total_a double, total_b double, n_a double, n_b double")


def test_shares_add_up(wide):
    out = C.segment_contributions(wide, "total_a", "total_b")
    assert out.agg(F.sum("share_of_change")).first()[0] == pytest.approx(1.0)


def test_abnormal_changes_cancel(wide):
    assert C.rank_abnormal_total(wide, F.lit(5.0)).agg(F.sum("abnormal")).first()[0] == pytest.approx(0.0, abs=1e-9)


def test_mix_rate_interaction_is_the_whole_change(wide):
    r = C.mix_rate_totals(wide).first()
    assert r.mix_effect + r.rate_effect + r.interaction == pytest.approx(r.delta)


def test_empty_segments_have_rate_zero(spark):
    wide = spark.createDataFrame([("d", "x", 0.0, 3.0, 0.0, 3.0), ("d", "y", 1.0, 1.0, 2.0, 2.0)], "dimension string, segment string, total_a double, total_b double, n_a double, n_b double")
    rates = {r.segment: r.rate_a for r in C.mix_rate_segments(wide).collect()}
    assert rates == {"x": 0.0, "y": 0.5}


PLANTED = {
    "orders": (lambda s: P.drop_orders(s, "NATION_3", *B97, 90), ("customer_state", "NATION_3")),
    "late_rate": (lambda s: P.delay_deliveries(s, "NATION_5", *B97, 90), ("customer_state", "NATION_5")),
    "cancellation_rate": (lambda s: P.cancel_orders(s, "boleto", *B97, 90), ("payment_type", "boleto")),
    "review_score": (lambda s: P.worsen_reviews(s, "Brand#2", *B97, 100), ("product_category", "Brand#2")),
}
A97, B97 = ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01")


@pytest.mark.parametrize("metric", list(PLANTED))
def test_planted_cause_leads(spark, metric):
    plant, expected = PLANTED[metric]
    dims = ("customer_state", "customer_city", "seller_state", "product_category")
    if metric == "cancellation_rate":
        dims += ("payment_type",)  # nearly every stand-in order has all three types, so they overlap too much for the other metrics
    out = explain_change(plant(standin(spark, "/root/testdata/sf0.01")), metric_catalog(A97, B97)[metric], dims)
    leading = [(r.dimension, r.segment) for r in out.where("section = 'candidate'").orderBy("place").collect()]
    assert expected in leading[:3], leading


def test_repeated_payments_outrank_business_causes(spark):
    shop = P.repeat_payments(standin(spark, "/root/testdata/sf0.01"), *B97, 60)
    out = explain_change(shop, metric_catalog(A97, B97)["revenue"], ("customer_state", "payment_type")).collect()
    first = next(r for r in out if r.section == "candidate" and r.place == 1)
    assert (first.dimension, first.segment) == ("data_quality", "order_payments")
    assert next(r.segment for r in out if r.section == "confidence") == "high"


def test_b_wins_where_periods_overlap(spark, sf):
    shop = standin(spark, sf)
    spec = MetricSpec("x", "total", "1", ("1997-01-01", "1998-01-01"), ("1997-06-01", "1997-07-01"))
    june = C.base_values(shop, spec).where("period = 'B'").count()
    start = datetime(1997, 6, 1)
    assert june == shop.orders.where(F.col("order_purchase_timestamp").between(start, start + timedelta(days=30) - timedelta(microseconds=1))).count()
