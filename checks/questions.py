"""I: the thirty everyday questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.standin import shop
from shiftscope.plans.questions import QUESTIONS

_DELIVERED = "order_status = 'delivered' and order_delivered_customer_date is not null"
_LATE = "order_delivered_customer_date > order_estimated_delivery_date"

SQL = {
    "I01_order_count": "select count(*) as n from sh_orders",
    "I02_people": "select count(distinct customer_unique_id) as n from sh_customers",
    "I03_seller_count": "select count(*) as n from sh_sellers",
    "I04_delivered_count": "select count(*) as n from sh_orders where order_status = 'delivered'",
    "I05_orders_by_status": "select order_status, count(*) as n from sh_orders group by 1",
    "I06_total_payments": "select round(sum(payment_value), 2) as value from sh_payments",
    "I07_mean_review": "select round(avg(review_score), 8) as value from sh_reviews",
    "I08_largest_customer_state": "select customer_state from sh_customers group by 1 order by count(*) desc, 1 limit 1",
    "I09_top_categories": "select product_category_name, count(*) as n from sh_items join sh_products using (product_id) "
                          "group by 1 order by n desc, 1 limit 5",
    "I09_top_categories_english": "select product_category_name_english, count(*) as n from sh_items join sh_products using (product_id) "
                                  "join sh_translation using (product_category_name) group by 1 order by n desc, 1 limit 5",
    "I10_commonest_payment_type": "select payment_type from sh_payments group by 1 order by count(*) desc, 1 limit 1",
    "I11_orders_in_november": "select count(*) as n from sh_orders where order_purchase_timestamp >= timestamp '1997-11-01' "
                              "and order_purchase_timestamp < timestamp '1997-12-01'",
    "I12_orders_per_month": "select date_trunc('month', order_purchase_timestamp)::date as month, count(*) as n from sh_orders "
                            "where year(order_purchase_timestamp) = 1997 group by 1",
    "I13_mean_freight": "select round(avg(freight_value), 4) as value from sh_items",
    "I14_mean_delivery_days": "select round(avg((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0), 4) "
                              f"as value from sh_orders where {_DELIVERED}",
    "I15_late_percentage": f"select round(100.0 * avg(case when {_LATE} then 1 else 0 end), 4) as value from sh_orders where {_DELIVERED}",
    "I16_best_seller": "select seller_id from sh_items group by 1 order by sum(price) desc, 1 limit 1",
    "I17_canceled_count": "select count(*) as n from sh_orders where order_status = 'canceled'",
    "I18_mean_installments": "select round(avg(payment_installments), 4) as value from sh_payments where payment_type = 'credit_card'",
    "I19_products_without_category": "select count(*) as n from sh_products where product_category_name is null",
    "I20_top_states_by_payment": "select customer_state, round(sum(payment_value), 2) as value from sh_payments join sh_orders using (order_id) "
                                 "join sh_customers using (customer_id) group by 1 order by 2 desc, 1 limit 3",
    "I21_payment_per_order": "select round(sum(payment_value) / count(distinct order_id), 4) as value from sh_payments",
    "I22_five_star_percentage": "select round(100.0 * avg(case when review_score = 5 then 1 else 0 end), 4) as value from sh_reviews",
    "I23_seller_cities": "select count(distinct seller_city) as n from sh_sellers",
    "I24_busiest_month": "select date_trunc('month', order_purchase_timestamp)::date as month from sh_orders group by 1 order by count(*) desc, 1 limit 1",
    "I25_mean_price_in_category": "select round(avg(price), 4) as value from sh_items join sh_products using (product_id) "
                                  "where product_category_name = 'Brand#17'",
    "I26_multi_item_orders": "select count(*) as n from (select order_id from sh_items group by 1 having count(*) > 1)",
    "I27_customers_in_state": "select count(*) as n from sh_customers where customer_state = 'NATION_7'",
    "I28_freight_in_year": "select round(sum(freight_value), 2) as value from sh_items join sh_orders using (order_id) "
                           "where year(order_purchase_timestamp) = 1998",
    "I29_largest_category_english": "select product_category_name_english from sh_products join sh_translation using (product_category_name) "
                                    "group by 1 order by count(*) desc, 1 limit 1",
    "I30_review_late_or_not": f"select case when {_LATE} then 'late' else 'on_time' end as arrival, round(avg(review_score), 6) as value "
                              f"from sh_orders join sh_reviews using (order_id) where {_DELIVERED} group by 1",
}
_DIGITS = {"I06_total_payments": 2, "I20_top_states_by_payment": 2, "I28_freight_in_year": 2, "I07_mean_review": 8, "I30_review_late_or_not": 6}


def _runner(name):
    def run(spark, sf):
        out = QUESTIONS[name](shop(spark, sf))
        return out.withColumn("value", F.round("value", _DIGITS.get(name, 4))) if "value" in out.columns else out

    return run


for _name in QUESTIONS:
    query(_name, SQL[_name])(_runner(_name))
