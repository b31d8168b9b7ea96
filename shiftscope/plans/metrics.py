"""What to measure: metric specs, join paths and the dimensions a change is broken down by."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date

# ---- fixed values: aliases, join conditions, dimensions and date columns of the shop model ----
JOINS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "customers": ("c", "c.customer_id = o.customer_id", ()),
    "order_items": ("oi", "oi.order_id = o.order_id", ()),
    "order_payments": ("op", "op.order_id = o.order_id", ()),
    "order_reviews": ("r", "r.order_id = o.order_id", ()),
    "products": ("p", "p.product_id = oi.product_id", ("order_items",)),
    "sellers": ("s", "s.seller_id = oi.seller_id", ("order_items",)),
}
DIMENSIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "customer_state": ("c.customer_state", ("customers",)),
    "customer_city": ("c.customer_city", ("customers",)),
    "seller_id": ("oi.seller_id", ("order_items",)),
    "seller_state": ("s.seller_state", ("order_items", "sellers")),
    "product_category": ("p.product_category_name", ("order_items", "products")),
    "payment_type": ("op.payment_type", ("order_payments",)),
}
DATE_COLUMNS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
KINDS = ("total", "per_order_average")
# ---- end of fixed values ----

# tables that can hold several rows per order, so joining two of them multiplies rows
MANY_SIDED = ("order_items", "order_payments", "order_reviews")


def resolve_joins(names: tuple[str, ...] | list[str]) -> list[str]:
    """Join order without repeats, every table after the tables it hangs on."""
    done: dict[str, None] = {}
    waiting = list(reversed(list(names)))
    while waiting:
        name = waiting[-1]
        if name not in JOINS:
            raise ValueError(f"unknown join {name!r}")
        open_parents = [p for p in JOINS[name][2] if p not in done]
        if open_parents:
            waiting.extend(open_parents)
        else:
            done.setdefault(waiting.pop())
    return list(done)


@dataclass(frozen=True)
class MetricSpec:
    """A metric measured per order over two half-open periods [start, end)."""

    name: str
    kind: str
    order_value: str
    period_a: tuple[str, str]
    period_b: tuple[str, str]
    joins: tuple[str, ...] = ()
    date_column: str = "order_purchase_timestamp"
    order_filter: str | None = None
    allow_fanout: bool = False
    path: list[str] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {self.kind!r}")
        if self.date_column not in DATE_COLUMNS:
            raise ValueError(f"unknown date column {self.date_column!r}")
        for day in (*self.period_a, *self.period_b):
            date.fromisoformat(day)
        object.__setattr__(self, "path", resolve_joins(self.joins))
        many = [t for t in self.path if t in MANY_SIDED]
        if len(many) > 1 and not self.allow_fanout:
            raise ValueError(f"joining {' and '.join(many)} multiplies rows; pass allow_fanout=True to keep that")

    def between(self, period_a: tuple[str, str], period_b: tuple[str, str]) -> MetricSpec:
        return replace(self, period_a=period_a, period_b=period_b)


_LATE = "o.order_delivered_customer_date > o.order_estimated_delivery_date"


def metric_catalog(period_a: tuple[str, str], period_b: tuple[str, str]) -> dict[str, MetricSpec]:
    """The ten metrics of the business glossary."""
    delivered = "o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL"
    entries = {
        "orders": ("total", "1", ()),
        "delivered_orders": ("total", "MAX(CASE WHEN o.order_status = 'delivered' THEN 1 ELSE 0 END)", ()),
        "revenue": ("total", "SUM(op.payment_value)", ("order_payments",)),
        "item_revenue": ("total", "SUM(oi.price)", ("order_items",)),
        "freight": ("total", "SUM(oi.freight_value)", ("order_items",)),
        "late_rate": ("per_order_average", f"MAX(CASE WHEN {delivered} THEN CASE WHEN {_LATE} THEN 1 ELSE 0 END END)", ()),
        "cancellation_rate": ("per_order_average", "MAX(CASE WHEN o.order_status = 'canceled' THEN 1 ELSE 0 END)", ()),
        "review_score": ("per_order_average", "AVG(r.review_score)", ("order_reviews",)),
        "delivery_days": (
            "per_order_average",
            "MAX(timestampdiff(MICROSECOND, o.order_purchase_timestamp, o.order_delivered_customer_date) / 86400000000.0D)",
            (),
        ),
        "order_value": ("per_order_average", "SUM(op.payment_value)", ("order_payments",)),
    }
    return {n: MetricSpec(n, kind, value, period_a, period_b, joins) for n, (kind, value, joins) in entries.items()}
