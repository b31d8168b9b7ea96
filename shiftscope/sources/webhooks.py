"""Signed provider messages: authenticity, parsing, idempotency key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shiftscope.functions.hashing import hmac_sha256

# ---- fixed values: provider names, payload shapes, tracked payment states ----
PAYMENT_PROVIDER, SHIPMENT_PROVIDER = "razorpay", "shiprocket"
PAYMENT_SCHEMA = (
    "event string, created_at double, payload struct<payment: struct<entity: struct<id: string, order_id: string, amount: bigint, status: string>>>"
)
SHIPMENT_SCHEMA = "order_id string, awb string, current_status string, current_timestamp string"
PAYMENT_STATUS = {
    "payment.authorized": "authorized",
    "payment.captured": "captured",
    "payment.failed": "failed",
    "refund.processed": "refunded",
}
# ---- end of fixed values ----


def signature_valid(provider: str, body: str, signature: str, payment_secret: str, shipment_token: str) -> Column:
    """Payment messages carry an HMAC of the raw body, shipment messages a shared token."""
    signed = F.lower(F.col(signature)) == hmac_sha256(F.col(body), payment_secret)
    token = F.col(signature) == F.lit(shipment_token)
    checked = F.when(F.col(provider) == PAYMENT_PROVIDER, signed).when(F.col(provider) == SHIPMENT_PROVIDER, token)
    return F.coalesce(checked, F.lit(False))


def idempotency_key(event_id: Column, body: Column) -> Column:
    """The provider's event id, else the first 40 hex digits of the body's sha256."""
    return F.coalesce(F.when(event_id != "", event_id), F.substring(F.sha2(body, 256), 1, 40))


def parse_webhook(messages: DataFrame, provider: str = "provider", body: str = "body") -> DataFrame:
    """Add event_type, order_id, occurred_at, amount and ``problem`` (NULL if the message is acceptable)."""
    raw = F.col(body)
    is_payment, is_shipment = F.col(provider) == PAYMENT_PROVIDER, F.col(provider) == SHIPMENT_PROVIDER
    rows = messages.withColumns({"_p": F.from_json(raw, PAYMENT_SCHEMA), "_s": F.from_json(raw, SHIPMENT_SCHEMA)})
    entity = F.col("_p.payload.payment.entity")
    epoch, iso = F.col("_p.created_at"), F.col("_s.current_timestamp")
    at_payment = F.when(epoch != 0, F.timestamp_micros((epoch * 1_000_000).cast("bigint")))
    at_shipment = F.try_to_timestamp(F.when(iso != "", iso))
    problem = (
        F.when(F.try_parse_json(raw).isNull(), "invalid JSON")
        .when(~(is_payment | is_shipment), "unknown provider")
        .when(is_shipment & (iso != "") & at_shipment.isNull(), "invalid time")
    )
    status = F.concat(F.lit("shipment."), F.lower(F.coalesce("_s.current_status", F.lit(""))))
    return rows.withColumns(
        {
            "event_type": F.when(is_payment, F.coalesce("_p.event", F.lit(""))).when(is_shipment, status),
            "order_id": F.coalesce(F.when(is_payment, entity["order_id"]).when(is_shipment, F.col("_s.order_id")), F.lit("")),
            "occurred_at": F.when(is_payment, at_payment).when(is_shipment, at_shipment),
            "amount": F.when(is_payment, entity["amount"]),
            "problem": problem,
        }
    ).drop("_p", "_s")
