"""Provider events to order state: dedupe, fold, outcomes, retries, reconciliation, look-ups (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.sources.webhooks import PAYMENT_PROVIDER, PAYMENT_STATUS, SHIPMENT_PROVIDER

# fixed values: event states and limits
STATUSES = ("received", "processed", "failed", "dead_letter")
MAX_ATTEMPTS = 5
RETRY_BASE_SECONDS, RETRY_MAX_SECONDS = 10, 3600
STALE_MINUTES = 10


def dedupe_events(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first delivery of every (provider, event_id). Each task keeps one row per key before the shuffle."""
    first = Window.partitionBy("provider", "event_id").orderBy(arrival)
    return events.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def new_events(events: DataFrame, landed: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First deliveries that are not in the landed table either, whatever their age."""
    return dedupe_events(events, arrival).join(landed.select("provider", "event_id"), ["provider", "event_id"], "left_anti")


def tracked_status() -> Column:
    """New status an event brings, NULL for event types nobody tracks."""
    names = F.create_map(*[F.lit(x) for pair in PAYMENT_STATUS.items() for x in pair])
    shipment = F.regexp_replace("event_type", "^shipment\\.", "")
    return F.when(F.col("provider") == PAYMENT_PROVIDER, F.try_element_at(names, F.col("event_type"))).when(
        F.col("provider") == SHIPMENT_PROVIDER, shipment
    )


def order_state(events: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Payment and shipment state of every order after all its events, taken in arrival order.

    The rule "apply unless older than or as old as the current state" is order dependent only through events without
    a time: such an event always applies and clears the guard. So the state is the newest event (ties: the one that came
    first) among those after the last untimed one, or that untimed event itself. Both parts are plain aggregates with
    map-side combine; no order's history is gathered anywhere.
    """
    rows = events.where(F.col("order_id") != "").select(
        "order_id", F.when(F.col("provider") == PAYMENT_PROVIDER, "payment").otherwise("shipment").alias("side"),
        tracked_status().alias("status"), "amount", "occurred_at", F.col(arrival).alias("seq"),
    )
    key = ["order_id", "side"]
    tracked, timed = F.col("status").isNotNull(), F.col("occurred_at").isNotNull()
    newest = F.max(F.when(tracked & timed, F.struct("occurred_at", (-F.col("seq")).alias("neg_seq"), "status", "amount")))
    reset = F.max(F.when(tracked & ~timed, F.struct("seq", "status", "amount")))
    once = rows.groupBy(*key).agg(newest.alias("best"), reset.alias("reset"))
    # only where the newest event came before the last untimed one, the events after that one are looked at again
    stale = F.col("reset").isNotNull() & (-F.col("best.neg_seq") < F.col("reset.seq"))
    again = rows.join(once.where(stale).select(*key, F.col("reset.seq").alias("after")), key).where(F.col("seq") > F.col("after"))
    later = again.groupBy(*key).agg(newest.alias("later"))
    chosen = F.when(stale, F.col("later")).otherwise(F.col("best"))
    state = once.join(later, key, "left").withColumn("pick", chosen).select(
        *key, F.coalesce("pick.status", "reset.status").alias("status"),
        F.when(F.col("pick").isNotNull(), F.col("pick.amount")).otherwise(F.col("reset.amount")).alias("amount"),
        F.col("pick.occurred_at").alias("updated_at"),
    )
    on = lambda side, col: F.max(F.when(F.col("side") == side, F.col(col)))
    wide = state.groupBy("order_id").agg(
        on("payment", "status").alias("p"), on("shipment", "status").alias("s"), on("payment", "amount").alias("amount"),
        on("payment", "updated_at").alias("payment_updated_at"), on("shipment", "updated_at").alias("shipment_updated_at"),
    )
    # an order whose events are all untracked still has an (empty) record
    return wide.select(
        "order_id", F.coalesce("p", F.lit("")).alias("payment_status"), F.coalesce("s", F.lit("")).alias("shipment_status"),
        "amount", "payment_updated_at", "shipment_updated_at",
    )


def event_outcome(events: DataFrame, permanent: Column, transient: Column) -> DataFrame:
    """One processing attempt: next status, attempts and error text; processed events stay as they are."""
    done = F.col("status") == "processed"
    tries = F.when(done, F.col("attempts")).otherwise(F.col("attempts") + 1)
    status = (
        F.when(done | (permanent.isNull() & transient.isNull()), "processed")
        .when(permanent.isNotNull() | (tries >= MAX_ATTEMPTS), "dead_letter")
        .otherwise("failed")
    )
    error = F.when(done, F.col("last_error")).otherwise(F.coalesce(permanent, transient, F.lit("")))
    return events.withColumns({"status": status, "attempts": tries, "last_error": error})


def permanent_error() -> Column:
    """Text of an error no retry can fix."""
    known = F.col("provider").isin(PAYMENT_PROVIDER, SHIPMENT_PROVIDER)
    return F.when(~known, F.concat(F.lit("Unknown provider "), F.col("provider"))).when(F.col("order_id") == "", "Event has no order id")


def retry_seconds(attempts: Column) -> Column:
    """Exponential back-off with an upper limit."""
    return F.least(F.pow(F.lit(2.0), attempts) * RETRY_BASE_SECONDS, F.lit(float(RETRY_MAX_SECONDS))).cast("bigint")


def retry_schedule(events: DataFrame, at: str) -> DataFrame:
    """Failed events with the time of their next attempt."""
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), retry_seconds(F.col("attempts")))
    return events.where(F.col("status") == "failed").withColumn("next_at", F.col(at) + wait)


def stale_failed(events: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    return events.where((F.col("status") == "failed") & (F.col("received_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))))


def replay(events: DataFrame, which: Column) -> DataFrame:
    """Give unprocessed events that match ``which`` a fresh start."""
    reset = which & (F.col("status") != "processed")
    return events.withColumns(
        {
            "status": F.when(reset, "received").otherwise(F.col("status")),
            "attempts": F.when(reset, F.lit(0)).otherwise(F.col("attempts")),
            "last_error": F.when(reset, F.lit("")).otherwise(F.col("last_error")),
        }
    )


def reconcile(provider_orders: DataFrame, local: DataFrame) -> DataFrame:
    """At most one issue per provider order: missing, then status, then amount. Local-only orders are not reported."""
    theirs = provider_orders.select("order_id", F.col("payment_status").alias("their_status"), F.col("amount").alias("their_amount"))
    ours = local.select("order_id", F.col("payment_status").alias("our_status"), F.col("amount").alias("our_amount"), F.lit(True).alias("found"))
    joined = theirs.join(ours, "order_id", "left")
    kind = (
        F.when(F.col("found").isNull(), "missing_locally")
        .when(F.col("our_status") != F.col("their_status"), "status_mismatch")
        .when(F.col("our_amount").isNotNull() & ~F.col("our_amount").eqNullSafe(F.col("their_amount")), "amount_mismatch")
    )
    by_amount = F.col("kind") == "amount_mismatch"
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "order_id", "kind",
        F.when(by_amount, F.col("our_amount").cast("string")).otherwise(F.coalesce("our_status", F.lit(""))).alias("local_value"),
        F.when(by_amount, F.col("their_amount").cast("string")).otherwise(F.col("their_status")).alias("provider_value"),
        F.lit(False).alias("resolved"),
    )


def status_counts(events: DataFrame) -> DataFrame:
    """Events per status, with a row for every status."""
    one = events.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return one.unpivot([], list(STATUSES), "status", "events")


def event_filter(events: DataFrame, **wanted: str | None) -> DataFrame:
    """Events with the given status, provider and / or order_id."""
    for col, value in wanted.items():
        if value:
            events = events.where(F.col(col) == value)
    return events


def open_issues(issues: DataFrame) -> DataFrame:
    return issues.where(~F.col("resolved")).orderBy(F.col("found_at").desc(), "order_id")


def order_timeline(orders: DataFrame, state: DataFrame, events: DataFrame, issues: DataFrame) -> DataFrame:
    """Everything known about a set of orders: (order_id, section, at, what), state first, then history, then issues."""
    pick = lambda df: df.join(orders.select("order_id").distinct(), "order_id", "left_semi")
    none = F.lit(None).cast("timestamp")
    text = F.concat_ws(" ", F.col("payment_status"), F.col("shipment_status"), F.col("amount").cast("string"))
    return (
        pick(state).select("order_id", F.lit("state").alias("section"), none.alias("at"), F.trim(text).alias("what"))
        .unionByName(pick(events).select("order_id", F.lit("event").alias("section"), F.col("occurred_at").alias("at"), F.col("event_type").alias("what")))
        .unionByName(pick(issues.where(~F.col("resolved"))).select("order_id", F.lit("issue").alias("section"), none.alias("at"), F.col("kind").alias("what")))
    )
