"""M and A6: provider events made from the driver's events, and sensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import table
from shiftscope.functions.hashing import hmac_sha256
from shiftscope.functions.ordered import positions
from shiftscope.operators import events as E, sensors as S
from shiftscope.session import spread
from shiftscope.sources import webhooks as W

SECRET, TOKEN = "stand-in-secret", "stand-in-token"

# every event as a provider message: even ids are payments, odd ids shipments, each 9th repeats the id of the one before,
# each 11th has no time, each 50th no order, each 97th a broken body, each 101st an unknown provider
_RAW = """ev as (select event_id, event_id as arrival, case when event_id % 101 = 0 then 'other' when event_id % 2 = 0 then 'razorpay' else 'shiprocket' end as provider,
      case when event_id % 9 = 0 and event_id > 1 then event_id - 2 else event_id end as eid, case when event_id % 50 = 0 then '' else user_id::varchar end as order_id,
      case event_type when 'purchase' then 'payment.captured' when 'signup' then 'payment.authorized' when 'error' then 'payment.failed'
        when 'click' then 'refund.processed' else 'payment.viewed' end as pay_type, 'shipment.' || lower(event_type) as ship_type,
      case when event_id % 11 <> 0 then date_trunc('second', ts + (event_id * 7919 % 200000 * interval '1' second)) end as tm, (json_extract(props, '$.k'))::bigint as amount, event_id % 97 = 0 as broken from events),
    pw as (select *, provider || '-' || eid as key, case when broken then 'invalid JSON' when provider = 'other' then 'unknown provider' end as problem,
      case when broken and provider = 'razorpay' then '' when broken and provider = 'shiprocket' then 'shipment.' when provider = 'razorpay' then pay_type when provider = 'shiprocket' then ship_type end as event_type from ev),
    ok as (select arrival, provider, key as event_id, event_type, order_id, tm as occurred_at, case when provider = 'razorpay' then amount end as amount from pw where problem is null),
    first as (select * from ok qualify row_number() over (partition by provider, event_id order by arrival) = 1)"""


def messages(spark, sf):
    e = spread(table(spark, sf, "events"))
    i = F.col("event_id")
    at = F.date_trunc("second", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i * 7919 % 200000)).cast("timestamp"))
    at = F.when(i % 11 != 0, at)
    order_id = F.when(i % 50 == 0, "").otherwise(F.col("user_id").cast("string"))
    kind = F.col("event_type")
    pay = (F.when(kind == "purchase", "payment.captured").when(kind == "signup", "payment.authorized").when(kind == "error", "payment.failed")
           .when(kind == "click", "refund.processed").otherwise("payment.viewed"))
    amount = F.get_json_object("props", "$.k").cast("bigint")
    entity = F.struct(F.concat(F.lit("pay_"), i).alias("id"), order_id.alias("order_id"), amount.alias("amount"), kind.alias("status"))
    payment = F.to_json(F.struct(pay.alias("event"), F.unix_timestamp(at).alias("created_at"), F.struct(F.struct(entity.alias("entity")).alias("payment")).alias("payload")))
    shipment = F.to_json(F.struct(order_id.alias("order_id"), F.concat(F.lit("awb"), i).alias("awb"), F.upper(kind).alias("current_status"),
                                  F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("current_timestamp")))
    provider = F.when(i % 101 == 0, "other").when(i % 2 == 0, W.PAYMENT_PROVIDER).otherwise(W.SHIPMENT_PROVIDER)
    body = F.when(i % 97 == 0, F.lit("{broken")).when(i % 2 == 0, payment).otherwise(shipment)
    eid = F.when((i % 9 == 0) & (i > 1), i - 2).otherwise(i)
    return e.select(i.alias("arrival"), provider.alias("provider"), body.alias("body"), eid.alias("eid")).withColumn(
        "event_id", F.concat_ws("-", "provider", F.col("eid").cast("string"))).drop("eid")


def accepted(spark, sf):
    rows = W.parse_webhook(messages(spark, sf)).where("problem is null")
    return rows.select("arrival", "provider", "event_id", "event_type", "order_id", "occurred_at", "amount")


def _utc(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("A6_parse_webhook", """select arrival, provider, key as event_id, event_type, case when broken or provider = 'other' then '' else order_id end as order_id,
    case when not broken and provider <> 'other' then tm end as occurred_at, case when provider = 'razorpay' and not broken then amount end as amount, problem from pw""", _RAW)
def _(spark, sf):
    return _utc(W.parse_webhook(messages(spark, sf)).drop("body"), "occurred_at")


@query("M1_verify_signature", "select provider, arrival % 13 <> 0 and provider <> 'other' as valid, count(*) as n from ev group by 1, 2", _RAW)
def _(spark, sf):
    rows = messages(spark, sf)
    # every 13th message is signed with another secret
    good = F.when(F.col("provider") == W.PAYMENT_PROVIDER, hmac_sha256(F.col("body"), SECRET)).otherwise(F.lit(TOKEN))
    bad = F.when(F.col("provider") == W.PAYMENT_PROVIDER, hmac_sha256(F.col("body"), "x")).otherwise(F.lit("x"))
    rows = rows.withColumn("signature", F.when(F.col("arrival") % 13 == 0, bad).otherwise(good))
    valid = W.signature_valid("provider", "body", "signature", SECRET, TOKEN)
    return rows.groupBy("provider", valid.alias("valid")).agg(F.count("*").alias("n"))


@query("M2_idempotency_key", """select event_id, case when event_id % 3 = 0 then substr(sha256(props), 1, 40) else event_id::varchar end as key from events""")
def _(spark, sf):
    given = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", W.idempotency_key(given, F.col("props")).alias("key"))


@query("M3_dedupe_events", "select * from first", _RAW)
def _(spark, sf):
    return _utc(E.dedupe_events(accepted(spark, sf)), "occurred_at")


@query("M3_new_events", "select arrival, provider, event_id from first where event_id not in (select key from pw where amount > 50)", _RAW)
def _(spark, sf):
    rows = accepted(spark, sf)
    landed = messages(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("arrival"), "props"), "arrival").where(
        F.get_json_object("props", "$.k").cast("int") > 50)
    return E.new_events(rows, landed).select("arrival", "provider", "event_id")


# the sequential rule itself, one event at a time in arrival order
_STATE = _RAW + """, tk as (select *, case when provider = 'razorpay' then case event_type when 'payment.authorized' then 'authorized' when 'payment.captured' then 'captured'
        when 'payment.failed' then 'failed' when 'refund.processed' then 'refunded' end else substr(event_type, 10) end as status from first where order_id <> ''),
    sq as (select *, row_number() over (partition by order_id, provider order by arrival) as n from tk where status is not null),
    fold as (select order_id, provider, n, status, amount, occurred_at as updated_at from sq where n = 1 union all
      select s.order_id, s.provider, s.n, case when s.occurred_at <= f.updated_at then f.status else s.status end,
        case when s.occurred_at <= f.updated_at then f.amount else s.amount end, case when s.occurred_at <= f.updated_at then f.updated_at else s.occurred_at end
      from fold f join sq s on s.order_id = f.order_id and s.provider = f.provider and s.n = f.n + 1),
    fin as (select * from fold qualify row_number() over (partition by order_id, provider order by n desc) = 1),
    st as (select o.order_id, coalesce(p.status, '') as payment_status, coalesce(s.status, '') as shipment_status, p.amount, p.updated_at as payment_updated_at,
      s.updated_at as shipment_updated_at from (select distinct order_id from tk) o left join fin p on p.order_id = o.order_id and p.provider = 'razorpay'
      left join fin s on s.order_id = o.order_id and s.provider = 'shiprocket')"""


def state(spark, sf):
    return E.order_state(E.dedupe_events(accepted(spark, sf)))


@query("M4_order_state", "select * from st", _STATE)
def _(spark, sf):
    return _utc(state(spark, sf), "payment_updated_at", "shipment_updated_at")


_OUT = """oc as (select event_id as arrival, case when event_id % 101 = 0 then 'other' when event_id % 2 = 0 then 'razorpay' else 'shiprocket' end as provider,
    case when event_id % 50 = 0 then '' else user_id::varchar end as order_id, (event_id % 6)::int as attempts, case when event_id % 8 = 0 then 'processed' else 'received' end as status,
    event_id % 5 = 0 as fails, ts as received_at from events),
  done as (select arrival, provider, order_id, received_at, case when status = 'processed' then attempts else attempts + 1 end as attempts,
    case when status = 'processed' then 'processed' when provider = 'other' or order_id = '' then 'dead_letter' when not fails then 'processed'
      when attempts + 1 >= 5 then 'dead_letter' else 'failed' end as status,
    case when status = 'processed' then '' when provider = 'other' then 'Unknown provider other' when order_id = '' then 'Event has no order id'
      when fails then 'TimeoutError: provider' else '' end as last_error from oc)"""


def outcomes(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        i.alias("arrival"), F.when(i % 101 == 0, "other").when(i % 2 == 0, W.PAYMENT_PROVIDER).otherwise(W.SHIPMENT_PROVIDER).alias("provider"),
        F.when(i % 50 == 0, "").otherwise(F.col("user_id").cast("string")).alias("order_id"), (i % 6).cast("int").alias("attempts"),
        F.when(i % 8 == 0, "processed").otherwise("received").alias("status"), F.lit("").alias("last_error"), F.col("ts").alias("received_at"))
    return E.event_outcome(rows, E.permanent_error(), F.when(F.col("arrival") % 5 == 0, "TimeoutError: provider"))


@query("M5_event_outcome", "select * from done", _OUT)
def _(spark, sf):
    return outcomes(spark, sf)


@query("M6_retry_schedule", """select arrival, attempts, received_at + least(pow(2, attempts) * 10, 3600)::int * interval '1' second as next_at from done where status = 'failed'""", _OUT)
def _(spark, sf):
    return E.retry_schedule(outcomes(spark, sf), "received_at").select("arrival", "attempts", "next_at")


@query("M7_stale_failed", """select arrival, received_at from done where status = 'failed' and received_at < timestamp '2024-01-20' - interval '10' minute""", _OUT)
def _(spark, sf):
    return E.stale_failed(outcomes(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz")).select("arrival", "received_at")


@query("M8_replay", """select arrival, case when status = 'dead_letter' then case when provider = 'other' or order_id = '' then 'dead_letter' else 'processed' end else status end as status,
    case when status = 'dead_letter' then 1 else attempts end as attempts from done""", _OUT)
def _(spark, sf):
    fresh = E.replay(outcomes(spark, sf), F.col("status") == "dead_letter")
    again = E.event_outcome(fresh.where("status = 'received'"), E.permanent_error(), F.lit(None).cast("string"))
    return fresh.where("status <> 'received'").unionByName(again).select("arrival", "status", "attempts")


_REC = _STATE + """, prov as (select order_id, case when order_id::int % 11 = 0 then 'changed' else payment_status end as payment_status,
      amount + case when order_id::int % 7 = 0 then 1 else 0 end as amount from st),
    loc as (select * from st where order_id::int % 13 <> 0),
    iss as (select p.order_id, case when l.order_id is null then 'missing_locally' when l.payment_status <> p.payment_status then 'status_mismatch'
        when l.amount is not null and l.amount is distinct from p.amount then 'amount_mismatch' end as kind, l.payment_status as ls, l.amount as la, p.payment_status as ps, p.amount as pa
      from prov p left join loc l using (order_id))"""


def _books(spark, sf):
    local = state(spark, sf)
    key = F.col("order_id").cast("int")
    theirs = local.select("order_id", F.when(key % 11 == 0, "changed").otherwise(F.col("payment_status")).alias("payment_status"),
                          (F.col("amount") + F.when(key % 7 == 0, 1).otherwise(0)).alias("amount"))
    return theirs, local.where(key % 13 != 0)


@query("M9_reconcile", """select order_id, kind, case when kind = 'amount_mismatch' then la::varchar else coalesce(ls, '') end as local_value,
    case when kind = 'amount_mismatch' then pa::varchar else ps end as provider_value, false as resolved from iss where kind is not null""", _REC)
def _(spark, sf):
    return E.reconcile(*_books(spark, sf))


@query("M10_status_counts", """select s as status, (select count(*) from done where done.status = s) as events from (select unnest(['received', 'processed', 'failed', 'dead_letter']) as s)""", _OUT)
def _(spark, sf):
    return E.status_counts(outcomes(spark, sf))


@query("M11_event_filter", "select arrival, provider, order_id, status from done where status = 'failed' and provider = 'shiprocket'", _OUT)
def _(spark, sf):
    return E.event_filter(outcomes(spark, sf), status="failed", provider=W.SHIPMENT_PROVIDER).select("arrival", "provider", "order_id", "status")


@query("M11_open_issues", "select order_id, kind, order_id::int as found_at from iss where kind is not null and order_id::int % 2 = 1", _REC)
def _(spark, sf):
    key = F.col("order_id").cast("int")
    issues = E.reconcile(*_books(spark, sf)).withColumns({"found_at": key, "resolved": key % 2 == 0})
    return E.open_issues(issues).select("order_id", "kind", "found_at")


@query("M12_order_timeline", """select order_id, 'state' as section, cast(null as timestamp) as "at", trim(concat_ws(' ', payment_status, shipment_status, amount::varchar)) as what
      from st where order_id in (select order_id from iss where kind is not null)
    union all select order_id, 'event', occurred_at, event_type from first where order_id in (select order_id from iss where kind is not null)
    union all select order_id, 'issue', null, kind from iss where kind is not null""", _REC)
def _(spark, sf):
    issues = E.reconcile(*_books(spark, sf))
    return _utc(E.order_timeline(issues, state(spark, sf), E.dedupe_events(accepted(spark, sf)), issues), "at")


# ------------------------------------------------------------------ sensors
_KAL = """rd as (select user_id as machine_id, row_number() over (partition by user_id order by ts, event_id) as t, value from events),
    kf as (select machine_id, t, value, value as level, 0.0::double as slope, 1000.0::double as p00, 0.0::double as p01, 1000.0::double as p11 from rd where t = 1 union all
      select machine_id, t, value, level + slope + a / (a + 0.25) * (value - level - slope), slope + b / (a + 0.25) * (value - level - slope),
        (1 - a / (a + 0.25)) * a, (1 - a / (a + 0.25)) * b, c - b / (a + 0.25) * b
      from (select r.machine_id, r.t, r.value, k.level, k.slope, p00 + 2 * p01 + p11 + 0.25e-5 as a, p01 + p11 + 0.5e-5 as b, p11 + 1e-5 as c
        from kf k join rd r on r.machine_id = k.machine_id and r.t = k.t + 1)),
    eta as (select *, case when level >= 60 then 0.0 when slope > 0 then (60 - level) / slope end as eta from kf),
    al as (select machine_id, t as at_step, round(level, 2) as smoothed_level, round(slope, 4) as slope_per_step, round(eta, 1) as predicted_steps_to_failure
      from eta where eta <= 48 and t > 10 qualify row_number() over (partition by machine_id order by t) = 1)"""
LEVEL = 60.0


def readings(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("machine_id"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return positions(rows, ["machine_id"], "at", ["event_id"], out="t").select("machine_id", "t", "value")


@query("M13_kalman_monitor", "select machine_id, t, value, round(level, 6) as level, round(slope, 6) as slope from kf", _KAL)
def _(spark, sf):
    return rounded(S.kalman_monitor(readings(spark, sf), position="t"), "level", "slope")


@query("M13_kalman_blocks", "select machine_id, t, value, round(level, 6) as level, round(slope, 6) as slope from kf", _KAL)
def _(spark, sf):
    # small blocks, so that block maps are chained at this size too
    return rounded(S.kalman_monitor(readings(spark, sf), block=32), "level", "slope")


@query("M14_failure_eta", "select machine_id, t, round(eta, 4) as eta from eta", _KAL)
def _(spark, sf):
    states = S.kalman_monitor(readings(spark, sf))
    return rounded(states.select("machine_id", "t", S.failure_eta(F.col("level"), F.col("slope"), LEVEL).alias("eta")), "eta", digits=4)


@query("M15_failure_alerts", "select * from al", _KAL)
def _(spark, sf):
    return S.failure_alerts(S.kalman_monitor(readings(spark, sf)), LEVEL)


@query("M16_alert_quality", """select machine_id, failed_at, at_step, failed_at - at_step as warning_lead, failed_at is null and at_step is not null as false_alarm from (
    select machine_id, min(case when value >= 60 then t end) as failed_at from rd group by 1) left join al using (machine_id)""", _KAL)
def _(spark, sf):
    rows = readings(spark, sf)
    return S.alert_quality(rows, S.failure_alerts(S.kalman_monitor(rows), LEVEL), LEVEL)
