"""N: runs, log and scoring, made from the conversations (one run per conversation, one query per turn)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.standin import table
from shiftscope.operators import audit as A, scoring as S

_RUNS = """rn as (select conv_id as run_id, 'question ' || (conv_id % 40) as question, 'set' || (conv_id % 4) as dataset, case when conv_id % 6 = 0 then 'failed' else 'ok' end as status,
      sum(('0x' || substr(md5(text), 1, 8))::bigint)::varchar as report, max(conv_id) * 60 as created_at from conversations group by conv_id),
    qy as (select conv_id as run_id, 'Q' || turn as query_id, md5(text) as sql_executed, length(text)::int as row_count, case when turn % 3 = 2 then 'timeout' end as error, turn as no from conversations),
    qh as (select run_id, no, sha256(to_json({'error': error, 'query_id': query_id, 'row_count': row_count, 'sql_executed': sql_executed})::varchar) as h from qy),
    bl as (select run_id, no // 1024 as block, sha256(string_agg(h, ',' order by no)) as h, count(*) as n from qh group by 1, 2),
    dg as (select r.run_id, sha256(to_json({'created_at': created_at, 'dataset': dataset, 'question': question, 'report': report, 'run_id': r.run_id, 'status': status})::varchar || '|' || coalesce(blocks, '')) as digest,
      coalesce(n, 0)::bigint as queries from rn r left join (select run_id, string_agg(h, ',' order by block) as blocks, sum(n) as n from bl group by 1) b on b.run_id = r.run_id)"""


def runs(spark, sf):
    turns = table(spark, sf, "conversations")
    # the report stands for all turns of the conversation: a sum of their hashes, which needs no gathering
    head = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    per = turns.groupBy(F.col("conv_id").alias("run_id")).agg(F.sum(head).cast("string").alias("report"))
    i = F.col("run_id")
    return per.select(i, F.concat(F.lit("question "), i % 40).alias("question"), F.concat(F.lit("set"), i % 4).alias("dataset"),
                      F.when(i % 6 == 0, "failed").otherwise("ok").alias("status"), "report", (i * 60).alias("created_at"))


def queries_of_runs(spark, sf):
    t = F.col("turn")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.concat(F.lit("Q"), t).alias("query_id"), F.md5("text").alias("sql_executed"),
        F.length("text").alias("row_count"), F.when(t % 3 == 2, "timeout").alias("error"))


def digests(spark, sf):
    return A.run_digests(runs(spark, sf), queries_of_runs(spark, sf))


@query("N1_run_digest", "select * from dg", _RUNS)
def _(spark, sf):
    return digests(spark, sf)


_CHAIN = _RUNS + """, en as (select dataset as chain, row_number() over (partition by dataset order by created_at) as seq, 'run_recorded' as event, r.run_id, digest as payload, created_at::varchar as "at"
      from rn r join dg on dg.run_id = r.run_id),
    ed as (select *, sha256(to_json({'at': "at", 'chain': chain, 'event': event, 'payload': payload, 'run_id': run_id, 'seq': seq})::varchar) as d from en),
    lg as (select chain, seq, event, run_id, payload, "at", repeat('0', 64) as prev_hash, sha256(repeat('0', 64) || d) as hash from ed where seq = 1 union all
      select e.chain, e.seq, e.event, e.run_id, e.payload, e."at", l.hash, sha256(l.hash || e.d) from lg l join ed e on e.chain = l.chain and e.seq = l.seq + 1)"""


def entries(spark, sf):
    return runs(spark, sf).join(digests(spark, sf), "run_id").select(
        F.col("dataset").alias("chain"), F.lit("run_recorded").alias("event"), "run_id", F.col("digest").alias("payload"), F.col("created_at").cast("string").alias("at"),
        F.col("created_at").alias("order_no"))


def log(spark, sf):
    return A.append_chain(entries(spark, sf))


@query("N2_append_chain", "select * from lg", _CHAIN)
def _(spark, sf):
    return log(spark, sf)


def tampered(spark, sf):
    """Every 17th entry edited, every 23rd removed."""
    rows = log(spark, sf).where(F.col("run_id") % 23 != 0)
    return rows.withColumn("payload", F.when(F.col("run_id") % 17 == 0, F.lit("edited")).otherwise(F.col("payload")))


@query("N3_verify_chain", """select chain, seq, 'entry altered, removed or out of order' as problem from (select *, lag(seq) over (partition by chain order by seq) as before from lg where run_id % 23 <> 0)
    where run_id % 17 = 0 or (before is null and seq <> 1) or before <> seq - 1""", _CHAIN)
def _(spark, sf):
    return A.verify_chain(tampered(spark, sf))


@query("N3_verify_intact", "select count(*) as entries, 0::bigint as problems, true as intact from lg", _CHAIN)
def _(spark, sf):
    rows = log(spark, sf)
    return A.audit_summary(rows, A.verify_chain(rows), A.verify_runs(rows, digests(spark, sf)))


@query("N4_verify_runs", """select run_id, 'run deleted' as problem from rn where run_id % 23 <> 0 and run_id % 7 = 0
    union all select run_id, 'run changed after it was recorded' from rn where run_id % 23 <> 0 and run_id % 7 <> 0 and run_id % 17 = 0
    union all select run_id, 'run has no log entry' from rn where run_id % 23 = 0 and run_id % 7 <> 0""", _RUNS)
def _(spark, sf):
    return A.verify_runs(tampered(spark, sf), digests(spark, sf).where(F.col("run_id") % 7 != 0))


@query("N5_baseline_runs", """select chain, seq, 'run_baselined' as event, run_id from (select dataset as chain, run_id, (select count(*) from rn o where o.dataset = r.dataset and o.run_id % 5 <> 0)
    + row_number() over (partition by dataset order by created_at) as seq from rn r where run_id % 5 = 0)""", _RUNS)
def _(spark, sf):
    kept = A.append_chain(entries(spark, sf).where(F.col("run_id") % 5 != 0))
    return A.baseline_runs(runs(spark, sf), digests(spark, sf), kept, "dataset", "created_at").select("chain", "seq", "event", "run_id")


@query("N6_newest_runs", "select run_id, question, dataset, status, created_at from rn order by created_at desc, run_id limit 20", _RUNS)
def _(spark, sf):
    return A.newest_runs(runs(spark, sf)).drop("report")


@query("N6_newest_entries", "select * from lg qualify row_number() over (partition by chain order by seq desc) <= 5", _CHAIN)
def _(spark, sf):
    return A.newest_entries(log(spark, sf), 5)


@query("N6_queries_of_run", "select run_id, query_id, row_count, error from qy where run_id = (select max(run_id) from rn)", _RUNS)
def _(spark, sf):
    rows = queries_of_runs(spark, sf)
    last = rows.agg(F.max("run_id").alias("m")).select("m").scalar()
    return A.queries_of(rows, last).select("run_id", "query_id", "row_count", "error")


@query("N6_feedback", "select conv_id as run_id, (turn % 4 - 1)::int as rating from conversations where turn % 4 - 1 between -1 and 1")
def _(spark, sf):
    return A.feedback_rows(table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), (F.col("turn") % 4 - 1).cast("int").alias("rating")))


@query("N7_cached_answer", """select question, run_id, created_at from (select *, row_number() over (partition by question order by created_at desc, run_id) as place from rn)
    where place <= 5 and status = 'ok' and created_at + 3000 > (select max(created_at) from rn) - 3000
    qualify row_number() over (partition by question order by created_at desc, run_id) = 1""", _RUNS)
def _(spark, sf):
    rows = runs(spark, sf).withColumns({"question_hash": F.col("question"), "expires_at": F.col("created_at") + 3000})
    now = rows.agg(F.max("created_at").alias("m")).select("m").scalar() - 3000
    return A.cached_answer(rows, now).select("question", "run_id", "created_at")


@query("N8_recent_runs", "select dataset, run_id, place from (select *, row_number() over (partition by dataset order by created_at desc, run_id)::int as place from rn) where place <= 3", _RUNS)
def _(spark, sf):
    return A.recent_runs(runs(spark, sf), 3).select("dataset", "run_id", "place")


@query("N9_result_match", """select event_type as question, bool_and(case event_type when 'view' then false when 'click' then day <> date '2024-01-03' else true end) as match from (
    select event_type, ts::date as day from events group by 1, 2) group by 1""")
def _(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    gold = S.result_rows(daily, F.col("event_type"), [F.col("day"), F.col("v")])
    # an answer slightly off everywhere, far off for 'view', and without one day for 'click'; dates written as timestamps
    off = F.when(F.col("event_type") == "view", 1.01).otherwise(1.0004)
    kept = daily.where(~((F.col("event_type") == "click") & (F.col("day") == F.lit("2024-01-03").cast("date"))))
    got = S.result_rows(kept, F.col("event_type"), [F.concat(F.col("day").cast("string"), F.lit(" 00:00:00")), F.col("v") * off])
    return S.result_match(gold, got)


@query("N9_result_match_more_columns", "select event_type as question, event_type <> 'view' as match from events group by 1")
def _(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    gold = S.result_rows(daily, F.col("event_type"), [F.col("day"), F.col("v")])
    # another order and one more column; 'view' lacks the value asked for
    value = F.when(F.col("event_type") == "view", F.col("v") + 7 * F.col("v")).otherwise(F.col("v"))
    return S.result_match(gold, S.result_rows(daily, F.col("event_type"), [F.col("n"), value, F.date_format("day", "yyyy-MM-dd")]))


_CAND = """cd as (select o_custkey % 50 as question, row_number() over (partition by o_custkey % 50 order by o_orderkey) as rank, o_orderpriority as dimension, o_orderstatus as segment from orders),
    ex as (select distinct o_custkey % 50 as question, '2-HIGH' as dimension, case when o_custkey % 50 = 7 then 'none' else 'f' end as segment from orders)"""


@query("N10_hit_rank", """select e.question, min(rank) as rank, coalesce(min(rank) <= 1, false) as hit_at_1, coalesce(min(rank) <= 3, false) as hit_at_3 from ex e
    left join cd c on c.question = e.question and c.dimension = e.dimension and lower(c.segment) = lower(e.segment) group by 1""", _CAND)
def _(spark, sf):
    from shiftscope.functions.ordered import positions

    question = (F.col("o_custkey") % 50).alias("question")
    orders = table(spark, sf, "orders").select(question, "o_orderkey", F.col("o_orderpriority").alias("dimension"), F.col("o_orderstatus").alias("segment"))
    ranked = positions(orders, ["question"], "o_orderkey", out="rank")
    expected = orders.select("question", F.lit("2-HIGH").alias("dimension"), F.when(F.col("question") == 7, "none").otherwise("f").alias("segment")).distinct()
    return S.hit_rank(ranked, expected)


_RES = """rs as (select l_orderkey * 8 + l_linenumber as id, case l_returnflag when 'A' then 'sql' when 'N' then 'cause' else 'refusal' end as category, l_quantity > 2 as correct, l_quantity > 8 as hit_at_1,
    l_quantity > 4 as hit_at_3, case when l_discount > 0.09 then 1 else 0 end as unsupported_numbers, round(l_extendedprice / 1000, 1) as duration_s, l_tax / 10 as cost_usd from lineitem),
    sm as (select round(avg(case when category = 'sql' then correct::int end) * 100, 1) as sql_accuracy_pct, round(avg(case when category = 'cause' then hit_at_1::int end) * 100, 1) as hit_at_1_pct,
      round(avg(case when category = 'cause' then hit_at_3::int end) * 100, 1) as hit_at_3_pct, round(avg(case when category = 'refusal' then correct::int end) * 100, 1) as refusal_pct,
      round(avg((unsupported_numbers > 0)::int) * 100, 1) as unsupported_pct, round(avg(duration_s), 2) as avg_latency_s, round(median(duration_s), 2) as median_latency_s,
      round(avg(cost_usd), 6) as avg_cost_usd, count(*) as questions from rs)"""


def results(spark, sf):
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(flag == "A", "sql").when(flag == "N", "cause").otherwise("refusal").alias("category"),
        (F.col("l_quantity") > 2).alias("correct"), (F.col("l_quantity") > 8).alias("hit_at_1"), (F.col("l_quantity") > 4).alias("hit_at_3"),
        F.when(F.col("l_discount") > 0.09, 1).otherwise(0).alias("unsupported_numbers"), F.round(F.col("l_extendedprice") / 1000, 1).alias("duration_s"), (F.col("l_tax") / 10).alias("cost_usd"))


@query("N11_benchmark_summary", "select * from sm", _RES)
def _(spark, sf):
    return S.benchmark_summary(results(spark, sf))


@query("N12_threshold_gate", """select measure, value, comparison, lim::double as "limit", pass, bool_and(pass) over () as accepted from (select *, case comparison when '>=' then value >= lim else value <= lim end as pass from (
    select 'sql_accuracy_pct' as measure, sql_accuracy_pct as value, '>=' as comparison, 95.0 as lim from sm union all select 'hit_at_1_pct', hit_at_1_pct, '>=', 85.0 from sm
    union all select 'refusal_pct', refusal_pct, '>=', 100.0 from sm union all select 'unsupported_pct', unsupported_pct, '<=', 2.0 from sm))""", _RES)
def _(spark, sf):
    return S.threshold_gate(S.benchmark_summary(results(spark, sf)))


@query("N13_merge_rerun", """select id, count(*) as n, min(source) as source from (select o_orderkey as id, 'rerun' as source from orders where o_custkey % 4 = 0
    union all select o_orderkey, 'previous' from orders where o_custkey % 4 <> 0) group by 1""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    previous = rows.select("id", F.lit("previous").alias("source"))
    rerun = rows.where(F.col("o_custkey") % 4 == 0).select("id", F.lit("rerun").alias("source"))
    return S.merge_rerun(previous, rerun).groupBy("id").agg(F.count("*").alias("n"), F.min("source").alias("source"))


@query("N14_latest_answer", """select question, r.run_id, query_id, sql_executed from (select * from rn where status = 'ok' qualify row_number() over (partition by question order by created_at desc, run_id desc) = 1) r
    left join (select * from qy where error is null qualify row_number() over (partition by run_id order by no desc) = 1) q on q.run_id = r.run_id""", _RUNS)
def _(spark, sf):
    return S.latest_answer(runs(spark, sf), queries_of_runs(spark, sf))
