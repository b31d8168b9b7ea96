"""J11-J26: supervised jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import _r, rounded
from checks.registry import query
from checks.standin import shop, table
from shiftscope.functions.ordered import positions
from shiftscope.operators import learn as L
from shiftscope.session import cut_lineage, scratch_path, spread

_FEAT = """lf as (select distinct purchased_at, late, promised_days, customer_state, seller_state, same_state, order_value, freight, n_items, n_sellers,
    max_weight_g, category from (select o.order_id, o.order_purchase_timestamp as purchased_at,
      (o.order_delivered_customer_date > o.order_estimated_delivery_date)::int as late,
      (epoch_us(o.order_estimated_delivery_date) - epoch_us(o.order_purchase_timestamp)) / 86400000000.0 as promised_days,
      c.customer_state, s.seller_state, (c.customer_state = s.seller_state)::int as same_state, sum(i.price) as order_value, sum(i.freight_value) as freight,
      count(*) as n_items, count(distinct i.seller_id) as n_sellers, max(p.product_weight_g) as max_weight_g,
      max(coalesce(p.product_category_name, 'unknown')) as category
    from sh_orders o join sh_customers c on c.customer_id = o.customer_id join sh_items i on i.order_id = o.order_id
    join sh_sellers s on s.seller_id = i.seller_id join sh_products p on p.product_id = i.product_id
    where o.order_status = 'delivered' and o.order_delivered_customer_date is not null group by o.order_id, 2, 3, 4, 5, 6, 7))"""


@query("J11_late_features", f"""select purchased_at, late, promised_days, customer_state, seller_state, same_state, {_r('order_value', 'freight', digits=4)}, n_items, n_sellers,
    coalesce(max_weight_g, (select median(max_weight_g) from lf))::double as max_weight_g, category, month(purchased_at)::int as month,
    (isodow(purchased_at) - 1)::int as weekday, round(freight / nullif(order_value, 0), 6) as freight_ratio from lf""", _FEAT)
def _(spark, sf):
    rows = L.fill_median(L.late_features(shop(spark, sf)), "max_weight_g")
    return rounded(rounded(rows, "order_value", "freight", digits=4), "freight_ratio")


@query("J12_time_split", """select case when purchased_at < cut then 'train' else 'test' end as split, count(*) as n, min(purchased_at) as first_at,
    max(purchased_at) as last_at from lf, (select make_timestamp(quantile_cont(epoch_us(purchased_at), 0.8)::bigint) as cut from lf) group by 1""", _FEAT)
def _(spark, sf):
    rows = L.time_split(L.late_features(shop(spark, sf)), "purchased_at")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("purchased_at").alias("first_at"), F.max("purchased_at").alias("last_at"))


def _late_sets(spark, sf):
    """Written once: training reads it many times, and a lost executor must not redo the joins."""
    rows = L.time_split(L.fill_median(L.late_features(shop(spark, sf)), "max_weight_g"), "purchased_at")
    rows = rows.withColumn("row_key", F.xxhash64(*rows.columns))
    train = rows.where("split = 'train'")
    rows = L.merge_rare(rows, train, L.CATEGORICAL)
    path = scratch_path(spark, "late")
    rows.write.parquet(path)
    saved = spark.read.schema(rows.schema).parquet(path)
    # the rows take few MB, so the scan alone would leave most cores idle in each of the many passes
    return spread(saved.where("split = 'train'")), saved.where("split = 'test'")


@query("J13_late_logistic")
def _(spark, sf):
    train, test = _late_sets(spark, sf)
    return L.binary_metrics(L.scored(L.late_logistic(train), test, "late", "row_key"), "row_key").withColumn("model", F.lit("logistic_regression"))


@query("J14_late_boosted")
def _(spark, sf):
    train, test = _late_sets(spark, sf)
    return L.binary_metrics(L.scored(L.late_boosted(train), test, "late", "row_key"), "row_key").withColumn("model", F.lit("gradient_boosting"))


_SCORE = """sc as (select l_orderkey * 8 + l_linenumber as rid, round(l_quantity / 7 + l_discount, 1) as score, (l_returnflag = 'R')::int as label from lineitem),
    ps as (select score, count(*) as n, sum(label) as pos from sc group by 1),
    cu as (select *, sum(n) over (order by score desc) as cum_n, sum(pos) over (order by score desc) as cum_pos from ps)"""


@query("J15_binary_metrics", """select sum(n)::bigint as rows, sum(pos)::bigint as positives,
    round(sum((n - pos) * (cum_pos - pos + pos / 2.0)) / (sum(pos) * (sum(n) - sum(pos)))::double, 6) as roc_auc,
    round(sum(pos * (cum_pos / cum_n::double)) / sum(pos)::double, 6) as average_precision,
    (select round(avg(label), 6) from (select label from sc order by score desc, rid, label limit (select floor(count(*) * 0.1)::bigint from lineitem))) as top_positive_rate
    from cu""", _SCORE)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2 + (F.col("l_returnflag") == "R").cast("int")).alias("rid"),
        F.round(F.col("l_quantity") / 7 + F.col("l_discount"), 1).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(L.binary_metrics(rows, "rid"), "roc_auc", "average_precision", "top_positive_rate")


_TEXT = """ts as (select doc_id, trim(coalesce(source, '') || ' ' || text) as text, ((1 + quality * 4) <= 2)::int as negative from documents join labels using (doc_id)
    where text is not null and length(trim(text)) >= 3)"""


def _texts(spark, sf):
    docs = spread(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").withColumn("score", F.col("quality") * 4 + 1)
    return L.review_text_set(docs, "source", "text", "score", "doc_id")


@query("J16_review_text_set", "select doc_id, md5(text) as text_md5, length(text)::int as text_length, negative from ts", _TEXT)
def _(spark, sf):
    return _texts(spark, sf).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_length"), "negative")


_FOLD = f"regexp_replace(translate(lower(text), '{L.ACCENTED}', '{L.PLAIN}'), '\\p{{Mn}}+', '', 'g')"
_WORDS = f"""dw as (select doc_id, regexp_extract_all({_FOLD}, '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from documents),
    tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from dw union all
      select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from dw) group by 1, 2),
    idf as (select term, count(*) as df, ln((1 + (select count(*) from documents)) / (1 + count(*))::double) + 1 as idf from tf group by 1 having count(*) >= 3)"""


@query("J17_word_idf", "select term, df, round(idf, 6) as idf from idf", _WORDS)
def _(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    n = docs.agg(F.count("*").alias("n")).select("n").scalar()
    return rounded(L.term_idf(docs, "doc_id", "text", "w", n, L.WORD_MIN_DF), "idf")


@query("J17_word_tfidf", """select doc_id, count(*) as terms, round(max(raw / norm), 6) as heaviest, round(sum(raw / norm), 4) as total from (
    select *, sqrt(sum(raw * raw) over (partition by doc_id)) as norm from (select doc_id, term, (1 + ln(tf)) * idf as raw from tf join idf using (term)))
    group by 1""", _WORDS)
def _(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    out = L.text_weights(docs, "doc_id", "text", ["w"], named=False).select(
        "doc_id", F.size("weights").cast("bigint").alias("terms"), F.array_max("weights").alias("heaviest"), F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("total"))
    return rounded(rounded(out, "heaviest"), "total", digits=4)


@query("J17_char_idf", f"""select term, count(*) as df from (select distinct doc_id, substr(w, i::int, n::int) as term from (
    select doc_id, w, n, unnest(range(1, length(w) - n + 2)) as i from (select doc_id, w, unnest(range(3, least(5, length(w)) + 1)) as n from (
      select distinct doc_id, ' ' || unnest(regexp_split_to_array(trim({_FOLD}), '\\s+')) || ' ' as w from documents) where length(w) > 2)))
    group by 1 having count(*) >= 5""")
def _(spark, sf):
    return L.term_idf(spread(table(spark, sf, "documents")), "doc_id", "text", "c", 1, L.CHAR_MIN_DF).drop("idf")


@query("J17_char_tfidf", f"""select doc_id, count(*) as terms, round(max(raw / norm), 6) as heaviest, round(sum(raw / norm), 4) as total from (
    select *, sqrt(sum(raw * raw) over (partition by doc_id)) as norm from (select doc_id, term, (1 + ln(tf)) * idf as raw from ct join ci using (term))) group by 1""",
    f"""cw as (select doc_id, w, count(*) as c from (select doc_id, ' ' || unnest(regexp_split_to_array(trim({_FOLD}), '\\s+')) || ' ' as w from documents) where length(w) > 2 group by 1, 2),
    ct as (select doc_id, term, sum(c)::bigint as tf from (select doc_id, c, substr(w, i::int, n::int) as term from (select doc_id, c, w, n, unnest(range(1, length(w) - n + 2)) as i
      from (select doc_id, c, w, unnest(range(3, least(5, length(w)) + 1)) as n from cw))) group by 1, 2),
    ci as (select term, ln((1 + (select count(*) from documents)) / (1 + count(*))::double) + 1 as idf from ct group by 1 having count(*) >= 5)""")
def _(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    out = L.text_weights(docs, "doc_id", "text", ["c"], named=False).select(
        "doc_id", F.size("weights").cast("bigint").alias("terms"), F.array_max("weights").alias("heaviest"), F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("total"))
    return rounded(rounded(out, "heaviest"), "total", digits=4)


@query("J18_sentiment_logistic")
def _(spark, sf):
    texts = L.stratified_split(_texts(spark, sf), "doc_id", "negative")
    weights = L.text_weights(texts, "doc_id", "text", fit=F.col("split") == "train", keep=["negative", "split"])
    saved = L.hashed_vectors(weights, "doc_id")
    model = L.sentiment_logistic(saved.where("split = 'train'"))
    return L.classification_report(model.transform(saved.where("split = 'test'")), "negative", "prediction")


@query("J19_classification_report", """select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from (
    with per as (select c, sum(support)::bigint as support, sum(named)::bigint as named, sum(hit)::bigint as hit from (
      select quality as c, 1 as support, 0 as named, (quality = toxic)::int as hit from labels union all select toxic, 0, 1, 0 from labels) group by 1),
    cl as (select c::varchar as class, coalesce(hit / nullif(named, 0)::double, 0) as precision, coalesce(hit / nullif(support, 0)::double, 0) as recall,
      coalesce(2 * hit / nullif(named + support, 0)::double, 0) as f1, support, hit from per)
    select class, precision, recall, f1, support from cl
    union all select 'accuracy', sum(hit) / sum(support)::double, sum(hit) / sum(support)::double, sum(hit) / sum(support)::double, sum(support)::bigint from cl
    union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::bigint from cl
    union all select 'weighted avg', sum(precision * support) / sum(support)::double, sum(recall * support) / sum(support)::double, sum(f1 * support) / sum(support)::double, sum(support)::bigint from cl)""")
def _(spark, sf):
    return rounded(L.classification_report(table(spark, sf, "labels"), "quality", "toxic"), "precision", "recall", "f1")


@query("J19_first_errors", "select doc_id, quality, toxic from labels where quality <> toxic order by doc_id limit 5")
def _(spark, sf):
    return L.first_errors(table(spark, sf, "labels"), "quality", "toxic", "doc_id")


_RUL = """rf as (select user_id as unit, row_number() over (partition by user_id order by ts, event_id) as cycle, value as s1, hour(ts)::double as s2,
    (json_extract(props, '$.k'))::double as s3, 1.0::double as s4 from events)"""
SENSORS = ["s1", "s2", "s3", "s4"]


def readings(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("unit"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("s1"),
        F.hour("ts").cast("double").alias("s2"), F.get_json_object("props", "$.k").cast("double").alias("s3"), F.lit(1.0).alias("s4"))
    return positions(rows, ["unit"], "at", ["event_id"], out="cycle").drop("at", "event_id")


@query("J20_informative_sensors", " union all ".join(
    f"select '{s}' as sensor, round(stddev_samp({s}), 6) as std, stddev_samp({s}) > 1e-4 as keep from rf" for s in SENSORS), _RUL)
def _(spark, sf):
    return rounded(L.informative_sensors(readings(spark, sf), SENSORS), "std")


_USED = ["s1", "s2", "s3"]
_WIN = _RUL + f""", df as (select *, {', '.join(f's - lag(s) over w as d_s'.replace('s - lag(s)', f'{s} - lag({s})').replace('d_s', f'd_{s}') for s in _USED)} from rf
    window w as (partition by unit order by cycle)), wf as (select unit, cycle, {', '.join(
    f'{s}, avg({s}) over w as {s}_mean, coalesce(case when count(d_{s}) over w >= 2 then avg(d_{s}) over w end, 0) as {s}_slope' for s in _USED)}
    from df window w as (partition by unit order by cycle rows between 29 preceding and current row))"""
_FCOLS = [c for s in _USED for c in (s, f"{s}_mean", f"{s}_slope")]


@query("J21_window_features", f"select unit, cycle, {_r(*_FCOLS, digits=8)} from wf", _WIN)
def _(spark, sf):
    return rounded(L.window_features(readings(spark, sf), _USED), *_FCOLS, digits=8)


@query("J21_window_features_blocks", f"select unit, cycle, {_r(*_FCOLS, digits=8)} from wf", _WIN)
def _(spark, sf):
    # the overlapping cut for very long units, forced at this size
    return rounded(L.window_features(cut_lineage(readings(spark, sf)), _USED, block=64), *_FCOLS, digits=8)


@query("J22_rul_target", "select unit, cycle, least(max(cycle) over (partition by unit) - cycle, 125) as rul from rf", _RUL)
def _(spark, sf):
    return L.rul_target(readings(spark, sf)).select("unit", "cycle", "rul")


@query("J23_last_cycle", "select unit, cycle, s1, s2, s3 from rf qualify row_number() over (partition by unit order by cycle desc) = 1", _RUL)
def _(spark, sf):
    return L.last_cycle(readings(spark, sf).drop("s4"))


@query("J24_rul_models")
def _(spark, sf):
    rows = cut_lineage(readings(spark, sf))  # put in order once
    features = L.rul_target(L.window_features(rows, _USED), of=rows)
    path = scratch_path(spark, "rul")
    features.write.parquet(path)
    saved = spark.read.parquet(path)
    half = F.pmod(F.xxhash64("unit"), F.lit(2))
    return L.rul_models(saved.where(half == 0), L.last_cycle(saved.where(half == 1)), _FCOLS)


@query("J25_rul_scores", """select unit % 5 as fleet, round(sqrt(avg(d * d)), 6) as rmse,
    round(sum(case when d < 0 then exp(-d / 13) - 1 else exp(d / 10) - 1 end), 4) as nasa_score from (
    select unit, (s3 - least(max(cycle) over (partition by unit) - cycle, 125))::double as d from rf) group by 1""", _RUL)
def _(spark, sf):
    rows = L.rul_target(readings(spark, sf)).withColumn("fleet", F.col("unit") % 5)
    return rounded(rounded(L.rul_scores(rows, ["fleet"], "rul", "s3"), "rmse"), "nasa_score", digits=4)


@query("J26_experiment_log", " union all ".join(
    f"select 'labels' as experiment, '{run}' as run, 'param' as kind, 'rows' as key, count(*)::varchar as value from labels union all select 'labels', '{run}', 'metric', 'toxic_share', round(avg(toxic), 6)::varchar from labels where quality = {q}"
    for run, q in (("first", 0), ("second", 1))))
def _(spark, sf):
    folder = scratch_path(spark, "runs")
    labels = table(spark, sf, "labels")
    n = labels.count()
    for run, quality in (("first", 0), ("second", 1)):
        share = labels.where(F.col("quality") == quality).agg(F.round(F.avg("toxic"), 6)).first()[0]
        L.log_run(spark, folder, "labels", run, {"rows": n}, {"toxic_share": share})
    return L.read_log(spark, folder).drop("logged_at")
