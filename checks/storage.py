"""A and L9: reading, writing, copying, auditing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.audit import _RUNS, runs
from checks.product import FIRST, LAST, _COUNTS, _GROWTH
from checks.registry import query
from checks.standin import shop, table
from checks.text import _PARAS
from shiftscope.operators import product as P
from shiftscope.session import cut_lineage, scratch_path, spread
from shiftscope.sources import archive, corpus, tables as T

_SH = {"customers": "sh_customers", "orders": "sh_orders", "order_items": "sh_items", "order_payments": "sh_payments", "order_reviews": "sh_reviews",
       "products": "sh_products", "sellers": "sh_sellers", "category_translation": "sh_translation", "geolocation": "sh_geo"}
_COUNTS_SQL = " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {v}" for n, v in _SH.items())


def _csv_shop(spark, sf):
    """The shop written as CSV with all declared columns, then read back with the declared types."""
    folder, files = scratch_path(spark, "csv"), {}
    for name, df in shop(spark, sf).items():
        declared = [c.split()[0] for c in T.SCHEMAS[name].split(", ")]
        cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in declared]
        files[name] = f"{folder}/{name}"
        df.select(*cols).write.option("header", True).csv(files[name])
    return T.read_csv_tables(spark, files)


@query("A1_load_tables", _COUNTS_SQL)
def _(spark, sf):
    loaded, folder = _csv_shop(spark, sf), scratch_path(spark, "tables")
    T.save_tables(loaded, folder)
    return T.row_counts(dict(T.open_tables(spark, folder).items()))


@query("A1_typed_columns", """select order_id::varchar as order_id, order_purchase_timestamp, order_delivered_customer_date, round(paid, 2) as paid from sh_orders
    left join (select order_id, sum(payment_value) as paid from sh_payments group by 1) using (order_id)""")
def _(spark, sf):
    s = _csv_shop(spark, sf)
    paid = s.order_payments.groupBy("order_id").agg(F.round(F.sum("payment_value"), 2).alias("paid"))
    return s.orders.join(paid, "order_id", "left").select("order_id", "order_purchase_timestamp", "order_delivered_customer_date", "paid")


@query("A2_read_table", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, sf):
    return T.read_table(spark, f"{sf}/nation.parquet")


_KEYED = [("customers", "customer_id", "customer_id"), ("orders", "order_id", "order_id"), ("order_items", "order_id,order_item_id", "(order_id, order_item_id)"),
          ("order_payments", "order_id,payment_sequential", "(order_id, payment_sequential)"), ("order_reviews", "review_id,order_id", "(review_id, order_id)"),
          ("products", "product_id", "product_id"), ("sellers", "seller_id", "seller_id"), ("category_translation", "product_category_name", "product_category_name")]


@query("A3_key_audit", " union all ".join(
    f"""select '{n}' as table_name, '{c}' as key_columns, count(*) as row_count, count(distinct {k}) as distinct_keys,
    count(*) filter (where {' or '.join(x + ' is null' for x in c.split(','))}) as null_keys,
    (select count(*) from (select {c} from {_SH[n]} group by {c} having count(*) > 1)) as repeated_keys from {_SH[n]}""" for n, c, k in _KEYED))
def _(spark, sf):
    return T.key_audit(dict(shop(spark, sf).items()), T.KEYS)


@query("A4_read_sensor_text", "select user_id::int as unit, event_id::int as cycle, value as op1, (json_extract(props, '$.k'))::double as op2 from events")
def _(spark, sf):
    path = scratch_path(spark, "sensor")
    cells = [F.col("user_id"), F.col("event_id"), F.col("value"), F.get_json_object("props", "$.k")]
    line = F.concat(F.lit(" "), F.concat_ws("   ", *[c.cast("string") for c in cells]), F.lit("  "))
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return archive.read_sensor_text(spark, path, ["unit", "cycle", "op1", "op2"])


@query("A5_parse_documents", """select 'doc_' || doc_id as doc_id, case when doc_id % 3 = 0 then 'doc ' || doc_id else 'About ' || doc_id end as title, case when doc_id % 3 = 0 then 'document' else source end as doc_type,
    case when doc_id % 3 <> 0 then date '2018-01-01' + (doc_id % 365)::int end as doc_date, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as body_md5 from documents""")
def _(spark, sf):
    i = F.col("doc_id")
    day = F.date_add(F.lit("2018-01-01").cast("date"), (i % 365).cast("int")).cast("string")
    header = F.concat(F.lit('---\ntitle: "About '), i, F.lit('"\ntype: '), F.col("source"), F.lit("\ndate: "), day, F.lit("\n---\n"))
    raw = F.concat(F.when(i % 3 != 0, header).otherwise(F.lit("")), F.col("text"), F.lit("\n"))
    files = table(spark, sf, "documents").select(F.concat(F.lit("/corpus/doc_"), i, F.lit(".md")).alias("path"), raw.alias("raw"))
    return corpus.parse_documents(files).select("doc_id", "title", "doc_type", "doc_date", F.md5("text").alias("body_md5"))


@query("A5_read_corpus", """select 'Item ' || item_id as title, 'passage' as doc_type, date '2018-01-01' + (item_id % 365)::int as doc_date, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as body_md5
    from benchmark""")
def _(spark, sf):
    # one file for each passage, read back as a folder of documents
    folder, i = scratch_path(spark, "corpus"), F.col("item_id")
    day = F.date_add(F.lit("2018-01-01").cast("date"), (i % 365).cast("int")).cast("string")
    raw = F.concat(F.lit("---\ntitle: Item "), i, F.lit("\ntype: passage\ndate: "), day, F.lit("\n---\n\n"), F.col("text"))
    table(spark, sf, "benchmark").select(raw.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return corpus.read_corpus(spark, folder, "*.txt").select("title", "doc_type", "doc_date", F.md5("text").alias("body_md5"))


@query("A7_snapshot_schema", _COUNTS_SQL)
def _(spark, sf):
    return T.row_counts(T.copy_tables(dict(shop(spark, sf).items()), scratch_path(spark, "lab")))


@query("A8_export_results", """select 'cohort' as sheet, count(*) as row_count from cc union all select 'growth', count(*) from growth""",
       _COUNTS + ", " + _GROWTH[_GROWTH.index("fl as"):])
def _(spark, sf):
    active = P.active_months(shop(spark, sf))
    sheets = {"cohort": P.cohort_counts(active, FIRST, LAST), "growth": P.growth_accounting(active, FIRST, LAST)}
    out = None
    for fmt in ("csv", "json"):
        paths = archive.export_results({n: d for n, d in sheets.items() if (fmt == "csv") == (n == "cohort")}, scratch_path(spark, fmt), fmt)
        for name, path in paths.items():
            back = spark.read.option("header", True).schema(sheets[name].schema).format(fmt).load(path)
            part = back.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("sheet"), "row_count")
            out = part if out is None else out.unionByName(part)
    return out


def _documents(spark, sf):
    i = F.col("doc_id")
    return spread(table(spark, sf, "documents")).select(
        i, F.col("source").alias("title"), F.lit("note").alias("doc_type"), F.when(i % 50 != 0, F.date_add(F.lit("2018-01-01").cast("date"), (i % 365).cast("int"))).alias("doc_date"),
        F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


@query("A9_export_chunks", "select 'notes' as dataset, doc_id, chunk_no, doc_date, md5(text) as text_md5 from ch", _PARAS)
def _(spark, sf):
    path = scratch_path(spark, "export")
    corpus.export_chunks(corpus.make_chunks(corpus.by_document(_documents(spark, sf)), "notes"), path, placed=True)
    return spark.read.parquet(path).select("dataset", "doc_id", "chunk_no", "doc_date", F.md5("text").alias("text_md5"))


@query("L9_ingest_chunks", "select 'a' as dataset, count(*) as chunks, count(distinct doc_id) as docs from ch where doc_id % 2 = 0 union all select 'b', count(*), count(distinct doc_id) from ch where doc_id % 3 = 0", _PARAS)
def _(spark, sf):
    store, docs = scratch_path(spark, "store"), _documents(spark, sf)
    made = cut_lineage(corpus.make_chunks(docs, "a"))  # three loads of chunks that are made once
    corpus.ingest_chunks(made, store)
    corpus.ingest_chunks(made.where("doc_id % 3 = 0").withColumn("dataset", F.lit("b")), store)
    corpus.ingest_chunks(made.where("doc_id % 2 = 0"), store)  # replaces the first load of 'a'
    return corpus.open_chunks(spark, store).groupBy(F.col("dataset").cast("string").alias("dataset")).agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"))


@query("A10_archive_runs", "select run_id, question, dataset, status from rn where run_id = (select max(run_id) from rn)", _RUNS)
def _(spark, sf):
    folder, rows = scratch_path(spark, "archive"), runs(spark, sf)
    archive.archive_runs(rows, folder)
    last = rows.orderBy(F.col("run_id").desc()).first()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return archive.read_archived_run(spark, folder, f"{schema}, bucket bigint", last["dataset"], last["run_id"]).select("run_id", "question", "dataset", "status")


_PROFILED = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


@query("A12_profile_tables", " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, '{k}' as column_type, count(*) filter (where {c} is null) as null_count, min({c})::varchar as min_value, max({c})::varchar as max_value from {t}"
                                              for t, cols in _PROFILED.items() for c, k in cols.items()))
def _(spark, sf):
    return T.profile_columns({t: table(spark, sf, t) for t in _PROFILED})


@query("A12_date_range", "select min(order_purchase_timestamp) as first_at, max(order_purchase_timestamp) as last_at, count(*) as n from sh_orders")
def _(spark, sf):
    at = "order_purchase_timestamp"
    return shop(spark, sf).orders.agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
