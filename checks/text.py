"""L: text, retrieval, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.change import rounded
from checks.registry import query
from checks.standin import table
from shiftscope.operators import grounding as G, retrieval as R, search as SX, text as X
from shiftscope.session import cut_lineage, scratch_path, spread

_PARAS = """pa as (select doc_id, source, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)),
      lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') as ps, doc_id % 50 = 0 as undated from documents),
    cl as (select doc_id, source, undated, list_reduce(list_transform(ps, lambda p: [p]), lambda acc, x: case when length(acc[-1]) + length(x[1]) + 2 > 900
      then list_append(acc, x[1]) else list_append(acc[1:-2], acc[-1] || chr(10) || chr(10) || x[1]) end) as cs from pa where len(ps) > 0),
    ch as (select doc_id, source, (i - 1)::int as chunk_no, cs[i] as text, case when not undated then (date '2018-01-01' + (doc_id % 365)::int) end as doc_date
      from (select *, unnest(range(1, len(cs) + 1)) as i from cl))"""


def chunks(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(
        "doc_id", "source", F.when(F.col("doc_id") % 50 != 0, F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))).alias("doc_date"),
        F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return X.chunk_text(docs, "text")


@query("L1_chunk_text", "select doc_id, chunk_no, length(text)::int as chars, md5(text) as text_md5 from ch", _PARAS)
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_no", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query("L2_tokenize", f"select doc_id, len({_TOK})::int as n_tokens, md5(array_to_string({_TOK}, ' ')) as tokens_md5 from documents")
def _(spark, sf):
    found = X.tokens(F.col("text"))
    return spread(table(spark, sf, "documents")).select("doc_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens_md5"))


_EMB = """eb as (select doc_id, (('0x' || substr(md5(t), 31, 2))::int) as bucket, count(*)::double as weight from (
    select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from documents) group by 1, 2)"""


@query("L3_hash_embed", "select * from eb", _EMB)
def _(spark, sf):
    return X.hash_embed(spread(table(spark, sf, "documents")), ["doc_id"], "text")


def benchmark_queries(spark, sf):
    start = F.date_add(F.lit("2018-01-01").cast("date"), (F.col("item_id") % 4 * 90).cast("int"))
    rows = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 5 != 0, start).alias("start"),
        F.when(F.col("item_id") % 5 != 0, F.date_add(start, 30)).alias("end"))
    return R.with_margin(R.index_columns(rows), "start", "end")


_Q = """qs as (select item_id as query_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+') as toks,
      case when item_id % 5 <> 0 then date '2018-01-01' + (item_id % 4 * 90 - 20)::int end as a,
      case when item_id % 5 <> 0 then date '2018-01-01' + (item_id % 4 * 90 + 50)::int end as z from benchmark)"""


def _bm25_sql(source: str) -> str:
    """source(doc_id, chunk_no, doc_date, text) -> cand, bm(query_id, doc_id, chunk_no, score)."""
    return f"""{_Q}, src as (select doc_id, chunk_no, doc_date, {_TOK} as toks from {source}),
    cand as (select query_id, doc_id, chunk_no, len(s.toks) as dl from qs join src s on doc_date is null or a is null or doc_date between a and z),
    win as (select distinct a, z from qs),
    wd as (select w.a, w.z, s.doc_id, s.chunk_no, s.toks from win w join src s on doc_date is null or w.a is null or doc_date between w.a and w.z),
    ws as (select a, z, count(*) as n, avg(len(toks)) as avgdl from wd group by 1, 2),
    wt as (select a, z, term, count(*) as df from (select a, z, unnest(list_distinct(toks)) as term from wd) group by 1, 2, 3),
    wr as (select t.a, t.z, term, ln(n - df + 0.5) - ln(df + 0.5) as raw from wt t join ws s on s.a is not distinct from t.a and s.z is not distinct from t.z),
    wf as (select a, z, avg(raw) * 0.25 as fl from wr group by 1, 2),
    qt as (select query_id, a, z, term, count(*) as times from (select query_id, a, z, unnest(toks) as term from qs) group by 1, 2, 3, 4),
    qw as (select query_id, q.term, times, case when raw < 0 then fl else raw end as idf, avgdl from qt q
      join wr r on r.a is not distinct from q.a and r.z is not distinct from q.z and r.term = q.term
      join wf f on f.a is not distinct from q.a and f.z is not distinct from q.z join ws s on s.a is not distinct from q.a and s.z is not distinct from q.z),
    tf as (select doc_id, chunk_no, term, count(*) as tf from (select doc_id, chunk_no, unnest(toks) as term from src) group by 1, 2, 3),
    bm as (select c.query_id, c.doc_id, c.chunk_no, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from cand c
      join qw on qw.query_id = c.query_id join tf on tf.doc_id = c.doc_id and tf.chunk_no = c.chunk_no and tf.term = qw.term group by 1, 2, 3)"""


def whole_documents(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(
        "doc_id", F.lit(0).alias("chunk_no"), F.when(F.col("doc_id") % 50 != 0, F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))).alias("doc_date"), "text")
    return cut_lineage(R.index_columns(docs).drop("text", "codes", "buckets"))


_DOCS = "(select doc_id, 0 as chunk_no, case when doc_id % 50 <> 0 then date '2018-01-01' + (doc_id % 365)::int end as doc_date, text from documents)"


@query("L4_bm25_scores", "select query_id, doc_id, chunk_no, round(score, 6) as score from bm", _bm25_sql(_DOCS))
def _(spark, sf):
    return rounded(R.bm25_scores(whole_documents(spark, sf), benchmark_queries(spark, sf)), "score")


@query("L5_cosine_scores", """select e.vec_id, c.label, round(list_dot_product(e.embedding::double[], c.v) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[]) * list_dot_product(c.v, c.v)), 6) as score
    from embeddings e cross join (select label, list(m order by i) as v from (select label, i, avg(x) as m from (
      select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2) group by 1) c""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.col("c.m").alias("embedding"))
    return rounded(R.cosine_scores(rows.drop("label"), centres, "vec_id", "embedding", "label"), "score")


@query("L5_cosine_top", """select vec_id, query_id, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from (
    select r.vec_id, q.vec_id as query_id, list_dot_product(r.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(r.embedding::double[], r.embedding::double[]) * list_dot_product(q.embedding::double[], q.embedding::double[])) as score
    from embeddings r cross join embeddings q where r.label = 3)) where place <= 3""")
def _(spark, sf):
    # every vector asks, the vectors of one label answer
    rows = table(spark, sf, "embeddings")
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(R.cosine_scores(rows.where("label = 3").select("vec_id", "embedding"), asked, "vec_id", "embedding", "query_id", top=3), "score")


@query("L6_rrf_fuse", """select query_id, place::int as place, doc_id, chunk_no, round(fused, 6) as fused from (select *, row_number() over (partition by query_id order by fused desc, doc_id, chunk_no) as place from (
    select l_suppkey % 10 as query_id, l_orderkey * 8 + l_linenumber as doc_id, 0 as chunk_no, max(1.0 / (60 + l_partkey) + 1.0 / (60 + l_orderkey)) as fused from lineitem group by 1, 2)) where place <= 5""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("query_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("doc_id"),
                                               F.lit(0).alias("chunk_no"), F.col("l_partkey").alias("keyword_rank"), F.col("l_orderkey").alias("vector_rank"))
    rows = rows.groupBy("query_id", "doc_id", "chunk_no").agg(F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
    return rounded(R.rrf_fuse(rows, 5).select("query_id", "place", "doc_id", "chunk_no", "fused"), "fused")


@query("L7_date_window", """select doc_id, chunk_no, doc_date from ch where doc_date is null or doc_date between date '2018-06-01' - 20 and date '2018-07-01' + 20""", _PARAS)
def _(spark, sf):
    return R.date_window(chunks(spark, sf), "2018-06-01", "2018-07-01").select("doc_id", "chunk_no", "doc_date")


@query("L7_candidate_counts", """select query_id, count(*) as candidates from qs join ch on doc_date is null or a is null or doc_date between a and z group by 1""", f"{_PARAS}, {_Q}")
def _(spark, sf):
    return R.candidate_counts(R.index_columns(chunks(spark, sf)), benchmark_queries(spark, sf))


_HYBRID = f"""{_PARAS}, {_bm25_sql('ch')}, bag as (select doc_id, chunk_no, ('0x' || substr(md5(t), 31, 2))::int as bucket, count(*)::double as w from (
      select doc_id, chunk_no, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from ch) group by 1, 2, 3),
    bn as (select doc_id, chunk_no, sqrt(sum(w * w)) as norm from bag group by 1, 2),
    qb as (select query_id, ('0x' || substr(md5(t), 31, 2))::int as bucket, count(*)::double as w from (
      select query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from qs) group by 1, 2),
    qn as (select query_id, sqrt(sum(w * w)) as norm from qb group by 1),
    vs as (select query_id, doc_id, chunk_no, sum(b.w * q.w) as dot from qb q join bag b using (bucket) group by 1, 2, 3),
    sc as (select c.query_id, c.doc_id, c.chunk_no, round(coalesce(b.score, 0), 9) as kw, round(coalesce(v.dot / (n.norm * q.norm), 0), 9) as ve from cand c
      left join bm b using (query_id, doc_id, chunk_no) left join vs v using (query_id, doc_id, chunk_no) left join bn n using (doc_id, chunk_no) left join qn q using (query_id)),
    fu as (select *, 1.0 / (60 + row_number() over (partition by query_id order by kw desc, doc_id, chunk_no)) + 1.0 / (60 + row_number() over (partition by query_id order by ve desc, doc_id, chunk_no)) as fused from sc)"""


@query("L8_hybrid_search", """select query_id, place::int as place, doc_id, chunk_no, round(fused, 4) as score from (
    select *, row_number() over (partition by query_id order by fused desc, doc_id, chunk_no) as place from fu) where place <= 3""", _HYBRID)
def _(spark, sf):
    return SX.hybrid_search(R.index_columns(chunks(spark, sf)).drop("text", "source"), benchmark_queries(spark, sf), k=3)


@query("L8_stored_index_search", """select query_id, place::int as place, f.doc_id, f.chunk_no, round(fused, 4) as score, c.doc_date, c.source as title, md5(c.text) as text_md5 from (
    select *, row_number() over (partition by query_id order by fused desc, doc_id, chunk_no) as place from fu) f join ch c using (doc_id, chunk_no) where place <= 5""", _HYBRID)
def _(spark, sf):
    # an index of many small shards, opened again; hits bring title and text along
    path = scratch_path(spark, "index")
    SX.write_index(R.index_columns(chunks(spark, sf)).withColumnRenamed("source", "title"), path, shard=512)
    found = SX.search(SX.ChunkIndex(spark, path), benchmark_queries(spark, sf), k=5, block=16)
    return found.withColumn("text_md5", F.md5("text")).drop("text")


@query("L10_unsupported_numbers", """with w as (select event_type as answer_id, day, v as x, length(split_part(raw, '.', 2)) as d, raw from (
      select event_type, ts::date as day, count(*) || '.' || (sum(event_id) % 7) as raw, (count(*) || '.' || (sum(event_id) % 7))::double as v from events group by 1, 2)),
    e as (select distinct event_type as answer_id, round(value, 1) as v from events)
    select answer_id, raw from w where x > 10.05 and not exists (select 1 from e where e.answer_id = w.answer_id and (abs(x - v) <= 0.05 + 1e-9 or abs(x - v * 100) <= 0.05 + 1e-9))""")
def _(spark, sf):
    rows = table(spark, sf, "events")
    # one answer text per event type and day: "<count>.<digit>"; evidence: every value of that type, one decimal
    text = F.concat(F.count("*").cast("string"), F.lit("."), (F.sum("event_id") % 7).cast("string"))
    answers = rows.groupBy(F.col("event_type").alias("answer_id"), F.to_date("ts").alias("day")).agg(text.alias("text"))
    evidence = rows.select(F.col("event_type").alias("answer_id"), F.round("value", 1).cast("string").alias("text"))
    return G.unsupported_numbers(answers, evidence, "answer_id", "text").select("answer_id", "raw")


@query("L11_extract_json", """select event_id, (json_extract(props, '$.k'))::int as k from events""")
def _(spark, sf):
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(X.extract_json(reply), "$.k", "int").alias("k"))


@query("L11_extract_json_conversations", """select role, count(*) as turns, count(*) filter (where json_valid(nullif(regexp_extract(text, '(?s)\\{.*\\}'), ''))) as with_json
    from conversations group by 1""")
def _(spark, sf):
    found = X.extract_json(F.col("text"))
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count(found).alias("with_json"))


@query("L12_mask_email", """select doc_id, md5(regexp_replace(text, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', '\\1***@\\2', 'g')) as masked_md5 from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.regexp_replace("text", X.EMAIL, "$1***@$2")).alias("masked_md5"))


@query("L12_mask_pii")
def _(spark, sf):
    masked = X.mask_pii(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", (masked != F.col("text")).alias("changed"), F.md5(masked).alias("masked_md5"))


@query("L13_normalize_label", "select p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '', 'g') as label from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.normalize_label(F.concat_ws("-", "p_name", "p_brand")).alias("label"))


@query("L13_normalize_cell", """select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m') || '-01' when 1 then strftime(o_orderdate, '%Y-%m-%d')
    when 2 then o_custkey || '.0' else o_orderpriority end as cell  from orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 4
    raw = (F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM")).when(kind == 1, F.col("o_orderdate").cast("string"))
           .when(kind == 2, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).otherwise(F.col("o_orderpriority")))
    return rows.select("o_orderkey", X.normalize_cell(raw).alias("cell"))


@query("L14_question_hash", """select conv_id, turn, substr(sha256(role || '|' || regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\?+$', ''), '\\s+', ' ', 'g')), 1, 24) as hash
    from conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.question_hash(F.col("text"), F.col("role")).alias("hash"))
