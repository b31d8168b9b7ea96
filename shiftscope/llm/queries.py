"""The queries of this folder: one for each operator, and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from shiftscope.llm.common import small_batches, table
from shiftscope.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    from shiftscope.llm.packing import pack_documents

    small_batches(spark)
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op10_token_files")
def op10(spark, sf_dir):
    from shiftscope.llm.tokenfiles import read_documents, write_token_files

    small_batches(spark)
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    from shiftscope.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op7_substring_dedup",
    """with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    g as (select doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w)),
    m as (select h, min(doc_id) as d from g group by h),
    r as (select g.doc_id, i from g join m using (h) where g.doc_id > m.d),
    gone as (select distinct doc_id, unnest(range(i, i + 50)) as k from r),
    one as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as k from w),
    k as (select one.doc_id, count(*) as n, string_agg(x, ' ' order by k) as t from one anti join gone using (doc_id, k) group by one.doc_id)
    select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join k using (doc_id)""",
)
def op7(spark, sf_dir):
    from shiftscope.llm.substrings import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"), layout=False)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_weak_supervision")
def op8(spark, sf_dir):
    from shiftscope.llm.quality import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


#: Only these queries use this key; a corpus takes a secret one.
KEY = "public test key"


@query("op9_feistel_pseudonyms")
def op9(spark, sf_dir):
    from shiftscope.llm.pii import pseudonymised

    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY).select("doc_id", "text", F.coalesce(F.aggregate(F.map_values("pii"), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("n_replaced"))


@query(
    "op6_threshold_topk",
    """with v as (select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
      where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
    s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
)
def op6(spark, sf_dir):
    from shiftscope.llm.topk import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


#: verdict, host, path
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op2_association_rules")
def op2(spark, sf_dir):
    from shiftscope.llm.urlrules import judged_urls

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judged_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


@query("op3_flow_resharding")
def op3(spark, sf_dir):
    from shiftscope.llm.resharding import reshard, rewrite

    kept = rewrite(reshard(table(spark, sf_dir, "documents"), new=8, old=5), scratch_path(spark, "shards"))
    return kept.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op5_trie_bpe")
def op5(spark, sf_dir):
    from shiftscope.llm.bpetrie import encoded

    both = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@query(
    "op11_metric_tree_codes",
    """with v as materialized (select vec_id, label, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
      where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
    y as materialized (select vec_id, p, x[len(x) // 16 * p + 1:len(x) // 16 * (p + 1)] as y from v, range(16) r(p)),
    c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as c, y as e from y qualify c < 64),
    """ + ",\n    ".join(
        f"""a{i} as materialized (select vec_id, p, min({{d: list_sum(list_transform(list_zip(y, e), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint, c: c}}) as m from y join c{i} using (p) group by vec_id, p)"""
        + (f""",
    s{i} as (select p, c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as e from (select p, m.c as c, i, sum(y[i])::bigint as s, count(*) as n from y join a{i} using (vec_id, p), range(1, 5) r(i) group by p, m.c, i) group by p, c),
    c{i + 1} as materialized (select p, c, coalesce(s{i}.e, c{i}.e) as e from c{i} left join s{i} using (p, c))""" if i < 2 else "")
        for i in range(3)) + """,
    k as (select sha256(string_agg(array_to_string(e, ','), ',' order by p, c)) as h from c2),
    o as (select vec_id, any_value(label) as label, string_agg(format('{:02x}', m.c), '' order by p) as code, sum(m.d)::bigint as error from a2 join v using (vec_id) group by vec_id)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from o, k""",
)
def op11(spark, sf_dir):
    from shiftscope.llm.vectorcodes import compressed, digest

    rows, codebooks = compressed(table(spark, sf_dir, "embeddings"), label_col="label")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


@query(
    "op12_filter_interactions",
    """with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    f as (select part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
      + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as m,
      doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good, doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as bad from d),
    n as (select part, m, count(*) as n, count_if(good) as g, count_if(bad) as b from f group by part, m),
    l as (select chr(65 + i) as c, i from (values (0), (1), (2), (3), (4)) v(i)),
    o as (select a.c || b.c || c.c || d.c || e.c as o from l a, l b, l c, l d, l e where list_unique([a.c, b.c, c.c, d.c, e.c]) = 5),
    s as (select o, k::int as step, (1 << (ascii(o[k]) - 65))::int as bit, coalesce(list_sum(list_transform(range(1, k), lambda j: (1 << (ascii(o[j]) - 65)))), 0)::int as before from o, range(1, 6) r(k)),
    r as (select part, o as filter_order, step, bit, sum(if(m & (before | bit) = 0, n, 0))::bigint as kept, sum(if(m & before = 0 and m & bit > 0, n, 0))::bigint as removed,
      sum(if(m & before > 0 and m & bit > 0, n, 0))::bigint as redundant, sum(if(m = bit, n, 0))::bigint as unique_fails,
      sum(if(m & before = 0 and m & bit > 0, g, 0))::bigint as good_lost, sum(if(m & before = 0 and m & bit > 0, b, 0))::bigint as toxic_lost from n, s group by part, o, step, bit)
    select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from r""",
)
def op12(spark, sf_dir):
    from shiftscope.llm.filteraudit import interactions

    found = interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lost={"good_lost": "quality = 1", "toxic_lost": "toxic = 1"})
    return found.drop("filter")


@query("op13_pareto_mix")
def op13(spark, sf_dir):
    from shiftscope.llm.sourcemix import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("pipeline")
def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)
