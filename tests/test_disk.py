"""What search and export leave on the disk, and that it is still all there."""

import os
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shiftscope import session
from shiftscope.operators import retrieval as R, search as SX
from shiftscope.sources import corpus


def _folders(spark):
    """Names of scratch folders, without what makes them unique."""
    base = session.shared_dir(spark).removeprefix("file:")
    return {name: name.rsplit("-", 1)[0] for name in os.listdir(base)}


@pytest.fixture
def chunks(spark):
    words = "red green blue cyan gold 7 a_b red red".split()
    rows = [(i % 40, i // 40, None if i % 9 == 0 else date(2018, 1, 1) + timedelta(i % 50), f"t{i}", " ".join(words[(i * k) % 9] for k in range(1, 2 + i % 13))) for i in range(400)]
    rows += [(50, 0, None, "empty", ""), (51, 0, date(2018, 1, 2), "twice", "red red"), (51, 0, date(2018, 1, 2), "twice", "red red")]
    return R.index_columns(spark.createDataFrame(rows, "doc_id long, chunk_no int, doc_date date, title string, text string"))


def test_an_index_holds_chunks_once(spark, chunks, tmp_path):
    before = _folders(spark)
    SX.write_index(chunks, str(tmp_path / "i"), shard=100)
    assert not [n for n in set(_folders(spark)) - set(before)]
    index = SX.ChunkIndex(spark, str(tmp_path / "i"))
    # texts, codes and buckets are there; words are not needed once they are counted
    assert set(index.rows.columns) == {*chunks.columns, "key", "shard"} - {"tokens"}
    rows = index.rows.collect()
    assert Counter((r.doc_id, r.chunk_no, r.text, tuple(r.codes), tuple(r.buckets)) for r in rows) == Counter((r.doc_id, r.chunk_no, r.text, tuple(r.codes), tuple(r.buckets)) for r in chunks.collect())
    want = {}
    for r in rows:
        for code, tf in Counter(r.codes).items():
            no = r.key & ((1 << SX._PLACE) - 1)
            want.setdefault((r.shard, code), {}).setdefault(no // SX.BLOCK, []).append((no, tf, len(r.codes)))
    got = {(r.shard, r.code): r.blocks for r in index.postings.collect()}
    assert got.keys() == want.keys() and len(got) > 10 and index.postings.count() == len(got)
    for at, blocks in got.items():
        assert [(b.block, b.most, b.short, b.no, b.tf) for b in blocks] == [
            (k, max(t for _, t, _ in v), min(n for *_, n in v), [n for n, *_ in sorted(v)], [t for _, t, _ in sorted(v)]) for k, v in sorted(want[at].items())]


def test_a_search_of_one_time_leaves_no_index(spark, chunks):
    queries = spark.createDataFrame([(1, ["red", "gold"]), (2, ["cyan"])], "query_id long, tokens array<string>").select(
        "query_id", "tokens", F.array(F.lit(3), F.lit(5)).alias("buckets"), F.lit(None).cast("date").alias("first_day"), F.lit(None).cast("date").alias("last_day"))
    before = _folders(spark)
    found = SX.hybrid_search(chunks.drop("text", "title"), queries, k=3, shard=100)
    assert found.count() == 6
    assert not [kind for name, kind in _folders(spark).items() if name not in before and kind in ("index", "chunks")]


def test_an_export_moves_documents_and_not_chunks(spark, tmp_path):
    docs = spark.range(300).select((F.col("id") * 37 % 290).alias("doc_id"), F.lit("t").alias("title"), F.lit("note").alias("doc_type"), F.lit(None).cast("date").alias("doc_date"),
                                   F.repeat(F.concat(F.lit("word "), F.col("id"), F.lit("\n\n")), 400).alias("text"))
    before = _folders(spark)
    corpus.export_chunks(corpus.make_chunks(corpus.by_document(docs), "d"), str(tmp_path / "a"), placed=True)
    assert not set(_folders(spark)) - set(before)
    corpus.export_chunks(corpus.make_chunks(docs, "d"), str(tmp_path / "b"))
    assert not [kind for name, kind in _folders(spark).items() if name not in before]
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert a.columns == b.columns and a.count() == b.count() > 600 and a.exceptAll(b).count() == 0
    files = sorted((tmp_path / "a").glob("part-*"))
    keys = [(r.doc_id, r.chunk_no) for f in files for r in spark.read.parquet(str(f)).select("doc_id", "chunk_no").collect()]
    assert keys == sorted(keys) and len(files) > 1
