"""Packing, BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftscope.llm import packing, queries as Q, tokenfiles
from shiftscope.llm.bpetrie import TrieEncoder, decoded, encoded
from shiftscope.llm.chunkcache import ChunkEncoder
from shiftscope.llm.packing import best_fit, cut_lengths, pack_documents
from shiftscope.llm.tokenfiles import bits_for, pack_bits, read_documents, read_ids, unpack_bits, write_token_files
from shiftscope.session import scratch_path

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PARTS = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "é", "é", "\xa0", "　", "'s", "1", "23", ".", "!?", "<|endoftext|>", "<|", "word", "\x1c", "日本", "😀", "\x01", "\x00", "Σ", "İ", "\r\n", "the", "tion", "----"]


def _texts(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(n)]


def _library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("path, make", [(BYTE, ChunkEncoder), (WORD, ChunkEncoder), (BYTE, TrieEncoder)])
def test_encoders_equal_the_library(path, make):
    encode, library = make(path, keep=300), _library(path)  # a small memory, so that forgetting is tried as well
    for seed in range(12):
        texts = _texts(seed, 250) + ["a" * 300, "ab" * 200, "x y" * 50]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, encode.dtype).tolist() for b in encode(texts)] == want


def test_trie_round_trip(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text")
    both = decoded(encoded(docs, BYTE), BYTE)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in both.collect())
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    assert decoded(encoded(no_docs, BYTE), BYTE).count() == 0


def test_trie_query_equals_the_library(spark, sf):
    library = _library(BYTE)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op5(spark, sf).collect()} == want


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 700)
    for score in ("norm", "dot"):
        bins, offsets = best_fit(lengths, 100, 5, 3000.0, score=score)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            size = lengths[own]
            assert size.sum() <= 100 and (len(own) == 1 or (len(own) <= 5 and (size.astype(float) ** 2).sum() <= 3000))
            order = np.argsort(offsets[own])
            assert (offsets[own][order] == np.concatenate([[0], np.cumsum(size[order])[:-1]])).all()
    assert cut_lengths(2500, 1024) == [452, 1024, 1024] and cut_lengths(2048, 1024) == [1024, 1024] and cut_lengths(0, 1024) == [0]


def test_packing_query(spark, sf):
    library = _library(BYTE)
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = Q.op1(spark, sf).toPandas().sort_values(["doc_id", "piece"])
    for doc, own in rows.groupby("doc_id"):
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids[doc]) and (own.length[1:] == 1024).all()
        assert all(zlib.crc32(np.array(ids[doc][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 1024 and own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
    assert rows.sequence_id.nunique() <= 1.01 * -(-rows.length.sum() // 1024) + 2 and set(rows.doc_id) == set(ids)


def test_packing_odd_documents(odd_docs, no_docs):
    rows = pack_documents(odd_docs, BYTE, end_id=2).toPandas()
    assert rows[rows.piece == 0].shape[0] == odd_docs.count() and rows.groupby("sequence_id").length.sum().max() <= 1024
    assert pack_documents(no_docs, BYTE, end_id=2).count() == 0


def _counting():
    """An encoder that takes few texts at a time only; nested, so that workers get it by value."""

    def make(*args):
        from shiftscope.llm.chunkcache import encoder

        class Few:
            dtype, size = encoder(*args).dtype, encoder(*args).size

            def __call__(self, texts):
                assert len(texts) <= 250, "the words of too many texts are held at once"
                return encoder(*args)(texts)

        return Few()

    return make


def _most_rows(docs):
    """Rows of the largest batch that reaches Python."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return docs.mapInArrow(rows, "n long").agg({"n": "max"}).first()[0]


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    packed = pack_bits(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    for first, count in ((0, 1000), (1, 7), (993, 7), (500, 0), (333, 100)):
        assert (unpack_bits(packed, width, first, count) == ids[first : first + count]).all()
    assert bits_for(49408) == 16 and bits_for(32000) == 15 and bits_for(1) == 1


def test_token_files(spark, sf, odd_docs, no_docs):
    library, before = _library(WORD), 0
    rows = Q.op10(spark, sf).toPandas().sort_values("doc_id").itertuples()
    for r, doc in zip(rows, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = [*library.encode(doc.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    path = scratch_path(spark, "odd")
    write_token_files(odd_docs, path, WORD, end_id=1, block_ids=64, part_bytes=5000)
    got = read_documents(spark, path).orderBy("start").collect()
    assert len(got) == odd_docs.count() and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    some = read_ids(spark, path, 37, 200).orderBy("position").collect()
    assert [r.id for r in some] == stream[37:237].tolist() and some[0].position == 37
    empty = scratch_path(spark, "empty")
    write_token_files(no_docs, empty, WORD, end_id=1)
    assert read_documents(spark, empty).count() == 0


def test_token_files_hold_few_texts(spark, sf, monkeypatch):
    docs = spark.range(700).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    Q.op10(spark, sf)
    assert _most_rows(docs) <= 500
    monkeypatch.setattr(tokenfiles, "encoder", _counting())
    path = scratch_path(spark, "few")
    write_token_files(docs, path, WORD, end_id=1)
    assert read_documents(spark, path).count() == 700


def test_packing_holds_few_texts(spark, sf, monkeypatch):
    docs = spark.range(700).selectExpr("id as doc_id", "concat('word ', id) as text").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    Q.op1(spark, sf)
    assert _most_rows(docs) <= 500
    monkeypatch.setattr(packing, "encoder", _counting())
    assert pack_documents(docs, BYTE, end_id=2).count() == 700


def test_documents_longer_than_a_block(spark):
    """A document of more ids than a block is one block of its own, and long ones follow each other."""
    texts = ["one two", "long word " * 40000, None, "again and again " * 25000, "three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, WORD, end_id=1, part_bytes=1 << 19)
    library, start = _library(WORD), 0
    got = {r.doc_id: r for r in read_documents(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids)) and np.frombuffer(got[i].ids, "<u4").tolist() == ids
        start += len(ids)
    assert max(r.n_ids for r in spark.read.parquet(f"{path}/blocks").collect()) > 1 << 16
    row = read_ids(spark, path, 70000, 3).orderBy("position").collect()
    assert [r.id for r in row] == np.frombuffer(got[1].ids, "<u4")[70000 - got[1].start :][:3].tolist()


def test_pieces_forget_and_learn_again():
    """Slots of new pieces are filled before they are joined, in both generations of a small memory."""
    for path in (BYTE, WORD):
        encode, library = ChunkEncoder(path, keep=20), _library(path)
        pick = random.Random(1)
        for _ in range(20):
            texts = [" ".join(pick.choices(["alpha", "Alpha", "beta.", "beta", "it's", "gamma,", "1st", "x"], k=9)) + pick.choice(["", "\nnext line", " end"]) for _ in range(8)]
            assert [np.frombuffer(b, encode.dtype).tolist() for b in encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
