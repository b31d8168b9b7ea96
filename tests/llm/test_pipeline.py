"""The pipeline, stage by stage, against what each stage must have done."""

import re

import corpus_pipeline as C
import public_tokenizers
import pyarrow as pa
from shiftscope.llm.common import saved
from shiftscope.llm.queries import QUERIES
from test_duplicates import _groups, _kept, _shingles


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in C.STAGES:
        seen.append(saved(stage(spark, seen[-1], sf)))
    assert all(d.schema == docs.schema for d in seen[1:-1])
    start, good, single, cut, masked = ({r.doc_id: r.text for r in d.collect()} for d in seen[:-1])
    kept = {r.doc_id for r in QUERIES["op8_weak_supervision"](spark, sf).where("kept").collect()}
    assert good == {d: t for d, t in start.items() if d in kept}
    sets = {d: _shingles(t) for d, t in good.items()}
    alike = {d: max((len(s & sets[e]) / len(s | sets[e]) for e in sets if e != d), default=0) for d, s in sets.items()}
    assert all(single[d] == good[d] for d in single)
    assert all(alike[d] >= 0.8 for d in set(good) - set(single)) and all(d in single for d in good if alike[d] < 0.8)
    assert not [1 for d in single for e in single if d < e and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
    want = _kept(sorted(single.items()))
    assert {d: " ".join(t.split()) for d, t in cut.items()} == {d: " ".join(t.split()) for d, (n, g, t) in want.items() if not g or g < n}
    assert all(cut[d] == single[d] for d in cut if not want[d][1])
    private = re.compile(r"\+1 \(\d{3}\) 555-\d{4}|[\w.]+@mail\d\.example\.com")
    assert set(masked) == set(cut) and not any(x in masked[d] for d, t in cut.items() for x in private.findall(t))
    assert all(masked[d] == t for d, t in cut.items() if not re.search(r"\d", t))
    packed = seen[-1].toPandas()
    assert set(packed.doc_id) == set(masked) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_packing_leaves_little_in_the_workers(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = C.packing(spark, docs, sf).toPandas()
    monkeypatch.setattr(C, "REMEMBERED", 900)
    got = C.packing(spark, docs, sf).toPandas()
    by = ["doc_id", "piece"]
    assert got.sort_values(by).reset_index(drop=True).equals(want.sort_values(by).reset_index(drop=True))

    def held(batches):
        from shiftscope.llm.chunkcache import encoder

        list(batches)
        e = encoder(PATH, 900)
        yield pa.RecordBatch.from_pydict({"n": [len(e.known) + len(e.known.older) + len(e.first)], "most": [max(map(len, map(str.split, texts)))]})

    texts, PATH = [r.text for r in docs.collect()], public_tokenizers.path("byte_bpe_50k.json")
    left = spark.range(8, numPartitions=4).mapInArrow(held, "n long, most long").toPandas()
    assert 0 < left.n.max() <= 900 + 2 * left.most.max()


def test_run_returns_the_last_stage(spark, sf):
    assert QUERIES["pipeline"](spark, sf).columns[:2] == ["doc_id", "piece"]
    assert C.ORACLE_SQL is None and len(C.STAGES) == 5


def test_near_duplicates_stage_is_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {d for (d, _), (k, g) in zip(rows, sorted(_groups([t for _, t in rows]).items())) if k == g}
    assert {r.doc_id for r in C.near_duplicates(spark, docs, sf).collect()} == want
