import hashlib
import math
import random
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from shiftscope.operators import grounding as G, retrieval as R, search as SX, text as X
from shiftscope.sources import corpus


def test_chunks_keep_paragraphs_and_lose_nothing(spark):
    body = "\n\n".join(f"Paragraph {i} " + "x" * (i * 37 % 500) for i in range(40)) + "\n\n" + "y" * 1200 + "\n\n  \n\nlast"
    got = [r.text for r in X.chunk_text(spark.createDataFrame([(1, body)], "id int, text string"), "text").orderBy("chunk_no").collect()]
    paragraphs = [p.strip() for p in body.split("\n\n") if p.strip()]
    assert "\n\n".join(got) == "\n\n".join(paragraphs)
    assert all(len(c) <= 900 or c in paragraphs for c in got)


def test_masks(spark):
    rows = [("mail jane.doe@example.com now", "mail j***@example.com now"), ("call +55 11 91234-5678.", "call ***78."), ("order 12345678", "order 12345678")]
    out = spark.createDataFrame(rows, "t string, want string").select(X.mask_pii(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_md5_mod_any_size(spark):
    import hashlib

    df = spark.createDataFrame([(w,) for w in ("a", "late", "delivery7")], "w string")
    for dims in (256, 1000, 999983):
        got = [r[0] for r in df.select(X.md5_mod(F.col("w"), dims)).collect()]
        assert got == [int(hashlib.md5(w.encode()).hexdigest(), 16) % dims for w in ("a", "late", "delivery7")]


def test_cells_and_labels(spark):
    cases = [("2017-11", "2017-11-01"), ("2017-11-05 10:00:00", "2017-11-05"), (" 12 ", "12.0"), ("On Time", "On Time")]
    out = spark.createDataFrame(cases, "t string, want string").select(X.normalize_cell(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]
    assert spark.range(1).select(X.normalize_label(F.lit("On-Time_x"))).first()[0] == "ontimex"


def test_json_from_replies(spark):
    texts = ["Sure!\n```json\n{\"k\": 1}\n```\nBye {not json}", "before {\"k\": 2} after", "nothing", "{broken"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.try_variant_get(X.extract_json(F.col("t")), "$.k", "int")).collect()]
    assert got == [1, 2, None, None]


def _unsupported(text, evidence):
    number = re.compile(r"(?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?")
    values = [float(i) for i in range(11)]
    for m in number.findall(evidence):
        v = abs(float(m.replace(",", "")))
        values += [v, v * 100]
    bad = []
    for raw in number.findall(text):
        clean = raw.replace(",", "").lstrip("+")
        digits = len(clean.split(".")[1]) if "." in clean else 0
        if not any(abs(abs(float(clean)) - v) <= 0.5 * 10**-digits + 1e-9 for v in values):
            bad.append(raw)
    return bad


def test_unsupported_numbers_equal_brute_force(spark):
    answers = [("a", "Sales fell 12.3% to 1,234 from 1409.5; 3 sellers, -45 and 46.5"), ("b", "Rate 0.286 or 28.6 % of 99.99; 17 left"), ("c", "42 and 43")]
    evidence = [("a", "0.1229 1234.4 1409.46 -45.2"), ("b", "0.28571 100 16.5"), ("c", "no number")]
    a, e = spark.createDataFrame(answers, "k string, t string"), spark.createDataFrame(evidence, "k string, t string")
    got = {}
    for r in G.unsupported_numbers(a, e, "k", "t").orderBy("k", "no").collect():
        got.setdefault(r.k, []).append(r.raw)
    assert got == {k: bad for (k, t), (_, ev) in zip(answers, evidence) if (bad := _unsupported(t, ev))}


DOCS = ["payments counted twice in october", "carrier lost drivers so deliveries were late", "boleto outage canceled many orders", "new seller onboarding guide",
        "late late late deliveries in the north", "october promotion for health and beauty"]


def _bm25(docs, query):
    toks = [re.findall(r"[a-z0-9_]+", d) for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in re.findall(r"[a-z0-9_]+", query)) for d in toks]


def _index(spark, docs):
    rows = spark.createDataFrame([(i, 0, d) for i, d in enumerate(docs)], "doc_id bigint, chunk_no int, text string").withColumn("doc_date", F.lit(None).cast("date"))
    return R.index_columns(rows)


def _asked(spark, queries):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id bigint, text string")
    none = F.lit(None).cast("date")
    return R.index_columns(rows).withColumns({"first_day": none, "last_day": none})


def test_bm25_equals_the_formula(spark):
    query = "late deliveries october late"
    got = {r.doc_id: r.score for r in R.bm25_scores(_index(spark, DOCS), _asked(spark, [query])).collect()}
    for i, want in enumerate(_bm25(DOCS, query)):
        assert abs(got.get(i, 0.0) - want) < 1e-9


def test_hybrid_search_is_the_same_in_any_block_size(spark):
    index, asked = _index(spark, DOCS * 30), _asked(spark, ["late deliveries", "payments twice", "boleto outage", "seller guide"])
    runs = [sorted(map(tuple, SX.hybrid_search(index, asked, k=2, block=b, shard=n).collect())) for b, n in ((256, 16384), (3, 40))]
    assert runs[0] == runs[1] and len(runs[0]) == 8
    best = {q: d for q, place, d, *_ in runs[0] if place == 1}
    assert best[1] % 6 == 0 and best[2] % 6 == 2 and best[3] % 6 == 3


def _fused(texts, days, query, window, k):
    """Both rankings in full, candidates of the window only."""
    inside = [i for i, d in enumerate(days) if d is None or window is None or window[0] <= d <= window[1]]
    own = [texts[i] for i in inside]
    bag = lambda t: np.bincount([int(hashlib.md5(w.encode()).hexdigest(), 16) % 256 for w in re.findall("[a-z0-9]+", t)], minlength=256)
    q = bag(query)
    cosine = [round(float(bag(t) @ q / ((np.linalg.norm(bag(t)) * np.linalg.norm(q)) or 1)), 9) for t in own]
    keyword = [round(s, 9) for s in _bm25(own, query)]
    rank = lambda scores: {i: r + 1 for r, i in enumerate(sorted(range(len(own)), key=lambda i: (-scores[i], i)))}
    a, b = rank(keyword), rank(cosine)
    best = sorted(range(len(own)), key=lambda i: (-(1 / (60 + a[i]) + 1 / (60 + b[i])), i))[:k]
    return [(inside[i], round(1 / (60 + a[i]) + 1 / (60 + b[i]), 4)) for i in best]


def test_search_equals_both_rankings_in_full(spark):
    """Common words with negative raw idf, words nobody has, windows without chunks, ties and undated chunks."""
    pick = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(pick.choices(words, weights=[1 / (i + 1) for i in range(60)], k=pick.randint(1, 30))) for _ in range(700)] + ["common alike"] * 40
    days = [None if i % 9 == 0 else date(2020, 1, 1) + timedelta(days=i * 37 % 200) for i in range(len(texts))]
    queries = [("w0 w1", None), ("w50 w58 w59", None), ("w0 w45 nothing", (date(2020, 2, 1), date(2020, 3, 1))), ("common", (date(2020, 1, 20), date(2020, 6, 1))),
               ("nothing at all", None), ("w3 w3 w40", (date(2030, 1, 1), date(2030, 2, 1))), ("", (date(2020, 1, 1), date(2020, 1, 2)))]
    rows = spark.createDataFrame([(i, 0, t, d) for i, (t, d) in enumerate(zip(texts, days))], "doc_id bigint, chunk_no int, text string, doc_date date")
    asked = spark.createDataFrame([(i, q, *(w or (None, None))) for i, (q, w) in enumerate(queries)], "query_id bigint, text string, first_day date, last_day date")
    found = {}
    for r in SX.hybrid_search(R.index_columns(rows), R.index_columns(asked), k=4, block=3, shard=100).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, (q, w) in enumerate(queries):
        want = _fused(texts, days, q, w, 4)
        assert [d for d, _ in found[i]] == [d for d, _ in want] and all(abs(a - b) < 1.1e-4 for (_, a), (_, b) in zip(found[i], want))


def test_few_postings_are_read(spark):
    """Blocks that can't reach the leaders are never opened, and the leaders are those of a full scan."""
    rng = np.random.default_rng(3)
    n = 6400
    length = rng.integers(20, 200, n).astype(float)
    blocks, weights = [], np.array([[2.0], [0.7], [4.0]])
    tf = [np.where(rng.random(n) < p, rng.geometric(0.6, n), 0) for p in (0.5, 0.9, 0.01)]
    tf[2][100:130] += 5
    for t in range(3):
        own = []
        for b in range(n // SX.BLOCK):
            at = np.flatnonzero(tf[t][b * SX.BLOCK : (b + 1) * SX.BLOCK]) + b * SX.BLOCK
            if len(at):
                own.append({"block": b, "most": int(tf[t][at].max()), "short": float(length[at].min()), "no": at.tolist(), "tf": tf[t][at].tolist()})
        blocks.append((t, own))
    asked = {"ids": np.array([1]), "window": np.array([0]), "first": np.array([-np.inf]), "last": np.array([np.inf]), "weights": weights, "mean": np.array([length.mean()])}
    found, read, there = SX.best_by_keyword(blocks, np.full(n, np.nan), length, asked, 20)
    score = sum(weights[t, 0] * SX._impact(tf[t].astype(float), length, length.mean()) for t in range(3))
    order = np.lexsort((np.arange(n), -np.round(score, 9)))[:20]
    assert found[0][1].tolist() == order.tolist() and read < 0.7 * there


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "late_notice.md").write_text("---\ntitle: Late notice\ntype: incident\ndate: 2018-06-03\n---\n\nCarrier lost drivers.\n\nMore text.\n")
    (tmp_path / "plain_note.md").write_text("No header here.\n")
    (tmp_path / "skip.txt").write_text("ignored")
    rows = {r.doc_id: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert set(rows) == {"late_notice", "plain_note"}
    assert (rows["late_notice"].title, rows["late_notice"].doc_type, str(rows["late_notice"].doc_date)) == ("Late notice", "incident", "2018-06-03")
    assert rows["late_notice"].text == "Carrier lost drivers.\n\nMore text."
    assert (rows["plain_note"].title, rows["plain_note"].doc_type, rows["plain_note"].doc_date) == ("plain note", "document", None)


def test_search_leaders_do_not_grow_with_small_shards(spark, tmp_path):
    """A span of shards gives its leaders together, and is dealt once for all blocks of queries."""
    import datetime

    from pyspark.sql import functions as F

    from shiftscope.operators import retrieval as R, search as SX

    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit(datetime.date(2018, 1, 1)).alias("doc_date"), F.format_string("w%d w%d", F.col("id") % 7, F.col("id") % 3).alias("text"))
    SX.write_index(R.index_columns(rows), str(tmp_path / "i"), shard=4)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3"), (3, "w0 w1")], "query_id bigint, text string").withColumns({c: F.lit(None).cast("date") for c in ("first_day", "last_day")})
    asked, index = R.index_columns(asked), SX.ChunkIndex(spark, str(tmp_path / "i"))
    packed, _ = SX.pack_queries(asked, R.statistics(index.daily, index.terms, asked), 256, 1)
    assert index.shards.count() > 60
    seen = SX._vector_leaders(index.rows, packed, 5)
    assert seen.count() == 3 * (5 + 15)  # one span, whatever the shards
    assert sorted(r["key"] for r in seen.where("first and query_id = 2").collect()) == sorted(r["key"] for r in index.rows.orderBy("key").limit(15).collect())
