"""Product codes, filter interactions and source mixing against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, oracle_connection
from shiftscope.llm import queries as Q, vectorcodes
from shiftscope.llm.filteraudit import interactions
from shiftscope.llm.sourcemix import mixed, targets
from shiftscope.llm.vectorcodes import compressed, integers, nearest, tree


@pytest.mark.parametrize("name", ["op11_metric_tree_codes", "op12_filter_interactions"])
def test_query_matches_sql(spark, sf, name):
    ok, message, _ = compare(spark, oracle_connection(sf), sf, name, Q.QUERIES[name], Q.ORACLES[name])
    assert ok, message


def _best(x, entries):
    squares = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(-1)
    return np.array([min(range(len(entries)), key=lambda c: (row[c], c)) for row in squares])


@pytest.mark.parametrize("kind", ["small", "ties", "long", "longer"])
def test_trees_assign_as_brute_force_does(kind):
    rng = np.random.default_rng(1)
    for n, width in ((1, 3), (40, 1), (700, 4), (1500, 2)):
        x = rng.integers(*{"small": (-200, 200), "ties": (-3, 3)}.get(kind, (-(2**33), 2**33)), (n, width))
        if kind == "longer":
            x = np.array([[int(v) * 2**90 + 1 for v in r] for r in x], object)
        entries, ball = x[rng.integers(0, n, 50)], tree(x)
        owned, owner, rows, row_owner = nearest(ball, x, entries)
        got = np.full(n, -1)
        for node, entry in zip(owned, owner):
            got[ball["order"][ball["start"][node] : ball["end"][node]]] = entry
            assert (ball["sums"][node] == x[ball["order"][ball["start"][node] : ball["end"][node]]].sum(axis=0)).all()
        assert (got[rows] == -1).all()
        got[rows] = row_owner
        assert (got == _best(x, entries)).all()


def test_whole_balls_are_owned():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 3, (500, 4)) for c in (0, 200, 400)]).astype(np.int64)
    owned, _, rows, _ = nearest(tree(x), x, np.array([[c] * 4 for c in (0, 200, 400)]))
    assert len(rows) == 0 and len(owned) < 60


def _codes(vectors, parts, entries, rounds):
    """(codes, codebooks) of integer vectors in order of id."""
    dim = vectors.shape[1]
    cuts = [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]
    books = [vectors[:entries, a:b].astype(object) for a, b in cuts]
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            of, old = _best(vectors[:, a:b], books[p]), books[p].copy()
            for e in set(of.tolist()):
                chosen = vectors[of == e, a:b].astype(object)
                old[e] = [int(s) // len(chosen) for s in chosen.sum(axis=0)]
            books[p] = old
    codes = np.array([_best(vectors[:, a:b], books[p]) for p, (a, b) in enumerate(cuts)]).T
    return codes, books


@pytest.mark.parametrize("dim, scale", [(8, 1.0), (7, 30.0), (3, 1e9), (6, 1e36)])
def test_codes_of_many_blocks(spark, monkeypatch, dim, scale):
    monkeypatch.setattr(vectorcodes, "BLOCK", 37)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(300, dim)) * scale
    rows = spark.createDataFrame([(int(i), v.tolist(), "abc"[i % 3] if i % 5 else None, 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string, codes int").repartition(3)
    found, books = compressed(rows, parts=4, entries=20, label_col="label")
    whole = integers(x.ravel(), 256).reshape(x.shape)
    codes, want = _codes(whole, 4, 20, 2)
    assert all((b == w).all() for b, w in zip(books, want))
    got = {r.vec_id: r for r in found.collect()}
    cuts = [(dim * p // 4, dim * (p + 1) // 4) for p in range(4)]
    error = [sum(int(s) for p, (a, b) in enumerate(cuts) for s in (v[a:b] - want[p][c[p]]) ** 2) for v, c in zip(whole.astype(object), codes)]
    sums = defaultdict(int)
    for i, e in enumerate(error):
        sums[got[i].label] += e
    fits = lambda v: v if v < 2**63 else None
    for i, e in enumerate(error):
        assert got[i].codes == codes[i].tolist() and got[i].error == fits(e)
        if all(map(fits, error)):
            assert got[i].label_error == fits(sums[got[i].label])


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], 7), (1, [0.5, 1.0], 7), (None, [3.0, 4.0], None), (2, None, 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0], 1), (7, [-3.4e38, 1.7e308], None)]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, of_label int, data string")
    found, books = compressed(vectors, parts=2, entries=64, label_col="label")
    got = found.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.error, r.label_error) for r in got) == [(False, 1, 0, 0), (False, 1, 0, 0), (False, 7, 0, 0), (True, 0, 0, 0)]
    assert books[1].ravel().tolist() == [256, 256, int(1.7e308) * 256, 1024]
    empty, none = compressed(vectors.where("vec_id = 4"), label_col="label")
    assert empty.count() == 0 and none == [] and empty.columns == found.columns


def _audit(docs, good, toxic):
    rows, first = [], {}
    for d, text, lang in docs:
        text = text or ""
        if d is not None:
            first[text] = min(first.get(text, d), d)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in zip("ABCD", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)))) if bad}
        rows.append((d, text, lang or "", fails))
    fails = [(lang, f | ({"E"} if d is not None and d > first[t] else set()), d in good, d in toxic) for d, t, lang, f in rows]
    out = {}
    for part in {r[0] for r in fails}:
        own = [r for r in fails if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                failing = [r for r in own if f in r[1]]
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(failing) - len(removed), sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed), f]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[key[1][key[2] - 1]]
    return out


def test_filters_of_odd_documents(spark, odd_docs):
    long = " ".join(f"w{i}" for i in range(150))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(long, "en"), (long, "en"), (long, None), ("A B # " * 60, "fr"), (None, "fr"), ("", "fr"), (" \n", None), (long.upper(), "en")])]
    rows += [(2, long + " x", "en"), (2, long, None), (2, long, "de"), (None, long, "en"), (None, None, "en"), (1, long, "en")] + [(9, "again and again", "en")] * 40
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, id int, part string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 0, 1), (9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = interactions(docs, labels, lost={"good_lost": "quality = 1", "toxic_lost": "toxic = 1"})
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found.collect()}
    assert got == _audit(rows, {0, 1, 9}, {1, 2})
    assert interactions(docs.limit(0), labels).count() == 0
    assert interactions(docs).where("filter_order = 'ABCDE' and step = 5").agg(F.sum("kept")).first()[0] == sum(v[0] for k, v in got.items() if k[1:] == ("ABCDE", 5))


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, "ccc")], "doc_id long, text string").withColumn("lang", F.lit("x"))
    found = interactions(docs, filters={"short": F.length("text") < 2, "long": F.length("text") > 1})
    assert {(r.filter_order, r.step, r.filter, r.kept, r.removed) for r in found.collect()} == {("shortlong", 1, "short", 3, 1), ("shortlong", 2, "long", 0, 3), ("longshort", 1, "long", 1, 3), ("longshort", 2, "short", 0, 1)}


def _reshared(sizes, weights, total, most):
    left, out = dict(zip(range(len(sizes)), weights)), {}
    while left:
        share = (total - sum(out.values())) / sum(left.values())
        over = [i for i, w in left.items() if share * w > most * sizes[i]]
        if not over:
            return [out.get(i, share * left.get(i, 0)) for i in range(len(sizes))]
        for i in over:
            out[i] = most * sizes[i]
            del left[i]
    return [out[i] for i in range(len(sizes))]


def test_targets_reshare_the_excess(spark):
    sizes = {None: 900, "b": 10, "a": 50, "é": 400, "Z": 0, "c": 3000, "": 70}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    names = sorted((n for n in sizes if n is not None), key=str.encode) + [None]
    want = _reshared([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    got = {r.source: r.target for r in targets(rows).collect()}
    assert [got[n] for n in names] == pytest.approx(want) and sum(want) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_query(spark, sf):
    rows = Q.op13(spark, sf).collect()
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id][0] or "")) and r.source == texts[r.doc_id][1]
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(sizes, key=str.encode)
    want = _reshared([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    assert [target[n] for n in names] == pytest.approx(want)
    for r in rows:  # documents that are left over don't come nearer
        short = target[r.source] - taken[r.source]
        certain = int(target[r.source] / sizes[r.source])
        if r.copies == certain < 2 and abs(short) > 0.001 * target[r.source]:
            assert abs(short - r["size"]) >= abs(short)


def test_draws_are_fixed_and_fair(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('word ', cast(10 + id % 7 as int)) as text", "if(id % 4 = 0, 'a', 'b') as source", "id % 3 + 1 as own", "1 as rank")
    first = mixed(docs).select("doc_id", "copies")
    again = mixed(docs.repartition(7).orderBy(F.rand(1))).select("doc_id", "copies")
    assert first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()
    rows = mixed(docs, weight="own", share=0.6).groupBy("source", (F.col("doc_id") % 3 + 1).alias("own")).agg(F.avg("copies").alias("copies"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    for r in rows:  # copies in proportion to the weight, up to two
        level = next(level for level in np.arange(0, 50, 0.001) if sum(min(2, k * level) for k in (1, 2, 3)) / 3 >= r.target / r["size"])
        assert abs(r.copies - min(2, level * r.own)) < 0.07


def test_mix_of_odd_documents(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("source", F.when(F.col("doc_id") > 4, "a")).withColumns({"at": F.lit(1), "level": F.lit("x")})
    found = mixed(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.copies <= 2 for r in found)
    assert mixed(no_docs.withColumn("source", F.lit("a"))).count() == 0
    equal = spark.createDataFrame([(1, "one two")] * 500 + [(2, "three")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    rows = mixed(equal, share=0.5).collect()
    assert sum(r.taken for r in rows) in (500, 501) and {r.target for r in rows} == {500.5}
