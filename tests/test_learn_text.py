"""Term weights by blocks of texts, held against plain counting."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shiftscope.operators import learn as L

TEXTS = [(1, "one two three one two"), (2, "two three Four"), (2, "one two"), (3, None), (4, ""), (5, "  Ação two   three  "), (None, "one two three"), (6, "x two three"),
         (7, "one two three four"), (8, "naïve two one"), (9, "a b c"), (10, "one \U0001f600two two three"),
         (11, "é" * 70 + " one two"), (12, "é" * 90), (13, "é" * 70), (14, "é" * 70), (15, "é" * 70)]


def _fold(text):
    return (text or "").lower().translate(str.maketrans(L.ACCENTED, L.PLAIN))


def _terms(kind, text):
    if kind == "w":
        words = re.findall(r"\w{2,}", _fold(text))
        return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
    padded = [f" {w} " for w in re.split(r"\s+", _fold(text).strip(" ")) if w]
    return Counter(w[i : i + n] for w in padded for n in (3, 4, 5) for i in range(len(w) - n + 1))


def _weights(kind, fitted):
    tf, seen, n = defaultdict(Counter), defaultdict(set), 0
    for key, text in TEXTS:
        tf[key] += _terms(kind, text)
        if fitted(key):
            n += 1
            for t in _terms(kind, text):
                seen[t].add(key)
    out = {}
    for key, counts in tf.items():
        raw = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + len(seen[t]))) + 1) for t, c in counts.items() if len(seen[t]) >= L.KINDS[kind][1]}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(key, f"{kind}:{t}"): round(v / norm, 9) for t, v in raw.items()}
    return out


def test_weights_of_any_blocks(spark):
    docs = spark.createDataFrame(TEXTS, "id bigint, text string")
    for chars, fitted, fit in ((40, lambda k: True, None), (10_000, lambda k: k != 7, ~F.col("id").eqNullSafe(7))):
        rows = L.text_weights(docs, "id", "text", fit=fit, chars=chars).collect()
        got = {(r["id"], t): round(w, 9) for r in rows for t, w in zip(r["terms"], r["weights"])}
        assert got == _weights("w", fitted) | _weights("c", fitted)


def test_idf_counts_keys_once(spark):
    docs = spark.createDataFrame(TEXTS, "id bigint, text string")
    for kind in "wc":
        seen = Counter(t for key in {k for k, _ in TEXTS} for t in set().union(*[_terms(kind, x) for k, x in TEXTS if k == key]))
        got = {r["term"]: r["df"] for r in L.term_idf(docs, "id", "text", kind, len(TEXTS), 2).collect()}
        assert got == {t: n for t, n in seen.items() if n >= 2}


def test_hashed_vectors_add_up_cells(spark):
    docs = spark.createDataFrame(TEXTS, "id bigint, text string").where("id is not null").withColumn("label", F.col("id") % 2)
    weights = L.text_weights(docs, "id", "text", keep=["label"])
    slots = weights.select("id", F.inline(F.arrays_zip("terms", "weights"))).groupBy("id", F.pmod(F.xxhash64("terms"), F.lit(8)).alias("i")).agg(F.sum("weights").alias("w"))
    want = defaultdict(dict)
    for r in slots.collect():
        want[r["id"]][r["i"]] = round(r["w"], 9)
    rows = L.hashed_vectors(weights, "id", bits=3).collect()
    assert sorted(r["id"] for r in rows) == sorted(k for k, _ in TEXTS if k in want)  # a row for each row of the texts
    for r in rows:
        assert {int(i): round(float(v), 9) for i, v in zip(r["features"].indices, r["features"].values)} == want[r["id"]] and r["label"] == r["id"] % 2


def test_single_terms_are_not_shuffled(spark):
    docs = spark.createDataFrame(TEXTS, "id bigint, text string")
    plan = L.text_weights(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (?:hashpartitioning|rangepartitioning)\((\w+)", plan)
    assert dealt and not [c for c in dealt if c == "id"]


def test_stratified_split_deals_keys_only(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit("text").alias("text"))
    got = L.stratified_split(rows, "id", "label")
    assert sorted((r["label"], r["split"], r["count"]) for r in got.groupBy("label", "split").count().collect()) == [(0, "test", 40), (0, "train", 160), (1, "test", 20), (1, "train", 80)]
    first = {r["id"] for r in rows.where("label = 1").orderBy(F.xxhash64(F.col("id").cast("string"))).limit(20).collect()}
    assert {r["id"] for r in got.where("label = 1 and split = 'test'").collect()} == first
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" not in plan and "Exchange hashpartitioning" not in plan  # texts stay where they are
