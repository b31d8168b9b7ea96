"""SimHash groups and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import compare, oracle_connection
from shiftscope.llm import queries as Q, simhash, substrings
from shiftscope.llm.components import connected
from shiftscope.llm.simhash import fingerprint, links, near_duplicates, one_of_each, similar_documents
from shiftscope.llm.substrings import Automaton, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    """Smallest id reachable over up to three bits, by comparing all pairs."""
    ids, root = sorted(prints), {}
    values = np.array([prints[i] for i in ids], np.uint64)
    for at, i in enumerate(ids):
        if i in root:
            continue
        todo = [at]
        while todo:
            k = todo.pop()
            if ids[k] in root:
                continue
            root[ids[k]] = i
            todo += np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3).tolist()
    return root


def test_simhash_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: _fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op4(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in _components(prints).items()}


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_crowded_fingerprints_lose_no_link(spark, monkeypatch, tile):
    """Chains and crowds of fingerprints, also where a key is dealt to tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    pick = random.Random(5)
    prints = [pick.getrandbits(64) for _ in range(100)]
    for centre in prints[:4]:
        at = centre
        for _ in range(60):  # a chain that wanders off
            at ^= sum(1 << b for b in pick.sample(range(64), pick.randint(1, 3)))
            prints.append(at)
        prints += [centre ^ 1 << pick.randrange(64) ^ 1 << pick.randrange(64) for _ in range(80)]
    rows = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    found = {r.node: r.root for r in connected(links(rows)).collect()}
    values = [int(np.uint64(p).astype(np.int64)) for p in prints]
    want = _components(dict(enumerate(prints)))
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(want[i], set()).add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def test_similar_documents_find_edited_copies(spark):
    pick, docs = random.Random(3), []
    for base in range(40):
        words = [f"w{pick.randrange(5000)}" for _ in range(pick.choice([20, 60, 300, 900]))]
        docs.append(" ".join(words))
        for share in (0.004, 0.01, 0.03, 0.1):  # of the words change
            copy = [f"x{pick.randrange(5000)}" if pick.random() < share else w for w in words]
            docs.append("  ".join(copy).upper())
    sets = [_shingles(d) for d in docs]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in similar_documents(rows).collect()}
    near = [(len(a & b) / len(a | b), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a & b]
    sure = [(i, j) for s, i, j in near if s >= 0.86]
    assert len(sure) > 40 and sum(group[i] == group[j] for i, j in sure) >= 0.98 * len(sure)
    reach = {}
    for s, i, j in near:
        if s >= 0.7:
            reach.setdefault(i, set()).add(j)
            reach.setdefault(j, set()).add(i)
    assert all(reach.get(i) for i in group if group[i] != i)
    assert similar_documents(rows.limit(0)).count() == 0


def _pair(pick, n, least, above):
    """Two word lists of n words whose five-word similarity is just at or above ``least``, or else just below it."""
    words = [f"w{pick.randrange(10**6)}" for _ in range(n)]
    copy, last = list(words), list(words)
    sim = lambda x: len(a & b) / len(a | b) if (a := _shingles(" ".join(words))) and (b := _shingles(" ".join(x))) else 0
    for at in pick.sample(range(n), n):
        copy[at] = f"x{pick.randrange(10**6)}"
        if sim(copy) < least:
            return " ".join(words), " ".join(last if above else copy)
        last = list(copy)


def test_similarity_is_exact_at_the_threshold(spark):
    """Pairs just below 0.8 stay apart."""
    pick = random.Random(11)
    pairs = [_pair(pick, pick.randint(60, 900), 0.8, False) for _ in range(150)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in similar_documents(rows).collect()}
    assert all(group[k] == k for k in group)


def _groups(docs, least=0.8):
    """Smallest number reachable over pairs of exact similarity ``least``, by comparing all pairs."""
    sets, group = [_shingles(d) for d in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and len(a & sets[j]) / len(a | sets[j]) >= least:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return dict(enumerate(group))


@pytest.mark.parametrize("tile, common", [(simhash.TILE, simhash.COMMON), (16, 5)])
def test_similar_documents_are_the_exact_components(spark, monkeypatch, tile, common):
    """Pairs at and just below 0.8, short ones too, and documents that share a long passage; no link comes from the keys of least hashes alone."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "COMMON", common)
    pick, passage = random.Random(13), " ".join(f"p{k}" for k in range(40))
    docs = [t for k in range(240) for t in _pair(pick, pick.choice([40, 60, 90, 300, 500]), 0.8, k % 4 > 0)]
    docs += [" ".join(f"w{pick.randrange(10**6)}" for _ in range(n)) + " " + passage for n in range(60)] + ["", " ", "one", "ONE two"]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_documents(rows).collect()} == _groups(docs)


def test_repeated_passages_do_not_hide_similar_sets(spark):
    pick, docs = random.Random(12), []
    for _ in range(80):
        words = [f"w{pick.randrange(10**6)}" for _ in range(300)]
        docs += [words, words[:200] + words[176:200] * 12 + words[200:]]
    sets = [_shingles(" ".join(d)) for d in docs]
    assert min(len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])) >= 0.8
    rows = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in similar_documents(rows).collect()}
    assert all(group[k] == k - k % 2 for k in group)


def test_near_duplicates_of_odd_documents(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.fingerprint == 0} == {0}  # no words: all alike
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and [r.doc_id for r in kept.where("text is null or trim(text) = ''").collect()] == [0]
    assert kept.where("doc_id is null").count() == 1
    assert near_duplicates(no_docs).count() == 0 and one_of_each(no_docs).count() == 0
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, k) for k in range(201, 300)] + [(5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{k: 200 for k in range(200, 300)}}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def _kept(docs, window=50):
    words = {d: WORD.findall(t or "") for d, t in docs}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (n, g, hashlib.sha256(t.encode()).hexdigest()) for d, (n, g, t) in _kept(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op7(spark, sf).collect()} == want


def test_substring_query_equals_its_oracle(spark, sf):
    ok, message, _ = compare(spark, oracle_connection(sf), sf, "op7", Q.op7, Q.ORACLES["op7_substring_dedup"])
    assert ok, message


@pytest.mark.parametrize("tile, stretch", [(substrings.TILE, substrings.STRETCH), (4, 64)])
def test_passages_in_new_company(spark, monkeypatch, tile, stretch):
    """Passages that share parts, in documents that repeat themselves, with few words and with one word over and over."""
    monkeypatch.setattr(substrings, "TILE", tile)
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    pick = random.Random(9)
    fresh = lambda n: [pick.choice("abcdefghijklmnopqrstuvwxyz") + pick.choice("xyz") * pick.randint(0, 3) for _ in range(n)]
    passages = [fresh(n) for n in (50, 60, 90, 49)]
    docs = []
    for d in range(60):
        own = fresh(pick.randint(0, 80))
        for _ in range(pick.randint(0, 3)):
            p = pick.choice(passages)
            a = pick.randint(0, 8)
            own += p[a:] + fresh(pick.randint(0, 30))
        if d % 7 == 0:
            own += ["same"] * 130
        if d % 9 == 0:
            own = [w for x in (["one", "two"] * 60, own) for w in x]
        docs.append((d, pick.choice([" ", "\n"]).join(own)))
    docs += [(60 + k, docs[k][1]) for k in range(5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in remove_repeats(rows, layout=False).collect()}
    assert got == _kept(docs)


def test_layout_and_odd_documents_stay(spark, odd_docs, no_docs):
    got = remove_repeats(odd_docs)
    assert got.where("n_removed = 0").select("text").exceptAll(odd_docs.select("text")).count() == 0 and got.count() == odd_docs.count()
    assert set(got.select("rest.*").columns) == set(odd_docs.columns) - {"doc_id", "text"}
    assert remove_repeats(no_docs).count() == 0
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"head\n{words}  tail"), (2, f"other  one\n\n{words}\n end\n"), (2, words), (None, words)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text) for r in remove_repeats(docs).collect())
    assert out == [(0, words), (1, f"head\n{words}  tail"), (2, ""), (2, "other  one\n end\n")]


def test_automaton_matches_brute_force():
    pick = random.Random(2)
    for _ in range(50):
        texts = [[pick.choice("abc") for _ in range(pick.randint(0, 30))] for _ in range(4)]
        automaton = Automaton()
        for t in texts[:3]:
            automaton.add(t)
        inside = {tuple(t[i:j]) for t in texts[:3] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([n for n in range(k + 2) if n == 0 or tuple(texts[3][k + 1 - n : k + 1]) in inside]) for k in range(len(texts[3]))]
        assert automaton.matches(texts[3]) == want
