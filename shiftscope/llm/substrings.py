"""Removal of passages that a document with a smaller id already holds, by suffix automata of reference passages.

The automaton of a reference shard streams the documents that may share text with it and gives, at every word, the length of the longest
suffix found in the shard; where it reaches ``window`` words, that window is removed. One automaton of a whole corpus would grow with it,
so the corpus is cut into shards that can be built in one task, and a shard's automaton is only sent where it can match:

1. Every window has an anchor, its ten-word gram of least hash. Equal windows have equal anchors, so text under an anchor that one
   document alone holds cannot repeat. Neighbouring windows with one anchor form a segment.
2. Segments of equal content are one; of those, all but the one with the smallest id repeat it whole.
3. What is left is trimmed to windows whose hash occurs twice, and equal passages are again one.
4. The remaining passages under one anchor are a reference shard. Passages run through its automaton in order of id and are then added.
   More than ``TILE`` passages are dealt to tiles, each with the automaton of one chunk and the passages of another.

Hashes only choose what is compared; except for equal content (two 64-bit hashes), what is removed is found word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from shiftscope.llm.common import saved, scope, slices
from shiftscope.session import scratch_path

GRAM = 10
TILE = 128
#: Words looked at together in a very long text.
STRETCH = 1 << 16
BASE = 0x9E3779B97F4A7C15


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, word, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                continue
            own, p = self._state(self.length[last] + 1, 0, {}), last
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = own
                p = self.link[p]
            if p != -1:
                q = self.next[p][word]
                self.link[own] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            last = own

    def matches(self, words: list) -> list[int]:
        """At every word the length of the longest suffix of what was read that occurs in the automaton."""
        state, n, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            follow = self.next[state].get(word)
            if follow is not None:
                state, n = follow, n + 1
            out.append(n)
        return out


def _powers(n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  grown once per worker
    if len(known.get("up", ())) < n:
        size = max(n, 1 << 16)
        back = pow(BASE, -1, 1 << 64)
        for name, factor in (("up", BASE), ("down", back)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            known[name] = np.cumprod(steps, dtype=np.uint64)
    return known["up"][:n], known["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of any run of words of a stretch of text."""

    def __init__(self, words: list[bytes]):
        self.text = b" ".join(words)
        raw = np.frombuffer(self.text, np.uint8)
        up, self.down = _powers(len(raw))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=self.sums[1:])
        spaces = np.flatnonzero(raw == 32)
        self.starts, self.ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])

    def runs(self, n: int) -> np.ndarray:
        """Hash of every run of ``n`` words."""
        s, e = self.starts[: len(self.starts) - n + 1], self.ends[n - 1 :]
        return _mixed((self.sums[e] - self.sums[s]) * self.down[s])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in every run of ``width`` values."""
    at, best, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[:-step]), have + step
    return at


def segments(words: list[bytes], window: int, gram: int) -> list[tuple]:
    """(anchor hash, content hash, first window, last window, first windows of further places or None) of a document's distinct segments."""
    places: dict[tuple[int, int], list[int]] = {}
    for at in range(0, len(words) - window + 1, STRETCH):
        text = Hashed(words[at : at + STRETCH + window - 1])
        grams = text.runs(gram)
        anchor = least_of(grams, window - gram + 1)
        cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        low, high = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]]) - 1
        hashes = grams[anchor[low]].view(np.int64).tolist()
        begin, end = text.starts[low].tolist(), text.ends[high + window - 1].tolist()
        content = [xxhash.xxh3_64_intdigest(text.text[b:e]) for b, e in zip(begin, end)]
        for h, c, a, b in zip(hashes, np.array(content, np.uint64).view(np.int64).tolist(), (low + at).tolist(), (high + at).tolist()):
            held = places.get((h, c))
            if held is None:
                places[h, c] = [b, a]
            else:
                held.append(a)
    return [(h, c, held[1], held[0], held[2:] or None) for (h, c), held in places.items()]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def _segment_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    names = ["doc_id", "row", "h", "content", "low", "high", "more"]
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc, row, *s) for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)) for s in segments(_words(text), window, gram)]
            yield _batch(rows, names, types)

    return docs.where("doc_id is not null").select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, h long, content long, low int, high int, more array<int>")


def _passages(held: DataFrame, window: int) -> DataFrame:
    """h, content, doc_id, text and window hashes of the segments listed for every document in ``held`` (text, doc_id, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = []
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(text)
                for s in wanted:
                    own = words[s["low"] : s["high"] + window]
                    rows.append((s["h"], s["content"], doc, b" ".join(own), Hashed(own).runs(window).view(np.int64)))
            yield _batch(rows, ["h", "content", "doc_id", "words", "hashes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())])

    return held.mapInArrow(run, "h long, content long, doc_id long, words binary, hashes array<long>")


def _trimmed(segs: DataFrame, window: int) -> DataFrame:
    """h, content, doc_id, low (within the segment), passage (hash), words: the runs of shared windows of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for h, content, doc, words, places in zip(*(c.to_pylist() for c in batch.columns)):
                words, places = words.split(), np.unique(places)
                cuts = np.flatnonzero(np.diff(places) > 1) + 1
                for part in np.split(places, cuts):
                    own = b" ".join(words[part[0] : part[-1] + window])
                    rows.append((h, content, doc, int(part[0]), int(np.uint64(xxhash.xxh3_64_intdigest(own)).astype(np.int64)), own))
            yield _batch(rows, ["h", "content", "doc_id", "low", "passage", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    return segs.mapInArrow(run, "h long, content long, doc_id long, low int, passage long, words binary")


def _automata(tiles: DataFrame, window: int) -> DataFrame:
    """h, passage, low, high: windows of each streamed passage that a reference passage of a smaller id holds. Input in order of tile and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, doc, automaton, waiting = None, None, None, []
        for batch in batches:
            rows = []
            for h, i, j, own, passage, refers, streams, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, i, j) != tile:
                    tile, doc, automaton, waiting = (h, i, j), None, Automaton(), []
                if own != doc:
                    for words in waiting:
                        automaton.add(words)
                    doc, waiting = own, []
                words = raw.split()
                if streams:
                    ends = [k - window + 1 for k, n in enumerate(automaton.matches(words)) if n >= window]
                    for part in np.split(np.array(ends, int), np.flatnonzero(np.diff(ends) > 1) + 1) if ends else []:
                        rows.append((h, passage, int(part[0]), int(part[-1])))
                if refers:
                    waiting.append(words)
            yield _batch(rows, ["h", "passage", "low", "high"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    order = ["h", "i", "j", "doc_id", "passage"]
    tiles = tiles.repartition("h", "i", "j").sortWithinPartitions(*order)
    return tiles.select("h", "i", "j", "doc_id", "passage", "refers", "streams", "words").mapInArrow(run, "h long, passage long, low int, high int")


def repeated_windows(docs: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """doc_id, row, low, high, more: ranges of windows (numbers of their first words) that also start in a document with a smaller id.

    ``more`` has the first windows of further ranges of the same length.

    ``docs`` has doc_id, row (any number that tells rows of equal id apart) and text.
    """
    segs = saved(_segment_rows(docs, window, min(gram, window)), "segments")
    # keys to join with are written first: a join of two tables is split where a key is hot, one with an aggregate beside it isn't
    several = saved(segs.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"), "several")
    segs = saved(segs.join(several, "h"), "shared")
    first = segs.groupBy("h", "content").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "row", "low", "high")).alias("at"))
    first = saved(first, "contents")
    repeats = segs.join(first.select("h", "content", "least"), ["h", "content"]).where("doc_id > least").select("doc_id", "row", "low", "high", "more")

    unlike = saved(first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "unlike")
    wanted = first.join(unlike, "h").groupBy("at.doc_id", "at.row").agg(F.collect_list(F.struct("h", "content", "at.low", "at.high")).alias("wanted"))
    held = saved(_passages(docs.join(wanted, ["doc_id", "row"]).select("doc_id", "text", "wanted"), window), "held")
    windows = held.select("h", "content", "doc_id", F.posexplode("hashes").alias("place", "w"))
    twice = saved(windows.groupBy("h", "w").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h", "w"), "twice")
    places = windows.join(twice, ["h", "w"]).groupBy("h", "content").agg(F.collect_list("place").alias("places"))
    parts = saved(_trimmed(held.join(places, ["h", "content"]).select("h", "content", "doc_id", "words", "places"), window), "passages")
    unique = saved(parts.groupBy("h", "passage").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words")), "unique")
    number = saved(unique.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "numbers")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    dealt = unique.join(number, "h").withColumn("own", F.pmod("passage", chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    role = lambda i, j, refers, streams: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(refers).alias("refers"), F.lit(streams).alias("streams"))
    roles = F.when(F.col("own") == F.col("other"), F.array(role("own", "own", True, True))).otherwise(F.array(role("own", "other", True, False), role("other", "own", False, True)))
    tiles = dealt.select("h", "doc_id", "passage", "words", F.explode(roles).alias("r")).select("h", "doc_id", "passage", "words", "r.*")
    found = saved(_automata(tiles, window), "matches")

    # back from passages to segments to documents; a passage's first holder has what the automata found, the others all of it
    size = F.size(F.split(F.col("words").cast("string"), " "))
    owned = parts.join(unique.select("h", "passage", F.col("doc_id").alias("least")), ["h", "passage"])
    whole = owned.where("doc_id > least").select("h", "content", "low", (F.col("low") + size - window).alias("high"))
    some = owned.where("doc_id = least").withColumnRenamed("low", "from").join(found, ["h", "passage"]).select("h", "content", (F.col("from") + F.col("low")).alias("low"), (F.col("from") + F.col("high")).alias("high"))
    cut = whole.unionByName(some).select("h", "content", F.col("low").alias("x"), F.col("high").alias("y"))
    holders = segs.join(first.select("h", "content", "least"), ["h", "content"]).where("doc_id = least")
    inside = holders.join(cut, ["h", "content"]).select("doc_id", "row", (F.col("low") + F.col("x")).alias("low"), (F.col("low") + F.col("y")).alias("high"), F.expr("transform(more, m -> m + x)").alias("more"))
    return repeats.unionByName(inside)


def remove_repeats(docs: DataFrame, window: int = 50, layout: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, n_removed, spans (first and last word of every maximal removed run) and rest of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are judged on the
    input. ``layout`` keeps the white space of what stays; without it the kept words are joined by one space. A text without removals
    comes back as it was where ``layout`` is set. Null texts have no words and stay null with ``layout``, else become empty. Rows
    with a null id neither repeat others nor are repeated. Rows of equal id do not repeat each other. ``rest`` is a struct of the
    other columns, whatever their names, and is missing where there are none. An empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest).withColumn("row", F.xxhash64("text"))
    path = scratch_path(docs.sparkSession, "ranges")
    with scope(docs.sparkSession):
        ranges = repeated_windows(rows.select("doc_id", "row", "text"), window).distinct().groupBy("doc_id", "row").agg(F.collect_list(F.struct("low", "high", "more")).alias("ranges"))
        ranges = saved(ranges, path=path)
    names = ["doc_id", "text", "n_words", "n_removed", "spans"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in range(3))):
                words = _words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                for r in ranges or []:
                    for low in [r["low"], *(r["more"] or [])]:
                        gone[low] += 1
                        gone[low + r["high"] - r["low"] + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
                if not layout:
                    text = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if spans else words).decode()
                elif spans:
                    text = _cut(text.encode(), spans).decode()
                out.append((doc, text, len(words), int(gone.sum()), spans))
            done = _batch(out, names, types)
            yield pa.RecordBatch.from_arrays([*done.columns, *batch.columns[3:]], [*names, *["rest"] * (batch.num_columns - 3)])

    joined = rows.join(ranges, ["doc_id", "row"], "left").select("doc_id", "text", "ranges", *[c for c in ["rest"] if rest])
    schema = "doc_id long, text string, n_words long, n_removed long, spans array<struct<first: long, last: long>>"
    if rest:
        schema = StructType.fromDDL(schema).add(joined.schema["rest"])
    return joined.mapInArrow(run, schema)


def _cut(raw: bytes, spans: list[dict]) -> bytes:
    """``raw`` without the words of ``spans`` and the white space before each of them."""
    codes = np.frombuffer(raw, np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    parts, at = [], 0
    for s in spans:
        parts.append(raw[at : int(ends[s["first"] - 1]) if s["first"] else 0])
        at = int(ends[s["last"]])
    return b"".join([*parts, raw[at:]])
