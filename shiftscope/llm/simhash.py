"""Near-duplicate documents by SimHash with pivot distance tables.

Fingerprints of 64 bits link where at most ``RADIUS`` bits differ. For every distinct fingerprint the Hamming distances to sixteen
reference fingerprints are computed once. By the triangle inequality two linked fingerprints differ by at most the radius in each of
these coordinates, so a pair is discarded by its largest coordinate difference, and the survivors are verified bit by bit.

Pairs are looked for only where they can link: fingerprints are cut into six blocks, three bits change at most three blocks, so linked
ones agree on three whole blocks and meet under one of twenty keys. Exact copies are one fingerprint. Under one key a task keeps the
links that join something new, never all pairs; a key with more than ``TILE`` fingerprints is dealt to tiles, pairs of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shiftscope.llm.common import place, saved, scope, slices, unused
from shiftscope.llm.components import connected
from shiftscope.session import scratch_path

RADIUS = 3
#: First bit and number of bits of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TILE = 1024
PIVOTS = 16
SEED = 42


def pivots() -> list[int]:
    """Reference fingerprints as signed 64-bit numbers: hashes of their numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(bytes([k]), SEED)).astype(np.int64)) for k in range(PIVOTS)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all word shingles of a text; fewer words are one shingle, no words none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, cut at ASCII white space
    if not words:
        return np.empty(0, "<u8")
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), "<u8", len(grams))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is set if it is set in over half of the hashes of the word shingles, repeats included; no words: 0."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    if len(hashes) == 0:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, as distinct rising hashes, are at least ``least`` similar (shared by all), exactly."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == 0 or len(b) / len(a) < least:
        return len(a) == 0
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return shared / (len(a) + len(b) - shared) >= least


def _linked(x: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, sketch: np.ndarray | None = None, sets: list[np.ndarray] | None = None, least: float = 0.0) -> np.ndarray:
    """Which of the pairs (a, b) link: pivot coordinates first, then the bits of those that are left, then their sketches and sets if there are any."""
    near = np.abs(table[a] - table[b]).max(axis=1) <= radius
    near[near] = np.bitwise_count(x[a[near]] ^ x[b[near]]) <= radius
    if sketch is not None and near.any():
        p, q = sketch[a[near]], sketch[b[near]]
        near[near] = ((p == q) & (p > 0)).sum(axis=1) >= (least - SLACK) * ((p > 0) | (q > 0)).sum(axis=1)
        near[near] = [alike(sets[i], sets[j], least) for i, j in zip(a[near].tolist(), b[near].tolist())]
    return near


def _joins(x: np.ndarray, table: np.ndarray, radius: int, sketch: np.ndarray | None = None, sets: list[np.ndarray] | None = None, least: float = 0.0, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of one run that connect all of its components, at most ``len(x) - 1``. Rows are in order of the first coordinate; those of one root are together already."""
    label, out = np.arange(len(x)) if root is None else np.unique(root, return_inverse=True)[1], []
    end = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(len(x)):
        other = np.arange(i + 1, end[i])
        other = other[label[other] != label[i]]
        if len(other) == 0:
            continue
        other = other[_linked(x, table, np.full(len(other), i), other, radius, sketch, sets, least)]
        found, first = np.unique(label[other], return_index=True)
        out += [(i, int(j)) for j in other[first]]
        label[np.isin(label, found)] = label[i]
    return out


def pivot_halves() -> list[F.Column]:
    """Distances of a fingerprint to the pivots, one byte each, in two longs."""
    distance = [F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    return [sum((F.shiftleft(d, 8 * k) for k, d in enumerate(distance[at : at + 8])), F.lit(0).cast("long")) for at in (0, 8)]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect all that are reachable by steps of at most ``radius`` bits.

    ``radius`` may be 0 to 3: the six blocks prove no more.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    fp = F.col("fingerprint")
    halves = pivot_halves()

    def key(number: int, blocks) -> F.Column:
        mask = sum(((1 << n) - 1) << first for first, n in blocks)
        return F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(int(np.uint64(mask).astype(np.int64)))))

    keys = F.array(*[key(n, blocks) for n, blocks in enumerate(combinations(BLOCKS, 3))])
    rows = saved(prints.where(fp.isNotNull()).select("fingerprint").distinct().select(fp.alias("node"), fp, halves[0].alias("t0"), halves[1].alias("t1")), "pivots")
    return _links_under(rows.withColumn("key", F.explode(keys)), radius)


def _links_under(rows: DataFrame, radius: int, least: float = 0.0) -> DataFrame:
    """Links (u, v) of nodes that meet under a key and link, enough to connect them.

    ``rows``: key, node, fingerprint, t0, t1 (pivot distances as bytes) and, if similarity counts too, sketch, set and root.
    """
    sketched = "sketch" in rows.columns
    kept = ["node", "fingerprint", "t0", "t1", *["sketch", "set", "root"] * sketched]
    shared = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    rows = rows.join(shared, "key")
    first = F.col("t0").bitwiseAND(F.lit(255))

    def edges(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        node = rows["node"].to_numpy()
        x = rows["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
        table = np.ascontiguousarray(np.stack([rows["t0"].to_numpy(), rows["t1"].to_numpy()], axis=1).astype("<i8")).view(np.uint8).reshape(-1, PIVOTS).astype(np.int16)
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), "<u2").reshape(len(x), -1) if sketched else None
        sets = [np.frombuffer(h, "<u8") for h in rows["set"].to_pylist()] if sketched else None
        root = rows["root"].to_numpy() if sketched else None
        size = ends - starts
        two = starts[size == 2]  # most runs
        if sketched:
            two = two[root[two] != root[two + 1]]
        hit = two[_linked(x, table, two, two + 1, radius, sketch, sets, least)] if len(two) else two
        pairs = [(int(a), int(a) + 1) for a in hit]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            pairs += [(s + a, s + b) for a, b in _joins(x[s:e], table[s:e], radius, sketch[s:e] if sketched else None, sets[s:e] if sketched else None, least, root[s:e] if sketched else None)]
        a, b = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["u", "v"])

    return _in_tiles(rows, kept, first, edges)


def _in_tiles(rows: DataFrame, kept: list[str], first: F.Column, edges) -> DataFrame:
    """Links (u, v) that ``edges`` (rows, first and last + 1 of every run) finds in the runs of rows under one key, of which there are ``n``, dealt to tiles."""
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    met = rows.select("key", *kept, own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *kept)

    def cut_up(rows: pa.Table) -> pa.RecordBatch:
        k, i, j = (rows[c].to_numpy() for c in ("key", "i", "j"))
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        return edges(rows, np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            k, i, j = (held[c].to_numpy() for c in ("key", "i", "j"))
            same = np.flatnonzero((k != k[-1]) | (i != i[-1]) | (j != j[-1])) if len(k) else []
            if len(same):  # the last run may go on in the next batch
                cut = int(same[-1]) + 1
                yield cut_up(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield cut_up(held.combine_chunks())

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", first).mapInArrow(run, "u long, v long")


#: Bins of a similarity sketch, and of the values that make its keys: BANDS keys of ROWS values each.
SKETCH, COARSE, BANDS, ROWS = 256, 32, 8, 3
#: A similarity is estimated from 256 bins, with a standard error of 0.025 at 0.8; five of them less, and the sets are compared.
SLACK = 0.125
#: Bits in which fingerprints of five-word shingles of similarity 0.8 differ, three standard deviations above the mean of about ten.
WIDE = 18


def _least_by_bin(hashes: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hash of every bin, whether it has one); ``hashes`` rise, and the first bits are the bin."""
    edge = np.searchsorted(hashes, np.arange(bins, dtype=np.uint64) << np.uint64(64 - (bins - 1).bit_length()))
    full = np.diff(np.append(edge, len(hashes))) > 0
    return hashes[np.minimum(edge, len(hashes) - 1)], full


def number_of(hashes: np.ndarray) -> int:
    """Number of a shingle set, from distinct rising hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def sketch_of(hashes: np.ndarray) -> tuple[int, bytes, list[int]]:
    """(number of the shingle set, sketch, keys) of distinct rising hashes: sets of high similarity agree in most bins and in some key."""
    number = number_of(hashes)
    if len(hashes) == 0:
        return number, bytes(2 * SKETCH), [number]
    least, full = _least_by_bin(hashes, SKETCH)
    sketch = np.where(full, 1 + (least % np.uint64(65535)), 0).astype("<u2")
    value, full = _least_by_bin(hashes, COARSE)
    at = np.arange(COARSE)
    step = (np.flatnonzero(full)[None, :] - at[:, None]) % COARSE  # an empty bin takes the value of the next full one
    value = value[(at + step.min(axis=1)) % COARSE] + step.min(axis=1).astype(np.uint64)
    keys = [int(np.uint64(xxhash.xxh3_64_intdigest(bytes([b]) + value[b * ROWS : (b + 1) * ROWS].tobytes())).astype(np.int64)) for b in range(BANDS)]
    return number, sketch.tobytes(), keys


def _sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """node, set (rising hashes as bytes) of ``nodes``, from the texts: most sets are never needed, so none are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([number_of(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "set"])

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "node long, set binary")
    return found.join(saved(nodes.distinct(), "wanted"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


#: Bytes of the parity bits of a set, and how many sets have a shingle that goes to the end of the order; so many such shingles at most.
PARITY, COMMON, COMMONS = 64, 256, 200_000
#: Bytes of the bits that pairs are held against before they take their sets along; they tell sets of up to some 18,000 shingles apart.
WIDE_PARITY = 1024


def _first_of(least: float, n: int) -> int:
    """Shingles from the front of a set of n: two sets at least ``least`` similar share one of theirs, whatever the order of all shingles."""
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def _parity(hashes: np.ndarray, size: int = PARITY) -> bytes:
    """Bits that each shingle flips one of: two sets differ in at least as many shingles as in bits."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (8 * size - 1), minlength=8 * size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _may_be_alike(a: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, root: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs of rows (a, b) aren't together yet and can be ``least`` similar, by bounds that lose none."""
    total, eps = n[a] + n[b], 1e-6
    need = least / (1 + least) * total - eps  # shared shingles
    left = np.minimum(n[a] - at[a], n[b] - at[b])
    near = (root[a] != root[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - eps) & (left >= need)
    near[near] = np.bitwise_count(bits[a[near]] ^ bits[b[near]]).sum(axis=1) <= total[near] - 2 * need[near]
    return near


def _prefix_links(docs: DataFrame, roots: DataFrame, shingle: int, least: float, text_col: str) -> DataFrame:
    """All links (u, v) between sets that ``roots`` (node, root) doesn't hold together yet: none is missed, and all are compared exactly.

    The first shingles of a set, in one order of all shingles, are its keys: similar sets share one. The order is that of the hashes, but
    the commonest shingles come last, so that few sets have them as keys. Which ones these are changes the work, never the result.
    """
    spark, texts = docs.sparkSession, docs.select(F.col(f"`{text_col}`").alias("text"))
    pairs_path, links_path = place(spark, "pairs"), place(spark, "links")

    def prefixes(common: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = []
                for text in batch.column(0).to_pylist():
                    hashes = np.unique(shingle_hashes(text, shingle))
                    if len(hashes):
                        late = np.isin(hashes, common) if len(common) else np.zeros(len(hashes), bool)
                        first = np.concatenate([hashes[~late], hashes[late]])[: _first_of(least, len(hashes))]
                        rows.append((number_of(hashes), len(hashes), _parity(hashes), first.view("<i8")))
                columns = list(zip(*rows)) or [(), (), (), ()]
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "n_own", "bits", "first"])

        return texts.mapInArrow(run, "node long, n_own long, bits binary, first array<long>")

    def candidates(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        node, root, n, at = (rows[c].to_numpy() for c in ("node", "root", "n_own", "at"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), "<u8").reshape(len(node), -1)
        size = ends - starts
        pairs = [(two := starts[size == 2], two + 1)]
        pairs[0] = tuple(p[_may_be_alike(two, n, at, bits, root, two + 1, least)] for p in pairs[0])
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            last = s + np.searchsorted(n[s:e], n[s:e] / least + 1e-6, side="right")
            for i in range(s, e - 1):  # rows rise in size
                b = np.arange(i + 1, last[i - s])
                a = np.full(len(b), i)
                near = _may_be_alike(a, n, at, bits, root, b, least)
                pairs.append((a[near], b[near]))
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        both = np.unique(np.stack([u, v], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["u", "v"])

    with scope(spark):
        counts = prefixes(np.empty(0, np.uint64)).select(F.explode("first").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON)
        common = [r.key for r in counts.orderBy(F.desc("n"), "key").limit(COMMONS).collect()]
        rows = prefixes(np.array(common, np.int64).view(np.uint64))
        rows = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n_own", "bits", "first")])
        rows = saved(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        # keys travel with numbers only; what shares one with another group takes its bits along
        keyed = rows.select("node", "root", F.posexplode("first").alias("at", "key"))
        under = Window.partitionBy("key")
        met = keyed.withColumns({"a": F.min("root").over(under), "b": F.max("root").over(under), "n": F.count(F.lit(1)).over(under)}).where("a < b")
        met = saved(met.select("key", "node", "at", "n"), "met")
        placed = met.join(rows.select("node", "root", "n_own", "bits"), "node")
        pairs = saved(_in_tiles(placed, ["node", "root", "n_own", "bits", "at"], F.col("n_own"), candidates).distinct(), path=pairs_path)

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [np.frombuffer(h, "<u8") for h in batch["set"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([len(h) for h in hashes], pa.int64()), pa.array([_parity(h, WIDE_PARITY) for h in hashes], pa.binary())], ["node", "n", "bits"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("a", "b"))
            total = batch["m"].to_numpy() + batch["n"].to_numpy()
            keep = np.bitwise_count(a ^ b).sum(axis=1) <= total - 2 * (least / (1 + least) * total - 1e-6)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = ([np.frombuffer(h, "<u8") for h in batch[c].to_pylist()] for c in ("a", "b"))
            yield batch.select(["u", "v"]).filter(pa.array([alike(x, y, least) for x, y in zip(a, b)], pa.bool_()))

    with scope(spark):
        sets = saved(_sets_of(docs, pairs.select(F.explode(F.array("u", "v")).alias("node")), shingle, text_col), "sets")
        # sets are long: first a bound that loses no pair
        wide = saved(sets.mapInArrow(widened, "node long, n long, bits binary"), "wide")
        one, other = wide.select(F.col("node").alias("u"), F.col("n").alias("m"), F.col("bits").alias("a")), wide.select(F.col("node").alias("v"), "n", F.col("bits").alias("b"))
        pairs = saved(pairs.join(one, "u").join(other, "v").select("u", "v", "m", "n", "a", "b").mapInArrow(near, "u long, v long"), "near")
        left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
        links = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compared, "u long, v long")
        return saved(links, path=links_path)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (number of the shingle set), component_id: groups of documents whose shingle sets are at least ``similarity`` alike.

    Three differing bits tell only copies that are all but exact. Here sets that meet under keys of their least hashes are linked first: pivot
    distances, ``radius`` bits and a sketch of 256 bins discard pairs, and the sets of what is left are compared. That finds most links
    and keeps large groups of copies from making all pairs. The links it misses come from the first shingles of all sets
    (``_prefix_links``), so the groups are exactly the components of similarity ``similarity`` and more. Nulls, repeats and empty texts as in
    ``near_duplicates``.
    """
    fp = F.col("fingerprint")
    names, types = ["doc_id", "node", "fingerprint", "sketch", "keys"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = np.unique(shingle_hashes(text, shingle))  # repeats out: the bits follow the similarity of sets
                number, sketch, keys = sketch_of(hashes)
                rows.append((doc, number, fingerprint_of(hashes), sketch, keys))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = saved(rows.mapInArrow(run, "doc_id long, node long, fingerprint long, sketch binary, keys array<long>"), "sketches")
    # equal sets are one node with one fingerprint
    nodes = rows.groupBy("node").agg(F.first(fp).alias("fingerprint"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    halves = pivot_halves()
    nodes = saved(nodes.select("node", fp, halves[0].alias("t0"), halves[1].alias("t1"), "sketch", "keys"), "nodes")
    # sketches and sets are long: only sets that meet one of another group take theirs along. Most copies meet under the first key
    spark, edges, roots = docs.sparkSession, None, None
    for bands in (F.col("band") == 0, F.col("band") > 0):
        links_path, roots_path = place(spark, "edges"), place(spark, "roots")
        with scope(spark):
            keyed = nodes.select("node", F.posexplode("keys").alias("band", "key")).where(bands).drop("band")
            keyed = keyed.withColumn("root", F.col("node")) if roots is None else keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            ends = Window.partitionBy("key")
            meeting = keyed.withColumns({"a": F.min("root").over(ends), "b": F.max("root").over(ends)}).where("a < b")
            meeting = saved(meeting.select("node", "root", "key"), "meeting")
            sets = saved(_sets_of(docs, meeting.select("node"), shingle, text_col), "sets")
            found = saved(_links_under(meeting.join(nodes.drop("keys"), "node").join(sets, "node"), radius, similarity), path=links_path)
            edges = found if edges is None else edges.unionByName(found)
            roots = saved(connected(edges), path=roots_path)
    # most groups are whole by now; all pairs of sets of different groups that can still link are looked at
    edges = edges.unionByName(_prefix_links(docs, roots, shingle, similarity, text_col))
    return _named(rows.select("doc_id", F.col("node").alias("fingerprint")), edges)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id of every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits, its own included. Texts without words, null
    texts among them, have fingerprint 0 and link like any other. A null doc_id is linked but never names a component, unless all
    of its members are null. Repeated rows come back as often as they are given; an empty table gives no rows.
    """
    prints = saved(fingerprints(docs, shingle, id_col, text_col), "prints")
    return _named(prints, links(prints, radius))


def _named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id from documents' fingerprints and the links between these."""
    roots = saved(connected(edges), "roots")
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = least.join(roots, least.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = saved(named, "named")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(component, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have a similar one of smaller id in reach (``similar_documents``); all columns as they were.

    Rows of equal id are one document and stay together. Rows with a null id stay where their whole group has none.
    """
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "groups")
    with scope(spark):
        found = saved(similar_documents(docs, shingle, similarity, id_col=id_col, text_col=text_col), path=path)
    own, same = unused(docs, "own_id"), unused(docs, "own_set")
    ids = found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    named = docs.where(id_.isNotNull()).join(ids.hint("merge"), id_ == F.col(own), "left_semi")
    nameless = found.where("component_id is null").select(F.col("fingerprint").alias(same)).distinct()
    if nameless.isEmpty():
        return named
    rest = docs.where(id_.isNull())
    texts = rest.select(F.xxhash64(text).alias(own), text.alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [sketch_of(np.unique(shingle_hashes(t, shingle)))[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.int64())], [own, same])

    kept = texts.mapInArrow(run, f"{own} long, {same} long").join(nameless, same, "left_semi").select(own)
    return named.unionByName(rest.join(kept, F.xxhash64(text) == F.col(own), "left_semi"))
