"""Vector best-fit packing of tokenised documents into training sequences.

A bin has three capacities: tokens, number of pieces, and attention cost (the sum of squared piece lengths). Pieces are placed in
order of falling length into the open bin that fits on all three and scores best, by the smallest norm of what would be left or by
the largest weighted dot product of demand and residual.

Pieces are dealt by hash to groups of about ``group_bytes`` bytes of text; each group is packed in its own task, and all lengths
occur in every group, so only the last few sequences of a group stay open. Nothing depends on a key's frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shiftscope.llm.chunkcache import KEEP, TEXTS, encoder
from shiftscope.llm.common import groups_of, slices

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than ``most``."""
    first = n % most or most
    return [n] if n <= most else [first] + [most] * ((n - first) // most)


def best_fit(lengths: np.ndarray, tokens: int, pieces: int, cost: float, weights=(1.0, 1.0, 1.0), score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece. Ties between pieces keep their order, ties between bins go to the older bin.

    A piece that alone breaks a capacity still gets a bin of its own.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score is 'norm' or 'dot'")
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    scale = np.array([tokens, pieces, cost], float)
    w = np.asarray(weights, float)
    left, number, used = np.empty((64, 3)), np.empty(64, np.int64), 0
    made = 0
    floor = np.array([lengths.min(), 1, float(lengths.min()) ** 2]) / scale if n else None
    for k, at in enumerate(order):
        size = int(lengths[at])
        need = np.array([size, 1, float(size) * size]) / scale
        open_ = left[:used]
        fits = np.flatnonzero((open_ >= need - 1e-12).all(axis=1))
        if len(fits):
            rest = open_[fits] - need
            best = fits[int(np.argmin((w * rest * rest).sum(axis=1)) if score == "norm" else np.argmax((w * open_[fits] * need).sum(axis=1)))]
            bins[at], offsets[at] = number[best], tokens - round(left[best, 0] * tokens)
            left[best] -= need
        else:
            if used == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            bins[at] = made
            left[used], number[used] = 1 - need, made
            made, used = made + 1, used + 1
        if k % 128 == 127:  # forget the bins that not even the smallest piece fits
            keep = np.flatnonzero((left[:used] >= floor - 1e-12).all(axis=1))
            left[: len(keep)], number[: len(keep)], used = left[keep], number[keep], len(keep)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, max_tokens: int, id_col: str = "doc_id", text_col: str = "text", remember: int = KEEP) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every document (PIECES). A null text counts as empty; a null id stays null.

    ``ids`` has two bytes an id where the vocabulary allows, else four. Without ``end_id`` an empty document has no piece. A task
    remembers the ids of about ``remember`` pieces of text: fewer take less memory and more time, and batches get smaller with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remember)
        width, end = encode.dtype.itemsize, b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        for batch in slices(batches, max(1, min(TEXTS, remember * 1000 // KEEP))):
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                raw, start = raw + end, 0
                for piece, length in enumerate(cut_lengths(len(raw) // width, max_tokens) if raw else []):
                    rows.append((doc, piece, start, length, raw[start * width : (start + length) * width]))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None = None, max_tokens: int = 1024, max_pieces: int | None = None, max_cost: float | None = None,
    weights=(1.0, 1.0, 1.0), score: str = "norm", group_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", remember: int = KEEP,
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset: one row for each piece of each document.

    ``max_pieces`` and ``max_cost`` default to the largest values a full sequence can reach. Null texts are empty documents; null and
    repeated ids are documents like any other; an empty table gives no rows; further columns of ``docs`` are ignored. ``remember``: as in ``token_pieces``.
    """
    groups = groups_of(docs, text_col, group_bytes)
    most_pieces, most_cost = max_pieces or max_tokens, max_cost or float(max_tokens) ** 2

    def pack(key, rows):
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).combine_chunks()
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit(lengths, max_tokens, most_pieces, most_cost, weights, score)
        ids = [np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes() for raw, n in zip(rows["ids"].to_pylist(), lengths.tolist())]
        number = (int(key[0].as_py()) << 32) + bins
        return pa.table({**{c: rows[c] for c in ("doc_id", "piece", "start", "length")}, "ids": pa.array(ids, pa.binary()), "sequence_id": pa.array(number), "offset": pa.array(offsets)})

    pieces = token_pieces(docs, tokenizer, end_id, max_tokens, id_col, text_col, remember)
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(groups)).cast("int")).groupBy("group")
    return grouped.applyInArrow(pack, PIECES + ", sequence_id long, offset long")
