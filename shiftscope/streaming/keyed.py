"""The rows of a key within a micro-batch in order, whatever their number.

A stateful processor gets the rows of a key in frames of bounded size, in no order. One frame is sorted in memory. Where there are more, rows
wait in a map of the key's RocksDB state, by blocks of ``WIDTH`` numbers of their order column, and come back block by block.

A call of a processor costs milliseconds, many times the work on the few rows a usual key has in a micro-batch. So a processor is called
for a bucket of keys: the state of a bucket is one value with the states of its keys by key.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Order numbers of a block. A block has as many rows unless numbers repeat.
WIDTH = 4096
PLACE, ROWS = "block bigint, part int", "rows binary"
HELD = "held binary"
#: Buckets of keys; fixed for the life of a checkpoint.
KEY_BUCKETS = 2048
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(frames: Iterator[pd.DataFrame], order: str, staged, width: int = WIDTH) -> Iterator[pd.DataFrame]:
    """Frames of all rows sorted by ``order`` (ties as they came); ``staged`` is a map state (PLACE, ROWS) that is empty before and after."""
    first, parts = next(frames, None), Counter()
    second = next(frames, None)
    if second is None:
        if first is not None:
            yield first.sort_values(order, kind="stable")
        return

    def put(frame: pd.DataFrame) -> None:
        for block, rows in frame.groupby(frame[order] // width, sort=False):
            staged.updateValue((int(block), parts[int(block)]), (pickle.dumps(rows),))
            parts[int(block)] += 1

    put(first)
    put(second)
    del first, second
    for frame in frames:
        put(frame)
    for block in sorted(parts):
        rows = [pickle.loads(staged.getValue((block, part))[0]) for part in range(parts[block])]
        yield pd.concat(rows).sort_values(order, kind="stable")
    staged.clear()


def key_bucket(key: str) -> Column:
    """The bucket of a key."""
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def load_states(state) -> dict:
    """The states of a bucket by key, from its value state (HELD)."""
    held = state.get()
    return pickle.loads(held[0]) if held else {}


def save_states(state, states: dict) -> None:
    state.update((pickle.dumps(states),))
