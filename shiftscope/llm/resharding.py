"""Resharding by minimum-cost flow: the fewest bytes leave their shard, and every new shard is filled to its capacity.

Rows are grouped by a hash of their text to blocks, so equal texts travel together. The driver sees the bytes and rows of the blocks, at
most about three times ``BLOCKS`` numbers whatever the data. A flow from old shards to new capacities, where staying is free and a
moved byte has a price, says how many bytes go where; blocks are then chosen, largest first, to fill these amounts. A block with
more rows than usual is dealt by id to cells, so no task holds it alone, and one with over half a shard's bytes travels in cells.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BLOCKS = 8192
#: Rows of a cell, at least, before a block is cut.
CELL = 32
FILE_BYTES = 128 << 20


def transfers(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Bytes from every old to every new shard at least cost, by successive shortest paths with potentials.

    ``sum(supply) <= sum(capacity)``; ``cost[i][j]`` is the price of a byte from i to j, not negative.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than there is")
    n, m = len(supply), len(capacity)
    flow, left, room, price = [[0] * m for _ in range(n)], list(supply), list(capacity), [0] * (n + m)
    while any(left):
        far = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came: list = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            steps = ((n + j, cost[v][j]) for j in range(m)) if v < n else ((i, -cost[i][v - n]) for i in range(n) if flow[i][v - n])
            for w, c in steps:
                new = d + c + price[v] - price[w]
                if new < far[w]:
                    far[w], came[w] = new, v
                    heapq.heappush(heap, (new, w))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: far[v] + price[v])
        for v in range(n + m):
            price[v] += min(far[v], far[end])
        way = [end]
        while came[way[-1]] is not None:
            way.append(came[way[-1]])
        way.reverse()
        amount = min([left[way[0]], room[end - n], *(flow[w][v - n] for v, w in zip(way, way[1:]) if v >= n)])
        for v, w in zip(way, way[1:]):
            if v < n:
                flow[v][w - n] += amount
            else:
                flow[w][v - n] -= amount
        left[way[0]] -= amount
        room[end - n] -= amount
    return flow


def chosen(units: list[tuple], flow: list[list[int]]) -> dict:
    """New shard of every unit (name, old shard, bytes): large ones first, each to where its old shard still owes most.

    What one old shard leaves over or short at a new shard is made up by the next.
    """
    out, over = {}, [0] * len(flow[0])
    by_old = defaultdict(list)
    for name, old, size in units:
        by_old[old].append((size, name))
    for old in sorted(by_old):
        owed = [a - b if a else -b for a, b in zip(flow[old], over)]
        for size, name in sorted(by_old[old], key=lambda u: (-u[0], u[1])):
            to = max(range(len(owed)), key=lambda j: (owed[j], j == old, -j))
            out[name] = to
            owed[to] -= size
        over = [-x for x in owed]
    return out


def reshard(docs: DataFrame, new: int = 8, old: int = 5, old_shard: str | None = None, blocks: int = BLOCKS, capacity: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, size, old_shard, shard, slot of every row of ``docs``.

    ``size`` is the UTF-8 length of the text (null: none) plus 1. ``capacity`` defaults to equal shares of all bytes. ``old_shard`` is a SQL
    expression for the shard (0 up to ``old`` - 1) a row is in now; without one the rows lie by a hash of their text. Slots number the
    rows of a shard from 0 without gaps. Null and repeated ids are rows like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int").alias("hash"),
                       (F.expr(old_shard) if old_shard else F.pmod(F.xxhash64(text), F.lit(old))).cast("int").alias("old_shard"))
    rows = rows.withColumn("block", F.col("hash") * old + F.col("old_shard")).drop("hash") if old_shard else rows.withColumnRenamed("hash", "block")
    if not old_shard:
        rows = rows.withColumn("old_shard", F.pmod("block", F.lit(old)).cast("int"))
    sums = rows.groupBy("block", "old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    total, usual = sum(r.bytes for r in sums), max(CELL, 2 * -(-sum(r.n for r in sums) // blocks))
    share = capacity or [total // new + (j < total % new) for j in range(new)]
    cuts = spark.createDataFrame([(r.block, -(-r.n // usual)) for r in sums if r.n > usual], "block int, cuts int")
    rows = rows.join(F.broadcast(cuts), "block", "left").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    cells = rows.groupBy("block", "cell", "old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    heavy = {r.block for r in sums if 2 * r.bytes > min(share)}
    name = lambda r: (r.block, r.cell) if r.block in heavy else (r.block, -1)
    size: dict = defaultdict(int)
    for r in cells:
        size[name(r), r.old_shard] += r.bytes
    supply = [sum(b for (_, o), b in size.items() if o == i) for i in range(old)]
    flow = transfers(supply, share, [[int(i != j) for j in range(new)] for i in range(old)])
    to = chosen([(u, o, b) for (u, o), b in size.items()], flow) if total else {}
    plan, used = [], [0] * new
    for r in sorted(cells, key=lambda r: (r.block, r.cell)):
        shard = to[name(r)]
        plan.append((r.block, r.cell, shard, used[shard]))
        used[shard] += r.n
    # one row for each cell, at most about three times the number of blocks
    plan = spark.createDataFrame(plan, "block int, cell int, shard int, first long")
    files = max(-(-max(share) // FILE_BYTES), -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // new))
    placed = rows.join(F.broadcast(plan), ["block", "cell"]).withColumn("file", F.pmod(F.xxhash64("block", "cell"), F.lit(files)).cast("int"))
    order = Window.partitionBy("shard", "file", "block", "cell").orderBy("doc_id", F.xxhash64("text"))
    placed = placed.repartition(new * files, "shard", "file").withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
    return placed.select("doc_id", "text", "size", "old_shard", "shard", "slot")


def rewrite(placed: DataFrame, path: str) -> DataFrame:
    """Write the shards that gain or lose rows below ``path`` as a new version, leaving other shards' files alone; returns what is there now.

    A manifest says which version of a shard counts, and a shard that is not in it is gone. It is written last, so a job that dies
    before leaves the old state whole. ``outdated`` lists what may be deleted.
    """
    spark = placed.sparkSession
    pairs = [tuple(r) for r in placed.select("old_shard", "shard").distinct().collect()]  # at most old shards times new ones
    moved = {s for pair in pairs if pair[0] != pair[1] for s in pair}
    stays = {s for _, s in pairs}
    known = current(spark, path)
    new = max(known.values(), default=-1) + 1
    touched = [s for s in stays if s not in known or s in moved]
    placed.where(F.col("shard").isin(touched)).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows/version={new}")
    manifest = [(s, new if s in touched else known[s]) for s in sorted(stays)]
    spark.createDataFrame(manifest, "shard int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={new}")
    return read_shards(spark, path, placed.schema)


def current(spark: SparkSession, path: str) -> dict[int, int]:
    """Version of every shard, from the newest manifest; empty where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return {}
    rows = spark.read.schema("shard int, version int, number int").parquet(f"{path}/manifest")
    newest = rows.agg(F.max("number")).first()[0]
    return {r.shard: r.version for r in rows.where(F.col("number") == newest).collect()}


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all shards as they are now; only the folders the manifest names are read."""
    versions = defaultdict(list)
    for shard, version in current(spark, path).items():
        versions[version].append(shard)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", IntegerType())])).parquet(f"{path}/rows")
    live = reduce(lambda a, b: a | b, [(F.col("version") == v) & F.col("shard").isin(s) for v, s in versions.items()])
    return rows.where(live).drop("version")


def outdated(spark: SparkSession, path: str) -> list[str]:
    """Folders below ``path`` that the newest manifest doesn't name."""
    live = {f"version={v}/shard={s}" for s, v in current(spark, path).items()}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/version=*/shard=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    folders = ["/".join(f.getPath().toString().split("/")[-2:]) for f in found]
    return sorted(f"{path}/rows/{f}" for f in folders if f not in live)
