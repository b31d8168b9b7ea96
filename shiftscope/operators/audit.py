"""Run records and their tamper-evident log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.functions.ordered import positions

# fixed values: hash before the first entry, events that record a run
GENESIS = "0" * 64
RUN_EVENTS = ("run_recorded", "run_baselined")
DIGEST_BLOCK = 1024


def canonical(*cols: str) -> Column:
    """Compact JSON of the columns in name order, NULLs kept, text in UTF-8."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def query_number(query_id: Column) -> Column:
    """Q10 comes after Q2."""
    return F.regexp_extract(query_id, r"(\d+)$", 1).try_cast("bigint")


def run_digests(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """(run_id, digest, queries) over a run and all its queries.

    Every query is hashed on its own, then blocks of up to DIGEST_BLOCK neighbours, then the run with its block hashes. So a
    run with very many queries is hashed by many tasks and only short block hashes meet.
    """
    number = query_number(F.col("query_id"))
    hashed = queries.select("run_id", number.alias("no"), F.sha2(canonical("query_id", "sql_executed", "row_count", "error"), 256).alias("h"))
    # names without a number are spread over many blocks by their hash
    block = F.coalesce(F.floor(F.col("no") / DIGEST_BLOCK), -1 - F.pmod(F.xxhash64("h"), F.lit(1 << 20))).alias("block")
    blocks = hashed.groupBy("run_id", block).agg(
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "h"))), lambda x: x["h"]), ","), 256).alias("h"), F.count("*").alias("n")
    )
    per_run = blocks.groupBy("run_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), ",").alias("blocks"), F.sum("n").alias("queries")
    )
    joined = runs.join(per_run, "run_id", "left")
    text = F.concat_ws("|", canonical("run_id", "question", "dataset", "status", "report", "created_at"), F.coalesce("blocks", F.lit("")))
    return joined.select("run_id", F.sha2(text, 256).alias("digest"), F.coalesce("queries", F.lit(0)).alias("queries"))


ENTRY = ("chain", "seq", "event", "run_id", "payload", "at")


def link(entry_digest: str, before: str) -> str:
    return hashlib.sha256((before + entry_digest).encode()).hexdigest()


def append_chain(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Give new entries (chain, event, run_id, payload, at, order_no) their seq, prev_hash and hash.

    ``heads`` (chain, seq, hash) are the newest entries already logged. Linking is serial inside a chain by nature; what
    a task walks through is one short digest per entry, streamed in order, and different chains run in parallel.
    """
    rows = positions(entries, ["chain"], "order_no", out="_pos")
    if heads is not None:
        rows = rows.join(heads.select("chain", F.col("seq").alias("_seq"), F.col("hash").alias("_head")), "chain", "left")
    else:
        rows = rows.withColumns({"_seq": F.lit(None).cast("bigint"), "_head": F.lit(None).cast("string")})
    rows = rows.withColumns({"seq": F.coalesce("_seq", F.lit(0)) + F.col("_pos"), "_head": F.coalesce("_head", F.lit(GENESIS))})
    rows = rows.withColumn("_digest", F.sha2(canonical(*ENTRY), 256))
    kind = entries.schema["chain"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, before = None, GENESIS
        for batch in batches:
            prev, made = [], []
            for c, digest, head in zip(batch["chain"], batch["_digest"], batch["_head"]):
                if c != chain:
                    chain, before = c, head
                prev.append(before)
                before = link(digest, before)
                made.append(before)
            yield pd.DataFrame({"chain": batch["chain"], "seq": batch["seq"], "prev_hash": prev, "hash": made})

    short = rows.select("chain", "seq", "_digest", "_head").repartition("chain").sortWithinPartitions("chain", "seq")
    hashes = short.mapInPandas(walk, f"chain {kind}, seq bigint, prev_hash string, hash string")
    return rows.select(*ENTRY).join(hashes, ["chain", "seq"]).select(*ENTRY, "prev_hash", "hash")


def chain_heads(log: DataFrame) -> DataFrame:
    newest = log.groupBy("chain").agg(F.max(F.struct("seq", "hash")).alias("h"))
    return newest.select("chain", "h.seq", "h.hash")


def verify_chain(log: DataFrame) -> DataFrame:
    """(chain, seq, problem) of entries that were altered, removed or moved.

    An entry meets its predecessor in an equi-join on (chain, seq), so one long chain is checked by all tasks.
    """
    before = log.select("chain", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    joined = log.join(before, ["chain", "seq"], "left")
    expected_prev = F.coalesce("_before", F.when(F.col("seq") == 1, F.lit(GENESIS)))
    digest = F.sha2(canonical(*ENTRY), 256)
    expected = F.sha2(F.concat(F.col("prev_hash"), digest), 256)
    good = F.col("prev_hash").eqNullSafe(expected_prev) & F.col("hash").eqNullSafe(expected)
    return joined.where(~good).select("chain", "seq", F.lit("entry altered, removed or out of order").alias("problem"))


def verify_runs(log: DataFrame, digests: DataFrame) -> DataFrame:
    """(run_id, problem): recorded runs that are gone or changed, and runs nobody recorded. payload holds the digest."""
    logged = log.where(F.col("event").isin(*RUN_EVENTS)).select("run_id", F.col("payload").alias("logged"))
    now = digests.select("run_id", F.col("digest").alias("current"))
    checked = logged.join(now, "run_id", "left")
    problem = F.when(F.col("current").isNull(), "run deleted").when(F.col("current") != F.col("logged"), "run changed after it was recorded")
    found = checked.select("run_id", problem.alias("problem")).where(F.col("problem").isNotNull())
    unlogged = now.join(logged, "run_id", "left_anti").select("run_id", F.lit("run has no log entry").alias("problem"))
    return found.unionByName(unlogged)


def audit_summary(log: DataFrame, chain_problems: DataFrame, run_problems: DataFrame) -> DataFrame:
    """One row: intact, entries, problems."""
    count = lambda df: df.agg(F.count("*").alias("n")).select("n").scalar()
    problems = count(chain_problems) + count(run_problems)
    return log.agg(F.count("*").alias("entries")).select((problems == 0).alias("intact"), "entries", problems.alias("problems"))


def baseline_runs(runs: DataFrame, digests: DataFrame, log: DataFrame, chain: str, order_no: str) -> DataFrame:
    """Log entries for runs without one (repeating it adds nothing). ``order_no`` is a numeric creation order."""
    missing = runs.join(log.where(F.col("event").isin(*RUN_EVENTS)).select("run_id"), "run_id", "left_anti")
    entries = missing.join(digests.select("run_id", "digest"), "run_id").select(
        F.col(chain).alias("chain"), F.lit("run_baselined").alias("event"), "run_id", F.col("digest").alias("payload"),
        F.col("created_at").cast("string").alias("at"), F.col(order_no).alias("order_no"),
    )
    return append_chain(entries, chain_heads(log))


# ---------------------------------------------------------------- listings
def newest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit)


def newest_entries(log: DataFrame, limit: int = 50) -> DataFrame:
    """The last entries of every chain, newest first; each task keeps its own last ones before the shuffle."""
    last = Window.partitionBy("chain").orderBy(F.col("seq").desc())
    return log.withColumn("place", F.row_number().over(last)).where(F.col("place") <= limit).drop("place").orderBy("chain", F.col("seq").desc())


def queries_of(queries: DataFrame, run_id) -> DataFrame:
    return queries.where(F.col("run_id") == run_id).orderBy(query_number(F.col("query_id")))


def feedback_rows(feedback: DataFrame) -> DataFrame:
    """Accepted feedback; ratings outside -1..1 are rejected."""
    return feedback.where(F.col("rating").between(-1, 1))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs of each dataset; each task keeps its own newest before the shuffle."""
    newest = Window.partitionBy("dataset").orderBy(F.col("created_at").desc(), "run_id")
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)


def cached_answer(runs: DataFrame, now: Column, look_back: int = 5) -> DataFrame:
    """Per question hash the newest 'ok' run that has not expired, among its ``look_back`` newest runs."""
    newest = Window.partitionBy("question_hash").orderBy(F.col("created_at").desc(), "run_id")
    rows = runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= look_back)
    usable = rows.where((F.col("status") == "ok") & (F.col("expires_at") > now))
    return usable.withColumn("pick", F.row_number().over(newest)).where(F.col("pick") == 1).drop("pick", "place")
