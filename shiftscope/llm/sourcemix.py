"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the mix by their weights, none beyond ``most`` times its own; the excess goes to the others. Within a source every
document is expected in so many copies that its words meet the target, in proportion to a weight of its own if it has one, never
beyond ``most``. The whole part of that number is certain. The rest is a chance p, and documents are drawn by Pareto order sampling: with u
uniform from a hash of the document, they are ranked by (u / (1 - u)) / (p / (1 - p)) and taken from the smallest rank on. The sample is
of fixed size in words: it ends where the next document would pass the target; what is then still short, which only matters in
a small source or after a very long document, goes in the same order to documents that fit, and last to one that passes the target by
less than what is short.

Ranks are running sums over range partitions, so one source may hold any share of all documents, and texts never move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shiftscope.functions.ordered import positions, running_sums
from shiftscope.llm.common import saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Rounds of filling end where every source is this near to its target, or nothing fits any more.
NEAR = 0.001
SEED = 42


def water_levels(items: DataFrame, group: list[str], total: str) -> DataFrame:
    """group, level: least(cap, level * weight) sums to ``total`` over the items (group, weight, cap, total) of a group.

    As long as some item is above its cap, it gets its cap and the others share what is left by weight.
    """
    level, settled = None, -1
    while True:
        if level is None:
            over = items.withColumn("over", F.lit(False))
        else:
            same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group]
            of = level.select(*[F.col(g).alias(f"of_{g}") for g in group], "level")
            joined = items.join(of, same) if group else items.withColumn("level", F.lit(level.first()["level"]))
            over = joined.withColumn("over", F.col("level") * F.col("weight") > F.col("cap"))
        capped = over.groupBy(*group) if group else over.groupBy()
        sums = saved(capped.agg(
            F.sum(F.col("over").cast("long")).alias("n"), F.first(total).alias("total"),
            F.coalesce(F.sum(F.when(F.col("over"), F.col("cap"))), F.lit(0)).cast("double").alias("capped"),
            F.coalesce(F.sum(F.when(~F.col("over"), F.col("weight"))), F.lit(0)).cast("double").alias("open")), "levels")
        count = sums.agg(F.sum("n")).first()[0] or 0
        # where all items are capped, any high level will do; where nothing weighs anything, none gets a share
        value = F.when(F.col("open") > 0, (F.col("total") - F.col("capped")) / F.col("open")).when(F.col("n") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
        level = sums.select(*group, value.alias("level"))
        if count == settled:
            return level
        settled = count


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target (double) from (source, source_size): weights repeat in order of the sources' code points, null last."""
    placed = saved(positions(sources.withColumn("none", F.col("source").isNull().cast("int")), [], "none", ["source"], "place"), "places")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    total = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    items = placed.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"), F.lit(total).alias("total"))
    level = water_levels(items, [], "total").first()
    return items.select("source", "source_size", F.least("cap", F.lit(level["level"] if level else 0.0) * F.col("weight")).alias("target"))


def _uniform(seed: int, *columns: str) -> Column:
    """Above 0 and below 1."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, weight: str | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs``.

    ``size`` is the number of words (null text: none), ``taken`` is ``copies`` times ``size``; no document gets more than ``most`` copies. ``weight`` is
    an SQL expression: a document's expected copies are in proportion to it (null or negative: none). Sources count as text, a null source is a
    source of its own. Rows without words get the certain copies of their source, which are no words, and take part in no draw. Rows
    that are equal in id, source and size are drawn one by one, and how many of them are taken is the same in any run. Null
    ids are ids. Other columns, whatever their names, play no part. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.greatest(F.coalesce(F.expr(weight).cast("double") if weight else F.lit(1.0), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"), own.alias("own"))
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()), "sizes")  # numbers are fixed once written
    return drawn(rows, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), most, seed)


def _numbered(rows: DataFrame) -> DataFrame:
    """``copy``: the place of a row among those equal to it, so that they are drawn one by one."""
    same = ["doc_id", "source", "size", "own"]
    often = saved(rows.groupBy(*same).count().where("count > 1").drop("count"), "often")
    if often.isEmpty():
        return rows.withColumn("copy", F.lit(1).cast("long"))
    of = often.select(*[F.col(c).alias(f"of_{c}") for c in same])
    equal = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in same]
    repeated = positions(rows.join(of, equal, "left_semi"), same, "at", out="copy")
    return rows.join(of, equal, "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(repeated)


def drawn(rows: DataFrame, sources: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix of ``rows`` (doc_id, source, size, own, at: a number of its own) for ``sources`` (source, source_size, target)."""
    sources = saved(sources, "targets").withColumnRenamed("source", "of_source")
    rows = _numbered(rows).join(sources, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rows = saved(rows, "rows")
    items = rows.select("source", (F.col("own") * F.col("size")).alias("weight"), (most * F.col("size")).cast("double").alias("cap"), F.col("target").alias("total"))
    level = saved(water_levels(items, ["source"], "total"), "level").withColumnRenamed("source", "of_source")
    expected = F.least(F.lit(float(most)), F.when(F.col("own") > 0, F.col("level") * F.col("own")).otherwise(0.0))
    chance = F.col("expected") - F.col("certain")
    u = _uniform(seed, "doc_id", "size", "copy")
    rows = (rows.join(level, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source").withColumn("expected", expected).withColumn("certain", F.floor("expected"))
            .withColumn("rank", F.when((chance > 0) & (F.col("size") > 0), u / (1 - u) / (chance / (1 - chance)))).drop("level", "own"))
    rows = saved(rows, "ranks")
    # words each source is short of
    short = saved(rows.groupBy("source", "target").agg((F.col("target") - F.sum(F.col("certain") * F.col("size"))).alias("short")), "short")
    open_, taken = rows.where("rank is not null").select("doc_id", "source", "size", "copy", "rank", "at"), []
    while True:
        of = short.select(F.col("source").alias("of_source"), "short")
        near = open_.join(of, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        ranked = running_sums(near.where("size <= short"), ["source"], "rank", {"upto": F.col("size")}, ["doc_id", "size", "copy"])
        new = saved(ranked.where("upto <= short").select("at", "source", "size"), "drawn")
        if new.isEmpty():  # nothing fits: one document a source that passes the target, if that is nearer
            best = near.where("size < 2 * short").groupBy("source").agg(F.min(F.struct("size", "rank", "doc_id", "copy", "at")).alias("best"))
            taken.append(best.select("best.at"))
            break
        taken.append(new.select("at"))
        gained = new.groupBy(F.col("source").alias("of_source")).agg(F.sum("size").alias("gained"))
        short = short.join(gained, F.col("source").eqNullSafe(F.col("of_source")), "left").select("source", "target", (F.col("short") - F.coalesce("gained", F.lit(0))).alias("short"))
        short = saved(short.where(F.col("short") > NEAR * F.col("target")), "short")
        if short.isEmpty():
            break
        # the sources still short, with what has not been taken
        of = short.select(F.col("source").alias("of_source"))
        left = open_.join(of, F.col("source").eqNullSafe(F.col("of_source")), "left_semi")
        open_ = saved(left.join(new.select(F.col("at").alias("new_at")), F.col("at") == F.col("new_at"), "left_anti"), "open")
    taken = reduce(DataFrame.unionByName, taken)
    out = rows.join(taken.withColumn("more", F.lit(1)), "at", "left").withColumn("copies", F.col("certain") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
