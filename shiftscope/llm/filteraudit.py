"""How filters interact: what each removes behind any others, from relations of failing ids.

Every filter has a stored table of the documents that fail it: their keys and part, never their texts. What a filter removes behind others
is its table left-anti joined with theirs; what it would have removed as well is redundant. The survivors of a sequence of filters depend on
the set of filters before, not on their order, so all prefixes come from one relation: before the anti-join with a filter's table
every row splits in one that has met the filter and one that hasn't, and only the former can be taken out. A left-semi join with good
or toxic ids at the start gives what is lost of these.

Keys are doc_id and a hash of the text, so rows that share an id are told apart; equal rows are one row with a count. One shuffle by key
serves all joins.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.llm.common import saved
from shiftscope.session import scratch_path

#: Filter that is a comparison of documents, not a condition on one: a text some smaller doc_id has as well.
REPEATED = "repeated"
KEY = ["id", "no_id", "hash"]


def conditions() -> dict[str, Column | str]:
    """Failure conditions on the columns text, words (array of words) and chars; in order of their letters."""
    n = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct("words")) < 80 * n,
        "C": 100 * capitals.cast("long") > 10 * F.col("chars"),
        "D": F.col("text").rlike("[#$%&*|]"),
        "E": REPEATED,
    }


def failing_ids(docs: DataFrame, filters: dict[str, Column | str], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(filter, id, no_id, hash, part, n: one stored table a filter; part, n: documents of every part).

    ``n`` counts equal rows. A null text is empty, a null part the empty string; a null id is no smaller id and has none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.coalesce(doc, F.lit(0)).alias("id"), doc.isNull().alias("no_id"), text.alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumns({"words": F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""), "chars": F.length("text")})
    own = {f: c for f, c in filters.items() if not isinstance(c, str)}
    failed = F.filter(F.array(*[F.when(c, F.lit(f)) for f, c in own.items()]), lambda f: f.isNotNull())
    # one row for each document, no text
    seen = saved(rows.select("id", "no_id", F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("digest"), "part", failed.alias("failed")), "verdicts")
    failing = seen.select(*KEY, "part", F.explode("failed").alias("filter"))
    for f in filters.keys() - own.keys():
        least = seen.where("not no_id").groupBy("digest").agg(F.min("id").alias("id"))  # the one document of equal texts that passes
        failing = failing.unionByName(seen.where("not no_id").join(least, ["digest", "id"], "left_anti").select(*KEY, "part", F.lit(f).alias("filter")))
    path = scratch_path(spark, "failing")
    # a row for each document and filter: equal rows are counted before they meet
    failing.groupBy("filter", *KEY, "part").agg(F.count(F.lit(1)).alias("n")).write.partitionBy("filter").parquet(path)
    tables = spark.read.schema("id long, no_id boolean, hash long, part string, n long, filter string").parquet(path)
    return tables, seen.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def removals(tables: DataFrame, filters: list[str], lost: dict[str, DataFrame]) -> DataFrame:
    """part, filter, before (bits of the filters applied first, the lowest for the first of ``filters``), measure, n for every filter, set of others and measure.

    Measures: "removed", and one for every entry of ``lost`` (tables of ids, column id): those of them that are removed.
    """
    table = {f: tables.where(F.col("filter") == f) for f in filters}
    seeds = tables.select(*KEY, "part", "n", "filter", F.lit("removed").alias("measure"))
    for name, ids in lost.items():
        hit = tables.where("not no_id").join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_semi")
        seeds = seeds.unionByName(hit.select(*KEY, "part", "n", "filter", F.lit(name).alias("measure")))
    rows = seeds.withColumn("before", F.lit(0))
    for bit, f in enumerate(filters):
        # with the filter before and without; a filter is not before itself
        both = F.when(F.col("filter") == f, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        met = rows.withColumn("met", F.explode(both))
        other = table[f].select(*[F.col(k).alias(f"o_{k}") for k in KEY])
        same = F.col("met") & (F.col("id") == F.col("o_id")) & (F.col("no_id") == F.col("o_no_id")) & (F.col("hash") == F.col("o_hash"))
        left = met.join(other, same, "left_anti")
        rows = left.withColumn("before", F.when(F.col("met"), F.col("before").bitwiseOR(1 << bit)).otherwise(F.col("before"))).drop("met")
    return rows.groupBy("part", "filter", "before", "measure").agg(F.sum("n").alias("n"))


def interactions(docs: DataFrame, labels: DataFrame | None = None, filters: dict[str, Column | str] | None = None, lost: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, shapley and one
    column of losses per entry of ``lost`` (a condition on ``labels``, whose ids are in ``id_col``).

    ``removed`` counts documents this step takes out, ``kept`` those left after it, ``redundant`` those that fail its filter but are gone
    already, ``unique_fails`` those that fail its filter and no other, ``shapley`` sums ``removed`` of its filter over all orders.
    ``filter_order`` joins the filters' names. Zeros are there; parts come from the documents, so an empty table gives no rows. Null texts
    are empty, a null part is the empty string, a null id has no labels and no equal text with a smaller id. Rows that
    share an id are rows of their own; labels hold for all of them, and a label given twice counts once.
    """
    spark = docs.sparkSession
    filters, lost = filters or conditions(), lost or {}
    names = list(filters)
    tables, totals = failing_ids(docs, filters, id_col, text_col, part_col)
    groups = {m: labels.where(c).select(F.col(f"`{id_col}`").alias("id")).distinct() for m, c in lost.items()}
    found = saved(removals(tables, names, groups), "removals")  # at most filters * sets * measures rows a part
    # all steps of all orders: a fixed number of rows
    steps = [("".join(order), i + 1, f, sum(1 << names.index(g) for g in order[:i])) for order in permutations(names) for i, f in enumerate(order)]
    steps = spark.createDataFrame([(k, *s) for k, s in enumerate(steps)], "k int, filter_order string, step int, filter string, before int")
    frame = totals.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factorial(len(names)) * len(names) - 1)))).join(F.broadcast(steps), "k")
    measures = ["removed", *lost]
    wide = found.groupBy("part", "filter", "before").agg(*[F.sum(F.when(F.col("measure") == m, F.col("n"))).alias(m) for m in measures])
    fails = found.where((F.col("measure") == "removed") & (F.col("before") == 0)).select("part", "filter", F.col("n").alias("fails"))
    alone = found.where((F.col("measure") == "removed") & (F.bit_count("before") == len(names) - 1)).select("part", "filter", F.col("n").alias("unique_fails"))
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), F.bit_count("before") + 1)
    shapley = found.where("measure = 'removed'").groupBy("part", "filter").agg(F.sum(F.col("n") * weight).alias("shapley"))
    out = frame.join(wide, ["part", "filter", "before"], "left")
    for more in (fails, alone, shapley):
        out = out.join(more, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select("part", "filter_order", "step", "filter", "n", *[zero(m).alias(m) for m in measures], zero("fails").alias("fails"), zero("unique_fails").alias("unique_fails"), zero("shapley").alias("shapley"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as filters
    out = out.withColumns({"kept": F.col("n") - F.sum("removed").over(so_far), "redundant": F.col("fails") - F.col("removed")})
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "shapley", *lost)
