"""Score benchmark runs: result equality, hit ranks, summary, acceptance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.functions.ordered import positions
from shiftscope.functions.quantiles import exact_quantile
from shiftscope.operators.audit import query_number
from shiftscope.operators.text import normalize_cell, normalize_label

TOLERANCE = 1e-3
# fixed values: acceptance limits
LIMITS = (
    ("sql_accuracy_pct", ">=", 95.0),
    ("hit_at_1_pct", ">=", 85.0),
    ("refusal_pct", ">=", 100.0),
    ("unsupported_pct", "<=", 2.0),
)


def result_rows(df: DataFrame, question: Column, cells: list[Column]) -> DataFrame:
    """(question, cells): each row's cells in column order, a number or else a normalised label; a NULL cell has neither."""
    normal = F.array(*[normalize_cell(c) for c in cells])

    def cell(x: Column) -> Column:
        number = x.try_cast("double")
        return F.struct(number.alias("number"), F.when(number.isNull(), normalize_label(x)).alias("label"))

    return df.select(question.alias("question"), F.transform(normal, cell).alias("cells"))


def _columns(rows: DataFrame) -> DataFrame:
    """What is in every column of a question's result: NULLs, labels whatever their order, and the numbers' count, range and mean."""
    flat = rows.select("question", F.posexplode("cells").alias("col", "c"))
    label, number = F.col("c.label"), F.col("c.number")
    return flat.groupBy("question", "col").agg(
        F.count_if(label.isNull() & number.isNull()).alias("nulls"), F.count(label).alias("labels"), F.sum(F.xxhash64(label).cast("decimal(38,0)")).alias("hash"),
        F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"),
    )


def _close(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= F.greatest(F.lit(TOLERANCE), TOLERANCE * F.greatest(F.abs(x), F.abs(y)))


def _chosen_columns(gold: DataFrame, got: DataFrame) -> DataFrame:
    """(question, picks): for every gold column, in order, the answer's column that holds the same; the answer may have more columns."""
    a, b = _columns(gold).alias("a"), _columns(got).alias("b")
    same = F.col("a.question") == F.col("b.question")
    for c in ("nulls", "labels", "numbers"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    for c in ("low", "high", "mean"):
        same = same & ((F.col("a.numbers") == 0) | _close(F.col(f"a.{c}"), F.col(f"b.{c}")))
    same = same & ((F.col("a.labels") == 0) | (F.col("a.hash") == F.col("b.hash")))
    # an answer has few columns, so the lists below are short
    fits = a.join(b, same).groupBy(F.col("a.question").alias("question"), F.col("a.col").alias("col")).agg(F.array_sort(F.collect_set(F.col("b.col"))).alias("fits"))
    alike = Window.partitionBy("question", "fits").orderBy("col")
    placed = fits.withColumn("pick", F.try_element_at("fits", F.row_number().over(alike))).where("pick is not null")
    return placed.groupBy("question").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "pick"))), lambda p: p["pick"]).alias("picks"))


def result_match(gold: DataFrame, got: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(question, match): same number of rows, and every gold row has its own equal row among the answer's.

    The answer may have more columns, in any order: each gold column is paired with one of the same content first. Labels ignore case
    and separators, numbers agree within 1e-3 (relative or absolute), NULL equals only NULL. Rows with the same labels are paired
    in the order of their numbers. ``questions`` names those that may have no row on either side, which is a match.
    """
    picks = _chosen_columns(gold, got)
    width = gold.groupBy("question").agg(F.max(F.size("cells")).alias("width"))
    taken = got.join(picks.join(width, "question").where(F.size("picks") == F.col("width")), "question", "left")
    taken = taken.select("question", F.when(F.col("picks").isNotNull(), F.transform("picks", lambda c: F.get("cells", c))).alias("cells"))

    def placed(df: DataFrame, name: str) -> DataFrame:
        mark = lambda c: F.when(c["number"].isNotNull(), "#").otherwise(F.coalesce(F.concat(F.lit("="), c["label"]), F.lit("-")))
        numbers = F.transform(F.filter("cells", lambda c: c["number"].isNotNull()), lambda c: c["number"])
        rows = df.select("question", F.coalesce(F.array_join(F.transform("cells", mark), "|"), F.lit("?")).alias("labels"), numbers.alias("numbers"))
        lead = rows.withColumn("_lead", F.coalesce(F.try_element_at("numbers", F.lit(1)), F.lit(0.0)))
        out = positions(lead, ["question", "labels"], "_lead", ["numbers"])
        return out.select("question", "labels", "pos", F.col("numbers").alias(name))

    both = placed(gold, "a").join(placed(taken, "b"), ["question", "labels", "pos"], "full")
    same = (F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", lambda x, y: F.coalesce(_close(x, y), F.lit(False))), lambda ok: ok)
    found = both.groupBy("question").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("match"))
    if questions is None:
        return found
    return questions.select("question").distinct().join(found, "question", "left").select("question", F.coalesce("match", F.lit(True)).alias("match"))


def hit_rank(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(question, rank, hit_at_1, hit_at_3): where the expected (dimension, segment) stands among the candidates."""
    want = expected.select("question", F.col("dimension").alias("_d"), F.lower("segment").alias("_s"))
    seg = F.lower(F.col("segment").cast("string"))
    found = candidates.join(want, "question").where((F.col("dimension") == F.col("_d")) & (seg == F.col("_s")))
    best = found.groupBy("question").agg(F.min("rank").alias("rank"))
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    return want.select("question").join(best, "question", "left").select("question", "rank", hit(1).alias("hit_at_1"), hit(3).alias("hit_at_3"))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """One row of percentages, latency and cost from (category, correct, hit_at_1, hit_at_3, unsupported_numbers, duration_s, cost_usd)."""
    share = lambda cat, col: F.round(F.avg(F.when(F.col("category") == cat, F.col(col).cast("int"))) * 100, 1)
    main = results.agg(
        share("sql", "correct").alias("sql_accuracy_pct"), share("cause", "hit_at_1").alias("hit_at_1_pct"), share("cause", "hit_at_3").alias("hit_at_3_pct"),
        share("refusal", "correct").alias("refusal_pct"), F.round(F.avg((F.col("unsupported_numbers") > 0).cast("int")) * 100, 1).alias("unsupported_pct"),
        F.round(F.avg("duration_s"), 2).alias("avg_latency_s"), F.round(F.avg("cost_usd"), 6).alias("avg_cost_usd"), F.count("*").alias("questions"),
    )
    middle = F.lit(exact_quantile(results, "duration_s", 0.5)).cast("double")
    return main.withColumn("median_latency_s", F.round(middle, 2))


def threshold_gate(summary: DataFrame) -> DataFrame:
    """(measure, value, comparison, limit, pass, accepted): every limit and whether all hold."""
    rows = [
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.lit(op).alias("comparison"), F.lit(limit).alias("limit"),
                 F.coalesce(F.col(m) >= limit if op == ">=" else F.col(m) <= limit, F.lit(False)).alias("pass"))
        for m, op, limit in LIMITS
    ]
    listed = summary.select(F.array(*rows).alias("rows"))
    return listed.select(F.explode("rows").alias("r"), F.forall("rows", lambda r: r["pass"]).alias("accepted")).select("r.*", "accepted")


def merge_rerun(previous: DataFrame, rerun: DataFrame, key: str = "id") -> DataFrame:
    """The previous report with the re-run questions replaced."""
    return previous.join(rerun.select(key), key, "left_anti").unionByName(rerun)


def latest_answer(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """Per question the newest 'ok' run and its last query that succeeded."""
    newest = runs.where(F.col("status") == "ok").groupBy("question").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    good = queries.where(F.col("error").isNull() & F.col("sql_executed").isNotNull())
    last = good.groupBy("run_id").agg(F.max_by(F.struct("query_id", "sql_executed"), query_number(F.col("query_id"))).alias("q"))
    return newest.join(last, "run_id", "left").select("question", "run_id", "q.query_id", "q.sql_executed")
