"""Find numbers in an answer that no evidence value supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: what counts as a number, and the small counts that need no evidence
NUMBER = r"(?U)(?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?"
FREE_INTEGERS = range(0, 11)
FINEST = 8


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _value(raw: Column) -> Column:
    return F.regexp_replace(raw, "[,+]", "").try_cast("double")


def unsupported_numbers(answers: DataFrame, evidence: DataFrame, key: str, text: str) -> DataFrame:
    """(key, raw) of every number that matches no evidence number of the same answer at its written precision.

    answers(key, text); evidence(key, text). A match allows a missing sign and a percentage (x 100). Numbers meet
    their evidence in an equi-join on (key, decimals, rounded value): each evidence value offers every cell within the tolerance at each
    precision in use, so no answer pairs all its numbers with all its evidence. Cells are no finer than FINEST decimals, as the
    tolerance is never below 1e-9.
    """
    written = answers.select(key, F.posexplode(_numbers(F.col(text))).alias("no", "raw"))
    fraction = F.regexp_extract("raw", r"\.(\d+)$", 1)
    written = written.withColumns({"x": F.abs(_value(F.col("raw"))), "decimals": F.length(fraction)})
    scaled = lambda v: v * F.pow(F.lit(10.0), F.least(F.col("decimals"), F.lit(FINEST)))
    written = written.withColumn("grid", F.round(scaled(F.col("x"))))
    tolerance = lambda side: F.lit(0.5) * F.pow(F.lit(10.0), -F.col(f"{side}.decimals")) + 1e-9

    free = F.array(*[F.lit(float(i)) for i in FREE_INTEGERS])
    small = F.exists(free, lambda v: F.abs(F.col("w.x") - v) <= tolerance("w"))
    open_numbers = written.alias("w").where(~small)
    precisions = written.select(key, "decimals").distinct()
    values = evidence.select(key, F.explode(F.array_distinct(_numbers(F.col(text)))).alias("raw"))
    value = F.abs(_value(F.col("raw")))
    values = values.select(key, F.explode(F.array(value, value * 100)).alias("v")).where(F.col("v").isNotNull()).distinct()
    offered = values.join(precisions, key)
    # in cells: half of one, and what 1e-9 is of the finest
    reach = 0.6
    cells = F.sequence(F.floor(scaled(F.col("v")) - reach).cast("bigint"), F.ceil(scaled(F.col("v")) + reach).cast("bigint"))
    offered = offered.select(key, "decimals", "v", F.explode(cells).alias("grid")).withColumn("grid", F.col("grid").cast("double"))
    # up to FINEST decimals a number is its cell, so the closest value decides; beyond, every value of the cell is tried
    point = F.when(F.col("decimals") > FINEST, F.col("v"))
    centre = F.col("grid") * F.pow(F.lit(10.0), -F.least(F.col("decimals"), F.lit(FINEST)))
    closest = offered.withColumn("point", point).groupBy(key, "decimals", "grid", "point").agg(F.min_by("v", F.abs(F.col("v") - centre)).alias("v")).drop("point")
    same = [F.col(f"w.{c}") == F.col(f"c.{c}") for c in (key, "decimals", "grid")]
    met = same[0] & same[1] & same[2] & (F.abs(F.col("w.x") - F.col("c.v")) <= tolerance("w"))
    return open_numbers.alias("w").join(closest.alias("c"), met, "left_anti").select(key, "no", "raw")
