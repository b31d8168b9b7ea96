"""Period-over-period change: measure, split by segment, rank by abnormal movement, check for repeated rows.

All functions are lazy DataFrame transformations. The unit is one row per order and period.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shiftscope.functions.numbers import pct_change, ratio, ratio_or_zero
from shiftscope.plans.metrics import DIMENSIONS, JOINS, MetricSpec, resolve_joins
from shiftscope.sources.tables import KEYS, Shop

NO_SEGMENT = "(none)"
MIN_DUPLICATE_INCREASE = 0.005


# ---------------------------------------------------------------- measuring
def _inside(col: Column, period: tuple[str, str]) -> Column:
    start, end = (F.lit(date.fromisoformat(d)) for d in period)
    return (col >= start) & (col < end)


def period_rows(shop: Shop, spec: MetricSpec) -> DataFrame:
    """Orders of either period under alias ``o`` with the column ``period``; B wins where periods overlap."""
    when = F.col(f"o.{spec.date_column}")
    in_a, in_b = _inside(when, spec.period_a), _inside(when, spec.period_b)
    orders = shop.orders.alias("o").where(in_a | in_b)
    if spec.order_filter:
        orders = orders.where(F.expr(spec.order_filter))
    return orders.withColumn("period", F.when(in_b, "B").otherwise("A")).alias("o")


def attach(df: DataFrame, shop: Shop, path: Sequence[str], how: str) -> DataFrame:
    """Join tables along a resolved path, each under its alias."""
    for name in path:
        alias, on, _ = JOINS[name]
        df = df.join(shop.table(name).alias(alias), F.expr(on), how)
    return df


def base_values(shop: Shop, spec: MetricSpec) -> DataFrame:
    """(order_id, period, v): the value of every order.

    Every expression is evaluated over the left-joined rows, so a repeated order counts as often as it is there, however the
    expression is spelt.
    """
    joined = attach(period_rows(shop, spec), shop, spec.path, "left")
    return joined.groupBy(F.col("o.order_id").alias("order_id"), "period").agg(F.expr(spec.order_value).alias("v"))


def total_by_period(base: DataFrame) -> DataFrame:
    return base.groupBy("period").agg(F.sum("v").alias("total"), F.count("v").alias("n"), F.count("*").alias("orders"))


# ---------------------------------------------------------------- segments
_FAMILIES = (("customers",), ("order_items", "sellers", "products"), ("order_payments",))


def segment_rows(shop: Shop, dimensions: Sequence[str], order_ids: DataFrame | None = None) -> DataFrame:
    """Distinct (order_id, dimension, segment) over the inner-join path of each dimension.

    Dimensions that share a child table are read in one scan of it; ``order_ids`` limits every scan up front.
    """
    parts = []
    for family in _FAMILIES:
        dims = [d for d in dimensions if DIMENSIONS[d][1][0] in family]
        if not dims:
            continue
        needed = resolve_joins([t for d in dims for t in DIMENSIONS[d][1]])
        root = "orders" if needed[0] == "customers" else needed[0]
        alias, lookups = ("o", needed) if root == "orders" else (JOINS[root][0], needed[1:])
        rows = shop.table(root)
        if order_ids is not None:
            rows = rows.join(order_ids.select("order_id"), "order_id", "left_semi")
        rows = attach(rows.alias(alias), shop, lookups, "left")
        picks = []
        for d in dims:
            sql, path = DIMENSIONS[d]
            # a left join kept rows whose lookup has no match; the path of a dimension is an inner join
            key = F.col(JOINS[path[-1]][1].split(" = ")[0])
            picks.append(F.when(key.isNotNull(), F.struct(F.lit(d).alias("dimension"), F.expr(sql).cast("string").alias("segment"))))
        rows = rows.select(F.col(f"{alias}.order_id").alias("order_id"), F.explode(F.array(*picks)).alias("pick"))
        parts.append(rows.where("pick is not null").select("order_id", "pick.dimension", "pick.segment"))
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def by_segment(base: DataFrame, segments: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, segment, period, total, n, orders); an order counts in every segment it has, or in '(none)'."""
    wanted = F.array(*[F.lit(d) for d in dimensions])
    own = segments.where(F.col("dimension").isin(*dimensions))
    matched = base.join(own.withColumn("segment", F.coalesce("segment", F.lit(NO_SEGMENT))), "order_id").select("dimension", "segment", "period", "v")
    # an order has at most one name for each dimension
    named = own.groupBy("order_id").agg(F.collect_set("dimension").alias("_named"))
    missing = F.array_except(wanted, F.coalesce("_named", F.array().cast("array<string>")))
    without = base.join(named, "order_id", "left").select(F.explode(missing).alias("dimension"), F.lit(NO_SEGMENT).alias("segment"), "period", "v")
    return (
        matched.unionByName(without).groupBy("dimension", "segment", "period")
        .agg(F.sum("v").alias("total"), F.count("v").alias("n"), F.count("*").alias("orders"))
    )


def orders_in_segment(base: DataFrame, segments: DataFrame, dimension: str, segment: str) -> DataFrame:
    """Keep the orders that have the segment in that dimension."""
    hit = segments.where((F.col("dimension") == dimension) & (F.col("segment") == segment)).select("order_id")
    return base.join(hit, "order_id", "left_semi")


# ---------------------------------------------------------------- A/B arithmetic
def pivot_periods(long: DataFrame, keys: Sequence[str] = ("dimension", "segment")) -> DataFrame:
    """Long to wide: total_a, total_b, n_a, n_b with missing or NULL as 0."""

    def side(col: str, period: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == period, F.col(col))), F.lit(0)).cast("double").alias(f"{col}_{period.lower()}")

    return long.groupBy(*keys).agg(side("total", "A"), side("total", "B"), side("n", "A"), side("n", "B"))


def period_change(df: DataFrame, value_a: str = "value_a", value_b: str = "value_b") -> DataFrame:
    """Add delta and pct_change."""
    a, b = F.col(value_a), F.col(value_b)
    return df.withColumn("delta", b - a).withColumn("pct_change", pct_change(a, b))


def total_change(totals: DataFrame, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """value_a, value_b, delta, pct_change of the whole metric (or of each key)."""
    return _change_of(pivot_periods(totals, keys), kind, keys)


def wide_change(wide: DataFrame, kind: str, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """value_a, value_b, delta, pct_change per key from the wide table."""
    sums = wide.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total_a", "total_b", "n_a", "n_b")])
    return _change_of(sums, kind, keys)


def _change_of(wide: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    if kind == "total":
        a, b = F.col("total_a"), F.col("total_b")
    else:
        a, b = ratio_or_zero(F.col("total_a"), F.col("n_a")), ratio_or_zero(F.col("total_b"), F.col("n_b"))
    return period_change(wide.select(*keys, a.alias("value_a"), b.alias("value_b")))


def _with_sums(df: DataFrame, key: Sequence[str], **sums: Column) -> DataFrame:
    """Add per-key sums: a grouped aggregate joined back, not a window that would gather a key in one task.

    The keys are dimension names, so the aggregate has one row per dimension and is safe to broadcast.
    """
    if not key:
        one = df.agg(*[v.alias(n) for n, v in sums.items()])
        return df.select("*", *[one.select(n).scalar().alias(n) for n in sums])
    per_key = df.groupBy(*key).agg(*[v.alias(n) for n, v in sums.items()])
    return df.join(F.broadcast(per_key), list(key))


def segment_contributions(wide: DataFrame, value_a: str, value_b: str, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """delta, share_of_change and pct_change of every segment."""
    out = period_change(wide, value_a, value_b)
    out = _with_sums(out, keys, _delta=F.sum("delta"))
    return out.withColumn("share_of_change", ratio_or_zero(F.col("delta"), F.col("_delta"))).drop("_delta")


def rank_abnormal_total(wide: DataFrame, overall_delta: Column, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """How far each segment moved beyond what its size in period A predicts."""
    delta = F.col("total_b") - F.col("total_a")
    sums = _with_sums(wide, keys, _a=F.sum("total_a"), _d=F.sum(delta))
    expected = ratio_or_zero(F.col("total_a"), F.col("_a")) * F.col("_d")
    return sums.select(
        *keys, "segment", F.col("total_a").alias("value_a"), F.col("total_b").alias("value_b"), delta.alias("delta"),
        expected.alias("expected_delta"), (delta - expected).alias("abnormal"),
        ratio_or_zero(delta - expected, overall_delta).alias("share_of_change"),
    )


def mix_rate_segments(wide: DataFrame, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """Split each segment's part in a ratio change into mix, rate and interaction effects."""
    sums = _with_sums(wide, keys, _na=F.sum("n_a"), _nb=F.sum("n_b"))
    parts = sums.select(
        *keys, "segment",
        ratio(F.col("n_a"), F.col("_na")).alias("weight_a"), ratio(F.col("n_b"), F.col("_nb")).alias("weight_b"),
        ratio_or_zero(F.col("total_a"), F.col("n_a")).alias("rate_a"), ratio_or_zero(F.col("total_b"), F.col("n_b")).alias("rate_b"),
    )
    shift, move = F.col("weight_b") - F.col("weight_a"), F.col("rate_b") - F.col("rate_a")
    effects = parts.withColumns(
        {"mix_effect": shift * F.col("rate_a"), "rate_effect": F.col("weight_a") * move, "interaction": shift * move}
    )
    return effects.withColumn("total_effect", F.col("mix_effect") + F.col("rate_effect") + F.col("interaction"))


def mix_rate_totals(wide: DataFrame, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """Overall rates, their difference and the three summed effects, per dimension."""
    rates = wide.groupBy(*keys).agg(
        ratio(F.sum("total_a"), F.sum("n_a")).alias("rate_a"), ratio(F.sum("total_b"), F.sum("n_b")).alias("rate_b")
    )
    effects = mix_rate_segments(wide, keys).groupBy(*keys).agg(
        F.sum("mix_effect").alias("mix_effect"), F.sum("rate_effect").alias("rate_effect"), F.sum("interaction").alias("interaction")
    )
    return rates.withColumn("delta", F.col("rate_b") - F.col("rate_a")).join(effects, list(keys))


def rank_abnormal_ratio(wide: DataFrame, overall_delta: Column, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """Abnormal change of a ratio: what the segment's own rate did, mix shifts left out."""
    parts = mix_rate_segments(wide, keys)
    abnormal = F.col("rate_effect") + F.col("interaction")
    return parts.select(
        *keys, "segment", F.col("rate_a").alias("value_a"), F.col("rate_b").alias("value_b"),
        (F.col("rate_b") - F.col("rate_a")).alias("delta"), F.col("mix_effect"), F.col("rate_effect"), F.col("interaction"),
        abnormal.alias("abnormal"), ratio_or_zero(abnormal, overall_delta).alias("share_of_change"),
    )


def rank_segments(wide: DataFrame, kind: str, overall_delta: Column, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    rank = rank_abnormal_total if kind == "total" else rank_abnormal_ratio
    cols = [*keys, "segment", "value_a", "value_b", "delta", "abnormal", "share_of_change"]
    return rank(wide, overall_delta, keys).select(*cols)


def leading_segments(ranked: DataFrame, k: int, keys: Sequence[str] = ("dimension",)) -> DataFrame:
    """The k most abnormal segments per dimension, with ``place`` 1..k.

    Spark prunes each task to its own k rows per dimension before the shuffle (window group limit).
    Rows sharing the top size are ordered by segment name.
    """
    order = Window.partitionBy(*keys).orderBy(F.abs("abnormal").desc_nulls_last(), "segment")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_candidates(ranked: DataFrame, per_dimension: int = 3) -> DataFrame:
    """Leading segments of every dimension without '(none)', rounded to 4 digits."""
    top = leading_segments(ranked, per_dimension).where(F.col("segment") != NO_SEGMENT)
    return top.select(
        "dimension", "segment", F.round("value_a", 4).alias("value_a"), F.round("value_b", 4).alias("value_b"),
        F.round("delta", 4).alias("change"), F.round("abnormal", 4).alias("abnormal_change"),
        F.round("share_of_change", 4).alias("share_of_change"),
    )


def candidate_order() -> list[Column]:
    """Total order of candidates: largest share first, then by name."""
    return [F.abs("share_of_change").desc_nulls_last(), F.col("dimension").asc(), F.col("segment").asc()]


# ---------------------------------------------------------------- data quality
def duplicate_check(shop: Shop, spec: MetricSpec, table: str) -> DataFrame | None:
    """(table_name, period, row_count, distinct_keys) of a table joined to the orders of both periods."""
    keys = KEYS[table]
    if not keys:
        return None
    when = F.col(f"o.{spec.date_column}")
    in_a, in_b = _inside(when, spec.period_a), _inside(when, spec.period_b)
    rows = shop.orders.alias("o").where(in_a | in_b)
    alias = "o"
    if table != "orders":
        alias = JOINS[table][0]
        rows = attach(rows, shop, resolve_joins([table]), "inner")
    period = F.when(in_b, "B").otherwise("A").alias("period")
    cols = [F.col(f"{alias}.{k}").alias(f"k{i}") for i, k in enumerate(keys)]
    # count per key first (NULL key parts form their own key), then per period
    per_key = rows.groupBy(period, *cols).agg(F.count("*").alias("n"))
    counted = per_key if len(keys) > 1 else per_key.withColumn("k0", F.col("k0"))
    distinct = F.count("*") if len(keys) > 1 else F.count("k0")
    return counted.groupBy("period").agg(F.sum("n").alias("row_count"), distinct.alias("distinct_keys")).select(
        F.lit(table).alias("table_name"), "period", "row_count", "distinct_keys"
    )


def duplicate_checks(shop: Shop, spec: MetricSpec, tables: Sequence[str] | None = None) -> DataFrame:
    """The check for every table the metric reads."""
    names = list(tables) if tables is not None else ["orders", *spec.path]
    parts = [duplicate_check(shop, spec, t) for t in names]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def duplicate_findings(checks: DataFrame, min_increase: float = MIN_DUPLICATE_INCREASE) -> DataFrame:
    """Tables whose share of repeated rows rose by more than ``min_increase``."""
    rate = ratio_or_zero(F.col("row_count") - F.col("distinct_keys"), F.col("row_count"))

    def side(period: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("period") == period, rate)), F.lit(0.0)).alias(f"duplicate_rate_{period.lower()}")

    wide = checks.groupBy("table_name").agg(side("A"), side("B"))
    grown = wide.withColumn("increase", F.col("duplicate_rate_b") - F.col("duplicate_rate_a"))
    return grown.where(F.col("increase") > min_increase)


def confidence(change: DataFrame, candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """One row with the verdict: data defects first, then the size of the change, then the best share."""
    n_findings = findings.agg(F.count("*").alias("n")).select("n").scalar()
    best = candidates.agg(F.max(F.abs("share_of_change")).alias("s")).select("s").scalar()
    verdict = (
        F.when(n_findings > 0, "high")
        .when(F.abs("pct_change") < 2, "no_significant_change")
        .when(best.isNull(), "low")
        .when(best >= 0.5, "high")
        .when(best >= 0.25, "medium")
        .otherwise("low")
    )
    return change.select(verdict.alias("confidence"))


def quality_override(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Data defects outrank business explanations: findings get priority 0, candidates 1."""
    defects = findings.select(
        F.lit(0).alias("priority"), F.lit("data_quality").alias("dimension"), F.col("table_name").alias("segment"),
        F.lit(None).cast("double").alias("share_of_change"), "duplicate_rate_b",
    )
    business = candidates.select(
        F.lit(1).alias("priority"), "dimension", "segment", "share_of_change", F.lit(None).cast("double").alias("duplicate_rate_b")
    )
    return defects.unionByName(business)


def conditional_pivot(df: DataFrame, segment: str, when: str, value: str, period_a: tuple[str, str], period_b: tuple[str, str]) -> DataFrame:
    """Segment x (sum in A, sum in B) in one pass over the rows."""
    col = F.col(when)
    return df.groupBy(F.col(segment).alias("segment")).agg(
        F.coalesce(F.sum(F.when(_inside(col, period_a), F.col(value))), F.lit(0)).alias("value_a"),
        F.coalesce(F.sum(F.when(_inside(col, period_b), F.col(value))), F.lit(0)).alias("value_b"),
    )
