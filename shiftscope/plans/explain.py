"""The whole investigation as one tidy result: change, candidates, drill-down, data quality, documents, verdict."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from shiftscope.operators import change as C
from shiftscope.plans.metrics import DIMENSIONS, MetricSpec
from shiftscope.session import cut_lineage
from shiftscope.sources.tables import Shop

EVIDENCE = (
    "section string, place int, dimension string, segment string, value_a double, value_b double, change double, share_of_change double, note string"
)
STATUS = {"low": "insufficient_evidence", "no_significant_change": "no_significant_change"}


def _small(df: DataFrame) -> DataFrame:
    """A result of a few rows, computed once and kept as local data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@dataclass
class Investigation:
    """Intermediate frames of one metric, shared by the steps below."""

    spec: MetricSpec
    base: DataFrame
    segments: DataFrame
    dimensions: tuple[str, ...]
    change: DataFrame
    wide: DataFrame
    ranked: DataFrame
    candidates: DataFrame
    checks: DataFrame
    findings: DataFrame

    def top_candidate(self) -> Row | None:
        """The strongest business candidate; one row comes to the driver."""
        return self.candidates.orderBy(*C.candidate_order()).first()


def investigate(shop: Shop, spec: MetricSpec, dimensions: Sequence[str] = tuple(DIMENSIONS), keep: bool = True) -> Investigation:
    """Set up the frames. ``keep`` writes the reused ones to the shared folder once: values per order, segments per order, totals per segment.
    That keeps every later plan short and survives lost executors."""
    base = C.base_values(shop, spec)
    if keep:
        base = cut_lineage(base)
    segments = C.segment_rows(shop, dimensions, base)
    if keep:
        segments = cut_lineage(segments)
    change = _small(C.total_change(C.total_by_period(base), spec.kind))  # one row
    wide = C.pivot_periods(C.by_segment(base, segments, dimensions))
    if keep:
        wide = cut_lineage(wide)
    ranked = C.rank_segments(wide, spec.kind, change.select("delta").scalar())
    candidates = C.top_candidates(ranked)
    checks = C.duplicate_checks(shop, spec)
    return Investigation(spec, base, segments, tuple(dimensions), change, wide, ranked, candidates, checks, C.duplicate_findings(checks))


def drill_down(inv: Investigation, dimension: str, segment: str, keep: int = 3) -> DataFrame:
    """Inside one segment, the leading segment of every other dimension against its own inner change."""
    others = [d for d in inv.dimensions if d != dimension]
    inside = C.orders_in_segment(inv.base, inv.segments, dimension, segment)
    long = C.by_segment(inside, inv.segments.where(F.col("dimension") != dimension), others)
    wide = cut_lineage(C.pivot_periods(long))
    # one row per dimension
    inner = C.wide_change(wide, inv.spec.kind).select("dimension", F.col("delta").alias("inner_delta"))
    ranked = C.rank_segments(wide.join(F.broadcast(inner), "dimension"), inv.spec.kind, F.col("inner_delta"), ["dimension", "inner_delta"])
    lead = C.leading_segments(ranked, 1).where(F.col("segment") != C.NO_SEGMENT)
    return (
        lead.select("dimension", "segment", "value_a", "value_b", "share_of_change")
        .orderBy(F.abs("share_of_change").desc_nulls_last(), "dimension")
        .limit(keep)
    )


def explain_change(
    shop: Shop,
    spec: MetricSpec,
    dimensions: Sequence[str] = tuple(DIMENSIONS),
    documents: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    """Evidence rows (section, place, dimension, segment, value_a, value_b, change, share_of_change, note).

    ``documents`` may map a search text to hits (doc_id, title, score) which are added as supporting context.
    """
    inv = investigate(shop, spec, dimensions)
    # bounded results: at most three candidates per dimension, one finding per table, three drill-down rows
    candidates, findings = inv.candidates.orderBy(*C.candidate_order()).collect(), inv.findings.collect()
    local = shop.orders.sparkSession.createDataFrame
    verdict = C.confidence(inv.change, local(candidates, inv.candidates.schema), local(findings, inv.findings.schema)).first()[0]
    change = inv.change.first()
    findings.sort(key=lambda f: (-f["increase"], f["table_name"]))
    rows = [("change", 1, None, spec.name, change["value_a"], change["value_b"], change["delta"],
             None if change["pct_change"] is None else change["pct_change"] / 100, None)]
    leading = [("data_quality", f["table_name"], None, None, None, None) for f in findings]
    leading += [(c["dimension"], c["segment"], c["value_a"], c["value_b"], c["change"], c["share_of_change"]) for c in candidates]
    rows += [("candidate", i, *c, None) for i, c in enumerate(leading[:5], start=1)]
    rows += [("quality", i, "data_quality", f["table_name"], f["duplicate_rate_a"], f["duplicate_rate_b"], f["increase"], None, None)
             for i, f in enumerate(findings, start=1)]
    rows.append(("confidence", 1, None, verdict, None, None, None, None, STATUS.get(verdict, "ok")))
    text = spec.name
    if candidates:
        top = candidates[0]
        where, text = f"inside {top['dimension']}={top['segment']}", f"{spec.name} {top['dimension']} {top['segment']}"
        inner = drill_down(inv, top["dimension"], top["segment"]).collect()
        rows += [("drill_down", i, d["dimension"], d["segment"], d["value_a"], d["value_b"], d["value_b"] - d["value_a"], d["share_of_change"], where)
                 for i, d in enumerate(inner, start=1)]
    if documents is not None:
        rows += [("document", i, None, str(h["doc_id"]), None, None, None, h["score"], h["title"]) for i, h in enumerate(documents(text).collect(), start=1)]
    return local(rows, EVIDENCE)
