"""A query of every area against its oracle (python -m checks.compare runs all of them)."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection

SAMPLE = [
    "A3_key_audit", "A5_parse_documents", "B6_all_dimensions", "B13_mix_rate_segments", "B15_top_candidates", "B20_explain_change", "C5_fact_order_items",
    "D8_orders_mom", "E4_growth_accounting", "F3_proportion_statistic", "G2_scenario_summary", "H4_worsen_reviews", "I20_top_states_by_payment", "J1_daily_series",
    "J4_robust_anomalies", "J15_binary_metrics", "K6_iou_pairs", "L1_chunk_text", "L4_bm25_scores", "L8_hybrid_search", "M4_order_state", "M3_land_events_stream",
    "M13_kalman_stream", "M17_daily_metrics_stream", "N1_run_digest", "N3_verify_chain", "N6_newest_entries", "N9_result_match", "C7_mart_counts", "A5_read_corpus", "O4_arrival_route_km",
]


@pytest.fixture(scope="module")
def con(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, sf, con, name):
    ok, message, _ = compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_every_oracle_binds(con):
    """DuckDB can plan the SQL of every query, also of those that only ``checks.compare`` runs."""
    bad = {}
    for name, sql in entry.oracle_sql().items():
        try:
            con.execute("explain " + sql)
        except Exception as e:
            bad[name] = str(e)[:300]
    assert not bad


def test_names_and_oracles_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
