"""Registered panel queries against their DuckDB text on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from chronopanel.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each family; the driver compares all of them.
CHOSEN = """a02_vintage_json a03_company_facts a13_cumulative_append a14_replace_keys b05_clip b15_readiness_gate c01_pit_asof c03_strict_asof
c06_asof_tolerance c07_forward_asof c10_event_alignment c11_membership_mask c17_frame_diff c24_shared_items d16_population_stability d18_reliability
d22_price_anomalies e01_simple_return e07_beta e12_rolling_rank e16_time_to_high e25_surprise e29_peer_mean f06_stratified_sample g05_membership_rebuild
h02_issuer_name h10_strip_markup i01_snapshot_ingest i03_newest_wins i07_checkpointed_resume k01_walk_forward k02_group_kfold k17_selection_panel
k08_month_placebo k13_naive_baselines k16_platt_calibration l02_ic_summary l04_block_bootstrap_dm l11_sharpe_moments l12_backtest_overfit l13_factor_regression l14_rolling_exposure
l17_event_study m01_node_table m04_isolated""".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}"
    return str(v)[:19]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_a_spark_function():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_duckdb(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) or "" for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[names.index(c)]) or "" for c in order) for r in want.fetchall())
    assert a == b
