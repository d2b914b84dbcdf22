"""Registered queries against DuckDB. All of them run through ``python -m checks.compare``."""

import os

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import check, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("window_forecast", "session_spine", "episodes", "targets", "compromise_onsets", "feat_hosts_ports", "feat_entropy",
          "feat_new_ports", "feat_beacon", "network_states", "split_lofo", "scaler_fit", "avg_precision_documents",
          "per_capture_metrics", "sustained_policy", "lead_time", "rollout_risk", "packet_statistics", "read_argus",
          "countermeasures", "stream_new_pairs")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    ok, note = check(spark, duck, name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_entry_points():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
