"""Queries on events where every window is attacked, so that no negative and no quiet window is left, against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.catalog import ORACLES, QUERIES
from checks.compare import check, connect
from netloom.operators import calibration as ca
from netloom.operators import ranking as rk

SF = "/root/testdata/sf0.001"
ATTACKED = ("early_warning_threshold", "conformal_threshold", "coverage_report", "evaluation_report", "two_level_report")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def attacked(tmp_path_factory):
    """Three events an hour of every capture for 30 days, each an attack of stage 2 or more."""
    folder = tmp_path_factory.mktemp("attacked")
    duckdb.connect().execute(f"""copy (select i as event_id, timestamp '2024-01-01' + interval (i * 4) minute as ts,
      i % 5 as user_id, 'error' as event_type, 200 + i % 7 as value, '{{"k": ' || i % 50 || '}}' as props
      from (select 6 * i + 1 + i % 5 as i from range(1800) r(i))) to '{folder}/events.parquet' (format parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ATTACKED)
def test_attacked_windows_match_sql(spark, attacked, name):
    ok, note = check(spark, connect(attacked), name, QUERIES[name], ORACLES[name], attacked)
    assert ok and not note.startswith("0 rows"), note


def test_forecast_of_attacked_windows(spark, attacked):
    assert QUERIES["forecast_timeline"](spark, attacked).filter("level = 1").count() == 0


def test_packet_block_merge_matches_sql(spark):
    ok, note = check(spark, connect(SF), "packet_block_merge", QUERIES["packet_block_merge"], ORACLES["packet_block_merge"], SF)
    assert ok, note


def test_quantiles_of_nothing(spark):
    none = spark.range(3).select(F.lit(None).cast("double").alias("v"), F.lit("a").alias("k"))
    row = rk.quantiles(none, [], "v", [0.1, 0.5]).first()
    assert (row["n"], row["q"]) == (0, [None, None])
    assert rk.quantiles(none, ["k"], "v", [0.5]).count() == 0
    empty = spark.createDataFrame([], "score double, y boolean, split string, valid boolean, is_quiet boolean")
    row = ca.early_warning_threshold(empty, 0.05, "score").first()
    assert (row["n"], row["threshold"]) == (0, None)
