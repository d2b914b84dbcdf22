"""Steps that every build of the state table takes: flows stored once, blocks found by as many halvings as borders need."""

import os

import pytest
from pyspark.sql import functions as F

from netloom.operators.blocked import _at_most

SF = "/root/testdata/sf0.001"


def test_number_of_borders_below(spark):
    rows = [(list(range(0, 2 * n, 2)), x) for n in range(0, 35) for x in (-1, 0, n, 2 * n - 2, 2 * n)]
    df = spark.createDataFrame(rows, "b array<int>, x int").select("b", "x", _at_most(F.col("b"), F.col("x")).alias("at"))
    for row in df.collect():
        assert row["at"] == sum(b <= row["x"] for b in row["b"]), row


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_flows_are_projected_once(spark):
    from checks.registry import flows, stored_flows
    first, second = stored_flows(spark, SF), stored_flows(spark, SF)
    assert sorted(first.inputFiles()) == sorted(second.inputFiles())
    assert first.columns == flows(spark, SF).columns
    assert first.exceptAll(flows(spark, SF)).count() == 0 and first.count() == flows(spark, SF).count()
