"""Distributed order statistics against brute force, with a third of all rows on one value."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators import blocked
from netloom.operators import calibration as ca
from netloom.operators import metrics as mt
from netloom.operators import ranking as rk
from netloom.operators.blocked import look_back, row_blocks, with_halo


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(3000), 3)
    s[:1000] = 0.5
    y = rng.random(3000) < 0.2 + 0.5 * s
    rows = [(int(i), float(a), bool(b), "g1" if i % 3 else "g2") for i, (a, b) in enumerate(zip(s, y))]
    return s, y, spark.createDataFrame(rows, "id int, score double, y boolean, grp string").cache()


def average_precision(y, s):
    total, tp, fp, out = y.sum(), 0, 0, 0.0
    for v in sorted(set(s), reverse=True):
        p, q = int((y & (s == v)).sum()), int((~y & (s == v)).sum())
        tp, fp = tp + p, fp + q
        out += p / total * tp / (tp + fp)
    return out


def test_average_precision_and_auc(scores):
    s, y, df = scores
    row = mt.auprc(df, []).first()
    assert row["auprc"] == pytest.approx(average_precision(y, s), abs=1e-12)
    pos, neg = s[y], s[~y]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12)


def test_quantiles_match_linear_interpolation(scores):
    s, _, df = scores
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    assert rk.quantiles(df, [], "score", qs, buckets=8).first()["q"] == pytest.approx(list(np.quantile(s, qs)))


def test_quantiles_per_group(scores):
    s, _, df = scores
    got = {r["grp"]: r["q"] for r in rk.quantiles(df, ["grp"], "score", [0.1, 0.9]).collect()}
    index = np.arange(len(s)) % 3 == 0
    assert got["g2"] == pytest.approx(list(np.quantile(s[index], [0.1, 0.9])))
    assert got["g1"] == pytest.approx(list(np.quantile(s[~index], [0.1, 0.9])))


def test_groups_are_not_gathered(spark):
    """Groups from one to many values, one with a third of all rows, a NULL group; nothing is broadcast by size."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).when(F.col("id") == 2, "one").otherwise(
            F.concat(F.lit("g"), F.col("id") % 40)).alias("grp"), F.round(F.rand(5) * 5000, 1).alias("v"))
    df = df.cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["grp"]: r["q"] for r in rk.quantiles(df, ["grp"], "v", [0.0, 0.3, 0.5, 1.0], rows=1500).collect()}
        cut = rk.bucketed(rk.value_counts(df, ["grp"], "v"), ["grp"], "v", ["n"], rows=1500)
        buckets = {r["grp"]: (r["b"], r["most"]) for r in cut.groupBy("grp", "_bucket").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
                   .groupBy("grp").agg(F.count("*").alias("b"), F.max("n").alias("most")).collect()}
        tasks = [r["count"] for r in cut.repartition(8, "grp", "_bucket").groupBy(F.spark_partition_id().alias("t")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pdf = df.toPandas()
    for key, part in pdf.groupby("grp", dropna=False):
        want = np.quantile(part["v"], [0.0, 0.3, 0.5, 1.0])
        assert got[None if key != key else key] == pytest.approx(list(want)), key
    assert len(got) == pdf["grp"].nunique(dropna=False)
    assert buckets["hot"][0] > 40 and buckets["hot"][1] < 2 * 20_000 / 64 * 2 and buckets["one"][0] == 1
    assert max(tasks) < 2 * sum(tasks) / 8


def test_conformal_rank(scores):
    s, y, df = scores
    neg = np.sort(s[~y])
    rank = int(np.ceil((len(neg) + 1) * (1 - 0.03)))
    row = ca.conformal_thresholds(df, (0.03,)).first()
    assert row["threshold"] == neg[rank - 1]
    assert (neg >= row["threshold"]).mean() <= 0.03 + 0.02


def test_without_negatives_the_threshold_defaults(spark):
    df = spark.createDataFrame([(0.4, True)], "score double, y boolean")
    row = ca.conformal_thresholds(df, (0.03,)).first()
    assert (row["threshold"], row["n_calibration"]) == (0.5, 0)


def test_bootstrap_reweights_whole_blocks(scores):
    s, y, df = scores
    blocked = df.withColumn("block", F.floor(F.col("id") / 100).cast("string"))
    draws = mt.block_multiplicities(blocked, 5).collect()
    per = {}
    for r in draws:
        per.setdefault(r["boot"], {})[r["block"]] = r["m"]
    assert all(sum(m.values()) == 30 for m in per.values())
    arrays = {r["block"]: r["m"] for r in mt.block_draws(blocked, 5).collect()}
    assert arrays == {b: [per[i].get(b, 0) for i in range(5)] for b in {b for m in per.values() for b in m}}
    got = {r["boot"]: r["auprc"] for r in mt.bootstrap_auprc(blocked, 5).collect()}
    for boot, m in per.items():
        rows = np.concatenate([np.tile(np.arange(int(b) * 100, int(b) * 100 + 100), k) for b, k in m.items()])
        assert got[boot] == pytest.approx(average_precision(y[rows], s[rows]), abs=1e-12)


def test_bootstrap_pairs_share_draws_and_one_class_is_null(scores, spark):
    s, y, df = scores
    both = df.withColumns({"block": F.floor(F.col("id") / 100).cast("string"), "other": F.when(F.col("id") % 7 > 0, 1 - F.col("score"))})
    runs = mt.bootstrap_metrics(both, 4, ["score", "other"]).collect()
    alone = {name: {r["boot"]: r["auprc"] for r in mt.bootstrap_auprc(both, 4, score=name).collect()} for name in ("score", "other")}
    assert {(r["model"], r["boot"]): r["auprc"] for r in runs} == {(m, b): v for m, d in alone.items() for b, v in d.items()}
    plain = mt.ranking_metrics(mt.score_counts(both.join(mt.block_multiplicities(both, 4), "block"), ["boot"], "other", "y", "m")
                               .filter("score is not null"), ["boot"])
    for r in plain.collect():
        mine = next(x for x in runs if x["model"] == "other" and x["boot"] == r["boot"])
        assert (mine["n"], mine["positives"]) == (r["n"], r["positives"])
        assert mine["auprc"] == pytest.approx(r["auprc"]) and mine["roc_auc"] == pytest.approx(r["roc_auc"])
    one = mt.bootstrap_metrics(both.filter("y"), 2, ["score"]).collect()
    assert [r["auprc"] for r in one] == [None, None]
    row = mt.paired_bootstrap(both, 4, "score", "other").first()
    gaps = [alone["score"][b] - alone["other"][b] for b in range(4)]
    assert row["resamples"] == 4 and row["p_a_better"] == np.mean([g > 0 for g in gaps])


def test_dense_index_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    assert sorted(r["i"] for r in mt.dense_index(df, "k").collect()) == list(range(500))


def test_look_back_equals_a_plain_window(spark):
    rng = np.random.default_rng(1)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.integers(4)}"), float(np.round(rng.random() * 50, 1)), i)
            for i in range(800)]
    df = spark.createDataFrame(rows, "k string, ts double, id int")
    plain = W.partitionBy("k").orderBy("ts", "id")
    want = {r["id"]: r["x"] for r in df.withColumn("x", F.lag("id", 3).over(plain)).collect()}
    for block in (1, 130, 10_000):
        out = look_back(df, ["k"], ["ts", "id"], 3, lambda w: {"x": F.lag("id", 3).over(w)}, block)
        got = {r["id"]: r["x"] for r in out.collect()}
        assert got == want
    assert out.columns == [*df.columns, "x"]


def test_look_back_shuffles_its_blocks_once(spark, tmp_path):
    """Finished rows and rows near borders read one shuffle, and no higher-order function is interpreted per row (F13)."""
    spark.range(4000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("ts"), "id").write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    out = look_back(df, ["k"], ["ts", "id"], 3, lambda w: {"x": F.lag("id", 3).over(w)}, 100)
    assert len(out.collect()) == 4000
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "lambdafunction" not in plan.split("Window")[-1].split("BroadcastExchange")[0]
    borders = spark.createDataFrame([([float(x) for x in range(n)], x) for n in (0, 1, 5, 40_000)
                                     for x in (-1.0, 0.0, 3.5, 4.0, 39_999.0)], "_borders array<double>, _spot double")
    counted = blocked._count_borders(borders, "n").collect()
    assert len(counted) == 20 and all(r["n"] == sum(b <= r["_spot"] for b in r["_borders"]) for r in counted)


def test_blocks_follow_rows_not_times(spark):
    """Almost a third of all rows are one key at one time: no block and no task holds much more than its share."""
    n = 120_000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 < 3, F.lit("hot")).when(F.col("id") % 1000 == 7, F.lit(None)).otherwise(
            F.concat(F.lit("k"), F.col("id") % 997)).alias("k"),
        F.when(F.col("id") % 10 < 3, 5.0).otherwise(F.rand(3) * 50).alias("ts"), "id")
    cut = row_blocks(df, ["k"], ["ts", "id"], 2000)
    blocks = cut.groupBy("k", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    hot = sorted((r for r in blocks if r["k"] == "hot"), key=lambda r: r["_block"])
    assert 14 <= len(hot) <= 24 and max(r["n"] for r in hot) < 4000
    assert all(a["hi"] < b["lo"] for a, b in zip(hot, hot[1:]))
    assert all(r["_block"] == 0 for r in blocks if r["k"] != "hot")
    tasks = cut.repartition(8, "k", "_block").groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert max(r["count"] for r in tasks) < 2 * n / 8


def test_halo_equals_a_plain_frame(spark):
    df = spark.range(200).select(F.lit("s").alias("k"), F.col("id").alias("p"))
    frame = W.partitionBy("k").orderBy("p").rowsBetween(-9, 2)
    want = {r["p"]: r["x"] for r in df.withColumn("x", F.sum("p").over(frame)).collect()}
    cut = with_halo(df, F.col("p"), 16, before=9, after=2)
    inside = W.partitionBy("k", "_slice").orderBy("p").rowsBetween(-9, 2)
    got = {r["p"]: r["x"] for r in cut.withColumn("x", F.sum("p").over(inside)).filter("_own").collect()}
    assert got == want


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 0)], "t int, p int")
    f0, f1, f2 = 2 * 2 / (3 + 3), 2 * 1 / (1 + 2), 0.0
    assert mt.macro_f1(df, "t", "p").first()["macro_f1"] == pytest.approx((f0 + f1 + f2) / 3)
