"""Splits, scaling, rollout and next-stage axioms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom import vocab
from netloom.config import EngineConfig
from netloom.operators import calibration as ca
from netloom.operators import dynamics as dy
from netloom.operators import models as md
from netloom.operators import normalise as nm
from netloom.operators import splits as sp
from netloom.operators import transitions as tr

CFG = EngineConfig(warmup_windows=40)


def test_purged_split(make_windows):
    sizes = (400, 250, 330)
    win = make_windows([0] * sum(sizes), [s for s, n in enumerate(sizes) for _ in range(n)])
    split = sp.temporal_split(win, CFG, 12).cache()
    assert sp.purge_violations(split, 12).count() == 0
    fit = {r["session"]: r["m"] for r in split.filter("fit_row").groupBy("session").agg(
        F.max("pos_in_session").alias("m")).collect()}
    assert fit == {s: int(0.6 * n) - 1 for s, n in enumerate(sizes)}
    assert split.filter("split is not null").agg(F.min("pos_in_session")).first()[0] == 40


def test_zero_inflated_bins(spark):
    rng = np.random.default_rng(3)
    values = [0.0] * 700 + list(rng.normal(size=300))
    long = spark.createDataFrame([("a", float(v)) for v in values], "feature string, value double")
    bins = nm.fit_bins(long)
    row = bins.first()
    want = np.unique(np.quantile(values, [i / 16 for i in range(1, 16)]))
    assert row["edges"] == pytest.approx(list(want))
    assert len(row["edges"]) < 15 and len(row["centers"]) == len(row["edges"]) + 1
    placed = nm.assign_bins(long, bins)
    assert placed.filter("value = 0").select("bin").distinct().count() == 1


def test_bins_read_their_rows_once(spark):
    """All passes of the fit read stored counts, so the long rows are computed once (F16)."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    long = spark.range(3000).select(F.lit("a").alias("feature"), (F.col("id") % 101).cast("double").alias("value"))
    bins = nm.fit_bins(long.mapInArrow(counted, long.schema)).first()
    assert read.value == 3000
    assert len(bins["edges"]) == 15 and len(bins["centers"]) == 16


def test_scaling_looks_up_no_map(spark):
    """Scaling a window reads its 92 parameters by position, whatever their order in the table (F13)."""
    win = spark.createDataFrame([(1.0, 5.0, "s")], "syn_rate double, ack_rate double, session_key string")
    scaler = spark.createDataFrame([("ack_rate", 1.0, 2.0), ("syn_rate", 0.5, 1.0)], "feature string, center double, scale double")
    own = spark.createDataFrame([("s", "ack_rate", 3.0)], "session_key string, feature string, center double")
    names = ("syn_rate", "ack_rate")
    plain = nm.scale_wide(win, scaler, names)
    assert plain.first()[:2] == (0.5, 2.0) and nm.unscale_wide(plain, scaler, names).first()[:2] == (1.0, 5.0)
    assert nm.scale_wide(win, scaler, names, own).drop("session_key").first()[:] == (0.5, 1.0)
    looked_up = plain._jdf.queryExecution().optimizedPlan().expressions().toString()
    assert "center" in looked_up and "[syn_rate]" not in looked_up


def test_scaler_fallbacks(spark):
    rows = [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (10.0, 0.0)]
    df = spark.createDataFrame(rows, "syn_rate double, ack_rate double")
    got = {r["feature"]: r for r in nm.fit_scaler(df, ("syn_rate", "ack_rate")).collect()}
    q = np.quantile([1, 2, 3, 10], [0.25, 0.75])
    assert got["syn_rate"]["center"] == 2.5 and got["syn_rate"]["scale"] == pytest.approx((q[1] - q[0]) / 1.349)
    assert got["ack_rate"]["scale"] == 1.0


@pytest.fixture(scope="module")
def forecast(spark):
    counts = spark.createDataFrame([(0, 0, 0, 90), (0, 0, 2, 10), (2, 2, 4, 5), (4, 4, 6, 3)],
                                   "stage int, progress int, next_stage int, n bigint")
    table = tr.transition_table(counts)
    sums = table.groupBy("stage", "progress").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 49 and all(r["s"] == pytest.approx(1.0) for r in sums)
    return tr.propagate(table, 6)


def test_rollout_axioms(forecast):
    hit, stage = forecast["hit"], forecast["stage"]
    assert (np.diff(hit, axis=0) >= -1e-12).all() and (hit >= 0).all() and (hit <= 1).all()
    assert np.allclose(stage.sum(-1), 1.0)


def test_rollout_matches_simulation_by_enumeration(spark, forecast):
    belief = [0.0] * 7
    belief[0] = 1.0
    df = spark.createDataFrame([(belief, 0)], "nowcast array<double>, progress int")
    row = tr.rollout_risk(df, forecast, (1, 6)).first()
    assert row["p_within_1"] == pytest.approx(forecast["hit"][0, 0, 0])
    assert row["p_within_6"] == pytest.approx(forecast["hit"][5, 0, 0])
    mass = tr.horizon_stage_mass(df, forecast, 6).first()["stage_mass"]
    assert sum(mass) == pytest.approx(6.0)


def test_next_stage_never_names_benign_or_current(spark, make_windows, forecast):
    win = make_windows([0] * 10 + [1, 2, 0, 4, 4, 0, 6]).withColumns(
        {"split": F.lit("train"), "is_stage_onset": F.col("stage_now") > 0})
    belief = F.array(*[F.when(F.col("stage_now") == z, 0.7).otherwise(0.05) for z in range(7)])
    ready = tr.progress(win.withColumn("nowcast", belief), 5)
    ready = tr.horizon_stage_mass(ready, forecast, 6).withColumn("current", F.col("stage_now"))
    rows = tr.next_stage(ready, tr.onset_counts(win, 5), 0.25).collect()
    for r in rows:
        assert r["next_probs"][0] == 0.0 and sum(r["next_probs"]) == pytest.approx(1.0)
        assert r["current"] == 0 or r["next_probs"][r["current"]] == 0.0


def test_logistic_learns_a_separable_target(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    rows = [([float(a), float(b)], bool(a > 0.3)) for a, b in x]
    df = spark.createDataFrame(rows, "x array<double>, y boolean")
    scored = md.predict(md.fit_logistic(df), df)
    assert scored.filter((F.col("score") > 0.5) == F.col("y")).count() > 380


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ np.array([[1.0, 0.0], [0.5, -1.0], [0.0, 2.0]]) + 3.0 + rng.normal(scale=0.1, size=(300, 2))
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in zip(x, y)],
                               "x array<double>, target array<double>")
    params = md.ridge_autoregression(df, 2)
    xc, yc = x - x.mean(0), y - y.mean(0)
    assert np.allclose(params["weights"], np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc))
    full = np.hstack([np.ones((300, 1)), x, y])
    assert np.allclose(np.array(md.gram(df.repartition(7)).first()[0]).reshape(6, 6), full.T @ full)
    assert np.allclose(params["intercept"], y.mean(0) - x.mean(0) @ params["weights"])
    assert np.allclose(params["sigma"], np.maximum((y - x @ params["weights"] - params["intercept"]).std(0), 0.05))
    with pytest.raises(ValueError, match="no rows"):
        md.ridge_autoregression(df.filter("false"), 2)


def test_normal_cdf():
    assert dy.normal_cdf(np.array([-1.959964, 0.0, 1.0, np.inf])) == pytest.approx([0.025, 0.5, 0.841345, 1.0], abs=1e-6)


def plain_states(n=60, features=3, seed=4):
    rng = np.random.default_rng(seed)
    edges = [[-1.0, 0.0, 1.0], [0.5], []]
    z = rng.normal(size=(n, features))
    bins = np.array([[int(np.searchsorted(e, v, side="right")) for e, v in zip(edges, row)] for row in z])
    mask = (rng.random((n, features)) < 0.8).astype(float)
    return z, bins, mask, edges


@pytest.fixture(scope="module")
def states(spark):
    z, bins, mask, edges = plain_states()
    rows = [("s", i, "train" if i < 40 else "test", list(map(float, z[i])), bins[i].tolist(), [len(e) + 1 for e in edges], mask[i].tolist())
            for i in range(60)] + [("t", i, "test", [0.0] * 3, [0, 0, 0], [4, 2, 1], [0.0] * 3) for i in range(5)]
    return spark.createDataFrame(rows, "session_key string, pos_in_session bigint, split string, z array<double>, bins array<int>,"
                                       " n_bins array<int>, mask array<double>").cache()


@pytest.mark.parametrize("block", [5, 16, 4096])
def test_next_state_likelihoods_equal_plain_counting(states, block):
    _, bins, mask, edges = plain_states()
    nb, context = np.array([len(e) + 1 for e in edges]), 6
    got = {(r["session_key"], r["k"], r["pos_in_session"]): (r["nll_history"], r["nll_persistence"])
           for r in dy.next_state_nll(states, (1, 4, 9), context, block).collect()}
    want = {}
    for k in (1, 4, 9):
        for i in range(context + k - 1, 60):
            past = bins[i - k - context + 1:i - k + 1]
            h = ((past == bins[i]).sum(0) + 0.5) / (context + 0.5 * nb)
            p = np.where(bins[i - k] == bins[i], 0.9, 0.1 / np.maximum(nb - 1, 1))
            seen = max(mask[i].sum(), 1)
            want["s", k, i] = tuple(-(np.log(np.maximum(q, 1e-4)) * mask[i]).sum() / seen for q in (h, p))
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key]) for key in want)


@pytest.mark.parametrize("k, block", [(1, 7), (5, 4096)])
def test_autoregression_equals_plain_ridge(states, k, block):
    z, bins, mask, edges = plain_states()
    pairs = md.history_pairs(states, k, depth=3, block=block)
    params = md.ridge_autoregression(pairs.filter("split = 'train'"), 3)
    at = np.arange(2, 60 - k)
    x, y = np.stack([z[at - 2], z[at - 1], z[at]], 1).reshape(len(at), -1), z[at + k]
    train = at < 40
    xc, yc = x[train] - x[train].mean(0), y[train] - y[train].mean(0)
    weights = np.linalg.solve(xc.T @ xc + np.eye(9), xc.T @ yc)
    assert np.allclose(params["weights"], weights)
    mu = y[train].mean(0) + (x - x[train].mean(0)) @ weights
    sigma = np.maximum((y - mu)[train].std(0), 0.05)
    got = {r["pos_in_session"]: r["nll_ar"] for r in dy.autoregression_nll(pairs.filter("session_key = 's'"), params, edges, k).collect()}
    for row, i in enumerate(at):
        p = []
        for j, e in enumerate(edges):
            borders = [-np.inf, *e, np.inf]
            b = bins[i + k, j]
            low, high = ((borders[b + s] - mu[row, j]) / sigma[j] for s in (0, 1))
            p.append(dy.normal_cdf(np.array([high]))[0] - dy.normal_cdf(np.array([low]))[0])
        want = -(np.log(np.clip(p, 1e-4, 1)) * mask[i + k]).sum() / max(mask[i + k].sum(), 1)
        assert got[i + k] == pytest.approx(want)
    assert len(got) == len(at)


def test_vocabulary_contract():
    assert len(vocab.FEATURES) == 92 and len(set(vocab.FEATURE_NAMES)) == 92
    assert len(vocab.STAGES) == 7


@pytest.mark.parametrize("kind, buckets", [("noisy", 64), ("noisy", 5), ("rising", 16), ("falling", 16), ("tied", 8)])
def test_isotonic_equals_the_min_max_formula(spark, kind, buckets):
    rng = np.random.default_rng(len(kind))
    x = np.round(rng.random(900), 3 if kind != "tied" else 1)
    y = {"noisy": rng.random(900) < x ** 2, "rising": x > 0.4, "falling": x < 0.4, "tied": rng.random(900) < x}[kind]
    x[:300] = 0.5  # a third of all rows are one score
    cal = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y)] + [(None, True)], "score double, y boolean")
    scores = np.unique(x)
    weight = np.array([(x == s).sum() for s in scores], float)
    total = np.array([y[x == s].sum() for s in scores], float)
    mean = lambda a, b: total[a:b + 1].sum() / weight[a:b + 1].sum()
    n = len(scores)
    least = [[np.inf] * n for _ in range(n)]  # least[a][i]: over ends b >= i
    for a in range(n):
        best, cw, ct = np.inf, weight[a:].sum(), total[a:].sum()
        for b in range(n - 1, a - 1, -1):
            best = min(best, ct / cw)
            least[a][b] = best
            cw, ct = cw - weight[b], ct - total[b]
    want = [max(least[a][i] for a in range(i + 1)) for i in range(n)]
    assert mean(0, n - 1) == pytest.approx(total.sum() / weight.sum())
    asked = [-1.0, 2.0, *np.linspace(0, 1, 211), *scores]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(asked)] + [(-1, None)], "i int, score double")
    out = ca.apply_isotonic(df, ca.isotonic(cal, buckets=buckets)).collect()
    got = {r["i"]: r["probability"] for r in out}
    assert got.pop(-1) is None and len(out) == len(asked) + 1
    np.testing.assert_allclose([got[i] for i in range(len(asked))], np.interp(asked, scores, want), atol=1e-9)


def test_isotonic_without_rows(spark):
    empty = spark.createDataFrame([], "score double, y boolean")
    df = spark.createDataFrame([(0.5,)], "score double")
    assert ca.apply_isotonic(df, ca.isotonic(empty)).first()["probability"] is None


@pytest.mark.parametrize("kind", ["noisy", "separable", "one class"])
def test_platt_is_optimal(spark, kind):
    rng = np.random.default_rng(6)
    x = np.round(rng.random(500), 3)
    y = {"noisy": rng.random(500) < 0.1 + 0.6 * x, "separable": x > 0.5, "one class": x > -1}[kind]
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y)] + [(None, True)], "score double, y boolean")
    a, b = ca.fit_platt(df)
    z = np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4)))
    q = 1 / (1 + np.exp(-(a * z + b)))
    if kind == "one class":
        assert q.min() > 0.99
    else:  # both derivatives of the penalised loss vanish
        assert abs(((q - y) * z).sum() + a / 1e3) < 1e-6 and abs((q - y).sum()) < 1e-6
    assert ca.fit_platt(df.filter("false")) == (0.0, 0.0)


def test_forecast_steps_are_the_single_forecasts(spark):
    rng = np.random.default_rng(12)
    counts = spark.createDataFrame([(z, p, n, float(rng.integers(1, 30))) for z in range(7) for p in range(7) for n in range(7)],
                                   "stage int, progress int, next_stage int, n double")
    forecast = tr.propagate(tr.transition_table(counts), 5)
    beliefs = rng.dirichlet(np.ones(7), 20)
    df = spark.createDataFrame([(i, list(map(float, b)), int(i % 7)) for i, b in enumerate(beliefs)], "i int, nowcast array<double>, progress int")
    rows = tr.step_stage_argmax(tr.rollout_risk(tr.rollout_steps(df, forecast, 5), forecast, range(1, 6)), forecast, 5).collect()
    for r in rows:
        assert r["risk_steps"] == pytest.approx([r[f"p_within_{k}"] for k in range(1, 6)])
        assert all(b >= a - 1e-12 for a, b in zip(r["risk_steps"], r["risk_steps"][1:]))
        assert np.allclose(np.sum(r["stage_steps"], 1), 1)
        assert r["step_stage"] == [int(np.argmax(s[1:])) + 1 for s in r["stage_steps"]]
