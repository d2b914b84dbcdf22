"""Signature scenarios and causality of the state features."""

from dataclasses import replace

import pytest
from builders import flow

from netloom import vocab
from netloom.config import EngineConfig
from netloom.operators.features import assign_windows, window_features
from netloom.plans.build import build_windows

CFG = EngineConfig(warmup_windows=3, context=4, horizons=(3,), primary_horizon=3, internal_cidrs=("192.168.10.0/24",),
                   block_rows=150)
START = 1_000_000


def features(make_flows, rows, cfg=CFG):
    df = window_features(assign_windows(make_flows(rows), cfg), cfg)
    return {r["window"] - START // 10: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def scenario(make_flows, background):
    rows = background(300)
    rows += [flow(10_000 + i, START + 20 * i, "192.168.10.3", "203.0.113.9", 8443) for i in range(15)]
    rows += [flow(20_000 + i, START + 100 + i * 0.02, "198.51.100.7", "192.168.10.5", i + 1, ack=0.0) for i in range(200)]
    rows += [flow(30_000 + i, START + 150 + i * 0.1, "192.168.10.4", f"192.168.10.{i + 20}", 445) for i in range(60)]
    rows += [flow(40_000, START + 200, "192.168.10.6", "203.0.113.77", 443, dur=90.0, fwd=5e8, bwd=1e4)]
    return features(make_flows, rows)


def test_beacon(scenario):
    assert max(scenario[w]["beacon_max"] for w in scenario if w >= 20) > 0.9
    assert all(scenario[w]["beacon_max"] == 0 for w in range(3))


def test_vertical_scan(scenario):
    assert scenario[10]["seq_port_score"] > 0.95
    assert scenario[10]["half_open_max"] >= 200


def test_lateral_movement(scenario):
    assert scenario[15]["int_fanout_max"] >= 60
    assert scenario[15]["int_scan_max"] >= 60


def test_exfiltration(scenario):
    assert scenario[20]["out_asym_max"] > 0.99
    assert scenario[20]["long_out_bytes"] >= 5e8


def test_new_pairs_fade(scenario):
    assert scenario[0]["new_pair_frac"] == 1.0
    assert scenario[28]["new_pair_frac"] < 0.5


def test_lull_is_one_session_of_zero_states(make_flows, background):
    rows = background(60) + background(60, START + 160, 5000)
    win = build_windows(make_flows(rows), CFG).orderBy("window").collect()
    assert {r["session"] for r in win} == {0}
    quiet = [r for r in win if r["n_flows"] == 0]
    assert len(quiet) == 10
    assert all(r[f] == 0.0 for r in quiet for f in vocab.FEATURE_NAMES)
    assert all(r["m_packet"] == 0.0 and r["m_ip"] == 1.0 for r in win)


def test_features_do_not_see_the_future(make_flows, background):
    rows = background(120) + [flow(9000 + i, START + 7 * i, "192.168.10.2", "203.0.113.5", 99) for i in range(17)]
    cut = START + 70
    whole = features(make_flows, rows)
    past = features(make_flows, [r for r in rows if r["ts"] < cut])
    for w in range(7):
        for name in vocab.FEATURE_NAMES:
            assert whole[w][name] == pytest.approx(past[w][name], abs=1e-9), (w, name)


def test_one_hot_channel_gives_the_same_scores_in_any_block_size(make_flows):
    rows = [flow(i, START + 5 * i + (i % 3) * 0.3, "192.168.10.2", "203.0.113.5", 99) for i in range(120)]
    small = features(make_flows, rows, replace(CFG, block_rows=40))
    large = features(make_flows, rows, replace(CFG, block_rows=10_000_000))
    for w in large:
        assert small[w]["beacon_max"] == pytest.approx(large[w]["beacon_max"], abs=1e-12)
        assert small[w]["beacon_pairs"] == large[w]["beacon_pairs"]
