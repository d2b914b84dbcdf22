"""Keyed state on a stream: order, late rows, forgetting, and going on from a checkpoint."""

import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.functions.order_window import rolling_thresholds, window_order_statistic
from netloom.operators import features as fx
from netloom.operators.calibration import adaptive_thresholds
from netloom.streaming import state as ss
from netloom.streaming import windows as sw
from netloom.streaming.run import PROVIDER, drive

CFG = EngineConfig(window_seconds=10.0, new_pair_lookback=4, beacon_gap_seconds=(2.0, 20.0))
SCHEMA = "capture string, src_ip string, dst_ip string, dst_port int, window bigint, ts double, te double, flow_id bigint"


def pair_flows(times, src="a", dst="b", first=0):
    return [("c", src, dst, 80, int(t // 10), float(t), t + 0.5, first + i) for i, t in enumerate(times)]


def feed(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, place, operator, delay="30 seconds", cfg=CFG):
    return drive(spark, path, SCHEMA, lambda s: operator(sw.with_event_time(s, delay), cfg), place, stateful=True, files_per_batch=1)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "feed"), str(tmp_path / "place")


def batch_pairs(spark, rows):
    """The batch rule on the same flows."""
    df = spark.createDataFrame(rows, SCHEMA)
    seen, out = {}, {}
    for r in sorted({(r["src_ip"], r["dst_ip"], r["window"]) for r in df.collect()}, key=lambda x: x[2]):
        last = seen.get(r[:2])
        out[r] = last is None or r[2] - last > CFG.new_pair_lookback
        seen[r[:2]] = r[2]
    return out


def test_any_order_inside_the_delay_gives_the_batch_result(spark, folder):
    path, place = folder
    times = [5, 12, 14, 31, 33, 90, 95, 101, 160, 165, 171, 240]
    rows = pair_flows(times) + pair_flows([7, 66, 71, 140], dst="x", first=100)
    rows.sort(key=lambda r: r[5])
    draw = random.Random(2)
    mixed = sorted(rows, key=lambda r: r[5] + draw.random() * 25)
    feed(spark, path, mixed[:6], mixed[6:11], mixed[11:], pair_flows([900], dst="end", first=500))
    run = stream(spark, path, place, ss.new_pairs)
    assert run.late_rows == 0
    assert {(r.src_ip, r.dst_ip, r.window): r.is_new for r in run.rows.collect()} == batch_pairs(spark, rows)


def test_state_falls_after_the_look_back(spark, folder):
    path, place = folder
    many = [r for i in range(40) for r in pair_flows([3 + i / 10], dst=f"h{i}", first=i)]
    quiet = [pair_flows([t], dst="keep", first=1000 + t) for t in (60, 100, 140, 200, 260)]
    feed(spark, path, many, *quiet)
    run = stream(spark, path, place, ss.new_pairs)
    assert max(run.state_rows) >= 40 and run.state_rows[-1] <= 8
    beacons = stream(spark, path, place + "-b", ss.beacon_scores)
    assert beacons.state_rows[-1] <= 8 < max(beacons.state_rows)


def test_late_rows_are_counted(spark, folder):
    path, place = folder
    # Spark drops by the watermark of the batch before: it passes 6 with the third batch, so the fourth comes late.
    feed(spark, path, pair_flows([5]), pair_flows([400], first=10), pair_flows([405], first=11),
         pair_flows([6, 7, 8], dst="late", first=20), pair_flows([900], first=30))
    run = stream(spark, path, place, ss.new_pairs)
    assert run.late_rows == 3
    assert {r.window for r in run.rows.collect()} == {0, 40}


def test_many_waiting_windows_need_few_calls():
    """A channel with rows in many windows: one timer for the first, and no walk through all waiting ones."""
    class State(dict):
        def get(self):
            return self["v"]

        def exists(self):
            return "v" in self

        def update(self, value):
            self["v"] = value

        def keys(self):
            raise AssertionError("walks through all waiting windows")

        containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        def __init__(self):
            self.timers = []

        def getMapState(self, *_):
            return State()

        getValueState = getMapState

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at

    beacons, handle = ss.Beacons(CFG), Handle()
    beacons.init(handle)
    rows = pd.DataFrame([r[4:] for r in pair_flows(range(0, 2000, 5))], columns=["window", "ts", "te", "flow_id"])
    list(beacons.handleInputRows(("c", "a", "b", 80), iter([rows.iloc[200:], rows.iloc[:200]]), Clock(0)))
    assert handle.timers == [10_000]
    got = [out for at in (5_000, 1_000_000, 10_000_000) for out in beacons.handleExpiredTimer(("c", "a", "b", 80), Clock(at), Clock(at))]
    assert [len(x) for x in got] == [200, 200] and len(handle.timers) == 4
    want = ss.Beacons(CFG).advance(("c", "a", "b", 80), rows, None)[0]
    assert pd.concat(got, ignore_index=True).equals(want)


def test_goes_on_from_its_checkpoint(spark, folder):
    path, place = folder
    before = spark.conf.get(PROVIDER, None)
    first = pair_flows([5, 15, 25, 35])
    feed(spark, path, first)
    stream(spark, path, place, ss.beacon_scores, "0 seconds")
    later = pair_flows([45, 55, 65, 75], first=50)
    feed(spark, path, later, pair_flows([300], dst="end", first=90))
    run = stream(spark, path, place, ss.beacon_scores, "0 seconds")
    assert spark.conf.get(PROVIDER, None) == before
    got = {r.flow_id: r.score for r in run.rows.collect()}
    plain = fx.beacon_scores(spark.createDataFrame(first + later, SCHEMA), CFG, ["capture"]).collect()
    want = {r.flow_id: r.score for r in plain}
    assert got.keys() == {r[-1] for r in first + later}
    assert all(got[i] == pytest.approx(want.get(i, 0.0)) for i in got) and max(want.values()) > 0.9


def test_forgotten_channel_starts_anew(spark, folder):
    path, place = folder
    cfg = replace(CFG, beacon_window=3, beacon_min_gaps=2, beacon_gap_seconds=(2.0, 10.0))
    rows = [pair_flows([5, 10, 15, 20]), pair_flows([505, 510, 515], first=10), pair_flows([900], dst="end", first=90)]
    feed(spark, path, *rows)
    got = {r.flow_id: r.score for r in stream(spark, path, place, ss.beacon_scores, cfg=cfg).rows.collect()}
    assert got[3] > 0.9 and got[10] == got[11] == 0 and got[12] > 0.9


def test_order_statistics_equal_sorting():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 300):
        values = rng.integers(0, 20, n) / 10
        a, b = rng.integers(0, n + 1, (2, 200))
        start, stop, rank = np.minimum(a, b), np.maximum(a, b), rng.integers(-1, n + 2, 200)
        for i, got in enumerate(window_order_statistic(values, start, stop, rank)):
            held = sorted(values[start[i]:stop[i]])
            assert got == held[rank[i] - 1] if 1 <= rank[i] <= len(held) else np.isnan(got)


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_batch_thresholds_equal_plain_rolling(spark, block):
    rng = np.random.default_rng(block)
    rows = [(s, i, float(rng.integers(0, 40)) / 40, bool(rng.random() < 0.3)) for s, n in (("a", 300), ("b", 40), ("c", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "session_key string, pos_in_session bigint, score double, y boolean")
    out = adaptive_thresholds(df, 0.1, history=30, min_history=8, block=block).collect()
    got = {(r.session_key, r.pos_in_session): r.threshold for r in out}
    for s in "abc":
        mine = [r for r in rows if r[0] == s]
        held, fallback = [], float(np.quantile([r[2] for r in mine], 0.9))
        for _, i, score, y in mine:
            recent = sorted(held[-30:])
            rank = min(max(int(np.ceil((len(recent) + 1) * 0.9)), 1), max(len(recent), 1))
            assert got[s, i] == pytest.approx(recent[rank - 1] if len(recent) >= 8 else fallback)
            held += [] if y else [score]
    seen = np.arange(12)
    assert np.isnan(rolling_thresholds(np.arange(12.0), seen, 0.1, 5, 3)[:3]).all()


def test_stream_thresholds_and_levels(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(s, i, 1000 + i, float(rng.integers(0, 30)) / 30, bool(rng.random() < 0.2), float(rng.random())) for s in "ab" for i in range(60)]
    schema = "session_key string, pos_in_session bigint, window bigint, score double, y boolean, early double"
    path = str(tmp_path / "scored")
    for part in (rows[:20] + rows[60:90], rows[20:60], rows[90:], [("end", 0, 5000, 0.0, False, 0.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    timed = lambda s: s.withColumn("event_time", F.timestamp_seconds(F.col("window") * 10)).withWatermark("event_time", "2 days")
    out = drive(spark, path, schema, lambda s: ss.adaptive_threshold(timed(s), CFG, 0.1, 0.77, 15, 5), stateful=True).rows.collect()
    assert out == []  # nothing is closed within two days
    timed = lambda s: s.withColumn("event_time", F.timestamp_seconds(F.col("window") * 10)).withWatermark("event_time", "1 hour")
    out = drive(spark, path, schema, lambda s: ss.adaptive_threshold(timed(s), CFG, 0.1, 0.77, 15, 5), stateful=True).rows
    got = {(r.session_key, r.pos_in_session): r.threshold for r in out.collect()}
    levels = drive(spark, path, schema, lambda s: ss.two_level(timed(s.withColumnRenamed("score", "risk")), CFG, 0.6, 0.5), stateful=True).rows
    level = {(r.session_key, r.pos_in_session): r.level for r in levels.collect()}
    for s in "ab":
        mine, held = [r for r in rows if r[0] == s], []
        for i, r in enumerate(mine):
            recent = sorted(held[-15:])
            rank = min(max(int(np.ceil((len(recent) + 1) * 0.9)), 1), max(len(recent), 1))
            assert got[s, r[1]] == pytest.approx(recent[rank - 1] if len(recent) >= 5 else 0.77)
            held += [] if r[4] else [r[3]]
            two = i > 0 and mine[i - 1][3] >= 0.6 and r[3] >= 0.6
            one = i > 0 and mine[i - 1][5] >= 0.5 and r[5] >= 0.5
            assert level[s, r[1]] == (2 if two else 1 if one else 0)
