"""Keyed state over a stream: new pairs, beacons, hysteresis and the adaptive threshold.

Every processor works in event time. Rows wait in map state, one entry per window, until an event-time timer says that the
watermark has passed the end of the key's first waiting window; then all its closed windows are processed in time order. A key has
a list of its waiting windows and one timer for the first, so no timer walks through all of them. Results do not
depend on the order of arrival within the watermark's delay, and equal the batch operators. Rows behind the watermark
never reach a processor: Spark drops and counts them (``run.StreamRun.late_rows``).

State ends: after each processed window a second timer is set for the time from which the key's memory can no longer
matter (or, for beacons, from which a channel counts as new); it clears the key. What a key holds is
bounded by the rows of its windows inside the delay, and a fixed memory (a window number, the last flow times, two
counters, the last scores).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.config import EngineConfig
from netloom.functions.order_window import rolling_thresholds

# Send the processors themselves to the workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ClosedWindows(StatefulProcessor):
    """Hands a key's rows to ``advance`` window by window, once each window is closed.

    ``columns``: what is kept of a waiting row, with types. ``memory``: columns of the key's memory.
    """

    columns: dict[str, str] = {}
    memory: dict[str, str] = {}

    def __init__(self, window_seconds: float, forget_windows: int):
        self.slot_ms = int(window_seconds * 1000)
        self.forget_ms = int(forget_windows) * self.slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "window bigint", ", ".join(f"{c} array<{t}>" for c, t in self.columns.items()))
        self.open = handle.getValueState("open", "windows array<bigint>")
        self.known = handle.getValueState("known", ", ".join(f"{c} {t}" for c, t in {"window": "bigint", **self.memory}.items()))

    def _end(self, window: int) -> int:
        return (window + 1) * self.slot_ms

    def _open(self) -> list[int]:
        return sorted(self.open.get()[0]) if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._open()
        held = set(before)
        for pdf in rows:
            of = pdf["window"].to_numpy()
            order = np.argsort(of, kind="stable")
            windows, start = np.unique(of[order], return_index=True)
            columns = [pdf[c].to_numpy()[order].tolist() for c in self.columns]
            for window, i, j in zip(windows.tolist(), start.tolist(), [*start[1:].tolist(), len(of)]):
                at, new = (window,), [c[i:j] for c in columns]
                if window in held:
                    new = [[*old, *more] for old, more in zip(self.waiting.getValue(at), new)]
                held.add(window)
                self.waiting.updateValue(at, tuple(new))
        if len(held) > len(before):
            self.open.update((sorted(held),))
            if not before or min(held) < before[0]:
                self.handle.registerTimer(self._end(min(held)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self._open()
        closed = [window for window in held if self._end(window) <= now]
        memory = self.known.get() if self.known.exists() else None
        if not closed:
            if memory is not None and not held and self._end(memory[0]) + self.forget_ms <= now:
                self.known.clear()
            return
        columns, windows = [[] for _ in self.columns], []
        for window in closed:
            values = self.waiting.getValue((window,))
            self.waiting.removeKey((window,))
            for column, more in zip(columns, values):
                column.extend(more)
            windows += [window] * len(values[0])
        if len(closed) < len(held):
            self.open.update((held[len(closed):],))
            self.handle.registerTimer(self._end(held[len(closed)]))
        else:
            self.open.clear()
        rows = pd.DataFrame({**dict(zip(self.columns, columns)), "window": windows})
        if memory is not None and self._end(memory[0]) + self.forget_ms <= self._end(closed[0] - 1):
            memory = None  # the timer that would have cleared it and these windows came in one batch
        out, memory = self.advance(key, rows, memory[1:] if memory else None)
        self.known.update((closed[-1], *memory))
        self.handle.registerTimer(self._end(closed[-1]) + self.forget_ms)
        yield out

    def advance(self, key: tuple, rows: pd.DataFrame, memory: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """(output, new memory) from the rows of closed windows, in order of windows."""
        raise TypeError("a processor defines how it advances")

    def close(self) -> None:
        pass


class NewPairs(ClosedWindows):
    """Per window of a host pair: was the pair unseen for the look-back?"""

    columns = {"flow_id": "bigint"}
    memory = {"last": "bigint"}

    def __init__(self, cfg: EngineConfig):
        super().__init__(cfg.window_seconds, cfg.new_pair_lookback + 1)  # from then on the pair is new anyway
        self.lookback = cfg.new_pair_lookback

    def advance(self, key, rows, memory):
        windows = np.unique(rows["window"].to_numpy())
        before = np.concatenate([[memory[0] if memory else np.nan], windows[:-1].astype(float)])
        is_new = np.isnan(before) | (windows - before > self.lookback)
        out = pd.DataFrame({"capture": key[0], "src_ip": key[1], "dst_ip": key[2], "window": windows, "is_new": is_new})
        return out, (int(windows[-1]),)


class Beacons(ClosedWindows):
    """Periodicity score of every flow from the last ``n`` starts and ends on its channel.

    A channel that was silent for ``n`` times the largest gap a beacon may have starts anew.
    """

    columns = {"ts": "double", "te": "double", "flow_id": "bigint"}
    memory = {"ts": "array<double>", "te": "array<double>"}

    def __init__(self, cfg: EngineConfig):
        self.n, self.least = cfg.beacon_window, cfg.beacon_min_gaps
        self.low, self.high = cfg.beacon_gap_seconds
        self.idle = cfg.beacon_min_idle
        super().__init__(cfg.window_seconds, int(self.n * self.high / cfg.window_seconds) + 1)

    def advance(self, key, rows, memory):
        rows = rows.sort_values(["ts", "flow_id"], kind="stable")
        held = memory or ([], [])
        old = len(held[0])
        ts = np.concatenate([np.asarray(held[0], float), rows["ts"].to_numpy()])
        te = np.concatenate([np.asarray(held[1], float), rows["te"].to_numpy()])
        gaps = pd.Series(np.diff(ts, prepend=np.nan))
        idles = pd.Series(ts - np.concatenate([[np.nan], te[:-1]]))
        mean = gaps.rolling(self.n, min_periods=self.least).mean()
        std = gaps.rolling(self.n, min_periods=self.least).std()
        idle = idles.rolling(self.n, min_periods=self.least).mean()
        ok = mean.between(self.low, self.high) & (idle >= self.idle)
        score = np.where(ok, 1.0 / (1.0 + std / mean), 0.0)[old:]
        keep = self.n + 1
        out = pd.DataFrame({"capture": key[0], "window": rows["window"], "flow_id": rows["flow_id"], "score": score})
        return out, ([float(v) for v in ts[-keep:]], [float(v) for v in te[-keep:]])


class Hysteresis(ClosedWindows):
    """Two-level alerts from counters of consecutive windows above each threshold."""

    columns = {"pos_in_session": "bigint", "risk": "double", "early": "double"}
    memory = {"hot": "bigint", "warm": "bigint"}

    def __init__(self, cfg: EngineConfig, threshold: float, early: float):
        super().__init__(cfg.window_seconds, cfg.gap_windows + 1)  # the session is over
        self.threshold, self.early, self.k = threshold, early, cfg.hysteresis

    @staticmethod
    def _run(flags: np.ndarray, start: int) -> np.ndarray:
        index = np.arange(len(flags))
        last_off = np.maximum.accumulate(np.where(flags, -1, index))
        return np.where(last_off < 0, index + 1 + start, index - last_off)

    def advance(self, key, rows, memory):
        rows = rows.sort_values("pos_in_session", kind="stable")
        hot0, warm0 = memory or (0, 0)
        hot = self._run((rows["risk"] >= self.threshold).to_numpy(), hot0)
        warm = self._run((rows["early"] >= self.early).to_numpy(), warm0)
        level = np.where(hot >= self.k, 2, np.where(warm >= self.k, 1, 0))
        out = pd.DataFrame({"session_key": key[0], "pos_in_session": rows["pos_in_session"], "level": level})
        return out, (int(hot[-1]), int(warm[-1]))


class AdaptiveThreshold(ClosedWindows):
    """Threshold before each window from the last ``history`` negatives of the session (``functions.order_window``)."""

    columns = {"pos_in_session": "bigint", "score": "double", "y": "boolean"}
    memory = {"scores": "array<double>"}

    def __init__(self, cfg: EngineConfig, budget: float, history: int, least: int, fallback: float):
        super().__init__(cfg.window_seconds, cfg.gap_windows + 1)
        self.budget, self.history, self.least, self.fallback = budget, history, least, fallback

    def advance(self, key, rows, memory):
        rows = rows.sort_values("pos_in_session", kind="stable")
        held = np.asarray(memory[0] if memory else [], float)
        negative = ~rows["y"].to_numpy(bool)
        scores = np.concatenate([held, rows["score"].to_numpy()[negative]])
        seen = len(held) + np.cumsum(negative) - negative
        found = rolling_thresholds(scores, seen, self.budget, self.history, self.least)
        out = pd.DataFrame({"session_key": key[0], "pos_in_session": rows["pos_in_session"],
                            "threshold": np.where(np.isnan(found), self.fallback, found)})
        return out, ([float(v) for v in scores[-self.history:]],)


def _keyed(rows: DataFrame, keys: list[str], processor: ClosedWindows, schema: str) -> DataFrame:
    """``rows`` need ``window``, the processor's columns, and an ``event_time`` with a watermark."""
    used = dict.fromkeys([*keys, "window", "event_time", *processor.columns])
    return rows.select(*used).groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def new_pairs(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    return _keyed(flows, ["capture", "src_ip", "dst_ip"], NewPairs(cfg),
                  "capture string, src_ip string, dst_ip string, window bigint, is_new boolean")


def beacon_scores(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    return _keyed(flows, ["capture", "src_ip", "dst_ip", "dst_port"], Beacons(cfg),
                  "capture string, window bigint, flow_id bigint, score double")


def two_level(scored: DataFrame, cfg: EngineConfig, threshold: float, early: float) -> DataFrame:
    """``scored(session_key, pos_in_session, window, event_time, risk, early)``."""
    return _keyed(scored, ["session_key"], Hysteresis(cfg, threshold, early),
                  "session_key string, pos_in_session bigint, level int")


def adaptive_threshold(scored: DataFrame, cfg: EngineConfig, budget: float, fallback: float, history: int = 500,
                       least: int = 20) -> DataFrame:
    """``scored(session_key, pos_in_session, window, event_time, score, y)``; ``fallback`` until enough negatives came."""
    return _keyed(scored, ["session_key"], AdaptiveThreshold(cfg, budget, history, least, fallback),
                  "session_key string, pos_in_session bigint, threshold double")
