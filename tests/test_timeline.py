"""Episodes, onsets, targets, alerts and lead times against plain loops over random stage series."""

from dataclasses import replace
from random import Random

import pytest
from pyspark.sql import functions as F

from netloom.config import EngineConfig
from netloom.operators import alerts as al
from netloom.operators import metrics as mt
from netloom.operators import timeline as tl

CFG = EngineConfig()
SCHEMA = ("capture string, session int, session_key string, window bigint, pos_in_session bigint, remaining bigint,"
          " stage_now int")


def draw_sessions(seed, n=60):
    """Random sessions of stages: quiet stretches, single windows and runs, of stages 0 to 6."""
    draw, out = Random(seed), {}
    for i in range(n):
        stages = []
        while len(stages) < draw.randrange(1, 34):
            stages += [draw.choice((0, 0, 0, 1, 2, 4, 6))] * draw.randrange(1, 6)
        out[f"cap{i // 3}", i % 3] = stages
    return out


@pytest.fixture(scope="module")
def sessions():
    return draw_sessions(20)


@pytest.fixture(scope="module")
def windows(spark, sessions):
    rows, at = [], {}
    for (capture, number), stages in sessions.items():
        for pos, stage in enumerate(stages):
            window = at[capture] = at.get(capture, -1) + 1
            rows.append((capture, number, f"{capture}#{number}", window, pos, len(stages) - 1 - pos, stage))
    return spark.createDataFrame(rows, SCHEMA).cache()


def by_session(df, *names):
    got = {}
    for r in df.orderBy("capture", "window").select("capture", "session", *names).collect():
        got.setdefault((r["capture"], r["session"]), []).append(tuple(r)[2:] if len(names) > 1 else r[2])
    return got


def expect(sessions, rule):
    return {key: [rule(stages, t) for t in range(len(stages))] for key, stages in sessions.items()}


def last_before(stages, t, test):
    return next((i for i in range(t - 1, -1, -1) if test(stages[i])), None)


def first_after(stages, t, test):
    return next((i for i in range(t + 1, len(stages)) if test(stages[i])), None)


def attack(stage):
    return stage > 0


def compromise(stage):
    return stage >= 2


@pytest.mark.parametrize("merge,quiet", [(0, 1), (2, 4), (5, 3)])
def test_episodes(windows, sessions, merge, quiet):
    def rule(stages, t):
        a, b = last_before(stages, t, attack), first_after(stages, t, attack)
        gap = t if a is None else t - a - 1
        start = attack(stages[t]) and (a is None or gap > merge)
        inside = attack(stages[t]) or (a is not None and b is not None and b - a - 1 <= merge)
        again = attack(stages[t]) and t > 0 and not attack(stages[t - 1]) and not start
        return inside, start and gap >= quiet, again

    out = tl.episodes(windows, replace(CFG, episode_merge_gap=merge, onset_quiet=quiet))
    assert by_session(out, "in_episode", "is_onset", "is_recurrence") == expect(sessions, rule)


def test_episode_numbers_count_starts(windows, sessions):
    out = by_session(tl.episodes(windows, replace(CFG, episode_merge_gap=2, onset_quiet=1)), "episode")
    number = {}
    for (capture, session), stages in sessions.items():
        want = []
        for t, stage in enumerate(stages):
            a, b = last_before(stages, t, attack), first_after(stages, t, attack)
            if attack(stage) and (a is None or t - a - 1 > 2):
                number[capture] = number.get(capture, -1) + 1
            inside = attack(stage) or (a is not None and b is not None and b - a - 1 <= 2)
            want.append(number[capture] if inside else -1)
        assert out[capture, session] == want


def test_stage_onsets(windows, sessions):
    def rule(stages, t):
        seen = last_before(stages, t, lambda s: s == stages[t])
        return attack(stages[t]) and (seen is None or t - seen > 4)

    assert by_session(tl.stage_onsets(windows, 4), "is_stage_onset") == expect(sessions, rule)


@pytest.mark.parametrize("k", [1, 4])
def test_targets(windows, sessions, k):
    def rule(stages, t):
        hit, stage = first_after(stages, t, compromise), first_after(stages, t, attack)
        known = len(stages) - 1 - t >= k
        any_soon = stage is not None and stage - t <= k
        return (known, known and hit is not None and hit - t <= k, -1 if hit is None else hit - t,
                0 if stage is None else stages[stage], known and any_soon)

    out = tl.any_attack_targets(tl.forecast_targets(windows, (k,)), k)
    names = (f"valid_{k}", f"y_{k}", "time_to_compromise", "next_attack_stage", f"any_{k}")
    assert by_session(out, *names) == expect(sessions, rule)


@pytest.mark.parametrize("quiet", [1, 5])
def test_compromise_onsets(windows, sessions, quiet):
    def rule(stages, t):
        a, now = last_before(stages, t, compromise), compromise(stages[t])
        return now and (a is None or t - a > quiet), not now and (a is None or t - a >= quiet)

    out = tl.compromise_onsets(windows, quiet)
    assert by_session(out, "is_compromise_onset", "is_quiet") == expect(sessions, rule)


@pytest.mark.parametrize("k", [1, 3])
def test_sustained_alerts_and_their_score(windows, sessions, k):
    def rule(stages, t):
        return t + 1 >= k and all(s >= 2 for s in stages[t + 1 - k:t + 1])

    want = expect(sessions, rule)
    assert by_session(al.sustained(windows, F.col("stage_now") >= 2, k, "held"), "held") == want
    score = al.sustained_score(windows.withColumn("score", F.col("stage_now") / 8.0), "score", k, "least")
    assert by_session(score.withColumn("held", F.coalesce(F.col("least") >= 0.25, F.lit(False))), "held") == want


def test_lead_times(windows, sessions):
    marked = tl.compromise_onsets(windows, 2)
    got = {(r["session_key"], r["pos_in_session"]): (r["lead_windows"], r["detected"]) for r in mt.lead_times(
        marked, F.col("stage_now") == 1, "is_compromise_onset", 3, 1, grace=2).collect()}
    want = {}
    for (capture, number), stages in sessions.items():
        for t, stage in enumerate(stages):
            a = last_before(stages, t, compromise)
            if not compromise(stage) or a is not None and t - a <= 2:
                continue
            run = 0
            while t - 1 - run >= 0 and stages[t - 1 - run] == 1:
                run += 1
            late = any(s == 1 for s in stages[t:t + 3])
            want[f"{capture}#{number}", t] = (min(run, 3), run > 0 or late)
    assert got == want and any(lead for lead, _ in want.values())


def test_spine_fills_idle_windows_and_splits_sessions(spark):
    draw = Random(4)
    held = sorted(draw.sample(range(200), 40))
    occupied = spark.createDataFrame([("c", w, w * 10) for w in held], "capture string, window bigint, x int")
    session, want = 0, []
    for w, following in zip(held, [*held[1:], None]):
        want.append((w, session, w * 10))
        if following is not None and following - w > 4:
            session += 1
        elif following is not None:
            want += [(i, session, None) for i in range(w + 1, following)]
    got = tl.session_spine(occupied, 4).orderBy("window").collect()
    assert [(r["window"], r["session"], r["x"]) for r in got] == want


def test_alert_log_lists_runs(windows, sessions):
    leveled = windows.withColumn("level", F.when(F.col("stage_now") > 2, 2).otherwise(F.least("stage_now", F.lit(1)))).withColumns(
        {"t": F.col("window") * 10.0, "risk": (F.col("window") * 7 % 11) / 11.0})
    got = {(r["level"], r["from_t"], r["to_t"], r["peak"], r["session_key"]) for r in al.alert_log(leveled, CFG).collect()}
    want, at = set(), {}
    for (capture, number), stages in sessions.items():
        run = None
        for stage in [*stages, None]:
            window = at.get(capture, 0)
            level = None if stage is None else 2 if stage > 2 else min(stage, 1)
            if run and level != run[0]:
                want.add((run[0], run[1] * 10.0, (window - 1) * 10.0, max(w * 7 % 11 / 11.0 for w in range(run[1], window)), f"{capture}#{number}"))
                run = None
            if level and not run:
                run = (level, window)
            if stage is not None:
                at[capture] = window + 1
    assert got == want
