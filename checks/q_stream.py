"""Streaming operators over the events table, delivered in time order in several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_metrics import _LEVEL, scored
from checks.q_states import KEYS
from checks.registry import CFG, big, flows, query, r6
from checks.sqltext import with_parts
from netloom.operators.features import assign_windows
from netloom.session import scratch_path
from netloom.streaming import state as ss
from netloom.streaming import windows as sw
from netloom.streaming.run import run_available

WIN = big("win", '"window"')
FILES = 8  # of a time range, and of a micro-batch


def _time_files(spark, df, order: str, parts: int = 3):
    """Consecutive time ranges, written one after the other: batches arrive as a live stream would."""
    path = scratch_path(spark, "feed")
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) / parts
    for i in range(parts):
        here = F.col(order) >= low + i * step
        if i < parts - 1:
            here = here & (F.col(order) < low + (i + 1) * step)
        df.filter(here).repartition(FILES).write.mode("append").parquet(path)
    return path, df.schema


def _feed(spark, sf_dir):
    return assign_windows(flows(spark, sf_dir), CFG)


def _closing(df):
    """One late-dated flow of a capture of its own: the watermark closes every real window, and never this one."""
    last = df.orderBy(F.desc("ts")).limit(1)
    later = last.withColumns({"ts": F.col("ts") + 40 * CFG.window_seconds, "flow_id": F.lit(-1).cast("bigint"), "capture": F.lit("end")})
    return assign_windows(later, CFG).select(*df.columns)


def _run(spark, sf_dir, transform, stateful=False, closing=True):
    df = _feed(spark, sf_dir)
    path, schema = _time_files(spark, df, "ts")
    if closing:
        # A later batch: written afterwards, so the file source picks it up last.
        _closing(df).coalesce(1).write.mode("append").parquet(path)
    return run_available(spark, path, schema, transform, stateful, FILES)


def _run_scored(spark, df, transform):
    """Scored windows as a stream, ended by one row of a session that never closes."""
    path, schema = _time_files(spark, df, "window")
    end = df.orderBy(F.desc("window")).limit(1).withColumns({
        "session_key": F.lit("end"), "window": F.col("window") + 40})
    end.coalesce(1).write.mode("append").parquet(path)
    time = F.timestamp_seconds(F.col("window") * int(CFG.window_seconds))
    return run_available(spark, path, schema, lambda s: transform(s.withColumn("event_time", time).withWatermark("event_time", "1 day")), True, FILES)


@query("stream_states", with_parts(f"""
select capture, {WIN}, {big('count(*)', 'n_flows')}, {r6('sum(fwd_bytes + bwd_bytes)', 'bytes_total')}, {r6('avg(duration)', 'duration_mean')},
  {r6('avg((syn_count > 0 and ack_count <= 0)::int)', 'unanswered_syn_frac')}, {big('count(*) filter (is_attack)', 'n_attack_flows')},
  {big('max(stage_no)', 'stage_now')} from flows group by capture, win"""))
def stream_states(spark, sf_dir):
    out = _run(spark, sf_dir, lambda s: sw.tumbling_states(s, CFG, "1 day"))
    return out.filter(F.col("window") <= _last_window(spark, sf_dir))


def _last_window(spark, sf_dir):
    return _feed(spark, sf_dir).agg(F.max("window").alias("w")).scalar()


@query("stream_host_maxima", with_parts(f"""
select capture, {WIN}, {big('max(n)', 'flows_per_host_max')}, {big('max(h)', 'half_open_max')}, {big('count(*)', 'unique_src_hosts')} from (
  select capture, win, src_ip, count(*) as n, count(*) filter (syn_count > 0 and ack_count <= 0) as h from flows group by all)
group by capture, win"""))
def stream_host_maxima(spark, sf_dir):
    out = _run(spark, sf_dir, lambda s: sw.host_maxima(s, CFG, "1 day"))
    return out.filter(F.col("window") <= _last_window(spark, sf_dir))


@query("stream_sessions", with_parts(f"""
select s.capture, {big('count(f.flow_id)', 'n_flows')}, {big('s.lo', 'first_window')}, {big('s.hi', 'last_window')}
from sess s join flows f on f.capture = s.capture and f.win between s.lo and s.hi group by s.capture, s.lo, s.hi"""))
def stream_sessions(spark, sf_dir):
    out = _run(spark, sf_dir, lambda s: sw.sessions(s, CFG, "1 day"))
    return out.filter(F.col("first_window") <= _last_window(spark, sf_dir))


@query("stream_duplicates", with_parts("select capture, cast(count(*) as bigint) as flows from flows group by capture"))
def stream_duplicates(spark, sf_dir):
    """Every flow delivered twice; each is kept once."""
    def twice(s):
        doubled = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
        return sw.drop_duplicates(doubled, "1 day").select("capture", "flow_id")
    return _run(spark, sf_dir, twice, closing=False).groupBy("capture").agg(F.count(F.lit(1)).alias("flows"))


@query("stream_new_pairs", with_parts(f"select capture, {WIN}, {r6('new_pair_frac', 'new_pair_frac')} from pairs"))
def stream_new_pairs(spark, sf_dir):
    out = _run(spark, sf_dir, lambda s: ss.new_pairs(sw.with_event_time(s, "1 day"), CFG), stateful=True)
    return out.groupBy(*KEYS).agg(F.avg(F.col("is_new").cast("double")).alias("new_pair_frac"))


@query("stream_beacons", with_parts(f"select capture, {WIN}, {big('flow_id', 'flow_id')}, {r6('score', 'score')} from beaconflows where score > 0"))
def stream_beacons(spark, sf_dir):
    out = _run(spark, sf_dir, lambda s: ss.beacon_scores(sw.with_event_time(s, "1 day"), CFG), stateful=True)
    return out.filter("score > 0")


@query("stream_two_level", with_parts(f"select session_key, {big('pos', 'pos_in_session')}, {big('level', 'level')} from lev", _LEVEL))
def stream_two_level(spark, sf_dir):
    df = scored(spark, sf_dir).select("session_key", "pos_in_session", "window", F.col("score").alias("risk"),
                                      F.col("score_b").alias("early"))
    return _run_scored(spark, df, lambda s: ss.two_level(s, CFG, 0.7, 0.5))


@query("stream_adaptive_threshold", with_parts(f"""
select t.session_key, {big('t.pos', 'pos_in_session')}, {r6('coalesce(case when len(h) >= 20 then h[cast(least(greatest(ceil((len(h) + 1) * (1.0::double - 0.05::double)), 1), len(h)) as bigint)] end, 0.9)', 'threshold')}
from (select t.session_key, t.pos, list_sort(list(n.score) filter (n.score is not null)) as h
  from (select *, coalesce(sum((not y)::int) over (partition by session_key order by pos rows between unbounded preceding and 1 preceding), 0) as seen
        from scored where valid_6) t
  left join (select session_key, score, row_number() over (partition by session_key order by pos) as i
             from scored where valid_6 and not y) n
    on n.session_key = t.session_key and n.i <= t.seen and n.i > t.seen - 50
  group by t.session_key, t.pos) t"""))
def stream_adaptive(spark, sf_dir):
    df = scored(spark, sf_dir).filter("valid").select("session_key", "pos_in_session", "window", "score", "y")
    return _run_scored(spark, df, lambda s: ss.adaptive_threshold(s, CFG, 0.05, 0.9, 50))
