"""Windows, labels, targets and the 92 features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import CFG, big, flows, query, r6
from checks.sqltext import feature_value, with_parts
from netloom import vocab
from netloom.operators import features as fx
from netloom.operators.features import assign_windows
from netloom.operators.labels import window_labels
from netloom.operators.timeline import any_attack_targets, compromise_onsets, label_spine, session_spine
from netloom.plans.build import build_windows, label_windows

KEYS = ["capture", "window"]


def windowed(spark, sf_dir):
    return assign_windows(flows(spark, sf_dir), CFG)


def labelled(spark, sf_dir):
    return label_windows(flows(spark, sf_dir), CFG)


@query("window_forecast", with_parts(f"""
select t.capture, {big('t.session', 'session')}, {big('t.win', '"window"')}, {r6('t.t', 't')},
  {big('t.n_flows', 'n_flows')}, {r6('coalesce(a.bytes_rate,0)', 'bytes_rate')},
  {r6('coalesce(a.packets_rate,0)', 'packets_rate')}, {r6('coalesce(a.unanswered_syn_frac,0)', 'unanswered_syn_frac')},
  {big('stage_now', 'stage_now')}, y_3, valid_3, y_6, valid_6, {big('time_to_compromise', 'time_to_compromise')}
from tgt t left join agg a on a.capture = t.capture and a.win = t.win"""))
def window_forecast(spark, sf_dir):
    """Flagship: what the traffic was in every window, and whether a compromise follows."""
    feats = fx.window_aggregates(windowed(spark, sf_dir), CFG)
    win = labelled(spark, sf_dir).join(feats, KEYS, "left")
    zero = [F.coalesce(n, F.lit(0.0)).alias(n) for n in ("bytes_rate", "packets_rate", "unanswered_syn_frac")]
    return win.select("capture", "session", "window", "t", "n_flows", *zero, "stage_now", "y_3", "valid_3",
                      "y_6", "valid_6", "time_to_compromise")


@query("session_spine", with_parts(
    f"select capture, {big('session', 'session')}, {big('win', '\"window\"')} from spine"))
def spine(spark, sf_dir):
    occupied = windowed(spark, sf_dir).select(*KEYS).distinct()
    return session_spine(occupied, CFG.gap_windows)


@query("attach_sessions", with_parts(f"""
select {big('f.flow_id', 'flow_id')}, f.capture, {big('f.win', '"window"')}, {big('s.session', 'session')}
from flows f left join spine s on s.capture = f.capture and s.win = f.win"""))
def attach(spark, sf_dir):
    f = windowed(spark, sf_dir).select("flow_id", *KEYS)
    return f.join(session_spine(f.select(*KEYS).distinct(), CFG.gap_windows), KEYS, "left").select(
        "flow_id", "capture", "window", "session")


@query("window_labels", with_parts(f"""
select capture, {big('win', '"window"')}, {big('n_flows', 'n_flows')}, {big('n_attack_flows', 'n_attack_flows')},
  {big('stage_now', 'stage_now')}, family_now, attempted_only from lab left join fam using (capture, win)"""))
def labels(spark, sf_dir):
    return window_labels(windowed(spark, sf_dir))


@query("idle_windows", with_parts(f"""
select capture, session_key, {big('win', '"window"')}, {r6('t', 't')}, {big('pos', 'pos_in_session')},
  {big('remaining', 'remaining')}, {big('n_flows', 'n_flows')}, {big('stage_now', 'stage_now')}, warmup,
  {r6('m_lookback', 'm_lookback')} from win"""))
def idle(spark, sf_dir):
    spine_ = label_spine(window_labels(windowed(spark, sf_dir)), CFG)
    return spine_.select("capture", "session_key", "window", "t", "pos_in_session", "remaining", "n_flows",
                         "stage_now", "warmup", "m_lookback")


@query("episodes", with_parts(f"""
select capture, {big('win', '"window"')}, {big('episode', 'episode')}, in_episode, is_onset, is_recurrence,
  is_stage_onset from epi"""))
def episodes(spark, sf_dir):
    return labelled(spark, sf_dir).select(*KEYS, "episode", "in_episode", "is_onset", "is_recurrence",
                                          "is_stage_onset")


@query("targets", with_parts(f"""
select capture, {big('win', '"window"')}, y_3, valid_3, y_6, valid_6,
  {big('time_to_compromise', 'time_to_compromise')}, {big('next_attack_stage', 'next_attack_stage')} from tgt"""))
def targets(spark, sf_dir):
    return labelled(spark, sf_dir).select(*KEYS, "y_3", "valid_3", "y_6", "valid_6", "time_to_compromise",
                                          "next_attack_stage")


@query("any_attack_targets", with_parts(f"""
select w.capture, {big('w.win', '"window"')}, w.remaining >= 6 as any_valid_6,
  w.remaining >= 6 and coalesce(max(a.stage_now) > 0, false) as any_6
from win w left join win a on a.session_key = w.session_key and a.pos > w.pos and a.pos <= w.pos + 6
group by w.capture, w.win, w.remaining"""))
def any_attack(spark, sf_dir):
    win = label_spine(window_labels(windowed(spark, sf_dir)), CFG)
    return any_attack_targets(win, 6).select(*KEYS, "any_valid_6", "any_6")


@query("compromise_onsets", with_parts(f"""
select w.capture, {big('w.win', '"window"')},
  w.stage_now >= 2 and (c_prev is null or pos - c_prev > 3) as is_compromise_onset,
  w.stage_now < 2 and (c_prev is null or pos - c_prev >= 3) as is_quiet from tgt w"""))
def onsets(spark, sf_dir):
    win = label_spine(window_labels(windowed(spark, sf_dir)), CFG)
    return compromise_onsets(win, CFG.onset_quiet).select(*KEYS, "is_compromise_onset", "is_quiet")


def _feature_query(name: str, names: list[str], make):
    body = ", ".join(r6(feature_value(n), n) for n in names)

    @query(name, with_parts(f"select capture, {big('win', '\"window\"')}, {body} from rawfeat"))
    def run(spark, sf_dir, names=tuple(names), make=make):
        df = make(windowed(spark, sf_dir))
        return df.select(*KEYS, *[F.coalesce(F.nanvl(F.col(n), F.lit(0.0)), F.lit(0.0)).alias(n) for n in names])


_GROUP = {g: [f.name for f in vocab.FEATURES if f.grp == g] for g in vocab.GROUPS}
_AGG = {"hosts": ["bidirectional_ratio_mean", "unidirectional_flow_frac", "empty_response_frac"],
        "ports": ["low_port_frac", "ephemeral_port_frac", "well_known_service_frac"]}
for _g in ("volume", "flags", "protocol", "timing", "packet"):
    _feature_query(f"feat_{_g}", _GROUP[_g], lambda f: fx.window_aggregates(f, CFG))
_feature_query("feat_traffic_shape", [*_AGG["hosts"], *_AGG["ports"], "auth_short_frac", "smtp_frac"],
               lambda f: fx.window_aggregates(f, CFG))
_CELL = ["unique_src_hosts", "unique_dst_hosts", "unique_dst_ports", "fanout_max", "fanout_mean",
         "ports_per_src_max", "ports_per_src_mean", "flows_per_host_max"]
_feature_query("feat_hosts_ports", _CELL, lambda f: fx.cell_features(f, CFG))
_feature_query("feat_entropy", ["dst_port_entropy", "dst_ip_entropy", "src_ip_entropy"],
               lambda f: fx.cell_features(f, CFG))
_feature_query("feat_access", ["auth_conn_max", "web_conn_max", "half_open_max", "icmp_sweep_max"],
               lambda f: fx.cell_features(f, CFG))
_feature_query("feat_lateral", _GROUP["lateral"], lambda f: fx.cell_features(f, CFG))
_feature_query("feat_exfil", _GROUP["exfil"], lambda f: fx.cell_features(f, CFG))
_feature_query("feat_c2_dns", ["dns_max"], lambda f: fx.cell_features(f, CFG))
_feature_query("feat_src_ports", ["unique_src_ports", "src_port_entropy"], lambda f: fx.source_ports(f))
_feature_query("feat_new_ports", ["new_dst_port_frac"], lambda f: fx.port_novelty(f))
_feature_query("feat_new_pairs", ["new_pair_frac", "new_int_pairs"], lambda f: fx.pair_novelty(f, CFG))


def _with_all_windows(part):
    def make(f):
        return f.select(*KEYS).distinct().join(part(f), KEYS, "left")
    return make


_feature_query("feat_sequential_ports", ["seq_port_score"], _with_all_windows(lambda f: fx.sequential_ports(f, CFG)))
_feature_query("feat_beacon", ["beacon_max", "beacon_pairs"], _with_all_windows(lambda f: fx.beacons(f, CFG)))


@query("beacon_flows", with_parts(f"""
select capture, {big('win', '"window"')}, {big('flow_id', 'flow_id')}, {r6('score', 'score')}
from beaconflows where score > 0"""))
def beacon_flows(spark, sf_dir):
    return fx.beacon_scores(windowed(spark, sf_dir), CFG).filter("score > 0").select(*KEYS, "flow_id", "score")


@query("network_states", with_parts(
    f"select capture, session_key, {big('win', '\"window\"')}, " + ", ".join(r6(n, n) for n in vocab.FEATURE_NAMES)
    + f""", {r6('m_packet', 'm_packet')}, {r6('m_ip', 'm_ip')}, {r6('m_lookback', 'm_lookback')}, warmup,
  {big('n_flows', 'n_flows')}, {big('stage_now', 'stage_now')}, family_now, {big('episode', 'episode')},
  is_onset, y_6, valid_6 from feat"""))
def network_states(spark, sf_dir):
    """The complete windows table: 92 features, masks, labels, episodes and targets."""
    return build_windows(flows(spark, sf_dir), CFG).select(
        "capture", "session_key", "window", *vocab.FEATURE_NAMES, "m_packet", "m_ip", "m_lookback", "warmup",
        "n_flows", "stage_now", "family_now", "episode", "is_onset", "y_6", "valid_6")

