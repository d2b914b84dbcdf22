"""Splits, scaling, bins and next-state likelihoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_states import KEYS, labelled
from checks.registry import CFG, big, query, r6, stored, stored_flows
from checks.sqltext import with_parts
from netloom import vocab
from netloom.operators import dynamics as dy
from netloom.operators import normalise as nm
from netloom.operators import splits as sp
from netloom.plans.build import build_windows

WIN = big("win", '"window"')


def split_table(spark, sf_dir):
    return sp.temporal_split(labelled(spark, sf_dir), CFG, CFG.primary_horizon)


def stored_split(spark, sf_dir):
    return stored(spark, sf_dir, "split", lambda: split_table(spark, sf_dir))


def datasets(df):
    return df.withColumn("dataset", F.when(F.col("capture") < "c3", "d0").otherwise("d1"))


@query("split_p1", with_parts(f"select capture, {WIN}, split, fit_row from split"))
def p1(spark, sf_dir):
    return split_table(spark, sf_dir).select(*KEYS, "split", "fit_row")


@query("split_sizes", with_parts(
    f"select split, {big('count(*)', 'rows')}, {big('count(*) filter (fit_row)', 'fit_rows')} from split group by split"))
def sizes(spark, sf_dir):
    return sp.split_sizes(stored_split(spark, sf_dir))


@query("split_lofo", with_parts(f"""
select s.capture, {big('s.win', '"window"')},
  case when touched then (case when s.pos >= 12 then 'test' end) else s.split end as split,
  s.fit_row and coalesce(s.family_now, '') <> 'Botnet' as fit_row
from split s join (
  select a.session_key, a.pos, count(b.pos) > 0 as touched from win a left join win b
    on b.session_key = a.session_key and b.family_now = 'Botnet' and b.pos between a.pos - 7 and a.pos + 6
  group by a.session_key, a.pos) t on t.session_key = s.session_key and t.pos = s.pos"""))
def lofo(spark, sf_dir):
    return sp.leave_family_out(labelled(spark, sf_dir), CFG, 6, "Botnet").select(*KEYS, "split", "fit_row")


@query("split_cross", with_parts(f"""
select capture, {WIN}, case when capture >= 'c3' then (case when pos >= 12 then 'test' end)
    when split in ('train', 'calibration') then split end as split,
  fit_row and capture < 'c3' as fit_row from split"""))
def cross(spark, sf_dir):
    df = sp.cross_dataset(datasets(labelled(spark, sf_dir)), CFG, 6, ["d0"], "d1")
    return df.select(*KEYS, "split", "fit_row")


@query("purge_check", with_parts(f"""
select a.session_key, {big('count(*)', 'rows')} from split a join split b on a.session_key = b.session_key
  and a.split = 'train' and b.split in ('calibration', 'test') and a.pos + 6 >= b.pos
group by a.session_key"""))
def purge(spark, sf_dir):
    bad = sp.purge_violations(stored_split(spark, sf_dir), 6)
    return bad.groupBy("session_key").agg(F.count(F.lit(1)).alias("rows"))


@query("split_dev", with_parts(f"""
select s.capture, {big('s.win', '"window"')}, case
    when split = 'train' and pos + 6 < hi - cast(trunc((hi - lo) * 0.2::double) as bigint) then 'train'
    when split = 'train' and pos >= hi - cast(trunc((hi - lo) * 0.2::double) as bigint) then 'calibration'
    when split = 'calibration' then 'test' end as split
from split s left join (select session_key, min(pos) as lo, max(pos) as hi from split where split = 'train'
                        group by session_key) r using (session_key)"""))
def dev(spark, sf_dir):
    return sp.development_split(stored_split(spark, sf_dir), 6).select(*KEYS, "split")


@query("thin_benign", with_parts(f"""
select capture, {WIN}, case when split = 'train' and not y_6 and stage_now = 0 and capture >= 'c3'
    and ('0x' || substr(md5(session_key || '|' || pos || '|0'), 1, 8))::bigint / 4294967296.0::double > 0.2
  then null else split end as split from split"""))
def thin(spark, sf_dir):
    from dataclasses import replace
    cfg = replace(CFG, benign_keep=(("d1", 0.2),))
    return sp.thin_benign(datasets(stored_split(spark, sf_dir)), cfg, 6).select(*KEYS, "split")


@query("split_spans", with_parts(f"""
select capture, {WIN}, case when pos < train_end then 'train' when pos < cal_end then 'calibration' else 'test' end
  as campaign_split from split"""))
def spans(spark, sf_dir):
    return sp.span_of_window(stored_split(spark, sf_dir), CFG).select(*KEYS, "campaign_split")


# ------------------------------------------------------------------ scaling and bins
NAMES = vocab.FEATURE_NAMES


def state_table(spark, sf_dir):
    """The whole windows table: all features (in single precision, as tables of states are stored) and masks, split."""
    def build():
        windows = sp.temporal_split(build_windows(stored_flows(spark, sf_dir), CFG), CFG, CFG.primary_horizon)
        return windows.withColumns({n: F.col(n).cast("float").cast("double") for n in NAMES})
    return stored(spark, sf_dir, "state", build)


_CELLS = ", ".join("{'feature': '%s', 'value': %s}" % (
    n, f"sign({n}) * ln(1 + abs({n}))" if n in vocab.LOG_FEATURES else n) for n in NAMES)
_KEPT = "capture, session_key, win, pos, split, fit_row, n_flows, warmup, y_6, m_packet, m_ip, m_lookback"
_FIT = "fit_row and (n_flows > 0 or (select count(*) < 100 from split where fit_row and n_flows > 0))"
_LONG = (("state", f"select {_KEPT}, " + ", ".join(f"cast(cast({n} as float) as double) as {n}" for n in NAMES) + " from feat"),
         ("long", f"select {_KEPT}, u.feature, u.value from (select {_KEPT}, unnest([{_CELLS}]) as u from state)"))
_SCALER = (*_LONG, ("scaler", f"""
select feature, quantile_cont(value, 0.5) as center,
  case when (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349::double > 1e-9
         then (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349::double
       when stddev_pop(value) > 1e-9 then stddev_pop(value) else 1.0 end as scale
from long where {_FIT} group by feature"""))


_ZL = ("zlong", """select l.*, least(greatest((l.value - s.center) / s.scale, -10.0), 10.0) as z
from long l join scaler s on s.feature = l.feature""")


@query("scaler_fit", with_parts(f"""
select feature, {r6('center', 'center')}, {r6('scale', 'scale')} from scaler""", *_SCALER))
def scaler_fit(spark, sf_dir):
    return nm.fit_scaler(nm.fit_rows(state_table(spark, sf_dir))).select("feature", "center", "scale")


_PIVOT = ", ".join(r6(f"max(z) filter (feature = '{n}')", n) for n in NAMES)


@query("scale_features", with_parts(f"select capture, {WIN}, {_PIVOT} from zlong group by capture, win", *_SCALER, _ZL))
def scale(spark, sf_dir):
    return scaled_state(spark, sf_dir).select(*KEYS, *NAMES)


_BACK = ", ".join(
    f"round(max(case when feature in ({', '.join(repr(x) for x in NAMES if x in vocab.LOG_FEATURES)}) "
    f"then sign(z*scale+center)*(exp(abs(z*scale+center))-1) else z*scale+center end) "
    f"filter (feature = '{n}') * 0.7310585::double, 3) + 0.0 as {n}" for n in NAMES)


@query("unscale_features", with_parts(
    f"select capture, {WIN}, {_BACK} from (select z.*, center, scale from zlong z join scaler using (feature))"
    " group by capture, win", *_SCALER, _ZL))
def unscale(spark, sf_dir):
    back = nm.unscale_wide(scaled_state(spark, sf_dir), stored_scaler(spark, sf_dir))
    return back.select(*KEYS, *[F.round(F.col(n) * 0.7310585, 3).alias(n) for n in NAMES])


_WARM = ("warm", """select session_key, feature, quantile_cont(value, 0.5) as own from long where warmup
group by session_key, feature having count(*) >= 10""")


@query("warmup_center", with_parts(
    f"select session_key, feature, {r6('own', 'center')} from warm", *_LONG, _WARM))
def warm(spark, sf_dir):
    return nm.warmup_centers(state_table(spark, sf_dir))


_WPIVOT = ", ".join(r6("max(least(greatest((value - coalesce(own, center)) / scale, -10.0), 10.0))"
                       f" filter (feature = '{n}')", n) for n in NAMES)


@query("scale_warmup", with_parts(f"""
select capture, {WIN}, {_WPIVOT} from long join scaler using (feature) left join warm using (session_key, feature)
group by capture, win""", *_SCALER, _WARM))
def scale_warm(spark, sf_dir):
    state = state_table(spark, sf_dir)
    scaler = stored_scaler(spark, sf_dir)
    return nm.scale_wide(state, scaler, centers=nm.warmup_centers(state)).select(*KEYS, *NAMES)


_EDGES = ("edges", "select feature, list_sort(list_distinct(quantile_cont(z, ["
          + ", ".join(f"{i / 16}" for i in range(1, 16)) + f"]))) as e from zlong where {_FIT} group by feature")
_BINNED = ("binned", """select z.*, len(list_filter(e, lambda x: x <= z)) as bin, len(e) + 1 as n_bins
from zlong z join edges using (feature)""")


def stored_scaler(spark, sf_dir):
    return stored(spark, sf_dir, "scaler", lambda: nm.fit_scaler(nm.fit_rows(state_table(spark, sf_dir))))


def scaled_state(spark, sf_dir):
    return stored(spark, sf_dir, "scaled", lambda: nm.scale_wide(state_table(spark, sf_dir), stored_scaler(spark, sf_dir)))


def bins_table(spark, sf_dir):
    def build():
        return nm.fit_bins(nm.unpivot(nm.fit_rows(scaled_state(spark, sf_dir)), NAMES, [], compressed=False))
    return stored(spark, sf_dir, "bins", build)


def binned_states(spark, sf_dir):
    """Windows with scaled values, bins and masks as arrays over all features."""
    return stored(spark, sf_dir, "binned", lambda: dy.binned_states(scaled_state(spark, sf_dir), bins_table(spark, sf_dir)))


@query("binner_fit", with_parts(f"""
select feature, {big('b.bin', 'bin')}, {r6('case when b.bin < len(e) then e[b.bin+1] end', 'upper')},
  {r6('coalesce(m.med, (case when b.bin = 0 then lo else e[b.bin] end + case when b.bin = len(e) then hi else e[b.bin+1] end) / 2)', 'center')}
from (select feature, e, unnest(generate_series(0, len(e))) as bin from edges) b
left join (select feature, bin, quantile_cont(z, 0.5) as med from binned where {_FIT} group by feature, bin) m
  using (feature, bin)
join (select feature, min(z) - 1e-6 as lo, max(z) + 1e-6 as hi from zlong where {_FIT} group by feature)
  using (feature)""", *_SCALER, _ZL, _EDGES, _BINNED))
def binner(spark, sf_dir):
    each = bins_table(spark, sf_dir).select("feature", "edges", F.posexplode("centers").alias("bin", "center"))
    return each.select("feature", "bin", F.get("edges", F.col("bin")).alias("upper"), "center")


@query("bin_index", with_parts(f"""
select capture, {WIN}, feature, {big('bin', 'bin')}, {big('n_bins', 'n_bins')} from binned""",
                               *_SCALER, _ZL, _EDGES, _BINNED))
def bin_of(spark, sf_dir):
    long = nm.unpivot(scaled_state(spark, sf_dir), NAMES, KEYS, compressed=False)
    return nm.assign_bins(long, bins_table(spark, sf_dir)).select(*KEYS, "feature", "bin", "n_bins")


HORIZONS = (1, 6, 30)
MASK = "case " + " ".join(
    f"when feature in ({', '.join(repr(f.name) for f in vocab.FEATURES if vocab.GROUP_MASK.get(f.grp) == m)}) then {m}"
    for m in vocab.MASKS) + " else 1.0 end"


def masked_rows(ks) -> tuple[tuple[str, str], ...]:
    """Likelihoods of every window, k after a whole context of eight windows, under that context and under its last one."""
    return (("b", f"select session_key, split, pos, feature, bin, n_bins, {MASK} as mask from binned"), ("nllrows", f"""
select k, session_key, pos, from_split, -sum(ln(greatest(ph, 1e-4)) * mask) / greatest(sum(mask), 1) as h,
  -sum(ln(greatest(pp, 1e-4)) * mask) / greatest(sum(mask), 1) as p
from (select k, t.session_key, t.pos, t.mask, any_value(a.split) filter (a.pos = t.pos - k) as from_split,
    case when bool_or(a.bin = t.bin) filter (a.pos = t.pos - k) then 0.9::double else 0.1::double / greatest(t.n_bins - 1, 1) end as pp,
    (count(*) filter (a.bin = t.bin) + 0.5::double) / (8.0::double + 0.5::double * t.n_bins) as ph
  from b t cross join (select unnest([{', '.join(map(str, ks))}]) as k) join b a on a.session_key = t.session_key
    and a.feature = t.feature and a.pos between t.pos - k - 7 and t.pos - k
  where t.pos - k >= 7 group by k, t.session_key, t.pos, t.feature, t.mask, t.n_bins)
group by k, session_key, pos, from_split"""))


STATE_PARTS = (*_SCALER, _ZL, _EDGES, _BINNED)


@query("next_state_nll", with_parts(f"""
select {big('k', 'k')}, session_key, {big('pos', 'pos_in_session')}, {r6('h', 'nll_history')}, {r6('p', 'nll_persistence')}
from nllrows""", *STATE_PARTS, *masked_rows(HORIZONS)))
def next_state(spark, sf_dir):
    """Likelihood of the state 1, 6 and 30 windows ahead under recent history and under persistence."""
    return dy.next_state_nll(binned_states(spark, sf_dir), HORIZONS, CFG.context, CFG.session_block)
