"""Transitions, next-stage forecasts and Spark ML baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_metrics import part, scored
from checks.q_splits import HORIZONS, MASK, NAMES, STATE_PARTS, binned_states, bins_table, scaled_state
from checks.q_states import KEYS
from checks.registry import CFG, big, query, r6, stored
from checks.sqltext import with_parts
from netloom import vocab
from netloom.operators import calibration as ca
from netloom.operators import dynamics as dy
from netloom.operators import metrics as mt
from netloom.operators import models as md
from netloom.operators import normalise as nm
from netloom.operators import transitions as tr

WIN = big("win", '"window"')
K = 3

_PROG = ("prog", """select *, max(stage_now) over w as progress, lead(stage_now) over s as next_stage,
  lag(stage_now) over s as prev_stage
from split window s as (partition by session_key order by pos),
  w as (partition by session_key order by pos rows between 7 preceding and current row)""")
_STEP = ("stepcounts", """select stage_now as z, progress as p, next_stage as s, count(*) as n from prog
where split = 'train' and next_stage is not null group by 1, 2, 3""")
_base = ", ".join(f"({z}, {s}, {v}::double)" for z, row in enumerate(vocab.TRANSITION_PRIOR) for s, v in enumerate(row))
_TABLE = ("ttable", f"""
select z, p, s, (coalesce(n, 0) + 20.0::double * pr) / sum(coalesce(n, 0) + 20.0::double * pr) over (partition by z, p) as pt
from (select z, p, s, v * e / sum(v * e) over (partition by z, p) as pr from (
    select b.z, g.p, b.s, b.v / sum(b.v) over (partition by b.z, g.p) as v,
      case when g.p >= 1 and b.s > g.p then exp(0.5::double) else 1.0 end as e
    from (values {_base}) b(z, s, v) cross join (select unnest(generate_series(0, 6)) as p) g))
left join stepcounts using (z, p, s)""")
_D0 = ("d0", """select z as z0, greatest(p, z) as p0, z, greatest(p, z) as p, 1.0::double as mass, 1.0::double as nohit
from (select unnest(generate_series(0, 6)) as z) a cross join (select unnest(generate_series(0, 6)) as p) b
where p >= z""")


def _step(a: str, b: str):
    return (b, f"""select z0, p0, t.s as z, greatest(d.p, t.s) as p, sum(d.mass * t.pt) as mass,
  sum(d.nohit * t.pt * (t.s < 2)::int) as nohit
from {a} d join ttable t on t.z = d.z and t.p = d.p group by z0, p0, t.s, greatest(d.p, t.s)""")


_CHAIN = (_PROG, _STEP, _TABLE, _D0, _step("d0", "d1"), _step("d1", "d2"), _step("d2", "d3"))
_BELIEF = ("belief", """select pr.*, z, case when z = stage_now then 0.7::double else 0.05::double end as b
from prog pr cross join (select unnest(generate_series(0, 6)) as z) g""")
# Expected windows per stage over the horizon, by start state.
_MASS = ("startmass", """select z0, p0, z as s, sum(mass) as m from (
  select * from d1 union all select * from d2 union all select * from d3) group by z0, p0, z""")
_STAGEMASS = ("stagemass", """select session_key, pos, win, capture, split, stage_now, progress, is_stage_onset, s, sum(b * m) as m
from belief join startmass on z0 = z and p0 = greatest(progress, z) group by all""")
_ONSETS = ("onsetcounts", """select z, p, s, coalesce(n, 0) + 1 as n
from (select unnest(generate_series(0, 6)) as z) a cross join (select unnest(generate_series(0, 6)) as p) b
cross join (select unnest(generate_series(0, 6)) as s) c
left join (select r.prev_stage as z, a.progress as p, r.stage_now as s, count(*) as n
  from prog r join prog a on a.session_key = r.session_key and a.pos = r.pos - 1
  where r.is_stage_onset and r.split = 'train' group by 1, 2, 3) using (z, p, s)""")


def forecast_table(spark, sf_dir):
    """Windows with a nowcast belief, the progress, and the count-based forecast tables."""
    df = scored(spark, sf_dir)
    belief = F.array(*[F.when(F.col("stage_now") == z, 0.7).otherwise(0.05) for z in range(vocab.N_STAGES)])
    ready = tr.progress(df.withColumn("nowcast", belief), CFG.context)
    table = stored(spark, sf_dir, "ttable", lambda: tr.transition_table(tr.step_counts(df, CFG.context)))
    return ready, tr.propagate(table, K)


@query("progress", with_parts(f"select capture, {WIN}, {big('progress', 'progress')} from prog", _PROG))
def progress(spark, sf_dir):
    return tr.progress(scored(spark, sf_dir), CFG.context).select(*KEYS, "progress")


@query("transition_table", with_parts(
    f"select {big('z', 'stage')}, {big('p', 'progress')}, {big('s', 'next_stage')}, {r6('pt', 'p')} from ttable",
    *_CHAIN[:3]))
def transition_table(spark, sf_dir):
    return tr.transition_table(tr.step_counts(scored(spark, sf_dir), CFG.context))


@query("rollout_risk", with_parts(f"""
select capture, {WIN}, {r6('sum(b * h1)', 'p_within_1')}, {r6('sum(b * h3)', 'p_within_3')}
from belief join (select z0, p0, 1 - sum(nohit) as h1 from d1 group by z0, p0) a
    on a.z0 = z and a.p0 = greatest(progress, z)
  join (select z0, p0, 1 - sum(nohit) as h3 from d3 group by z0, p0) c on c.z0 = z and c.p0 = greatest(progress, z)
group by capture, win""", *_CHAIN, _BELIEF))
def rollout(spark, sf_dir):
    df, forecast = forecast_table(spark, sf_dir)
    return tr.rollout_risk(df, forecast, (1, 3)).select(*KEYS, "p_within_1", "p_within_3")


@query("markov_onsets", with_parts(
    f"select {big('z', 'stage')}, {big('p', 'progress')}, {big('s', 'next_stage')}, {big('n', 'n')} from onsetcounts",
    _PROG, _ONSETS))
def markov(spark, sf_dir):
    return tr.onset_counts(scored(spark, sf_dir), CFG.context)


_NEXT = ("nextp", """select capture, win, s, v / greatest(sum(v) over (partition by capture, win), 1e-12) as v from (
  select m.capture, m.win, m.s, case when m.s = 0 or (m.stage_now > 0 and m.s = m.stage_now) then 0.0 else
    exp(0.25::double * ln(greatest(m.m, 1e-6)) + 0.75::double * ln(greatest(t.q, 1e-6))) end as v
  from stagemass m join (select z, p, s, n / sum(n) over (partition by z, p)::double as q from onsetcounts) t
    on t.z = m.stage_now and t.p = greatest(m.progress, m.stage_now) and t.s = m.s)""")


@query("next_stage_blend", with_parts(f"""
select capture, {WIN}, {big('arg_max(s, v)', 'heading_to')}, {r6('max(v)', 'heading_to_p')} from nextp
group by capture, win""", *_CHAIN, _BELIEF, _MASS, _STAGEMASS, _ONSETS, _NEXT))
def next_stage(spark, sf_dir):
    df, forecast = forecast_table(spark, sf_dir)
    ready = tr.horizon_stage_mass(df, forecast, K).withColumn("current", F.col("stage_now").cast("int"))
    out = tr.next_stage(ready, tr.onset_counts(scored(spark, sf_dir), CFG.context), CFG.next_stage_blend)
    return out.select(*KEYS, "heading_to", "heading_to_p")


# Ranked predictions at anchors one window before each test onset.
_ANCH = ("anch", """select a.session_key, a.pos, a.stage_now, a.progress, r.stage_now as truth
from prog a join prog r on r.session_key = a.session_key and r.pos = a.pos + 1
where r.is_stage_onset and a.split = 'test'""")


def _pick(source: str, value: str, cond: str) -> str:
    return f"""select session_key, pos, s from (select session_key, pos, s, row_number() over
  (partition by session_key, pos order by v desc, s) as rn from (
  select h.session_key, h.pos, x.s, case when x.s = 0 or (h.stage_now > 0 and x.s = h.stage_now) then 0.0
    else {value} end as v from anch h join {source} x on {cond})) where rn = 1"""


_PM = ("pickmodel", _pick("stagemass", "x.m", "x.session_key = h.session_key and x.pos = h.pos"))
_PK = ("pickmarkov", _pick("onsetcounts", "x.n::double", "x.z = h.stage_now and x.p = h.progress"))
_PG = ("pickmarginal", _pick("margin", "x.n::double", "true"))
_MARGIN = ("margin", "select s, sum(n) as n from onsetcounts group by s")


@query("next_stage_accuracy", with_parts(f"""
select {big('count(*)', 'n_transitions')}, {r6('avg((m.s = truth)::int)', 'model')}, {r6('avg((k.s = truth)::int)', 'markov')},
  {r6('avg((g.s = truth)::int)', 'marginal')}
from anch h join pickmodel m using (session_key, pos) join pickmarkov k using (session_key, pos)
join pickmarginal g using (session_key, pos)""", *_CHAIN, _BELIEF, _MASS, _STAGEMASS, _ONSETS, _ANCH, _PM, _PK, _PG,
                                         _MARGIN))
def accuracy(spark, sf_dir):
    df, forecast = forecast_table(spark, sf_dir)
    ready = tr.horizon_stage_mass(df, forecast, K)
    return tr.transition_accuracy(ready, tr.onset_counts(scored(spark, sf_dir), CFG.context), 1)


_CAND = ("cand", """select h.session_key, h.pos, h.stage_now, h.truth, m.s,
  case when m.s = 0 or (h.stage_now > 0 and m.s = h.stage_now) then 0.0 else m.m end as w0,
  case when m.s = 0 or (h.stage_now > 0 and m.s = h.stage_now) then 0.0 else o.n::double end as t0
from anch h join stagemass m on m.session_key = h.session_key and m.pos = h.pos
join onsetcounts o on o.z = h.stage_now and o.p = greatest(h.progress, h.stage_now) and o.s = m.s""")
_NORM = ("norm", """select *, greatest(w0 / sum(w0) over a, 1e-6) as w, greatest(t0 / sum(t0) over a, 1e-6) as t
from cand window a as (partition by session_key, pos)""")


def _first(value: str) -> str:
    return f"list(s order by {value} desc, s)[1]"


_blends = ", ".join(_first(f"case when s = 0 then 0.0 else exp({w}::double * ln(w) + {1 - w}::double * ln(t)) end")
                    + f" as b{int(100 * w)}" for w in (0.25, 0.5, 0.75))
_BEST = ("best", f"""select truth, {_first('w0')} as wm, {_first('t0')} as tab, {_blends} from norm
group by session_key, pos, truth""")


@query("predictor_comparison", with_parts(f"""
select {big('count(*)', 'n')}, {r6('avg((wm = truth)::int)', 'wm')}, {r6('avg((tab = truth)::int)', 'table_now')},
  {r6('avg((tab = truth)::int)', 'markov_true')}, {r6('avg((b25 = truth)::int)', 'blend_25')},
  {r6('avg((b50 = truth)::int)', 'blend_50')}, {r6('avg((b75 = truth)::int)', 'blend_75')}, {r6('1', 'current_stage_correct')}
from best""", *_CHAIN, _BELIEF, _MASS, _STAGEMASS, _ONSETS, _ANCH, _CAND, _NORM, _BEST))
def comparison(spark, sf_dir):
    df, forecast = forecast_table(spark, sf_dir)
    ready = tr.horizon_stage_mass(df, forecast, K)
    return tr.predictor_comparison(ready, tr.onset_counts(scored(spark, sf_dir), CFG.context), 1)


_STEPM = ("stepmass", """select session_key, pos, stage_now, k, s, sum(b * mass) as m from belief join (
  select z0, p0, z as s, 1 as k, sum(mass) as mass from d1 group by 1, 2, 3
  union all select z0, p0, z, 2, sum(mass) from d2 group by 1, 2, 3
  union all select z0, p0, z, 3, sum(mass) from d3 group by 1, 2, 3) on z0 = z and p0 = greatest(progress, z)
where split = 'test' and s > 0 group by all""")


@query("attack_step_accuracy", with_parts(f"""
select {big('count(*)', 'n_attack_steps')}, {r6('avg((named = f.stage_now)::int)', 'model')},
  {r6('avg((greatest(b.stage_now, 1) = f.stage_now)::int)', 'nowcast_carried_forward')}
from (select session_key, pos, k, stage_now, arg_max(s, m) as named from stepmass group by all) b
join win f on f.session_key = b.session_key and f.pos = b.pos + b.k and f.stage_now > 0""",
                                          *_CHAIN, _BELIEF, _STEPM))
def attack_steps(spark, sf_dir):
    df, forecast = forecast_table(spark, sf_dir)
    return tr.attack_step_accuracy(tr.step_stage_argmax(df, forecast, K), K)


@query("nowcast_macro_f1", with_parts(f"""
select {r6('avg(2.0::double * h / (t + p))', 'macro_f1')}, {big('count(*)', 'classes')} from (
  select c.stage_now, count(*) filter (a.stage_now = c.stage_now) as t,
    count(*) filter (a.guess = c.stage_now) as p,
    count(*) filter (a.stage_now = c.stage_now and a.guess = c.stage_now) as h
  from (select distinct stage_now from prog) c
  cross join (select stage_now, coalesce(prev_stage, 0) as guess from prog) a group by c.stage_now)""", _PROG))
def macro_f1(spark, sf_dir):
    from pyspark.sql import Window as W
    previous = F.lag("stage_now").over(W.partitionBy("session_key").orderBy("pos_in_session"))
    df = scored(spark, sf_dir).withColumn("guess", F.coalesce(previous, F.lit(0)))
    return mt.macro_f1(df, "stage_now", "guess")


# ------------------------------------------------------------------ model inputs and Spark ML
@query("history_stack", with_parts(f"""
select session_key, {big('pos', 'pos_in_session')}, {big('case when len(x) = 6 then list_sum(x) else -1 end', 'flows_in_stack')},
  {big('case when len(x) = 6 then x[1] else -1 end', 'oldest')}
from (select session_key, pos, list(n_flows) over (partition by session_key order by pos rows between 5 preceding
  and current row) as x from win)"""))
def stack(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("a", F.array(F.col("n_flows").cast("bigint")))
    out = md.stack_history(df, "a", 6, CFG.session_block)
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda s, v: s + v)
    return out.select("session_key", "pos_in_session", 
                      F.coalesce(total, F.lit(-1)).alias("flows_in_stack"),
                      F.coalesce(F.col("x")[0], F.lit(-1)).alias("oldest"))


@query("context_tensor", with_parts(f"""
select session_key, {big('pos', 'pos_in_session')}, {big('list_sum(x)', 'flows')}, {big('list_sum(y)', 'stages')}
from (select session_key, pos, list(n_flows) over w as x, list(stage_now) over w as y from win
  window w as (partition by session_key order by pos rows between 7 preceding and current row)) where len(x) = 8"""))
def context(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"a": F.col("n_flows").cast("bigint"), "b": F.col("stage_now").cast("bigint")})
    out = md.context_tensor(df, ["a", "b"], CFG.context, CFG.session_block)

    def total(i):
        return F.aggregate("context", F.lit(0).cast("bigint"), lambda s, v: s + v[i])
    return out.select("session_key", "pos_in_session", total(0).alias("flows"), total(1).alias("stages"))


def model_rows(spark, sf_dir):
    """Scaled, masked model inputs with target and split."""
    def build():
        return nm.model_input(scaled_state(spark, sf_dir)).withColumn("y", F.col("y_6"))
    return stored(spark, sf_dir, "inputs", build)


def _scores(spark, sf_dir, kind):
    def build():
        rows = model_rows(spark, sf_dir)
        if kind == "stack":
            rows = md.stack_history(rows.withColumnRenamed("x", "a"), "a", 6, CFG.session_block)
        train = rows.filter("split = 'train' and valid_6")
        model = md.fit_boosting(train, rounds=20) if kind == "boost" else md.fit_logistic(train)
        return md.predict(model, rows).select(*KEYS, "session_key", "pos_in_session", "split", "valid_6", "y", "score")
    return stored(spark, sf_dir, f"scores_{kind}", build)


@query("logistic_scores")
def logistic(spark, sf_dir):
    return _scores(spark, sf_dir, "logreg").select(*KEYS, "split", "score")


@query("logistic_stack_scores")
def logistic_stack(spark, sf_dir):
    return _scores(spark, sf_dir, "stack").select(*KEYS, "split", "score")


@query("boosting_scores")
def boosting(spark, sf_dir):
    return _scores(spark, sf_dir, "boost").select(*KEYS, "split", "score")


@query("hybrid_scores")
def hybrid(spark, sf_dir):
    a = _scores(spark, sf_dir, "logreg").withColumnRenamed("score", "s_a")
    b = _scores(spark, sf_dir, "boost").select(*KEYS, F.col("score").alias("s_b"))
    out = ca.hybrid_score(a.join(b, KEYS), "s_a", "s_b", valid="valid_6")
    return out.select(*KEYS, "s_a", "s_b", "hybrid")


_LOGIT = "ln(least(greatest(score, 0.0001), 0.9999) / (1 - least(greatest(score, 0.0001), 0.9999)))"
_NEWTON = (("counted", f"select {_LOGIT} as z, count(*)::double as n, sum(y::int)::double as p from cal group by 1"),
           ("newton0", "select 0.0::double as a, 0.0::double as b"),
           *[(f"newton{i}", f"""select a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) as a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) as b
  from (select a, b, sum((n * q - p) * z) + a / 1000 as ga, sum(n * q - p) as gb, sum(n * q * (1 - q) * z * z) + 0.001::double as haa,
      sum(n * q * (1 - q) * z) as hab, sum(n * q * (1 - q)) as hbb
    from (select *, 1 / (1 + exp(-(a * z + b))) as q from newton{i - 1} cross join counted) group by a, b)""") for i in range(1, 13)])


@query("platt_calibration", with_parts(f"""
select capture, {big('win', '"window"')}, {r6(f'1 / (1 + exp(-(a * {_LOGIT} + b)))', 'probability')}
from scored cross join newton12""", *_NEWTON))
def platt(spark, sf_dir):
    a, b = ca.fit_platt(part(spark, sf_dir, "calibration"))
    return scored(spark, sf_dir).select(*KEYS, ca.apply_platt(F.col("score"), a, b).alias("probability"))


ISOTONIC_PARTS = (
    ("iso_d", """select score, count(*) as w, sum(y::int) as s, row_number() over (order by score) as i,
  sum(count(*)) over (order by score) as cw, sum(sum(y::int)) over (order by score) as cs from cal group by score"""),
    # The min-max formula: the greatest, over starts, of the least mean, over ends, of all runs around a score.
    ("iso", """select score, max(least_) as v from (
    select d.score, a.i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)::double) as least_
    from iso_d d join iso_d a on a.i <= d.i join iso_d b on b.i >= d.i group by d.score, a.i) group by score"""))


@query("isotonic_calibration", with_parts(f"""
select capture, {big('win', '"window"')}, {r6("""case when x0 is null then v1 when x1 is null or v1 = v0 then v0
    else v0 + (v1 - v0) * (score - x0) / (x1 - x0) end""", 'probability')}
from (select s.*, lo.score as x0, lo.v as v0, hi.score as x1, hi.v as v1 from scored s
  left join iso lo on lo.score = (select max(score) from iso where iso.score <= s.score)
  left join iso hi on hi.score = (select min(score) from iso where iso.score > s.score))""", *ISOTONIC_PARTS))
def isotonic(spark, sf_dir):
    blocks = ca.isotonic(part(spark, sf_dir, "calibration"))
    return ca.apply_isotonic(scored(spark, sf_dir), blocks).select(*KEYS, "probability")


@query("nowcast_model")
def nowcast(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    model = md.fit_nowcast(rows.filter("split = 'train'"))
    out = tr.nowcast_progress(md.nowcast(model, rows), CFG.context)
    return out.select(*KEYS, F.col("nowcast")[0].alias("p_benign"), "progress")


@query("ridge_ar_nll")
def ridge(spark, sf_dir):
    """Gaussian bin likelihood of the state 1, 6 and 30 windows ahead under a ridge AR(6), per window."""
    states = binned_states(spark, sf_dir)
    found = {r["feature"]: r["edges"] for r in bins_table(spark, sf_dir).select("feature", "edges").collect()}
    edges, out = [found[n] for n in NAMES], None
    for k in HORIZONS:
        pairs = md.history_pairs(states, k, block=CFG.session_block)
        params = md.ridge_autoregression(pairs.filter("split = 'train'"), len(NAMES))
        rows = dy.autoregression_nll(pairs, params, edges, k)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("surprise", with_parts(f"""
select t.session_key, {big('t.pos', 'pos_in_session')}, {r6('-sum(ln(greatest(ph, 1e-4)) * mask) / greatest(sum(mask), 1)', 'surprise')}
from (select b.session_key, b.pos, b.feature, b.mask, (count(a.pos) + 0.5::double) / (8.0::double + 0.5::double * b.n_bins) as ph
  from b left join b a on a.session_key = b.session_key and a.feature = b.feature and a.bin = b.bin
    and a.pos between b.pos - 8 and b.pos - 1
  where b.pos >= 8 group by b.session_key, b.pos, b.feature, b.mask, b.n_bins) t
group by t.session_key, t.pos""", *STATE_PARTS, ("b", f"select session_key, pos, feature, bin, n_bins, {MASK} as mask from binned")))
def surprise(spark, sf_dir):
    return dy.surprise(binned_states(spark, sf_dir), CFG.context, CFG.session_block)
