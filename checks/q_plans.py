"""Whole plans: evaluation, policy sweep, and the fitted forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import q_metrics as qm
from checks.q_metrics import scored
from checks.q_models import ISOTONIC_PARTS
from checks.q_splits import HORIZONS, NAMES, STATE_PARTS, binned_states, bins_table, masked_rows
from checks.registry import CFG, big, flows, query, r6, stored
from checks.sqltext import with_parts
from netloom.plans import analyse as an
from netloom.plans import evaluate as ev
from netloom.plans.build import build_windows

_BUD = ("budgets", """select unnest([0.03::double, 0.05::double, 0.1::double]) as budget,
  unnest(quantile_cont(score_b, [0.97, 0.95, 0.9])) as thr from cal
where not y and stage_now < 2 and (c_prev is null or pos - c_prev >= 3)""")
_LV = ("lv", """select *, case when two then 2 when one then 1 else 0 end as level from (
  select s.*, budget, thr, coalesce(score >= 0.7 and lag(score) over w >= 0.7, false) as two,
    coalesce(score_b >= thr and lag(score_b) over w >= thr, false) as one
  from scored s cross join budgets window w as (partition by budget, session_key order by pos))""")


@query("two_level_report", with_parts(f"""
select {r6('b.budget', 'budget')}, {r6('b.thr', 'early_threshold')}, {big('count(l.pos) filter (onset)', 'onsets')},
  {big('count(l.pos) filter (onset and warned)', 'warned')},
  {r6('avg((level = 1)::int) filter (quiet and not y)', 'false_rate')}, {r6('avg((level = 1)::int) filter (quiet and y)', 'hit_rate')},
  {r6('count(*) filter (quiet and not y and level = 1) / count(*)::double', 'false_per_hour')}
from budgets b join (select a.*, a.stage_now < 2 and (a.c_prev is null or a.pos - a.c_prev >= 3) as quiet,
    a.stage_now >= 2 and (a.c_prev is null or a.pos - a.c_prev > 3) as onset, coalesce(p.level > 0, false) as warned
  from lv a left join lv p on p.budget = a.budget and p.session_key = a.session_key and p.pos = a.pos - 1
  where a.split = 'test' and a.valid_6) l on l.budget = b.budget group by b.budget, b.thr""", _BUD, _LV))
def two_level_report(spark, sf_dir):
    return ev.two_level_report(scored(spark, sf_dir), CFG, (0.03, 0.05, 0.1), 0.7)


_TEST = ("tested", "select * from nllrows where from_split = 'test'")


@query("next_state_report", with_parts(f"""
select {big('k', 'k')}, {big('count(*)', 'n')}, {r6('avg(h)', 'nll_history')}, {r6('avg(p)', 'nll_persistence')}, {r6('avg(p - h)', 'gain')}
from tested group by k""", *STATE_PARTS, *masked_rows(HORIZONS), _TEST))
def next_state_report(spark, sf_dir):
    out = ev.next_state_report(binned_states(spark, sf_dir), HORIZONS, CFG)
    return out.select("k", "n", "nll_history", "nll_persistence", "gain")


@query("next_state_controls")
def next_state_controls(spark, sf_dir):
    """The same report with the ridge autoregression beside it."""
    edges = {r["feature"]: r["edges"] for r in bins_table(spark, sf_dir).select("feature", "edges").collect()}
    return ev.next_state_report(binned_states(spark, sf_dir), HORIZONS, CFG, [edges[n] for n in NAMES])


_GAIN = ("gain", """select session_key || '@' || cast(floor(pos / 20) as bigint) as block, p - h as g from tested""")
_NUM = ("numbered", """select block, s, c, row_number() over (order by substr(md5(block), 1, 2), block) - 1 as i
from (select block, sum(g) as s, count(*) as c from gain group by block)""")
_MEANS = ("means", """select boot, sum(n.s) / sum(n.c) as m from (
  select boot, cast(floor(('0x' || substr(md5(boot || '|' || i || '|0'), 1, 8))::bigint / 4294967296.0::double
    * (select count(*) from numbered)) as bigint) as pick
  from (select unnest(generate_series(0, 299)) as boot) b cross join numbered) d
join numbered n on n.i = d.pick group by boot""")


@query("next_state_interval", with_parts(f"""
select {big('1', 'k')}, {big('(select count(*) from gain)', 'n')}, {r6('(select avg(g) from gain)', 'gain')},
  {r6('quantile_cont(m, 0.025)', 'gain_low')}, {r6('quantile_cont(m, 0.975)', 'gain_high')} from means""",
                                       *STATE_PARTS, *masked_rows((1,)), _TEST, _GAIN, _NUM, _MEANS))
def next_state_interval(spark, sf_dir):
    return ev.next_state_report(binned_states(spark, sf_dir), (1,), CFG, block=20).select(
        "k", "n", "gain", "gain_low", "gain_high")


@query("fixed_threshold_report", with_parts(f"""
select {big('count(*) filter (score >= 0.6 and y)', 'tp')}, {big('count(*) filter (score >= 0.6 and not y)', 'fp')},
  {big('count(*) filter (score < 0.6 and y)', 'fn')}, {big('count(*) filter (score < 0.6 and not y)', 'tn')}
from scored where valid_6 and pos >= 12"""))
def fixed_threshold(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("valid and pos_in_session >= 12")
    return ev.fixed_threshold_report(rows, 0.6).select("tp", "fp", "fn", "tn")


def _metrics(part: str, names: list[str], sql: str) -> str:
    """One row of metrics as (part, metric, value) rows."""
    return (f"select '{part}' as part, unnest([{', '.join(repr(n) for n in names)}]) as metric, "
            f"unnest([{', '.join(f'cast({n} as double)' for n in names)}]) as value from ({sql})")


_RANKS = ["n", "positives", "auprc", "roc_auc"]
_POINT = ["tp", "fp", "fn", "tn", "brier", "precision", "recall", "f1", "fpr"]
_LEADS = ["n_onsets", "warned_before", "detected_within", "warned_before_frac", "detected_frac", "median_lead_windows", "mean_lead_windows"]
_ECE = """select {r} from (select least(cast(floor(score * 10) as bigint), 9) as bin, avg(score) as predicted,
  avg(y::int) as observed, count(*) as cnt from {t} group by 1)"""
_AT = [f"(select threshold from thr where budget = {b!r}::double)" for b in CFG.fpr_budgets]
_REPORT = (
    ("budgets", f"select unnest([{', '.join(f'{b!r}::double' for b in CFG.fpr_budgets)}]) as budget"), ("neg", qm._NEG), qm._THR,
    qm._QUIET, qm._BLOCKED, qm._DRAWS, ("boots", qm._boots("score")), *ISOTONIC_PARTS, qm._HELD, ("policy", qm._POLICY),
    ("isotest", """select s.y, case when x0 is null then v1 when x1 is null or v1 = v0 then v0
    else v0 + (v1 - v0) * (score - x0) / (x1 - x0) end as score
  from (select s.*, lo.score as x0, lo.v as v0, hi.score as x1, hi.v as v1 from test s
    left join iso lo on lo.score = (select max(score) from iso where iso.score <= s.score)
    left join iso hi on hi.score = (select min(score) from iso where iso.score > s.score)) s"""),
    *[(f"sus{i}", qm._SUS[1].replace("0.3", at)) for i, at in enumerate(_AT)],
    *[(f"lead{i}", qm._LEAD[1].replace("from sus", f"from sus{i}")) for i in range(len(_AT))])
_EVALUATION = " union all ".join([
    _metrics("all", _RANKS, qm._ranking("test", "")),
    _metrics("all", ["ece"], _ECE.format(t="test", r=r6("sum(abs(observed - predicted) * cnt) / sum(cnt)", "ece"))),
    _metrics("auprc_ci", ["resamples", "low", "high"], f"""select {big('count(*)', 'resamples')},
      {r6('quantile_cont(ap, 0.025)', 'low')}, {r6('quantile_cont(ap, 0.975)', 'high')} from boots"""),
    _metrics("early_warning", _RANKS, qm._ranking("quiet", "")),
    _metrics("macro_capture", ["auprc", "roc_auc"], f"""select {r6('avg(a)', 'auprc')}, {r6('avg(u)', 'roc_auc')} from (
      select {qm._AP} as a, {qm._AUC} as u from ({qm._curve('test', 'capture')}) group by capture having sum(p) >= 5 and sum(q) >= 5)"""),
    _metrics("isotonic", ["brier"], f"select {r6('avg(pow(least(greatest(score, 0.0::double), 1.0::double) - y::int, 2))', 'brier')} from isotest"),
    _metrics("isotonic", ["ece"], _ECE.format(t="isotest", r=r6("sum(abs(observed - predicted) * cnt) / sum(cnt)", "ece"))),
    f"select 'sustained' as part, 'threshold_' || cast(budget as varchar) as metric, {r6('threshold', 'value')} from policy",
    *[_metrics(f"fpr_{b}", _POINT, qm._confusion("test", "", at)) for b, at in zip(CFG.fpr_budgets, _AT)],
    *[_metrics(f"fpr_{b}", _LEADS, f"select {qm._LEAD_SUMMARY} from lead{i}") for i, b in enumerate(CFG.fpr_budgets)]])


@query("evaluation_report", with_parts(_EVALUATION, *_REPORT))
def evaluation_report(spark, sf_dir):
    """All metrics of one model at its operating points, as (part, metric, value) rows."""
    return ev.evaluation_report(scored(spark, sf_dir), CFG, block=20)


@query("forecast_timeline")
def forecast_timeline(spark, sf_dir):
    """Fit on the stored windows, then analyse the flows into an alert timeline."""
    def build():
        from netloom.operators.splits import temporal_split
        return temporal_split(build_windows(flows(spark, sf_dir), CFG), CFG, CFG.primary_horizon)
    windows = stored(spark, sf_dir, "windows", build)
    model = an.fit(windows, CFG)
    arrays = ("nowcast", "risk_steps", "stage_steps", "next_probs")
    found = an.analyse(flows(spark, sf_dir), model, CFG)
    texts = {c: F.transform(F.flatten(c) if c == "stage_steps" else F.col(c), lambda v: F.format_number(v, 4)) for c in arrays}
    return found.drop("time").withColumns({c: F.array_join(v, " ") for c, v in texts.items()})


