"""Metrics, calibration and alert policies on a scored windows table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_splits import stored_split
from checks.q_states import KEYS
from checks.registry import CFG, big, query, r6, stored, table
from checks.sqltext import with_parts
from netloom.operators import alerts as al
from netloom.operators import calibration as ca
from netloom.operators import metrics as mt
from netloom.operators import ranking as rk
from netloom.operators.timeline import compromise_onsets

WIN = big("win", '"window"')


def scored(spark, sf_dir):
    """Every window with two deterministic scores, the 6-window target and its validity."""
    def build():
        c = F.col
        mix = (c("window") * 37 + c("n_flows") * 11 + c("stage_now") * 29) % 100
        mix_b = (c("window") * 53 + c("n_flows") * 7 + c("pos_in_session") * 3 + c("stage_now") * 41) % 100
        base = compromise_onsets(stored_split(spark, sf_dir), CFG.onset_quiet)
        return base.withColumns({"score": mix / 100.0, "score_b": mix_b / 100.0, "y": c("y_6"),
                                 "valid": c("valid_6")})
    return stored(spark, sf_dir, "scored", build)


def part(spark, sf_dir, name):
    return scored(spark, sf_dir).filter((F.col("split") == name) & F.col("valid"))


def graded(spark, sf_dir):
    """Document quality labels with the text length as the score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("y"))
    return marks.join(docs, "doc_id")


# Ranking metrics, written as rank sums over distinct scores.
def _curve(src: str, by: str, score: str = "score") -> str:
    part_by = f"partition by {by}" if by else ""
    return f"""select {by + ',' if by else ''} s, p, q, sum(p) over w as tp, sum(q) over w as fp
from (select {by + ',' if by else ''} {score} as s, count(*) filter (y) as p, count(*) filter (not y) as q
      from {src} group by {by + ',' if by else ''} {score})
window w as ({part_by} order by s desc rows unbounded preceding)"""


_AP = "sum(p * tp / (tp + fp)::double) / sum(p)"
_AUC = "sum(q * (tp - p / 2.0::double)) / (sum(p) * sum(q))"
_BOTH = "sum(p) > 0 and sum(q) > 0"


def _ranking(src: str, by: str, having: str = "") -> str:
    group = f"group by {by} {having}" if by else ""
    return f"""select {by + ',' if by else ''} {big('sum(p + q)', 'n')}, {big('sum(p)', 'positives')},
  {r6(f'case when {_BOTH} then {_AP} end', 'auprc')}, {r6(f'case when {_BOTH} then {_AUC} end', 'roc_auc')}
from ({_curve(src, by)}) {group}"""


@query("avg_precision", with_parts(_ranking("test", "")))
def avg_precision(spark, sf_dir):
    return mt.auprc(part(spark, sf_dir, "test"), [])


GRADED = "select l.doc_id, d.source, d.n_chars::double as score, l.quality = 1 as y from labels l join documents d using (doc_id)"


@query("avg_precision_documents", with_parts(_ranking("graded", "source"), ("graded", GRADED)))
def avg_precision_documents(spark, sf_dir):
    return mt.auprc(graded(spark, sf_dir), ["source"])


@query("per_capture_metrics", with_parts(_ranking("test", "capture", "having sum(p) >= 5 and sum(q) >= 5")))
def per_capture(spark, sf_dir):
    return mt.per_capture(part(spark, sf_dir, "test"))


_QUIET = ("quiet", "select * from test where stage_now < 2 and (c_prev is null or pos - c_prev >= 3)")


@query("early_warning_metrics", with_parts(_ranking("quiet", ""), _QUIET))
def early_warning_metrics(spark, sf_dir):
    return mt.auprc(part(spark, sf_dir, "test").filter("is_quiet"), [])


def _confusion(src, by, thr):
    b = by + "," if by else ""
    return f"""select {b} {big('tp', 'tp')}, {big('fp', 'fp')}, {big('fn', 'fn')}, {big('tn', 'tn')}, {r6('brier', 'brier')},
  {r6('case when tp+fp>0 then tp/(tp+fp)::double else 0 end', 'precision')},
  {r6('case when tp+fn>0 then tp/(tp+fn)::double else 0 end', 'recall')},
  {r6('case when 2*tp+fp+fn>0 then 2*tp/(2*tp+fp+fn)::double else 0 end', 'f1')},
  {r6('case when fp+tn>0 then fp/(fp+tn)::double else 0 end', 'fpr')}
from (select {b} count(*) filter (score >= {thr} and y) as tp, count(*) filter (score >= {thr} and not y) as fp,
    count(*) filter (score < {thr} and y) as fn, count(*) filter (score < {thr} and not y) as tn,
    avg(pow(least(greatest(score, 0.0::double), 1.0::double) - y::int, 2)) as brier from {src} {'group by ' + by if by else ''})"""


@query("confusion", with_parts(_confusion("test", "capture", "0.6")))
def confusion(spark, sf_dir):
    return mt.confusion(part(spark, sf_dir, "test"), ["capture"], 0.6)


@query("confusion_documents", with_parts(_confusion("graded", "source", "1000"), ("graded", GRADED)))
def confusion_documents(spark, sf_dir):
    return mt.confusion(graded(spark, sf_dir), ["source"], 1000.0)


_REL = """select least(cast(floor(score*10) as bigint), 9) as bin, avg(score) as predicted, avg(y::int) as observed,
  count(*) as cnt from test group by 1"""


@query("reliability", with_parts(
    f"select {big('bin', 'bin')}, {r6('predicted', 'predicted')}, {r6('observed', 'observed')}, {big('cnt', 'count')} from rel",
    ("rel", _REL)))
def reliability(spark, sf_dir):
    return mt.reliability(part(spark, sf_dir, "test"), [])


@query("ece", with_parts(f"select {r6('sum(abs(observed - predicted) * cnt) / sum(cnt)', 'ece')} from rel", ("rel", _REL)))
def ece(spark, sf_dir):
    return mt.calibration_error(part(spark, sf_dir, "test"), [])


@query("time_blocks", with_parts(f"select session_key || '@' || cast(floor(pos / 180) as bigint) as block, {big('count(*)', 'rows')} from win group by 1"))
def blocks(spark, sf_dir):
    return mt.time_blocks(stored_split(spark, sf_dir)).groupBy("block").agg(F.count(F.lit(1)).alias("rows"))


# ------------------------------------------------------------------ bootstrap
N_BOOT = 300
_BLOCKED = ("blocked", "select *, session_key || '@' || cast(floor(pos / 20) as bigint) as block from test")
_DRAWS = ("draws", f"""select b.boot, n.block, count(*) as m from (
    select boot, i, cast(floor(('0x' || substr(md5(boot || '|' || i || '|0'), 1, 8))::bigint / 4294967296.0::double
      * (select count(distinct block) from blocked)) as bigint) as pick
    from (select unnest(generate_series(0, {N_BOOT - 1})) as boot),
         (select row_number() over (order by substr(md5(block), 1, 2), block) - 1 as i from (select distinct block from blocked))) b
  join (select block, row_number() over (order by substr(md5(block), 1, 2), block) - 1 as i from (select distinct block from blocked)) n
    on n.i = b.pick group by b.boot, n.block""")


def _boots(score: str) -> str:
    return f"""select boot, {_AP} as ap from (
  select boot, s, p, q, sum(p) over w as tp, sum(q) over w as fp from (
    select d.boot, t.{score} as s, sum(case when t.y then d.m else 0 end) as p,
      sum(case when t.y then 0 else d.m end) as q
    from blocked t join draws d on d.block = t.block group by d.boot, t.{score})
  window w as (partition by boot order by s desc rows unbounded preceding))
group by boot having {_BOTH}"""


@query("block_bootstrap", with_parts(f"select {big('boot', 'boot')}, {r6('ap', 'auprc')} from boots",
                                     _BLOCKED, _DRAWS, ("boots", _boots("score"))))
def bootstrap(spark, sf_dir):
    rows = mt.time_blocks(part(spark, sf_dir, "test"), 20)
    return mt.bootstrap_auprc(rows, N_BOOT).select("boot", "auprc")


@query("bootstrap_interval", with_parts(f"""select {big('count(*)', 'resamples')},
  {r6('quantile_cont(ap, 0.025)', 'low')}, {r6('quantile_cont(ap, 0.975)', 'high')} from boots""",
                                        _BLOCKED, _DRAWS, ("boots", _boots("score"))))
def interval(spark, sf_dir):
    rows = mt.time_blocks(part(spark, sf_dir, "test"), 20)
    return mt.interval(mt.bootstrap_auprc(rows, N_BOOT), "auprc")


@query("paired_bootstrap", with_parts(f"""select {big('count(*)', 'resamples')}, {r6('quantile_cont(d, 0.025)', 'low')},
  {r6('quantile_cont(d, 0.975)', 'high')}, {r6('avg((d > 0)::int)', 'p_a_better')}
from (select a.ap - b.ap as d from boots a join boots_b b on a.boot = b.boot)""",
                                      _BLOCKED, _DRAWS, ("boots", _boots("score")), ("boots_b", _boots("score_b"))))
def paired(spark, sf_dir):
    rows = mt.time_blocks(part(spark, sf_dir, "test"), 20)
    return mt.paired_bootstrap(rows, N_BOOT, "score", "score_b")


# ------------------------------------------------------------------ thresholds
_BUDGETS = "select unnest([0.005::double, 0.01::double, 0.02::double, 0.05::double]) as budget"
_NEG = """select score, row_number() over (order by score) as r, count(*) over () as n from cal where not y"""
_THR = ("thr", f"""select budget, coalesce(min(score) filter (r >= least(greatest(ceil((n + 1) * (1.0::double - budget)), 1), n)),
  0.5::double) as threshold, coalesce(min(n), 0) as n from budgets left join neg on true group by budget""")


@query("conformal_threshold", with_parts(
    f"select {r6('budget', 'budget')}, {r6('threshold', 'threshold')}, {big('n', 'n_calibration')} from thr",
    ("budgets", _BUDGETS), ("neg", _NEG), _THR))
def conformal(spark, sf_dir):
    return ca.conformal_thresholds(part(spark, sf_dir, "calibration"), (0.005, 0.01, 0.02, 0.05))


@query("coverage_report", with_parts(f"""
select {r6('budget', 'budget')}, {r6('threshold', 'threshold')}, {r6('c.f', 'calibration_fpr')}, {r6('t.f', 'test_fpr')},
  {r6('t.r', 'test_recall')}, {r6('t.f', 'test_alerts_per_hour')}, {r6('t.f - budget', 'coverage_gap')},
  t.f <= budget * 1.5::double as guarantee_held
from (select budget, threshold, coalesce(avg((score >= threshold)::int) filter (not y), 0) as f from cal cross join thr group by 1, 2) c
join (select budget, coalesce(avg((score >= threshold)::int) filter (not y), 0) as f,
        coalesce(avg((score >= threshold)::int) filter (y), 0) as r from test cross join thr group by 1) t using (budget)""",
                                     ("budgets", _BUDGETS), ("neg", _NEG), _THR))
def coverage(spark, sf_dir):
    return ca.coverage_report(part(spark, sf_dir, "calibration"), part(spark, sf_dir, "test"),
                              seconds=CFG.window_seconds)


_ADAPTIVE = ("adaptive", """
select session_key, pos, y, score,
  coalesce(case when len(h) >= 20 then h[cast(least(greatest(ceil((len(h) + 1) * (1.0::double - 0.05::double)), 1), len(h)) as bigint)] end, f) as threshold
from (select t.session_key, t.pos, t.f, t.y, t.score, list_sort(list(n.score) filter (n.score is not null)) as h
  from (select *, quantile_cont(score, 0.95) over (partition by session_key) as f,
          coalesce(sum((not y)::int) over (partition by session_key order by pos rows between unbounded preceding and 1 preceding), 0) as seen
        from scored where valid_6) t
  left join (select session_key, score, row_number() over (partition by session_key order by pos) as i
             from scored where valid_6 and not y) n
    on n.session_key = t.session_key and n.i <= t.seen and n.i > t.seen - 50
  group by t.session_key, t.pos, t.f, t.y, t.score)""")


def _adaptive(spark, sf_dir):
    return ca.adaptive_thresholds(scored(spark, sf_dir).filter("valid"), 0.05, history=50, block=128)


@query("adaptive_threshold", with_parts(
    f"select session_key, {big('pos', 'pos_in_session')}, {r6('threshold', 'threshold')} from adaptive", _ADAPTIVE))
def adaptive(spark, sf_dir):
    return _adaptive(spark, sf_dir).select("session_key", "pos_in_session", "threshold")


def _adaptive_summary(by: str) -> str:
    return f"""select {by} {big('count(*) filter (not y)', 'n_calibration')}, {r6('quantile_cont(threshold, 0.5)', 'threshold')},
  {r6('coalesce(avg((score >= threshold)::int) filter (not y), 0)', 'fpr')},
  {r6('coalesce(avg((score >= threshold)::int) filter (y), 0)', 'recall')},
  {r6('coalesce(avg((score >= threshold)::int) filter (not y), 0)', 'alerts_per_hour')} from adaptive"""


@query("adaptive_summary", with_parts(_adaptive_summary("session_key,") + " group by session_key", _ADAPTIVE))
def adaptive_summary(spark, sf_dir):
    return ca.adaptive_summary(_adaptive(spark, sf_dir), ["session_key"], seconds=CFG.window_seconds)


@query("adaptive_summary_overall", with_parts(_adaptive_summary(""), _ADAPTIVE))
def adaptive_summary_overall(spark, sf_dir):
    return ca.adaptive_summary(_adaptive(spark, sf_dir), seconds=CFG.window_seconds)


@query("warmup_threshold", with_parts(f"""
select session_key, {big('pos', 'pos_in_session')}, {r6('b.budget', 'budget')}, {r6('b.t', 'threshold')}
from (select *, row_number() over (partition by session_key order by pos) as rk,
        count(*) over (partition by session_key) as sz from test) r
join (select session_key, unnest([0.01::double, 0.03::double]) as budget,
        unnest([quantile_cont(score, 0.99), quantile_cont(score, 0.97)]) as t
      from (select *, row_number() over (partition by session_key order by pos) as rk from test)
      where rk <= 30 group by session_key) b using (session_key)
where sz > 40 and rk > 30"""))
def warmup_threshold(spark, sf_dir):
    return ca.warmup_thresholds(part(spark, sf_dir, "test"), (0.01, 0.03), baseline=30).select(
        "session_key", "pos_in_session", "budget", "threshold")


_HELD = ("held", """select *, case when lag(score) over (partition by session_key order by pos) is null then null
  else least(score, lag(score) over (partition by session_key order by pos)) end as held from scored""")
_POINTS = ", ".join(repr(0.5 + i * (0.999 - 0.5) / 199) for i in range(200))
_POLICY = f"""select budget, coalesce(min(threshold) filter (fpr <= budget), max(threshold)) as threshold
from (select threshold, (select count(*) from held where split = 'calibration' and valid_6 and not y and held >= threshold)
        / greatest((select count(*) from held where split = 'calibration' and valid_6 and not y), 1)::double as fpr
      from (select distinct unnest(quantile_cont(score, [{_POINTS}])) as threshold from cal)),
  (select unnest([0.01::double, 0.03::double]) as budget) group by budget"""


@query("sustained_policy", with_parts(
    f"select {r6('budget', 'budget')}, {r6('threshold', 'threshold')} from policy", _HELD, ("policy", _POLICY)))
def policy(spark, sf_dir):
    return ca.sustained_policy(scored(spark, sf_dir), (0.01, 0.03), CFG.hysteresis)


# ------------------------------------------------------------------ alerts
@query("sustained_alert", with_parts(f"""
select session_key, {big('pos', 'pos_in_session')},
  coalesce(score >= 0.6 and lag(score) over s >= 0.6 and lag(score, 2) over s >= 0.6, false) as alert
from scored window s as (partition by session_key order by pos)"""))
def sustained(spark, sf_dir):
    return al.sustained(scored(spark, sf_dir), F.col("score") >= 0.6, 3, "alert").select(
        "session_key", "pos_in_session", "alert")


_LEVEL = ("lev", """select *, case when two then 2 when one then 1 else 0 end as level from (
  select *, coalesce(score >= 0.7 and lag(score) over s >= 0.7, false) as two,
    coalesce(score_b >= 0.5 and lag(score_b) over s >= 0.5, false) as one
  from scored window s as (partition by session_key order by pos))""")


def levelled(spark, sf_dir):
    out = al.two_level(scored(spark, sf_dir), "score", "score_b", 0.7, 0.5, CFG.hysteresis)
    return out.withColumn("risk", F.col("score"))


@query("two_level_alert", with_parts(f"""
select capture, {WIN}, {big('level', 'level')}, two as alert, {r6('score', 'risk')},
  strftime(to_timestamp(win * 3600)::timestamp, '%Y-%m-%d %H:%M:%S') as time from lev""", _LEVEL))
def two_level(spark, sf_dir):
    df = al.timeline(levelled(spark, sf_dir), CFG).select(*KEYS, "level", "alert", "risk", "time")
    return df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query("alert_log", with_parts(f"""
select session_key, {big('level', 'level')}, {r6('min(t)', 'from_t')}, {r6('max(t)', 'to_t')},
  {r6('count(*) * 60.0', 'minutes')}, {r6('max(score)', 'peak')}
from (select *, pos - row_number() over (partition by session_key, level order by pos) as isle from lev)
where level > 0 group by session_key, level, isle""", _LEVEL))
def alert_log(spark, sf_dir):
    return al.alert_log(levelled(spark, sf_dir), CFG)


@query("analysis_summary", with_parts(f"""
select capture, {big('count(*)', 'windows')}, {big('sum(n_flows)', 'flows')}, {big('count(score)', 'scored_windows')},
  {big('count(*) filter (two)', 'alert_windows')}, {big('count(*) filter (level = 1)', 'early_warning_windows')},
  {r6('min(t) filter (level = 1)', 'first_early_warning')}, {r6('min(t) filter (two)', 'first_alert')},
  {r6('max(score)', 'max_risk')}, case when sum(n_attack_flows) > 0 then cast(count(*) filter (stage_now > 0) as bigint) end
  as labelled_attack_windows from lev group by capture""", _LEVEL))
def summary(spark, sf_dir):
    return al.summary(levelled(spark, sf_dir))


_LEAD = ("lead", """select o.capture, o.session_key, o.pos,
  (select count(*) from sus s where s.session_key = o.session_key and s.pos < o.pos and s.pos >= o.pos - 6
     and s.on_ and not exists (select 1 from sus z where z.session_key = o.session_key
       and z.pos > s.pos and z.pos < o.pos and not z.on_)) as lead_windows,
  exists (select 1 from sus s where s.session_key = o.session_key and s.pos between o.pos and o.pos + 6 and s.on_) as late
from scored o where o.split = 'test' and o.stage_now >= 2 and (o.c_prev is null or o.pos - o.c_prev > 3)""")
_SUS = ("sus", """select session_key, pos, coalesce(score >= 0.3 and lag(score) over
  (partition by session_key order by pos) >= 0.3, false) as on_ from scored""")


def _onset_leads(spark, sf_dir):
    df = scored(spark, sf_dir)
    onset = df.withColumn("onset", F.col("is_compromise_onset") & F.coalesce(F.col("split") == "test", F.lit(False)))
    return mt.lead_times(onset, F.col("score") >= 0.3, "onset", 6, CFG.hysteresis)


@query("lead_time", with_parts(f"""
select capture, {big('pos', 'pos_in_session')}, {big('lead_windows', 'lead_windows')},
  lead_windows > 0 or late as detected from lead""", _SUS, _LEAD))
def lead_time(spark, sf_dir):
    return _onset_leads(spark, sf_dir).select("capture", "pos_in_session", "lead_windows", "detected")


_LEAD_SUMMARY = f"""{big('count(*)', 'n_onsets')}, {big('count(*) filter (lead_windows > 0)', 'warned_before')},
  {big('count(*) filter (lead_windows > 0 or late)', 'detected_within')},
  {r6('avg((lead_windows > 0)::int)', 'warned_before_frac')}, {r6('avg((lead_windows > 0 or late)::int)', 'detected_frac')},
  {r6('coalesce(quantile_cont(lead_windows::double, 0.5) filter (lead_windows > 0), 0)', 'median_lead_windows')},
  {r6('coalesce(avg(lead_windows) filter (lead_windows > 0), 0)', 'mean_lead_windows')}"""


@query("lead_time_summary", with_parts(f"select {_LEAD_SUMMARY} from lead", _SUS, _LEAD))
def lead_summary(spark, sf_dir):
    return mt.lead_summary(_onset_leads(spark, sf_dir))


@query("early_warning_threshold", with_parts(f"""
select {big('count(*)', 'n')}, {r6('quantile_cont(score_b, 0.95)', 'threshold')} from cal
where not y and stage_now < 2 and (c_prev is null or pos - c_prev >= 3)"""))
def early_threshold(spark, sf_dir):
    return ca.early_warning_threshold(scored(spark, sf_dir), 0.05, "score_b")


# ------------------------------------------------------------------ ranking primitives over the big tables
@query("exact_quantiles", f"""
select l_returnflag, {big('count(*)', 'n')}, {r6('quantile_cont(l_extendedprice, 0.25)', 'q25')},
  {r6('quantile_cont(l_extendedprice, 0.5)', 'q50')}, {r6('quantile_cont(l_extendedprice, 0.99)', 'q99')}
from lineitem group by l_returnflag""")
def exact_quantiles(spark, sf_dir):
    q = rk.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.99])
    return q.select("l_returnflag", "n", *[F.col("q")[i].alias(x) for i, x in enumerate(("q25", "q50", "q99"))])


@query("prefix_sums", f"""
select {big('l_quantity', 'l_quantity')}, {big('n', 'n')}, {big('sum(n) over (order by l_quantity)', 'cum_n')},
  {big('sum(n) over ()', 'total_n')} from (select l_quantity, count(*) as n from lineitem group by 1)""")
def prefix_sums(spark, sf_dir):
    counts = rk.value_counts(table(spark, sf_dir, "lineitem"), [], "l_quantity")
    return rk.cumulate(counts, [], "l_quantity", ["n"]).withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
