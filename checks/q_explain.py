"""Explanations, host attribution, knowledge base, campaigns and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.q_splits import NAMES, STATE_PARTS, scaled_state, stored_split
from checks.q_states import KEYS
from checks.registry import CFG, big, flows, query, r6, stored, table
from checks.sqltext import with_parts
from netloom import vocab
from netloom.operators import campaigns as cp
from netloom.operators import explain as ex
from netloom.operators import features as fx
from netloom.operators import knowledge as kb
from netloom.operators import normalise as nm
from netloom.operators import reports as rp
from netloom.operators.labels import refine_stages

WIN = big("win", '"window"')
POS = big("pos", "pos_in_session")
BIAS = -1.0

# A linear score whose weights are the class difference of every feature (both engines compute it).
_SCALED = STATE_PARTS[:4]
_W = ("weights", """select feature, coalesce(avg(z) filter (y_6), 0) - coalesce(avg(z) filter (not y_6), 0) as weight
from zlong where split = 'train' group by feature""")
_C = ("contrib", "select z.*, round(weight * z, 8) + 0.0 as c from zlong z join weights using (feature) where split = 'test'")


def _contrib(spark, sf_dir) -> DataFrame:
    def build():
        z = scaled_state(spark, sf_dir)
        long = nm.unpivot(z, NAMES, [*KEYS, "session_key", "pos_in_session", "split", "y_6"], compressed=False)
        mean = F.avg(F.when(F.col("y_6"), F.col("value"))), F.avg(F.when(~F.col("y_6"), F.col("value")))
        weights = long.filter("split = 'train'").groupBy("feature").agg(
            (F.coalesce(mean[0], F.lit(0.0)) - F.coalesce(mean[1], F.lit(0.0))).alias("weight"))
        # Features that measure the same differ by rounding only: eight places decide ties alike in both engines.
        found = ex.contributions(long.filter("split = 'test'"), weights)
        return found.withColumn("contribution", F.round("contribution", 8) + 0.0)
    return stored(spark, sf_dir, "contrib", build)


@query("feature_attribution", with_parts(
    f"select session_key, {POS}, feature, {r6('c', 'contribution')} from contrib", *_SCALED, _W, _C))
def attribution(spark, sf_dir):
    return _contrib(spark, sf_dir).select("session_key", "pos_in_session", "feature", "contribution")


@query("top_attributions", with_parts(f"""select session_key, {POS}, feature, {r6('c', 'contribution')} from (
  select *, row_number() over (partition by session_key, pos order by abs(c) desc, feature) as rk from contrib)
where rk <= 3""", *_SCALED, _W, _C))
def top_attributions(spark, sf_dir):
    return ex.top_contributions(_contrib(spark, sf_dir), 3).select(
        "session_key", "pos_in_session", "feature", "contribution")


_groups = " ".join(f"when feature in ({', '.join(repr(f.name) for f in vocab.FEATURES if f.grp == g)}) then '{g}'"
                   for g in vocab.GROUPS)
_G = ("groups", f"""select session_key, pos, case {_groups} end as grp, sum(c) as c from contrib group by all""")


@query("group_attribution", with_parts(
    f"select session_key, {POS}, grp, {r6('c', 'contribution')} from groups", *_SCALED, _W, _C, _G))
def group_attribution(spark, sf_dir):
    return ex.group_contributions(_contrib(spark, sf_dir))


@query("group_counterfactual", with_parts(f"""
select session_key, {POS}, grp, {big('step', 'step')}, {r6('1 / (1 + exp(-tot))', 'risk')}, {r6('after', 'risk_after')} from (
  select *, min(after) over (partition by session_key, pos order by step rows between unbounded preceding and 1 preceding) as best
  from (select *, 1 / (1 + exp(-(tot - sum(c) over (partition by session_key, pos order by step)))) as after from (
    select *, row_number() over (partition by session_key, pos order by c desc, grp) as step,
      sum(c) over (partition by session_key, pos) - 1.0::double as tot from groups)))
where step <= 4 and coalesce(best >= 0.25::double, true)""", *_SCALED, _W, _C, _G))
def counterfactual(spark, sf_dir):
    return ex.group_counterfactual(_contrib(spark, sf_dir), BIAS, 0.25)


@query("deletion_test", with_parts(f"""
select {big('count(*)', 'n')}, {r6('avg(r - 1 / (1 + exp(-(z - top))))', 'mean_drop_top')},
  {r6('avg(r - 1 / (1 + exp(-(z - rnd))))', 'mean_drop_random')},
  {r6('avg(r - 1 / (1 + exp(-(z - top)))) / avg(r - 1 / (1 + exp(-(z - rnd))))', 'ratio')}
from (select session_key, pos, sum(c) - 1.0::double as z, 1 / (1 + exp(-(sum(c) - 1.0::double))) as r,
    sum(c) filter (b <= 5) as top, sum(c) filter (d <= 5) as rnd
  from (select *, row_number() over (partition by session_key, pos order by c desc, feature) as b,
    row_number() over (partition by session_key, pos order by substr(md5(session_key || '|' || pos || '|' || feature || '|0'), 1, 8), feature) as d
    from contrib) group by session_key, pos)""", *_SCALED, _W, _C))
def deletion(spark, sf_dir):
    return ex.deletion_test(_contrib(spark, sf_dir), BIAS, k=5)


@query("temporal_occlusion", with_parts(f"""
select session_key, {POS}, {big('block', 'block')},
  {r6('1 / (1 + exp(-(tot - 1))) - 1 / (1 + exp(-(tot - 1 - part)))', 'drop')} from (
  select session_key, pos, block, part, sum(part) over (partition by session_key, pos) as tot from (
    select a.session_key, a.pos, floor(g.lag / 4) as block, sum(c.c) / 8 as part
    from (select distinct session_key, pos from contrib) a cross join (select unnest(generate_series(0, 7)) as lag) g
    join contrib c on c.session_key = a.session_key and c.pos = a.pos - g.lag group by all))""", *_SCALED, _W, _C))
def occlusion(spark, sf_dir):
    """A linear score over the last eight windows, each window with an eighth of the weight."""
    c = _contrib(spark, sf_dir).select("session_key", F.col("pos_in_session").alias("at"), "feature",
                                       (F.col("contribution") / 8).alias("contribution"))
    spread = c.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn(
        "pos_in_session", F.col("at") + F.col("lag"))
    anchors = c.select("session_key", F.col("at").alias("pos_in_session")).distinct()
    return ex.temporal_occlusion(spread.join(anchors, ["session_key", "pos_in_session"], "left_semi"), BIAS, 4)


# ------------------------------------------------------------------ hosts
_T = ("targets", """select capture || '@' || win as target, capture, win from (
  select capture, win, row_number() over (partition by capture order by stage_now desc, n_flows desc, win) as rk
  from win) where rk <= 3""")
_NEAR = ("near", """select t.target, t.win as tw, f.* from flows f join targets t on t.capture = f.capture
  and f.win between t.win - 17 and t.win""")
_HOSTS = ("hosts", """select * from (select target, host, count(*) as recent_flows,
    row_number() over (partition by target order by count(*) desc, host) as rk
  from (select target, unnest([src_ip, dst_ip]) as host from near where win > tw - 6) group by target, host) where rk <= 4""")
_RISK = "flow_count * 0.5 + fanout_max + half_open_max * 0.25"


def _targets(spark, sf_dir):
    from pyspark.sql import Window as W
    order = W.partitionBy("capture").orderBy(F.desc("stage_now"), F.desc("n_flows"), "window")
    return stored(spark, sf_dir, "targets", lambda: stored_split(spark, sf_dir).withColumn(
        "rk", F.row_number().over(order)).filter("rk <= 3").select(
            F.concat_ws("@", "capture", "window").alias("target"), "capture", "window"))


@query("recent_hosts", with_parts(f"select target, host, {big('recent_flows', 'recent_flows')} from hosts",
                                  _T, _NEAR, _HOSTS))
def recent_hosts(spark, sf_dir):
    return ex.recent_hosts(flows(spark, sf_dir), _targets(spark, sf_dir), CFG, recent=6, top=4)


_WITHOUT = ("without", """select v.target, v.host, coalesce(max(k.risk), 0) as risk from (
    select target, host from hosts union all select target, '' from targets) v
  left join (select target, host, count(*) * 0.5 + max(fan) + coalesce(max(half), 0) * 0.25 as risk from (
    select v.target, v.host, n.src_ip, n.flow_id, count(*) over (partition by v.target, v.host, n.src_ip) as nsrc,
      (select count(distinct m.dst_ip) from near m where m.target = v.target and m.win = m.tw and m.src_ip = n.src_ip
         and m.src_ip <> v.host and m.dst_ip <> v.host) as fan,
      (select count(*) from near m where m.target = v.target and m.win = m.tw and m.src_ip = n.src_ip
         and m.src_ip <> v.host and m.dst_ip <> v.host and m.syn_count > 0 and m.ack_count <= 0) as half
    from (select target, host from hosts union all select target, '' from targets) v
    join near n on n.target = v.target and n.win = n.tw and n.src_ip <> v.host and n.dst_ip <> v.host)
  group by target, host) k on k.target = v.target and k.host = v.host
group by v.target, v.host""")


@query("host_attribution", with_parts(f"""
select w.target, w.host, {big('h.recent_flows', 'recent_flows')}, {r6('w.risk', 'risk_without')},
  {r6('b.risk - w.risk', 'contribution')}, {r6('b.risk', 'risk')}
from without w join without b on b.target = w.target and b.host = '' join hosts h on h.target = w.target and h.host = w.host""",
                                      _T, _NEAR, _HOSTS, _WITHOUT))
def host_attribution(spark, sf_dir):
    def featurise(f, cfg, series):
        keys = [*series, "window"]
        return fx.window_aggregates(f, cfg, series).join(fx.cell_features(f, cfg, series), keys)
    risk = F.expr(_RISK.replace("half_open_max", "coalesce(half_open_max, 0)"))
    return ex.host_attribution(flows(spark, sf_dir), _targets(spark, sf_dir), CFG, featurise, risk, recent=6, top=4)


@query("flagged_flows", with_parts(f"""
select target, {big('flow_id', 'flow_id')}, {r6('ts', 'ts')}, src_ip, dst_ip from (
  select *, row_number() over (partition by target order by ts, flow_id) as rk from near n
  where win > tw - 6 and exists (select 1 from hosts h where h.target = n.target and h.host in (n.src_ip, n.dst_ip)))
where rk <= 10""", _T, _NEAR, _HOSTS))
def flagged(spark, sf_dir):
    t = _targets(spark, sf_dir)
    hosts = ex.recent_hosts(flows(spark, sf_dir), t, CFG, recent=6, top=4)
    return ex.flagged_flows(flows(spark, sf_dir), hosts, t, CFG, recent=6, limit=10).select(
        "target", "flow_id", "ts", "src_ip", "dst_ip")


@query("top_risk_windows", with_parts(f"""
select capture, {WIN}, {r6('score', 'score')} from scored order by score desc, capture, win limit 25"""))
def top_risk(spark, sf_dir):
    from checks.q_metrics import scored
    return scored(spark, sf_dir).orderBy(F.desc("score"), "capture", "window").limit(25).select(*KEYS, "score")


# ------------------------------------------------------------------ knowledge (derived from the order tables)
_PREF = ", ".join(f"'{x}'" for x in vocab.COUNTERMEASURE_PREFERENCE)
# Technique numbers skip 1046, so that it has no mapping and takes the curated fallback.
_MAP_TEXT = """select concat('T', cast(1030 + l_partkey % 400 + case when l_partkey % 400 >= 16 then 1 else 0 end as {S})) as technique,
  concat('D3-', cast(l_suppkey % 60 as {S})) as raw_id,
  cast(l_suppkey % 60 as int) as k, min(l_orderkey * 10 + l_linenumber) as ord
from {T} group by 1, 2, 3"""
_MAPPINGS = ("mappings", f"""select technique, case when k < 16 then [{_PREF}][k + 1] else raw_id end as id,
  ['Isolate', 'Detect', 'Evict', 'Harden', 'Model'][k % 5 + 1] as tactic, 'measure ' || k as name, ord
from ({_MAP_TEXT.format(S='varchar', T='lineitem')})""")
_WANTED = ("wanted", "select distinct 'T' || (1030 + p_partkey % 600) as technique from part")


def _mappings(spark, sf_dir):
    base = spark.sql(_MAP_TEXT.format(S="string", T="{t}"), t=table(spark, sf_dir, "lineitem"))
    k = F.col("k")
    pref = F.get(F.array(*[F.lit(x) for x in vocab.COUNTERMEASURE_PREFERENCE]), k)
    tactic = F.get(F.array(*[F.lit(x) for x in ("Isolate", "Detect", "Evict", "Harden", "Model")]), k % 5)
    return base.select("technique", F.coalesce(pref, F.col("raw_id")).alias("id"), tactic.alias("tactic"),
                       F.concat(F.lit("measure "), k.cast("string")).alias("name"), "ord")


def _wanted(spark, sf_dir):
    number = (F.lit(1030) + F.col("p_partkey") % 600).cast("string")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("T"), number).alias("technique")).distinct()


_CAT = ("cat", """select id, tactic, name from (
  select *, row_number() over (partition by id order by ord) as rn from mappings) where rn = 1""")
_cur = ", ".join(f"('{t}', '{i}', {n})" for t, ids in vocab.CURATED_COUNTERMEASURES.items() for n, i in enumerate(ids))
_tac = " ".join(f"when '{k}' then {v}" for k, v in vocab.TACTIC_ORDER.items())
_CM = ("measures", f"""select technique, rank, id, tactic, name, curated from (
  select *, row_number() over (partition by technique order by again, pref, tac, ord) as rank from (
    select *, (row_number() over (partition by technique, tactic order by pref, tac, ord) > 1)::int as again from (
      select *, coalesce(list_position([{_PREF}], id) - 1, 99) as pref, case tactic {_tac} else 9 end as tac from (
        select m.*, false as curated from mappings m where technique in (select technique from wanted)
        union all
        select c.t, c.i, cat.tactic, cat.name, c.n, true from (values {_cur}) c(t, i, n) join cat on cat.id = c.i
        where c.t in (select technique from wanted) and c.t not in (select technique from mappings)))))
where rank <= 4""")


@query("countermeasures", with_parts(
    f"select technique, {big('rank', 'rank')}, id, tactic, name, curated from measures", _MAPPINGS, _WANTED, _CAT, _CM))
def countermeasures(spark, sf_dir):
    return kb.countermeasures(_wanted(spark, sf_dir), _mappings(spark, sf_dir))


@query("countermeasure_catalogue", with_parts("select id, tactic, name from cat", _MAPPINGS, _CAT))
def catalogue(spark, sf_dir):
    return kb.catalogue(_mappings(spark, sf_dir))


_PAIRS = ("pairs", "select distinct 'S' || (p_partkey % 6) as stage, 'T' || (1030 + p_partkey % 600) as technique from part")


@query("common_countermeasures", with_parts(f"""
select stage, id, {big('n', 'n')}, {big('rank', 'rank')} from (
  select stage, id, count(*) as n, row_number() over (partition by stage order by count(*) desc, id) as rank
  from pairs join measures using (technique) group by stage, id) where rank <= 5""",
                                            _MAPPINGS, _WANTED, _CAT, _CM, _PAIRS))
def common(spark, sf_dir):
    number = (F.lit(1030) + F.col("p_partkey") % 600).cast("string")
    pairs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), (F.col("p_partkey") % 6).cast("string")).alias("stage"),
        F.concat(F.lit("T"), number).alias("technique")).distinct()
    return kb.common_countermeasures(pairs, kb.countermeasures(_wanted(spark, sf_dir), _mappings(spark, sf_dir)))


def stix_objects(spark, sf_dir):
    """A knowledge bundle made from parts, suppliers, nations and line items."""
    def obj(df, kind, ident, name, ext=None, revoked=None, source=None, target=None, rel=None):
        none = F.lit(None).cast("string")
        ref = F.struct(F.lit("mitre-attack").alias("source_name"), (none if ext is None else ext).alias("external_id"),
                       F.concat(F.lit("https://kb.test/"), none if ext is None else ext).alias("url"))
        refs = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("X").alias("external_id"),
                                F.lit("u").alias("url")), ref)
        return df.select(
            ident.alias("id"), F.lit(kind).alias("type"), (none if name is None else name).alias("name"),
            (none if name is None else F.concat(name, F.lit("\nmore"))).alias("description"),
            (F.lit(None).cast("boolean") if revoked is None else revoked).alias("revoked"),
            F.lit(None).cast("boolean").alias("x_mitre_deprecated"), (none if rel is None else F.lit(rel)).alias("relationship_type"),
            (none if source is None else source).alias("source_ref"), (none if target is None else target).alias("target_ref"),
            refs.alias("external_references"))
    c = F.col
    part_id = F.concat(F.lit("p"), c("p_partkey"))
    parts = obj(table(spark, sf_dir, "part"), "attack-pattern", part_id, c("p_name"),
                F.concat(F.lit("T"), c("p_partkey")), c("p_size") % 10 == 0)
    makers = obj(table(spark, sf_dir, "supplier"), "course-of-action", F.concat(F.lit("s"), c("s_suppkey")), c("s_name"),
                 F.concat(F.when(c("s_suppkey") % 4 == 0, "X").otherwise("M"), c("s_suppkey").cast("string")))
    tactics = obj(table(spark, sf_dir, "nation"), "x-mitre-tactic", F.concat(F.lit("n"), c("n_nationkey")), c("n_name"),
                  F.concat(F.lit("TA"), c("n_nationkey").cast("string")))
    links = obj(table(spark, sf_dir, "lineitem"), "relationship",
                F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber"), None, rel="mitigates",
                source=F.concat(F.lit("s"), c("l_suppkey")), target=F.concat(F.lit("p"), c("l_partkey")))
    return parts.unionByName(makers).unionByName(tactics).unionByName(links)


@query("stix_mitigations", """
select distinct 'T' || p_partkey as technique, 'M' || s_suppkey as mitigation, s_name as mitigation_name
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
where p_size % 10 <> 0 and s_suppkey % 4 <> 0""")
def mitigations(spark, sf_dir):
    return kb.mitigations(stix_objects(spark, sf_dir))


@query("stix_techniques", """
select 'T' || p_partkey as external_id, p_name as name, 'https://kb.test/T' || p_partkey as url, p_name as description
from part where p_size % 10 <> 0""")
def techniques(spark, sf_dir):
    return kb.techniques(stix_objects(spark, sf_dir)).drop("stix_id")


@query("technique_lookup", """
select distinct 'T' || l_partkey as technique, coalesce(p_name, 'T' || l_partkey) as name,
  coalesce(p_name, '') as description,
  case when p_name is null then 'https://attack.mitre.org/techniques/T' || l_partkey || '/' else 'https://kb.test/T' || l_partkey end as url
from lineitem left join part on p_partkey = l_partkey and p_size % 10 <> 0""")
def lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), "l_partkey").alias("technique")).distinct()
    return kb.technique_lookup(wanted, kb.techniques(stix_objects(spark, sf_dir)))


_st = ", ".join(f"('{s}', {vocab.STAGES.index(s)}, '{t}', {i})" for s, ts in vocab.STAGE_TECHNIQUES.items() for i, t in enumerate(ts))


@query("stage_cards", with_parts(f"""
select w.stage, {big('count(*)', 'windows')}, {big('any_value(c.techniques)', 'techniques')}, {big('any_value(c.measures)', 'measures')},
  any_value(c.first_measure) as first_measure
from (select [{', '.join(f"'{s}'" for s in vocab.STAGES)}][stage_now + 1] as stage from win where stage_now > 0) w
join (select st.stage, count(distinct st.t) as techniques, count(m.id) as measures,
    coalesce(min(st.i * 10 + m.rank || ':' || m.id), '') as first_measure
  from (values {_st}) st(stage, no, t, i) left join measures m on m.technique = st.t group by st.stage) c using (stage)
group by w.stage""", _MAPPINGS, ("wanted", f"select distinct t as technique from (values {_st}) st(stage, no, t, i)"), _CAT, _CM))
def stage_cards(spark, sf_dir):
    """How many windows each stage card applies to, with its techniques and measures."""
    from netloom.functions.scalars import stage_name
    objects = stix_objects(spark, sf_dir)
    cards = kb.stage_cards(spark, kb.tactics(objects), kb.techniques(objects).drop("stix_id"), _mappings(spark, sf_dir))
    flat = cards.select("stage", F.size("techniques").alias("techniques"), F.explode("techniques").alias("t"))
    each = flat.select("stage", "techniques", "t.ord", F.explode_outer("t.countermeasures").alias("m"))
    per = each.groupBy("stage", "techniques").agg(
        F.count("m.id").alias("measures"),
        F.coalesce(F.min(F.concat((F.col("ord") * 10 + F.col("m.rank")).cast("string"), F.lit(":"), F.col("m.id"))),
                   F.lit("")).alias("first_measure"))
    win = stored_split(spark, sf_dir).filter("stage_now > 0").select(stage_name(F.col("stage_now")).alias("stage"))
    return win.join(F.broadcast(per), "stage").groupBy("stage").agg(
        F.count(F.lit(1)).alias("windows"), F.first("techniques").alias("techniques"),
        F.first("measures").alias("measures"), F.first("first_measure").alias("first_measure"))


# ------------------------------------------------------------------ campaigns
_GAP, _MAX = 86400.0, 172800.0
_SNIP = (("bursts", f"""select *, sum(brk) over (partition by capture, stage order by ts, flow_id) - 1 as snippet from (
  select *, case when lag(ts) over o is null or ts - lag(ts) over o > {_GAP} then 1 else 0 end as brk
  from flows where is_attack window o as (partition by capture, stage order by ts, flow_id))"""),
         ("members", f"""select * from (select *, min(ts) over b as t0, least(max(ts) over b, min(ts) over b + {_MAX}) as t1
  from bursts window b as (partition by capture, stage, snippet)) where ts <= t1"""))
_FAMILY = """(select family from members m where m.capture = s.capture and m.stage = s.stage and m.snippet = s.snippet
  group by family order by count(*) desc, family limit 1)"""


def _snippets(spark, sf_dir):
    return cp.snippets(flows(spark, sf_dir), _GAP, _MAX, 2, block_rows=100)


@query("snippets", with_parts(f"""
select capture, stage, {big('snippet', 'snippet')}, {r6('t0', 't0')}, {r6('t1', 't1')}, {big('n', 'n_flows')}, {_FAMILY} as family,
  campaign_split
from (select s.*, p.campaign_split from (select capture, stage, snippet, min(t0) as t0, min(t1) as t1, count(*) as n
    from members group by 1, 2, 3 having count(*) >= 2) s
  left join (select capture, win, case when pos < train_end then 'train' when pos < cal_end then 'calibration' else 'test' end
    as campaign_split from split) p on p.capture = s.capture and p.win = cast(floor(s.t0 / 3600) as bigint)) s""", *_SNIP))
def snippets(spark, sf_dir):
    from netloom.operators.splits import span_of_window
    spans = span_of_window(stored_split(spark, sf_dir), CFG)
    return cp.with_split(_snippets(spark, sf_dir)[0], spans, CFG.window_seconds)


_BG = ("bgs", """select capture, session, campaign_split, min(win) * 3600.0::double as t0, (min(win) + 12) * 3600.0::double as t1
from (select *, floor((row_number() over (partition by capture, session, campaign_split, isle order by win) - 1) / 12) as tile
  from (select *, win - row_number() over (partition by capture, session, campaign_split order by win) as isle
    from (select *, case when pos < train_end then 'train' when pos < cal_end then 'calibration' else 'test' end as campaign_split
          from split) where n_attack_flows = 0))
group by capture, session, campaign_split, isle, tile having count(*) = 12""")


def _backgrounds(spark, sf_dir):
    from netloom.operators.splits import span_of_window
    return cp.backgrounds(span_of_window(stored_split(spark, sf_dir), CFG), 12 * CFG.window_seconds, CFG.window_seconds)


@query("backgrounds", with_parts(
    f"select capture, {big('session', 'session')}, campaign_split, {r6('t0', 't0')}, {r6('t1', 't1')} from bgs", _BG))
def backgrounds(spark, sf_dir):
    return _backgrounds(spark, sf_dir)


@query("pivot_hosts", with_parts(f"""
select capture, stage, {big('snippet', 'snippet')}, ip as "pivot" from (
  select capture, stage, snippet, ip, row_number() over (partition by capture, stage, snippet order by side, count(*) desc, ip) as rk
  from (select capture, stage, snippet, 0 as side, src_ip as ip from members where src_int
        union all select capture, stage, snippet, 1, dst_ip from members where dst_int)
  group by capture, stage, snippet, side, ip) where rk = 1""", *_SNIP))
def pivots(spark, sf_dir):
    _, members = _snippets(spark, sf_dir)
    return cp.pivot_hosts(members, CFG.internal_cidrs, ["capture", "stage", "snippet"])


def _plan(spark, sf_dir):
    """Every background in turn gets the snippets that share its capture and hour of day bucket."""
    b = _backgrounds(spark, sf_dir).select(
        F.concat_ws("-", F.lit("camp"), "capture", F.col("t0").cast("bigint").cast("string")).alias("campaign"),
        F.col("capture").alias("bg_capture"), F.col("t0").alias("bg_t0"), F.col("t1").alias("bg_t1"), "campaign_split")
    table_, _ = _snippets(spark, sf_dir)
    s = table_.select("capture", "stage", "snippet", "t0")
    slot = F.pmod(F.floor(F.col("bg_t0") / 3600), F.lit(5))
    hour = F.pmod(F.floor(F.col("t0") / 3600), F.lit(5))
    joined = b.withColumn("_k", slot).join(
        s.withColumns({"_k": hour, "bg_capture": F.col("capture")}), ["bg_capture", "_k"], "left").drop("_k")
    return joined.withColumns({
        "at": F.col("bg_t0") + 7200.0, "length": F.lit(36000.0), "victim": F.lit("192.168.1.3"),
        "pool": F.array(F.lit("192.168.1.3"), F.lit("192.168.1.5"))})


# Members of the plan, per campaign: what was injected and where the pivot went.
_PLAN = ("plan", """select 'camp-' || b.capture || '-' || cast(b.t0 as bigint) as campaign, b.capture as bg_capture, b.t0 as bg_t0,
  b.t1 as bg_t1, s.capture, s.stage, s.snippet, s.t0
from bgs b join (select capture, stage, snippet, min(t0) as t0 from members group by 1, 2, 3 having count(*) >= 2) s
  on s.capture = b.capture and cast(floor(s.t0 / 3600) as bigint) % 5 = cast(floor(b.t0 / 3600) as bigint) % 5""")


@query("campaign_injection", with_parts(f"""
select campaign as capture, {big('count(*)', 'flows')}, {big('count(*) filter (is_attack)', 'attack_flows')},
  {r6('sum(ts - bg_t0)', 'time_sum')}
from (select p.campaign, p.bg_t0, f.ts, f.is_attack from (select distinct campaign, bg_capture, bg_t0, bg_t1 from plan) p
    join flows f on f.capture = p.bg_capture and f.ts between p.bg_t0 and p.bg_t1
  union all
  select p.campaign, p.bg_t0, m.ts + (p.bg_t0 + 7200.0::double - p.t0), true from plan p
    join members m on m.capture = p.capture and m.stage = p.stage and m.snippet = p.snippet
      and m.ts <= p.t0 + 36000.0::double)
group by campaign""", *_SNIP, _BG, _PLAN))
def injection(spark, sf_dir):
    plan = stored(spark, sf_dir, "plan", lambda: _plan(spark, sf_dir).filter("stage is not null"))
    _, members = _snippets(spark, sf_dir)
    out = cp.inject(flows(spark, sf_dir), members, plan, CFG.internal_cidrs, CFG.window_seconds)
    starts = plan.select(F.col("campaign").alias("capture"), "bg_t0").distinct()
    return out.join(starts, "capture").groupBy("capture").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("is_attack").alias("attack_flows"),
        F.sum(F.col("ts") - F.col("bg_t0")).alias("time_sum"))


@query("campaign_windows")
def campaign_windows(spark, sf_dir):
    """Campaign windows through the ordinary label job, tagged with their split."""
    from netloom.plans.build import label_windows
    plan = stored(spark, sf_dir, "plan", lambda: _plan(spark, sf_dir).filter("stage is not null"))
    _, members = _snippets(spark, sf_dir)
    out = cp.inject(flows(spark, sf_dir), members, plan, CFG.internal_cidrs, CFG.window_seconds)
    win = cp.campaign_windows(out, CFG, plan, label_windows)
    return win.select(*KEYS, "campaign_split", "synthetic", "stage_now", "episode", "y_6")


# ------------------------------------------------------------------ reports
@query("capture_summary", with_parts(f"""
select capture, {big('count(*)', 'windows')}, {big('count(distinct session)', 'sessions')},
  {big('count(*) filter (stage_now > 0)', 'attack_windows')},
  {big('count(distinct episode) filter (episode >= 0)', 'episodes')}, {big('count(*) filter (is_onset)', 'onsets')},
  {big('count(*) filter (is_stage_onset)', 'stage_onsets')}, {big('count(*) filter (is_recurrence)', 'recurrences')},
  {', '.join(big(f'count(*) filter (stage_now = {i})', f'stage_{i}') for i in range(7))} from split group by capture"""))
def summary(spark, sf_dir):
    return rp.capture_summary(stored_split(spark, sf_dir))


@query("episode_table", with_parts(f"""
select capture, {big('episode', 'episode')}, {r6('min(t)', 'start_t')}, {r6('max(t)', 'end_t')},
  array_to_string(list_sort(list_distinct(list(stage_now) filter (stage_now > 0))), ',') as stages,
  array_to_string(list_sort(list_distinct(list(family_now) filter (family_now is not null))), ',') as families,
  bool_or(is_onset) as onset, {big('count(*) filter (stage_now > 0)', 'attack_windows')}
from split where episode >= 0 group by capture, episode"""))
def episode_table(spark, sf_dir):
    df = rp.episode_table(stored_split(spark, sf_dir))
    return df.withColumns({"stages": F.array_join(F.transform("stages", lambda x: x.cast("string")), ","),
                           "families": F.array_join("families", ",")})


_SCHED = ("schedule", """select 'slot' || (row_number() over (order by capture, t)) as slot, capture, family_now as family,
  t + 900.0::double as a, t + 7200.0::double as b from win where family_now is not null and n_flows > 1""")


@query("label_audit", with_parts(f"""
select s.capture, s.family, {r6('s.a', 'start')}, {r6('min(w.t)', 'first_t')}, {r6('max(w.t)', 'last_t')},
  {r6('(min(w.t) - s.a) / 60.0', 'offset_min')}, coalesce(abs(min(w.t) - s.a) <= 1200, false) as passed
from schedule s left join win w on w.capture = s.capture and w.family_now = s.family
  and w.t between s.a - 1800 and s.b + 1800 and not (s.family = 'Infiltration' and w.stage_now = 1)
group by s.slot, s.capture, s.family, s.a""", _SCHED))
def label_audit(spark, sf_dir):
    win = stored_split(spark, sf_dir)
    schedule = win.filter("family_now is not null and n_flows > 1").select(
        F.concat_ws("@", "capture", "window").alias("slot"), "capture", F.col("family_now").alias("family"),
        (F.col("t") + 900.0).alias("start"), (F.col("t") + 7200.0).alias("end"))
    out = rp.label_audit(win, schedule, tolerance=1200.0)
    return out.join(schedule.select("slot", "start"), "slot").drop("slot")


@query("seed_table", f"""
select 'p1' as protocol, source as model, 'len' as metric, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')}, {big('count(v)', 'seeds')}
from (select source, doc_id % 3 as seed, avg(n_chars) as v from documents group by 1, 2) group by source""")
def seed_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    results = docs.groupBy("source", (F.col("doc_id") % 3).alias("seed")).agg(F.avg("n_chars").alias("value"))
    return rp.seed_table(results.select(F.lit("p1").alias("protocol"), F.col("source").alias("model"), "seed",
                                        F.lit("len").alias("metric"), "value"))


@query("refine_stages", with_parts(f"""
select {big('flow_id', 'flow_id')}, case when stage = 'LateralMovement' and not starts_with(src_ip, '192.168.1.2')
  then 'Reconnaissance' else stage end as stage,
  case when stage = 'LateralMovement' and not starts_with(src_ip, '192.168.1.2') then 'T1595' end as technique from flows"""))
def refine(spark, sf_dir):
    return refine_stages(flows(spark, sf_dir), ["192.168.1.2/32"]).select("flow_id", "stage", "technique")

