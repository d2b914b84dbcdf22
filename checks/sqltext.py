"""DuckDB building blocks: the same tables the engine derives, written independently in SQL."""

from __future__ import annotations

import re

from checks.registry import FAMILIES, FLOW_TEXT
from netloom import vocab

_FLOWS = FLOW_TEXT.format(S="varchar", EP="epoch(ts)", J="json_extract_string(props,'$.k')", T="events")
_STAGES = ", ".join(f"'{s}'" for s in vocab.STAGES)
_FAMS = ", ".join(f"'{s}'" for s in FAMILIES)


def _ports(values: tuple[int, ...]) -> str:
    return "(" + ",".join(map(str, values)) + ")"


PARTS: dict[str, str] = {}

PARTS["flows"] = f"""
select *, cast(floor(ts/3600.0) as bigint) as win, [{_STAGES}][stage_no+1] as stage,
  [{_FAMS}][stage_no+1] as family, stage_no > 0 as is_attack,
  stage_no > 0 and flow_id % 4 = 0 as attempted,
  starts_with(src_ip, '192.168.1.') as src_int, starts_with(dst_ip, '192.168.1.') as dst_int
from ({_FLOWS})"""

# ---------------------------------------------------------------- labels, spine, targets
PARTS["lab"] = """
select capture, win, count(*) as n_flows, count(*) filter (is_attack) as n_attack_flows,
  coalesce(max(stage_no), 0) as stage_now,
  coalesce(bool_and(attempted) filter (is_attack), false) as attempted_only
from flows group by capture, win"""
PARTS["fam"] = """
select capture, win, family as family_now from (
  select capture, win, family, row_number() over (partition by capture, win order by count(*) desc, family) as rn
  from flows where is_attack group by capture, win, family) where rn = 1"""
PARTS["sess"] = """
select capture, session, min(win) as lo, max(win) as hi from (
  select capture, win, sum(brk) over (partition by capture order by win) as session from (
    select capture, win,
      case when win - lag(win) over (partition by capture order by win) > 2 then 1 else 0 end as brk from lab))
group by capture, session"""
PARTS["spine"] = """
select capture, cast(session as bigint) as session, lo, hi, unnest(generate_series(lo, hi)) as win from sess"""
PARTS["win"] = """
select s.capture, s.session, s.capture || '#' || s.session as session_key, s.win,
  s.win * 3600.0::double as t, s.win - s.lo as pos, s.hi - s.win as remaining,
  coalesce(l.n_flows, 0) as n_flows, coalesce(l.n_attack_flows, 0) as n_attack_flows,
  coalesce(l.stage_now, 0) as stage_now, f.family_now,
  coalesce(l.attempted_only, false) as attempted_only,
  s.win - s.lo < 12 as warmup, case when s.win - s.lo >= 8 then 1.0 else 0.0 end as m_lookback
from spine s left join lab l on s.capture = l.capture and s.win = l.win
left join fam f on s.capture = f.capture and s.win = f.win"""
PARTS["tgt"] = """
select *, t_next is not null and t_next - pos <= 3 and remaining >= 3 as y_3, remaining >= 3 as valid_3,
  t_next is not null and t_next - pos <= 6 and remaining >= 6 as y_6, remaining >= 6 as valid_6,
  coalesce(t_next - pos, -1) as time_to_compromise, coalesce(s_next, 0) as next_attack_stage
from (select w.*,
    min(pos) filter (stage_now >= 2) over fut as t_next,
    arg_min(stage_now, pos) filter (stage_now > 0) over fut as s_next,
    max(pos) filter (stage_now >= 2) over past as c_prev
  from win w
  window fut as (partition by session_key order by pos rows between 1 following and unbounded following),
    past as (partition by session_key order by pos rows between unbounded preceding and 1 preceding))"""
PARTS["hits"] = """
select capture, session_key, pos, win, prev_pos,
  case when prev_pos is null or pos - prev_pos - 1 > 3 then 1 else 0 end as is_start
from (select *, lag(pos) over (partition by session_key order by pos) as prev_pos from win where stage_now > 0)"""
PARTS["eps"] = """
select capture, session_key, episode, min(pos) as p0, max(pos) as p1 from (
  select *, sum(is_start) over (partition by capture order by win) - 1 as episode from hits)
group by capture, session_key, episode"""
PARTS["epi"] = """
select w.*, coalesce(e.episode, -1) as episode, e.episode is not null as in_episode,
  coalesce(w.pos = e.p0 and w.pos - coalesce(q.prev_end, -1) - 1 >= 3, false) as is_onset,
  coalesce(w.stage_now > 0 and p.stage_now = 0 and w.pos > e.p0, false) as is_recurrence,
  w.stage_now > 0 and (o.last_pos is null or w.pos - o.last_pos > 3) as is_stage_onset
from tgt w
left join eps e on e.session_key = w.session_key and w.pos between e.p0 and e.p1
left join (select session_key, episode, lag(p1) over (partition by session_key order by p0) as prev_end from eps) q
  on q.session_key = e.session_key and q.episode = e.episode
left join win p on p.session_key = w.session_key and p.pos = w.pos - 1
left join (select session_key, pos, lag(pos) over (partition by session_key, stage_now order by pos) as last_pos
           from win) o on o.session_key = w.session_key and o.pos = w.pos"""
PARTS["split"] = """
select e.*, len, train_end, cal_end,
  case when pos < 12 then null when pos + 6 < train_end then 'train'
       when pos >= train_end and pos + 6 < cal_end then 'calibration'
       when pos >= cal_end then 'test' end as split,
  pos < train_end as fit_row
from (select e.*, len, cast(trunc(len * 0.6::double) as bigint) as train_end,
        cast(trunc(len * 0.6::double) as bigint) + cast(trunc(len * 0.15::double) as bigint) as cal_end
      from (select *, count(*) over (partition by session_key) as len from epi) e) e"""
# A score any model could have given each window; many ties on purpose.
PARTS["scored"] = """
select *, ((win * 37 + n_flows * 11 + stage_now * 29) % 100) / 100.0::double as score,
  ((win * 53 + n_flows * 7 + pos * 3 + stage_now * 41) % 100) / 100.0::double as score_b,
  y_6 as y from split"""
PARTS["test"] = "select * from scored where split = 'test' and valid_6"
PARTS["cal"] = "select * from scored where split = 'calibration' and valid_6"

# ---------------------------------------------------------------- features
_FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]
_tot = "(" + "+".join(f"sum({f}_count)" for f in _FLAGS) + "+1e-9)"
_flag_entropy = "-(" + "+".join(
    f"(sum({f}_count)/{_tot})*log2(sum({f}_count)/{_tot}+1e-9)" for f in _FLAGS) + ")/log2(6)"
PARTS["agg"] = f"""
select capture, win, count(*)::double as flow_count, count(*)/3600.0::double as flow_rate,
  sum(fwd_bytes) as fwd_bytes_total, sum(bwd_bytes) as bwd_bytes_total,
  (sum(fwd_bytes)+sum(bwd_bytes))/3600.0::double as bytes_rate,
  sum(fwd_packets) as fwd_packets_total, sum(bwd_packets) as bwd_packets_total,
  (sum(fwd_packets)+sum(bwd_packets))/3600.0::double as packets_rate,
  avg(fwd_bytes+bwd_bytes) as bytes_per_flow_mean, stddev_samp(fwd_bytes+bwd_bytes) as bytes_per_flow_std,
  max(fwd_bytes+bwd_bytes) as bytes_per_flow_max,
  avg(fwd_packets+bwd_packets) as packets_per_flow_mean, stddev_samp(fwd_packets+bwd_packets) as packets_per_flow_std,
  max(fwd_packets+bwd_packets) as packets_per_flow_max,
  avg(duration) as duration_mean, stddev_samp(duration) as duration_std, max(duration) as duration_max,
  {", ".join(f"sum({f}_count)/(count(*)+1e-9) as {f}_rate" for f in _FLAGS)},
  sum(syn_count)/(sum(ack_count)+1.0::double) as syn_ack_ratio,
  avg((syn_count>0 and ack_count<=0)::int) as unanswered_syn_frac, avg((rst_count>0)::int) as rst_frac,
  {_flag_entropy} as flag_entropy,
  avg((protocol=6)::int) as tcp_frac, avg((protocol=17)::int) as udp_frac, avg((protocol=1)::int) as icmp_frac,
  avg((protocol not in (1,6,17))::int) as other_proto_frac,
  avg(iat_mean) as iat_mean_mean, stddev_samp(iat_mean) as iat_mean_std, min(iat_mean) as iat_mean_min,
  max(iat_max) as iat_max_max, avg(iat_std) as iat_std_mean,
  1.0::double/(1.0::double+stddev_samp(iat_mean)/(avg(iat_mean)+1e-9)) as iat_regularity,
  count(distinct src_ip)::double as unique_src_hosts, count(distinct dst_ip)::double as unique_dst_hosts,
  count(distinct dst_port)::double as unique_dst_ports, count(distinct src_port)::double as unique_src_ports,
  avg((dst_port>=0 and dst_port<1024)::int) as low_port_frac, avg((dst_port>=49152)::int) as ephemeral_port_frac,
  avg((dst_port in {_ports(vocab.WELL_KNOWN_PORTS)})::int) as well_known_service_frac,
  avg(fwd_bytes/(fwd_bytes+bwd_bytes+1e-9)) as bidirectional_ratio_mean,
  avg((bwd_bytes<=0)::int) as unidirectional_flow_frac, avg((bwd_packets<=0)::int) as empty_response_frac,
  avg(ttl_mean) as ttl_mean_mean, max(ttl_mean)-min(ttl_mean) as ttl_spread,
  avg((duration<3)::int) filter (dst_port in {_ports(vocab.AUTH_PORTS)}) as auth_short_frac,
  avg((src_int and dst_int)::int) as int_int_frac,
  avg((dst_port in {_ports(vocab.MAIL_PORTS)})::int) as smtp_frac,
  sum(fwd_bytes) filter (src_int and not dst_int and duration>=60) as long_out_bytes,
  max((ttl_mean is not null)::int)::double as m_packet
from flows group by capture, win"""
for _c, _n in (("dst_port", "dst_port_entropy"), ("src_port", "src_port_entropy"),
               ("dst_ip", "dst_ip_entropy"), ("src_ip", "src_ip_entropy")):
    PARTS[f"ent_{_c}"] = f"""
select capture, win, case when count(*)<=1 then 0.0 else
  -sum((n/tot)*log2(n/tot))/log2(count(*)) end as {_n}
from (select capture, win, {_c}, count(*)::double as n, sum(count(*)) over (partition by capture, win)::double as tot
      from flows group by capture, win, {_c}) group by capture, win"""


def _max_count(name: str, keys: str, cond: str, what: str = "count(*)") -> None:
    PARTS[name] = f"""
select capture, win, max(n)::double as {name} from (
  select capture, win, {keys}, {what} as n from flows where {cond} group by capture, win, {keys})
group by capture, win"""


_max_count("auth_conn_max", "src_ip, dst_ip", f"dst_port in {_ports(vocab.AUTH_PORTS)}")
_max_count("web_conn_max", "src_ip, dst_ip", f"dst_port in {_ports(vocab.WEB_PORTS)}")
_max_count("half_open_max", "src_ip", "syn_count>0 and ack_count<=0")
_max_count("dns_max", "src_ip", "dst_port=53")
_max_count("flows_per_host_max", "src_ip", "true")
_max_count("icmp_sweep_max", "src_ip", "protocol=1", "count(distinct dst_ip)")
_max_count("int_fanout_max", "src_ip", "src_int and dst_int", "count(distinct dst_ip)")
_max_count("int_scan_max", "src_ip, dst_port", "src_int and dst_int", "count(distinct dst_ip)")
PARTS["fan"] = """
select capture, win, max(d)::double as fanout_max, avg(d) as fanout_mean,
  max(p)::double as ports_per_src_max, avg(p) as ports_per_src_mean
from (select capture, win, src_ip, count(distinct dst_ip) as d, count(distinct dst_port) as p
      from flows group by capture, win, src_ip) group by capture, win"""
PARTS["newport"] = """
select p.capture, p.win, avg((q.dst_port is null)::int) as new_dst_port_frac
from (select distinct capture, win, dst_port from flows) p
join (select capture, win, lag(win) over (partition by capture order by win) as prev from lab) o
  on o.capture = p.capture and o.win = p.win
left join (select distinct capture, win, dst_port from flows) q
  on q.capture = p.capture and q.win = o.prev and q.dst_port = p.dst_port
group by p.capture, p.win"""
PARTS["seq"] = """
select capture, win, max(s) as seq_port_score from (
  select capture, win, src_ip, avg((abs(d)=1)::int) as s, count(*) as n from (
    select capture, win, src_ip,
      dst_port - lag(dst_port) over (partition by capture, win, src_ip order by ts, flow_id) as d
    from flows where dst_port >= 0) group by capture, win, src_ip) where n >= 3 group by capture, win"""
PARTS["exfil"] = """
select capture, win, max(o) as out_bytes_max,
  max(case when o+i >= 10000 then (o-i)/(o+i+1.0::double) end) as out_asym_max
from (select capture, win, host, sum(o) as o, sum(i) as i from (
    select capture, win, src_ip as host, fwd_bytes as o, bwd_bytes as i from flows where src_int and not dst_int
    union all
    select capture, win, dst_ip, bwd_bytes, fwd_bytes from flows where dst_int and not src_int)
  group by capture, win, host) group by capture, win"""
PARTS["pairs"] = """
select capture, win, avg(isnew::int) as new_pair_frac,
  sum((isnew and si and di)::int)::double as new_int_pairs from (
  select *, coalesce(win - lag(win) over (partition by capture, src_ip, dst_ip order by win) > 8, true) as isnew
  from (select distinct capture, win, src_ip, dst_ip, src_int as si, dst_int as di from flows))
group by capture, win"""
PARTS["beaconflows"] = """
select capture, win, src_ip, dst_ip, dst_port, flow_id,
  case when n >= 4 and m between 2 and 1e6 and mi >= 1 then 1.0::double/(1.0::double+s/m) else 0.0 end as score
from (select *, count(gap) over w6 as n, avg(gap) over w6 as m, stddev_samp(gap) over w6 as s, avg(idle) over w6 as mi
  from (select *, ts - lag(ts) over ch as gap, ts - lag(te) over ch as idle from flows
        window ch as (partition by capture, src_ip, dst_ip, dst_port order by ts, flow_id))
  window w6 as (partition by capture, src_ip, dst_ip, dst_port order by ts, flow_id
                rows between 5 preceding and current row))"""
PARTS["beacon"] = """
select capture, win, max(score) as beacon_max,
  count(distinct (src_ip, dst_ip, dst_port)) filter (score >= 0.8)::double as beacon_pairs
from beaconflows group by capture, win"""
_FEATURE_TABLES = ["ent_dst_port", "ent_src_port", "ent_dst_ip", "ent_src_ip", "auth_conn_max", "web_conn_max",
                   "half_open_max", "dns_max", "flows_per_host_max", "icmp_sweep_max", "int_fanout_max",
                   "int_scan_max", "fan", "newport", "seq", "exfil", "pairs", "beacon"]
PARTS["rawfeat"] = "select * from agg " + " ".join(
    f"left join {t} using (capture, win)" for t in _FEATURE_TABLES)
_ABSENT = {"ttl_var_mean", "ttl_unique_mean", "win_mean_mean", "win_std_mean", "win_zero_rate", "frag_rate_mean",
           "retrans_rate", *[f"payload_hist_{i}_mean" for i in range(8)]}


def feature_value(name: str, src: str = "") -> str:
    return "0.0::double" if name in _ABSENT else f"coalesce({src}{name}, 0.0::double)"


# Features on the whole spine (idle windows are zero states).
PARTS["feat"] = (
    "select w.*, " + ", ".join(f"{feature_value(n, 'f.')} as {n}" for n in vocab.FEATURE_NAMES)
    + ", coalesce(f.m_packet, 0.0::double) as m_packet, 1.0::double as m_ip"
    + " from split w left join rawfeat f on f.capture = w.capture and f.win = w.win")


def with_parts(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the building blocks it uses, directly or indirectly."""
    pool = dict(PARTS)
    local = dict(extra)
    pool.update(local)
    need: list[str] = []

    def visit(text: str, seen: frozenset[str]) -> None:
        words = set(re.findall(r"(?:from|join)\s+([a-z_][a-z_0-9]*)", text))
        for name in pool:
            if name in words and name not in seen and name not in need:
                visit(pool[name], seen | {name})
                if name not in need:
                    need.append(name)

    visit(body, frozenset())
    return "with " + ",\n".join(f"{n} as ({pool[n]})" for n in need) + "\n" + body
