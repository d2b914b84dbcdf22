"""Readers, parsers and stored tables, fed with files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_metrics import scored
from checks.q_splits import stored_split
from checks.q_states import KEYS
from checks.registry import CFG, big, flows, query, r6, table
from checks.sqltext import with_parts
from netloom import vocab
from netloom.functions import scalars as sc
from netloom.operators import labels as lb
from netloom.plans.build import build_windows, merge_packet_block
from netloom.session import scratch_path
from netloom.sources import csv_flows as cf
from netloom.sources import packets as pk
from netloom.sources import tables as st

ID = big("event_id", "event_id")
WIN = big("win", '"window"')

# Labels as different releases spell them, by event number.
_SPELLINGS = ("BENIGN", "Portscan", "Infiltration - Portscan", "Infiltration – Attempted", "DoS  Hulk - Attempted",
              "Web Attack – XSS", "Botnet Ares", "ddos-loic-http", "Port Scan", " SSH-Patator ")
_spell_sql = ", ".join(f"'{s}'" for s in _SPELLINGS)
_KEYS = [s.replace("–", "-").replace(" ", " ") for s in _SPELLINGS]


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def spelled(df):
    return df.withColumn("label", F.get(F.array(*[F.lit(s) for s in _SPELLINGS]),
                                        (F.col("event_id") % len(_SPELLINGS)).cast("int")))


_norm = "regexp_replace(lower(trim(regexp_replace(replace(replace([{0}][event_id % 10 + 1], chr(8211), '-'), chr(160), ' '), '\\s+', ' ', 'g'))), '\\s*-\\s*', '-', 'g')".format(_spell_sql)


@query("normalise_label", f"select {ID}, {_norm} as label_key, ends_with({_norm}, '-attempted') as attempted from events")
def normalise_label(spark, sf_dir):
    df = spelled(events(spark, sf_dir))
    return df.select("event_id", sc.normalise_label(F.col("label")).alias("label_key"),
                     sc.is_attempted(F.col("label")).alias("attempted"))


def _known() -> str:
    rows = []
    for r in vocab.LABEL_MAP["cicids"]:
        for name in (r.label, *r.aliases):
            key = "-".join(x.strip() for x in " ".join(name.lower().split()).split("-"))
            rows.append(f"('{key}', '{r.family}', '{r.stage}', {'null' if r.technique is None else repr(r.technique)})")
    return ", ".join(dict.fromkeys(rows))


@query("resolve_labels", f"""
select {ID}, coalesce(a.f, b.f) as family, coalesce(a.s, b.s) as stage, coalesce(a.t, b.t) as technique,
  coalesce(a.s, b.s) <> 'Benign' as is_attack, ends_with(k, '-attempted') as attempted
from (select event_id, {_norm} as k from events) e
left join (values {_known()}) a(k, f, s, t) using (k)
left join (values {_known()}) b(k, f, s, t) on b.k = regexp_replace(e.k, '-attempted$', '')""")
def resolve(spark, sf_dir):
    df = lb.resolve_exact(spelled(events(spark, sf_dir)).select("event_id", "label"), lb.label_dimension(spark, "cicids"))
    return df.select("event_id", "family", "stage", "technique", "is_attack", "attempted")


@query("unmapped_labels", """
select distinct event_type as label from events where lower(event_type) not in ('benign', 'normal', 'bot')""")
def unmapped(spark, sf_dir):
    df = events(spark, sf_dir).select(F.col("event_type").alias("label"))
    return lb.unmapped_labels(df, lb.label_dimension(spark, "cicids"))


_TOK = ("flow=From-Botnet-V42-TCP-CC73-Not-Encrypted", "flow=From-Botnet-V1-TCP-WEB-Established-SSL",
        "flow=From-Botnet-V50-UDP-Attempt", "flow=From-Botnet-V1-UDP-DNS", "flow=Background-UDP",
        "flow=To-Normal-V42-Jist", "flow=From-Botnet-V49-ICMP", "flow=From-Botnet-V1-SPAM", "",
        "flow=From-Botnet-V2-TCP-Attempt")
_tok_sql = ", ".join(f"'{t}'" for t in _TOK)


@query("resolve_tokens", f"""
select {ID}, {big('scenario', 'scenario')}, {big("len(list_filter(string_split_regex(regexp_replace(k, '^flow=', ''), '[-\\s]+'), lambda t: t <> ''))", 'tokens')},
  case when k not like '%botnet%' then 'Benign' when k like '%spam%' then 'Spam'
    when regexp_matches(k, '(^|-)cc[0-9]+(-|$)') or list_contains(string_split(k, '-'), 'dns') then 'Botnet'
    when (list_contains(string_split(k, '-'), 'icmp') or list_contains(string_split(k, '-'), 'udp')) and scenario in (4, 10, 11) then 'DDoS'
    when list_contains(string_split(k, '-'), 'attempt') and scenario in (3, 5, 6, 8, 9, 12, 13) then 'PortScan'
    else 'Botnet' end as family
from (select event_id, 1 + event_id % 13 as scenario, lower([{_tok_sql}][event_id % 10 + 1]) as k from events)""")
def tokens(spark, sf_dir):
    label = F.get(F.array(*[F.lit(t) for t in _TOK]), (F.col("event_id") % 10).cast("int"))
    df = events(spark, sf_dir).select("event_id", (F.col("event_id") % 13 + 1).alias("scenario"), label.alias("label"))
    return lb.resolve_tokens(df).select("event_id", "scenario", F.size(sc.label_tokens(F.col("label"))).alias("tokens"),
                                        "family")


# ------------------------------------------------------------------ scalars
_LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss",
            "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm", "d/M/yy H:mm", "dd-MM-yyyy HH:mm:ss")


@query("parse_time", f"""
select {ID}, {r6('''case event_id % 11 when 0 then epoch(ts) when 1 then floor(epoch(ts)) when 2 then floor(epoch(ts) * 1000) / 1000
  when 6 then floor(epoch(ts) / 60) * 60 when 7 then floor(epoch(ts) / 60) * 60 when 9 then floor(epoch(ts)) when 10 then -1
  else floor(epoch(ts)) end''', 'ts')} from events""")
def parse_time(spark, sf_dir):
    """Every layout, plain epoch numbers and junk, over all events."""
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 11
    text = F.when(kind == 9, F.floor(F.unix_micros(at) / 1000000).cast("string")).when(kind == 10, "n/a")
    for i, layout in enumerate(_LAYOUTS):
        text = F.when(kind == i, F.date_format(at, layout)).otherwise(text)
    parsed = sc.parse_time(F.concat(F.lit(" "), text, F.lit(" ")))
    return events(spark, sf_dir).select("event_id", F.coalesce(parsed, F.lit(-1.0)).alias("ts"))


@query("parse_ports", f"""
select {ID}, {big('''case event_id % 5 when 0 then event_id % 70000 when 1 then event_id % 65536 when 2 then -1 when 3 then -1 else event_id % 65536 end
  * (case when event_id % 5 = 0 and event_id % 70000 > 65535 then 0 else 1 end) - (case when event_id % 5 = 0 and event_id % 70000 > 65535 then 1 else 0 end)''', 'port')},
  {big("case event_id % 4 when 0 then 6 when 1 then 17 when 2 then 58 else 0 end", 'protocol')} from events""")
def parse_ports(spark, sf_dir):
    e = F.col("event_id")
    text = (F.when(e % 5 == 0, (e % 70000).cast("string")).when(e % 5 == 1, F.concat(F.lit("0x"), F.lower(F.hex(e % 65536))))
            .when(e % 5 == 2, "-4").when(e % 5 == 3, "icmp").otherwise(F.concat(F.lit(" "), (e % 65536).cast("string"))))
    proto = F.when(e % 4 == 0, "6").when(e % 4 == 1, " UDP ").when(e % 4 == 2, "IPv6-ICMP").otherwise("carp")
    return events(spark, sf_dir).select("event_id", sc.port_number(text).alias("port"),
                                        sc.protocol_number(proto).alias("protocol"))


@query("ip_membership", f"""
select {ID}, {big('''case event_id % 6 when 4 then -1 when 5 then -1 else (10 + event_id % 3) * 16777216 + (event_id % 256) * 65536
  + (user_id % 256) * 256 + event_id % 200 end''', 'ip')},
  event_id % 6 < 4 and (event_id % 3 = 0 or (event_id % 3 = 1 and event_id % 256 between 16 and 31)) as internal from events""")
def ip_membership(spark, sf_dir):
    e = F.col("event_id")
    good = F.concat_ws(".", (e % 3 + 10).cast("string"), (e % 256).cast("string"), (F.col("user_id") % 256).cast("string"),
                       (e % 200).cast("string"))
    ip = F.when(e % 6 == 4, "fe80::1").when(e % 6 == 5, F.concat(good, F.lit(".1"))).otherwise(good)
    return events(spark, sf_dir).select(
        "event_id", F.coalesce(sc.ipv4_number(ip), F.lit(-1)).alias("ip"),
        sc.in_networks(ip, ("10.0.0.0/8", "11.16.0.0/12")).alias("internal"))


@query("logit_interpolation", f"""
select {big('l_orderkey', 'l_orderkey')}, {big('l_linenumber', 'l_linenumber')},
  {r6('ln(least(greatest(l_discount, 0.0001), 0.9999) / (1 - least(greatest(l_discount, 0.0001), 0.9999)))', 'logit')},
  {r6('case when l_discount < 0.02 then 0.1 when l_discount >= 0.08 then 0.9 when l_discount < 0.05 then 0.1 + 0.4 * (l_discount - 0.02) / 0.03::double else 0.5 + 0.4 * (l_discount - 0.05) / 0.03::double end', 'mapped')}
from lineitem""")
def logit_interpolation(spark, sf_dir):
    d = F.col("l_discount")
    knots = F.lit([0.02, 0.05, 0.08]), F.lit([0.1, 0.5, 0.9])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sc.logit(d).alias("logit"),
                                                   sc.interpolate(d, *knots).alias("mapped"))


@query("compress_values", f"""
select {big('o_orderkey', 'o_orderkey')}, {r6("case when o_orderkey % 7 = 0 then 0 else sign(o_totalprice - 100000) * ln(1 + abs(o_totalprice - 100000)) end", 'compressed')}
from orders""")
def compress_values(spark, sf_dir):
    x = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") - 100000)
    return table(spark, sf_dir, "orders").select("o_orderkey", sc.compress(x, True).alias("compressed"))


# ------------------------------------------------------------------ CSV dialects
def _flowmeter_csv(spark, sf_dir, stage_column: bool = False) -> str:
    f = flows(spark, sf_dir)
    at = F.timestamp_micros(F.round(F.col("ts") * 1000000).cast("bigint"))
    cells = [
        F.concat_ws("-", "src_ip", "dst_ip", F.col("src_port").cast("string"), F.col("dst_port").cast("string"), F.lit("6")).alias("Flow ID"),
        F.col("src_port").alias(" Source Port"), F.col("dst_port").alias(" Destination Port"), F.col("protocol").alias(" Protocol"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(" Timestamp"), (F.col("duration") * 1e6).alias(" Flow Duration"),
        F.col("fwd_packets").alias(" Total Fwd Packets"), F.col("bwd_packets").alias(" Total Backward Packets"),
        F.when(F.col("flow_id") % 50 == 7, "Infinity").otherwise(F.col("fwd_bytes").cast("string")).alias("Total Length of Fwd Packets"),
        F.col("bwd_bytes").alias(" Total Length of Bwd Packets"), F.col("syn_count").alias("SYN Flag Count"),
        F.col("iat_mean").alias("Flow IAT Mean"), F.lit(8192).alias("Init_Win_bytes_forward"),
        F.lit(-1).alias("Fwd Init Win Bytes"), F.when(F.col("is_attack"), "DoS Hulk - Attempted").otherwise("BENIGN").alias("Label"),
    ]
    if stage_column:
        cells += [F.lit("x").alias("Activity"), F.when(F.col("is_attack"), "Lateral Movement").otherwise("Benign").alias("Stage")]
    path = scratch_path(spark, "csv")
    f.select(*cells).write.option("header", "true").csv(path)
    return path




@query("read_flowmeter", with_parts(f"""
select src_ip, dst_ip, {big('dst_port', 'dst_port')}, {big('protocol', 'protocol')}, {big('count(*)', 'flows')},
  {r6('max(ts)', 'last_ts')}, {r6('sum(duration)', 'duration')}, {r6('coalesce(sum(case when flow_id % 50 = 7 then null else fwd_bytes end), -1)', 'fwd_bytes')},
  {r6('sum(iat_mean / 1e6)', 'iat_mean')}, {big('count(*) filter (protocol = 6)', 'with_window')},
  {big('count(*) filter (is_attack)', 'attempted')} from flows group by all"""))
def read_flowmeter(spark, sf_dir):
    df = cf.read_flowmeter(spark, cf.list_files(spark, _flowmeter_csv(spark, sf_dir)), "cicids2017")
    return df.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("flows"), F.max("ts").alias("last_ts"), F.sum("duration").alias("duration"),
        F.coalesce(F.sum("fwd_bytes"), F.lit(-1.0)).alias("fwd_bytes"), F.sum("iat_mean").alias("iat_mean"),
        F.count("win_mean").alias("with_window"), F.count_if(F.col("attempted") & F.col("is_attack")).alias("attempted"))


@query("read_stage_labelled", with_parts(f"""
select case when is_attack then 'LateralMovement' else 'Benign' end as stage,
  case when is_attack then 'APT-Lateral' else 'Benign' end as family, {big('count(*)', 'flows')}, {r6('sum(ts) / 1e12', 'ts_sum')}
from flows group by 1, 2"""))
def read_stage_labelled(spark, sf_dir):
    df = cf.read_flows(spark, cf.list_files(spark, _flowmeter_csv(spark, sf_dir, True))[0].rsplit("/", 1)[0], "stage_labelled")
    return df.groupBy("stage", "family").agg(F.count(F.lit(1)).alias("flows"), (F.sum("ts") / 1e12).alias("ts_sum"))


@query("read_folder", with_parts(f"""
select f.src_ip, {big('f.src_port', 'src_port')}, f.dst_ip, {big('f.dst_port', 'dst_port')}, {big('f.protocol', 'protocol')}, {r6('ts', 'ts')},
  {r6('round(duration * 1e6) / 1e6', 'duration')}, {r6('fwd_packets', 'fwd_packets')}, {r6('bwd_bytes', 'bwd_bytes')},
  case when is_attack then 'LateralMovement' else 'Benign' end as stage
from (select * from flows union all select * from flows where flow_id % 100 = 5) f"""))
def read_folder(spark, sf_dir):
    """Events as a folder of files with three column orders, two of them headerless or compressed, and repeated flows."""
    f = flows(spark, sf_dir)
    f = f.unionByName(f.filter("flow_id % 100 = 5"))
    at = F.timestamp_micros(F.round(F.col("ts") * 1000000).cast("bigint"))
    cells = {
        "Flow ID": F.lit("x"), "Src IP": F.col("src_ip"), "Src Port": F.col("src_port"), "Dst IP": F.col("dst_ip"), "Dst Port": F.col("dst_port"),
        "Protocol": F.col("protocol"), "Timestamp": F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "Flow Duration": F.round(F.col("duration") * 1e6), "Total Fwd Packet": F.col("fwd_packets"),
        "Total Length of Bwd Packet": F.col("bwd_bytes"), "Activity": F.lit("y"),
        "Stage": F.when(F.col("is_attack"), "Lateral Movement").otherwise("Benign"),
    }
    root, names = scratch_path(spark, "day"), list(cells)
    swapped = ["Dst IP", "Dst Port", "Flow ID", "Src IP", "Src Port", *names[5:], "Fwd Header Length"]
    cells["Fwd Header Length"] = F.lit(3)
    for part, order, header, codec in ((0, names, True, "none"), (1, names, False, "none"), (2, swapped, True, "gzip")):
        (f.filter(F.col("flow_id") % 3 == part).select(*[cells[n].alias(n) for n in order])
         .write.option("header", str(header).lower()).option("compression", codec).csv(f"{root}/{part}"))
    got = cf.read_flows(spark, root)
    return got.select("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "ts", "duration", "fwd_packets", "bwd_bytes", "stage")


@query("read_argus", with_parts(f"""
select family, {big('dst_port', 'dst_port')}, {big('count(*)', 'flows')}, {r6('sum(fwd_bytes + bwd_bytes - fwd_bytes)', 'bwd_bytes')},
  {r6('sum(round((fwd_packets + bwd_packets) * least(greatest(fwd_bytes / greatest(fwd_bytes + bwd_bytes, 1), 0), 1)))', 'fwd_packets')},
  {r6('sum(duration / greatest(fwd_packets + bwd_packets, 1))', 'iat_mean')}, {big('sum(rst_count)', 'rst')}, {big('sum(syn_count)', 'syn')}
from (select * replace (case when stage_no = 0 then 'Benign' when stage_no % 2 = 0 then 'DDoS' else 'Botnet' end as family,
        case when dst_port = 22 then 771 else dst_port end as dst_port) from flows) group by family, dst_port"""))
def read_argus(spark, sf_dir):
    f = flows(spark, sf_dir)
    at = F.timestamp_micros(F.round(F.col("ts") * 1000000).cast("bigint"))
    label = (F.when(F.col("stage_no") == 0, "flow=Background-TCP").when(F.col("stage_no") % 2 == 0, "flow=From-Botnet-V47-UDP")
             .otherwise("flow=From-Botnet-V47-TCP-Established"))
    state = F.concat(F.when(F.col("syn_count") > 0, "S").otherwise(""), F.lit("_"), F.when(F.col("rst_count") > 0, "r").otherwise(""))
    path = scratch_path(spark, "argus") + "/4/capture.binetflow"
    f.select(
        F.date_format(at, "yyyy/MM/dd HH:mm:ss.SSSSSS").alias("StartTime"), F.col("duration").alias("Dur"), F.lit("tcp").alias("Proto"),
        F.col("src_ip").alias("SrcAddr"), F.col("src_port").alias("Sport"), F.lit("  ->").alias("Dir"), F.col("dst_ip").alias("DstAddr"),
        F.when(F.col("dst_port") == 22, "0x0303").otherwise(F.col("dst_port").cast("string")).alias("Dport"), state.alias("State"),
        (F.col("fwd_packets") + F.col("bwd_packets")).alias("TotPkts"), (F.col("fwd_bytes") + F.col("bwd_bytes")).alias("TotBytes"),
        F.col("fwd_bytes").alias("SrcBytes"), label.alias("Label")).write.option("header", "true").option("compression", "gzip").csv(path)
    df = cf.read_flows(spark, path, scenario=4)
    return df.groupBy("family", "dst_port").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bwd_bytes").alias("bwd_bytes"), F.sum("fwd_packets").alias("fwd_packets"),
        F.sum("iat_mean").alias("iat_mean"), F.sum("rst_count").cast("bigint").alias("rst"),
        F.sum("syn_count").cast("bigint").alias("syn"))


@query("slice_csv", f"select {big('count(*)', 'rows')}, {big('min(event_id)', 'first_id')} from events where ts between '2024-01-05' and '2024-01-09'")
def slice_csv(spark, sf_dir):
    src, out = scratch_path(spark, "raw"), scratch_path(spark, "slice")
    events(spark, sf_dir).select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Time Stamp"),
                                 "value").write.option("header", "true").csv(src)
    cf.slice_csv(spark, src, 1704412800.0, 1704758400.0, out, "Time Stamp")
    back = spark.read.option("header", "true").csv(out)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("event_id").cast("bigint")).alias("first_id"))


# ------------------------------------------------------------------ packets and exporter tables
def _packets(spark, sf_dir):
    """Line items as packets: raw IPv4, IPv6 and broken headers built from their numbers."""
    c = F.col

    def byte(x, width=2):
        return F.lpad(F.hex(x.cast("bigint")), width, "0")

    seq = byte(c("l_suppkey"), 8)
    tcp = F.concat(F.lit("00500050"), seq, F.lit("00000000"), F.lit("5010"), byte(c("l_partkey") % 3 * 1000, 4), F.lit("00000000"))
    v4 = F.concat(F.lit("450000280000"), F.when(c("l_linenumber") == 5, "2000").otherwise("4000"), byte(c("l_quantity") + 30),
                  F.when(c("l_linenumber") == 6, "11").otherwise("06"), F.lit("00000a0000010a000002"), tcp)
    v6 = F.concat(F.lit("6000000000140 6").substr(1, 12), F.lit("06"), byte(c("l_quantity") + 30), F.lit("0" * 64), tcp)
    raw = F.when(c("l_linenumber") == 7, F.lit("4500")).when(c("l_linenumber") == 4, v6).otherwise(v4)
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") % 500).alias("flow_key"), "l_orderkey", "l_linenumber", F.unhex(raw).alias("ip_packet"),
        F.floor(c("l_extendedprice") % 1600).cast("int").alias("payload_size"))


_PK = ("pk", """select l_orderkey % 500 as flow_key, l_orderkey, l_linenumber, cast(floor(l_extendedprice % 1600) as int) as payload,
  case when l_linenumber <> 7 then cast(l_quantity + 30 as int) end as ttl, (l_linenumber = 5)::int as fragmented,
  case when l_linenumber not in (6, 7) then l_suppkey end as tcp_seq,
  case when l_linenumber not in (6, 7) then l_partkey % 3 * 1000 end as tcp_window from lineitem""")


@query("decode_ip", with_parts(f"""
select {big('l_orderkey', 'l_orderkey')}, {big('l_linenumber', 'l_linenumber')}, {big('coalesce(ttl, -1)', 'ttl')},
  {big('fragmented', 'fragmented')}, {big('coalesce(tcp_seq, -1)', 'tcp_seq')}, {big('coalesce(tcp_window, -1)', 'tcp_window')} from pk""", _PK))
def decode_ip(spark, sf_dir):
    df = pk.decode_ip(_packets(spark, sf_dir))
    return df.select("l_orderkey", "l_linenumber", *[F.coalesce(x, F.lit(-1)).alias(x) for x in ("ttl", "fragmented", "tcp_seq", "tcp_window")])


_edges = vocab.PAYLOAD_EDGES
_hist = ", ".join(r6(f"count(*) filter (payload >= {_edges[i]} and payload < {_edges[i + 1]})", f"payload_hist_{i}") for i in range(8))


@query("packet_statistics", with_parts(f"""
select {big('flow_key', 'flow_key')}, {r6('avg(ttl)', 'ttl_mean')}, {r6('case when count(ttl) > 1 then var_pop(ttl) else 0 end', 'ttl_var')},
  {r6('count(distinct ttl)', 'ttl_unique')}, {r6('coalesce(avg(tcp_window), 0)', 'win_mean')},
  {r6('case when count(tcp_window) > 1 then stddev_pop(tcp_window) else 0 end', 'win_std')},
  {r6('count(*) filter (tcp_window = 0)', 'win_zero_count')}, {r6('avg(fragmented)', 'frag_rate')},
  {r6('count(tcp_seq) filter (payload > 0) - count(distinct tcp_seq) filter (payload > 0)', 'retrans_count')}, {_hist}
from pk group by flow_key""", _PK))
def packet_statistics(spark, sf_dir):
    return pk.packet_statistics(pk.decode_ip(_packets(spark, sf_dir)))


@query("export_to_flows", with_parts(f"""
select {big('flow_id', 'event_id')}, {r6('floor(ts * 1000) / 1000', 'ts')}, src_ip, {big('dst_port', 'dst_port')}, {r6('duration', 'duration')},
  {r6('fwd_bytes', 'fwd_bytes')}, {r6('0', 'psh_count')}, {r6('3 / (4 + 1e-9)', 'payload_hist_0')}, {r6('1 / (4 + 1e-9)', 'payload_hist_1')} from flows"""))
def export_to_flows(spark, sf_dir):
    f = flows(spark, sf_dir)
    exported = f.select(
        F.col("flow_id").alias("event_id"), F.floor(F.col("ts") * 1000).alias("bidirectional_first_seen_ms"), "src_ip", "dst_ip",
        "src_port", "dst_port", "protocol", (F.col("duration") * 1000).alias("bidirectional_duration_ms"),
        F.col("fwd_bytes").alias("src2dst_bytes"), F.lit(3).alias("udps.payload_hist_0"), F.lit(1).alias("udps.payload_hist_1"))
    out = pk.export_to_flows(exported, ["event_id"])
    return out.select("event_id", "ts", "src_ip", "dst_port", "duration", "fwd_bytes", "psh_count", "payload_hist_0", "payload_hist_1")


@query("has_packet_level", with_parts("select capture, bool_or(ttl_mean is not null) as has_packet_level from flows group by capture"))
def has_packet_level(spark, sf_dir):
    return cf.has_packet_level(flows(spark, sf_dir), ["capture"])


@query("conform_flows", with_parts(f"""
select {big('flow_id', 'flow_id')}, src_ip, {big('dst_port', 'dst_port')}, {r6('duration', 'duration')}, case when flow_id % 9 = 0 then -1 else {r6('fwd_bytes', 'x')[:-5]} end as fwd_bytes,
  {r6('coalesce(ttl_mean, -1)', 'ttl_mean')}, 'BENIGN' as label, 'Benign' as stage, false as is_attack from flows"""))
def conform_flows(spark, sf_dir):
    """Lenient casts and defaults over text columns without labels."""
    f = flows(spark, sf_dir).drop(*vocab.LABEL_COLUMNS, "win_mean")
    text = f.withColumns({"dst_port": F.col("dst_port").cast("string"), "fwd_bytes": F.when(
        F.col("flow_id") % 9 == 0, "bad").otherwise(F.col("fwd_bytes").cast("string"))})
    out = cf.conform(text, ["flow_id"])
    return out.select("flow_id", "src_ip", "dst_port", "duration", F.coalesce("fwd_bytes", F.lit(-1.0)).alias("fwd_bytes"),
                      F.coalesce("ttl_mean", F.lit(-1.0)).alias("ttl_mean"), "label", "stage", "is_attack")


@query("capture_names", """
select event_id, 'cic17-' || event_type || '_' || event_id % 7 as capture from events""")
def capture_names(spark, sf_dir):
    name = F.concat(F.upper("event_type"), F.lit(" "), (F.col("event_id") % 7).cast("string"), F.lit(".csv.gz"))
    return events(spark, sf_dir).select("event_id", cf.capture_name("cicids2017", cf.file_stem(name)).alias("capture"))


@query("sample_rows", """
select event_id from events order by substr(md5(event_id || '|0'), 1, 8), event_id limit 500""")
def sample_rows(spark, sf_dir):
    from netloom.operators.ranking import sample_rows as sample
    return sample(events(spark, sf_dir).select("event_id"), ["event_id"], 500)


# ------------------------------------------------------------------ stored tables
@query("windows_round_trip", with_parts(f"""
select capture, {big('count(*)', 'windows')}, {big('sum(n_flows)', 'flows')} from split where capture in ('c1', 'c2') group by capture"""))
def windows_round_trip(spark, sf_dir):
    """Partitioned write, then a load that prunes to one dataset's folders."""
    path = scratch_path(spark, "windows")
    df = stored_split(spark, sf_dir).withColumn("dataset", F.when(F.col("capture").isin("c1", "c2"), "d0").otherwise("d1"))
    st.write_partitioned(df, path)
    back = st.load_windows(spark, path, ["d0"])
    return back.groupBy("capture").agg(F.count(F.lit(1)).alias("windows"), F.sum("n_flows").alias("flows"))


@query("timeline_json", with_parts(f"select capture, {big('count(*)', 'rows')}, {r6('sum(t) / 1e6', 't_sum')} from win group by capture"))
def timeline_json(spark, sf_dir):
    path = scratch_path(spark, "timeline")
    st.write_timeline(stored_split(spark, sf_dir).select("capture", "window", "t", "stage_now"), path)
    back = spark.read.schema("capture string, window bigint, t double, stage_now int").json(path)
    return back.groupBy("capture").agg(F.count(F.lit(1)).alias("rows"), (F.sum("t") / 1e6).alias("t_sum"))


@query("scores_registry", with_parts(f"""
select capture, {WIN}, {r6("case when split = 'test' then score else -1 end", 's_a')}, {r6("case when split = 'test' then score_b else -1 end", 's_b')} from scored"""))
def scores_registry(spark, sf_dir):
    """Scores of two models appended, then joined back by model and seed."""
    df = scored(spark, sf_dir)
    path = scratch_path(spark, "scores")
    test = df.filter("split = 'test'")
    st.append_scores(test, "a", 17, path)
    st.append_scores(test, "b", 17, path, "score_b")
    out = st.join_scores(st.join_scores(df, path, "a", 17, "s_a"), path, "b", 17, "s_b")
    return out.select(*KEYS, F.coalesce("s_a", F.lit(-1.0)).alias("s_a"), F.coalesce("s_b", F.lit(-1.0)).alias("s_b"))


@query("results_registry", with_parts(f"""
select 'p1' as protocol, 'score' as model, {big('17', 'seed')}, 'mean_score' as metric, {r6('avg(score)', 'value')} from test
union all select 'p1', 'score', 17, 'rows', {r6('count(*)', 'value')} from test"""))
def results_registry(spark, sf_dir):
    path = scratch_path(spark, "results")
    test = scored(spark, sf_dir).filter("split = 'test' and valid")
    st.append_results(test.agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("rows")), "p1", "score", 17, path)
    return spark.read.parquet(path)


@query("packet_block_merge", with_parts(f"""
select s.capture, {big('s.win', '"window"')}, {r6("case when s.win % 3 = 0 then s.n_flows * 2.0 else coalesce(a.ttl_mean_mean, 0) end", 'ttl_mean_mean')},
  {r6("case when s.win % 3 = 0 then 1.0 else coalesce(a.m_packet, 0) end", 'm_packet')}
from split s left join agg a on a.capture = s.capture and a.win = s.win"""))
def packet_block(spark, sf_dir):
    """A cached block on a shifted grid replaces measurements where it has valid rows."""
    state = build_windows(flows(spark, sf_dir), CFG)
    cached = stored_split(spark, sf_dir).select(
        "capture", (F.col("window") - 10).alias("window"), (F.col("n_flows") * 2.0).alias("ttl_mean_mean"),
        F.when(F.col("window") % 3 == 0, 1).otherwise(0).alias("packet_level_valid"))
    block = st.packet_block(cached, 10 * CFG.window_seconds, CFG.window_seconds)
    return merge_packet_block(state, block).select(*KEYS, "ttl_mean_mean", "m_packet")


@query("build_manifest", with_parts(f"""
select capture, {big('count(*)', 'windows')}, {big('count(*) filter (is_onset)', 'onsets')}, {big('1', 'raw_files')}, true as has_size from split group by capture"""))
def manifest(spark, sf_dir):
    from netloom.operators.reports import build_manifest
    path = scratch_path(spark, "flows")
    st.write_partitioned(flows(spark, sf_dir).select("capture", "dataset", "ts").repartition("capture"), path)
    raw = st.raw_files(spark.read.parquet(path))
    out = build_manifest(stored_split(spark, sf_dir), raw)
    return out.select("capture", "windows", "onsets", "raw_files", (F.col("raw_bytes") > 0).alias("has_size"))


@query("parameter_store", with_parts(f"select capture, {r6('avg(n_flows)', 'center')} from win group by capture"))
def parameters(spark, sf_dir):
    path = scratch_path(spark, "params")
    st.save_parameters(stored_split(spark, sf_dir).groupBy("capture").agg(F.avg("n_flows").alias("center")), path)
    return st.load_parameters(spark, path)


@query("stix_bundle", f"select type, {big('count(*)', 'objects')} from (select 'attack-pattern' as type from part union all "
       "select 'course-of-action' from supplier union all select 'x-mitre-tactic' from nation) group by type")
def stix_bundle(spark, sf_dir):
    """Objects written as bundle documents of at most a thousand, read back through the bundle reader."""
    from checks.q_explain import stix_objects
    path = scratch_path(spark, "stix")
    objs = stix_objects(spark, sf_dir).filter("type <> 'relationship'")
    chunk = F.floor(F.substring("id", 2, 20).cast("bigint") / 1000)
    (objs.groupBy(F.col("type").alias("kind"), chunk.alias("chunk"))
     .agg(F.collect_list(F.struct(*objs.columns)).alias("objects")).write.partitionBy("kind", "chunk").json(path))
    return st.read_stix(spark, path).groupBy("type").agg(F.count(F.lit(1)).alias("objects"))


@query("load_campaigns", with_parts(f"select {WIN}, capture from split where split = 'train' and capture < 'c3'"))
def load_campaigns(spark, sf_dir):
    path = scratch_path(spark, "campaigns")
    df = stored_split(spark, sf_dir).filter("split is not null").select("capture", "window", F.col("split").alias("campaign_split"))
    st.write_partitioned(df.withColumn("dataset", F.when(F.col("capture") < "c3", "d0").otherwise("d1")), path,
                         ("dataset", "campaign_split"))
    return st.load_campaigns(spark, path, ["d0"], "train").select("window", "capture")


@query("add_campaigns", with_parts(f"""
select synthetic, split, {big('count(*)', 'rows')} from (
  select false as synthetic, split from split where capture < 'c3'
  union all select true, case when pos >= 12 and capture = 'c3' then 'train' when pos >= 12 then 'p4' end from split where capture >= 'c3')
group by synthetic, split"""))
def add_campaigns(spark, sf_dir):
    from netloom.operators.splits import add_campaigns as add
    df = stored_split(spark, sf_dir)
    camp = df.filter("capture >= 'c3'").drop("split", "fit_row").withColumn(
        "campaign_split", F.when(F.col("capture") == "c3", "train").otherwise("test"))
    return add(df.filter("capture < 'c3'"), camp, CFG).groupBy("synthetic", "split").agg(F.count(F.lit(1)).alias("rows"))



