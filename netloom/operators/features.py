"""The 92 network-state features of every occupied window.

Flows are read once per grouping level, never once per feature:

* ``window_aggregates``  plain aggregates, combined map-side before a tiny shuffle;
* ``cell_features``      one shuffle on (window, source, destination, port); hosts, pairs, ports,
                         entropies and exfiltration all roll up from these cells;
* ``source_ports``       source-port counts;
* ``pair_novelty``, ``port_novelty``   history over distinct (key, window) rows, at most one per window;
* ``sequential_ports``, ``beacons``    ordered history over flows, in blocks (see blocked.py).

All results are keyed and partitioned by (series, window), so the closing joins add no shuffle.
``series`` names the columns of one time line: the capture, or (target, host) in host removal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom import vocab
from netloom.config import EngineConfig
from netloom.functions.scalars import in_networks, share, window_index
from netloom.operators.blocked import look_back

EPS = 1e-9
SERIES = ("capture",)


def assign_windows(flows: DataFrame, cfg: EngineConfig) -> DataFrame:
    return flows.withColumn("window", window_index(F.col("ts"), cfg.window_seconds))


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def window_aggregates(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    c = F.col
    port, proto = c("dst_port"), c("protocol")
    size = c("fwd_bytes") + c("bwd_bytes")
    packets = c("fwd_packets") + c("bwd_packets")
    ttl_known = c("ttl_mean").isNotNull() & ~F.isnan("ttl_mean")
    auth = port.isin(*vocab.AUTH_PORTS)
    spread = [("bytes_per_flow", size), ("packets_per_flow", packets), ("duration", c("duration"))]
    agg = flows.groupBy(*series, "window").agg(
        F.count(F.lit(1)).cast("double").alias("flow_count"),
        *[_total(x).alias(f"{x}_total") for x in ("fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets")],
        *[fn(x).alias(f"{name}_{suffix}") for name, x in spread
          for suffix, fn in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))],
        *[_total(f"{flag}_count").alias(f"_{flag}") for flag in vocab.FLAGS],
        share((c("syn_count") > 0) & (c("ack_count") <= 0)).alias("unanswered_syn_frac"),
        share(c("rst_count") > 0).alias("rst_frac"),
        share(proto == 6).alias("tcp_frac"),
        share(proto == 17).alias("udp_frac"),
        share(proto == 1).alias("icmp_frac"),
        share(~proto.isin(1, 6, 17)).alias("other_proto_frac"),
        F.avg("iat_mean").alias("iat_mean_mean"),
        F.stddev_samp("iat_mean").alias("iat_mean_std"),
        F.min("iat_mean").alias("iat_mean_min"),
        F.max("iat_max").alias("iat_max_max"),
        F.avg("iat_std").alias("iat_std_mean"),
        share((port >= 0) & (port < 1024)).alias("low_port_frac"),
        share(port >= 49152).alias("ephemeral_port_frac"),
        share(port.isin(*vocab.WELL_KNOWN_PORTS)).alias("well_known_service_frac"),
        share(port.isin(*vocab.MAIL_PORTS)).alias("smtp_frac"),
        share(F.when(auth, c("duration") < 3.0)).alias("auth_short_frac"),
        F.avg(c("fwd_bytes") / (size + EPS)).alias("bidirectional_ratio_mean"),
        share(F.coalesce(c("bwd_bytes"), F.lit(0.0)) <= 0).alias("unidirectional_flow_frac"),
        share(F.coalesce(c("bwd_packets"), F.lit(0.0)) <= 0).alias("empty_response_frac"),
        *[F.avg(x).alias(f"{x}_mean") for x in
          ("ttl_mean", "ttl_var", "ttl_unique", "win_mean", "win_std", "frag_rate", *vocab.PAYLOAD_COLUMNS)],
        (F.max("ttl_mean") - F.min("ttl_mean")).alias("ttl_spread"),
        _total("win_zero_count").alias("_win_zero"),
        _total("retrans_count").alias("_retrans"),
        F.max(ttl_known.cast("double")).alias("m_packet"),
    )
    w = F.lit(float(cfg.window_seconds))
    all_packets = c("fwd_packets_total") + c("bwd_packets_total")
    flag_total = reduce(Column.__add__, [c(f"_{f}") for f in vocab.FLAGS]) + EPS
    shares = [c(f"_{f}") / flag_total for f in vocab.FLAGS]
    entropy = reduce(Column.__add__, [s * F.log2(s + EPS) for s in shares])
    return agg.select(
        *series, "window",
        *[x for x in agg.columns if x not in (*series, "window") and not x.startswith("_")],
        (c("flow_count") / w).alias("flow_rate"),
        ((c("fwd_bytes_total") + c("bwd_bytes_total")) / w).alias("bytes_rate"),
        (all_packets / w).alias("packets_rate"),
        *[(c(f"_{f}") / (c("flow_count") + EPS)).alias(f"{f}_rate") for f in vocab.FLAGS],
        (c("_syn") / (c("_ack") + 1.0)).alias("syn_ack_ratio"),
        (-entropy / math.log2(len(vocab.FLAGS))).alias("flag_entropy"),
        (c("_win_zero") / (all_packets + EPS)).alias("win_zero_rate"),
        (c("_retrans") / (all_packets + EPS)).alias("retrans_rate"),
        (1.0 / (1.0 + c("iat_mean_std") / (c("iat_mean_mean") + EPS))).alias("iat_regularity"),
    )


def _entropy(n: Column, n_log_n: Column, kinds: Column) -> Column:
    """Shannon entropy over log2(distinct values), from sums over the value counts."""
    return F.when(kinds <= 1, F.lit(0.0)).otherwise((F.log2(n) - n_log_n / n) / F.log2(kinds.cast("double")))


def cell_counts(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """One row per (window, source, destination, destination port)."""
    c = F.col
    return (
        flows.groupBy(*series, "window", "src_ip", "dst_ip", "dst_port")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if((c("syn_count") > 0) & (c("ack_count") <= 0)).alias("half_open"),
            F.count_if(c("protocol") == 1).alias("icmp"),
            _total("fwd_bytes").alias("fwd"),
            _total("bwd_bytes").alias("bwd"),
            _total(F.when(c("duration") >= 60.0, c("fwd_bytes"))).alias("long_fwd"),
        )
        .withColumn("src_int", in_networks(c("src_ip"), cfg.internal_cidrs))
        .withColumn("dst_int", in_networks(c("dst_ip"), cfg.internal_cidrs))
    )


def cell_features(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Host, pair, port and exfiltration features, by three roll-ups of the cells.

    Each cell contributes one small record to every grouping it belongs to (``kind``), so all
    groupings share the shuffles instead of each re-reading the flows.
    """
    c = F.col
    port = c("dst_port")
    both = c("src_int") & c("dst_int")
    upload = c("src_int") & ~c("dst_int")
    download = ~c("src_int") & c("dst_int")
    zero = F.lit(0).cast("bigint")
    none = F.lit(0.0)

    def record(kind: str, k1: Column, k2: Column | None = None, **values: Column) -> Column:
        fields = {"n": zero, "half_open": zero, "icmp": zero, "auth": zero, "web": zero, "dns": zero,
                  "internal": zero, "sent": none, "got": none, "long_sent": none, **values}
        return F.struct(F.lit(kind).alias("kind"), k1.cast("string").alias("k1"),
                        (F.lit(None) if k2 is None else k2).cast("string").alias("k2"),
                        *[v.alias(k) for k, v in fields.items()])

    def only(condition: Column) -> Column:
        return F.when(condition, c("n")).otherwise(zero)

    records = F.array(
        record("pair", c("src_ip"), c("dst_ip"), n=c("n"), half_open=c("half_open"), icmp=c("icmp"),
               auth=only(port.isin(*vocab.AUTH_PORTS)), web=only(port.isin(*vocab.WEB_PORTS)),
               dns=only(port == 53), internal=both.cast("bigint")),
        record("scan", c("src_ip"), port, internal=both.cast("bigint")),
        record("dst", c("dst_ip"), n=c("n")),
        record("port", port, n=c("n")),
        F.when(upload, record("host", c("src_ip"), sent=c("fwd"), got=c("bwd"), long_sent=c("long_fwd")))
        .when(download, record("host", c("dst_ip"), sent=c("bwd"), got=c("fwd"))),
    )
    keys = [*series, "window"]
    # Cells without a host record leave a row of NULLs; dropping it afterwards keeps all of this generated code.
    parts = cell_counts(flows, cfg, series).select(*keys, F.inline(records)).filter(c("kind").isNotNull())
    totals = ("n", "half_open", "icmp", "auth", "web", "dns", "internal", "sent", "got", "long_sent")
    level = parts.groupBy(*keys, "kind", "k1", "k2").agg(*[F.sum(x).alias(x) for x in totals])

    pair, scan = c("kind") == "pair", c("kind") == "scan"
    entity = F.when(pair | scan, F.lit("src")).otherwise(c("kind"))
    per_entity = level.groupBy(*keys, entity.alias("entity"), "k1").agg(
        F.sum("n").alias("n"),
        F.count_if(pair).alias("fanout"),
        F.count_if(scan).alias("ports"),
        F.max("auth").alias("auth"),
        F.max("web").alias("web"),
        F.sum("half_open").alias("half_open"),
        F.sum("dns").alias("dns"),
        F.count_if(pair & (c("icmp") > 0)).alias("sweep"),
        F.count_if(pair & (c("internal") > 0)).alias("int_fanout"),
        F.sum(F.when(pair & (c("internal") > 0), c("n"))).alias("int_flows"),
        F.max(F.when(scan, c("internal"))).alias("int_scan"),
        F.sum("sent").alias("sent"), F.sum("got").alias("got"), F.sum("long_sent").alias("long_sent"),
    )

    def of(name: str, x: Column) -> Column:
        return F.when(c("entity") == name, x)

    def top(x: str, entity_name: str = "src") -> Column:
        return F.max(of(entity_name, c(x))).cast("double")

    def entropy(name: str) -> Column:
        n = c("n").cast("double")
        return _entropy(F.sum(of(name, n)), F.sum(of(name, n * F.log2(n))), F.count_if(c("entity") == name))

    volume = c("sent") + c("got")
    flows_seen = F.sum(of("src", c("n"))).cast("double")
    return per_entity.groupBy(*keys).agg(
        F.count_if(c("entity") == "src").cast("double").alias("unique_src_hosts"),
        F.count_if(c("entity") == "dst").cast("double").alias("unique_dst_hosts"),
        F.count_if(c("entity") == "port").cast("double").alias("unique_dst_ports"),
        entropy("src").alias("src_ip_entropy"),
        entropy("dst").alias("dst_ip_entropy"),
        entropy("port").alias("dst_port_entropy"),
        top("fanout").alias("fanout_max"), F.avg(of("src", c("fanout"))).alias("fanout_mean"),
        top("ports").alias("ports_per_src_max"), F.avg(of("src", c("ports"))).alias("ports_per_src_mean"),
        top("n").alias("flows_per_host_max"),
        top("auth").alias("auth_conn_max"), top("web").alias("web_conn_max"),
        top("half_open").alias("half_open_max"), top("sweep").alias("icmp_sweep_max"),
        (F.coalesce(F.sum(of("src", c("int_flows"))).cast("double"), none) / flows_seen).alias("int_int_frac"),
        top("int_fanout").alias("int_fanout_max"), top("int_scan").alias("int_scan_max"),
        top("dns").alias("dns_max"),
        top("sent", "host").alias("out_bytes_max"),
        F.max(F.when((c("entity") == "host") & (volume >= 10_000), (c("sent") - c("got")) / (volume + 1.0)))
        .alias("out_asym_max"),
        F.sum(of("host", c("long_sent"))).alias("long_out_bytes"),
    )


def source_ports(flows: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    n = F.col("n").cast("double")
    return (
        flows.groupBy(*series, "window", "src_port").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*series, "window")
        .agg(F.count(F.lit(1)).cast("double").alias("unique_src_ports"),
             _entropy(F.sum(n), F.sum(n * F.log2(n)), F.count(F.lit(1))).alias("src_port_entropy"))
    )


def sequential_ports(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Share of one source's consecutive destination ports that differ by exactly one."""
    ordered = look_back(
        flows.filter(F.col("dst_port") >= 0).select(*series, "window", "src_ip", "ts", "flow_id", "dst_port"),
        keys=[*series, "window", "src_ip"], order=["ts", "flow_id"],
        depth=1, values=lambda w: {"prev_port": F.lag("dst_port").over(w)}, rows=cfg.block_rows,
    )
    unit = F.abs(F.col("dst_port") - F.col("prev_port")) == 1
    return (
        ordered.groupBy(*series, "window", "src_ip").agg(F.count(F.lit(1)).alias("n"), share(unit).alias("score"))
        .filter(F.col("n") >= cfg.seq_min_flows)
        .groupBy(*series, "window").agg(F.max("score").alias("seq_port_score"))
    )


def pair_novelty(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Host pairs not seen in the look-back; one row per pair and window enters the history."""
    by_pair = W.partitionBy(*series, "src_ip", "dst_ip").orderBy("window")
    c = F.col
    pairs = (
        flows.select(*series, "src_ip", "dst_ip", "window").distinct()
        .withColumn("last_window", F.lag("window").over(by_pair))
        .withColumn("is_new", c("last_window").isNull() | (c("window") - c("last_window") > cfg.new_pair_lookback))
    )
    internal = in_networks(c("src_ip"), cfg.internal_cidrs) & in_networks(c("dst_ip"), cfg.internal_cidrs)
    return pairs.groupBy(*series, "window").agg(
        share(c("is_new")).alias("new_pair_frac"),
        F.count_if(c("is_new") & internal).cast("double").alias("new_int_pairs"),
    )


def port_novelty(flows: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Share of a window's ports that the previous occupied window did not have."""
    keys = [*series, "window"]
    occupied = flows.select(*keys).distinct().withColumn(
        "prev_window", F.lag("window").over(W.partitionBy(*series).orderBy("window")))
    by_port = W.partitionBy(*series, "dst_port").orderBy("window")
    ports = flows.select(*keys, "dst_port").distinct().withColumn("port_window", F.lag("window").over(by_port))
    known = F.col("port_window").eqNullSafe(F.col("prev_window")) & F.col("prev_window").isNotNull()
    return ports.join(occupied, keys).groupBy(*keys).agg(share(~known).alias("new_dst_port_frac"))


def beacon_scores(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Periodicity score of every flow on its (source, destination, port) channel."""
    n = cfg.beacon_window
    c = F.col
    ordered = look_back(
        flows.select(*series, "window", "src_ip", "dst_ip", "dst_port", "ts", "te", "flow_id"),
        keys=[*series, "src_ip", "dst_ip", "dst_port"], order=["ts", "flow_id"],
        depth=n, rows=cfg.block_rows,
        values=lambda w: {f"ts_{i}": F.lag("ts", i).over(w) for i in range(1, n + 1)}
        | {f"te_{i}": F.lag("te", i).over(w) for i in range(1, n + 1)},
    )
    starts = [c("ts"), *[c(f"ts_{i}") for i in range(1, n + 1)]]
    gaps = [starts[i] - starts[i + 1] for i in range(n)]
    idles = [starts[i] - c(f"te_{i + 1}") for i in range(n)]

    def add(xs: list[Column]) -> Column:
        return reduce(Column.__add__, [F.coalesce(x, F.lit(0.0)) for x in xs])

    scored = (
        ordered.withColumn("_n", reduce(Column.__add__, [g.isNotNull().cast("int") for g in gaps]))
        .filter(c("_n") >= cfg.beacon_min_gaps)
        .withColumn("_mean", add(gaps) / c("_n"))
        .withColumn("_idle", add(idles) / c("_n"))
        .withColumn("_std", F.sqrt(add([(g - c("_mean")) * (g - c("_mean")) for g in gaps]) / (c("_n") - 1)))
    )
    low, high = cfg.beacon_gap_seconds
    periodic = c("_mean").between(low, high) & (c("_idle") >= cfg.beacon_min_idle)
    return scored.select(*series, "window", "src_ip", "dst_ip", "dst_port", "flow_id",
                         F.when(periodic, 1.0 / (1.0 + c("_std") / c("_mean"))).otherwise(0.0).alias("score"))


def beacons(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """Best score and number of beacon-like channels; windows without scored flows are absent (0)."""
    return (
        beacon_scores(flows, cfg, series)
        .groupBy(*series, "window", "src_ip", "dst_ip", "dst_port").agg(F.max("score").alias("score"))
        .groupBy(*series, "window")
        .agg(F.max("score").alias("beacon_max"),
             F.count_if(F.col("score") >= 0.8).cast("double").alias("beacon_pairs"))
    )


def window_features(flows: DataFrame, cfg: EngineConfig, series: Sequence[str] = SERIES) -> DataFrame:
    """All 92 features and the packet mask, for windows that hold at least one flow."""
    keys = [*series, "window"]
    parts = [
        cell_features(flows, cfg, series), source_ports(flows, series), sequential_ports(flows, cfg, series),
        pair_novelty(flows, cfg, series), port_novelty(flows, series), beacons(flows, cfg, series),
    ]
    joined = reduce(lambda a, b: a.join(b, keys, "left"), parts, window_aggregates(flows, cfg, series))
    return clean_features(joined, keys)


def clean_features(df: DataFrame, keep: Sequence[str], names: Sequence[str] = vocab.FEATURE_NAMES) -> DataFrame:
    """Missing values become 0, and packet features are 0 wherever the packet mask is 0."""
    mask = F.coalesce(F.col("m_packet"), F.lit(0.0))

    def value(name: str) -> Column:
        x = F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
        return F.when(mask > 0, x).otherwise(0.0) if name in vocab.PACKET_FEATURES else x

    return df.select(*keep, *[value(n).alias(n) for n in names], mask.alias("m_packet"))
