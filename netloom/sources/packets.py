"""Packet tables to flow-level packet statistics, and flow-exporter tables to canonical flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom import vocab
from netloom.sources.csv_flows import conform


def _byte(buf: Column, at: Column | int) -> Column:
    """Unsigned byte at a zero-based offset."""
    position = at + 1 if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.hex(F.substring(buf, position, 1)), 16, 10).cast("int")


def _number(buf: Column, at: Column | int, length: int) -> Column:
    position = at + 1 if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.hex(F.substring(buf, position, length)), 16, 10).cast("bigint")


def decode_ip(packets: DataFrame, buf: str = "ip_packet") -> DataFrame:
    """Add ttl, fragmented, tcp_window and tcp_seq from raw IPv4/IPv6 bytes.

    NULL marks a field the packet does not carry; frames under 20 bytes carry none.
    """
    b = F.col(buf)
    size = F.coalesce(F.octet_length(b), F.lit(0))
    version = F.when(size >= 20, F.shiftright(_byte(b, 0), 4))
    v4, v6 = version == 4, version == 6
    header = F.when(v4, _byte(b, 0).bitwiseAND(15) * 4).when(v6, F.lit(40))
    proto = F.when(v4, _byte(b, 9)).when(v6, _byte(b, 6))
    offset = _number(b, 6, 2)
    broken = (F.shiftright(offset, 13).bitwiseAND(F.lit(1).cast("bigint")) > 0) | (
        offset.bitwiseAND(F.lit(0x1FFF).cast("bigint")) > 0)
    out = packets.withColumns({
        "ttl": F.when(v4, _byte(b, 8)).when(v6, _byte(b, 7)),
        "fragmented": F.when(v4, broken.cast("int")).otherwise(F.lit(0)),
        "_header": F.when((proto == 6) & (size >= header + 20), header),
    })
    at = F.col("_header")
    return out.withColumns({
        "tcp_seq": F.when(at.isNotNull(), _number(b, at + 4, 4)),
        "tcp_window": F.when(at.isNotNull(), _number(b, at + 14, 2)),
    }).drop("_header")


def packet_statistics(decoded: DataFrame, keys: Sequence[str] = ("flow_key",)) -> DataFrame:
    """Per-flow packet features from decoded packets.

    Different TTLs are counted exactly: a TTL is one byte, so four longs have a bit for each.

    Repeated payload-carrying sequence numbers are counted against the different ones, which alone go
    through a (flow, sequence) grouping: a flow with a third of all packets is spread over its sequence
    numbers, and such a group is two numbers wide. All else is summed by flow before the shuffle.
    """
    payload = F.coalesce("payload_size", F.lit(0))
    carried = F.when(payload > 0, F.col("tcp_seq"))
    edges = vocab.PAYLOAD_EDGES
    window, ttl = F.col("tcp_window"), F.col("ttl")
    sums = {
        "packets": F.lit(1), "frag": F.coalesce("fragmented", F.lit(0)), "win_zero_count": (window == 0).cast("int"),
        **{f"payload_hist_{i}": ((payload >= edges[i]) & (payload < edges[i + 1])).cast("int") for i in range(8)},
    }
    masks = [F.when(F.shiftright("ttl", 6) == i, F.expr("shiftleft(1L, ttl & 63)")) for i in range(4)]
    flows = decoded.groupBy(*keys).agg(
        *[F.coalesce(F.bit_or(m), F.lit(0)).alias(f"_ttls{i}") for i, m in enumerate(masks)],
        F.count("ttl").alias("_tn"), F.sum("ttl").alias("_t"), F.sum(ttl.cast("double") * ttl).alias("_t2"),
        F.count("tcp_window").alias("_wn"), F.sum("tcp_window").alias("_w"), F.sum(F.pow(window.cast("double"), F.lit(2.0))).alias("_w2"),
        F.count(carried).alias("_carried"), F.lit(0).cast("bigint").alias("_seqs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    # Packets without a number stay in: a filter on decoded fields would run the decoding in itself again.
    different = decoded.select(*keys, carried.alias("_seq")).distinct().groupBy(*keys).agg(F.count("_seq").alias("_seqs"))
    # A union instead of a join: keys may be null.
    total = flows.unionByName(different, allowMissingColumns=True).groupBy(*keys).agg(
        sum((F.bit_count(F.max(f"_ttls{i}")) for i in range(1, 4)), F.bit_count(F.max("_ttls0"))).alias("_kinds"),
        (F.max("_carried") - F.sum("_seqs")).alias("retrans_count"),
        *[F.max(n).alias(n) for n in ("_tn", "_t", "_t2", "_wn", "_w", "_w2", *sums)])

    def variance(n: str, s: str, s2: str) -> Column:
        mean = F.col(s) / F.col(n)
        return F.when(F.col(n) > 1, F.greatest(F.col(s2) / F.col(n) - mean * mean, F.lit(0.0))).otherwise(0.0)

    return total.select(
        *keys, F.coalesce(F.col("_t") / F.col("_tn"), F.lit(0.0)).alias("ttl_mean"),
        variance("_tn", "_t", "_t2").alias("ttl_var"),
        F.col("_kinds").cast("double").alias("ttl_unique"),
        F.coalesce(F.col("_w") / F.col("_wn"), F.lit(0.0)).alias("win_mean"),
        F.sqrt(variance("_wn", "_w", "_w2")).alias("win_std"),
        F.col("win_zero_count").cast("double").alias("win_zero_count"),
        (F.col("frag") / F.col("packets")).alias("frag_rate"),
        F.col("retrans_count").cast("double").alias("retrans_count"),
        *[F.col(c).cast("double").alias(c) for c in vocab.PAYLOAD_COLUMNS])


# Exporter column -> canonical column (times in milliseconds are divided by 1000).
EXPORT_SECONDS = {
    "ts": "bidirectional_first_seen_ms", "te": "bidirectional_last_seen_ms", "duration": "bidirectional_duration_ms",
    "iat_mean": "bidirectional_mean_piat_ms", "iat_std": "bidirectional_stddev_piat_ms",
    "iat_max": "bidirectional_max_piat_ms", "iat_min": "bidirectional_min_piat_ms",
}
EXPORT_PLAIN = {
    "src_port": "src_port", "dst_port": "dst_port", "protocol": "protocol",
    "fwd_bytes": "src2dst_bytes", "bwd_bytes": "dst2src_bytes",
    "fwd_packets": "src2dst_packets", "bwd_packets": "dst2src_packets",
    **{f"{f}_count": f"bidirectional_{f}_packets" for f in vocab.FLAGS},
    "pkt_len_mean": "bidirectional_mean_ps", "pkt_len_std": "bidirectional_stddev_ps",
    "pkt_len_max": "bidirectional_max_ps", "pkt_len_min": "bidirectional_min_ps",
    **{c: f"udps.{c}" for c in vocab.PACKET_COLUMNS if not c.startswith("payload")},
}


def export_to_flows(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Flow-exporter table to canonical flows; absent columns take their defaults."""
    def column(name: str, default: object = 0.0) -> Column:
        return F.col(f"`{name}`") if name in df.columns else F.lit(default)

    counts = [column(f"udps.payload_hist_{i}") for i in range(8)]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    chosen = {n: column(src) / 1000.0 for n, src in EXPORT_SECONDS.items()}
    chosen |= {"src_ip": column("src_ip", "0.0.0.0"), "dst_ip": column("dst_ip", "0.0.0.0")}
    chosen |= {n: column(src, 0 if n in ("src_port", "dst_port", "protocol") else 0.0)
               for n, src in EXPORT_PLAIN.items()}
    chosen |= {f"payload_hist_{i}": counts[i] / (total + 1e-9) for i in range(8)}
    return conform(df.select(*[c.alias(n) for n, c in chosen.items()], *extra), extra)
