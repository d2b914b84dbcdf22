"""Rows that several test modules build their tables from."""


def flow(i, ts, src, dst, dport=443, dur=0.2, fwd=500.0, bwd=800.0, syn=1.0, ack=1.0, proto=6, sport=40000):
    return {"flow_id": i, "ts": float(ts), "te": float(ts) + dur, "src_ip": src, "dst_ip": dst, "src_port": sport,
            "dst_port": dport, "protocol": proto, "duration": dur, "fwd_bytes": fwd, "bwd_bytes": bwd,
            "fwd_packets": 3.0, "bwd_packets": 2.0, "syn_count": syn, "ack_count": ack, "capture": "cap"}
