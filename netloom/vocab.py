"""Fixed vocabularies. The values below are contracts shared with existing data and models."""

from __future__ import annotations

from typing import NamedTuple

# --- Fixed values: kill-chain stages, in kill-chain order -------------------------------
STAGES = (
    "Benign",
    "Reconnaissance",
    "InitialAccess",
    "LateralMovement",
    "CommandAndControl",
    "Exfiltration",
    "Impact",
)
STAGE_ATTACK_ID = (None, "TA0043", "TA0001", "TA0008", "TA0011", "TA0010", "TA0040")
FIRST_COMPROMISE_STAGE = 2
N_STAGES = len(STAGES)

# --- Fixed values: canonical flow columns ------------------------------------------------
KEY_COLUMNS = ("ts", "te", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
FLOW_COLUMNS = (
    "duration", "fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets",
    "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count",
    "iat_mean", "iat_std", "iat_max", "iat_min",
    "pkt_len_mean", "pkt_len_std", "pkt_len_max", "pkt_len_min",
)
PAYLOAD_COLUMNS = tuple(f"payload_hist_{i}" for i in range(8))
PACKET_COLUMNS = (
    "ttl_mean", "ttl_var", "ttl_unique", "win_mean", "win_std", "win_zero_count",
    "frag_rate", "retrans_count", *PAYLOAD_COLUMNS,
)
LABEL_COLUMNS = ("label", "family", "stage", "technique", "is_attack", "attempted")

# --- Fixed values: port groups and protocol numbers --------------------------------------
WELL_KNOWN_PORTS = (80, 443, 22, 21, 25, 53, 445, 3389)
AUTH_PORTS = (21, 22, 23, 445, 3306, 3389, 5900)
WEB_PORTS = (80, 443, 8080, 8443)
MAIL_PORTS = (25, 465, 587)
PROTOCOLS = {
    "tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "ipv6icmp": 58, "rtp": 17,
    "arp": 0, "ipv6": 41, "gre": 47, "esp": 50,
}
FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")
PAYLOAD_EDGES = (0, 1, 64, 128, 256, 512, 1024, 1400, 65536)
NULL_TOKENS = ("", "NaN", "nan", "Infinity", "-Infinity", "inf", "-")

# --- Fixed values: timestamp layouts, tried in this order: (shape of the text, Spark pattern)
TIME_LAYOUTS = (
    (r"^\d{4}-", "yyyy-M-d H:m:s[.SSSSSSSSS]"),
    (r"^\d{4}/", "yyyy/M/d H:m:s[.SSSSSSSSS]"),
    (r"^\d{1,2}/\d{1,2}/\d{4} +\d+:\d+:\d+$", "d/M/yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} +\d+:\d+:\d+ [AaPp][Mm]$", "d/M/yyyy h:m:s a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} +\d+:\d+$", "d/M/yyyy H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{2} +\d+:\d+$", "d/M/yy H:m"),
    (r"^\d{1,2}-\d{1,2}-\d{4} ", "d-M-yyyy H:m:s"),
)

# --- Fixed values: folded CSV headers -> canonical names ---------------------------------
FLOWMETER_HEADERS = {
    "srcip": "src_ip", "sourceip": "src_ip", "flowid": "flow_key",
    "dstip": "dst_ip", "destinationip": "dst_ip",
    "srcport": "src_port", "sourceport": "src_port",
    "dstport": "dst_port", "destinationport": "dst_port",
    "protocol": "protocol", "timestamp": "time_text", "flowduration": "duration",
    "totalfwdpackets": "fwd_packets", "totalfwdpacket": "fwd_packets", "totfwdpkts": "fwd_packets",
    "totalbackwardpackets": "bwd_packets", "totalbwdpackets": "bwd_packets", "totbwdpkts": "bwd_packets",
    "totallengthoffwdpackets": "fwd_bytes", "totallengthoffwdpacket": "fwd_bytes", "totlenfwdpkts": "fwd_bytes",
    "totallengthofbwdpackets": "bwd_bytes", "totallengthofbwdpacket": "bwd_bytes", "totlenbwdpkts": "bwd_bytes",
    "synflagcount": "syn_count", "synflagcnt": "syn_count",
    "ackflagcount": "ack_count", "ackflagcnt": "ack_count",
    "finflagcount": "fin_count", "finflagcnt": "fin_count",
    "rstflagcount": "rst_count", "rstflagcnt": "rst_count",
    "pshflagcount": "psh_count", "pshflagcnt": "psh_count",
    "urgflagcount": "urg_count", "urgflagcnt": "urg_count",
    "flowiatmean": "iat_mean", "flowiatstd": "iat_std", "flowiatmax": "iat_max", "flowiatmin": "iat_min",
    "packetlengthmean": "pkt_len_mean", "pktlenmean": "pkt_len_mean",
    "packetlengthstd": "pkt_len_std", "pktlenstd": "pkt_len_std",
    "maxpacketlength": "pkt_len_max", "pktlenmax": "pkt_len_max", "packetlengthmax": "pkt_len_max",
    "minpacketlength": "pkt_len_min", "pktlenmin": "pkt_len_min", "packetlengthmin": "pkt_len_min",
    "fwdinitwinbytes": "win_mean", "initwinbytesforward": "win_mean", "initfwdwinbyts": "win_mean",
    "label": "label", "stage": "stage_label", "activity": "activity",
}
ARGUS_HEADERS = {
    "starttime": "time_text", "dur": "duration", "proto": "protocol",
    "srcaddr": "src_ip", "sport": "src_port", "dstaddr": "dst_ip", "dport": "dst_port",
    "state": "state_text", "totpkts": "tot_packets", "totbytes": "tot_bytes",
    "srcbytes": "fwd_bytes", "label": "label",
}
MICROSECOND_COLUMNS = ("duration", "iat_mean", "iat_std", "iat_max", "iat_min")


class LabelRule(NamedTuple):
    label: str
    family: str
    stage: str
    technique: str | None = None
    aliases: tuple[str, ...] = ()


# --- Fixed values: raw label -> family, stage, technique ---------------------------------
LABEL_MAP: dict[str, tuple[LabelRule, ...]] = {
    "cicids": (
        LabelRule("BENIGN", "Benign", "Benign", None, ("Benign", "normal")),
        LabelRule("Portscan", "PortScan", "Reconnaissance", "T1046", ("PortScan", "Port Scan")),
        LabelRule("FTP-Patator", "BruteForce", "InitialAccess", "T1110", ("FTP-BruteForce", "FTP Patator")),
        LabelRule("SSH-Patator", "BruteForce", "InitialAccess", "T1110",
                  ("SSH-BruteForce", "SSH-Bruteforce", "SSH Patator")),
        LabelRule("Web Attack - Brute Force", "WebAttack", "InitialAccess", "T1110", ("Brute Force -Web",)),
        LabelRule("Web Attack - XSS", "WebAttack", "InitialAccess", "T1190", ("Brute Force -XSS",)),
        LabelRule("Web Attack - SQL Injection", "WebAttack", "InitialAccess", "T1190",
                  ("Web Attack - SQL", "SQL Injection")),
        LabelRule("Heartbleed", "Heartbleed", "InitialAccess", "T1190"),
        LabelRule("Infiltration - Portscan", "Infiltration", "LateralMovement", "T1046"),
        LabelRule("Infiltration", "Infiltration", "CommandAndControl", "T1071", ("Infilteration",)),
        LabelRule("Infiltration - Attempted", "Infiltration", "InitialAccess", "T1204"),
        LabelRule("Infiltration - Dropbox download", "Infiltration", "InitialAccess", "T1204"),
        LabelRule("Infiltration - Cool disk - MAC", "Infiltration", "InitialAccess", "T1204"),
        LabelRule("Botnet", "Botnet", "CommandAndControl", "T1071", ("Bot", "Botnet Ares")),
        LabelRule("DoS Hulk", "DoS", "Impact", "T1499", ("DoS-Hulk", "DoS attacks-Hulk")),
        LabelRule("DoS GoldenEye", "DoS", "Impact", "T1499", ("DoS-GoldenEye", "DoS attacks-GoldenEye")),
        LabelRule("DoS Slowloris", "DoS", "Impact", "T1499", ("DoS-Slowloris", "DoS attacks-Slowloris")),
        LabelRule("DoS Slowhttptest", "DoS", "Impact", "T1499", ("DoS attacks-SlowHTTPTest",)),
        LabelRule("DDoS", "DDoS", "Impact", "T1498",
                  ("DDoS attacks-LOIC-HTTP", "DDOS attack-LOIC-UDP", "DDOS attack-HOIC",
                   "DDoS-LOIC-UDP", "DDoS-LOIC-HTTP", "DDoS LOIT")),
    ),
    "dapt2020": (
        LabelRule("Benign", "Benign", "Benign", None, ("BENIGN", "Normal")),
        LabelRule("Reconnaissance", "APT-Recon", "Reconnaissance", "T1595"),
        LabelRule("Establish Foothold", "APT-Foothold", "InitialAccess", "T1190",
                  ("Establish Foothold ", "Foothold", "Establishing Foothold")),
        LabelRule("Lateral Movement", "APT-Lateral", "LateralMovement", "T1021", ("LateralMovement",)),
        LabelRule("Data Exfiltration", "APT-Exfil", "Exfiltration", "T1041",
                  ("Exfiltration", "DataExfiltration")),
    ),
}


class TokenRule(NamedTuple):
    tokens: tuple[str, ...]
    family: str
    stage: str
    technique: str
    prefixes: tuple[str, ...] = ()
    scenarios: tuple[int, ...] = ()


# --- Fixed values: composite botnet labels, first matching rule wins ---------------------
TOKEN_RULES = (
    TokenRule(("spam", "smtp"), "Spam", "Impact", "T1496"),
    TokenRule(("ad",), "ClickFraud", "Impact", "T1496"),
    TokenRule(("irc", "p2p"), "Botnet", "CommandAndControl", "T1071", prefixes=("cc",)),
    TokenRule(("dns",), "Botnet", "CommandAndControl", "T1071"),
    TokenRule(("icmp", "udp"), "DDoS", "Impact", "T1498", scenarios=(4, 10, 11)),
    TokenRule(("attempt",), "PortScan", "Reconnaissance", "T1046", scenarios=(3, 5, 6, 8, 9, 12, 13)),
    TokenRule(("binary",), "Botnet", "CommandAndControl", "T1105"),
)
TOKEN_DEFAULT = TokenRule((), "Botnet", "CommandAndControl", "T1071")
BENIGN_WORDS = ("normal", "background")
BOTNET_WORD = "botnet"
LOFO_FAMILIES = ("PortScan", "BruteForce", "WebAttack", "DoS", "DDoS", "Botnet", "Infiltration")

# --- Fixed values: response knowledge ----------------------------------------------------
CURATED_COUNTERMEASURES = {
    "T1046": ("D3-CAA", "D3-NTF", "D3-NTCD"),
    "T1595": ("D3-CAA", "D3-ITF", "D3-NTCD"),
    "T1496": ("D3-PHDURA", "D3-OTF", "D3-NTF"),
}
COUNTERMEASURE_PREFERENCE = (
    "D3-NTF", "D3-ITF", "D3-OTF", "D3-CAA", "D3-ISVA", "D3-PHDURA", "D3-NTCD", "D3-RTSD",
    "D3-DNSDL", "D3-DNSTA", "D3-ST", "D3-ANCI", "D3-MFA", "D3-CTS", "D3-APCA", "D3-NTSA",
)
TACTIC_ORDER = {"Isolate": 0, "Detect": 1, "Evict": 2, "Harden": 3}
STAGE_TECHNIQUES = {
    "Reconnaissance": ("T1595", "T1046"),
    "InitialAccess": ("T1110", "T1190", "T1204"),
    "LateralMovement": ("T1021", "T1046"),
    "CommandAndControl": ("T1071", "T1105", "T1571"),
    "Exfiltration": ("T1041", "T1048"),
    "Impact": ("T1498", "T1499", "T1496"),
}

# --- Fixed values: kill-chain transition prior (row = stage now, column = next stage) -----
TRANSITION_PRIOR = (
    (0.975, 0.01, 0.006, 0.001, 0.005, 0.001, 0.002),
    (0.08, 0.85, 0.05, 0.005, 0.01, 0.0001, 0.005),
    (0.08, 0.01, 0.84, 0.02, 0.04, 0.005, 0.005),
    (0.07, 0.0001, 0.01, 0.84, 0.05, 0.02, 0.01),
    (0.05, 0.005, 0.005, 0.02, 0.89, 0.015, 0.015),
    (0.06, 0.0001, 0.0001, 0.01, 0.03, 0.89, 0.01),
    (0.08, 0.0001, 0.0001, 0.0001, 0.02, 0.0001, 0.90),
)
FORWARD_BONUS = 0.5


class Feature(NamedTuple):
    name: str
    grp: str
    is_log: bool
    unit: str


# --- Fixed values: the 92 state features, in contract order (group, log-compressed, unit) --
FEATURES = (
    Feature("flow_count", "volume", True, "flows"),
    Feature("flow_rate", "volume", True, "flows/s"),
    Feature("fwd_bytes_total", "volume", True, "bytes"),
    Feature("bwd_bytes_total", "volume", True, "bytes"),
    Feature("bytes_rate", "volume", True, "bytes/s"),
    Feature("fwd_packets_total", "volume", True, "pkts"),
    Feature("bwd_packets_total", "volume", True, "pkts"),
    Feature("packets_rate", "volume", True, "pkts/s"),
    Feature("bytes_per_flow_mean", "volume", True, "bytes"),
    Feature("bytes_per_flow_std", "volume", True, "bytes"),
    Feature("bytes_per_flow_max", "volume", True, "bytes"),
    Feature("packets_per_flow_mean", "volume", True, "pkts"),
    Feature("packets_per_flow_std", "volume", True, "pkts"),
    Feature("packets_per_flow_max", "volume", True, "pkts"),
    Feature("duration_mean", "volume", True, "s"),
    Feature("duration_std", "volume", True, "s"),
    Feature("duration_max", "volume", True, "s"),
    Feature("syn_rate", "flags", False, ""),
    Feature("ack_rate", "flags", False, ""),
    Feature("fin_rate", "flags", False, ""),
    Feature("rst_rate", "flags", False, ""),
    Feature("psh_rate", "flags", False, ""),
    Feature("urg_rate", "flags", False, ""),
    Feature("syn_ack_ratio", "flags", True, ""),
    Feature("unanswered_syn_frac", "flags", False, ""),
    Feature("rst_frac", "flags", False, ""),
    Feature("flag_entropy", "flags", False, ""),
    Feature("tcp_frac", "protocol", False, ""),
    Feature("udp_frac", "protocol", False, ""),
    Feature("icmp_frac", "protocol", False, ""),
    Feature("other_proto_frac", "protocol", False, ""),
    Feature("iat_mean_mean", "timing", True, "s"),
    Feature("iat_mean_std", "timing", True, "s"),
    Feature("iat_mean_min", "timing", True, "s"),
    Feature("iat_max_max", "timing", True, "s"),
    Feature("iat_std_mean", "timing", True, "s"),
    Feature("iat_regularity", "timing", False, ""),
    Feature("unique_src_hosts", "hosts", True, "hosts"),
    Feature("unique_dst_hosts", "hosts", True, "hosts"),
    Feature("unique_dst_ports", "ports", True, "ports"),
    Feature("unique_src_ports", "ports", True, "ports"),
    Feature("dst_port_entropy", "ports", False, ""),
    Feature("src_port_entropy", "ports", False, ""),
    Feature("dst_ip_entropy", "hosts", False, ""),
    Feature("src_ip_entropy", "hosts", False, ""),
    Feature("fanout_max", "hosts", True, "hosts"),
    Feature("fanout_mean", "hosts", True, "hosts"),
    Feature("ports_per_src_max", "ports", True, "ports"),
    Feature("ports_per_src_mean", "ports", True, "ports"),
    Feature("low_port_frac", "ports", False, ""),
    Feature("ephemeral_port_frac", "ports", False, ""),
    Feature("well_known_service_frac", "ports", False, ""),
    Feature("bidirectional_ratio_mean", "hosts", False, ""),
    Feature("unidirectional_flow_frac", "hosts", False, ""),
    Feature("empty_response_frac", "hosts", False, ""),
    Feature("flows_per_host_max", "hosts", True, "flows"),
    Feature("new_dst_port_frac", "ports", False, ""),
    Feature("ttl_mean_mean", "packet", False, ""),
    Feature("ttl_var_mean", "packet", True, ""),
    Feature("ttl_unique_mean", "packet", False, ""),
    Feature("ttl_spread", "packet", False, ""),
    Feature("win_mean_mean", "packet", True, "bytes"),
    Feature("win_std_mean", "packet", True, "bytes"),
    Feature("win_zero_rate", "packet", False, ""),
    Feature("frag_rate_mean", "packet", False, ""),
    Feature("retrans_rate", "packet", False, ""),
    Feature("payload_hist_0_mean", "packet", False, ""),
    Feature("payload_hist_1_mean", "packet", False, ""),
    Feature("payload_hist_2_mean", "packet", False, ""),
    Feature("payload_hist_3_mean", "packet", False, ""),
    Feature("payload_hist_4_mean", "packet", False, ""),
    Feature("payload_hist_5_mean", "packet", False, ""),
    Feature("payload_hist_6_mean", "packet", False, ""),
    Feature("payload_hist_7_mean", "packet", False, ""),
    Feature("auth_conn_max", "access", True, "flows"),
    Feature("auth_short_frac", "access", False, ""),
    Feature("web_conn_max", "access", True, "flows"),
    Feature("half_open_max", "access", True, "flows"),
    Feature("seq_port_score", "access", False, ""),
    Feature("icmp_sweep_max", "access", True, "hosts"),
    Feature("int_int_frac", "lateral", False, ""),
    Feature("int_fanout_max", "lateral", True, "hosts"),
    Feature("int_scan_max", "lateral", True, "hosts"),
    Feature("dns_max", "c2", True, "flows"),
    Feature("smtp_frac", "c2", False, ""),
    Feature("out_bytes_max", "exfil", True, "bytes"),
    Feature("out_asym_max", "exfil", False, ""),
    Feature("long_out_bytes", "exfil", True, "bytes"),
    Feature("new_pair_frac", "lookback", False, ""),
    Feature("new_int_pairs", "lookback", True, "pairs"),
    Feature("beacon_max", "lookback", False, ""),
    Feature("beacon_pairs", "lookback", True, "pairs"),
)
FEATURE_NAMES = tuple(f.name for f in FEATURES)
LOG_FEATURES = frozenset(f.name for f in FEATURES if f.is_log)
PACKET_FEATURES = tuple(f.name for f in FEATURES if f.grp == "packet")
GROUPS = ("volume", "flags", "protocol", "timing", "ports", "hosts", "packet",
          "access", "lateral", "c2", "exfil", "lookback")
GROUP_MASK = {"packet": "m_packet", "lateral": "m_ip", "exfil": "m_ip", "lookback": "m_lookback"}
MASKS = ("m_packet", "m_ip", "m_lookback")
