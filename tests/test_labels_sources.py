"""Label vocabularies, parsers and CSV readers on small hand-written inputs."""

import re

import pytest
from pyspark.sql import functions as F

from netloom.functions import scalars as sc
from netloom.operators import knowledge as kb
from netloom.operators import labels as lb
from netloom.sources import csv_flows as cf
from netloom.sources import packets as pk


def exact(spark, family, raw):
    df = spark.createDataFrame([(r,) for r in raw], "label string")
    rows = lb.resolve_exact(df, lb.label_dimension(spark, family)).collect()
    return {r["label"]: (r["family"], r["stage"], r["attempted"]) for r in rows}


def test_exact_labels(spark):
    got = exact(spark, "cicids", ["BENIGN", "Infiltration - Attempted", "DoS Hulk - Attempted", "Web Attack – XSS",
                                  "infiltration  -  portscan", "Bot", "DDoS attacks-LOIC-HTTP"])
    assert got["BENIGN"] == ("Benign", "Benign", False)
    assert got["Infiltration - Attempted"] == ("Infiltration", "InitialAccess", True)
    assert got["DoS Hulk - Attempted"] == ("DoS", "Impact", True)
    assert got["Web Attack – XSS"] == ("WebAttack", "InitialAccess", False)
    assert got["infiltration  -  portscan"] == ("Infiltration", "LateralMovement", False)
    assert got["Bot"][1] == "CommandAndControl"
    assert got["DDoS attacks-LOIC-HTTP"][0] == "DDoS"


def test_stage_column_labels(spark):
    got = exact(spark, "dapt2020", ["Benign", "Establish Foothold ", "Data Exfiltration"])
    assert got["Establish Foothold "][0] == "APT-Foothold"
    assert got["Data Exfiltration"][1] == "Exfiltration"


def test_unmapped_label_fails_the_job(spark):
    with pytest.raises(Exception, match="unmapped label"):
        exact(spark, "cicids", ["Something New"])


@pytest.mark.parametrize("label,scenario,family,stage", [
    ("flow=Background-UDP", 1, "Benign", "Benign"),
    ("flow=From-Normal-V42-Stribrek", 1, "Benign", "Benign"),
    ("", 1, "Benign", "Benign"),
    ("flow=From-Botnet-V42-TCP-CC73-Not-Encrypted", 1, "Botnet", "CommandAndControl"),
    ("flow=From-Botnet-V42-UDP-DNS", 4, "Botnet", "CommandAndControl"),
    ("flow=From-Botnet-V47-ICMP", 4, "DDoS", "Impact"),
    ("flow=From-Botnet-V47-ICMP", 1, "Botnet", "CommandAndControl"),
    ("flow=From-Botnet-V50-TCP-Attempt", 9, "PortScan", "Reconnaissance"),
    ("flow=From-Botnet-V50-TCP-Attempt-SPAM", 9, "Spam", "Impact"),
    ("flow=From-Botnet-V42-TCP-HTTP-Ad-4", 2, "ClickFraud", "Impact"),
    ("flow=From-Botnet-V42-TCP-CCx", 2, "Botnet", "CommandAndControl"),
])
def test_token_labels(spark, label, scenario, family, stage):
    df = spark.createDataFrame([(label, scenario)], "label string, scenario int")
    row = lb.resolve_tokens(df).first()
    assert (row["family"], row["stage"]) == (family, stage)


def test_refine_external_lateral_movement(spark):
    df = spark.createDataFrame([("172.16.0.1", "LateralMovement", "T1046"), ("192.168.10.8", "LateralMovement", "T1046")],
                               "src_ip string, stage string, technique string")
    rows = lb.refine_stages(df, ["192.168.10.0/24"]).collect()
    assert [(r["stage"], r["technique"]) for r in rows] == [("Reconnaissance", "T1595"), ("LateralMovement", "T1046")]


def test_time_layouts(spark):
    texts = ["2017-07-07 12:30:05.25", "2017-07-07 12:30:05", "2017/07/07 12:30:05.250000", "2017/07/07 12:30:05",
             "07/07/2017 12:30:05", "7/7/2017 12:30:05 PM", "7/7/2017 12:30", "7/7/17 12:30", "07-07-2017 12:30:05",
             "1499430605.5", "soon"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(sc.parse_time(F.col("t"))).collect()]
    base = 1499430605.0
    assert got == [base + 0.25, base, base + 0.25, base, base, base, base - 5, base - 5, base, base + 0.5, None]


def test_flowmeter_reader(spark, tmp_path):
    folder = tmp_path / "day"
    folder.mkdir()
    (folder / "Friday One.csv").write_text(
        "Flow ID, Source Port, Destination Port, Protocol, Timestamp, Flow Duration, Total Fwd Packets,"
        "Total Fwd Packet,Flow IAT Mean,Fwd Init Win Bytes,Label\n"
        "10.0.0.1-8.8.8.8-1-2-6,1000,80,6,7/7/2017 8:59,2000000,5,9,500000,8192,BENIGN\n"
        "10.0.0.2-8.8.8.8-1-2-17,0x10,99999,17,7/7/2017 9:00,Infinity,-,9,NaN,0,Portscan - Attempted\n"
        "10.0.0.3-8.8.8.8-1-2-6,1,2,6,never,1,1,1,1,1,BENIGN\n")
    rows = cf.read_flows(spark, str(folder)).orderBy("ts").collect()
    assert len(rows) == 2
    a, b = rows
    assert (a["src_ip"], a["duration"], a["fwd_packets"], a["iat_mean"], a["win_mean"]) == ("10.0.0.1", 2.0, 5.0, 0.5, 8192.0)
    assert a["capture"] == "cic17-friday_one" and a["te"] == a["ts"] + 2.0 and a["ttl_mean"] is None
    assert (b["src_port"], b["dst_port"], b["duration"], b["fwd_packets"], b["win_mean"]) == (16, -1, None, None, None)
    assert (b["stage"], b["attempted"], b["is_attack"]) == ("Reconnaissance", True, True)


def test_headerless_file_borrows_a_sibling_header(spark, tmp_path):
    head = "Flow ID,Src Port,Dst Port,Protocol,Timestamp,Flow Duration,Activity,Stage\n"
    row = "10.0.0.{0}-8.8.8.8-1-2-6,1,2,6,01/02/2019 10:00:0{0},10,x,{1}\n"
    (tmp_path / "a_Flow.csv").write_text(head + row.format(1, "Benign"))
    (tmp_path / "b_Flow.csv").write_text(row.format(2, "Reconnaissance") + row.format(3, "Benign"))
    files = cf.list_files(spark, str(tmp_path), "*_Flow.csv")
    rows = cf.read_stage_labelled(spark, files).orderBy("src_ip").collect()
    assert [(r["src_ip"], r["stage"]) for r in rows] == [
        ("10.0.0.1", "Benign"), ("10.0.0.2", "Reconnaissance"), ("10.0.0.3", "Benign")]


def test_argus_reader(spark, tmp_path):
    folder = tmp_path / "4"
    folder.mkdir()
    (folder / "x.binetflow").write_text(
        "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"
        "2011/08/15 13:45:00.5,2.0,tcp,147.32.1.1,0x0303,->,8.8.8.8,80,SRPA_SPA,0,0,4,400,100,flow=Background\n"
        "2011/08/15 13:45:01,1.0,icmp,147.32.1.1,,->,8.8.8.8,,ECO,0,0,2,100,300,flow=From-Botnet-V47-ICMP\n")
    assert cf.detect_format(spark, str(folder / "x.binetflow")) == "argus"
    a, b = cf.read_argus(spark, [str(folder / "x.binetflow")]).orderBy("ts").collect()
    assert (a["src_port"], a["bwd_bytes"], a["fwd_packets"], a["bwd_packets"]) == (0x303, 300.0, 1.0, 3.0)
    assert (a["syn_count"], a["rst_count"], a["fin_count"]) == (1.0, 1.0, 0.0)
    assert (b["bwd_bytes"], b["fwd_packets"], b["dst_port"], b["protocol"]) == (0.0, 2.0, -1, 1)
    assert (b["family"], b["capture"]) == ("DDoS", "ctu-s04")


def test_folder_of_different_headers(spark, tmp_path):
    head = ["Flow ID,Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp,Flow Duration,Label",
            "Dst Port,Protocol,Timestamp,Flow Duration,Label,Src IP,Src Port,Dst IP"]
    (tmp_path / "a.csv").write_text(head[0] + "\nx,10.0.0.1,1,10.0.0.2,2,6,01/02/2019 10:00:01,10,BENIGN\n" * 1
                                    + "x,10.0.0.1,1,10.0.0.2,2,6,01/02/2019 10:00:01,10,BENIGN\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text(head[1] + "\n2,6,01/02/2019 10:00:02,10,BENIGN,10.0.0.1,1,10.0.0.2\n")
    rows = cf.read_flows(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r["src_ip"], r["src_port"], r["dst_ip"], r["dst_port"]) for r in rows] == [("10.0.0.1", 1, "10.0.0.2", 2)] * 3


def test_unknown_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one,two\n1,2\n")
    with pytest.raises(cf.FlowSchemaError, match="no known header"):
        cf.read_flows(spark, str(tmp_path))
    with pytest.raises(cf.FlowSchemaError):
        cf.read_flows(spark, str(tmp_path), "stage_labelled")


def test_argus_without_scenario(spark, tmp_path):
    folder = tmp_path / "some"
    folder.mkdir()
    for name in ("x.binetflow", "capture-s09.binetflow"):
        (folder / name).write_text(
            "StartTime,Dur,Proto,SrcAddr,Sport,Dir,DstAddr,Dport,State,sTos,dTos,TotPkts,TotBytes,SrcBytes,Label\n"
            "2011/08/15 13:45:00.5,2.0,tcp,147.32.1.1,1,->,8.8.8.8,80,SRPA_SPA,0,0,4,400,100,flow=From-Botnet-V50-TCP-Attempt\n")
    rows = cf.read_flows(spark, str(folder)).orderBy("capture").collect()
    assert [(r["capture"], r["family"]) for r in rows] == [("ctu-s00", "Botnet"), ("ctu-s09", "PortScan")]


def test_missing_required_column(spark):
    with pytest.raises(cf.FlowSchemaError):
        cf.conform(spark.createDataFrame([(1.0,)], "ts double"))


def test_packet_statistics(spark):
    rows = [("f", 64, 0, 100, 7, 10), ("f", 64, 0, 100, 7, 10), ("f", 66, 1, 0, 8, 0), ("f", None, 0, None, None, 1500)]
    df = spark.createDataFrame(rows, "flow_key string, ttl int, fragmented int, tcp_window bigint, tcp_seq bigint, payload_size int")
    r = pk.packet_statistics(df).first()
    assert r["retrans_count"] == 1.0 and r["ttl_unique"] == 2.0 and r["win_zero_count"] == 1.0
    assert r["frag_rate"] == 0.25 and r["ttl_mean"] == pytest.approx(194 / 3)
    assert (r["payload_hist_0"], r["payload_hist_1"], r["payload_hist_7"]) == (1.0, 2.0, 1.0)


def grouped_columns(df):
    """Widths of the rows that the plan's hash aggregates keep, by their numbers of keys."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [(len(k.split(", ")), len(f.split(", ")) if f else 0)
            for k, f in re.findall(r"HashAggregate\(keys=\[(.+?)\], functions=\[(.*?)\], output", plan)]


def test_packets_by_sequence_number_are_narrow(spark):
    schema = "flow_key string, ttl int, fragmented int, tcp_window bigint, tcp_seq bigint, payload_size int"
    rows = [(k, 60 + i % 3, i % 2, i * 10, i % 5 if i % 7 else None, i % 4 * 30) for k in ("f", "g", None) for i in range(40)]
    out = pk.packet_statistics(spark.createDataFrame(rows, schema))
    wide = [functions for keys, functions in grouped_columns(out) if keys > 1]
    assert wide and max(wide) == 0
    found = {r["flow_key"]: r for r in out.collect()}
    carried = [r[4] for r in rows if r[0] == "f" and r[4] is not None and r[5] > 0]
    assert set(found) == {"f", "g", None}
    assert all(r["retrans_count"] == len(carried) - len(set(carried)) and r["ttl_unique"] == 3 for r in found.values())


def test_mitigations_do_not_sort_relationships(spark):
    ref = "array<struct<source_name: string, external_id: string, url: string>>"
    schema = ("id string, type string, revoked boolean, x_mitre_deprecated boolean, name string, description string, "
              f"relationship_type string, source_ref string, target_ref string, external_references {ref}")

    def obj(key, kind, name, external, revoked=False):
        return (key, kind, revoked, None, name, None, None, None, None, [("mitre-attack", external, "u")])

    def link(key, source, target):
        return (key, "relationship", None, None, None, None, "mitigates", source, target, None)

    rows = [obj("p1", "attack-pattern", "one", "T1"), obj("p2", "attack-pattern", "two", "T2"), obj("p3", "attack-pattern", "x", "T3", True),
            obj("s1", "course-of-action", "b", "M1"), obj("s2", "course-of-action", "a", "M1"), obj("s3", "course-of-action", "c", "X1"),
            link("r1", "s1", "p1"), link("r2", "s1", "p1"), link("r3", "s2", "p1"), link("r4", "s1", "p2"), link("r5", "s2", "p3"), link("r6", "s3", "p1")]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = kb.mitigations(spark.createDataFrame(rows, schema))
        assert sorted(map(tuple, out.collect())) == [("T1", "M1", "a"), ("T2", "M1", "b")]
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and not re.search(r"SortAggregate\(key=\[technique", plan)


def test_headers_take_one_task_per_file(spark, tmp_path):
    """However small the splits are: a large file is opened once, and a small one is not packed with others."""
    for i, rows in enumerate((3000, 1, 40)):
        (tmp_path / f"f{i}.csv").write_text(f"a{i},b\n" + "1,2\n" * rows)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = cf.headers_of(spark, [str(tmp_path)])
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found.values()) == [["a0", "b"], ["a1", "b"], ["a2", "b"]]
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("headers") for s in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) == 3
