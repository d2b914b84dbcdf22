"""Flow CSV dialects to the canonical schema.

Cells are read as text and cast leniently, so one malformed cell never fails a file. The first
lines of all files come to the driver from one job; files of one header are one scan, and Catalyst
then prunes the unmapped columns.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import vocab
from netloom.functions import scalars as sc
from netloom.operators.labels import label_dimension, resolve_exact, resolve_tokens

# Workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUMERIC = (*vocab.FLOW_COLUMNS, "win_mean", "tot_packets", "tot_bytes")
CAPTURE_PREFIX = {"cicids2017": "cic17", "cicids2018": "cic18", "ctu13": "ctu", "dapt2020": "dapt"}


class FlowSchemaError(ValueError):
    """The input cannot be brought to the canonical flow schema."""


def fold(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> list[str]:
    reader = spark.read.format("text").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return sorted(unquote(p) for p in reader.load(root).inputFiles())


#: Above any file's size: a file is never split and never shares its partition.
WHOLE_FILE = str(1 << 50)


def _first_rows(batches):
    """First line of the partition's file; the rest is not read."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("path").slice(0, 1), batch.column("value").slice(0, 1)],
                                             names=["path", "value"])
            return


def headers_of(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Cells of the first line of every file, compressed ones too; folders are read through.

    One job with one task per file, however large the file: the task stops after the first batch of lines.
    """
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k in settings:
            spark.conf.set(k, WHOLE_FILE)
        text = spark.read.option("recursiveFileLookup", "true").text(list(paths))
        lines = text.select(F.col("_metadata.file_path").alias("path"), "value")
        rows = lines.mapInArrow(_first_rows, "path string, value string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return {unquote(r.path): next(csv.reader([(r.value or "").lstrip("\ufeff")]), [""]) for r in sorted(rows)}


def kind_of(path: str, names: Sequence[str]) -> str | None:
    """Dialect of a file from its suffix and header; None if the first line is no header of a known dialect."""
    folded = {fold(n) for n in names}
    if ".binetflow" in path.lower() or {"srcaddr", "dstaddr"} <= folded:
        return "argus"
    if not any(vocab.FLOWMETER_HEADERS.get(n) == "time_text" for n in folded):
        return None
    return "stage_labelled" if "stage" in folded else "flowmeter"


def _scan(spark: SparkSession, paths: Sequence[str], headers: dict[str, str], names: Sequence[str],
          has_header: bool = True) -> DataFrame:
    """Project the mapped columns of same-header files; the first of two equal names wins."""
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    raw = (spark.read.option("header", str(has_header).lower()).option("enforceSchema", "true")
           .schema(schema).csv(list(paths)))
    picked: dict[str, Column] = {}
    for i, original in enumerate(names):
        target = headers.get(fold(original))
        if target and target not in picked:
            cell = F.col(f"c{i}")
            known = F.when(~cell.isin(*vocab.NULL_TOKENS), cell)
            picked[target] = sc.lenient_double(cell) if target in NUMERIC else known
    file = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name")]
    return raw.select(*[c.alias(n) for n, c in picked.items()], *file)


def scan_projected(spark: SparkSession, paths: Sequence[str], headers: dict[str, str],
                   sibling_header: bool = False, found: dict[str, list[str]] | None = None) -> DataFrame:
    """Read files that may differ in header; with ``sibling_header`` a headerless file takes the
    header of another file of equal width. ``found``: headers by file, if they are known already."""
    by_header: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    found = headers_of(spark, paths) if found is None else found
    known = {p: any(fold(n) in headers for n in names) for p, names in found.items()}
    for path, names in found.items():
        if known[path]:
            by_header.setdefault((tuple(names), True), []).append(path)
            continue
        match = next((h for p, h in found.items() if known[p] and len(h) == len(names)), None)
        if match is None or not sibling_header:
            raise FlowSchemaError(f"{path}: its first line is no known header" + (" and no sibling's fits" if sibling_header else ""))
        by_header.setdefault((tuple(match), False), []).append(path)
    if not by_header:
        raise FlowSchemaError(f"no files with rows in {list(paths)}")
    parts = [_scan(spark, files, headers, names, has) for (names, has), files in by_header.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def conform(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Canonical columns and types: missing key or flow columns fail, missing packet columns are NULL."""
    missing = [c for c in (*vocab.KEY_COLUMNS, *vocab.FLOW_COLUMNS) if c not in df.columns]
    if missing:
        raise FlowSchemaError(f"missing required columns {sorted(missing)}")
    types = {"src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "protocol": "smallint",
             "label": "string", "family": "string", "stage": "string", "technique": "string",
             "is_attack": "boolean", "attempted": "boolean"}
    defaults = {"label": "BENIGN", "family": "Benign", "stage": "Benign", "technique": None,
                "is_attack": False, "attempted": False}
    out = []
    for name in (*vocab.KEY_COLUMNS, *vocab.FLOW_COLUMNS, *vocab.PACKET_COLUMNS, *vocab.LABEL_COLUMNS):
        kind = types.get(name, "double")
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(defaults.get(name)).cast(kind)
        out.append(value.alias(name))
    return df.select(*out, *extra)


def has_packet_level(flows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Does any representative packet column carry a measurement (per group)?"""
    seen = [F.coalesce(~F.isnan(c), F.lit(False)) & F.col(c).isNotNull() for c in ("ttl_mean", "win_mean", "frag_rate", "retrans_count")]
    any_seen = seen[0] | seen[1] | seen[2] | seen[3]
    return flows.groupBy(*by).agg(F.coalesce(F.bool_or(any_seen), F.lit(False)).alias("has_packet_level"))


def capture_name(dataset: str, stem: Column) -> Column:
    return F.concat(F.lit(CAPTURE_PREFIX.get(dataset, dataset) + "-"), F.lower(F.replace(stem, F.lit(" "), F.lit("_"))))


def file_stem(name: Column) -> Column:
    """File name without its extensions; Spark reports names URL-encoded."""
    plain = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(plain, r"\.gz$", ""), r"\.[^.]*$", "")


def _finish(df: DataFrame, dataset: str, capture: Column, on_unmapped: str) -> DataFrame:
    df = df.withColumns({"capture": capture, "dataset": F.lit(dataset)})
    if "te" not in df.columns:
        df = df.withColumn("te", F.col("ts") + F.coalesce("duration", F.lit(0.0)))
    if "label" in df.columns:
        if dataset == "ctu13":
            df = resolve_tokens(df, on_unmapped=on_unmapped)
        else:
            family = "cicids" if dataset.startswith("cicids") else dataset
            df = resolve_exact(df, label_dimension(df.sparkSession, family), on_unmapped=on_unmapped)
    canonical = conform(df, ["dataset", "capture"]).filter(F.col("ts").isNotNull())
    keyed = [F.col(c) for c in canonical.columns]
    return canonical.withColumn("flow_id", F.xxhash64(*keyed))


def read_flowmeter(spark: SparkSession, paths: Sequence[str], dataset: str = "cicids2017",
                   label_column: str = "label", sibling_header: bool = False,
                   on_unmapped: str = "error", found: dict[str, list[str]] | None = None) -> DataFrame:
    """Bidirectional flow-meter exports; durations and inter-arrival times are microseconds."""
    df = scan_projected(spark, paths, vocab.FLOWMETER_HEADERS, sibling_header, found)
    if "time_text" not in df.columns:
        raise FlowSchemaError("no timestamp column")
    if label_column != "label":
        if label_column not in df.columns:
            raise FlowSchemaError(f"no {label_column!r} column for labels")
        df = df.drop("label").withColumnRenamed(label_column, "label")
    if "src_ip" not in df.columns and "flow_key" in df.columns:
        df = df.withColumns({"src_ip": sc.flow_key_ip(F.col("flow_key"), 0),
                             "dst_ip": sc.flow_key_ip(F.col("flow_key"), 1)})
    new = {"ts": sc.parse_time(F.col("time_text"))}
    new |= {c: F.col(c) / F.lit(1e6) for c in vocab.MICROSECOND_COLUMNS if c in df.columns}
    new |= {p: sc.port_number(F.col(p)) for p in ("src_port", "dst_port") if p in df.columns}
    if "protocol" in df.columns:
        new["protocol"] = sc.protocol_number(F.col("protocol"))
    df = df.withColumns(new)
    df = df.withColumns({c: F.lit("0.0.0.0" if c.endswith("_ip") else 0.0)
                         for c in (*vocab.KEY_COLUMNS, *vocab.FLOW_COLUMNS) if c not in df.columns and c != "te"})
    if "win_mean" in df.columns:
        absent = (F.col("win_mean") < 0) | (F.col("protocol") != 6)
        df = df.withColumn("win_mean", F.when(~absent, F.col("win_mean")))
    return _finish(df, dataset, capture_name(dataset, file_stem(F.col("file_name"))), on_unmapped)


def read_stage_labelled(spark: SparkSession, paths: Sequence[str], on_unmapped: str = "error",
                        found: dict[str, list[str]] | None = None) -> DataFrame:
    """Flow-meter files labelled by their Stage column; files may lack their header."""
    return read_flowmeter(spark, paths, "dapt2020", "stage_label", True, on_unmapped, found)


def read_argus(spark: SparkSession, paths: Sequence[str], scenario: int | None = None,
               on_unmapped: str = "error", found: dict[str, list[str]] | None = None) -> DataFrame:
    """Bidirectional netflow with totals only: the backward side is the rest, flags come from State.

    Without a given scenario a file's is that of its folder (``4/x``) or name (``s04``), or else 0.
    """
    c = F.col
    df = scan_projected(spark, paths, vocab.ARGUS_HEADERS, found=found)
    named = [F.regexp_extract("source_file", p, 1).try_cast("int") for p in (r"/(\d+)/[^/]*$", r"s(\d{2})[^/]*$")]
    number = F.lit(scenario) if scenario is not None else F.coalesce(*named, F.lit(0))
    zero = F.lit(0.0)
    df = df.withColumns({
        "scenario": number, "ts": sc.parse_time(c("time_text")),
        "protocol": sc.protocol_number(c("protocol")), "src_port": sc.port_number(c("src_port")),
        "dst_port": sc.port_number(c("dst_port")), "duration": F.coalesce("duration", zero),
        "tot_packets": F.coalesce("tot_packets", zero), "tot_bytes": F.coalesce("tot_bytes", zero),
        "fwd_bytes": F.coalesce("fwd_bytes", zero),
    })
    split = argus_split(c("tot_packets"), c("tot_bytes"), c("fwd_bytes"), c("duration"))
    df = df.withColumns({**split, **flag_counts(c("state_text"))})
    return _finish(df, "ctu13", F.format_string("ctu-s%02d", c("scenario")), on_unmapped)


def flag_counts(state: Column) -> dict[str, Column]:
    text = F.upper(F.coalesce(state, F.lit("")))
    return {f"{flag}_count": text.contains(flag[0].upper()).cast("double") for flag in vocab.FLAGS}


def argus_split(packets: Column, octets: Column, forward: Column, duration: Column) -> dict[str, Column]:
    """Forward and backward counts by byte share, and mean gap and length in place of statistics."""
    fwd_share = sc.clip(forward / F.greatest(octets, F.lit(1.0)), 0.0, 1.0)
    per = F.greatest(packets, F.lit(1.0))
    gap, size = duration / per, octets / per
    # Halves round away from zero, as for plain floats.
    return {
        "bwd_bytes": F.greatest(octets - forward, F.lit(0.0)),
        "fwd_packets": F.round(packets * fwd_share), "bwd_packets": F.round(packets * (1.0 - fwd_share)),
        "iat_mean": gap, "iat_std": F.lit(0.0), "iat_max": gap, "iat_min": gap,
        "pkt_len_mean": size, "pkt_len_std": F.lit(0.0), "pkt_len_max": size, "pkt_len_min": size,
    }


def detect_format(spark: SparkSession, path: str) -> str:
    """argus, stage_labelled or flowmeter, from the suffix and then the header, of a file."""
    (name, header), *_ = headers_of(spark, [path]).items()
    return kind_of(name, header) or "flowmeter"


def read_flows(spark: SparkSession, path: str, fmt: str = "auto", dataset: str = "cicids2017",
               scenario: int | None = None, on_unmapped: str = "error") -> DataFrame:
    """One entry point for every dialect, for a file or a folder of files that may differ in dialect and header.

    A file whose first line is no known header is read with the header of a stage-labelled file of
    equal width; without one it fails the job.
    """
    found = headers_of(spark, [path])
    if not found:
        raise FlowSchemaError(f"{path}: no files with rows")
    kinds = {p: kind_of(p, names) if fmt == "auto" else fmt for p, names in found.items()}
    spare = "stage_labelled" if "stage_labelled" in kinds.values() else None
    groups: dict[str, dict[str, list[str]]] = {}
    for file, names in found.items():
        kind = kinds[file] or spare
        if kind is None:
            raise FlowSchemaError(f"{file}: its first line is no known header")
        groups.setdefault(kind, {})[file] = names
    parts = []
    for kind, files in groups.items():
        if kind == "argus":
            parts.append(read_argus(spark, list(files), scenario, on_unmapped, files))
        elif kind == "stage_labelled":
            parts.append(read_stage_labelled(spark, list(files), on_unmapped, files))
        else:
            parts.append(read_flowmeter(spark, list(files), dataset, on_unmapped=on_unmapped, found=files))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slice_csv(spark: SparkSession, path: str, start: float, end: float, out: str, ts_column: str,
              columns: Sequence[str] | None = None) -> None:
    """Copy the rows of a time span to gzip CSV in the original layout."""
    raw = spark.read.option("header", str(columns is None).lower()).csv(path)
    if columns is not None:
        raw = raw.toDF(*columns)
    at = sc.parse_time(F.col(f"`{ts_column}`"))
    raw.filter(at.between(start, end)).write.option("header", "true").option("compression", "gzip").csv(out)
