"""Query registry and the flow projection that the driver tables are read through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom import vocab
from netloom.config import EngineConfig
from netloom.functions.scalars import stage_name
from netloom.session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CFG = EngineConfig(
    window_seconds=3600.0, session_gap_seconds=7200.0, warmup_windows=12, context=8, horizons=(3, 6),
    primary_horizon=6, episode_merge_gap=3, onset_quiet=3, internal_cidrs=("192.168.1.0/24",),
    new_pair_lookback=8, beacon_gap_seconds=(2.0, 1e6), seq_min_flows=3,
    block_rows=500, session_block=128,
)

FLOW_TEXT = """
select event_id as flow_id, concat('c', cast(user_id%5 as {S})) as capture,
  {EP} as ts, {EP}+value as te, value as duration,
  concat('192.168.1.', cast(user_id%10 as {S})) as src_ip,
  case when k<30 then concat('192.168.1.', cast(k%10 as {S}))
       else concat('8.8.4.', cast(k%10 as {S})) end as dst_ip,
  cast(1024+event_id%60000 as int) as src_port,
  cast(case when event_id%11=0 then 25 when event_type='click' then 443 when event_type='view' then 80
       when event_type='error' then 22 when event_type='purchase' then 23 else 53 end as int) as dst_port,
  cast(case event_id%10 when 0 then 1 when 1 then 17 else 6 end as smallint) as protocol,
  cast(1+event_id%5 as double) as fwd_packets,
  cast(case when event_id%7=0 then 0 else 1+event_id%3 end as double) as bwd_packets,
  cast(case when event_id%10>1 then 1 else 0 end as double) as syn_count,
  cast(case when event_id%10>1 and event_id%4>0 then 1 else 0 end as double) as ack_count,
  cast(case when event_id%4=1 then 1 else 0 end as double) as fin_count,
  cast(case when event_id%13=0 then 1 else 0 end as double) as rst_count,
  cast(event_id%3 as double) as psh_count, cast(0 as double) as urg_count,
  value/(1+event_id%5) as iat_mean, value/10 as iat_std, value as iat_max, value/100 as iat_min,
  value*2 as pkt_len_mean, value/2 as pkt_len_std, value*4 as pkt_len_max, value/4 as pkt_len_min,
  case when user_id%5=0 then cast(32+event_id%97 as double) end as ttl_mean,
  value*10 as fwd_bytes, case when event_id%7=0 then 0.0 else value*3 end as bwd_bytes,
  case when event_type='error' and value>150 then cast(event_id%6+1 as int) else 0 end as stage_no
from (select *, cast({J} as int) as k from {T}) e
"""
FAMILIES = ("Benign", "APT-Recon", "BruteForce", "Infiltration", "Botnet", "APT-Exfil", "DoS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical flows as a projection of the events table (every row of it)."""
    configure(spark)
    text = FLOW_TEXT.format(S="string", EP="unix_micros(cast(ts as timestamp))/1e6",
                            J="get_json_object(props,'$.k')", T="{events}")
    base = spark.sql(text, events=table(spark, sf_dir, "events"))
    family = F.element_at(F.array(*[F.lit(x) for x in FAMILIES]), F.col("stage_no") + 1)
    attack = F.col("stage_no") > 0
    missing = [c for c in vocab.PACKET_COLUMNS if c != "ttl_mean"]
    return base.withColumns({
        "stage": stage_name(F.col("stage_no")), "family": family, "is_attack": attack,
        "attempted": attack & (F.col("flow_id") % 4 == 0), "technique": F.lit(None).cast("string"),
        "label": family, "dataset": F.lit("events"),
        **{c: F.lit(None).cast("double") for c in missing},
    })


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per application to the shared folder, then read by many queries.

    Evaluation always works on a stored windows table; this also ends the lineage at durable files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical flows as a table, as a build reads them many times: the projection is computed once."""
    return stored(spark, sf_dir, "flows", lambda: flows(spark, sf_dir))


# The data has two decimals, so means over 2^k rows end exactly on a rounding border, where the
# order of a floating-point sum decides. Both engines shift by this much before rounding.
OFF_BORDER = 1.7e-8


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, doubles rounded to 6 places (and no -0.0)."""
    def fix(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c.cast("double") + F.lit(OFF_BORDER), 6) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("bigint").alias(field.name)
        return c
    return df.select(*[fix(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its DuckDB text."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(configure(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(expr: str, name: str) -> str:
    return f"round(cast({expr} as double) + {OFF_BORDER}::double, 6) + 0.0 as {name}"


def big(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"
