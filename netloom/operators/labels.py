"""Raw labels to family, stage and technique; per-window ground truth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom import vocab
from netloom.functions.scalars import in_networks, is_attempted, label_tokens, normalise_label, stage_index

LABEL_DIM_SCHEMA = "label_key string, family string, stage string, technique string"


def label_dimension(spark: SparkSession, family_of_datasets: str) -> DataFrame:
    """Label rules as a table; its size is fixed by the vocabulary (under 60 keys)."""
    rows = [(name, r.family, r.stage, r.technique)
            for r in vocab.LABEL_MAP[family_of_datasets] for name in (r.label, *r.aliases)]
    raw = spark.createDataFrame(rows, "raw string, family string, stage string, technique string")
    return raw.select(normalise_label(F.col("raw")).alias("label_key"), "family", "stage", "technique").distinct()


def resolve_exact(df: DataFrame, dim: DataFrame, label: str = "label", on_unmapped: str = "error") -> DataFrame:
    """Look labels up by key; an exact key wins over the key without its "-attempted" suffix.

    ``on_unmapped`` is "error" (the job fails at the first such row) or "null".
    """
    key = normalise_label(F.col(label))
    small = F.broadcast(dim)
    plain = small.select(F.col("label_key").alias("_key"), F.struct("family", "stage", "technique").alias("_hit"))
    base = plain.select(F.col("_key").alias("_base"), F.col("_hit").alias("_base_hit"))
    out = (
        df.withColumn("_key", key)
        .withColumn("_base", F.when(F.col("_key").endswith("-attempted"), F.regexp_replace("_key", "-attempted$", "")))
        .join(plain, "_key", "left").join(base, "_base", "left")
        .withColumn("_hit", F.coalesce("_hit", "_base_hit"))
    )
    stage = F.col("_hit.stage")
    if on_unmapped == "error":
        message = F.concat(F.lit("unmapped label: "), F.coalesce(F.col(label), F.lit("NULL")))
        stage = F.when(F.col("_hit").isNull(), F.raise_error(message).cast("string")).otherwise(stage)
    return out.select(
        *df.columns, F.col("_hit.family").alias("family"), stage.alias("stage"),
        F.col("_hit.technique").alias("technique"), (stage != "Benign").alias("is_attack"),
        is_attempted(F.col(label)).alias("attempted"),
    )


def unmapped_labels(df: DataFrame, dim: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels no rule covers (left anti, both with and without the suffix)."""
    keyed = df.select(label).distinct().withColumn("_key", normalise_label(F.col(label)))
    keyed = keyed.withColumn("_base", F.regexp_replace("_key", "-attempted$", ""))
    known = F.broadcast(dim.select("label_key"))
    return (keyed.join(known, keyed["_key"] == known["label_key"], "left_anti")
            .join(known, keyed["_base"] == known["label_key"], "left_anti").select(label))


def resolve_tokens(df: DataFrame, label: str = "label", scenario: str = "scenario",
                   on_unmapped: str = "error") -> DataFrame:
    """Composite botnet labels: the first rule whose token, prefix and scenario match decides."""
    key, tokens = normalise_label(F.col(label)), F.col("_tokens")

    def matches(rule: vocab.TokenRule) -> Column:
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in rule.tokens]))
        for prefix in rule.prefixes:
            numbered = F.lit(f"^{prefix}[0-9]+$")
            hit = hit | F.exists(tokens, lambda t: F.regexp_like(t, numbered))  # noqa: B023 (used at once)
        return hit & F.col(scenario).isin(*rule.scenarios) if rule.scenarios else hit

    def result(rule: vocab.TokenRule) -> Column:
        return F.struct(F.lit(rule.family).alias("family"), F.lit(rule.stage).alias("stage"),
                        F.lit(rule.technique).alias("technique"))

    benign = (key == "") | reduce(Column.__or__, [key.contains(w) for w in vocab.BENIGN_WORDS])
    nothing = F.struct(F.lit("Benign").alias("family"), F.lit("Benign").alias("stage"),
                       F.lit(None).cast("string").alias("technique"))
    unknown = F.lit(None)
    if on_unmapped == "error":
        unknown = F.raise_error(F.concat(F.lit("neither botnet, normal nor background: "), F.col(label)))
    is_bot = key.contains(vocab.BOTNET_WORD)
    chain = F.when(~is_bot & benign, nothing).when(~is_bot, unknown.cast(
        "struct<family:string,stage:string,technique:string>"))
    for rule in vocab.TOKEN_RULES:
        chain = chain.when(matches(rule), result(rule))
    hit = chain.otherwise(result(vocab.TOKEN_DEFAULT))
    out = df.withColumn("_tokens", label_tokens(F.col(label))).withColumn("_hit", hit)
    return out.select(*df.columns, "_hit.family", "_hit.stage", "_hit.technique",
                      (F.col("_hit.stage") != "Benign").alias("is_attack"),
                      is_attempted(F.col(label)).alias("attempted"))


def refine_stages(flows: DataFrame, cidrs: Sequence[str]) -> DataFrame:
    """Lateral movement starts inside by definition: an outside source makes it reconnaissance."""
    if not cidrs:
        return flows
    outside = (F.col("stage") == "LateralMovement") & ~in_networks(F.col("src_ip"), cidrs)
    return flows.withColumns({
        "stage": F.when(outside, F.lit("Reconnaissance")).otherwise(F.col("stage")),
        "technique": F.when(outside, F.lit("T1595")).otherwise(F.col("technique")),
    })


def window_labels(flows: DataFrame, series: Sequence[str] = ("capture",)) -> DataFrame:
    """Furthest stage, modal family and attack counts of each occupied window."""
    attack = F.col("is_attack")
    return flows.groupBy(*series, "window").agg(
        F.count(F.lit(1)).cast("int").alias("n_flows"),
        F.count_if(attack).cast("int").alias("n_attack_flows"),
        F.coalesce(F.max(F.when(attack, stage_index(F.col("stage")))), F.lit(0)).cast("tinyint").alias("stage_now"),
        F.mode(F.when(attack, F.col("family")), True).alias("family_now"),
        F.coalesce(F.bool_and(F.when(attack, F.col("attempted"))), F.lit(False)).alias("attempted_only"),
    )
