"""Techniques, countermeasures and stage cards from flattened knowledge tables.

``objects``: one row per STIX object. ``mappings(technique, id, tactic, name, ord)``: which
countermeasures the published mapping lists for a technique, in input order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom import vocab

_URL = "https://attack.mitre.org/techniques/"


def _external(field: str):
    refs = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return F.try_element_at(refs, F.lit(1))[field]


def live_objects(objects: DataFrame, kind: str) -> DataFrame:
    """Objects of a type with their external id; revoked and deprecated ones dropped, ids kept once.

    Other types go first: relationships are most of a bundle, and an id names its type.
    """
    flag = [~F.coalesce(F.col(c), F.lit(False)) for c in ("revoked", "x_mitre_deprecated")]
    first_line = F.element_at(F.split(F.coalesce("description", F.lit("")), "\n"), 1)
    return objects.filter(flag[0] & flag[1] & (F.col("type") == kind)).select(
        "id", _external("external_id").alias("external_id"), _external("url").alias("url"), "name",
        first_line.alias("description")).dropDuplicates(["id"])


def tactics(objects: DataFrame) -> DataFrame:
    return live_objects(objects, "x-mitre-tactic").select("external_id", "name", "url", "description")


def techniques(objects: DataFrame) -> DataFrame:
    return live_objects(objects, "attack-pattern").select(
        "external_id", "name", "url", "description", F.col("id").alias("stix_id"))


def mitigations(objects: DataFrame) -> DataFrame:
    """(technique, mitigation) pairs through "mitigates" relationships, each once."""
    links = objects.filter("type = 'relationship' and relationship_type = 'mitigates'").select(
        "source_ref", "target_ref")
    source = live_objects(objects, "course-of-action").filter("external_id like 'M%'").select(
        F.col("id").alias("source_ref"), F.col("external_id").alias("mitigation"), F.col("name").alias("mitigation_name"))
    target = techniques(objects).select(F.col("stix_id").alias("target_ref"), F.col("external_id").alias("technique"))
    order = W.partitionBy("mitigation").orderBy("mitigation_name", "source_ref")
    source = source.withColumn("_nth", F.row_number().over(order))
    # Objects are hashed and relationships pass by unsorted; a pair carries the number of its first name, which joins last.
    pairs = (links.join(target.hint("shuffle_hash"), "target_ref")
             .join(source.select("source_ref", "mitigation", "_nth").hint("shuffle_hash"), "source_ref")
             .groupBy("technique", "mitigation").agg(F.min("_nth").alias("_nth")))
    names = source.select("mitigation", "_nth", "mitigation_name")
    return pairs.join(names.hint("shuffle_hash"), ["mitigation", "_nth"], "left").select("technique", "mitigation", "mitigation_name")


def technique_lookup(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Technique details, with a placeholder for unknown ids."""
    t = F.col("technique")
    return wanted.select("technique").join(known, t == F.col("external_id"), "left").select(
        "technique", F.coalesce("name", t).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("url", F.concat(F.lit(_URL), t, F.lit("/"))).alias("url"))


def catalogue(mappings: DataFrame) -> DataFrame:
    """First entry of every countermeasure id over all mappings."""
    order = W.partitionBy("id").orderBy("ord")
    return mappings.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("id", "tactic", "name")


def _curated(spark: SparkSession) -> DataFrame:
    rows = [(t, i, n) for t, ids in vocab.CURATED_COUNTERMEASURES.items() for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "technique string, id string, ord bigint")


def countermeasures(wanted: DataFrame, mappings: DataFrame, limit: int = 4) -> DataFrame:
    """Ranked countermeasures per technique: one per tactic first, then the rest, at most ``limit``.

    Techniques without a mapping fall back to the curated list, resolved through the catalogue.
    """
    spark = wanted.sparkSession
    want = wanted.select("technique").distinct()
    mapped = mappings.join(want, "technique", "left_semi").select(
        "technique", "id", "tactic", "name", "ord", F.lit(False).alias("curated"))
    missing = want.join(mappings.select("technique").distinct(), "technique", "left_anti")
    fallback = (F.broadcast(_curated(spark)).join(missing, "technique").join(catalogue(mappings), "id")
                .select("technique", "id", "tactic", "name", "ord", F.lit(True).alias("curated")))
    preference = F.create_map(*[F.lit(x) for i, d in enumerate(vocab.COUNTERMEASURE_PREFERENCE) for x in (d, i)])
    tactic_rank = F.create_map(*[F.lit(x) for kv in vocab.TACTIC_ORDER.items() for x in kv])
    every = mapped.unionByName(fallback).withColumns({
        "_pref": F.coalesce(preference[F.col("id")], F.lit(99)),
        "_tac": F.coalesce(tactic_rank[F.col("tactic")], F.lit(9)),
    })
    rank = ("_pref", "_tac", "ord")
    in_tactic = F.row_number().over(W.partitionBy("technique", "tactic").orderBy(*rank))
    picked = every.withColumn("_again", (in_tactic > 1).cast("int"))
    order = W.partitionBy("technique").orderBy("_again", *rank)
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "technique", "rank", "id", "tactic", "name", "curated")


def stage_techniques(spark: SparkSession) -> DataFrame:
    rows = [(s, vocab.STAGES.index(s), vocab.STAGE_ATTACK_ID[vocab.STAGES.index(s)], t, i)
            for s, ts in vocab.STAGE_TECHNIQUES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "stage string, stage_no int, tactic_id string, technique string, ord int")


def stage_cards(spark: SparkSession, tactic_table: DataFrame, known: DataFrame, mappings: DataFrame) -> DataFrame:
    """One nested row per stage: tactic, techniques and their countermeasures."""
    pairs = stage_techniques(spark)
    details = technique_lookup(pairs.select("technique").distinct(), known)
    measures = countermeasures(pairs, mappings).groupBy("technique").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "tactic", "name", "curated"))).alias("countermeasures"))
    rows = (pairs.join(details, "technique").join(measures, "technique", "left")
            .join(tactic_table.select(F.col("external_id").alias("tactic_id"), F.col("name").alias("tactic_name"),
                                      F.col("url").alias("tactic_url")), "tactic_id", "left"))
    cards = rows.groupBy("stage", "stage_no", "tactic_id").agg(
        F.coalesce(F.first("tactic_name", True), F.first("stage")).alias("tactic_name"),
        F.first("tactic_url", True).alias("tactic_url"),
        F.array_sort(F.collect_list(F.struct("ord", "technique", F.col("name"), "countermeasures"))).alias("techniques"))
    return cards


def common_countermeasures(pairs: DataFrame, measures: DataFrame, top: int = 5) -> DataFrame:
    """Countermeasures shared by the most techniques of a stage: the top-k report."""
    counted = pairs.join(measures, "technique").groupBy("stage", "id").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("stage").orderBy(F.desc("n"), "id")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
