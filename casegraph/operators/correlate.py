"""Observations -> entities, evidence and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions.ordered import first_wins
from casegraph.functions.text import stable_id


def observations_in_project(
    observations: DataFrame, artifacts: DataFrame, runs: DataFrame, project_id: str
) -> DataFrame:
    """Entity-category observations of one project with their artifact columns. Project and category are
    filtered before the joins; both joins are on unique keys of the right side."""
    wanted = observations.filter(F.lower("category").isin(fv.ENTITY_CATEGORIES))
    in_project = artifacts.join(
        runs.filter(F.col("project_id") == project_id).select(F.col("id").alias("run_id")), "run_id", "left_semi"
    ).select(
        F.col("id").alias("artifact_id"), "sha256",
        F.coalesce("original_path", "source_uri", "sha256").alias("artifact_name"), "acquired_at",
    )
    return wanted.join(in_project, "artifact_id").withColumn("project_id", F.lit(project_id))


def build_entities(scoped: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New entity rows: one per (category, normalized value) and one artifact node per content hash.

    Both keys go through one partial aggregation: the observation stream is read and shuffled once."""
    columns = ["type", "value", "normalized_value", "confidence"]
    keyed = scoped.select(
        "project_id", "observed_at", F.col("id").alias("observation_id"),
        F.explode(F.array(
            F.struct(
                F.col("category").alias("type"), F.col("original_value").alias("value"), F.col("normalized_value"),
                F.col("confidence").cast("double").alias("confidence")),
            F.struct(
                F.lit("artifact").alias("type"), F.col("artifact_name").alias("value"),
                F.col("sha256").alias("normalized_value"), F.lit(1.0).alias("confidence")),
        )).alias("e"),
    ).select("project_id", "observed_at", "observation_id", "e.*")
    entities = first_wins(keyed, ["project_id", "type", "normalized_value"], ["observed_at", "observation_id"])
    entities = entities.select(
        stable_id(F.col("project_id"), F.col("type"), F.col("normalized_value")).alias("id"), "project_id", *columns
    )
    if existing is not None:
        entities = entities.join(
            existing.select("project_id", "type", "normalized_value"), ["project_id", "type", "normalized_value"],
            "left_anti",
        ).select("id", "project_id", *columns)
    return entities


def build_evidence(scoped: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One evidence row per observation that has none."""
    if existing is not None:
        scoped = scoped.join(
            existing.select(F.col("observation_id").alias("id")), "id", "left_anti"
        )
    return scoped.select(
        stable_id(F.lit("evidence"), F.col("id")).alias("id"), "artifact_id", F.col("id").alias("observation_id"),
        F.col("extractor").alias("source"), F.col("original_value").alias("value"), "location",
        F.col("sha256").alias("artifact_sha256"), F.col("observed_at").alias("collected_at"),
    )


def build_relations(scoped: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One `contains` edge per (artifact node, entity) with the first observation's evidence.

    Node ids are functions of the natural keys, so no join to the entity table is needed."""
    edges = scoped.select(
        "project_id",
        stable_id(F.col("project_id"), F.lit("artifact"), F.col("sha256")).alias("from_entity_id"),
        stable_id(F.col("project_id"), F.col("category"), F.col("normalized_value")).alias("to_entity_id"),
        F.lit("contains").alias("type"), "observed_at", F.col("id").alias("observation_id"),
        F.col("confidence").cast("double").alias("confidence"),
    )
    keys = ["project_id", "from_entity_id", "to_entity_id", "type"]
    edges = first_wins(edges, keys, ["observed_at", "observation_id"])
    if existing is not None:
        edges = edges.join(existing.select(*keys), keys, "left_anti")
    return edges.select(
        stable_id(F.col("from_entity_id"), F.col("to_entity_id"), F.col("type")).alias("id"), *keys,
        stable_id(F.lit("evidence"), F.col("observation_id")).alias("evidence_id"), "confidence",
    )


def unanalyzed_artifacts(artifacts: DataFrame, observations: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Artifacts without observations and, when `attempts` (artifact_id) is given, without a finished analysis: one that
    held nothing is not analyzed again."""
    done = observations.select(F.col("artifact_id").alias("id"))
    if attempts is not None:
        done = done.unionByName(attempts.select(F.col("artifact_id").alias("id")))
    return artifacts.join(done, "id", "left_anti")


def project_scoped(child: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows of a child table whose parent is in scope."""
    return child.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(child.columns)


def new_resources(results: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """First result per canonical URL (case ignored over the whole URL) that is not known yet."""
    keyed = results.withColumn("url_key", F.lower("canonical_url")).filter(F.col("url_key").isNotNull())
    first = first_wins(keyed, ["url_key"], order)
    return first.join(
        known.select(F.lower("canonical_url").alias("url_key")), "url_key", "left_anti"
    ).drop("url_key")
