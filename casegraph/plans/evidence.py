"""End-to-end flows: local evidence (scan, classify, extract, correlate) and the complete report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.operators import attempts as att
from casegraph.operators import correlate, report
from casegraph.operators.artifacts import magic_kind
from casegraph.operators.observations import valid_observations, with_identity
from casegraph.plans.registry import ExtractorRegistry, default_extractors
from casegraph.session import scratch_path


def stage_by_kind(artifacts: DataFrame, path: str | None = None) -> DataFrame:
    """Classify once and keep the artifacts as a table partitioned by kind, in the shared folder or at `path`. Every
    extractor then reads the files of its own kinds only, instead of scanning and classifying the whole collection again."""
    spark = artifacts.sparkSession
    classified = magic_kind(artifacts)
    path = path or scratch_path(spark, "classified")
    classified.write.mode("overwrite").partitionBy("kind").parquet(path)
    return spark.read.schema(classified.schema).parquet(path)


def extracted(classified: DataFrame, observed_at: Column, registry: ExtractorRegistry | None = None):
    """Classified artifacts -> (valid observations with their ids, diagnostics)."""
    observations, notes = (registry or default_extractors()).extract(classified)
    return with_identity(valid_observations(observations), observed_at), notes


def analyze(artifacts: DataFrame, observed_at: Column, registry: ExtractorRegistry | None = None):
    """artifacts(artifact_id, original_path, size, content) -> (observations, diagnostics).

    Observations feed several correlation jobs, so they too become a table before they are returned."""
    spark = artifacts.sparkSession
    identified, notes = extracted(stage_by_kind(artifacts), observed_at, registry)
    path = scratch_path(spark, "observations")
    identified.write.parquet(path)
    return spark.read.schema(identified.schema).parquet(path), notes


def correlate_project(
    observations: DataFrame, artifacts: DataFrame, runs: DataFrame, project_id: str,
    existing: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    existing = existing or {}
    scoped = correlate.observations_in_project(observations, artifacts, runs, project_id)
    return {
        "entities": correlate.build_entities(scoped, existing.get("entities")),
        "evidence": correlate.build_evidence(scoped, existing.get("evidence")),
        "relations": correlate.build_relations(scoped, existing.get("relations")),
    }


RUN_CHILDREN = ["findings", "dns", "services", "malware", "provider_requests", "network_attempts"]
PROJECT_CHILDREN = ["entities", "relations", "discovered_resources"]


def build_report(tables: dict[str, DataFrame], project_id: str, redact: bool = True) -> dict[str, DataFrame]:
    """Every report table of one project, redacted on request, plus timeline, coverage and endpoint summary."""
    project = tables["projects"].filter(F.col("id") == project_id)
    runs = tables["runs"].filter(F.col("project_id") == project_id)
    artifacts = correlate.project_scoped(tables["artifacts"], runs, "run_id")
    observations = correlate.project_scoped(tables["observations"], artifacts, "artifact_id")
    scoped = {"projects": project, "runs": runs, "artifacts": artifacts, "observations": observations}
    if "evidence" in tables:
        scoped["evidence"] = correlate.project_scoped(tables["evidence"], artifacts, "artifact_id")
    for name in RUN_CHILDREN:
        if name in tables:
            scoped[name] = correlate.project_scoped(tables[name], runs, "run_id")
    for name in PROJECT_CHILDREN:
        if name in tables:
            scoped[name] = tables[name].filter(F.col("project_id") == project_id)
    out = {name: report.redact_table(name, df, redact) for name, df in scoped.items()}
    out["timeline"] = report.timeline(runs, artifacts, observations, redact)
    if "endpoints" in tables:
        out["endpoint_summary"] = att.endpoint_summary(tables["endpoints"])
        if "provider_requests" in scoped and "network_attempts" in scoped:
            out["coverage"] = att.coverage_summary(
                scoped["provider_requests"], scoped["network_attempts"], tables["endpoints"])
    return out
