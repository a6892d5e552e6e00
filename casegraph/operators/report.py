"""Report tables: redaction, timeline, paging, counts, outcome labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions.binding import with_bound
from casegraph.functions.redact import is_sensitive, pseudonymize
from casegraph.functions.text import date_of, date_text, literal_map, rank_of
from casegraph.functions.urls import redact_uri


def _hide(df: DataFrame, columns: list[str], when: Column | None = None) -> DataFrame:
    hidden = {c: pseudonymize(F.col(c)) for c in columns}
    if when is not None:
        hidden = {c: F.when(when, v).otherwise(F.col(c)) for c, v in hidden.items()}
    return df.withColumns(hidden)


def redact_table(name: str, df: DataFrame, redact: bool = True) -> DataFrame:
    """Redaction rule of one report table; tables without a rule pass unchanged."""
    if not redact:
        return df
    if name == "projects":
        return _hide(df, ["root_path"])
    if name == "artifacts":
        return _hide(df.withColumn("source_uri", redact_uri(F.col("source_uri"))).drop("stored_path"), ["original_path"])
    if name == "observations":
        return _hide(df, ["original_value", "normalized_value", "location"], is_sensitive(F.col("category")))
    if name == "evidence":
        return _hide(df, ["value", "location"])
    if name == "entities":
        artifact = F.lower("type") == "artifact"
        sensitive = is_sensitive(F.col("type"))
        return _hide(_hide(df, ["value"], artifact | sensitive), ["normalized_value"], sensitive & ~artifact)
    if name == "findings":
        return _hide(df, ["description"], F.col("sensitive"))
    if name == "discovered_resources":
        return _hide(
            df.withColumns({c: redact_uri(F.col(c)) for c in ("url", "canonical_url")}), ["query"])
    if name == "services":
        return _hide(df, ["host", "banner"])
    if name == "provider_requests":
        return _hide(df, ["query"])
    return df


def timeline(runs: DataFrame, artifacts: DataFrame, observations: DataFrame, redact: bool = False) -> DataFrame:
    """(timestamp, kind, source_id, value) in time order. Ties follow the text of the row; comparing the columns gives
    that order without building the text for every row."""
    event = lambda df, at, kind, value: df.filter(F.col(at).isNotNull()).select(
        F.col(at).cast("timestamp").alias("timestamp"), F.lit(kind).alias("kind"),
        F.col("id").alias("source_id"), value.alias("value"),
    )
    original = F.col("original_value")
    normalized = F.col("normalized_value")
    # the sort below runs all this twice, once for its sample: texts are bound first, so that the parser runs as compiled code
    texts = with_bound(
        observations.filter(F.contains(F.lower("category"), F.lit("date"))).select("id", "original_value", "normalized_value"),
        __first=date_text(normalized), __second=F.when(~original.eqNullSafe(normalized), date_text(original)),
    )
    dated = with_bound(texts, __at=F.coalesce(date_of(F.col("__first")), date_of(F.col("__second"))))
    rows = (
        event(runs, "created_at", "run_created", F.col("command"))
        .unionByName(event(runs, "started_at", "run_started", F.col("command")))
        .unionByName(event(runs, "finished_at", "run_finished", F.col("status")))
        .unionByName(event(artifacts, "acquired_at", "artifact_acquired", F.col("sha256")))
        .unionByName(event(dated, "__at", "metadata_date", pseudonymize(original) if redact else original))
    )
    return rows.orderBy("timestamp", "kind", "source_id", "value")


def findings_min_severity(findings: DataFrame, minimum: str, offset: int = 0, limit: int = 100) -> DataFrame:
    rank = rank_of(F.col("severity"), fv.SEVERITIES)
    chosen = findings.filter(rank >= fv.SEVERITIES[minimum])
    return chosen.orderBy(rank.desc(), "rule_id", "id").offset(offset).limit(limit)


def entities_page(entities: DataFrame, entity_type: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    chosen = entities if entity_type is None else entities.filter(F.col("type") == entity_type.strip().lower())
    return (
        chosen.orderBy("type", "normalized_value", "id").offset(max(offset, 0)).limit(max(limit, 1))
    )


def with_total(page: DataFrame, matching: DataFrame) -> DataFrame:
    """Attach the size of the unpaged result; the joined side is one row."""
    total = matching.agg(F.count(F.lit(1)).alias("total")).withColumn("__one", F.lit(1))
    return page.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one").drop("__one")


def pending_resources(resources: DataFrame) -> DataFrame:
    return resources.filter(F.col("status") == "pending")


def requeue_failed(resources: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return resources.withColumns({
        "status": F.when(failed, "pending").otherwise(F.col("status")),
        "last_error": F.when(~failed, F.col("last_error")),
    })


def project_status(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "id").limit(n)


def scope_list(entries: DataFrame) -> DataFrame:
    return entries.orderBy("kind", "value")


ORDERS = {
    "entities": ["type", "normalized_value"], "observations": ["category", "normalized_value"],
    "relations": ["from_entity_id", "to_entity_id"], "artifacts": ["sha256"], "dns": ["name", "record_type"],
}


def ordered_export(name: str, df: DataFrame) -> DataFrame:
    """Range-partitioned global order; the key itself completes ties so output is stable."""
    keys = ORDERS[name] + [c for c in ("id",) if c in df.columns]
    return df.orderBy(*keys)


def evidence_manifest(artifacts: DataFrame, redact: bool) -> DataFrame:
    return artifacts.select(
        "id", "sha256", "size", "mime_type", F.lit(not redact).alias("included")
    ).orderBy("sha256", "id")


def category_families(observations: DataFrame) -> DataFrame:
    """(family, n) with zero families kept. Counts per category first, so the mapping joins a handful of rows."""
    spark = observations.sparkSession
    pairs = [(f, c) for f, cs in fv.CATEGORY_FAMILIES.items() for c in cs]
    mapping = spark.createDataFrame(pairs, "family string, pattern string")
    counts = observations.groupBy(F.lower("category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    keys = counts.withColumn("pattern", F.explode(F.array(
        F.col("category"), F.when(F.startswith("category", F.lit("history")), F.lit("history*"))
    ))).filter(F.col("pattern").isNotNull())
    summed = keys.join(F.broadcast(mapping), "pattern").groupBy("family").agg(F.sum("n").alias("n"))
    return mapping.select("family").distinct().join(summed, "family", "left").select(
        "family", F.coalesce("n", F.lit(0)).alias("n")
    )


def category_gap(baseline: DataFrame, ours: DataFrame) -> DataFrame:
    """Families with a positive count in the baseline and none in ours."""
    return baseline.filter(F.col("n") > 0).join(
        ours.filter(F.col("n") > 0), "family", "left_anti"
    ).select("family")


def run_outcome(runs: DataFrame, tasks: DataFrame, partial_label: str = "partial_provider_failure") -> DataFrame:
    """Status and coverage label per run from its tasks; any failure means partial, never complete."""
    failures = tasks.groupBy("run_id").agg(F.count_if(F.col("status") == "failed").alias("failures"))
    failed = F.coalesce("failures", F.lit(0)) > 0
    return runs.select(F.col("id").alias("run_id")).join(failures, "run_id", "left").select(
        "run_id", F.coalesce("failures", F.lit(0)).alias("failures"),
        F.when(failed, "partially_failed").otherwise("completed").alias("status"),
        F.when(failed, partial_label).otherwise("complete").alias("coverage_status"),
    )


def distinct_ci(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values after trimming and lower-casing."""
    key = F.lower(F.trim(column))
    return df.select(key.alias(column)).filter(F.col(column) != "").distinct()


def missing_providers(requested: DataFrame, registered: DataFrame) -> DataFrame:
    """Journal rows for requested ids that are not registered."""
    known = registered.select(F.lower("provider_id").alias("k"))
    return (
        requested.withColumn("k", F.lower("provider_id")).join(known, "k", "left_anti")
        .select(
            "provider_id", F.lit("failed").alias("status"), F.lit(1).alias("attempt_count"),
            F.lit(fv.UNKNOWN_PROVIDER).alias("last_error"),
        )
    )


def hash_reputation(artifacts: DataFrame, reputation: DataFrame) -> DataFrame:
    """Every artifact with its reputation row, or found = false."""
    known = reputation.withColumn("found", F.lit(True))
    return artifacts.join(known, "sha256", "left").withColumn("found", F.coalesce("found", F.lit(False)))
