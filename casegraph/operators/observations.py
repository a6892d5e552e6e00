"""Shared shape of extraction results and the rules applied to every extractor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegraph.functions.ordered import first_wins
from casegraph.functions.text import normalize_value, not_blank, stable_id

COLUMNS = [
    "artifact_id", "category", "original_value", "normalized_value", "extractor", "extractor_version",
    "location", "confidence", "position",
]


def observation_rows(
    df: DataFrame, extractor: str, order: list[str], keys: list[str] | None = None, ascii_only: bool = False
) -> DataFrame:
    """Finish (artifact_id, category, value, location, confidence, <order>) rows: drop blanks, normalize,
    and when `keys` is given keep the first row per (artifact, keys). `position` holds the order columns: it tells rows
    apart that are equal in everything else."""
    rows = (
        df.filter(not_blank(F.col("category")) & not_blank(F.col("value")))
        .withColumn("normalized_value", normalize_value(F.col("category"), F.col("value"), ascii_only))
        .withColumnRenamed("value", "original_value")
        .withColumn("extractor", F.lit(extractor))
        .withColumn("extractor_version", F.lit("1.0.0"))
        .withColumn("position", F.concat_ws(",", *[F.col(c).cast("string") for c in order]))
        .select(*COLUMNS, *order)
    )
    if keys:
        rows = first_wins(rows, ["artifact_id", *keys], order)
    return rows.select(*COLUMNS)


def with_identity(observations: DataFrame, observed_at: Column) -> DataFrame:
    """Deterministic id, one per observation, and observation time."""
    return observations.withColumn(
        "id", stable_id(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS])
    ).withColumn("observed_at", observed_at)


def valid_observations(observations: DataFrame) -> DataFrame:
    return observations.filter(
        not_blank(F.col("category")) & not_blank(F.col("original_value")) & F.col("confidence").between(0.0, 1.0)
    )


def match_caps(matches: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """At most `limit` rows per group in document order. The rank filter is pushed below the shuffle as a
    group limit, so no task receives more than `limit` rows per group and sender."""
    window = W.partitionBy(*group).orderBy(*order)
    return matches.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= limit).drop("__rank")


def cumulative_budget(
    df: DataFrame, group: list[str], order: list[str], size: str, budget: int, within_budget: str = "within_budget"
) -> DataFrame:
    """Running total per group and whether it still fits. Groups are single containers, whose entry count
    is bounded by what one file holds."""
    window = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("running_size", F.sum(size).over(window)).withColumn(
        within_budget, F.col("running_size") <= budget
    )


def size_budget(artifacts: DataFrame, maximum: int, code: str, message: str) -> tuple[DataFrame, DataFrame]:
    """Split on the size column before the content is touched; the rejected side becomes diagnostics."""
    fits = artifacts.filter(F.col("size") <= maximum)
    rejected = diagnostics(artifacts.filter(F.col("size") > maximum), code, F.lit(message), True)
    return fits, rejected


def diagnostics(df: DataFrame, code: str, message: Column, is_error: bool) -> DataFrame:
    return df.select(
        "artifact_id", F.lit(code).alias("code"), message.alias("message"), F.lit(is_error).alias("is_error")
    )


def extraction_diagnostics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code", "is_error").agg(F.count(F.lit(1)).alias("n"))
