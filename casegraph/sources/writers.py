"""Sinks: distributed writes, one folder per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions.redact import csv_safe, pseudonymize
from casegraph.operators.report import ordered_export


def csv_view(name: str, df: DataFrame, redact: bool = True) -> DataFrame:
    """Text columns of one CSV table in export order, values hidden and formulas neutralized."""
    ordered = ordered_export(name, df)
    cells = []
    for column in fv.CSV_COLUMNS[name]:
        text: Column = F.coalesce(F.col(column).cast("string"), F.lit(""))
        if redact and column in fv.CSV_HIDDEN[name]:
            text = pseudonymize(text)
        cells.append(csv_safe(text).alias(column))
    return ordered.select(*cells)


def sink_csv_tables(tables: dict[str, DataFrame], path: str, redact: bool = True) -> dict[str, str]:
    written = {}
    for name in fv.CSV_COLUMNS:
        written[name] = f"{path}/{name}"
        csv_view(name, tables[name], redact).write.mode("overwrite").csv(
            written[name], header=True, quoteAll=True, escape='"', emptyValue="")
    return written


def sink_report_tables(report: dict[str, DataFrame], path: str) -> dict[str, str]:
    written = {}
    for name, df in report.items():
        written[name] = f"{path}/{name}"
        df.write.mode("overwrite").option("ignoreNullFields", "true").json(written[name])
    return written


def ndjson_envelope(df: DataFrame, run_id: Column, coverage: Column, data: list[str] | None = None) -> DataFrame:
    """One `{schema_version, success, data, errors, run_id, coverage}` line per row; nulls are left out."""
    return df.select(
        F.to_json(F.struct(
            F.lit("1").alias("schema_version"), F.lit(True).alias("success"),
            F.struct(*[F.col(c) for c in data or df.columns]).alias("data"), F.array().cast("array<string>").alias("errors"),
            run_id.alias("run_id"), coverage.alias("coverage"),
        )).alias("value")
    )


def sink_ndjson_envelope(df: DataFrame, path: str, run_id: Column, coverage: Column) -> None:
    ndjson_envelope(df, run_id, coverage).write.mode("overwrite").text(path)


def sink_graph(lines: DataFrame, path: str) -> None:
    """Graph text in file order: the lines are range-sorted, so part files concatenate to the document."""
    lines.select("line").write.mode("overwrite").text(path)
