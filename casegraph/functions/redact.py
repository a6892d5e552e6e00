"""Pseudonyms and diagnostic cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions.urls import bare_uri


def pseudonymize(value: Column) -> Column:
    """`[redacted:<16 hex>]`; NULL and the empty string pass through."""
    return F.when(value == "", value).otherwise(
        F.concat(F.lit("[redacted:"), F.substring(F.sha2(value, 256), 1, 16), F.lit("]"))
    )


def is_sensitive(category: Column) -> Column:
    return F.lower(category).isin(fv.SENSITIVE_CATEGORIES)


def sanitize_diagnostic(message: Column, limit: int | None = None) -> Column:
    """Strip credentials, query and fragment of every URL in a message; a `limit` bounds its length."""
    urls = F.array_sort(
        F.array_distinct(F.regexp_extract_all(message, F.lit(fv.DIAGNOSTIC_URL), F.lit(0))),
        lambda a, b: F.length(b) - F.length(a),
    )

    def clean(url: Column) -> Column:
        bare = F.rtrim(url, F.lit(".,;)"))
        return F.when(bare.rlike(r"(?i)^https?://[^/?#\s]"), bare_uri(bare)).otherwise(F.lit("[redacted-uri]"))

    text = F.when(
        F.contains(F.lower(message), F.lit("://")),
        F.aggregate(urls, message, lambda acc, url: F.replace(acc, url, clean(url))),
    ).otherwise(message)
    if limit is None:
        return text
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit(" [truncated]")))


def csv_safe(value: Column) -> Column:
    """Neutralize a leading spreadsheet formula character."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(F.coalesce(value, F.lit("")))
