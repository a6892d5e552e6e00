"""HTTP response functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegraph import fixed_values as fv


def classify_outcome(status: Column, body: Column) -> Column:
    preview = F.lower(body)
    challenge = F.lit(False)
    for marker in fv.CHALLENGE_MARKERS:
        challenge = challenge | F.contains(preview, F.lit(marker))
    return (
        F.when(status == 407, "proxy_authentication_required")
        .when(status == 403, "forbidden")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(challenge, "challenge")
        .when((status >= 200) & (status < 400), "success")
        .otherwise("unknown_failure")
    )


def detect_technology(server: Column, powered_by: Column, body: Column) -> Column:
    preview = F.lower(body)
    marked = F
    for marker, name in fv.TECHNOLOGY_MARKERS:
        marked = marked.when(F.contains(preview, F.lit(marker)), F.lit(name))
    return F.coalesce(server, powered_by, marked.otherwise(F.lit(None)))
