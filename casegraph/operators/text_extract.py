"""Observations from text and from printable strings inside binaries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import fixed_values as fv
from casegraph.functions.binding import explode_rows, with_bound
from casegraph.functions.ordered import match_array
from casegraph.functions.text import html_decode, map_text_key, map_xmp_property, trim_ws
from casegraph.operators import sweep, swept
from casegraph.operators.observations import observation_rows

LINE_BREAK = r"\r\n|\n|\r"


def _lines(texts: DataFrame, markers: list[str]) -> DataFrame:
    """(artifact_id, line, line_no) of the lines that can match."""
    return (
        explode_rows(texts, F.split("text", LINE_BREAK), "line", "artifact_id", position="i")
        .filter(_has_any(F.col("line"), markers))
        .select("artifact_id", "line", (F.col("i") + 1).alias("line_no"))
    )


def _has_any(line: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for marker in markers:
        out = out | F.contains(line, F.lit(marker))
    return out


def text_key_values(texts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """`key=value` / `key:value` lines; the first separator splits, credentials are masked."""
    separator = r"(?s)^([^=:]+)[=:](.+)$"
    candidates = texts.filter(F.col("text").rlike("[=:]"))
    rows = (
        _lines(candidates, ["=", ":"])
        .transform(lambda lines: with_bound(
            lines, key=trim_ws(F.regexp_extract("line", separator, 1)), raw=trim_ws(F.regexp_extract("line", separator, 2))))
        .filter((F.col("raw") != "") & F.col("line").rlike(separator))
        .withColumn("category", map_text_key(F.col("key")))
        .select(
            "artifact_id", "category",
            F.when(F.col("category") == "credential_indicator", "[redacted]").otherwise(F.col("raw")).alias("value"),
            F.concat(F.lit("line:"), F.col("line_no").cast("string")).alias("location"),
            F.lit(1.0).alias("confidence"), "line_no",
        )
    )
    return observation_rows(rows, "builtin.text", ["line_no"], ["category", "normalized_value"], ascii_only)


def text_emails(texts: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Guarded e-mail addresses per line; texts without `@` never reach the pattern."""
    rows = (
        explode_rows(
            _lines(texts.filter(F.contains("text", F.lit("@"))), ["@"]), match_array(F.col("line"), fv.EMAIL), "value",
            "artifact_id", "line_no", position="match_no",
        )
        .withColumns({
            "category": F.lit("email"), "confidence": F.lit(0.9),
            "location": F.concat(F.lit("line:"), F.col("line_no").cast("string")),
        })
    )
    return observation_rows(
        rows, "builtin.text", ["line_no", "match_no"], ["category", "normalized_value"], ascii_only
    )


def _decoded(content: bytes | None, encoding: str) -> str | None:
    """Broken units become the replacement character."""
    return None if content is None else bytes(content).decode(encoding, errors="replace")


@F.pandas_udf(T.StringType())
def wide_text(contents: pd.Series) -> pd.Series:
    """Text of UTF-16 or UTF-32 bytes, told apart by their byte order mark, which goes."""
    return contents.map(lambda b: _decoded(b, "utf-32" if b is not None and bytes(b[:4]) in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff") else "utf-16"))


def _scan(artifacts: DataFrame, patterns: Callable[[], list[sweep.Pattern]], limit: int | None = None) -> DataFrame:
    """All hits of all patterns in both readings of each content as rows, one pass a reading; a `limit` holds per reading
    and pattern."""
    hits = swept.binary_hits(patterns, limit)(F.col("content"))
    return explode_rows(artifacts, hits, "h", "artifact_id").select("artifact_id", "h.*")


def _string_patterns() -> list[sweep.Pattern]:
    return [
        sweep.email(guarded=True), sweep.anchored(fv.UNC_PATH, "\\\\"), sweep.anchored(fv.URL, "http://", "https://"),
        sweep.anchored(fv.WINDOWS_PATH, ":\\", back=1), sweep.loose_element("dc", "xmp", "pdf", "photoshop"),
    ]


def binary_strings(artifacts: DataFrame, limit: int | None = None) -> DataFrame:
    """E-mails, UNC paths and their hosts, URLs, Windows paths and their users, XMP properties."""
    hits = _scan(artifacts, _string_patterns, limit)
    v = F.col("value")
    field = lambda category, value, location, confidence: F.struct(
        F.lit(category).alias("category") if isinstance(category, str) else category.alias("category"),
        value.alias("value"),
        (F.lit(location) if isinstance(location, str) else location).alias("location"),
        F.lit(confidence).alias("confidence"),
    )
    unc_host = F.substring_index(F.ltrim(v, F.lit("\\")), "\\", 1)
    user = F.regexp_extract(v, fv.USER_IN_PATH, 1)
    prop = F.regexp_extract(v, fv.XMP_STRING, 1)
    found = (
        F.when(F.col("pattern_no") == 0, F.array(field("email", v, "binary/string", 0.7)))
        .when(F.col("pattern_no") == 1, F.array(
            field("unc_path", v, "binary/string", 0.7), field("hostname", unc_host, "binary/unc-host", 0.75)))
        .when(F.col("pattern_no") == 2, F.array(field("url", v, "binary/string", 0.7)))
        .when(F.col("pattern_no") == 3, F.array(
            field("path", v, "binary/path", 0.65), field("username", user, "binary/path-user", 0.7)))
        .otherwise(F.array(field(
            map_xmp_property(prop, fv.XMP_STRING_PROPERTIES),
            html_decode(F.regexp_extract(v, fv.XMP_STRING, 2)),
            F.concat(F.lit("binary/xmp/"), prop), 0.9)))
    )
    rows = explode_rows(hits, found, "o", "artifact_id", "pass_no", "pattern_no", "match_no", position="part")
    rows = rows.select("artifact_id", "pass_no", "pattern_no", "match_no", "part", "o.*")
    return observation_rows(
        rows, "builtin.binary-strings", ["pass_no", "pattern_no", "match_no", "part"], ["category", "normalized_value"]
    )


INDICATORS = [("email", 0.75), ("url", 0.75), ("path", 0.72), ("printer", 0.7), ("application", 0.68)]


def _indicator_patterns() -> list[sweep.Pattern]:
    return [
        sweep.email(guarded=False), sweep.anchored(fv.INDICATOR_URL, "http://", "https://", "ftp://", "ldap://"),
        _indicator_path(), sweep.anchored(fv.INDICATOR_PRINTER, "winspool", "printer", "printto"),
        sweep.anchored(
            fv.INDICATOR_APPLICATION, "adobe", "acrobat", "indesign", "libreoffice", "openoffice", "microsoft word",
            "microsoft excel", "microsoft powerpoint", "corel wordperfect"),
    ]


def _indicator_path() -> sweep.Pattern:
    """A path starts at two backslashes, or at the letter before a colon and a backslash."""
    drive, share = sweep.anchored(fv.INDICATOR_PATH, back=1), sweep.anchored(fv.INDICATOR_PATH)

    def on(text: str) -> sweep.Check:
        at_drive, at_share = drive.on(text), share.on(text)
        return lambda at, done: (at_drive if text[at] == ":" else at_share)(at, done)

    return sweep.Pattern((":\\", "\\\\"), on)


def legacy_indicators(
    artifacts: DataFrame, extractor: str = "builtin.legacy", location: str = "legacy/binary",
    limit: int | None = None,
) -> DataFrame:
    """Indicator phrases in both readings; first wins per (category, normalized value, location)."""
    hits = _scan(artifacts, _indicator_patterns, limit)
    categories = F.array(*[F.lit(c) for c, _ in INDICATORS])
    confidences = F.array(*[F.lit(c) for _, c in INDICATORS])
    rows = hits.select(
        "artifact_id", "pass_no", "pattern_no", "match_no",
        categories[F.col("pattern_no")].alias("category"),
        F.btrim("value", F.lit("\x00 \r\n\t")).alias("value"),
        F.lit(location).alias("location"),
        confidences[F.col("pattern_no")].alias("confidence"),
    )
    return observation_rows(
        rows, extractor, ["pass_no", "pattern_no", "match_no"], ["category", "normalized_value", "location"]
    )


def loose_xmp(texts: DataFrame, extractor: str = "builtin.pdf", location: str = "pdf/raw") -> DataFrame:
    """Namespaced properties outside well-formed XML; each gives its mapped and its raw category."""
    hits = explode_rows(texts, swept.loose_properties("text"), "h", "artifact_id").select("artifact_id", "h.*")
    pick = lambda group: F.when(
        F.col("pattern_no") == 0, F.regexp_extract("value", fv.LOOSE_XMP_ELEMENT, group)
    ).otherwise(F.regexp_extract("value", fv.LOOSE_XMP_ATTRIBUTE, group))
    prop = F.col("property")
    rows = (
        with_bound(hits, property=pick(1), text=trim_ws(html_decode(pick(2))))
        .filter(F.char_length("text") > 0)
        .select(
            "artifact_id", "pattern_no", "match_no", F.col("text").alias("value"),
            F.concat(
                F.lit(f"{location}/loose-xmp/"), F.when(F.col("pattern_no") == 0, "element").otherwise("attribute"),
                F.lit(":"), prop,
            ).alias("location"),
            F.posexplode(F.array(
                F.struct(map_xmp_property(prop).alias("category"), F.lit(0.78).alias("confidence")),
                F.struct(F.concat(F.lit("xmp."), F.lower(prop)).alias("category"), F.lit(0.75).alias("confidence")),
            )).alias("part", "o"),
        )
        .select("artifact_id", "pattern_no", "match_no", "part", "value", "location", "o.*")
    )
    return observation_rows(rows, extractor, ["pattern_no", "match_no", "part"])
