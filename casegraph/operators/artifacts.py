"""Artifact-level operators: kind, duplicates, entropy, static risk, embedded images, PDF information."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import fixed_values as fv
from casegraph.functions.binding import explode_rows, let, with_bound
from casegraph.functions.ordered import first_wins
from casegraph.functions.text import extension_kind, extension_of, literal_map, not_blank
from casegraph.operators.containers import INVALID, container_entries, zip_kind
from casegraph.operators import sweep, swept
from casegraph.operators.observations import observation_rows


def dedup_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per content hash: the earliest sighting."""
    return first_wins(artifacts, ["sha256"], ["acquired_at", "original_path"])


def magic_kind(artifacts: DataFrame) -> DataFrame:
    """Add (kind, mime_type) from leading bytes, container members, then the original file extension."""
    head = F.substring("content", 1, 512)
    lead = F.hex(F.substring("content", 1, 16))
    kind, mime = F, F
    for magic, magic_kind_name, magic_mime in fv.MAGIC_NUMBERS:
        kind = kind.when(F.startswith(lead, F.lit(magic)), F.lit(magic_kind_name))
        mime = mime.when(F.startswith(lead, F.lit(magic)), F.lit(magic_mime))
    zip_like = F.startswith(lead, F.lit(fv.ZIP_MAGIC[0])) | F.startswith(lead, F.lit(fv.ZIP_MAGIC[1]))
    sample = F.lower(F.decode(head, "ISO-8859-1"))
    svg = F.contains(sample, F.lit("<svg"))
    ext = extension_of(F.col("original_path"))
    by_ext_kind = literal_map({k: v[0] for k, v in fv.FALLBACK_EXTENSIONS.items()})[ext]
    by_ext_mime = literal_map({k: v[1] for k, v in fv.FALLBACK_EXTENSIONS.items()})[ext]
    marked = F.lit(False)
    for mark in fv.BYTE_ORDER_MARKS:
        marked = marked | F.startswith(lead, F.lit(mark))
    text = marked | ~sample.rlike(r"\x00") & (
        F.regexp_count(sample, F.lit(r"[\x01-\x08\x0e-\x1f]")) <= F.floor(F.length(head) / 20)
    )
    # one narrow pass: only the bytes of ZIP-like rows travel to Python
    rows = artifacts.withColumn("__zip", zip_kind(F.when(zip_like, F.col("content"))))
    container = F.col("__zip")
    return rows.withColumns({
        "kind": F.coalesce(
            container,
            kind.when(svg, "svg").when(by_ext_kind.isNotNull(), by_ext_kind).when(text, "text").otherwise("unknown")),
        "mime_type": F.coalesce(
            F.when(container.isNotNull(), F.coalesce(literal_map(fv.CONTAINER_MIME_TYPES)[container], F.lit("application/octet-stream"))),
            mime.when(svg, "image/svg+xml").when(by_ext_mime.isNotNull(), by_ext_mime).when(text, "text/plain")
            .otherwise("application/octet-stream")),
    }).drop("__zip")


@F.pandas_udf(T.DoubleType())
def byte_entropy(contents: pd.Series) -> pd.Series:
    """Shannon entropy of the byte histogram, one vectorized count per content."""

    def one(content):
        if not content:
            return 0.0
        counts = np.bincount(np.frombuffer(content, dtype=np.uint8), minlength=256)
        share = counts[counts > 0] / len(content)
        return float(-(share * np.log2(share)).sum())

    return contents.map(one)


def _risk_patterns() -> list[sweep.Pattern]:
    return [sweep.anchored(fv.URL, "http://", "https://"), sweep.anchored("(?i)ddeauto", "ddeauto")]


def static_risk(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, original_path, size, sha256, kind, content) -> (artifact_id, kind, value, severity) rows.

    Row-level rules are built in one pass and exploded; markers and URLs come from one sweep of the content; only
    containers are opened."""
    row = lambda kind, value, severity: F.struct(
        F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(severity).alias("severity")
    )
    expected = extension_kind(F.col("original_path"))
    rules = F.concat(
        F.array(
            row("sha256", F.col("sha256"), "informational"),
            row("entropy", F.format_string("%.4f", F.col("__entropy")), "informational"),
            F.when(expected != F.col("kind"), row(
                "mime_mismatch",
                F.concat(F.lit(fv.MIME_MISMATCH[0]), expected, F.lit(fv.MIME_MISMATCH[1]), F.col("kind")),
                "medium")),
            F.when(F.startswith(F.hex(F.substring("content", 1, 2)), F.lit("4D5A")),
                   row("embedded_executable", F.lit("MZ header"), "high")),
            F.when(F.exists("__hits", lambda h: h["pattern_no"] == 1), row("dde", F.lit("DDEAUTO marker"), "high")),
        ),
        F.transform(F.filter("__hits", lambda h: h["pattern_no"] == 0), lambda h: row("url", h["value"], "informational")),
    )
    marked = artifacts.withColumns({"__entropy": byte_entropy("content"), "__hits": swept.binary_hits(_risk_patterns, wide=False)(F.col("content"))})
    base = explode_rows(marked, rules, "r", "artifact_id").select("artifact_id", "r.*")
    return base.unionByName(container_risk(artifacts))


def container_risk(artifacts: DataFrame) -> DataFrame:
    return entry_risk(container_entries(artifacts.filter(F.col("kind").isin("open_xml", "open_document", "zip"))))


def entry_risk(entries: DataFrame) -> DataFrame:
    """Risk rows of container entries, however they were read."""
    low = F.lower("name")
    flag = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    flags = F.when(
        F.col("entry_no") == INVALID, F.array(flag("container_error", "medium"))
    ).otherwise(F.array(
        F.when(F.endswith(low, F.lit("vbaproject.bin")), flag("macro", "high")),
        F.when(F.contains(low, F.lit("macros/")) | F.contains(low, F.lit("wordbasic")), flag("macro", "high")),
        F.when(F.endswith(low, F.lit(".exe")) | F.endswith(low, F.lit(".dll")), flag("embedded_executable", "high")),
        F.when(F.contains(low, F.lit("embeddings/")) | F.contains(low, F.lit("oleobject")),
               flag("embedded_object", "medium")),
    ))
    return (
        explode_rows(entries, flags, "f", "artifact_id", "entry_no", "name")
        .select(
            "artifact_id", F.col("f.kind").alias("kind"),
            F.when(F.col("entry_no") == INVALID, fv.CONTAINER_ERROR).otherwise(F.col("name")).alias("value"),
            F.col("f.severity").alias("severity"),
        )
    )


def embedded_images(artifacts: DataFrame, extractor: str = "builtin.indesign", location: str = "indesign") -> DataFrame:
    """Complete JPEG and PNG spans inside a content, as `format:length`."""
    images = explode_rows(artifacts, swept.image_spans("content"), "image", "artifact_id", position="image_no")
    rows = images.select(
        "artifact_id", F.lit("embedded_image").alias("category"),
        F.concat("image.format", F.lit(":"), F.col("image.size").cast("string")).alias("value"),
        F.concat(F.lit(f"{location}/image:"), F.col("image_no").cast("string")).alias("location"),
        F.lit(1.0).alias("confidence"), "image_no",
    )
    return observation_rows(rows, extractor, ["image_no"], ascii_only=True)


# White space and comments, then a literal or hexadecimal string. Nested unescaped parentheses are not read.
_PDF_GAP = r"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*+"
_PDF_STRING = r"(\([^()\\]*+(?:\\[\s\S][^()\\]*+)*+\)|<[0-9A-Fa-f\s]*+>)?"
_PDF_NAME_CHAR = r"[^\x00\t\n\f\r /<>\[\]()]"


def _pdf_string(token: Column) -> Column:
    """Decode one PDF string token."""
    body = F.substr(token, F.lit(2), F.length(token) - 2)
    literal = F.regexp_replace(body, r"\\\r\n|\\\r|\\\n", "")
    for code, char in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f")):
        literal = F.regexp_replace(literal, rf"(?<!\\)((?:\\\\)*)\\{code}", f"$1{char}")
    octal = F.array_distinct(F.regexp_extract_all(literal, F.lit(r"\\([0-7]{1,3})"), F.lit(1)))
    literal = F.aggregate(
        F.array_sort(octal, lambda a, b: F.length(b) - F.length(a)), literal,
        lambda acc, digits: F.replace(
            acc, F.concat(F.lit("\\"), digits), F.chr(F.conv(digits, 8, 10).cast("int") % 256)),
    )
    literal = F.regexp_replace(literal, r"\\([\s\S])", "$1")
    digits = F.regexp_replace(body, r"\s", "")
    digits = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    raw = F.when(F.startswith(token, F.lit("<")), F.upper(digits)).otherwise(F.hex(F.encode(literal, "ISO-8859-1")))
    return let(raw, lambda r: F.rtrim(
        F.when(F.startswith(r, F.lit("FEFF")), _utf16_hex(F.substr(r, F.lit(5))))
        .when(F.startswith(r, F.lit("FFFE")), _utf16_hex(F.regexp_replace(F.substr(r, F.lit(5)), "(..)(..)", "$2$1")))
        .otherwise(F.decode(F.unhex(r), "ISO-8859-1")),
        F.lit("\x00"),
    ))


def _utf16_hex(digits: Column) -> Column:
    """Text of big-endian UTF-16 in hex; lone surrogates become the replacement character."""

    def sound(units: Column) -> Column:
        return F.transform(units, lambda u, i: F.when(
            (u.rlike("^D[89AB]") & ~F.coalesce(F.get(units, i + 1).rlike("^D[C-F]"), F.lit(False)))
            | (u.rlike("^D[C-F]") & ~F.coalesce(F.get(units, i - 1).rlike("^D[89AB]"), F.lit(False))),
            F.lit("FFFD"),
        ).otherwise(u))

    return let(
        F.regexp_extract_all(digits, F.lit("(.{4})"), F.lit(1)),
        lambda units: F.decode(F.unhex(F.array_join(sound(units), "")), "UTF-16BE"),
    )


#: (key, category, location, what may not follow, confidence) in the order of precedence.
_PDF_KEYS = [(k, c, f"pdf/info/{k}", rf"(?!{_PDF_NAME_CHAR})", 1.0) for k, c in fv.PDF_INFO_KEYS.items()]
_PDF_KEYS += [(k, c, f"pdf/filespec/{k}", "", 0.85) for k, c in fv.PDF_FILE_KEYS.items()]


def _pdf_patterns() -> list[sweep.Pattern]:
    """A key's name, then perhaps a string: the string is the value."""
    return [sweep.anchored(f"/{key}{guard}{_PDF_GAP}{_PDF_STRING}", f"/{key}", group=1) for key, _, _, guard, _ in _PDF_KEYS]


def pdf_info(artifacts: DataFrame) -> DataFrame:
    """Info dictionary and file-specification strings of uncompressed PDF objects, all keys in one sweep. Info keys number
    from the second occurrence on, file-specification keys always."""
    pdfs = artifacts.filter(F.startswith(F.hex(F.substring("content", 1, 5)), F.lit("255044462D")))
    hits = swept.binary_hits(_pdf_patterns, wide=False, fold=False)(F.col("content"))
    tokens = explode_rows(pdfs, hits, "h", "artifact_id").select(
        "artifact_id", F.col("h.pattern_no").alias("key_no"), F.col("h.match_no").alias("occurrence"), F.col("h.value").alias("token")
    ).filter(F.col("token") != "")
    of_key = lambda values: F.get(F.array(*map(F.lit, values)), F.col("key_no"))
    place = of_key([k[2] for k in _PDF_KEYS])
    plain = of_key([bool(k[3]) for k in _PDF_KEYS]) & (F.col("occurrence") == 0)
    rows = with_bound(tokens, value=let(F.col("token"), _pdf_string)).filter(not_blank(F.col("value"))).select(
        "artifact_id", "key_no", "occurrence", "value", of_key([k[1] for k in _PDF_KEYS]).alias("category"),
        F.when(plain, place).otherwise(F.concat(place, F.lit(":"), F.col("occurrence").cast("string"))).alias("location"),
        of_key([k[4] for k in _PDF_KEYS]).alias("confidence"))
    return observation_rows(
        rows, "builtin.pdf", ["key_no", "occurrence"], ["category", "normalized_value", "location"]
    )
