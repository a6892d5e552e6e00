"""File readers. All use fixed schemas; unusable rows become diagnostics or are dropped, never an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph import schemas
from casegraph.functions import urls
from casegraph.functions.binding import with_bound
from casegraph.functions.text import literal_map, stable_id, trim_ws
from casegraph.operators.correlate import new_resources
from casegraph.operators.discovery import extract_links
from casegraph.operators.observations import diagnostics
from casegraph.sources.ranged import file_digests, list_files, reachable


def scan_artifacts(
    spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None,
    max_bytes: int | None = None, max_files: int | None = None, content: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(artifacts with content, diagnostics of files over a byte budget, when one is given).

    The budget is a filter on the listed length, so oversized files are never read. `max_files` keeps the first paths:
    they are chosen from a listing without content, and only those files are read. Without `content`, files are listed and
    hashed by tasks: the driver holds no listing, and a file may be larger than a row; where only Spark can open the store,
    its reader reads each file as a row."""
    by_rows = content or not reachable(path)
    if by_rows:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        files = reader.load(path)
    else:
        files = list_files(spark, path, recursive, pattern)
    if max_files:
        files = files.join(files.select("path").orderBy("path").limit(max_files), "path", "left_semi")
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    rejected = files.filter(~fits).select(stable_id(F.col("path")).alias("artifact_id"), F.col("path"))
    read = files.filter(fits).withColumn("sha256", F.sha2("content", 256)) if by_rows else file_digests(files.filter(fits))
    kept = read.select(
        stable_id(F.col("path")).alias("artifact_id"), F.col("path").alias("original_path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("acquired_at"), "sha256", *["content"] * content,
    )
    return kept, diagnostics(
        rejected, "artifact.size_budget", F.concat(F.lit("File exceeds the byte budget: "), F.col("path")), True)


def import_urls_text(spark: SparkSession, path: str) -> DataFrame:
    line = trim_ws(F.col("value"))
    none = F.lit(None).cast("string")
    return (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.explode(F.split("value", "\r")).alias("value")).select(line.alias("url"))
        .filter((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
        .select("url", none.alias("title"), none.alias("snippet"))
    )


def import_urls_csv(spark: SparkSession, path: str) -> DataFrame:
    """One record per physical line, quotes doubled; any line whose first field is `url` is a header."""
    return (
        spark.read.schema(schemas.IMPORTED_URLS)
        .csv(path, quote='"', escape='"', multiLine=False, ignoreLeadingWhiteSpace=True,
             ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=True)
        .select(*[trim_ws(F.col(c)).alias(c) for c in ("url", "title", "snippet")])
        .filter((F.col("url") != "") & (F.lower("url") != "url"))
    )


def import_urls_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return url_json_rows(spark.read.text(path, wholetext=True))


def url_json_rows(documents: DataFrame) -> DataFrame:
    """(value) documents: array, or object with `results`; items are strings or objects with a string `url`."""
    doc = documents.select(F.try_parse_json("value").alias("doc")).filter("doc IS NOT NULL")
    items = F.coalesce(
        F.try_variant_get("doc", "$.results", "array<variant>"), F.try_variant_get("doc", "$", "array<variant>")
    )
    item = doc.select(F.explode(items).alias("i"))
    text = lambda name: F.when(
        F.schema_of_variant(F.variant_get("i", f"$.{name}", "variant")) == "STRING",
        F.try_variant_get("i", f"$.{name}", "string"))
    kind = F.schema_of_variant("i")
    return item.select(
        F.when(kind == "STRING", F.try_variant_get("i", "$", "string")).otherwise(text("url")).alias("url"),
        F.when(kind != "STRING", text("title")).alias("title"),
        F.when(kind != "STRING", text("snippet")).alias("snippet"),
    ).filter(F.col("url").isNotNull())


def import_urls_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(schemas.IMPORTED_URLS).json(path, mode="PERMISSIVE")
        .filter(F.col("url").isNotNull())
    )


def import_urls_har(spark: SparkSession, path: str) -> DataFrame:
    return url_har_rows(spark.read.text(path, wholetext=True))


def url_har_rows(documents: DataFrame) -> DataFrame:
    """(value) HAR documents -> request URLs."""
    none = F.lit(None).cast("string")
    return (
        documents.select(F.from_json("value", schemas.HAR).alias("h"))
        .select(F.explode("h.log.entries").alias("e")).select(F.col("e.request.url").alias("url"))
        .filter(F.col("url").isNotNull())
        .select("url", none.alias("title"), none.alias("snippet"))
    )


URL_READERS = {
    "text": import_urls_text, "txt": import_urls_text, "csv": import_urls_csv, "json": import_urls_json,
    "ndjson": import_urls_ndjson, "jsonl": import_urls_ndjson, "har": import_urls_har,
}


def import_discovery(
    spark: SparkSession, sources: list[tuple[str, str]], known: DataFrame, maximum: int | None = None
) -> DataFrame:
    """(path, format) sources -> new resources: canonical, first source wins, known URLs dropped.

    `maximum` keeps the first raw values of each source, in the order of their text, before any filter."""
    parts = []
    for number, (path, fmt) in enumerate(sources):
        if fmt not in URL_READERS:
            raise ValueError(f"unsupported discovery import format: {fmt}")
        values = URL_READERS[fmt](spark, path)
        if maximum:
            values = values.orderBy("url", "title", "snippet").limit(max(1, maximum))
        parts.append(values.withColumns({
            "source_no": F.lit(number), "provider_id": F.lit(f"import:{fmt}"),
            "query": F.lit(path.rstrip("/").rsplit("/", 1)[-1]),
        }))
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    rows = urls.with_canonical_url(values.filter(urls.is_http(F.col("url"))), "url", "canonical_url")
    return new_resources(rows, known, ["source_no", "url", "title"]).drop("source_no")


def import_url_index(spark: SparkSession, path: str, target: str, types: list[str], maximum: int | None = None) -> DataFrame:
    """Offline index of plain or NDJSON lines, kept when host and extension fit."""
    value = trim_ws(F.col("value"))
    is_json = F.startswith(value, F.lit("{"))
    field = lambda name: F.when(is_json, F.get_json_object(value, f"$.{name}"))
    rows = (
        spark.read.text(path).filter((value != "") & ~F.startswith(value, F.lit("#")))
        .select(F.when(is_json, field("url")).otherwise(value).alias("raw"), field("title").alias("title"),
                field("snippet").alias("snippet"))
    )
    u = F.col("raw")
    kept = rows.filter(
        urls.is_http(u) & urls.below_host(urls.host(u), F.lit(target)) & urls.has_file_type(urls.path(u), types)
    ).select(urls.absolute_uri(u).alias("url"), "title", "snippet")
    return kept.orderBy("url", "title", "snippet").limit(maximum) if maximum else kept


def import_crawl_index(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """CDX JSON lines: status 200, wanted extension, first capture per urlkey."""
    from casegraph.functions.ordered import first_wins

    rows = spark.read.schema(schemas.CRAWL_INDEX).json(path)
    wanted = rows.filter((F.col("status") == "200") & F.col("url").rlike("(" + "|".join(rf"\.{t}$" for t in types) + ")"))
    return first_wins(wanted, ["urlkey"], ["timestamp", "url"])


def import_search_json(spark: SparkSession, path: str, per_file: int | None = None) -> DataFrame:
    return search_json_rows(spark.read.text(path, wholetext=True), per_file)


def search_json_rows(documents: DataFrame, per_file: int | None = None) -> DataFrame:
    """(value) saved JSON result documents -> (url, title, snippet)."""
    results = F.from_json("value", schemas.SEARCH_JSON)["results"]
    if per_file:
        results = F.slice(results, 1, per_file)
    return (
        documents.select(F.explode(results).alias("r"))
        .select(F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.col("r.content").alias("snippet"))
        .filter(F.col("url").isNotNull())
    )


def import_search_pages(pages: DataFrame, target: str, types: list[str]) -> DataFrame:
    """Saved HTML result pages (url, html): links with the redirect parameter unwrapped, then host and type filters."""
    links = extract_links(pages)
    wrapped = F.regexp_extract(urls.query(F.col("url")), r"[?&]uddg=([^&]*)", 1)
    target_url = F.when(wrapped != "", F.coalesce(F.try_url_decode(wrapped), F.col("url"))).otherwise(F.col("url"))
    u = F.col("target_url")
    return (
        with_bound(links, target_url=urls.absolute_uri(target_url))
        .filter(urls.below_host(urls.host(u), F.lit(target)) & urls.has_file_type(urls.path(u), types))
        .select(u.alias("url"), F.col("text").alias("title"))
    )


def read_endpoint_records(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(uri, secret_ref, weight, tags) of a text, CSV, JSON or NDJSON endpoint list."""
    if fmt == "json":
        return spark.read.schema(schemas.ENDPOINT_RECORDS).json(path, multiLine=True)
    line = trim_ws(F.col("value"))
    lines = spark.read.text(path).filter((line != "") & ~F.startswith(line, F.lit("#"))).select(line.alias("value"))
    if fmt in ("ndjson", "jsonl"):
        record = F.from_json("value", schemas.ENDPOINT_RECORDS)
        return lines.select(F.inline(F.array(F.coalesce(record, F.from_json(F.lit("{}"), schemas.ENDPOINT_RECORDS)))))
    fields = F.split("value", ",") if fmt == "csv" else F.array("value")
    item = lambda i: trim_ws(F.try_element_at(fields, F.lit(i)))
    return lines.select(
        item(1).alias("uri"), item(2).alias("secret_ref"), item(3).try_cast("int").alias("weight"),
        F.array().cast("array<string>").alias("tags"),
    )


def import_endpoints(records: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted endpoints, diagnostics of rejected records). URIs already in the pool are skipped."""
    uri = F.col("uri")
    sch = urls.scheme(uri)
    protocol = literal_map({k: v[0] for k, v in fv.ENDPOINT_SCHEMES.items()})[sch]
    dns_mode = literal_map({k: v[1] for k, v in fv.ENDPOINT_SCHEMES.items()})[sch]
    checked = records.withColumn(
        "problem",
        F.when(uri.isNull() | ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]"), "endpoint.invalid_uri")
        .when(urls.user_info(uri) != "", "endpoint.inline_credentials")
        .when(protocol.isNull(), "endpoint.unsupported_scheme"),
    )
    accepted = checked.filter(F.col("problem").isNull()).select(
        "uri", protocol.alias("protocol"), dns_mode.alias("dns_mode"), "secret_ref",
        F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).alias("weight"), "tags",
    )
    if known is not None:
        accepted = accepted.join(known.select("uri"), "uri", "left_anti").select(accepted.columns)
    rejected = checked.filter(F.col("problem").isNotNull()).select(
        stable_id(F.coalesce(uri, F.lit(""))).alias("artifact_id"), F.col("problem").alias("code"),
        # the rejected text may hold credentials, so only its scheme is repeated
        F.concat(F.lit("Rejected endpoint with scheme "), F.coalesce(sch, F.lit("?"))).alias("message"),
        F.lit(True).alias("is_error"),
    )
    return accepted, rejected
