"""Table schemas (Spark DDL). Inputs are always read with one of these, never inferred."""

from pyspark.sql import types as T

PROJECTS = "id STRING, name STRING, root_path STRING, default_mode STRING, created_at TIMESTAMP"
SCOPE_ENTRIES = "id STRING, project_id STRING, value STRING, kind STRING, maximum_mode STRING, created_at TIMESTAMP"
RUNS = (
    "id STRING, project_id STRING, command STRING, mode STRING, status STRING, coverage_status STRING, "
    "created_at TIMESTAMP, started_at TIMESTAMP, finished_at TIMESTAMP"
)
ARTIFACTS = (
    "id STRING, run_id STRING, source_uri STRING, original_path STRING, stored_path STRING, sha256 STRING, "
    "size BIGINT, mime_type STRING, kind STRING, acquired_at TIMESTAMP"
)
OBSERVATIONS = (
    "id STRING, artifact_id STRING, category STRING, original_value STRING, normalized_value STRING, "
    "extractor STRING, extractor_version STRING, location STRING, confidence DOUBLE, observed_at TIMESTAMP"
)
DIAGNOSTICS = "artifact_id STRING, code STRING, message STRING, is_error BOOLEAN"
IMPORTED_URLS = "url STRING, title STRING, snippet STRING"
CRAWL_INDEX = "urlkey STRING, timestamp STRING, url STRING, mime STRING, status STRING"
ENDPOINT_RECORDS = "uri STRING, secret_ref STRING, weight INT, tags ARRAY<STRING>"

# Shapes returned by Python helpers are type objects, so that modules load before a session exists.
XML_NODES = T.ArrayType(T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("parent_property", T.StringType()), T.StructField("parent_label", T.StringType()),
    T.StructField("attribute", T.StringType()),
    T.StructField("value", T.StringType()),
]))
CONTAINER_ENTRIES = T.ArrayType(T.StructType([
    T.StructField("entry_no", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("compressed_size", T.LongType()), T.StructField("xml", T.BinaryType()),
]))
HAR = "log STRUCT<entries: ARRAY<STRUCT<request: STRUCT<url: STRING>>>>"
SEARCH_JSON = "results ARRAY<STRUCT<url: STRING, title: STRING, content: STRING>>"
HOST_DOCUMENT = (
    "ip_str STRING, org STRING, isp STRING, asn STRING, os STRING, last_update STRING, country_code STRING, "
    "country_name STRING, city STRING, region_code STRING, latitude DOUBLE, longitude DOUBLE, "
    "ports ARRAY<INT>, hostnames ARRAY<STRING>, domains ARRAY<STRING>, tags ARRAY<STRING>, cpe ARRAY<STRING>, "
    "vulns STRING, data ARRAY<STRUCT<port: INT, transport: STRING, product: STRING, version: STRING, "
    "timestamp: STRING, hash: BIGINT, ssl: STRING, hostnames: ARRAY<STRING>, cpe: ARRAY<STRING>, data: STRING>>"
)
FILE_DOCUMENT = (
    "data STRUCT<id: STRING, type: STRING, attributes: STRUCT<sha256: STRING, sha1: STRING, md5: STRING, "
    "size: BIGINT, type_description: STRING, meaningful_name: STRING, reputation: INT, last_analysis_date: BIGINT, "
    "last_submission_date: BIGINT, times_submitted: BIGINT, last_analysis_stats: STRUCT<malicious: INT, "
    "suspicious: INT, undetected: INT, harmless: INT, timeout: INT>>>"
)
