"""How the given tables stand in for the engine's tables, in Spark and in SQL.

Every stand-in is a projection of a whole table: no sampling, no constants-only rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions import urls
from casegraph.functions.net import v4_text
from casegraph.functions.text import stable_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL fragments


def host_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1))"


def path_sql(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


def escape_sql(text: str) -> str:
    return (
        "array_to_string(list_transform(regexp_extract_all(" + text + ", '[^\\x21-\\x7e]+|[\\x21-\\x7e]+'), "
        "lambda r: CASE WHEN regexp_matches(r, '^[^\\x21-\\x7e]') THEN regexp_replace(hex(encode(r)), '(..)', '%\\1', 'g') "
        "ELSE r END), '')"
    )


def canonical_sql(u: str) -> str:
    """Canonical URL of the URLs that occur here: no user-info, no dot segments."""
    return (
        f"(lower(regexp_extract({u}, '^([A-Za-z]+)://', 1)) || '://' || "
        f"regexp_replace({host_sql(u)}, CASE WHEN lower({u}) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') || "
        f"CASE WHEN {path_sql(u)} = '' THEN '/' ELSE {escape_sql(path_sql(u))} END || "
        f"{escape_sql(f'''regexp_extract({u}, '^[^?#]*([?][^#]*)', 1)''')})"
    )


def id_sql(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(1), {', '.join(parts)})), 1, 32)"


def pseudonym_sql(v: str) -> str:
    return f"CASE WHEN {v} = '' THEN {v} ELSE '[redacted:' || substr(sha256({v}), 1, 16) || ']' END"


# ---------------------------------------------------------------- attempts (events)

ATTEMPTS_SQL = """
attempts AS (
  SELECT event_id AS id, user_id AS endpoint_id, ts AS attempted_at, value AS duration_ms, event_type,
         CASE WHEN event_type <> 'error' THEN 'success' WHEN value >= 10 THEN 'rate_limited' ELSE 'cancelled' END AS outcome
  FROM events)
"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as attempts: `error` fails (rotating when the value is high), everything else succeeds."""
    return attempt_columns(table(spark, sf_dir, "events"))


def attempt_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("endpoint_id"), F.col("ts").alias("attempted_at"),
        F.col("value").alias("duration_ms"), "event_type",
        F.when(F.col("event_type") != "error", "success").when(F.col("value") >= 10, "rate_limited")
        .otherwise("cancelled").alias("outcome"),
    )


# ---------------------------------------------------------------- endpoints (customer) and pools (nation)

SCHEMES = {
    "AUTOMOBILE": "http", "BUILDING": "https", "FURNITURE": "socks4", "HOUSEHOLD": "socks5", "MACHINERY": "socks5h",
}
STATUSES = {
    "AUTOMOBILE": "healthy", "BUILDING": "cooldown", "FURNITURE": "degraded", "HOUSEHOLD": "quarantined",
    "MACHINERY": "unknown",
}
_case = lambda m: "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
PROTOCOLS = {"http": "http", "https": "https_connect", "socks4": "socks4", "socks5": "socks5", "socks5h": "socks5_host"}

ENDPOINTS_SQL = f"""
endpoints AS (
  SELECT c_custkey AS id, c_nationkey AS pool_id,
         {_case(SCHEMES)} || '://ep' || c_custkey || '.example.net:8080' AS uri,
         CASE {_case(SCHEMES)} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PROTOCOLS.items())} END AS protocol,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'remote' ELSE 'local' END AS dns_mode,
         {_case(STATUSES)} AS status,
         CASE WHEN c_acctbal > 5000 THEN 'vault/' || c_custkey END AS secret_ref,
         CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS success_count,
         CAST(c_nationkey AS BIGINT) AS failure_count,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS ewma_latency_ms,
         CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-01-15 00:00:00' END AS cooldown_until
  FROM customer),
pools AS (SELECT n_nationkey AS id, n_name AS name FROM nation)
"""


def _pick(column: str, mapping: dict[str, str]) -> Column:
    out = F
    for key, value in mapping.items():
        out = out.when(F.col(column) == key, F.lit(value))
    return out.otherwise(F.lit(None))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = _pick("c_mktsegment", SCHEMES)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pool_id"),
        F.concat(scheme, F.lit("://ep"), F.col("c_custkey").cast("string"), F.lit(".example.net:8080")).alias("uri"),
        _pick("c_mktsegment", {k: PROTOCOLS[v] for k, v in SCHEMES.items()}).alias("protocol"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "remote").otherwise("local").alias("dns_mode"),
        _pick("c_mktsegment", STATUSES).alias("status"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("vault/"), F.col("c_custkey").cast("string"))).alias("secret_ref"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("long").alias("success_count"),
        F.col("c_nationkey").cast("long").alias("failure_count"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("ewma_latency_ms"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("cooldown_until"),
    )


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


# ---------------------------------------------------------------- pages as resources, artifacts, observations

PAGES_SQL = f"""
page_artifacts AS (
  SELECT 'page-' || page_id AS id, 'run-' || regexp_extract(url, '^([a-z]+):', 1) AS run_id, url AS source_uri,
         CASE WHEN url LIKE '%.html%' THEN '/captures/' || page_id || '.html' END AS original_path, sha256(html) AS sha256,
         CAST(strlen(html) AS BIGINT) AS size, page_id
  FROM pages),
page_runs AS (
  SELECT DISTINCT 'run-' || regexp_extract(url, '^([a-z]+):', 1) AS id,
         'project-' || regexp_extract(url, '^([a-z]+):', 1) AS project_id FROM pages),
raw_observations AS (
  SELECT page_id, 'hostname' AS category, upper({host_sql('url')}) AS original_value, {host_sql('url')} AS normalized_value,
         'uri/host' AS location, 0.75 AS confidence FROM pages
  UNION ALL SELECT page_id, 'url', url, lower({canonical_sql('url')}), 'uri', 0.7 FROM pages
  UNION ALL SELECT page_id, 'application', 'Template ' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1),
         'Template ' || regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), NULL, 0.68 FROM pages
  UNION ALL SELECT page_id, 'title', regexp_extract(html, '<title>([^<]*)</title>', 1),
         regexp_extract(html, '<title>([^<]*)</title>', 1), 'html/title', 1.0 FROM pages),
page_observations AS (
  SELECT {id_sql("'page-' || page_id", 'category', 'normalized_value')} AS id, 'page-' || page_id AS artifact_id,
         category, original_value, normalized_value, 'builtin.page' AS extractor, location,
         CAST(confidence AS DOUBLE) AS confidence, page_id AS observed_at
  FROM raw_observations),
scoped AS (
  SELECT o.*, r.project_id, a.sha256, coalesce(a.original_path, a.source_uri, a.sha256) AS artifact_name
  FROM page_observations o JOIN page_artifacts a ON o.artifact_id = a.id JOIN page_runs r ON a.run_id = r.id
  WHERE r.project_id = 'project-https' AND o.category IN ('hostname', 'url', 'application')),
entities AS (
  SELECT {id_sql('project_id', 'type', 'normalized_value')} AS id, project_id, type, value, normalized_value, confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, type, normalized_value ORDER BY observed_at, oid) AS rn
        FROM (SELECT project_id, category AS type, original_value AS value, normalized_value, confidence, observed_at, id AS oid FROM scoped
              UNION ALL SELECT project_id, 'artifact', artifact_name, sha256, 1.0, observed_at, id FROM scoped))
  WHERE rn = 1),
relations AS (
  SELECT {id_sql('from_entity_id', 'to_entity_id', "'contains'")} AS id, project_id, from_entity_id, to_entity_id,
         'contains' AS type, {id_sql("'evidence'", 'oid')} AS evidence_id, confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, from_entity_id, to_entity_id ORDER BY observed_at, oid) AS rn
        FROM (SELECT project_id, {id_sql('project_id', "'artifact'", 'sha256')} AS from_entity_id,
                     {id_sql('project_id', 'category', 'normalized_value')} AS to_entity_id, confidence, observed_at, id AS oid
              FROM scoped))
  WHERE rn = 1)
"""


def page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.concat(F.lit("run-"), urls.scheme(url)).alias("run_id"), url.alias("source_uri"),
        F.when(F.contains(url, F.lit(".html")), F.concat(F.lit("/captures/"), F.col("page_id").cast("string"), F.lit(".html")))
        .alias("original_path"),
        F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"),
        F.col("page_id").alias("acquired_at"),
    )


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = urls.scheme(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("run-"), scheme).alias("id"), F.concat(F.lit("project-"), scheme).alias("project_id")
    ).distinct()


def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    host = urls.host(url)
    lang = F.concat(F.lit("Template "), F.regexp_extract(url, "^[a-z]+://[^/]+/([a-z]+)/", 1))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    row = lambda category, original, normalized, location, confidence: F.struct(
        F.lit(category).alias("category"), original.alias("original_value"), normalized.alias("normalized_value"),
        F.lit(location).cast("string").alias("location"), F.lit(confidence).alias("confidence"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(
        row("hostname", F.upper(host), host, "uri/host", 0.75),
        row("url", url, F.lower(urls.canonical_url(url)), "uri", 0.7),
        row("application", lang, lang, None, 0.68),
        row("title", title, title, "html/title", 1.0),
    )).alias("o")).select("page_id", "o.*")
    artifact = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    return rows.select(
        stable_id(artifact, F.col("category"), F.col("normalized_value")).alias("id"), artifact.alias("artifact_id"),
        "category", "original_value", "normalized_value", F.lit("builtin.page").alias("extractor"), "location",
        "confidence", F.col("page_id").alias("observed_at"),
    )


# ---------------------------------------------------------------- addresses (customer) and networks (supplier)

FIRST = [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8, 1, 11, 126, 128, 168, 171, 173, 191, 193, 197, 199, 202, 223]
SECOND = [0, 2, 16, 18, 19, 31, 32, 51, 63, 64, 100, 127, 168, 254, 255]
THIRD = [0, 2, 100, 113, 1]

ADDRESSES_SQL = f"""
addresses AS (
  SELECT c_custkey, CAST({FIRST}[c_nationkey + 1] AS VARCHAR) || '.' || {SECOND}[c_custkey % 15 + 1] || '.' ||
         {THIRD}[CAST(c_custkey / 3 AS BIGINT) % 5 + 1] || '.' || (c_custkey % 256) AS address
  FROM customer),
numbers AS (
  SELECT c_custkey, address, CAST(split_part(address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(address, '.', 2) AS BIGINT) * 65536
       + CAST(split_part(address, '.', 3) AS BIGINT) * 256 + CAST(split_part(address, '.', 4) AS BIGINT) AS n
  FROM addresses)
"""
ADDRESSES_SQL = ADDRESSES_SQL.replace("CAST(c_custkey / 3 AS BIGINT)", "(c_custkey // 3)")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, index: F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int")).cast("string")
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(
        ".", pick(FIRST, F.col("c_nationkey")), pick(SECOND, key % 15), pick(THIRD, F.floor(key / 3) % 5),
        (key % 256).cast("string"),
    ).alias("address"))


V4_SQL = lambda n: f"(({n}) >> 24) || '.' || ((({n}) >> 16) & 255) || '.' || ((({n}) >> 8) & 255) || '.' || (({n}) & 255)"
NETWORKS_SQL = f"""
networks AS (
  SELECT s_suppkey, s_nationkey + 4 AS prefix, (s_suppkey * 2654435761) % 4294967296 AS base,
         {V4_SQL('(s_suppkey * 2654435761) % 4294967296')} || '/' || (s_nationkey + 4) AS cidr
  FROM supplier)
"""


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes of length 4 to 28 spread over the address space."""
    base = (F.col("s_suppkey") * 2654435761) % 4294967296
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(v4_text(base), F.lit("/"), (F.col("s_nationkey") + 4).cast("string")).alias("cidr"))


# ---------------------------------------------------------------- runs (orders) and tasks (lineitem)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("project_id"),
        F.col("o_orderpriority").alias("command"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


# ---------------------------------------------------------------- files


def write_files(df: DataFrame, folder: str) -> None:
    """One file per row of (name, content binary) below a folder of the shared store, dealt out to 256 folders: no folder,
    and so no task that lists one, holds them all."""

    def written(batches):
        import zlib

        from casegraph.sources.ranged import opened

        system, path = opened(folder)
        made = set()
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                own = f"{path}/{zlib.crc32(name.encode()) & 255:02x}"
                if own not in made:
                    system.create_dir(own)
                    made.add(own)
                with system.open_output_stream(f"{own}/{name}") as file:
                    file.write(bytes(content))
            yield batch[["name"]]

    df.select("name", "content").mapInPandas(written, "name string").write.format("noop").mode("overwrite").save()
