"""Scope decisions, filters and redaction over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions import urls
from casegraph.operators import observations as obs
from casegraph.operators import report, scope
from casegraph.operators.correlate import build_entities, observations_in_project
from casegraph.operators.discovery import target_filetype_filter
from queries.registry import query
from queries.standins import (
    ADDRESSES_SQL, ENDPOINTS_SQL, FIRST, NETWORKS_SQL, PAGES_SQL, SECOND, V4_SQL, addresses, canonical_sql, endpoints, host_sql, networks,
    page_artifacts, page_observations, page_runs, path_sql, pools, pseudonym_sql, runs, table,
)

# Scope entries from page hosts: `blog.` hosts by name, `m.` hosts through their parent domain, `www.` hosts only
# passively, https folders as URL prefixes; networks come from the supplier table.
ENTRIES_SQL = f"""
entries AS (
  SELECT DISTINCT CASE WHEN h LIKE 'm.%' THEN 'domain' ELSE 'host' END AS kind,
         CASE WHEN h LIKE 'm.%' THEN substr(h, 3) ELSE h END AS value,
         CASE WHEN h LIKE 'www.%' THEN 0 WHEN h LIKE 'm.%' THEN 2 ELSE 1 END AS max_rank
  FROM (SELECT {host_sql('url')} AS h FROM pages) WHERE h LIKE 'blog.%' OR h LIKE 'm.%' OR h LIKE 'www.%'),
prefixes AS (
  SELECT DISTINCT regexp_extract(url, '^(https://[^/]+/en)/', 1) AS value FROM pages WHERE regexp_matches(url, '^https://th[^/]+/en/'))
"""


def scope_entries(spark, d):
    pages = table(spark, d, "pages")
    h = urls.host(F.col("url"))
    mobile, www = F.startswith(h, F.lit("m.")), F.startswith(h, F.lit("www."))
    names = pages.filter(mobile | www | F.startswith(h, F.lit("blog."))).select(
        F.when(mobile, "domain").otherwise("host").alias("kind"),
        F.when(mobile, F.substr(h, F.lit(3))).otherwise(h).alias("value"),
        F.when(www, "passive").when(mobile, "aggressive").otherwise("active").alias("maximum_mode"),
    ).distinct()
    prefix = F.regexp_extract("url", "^(https://[^/]+/en)/", 1)
    folders = pages.filter(F.col("url").rlike("^https://th[^/]+/en/")).select(
        F.lit("url").alias("kind"), prefix.alias("value"), F.lit("active").alias("maximum_mode")).distinct()
    nets = networks(spark, d).select(F.lit("cidr").alias("kind"), F.col("cidr").alias("value"), F.lit("active").alias("maximum_mode"))
    return names.unionByName(folders).unionByName(nets)


REQUESTS_SQL = f"""
requests AS (
  SELECT 'page-' || page_id AS id, url FROM pages
  UNION ALL SELECT 'evil-' || page_id, replace(url, '/en/', '/en-evil/') FROM pages
  UNION ALL SELECT 'ftp-' || page_id, 'ftp' || regexp_extract(url, '^https?(.*)$', 1) FROM pages
  UNION ALL SELECT 'ip-' || c_custkey, 'https://' || address || '/' FROM addresses)
"""


def scope_requests(spark, d):
    pages = table(spark, d, "pages")
    tag = lambda t: F.concat(F.lit(t), F.col("page_id").cast("string")).alias("id")
    return (
        pages.select(tag("page-"), "url")
        .unionByName(pages.select(tag("evil-"), F.replace("url", F.lit("/en/"), F.lit("/en-evil/")).alias("url")))
        .unionByName(pages.select(tag("ftp-"), F.regexp_replace("url", "^https?", "ftp").alias("url")))
        .unionByName(addresses(spark, d).select(
            F.concat(F.lit("ip-"), F.col("c_custkey").cast("string")).alias("id"),
            F.concat(F.lit("https://"), F.col("address"), F.lit("/")).alias("url")))
    )


import ipaddress  # noqa: E402

from casegraph import fixed_values as fv  # noqa: E402

PUBLIC_SQL = " AND ".join(
    f"NOT n BETWEEN {int(ipaddress.ip_network(p).network_address)} AND {int(ipaddress.ip_network(p).broadcast_address)}"
    for p in fv.NON_PUBLIC_V4)
NON_PUBLIC_SQL = ", ".join(
    f"({int(ipaddress.ip_network(p).network_address)}, {int(ipaddress.ip_network(p).broadcast_address)})" for p in fv.NON_PUBLIC_V4)
PREFIX_HIT = f"""(regexp_extract(q.url, '^([a-z]+://[^/]+)', 1) = regexp_extract(p.value, '^([a-z]+://[^/]+)', 1)
  AND ({path_sql('q.url')} = '/en' OR starts_with({path_sql('q.url')}, '/en/')))"""


@query("scope_filter", f"""
WITH {ADDRESSES_SQL}, {NETWORKS_SQL}, {ENTRIES_SQL}, {REQUESTS_SQL}
SELECT id, url FROM requests q WHERE url LIKE 'http%' AND id NOT LIKE 'ip-%' AND (
  EXISTS (SELECT 1 FROM entries e WHERE max_rank >= 1 AND ({host_sql('q.url')} = e.value OR (e.kind = 'domain' AND ends_with({host_sql('q.url')}, '.' || e.value))))
  OR EXISTS (SELECT 1 FROM prefixes p WHERE {PREFIX_HIT}))
UNION ALL
SELECT 'ip-' || c_custkey, 'https://' || address || '/' FROM numbers WHERE {PUBLIC_SQL}
  AND EXISTS (SELECT 1 FROM networks WHERE (n >> (32 - prefix)) = (base >> (32 - prefix)))""")
def scope_filter(spark, d):
    return scope.scope_filter(scope_requests(spark, d), scope_entries(spark, d), "active").select("id", "url")


@query("scope_url_prefix", f"""
WITH {ADDRESSES_SQL}, {ENTRIES_SQL}, {REQUESTS_SQL}
SELECT id, url FROM requests q WHERE EXISTS (SELECT 1 FROM prefixes p WHERE {PREFIX_HIT})""")
def scope_url_prefix(spark, d):
    return scope.scope_url_prefix(scope_requests(spark, d), scope_entries(spark, d)).select("id", "url")


# DNS answers: every page gives its host one address.
DNS_SQL = f"""
dns AS (
  SELECT {host_sql('url')} AS name, page_id, CAST({FIRST}[page_id % 25 + 1] AS VARCHAR) || '.' || {SECOND}[page_id % 15 + 1] || '.9.' || (page_id % 256) AS value,
         CAST({FIRST}[page_id % 25 + 1] AS BIGINT) * 16777216 + {SECOND}[page_id % 15 + 1] * 65536 + 9 * 256 + page_id % 256 AS n FROM pages)
"""


def dns_answers(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % n + 1).cast("int")).cast("string")
    return table(spark, d, "pages").select(
        urls.host(F.col("url")).alias("name"), F.lit("A").alias("record_type"),
        F.concat_ws(".", pick(FIRST, 25), pick(SECOND, 15), F.lit("9"), (F.col("page_id") % 256).cast("string")).alias("value"))


@query("resolved_scope", f"""
WITH {DNS_SQL}, good AS (SELECT name FROM dns GROUP BY name HAVING bool_and({PUBLIC_SQL}))
SELECT page_id, url FROM pages WHERE {host_sql('url')} IN (SELECT name FROM good)""")
def resolved_scope(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    with_user = pages.select("page_id", F.replace("url", F.lit("://"), F.lit("://u@")).alias("url"))
    return scope.resolved_scope(pages.unionByName(with_user), dns_answers(spark, d))


@query("resolved_scope_policy", f"""
WITH {ADDRESSES_SQL}, {DNS_SQL}, {ENTRIES_SQL}, good AS (SELECT name FROM dns GROUP BY name HAVING bool_and({PUBLIC_SQL}))
SELECT page_id, url FROM pages q WHERE {host_sql('url')} IN (SELECT name FROM good) AND (
  EXISTS (SELECT 1 FROM entries e WHERE max_rank >= 1 AND ({host_sql('q.url')} = e.value OR (e.kind = 'domain' AND ends_with({host_sql('q.url')}, '.' || e.value))))
  OR EXISTS (SELECT 1 FROM prefixes p WHERE {PREFIX_HIT}))""")
def resolved_scope_policy(spark, d):
    """Scope entries and resolved addresses together; answers in upper case with a trailing dot, other schemes beside."""
    pages = table(spark, d, "pages").select("page_id", "url")
    other = pages.select("page_id", F.regexp_replace("url", "^[a-z]+:", "ftp:").alias("url"))
    answers = dns_answers(spark, d).withColumn("name", F.concat(F.upper("name"), F.lit(".")))
    return scope.resolved_scope(pages.unionByName(other), answers, scope_entries(spark, d))


@query("scope_normalize", f"""
WITH {NETWORKS_SQL}, raw AS (
  SELECT 'url' AS kind, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || rtrim({path_sql('url')}, '/') AS value, page_id,
         CASE WHEN url LIKE '%?%' THEN 'active' ELSE 'passive' END AS mode FROM pages
  UNION ALL SELECT 'domain', {host_sql('url')}, page_id, CASE WHEN url LIKE '%?%' THEN 'active' ELSE 'passive' END FROM pages
  UNION ALL SELECT 'cidr', {V4_SQL('(base >> (32 - prefix)) << (32 - prefix)')} || '/' || prefix, s_suppkey, 'active' FROM networks
  UNION ALL SELECT 'host', lower(c_name), c_custkey, 'active' FROM customer)
SELECT kind, value, arg_max(mode, page_id) AS maximum_mode FROM raw GROUP BY kind, value""")
def scope_normalize(spark, d):
    pages = table(spark, d, "pages")
    mode = F.when(F.contains("url", F.lit("?")), "active").otherwise("passive").alias("maximum_mode")
    rows = (
        pages.select(F.col("url").alias("value"), F.col("page_id").alias("created_at"), mode)
        .unionByName(pages.select(
            F.concat(F.lit(" "), F.upper(urls.host(F.col("url"))), F.lit(".")).alias("value"), F.col("page_id").alias("created_at"), mode))
        .unionByName(networks(spark, d).select(F.col("cidr").alias("value"), F.col("s_suppkey").alias("created_at"), F.lit("active").alias("maximum_mode")))
        .unionByName(table(spark, d, "customer").select(F.col("c_name").alias("value"), F.col("c_custkey").alias("created_at"), F.lit("active").alias("maximum_mode")))
        .withColumns({"project_id": F.lit("p"), "kind": F.lit(None).cast("string")})
    )
    return scope.scope_normalize(rows, ["created_at"]).select("kind", "value", "maximum_mode")


@query("valid_observations", """
SELECT l_orderkey, l_linenumber, l_discount * 12 AS confidence FROM lineitem WHERE l_returnflag <> 'N' AND l_discount * 12 BETWEEN 0 AND 1""")
def valid_observations(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("category"),
        F.col("l_linestatus").alias("original_value"), (F.col("l_discount") * 12).alias("confidence"))
    return obs.valid_observations(rows).select("l_orderkey", "l_linenumber", "confidence")


SENSITIVE_SQL = ", ".join(f"'{c}'" for c in fv.SENSITIVE_CATEGORIES)


@query("redact_tables", f"""
WITH {PAGES_SQL}
SELECT 'observation' AS tbl, id, CASE WHEN category IN ({SENSITIVE_SQL}) THEN {pseudonym_sql('original_value')} ELSE original_value END AS a,
  CASE WHEN category IN ({SENSITIVE_SQL}) THEN {pseudonym_sql('normalized_value')} ELSE normalized_value END AS b,
  CASE WHEN category IN ({SENSITIVE_SQL}) THEN {pseudonym_sql('location')} ELSE location END AS c FROM page_observations
UNION ALL SELECT 'artifact', id, regexp_extract(source_uri, '^[^?#]*', 0), {pseudonym_sql('original_path')}, sha256 FROM page_artifacts
UNION ALL SELECT 'entity', id, CASE WHEN type = 'artifact' OR type IN ({SENSITIVE_SQL}) THEN {pseudonym_sql('value')} ELSE value END,
  CASE WHEN type IN ({SENSITIVE_SQL}) THEN {pseudonym_sql('normalized_value')} ELSE normalized_value END, type FROM entities""")
def redact_tables(spark, d):
    view = lambda name, df, a, b, c: report.redact_table({"entity": "entities"}.get(name, name + "s"), df).select(
        F.lit(name).alias("tbl"), "id", F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    scoped = observations_in_project(page_observations(spark, d), page_artifacts(spark, d), page_runs(spark, d), "project-https")
    return (
        view("observation", page_observations(spark, d), "original_value", "normalized_value", "location")
        .unionByName(view("artifact", page_artifacts(spark, d), "source_uri", "original_path", "sha256"))
        .unionByName(view("entity", build_entities(scoped), "value", "normalized_value", "type"))
    )


@query("target_filetype_filter", f"""
SELECT page_id, url FROM pages WHERE ({host_sql('url')} = 'example.net' OR ends_with({host_sql('url')}, '.example.net'))
  AND (ends_with({path_sql('url')}, '.html') OR ends_with({path_sql('url')}, '.htm'))""")
def target_filetype(spark, d):
    return target_filetype_filter(table(spark, d, "pages").select("page_id", "url"), "example.net", ["html", "HTM"])


SEVERITY_SQL = "CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(fv.SEVERITIES)) + " ELSE 'low' END"
RANK_SQL = "CASE severity " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in fv.SEVERITIES.items()) + " END"


@query("findings_min_severity", f"""
WITH f AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_shipmode AS rule_id, {SEVERITY_SQL} AS severity FROM
  (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
m AS (SELECT * FROM f WHERE {RANK_SQL} >= 2)
SELECT id, rule_id, severity, (SELECT count(*) FROM m) AS total FROM (SELECT * FROM m ORDER BY {RANK_SQL} DESC, rule_id, id LIMIT 50 OFFSET 25)""")
def findings_min_severity(spark, d):
    severity = F
    for number, name in enumerate(fv.SEVERITIES):
        severity = severity.when(F.col("l_linenumber") == number + 1, F.lit(name))
    findings = table(spark, d, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.concat("l_returnflag", "l_linestatus").alias("rule_id"), severity.otherwise("low").alias("severity"))
    matching = report.findings_min_severity(findings, "medium", 25, 50)
    total = findings.filter(F.col("severity").isin("medium", "high", "critical"))
    return report.with_total(matching, total).select("id", "rule_id", "severity", "total")


@query("entities_page", f"""
WITH {PAGES_SQL} SELECT type, normalized_value, (SELECT count(*) FROM entities WHERE type = 'hostname') AS total
FROM (SELECT * FROM entities WHERE type = 'hostname' ORDER BY type, normalized_value LIMIT 20 OFFSET 5)""")
def entities_page(spark, d):
    scoped = observations_in_project(page_observations(spark, d), page_artifacts(spark, d), page_runs(spark, d), "project-https")
    entities = build_entities(scoped)
    page = report.entities_page(entities, " Hostname ", 5, 20)
    return report.with_total(page, entities.filter(F.col("type") == "hostname")).select("type", "normalized_value", "total")


STATE_SQL = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'scope_rejected' END"


def resources(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("scope_rejected").alias("status"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("last_error"))


@query("pending_resources", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'")
def pending_resources(spark, d):
    return report.pending_resources(resources(spark, d)).select("id")


@query("requeue_failed", """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'scope_rejected' ELSE 'pending' END AS status,
  CASE o_orderstatus WHEN 'P' THEN o_orderpriority END AS last_error FROM orders""")
def requeue_failed(spark, d):
    return report.requeue_failed(resources(spark, d))


@query("reset_endpoints", f"WITH {ENDPOINTS_SQL} SELECT id, uri, 'unknown' AS status, 0 AS consecutive_failures, CAST(NULL AS VARCHAR) AS cooldown_until FROM endpoints WHERE pool_id = 3")
def reset_endpoints(spark, d):
    from casegraph.operators.attempts import reset_endpoints as reset
    return reset(endpoints(spark, d), pools(spark, d), "NATION_3").select(
        "id", "uri", "status", "consecutive_failures", F.col("cooldown_until").cast("string").alias("cooldown_until"))
