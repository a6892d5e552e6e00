"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.functions import http, net, redact, text, urls
from queries.registry import query
from queries.standins import (
    ADDRESSES_SQL, NETWORKS_SQL, V4_SQL, addresses, canonical_sql, host_sql, networks, path_sql, pseudonym_sql, table,
)

BS = "chr(92)"


def _variants(spark, d):
    """Each page URL as given and in a spelling with upper-case scheme and host and the default port."""
    u = F.col("url")
    loud = F.concat(
        F.upper(urls.scheme(u)), F.lit("://"), F.upper(urls.authority(u)),
        F.when(urls.scheme(u) == "https", ":443").otherwise(":80"), F.substr(u, F.length(urls.authority(u)) + F.instr(u, F.lit("://")) + F.lit(3)),
    )
    return table(spark, d, "pages").select("page_id", F.explode(F.array(u, loud)).alias("url"))


VARIANTS_SQL = """
variants AS (
  SELECT page_id, url FROM pages
  UNION ALL
  SELECT page_id, upper(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))
    || CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)
  FROM pages)
"""


@query("canonical_url", f"WITH {VARIANTS_SQL} SELECT page_id, {canonical_sql('url')} AS canonical FROM variants")
def canonical(spark, d):
    return _variants(spark, d).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("canonical_url_idn", f"""
WITH named AS (SELECT page_id, regexp_replace(url, '://', '://xn--bcher-kva.') AS url FROM pages)
SELECT page_id, {canonical_sql('url')} AS canonical FROM named UNION ALL SELECT page_id, {canonical_sql('url')} FROM pages""")
def canonical_idn(spark, d):
    """Every page under its own host and below a host name with an umlaut, in upper case."""
    p = table(spark, d, "pages").select("page_id", "url")
    named = p.select("page_id", F.replace("url", F.lit("://"), F.lit("://B\u00dcCHER.")).alias("url"))
    return urls.with_canonical_url(named.unionByName(p), "url", "canonical").select("page_id", "canonical")


@query("normalize_value", """
WITH v AS (
  SELECT page_id, 'url' AS category, '  ' || upper(url) || chr(9) AS value FROM pages
  UNION ALL SELECT o_orderkey, 'date', ' ' || strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') FROM orders
  UNION ALL SELECT o_orderkey, 'date', o_orderpriority FROM orders
  UNION ALL SELECT c_custkey, 'company', c_name || '  ' FROM customer)
SELECT page_id AS id, category, CASE
  WHEN category = 'url' THEN lower(trim(value, ' ' || chr(9)))
  WHEN category = 'date' AND regexp_matches(trim(value), '^[0-9]{4}:') THEN
    replace(substr(trim(value), 1, 10), ':', '-') || 'T' || substr(trim(value), 12) || '.0000000+00:00'
  ELSE trim(value) END AS normalized
FROM v""")
def normalize(spark, d):
    pages, orders, customer = (table(spark, d, t) for t in ("pages", "orders", "customer"))
    rows = (
        pages.select(F.col("page_id").alias("id"), F.lit("url").alias("category"),
                     F.concat(F.lit("  "), F.upper("url"), F.lit("\t")).alias("value"))
        .unionByName(orders.select(F.col("o_orderkey").alias("id"), F.lit("date").alias("category"), F.concat(
            F.lit(" "), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).alias("value")))
        .unionByName(orders.select(F.col("o_orderkey").alias("id"), F.lit("date").alias("category"), F.col("o_orderpriority").alias("value")))
        .unionByName(customer.select(F.col("c_custkey").alias("id"), F.lit("company").alias("category"), F.concat(F.col("c_name"), F.lit("  ")).alias("value")))
    )
    return rows.select("id", "category", text.normalize_value(F.col("category"), F.col("value")).alias("normalized"))


@query("pseudonymize", f"SELECT c_custkey, {pseudonym_sql('c_name')} AS hidden FROM customer")
def pseudonymize(spark, d):
    return table(spark, d, "customer").select("c_custkey", redact.pseudonymize(F.col("c_name")).alias("hidden"))


PRIVATE_SQL = "replace(url, '://', '://user:secret@')"


@query("redact_uri", f"""
SELECT page_id, regexp_extract(url, '^[^?#]*', 0) AS redacted, {pseudonym_sql("regexp_extract(html, '<title>([^<]*)<', 1)")} AS title FROM pages""")
def redact_uri(spark, d):
    return table(spark, d, "pages").select(
        "page_id", urls.redact_uri(F.replace("url", F.lit("://"), F.lit("://user:secret@"))).alias("redacted"),
        urls.redact_uri(F.regexp_extract("html", "<title>([^<]*)<", 1)).alias("title"))


@query("redact_destination", f"""
SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || ':8443' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS destination FROM pages""")
def redact_destination(spark, d):
    loud = F.regexp_replace("url", "^([a-z]+://)([^/?#]*)", "$1user:secret@$2:8443")
    return table(spark, d, "pages").select("page_id", urls.redact_destination(loud).alias("destination"))


@query("sanitize_diagnostic", """
SELECT page_id, m AS message FROM (
  SELECT page_id, 'GET ' || regexp_extract(url, '^[^?#]*', 0) || ' failed: ' || html AS m FROM pages)""")
def sanitize_diagnostic(spark, d):
    message = F.concat(F.lit("GET "), F.replace("url", F.lit("://"), F.lit("://u:p@")), F.lit(" failed: "), F.col("html"))
    return table(spark, d, "pages").select("page_id", redact.sanitize_diagnostic(message).alias("message"))


@query("slug_property", """
SELECT p_partkey, 'custom.' || regexp_replace(lower(p_type || ' ' || p_name), '[^\\p{L}\\p{Nd}]', '_', 'g') AS slug,
  CASE p_type WHEN 'x' THEN '' ELSE 'custom.' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]', '_', 'g'), '_') END AS mapped FROM part""")
def slug_property(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", text.slug_property(F.concat_ws(" ", "p_type", "p_name")).alias("slug"),
        text.map_custom_property(F.col("p_brand")).alias("mapped"))


REFERENCE_SQL = f"""
refs AS (
  SELECT page_id, url AS target FROM pages
  UNION ALL SELECT page_id, {path_sql('url')} FROM pages
  UNION ALL SELECT page_id, {BS} || {BS} || {host_sql('url')} || replace({path_sql('url')}, '/', {BS}) FROM pages
  UNION ALL SELECT page_id, 'C:' || replace({path_sql('url')}, '/', {BS}) FROM pages
  UNION ALL SELECT page_id, '..' || {path_sql('url')} FROM pages
  UNION ALL SELECT page_id, substr({path_sql('url')}, 2) FROM pages)
"""


@query("classify_reference", f"""
WITH {REFERENCE_SQL} SELECT page_id, target, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]+:') THEN 'url'
  WHEN starts_with(target, {BS} || {BS}) OR regexp_matches(target, '^[A-Za-z]:.') OR starts_with(target, '../') OR starts_with(target, '/')
  THEN 'path' ELSE 'external_relationship' END AS category FROM refs""")
def classify_reference(spark, d):
    u, p = F.col("url"), urls.raw_path(F.col("url"))
    windows = F.replace(p, F.lit("/"), F.lit("\\"))
    return table(spark, d, "pages").select("page_id", F.explode(F.array(
        u, p, F.concat(F.lit("\\\\"), urls.host(u), windows), F.concat(F.lit("C:"), windows), F.concat(F.lit(".."), p),
        F.substr(p, F.lit(2)),
    )).alias("target")).withColumn("category", text.classify_reference(F.col("target")))


@query("user_from_path", f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_name END AS username FROM customer""")
def user_from_path(spark, d):
    folder = F.when(F.col("c_mktsegment") == "BUILDING", "C:/Users/").when(
        F.col("c_mktsegment") == "MACHINERY", "D:\\shared\\").otherwise("c:\\documents and settings\\")
    path = F.concat(folder, F.col("c_name"), F.lit("\\report.doc"))
    return table(spark, d, "customer").select("c_custkey", text.user_from_path(path).alias("username"))


TEXT_KEY_SQL = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.TEXT_KEYS.items()) + (
    " ELSE CASE WHEN k LIKE '%printer%' THEN 'printer' ELSE 'config.' || replace(k, ' ', '_') END END")
XMP_SQL = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.XMP_PROPERTIES.items()) + " ELSE 'xmp.' || k END"
IMAGE_SQL = "CASE " + " ".join(f"WHEN k LIKE '%{n}%' THEN '{c}'" for n, c in fv.IMAGE_TAG_RULES) + (
    " ELSE 'image.' || replace(k, ' ', '_') END")
OFFICE_SQL = "CASE k " + " ".join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in fv.OFFICE_ELEMENTS.items()) + " END"
KEYS = ["Full Address", "UserName", "Printer", "creator", "ModifyDate", "GPS Latitude", "Date/Time", "Software"]


@query("map_category", f"""
WITH keys AS (SELECT c_custkey, lower(list_extract({KEYS}, CAST(c_custkey % {len(KEYS)} AS INTEGER) + 1)) AS k FROM customer
  UNION ALL SELECT c_custkey, lower(c_mktsegment) FROM customer)
SELECT c_custkey, k, {TEXT_KEY_SQL} AS text_category, {XMP_SQL} AS xmp_category, {IMAGE_SQL} AS image_category,
  {OFFICE_SQL} AS office_category FROM keys""")
def map_category(spark, d):
    name = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("c_custkey") % len(KEYS) + 1).cast("int"))
    key = F.col("name")
    return (
        table(spark, d, "customer").select("c_custkey", F.explode(F.array(name, F.col("c_mktsegment"))).alias("name"))
        .select("c_custkey", F.lower(key).alias("k"), text.map_text_key(key).alias("text_category"),
                text.map_xmp_property(key).alias("xmp_category"), text.map_image_tag(key).alias("image_category"),
                text.map_office_element(key).alias("office_category"))
    )


@query("reverse_dns_name", f"""
WITH {ADDRESSES_SQL} SELECT c_custkey, address, array_to_string(list_reverse(string_split(address, '.')), '.') || '.in-addr.arpa' AS name FROM addresses
UNION ALL SELECT c_custkey, '2001:db8::' || printf('%x', c_custkey % 65536),
  array_to_string(list_reverse(string_split_regex(printf('20010db800000000000000000000%04x', c_custkey % 65536), '')), '.') || '.ip6.arpa' FROM customer""")
def reverse_dns_name(spark, d):
    six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("c_custkey") % 65536)))
    rows = addresses(spark, d).unionByName(table(spark, d, "customer").select("c_custkey", six.alias("address")))
    return rows.withColumn("name", net.reverse_dns_name(F.col("address")))


@query("normalize_dns", f"""
SELECT page_id, 'MX' AS record_type, '10 ' || {host_sql('url')} AS value FROM pages
UNION ALL SELECT page_id, 'NS', {host_sql('url')} FROM pages
UNION ALL SELECT page_id, 'TXT', {host_sql('url')} || '.' FROM pages""")
def normalize_dns(spark, d):
    h = F.concat(urls.host(F.col("url")), F.lit("."))
    rec = lambda t, v: F.struct(F.lit(t).alias("record_type"), v.alias("value"))
    return table(spark, d, "pages").select("page_id", F.explode(F.array(
        rec("MX", F.concat(F.lit("10   "), h)), rec("NS", h), rec("TXT", h))).alias("r")).select(
        "page_id", "r.record_type", net.normalize_dns(F.col("r.record_type"), F.col("r.value")).alias("value"))


STATUS_CODES = {"click": 200, "view": 302, "purchase": 403, "signup": 429, "error": 503}
_status_sql = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STATUS_CODES.items()) + " END"


@query("classify_outcome", f"""
WITH r AS (SELECT page_id, html, CASE WHEN url LIKE '%?page=%' THEN 407 WHEN url LIKE '%utm_%' THEN 403 WHEN url LIKE '%#top' THEN 429
  WHEN url LIKE '%.html%' THEN 404 WHEN url LIKE '%/' THEN 502 ELSE 200 END AS status,
  CASE WHEN url LIKE 'https:%' THEN html ELSE '<p>Solve the CAPTCHA</p>' END AS body FROM pages)
SELECT page_id, CASE WHEN status = 407 THEN 'proxy_authentication_required' WHEN status = 403 THEN 'forbidden' WHEN status = 429 THEN 'rate_limited'
  WHEN status >= 500 THEN 'server_error' WHEN contains(lower(body), 'captcha') OR contains(lower(body), 'challenge-platform')
  THEN 'challenge' WHEN status BETWEEN 200 AND 399 THEN 'success' ELSE 'unknown_failure' END AS outcome FROM r""")
def classify_outcome(spark, d):
    u = F.col("url")
    has = lambda s: F.contains(u, F.lit(s))
    status = (F.when(has("?page="), 407).when(has("utm_"), 403).when(F.endswith(u, F.lit("#top")), 429).when(has(".html"), 404)
              .when(F.endswith(u, F.lit("/")), 502).otherwise(200))
    body = F.when(F.startswith(u, F.lit("https:")), F.col("html")).otherwise(F.lit("<p>Solve the CAPTCHA</p>"))
    return table(spark, d, "pages").select("page_id", http.classify_outcome(status, body).alias("outcome"))


@query("detect_technology", """
SELECT page_id, coalesce(CASE WHEN url LIKE '%.html%' THEN 'nginx' END, CASE WHEN url LIKE '%?page=%' THEN 'PHP/8' END,
  CASE WHEN contains(lower(substr(b, 1, 131072)), 'wp-content') THEN 'WordPress' WHEN contains(lower(substr(b, 1, 131072)), '__next') THEN 'Next.js'
  WHEN contains(lower(substr(b, 1, 131072)), 'drupal') THEN 'Drupal' END) AS technology
FROM (SELECT page_id, url, CASE WHEN url LIKE 'https:%' THEN html || '<link href="/WP-Content/x">' ELSE html END AS b FROM pages)""")
def detect_technology(spark, d):
    u = F.col("url")
    body = F.when(F.startswith(u, F.lit("https:")), F.concat("html", F.lit('<link href="/WP-Content/x">'))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", http.detect_technology(
        F.when(F.contains(u, F.lit(".html")), "nginx"), F.when(F.contains(u, F.lit("?page=")), "PHP/8"), body).alias("technology"))


EXTENSIONS = ["pdf", "DOCX", "odt", "gif", "rdp", "txt", "webp", "wpd"]


@query("extension_kind", "SELECT p_partkey, CASE p_partkey % 8 " + " ".join(
    f"WHEN {i} THEN " + (f"'{fv.EXTENSION_KINDS[e.lower()]}'" if e.lower() in fv.EXTENSION_KINDS else "NULL") for i, e in enumerate(EXTENSIONS))
    + " END AS kind FROM part")
def extension_kind(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    name = F.concat(F.lit("/files.d/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), ext)
    return table(spark, d, "part").select("p_partkey", text.extension_kind(name).alias("kind"))


@query("safe_entry_path", f"""
WITH {REFERENCE_SQL} SELECT page_id, target, NOT (starts_with(replace(target, {BS}, '/'), '/') OR regexp_matches(target, '^[A-Za-z]:')
  OR list_contains(string_split(replace(target, {BS}, '/'), '/'), '..')) AS safe FROM refs""")
def safe_entry_path(spark, d):
    u, p = F.col("url"), urls.raw_path(F.col("url"))
    windows = F.replace(p, F.lit("/"), F.lit("\\"))
    return table(spark, d, "pages").select("page_id", F.explode(F.array(
        u, p, F.concat(F.lit("\\\\"), urls.host(u), windows), F.concat(F.lit("C:"), windows), F.concat(F.lit(".."), p),
        F.substr(p, F.lit(2)),
    )).alias("target")).withColumn("safe", text.safe_entry_path(F.col("target")))


@query("valid_hash_id", """
SELECT doc_id, regexp_matches(h, '^([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$') AS valid, length(h) AS n FROM (
  SELECT doc_id, unnest([sha256(text), md5(text), substr(sha256(text), 1, 40), substr(sha256(text), 1, 50), substr(text, 1, 32)]) AS h FROM documents)""")
def valid_hash_id(spark, d):
    sha = F.sha2("text", 256)
    hashes = F.array(sha, F.md5("text"), F.substring(sha, 1, 40), F.substring(sha, 1, 50), F.substring("text", 1, 32))
    return table(spark, d, "documents").select("doc_id", F.explode(hashes).alias("h")).select(
        "doc_id", text.valid_hash_id(F.col("h")).alias("valid"), F.char_length("h").cast("long").alias("n"))


def _range_sql(prefixes):
    import ipaddress
    nets = [ipaddress.ip_network(p) for p in prefixes]
    return " OR ".join(f"n BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets)


@query("non_public_address", f"WITH {ADDRESSES_SQL} SELECT c_custkey, address, ({_range_sql(fv.NON_PUBLIC_V4)}) AS non_public FROM numbers")
def non_public_address(spark, d):
    return addresses(spark, d).withColumn("non_public", net.non_public_address(F.col("address")))


@query("cidr_match", f"""
WITH {ADDRESSES_SQL}, {NETWORKS_SQL}
SELECT c_custkey, s_suppkey FROM numbers JOIN networks ON (n >> (32 - prefix)) = (base >> (32 - prefix))""")
def cidr_match(spark, d):
    from casegraph.operators.scope import cidr_match as match
    return match(addresses(spark, d), networks(spark, d), "address", "cidr").select("c_custkey", "s_suppkey")


@query("longest_prefix", f"""
WITH {ADDRESSES_SQL}, {NETWORKS_SQL},
best AS (SELECT c_custkey, first(cidr ORDER BY prefix DESC, cidr) AS cidr FROM numbers JOIN networks ON (n >> (32 - prefix)) = (base >> (32 - prefix)) GROUP BY 1)
SELECT c_custkey, cidr FROM numbers LEFT JOIN best USING (c_custkey)""")
def longest_prefix(spark, d):
    from casegraph.operators.scope import longest_prefix as narrowest
    return narrowest(addresses(spark, d), networks(spark, d).select("cidr"), "address", "cidr").select("c_custkey", "cidr")
