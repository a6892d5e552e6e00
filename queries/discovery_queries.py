"""Sources, links, candidates and site maps over whole tables. File readers read files that Spark writes from the
tables into the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions import urls
from casegraph.functions.ordered import first_wins
from casegraph.operators import discovery as disc
from casegraph.operators.artifacts import dedup_artifacts as dedup
from casegraph.operators.correlate import new_resources as new_only
from casegraph.operators.scope import scope_filter
from casegraph.session import scratch_path
from casegraph.sources import readers
from queries.predicates import ENTRIES_SQL, NON_PUBLIC_SQL
from queries.registry import query
from queries.standins import write_files  # noqa: E402
from queries.standins import (
    ADDRESSES_SQL, FIRST, NETWORKS_SQL, SECOND, V4_SQL, addresses, canonical_sql, endpoints, escape_sql, host_sql, networks, path_sql, table,
)


def pages(spark, d):
    return table(spark, d, "pages")


LINKS_SQL = f"""
anchors AS (
  SELECT page_id, url AS source_url, i - 1 AS position, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)$', 1) AS text
  FROM (SELECT page_id, url, unnest(list_zip(regexp_extract_all(html, '<a href="[^"]*">[^<]*'), range(1, len(regexp_extract_all(html, '<a href="[^"]*">[^<]*')) + 1))) AS z,
        z[1] AS a, z[2] AS i FROM pages) WHERE z[1] IS NOT NULL),
links AS (
  SELECT page_id, source_url, position, regexp_extract(source_url, '^([a-z]+://[^/]+)', 1) || {escape_sql('href')} AS url, text FROM anchors)
"""


@query("flagship_links_per_host", f"""
WITH {LINKS_SQL}, canon AS (SELECT lower({canonical_sql('url')}) AS key, source_url, position FROM links)
SELECT {host_sql('key')} AS host, count(DISTINCT key) AS urls FROM canon GROUP BY 1""")
def flagship(spark, d):
    """Captured pages -> links -> canonical URLs -> first sighting -> distinct URLs per host."""
    links = disc.extract_links(pages(spark, d))
    keyed = urls.with_canonical_url(links, "url", "key").select(F.lower("key").alias("key"), "source_url", "position")
    first = first_wins(keyed, ["key"], ["source_url", "position"])
    return first.groupBy(urls.host(F.col("key")).alias("host")).agg(F.count(F.lit(1)).alias("urls"))


@query("scan_artifacts")
def scan_artifacts(spark, d):
    """The table files themselves as artifacts; files over the byte budget appear as diagnostics, unread."""
    found, rejected = readers.scan_artifacts(spark, d, pattern="*.parquet", content=False)
    name = F.regexp_extract(F.col("original_path"), "[^/]+$", 0)
    return found.select(name.alias("name"), "size", "sha256", F.lit(None).cast("string").alias("code")).unionByName(
        rejected.select(F.regexp_extract("message", "[^/]+$", 0).alias("name"), F.lit(None).cast("long").alias("size"),
                        F.lit(None).cast("string").alias("sha256"), "code"))


@query("scan_artifacts_budget", """
WITH f AS (SELECT 'c' || c_custkey || '.txt' AS name, repeat('name=' || c_name || chr(10), CASE WHEN c_nationkey % 5 = 0 THEN 9 ELSE 1 END) AS body FROM customer)
SELECT name, length(body) AS size, sha256(body) AS sha256, NULL AS code FROM f WHERE length(body) <= 100
UNION ALL SELECT name, NULL, NULL, 'artifact.size_budget' FROM f WHERE length(body) > 100""")
def scan_artifacts_budget(spark, d):
    """A file per customer, a fifth of them over the byte budget, and files of another name beside."""
    folder = scratch_path(spark, "scan")
    body = F.concat(F.lit("name="), "c_name", F.lit("\n"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "customer").repartition(spread).select(
        F.explode(F.array(*[F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(e)) for e in (".txt", ".tmp")])).alias("name"),
        F.when(F.col("c_nationkey") % 5 == 0, F.repeat(body, 9)).otherwise(body).cast("binary").alias("content"))
    write_files(rows, folder)
    found, rejected = readers.scan_artifacts(spark, folder, pattern="*.txt", max_bytes=100, content=False)
    base = lambda c: F.regexp_extract(c, "[^/]+$", 0).alias("name")
    none = F.lit(None)
    return found.select(base("original_path"), "size", "sha256", none.cast("string").alias("code")).unionByName(
        rejected.select(base("message"), none.cast("long").alias("size"), none.cast("string").alias("sha256"), "code"))


@query("dedup_artifacts", """
SELECT sha256(text) AS sha256, 'doc/' || min(doc_id) AS original_path, count(*) AS sightings FROM documents GROUP BY 1""")
def dedup_artifacts(spark, d):
    rows = table(spark, d, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("original_path"),
        F.col("doc_id").alias("acquired_at"))
    counts = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("sightings"))
    return dedup(rows).join(counts, "sha256").select("sha256", "original_path", "sightings")


def _write_lines(spark, df, name):
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


@query("import_urls_text", "SELECT url FROM pages")
def import_urls_text(spark, d):
    lines = pages(spark, d).select(F.explode(F.array(
        F.concat(F.lit("  "), F.col("url"), F.lit("\t")), F.concat(F.lit("# page "), F.col("page_id").cast("string")), F.lit(""),
    )).alias("value"))
    return readers.import_urls_text(spark, _write_lines(spark, lines, "urls.txt")).select("url")


@query("import_urls_csv", """SELECT url, 'The "page", ' || page_id AS title, 'p' || page_id AS snippet FROM pages""")
def import_urls_csv(spark, d):
    number = F.col("page_id").cast("string")
    lines = pages(spark, d).select(F.explode(F.array(
        F.lit("URL,title,snippet"),
        F.concat(F.lit('"'), F.col("url"), F.lit('","The ""page"", '), number, F.lit('", p'), number),
    )).alias("value"))
    return readers.import_urls_csv(spark, _write_lines(spark, lines, "urls.csv"))


@query("import_urls_json", """SELECT url, NULL AS title FROM pages UNION ALL SELECT url, 'Page ' || page_id FROM pages""")
def import_urls_json(spark, d):
    """One result document per page: a plain string, an object, an object without a URL, and one with a numeric URL."""
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    items = F.concat(
        F.lit('{"results":['), F.to_json(F.array("url")), F.lit(","), F.to_json(F.struct("url", title.alias("title"))),
        F.lit(',{"title":"none"},{"url":5}]}'))
    flat = F.regexp_replace(items, r'\[(\[)("[^"]*")\]', r'[$2')
    return readers.url_json_rows(pages(spark, d).select(flat.alias("value"))).select("url", "title")


@query("import_urls_ndjson", "SELECT url, 'Page ' || page_id AS title FROM pages")
def import_urls_ndjson(spark, d):
    path = scratch_path(spark, "urls.ndjson")
    pages(spark, d).select("url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title")).write.json(path)
    return readers.import_urls_ndjson(spark, path).select("url", "title")


@query("import_urls_har", f"WITH {LINKS_SQL} SELECT url FROM links")
def import_urls_har(spark, d):
    """One archive per page, one entry per link."""
    entries = disc.extract_links(pages(spark, d)).groupBy("source_url").agg(F.collect_list(
        F.struct(F.struct("url", F.lit("GET").alias("method")).alias("request"))).alias("entries"))
    return readers.url_har_rows(entries.select(
        F.to_json(F.struct(F.struct("entries").alias("log"))).alias("value"))).select("url")


@query("import_discovery", f"""
WITH v AS (
  SELECT 0 AS n, 'import:text' AS provider_id, {canonical_sql('url')} AS c FROM pages WHERE url NOT LIKE '%/fr/%'
  UNION ALL SELECT 1, 'import:ndjson', {canonical_sql('url')} FROM pages),
f AS (SELECT lower(c) AS k, arg_min(c, n) AS canonical_url, arg_min(provider_id, n) AS provider_id FROM v GROUP BY 1)
SELECT canonical_url, provider_id FROM f WHERE k NOT IN (SELECT lower({canonical_sql('url')}) FROM pages WHERE url LIKE '%/de/%')""")
def import_discovery(spark, d):
    p = pages(spark, d)
    text = _write_lines(spark, p.filter(~F.contains("url", F.lit("/fr/"))).select(F.explode(F.array(
        "url", F.lit("mailto:someone@example.com"))).alias("value")), "discovery.txt")
    ndjson = scratch_path(spark, "discovery.ndjson")
    p.select("url").write.json(ndjson)
    known = p.filter(F.contains("url", F.lit("/de/"))).select(F.upper(urls.canonical_url(F.col("url"))).alias("canonical_url"))
    return readers.import_discovery(spark, [(text, "text"), (ndjson, "ndjson")], known).select("canonical_url", "provider_id")


@query("import_url_index", f"""
SELECT regexp_extract(url, '^[^#]*') AS url, CASE WHEN url LIKE 'https:%' THEN 'Page ' || page_id END AS title FROM pages
WHERE ends_with({host_sql('url')}, '.example.com') AND ends_with({path_sql('url')}, '.html')""")
def import_url_index(spark, d):
    title = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    line = F.when(F.startswith("url", F.lit("https:")), F.to_json(F.struct("url", title.alias("title")))).otherwise(F.col("url"))
    lines = pages(spark, d).select(F.explode(F.array(line, F.lit("# comment"))).alias("value"))
    return readers.import_url_index(spark, _write_lines(spark, lines, "index"), "example.com", ["html", "pdf"]).select("url", "title")


@query("import_crawl_index", f"""
WITH c AS (SELECT {host_sql('url')} AS urlkey, printf('%014d', page_id) AS ts, url, CASE WHEN url LIKE 'https:%' THEN '200' ELSE '404' END AS status FROM pages)
SELECT urlkey, arg_min(url, ts) AS url FROM c WHERE status = '200' AND regexp_matches(url, '(\\.html$|/$)') GROUP BY 1""")
def import_crawl_index(spark, d):
    path = scratch_path(spark, "cdx")
    url = F.regexp_replace("url", "/$", "/index.html")
    pages(spark, d).select(
        urls.host(F.col("url")).alias("urlkey"), F.format_string("%014d", "page_id").alias("timestamp"), url.alias("url"),
        F.when(F.startswith("url", F.lit("https:")), "200").otherwise("404").alias("status")).write.json(path)
    return readers.import_crawl_index(spark, path, ["html"]).select("urlkey", F.regexp_replace("url", "/index.html$", "/").alias("url"))


@query("import_search_results", f"""
SELECT url, 'Result ' || page_id AS title FROM pages WHERE ends_with({host_sql('url')}, '.example.org') AND ends_with({path_sql('url')}, '.html')
UNION ALL SELECT url, 'Page ' || page_id FROM pages""")
def import_search_results(spark, d):
    """Saved HTML result pages with wrapped links, and saved JSON result documents."""
    number = F.col("page_id").cast("string")
    html = F.concat(F.lit('<div><a class="r" href="/l/?kl=us-en&amp;uddg='), F.url_encode("url"), F.lit('&amp;rut=1">Result <b>'), number, F.lit("</b></a></div>"))
    saved = pages(spark, d).select(F.lit("https://search.example/html/?q=x").alias("url"), html.alias("html"))
    document = F.to_json(F.struct(F.array(F.struct("url", F.concat(F.lit("Page "), number).alias("title"))).alias("results")))
    return readers.import_search_pages(saved, "example.org", ["html"]).select("url", "title").unionByName(
        readers.search_json_rows(pages(spark, d).select(document.alias("value"))).select("url", "title"))


def endpoint_list_sql(secret: str, weight: str) -> str:
    return f"""
WITH r AS (SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'http' WHEN 'BUILDING' THEN 'https' WHEN 'FURNITURE' THEN 'socks4'
    WHEN 'HOUSEHOLD' THEN 'socks5' ELSE 'socks5h' END AS s, 'vault/' || c_custkey AS secret FROM customer)
SELECT s || '://ep' || c_custkey || '.example.net:8080' AS uri, CASE s WHEN 'https' THEN 'https_connect' WHEN 'socks5h' THEN 'socks5_host' ELSE s END AS protocol,
  CASE s WHEN 'socks5h' THEN 'remote' ELSE 'local' END AS dns_mode, {secret} AS secret_ref, {weight} AS weight, NULL AS code
FROM r WHERE c_nationkey > 2
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE c_nationkey WHEN 0 THEN 'endpoint.inline_credentials' ELSE 'endpoint.unsupported_scheme' END FROM r WHERE c_nationkey < 2"""


def listed_endpoints(spark, d):
    """(uri, secret_ref, weight, pool_id): nation 0 carries inline credentials, nation 1 an unknown scheme."""
    uri = F.when(F.col("pool_id") == 0, F.replace("uri", F.lit("://"), F.lit("://user:pw@"))).when(
        F.col("pool_id") == 1, F.regexp_replace("uri", "^[a-z0-9]+", "gopher")).otherwise(F.col("uri"))
    return endpoints(spark, d).select(
        uri.alias("uri"), F.concat(F.lit("vault/"), F.col("id").cast("string")).alias("secret_ref"), (F.col("pool_id") - 3).cast("int").alias("weight"), "pool_id")


def imported_endpoints(spark, d, lines, fmt):
    """Write a list, import it; nation 2 is already in the pool."""
    path = _write_lines(spark, lines, f"endpoints.{fmt}")
    known = endpoints(spark, d).filter(F.col("pool_id") == 2).select("uri")
    accepted, rejected = readers.import_endpoints(readers.read_endpoint_records(spark, path, fmt), known)
    return accepted.select("uri", "protocol", "dns_mode", "secret_ref", "weight", F.lit(None).cast("string").alias("code")).unionByName(
        rejected.select("code"), allowMissingColumns=True)


@query("import_endpoints", endpoint_list_sql("secret", "greatest(c_nationkey - 3, 1)"))
def import_endpoints(spark, d):
    """CSV list with comment lines."""
    line = F.concat_ws(",", "uri", F.concat(F.lit(" "), F.col("secret_ref")), F.col("weight").cast("string"))
    return imported_endpoints(spark, d, listed_endpoints(spark, d).select(F.explode(F.array(line, F.lit("# list"))).alias("value")), "csv")


@query("import_endpoints_text", endpoint_list_sql("NULL", "1"))
def import_endpoints_text(spark, d):
    """A URI per line, padded, with comment and blank lines."""
    padded = F.concat(F.lit("  "), F.col("uri"), F.lit("\t"))
    return imported_endpoints(spark, d, listed_endpoints(spark, d).select(F.explode(F.array(padded, F.lit(" # list"), F.lit(""))).alias("value")), "txt")


def endpoint_record():
    return F.struct("uri", "secret_ref", "weight", F.array(F.lit("eu"), F.lit("fast")).alias("tags"))


@query("import_endpoints_ndjson", endpoint_list_sql("secret", "greatest(c_nationkey - 3, 1)"))
def import_endpoints_ndjson(spark, d):
    """A record per line, with comment and blank lines."""
    return imported_endpoints(spark, d, listed_endpoints(spark, d).select(F.explode(F.array(F.to_json(endpoint_record()), F.lit("# list"), F.lit(""))).alias("value")), "ndjson")


@query("import_endpoints_json", endpoint_list_sql("secret", "greatest(c_nationkey - 3, 1)"))
def import_endpoints_json(spark, d):
    """One array per file, a file per nation."""
    rows = listed_endpoints(spark, d).groupBy("pool_id").agg(F.to_json(F.collect_list(endpoint_record())).alias("value"))
    path = scratch_path(spark, "endpoints.json")
    rows.write.partitionBy("pool_id").text(path)
    known = endpoints(spark, d).filter(F.col("pool_id") == 2).select("uri")
    accepted, rejected = readers.import_endpoints(readers.read_endpoint_records(spark, f"{path}/*", "json"), known)
    return accepted.select("uri", "protocol", "dns_mode", "secret_ref", "weight", F.lit(None).cast("string").alias("code")).unionByName(
        rejected.select("code"), allowMissingColumns=True)


@query("extract_links", f"WITH {LINKS_SQL} SELECT source_url, position, url, text FROM links")
def extract_links(spark, d):
    return disc.extract_links(pages(spark, d))


@query("new_resources", f"""
WITH {LINKS_SQL}, c AS (SELECT {canonical_sql('url')} AS canonical_url, source_url, position FROM links),
f AS (SELECT lower(canonical_url) AS k, arg_min(canonical_url, source_url || printf('%05d', position)) AS canonical_url FROM c GROUP BY 1)
SELECT canonical_url FROM f WHERE k NOT IN (SELECT lower({canonical_sql('url')}) FROM links WHERE position = 0)""")
def new_resources(spark, d):
    links = urls.with_canonical_url(disc.extract_links(pages(spark, d)), "url", "canonical_url")
    known = links.filter(F.col("position") == 0).select(F.upper("canonical_url").alias("canonical_url"))
    return new_only(links, known, ["source_url", "position"]).select("canonical_url")


@query("expand_cidr", f"""
WITH {NETWORKS_SQL}, small AS (SELECT base, 22 + prefix % 11 AS p FROM networks),
wide AS (SELECT printf('2001:db8:%x:%x:1:2:', 1 + s_suppkey, 1 + prefix) AS head, 113 + prefix % 16 AS p FROM networks)
SELECT {V4_SQL('base')} || '/' || p AS cidr, {V4_SQL('low + i')} AS address FROM (
  SELECT base, p, (base >> (32 - p)) << (32 - p) AS low, unnest(range(0, 1 << (32 - p))) AS i FROM small)
UNION ALL
SELECT head || '40:1/' || p, head || printf('%x:%x', 64 + (i >> 16), i & 65535) FROM (
  SELECT head, p, CASE WHEN p = 128 THEN 1 ELSE 0 END + unnest(range(0, 1 << (128 - p))) AS i FROM wide)""")
def expand_cidr(spark, d):
    """Every address of v4 prefixes of length 22 to 32 and of v6 prefixes of length 113 to 128."""
    given = networks(spark, d)
    prefix = F.substring_index("cidr", "/", -1).cast("int")
    v4 = F.concat(F.substring_index("cidr", "/", 1), F.lit("/"), (prefix % 11 + 22).cast("string"))
    v6 = F.format_string("2001:db8:%x:%x:1:2:40:1/%d", F.col("s_suppkey") + 1, prefix + 1, prefix % 16 + 113)
    return disc.expand_cidr(given.select(F.explode(F.array(v4, v6)).alias("cidr")))


@query("refused_ranges", f"""
WITH {NETWORKS_SQL}, edges AS (SELECT cidr, (base >> (32 - prefix)) << (32 - prefix) AS low, 1::BIGINT << (32 - prefix) AS size FROM networks)
SELECT DISTINCT cidr FROM edges, (VALUES {NON_PUBLIC_SQL}) b(first, last) WHERE low <= last AND low + size - 1 >= first""")
def refused_ranges(spark, d):
    """Whole ranges refused because an address is out of scope (scope: everything public)."""
    return disc.non_public_ranges(networks(spark, d))


@query("candidate_names", f"""
WITH l AS (SELECT lower(trim(p_name)) AS label, 2 * min(p_partkey) AS o FROM part GROUP BY 1 UNION ALL
           SELECT lower(replace(p_name, ' ', '-')) AS label, 2 * min(p_partkey) + 1 FROM part GROUP BY 1),
f AS (SELECT DISTINCT label FROM l)
SELECT label || '.' || h AS name, h AS domain FROM f, (SELECT DISTINCT {host_sql('url')} AS h FROM pages)
WHERE regexp_matches(label, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$')""")
def candidate_names(spark, d):
    part = table(spark, d, "part")
    labels = part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("label"), (F.col("p_partkey") * 2).alias("o")).unionByName(
        part.select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("label"), (F.col("p_partkey") * 2 + 1).alias("o")))
    domains = pages(spark, d).select(urls.host(F.col("url")).alias("domain")).distinct()
    return disc.candidate_names(labels, domains, ["o"]).select("name", "domain")


SUFFIXES_SQL = "['~', '.bak', '.old', '.orig', '.save', '.zip']"
BACKUPS_SQL = f"""
backups AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*') || s AS candidate, i AS suffix_no
  FROM pages, (SELECT unnest({SUFFIXES_SQL}) AS s, unnest(range(0, 6)) AS i) WHERE NOT ends_with({path_sql('url')}, '/'))
"""


@query("backup_candidates", f"WITH {BACKUPS_SQL} SELECT url, candidate FROM backups")
def backup_candidates(spark, d):
    return disc.backup_candidates(pages(spark, d)).select("url", "candidate")


@query("union_candidates", f"""
WITH {BACKUPS_SQL}, c AS (
  SELECT candidate, 0 AS part, page_id AS o, suffix_no FROM backups
  UNION ALL SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+') || '/' || f, 1, 0, k FROM pages, (VALUES ('backup.zip', 0), ('www.tar.gz', 1)) t(f, k)),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY part, o, suffix_no) AS rn FROM c)
SELECT candidate FROM r WHERE rn = 1""")
def union_candidates(spark, d):
    """All candidates."""
    p = pages(spark, d)
    roots = p.select(F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")), F.lit("/")).alias("root")).distinct()
    return disc.union_candidates(p.select("page_id", "url"), roots, None, "page_id")


@query("exposed_backups", f"""
WITH {BACKUPS_SQL} SELECT DISTINCT 'web.backup.exposed' AS rule_id, candidate AS description, 'high' AS severity, 0.85::DOUBLE AS confidence FROM backups
WHERE suffix_no IN (1, 5) AND url LIKE 'https:%'""")
def exposed_backups(spark, d):
    """Captured responses: `.bak` and `.zip` of https pages answered 200 / 206, everything else 404."""
    found = disc.backup_candidates(pages(spark, d))
    status = F.when(F.startswith("candidate", F.lit("https:")) & F.endswith("candidate", F.lit(".bak")), 200).when(
        F.startswith("candidate", F.lit("https:")) & F.endswith("candidate", F.lit(".zip")), 206).otherwise(404)
    responses = found.select(urls.canonical_url(F.col("candidate")).alias("canonical_url"), status.alias("status_code"))
    return disc.exposed_backups(found, responses).select("rule_id", "description", "severity", "confidence")


@query("wildcard_suppressed_names", f"""
WITH a AS (SELECT DISTINCT 'd' || c_nationkey AS domain, 'n' || c_custkey || '.d' || c_nationkey AS name, unnest([
    '192.0.2.' || (c_nationkey % 7), CASE c_mktsegment WHEN 'BUILDING' THEN '198.51.100.' || (c_custkey % 9) WHEN 'MACHINERY' THEN '192.0.2.' || ((c_nationkey + 1) % 7) END]) AS address FROM customer),
p AS (SELECT DISTINCT 'd' || n_nationkey AS domain, unnest(['192.0.2.' || (n_nationkey % 7), CASE WHEN n_regionkey = 1 THEN '192.0.2.' || ((n_nationkey + 1) % 7) END]) AS address FROM nation WHERE n_regionkey < 4),
s AS (SELECT domain, name, list_sort(list(address)) AS l FROM a WHERE address IS NOT NULL GROUP BY ALL),
w AS (SELECT domain, list_sort(list(address)) AS l FROM p WHERE address IS NOT NULL GROUP BY ALL)
SELECT s.domain, s.name, CAST(len(s.l) AS BIGINT) AS addresses FROM s LEFT JOIN w USING (domain) WHERE w.l IS NULL OR s.l <> w.l""")
def wildcard_suppressed_names(spark, d):
    domain = lambda c: F.concat(F.lit("d"), F.col(c).cast("string")).alias("domain")
    plain = lambda n: F.concat(F.lit("192.0.2."), (n % 7).cast("string"))
    n = F.col("c_nationkey")
    extra = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("198.51.100."), (F.col("c_custkey") % 9).cast("string"))).when(
        F.col("c_mktsegment") == "MACHINERY", plain(n + 1))
    answers = table(spark, d, "customer").select(
        domain("c_nationkey"), F.concat(F.lit("n"), F.col("c_custkey").cast("string"), F.lit(".d"), n.cast("string")).alias("name"),
        F.explode(F.array(plain(n), extra)).alias("address"))
    k = F.col("n_nationkey")
    probes = table(spark, d, "nation").filter(F.col("n_regionkey") < 4).select(
        domain("n_nationkey"), F.explode(F.array(plain(k), F.when(F.col("n_regionkey") == 1, plain(k + 1)))).alias("address"))
    return disc.wildcard_suppressed_names(answers, probes)


# Site map: each page is captured at its own URL; the page after it (by number) is captured at its first link.
CAPTURED_SQL = f"""
{LINKS_SQL},
captured AS (
  SELECT source_url, position, url, text FROM links
  UNION ALL
  SELECT f.url AS source_url, l.position, regexp_extract(f.url, '^([a-z]+://[^/]+)', 1) || regexp_extract(l.url, '^[a-z]+://[^/]+(/.*)$', 1), l.text
  FROM links f JOIN links l ON l.page_id = f.page_id + 1 WHERE f.position = 0),
edges AS (SELECT lower({canonical_sql('source_url')}) AS page, lower({canonical_sql('url')}) AS target FROM captured)
"""


def captured_links(spark, d):
    p = pages(spark, d)
    own = disc.extract_links(p, keep=("page_id",))  # by number: several pages may share a URL
    first = own.filter(F.col("position") == 0).select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("at"))
    borrowed = p.select("page_id", "html").join(first, "page_id").select(F.col("at").alias("url"), "html")
    return own.drop("page_id").unionByName(disc.extract_links(borrowed))


@query("site_map", f"""
WITH RECURSIVE {CAPTURED_SQL},
walk AS (
  SELECT root, lower({canonical_sql('root')}) AS page, 0 AS depth FROM (SELECT min(url) AS root FROM pages GROUP BY {host_sql('url')})
  UNION
  SELECT root, target, depth + 1 FROM walk JOIN edges USING (page) WHERE depth < 3)
SELECT root, page, CAST(min(depth) AS BIGINT) AS depth FROM walk WHERE depth > 0 GROUP BY ALL""")
def site_map(spark, d):
    """One walk per host, from its first URL."""
    roots = pages(spark, d).groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("url").alias("root")).select("root")
    found = disc.site_map(captured_links(spark, d), roots, max_depth=2)
    return found.select("root", F.lower(urls.canonical_url(F.col("url"))).alias("page"), F.col("depth").cast("long").alias("depth"))


@query("host_intel_flatten", f"""
SELECT address AS requested_ip, c_name AS org, 'AS' || c_nationkey AS asn, CAST(1 AS BIGINT) AS service_count, 8080 AS port, 'tcp' AS transport,
  'banner of ' || c_name AS banner, c_mktsegment AS product
FROM (WITH {ADDRESSES_SQL} SELECT * FROM addresses) JOIN customer USING (c_custkey)""")
def host_intel_flatten(spark, d):
    rows = addresses(spark, d).join(table(spark, d, "customer"), "c_custkey")
    body = F.to_json(F.struct(
        F.col("address").alias("ip_str"), F.col("c_name").alias("org"), F.concat(F.lit("AS"), F.col("c_nationkey").cast("string")).alias("asn"),
        F.array(F.lit(8080)).alias("ports"),
        F.array(F.struct(F.lit(8080).alias("port"), F.lit("tcp").alias("transport"), F.col("c_mktsegment").alias("product"),
                         F.concat(F.lit("banner of "), F.col("c_name")).alias("data"))).alias("data")))
    hosts, services = disc.host_intel_flatten(rows.select(F.concat_ws("#", "address", "c_custkey").alias("requested_ip"), body.alias("body")))
    joined = hosts.join(services, "requested_ip")
    return joined.select(F.substring_index("requested_ip", "#", 1).alias("requested_ip"), "org", "asn",
                         F.col("service_count").cast("long").alias("service_count"), "port", "transport", "banner", "product")


@query("file_reputation_flatten", """
SELECT sha256(text) AS requested_hash, 'file' AS object_type, n_chars AS size, doc_id AS times_submitted, CAST(length(source) AS INTEGER) AS malicious FROM documents""")
def file_reputation_flatten(spark, d):
    sha = F.sha2("text", 256)
    body = F.to_json(F.struct(F.struct(
        sha.alias("id"), F.lit("file").alias("type"), F.struct(
            sha.alias("sha256"), F.col("n_chars").alias("size"), F.col("doc_id").alias("times_submitted"),
            F.struct(F.char_length("source").alias("malicious")).alias("last_analysis_stats")).alias("attributes")).alias("data")))
    return disc.file_reputation_flatten(table(spark, d, "documents").select(sha.alias("requested_hash"), body.alias("body"))).select(
        "requested_hash", "object_type", "size", "times_submitted", "malicious")


@query("merge_headers", """
SELECT o_orderkey AS response_id, 'x-line' AS name, string_agg(l_shipdate, ',' ORDER BY l_shipdate) AS values_text FROM (
  SELECT l_orderkey AS o_orderkey, printf('%d/%d/%d', l_linenumber, l_partkey, l_suppkey) AS l_shipdate FROM lineitem) GROUP BY 1""")
def merge_headers(spark, d):
    """Line items as header lines of one response per order, names in two spellings."""
    name = F.when(F.col("l_returnflag") == "A", "X-Line").otherwise("x-line")
    value = F.format_string("%d/%d/%d", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("response_id"), name.alias("name"), value.alias("value"), value.alias("o"))
    return disc.merge_headers(rows, "o").select("response_id", "name", F.array_join("values", ",").alias("values_text"))
