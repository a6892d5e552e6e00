"""Correlation, reports and graph exports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.operators import correlate as cor
from casegraph.operators import graph_export, report
from casegraph.plans.evidence import build_report
from casegraph.session import scratch_path
from casegraph.sources import writers
from queries.predicates import SENSITIVE_SQL
from queries.registry import query
from queries.standins import (
    ENDPOINTS_SQL, PAGES_SQL, attempts, endpoints, host_sql, id_sql, page_artifacts, page_observations, page_runs, pseudonym_sql, runs, table,
)


def scoped(spark, d):
    return cor.observations_in_project(page_observations(spark, d), page_artifacts(spark, d), page_runs(spark, d), "project-https")


@query("observations_in_project", f"WITH {PAGES_SQL} SELECT id, artifact_id, category, sha256, artifact_name FROM scoped")
def observations_in_project(spark, d):
    return scoped(spark, d).select("id", "artifact_id", "category", "sha256", "artifact_name")


@query("build_entities", f"WITH {PAGES_SQL} SELECT * FROM entities WHERE (type, normalized_value) NOT IN (SELECT 'hostname', {host_sql('url')} FROM pages WHERE url LIKE '%/de/%')")
def build_entities(spark, d):
    obs = page_observations(spark, d)
    existing = obs.filter((F.col("category") == "hostname")).join(
        table(spark, d, "pages").filter(F.contains("url", F.lit("/de/"))).select(
            F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("artifact_id")), "artifact_id", "left_semi").select(
        F.lit("project-https").alias("project_id"), F.col("category").alias("type"), "normalized_value").distinct()
    return cor.build_entities(scoped(spark, d), existing)


@query("build_evidence", f"""
WITH {PAGES_SQL} SELECT {id_sql("'evidence'", 'id')} AS id, artifact_id, id AS observation_id, extractor AS source, original_value AS value, location,
  sha256 AS artifact_sha256 FROM scoped WHERE category <> 'application'""")
def build_evidence(spark, d):
    existing = page_observations(spark, d).filter(F.col("category") == "application").select(F.col("id").alias("observation_id"))
    return cor.build_evidence(scoped(spark, d), existing).drop("collected_at")


@query("build_relations", f"WITH {PAGES_SQL} SELECT id, from_entity_id, to_entity_id, type, evidence_id, confidence FROM relations")
def build_relations(spark, d):
    return cor.build_relations(scoped(spark, d)).drop("project_id")


@query("unanalyzed_artifacts", "SELECT 'doc-' || doc_id AS id FROM documents WHERE NOT regexp_matches(text, '[=:]')")
def unanalyzed_artifacts(spark, d):
    docs = table(spark, d, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return cor.unanalyzed_artifacts(docs.select(name.alias("id")), docs.filter(F.col("text").rlike("[=:]")).select(name.alias("artifact_id")))


@query("project_scoped", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def project_scoped(spark, d):
    parents = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return cor.project_scoped(table(spark, d, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("hash_reputation", """
SELECT doc_id, coalesce(n > 1, false) AS listed, r.sha256 IS NOT NULL AS found FROM (SELECT doc_id, sha256(text) AS sha256 FROM documents) a
LEFT JOIN (SELECT sha256(text) AS sha256, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) r USING (sha256)""")
def hash_reputation(spark, d):
    docs = table(spark, d, "documents").withColumn("sha256", F.sha2("text", 256))
    known = docs.filter(F.col("lang") == "en").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    return report.hash_reputation(docs.select("doc_id", "sha256"), known).select(
        "doc_id", F.coalesce(F.col("n") > 1, F.lit(False)).alias("listed"), "found")


@query("project_status", """SELECT 'runs' AS name, count(*) AS n FROM orders UNION ALL SELECT 'artifacts', count(*) FROM documents
UNION ALL SELECT 'scopes', count(*) FROM supplier UNION ALL SELECT 'observations', count(*) FROM lineitem""")
def project_status(spark, d):
    return report.project_status({n: table(spark, d, t) for n, t in (
        ("runs", "orders"), ("artifacts", "documents"), ("scopes", "supplier"), ("observations", "lineitem"))})


FAMILIES_SQL = f"""
m AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{c}')" for f, cs in fv.CATEGORY_FAMILIES.items() for c in cs)}) t(family, pattern)),
narrow AS (SELECT lower(category) AS category, count(*) AS n FROM page_observations GROUP BY 1),
wide AS (SELECT lower(category) AS category, count(*) AS n FROM (
    SELECT category FROM page_observations UNION ALL SELECT 'history.' || lower(c_mktsegment) FROM customer UNION ALL SELECT 'Author' FROM supplier) GROUP BY 1)
"""
IN_FAMILY = "category = pattern OR (pattern = 'history*' AND starts_with(category, 'history'))"


@query("category_families", f"""
WITH {PAGES_SQL}, {FAMILIES_SQL}
SELECT family, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM m LEFT JOIN wide ON {IN_FAMILY} GROUP BY 1""")
def category_families(spark, d):
    return report.category_families(_categories(spark, d))


def _categories(spark, d):
    return (
        page_observations(spark, d).select("category")
        .unionByName(table(spark, d, "customer").select(F.concat(F.lit("history."), F.lower("c_mktsegment")).alias("category")))
        .unionByName(table(spark, d, "supplier").select(F.lit("Author").alias("category")))
    )


@query("category_gap", f"""
WITH {PAGES_SQL}, {FAMILIES_SQL}
SELECT DISTINCT family FROM m JOIN wide ON {IN_FAMILY} WHERE family NOT IN (SELECT family FROM m JOIN narrow ON {IN_FAMILY})""")
def category_gap(spark, d):
    """Families found by the wider category stream and missed by page observations alone."""
    return report.category_gap(
        report.category_families(_categories(spark, d)), report.category_families(page_observations(spark, d).select("category")))


@query("run_outcome", """
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, coalesce(f, 0) AS failures, CASE WHEN f > 0 THEN 'partially_failed' ELSE 'completed' END AS status,
  CASE WHEN f > 0 THEN 'partial_provider_failure' ELSE 'complete' END AS coverage_status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def run_outcome(spark, d):
    tasks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"))
    return report.run_outcome(runs(spark, d), tasks)


@query("first_wins", """
SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def first_wins(spark, d):
    from casegraph.functions.ordered import first_wins as first
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey")
    return first(rows, ["l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_suppkey"]).drop("l_suppkey")


@query("match_caps", """
SELECT doc_id, position, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS position FROM (
  SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{6,}') AS w FROM documents)) WHERE position < 5""")
def match_caps(spark, d):
    from casegraph.operators.observations import match_caps as caps
    words = table(spark, d, "documents").select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("position", "word"))
    return caps(words, ["doc_id"], ["position"], 5).select("doc_id", F.col("position").cast("long").alias("position"), "word")


@query("cumulative_budget", """
SELECT l_orderkey, l_linenumber, l_partkey, round(s, 2) AS running, s <= 100 AS fits FROM (
  SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS s FROM lineitem)""")
def cumulative_budget(spark, d):
    from casegraph.operators.observations import cumulative_budget as budget
    rows = budget(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", 100, "fits")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("running_size", 2).alias("running"), "fits")


TIMELINE_SQL = f"""
t AS (
  SELECT epoch_us(o_orderdate) AS happened_us, 'run_created' AS kind, CAST(o_orderkey AS VARCHAR) AS source_id, o_orderpriority AS value FROM orders
  UNION ALL SELECT epoch_us(o_orderdate + INTERVAL 1 HOUR), 'run_started', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT epoch_us(o_orderdate + INTERVAL 2 HOUR), 'run_finished', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT epoch_us(ts), 'artifact_acquired', CAST(event_id AS VARCHAR), sha256(props) FROM events
  UNION ALL SELECT epoch_us(l_shipdate), 'metadata_date', l_orderkey || '-' || l_linenumber, strftime(l_shipdate, '%Y:%m:%d %H:%M:%S') FROM lineitem)
"""


@query("timeline", f"WITH {TIMELINE_SQL} SELECT happened_us, kind, source_id, value FROM t")
def timeline(spark, d):
    return _timeline(spark, d).select(F.unix_micros("timestamp").alias("happened_us"), "kind", "source_id", "value")


def _timeline(spark, d, redact=False):
    hours = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} HOURS")
    state = F.col("o_orderstatus")
    run_rows = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("command"), state.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.when(state != "P", hours(1)).alias("started_at"), F.when(state == "F", hours(2)).alias("finished_at"))
    artifact_rows = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("acquired_at"), F.sha2("props", 256).alias("sha256"))
    raw = F.col("raw")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id")
    shipped = table(spark, d, "lineitem").select(key, F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss").alias("raw"))
    observed = shipped.select("id", F.explode(F.array(
        F.struct(F.lit("Date").alias("category"), raw.alias("original_value"), raw.alias("normalized_value")),
        F.struct(F.lit("links_up_to_date").alias("category"), F.lit("true").alias("original_value"), F.lit("true").alias("normalized_value")),
    )).alias("o")).select("id", "o.*")
    return report.timeline(run_rows, artifact_rows, observed, redact)


@query("recent_runs", "SELECT CAST(o_orderkey AS VARCHAR) AS id, epoch_us(o_orderdate) AS created FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def recent_runs(spark, d):
    return report.recent_runs(runs(spark, d), 20).select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"))


@query("scope_list", "SELECT p_type AS kind, p_name AS value FROM part")
def scope_list(spark, d):
    return report.scope_list(table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_name").alias("value")))


@query("ordered_exports", f"WITH {PAGES_SQL} SELECT category, normalized_value, id FROM page_observations")
def ordered_exports(spark, d):
    return report.ordered_export("observations", page_observations(spark, d)).select("category", "normalized_value", "id")


@query("distinct_ci", "SELECT DISTINCT lower(trim(name)) AS name FROM (SELECT ' ' || upper(p_name) AS name FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_type FROM part)")
def distinct_ci(spark, d):
    part = table(spark, d, "part")
    rows = part.select(F.explode(F.array(F.concat(F.lit(" "), F.upper("p_name")), "p_name", "p_type", F.lit("  "))).alias("name"))
    return report.distinct_ci(rows, "name")


@query("missing_providers", """SELECT c_name AS provider_id, 'failed' AS status, 1 AS attempt_count, 'Provider is not registered.' AS last_error FROM customer
WHERE lower(replace(c_name, 'Customer', 'Supplier')) NOT IN (SELECT lower(s_name) FROM supplier)""")
def missing_providers(spark, d):
    requested = table(spark, d, "customer").select(F.upper(F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("provider_id"))
    registered = table(spark, d, "supplier").select(F.col("s_name").alias("provider_id"))
    return report.missing_providers(requested, registered).withColumn(
        "provider_id", F.replace(F.initcap("provider_id"), F.lit("Supplier"), F.lit("Customer")))


@query("evidence_manifest", "SELECT doc_id AS id, sha256(text) AS sha256, n_chars AS size, 'text/plain' AS mime_type, false AS included FROM documents")
def evidence_manifest(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"), F.lit("text/plain").alias("mime_type"))
    return report.evidence_manifest(rows, redact=True)


def graph(spark, d):
    s = scoped(spark, d)
    return cor.build_entities(s), cor.build_relations(s)


@query("graph_csv", f"""
WITH {PAGES_SQL} SELECT 'node' AS record, id, type, value, NULL AS "from", NULL AS "to" FROM entities
UNION ALL SELECT 'edge', id, type, NULL, from_entity_id, to_entity_id FROM relations""")
def graph_csv(spark, d):
    return graph_export.graph_csv(*graph(spark, d))


def _xml_sql(v):
    return f"replace(replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


DOT_SQL = "replace(replace(replace({v}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"


@query("graph_dot", f"""
WITH {PAGES_SQL} SELECT 0 AS section, 'digraph casegraph {{' AS line UNION ALL SELECT 4, '}}'
UNION ALL SELECT 1, '  "' || id || '" [label="' || {DOT_SQL.format(v="(type || ': ' || value)")} || '"];' FROM entities
UNION ALL SELECT 3, '  "' || from_entity_id || '" -> "' || to_entity_id || '" [label="contains"];' FROM relations""")
def graph_dot(spark, d):
    return graph_export.graph_lines(*graph(spark, d), "dot").select("section", "line")


XML_HEAD = '<?xml version="1.0" encoding="utf-8"?>'


@query("graph_graphml", f"""
WITH {PAGES_SQL} SELECT 1 AS section, '<node id="' || id || '"><data key="type">' || type || '</data><data key="value">' || {_xml_sql('value')} || '</data></node>' AS line FROM entities
UNION ALL SELECT 3, '<edge source="' || from_entity_id || '" target="' || to_entity_id || '"><data key="type">contains</data></edge>' FROM relations
UNION ALL SELECT 0, '{XML_HEAD}<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">' UNION ALL SELECT 4, '</graph></graphml>'""")
def graph_graphml(spark, d):
    """All lines, from the declaration to the closing tags."""
    return graph_export.graph_lines(*graph(spark, d), "graphml").select("section", "line")


@query("graph_gexf", f"""
WITH {PAGES_SQL} SELECT 1 AS section, '<node id="' || id || '" label="' || {_xml_sql("type || ': ' || value")} || '"/>' AS line FROM entities
UNION ALL SELECT 3, '<edge id="' || id || '" source="' || from_entity_id || '" target="' || to_entity_id || '" label="contains"/>' FROM relations
UNION ALL SELECT 0, '{XML_HEAD}<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'
UNION ALL SELECT 2, '</nodes><edges>' UNION ALL SELECT 4, '</edges></graph></gexf>'""")
def graph_gexf(spark, d):
    """All lines, from the declaration to the closing tags."""
    return graph_export.graph_lines(*graph(spark, d), "gexf").select("section", "line")


@query("sink_csv_tables", f"WITH {PAGES_SQL} SELECT id, type, {pseudonym_sql('value')} AS value, {pseudonym_sql('normalized_value')} AS normalized_value FROM entities")
def sink_csv_tables(spark, d):
    """Write the three CSV tables, read the entity file back."""
    entities, relations = graph(spark, d)
    written = writers.sink_csv_tables(
        {"entities": entities, "relations": relations, "observations": page_observations(spark, d)}, scratch_path(spark, "csv"))
    return spark.read.csv(written["entities"], header=True, quote='"', escape='"').select("id", "type", "value", "normalized_value")


@query("sink_ndjson_envelope", """
SELECT '{"schema_version":"1","success":true,"data":{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"},"errors":[],"run_id":"run-' || o_custkey || '"'
  || CASE WHEN o_orderstatus = 'F' THEN ',"coverage":"complete"' ELSE '' END || '}' AS value FROM orders""")
def sink_ndjson_envelope(spark, d):
    """Write the envelope lines, read them back."""
    orders = table(spark, d, "orders")
    path = scratch_path(spark, "ndjson")
    rows = orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    lines = writers.ndjson_envelope(
        rows, F.concat(F.lit("run-"), F.col("o_custkey").cast("string")), F.when(F.col("o_orderstatus") == "F", "complete"), ["o_orderkey", "o_orderstatus"])
    lines.write.text(path)
    return spark.read.text(path)


def report_inputs(spark, d):
    entities, relations = graph(spark, d)
    run = page_runs(spark, d).select(
        "id", "project_id", F.lit("crawl").alias("command"), F.lit("completed").alias("status"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"))
    return {
        "projects": page_runs(spark, d).select(
            F.col("project_id").alias("id"), F.col("project_id").alias("name"), F.concat(F.lit("/work/"), "project_id").alias("root_path")).distinct(),
        "runs": run,
        "artifacts": page_artifacts(spark, d).withColumns({"acquired_at": F.timestamp_seconds("acquired_at"), "stored_path": F.lit("/store")}),
        "observations": page_observations(spark, d),
        "evidence": cor.build_evidence(scoped(spark, d)),
        "entities": entities, "relations": relations,
        "provider_requests": table(spark, d, "supplier").select(
            F.col("s_suppkey").cast("string").alias("id"), F.lit("run-https").alias("run_id"), F.col("s_name").alias("query"),
            F.when(F.col("s_acctbal") < 0, "failed").otherwise("completed").alias("status")),
        "network_attempts": attempts(spark, d).select(
            F.col("id").cast("string").alias("id"), F.lit("run-https").alias("run_id"), "endpoint_id", F.col("event_type").alias("rotation_reason")),
        "endpoints": endpoints(spark, d),
    }


@query("sink_report_tables", f"""
WITH {PAGES_SQL}, {ENDPOINTS_SQL}, pa AS (SELECT * FROM page_artifacts WHERE run_id = 'run-https')
SELECT 'projects' AS name, 1::BIGINT AS n UNION ALL SELECT 'runs', 1 UNION ALL SELECT 'artifacts', count(*) FROM pa
UNION ALL SELECT 'observations', count(*) FROM page_observations WHERE artifact_id IN (SELECT id FROM pa)
UNION ALL SELECT 'evidence', count(*) FROM scoped UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations
UNION ALL SELECT 'provider_requests', count(*) FROM supplier UNION ALL SELECT 'network_attempts', count(*) FROM events
UNION ALL SELECT 'timeline', count(*) + 1 FROM pa UNION ALL SELECT 'coverage', 6
UNION ALL SELECT 'endpoint_summary', count(DISTINCT (protocol, status)) FROM endpoints""")
def sink_report_tables(spark, d):
    """Write the complete redacted report, count the rows read back per table."""
    written = writers.sink_report_tables(build_report(report_inputs(spark, d), "project-https"), scratch_path(spark, "report"))
    return report.project_status({name: spark.read.text(path) for name, path in written.items()})
