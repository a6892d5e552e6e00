"""Operators against small goldens and sequential brute force, including skewed keys."""

import datetime as dt
import io
import ipaddress
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from casegraph import fixed_values as fv
from casegraph.operators import artifacts as art
from casegraph.operators import attempts as att
from casegraph.operators import containers, correlate, discovery, graph_export, report, text_extract
from casegraph.plans.evidence import analyze, build_report
from casegraph.session import scratch_path
from casegraph.sources import readers, writers


def sequential_health(rows):
    """The attempt-by-attempt fold."""
    state, streaks = {}, {}
    for id_, endpoint, at, outcome, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        s = state.setdefault(endpoint, dict(ok=0, bad=0, run=0, ewma=None, status=None, until=None))
        if outcome == "success":
            s.update(ok=s["ok"] + 1, run=0, until=None, status="healthy")
            s["ewma"] = ms if s["ewma"] is None else s["ewma"] * 0.8 + ms * 0.2
        else:
            s.update(bad=s["bad"] + 1, run=s["run"] + 1)
            if outcome in fv.ROTATING_OUTCOMES:
                s.update(status="cooldown", until=at + dt.timedelta(seconds=120))
            else:
                s["status"] = "degraded"
        streaks[id_] = s["run"]
    return state, streaks


@pytest.fixture(scope="module")
def skewed_log():
    rnd = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        endpoint = 1 if rnd.random() < 0.4 else rnd.randrange(2, 40)
        at = start + dt.timedelta(seconds=rnd.randrange(0, 4000))  # many equal timestamps
        rows.append((i, endpoint, at, rnd.choice(["success", "timeout", "cancelled", "success"]), rnd.random() * 100))
    return rows


@pytest.mark.parametrize("seconds", [1, 60, 100_000])
def test_health_equals_sequential_fold(spark, skewed_log, seconds):
    df = spark.createDataFrame(skewed_log, "id long, endpoint_id long, attempted_at timestamp, outcome string, duration_ms double")
    state, streaks = sequential_health(skewed_log)
    for r in att.endpoint_health(df, seconds).collect():
        s = state[r.endpoint_id]
        assert (r.success_count, r.failure_count, r.consecutive_failures, r.status) == (s["ok"], s["bad"], s["run"], s["status"])
        assert r.cooldown_until == s["until"]
        assert r.ewma_latency_ms == pytest.approx(s["ewma"], rel=1e-9) if s["ewma"] is not None else r.ewma_latency_ms is None
    got = {r.id: r.consecutive_failures for r in att.failure_streaks(df, seconds).select("id", "consecutive_failures").collect()}
    assert got == streaks


def test_never_successful_endpoint(rows):
    t = dt.datetime(2024, 1, 1)
    df = rows([(1, 1, t, "cancelled", 1.0), (2, 1, t, "forbidden", 1.0)], "id long, endpoint_id long, attempted_at timestamp, outcome string, duration_ms double")
    r = att.endpoint_health(df).first()
    assert (r.success_count, r.failure_count, r.consecutive_failures, r.status, r.ewma_latency_ms) == (0, 2, 2, "cooldown", None)


def test_least_latency_rank(rows):
    df = rows([(1, 1, 50.0, 0), (2, 1, 10.0, 3), (3, 1, None, 0), (4, 1, 30.0, 0)], "id int, pool_id int, ewma_latency_ms double, failure_count int")
    assert [r.id for r in att.rank_endpoints(df, "least_latency").orderBy("rank").collect()] == [2, 4, 1, 3]
    assert [r.id for r in att.rank_endpoints(df, "failover", first=1).collect()] == [4]


def test_reset_unknown_pool_is_an_error(rows):
    pools = rows([(1, "a")], "id int, name string")
    ep = rows([(1, 1, "cooldown", 3, None)], "id int, pool_id int, status string, consecutive_failures int, cooldown_until timestamp")
    with pytest.raises(ValueError):
        att.reset_endpoints(ep, pools, "b")


def test_import_endpoints(rows):
    df = rows([("http://h.test:8080", None, None, []), ("socks5h://h.test:1080", "env:X", 0, ["a"]), ("http://user:pass@h.test", None, 1, []),
               ("ftp://h.test", None, 1, []), ("nonsense", None, 1, [])], "uri string, secret_ref string, weight int, tags array<string>")
    good, bad = readers.import_endpoints(df)
    assert sorted((r.uri, r.protocol, r.dns_mode, r.weight) for r in good.collect()) == [
        ("http://h.test:8080", "http", "local", 1), ("socks5h://h.test:1080", "socks5_host", "remote", 1)]
    assert sorted(r.code for r in bad.collect()) == ["endpoint.inline_credentials", "endpoint.invalid_uri", "endpoint.unsupported_scheme"]
    assert all("pass" not in r.message for r in bad.collect())


FORMATS = {
    "text": "# list\nhttps://EXAMPLE.test:443/a.pdf\n\n  https://example.test/a.pdf#x \n",
    "csv": 'url,title,snippet\n"https://EXAMPLE.test:443/a.pdf","A ""q"", t",s\nhttps://example.test/a.pdf,B,s\n',
    "json": '{"results":["https://EXAMPLE.test:443/a.pdf",{"url":"https://example.test/a.pdf","title":"B"},{"url":7}]}',
    "ndjson": '{"url":"https://EXAMPLE.test:443/a.pdf"}\n{"url":"https://example.test/a.pdf"}\n{"title":"x"}\nnot json\n',
    "har": '{"log":{"entries":[{"request":{"url":"https://EXAMPLE.test:443/a.pdf"}},{"request":{"url":"https://example.test/a.pdf"}}]}}',
}


@pytest.mark.parametrize("fmt", sorted(FORMATS))
def test_import_formats(spark, tmp_path, fmt):
    path = tmp_path / f"urls.{fmt}"
    path.write_text(FORMATS[fmt])
    known = spark.createDataFrame([], "canonical_url string")
    out = readers.import_discovery(spark, [(str(path), fmt)], known).collect()
    assert [(r.canonical_url, r.provider_id) for r in out] == [("https://example.test/a.pdf", f"import:{fmt}")]


def test_import_maximum_counts_raw_values(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("".join(f"https://example.test/{i}\n" for i in range(10)))
    known = spark.createDataFrame([], "canonical_url string")
    assert readers.import_discovery(spark, [(str(path), "text")], known, maximum=3).count() == 3


def office(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return bytearray(buffer.getvalue())


def test_office_goldens(rows):
    core = "<c xmlns:dc='d'><dc:creator>Ann</dc:creator><dc:title>T</dc:title></c>"
    app = "<p><Application>Word</Application><Company>Org</Company></p>"
    files = rows([("ok", office({"docProps/core.xml": core, "docProps/app.xml": app})), ("bad", office({"../docProps/core.xml": core})),
                  ("odf", office({"meta.xml": "<m><generator>Gen</generator><editing-cycles>3</editing-cycles></m>"})), ("broken", bytearray(b"PK\x03\x04zz"))],
                 "artifact_id string, content binary")
    entries = containers.container_entries(files)
    got = sorted((r.artifact_id, r.category, r.original_value) for r in containers.office_properties(entries).collect())
    assert got == [("odf", "application", "Gen"), ("odf", "revision", "3"), ("ok", "application", "Word"), ("ok", "author", "Ann"),
                   ("ok", "company", "Org"), ("ok", "title", "T")]
    notes = {r.artifact_id: r.code for r in containers.container_diagnostics(entries).collect()}
    assert notes == {"bad": "zip.path_traversal", "broken": "zip.invalid"}


def test_cumulative_budget_stops_at_first_overflow(rows):
    from casegraph.operators.observations import cumulative_budget

    df = rows([("a", i, 40) for i in range(4)], "artifact_id string, entry_no int, size long")
    out = cumulative_budget(df, ["artifact_id"], ["entry_no"], "size", 100).orderBy("entry_no").collect()
    assert [r.within_budget for r in out] == [True, True, False, False]


def test_text_goldens(rows):
    text = "full address:s:rdp.example.test\r\nAddress=ica.example.test\rPassword=secret\n=x\nkey=\nmail a.b@Example.test, x@y.zz9\n\u00e9x@site.org"
    df = rows([("t", text)], "artifact_id string, text string")
    kv = {(r.category, r.original_value, r.location) for r in text_extract.text_key_values(df).collect()}
    assert kv == {("server", "s:rdp.example.test", "line:1"), ("server", "ica.example.test", "line:2"),
                  ("credential_indicator", "[redacted]", "line:3")}
    assert {r.original_value for r in text_extract.text_emails(df).collect()} == {"a.b@Example.test", "\u00e9x@site.org"}


def test_binary_strings_utf16_with_broken_units(rows):
    wide = "mail@wide.test ".encode("utf-16-le") + b"\x00\xd8\xff" + "x".encode()
    df = rows([("w", bytearray(wide)), ("n", bytearray(b"\xff\xd8a@b.test\0\\\\srv\\share\\f\0http://h.test/x\0"))], "artifact_id string, content binary")
    got = {(r.artifact_id, r.category, r.original_value) for r in text_extract.binary_strings(df).collect()}
    assert ("w", "email", "mail@wide.test") in got
    assert {("n", "unc_path", "\\\\srv\\share\\f"), ("n", "hostname", "srv"), ("n", "url", "http://h.test/x")} <= got


def test_magic_kinds_and_risk(rows):
    risky = b"MZ\0DDEAUTO\0https://malware.example.test/payload"
    df = rows([("p", "/x/a.txt", bytearray(b"%PDF-1.4")), ("s", "/x/a.bin", bytearray(b"<?xml?><SVG/>")), ("r", "/x/a.rdp", bytearray(b"a:s:b")),
               ("g", "/x/a.gif", bytearray(b"GIF89a\0")), ("e", "/x/empty", bytearray(b"")), ("m", "/x/deceptive.pdf", bytearray(risky))],
              "artifact_id string, original_path string, content binary").withColumns({
                  "size": F.octet_length("content").cast("long"), "sha256": F.sha2("content", 256)})
    kinds = art.magic_kind(df)
    assert {r.artifact_id: r.kind for r in kinds.collect()} == {"p": "pdf", "s": "svg", "r": "rdp", "g": "unknown", "e": "text", "m": "unknown"}
    risk = {(r.kind, r.severity) for r in art.static_risk(kinds).filter("artifact_id = 'm'").collect()}
    assert risk == {("sha256", "informational"), ("entropy", "informational"), ("mime_mismatch", "medium"), ("embedded_executable", "high"),
                    ("dde", "high"), ("url", "informational")}


def test_pdf_strings(rows):
    body = (b"%PDF-1.4 /Author (J\\151m \\(x\\) \\\\n) /Title<feff00e900> /Keywords (a(b)c) /Producer %c\n (P) /Title (second)")
    got = {(r.category, r.original_value, r.location) for r in art.pdf_info(rows([("a", bytearray(body))], "artifact_id string, content binary")).collect()}
    assert got == {("author", "Jim (x) \\n", "pdf/info/Author"), ("title", "\u00e9", "pdf/info/Title"), ("application", "P", "pdf/info/Producer"),
                   ("title", "second", "pdf/info/Title:1")}


def test_unclean_text_is_kept(rows):
    from casegraph.plans.registry import default_extractors

    pdf = "%PDF-1.4\xff <x:xmpmeta xmlns:x='x'><dc:creator>".encode("latin-1") + "J\u00e9".encode() + b"</dc:creator></x:xmpmeta>"
    df = rows([("t", "text", bytearray(b"\xc3\x28\nusername=ann\n")), ("p", "pdf", bytearray(pdf)), ("i", "image", bytearray(b""))],
              "artifact_id string, kind string, content binary").withColumn("size", F.octet_length("content").cast("long"))
    observations, notes = default_extractors().extract(df)
    got = {(r.artifact_id, r.category, r.original_value) for r in observations.collect()}
    assert ("t", "username", "ann") in got and ("p", "author", "J\u00e9") in got
    assert [(r.artifact_id, r.code) for r in notes.collect()] == [("i", "extractor.unsupported")]


def test_full_local_flow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rdp").write_text("full address:s:rdp.example.test\nusername:s:ann\n")
    (tmp_path / "in" / "b.docx").write_bytes(bytes(office({"[Content_Types].xml": "<t/>", "docProps/core.xml": "<c><creator>Ann</creator></c>"})))
    (tmp_path / "in" / "copy.docx").write_bytes((tmp_path / "in" / "b.docx").read_bytes())
    found, rejected = readers.scan_artifacts(spark, str(tmp_path / "in"), max_bytes=100_000)
    assert rejected.count() == 0
    observations, notes = analyze(found, F.lit("2024-01-01").cast("timestamp"))
    assert {(r.category, r.original_value) for r in observations.collect()} == {("server", "s:rdp.example.test"), ("username", "s:ann"), ("author", "Ann")}
    assert notes.count() == 0
    assert art.dedup_artifacts(found.select("sha256", "acquired_at", "original_path")).count() == 2


def test_site_map_depth_and_budget(rows):
    root = "https://h.test/"
    links = rows([(root, 0, root + "a", "A"), (root, 1, root + "b", "B"), (root, 2, "https://other.test/x", "X"), (root + "a", 0, root + "c", "C"),
                  (root + "b", 0, root + "d", "D"), (root + "c", 0, root + "e", "E"), (root + "a", 1, root, "home")],
                 "source_url string, position int, url string, text string")
    roots = rows([(root,)], "root string")
    got = lambda depth, pages: {(r.url[15:], r.depth) for r in discovery.site_map(links, roots, depth, pages).collect()}
    assert got(0, 10) == {("a", 1), ("b", 1)}
    assert got(1, 10) == {("a", 1), ("b", 1), ("c", 2), ("d", 2), ("", 2)}
    assert got(2, 10) == {("a", 1), ("b", 1), ("c", 2), ("d", 2), ("", 2), ("e", 3)}
    assert got(5, 2) == {("a", 1), ("b", 1), ("c", 2), ("", 2)}  # root and `a` only


def test_site_map_visits_every_page_of_a_large_host(rows):
    root, n = "https://h.test/", 10_500
    links = rows([(root, k, f"{root}p{k}", "P") for k in range(n)] + [(f"{root}p{k}", 0, f"{root}q{k}", "Q") for k in range(n)],
                 "source_url string, position int, url string, text string")
    found = discovery.site_map(links, rows([(root,)], "root string"), 2)
    assert {(r.url[15:], r.depth) for r in found.collect()} == {(f"p{k}", 1) for k in range(n)} | {(f"q{k}", 2) for k in range(n)}


def test_wildcard_sets(rows):
    answers = rows([("d", "same", "1"), ("d", "same", "2"), ("d", "subset", "1"), ("d", "more", "1"), ("d", "more", "2"), ("d", "more", "3"), ("d", "none", None),
                    ("e", "n", "1")], "domain string, name string, address string")
    probes = rows([("d", "1"), ("d", "2")], "domain string, address string")
    assert sorted(r.name for r in discovery.wildcard_suppressed_names(answers, probes).collect()) == ["more", "n", "subset"]


def correlated(rows):
    t = dt.datetime(2024, 1, 1)
    obs = rows([("o1", "a1", "email", "A@x.test", "a@x.test", "e", "line:1", 0.9, t), ("o2", "a2", "email", "a@x.test", "a@x.test", "e", None, 0.5, t),
                ("o3", "a2", "title", "T", "T", "e", None, 1.0, t), ("o4", "a3", "email", "b@x.test", "b@x.test", "e", None, 1.0, t)],
               "id string, artifact_id string, category string, original_value string, normalized_value string, extractor string, location string, confidence double, observed_at timestamp")
    arts = rows([("a1", "r1", "h1", "/p/one", None, t), ("a2", "r1", "h2", None, "https://u:p@x.test/two?q=1", t), ("a3", "r2", "h3", None, None, t)],
                "id string, run_id string, sha256 string, original_path string, source_uri string, acquired_at timestamp")
    runs = rows([("r1", "p"), ("r2", "other")], "id string, project_id string")
    return obs, arts, runs


def test_correlation_is_idempotent(rows):
    obs, arts, runs = correlated(rows)
    scoped = correlate.observations_in_project(obs, arts, runs, "p")
    entities, relations, evidence = correlate.build_entities(scoped), correlate.build_relations(scoped), correlate.build_evidence(scoped)
    assert {(r.type, r.value, r.confidence) for r in entities.collect()} == {
        ("email", "A@x.test", 0.9), ("artifact", "/p/one", 1.0), ("artifact", "https://u:p@x.test/two?q=1", 1.0)}
    ids = {r.id for r in entities.collect()}
    edges = relations.collect()
    assert len(edges) == 2 and all({e.from_entity_id, e.to_entity_id} <= ids for e in edges)
    assert {e.evidence_id for e in edges} == {r.id for r in evidence.collect()}
    assert correlate.build_entities(scoped, entities).count() == 0
    assert correlate.build_relations(scoped, relations).count() == 0
    assert correlate.build_evidence(scoped, evidence).count() == 0


def test_redacted_report_leaks_nothing(spark, rows, tmp_path):
    obs, arts, runs = correlated(rows)
    runs = runs.withColumns({"command": F.lit("c"), "status": F.lit("completed"), "created_at": F.lit("2024-01-01").cast("timestamp"),
                             "started_at": F.lit(None).cast("timestamp"), "finished_at": F.lit(None).cast("timestamp")})
    scoped = correlate.observations_in_project(obs, arts, runs, "p")
    tables = {"projects": rows([("p", "n", "/secret/root")], "id string, name string, root_path string"), "runs": runs,
              "artifacts": arts.withColumn("stored_path", F.lit("/store")), "observations": obs, "evidence": correlate.build_evidence(scoped),
              "entities": correlate.build_entities(scoped)}
    out = writers.sink_report_tables(build_report(tables, "p", redact=True), str(tmp_path / "report"))
    content = "\n".join(r.value for path in out.values() for r in spark.read.text(path).collect())
    assert "x.test\"" not in content and "u:p" not in content and "/secret" not in content and "/p/one" not in content and "/store" not in content
    assert "h1" in content and "[redacted:" in content


def test_graph_escaping(rows):
    import xml.etree.ElementTree as ET

    nodes = rows([("n1", "author", 'A & <B> "q" \\ \n x'), ("n2", "artifact", "p")], "id string, type string, value string")
    edges = rows([("e1", "n2", "n1", "contains")], "id string, from_entity_id string, to_entity_id string, type string")
    for fmt in ("graphml", "gexf"):
        ET.fromstring("".join(r.line for r in graph_export.graph_lines(nodes, edges, fmt).collect()).encode())
    dot = [r.line for r in graph_export.graph_lines(nodes, edges, "dot").collect()]
    assert dot[0].startswith("digraph") and dot[-1] == "}" and '\\"q\\" \\\\ \\n x' in dot[1]


def test_csv_sink(spark, rows, tmp_path):
    entities = rows([("1", "author", "=cmd", 'a"b', 1.0)], "id string, type string, value string, normalized_value string, confidence double")
    view = writers.csv_view("entities", entities, redact=False).first()
    assert view.value == "'=cmd" and view.normalized_value == 'a"b'
    assert writers.csv_view("entities", entities, redact=True).first().value.startswith("[redacted:")


def test_requeue(rows):
    df = rows([(1, "failed", "e"), (2, "pending", None), (3, "scope_rejected", "r")], "id int, status string, last_error string")
    assert {(r.id, r.status, r.last_error) for r in report.requeue_failed(df).collect()} == {(1, "pending", None), (2, "pending", None), (3, "scope_rejected", "r")}


@pytest.mark.parametrize("partitions", ["1", "64"])
def test_results_do_not_depend_on_partitioning(spark, skewed_log, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(skewed_log, "id long, endpoint_id long, attempted_at timestamp, outcome string, duration_ms double")
        got = {r.id: r.consecutive_failures for r in att.failure_streaks(df).select("id", "consecutive_failures").collect()}
        assert got == sequential_health(skewed_log)[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_captures_of_pages_that_share_a_url(rows, monkeypatch):
    """Each page's successor is captured at that page's own first link, also when another page has its URL."""
    from queries import discovery_queries as dq

    link = lambda *paths: "".join(f'<a href="{p}">x</a>' for p in paths)
    given = rows([
        (0, "http://a.test/", link("/p")), (1, "http://b.test/", link("/q")), (5, "http://a.test/", link("/r")), (6, "http://c.test/", link("/s")),
    ], "page_id long, url string, html string")
    monkeypatch.setattr(dq, "pages", lambda spark, d: given)
    got = sorted((r.source_url, r.url) for r in dq.captured_links(None, None).collect())
    assert got == [
        ("http://a.test/", "http://a.test/p"), ("http://a.test/", "http://a.test/r"), ("http://a.test/p", "http://a.test/q"),
        ("http://a.test/r", "http://a.test/s"), ("http://b.test/", "http://b.test/q"), ("http://c.test/", "http://c.test/s")]


def test_addresses_are_dealt_out_in_blocks(spark, rows):
    """One wide range among small ones: every address once, and no task makes more than a share of them."""
    given = ["10.1.0.0/16", "10.2.3.4/32", "2001:db8::/114", "::/115", "2001:db8:0:0:1::40:0/113", "fe80::1:0:0:0/119"]
    found = discovery.expand_cidr(rows([(c,) for c in given], "cidr string").coalesce(1))
    want = sorted((c, str(a)) for c in given for a in ipaddress.ip_network(c, strict=False))
    assert sorted((r.cidr, r.address) for r in found.collect()) == want
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < len(want) / 3


def test_scan_lists_and_hashes_in_tasks(spark, tmp_path):
    """Folders of files, hidden ones and other names apart: the rows of a scan with content, whose bytes are not kept."""
    for name, data in (("a.txt", b"a"), ("b.tmp", b"b"), ("_c.txt", b"c"), ("deep/d.txt", b"d" * 3_000_000), ("deep/er/e f.txt", b"e"), (".h/g.txt", b"g"), ("deep/big.txt", b"x" * 9_000_000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    view = lambda found: sorted(tuple(r) for r in found.select("artifact_id", "original_path", "size", "acquired_at", "sha256").collect())
    for options in ({"pattern": "*.txt"}, {"pattern": "*.txt", "max_bytes": 5_000_000}, {"recursive": False}, {"max_files": 2}):
        found, rejected = readers.scan_artifacts(spark, str(tmp_path), content=False, **options)
        whole, refused = readers.scan_artifacts(spark, str(tmp_path), **options)
        assert view(found) == view(whole) and sorted(rejected.collect()) == sorted(refused.collect())
        assert "content" not in found.columns and found.count() > 0


def test_written_files_are_dealt_out_to_folders(spark, rows, tmp_path):
    import os

    from queries.standins import write_files

    write_files(rows([(f"{k}.txt", bytearray(b"x")) for k in range(2000)], "name string, content binary"), str(tmp_path / "out"))
    folders = [len(files) for _, _, files in os.walk(tmp_path / "out") if files]
    assert sum(folders) == 2000 and max(folders) < 50


def test_evidence_flow_keeps_customers_of_one_name_apart(spark, tmp_path):
    from compare import TABLES, compare, connect

    import __spark_entry__ as contract

    for name in TABLES:
        if name != "customer":
            (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").limit(40).withColumn("c_name", F.lit("Ann")).coalesce(1).write.parquet(f"{tmp_path}/out")
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "customer.parquet")
    query = contract.queries()["evidence_flow"]
    assert compare(query(spark, str(tmp_path)), connect(str(tmp_path)), contract.oracle_sql()["evidence_flow"]) is None


def test_timeline_reads_every_spelling_of_a_date(rows):
    """Spellings with and without blanks around, the original where the normalized text is no date, and no others."""
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    dated = [
        ("a", "2024:01:02 03:04:05", "2024:01:02 03:04:05"), ("b", None, " D:20240102050405+02'00'\n"), ("c", "none at all", "2024-01-02T03:04:05Z"),
        ("d", "\tTue, 02 Jan 2024 03:04:05 GMT ", "soon"), ("e", "01/02/2024 03:04:05", None), ("f", "2024:13:02 03:04:05", "2024-01-02 03:04:05"),
    ]
    others = [("g", "2024:13:02 03:04:05", "2024:13:02 03:04:05"), ("h", None, None), ("i", "é024:01:02 03:04:05", "D:2024:01:02"), ("j", "true", "true")]
    observed = rows([(i, "Date", o, n) for i, n, o in dated + others], "id string, category string, original_value string, normalized_value string")
    out = report.timeline(*_no_runs(rows), observed).collect()
    assert [tuple(r) for r in out] == [(at, "metadata_date", i, o) for i, _, o in dated]


def test_timeline_parses_dates_in_compiled_code(rows):
    """The sort computes its rows twice, so no lambda (interpreted row by row) may stand in their dates."""
    observed = rows([("a", "Date", "2024-01-02", "2024-01-02")], "id string, category string, original_value string, normalized_value string")
    plan = report.timeline(*_no_runs(rows), observed)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def _no_runs(rows):
    return (
        rows([], "id string, command string, status string, created_at timestamp, started_at timestamp, finished_at timestamp"),
        rows([], "id string, acquired_at timestamp, sha256 string"),
    )
