"""No extractor stops early, reads a prefix, slows down on long runs or mistakes an encoding."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from casegraph.functions import http, net
from casegraph.operators import artifacts as art
from casegraph.operators import containers, discovery, text_extract, xml_extract
from casegraph.plans.registry import default_extractors


def zipped(parts: dict[str, bytes]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in parts.items():
            archive.writestr(name, data)
    return bytearray(out.getvalue())


def test_many_matches_per_text(rows):
    body = "".join(f"u{k}@mail.example.com\x00ftp://h{k}.example.com/x\x00" for k in range(2500)).encode()
    df = rows([("a", bytearray(body))], "artifact_id string, content binary")
    got = text_extract.legacy_indicators(df).groupBy("category").count().collect()
    assert {(r.category, r["count"]) for r in got} == {("email", 2500), ("url", 2500)}
    few = text_extract.legacy_indicators(df, limit=10).groupBy("category").count().collect()
    assert {r["count"] for r in few} == {10}
    assert text_extract.binary_strings(df).filter("category = 'email'").count() == 2500


def test_long_values_are_kept_whole(rows):
    url, creator = "http://example.com/" + "p" * 9000, "c" * 20_000
    text = f"{url}\x00<dc:creator>{creator}</dc:creator>".encode()
    df = rows([("a", bytearray(text))], "artifact_id string, content binary")
    got = {(r.category, r.original_value) for r in text_extract.binary_strings(df).collect()}
    assert ("url", url) in got and ("author", creator) in got


@pytest.mark.parametrize("run", ["a", "1.", "a@"])
def test_ten_megabytes_of_one_run(rows, run):
    df = rows([("a", bytearray((run * (10_000_000 // len(run))).encode()))], "artifact_id string, content binary")
    start = time.perf_counter()
    text_extract.legacy_indicators(df).count()
    assert time.perf_counter() - start < 60


def test_email_pattern_finds_what_the_plain_one_does(rows):
    from casegraph import fixed_values as fv

    plain = rf"[{fv.WORD}.+-]+@[{fv.WORD}.-]+\.[A-Za-z]{{2,}}"
    texts = ["a@b.cd@e.fg", "x a@b.cd.ef-@g.hi", "..@a.bc", "a@b@c.de", "é.ü+x@dömain.org1", "a@b.c", "@a.bc", "p@q.rs_t@u.vw", "a-a@b.co-b@c.de"]
    df = rows([(t,) for t in texts], "t string")
    for r in df.select("t", F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("p"), F.regexp_extract_all("t", F.lit(fv.EMAIL_UNGUARDED), F.lit(0)).alias("g")).collect():
        assert r.p == r.g, r.t


@pytest.mark.parametrize("mark,encoding", [(b"", "utf-8"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be")])
def test_text_encodings(rows, mark, encoding):
    text = "full address:s:srv.example.test\r\npassword 51:b:0102\r\nusername:s:José\r\n"
    df = rows([("a", "a.rdp", bytearray(mark + text.encode(encoding)))], "artifact_id string, original_path string, content binary")
    df = art.magic_kind(df.withColumn("size", F.octet_length("content").cast("long")))
    observations, notes = default_extractors().extract(df)
    got = {(r.category, r.original_value) for r in observations.collect()}
    assert got == {("server", "s:srv.example.test"), ("credential_indicator", "[redacted]"), ("username", "s:José")} and notes.count() == 0
    unnamed = art.magic_kind(df.withColumn("original_path", F.lit("a")).drop("kind", "mime_type"))
    assert mark == b"" or unnamed.first().kind == "text"


@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1", "utf-16"])
def test_declared_xml_encodings(rows, encoding):
    core = f'<?xml version="1.0" encoding="{encoding}"?><c><creator>José</creator></c>'
    df = rows([("a", zipped({"docProps/core.xml": core.encode(encoding)}))], "artifact_id string, content binary")
    assert [(r.category, r.original_value) for r in containers.office_properties(containers.container_entries(df)).collect()] == [("author", "José")]
    decoded = rows([("a", core)], "artifact_id string, xml string")
    assert [r.value for r in xml_extract.xml_nodes(decoded).filter("name = 'creator'").collect()] == ["José"]


def test_broken_parts_leave_a_diagnostic(rows):
    df = rows([("a", zipped({"docProps/core.xml": b"<c><creator>", "docProps/app.xml": b"<p><Company>X</Company></p>"}))], "artifact_id string, content binary")
    entries = containers.container_entries(df)
    assert [(r.code, r.is_error) for r in containers.container_diagnostics(entries).collect()] == [("xml.invalid", False)]
    assert containers.office_properties(entries).count() == 1


def test_container_limits_only_when_asked(rows):
    df = rows([("a", zipped({f"f{k}": b"x" * 10 for k in range(12_000)}))], "artifact_id string, content binary")
    assert containers.container_entries(df).filter("within_entries AND within_budget").count() == 12_000
    codes = containers.container_diagnostics(containers.container_entries(df, max_entries=100, max_bytes=500)).collect()
    assert {r.code for r in codes} == {"zip.entry_budget", "zip.size_budget"}


def test_large_sitemap_and_deep_xml(rows):
    xml = "<urlset>" + "".join(f"<url><loc>http://h.test/{k}</loc></url>" for k in range(50_000)) + "</urlset>"
    assert xml_extract.sitemap_locations(rows([("s", xml)], "source string, xml string")).count() == 50_000
    deep = "<a>" * 500 + "x" + "</a>" * 500
    assert xml_extract.xml_nodes(rows([("s", deep)], "source string, xml string")).first().depth == 499


def test_markers_behind_a_long_prefix(rows):
    df = rows([(200, "x" * 200_000 + "captcha wp-content")], "s int, b string")
    r = df.select(http.classify_outcome(F.col("s"), F.col("b")).alias("o"), http.detect_technology(F.lit(None), F.lit(None), F.col("b")).alias("t")).first()
    assert (r.o, r.t) == ("challenge", "WordPress")


def test_ranges_are_judged_by_their_ends(rows):
    import ipaddress

    cidrs = ["8.8.8.0/24", "8.0.0.0/5", "172.0.0.0/8", "172.32.0.0/11", "192.166.0.0/15", "192.168.0.0/13", "192.168.5.5/32", "1.1.1.1/32", "0.0.0.0/0", "2001:4860::/32", "::/0", "fe00::/8", "2606:4700::/32"]
    df = rows([(c,) for c in cidrs], "cidr string")
    got = {r.cidr for r in discovery.non_public_ranges(df).collect()}
    from casegraph import fixed_values as fv

    blocks = [ipaddress.ip_network(p) for p in [*fv.NON_PUBLIC_V4, *fv.NON_PUBLIC_V6]]
    expected = {c for c in cidrs if any(b.version == ipaddress.ip_network(c, strict=False).version and b.overlaps(ipaddress.ip_network(c, strict=False)) for b in blocks)}
    assert got == expected
    edges = df.select("cidr", net.last_hex(net.cidr_network(F.col("cidr")), net.cidr_prefix(F.col("cidr"))).alias("last")).collect()
    assert {r.cidr: int(r.last, 16) for r in edges} == {c: int(ipaddress.ip_network(c, strict=False).broadcast_address) for c in cidrs}


def test_expansion_has_no_limit_of_its_own(rows):
    df = rows([("10.0.0.0/14",), ("2001:db8::/112",)], "cidr string")
    assert {(r.cidr, r["count"]) for r in discovery.expand_cidr(df).groupBy("cidr").count().collect()} == {("10.0.0.0/14", 1 << 18), ("2001:db8::/112", 1 << 16)}
    assert discovery.expand_cidr(df, budget=3).count() == 6


def test_candidates_without_a_limit_are_not_sorted_into_one_task(rows):
    resources, roots = rows([(1, "http://a.test/x.doc")], "page_id long, url string"), rows([("http://a.test/",)], "root string")
    plan = discovery.union_candidates(resources, roots, None, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert discovery.union_candidates(resources, roots, 3, "page_id").count() == 3


def test_equal_properties_are_two_observations(rows):
    from casegraph.operators.correlate import unanalyzed_artifacts
    from casegraph.operators.observations import with_identity

    core = b"<c><creator>Ann</creator><creator>Ann</creator></c>"
    df = rows([("a", zipped({"docProps/core.xml": core}))], "artifact_id string, content binary")
    found = with_identity(containers.office_properties(containers.container_entries(df)), F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(found) == 2 and len({r.id for r in found}) == 2
    artifacts, seen = rows([("a",), ("b",), ("c",)], "id string"), rows([("a",)], "artifact_id string")
    assert {r.id for r in unanalyzed_artifacts(artifacts, seen).collect()} == {"b", "c"}
    assert {r.id for r in unanalyzed_artifacts(artifacts, seen, rows([("b",)], "artifact_id string")).collect()} == {"c"}


def test_links_as_an_html_reader_sees_them(rows):
    html = (
        '<a data-href="/no" href="/yes">one</a><!-- <a href="/hidden">x</a> --><script>var s = \'<a href="/script">y</a>\';</script>'
        "<a title='a > b' HREF = '/two'>two &hearts; &Eacute;</a><a name=x>none</a><a href=/three?a=1&amp;b=2 class=k>th<b>re</b>e</a><abbr href='/no'>z</abbr>"
        '<A\nhref="/four">&lt;four&gt; &amp;lt; &#233;&#x41;</A><style>a {}</style><a href="/five">five<!-- unclosed <a href="/gone">q</a>')
    got = discovery.extract_links(rows([("http://h.test/d/", html)], "url string, html string")).orderBy("position").collect()
    assert [(r.position, r.url, r.text) for r in got] == [
        (0, "http://h.test/yes", "one"), (1, "http://h.test/two", "two \u2665 \u00c9"), (2, "http://h.test/three?a=1&b=2", "three"),
        (3, "http://h.test/four", "<four> &lt; \u00e9A"), (4, "http://h.test/five", "five")]


def test_user_info_beside_an_ascii_host(rows):
    from casegraph.functions import urls

    df = rows([("https://\u00fcser@E.test/a",), ("https://b\u00fccher.test/a",)], "u string")
    assert [r.c for r in df.select(urls.canonical_url(F.col("u")).alias("c")).collect()] == ["https://%C3%BCser@e.test/a", None]
    assert {r.u: r.c for r in urls.with_canonical_url(df, "u", "c").collect()} == {
        "https://\u00fcser@E.test/a": "https://%C3%BCser@e.test/a", "https://b\u00fccher.test/a": "https://xn--bcher-kva.test/a"}


def test_every_prefix_length_is_counted(rows):
    """Against the standard library: ranges across groups, and the first addresses of ranges that no one can list."""
    import ipaddress
    from itertools import islice

    cidrs = ["10.255.0.0/15", "192.0.2.255/32", "2001:db8::/110", "2001:db8:0:ffff::/111", "2001:db8::7/128", "::ffff:0:0/116"]
    got = {}
    for r in discovery.expand_cidr(rows([(c,) for c in cidrs], "cidr string")).collect():
        got.setdefault(r.cidr, []).append(r.address)
    for c in cidrs:
        expected = {str(a) if a.version == 4 else a for a in ipaddress.ip_network(c, strict=False)}
        assert len(got[c]) == len(expected) and {a if ":" not in a else ipaddress.ip_address(a) for a in got[c]} == expected
    wide = ["2001:db8::/32", "2001:db8:1:2::/64", "::/0", "0.0.0.0/0", "2001:db8::fffe/127", "198.51.100.0/30"]
    for budget in (1, 3, 70_000):
        first = {}
        for r in discovery.expand_cidr(rows([(c,) for c in wide], "cidr string"), budget=budget).collect():
            first.setdefault(r.cidr, []).append(int(ipaddress.ip_address(r.address)))
        for c in wide:
            net = ipaddress.ip_network(c, strict=False)
            assert sorted(first[c]) == [int(net.network_address) + k for k in range(min(budget, net.num_addresses))]


def test_candidate_names_without_and_with_a_budget(rows):
    labels = [(f" L{k} ", k) for k in range(2500)] + [("l7", 0), ("bad label", -2), ("", -1), ("-x", 5000)]
    domains = [f"d{k}.test" for k in range(30)] + ["dot.test."]
    df, dom = rows(labels, "label string, o long"), rows([(d,) for d in domains], "domain string")
    got = {(r.name, r.domain) for r in discovery.candidate_names(df, dom, ["o"], block=64, salts=3).collect()}
    assert got == {(f"l{k}.{d.rstrip('.')}", d) for k in range(2500) for d in domains}
    some = discovery.candidate_names(df, dom, ["o"], budget=4).collect()
    assert len(some) == 3 * len(domains) and {r.label for r in some} == {"l0", "l7", "l1"}   # the bad label used the fourth
    plan = discovery.candidate_names(df, dom, ["o"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "broadcast" not in plan.lower()
    assert discovery.candidate_names(df.limit(0), dom, ["o"]).count() == 0


def test_ranged_containers_read_little(spark, tmp_path):
    """Large members stay unread; the rows equal those of whole contents, broken files included."""
    import random

    from casegraph.operators.artifacts import entry_risk
    from casegraph.sources import ranged

    noise = random.Random(1).randbytes(6_000_000)
    (tmp_path / "deep").mkdir()
    parts = {"word/media/big.bin": noise, "docProps/core.xml": b"<c><creator>Ann</creator></c>", "word/vbaProject.bin": b"m"}
    (tmp_path / "a.docx").write_bytes(bytes(zipped(parts)))
    (tmp_path / "deep" / "b.docx").write_bytes(bytes(zipped({"meta.xml": b"<m><creator>Bo</creator></m>"})))
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "skip.txt").write_bytes(b"x")
    entries = containers.ranged_entries(spark, str(tmp_path), pattern="*.docx")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(str(tmp_path)).select(
        F.sha2("path", 256).alias("x"), "path", "content")
    from casegraph.functions.text import stable_id

    expected = containers.container_entries(whole.select(stable_id(F.col("path")).alias("artifact_id"), "content"))
    order = ["artifact_id", "entry_no"]
    assert entries.orderBy(order).collect() == expected.select(entries.columns).orderBy(order).collect() and entries.count() == 5
    assert {r.original_value for r in containers.office_properties(entries).collect()} == {"Ann", "Bo"}
    assert {(r.kind, r.severity) for r in entry_risk(entries).collect()} == {("macro", "high"), ("container_error", "medium")}
    limited = containers.ranged_entries(spark, f"file:{tmp_path}", max_entries=1, pattern="a.*")
    assert [r.within_entries for r in limited.orderBy("entry_no").collect()] == [True, False, False]

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.taken += len(data)
            return data

    assert len(ranged.directory_rows(Counted((tmp_path / "a.docx").read_bytes()))) == 3 and Counted.taken < 100_000


@pytest.mark.parametrize("clock", [(2026, 12, 1, 9, 0, 0), (2026, 1, 26, 9, 0, 0), (2026, 2, 28, 9, 0, 0)])
def test_broken_stand_in_containers_hold_no_strings(monkeypatch, clock):
    """Packed bytes and time stamps read as text by chance: row 16279 gave an address, some days gave paths."""
    import pandas as pd

    import __spark_entry__  # noqa: F401
    from casegraph.operators.sweep import Scanner
    from queries.extraction_queries import _office_file

    keys = [*range(500), *range(16_270, 16_300)]
    row = [pd.Series([f"Customer#{k:09d}" for k in keys]), pd.Series(["MACHINERY"] * len(keys)), pd.Series([str(k) for k in keys])]
    now = _office_file.func(*row)
    monkeypatch.setattr(time, "localtime", lambda *_: time.struct_time((*clock, 0, 1, 0)))
    then = _office_file.func(*row)
    assert (now == then).all()
    scanner = Scanner(text_extract._string_patterns())
    for c in then:
        assert not any(scanner.matches(c.decode("latin-1"))) and not any(scanner.matches(c.decode("utf-16-le", "replace")))
        assert containers.directory_rows(io.BytesIO(c)) == [(-1, "File is not a zip file", 0, 0, None)]


def test_diagnostics_open_a_container_once(rows):
    """Each rule used to list all containers anew."""
    many = {f"e{k:03d}": b"x" for k in range(20)} | {"a/meta.xml": b"<x", "meta.xml": b"<x>", "../up": b""}
    df = rows([("a", zipped(many)), ("b", bytearray(b"PK\x03\x04zz")), ("c", None)], "artifact_id string, content binary")
    notes = containers.container_diagnostics(containers.container_entries(df))
    assert notes._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.artifact_id, r.code, r.is_error) for r in notes.collect()) == [
        ("a", "xml.invalid", False), ("a", "zip.path_traversal", True), ("b", "zip.invalid", True)]
    xml = [r.message for r in notes.filter("code = 'xml.invalid'").collect()]
    bad = xml_extract.xml_nodes(rows([("a", bytearray(b"<x>"))], "artifact_id string, xml binary")).first().value
    assert xml == [f"meta.xml: {bad}"]


def test_stand_in_tasks_do_not_grow_with_the_table(spark, tmp_path):
    """Artifact bytes were built by as many tasks as there are cores, whatever the size of the table."""
    import __spark_entry__  # noqa: F401
    from queries.extraction_queries import TASK_ROWS, customer

    n = 20 * TASK_ROWS
    columns = ["id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "'BUILDING' AS c_mktsegment"]
    spark.range(n).selectExpr(*columns).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = [r["count"] for r in customer(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) < 1.2 * TASK_ROWS


def test_long_files_are_hashed_in_stretches(spark, tmp_path):
    """No task reads more than a stretch of one file; the digests are those of the whole files."""
    import hashlib
    import random

    from casegraph.sources import ranged

    sizes = [0, 1, 999, 1000, 1001, 2000, 3517]
    bodies = {f"f{n}.bin": random.Random(n).randbytes(n) for n in sizes}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in ranged.file_digests(ranged.list_files(spark, str(tmp_path)), stretch=1000).collect()}
    assert got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
    import pandas as pd

    path, state, rounds = str(tmp_path / "f3517.bin"), None, []
    while not rounds or rounds[-1].sha256[0] is None:
        row = pd.DataFrame({"path": [path], "at": [1000 * len(rounds)], "state": [state]})
        rounds += ranged._advanced(1000)([row])
        state = rounds[-1].state[0]
    assert len(rounds) == 4 and rounds[-1].sha256[0] == got["f3517.bin"][1]


def test_files_of_a_store_that_only_spark_opens(spark, tmp_path):
    from casegraph.sources import readers

    (tmp_path / "a.txt").write_bytes(b"abc")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    found, _ = readers.scan_artifacts(spark, "viewfs://store/in", pattern="*.txt", content=False)
    assert [(r.size, r.sha256[:8]) for r in found.collect()] == [(3, "ba7816bf")] and "content" not in found.columns


def test_ranged_entries_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver lists no file; the data source over the same folder gives the same rows."""
    from casegraph.sources import ranged

    for k in range(40):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}" / f"{k}.docx").write_bytes(bytes(zipped({"meta.xml": b"<m/>" * k, "x" * k + ".bin": b"y" * (k * 3000)})))
    spark.dataSource.register(ranged.ContainerSource)
    order = ["path", "entry_no", "name", "size", "compressed_size", "xml"]
    expected = spark.read.format("zip_directory").option("path", str(tmp_path)).load().select(order).orderBy(order).collect()
    monkeypatch.setattr(ranged, "listed", lambda *a: pytest.fail("listed on the driver"))
    entries = containers.ranged_entries(spark, str(tmp_path), with_path=True)
    assert entries.select(order).orderBy(order).collect() == expected and len(expected) == 80
