"""Streaming XML rows: whole documents, encodings, errors behind many rows, memory."""

import subprocess
import sys
import os

from pyspark.sql import functions as F

from casegraph.operators import xml_extract
from casegraph.plans.registry import default_extractors

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_large_documents_are_streamed(rows):
    """A million elements over many Arrow batches, beside small ones and one that breaks at its end."""
    many = "<r>\n" + "".join(f"<a k='{i}'>v{i}</a>\n" for i in range(500_000)) + "</r>"
    df = rows([("big", many), ("cut", many[:-3]), ("small", "<x><y>1</y><!--c--></x>"), ("none", None), ("empty", ""), ("type", "<!DOCTYPE a><a/>")], "source string, xml string").coalesce(1)
    got = {(r.source, r.name): (r["count"], r.seqs) for r in xml_extract.xml_nodes(df).groupBy("source", "name").agg(F.count("*").alias("count"), F.max("seq").alias("seqs")).collect()}
    assert got == {("big", "a"): (1_000_000, 500_001), ("cut", "#error"): (1, 0), ("small", "y"): (1, 2), ("small", "#comment"): (1, 3), ("empty", "#error"): (1, 0), ("type", "#error"): (1, 0)}


def test_memory_does_not_grow_with_the_document():
    code = (
        "import resource, sys; sys.path.insert(0, %r)\n"
        "from casegraph.operators.xml_extract import node_rows\n"
        "def peak(n):\n"
        "    data = b'<r>' + b'<a>x</a>\\n' * n + b'</r>'; size = len(data)\n"
        "    base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "    total = sum(len(rows) for rows in node_rows(data))\n"
        "    assert total == n\n"
        "    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base\n"
        "peak(50_000); print(peak(2_000_000))\n") % ROOT
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 40_000


def test_declared_encodings_of_standalone_svg(rows):
    svg = "<?xml version='1.0' encoding='{}'?><svg xmlns:dc='d'><dc:creator>José €</dc:creator></svg>"
    docs = [(e, bytearray(svg.format(e).replace("€", "E").encode(e))) for e in ("iso-8859-1", "utf-8", "utf-16", "us-ascii") if e != "us-ascii"]
    docs += [("cp1252", bytearray(svg.format("windows-1252").encode("cp1252"))), ("bom", bytearray(b"\xef\xbb\xbf" + svg.format("utf-8").encode())), ("bad", bytearray(b"<svg><creator>\xff</creator></svg>"))]
    df = rows(docs, "artifact_id string, content binary").withColumns({"kind": F.lit("svg"), "size": F.octet_length("content").cast("long")})
    observations, notes = default_extractors().extract(df)
    got = {r.artifact_id: r.original_value for r in observations.filter("category = 'author'").collect()}
    assert got == {"iso-8859-1": "José E", "utf-8": "José E", "utf-16": "José E", "cp1252": "José €", "bom": "José €"}
    assert [(r.artifact_id, r.code) for r in notes.collect()] == [("bad", "svg.invalid")]


def test_table_function(spark, rows):
    xml_extract.register_xml_nodes(spark, "nodes_of")
    rows([("a", "<r n='1'><b>x</b></r>"), ("b", "<")], "id string, xml string").createOrReplaceTempView("xml_docs")
    got = spark.sql("SELECT id, n.name, n.attribute, n.value FROM xml_docs, LATERAL nodes_of(xml) n ORDER BY id, seq").collect()
    assert [tuple(r)[:3] for r in got] == [("a", "r", "n"), ("a", "b", None), ("b", "#error", None)]
