"""XML flattening and the jobs that read metadata from XML."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import fixed_values as fv
from casegraph import schemas
from casegraph.functions.binding import explode_rows, with_bound
from casegraph.functions.text import classify_reference, html_decode, map_xmp_property, not_blank, trim_ws
from casegraph.functions.urls import absolute_uri
from casegraph.operators.observations import observation_rows
from casegraph.operators.swept import packet_spans

ERROR = "#error"
COMMENT = "#comment"


class _BadXml(Exception):
    pass


PIECE = 1 << 16     # bytes parsed at once
ROWS = 8192         # rows of an Arrow batch, and rows held back until a document is known to be sound


class _Nodes:
    """Incremental reader of one document: rows (seq, depth, name, parent property, parent label, attribute, value) of its
    attributes, leaves and comments. The parent label is the `name` attribute of the parent element. What is held is the
    path from the root and the rows of the last piece."""

    def __init__(self, xml: str | bytes, silent: bool = False):
        if isinstance(xml, bytes) and xml[:4] in (b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff"):
            xml = xml.decode("utf-32", errors="replace")
        # decoded text is handed over as UTF-8, whatever its declaration says; bytes follow their own declaration
        self.data = xml.encode("utf-8") if isinstance(xml, str) else xml
        self.parser = expat.ParserCreate("utf-8" if isinstance(xml, str) else None)
        self.parser.buffer_text = True
        self.parser.StartDoctypeDeclHandler = self._doctype
        self.rows: list[tuple] = []
        self.stack: list[list] = []  # [seq, name, text parts, has child, name attribute]
        self.seq = 0
        if not silent:
            self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
            self.parser.CharacterDataHandler, self.parser.CommentHandler = self._text, self._comment

    def __iter__(self) -> Iterator[list[tuple]]:
        """Rows piece by piece; raises for a document that is not well-formed or declares a type."""
        for at in range(0, max(len(self.data), 1), PIECE):
            self.parser.Parse(self.data[at: at + PIECE], at + PIECE >= len(self.data))
            rows, self.rows = self.rows, []
            yield rows

    def _owner(self, name: str) -> str:
        for frame in reversed(self.stack):
            if frame[1].lower() not in fv.RDF_WRAPPERS:
                return frame[1]
        return name

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        self.seq += 1
        name = tag.rpartition(":")[2]
        parent, label = self._owner(name), self.stack[-1][4] if self.stack else None
        if self.stack:
            self.stack[-1][3] = True
            self.stack[-1][2].clear()
        for key, value in attributes.items():
            if key != "xmlns" and not key.startswith("xmlns:"):
                self.rows.append((self.seq, len(self.stack), name, parent, label, key.rpartition(":")[2], value))
        self.stack.append([self.seq, name, [], False, attributes.get("name")])

    def _end(self, tag: str) -> None:
        number, name, parts, has_child, _ = self.stack.pop()
        if not has_child:
            label = self.stack[-1][4] if self.stack else None
            self.rows.append((number, len(self.stack), name, self._owner(name), label, None, "".join(parts)))

    def _text(self, data: str) -> None:
        if self.stack and not self.stack[-1][3]:
            self.stack[-1][2].append(data)

    def _comment(self, data: str) -> None:
        self.seq += 1
        self.rows.append((self.seq, len(self.stack), COMMENT, None, None, None, data))

    def _doctype(self, *_) -> None:
        raise _BadXml("document type declarations are refused")


def node_rows(xml: str | bytes | None) -> Iterator[list[tuple]]:
    """A document's rows in lists of bounded size, or one error row and nothing else. Rows are held back until the
    document is known to be sound; one with more rows than that is read through once before its rows are given."""
    if xml is None:
        return
    held: list[tuple] = []
    try:
        pieces = iter(_Nodes(xml))
        for rows in pieces:
            held += rows
            if len(held) > ROWS:
                for _ in _Nodes(xml, silent=True):
                    pass
                yield held
                held = []
                yield from pieces
    except (expat.ExpatError, _BadXml, UnicodeEncodeError) as problem:
        held = [(0, 0, ERROR, None, None, None, str(problem))]
    if held:
        yield held


def _problem(xml: str | bytes | None) -> str | None:
    if xml is None:
        return None
    try:
        for _ in _Nodes(xml, silent=True):
            pass
    except (expat.ExpatError, _BadXml, UnicodeEncodeError) as problem:
        return str(problem)
    return None


@F.pandas_udf(T.StringType())
def xml_problem(documents: pd.Series) -> pd.Series:
    """The value of a document's `#error` row; null for a sound one and for null."""
    return documents.map(lambda xml: _problem(xml if xml is None or isinstance(xml, str) else bytes(xml)))


_FIELDS = schemas.XML_NODES.elementType.fields
_ARROW = [(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in _FIELDS]


def xml_nodes(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Every other column plus one row per attribute, leaf and comment. Bad XML gives one `#error` row.

    Text is read as it stands, bytes by their own declaration. Rows stream out in Arrow batches, so neither a large
    document nor many of its nodes are ever one value."""
    keep = [c for c in df.columns if c != xml]
    narrow = df.select(*[F.col(f"`{c}`") for c in [*keep, xml]])
    schema = T.StructType([narrow.schema[c] for c in keep] + _FIELDS)
    arrow = _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, documents = batch.columns[:-1], batch.column(batch.num_columns - 1)
            owner: list[int] = []
            rows: list[tuple] = []

            def flushed() -> pa.RecordBatch:
                own = pa.array(owner, pa.int32())
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), arrow)]
                return pa.RecordBatch.from_arrays([*(c.take(own) for c in kept), *columns], [*batch.schema.names[:-1], *(n for n, _ in arrow)])

            for k in range(batch.num_rows):
                for part in node_rows(documents[k].as_py()):
                    for at in range(0, len(part), ROWS):
                        some = part[at: at + ROWS]
                        rows += some
                        owner += [k] * len(some)
                        if len(rows) >= ROWS:
                            yield flushed()
                            owner, rows = [], []
            if rows:
                yield flushed()

    return narrow.mapInArrow(run, schema)


class XmlNodes:
    """Table function for SQL: `SELECT .. FROM docs, LATERAL xml_nodes(xml)`."""

    def eval(self, xml):
        for rows in node_rows(xml if isinstance(xml, str) or xml is None else bytes(xml)):
            yield from rows


def register_xml_nodes(spark: SparkSession, name: str = "xml_nodes") -> None:
    """Make the rows of `xml_nodes` a table function of the session."""
    spark.udtf.register(name, F.udtf(XmlNodes, returnType=T.StructType(_FIELDS)))


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """(source, url) of every `loc` in any namespace. Documents with a DTD or bad XML yield nothing."""
    nodes = xml_nodes(sitemaps.select("source", "xml"))
    return (
        with_bound(
            nodes.filter((F.col("name") == "loc") & F.col("attribute").isNull()),
            url=absolute_uri(trim_ws(F.col("value"))),
        ).filter(F.col("url").isNotNull()).select("source", "url")
    )


def svg_metadata(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, xml) -> comments, references, creator / title / description."""
    n, a, v = F.col("name"), F.col("attribute"), F.col("value")
    rows = (
        xml_nodes(artifacts.select("artifact_id", "xml"))
        .filter(not_blank(v))
        .withColumn(
            "category",
            F.when(n == "#comment", "comments")
            .when(a.isin("href", "about", "resource"),
                  F.when(classify_reference(v) == "url", "url").otherwise("external_relationship"))
            .when(a.isNull() & (n == "creator"), "author")
            .when(a.isNull() & (n == "title"), "title")
            .when(a.isNull() & (n == "description"), "comments"),
        )
        .filter(F.col("category").isNotNull())
        .withColumn(
            "location",
            F.when(n == "#comment", "svg/comment").when(a.isNotNull(), F.concat(F.lit("svg/@"), a))
            .otherwise(F.concat(F.lit("svg/"), n)),
        )
        .withColumn("confidence", F.lit(1.0))
    )
    return observation_rows(rows, "builtin.svg", ["seq"])


def _packets(texts: DataFrame) -> DataFrame:
    return explode_rows(texts, packet_spans("text"), "xml", "artifact_id", position="packet")


def xmp_packets(texts: DataFrame, extractor: str = "builtin.pdf", location: str = "pdf/raw") -> DataFrame:
    """(artifact_id, text) -> observations of the complete XMP packets."""
    packets = _packets(texts)
    a = F.col("attribute")
    is_item = F.lower("name") == "li"
    prop = F.when(a.isNotNull(), F.when(F.lower(a) == "li", F.col("parent_property")).otherwise(a)).otherwise(
        F.when(is_item, F.col("parent_property")).otherwise(F.col("name"))
    )
    rows = (
        xml_nodes(packets)
        .filter(~F.col("name").isin(ERROR, COMMENT) & not_blank(F.col("value")))
        .transform(lambda n: with_bound(n.withColumnRenamed("value", "__raw"), value=trim_ws(html_decode(F.col("__raw")))))
        .filter(F.char_length("value") > 0)
        .withColumn("property", prop)
        .withColumn("category", map_xmp_property(F.col("property")))
        .withColumn("is_leaf", a.isNull())
        .withColumn(
            "location",
            F.concat(
                F.lit(f"{location}/xmp:"), F.col("packet").cast("string"), F.lit("/"),
                F.when(a.isNotNull(), F.concat(F.lit("@"), a)).otherwise(F.col("property")),
            ),
        )
        .withColumn("confidence", F.lit(0.92))
    )
    return observation_rows(rows, extractor, ["packet", "seq", "is_leaf"])


def xmp_diagnostics(texts: DataFrame, location: str = "pdf/raw") -> DataFrame:
    """Packets that do not parse, as diagnostics."""
    return with_bound(_packets(texts), problem=xml_problem("xml")).filter(F.col("problem").isNotNull()).select(
        "artifact_id", F.lit("xmp.invalid").alias("code"),
        F.concat(F.lit(f"{location}/xmp:"), F.col("packet").cast("string"), F.lit(": "), F.col("problem")).alias("message"),
        F.lit(False).alias("is_error"),
    )
