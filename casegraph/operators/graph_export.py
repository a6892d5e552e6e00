"""Graph exports: every node or edge becomes text in the JVM; a range sort gives the file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _xml(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for char, ref in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def _dot(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def graph_csv(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """record,id,type,value,from,to with nodes first, both by id."""
    none = F.lit(None).cast("string")
    rows = nodes.select(
        F.lit("node").alias("record"), "id", "type", "value", none.alias("from"), none.alias("to")
    ).unionByName(edges.select(
        F.lit("edge").alias("record"), "id", "type", none.alias("value"),
        F.col("from_entity_id").alias("from"), F.col("to_entity_id").alias("to"),
    ))
    return rows.orderBy(F.col("record") == "edge", "id")


def _document(spark, nodes: DataFrame, edges: DataFrame, head: str, middle: str | None, tail: str) -> DataFrame:
    """(section, id, line): header, node lines, separator, edge lines, footer in sorted order."""
    fixed = [(0, "", head), (4, "", tail)] + ([(2, "", middle)] if middle else [])
    frame = spark.createDataFrame(fixed, "section int, id string, line string")
    body = nodes.withColumn("section", F.lit(1)).unionByName(edges.withColumn("section", F.lit(3)))
    return frame.unionByName(body.select("section", "id", "line")).orderBy("section", "id")


def graph_lines(nodes: DataFrame, edges: DataFrame, fmt: str, name: str = "casegraph") -> DataFrame:
    label = F.concat(F.col("type"), F.lit(": "), F.col("value"))
    src, dst = F.col("from_entity_id"), F.col("to_entity_id")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    i, t, v = F.col("id"), F.col("type"), F.col("value")
    if fmt == "dot":
        node = cat('  "', i, '" [label="', _dot(label), '"];')
        edge = cat('  "', src, '" -> "', dst, '" [label="', _dot(t), '"];')
        head, middle, tail = f"digraph {name} {{", None, "}"
    elif fmt == "graphml":
        node = cat('<node id="', i, '"><data key="type">', _xml(t), '</data><data key="value">', _xml(v), "</data></node>")
        edge = cat('<edge source="', src, '" target="', dst, '"><data key="type">', _xml(t), "</data></edge>")
        head = (
            '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
            '<graph edgedefault="directed">'
        )
        middle, tail = None, "</graph></graphml>"
    elif fmt == "gexf":
        node = cat('<node id="', i, '" label="', _xml(label), '"/>')
        edge = cat('<edge id="', i, '" source="', src, '" target="', dst, '" label="', _xml(t), '"/>')
        head = (
            '<?xml version="1.0" encoding="utf-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3">'
            '<graph defaultedgetype="directed"><nodes>'
        )
        middle, tail = "</nodes><edges>", "</edges></graph></gexf>"
    else:
        raise ValueError("format must be dot, graphml or gexf")
    return _document(
        nodes.sparkSession, nodes.select("id", node.alias("line")), edges.select("id", edge.alias("line")),
        head, middle, tail,
    )
