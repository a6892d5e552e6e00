"""ZIP containers: directory rows, budgets, office properties."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph import schemas
from casegraph.functions.binding import explode_rows, with_bound
from casegraph.functions.text import classify_reference, map_office_element, safe_entry_path, slug_property, stable_id
from casegraph.operators.observations import cumulative_budget, observation_rows
from casegraph.operators.xml_extract import COMMENT, ERROR, xml_nodes, xml_problem
from casegraph.sources.ranged import INVALID, directory_rows, file_rows, list_files

_ENTRY = schemas.CONTAINER_ENTRIES.elementType
_ARROW = [(f.name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in _ENTRY]
ROWS = 4096         # rows of an Arrow batch
BYTES = 8 << 20     # or so much XML


@F.pandas_udf(T.StringType())
def zip_kind(contents: pd.Series) -> pd.Series:
    """Kind of a ZIP-like content by its member names; unreadable containers are `unknown`."""

    def one(content):
        if content is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = {name.lower() for name in archive.namelist()}
        except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
            return "unknown"
        if "[content_types].xml" in names:
            return "open_xml"
        return "open_document" if names & {"meta-inf/manifest.xml", "meta.xml"} else "zip"

    return contents.map(one)


def container_entries(artifacts: DataFrame, max_entries: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(artifact_id, content) -> directory rows with running size and safety flags; limits hold when given."""
    narrow = artifacts.select("artifact_id", "content")
    arrow = _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows leave in batches of their own size, however many a batch of containers holds."""
        for batch in batches:
            ids, contents = batch.columns
            owner: list[int] = []
            rows: list[tuple] = []

            def flushed() -> pa.RecordBatch:
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), arrow)]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int32())), *columns], [batch.schema.names[0], *(n for n, _ in arrow)])

            for k in range(batch.num_rows):
                content = contents[k].as_py()
                found = [] if content is None else directory_rows(io.BytesIO(content), max_entries, max_bytes)
                for at in range(0, len(found), ROWS):
                    some = found[at: at + ROWS]
                    rows += some
                    owner += [k] * len(some)
                    if len(rows) >= ROWS:
                        yield flushed()
                        owner, rows = [], []
            if rows:
                yield flushed()

    listed = narrow.mapInArrow(run, T.StructType([narrow.schema["artifact_id"], *_ENTRY.fields]))
    return _flagged(listed, max_entries, max_bytes)


def ranged_entries(spark: SparkSession, path: str, max_entries: int | None = None, max_bytes: int | None = None, pattern: str = "*",
                   with_path: bool = False) -> DataFrame:
    """The rows of `container_entries` for the files below a folder, by ranged reads: each container is opened once and
    only its directory and metadata entries are read, whatever its size. Tasks list the folders and read the files, which
    are dealt out evenly; the driver holds no listing."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = list_files(spark, path, pattern=pattern).select("path", "length").repartition(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths: list[str] = []
            rows: list[tuple] = []
            size = 0
            for uri, length in zip(*(c.to_pylist() for c in batch.columns)):
                for row in file_rows(uri, length, max_entries, max_bytes):
                    paths.append(uri)
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= ROWS or size >= BYTES:
                        yield _with_paths(paths, rows)
                        paths, rows, size = [], [], 0
            if rows:
                yield _with_paths(paths, rows)

    listed = files.mapInArrow(run, T.StructType([files.schema["path"], *_ENTRY.fields])).withColumn("artifact_id", stable_id(F.col("path")))
    return _flagged(listed.select(*["path"] * with_path, "artifact_id", *_ENTRY.names), max_entries, max_bytes)


def _with_paths(paths: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _ARROW)]
    return pa.RecordBatch.from_arrays([pa.array(paths), *columns], ["path", *(n for n, _ in _ARROW)])


def _flagged(rows: DataFrame, max_entries: int | None, max_bytes: int | None) -> DataFrame:
    budgeted = cumulative_budget(rows, ["artifact_id"], ["entry_no"], "size", max_bytes if max_bytes is not None else 2 ** 63 - 1)
    size, packed = F.col("size"), F.col("compressed_size")
    return (
        budgeted.withColumn("within_entries", F.lit(True) if max_entries is None else F.col("entry_no") < max_entries)
        .withColumn("safe_path", safe_entry_path(F.col("name")))
        .withColumn("is_metadata", metadata_entry(F.col("name")))
        .withColumn(
            "suspicious_ratio",
            ((size > 0) & (packed == 0))
            | ((size > 1024 * 1024) & (F.floor(size / F.greatest(packed, F.lit(1))) > 1000)),
        )
    )


def metadata_entry(name: Column) -> Column:
    low = F.lower(name)
    return (
        low.isin("docprops/core.xml", "docprops/app.xml", "docprops/custom.xml", "meta.xml")
        | F.endswith(low, F.lit(".rels")) | F.endswith(low, F.lit("versionlist.xml"))
        | F.contains(low, F.lit("versions/"))
    )


def container_diagnostics(entries: DataFrame) -> DataFrame:
    """One row per rule that rejected something; a budget speaks at a container's first entry beyond it. All rules are read
    in one pass: the containers are opened once."""
    before = W.partitionBy("artifact_id").orderBy("entry_no").rowsBetween(W.unboundedPreceding, -1)
    good, listed, fits = F.col("entry_no") != INVALID, F.col("within_entries"), F.col("within_budget")
    first = lambda c: c & (F.count(F.when(c, 1)).over(before) == 0)
    note = lambda when, code, message, is_error: F.when(when, F.struct(
        F.lit(code).alias("code"), message.alias("message"), F.lit(is_error).alias("is_error")))
    name, problem = F.col("name"), F.col("__problem")
    rows = entries.withColumns({"__problem": xml_problem(F.when(F.expr(PART), F.col("xml"))), "__many": first(good & ~listed), "__large": first(good & listed & ~fits)})
    notes = F.array(
        note(~good, "zip.invalid", name, True),
        note(F.col("__many"), "zip.entry_budget", F.lit("more entries than asked for; the rest is not listed as data"), True),
        note(F.col("__large"), "zip.size_budget", F.lit("unpacked sizes exceed the byte limit from this entry on"), True),
        note(good & listed & fits & ~F.col("safe_path"), "zip.path_traversal", F.concat(F.lit("path leaves the container, not read: "), name), True),
        note(good & listed & fits & F.col("safe_path") & F.col("is_metadata") & F.col("suspicious_ratio"), "zip.compression_ratio",
             F.concat(F.lit("unpacks to far more than its size, not read: "), name), True),
        note(problem.isNotNull(), "xml.invalid", F.concat_ws(": ", name, problem), False),
    )
    return explode_rows(rows, notes, "note", "artifact_id").select("artifact_id", "note.*")


PART = "within_entries AND within_budget AND safe_path AND is_metadata AND NOT suspicious_ratio AND xml IS NOT NULL"


def _parts(entries: DataFrame) -> DataFrame:
    return entries.filter(PART).select("artifact_id", "entry_no", F.col("name").alias("entry"), "xml")


def office_properties(entries: DataFrame) -> DataFrame:
    """Container rows -> observations of core, app, custom, ODF meta and relationship parts."""
    parts = _parts(entries)
    n, v, attribute = F.col("name"), F.col("value"), F.col("attribute")
    in_custom = F.lower("entry") == "docprops/custom.xml"
    leaf, target = attribute.isNull(), (n == "Relationship") & (attribute == "Target")
    custom = in_custom & leaf & F.col("parent_label").isNotNull()
    rows = (
        with_bound(
            xml_nodes(parts).filter(~n.isin(ERROR, COMMENT)),
            category=F.when(target, classify_reference(v)).when(custom, slug_property(F.col("parent_label")))
            .when(leaf & ~in_custom, map_office_element(n)),
        )
        .filter(F.col("category").isNotNull())
        .withColumn(
            "location",
            F.when(target, F.concat(F.col("entry"), F.lit("@Target"))).when(custom, F.concat_ws("/", "entry", "parent_label"))
            .otherwise(F.concat_ws("/", "entry", "name")),
        )
        .withColumn("confidence", F.when(custom, 0.9).otherwise(1.0))
    )
    return observation_rows(rows, "builtin.zip-xml", ["entry_no", "seq"])
