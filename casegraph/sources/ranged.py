"""Files below a folder, listed and hashed by tasks, and a Spark data source that reads the directories of ZIP containers by
ranges."""

from __future__ import annotations

import ctypes
import fnmatch
import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from casegraph.session import scratch_path

INVALID = -1  # entry_no of the single row of an unreadable container
RANGE = 16 << 10


def _metadata_name(name: str) -> bool:
    low = name.lower()
    return (
        low in ("docprops/core.xml", "docprops/app.xml", "docprops/custom.xml", "meta.xml")
        or low.endswith((".rels", "versionlist.xml"))
        or "versions/" in low
    )


def _suspicious(size: int, packed: int) -> bool:
    return (size > 0 and packed == 0) or (size > 1024 * 1024 and size // max(1, packed) > 1_000)


def directory_rows(file: BinaryIO, max_entries: int | None = None, max_bytes: int | None = None) -> list[tuple]:
    """Central directory of one container; metadata entries carry their XML bytes, whose declared encoding the parser obeys.
    Of a seekable file only the directory and those entries are read."""
    try:
        with zipfile.ZipFile(file) as archive:
            rows, total = [], 0
            for number, entry in enumerate(archive.infolist()):
                total += entry.file_size
                xml = None
                readable = (
                    (max_entries is None or number < max_entries) and (max_bytes is None or total <= max_bytes)
                    and not _suspicious(entry.file_size, entry.compress_size)
                )
                if readable and _metadata_name(entry.filename):
                    try:
                        xml = archive.read(entry)
                    except Exception:  # a broken member is reported as invalid XML
                        xml = b""
                rows.append((number, entry.orig_filename, entry.file_size, entry.compress_size, xml))
            return rows
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError) as problem:
        return [(INVALID, str(problem), 0, 0, None)]


# Files


def opened(uri: str):
    """(file system, path in it) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    scheme, sign, rest = uri.partition(":")
    if not sign or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if sign else uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def reachable(uri: str) -> bool:
    """Whether tasks can open files of this store themselves; some stores only Spark's readers know."""
    try:
        opened(uri)
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def spelled(uri: str, system, folder: str):
    """How Spark spells a path of the file system of `uri`."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        return lambda path: "file:" + path
    lead = uri[: len(uri) - len(folder.lstrip("/"))].rstrip("/") + "/"
    return lambda path: lead + path.lstrip("/")


def listed(uri: str, pattern: str) -> list[tuple[str, int]]:
    """(URI, length) of the files below a folder, as Spark spells their paths."""
    from pyarrow import fs

    system, folder = opened(uri)
    spell = spelled(uri, system, folder)
    files = [f for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file]
    return sorted((spell(f.path), f.size) for f in files if fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._")


LISTED = "path string, length long, modified_ms long, is_folder boolean"


def _children(batches):
    """Files and folders of each folder; names that start with `_` or `.` are hidden, as for any Spark reader."""
    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        for uri in batch["path"]:
            system, folder = opened(uri)
            spell = spelled(uri, system, folder)
            found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name[0] not in "._"]
            for at in range(0, len(found), 10_000):
                part = found[at: at + 10_000]
                yield pd.DataFrame({
                    "path": [spell(f.path) for f in part], "length": pd.array([f.size for f in part], "Int64"),
                    "modified_ms": [(f.mtime_ns or 0) // 1_000_000 for f in part], "is_folder": [not f.is_file for f in part]})


def list_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder. Tasks list the folders, level by level, into tables in
    the scratch folder: the driver holds no listing, however many files there are."""
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files = spark.createDataFrame([(path,)], "path string"), None
    while True:
        out = scratch_path(spark, "listing")
        level.mapInPandas(_children, LISTED).write.parquet(out)
        found = spark.read.schema(LISTED).parquet(out)
        own = found.filter("NOT is_folder").select("path", "length", F.timestamp_millis("modified_ms").alias("modificationTime"))
        files = own if files is None else files.unionByName(own)
        level = found.filter("is_folder").select("path").repartition(spread)
        if not recursive or level.isEmpty():
            break
    if pattern is None:
        return files
    return files.filter(F.regexp_extract("path", "[^/]+$", 0).rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))


class Sha256:
    """SHA-256 whose state is bytes, so that one task can go on where another stopped: hashlib's library by its own names,
    as hashlib does not give the state away."""

    SIZE = 256  # more than the library's structure takes

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.lib = ctypes.CDLL(_hashlib.__file__)
        self.own = ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self.lib.SHA256_Init(self.own)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.own, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.own.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.own)
        return out.raw.hex()


def resumable() -> bool:
    """Whether this interpreter's hash library can be resumed."""
    try:
        first = Sha256()
        first.update(b"a" * 70)
        second = Sha256(first.state())
        second.update(b"b" * 70)
        return second.hexdigest() == hashlib.sha256(b"a" * 70 + b"b" * 70).hexdigest()
    except (AttributeError, ImportError, OSError):
        return False


def _digested(batches):
    """SHA-256 of each file, read piece by piece: a file of any size takes the memory of one piece."""
    for batch in batches:
        digests = []
        for uri in batch["path"]:
            system, path = opened(uri)
            digest = hashlib.sha256()
            with system.open_input_stream(path) as file:
                while piece := file.read(1 << 20):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def _advanced(stretch: int):
    """Reads on in each file by `stretch` bytes at most; at its end the state becomes the digest."""

    def run(batches):
        for batch in batches:
            states, digests = [], []
            for uri, at, state in zip(batch["path"], batch["at"], batch["state"]):
                system, path = opened(uri)
                digest, left = Sha256(state), stretch
                with system.open_input_file(path) as file:
                    file.seek(at)
                    while left and (piece := file.read(min(left, 1 << 20))):
                        digest.update(piece)
                        left -= len(piece)
                states.append(digest.state() if not left else None)
                digests.append(None if not left else digest.hexdigest())
            yield batch.assign(at=batch["at"] + stretch, state=states, sha256=digests)

    return run


STRETCH = 256 << 20  # bytes of a file that one task reads


def file_digests(files: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(path, length, modificationTime) of files -> with `sha256`; files are dealt out evenly. A digest runs through a file
    from its start, but not in one task: of a long file each job reads one stretch on and hands the digest's state to the
    next job."""
    spark = files.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("path", "length", F.unix_millis("modificationTime").alias("modified_ms"))
    named = "path string, length long, modified_ms long, sha256 string"
    long = rows.filter(F.col("length") >= stretch).withColumns({"at": F.lit(0).cast("long"), "state": F.lit(None).cast("binary")})
    parts = []
    while resumable() and not long.isEmpty():
        out = scratch_path(spark, "digests")
        long.repartition(spread).mapInPandas(_advanced(stretch), f"{named}, at long, state binary").write.parquet(out)
        parts.append(spark.read.parquet(out).filter("sha256 IS NOT NULL").select("path", "length", "modified_ms", "sha256"))
        long = spark.read.parquet(out).filter("sha256 IS NULL").drop("sha256")
    short = rows.filter(F.col("length") < stretch) if parts else rows
    hashed = short.repartition(spread).mapInPandas(_digested, named)
    for part in parts:
        hashed = hashed.unionByName(part)
    return hashed.select("path", "length", F.timestamp_millis("modified_ms").alias("modificationTime"), "sha256")


def file_rows(uri: str, length: int, max_entries: int | None = None, max_bytes: int | None = None) -> list[tuple]:
    """`directory_rows` of one file. A file of no more than one range's worth is read whole: its parts would take as long."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        return directory_rows(file if length >= RANGE else io.BytesIO(file.read()), max_entries, max_bytes)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class ContainerReader(DataSourceReader):
    """The listing is made on the driver, as for any file source; files are dealt out by number, as the bytes read of a
    container do not depend on its size."""

    def __init__(self, options: dict[str, str]):
        number = lambda name: int(options[name]) if name in options else None
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.max_entries, self.max_bytes = number("maxentries"), number("maxbytes")
        self.per_task = int(options.get("filespertask", 256))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, self.pattern)
        return [Files(files[k: k + self.per_task]) for k in range(0, len(files), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for uri, length in partition.files:
            for row in file_rows(uri, length, self.max_entries, self.max_bytes):
                yield (uri, length, *row)


class ContainerSource(DataSource):
    """`spark.read.format("zip_directory").option("path", folder)`: a row per entry of every container below a folder."""

    @classmethod
    def name(cls) -> str:
        return "zip_directory"

    def schema(self) -> str:
        return "path string, length bigint, entry_no int, name string, size bigint, compressed_size bigint, xml binary"

    def reader(self, schema) -> ContainerReader:
        return ContainerReader({k.lower(): v for k, v in self.options.items()})
