"""Line dedup with sharded cuckoo filters backed by exact reference tables.

The index of a corpus has three parts, all DataFrames:

* ``refs``: one row per (key, document) that holds the line key: the exact reference table;
* ``counts``: per key that at least `min_docs` documents hold: how many, and the largest of them (its keeper);
* ``filters``: per shard of the key space a cuckoo filter over the keys of ``counts``.

``insert`` and ``delete`` change all three for the touched keys only; a cuckoo filter, unlike a Bloom filter, forgets a
deleted key, so inserting documents and deleting them again gives the index and the cleaned texts one had before.

Cleaning probes the filters first: only lines that pass meet the exact table, so false positives cost a join row and
never a line. A key held by more than one in `HOT_SHARE` of all references would crowd its shard; there are at most
`HOT_SHARE` such keys, whatever the corpus, so they are broadcast and checked exactly before the filters are probed.

Cases: a null or empty text is one empty line; keys shorter than `min_chars` code points are never dropped; the same
document in several rows counts once per key and each row is cleaned alike; a row with a null id is returned as it is
and counts for no key; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from casegraph.llm.common import batches_by_bytes, cut, id_and_text, sha256, texts_of

SPACE = b" \t\n\x0b\x0c\r"
HOT_SHARE = 10_000
KEYS_PER_SHARD = 100_000


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; what finds no place after many moves is kept whole in a stash."""

    SLOTS, MOVES = 4, 200

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[tuple[int, int]] = ()):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.stash = set(stash)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.85 * cls.SLOTS))))))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (k2.astype(np.int64) & 0xFFFF).astype(np.uint16)
        mark[mark == 0] = 1
        first = ((k1.astype(np.int64) >> 20) & (self.buckets - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, place, mark):
        """The partner bucket; applied twice it gives the first again."""
        return (place ^ ((mark.astype(np.int64) * 0x5BD1E995) & (self.buckets - 1))) if isinstance(mark, np.ndarray) else (
            place ^ ((int(mark) * 0x5BD1E995) & (self.buckets - 1)))

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        mark, first, second = self.places(k1, k2)
        for n in range(len(k1)):
            if not self._put(int(mark[n]), int(first[n]), int(second[n])):
                self.stash.add((int(k1[n]), int(k2[n])))

    def _put(self, mark: int, first: int, second: int) -> bool:
        table, moved = self.table, []
        for place in (first, second):
            for slot in range(self.SLOTS):
                if not table[place, slot]:
                    table[place, slot] = mark
                    return True
        place = second
        for turn in range(self.MOVES):
            slot = turn % self.SLOTS
            moved.append((place, slot))
            mark, table[place, slot] = int(table[place, slot]), mark
            place = self.other(place, mark)
            for slot in range(self.SLOTS):
                if not table[place, slot]:
                    table[place, slot] = mark
                    return True
        for place, slot in reversed(moved):  # undo: no earlier key may lose its place
            mark, table[place, slot] = int(table[place, slot]), mark
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        mark, first, second = self.places(k1, k2)
        for n in range(len(k1)):
            key = (int(k1[n]), int(k2[n]))
            if key in self.stash:
                self.stash.remove(key)
                continue
            for place in (int(first[n]), int(second[n])):
                at = np.flatnonzero(self.table[place] == mark[n])
                if len(at):
                    self.table[place, at[0]] = 0
                    break

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(k1, k2)
        found = (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)
        if self.stash:
            found |= np.fromiter(((int(a), int(b)) in self.stash for a, b in zip(k1, k2)), bool, len(k1))
        return found

    def to_bytes(self) -> bytes:
        stash = np.array(sorted(self.stash), np.int64).tobytes()
        return self.buckets.to_bytes(8, "little") + self.table.tobytes() + stash

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets = int.from_bytes(data[:8], "little")
        end = 8 + buckets * cls.SLOTS * 2
        stash = np.frombuffer(data[end:], np.int64).reshape(-1, 2)
        table = np.frombuffer(data[8:end], np.uint16).reshape(buckets, cls.SLOTS).copy()
        return cls(buckets, table, [(int(a), int(b)) for a, b in stash])


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame      # k1, k2, doc_id
    counts: DataFrame    # k1, k2, n_docs, keeper
    filters: DataFrame   # shard, filter
    shards: int
    sized_for: int    # keys when the filters were last made anew
    hot_above: int
    min_chars: int
    min_docs: int


def keys_of(text: bytes | None, min_chars: int) -> list[bytes]:
    """The key of each line; b'' where the line is too short to be compared."""
    out = []
    for line in (text or b"").lower().split(b"\n"):
        key = line.strip(SPACE)
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
            key = b""
        out.append(key)
    return out


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, k1, k2): a 128-bit hash of each key of a document, once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                own = {xxhash.xxh3_128_digest(k) for k in keys_of(text, min_chars) if k}
                ids += [doc] * len(own)
                digests += own
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "k1", "k2"])

    texts = id_and_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return texts.mapInArrow(run, "doc_id long, k1 long, k2 long")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    """A new cuckoo filter per shard; a shard has about KEYS_PER_SHARD keys."""

    def run(group: pa.Table) -> pa.Table:
        k1, k2 = group.column("k1").to_numpy(), group.column("k2").to_numpy()
        made = CuckooFilter.sized(len(k1))
        made.insert(k1, k2)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return counts.select(_shard(shards).alias("shard"), "k1", "k2").groupBy("shard").applyInArrow(run, "shard int, filter binary")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> LineIndex:
    refs = cut(line_keys(docs, id_col, text_col, min_chars).dropDuplicates())
    return _index(refs, min_chars, min_docs)


def _index(refs: DataFrame, min_chars: int, min_docs: int) -> LineIndex:
    seen, kept = Observation(), Observation()
    counted = _counted(refs).observe(seen, F.sum("n_docs").alias("refs")).filter(F.col("n_docs") >= min_docs)
    counts = cut(counted.observe(kept, F.count(F.lit(1)).alias("keys")))
    keys = kept.get["keys"] or 0
    shards = _shards(keys)
    return LineIndex(refs, counts, _filters(counts, shards), shards, keys, _hot_above(seen.get["refs"] or 0, min_docs), min_chars, min_docs)


def _shards(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_SHARD))


def _hot_above(refs: int, min_docs: int) -> int:
    """More documents than this hold at most HOT_SHARE keys."""
    return max(min_docs, refs // HOT_SHARE)


def _changed(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over `refs`, given the keys whose references changed: only their counts and shards are made anew. What
    depends on the corpus' size follows it: the bound of hot keys always, the number of shards and the sizes of the filters
    when the keys have outgrown them by a tenth; then all filters are made from the counts, which costs a constant share of
    the insertions that led to it."""
    old = index.counts.join(touched, ["k1", "k2"], "left_semi")
    new = cut(_counted(refs.join(touched, ["k1", "k2"], "left_semi")).filter(F.col("n_docs") >= index.min_docs))
    counts = cut(index.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(new))
    keys, hot_above = counts.count(), _hot_above(refs.count(), index.min_docs)
    if keys > max(1.1 * index.sized_for, 16):
        shards = _shards(keys)
        return LineIndex(refs, counts, cut(_filters(counts, shards)), shards, keys, hot_above, index.min_chars, index.min_docs)
    gone = old.join(new, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(False).alias("put"))
    come = new.join(old, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(True).alias("put"))
    moves = gone.unionByName(come).select(_shard(index.shards).alias("shard"), "k1", "k2", "put")

    def run(key, filters: pa.Table, changes: pa.Table) -> pa.Table:
        made = CuckooFilter.from_bytes(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter.sized(changes.num_rows)
        put = changes.column("put").to_numpy()
        k1, k2 = changes.column("k1").to_numpy(), changes.column("k2").to_numpy()
        made.delete(k1[~put], k2[~put])
        made.insert(k1[put], k2[put])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    filters = cut(index.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(run, "shard int, filter binary"))
    return LineIndex(refs, counts, filters, index.shards, index.sized_for, hot_above, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """Add documents; references that the index already has change nothing."""
    found = line_keys(docs, id_col, text_col, index.min_chars).dropDuplicates()
    added = cut(found.join(index.refs, ["k1", "k2", "doc_id"], "left_anti").select("doc_id", "k1", "k2"))
    return _changed(index, index.refs.select("doc_id", "k1", "k2").unionByName(added), added.select("k1", "k2").distinct())


def delete(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """Take documents out, by id."""
    out = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    touched = cut(index.refs.join(out, "doc_id", "left_semi").select("k1", "k2").distinct())
    return _changed(index, cut(index.refs.join(out, "doc_id", "left_anti").select("doc_id", "k1", "k2")), touched)


def probe(index: LineIndex, refs: DataFrame) -> DataFrame:
    """References that pass their shard's filter. Filter rows sort before the references of their shard, so a task
    holds one filter at a time and streams the references past it, however many there are."""
    asked = refs.select(_shard(index.shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "doc_id", "k1", "k2")
    held = index.filters.select("shard", "filter", *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "k1", "k2")])
    salts = F.lit(64)  # one shard's references go to several tasks
    placed = held.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).unionByName(
        asked.withColumn("salt", F.pmod(F.hash("doc_id"), salts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, CuckooFilter] | None = None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            filters, valid = batch.column("filter"), np.asarray(batch.column("filter").is_valid())
            edges = np.flatnonzero(np.diff(shard) | np.diff(valid.astype(np.int8)) | valid[1:]) + 1
            for start, stop in zip([0, *edges], [*edges, len(shard)]):
                if start == stop:
                    continue
                if valid[start]:
                    current = (int(shard[start]), CuckooFilter.from_bytes(filters[int(start)].as_py()))
                elif current and current[0] == shard[start]:
                    part = batch.slice(start, stop - start).select(["doc_id", "k1", "k2"])
                    yield part.filter(pa.array(current[1].holds(part.column(1).to_numpy(), part.column(2).to_numpy())))

    return placed.repartition("shard", "salt").sortWithinPartitions("shard", F.col("filter").isNull(), "salt").mapInArrow(run, "doc_id long, k1 long, k2 long")


def drops(index: LineIndex, refs: DataFrame) -> DataFrame:
    """(doc_id, drop): the keys whose lines a document loses."""
    hot = index.counts.filter(F.col("n_docs") >= index.hot_above)  # at most HOT_SHARE rows
    common = refs.join(F.broadcast(hot), ["k1", "k2"]).filter(F.col("doc_id") != F.col("keeper"))
    rare = refs.join(F.broadcast(hot.select("k1", "k2")), ["k1", "k2"], "left_anti")
    exact = probe(index, rare).join(index.counts, ["k1", "k2"]).filter(F.col("doc_id") != F.col("keeper"))
    lost = reduce(DataFrame.unionByName, [x.select("doc_id", "k1", "k2") for x in (common, exact)])
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))


def _kept(text: bytes, drop: list[dict] | None, min_chars: int) -> tuple[bytes, int]:
    """A text without its dropped lines, and how many those are."""
    import xxhash

    if not drop:
        return text, 0
    gone = {np.array([d["k1"], d["k2"]], np.int64).tobytes() for d in drop}
    stay = [not k or xxhash.xxh3_128_digest(k) not in gone for k in keys_of(text, min_chars)]
    return b"\n".join(line for line, s in zip(text.split(b"\n"), stay) if s), len(stay) - sum(stay)


def clean(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for documents that the index holds."""
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in texts_of(batch.column("text"))]
            made = [_kept(t, d, min_chars) for t, d in zip(texts, batch.column("drop").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
                pa.array([n for _, n in made], pa.int64()), pa.array([sha256(t) for t, _ in made], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    joined = id_and_text(docs, id_col, text_col).join(drops(index, index.refs), "doc_id", "left")
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def cleaned(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with the text that is kept; a null text stays null."""
    min_chars, at = index.min_chars, docs.columns.index(text_col)
    lost = drops(index, index.refs).toDF("__id", "__drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else _kept(t, d, min_chars)[0] for t, d in zip(texts_of(batch.column(at)), batch.column("__drop").to_pylist())]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(made, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    joined = docs.join(lost, docs[id_col].cast("long") == F.col("__id"), "left").drop("__id")
    return joined.mapInArrow(run, docs.schema)
