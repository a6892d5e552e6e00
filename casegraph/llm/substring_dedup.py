"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is parsed against the text that documents with smaller ids hold. The reference is indexed in blocks: a
sampled gram (an anchor: the least hash among the grams of a window) with the windows that contain it. As the anchor
follows from the window's own words, equal windows always meet in one block list.

1. ``anchors``: exact copies of a smaller document are set aside (their parse is one factor); each other document gives
   its anchors, about two in (window - gram + 2) words.
2. ``occurrences``: anchors of two documents or more are indexed; a document's windows around such an anchor form one
   block, with a hash of the whole block and one per window.
3. ``blocks``: equal blocks collapse to their smallest document. A later holder of a block copies it whole: one factor.
   The smallest holder may still share some windows with blocks that differ only at their ends: these boundaries are
   checked window by window.
4. ``factors``: per document the factors join, left to right, to spans of `window` words or more; they are what is removed.

Nothing is compared pairwise: a passage that a third of all documents hold is one block list, reduced map-side.

This is block parsing, not a greedy longest-match walk: a factor is a whole block or the windows at its ends, found by the
document's own anchors, and touching factors join. What is removed is the same, as every window that occurs earlier lies in
some block.

Cases: null or short texts have no window and keep all words; rows repeated under one id stay (an id is never its own
source), and different texts under one id are parsed apart; copies under larger ids lose every word if they have a window; a null id is neither source nor cleaned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import WordHashes, cut, id_and_text, mix64, sha256, texts_of
from casegraph.llm.word_windows import Powers, rolling, sliding_min


def _anchor_values(hashes: np.ndarray, window: int, gram: int, powers: Powers) -> np.ndarray:
    """The anchor of each window."""
    return sliding_min(rolling(hashes, gram, powers), window - gram + 1)


def _text_key(text: bytes) -> tuple[int, int]:
    import xxhash

    digest = np.frombuffer(xxhash.xxh3_128_digest(text), np.int64)
    return int(digest[0]), int(digest[1])


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(t1, t2, doc_id, words_key, anchors): hashes of the text and its distinct anchors, per row with a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = WordHashes(), Powers()
        for batch in batches:
            t1, t2, ids, keys, sizes, values = [], [], [], [], [0], []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("words_key").to_pylist(), texts_of(batch.column("text"))):
                found = text.split()
                if len(found) < window:
                    continue
                own = np.unique(_anchor_values(words.of(found), window, gram, powers))
                a, b = _text_key(b" ".join(found))
                t1.append(a)
                t2.append(b)
                ids.append(doc)
                keys.append(key)
                sizes.append(len(own))
                values.append(own)
            flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), lists], ["t1", "t2", "doc_id", "words_key", "anchors"])

    return texts.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).mapInArrow(
        run, "t1 long, t2 long, doc_id long, words_key long, anchors array<long>")


def occurrences(texts: DataFrame, shared: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, block, doc_id, words_key, start, hashes): per text the runs of windows that have one shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = WordHashes(), Powers()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            lists = batch.column("shared")
            for n, (doc, key, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("words_key").to_pylist(), texts_of(batch.column("text")))):
                own = words.of((text or b"").split())
                if len(own) < window:
                    continue
                wanted = np.sort(lists[n].values.to_numpy(zero_copy_only=False).view(np.uint64))
                anchor = _anchor_values(own, window, gram, powers)
                at = np.searchsorted(wanted, anchor)
                starts = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == anchor)
                if not len(starts):
                    continue
                value = anchor[starts]
                first = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (value[1:] != value[:-1])])
                size = np.diff(np.r_[first, len(starts)])
                hashes = rolling(own, window, powers)[starts]
                place = np.arange(len(starts), dtype=np.uint64) - np.repeat(first, size).astype(np.uint64)
                block = np.add.reduceat(mix64(hashes + place * np.uint64(0x9E3779B97F4A7C15)), first) + size.astype(np.uint64)
                for into, what in zip(out, (value[first], block, np.full(len(first), doc, np.int64), np.full(len(first), key, np.int64), starts[first], size, hashes)):
                    into.append(what)
            if not out[0]:
                continue
            value, block, docs, keys, start, size, hashes = (np.concatenate(x) for x in out)
            runs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(block.view(np.int64)), pa.array(docs), pa.array(keys), pa.array(start.astype(np.int32)), runs],
                ["anchor", "block", "doc_id", "words_key", "start", "hashes"])

    return texts.join(shared, ["doc_id", "words_key"]).mapInArrow(run, "anchor long, block long, doc_id long, words_key long, start int, hashes array<long>")


def blocks(found: DataFrame) -> DataFrame:
    """(anchor, block, source, early): a block's smallest document, and which of the block's windows an even smaller
    document holds in a block that differs elsewhere."""
    distinct = cut(found.groupBy("anchor", "block").agg(F.min("doc_id").alias("source"), F.first("hashes").alias("hashes")))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    windows = cut(distinct.join(several, "anchor", "left_semi").select(
        "anchor", "block", "source", F.posexplode("hashes").alias("at", "hash")))
    # a table of its own, so that the join's hot partitions can be split
    least = cut(windows.groupBy("anchor", "hash").agg(F.min("source").alias("least"), F.max("source").alias("most")).filter("least < most").drop("most"))
    early = (
        windows.join(least, ["anchor", "hash"]).filter("least < source")
        .groupBy("anchor", "block").agg(F.collect_list("at").alias("early"))
    )
    return cut(distinct.drop("hashes").join(early, ["anchor", "block"], "left"))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, words_key): the key tells apart texts of different words under one id."""
    words = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    return id_and_text(docs, id_col, text_col).withColumn("words_key", F.xxhash64(words))


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 25) -> DataFrame:
    """(doc_id, words_key, factors): per text that is not a copy, its factors (start, windows, early) - windows counted from
    `start`, or only the offsets `early`."""
    texts = keyed_texts(docs, id_col, text_col)
    firsts = cut(anchors(texts, window, gram).groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "words_key", "anchors")).alias("first")).select("first.*"))
    each = firsts.select("doc_id", "words_key", F.explode("anchors").alias("anchor"))
    held = cut(each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor"))
    shared = each.join(held, "anchor").groupBy("doc_id", "words_key").agg(F.collect_list("anchor").alias("shared"))
    found = cut(occurrences(texts, shared, window, gram))
    index = blocks(found)
    copied = (
        found.select("anchor", "block", "doc_id", "words_key", "start", F.size("hashes").alias("windows")).join(index, ["anchor", "block"])
        .withColumn("early", F.when(F.col("doc_id") == F.col("source"), F.col("early")))
        .filter((F.col("doc_id") > F.col("source")) | F.col("early").isNotNull())
        .groupBy("doc_id", "words_key").agg(F.collect_list(F.struct("start", "windows", "early", "source")).alias("factors"))
    )
    return firsts.select("doc_id", "words_key").distinct().join(copied, ["doc_id", "words_key"], "left")


def covered(n_words: int, found: list[dict], window: int) -> list[tuple[int, int]]:
    """Factors, parsed left to right: the spans [start, end) that overlapping windows form."""
    starts = sorted(w for f in found for w in ((f["start"] + k for k in f["early"]) if f["early"] is not None else range(f["start"], f["start"] + f["windows"])))
    spans: list[tuple[int, int]] = []
    for s in starts:
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], s + window)
        else:
            spans.append((s, s + window))
    return spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 25, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept]); spans hold word offsets, end exclusive."""
    parsed = factors(docs, id_col, text_col, window, gram).withColumn("first", F.lit(True))
    joined = keyed_texts(docs, id_col, text_col).join(parsed, ["doc_id", "words_key"], "left").drop("words_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "factors", "first")]
            for text, doc, found, first in zip(texts_of(batch.column("text")), *columns):
                words = (text or b"").split()
                if found:
                    spans = covered(len(words), found, window)
                elif doc is not None and not first and len(words) >= window:
                    spans = [(0, len(words))]  # a copy of a smaller document
                else:
                    spans = []
                kept, at = [], 0
                for start, end in spans:
                    kept += words[at:start]
                    at = end
                kept += words[at:]
                text = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), sha256(text), [{"start": s, "end": e} for s, e in spans], text))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()][: 5 + with_text]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            if with_text:
                made[5] = made[5].cast(pa.string())
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 5 + with_text])

    return joined.mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept string" * with_text)
