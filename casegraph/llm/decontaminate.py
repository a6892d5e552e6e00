"""Benchmark decontamination with a distributed positional inverted index.

1. ``item_terms``: the words of the benchmark items, as (item, position, term).
2. ``frequencies``: how often each test term occurs in all documents.
3. ``anchors``: each test window (13 words, or a shorter item whole) is represented by its two rarest terms. A window
   with a term that no document has is out.
4. ``postings``: the index: (term, doc_id, position) of the anchor terms in all documents.
5. ``phrases``: posting lists meet the anchors term by term; position minus item position is the diagonal. A window whose
   two anchors lie on one diagonal of a document is a candidate; the full phrase is then compared with the whole text.
6. ``proximity``: windows that a document holds nearly: all but `missing` of their words, each at most `slack` words off
   one diagonal. Two of the `missing` + 2 rarest terms that occur must be there, so two anchors of one segment of an item on
   neighbouring diagonals give all candidates (terms that no document has use up the allowance); the whole text decides.

Which words of a document are test terms is decided in the scan by a bit set of fixed size (1 MiB, two bits a term);
what passes it wrongly finds no partner in the joins. A benchmark of any size therefore gives the same result, and a
passage or term in a third of all documents is only a long posting list: joins on it are split by Spark.

Cases: null text has no words; an item without words matches nothing; equal items, repeated rows and ids are fine (an id
counts once); items with null id take no part; a document with null id is returned unmatched; empty tables give rows
without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import WordHashes, cut, id_and_text, mix64, texts_of

WINDOW = 13
BITS = 1 << 23
STARTS = 64          # window starts of one segment of an item: a segment is a small row, whatever the item's length
#: Words are runs of a-z, 0-9 and all bytes of non-ASCII characters; A-Z become a-z, the rest separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def item_terms(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, variant, at, term); an item's variants are its different texts."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = items.dropna().dropDuplicates().withColumn("variant", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            own = [words.of(words_of(t)) for t in texts_of(batch.column("text"))]
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), batch.column("variant"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["item_id", "variant", "terms"])

    return items.mapInArrow(run, "item_id string, variant long, terms array<long>").select(
        "item_id", "variant", F.posexplode("terms").alias("at", "term"))


def _slots(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (terms % np.uint64(BITS)).astype(np.int64), (mix64(terms) % np.uint64(BITS)).astype(np.int64)


def bit_set(terms: DataFrame) -> np.ndarray:
    """The bits of a column of terms: at most BITS / 64 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots in _slots(batch.column("term").to_numpy().view(np.uint64)):
                bits = np.left_shift(np.int64(1), slots & 63)
                yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(bits)], ["word", "bits"])

    words = np.zeros(BITS // 64, np.int64)
    for row in terms.select("term").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        words[row.word] = row.bits
    return words


def _passes(words: np.ndarray, terms: np.ndarray) -> np.ndarray:
    one, two = _slots(terms)
    return ((words[one >> 6] >> (one & 63)) & (words[two >> 6] >> (two & 63)) & 1).astype(bool)


def frequencies(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(term, n): occurrences in all documents of the terms that pass the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            own = [words.of(words_of(t)) for t in texts_of(batch.column("text"))]
            every = np.concatenate(own) if own else np.zeros(0, np.uint64)
            terms, n = np.unique(every[_passes(bits, every)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def windows_of(terms: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, rarest position, second rarest position) of each window that can occur."""
    width = min(window, len(terms))
    out = []
    for start in range(len(terms) - width + 1):
        own = counts[start: start + width]
        if own.min() > 0:
            order = np.argsort(own, kind="stable")
            out.append((start, start + int(order[0]), start + int(order[min(1, width - 1)])))
    return out


def item_windows(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item_id, variant, terms, windows, anchors): an item's terms in order, its windows, its anchor positions."""
    whole = terms.join(counts, "term", "left").groupBy("item_id", "variant").agg(
        F.sort_array(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, variant, w in zip(*(batch.column(c).to_pylist() for c in ("item_id", "variant", "w"))):
                ids = [x["term"] for x in w]
                found = windows_of(np.array(ids), np.array([x["n"] for x in w]), window)
                anchors = sorted({p for f in found for p in f[1:]})
                rows.append((item, variant, ids, [p for f in found for p in f], anchors))
            types = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["item_id", "variant", "terms", "windows", "anchors"])

    return whole.mapInArrow(run, "item_id string, variant long, terms array<long>, windows array<int>, anchors array<int>")


def postings(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(term, doc_id, at): the positional index of the terms that pass the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            terms, docs, places = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                own = words.of(words_of(text))
                at = np.flatnonzero(_passes(bits, own))
                terms.append(own[at])
                places.append(at)
                docs.append(np.full(len(at), doc, np.int64))
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(terms).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places).astype(np.int32))],
                    ["term", "doc_id", "at"])

    return texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "term long, doc_id long, at int")


def diagonals(index: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, variant, item_at, diagonal): each posting against each anchor position of its term."""
    anchors = items.select("item_id", "variant", F.explode("anchors").alias("item_at"), "terms").withColumn(
        "term", F.element_at("terms", F.col("item_at") + 1)).drop("terms")
    return index.join(cut(anchors), "term").select("doc_id", "item_id", "variant", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"))


def phrases(texts: DataFrame, index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids): all documents with the words inside any occurrence of a window."""
    lined = diagonals(index, items).groupBy("doc_id", "item_id", "variant", "diagonal").agg(F.collect_set("item_at").alias("lined"))
    # in a window that can occur both anchors are on its diagonal
    possible = F.expr("exists(sequence(1, size(windows), 3), i -> array_contains(lined, windows[i]) AND array_contains(lined, windows[i+1]))")
    candidates = lined.join(cut(items.filter(F.size("windows") > 0)), ["item_id", "variant"]).filter(possible).groupBy("doc_id", "item_id", "variant").agg(
        F.first("terms").alias("terms"), F.collect_list("diagonal").alias("diagonals"))
    asked = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "terms", "diagonals")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("asked").to_pylist()):
                found = words_of(text)
                hit, items_hit = np.zeros(len(found) + 1, np.int64), set()
                if own:
                    hashes = words.of(found).view(np.int64)
                    for item in own:
                        terms = np.array(item["terms"], np.int64)
                        width = min(window, len(terms))
                        for diagonal in item["diagonals"]:
                            low, high = max(0, -diagonal), min(len(terms), len(hashes) - diagonal)
                            same = terms[low:high] == hashes[low + diagonal: high + diagonal]
                            if len(same) < width:
                                continue
                            runs = np.r_[0, np.cumsum(same)]
                            starts = np.flatnonzero(runs[width:] - runs[:-width] == width) + low + diagonal
                            np.add.at(hit, starts, 1)
                            np.add.at(hit, starts + width, -1)
                            if len(starts):
                                items_hit.add(item["item_id"])
                rows.append((doc, len(found), int((np.cumsum(hit)[:-1] > 0).sum()), sorted(items_hit)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "n_words", "n_hit", "item_ids"])

    return texts.join(asked, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_hit long, item_ids array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, contaminated) for every row of `docs`."""
    texts = id_and_text(docs, id_col, text_col)
    terms = cut(item_terms(benchmark, item_col, item_text_col))
    items = cut(item_windows(terms, frequencies(texts, bit_set(terms)), window))
    anchored = items.select(F.explode("anchors").alias("at"), "terms").select(F.element_at("terms", F.col("at") + 1).alias("term"))
    index = postings(texts, bit_set(anchored))
    return phrases(texts, index, items, window).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def near_anchors(counts: np.ndarray, window: int, missing: int) -> list[int]:
    """Anchor places of the windows of these terms that a document may hold with at most `missing` words wanting. Of the
    `spare` + 2 rarest terms that occur, `spare` may be the wanting ones, so two are there (one, where a window needs no
    more). Every place of a rare term is an anchor, as each of them may be the one that is there."""
    width = min(window, len(counts))
    allowed = min(missing, width - 1)
    out: set[int] = set()
    for start in range(len(counts) - width + 1):
        own = counts[start: start + width]
        spare = allowed - int((own == 0).sum())
        if spare >= 0:
            order = [int(p) for p in np.argsort(own, kind="stable") if own[p] > 0]
            out.update(start + p for p in order[: spare + min(2, width - allowed)])
    return sorted(out)


def held(hashes: np.ndarray, terms: np.ndarray, lows: np.ndarray, slack: int, width: int) -> np.ndarray:
    """Per diagonal and window start: how many terms of the window stand at most `slack` words behind their place."""
    at = lows[:, None] + np.arange(len(terms))
    there = np.zeros(at.shape, bool)
    for step in range(slack + 1):
        there |= (at + step >= 0) & (at + step < len(hashes)) & (hashes[np.clip(at + step, 0, len(hashes) - 1)] == terms)
    sums = np.zeros((len(lows), len(terms) + 1), np.int32)
    np.cumsum(there, axis=1, out=sums[:, 1:])
    return sums[:, width:] - sums[:, :-width]


def proximity(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, slack: int = 2, missing: int = 2) -> DataFrame:
    """(doc_id, item_id, start, wanting, diagonal): a row per document, item and window start that match nearly (exact
    matches included), with the fewest wanting words and the least diagonal that attains them; of several texts of one item
    or id, the best. A window of one word must be there."""
    texts = id_and_text(docs, id_col, text_col)
    terms = cut(item_terms(benchmark, item_col, item_text_col))
    counts = frequencies(texts, bit_set(terms))
    whole = terms.join(counts, "term", "left").groupBy("item_id", "variant").agg(
        F.sort_array(F.collect_list(F.struct("at", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, w in zip(*(batch.column(c).to_pylist() for c in ("item_id", "w"))):
                ids, n = [x["term"] for x in w], np.array([x["n"] for x in w])
                width = min(window, len(ids))
                for first in range(0, len(ids) - width + 1, STARTS):
                    end = first + STARTS + width - 1
                    if places := near_anchors(n[first:end], width, missing):
                        rows.append((item, first, width, ids[first:end], places))
            types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["item_id", "first", "width", "terms", "places"])

    segments = cut(whole.mapInArrow(segmented, "item_id string, first int, width int, terms array<long>, places array<int>").withColumn(
        "segment", F.monotonically_increasing_id()))
    anchors = cut(segments.select("segment", F.least(F.lit(2), F.greatest(F.col("width") - missing, F.lit(1))).alias("least"), F.explode("places").alias("place"), "terms")
                  .withColumn("term", F.element_at("terms", F.col("place") + 1)).drop("terms"))
    index = postings(texts, bit_set(anchors))
    # the words of a match stand on `slack` + 1 neighbouring diagonals: these share a band with the one before it
    band = F.floor((F.col("at") - F.col("place")) / F.lit(slack + 1)).cast("int")
    lined = (
        index.join(anchors, "term").select("doc_id", "segment", "least", "place", F.explode(F.array(band, band - 1)).alias("band"))
        .groupBy("doc_id", "segment", "band").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.first("least").alias("least"))
        .filter((F.col("least") == 1) | (F.col("low") < F.col("high")))
    )
    asked = (
        lined.groupBy("doc_id", "segment").agg(F.collect_list("band").alias("bands"))
        .join(segments.drop("places"), "segment")
        .groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "first", "width", "terms", "bands")).alias("asked"))
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        # a match whose least apparent diagonal lies in a band begins at most `slack` before it
        offsets = np.arange(-slack, slack + 1)
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("asked").to_pylist()):
                hashes = words.of(words_of(text)).view(np.int64)
                if not len(hashes):
                    continue
                for x in own:
                    wanted, width = np.array(x["terms"], np.int64), x["width"]
                    lows = np.unique(np.array(x["bands"], np.int64)[:, None] * (slack + 1) + offsets)
                    n = held(hashes, wanted, lows, slack, width)
                    best, least = n.argmax(axis=0), width - min(missing, width - 1)
                    for k in np.flatnonzero(n.max(axis=0) >= least).tolist():
                        rows.append((doc, x["item_id"], x["first"] + k, width - int(n[best[k], k]), int(lows[best[k]]) + k))
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "start", "wanting", "diagonal"])

    found = texts.join(asked, "doc_id").mapInArrow(verified, "doc_id long, item_id string, start int, wanting int, diagonal int")
    return found.groupBy("doc_id", "item_id", "start").agg(F.min(F.struct("wanting", "diagonal")).alias("best")).select("doc_id", "item_id", "start", "best.*")
