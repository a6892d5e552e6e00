"""Near-duplicate groups by one-permutation MinHash.

1. ``sketches``: one pass over the words gives a document's distinct shingles (64-bit hashes), sorted. Equal cuts of the
   hash range are the bins of one permutation, the least hash in a bin is its value. Empty bins borrow from a non-empty
   one chosen by a hash of (bin, attempt) - optimal densification - and consecutive bins form bands.
2. Documents with equal shingle sets collapse to their smallest id before anything is paired.
3. ``candidates``: per band the documents with one value form a bucket. A bucket of m gives m - 1 edges, to its centre:
   the member that shares the most buckets, as the origin of a family does.
4. ``verified``: links are confirmed on the full sets.
5. ``leftovers``: members of one centre that ended in different components are compared too, unless a bound forbids a
   link: their sizes, what each shares with the centre, and what each has outside it that anyone else has. So the star
   loses no link of its bucket, and a family that is one component costs nothing.

With the default 32 bands of 5 bins a pair at similarity 0.85 shares no band with probability 7e-9 (at 0.8: 3e-6).

Cases: words are runs of non-space; fewer words than a shingle are one shingle; null or wordless texts are linked with
nothing and are their own component; rows repeated under one id count once per id in the groups and each row is
returned; a null id is returned as its own, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import WordHashes, cut, id_and_text, mix64, texts_of
from casegraph.llm.components import components

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of each `width` consecutive words; fewer words are one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix64(total + words[k: k + n] * FACTORS[k % 4])
    return np.unique(total)


def densified(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The least shingle of each bin; empty bins filled by optimal densification."""
    cuts = np.searchsorted((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32), np.arange(bins + 1, dtype=np.uint64))
    full = cuts[1:] > cuts[:-1]
    values = shingles[np.minimum(cuts[:-1], len(shingles) - 1)].copy()
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        donor = (mix64(empty.astype(np.uint64) * FACTORS[0] + np.uint64(attempt * int(FACTORS[1]) % (1 << 64))) % np.uint64(bins)).astype(np.int64)
        ready = full[donor]
        values[empty[ready]] = values[donor[ready]]
        empty, attempt = empty[~ready], attempt + 1
    return values


def sketches(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands): set size, 128-bit hash of the set, band values (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = WordHashes()
        spread = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            sizes, first, second, flat, ends = [], [], [], [], [0]
            for text in texts_of(batch.column("text")):
                own = shingle_set(words.of((text or b"").lower().split()), width)
                sizes.append(len(own))
                pair = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                first.append(int(pair[0]))
                second.append(int(pair[1]))
                if len(own):
                    values, band = densified(own, bands * rows).reshape(bands, rows), spread
                    for k in range(rows):
                        band = mix64(band + values[:, k] * FACTORS[k % 4])
                    flat.append(band)
                ends.append(ends[-1] + (bands if len(own) else 0))
            values = np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists],
                ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return texts.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, stars) from (doc_id, n, bands): bucket members (band, doc_id, n, centre) and distinct star edges."""
    rows = sets.select("doc_id", "n", F.explode("bands").alias("band"))
    sizes = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = cut(rows.join(sizes, "band"))
    shared = members.groupBy("doc_id").agg(F.sum("size").alias("shared"))
    centres = cut(
        members.select("band", "doc_id").join(cut(shared), "doc_id")
        .groupBy("band").agg(F.max(F.struct("shared", (-F.col("doc_id")).alias("least"))).alias("top"))
        .select("band", (-F.col("top.least")).alias("centre"))
    )
    placed = cut(members.drop("size").join(centres, "band"))
    stars = placed.filter("doc_id <> centre").select(
        F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    return placed, stars


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles array<long>): the full sets of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            own = [shingle_set(words.of((t or b"").lower().split()), width) for t in texts_of(batch.column("text"))]
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["doc_id", "shingles"])

    return texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(run, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, both, na, nb): exact sizes of the intersection and of the full sets (doc_id, shingles)."""
    return (
        pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")
        .select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"), F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"))
    )


def is_link(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent


def leftovers(placed: DataFrame, stars: DataFrame, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs under one centre, in different components, that no bound excludes.

    With c the centre, a set's part in c and its part outside, counting outside only shingles that another open document
    holds too: |a & b| <= min(|a & c|, |b & c|) + min(out(a), out(b)). A document is asked only if the shingles it shares
    with anyone suffice, and only documents outside the centre's component ask."""
    named = labels.withColumnRenamed("node", "doc_id")
    of_centre = labels.select(F.col("node").alias("centre"), F.col("component").alias("c_component"))
    members = placed.filter("doc_id <> centre").select("centre", "doc_id", "n").distinct().join(named, "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    members = cut(members)
    mixed = cut(members.groupBy("centre").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("centre"))
    open_ = members.join(mixed, "centre").join(of_centre, "centre", "left").withColumn("c_component", F.coalesce("c_component", "centre"))
    open_ = open_.withColumn("a", F.least("doc_id", "centre")).withColumn("b", F.greatest("doc_id", "centre"))
    open_ = cut(open_.join(stars.select("a", "b", "both"), ["a", "b"]).drop("a", "b"))
    asked = open_.select(F.explode(F.array("doc_id", "centre")).alias("doc_id")).distinct()
    tokens = full.join(asked, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("shingle"))
    several = cut(tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("shingle"))
    shared = tokens.join(several, "shingle").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))
    open_ = cut(open_.join(cut(shared), "doc_id").filter(F.col("shared") * 100 >= F.col("n") * percent).withColumn("out", F.col("shared") - F.col("both")))
    x, y = open_.filter("component <> c_component").alias("x"), open_.alias("y")
    col = lambda c: (F.col(f"x.{c}"), F.col(f"y.{c}"))
    most = F.least(*col("both")) + F.least(*col("out"))
    once = (F.col("y.component") == F.col("y.c_component")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    fits = (F.least(*col("n")) * 100 >= F.greatest(*col("n")) * percent) & (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent)
    return x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.component") != F.col("y.component")) & once & fits).select(
        F.least(*col("doc_id")).alias("a"), F.greatest(*col("doc_id")).alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
           bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    texts = id_and_text(docs, id_col, text_col)
    sketched = cut(sketches(texts, width, bands, rows))
    worded = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(worded.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r")).select(
        "s1", "s2", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.bands"))
    sets = classes.select("doc_id", "n", "bands")
    known = texts.filter(F.col("doc_id").isNotNull())
    placed, stars = candidates(sets)
    stars = cut(stars)
    # the sets of every document of a bucket, read from the texts once
    full = cut(_sets(known, stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width))
    checked = cut(verified(stars, full))
    linked = cut(checked.filter(is_link(percent)).select("a", "b"))
    labels = components(linked)
    rest = cut(leftovers(placed, checked, labels, full, percent))
    if not rest.isEmpty():
        labels = components(linked.unionByName(verified(rest, full).filter(is_link(percent)).select("a", "b")))
    of_class = cut(classes.select("s1", "s2", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "s1", "s2", F.coalesce("component", "doc_id").alias("class_id")))
    named = sketched.select("doc_id", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
