"""Toxicity by a weighted finite-state grammar over clauses.

* A lexicon of insults is learned from labels: words and word beginnings that stand in toxic documents far more often
  than chance allows (Chernoff bound on the tail, false discovery rate `rate`). Equal texts count once, and copies that
  differ a little share a MinHash value and count once per value, so a family of copies proves nothing by its size.
* Word lists give the other classes: threats, targets, negation, reported speech. A word's class is its symbol.
* Transducers read a clause's symbols and compose: ``negate`` marks what follows a negation within two words, ``report``
  marks what follows a verb of saying or stands in quotes, ``aim`` joins an insult or threat with a target within four
  words. Their output is one pattern per insult or threat: (kind, aimed, negated, reported).
* A document's score is a logistic function of how many clauses match each pattern; the patterns' weights start from the
  grammar's own (aimed counts more, negated and reported less) and are fitted on the labels with a pull towards them.

Learning uses at most `max_rows` labelled rows per class, those with the least hash of their id, never rows of the
held-out third. Labels, lang, source and id are no input of a score.

Cases: null or empty text has no clause and gets the base score; repeated rows score alike; a null id is never used for
learning and is not held out; without labels of both classes the grammar's own weights score with an empty lexicon.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import cut, id_and_text, mix64, texts_of

#: Letters and apostrophes stay, A-Z become a-z; marks that end a clause and quotes are symbols of their own.
END, QUOTE = b"|", b'"'
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))
KEPT = bytes(b if b in END + QUOTE else WORDS[b] for b in range(256))
MARKS = [(mark, b" " + END + b" ") for mark in (b".", b"!", b"?", b";", b":", b"\n")] + [(b'"', b" \" ")]

#: Word lists in the four languages of the tables (fixed values).
THREAT = "kill hurt destroy burn beat shoot stab punch crush tuer frapper brûler töten schlagen verbrennen umbringen matar golpear quemar".split()
TARGET = "you your you're youre he she they them him her his their these those people tu vous toi ton ta tes ils elles du dich dir euch ihr sie usted ustedes vosotros ellos ellas tú".split()
NEGATE = "not never no isn't aren't don't won't cannot pas jamais non nicht nie kein keine nunca jamás".split()
REPORT = "said says say wrote called calls claims claimed quoted dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split()
KINDS = ("insult", "threat")
N_PATTERNS = 8
#: The grammar's own weights by (kind, aimed, negated, reported) bits; a clause counts for its heaviest pattern.
BIAS = -3.0
OWN = np.array([(2.5, 0.5)[kind] + 1.0 * aimed for kind in (0, 1) for aimed in (0, 1) for _ in (0, 1)])
SOFTER = 1.2  # less when negated or reported
STEM = (4, 5, 6)


def symbols(text: bytes) -> list[bytes]:
    for mark, spaced in MARKS:
        text = text.replace(mark, spaced)
    return text.translate(KEPT).split()


def features_of(words: set[bytes]) -> set[str]:
    """Words, and beginnings of words (of `STEM` characters, marked by a star)."""
    out = set()
    for w in words:
        word = w.decode(errors="ignore")
        if len(word) >= 3:
            out.add(word)
            out.update(word[:n] + "*" for n in STEM if len(word) > n)
    return out


@dataclass(frozen=True)
class Grammar:
    insults: frozenset[str]
    weights: np.ndarray      # by pattern: kind, aimed, soft
    bias: float

    def classes(self) -> Classes:
        return Classes(self.insults)


class Classes(dict):
    """Word -> class letter: i insult, t threat, a target, n negation, r report, e clause end, q quote, - other."""

    def __init__(self, insults: frozenset[str], limit: int = 400_000):
        super().__init__()
        self.insults, self.limit = insults, limit
        self.listed = {w.encode(): c for c, own in (("t", THREAT), ("a", TARGET), ("n", NEGATE), ("r", REPORT)) for w in own}
        self.listed.update({END: "e", QUOTE: "q"})

    def __missing__(self, word: bytes) -> str:
        if len(self) >= self.limit:
            self.clear()
        found = self.listed.get(word)
        if found is None:
            text = word.decode(errors="ignore")
            hit = text in self.insults or any(text[:n] + "*" in self.insults for n in STEM if len(text) > n)
            found = "i" if hit else "-"
        self[word] = found
        return found


def negate(clause: str) -> set[int]:
    """Positions within two words after a negation."""
    return {k + d for k, c in enumerate(clause) if c == "n" for d in (1, 2)}


def report(clause: str, quoted: bool) -> tuple[set[int], bool]:
    """Positions after a verb of saying or inside quotes, and whether a quote stays open."""
    out, said = set(), False
    for k, c in enumerate(clause):
        quoted ^= c == "q"
        said |= c == "r"
        if said or quoted:
            out.add(k)
    return out, quoted


def aim(clause: str) -> set[int]:
    """Positions with a target within four words on either side."""
    return {k for k, c in enumerate(clause) if c in "it" and "a" in clause[max(0, k - 4): k + 5]}


def patterns(line: str) -> np.ndarray:
    """How many clauses match each pattern, from a document's class letters."""
    counts, quoted = np.zeros(N_PATTERNS), False
    for clause in line.split("e"):
        if "i" not in clause and "t" not in clause:
            quoted ^= bool(clause.count("q") % 2)
            continue
        negated, aimed = negate(clause), aim(clause)
        reported, quoted = report(clause, quoted)
        for k, c in enumerate(clause):
            if c in "it":
                soft = k in negated or k in reported
                if c == "t" and k not in aimed:
                    continue  # a threat needs someone
                counts[4 * (c == "t") + 2 * (k in aimed) + soft] += 1
    return counts


def matched(text: bytes | None, classes: Classes) -> np.ndarray:
    return patterns("".join(map(classes.__getitem__, symbols(text or b""))))


def scores(counts: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bias + np.log1p(counts) @ weights, -30, 30)))


def own_weights() -> np.ndarray:
    soft = np.tile([0.0, SOFTER], N_PATTERNS // 2)
    return (OWN - soft) / np.log(2)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _family(words: list[bytes]) -> int:
    """The least hash of word triples: copies that differ a little mostly share it."""
    import xxhash

    own = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[k: k + 3])) for k in range(max(1, len(words) - 2))), np.uint64)
    return int(mix64(own).min().view(np.int64))


def lexicon(sample: DataFrame, rate: float) -> frozenset[str]:
    """Features that mark toxic documents beyond chance, from (text, toxic) rows."""

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(symbols(t or b""), x) for t, x in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist())]
            made = [(w, x) for w, x in made if w]
            yield pa.RecordBatch.from_arrays([
                pa.array([_family(w) for w, _ in made], pa.int64()), pa.array([x for _, x in made], pa.int32()),
                pa.array([sorted(features_of(set(w))) for w, _ in made], pa.list_(pa.string()))], ["family", "toxic", "features"])

    # one row of a family and label stands for all
    rows = sample.mapInArrow(families, "family long, toxic int, features array<string>").groupBy("family", "toxic").agg(F.max("features").alias("features"))
    rows = cut(rows)
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return frozenset()
    base = n_toxic / (n_toxic + n_clean)
    stats = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    p = F.col("t") / F.col("n")
    clean = F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - base))).otherwise(F.lit(0.0))
    # the tail of a binomial is at most exp(-n KL(p, base)); as -log p
    stats = cut(stats.filter(p >= 0.5).withColumn("surprise", F.col("n") * (p * F.log(p / F.lit(base)) + clean)))
    tested = rows.select(F.explode("features").alias("feature")).agg(F.approx_count_distinct("feature")).first()[0]
    # Benjamini-Hochberg: features sorted by surprise, the k-th needs exp(-surprise) <= rate k / tested
    steps = sorted(((r.s, r.k) for r in stats.groupBy(F.round("surprise", 2).alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    seen, limit = 0, None
    for s, k in steps:
        seen += k
        if np.exp(-s) <= rate * seen / max(1, tested):
            limit = s
    if limit is None:
        return frozenset()
    listed = {*THREAT, *TARGET, *NEGATE, *REPORT}
    rows = stats.filter((F.round("surprise", 2) >= float(limit)) & (F.col("t") >= 3)).select("feature", "t", "n").collect()
    return chosen({r.feature: (r.t, r.n - r.t) for r in rows if r.feature not in listed})


def chosen(found: dict[str, tuple[int, int]]) -> frozenset[str]:
    """From features with their toxic and clean counts: a beginning that clean documents hold gives way to a longer
    feature that marks nearly as many toxic ones and fewer clean ones; what a listed beginning covers needs no entry."""
    kept = {f for f, (t, c) in found.items() if not (f.endswith("*") and any(
        g != f and g.startswith(f[:-1]) and found[g][0] >= 0.95 * t and found[g][1] < c for g in found))}
    return frozenset(f for f in kept if not any(f.rstrip("*")[:n] + "*" in kept for n in STEM if n < len(f.rstrip("*"))))


def fitted(counts: np.ndarray, toxic: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on pattern counts, by Newton steps, with a pull towards the grammar's own weights."""
    x = np.c_[np.log1p(counts), np.ones(len(counts))]
    prior = np.r_[own_weights(), BIAS]
    strength = np.r_[np.full(N_PATTERNS, pull), 0.01]
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        w = w - np.linalg.solve(hessian, gradient)
    return np.r_[np.maximum(w[:N_PATTERNS], 0.0)], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = 4000, rate: float = 0.05) -> Grammar:
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = cut(marks)
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Grammar(frozenset(), own_weights(), BIAS)
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = F.create_map(*[v for k, n in sizes.items() for v in (F.lit(k), F.lit(int(min(1.0, max_rows / n) * (1 << 30))))])
    picked = marks.filter(place < share[F.col("toxic")])
    sample = cut(id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("text", "toxic"))  # about 2 max_rows ids
    insults = lexicon(sample, rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(insults)
        for batch in batches:
            rows = [matched(t, classes).tolist() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], ["counts", "toxic"])

    rows = sample.mapInArrow(count, "counts array<double>, toxic int").collect()
    if not rows:
        return Grammar(frozenset(), own_weights(), BIAS)
    weights, bias = fitted(np.array([r.counts for r in rows]), np.array([r.toxic for r in rows], float))
    return Grammar(insults, weights, bias)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = grammar.classes()
        for batch in batches:
            counts = np.array([matched(t, classes) for t in texts_of(batch.column("text"))]).reshape(-1, N_PATTERNS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(counts, grammar.weights, grammar.bias), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def acceptable(docs: DataFrame, grammar: Grammar, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays below the limit."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = grammar.classes()
        for batch in batches:
            counts = np.array([matched(t, classes) for t in texts_of(batch.column(at))]).reshape(-1, N_PATTERNS)
            yield batch.filter(pa.array(scores(counts, grammar.weights, grammar.bias) < limit))

    return docs.mapInArrow(run, docs.schema)
