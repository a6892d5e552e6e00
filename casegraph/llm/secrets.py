"""Secret scan: fixed patterns plus a token-efficiency test.

A tokenizer's vocabulary holds what its language repeats: words give four characters a token or more, random strings
fewer than two. In every run of `shortest` characters or more of the alphabet of keys, each token scores `ratio` less its
characters; a stretch of tokens whose scores sum to `surplus` or more is random, wherever it lies in the run and however
long the run is. A stretch ends where its sum has fallen by `surplus` from its best. Where the whole run scores above zero
and holds such a stretch, the whole run is the span, else the stretch is; its kind is `random`, whatever letters and digits
it mixes. Base spans cut a run, and so do known digests and identifiers: hex of a digest's length, UUIDs, subresource
hashes, numbers and a date in front.

Tokens are counted in pieces of `PIECE` characters, so the work is linear in the run.

Cases: null text is empty and has no span; rows are scanned one by one, so repeated rows, null ids and empty tables need
no rule; a text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from casegraph.llm import spans
from casegraph.llm.common import id_and_text

KINDS = ("assign", "access", "hex", "random")
FINDERS = (spans.assigns, spans.accesses, spans.hexes)
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+")
SHORTEST, PIECE = 12, 256            # PIECE bounds what is tokenized at once, not what is found
RATIO, SURPLUS = 2.4, 7.0
EDGES = "=-_/+"
#: Digests and identifiers that look random and are no secrets.
KNOWN = re.compile(
    r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|sha(?:1|256|384|512)-[A-Za-z0-9+/=]{27,128}|[0-9_/+=-]+")
KNOWN_PART = re.compile(rf"(?<![0-9A-Za-z])(?:{KNOWN.pattern})(?![0-9A-Za-z])")
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])")
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def read_ranks(vocabulary_file: str) -> dict[bytes, int]:
    """A public rank file: a base64 token and its rank per line."""
    with open(vocabulary_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokenizer_of(ranks: dict[bytes, int]):
    import tiktoken

    words = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("secrets", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, taken: list[spans.Span], shortest: int) -> Iterator[spans.Span]:
    """Runs without the base spans and known values in them and without a date in front, stripped of signs at the ends."""
    taken, first = sorted(taken), 0
    for m in RUN.finditer(text):
        while first < len(taken) and taken[first][1] <= m.start():
            first += 1
        at, k = m.start(), first
        while at < m.end():
            stop = min(m.end(), max(at, taken[k][0])) if k < len(taken) else m.end()
            if stop - at >= shortest:
                date = DATE.match(text, at, stop)
                start = date.end() if date else at
                for known in [*KNOWN_PART.finditer(text, start, stop), None]:
                    left = text[start: known.start() if known else stop].lstrip(EDGES)
                    part, end = left.rstrip(EDGES), known.start() if known else stop
                    if len(part) >= shortest:
                        yield end - len(left), end - len(left) + len(part)
                    start = known.end() if known else stop
            at = max(at, taken[k][1]) if k < len(taken) else m.end()
            k += 1


def random_parts(sizes: list[int], ratio: float, surplus: float) -> list[spans.Span]:
    """Stretches (in characters) of tokens of these sizes whose scores `ratio - size` sum to `surplus` or more."""
    found, total, best, at = [], 0.0, 0.0, 0
    start = end = 0
    for size in sizes:
        if total <= 0.0:
            total, best, start, end = 0.0, 0.0, at, at
        total += ratio - size
        at += size
        if total > best:
            best, end = total, at
        if total <= best - surplus or total <= 0.0:
            if best >= surplus:
                found.append((start, end))
            total = best = 0.0
    if best >= surplus:
        found.append((start, end))
    return found


def random_runs(text: str, tokens_of, size_of: dict[int, int], taken: list[spans.Span], ratio: float = RATIO, surplus: float = SURPLUS, shortest: int = SHORTEST) -> list[spans.Span]:
    found: list[spans.Span] = []
    for start, end in stretches(text, taken, shortest):
        sizes = [size_of[t] for k in range(start, end, PIECE) for t in tokens_of(text[k: min(k + PIECE, end)])]
        parts = random_parts(sizes, ratio, surplus)
        if parts and ratio * len(sizes) > end - start:
            found.append((start, end))
        else:
            found += [(start + a, start + b) for a, b in parts]
    return found


def scan(docs: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text",
         ratio: float = RATIO, surplus: float = SURPLUS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, spans): kind, start, end and whether a base pattern found it, by start, then kind."""
    if shortest < SHORTEST:
        raise ValueError(f"runs are read from {SHORTEST} characters on")
    ranks = read_ranks(vocabulary_file)
    size_of = {rank: len(token) for token, rank in ranks.items()}  # runs are ASCII

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = [(start, k, end, True) for k, find in enumerate(FINDERS) for start, end in find(text or "")]
                if text and RUN.search(text):
                    encoding = encoding or tokenizer_of(ranks)
                    taken = [(s, e) for s, _, e, _ in found]
                    found += [(s, 3, e, False) for s, e in random_runs(text, encoding.encode_ordinary, size_of, taken, ratio, surplus, shortest)]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, SPAN)], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPAN_SQL}")
