"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut the same bytes (a space and the text) differently. Offsets where tokens of both end cut the tokens into
groups; the two tokens that end there are a link. A link's pair is counted over the whole corpus, and a link is best when
no other partner of its B id is counted more often.

Blocks of documents become runs: (pair, document, times) records, radix-partitioned by B id and sorted by (B id, A id),
each part a list of zstd frames; a run holds a pair once per document. Per part, runs are merged `fan_in` at a time by a
heap over the frames' last keys, which sums a pair's records; passes go on until one group is left, so no task holds more
than `fan_in` runs of a part and a frequent pair is one record per run. In the last pass, the order by B id puts all
partners of a B id together, so its highest count is known when its last partner has passed; counts and marks stream back
to the runs in the order of their own keys, through the same passes, and each run adds up its documents.

Both tokenizers end a token before a single space between two characters that are not white space: the byte-level rule
starts a word there, and no piece has a space behind another character (`Pair.load` checks both). So a text is cut there
into units which are aligned apart, and a unit that was seen before is looked up. Where a tokenizer has other rules, a
whole text is one unit. A byte-level vocabulary whose ids are in the order of its merges gives the same ids as a table of
ranks, which is read faster; it serves units of Latin letters, where no version of Unicode changes a character's class.

Cases: a null or empty text has no tokens, and neither has a text that a tokenizer does not give back byte by byte
(U+2581 stands for a space in pieces): zeros and an empty digest. Rows are aligned one by one, so a repeated row, id or
text counts each time; null ids are kept; an empty table gives an empty result; the length of a text is not limited.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import batches_by_bytes, cut, id_and_text, sha256, texts_of
from casegraph.session import scratch_path

BLOCK = 8 << 20         # bytes of text a run covers
PARTS = 32              # radix: B id modulo this
FAN_IN = 64             # runs merged at once
FRAME = 1 << 15         # records a zstd frame holds
CACHED = 300_000        # units a worker remembers from block to block, of at most CACHED_CHARS characters in all
CACHED_CHARS = 8 << 20

CLOSE = re.compile(r"\s | \s")
UNITS = re.compile(r" (\s*\S*(?:(?! \S)\s+\S*)*)")
LATIN = re.compile(r"[\x00-\u024f]+")
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def units_of(text: str) -> list[str]:
    """What stands between the cuts, each without the space in front of it."""
    if text[0].isspace() or text[-1].isspace() or CLOSE.search(text):
        return UNITS.findall(" " + text)
    return text.split(" ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            letters[chr(spare)] = b
            spare += 1
    return letters


@dataclass(frozen=True)
class Pair:
    """Both tokenizers as read on the driver; sent with each job (about 5 MB)."""

    a_model: str
    b_model: bytes
    apart: bool      # whether texts may be cut into units
    ranked: bool     # whether the ids of A are in the order of its merges

    @classmethod
    def load(cls, a_file: str, b_file: str) -> Pair:
        import sentencepiece

        with open(a_file, encoding="utf-8") as f:
            a_model = f.read()
        with open(b_file, "rb") as f:
            b_model = f.read()
        rules, pieces = json.loads(a_model), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        words = rules.get("normalizer") is None and rules["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        known = range(pieces.get_piece_size())
        plain = not any(re.search("[^▁]▁", pieces.id_to_piece(k)) for k in known)
        probe = "ﬁ é  Å \t x"  # a normalizer would change it
        apart = words and plain and pieces.decode(pieces.encode(probe)) == probe
        model = rules["model"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        ranks = [model["vocab"].get(m.replace(" ", ""), -1) for m in merges]
        return cls(a_model, b_model, apart, apart and not model.get("dropout") and 0 < len(ranks) and ranks == list(range(ranks[0], ranks[0] + len(ranks))))

    def aligner(self) -> Aligner:
        return Aligner(self)


class Seen(dict):
    """Unit -> its number, in the order of first sight."""

    def __missing__(self, unit: str) -> int:
        value = self[unit] = len(self)
        return value


class Aligner:
    """Aligned units of one worker: numbers of tokens, groups as text and links, by unit number."""

    def __init__(self, pair: Pair):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(pair.a_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b_model)
        self.apart = pair.apart
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_ids = max(vocabulary.values()) + 1
        self.a_bytes = [b""] * self.a_ids
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.said = [f"{k}{sign}" for k in range(max(self.a_ids, len(self.b_bytes))) for sign in ",|,;\n"]
        self.ranks = None
        if pair.ranked:
            import tiktoken

            special = {t.content for t in self.a.get_added_tokens_decoder().values()}
            table = {bytes(map(letters.__getitem__, t)): k for t, k in vocabulary.items() if t not in special}
            self.ranks = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=table, special_tokens={})
        self.forget()

    def _piece(self, k: int) -> bytes:
        text = self.b.id_to_piece(k)
        return bytes([int(text[3:5], 16)]) if self.b.is_byte(k) else text.replace("▁", " ").encode()

    def forget(self) -> None:
        self.seen, self.groups, self.chars = Seen(), [], 0
        self.counts = np.zeros((3, 0), np.int64)           # by unit: tokens of A and B, links (-1: text not given back)
        self.links = np.zeros(0, np.int64)

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of a space and each unit."""
        if self.ranks is None:
            a = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        else:
            a = [self.ranks.encode_ordinary(" " + u) if LATIN.fullmatch(u) else self.a.encode(" " + u, add_special_tokens=False).ids for u in units]
        return a, self.b.encode(units, num_threads=1)

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """Groups and links of the tokens of space + text; None if they spell something else."""
        whole = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        groups, links = [], []
        i = j = i0 = j0 = end_a = end_b = 0
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                end_a += len(self.a_bytes[a[i]])
                i += 1
            else:
                end_b += len(self.b_bytes[b[j]])
                j += 1
            if end_a == end_b:
                groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
                links.append(b[j - 1] * self.a_ids + a[i - 1])
                i0, j0 = i, j
        return ";".join(groups), links

    def all_aligned(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """Groups, link numbers and links of many units in one byte string; None if any does not give its text back."""
        whole = [b" " + u.encode() for u in units]
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        ends = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
        last_a, last_b = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) - 1 for x in (a, b))
        if not (np.array_equal(ends_a[last_a], ends) and np.array_equal(ends_b[last_b], ends)):
            return None
        data = b"".join(whole)
        if b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != data:
            return None
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        link_a, link_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        unit_ends = np.searchsorted(common, ends)
        n_links = np.diff(unit_ends + 1, prepend=0)
        # a token's text and the sign behind it: , inside a side, | after A, ; after a group, line feed after a unit
        sign_a, sign_b = np.zeros(len(flat_a), np.int64), np.full(len(flat_b), 2)
        sign_a[link_a], sign_b[link_b] = 1, 3
        sign_b[link_b[unit_ends]] = 4
        spelled = np.r_[flat_a * 5 + sign_a, flat_b * 5 + sign_b]
        order = np.argsort(np.r_[np.searchsorted(common, ends_a) * 2, np.searchsorted(common, ends_b) * 2 + 1], kind="stable")
        text = "".join(map(self.said.__getitem__, spelled[order].tolist()))
        return text.split("\n")[:-1], n_links, flat_b[link_b] * self.a_ids + flat_a[link_a]

    def learn(self, units: list[str]) -> None:
        """Align units that were not seen before."""
        counts, links = [self.counts], [self.links]
        for k in range(0, len(units), 16384):
            some = units[k: k + 16384]
            a, b = self.encoded(some)
            found = self.all_aligned(some, a, b) if all(b) else None
            if found is None:
                one_by_one = [self.aligned(*x) for x in zip(some, a, b)]
                found = ([f[0] if f else "" for f in one_by_one], np.array([len(f[1]) if f else -1 for f in one_by_one], np.int64),
                         np.array([x for f in one_by_one if f for x in f[1]], np.int64))
            self.groups += found[0]
            counts.append(np.stack([np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b)), found[1]]))
            links.append(found[2])
            self.chars += sum(map(len, some))
        self.counts, self.links = np.concatenate(counts, axis=1), np.concatenate(links)

    def block(self, texts: list[bytes | None]) -> Block:
        if len(self.seen) > CACHED or self.chars > CACHED_CHARS:
            self.forget()
        before = len(self.seen)
        decoded = [t.decode() if t else None for t in texts]
        units = [list(map(self.seen.__getitem__, units_of(t) if self.apart else [t])) if t else [] for t in decoded]
        if len(self.seen) > before:
            self.learn(list(islice(self.seen, before, None)))
        n_links, groups = self.counts[2], []
        ends = np.cumsum(n_links.clip(0))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        flat = np.fromiter(chain.from_iterable(units), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(units)), sizes)
        broken = np.zeros(len(units), bool)
        broken[owner[n_links[flat] < 0]] = True
        if broken.any():
            flat, owner = flat[~broken[owner]], owner[~broken[owner]]
        many = n_links[flat]
        counts = np.stack([np.bincount(owner, row[flat], len(units)).astype(np.int64) for row in self.counts])
        done = np.cumsum(many)
        keys = self.links[np.repeat(ends[flat] - done, many) + np.arange(int(many.sum()))]
        places = np.repeat(owner, many)
        for k, own in enumerate(units):
            text = None if broken[k] or not own else ";".join(map(self.groups.__getitem__, own))
            if broken[k]:  # units may differ where the whole does not: decided on the whole
                a, b = self.a.encode(" " + decoded[k], add_special_tokens=False).ids, self.b.encode(decoded[k])
                found = self.aligned(decoded[k], a, b)
                if found is not None:
                    text = found[0]
                    counts[:, k] = len(a), len(b), len(found[1])
                    keys, places = np.r_[keys, found[1]], np.r_[places, np.full(len(found[1]), k)]
            groups.append(text)
        return Block(groups, counts, keys, places)


@dataclass
class Block:
    groups: list[str | None]
    counts: np.ndarray   # tokens of A, tokens of B, links; by document
    keys: np.ndarray     # B id * size of A + A id, by link
    places: np.ndarray   # the link's document in the block


# zstd frames of integer columns

def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of any lengths as one frame; the first is ascending. Bytes of equal weight stand together."""
    import zstandard

    head = np.array([len(columns), *map(len, columns)], np.int64).tobytes()
    first = np.diff(columns[0], prepend=0)
    planes = [np.ascontiguousarray(np.asarray(c, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(frame: bytes) -> list[np.ndarray]:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    n = int(data[:8].view(np.int64)[0])
    sizes, at, columns = data[8: 8 + 8 * n].view(np.int64), 8 + 8 * n, []
    for size in sizes.tolist():
        columns.append(np.ascontiguousarray(data[at: at + 8 * size].reshape(8, size).T).view("<i8").reshape(size))
        at += 8 * size
    return [np.cumsum(columns[0]), *columns[1:]]


def frames_of(*columns: np.ndarray) -> list[bytes]:
    return [pack(*[c[k: k + FRAME] for c in columns]) for k in range(0, len(columns[0]), FRAME)]


class Cursor:
    """A run's records in the order of their keys, one frame in memory at a time."""

    def __init__(self, frames: Iterable[bytes]):
        self.frames = iter(frames)
        self.advance()

    def advance(self) -> None:
        frame = next(self.frames, None)
        self.columns = None if frame is None else unpack(frame)

    @property
    def last(self) -> int | None:
        """The current frame's last key; None at the end."""
        return None if self.columns is None else int(self.columns[0][-1])

    def upto(self, key: int) -> list[list[np.ndarray]]:
        """The records up to a key, which are passed by."""
        taken = []
        while self.columns is not None:
            n = int(np.searchsorted(self.columns[0], key, side="right"))
            taken.append([c[:n] for c in self.columns])
            if n < len(self.columns[0]):
                self.columns = [c[n:] for c in self.columns]
                break
            self.advance()
        return taken


def heap_merge(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, summed counts) of all runs, ascending. The heap holds each run's last key in memory: everything up to the
    smallest of these is in memory and can go out."""
    cursors = [Cursor(frames) for frames in runs]
    heap = [(c.last, k) for k, c in enumerate(cursors) if c.last is not None]
    heapq.heapify(heap)
    while heap:
        limit = heap[0][0]
        parts = [part for c in cursors if c.columns is not None for part in c.upto(limit)]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield keys[heads], np.add.reduceat(counts, heads)
        while heap and heap[0][0] <= limit:
            k = heapq.heappop(heap)[1]
            if cursors[k].last is not None:
                heapq.heappush(heap, (cursors[k].last, k))


def with_maxima(merged: Iterator[tuple[np.ndarray, np.ndarray]], a_ids: int) -> Iterator[list[np.ndarray]]:
    """(keys, counts, best): a B id's records wait until the next B id shows that its highest count is known."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def marked(n: int) -> list[np.ndarray]:
        side = keys[:n] // a_ids
        heads = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
        top = np.repeat(np.maximum.reduceat(counts[:n], heads), np.diff(np.r_[heads, n]))
        return [keys[:n], counts[:n], (counts[:n] == top).astype(np.int64)]

    for more_keys, more_counts in merged:
        keys, counts = np.r_[keys, more_keys], np.r_[counts, more_counts]
        whole = int(np.searchsorted(keys, keys[-1] // a_ids * a_ids))
        if whole:
            yield marked(whole)
            keys, counts = keys[whole:], counts[whole:]
    if len(keys):
        yield marked(len(keys))


def handed_down(marked: Iterable[list[np.ndarray]], runs: list[list[bytes]]) -> list[list[bytes]]:
    """Each run's own keys with the counts and marks of the whole, as frames in the order of its keys."""
    cursors, own = [Cursor(frames) for frames in runs], [[] for _ in runs]
    for keys, counts, best in marked:
        for cursor, out in zip(cursors, own):
            if cursor.columns is None:
                continue
            parts = [p[0] for p in cursor.upto(int(keys[-1])) if len(p[0])]
            if parts:
                mine = np.concatenate(parts)
                at = np.searchsorted(keys, mine)
                out.extend(frames_of(mine, counts[at], best[at]))
    return own


# Spark jobs

FRAMES = "array<binary>"
RUN_SCHEMA = f"run long, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, digest array<string>, groups array<string>, heads array<{FRAMES}>, postings array<{FRAMES}>"
RUN_ARROW = [
    ("run", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("digest", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), ("heads", pa.list_(pa.list_(pa.binary()))), ("postings", pa.list_(pa.list_(pa.binary())))]


def run_parts(block: Block, a_ids: int, parts: int) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """Per radix part: frames of (pair, count) and frames of (pair's number, document, times)."""
    n = max(1, len(block.groups))
    records, times = np.unique(block.keys * n + block.places, return_counts=True)
    keys, places = records // n, records % n
    heads, postings, part_of = [], [], keys // a_ids % parts
    for part in range(parts):
        mine = part_of == part
        own, own_times = keys[mine], times[mine]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        number = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(own)]))
        heads.append(frames_of(own[first], np.add.reduceat(own_times, first)) if len(own) else [])
        postings.append(frames_of(number, places[mine], own_times))
    return heads, postings


def write_runs(docs: DataFrame, pair: Pair, id_col: str, text_col: str, with_groups: bool, block_bytes: int, parts: int) -> DataFrame:
    """The runs as a table in the shared folder: what a lost executor had is made again, what was written is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = pair.aligner(), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        size = 0

        def written() -> pa.RecordBatch:
            block = aligner.block(texts)
            heads, postings = run_parts(block, aligner.a_ids, parts)
            digest = ["" if g is None else sha256(g.encode()) for g in block.groups]
            row = [number, ids, *block.counts.tolist(), digest, [g or "" for g in block.groups] if with_groups else None, heads, postings]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(row, RUN_ARROW)], [name for name, _ in RUN_ARROW])

        for batch in batches:
            for piece in batches_by_bytes(iter([batch]), "text", block_bytes):
                ids += piece.column("doc_id").to_pylist()
                texts += texts_of(piece.column("text"))
                size += piece.column("text").nbytes
                if size >= block_bytes:
                    yield written()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield written()

    path = scratch_path(docs.sparkSession, "alignment-runs")
    id_and_text(docs, id_col, text_col).mapInArrow(run, RUN_SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(RUN_SCHEMA).parquet(path)


def arrow_rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(schema)], [name for name, _ in schema])


LEVEL = [("part", pa.int32()), ("run", pa.int64()), ("frames", pa.list_(pa.binary()))]


def spill_count(runs: DataFrame, a_ids: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(part, run, frames) of (pair, corpus count, best): of the written runs, and of the merged whole (one row a part)."""
    leaves = runs.select("run", F.posexplode("heads").alias("part", "frames")).select("part", "run", "frames")
    levels, n = [leaves], runs.count()

    def up(group: tuple, table: pa.Table) -> pa.Table:
        frames = [f for block in heap_merge(table.column("frames").to_pylist()) for f in frames_of(*block)]
        return arrow_rows(LEVEL, [(group[0].as_py(), group[1].as_py(), frames)])

    def settled(group: tuple, table: pa.Table) -> pa.Table:
        own = table.column("frames").to_pylist()
        whole = list(with_maxima(heap_merge(own), a_ids))
        back = handed_down(whole, own)
        top = [f for block in whole for f in frames_of(*block)]
        return arrow_rows(LEVEL, [(group[0].as_py(), None, top), *((group[0].as_py(), r, f) for r, f in zip(table.column("run").to_pylist(), back))])

    def down(group: tuple, above: pa.Table, below: pa.Table) -> pa.Table:
        marked = (unpack(f) for frames in above.column("frames").to_pylist() for f in frames)
        back = handed_down(marked, below.column("frames").to_pylist())
        return arrow_rows(LEVEL, [(group[0].as_py(), r, f) for r, f in zip(below.column("run").to_pylist(), back)])

    parents = []
    while n > fan_in:
        n = math.ceil(n / fan_in)
        parents.append(n)
        below = levels[-1].withColumn("parent", F.pmod(F.xxhash64("run"), F.lit(n)))
        levels[-1] = below
        levels.append(cut(below.groupBy("part", "parent").applyInArrow(up, f"part int, run long, frames {FRAMES}")))
    top = cut(levels[-1].groupBy("part").applyInArrow(settled, f"part int, run long, frames {FRAMES}"))
    marked = top.filter("run IS NOT NULL")
    for below in reversed(levels[:-1]):
        above = marked.withColumnRenamed("run", "parent")
        marked = cut(above.groupBy("part", "parent").cogroup(below.groupBy("part", "parent")).applyInArrow(down, f"part int, run long, frames {FRAMES}"))
    return marked, top.filter("run IS NULL")


DOC_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False,
          block_bytes: int = BLOCK, parts: int = PARTS, fan_in: int = FAN_IN) -> DataFrame:
    """Per row: token, group and link numbers, links that are best, the sum of the links' counts and the groups' digest;
    with `with_groups`, also the groups `a1,a2|b1;a3|b2,b3` themselves."""
    pair = Pair.load(a_file, b_file)
    runs = write_runs(docs, pair, id_col, text_col, with_groups, block_bytes, parts)
    marked, _ = spill_count(runs, pair.aligner().a_ids, fan_in)
    back = marked.groupBy("run").agg(F.collect_list(F.struct("part", "frames")).alias("marks"))  # `parts` rows a run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                sums = np.zeros((2, len(row["doc_id"])), np.int64)
                for mark in row["marks"] or []:
                    if not mark["frames"]:
                        continue
                    _, counts, best = (np.concatenate(c) for c in zip(*map(unpack, mark["frames"])))
                    for number, place, times in map(unpack, row["postings"][mark["part"]]):
                        np.add.at(sums[0], place, times * best[number])
                        np.add.at(sums[1], place, times * counts[number])
                columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_links"], row["n_links"], *sums.tolist(), row["digest"]]
                arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())]
                names = DOC_SCHEMA.replace(" long", "").replace(" string", "").split(", ")
                if with_groups:
                    arrays, names = [*arrays, pa.array(row["groups"], pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    read = ["run", "doc_id", "n_a", "n_b", "n_links", "digest", "postings", *["groups"] * with_groups]
    return runs.select(*read).join(back, "run", "left").mapInArrow(added, DOC_SCHEMA + ", groups string" * with_groups)


def pair_counts(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK, parts: int = PARTS, fan_in: int = FAN_IN) -> DataFrame:
    """The alignment table itself: (a_id, b_id, count, best) of every pair that is linked anywhere."""
    pair = Pair.load(a_file, b_file)
    a_ids = pair.aligner().a_ids
    _, whole = spill_count(write_runs(docs, pair, id_col, text_col, False, block_bytes, parts), a_ids, fan_in)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frames in batch.column("frames").to_pylist():
                for keys, counts, best in map(unpack, frames):
                    yield pa.RecordBatch.from_arrays([pa.array(keys % a_ids), pa.array(keys // a_ids), pa.array(counts), pa.array(best > 0)], ["a_id", "b_id", "count", "best"])

    return whole.select("frames").mapInArrow(rows, "a_id long, b_id long, count long, best boolean")
