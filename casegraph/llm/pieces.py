"""SentencePiece encoding by forward filtering, backward sampling; lossless decoding.

The lattice of a text has a node per byte and an edge per vocabulary piece. Forward filtering sums, for each node, the
weight of all paths that reach it; backward sampling walks from the end and takes each incoming edge with its share of
that sum. The result is an exact draw from all segmentations, with probability in proportion to the product of the
pieces' weights. Random numbers are a hash of (seed, row key, unit, step), so a row's segmentation depends on its key
and text only, not on partitions, batches or retries.

No piece has a space behind another character and line feeds are always bytes, so every path passes the node before
such a space or beside a line feed: the lattice splits there into units whose segmentations are independent. Units
repeat, so the forward pass runs once per distinct unit of a batch, for all of them together; sampling steps all
occurrences together.

The vocabulary file is a BPE model, whose scores are merge ranks, not probabilities; a piece of rank r gets the weight
(r + 2) ** -alpha. A larger `alpha` brings the draws closer to the best path. A character that is no piece becomes its
byte pieces, and so does a literal U+2581, which the model writes for a space: so decoding gives back any text exactly.

Cases: null text gives null ids; an empty text gives none; the same key and text give the same ids in every row; a null
key is a key of its own; very long texts and words without a space are ordinary (work grows with their bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casegraph.llm.common import batches_by_bytes, mix64, sha256, texts_of

BOUNDARY = rb"\n| *[^ \n]+| +"
BATCH = 2 << 20


@dataclass(frozen=True)
class Vocabulary:
    """A model's pieces as bytes (a space for U+2581), their trie and weights. About 2 MB, sent with each job."""

    spelled: list[bytes]      # by id, what a piece decodes to
    parent: np.ndarray        # trie: child k + 1 hangs below parent[k] by letter[k]
    letter: np.ndarray
    piece_at: np.ndarray      # trie node -> piece id or -1
    weight: np.ndarray        # by id, log
    byte_piece: np.ndarray    # byte -> id

    @classmethod
    def load(cls, model_file: str, alpha: float = 1.0) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spelled, byte_piece, weight = [], np.zeros(256, np.int32), np.zeros(model.get_piece_size())
        nodes: dict[tuple[int, int], int] = {}
        parent, letter, piece_at = [], [], {}
        for k in range(model.get_piece_size()):
            text = model.id_to_piece(k)
            weight[k] = -alpha * np.log(2.0 + max(0.0, -model.get_score(k)))
            if model.is_control(k) or model.is_unknown(k):
                spelled.append(b"")
            elif model.is_byte(k):
                value = int(text[3:5], 16)
                byte_piece[value] = k
                weight[k] = -alpha * np.log(2.0 + model.get_piece_size())
                spelled.append(bytes([value]))
            else:
                spelled.append(text.replace("▁", " ").encode())
                at = 0
                for b in spelled[k]:
                    if (at, b) not in nodes:
                        nodes[at, b] = len(parent) + 1
                        parent.append(at)
                        letter.append(b)
                    at = nodes[at, b]
                piece_at[at] = k
        ends = np.full(len(parent) + 1, -1, np.int32)
        ends[list(piece_at)] = list(piece_at.values())
        return cls(spelled, np.array(parent, np.int32), np.array(letter, np.uint8), ends, weight, byte_piece)

    def steps(self) -> np.ndarray:
        """Dense transitions: node * 256 + byte -> node, 0 for none."""
        kind = np.uint16 if len(self.parent) < 1 << 16 else np.int32  # the smaller table misses the cache less often
        dense = np.zeros((len(self.parent) + 1) * 256, kind)
        dense[self.parent.astype(np.int64) * 256 + self.letter] = np.arange(1, len(self.parent) + 1, dtype=kind)
        return dense


def _char_sizes() -> np.ndarray:
    lead = np.arange(256)
    return np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0], [1, 0, 2, 3], 4).astype(np.int64)


@dataclass(frozen=True)
class Lattice:
    """Incoming edges of every node of every distinct unit, with cumulative probabilities."""

    first: np.ndarray   # unit -> its first node
    last: np.ndarray    # unit -> its last node
    key: np.ndarray     # node + cumulative probability of its incoming edges
    piece: np.ndarray
    size: np.ndarray


def lattice(units: list[bytes], vocabulary: Vocabulary, steps: np.ndarray, char_size: np.ndarray) -> Lattice:
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.fromiter(map(len, units), np.int32, len(units))
    start = np.cumsum(sizes, dtype=np.int32) - sizes
    unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    stop = np.repeat(start + sizes, sizes)
    # edges: walk the trie from every byte at once
    at, node, found = np.arange(len(data), dtype=np.int32), np.zeros(len(data), np.int32), []
    depth = 0
    while len(at):
        inside = at + depth < stop[at]
        at, node = at[inside], node[inside]
        node = steps[node * 256 + data[at + depth]].astype(np.int32)
        at, node = at[node > 0], node[node > 0]
        depth += 1
        piece = vocabulary.piece_at[node]
        ends = piece >= 0
        found.append((at[ends], np.full(int(ends.sum()), depth, np.int32), piece[ends]))
    begin, length, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32),) * 3
    del found, stop
    # bytes of characters that are no piece
    lone = np.zeros(len(data), bool)
    lone[begin[length == char_size[data[begin]]]] = True
    heads = np.maximum.accumulate(np.where(char_size[data] > 0, np.arange(len(data), dtype=np.int32), 0)) if len(data) else begin
    bare = np.flatnonzero(~lone[heads]).astype(np.int32)
    begin = np.r_[begin, bare]
    length = np.r_[length, np.ones(len(bare), np.int32)]
    piece = np.r_[piece, vocabulary.byte_piece[data[bare]]]
    # forward filtering, by the distance of an edge's end from the start of its unit
    own = unit[begin]
    far = begin + length - start[own]
    target = begin + own + length
    del begin, own, heads, lone
    order = np.argsort((far.astype(np.int64) << 40) | (target.astype(np.int64) << 8) | length).astype(np.int32)  # one order, whatever the batch
    far, target, length, piece = far[order], target[order], length[order], piece[order]
    bounds = np.searchsorted(far, np.arange(1, (int(far[-1]) if len(far) else 0) + 2))
    del far
    total = np.full(len(data) + len(units), -np.inf)
    first = start + np.arange(len(units), dtype=np.int32)
    total[first] = 0.0
    share = np.zeros(len(target))
    for low, high in zip(bounds[:-1], bounds[1:]):
        if low == high:
            continue
        into = target[low:high]
        value = total[into - length[low:high]] + vocabulary.weight[piece[low:high]]
        heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
        counts = np.diff(np.r_[heads, len(into)])
        top = np.maximum.reduceat(value, heads)
        value = np.exp(value - np.repeat(top, counts))
        sums = np.add.reduceat(value, heads)
        total[into[heads]] = top + np.log(sums)
        share[low:high] = value / np.repeat(sums, counts)
    order = np.argsort((target.astype(np.int64) << 8) | length).astype(np.int32)
    target, share = target[order], share[order]
    heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else target
    counts = np.diff(np.r_[heads, len(target)])
    run = np.cumsum(share)
    del share
    run -= np.repeat(run[heads] - np.diff(np.r_[0.0, run])[heads], counts) if len(heads) else 0
    key = target + np.minimum(run, 1.0)
    if len(heads):
        key[heads + counts - 1] = target[heads] + 1.0
    return Lattice(first, first + sizes, key, piece[order], length[order])


def sample(grid: Lattice, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw a segmentation for every occurrence: (pieces in order, pieces per occurrence). `unit` is sorted, so that
    neighbouring lookups fall on neighbouring edges."""
    node, first = grid.last[unit].copy(), grid.first[unit]
    alive = np.flatnonzero(node > first)
    count = np.zeros(len(unit), np.int64)
    taken, step = [], 0
    while len(alive):
        bits = mix64(seed[alive] + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(34)
        edge = np.searchsorted(grid.key, node[alive] + bits * 2.0 ** -30, side="right")
        taken.append((alive, grid.piece[edge]))
        count[alive] += 1
        node[alive] -= grid.size[edge]
        alive = alive[node[alive] > first[alive]]
        step += 1
    end = np.cumsum(count)
    pieces = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
    for step, (who, piece) in enumerate(taken):
        pieces[end[who] - 1 - step] = piece
    return pieces, count


def encode_batch(keys: list, texts: list[bytes], vocabulary: Vocabulary, steps: np.ndarray, char_size: np.ndarray, seed: int) -> list[np.ndarray]:
    import re

    import xxhash

    cut, names, occurrences, per_text, seeds = re.compile(BOUNDARY).findall, {}, [], [], []
    for key, text in zip(keys, texts):
        units = cut(b" " + text) if text else []
        occurrences.append(np.fromiter((names.setdefault(u, len(names)) for u in units), np.int64, len(units)))
        per_text.append(len(units))
        own = xxhash.xxh3_64_intdigest(repr(key).encode(), seed)
        seeds.append(mix64(np.uint64(own) ^ (np.arange(len(units), dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))))
    unit, seeds = np.concatenate(occurrences), np.concatenate(seeds)
    order = np.argsort(unit, kind="stable")
    pieces, count = sample(lattice(list(names), vocabulary, steps, char_size), unit[order], seeds[order])
    # from the order by unit back to the order of the texts
    counts = np.zeros(len(unit), np.int64)
    counts[order] = count
    begin = np.zeros(len(unit), np.int64)
    begin[order] = np.cumsum(count) - count
    ends = np.cumsum(counts)
    flat = pieces[np.repeat(begin - (ends - counts), counts) + np.arange(len(pieces))]
    cuts = np.r_[0, ends][np.cumsum([0, *per_text])]
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def decode_ids(ids, spelled: list[bytes]) -> bytes:
    """The text of a list of ids; the space in front, which encoding adds, goes."""
    return b"".join(map(spelled.__getitem__, ids))[1:]


def encode(df: DataFrame, model_file: str, key_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 17) -> DataFrame:
    """`df` with piece_ids array<int>, n_pieces int, decoded_sha256 (of the decoded pieces) and lossless boolean; columns
    of these names are replaced."""
    vocabulary = Vocabulary.load(model_file, alpha)
    made = [("piece_ids", "array<int>", pa.list_(pa.int32())), ("n_pieces", "int", pa.int32()), ("decoded_sha256", "string", pa.string()), ("lossless", "boolean", pa.bool_())]
    kept = df.drop(*[m[0] for m in made])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} {t}" for n, t, _ in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, char_size = vocabulary.steps(), _char_sizes()
        for batch in batches_by_bytes(batches, text_col, BATCH):
            texts = texts_of(batch.column(text_col).cast(pa.string()))
            ids = encode_batch(batch.column(key_col).to_pylist(), [t or b"" for t in texts], vocabulary, steps, char_size, seed)
            back = [decode_ids(own.tolist(), vocabulary.spelled) for own in ids]
            none = np.array([t is None for t in texts], bool)
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32(), mask=np.r_[none, False]) if none.any() else pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            columns = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))),
                pa.array([None if t is None else len(i) for t, i in zip(texts, ids)], pa.int32()),
                pa.array([None if t is None else sha256(b) for t, b in zip(texts, back)], pa.string()),
                pa.array([None if t is None else t == b for t, b in zip(texts, back)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[m[0] for m in made]])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """`df` with the text of its piece ids (null for null)."""
    vocabulary = Vocabulary.load(model_file)
    kept = df.drop(into)
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if ids is None else decode_ids(ids, vocabulary.spelled) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()).cast(pa.string())], [*batch.schema.names, into])

    return kept.mapInArrow(run, schema)
