"""Conversation structure repair by cheapest edits, with prefix-doubling path ranking.

A conversation shall read `(s?(ua)+)?` by the initials of its roles. Its messages are kept (0), given the role that fits
(2) or deleted (3; the only way with a blank or repeated message), and empty messages of the role that fits may be
inserted anywhere (2); a truncated message that stays costs 1 more. Nodes are (message, state of the grammar). A cost DP
from the end gives each node the cost of what remains, and the arcs that attain it are the optimal ones: from a node at
most one for each letter of D, I, K, R, as the state decides which role an edit gives. Every node takes its least letter;
ranks of audits of length 1, 2, 4, ... follow by ranking pairs (own rank, rank at the pointer) and doubling the pointers,
until all pointers are at an end. Then equal ranks are equal audits: the least audit of one node for each rank is read off
by the doubled pointers and shared by all.

Conversations are cut into chunks of `chunk_rows` messages, however long they are. A chunk's DP is a 4 x 4 matrix over
(min, +), so what a later chunk costs reaches an earlier one by matrix products over doubled distances, and the state in
which a chunk is entered comes forward by composing the chunks' state maps the same way: a conversation that owns a third
of all rows is spread over many tasks. Only the digest of the repaired text reads a conversation in one go, as SHA-256
must; it streams one row per chunk.

Faults: the first that holds counts. Blank: nothing but ASCII white space. Duplicate: role and text seen earlier in the
conversation. Truncated: the last character that is not white space is none of `.!?`.

Cases: nulls in role or text are one space (blank text, a role that must change); rows with a null turn come first; rows
of one turn are ordered by role and text; a null conversation id is one conversation; a conversation without live rows,
or whose rows are all deleted, has an empty audit or one of D only and the digest of the empty text; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.ordered import ranked
from casegraph.llm.common import cut
from casegraph.session import scratch_path

CHUNK = 256
SPACE = " \t\n\x0b\x0c\r"
INFINITE = 1 << 60
FILL = np.array([2, 2, 3, 2])         # state -> state after the role that fits; states: start, after s, after u, after a
FITS = ("user", "user", "assistant", "user")
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])   # initial s, u, a, other -> state after it
END = (0, INFINITE, INFINITE, 0)
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
OK, TRUNCATED, BLANK, DUPLICATE = range(4)


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs by state after any insertions."""
    start, system, user, assistant = cost.T
    user, assistant = np.minimum(user, assistant + 2), np.minimum(assistant, user + 2)
    return np.minimum(np.stack([np.minimum(start, user + 2), np.minimum(system, user + 2), user, assistant], axis=1), INFINITE)


@dataclass
class Chunks:
    """Messages of many chunks in a row; a code is 4 * (initial s, u, a, other) + fault, as a letter from `a`."""

    codes: list[str]

    def __post_init__(self):
        flat = np.frombuffer("".join(self.codes).encode(), np.uint8).astype(np.int64) - 97
        self.initial, self.fault = flat >> 2, flat & 3
        self.size = np.fromiter(map(len, self.codes), np.int64, len(self.codes))
        self.row = np.cumsum(self.size) - self.size
        self.node = self.row + np.arange(len(self.codes))        # a chunk has a node more than messages
        self.late = (self.fault == TRUNCATED).astype(np.int64)
        self.stays = self.fault < BLANK

    def costs(self, ends: np.ndarray) -> np.ndarray:
        """Remaining cost by node and state, given the cost by state behind each chunk."""
        cost = np.zeros((len(self.fault) + len(self.size), 4), np.int64)
        cost[self.node + self.size] = closed(ends)
        order = np.argsort(-self.size, kind="stable")
        longest = int(self.size.max(initial=0))
        running = np.searchsorted(-self.size[order], -np.arange(longest), side="left")
        for step, n in enumerate(running.tolist()):
            back = self.size[order[:n]] - 1 - step
            row, node = self.row[order[:n]] + back, self.node[order[:n]] + back
            cost[node] = closed(np.minimum.reduce(list(self.ways(row, cost[node + 1]))))
        return cost

    def ways(self, row: np.ndarray, after: np.ndarray) -> Iterator[np.ndarray]:
        """Cost by state of deleting, keeping and giving another role to messages, given the costs after them."""
        target, stays, late = KEEP[self.initial[row]], self.stays[row][:, None], self.late[row][:, None]
        yield after + 3
        yield np.where(stays & (target >= 0), np.take_along_axis(after, np.maximum(target, 0), axis=1) + late, INFINITE)
        yield np.where(stays, after[:, FILL] + late + 2, INFINITE)

    def paths(self, cost: np.ndarray, last: np.ndarray) -> Paths:
        """The least optimal arc of every node, ranked by doubling. `last`: chunks that end their conversation."""
        at_end = np.zeros(len(cost), bool)
        at_end[self.node + self.size] = True
        inner, flat = np.flatnonzero(~at_end), np.arange(len(cost) * 4).reshape(-1, 4)
        row = np.arange(len(inner))                       # inner nodes follow the messages one to one
        after, state = cost[inner + 1], np.arange(4)
        delete, keep, rerole = self.ways(row, after)
        insert = cost[:, FILL] + 2
        own = cost[inner]
        letter, pointer = np.zeros((len(cost), 4), np.int64), flat.copy()
        tight = [own == delete, own == insert[inner], (own == keep) & (keep < INFINITE), (own == rerole) & (rerole < INFINITE)]
        letter[inner] = np.select(tight, [1, 2, 3, 4])
        step = (inner[:, None] + 1) * 4
        pointer[inner] = np.select(tight, [step + state, inner[:, None] * 4 + FILL, step + KEEP[self.initial], step + FILL])
        final = self.node[last] + self.size[last]
        letter[final] = np.where(cost[final] > 0, 2, 0)   # behind the last message, only insertions remain
        pointer[final] = np.where(cost[final] > 0, final[:, None] * 4 + FILL, flat[final])
        return Paths(self, letter.ravel(), pointer.ravel())


class Paths:
    def __init__(self, chunks: Chunks, letter: np.ndarray, pointer: np.ndarray):
        self.chunks, self.letter, self.pointers = chunks, letter, [pointer]
        self.rank, self.length = letter, (letter > 0).astype(np.int64)
        while (letter[pointer] > 0).any():
            pairs = self.rank * (int(self.rank.max()) + 1) + self.rank[pointer]
            self.rank = np.unique(pairs, return_inverse=True)[1].reshape(-1)
            self.length = self.length + self.length[pointer]
            pointer = pointer[pointer]
            self.pointers.append(pointer)

    def exits(self) -> np.ndarray:
        """The state in which a chunk is left, by the state in which it is entered."""
        entry = self.chunks.node[:, None] * 4 + np.arange(4)
        return self.pointers[-1][entry] - (self.chunks.node + self.chunks.size)[:, None] * 4

    def audits(self, entry: np.ndarray) -> list[str]:
        """The audit of each chunk, entered in a state; read off once for each rank."""
        node = self.chunks.node * 4 + entry
        _, one, which = np.unique(self.rank[node], return_index=True, return_inverse=True)
        start, size = node[one], self.length[node[one]]
        at = np.repeat(start, size)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        for k, pointer in enumerate(self.pointers):
            at = np.where(offset >> k & 1, pointer[at], at)
        text, ends = LETTERS[self.letter[at]].tobytes().decode(), np.cumsum(size).tolist()
        shared = [text[a:b] for a, b in zip([0, *ends], ends)]
        return [shared[k] for k in which.reshape(-1).tolist()]


def edited(audit: str, state: int, roles: list[str], texts: list[str], codes: str) -> list[str]:
    """The lines `role:text` that an audit leaves of a chunk entered in `state`."""
    lines, k = [], 0
    for letter in audit:
        if letter == "D":
            k += 1
        elif letter == "K":
            lines.append(f"{roles[k]}:{texts[k]}")
            state = int(KEEP[(ord(codes[k]) - 97) >> 2][state])
            k += 1
        else:
            lines.append(f"{FITS[state]}:{texts[k] if letter == 'R' else ''}")
            state = int(FILL[state])
            k += letter == "R"
    return lines


def illegal(initials: np.ndarray) -> int:
    """Neighbours that are not su, ua or au."""
    a, b = initials[:-1], initials[1:]
    return int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())


# Spark jobs

def conversation_key(conv_id: str) -> Column:
    return F.coalesce(F.col(conv_id).cast("long").cast("string"), F.lit(" ")).alias("conv")


def numbered(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, live: Column) -> DataFrame:
    """Live messages with their place (from 0) in their conversation and their own code, written as a table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = messages.filter(live).select(conversation_key(conv_col), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    path = scratch_path(messages.sparkSession, "repair-rows")
    ranked(rows, ["conv"], order, "place").select(
        "conv", "turn", "role", "text", (F.col("place").cast("long") - 1).alias("place"), (initial * 4 + fault).alias("code"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("mark"),
    ).write.parquet(path)
    return messages.sparkSession.read.parquet(path)


def chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(conv, chunk, n_chunks, codes, roles, texts), written as a table; a repeated message gets its fault here."""
    chunk = F.floor(F.col("place") / chunk_rows).alias("chunk")
    marks = rows.select("conv", "mark", "place", chunk)
    firsts = marks.groupBy("conv", "mark").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeats = marks.join(firsts, ["conv", "mark"]).filter("place > first").groupBy("conv", "chunk").agg(F.collect_list("place").alias("repeats"))
    sizes = rows.groupBy("conv").agg((F.floor(F.max("place") / chunk_rows) + 1).alias("n_chunks"))
    grouped = rows.groupBy("conv", chunk).agg(F.sort_array(F.collect_list(F.struct("place", "code", "role", "text"))).alias("messages"))

    def letter(m: Column) -> Column:
        again = F.array_contains(F.coalesce("repeats", F.array().cast("array<long>")), m["place"])
        fault = F.when(m["code"] % 4 == BLANK, BLANK).when(again, DUPLICATE).otherwise(m["code"] % 4)
        return F.chr(97 + m["code"] - m["code"] % 4 + fault)

    path = scratch_path(rows.sparkSession, "repair-chunks")
    grouped.join(repeats, ["conv", "chunk"], "left").join(sizes, "conv").select(
        "conv", "chunk", "n_chunks", F.array_join(F.transform("messages", letter), "").alias("codes"),
        F.col("messages.role").alias("roles"), F.col("messages.text").alias("texts"),
    ).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, codes) -> m: cost of crossing a chunk, by state before and after it."""
    for batch in batches:
        chunks = Chunks(batch.column("codes").to_pylist())
        columns = []
        for state in range(4):
            end = np.full((len(chunks.size), 4), INFINITE)
            end[:, state] = 0
            columns.append(chunks.costs(end)[chunks.node])
        m = np.stack(columns, axis=2).reshape(len(chunks.size), 16)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(m.tolist(), pa.list_(pa.int64()))], ["conv", "chunk", "m"])


def state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, codes, ends, last) -> f: state behind a chunk, by the state before it."""
    for batch in batches:
        chunks, ends, last = Chunks(batch.column("codes").to_pylist()), *borders(batch)
        f = chunks.paths(chunks.costs(ends), last).exits()
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(f.tolist(), pa.list_(pa.int64()))], ["conv", "chunk", "f"])


def borders(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    last = np.array(batch.column("last").to_pylist(), bool)
    return np.array([END if e is None else e for e in batch.column("ends").to_pylist()], np.int64).reshape(-1, 4), last


def product(m: Column, n: Column) -> Column:
    """Matrix product over (min, +) of rows of 16."""
    cell = lambda k: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.get(m, F.floor(k / 4) * 4 + j) + F.get(n, j * 4 + k % 4)))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.least(cell(k), F.lit(INFINITE)))


def doubled(chunks: DataFrame, value: str, rounds: int, direction: int, combine) -> DataFrame:
    """`value` of every chunk combined with that of all chunks behind it (direction 1) or before it (-1)."""
    for k in range(rounds):
        other = chunks.select("conv", (F.col("chunk") - direction * 2 ** k).alias("chunk"), F.col(value).alias("__other"))
        chunks = cut(chunks.join(other, ["conv", "chunk"], "left").withColumn(value, F.when(F.col("__other").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("__other")))).drop("__other"))
    return chunks


def linked(chunks: DataFrame) -> DataFrame:
    """Chunks with what their neighbours tell them: `ends` (costs behind), `entry` (state before) and the next code.
    Only conversations of more than one chunk are asked."""
    most = chunks.agg(F.max("n_chunks")).first()[0] or 1
    rounds = math.ceil(math.log2(most))
    codes = chunks.select("conv", "chunk", "n_chunks", "codes").filter("n_chunks > 1")
    rest = doubled(codes.select("conv", "chunk", "codes").mapInArrow(matrices, "conv string, chunk long, m array<long>"), "m", rounds, 1, product)
    state = F.sequence(F.lit(0), F.lit(3))
    final = F.array(*[F.lit(e).cast("long") for e in END])
    ends = rest.select("conv", (F.col("chunk") - 1).alias("chunk"), F.transform(state, lambda q: F.array_min(F.transform(state, lambda j: F.get("m", q * 4 + j) + F.get(final, j)))).alias("ends"))
    after = codes.select("conv", (F.col("chunk") - 1).alias("chunk"), F.substring("codes", 1, 1).alias("next_code"))
    known = cut(codes.join(ends, ["conv", "chunk"], "left").join(after, ["conv", "chunk"], "left").withColumn("last", F.col("chunk") == F.col("n_chunks") - 1))
    maps = known.select("conv", "chunk", "codes", "ends", "last").mapInArrow(state_maps, "conv string, chunk long, f array<long>")
    through = doubled(maps, "f", rounds, -1, lambda own, before: F.transform(before, lambda q: F.get(own, q)))
    entry = through.select("conv", (F.col("chunk") + 1).alias("chunk"), F.get("f", F.lit(0)).alias("entry"))
    return known.select("conv", "chunk", "ends", "next_code").join(entry, ["conv", "chunk"], "left")


PART_SCHEMA = "conv string, chunk long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def repaired_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, roles, texts = (batch.column(c).to_pylist() for c in ("codes", "roles", "texts"))
        entry = np.array([e or 0 for e in batch.column("entry").to_pylist()], np.int64)
        chunks, ends, last = Chunks(codes), *borders(batch)
        cost = chunks.costs(ends)
        audits = chunks.paths(cost, last).audits(entry)
        counts = [[int((own == fault).sum()) for fault in (BLANK, DUPLICATE, TRUNCATED)] for own in np.split(chunks.fault, chunks.row[1:])]
        follow = [[] if c is None else [(ord(c) - 97) >> 2] for c in batch.column("next_code").to_pylist()]
        turns = [illegal(np.r_[own, f].astype(np.int64)) for own, f in zip(np.split(chunks.initial, chunks.row[1:]), follow)]
        lines = ["\n".join(edited(a, int(e), *rest)) for a, e, *rest in zip(audits, entry, roles, texts, codes)]
        columns = [*zip(*counts), turns, cost[chunks.node, entry].tolist()]
        arrays = [batch.column("conv"), batch.column("chunk"), *(pa.array(c, pa.int64()) for c in columns), pa.array(audits, pa.string()), pa.array(lines, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, PART_SCHEMA.replace(" long", "").replace(" string", "").split(", "))


REPAIR_SCHEMA = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of (conversation, chunk) -> a row per conversation; the digest streams over its chunks."""
    names = REPAIR_SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
    conv = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["conv"] != conv:
                if conv is not None:
                    done.append((conv, *sums, cost, "".join(audits), digest.hexdigest()))
                conv, sums, cost, audits, digest, empty = row["conv"], [0] * 4, row["cost"], [], hashlib.sha256(), True
            sums = [a + row[c] for a, c in zip(sums, ("blank", "duplicate", "truncated", "illegal"))]
            audits.append(row["audit"])
            if row["repaired"]:
                digest.update((row["repaired"] if empty else "\n" + row["repaired"]).encode())
                empty = False
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((conv, *sums, cost, "".join(audits), digest.hexdigest()), kinds)], names)


def parts_of(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, faults, cost, audit, repaired): a chunk's part of its conversation's repair."""
    return (
        chunks.join(linked(chunks), ["conv", "chunk"], "left").withColumn("last", F.col("chunk") == F.col("n_chunks") - 1)
        .select("conv", "chunk", "codes", "roles", "texts", "ends", "entry", "next_code", "last").mapInArrow(repaired_parts, PART_SCHEMA))


def repair(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           live: Column | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """A row per conversation id: gaps in its turns, faults, illegal neighbours, the cost and audit of the cheapest repair
    (the ASCII-least of several) and the digest of the repaired lines. Rows that are not `live` only name their id."""
    rows = numbered(messages, conv_col, turn_col, role_col, text_col, F.lit(True) if live is None else live)
    made = parts_of(chunked(rows, chunk_rows)).repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(whole, REPAIR_SCHEMA)
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    every = messages.select(conversation_key(conv_col)).distinct()
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(gaps, "conv", "left").join(made, "conv", "left").select(
        F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired_text(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  chunk_rows: int = CHUNK) -> DataFrame:
    """The repair itself: (conv_id, chunk, audit, repaired), a chunk's edits and the lines they leave, in order of chunk."""
    rows = numbered(messages, conv_col, turn_col, role_col, text_col, F.lit(True))
    return parts_of(chunked(rows, chunk_rows)).select(F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id"), "chunk", "audit", "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of `conversations` with planted faults by crc32(`conv_id:turn`) % 20 (nulls: one space): 0 drops a row (it
    stays with `live` false), 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes its role user."""
    blank = F.lit(" ")
    hit = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), blank) for c in ("conv_id", "turn")]).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (hit != 0).alias("live"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
