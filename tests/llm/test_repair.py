"""Repair against shortest paths over whole strings, and against all edit sequences."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from casegraph.llm import repair
from casegraph.llm.queries import QUERIES

TARGET = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def facts(rows):
    """(must go, truncated) and counts, of (role, text) in order."""
    seen, out, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        blank, again = not bare, (role, text) in seen
        late = not blank and not again and bare[-1] not in ".!?"
        seen.add((role, text))
        counts = [counts[0] + blank, counts[1] + (again and not blank), counts[2] + late]
        out.append((blank or again, late))
    return out, counts


def best(rows):
    """(cost, audit, lines) by memoized minimum over (cost, audit) from the end."""
    known, _ = facts(rows)
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    fits = {"0": "user", "s": "user", "u": "assistant", "a": "user"}

    @functools.cache
    def rest(k, state, inserted):
        options = [(0, "", ())] if k == len(rows) and state in "0a" else [(10 ** 9, "", ())]
        if k < len(rows):
            (role, text), (gone, late) = rows[k], known[k]
            options.append(plus(3, "D", (), rest(k + 1, state, 0)))
            if not gone:
                if (state, role[:1]) in step:
                    options.append(plus(late, "K", (f"{role}:{text}",), rest(k + 1, step[state, role[:1]], 0)))
                options.append(plus(2 + late, "R", (f"{fits[state]}:{text}",), rest(k + 1, fits[state][0], 0)))
        if inserted < 3:
            options.append(plus(2, "I", (f"{fits[state]}:",), rest(k, fits[state][0], inserted + 1)))
        return min(options)

    def plus(cost, letter, line, tail):
        return cost + tail[0], letter + tail[1], line + tail[2]

    # from the back, so that the recursion stays shallow
    for k in range(len(rows), -1, -1):
        for state in "0sua":
            rest(k, state, 0)
    return rest(0, "0", 0)


def expected(rows):
    """Contract values of (turn, role, text) rows in order."""
    pairs = [(r, t) for _, r, t in rows]
    _, counts = facts(pairs)
    cost, audit, lines = best(pairs)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
    return (gaps, *counts, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_all_edit_sequences():
    """Every sequence of edits with up to two insertions in each gap."""
    rng, gaps = random.Random(3), ["", "u", "a", "ua", "au"]
    for _ in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a.", "b", "", "c!"])) for _ in range(rng.randint(0, 3))]
        known, _ = facts(rows)
        found = set()
        for kept in itertools.product(*[["D"] if gone else ["D", "K", "Ru", "Ra"] for gone, _ in known]):
            for inserts in itertools.product(gaps, repeat=len(rows) + 1):
                said = inserts[0] + "".join((rows[k][0][0] if e == "K" else e[1:] if e[0] == "R" else "") + inserts[k + 1] for k, e in enumerate(kept))
                if TARGET.fullmatch(said):
                    cost = 2 * sum(map(len, inserts)) + sum({"D": 3, "K": 0, "R": 2}[e[0]] + (known[k][1] if e != "D" else 0) for k, e in enumerate(kept))
                    found.add((cost, "I" * len(inserts[0]) + "".join(e[0] + "I" * len(inserts[k + 1]) for k, e in enumerate(kept))))
        assert min(found) == best(rows)[:2]


def coded(rows):
    """A chunk's codes."""
    known, _ = facts(rows)
    out = ""
    for (role, text), (gone, late) in zip(rows, known):
        fault = (repair.BLANK if BLANK.fullmatch(text) else repair.DUPLICATE) if gone else repair.TRUNCATED if late else repair.OK
        out += chr(97 + 4 * "sua".find(role[:1]) % 16 + fault if role[:1] in ("s", "u", "a") else 97 + 12 + fault)
    return out


def made(rng, n):
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "", "x"]), rng.choice(["a.", "b", "", "  \n", f"c{rng.random()}!", f"{rng.random()}"])) for _ in range(n)]


def test_paths_equal_brute_force():
    rng = random.Random(1)
    cases = [made(rng, rng.choice([0, 1, 2, 3, 5, 8, 13, 40])) for _ in range(400)]
    chunks = repair.Chunks([coded(c) for c in cases])
    cost = chunks.costs(np.array([repair.END] * len(cases)))
    paths = chunks.paths(cost, np.ones(len(cases), bool))
    audits = paths.audits(np.zeros(len(cases), np.int64))
    for k, rows in enumerate(cases):
        want = best(rows)
        assert (int(cost[chunks.node[k], 0]), audits[k]) == want[:2]
        assert tuple(repair.edited(audits[k], 0, [r for r, _ in rows], [t for _, t in rows], coded(rows))) == want[2]
    ranks = paths.rank[chunks.node * 4]
    order = np.argsort(ranks, kind="stable")
    assert [audits[k] for k in order] == sorted(audits)  # ranks order whole audits


@pytest.mark.parametrize("chunk_rows", [1, 3, 256])
def test_repair_across_chunks(spark, chunk_rows):
    """Conversations of one and of many chunks, with null ids, turns, roles and texts, repeated rows and clashing columns."""
    rng, rows = random.Random(chunk_rows), []
    for conv in [None, *range(12)]:
        for k in range(rng.choice([1, 2, 3, 7, 20, 61])):
            (role, text), = made(rng, 1)
            turn = rng.choice([None, k, k, 2 * k])
            rows.append((conv, turn, rng.choice([role, role, role, None]), rng.choice([text] * 5 + [None]), "x"))
            rows += rows[-1:] if rng.random() < 0.1 else []
    rows += [(99, 0, "user", "  ", "x"), (98, None, "user", "a.", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(messages, chunk_rows=chunk_rows).collect()}
    held = {}
    for conv, turn, role, text, _ in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: expected(in_order(own)) for conv, own in held.items()}
    parts = {}
    for r in sorted(repair.repaired_text(messages, chunk_rows=chunk_rows).collect(), key=lambda r: r.chunk):
        parts.setdefault(r.conv_id, []).append(r.repaired)
    assert {c: hashlib.sha256("\n".join(filter(None, p)).encode()).hexdigest() for c, p in parts.items()} == {c: v[-1] for c, v in got.items()}


def test_nothing_left(spark):
    from pyspark.sql import functions as F

    messages = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in repair.repair(messages, live=F.lit(False)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", none)]
    assert repair.repair(messages.limit(0)).collect() == []


def test_query_equals_brute_force(spark):
    held = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect():
        hit = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        own = held.setdefault(r.conv_id, [])
        text = "" if hit == 1 else re.sub("[.!?]", "", r.text) if hit == 2 else r.text
        own += [(r.turn, "user" if hit == 4 else r.role, text)] * (hit != 0) * (1 + (hit == 3))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {conv: expected(in_order(own)) for conv, own in held.items()}
