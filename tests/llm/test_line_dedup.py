import hashlib
from collections import defaultdict

import numpy as np
import pytest

from casegraph.llm import line_dedup as ld

A, B, C = "this line is common to many", "another line that is shared", "only one text has this line"
ROWS = [
    (1, f"{A}\n{C}\n  {A.upper()}  "), (2, f"x\n{A}"), (3, f"{A}\r\n{B}"), (4, B), (5, f"{B}\n{B}"), (5, f"{B}\n{B}"),
    (6, None), (7, ""), (None, f"{A}\n{B}"), (8, "short\nshort"), (9, "short"), (10, "short"),
    (11, "é" * 19), (12, "é" * 19), (13, "é" * 19), (14, "é" * 20), (15, "é" * 20), (16, "É" * 20), (17, "é" * 20), (18, ("w " * 60_000) + "\n" + A),
]


def brute(rows):
    held = defaultdict(set)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < 3 or max(held[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(index, frame):
    return sorted((tuple(r) for r in ld.clean(index, frame).collect()), key=str)


def test_equals_brute_force(docs):
    frame = docs(ROWS)
    assert result(ld.build(frame), frame) == brute(ROWS)


def test_cleaned_keeps_columns_and_null(docs):
    frame = docs(ROWS)
    out = ld.cleaned(ld.build(frame), frame)
    assert out.columns == frame.columns and out.count() == len(ROWS)
    assert {r.text for r in out.filter("doc_id = 6").collect()} == {None}
    assert {r.text for r in out.filter("doc_id = 2").collect()} == {"x"}


def test_insert_and_delete_are_reversible(docs):
    base, more = [r for r in ROWS if r[0] in (1, 2, 4, 5, 11, 14)], [(30, A), (31, f"{A}\n{B}"), (32, B)]
    frame, added = docs(base), docs(more)
    index = ld.build(frame)
    grown = ld.insert(index, added)
    both = frame.unionByName(added)
    assert result(grown, both) == brute(base + more)
    again = ld.insert(grown, added)
    assert result(again, both) == brute(base + more)
    back = ld.delete(grown, added)
    assert result(back, frame) == brute(base) == result(index, frame)
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))


def test_small_constants_probe_the_filters(docs, monkeypatch):
    """No key is hot and shards hold three keys: answers come from the filters, through growth, overflow and deletion."""
    import random

    monkeypatch.setattr(ld, "HOT_SHARE", 1)
    monkeypatch.setattr(ld, "KEYS_PER_SHARD", 3)
    rng = random.Random(2)
    line = lambda k: f"line number {k} of the common pool"
    text = lambda pool: "\n".join(line(rng.randrange(pool)) for _ in range(6))
    base, more = [(k, text(5)) for k in range(20)], [(k, text(200)) for k in range(100, 260)]
    frame, added = docs(base), docs(more)
    index = ld.build(frame)
    assert ld.drops(index, index.refs).count() > 0 and index.counts.filter(f"n_docs >= {index.hot_above}").count() == 0
    grown = ld.insert(index, added)
    both = frame.unionByName(added)
    assert grown.shards > 10 * index.shards and grown.hot_above > index.hot_above
    assert result(grown, both) == brute(base + more)
    fewer = ld.delete(grown, docs(more[:80]))
    assert result(fewer, docs(base + more[80:])) == brute(base + more[80:])
    back = ld.delete(fewer, docs(more[80:]))
    assert back.hot_above == index.hot_above and result(back, frame) == brute(base)
    one = ld.insert(back, docs(more[:1]))
    assert one.shards == back.shards and result(one, docs(base + more[:1])) == brute(base + more[:1])


def test_empty(docs):
    frame = docs([])
    assert ld.clean(ld.build(frame), frame).count() == 0


@pytest.mark.parametrize("keys", [1, 50, 5000])
def test_cuckoo_filter(keys):
    rng = np.random.default_rng(keys)
    k1, k2 = (rng.integers(-2**63, 2**63 - 1, keys) for _ in range(2))
    made = ld.CuckooFilter.sized(keys)
    made.insert(k1, k2)
    assert made.holds(k1, k2).all()
    made = ld.CuckooFilter.from_bytes(made.to_bytes())
    half = keys // 2
    made.delete(k1[:half], k2[:half])
    assert made.holds(k1[half:], k2[half:]).all()
    other = rng.integers(-2**63, 2**63 - 1, (2, 20_000))
    assert made.holds(other[0], other[1]).mean() < 0.01
    made.delete(k1[half:], k2[half:])
    assert not made.table.any() and not made.stash


def test_full_filter_keeps_keys_in_its_stash():
    made = ld.CuckooFilter(1)
    k = np.arange(40, dtype=np.int64)
    made.insert(k << 20, k + 1)
    assert made.stash and made.holds(k << 20, k + 1).all()
    made = ld.CuckooFilter.from_bytes(made.to_bytes())
    made.delete(k << 20, k + 1)
    assert not made.stash and not made.table.any()
