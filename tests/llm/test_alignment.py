"""Alignment against whole-text encoding and plain counting."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casegraph.llm import alignment
from casegraph.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Pair.load(A, B).aligner()


def whole(aligner, text):
    """Tokens of the whole text, with ends and groups by sets; None without tokens."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    if b"".join(aligner.a_bytes[x] for x in a) != b" " + text.encode() or b"".join(aligner.b_bytes[x] for x in b) != b" " + text.encode():
        return None
    ends_a, ends_b = np.cumsum([len(aligner.a_bytes[x]) for x in a]), np.cumsum([len(aligner.b_bytes[x]) for x in b])
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups, low = [], 0
    for end in common:
        groups.append(",".join(str(x) for x, e in zip(a, ends_a) if low < e <= end) + "|" + ",".join(str(x) for x, e in zip(b, ends_b) if low < e <= end))
        low = end
    links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
    return len(a), len(b), ";".join(groups), links


def brute(aligner, texts):
    found = [whole(aligner, t) for t in texts]
    count = Counter(link for f in found if f for link in f[3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((f[0], f[1], f[2].count(";") + 1, len(f[3]), sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(f[2].encode()).hexdigest()))
    return out, count, top


TEXTS = [None, "", " ", "  ", "a", "The cat sat on the mat.", " two  spaces \n and\tends ", "line\nline\n\n  indented\r\n", "▁ is a space", "<|endoftext|> <s></s> <0x0A>",
         "don't we'll I'M 've", "naïve Ångström ﬁne é 東京タワー 🙂🙂 x", "\x00\x1c\x1f \x85\xa0　z", "a" * 3000, "x y " * 500, "The cat sat on the mat.", " .!? 12 345 6"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sa1.▁\x1c　ȩ́")), st.characters(codec="utf-8")), min_size=1))
def test_units_change_nothing(aligner, text):
    units = alignment.units_of(text)
    assert " ".join(["", *units]) == " " + text
    block = aligner.block([text.encode()])
    expected = whole(aligner, text)
    assert block.groups == [expected and expected[2]]
    assert block.counts[:, 0].tolist() == ([expected[0], expected[1], len(expected[3])] if expected else [0, 0, 0])


@pytest.mark.parametrize("block_bytes,fan_in", [(alignment.BLOCK, 64), (200, 2), (1, 3)])
def test_counts_equal_brute_force(spark, aligner, block_bytes, fan_in):
    """One run, and many runs through several passes of the merge."""
    docs = spark.createDataFrame([(None if k == 3 else k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_a string").repartition(3)
    expected, count, top = brute(aligner, TEXTS)
    got = alignment.align(docs, A, B, with_groups=True, block_bytes=block_bytes, fan_in=fan_in, parts=5).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == {None if k == 3 else k: e for k, e in enumerate(expected)}
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)
    pairs = alignment.pair_counts(docs, A, B, block_bytes=block_bytes, fan_in=fan_in, parts=5).collect()
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in pairs} == {k: (n, n == top[k[1]]) for k, n in count.items()} and len(pairs) == len(count)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_frames_and_merge(monkeypatch):
    """Frames of two records, so that groups of a B id and of a key span frames."""
    monkeypatch.setattr(alignment, "FRAME", 2)
    rng, runs, total = np.random.default_rng(1), [], Counter()
    for _ in range(7):
        own = Counter(rng.integers(0, 60, rng.integers(0, 40)).tolist())
        total.update(own)
        keys = np.array(sorted(own), np.int64)
        runs.append(alignment.frames_of(keys, np.array([own[k] for k in keys.tolist()], np.int64)))
    merged = list(alignment.heap_merge(runs))
    assert dict(zip(np.concatenate([k for k, _ in merged]).tolist(), np.concatenate([c for _, c in merged]).tolist())) == total
    marked = list(alignment.with_maxima(iter(merged), 10))
    flat = [tuple(r) for block in marked for r in zip(*(c.tolist() for c in block))]
    assert flat == [(k, total[k], int(total[k] == max(total[j] for j in total if j // 10 == k // 10))) for k in sorted(total)]
    for run, back in zip(runs, alignment.handed_down(marked, runs)):
        assert [tuple(r) for f in back for r in zip(*(c.tolist() for c in alignment.unpack(f)))] == [x for f in run for x in flat if x[0] in alignment.unpack(f)[0]]


def test_query_equals_brute_force(spark, aligner):
    from casegraph.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected, _, _ = brute_fast(aligner, [r.text for r in rows])
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: e for r, e in zip(rows, expected)}


def brute_fast(aligner, texts):
    """As `brute`, with dictionaries for the ends (long texts)."""
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
        at_a = dict(zip(np.cumsum([len(aligner.a_bytes[x]) for x in a]).tolist(), range(1, len(a) + 1)))
        at_b = dict(zip(np.cumsum([len(aligner.b_bytes[x]) for x in b]).tolist(), range(1, len(b) + 1)))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            groups.append(",".join(map(str, a[i: at_a[end]])) + "|" + ",".join(map(str, b[j: at_b[end]])))
            i, j = at_a[end], at_b[end]
            links.append((a[i - 1], b[j - 1]))
        found.append((len(a), len(b), ";".join(groups), links))
    count = Counter(link for f in found if f for link in f[3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(f[0], f[1], len(f[3]), len(f[3]), sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(f[2].encode()).hexdigest()) if f else (0,) * 6 + ("",) for f in found], count, top
