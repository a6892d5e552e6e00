import random

import numpy as np
import pytest

from casegraph.llm import components as cc
from casegraph.llm import near_dedup as nd


def brute(rows, width, percent):
    sets = {}
    for doc, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets[doc] = {tuple(w[k: k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = [d for d in sets if d is not None]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((d, len(sets[d]), find(d), d is None or find(d) == d) for d, _ in rows), key=str)


def family(rng, base, n, most):
    """Copies with up to `most` words changed, in chains."""
    out = [base]
    while len(out) < n:
        words = list(rng.choice(out))
        for _ in range(rng.randrange(most + 1)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(10_000)
        out.append(words)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, width, percent):
    rng = random.Random(width)
    rows, k = [], 0
    for size, most in ((120, 3), (60, 4), (200, 9), (12, 1), (8, 1)):
        for text in family(rng, ["w%d" % rng.randrange(5000) for _ in range(size)], 25, most):
            rows.append((k, text))
            k += 1
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:30])] + [(5, rows[5][1])]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "one two"), (None, "one two"), (2007, "z " * 50_000), (2008, "z " * 9)]
    rng.shuffle(rows)
    got = nd.groups(docs(rows), width=width, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width, percent)


def test_star_family_whose_links_all_pass_the_centre(docs):
    """Copies linked to the base only: the centre must be the base, whatever its id."""
    rng = random.Random(2)
    base = ["w%d" % k for k in range(150)]
    rows = [(500, " ".join(base))]
    for k in range(40):
        words = list(base)
        words[3 * k + 5] = words[(3 * k + 70) % 150] = f"y{k}"
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    assert sorted((tuple(r) for r in nd.groups(docs(rows), width=3, percent=90).collect()), key=str) == brute(rows, 3, 90)


def test_empty(docs):
    assert nd.groups(docs([])).count() == 0


def test_densified_bins_agree_at_the_rate_of_similarity():
    rng = np.random.default_rng(1)
    for n in (10, 60, 900):
        same = []
        for _ in range(200):
            common, one, two = (rng.integers(0, 2**63, m, dtype=np.uint64) for m in (n, n // 10, n // 10))
            a, b = (nd.densified(np.unique(np.r_[common, x]), 160) for x in (one, two))
            same.append((a == b).mean())
        assert abs(np.mean(same) - n / (n + 2 * (n // 10))) < 0.03


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(300, 330)] + [(900, 901), (901, 902), (902, 900), (5, 5)]
    got = dict(map(tuple, cc.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(100, 141)} == {100}
    assert {got[k] for k in [7, *range(300, 330)]} == {7}
    assert {got[k] for k in (900, 901, 902)} == {900} and 5 not in got
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
