import random

import pytest
import re

from casegraph.llm import decontaminate as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(rows, items):
    out = []
    grams = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            size = min(13, len(w))
            for k in range(len(w) - size + 1):
                grams.setdefault(tuple(w[k: k + size]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    for doc, text in rows:
        w = words(text)
        hit, ids = set(), set()
        for size in sizes if doc is not None else ():
            for k in range(len(w) - size + 1):
                if found := grams.get(tuple(w[k: k + size])):
                    hit.update(range(k, k + size))
                    ids |= found
        out.append((doc, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(3)
    vocabulary = ["w%d" % k for k in range(300)] + ["Das", "über", "ñ9"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice([1, 5, 12, 13, 14, 40, 90])) if k else ["rare"])) for k in range(30)]
    items += [(3, items[3][1]), (77, items[5][1]), (78, None), (79, "!!"), (None, "w1 w2"), (80, "a a a a a a a a a a a a a a a"), (81, "absentterm w1 w2")]
    rows = []
    for k in range(80):
        own = text(rng.randrange(120))
        _, item = rng.choice(items[:30])
        part = item.split()[rng.randrange(3):]
        rows.append((k, " ".join(own[:50]) + ", " + "-".join(part).upper() + "; " + " ".join(own[50:])))
    rows += [(200, None), (201, ""), (202, "..."), (203, "a " * 40), (204, items[12][1]), (204, items[12][1]), (None, items[12][1]), (205, "w1 " * 30_000 + items[20][1])]
    return rows, items


def test_equals_brute_force(spark, docs):
    rows, items = sample()
    got = dc.contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, items)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs([]), none).count() == 0
    assert [tuple(r) for r in dc.contamination(docs([(1, "a b")]), none).collect()] == [(1, 2, 0, [], False)]


def near_brute(rows, items, window=13, slack=2, missing=2):
    """Every window against every diagonal of every document."""
    out = {}
    for item, text in items:
        w = [x.decode() for x in dc.words_of((text or "").encode())]
        width = min(window, len(w))
        for start in range(len(w) - width + 1 if item is not None and w else 0):
            own = w[start: start + width]
            for doc, body in rows:
                words = [x.decode() for x in dc.words_of((body or "").encode())]
                if doc is None or not set(own) & set(words):
                    continue
                for low in range(-width - slack, len(words)):
                    there = sum(any(0 <= low + p + k < len(words) and words[low + p + k] == x for k in range(slack + 1)) for p, x in enumerate(own))
                    if there >= width - min(missing, width - 1):
                        key, value = (doc, str(item), start), (width - there, low)
                        out[key] = min(out.get(key, value), value)
    return out


@pytest.mark.parametrize("slack,missing", [(0, 0), (2, 2), (1, 4)])
def test_proximity_equals_brute_force(spark, docs, slack, missing):
    """Passages with words put in, left out and replaced, by words that no document has too."""
    rng = random.Random(slack + missing)
    vocabulary = ["w%d" % k for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 6, 13, 15])))) for k in range(12)]
    items += [(20, items[3][1] + " unseenone " + items[4][1]), (3, items[5][1]), (21, None), (22, "!"), (None, "w1 w2 w3")]
    rows = []
    for k in range(40):
        words = rng.choice(items[:13])[1].split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at: at + rng.randrange(2)] = rng.choice([[], ["w7"], ["other"]])
        rows.append((k, " ".join(rng.choices(vocabulary, k=5) + words + rng.choices(vocabulary, k=rng.randrange(8)))))
    rows += [(50, None), (51, ""), (3, "w1 w2 w3 w4"), (None, items[3][1]), (7, rows[7][1])]
    got = dc.proximity(docs(rows), spark.createDataFrame(items, "item_id long, text string"), slack=slack, missing=missing).collect()
    assert {(r.doc_id, r.item_id, r.start): (r.wanting, r.diagonal) for r in got} == near_brute(rows, items, 13, slack, missing) and len(got) == len({tuple(r)[:3] for r in got})


def test_proximity_finds_a_word_replaced_everywhere(spark, docs):
    item = "alpha one two beta three four five six seven eight nine ten eleven"
    texts = [(1, item), (2, item.replace("beta", "gamma")), (3, item.replace("two beta", "two extra words beta")), (4, "beta " + "x " * 40 + "alpha")]
    got = {r.doc_id: r.wanting for r in dc.proximity(docs(texts), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    assert {r.doc_id for r in dc.proximity(docs(texts[1:2]), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()} == {2}


def test_near_anchors_leave_two_wherever_words_are_wanting():
    """Whichever `missing` words of a window are wanting, two of its anchors are there: one alone is no candidate."""
    import itertools

    rng = random.Random(5)
    for width, missing in [(13, 2), (6, 2), (4, 2), (3, 2), (1, 2), (6, 0), (6, 3)]:
        for _ in range(20):
            counts = dc.np.array(rng.choices([0, 1, 1, 5, 9, 9], k=width + rng.randrange(4)))
            places = set(dc.near_anchors(counts, width, missing))
            allowed = min(missing, width - 1)
            for start in range(len(counts) - width + 1):
                own = range(start, start + width)
                absent = {p for p in own if counts[p] == 0}
                for wanting in itertools.combinations(own, allowed):
                    if absent <= set(wanting):
                        assert len((places & set(own)) - set(wanting)) >= min(2, width - allowed)


def test_proximity_of_an_item_of_many_segments(spark, docs):
    rng = random.Random(8)
    item = ["t%d" % rng.randrange(150) for _ in range(3 * dc.STARTS + 5)]
    rows = [(k, " ".join(["x"] * k + item[max(0, at - 20): at] + ["x"] * (k % 2) + item[at: at + 20])) for k, at in enumerate(range(10, len(item), 17))]
    got = dc.proximity(docs(rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start): (r.wanting, r.diagonal) for r in got} == near_brute(rows, [(1, " ".join(item))]) and len(got) > 200
