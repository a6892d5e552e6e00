import hashlib
import random

from casegraph.llm import substring_dedup as sd


def brute(rows, window):
    first, out = {}, []
    for doc, text in rows:
        words = (text or "").split()
        for k in range(len(words) - window + 1):
            if doc is not None:
                gram = tuple(words[k: k + window])
                first[gram] = min(first.get(gram, doc), doc)
    for doc, text in rows:
        words = (text or "").split()
        drop = [False] * len(words)
        for k in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[k: k + window])] < doc:
                drop[k: k + window] = [True] * window
        kept = " ".join(w for w, d in zip(words, drop) if not d)
        out.append((doc, len(words), sum(drop), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def check(docs, rows, window=50, gram=25):
    got = sd.dedup(docs(rows), window=window, gram=gram)
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=str) == brute(rows, window)
    for r in got.collect():
        assert r.n_removed == sum(s.end - s.start for s in r.spans)


def test_planted_passages_and_edges(docs):
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(100_000)
    passage = [word() for _ in range(140)]
    text = lambda n: [word() for _ in range(n)]
    rows = [(k, " ".join(text(rng.randrange(60)) + passage[rng.randrange(60): 80 + rng.randrange(60)] + text(rng.randrange(60)))) for k in range(60, 10, -1)]
    rows += [(100, " ".join(passage)), (101, " ".join(passage)), (101, " ".join(passage)), (102, "  ".join(passage)), (103, " ".join(passage[:50])), (104, " ".join(passage[:49]))]
    rows += [(105, None), (106, ""), (None, " ".join(passage)), (107, "a " * 400), (108, "a " * 300), (3, "a " * 55), (109, " ".join(passage + text(5) + passage))]
    long = text(30_000)
    rows += [(200, " ".join(long)), (201, " ".join(long[10_000:20_000] + passage[:70]))]
    check(docs, rows)


def test_different_texts_under_one_id(docs):
    """Each text has factors of its own; an id is never its own source, also where only white space differs."""
    rng = random.Random(6)
    text = lambda n: ["w%d" % rng.randrange(100_000) for _ in range(n)]
    passage, own = text(80), text(90)
    rows = [(1, " ".join(passage)), (5, " ".join(text(80) + passage)), (5, " ".join(own)), (5, "  ".join(own)), (5, " ".join(own[:70] + text(9))), (9, " ".join(own)), (9, " ".join(passage)), (2, " ".join(passage))]
    check(docs, rows)


def test_small_windows_with_few_words(docs):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for k in range(80)]
    check(docs, rows, window=6, gram=3)


def test_empty(docs):
    assert sd.dedup(docs([])).count() == 0
