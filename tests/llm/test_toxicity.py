import random
import zlib

import numpy as np

from casegraph.llm import toxicity as tx


def corpus(n=900):
    rng = random.Random(6)
    filler = ["%s%s" % (a, b) for a in ("lor", "ips", "dol", "sit", "ame") for b in ("um", "em", "or", "is", "at", "en")]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(filler) for _ in range(40)]
        toxic = int(rng.random() < 0.15)
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blorp", "snarg", "you blorp", "frubbling", "frubbler"]))
        rows.append((k, " ".join(words) + "."))
        labels.append((k, toxic))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    frame, marks = docs(rows), spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, toxic int, text string")
    grammar = tx.learn(frame, marks)
    assert grammar.insults and all(any(f.startswith(s) for s in ("blor", "snar", "frub")) for f in grammar.insults)
    truth = dict(labels)
    got = tx.score(frame, grammar).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    own = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.97
    kept = tx.acceptable(frame, grammar)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)


def test_held_out_rows_teach_nothing(spark, docs):
    rows, labels = corpus(300)
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, t in labels]
    learn = lambda x: tx.learn(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int"))
    one, two = learn(labels), learn(flipped)
    assert one.insults == two.insults and np.allclose(one.weights, two.weights) and one.bias == two.bias


def test_edges(spark, docs):
    grammar = tx.Grammar(frozenset({"blorp"}), tx.own_weights(), tx.BIAS)
    rows = [(1, None), (2, ""), (None, "blorp"), (3, "x " * 100_000 + "you blorp. you blorp. you blorp. you blorp"), (3, "x"), (4, '"' * 999)]
    got = tx.score(docs(rows), grammar).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    assert {r.predicted for r in got if r.doc_id in (1, 2, 4)} == {0} and max(r.score for r in got if r.doc_id == 3) > 0.7
    assert tx.score(docs([]), grammar).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.learn(docs([]), none).insults == frozenset()
    assert tx.learn(docs(rows), spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")).insults == frozenset()


def letters(text):
    return "".join(map(tx.Classes(frozenset({"blorp", "snar*"})).__getitem__, tx.symbols(text.encode())))


def test_transducers():
    assert letters("You are a blorp! He said: \"snargly\"") == "a--ieare" + "qiq" or letters("You are a blorp!").startswith("a--i")
    assert tx.negate("nxi") == {1, 2}
    assert tx.report("r-i", False) == ({0, 1, 2}, False) and tx.report("-qi", False)[1]
    assert tx.aim("a--i") == {3} and tx.aim("a-----i") == set()
    plain, aimed, soft = (tx.patterns(x) for x in ("--i--", "a-i", "n-i"))
    assert plain[0] == 1 and aimed[2] == 1 and soft[1] == 1
    assert tx.patterns("--t--").sum() == 0 and tx.patterns("t-a")[6] == 1
    w = tx.own_weights()
    value = [tx.scores(p[None], w, tx.BIAS)[0] for p in (soft, plain, aimed)]
    assert value == sorted(value) and len(set(value)) == 3


def test_beginnings_give_way_to_cleaner_features():
    found = {"lose*": (100, 6), "loser": (99, 0), "idio*": (50, 0), "idiot": (50, 0), "chll*": (40, 1), "chlla*": (20, 0)}
    assert tx.chosen(found) == {"loser", "idio*", "chll*"}
