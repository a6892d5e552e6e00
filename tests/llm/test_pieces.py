import math
from collections import Counter

import numpy as np
import pytest

from casegraph.llm import pieces as pc
from casegraph.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  two  spaces ", "plain words, and more", "line\n\n  feeds\r\n\ttabs", "▁ literal ▁▁x", "日本語 𝄞 é ß \x00\x7f", "x" * 3000,
         "word " * 20_000, "<s> <unk> <0x41> </s>", "a b c"]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.Vocabulary.load(MODEL)


def test_round_trip_and_reference_decoder(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(TEXTS)) + [(None, "no key"), (4, TEXTS[4])]
    out = pc.encode(docs(rows), MODEL)
    again = pc.decode(out, MODEL).collect()
    assert len(again) == len(rows)
    for r in again:
        assert r.decoded == r.text
        if r.text is None:
            assert (r.piece_ids, r.n_pieces, r.lossless, r.decoded_sha256) == (None,) * 4
        else:
            assert r.lossless and r.n_pieces == len(r.piece_ids)
            if "▁" not in r.text:
                assert model.decode(r.piece_ids) == r.text
    same = [tuple(r.piece_ids) for r in again if r.doc_id == 4]
    assert len(same) == 2 and len(set(same)) == 1
    shuffled = {r.doc_id: r.piece_ids for r in pc.encode(docs(rows[::-1]).repartition(7), MODEL).collect()}
    assert all(shuffled[r.doc_id] == r.piece_ids for r in again)


def test_seed_and_key_change_the_draw(docs):
    text = "internationalization of unbelievable characterizations " * 5
    ids = lambda rows, **o: [r.piece_ids for r in pc.encode(docs(rows), MODEL, **o).orderBy("doc_id").collect()]
    one, two = ids([(1, text), (2, text)], alpha=0.3)
    assert one != two and ids([(1, text)], alpha=0.3, seed=5)[0] != one and ids([(1, text)], alpha=0.3)[0] == one


@pytest.mark.parametrize("word", ["hers", "into it", "日b"])
def test_draws_follow_the_lattice(vocabulary, word):
    """The share of each segmentation is its weight among all of them."""
    spelled = {}
    for k, s in enumerate(vocabulary.spelled):
        if s and k not in set(vocabulary.byte_piece.tolist()):
            spelled.setdefault(s, k)
    whole = b" " + word.encode()

    def paths(at):
        if at == len(whole):
            yield (), 0.0
        for end in range(at + 1, len(whole) + 1):
            if (k := spelled.get(whole[at:end])) is not None:
                for rest, weight in paths(end):
                    yield (k, *rest), weight + vocabulary.weight[k]

    weights = dict(paths(0))
    total = sum(map(math.exp, weights.values()))
    n = 20_000
    drawn = pc.encode_batch(list(range(n)), [word.encode()] * n, vocabulary, vocabulary.steps(), pc._char_sizes(), 3)
    got = Counter(tuple(d.tolist()) for d in drawn)
    assert set(got) <= set(weights)
    for path, weight in weights.items():
        p = math.exp(weight) / total
        assert abs(got[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_empty(docs):
    assert pc.encode(docs([]), MODEL).count() == 0


def test_units_do_not_depend_on_the_batch(vocabulary):
    steps, size = vocabulary.steps(), pc._char_sizes()
    texts = [b"one two three", b"two two one", b"another text here"]
    together = pc.encode_batch([1, 2, 3], texts, vocabulary, steps, size, 1)
    alone = [pc.encode_batch([k], [t], vocabulary, steps, size, 1)[0] for k, t in zip((1, 2, 3), texts)]
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
